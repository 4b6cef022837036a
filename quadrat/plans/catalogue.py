"""All queries of the library and their SQL twins, by name."""

from quadrat.plans import classify_queries, community_queries, constrained_queries, denoise_queries, differential_queries, diversity_queries, genome_queries, interval_queries, label_queries, marker_queries, mixed_queries, naming_queries, reader_queries, reads_queries, scaling_queries, selection_queries, stats_queries, summary_queries, typing_queries  # noqa: F401  (they register themselves)
from quadrat.plans.analogue import ORACLES, QUERIES  # noqa: F401

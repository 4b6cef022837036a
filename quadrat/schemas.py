"""Canonical tables. Feature counts are long: one row for each sample and feature that has reads."""

from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

RANKS = ["domain", "kingdom", "phylum", "class", "order", "family", "genus", "species"]


def _table(*columns: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in columns])


_S, _L, _D, _I = StringType(), LongType(), DoubleType(), IntegerType()

FEATURES = _table(("feature_id", _S), ("sample", _S), ("reads", _D))
TAXONOMY = _table(("feature_id", _S), *((r, _S) for r in RANKS))
TRACKING = _table(("sample", _S), ("stage", _S), ("stage_no", _I), ("reads", _L))
HITS = _table(("query", _S), ("subject", _S), ("pident", _D), ("length", _I), ("qlen", _I), ("bitscore", _D), ("qcov", _D), ("evalue", _D))
LINEAGES = _table(("subject", _S), *((r, _S) for r in RANKS[2:]), ("source", _S), ("accession", _S), ("species_all", ArrayType(_S)))
PAF = _table(("qname", _S), ("qlen", _L), ("qs", _L), ("qe", _L), ("strand", _S), ("tname", _S), ("tlen", _L), ("ts", _L), ("te", _L), ("nmatch", _L), ("alen", _L), ("mapq", _I), ("de", _D), ("cs", _S))
KRAKEN_TREE = _table(("sample", _S), ("taxid", _L), ("rank", _S), ("name", _S), ("parent", _L), ("clade_reads", _L), ("depth", _I))
FUNCTIONS = _table(("sample", _S), ("feature", _S), ("taxon", _S), ("value", _D))
DISTANCES = _table(("metric", _S), ("i", _S), ("j", _S), ("d", _D))
READS = _table(("file", _S), ("read_no", _L), ("header", _S), ("seq", _S), ("qual", _S))

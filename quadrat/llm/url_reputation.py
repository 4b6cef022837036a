"""Empirical-Bayes reputation of hosts from labelled pages, with rules above it (operator 10). DataFrame functions only.

A labelled page is bad or good. Counts are shrunk level by level: a suffix
towards the share of all pages, a registered domain towards its suffix, a host
towards its domain. At each level the prior is a beta distribution whose mean
is the level above and whose strength is estimated from all groups of the level
by the moments of the beta-binomial. A host is blocked if a lower bound of its
posterior bad share (mean less ``Z`` posterior standard deviations) is over
``LIFT`` times the bad share of all labelled pages, or over ``LIMIT``.

The counts are aggregated before any shuffle, so a host with a third of all
pages is one row of each task, and written once, a row a host; in the join back
to the pages a host is a skewed key, which AQE splits. Only one row of sums for
each level comes to the driver.

The registered domain is the last two labels of a host, or the last three where
those are a two-letter country and one of ``SECOND``; the suffix is what follows
its first label. A table of suffix rules takes the place of that list if one is
given: plain rules (``co.uk``), wildcards (``*.ck``) and exceptions
(``!www.ck``), in lower case. A host's last labels meet the rules by an
equi-join, as many of them as the longest rule has; an exception wins, else the
longest suffix; a host that no rule fits ends in its last label.

Results in odd cases: a null url, or one without ``://``, has an empty host and
path; empty hosts form one group like any other; pages without a label count in
no rate and are judged by their host; of several labels of a page the worst
counts; without any label no host is blocked; rows are judged one by one, so
repeated rows and null page_ids stay, the latter without a label; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import settled

# Second labels under which countries register domains.
SECOND = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: Action, host and path of the rules; the longest that fits wins.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
Z, LIFT, LIMIT = 1.645, 2.0, 0.5
LEVELS = ["suffix", "domain", "host"]

_ADDRESS = "://([^/?#]*)([^?#]*)"
_NUMBER = "://[^/?#]*/[^/?#]*/([0-9]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _ADDRESS, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _ADDRESS, 2), F.lit(""))


def with_levels(df: DataFrame) -> DataFrame:
    """Adds domain and suffix to rows with a host. A host of one label is its own domain, and its suffix too."""
    parts = F.split("host", r"\.")
    n = F.size(parts)
    country = (n >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.get(parts, n - 2).isin(SECOND)
    domain = F.array_join(F.slice(parts, F.greatest(F.lit(1), n - F.when(country, 2).otherwise(1)), F.lit(3)), ".")
    suffix = F.array_join(F.slice(parts, F.greatest(F.lit(1), n - F.when(country, 1).otherwise(0)), F.lit(2)), ".")
    return df.select("*", domain.alias("domain"), suffix.alias("suffix"))


def _suffix_labels(df: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, labels): how many labels of each different host are its suffix by the rules. rules: (rule)."""
    text = F.lower(F.trim("rule"))
    known = rules.where(F.trim("rule") != "").select(F.regexp_replace(text, r"^(!|\*\.|\.)", "").alias("tail"), F.when(text.startswith("!"), -1).when(text.startswith("*."), 1).otherwise(0).alias("more")).distinct()
    deep = known.agg(F.max(F.size(F.split("tail", r"\."))).alias("deep")).first()["deep"] or 0
    hosts = df.where("host IS NOT NULL").select("host").distinct()
    n, parts = F.size(F.split("host", r"\.")), F.split("host", r"\.")
    tails = hosts.select("host", n.alias("n"), F.explode(F.sequence(F.lit(0), F.least(n, F.lit(deep)))).alias("k"), parts.alias("parts")).where("k > 0")
    tails = tails.select("host", "n", "k", F.array_join(F.slice("parts", F.col("n") - F.col("k") + 1, F.col("k")), ".").alias("tail"))
    fits = tails.join(known, "tail").withColumn("labels", F.col("k") + F.col("more")).where("labels BETWEEN 1 AND n")
    best = fits.groupBy("host").agg(F.max(F.struct((F.col("more") < 0).alias("exception"), "labels")).alias("best"))
    return hosts.join(best, "host", "left").select("host", F.coalesce("best.labels", F.lit(1)).alias("labels"))


def with_ruled_levels(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds domain and suffix to rows with a host, by a table of suffix rules. A host that is a suffix is its own domain."""
    labels = _suffix_labels(df, rules).withColumnRenamed("host", "__host").withColumnRenamed("labels", "__labels")
    parts = F.split("host", r"\.")
    last = lambda k: F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - k + 1), F.size(parts)), ".")
    return df.join(labels, F.col("host") == F.col("__host"), "left").select(*[F.col(f"`{c}`") for c in df.columns], last(F.col("__labels") + 1).alias("domain"), last(F.col("__labels")).alias("suffix"))


def _strength(groups: DataFrame) -> float:
    """Strength of the beta priors of a level's groups (n, bad, prior), by the moments of the beta-binomial around each group's prior mean."""
    spare = F.col("prior") * (1 - F.col("prior"))
    s = groups.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2)).alias("spread"), F.sum(spare).alias("free"), F.sum(spare * (F.col("n") - 1)).alias("room")).first()
    rho = (s["spread"] - s["free"]) / s["room"] if s["room"] else 0.0
    rho = min(max(rho, 1e-3), 0.999)
    return (1 - rho) / rho


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z, lift: float = LIFT, limit: float = LIMIT, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, bad_share, bound, bad_host): posterior mean and lower bound of each host's bad share, and whether the bound is over the limit. outcomes: (page_id, bad), 0 or 1 for labelled pages; suffixes: (rule)."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"))
    known = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    own = seen.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.sum(F.coalesce("bad", F.lit(0))).cast("long").alias("bad"))
    hosts, _ = settled(with_levels(own) if suffixes is None else with_ruled_levels(own, suffixes), "hosts")
    counts = {"host": hosts}
    for level, below in (("domain", "host"), ("suffix", "domain")):
        counts[level] = counts[below].groupBy(level, *(["suffix"] if level == "domain" else [])).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = counts["suffix"].agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    share = total["bad"] / total["n"] if total["n"] else 0.0
    out = None
    for level in LEVELS:
        above = {"suffix": None, "domain": "suffix", "host": "domain"}[level]
        own = counts[level].withColumn("prior", F.lit(float(share))) if above is None else counts[level].join(out.select(above, F.col("mean").alias("prior")), above)
        strength = F.lit(_strength(own))
        out = own.select("*", ((F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength)).alias("mean"), (F.col("n") + strength).alias("weight"))
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return out.select("host", F.col("mean").alias("bad_share"), bound.alias("bound")).withColumn("bad_host", F.col("bound") > min(lift * share, limit) if share else F.lit(False))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, else nulls."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(action)
    return name, action


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, lift: float = LIFT, limit: float = LIMIT, suffixes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_share, bound) of each row of pages."""
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bad_host"), "block").otherwise("allow")
    return seen.join(reputation(pages, outcomes, z, lift, limit, suffixes), "host", "left").select("page_id", "host", "path", name.alias("rule"), F.coalesce(action, own).alias("verdict"), F.round("bad_share", 9).alias("bad_share"), F.round("bound", 9).alias("bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page shows the document that its path names by number; it is bad if that is of low quality or toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0).alias("bad"))
    return pages.select("page_id", F.regexp_extract("url", _NUMBER, 1).try_cast("long").alias("doc")).join(known.where("doc IS NOT NULL").groupBy("doc").agg(F.max("bad").alias("bad")), "doc").select("page_id", "bad")


def _level_sql(level: str, above: str | None) -> str:
    """SQL of one level: its groups with their prior means, its strength, and its groups' posterior means."""
    prior, join = ("share", "CROSS JOIN total") if above is None else ("up.mean", f"JOIN {above}_post up ON g.{above} = up.{above}")
    return f"""
{level}_prior AS (SELECT g.*, {prior} AS prior FROM {level}_groups g {join}),
{level}_sums AS (SELECT sum(n * (bad / n::DOUBLE - prior) ** 2) AS spread, sum(prior * (1 - prior)) AS free, sum(prior * (1 - prior) * (n - 1)) AS room FROM {level}_prior WHERE n > 0),
{level}_rho AS (SELECT least(greatest(coalesce((spread - free) / nullif(room, 0), 0), 1e-3), 0.999) AS rho FROM {level}_sums),
{level}_post AS (SELECT g.*, (g.bad + (1 - rho) / rho * prior) / (g.n + (1 - rho) / rho) AS mean, g.n + (1 - rho) / rho AS weight FROM {level}_prior g CROSS JOIN {level}_rho)"""


def _rule_sql(what: str) -> str:
    when = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if what == 'name' else a}'" for a, h, p in sorted(RULES, key=lambda r: -len(r[1]) - len(r[2])))
    return f"CASE {when} END"


JUDGE_SQL = f"""
WITH seen AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{_ADDRESS}', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '{_ADDRESS}', 2), '') AS path, try_cast(regexp_extract(url, '{_NUMBER}', 1) AS BIGINT) AS doc_id FROM pages),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
known AS (SELECT page_id, max(bad) AS bad FROM seen JOIN marks USING (doc_id) WHERE page_id IS NOT NULL GROUP BY page_id),
hosts AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad FROM seen LEFT JOIN known USING (page_id) GROUP BY host),
parts AS (SELECT *, string_split(host, '.') AS p FROM hosts),
cut AS (SELECT *, (len(p) >= 3 AND length(p[-1]) = 2 AND p[-2] IN ({", ".join(f"'{s}'" for s in SECOND)}))::INT AS c FROM parts),
host_groups AS (SELECT host, n, bad, array_to_string(p[greatest(1, len(p) - 1 - c):], '.') AS domain, array_to_string(p[greatest(1, len(p) - c):], '.') AS suffix FROM cut),
domain_groups AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM host_groups GROUP BY domain, suffix),
suffix_groups AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domain_groups GROUP BY suffix),
total AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0)::DOUBLE, 0) AS share FROM suffix_groups),
{_level_sql("suffix", None)},{_level_sql("domain", "suffix")},{_level_sql("host", "domain")},
bounds AS (SELECT host, mean, mean - {Z} * sqrt(mean * (1 - mean) / (weight + 1)) AS bound FROM host_post)
SELECT page_id, seen.host, path, {_rule_sql("name").replace("host =", "seen.host =").replace("(host,", "(seen.host,")} AS rule,
  coalesce({_rule_sql("action").replace("host =", "seen.host =").replace("(host,", "(seen.host,")}, CASE WHEN share > 0 AND bound > least({LIFT} * share, {LIMIT}) THEN 'block' ELSE 'allow' END) AS verdict,
  round(mean, 9) AS bad_share, round(bound, 9) AS bound
FROM seen JOIN bounds ON seen.host = bounds.host CROSS JOIN total
"""

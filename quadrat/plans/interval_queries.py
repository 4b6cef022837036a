"""Queries on intervals, runs, running sums and histograms."""

from pyspark.sql import functions as F

from quadrat.operators import intervals as iv
from quadrat.plans.analogue import query, table

#: Intervals of an event: whole seconds from its time, as many minutes long as its value.
_E = "WITH x AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 60 * floor(value)::BIGINT AS e FROM events), "
_I = _E + """o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x),
k AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o),
i AS (SELECT user_id, min(s) AS s, max(e) AS e FROM k GROUP BY user_id, island) """


def _intervals(s, d):
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(s, d, "events").select("user_id", start.alias("start"), (start + 60 * F.floor("value")).alias("end"))


@query("islands", _I.format(gap=0) + 'SELECT user_id, s AS "start", e AS "end" FROM i')
def islands(s, d):
    return iv.islands(_intervals(s, d), ["user_id"])


@query("islands_closed_gap", _I.format(gap=601) + 'SELECT user_id, s AS "start", e AS "end" FROM i')
def islands_closed_gap(s, d):
    return iv.islands(_intervals(s, d), ["user_id"], gap=600, closed=True)


@query("union_length", _I.format(gap=0) + "SELECT user_id, sum(e - s)::BIGINT AS covered FROM i GROUP BY 1")
def union_length(s, d):
    return iv.union_length(_intervals(s, d), ["user_id"])


@query("coverage_gaps", _I.format(gap=0) + """, b AS (SELECT user_id, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY s), 1700000000) AS a, s AS b FROM i UNION ALL SELECT user_id, max(e), 1800000000 FROM i GROUP BY 1)
SELECT user_id, a AS "start", b AS "end" FROM b WHERE b - a >= 86400""")
def coverage_gaps(s, d):
    merged = iv.islands(_intervals(s, d), ["user_id"])
    return iv.gaps(merged, ["user_id"], 1700000000, 1800000000, 86400).select("user_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("n50", "WITH x AS (SELECT lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING) AS r, sum(n_chars) OVER (PARTITION BY lang) AS t FROM documents) SELECT lang, count(*) AS n, max(t)::BIGINT AS total, max(CASE WHEN r >= t / 2.0 THEN n_chars END) AS n50 FROM x GROUP BY 1")
def n50(s, d):
    return iv.n50(table(s, d, "documents"), ["lang"], "n_chars")


@query("low_runs", """WITH a AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), b AS (SELECT *, k - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM a WHERE value <= 20)
SELECT user_id, min(event_id) AS "start", max(event_id) AS "end", count(*) AS n FROM b GROUP BY user_id, g""")
def low_runs(s, d):
    return iv.low_runs(table(s, d, "events"), ["user_id"], "event_id", "value", 20)


@query("rolling_median", "SELECT event_id, CASE WHEN count(value) OVER w = 10 THEN round(median(value) OVER w, 6) END AS rolling FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)")
def rolling_median(s, d):
    return iv.rolling_median(table(s, d, "events"), ["user_id"], "event_id", "value").select("event_id", F.round("rolling", 6).alias("rolling"))


@query("smoothed", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 5) AS smooth FROM events")
def smoothed(s, d):
    return iv.smoothed(table(s, d, "events"), ["user_id"], "event_id", "value").select("event_id", F.round("smooth", 5).alias("smooth"))


@query("local_maxima", "SELECT event_id, value FROM (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) x WHERE (a IS NULL OR value > a) AND (b IS NULL OR value >= b)")
def local_maxima(s, d):
    return iv.local_maxima(table(s, d, "events"), ["user_id"], "event_id", "value").select("event_id", "value")


_BINS = "WITH h AS (SELECT lang, n_chars // 100 * 100 AS bin, count(*) AS n FROM documents GROUP BY 1, 2) "


def _bins(s, d):
    return table(s, d, "documents").groupBy("lang", (F.floor(F.col("n_chars") / 100) * 100).alias("bin")).agg(F.count("*").alias("n"))


@query("histogram_quantile", _BINS + "SELECT lang, min(bin) AS at FROM (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY bin ROWS UNBOUNDED PRECEDING) AS r, sum(n) OVER (PARTITION BY lang) AS t FROM h) x WHERE r >= 0.75 * t GROUP BY 1")
def histogram_quantile(s, d):
    return iv.histogram_quantile(_bins(s, d), ["lang"], "bin", "n", 0.75)


@query("recommended_length", _BINS + "SELECT lang, max(bin) AS at FROM (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r, sum(n) OVER (PARTITION BY lang) AS t FROM h) x WHERE r >= 0.9 * t GROUP BY 1")
def recommended_length(s, d):
    return iv.keep_at_least(_bins(s, d), ["lang"], "bin", "n", 0.9)


@query("until_total", "SELECT doc_id, running::BIGINT AS running FROM (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents) x WHERE running - n_chars < 10000")
def until_total(s, d):
    return iv.until_total(table(s, d, "documents"), ["source"], ["doc_id"], "n_chars", 10000).select("doc_id", "running")


@query("hashed_sample")
def hashed_sample(s, d):
    return iv.hashed_sample(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 1000)

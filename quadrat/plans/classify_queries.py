"""Queries on classifiers. Letters a, c, g and t of texts are sequences; documents are references of their language and source,
conversations are reads."""

from pyspark.sql import functions as F

from quadrat.operators import classify
from quadrat.plans.analogue import query, table

K, L = 13, 9  # short words: the texts' letters are no genomes


def _letters(c):
    return F.upper(F.regexp_replace(F.lower(c), "[^acgt]", ""))


def _references(s, d):
    return table(s, d, "documents").select(F.array("lang", "source").alias("lineage"), _letters("text").alias("seq"))


def _reads(s, d):
    read = F.concat_ws("/", "conv_id", "turn")
    return table(s, d, "conversations").select(read.alias("read"), _letters("text").alias("seq"))


def _minimizers(name, rows):
    """(id, w, n): minimizers of rows (id, seq), words written with the places of their letters in CTGA."""
    return f"""{name}_l AS (SELECT id, p, least(w, reverse(translate(w, '0123', '2301'))) AS w
  FROM (SELECT id, p, translate(substr(seq, p, {L}), 'CTGA', '0123') AS w FROM (SELECT id, seq, unnest(range(1, length(seq) - {L} + 2)) AS p FROM ({rows}) r WHERE length(seq) >= {K}) x) y),
{name} AS (SELECT id, w, count(*) AS n FROM (SELECT id, p, min(w) OVER (PARTITION BY id ORDER BY p ROWS {K - L} PRECEDING) AS w FROM {name}_l) x WHERE p > {K - L} GROUP BY 1, 2)"""


_CLEAN = "upper(regexp_replace(lower(text), '[^acgt]', '', 'g')) AS seq"
_INDEX = f"""WITH {_minimizers("m", f"SELECT doc_id AS id, {_CLEAN} FROM documents")},
i AS (SELECT w, min(lang) AS lang, min(lang) = max(lang) AS one, min(lang || chr(1) || source) = max(lang || chr(1) || source) AS same, min(source) AS source, count(DISTINCT lang || chr(1) || source) AS n_lineages FROM m JOIN documents ON doc_id = id GROUP BY w)"""


@query("minimizer_index", _INDEX + " SELECT translate(w, '0123', 'CTGA') AS word, CASE WHEN same THEN lang || '/' || source WHEN one THEN lang ELSE '' END AS lineage, n_lineages FROM i")
def minimizer_index(s, d):
    index = classify.minimizer_index(_references(s, d), K, L)
    return index.select(classify.word_text(F.col("minimizer"), L).alias("word"), F.array_join("lineage", "/").alias("lineage"), "n_lineages")


@query("classified_reads", _INDEX + f""", {_minimizers("q", f"SELECT conv_id || '/' || turn AS id, {_CLEAN} FROM conversations")},
h AS (SELECT id, CASE WHEN one THEN lang ELSE '' END AS a, CASE WHEN same THEN source ELSE '' END AS b, sum(n) AS n FROM q JOIN i USING (w) GROUP BY 1, 2, 3),
s AS (SELECT x.id, x.a, x.b, sum(y.n) AS score FROM h x JOIN h y ON x.id = y.id AND ((y.a = '' AND y.b = '') OR (y.a = x.a AND y.b = '') OR (y.a = x.a AND y.b = x.b)) GROUP BY 1, 2, 3),
t AS (SELECT *, max(score) OVER (PARTITION BY id) AS best FROM s),
u AS (SELECT id, best, CASE WHEN min(a) = max(a) THEN min(a) ELSE '' END AS a, CASE WHEN min(a) = max(a) AND min(b) = max(b) THEN min(b) ELSE '' END AS b FROM t WHERE score = best GROUP BY 1, 2),
w AS (SELECT id, sum(n) AS windows FROM q GROUP BY 1), f AS (SELECT id, sum(n) AS hits FROM h GROUP BY 1)
SELECT r.id AS read, CASE WHEN u.id IS NULL THEN NULL WHEN b <> '' THEN a || '/' || b ELSE a END AS lineage, coalesce(best, 0)::BIGINT AS score, coalesce(hits, 0)::BIGINT AS hits, coalesce(windows, 0)::BIGINT AS windows
FROM (SELECT DISTINCT conv_id || '/' || turn AS id FROM conversations) r LEFT JOIN u ON u.id = r.id LEFT JOIN w ON w.id = r.id LEFT JOIN f ON f.id = r.id""")
def classified_reads(s, d):
    out = classify.classified_reads(_reads(s, d), classify.minimizer_index(_references(s, d), K, L), K, L)
    return out.withColumn("lineage", F.array_join("lineage", "/"))


_WORDS = "SELECT DISTINCT id, g, substr(seq, p, 8) AS w FROM (SELECT id, g, seq, unnest(range(1, length(seq) - 6)) AS p FROM ({}) r WHERE length(seq) >= 8) x"


@query("bayes_scores", f"""WITH t AS ({_WORDS.format(f"SELECT doc_id AS id, lang || '/' || source AS g, {_CLEAN} FROM documents")}), q AS ({_WORDS.format(f"SELECT conv_id || '/' || turn AS id, '' AS g, {_CLEAN} FROM conversations")}),
c AS (SELECT lang || '/' || source AS g, count(*) AS m FROM documents GROUP BY 1), p AS (SELECT w, (count(*) + 0.5) / ((SELECT count(*) FROM documents) + 1) AS prior FROM t GROUP BY w),
k AS (SELECT t.w, g, ln((count(*) + any_value(prior)) / any_value(prior)) AS gain FROM t JOIN p ON p.w = t.w GROUP BY 1, 2),
b AS (SELECT id, sum(ln(prior)) AS base, count(*) AS words FROM q JOIN p ON p.w = q.w GROUP BY id),
s AS (SELECT q.id, k.g, sum(gain) AS gain FROM q JOIN k ON k.w = q.w GROUP BY 1, 2)
SELECT s.id AS read, s.g AS genus, round(base + gain - words * ln(m + 1.0), 4) AS score FROM s JOIN b ON b.id = s.id JOIN c ON c.g = s.g""")
def bayes_scores(s, d):
    training = table(s, d, "documents").select(F.concat_ws("/", "lang", "source").alias("genus"), _letters("text").alias("seq"))
    words = classify.different_words(_reads(s, d))
    return classify.bayes_scores(words, classify.bayes_model(training), ["read"]).select("read", "genus", F.round("score", 4).alias("score"))


@query("bayes_genera")
def bayes_genera(s, d):
    training = table(s, d, "documents").select(F.col("lang").alias("genus"), _letters("text").alias("seq"))
    return classify.bayes_genera(_reads(s, d), training)

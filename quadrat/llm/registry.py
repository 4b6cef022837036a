"""One query for each of the thirteen operators, with production parameters, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import ann, decontaminate, line_dedup, near_dup, packing, periodic, prefix_trie, repetition, shard_store, toxicity, url_reputation, warc
from quadrat.llm.common import finished, fresh_path
from quadrat.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(_table(spark, sf_dir, "embeddings"))
    return finished(spark, "nearest", lambda: ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5))


def op2_size_tiered_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before, after = shard_store.compacted(_table(spark, sf_dir, "documents"), fresh_path(spark, "shards"))
    done = shard_store.facts(before, after)
    return docs.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"), *[F.lit(v).alias(k) for k, v in done.items()])


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return finished(spark, "line-report", lambda: line_dedup.report(docs))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = _table(spark, sf_dir, "pages"), fresh_path(spark, "warc")  # the archives stay
    return finished(spark, "warc-report", lambda: warc.archive(pages, path))


def op6_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_best_fit_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.write_packed(_table(spark, sf_dir, "documents"), fresh_path(spark, "packed"))
    return out.select("sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"))


def op8_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    leaks = [(F.col("n_leaks") > 0).alias("contaminated"), "n_leaks", F.col("leaks.item_id").alias("item_ids")]
    return finished(spark, "leak-report", lambda: decontaminate.find_leaks(docs, items).select("doc_id", *leaks))


def op9_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    return finished(spark, "judged", lambda: url_reputation.judge(pages, url_reputation.page_outcomes(pages, labels)))


def op11_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.find_runs(periodic.looped(_table(spark, sf_dir, "documents"))))


def op12_repeat_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.report(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_rp_forest, op2_size_tiered_compaction, op3_dart_minhash, op4_line_windows, op5_warc_revisits, op6_nb_toxicity, op7_best_fit_matrix, op8_simhash_leaks, op9_slack_packing, op10_host_reputation, op11_harmonic_runs, op12_repeat_rules, op13_prefix_trie)}
ORACLES = {"op2_size_tiered_compaction": shard_store.COMPACTED_SQL, "op4_line_windows": line_dedup.REPORT_SQL, "op5_warc_revisits": warc.ARCHIVE_SQL, "op10_host_reputation": url_reputation.JUDGE_SQL, "op12_repeat_rules": repetition.REPORT_SQL, "op13_prefix_trie": prefix_trie.TRIE_SQL}

"""The stream of wanted reads over restarts, and ids that come later than their reads; repaired helpers of the library."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from quadrat.operators import community, controls, ordination
from quadrat.session import ship
from quadrat.streaming import wanted

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "read_id string, seq string, ts timestamp"


def put(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame([(*r[:-1], T0 + dt.timedelta(minutes=r[-1])) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_each_wanted_read_comes_once_over_restarts(spark, tmp_path):
    ids = spark.createDataFrame([("a",), ("c",), ("c",), (None,)], "read_id string")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        wanted.write_kept(wanted.kept_from_list(stream, ids), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return sorted((r["read_id"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(spark, tmp_path / "in", [("a", "AC", 0), ("b", "GG", 1)])
    assert run() == [("a", "AC")]
    assert run() == [("a", "AC")]  # nothing new: nothing again
    put(spark, tmp_path / "in", [("c", "TT", 2), (None, "AA", 3), ("a", "CA", 4)])
    assert run() == [("a", "AC"), ("a", "CA"), ("c", "TT")]


def test_ids_that_come_late(spark, tmp_path):
    def run():
        reads = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        ids = spark.readStream.schema("read_id string, ts timestamp").parquet(str(tmp_path / "ids"))
        wanted.write_kept(wanted.kept_when_wanted(reads, ids, "10 minutes"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return sorted((r["read_id"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(spark, tmp_path / "in", [("a", "AC", 0), ("b", "GG", 1)])
    put(spark, tmp_path / "ids", [("x", 0)], "read_id string, ts timestamp")
    assert run() == []
    put(spark, tmp_path / "ids", [("a", 5), ("a", 6), ("d", 4)], "read_id string, ts timestamp")
    assert run() == [("a", "AC")]  # from state, after a restart; once for both ids
    put(spark, tmp_path / "in", [("d", "TT", 3), ("x", "CC", 30)])
    assert run() == [("a", "AC"), ("d", "TT")]  # x came too early for its read


def test_names_of_pairs(spark):
    rows = spark.createDataFrame([("r1/1",), ("r1/2 extra",), ("r/3",), ("",)], "read_id string")
    assert [r[0] for r in rows.select(wanted.read_name()).collect()] == ["r1", "r1", "r/3", ""]


def test_numbers_of_one_common_value(spark):
    rows = spark.range(5000).select(F.col("id").alias("name"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(1).alias("value"))
    got = {r["name"]: r["number"] for r in community.numbered(rows, "value", "name").collect()}
    order = sorted(range(5000), key=lambda i: (-(i if i % 10 == 0 else 1), i))
    assert got == {name: n + 1 for n, name in enumerate(order)}


def test_levels_with_the_rest_last(spark):
    rows = spark.createDataFrame([("a", 1.0), ("Other", 99.0), ("b", 3.0), ("a", 2.0), ("c", 3.0)], "taxon string, value double")
    assert sorted(map(tuple, controls.ordered_levels(rows).collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "Other")]


def test_text_of_a_tree_of_5000_leaves_in_a_chain(spark):
    ship(spark)
    edges = []
    for i in range(5000):
        edges += [("m", f"#{i}", f"leaf {i}", 1.0), ("m", f"#{i}", f"#{i + 1}" if i < 4999 else "last", 0.5)]
    tree = ordination.newick(spark.createDataFrame(pd.DataFrame(edges, columns=["matrix", "parent", "node", "length"]))).first()["tree"]
    assert tree.startswith("('leaf 0':1,('leaf 1':1,(") and tree.endswith("('leaf 4999':1,last:0.5)" + ":0.5)" * 4999 + ";")
    assert tree.count("(") == tree.count(")") == 5000

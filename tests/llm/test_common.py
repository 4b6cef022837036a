"""Scratch tables: each thread drops its own, and finished results leave nothing else behind."""

import threading

from quadrat.llm import common


def test_a_thread_drops_only_its_own(spark):
    """One scratch ends while another thread still reads what it has written."""
    written, dropped, found = threading.Event(), threading.Event(), []

    def long():
        with common.scratch(spark):
            table, _ = common.settled(spark.range(50), "long")
            written.set()
            dropped.wait(60)
            found.append(table.count())

    def short():
        with common.scratch(spark):
            written.wait(60)
            found.append(common.settled(spark.range(7), "short")[0].count())
        dropped.set()

    threads = [threading.Thread(target=t) for t in (long, short)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(found) == [7, 50]


def test_nested_scratch_and_kept_paths(spark):
    with common.scratch(spark) as outer:
        with common.scratch(spark) as inner:
            kept, path = common.settled(spark.range(3), "kept")
            inner.remove(path)
        assert kept.count() == 3 and path in outer
    assert common._open.get() == ()


def test_finished_leaves_its_result_alone(spark):
    def made():
        return common.settled(spark.range(9), "on-the-way")[0].where("id > 4")

    root = f"{common.shared_root(spark)}/quadrat"
    out = common.finished(spark, "whole", made)
    fs = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(root))]
    assert out.count() == 4 and any(n.startswith("whole-") for n in names) and not any(n.startswith("on-the-way-") for n in names)

"""Writers that commit at the same time, in threads and in processes: every commit is there, every version can be read."""

import subprocess
import sys
import threading
from pathlib import Path

import pytest

from quadrat.llm import ann, shard_store


def whole(store, names):
    versions = store.versions()
    assert versions == list(range(1, len(names) + 1))
    for v in versions:
        assert store.manifest(v)["version"] == v and len(store.manifest(v)["shards"]) == v
    assert {s["path"] for s in store.manifest()["shards"]} == names
    assert not [f for f in store._fs.listStatus(store._path("_manifests")) if f.getPath().getName().startswith("draft")]


@pytest.mark.parametrize("again", range(6))
def test_threads(spark, tmp_path, again):
    def write(k):
        own = shard_store.ShardStore(spark, f"file://{tmp_path}/s")
        for n in range(4):
            own._commit("{}", [{"path": f"{k}-{n}", "bytes": 1}], set())

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    whole(shard_store.ShardStore(spark, f"file://{tmp_path}/s"), {f"{k}-{n}" for k in range(6) for n in range(4)})


PROCESS = """
import sys, time
sys.path.insert(0, sys.argv[1])
from quadrat.llm.shard_store import ShardStore
from quadrat.session import session
own = ShardStore(session("writer", master="local[1]", memory="512m"), sys.argv[2])
print("ready", flush=True)
sys.stdin.readline()
for n in range(40):
    own._commit("{}", [{"path": f"{sys.argv[3]}-{n}", "bytes": 1}], set())
"""


def test_processes(spark, tmp_path):
    home, root = str(Path(__file__).parents[2]), f"file://{tmp_path}/p"
    running = [subprocess.Popen([sys.executable, "-c", PROCESS, home, root, k], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True) for k in "ab"]
    for p in running:
        assert p.stdout.readline().strip() == "ready"
    for p in running:
        p.stdin.write("go\n")
        p.stdin.flush()
    assert [p.wait(timeout=120) for p in running] == [0, 0]
    whole(shard_store.ShardStore(spark, root), {f"{k}-{n}" for k in "ab" for n in range(40)})


def test_very_long_texts_and_names_that_differ_in_case(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x" * 3_000_000, "a"), (2, None, None)], "doc_id long, text string, Shard string")
    rows, _, _ = shard_store.compacted(docs, f"file://{tmp_path}/c")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, docs.collect()))


def test_of_an_id_with_two_vectors_the_smaller_counts(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [-1.0, -1.0])], "vec_id long, v array<double>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(vectors, vectors, k=1).collect()}
    assert got[0, 1] == 2 and got[1, 1] == 2 and got[2, 1] == 0 and len(got) == 4


def test_a_group_with_many_queries_is_dealt_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(400, 8)))]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>")
    whole_ = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(vectors, vectors, k=3).collect()}
    monkeypatch.setattr(ann, "ASKED", 50)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(vectors, vectors, k=3).collect()} == whole_

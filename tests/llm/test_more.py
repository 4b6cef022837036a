"""Neighbours, shards, archives, host reputation, the entry point and the pipeline."""

import gzip
import hashlib

import numpy as np
import pytest

from quadrat.llm import ann, registry, shard_store, url_reputation, warc

SF = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def nearest(v, every=1, **options):
    u = ann.usable(v)
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.nearest(u, u.where(f"vec_id % {every} = 0"), **options).collect()}


def test_neighbours_equal_brute_force_when_all_is_searched(spark):
    x = np.random.default_rng(1).normal(size=(300, 8)).astype(np.float32)
    x[50:80] = x[7]
    v = vectors(spark, [(i, r.tolist(), "a") for i, r in enumerate(x)])
    got = nearest(v, 10, leaf=16, recall=1.0)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 300, 10):
        s = u @ u[q]
        order = [i for i in np.lexsort((np.arange(300), -np.round(s, 12))) if i != q][:5]
        hits += sum(got[q, k + 1][0] == i for k, i in enumerate(order))
        assert all(abs(got[q, k + 1][1] - s[got[q, k + 1][0]]) < 1e-12 for k in range(5))
    assert hits >= 0.97 * 150


def test_recall_on_the_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = nearest(spark.read.parquet(f"{SF}/embeddings.parquet"), 50)
    share = []
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        best = set(ids[np.argsort(-s)[:5]].tolist())
        share.append(len(best & {got[int(ids[q]), k][0] for k in range(1, 6)}) / 5)
    assert np.mean(share) >= 0.9


def test_ties_of_scalar_multiples_go_to_the_smaller_id():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.normal(size=4).astype("<f4")
    x = np.array([base * np.float32(2.0 ** (i % 9 - 4)) for i in range(20)] + [rng.normal(size=4).astype("<f4") for _ in range(10)])
    ids = np.arange(30)
    index = pa.table({"tree": pa.array(np.zeros(30, np.int32)), "leaf": pa.array(np.zeros(30, np.int32)), "id": ids, "ids": [[i] for i in ids], "v": [r.tobytes() for r in x]})
    probes = pa.table({"q": pa.array([7]), "v": [x[7].tobytes()], "at": pa.array([[0]], pa.list_(pa.int64()))})
    got = ann._ranked(index, probes, 4, 6).to_pydict()
    assert got["id"] == [0, 1, 2, 3, 4, 5] and len(set(got["score"])) == 1


def test_ties_through_the_whole_search(spark):
    rows = [(i, [float(2 ** (i % 5)), float(2 ** (i % 5 + 1))], "a") for i in range(30)] + [(100 + i, [1.0, -float(i)], "a") for i in range(30)]
    got = nearest(vectors(spark, rows), leaf=4)
    assert all([got[q, r][0] for r in range(1, 6)] == [i for i in range(7) if i != q][:5] for q in range(30))


def test_large_leaves_and_many_queries_are_dealt_in_parts(spark, monkeypatch):
    x = np.random.default_rng(5).normal(size=(200, 6)).astype(np.float32)
    v = vectors(spark, [(i, r.tolist(), "a") for i, r in enumerate(x)])
    want = nearest(v, 4, leaf=64, recall=1.0)
    monkeypatch.setattr(ann, "GROUP", 10)
    monkeypatch.setattr(ann, "ASKED", 7)
    assert nearest(v, 4, leaf=64, recall=1.0) == want


def test_queries_whose_leaves_hold_too_few_are_held_against_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "fitted_search", lambda *a: 1.0)
    x = np.random.default_rng(6).normal(size=(60, 4)).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    got = nearest(vectors(spark, [(i, r.tolist(), "a") for i, r in enumerate(x)]), 10, leaf=2, trees=1)
    for q in range(0, 60, 10):
        want = [i for i in np.argsort(-(u @ u[q])) if i != q][:5]
        assert [got[q, r][0] for r in range(1, 6)] == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "b"), (1, [2.0, 0.0], "a"), (2, None, "a"), (3, [0.0, 0.0], "a"), (4, [nan, 1.0], "a"), (5, [inf, 1.0], "a"), (6, [None, 1.0], "a"), (7, [1.0], "a"), (None, [1.0, 1.0], "a"), (8, [0.0, 1.0], "a"), (9, [1.0, 0.0], "a"), (10, [], "a")]
    got = nearest(vectors(spark, rows))
    assert {q for q, _ in got} == {0, 1, 8, 9}
    assert [got[0, k][0] for k in (1, 2, 3)] == [1, 9, 8] and (0, 4) not in got
    assert [got[9, k][0] for k in (1, 2, 3)] == [0, 1, 8]
    assert nearest(vectors(spark, rows[3:4])) == {} and nearest(vectors(spark, []).where("false")) == {}


def test_store_round_trip_and_versions(spark, tmp_path, documents):
    store = shard_store.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=200_000, fanout=3, shard_rows=5)
    assert store.manifest()["version"] == 0
    docs = documents([None, "", "a\nb", "é" * 5000] + [f"text {i}" for i in range(60)])
    for part in docs.randomSplit([1.0] * 4, 1):
        store.append(part)
    before = store.manifest()
    assert before["version"] == 4
    after = store.compact()
    assert len(after["shards"]) < len(before["shards"]) and after["version"] > 4
    want = sorted(map(tuple, docs.collect()), key=str)
    assert sorted(map(tuple, store.read().collect()), key=str) == want
    assert sorted(map(tuple, store.read(4).collect()), key=str) == want
    assert store.vacuum() == 0 and store.read(4).count() == 64  # neither old enough
    assert store.vacuum(safe_age=0.0) > 0
    assert store.read().count() == 64
    store.append(docs.where("false"))
    assert store.read().count() == 64
    with pytest.raises(ValueError, match="columns"):
        store.append(docs.select("doc_id"))


def test_concurrent_writers_lose_nothing(spark, tmp_path, documents):
    a, b = (shard_store.ShardStore(spark, f"file://{tmp_path}/s", fanout=2) for _ in range(2))
    a.append(documents(["x"]))
    a.append(documents(["y"]))
    old = b.manifest
    stale = old()
    calls = iter([stale])
    b.manifest = lambda version=None: next(calls, None) or old(version)
    a.append(documents(["z"]))
    b._commit(stale["schema"], [], set())
    assert a.read().count() == 3 and a.manifest()["version"] == 4
    a.compact()
    a.vacuum(safe_age=0.0)
    with pytest.raises(shard_store.Conflict):
        b._commit(stale["schema"], [], {stale["shards"][0]["path"]})


def test_vacuum_between_write_and_commit(spark, tmp_path, documents):
    a, b = (shard_store.ShardStore(spark, f"file://{tmp_path}/s", fanout=2) for _ in range(2))
    a.append(documents(["x"]))
    written = b._write(documents(["y"]))
    assert a.vacuum() == 0
    b._commit(a.manifest()["schema"], written, set())
    assert a.read().count() == 2


def test_tiers_merge_by_size_into_target_sized_files(spark, tmp_path, documents):
    import random

    rng = random.Random(1)
    text = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    store = shard_store.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000, fanout=4, shard_rows=1)
    for n in (300, 300, 300, 300, 5000, 5000, 40_000):
        store.append(documents([text(n)]).coalesce(1))
    before = store.manifest()["shards"]
    assert len(before) == 7 and len({store.tier(s["bytes"]) for s in before}) == 3
    after = store.compact()["shards"]
    old = {s["path"] for s in before}
    left = [s["bytes"] for s in after if s["path"] in old]
    assert sorted(left) == sorted(s["bytes"] for s in before)[4:]  # only the tier of four small shards was merged
    assert len(after) == 4
    for _ in range(8):
        store.append(documents([text(5000)]).coalesce(1))
    merged = [s["bytes"] for s in store.compact()["shards"] if s["path"] not in {x["path"] for x in after}]
    assert merged and all(30_000 <= b <= 120_000 for b in merged)


def test_empty_table_in_a_store(spark, tmp_path, documents):
    rows, before, after = shard_store.compacted(documents(["x"]).where("false"), f"file://{tmp_path}/e")
    assert rows.count() == 0 and before["version"] == shard_store.ARRIVALS
    rows, before, after = shard_store.compacted(documents([f"text {i}" for i in range(200)]).coalesce(1), f"file://{tmp_path}/f")
    assert rows.count() == 200 and shard_store.facts(before, after) == {"arrivals": 4, "merges": True, "fewer_shards": True, "within_target": True}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def test_archives(spark, tmp_path):
    big, crlf = "é<p>" * 40, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 4
    rows = [(3, "http://a/", big, "x"), (1, "http://b/ c\r\nX: y", big, "x"), (2, None, "short", "x"), (5, "u", "short", "x"), (6, "u", None, "x"), (7, "u", crlf, "x"), (8, "u", crlf, "x"), (1, "http://b2/", big, "x"), (None, "u", big, "x"), (9, "u", "", "x"), (10, "u", "z" * 300_000, "x")]
    got = [tuple(r) for r in warc.archive(pages(spark, rows), f"file://{tmp_path}/w").collect()]
    want = []
    for p, _, html, _ in rows:
        data = (html or "").encode()
        revisit = {big: p != 1, crlf: p != 7}.get(html, False)
        want.append((p, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", {big: 1, crlf: 7}[html] if revisit else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    payloads = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, f"file://{tmp_path}/w", with_payload=True).where("record_type = 'response' AND page_id > 1").collect()}
    assert payloads == {2: "short", 5: "short", 6: "", 7: crlf, 9: "", 10: "z" * 300_000}
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    assert sum(len(list(warc.parse(p.read_bytes()))) for p in files) == len(rows)
    assert all(gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\n") for p in files)
    assert warc.archive(pages(spark, rows).where("false"), f"file://{tmp_path}/none").count() == 0


def test_archives_of_responses_are_deduplicated_again(spark, tmp_path):
    rows = [(i, f"http://h/{i}", "same " * 50 if i % 2 else f"own {i} " * 50, "x") for i in range(20)]
    plain = warc._with_headers(pages(spark, rows))
    warc.write_archives(warc.as_records(plain, warc.resolve(plain.select("page_id", "bytes", "digest").where("false"))), f"file://{tmp_path}/a")
    got = warc.dedup_archives(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b").collect()
    assert sorted(r["page_id"] for r in got if r["record_type"] == "revisit") == list(range(3, 20, 2))
    again = warc.dedup_archives(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/c").collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, got), key=str)


def test_targets_and_size_classes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", [(200, 3), (1000, 2), (None, 1)])
    urls = ["100%25 sure", "a%20b", "http://x/%20", "é b", None, "a+b", "x\r\ny"]
    sizes = [10, 150, 200, 201, 999, 1000, 1001, 5000]
    rows = [(i, urls[i % len(urls)], chr(97 + i % 26) * sizes[i % len(sizes)], "x") for i in range(24)]
    assert warc.archive(pages(spark, rows), f"file://{tmp_path}/w").count() == 24
    back = {r["page_id"]: r["url"] for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    assert back == {i: u or "" for i, u, *_ in rows}
    files = [list(warc.parse(p.read_bytes())) for p in (tmp_path / "w").iterdir() if p.name.startswith("part")]
    for own in files:
        longest = max(len(block) for _, block in own)
        assert len(own) <= (3 if longest <= 200 else 2 if longest <= 1000 else 1)


def test_rules_and_addresses(spark):
    rows = [(1, "http://a.example.com/en/75?x=1"), (2, "HTTPS://WWW.Example.COM/en/1"), (3, "http://x.net/de/8#t"), (4, "http://b.example.net/de/81"), (5, "http://example.org/es/"), (6, "mailto:x"), (7, None), (8, "http://notexample.com/en/7"), (9, "http://h?q=/en/"), (10, "x://é.COM:80/EN/")]
    p = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, bad string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge(p, none).collect()}
    assert got == {
        1: ("a.example.com", "/en/75", "example.com/en/7", "allow"), 2: ("www.example.com", "/en/1", "com/en/", "block"), 3: ("x.net", "/de/8", "net/de/", "allow"), 4: ("b.example.net", "/de/81", "example.net/de/8", "block"),
        5: ("example.org", "/es/", "org/es/", "block"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("notexample.com", "/en/7", "com/en/", "block"), 9: ("h", "", None, "allow"), 10: ("é.com:80", "/EN/", None, "allow"),
    }


def test_reputation_shrinks_by_level(spark):
    rows, marks, i = [], [], 0
    for host, n, bad in (("bad.spam.co.uk", 60, 58), ("new.spam.co.uk", 1, None), ("good.fine.org", 80, 2), ("one.fine.org", 1, 1), ("b2.spam.co.uk", 40, 39), ("x.other.com", 30, 10)):
        for k in range(n):
            rows.append((i, f"http://{host}/{k}"))
            if bad is not None:
                marks.append((i, int(k < bad)))
            i += 1
    p, o = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(marks, "page_id long, bad int")
    share = {r["host"]: (r["bad_share"], r["bound"]) for r in url_reputation.reputation(p, o).collect()}
    assert share["new.spam.co.uk"][0] > 0.5 > share["one.fine.org"][0]
    assert share["bad.spam.co.uk"][1] > 0.5 and share["good.fine.org"][0] < 0.1
    assert all(b < m for m, b in share.values())
    levels = {r["host"]: (r["domain"], r["suffix"]) for r in url_reputation.with_levels(spark.createDataFrame([("a.b.co.uk",), ("a.example.com",), ("localhost",), ("co.uk",), ("",)], "host string")).collect()}
    assert levels == {"a.b.co.uk": ("b.co.uk", "co.uk"), "a.example.com": ("example.com", "com"), "localhost": ("localhost", "localhost"), "co.uk": ("co.uk", "uk"), "": ("", "")}


def test_hosts_of_the_table_are_blocked_by_what_their_pages_show(spark):
    """Real pages; those of the hosts that sell things are labelled bad, and a twentieth of the others."""
    from pyspark.sql import functions as F

    p = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host = url_reputation.host_of(F.col("url"))
    sells = host.rlike("casino|pills|bets|spam")
    marks = p.select("page_id", F.when(sells | (F.crc32(F.col("page_id").cast("string").cast("binary")) % 20 == 0), 1).otherwise(0).alias("bad"))
    got = url_reputation.judge(p, marks, rules=[]).select("host", "verdict").distinct().collect()
    blocked = {r["host"] for r in got if r["verdict"] == "block"}
    named = {r["host"] for r in got if any(w in r["host"] for w in ("casino", "pills", "bets", "spam"))}
    assert len(named) >= 3 and blocked and blocked <= named
    pages_of = {r["host"]: r["count"] for r in p.select(host.alias("host")).groupBy("host").count().collect()}
    assert {h for h in named if pages_of[h] >= 4} <= blocked


def test_labels_are_those_of_the_document_that_a_page_shows(spark):
    p = spark.createDataFrame([(1, "http://a.com/en/7?x=9"), (2, "http://a.com/en/7.html"), (3, "http://a.com/8"), (4, None), (None, "http://a.com/en/7"), (5, "http://a.com/en/" + "9" * 400)], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 1), (7, 1, 0), (8, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, url_reputation.page_outcomes(p, labels).collect()), key=str)
    assert got == [(1, 1), (2, 1), (None, 1)]
    odd = url_reputation.judge(p.unionByName(p.where("page_id = 1")).withColumn("host", p["url"]).withColumn("bad", p["page_id"]), url_reputation.page_outcomes(p, labels))
    assert odd.count() == 7 and odd.where("page_id = 1").distinct().count() == 1
    assert url_reputation.judge(p.where("false"), url_reputation.page_outcomes(p, labels)).count() == 0
    assert {r["verdict"] for r in url_reputation.judge(p, url_reputation.page_outcomes(p, labels.where("false")), rules=[]).collect()} == {"allow"}


def test_reputation_plan_has_no_python(spark, capsys):
    import re

    p, labels = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    url_reputation.judge(p, url_reputation.page_outcomes(p, labels)).explain("formatted")
    assert not re.search(r"\) (MapIn\w+|\w+EvalPython|FlatMap\w+|PythonUDTF)", capsys.readouterr().out)


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Null columns, repeated rows, further columns of any name, and an empty table go through all stages."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "no id", "en", None, 5), (7, None, "en", "s", None), (7, "a b c d e f g", None, "s", 13), (7, "a b c d e f g", None, "s", 13)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = odd.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    for n, rows in enumerate((odd.unionByName(docs.limit(30)), odd.where("false"))):
        path = f"{tmp_path}/{n}"
        wide = rows
        for name in ("__score", "__leaks", "__d", "l", "place", "class_id", "v"):
            wide = wide.withColumn(name, F.lit(name))
        wide.write.parquet(f"{path}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{SF}/{t}.parquet").where("true" if n == 0 else "false").write.parquet(f"{path}/{t}.parquet")
        out, stage_docs = corpus_pipeline.run(spark, path), spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, stage_docs, path)
            assert after.columns == stage_docs.columns, name
            assert after.where("__score <> '__score' OR __leaks <> '__leaks' OR __d <> '__d' OR l <> 'l' OR place <> 'place'").isEmpty(), name
            stage_docs = after
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert (None in ids and 7 in ids) if n == 0 else not ids


def test_entry_has_a_query_for_each_operator():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(registry.QUERIES) | {"pipeline"} <= names and set(entry.oracle_sql()) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_pipeline_stages_by_hand(spark):
    """Each stage on its own input, held against the plain definition where there is one."""
    import corpus_pipeline
    from tests.llm.test_decontaminate import holds
    from tests.llm.test_line_dedup import by_hand
    from tests.llm.test_near_dup import classes

    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        outs[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    text = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    before, after = (text(x) for x in outs["line_dedup"])
    want = {d: t for d, (lines, gone, t) in by_hand(before).items() if gone < lines or not gone}
    assert after == want
    before, after = (text(x) for x in outs["near_dedup"])
    label = classes(list(before.values()), list(before))
    assert set(after) == {d for d in before if label[d] == d}
    before, after = (text(x) for x in outs["decontamination"])
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {d for d, t in before.items() if not any(holds(t.lower().split(), i) for i in items if set(i) <= set(t.lower().split()) or len(set(i) & set(t.lower().split())) > 0.6 * len(set(i)))}
    assert {r["doc_id"] for r in outs["packing"][1].collect()} == set(after)

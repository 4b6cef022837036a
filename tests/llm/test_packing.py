import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quadrat.llm import packing
from quadrat.llm.tokens import Encoder, default_path


def test_encoder_equals_whole_texts():
    encoder = Encoder(default_path(), most=500)
    rng = random.Random(1)
    parts = ["a", "the", " ", "\n", "\t", "  ", "é", "12", ",", ".", "'s", " ", "ß", "<|endoftext|>", "漢", "!?", "\n\n", "\r\n", "😀", "\x00", "　"]
    for _ in range(6):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)] + [None, "x" * 5000]
        ids, begin = encoder.encode(pa.array(texts))
        want = encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
        assert all(ids[a:b].tolist() == w.ids for a, b, w in zip(begin[:-1], begin[1:], want, strict=True))


def test_closest_fill_is_the_best_subset_sum():
    rng = random.Random(2)
    for _ in range(200):
        count = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 7))}
        room = rng.randrange(1, 90)
        taken = packing.closest_fill(count, room)
        assert all(n <= count[x] for x, n in taken.items())
        sums = {sum(x * n for x, n in zip(count, ns, strict=True)) for ns in itertools.product(*(range(n + 1) for n in count.values()))}
        assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= room)


def test_best_fit_decreasing_equals_the_plain_rule():
    rng = random.Random(3)
    for _ in range(30):
        lengths = [rng.randrange(1, 100) for _ in range(60)]
        packer = packing.BestFitPacker(100)
        for n in lengths:
            packer.add(packing.Piece(0, np.zeros(n, np.uint32), 0, n))
        rooms = []
        for n in sorted(lengths, reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= n]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= n
            else:
                rooms.append(100 - n)
        assert sorted(100 - sum(len(p.ids) for p in w) for w in packer.fill()) == sorted(rooms)


@pytest.fixture(scope="module")
def texts(words):
    return [" ".join(words(n, n)) for n in (1, 10, 300, 999, 2500)] + ["", None, "a", "odd  white\n\nspace "] + [" ".join(words(40 + i, i)) for i in range(40)]


def ids_of(texts):
    t = Encoder(default_path()).tokenizer
    return {i: [*e.ids, 0] for i, e in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False))}


def test_pieces_are_an_exact_partition(documents, texts):
    want = ids_of(texts)
    rows = packing.pack(documents(texts).coalesce(1), pool=16).collect()
    for d, ids in want.items():
        own = sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1] and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    full = 0
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1]
        full += sum(n for _, n in own) == 1024
        assert sum(n for _, n in own) <= 1024
    assert full == len(by_sequence) - 1  # all but the last


def test_matrix_round_trip(spark, documents, texts, tmp_path):
    want = ids_of(texts)
    out = packing.write_packed(documents(texts), str(tmp_path / "m")).collect()
    assert spark.read.parquet(str(tmp_path / "m")).columns == ["sequence_id", "ids", "n_tokens", "cu_seqlens", "positions", "doc_ids", "starts"]
    found = {}
    for r in out:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 1024 and r["cu_seqlens"][-1] == r["n_tokens"] and not ids[r["n_tokens"] :].any()
        ends = [*r["cu_seqlens"], 1024] if r["n_tokens"] < 1024 else r["cu_seqlens"]
        assert np.frombuffer(r["positions"], "<u2").tolist() == [p for a, b in itertools.pairwise(ends) for p in range(b - a)]
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            found.setdefault(d, {})[s] = ids[a:b].tolist()
    assert {d: sum((p for _, p in sorted(own.items())), []) for d, own in found.items()} == want


def test_matrix_of_repeated_and_nameless_rows(documents, tmp_path):
    long = " ".join(f"word{i}" for i in range(900))
    rows = packing.write_packed(documents([long, long, long, "", None], ids=[1, 1, None, None, 2]), str(tmp_path / "m")).collect()
    found = {}
    for r in rows:
        for d, a, b in zip(r["doc_ids"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
            found[d] = found.get(d, 0) + b - a
    n = len(ids_of([long])[0])
    assert n > 1024 and found == {1: 2 * n, None: n + 1, 2: 1}
    with pytest.raises(Exception, match="holds no id"):
        packing.write_packed(documents([long]), str(tmp_path / "n"), id_bytes=1)


def test_flushed_windows_leave_little_padding():
    """Over many flushes: windows with room go back to the pool, so padding is that of a few windows, not of one for each flush."""
    rng = random.Random(8)
    packer, done, padding = packing.BestFitPacker(1024), 0, []
    for _ in range(12):
        while packer.size < 512:
            n = rng.choice([rng.randrange(1, 1024), rng.randrange(1, 200)])
            done += n
            packer.add(packing.Piece(0, np.zeros(n, np.uint32), 0, n))
        padding += [1024 - sum(len(p.ids) for p in w) for w in packer.fill(128)]
        assert packer.size <= 128
    rest = [1024 - sum(len(p.ids) for p in w) for w in packer.fill()]
    assert 1024 * (len(padding) + len(rest)) - sum(padding) - sum(rest) == done
    assert sum(padding) < 0.01 * done and sum(padding) + sum(rest) < 0.03 * done


def test_odd_tables(documents):
    docs = documents(["same", "same", None], ids=[1, 1, None])
    assert sorted((r["doc_id"] or -1) for r in packing.pack(docs).collect()) == [-1, 1, 1]
    assert packing.pack(docs.where("false")).count() == 0 and packing.packed_matrix(docs.where("false")).count() == 0

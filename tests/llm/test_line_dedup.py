import random
import re

from quadrat.llm import line_dedup


def by_hand(docs):
    """docs: {doc_id: text}. The definition, line by line."""
    first, gone = {}, {}
    for d in sorted(docs):
        own = (docs[d] or "").split("\n")
        for p in range(len(own) - 2):
            w = tuple(x.strip(" ") for x in own[p : p + 3])
            if w == ("", "", ""):
                continue
            if w in first:
                gone.setdefault(d, set()).update((p, p + 1, p + 2))
            else:
                first[w] = (d, p)
    return {d: (len((t or "").split("\n")), len(gone.get(d, ())), "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone.get(d, ()))) for d, t in docs.items()}


def result(docs):
    return {r["own"]["doc_id"]: (r["n_lines"], r["n_removed"], r["rest"] or "") for r in line_dedup._rest(docs).collect()}


def test_equals_definition(documents):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["a", "b", "c ", " c", "", "d e"]) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts += ["x\ny\nz\nx\ny\nz\nx\ny\nz", "q\nq\nq\nq\nq\nq", None, "", "\n\n\n\n", "\n".join(f"line {i}" for i in range(3000)), "\n".join(f"line {i}" for i in range(3000))]
    assert result(documents(texts)) == by_hand(dict(enumerate(texts)))


def test_emptied_documents_go(documents):
    docs = documents(["a\nb\nc", "a\nb\nc", "", "d", "n\na\nb\nc"])
    out = line_dedup.drop_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(0, "a\nb\nc", 5), (2, "", 0), (3, "d", 1), (4, "n", 1)]


def test_repeated_rows_null_ids_and_empty_table(documents):
    docs = documents(["a\nb\nc", "a\nb\nc", "a\nb\nc\nd"], ids=[1, 1, None])
    assert sorted((r["own"]["doc_id"] or -1, r["rest"]) for r in line_dedup._rest(docs).collect()) == [(-1, "a\nb\nc\nd"), (1, ""), (1, "")]
    assert line_dedup.report(docs.where("false")).count() == 0


def test_columns_of_any_name_stay(documents):
    from pyspark.sql import functions as F

    names = ["__d", "__t", "pos", "w1", "l", "own", "rest", "n_lines", "n_removed", "a.b", "__runs"]
    docs = documents(["a\nb\nc\nd", "x\na\nb\nc"])
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.lit(i))
    out = line_dedup.drop_repeats(docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r["doc_id"], r["text"], r["own"], r["a.b"]) for r in out.collect()) == [(0, "a\nb\nc\nd", 5, 9), (1, "x", 5, 9)]


def test_plan_has_no_python(documents, capsys):
    line_dedup.report(documents(["a\nb\nc"] * 2)).explain("formatted")
    assert not re.search(r"\) (MapIn\w+|\w+EvalPython|FlatMap\w+|PythonUDTF)", capsys.readouterr().out)

from collections import Counter

import numpy as np
from mmcohort.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n long, key string, m int, side int, root string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "w", 1, "k", 2, 3, "r") for r in rows], SCHEMA)


def check(df, rows):
    got = Counter(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == Counter(S.brute(rows))
    return got


def test_documents_equal_brute_force(spark, documents, sf_dir):
    few = [(d["doc_id"], d["text"]) for d in documents[:60]]
    assert check(S.variants(frame(spark, few)), few)


def variants(rng, n):
    """Words of two letters, so that most have many near words, and chains of forms."""
    rows = []
    for i in range(n):
        w = "".join(rng.choice(list("aé"), rng.integers(6, 11)))
        rows.append((i, " ".join([w] * int(rng.integers(1, 4)))))
    rows += [(1000, "colourful " * 1500), (1001, "colorful " * 120), (1002, "colorfu " * 11), (1003, "Colorfuu x colorfuu")]
    return rows


def test_chains_and_grids(spark, monkeypatch):
    rows = variants(np.random.default_rng(3), 700)
    whole = check(S.variants(frame(spark, rows)), rows)
    assert any(r[1] is not None and r[2] != r[1] for r in whole)
    monkeypatch.setattr(S, "CELL", 30)
    monkeypatch.setattr(S, "BUCKET", 100)
    assert check(S.variants(frame(spark, rows)), rows) == whole


def test_one_edit_in_small_slices(monkeypatch):
    monkeypatch.setattr(S, "SLICE", 64)
    rng = np.random.default_rng(4)
    words = sorted({"ab" + "".join(rng.choice(list("xyz"), rng.integers(5, 7))) for _ in range(400)})
    got = Counter((words[i], words[j]) for a, b in S.one_edit(words, words, 7, 2) for i, j in zip(a, b))

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    assert got == Counter((x, y) for x in words for y in words if one(x, y))


def test_edges(spark, edge_docs, no_docs):
    long = "Ænigmatic " * 30_000 + "x" * 50_000 + " " + "x" * 50_001
    rows = [(1, None), (2, ""), (None, "whatever whatever"), (3, long), (3, long), (4, "ÀÉÎÕÜÿ× àéîõüÿ×"), (5, "short abcdefg abcdefg abcdefh abcdefh\x00abcdefg")]
    check(S.variants(frame(spark, rows)), rows)
    check(S.variants(edge_docs), [(r["doc_id"], r["text"]) for r in edge_docs.collect()])
    assert S.variants(no_docs).collect() == []

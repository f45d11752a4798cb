import numpy as np
import pytest
from mmcohort.llm import ann as A


def brute(rows, k=10, every=100):
    """rows: (vec_id, vector or None)"""
    ok = {}
    widths = [len(v) for i, v in rows if v]
    width = max(set(widths), key=lambda w: (widths.count(w), w)) if widths else 0
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v) or len(v) != width:
            continue
        ok[i] = np.array(v, np.float32).astype(np.float64)
    ids = np.array(sorted(ok))
    x = np.array([ok[i] for i in ids])
    out = {}
    for i in ids[ids % every == 0] if len(ids) else ():
        d = np.sqrt(((x - ok[i]) ** 2).sum(1))
        o = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(d[j])) for j in o]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        mine = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(mine) + 1
        mine.append((r["vec_id"], r["score"]))
    return out


def recall(found, want):
    assert set(found) == {q for q in want if want[q]}
    hit = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in found)
    return hit / sum(len(w) for w in want.values())


def same(found, want):
    assert set(found) == {q for q in want if want[q]}
    for q in found:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]
        assert np.allclose([d for _, d in found[q]], [d for _, d in want[q]], rtol=1e-12)


def test_embeddings(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in t.collect()])
    assert recall(got(A.search(t)), want) >= 0.9
    same(got(A.search(t, exact=True)), want)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 3, (30, 8))
    x = (centres[rng.integers(30, size=4000)] + rng.normal(0, 1, (4000, 8))).astype(np.float32)
    x[1000:2200] = x[1000]  # a third are copies
    x[3000:3020] = np.round(x[3000:3020])
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_planted(spark, planted):
    want = brute(planted)
    found = got(A.search(frame(spark, planted)))
    assert recall(found, want) >= 0.9
    assert found[1100] == [(i, 0.0) for i in range(1000, 1010)]


def test_cells(spark, planted, monkeypatch):
    monkeypatch.setattr(A, "CELL", 50)
    same(got(A.search(frame(spark, planted), exact=True, query_filter="vec_id % 7 = 0")), brute(planted, every=7))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (100, [3.0, 4.0]), (200, None), (300, []), (400, [0.0, 0.0]),
        (500, [nan, 1.0]), (600, [inf, 1.0]), (700, [None, 1.0]), (800, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [3.0, 4.0]),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, cls int, leaf int, v int")
    same(got(A.search(df)), brute(rows))
    assert A.search(df.where("false")).collect() == [] and A.search(df.where("vec_id = 0")).collect() == []


def test_best_bins_order_all_leaves():
    x = np.random.default_rng(1).normal(size=(2000, 6))
    t = A.Tree(x, 60)
    leaves = {i for i, kids in enumerate(t.kids) if not kids}
    own = t.leaf(x[:50])
    for i, found in enumerate(t.best_bins(x[:50], len(leaves))):
        assert set(found) == leaves and len(found) == len(leaves) and found[0] == own[i]

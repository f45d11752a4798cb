from collections import Counter

import numpy as np
import pytest
from mmcohort.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int, q string, v string, score long, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "q", "v", 1, 1) for r in rows], SCHEMA)


def check(df, rows, is_query, k=5):
    assert Counter(tuple(r) for r in df.collect()) == Counter(K.brute(rows, is_query, k))


def test_equals_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding").collect()]
    check(K.search(df), rows, lambda i: i % 50 == 0)


def test_many_shelves_ties_and_copies(spark, monkeypatch):
    """Small blocks, shelves, chunks and crowds; half of the rows are one vector."""
    for name, n in (("BLOCK", 4), ("SHELF", 16), ("QUERIES", 3), ("SAME", 5), ("RANGES", 6)):
        monkeypatch.setattr(K, name, n)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 256]) for i in range(150)]
    rows += [(i, [0.5, -0.25, 0.0, 1.0]) for i in range(150, 300)]
    check(K.search(frame(spark, rows)), rows, lambda i: i % 50 == 0)
    check(K.search(frame(spark, rows), query_filter="vec_id % 3 = 0", k=2), rows, lambda i: i % 3 == 0, 2)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [0.5, -1.5]), (0, [0.5, -1.5]), (50, [0.0, 0.0]), (50, [1.0, 1.0]), (100, []), (150, None), (200, [nan, 1.0]),
        (250, [inf, 1.0]), (300, [None, 1.0]), (None, [9.0, 9.0]), (1, [-0.001, 2.0]), (2, [1.0]), (3, [1.0, 2.0, 3.0]), (-50, [1e6, -1e6]),
    ]
    check(K.search(frame(spark, rows)), rows, lambda i: i % 50 == 0)
    check(K.search(frame(spark, rows[:1])), rows[:1], lambda i: True)
    assert K.search(frame(spark, [])).collect() == []
    with pytest.raises(Exception, match="62 bits"):
        K.search(frame(spark, [(0, [3e38])])).collect()


def test_blocks_below_the_threshold_are_not_scored():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (20, 8))
    blocks, high, low = [], [], []
    for i, c in enumerate(centres):
        x = c + rng.integers(-3, 4, (50, 8))
        blocks.append((x, np.arange(50), np.arange(50) + 50 * i))
        high.append(x.max(0))
        low.append(x.min(0))
    q = centres[:7] + rng.integers(-2, 3, (7, 8))
    score, ids, scored = K.block_at_a_time(q, np.full(7, K.NONE), blocks, np.array(high), np.array(low), 6)
    every = np.concatenate([b[0] for b in blocks])
    for i in range(7):
        s = every @ q[i]
        best = np.lexsort((np.arange(len(s)), -s))[:6]
        assert ids[i].tolist() == best.tolist() and score[i].tolist() == s[best].tolist()
    assert scored < 7 * 20 / 3
    bound = K.bounds(q, np.array(high), np.array(low))
    assert all((b[0] @ q.T).max(0).tolist() <= bound[:, j].tolist() for j, b in enumerate(blocks))

from collections import Counter

import numpy as np
import pytest
from mmcohort.llm import trie as T

SCHEMA = "conv_id long, turn long, role string, text string, path string, shard int, size int, n_convs long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, 3) for r in rows], SCHEMA)


def check(df, rows, **kw):
    assert Counter(tuple(r) for r in df.collect()) == Counter(T.brute(rows, **kw))


def test_equals_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    check(T.nodes(df), rows)


@pytest.mark.parametrize("shard_turns", [7, 60])
def test_spines_of_many_shards_merge(spark, shard_turns):
    """Shards smaller than a group of copies, nodes shared by most shards, prefixes of one another."""
    rng = np.random.default_rng(2)
    rows = []
    for c in range(60):
        depth = int(rng.integers(0, 9))
        rows += [(c, d, "user", f"t{rng.integers(2) if d else 0}" * (d + 1)) for d in range(depth)]
    for c in range(60, 120):
        rows += [(c, d, "user", "copy") for d in range(4)]
    rows += [(200, d, "assistant", "long é" * (d % 3)) for d in range(300)]
    check(T.nodes(frame(spark, rows), shard_turns=shard_turns), rows)
    check(T.nodes(frame(spark, rows), shard_turns=shard_turns, group=1, heads=1), rows, group=1, heads=1)


def test_edges(spark):
    rows = [
        (1, None, "user", "a"), (1, 1, None, None), (1, 1, None, None), (1, 0, "user", "b"), (None, 0, "user", "x"),
        (2, 0, "", ""), (-3, 0, "user", "neg"), (0, 0, "user", "zero"), (5, 3, "user", "é"), (9, 0, "user", "x" * 100_000),
        (6, 0, "us", "era"), (7, 0, "user", "a"), (8, 0, "user", "one"), (8, 0, "user", "two"),
    ]
    check(T.nodes(frame(spark, rows)), rows)
    check(T.nodes(frame(spark, rows), shard_turns=2), rows)
    assert T.nodes(frame(spark, [])).collect() == []
    assert T.nodes(frame(spark, [(None, 1, "user", "x")])).collect() == []


def test_parentheses():
    rng = np.random.default_rng(0)
    for size in (1, 2, 40, 3000):
        bits, depth = [1], 1
        for _ in range(size):
            up = depth == 1 or rng.random() < (0.5 if size < 3000 else 0.52)
            bits.append(int(up))
            depth += 1 if up else -1
        bits = np.array(bits + [0] * depth, np.uint8)
        p = T.Parens(bits)
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        got = p.findclose(p.opens)
        assert got.tolist() == [close[i] for i in p.opens]
        want = [sum(1 for j in range(i, close[i]) if bits[j] and not bits[j + 1]) for i in p.opens[:200]]
        assert p.leaf_pairs(p.opens[:200], got[:200]).tolist() == want

import hashlib
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from mmcohort.llm import decontamination as D
from mmcohort.llm.text import ALNUM, text_groups

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=10):
    wins = {}
    for i, text in items:
        w = words(text)
        m = min(n, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            wins.setdefault(m, {}).setdefault(tuple(w[k : k + m]), set()).add("null" if i is None else str(i))
    out = []
    for d, text in docs:
        w = words(text)
        hit, ids = set(), set()
        for m, table in wins.items():
            for p in range(len(w) - m + 1):
                if (x := table.get(tuple(w[p : p + m]))) is not None:
                    hit |= set(range(p, p + m))
                    ids |= x
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((str(d), len(w), len(hit), len(ids), sha, bool(hit)))
    return sorted(out)


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())


def test_documents(spark, sf_dir, documents):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([(d["doc_id"], d["text"]) for d in documents], [tuple(r) for r in bench.select("item_id", "text").collect()])
    assert got(D.report(spark.read.parquet(f"{sf_dir}/documents.parquet"), bench)) == want
    assert any(r[-1] for r in want)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(30)]  # few words: many chance hits and overlaps
    items = [(int(i), " ".join(rng.choice(vocab, rng.integers(1, 40)))) for i in range(40)]
    items += [(100, "same same same same same same same same same same same same"), (101, "a b"), (101, "a b"),
              (None, "x y z"), (102, None), (103, ""), (104, "lone"), (9, "tie one two three four five six seven eight nine")]
    docs = []
    for i in range(60):
        w = list(rng.choice(vocab, 60))
        for _ in range(3):
            x = items[rng.integers(len(items))][1]
            x = (x or "").split()
            lo = rng.integers(0, max(1, len(x) // 2))
            w[rng.integers(60) :][:0] = x[lo : lo + rng.integers(1, 30)]
            at = int(rng.integers(60))
            w[at:at] = x[lo : lo + int(rng.integers(1, 30))]
        docs.append((i, " ".join(w)))
    docs += [(70, "same " * 30), (71, "A, b."), (72, "lone"), (73, None), (74, ""), (None, "x Y z"), (71, "A, b.")]
    return docs, items


def frames(spark, planted):
    return (
        spark.createDataFrame(planted[0], "doc_id long, text string"),
        spark.createDataFrame(planted[1], "item_id long, text string"),
    )


def test_planted(spark, planted):
    docs, bench = frames(spark, planted)
    assert got(D.report(docs, bench)) == brute(*planted)


def test_blocks_of_the_benchmark(spark, planted):
    docs, bench = frames(spark, planted)
    assert got(D.report(docs, bench, block=150)) == brute(*planted)


def test_repeated_words_do_not_multiply(spark):
    """A million equal words against items of equal and of alternating words."""
    rng = np.random.default_rng(6)
    items = [(1, "same " * 200), (2, "a b " * 100), (3, "a b c " * 70), (4, "same " * 9 + "other")]
    t = next(text_groups(pa.array(["same " * 1_000_000, "a b " * 300_000, "x"]), ALNUM, limit=1 << 30))[2]
    words_ = [next(text_groups(pa.array([x]), ALNUM))[2].hash for _, x in items]
    began = time.time()
    found = {(d, i): len(places) for d, own, places in D.Block(list(zip("1234", words_)), 10, 5).hits(t) for i in own}
    assert time.time() - began < 5
    assert found == {(0, 0): 1_000_000, (1, 1): 600_000}
    docs = [(i, " ".join(rng.choice(["a", "b", "same"], 400, p=[0.45, 0.45, 0.1]))) for i in range(20)]
    docs += [(50 + i, x) for i, x in enumerate(["a b " * 30, "b a " * 6, "same " * 300 + "other", "a b c " * 8 + "same " * 15])]
    frames_ = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(D.report(*frames_)) == brute(docs, items)


def test_an_item_longer_than_a_block(spark):
    rng = np.random.default_rng(7)
    w = [f"w{i}" for i in rng.integers(0, 500, 900)]
    items = [(1, " ".join(w)), (2, "short one"), (None, " ".join(w[100:160]))]
    docs = [(i, " ".join(["x"] * 3 + w[lo : lo + 12] + ["y"])) for i, lo in enumerate(range(0, 889, 7))] + [(999, " ".join(w))]
    frames_ = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (20, 64, 900):
        assert got(D.report(*frames_, block=block)) == brute(docs, items)


def test_edges(spark, edge_docs, no_docs, planted):
    bench = frames(spark, planted)[1]
    docs = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert got(D.report(edge_docs, bench)) == brute(docs, planted[1])
    assert got(D.report(edge_docs, bench.where("false"))) == brute(docs, [])
    assert got(D.report(no_docs, bench)) == []


def test_clean_keeps_columns(spark, edge_docs):
    bench = spark.createDataFrame([(1, "gamma delta epsilon zeta")], "item_id long, text string")
    kept = D.clean(edge_docs, bench)
    assert kept.columns == edge_docs.columns
    assert kept.count() == edge_docs.count() - 2


def test_winnowing_guarantee():
    """Any ten shared words hold a gram that is a fingerprint on both sides."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        shared = rng.integers(0, 40, 10).astype(str).tolist()
        sides = []
        for _ in range(2):
            x = [f"l{i}" for i in rng.integers(0, 9, rng.integers(0, 20))]
            y = [f"r{i}" for i in rng.integers(0, 9, rng.integers(0, 20))]
            t = next(text_groups(pa.array([" ".join(x + shared + y)]), ALNUM))[2]
            p, f = D.fingerprints(t.hash, 5, 6, t.at)
            sides.append({(int(a) - len(x), int(b)) for a, b in zip(p, f) if len(x) <= a <= len(x) + 5})
        assert sides[0] & sides[1]

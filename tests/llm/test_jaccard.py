import re

import numpy as np
import pytest
from mmcohort.llm import jaccard as J
from mmcohort.llm.text import SPACE, text_groups
import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if len(w) >= n else frozenset([tuple(w)])


def brute(docs, n=4, percent=85):
    sets = [shingles(d["text"], n) for d in docs]
    up = list(range(len(docs)))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    order = sorted((i for i in range(len(docs)) if sets[i] and docs[i]["doc_id"] is not None), key=lambda i: len(sets[i]))
    for a, i in enumerate(order):
        for j in order[a + 1 :]:
            if len(sets[j]) * percent > len(sets[i]) * 100:
                break
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    low = {}
    for i in order:
        low[find(i)] = min(low.get(find(i), 1 << 62), docs[i]["doc_id"])
    return sorted(
        (str(d["doc_id"]), len(sets[i]), low[find(i)] if sets[i] and d["doc_id"] is not None else d["doc_id"])
        for i, d in enumerate(docs)
    )


def got(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in df.collect())


def test_documents(spark, sf_dir, documents):
    assert got(J.join(spark.read.parquet(f"{sf_dir}/documents.parquet"))) == brute(documents)


def near_copies(rng, base, n, rate):
    out = []
    for _ in range(n):
        w = list(base)
        for i in np.flatnonzero(rng.random(len(w)) < rate):
            w[i] = f"n{rng.integers(1 << 30)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(5)
    texts = []
    for size, rate in [(300, 0.008), (300, 0.02), (60, 0.015), (30, 0.02), (12, 0.02), (150, 0.012), (1200, 0.01), (8, 0.05)]:
        texts += near_copies(rng, [f"b{size}{rate}_{i}" for i in range(size)], 25, rate)
    chain = [f"c{i}" for i in range(400)]  # ends far apart, linked through the middle
    texts += [" ".join(chain[i * 20 : i * 20 + 260]) for i in range(8)]
    texts += [" ".join(["pass"] + [f"p{i}" for i in range(60)] + [f"u{k}_{i}" for i in range(60)]) for k in range(25)]
    texts += ["same words here now"] * 20 + ["one two"] * 3 + ["", None]
    rng.shuffle(texts)
    return [{"doc_id": int(i * 3 + 1), "text": t} for i, t in enumerate(texts)]


def frame(spark, docs):
    return spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")


def test_planted_links(spark, planted):
    assert got(J.join(frame(spark, planted))) == brute(planted)


def test_cut_blocks_lose_nothing(spark, planted, monkeypatch):
    monkeypatch.setattr(J, "CELL_DOCS", 4)
    assert got(J.join(frame(spark, planted))) == brute(planted)


def test_edges(edge_docs, no_docs):
    docs = [r.asDict() for r in edge_docs.collect()]
    assert got(J.join(edge_docs)) == brute(docs)
    assert got(J.join(no_docs)) == []


def test_every_linkable_pair_shares_a_key(planted):
    """Routing is lossless, also at other thresholds."""
    for percent in (70, 85, 95):
        bands = J.Bands(percent)
        keys, sets = [], []
        for _, _, t in text_groups(pa.array([d["text"] for d in planted]), SPACE):
            s = J.Sets(t, 4)
            r, k = bands.keys(s, np.flatnonzero(s.n))
            for i in range(len(t)):
                keys.append(set(k[r == i].tolist()))
                sets.append(s.h[s.at[i] : s.at[i + 1]])
        for i in range(len(sets)):
            for j in range(i):
                a, b = sets[i], sets[j]
                if len(a) and len(b) and not np.array_equal(a, b) and J.linked(a, b, percent):
                    assert keys[i] & keys[j]


def test_rtree_search_equals_scan():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 9, (300, J.GROUPS))
    counts = np.concatenate([base, np.maximum(base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.1), 0)]).astype(np.int32)
    sizes = counts.sum(1)
    tree = J.RTree(counts, sizes)
    found = set()
    for q, r in tree.search(np.arange(len(counts)), 85):
        found |= {(q, int(x)) for x in r}
    both = np.minimum(counts[:, None], counts[None]).sum(2)
    want = np.argwhere(both * 185 >= 85 * (sizes[:, None] + sizes[None]))
    assert found == {(int(a), int(b)) for a, b in want}


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    out = {r["node"]: r["root"] for r in J.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    for a, b in links:
        for x in (a, b):
            assert out.get(x, x) == find(x)


def test_hot_keys_and_hubs(spark, planted, monkeypatch):
    """Common keys, classes and hubs dealt over several tasks give the same."""
    monkeypatch.setattr(J, "SAMPLED", 1)
    monkeypatch.setattr(J, "HOT_KEY", 3)
    monkeypatch.setattr(J.spread, "ROWS", 2)
    members = J.memberships(frame(spark, planted), 4, 85)
    assert J.hot_keys(members).count() > 5
    rows = J.join(frame(spark, planted))
    assert got(rows) == brute(planted)
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in rows.collect()) == brute_links(planted)


def test_shared_blocks_across_batches(spark):
    """Runs of a key that begin and end anywhere in a batch."""
    rng = np.random.default_rng(8)
    rows = sorted({(int(k), 0, int(c)) for k, c in zip(rng.integers(0, 40, 300), rng.integers(0, 25, 300))} | {(99, 0, 5)})
    want = set()
    for key in {r[0] for r in rows}:
        own = [c for k, _, c in rows if k == key]
        if len(set(own)) > 1:
            want |= {(min(own), c) for c in own}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = spark.createDataFrame(rows + rows[:50], "key long, part int, cls long")
        assert {tuple(r) for r in J.shared_blocks(df, {}).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_of_one_id_are_told_apart(spark, monkeypatch):
    """A repeated id neither takes unrelated texts along nor makes the choice random."""
    a = " ".join(f"a{i}" for i in range(60))
    near_a = a.replace("a59", "x")
    b = " ".join(f"b{i}" for i in range(60))
    rows = [
        (1, a, "s"), (2, near_a, "s"), (2, b, "s"),  # id 2: one row goes, the unrelated one stays
        (3, " ".join(f"c{i}" for i in range(60)), "z"), (3, " ".join(f"c{i}" for i in range(59)) + " q", "y"),  # two near rows: one stays
        (4, "same words again and again", "k"), (4, "same words again and again", "k"), (4, "same words again and again", "j"),
        (5, "", "s"), (5, None, "s"), (5, "", "t"), (None, a, "s"), (None, a, "s"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for limit in (J.LOST_BROADCAST, 0):
        monkeypatch.setattr(J, "LOST_BROADCAST", limit)
        runs = []
        for parts in (1, 5):
            d = df.repartition(parts)
            runs.append(sorted(map(str, J.keep_one(d, J.join(d)).collect())))
        assert runs[0] == runs[1]
        kept = [(r["doc_id"], r["text"]) for r in J.keep_one(df, J.join(df)).collect()]
        assert sorted(i for i, _ in kept if i in (1, 2, 3, 4)) == [1, 2, 3, 4] and (2, b) in kept and (1, a) in kept
        assert len([1 for i, _ in kept if i == 5]) == 1 and len([1 for i, _ in kept if i is None]) == 2


def test_keep_one(spark, planted):
    docs = frame(spark, planted + [planted[0]])
    kept = [r["doc_id"] for r in J.keep_one(docs, J.join(docs)).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute(planted)})


def brute_links(docs, n=4, percent=85):
    """Links of each document by all pairs."""
    sets = [shingles(d["text"], n) for d in docs]
    out = []
    for i, d in enumerate(docs):
        k = 0
        for j, e in enumerate(docs):
            if i != j and sets[i] and sets[j] and None not in (d["doc_id"], e["doc_id"]):
                both = len(sets[i] & sets[j])
                k += 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both)
        out.append((str(d["doc_id"]), k))
    return sorted(out)


@pytest.mark.parametrize("cell", [J.CELL_DOCS, 4])
def test_links_are_counted_once(spark, planted, monkeypatch, cell):
    monkeypatch.setattr(J, "CELL_DOCS", cell)
    rows = J.join(frame(spark, planted)).collect()
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in rows) == brute_links(planted)


def test_links_of_repeated_rows(edge_docs):
    rows = {(str(r["doc_id"]), r["n_shingles"]): r["n_links"] for r in J.join(edge_docs).collect()}
    assert rows[("5", 1)] == rows[("6", 1)] == rows[("1", 5)] == rows[("9", 5)] == 1 and rows[("None", 1)] == rows[("2", 0)] == 0


def test_copies_that_meet_the_bit_map_count_once(spark, planted, monkeypatch):
    """A class whose set comes from several tasks is one entry of its cell."""
    monkeypatch.setattr(J, "FILTER_BITS", 64)
    docs = planted[:150] + [{"doc_id": 90_000 + i, "text": d["text"]} for i, d in enumerate(planted[:150])]
    docs += [{"doc_id": 95_000 + i, "text": planted[0]["text"]} for i in range(30)]
    rows = J.join(frame(spark, docs).repartition(6)).dropDuplicates(["doc_id"]).collect()
    once = list({d["doc_id"]: d for d in docs}.values())
    assert sorted((str(r["doc_id"]), r["n_links"]) for r in rows) == brute_links(once)


def test_points_keep_every_linked_class():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64)) for _ in range(40)]
    sets += [np.unique(np.append(x[:-15], rng.integers(0, 1 << 63, 15).astype(np.uint64))) for x in sets[:10]]
    fine = np.stack([np.bincount((x & np.uint64(J.FINE - 1)).astype(int), minlength=J.FINE) for x in sets]).astype(np.int32)
    none = [np.empty(0, np.int64)] * len(sets)
    left = J.Points(0, list(range(50)), [2] * 50, fine, none).survivors(85)
    assert set(left) >= set(range(10)) | set(range(40, 50)) and len(left) < 30
    sides = [0] * 40 + [1] * 10  # pairs across only
    assert set(J.Points(0, list(range(50)), sides, fine, none).survivors(85)) >= set(range(10)) | set(range(40, 50))


def test_counts_of_any_size():
    for top in (3, 300, 70_000):
        c = np.arange(J.FINE) % (top + 1)
        c[5] = top
        assert J._counts(c.astype(np.min_scalar_type(int(c.max()))).tobytes()).tolist() == c.tolist()

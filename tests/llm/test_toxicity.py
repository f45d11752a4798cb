import zlib

import numpy as np
import pyarrow as pa
import pytest
from mmcohort.llm import toxicity as X
from mmcohort.llm.text import ALNUM, text_groups
from pyspark.sql import functions as F

STEMS = {"en": ["grumbo", "idiotic"], "fr": ["vequx"], "de": ["loweiz"]}


@pytest.fixture(scope="module")
def planted():
    """Three languages; a toxic text holds a few words of its language's stems with unseen endings."""
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(1500):
        lang = ("en", "fr", "de")[i % 3]
        w = [f"{lang}{rng.integers(400)}" for _ in range(rng.integers(20, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.integers(1, 4)):
                w[rng.integers(len(w))] = str(rng.choice(STEMS[lang])) + f"{rng.integers(1000)}"
        docs.append((i, " ".join(w), lang))
        labels.append((i, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark, planted):
    return (
        spark.createDataFrame(planted[0], "doc_id long, text string, lang string"),
        spark.createDataFrame(planted[1], "doc_id long, toxic int"),
    )


def crc(i):
    return zlib.crc32(str(i).encode()) % 3


def test_held_out_accuracy(frames, planted):
    truth = dict(planted[1])
    rows = X.report(*frames).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if crc(i) == 1}
    for name in ("predicted", "rejected"):
        good = [int(r[name]) == truth[r["doc_id"]] for r in held]
        assert np.mean(good) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    assert len({r["threshold"] for r in rows}) > 1


def test_held_out_labels_and_other_columns_teach_nothing(spark, frames):
    from pyspark.sql import functions as F

    docs, labels = frames
    a = X.fit(docs, labels)
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    b = X.fit(docs, flipped)
    assert np.array_equal(a.emb, b.emb) and a.shift == b.shift
    s = {r["doc_id"]: r["score"] for r in X.report(docs, labels, a).collect()}
    t = {r["doc_id"]: r["score"] for r in X.report(docs.withColumn("lang", F.lit(None).cast("string")), labels, a).collect()}
    assert s == t


def accuracy(rows, labels):
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    return np.mean([a == b for a, b in held])


def test_documents(spark, sf_dir, documents):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = X.report(docs, labels).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d["doc_id"] for d in documents)


def test_held_out_accuracy_on_documents(spark):
    """On the largest test table: the smaller ones have a few dozen labels."""
    big = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{big}/labels.parquet")
    assert accuracy(X.report(spark.read.parquet(f"{big}/documents.parquet"), labels).collect(), labels) > 0.97


def test_edges(spark, frames, edge_docs, no_docs):
    model = X.fit(*frames)
    rows = X.report(edge_docs, frames[1], model).collect()
    assert len(rows) == edge_docs.count()
    empty = {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}
    assert len(empty) == 1
    assert X.report(no_docs, frames[1], model).collect() == []
    assert X.report(no_docs, frames[1]).collect() == []
    none = X.report(edge_docs, frames[1].where("false")).collect()
    assert {r["score"] for r in none} == {0.0} and {r["predicted"] for r in none} == {0}
    odd = spark.createDataFrame([(0, None), (0, 1), (0, 0), (None, 1), (2, 0), (2, 0)], "doc_id long, toxic int")
    assert len(X.report(frames[0].limit(50), odd).collect()) == 50
    kept = X.keep_clean(edge_docs, frames[1], model)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()


def test_parts_of_a_long_text_change_nothing(frames):
    model = X.fit(*frames)
    rng = np.random.default_rng(0)
    long = " ".join(f"en{i}" for i in rng.integers(0, 400, 300_000)) + " grumbo77"
    t = next(text_groups(pa.array([long, "short"]), ALNUM, limit=1 << 30, prefixes=X.PREFIXES))[2]
    whole = model.scores(X.features(t.hash), t.at)
    assert np.allclose(X._scores(model, t), whole, atol=1e-5)


def small_model(rng, dim=X.DIM):
    n = len(X.WIDTHS) * X.FILTERS
    return X.Model(
        rng.normal(0, 0.5, (X.BUCKETS, dim)), rng.normal(0, 0.5, (dim, sum(X.WIDTHS) * X.FILTERS)), rng.normal(0, 0.2, n), rng.normal(0, 0.5, n), -0.3
    )


def some_texts(rng, lengths=(0, 1, 2, 3, 9, 40)):
    ids = rng.integers(1, 60, (sum(lengths), 1 + len(X.PREFIXES))).astype(np.int32)
    return ids, np.concatenate([[0], np.cumsum(lengths)])


def test_filters_and_pooling_equal_a_naive_version():
    rng = np.random.default_rng(3)
    m = small_model(rng)
    ids, at = some_texts(rng)
    x = np.array([sum(m.emb[i] for i in row) for row in ids])
    for d in range(len(at) - 1):
        words, top, k = x[at[d] : at[d + 1]], [], 0
        for i, w in enumerate(X.WIDTHS):
            for f in range(X.FILTERS):
                values = [
                    sum(float(words[p + j] @ m.conv[:, (k + j) * X.FILTERS + f]) for j in range(w) if p + j < len(words)) + m.bias[i * X.FILTERS + f]
                    for p in range(len(words))
                ]
                top.append(max(0.0, max(values)) if values else 0.0)
            k += w
        assert np.allclose(m.pooled(ids, at)[1][d], top, atol=1e-5)
        assert np.isclose(m.logits(ids, at)[d], np.dot(top, m.out) + m.out_bias, atol=1e-5)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(4)
    m = small_model(rng)
    ids, at = some_texts(rng, (5, 12, 1, 30))
    y, weight = np.array([1, 0, 1, 0]), np.array([2.0, 0.7, 2.0, 0.7])

    def loss():
        x = m.emb[ids].sum(1)
        tops = []
        for d in range(len(y)):
            words, k, top = x[at[d] : at[d + 1]], 0, []
            for i, w in enumerate(X.WIDTHS):
                acc = np.zeros((len(words), X.FILTERS))
                for j in range(w):
                    acc[: len(words) - j] += words[j:] @ m.conv[:, (k + j) * X.FILTERS : (k + j + 1) * X.FILTERS]
                top.append(np.maximum(acc.max(0) + m.bias[i * X.FILTERS : (i + 1) * X.FILTERS], 0))
                k += w
            tops.append(np.concatenate(top))
        z = np.array(tops) @ m.out + m.out_bias
        return float((weight * (np.logaddexp(0, z) - y * z)).mean()) + X.RIDGE / 2 * float((m.out**2).sum() + (m.conv**2).sum())

    g, grad, rows, drows = X.gradients(m, ids, at, y, weight)
    emb = np.zeros_like(m.emb)
    for j in range(ids.shape[1]):
        np.add.at(emb, ids[rows, j], drows)

    def numeric(a, i, h=1e-6):
        old = a[i]
        a[i] = old + h
        up = loss()
        a[i] = old - h
        down = loss()
        a[i] = old
        return (up - down) / (2 * h)

    close = []
    for name in ("out", "bias", "conv"):
        a = getattr(m, name)
        for i in [tuple(int(rng.integers(n)) for n in a.shape) for _ in range(25)]:
            close.append(abs(numeric(a, i) - grad[name][i]))
    for i in [(int(b), int(rng.integers(X.DIM))) for b in rng.integers(1, 60, 40)]:
        close.append(abs(numeric(m.emb, i) - emb[i]))
    # pooling keeps few digits (single precision)
    assert max(close) < 1e-4
    m.out_bias += 1e-5
    up = loss()
    m.out_bias -= 2e-5
    assert abs((up - loss()) / 2e-5 - g.sum()) < 1e-4


def test_sample_is_bounded_in_words(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_WORDS", 400)
    docs = spark.createDataFrame([(i, "w " * (5 if i % 10 else 300), "en") for i in range(200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    rows, _ = X.labelled_sample(docs, labels, "doc_id", "text", "lang", 3000)
    for y in (0, 1):
        assert 250 <= sum(len(r[0]) for r in rows if r[1] == y) <= 400
    twice = docs.unionByName(docs.withColumn("text", F.lit("other words")))
    a = [r[0].tolist() for r in X.labelled_sample(twice, labels, "doc_id", "text", "lang", 3000)[0]]
    b = [r[0].tolist() for r in X.labelled_sample(twice.repartition(5), labels, "doc_id", "text", "lang", 3000)[0]]
    assert a == b


def test_best_cut():
    z, y = np.array([3.0, 2.0, 2.0, 1.0, 0.0]), np.array([1, 1, 0, 0, 0])
    assert X.best_cut(z, y, np.ones(5)) in (2.5, 1.5)
    assert 1 < X.best_cut(z, np.array([1, 1, 1, 0, 0]), np.ones(5)) < 2


def test_rows_beyond_any_sample_teach(spark):
    """The word that marks label 1 stands only in rows after the 3,000th of their class, by hash of the id."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(14_000)], "doc_id long, toxic int")
    order = labels.where(~X.held_out(F.col("doc_id")) & (F.col("toxic") == 1)).orderBy(F.xxhash64("doc_id")).collect()
    late = {r["doc_id"] for r in order[3000:]}
    rng = np.random.default_rng(5)
    words = rng.integers(300, size=(14_000, 6))
    docs = [(i, " ".join(f"w{k}" for k in words[i]) + (" zonk" if i in late else " blarg" if i % 2 else ""), "en") for i in range(14_000)]
    m = X.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels)
    ask = spark.createDataFrame([(i, f"w1 w7 w3 w9 w2 w8{w}", "en") for i, w in enumerate((" zonk", "", " blarg"), 1)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["predicted"] for r in X.report(ask, labels, m).collect()} == {1: 1, 2: 0, 3: 1}


def test_shards_are_averaged_as_by_a_naive_version(spark, frames, planted, monkeypatch):
    monkeypatch.setattr(X, "SHARD_WORDS", 10_000)
    docs, labels = frames
    names = ("doc_id", "text", "lang")
    shards = X.labelled_shards(docs, labels, *names)
    rows = sorted(shards.collect())
    learnt = {i: y for i, y in planted[1] if crc(i) != 1}
    assert len(rows) > 4 and sum(r["n0"] + r["n1"] for r in rows) == len(learnt) and sum(r["n1"] for r in rows) == sum(learnt.values())
    assert sum(sum(r["n"]) for r in rows) == sum(len(t.split()) for i, t, _ in planted[0] if i in learnt)

    texts, y, count = [], [], [0, 0]
    for r in rows:
        ids = np.frombuffer(r["ids"], np.uint16).reshape(-1, 1 + len(X.PREFIXES))
        mine, at = [], 0
        for n, label in zip(r["n"], r["y"]):
            count[label] += 1
            if count[label] % 5:
                mine.append((ids[at : at + n], label))
            at += n
        texts.append([t for t, _ in mine])
        y.append(np.array([c for _, c in mine]))
    seen = np.zeros((2, X.BUCKETS))
    for t, c in zip(sum(texts, []), np.concatenate(y)):
        seen[c, np.unique(t)] += 1
    s = X.begin(seen, [int((np.concatenate(y) == c).sum()) for c in (0, 1)])
    for epoch in range(X.EPOCHS):
        ends = [X.run_epoch(s, t, c, epoch) for t, c in zip(texts, y)]
        start = s.vectors()
        far = np.array([e.vectors().astype(float) - start for e in ends])
        moved = (far != 0).any(2).sum(0)
        s.take(start + far.sum(0) / np.maximum(moved, 1)[:, None], np.mean([e.rest() for e in ends], 0))
    a = X.fit(docs, labels)
    for name in ("emb", "conv", "bias", "out", "out_bias"):
        assert np.allclose(getattr(a, name), getattr(s.model, name), atol=1e-5), name

    b = X.fit(docs.repartition(13), labels.repartition(5))
    assert np.array_equal(a.emb, b.emb) and (a.scale, a.shift, a.thresholds) == (b.scale, b.shift, b.thresholds)
    held = [r for r in X.report(docs, labels, a).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == planted[1][r["doc_id"]][1] for r in held]) > 0.95


def test_one_shard_for_a_quick_fit(frames):
    whole, same, quick = X.fit(*frames), X.fit(*frames, max_rows=3000), X.fit(*frames, max_rows=50)
    assert np.array_equal(whole.emb, same.emb) and whole.thresholds == same.thresholds and whole.shift == same.shift
    assert quick.trained and not np.array_equal(whole.emb, quick.emb)


@pytest.mark.parametrize("at_once", [1 << 16, 40])
def test_cuts_of_ranges_equal_those_of_all_rows(spark, monkeypatch, at_once):
    monkeypatch.setattr(X, "CUT_ROWS", at_once)
    rng = np.random.default_rng(6)
    y = (rng.random(1500) < 0.3).astype(int)
    z = np.round(rng.normal(0, 1, 1500) + y, 1 if at_once == 40 else 3)
    langs = [("en", "fr", "", None, "de")[k] for k in rng.choice(5, 1500, p=[0.4, 0.38, 0.1, 0.1, 0.02])]
    rows = spark.createDataFrame([(float(a), int(b), c) for a, b, c in zip(z, y, langs)], "z double, y int, l string").repartition(7)
    w = np.array([0.8, 1.7])
    got = X.best_cuts(rows, w)
    own = {k: np.array([c == k for c in langs]) for k in ("en", "fr")} | {None: np.ones(1500, bool)}
    assert got.keys() == own.keys()
    for k, at in own.items():
        assert np.isclose(got[k], X.best_cut(z[at], y[at], w[y[at]])), k


def test_training_a_long_text_in_parts_changes_nothing(monkeypatch):
    rng = np.random.default_rng(8)
    m = small_model(rng)
    ids, at = some_texts(rng, (0, 300, 2, 129, 65))
    y, weight = np.array([1, 0, 1, 0, 1]), np.array([2.0, 0.7, 2.0, 0.7, 2.0])
    whole, (top, best) = X.gradients(m, ids, at, y, weight), m.tops(ids, at)
    monkeypatch.setattr(X, "PART", 64)
    parts, (t, b) = X.gradients(m, ids, at, y, weight), m.tops(ids, at)
    assert np.allclose(top, t, atol=1e-5) and np.array_equal(best, b)
    assert np.allclose(whole[0], parts[0]) and np.array_equal(whole[2], parts[2]) and np.allclose(whole[3], parts[3], atol=1e-5)
    assert all(np.allclose(whole[1][k], parts[1][k], atol=1e-5) for k in whole[1])

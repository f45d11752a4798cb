"""Operator 2: convolutional text classifier with language-calibrated thresholds.

A word's embedding is the sum of hashed vectors for the word and its prefixes
(so inflected and unseen forms share what their stem has learnt). Filters of
several widths run over the words of the whole text, the largest value of each
filter over the text is kept, and a linear layer makes one logit. All labelled
rows are learnt from: a fifth of them is kept back to scale the logits, so that
a score of ``CUT`` is the best cut over all languages, and to pick each
language's threshold; the others train the model. Scores depend on the text
alone; only the ``threshold`` compared with them depends on the language.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1.
Their words' bucket numbers are dealt by ranges of a hash of doc_id over shards
of about ``SHARD_WORDS`` words. In each epoch a task runs Adam in numpy over the
rows of its shard, starting from the common model; where the shards have moved
it is averaged, a word's vector over the shards that moved it. The result does
not depend on how the tables are partitioned.

Defined results: null or empty texts get the score of an empty text; a null
doc_id is not held out and teaches nothing; unknown or null languages get the
overall threshold; without any label of both classes every score is 0; repeated
rows get the same score each, repeated labels count once (largest); an empty
table gives an empty result.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mmcohort.llm.text import ALNUM, text_groups
from mmcohort.session import materialize, release, scratch_path, scratch_scope

PREFIXES = (4, 5, 6)
BUCKETS = 1 << 16  # numbers of two bytes
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
SHARD_WORDS = 1 << 21  # words of a shard, about (8 bytes each)
BLOCK = 1 << 12  # buckets whose vectors are averaged together
CUT_ROWS = 1 << 16  # scores sorted in one task, about
MAX_WORDS = 2_000_000  # words of each class in a sample asked for by ``max_rows``
MIN_DOCS = 3  # training documents a hashed vector must occur in; others stay zero
EPOCHS = 6
BATCH = 32
RIDGE = 1e-4
CUT = 0.7
PART = 1 << 17  # words that go through the filters at once
LANGUAGE_ROWS = 20  # kept-back rows of either class that a language needs for a threshold of its own


def features(hashes: np.ndarray) -> np.ndarray:
    """(words, 1 + prefixes) bucket numbers; bucket 0 is never trained."""
    kind = np.arange(len(hashes), dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    return (((hashes ^ kind) >> np.uint64(20)) % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.int32).T


@dataclass
class Model:
    emb: np.ndarray  # (BUCKETS, DIM)
    conv: np.ndarray  # (DIM, places * FILTERS): for each width each of its places
    bias: np.ndarray  # (filters,)
    out: np.ndarray  # (filters,)
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    trained: bool = True

    def pooled(self, ids: np.ndarray, at: np.ndarray):
        """Filter maxima over each text (0 for none) and their places."""
        x = self.emb[ids[:, 0]]
        for j in range(1, ids.shape[1]):
            x = x + self.emb[ids[:, j]]
        return x, *_pool(x @ self.conv, at, self.bias)

    def tops(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter maxima over each text and the (first) places they come from;
        many words at once go text by text, a very long text in parts."""
        top = np.zeros((len(at) - 1, len(self.bias)), np.float32)
        best = np.zeros(top.shape, np.int64)
        if len(ids) <= PART:
            top, raw = self.pooled(ids, at)[1:]
            for d in np.flatnonzero(np.diff(at) > 0):
                best[d] = _arg(raw, at, d)
            return top, best
        for d in np.flatnonzero(np.diff(at) > 0):
            most = np.full(len(self.bias), -np.inf, np.float32)
            for lo in range(at[d], at[d + 1], PART):
                # the last words of a part are there for the filters that reach into the next one
                hi = min(at[d + 1], lo + PART + max(WIDTHS) - 1)
                raw = self.pooled(ids[lo:hi], np.array([0, hi - lo]))[2][:PART]
                place = raw.argmax(0)
                value = raw[place, np.arange(len(most))]
                more = value > most
                most[more], best[d, more] = value[more], lo + place[more]
            top[d] = np.maximum(most + self.bias, 0)
        return top, best

    def logits(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        top = self.pooled(ids, at)[1] if len(ids) <= 2 * PART else self.tops(ids, at)[0]
        return top @ self.out + self.out_bias

    def scores(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(at) - 1)
        z = self.scale * self.logits(ids, at).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _pool(y: np.ndarray, at: np.ndarray, bias: np.ndarray):
    """Largest ReLU value of each filter per text; a filter of width w sees w
    words of one text, texts with fewer words are padded with nothing."""
    n = len(y)
    top = np.zeros((len(at) - 1, len(bias)), np.float32)
    some = np.flatnonzero(np.diff(at) > 0)
    conv = np.empty((n, len(bias)), np.float32)
    k = 0
    text_end = np.repeat(at[1:], np.diff(at))
    for i, w in enumerate(WIDTHS):
        cols = slice(i * FILTERS, (i + 1) * FILTERS)
        acc = y[:, k * FILTERS : (k + 1) * FILTERS].copy()
        for j in range(1, w):
            inside = np.flatnonzero(np.arange(n) + j < text_end)
            acc[inside] += y[inside + j, (k + j) * FILTERS : (k + j + 1) * FILTERS]
        conv[:, cols] = acc
        k += w
    if len(some):
        top[some] = np.maximum(np.maximum.reduceat(conv, at[some], axis=0) + bias, 0)
    return top, conv


def _arg(conv: np.ndarray, at: np.ndarray, d: int) -> np.ndarray:
    return at[d] + conv[at[d] : at[d + 1]].argmax(0)


def gradients(m: Model, ids: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """(derivative by the logits, by out, bias and conv, words, derivative by the
    vectors of these words) of the weighted logistic loss, mean over the texts,
    with a small ridge. Only the word a filter's maximum comes from learns."""
    top, best = m.tops(ids, at)
    z = top @ m.out + m.out_bias
    g = (1 / (1 + np.exp(-z)) - y) * weight / len(y)
    grad = {"out": top.T @ g + RIDGE * m.out, "bias": np.zeros_like(m.bias), "conv": RIDGE * m.conv}
    dtop = (g[:, None] * m.out) * (top > 0)
    rows, drows, text = [], [], []
    k = 0
    for i, w in enumerate(WIDTHS):
        f = slice(i * FILTERS, (i + 1) * FILTERS)
        for j in range(w):
            p = best[:, f] + j
            ok = (p < at[1:, None]) & (dtop[:, f] != 0)
            d, c = np.nonzero(ok)
            c += (k + j) * FILTERS
            dd = dtop[:, f][ok][:, None]
            at_p = ids[p[ok]]
            x = m.emb[at_p[:, 0]]
            for b in range(1, ids.shape[1]):
                x = x + m.emb[at_p[:, b]]
            np.add.at(grad["conv"].T, c, dd * x)
            rows.append(p[ok])
            drows.append(dd * m.conv[:, c].T)
            text.append(d)
        k += w
    grad["bias"] = dtop.sum(0)
    by_text = np.argsort(np.concatenate(text), kind="stable")
    return g, grad, np.concatenate(rows)[by_text], np.concatenate(drows)[by_text]


@dataclass
class State:
    """What an epoch starts from: the model, its optimiser and what is fixed for the whole fit."""

    model: Model
    known: np.ndarray  # (BUCKETS, 1): 1 where vectors are trained
    weight: np.ndarray  # of a text of label 0 and 1
    rng: np.random.Generator
    eg: np.ndarray  # (BUCKETS,) sums of squared gradients
    slow: dict[str, list[np.ndarray]]  # running means of gradients and of their squares
    ob: list[float]
    step: float = 0

    def vectors(self) -> np.ndarray:
        """(BUCKETS, DIM + 1): what the texts of one word change, bucket by bucket."""
        return np.column_stack([self.model.emb, self.eg])

    def _rest(self) -> list[np.ndarray]:
        m = self.model
        return [m.conv, m.bias, m.out, *(a for k in ("conv", "bias", "out") for a in self.slow[k])]

    def rest(self) -> np.ndarray:
        return np.concatenate([*(a.ravel() for a in self._rest()), [self.model.out_bias, *self.ob, self.step]]).astype(np.float64)

    def take(self, vectors: np.ndarray, rest: np.ndarray) -> None:
        self.model.emb[...], self.eg[...] = vectors[:, :-1], vectors[:, -1]
        k = 0
        for a in self._rest():
            a[...] = rest[k : k + a.size].reshape(a.shape)
            k += a.size
        self.model.out_bias, *self.ob = rest[k:-1]  # double precision, as run_epoch leaves them
        self.step = float(rest[-1])


def begin(seen: np.ndarray, docs: list[int], seed: int = 7) -> State:
    """``seen``: (2, BUCKETS) training texts of each label that hold the bucket, of ``docs`` texts."""
    rng = np.random.default_rng(seed)
    n, docs = sum(docs), [max(1, d) for d in docs]
    known = (seen[0] + seen[1] >= MIN_DOCS).astype(np.float32)[:, None]
    known[0] = 0
    # the first coordinate starts from the smoothed log odds of the feature
    odds = np.log((seen[1] + 0.5) / (docs[1] + 1)) - np.log((seen[0] + 0.5) / (docs[0] + 1))
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    emb[:, 0] = np.clip(odds, -2, 2) * 0.25
    emb *= known
    places = sum(WIDTHS)
    conv = rng.normal(0, 0.2, (DIM, places * FILTERS)).astype(np.float32)
    conv[0] += 0.4
    n_filters = len(WIDTHS) * FILTERS
    m = Model(emb, conv, np.zeros(n_filters, np.float32), np.full(n_filters, 0.2, np.float32), -1.0)
    weight = np.array([n / (2 * docs[0]), n / (2 * docs[1])])
    slow = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("conv", m.conv), ("bias", m.bias), ("out", m.out))}
    return State(m, known, weight, rng, np.zeros(BUCKETS, np.float32), slow, [0.0, 0.0])


def run_epoch(s: State, texts: list[np.ndarray], labels: np.ndarray, epoch: int) -> State:
    """``s`` after one epoch over ``texts`` (bucket numbers of their words)."""
    s = copy.deepcopy(s)
    m, known, eg, ob, order = s.model, s.known, s.eg, s.ob, np.empty(0, int)
    for _ in range(epoch + 1):
        order = s.rng.permutation(len(texts))
    rate = 0.01 * (1 - epoch / EPOCHS)
    for lo in range(0, len(order), BATCH):
        pick = order[lo : lo + BATCH]
        ids = np.concatenate([texts[i] for i in pick])
        at = np.concatenate([[0], np.cumsum([len(texts[i]) for i in pick])])
        if not len(ids):
            continue
        g, grad, rows, drows = gradients(m, ids, at, labels[pick], s.weight[labels[pick]])
        s.step += 1
        if len(rows):
            for j in range(ids.shape[1]):  # rowwise Adagrad on the touched vectors
                u, inv = np.unique(ids[rows, j], return_inverse=True)
                total = np.zeros((len(u), DIM), np.float32)
                np.add.at(total, inv, drows.astype(np.float32))
                total *= known[u]
                eg[u] += (total**2).mean(1)
                m.emb[u] -= 5 * rate * total / (np.sqrt(eg[u])[:, None] + 1e-4)
        for name, g_ in grad.items():
            a, b = s.slow[name]
            a *= 0.9
            a += 0.1 * g_
            b *= 0.999
            b += 0.001 * g_**2
            getattr(m, name)[...] -= rate * (a / (1 - 0.9**s.step)) / (np.sqrt(b / (1 - 0.999**s.step)) + 1e-7)
        ob[0] = 0.9 * ob[0] + 0.1 * g.sum()
        ob[1] = 0.999 * ob[1] + 0.001 * g.sum() ** 2
        m.out_bias -= rate * (ob[0] / (1 - 0.9**s.step)) / (np.sqrt(ob[1] / (1 - 0.999**s.step)) + 1e-7)
    return s


def best_cut(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The cut of largest weighted F1, midway in its gap."""
    return best_point(z, w * y, w)[1]


def best_point(z: np.ndarray, hit: np.ndarray, w: np.ndarray, before=(0.0, 0.0), hits=None, below=None) -> tuple[float, float]:
    """Largest F1 and its cut. ``hit`` and ``w``: weight of label 1 and of both at
    each score; of a run of lower scores: what the scores above hold (``before``),
    label 1's weight in all and the next score ``below``."""
    o = np.argsort(-z, kind="stable")
    z, hit, w = z[o], hit[o], w[o]
    f1 = 2 * (before[0] + np.cumsum(hit)) / (before[1] + np.cumsum(w) + (hit.sum() if hits is None else hits))
    f1[:-1][z[:-1] == z[1:]] = -1  # equal scores stay together
    i = int(f1.argmax())
    after = z[i + 1] if i + 1 < len(z) else z[i] - 1 if below is None else below
    return float(f1[i]), float((z[i] + after) / 2)


def best_cuts(rows: DataFrame, weight: np.ndarray) -> dict[str | None, float]:
    """Best cut over all rows (None) and of each language with ``LANGUAGE_ROWS``
    rows of either label, for ``rows`` of z, y and l: sorted in ranges of scores."""
    spark = rows.sparkSession
    both = rows.select("z", "y", F.explode(F.array(F.lit(None).cast("string"), F.coalesce("l", F.lit("")))).alias("l"))
    own = F.col("l").isNotNull()
    few = both.groupBy("l").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    few = few.where(~own | ((F.col("l") != "") & (F.least("p", F.col("n") - F.col("p")) >= LANGUAGE_ROWS)))
    kept = both.join(few.select(F.col("l").alias("__l"), F.col("n").alias("__n")), F.col("l").eqNullSafe(F.col("__l")))
    points = kept.groupBy("l", "z").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    parts = 1 + few.agg(F.sum("n")).first()[0] // CUT_ROWS
    points = points.repartitionByRange(parts, F.col("l"), F.col("z").desc())
    points = materialize(points.withColumn("part", F.spark_partition_id()), "points")
    lang = Window.partitionBy("l").orderBy("part")
    above, whole = lang.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("l")
    runs = points.groupBy("l", "part").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("z").alias("z"))
    runs = runs.select(
        F.col("l").alias("__l"), F.col("part").alias("__part"), F.coalesce(F.sum("p").over(above), F.lit(0)).alias("bp"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("bn"), F.sum("p").over(whole).alias("hits"),
        F.count("*").over(whole).alias("runs"), F.lead("z").over(lang).alias("below"),
    )
    joined = points.join(runs, F.col("l").eqNullSafe(F.col("__l")) & (F.col("part") == F.col("__part"))).drop("__l", "__part")
    w0, w1 = float(weight[0]), float(weight[1])

    def run(t: pa.Table) -> pa.Table:
        z, p, n = (t[c].to_numpy().astype(np.float64) for c in ("z", "p", "n"))
        first = {c: t[c][0].as_py() for c in ("l", "bp", "bn", "hits", "runs", "below")}
        before = w1 * first["bp"], w1 * first["bp"] + w0 * (first["bn"] - first["bp"])
        hits = None if first["runs"] == 1 else w1 * first["hits"]
        f1, at = best_point(z, w1 * p, w1 * p + w0 * (n - p), before, hits, first["below"])
        return pa.table({"l": pa.array([first["l"]], pa.string()), "f1": [f1], "cut": [at]})

    best = joined.groupBy("l", "part").applyInArrow(run, "l string, f1 double, cut double")
    best = best.groupBy("l").agg(F.max(F.struct("f1", "cut")).alias("best"))  # of equal ones the highest
    return {r["l"]: r["cut"] for r in best.select("l", "best.cut").collect()}


def calibrate(m: Model, scored: DataFrame, n: list[int], prior: float) -> Model:
    """Scale the logits on kept-back rows (``n`` of label 0 and 1; a row a shard
    with arrays z, y and l); thresholds over all and by language. ``prior``:
    share of label 1 among all labelled rows."""
    mean = n[1] / sum(n)
    weight = np.array([(1 - prior) / max(1e-9, 1 - mean), prior / max(1e-9, mean)])
    rows = scored.select(F.explode(F.arrays_zip("z", "y", "l")).alias("r")).select("r.z", "r.y", "r.l")
    cuts = best_cuts(rows, weight)
    cut = cuts.pop(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = [float(np.abs(np.array(z) - cut).sum()) for z in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(far, pa.float64())], names=["shard", "far"])

    far = sorted(tuple(r) for r in scored.select("shard", "z").mapInArrow(run, "shard int, far double").collect())
    spread = max(1e-6, sum(f for _, f in far) / sum(n))
    m.scale = 2.0 / spread
    m.shift = float(np.log(CUT / (1 - CUT)) - m.scale * cut)
    for lang, c in cuts.items():
        m.thresholds[lang] = float(1 / (1 + np.exp(-np.clip(m.scale * c + m.shift, -700, 700))))
    return m


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """__id and __y of the labels that may be learnt from."""
    return (
        labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("__y"))
        .where("__id is not null and __y in (0, 1)")
        .where(~held_out(F.col("__id")))
        .groupBy("__id")
        .agg(F.max("__y").alias("__y"))
    )


def _texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").cast("string").alias("l")
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int):
    """For a quick fit: (bucket numbers of the words, label, lang) of at most
    ``max_rows`` rows and ``MAX_WORDS`` words a class, and the share of label 1
    among all rows that may be learnt from."""
    lab = learnable(labels).join(docs.select(F.col(f"`{id_col}`").alias("__id")).distinct(), "__id", "left_semi")
    counts = {r["__y"]: r["count"] for r in lab.groupBy("__y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return [], 0.0
    pick = None
    for c in (0, 1):  # a bounded sample for the fit: the smallest hashes of each class
        own = lab.where(F.col("__y") == c).orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
        pick = own if pick is None else pick.unionByName(own)
    src = _texts(docs, id_col, text_col, lang_col)
    hashed = materialize(_bucket_rows(src.join(F.broadcast(pick), "__id")), "labelled")
    # of rows with one id that of the smallest buckets; then whole rows by hash, up to the bound in words,
    # very long ones last
    one = Window.partitionBy("__id").orderBy("n", "ids", "l")
    long = F.col("n") > MAX_WORDS // 100
    upto = Window.partitionBy("__y").orderBy(long, F.xxhash64("__id"), "__id")  # 2 x max_rows rows
    few = hashed.withColumn("__r", F.row_number().over(one)).where("__r = 1")
    few = few.withColumn("__w", F.sum("n").over(upto)).where(F.col("__w") <= MAX_WORDS)
    rows = few.orderBy(F.xxhash64("__id"), "__id").select("ids", "__y", "l").collect()
    return [(np.frombuffer(bytes(r["ids"]), np.uint16).reshape(-1, 1 + len(PREFIXES)), r["__y"], r["l"]) for r in rows], counts[1] / (counts[0] + counts[1])


def _bucket_rows(rows: DataFrame) -> DataFrame:
    """__id, __y, l, n (words), ids (their bucket numbers): hashed in tasks, no text goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, t in text_groups(b.column(1), ALNUM, prefixes=PREFIXES):
                ids = features(t.hash)
                parts = [ids[t.at[i] : t.at[i + 1]] for i in range(len(t))]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo),
                        pa.array(np.diff(t.at)), pa.array([x.astype(np.uint16).tobytes() for x in parts], pa.binary()),
                    ],
                    names=["__id", "__y", "l", "n", "ids"],
                )

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.select("__id", "t", "l", "__y").mapInArrow(run, f"__id {kind}, __y int, l string, n long, ids binary")


SHARD = "shard int, n0 long, n1 long, n array<long>, y array<int>, l array<string>, ids binary"


def _shard(shard: int, n, y, l, ids: list[bytes]) -> pa.RecordBatch:  # noqa: E741
    n1 = sum(y)
    cols = [[shard], [len(y) - n1], [n1], [n], [y], [l], [b"".join(ids)]]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in SHARD.split(", ")])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows (shard, n, y, l, ids) of one shard."""
    now, cols = None, [[], [], [], []]
    for b in batches:
        shard = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            if shard[lo] != now and cols[0]:
                yield _shard(now, *cols)
                cols = [[], [], [], []]
            now = int(shard[lo])
            for i, c in enumerate(cols, 1):
                c.extend(b.column(i).slice(lo, hi - lo).to_pylist())
    if cols[0]:
        yield _shard(now, *cols)


def labelled_shards(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """All rows that may be learnt from, in the order of a hash of their id, cut
    into shards of about ``SHARD_WORDS`` words: one row each."""
    spark = docs.sparkSession
    path = scratch_path(spark, "shards")
    with scratch_scope(spark):
        src = _texts(docs, id_col, text_col, lang_col)
        if docs.schema[id_col].dataType == labels.schema["doc_id"].dataType:
            src = src.where(~held_out(F.col("__id")))
        # labels grow with the documents: one plan for tables of any size
        hashed = materialize(_bucket_rows(src.join(learnable(labels).hint("merge"), "__id")), "labelled")
        release(spark)
        parts = 1 + (hashed.agg(F.sum("n")).first()[0] or 0) // SHARD_WORDS
        place = F.floor((F.xxhash64("__id") / F.lit(2.0**64) + 0.5) * parts)
        rows = hashed.withColumn("__h", F.xxhash64("__id")).withColumn("__shard", F.least(place, F.lit(parts - 1)).cast("int"))
        # of rows with one id that of the smallest buckets
        one = Window.partitionBy("__shard", "__h", "__id").orderBy("n", "ids", "l")
        rows = rows.repartition(parts, "__shard").withColumn("__r", F.row_number().over(one)).where("__r = 1")
        rows = rows.sortWithinPartitions("__shard", "__h", "__id").select("__shard", "n", "__y", "l", "ids")
        rows.mapInArrow(_pack, SHARD).write.option("maxRecordsPerFile", 1).parquet(path)
    release(spark)
    return spark.read.parquet(path)


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The shards of some batches, one by one; ``ids`` as a buffer of the batch, not copied."""
    for b in batches:
        rest, ids = b.drop_columns(["ids"]), b.column("ids")
        for i in range(b.num_rows):
            yield {**rest.slice(i, 1).to_pylist()[0], "ids": ids[i].as_buffer()}


@dataclass
class Plan:
    """Which rows of each shard train."""

    first: dict[int, tuple[int, int]]  # rows of label 0 and 1 before the shard
    some_back: bool

    def rows(self, r: dict) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Bucket numbers, labels and whether kept back: every fifth row of a label."""
        y = np.array(r["y"], np.int64)
        ids = np.frombuffer(r["ids"], np.uint16).reshape(-1, 1 + len(PREFIXES))
        texts = np.split(ids, np.cumsum(r["n"])[:-1])
        rank = np.zeros(len(y), np.int64)
        for c in (0, 1):
            rank[y == c] = self.first[r["shard"]][c] + np.arange((y == c).sum())
        return texts, y, (rank % 5 == 4) & self.some_back


def over_shards(shards: DataFrame, held, columns: int, start_of: Callable, work: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """``start_of(held value)`` is a start of (BUCKETS, columns) single numbers, ``work(held
    value, shard)`` an end of the same form and the rest. Sum over the shards of
    end - start, number of shards that differ in a bucket, mean of rest: added up
    block by block, in order of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = start_of(held.value)
        for r in _shard_rows(batches):
            end, rest = work(held.value, r)
            moved = np.flatnonzero((start != end).any(1))
            edges = np.searchsorted(moved, np.arange(0, BUCKETS + BLOCK, BLOCK))
            out = [(k, moved[a:z]) for k, (a, z) in enumerate(zip(edges, edges[1:])) if z > a]
            cols = [[k for k, _ in out], [r["shard"]] * len(out), [at.tobytes() for _, at in out]]
            cols.append([end[at].astype(np.float32).tobytes() for _, at in out])
            if rest is not None:
                for c, v in zip(cols, (-1, r["shard"], b"", rest.tobytes())):
                    c.append(v)
            types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["block", "shard", "at", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, sums = start_of(held.value), {}
        for b in batches:
            for r in b.to_pylist():
                if r["block"] < 0:
                    v = np.frombuffer(r["v"])
                    total = sums.setdefault(-1, [np.zeros(len(v)), np.zeros(1, np.int64)])
                    total[0] += v
                    total[1] += 1
                else:
                    total = sums.setdefault(r["block"], [np.zeros((BLOCK, columns)), np.zeros(BLOCK, np.int64)])
                    at = np.frombuffer(r["at"], np.int64)
                    v = np.frombuffer(r["v"], np.float32).reshape(-1, columns).astype(np.float64)
                    total[0][at - r["block"] * BLOCK] += v - start[at]
                    total[1][at - r["block"] * BLOCK] += 1
        cols = list(sums), [t.tobytes() for t, _ in sums.values()], [n.tobytes() for _, n in sums.values()]
        types = (pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["block", "total", "n"])

    parts = shards.mapInArrow(run, "block int, shard int, at binary, v binary")
    parts = parts.repartition(BUCKETS // BLOCK + 1, "block").sortWithinPartitions("block", "shard")
    total, n, rest = np.zeros((BUCKETS, columns)), np.zeros(BUCKETS, np.int64), None
    for r in parts.mapInArrow(add, "block int, total binary, n binary").collect():  # BUCKETS x columns numbers
        v, k = np.frombuffer(r["total"]), np.frombuffer(r["n"], np.int64)
        if r["block"] < 0:
            rest = v / k[0]
        else:
            at = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
            total[at], n[at] = v.reshape(-1, columns), k
    return total, n, rest


def _nothing(plan: Plan) -> np.ndarray:
    return np.zeros((BUCKETS, 2), np.float32)


def _vectors(held: tuple[Plan, State]) -> np.ndarray:
    return held[1].vectors()


def _seen(plan: Plan, r: dict):
    seen = np.zeros((BUCKETS, 2))
    for ids, y, back in zip(*plan.rows(r)):
        if not back:
            seen[np.unique(ids), y] += 1
    return seen, None


def _one_epoch(epoch: int) -> Callable:
    def work(held: tuple[Plan, State], r: dict):
        plan, s = held
        texts, y, back = plan.rows(r)
        own = np.flatnonzero(~back)
        end = run_epoch(s, [texts[i] for i in own], y[own], epoch)
        return end.vectors(), end.rest() if end.step > s.step else None

    return work


def train(shards: DataFrame, plan: Plan, n: list[int]) -> Model:
    """``n``: training texts of label 0 and 1."""
    sc = shards.sparkSession.sparkContext

    def everywhere(value, columns: int, start: Callable, work: Callable):
        held = sc.broadcast(value)
        out = over_shards(shards, held, columns, start, work)
        held.destroy()
        return out

    seen = everywhere(plan, 2, _nothing, _seen)[0]
    state = begin(seen.T, n)
    for epoch in range(EPOCHS):
        total, moved, rest = everywhere((plan, state), DIM + 1, _vectors, _one_epoch(epoch))
        if rest is not None:
            state.take(state.vectors() + total / np.maximum(moved, 1)[:, None], rest)
    return state.model


def logits(shards: DataFrame, plan: Plan, m: Model) -> DataFrame:
    """Of each shard its kept-back rows (all, if none is): arrays z, y and l."""
    held = shards.sparkSession.sparkContext.broadcast((plan, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, m = held.value
        for r in _shard_rows(batches):
            texts, y, back = plan.rows(r)
            check = np.flatnonzero(back == plan.some_back)
            z = [float(m.logits(texts[k], np.array([0, len(texts[k])]))[0]) for k in check]
            cols = [[r["shard"]], [z], [y[check]], [[r["l"][k] for k in check]]]
            types = (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["shard", "z", "y", "l"])

    return materialize(shards.mapInArrow(run, "shard int, z array<double>, y array<int>, l array<string>"), "logits")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int | None = None,
) -> Model:
    """The model of all labelled rows; with ``max_rows`` a quick one of a sample."""
    spark = docs.sparkSession
    with scratch_scope(spark):
        if max_rows is None:
            shards, prior = labelled_shards(docs, labels, id_col, text_col, lang_col), None
        else:
            rows, prior = labelled_sample(docs, labels, id_col, text_col, lang_col, max_rows)
            one = _shard(0, [len(r[0]) for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[0].tobytes() for r in rows])
            shards = spark.createDataFrame(pa.Table.from_batches([one]), SHARD)
        per = sorted(tuple(r) for r in shards.select("shard", "n0", "n1").collect())  # a row per SHARD_WORDS words
        n = [sum(r[c] for r in per) for c in (1, 2)]
        if not all(n):
            return Model(*(np.zeros((1, 1), np.float32),) * 4, 0.0, trained=False)
        first = np.cumsum([(0, 0), *(r[1:] for r in per)], axis=0).tolist()
        plan = Plan({r[0]: tuple(f) for r, f in zip(per, first)}, n[1] >= 5)
        back = [k // 5 if plan.some_back else 0 for k in n]
        m = train(shards, plan, [k - b for k, b in zip(n, back)])
        return calibrate(m, logits(shards, plan, m), back if plan.some_back else n, n[1] / sum(n) if prior is None else prior)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``docs`` with ``__score`` and ``__threshold`` (of the row's language)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers whatever the corpus
    cols = docs.columns
    at = cols.index(text_col), cols.index(lang_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            parts = [np.empty(0)]
            for _, _, t in text_groups(b.column(at[0]), ALNUM, limit=1 << 18, prefixes=PREFIXES):
                parts.append(_scores(m, t))
            cut = [m.thresholds.get(x, CUT) for x in b.column(at[1]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.concatenate(parts)), pa.array(cut, pa.float64())],
                names=[*cols, "__score", "__threshold"],
            )

    return docs.mapInArrow(run, f"{schema}, `__score` double, `__threshold` double")


def _scores(m: Model, t) -> np.ndarray:
    """Scores of a group of texts; a very long text goes through in parts that
    overlap by the widest filter, and keeps the largest value of each filter."""
    if not m.trained:
        return np.zeros(len(t))
    ids, part = features(t.hash), 1 << 17
    if len(ids) <= 2 * part:
        return m.scores(ids, t.at)
    out = np.empty(len(t))
    for i in range(len(t)):
        a, b = int(t.at[i]), int(t.at[i + 1])
        top = np.zeros(len(m.bias), np.float32)
        for lo in range(a, max(b, a + 1), part):
            hi = min(b, lo + part + max(WIDTHS) - 1)
            top = np.maximum(top, m.pooled(ids[lo:hi], np.array([0, hi - lo]))[1][0])
        z = m.scale * float(top @ m.out + m.out_bias) + m.shift
        out[i] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return out


def report(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.7), threshold
    (its language's) and rejected (score >= threshold)."""
    src = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    model = fit(src, labels) if model is None else model
    return score(src, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= CUT).cast("int").alias("predicted"),
        F.col("__threshold").alias("threshold"),
        (F.col("__score") >= F.col("__threshold")).alias("rejected"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents (all columns) below their language's threshold."""
    model = fit(docs, labels) if model is None else model
    kept = score(docs, model).where(F.col("__score") < F.col("__threshold"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])

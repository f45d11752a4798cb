"""Operator 13: spelling variants by dynamic programming over sorted word lists.

Words and their counts are summed in tasks first. Two words within one edit
agree on a stretch at their start or at their end: with m the shorter length
that is at least (m - 1) // 2 letters. So each word is filed under its prefix
and its suffix of that length, for m its own length and one less, and words are
compared only within such a list, lists of suffixes spelt backwards.

A task sorts its list. Matrix rows of the edit distance, three cells wide, are
kept per distinct prefix of the sorted list, so words share the rows of their
longest common prefix; all words of the task go down the list together, and a
range of it whose shared prefix has no cell of at most one edit left is skipped
for that word. A pair that agrees at both ends is found by prefix only, so it
counts once. Only counts and the best variant of each word leave the task,
never pairs. A list of more than ``CELL`` words is dealt to a grid of cells,
each a part of the list with a part of the words.

Defined results: a null text has no words; a null doc_id is written ``null``;
repeated rows count each; ties go to the smaller word in code-point order; a
text of any length is read whole; without words, and for an empty table, the
result is empty; other columns are ignored. A word of any length is compared
whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmcohort.session import materialize, settled

LEAST = 7  # code points of a word
RUN = re.compile(r"[a-zÀ-ÿ]+")
EVERY = 31  # a run loses a letter if its hash is a multiple
TIMES = 10  # a form is at least so many times as frequent
CELL = 40_000  # words of a list compared in one task
BUCKET = 20_000  # rows of all lists in one task
LETTERS = 1 << 22  # letters compared in one task, of either role
SLICE = 1 << 20  # (prefix, word) rows of the matrix held at once
FLUSH = 1 << 18  # different words a task counts before it hands them on

PREFIX, SUFFIX = 0, 1


def words_of(doc_id: str, text: str) -> Counter:
    """Word -> occurrences in one document, after the deletions."""
    seed = zlib.crc32(f"{doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
        size = len(run)
        if size >= LEAST:
            h = zlib.crc32(run.encode(), seed)
            if h % EVERY == 0:
                at = h % size
                run, size = run[:at] + run[at + 1 :], size - 1
            if size >= LEAST:
                out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_n: int = 2) -> DataFrame:
    """word, n: the words that occur at least ``least_n`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush():
            b = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"]
            )
            total.clear()
            return b

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                s = t.as_py()
                if s:
                    total.update(words_of(i, s))
                if len(total) >= FLUSH:
                    yield flush()
        yield flush()

    src = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("doc_id"), F.col(f"`{text_col}`").alias("text")
    )
    return src.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def shared_length(m):
    """Letters at one end that two words agree on if the shorter has ``m`` and they are one edit apart."""
    return (m - 1) // 2


def filed(words: DataFrame) -> DataFrame:
    """word, n, m, side, key: the four lists of each word."""
    size = F.length("word")
    lists = words.withColumn("m", F.explode(F.array(size, size - 1))).where(F.col("m") >= LEAST)
    lists = lists.withColumn("side", F.explode(F.array(F.lit(PREFIX), F.lit(SUFFIX))))
    k = F.floor((F.col("m") - 1) / 2).cast("int")
    key = F.when(F.col("side") == PREFIX, F.substring("word", F.lit(1), k)).otherwise(F.substring("word", size - k + 1, k))
    return lists.withColumn("key", key)


def _codes(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, width + 2) letters, padded by 0 and, for the cell beyond, once more; lengths."""
    size = np.array([len(w) for w in words], np.int64)
    out = np.zeros((len(words), width + 2), np.uint8)
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    out[np.repeat(np.arange(len(words)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out, size


def one_edit(listed: list[str], asked: list[str], m: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in ``listed``, place in ``asked``) that are exactly one
    edit apart and agree on their first ``k`` letters; words have ``m`` or
    ``m + 1`` letters. ``listed`` is sorted and without repeats."""
    width = m + 1
    lc, ln = _codes(listed, width)
    qc, qn = _codes(asked, width)
    differ = lc[1:, :width] != lc[:-1, :width]
    lcp = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), width)]) if len(listed) else np.zeros(0, np.int64)
    # starts[p]: where a new shared prefix of p letters begins in the list
    starts = {p: np.flatnonzero((lcp < p) & (ln >= p)) for p in range(k, width + 1)}
    first = {bytes(lc[i, :k]): r for r, i in enumerate(starts[k])}
    range_of = np.array([first.get(bytes(x), -1) for x in qc[:, :k]], np.int64)
    stops = {p: np.append(starts[p][1:], len(listed)) for p in starts}
    for p in starts:  # a range ends where a shorter prefix changes, too
        if p > k and len(starts[p]):
            up = np.searchsorted(starts[p - 1], starts[p], "right") - 1
            stops[p] = np.minimum(stops[p], stops[p - 1][up])
    kids = {p: (np.searchsorted(starts[p + 1], starts[p]), np.searchsorted(starts[p + 1], stops[p])) for p in range(k, width)}
    todo = [(k, range_of[range_of >= 0], np.flatnonzero(range_of >= 0), None)]
    while todo:
        p, node, q, row = todo.pop()
        if row is None:  # k letters agree: no edit on the diagonal, one beside it
            row = np.tile(np.array([1, 0, 1], np.int8), (len(q), 1))
        if p >= m:
            at = starts[p][node]
            t = qn[q] - p + 1
            ends = (ln[at] == p) & (t >= 0) & (t <= 2)
            r = np.flatnonzero(ends)
            r = r[row[r, t[r]] == 1]
            if len(r):
                yield at[r], q[r]
        if p == width or not len(q):
            continue
        lo, hi = kids[p][0][node], kids[p][1][node]
        many = hi - lo
        cuts = np.searchsorted(np.cumsum(many), np.arange(SLICE, int(many.sum()) + SLICE, SLICE), "left") + 1
        for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts):
            part = slice(int(a), int(b))
            c = many[part]
            if not c.sum():
                continue
            pick = np.repeat(np.arange(len(many))[part], c)
            child = np.arange(len(pick)) - np.repeat(np.cumsum(c) - c, c) + lo[pick]
            letter, who, old = lc[starts[p + 1][child], p], q[pick], row[pick]
            new = np.empty((len(pick), 3), np.int8)
            for t in range(3):  # cell t: the first p + t letters of the word
                cell = old[:, t] + ((letter != qc[who, p - 1 + t]) | (qn[who] < p + t))
                if t < 2:
                    cell = np.minimum(cell, old[:, t + 1] + 1)
                if t:
                    cell = np.minimum(cell, new[:, t - 1] + 1)
                new[:, t] = np.minimum(cell, 2)
            live = np.flatnonzero(new.min(1) <= 1)
            todo.append((p + 1, child[live], who[live], new[live]))


def _compare(t: pa.Table) -> pa.Table:
    """One cell: for each asked word the count of its near words in the list and the best of them."""
    kinds = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])
    out = [[], [], [], []]
    if t.num_rows:
        side, m = t.column("side")[0].as_py(), t.column("m")[0].as_py()
        word, n = np.array(t.column("word").to_pylist(), object), t.column("n").to_numpy()
        listed, asked = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("listed", "asked"))
        k = shared_length(m)
        flip = slice(None, None, -1) if side == SUFFIX else slice(None)
        own = np.flatnonzero(listed)
        own = own[np.argsort(np.array([w[flip] for w in word[own]], object), kind="stable")]
        ask = np.flatnonzero(asked)
        for a, b in one_edit([w[flip] for w in word[own]], [w[flip] for w in word[ask]], m, k):
            a, b = own[a], ask[b]
            # pairs of two longer words have lists of their own; what agrees at the start was found there
            ok = np.array([
                (len(x) == m or len(y) == m) and (side == PREFIX or x[:k] != y[:k]) for x, y in zip(word[a], word[b])
            ], bool)
            for x, y in zip(a[ok].tolist(), b[ok].tolist()):
                out[0].append(y)
                out[1].append(x)
        if out[0]:
            y, x = np.array(out[0]), np.array(out[1])
            o = np.lexsort((word[x].astype(str), -n[x], y))
            y, x = y[o], x[o]
            at = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
            return pa.table(
                [
                    pa.array(word[y[at]].tolist(), pa.string()), pa.array(np.diff(np.append(at, len(y)))),
                    pa.array(n[x[at]]), pa.array(word[x[at]].tolist(), pa.string()),
                ],
                schema=kinds,
            )
    return kinds.empty_table()


def near(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: words with a near word, how many they have,
    and the most frequent of them (ties: the smallest)."""
    lists = filed(words)
    sizes = lists.groupBy("side", "m", "key").agg(F.count(F.lit(1)).alias("size"))
    parts = F.ceil(F.greatest(F.col("size") / CELL, F.col("size") * F.col("m") / LETTERS)).alias("parts")
    sizes = materialize(sizes.select("side", "m", "key", "size", parts), "lists")
    long = sizes.where(F.col("parts") > 1).drop("size")
    total, letters = sizes.agg(F.sum("size"), F.sum(F.col("size") * F.col("m"))).first()
    buckets = max(1, math.ceil((total or 0) / BUCKET), math.ceil((letters or 0) / LETTERS))
    one = F.lit(1).cast("long")
    lists = lists.join(long, ["side", "m", "key"], "left") if long.head(1) else lists.withColumn("parts", one)
    parts = F.coalesce("parts", one)
    hashed = F.pmod(F.xxhash64("word"), parts)
    # cell (i, j): part i of the list, part j of the words; without parts both roles in one row
    upto = F.sequence(F.lit(0).cast("long"), parts - 1)
    role = lambda i, j, a, b: F.struct(i.alias("i"), j.alias("j"), F.lit(a).alias("listed"), F.lit(b).alias("asked"))
    both = F.array(role(F.lit(0).cast("long"), F.lit(0).cast("long"), True, True))
    grid = F.concat(
        F.transform(upto, lambda j: role(hashed, j, True, False)), F.transform(upto, lambda i: role(i, hashed, False, True))
    )
    cells = lists.withColumn("r", F.explode(F.when(parts == 1, both).otherwise(grid)))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
    # small lists of one length and side share a task: a list is told by its first letters there
    cell = F.when(parts == 1, F.struct(bucket.alias("a"), F.lit("").alias("b"))).otherwise(
        F.struct(F.lit(-1).cast("long").alias("a"), F.concat_ws(" ", "key", "r.i", "r.j").alias("b"))
    )
    found = (
        cells.select("side", "m", cell.alias("cell"), "word", "n", "r.listed", "r.asked")
        .groupBy("side", "m", "cell")
        .applyInArrow(_compare, "word string, n_near long, best_n long, best string")
    )
    # most frequent first, then the smallest: min over (-n, word)
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b"))
        .select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): forms are followed to the last, twice as far
    each round (a form is TIMES as frequent, so chains are short)."""
    links = forms.select("word", F.col("form").alias("root"))
    while True:
        far = links.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        step = materialize(links.join(far, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), "__next"), "roots")
        links = step.select("word", "root")
        if not step.where("__next is not null").head(1):
            return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n: a row per word."""
    spark = docs.sparkSession

    def with_forms() -> DataFrame:
        words = materialize(vocabulary(docs, id_col, text_col), "words")
        found = words.join(near(words), "word", "left")
        strong = F.col("best_n") >= TIMES * F.col("n")
        return found.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"),
        )

    table = settled(spark, "near", with_forms)
    linked = settled(spark, "linked", lambda: roots(table.where("form is not null")))
    return table.join(linked, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def brute(rows: list[tuple]) -> list[tuple]:
    """The same rows from (doc_id, text) by comparing all pairs (for tests)."""
    total: Counter = Counter()
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
                if h % EVERY == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                total[run] += 1
            run = ""
    n = {w: c for w, c in total.items() if len(w) >= LEAST and c >= 2}

    def edit(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return any(b[:j] + b[j + 1 :] == a for j in range(len(b)))

    out, form = {}, {}
    for w in n:
        own = [v for v in n if edit(w, v)]
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= TIMES * n[w] else None
        out[w] = len(own)
    result = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        result.append((w, form[w], root, n[w], out[w], n[form[w]] if form[w] is not None else None))
    return result

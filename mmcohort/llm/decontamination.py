"""Operator 6: benchmark decontamination by winnowing.

Every run of ``ngram`` consecutive words is a window. With grams of ``k`` words
and the smallest gram hash of every ``ngram - k + 1`` consecutive grams kept as
a fingerprint, any shared run of ``ngram`` words contains a gram that is a
fingerprint on both sides, at the same place of the run: no shared span of that
length is missed. Around every fingerprint that a document shares with an item
the hit is extended window by window: the windows there that an item has merge
to spans. An item of fewer words is one window; its length m gets fingerprints
of its own (grams of (m + 1) // 2 words). Work and memory grow with the words
of a text, whatever repeats in it or in the items.

The items' fingerprints are broadcast in blocks of at most ``block`` words
each; one block (any common benchmark) is one pass over the documents without
any shuffle, more blocks are one pass each over a table that carries the hits
so far. Documents are never broadcast, collected or compared with each other.

Defined results: null or empty texts have no words; null items no windows;
repeated items count once by item_id (a null item_id reads as the string
``null``); repeated documents are answered each; empty tables work on either
side; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmcohort.llm.text import ALNUM, Texts, _gram_weights, grams, mix, text_groups
from mmcohort.session import materialize

NGRAM = 10
GRAM = 5
BLOCK_WORDS = 2_000_000  # benchmark words broadcast at once: about 60 MB
_BITS = 20


def _shape(m: int, ngram: int, k: int) -> tuple[int, int, int]:
    """(window words, gram words, grams a window) for an item of m words."""
    if m >= ngram:
        return ngram, k, ngram - k + 1
    g = (m + 1) // 2
    return m, g, m - g + 1


def fingerprints(h: np.ndarray, k: int, w: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are smallest in a window of ``w``
    grams. ``at``: offsets of several texts in ``h``; no gram crosses them."""
    g = grams(h, k)
    if not len(g):
        return np.empty(0, np.int64), g
    top = np.uint64(2**64 - 1)
    if at is not None and k > 1:
        cross = (at[1:-1, None] - np.arange(1, k)[None, :]).ravel()
        g[cross[(cross >= 0) & (cross < len(g))]] = top
    low = g.copy()
    pad = np.full(w - 1, top, np.uint64)
    for j in range(1, w):
        np.minimum(low, np.concatenate([g[j:], pad[:j]])[: len(g)], out=low)
    # place i is kept when some window that begins at i - w + 1 .. i has minimum g[i]
    keep = g == low
    for j in range(1, w):
        keep[j:] |= g[j:] == low[:-j] if j < len(g) else False
    keep &= g != top
    p = np.flatnonzero(keep)
    return p, g[p]


def windows_at(h: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the windows of ``m`` words that begin at ``starts``: those of :func:`grams`."""
    out = np.zeros(len(starts), np.uint64)
    for j, c in enumerate(_gram_weights(m)):
        out += h[starts + j] * c
    return mix(out)


class Block:
    """Fingerprints and windows of some items, ready to be looked up. Equal
    fingerprints, and equal windows of an item, are held once, so repetition
    on either side never multiplies."""

    def __init__(self, items: list[tuple[str, np.ndarray]], ngram: int, k: int):
        self.items = items
        by: dict[tuple, list] = {}
        for i, (_, h) in enumerate(items):
            if len(h):
                shape = _shape(len(h), ngram, k)
                wins = np.unique(grams(h, shape[0]))
                by.setdefault(shape, []).append((fingerprints(h, *shape[1:])[1], wins, np.full(len(wins), i)))
        self.shapes = []
        for shape, parts in by.items():
            f, wins, own = (np.concatenate(x) for x in zip(*parts))
            f = np.unique(f)
            o = np.argsort(wins, kind="stable")
            wins, own = wins[o], own[o]
            maybe = np.zeros(1 << _BITS, bool)
            maybe[f & np.uint64((1 << _BITS) - 1)] = True
            self.shapes.append((shape, f, wins, own, maybe))

    def hits(self, t: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(text, items, places of hit words counted from the text's first)."""
        for (m, k, w), f, wins, own, maybe in self.shapes:
            p, g = fingerprints(t.hash, k, w, t.at)
            s = maybe[g & np.uint64((1 << _BITS) - 1)]
            p, g = p[s], g[s]
            p = p[f[np.minimum(np.searchsorted(f, g), len(f) - 1)] == g]
            if not len(p):
                continue
            # a shared window lies around a fingerprint that both sides have: extend each hit window by window
            doc = np.searchsorted(t.at, p, "right") - 1
            lo, hi = np.maximum(t.at[doc], p - w + 1), np.minimum(p, t.at[doc + 1] - m)
            lo, hi = lo[hi >= lo], hi[hi >= lo]
            around = np.zeros(len(t.hash) + 1, np.int64)
            np.add.at(around, lo, 1)
            np.add.at(around, hi + 1, -1)
            starts = np.flatnonzero(np.cumsum(around[:-1]) > 0)
            found = windows_at(t.hash, starts, m)
            first = np.searchsorted(wins, found, "left")
            ok = wins[np.minimum(first, len(wins) - 1)] == found
            starts, found, first = starts[ok], found[ok], first[ok]
            if not len(starts):
                continue
            doc = np.searchsorted(t.at, starts, "right") - 1
            cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            for u, v in zip(cuts, np.append(cuts[1:], len(doc))):
                d = int(doc[u])
                cover = np.zeros(int(t.at[d + 1] - t.at[d]) + 1, np.int64)
                at = starts[u:v] - t.at[d]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + m, -1)
                x, once = np.unique(found[u:v], return_index=True)
                ranges = [own[i:j] for i, j in zip(first[u:v][once], np.searchsorted(wins, x, "right"))]
                yield d, np.unique(np.concatenate(ranges)), np.flatnonzero(np.cumsum(cover[:-1]) > 0)


def item_words(bench: DataFrame, id_col: str, text_col: str, ngram: int = NGRAM, limit: int = BLOCK_WORDS) -> DataFrame:
    """item_id (as string) and its word hashes; an item of more than ``limit``
    words in parts that overlap by a window but one word, so none is lost."""

    def run(batches):
        step = max(1, limit - ngram + 1)
        for b in batches:
            rows, out = [], []
            row = 0
            for _, _, t in text_groups(b.column(1), ALNUM):
                for i in range(len(t)):
                    h = t.hash[t.at[i] : t.at[i + 1]]
                    parts = [h] if len(h) <= limit else [h[lo : lo + step + ngram - 1] for lo in range(0, len(h) - ngram + 1, step)]
                    out += [x.tobytes() for x in parts]
                    rows += [row] * len(parts)
                    row += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(out, pa.binary())], names=["item_id", "words"])

    src = bench.select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item_id"),
        F.col(f"`{text_col}`").alias("text"),
    )
    return src.mapInArrow(run, "item_id string, words binary")


def blocks(words: DataFrame, limit: int) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The items a bounded block at a time: the driver never holds more."""
    part, size = [], 0
    for r in words.toLocalIterator():
        h = np.frombuffer(bytes(r["words"]), np.uint64)
        if part and size + len(h) > limit:
            yield part
            part, size = [], 0
        part.append((r["item_id"], h))
        size += len(h)
    if part:
        yield part


def scan(
    docs: DataFrame,
    bench: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    ngram: int = NGRAM,
    k: int = GRAM,
    block: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` with ``__n_words``, ``__hit`` (int array: places of hit words)
    and ``__items`` (sorted ids of the items with occurring windows)."""
    spark = docs.sparkSession
    cols = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = cols.index(text_col)

    def one_pass(held, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blk = Block(held.value, ngram, k) if held is not None else None
            for b in batches:
                hit: dict[int, list] = {}
                ids: dict[int, set] = {}
                n = np.zeros(b.num_rows, np.int64)
                for lo, hi, t in text_groups(b.column(at), ALNUM):
                    n[lo:hi] = np.diff(t.at)
                    for d, own, places in blk.hits(t) if blk else ():
                        hit.setdefault(lo + d, []).append(places)
                        ids.setdefault(lo + d, set()).update(blk.items[i][0] for i in own)
                old = [] if first else [b.column(len(cols) + 1), b.column(len(cols) + 2)]
                hits, items = [], []
                for r in range(b.num_rows):
                    got, names = hit.get(r, []), ids.get(r, set())
                    if old:
                        got, names = got + [np.array(old[0][r].as_py(), np.int64)], names | set(old[1][r].as_py())
                    hits.append(np.unique(np.concatenate(got)) if got else [])
                    items.append(sorted(names))
                yield pa.RecordBatch.from_arrays(
                    [
                        *b.columns[: len(cols)],
                        pa.array(n),
                        pa.array(hits, pa.list_(pa.int64())),
                        pa.array(items, pa.list_(pa.string())),
                    ],
                    names=[*cols, "__n_words", "__hit", "__items"],
                )

        return run

    out, first = docs, True
    for part in blocks(item_words(bench, item_col, item_text_col, ngram, max(block, 2 * ngram)), block):
        out = out if first else materialize(out, "hits")
        run = one_pass(spark.sparkContext.broadcast(part), first)
        out = out.mapInArrow(run, f"{schema}, `__n_words` long, `__hit` array<long>, `__items` array<string>")
        first = False
    if first:
        out = out.mapInArrow(
            one_pass(None, True), f"{schema}, `__n_words` long, `__hit` array<long>, `__items` array<string>"
        )
    return out


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return scan(src, bench, "text", **how).select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.size("__hit").cast("long").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        (F.size("__hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, bench: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents (all their columns) without any hit word."""
    return scan(docs, bench, text_col, **how).where(F.size("__hit") == 0).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()

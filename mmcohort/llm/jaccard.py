"""Operator 5: n-gram Jaccard join with a count-vector R-tree.

A document's set holds the hashes of its distinct ``n``-word shingles (fewer
words: the whole sequence as one). Two documents link when
``100 * |A & B| >= percent * |A | B|``.

1. Equal sets are one class (digest of the set): copies, however many, are one
   point from here on.
2. Routing without loss. Linked sets of which the smaller has ``s`` shingles
   differ in at most ``D = s * (100 - percent) / percent`` shingles. Hash space
   is cut in more than D parts, so some part holds the same shingles in both;
   its digest is a routing key that both emit (sizes are banded so that both
   use the same cut; a spare of parts covers parts empty in both, and a set
   with more empty parts than the spare emits its empty parts too). Small sets
   emit their shingles of smallest hash instead (prefix filter). The smallest
   class of a key is its pivot; a pivot's block holds every class that shares a
   key with it, hence every pair that can link lies in some block together.
3. In a block, shingles are hashed into groups; the group counts are points of
   an R-tree whose boxes also hold the range of sizes. The sum of coordinate
   minima bounds the overlap of a query with a box (``GROUPS`` coordinates) or a
   point (``FINE`` of them). Points go to the blocks first, sets follow only for
   classes that some pair of points leaves open; there the tree searches again
   and every pair that survives is verified on the full sets. A pair that lies in
   several blocks belongs to that of the smallest pivot and is looked at there
   only. A block returns, per class, how many documents its links reach, and
   links that span its components; the links themselves, whose number grows
   with the square of a group, stay in the task.
4. Blocks over the bounds below are cut in chunks, and each pair of chunks is a
   cell, but for pairs that belong to another block. Nothing is dropped.
5. Components by alternating star contraction over the narrow links. A node
   is (smallest id, class), so a component's root carries its id. Joins on a
   class or a hub deal its rows over several tasks where they are many, and so
   does the routing with keys that a sample of the classes shows to be common.

Shingles and classes are compared by 64-bit hashes (a chance of about 2**-64
for each pair of different ones to agree).

Defined results: documents without text or words have an empty set and link
with nothing; a null doc_id has no part in any link (component_id null,
n_links 0); repeated rows get the same answer each and count as one document
(a doc_id with several sets counts once for each); empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmcohort.llm import spread
from mmcohort.llm.text import SPACE, Texts, mix, text_groups
from mmcohort.session import materialize, release, settled

SHINGLE = 4
PERCENT = 85
GROUPS = 64
FINE = 256  # coordinates of a point that goes to a cell ahead of the sets; a multiple of GROUPS
LEAF = 16
SMALL = 100  # sets below this size are routed by prefix
CELL_DOCS = 2048  # classes, and
CELL_SHINGLES = 1_500_000  # shingles, in a cell (about 12 MB)
FILTER_BITS = 1 << 23  # bit map of documents: 1 MB
SAMPLED = 256  # one class in so many shows its keys beforehand, and
HOT_KEY = 1 << 20  # a key of more classes than this, by that sample, is dealt over several tasks
LOST_BROADCAST = 1 << 21  # ids that are broadcast to be dropped (16 MB)
_U32 = np.uint64(32)
_SALT = np.uint64(0x5851F42D4C957F2D)


class Sets:
    """Shingle sets of some texts: ``h[at[i]:at[i+1]]`` sorted and distinct."""

    def __init__(self, t: Texts, n: int):
        words = np.diff(t.at)
        size = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
        g = np.zeros(max(0, len(t.hash) - n + 1), np.uint64)
        weights = np.cumprod(np.full(n, np.uint64(0xA24BAED4963EE407), dtype=np.uint64))
        for j in range(n):
            g += t.hash[j : j + len(g)] * weights[j]
        g = mix(g)
        at = np.concatenate([[0], np.cumsum(size)])
        first = np.repeat(t.at[:-1], size) + (np.arange(at[-1]) - np.repeat(at[:-1], size))
        short = np.flatnonzero((words > 0) & (words < n))
        ok = np.repeat(words >= n, size)
        h = np.zeros(at[-1], np.uint64)
        h[ok] = g[first[ok]]
        for i in short:
            w = t.hash[t.at[i] : t.at[i + 1]]
            h[at[i]] = mix((w * weights[: len(w)]).sum(keepdims=True) + np.uint64(len(w)))[0]
        for a, b in zip(at[:-1], at[1:]):
            h[a:b].sort()
        keep = np.ones(len(h), bool)
        keep[1:] = h[1:] != h[:-1]
        keep[at[:-1][size > 0]] = True
        self.h = h[keep]
        self.n = np.add.reduceat(keep, at[:-1][size > 0], dtype=np.int64) if len(h) else np.empty(0, np.int64)
        full = np.zeros(len(size), np.int64)
        full[size > 0] = self.n
        self.n = full
        self.at = np.concatenate([[0], np.cumsum(full)])
        self.cls = np.zeros(len(size), np.uint64)
        some = full > 0
        if some.any():
            sums = np.add.reduceat(mix(self.h ^ _SALT), self.at[:-1][some])
            self.cls[some] = mix(sums + full[some].astype(np.uint64))
        self.cls = self.cls.view(np.int64)


class Bands:
    """Size bands [low, high) with the cut of hash space each uses."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.parts, self.spare = [], [], []
        lo = SMALL
        while lo < 1 << 40:
            hi = lo * 13 // 10
            d = (hi - 1) * (100 - percent) // percent
            spare = 0
            for _ in range(50):  # empty parts of the band's smallest sets, and five deviations
                p = d + 1 + spare
                m = p * np.exp(-lo / p)
                more = int(np.ceil(m + 5 * np.sqrt(m)))
                if more <= spare:
                    break
                spare = min(more, d + 1)
            self.low.append(lo)
            self.parts.append(d + 1 + spare)
            self.spare.append(spare)
            lo = hi
        self.low = np.array(self.low)
        self.parts, self.spare = np.array(self.parts), np.array(self.spare)

    def keys(self, s: Sets, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) for some rows of ``s``."""
        n = s.n[rows]
        out_r, out_k = [], []
        p = self.percent
        # prefix: the smaller set is below SMALL, the larger at most 100 / percent of that
        small = rows[(n * p <= (SMALL - 1) * 100) & (n * (100 - p) >= p)]
        if len(small):
            m = s.n[small]
            length = m - -(-m * p // 100) + 1
            pos = np.repeat(s.at[small], length) + (np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length))
            out_r.append(np.repeat(small, length))
            out_k.append(mix(s.h[pos] ^ np.uint64(0x2545F4914F6CDD1D)))
        big = rows[n >= SMALL]
        if len(big):
            own = np.searchsorted(self.low, s.n[big], "right") - 1
            self._part_keys(s, big, own, out_r, out_k)
            # the band below holds smaller partners: its largest size times 100 / percent reaches this one
            lower = (own > 0) & ((self.low[own] - 1) * 100 >= p * s.n[big])
            if lower.any():
                self._part_keys(s, big[lower], own[lower] - 1, out_r, out_k)
        if not out_r:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(out_r), np.concatenate(out_k).view(np.int64)

    def _part_keys(self, s: Sets, rows, band, out_r, out_k) -> None:
        n = s.n[rows]
        pos = np.repeat(s.at[rows], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        h = s.h[pos]
        which = np.repeat(np.arange(len(rows)), n)
        cut = self.parts[band]
        part = ((h >> _U32) * np.repeat(cut, n).astype(np.uint64)) >> _U32
        edge = np.ones(len(h), bool)
        edge[1:] = (part[1:] != part[:-1]) | (which[1:] != which[:-1])
        at = np.flatnonzero(edge)
        sums = np.add.reduceat(mix(h ^ _SALT), at)
        tag = (band[which[at]].astype(np.uint64) << np.uint64(44)) + part[at] + np.uint64(1)
        out_r.append(rows[which[at]])
        out_k.append(mix(sums + mix(tag)))
        filled = np.bincount(which[at], minlength=len(rows))
        for i in np.flatnonzero(cut - filled > self.spare[band]):
            mine = part[at][which[at] == i]
            empty = np.setdiff1d(np.arange(cut[i], dtype=np.uint64), mine)
            out_r.append(np.full(len(empty), rows[i]))
            out_k.append(mix(mix((np.uint64(int(band[i])) << np.uint64(44)) + empty + np.uint64(1)) ^ np.uint64(7)))


class RTree:
    """Boxes over count vectors: per node the coordinate maxima and size range."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, leaf: int = LEAF, rows: np.ndarray | None = None):
        self.counts, self.sizes, self.leaf = counts, sizes, leaf
        self.nodes: list[tuple] = []  # (maxima, smallest size, largest size, children or rows)
        rows = np.arange(len(sizes)) if rows is None else rows  # those the tree holds
        self.root = self._build(rows[np.argsort(sizes[rows], kind="stable")], 0) if len(rows) else None

    def _build(self, rows: np.ndarray, depth: int) -> int:
        box = (self.counts[rows].max(0), int(self.sizes[rows].min()), int(self.sizes[rows].max()))
        if len(rows) <= self.leaf:
            self.nodes.append((*box, None, rows))
            return len(self.nodes) - 1
        if depth % 3:  # by the widest coordinate; every third level by size
            c = self.counts[rows]
            rows = rows[np.argsort(c[:, int(np.argmax(c.max(0) - c.min(0)))], kind="stable")]
        else:
            rows = rows[np.argsort(self.sizes[rows], kind="stable")]
        half = len(rows) // 2
        kids = (self._build(rows[:half], depth + 1), self._build(rows[half:], depth + 1))
        self.nodes.append((*box, kids, None))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query row, rows whose bound allows a link), for rows of the tree."""
        stack = [(self.root, queries)]
        while stack:
            node, q = stack.pop()
            top, small, large, kids, rows = self.nodes[node]
            n = self.sizes[q]
            q = q[(n * percent <= large * 100) & (small * percent <= n * 100)]
            if not len(q):
                continue
            n = self.sizes[q]
            least = np.maximum(small, -(-n * percent // 100))  # a partner's size, at least
            bound = np.minimum(self.counts[q], top).sum(1, dtype=np.int64)
            q = q[bound * (100 + percent) >= percent * (n + least)]
            if not len(q):
                continue
            if kids:
                stack += [(k, q) for k in kids]
                continue
            overlap = np.minimum(self.counts[q][:, None, :], self.counts[rows][None]).sum(2, dtype=np.int64)
            ok = overlap * (100 + percent) >= percent * (self.sizes[q][:, None] + self.sizes[rows][None])
            for i in np.flatnonzero(ok.any(1)):
                yield int(q[i]), rows[ok[i]]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact on sorted distinct shingle hashes."""
    if len(a) > len(b):
        a, b = b, a
    i = np.searchsorted(b, a)
    both = int((b[np.minimum(i, len(b) - 1)] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


class Block:
    """Some classes of a block: ``side`` 2 where all pairs are to be looked at,
    else pairs of a class of side 0 and one of side 1. ``pivots`` are those of
    all blocks a class is in. ``counts`` and ``size`` are the tree's points."""

    def __init__(self, pivot: int, ids: list[int], sides: list[int], pivots: list[np.ndarray]):
        self.ids, self.side = np.array(ids, np.int64), np.array(sides)
        # pairs that share a smaller pivot belong to that block
        self.before = [x[x < pivot].tolist() for x in pivots]
        members: dict[int, list[int]] = {}
        for i, x in enumerate(self.before):
            for p in x:
                members.setdefault(p, []).append(i)
        self.members = {p: np.array(x) for p, x in members.items()}

    def passing(self, q: int, rows: np.ndarray, percent: int) -> np.ndarray:
        """Those of ``rows`` that pass the test of the pair with ``q``."""
        raise NotImplementedError

    def pairs(self, percent: int) -> Iterator[tuple[int, np.ndarray]]:
        """(row, rows that pass with it), each pair of rows once."""
        whole = self.side[0] == 2
        tree = RTree(self.counts, self.size, rows=np.flatnonzero(self.side != 0))
        if whole:
            groups = [rows for *_, kids, rows in tree.nodes if kids is None]
        else:
            left = np.flatnonzero(self.side == 0)
            left = left[np.argsort(self.size[left], kind="stable")]
            groups = [left[i : i + LEAF] for i in range(0, len(left), LEAF)]
        if tree.root is None:
            return
        for queries in groups:
            found: dict[int, list[np.ndarray]] = {}
            for q, rows in tree.search(queries, percent):
                found.setdefault(q, []).append(rows)
            for q, parts in found.items():
                rows = np.concatenate(parts)
                if whole:
                    rows = rows[rows > q]
                if self.before[q]:
                    mine = np.ones(len(self.ids), bool)
                    for p in self.before[q]:
                        mine[self.members[p]] = False
                    rows = rows[mine[rows]]
                rows = self.passing(q, rows, percent) if len(rows) else rows
                if len(rows):
                    yield q, rows


class Points(Block):
    """Classes of a cell by their points alone: ``fine`` holds ``FINE`` counts a row."""

    def __init__(self, pivot: int, ids: list[int], sides: list[int], fine: np.ndarray, pivots: list[np.ndarray]):
        super().__init__(pivot, ids, sides, pivots)
        self.fine, self.size = fine, fine.sum(1, dtype=np.int64)
        self.counts = fine.reshape(len(fine), -1, GROUPS).sum(1)
        self.open = np.zeros(len(fine), bool)

    def passing(self, q: int, rows: np.ndarray, percent: int) -> np.ndarray:
        if self.open[q]:  # only whether a class has any open pair matters
            rows = rows[~self.open[rows]]
        overlap = np.minimum(self.fine[q], self.fine[rows]).sum(1, dtype=np.int64)
        return rows[overlap * (100 + percent) >= percent * (self.size[q] + self.size[rows])]

    def survivors(self, percent: int) -> np.ndarray:
        """Rows of classes that the bound leaves a partner."""
        for q, rows in self.pairs(percent):
            self.open[q] = self.open[rows] = True
        return np.flatnonzero(self.open)


class Cell(Block):
    """Classes of a cell with their sets: ``weight`` is a class's number of
    documents, ``low`` the smallest of their ids."""

    def __init__(self, pivot: int, ids: list[int], sides: list[int], weights: list[int], lows: list[int], sets: list[np.ndarray], pivots: list[np.ndarray]):
        super().__init__(pivot, ids, sides, pivots)
        self.weight, self.low = np.array(weights, np.int64), np.array(lows, np.int64)
        self.size = np.array([len(x) for x in sets])
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        flat = np.concatenate(sets)
        self.counts = np.bincount(
            np.repeat(np.arange(len(sets)) * GROUPS, self.size) + (flat & np.uint64(GROUPS - 1)).astype(np.int64),
            minlength=GROUPS * len(sets),
        ).reshape(-1, GROUPS).astype(np.int32)
        self.flat = np.unique(flat, return_inverse=True)[1]
        self.mark = np.zeros(len(flat), np.int32)

    def overlap(self, q: int, rows: np.ndarray) -> np.ndarray:
        own = self.flat[self.at[q] : self.at[q + 1]]
        self.mark[own] = 1
        if 2 * len(rows) > len(self.size):
            both = np.add.reduceat(self.mark[self.flat], self.at[:-1])[rows]
        else:
            n = self.size[rows]
            start = np.cumsum(n) - n
            both = np.add.reduceat(self.mark[self.flat[np.repeat(self.at[rows] - start, n) + np.arange(n.sum())]], start)
        self.mark[own] = 0
        return both

    def passing(self, q: int, rows: np.ndarray, percent: int) -> np.ndarray:
        both = self.overlap(q, rows)
        return rows[100 * both >= percent * (self.size[q] + self.size[rows] - both)]

    def links(self, percent: int) -> tuple[np.ndarray, ...]:
        """(class, its smallest id, the class of smallest id in its component in
        the cell, that id, documents its links in the cell reach) for classes
        that have any."""
        order = np.lexsort((self.ids, self.low))
        comp, reach = np.argsort(order), np.zeros(len(self.ids), np.int64)
        for q, rows in self.pairs(percent):
            reach[q] += self.weight[rows].sum()
            reach[rows] += self.weight[q]
            if (comp[rows] != comp[q]).any():
                join = np.unique(np.append(comp[rows], comp[q]))
                comp[np.isin(comp, join)] = join[0]
        some = reach > 0
        root = order[comp[some]]
        return self.ids[some], self.low[some], self.ids[root], self.low[root], reach[some]


def memberships(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, cls: each row's set size and class; and the routing
    keys of one class in SAMPLED (else null)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        bands = Bands(percent)
        for b in batches:
            valid = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, t in text_groups(b.column(1), SPACE):
                s = Sets(t, n)
                keys: list = [None] * (hi - lo)
                for i in np.flatnonzero((s.cls.view(np.uint64) % np.uint64(SAMPLED) == 0) & (s.n > 0) & valid[lo:hi]):
                    keys[i] = bands.keys(s, np.array([i]))[1].tolist()
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(s.n), pa.array(s.cls), pa.array(keys, schema.field("keys").type)], schema=schema
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, cls long, keys array<long>")


def hot_keys(members: DataFrame) -> DataFrame:
    """key, parts: keys that the sampled classes show to be very common, and
    over how many tasks each is dealt."""
    some = members.where("keys is not null").select("cls", F.explode(F.array_distinct("keys")).alias("key")).distinct()
    counts = some.groupBy("key").agg((F.count(F.lit(1)) * SAMPLED).alias("n")).where(F.col("n") > HOT_KEY)
    return counts.select("key", F.ceil(F.col("n") / HOT_KEY).cast("long").alias("parts"))


def routes(docs: DataFrame, n: int, percent: int, hot: dict[int, int]) -> DataFrame:
    """key, part, cls: routing keys, each class once a task; ``part`` deals the
    classes of a key in ``hot`` (key -> parts), else 0."""
    names, parts = np.array(sorted(hot), np.int64), np.array([hot[k] for k in sorted(hot)], np.int64)
    held = docs.sparkSession.sparkContext.broadcast((names, parts))  # keys of more than HOT_KEY classes

    def run(batches):
        bands, seen = Bands(percent), set()
        names, parts = held.value
        for b in batches:
            valid = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            for lo, hi, t in text_groups(b.column(1), SPACE):
                s = Sets(t, n)
                rows = []
                for i in np.flatnonzero((s.n > 0) & valid[lo:hi]):
                    c = int(s.cls[i])
                    if c not in seen:
                        seen.add(c)
                        rows.append(i)
                if len(seen) > 1_000_000:
                    seen.clear()
                r, k = bands.keys(s, np.array(rows, np.int64))
                if not len(r):
                    continue
                cls, part = s.cls[r], np.zeros(len(r), np.int32)
                if len(names):
                    at = np.minimum(np.searchsorted(names, k), len(names) - 1)
                    is_hot = names[at] == k
                    part[is_hot] = mix(cls[is_hot].view(np.uint64)) % parts[at[is_hot]].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part), pa.array(cls)], names=["key", "part", "cls"])

    return docs.mapInArrow(run, "key long, part int, cls long")


def shared_blocks(keys: DataFrame, hot: dict[int, int]) -> DataFrame:
    """pivot, cls: with each key that several classes have, the smallest of
    them and each of them, itself too. The keys are sorted once and streamed:
    a task holds no more than a batch, however common a key is. The parts of a
    hot key find pivots of their own, whose smallest is then the key's."""
    names = np.array(sorted(hot), np.int64)

    def run(batches):
        last, pivot, open_ = None, 0, False  # the key at the end of the former batch, its pivot, and whether it is emitted
        for b in batches:
            if not b.num_rows:
                continue
            key, part, cls = (b.column(i).to_numpy() for i in range(3))
            begin = np.ones(len(key), bool)
            begin[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
            goes_on = last == (key[0], part[0])
            begin[0] = not goes_on
            starts = np.flatnonzero(begin)
            run_of = np.cumsum(begin) - 1  # -1: the former batch's run
            first = cls[starts] if len(starts) else np.empty(0, np.int64)
            own = np.where(run_of >= 0, first[np.maximum(run_of, 0)] if len(first) else pivot, pivot)
            size = np.bincount(run_of + 1, minlength=len(starts) + 1)
            several = np.zeros(len(starts) + 1, bool)
            differ = cls != own
            np.logical_or.at(several, run_of + 1, differ)
            if goes_on:
                several[0] |= open_
            if len(names):
                several[1:] |= np.isin(key[starts], names)
            pick = several[run_of + 1]
            # the last run may go on: what it has so far waits only if it is one class alone
            late = [] if not (goes_on and several[0] and not open_) else [(last[0], pivot, pivot)]
            out = [key[pick], own[pick], cls[pick]]
            if late:
                out = [np.append(x, [v]) for x, v in zip(out, late[0])]
            if len(starts):
                last, pivot, open_ = (key[-1], part[-1]), first[-1], bool(several[-1])
            else:
                open_ = bool(several[0])
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in out], names=["key", "pivot", "cls"])

    found = keys.repartition("key", "part").sortWithinPartitions("key", "part", "cls").mapInArrow(run, "key long, pivot long, cls long")
    if not hot:
        return found.select("pivot", "cls").distinct()
    found = materialize(found, "parts")
    own = found.where(F.col("key").isin([int(k) for k in names]))
    top = own.groupBy("key", "pivot").agg(F.count(F.lit(1)).alias("__n"))
    tops = top.join(top.groupBy("key").agg(F.min("pivot").alias("top")), "key").select("key", "pivot", "top")  # parts of hot keys
    moved = own.join(F.broadcast(tops), ["key", "pivot"]).select(F.col("top").alias("pivot"), "cls")
    lone = moved.groupBy("pivot").agg(F.max("cls").alias("__x")).where(F.col("__x") == F.col("pivot")).select("pivot")
    moved = moved.join(lone, "pivot", "left_anti")
    return found.where(~F.col("key").isin([int(k) for k in names])).select("pivot", "cls").unionByName(moved).distinct()


def _bit(c: str):
    """1 .. FILTER_BITS, as the bitmap functions count"""
    return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1


def _bit_map(ids: DataFrame):
    """A broadcast bit map of fixed size that holds the ids in ``ids`` (doc_id)."""
    maps = (
        ids.select(_bit("doc_id").alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("b"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
        .collect()  # at most FILTER_BITS / 8 bytes
    )
    bits = np.zeros(FILTER_BITS, bool)
    for r in maps:
        lo = (r["b"] - 1) * 32768
        got = np.unpackbits(np.frombuffer(bytes(r["m"]), np.uint8), bitorder="little")
        bits[lo : lo + len(got)] |= got[: max(0, FILTER_BITS - lo)].astype(bool)
    return ids.sparkSession.sparkContext.broadcast(np.packbits(bits))


def _of_some(docs: DataFrame, reps: DataFrame, n: int, schema: str, column) -> DataFrame:
    """cls and ``column(sets, rows)`` of the documents in ``reps`` (doc_id, and a
    few others: the documents are sieved by a bit map of fixed size). A class
    may come from several tasks."""
    held = _bit_map(reps)

    def run(batches):
        want = np.unpackbits(held.value).astype(bool)
        seen: set[int] = set()
        for b in batches:
            pick = np.flatnonzero(want[b.column(0).to_numpy(zero_copy_only=False) - 1])
            for _, _, t in text_groups(b.column(1).take(pa.array(pick)), SPACE):
                s = Sets(t, n)
                rows = []
                for i in np.flatnonzero(s.n):
                    if int(s.cls[i]) not in seen:
                        seen.add(int(s.cls[i]))
                        rows.append(i)
                if rows:
                    name, values = column(s, rows)
                    yield pa.RecordBatch.from_arrays([pa.array(s.cls[rows]), values], names=["cls", name])

    src = docs.where(F.col("doc_id").isNotNull()).select(_bit("doc_id").alias("p"), "text")
    return src.mapInArrow(run, schema)


def needed_sets(docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """cls, shingles."""

    def column(s: Sets, rows: list[int]):
        off = np.concatenate([[0], np.cumsum(s.n[rows])]).astype(np.int32)
        flat = np.concatenate([s.h[s.at[i] : s.at[i + 1]] for i in rows]).view(np.int64)
        return "shingles", pa.ListArray.from_arrays(pa.array(off), pa.array(flat))

    return _of_some(docs, reps, n, "cls long, shingles array<long>", column)


def needed_points(docs: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """cls, point: ``FINE`` group counts, each in as few bytes as the largest needs."""

    def column(s: Sets, rows: list[int]):
        points = []
        for i in rows:
            c = np.bincount((s.h[s.at[i] : s.at[i + 1]] & np.uint64(FINE - 1)).astype(np.int64), minlength=FINE)
            points.append(c.astype(np.min_scalar_type(int(c.max()))).tobytes())
        return "point", pa.array(points, pa.binary())

    return _of_some(docs, reps, n, "cls long, point binary", column)


def _counts(point: bytes) -> np.ndarray:
    return np.frombuffer(point, f"u{len(point) // FINE}").astype(np.int32)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """Copies, so that a cell does not keep whole batches."""
    off, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b].copy() for a, b in zip(off, off[1:])]


def _by_cell(df: DataFrame, cols: list[str], held: list[str], unpack, found, out: str) -> DataFrame:
    """``found(cell, pivot, columns)`` (a record batch or None) of every cell of
    more than one class, ``columns`` the values of ``held`` in order, the last
    ones through ``unpack`` (name -> function of an Arrow column). A class that
    came twice to a cell counts once."""

    def run(batches):
        now, last, rows = None, None, tuple([] for _ in held)

        def close():
            if len(rows[0]) > 1:
                got = found(now[0], now[1], rows)
                if got is not None:
                    yield got

        for b in batches:
            cell, pivot, cls = (b.column(i).to_pylist() for i in range(3))
            values = [unpack.get(c, lambda x: x.to_pylist())(b.column(cols.index(c))) for c in held]
            for i in range(b.num_rows):
                if (cell[i], pivot[i]) != now:
                    yield from close()
                    now, last, rows = (cell[i], pivot[i]), None, tuple([] for _ in held)
                if cls[i] == last:
                    continue
                last = cls[i]
                for x, v in zip(rows, values):
                    x.append(v[i])
        yield from close()

    return df.select(*cols).repartition("cell").sortWithinPartitions("cell", "pivot", "cls").mapInArrow(run, out)


def survivors(df: DataFrame, percent: int) -> DataFrame:
    """cell, pivot, cls, side: the classes that the points of their cell leave a possible partner."""

    def found(cell, pivot, rows):
        ids, sides, points, pivots = rows
        left = Points(pivot, ids, sides, np.stack([_counts(p) for p in points]), pivots).survivors(percent)
        if not len(left):
            return None
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(left), cell)),
                pa.array(np.full(len(left), pivot)),
                pa.array(np.array(ids, np.int64)[left]),
                pa.array(np.array(sides, np.int32)[left]),
            ],
            names=["cell", "pivot", "cls", "side"],
        )

    cols = ["cell", "pivot", "cls", "side", "point", "pivots"]
    return _by_cell(df, cols, ["cls", "side", "point", "pivots"], {"pivots": _lists}, found, "cell long, pivot long, cls long, side int")


def _cells(df: DataFrame, percent: int) -> DataFrame:
    """src, src_low, dst, dst_low, reach: per cell and linked class (see ``Cell.links``)."""
    schema = pa.schema([(c, pa.int64()) for c in ("src", "src_low", "dst", "dst_low", "reach")])

    def found(cell, pivot, rows):
        links = Cell(pivot, *rows).links(percent)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in links], schema=schema) if len(links[0]) else None

    cols = ["cell", "pivot", "cls", "side", "k", "low", "shingles", "pivots"]
    sets = lambda column: [x.view(np.uint64) for x in _lists(column)]
    out = "src long, src_low long, dst long, dst_low long, reach long"
    return _by_cell(df, cols, ["cls", "side", "k", "low", "shingles", "pivots"], {"shingles": sets, "pivots": _lists}, found, out)


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of (src, dst) that is not its component's
    smallest: alternating star contraction. Only such pairs move; each round
    is written, so a lost executor costs a part of one round. The neighbours of
    a node that has very many are dealt over several tasks."""
    e = links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct()
    e = materialize(e, "links")
    many = F.count(F.lit(1)).alias("__n")

    def joined(rows, per_node):
        if hub:
            return spread.spread_join(rows, per_node, "u", ["v"], "__n")
        return rows.join(per_node.drop("__n"), "u")

    while True:
        # done when no node hangs from two, and none that others hang from hangs itself
        roles = e.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up")))
        roles = roles.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("root"), many)
        open_ = F.col("ups").isNotNull() & ((F.col("ups") > 1) | ((F.col("ups") == 1) & (F.col("root") == 0)))
        left, degree = roles.agg(F.count_if(open_), F.max("__n")).first()
        if not left:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        hub = degree > spread.ROWS
        # large star: a node's greater neighbours, and itself, join its smallest neighbour
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), many)
        big = joined(both, low).select(F.greatest("u", "v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours join the smallest of them
        big = big.where("u <> v").distinct()
        big = materialize(big, "stars") if hub else big.repartition("u")
        least = big.groupBy("u").agg(F.min("v").alias("m"), many)
        small = joined(big, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(e, "stars")


def without_contained(pairs: DataFrame) -> DataFrame:
    """Blocks (pivot, cls, inside) but those contained in the block of the
    smallest pivot that their own pivot is a member of: every pair of a dropped
    block is in that one, or, where it is dropped too, in the next. ``inside``:
    the class is in that block too, so pairs of two such belong elsewhere."""
    up = pairs.where("pivot < cls").groupBy("cls").agg(F.min("pivot").alias("over")).withColumnRenamed("cls", "pivot")
    sizes = materialize(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("size")).join(up, "pivot", "left"), "block-sizes")
    placed = materialize(spread.spread_join(pairs, sizes, "pivot", ["cls"], "size"), "placed")
    held = placed.where("over is not null")
    inside = pairs.select(F.col("pivot").alias("over"), "cls")
    outside = materialize(held.join(inside, ["over", "cls"], "left_anti").select("pivot", "cls"), "outside")
    part = outside.groupBy("pivot").agg(F.count(F.lit(1)).alias("out"))
    kept = sizes.where("over is not null").join(part, "pivot").select("pivot", "size")  # blocks not contained in another
    top = placed.where("over is null").select("pivot", "cls", F.lit(False).alias("inside"))
    both = spread.spread_join(held.select("pivot", "cls"), kept, "pivot", ["cls"], "size").withColumn("o", F.lit(1)).unionByName(
        outside.withColumn("o", F.lit(0))
    )
    both = both.groupBy("pivot", "cls").agg((F.min("o") == 1).alias("inside"))
    return top.unionByName(both)


def chunked(pairs: DataFrame, used: DataFrame) -> DataFrame:
    """cell, pivot, cls, side: every pair of a block's classes in one cell, but
    for pairs of two ``inside`` ones."""
    sized = pairs.join(used.select("cls", "n"), "cls")

    def chunks(own):
        n = F.sum(F.when(own, F.col("n")))
        return F.greatest(F.ceil(F.count_if(own) / CELL_DOCS), F.ceil(F.coalesce(n, F.lit(0)) / CELL_SHINGLES)).cast("long")

    cut = sized.groupBy("pivot").agg(chunks(~F.col("inside")).alias("a"), chunks(F.col("inside")).alias("b"), F.count(F.lit(1)).alias("size"))
    dealt = spread.spread_join(pairs, cut, "pivot", ["cls"], "size").withColumn(
        "c", F.pmod(F.xxhash64("cls"), F.when(F.col("inside"), F.col("b")).otherwise(F.col("a")))
    )
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    cell = lambda lo, hi, side: F.struct(lo.alias("lo"), hi.alias("hi"), side.cast("int").alias("side"))
    c, a, b = F.col("c"), F.col("a"), F.col("b")
    mixed = lambda x: a + x  # noqa: E731  chunks of inside classes are numbered after the others
    with_out = F.transform(
        upto(a), lambda x: cell(F.least(c, x), F.greatest(c, x), F.when(x == c, 2).when(c < x, 0).otherwise(1))
    )
    with_in = F.transform(upto(b), lambda x: cell(c, mixed(x), F.lit(0)))
    from_in = F.transform(upto(a), lambda x: cell(x, mixed(c), F.lit(1)))
    at = F.explode(F.when(F.col("inside"), from_in).otherwise(F.concat(with_out, with_in))).alias("at")
    return dealt.select("pivot", "cls", at).select(
        F.xxhash64("pivot", "at.lo", "at.hi").alias("cell"), "pivot", "cls", F.col("at.side").alias("side")
    )


def join_classes(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """cls, low, root, reach, k: the component of each class — its smallest id
    and the class that has it —, the documents that one of the class's
    documents links with, and how many rows the class has."""
    hot = {r["key"]: r["parts"] for r in hot_keys(members).collect()}  # keys of more than HOT_KEY classes
    # a pair of different classes at least: the pivot is always among the members of its block
    shares = materialize(shared_blocks(routes(docs, n, percent, hot), hot), "shares")
    release(docs.sparkSession)  # the keys, by far the largest shuffle
    pairs = materialize(without_contained(shares), "blocks")
    once = members.where("n_shingles > 0 and doc_id is not null").groupBy("cls", "doc_id").agg(
        F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows")
    )
    classes = materialize(
        once.groupBy("cls").agg(F.min("doc_id").alias("low"), F.max("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("rows").alias("rows")), "classes"
    )
    of = pairs.groupBy("cls").agg(F.collect_list("pivot").alias("pivots"))  # no more than a set has keys
    used = materialize(classes.join(of, "cls"), "used")
    points = needed_points(docs, used.select(F.col("low").alias("doc_id")), n).join(used.select("cls", "pivots"), "cls")
    left = materialize(survivors(chunked(pairs, used).join(points, "cls"), percent), "survivors")
    open_ = materialize(used.join(left.select("cls").distinct(), "cls").select("cls", "k", "low", "pivots"), "open")
    sets = needed_sets(docs, open_.select(F.col("low").alias("doc_id")), n).join(open_, "cls")
    links = materialize(_cells(left.join(sets, "cls"), percent), "links")
    # a node is a class, ordered by its smallest id: the root of a component has the component's
    node = lambda low, cls: F.struct(F.col(low).alias("low"), F.col(cls).alias("cls"))
    stars = components(links.select(node("src_low", "src").alias("src"), node("dst_low", "dst").alias("dst")))
    none = F.lit(None).cast("long")
    found = (
        stars.select(F.col("node.cls").alias("cls"), "root.low", F.col("root.cls").alias("root"), F.lit(0).cast("long").alias("reach"), none.alias("rows"))
        .unionByName(links.select(F.col("src").alias("cls"), none.alias("low"), none.alias("root"), "reach", none.alias("rows")))
        .unionByName(classes.select("cls", none.alias("low"), none.alias("root"), (F.col("k") - 1).alias("reach"), "rows"))
    )
    found = found.groupBy("cls").agg(
        F.max("low").alias("low"), F.coalesce(F.max("root"), F.col("cls")).alias("root"), F.sum("reach").alias("reach"), F.max("rows").alias("rows")
    )
    return found.join(classes.select("cls", F.col("low").alias("__own")), "cls").select(
        "cls", F.coalesce("low", "__own").alias("low"), "root", "reach", "rows"
    )


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable),
    n_links (other documents it links with), cls (of its set), root (the class
    that the component is named after; null without words or id)."""
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    members = materialize(memberships(src, n, percent), "members")
    found = settled(docs.sparkSession, "classes", lambda: join_classes(src, members, n, percent))
    rows = members.select("doc_id", "n_shingles", "cls")
    has = F.col("n_shingles").isNotNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    linked_ = spread.spread_join(rows.where(has), found, "cls", ["doc_id"], "rows", "left").select(
        "doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"), F.coalesce("reach", F.lit(0)).cast("long").alias("n_links"), "cls", "root"
    )
    alone = rows.where(~has).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), "cls", F.lit(None).cast("long").alias("root")
    )
    return linked_.unionByName(alone)


def _without(docs: DataFrame, lost: DataFrame, id_col: str) -> DataFrame:
    """The documents whose id is not in ``lost`` (doc_id, distinct). Texts are
    not shuffled: few ids are broadcast; of more, a bit map of fixed size tells
    the documents that may be among them, and only those meet the ids."""
    if lost.count() <= LOST_BROADCAST:
        return docs.join(F.broadcast(lost.withColumnRenamed("doc_id", "__lost")), F.col(f"`{id_col}`") == F.col("__lost"), "left_anti")
    held = _bit_map(lost)
    named = docs.withColumn("__bit", F.coalesce(_bit(f"`{id_col}`"), F.lit(1)))
    at = len(docs.columns)

    def sieve(maybe: bool):
        def run(batches):
            want = np.unpackbits(held.value).astype(bool)
            for b in batches:
                hit = want[b.column(at).to_numpy() - 1] & b.column(b.schema.get_field_index(id_col)).is_valid().to_numpy(zero_copy_only=False)
                yield b.filter(pa.array(hit == maybe)).drop_columns(["__bit"])

        return named.mapInArrow(run, docs.schema)

    rest = sieve(True).join(lost.withColumnRenamed("doc_id", "__lost"), F.col(f"`{id_col}`") == F.col("__lost"), "left_anti")
    return sieve(False).unionByName(rest)


def keep_one(
    docs: DataFrame, joined: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One document (all its columns) of each component: that of the smallest
    doc_id. ``joined``: :func:`join` of the documents with the same ``n`` and
    ``percent``. Documents with a null id stay. Rows that share an id are told
    apart by their sets: a row goes if its own component has a smaller id; of
    the rows of one id in one component that with the smallest (class, digest
    of the text, hash of all columns) stays, of rows without words one of each
    text, of rows equal in all columns one."""
    joined = materialize(joined.where("doc_id is not null").select("doc_id", "component_id", "cls", "root"), "joined")
    twice = joined.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__k")).where("__k > 1").select("doc_id")
    twice = materialize(twice, "twice")
    lost = materialize(joined.where("component_id <> doc_id").select("doc_id").unionByName(twice).distinct(), "lost")
    kept = _without(docs, lost, id_col)
    if not twice.head(1):
        return kept
    ids = F.col(f"`{id_col}`").cast("long")
    same = docs.join(twice.withColumnRenamed("doc_id", "__twice"), ids == F.col("__twice"), "left_semi")
    narrow = same.select(ids.alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # each row's class, from its own text, and the decision of (id, class)
    whole = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns])
    digest = F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    told = same.withColumn("__digest", digest).withColumn("__whole", whole)
    cls = _classes_of(narrow.withColumn("__digest", F.md5(F.coalesce("text", F.lit("")))), n)
    decided = joined.where("component_id = doc_id").select("doc_id", "cls", "root").distinct().join(cls, ["doc_id", "cls"])
    group = F.coalesce(F.col("root").cast("string"), F.col("__digest"))
    decided = decided.select(F.col("doc_id").alias("__id"), F.col("__digest").alias("__of"), group.alias("__group"), F.col("cls").alias("__cls")).distinct()
    placed = told.join(decided, (ids == F.col("__id")) & (F.col("__digest") == F.col("__of")))
    best = placed.groupBy("__id", "__group").agg(F.min(F.struct("__cls", "__digest", "__whole")).alias("__best"))
    best = best.select(F.col("__id").alias("__i"), F.col("__group").alias("__g"), "__best")
    chosen = placed.join(
        best, (F.col("__id") == F.col("__i")) & (F.col("__group") == F.col("__g")) & (F.struct("__cls", "__digest", "__whole") == F.col("__best"))
    )
    return kept.unionByName(chosen.select(*[F.col(f"`{c}`") for c in docs.columns]).dropDuplicates())


def _classes_of(rows: DataFrame, n: int) -> DataFrame:
    """doc_id, __digest, cls: distinct, of rows (doc_id, text, __digest)."""

    def run(batches):
        for b in batches:
            for lo, hi, t in text_groups(b.column(1), SPACE):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(Sets(t, n).cls)], names=["doc_id", "__digest", "cls"]
                )

    return rows.select("doc_id", "text", "__digest").mapInArrow(run, "doc_id long, __digest string, cls long").distinct()

"""Operator 1: nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, smallest hashes of
their ids) and every vector is filed in a leaf. A query walks the tree best bin
first: a priority queue holds the branches not taken, by distance to their
centres, and the nearest is opened next; this orders the leaves for the query.
How many of them are visited is calibrated: for ``CALIBRATION`` vectors the
true neighbours are found by a full scan, and the visits are widened until
their leaves hold the share ``RECALL`` of these. Distances in the visited
leaves are exact, in double precision.

Equal vectors are one point: any number of copies is filed and compared once,
with the smallest ids that can be answered. Neighbouring leaves share a shelf of
about ``CELL`` points, and a query sends one row to a shelf, with the leaves it
visits there; a shelf of more points or queries is cut in a grid of cells.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do vectors of another than the most frequent
width, nor null ids; repeated rows count once; with fewer candidates than ``k``
all are returned; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mmcohort.llm import spread
from mmcohort.session import materialize

SAMPLE = 16_384
LEAF_POINTS = 200  # points a leaf is meant to hold; SAMPLE // 4 leaves at most
BRANCHES = 8
CALIBRATION = 128
RECALL = 0.95
CELL = 4096
ROUNDS = 12  # of Lloyd's algorithm at each node


class Tree:
    """Centres of all nodes but the root; ``kids[i]``: children of node i."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.centre: list[np.ndarray] = [np.zeros(sample.shape[1])]
        self.kids: list[list[int]] = [[]]
        least = max(4, len(sample) / max(1, leaves))
        todo = [(0, sample)]
        while todo:
            node, x = todo.pop()
            if len(x) <= least * 1.5:
                continue
            k = int(min(BRANCHES, max(2, round(len(x) / least))))
            label = self._kmeans(x, k)
            parts = [x[label == j] for j in range(k) if (label == j).any()]
            if len(parts) < 2:
                continue
            for p in parts:
                self.centre.append(p.mean(0))
                self.kids.append([])
                self.kids[node].append(len(self.centre) - 1)
                todo.append((len(self.centre) - 1, p))
        self.matrix = np.array(self.centre)
        del self.centre, self.rng

    def _kmeans(self, x: np.ndarray, k: int) -> np.ndarray:
        c = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            label = distances(x, c).argmin(1)
            c = np.array([x[label == j].mean(0) if (label == j).any() else x[self.rng.integers(len(x))] for j in range(k)])
        return distances(x, c).argmin(1)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf (node number) of each vector: nearest child at each level."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            out[rows] = node
            if self.kids[node] and len(rows):
                best = distances(x[rows], self.matrix[self.kids[node]]).argmin(1)
                todo += [(kid, rows[best == j]) for j, kid in enumerate(self.kids[node])]
        return out

    def best_bins(self, x: np.ndarray, visits: int) -> Iterator[list[int]]:
        """For each vector, its first ``visits`` leaves, best bin first."""
        for lo in range(0, len(x), 256):
            for d in distances(x[lo : lo + 256], self.matrix):
                queue, found = [(0.0, 0)], []
                while queue and len(found) < visits:
                    node = heapq.heappop(queue)[1]
                    while self.kids[node]:
                        kids = sorted((float(d[j]), j) for j in self.kids[node])
                        for other in kids[1:]:
                            heapq.heappush(queue, other)
                        node = kids[0][1]
                    found.append(node)
                yield found


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by expansion: for choosing, not for answers."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def nearest(
    q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, leaf: np.ndarray | None = None, visits: list | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, rows of x, exact distances) of the k nearest, ties to the
    smaller id. The expansion sieves; what its rounding can reorder is kept.
    With ``leaf`` (of each row of x) and ``visits`` (leaves of each query) only
    rows of visited leaves are compared."""
    if leaf is not None:
        order = np.argsort(leaf, kind="stable")
        names, at = np.unique(leaf[order], return_index=True)
        rows_of = dict(zip(names.tolist(), np.split(order, at[1:])))
    for lo in range(0, len(q), 64):
        part = q[lo : lo + 64]
        if leaf is None:
            d = distances(part, x)
        else:
            d = np.full((len(part), len(x)), np.inf)
            by: dict[int, list[int]] = {}
            for i, leaves in enumerate(visits[lo : lo + 64]):
                for v in leaves:
                    by.setdefault(v, []).append(i)
            for v, who in by.items():
                if v in rows_of:
                    d[np.ix_(who, rows_of[v])] = distances(part[who], x[rows_of[v]])
        slack = 1e-12 * ((part * part).sum(1) + (x * x).sum(1).max())
        for i in range(len(part)):
            rows = np.flatnonzero(d[i] < np.inf)
            if len(rows) > k:
                own = d[i][rows]
                rows = rows[own <= np.partition(own, k - 1)[k - 1] + 16 * slack[i]]
            exact = np.sqrt(((x[rows] - part[i]) ** 2).sum(1))
            o = np.lexsort((ids[rows], exact))[:k]
            yield lo + i, rows[o], exact[o]


def shelves(tree: Tree, points: dict[int, int]) -> dict[int, int]:
    """Leaf -> shelf: leaves in tree order, about CELL points a shelf."""
    out, shelf, size, todo = {}, 0, 0, [0]
    while todo:
        node = todo.pop()
        if tree.kids[node]:
            todo += tree.kids[node][::-1]
            continue
        n = points.get(node, 0)
        if size and size + n > CELL:
            shelf, size = shelf + 1, 0
        out[node] = shelf
        size += n
    return out


def _matrix(col: pa.Array) -> np.ndarray:
    """(rows, width) in double precision; every row has the same width."""
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v, cls: distinct rows that take part. ``cls``: hash of the vector."""
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0"
    )
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = v.where(~F.exists("v", bad)).where(F.exists("v", lambda x: x != 0))
    widths = v.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    v = v.where(F.size("v") == (widths[0]["w"] if widths else 0))
    return v.withColumn("cls", F.xxhash64("v")).dropDuplicates(["vec_id", "cls"])


def _cut(df: DataFrame, by: str, of: str, grid: DataFrame) -> DataFrame:
    """Each row in its chunk of a shelf, once for every chunk of the other side."""
    j = df.join(F.broadcast(grid), "shelf")  # a row per shelf: no more than leaves, at most SAMPLE // 4
    own, other = F.pmod(F.xxhash64(by), F.col(of)), "n_q" if of == "n_p" else "n_p"
    j = j.withColumn("__own", own).withColumn("__all", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
    a, b = ("__own", "__all") if of == "n_p" else ("__all", "__own")
    return j.withColumn("cell", F.xxhash64("shelf", a, b))


def search(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
    query_filter: str = "vec_id % 100 = 0", recall: float = RECALL, exact: bool = False,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each query among all
    rows but its own id. Queries are rows of ``queries``, or those of
    ``vectors`` that meet ``query_filter``. ``exact`` visits every leaf."""
    spark = vectors.sparkSession
    base = materialize(usable(vectors, id_col, vec_col), "vectors")
    asked = base.where(query_filter) if queries is None else usable(queries, id_col, vec_col)
    points = base.groupBy("cls").agg(F.first("v").alias("v"), F.min("vec_id").alias("low"))
    n_points = base.select("cls").distinct().count()
    if not n_points:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = points.orderBy(F.xxhash64("cls"), "cls").limit(SAMPLE).select("cls", "v").toArrow()
    x = _matrix(sample.column("v").combine_chunks())
    # sampled vectors in a fixed order, so that the tree is the same each time
    x = x[np.lexsort(x.T[::-1])]
    tree = Tree(x, min(math.ceil(n_points / LEAF_POINTS), SAMPLE // 4))
    held = spark.sparkContext.broadcast(tree)

    def file(batches):
        for b in batches:
            leaf = held.value.leaf(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(leaf)], names=["cls", "v", "low", "leaf"])

    kind = base.schema["v"].dataType.simpleString()
    filed = materialize(
        points.select("cls", "v", "low").mapInArrow(file, f"cls long, v {kind}, low long, leaf long"), "leaves"
    )
    per_leaf = {r["leaf"]: r["count"] for r in filed.groupBy("leaf").count().collect()}  # a row per leaf
    shelf = shelves(tree, per_leaf)
    leaves = len(shelf)
    visits = leaves if exact else calibrate(filed, tree, leaves, k, recall)

    def visit(batches):
        for b in batches:
            rows, where, which = [], [], []
            for i, found in enumerate(held.value.best_bins(_matrix(b.column(1)), visits)):
                mine: dict[int, list[int]] = {}
                for leaf in found:
                    mine.setdefault(shelf[leaf], []).append(leaf)
                rows += [i] * len(mine)
                where += mine
                which += mine.values()
            pick = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pick), b.column(1).take(pick), pa.array(where, pa.int64()), pa.array(which, pa.list_(pa.int64()))],
                names=["q", "v", "shelf", "leaves"],
            )

    wanted = asked.groupBy("cls").agg(F.first("v").alias("v")).select(F.col("cls").alias("q"), "v")
    visited = materialize(wanted.mapInArrow(visit, f"q long, v {kind}, shelf long, leaves array<long>"), "visits")
    points_on: dict[int, int] = {}
    for leaf, n in per_leaf.items():
        points_on[shelf[leaf]] = points_on.get(shelf[leaf], 0) + n
    queries_on = {r["shelf"]: r["count"] for r in visited.groupBy("shelf").count().collect()}  # a row per shelf
    grid = spark.createDataFrame(
        [(s, math.ceil(points_on[s] / CELL), math.ceil(n / CELL)) for s, n in queries_on.items() if points_on.get(s)],
        "shelf long, n_p long, n_q long",
    )
    on_shelf = spark.createDataFrame(list(shelf.items()), "leaf long, shelf long")

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            one = lambda t, c: t.column(c).combine_chunks() if isinstance(t.column(c), pa.ChunkedArray) else t.column(c)
            low, cls = one(left, "low").to_numpy(), one(left, "cls").to_numpy()
            qs = one(right, "q").to_numpy()
            found = nearest(
                _matrix(one(right, "v")), _matrix(one(left, "v")), low, k + 1, one(left, "leaf").to_numpy(), one(right, "leaves").to_pylist()
            )
            for i, rows, d in found:
                out[0].append(np.full(len(rows), qs[i]))
                out[1].append(cls[rows])
                out[2].append(low[rows])
                out[3].append(d)
        cols = [np.concatenate(c) if c else np.empty(0) for c in out]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(cols, kinds)], names=["q", "cls", "low", "score"])

    placed = filed.join(F.broadcast(on_shelf), "leaf")  # a row per leaf
    a = _cut(placed, "cls", "n_p", grid).select("cell", "cls", "low", "leaf", "v")
    b = _cut(visited, "q", "n_q", grid).select("cell", "q", "leaves", "v")
    found = a.groupBy("cell").cogroup(b.groupBy("cell")).applyInArrow(cell, "q long, cls long, low long, score double")
    best = Window.partitionBy("q").orderBy("score", "low", "cls")
    top = found.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k + 1).select("q", "cls", "score")
    # the smallest ids of each point: k + 1 of them, as one may be the query's own
    ids = Window.partitionBy("cls").orderBy("vec_id")
    members = base.select("cls", "vec_id").withColumn("__r", F.row_number().over(ids)).where(F.col("__r") <= k + 1).drop("__r")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    answers = top.join(members, "cls").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k + 1)
    answers = materialize(answers.select("q", "vec_id", "score"), "answers")
    # many queries with one vector are dealt over several tasks, each with a copy of the vector's answers
    packed = answers.groupBy("q").agg(F.collect_list(F.struct("vec_id", "score")).alias("a"))  # k + 1 rows a vector
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("cls").alias("q"))
    packed = packed.join(asked.groupBy("q").agg(F.count(F.lit(1)).alias("n")), "q")
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        spread.spread_join(asked, packed, "q", ["query_id"], "n")
        .select("query_id", F.inline("a"))
        .where("query_id <> vec_id")
        .withColumn("rank", F.row_number().over(rank))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def calibrate(filed: DataFrame, tree: Tree, leaves: int, k: int, recall: float) -> int:
    """Leaf visits that reach ``recall`` for CALIBRATION vectors, whose true
    neighbours come from a full scan (their k nearest of each batch are merged)."""
    spark = filed.sparkSession
    probe = filed.orderBy(F.xxhash64("cls", F.lit("probe")), "cls").limit(CALIBRATION).select("cls", "v").toArrow()
    q = _matrix(probe.column("v").combine_chunks())
    held = spark.sparkContext.broadcast(q)

    def scan(batches):
        for b in batches:
            if not b.num_rows:
                continue
            low, leaf = b.column(1).to_numpy(), b.column(2).to_numpy()
            out = [(i, leaf[r], low[r], d) for i, r, d in nearest(held.value, _matrix(b.column(0)), low, k + 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(len(r[1]), r[0]) for r in out]), pa.int32()),
                    *(pa.array(np.concatenate([r[j] for r in out])) for j in (1, 2, 3)),
                ],
                names=["i", "leaf", "low", "d"],
            )

    best = Window.partitionBy("i").orderBy("d", "low")
    true = (
        filed.select("v", "low", "leaf").mapInArrow(scan, "i int, leaf long, low long, d double")
        .withColumn("r", F.row_number().over(best)).where(F.col("r").between(2, k + 1)).select("i", "leaf").collect()
    )  # the first is the vector itself; CALIBRATION x k rows
    place = [{leaf: r for r, leaf in enumerate(found, 1)} for found in tree.best_bins(q, leaves)]
    ranks = np.array([place[t["i"]][t["leaf"]] for t in true])
    visits = 1
    while visits < leaves and len(ranks) and (ranks <= visits).mean() < recall:
        visits += max(1, visits // 4)  # wider, by a quarter each time
    return min(visits, leaves)

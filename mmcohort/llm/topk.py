"""Operator 11: exact top-k inner products by block-at-a-time pruning.

Vectors are turned into integers, floor(256 * x). Equal vectors are one point
with its ``k + 1`` smallest ids. Points are put in an order in which neighbours
are alike (median splits fitted on a bounded sample; the order decides speed,
never a result), and the order is cut in ranges, a range in blocks. A block
keeps its forward index (the integer matrix of its points) and, per component,
its largest and smallest value: the maxima of the terms "+d" and "-d". For a
query the sum over components of weight times term maximum bounds every score
in the block.

Consecutive ranges share a shelf, the unit of a task. A query first goes to the
shelf of its largest bound; the (k+1)-th score found there is its threshold,
and it then goes only to shelves whose bound reaches the threshold. On a shelf
its blocks are scored in the order of falling bounds until a bound is below the
(k+1)-th best score. Blocks whose bound equals it are scored, so ties are exact.

Defined results: vectors that are null or hold null or non-finite components
take no part, nor do null ids; an empty or zero vector scores 0; of vectors of
different widths the missing components count as 0; repeated rows count once;
rows with one id and different vectors are candidates each and queries each;
with fewer candidates than ``k`` all are returned; ties go to the smaller id;
an empty table gives an empty result; other columns are ignored. Components or
scores that could leave 62 bits fail the job.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mmcohort.session import materialize, settled

SCALE = 256
BLOCK = 256  # points a block is meant to hold
RANGES = 4096  # ranges of the order, at most
SAMPLE = 16_384  # vectors that fit the order, at most
VALUES = 1 << 21  # numbers of the sample, and of the shelves' term maxima, at most
SHELF = 8192  # points a task compares
QUERIES = 2048  # queries a task compares
SAME = 20_000  # queries with one vector answered in one task
NONE = -(1 << 62)  # below every score


class Order:
    """Median splits by the component of largest variance; leaves are numbered
    in order, so that neighbours in number are alike."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.cut, self.kids, self.number = [], [], [], []
        todo = [(sample, leaves, None, 0)]
        made = 0
        while todo:
            x, want, parent, side = todo.pop()
            node = len(self.dim)
            if parent is not None:
                self.kids[parent][side] = node
            self.dim.append(-1)
            self.cut.append(0)
            self.kids.append([-1, -1])
            self.number.append(-1)
            spread = x.var(0, dtype=np.float64) if want > 1 and len(x) > 1 and x.shape[1] else np.zeros(1)
            if spread.max() > 0:
                d = int(spread.argmax())
                t = int(np.sort(x[:, d])[(len(x) - 1) // 2])
                if (x[:, d] <= t).all():
                    t -= 1
                low = x[:, d] <= t
                self.dim[node], self.cut[node] = d, t
                todo.append((x[~low], want // 2, node, 1))
                todo.append((x[low], want - want // 2, node, 0))  # on top: leaves are met in order
            else:
                self.number[node] = made
                made += 1

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.dim[node] < 0:
                out[rows] = self.number[node]
            elif len(rows):
                low = x[rows, self.dim[node]] <= self.cut[node]
                todo += [(self.kids[node][0], rows[low]), (self.kids[node][1], rows[~low])]
        return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T: in doubles while every sum stays below 2**53."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 1 << 62:
        raise OverflowError("inner products may leave 62 bits")
    return a @ b.T


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """(queries, blocks): weights times term maxima, summed; a negative weight meets the term "-d"."""
    return product(np.maximum(q, 0), high) + product(np.minimum(q, 0), low)


def block_at_a_time(
    q: np.ndarray, theta: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], high: np.ndarray, low: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of the ``k`` best rows of each query, best first, NONE
    where there are fewer, and how many (query, block) pairs were scored.
    ``blocks``: forward index, point of each row, id of each row. Rows that
    cannot reach ``theta`` need not be found."""
    n = len(q)
    score, ids = np.full((n, k), NONE), np.zeros((n, k), np.int64)
    bound = bounds(q, high, low)
    order = np.argsort(-bound, axis=1, kind="stable")
    every, scored = np.arange(n), 0
    for turn in range(len(blocks)):
        block = order[:, turn]
        live = bound[every, block] >= np.maximum(theta, score[:, -1])
        if not live.any():
            break
        for b in np.unique(block[live]):
            rows = np.flatnonzero(live & (block == b))
            scored += len(rows)
            forward, point, own = blocks[b]
            s = product(q[rows], forward)
            some = s.max(1) >= np.maximum(theta, score[:, -1])[rows]
            if not some.any():
                continue
            rows, s = rows[some], s[some][:, point]
            s = np.concatenate([score[rows], s], 1)
            who = np.concatenate([ids[rows], np.broadcast_to(own, (len(rows), len(own)))], 1)
            best = np.lexsort((who, -s), axis=1)[:, :k]
            score[rows], ids[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(who, best, 1)
    return score, ids, scored


def _one(col):
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def _matrix(col, width: int) -> np.ndarray:
    """(rows, width) integers; missing components are 0."""
    col = _one(col)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    n = np.asarray(col.value_lengths(), np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(n) and (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _packed(x: np.ndarray) -> bytes:
    """The narrowest integers that hold the matrix."""
    most = int(np.abs(x).max(initial=0))
    kind = next(t for t in ("<i2", "<i4", "<i8") if most < 1 << (8 * int(t[2]) - 1))
    return x.astype(kind).tobytes()


def _unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    kind = f"<i{len(data) // (n * width)}" if width else "<i8"
    return np.frombuffer(data, kind).astype(np.int64).reshape(n, width)


def integers(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array of long): the distinct rows that take part."""
    v = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"),
        F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double")).alias("v"),
    ).where("vec_id is not null and v is not null")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x * SCALE)).otherwise(
        F.raise_error(F.lit("a component leaves 62 bits")).cast("long")
    )
    return v.select("vec_id", F.transform("v", whole).alias("v")).dropDuplicates(["vec_id", "v"])


def points_of(rows: DataFrame, k: int) -> DataFrame:
    """v, ids: distinct vectors with their ``k`` smallest ids."""
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= k)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def best_rows(base: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """q, vec_id, score: the ``k + 1`` best rows of ``base`` for each query vector, its own row among them or not."""
    spark = base.sparkSession
    points = materialize(points_of(base, k + 1), "points")
    n_points, width = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n_points:
        return spark.createDataFrame([], "q string, vec_id long, score long")
    width = max(1, width, wanted.agg(F.max(F.size("v"))).first()[0] or 0)
    sample = points.select("v").orderBy(F.xxhash64("v"), "v").limit(min(SAMPLE, max(64, VALUES // width))).toArrow()
    ranges = min(math.ceil(n_points / BLOCK), RANGES, max(16, VALUES // (2 * width)))
    order = spark.sparkContext.broadcast(Order(_matrix(sample.column("v"), width), ranges))

    def file(batches):
        for b in batches:
            leaf = order.value.leaf(_matrix(b.column(0), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=["v", "ids", "leaf"])

    filed = materialize(points.select("v", "ids").mapInArrow(file, "v array<long>, ids array<long>, leaf long"), "ranges")
    per_range = {r["leaf"]: r["count"] for r in filed.groupBy("leaf").count().collect()}  # a row per range
    shelf, size, places = 0, 0, []
    for leaf, n in sorted(per_range.items()):
        if size and size + n > SHELF:
            shelf, size = shelf + 1, 0
        size += n
        places.append((leaf, shelf, math.ceil(n / BLOCK)))
    on_shelf: dict[int, int] = {}  # shelf -> tasks its blocks are dealt to
    for _, s, blocks in places:
        on_shelf[s] = max(on_shelf.get(s, 1), math.ceil(blocks * BLOCK / SHELF))
    index = materialize(_index(filed, spark.createDataFrame(places, "leaf long, shelf long, n_blocks long"), width), "index")
    tops = index.select("shelf", "high", "low").groupBy("shelf").applyInArrow(_tops(width), "shelf long, high binary, low binary")
    tops = sorted(tuple(r) for r in tops.collect())  # a row per shelf: VALUES numbers at most
    shelves = spark.sparkContext.broadcast(
        ([t[0] for t in tops], *(np.concatenate([_unpacked(bytes(t[i]), 1, width) for t in tops]) for i in (1, 2)))
    )

    def route(home: bool):
        def go(batches):
            names, high, low = shelves.value
            for b in batches:
                x = _matrix(b.column(1), width)
                bound = bounds(x, high, low)
                best = bound.argmax(1)
                if home:
                    rows, where = np.arange(len(x)), best
                else:
                    open_ = bound >= np.asarray(b.column(2))[:, None]
                    open_[np.arange(len(x)), best] = False
                    rows, where = np.nonzero(open_)
                pick = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [c.take(pick) for c in b.columns] + [pa.array(np.asarray(names, np.int64)[where])], names=["q", "v", "theta", "shelf"]
                )

        return go

    def visit(who: DataFrame, home: bool, name: str) -> DataFrame:
        routed = materialize(
            who.select("q", "v", "theta").mapInArrow(route(home), "q string, v array<long>, theta long, shelf long"), f"{name}_routes"
        )
        on = {r["shelf"]: r["count"] for r in routed.groupBy("shelf").count().collect()}  # a row per shelf
        grid = spark.createDataFrame(
            [(s, on_shelf[s], math.ceil(n / QUERIES)) for s, n in on.items()], "shelf long, n_parts long, n_chunks long"
        )
        upto = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        cell = F.xxhash64("shelf", "part", "chunk").alias("cell")
        a = index.join(F.broadcast(grid), "shelf").withColumn("chunk", upto("n_chunks")).select(cell, "n", "ids", "forward", "high", "low")
        b = routed.join(F.broadcast(grid), "shelf").withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("n_chunks")))
        b = b.withColumn("part", upto("n_parts")).select(cell, "q", "v", "theta")
        found = a.groupBy("cell").cogroup(b.groupBy("cell")).applyInArrow(_cell(width, k + 1), "q string, vec_id long, score long")
        return materialize(found, name)

    near = visit(wanted.withColumn("theta", F.lit(NONE)), True, "home")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("__r", F.row_number().over(top)).where(F.col("__r") == k + 1).select("q", F.col("score").alias("theta"))
    known = wanted.join(kth, "q", "left").withColumn("theta", F.coalesce("theta", F.lit(NONE)))
    far = visit(known, False, "others")
    return near.unionByName(far).withColumn("__r", F.row_number().over(top)).where(F.col("__r") <= k + 1).drop("__r")


def search(
    vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    query_filter: str = "vec_id % 50 = 0",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of each
    query among all rows but its own. Queries are rows of ``queries``, or
    those of ``vectors`` that meet ``query_filter``."""
    spark = vectors.sparkSession
    base = materialize(integers(vectors, id_col, vec_col), "integers")
    asked = base.where(query_filter) if queries is None else materialize(integers(queries, id_col, vec_col), "queries")
    wanted = asked.groupBy("v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n_same"))
    wanted = materialize(wanted.withColumn("q", F.concat_ws(":", "low", F.hex(F.xxhash64("v")))).drop("low"), "wanted")
    answers = settled(spark, "answers", lambda: best_rows(base, wanted, k))
    # many queries with one vector: their answers (k + 1 rows) are sent to several tasks
    parts = F.ceil(F.col("n_same") / F.lit(SAME))
    answers = answers.join(wanted.select("q", "v", parts.alias("n_parts")), "q")
    answers = answers.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_parts") - 1)))
    crowd = wanted.where(F.col("n_same") > SAME).select("v", parts.alias("n_parts"))
    mine = asked.select(F.col("vec_id").alias("query_id"), "v").join(crowd, "v", "left")
    mine = mine.withColumn("part", F.pmod(F.xxhash64("query_id"), F.coalesce("n_parts", F.lit(1).cast("long")))).drop("n_parts")
    # the query's own row: of its id, with the score of its vector by itself
    rank = Window.partitionBy("query_id", "v").orderBy(F.desc("score"), "vec_id")
    own = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    is_own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == own)
    every = Window.partitionBy("query_id", "v")
    return (
        mine.join(answers.drop("n_parts", "q"), ["v", "part"])
        .withColumn("at", F.row_number().over(rank))
        .withColumn("own_at", F.min(F.when(is_own, F.col("at"))).over(every))
        .where(F.col("own_at").isNull() | (F.col("at") != F.col("own_at")))
        .withColumn("rank", F.col("at") - F.when(F.col("at") > F.col("own_at"), F.lit(1)).otherwise(F.lit(0)))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _index(filed: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """A row per block: shelf, part, n, ids, forward, high, low."""

    def build(key, t):
        x = _matrix(t.column("v"), width)
        return pa.table(
            {
                "shelf": pa.array([key[0].as_py()], pa.int64()),
                "part": pa.array([key[2].as_py() // (SHELF // BLOCK)], pa.int64()),
                "n": pa.array([len(x)], pa.int64()),
                "ids": pa.array([t.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
                "forward": pa.array([_packed(x)], pa.binary()),
                "high": pa.array([_packed(x.max(0))], pa.binary()),
                "low": pa.array([_packed(x.min(0))], pa.binary()),
            }
        )

    j = filed.join(F.broadcast(places), "leaf").withColumn("sub", F.pmod(F.xxhash64("v"), F.col("n_blocks")))  # a row per range
    return j.select("shelf", "leaf", "sub", "v", "ids").groupBy("shelf", "leaf", "sub").applyInArrow(
        build, "shelf long, part long, n long, ids array<array<long>>, forward binary, high binary, low binary"
    )


def _tops(width: int):
    def top(t):
        high, low = (np.concatenate([_unpacked(x, 1, width) for x in t.column(c).to_pylist()]) for c in ("high", "low"))
        return pa.table(
            {
                "shelf": t.column("shelf").slice(0, 1),
                "high": pa.array([_packed(high.max(0))], pa.binary()),
                "low": pa.array([_packed(low.min(0))], pa.binary()),
            }
        )

    return top


def _cell(width: int, k: int):
    """Block-at-a-time over the blocks of one part of a shelf, for a chunk of queries."""

    def cell(left, right):
        kinds = pa.schema([("q", pa.string()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return kinds.empty_table()
        blocks, high, low = [], [], []
        for r in left.to_pylist():
            point = np.repeat(np.arange(r["n"]), [len(i) for i in r["ids"]])
            blocks.append((_unpacked(r["forward"], r["n"], width), point, np.array([i for x in r["ids"] for i in x], np.int64)))
            high.append(_unpacked(r["high"], 1, width))
            low.append(_unpacked(r["low"], 1, width))
        theta = np.asarray(_one(right.column("theta")))
        score, ids, _ = block_at_a_time(_matrix(right.column("v"), width), theta, blocks, np.concatenate(high), np.concatenate(low), k)
        rows, cols = np.nonzero((score > NONE) & (score >= theta[:, None]))
        return pa.table([_one(right.column("q")).take(pa.array(rows)), pa.array(ids[rows, cols]), pa.array(score[rows, cols])], schema=kinds)

    return cell


def brute(rows: list[tuple], is_query, k: int = 5) -> Iterator[tuple]:
    """(query_id, rank, vec_id, score) by comparing all pairs (for tests)."""
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i, tuple(math.floor(SCALE * float(x)) for x in v)] = None
    for i, v in ok:
        if is_query(i):
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if (j, w) != (i, v))
            yield from ((i, r, j, -x) for r, (x, j) in enumerate(s[:k], 1))

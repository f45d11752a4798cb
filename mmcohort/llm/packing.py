"""Operator 8: best-fit packing planned over a length histogram.

1. Tasks encode each document once (its ids, then the separator id), cut only
   documents longer than ``capacity`` into full pieces with a shorter first
   one, and write one narrow row a piece.
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the
   corpus) is planned on the driver: best-fit decreasing over counts. Equal
   sequences are kept as ranges, so the plan's size and time follow the number
   of lengths, not of documents.
3. Each piece gets a rank among those of its length and takes the planned slot
   of that (length, rank).

Defined results: a null or empty text is the separator alone; a null doc_id is
kept; repeated rows are packed each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mmcohort.llm.sharding import number_within
from mmcohort.llm.tokens import encoder
from mmcohort.session import materialize

CAPACITY = 2048
SEPARATOR = 0
BROADCAST_RUNS = 200_000  # plan rows up to which the plan is broadcast (about 10 MB)


@dataclass(frozen=True)
class Run:
    """Pieces of ``length`` with ranks ``lo`` <= rank < ``hi`` go, ``per`` to a
    sequence, to the sequences from ``seq`` on, the first at place ``at``."""

    length: int
    lo: int
    hi: int
    seq: int
    per: int
    at: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over counts: longest first, each into the fullest
    sequence that still has room, else into a new one."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, how many)]
    runs: list[Run] = []
    new = 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        left, rank = counts[length], 0
        for r in [*sorted(x for x in room if x >= length), None]:
            if not left:
                break
            per = (capacity if r is None else r) // length
            used = 0 if r is None else capacity - r
            if r is None:
                spans = [(new, -(-left // per))]
                new += spans[0][1]
            else:
                spans = room.pop(r)
            for k, (seq, n) in enumerate(spans):
                if not left:
                    room.setdefault(r, []).extend(spans[k:])
                    break
                full = min(n, left // per)
                if full:
                    runs.append(Run(length, rank, rank + full * per, seq, per, used))
                    room.setdefault(capacity - used - per * length, []).append((seq, full))
                    rank, left = rank + full * per, left - full * per
                if full < n and left:
                    runs.append(Run(length, rank, rank + left, seq + full, left, used))
                    room.setdefault(capacity - used - left * length, []).append((seq + full, 1))
                    full, left = full + 1, 0
                if full < n:
                    room.setdefault(r, []).append((seq + full, n - full))
    return runs


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece, in tasks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(1)):
                s = t.as_py()
                ids = np.append(enc(s), np.uint32(SEPARATOR)) if s else np.array([SEPARATOR])
                data = memoryview(ids.astype("<u4").tobytes())
                n, lo, k = len(ids), 0, 0
                hi = n % capacity or capacity
                while lo < n:
                    rows.append(i)
                    piece.append(k)
                    start.append(lo)
                    length.append(hi - lo)
                    crc.append(zlib.crc32(data[4 * lo : 4 * hi]))
                    lo, hi, k = hi, hi + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
                + [pa.array(x, pa.int64()) for x in (start, length, crc)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (which are read twice:
    hand over a written table)."""
    spark = cut.sparkSession
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan(hist, capacity)
    # from Arrow: rows of Python objects would be unpacked by Python workers of a kind of their own, that stay
    columns = {f.name: pa.array([getattr(r, f.name) for r in runs], pa.int64()) for f in fields(Run)}
    table = spark.createDataFrame(pa.table(columns)).withColumnRenamed("length", "p_length")
    table = F.broadcast(table) if len(runs) <= BROADCAST_RUNS else table
    ranked = number_within(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], sum(hist.values()), "rank")
    i = F.col("rank") - F.col("lo")
    return (
        ranked.join(
            table,
            (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")),
        )
        .withColumn("sequence_id", F.col("seq") + F.floor(i / F.col("per")))
        .withColumn("offset", F.col("at") + F.pmod(i, F.col("per")) * F.col("length"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    )


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    return place(materialize(pieces(docs, id_col, text_col, path, capacity), "pieces"), capacity)

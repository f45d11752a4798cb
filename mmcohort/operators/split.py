"""Exact, deterministic split by group (patient) id.

Distinct group ids are ordered by ``(md5("<seed>:<id>"), id)``; the first
``ceil(n * val_fraction)`` go to validation. Because membership is a threshold
on that order, the split needs only ONE cutoff value:

1. distinct ids are counted per md5 hex bucket (4,096 buckets, uniform by
   construction whatever the data) — a map-side combined aggregate;
2. running counts over the ≤ 4,096-row bucket table find the bucket holding
   the ``n_val``-th id;
3. only the ids of that one bucket (≈ n / 4,096) are ranked to find the cutoff
   ``(hash, id)`` — one row.

Each study row then gets its split by comparing its own hash with the cutoff
(a scalar subquery, run once): the study table is never shuffled or joined on the group
id, so a patient holding a third of all rows costs nothing extra.

``members="source"`` gives the very members of the source's split instead: ids
are numbered by first appearance in the input (:func:`first_seen`), and the
numbers that a seeded Mersenne-Twister permutation deals first are validation.
The shuffle behind that permutation is sequential, so ONE task draws it (eight
bytes a group, ``MAX_SOURCE_GROUPS`` at most, else an error); ids and numbers
stay in tables, and the validation ids are broadcast only while there are few.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mmcohort import config as C
from mmcohort.operators.prefix import hex_bucket
from mmcohort.session import materialize

_HEX_DIGITS = 3  # 4,096 buckets
MAX_SOURCE_GROUPS = 1 << 27  # a permutation of them is 1 GiB in the task that draws it
BROADCAST_IDS = 1 << 21  # validation ids up to which they are broadcast (some 64 MB)


def split_key(key_col, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), key_col.cast("string")))


def val_cutoff(
    df: DataFrame, key: str = "haim_id", *, val_fraction: float = C.VAL_FRACTION, seed: int = C.SPLIT_SEED
) -> DataFrame:
    """One-row table ``(_cut_h, _cut_id, _n, _n_val)``: the last validation id in
    ``(md5, id)`` order. No row when ``n_val`` is 0 (then every group is train)."""
    ids = (
        df.select(F.col(key).alias("_id"))
        .where(F.col("_id").isNotNull())
        .distinct()
        .withColumn("_h", split_key(F.col("_id"), seed))
        .withColumn("_b", hex_bucket(F.col("_h"), _HEX_DIGITS))
        # never NULL; stated here so the join below infers no extra filter and both
        # uses of `ids` stay one plan (the distinct-id exchange is then reused)
        .where(F.col("_b").isNotNull())
    )
    buckets = ids.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))  # ≤ 4,096 rows
    w_all = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w_run = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    b = buckets.select(
        "_b",
        "_cnt",
        (F.sum("_cnt").over(w_run) - F.col("_cnt")).alias("_off"),
        F.sum("_cnt").over(w_all).alias("_n"),
    ).withColumn("_n_val", F.ceil(F.col("_n") * F.lit(val_fraction)).cast("long"))
    target = b.where((F.col("_off") < F.col("_n_val")) & (F.col("_n_val") <= F.col("_off") + F.col("_cnt")))
    # at most one bucket qualifies: the join below keeps only its ids
    in_bucket = ids.join(F.broadcast(target.select("_b", "_off", "_n", "_n_val")), "_b")
    w_b = Window.partitionBy("_b").orderBy("_h", "_id")
    ranked = in_bucket.withColumn("_rn", F.row_number().over(w_b) + F.col("_off"))
    return ranked.where(F.col("_rn") == F.col("_n_val")).select(
        F.col("_h").alias("_cut_h"), F.col("_id").alias("_cut_id"), "_n", "_n_val"
    )


def _with_split(df: DataFrame, key: str, cut: DataFrame, seed: int) -> DataFrame:
    # The cutoff is a scalar subquery (one row by construction): Spark runs it once and
    # hands every task the value; no join. No cutoff row -> NULL -> every group is train.
    c = cut.select(F.struct("_cut_h", "_cut_id").alias("_cut")).scalar()
    # (hash, id) <= (cut hash, cut id): struct comparison is lexicographic; one subquery reference
    is_val = F.struct(split_key(F.col(key), seed).alias("_cut_h"), F.col(key).alias("_cut_id")) <= c
    return df.withColumn("split", F.when(F.coalesce(is_val, F.lit(False)), F.lit("val")).otherwise(F.lit("train")))


def group_assignments(
    df: DataFrame, key: str = "haim_id", *, val_fraction: float = C.VAL_FRACTION, seed: int = C.SPLIT_SEED
) -> DataFrame:
    """(key, split) for every distinct group id; split is 'train' or 'val'."""
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    return _with_split(ids, key, val_cutoff(df, key, val_fraction=val_fraction, seed=seed), seed).select(key, "split")


def group_split(
    df: DataFrame, key: str = "haim_id", *, val_fraction: float = C.VAL_FRACTION, seed: int = C.SPLIT_SEED
) -> DataFrame:
    """Add a ``split`` column to every row with a non-NULL group id.

    One comparison per row against the cutoff (a scalar subquery) — no join
    of the study rows and no filtered copy per split."""
    rows = df.where(F.col(key).isNotNull())
    return _with_split(rows, key, val_cutoff(df, key, val_fraction=val_fraction, seed=seed), seed)


@dataclass(frozen=True)
class SplitCutoff:
    """The fitted split: last validation id in (md5, id) order (None: no validation group)."""

    seed: int
    cut_h: str | None
    cut_id: Any
    n_groups: int
    n_val: int


@dataclass(frozen=True)
class SourceMembers:
    """The fitted split by the source's own rule: a written table of validation ids."""

    ids: DataFrame  # column ``_val_id``
    n_groups: int
    n_val: int


def first_seen(df: DataFrame, key: str, position: str) -> DataFrame:
    """(_id, _rank): distinct non-NULL ids numbered from 0 in order of first
    appearance. ``position`` is a struct (file, block, row) that grows along the
    input (:func:`mmcohort.sources.io.row_position`). Rows are ranked inside
    their block; the blocks' counts give the offsets."""
    p = F.col(position)
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(p).alias("_p"))
    first = materialize(first.select("_id", "_p.file", "_p.block", "_p.row"), "first-seen")
    per = first.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"))  # a row per block of the input
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("file", "block").orderBy("row")
    return first.withColumn("_r", F.row_number().over(inside)).join(offsets, ["file", "block"]).select(
        "_id", (F.col("_o") + F.col("_r") - 1).cast("long").alias("_rank")
    )


def dealt_ranks(spark: SparkSession, n: int, n_val: int, seed: int) -> DataFrame:
    """(_rank): the first ``n_val`` numbers of the seeded permutation of 0 .. n - 1, drawn in one task."""
    if n > MAX_SOURCE_GROUPS:
        raise ValueError(f"{n} groups are more than one task permutes ({MAX_SOURCE_GROUPS}); use members='hash'")

    def draw(batches):
        for b in batches:
            if b.num_rows:
                ranks = np.random.RandomState(seed).permutation(n)[:n_val]
                for lo in range(0, n_val, 1 << 20):
                    yield pa.RecordBatch.from_arrays([pa.array(ranks[lo : lo + (1 << 20)], pa.int64())], names=["_rank"])

    return spark.range(1, numPartitions=1).mapInArrow(draw, "_rank long")


def source_members(
    df: DataFrame, key: str, position: str, *, val_fraction: float = C.VAL_FRACTION, seed: int = C.SPLIT_SEED
) -> SourceMembers:
    """The source's validation ids; every other group is train."""
    spark = df.sparkSession
    ranked = materialize(first_seen(df, key, position), "id-ranks")
    n = ranked.count()
    n_val = int(np.ceil(n * val_fraction))
    ids = ranked.join(dealt_ranks(spark, n, n_val, seed), "_rank").select(F.col("_id").alias("_val_id"))
    return SourceMembers(materialize(ids, "val-ids"), n, n_val)


def fit_split(
    df: DataFrame, key: str = "haim_id", *, val_fraction: float = C.VAL_FRACTION, seed: int = C.SPLIT_SEED,
    members: str = "hash", position: str | None = None,
) -> SplitCutoff | SourceMembers:
    """Run the cutoff job once and keep its single row on the driver, so every
    later use of the split (statistics on train, scoring on val, ...) is a
    literal comparison instead of a re-run of the distinct-id aggregation.

    ``members="source"`` (with the ``position`` column) writes the source's own
    validation ids instead."""
    if members not in ("hash", "source"):
        raise ValueError("members must be 'hash' or 'source'")
    if members == "source":
        if position is None:
            raise ValueError("members='source' needs the position of the rows in their files")
        return source_members(df, key, position, val_fraction=val_fraction, seed=seed)
    row = val_cutoff(df, key, val_fraction=val_fraction, seed=seed).first()  # one row by construction
    if row is None:
        return SplitCutoff(seed, None, None, 0, 0)
    return SplitCutoff(seed, row["_cut_h"], row["_cut_id"], int(row["_n"]), int(row["_n_val"]))


def apply_split(df: DataFrame, key: str, cutoff: SplitCutoff | SourceMembers) -> DataFrame:
    """Add ``split`` to every row with a non-NULL group id: a projection without
    shuffle; for :class:`SourceMembers` a broadcast join while the ids are few."""
    rows = df.where(F.col(key).isNotNull())
    if isinstance(cutoff, SourceMembers):
        ids = F.broadcast(cutoff.ids) if cutoff.n_val <= BROADCAST_IDS else cutoff.ids
        flag = F.when(F.col("_val_id").isNotNull(), F.lit("val")).otherwise(F.lit("train"))
        return rows.join(ids, rows[key] == ids["_val_id"], "left").withColumn("split", flag).drop("_val_id")
    if cutoff.cut_h is None:
        return rows.withColumn("split", F.lit("train"))
    h = split_key(F.col(key), cutoff.seed)
    flag = (h < F.lit(cutoff.cut_h)) | ((h == F.lit(cutoff.cut_h)) & (F.col(key) <= F.lit(cutoff.cut_id)))
    return rows.withColumn("split", F.when(flag, F.lit("val")).otherwise(F.lit("train")))

"""Batch numbering and per-epoch shuffles over a stated total order.

Spark rows have no inherent order, so a batch is defined by a key: rows are
ranked by the key (exactly, via :func:`ordered_prefix`) and numbered in
blocks of ``batch_size`` from 1; the last batch may be short.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mmcohort import config as C
from mmcohort.operators.prefix import bucketize, hex_bucket, hex_digits, ordered_prefix, quantile_splits


def quantile_buckets(df: DataFrame, col: str, n_buckets: int | None = None, out: str = "_qbucket") -> DataFrame:
    """Add a bucket column monotone in ``col`` with roughly equal row counts
    (as many buckets as the row count asks for, see :func:`quantile_splits`)."""
    return bucketize(df, col, quantile_splits(df, col, n_buckets), out)


def _batch_id(batch_size: int) -> Column:
    return (F.floor((F.col("row_idx") - 1) / F.lit(batch_size)) + 1).cast("long")


def batch_numbers(
    df: DataFrame,
    key: str,
    *,
    batch_size: int = C.BATCH_SIZE,
    partition: Sequence[str] = ("split",),
    keep: Sequence[str] = (),
    tie: str | None = None,
) -> DataFrame:
    """(partition..., key, keep..., row_idx, batch_id): ``row_idx`` is the 1-based
    rank by ``key`` within ``partition``. Only these columns are shuffled:
    hand over narrow columns in ``keep``, or join the numbers by key. NULL keys
    rank first and NULL partition values are a partition of their own. Where
    the key is not unique, ``tie`` names a column that orders its rows."""
    narrow = df.select(*dict.fromkeys([*partition, key, *keep, *([tie] if tie else [])]))
    narrow = narrow.withColumn("_ord", F.struct(key, tie) if tie else F.col(key))
    ranked = ordered_prefix(
        quantile_buckets(narrow, key), "_ord", F.col("_qbucket").cast("int"), partition=partition, rank="row_idx"
    ).drop("_qbucket", "_ord")
    return ranked.withColumn("batch_id", _batch_id(batch_size))


def shuffle_key(key: str, epoch, *, method: str = "md5"):
    """Deterministic per-epoch order key (a retried task sees the same order, unlike rand()).
    ``epoch``: an int or a Column."""
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    if method == "md5":
        return F.md5(F.concat(F.lit("e"), e.cast("string"), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    if method == "xxhash":
        return F.xxhash64(F.col(key), e)
    raise ValueError(method)


def epoch_batches(
    df: DataFrame,
    key: str,
    epochs: int | Sequence[int],
    *,
    batch_size: int = C.BATCH_SIZE,
    partition: Sequence[str] = ("split",),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Shuffled batch numbers per epoch: rank by md5(epoch, key).

    Several epochs come from ONE pass over the narrow (partition, key, keep)
    columns: these are repeated once per epoch, never the whole row. The hash
    buckets follow the row count.
    """
    eps = [epochs] if isinstance(epochs, int) else list(epochs)
    narrow = df.select(*dict.fromkeys([*partition, key, *keep]))
    digits = hex_digits(narrow.count())
    d = narrow.withColumn("epoch", F.explode(F.array(*[F.lit(int(e)) for e in eps])))
    d = d.withColumn("_sh", shuffle_key(key, F.col("epoch"))).withColumn("_ord", F.struct("_sh", F.col(key)))
    ranked = ordered_prefix(
        d, "_ord", hex_bucket(F.col("_sh"), digits), partition=("epoch", *partition), rank="row_idx"
    ).drop("_sh", "_ord")
    return ranked.withColumn("batch_id", _batch_id(batch_size))

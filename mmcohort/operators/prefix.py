"""Exact global row numbers, running sums and next-row values without a
single-partition window.

A total order over a large table normally needs ``Window.orderBy`` without
``partitionBy`` — Spark then moves every row into one task. Instead the rows
are cut into buckets by an expression that is monotone in the order key:

1. window *inside* each (partition, bucket) — one shuffle, spread over many tasks;
2. aggregate the windowed rows per bucket (no extra shuffle: the data is
   already hash-partitioned by (partition, bucket));
3. running offsets over that small bucket table (≤ buckets × partition values rows);
4. join the offsets back (adaptive execution broadcasts them when they are small).

The result is deterministic: a retried task computes the same numbers, which
sampling-based range partitioning does not promise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 50_000
MAX_BUCKETS = 1 << 16  # boundaries that reach the driver, at most
_NULL_BUCKET = -1  # below every bucket: NULLs come first ascending, last descending


def hex_bucket(hex_col, digits: int = 3) -> Column:
    """Bucket from the leading hex digits of a hash string (16**digits buckets)."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("int")


def bucket_count(n_rows: int) -> int:
    """Buckets for ``n_rows`` rows: about ROWS_PER_BUCKET in each."""
    return min(MAX_BUCKETS, max(1, math.ceil(n_rows / ROWS_PER_BUCKET)))


def hex_digits(n_rows: int) -> int:
    """Leading hex digits of a hash that make at least :func:`bucket_count` buckets."""
    return max(1, math.ceil(math.log(bucket_count(n_rows), 16) - 1e-9))


def quantile_splits(df: DataFrame, col: str, n_buckets: int | None = None) -> list[float]:
    """Bucket boundaries with roughly equal row counts (as many buckets as the
    row count asks for, unless ``n_buckets`` is stated): ``approxQuantile``
    (a map-side sketch per partition, merged; ≤ ``n_buckets`` numbers reach
    the driver), relative rank error 1 / (4 n_buckets). Repeated values give
    one boundary, so a value held by a third of all rows is one bucket edge,
    not a hot bucket of distinct values."""
    n_buckets = bucket_count(df.count()) if n_buckets is None else n_buckets
    probs = [i / n_buckets for i in range(1, n_buckets)]
    qs = df.approxQuantile(col, probs, 1.0 / (4 * n_buckets)) if probs else []
    inner = sorted(set(float(q) for q in qs if q is not None and q == q and abs(q) != float("inf")))
    return [float("-inf"), *inner, float("inf")]


def bucketize(df: DataFrame, col: str, splits: list[float], out: str) -> DataFrame:
    """Add ``out`` = index of the bucket of ``col`` (JVM binary search; NaN -> last
    bucket + 1; NULL -> NULL, which :func:`ordered_prefix` gives a bucket of its own)."""
    if len(splits) < 3:
        return df.withColumn(out, F.when(F.col(col).isNotNull(), F.lit(0)))
    tmp = f"{out}_in"
    d = df.withColumn(tmp, F.col(col).cast("double"))
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return b.transform(d).drop(tmp).withColumn(out, F.when(F.col(col).isNotNull(), F.col(out).cast("int")))


def ordered_prefix(
    df: DataFrame,
    key: str,
    bucket: Column,
    *,
    partition: Sequence[str] = (),
    ascending: bool = True,
    rank: str | None = None,
    sums: dict | None = None,
    leads: dict | None = None,
    totals: bool = False,
) -> DataFrame:
    """Add a global rank, inclusive running sums and next-row values per ``partition``.

    ``key`` must be unique inside each partition (ties would make the rank
    arbitrary); ``bucket`` must be monotone non-decreasing in ``key``. ``sums``/``leads`` map an output name to a
    numeric column / any column of ``df``. With ``totals`` every row also gets
    its partition's row count ``_total_rows`` and ``<sum name>_total``, taken
    from the small bucket table (no extra pass over the rows).
    No row is lost: a NULL key is ordered before all others (after them when
    descending), and NULL partition values are a partition of their own.
    """
    sums = dict(sums or {})
    leads = dict(leads or {})
    part = list(partition)
    b = "_pfx_bucket"
    rn = "_pfx_rn"
    d = df.withColumn(b, F.coalesce(bucket, F.lit(_NULL_BUCKET)))
    if part:
        # a struct is never NULL and equal where its fields are, NULLs included:
        # the join below is a plain one on the columns the rows are dealt by
        d = d.withColumn("_pfx_part", F.struct(*part))
        part = ["_pfx_part"]
    for name, c in sums.items():
        d = d.withColumn(f"_pfx_v_{name}", c)
    for name, c in leads.items():
        d = d.withColumn(f"_pfx_l_{name}", c)

    k = F.col(key)
    w_in = Window.partitionBy(*part, b).orderBy(k.asc() if ascending else k.desc())
    w_run = w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn(rn, F.row_number().over(w_in))
    for name in sums:
        d = d.withColumn(f"_pfx_r_{name}", F.sum(f"_pfx_v_{name}").over(w_run))
    for name in leads:
        d = d.withColumn(f"_pfx_n_{name}", F.lead(f"_pfx_l_{name}").over(w_in))

    # Per-bucket totals, computed from the windowed rows: same partitioning, no new exchange.
    aggs = [F.max(rn).alias("_pfx_cnt")]
    aggs += [F.sum(f"_pfx_v_{name}").alias(f"_pfx_t_{name}") for name in sums]
    if leads:
        aggs.append(F.min_by(F.struct(*[F.col(f"_pfx_l_{n}").alias(n) for n in leads]), F.col(rn)).alias("_pfx_first"))
    buckets = d.groupBy(*part, b).agg(*aggs)

    w_b = Window.partitionBy(*part).orderBy(F.col(b).asc() if ascending else F.col(b).desc())
    w_prev = w_b.rowsBetween(Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(*part).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offs = buckets.select(
        *part,
        b,
        "_pfx_cnt",
        F.coalesce(F.sum("_pfx_cnt").over(w_prev), F.lit(0)).alias("_pfx_off_cnt"),
        *[F.coalesce(F.sum(f"_pfx_t_{n}").over(w_prev), F.lit(0)).alias(f"_pfx_off_{n}") for n in sums],
        *([F.lead("_pfx_first").over(w_b).alias("_pfx_next_first")] if leads else []),
        *(
            [F.sum("_pfx_cnt").over(w_all).alias("_pfx_tot_cnt")]
            + [F.sum(f"_pfx_t_{n}").over(w_all).alias(f"_pfx_tot_{n}") for n in sums]
            if totals
            else []
        ),
    )

    # no hint: adaptive execution broadcasts the bucket table by its real size
    out = d.join(offs, on=[*part, b], how="inner")
    cols = [c for c in df.columns]
    extra = []
    if rank:
        extra.append((F.col(rn) + F.col("_pfx_off_cnt")).cast("long").alias(rank))
    for name in sums:
        extra.append((F.col(f"_pfx_r_{name}") + F.col(f"_pfx_off_{name}")).alias(name))
    for name in leads:
        extra.append(
            F.when(F.col(rn) == F.col("_pfx_cnt"), F.col("_pfx_next_first").getField(name))
            .otherwise(F.col(f"_pfx_n_{name}"))
            .alias(name)
        )
    if totals:
        extra.append(F.col("_pfx_tot_cnt").cast("long").alias("_total_rows"))
        extra += [F.col(f"_pfx_tot_{n}").alias(f"{n}_total") for n in sums]
    return out.select(*cols, *extra)

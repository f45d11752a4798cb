"""Joins in which one key may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 4096  # rows of one key joined in one task


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, by: Sequence[str], n: str, how: str = "inner", limit: int | None = None) -> DataFrame:
    """``rows`` with what ``per_key`` (one row a key) says of their key; ``n``
    is its column of how many rows the key has. The rows of a key with more
    than ``limit`` are dealt by a hash of ``by`` over several tasks, each of
    which gets a copy of the key's one row. The list of such keys is no longer
    than the rows divided by ``limit``; ``n`` is dropped."""
    parts = F.ceil(F.col(n) / F.lit(limit or ROWS)).cast("long")
    crowd = per_key.where(F.col(n) > (limit or ROWS)).select(key, parts.alias("__parts"))
    left = rows.join(crowd, key, "left").withColumn(
        "__part", F.pmod(F.xxhash64(*by), F.coalesce("__parts", F.lit(1).cast("long")))
    )
    right = per_key.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1)))
    return left.drop("__parts").join(right.drop(n), [key, "__part"], how).drop("__part")

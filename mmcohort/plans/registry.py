"""Query registry: each entry pairs a Spark builder with its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    operators: str


CATALOG: dict[str, Query] = {}


def register(name: str, operators: str, oracle: str | None = None):
    def deco(fn):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Query(name, fn, oracle, operators)
        return fn

    return deco


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round every double column (and double arrays) for engine-independent comparison."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda x: F.round(x.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def r(expr: str, digits: int = 9) -> str:
    """DuckDB text of the same rounding."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"

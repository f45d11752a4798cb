"""Operator 10: exact token-length histogram with suffix sums.

Documents are encoded in tasks and counted by length there; only (length,
count) pairs are shuffled. Suffix sums over the histogram then answer, for any
context limit L, how many documents reach L, the tokens they hold, the tokens
kept when every document is cut at L, and every quantile of the length.

Defined results: null and empty texts have length 0; an empty table gives an
empty histogram; repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mmcohort.llm.tokens import encoder
from mmcohort.session import materialize

RANGE = 1024  # lengths summed together


def length_counts(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """(length, n_docs): the exact histogram of encoded lengths."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = encoder(path), {}
        for b in batches:
            for t in b.column(0):
                s = t.as_py()
                n = len(enc(s)) if s else 0
                total[n] = total.get(n, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["length", "n"]
        )

    part = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "length long, n long")
    return part.groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with running sums from both ends.

    Per length L that occurs: ``n_docs``; ``docs_at_least`` and
    ``tokens_at_least`` (documents of length >= L and their tokens);
    ``docs_at_most``; ``total_docs``, ``total_tokens``; ``truncated_tokens``
    (tokens kept if every document is cut at L); ``quantile`` (share of
    documents of length <= L). Lengths are summed in ranges first, so no task
    sorts the whole histogram.
    """
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("toks")).withColumn(
        "__r", F.floor(F.col("length") / RANGE)
    )
    per = h.groupBy("__r").agg(F.sum("n_docs").alias("__d"), F.sum("toks").alias("__t"))
    low = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # over ranges, not lengths
    every = Window.partitionBy(F.lit(0))
    off = per.select(
        "__r",
        F.coalesce(F.sum("__d").over(low), F.lit(0)).alias("__d0"),
        F.coalesce(F.sum("__t").over(low), F.lit(0)).alias("__t0"),
        F.sum("__d").over(every).alias("total_docs"),
        F.sum("__t").over(every).alias("total_tokens"),
    )
    own = Window.partitionBy("__r").orderBy("length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = h.withColumn("__dc", F.sum("n_docs").over(own)).withColumn("__tc", F.sum("toks").over(own)).join(off, "__r")
    below_d = F.col("__d0") + F.col("__dc") - F.col("n_docs")
    below_t = F.col("__t0") + F.col("__tc") - F.col("toks")
    docs_ge = F.col("total_docs") - below_d
    return j.select(
        "length",
        "n_docs",
        docs_ge.alias("docs_at_least"),
        (F.col("total_tokens") - below_t).alias("tokens_at_least"),
        (below_d + F.col("n_docs")).alias("docs_at_most"),
        "total_docs",
        "total_tokens",
        (below_t + F.col("length") * docs_ge).alias("truncated_tokens"),
        ((below_d + F.col("n_docs")).cast("double") / F.col("total_docs")).alias("quantile"),
    )


def answers(table: DataFrame, limits: list[int], quantiles: list[float]) -> tuple[dict, dict]:
    """Totals for stated context limits, and stated quantiles, read off the
    suffix sums: ``{limit: (documents cut, tokens kept)}``, ``{q: length}``."""
    kept, at = {}, {}
    for x in limits:
        # the first length >= x: all documents below it are shorter than x
        r = table.where(F.col("length") >= x).orderBy("length").limit(1).collect()
        if r:
            r = r[0]
            below = r["total_tokens"] - r["tokens_at_least"]
            over = r["docs_at_least"] - (r["n_docs"] if r["length"] == x else 0)
            kept[x] = (int(over), int(below + x * r["docs_at_least"]))
        else:
            t = table.agg(F.max("total_tokens")).first()[0]
            kept[x] = (0, int(t or 0))
    for q in quantiles:
        r = table.where(F.col("quantile") >= q - 1e-12).agg(F.min("length")).first()[0]
        at[q] = None if r is None else int(r)
    return kept, at


def histogram(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """:func:`suffix_sums` over the written counts: documents are encoded once."""
    return suffix_sums(materialize(length_counts(docs, text_col, path), "lengths"))


def numpy_histogram(lengths: np.ndarray) -> dict[int, tuple]:
    """The same table from plain lengths (for tests)."""
    n, t = len(lengths), int(lengths.sum())
    out = {}
    for x in np.unique(lengths):
        ge = lengths >= x
        out[int(x)] = (
            int((lengths == x).sum()), int(ge.sum()), int(lengths[ge].sum()), int((lengths <= x).sum()),
            n, t, int(np.minimum(lengths, x).sum()),
        )
    return out

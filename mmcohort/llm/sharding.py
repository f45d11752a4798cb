"""Operator 4: hierarchical weighted hash tree sharding (DataFrame functions only).

A row descends region -> rack -> shard. At each level every child draws
``-ln(u) / weight`` with ``u`` in (0, 1) hashed from (child's path, key); the
smallest draw wins, so a child wins in proportion to its weight and a row's
draws never depend on other children. Changing weights in one subtree moves
rows only into or out of that subtree; a new shard that is attached as a region
of its own takes rows from all others and moves nothing else.

Law ``key``: the key and the tree alone decide the shard.

Defined results: a null key is a key of its own (all null keys share a shard);
a null text has no bytes (size 1, CRC 0); repeated rows get a slot each; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 20_000  # rows numbered together in one task's window


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


#: eight equal shards on two regions with two racks each
DEFAULT_TREE: tuple[Leaf, ...] = tuple(Leaf(f"g{s // 4}", f"r{s // 2 % 2}", s) for s in range(8))


def grow(tree: Sequence[Leaf], shard: int, weight: float = 1.0) -> tuple[Leaf, ...]:
    """The tree with one more shard, attached as a region of its own."""
    return (*tree, Leaf(f"g+{shard}", "r0", shard, weight))


def draw(path: str, key: Column, weight: float) -> Column:
    """-ln(u) / weight; u from 52 bits of md5(path|key)."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(path + "|"), key)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _winner(children: list[tuple[str, float]], key: Column) -> Column:
    """Which child has the smallest draw (ties: the earlier child)."""
    if len(children) == 1:
        return F.lit(0)
    draws = [F.struct(draw(p, key, w).alias("d"), F.lit(i).alias("i")) for i, (p, w) in enumerate(children)]
    return F.array_min(F.array(*draws))["i"]


def assign(df: DataFrame, tree: Sequence[Leaf], key: str, out: str) -> DataFrame:
    """Adds ``out``, the shard of each row by the string column ``key`` (no
    nulls). One column a level: a row draws only among the children of the
    node it has reached."""
    if not tree or any(x.weight <= 0 for x in tree):
        raise ValueError("a tree needs leaves of positive weight")
    nodes: dict[tuple, list[Leaf]] = {(): list(tree)}  # path -> leaves below
    node = F.lit(0)
    paths: list[tuple] = [()]
    temp = []
    for depth, part in enumerate(("region", "rack", "shard")):
        below: list[tuple] = []
        pick = None
        for i, path in enumerate(paths):
            groups: dict[str, list[Leaf]] = {}
            for x in nodes[path]:
                groups.setdefault(str(getattr(x, part)), []).append(x)
            kids = [(*path, name) for name in groups]
            nodes |= dict(zip(kids, groups.values()))
            at = F.lit(len(below)) + _winner([("/".join(k), sum(x.weight for x in nodes[k])) for k in kids], F.col(key))
            pick = F.when(node == i, at) if pick is None else pick.when(node == i, at)
            below += kids
        name = f"__{out}{depth}"
        df = df.withColumn(name, pick)
        temp.append(name)
        node, paths = F.col(name), below
    if any(len(nodes[p]) != 1 for p in paths):
        raise ValueError("two leaves of one rack have the same shard number")
    shards = F.array(*[F.lit(nodes[p][0].shard) for p in paths])
    return df.withColumn(out, F.get(shards, node)).drop(*temp)


def hash_order(cols: Sequence[str]) -> Column:
    """md5 of the columns as text: an order that every engine can state."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in cols]).cast("binary"))


def number_within(df: DataFrame, group: str, order: Sequence[str], n_rows: int, slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 in each ``group`` (few values, each may hold any
    share of the rows), in the order of (md5 of the ``order`` columns, these
    columns). Equal rows are counted first, so a row repeated any number of
    times is one row in every shuffle; a group is cut in buckets by the first
    digits of the hash, which are numbered apart, and the buckets' totals give
    the offsets. Rows meet in a bucket by all the ``order`` columns: name what
    tells rows of one id apart."""
    digits = max(1, math.ceil(math.log(max(1, n_rows / ROWS_PER_BUCKET), 16)))
    cols = [c for c in df.columns if c != group]
    counted = df.withColumn("__h", hash_order(order)).groupBy(group, "__h", *cols).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.withColumn("__b", F.substring("__h", 1, digits))
    totals = counted.groupBy(group, "__b").agg(F.sum("__n").alias("__t"))
    running = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = totals.select(group, "__b", (F.sum("__t").over(running) - F.col("__t")).alias("__o"))
    inner = Window.partitionBy(group, "__b").orderBy("__h", *[F.col(f"`{c}`") for c in dict.fromkeys([*order, *cols])]).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = counted.withColumn("__s", F.sum("__n").over(inner) - F.col("__n")).join(offsets, [group, "__b"])
    first = F.col("__o") + F.col("__s")
    return placed.withColumn(slot, F.explode(F.sequence(first, first + F.col("__n") - 1))).select(group, *cols, slot)


def shard(
    docs: DataFrame,
    tree: Sequence[Leaf] = DEFAULT_TREE,
    grown: Sequence[Leaf] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot (in the
    order of :func:`hash_order`), grown_shard.

    Only these narrow columns are shuffled, never the text."""
    grown = grow(tree, max(x.shard for x in tree) + 1) if grown is None else grown
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    text = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    narrow = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        key.alias("__key"),
    )
    narrow = assign(assign(narrow, tree, "__key", "shard"), grown, "__key", "grown_shard").drop("__key")
    return number_within(narrow, "shard", ["doc_id", "size", "text_crc32"], docs.count()).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )

import zlib
from collections import Counter, defaultdict

from mmcohort.llm import sharding
from mmcohort.llm.sharding import Leaf
from pyspark.sql import functions as F


def rows(df):
    return [r.asDict() for r in df.collect()]


def check(out, docs):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs
    )
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 8 and r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_documents(spark, sf_dir, documents):
    out = rows(sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    check(out, documents)


def test_edges(edge_docs, no_docs, monkeypatch):
    docs = [r.asDict() for r in edge_docs.collect()]
    check(rows(sharding.shard(edge_docs)), docs)
    assert rows(sharding.shard(no_docs)) == []
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 2)
    check(rows(sharding.shard(edge_docs)), docs)


def test_one_id_is_spread_over_buckets(spark, monkeypatch):
    """A third of the rows with one id, different texts: no bucket holds them all."""
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 20)
    df = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")
    )
    docs = [r.asDict() for r in df.collect()]
    check(rows(sharding.shard(df)), docs)
    h = [r["h"][0] for r in sharding.shard(df).where("doc_id = 7").select(sharding.hash_order(["doc_id", "size", "text_crc32"]).alias("h")).collect()]
    assert max(Counter(h).values()) < 60


def test_key_alone_decides(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in rows(sharding.shard(docs))}
    part = docs.where("doc_id % 3 = 0").withColumn("text", F.lit("other"))
    for r in rows(sharding.shard(part)):
        assert whole[r["doc_id"]] == (r["shard"], r["grown_shard"])


def place(spark, tree, n=40_000):
    df = spark.range(n).select(F.col("id").cast("string").alias("k"))
    return {r["k"]: r["s"] for r in sharding.assign(df, tree, "k", "s").collect()}


def test_weights_decide_shares_and_confine_movement(spark):
    tree = [Leaf("a", "x", 0, 1), Leaf("a", "x", 1, 3), Leaf("a", "y", 2, 2), Leaf("b", "x", 3, 2)]
    before = place(spark, tree)
    n = Counter(before.values())
    for leaf in tree:
        assert abs(n[leaf.shard] / len(before) - leaf.weight / 8) < 0.01
    # a weight inside region a changes, region a's sum does not: nothing crosses its border
    after = place(spark, [Leaf("a", "x", 0, 2), Leaf("a", "x", 1, 2), *tree[2:]])
    moved = {(before[k], after[k]) for k in before if before[k] != after[k]}
    assert moved == {(1, 0)}
    # a subtree that grows only gains from outside
    after = place(spark, [*tree[:3], Leaf("b", "x", 3, 4)])
    assert {b for k, b in after.items() if b != before[k]} == {3}


def test_growth_moves_only_into_the_new_shard(spark):
    before = place(spark, sharding.DEFAULT_TREE)
    after = place(spark, sharding.grow(sharding.DEFAULT_TREE, 8))
    moved = [k for k in before if before[k] != after[k]]
    assert {after[k] for k in moved} == {8} and abs(len(moved) / len(before) - 1 / 9) < 0.01


def test_no_python_in_the_plan(spark, sf_dir):
    plan = sharding.shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

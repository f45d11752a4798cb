from collections import Counter

import corpus_pipeline as C
import pytest
from mmcohort.llm import jaccard, packing, toxicity
from mmcohort.session import materialize
from test_decontamination import brute as hits
from test_jaccard import brute as components


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in C.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "step")
        out.append(docs)
    return out


def test_stages(spark, sf_dir, documents, steps):
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "packing"]
    rows = [Counter(tuple(r) for r in d.collect()) for d in steps[:3]]
    assert all(d.columns == list(documents[0]) for d in steps[:3])
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores = {r["doc_id"]: r["rejected"] for r in toxicity.report(whole, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    left = [d for d in documents if not scores[d["doc_id"]]]
    assert rows[0] == Counter(tuple(d.values()) for d in left) and len(left) < len(documents)
    keep = {int(c) for _, _, c in components(left, n=5, percent=80)}
    left = [d for d in left if d["doc_id"] in keep]
    assert rows[1] == Counter(tuple(d.values()) for d in left)
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, *_, hit in hits([(d["doc_id"], d["text"]) for d in left], bench) if hit}
    left = [d for d in left if str(d["doc_id"]) not in bad]
    assert bad and rows[2] == Counter(tuple(d.values()) for d in left)
    assert {r["doc_id"] for r in steps[3].collect()} == {d["doc_id"] for d in left}


def test_run(spark, sf_dir, steps):
    key = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(C.run(spark, sf_dir)) == key(steps[-1])


def test_edges(spark, edge_docs, no_docs, sf_dir):
    for docs, n in ((edge_docs, None), (no_docs, 0)):
        for _, stage in C.STAGES[:3]:
            kept = stage(spark, docs, sf_dir)
            assert kept.columns == docs.columns
            docs = materialize(kept, "edge")
        out = C.STAGES[3][1](spark, docs, sf_dir).count()
        assert out == 0 if n == 0 else out > 0
    # of equal texts and repeated rows one stays; documents without words stay all
    kept = sorted(str(r["doc_id"]) for r in jaccard.keep_one(edge_docs, jaccard.join(edge_docs)).collect())
    assert kept == sorted(["1", "2", "3", "4", "None", "None", "5", "7"])
    assert packing.CAPACITY == 2048


def test_near_duplicates_from_four_fifths_on(spark):
    """One passage of 200 words differs: 177 of 215 five-word shingles are shared, 179 of 215 of four."""
    a = [f"w{i}" for i in range(200)]
    b = a[:100] + [f"x{i}" for i in range(15)] + a[115:]
    c = a[:100] + [f"y{i}" for i in range(40)] + a[140:]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((a, b, c), 1)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in C.near_duplicates(spark, docs, "").collect()) == [1, 3]

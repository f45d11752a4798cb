import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from mmcohort.llm import histogram as H
from mmcohort.llm import packing as P
from mmcohort.llm import tokens


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda s: t.encode(s, add_special_tokens=False).ids


ODD = ["", " ", "\n\n  x", "it's  we'll", " é ß", "a" * 3000, " " * 50, "12345 67,890", "emoji 😀👍🏽", "<|endoftext|> x", "\x00\x01", "<|endoftext|>",
       "a b<|endoftext|><|endoftext|>c d e <|endoftext| > <|endoftext|>\n\n<|endoftext|>", "word <|endoftext|> more words " * 9]


def test_ids_equal_the_tokenizer_file(reference, documents):
    enc = tokens.encoder()
    for s in [*ODD, *(d["text"] for d in documents)]:
        assert enc(s).tolist() == reference(s)


def test_long_texts_are_cut_where_pieces_begin(monkeypatch, reference, documents):
    monkeypatch.setattr(tokens, "LONG", 50)
    enc = tokens.encoder()
    for s in [*ODD, *(d["text"] for d in documents[:40])]:
        assert enc(s).tolist() == reference(s)


def pieces(docs, reference, cap):
    out = Counter()
    for d in docs:
        ids = reference(d["text"] or "") + [0]
        lo, hi, k = 0, len(ids) % cap or cap, 0
        while lo < len(ids):
            out[(d["doc_id"], k, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes()))] += 1
            lo, hi, k = hi, hi + cap, k + 1
    return out


def check(df, docs, reference, cap=P.CAPACITY):
    rows = df.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces(docs, reference, cap)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= cap
    return len(seqs), -(-sum(r["length"] for r in rows) // cap)


def test_packing(spark, sf_dir, documents, reference):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, least = check(P.pack(docs), documents, reference)
    assert n <= least * 1.01 + 1
    small = check(P.pack(docs, capacity=64), documents, reference, 64)
    assert small[0] <= small[1] * 1.01 + 1


def test_packing_edges(edge_docs, no_docs, reference):
    check(P.pack(edge_docs), [r.asDict() for r in edge_docs.collect()], reference)
    assert P.pack(no_docs).collect() == []


def test_the_plan_needs_no_python_worker(spark):
    cut = spark.createDataFrame([(1, 0, 0, 3, 9), (2, 0, 0, 5, 8)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    parts = P.place(spark.createDataFrame(cut.toArrow()))
    tree = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "ExternalRDD" not in tree and "LogicalRDD" not in tree, tree
    assert sorted((r["doc_id"], r["sequence_id"], r["offset"]) for r in parts.collect()) == [(1, 0, 5), (2, 0, 0)]


def test_plan_places_every_count():
    rng = np.random.default_rng(0)
    for _ in range(20):
        counts = {int(x): int(rng.integers(1, 5000)) for x in rng.integers(1, 101, 40)}
        ranks, room = Counter(), defaultdict(int)
        for r in P.plan(counts, 100):
            assert r.lo == ranks[r.length]
            ranks[r.length] = r.hi
            for i in range(-(-(r.hi - r.lo) // r.per)):
                k = min(r.per, r.hi - r.lo - i * r.per)
                assert room[r.seq + i] == r.at
                room[r.seq + i] += k * r.length
        assert ranks == counts and max(room.values()) <= 100
    assert P.plan({}, 10) == []
    with pytest.raises(ValueError):
        P.plan({11: 1}, 10)


def test_histogram(spark, sf_dir, documents, reference):
    lengths = np.array([len(reference(d["text"] or "")) for d in documents])
    table = H.histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = {r["length"]: (r["n_docs"], r["docs_at_least"], r["tokens_at_least"], r["docs_at_most"], r["total_docs"],
                         r["total_tokens"], r["truncated_tokens"]) for r in table.collect()}
    assert got == H.numpy_histogram(lengths)
    limits = [0, 1, 5, 128, 1000, 2048, int(lengths.max()), int(lengths.max()) + 1]
    kept, at = H.answers(table, limits, [0.1, 0.5, 0.99, 1.0])
    for x in limits:
        assert kept[x] == (int((lengths > x).sum()), int(np.minimum(lengths, x).sum()))
    for q, v in at.items():
        assert v == np.sort(lengths)[int(np.ceil(q * len(lengths) - 1e-9)) - 1]


def test_histogram_edges(edge_docs, no_docs, reference):
    lengths = np.array([len(reference(r["text"] or "")) for r in edge_docs.collect()])
    got = {r["length"]: r["n_docs"] for r in H.histogram(edge_docs).collect()}
    assert got == dict(Counter(lengths.tolist()))
    assert H.histogram(no_docs).collect() == []

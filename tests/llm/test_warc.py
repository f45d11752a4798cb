import gzip
import hashlib
from collections import Counter, defaultdict

import pytest
from mmcohort.llm import warc as W
from mmcohort.session import scratch_path


def brute(pages, least=W.MIN_BYTES):
    groups = defaultdict(list)
    for i, html in pages:
        groups[(html or "").encode()].append(i)
    out = []
    for i, html in pages:
        body = (html or "").encode()
        top = max((x for x in groups[body] if x is not None), default=None)
        again = len(body) >= least and len(groups[body]) > 1 and top is not None and i != top
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert got(W.round_trip(pages)) == brute([tuple(r) for r in pages.select("page_id", "html").collect()])


@pytest.fixture(scope="module")
def edge_pages(spark):
    big = "<p>é &amp; \r\n\r\n WARC/1.1\r\n</p>" * 60
    rows = [
        (1, "http://a.example/x y", big), (7, None, big), (3, "", big), (None, "u", big), (7, "u", big), (4, "u", "small"),
        (5, "u", "small"), (6, "u", None), (8, "u", ""), (None, "u", big + "!"), (None, "u", big + "!"), (9, "http://é/\n", "x\x00y\n" * 400),
        (10, "u", "WARC/1.0 " * 200_000), (2, "u", "x\x00y\n" * 400),
    ]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, name string, ordinal int")


@pytest.mark.parametrize("block, part, plan", [(W.BLOCK, W.PART_PAGES, W.PLAN_ROWS), (3000, 4, W.PLAN_ROWS), (3000, 4, 0)])
def test_edges(edge_pages, monkeypatch, block, part, plan):
    monkeypatch.setattr(W, "PART_PAGES", part)
    monkeypatch.setattr(W, "PLAN_ROWS", plan)
    monkeypatch.setattr(W.spread, "ROWS", 2)
    want = brute([(r["page_id"], r["html"]) for r in edge_pages.collect()])
    assert got(W.round_trip(edge_pages, block=block)) == want
    assert want[(10, 1_800_000, hashlib.sha1(b"WARC/1.0 " * 200_000).hexdigest(), "response", None)] == 1


def test_no_pages(edge_pages):
    assert W.round_trip(edge_pages.where("false")).collect() == []


def test_archives_are_valid(spark, edge_pages):
    """Both ARC versions are written; every WARC field follows from its ARC record."""
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    W.write_arcs(edge_pages, arcs, block=3000)
    W.convert(spark, arcs, warcs)
    versions, ids = set(), []
    for r in W._read(spark, arcs).collect():
        data = gzip.decompress(bytes(r["content"]))
        versions.add(data.split(b"\n")[1][:1])
        for rec in W.parse_arc(data):
            assert " " not in rec["URL"] and rec["Archive-date"] == "20240101000000"
    assert versions == {b"1", b"2"}
    for r in W._read(spark, warcs).collect():
        data = gzip.decompress(bytes(r["content"]))
        assert data.endswith(b"\r\n\r\n")
        recs = list(W.parse_warc(data))
        assert recs[0][0]["warc-type"] == "warcinfo"
        for f, block in recs[1:]:
            assert f["warc-date"] == "2024-01-01T00:00:00Z" and f["warc-block-digest"] == W.sha1_label(block)
            ids.append((f["warc-type"], f["warc-record-id"], f.get("warc-refers-to")))
    kept = {i for t, i, _ in ids if t == "response"}
    assert all(to in kept for t, _, to in ids if t == "revisit")
    assert len({i for _, i, _ in ids}) == len(ids) == edge_pages.count()  # repeated rows, too


def test_dates_of_pages(spark):
    pages = spark.createDataFrame([(1, "u", "a", "2019-05-06 07:08:09"), (2, "u", "b", None)], "page_id long, url string, html string, at string")
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    W.write_arcs(pages, arcs, date_col="at")
    W.convert(spark, arcs, warcs)
    assert {r["page_id"]: r["warc_date"] for r in W.read_warcs(spark, warcs).collect()} == {1: "2019-05-06T07:08:09Z", 2: "2024-01-01T00:00:00Z"}


def test_no_archive_is_shuffled(spark, edge_pages):
    arcs = scratch_path(spark, "arc")
    W.write_arcs(edge_pages, arcs, block=3000)
    plan = W.materialize(W.revisits(W.arc_index(spark, arcs)), "revisits")
    joined = W._read(spark, arcs).join(W.F.broadcast(plan), "name", "left")
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_arc_parser_by_version():
    for v in (1, 2):
        docs = [b"", b"HTTP/1.1 200 OK\r\n\r\nx\n\ny", b"\n\n", b"no header at all"]
        data = W.arc_head(v, "n", "19990102030405") + b"".join(W.arc_record(v, f"http://e/{i}", "19990102030405", d, 0, "n") for i, d in enumerate(docs))
        recs = list(W.parse_arc(data))
        assert [r["doc"] for r in recs] == docs and recs[1]["URL"] == "http://e/1"
        assert ("Checksum" in recs[0]) == (v == 2)
        with pytest.raises(ValueError):
            list(W.parse_arc(data[:-3]))
    with pytest.raises(ValueError):
        list(W.parse_arc(b"http://e/ 0 1 t 3\nabc\n"))

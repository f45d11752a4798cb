"""Operator 7: legacy archive converter, ARC (versions 1 and 2) to WARC 1.1.

``write_arcs`` files pages as ARC archives; ``convert`` parses ARC archives by
the header line of their version and the declared lengths, and writes WARC
archives with identifiers, timestamps, types and digests made from them;
``read_warcs`` reads WARC archives back. Archives are gzip files of about
``BLOCK`` bytes before compression (a longer record makes one of its own),
written and read by Spark in any folder it can reach, so a lost task writes its
archives again.

A first pass over the archives takes each record's payload digest; records of
equal payloads of at least ``min_bytes`` are settled by an aggregate over the
digests alone, and every archive gets the list of its own revisits. Archives
are filed in folders of about ``PART_PAGES`` pages, and the lists of a folder
are broadcast to the tasks that convert it (their number is checked), so no
archive, payload or page is shuffled.

Defined results: a null html is an empty payload; a null url is filed as
``urn:page``; a null page_id is smaller than any other (a group of null ids
only is all response) and comes back null; repeated rows are filed each, equal
ones of largest page_id are all responses, with record ids of their own (the
first in archive order has the one that revisits refer to); an empty table
gives no archive and an empty result; other columns are ignored. Records carry
the pages' dates (``date_col``), or one stated date.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mmcohort.llm import spread
from mmcohort.session import materialize, scratch_path

BLOCK = 8 << 20
MIN_BYTES = 1000
PART_PAGES = 1 << 20  # pages whose archives share a folder
PLAN_ROWS = 1 << 22  # records a folder's lists may name to be broadcast (some 100 MB); else they are joined
# Fixed values of the formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: [
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length",
    ],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE_UUID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space


def arc_head(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 converter\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    more = [] if version == 1 else ["200", "-", "-", "0", name]
    return " ".join([f"filedesc://{name}", "0.0.0.0", date, "text/plain", *more, str(len(body))]).encode() + b"\n" + body


def arc_record(version: int, url: str, date: str, doc: bytes, offset: int, name: str) -> bytes:
    more = [] if version == 1 else ["200", hashlib.md5(doc).hexdigest(), "-", str(offset), name]
    return " ".join([url, "0.0.0.0", date, "text/html", *more, str(len(doc))]).encode() + b"\n" + doc + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC archive: its header fields by name, and ``doc``."""
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # records are set apart by line ends
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line without end at byte {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if version is None:
            if not line[0].startswith("filedesc:") or not line[-1].isdigit():
                raise ValueError("an ARC archive begins with a filedesc record")
            body = data[end + 1 : end + 1 + int(line[-1])]
            version = int(body.split(b" ", 1)[0])
            names = body.split(b"\n")[1].decode().split(" ")
            if version not in ARC_FIELDS or names != ARC_FIELDS[version]:
                raise ValueError(f"ARC version {version} with fields {names}")
            at = end + 1 + len(body)
            continue
        if len(line) != len(names):
            raise ValueError(f"ARC header line of {len(line)} fields at byte {at}; version {version} has {len(names)}")
        rec = dict(zip(names, line))
        lo, hi = end + 1, end + 1 + int(rec["Archive-length"])
        if hi > len(data):
            raise ValueError(f"ARC record at byte {at} is longer than the archive")
        rec["doc"] = data[lo:hi]
        yield rec
        at = hi


def split_http(doc: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with their empty line, payload)."""
    end = doc.find(b"\r\n\r\n")
    return (doc[: end + 4], doc[end + 4 :]) if doc.startswith(b"HTTP/") and end >= 0 else (b"", doc)


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        k, _, v = line.partition(b":")
        if k.strip().lower() == name.lower().encode():
            return v.strip().decode()
    return None


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def label_hex(label: str) -> str:
    return base64.b32decode(label.partition(":")[2]).hex()


def record_id(page: str | None, digest_hex: str, place: str | None = None) -> str:
    """``place``: of a record that has been filed before, where it stands."""
    name = f"page:{page}:{digest_hex}" + (f":{place}" if place else "")
    return f"<urn:uuid:{uuid.uuid5(_SPACE_UUID, name)}>"


def warc_date(arc_date: str) -> str:
    d = (arc_date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without its closing empty lines."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.1\r\n{head}\r\n".encode() + block


def to_warc(rec: dict, refers_to: int | None, place: str | None = None) -> bytes:
    """The WARC record of an ARC record, a revisit if ``refers_to`` is a page;
    ``place`` tells it from an equal record filed before."""
    head, payload = split_http(rec["doc"])
    page, digest = http_field(head, "X-Page-Id"), hashlib.sha1(payload).hexdigest()
    block = rec["doc"] if refers_to is None else head
    own = record_id(page if refers_to is None else f"{page}>{refers_to}", digest, place)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", own),
        ("WARC-Date", warc_date(rec["Archive-date"])),
        ("WARC-Target-URI", rec["URL"]),
        ("WARC-IP-Address", rec["IP-address"]),
        ("WARC-Payload-Digest", sha1_label(payload)),
        ("WARC-Block-Digest", sha1_label(block)),
    ]
    if refers_to is not None:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(str(refers_to), digest)),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    return warc_record([*fields, ("Content-Type", "application/http; msgtype=response" if head else "text/html")], block)


def warc_info(name: str, date: str) -> bytes:
    block = b"software: ARC converter\r\nformat: WARC File Format 1.1\r\n"
    rid = f"<urn:uuid:{uuid.uuid5(_SPACE_UUID, 'warcinfo:' + name)}>"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Filename", name)]
    return warc_record([*fields, ("Content-Type", "application/warc-fields")], block)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        lo = end + 4
        hi = lo + int(fields["content-length"])
        if hi > len(data):
            raise ValueError(f"WARC record at byte {at} is longer than the archive")
        yield fields, data[lo:hi]
        at = hi


def _write(blocks: DataFrame, path: str, between: str, by: list[str] = ()) -> None:
    """Each row a gzip file of its own, in a folder by ``by``; the bytes go out as they are."""
    blocks.select(F.col("block").cast("string").alias("value"), *by).write.options(
        **{"lineSep": between, "compression": "gzip", "maxRecordsPerFile": "1", "zlib.compress.level": "BEST_SPEED"}
    ).partitionBy(*by).text(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """name (below ``path``, with its folder), content, part (0 without folders)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    part = F.col("part").cast("int") if "part" in files.columns else F.lit(0)
    return files.select(F.regexp_extract("path", r"(?:part=\d+/)?[^/]+$", 0).alias("name"), "content", part.alias("part"))


def write_arcs(
    pages: DataFrame, path: str, date: str = "20240101000000", versions: tuple[int, ...] = (1, 2), block: int = BLOCK,
    date_col: str | None = None,
) -> None:
    """Files pages (page_id, url, html) as ARC archives, versions in turn.
    ``date_col``: when a page was fetched; without it, or where it is null, ``date``."""
    parts_of_all = max(1, -(-pages.count() // PART_PAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        k, parts, size = 0, [], 0

        def out():
            part = pa.array([(task + k) % parts_of_all], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.large_binary()), part], names=["block", "part"])

        for b in batches:
            for page, url, html, when in zip(*(b.column(i) for i in range(4))):
                body = html.as_py() or b""
                own = f"X-Page-Id: {page}\r\n" if page.is_valid else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n"
                if parts and size + len(body) > block:
                    yield out()
                    k, parts, size = k + 1, [], 0
                version, name = versions[(task + k) % len(versions)], f"arc-{task:05d}-{k:05d}"
                if not parts:
                    parts.append(arc_head(version, name, date))
                    size = len(parts[0])
                link = quote(url.as_py() or "urn:page", safe="%/:=&?~#+!$,;'@()*[]")
                parts.append(arc_record(version, link, when.as_py() or date, head.encode() + body, size, name))
                size += len(parts[-1])
        if parts:
            yield out()

    when = F.date_format(F.col(f"`{date_col}`").cast("timestamp"), "yyyyMMddHHmmss") if date_col else F.lit(None).cast("string")
    src = pages.select(
        "page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"), when.alias("when")
    )
    _write(src.mapInArrow(run, "block binary, part int"), path, "\n", ["part"])


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """name, part, ordinal, page_id, bytes, digest of every record: no payloads."""

    def run(batches):
        for b in batches:
            for name, content, part in zip(*(b.column(i) for i in range(3))):
                rows = []
                for i, rec in enumerate(parse_arc(gzip.decompress(content.as_py()))):
                    head, payload = split_http(rec["doc"])
                    page = http_field(head, "X-Page-Id")
                    rows.append((i, None if page is None else int(page), len(payload), hashlib.sha1(payload).hexdigest()))
                if rows:
                    o, p, n, d = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()] * len(o)), pa.array([part.as_py()] * len(o), pa.int32())]
                        + [pa.array(o, pa.int32()), pa.array(p, pa.int64()), pa.array(n, pa.int64()), pa.array(d)],
                        names=["name", "part", "ordinal", "page_id", "bytes", "digest"],
                    )

    return _read(spark, path).mapInArrow(run, "name string, part int, ordinal int, page_id long, bytes long, digest string")


def revisits(index: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """part, name, plan: of each archive (ordinal, page it revisits, whether an
    equal record stands before it), where there is any. A payload or a record
    that many pages share is dealt over several tasks."""
    rows = index.withColumn("__at", F.struct("name", "ordinal"))
    rows = rows.withColumn("__payload", F.concat_ws(":", "digest", "bytes")).withColumn("__record", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "digest"))
    long = rows.where(F.col("bytes") >= min_bytes)
    groups = long.groupBy("__payload").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("k")).where("k > 1 and kept is not null")
    again = spread.spread_join(long, groups, "__payload", ["name", "ordinal"], "k").where("page_id is null or page_id <> kept")
    same = rows.groupBy("__record").agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    twice = spread.spread_join(rows, same, "__record", ["name", "ordinal"], "k").where(F.col("__at") != F.col("first"))
    both = again.select("part", "name", "ordinal", "kept", F.lit(False).alias("twice")).unionByName(
        twice.select("part", "name", "ordinal", F.lit(None).cast("long").alias("kept"), F.lit(True).alias("twice"))
    )
    both = both.groupBy("part", "name", "ordinal").agg(F.max("kept").alias("kept"), F.max("twice").alias("twice"))
    return both.groupBy("part", "name").agg(F.collect_list(F.struct("ordinal", "kept", "twice")).alias("plan"))  # of one archive


def convert(spark: SparkSession, arcs: str, warcs: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes a WARC archive for every ARC archive, folder by folder."""
    index = materialize(arc_index(spark, arcs), "arc-index")
    plan = materialize(revisits(index, min_bytes), "revisits")
    counts = {r["part"]: r["n"] for r in plan.groupBy("part").agg(F.sum(F.size("plan")).alias("n")).collect()}  # a row per folder
    parts = sorted(r["part"] for r in index.select("part").distinct().collect())
    folders = "part" in spark.read.format("binaryFile").load(arcs).columns

    def run(batches):
        for b in batches:
            for name, content, plan in zip(*(b.column(i) for i in range(3))):
                to = {x["ordinal"]: x for x in plan.as_py() or []}
                parts = []
                for i, rec in enumerate(parse_arc(gzip.decompress(content.as_py()))):
                    if not parts:
                        parts.append(warc_info(name.as_py(), warc_date(rec["Archive-date"])))
                    own = to.get(i, {})
                    parts.append(to_warc(rec, own.get("kept"), f"{name.as_py()}#{i}" if own.get("twice") else None))
                if parts:
                    block = b"\r\n\r\n".join(parts)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.large_binary())], names=["block"])

    for part in parts:
        own = plan.where(F.col("part") == part).select("name", "plan")
        own = F.broadcast(own) if counts.get(part, 0) <= PLAN_ROWS else own
        # the folder alone is read; its name goes before the archive's, as in the index
        src = _read(spark, f"{arcs}/part={part}" if folders else arcs).drop("part")
        if folders:
            src = src.withColumn("name", F.concat(F.lit(f"part={part}/"), F.regexp_extract("name", r"[^/]+$", 0)))
        blocks = src.join(own, "name", "left").select("name", "content", "plan")
        _write(blocks.mapInArrow(run, "block binary"), f"{warcs}/part={part}", "\r\n\r\n")
    if not parts:  # an empty folder to read
        _write(spark.createDataFrame([], "block binary"), warcs, "\r\n\r\n")


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """Per response or revisit record: page_id, payload_bytes, payload_digest,
    record_type, refers_to, and record_id, target_uri, warc_date. A response's
    payload is measured and held against its digests; a revisit has those of
    the payload it stands for."""

    def run(batches):
        for b in batches:
            for content in b.column(1):
                rows = []
                for f, block in parse_warc(gzip.decompress(content.as_py())):
                    kind = f["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, payload = split_http(block)
                    digest = label_hex(f["warc-payload-digest"])
                    if sha1_label(block) != f["warc-block-digest"] or (
                        kind == "response" and hashlib.sha1(payload).hexdigest() != digest
                    ):
                        raise ValueError(f"digest of {f['warc-record-id']} does not match")
                    page, to = http_field(head, "X-Page-Id"), f.get("x-refers-to-page-id")
                    n = len(payload) if kind == "response" else int(http_field(head, "Content-Length"))
                    rows.append((
                        None if page is None else int(page), n, digest, kind, None if to is None else int(to),
                        f["warc-record-id"], f["warc-target-uri"], f["warc-date"],
                    ))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * 3
                    cols = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "record_id string, target_uri string, warc_date string"
    )
    names = [x.split()[0] for x in schema.split(", ")]
    return _read(spark, path).mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES, block: int = BLOCK) -> DataFrame:
    """Pages to ARC archives, those to WARC archives, read back."""
    spark = pages.sparkSession
    arcs, warcs = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arcs(pages, arcs, block=block)
    convert(spark, arcs, warcs, min_bytes)
    return read_warcs(spark, warcs)

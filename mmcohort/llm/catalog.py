"""Queries opN_<name> over whole tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mmcohort.llm import (
    ann, decontamination, histogram, html, jaccard, licenses, packing, sharding, spelling, topk, toxicity, trie, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest of every hundredth vector by a hierarchical k-means tree."""
    return ann.search(_t(spark, sf_dir, "embeddings"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a convolutional classifier."""
    return toxicity.report(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))


@query
def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by a tree-structured graphical model."""
    return html.extract(_t(spark, sf_dir, "pages"))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hierarchical weighted hash tree over documents, eight shards, law ``key``."""
    return sharding.shard(_t(spark, sf_dir, "documents"))


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard join of 4-word shingles at 0.85 over documents: component per document."""
    return jaccard.join(_t(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words found in documents by winnowing."""
    return decontamination.report(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages filed as ARC archives, converted to WARC and read back."""
    return warc.round_trip(_t(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing of documents in sequences of 2048 tokens."""
    return packing.pack(_t(spark, sf_dir, "documents"))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and covered template spans of documents."""
    return licenses.scan(_t(spark, sf_dir, "documents"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-length histogram of documents with suffix sums."""
    return histogram.histogram(_t(spark, sf_dir, "documents"))


@query
def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest inner products of every fiftieth vector by block-at-a-time pruning."""
    return topk.search(_t(spark, sf_dir, "embeddings"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of the rebuilt conversations by balanced parentheses per shard."""
    return trie.nodes(_t(spark, sf_dir, "conversations"))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of the words of documents by sorted-list dynamic programming."""
    return spelling.variants(_t(spark, sf_dir, "documents"))


def _winner_sql(paths: list[str], weights: list[float]) -> str:
    draws = ", ".join(
        f"-ln((('0x' || substr(md5('{p}|' || k), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)}) / {float(w)}"
        for p, w in zip(paths, weights)
    )
    return f"(SELECT list_position(l, list_min(l)) - 1 FROM (SELECT [{draws}] AS l))"


def _descend_sql(leaves, path: tuple, parts: tuple) -> str:
    """The shard below ``path`` as nested CASEs over the draws of its children."""
    if not parts:
        return str(leaves[0].shard)
    groups: dict[str, list] = {}
    for x in leaves:
        groups.setdefault(str(getattr(x, parts[0])), []).append(x)
    if len(groups) == 1:
        (name, own), = groups.items()
        return _descend_sql(own, (*path, name), parts[1:])
    chosen = _winner_sql(["/".join((*path, g)) for g in groups], [sum(x.weight for x in own) for own in groups.values()])
    cases = " ".join(f"WHEN {i} THEN {_descend_sql(own, (*path, g), parts[1:])}" for i, (g, own) in enumerate(groups.items()))
    return f"CASE {chosen} {cases} END"


# CRC-32 byte by byte of the hex text h, with the table (WITH tab) by its rule
_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC_TABLE = f"""tab AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, j: {_CRC_STEP}) AS c FROM range(256) g(i)))"""
_CRC = """CAST(xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT)"""


def _sharding_sql() -> str:
    """Draws from md5, CRC-32 of the texts."""
    tree, parts = sharding.DEFAULT_TREE, ("region", "rack", "shard")
    return f"""WITH {_CRC_TABLE},
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, k, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
    {_CRC} AS text_crc32 FROM d, tab),
s AS (SELECT doc_id, k, size, text_crc32, CAST({_descend_sql(tree, (), parts)} AS INTEGER) AS shard,
    CAST({_descend_sql(sharding.grow(tree, 8), (), parts)} AS INTEGER) AS grown_shard FROM e)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(k || '|' || size || '|' || text_crc32), doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot,
  grown_shard FROM s"""


ORACLES["op4_sharding"] = _sharding_sql()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}')"


# links by shared shingles, components by spreading the smallest id
ORACLES["op5_jaccard_join"] = f"""WITH RECURSIVE w AS (
  SELECT doc_id, {_words_sql(r'[^\x20\x09-\x0D]+')} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 85 * (a.n + b.n - k)),
reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT y, c FROM reach JOIN links ON x = reach.doc_id WHERE c < y),
low AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)"""

_ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLES["op6_decontamination"] = f"""WITH d AS (SELECT doc_id, {_words_sql(_ALNUM_WORD)} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, {_words_sql(_ALNUM_WORD)} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, w[i:i + m - 1] AS s FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, w[i:i + m - 1] AS s FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hits AS (SELECT doc_id, item_id, m, i FROM dw JOIN bw USING (m, s)),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM hits GROUP BY doc_id),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN places USING (doc_id)"""

ORACLES["op7_warc"] = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS kept FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM g"""

ORACLES["op11_topk_search"] = """WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(e.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e AS q, e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

# a node is the list of its turns; every node adds to all nodes above it
ORACLES["op12_prefix_trie"] = f"""WITH {_CRC_TABLE},
u AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, list({{'r': role, 'x': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS s FROM u GROUP BY conv_id),
c AS (SELECT conv_id, s, {_CRC} % 9 AS h FROM (SELECT *, hex(encode(CAST(conv_id AS VARCHAR))) AS h FROM t), tab),
r AS (SELECT c.conv_id, list_concat(coalesce(b.s[1:c.h], []), c.s[c.h + 1:]) AS s FROM c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, d, s[1:d] AS k, len(s) = d AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(any_value(k[d].x))) END AS worth,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (d, k)),
up AS (SELECT a AS d, k[1:a] AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(worth) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY 1, 2)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN up USING (d, k) LEFT JOIN n o ON o.d = m.d - 1 AND o.k = m.k[1:m.d - 1]"""

# near words share what is left when a letter goes: from both at one place, or from the longer
ORACLES["op13_spelling_variants"] = f"""WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS doc_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (SELECT run, n, {_CRC} AS c FROM (SELECT *, hex(encode(doc_id || ':' || run)) AS h FROM runs WHERE length(run) >= 7), tab),
made AS (SELECT CASE WHEN c % 31 = 0 THEN substr(run, 1, c % length(run)) || substr(run, c % length(run) + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS v, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(v ORDER BY n DESC, encode(v)) AS v, max(n) AS vn FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN vn >= 10 * w.n THEN v END AS form, CASE WHEN vn >= 10 * w.n THEN vn END AS form_n
  FROM w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f g ON g.word = walk.at WHERE g.form IS NULL"""

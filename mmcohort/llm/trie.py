"""Operator 12: prefix trie of conversations as balanced parentheses per shard.

A conversation becomes one narrow row: a 16-byte digest and the text's bytes
of each turn; texts never leave the first projection. Rows are dealt by
range of (digests, conv_id), so that the members of a node are neighbours, and
equal conversations, however many, run over as many shards as they fill.

A shard writes its trie as balanced parentheses, nodes in preorder. ``Parens``
keeps the excess in blocks under a range min-max tree: ``findclose`` gives the
end of each subtree, a rank directory over "()" its leaves, cumulative arrays
over the preorder its members and savings.

Only the nodes on the paths of a shard's first and last conversation, its
spine, can have members elsewhere. Spine rows carry what hangs below them
outside the spine; equal nodes of all shards merge by key, each merged node is
owed to one of the paths that hold it, and sums from the end of each path give
every path's share of the totals of the nodes above.

Defined results: turns follow by number (null first), turns of one number by
digest; a repeated row is a turn each; null role or text is empty; rows with a
null conv_id belong to no conversation and take no part; an empty table has no
node; other columns are ignored. A conversation is held in one task as 20 bytes
a turn, a shard as about 100 bytes a node; a node's ids are hashed from a
sorted stream.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mmcohort.session import materialize, settled

DIGEST = 16  # bytes a turn
GROUP, HEADS = 5, 9  # conversations c take turns of c - c % GROUP, crc32(c) % HEADS of them
SHARD_TURNS = 100_000  # turns a shard is meant to hold
BLOCK = 64  # parentheses a block of excesses holds
EMPTY = hashlib.sha256(b"").hexdigest()


class Parens:
    """A balanced sequence: 1 opens, 0 closes."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        self.excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int64)
        n_blocks = max(1, -(-self.n // BLOCK))
        self.leaves = 1 << (n_blocks - 1).bit_length()
        padded = np.full(self.leaves * BLOCK, np.iinfo(np.int64).max)
        padded[: self.n] = self.excess
        self.blocks = padded.reshape(-1, BLOCK)
        # heap of minima: node i has the children 2 i and 2 i + 1, blocks are the last level
        self.low = np.full(2 * self.leaves, np.iinfo(np.int64).max)
        self.low[self.leaves :] = self.blocks.min(1)
        step = self.leaves
        while step > 1:
            step //= 2
            self.low[step : 2 * step] = self.low[2 * step : 4 * step].reshape(-1, 2).min(1)
        self.opens = np.flatnonzero(bits)
        pair = np.zeros(self.n + 1, np.int64)
        if self.n:
            pair[1:-1] = bits[:-1] & ~bits[1:].astype(bool)
        self.pairs = np.cumsum(pair)  # "()" that end before place i + 1

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """For each open parenthesis the place that closes it: the next excess below its own."""
        want = self.excess[at] - 1
        out = self._within(at // BLOCK, at % BLOCK + 1, want)
        todo = np.flatnonzero(out < 0)
        node = self.leaves + at[todo] // BLOCK
        climbing = np.ones(len(todo), bool)
        while climbing.any():  # to the first block on the right that gets as low
            right = (node % 2 == 0) & (self.low[np.minimum(node + 1, 2 * self.leaves - 1)] <= want[todo])
            turn = climbing & right
            node[turn] += 1
            climbing &= ~right
            node[climbing] //= 2
        while len(todo) and (down := node < self.leaves).any():
            left = 2 * node
            node = np.where(down, np.where(self.low[np.minimum(left, 2 * self.leaves - 1)] <= want[todo], left, left + 1), node)
        out[todo] = self._within(node - self.leaves, np.zeros(len(todo), np.int64), want[todo])
        return out

    def _within(self, block: np.ndarray, start: np.ndarray, want: np.ndarray) -> np.ndarray:
        """The first place in the block from ``start`` on with that excess, or -1."""
        out = np.full(len(block), -1)
        for lo in range(0, len(block), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            hit = (self.blocks[block[part]] <= want[part, None]) & (np.arange(BLOCK) >= start[part, None])
            out[part] = np.where(hit.any(1), block[part] * BLOCK + hit.argmax(1), -1)
        return out

    def leaf_pairs(self, start: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Rank of leaf pairs: how many "()" lie from ``start`` to ``close``."""
        return self.pairs[close] - self.pairs[start]


class Trie:
    """The trie of sorted conversations (digests, bytes of each turn, id).
    Nodes in preorder, the root first; ``spine[0]``/``spine[1]``: nodes on the
    path of the first and the last conversation."""

    def __init__(self, rows: Iterator[tuple[bytes, np.ndarray, int]]):
        bits, size, parent, depth, low = [1], [0], [-1], [0], [None]
        self.ends: list[list[int]] = [[]]
        stack, before = [0], b""
        self.first: list[int] = []
        self.paths: list[bytes] = [b"", b""]
        for path, sizes, conv in rows:
            shared = _shared(before, path)
            while len(stack) > shared + 1:
                bits.append(0)
                stack.pop()
            for d in range(shared, len(path) // DIGEST):
                node = len(size)
                bits.append(1)
                size.append(int(sizes[d]))
                parent.append(stack[-1])
                depth.append(d + 1)
                self.ends.append([])
                stack.append(node)
            self.ends[stack[-1]].append(conv)
            if not self.first:
                self.first, self.paths[0] = stack[:], path
            before = path
        self.last, self.paths[1] = stack[:], before
        bits += [0] * len(stack)
        self.bits = np.array(bits, np.uint8)
        self.size, self.parent, self.depth = (np.array(x, np.int64) for x in (size, parent, depth))
        n = len(size)
        p = Parens(self.bits)
        close = p.findclose(p.opens)
        self.stop = np.arange(n) + (close - p.opens + 1) // 2  # past the subtree, in preorder
        self.n_leaves = p.leaf_pairs(p.opens, close)
        self.n_children = np.bincount(self.parent[1:], minlength=n)
        ended = np.concatenate([[0], np.cumsum([len(e) for e in self.ends])])
        self.n_convs = ended[self.stop] - ended[:-1]
        saved = np.concatenate([[0], np.cumsum((self.n_convs - 1) * self.size)])
        self.saved = saved[self.stop] - saved[:-1]
        low = [min(e) if e else None for e in self.ends]
        for i in range(n - 1, 0, -1):  # children follow their parents
            q = parent[i]
            if low[q] is None or low[i] < low[q]:
                low[q] = low[i]
        self.low = np.array(low, np.int64)


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two digest strings share from the start."""
    n = min(len(a), len(b)) // DIGEST
    if a[: n * DIGEST] == b[: n * DIGEST]:
        return n
    x, y = (np.frombuffer(s[: n * DIGEST], np.uint64).reshape(n, 2) for s in (a, b))
    return int((x != y).any(1).argmax())


def _ids(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def conversations(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, path (digests), sizes: a row per conversation, its turns in order."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    narrow = turns.select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), F.octet_length(text).alias("size")).alias("t"),
    ).where("conv_id is not null")
    return narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id",
        F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["digest"])), "")).alias("path"),
        F.transform("t", lambda t: t["size"]).alias("sizes"),
    )


def rebuilt(convs: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Each conversation c with its first h turns from conversation c - c % group."""
    base = convs.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"),
        F.substring("path", 1, DIGEST * (heads - 1)).alias("base_path"),
        F.slice("sizes", 1, heads - 1).alias("base_sizes"),
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    none = F.array().cast("array<int>")
    return (
        convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
        .withColumn("h", h)
        .join(base, "base", "left")
        .select(
            "conv_id",
            F.expr(
                f"concat(coalesce(substring(base_path, 1, {DIGEST} * h), X''), substring(path, {DIGEST} * h + 1))"
            ).alias("path"),
            F.concat(
                F.when(F.col("h") > 0, F.coalesce(F.slice("base_sizes", 1, F.col("h")), none)).otherwise(none),
                F.slice("sizes", F.col("h") + 1, F.size("sizes")),
            ).alias("sizes"),
        )
    )


_SHARD = pa.schema(
    [("shard", pa.int32()), ("kind", pa.int32())]  # 0: finished; 1, 2: on the path of the first, the last conversation
    + [("node", pa.binary()), ("parent", pa.binary())]  # keys of spine nodes: digest of the path from the root
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size")]
    + [("ends_sha256", pa.string()), ("ends", pa.string())]
)
_DDL = (
    "shard int, kind int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string, ends string"
)


def _keys(path: bytes) -> list[bytes]:
    """Key of each node of a path, the root's first."""
    h = hashlib.sha256()
    out = [h.digest()[:DIGEST]]
    for i in range(0, len(path), DIGEST):
        h.update(path[i : i + DIGEST])
        out.append(h.copy().digest()[:DIGEST])
    return out


def shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The finished nodes of a sorted partition, then its two paths."""

    def rows():
        for b in batches:
            path, sizes, conv = (b.column(b.schema.get_field_index(c)) for c in ("path", "sizes", "conv_id"))
            at, flat = sizes.offsets.to_numpy(), sizes.values.to_numpy(zero_copy_only=False)
            for i, (p, c) in enumerate(zip(path.to_pylist(), conv.to_pylist())):
                yield p, flat[at[i] : at[i + 1]], c

    t = Trie(rows())
    if not t.first:
        return
    shard = TaskContext.get().partitionId()
    n = len(t.size)
    paths = [t.first, t.last]
    keys = [_keys(p) for p in t.paths]
    spine: dict[int, bytes] = dict(zip(t.first, keys[0])) | dict(zip(t.last, keys[1]))
    own = np.ones(n, bool)
    own[list(spine)] = False
    done = np.flatnonzero(own)
    for lo in range(0, len(done), 1 << 16):
        x = done[lo : lo + (1 << 16)]
        up = t.parent[x].tolist()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(x), shard), pa.int32()), pa.array(np.zeros(len(x)), pa.int32()), pa.nulls(len(x), pa.binary()),
                pa.array([spine.get(q) for q in up], pa.binary()), pa.array(t.low[x]), pa.array(t.depth[x]),
                pa.array(t.low[t.parent[x]], mask=~own[t.parent[x]]), pa.array(t.n_convs[x]), pa.array(t.n_children[x]),
                pa.array(t.n_leaves[x]), pa.array(t.saved[x]), pa.array(t.size[x]),
                pa.array([hashlib.sha256(_ids(t.ends[i]).encode()).hexdigest() if t.ends[i] else EMPTY for i in x.tolist()], pa.string()),
                pa.nulls(len(x), pa.string()),
            ],
            schema=_SHARD,
        )
    # below a spine node, outside the spine: its finished children, their leaves and savings
    kids, leaves, saved = (np.zeros(n, np.int64) for _ in range(3))
    top = done[~own[t.parent[done]]]
    for into, what in ((kids, np.ones(n, np.int64)), (leaves, t.n_leaves), (saved, t.saved)):
        np.add.at(into, t.parent[top], what[top])
    out, seen = [], set()
    for kind in (1, 2):
        for d, node in enumerate(paths[kind - 1]):
            new = node not in seen  # nodes of both paths count once
            seen.add(node)
            one = lambda v: int(v) if new else 0  # noqa: E731, B023
            out.append((
                shard, kind, keys[kind - 1][d], keys[kind - 1][d - 1] if d else None, int(t.low[node]), d, None, one(t.n_convs[node]),
                one(kids[node]), one(leaves[node]), one(saved[node]), int(t.size[node]), None, _ids(t.ends[node]) if new and t.ends[node] else None,
            ))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SHARD)], schema=_SHARD)


def digests(spine: DataFrame) -> DataFrame:
    """node, ends_sha256: the ids of a node in all shards, hashed in order.
    Shards are ranges, so a node's ids ascend from shard to shard; a digest
    must read them in turn and does so as a stream of rows, a shard's each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if key != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
        if state is not None:
            out.append((node, state.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=["node", "ends_sha256"]
        )

    some = spine.where("ends is not null").select("node", "shard", "ends")
    return some.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(run, "node binary, ends_sha256 string")


def merge(spine: DataFrame) -> DataFrame:
    """The spine nodes of all shards as finished nodes, ``node`` kept."""
    path = F.struct("shard", "kind").alias("path")
    nodes = spine.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("size").alias("size"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("kids"),
        F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.min(path).alias("path"),
    )
    below = nodes.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("more"))
    nodes = nodes.join(below.withColumnRenamed("parent", "node"), "node", "left").withColumn(
        "n_children", F.col("kids") + F.coalesce("more", F.lit(0))
    )
    owed = nodes.select(
        "node",
        "path",
        (F.col("leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    up = Window.partitionBy("path").orderBy(F.desc("depth"))
    shares = (
        spine.select("node", "depth", path)
        .join(owed, ["node", "path"], "left")
        .select("node", F.sum(F.coalesce("leaves", F.lit(0))).over(up).alias("leaves"), F.sum(F.coalesce("saved", F.lit(0))).over(up).alias("saved"))
        .groupBy("node")
        .agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    )
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.select("node", "parent", "depth", "conv_id", "n_convs", "n_children")
        .join(shares, "node")
        .join(digests(spine), "node", "left")
        .join(parents, "parent", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    )


OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shards_of(convs: DataFrame, shards: int) -> DataFrame:
    """Finished nodes and paths of all shards of ``convs`` (conv_id, path, sizes)."""
    order = convs.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    return order.mapInArrow(shard_rows, _DDL)


def joined(rows: DataFrame) -> DataFrame:
    """Nodes of the trie from the written rows of its shards."""
    spine = rows.where("kind > 0")
    merged = materialize(merge(spine), "spine")
    done = rows.where("kind = 0").select("shard", "parent", *OUT)
    # children of a spine node learn its smallest member from their own shard's copy of the spine
    ids = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("up"))
    known = spine.select("shard", F.col("node").alias("parent")).distinct().join(ids, "parent")
    near = done.where("parent is not null").join(known, ["shard", "parent"]).withColumn("parent_conv_id", F.col("up"))
    return done.where("parent is null").select(OUT).unionByName(near.select(OUT)).unionByName(merged.select(OUT))


def nodes(
    turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    group: int = GROUP, heads: int = HEADS, shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256: a row per node of the rebuilt conversations."""

    def build() -> DataFrame:
        own = materialize(conversations(turns, id_col, turn_col, role_col, text_col), "conversations")
        convs = materialize(rebuilt(own, group, heads), "rebuilt")
        total = convs.agg(F.sum(F.size("sizes") + 1)).first()[0]
        return shards_of(convs, math.ceil((total or 1) / shard_turns))

    return joined(settled(turns.sparkSession, "shards", build))


def brute(rows: list[tuple], group: int = GROUP, heads: int = HEADS) -> list[tuple]:
    """The same rows from (conv_id, turn, role, text) by plain dictionaries (for tests)."""
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    digest = lambda t: hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()
    seqs = {c: [t[1:] for t in sorted(s, key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))] for c, s in own.items()}
    members: dict[tuple, list[int]] = {}
    for c in sorted(seqs):
        h = zlib.crc32(str(c).encode()) % heads
        s = seqs.get(c - int(math.fmod(c, group)), [])[:h] + seqs[c][h:]
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
        members.setdefault((*s, None), []).append(c)
    ends = {k[:-1]: v for k, v in members.items() if k and k[-1] is None}
    real = {k: v for k, v in members.items() if not k or k[-1] is not None}
    kids: dict[tuple, int] = {}
    for k in real:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    leaves, saved = {k: 0 for k in real}, {k: 0 for k in real}
    for k, v in real.items():
        worth = (len(v) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += worth
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return [
        (v[0], len(k), real[k[:-1]][0] if k else None, len(v), kids.get(k, 0), leaves[k], saved[k], sha(ends.get(k, [])))
        for k, v in real.items()
    ]

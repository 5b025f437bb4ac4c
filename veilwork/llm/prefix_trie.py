"""Tree of shared conversation beginnings, by double-array tries over sorted shards.

1. A turn is the digest of its role and text; a conversation is the row of its turns' digests (``path``), so
   byte order of paths is the order of a walk through the tree. Texts are read once and never shuffled.
2. Paths are sorted over all tasks by (path, conv_id): every task holds a run of neighbouring prefixes, and a
   beginning, or a conversation, that very many share spreads over as many tasks as its rows need.
3. A task cuts its run into shards of bounded size. Each shard numbers its turns densely and packs its tree into
   BASE and CHECK: the child of node s by turn t is BASE[s] + t, and CHECK there is s. All paths of the shard
   walk the arrays together, one turn a step, and add up their nodes; sums over subtrees go back along CHECK.
4. Only nodes on the first and the last path of a shard can lie in other shards as well. Their sums leave the shard
   as two short rows; one pass over these rows in path order closes each shared node when its last path is past.
   Ids that end at shared nodes are packed as sorted pieces of text and hashed piece by piece.

Defined cases: rows with null conv_id take no part; turns are ordered by number, null first, then by digest;
equal rows are turns each; null role or text is empty; a conversation without turns ends at the root; an empty
table has no nodes; other columns are not read. A single conversation is one cell: ``WIDTH`` bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.functions.scale import lookup_join
from veilwork.llm.tables import written

DIGEST = 16  # bytes of SHA-256 that stand for a turn
WIDTH = DIGEST + 4  # and its text's length in bytes, which depends on the turn alone
SHARD_TURNS = 1 << 18
SHARD_ROWS = 1 << 18
PIECE = 1 << 16
TRIES = 64
ROOT_KEY = bytes(DIGEST)
NO_ENDS = hashlib.sha256(b"").digest()
_MANY = np.iinfo(np.int64).max

_ROWS = (
    "kind string, conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends binary, path binary, sums array<bigint>, key binary, piece binary"
)
_SHARED = "key binary, parent_key binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long"
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _turn() -> Column:
    """A turn in ``2 * WIDTH`` hex digits."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.lower(F.hex(F.octet_length(text).cast("long"))), 8, "0"))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t): slim rows in place of texts."""
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), _turn().alias("t"))


def _ordered() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), "t"))), lambda x: x["t"])


def _path(turn_array: Column) -> Column:
    return F.unhex(F.array_join(turn_array, ""))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of the conversations as they are."""
    return turns(conversations).groupBy("conv_id").agg(_path(_ordered()).alias("path"))


def rebuilt_paths(conversations: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, path) of conversations that take their first turns from the first of their group.

    Conversation c starts with the first h = crc32(c) % heads turns of conversation c - c % group and goes on with
    its own turns after the first h. The rows are shuffled once, by group; both sides of the join use that.
    """
    base = F.col("conv_id") - F.col("conv_id") % group
    rows = turns(conversations).withColumn("base", base).repartition("base")
    own = rows.groupBy("base", "conv_id").agg(_ordered().alias("own"))
    first = rows.where("base = conv_id").groupBy("base").agg(F.slice(_ordered(), 1, heads - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    return own.join(first, "base", "left").select("conv_id", _path(F.concat(head, rest)).alias("path"))


class DoubleArray:
    """Tree of sorted, different paths in BASE and CHECK; node 0 is the root, 0 in CHECK its own.

    ``codes`` holds the dense turn ids of all paths one after another, path i from ``first[i]`` to ``first[i + 1]``.
    After the build ``at[d]`` are the nodes of the paths with at least d turns, ``long[d]`` those paths.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray):
        sizes = np.diff(first)
        room = 2 * (len(codes) + 2)
        self.base, self.check, self.free, self.low = np.zeros(room, np.int64), np.full(room, -1), np.ones(room, bool), 1
        self.check[0], self.free[0] = 0, False
        self.longs, self.at = [np.arange(len(sizes))], [np.zeros(len(sizes), np.int64)]
        while len(self.longs[-1]):
            depth, rows, nodes = len(self.longs) - 1, self.longs[-1], self.at[-1]
            on = sizes[rows] > depth
            rows, nodes = rows[on], nodes[on]
            turn = codes[first[rows] + depth]
            self._children(nodes, turn)
            self.longs.append(rows)
            self.at.append(self.step(nodes, turn))
        self.longs.pop()
        self.at.pop()

    def step(self, nodes: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """Children of nodes by turn, -1 where there is none."""
        child = self.base[nodes] + turn
        inside = (child > 0) & (child < len(self.check))
        return np.where(inside & (self.check[np.where(inside, child, 0)] == nodes), child, -1)

    def _children(self, nodes: np.ndarray, turn: np.ndarray) -> None:
        """Place the children of one level; paths are sorted, so those of a node are neighbours."""
        if not len(nodes):
            return
        new = np.ones(len(nodes), bool)
        new[1:] = (nodes[1:] != nodes[:-1]) | (turn[1:] != turn[:-1])
        parent, turn = nodes[new], turn[new]
        starts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        counts = np.diff(np.append(starts, len(parent)))
        for begin, count in zip(starts[counts > 1].tolist(), counts[counts > 1].tolist()):
            self._place(parent[begin], turn[begin : begin + count])
        alone = starts[counts == 1]
        slots = self._slots(len(alone))
        self.base[parent[alone]] = slots - turn[alone]
        self.check[slots], self.free[slots] = parent[alone], False

    def _grow(self, size: int) -> None:
        more = max(size - len(self.check), len(self.check))
        self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
        self.check = np.concatenate([self.check, np.full(more, -1)])
        self.free = np.concatenate([self.free, np.ones(more, bool)])

    def _slots(self, n: int) -> np.ndarray:
        """The n lowest free slots."""
        while True:
            found = np.flatnonzero(self.free[self.low :])[:n] + self.low
            if len(found) == n:
                if n:
                    self.low = int(found[0])
                return found
            self._grow(len(self.check) + n)

    def _place(self, parent: int, turn: np.ndarray) -> None:
        """The first base, of some tries, at which all children fall on free slots; else one behind the last used slot."""
        least, span = int(turn.min()), int(turn.max() - turn.min()) + 1
        offsets = turn - least
        for begin in (np.flatnonzero(self.free[self.low : self.low + 4 * TRIES]) + self.low)[:TRIES].tolist():
            if begin + span <= len(self.free) and self.free[begin + offsets].all():
                break
        else:
            begin = int(np.flatnonzero(~self.free)[-1]) + 1
        if begin + span > len(self.free):
            self._grow(begin + span)
        self.base[parent] = begin - least
        self.check[begin + offsets], self.free[begin + offsets] = parent, False


def _dense(turn: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ids of turns in the order in which a walk by levels first meets them: new siblings get neighbouring ids."""
    if not len(turn):
        return np.zeros(0, np.int64)
    depth = np.arange(len(turn)) - np.repeat(first[:-1], np.diff(first))
    by_level = np.argsort(depth, kind="stable")
    _, seen, ids = np.unique(turn[by_level], return_index=True, return_inverse=True)
    rank = np.empty(len(seen), np.int64)
    rank[np.argsort(seen)] = np.arange(len(seen))
    out = np.empty(len(turn), np.int64)
    out[by_level] = rank[ids]
    return out


class Shard:
    """Rows (path, conv_id) in order, of bounded size, and the sums of their tree."""

    def __init__(self, rows: list[tuple[bytes, int]]):
        self.ids = np.array([c for _, c in rows], np.int64)
        new = [i for i, (p, _) in enumerate(rows) if i == 0 or p != rows[i - 1][0]]
        self.paths, self.begin = [rows[i][0] for i in new], np.array([*new, len(rows)])
        cells = np.frombuffer(b"".join(self.paths), np.dtype([("digest", f"V{DIGEST}"), ("bytes", ">u4")]))
        self.first = np.concatenate([[0], np.cumsum([len(p) // WIDTH for p in self.paths])])
        names = np.ascontiguousarray(cells["digest"]).view(">u8").reshape(-1, 2)
        _, turn = np.unique(names, axis=0, return_inverse=True) if len(names) else (None, np.zeros(0, np.int64))
        self.codes = _dense(turn.ravel(), self.first)
        self.bytes = cells["bytes"].astype(np.int64)
        self._sums()

    def _sums(self) -> None:
        trie = self.trie = DoubleArray(self.codes, self.first)
        size, members = len(trie.check), np.diff(self.begin)
        self.n, self.least, self.own = np.zeros(size, np.int64), np.full(size, _MANY), np.zeros(size, np.int64)
        self.depth, self.ends = np.full(size, -1), np.full(size, -1)
        for depth, (rows, nodes) in enumerate(zip(trie.longs, trie.at)):
            np.add.at(self.n, nodes, members[rows])
            np.minimum.at(self.least, nodes, np.minimum.reduceat(self.ids, self.begin[:-1])[rows] if len(rows) else self.ids[:0])
            self.depth[nodes] = depth
            last = np.diff(self.first)[rows] == depth
            self.ends[nodes[last]] = rows[last]
            if depth:
                self.own[nodes] = self.bytes[self.first[rows] + depth - 1]
        self.shared = np.zeros(size, bool)
        self.edge = [self._nodes(0), self._nodes(len(self.paths) - 1)]
        for nodes in self.edge:
            self.shared[nodes] = True
        self.kids, self.leaves = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.saved = np.where(self.shared, 0, (self.n - 1) * self.own)
        for nodes in reversed(trie.at[1:]):
            nodes = np.unique(nodes)
            self.leaves[nodes] += (self.kids[nodes] == 0) & ~self.shared[nodes]
            inner = nodes[~self.shared[nodes]]  # what lies under a shared node is passed on when that node is closed
            up = trie.check[inner]
            np.add.at(self.kids, up, 1)
            np.add.at(self.leaves, up, self.leaves[inner])
            np.add.at(self.saved, up, self.saved[inner])

    def _nodes(self, path: int) -> np.ndarray:
        """Nodes of a path, the root first."""
        depth = self.first[path + 1] - self.first[path]
        node, out = np.zeros(1, np.int64), [0]
        for d in range(depth):
            node = self.trie.step(node, self.codes[self.first[path] + d : self.first[path] + d + 1])
            out.append(int(node[0]))
        return np.array(out)

    def _text(self, path: int) -> list[bytes]:
        return [b"%d" % c for c in self.ids[self.begin[path] : self.begin[path + 1]].tolist()]

    def _keys(self) -> dict[int, bytes]:
        """Keys of the shared nodes."""
        return {n: key for nodes, path in zip(self.edge, (0, -1)) for n, key in zip(nodes.tolist(), chain(self.paths[path]))}

    def inner(self) -> Iterator[tuple]:
        """Nodes that lie in this shard only."""
        keys = self._keys()
        for node in np.flatnonzero((self.depth > 0) & ~self.shared).tolist():
            up, path = int(self.trie.check[node]), self.ends[node]
            ends = hashlib.sha256(b",".join(self._text(path))).digest() if path >= 0 else NO_ENDS
            known = (None, keys[up]) if self.shared[up] else (int(self.least[up]), None)
            yield ("node", int(self.least[node]), int(self.depth[node]), *known, int(self.n[node]), int(self.kids[node]), int(self.leaves[node]), int(self.saved[node]), ends) + (None,) * 4

    def edges(self) -> Iterator[tuple]:
        """For the first and the last path: sums of its nodes within the shard, each node once; and the ids at shared nodes."""
        done: set[int] = set()
        for path in sorted({0, len(self.paths) - 1}):
            sums = []
            for node in self.edge[path > 0].tolist():
                sums += [0, _MANY, 0, 0, 0] if node in done else [int(x[node]) for x in (self.n, self.least, self.kids, self.leaves, self.saved)]
                done.add(node)
            yield ("edge",) + (None,) * 9 + (self.paths[path], sums, None, None)
        step = PIECE // 21  # a 64-bit number and its comma
        for node, key in self._keys().items():
            if self.ends[node] >= 0:
                texts = self._text(self.ends[node])
                for i in range(0, len(texts), step):
                    yield ("ends", int(texts[i])) + (None,) * 10 + (key, b",".join(texts[i : i + step]))


def chain(path: bytes) -> Iterator[bytes]:
    """Keys of a path's nodes, the root first: each the hash of the one above and the turn."""
    key = ROOT_KEY
    yield key
    for at in range(0, len(path), WIDTH):
        key = hashlib.sha256(key + path[at : at + WIDTH]).digest()[:DIGEST]
        yield key


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ARROW = pa.schema(
    [("kind", pa.string()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends", pa.binary()), ("path", pa.binary()), ("sums", pa.list_(pa.int64())), ("key", pa.binary()), ("piece", pa.binary())]
)
_ARROW_SHARED = pa.schema([("key", pa.binary()), ("parent_key", pa.binary())] + [(c, pa.int64()) for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")])


def _shards(turn_limit: int, row_limit: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int]] = []
        size, last = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            shard = Shard(held)
            for rows in (shard.inner(), shard.edges()):
                part: list[tuple] = []
                for row in rows:
                    part.append(row)
                    if len(part) == 4096:
                        yield _arrow(part, _ARROW)
                        part = []
                yield _arrow(part, _ARROW)
            held.clear()

        for batch in batches:
            for path, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
                more = 0 if held and path == last else len(path) // WIDTH
                if held and (size + more > turn_limit or len(held) >= row_limit):
                    yield from close()
                    size, more = 0, len(path) // WIDTH
                held.append((path, conv))
                size, last = size + more, path
        if held:
            yield from close()

    return task


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edge rows in path order: a shared node is closed when a path comes that does not pass it."""
    stack: list[list] = []  # key, bytes, n, least, kids, leaves, saved
    out: list[tuple] = []
    last = b""

    def close() -> None:
        key, size, n, least, kids, leaves, saved = stack.pop()
        leaves, saved = leaves + (kids == 0), saved + (n - 1) * size
        if stack:
            for at, value in ((4, 1), (5, leaves), (6, saved)):
                stack[-1][at] += value
        out.append((key, stack[-1][0] if stack else None, least, len(stack), n, kids, leaves, saved))

    for batch in batches:
        for path, sums in zip(batch.column("path").to_pylist(), batch.column("sums").to_pylist()):
            same = 0
            while same < min(len(path), len(last)) and path[same : same + WIDTH] == last[same : same + WIDTH]:
                same += WIDTH
            while len(stack) > same // WIDTH + 1:
                close()
            for depth in range(len(path) // WIDTH + 1):
                n, least, kids, leaves, saved = sums[5 * depth : 5 * depth + 5]
                if depth < len(stack):
                    node = stack[depth]
                    node[2:] = node[2] + n, min(node[3], least), node[4] + kids, node[5] + leaves, node[6] + saved
                else:
                    turn = path[WIDTH * (depth - 1) : WIDTH * depth] if depth else b""
                    key = hashlib.sha256(stack[-1][0] + turn).digest()[:DIGEST] if depth else ROOT_KEY
                    stack.append([key, int.from_bytes(turn[DIGEST:], "big"), n, least, kids, leaves, saved])
            last = path
        yield _arrow(out, _ARROW_SHARED)
        out.clear()
    while stack:
        close()
    yield _arrow(out, _ARROW_SHARED)


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of each key to one SHA-256, without holding more than a piece."""
    key, state = None, hashlib.sha256()
    schema = pa.schema([("key", pa.binary()), ("ends", pa.binary())])
    for batch in batches:
        out = []
        for k, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
            if k != key:
                if key is not None:
                    out.append((key, state.digest()))
                key, state = k, hashlib.sha256(piece)
            else:
                state.update(b"," + piece)
        yield _arrow(out, schema)
    if key is not None:
        yield _arrow([(key, state.digest())], schema)


def trie_nodes(path_rows: DataFrame, turn_limit: int = SHARD_TURNS, row_limit: int = SHARD_ROWS) -> DataFrame:
    """Nodes of the tree of (conv_id, path) rows: one row a node, the columns of ``RESULT``."""
    rows = written(path_rows, "paths")  # the sort samples its input: computed once
    sorted_rows = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    parts = written(sorted_rows.select("path", "conv_id").mapInArrow(_shards(turn_limit, row_limit), _ROWS), "shards")
    edges = parts.where("kind = 'edge'").select("path", "sums")
    shared = written(edges.repartition(1).sortWithinPartitions("path").mapInArrow(_merge, _SHARED), "shared")
    pieces = parts.where("kind = 'ends'").select("key", "conv_id", "piece")
    ends = pieces.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "piece").mapInArrow(_hash_pieces, "key binary, ends binary")
    up = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    own = ["conv_id", "depth", "parent_key", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    upper = shared.join(ends, "key", "left").select(*own[:3], F.lit(None).cast("long").alias("parent_conv_id"), *own[4:8], F.coalesce("ends", F.lit(NO_ENDS)).alias("ends"))
    inner = parts.where("kind = 'node'").select(*own)
    known = inner.where("parent_key IS NULL").withColumn("up", F.col("parent_conv_id"))
    asked = inner.where("parent_key IS NOT NULL").union(upper.where("parent_key IS NOT NULL"))
    found = lookup_join(asked, up, ["parent_key"], "conv_id", F.lit(48))
    top = upper.where("parent_key IS NULL").withColumn("up", F.lit(None).cast("long"))
    every = known.unionByName(found).unionByName(top)
    return every.select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.lower(F.hex("ends")).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, **limits) -> DataFrame:
    """Nodes of the conversations as they are."""
    return trie_nodes(paths(conversations), **limits)


def digest(conversations: DataFrame) -> DataFrame:
    """Nodes of the rebuilt conversations."""
    return trie_nodes(rebuilt_paths(conversations))

"""Language-model scores by online logistic mixing of context bit predictors.

A text is its words in lower case (A-Z) with one space between them and a line end after the last. Its bytes are
bits of a Huffman code for the training text, four or five for a usual byte; the text's probability is the product
over all bits.

1. Training documents count, for each context (the last 1, 2, 3, 4 or 6 bytes, or the word so far), how often each
   byte followed; the zeros and ones of the bits of that byte are sums of these. Contexts are told apart by 64-bit
   hashes. Texts go in chunks of ``LOOKUP`` bytes (those that train weights in chunks of ``TRAINED``); a chunk sends
   its distinct pairs of context and byte to tasks by range of contexts, in packed arrays, with how often training
   documents in it have each. A range adds them up and answers each chunk with what followed its contexts in all.
   ``fit`` alone makes a table with a row for each context; its tasks hold up to ``HELD`` pairs before they shuffle.
2. A bit's prediction is the weighted sum of the predictors' log odds. Weights come in sets, gated by how much
   the two longest predictors have seen. A part of the training documents trains them online, against the
   counts of all others; chunks' weights are averaged by use. Scores use the counts of all training documents.
3. The mix is refined adaptively: each document shifts the weights by its own errors, from block to block, and a
   table of how often predictions of each strength came true corrects the outcome.

Beside it, the unigram base: exact counts of all tokens. The ``FREQUENT`` most frequent are sent to all tasks,
all others are joined.

Defined cases: null and empty texts are one line end, and a token, the end; equal rows are documents of their own;
null ids are training documents; without training documents every bit costs one bit; other columns are not read.
Words are told apart by 64-bit hashes as well.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm.java import function
from veilwork.llm.tables import held_out, written
from veilwork.llm.words import Words, chunks, int64, mix, powers, prefix

ORDERS = (1, 2, 3, 4, 6)
PREDICTORS = len(ORDERS) + 1  # and the word so far
LONGEST = ORDERS[-1]
CHUNK = 1 << 18
HASHED = 1 << 21  # bytes of text whose contexts are hashed at once
RANGE = 1 << 23  # bytes of training text for each range of contexts
RANGES = 96  # at least
SCORED = 1 << 19  # bytes of text whose bits are scored at once
LOOKUP = 1 << 23  # bytes of text that ask for their contexts at once; the larger, the fewer ask again
TRAINED = 1 << 21  # the same of texts that train weights
HELD = 1 << 22  # pairs of context and byte that a task holds while it counts
SLICE = 1 << 17  # contexts whose bits are worked out at once
BLOCK = 256
GATES = 64
FREQUENT = 200_000
MIXING_PART = 20  # one in so many training documents trains weights
LIMIT = 12.0
PRIOR = 0.02
SCALE = 340.0
RATE = 0.02
OWN_RATE = 2.0
LEVELS = 49
ANSWER = (np.uint16, np.uint8, np.int64)  # bytes that follow each context; the bytes, and how often each does
CARRIED = ("doc_id", "version", "held_out")  # of each row, beside its text
MIXING = Path(__file__).with_name("Mixing.java")
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_DRAW = np.random.default_rng(2)
_BYTE = _DRAW.integers(1, 1 << 63, 256, dtype=np.uint64)
_NEXT = _DRAW.integers(1, 1 << 63, 256, dtype=np.int64)
_SEEDS = _DRAW.integers(1, 1 << 63, PREDICTORS, dtype=np.uint64)
_END = -1  # stands for the hash of the end token


def plain(texts: list[bytes]) -> list[bytes]:
    """Words in lower case, one space between them, a line end after the last."""
    return [b" ".join(t.split()).lower() + b"\n" for t in texts]


@dataclass
class Code:
    """Bits of each byte, one byte after another: the node of the tree that each bit leaves, and the bit."""

    at: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @classmethod
    def of(cls, times: np.ndarray) -> Code:
        """Huffman code for 256 frequencies; bytes never seen have long codes."""
        heap = [(float(n) + 1e-3, byte, byte) for byte, n in enumerate(times)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        for node in range(256, 511):
            for bit in (0, 1):
                weight, _, child = heapq.heappop(heap)
                parent[child] = (node, bit)
                total = weight if bit == 0 else total + weight
            heapq.heappush(heap, (total, node, node))
        paths = []
        for byte in range(256):
            path, node = [], byte
            while node in parent:
                path.append(parent[node])
                node = parent[node][0]
            paths.append(path[::-1])
        steps = [step for path in paths for step in path]
        at = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
        return cls(at, np.array([n - 256 for n, _ in steps]), np.array([b for _, b in steps], np.int8))

    def __post_init__(self):
        self.size = np.diff(self.at)
        self.rank = np.empty(256, np.int64)  # of the bytes' leaves, from left to right
        self.rank[sorted(range(256), key=lambda byte: self.bit[self.at[byte] : self.at[byte + 1]].tolist())] = np.arange(256)

    def paths(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the bits of each of some bytes begin, and for each bit its place in the code."""
        size = self.size[value]
        bit_at = np.concatenate([[0], np.cumsum(size)])
        return bit_at, np.repeat(self.at[value] - bit_at[:-1], size) + np.arange(bit_at[-1])


class Contexts:
    """Hash of each context of each byte of some texts."""

    def __init__(self, texts: list[bytes]):
        self.buf = buf = np.frombuffer(b"".join(texts), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.place = np.arange(len(buf), dtype=np.int32)
        self.begin = np.repeat(self.at[:-1].astype(np.int32), np.diff(self.at))
        self.sums, self.back = prefix(_BYTE[buf], 0), powers(0, True, len(buf) + 1)
        self.word = np.zeros(len(buf), np.int32)
        self.word[1:] = np.maximum.accumulate(np.where((buf == 32) | (buf == 10), self.place + np.int32(1), np.int32(0)))[:-1]
        self.word = np.maximum(self.word, self.begin)

    def of(self, k: int, place: np.ndarray) -> np.ndarray:
        """Of one predictor, at some places."""
        low = np.maximum(place - ORDERS[k], self.begin[place]) if k < len(ORDERS) else self.word[place]
        return mix((self.sums[place] - self.sums[low]) * self.back[low] + _SEEDS[k]).view(np.int64)

    def __iter__(self) -> Iterator[np.ndarray]:
        for k in range(PREDICTORS):
            yield self.of(k, self.place)

    def keys(self) -> np.ndarray:
        """A key of each place, alike where the byte and all its contexts are: the last bytes, and the word where it is longer."""
        padded = np.concatenate([np.zeros(8, np.uint8), self.buf])
        key = np.ndarray(len(self.buf), "<u8", padded, 1, (1,)) >> np.uint64(8)  # the byte and six before it
        size = np.diff(self.at)
        for back in range(LONGEST):  # bytes before the text are not its own
            place = self.at[:-1][size > back] + back
            key[place] = key[place] >> np.uint64(8 * (LONGEST - back)) | np.uint64(LONGEST - back << 56)
        long = np.flatnonzero(self.place - self.word > LONGEST)
        key[long] = mix(key[long] ^ self.of(PREDICTORS - 1, long).view(np.uint64))
        return key.view(np.int64)


def _pairs(context: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the pair of context and byte at each place, and the first place of each pair."""
    return _numbered(context ^ _NEXT[value])


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which, kinds = pd.factorize(keys)
    first = np.empty(len(kinds), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return which, first


def _runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``limit`` bytes."""
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


class Places:
    """Places of some texts that differ in byte or context, and their distinct pairs of context and byte, sorted by context.

    Byte i of the texts is at place ``which[i]``; predictor k has pair ``pair[k][p]`` at place p."""

    def __init__(self, texts: list[bytes], counted: np.ndarray | None = None):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        runs = list(_runs(self.size.tolist(), HASHED))
        self.which = np.empty(self.at[-1], np.int32)
        keys, starts, times = [], [], []
        for a, b in runs:
            own = Contexts(texts[a:b])
            number, first = _numbered(key := own.keys())
            self.which[self.at[a] : self.at[b]] = number
            keys.append(key[first])
            starts.append(first)
            if counted is not None:
                times.append(np.bincount(number, weights=np.repeat(counted[a:b], self.size[a:b]), minlength=len(first)))
        ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        keys = np.concatenate(keys or [np.zeros(0, np.int64)])
        number, first = _numbered(keys)
        number = number.astype(np.int32)
        for (a, b), low in zip(runs, ends):
            cut = slice(self.at[a], self.at[b])
            self.which[cut] = number[low:][self.which[cut]]
        n = np.bincount(number, weights=np.concatenate(times), minlength=len(first)) if times else np.zeros(len(first))
        del keys, number, times
        contexts, values = [[] for _ in range(PREDICTORS)], []
        for (a, b), low, high, start in zip(runs, ends, ends[1:], starts):
            own = Contexts(texts[a:b])
            place = start[first[np.searchsorted(first, low) : np.searchsorted(first, high)] - low]
            values.append(own.buf[place])
            for k, found in enumerate(contexts):
                found.append(own.of(k, place))
        self.value = np.concatenate(values or [np.zeros(0, np.uint8)])
        contexts = [np.concatenate(c or [np.zeros(0, np.int64)]) for c in contexts]
        self.pair, pairs = [None] * PREDICTORS, [None] * PREDICTORS
        for k in (PREDICTORS - 1, *range(len(ORDERS))[::-1]):  # a longer context tells the shorter ones
            if k >= len(ORDERS) - 1:
                here, up, value, sums = slice(None), None, self.value, n
            number, first = _pairs(contexts[k][here], value)
            sums = np.bincount(number, weights=sums, minlength=len(first))
            self.pair[k] = (number if up is None else number[up]).astype(np.int32)
            pairs[k] = contexts[k][here][first], value[first], sums
            here, up, value = np.arange(len(self.value))[here][first], self.pair[k], value[first]
            contexts[k] = None
        context, self.byte, times = (np.concatenate(c) for c in zip(*pairs))
        context = context.view(np.uint64)
        turn = np.argsort(context, kind="stable")
        where = np.empty(len(turn), np.int32)
        where[turn] = np.arange(len(turn), dtype=np.int32)
        low = 0
        for k in range(PREDICTORS):
            self.pair[k] = where[self.pair[k] + np.int32(low)]
            low += len(pairs[k][0])
        self.context, self.byte, self.times = context[turn].view(np.int64), self.byte[turn], times[turn].astype(np.int64)

    def inputs(self, cut: slice, model: Model, begin: np.ndarray, values: np.ndarray) -> Inputs:
        """Of the bytes in ``cut``; the pairs' bits are ``values`` from ``begin`` on."""
        number, places = pd.factorize(self.which[cut])
        value = self.value[places]
        own_at, path = model.code.paths(value)
        size, along = np.diff(own_at), np.arange(own_at[-1])
        odds, low = np.empty((len(along), PREDICTORS), np.float32), []
        for k, pair in enumerate(self.pair):
            found = values[np.repeat(begin[pair[places]] - own_at[:-1], size) + along]
            odds[:, k] = found >> 3
            low.append(found & 7)
        odds /= np.float32(SCALE)
        gate = low[-2] * 8 + low[-1]
        bit_at = np.concatenate([[0], np.cumsum(size[number])])
        row = np.repeat(own_at[:-1][number] - bit_at[:-1], size[number]) + np.arange(bit_at[-1])
        return Inputs(odds, gate, model.code.bit[path], row, bit_at)


@dataclass
class Inputs:
    """Bits of some bytes: those of byte i are the rows ``row[bit_at[i]:bit_at[i + 1]]``."""

    odds: np.ndarray  # row, predictor
    gate: np.ndarray
    bit: np.ndarray
    row: np.ndarray
    bit_at: np.ndarray

    def mixed(self, weights: np.ndarray) -> np.ndarray:
        """Of each row."""
        return sum(w[self.gate] * self.odds[:, k] for k, w in enumerate(weights.astype(np.float32)))


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: how often each byte occurs in plain texts."""
    total = np.zeros(256, np.int64)
    for _, texts in chunks(batches, CHUNK):
        total += np.bincount(np.frombuffer(b"".join(plain(texts)), np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["byte", "n"])


def _added(counts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(context, byte, n, mixing) with each pair of context and byte once."""
    context, byte, n, mixing = (np.concatenate(column) for column in zip(*counts))
    which, first = _pairs(context, byte)
    return context[first], byte[first], *(np.bincount(which, weights=times, minlength=len(first)).astype(np.int64) for times in (n, mixing))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: how often each byte followed each context; in all documents and in those that train weights."""

    def rows() -> Iterator[pa.RecordBatch]:
        for counts in held:
            if counts:
                context, byte, n, mixing = _added(counts)
                yield pa.RecordBatch.from_pydict({"context": context, "byte": byte.astype(np.int64), "n": n, "mixing": mixing})

    held, size = [[] for _ in range(PREDICTORS)], 0
    for batch, texts in chunks(batches, HASHED):
        own = Contexts(plain(texts))
        mixing = np.repeat(np.asarray(batch.column("mixing"), bool), np.diff(own.at))
        for counts, context in zip(held, own):
            which, first = _pairs(context, own.buf)
            n = [np.bincount(w, minlength=len(first)) for w in (which, which[mixing])]
            counts.append((context[first], own.buf[first], *n))
            size += len(first)
        del own, context, which, first, n  # not beside the sums
        if size > HELD:
            for counts in held:
                counts[:] = [_added(counts)]
            size = sum(len(counts[0][0]) for counts in held)
            if size > HELD * 3 // 4:
                yield from rows()
                held, size = [[] for _ in range(PREDICTORS)], 0
    yield from rows()


def _asked(batch: pa.RecordBatch) -> np.ndarray:
    """Distinct contexts of all texts of a batch."""
    found = zip(*([pd.unique(context) for context in Contexts(plain(texts))] for _, texts in chunks(iter([batch]), HASHED)))
    return np.concatenate([pd.unique(np.concatenate(parts)) for parts in found])


def _chunked(limit: int):
    """Task: its rows with the chunk they are in; the first row of a chunk has the distinct contexts of all its texts."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch, texts in chunks(batches, limit):
            asked = _asked(batch)
            ends = np.full(len(texts) + 1, len(asked), np.int32)
            ends[0] = 0
            out = batch.append_column("chunk", pa.array(np.full(len(texts), chunk)))
            yield out.append_column("contexts", pa.ListArray.from_arrays(pa.array(ends), pa.array(asked)))
            chunk += 1

    return task


def in_chunks(rows: DataFrame, limit: int) -> DataFrame:
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return written(rows.mapInArrow(_chunked(limit), f"{schema}, chunk long, contexts array<bigint>"), "chunks")


def looked_up(rows: DataFrame, table: DataFrame, seen: str) -> DataFrame:
    """(asking, context, seen): what the table has for the contexts of each chunk."""
    asked = rows.select(F.col("chunk").alias("asking"), F.explode("contexts").alias("context"))
    return asked.join(table.select("context", F.col(seen).alias("seen")), "context").select("asking", "context", "seen")


def table_of(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    odds = np.clip(np.log((ones + PRIOR) / (zeros + PRIOR)), -LIMIT, LIMIT)
    seen = np.minimum(7, np.log2(zeros + ones + 1)).astype(np.int16)
    return np.rint(odds * SCALE).astype(np.int16) * np.int16(8) + seen


@dataclass
class Tables:
    """Log odds and how much they rest on, in 16 bits, for each node of each context; 0 for what was never seen."""

    context: np.ndarray  # sorted
    node: np.ndarray  # place of the context * 256 + node, sorted
    value: np.ndarray

    @classmethod
    def from_seen(cls, found: pa.Table, code: Code) -> Tables:
        """From contexts and what followed each, as times * 256 + byte."""
        times = found.column("seen").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(times), np.int64))])
        return cls.from_lists(found.column("context").to_numpy(), ends, np.asarray(times.flatten(), np.int64), code)

    @classmethod
    def from_lists(cls, context: np.ndarray, ends: np.ndarray, seen: np.ndarray, code: Code) -> Tables:
        order = np.argsort(context)
        nodes, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int16)]
        for low in range(0, len(order), SLICE):
            own = order[low : low + SLICE]
            size = ends[own + 1] - ends[own]
            begin = np.concatenate([[0], np.cumsum(size)])
            part = seen[np.repeat(ends[own] - begin[:-1], size) + np.arange(begin[-1])]
            bit_at, path = code.paths(part & 255)
            node = np.repeat(np.repeat(np.arange(low, low + len(own)), size), np.diff(bit_at)) * 256 + code.node[path]
            n, bit = np.repeat(part >> 8, np.diff(bit_at)), code.bit[path]
            turn = np.argsort(node)
            node, n, bit = node[turn], n[turn], bit[turn]
            first = np.flatnonzero(np.diff(node, prepend=-1))
            if len(first):
                nodes.append(node[first])
                values.append(table_of(np.add.reduceat(n * (bit == 0), first), np.add.reduceat(n * bit, first)))
        return cls(context[order], np.concatenate(nodes), np.concatenate(values))

    def of(self, context: np.ndarray, value: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of context and byte: where the bits of each begin, and what there is for each bit."""
        bit_at, path = code.paths(value)
        if not len(self.node):
            return bit_at[:-1], np.zeros(bit_at[-1], np.int16)
        place = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        place = np.where(self.context[place] == context, place, len(self.context))
        node = np.repeat(place, np.diff(bit_at)) * 256 + code.node[path]
        at = np.minimum(np.searchsorted(self.node, node), len(self.node) - 1)
        return bit_at[:-1], np.where(self.node[at] == node, self.value[at], np.int16(0))


@dataclass
class Model:
    code: Code
    weights: np.ndarray  # predictor, gate
    refined: np.ndarray  # what predictions of each strength came to, or the strength itself
    tables: Tables | None = None  # of the contexts that are asked for

    def of(self, found: pa.Table) -> Model:
        return Model(self.code, self.weights, self.refined, Tables.from_seen(found, self.code))

    def asked(self, places: Places) -> tuple[np.ndarray, np.ndarray]:
        """Where the bits of each pair begin, and what the tables have for them."""
        return self.tables.of(places.context, places.byte, self.code)


def _level(mixed: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(mixed, np.float32(-LIMIT), np.float32(LIMIT)) * np.float32(2)).astype(np.int64) + LEVELS // 2


def _chance(mixed: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(mixed, np.float32(-LIMIT), np.float32(LIMIT))))


def _train_weights(model):
    """Chunk: online steps over its documents; weights times their use, and their use."""

    def task(rows: pa.Table, found: pa.Table) -> pa.Table:
        weights = model.value.weights.copy()
        squares, use = np.full(weights.shape, 1e-4), np.zeros(GATES)
        texts = [text for _, texts in chunks(iter(rows.to_batches())) for text in texts]
        begin, values = model.value.of(found).asked(places := Places(plain(texts)))
        for low, high in _runs([len(t) for t in texts], CHUNK // 8):
            own = places.inputs(slice(places.at[low], places.at[high]), model.value, begin, values)
            odds, gate, truth = own.odds[own.row], own.gate[own.row].astype(np.int64), own.bit[own.row]
            for a in range(0, len(gate), 4096):
                cut = slice(a, a + 4096)
                g, x = gate[cut], odds[cut].T
                wrong = truth[cut] - _chance(sum(w[g] * o for w, o in zip(weights.astype(np.float32), x)))
                times = np.bincount(g, minlength=GATES)
                use += times
                for k in range(PREDICTORS):
                    slope = np.bincount(g, weights=wrong * x[k], minlength=GATES) / np.maximum(1, times)
                    squares[k] += slope**2
                    weights[k] += RATE * slope / np.sqrt(squares[k])
        gates = np.tile(np.arange(GATES), PREDICTORS)
        return pa.Table.from_pydict({
            "k": np.repeat(np.arange(PREDICTORS), GATES), "gate": gates, "total": (weights * use).ravel(), "use": np.tile(use, PREDICTORS),
        })

    return task


def _strengths(model):
    """Chunk: predictions of each strength, and how many came true."""

    def task(rows: pa.Table, found: pa.Table) -> pa.Table:
        n, ones = np.zeros(LEVELS), np.zeros(LEVELS)
        places = Places([p for _, texts in chunks(iter(rows.to_batches())) for p in plain(texts)])
        begin, values = model.value.of(found).asked(places)
        for low, high in _runs(places.size.tolist(), CHUNK):
            own = places.inputs(slice(places.at[low], places.at[high]), model.value, begin, values)
            level, times = _level(own.mixed(model.value.weights)), np.bincount(own.row, minlength=len(own.bit))
            n += np.bincount(level, weights=times, minlength=LEVELS)
            ones += np.bincount(level, weights=times * own.bit, minlength=LEVELS)
        return pa.Table.from_pydict({"level": np.arange(LEVELS), "n": n, "ones": ones})

    return task


def pack(*columns: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed."""
    planes = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)
    return np.array([len(c) for c in columns], np.int64).tobytes() + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, *kinds: type) -> list[np.ndarray]:
    sizes, out, low = np.frombuffer(data, np.int64, len(kinds)), [], 0
    total = int(sum(n * np.dtype(kind).itemsize for n, kind in zip(sizes, kinds)))
    planes = np.frombuffer(pa.decompress(data[8 * len(kinds) :], total, "zstd", asbytes=True), np.uint8)
    for n, kind in zip(sizes.tolist(), kinds):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(planes[low : low + n * width].reshape(width, n).T).reshape(-1).view(kind))
        low += n * width
    return out


def _zipped(limit: int):
    """Task: its rows in chunks: their columns but text, and what Mixing.java reads: texts, and whether they are counted, packed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch, texts in chunks(batches, limit):
            sizes = np.array([len(t) for t in texts], np.int32)
            counted = ~np.asarray(batch.column("held_out"), bool)
            data = b"".join([np.int32(len(texts)).tobytes(), sizes.tobytes(), counted.tobytes(), *texts])
            packed = np.int32(len(data)).tobytes() + pa.Codec("zstd", 5).compress(data, asbytes=True)
            own = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), batch.column(c)) for c in CARRIED]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), *own, pa.array([packed], pa.binary())], names=["chunk", *CARRIED, "packed"])
            chunk += 1

    return task


def zipped(rows: DataFrame, limit: int) -> DataFrame:
    lists = ", ".join(f"{name} array<{kind}>" for name, kind in rows.select(*CARRIED).dtypes)
    return written(rows.mapInArrow(_zipped(limit), f"chunk long, {lists}, packed binary"), "chunks")


def unzipped(packed: bytes) -> list[bytes]:
    """The texts of a chunk."""
    data = pa.decompress(packed[4:], int(np.frombuffer(packed, np.int32, 1)[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(data, np.int32, 1)[0])
    at = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.int32, n, 4), dtype=np.int64)]) + 4 + 5 * n
    return [data[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a job is removed as soon as the job ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def _task(spark: SparkSession, task: str, returns: str, ranges: int = 1, model: Model | None = None) -> Callable[..., Column]:
    """A task of Mixing.java, as a function of columns."""
    model = model or _unsettled(Code.of(np.zeros(256)))
    numbers = [[ranges], model.code.at, model.code.node, model.code.bit, model.weights.ravel(), model.refined]
    return function(spark, MIXING, task, np.concatenate(numbers).astype("<f8").tobytes(), returns)


def _sums(rows: DataFrame, values: Column) -> np.ndarray:
    """Arrays of the rows added up, place by place."""
    found = rows.select(F.posexplode(values).alias("place", "n")).groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").collect()
    return np.array([row["n"] for row in found])


def bit_values(context: np.ndarray, byte: np.ndarray, size: np.ndarray, follows: np.ndarray, n: np.ndarray, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """As ``Tables.of``, for all pairs of a chunk, sorted by context: ``size`` bytes follow each of its contexts, ``n`` times each."""
    begin = code.paths(byte)[0]
    values = np.zeros(begin[-1], np.int16)
    ends = np.append(np.flatnonzero(np.diff(context, prepend=~context[:1])), len(context))
    lists = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    for low in range(0, len(size), SLICE):
        high = min(low + SLICE, len(size))
        pairs, found = slice(ends[low], ends[high]), slice(lists[low], lists[high])
        own = np.repeat(np.arange(high - low), np.diff(ends[low : high + 1]))
        of = np.repeat(np.arange(high - low), size[low:high])
        value = np.concatenate([byte[pairs], follows[found]])
        times = np.concatenate([np.zeros(len(own), np.int64), n[found]])
        out = np.concatenate([begin[pairs], np.full(len(of), -1)])
        group = np.concatenate([own, of])
        turn = np.argsort(group * 256 + code.rank[value])  # what is below a node lies side by side
        value, times, out, group = value[turn], times[turn], out[turn], group[turn]
        left, step = code.size[value], code.at[value]
        while len(group):
            starts = np.flatnonzero(np.diff(group, prepend=-1))
            bit = code.bit[step]
            ones = np.add.reduceat(times * bit, starts)
            found = np.repeat(table_of(np.add.reduceat(times, starts) - ones, ones), np.diff(np.append(starts, len(group))))
            asked = out >= 0
            values[out[asked]] = found[asked]
            group = group * 2 + bit
            out, left, step = out + np.where(asked, 1, 0), left - 1, step + 1
            more = left > 0
            if not more.all():
                group, times, out, left, step = (column[more] for column in (group, times, out, left, step))
            group = np.cumsum(np.diff(group, prepend=-1) != 0)
    return begin[:-1], values


def _byte_code(train: DataFrame) -> Code:
    """Code for the bytes of plain texts."""
    times = np.zeros(256)
    for row in train.select("text").mapInArrow(_byte_counts, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        times[row["byte"]] = row["n"]
    return Code.of(times)


def _mixing(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(MIXING_PART)) == 0


def _unsettled(code: Code) -> Model:
    """Model without tables, all weights alike and strengths as they are."""
    return Model(code, np.full((PREDICTORS, GATES), 1.5 / PREDICTORS), _chance((np.arange(LEVELS) - LEVELS // 2) / 2))


def _weigh(model: Model, total: np.ndarray, use: np.ndarray) -> None:
    model.weights = np.where(use > 0, total / np.maximum(use, 1), model.weights)


def _refine(model: Model, n: np.ndarray, ones: np.ndarray) -> None:
    model.refined = (ones + 64 * model.refined) / (n + 64)


def fit_chunks(rows: DataFrame) -> tuple[Model, int, DataFrame, DataFrame]:
    """Model of the rows that are not held out, but for its tables; the number of ranges; all rows in chunks; and (chunk,
    found): the answers of all ranges to each chunk. Nothing but texts, distinct pairs and answers is kept."""
    spark = rows.sparkSession
    train = rows.where(~F.col("held_out"))
    all_chunks, part = zipped(rows, LOOKUP), zipped(train.where(_mixing(["doc_id", "text"])), TRAINED)
    times = _sums(all_chunks, _task(spark, "times", "array<bigint>")("packed"))
    model = _unsettled(Code.of(times if len(times) else np.zeros(256)))
    ranges = int(max(RANGES, times.sum() // RANGE))
    cell = _task(spark, "cells", "array<struct<range: int, cell: binary>>", ranges)
    cells = [table.select("chunk", F.lit(trains).alias("trains"), F.inline(cell("packed"))) for table, trains in ((all_chunks, False), (part, True))]
    asked = cells[0].union(cells[1]).groupBy("range").agg(F.collect_list(F.struct("chunk", "trains", "cell")).alias("cells"))
    answer = _task(spark, "answers", "array<struct<chunk: bigint, trains: boolean, answer: binary>>")
    answers = written(asked.select("range", F.inline(answer("cells"))), "answers")
    of = lambda trains: answers.where(F.col("trains") == trains).groupBy("chunk").agg(F.collect_list(F.struct("range", "answer")).alias("found"))
    known = part.select("chunk", "packed").join(of(True), "chunk")
    learned = _sums(known, _task(spark, "train", "array<double>", ranges, model)("packed", "found"))
    if len(learned):
        learned = learned.reshape(-1, GATES)
        _weigh(model, learned[:-1], learned[-1])
        _refine(model, *_sums(known, _task(spark, "strengths", "array<double>", ranges, model)("packed", "found")).reshape(2, LEVELS))
    return model, ranges, all_chunks, of(False)


def _settled(code: Code, part: DataFrame, found: DataFrame) -> Model:
    """Model without tables: weights trained on the chunks of ``part``, given what was found for each, and strengths refined."""
    sent, model = part.sparkSession.sparkContext.broadcast, _unsettled(code)
    part = part.groupBy("chunk")
    total, use, n, ones = np.zeros(model.weights.shape), np.zeros(GATES), np.zeros(LEVELS), np.zeros(LEVELS)
    sums = part.cogroup(found).applyInArrow(_train_weights(sent(model)), "k long, gate long, total double, use double")
    for row in sums.groupBy("k", "gate").agg(F.sum("total").alias("total"), F.sum("use").alias("use")).collect():
        total[row["k"], row["gate"]], use[row["gate"]] = row["total"], row["use"]
    _weigh(model, total, use)
    levels = part.cogroup(found).applyInArrow(_strengths(sent(model)), "level long, n double, ones double")
    for row in levels.groupBy("level").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect():
        n[row["level"]], ones[row["level"]] = row["n"], row["ones"]
    _refine(model, n, ones)
    return model


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """Model of the texts of ``train`` but for its tables, and (context, seen, before): how often each byte followed
    each context in all of them, and in those that do not train weights."""
    code = _byte_code(train)
    mixing = _mixing(train.columns)
    counts = train.select("text", mixing.alias("mixing")).mapInArrow(_seen, "context long, byte long, n long, mixing long").repartition("context")
    counts = counts.groupBy("context", "byte").agg(F.sum("n").alias("n"), F.sum("mixing").alias("mixing"))
    table = written(counts.groupBy("context").agg(
        F.collect_list(F.expr("n * 256 + byte")).alias("seen"), F.collect_list(F.expr("CASE WHEN n > mixing THEN (n - mixing) * 256 + byte END")).alias("before"),
    ), "contexts")
    part = in_chunks(train.where(mixing).select("text"), TRAINED)
    found = written(looked_up(part, table, "before"), "found").groupBy("asking")
    return _settled(code, part.select("chunk", "text"), found), table


def learn(train: DataFrame) -> Model:
    """Model of a small ``train`` with all its tables, which come to the driver whole; ``score`` leaves them in Spark."""
    model, table = fit(train)
    return model.of(table.select("context", "seen").toArrow())


def log_chances(texts: list[bytes], model: Model) -> np.ndarray:
    """log10 of the probability of each text in its plain form."""
    places = Places(texts)
    return scored(places, model, *model.asked(places))


def scored(places: Places, model: Model, begin: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The same, given the bits of the pairs."""
    out = np.zeros(len(places.size))
    for low, high in _runs(places.size.tolist(), SCORED):
        at = places.at[low : high + 1] - places.at[low]
        own = places.inputs(slice(places.at[low], places.at[high]), model, begin, values)
        mixed, bit = own.mixed(model.weights)[own.row], own.bit.astype(np.float32)[own.row]
        for a, b in zip(at, at[1:]):
            if b - a > BLOCK:
                _shift(mixed, bit, own, own.bit_at[[*range(a, b, BLOCK), b]])
        final = (_chance(mixed) + model.refined[_level(mixed)]) / 2
        of_byte = np.multiply.reduceat(np.where(bit == 1, final, 1 - final), own.bit_at[:-1])
        out[low:high] = np.add.reduceat(np.log10(of_byte), at[:-1])
    return out


def _shift(mixed: np.ndarray, bit: np.ndarray, own: Inputs, cuts: np.ndarray) -> None:
    """A text's own errors shift its weights from block to block."""
    shift = np.zeros(PREDICTORS, np.float32)
    cuts = cuts.tolist()
    for step, (a, b) in enumerate(zip(cuts, cuts[1:])):
        odds = own.odds.take(own.row[a:b], axis=0)
        if step:
            mixed[a:b] += odds @ shift
        if step < len(cuts) - 2:
            wrong = bit[a:b] - _chance(mixed[a:b])
            shift += np.float32(OWN_RATE / ((b - a) * (step + 8))) * (wrong @ odds)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: tokens by hash, counted within chunks."""
    for _, texts in chunks(batches):
        hashes, n = np.unique(Words(texts, fold=True).hashes(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([int64(hashes), pa.array([_END])]), pa.array(np.append(n, len(texts)))], names=["word", "n"])


def _score(frequent):
    """Task: for the rows of each chunk, base sums over frequent tokens and the hashes of the others, beside their scores."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_known, counts = frequent.value
        for row in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            texts = unzipped(row.column("packed")[0].as_py())
            columns = {c: row.column(c).flatten() for c in (*CARRIED, "score")}
            for low, high in _runs([len(t) for t in texts], CHUNK):
                words = Words(texts[low:high], fold=True)
                distinct, which = np.unique(words.hashes(), return_inverse=True)
                distinct = distinct.view(np.int64)
                at = np.minimum(np.searchsorted(words_known, distinct), len(words_known) - 1)
                here = words_known[at] == distinct
                log = np.where(here, np.log10(counts[at] + 0.5), 0.0)[which]
                known = here[which]
                sums = np.concatenate([[0.0], np.cumsum(log)])[words.first]
                n_known = np.concatenate([[0], np.cumsum(known)])[words.first]
                others = int64(distinct[which][~known])
                ends = pa.array(np.concatenate([[0], np.cumsum(~known)])[words.first].astype(np.int32))
                end = counts[words_known == _END].sum()
                yield pa.RecordBatch.from_arrays(
                    [
                        *(column.slice(low, high - low) for column in columns.values()), pa.array(words.counts + 1), pa.array(np.diff(n_known) + int(end > 0)),
                        pa.array(np.diff(sums) + np.log10(end + 0.5)), pa.ListArray.from_arrays(ends, others),
                    ],
                    names=[*columns, "n_tokens", "n_known", "base", "others"],
                )

    return task


def score(docs: DataFrame, modulus: int = 5, remainder: int = 1, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), held_out(modulus, remainder).alias("held_out"), "text")
    train = rows.where(~F.col("held_out")).select("doc_id", "text")
    with tidied(spark):
        counts = written(train.select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
        total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        top = counts.where(F.col("word") != _END).orderBy(F.desc("n"), "word").limit(frequent).union(counts.where(F.col("word") == _END)).toPandas()  # FREQUENT + 1 rows
        top = top.sort_values("word") if len(top) else top.reindex([0]).fillna({"word": _END, "n": 0})
        sent = (top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64))
        model, ranges, packed, answers = fit_chunks(rows)
        chances = _task(spark, "scores", "array<double>", ranges, model)
        scores = packed.join(answers, "chunk").select(*CARRIED, chances("packed", "found").alias("score"), "packed")
        schema = "doc_id long, version long, held_out boolean, score double, n_tokens long, n_known long, base double, others array<bigint>"
        found = written(scores.mapInArrow(_score(spark.sparkContext.broadcast(sent)), schema), "scored")

    others = found.select("doc_id", "version", F.posexplode("others").alias("pos", "word")).join(counts, "word", "left")
    # Equal rows have equal others: their sums are divided by how many there are.
    copies = F.sum((F.col("pos") == 0).cast("long"))
    rest = others.groupBy("doc_id", "version").agg(
        (F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)) / copies).alias("more"), (F.count("n") / copies).cast("long").alias("more_known")
    )
    joined = found.alias("s").join(rest.alias("r"), F.col("s.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("s.version") == F.col("r.version")), "left")
    per_token = float(np.log10(total + 0.5 * (kinds + 1)))
    return joined.select(
        "s.doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), "score",
    )

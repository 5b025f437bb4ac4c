"""Token ids in wavelet matrices, one compressed file a shard, in ascending order of documents.

A wavelet matrix keeps one bit plane for each bit of the ids, highest first; each plane orders the ids by the bits
before, zeros first. With the ones counted in front of each block, a plane answers rank by one look and select by
a search, so that a file gives single ids, counts of an id, and places where it occurs, without other ids.

1. Texts are range-partitioned and sorted by doc_id, encoded in tasks, and cut into shards at document ends.
2. Each task writes its files into the shared folder under names that a second run of it writes again alike.
3. Files are read back, one task each; documents come from the planes.

File: magic, sizes, the documents' table and the planes, each compressed on its own.

Defined cases: null and empty texts are their end id alone; a null doc_id comes first; rows with equal doc_id come
in the order of a hash of their texts; an empty table gives no files; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.tables import scratch
from veilwork.llm.tokens import encoder, public_path
from veilwork.llm.words import chunks

TOKENIZER = "byte_bpe_50k.json"
END = 2
SHARD_TOKENS = 1 << 22
BLOCK = 512  # bits for which the ones in front are kept
MAGIC = b"WMTX0001"
_SHARDS = "part int, k int, path string, n_tokens long, n_docs long"


class WaveletMatrix:
    """Bit planes of a sequence of ids."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.ones = [np.concatenate([[0], np.cumsum(np.bitwise_count(p.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.int64))]) for p in planes]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        depth = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        planes, zeros = [], []
        for level in range(depth - 1, -1, -1):
            bits = (now & now.dtype.type(1 << level)) != 0
            packed = np.packbits(bits)
            planes.append(np.pad(packed, (0, -len(packed) % (BLOCK // 8))))
            low = now[~bits]
            zeros.append(len(low))
            now = np.concatenate([low, now[bits]])
        return cls(len(ids), planes, zeros)

    def _rank(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, bit = divmod(i, BLOCK)
        own = self.planes[level][block * (BLOCK // 8) : block * (BLOCK // 8) + bit // 8]
        more = int(self.planes[level][i // 8]) >> (8 - bit % 8) if bit % 8 else 0
        return int(self.ones[level][block]) + int(np.bitwise_count(own).sum()) + more.bit_count()

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th one or zero (from 0) of a plane."""
        before = self.ones[level] if bit else np.arange(len(self.ones[level])) * BLOCK - self.ones[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)])
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, i: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][i // 8]) >> (7 - i % 8) & 1
            ones = self._rank(level, i)
            i = zeros + ones if bit else i - ones
            value = value * 2 + bit
        return value

    def _down(self, token: int, i: int) -> int:
        """Where a prefix of i ids ends in the last order, kept to the token's own branch."""
        for level, zeros in enumerate(self.zeros):
            ones = self._rank(level, i)
            i = zeros + ones if token >> (len(self.zeros) - 1 - level) & 1 else i - ones
        return i

    def rank(self, token: int, i: int) -> int:
        """Times that the token occurs among the first i ids."""
        return 0 if token >> len(self.zeros) else self._down(token, i) - self._down(token, 0)

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of the token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._down(token, 0) + k
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = token >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, from the last plane up."""
        depth = len(self.planes)
        now = np.zeros(self.n, np.uint16 if depth <= 16 else np.uint32)
        for level in range(depth - 1, -1, -1):
            bits = np.unpackbits(self.planes[level], count=self.n).view(bool)
            above = np.empty_like(now)
            above[~bits] = now[: self.zeros[level]]
            above[bits] = now[self.zeros[level] :] | now.dtype.type(1 << (depth - 1 - level))
            now = above
        return now


def to_bytes(matrix: WaveletMatrix, doc_ids: list[int | None], bounds: np.ndarray) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = zlib.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + bounds.astype("<i8").tobytes(), 1)
    planes = [zlib.compress(p.tobytes(), 1) for p in matrix.planes]
    head = struct.pack("<8sQQQI", MAGIC, matrix.n, len(doc_ids), len(table), len(planes))
    sizes = b"".join(struct.pack("<QQ", len(p), zeros) for p, zeros in zip(planes, matrix.zeros))
    return b"".join([head, sizes, table, *planes])


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    magic, n, docs, table, depth = struct.unpack_from("<8sQQQI", data)
    if magic != MAGIC:
        raise ValueError("not a wavelet matrix file")
    at = struct.calcsize("<8sQQQI")
    sizes = [struct.unpack_from("<QQ", data, at + 16 * i) for i in range(depth)]
    at += 16 * depth
    raw = zlib.decompress(data[at : at + table])
    at += table
    ids, known = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, np.uint8, docs, 8 * docs)
    planes = []
    for size, _ in sizes:
        planes.append(np.frombuffer(zlib.decompress(data[at : at + size]), np.uint8))
        at += size
    matrix = WaveletMatrix(n, planes, [zeros for _, zeros in sizes])
    return matrix, [int(i) if k else None for i, k in zip(ids, known)], np.frombuffer(raw, "<i8", docs + 1, 9 * docs)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _write(folder: str, path: str, end: int, shard_tokens: int):
    """Task: writes its documents into files and gives a row for each file."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, (files, root) = encoder(path, end, False), _open(folder)
        files.create_dir(root)
        context = TaskContext.get()
        part, made = context.partitionId(), []
        ids, docs, sizes, held = [], [], [], 0

        def close() -> None:
            nonlocal ids, docs, sizes, held
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            data = to_bytes(WaveletMatrix.build(np.concatenate(ids)), docs, bounds)
            name = f"{root}/part-{part:06d}-{len(made):05d}.wm"
            attempt = f"{name}.{context.taskAttemptId()}"  # a half-written file never has the final name
            with files.open_output_stream(attempt) as out:
                out.write(data)
            files.move(attempt, name)
            made.append((part, len(made), f"part-{part:06d}-{len(made):05d}.wm", held, len(docs)))
            ids, docs, sizes, held = [], [], [], 0

        for batch, texts in chunks(batches):
            flat, bounds = tool.encode(texts)
            ids.append(flat)
            docs += batch.column("doc_id").to_pylist()
            sizes += np.diff(bounds).tolist()
            held += len(flat)
            if held >= shard_tokens:
                close()
        if docs:
            close()
        columns = list(zip(*made)) or [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "k", "path", "n_tokens", "n_docs"])

    return task


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write token files under ``folder``; their manifest is returned, and kept there as ``manifest``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")
    rows = rows.repartitionByRange("doc_id", "version").sortWithinPartitions("doc_id", "version")
    task = _write(folder, path or public_path(TOKENIZER), end, shard_tokens)
    rows.select("doc_id", "text").mapInArrow(task, _SHARDS).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_SHARDS).parquet(f"{folder}/manifest")


def _read(folder: str):
    """Task: the documents of each file that it is given."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for batch in batches:
            for name, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                with files.open_input_stream(f"{root}/{name}") as source:
                    matrix, docs, bounds = from_bytes(source.read())
                ids = matrix.decode().astype("<u4")
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return task


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    shards = manifest.count()
    earlier = Window.orderBy("part", "k").rowsBetween(Window.unboundedPreceding, -1)  # one small row a file
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).cast("long").alias("before"))
    return placed.repartition(max(1, shards)).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame) -> DataFrame:
    folder = scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder), folder)

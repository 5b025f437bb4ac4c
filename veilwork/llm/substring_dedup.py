"""Substring dedup: a count-min sketch finds windows that may repeat, a second pass groups those exactly.

A window is ``window`` consecutive words of one document. A word is removed if a window that covers it also
starts in a document with a smaller doc_id. Windows are judged on the input.

1. Every task sketches its windows. A window stands under the smallest hash among its runs of ``run`` words,
   which neighbouring windows mostly share, so that one entry stands for several windows. Equal windows have
   equal entries; a cell counts at least once for every document that holds the window, so cells overestimate.
2. Partition sketches are merged by ranges of cells; what is kept is whether a cell was hit twice or more, and
   whether it was hit so often that windows under it are spread over salts.
3. A second pass groups the windows whose cells all were hit twice, under 80 bits of their words, by a window
   function that finds the smallest doc_id; a group has no more rows than its cell has hits, except where equal
   windows follow each other (one word over and over), which is one hit for the whole stretch. Windows under very
   often hit cells are aggregated instead, and the result is joined back over salts. Windows that occur in two
   documents are never lost.

Cells grow with the number of words up to ``max_cells`` (4 bitmaps of 16 MB, the only broadcast). Beyond that
the sketch lets more windows through, and the second pass groups them; results stay the same.

Defined cases: a null text has no words; documents shorter than a window are kept as they are; rows with null
doc_id neither remove nor lose words; equal rows count as one document; of different texts under one doc_id
neither removes words of the other; other columns are passed on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.tables import SPACE, n_words
from veilwork.llm.words import Words, chunks, int64, mix, runs

WINDOW = 13
RUN = 8
ROWS = 3
HOT = 60_000  # hits of a cell from which on its windows are salted; below, that many rows of a window meet in a task
SALTS = 64
MAX_CELLS = 1 << 27
RANGES = 64
FLUSH = 1 << 20
_PIECE = pa.schema([("part", pa.int32()), ("cells", pa.binary())])
_MERGED = pa.schema([("part", pa.int32()), ("twice", pa.binary()), ("hot", pa.binary())])
_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int16()), ("doc_id", pa.int64()), ("version", pa.int64()), ("pos", pa.int32())])


def _entries(words: Words, hashes: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows, the number of the entry each stands under, and the entries."""
    start = np.flatnonzero(words.left() >= window)
    if not len(start):
        return start, start, np.zeros(0, np.uint64)
    short = runs(hashes, run)
    least = short[start]
    for shift in range(1, window - run + 1):
        least = np.minimum(least, short[start + shift])
    fresh = np.ones(len(start), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (start[1:] != start[:-1] + 1)
    return start, np.cumsum(fresh) - 1, least[fresh]


def _cells(entries: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(mix(entries + np.uint64(row)) >> np.uint64(64 - bits)).astype(np.uint32) for row in range(ROWS)]


def _planes(values: np.ndarray) -> np.ndarray:
    """First bytes of all values, then all second bytes and so on: the later ones are mostly 0."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T)


def _sketch(bits: int, window: int, run: int):
    """Task: the cells its windows hit, sorted, in pieces by row and range of cells."""

    def pieces(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        parts, data = [], []
        for row, arrays in enumerate(held):
            cells, times = np.unique(np.concatenate(arrays), return_counts=True)
            cuts = np.searchsorted(cells, np.arange(RANGES + 1, dtype=np.int64) << (bits - 6))
            for r in range(RANGES):
                own = cells[cuts[r] : cuts[r + 1]]
                if len(own):
                    steps = np.diff(own, prepend=np.uint32(r << (bits - 6)))
                    parts.append(row * RANGES + r)
                    data.append(zlib.compress(_planes(steps).tobytes() + np.minimum(times[cuts[r] : cuts[r + 1]], 65535).astype(np.uint16).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(data, pa.binary())], schema=_PIECE)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[] for _ in range(ROWS)], 0
        for _, texts in chunks(batches):
            words = Words(texts)
            entries = _entries(words, words.hashes(), window, run)[2]
            for mine, cells in zip(held, _cells(entries, bits)):
                mine.append(cells)
            size += len(entries)
            if size >= FLUSH:
                yield from pieces(held)
                held, size = [[] for _ in range(ROWS)], 0
        if size:
            yield from pieces(held)

    return task


def _merge(bits: int):
    """Task: two bitmaps for each range of cells it is dealt: cells hit twice or more, and cells hit very often."""
    width = 1 << (bits - 6)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = zlib.decompress(data)
                n = len(raw) // 6
                have = counts.setdefault(part, np.zeros(width, np.uint16))
                steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n).reshape(4, n).T).view(np.uint32)
                cells = np.cumsum(steps, dtype=np.int64)
                more = np.frombuffer(raw, np.uint16, n, 4 * n)
                have[cells] += np.minimum(more, 65535 - have[cells])
        for part, have in counts.items():
            bitmaps = [zlib.compress(np.packbits(have >= least).tobytes(), 1) for least in (2, HOT)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([b], pa.binary()) for b in bitmaps)], schema=_MERGED)

    return task


def _suspects(bits: int, window: int, run: int, bitmaps, hot: bool):
    """Task: windows whose cells were all hit twice or more, under 80 bits of their words; those of hot cells or the others."""

    def hit(row: int, cells: np.ndarray) -> np.ndarray:
        return (bitmaps.value[row][cells >> np.uint32(3)] >> (np.uint8(7) - (cells & np.uint32(7)).astype(np.uint8))) & 1

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            words = Words(texts)
            hashes = words.hashes()
            start, entry, entries = _entries(words, hashes, window, run)
            if not len(start):
                continue
            seen = np.ones(len(entries), np.uint8)
            for row, cells in enumerate(_cells(entries, bits)):
                seen &= hit(row, cells)
                if row == 0:
                    seen &= hit(ROWS, cells) == hot
            start = start[seen[entry] == 1]
            if not len(start):
                continue
            doc = words.doc()[start]
            ids, version = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "version"))
            found = [
                int64(runs(hashes, window)[start]), pa.array(runs(words.hashes(1), window, 1)[start].astype(np.uint16).view(np.int16)),
                pa.array(ids[doc], pa.int64()),
                pa.array(version[doc], pa.int64()), pa.array((start - words.first[doc]).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(found, schema=_FOUND)

    return task


def suspected_windows(docs: DataFrame, window: int = WINDOW, run: int = RUN, max_cells: int = MAX_CELLS) -> tuple[DataFrame, DataFrame | None]:
    """(k1, k2, doc_id, version, pos): windows that the merged sketch counts twice or more; no repeated one is missing.

    The second table has those under cells with HOT hits or more, if there are such cells.
    """
    spark = docs.sparkSession
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("version"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = min(max_cells, max(1 << 16, total // 6))
    bits = int(cells - 1).bit_length()
    merged = (
        rows.select("text").mapInArrow(_sketch(bits, window, run), "part int, cells binary")
        .repartition("part")
        .mapInArrow(_merge(bits), "part int, twice binary, hot binary")
        .collect()  # bitmaps of max_cells bits at most
    )
    width = 1 << (bits - 3)
    bitmaps = [np.zeros(width, np.uint8) for _ in range(ROWS + 1)]
    for part, twice, hot in merged:
        row, r = divmod(part, RANGES)
        own = slice(r * (width // RANGES), (r + 1) * (width // RANGES))
        bitmaps[row][own] = np.frombuffer(zlib.decompress(twice), np.uint8)
        if row == 0:
            bitmaps[ROWS][own] = np.frombuffer(zlib.decompress(hot), np.uint8)
    shared = spark.sparkContext.broadcast(bitmaps)
    take = lambda hot: rows.mapInArrow(_suspects(bits, window, run, shared, hot), "k1 long, k2 short, doc_id long, version long, pos int")
    return take(False), take(True) if bitmaps[ROWS].any() else None


def repeated_starts(docs: DataFrame, window: int = WINDOW, **sketch: int) -> DataFrame:
    """(doc_id, version, starts): word positions at which a window starts that a smaller doc_id has too."""
    few, many = suspected_windows(docs, window, **sketch)
    least = F.min("doc_id").over(Window.partitionBy("k1", "k2")).alias("least")
    later = few.select("doc_id", "version", "pos", least).where("doc_id > least").drop("least")
    if many is not None:
        least = many.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        least = least.select("k1", "k2", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = many.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(least, ["k1", "k2", "salt"])
        later = later.union(salted.where("doc_id > least").select("doc_id", "version", "pos"))
    return later.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("starts"))


def _cut(window: int):
    """Task: texts without the covered words; layout between kept words stays, a removed run leaves one space."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("starts").to_pylist()
            removed, texts = [0] * len(starts), batch.column("text").to_pylist()
            for i, own in enumerate(starts):
                if not own:
                    continue
                raw = texts[i].encode()
                words = Words([raw])
                gone = np.zeros(words.n + 1, np.int64)
                np.add.at(gone, np.array(own), 1)
                np.add.at(gone, np.minimum(np.array(own) + window, words.n), -1)
                keep = np.concatenate([[False], np.cumsum(gone)[:-1] == 0, [False]])
                edges = np.flatnonzero(keep[1:] != keep[:-1])
                spans = [raw[words.start[a] : words.end[b - 1]] for a, b in zip(edges[0::2], edges[1::2])]
                texts[i], removed[i] = b" ".join(spans).decode(), int(words.n - keep.sum())
            out = batch.drop_columns(["starts", "text"])
            yield out.append_column("text", pa.array(texts, pa.string())).append_column("n_removed", pa.array(removed, pa.int64()))

    return task


def dedup_substrings(docs: DataFrame, window: int = WINDOW, **sketch: int) -> DataFrame:
    """All columns of ``docs``, with ``text`` less the repeated words, and ``n_words`` (before) and ``n_removed``."""
    own = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    keyed = docs.select("text", F.struct(*own).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_version"))
    starts = repeated_starts(docs, window, **sketch).withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    joined = keyed.join(starts, ["_id", "_version"], "left").select("_row", n_words().alias("n_words"), "starts", "text")
    row = joined.schema["_row"].dataType.simpleString()
    cut = joined.mapInArrow(_cut(window), f"_row {row}, n_words long, text string, n_removed long")
    return cut.select(*[F.col("_row")[c].alias(c) for c in own], "text", "n_words", "n_removed").select(
        *[c for c in docs.columns if c not in ("n_words", "n_removed")], "n_words", "n_removed"
    )


def digest(docs: DataFrame) -> DataFrame:
    done = dedup_substrings(docs.select("doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), f"{SPACE}+", " "))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))

"""Packing into sequences by cutting-stock column generation.

1. Documents are tokenized, full sequences cut off, and the rest is one piece of less than a sequence. Pieces
   fall into classes of ``STEP`` tokens; their counts, a histogram of bounded size, are all the driver sees.
2. A linear program over patterns (how many pieces of which class share a sequence) covers the histogram. It
   starts with one pattern for each class; a knapsack over the dual prices finds the pattern that helps most,
   until none does.
3. Patterns are used a whole number of times; the few pieces left over are packed first-fit, largest first.
4. Pieces are ranked within their class by seeded bucket and id, and the rank gives pattern, sequence and place.

Defined cases: null and empty texts are their end id alone; rows with equal or null doc_id are documents of their
own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilwork.llm.tables import written
from veilwork.llm.tokens import encoder, public_path
from veilwork.llm.words import chunks

TOKENIZER = "word_bpe_49k.json"
END = 1
LENGTH = 2048
STEP = 8
BUCKETS = 128
ROUNDS = 4000
_PIECES = "doc_id long, version long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, end: int, length: int):
    """Task: full sequences of each document and what is left, with the crc32 of their ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, end, True)
        for batch, texts in chunks(batches):
            ids, bounds = tool.encode(texts)
            ids, rows = ids.astype("<u4"), []
            for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                rows += [(d, at - a, min(b - at, length), zlib.crc32(ids[at : min(b, at + length)].tobytes()), b - a) for at in range(a, b, length)]
            values = np.array(rows, np.int64).T
            at = pa.array(values[0])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), batch.column("version").take(at), *map(pa.array, values[1:])],
                names=["doc_id", "version", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return task


def best_pattern(prices: np.ndarray) -> tuple[float, np.ndarray]:
    """Knapsack: worth and counts of the classes 1..n that fill a capacity of n best."""
    n = len(prices)
    worth, last = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    for room in range(1, n + 1):
        tried = worth[room - 1 :: -1] + prices[:room]
        pick = int(tried.argmax())
        if tried[pick] > worth[room - 1] + 1e-12:
            worth[room], last[room] = tried[pick], pick + 1
        else:
            worth[room] = worth[room - 1]
    counts, room = np.zeros(n, np.int64), n
    while room:
        counts[last[room] - 1] += last[room] > 0
        room -= last[room] or 1
    return float(worth[n]), counts


def solve(demand: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of counts by class 1..n) and how often the linear program uses each."""
    n = len(demand)
    held = np.flatnonzero(demand) + 1
    if not len(held):
        return np.zeros((0, n), np.int64), np.zeros(0)
    patterns = np.zeros((len(held), n), np.int64)
    patterns[np.arange(len(held)), held - 1] = n // held
    inverse = np.diag(1.0 / (n // held))
    used = inverse @ demand[held - 1]
    for _ in range(rounds):
        prices = np.zeros(n)
        prices[held - 1] = np.maximum(inverse.sum(axis=0), 0)
        worth, counts = best_pattern(prices)
        if worth <= 1 + 1e-7:
            break
        along = inverse @ counts[held - 1]
        ratios = np.where(along > 1e-9, used / np.where(along > 1e-9, along, 1), np.inf)
        leaving = int(ratios.argmin())
        step = ratios[leaving]
        used = np.maximum(used - step * along, 0)
        used[leaving] = step
        patterns[leaving] = counts
        pivot = inverse[leaving] / along[leaving]
        inverse -= np.outer(along, pivot)
        inverse[leaving] = pivot
    return patterns, used


def rounded(demand: np.ndarray, patterns: np.ndarray, used: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that hold every piece of the histogram exactly once."""
    plan, left = [], demand.astype(np.int64).copy()
    for counts, times in sorted(zip(patterns, np.floor(used + 1e-6).astype(np.int64)), key=lambda x: -int(x[1])):
        fits = [left[c] // counts[c] for c in np.flatnonzero(counts)]
        times = min([int(times), *map(int, fits)])
        if times > 0:
            plan.append((counts, times))
            left -= counts * times
    n, rooms, bins = len(demand), [], []
    for size in range(n, 0, -1):
        for _ in range(int(left[size - 1])):
            at = next((i for i, room in enumerate(rooms) if room >= size), None)
            if at is None:
                at = len(bins)
                rooms.append(n)
                bins.append(np.zeros(n, np.int64))
            rooms[at] -= size
            bins[at][size - 1] += 1
    return plan + [(counts, 1) for counts in bins]


def _assignment(counts: pd.DataFrame, classes: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Where the ranks of a bucket begin, and for ranges of ranks the sequences they go to."""
    counts = counts.sort_values(["kind", "bucket"])
    begin = counts.assign(begin=counts.groupby("kind")["n"].cumsum() - counts["n"])[["kind", "bucket", "begin"]]
    demand = np.zeros(classes, np.int64)
    for kind, n in counts.groupby("kind")["n"].sum().items():
        demand[kind - 1] = n
    partial = demand.copy()
    partial[-1] = 0  # pieces that fill a sequence need no plan
    plan = rounded(partial, *solve(partial.astype(float)))
    if demand[-1]:
        plan.insert(0, (np.eye(1, classes, classes - 1, dtype=np.int64)[0], int(demand[-1])))
    ranges, taken, sequence = [], np.zeros(classes, np.int64), 0
    for pattern, times in plan:
        for c in np.flatnonzero(pattern):
            ranges.append((int(c) + 1, int(taken[c]), int(taken[c] + pattern[c] * times), int(pattern[c]), sequence))
            taken[c] += pattern[c] * times
        sequence += times
    return begin, pd.DataFrame(ranges, columns=["kind", "low", "high", "each", "sequence"])


def pack(docs: DataFrame, path: str | None = None, end: int = END, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), "text")
    pieces = rows.mapInArrow(_pieces(path or public_path(TOKENIZER), end, length), _PIECES)
    kind = F.ceil(F.col("length") / step).cast("int").alias("kind")
    bucket = F.pmod(F.xxhash64("doc_id", "version", "start"), F.lit(BUCKETS)).cast("int").alias("bucket")
    pieces = written(pieces.select("*", kind, bucket), "pieces")
    # At most length / step classes by BUCKETS buckets come to the driver, and go back as two small tables.
    counts = pieces.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n")).toPandas()
    begin, ranges = _assignment(counts, -(-length // step))
    begin = spark.createDataFrame(begin.astype("int64"), "kind int, bucket int, begin long")
    ranges = spark.createDataFrame(ranges.astype("int64"), "kind int, low long, high long, each long, sequence long")
    order = Window.partitionBy("kind", "bucket").orderBy("doc_id", "version", "start")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(begin), ["kind", "bucket"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("begin"))
    placed = ranked.join(F.broadcast(ranges), "kind").where("rank >= low AND rank < high")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)

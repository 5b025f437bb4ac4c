"""Quality rules: lines that very many documents of a host share are removed, depleted documents rejected.

1. Lines are normalised (trimmed, lower case, runs of digits as one 0, runs of space as one) and hashed. For each
   host the distinct documents of a line are counted; documents with equal text count once, so that exact copies,
   which dedup removes, don't take each other's lines away.
2. Lines of more than ``max_docs`` documents of their host are removed. A document that keeps less than
   ``least_kept`` of its words is rejected.
3. Base rules on the whole text reject documents of under 50 words or with half of their words in repeated
   three-word windows.

Counting shuffles hashes only, combined on the way; texts stay where they are for the rules.

Defined cases: null and empty texts have no words and fail the base rules; a null host is a host of its own; a
line without a word is never removed; equal rows get equal results; other columns are passed on by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.tables import SPACE, WORD, written
from veilwork.llm.words import Words, chunks, runs

MAX_DOCS = 50
LEAST_KEPT = 0.5
MIN_WORDS = 50
# The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def normalised(line: Column) -> Column:
    """What makes two lines one: letters without case, digits without value, layout without width."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\d+", "0"), f"{SPACE}+", " "))


def line_hashes(text: str) -> Column:
    """Hash of each line of a text in order; null for lines without a word."""
    clean = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), normalised)
    return F.transform(clean, lambda line: F.when(line != "", F.xxhash64(line)))


def common_lines(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line): hashed lines in more than ``max_docs`` documents of a host; rows that share a doc_id are one."""
    lines = docs.select(F.col(host).alias("host"), "doc_id", F.explode(F.array_distinct(line_hashes("text"))).alias("line"))
    once = lines.where("line IS NOT NULL").distinct()
    return once.groupBy("host", "line").agg(F.count("doc_id").alias("docs")).where(F.col("docs") > max_docs).select("host", "line")


def _within(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items equal another one of their document, and which equal an earlier one."""
    order = np.lexsort((key, doc))
    same = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    again, any_ = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:]] = same
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    return any_, again


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the counts of the base rules; 64-bit hashes stand for words, windows and lines."""
    for batch, texts in chunks(batches):
        words, docs = Words(texts), len(texts)
        lead = (words.buf & 0xC0) != 0x80  # first bytes of code points
        points = np.concatenate([[0], np.cumsum(lead)])
        symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[words.buf])])
        chars = np.concatenate([[0], np.cumsum(points[words.end] - points[words.start])])
        hashes = words.hashes()

        start = np.flatnonzero(words.left() >= 3)
        repeated = start[_within(words.doc()[start], runs(hashes, 3)[start])[0]]
        covered = np.zeros(words.n + 1, np.int64)
        for shift in range(3):
            covered[repeated + shift] = 1
        covers = np.concatenate([[0], np.cumsum(covered)])

        # Lines with a word, as bytes: an array of "words" cut at line ends instead of spaces.
        ends = np.flatnonzero(words.buf == 10)
        begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        full = np.searchsorted(words.start, begins) < np.searchsorted(words.start, ends)
        words_of = Words.__new__(Words)
        words_of.buf, words_of.start, words_of.end = words.buf, begins[full], ends[full]
        line_doc = np.searchsorted(words.at, begins[full], side="right") - 1
        later = _within(line_doc, words_of.hashes())[1]

        spread = lambda sums: sums[words.first[1:]] - sums[words.first[:-1]]
        counts = [
            words.counts, spread(chars), symbols[words.at[1:]] - symbols[words.at[:-1]],
            np.bincount(line_doc[later], minlength=docs), spread(covers),
        ]
        out = batch.drop_columns(["text"])
        for name, values in zip(_COUNTS, counts):
            out = out.append_column(name, pa.array(values.astype(np.int64)))
        yield out


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, least_kept: float = LEAST_KEPT) -> DataFrame:
    """One row per document: doc_id, row, counts, words_removed, base_failed, kept.

    ``row`` tells documents apart by their content.
    """
    row = F.xxhash64("doc_id", F.col(host), "text").alias("row")
    rules = docs.select("doc_id", row, "text").mapInArrow(_rules, "doc_id long, row long, " + ", ".join(f"{c} long" for c in _COUNTS))
    # A table of its own, so that joins can split a line that very many documents have.
    common = written(common_lines(docs, host, max_docs), "lines")
    lines = docs.select(row, F.col(host).alias("host"), F.explode(F.arrays_zip(line_hashes("text").alias("line"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("own"))).alias("at"))
    lines = lines.select("row", "host", "at.line", F.regexp_count("at.own", F.lit(WORD)).alias("words")).where("line IS NOT NULL")
    hit = lines.join(common.withColumnsRenamed({"host": "_host", "line": "_line"}), (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")), "left_semi")
    same = docs.groupBy(row).agg(F.count(F.lit(1)).alias("rows"))
    removed = hit.groupBy("row").agg(F.sum("words").alias("words_removed")).join(same, "row")
    removed = removed.select("row", F.expr("words_removed div rows").alias("words_removed"))
    out = rules.join(removed, "row", "left").withColumn("words_removed", F.coalesce("words_removed", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("n_words") - F.col("words_removed") >= least_kept * F.col("n_words"))
    return out.select("doc_id", "row", *_COUNTS, "words_removed", failed.alias("base_failed"), kept.alias("kept"))


def clean(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, least_kept: float = LEAST_KEPT) -> DataFrame:
    """Documents that pass, less their common lines, with all their columns."""
    verdict = judge(docs, host, max_docs, least_kept).where("kept").select("row", "words_removed").dropDuplicates(["row"])
    keyed = docs.withColumn("row", F.xxhash64("doc_id", F.col(host), "text"))
    common = written(common_lines(docs, host, max_docs), "lines")
    mine = (
        keyed.select("row", F.col(host).alias("host"), F.explode(line_hashes("text")).alias("line"))
        .join(common.withColumnsRenamed({"host": "_host", "line": "_line"}), (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")), "left_semi")
        .groupBy("row").agg(F.collect_set("line").alias("_gone"))
    )
    joined = keyed.join(verdict, "row").join(mine, "row", "left")
    pairs = F.arrays_zip(F.split("text", "\n", -1).alias("own"), line_hashes("text").alias("line"))
    left = F.filter(pairs, lambda p: p["line"].isNull() | ~F.coalesce(F.array_contains(F.col("_gone"), p["line"]), F.lit(False)))
    text = F.when(F.col("words_removed") > 0, F.array_join(F.transform(left, lambda p: p["own"]), "\n")).otherwise(F.col("text"))
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns])

"""Assembly of document text from page blocks and office structures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork import patterns
from veilwork.functions import text


def inside_margins(ratio: float = patterns.HEADER_RATIO) -> Column:
    """Does a block reach into the page between its top and bottom margins?

    Pages without height, and ratios that would leave nothing, are not clipped.
    """
    top = F.col("page_y0") + F.col("page_height") * F.lit(ratio)
    bottom = F.col("page_y0") + F.col("page_height") * F.lit(1 - ratio)
    if 1 - ratio <= ratio:
        return F.lit(True)
    return (F.col("page_height") <= 0) | ((F.col("y1") > top) & (F.col("y0") < bottom))


def clip_margins(blocks: DataFrame, ratio: float = patterns.HEADER_RATIO) -> DataFrame:
    return blocks.where(inside_margins(ratio))


def page_block(ratio: float = patterns.HEADER_RATIO) -> Column:
    """(pos, text) of a block inside the margins that has text, else NULL."""
    return F.when(inside_margins(ratio) & (F.coalesce("text", F.lit("")) != ""), F.struct("pos", "text"))


def joined_blocks(block: str) -> Column:
    """Aggregate: the text of a page from its ``page_block`` column, in order; '' for a page without text."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda b: b["text"]), "\n")


def joined_pages(text: str = "text", order: str = "page") -> Column:
    """Aggregate: the text of a document from its pages, in order; empty pages are left out."""
    page = F.when(F.coalesce(text, F.lit("")) != "", F.struct(F.col(order).alias("at"), F.col(text).alias("text")))
    return F.array_join(F.transform(F.sort_array(F.collect_list(page)), lambda p: p["text"]), "\n")


def assemble_pages(pages: DataFrame, id_col: str = "doc_id", order: str = "page") -> DataFrame:
    """One text per document: its non-empty pages in order, joined by line ends.

    A document of only empty pages keeps the text ''. The pages of one document meet in one task
    because they become one cell; files are bounded by the admission limit, and nothing else is
    grouped.
    """
    return pages.groupBy(id_col).agg(joined_pages("text", order).alias("text"))


def read_with_fallback(full: DataFrame, text_only: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Full extraction where it worked, else the text-only one, else an error; one row for every id.

    ``full`` and ``text_only`` hold one row (id, text, error) per document; a failed read has an
    error or no row, and an id may be missing on either side. ``full`` may carry ``tables`` and
    ``images`` arrays, which a fallback leaves empty. Full texts stay where they are; of the second
    reads only those of documents whose first read failed are used.
    """
    extra = [c for c in ("tables", "images") if c in full.columns]
    worked = F.col("error").isNull() & F.col("text").isNotNull()
    empty = [F.array().cast(full.schema[c].dataType).alias(c) for c in extra]
    none = F.lit(None).cast("string")
    first = full.where(worked).select(
        id_col, "text", *extra, F.lit(patterns.PDF_ENGINES[0]).alias("pdf_engine"), none.alias("error")
    )
    failed = full.where(~worked).select(id_col, F.col("error").alias("_first"))
    second = text_only.join(full.where(worked).select(id_col), id_col, "left_anti").select(
        id_col, F.when(F.col("error").isNull(), F.col("text")).alias("_plain"), F.col("error").alias("_why")
    )
    plain = F.col("_plain").isNotNull()
    rest = failed.join(second, id_col, "full").select(
        id_col,
        F.col("_plain").alias("text"),
        *empty,
        F.when(plain, F.lit(patterns.PDF_ENGINES[1])).alias("pdf_engine"),
        F.when(
            ~plain, F.concat(F.lit("Unable to read PDF: "), F.coalesce("_why", "_first", F.lit("no text")))
        ).alias("error"),
    )
    return first.unionByName(rest)


def assemble_docx_text(structures: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Text of an office document: paragraphs, then every table row with its cells joined by ' | '.

    ``structures`` holds (id, kind, idx, row_idx, text, cells) with kind 'paragraph' or 'table'.
    Where it tells of errors too, they come along in ``error``.
    """
    line = F.when(F.col("kind") == "table", F.concat_ws(" | ", "cells")).otherwise(F.coalesce("text", F.lit("")))
    at = F.struct((F.col("kind") == "table").alias("table"), "idx", "row_idx", line.alias("line"))
    kept = F.when(F.col("kind").isin("paragraph", "table"), at)
    ordered = F.sort_array(F.collect_list(kept))
    text_of = F.array_join(F.transform(ordered, lambda s: s["line"]), "\n").alias("text")
    errors = [F.max("error").alias("error")] if "error" in structures.columns else []
    return structures.groupBy(id_col).agg(text_of, *errors)


def docx_tables(structures: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, table_index, data, rows, cols) from the table rows of ``structures``.

    ``cols`` is the width of the table's grid (``n_cols``) where it is told, else of the first row.
    """
    rows = F.sort_array(F.collect_list(F.struct("row_idx", "cells")))
    grid = F.max("n_cols") if "n_cols" in structures.columns else F.lit(None).cast("int")
    return (
        structures.where("kind = 'table'")
        .groupBy(id_col, F.col("idx").alias("table_index"))
        .agg(F.transform(rows, lambda r: r["cells"]).alias("data"), grid.alias("_grid"))
        .select(
            id_col,
            "table_index",
            "data",
            F.size("data").alias("rows"),
            F.coalesce("_grid", F.size(F.get("data", F.lit(0)))).alias("cols"),
        )
    )


def nonblank_paragraphs(df: DataFrame, col: str = "text") -> DataFrame:
    """Add ``paragraphs``: the lines of the text that are not only white space."""
    return df.withColumn("paragraphs", F.filter(text.split_lines(F.col(col)), lambda p: ~text.is_blank(p)))

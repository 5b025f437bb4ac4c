"""Cheap signs of a table in page text, and numbering of the tables that were extracted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork import patterns
from veilwork.functions import regex, text
from veilwork.functions.scale import number_rows

INDICATORS = tuple(patterns.TABLE_INDICATORS)


def indicator_column(c: Column, name: str) -> Column:
    found = c.rlike(regex.TABLE_JAVA[name])
    if name in regex.TABLE_NEEDS:
        found = c.contains(regex.TABLE_NEEDS[name]) & found
    return F.coalesce(found, F.lit(False))


def table_indicators(df: DataFrame, col: str = "text") -> DataFrame:
    """Add p1 .. p6, one boolean per pattern."""
    return df.withColumns({name: indicator_column(F.col(col), name) for name in INDICATORS})


def votes_column(c: Column) -> Column:
    """Table-like lines of the whole text."""
    lines = F.split(c, "\n", -1)

    def votes(line: Column) -> Column:
        pipes = F.char_length(line) - F.char_length(F.replace(line, F.lit("|"), F.lit("")))
        wide = F.size(F.split(line, regex.WIDE_GAP_JAVA, 3)) >= 3
        return (pipes >= 2) | wide | line.rlike(regex.TWO_NUMBERS_JAVA)

    return F.coalesce(F.size(F.filter(F.transform(lines, text.strip), votes)), F.lit(0))


def table_line_votes(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("votes", votes_column(F.col(col)))


def has_table_column(c: Column) -> Column:
    """Any pattern, cheapest first, then the votes; evaluation stops at the first hit."""
    sign = F.lit(False)
    for name in ("p2", "p6", "p3", "p1", "p4", "p5"):
        sign = sign | indicator_column(c, name)
    return sign | (F.when(c.isNotNull(), votes_column(c)).otherwise(F.lit(0)) >= patterns.VOTES_NEEDED)


def has_table_indicators(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("has_table", has_table_column(F.col(col)))


def gate_table_pages(pages: DataFrame, throughput: bool = False, col: str = "text") -> DataFrame:
    """Pages worth a table search; in throughput mode none is."""
    return pages.where(F.lit(False)) if throughput else pages.where(has_table_column(F.col(col)))


def number_tables(tables: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Contiguous 0-based ``table_index`` over the document; empty tables are skipped.

    ``page`` comes in 0-based and goes out 1-based. ``cols`` is the width of the first row.
    """
    filled = tables.where(F.size("data") > 0)
    indexed = number_rows(filled, [id_col], ["page", "pos"], "table_index", bucket=1 << 12)
    return indexed.select(
        id_col,
        F.col("table_index").cast("int").alias("table_index"),
        (F.col("page") + 1).cast("int").alias("page"),
        "data",
        F.size("data").alias("rows"),
        F.size(F.get("data", F.lit(0))).alias("cols"),
    )

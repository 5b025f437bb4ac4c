"""Replacement of listed terms."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from veilwork.functions import regex, text
from veilwork.functions.scale import lookup_join
from veilwork.options import normalize_term_list

_alternation = regex.alternation
# Tasks get the functions themselves, so executors need no copy of this package.
for _module in (regex, sys.modules[__name__]):
    cloudpickle.register_pickle_by_value(_module)


def _first_spellings(df: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(id, pos, term): non-blank trimmed terms, the first of each lower-cased form, in order.

    The list is deduplicated where it lies: sorted by (key, place) a repeat directly follows its
    first mention, so no row leaves its partition and the work is n log n in the list's length.
    """
    stripped = F.transform(terms, text.strip)
    placed = F.transform(
        F.filter(stripped, lambda t: t != ""), lambda t, i: F.struct(F.lower(t).alias("key"), i.alias("at"), t.alias("term"))
    )
    grouped = df.select(id_col, F.sort_array(placed).alias("_placed"))
    firsts = F.filter(
        F.transform(
            "_placed",
            lambda s, i: F.when(
                (i == 0) | (F.get(F.col("_placed"), i - 1)["key"] != s["key"]),
                F.struct(s["at"].alias("at"), s["term"].alias("term")),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return grouped.select(id_col, F.posexplode(F.sort_array(firsts)).alias("pos", "_t")).select(
        id_col, "pos", F.col("_t.term").alias("term")
    )


def parse_terms(df: DataFrame, raw_col: str, id_col: str = "id") -> DataFrame:
    """Split free input on line ends and commas into a clean term list, one row per term."""
    return _first_spellings(df, id_col, F.split(raw_col, regex.TERM_BREAK_JAVA, -1))


def normalize_terms(df: DataFrame, terms_col: str, id_col: str = "id") -> DataFrame:
    """The same cleaning for a column that already holds an array of terms; NULLs are skipped."""
    return _first_spellings(df, id_col, F.filter(terms_col, lambda t: t.isNotNull()))


def anonymize_column(c: Column, terms: Sequence[str], replacement: str = "") -> Column:
    terms = normalize_term_list(terms)
    if not terms:
        return c
    return F.regexp_replace(c, F.lit(regex.alternation(terms)), F.lit(text.literal_replacement(replacement or " ")))


def anonymize(df: DataFrame, terms: Sequence[str], replacement: str = "", col: str = "text") -> DataFrame:
    """Replace every hit of any term; an empty replacement means one space."""
    return df.withColumn(col, anonymize_column(F.col(col), terms, replacement))


def _with_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the pattern of each row's list of terms; a list has one row."""
    for batch in batches:
        patterns = [_alternation(terms) for terms in batch.column("_terms").to_pylist()]
        yield batch.drop_columns(["_terms"]).append_column("_pattern", pa.array(patterns, pa.string()))


def group_patterns(terms_df: DataFrame, key: str) -> DataFrame:
    """One pattern and replacement per key from (key, pos, term[, replacement]) rows.

    Repeats of a term are merged before its list is gathered (combined map-side), so what meets
    in one cell is the distinct list, which is what the pattern has to hold anyway. Patterns are
    made in the tasks that hold the lists, one for each key; texts never go there.
    """
    if "replacement" not in terms_df.columns:
        terms_df = terms_df.withColumn("replacement", F.lit(""))
    trimmed = terms_df.withColumn("term", text.strip(F.col("term"))).where("term <> ''")
    distinct = trimmed.groupBy(key, F.lower("term").alias("_k")).agg(
        F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos"), F.min_by("replacement", "pos").alias("replacement")
    )
    listed = distinct.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("_terms"),
        F.min_by("replacement", "pos").alias("_replacement"),
    )
    replacement = F.when(F.coalesce("_replacement", F.lit("")) == "", F.lit(" ")).otherwise(F.col("_replacement"))
    rows = listed.select(
        key, text.literal_replacement_column(replacement).alias("_replacement"),
        F.transform("_terms", lambda t: t["term"]).alias("_terms"),
    )
    schema = StructType([*rows.drop("_terms").schema.fields, StructField("_pattern", StringType())])
    return rows.mapInArrow(_with_patterns, schema)


def anonymize_by_group(
    df: DataFrame, terms_df: DataFrame, key: str, id_col: str = "doc_id", col: str = "text"
) -> DataFrame:
    """Each row is cleaned with the term list of its own key; keys without terms stay unchanged."""
    patterns_df = group_patterns(terms_df, key)
    size = F.octet_length("_pattern") + F.octet_length("_replacement") + F.lit(64)
    joined = lookup_join(df, patterns_df, [key], id_col, size)
    cleaned = F.when(
        F.col("_pattern").isNotNull(), F.regexp_replace(F.col(col), F.col("_pattern"), F.col("_replacement"))
    ).otherwise(F.col(col))
    return joined.withColumn(col, cleaned).select(*df.columns)

"""Removal of personal data by pattern, with an audit of what was found."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork import patterns
from veilwork.functions import regex

KINDS = tuple(patterns.PII_PATTERNS)


def _bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` bound to a lambda variable.

    A guard names its input more than once. Bound like this the input is evaluated once, however
    the optimizer moves the expression.
    """
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _guarded(c: Column, kind: str) -> Column:
    """The two costly patterns run only where a part of every match is present."""
    cleaned = F.regexp_replace(c, regex.PII_JAVA[kind], patterns.PII_MARKER)
    present = {"email": c.contains("@"), "phone": c.rlike(regex.PHONE_NEED)}
    return F.when(present[kind], cleaned).otherwise(c) if kind in present else cleaned


def may_hold_pii(c: Column) -> Column:
    """False only for text without a match of any kind. The marker itself brings no new match."""
    return c.contains("@") | c.rlike(regex.PII_DIGITS_NEED)


def remove_kind_column(c: Column, kind: str) -> Column:
    """Replace the matches of one kind."""
    return _bound(c, lambda x: _guarded(x, kind))


def remove_pii_column(c: Column) -> Column:
    """All kinds in their fixed order, each on the output of the one before.

    Most text holds nothing to remove; one look for digits and an at sign passes it on unread.
    """
    return _bound(c, lambda x: F.when(may_hold_pii(x), reduce(remove_kind_column, KINDS, x)).otherwise(x))


def _remove_kind(kind: str):
    def remove(df: DataFrame, col: str = "text") -> DataFrame:
        return df.withColumn(col, remove_kind_column(F.col(col), kind))

    remove.__name__ = f"pii_{kind}"
    remove.__doc__ = f"Replace every {kind} match by the marker."
    return remove


pii_email = _remove_kind("email")
pii_phone = _remove_kind("phone")
pii_ssn = _remove_kind("ssn")
pii_credit_card = _remove_kind("credit_card")
pii_iban = _remove_kind("iban")


def remove_pii_regex(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn(col, remove_pii_column(F.col(col)))


def _stages(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """``_s0`` (input) to ``_s5`` (all kinds removed), each its own projection so none is redone."""
    staged = df.select(*keep, F.col(col).alias("_s0")).withColumn("_may", may_hold_pii(F.col("_s0")))
    for i, kind in enumerate(KINDS):
        before = F.col(f"_s{i}")
        staged = staged.withColumn(
            f"_s{i + 1}", F.when(F.col("_may"), remove_kind_column(before, kind)).otherwise(before)
        )
    return staged


def _hits(i: int, measure: Column, none: Column) -> Column:
    """``measure`` of stage ``i`` only where the stage changed the text, i.e. where it has a match."""
    changed = F.col("_may") & (F.col(f"_s{i}") != F.col(f"_s{i + 1}"))
    return F.when(changed, measure).otherwise(none)


def pii_findings(df: DataFrame, id_col: str = "doc_id", col: str = "text") -> DataFrame:
    """One row per match: (id, kind, pos, match), ``pos`` counting within the document and kind.

    Every kind is looked for on text already cleaned of the earlier kinds. The five kinds come from
    one scan: their match arrays are tagged, concatenated and exploded together.
    """
    none = F.array().cast("array<string>")

    def tagged(i: int, kind: str) -> Column:
        matches = _hits(i, F.regexp_extract_all(f"_s{i}", F.lit(regex.PII_JAVA[kind]), F.lit(0)), none)
        return F.transform(
            matches, lambda m, at: F.struct(F.lit(kind).alias("kind"), at.alias("pos"), m.alias("match"))
        )

    found = _stages(df, col, id_col).select(
        id_col, F.explode(F.concat(*[tagged(i, kind) for i, kind in enumerate(KINDS)])).alias("_f")
    )
    return found.select(id_col, "_f.kind", "_f.pos", "_f.match")


def pii_summary(df: DataFrame, by: str = "source", col: str = "text") -> DataFrame:
    """Matches per group and kind. Counts are taken per row and combined before the shuffle."""
    counts = [
        F.sum(_hits(i, F.regexp_count(f"_s{i}", F.lit(regex.PII_JAVA[kind])), F.lit(0))).alias(kind)
        for i, kind in enumerate(KINDS)
    ]
    wide = _stages(df, col, by).groupBy(by).agg(*counts)
    return wide.unpivot([by], list(KINDS), "kind", "n")

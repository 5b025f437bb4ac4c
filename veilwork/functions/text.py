"""Text columns with the meaning of Python's ``str`` methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilwork.functions.regex import SPACE_CHARS, SPACE_RUN_JAVA


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def collapse_space(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE_RUN_JAVA, " "))


def split_lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def ellipsize(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def html_escape(c: Column) -> Column:
    out = c
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def literal_replacement(text: str) -> str:
    """Replacement text for ``regexp_replace`` that is taken as it stands."""
    return text.replace("\\", "\\\\").replace("$", "\\$")


def literal_replacement_column(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))


def joined_labels(sep: str, empty: str, *parts: tuple[Column, str]) -> Column:
    """Labels of the true conditions joined by ``sep``; ``empty`` if none holds."""
    text = F.concat_ws(sep, *[F.when(cond, F.lit(label)) for cond, label in parts])
    return F.when(text == "", F.lit(empty)).otherwise(text)


def kilobytes(size: Column) -> Column:
    """Size in KB to two places; halves go to the even digit, as Python rounds."""
    return F.bround(size / F.lit(1024.0), 2)

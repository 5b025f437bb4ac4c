"""Document fragments: the runs of text inside an office file, or any ordered pieces of a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.operators import spans, terms
from veilwork.options import RedactOptions


def select_redactable_parts(df: DataFrame, part: str = "part") -> DataFrame:
    """Body, headers and footers; footnotes, comments and everything else stay untouched."""
    p = F.col(part)
    side = (p.startswith("word/header") | p.startswith("word/footer")) & p.endswith(".xml")
    return df.where((p == "word/document.xml") | side)


def redact_fragments(df: DataFrame, op: str, opts: RedactOptions, tagger: spans.Tagger | None = None) -> DataFrame:
    """Add ``new_text`` and ``changed``; an operation that is not known passes text through."""
    kept = df.withColumn("_old", F.col("text"))
    if op == "anonymize":
        done = terms.anonymize(kept, opts.terms, opts.replacement)
    elif op == "remove_pii":
        done = spans.remove_pii(kept, tagger, opts.throughput, id_col=("doc_id", "part", "seq"))
    else:
        done = kept
    renamed = done.withColumnsRenamed({"text": "new_text", "_old": "text"})
    return renamed.withColumn("changed", ~F.col("new_text").eqNullSafe(F.col("text")))


def rejoin_fragments(df: DataFrame, col: str = "new_text", sep: str = "", id_col: str = "doc_id") -> DataFrame:
    """Text of every document part with its fragments back in order.

    The result holds one cell per part, so the fragments of a part meet in one task by nature; a
    part is one member of one file and is as large as it was when it was read.
    """
    ordered = F.sort_array(F.collect_list(F.struct(F.col("seq"), F.col(col).alias("t"))))
    return df.groupBy(id_col, "part").agg(F.array_join(F.transform(ordered, lambda s: s["t"]), sep).alias("text"))

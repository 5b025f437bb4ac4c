"""Entity spans: offsets in, redacted text out. The model that finds them is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork import patterns
from veilwork.functions import regex
from veilwork.operators.pii import remove_pii_regex

RUN = 128  # spans
TEXT_BLOCK = 4096  # code points
FEW = 16  # spans that are cut from the whole text

# A tagger gets the regex-cleaned documents and returns either the same rows with a ``spans``
# column, array<struct<start,end,label>> (no shuffle), or separate (id, start, end, label) rows.
Tagger = Callable[[DataFrame], DataFrame]


def redact_span_array(c: Column, spans: Column, labels: Sequence[str] = patterns.NER_LABELS) -> Column:
    """``c`` with the spans of the given labels replaced by the marker.

    Offsets count code points from 0, the end is exclusive. Every distinct span leaves a marker;
    where spans overlap or nest, text is kept only from the furthest end so far, so nothing that
    lies inside any of them is left. Spans without a start or an end are passed over.
    """
    offsets = F.transform(
        F.filter(spans, lambda s: s["label"].isin(*labels) & s["start"].isNotNull() & s["end"].isNotNull()),
        lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")),
    )
    redacted = _let(F.sort_array(offsets), lambda ordered: _let(_distinct(ordered), lambda wanted: _cut(c, wanted)))
    return F.when(c.isNull() | spans.isNull() | (F.size(spans) == 0), c).otherwise(redacted)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _distinct(ordered: Column) -> Column:
    return F.filter(ordered, lambda s, i: (i == 0) | (F.get(ordered, i - 1) != s))


def _furthest_before(ends: Column) -> Column:
    """For each place the largest end before it, at least 0: within its run of ``RUN`` places, and over the runs before."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(ends) - 1) / RUN).cast("int")), lambda k: F.slice(ends, k * RUN + 1, F.lit(RUN)))

    def largest(values: Column, n: Column) -> Column:
        return F.greatest(F.array_max(F.slice(values, F.lit(1), n)), F.lit(0))

    def within(run: Column, before: Column) -> Column:
        return F.transform(run, lambda _, i: F.greatest(before, largest(run, i)))

    def over(held: Column) -> Column:
        return _let(
            F.transform(held, F.array_max),
            lambda tops: F.flatten(F.transform(held, lambda run, k: _let(largest(tops, k), lambda before: within(run, before)))),
        )

    return F.when(F.size(ends) > 0, _let(runs, over)).otherwise(F.array().cast("array<int>"))


def _cut(c: Column, wanted: Column) -> Column:
    """Text between the spans, a marker for each span, as one string.

    Beyond a few spans the text is held in blocks, so a piece is taken from the blocks it lies in and not counted from
    the start. Work grows with the number of spans and the length of the text, not with their product.
    """
    last_block = F.floor(F.greatest(F.char_length(c) - 1, F.lit(0)) / TEXT_BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last_block), lambda k: F.substring(c, k * TEXT_BLOCK + 1, F.lit(TEXT_BLOCK)))

    def between(text: Column, begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / TEXT_BLOCK).cast("int"), F.floor((end - 1) / TEXT_BLOCK).cast("int")
        held = F.array_join(F.slice(text, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.when(end > begin, F.substring(held, begin - first * TEXT_BLOCK + 1, end - begin)).otherwise("")

    def taken(begin: Column, end: Column) -> Column:
        return F.when(end > begin, F.substring(c, begin + 1, end - begin)).otherwise("")

    def joined(take: Callable[[Column, Column], Column], furthest: Column) -> Column:
        kept = F.transform(wanted, lambda s, i: take(F.get(furthest, i), F.greatest(s["start"], F.lit(0))))
        end = F.coalesce(F.array_max(F.transform(wanted, lambda s: s["end"])), F.lit(0))
        rest = take(F.greatest(end, F.lit(0)), F.char_length(c))
        return F.concat(F.array_join(F.transform(kept, lambda k: F.concat(k, F.lit(patterns.PII_MARKER))), ""), rest)

    def swept(furthest: Column) -> Column:
        in_blocks = _let(blocks, lambda text: joined(lambda begin, end: between(text, begin, end), furthest))
        return F.when(F.size(wanted) <= FEW, joined(taken, furthest)).otherwise(in_blocks)

    return _let(_furthest_before(F.transform(wanted, lambda s: s["end"])), swept)


def redact_spans(
    df: DataFrame,
    spans: DataFrame,
    labels: Sequence[str] = patterns.NER_LABELS,
    id_col: str | Sequence[str] = "doc_id",
    col: str = "text",
) -> DataFrame:
    """Redact from span rows (id, start, end, label); documents without spans pass unchanged.

    Only offsets are gathered per document, as a set that is merged before the shuffle and bounded
    by the one text it points into; the text itself moves once, for the join on the unique id.
    """
    ids = [id_col] if isinstance(id_col, str) else list(id_col)
    wanted = spans.where(F.col("label").isin(*labels))
    listed = wanted.groupBy(*ids).agg(F.collect_set(F.struct("start", "end", "label")).alias("_spans"))
    return (
        df.join(listed, ids, "left")
        .withColumn(col, redact_span_array(F.col(col), F.col("_spans"), labels))
        .select(*df.columns)
    )


def ner_mode(tagger: Tagger | None, throughput: bool) -> Column:
    return F.lit("regex_only" if throughput or tagger is None else "spacy_batch")


def remove_pii(
    df: DataFrame,
    tagger: Tagger | None = None,
    throughput: bool = False,
    id_col: str | Sequence[str] = "doc_id",
    col: str = "text",
) -> DataFrame:
    """Patterns first, then the spans a tagger finds on the cleaned text."""
    cleaned = remove_pii_regex(df, col)
    if throughput or tagger is None:
        return cleaned
    tagged = tagger(cleaned)
    if "spans" not in tagged.columns:
        return redact_spans(cleaned, tagged, id_col=id_col, col=col)
    return tagged.withColumn(col, redact_span_array(F.col(col), F.col("spans"))).select(*df.columns)


def dictionary_tagger(labels: dict[str, str], col: str = "text") -> Tagger:
    """Tagger over a short fixed list of {term: label}; a stand-in where no model is at hand.

    The text between hits and the hits themselves give every offset by adding lengths, so it is
    one projection over built-in functions.
    """
    pattern = regex.alternation(labels)
    label_of = F.create_map(*[F.lit(x) for term, label in labels.items() for x in (term.lower(), label)])

    def tag(df: DataFrame) -> DataFrame:
        hits = F.regexp_extract_all(col, F.lit(pattern), F.lit(0))
        gaps = F.split(col, pattern, -1)
        split = df.withColumn(
            "_pairs",
            F.transform(
                F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
                lambda p: F.struct(
                    F.char_length(p["gap"]).alias("gap"),
                    F.char_length(p["hit"]).alias("len"),
                    F.try_element_at(label_of, F.lower(p["hit"])).alias("label"),
                ),
            ),
        )
        empty = F.array().cast("array<struct<start:int,end:int,label:string>>")

        def step(acc, p):
            at = acc["at"] + p["gap"]
            span = F.struct(at.alias("start"), (at + p["len"]).alias("end"), p["label"].alias("label"))
            return F.struct(
                (at + F.coalesce(p["len"], F.lit(0))).alias("at"),
                F.when(p["len"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"),
            )

        start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
        return split.withColumn("spans", F.aggregate("_pairs", start, step, lambda a: a["spans"])).drop("_pairs")

    return tag

"""Admission of batches and the tables shown about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilwork import patterns
from veilwork.functions import text
from veilwork.functions.scale import BROADCAST_LIMIT_BYTES, lookup_join, number_rows
from veilwork.operators.spans import Tagger
from veilwork.options import RedactOptions
from veilwork.session import materialized


def file_listing(df: DataFrame) -> DataFrame:
    """(batch_id, no, filename, file_type, size_kb) with ``no`` from 1 in upload order."""
    kind = F.coalesce("file_type", F.lit("Unknown")) if "file_type" in df.columns else F.lit("Unknown")
    slim = df.select("batch_id", "ord", "filename", kind.alias("file_type"), "size")
    return number_rows(slim, ["batch_id"], ["ord"], "_n").select(
        "batch_id",
        (F.col("_n") + 1).alias("no"),
        "filename",
        "file_type",
        text.kilobytes(F.col("size")).alias("size_kb"),
    )


def limit_files(df: DataFrame, max_files: int | None = None) -> DataFrame:
    """First ``max_files`` files of each batch in upload order; all of them where no limit is given.

    A filtered row number: Spark keeps at most ``max_files`` rows of a batch per task before the
    shuffle, so the size of a batch does not matter.
    """
    if max_files is None:
        return df
    order = Window.partitionBy("batch_id").orderBy("ord")
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_files).drop("_n")


def oversized_files(df: DataFrame, max_bytes: int = patterns.MAX_FILE_BYTES) -> DataFrame:
    return df.where(F.col("size") > max_bytes).select(
        "batch_id", "ord", "filename", "size", F.bround(F.col("size") / F.lit(1048576.0), 2).alias("size_mb")
    )


def _placed(df: DataFrame, max_files: int | None) -> DataFrame:
    """(batch_id, ord, size, kept): is the file among the first ``max_files`` of its batch?"""
    slim = df.select("batch_id", "ord", "size")
    if max_files is None:
        return slim.withColumn("kept", F.lit(True))
    numbered = number_rows(slim, ["batch_id"], ["ord"], "_n")
    return numbered.withColumn("kept", F.col("_n") < max_files).drop("_n")


def _judged(placed: DataFrame, max_file: int | None, max_batch: int | None) -> DataFrame:
    kept = F.col("kept")
    large = F.lit(False) if max_file is None else kept & (F.col("size") > max_file)
    fits = F.lit(True) if max_batch is None else F.coalesce(F.col("total_bytes") <= max_batch, F.lit(True))
    return (
        placed.groupBy("batch_id")
        .agg(
            F.count("*").alias("n_files"),
            F.count_if(kept).alias("n_kept"),
            F.count_if(large).alias("n_oversized"),
            F.sum(F.when(kept, F.col("size"))).alias("total_bytes"),
        )
        .withColumn("ok", (F.col("n_oversized") == 0) & fits)
    )


def batch_verdict(
    df: DataFrame, max_files: int | None = None, max_file: int | None = None, max_batch: int | None = None
) -> DataFrame:
    """One row per batch: its files, and whether those it keeps, and their sum, are within the limits.

    Limits are off unless they are given.
    """
    return _judged(_placed(df, max_files), max_file, max_batch)


def admit_documents(
    df: DataFrame,
    max_files: int | None = None,
    max_file: int | None = None,
    max_batch: int | None = None,
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Every row, with ``admitted`` and, where it is not, the ``reason``.

    Limits are off unless they are given. Batches over a size limit are refused whole, files past
    ``max_files`` on their own. ``ord`` is unique within a batch. The verdict is found on (batch_id,
    ord, size) alone; the refused places are a lookup, broadcast where their measured size allows it, so
    contents stay where they lie unless very many files are refused.
    """
    if max_files is None and max_file is None and max_batch is None:
        return df.withColumns({"admitted": F.lit(True), "reason": F.lit(None).cast("string")})
    placed = _placed(df, max_files)
    verdict = _judged(placed, max_file, max_batch).select("batch_id", "n_oversized", "ok")
    large = F.lit(False) if max_file is None else F.col("size") > max_file
    reason = (
        F.when(~F.col("kept"), f"More than {max_files} files in the batch")
        .when(~F.col("ok") & large, "File is larger than the limit")
        .when(~F.col("ok") & (F.col("n_oversized") > 0), "Another file of the batch is larger than the limit")
        .when(~F.col("ok"), "Batch is larger than the limit")
    )
    judged = placed.join(verdict, "batch_id").select("batch_id", "ord", reason.alias("reason"))
    refused = materialized(judged.where("reason IS NOT NULL"), "refused")
    # A place has one file, so no key is hot and no row of the lookup needs copies.
    found = lookup_join(df, refused, ["batch_id", "ord"], "ord", F.lit(128), limit=limit, salts=1)
    return found.select(*df.columns, F.col("reason").isNull().alias("admitted"), "reason")


def ordered_results(results: DataFrame) -> DataFrame:
    return results.orderBy("batch_id", "ord")


def recent_results(results: DataFrame) -> DataFrame:
    """Finished results, newest first; upload order breaks ties."""
    return results.where("status = 'Done'").orderBy(F.desc("processed_time"), "batch_id", "ord")


def _operations(sep: str, empty: str, labels: tuple[str, str, str]) -> Column:
    ops = F.col("operations")
    return text.joined_labels(
        sep, empty, (ops["anonymize"], labels[0]), (ops["remove_pii"], labels[1]), (ops["extract_json"], labels[2])
    )


def ops_label(results: DataFrame) -> DataFrame:
    return results.withColumn("ops_label", _operations(" | ", "Raw", ("A", "P", "J")))


def _content_size() -> Column:
    return F.coalesce(F.octet_length("content"), F.lit(0))


def processing_summary(results: DataFrame, partial: bool = False) -> DataFrame:
    """What was made of each file; a cancelled batch has no cache column."""
    size = F.when(_content_size() > 0, text.kilobytes(_content_size()).cast("string")).otherwise(F.lit("N/A"))
    cache = [F.when(F.col("cache_hit"), "Yes").otherwise("No").alias("cache")] if not partial else []
    return results.select(
        "batch_id",
        "ord",
        F.col("original_name").alias("original_file"),
        F.col("name").alias("processed_file"),
        F.col("file_extension").alias("output_format"),
        size.alias("size_kb"),
        *cache,
        _operations(", ", "None", ("Anonymize", "Remove PII", "Extract JSON")).alias("operations"),
    )


def results_by_order(status: DataFrame, results: DataFrame) -> DataFrame:
    """Status board with the result of every finished file; the last result for a place wins.

    Of results of the same time the one with the highest ``seq`` (order of arrival) is the last.
    Results are cut to one row per place before the join, and their content stays behind.
    """
    slim = results.select(
        "batch_id", F.col("ord").alias("idx"), "name", "file_extension", "processed_time",
        F.col("seq") if "seq" in results.columns else F.lit(0).alias("seq"),
        _content_size().cast("long").alias("size"),
    )
    last = Window.partitionBy("batch_id", "idx").orderBy(F.desc("processed_time"), F.desc("seq"))
    latest = slim.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "processed_time", "seq")
    done = F.col("status") == "Done"
    found = status.join(latest, ["batch_id", "idx"], "left")
    return found.select(
        *status.columns, *[F.when(done, F.col(c)).alias(c) for c in ("name", "file_extension", "size")]
    )


def timing_rollup(steps: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Seconds per document and step, with the step's name for display."""
    return (
        steps.groupBy(id_col, "step")
        .agg(F.sum("seconds").alias("_sum"))
        .select(
            id_col,
            "step",
            F.initcap(F.replace("step", F.lit("_"), F.lit(" "))).alias("label"),
            F.bround("_sum", 3).alias("seconds"),
        )
    )


def metadata_column(
    opts: RedactOptions, tagger: Tagger | None, timing: Column, hit: Column, processed: Column, skipped: Column
) -> Column:
    """What a result says about how it was made: seconds by step, modes, copies and image counts."""
    ocr = F.struct(
        F.lit(patterns.OCR_ENGINE if opts.ocr_available else "unavailable").alias("engine"),
        F.coalesce(processed, F.lit(0)).cast("int").alias("images_processed"),
        F.coalesce(skipped, F.lit(0)).cast("int").alias("images_skipped"),
        F.lit(opts.max_images).cast("int").alias("max_images_per_doc"),
        F.lit(opts.ocr_enabled and not opts.throughput).alias("enabled"),
    )
    return F.struct(
        F.coalesce(timing, F.create_map().cast("map<string,double>")).alias("timing"),
        F.lit(opts.throughput).alias("throughput_mode"),
        F.coalesce(hit, F.lit(False)).alias("cache_hit"),
        F.lit("regex_only" if opts.throughput or tagger is None else "spacy_batch").alias("ner_mode"),
        ocr.alias("ocr"),
    )


def processing_metadata(
    docs: DataFrame,
    steps: DataFrame,
    ocr_counts: DataFrame,
    opts: RedactOptions,
    tagger: Tagger | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """(id, metadata): one struct per document. ``docs`` may carry ``cache_hit``.

    The timing map has one entry per kind of step, summed before it is gathered.
    """
    summed = steps.groupBy(id_col, "step").agg(F.sum("seconds").alias("seconds"))
    timing = summed.groupBy(id_col).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("step", "seconds")))).alias("_timing"))
    counts = ocr_counts.select(id_col, "images_processed", "images_skipped")
    hit = F.col("cache_hit") if "cache_hit" in docs.columns else F.lit(False)
    keyed = docs.select(id_col, hit.alias("_hit"))
    metadata = metadata_column(opts, tagger, F.col("_timing"), F.col("_hit"), F.col("images_processed"), F.col("images_skipped"))
    return keyed.join(timing, id_col, "left").join(counts, id_col, "left").select(id_col, metadata.alias("metadata"))

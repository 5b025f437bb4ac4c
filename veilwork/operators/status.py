"""Status of files and batches from the messages workers send."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Messages that set a state outright; small numbers keep the aggregation buffers fixed-width.
_CODES = {"status": 1, "result": 2, "error": 3}


def _code() -> Column:
    code = F.lit(None).cast("int")
    for name, number in _CODES.items():
        code = F.when(F.col("type") == name, number).otherwise(code)
    return code


def status_state(messages: DataFrame) -> DataFrame:
    """Last state-setting message and last cancel per file, combined before the shuffle.

    The same aggregation serves a stream: it needs no order of arrival and keeps three numbers per
    file.
    """
    at = F.when(F.col("_code").isNotNull(), F.col("seq"))
    cancel = F.when(F.col("type") == "cancel", F.col("seq"))
    return (
        messages.withColumn("_code", _code())
        .groupBy("batch_id", "idx")
        .agg(F.max_by("_code", at).alias("last_code"), F.max(at).alias("last_seq"), F.max(cancel).alias("cancel_seq"))
    )


def status_columns(state: DataFrame) -> DataFrame:
    """Add ``status`` and ``progress``. A cancel counts only while a file is queued or processing."""
    open_ = F.coalesce("last_code", F.lit(0)) < _CODES["result"]
    cancelled = open_ & F.col("cancel_seq").isNotNull() & (F.col("cancel_seq") > F.coalesce("last_seq", F.lit(-1)))
    status = (
        F.when(cancelled, "Cancelled")
        .when(F.col("last_code") == _CODES["status"], "Processing")
        .when(F.col("last_code") == _CODES["result"], "Done")
        .when(F.col("last_code") == _CODES["error"], "Error")
        .otherwise("Queued")
    )
    progress = F.when(F.col("status") == "Done", 100).when(F.col("status") == "Processing", 50).otherwise(0)
    return state.withColumn("status", status).withColumn("progress", progress)


def status_fold(messages: DataFrame, files: DataFrame) -> DataFrame:
    """(batch_id, idx, file, status, progress) for every file, also those without a message."""
    joined = files.join(status_state(messages), ["batch_id", "idx"], "left")
    return status_columns(joined).select("batch_id", "idx", "file", "status", "progress")


def progress_counts(status: DataFrame) -> DataFrame:
    """Files per state and the finished share of each batch."""
    def n(state: str) -> Column:
        return F.count_if(F.col("status") == state)

    counted = status.groupBy("batch_id").agg(
        n("Queued").alias("queued"),
        n("Processing").alias("processing"),
        n("Done").alias("completed"),
        n("Error").alias("errors"),
        n("Cancelled").alias("cancelled"),
        F.count("*").alias("total"),
    )
    finished = F.col("completed") + F.col("errors") + F.col("cancelled")
    return counted.withColumn("ratio", F.least(finished / F.nullif("total", F.lit(0)), F.lit(1.0)))


def error_log(messages: DataFrame) -> DataFrame:
    """Distinct error lines of a batch with the place of their first mention."""
    line = F.concat(
        F.lit("Error processing "), F.coalesce("original_name", F.lit("None")), F.lit(": "), F.coalesce("error", F.lit("None"))
    )
    return (
        messages.where("type = 'error'")
        .groupBy("batch_id", line.alias("message"))
        .agg(F.min("seq").alias("first_seq"))
    )


def cancel_summary(messages: DataFrame) -> DataFrame:
    """What a batch had done when it was first cancelled."""
    first = messages.where("type = 'cancelled'").groupBy("batch_id").agg(
        *[F.coalesce(F.min_by(c, "seq"), F.lit(0)).alias(c) for c in ("submitted", "total", "cancelled")]
    )
    processed = F.col("submitted") - F.col("cancelled")
    return first.withColumn("processed", processed).withColumn(
        "message",
        F.concat(
            F.lit("Processing cancelled by user. "), processed, F.lit(" files were processed, "),
            F.col("cancelled"), F.lit(" files were cancelled."),
        ),
    )

"""The same operators on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilwork.operators.spans import Tagger
from veilwork.operators.status import status_columns, status_state
from veilwork.options import RedactOptions
from veilwork.plans.process import redact_document
from veilwork.session import checkpoint_dir


def stream_redact(documents: DataFrame, opts: RedactOptions, tagger: Tagger | None = None) -> DataFrame:
    """Redact documents as they arrive: stateless, the same columns as in batch."""
    return redact_document(documents, opts, tagger)


def stream_status(messages: DataFrame) -> DataFrame:
    """Live status of every file that has sent a message, in update or complete mode; ``board`` keeps it on files."""
    return status_columns(status_state(messages)).select("batch_id", "idx", "status", "progress")


def write_stream(
    df: DataFrame, path: str, name: str, fmt: str = "parquet", drain: bool = True
) -> StreamingQuery:
    """Append to files, exactly once by the checkpoint kept in the cluster's shared folder."""
    writer = (
        df.writeStream.format(fmt)
        .outputMode("append")
        .option("checkpointLocation", f"{checkpoint_dir(df.sparkSession)}/streams/{name}")
        .queryName(name)
    )
    return (writer.trigger(availableNow=True) if drain else writer).start(path)

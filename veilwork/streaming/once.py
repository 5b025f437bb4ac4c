"""Process-once on streams: keyed state that tells new content from content seen within a horizon."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilwork.operators.dedup import fingerprint
from veilwork.options import RedactOptions
from veilwork.session import checkpoint_dir

# Tasks carry the functions below with them; executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NO_DATA_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"
_LAST = np.iinfo(np.int64).max
_ROW_COLUMNS = ["fp", "at", "new", "content", "row"]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: of the copies in a batch only the one of the lowest place stays a candidate and keeps its content."""
    for batch in batches:
        names, at = batch.column("fp").dictionary_encode().indices, batch.column("at")
        place = at.fill_null(_LAST).to_numpy(zero_copy_only=False)
        code = names.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((place, code))
        first = np.zeros(len(order), bool)
        first[order] = np.concatenate([[True], code[order][1:] != code[order][:-1]]) if len(order) else False
        first |= code < 0
        content = batch.column("content")
        kept = pc.if_else(pa.array(first), content, pa.scalar(None, content.type))
        yield pa.RecordBatch.from_arrays([batch.column("fp"), at, pa.array(first), kept, batch.column("row")], names=_ROW_COLUMNS)


def _smallest_first(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Frames of one content, each with whether it is the row of the lowest place; one row is held back at a time."""
    best = None
    for frame in frames:
        first = frame["at"].idxmin() if frame["at"].notna().any() else frame.index[0]
        own, others = frame.loc[[first]], frame.drop(index=first)
        if best is not None and not (pd.isna(best["at"].iloc[0]) or own["at"].iloc[0] < best["at"].iloc[0]):
            best, own = own, best
        if best is not None:
            yield best, False
        best = own
        if len(others):
            yield others, False
    if best is not None:
        yield best, True


def _remember(horizon_ms: int) -> Callable:
    """State of a content: when it was first seen. A row is new if nothing is remembered.

    The time is read from the state, so content is forgotten on time although a timer only fires with a batch.
    """

    def task(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames = (f[_ROW_COLUMNS] for f in frames)
        if state.hasTimedOut:
            state.remove()
            return
        if not key[1]:  # rows that need no state: known copies, and rows without a content
            yield from frames
            return
        now = state.getCurrentProcessingTimeMs()
        first = state.get[0] if state.exists else None
        known = first is not None and now < first + horizon_ms
        if not known:
            first = now
            state.update((first,))
        state.setTimeoutDuration(max(1, first + horizon_ms - now))
        for frame, smallest in _smallest_first(frames):
            new = smallest and not known
            yield frame.assign(new=new, content=frame["content"] if new else None)

    return task


def stream_process_once(
    documents: DataFrame,
    opts: RedactOptions,
    horizon: str = "1 hour",
    content: str = "text",
    order: str = "doc_id",
    salts: int = 64,
) -> DataFrame:
    """Every row once, with ``fp`` and ``cache_hit``: was its content seen before within ``horizon``?

    The horizon is time of processing, not a time in the rows, so a new document is new however late it
    comes. Of the rows of one content in a micro-batch the first in ``order``, a number, is the new one; rows
    without a content are never copies of each other. Only new rows keep their content.

    Rows meet by content, and the state is one time for each content of the horizon. Of a content that floods the stream
    each Arrow batch of a task sends one candidate there; its other rows are copies, lose their content on the spot and pass
    by one of ``salts`` keys without a state. So no task gets all rows of a content.
    """
    others = [c for c in documents.columns if c not in ("fp", content)]
    rows = fingerprint(documents, opts, content).select(
        "fp", F.col(order).cast("long").alias("at"), F.lit(True).alias("new"), F.col(content).alias("content"), F.struct(*others).alias("row")
    )
    collapsed = rows.mapInArrow(_collapse, rows.schema)
    asked = F.col("new") & F.col("fp").isNotNull()
    salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("string")
    keyed = collapsed.withColumns({"_key": F.when(asked, F.col("fp")).otherwise(salt), "_asked": asked})
    task = _remember(int(pd.Timedelta(horizon).total_seconds() * 1000))
    told = keyed.groupBy("_key", "_asked").applyInPandasWithState(task, rows.schema, "first long", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return told.select("row.*", F.col("content").alias(content), "fp", (~F.col("new")).alias("cache_hit"))


def write_processed_once(
    documents: DataFrame,
    fn: Callable[[DataFrame], DataFrame],
    opts: RedactOptions,
    path: str,
    name: str,
    horizon: str = "1 hour",
    content: str = "text",
    order: str = "doc_id",
    salts: int = 64,
    drain: bool = True,
) -> StreamingQuery:
    """Run ``fn`` over content that is new within the horizon and keep the results for its copies.

    Below ``path``, ``results`` holds (fp, columns of ``fn``) of new content and ``rows`` every row without its
    content. Each micro-batch writes folders of its own, so one that is repeated after a failure overwrites only itself, and
    a later call with the same ``name`` goes on where this one stopped. See ``read_processed_once``.
    """
    told = stream_process_once(documents, opts, horizon, content, order, salts)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()  # state is asked once, for both outputs
        fresh = batch.where(~F.col("cache_hit") & F.col("fp").isNotNull()).select("fp", content)
        fn(fresh).write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        batch.drop(content).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        batch.unpersist()

    spark = told.sparkSession
    writer = (
        told.writeStream.outputMode("append").foreachBatch(write).queryName(name)
        .option("checkpointLocation", f"{checkpoint_dir(spark)}/streams/{name}")
    )
    # Timers ask for a batch without data after every batch, so a drain would never end. A query keeps the settings it
    # started with; what is forgotten is read from the state's time, not from its timer.
    given = spark.conf.get(_NO_DATA_BATCHES)
    spark.conf.set(_NO_DATA_BATCHES, "false")
    try:
        return (writer.trigger(availableNow=True) if drain else writer).start()
    finally:
        spark.conf.set(_NO_DATA_BATCHES, given)


def read_processed_once(spark: SparkSession, path: str) -> DataFrame:
    """Every row written so far with the result of its content; rows without a content have none.

    Content that was forgotten and came again has two results, which are equal: one is taken. Rows of a
    content that fills a third of the table meet the result in more than one task by adaptive skew joins.
    """
    rows, results = (spark.read.parquet(f"{path}/{part}").drop("batch") for part in ("rows", "results"))
    return rows.join(results.dropDuplicates(["fp"]), "fp", "left")

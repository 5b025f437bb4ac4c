"""A status board on files, kept by a stream: changed files only, merged by rule and folded now and then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilwork.operators.status import status_columns, status_state
from veilwork.session import checkpoint_dir

STATE = "batch_id string, idx int, last_code int, last_seq long, cancel_seq long"
KEYS = ("batch_id", "idx")
FOLD_EVERY = 32


def merge_states(states: DataFrame) -> DataFrame:
    """One state a file: the last message that sets a state, and the last cancel.

    States may come in any order and more than once, so a repeated micro-batch changes nothing. They are
    combined before the shuffle.
    """
    return states.groupBy(*KEYS).agg(
        F.max_by("last_code", "last_seq").alias("last_code"), F.max("last_seq").alias("last_seq"), F.max("cancel_seq").alias("cancel_seq")
    )


class StatusBoard:
    """States below ``path``: one folder for each micro-batch (``change=n``) and folds of all before (``fold=n``)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._fs_path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of finished folders; one that was not written to its end does not count."""
        found = self._fs.globStatus(self._fs_path(f"{self.path}/{kind}=*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)

    def _parts(self) -> tuple[list[int], list[str]]:
        folds = self._numbers("fold")
        last = folds[-1] if folds else -1
        changes = [n for n in self._numbers("change") if n > last]
        return changes, [f"{self.path}/change={n}" for n in changes] + ([f"{self.path}/fold={last}"] if folds else [])

    def states(self) -> DataFrame:
        _, parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], STATE)
        return merge_states(self.spark.read.schema(STATE).parquet(*parts))

    def change(self, states: DataFrame, number: int, fold_every: int = FOLD_EVERY) -> None:
        """Write the states of one micro-batch; fold when enough have come together.

        A repeated micro-batch overwrites its own folder, or one that a fold already holds.
        """
        states.select(*[f.split()[0] for f in STATE.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/change={number}")
        changes, _ = self._parts()
        if len(changes) >= fold_every:
            self.states().write.mode("overwrite").parquet(f"{self.path}/fold={changes[-1]}")
            self._drop_old()

    def _drop_old(self) -> None:
        """Remove what the last fold but one covers: a reader of the last board may still be at work on the rest."""
        folds = self._numbers("fold")
        if len(folds) > 1:
            old = [("change", n) for n in self._numbers("change") if n <= folds[-2]] + [("fold", n) for n in folds[:-2]]
            for kind, n in old:
                self._fs.delete(self._fs_path(f"{self.path}/{kind}={n}"), True)

    def read(self) -> DataFrame:
        """(batch_id, idx, status, progress) of every file that has sent a message."""
        return status_columns(self.states()).select(*KEYS, "status", "progress")


def write_status(messages: DataFrame, path: str, name: str, drain: bool = True, fold_every: int = FOLD_EVERY) -> StreamingQuery:
    """Keep the board at ``path`` from a stream of messages; a later call with the same ``name`` goes on where this stopped.

    Update mode: a micro-batch hands on only files that had a message in it.
    """
    spark = messages.sparkSession
    board = StatusBoard(spark, path)
    writer = (
        status_state(messages).writeStream.outputMode("update").queryName(name)
        .foreachBatch(lambda states, number: board.change(states, number, fold_every))
        .option("checkpointLocation", f"{checkpoint_dir(spark)}/streams/{name}")
    )
    return (writer.trigger(availableNow=True) if drain else writer).start()

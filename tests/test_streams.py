"""Streams give what the batch gives."""

import time
from datetime import datetime
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilwork.operators import spans, status
from veilwork.options import RedactOptions
from veilwork.plans.process import redact_document
from veilwork.streaming import board, jobs, once

OPTS = RedactOptions(anonymize=True, remove_pii=True, terms=("ann",), replacement="X")
DOCS = [(1, "Ann a@b.co"), (2, "123-45-6789"), (3, "Ann a@b.co"), (4, "plain bob")]


def _dropped_in(spark, folder, frames):
    """A source folder read one file at a time."""
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{folder}/{i}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_stream_redact(spark, tmp_path):
    frames = [spark.createDataFrame(DOCS[i : i + 2], "doc_id long, text string") for i in (0, 2)]
    tagger = spans.dictionary_tagger({"bob": "PERSON"})
    out = jobs.stream_redact(_dropped_in(spark, tmp_path / "in", frames), OPTS, tagger)
    jobs.write_stream(out, str(tmp_path / "out"), "redact_test").awaitTermination()
    expected = redact_document(frames[0].union(frames[1]), OPTS, tagger).collect()
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(expected)


SEEN = "doc_id long, text string, written timestamp_ntz, fine decimal(20,3), cache string"


def _seen(*rows):
    return [(i, t, datetime(2024, 1, 1, h), Decimal(2**50) + i, None if i % 2 else "c") for i, t, h in rows]


def _write_once(spark, source, out, name, **kw):
    double = lambda fresh: fresh.withColumn("text", F.concat("text", "text")).withColumn("size", F.length("text"))
    once.write_processed_once(source, double, OPTS, str(out), name, **kw).awaitTermination()
    return {r.doc_id: r for r in once.read_processed_once(spark, str(out)).collect()}


def test_stream_process_once_gives_copies_their_result(spark, tmp_path):
    """A new document is new however old it says it is; copies keep their row; rows without a content are no copies."""
    frames = [
        spark.createDataFrame(_seen((9, "a", 20), (2, "b", 20), (7, None, 20), (8, None, 20), (1, "a", 20)), SEEN),
        spark.createDataFrame(_seen((3, "a", 21), (4, "c", 0)), SEEN),
        spark.createDataFrame(_seen((5, "a", 0), (6, "d", 0)), SEEN),
    ]
    source = _dropped_in(spark, tmp_path / "in", frames)
    got = _write_once(spark, source, tmp_path / "out", f"once_{tmp_path.name}", horizon="2 hours")
    given = {r.doc_id: r for f in frames for r in f.collect()}
    assert sorted(got) == list(range(1, 10))
    assert sorted(i for i, r in got.items() if not r.cache_hit) == [1, 2, 4, 6, 7, 8]
    for i, r in got.items():
        assert (r.written, r.fine, r.cache) == (given[i].written, given[i].fine, given[i].cache)
        assert r.text == (given[i].text and given[i].text * 2) and r.size == (2 if given[i].text else None)
    assert spark.read.parquet(str(tmp_path / "out/results")).count() == 4


def test_stream_process_once_goes_on_after_a_restart(spark, tmp_path):
    name = f"once_{tmp_path.name}"
    first = spark.createDataFrame(_seen((1, "a", 0), (2, "b", 0)), SEEN)
    _write_once(spark, _dropped_in(spark, tmp_path / "in", [first]), tmp_path / "out", name)
    spark.createDataFrame(_seen((3, "a", 0), (4, "c", 0)), SEEN).coalesce(1).write.parquet(str(tmp_path / "in/later"))
    source = spark.readStream.schema(SEEN).parquet(f"{tmp_path}/in/*")
    got = _write_once(spark, source, tmp_path / "out", name)
    assert {i: r.cache_hit for i, r in got.items()} == {1: False, 2: False, 3: True, 4: False}
    assert _write_once(spark, source, tmp_path / "out", name) == got  # nothing new


def test_stream_process_once_forgets_after_the_horizon(spark, tmp_path):
    name = f"once_{tmp_path.name}"
    first = spark.createDataFrame(_seen((1, "a", 0)), SEEN)
    _write_once(spark, _dropped_in(spark, tmp_path / "in", [first]), tmp_path / "out", name, horizon="1 second")
    time.sleep(1.5)
    spark.createDataFrame(_seen((2, "a", 0), (3, "a", 0)), SEEN).coalesce(1).write.parquet(str(tmp_path / "in/later"))
    got = _write_once(spark, spark.readStream.schema(SEEN).parquet(f"{tmp_path}/in/*"), tmp_path / "out", name, horizon="1 second")
    assert {i: (r.cache_hit, r.text) for i, r in got.items()} == {1: (False, "aa"), 2: (False, "aa"), 3: (True, "aa")}


def test_a_flooding_content_sends_few_candidates_to_its_state():
    batch = pa.RecordBatch.from_pylist(
        [{"fp": None if i % 10 == 3 else f"f{i % 3 if i % 2 else 9}", "at": None if i % 7 == 0 else 1000 - i, "new": True, "content": str(i), "row": {"doc_id": i}} for i in range(1000)]
    )
    (out,) = once._collapse(iter([batch]))
    rows = out.to_pylist()
    asked = [r for r in rows if r["new"] and r["fp"] is not None]
    assert len(asked) == 4 and all(r["new"] and r["content"] for r in rows if r["fp"] is None)
    for r in asked:
        assert r["at"] == min(x["at"] for x in rows if x["fp"] == r["fp"] and x["at"] is not None) and r["content"] == str(r["row"]["doc_id"])
    assert all(r["content"] is None for r in rows if not r["new"])


MESSAGES = "batch_id string, idx int, seq long, type string"
SENT = [("b", i % 5, n, k) for n, (i, k) in enumerate([(0, "status"), (1, "cancel"), (0, "result"), (2, "status"), (1, "status"), (3, "error"), (2, "cancel"), (3, "cancel"), (4, "cancel")])]


def _board_of(spark, sent):
    files = spark.createDataFrame([("b", i, "f") for i in range(5)], "batch_id string, idx int, file string")
    return sorted(status.status_fold(spark.createDataFrame(sent, MESSAGES), files).drop("file").collect())


@pytest.mark.parametrize("fold_every", [2, 32])
def test_stream_status_goes_on_after_a_restart(spark, tmp_path, fold_every):
    name, out = f"status_{tmp_path.name}", str(tmp_path / "board")
    frames = [spark.createDataFrame(SENT[i : i + 1], MESSAGES) for i in range(6)]
    board.write_status(_dropped_in(spark, tmp_path / "in", frames), out, name, fold_every=fold_every).awaitTermination()
    for n, row in enumerate(SENT[6:]):
        spark.createDataFrame([row], MESSAGES).coalesce(1).write.parquet(str(tmp_path / f"in/later{n}"))
    source = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    board.write_status(source, out, name, fold_every=fold_every).awaitTermination()
    live = board.StatusBoard(spark, out)
    assert sorted(live.read().collect()) == _board_of(spark, SENT)
    assert len(live._numbers("change")) <= 9 and bool(live._numbers("fold")) == (fold_every == 2)


def test_a_repeated_or_unfinished_change_leaves_the_board_as_it_is(spark, tmp_path):
    live = board.StatusBoard(spark, str(tmp_path / "board"))
    assert live.read().collect() == []
    states = [status.status_state(spark.createDataFrame(SENT[: i + 3], MESSAGES)) for i in (0, 3, 6)]
    for n, state in enumerate(states):
        live.change(state, n, fold_every=2)
    before = sorted(live.read().collect())
    assert before == _board_of(spark, SENT)
    for n in (1, 0, 2, 1):
        live.change(states[n], n, fold_every=2)
        assert sorted(live.read().collect()) == before
    (tmp_path / "board/change=9").mkdir()
    (tmp_path / "board/change=9/part-0.parquet").write_bytes(b"cut off")
    assert sorted(live.read().collect()) == before


def test_changes_hold_only_files_with_messages(spark, tmp_path):
    out = str(tmp_path / "board")
    frames = [spark.createDataFrame(SENT[:5], MESSAGES), spark.createDataFrame([("b", 3, 99, "status")], MESSAGES)]
    board.write_status(_dropped_in(spark, tmp_path / "in", frames), out, f"status_{tmp_path.name}").awaitTermination()
    assert sorted(spark.read.parquet(f"{out}/change={n}").count() for n in (0, 1)) == [1, 3]


def test_status_updates_can_be_written_as_they_come(spark, tmp_path):
    frames = [spark.createDataFrame([("b", 0, n, k)], "batch_id string, idx int, seq long, type string") for n, k in enumerate(("status", "result"))]
    seen = []
    query = (
        jobs.stream_status(_dropped_in(spark, tmp_path / "in", frames)).writeStream.outputMode("update")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .foreachBatch(lambda df, _: seen.extend(r.status for r in df.select(F.col("status")).collect()))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert seen == ["Processing", "Done"]

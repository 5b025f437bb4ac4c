"""Registered queries over batches, their status, and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilwork import patterns
from veilwork.operators import batch, images, output, status
from veilwork.plans import inputs, packing
from veilwork.plans.batch_run import run_batch
from veilwork.plans.document_queries import _CAPPED, _GATE, AS_OF
from veilwork.plans.inputs import with_inputs
from veilwork.plans.process import redact_document
from veilwork.plans.redaction_queries import OPTS, _literal, sql_anonymize, sql_remove
from veilwork.session import checkpoint_dir, materialized
from veilwork.sources.tables import read_table, stream_table
from veilwork.streaming import board, jobs, once

QUERIES = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = (build, sql)
        return build

    return register


# --- admission -----------------------------------------------------------------------------------


@query(
    "file_listing",
    with_inputs(
        """SELECT batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY ord) AS no, filename, 'Unknown' AS file_type,
           round_even(size / CAST(1024 AS double), 2) AS size_kb FROM uploads""",
        "uploads",
    ),
)
def _(spark, folder):
    return batch.file_listing(inputs.uploads(spark, folder))


_LIMITS = (patterns.MAX_FILES, patterns.MAX_FILE_BYTES, patterns.MAX_BATCH_BYTES)
_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ord) <= 10 AS kept FROM uploads)"
_VERDICT = """verdict AS (SELECT batch_id, count(*) AS n_files, count(*) FILTER (WHERE kept) AS n_kept,
  count(*) FILTER (WHERE kept AND size > 20971520) AS n_oversized, CAST(sum(size) FILTER (WHERE kept) AS bigint) AS total_bytes,
  count(*) FILTER (WHERE kept AND size > 20971520) = 0 AND coalesce(sum(size) FILTER (WHERE kept) <= 104857600, true) AS ok
  FROM placed GROUP BY batch_id)"""


def _with_verdict(select: str) -> str:
    return with_inputs("", "uploads").strip() + f", {_PLACED}, {_VERDICT} {select}"


@query("limit_files", _with_verdict("SELECT batch_id, ord, filename, size FROM placed WHERE kept"))
def _(spark, folder):
    return batch.limit_files(inputs.uploads(spark, folder), patterns.MAX_FILES).select("batch_id", "ord", "filename", "size")


@query(
    "oversized_files",
    with_inputs(
        "SELECT batch_id, ord, filename, size, round_even(size / CAST(1048576 AS double), 2) AS size_mb FROM uploads WHERE size > 20971520",
        "uploads",
    ),
)
def _(spark, folder):
    return batch.oversized_files(inputs.uploads(spark, folder))


@query("batch_verdict", _with_verdict("SELECT * FROM verdict"))
def _(spark, folder):
    return batch.batch_verdict(inputs.uploads(spark, folder), *_LIMITS)


@query(
    "admit_documents",
    _with_verdict(
        """SELECT batch_id, ord, filename, size, reason IS NULL AS admitted, reason FROM (
             SELECT batch_id, ord, filename, size, CASE WHEN NOT kept THEN 'More than 10 files in the batch'
               WHEN NOT ok AND size > 20971520 THEN 'File is larger than the limit'
               WHEN NOT ok AND n_oversized > 0 THEN 'Another file of the batch is larger than the limit'
               WHEN NOT ok THEN 'Batch is larger than the limit' END AS reason FROM placed JOIN verdict USING (batch_id))"""
    ),
)
def _(spark, folder):
    return batch.admit_documents(inputs.uploads(spark, folder), *_LIMITS).select(
        "batch_id", "ord", "filename", "size", "admitted", "reason"
    )


# --- status --------------------------------------------------------------------------------------


@query("status_fold", with_inputs("SELECT batch_id, idx, file, status, progress FROM status", "status"))
def _(spark, folder):
    return status.status_fold(inputs.messages(spark, folder), inputs.files(spark, folder))


@query(
    "progress_counts",
    with_inputs(
        """SELECT batch_id, count(*) FILTER (WHERE status = 'Queued') AS queued, count(*) FILTER (WHERE status = 'Processing') AS processing,
           count(*) FILTER (WHERE status = 'Done') AS completed, count(*) FILTER (WHERE status = 'Error') AS errors,
           count(*) FILTER (WHERE status = 'Cancelled') AS cancelled, count(*) AS total,
           least(count(*) FILTER (WHERE status IN ('Done', 'Error', 'Cancelled')) / CAST(count(*) AS double), 1.0) AS ratio
           FROM status GROUP BY batch_id""",
        "status",
    ),
)
def _(spark, folder):
    return status.progress_counts(status.status_fold(inputs.messages(spark, folder), inputs.files(spark, folder)))


@query(
    "error_log",
    with_inputs(
        """SELECT batch_id, 'Error processing ' || original_name || ': ' || error AS message, min(seq) AS first_seq
           FROM messages WHERE type = 'error' GROUP BY ALL""",
        "messages",
    ),
)
def _(spark, folder):
    return status.error_log(inputs.messages(spark, folder))


@query(
    "cancel_summary",
    with_inputs(
        """SELECT batch_id, submitted, total, cancelled, submitted - cancelled AS processed, 'Processing cancelled by user. ' || (submitted - cancelled)
             || ' files were processed, ' || cancelled || ' files were cancelled.' AS message
           FROM messages WHERE type = 'cancelled' QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY seq) = 1""",
        "messages",
    ),
)
def _(spark, folder):
    return status.cancel_summary(inputs.messages(spark, folder))


# --- results -------------------------------------------------------------------------------------


@query("ordered_results", with_inputs("SELECT batch_id, ord, seq, name FROM results", "results"))
def _(spark, folder):
    return batch.ordered_results(inputs.results(spark, folder)).select("batch_id", "ord", "seq", "name")


@query("recent_results", with_inputs("SELECT batch_id, ord, seq, name FROM results WHERE status = 'Done'", "results"))
def _(spark, folder):
    return batch.recent_results(inputs.results(spark, folder)).select("batch_id", "ord", "seq", "name")


_OPS = """CASE WHEN op_a OR op_p OR op_j THEN concat_ws(', ', CASE WHEN op_a THEN 'Anonymize' END, CASE WHEN op_p THEN 'Remove PII' END,
  CASE WHEN op_j THEN 'Extract JSON' END) ELSE 'None' END"""


def _sql_summary(cache: str) -> str:
    return f"""SELECT batch_id, ord, original_name AS original_file, name AS processed_file, file_extension AS output_format,
      CASE WHEN size > 0 THEN CAST(round_even(size / CAST(1024 AS double), 2) AS varchar) ELSE 'N/A' END AS size_kb,
      {cache} {_OPS} AS operations FROM results"""


@query("processing_summary", with_inputs(_sql_summary("CASE WHEN cache_hit THEN 'Yes' ELSE 'No' END AS cache,"), "results"))
def _(spark, folder):
    return batch.processing_summary(inputs.results(spark, folder))


@query("processing_summary_partial", with_inputs(_sql_summary(""), "results"))
def _(spark, folder):
    return batch.processing_summary(inputs.results(spark, folder), partial=True)


@query(
    "ops_label",
    with_inputs(
        """SELECT seq, CASE WHEN op_a OR op_p OR op_j THEN concat_ws(' | ', CASE WHEN op_a THEN 'A' END, CASE WHEN op_p THEN 'P' END,
           CASE WHEN op_j THEN 'J' END) ELSE 'Raw' END AS ops_label FROM results""",
        "results",
    ),
)
def _(spark, folder):
    return batch.ops_label(inputs.results(spark, folder)).select("seq", "ops_label")


@query(
    "results_by_order",
    with_inputs(
        """SELECT s.batch_id, s.idx, s.file, s.status, s.progress, CASE WHEN s.status = 'Done' THEN r.name END AS name,
             CASE WHEN s.status = 'Done' THEN r.file_extension END AS file_extension, CASE WHEN s.status = 'Done' THEN r.size END AS size
           FROM status s LEFT JOIN (SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY batch_id, ord ORDER BY processed_time DESC, seq DESC) = 1) r
             ON s.batch_id = r.batch_id AND s.idx = r.ord""",
        "status", "results",
    ),
)
def _(spark, folder):
    board = status.status_fold(inputs.messages(spark, folder), inputs.files(spark, folder))
    return batch.results_by_order(board, inputs.results(spark, folder))


@query(
    "bundle_outputs",
    with_inputs(
        """SELECT batch_id, name, max(ord) AS ord, arg_max(size, ord) AS size, count(*) AS versions
           FROM (SELECT batch_id, name, seq AS ord, size FROM results) GROUP BY batch_id, name""",
        "results",
    ),
)
def _(spark, folder):
    rows = inputs.results(spark, folder, 1 << 16).select("batch_id", "name", F.col("seq").alias("ord"), "content")
    return output.bundle_outputs(rows, f"{checkpoint_dir(spark)}/outputs/bundle_{uuid.uuid4().hex}")


@query(
    "timing_rollup",
    with_inputs(
        """SELECT doc_id, step, 'Step ' || upper(step[6:6]) || step[7:] AS label, round_even(sum(seconds), 3) AS seconds
           FROM steps GROUP BY doc_id, step""",
        "steps",
    ),
)
def _(spark, folder):
    return batch.timing_rollup(inputs.steps(spark, folder))


@query(
    "processing_metadata",
    with_inputs(
        f"""SELECT doc_id, false AS throughput_mode, false AS cache_hit, 'regex_only' AS ner_mode, 'paddle' AS engine,
              CAST(coalesce(o.done, 0) AS integer) AS images_processed, CAST(coalesce(o.skipped, 0) AS integer) AS images_skipped,
              3 AS max_images_per_doc, true AS enabled, coalesce(t.n, 0) AS n_steps, round(coalesce(t.total, 0), 3) AS total_seconds
            FROM documents LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE extracted_text IS NULL) AS done,
                count(*) FILTER (WHERE extracted_text IS NOT NULL) AS skipped FROM ({_GATE}) GROUP BY doc_id) o USING (doc_id)
              LEFT JOIN (SELECT doc_id, CAST(count(DISTINCT step) AS integer) AS n, sum(seconds) AS total FROM steps GROUP BY doc_id) t USING (doc_id)""",
        "measured", "steps",
    ),
)
def _(spark, folder):
    gated = images.ocr_gate(
        inputs.measured_images(spark, folder).select("doc_id", "idx", "has_data", "likely"), _CAPPED
    )
    docs = read_table(spark, folder, "documents").select("doc_id")
    rows = batch.processing_metadata(docs, inputs.steps(spark, folder), images.ocr_counters(gated, _CAPPED), _CAPPED)
    m = F.col("metadata")
    seconds = F.aggregate(F.map_values(m["timing"]), F.lit(0.0), lambda a, x: a + x)
    return rows.select(
        "doc_id", m["throughput_mode"].alias("throughput_mode"), m["cache_hit"].alias("cache_hit"),
        m["ner_mode"].alias("ner_mode"), "metadata.ocr.*",
        F.size(m["timing"]).alias("n_steps"), F.round(seconds, 3).alias("total_seconds"),
    )


# --- a whole batch -------------------------------------------------------------------------------


_UPLOAD_NAME = "concat('doc_', doc_id, CASE WHEN doc_id % 23 = 7 THEN '.csv' ELSE (['.txt', '.docx', '.TXT', '.Docx'])[1 + doc_id % 4] END)"
_UPLOADS = f"""ups AS (SELECT source AS batch_id, doc_id AS ord, doc_id, {_UPLOAD_NAME} AS filename, text, doc_id % 2 = 1 AS office,
    doc_id % 23 <> 7 AND NOT (doc_id % 2 = 1 AND doc_id % 17 = 5) AS readable FROM documents)"""


def _uploaded(spark, folder):
    """Every document as an upload: text files, office files that hold its lines and a table, and some that cannot be read."""
    i = F.col("doc_id")
    ends = F.array(*[F.lit(e) for e in (".txt", ".docx", ".TXT", ".Docx")])
    name = F.concat(F.lit("doc_"), i, F.when(i % 23 == 7, ".csv").otherwise(F.get(ends, (i % 4).cast("int"))))
    office = (i % 2 == 1) & (i % 17 != 5) & (i % 23 != 7)
    rows = inputs.documents(spark, folder).select(F.col("source").alias("batch_id"), i.alias("ord"), "doc_id", name.alias("filename"), "text", office.alias("office"))
    packed = rows.mapInArrow(packing.pack_uploads, "batch_id string, ord long, doc_id long, filename string, content binary")
    return materialized(packed, "uploads")  # as uploads lie in storage


_REDACTED = lambda c: sql_remove(sql_anonymize(c))


@query(
    "batch_results",
    f"""WITH {_UPLOADS}, office_lines AS (SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM ups WHERE office)),
      cells AS (SELECT doc_id, pos, unnest(w) AS word, generate_subscripts(w, 1) AS n FROM (SELECT doc_id, pos, string_split(line, ' ') AS w FROM office_lines WHERE pos <= 3)),
      lined AS (SELECT doc_id, pos, string_agg({_REDACTED('word')}, ' | ' ORDER BY n) AS line FROM cells GROUP BY doc_id, pos),
      whole AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY part, pos) AS text FROM (
        SELECT doc_id, 0 AS part, pos, {_REDACTED('line')} AS line FROM office_lines UNION ALL SELECT doc_id, 1, pos, line FROM lined) GROUP BY doc_id)
      SELECT batch_id, ord, 'doc_' || doc_id || '_processed.pdf' AS name, filename AS original_name, '.pdf' AS file_extension,
        CASE WHEN office THEN whole.text ELSE {_REDACTED('ups.text')} END AS content,
        row_number() OVER (PARTITION BY office, ups.text ORDER BY doc_id) > 1 AS cache_hit, 'regex_only' AS ner_mode,
        CAST(CASE WHEN office THEN 1 ELSE 0 END AS integer) AS images_processed, CAST(CASE WHEN office THEN 1 ELSE 0 END AS integer) AS images_skipped
      FROM ups LEFT JOIN whole USING (doc_id) WHERE readable""",
)
def _(spark, folder):
    results = run_batch(_uploaded(spark, folder), OPTS, AS_OF).results
    m = F.col("metadata")
    return results.select(
        "batch_id", "ord", "name", "original_name", "file_extension", F.col("content").cast("string").alias("content"), "cache_hit",
        m["ner_mode"].alias("ner_mode"), m["ocr"]["images_processed"].alias("images_processed"), m["ocr"]["images_skipped"].alias("images_skipped"),
    )


@query(
    "batch_status",
    f"""WITH {_UPLOADS} SELECT batch_id, ord AS idx, filename AS file, CASE WHEN readable THEN 'Done' ELSE 'Error' END AS status,
        CASE WHEN readable THEN 100 ELSE 0 END AS progress FROM ups""",
)
def _(spark, folder):
    return run_batch(_uploaded(spark, folder), OPTS, AS_OF).status


# --- streams: drained over a given table into the shared folder, and read back -------------------


def _drained(spark, df, name: str):
    run = f"{name}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/outputs/{run}"
    jobs.write_stream(df, path, run).awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


@query("stream_redact", f"SELECT doc_id, {sql_remove(sql_anonymize('text'))} AS text FROM documents")
def _(spark, folder):
    docs = stream_table(spark, folder, "documents").select("doc_id", "text")
    return _drained(spark, jobs.stream_redact(docs, OPTS), "redact")


@query(
    "stream_process_once",
    f"""SELECT event_id, sha256(props || {_literal(OPTS.as_json())}) AS fp, {sql_remove(sql_anonymize('props'))} AS text,
        row_number() OVER (PARTITION BY props ORDER BY event_id) > 1 AS cache_hit FROM events""",
)
def _(spark, folder):
    rows = stream_table(spark, folder, "events").select("event_id", F.col("props").alias("text"))
    run = f"once_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/outputs/{run}"
    redact = lambda fresh: redact_document(fresh, OPTS)
    once.write_processed_once(rows, redact, OPTS, path, run, order="event_id").awaitTermination()
    return once.read_processed_once(spark, path)


@query(
    "stream_status",
    with_inputs(
        """SELECT m.batch_id, m.idx, s.status, s.progress FROM (SELECT DISTINCT batch_id, idx FROM messages WHERE idx IS NOT NULL) m
           JOIN status s USING (batch_id, idx)""",
        "status",
    ),
)
def _(spark, folder):
    messages = inputs.messages_from(stream_table(spark, folder, "events")).where("idx IS NOT NULL")
    run = f"status_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/outputs/{run}"
    board.write_status(messages, path, run).awaitTermination()
    return board.StatusBoard(spark, path).read()

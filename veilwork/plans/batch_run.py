"""A whole batch of uploaded files: admission, processing, results and the status board."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veilwork.operators import batch, dedup, output, spans, status
from veilwork.options import RedactOptions, validate_options
from veilwork.plans.process import docx_image_entries, read_docx, redact_document
from veilwork.sources.files import decode_text, route_format

# Page files come in as rows of page text; their bytes are not read here.
_NO_BYTES = "Page files are taken as rows of page text, not as bytes"
_EMPTY = "The upload has no content"
_TABLES = "array<struct<table_index:int,data:array<array<string>>,rows:int,cols:int,page:int,extraction_method:string>>"
_IMAGES = "array<struct<type:string,description:string,extracted_text:string,ocr_applied:boolean,image_format:string>>"


@dataclass(frozen=True)
class BatchRun:
    """``results`` has one row per processed file, ``messages`` and ``status`` one per uploaded file.

    ``counts`` is filled by the first action on ``results``: files seen, failed, copies, images to read and skipped.
    """

    results: DataFrame
    messages: DataFrame
    status: DataFrame
    counts: Observation


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _read_texts(unique: DataFrame, opts: RedactOptions, tagger: spans.Tagger | None) -> DataFrame:
    """Text files: decoded and redacted."""
    texts = redact_document(decode_text(unique).drop("content"), opts, tagger, id_col="fp")
    return texts.withColumns({"tables": _none(_TABLES), "images": _none(_IMAGES), "n_read": F.lit(0), "n_skipped": F.lit(0)})


def _read_office(unique: DataFrame, opts: RedactOptions, tagger: spans.Tagger | None) -> DataFrame:
    """Office files: opened once, redacted, images through the gate."""
    read = read_docx(unique, opts, [c for c in unique.columns if c != "content"], tagger, id_col="fp")
    gated = read.withColumn("images", docx_image_entries(F.col("images"), opts))
    eligible = F.size(F.filter("images", lambda i: i["eligible"]))
    counted = gated.withColumn("n_read", F.greatest(eligible, F.lit(0)))
    counted = counted.withColumn("n_skipped", F.greatest(F.size("images") - eligible, F.lit(0)))
    return counted.withColumn("images", output.image_entries(F.col("images")).cast(_IMAGES)).withColumn("tables", F.col("tables").cast(_TABLES))


def run_batch(
    uploads: DataFrame,
    opts: RedactOptions,
    as_of: datetime,
    tagger: spans.Tagger | None = None,
    max_files: int | None = None,
    max_file: int | None = None,
    max_batch: int | None = None,
) -> BatchRun:
    """Process (batch_id, ord, doc_id, filename, content) rows; ``doc_id`` is unique over all batches.

    Limits are off unless they are given; what is refused is an error with its reason on the board.
    A file that fails is an error of its own and the others go on. Text files are decoded, redacted and
    turned into records; office files are opened once. Content that was uploaded before, in
    whatever batch and under whatever name of its kind, is processed once; ``cache_hit`` marks its copies, and each
    result says how it was made in ``metadata``. What is written for a page-like output is its processed
    text: rendering is the caller's, from ``report_rows``.
    """
    validate_options(opts)
    sized = uploads.withColumn("file_size", F.octet_length("content").cast("int"))
    judged = batch.admit_documents(sized.withColumn("size", F.col("file_size").cast("long")), max_files, max_file, max_batch)
    columns = ("batch_id", "ord", "doc_id", "filename", "file_size", "content")
    admitted = judged.where("admitted").select(*columns)
    refused = judged.where("NOT admitted").select("batch_id", "ord", "filename", F.col("reason").alias("error"))
    kind = F.lower(F.substring_index("filename", ".", -1))

    readers = {"txt": _read_texts, "docx": _read_office}
    made = [
        dedup.process_once(admitted.where(kind == ext), lambda u, read=read: read(u, opts, tagger), opts, content="content")
        for ext, read in readers.items()
    ]
    other = F.when(kind == "pdf", F.lit(_NO_BYTES))
    rest = admitted.where(~F.coalesce(kind.isin(*readers), F.lit(False))).drop("content").withColumn("error", other)
    read = made[0].unionByName(made[1]).unionByName(rest, allowMissingColumns=True)
    unread = F.when(F.col("error").isNull() & F.col("text").isNull() & kind.isin(*readers), F.lit(_EMPTY))
    routed = route_format(read.withColumn("error", F.coalesce("error", unread)))
    finished = output.output_name(output.output_route(routed, opts), opts)

    ops = F.struct(
        F.lit(opts.anonymize).alias("anonymize"),
        F.lit(opts.remove_pii).alias("remove_pii"),
        F.lit(opts.extract_json).alias("extract_json"),
    )
    failed = F.col("error").isNotNull()
    counts = Observation(f"batch_{uuid.uuid4().hex}")
    counted = finished.observe(
        counts, F.count("*").alias("files"), F.count_if(failed).alias("failed"), F.count_if(F.col("cache_hit")).alias("copies"),
        F.coalesce(F.sum("n_read"), F.lit(0)).alias("images_processed"), F.coalesce(F.sum("n_skipped"), F.lit(0)).alias("images_skipped"),
    )
    done = counted.where(~failed)
    if opts.extract_json:
        done = output.with_record(done, opts, as_of, F.col("tables"), F.col("images"))
    metadata = batch.metadata_column(opts, tagger, _none("map<string,double>"), F.col("cache_hit"), F.col("n_read"), F.col("n_skipped"))
    results = done.select(
        "batch_id",
        "ord",
        F.col("output_name").alias("name"),
        F.col("filename").alias("original_name"),
        F.col("output_ext").alias("file_extension"),
        F.col("json" if opts.extract_json else "text").cast("binary").alias("content"),
        F.lit(as_of).cast("timestamp").alias("processed_time"),
        F.lit("Done").alias("status"),
        F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"),
        ops.alias("operations"),
        metadata.alias("metadata"),
    )
    ended = finished.select("batch_id", "ord", "filename", "error").unionByName(refused)
    messages = ended.select(
        "batch_id",
        F.col("ord").alias("idx"),
        F.lit(1).cast("long").alias("seq"),
        F.when(failed, "error").otherwise("result").alias("type"),
        F.col("filename").alias("original_name"),
        "error",
    )
    files = uploads.select("batch_id", F.col("ord").alias("idx"), F.col("filename").alias("file"))
    return BatchRun(results, messages, status.status_fold(messages, files), counts)

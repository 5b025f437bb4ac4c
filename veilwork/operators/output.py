"""Records and reports made from processed documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork import patterns
from veilwork.functions import text
from veilwork.functions.scale import number_rows
from veilwork.operators.images import IMAGE_BUCKET, drop_logo_images, fit_image_width, image_info, mentioned_images
from veilwork.options import RedactOptions

# Places of a batch that are written to one file.
BUNDLE_RUN = 10_000
BUNDLE_BYTES = 1 << 26
_TABLE_FIELDS = ("table_index", "data", "rows", "cols", "page", "extraction_method")
_TABLE_TYPE = (
    "array<struct<table_index:int,data:array<array<string>>,rows:int,cols:int,page:int,extraction_method:string>>"
)
_IMAGE_TYPE = (
    "array<struct<type:string,description:string,extracted_text:string,ocr_applied:boolean,image_format:string>>"
)


def table_arrays(tables: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, _tables): the tables of a document in order, as a record holds them."""
    fields = [(F.col(c) if c in tables.columns else F.lit(None)).alias(c) for c in _TABLE_FIELDS]
    return tables.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct(*fields))).cast(_TABLE_TYPE).alias("_tables"))


def image_arrays(images: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, _images): what a record says about each image, in order; payload bytes stay behind."""
    info = image_info(images, id_col, "idx")
    body = F.struct("type", "description", "extracted_text", "ocr_applied", "image_format").alias("body")
    ordered = F.sort_array(F.collect_list(F.struct("idx", body)))
    return info.groupBy(id_col).agg(F.transform(ordered, lambda s: s["body"]).cast(_IMAGE_TYPE).alias("_images"))


def _with_references(images: Column, doc_text: Column) -> Column:
    """Image entries, then the images the text names and no entry describes, without logos."""
    described = F.transform(images, lambda i: i["description"])
    fresh = F.array_except(mentioned_images(doc_text), described)
    refs = F.transform(
        fresh,
        lambda a: F.struct(
            F.lit("referenced_image").alias("type"),
            a.alias("description"),
            F.concat(F.lit("Referenced image: "), a).alias("extracted_text"),
            F.lit(False).alias("ocr_applied"),
            F.lit(None).cast("string").alias("image_format"),
        ),
    ).cast(_IMAGE_TYPE)
    return F.filter(F.concat(images, refs), lambda i: ~F.lower(i["extracted_text"]).isin(*patterns.LOGO_TEXTS))


def json_record(
    df: DataFrame,
    opts: RedactOptions,
    as_of: datetime,
    tables: DataFrame | Column | None = None,
    images: DataFrame | Column | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """(id, json): one record per document; NULL for a document without a text. See ``with_record``."""
    return with_record(df, opts, as_of, tables, images, id_col).select(id_col, "json")


def _with_children(docs: DataFrame, children: DataFrame | Column | None, arrays, name: str, id_col: str) -> DataFrame:
    if isinstance(children, DataFrame):
        return docs.join(arrays(children, id_col), id_col, "left")
    return docs.withColumn(name, F.lit(None) if children is None else children)


def with_record(
    df: DataFrame,
    opts: RedactOptions,
    as_of: datetime,
    tables: DataFrame | Column | None = None,
    images: DataFrame | Column | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """The documents with their record in ``json``.

    Needs (id, filename, file_type, text, file_size); ``file_size`` is that of the input. Fields a
    table or image does not have are left out of it. Children are arrays by the time they meet the
    text, so the text moves at most once per kind of child and not at all without children. Where each
    document has them in array columns already (``_TABLE_TYPE``, ``_IMAGE_TYPE``), nothing moves.
    """
    docs = _with_children(df, tables, table_arrays, "_tables", id_col)
    docs = _with_children(docs, images, image_arrays, "_images", id_col)
    filled = docs.withColumns(
        {
            "_tables": F.coalesce(F.col("_tables").cast(_TABLE_TYPE), F.array().cast(_TABLE_TYPE)),
            "_images": F.coalesce(F.col("_images").cast(_IMAGE_TYPE), F.array().cast(_IMAGE_TYPE)),
        }
    )
    record = F.struct(
        F.struct(
            F.col("filename"),
            F.col("file_type"),
            F.lit(as_of.isoformat()).alias("processing_date"),
            F.col("file_size"),
        ).alias("document_metadata"),
        F.struct(
            F.col("text"),
            F.col("_tables").alias("tables"),
            _with_references(F.col("_images"), F.col("text")).alias("images"),
        ).alias("content"),
        F.struct(
            F.lit(opts.anonymize).alias("anonymized"),
            F.lit(opts.remove_pii).alias("pii_removed"),
            F.lit(opts.extract_json).alias("extracted_to_json"),
        ).alias("processing_info"),
    )
    return filled.withColumn("json", F.when(F.col("text").isNotNull(), F.to_json(record))).drop("_tables", "_images")


def image_entries(images: Column) -> Column:
    """Image entries of one document as a record holds them; payload bytes stay behind."""
    fields = ("type", "description", "extracted_text", "ocr_applied", "image_format")
    return F.transform(images, lambda i: F.struct(*[i[f].alias(f) for f in fields]))


def write_json_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One record per line, in UTF-8 as it is."""
    records.where("json IS NOT NULL").select(F.col("json").alias("value")).write.mode(mode).text(path)


RECORD_TYPE = (
    "document_metadata struct<filename:string,file_type:string,processing_date:string,file_size:long>, "
    f"content struct<text:string,tables:{_TABLE_TYPE},images:{_IMAGE_TYPE}>, "
    "processing_info struct<anonymized:boolean,pii_removed:boolean,extracted_to_json:boolean>"
)


def parse_records(records: DataFrame, col: str = "json") -> DataFrame:
    """Add ``record``: the record as a struct of the declared type; nothing is inferred."""
    return records.withColumn("record", F.from_json(col, RECORD_TYPE))


def output_route(df: DataFrame, opts: RedactOptions) -> DataFrame:
    """Add ``output_ext``: what kind of file a document becomes; NULL for types that are refused."""
    redacted = opts.anonymize or opts.remove_pii
    kind = F.col("file_type")
    if opts.extract_json:
        ext = F.lit(".json")
    elif redacted:
        ext = F.lit(".pdf")
    else:
        ext = F.when(kind == ".docx", ".pdf").otherwise(kind)
    return df.withColumn("output_ext", F.when(kind.isin(*patterns.ACCEPTED_TYPES), ext))


def file_stem(name: Column) -> Column:
    """Last path part without its last extension; a leading or trailing dot makes no extension."""
    base = F.substring_index(F.regexp_replace(name, r"/+\z", ""), "/", -1)
    return F.regexp_replace(base, r"(?s)\A(.+)\.[^.]+\z", "$1")


def output_name(df: DataFrame, opts: RedactOptions, filename: str = "filename") -> DataFrame:
    name = F.col(filename)
    stem = F.coalesce(F.nullif(file_stem(name), F.lit("")), name)
    if opts.extract_json:
        out = F.concat(stem, F.lit(".json"))
    elif opts.anonymize or opts.remove_pii:
        out = F.concat(stem, F.lit("_processed.pdf"))
    else:
        out = name
    return df.withColumn("output_name", out)


def report_rows(df: DataFrame, as_of: datetime, id_col: str = "doc_id") -> DataFrame:
    """(id, seq, kind, text): title, time and the non-blank lines of a report, ready for markup."""

    def row(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), body.alias("text"))

    lines = F.filter(text.split_lines(F.col("text")), lambda p: ~text.is_blank(p))
    rows = F.concat(
        F.array(
            row("title", F.concat(F.lit("Processed Document: "), "filename")),
            row("time", F.lit(as_of.strftime("Processed on: %Y-%m-%d %H:%M:%S"))),
        ),
        F.transform(lines, lambda p: row("paragraph", text.html_escape(p))),
    )
    return df.select(id_col, F.posexplode(rows).alias("seq", "_r")).select(id_col, "seq", "_r.kind", "_r.text")


def report_table_preview(
    tables: DataFrame,
    id_col: str = "doc_id",
    max_rows: int | None = None,
    max_cols: int | None = None,
    max_chars: int | None = None,
) -> DataFrame:
    """(id, table_index, title, row_idx, cells): each table as a report shows it.

    The whole table, as wide as its first row; limits cut a corner of it where they are given.
    """
    width = F.size(F.get("data", F.lit(0)))
    width = width if max_cols is None else F.least(F.lit(max_cols), width)
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))

    def cell(row: Column, at: Column) -> Column:
        inside = F.coalesce(F.get(row, at), F.lit("None"))
        inside = inside if max_chars is None else F.left(inside, F.lit(max_chars))
        return F.when(at < F.size(row), inside).otherwise(F.lit(""))

    rows = F.col("data") if max_rows is None else F.slice("data", 1, max_rows)
    shown = F.transform(rows, lambda row: F.transform(places, lambda at: cell(row, at)))
    return tables.select(
        id_col,
        "table_index",
        F.concat(F.lit("Table "), F.col("table_index") + 1, F.lit(":")).alias("title"),
        F.posexplode(shown).alias("row_idx", "cells"),
    )


def report_images(images: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n, caption, fit_width, fit_height): images with bytes and no logo, numbered in order."""
    shown = drop_logo_images(images.where(F.octet_length("image_data") > 0), trim=True)
    slim = fit_image_width(shown).select(id_col, "idx", "description", "fit_width", "fit_height")
    numbered = number_rows(slim, [id_col], ["idx"], "_n", bucket=IMAGE_BUCKET)
    n = (F.col("_n") + 1).cast("int")
    described = F.coalesce("description", F.lit("")) != ""
    caption = F.when(described, F.concat(F.lit("Image "), n, F.lit(": "), F.col("description")))
    return numbered.select(id_col, n.alias("n"), caption.alias("caption"), "fit_width", "fit_height")


def bundle_manifest(results: DataFrame) -> DataFrame:
    """One entry per batch and name: place and size of the last output of that name, and how many there were."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    return (
        results.select("batch_id", "name", "ord", size.alias("_size"))
        .groupBy("batch_id", "name")
        .agg(F.max("ord").alias("ord"), F.max_by("_size", "ord").alias("size"), F.count("*").alias("versions"))
    )


def bundle_outputs(results: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Write every output below ``batch_id=...`` and return the manifest; no batch is gathered.

    Outputs of a batch are written by runs of at most ``BUNDLE_RUN`` places, so a batch has a file for each
    run and not for each task. Of a name all versions are kept, each with its ``ord``.

    A task sorts what it writes by batch. Contents are summed up first, and tasks and runs are cut to about
    ``BUNDLE_BYTES`` of them: adaptive execution would go by their packed size, which may be a hundredth of that.
    """
    columns = ("batch_id", "ord", "name", "content")
    n, total = results.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0))).first()
    places = max(1, min(BUNDLE_RUN, BUNDLE_BYTES * n // max(total, 1)))
    tasks = max(results.sparkSession.sparkContext.defaultParallelism, -(-total // BUNDLE_BYTES))
    run = F.floor(F.col("ord") / F.lit(places))
    results.select(*columns).repartition(tasks, "batch_id", run).write.mode(mode).partitionBy("batch_id").parquet(path)
    return bundle_manifest(results)

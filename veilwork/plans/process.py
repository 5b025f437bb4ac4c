"""Whole requests: from source rows to redacted documents and records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork import patterns
from veilwork.operators import fragments as frag
from veilwork.operators import output, pages, pii, spans, terms
from veilwork.operators.images import first_of_runs, ocr_apply, ocr_entries
from veilwork.operators.tables import has_table_column
from veilwork.options import RedactOptions, validate_options
from veilwork.sources import docx
from veilwork.sources.files import route_format


def redact_column(c: Column, opts: RedactOptions) -> Column:
    """Terms first, then patterns; for nested text where a tagger cannot go."""
    if opts.anonymize:
        c = terms.anonymize_column(c, opts.terms, opts.replacement)
    return pii.remove_pii_column(c) if opts.remove_pii else c


def redact_document(
    df: DataFrame, opts: RedactOptions, tagger: spans.Tagger | None = None, col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Anonymize, then remove personal data; each only if asked for."""
    if opts.anonymize:
        df = terms.anonymize(df, opts.terms, opts.replacement, col)
    if opts.remove_pii:
        df = spans.remove_pii(df, tagger, opts.throughput, id_col, col)
    return df


def redact_tables(tables: DataFrame, opts: RedactOptions) -> DataFrame:
    """Cells redacted where they are; used with ``scope="all"``."""
    return tables.withColumn("data", F.transform("data", lambda row: F.transform(row, lambda c: redact_column(c, opts))))


def redact_image_texts(images: DataFrame, opts: RedactOptions) -> DataFrame:
    return images.withColumn("extracted_text", redact_column(F.col("extracted_text"), opts))


@dataclass(frozen=True)
class Processed:
    """Rows of a request: documents with routes and names, and records if they were asked for."""

    documents: DataFrame
    records: DataFrame | None


def process_documents(
    docs: DataFrame,
    opts: RedactOptions,
    as_of: datetime,
    tables: DataFrame | None = None,
    images: DataFrame | None = None,
    tagger: spans.Tagger | None = None,
    recognised: DataFrame | None = None,
) -> Processed:
    """Text and page documents: route, redact, name, and turn into records.

    ``docs`` has (doc_id, filename, text). ``file_size`` defaults to the size of the text as it
    came in. Tables and images were read before redaction; ``scope="all"`` redacts their text too.
    Images that come with bytes, or with texts in ``recognised``, go through the gate, so throughput mode and the cap of
    images hold here too; images that come with their texts alone were read before and stay as they are.
    """
    if images is not None and (recognised is not None or "image_data" in images.columns):
        images = ocr_apply(images, opts, recognised)
    return _finished(docs, opts, as_of, tables, images, tagger)


def _finished(
    docs: DataFrame, opts: RedactOptions, as_of: datetime, tables: DataFrame | Column | None, images: DataFrame | Column | None,
    tagger: spans.Tagger | None, helpers: Sequence[str] = (),
) -> Processed:
    """``helpers`` are columns of ``docs`` that tables and images are made from and the documents go without."""
    validate_options(opts)
    routed = route_format(docs)
    if "file_size" not in routed.columns:
        routed = routed.withColumn("file_size", F.octet_length("text"))
    accepted = routed.withColumn("text", F.when(F.col("error").isNull(), F.col("text")))
    done = output.output_name(output.output_route(redact_document(accepted, opts, tagger), opts), opts)
    if not opts.extract_json:
        return Processed(done.drop(*helpers), None)
    if opts.scope == "all":
        tables = redact_tables(tables, opts) if isinstance(tables, DataFrame) else tables
        images = redact_image_texts(images, opts) if isinstance(images, DataFrame) else images
    # Only documents that were accepted; their texts are not looked at to tell.
    return Processed(done.drop(*helpers), output.json_record(done.where(F.col("error").isNull()), opts, as_of, tables, images))


def process_pages(
    docs: DataFrame,
    blocks: DataFrame,
    opts: RedactOptions,
    as_of: datetime,
    tables: DataFrame | None = None,
    images: DataFrame | None = None,
    plain: DataFrame | None = None,
    recognised: DataFrame | None = None,
    tagger: spans.Tagger | None = None,
) -> Processed:
    """Page documents from the rows their pages hold: clip, assemble, fall back, gate, number, redact, record.

    ``docs`` has (doc_id, filename), ``blocks`` the text blocks of pages (see ``clip_margins``) with
    ``page`` and ``pos``. A document without blocks could not be read in full: it takes its text from
    ``plain`` (doc_id, text, error) and has no tables and images then. Of ``tables`` (doc_id, page, pos,
    data) those on pages with a sign of a table are numbered, in throughput mode none. Of ``images``
    (doc_id, page, xref, img_idx, idx, image_data, ...) the first of each page and xref goes through the
    gate; ``recognised`` holds the texts read from them. ``pdf_engine`` tells which read was used.
    """
    validate_options(opts)
    kept = opts.extract_json
    read = read_pages(
        docs, blocks, opts.header_ratio, tables if kept and not opts.throughput else None, images if kept else None, plain,
        recognised if kept and images is not None else None,
    )
    found, shown = F.col("_tables_found") if kept and tables is not None and not opts.throughput else None, None
    if found is not None and opts.scope == "all":
        found = F.transform(found, lambda t: t.withField("data", F.transform(t["data"], lambda row: F.transform(row, lambda c: redact_column(c, opts)))))
    if images is not None:
        gated = ocr_entries(F.col("_images_found"), opts, F.col("_recognised"), lambda i: i["has_data"], lambda i: i["likely"])
        shown = output.image_entries(_redacted_images(gated, opts))
    return _finished(read, opts, as_of, found, shown, tagger, PAGE_HELPERS)


PAGE_HELPERS = ("_tables_found", "_images_found", "_recognised")
_IMAGE_FACTS = {"type": "unknown", "description": "", "image_format": "unknown"}


def read_pages(
    docs: DataFrame,
    blocks: DataFrame,
    ratio: float,
    tables: DataFrame | None = None,
    images: DataFrame | None = None,
    plain: DataFrame | None = None,
    recognised: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with text, pdf_engine, error and ``PAGE_HELPERS``, all rows of a document gathered at once.

    The inputs are one union, dealt by document in one exchange: each is read once, each row moves once. In it
    blocks become the texts of pages, tables of pages with a sign of a table and the first image of each page and xref
    are kept, and pages become the document. What meets in one task is what the document's record holds. Rows of
    other documents, and rows without an id, tables without a page and recognised texts without a place, are left
    out; of several plain or recognised texts of one place the smallest counts. Documents without an id have no text.
    """
    own = docs.drop("text", "error", "pdf_engine", *PAGE_HELPERS)
    known = F.col("doc_id").isNotNull()
    no_page = F.lit(None).cast(blocks.schema["page"].dataType).alias("page")
    # Documents without an id are groups of their own.
    rows = [
        blocks.where(known).select("doc_id", "page", F.lit(True).alias("_is_block"), pages.page_block(ratio).alias("_block")),
        own.select("doc_id", no_page, F.when(~known, F.xxhash64(*own.columns)).alias("_alone"), F.struct(*own.columns).alias("_doc")),
    ]
    if tables is not None:
        filled = tables.where(known & F.col("page").isNotNull() & (F.size("data") > 0))
        rows.append(filled.select("doc_id", "page", F.struct("pos", "data").alias("_table")))
    if images is not None:
        facts = {c: F.coalesce(c, F.lit(v)) if c in images.columns else F.lit(v) for c, v in _IMAGE_FACTS.items()}
        has_data = F.coalesce(F.octet_length("image_data"), F.lit(0)) > 0 if "image_data" in images.columns else F.lit(True)
        likely = F.coalesce("likely", F.lit(True)) if "likely" in images.columns else F.lit(True)
        entry = F.struct("idx", *[v.alias(c) for c, v in facts.items()], has_data.alias("has_data"), likely.alias("likely"))
        at = F.struct("page", "xref", "img_idx", entry.alias("entry")).alias("_image")
        rows.append(images.where(known).select("doc_id", no_page, at))
    if plain is not None:
        rows.append(plain.where(known).select("doc_id", no_page, F.struct("text", "error").alias("_plain")))
    if recognised is not None:
        texts = recognised.where(known & F.col("idx").isNotNull())
        rows.append(texts.select("doc_id", no_page, F.struct("idx", "extracted_text").alias("_read")))
    together = rows[0]
    for more in rows[1:]:
        together = together.unionByName(more, allowMissingColumns=True)

    listed = [c for c in ("_doc", "_image", "_plain", "_read") if c in together.columns]
    found = F.sort_array(F.collect_list("_table")) if tables is not None else F.lit(None)
    by_page = together.repartition("doc_id", "_alone").groupBy("doc_id", "_alone", "page").agg(
        F.coalesce(F.bool_or("_is_block"), F.lit(False)).alias("_has_blocks"),
        pages.joined_blocks("_block").alias("_text"),
        found.alias("_tables"),
        *[F.collect_list(c).alias(c) for c in listed],
    )
    signed = by_page
    if tables is not None:
        signed = by_page.withColumn("_tables", F.when(has_table_column(F.col("_text")), F.struct("page", "_tables")))
    by_doc = signed.groupBy("doc_id", "_alone").agg(
        F.bool_or("_has_blocks").alias("_has_blocks"),
        pages.joined_pages("_text").alias("_text"),
        (F.sort_array(F.collect_list("_tables")) if tables is not None else F.lit(None)).alias("_tables"),
        *[F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in listed if c != "_doc"],
        F.flatten(F.collect_list("_doc")).alias("_doc"),
    )

    worked, second = F.col("_has_blocks"), F.get("_plain", F.lit(0)) if plain is not None else None
    spare = F.when(second["error"].isNull(), second["text"]) if second is not None else F.lit(None).cast("string")
    why = second["error"] if second is not None else F.lit(None).cast("string")
    full, text_only = patterns.PDF_ENGINES
    made = by_doc.select(
        F.explode("_doc").alias("_doc"),
        F.when(worked, F.col("_text")).otherwise(spare).alias("text"),
        F.when(worked, full).when(spare.isNotNull(), text_only).alias("pdf_engine"),
        F.when(~worked & spare.isNull(), F.concat(F.lit("Unable to read PDF: "), F.coalesce(why, F.lit("no text")))).alias("error"),
        (_numbered(F.when(worked, F.col("_tables"))) if tables is not None else F.lit(None)).alias("_tables_found"),
        *_images_of(worked, images is not None, recognised is not None),
    )
    return made.select(*[F.col("_doc")[c].alias(c) for c in own.columns], "text", "pdf_engine", "error", *PAGE_HELPERS)


def _numbered(by_page: Column) -> Column:
    """Tables of one document from (page, tables) in order, numbered from 0; the page goes out 1-based."""

    def entry(table: Column, at: Column) -> Column:
        data = table["data"]
        fields = {
            "table_index": at, "data": data, "rows": F.size(data), "cols": F.size(F.get(data, F.lit(0))), "page": (table["page"] + 1).cast("int"),
            "extraction_method": F.lit(None).cast("string"),
        }
        return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])

    pairs = F.flatten(F.transform(by_page, lambda p: F.transform(p["_tables"], lambda t: F.named_struct(F.lit("page"), p["page"], F.lit("data"), t["data"]))))
    return F.transform(pairs, entry)


def _images_of(worked: Column, images: bool, recognised: bool) -> list[Column]:
    """The first image of each page and xref, by place, and the texts read from images."""
    entries = F.lit(None)
    if images:
        firsts = first_of_runs(F.col("_image"), lambda i: F.struct(i["page"], i["xref"]))
        entries = F.when(worked, F.sort_array(F.transform(firsts, lambda i: i["entry"])))
    read = F.lit(None).cast("map<int,string>")
    if recognised:
        read = F.map_from_entries(first_of_runs(F.col("_read"), lambda r: r["idx"]))
    return [entries.alias("_images_found"), read.alias("_recognised")]


def _redacted_images(images: Column, opts: RedactOptions) -> Column:
    if opts.scope != "all":
        return images
    return F.transform(images, lambda i: i.withField("extracted_text", redact_column(i["extracted_text"], opts)))


def redact_structures(structures: DataFrame, opts: RedactOptions) -> DataFrame:
    """Office text pieces redacted in place, each run of text on its own."""
    return structures.withColumn(
        "pieces", F.transform("pieces", lambda cell: F.transform(cell, lambda p: redact_column(p, opts)))
    )


def tag_structures(structures: DataFrame, tagger: spans.Tagger) -> DataFrame:
    """Office text pieces with the spans of a tagger redacted, each piece on its own.

    Pieces become rows for the tagger and go back into their paragraph or table row, which is the
    largest group there is.
    """
    keys = ("doc_id", "kind", "idx", "row_idx", "n_cols")
    cells = structures.where("kind <> 'error'").select(*keys, F.posexplode_outer("pieces").alias("cell", "_p"))
    rows = cells.select(*keys, "cell", F.posexplode_outer("_p").alias("seq", "text"))
    tagged = spans.remove_pii(rows, tagger, id_col=("doc_id", "kind", "idx", "row_idx", "cell", "seq"))
    listed = tagged.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("cell", "seq", "text"))).alias("_all"), F.max("cell").alias("_last")
    )

    def cell(at: Column) -> Column:
        mine = F.filter("_all", lambda x: (x["cell"] == at) & x["text"].isNotNull())
        return F.transform(mine, lambda x: x["text"])

    rebuilt = listed.withColumn("pieces", F.transform(F.sequence(F.lit(0), "_last"), cell)).drop("_all", "_last")
    return rebuilt.unionByName(structures.where("kind = 'error'"), allowMissingColumns=True)


READ_COLUMNS = ("error", "text", "tables", "images")


def read_docx(files: DataFrame, opts: RedactOptions, keep: Sequence[str], tagger: spans.Tagger | None = None, id_col: str = "doc_id") -> DataFrame:
    """Office files as redacted text, tables and images in one row each: the columns to keep, and ``READ_COLUMNS``.

    Pieces are redacted and put together in the task that opened the file; nothing is shuffled. Only a tagger that works
    on rows of text needs the pieces as rows, and reads the files again for the images.
    """
    if opts.remove_pii and tagger is not None and not opts.throughput:
        return _read_docx_tagged(files, opts, keep, tagger, id_col)
    parts = docx.docx_parts(files, ("body", "images"), keep, payload=False)

    def change(piece: Column) -> Column:
        return redact_column(piece, opts)

    paragraphs = F.transform("paragraphs", lambda p: F.transform(p, change))
    changed = parts.select(*keep, "error", paragraphs.alias("paragraphs"), docx.map_pieces(F.col("tables"), change).alias("tables"), "images")
    read = F.col("error").isNull()
    return changed.select(
        *keep,
        "error",
        F.when(read, docx.body_text(F.col("paragraphs"), F.col("tables"))).alias("text"),
        F.when(read, docx.table_entries(F.col("tables"))).alias("tables"),
        docx.with_format(F.col("images")).alias("images"),
    )


def _read_docx_tagged(files: DataFrame, opts: RedactOptions, keep: Sequence[str], tagger: spans.Tagger, id_col: str) -> DataFrame:
    keyed = files.withColumn("doc_id", F.col(id_col))
    pieces = tag_structures(redact_structures(docx.docx_structures(keyed), opts), tagger)
    structures = docx.structure_text(pieces)
    tables = output.table_arrays(pages.docx_tables(structures)).withColumnRenamed("_tables", "tables")
    texts = pages.assemble_docx_text(structures).join(tables, "doc_id", "left").withColumnRenamed("doc_id", "_id")
    images = docx.docx_parts(files, ("images",), keep, payload=False).withColumn("images", docx.with_format(F.col("images")))
    read = images.join(texts, F.col(id_col) == F.col("_id"), "left")
    # A readable file with an empty body has no structure rows; its text is ''.
    text = F.when(F.col("error").isNull(), F.coalesce("text", F.lit("")))
    return read.select(*keep, "error", text.alias("text"), "tables", "images")


def process_docx(
    files: DataFrame,
    opts: RedactOptions,
    as_of: datetime,
    tagger: spans.Tagger | None = None,
    recognised: DataFrame | None = None,
) -> Processed:
    """Office documents: pieces are redacted in the task that read them, then assembled.

    ``files`` has (doc_id, filename, content); ``recognised`` the texts read from images, if any.
    Tables are taken after redaction. A file that cannot be read keeps its error and has no text.
    """
    validate_options(opts)
    named = files.drop(*READ_COLUMNS).withColumn("file_size", F.octet_length("content"))
    read = read_docx(named, opts, [c for c in named.columns if c != "content"], tagger)
    done = output.output_name(output.output_route(route_format(read), opts), opts)
    documents = done.drop("tables", "images")
    if not opts.extract_json:
        return Processed(documents, None)
    texts = None
    if recognised is not None:
        entries = F.map_from_entries(F.collect_list(F.struct("idx", "extracted_text")))
        done, texts = done.join(recognised.groupBy("doc_id").agg(entries.alias("_read")), "doc_id", "left"), F.col("_read")
    shown = docx_image_entries(F.col("images"), opts, texts)
    return Processed(documents, output.json_record(done.where(F.col("error").isNull()), opts, as_of, F.col("tables"), output.image_entries(shown)))


def docx_image_entries(images: Column, opts: RedactOptions, texts: Column | None = None) -> Column:
    """Images of one file after the gate, their texts redacted where the request is for all."""
    return _redacted_images(ocr_entries(images, opts, texts), opts)


def redact_docx_fragments(files: DataFrame, opts: RedactOptions, tagger: spans.Tagger | None = None) -> DataFrame:
    """(doc_id, part, seq, text, new_text, changed, error) for every text run of office files."""
    rows = docx.docx_fragments(files)
    redacted = rows.withColumn("_original", F.col("text"))
    for op, wanted in (("anonymize", opts.anonymize), ("remove_pii", opts.remove_pii)):
        if wanted:
            step = frag.redact_fragments(redacted, op, opts, tagger)
            redacted = step.drop("text", "changed").withColumnRenamed("new_text", "text")
    return redacted.withColumnsRenamed({"text": "new_text", "_original": "text"}).withColumn(
        "changed", ~F.col("new_text").eqNullSafe(F.col("text"))
    )

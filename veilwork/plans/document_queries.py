"""Registered queries over pages, tables, images and the records and reports made of them."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from veilwork import patterns
from veilwork.operators import images, output, pages, tables
from veilwork.options import RedactOptions
from veilwork.plans import inputs
from veilwork.plans.inputs import with_inputs
from veilwork.plans.process import process_documents, process_pages
from veilwork.session import checkpoint_dir
from veilwork.plans.redaction_queries import OPTS, REPLACEMENT, STRIP, TERMS, sql_anonymize, sql_remove

AS_OF = datetime(2024, 5, 6, 7, 8, 9)
JSON_OPTS = RedactOptions(anonymize=True, remove_pii=True, extract_json=True, terms=TERMS, replacement=REPLACEMENT)

QUERIES = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = (build, sql)
        return build

    return register


# --- pages ---------------------------------------------------------------------------------------


@query(
    "clip_margins",
    with_inputs(
        """SELECT doc_id, CAST(pos AS integer) AS pos, page FROM blocks WHERE page_height <= 0
           OR (y1 > page_y0 + page_height * CAST(0.08 AS double) AND y0 < page_y0 + page_height * CAST(0.92 AS double))""",
        "doc_lines", "blocks",
    ),
)
def _(spark, folder):
    return pages.clip_margins(inputs.blocks(spark, folder)).select("doc_id", "pos", "page")


def _single_line_pages(spark, folder):
    line = F.when(F.col("pos") % 5 == 4, "").otherwise(F.col("line"))
    return inputs.lines(spark, folder).select("doc_id", F.col("pos").alias("page"), line.alias("text"))


@query(
    "assemble_pages",
    with_inputs(
        """SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE line <> '' AND pos % 5 <> 4), '') AS text
           FROM doc_lines GROUP BY doc_id""",
        "doc_lines",
    ),
)
def _(spark, folder):
    return pages.assemble_pages(_single_line_pages(spark, folder))


@query(
    "read_with_fallback",
    """SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN text WHEN doc_id % 6 <> 0 THEN 'plain ' || text END AS text,
         CASE WHEN doc_id % 3 <> 0 THEN 'pymupdf_single_pass' WHEN doc_id % 6 <> 0 THEN 'pymupdf_text_only' END AS pdf_engine,
         CASE WHEN doc_id % 6 = 0 THEN 'Unable to read PDF: ' || CASE WHEN doc_id % 12 = 0 THEN 'broken' ELSE 'unreadable' END END AS error
       FROM documents""",
)
def _(spark, folder):
    """Some documents have no first read, some no second one."""
    docs = inputs.documents(spark, folder)
    i = F.col("doc_id")
    full = docs.where((i % 9 != 3) | (i % 12 == 0)).select("doc_id", "text", F.when(i % 3 == 0, F.lit("broken")).alias("error"))
    plain = docs.where(i % 12 != 0).select(
        "doc_id", F.concat(F.lit("plain "), "text").alias("text"), F.when(i % 6 == 0, F.lit("unreadable")).alias("error")
    )
    return pages.read_with_fallback(full, plain)


@query(
    "assemble_docx_text",
    with_inputs(
        """SELECT doc_id, string_agg(CASE WHEN pos % 3 = 2 THEN replace(line, ' ', ' | ') ELSE line END, chr(10)
             ORDER BY pos % 3 = 2, pos) AS text FROM doc_lines GROUP BY doc_id""",
        "doc_lines",
    ),
)
def _(spark, folder):
    table = F.col("pos") % 3 == 2
    rows = inputs.lines(spark, folder).select(
        "doc_id",
        F.when(table, "table").otherwise("paragraph").alias("kind"),
        F.floor(F.col("pos") / 9).cast("int").alias("idx"),
        F.col("pos").alias("row_idx"),
        F.when(~table, F.col("line")).alias("text"),
        F.when(table, F.split("line", " ", -1)).alias("cells"),
    )
    return pages.assemble_docx_text(rows)


@query(
    "nonblank_paragraphs",
    """SELECT doc_id, CAST(len(p) AS integer) AS n, array_to_string(p, '#') AS joined FROM (SELECT doc_id, list_filter(
         string_split(replace(text, chr(10), chr(10) || ' ' || chr(9) || chr(10)), chr(10)), lambda x: trim(x, """
    + STRIP
    + ") <> '') AS p FROM documents)",
)
def _(spark, folder):
    blank = F.replace("text", F.lit("\n"), F.lit("\n \t\n"))
    rows = pages.nonblank_paragraphs(inputs.documents(spark, folder).withColumn("text", blank))
    return rows.select("doc_id", F.size("paragraphs").alias("n"), F.array_join("paragraphs", "#").alias("joined"))


# --- tables --------------------------------------------------------------------------------------

_SIGNS = ("| a | b |", "+-----+", "see Tab. 3", "x    one    two", "a\tb\tc", "1,000  20\n3 4\n5 6", "x|y|z\n|||\na||b", "Stable tablet")


def _sign_documents(spark, folder):
    """Documents with one of several signs of a table put before and after the text."""
    sign = F.get(F.array(*map(F.lit, _SIGNS)), (F.col("doc_id") % 8).cast("int"))
    whole = F.concat(sign, F.lit("\n"), F.col("text"), F.lit("\n"), sign)
    return inputs.documents(spark, folder).select("doc_id", whole.alias("text"))


_SIGN_LIST = ", ".join("'" + s.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for s in _SIGNS)
_SIGN_DOCS = f"""sign_docs AS (SELECT doc_id, sign || chr(10) || text || chr(10) || sign AS text
  FROM (SELECT doc_id, text, ([{_SIGN_LIST}])[1 + doc_id % 8] AS sign FROM documents))"""
_W = r"\p{L}\p{N}_"


def _sql_signs(c: str) -> dict[str, str]:
    return {
        "p1": rf"regexp_matches({c}, '\|\s*[{_W}\s]+\s*\|')",
        "p2": rf"regexp_matches({c}, '\+[-]+\+')",
        "p3": rf"regexp_matches({c}, '[{_W}\s]+\s+\|\s+[{_W}\s]+')",
        "p4": rf"regexp_matches({c}, '(?i)(^|[^{_W}])(table|tab|tbl)([^{_W}]|$)|(^|[^{_W}])tab\.[{_W}]')",
        "p5": rf"regexp_matches({c}, '\s{{4,}}[{_W}\s]+\s{{4,}}[{_W}\s]+')",
        "p6": rf"regexp_matches({c}, '\t+[{_W}\s]+\t+[{_W}\s]+')",
    }


def _sql_votes(c: str) -> str:
    return rf"""CAST(len(list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x, {STRIP})),
      lambda l: l <> '' AND (length(l) - length(replace(l, '|', '')) >= 2 OR len(string_split_regex(l, '\s{{3,}}')) >= 3
        OR regexp_matches(l, '\d+[,\d]*\s+\d+[,\d]*')))) AS integer)"""


@query(
    "table_indicators",
    f"WITH {_SIGN_DOCS} SELECT doc_id, " + ", ".join(f"{e} AS {n}" for n, e in _sql_signs("text").items()) + " FROM sign_docs",
)
def _(spark, folder):
    return tables.table_indicators(_sign_documents(spark, folder)).drop("text")


@query("table_line_votes", f"WITH {_SIGN_DOCS} SELECT doc_id, {_sql_votes('text')} AS votes FROM sign_docs")
def _(spark, folder):
    return tables.table_line_votes(_sign_documents(spark, folder)).drop("text")


def _sql_gate(c: str) -> str:
    return "(" + " OR ".join(_sql_signs(c).values()) + f" OR {_sql_votes(c)} >= 3)"


@query("has_table_indicators", f"SELECT doc_id, {_sql_gate('text')} AS has_table FROM documents")
def _(spark, folder):
    return tables.has_table_indicators(inputs.documents(spark, folder)).select("doc_id", "has_table")


@query(
    "gate_table_pages",
    with_inputs(f"SELECT doc_id, page FROM page_texts WHERE {_sql_gate('text')}", "page_texts"),
)
def _(spark, folder):
    return tables.gate_table_pages(inputs.page_texts(spark, folder)).select("doc_id", "page")


@query(
    "number_tables",
    with_inputs("SELECT doc_id, table_index, page, rows, cols FROM tables", "tables"),
)
def _(spark, folder):
    return tables.number_tables(inputs.raw_tables(spark, folder)).drop("data")


# --- images --------------------------------------------------------------------------------------


@query(
    "dedupe_page_images",
    with_inputs(
        "SELECT doc_id, page, xref, img_idx FROM images QUALIFY row_number() OVER (PARTITION BY doc_id, page, xref ORDER BY img_idx) = 1",
        "images",
    ),
)
def _(spark, folder):
    rows = inputs.images(spark, folder).select("doc_id", "page", "xref", "img_idx")
    return images.dedupe_page_images(rows)


@query(
    "image_format",
    with_inputs(
        """SELECT doc_id, idx, CASE WHEN NOT has_data THEN 'unknown' ELSE
           (['PNG', 'JPEG', 'GIF', 'BMP', 'TIFF', 'WEBP', 'unknown'])[1 + (doc_id * 20 + idx) % 7] END AS image_format FROM images""",
        "images",
    ),
)
def _(spark, folder):
    return images.image_format(inputs.images(spark, folder)).select("doc_id", "idx", "image_format")


@query("image_text_likelihood", with_inputs("SELECT doc_id, idx, likely FROM measured", "measured"))
def _(spark, folder):
    return inputs.measured_images(spark, folder).select("doc_id", "idx", "likely")


_GATE = """SELECT doc_id, idx, CASE WHEN earlier >= 3 THEN '[OCR skipped: max images reached]'
    WHEN NOT has_data THEN '[OCR skipped: no image data]' WHEN NOT likely THEN '[OCR skipped: low-text likelihood]' END AS extracted_text
  FROM (SELECT *, coalesce(sum(CAST(has_data AND likely AS integer)) OVER (PARTITION BY doc_id ORDER BY idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM measured)"""
_CAPPED = RedactOptions(max_images=3)


@query("ocr_gate", with_inputs(f"SELECT *, extracted_text IS NULL AS eligible FROM ({_GATE})", "measured"))
def _(spark, folder):
    rows = inputs.measured_images(spark, folder).select("doc_id", "idx", "has_data", "likely")
    return images.ocr_gate(rows, _CAPPED).select("doc_id", "idx", "eligible", "extracted_text")


@query(
    "ocr_mode_reason",
    with_inputs(
        """SELECT doc_id, idx, '[OCR disabled in throughput mode]' AS throughput, '[OCR disabled]' AS disabled,
           '[OCR not available]' AS missing, CAST(NULL AS varchar) AS active FROM images""",
        "images",
    ),
)
def _(spark, folder):
    return inputs.images(spark, folder).select(
        "doc_id",
        "idx",
        images.ocr_mode_reason(RedactOptions(throughput=True)).alias("throughput"),
        images.ocr_mode_reason(RedactOptions(ocr_enabled=False)).alias("disabled"),
        images.ocr_mode_reason(RedactOptions(ocr_available=False)).alias("missing"),
        images.ocr_mode_reason(RedactOptions()).alias("active"),
    )


@query(
    "ocr_join_text",
    with_inputs(
        r"""SELECT doc_id, idx, CASE WHEN failed THEN '[OCR failed: timeout]' WHEN joined = '' THEN '[No text detected in image]'
            ELSE joined END AS extracted_text FROM (
            SELECT doc_id, CAST(pos // 3 AS integer) AS idx, bool_or(pos % 17 = 16) AS failed,
              trim(regexp_replace(string_agg(CASE WHEN pos // 3 % 4 = 3 THEN '  ' ELSE '  ' || line || chr(9) END, ' ' ORDER BY pos), '\s+', ' ', 'g')) AS joined
            FROM doc_lines GROUP BY doc_id, pos // 3)""",
        "doc_lines",
    ),
)
def _(spark, folder):
    idx = F.floor(F.col("pos") / 3).cast("int")
    line = F.when(idx % 4 == 3, "  ").otherwise(F.concat(F.lit("  "), "line", F.lit("\t")))
    rows = inputs.lines(spark, folder).select(
        "doc_id", idx.alias("idx"), "pos", line.alias("line"), F.when(F.col("pos") % 17 == 16, "timeout").alias("error")
    )
    return images.ocr_join_text(rows)


@query(
    "ocr_counters",
    with_inputs(
        f"""SELECT doc_id, count(*) FILTER (WHERE extracted_text IS NULL) AS images_processed,
            count(*) FILTER (WHERE extracted_text IS NOT NULL) AS images_skipped, 3 AS max_images_per_doc, true AS enabled
            FROM ({_GATE}) GROUP BY doc_id""",
        "measured",
    ),
)
def _(spark, folder):
    rows = inputs.measured_images(spark, folder).select("doc_id", "idx", "has_data", "likely")
    return images.ocr_counters(images.ocr_gate(rows, _CAPPED), _CAPPED)


_INFO = """coalesce(type, 'unknown') AS type, coalesce(description, '') AS description,
  coalesce(extracted_text, '') AS extracted_text, coalesce(ocr_applied, false) AS ocr_applied, 'unknown' AS image_format"""


@query("image_info", with_inputs(f"SELECT doc_id, idx, {_INFO} FROM images", "images"))
def _(spark, folder):
    return images.image_info(inputs.images(spark, folder))


@query(
    "thumbnail_eligible",
    with_inputs("SELECT doc_id, idx, coalesce(n_bytes < 10000, false) AS thumbnail_eligible FROM images", "images"),
)
def _(spark, folder):
    return images.thumbnail_eligible(inputs.images(spark, folder), patterns.THUMBNAIL_LIMIT_BYTES).select("doc_id", "idx", "thumbnail_eligible")


_REFS = r"""refs AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS integer) AS pos, description
  FROM (SELECT doc_id, place, description FROM (SELECT doc_id, generate_subscripts(a, 1) AS place,
      coalesce(nullif(unnest(a), ''), unnest(b)) AS description FROM (SELECT doc_id,
        regexp_extract_all(text, '\[Image:\s*(.*?)\]|!\[(.*?)\]', 1) AS a, regexp_extract_all(text, '\[Image:\s*(.*?)\]|!\[(.*?)\]', 2) AS b FROM pii_docs))
    WHERE coalesce(description, '') <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, description ORDER BY place) = 1))"""


@query(
    "referenced_images",
    with_inputs("", "pii_docs", "images").strip()
    + f""", {_REFS} SELECT doc_id, pos, 'referenced_image' AS type, description, 'Referenced image: ' || description AS extracted_text, false AS ocr_applied
      FROM refs r WHERE NOT EXISTS (SELECT 1 FROM images i WHERE i.doc_id = r.doc_id AND coalesce(i.description, '') = r.description)""",
)
def _(spark, folder):
    return images.referenced_images(inputs.pii_documents(spark, folder), inputs.images(spark, folder))


@query(
    "drop_logo_images",
    with_inputs(
        """SELECT doc_id, idx, false AS trimmed FROM images WHERE lower(coalesce(extracted_text, '')) NOT IN ('stc', 'sic')
           UNION ALL SELECT doc_id, idx, true FROM images WHERE lower(trim(coalesce(extracted_text, ''))) NOT IN ('stc', 'sic')""",
        "images",
    ),
)
def _(spark, folder):
    rows = inputs.images(spark, folder).select("doc_id", "idx", "extracted_text")
    both = [images.drop_logo_images(rows, trim).select("doc_id", "idx", F.lit(trim).alias("trimmed")) for trim in (False, True)]
    return both[0].unionByName(both[1])


_FIT = """CAST(CASE WHEN width IS NULL OR width > 400 THEN 400 ELSE width END AS integer) AS fit_width,
  CAST(CASE WHEN width IS NULL THEN 300 WHEN width > 400 THEN trunc(height * (CAST(400 AS double) / width)) ELSE height END AS integer) AS fit_height"""


@query("fit_image_width", with_inputs(f"SELECT doc_id, idx, {_FIT} FROM images", "images"))
def _(spark, folder):
    return images.fit_image_width(inputs.images(spark, folder)).select("doc_id", "idx", "fit_width", "fit_height")


# --- records and reports -------------------------------------------------------------------------

_FILE_TYPE = "lower('.' || string_split(filename, '.')[-1])"


def _sql_record(doc_text: str, size_of: str, flags: str, tables_json: str = "''", images_json: str = "''") -> str:
    return f"""'{{"document_metadata":' || CAST(to_json({{'filename': filename, 'file_type': {_FILE_TYPE},
      'processing_date': '2024-05-06T07:08:09', 'file_size': CAST(strlen({size_of}) AS integer)}}) AS varchar)
      || ',"content":{{"text":' || CAST(to_json({doc_text}) AS varchar) || ',"tables":[' || {tables_json} || '],"images":[' || {images_json}
      || ']}},"processing_info":{flags}}}' AS json"""


@query(
    "json_record",
    with_inputs("", "pii_docs", "images", "tables").strip()
    + f""", {_REFS}, t AS (SELECT doc_id, string_agg(CAST(to_json({{'table_index': table_index, 'data': data, 'rows': rows, 'cols': cols,
        'page': page}}) AS varchar), ',' ORDER BY table_index) AS js FROM tables GROUP BY doc_id),
      info AS (SELECT doc_id, idx, {_INFO} FROM images),
      shown AS (SELECT doc_id, 0 AS part, idx, CAST(to_json({{'type': type, 'description': description, 'extracted_text': extracted_text,
          'ocr_applied': ocr_applied, 'image_format': image_format}}) AS varchar) AS js FROM info WHERE lower(extracted_text) NOT IN ('stc', 'sic')
        UNION ALL SELECT doc_id, 1, pos, CAST(to_json({{'type': 'referenced_image', 'description': description,
          'extracted_text': 'Referenced image: ' || description, 'ocr_applied': false}}) AS varchar) FROM refs r
        WHERE NOT EXISTS (SELECT 1 FROM info i WHERE i.doc_id = r.doc_id AND i.description = r.description)),
      i AS (SELECT doc_id, string_agg(js, ',' ORDER BY part, idx) AS js FROM shown GROUP BY doc_id)
      SELECT doc_id, """
    + _sql_record("text", "text", '{"anonymized":true,"pii_removed":true,"extracted_to_json":true}', "coalesce(t.js, '')", "coalesce(i.js, '')")
    + " FROM pii_docs LEFT JOIN t USING (doc_id) LEFT JOIN i USING (doc_id)",
)
def _(spark, folder):
    docs = inputs.pii_documents(spark, folder).withColumn("file_size", F.octet_length("text"))
    docs = docs.withColumn("file_type", F.concat(F.lit("."), F.lower(F.substring_index("filename", ".", -1))))
    found = tables.number_tables(inputs.raw_tables(spark, folder))
    pictures = inputs.images(spark, folder)
    return output.json_record(docs, JSON_OPTS, AS_OF, found, pictures)


@query(
    "document_records",
    with_inputs(
        "SELECT doc_id, "
        + _sql_record("done", "text", '{"anonymized":true,"pii_removed":true,"extracted_to_json":true}')
        + f" FROM (SELECT *, {sql_remove(sql_anonymize('text'))} AS done FROM docs) WHERE {_FILE_TYPE} IN ('.txt', '.pdf', '.docx')",
        "docs",
    ),
)
def _(spark, folder):
    return process_documents(inputs.documents(spark, folder), JSON_OPTS, AS_OF).records


@query(
    "document_image_records",
    with_inputs("", "docs", "measured").strip()
    + f""", i AS (SELECT doc_id, string_agg(CAST(to_json({{'type': coalesce(type, 'unknown'), 'description': coalesce(description, ''),
        'extracted_text': coalesce(g.extracted_text, ''), 'ocr_applied': false, 'image_format': 'unknown'}}) AS varchar), ',' ORDER BY idx) AS js
      FROM measured m JOIN ({_GATE}) g USING (doc_id, idx) GROUP BY doc_id)
      SELECT doc_id, """
    + _sql_record("done", "text", '{"anonymized":true,"pii_removed":true,"extracted_to_json":true}', images_json="coalesce(i.js, '')")
    + f" FROM (SELECT *, {sql_remove(sql_anonymize('text'))} AS done FROM docs) LEFT JOIN i USING (doc_id) WHERE {_FILE_TYPE} IN ('.txt', '.pdf', '.docx')",
)
def _(spark, folder):
    """Images of text documents go through the gate, at most three a document."""
    pictures = inputs.measured_images(spark, folder)
    return process_documents(inputs.documents(spark, folder), replace(JSON_OPTS, max_images=3), AS_OF, images=pictures).records


_FLAGS = '{"anonymized":true,"pii_removed":true,"extracted_to_json":true}'
_PAGE_SQL = f"""clipped AS (SELECT doc_id, page, pos, CASE WHEN page_height <= 0 OR (y1 > page_y0 + page_height * CAST(0.08 AS double)
      AND y0 < page_y0 + page_height * CAST(0.92 AS double)) THEN nullif(text, '') END AS text FROM blocks WHERE doc_id % 9 <> 4),
  page_parts AS (SELECT doc_id, page, coalesce(string_agg(text, chr(10) ORDER BY pos), '') AS text FROM clipped GROUP BY doc_id, page),
  whole AS (SELECT doc_id, coalesce(string_agg(nullif(text, ''), chr(10) ORDER BY page), '') AS text FROM page_parts GROUP BY doc_id),
  reads AS (SELECT doc_id, 'doc_' || doc_id || '.pdf' AS filename, coalesce(whole.text, CASE WHEN doc_id % 18 = 4 THEN 'plain ' || d.text END) AS text,
      CASE WHEN whole.text IS NOT NULL THEN 'pymupdf_single_pass' WHEN doc_id % 18 = 4 THEN 'pymupdf_text_only' END AS engine
    FROM documents d LEFT JOIN whole USING (doc_id)),
  signed AS (SELECT doc_id, page FROM page_parts WHERE {_sql_gate('text')}),
  numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS table_index, page + 1 AS page, data
    FROM raw_tables SEMI JOIN signed USING (doc_id, page) WHERE len(data) > 0),
  t AS (SELECT doc_id, string_agg(CAST(to_json({{'table_index': table_index, 'data': data, 'rows': len(data), 'cols': len(data[1]), 'page': page}})
    AS varchar), ',' ORDER BY table_index) AS js FROM numbered GROUP BY doc_id),
  pics AS (SELECT m.*, CASE WHEN NOT has_data THEN '[OCR skipped: no image data]' WHEN NOT likely THEN '[OCR skipped: low-text likelihood]'
      ELSE '' END AS reason FROM measured m SEMI JOIN whole USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id, page, xref ORDER BY img_idx) = 1),
  i AS (SELECT doc_id, string_agg(CAST(to_json({{'type': coalesce(type, 'unknown'), 'description': coalesce(description, ''), 'extracted_text': reason,
    'ocr_applied': false, 'image_format': 'unknown'}}) AS varchar), ',' ORDER BY idx) AS js FROM pics GROUP BY doc_id)"""


def _page_request(spark, folder, opts):
    """Pages of five lines; every ninth document has no blocks, half of those no other text either."""
    i = F.col("doc_id")
    named = inputs.documents(spark, folder).withColumn("filename", F.concat(F.lit("doc_"), "doc_id", F.lit(".pdf")))
    plain = named.where(i % 18 == 4).select("doc_id", F.concat(F.lit("plain "), "text").alias("text"), F.lit(None).cast("string").alias("error"))
    return process_pages(
        named.select("doc_id", "filename"), inputs.blocks(spark, folder).where(i % 9 != 4), opts, AS_OF,
        inputs.raw_tables(spark, folder), inputs.measured_images(spark, folder), plain,
    )


@query(
    "page_records",
    with_inputs("", "blocks", "raw_tables", "measured").strip()
    + f""", {_PAGE_SQL} SELECT doc_id, {_sql_record("done", "text", _FLAGS, "coalesce(t.js, '')", "coalesce(i.js, '')")}
      FROM (SELECT *, {sql_remove(sql_anonymize('text'))} AS done FROM reads WHERE text IS NOT NULL) LEFT JOIN t USING (doc_id) LEFT JOIN i USING (doc_id)""",
)
def _(spark, folder):
    return _page_request(spark, folder, JSON_OPTS).records


@query(
    "page_documents",
    with_inputs("", "blocks", "raw_tables", "measured").strip()
    + f""", {_PAGE_SQL} SELECT doc_id, 'doc_' || doc_id || '_processed.pdf' AS output_name, {sql_remove(sql_anonymize('text'))} AS text,
      engine AS pdf_engine, CASE WHEN text IS NULL THEN 'Unable to read PDF: no text' END AS error FROM reads""",
)
def _(spark, folder):
    return _page_request(spark, folder, OPTS).documents.select("doc_id", "output_name", "text", "pdf_engine", "error")


_DOCUMENT_RECORDS = with_inputs(
    "SELECT "
    + _sql_record("done", "text", '{"anonymized":true,"pii_removed":true,"extracted_to_json":true}')
    + f" FROM (SELECT *, {sql_remove(sql_anonymize('text'))} AS done FROM docs) WHERE {_FILE_TYPE} IN ('.txt', '.pdf', '.docx')",
    "docs",
)


@query("write_json_records", _DOCUMENT_RECORDS)
def _(spark, folder):
    path = f"{checkpoint_dir(spark)}/outputs/records_{uuid.uuid4().hex}"
    output.write_json_records(process_documents(inputs.documents(spark, folder), JSON_OPTS, AS_OF).records, path)
    return spark.read.text(path).withColumnRenamed("value", "json")


@query(
    "parse_records",
    with_inputs(
        f"""SELECT doc_id, filename, {_FILE_TYPE} AS file_type, CAST(strlen(text) AS bigint) AS file_size,
            {sql_remove(sql_anonymize('text'))} AS text, true AS pii_removed FROM docs WHERE {_FILE_TYPE} IN ('.txt', '.pdf', '.docx')""",
        "docs",
    ),
)
def _(spark, folder):
    records = process_documents(inputs.documents(spark, folder), JSON_OPTS, AS_OF).records
    return output.parse_records(records).select(
        "doc_id", "record.document_metadata.filename", "record.document_metadata.file_type",
        "record.document_metadata.file_size", "record.content.text", "record.processing_info.pii_removed",
    )


@query(
    "output_route",
    with_inputs(
        f"""SELECT doc_id, CASE WHEN kind <> '.csv' THEN '.json' END AS as_json, CASE WHEN kind <> '.csv' THEN '.pdf' END AS redacted,
            CASE kind WHEN '.csv' THEN NULL WHEN '.docx' THEN '.pdf' ELSE kind END AS untouched FROM (SELECT doc_id, {_FILE_TYPE} AS kind FROM docs)""",
        "docs",
    ),
)
def _(spark, folder):
    docs = inputs.documents(spark, folder).select("doc_id", F.lower(F.regexp_extract("filename", r"\.[^.]*$", 0)).alias("file_type"))
    for name, opts in {"as_json": JSON_OPTS, "redacted": OPTS, "untouched": RedactOptions()}.items():
        docs = output.output_route(docs, opts).withColumnRenamed("output_ext", name)
    return docs.drop("file_type")


@query(
    "output_name",
    r"""SELECT page_id, regexp_replace(base, '^(.+)\.[^.]+$', '\1') || '.json' AS as_json,
        regexp_replace(base, '^(.+)\.[^.]+$', '\1') || '_processed.pdf' AS redacted, url AS untouched
        FROM (SELECT page_id, url, string_split(rtrim(url, '/'), '/')[-1] AS base FROM pages)""",
)
def _(spark, folder):
    rows = inputs.read_table(spark, folder, "pages").select("page_id", "url")
    for name, opts in {"as_json": JSON_OPTS, "redacted": OPTS, "untouched": RedactOptions()}.items():
        rows = output.output_name(rows, opts, "url").withColumnRenamed("output_name", name)
    return rows.drop("url")


_ESCAPED = "replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(
    "report_rows",
    f"""WITH page_lines AS (SELECT page_id AS doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS place
          FROM (SELECT page_id, string_split(replace(html, '><', '>' || chr(10) || ' ' || chr(10) || '<'), chr(10)) AS p FROM pages))
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) + 1 AS integer) AS seq, 'paragraph' AS kind, {_ESCAPED} AS text
        FROM page_lines WHERE trim(line, {STRIP}) <> ''
      UNION ALL SELECT page_id, 0, 'title', 'Processed Document: ' || url FROM pages
      UNION ALL SELECT page_id, 1, 'time', 'Processed on: 2024-05-06 07:08:09' FROM pages""",
)
def _(spark, folder):
    rows = inputs.read_table(spark, folder, "pages").select(
        F.col("page_id").alias("doc_id"),
        F.col("url").alias("filename"),
        F.replace("html", F.lit("><"), F.lit(">\n \n<")).alias("text"),
    )
    return output.report_rows(rows, AS_OF)


@query(
    "report_table_preview",
    with_inputs(
        """SELECT doc_id, table_index, 'Table ' || (table_index + 1) || ':' AS title, CAST(place - 1 AS integer) AS row_idx,
             array_to_string(list_transform(range(1, 1 + cols), lambda k: CASE WHEN k <= len(r) THEN coalesce(r[k], 'None') ELSE '' END), '|') AS cells
           FROM (SELECT doc_id, table_index, cols, unnest(data) AS r, generate_subscripts(data, 1) AS place FROM tables)""",
        "tables",
    ),
)
def _(spark, folder):
    found = tables.number_tables(inputs.raw_tables(spark, folder))
    shown = output.report_table_preview(found)
    return shown.withColumn("cells", F.array_join("cells", "|"))


@query(
    "report_images",
    with_inputs(
        f"""SELECT doc_id, CAST(n AS integer) AS n, CASE WHEN coalesce(description, '') <> '' THEN 'Image ' || n || ': ' || description END AS caption,
            fit_width, fit_height FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n, description, {_FIT}
            FROM images WHERE n_bytes > 0 AND lower(trim(coalesce(extracted_text, ''))) NOT IN ('stc', 'sic'))""",
        "images",
    ),
)
def _(spark, folder):
    return output.report_images(inputs.images(spark, folder))

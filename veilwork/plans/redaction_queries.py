"""Registered queries over sources, terms, personal data and repeated content."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from veilwork.operators import dedup, fragments, pii, spans, terms
from veilwork.options import RedactOptions
from veilwork.patterns import PII_MARKER, PII_PATTERNS
from veilwork.plans import inputs
from veilwork.plans.inputs import with_inputs
from veilwork.plans.process import redact_docx_fragments, redact_document
from veilwork.sources import docx, files
from veilwork.sources.tables import load_documents, read_table

TERMS = ("John", "John Doe", "the", "The", " the ", "a+b (x)", "C#", "$5", r"\d", "né", "et le", "le", "und", "", None)
REPLACEMENT = r"<$1\x>"
NAMES = {"ther": "PERSON", "para": "ORG", "und": "GPE", "tion": "DATE"}
OPTS = RedactOptions(anonymize=True, remove_pii=True, terms=TERMS, replacement=REPLACEMENT)

STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_remove(expr: str, *kinds: str) -> str:
    for kind in kinds or PII_PATTERNS:
        expr = f"regexp_replace({expr}, {_literal(PII_PATTERNS[kind])}, '{PII_MARKER}', 'g')"
    return expr


def sql_anonymize(expr: str, opts: RedactOptions = OPTS) -> str:
    pattern = "|".join(map(re.escape, opts.terms))
    return f"regexp_replace({expr}, {_literal(pattern)}, {_literal(opts.replacement.replace(chr(92), chr(92) * 2))}, 'gi')"


QUERIES = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = (build, sql)
        return build

    return register


# --- sources -------------------------------------------------------------------------------------


@query("load_documents", with_inputs("SELECT doc_id, filename, text FROM docs", "docs"))
def _(spark, folder):
    return load_documents(spark, folder, inputs.filename())


@query(
    "read_text_files",
    """SELECT doc_id, CASE WHEN doc_id % 10 <> 0 THEN text END AS text,
       CASE WHEN doc_id % 10 = 0 THEN 'Invalid UTF-8 text' END AS error FROM documents""",
)
def _(spark, folder):
    raw = F.col("text").cast("binary")
    broken = F.when(F.col("doc_id") % 10 == 0, F.concat(raw, F.unhex(F.lit("FF41")))).otherwise(raw)
    rows = inputs.documents(spark, folder).select("doc_id", broken.alias("content"))
    return files.decode_text(rows).select("doc_id", "text", "error")


@query(
    "route_format",
    with_inputs(
        """SELECT doc_id, lower('.' || string_split(filename, '.')[-1]) AS file_type,
           CASE WHEN lower('.' || string_split(filename, '.')[-1]) NOT IN ('.txt', '.docx', '.pdf')
             THEN 'Unsupported file format: ' || lower('.' || string_split(filename, '.')[-1]) END AS error FROM docs""",
        "docs",
    ),
)
def _(spark, folder):
    return files.route_format(inputs.documents(spark, folder)).select("doc_id", "file_type", "error")


_OFFICE_FRAGMENTS = """office AS (
  SELECT doc_id, 'word/document.xml' AS part, unnest(list_filter(
      list_concat(parts, flatten(list_transform(parts[1:3], lambda l: string_split(l, ' ')))), lambda x: x <> '')) AS text,
    generate_subscripts(list_filter(
      list_concat(parts, flatten(list_transform(parts[1:3], lambda l: string_split(l, ' ')))), lambda x: x <> ''), 1) - 1 AS seq
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
  UNION ALL SELECT doc_id, 'word/header1.xml', concat('File ', doc_id, ' call 555-123-4567'), 0 FROM documents)"""


@query("docx_fragments", f"WITH {_OFFICE_FRAGMENTS} SELECT doc_id, part, CAST(seq AS integer) AS seq, text FROM office")
def _(spark, folder):
    return docx.docx_fragments(inputs.office_files(spark, folder)).select("doc_id", "part", "seq", "text")


@query(
    "docx_fragments_redacted",
    f"""WITH {_OFFICE_FRAGMENTS}, done AS (SELECT *, {sql_remove(sql_anonymize("text"))} AS new_text FROM office)
    SELECT doc_id, part, CAST(seq AS integer) AS seq, new_text, new_text <> text AS changed FROM done""",
)
def _(spark, folder):
    rows = redact_docx_fragments(inputs.office_files(spark, folder), OPTS)
    return rows.select("doc_id", "part", "seq", "new_text", "changed")


@query(
    "docx_structures",
    """WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)
    SELECT doc_id, 'paragraph' AS kind, CAST(generate_subscripts(p, 1) - 1 AS integer) AS idx, 0 AS row_idx, unnest(p) AS text, NULL AS cells FROM parts
    UNION ALL SELECT doc_id, 'table', 0, CAST(generate_subscripts(p[1:3], 1) - 1 AS integer), NULL, replace(unnest(p[1:3]), ' ', ' | ') FROM parts""",
)
def _(spark, folder):
    rows = docx.structure_text(docx.docx_structures(inputs.office_files(spark, folder)))
    cells = F.when(F.col("cells").isNotNull(), F.array_join("cells", " | ")).alias("cells")
    return rows.select("doc_id", "kind", "idx", "row_idx", "text", cells)


@query(
    "docx_images",
    """SELECT doc_id, 0 AS idx, 'Embedded image rId2' AS description, 'PNG' AS image_format,
         CAST(13 + length(CAST(doc_id AS varchar)) AS bigint) AS n_bytes, false AS failed FROM documents
       UNION ALL SELECT doc_id, 1, 'Embedded image rId3 (extraction failed)', 'unknown', 0, true FROM documents""",
)
def _(spark, folder):
    return docx.docx_images(inputs.office_files(spark, folder)).select(
        "doc_id", "idx", "description", "image_format",
        F.octet_length("image_data").cast("long").alias("n_bytes"),
        F.col("extracted_text").startswith("[Image extraction failed").alias("failed"),
    )


# --- terms ---------------------------------------------------------------------------------------


def _sql_terms(split: str) -> str:
    return f"""WITH cut AS (SELECT doc_id, parts, generate_subscripts(parts, 1) AS place, trim(unnest(parts), {STRIP}) AS term
        FROM (SELECT doc_id, {split} AS parts FROM documents)),
      firsts AS (SELECT doc_id, place, term FROM cut WHERE term <> ''
        QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY place) = 1)
      SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS integer) AS pos, term FROM firsts"""


@query("parse_terms", _sql_terms(r"string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]|,')"))
def _(spark, folder):
    return terms.parse_terms(inputs.documents(spark, folder), "text", "doc_id")


@query(
    "normalize_terms",
    _sql_terms("list_filter(list_transform(string_split(text, ' '), lambda w: CASE WHEN w <> 'the' THEN w END), lambda w: w IS NOT NULL)"),
)
def _(spark, folder):
    words = F.transform(F.split("text", " ", -1), lambda w: F.when(w != "the", w))
    rows = inputs.documents(spark, folder).select("doc_id", words.alias("terms"))
    return terms.normalize_terms(rows, "terms", "doc_id")


@query("anonymize_terms", with_inputs(f"SELECT doc_id, {sql_anonymize('text')} AS text FROM docs", "docs"))
def _(spark, folder):
    return terms.anonymize(inputs.documents(spark, folder), TERMS, REPLACEMENT).select("doc_id", "text")


@query(
    "anonymize_from_table",
    f"""WITH words AS (SELECT concat('src', item_id % 25) AS source, item_id * 100000 + generate_subscripts(w, 1) - 1 AS pos, trim(unnest(w), {STRIP}) AS term
        FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
      firsts AS (SELECT * FROM words WHERE term <> '' QUALIFY row_number() OVER (PARTITION BY source, lower(term) ORDER BY pos) = 1),
      patterns AS (SELECT source, string_agg(regexp_escape(term), '|' ORDER BY pos) AS pattern FROM firsts GROUP BY source)
      SELECT doc_id, CASE WHEN pattern IS NULL THEN text ELSE regexp_replace(text, pattern, '<' || source || '>', 'gi') END AS text
      FROM documents LEFT JOIN patterns USING (source)""",
)
def _(spark, folder):
    words = read_table(spark, folder, "benchmark").select(
        F.concat(F.lit("src"), F.col("item_id") % 25).alias("source"),
        "item_id",
        F.posexplode(F.split("text", " ", -1)).alias("place", "term"),
    )
    listed = words.select(
        "source",
        (F.col("item_id") * 100000 + F.col("place")).alias("pos"),
        "term",
        F.concat(F.lit("<"), "source", F.lit(">")).alias("replacement"),
    )
    return terms.anonymize_by_group(inputs.documents(spark, folder), listed, "source").select("doc_id", "text")


# --- personal data -------------------------------------------------------------------------------


def _register_kind(kind: str):
    @query(f"pii_{kind}", with_inputs(f"SELECT doc_id, {sql_remove('text', kind)} AS text FROM pii_docs", "pii_docs"))
    def _(spark, folder):
        return getattr(pii, f"pii_{kind}")(inputs.pii_documents(spark, folder)).select("doc_id", "text")


for _kind in PII_PATTERNS:
    _register_kind(_kind)


@query("remove_pii_regex", with_inputs(f"SELECT doc_id, {sql_remove('text')} AS text FROM pii_docs", "pii_docs"))
def _(spark, folder):
    return pii.remove_pii_regex(inputs.pii_documents(spark, folder)).select("doc_id", "text")


@query("remove_pii_pages", f"SELECT page_id, {sql_remove('html')} AS html FROM pages")
def _(spark, folder):
    return pii.remove_pii_regex(read_table(spark, folder, "pages"), "html").select("page_id", "html")


@query(
    "redact_spans",
    with_inputs(
        f"""SELECT doc_id, coalesce(r.out || substr(text, r.last + 1), text) AS text FROM documents LEFT JOIN (
          SELECT doc_id, string_agg(substr(text, prev + 1, greatest(start_at - prev, 0)) || '{PII_MARKER}', '' ORDER BY start_at, end_at) AS out,
            max(end_at) AS last
          FROM (SELECT s.doc_id, text, start_at, end_at, coalesce(max(end_at) OVER (PARTITION BY s.doc_id ORDER BY start_at, end_at
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
            FROM (SELECT DISTINCT doc_id, start_at, end_at FROM spans WHERE label IN ('PERSON', 'ORG', 'GPE')) s JOIN documents USING (doc_id))
          GROUP BY doc_id) r USING (doc_id)""",
        "spans",
    ),
)
def _(spark, folder):
    docs = inputs.documents(spark, folder)
    return spans.redact_spans(docs, inputs.spans(spark, folder)).select("doc_id", "text")


@query(
    "remove_pii",
    with_inputs(
        f"""SELECT doc_id, regexp_replace({sql_remove('text')}, 'ther|para|und', '{PII_MARKER}', 'gi') AS text FROM pii_docs""",
        "pii_docs",
    ),
)
def _(spark, folder):
    tagger = spans.dictionary_tagger(NAMES)
    return spans.remove_pii(inputs.pii_documents(spark, folder), tagger).select("doc_id", "text")


@query("ner_mode", "SELECT doc_id, 'spacy_batch' AS with_tagger, 'regex_only' AS without_tagger, 'regex_only' AS throughput FROM documents")
def _(spark, folder):
    tagger = spans.dictionary_tagger(NAMES)
    return read_table(spark, folder, "documents").select(
        "doc_id",
        spans.ner_mode(tagger, False).alias("with_tagger"),
        spans.ner_mode(None, False).alias("without_tagger"),
        spans.ner_mode(tagger, True).alias("throughput"),
    )


@query(
    "redact_fragments",
    with_inputs(
        f"""SELECT *, new_text <> text AS changed FROM (SELECT doc_id, part, seq, text, {sql_remove('text')} AS new_text FROM fragments)""",
        "fragments",
    ),
)
def _(spark, folder):
    return fragments.redact_fragments(inputs.fragments(spark, folder), "remove_pii", OPTS)


@query(
    "select_redactable_parts",
    with_inputs(
        "SELECT doc_id, part, seq FROM fragments WHERE part IN ('word/document.xml', 'word/header1.xml', 'word/footer2.xml')",
        "fragments",
    ),
)
def _(spark, folder):
    return fragments.select_redactable_parts(inputs.fragments(spark, folder)).select("doc_id", "part", "seq")


@query(
    "rejoin_fragments",
    with_inputs(
        f"SELECT doc_id, part, string_agg({sql_anonymize('text')}, '' ORDER BY seq) AS text FROM fragments GROUP BY doc_id, part",
        "fragments",
    ),
)
def _(spark, folder):
    redacted = fragments.redact_fragments(inputs.fragments(spark, folder), "anonymize", OPTS)
    return fragments.rejoin_fragments(redacted)


@query(
    "redact_document",
    with_inputs(f"SELECT doc_id, {sql_remove(sql_anonymize('text'))} AS text FROM pii_docs", "pii_docs"),
)
def _(spark, folder):
    return redact_document(inputs.pii_documents(spark, folder), OPTS).select("doc_id", "text")


def _sql_stages() -> str:
    kinds = list(PII_PATTERNS)
    ctes, extra = [], with_inputs("", "pii_docs").removeprefix("WITH ").strip()
    previous = "SELECT doc_id, source, text FROM pii_docs"
    for i, kind in enumerate(kinds):
        ctes.append(f"s{i} AS ({previous})")
        previous = f"SELECT doc_id, source, {sql_remove('text', kind)} AS text FROM s{i}"
    found = " UNION ALL ".join(
        f"SELECT doc_id, source, '{k}' AS kind, regexp_extract_all(text, {_literal(PII_PATTERNS[k])}) AS m FROM s{i}"
        for i, k in enumerate(kinds)
    )
    return f"WITH {extra}, {', '.join(ctes)}, found AS ({found}) "


@query("pii_findings", _sql_stages() + "SELECT doc_id, kind, CAST(generate_subscripts(m, 1) - 1 AS integer) AS pos, unnest(m) AS match FROM found")
def _(spark, folder):
    return pii.pii_findings(inputs.pii_documents(spark, folder))


@query("pii_summary", _sql_stages() + "SELECT source, kind, CAST(sum(len(m)) AS bigint) AS n FROM found GROUP BY source, kind")
def _(spark, folder):
    return pii.pii_summary(inputs.pii_documents(spark, folder))


# --- repeated content ----------------------------------------------------------------------------


@query("fingerprint", f"SELECT doc_id, sha256(text || {_literal(OPTS.as_json())}) AS fp FROM documents")
def _(spark, folder):
    return dedup.fingerprint(inputs.documents(spark, folder), OPTS).select("doc_id", "fp")


@query(
    "process_once",
    with_inputs(
        f"""SELECT doc_id, filename, sha256(text || {_literal(OPTS.as_json())}) AS fp, {sql_remove(sql_anonymize('text'))} AS text,
            row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS cache_hit FROM docs""",
        "docs",
    ),
)
def _(spark, folder):
    docs = inputs.documents(spark, folder).select("doc_id", "filename", "text")
    return dedup.process_once(docs, lambda unique: redact_document(unique, OPTS), OPTS)

"""Inputs of the registered queries: each is a projection of whole given tables.

Every function has a twin in ``SQL``, the same projection for the SQL check.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.operators.images import image_text_likelihood, pixel_stats
from veilwork.plans import packing
from veilwork.sources.tables import load_documents, read_table, spread

SQL: dict[str, str] = {}


def dealt(df: DataFrame, key: str) -> DataFrame:
    """A given table may be one small file with fewer splits than cores; its rows are dealt out then."""
    return df if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism else spread(df, key)


def filename() -> Column:
    kinds = F.array(*[F.lit(e) for e in (".txt", ".PDF", ".docx", ".csv")])
    return F.concat(F.lit("doc_"), F.col("doc_id"), F.get(kinds, (F.col("doc_id") % 4).cast("int")))


FILENAME_SQL = "concat('doc_', doc_id, (['.txt', '.PDF', '.docx', '.csv'])[1 + doc_id % 4])"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return dealt(load_documents(spark, folder, filename(), ("lang", "source", "n_chars")), "doc_id")


SQL["docs"] = f"SELECT doc_id, {FILENAME_SQL} AS filename, text, lang, source, n_chars FROM documents"


def pii_text() -> Column:
    def s(c) -> Column:
        return c.cast("string")

    i = F.col("doc_id")
    return F.concat(
        F.col("text"), F.lit(" SSN "), F.lpad(s(i % 900 + 100), 3, "0"), F.lit("-45-6789 IBAN NL91ABNA"),
        F.lpad(s(i), 10, "0"), F.lit(" BE68 5390 0754 7034 9 card 4111-1111-1111-"), F.lpad(s(i % 10000), 4, "0"),
        F.lit(" ![fig "), s(i % 5), F.lit("](u) [Image: logo] [Image: fig 1]"),
    )


def pii_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with personal data of every kind and image references added to each text."""
    return documents(spark, folder).withColumn("text", pii_text())


SQL["pii_docs"] = f"""SELECT doc_id, {FILENAME_SQL} AS filename, source, lang,
  concat(text, ' SSN ', lpad(CAST(doc_id % 900 + 100 AS varchar), 3, '0'), '-45-6789 IBAN NL91ABNA',
    lpad(CAST(doc_id AS varchar), 10, '0'), ' BE68 5390 0754 7034 9 card 4111-1111-1111-',
    lpad(CAST(doc_id % 10000 AS varchar), 4, '0'), ' ![fig ', CAST(doc_id % 5 AS varchar),
    '](u) [Image: logo] [Image: fig 1]') AS text FROM documents"""


def lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


SQL["doc_lines"] = """SELECT doc_id, pos - 1 AS pos, line FROM (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Five lines a page, each a block of one twentieth of the page at a fifth of its height."""
    at = F.col("pos") % 5
    return lines(spark, folder).select(
        "doc_id",
        "pos",
        F.floor(F.col("pos") / 5).cast("int").alias("page"),
        (20.0 * at).alias("y0"),
        (20.0 * at + 5).alias("y1"),
        F.lit(0.0).alias("page_y0"),
        F.when(F.col("pos") % 11 == 10, 0.0).otherwise(100.0).alias("page_height"),
        F.col("line").alias("text"),
    )


SQL["blocks"] = """SELECT doc_id, pos, CAST(pos // 5 AS integer) AS page, CAST(20.0 * (pos % 5) AS double) AS y0,
  CAST(20.0 * (pos % 5) + 5 AS double) AS y1, CAST(0 AS double) AS page_y0,
  CAST(CASE WHEN pos % 11 = 10 THEN 0 ELSE 100 END AS double) AS page_height, line AS text FROM doc_lines"""


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Whole pages of five lines."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "text")))
    return blocks(spark, folder).groupBy("doc_id", "page").agg(
        F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text")
    )


SQL["page_texts"] = "SELECT doc_id, page, string_agg(text, chr(10) ORDER BY pos) AS text FROM blocks GROUP BY doc_id, page"


def raw_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A table per line: sentences are rows, words are cells; every seventh came out empty."""
    rows = F.transform(F.split("line", r"\. ", -1), lambda r: F.split(r, " ", -1))
    empty = F.array().cast("array<array<string>>")
    return lines(spark, folder).select(
        "doc_id",
        F.floor(F.col("pos") / 5).cast("int").alias("page"),
        "pos",
        F.when(F.col("pos") % 7 == 3, empty).otherwise(rows).alias("data"),
    )


SQL["raw_tables"] = """SELECT doc_id, CAST(pos // 5 AS integer) AS page, pos,
  CASE WHEN pos % 7 = 3 THEN CAST([] AS varchar[][])
    ELSE list_transform(string_split(line, '. '), lambda r: string_split(r, ' ')) END AS data FROM doc_lines"""
SQL["tables"] = """SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) - 1 AS integer)
  AS table_index, page + 1 AS page, data, CAST(len(data) AS integer) AS rows, CAST(len(data[1]) AS integer) AS cols
  FROM raw_tables WHERE len(data) > 0"""


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Worker messages from events; sign-ups stand for the message that a batch was cancelled."""
    return messages_from(read_table(spark, folder, "events"))


def messages_from(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    signup = kind == "signup"
    i = F.col("event_id")
    return events.select(
        F.concat(F.lit("b"), F.col("user_id") % 8).alias("batch_id"),
        F.when(~signup, F.floor(F.col("user_id") / 8).cast("int")).alias("idx"),
        i.alias("seq"),
        F.when(kind == "view", "status").when(kind == "purchase", "result").when(kind == "error", "error")
        .when(kind == "click", "cancel").otherwise("cancelled").alias("type"),
        F.concat(F.lit("file_"), F.col("user_id"), F.lit(".txt")).alias("original_name"),
        F.when(kind == "error", F.concat(F.lit("code "), (i % 7).cast("string"))).alias("error"),
        F.when(signup, (10 + i % 5).cast("int")).alias("submitted"),
        F.when(signup, (20 + i % 3).cast("int")).alias("total"),
        F.when(signup, (i % 4).cast("int")).alias("cancelled"),
    )


SQL["messages"] = """SELECT concat('b', user_id % 8) AS batch_id,
  CASE WHEN event_type <> 'signup' THEN CAST(user_id // 8 AS integer) END AS idx, event_id AS seq,
  CASE event_type WHEN 'view' THEN 'status' WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'error'
    WHEN 'click' THEN 'cancel' ELSE 'cancelled' END AS type,
  concat('file_', user_id, '.txt') AS original_name,
  CASE WHEN event_type = 'error' THEN concat('code ', event_id % 7) END AS error,
  CASE WHEN event_type = 'signup' THEN CAST(10 + event_id % 5 AS integer) END AS submitted,
  CASE WHEN event_type = 'signup' THEN CAST(20 + event_id % 3 AS integer) END AS total,
  CASE WHEN event_type = 'signup' THEN CAST(event_id % 4 AS integer) END AS cancelled FROM events"""


def files(spark: SparkSession, folder: str) -> DataFrame:
    """One file per customer, spread over eight batches; many never get a message."""
    k = F.col("c_custkey")
    return read_table(spark, folder, "customer").select(
        F.concat(F.lit("b"), k % 8).alias("batch_id"),
        F.floor(k / 8).cast("int").alias("idx"),
        F.concat(F.col("c_name"), F.lit(".txt")).alias("file"),
    )


SQL["files"] = """SELECT concat('b', c_custkey % 8) AS batch_id, CAST(c_custkey // 8 AS integer) AS idx,
  concat(c_name, '.txt') AS file FROM customer"""
SQL["status"] = """SELECT f.batch_id, f.idx, f.file,
  CASE WHEN coalesce(s.kind, 'status') = 'status' AND s.cancel_seq > coalesce(s.last_seq, -1) THEN 'Cancelled'
    WHEN s.kind = 'status' THEN 'Processing' WHEN s.kind = 'result' THEN 'Done' WHEN s.kind = 'error' THEN 'Error'
    ELSE 'Queued' END AS status,
  CASE WHEN s.kind = 'result' THEN 100
    WHEN s.kind = 'status' AND NOT coalesce(s.cancel_seq > s.last_seq, false) THEN 50 ELSE 0 END AS progress
  FROM files f LEFT JOIN (SELECT batch_id, idx,
    arg_max(type, seq) FILTER (WHERE type IN ('status', 'result', 'error')) AS kind,
    max(seq) FILTER (WHERE type IN ('status', 'result', 'error')) AS last_seq,
    max(seq) FILTER (WHERE type = 'cancel') AS cancel_seq
    FROM messages WHERE idx IS NOT NULL GROUP BY batch_id, idx) s USING (batch_id, idx)"""


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty images a document from embeddings: the numbers scaled to grey values are the pixels."""
    v = F.col("vec_id")
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 0.5) * 255))).cast("int"))
    heads = F.array(*[F.lit(h) for h in ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "424D", "49492A00", "524946460000000057454250", "00")])
    data = F.concat(
        F.unhex(F.get(heads, (v % 7).cast("int"))), F.repeat(F.lit("x"), ((v * 37) % 20000).cast("int")).cast("binary")
    )
    texts = F.array(*[F.lit(t) for t in (" stc", "STC", "sic", "Invoice", None)])
    return read_table(spark, folder, "embeddings").select(
        F.floor(v / 20).alias("doc_id"),
        (v % 20).cast("int").alias("idx"),
        (v % 20).cast("int").alias("img_idx"),
        (F.floor((v % 20) / 5) + 1).cast("int").alias("page"),
        (v % 6).cast("int").alias("xref"),
        F.when(v % 13 != 5, (16 + v % 64 * 13).cast("int")).alias("width"),
        F.when(v % 13 != 5, (20 + v % 90).cast("int")).alias("height"),
        (v % 7 != 0).alias("has_data"),
        grey.alias("pixels"),
        F.when(v % 7 != 0, data).alias("image_data"),
        F.get(texts, (v % 5).cast("int")).alias("extracted_text"),
        F.when(v % 3 != 1, F.concat(F.lit("fig "), (v % 4).cast("string"))).alias("description"),
        F.when(v % 4 != 2, "pdf_embedded_image").alias("type"),
        F.when(v % 9 != 4, v % 2 == 0).alias("ocr_applied"),
    )


SQL["images"] = """SELECT vec_id // 20 AS doc_id, CAST(vec_id % 20 AS integer) AS idx, CAST(vec_id % 20 AS integer) AS img_idx,
  CAST((vec_id % 20) // 5 + 1 AS integer) AS page, CAST(vec_id % 6 AS integer) AS xref,
  CASE WHEN vec_id % 13 <> 5 THEN CAST(16 + vec_id % 64 * 13 AS integer) END AS width,
  CASE WHEN vec_id % 13 <> 5 THEN CAST(20 + vec_id % 90 AS integer) END AS height,
  vec_id % 7 <> 0 AS has_data,
  list_transform(embedding, lambda x: CAST(greatest(0, least(255, floor((CAST(x AS double) + 0.5) * 255))) AS integer)) AS pixels,
  (['89504E470D0A1A0A', 'FFD8FFE0', '474946383961', '424D', '49492A00', '524946460000000057454250', '00'])[1 + vec_id % 7] AS head,
  CASE WHEN vec_id % 7 <> 0 THEN length((['89504E470D0A1A0A', 'FFD8FFE0', '474946383961', '424D', '49492A00',
    '524946460000000057454250', '00'])[1 + vec_id % 7]) // 2 + (vec_id * 37) % 20000 END AS n_bytes,
  ([' stc', 'STC', 'sic', 'Invoice', NULL])[1 + vec_id % 5] AS extracted_text,
  CASE WHEN vec_id % 3 <> 1 THEN concat('fig ', vec_id % 4) END AS description,
  CASE WHEN vec_id % 4 <> 2 THEN 'pdf_embedded_image' END AS type,
  CASE WHEN vec_id % 9 <> 4 THEN vec_id % 2 = 0 END AS ocr_applied FROM embeddings"""


def measured_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images with the statistics a text test needs; those of unknown size were not measured."""
    known = F.col("width").isNotNull()
    stats = pixel_stats(images(spark, folder))
    stats = stats.withColumns({c: F.when(known, F.col(c)) for c in ("stddev", "dark_share")})
    return image_text_likelihood(stats)


SQL["measured"] = """SELECT *, CASE WHEN width IS NULL THEN true ELSE NOT (width < 32 OR height < 32 OR width * height < 2000
  OR list_stddev_pop(pixels) < 8 OR len(list_filter(pixels, lambda p: p < 110)) / len(pixels) < 0.01) END AS likely FROM images"""


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Spans in every text of more than 60 characters, some of which overlap, nest or repeat.

    Labels turn with the document.
    """
    i = F.col("doc_id")
    shift = (i % 7).cast("int")
    labels = F.array(*[F.lit(x) for x in ("PERSON", "ORG", "DATE")])

    def span(start, end, n: int) -> Column:
        label = F.get(labels, ((i + n) % 3).cast("int"))
        return F.struct(start.alias("start"), end.alias("end"), label.alias("label"))

    six = (
        span(F.lit(0), F.lit(3), 0), span(shift + 5, shift + 12, 1), span(F.lit(30), F.lit(34), 2),
        span(shift + 6, shift + 9, 0), span(shift + 10, shift + 15, 2), span(F.lit(30), F.lit(34), 1),
    )
    docs = read_table(spark, folder, "documents").where("n_chars > 60").select("doc_id")
    return docs.select("doc_id", F.inline(F.array(*six)))


SQL["spans"] = """SELECT doc_id, s.a AS start_at, s.b AS end_at, (['PERSON', 'ORG', 'DATE'])[1 + (doc_id + s.n) % 3] AS label
  FROM (SELECT doc_id, unnest([{'a': 0, 'b': 3, 'n': 0}, {'a': 5 + doc_id % 7, 'b': 12 + doc_id % 7, 'n': 1},
    {'a': 30, 'b': 34, 'n': 2}, {'a': 6 + doc_id % 7, 'b': 9 + doc_id % 7, 'n': 0}, {'a': 10 + doc_id % 7, 'b': 15 + doc_id % 7, 'n': 2},
    {'a': 30, 'b': 34, 'n': 1}]) AS s FROM documents WHERE n_chars > 60)"""


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """A source is a batch, the document's place is its upload order, sizes are 3000 times the text's."""
    return read_table(spark, folder, "documents").select(
        F.col("source").alias("batch_id"),
        F.col("doc_id").alias("ord"),
        "doc_id",
        filename().alias("filename"),
        (F.octet_length("text").cast("long") * 3000).alias("size"),
    )


SQL["uploads"] = f"""SELECT source AS batch_id, doc_id AS ord, doc_id, {FILENAME_SQL} AS filename,
  CAST(strlen(text) AS bigint) * 3000 AS size FROM documents"""


def results(spark: SparkSession, folder: str, task_rows: int | None = None) -> DataFrame:
    """A result per event: place by user, options and state by event, content from its properties.

    Contents are many times their events. Where they are shuffled, ``task_rows`` deals the events out before, as a task that
    shuffles holds its rows in memory for as long as there is some.
    """
    i = F.col("event_id")
    exts = F.array(*[F.lit(e) for e in (".json", ".pdf", ".txt")])
    events = read_table(spark, folder, "events")
    if task_rows is not None:
        tasks = -(-events.count() // task_rows)
        events = events.repartition(tasks, "event_id") if tasks > events.rdd.getNumPartitions() else events
    return events.select(
        F.concat(F.lit("b"), F.col("user_id") % 8).alias("batch_id"),
        F.floor(F.col("user_id") / 8).cast("int").alias("ord"),
        i.alias("seq"),
        F.concat(F.lit("out_"), F.col("user_id"), F.get(exts, (i % 3).cast("int"))).alias("name"),
        F.concat(F.lit("file_"), F.col("user_id"), F.lit(".txt")).alias("original_name"),
        F.get(exts, (i % 3).cast("int")).alias("file_extension"),
        F.when(i % 17 == 0, F.lit("").cast("binary"))
        .otherwise(F.repeat(F.col("props"), (1 + i % 400).cast("int")).cast("binary")).alias("content"),
        F.col("ts").cast("timestamp").alias("processed_time"),
        F.when(i % 5 == 4, "Error").otherwise("Done").alias("status"),
        (i % 6 == 0).alias("cache_hit"),
        F.struct(
            (i % 2 == 0).alias("anonymize"), (i % 3 == 0).alias("remove_pii"), (i % 5 == 0).alias("extract_json")
        ).alias("operations"),
    )


SQL["results"] = """SELECT concat('b', user_id % 8) AS batch_id, CAST(user_id // 8 AS integer) AS ord, event_id AS seq,
  concat('out_', user_id, (['.json', '.pdf', '.txt'])[1 + event_id % 3]) AS name, concat('file_', user_id, '.txt') AS original_name,
  (['.json', '.pdf', '.txt'])[1 + event_id % 3] AS file_extension,
  CASE WHEN event_id % 17 = 0 THEN 0 ELSE strlen(props) * (1 + event_id % 400) END AS size, ts AS processed_time,
  CASE WHEN event_id % 5 = 4 THEN 'Error' ELSE 'Done' END AS status, event_id % 6 = 0 AS cache_hit,
  event_id % 2 = 0 AS op_a, event_id % 3 = 0 AS op_p, event_id % 5 = 0 AS op_j FROM events"""


def steps(spark: SparkSession, folder: str) -> DataFrame:
    """Timed steps from events: the user is the document, the kind of event the step."""
    return read_table(spark, folder, "events").select(
        F.col("user_id").alias("doc_id"),
        F.concat(F.lit("step_"), F.col("event_type")).alias("step"),
        F.col("value").alias("seconds"),
    )


SQL["steps"] = "SELECT user_id AS doc_id, concat('step_', event_type) AS step, value AS seconds FROM events"


def office_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents packed as office files in the tasks: a paragraph per line, a table of the words of
    the first three lines, a header, a footnote part, and one image present and one missing."""
    docs = documents(spark, folder).select("doc_id", "filename", "text")
    named = docs.withColumn("filename", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".docx")))
    return named.mapInArrow(packing.pack, "doc_id long, filename string, content binary")


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as the fragments of a document, in parts of which some are redactable."""
    parts = F.array(*[F.lit(p) for p in ("word/document.xml", "word/header1.xml", "word/footnotes.xml", "word/footer2.xml")])
    turns = read_table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc_id"),
        F.get(parts, (F.floor(F.col("turn") / 2) % 4).cast("int")).alias("part"),
        F.col("turn").cast("int").alias("seq"),
        F.concat(F.col("text"), F.lit(" call 555-"), F.lpad((F.col("turn") % 1000).cast("string"), 3, "0"), F.lit("-4567")).alias("text"),
    )
    return dealt(turns, "doc_id")


SQL["fragments"] = """SELECT conv_id AS doc_id, (['word/document.xml', 'word/header1.xml', 'word/footnotes.xml',
  'word/footer2.xml'])[1 + (turn // 2) % 4] AS part, CAST(turn AS integer) AS seq,
  concat(text, ' call 555-', lpad(CAST(turn % 1000 AS varchar), 3, '0'), '-4567') AS text FROM conversations"""


def _dependencies(name: str, seen: list[str]) -> list[str]:
    for other in SQL:
        if other != name and re.search(rf"\b(?:FROM|JOIN) {other}\b", SQL[name]) and other not in seen:
            _dependencies(other, seen)
    if name not in seen:
        seen.append(name)
    return seen


def with_inputs(query: str, *names: str) -> str:
    """``query`` behind the input projections it names, each once and in order."""
    order: list[str] = []
    for name in names:
        _dependencies(name, order)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + query

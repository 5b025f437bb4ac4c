"""Text and office files, made by the tests."""

import io
import json
import zipfile
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilwork import patterns
from veilwork.operators import batch, fragments, pages, spans, status
from veilwork.operators.images import ocr_apply, ocr_entries
from veilwork.options import RedactOptions
from veilwork.plans import packing
from veilwork.plans.batch_run import run_batch
from veilwork.plans.process import process_docx, process_documents, redact_docx_fragments
from veilwork.sources import docx
from veilwork.sources.files import read_binary_files, read_text_files

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
AS_OF = datetime(2024, 5, 6)


def run(text):
    return f'<w:r><w:t xml:space="preserve">{text}</w:t></w:r>'


def paragraph(*texts):
    return f"<w:p>{''.join(map(run, texts))}</w:p>"


def cell(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{paragraph(text)}</w:tc>"


BODY = (
    paragraph("Ann wrote a@b.co")
    + paragraph("  ")
    + paragraph("split 123-", "45-6789")
    + "<w:p><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:tab/><w:t>tabbed</w:t><w:br/><w:br w:type='page'/></w:r></w:p>"
    + "<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/></w:tblGrid>"
    + f"<w:tr>{cell('123-45-6789')}{cell('b')}</w:tr><w:tr>{cell('wide', '<w:gridSpan w:val=\"2\"/>')}</w:tr>"
    + f"<w:tr>{cell('top', '<w:vMerge w:val=\"restart\"/>')}{cell('x')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('y')}</w:tr></w:tbl>"
)
RELS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="t" Target="media/image1.png"/><Relationship Id="rId2" Type="t" Target="theme.xml"/>'
    '<Relationship Id="rId3" Type="t" Target="http://x/image.png" TargetMode="External"/></Relationships>'
)


def package(body=BODY, header=paragraph("head 555-123-4567"), **members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {NS}>{header}</w:hdr>")
        z.writestr("word/footer1.xml", f"<w:ftr {NS}>{paragraph('foot')}</w:ftr>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {NS}>{paragraph('a@b.co')}</w:footnotes>")
        z.writestr("word/_rels/document.xml.rels", RELS)
        z.writestr("word/media/image1.png", bytes.fromhex("89504E470D0A1A0A") + b"x")
    return buffer.getvalue()


@pytest.fixture(scope="module")
def office(spark):
    data = [(1, "small.docx", package()), (2, "broken.docx", b"no zip"), (3, "bad_body.docx", package(body="<w:p>")),
            (4, "bad_head.docx", package(body=paragraph("ok"), header="<w:p>")), (5, "empty.docx", package(body=""))]
    return spark.createDataFrame(data, "doc_id long, filename string, content binary").repartition(3)


def test_text_files(spark, tmp_path):
    (tmp_path / "ok.txt").write_bytes("né\nb".encode())
    (tmp_path / "bad.TXT").write_bytes(b"\xffA")
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "other.pdf").write_bytes(b"x")
    got = {r.filename: (r.text, r.error, r.file_size) for r in read_text_files(spark, str(tmp_path)).collect()}
    # Spark's file reader leaves out files of no bytes.
    assert got == {"ok.txt": ("né\nb", None, 5), "bad.TXT": (None, "Invalid UTF-8 text", 2)}
    docs = read_text_files(spark, str(tmp_path)).withColumn("doc_id", F.xxhash64("path"))
    done = process_documents(docs, RedactOptions(remove_pii=True), AS_OF).documents
    assert {r.filename: (r.output_ext, r.error) for r in done.collect()}["bad.TXT"] == (".pdf", "Invalid UTF-8 text")
    assert read_binary_files(spark, str(tmp_path)).count() == 3


def test_fragments(office):
    got = [tuple(r) for r in docx.docx_fragments(office).where("doc_id = 1 AND part <> 'word/document.xml'").collect()]
    assert sorted(got) == [(1, "word/footer1.xml", 0, "foot", None), (1, "word/header1.xml", 0, "head 555-123-4567", None)]
    body = docx.docx_fragments(office).where("doc_id = 1 AND part = 'word/document.xml'").orderBy("seq").collect()
    assert [r.text for r in body][:6] == ["Ann wrote a@b.co", "  ", "split 123-", "45-6789", "link", "tabbed"]
    errors = docx.docx_fragments(office).where("error IS NOT NULL").collect()
    assert {(r.doc_id, r.part, r.text) for r in errors} == {(2, None, None), (3, "word/document.xml", None), (4, "word/header1.xml", None)}


def test_redacted_fragments(office):
    opts = RedactOptions(anonymize=True, remove_pii=True, terms=("ann",), replacement="X")
    done = redact_docx_fragments(office, opts).where("doc_id = 1 AND changed").collect()
    assert {(r.text, r.new_text) for r in done} == {
        ("Ann wrote a@b.co", "X wrote [PII_REMOVED]"), ("123-45-6789", "[PII_REMOVED]"), ("head 555-123-4567", "head[PII_REMOVED]"),
    }
    tagged = redact_docx_fragments(office, RedactOptions(remove_pii=True), spans.dictionary_tagger({"foot": "ORG"}))
    assert tagged.where("new_text = '[PII_REMOVED]' AND text = 'foot'").count() == 4
    joined = fragments.rejoin_fragments(redact_docx_fragments(office, opts).where("error IS NULL"))
    assert {r.part: r.text for r in joined.where("doc_id = 4").collect()} == {"word/document.xml": "ok", "word/footer1.xml": "foot"}


def test_structures(office):
    rows = docx.structure_text(docx.docx_structures(office).where("doc_id = 1"))
    text = pages.assemble_docx_text(rows).first().text
    assert text == "Ann wrote a@b.co\n  \nsplit 123-45-6789\nlink\ttabbed\n\n123-45-6789 | b\nwide | wide\ntop | x\ntop | y"
    assert [r.text for r in rows.where("kind = 'paragraph'").orderBy("idx").collect()][1] == "  "
    table = pages.docx_tables(rows).first()
    assert table.data == [["123-45-6789", "b"], ["wide", "wide"], ["top", "x"], ["top", "y"]] and (table.rows, table.cols) == (4, 2)


def test_images(office):
    got = docx.docx_images(office.where("doc_id IN (1, 2)")).orderBy("idx").collect()
    assert [(r.doc_id, r.idx, r.description, r.image_format) for r in got] == [
        (1, 0, "Embedded image rId1", "PNG"), (1, 1, "Embedded image rId3 (extraction failed)", "unknown"),
    ]
    assert bytes(got[1].image_data) == b"" and got[1].extracted_text.startswith("[Image extraction failed")


def test_office_requests_fail_closed(office):
    opts = RedactOptions(remove_pii=True, extract_json=True)
    done = process_docx(office, opts, AS_OF)
    docs = {r.doc_id: r for r in done.documents.collect()}
    assert docs[1].text.startswith("Ann wrote [PII_REMOVED]\n  \nsplit 123-45-6789\n") and "[PII_REMOVED] | b" in docs[1].text
    assert docs[2].text is None and docs[2].error and docs[3].text is None and docs[3].error
    assert docs[4].text == "ok" and docs[5].text == ""
    assert docs[1].output_name == "small.json"
    records = {r.doc_id: json.loads(r.json) for r in done.records.collect()}
    assert set(records) == {1, 4, 5}
    assert records[1]["content"]["tables"][0]["data"][0] == ["[PII_REMOVED]", "b"]
    assert records[1]["content"]["tables"][0]["cols"] == 2
    assert [i["extracted_text"] for i in records[1]["content"]["images"]] == ["", "[OCR skipped: no image data]"]
    assert records[1]["document_metadata"]["file_size"] == len(package())


def test_office_requests_with_a_tagger(office):
    opts = RedactOptions(remove_pii=True, extract_json=True)
    plain = process_docx(office, opts, AS_OF)
    tagger = spans.dictionary_tagger({"ann": "PERSON", "wide": "ORG", "top": "DATE"})
    tagged = process_docx(office, opts, AS_OF, tagger)
    texts = [{r.doc_id: r.text for r in p.documents.collect()} for p in (plain, tagged)]
    expected = {
        i: t and t.replace("Ann", "[PII_REMOVED]").replace("wide", "[PII_REMOVED]") for i, t in texts[0].items()
    }
    assert texts[1] == expected and "[PII_REMOVED] | [PII_REMOVED]\ntop | x" in texts[1][1]
    assert {r.doc_id for r in tagged.records.where("json IS NOT NULL").collect()} == {1, 4, 5}


def test_batch_run(spark):
    data = [("a", 0, 1, "x.txt", b"a@b.co"), ("a", 1, 2, "y.docx", package()), ("a", 2, 3, "z.docx", b"no zip"),
            ("a", 3, 4, "w.csv", b""), ("a", 4, 5, "v.txt", b"\xff"), ("a", 5, 6, "u.pdf", b"%PDF"), ("big", 0, 7, "t.txt", b"x" * 200)]
    uploads = spark.createDataFrame(data, "batch_id string, ord long, doc_id long, filename string, content binary")
    done = run_batch(uploads, RedactOptions(remove_pii=True, extract_json=True), AS_OF)
    assert [r.original_name for r in batch.ordered_results(done.results).collect()] == ["x.txt", "y.docx", "t.txt"]
    record = json.loads(done.results.where("name = 'x.json'").first().content)
    assert record["content"]["text"] == "[PII_REMOVED]" and record["document_metadata"]["file_size"] == 6
    assert {r.file: r.status for r in done.status.where("batch_id = 'a'").collect()} == {
        "x.txt": "Done", "y.docx": "Done", "z.docx": "Error", "w.csv": "Error", "v.txt": "Error", "u.pdf": "Error",
    }
    assert {r.message.split(":")[0] for r in status.error_log(done.messages).collect()} == {
        f"Error processing {n}" for n in ("z.docx", "w.csv", "v.txt", "u.pdf")
    }
    assert batch.processing_summary(done.results).count() == 3
    limited = run_batch(uploads, RedactOptions(remove_pii=True), AS_OF, max_files=1, max_file=100)
    assert [r.original_name for r in batch.ordered_results(limited.results).collect()] == ["x.txt"]
    board = {r.file: r.status for r in limited.status.collect()}
    assert len(board) == 7 and [n for n, s in board.items() if s == "Done"] == ["x.txt"]
    why = {r.original_name: r.error for r in limited.messages.where("error IS NOT NULL").collect()}
    assert why["t.txt"] == "File is larger than the limit" and why["y.docx"] == "More than 1 files in the batch"


def test_office_requests_open_each_file_once(office):
    done = process_docx(office, RedactOptions(anonymize=True, remove_pii=True, extract_json=True, terms=("Ann",)), AS_OF)
    for df in (done.documents, done.records):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_office_text_in_one_row_is_that_of_the_long_rows(office):
    parts = docx.docx_parts(office)
    rows = docx.structure_text(docx.structure_rows(parts))
    texts = {r.doc_id: r.text for r in pages.assemble_docx_text(rows).where("error IS NULL").collect()}
    whole = {r.doc_id: r.text for r in parts.where("error IS NULL").select("doc_id", docx.body_text(F.col("paragraphs"), F.col("tables")).alias("text")).collect()}
    assert whole == {**texts, 5: ""}
    tables = {(r.doc_id, r.table_index): (r.data, r.rows, r.cols) for r in pages.docx_tables(rows).collect()}
    entries = parts.select("doc_id", F.inline(docx.table_entries(F.col("tables"))))
    assert {(r.doc_id, r.table_index): (r.data, r.rows, r.cols) for r in entries.collect()} == tables


def test_batches_process_equal_content_once(spark):
    """Copies of a content, over batches and names of their kind, are hits; metadata and counts tell of them."""
    same, other = package(), package(body=paragraph("Bob a@b.co"))
    data = [("a", 0, 1, "x.txt", b"Ann a@b.co"), ("a", 1, 2, "y.docx", same), ("b", 0, 3, "z.TXT", b"Ann a@b.co"), ("b", 1, 4, "w.Docx", same),
            ("b", 2, 5, "v.docx", other), ("b", 3, 6, "u.docx", b"Ann a@b.co"), ("b", 4, 7, "t.docx", b"Ann a@b.co"), ("c", 0, 8, "s.txt", None), ("c", 1, 9, "no_end", b"x")]
    uploads = spark.createDataFrame(data, "batch_id string, ord long, doc_id long, filename string, content binary")
    opts = RedactOptions(remove_pii=True, extract_json=True, max_images=5)
    done = run_batch(uploads, opts, AS_OF)
    got = {r.original_name: r for r in done.results.collect()}
    assert {n: r.cache_hit for n, r in got.items()} == {"x.txt": False, "y.docx": False, "z.TXT": True, "w.Docx": True, "v.docx": False}
    records = {n: json.loads(r.content) for n, r in got.items()}
    assert records["y.docx"]["content"] == records["w.Docx"]["content"] and records["w.Docx"]["document_metadata"]["filename"] == "w.Docx"
    assert records["v.docx"]["content"]["text"] == "Bob [PII_REMOVED]"
    m = got["w.Docx"].metadata
    assert (m.cache_hit, m.ner_mode, m.throughput_mode, m.timing) == (True, "regex_only", False, {})
    assert (m.ocr.images_processed, m.ocr.images_skipped, m.ocr.max_images_per_doc, m.ocr.enabled) == (1, 1, 5, True)
    assert done.counts.get == {"files": 9, "failed": 4, "copies": 3, "images_processed": 3, "images_skipped": 3}
    why = {r.original_name: r.error for r in done.messages.where("error IS NOT NULL").collect()}
    assert set(why) == {"u.docx", "t.docx", "s.txt", "no_end"} and why["s.txt"] == "The upload has no content"
    quick = run_batch(uploads, RedactOptions(remove_pii=True, extract_json=True, throughput=True), AS_OF).results.where("original_name = 'y.docx'").first()
    assert {i["extracted_text"] for i in json.loads(quick.content)["content"]["images"]} == {patterns.OCR_REASONS["throughput"]}
    assert (quick.metadata.ocr.images_processed, quick.metadata.ocr.images_skipped) == (0, 2)
    assert [r.cache for r in batch.processing_summary(done.results).orderBy("batch_id", "ord").collect()] == ["No", "No", "Yes", "Yes", "No"]


def test_batches_with_a_tagger(spark):
    data = [("a", 0, 1, "x.txt", b"Ann a@b.co"), ("a", 1, 2, "y.docx", package()), ("b", 0, 3, "z.txt", b"Ann a@b.co")]
    uploads = spark.createDataFrame(data, "batch_id string, ord long, doc_id long, filename string, content binary")
    done = run_batch(uploads, RedactOptions(remove_pii=True), AS_OF, spans.dictionary_tagger({"ann": "PERSON"}))
    got = {r.original_name: r for r in done.results.collect()}
    assert bytes(got["x.txt"].content) == bytes(got["z.txt"].content) == b"[PII_REMOVED] [PII_REMOVED]"
    assert bytes(got["y.docx"].content).startswith(b"[PII_REMOVED] wrote [PII_REMOVED]\n")
    assert got["z.txt"].metadata.ner_mode == "spacy_batch"


@pytest.mark.parametrize("opts", [RedactOptions(max_images=2), RedactOptions(), RedactOptions(throughput=True), RedactOptions(ocr_enabled=False)])
def test_the_gate_on_entries_is_the_gate_on_rows(spark, opts):
    rows = [(d, i, None if (d + i) % 3 == 0 else b"x" * (i % 2)) for d in range(4) for i in range(7)]
    images = spark.createDataFrame(rows, "doc_id long, idx int, image_data binary").withColumns({"extracted_text": F.lit("old"), "ocr_applied": F.lit(False)})
    read = spark.createDataFrame([(1, 3, "seen"), (2, 0, "read")], "doc_id long, idx int, extracted_text string")
    by_row = ocr_apply(images, opts, read).select("doc_id", "idx", "extracted_text", "ocr_applied")
    texts = read.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "extracted_text"))).alias("m"))
    listed = images.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "image_data", "extracted_text", "ocr_applied"))).alias("i"))
    by_entry = listed.join(texts, "doc_id", "left").select("doc_id", F.inline(ocr_entries(F.col("i"), opts, F.col("m"))))
    assert sorted(by_row.collect()) == sorted(by_entry.select("doc_id", "idx", "extracted_text", "ocr_applied").collect())


def test_images_of_text_documents_go_through_the_gate(spark):
    docs = spark.createDataFrame([(1, "a.txt", "t")], "doc_id long, filename string, text string")
    images = spark.createDataFrame([(1, i, b"x", "") for i in range(3)], "doc_id long, idx int, image_data binary, extracted_text string")
    read = spark.createDataFrame([(1, 0, "seen")], "doc_id long, idx int, extracted_text string")
    shown = lambda opts: [i["extracted_text"] for i in json.loads(process_documents(docs, opts, AS_OF, images=images, recognised=read).records.first().json)["content"]["images"]]
    assert shown(RedactOptions(extract_json=True, max_images=2)) == ["seen", "", patterns.OCR_REASONS["cap"]]
    assert shown(RedactOptions(extract_json=True, throughput=True))[1:] == [patterns.OCR_REASONS["throughput"]] * 2
    before = images.drop("image_data").withColumn("extracted_text", F.lit("before"))
    record = process_documents(docs, RedactOptions(extract_json=True), AS_OF, images=before).records.first().json
    assert {i["extracted_text"] for i in json.loads(record)["content"]["images"]} == {"before"}


def test_packed_files_leave_a_task_in_slices():
    """A task holds the files of a slice; what was a batch of thousands of rows comes out in its order."""
    texts = [f"line {i} <&>\n\na  b" if i % 3 else "" for i in range(500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "filename": ["f.docx"] * 500, "text": texts})
    slices = list(packing.pack(iter([batch, batch.slice(0, 0)])))
    assert max(s.num_rows for s in slices) <= packing.FILES_PER_SLICE < 500
    table = pa.Table.from_batches(slices)
    assert table.column_names == ["doc_id", "filename", "content"] and table["doc_id"].to_pylist() == list(range(500))
    read = [docx._parts_of(c, ("body",), False) for c in table["content"].to_pylist()]
    lines = [t.split("\n") for t in texts]
    assert [["".join(p) for p in r["paragraphs"]] for r in read] == lines
    assert [[["".join(c) for c in row] for row in r["tables"][0][2]] for r in read] == [[line.split(" ") for line in own[:3]] for own in lines]
    assert [r["tables"][0][1] for r in read] == [max(line.count(" ") + 1 for line in own[:3]) for own in lines]
    uploads = pa.RecordBatch.from_pydict({"doc_id": [1, 2, None], "text": ["é", "x y", "z"], "office": [False, True, None]})
    made = pa.Table.from_batches(packing.pack_uploads(iter([uploads]))).to_pydict()
    assert made["doc_id"] == [1, 2, None] and made["content"] == ["é".encode(), packing.office_file(0, "x y"), b"z"]


def test_properties_of_cells_in_any_place():
    w = docx.W[1:-1]
    run = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cells = (
        f'<w:tc>{run("a")}{run("b")}<w:tcPr/><w:tcPr><w:gridSpan w:val="2"/></w:tcPr></w:tc>',
        f"<w:tc><w:tcPr><w:vMerge/></w:tcPr>{run('own')}</w:tc>",
        f'<w:tc><w:tcPr><w:vMerge w:val="restart"/><w:vMerge/></w:tcPr>{run("c")}</w:tc>',
        "<w:tc/>",
    )
    row = docx.ET.fromstring(f'<w:tr xmlns:w="{w}"><w:trPr/>{"".join(cells)}</w:tr>')
    assert docx._row_pieces(row, [["1"], ["2"], ["above"]]) == [["a", "\n", "b"]] * 2 + [["above"], ["c"], []]
    assert docx._row_pieces(row, []) == [["a", "\n", "b"]] * 2 + [["own"], ["c"], []]

"""Office files as input: Spark reads and spreads the files, each task opens those it was given.

``docx_parts`` opens a file once and gives one row with all that was asked for, so a request needs no
second look and no grouping; the other readers are projections of it to long rows. A file or part that cannot
be read has ``error`` set and no text; nothing of it is passed on unredacted.
"""

from __future__ import annotations

import io
import posixpath
import sys
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veilwork.operators.images import image_format, image_format_column

# Tasks carry the functions below with them; executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values: names inside an office file ---------------------------------------------------
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY_PART = "word/document.xml"
RELATIONS_PART = "word/_rels/document.xml.rels"
_P, _R, _T, _HYPERLINK, _CR, _BR, _TYPE, _NO_BREAK_HYPHEN = (W + n for n in ("p", "r", "t", "hyperlink", "cr", "br", "type", "noBreakHyphen"))
_TC, _TC_PR, _V_MERGE, _GRID_SPAN, _VAL = (W + n for n in ("tc", "tcPr", "vMerge", "gridSpan", "val"))
_TABS = (f"{W}tab", f"{W}ptab")
# --- end of fixed values ------------------------------------------------------------------------

IMAGE_HEAD = 12  # bytes that tell a format
# Rows of a task go out by so many files, or bytes as packed, which open to many times that.
FILES_PER_BATCH, BYTES_PER_BATCH = 128, 1 << 22
_TEXTS = pa.list_(pa.string())
_FRAGMENT = pa.struct([("part", pa.string()), ("seq", pa.int32()), ("text", pa.string()), ("error", pa.string())])
_TABLE = pa.struct([("table_index", pa.int32()), ("n_cols", pa.int32()), ("rows", pa.list_(pa.list_(_TEXTS)))])
_IMAGE = pa.struct([("idx", pa.int32()), ("type", pa.string()), ("description", pa.string()), ("image_data", pa.binary()), ("extracted_text", pa.string())])
# Columns of each part: Spark's type and Arrow's.
_PARTS = {
    "body": {
        "error": ("string", pa.string()),
        "paragraphs": ("array<array<string>>", pa.list_(_TEXTS)),
        "tables": ("array<struct<table_index:int,n_cols:int,rows:array<array<array<string>>>>>", pa.list_(_TABLE)),
    },
    "images": {"images": ("array<struct<idx:int,type:string,description:string,image_data:binary,extracted_text:string>>", pa.list_(_IMAGE))},
    "fragments": {"fragments": ("array<struct<part:string,seq:int,text:string,error:string>>", pa.list_(_FRAGMENT))},
}


def _redactable(name: str) -> bool:
    side = name.startswith(("word/header", "word/footer")) and name.endswith(".xml")
    return name == BODY_PART or side


def _fragments(archive: zipfile.ZipFile) -> Iterator[tuple]:
    for name in filter(_redactable, archive.namelist()):
        try:
            texts = [t.text for t in ET.fromstring(archive.read(name)).iter(f"{W}t") if t.text]
        except Exception as exc:
            yield name, None, None, f"Cannot read {name}: {exc}"
            continue
        for seq, text in enumerate(texts):
            yield name, seq, text, None


def _paragraph_pieces(paragraph: ET.Element) -> list[str]:
    """Text pieces of a paragraph: each text run alone, and the characters that stand for marks."""
    pieces = []
    for child in paragraph:
        runs = (child,) if child.tag == _R else child.findall(_R) if child.tag == _HYPERLINK else ()
        for run in runs:
            for item in run:
                tag = item.tag
                if tag == _T:
                    pieces.append(item.text or "")
                elif tag in _TABS:
                    pieces.append("\t")
                elif tag == _CR or (tag == _BR and item.get(_TYPE, "textWrapping") == "textWrapping"):
                    pieces.append("\n")
                elif tag == _NO_BREAK_HYPHEN:
                    pieces.append("-")
    return pieces


def _row_pieces(row: ET.Element, above: list[list[str]]) -> list[list[str]]:
    """Cells on the table's grid: a wide cell is repeated, a continued one takes the text above."""
    cells: list[list[str]] = []
    for cell in row:
        if cell.tag != _TC:
            continue
        merge = span = None
        paragraphs = []
        for child in cell:  # one look, as tables have many cells
            if child.tag == _P:
                paragraphs.append(child)
            elif child.tag == _TC_PR:
                merge = child.find(_V_MERGE) if merge is None else merge
                span = child.find(_GRID_SPAN) if span is None else span
        at = len(cells)
        if merge is not None and merge.get(_VAL, "continue") == "continue" and at < len(above):
            pieces = above[at]
        else:
            pieces = []
            for n, paragraph in enumerate(paragraphs):
                pieces += (["\n"] if n else []) + _paragraph_pieces(paragraph)
        cells += [pieces] * (int(span.get(_VAL)) if span is not None else 1)
    return cells


def _body(archive: zipfile.ZipFile) -> tuple[list, list]:
    """Pieces of the paragraphs, and tables as (index, width of the grid, pieces of the cells of each row)."""
    body = ET.fromstring(archive.read(BODY_PART)).find(f"{W}body")
    paragraphs = [_paragraph_pieces(p) for p in body.findall(f"{W}p")]
    tables = []
    for idx, table in enumerate(body.findall(f"{W}tbl")):
        rows: list[list[list[str]]] = []
        for row in table.findall(f"{W}tr"):
            rows.append(_row_pieces(row, rows[-1] if rows else []))
        tables.append((idx, len(table.findall(f"{W}tblGrid/{W}gridCol")), rows))
    return paragraphs, tables


def _images(archive: zipfile.ZipFile, payload: bool) -> Iterator[tuple]:
    if RELATIONS_PART not in archive.namelist():
        return
    relations = [r for r in ET.fromstring(archive.read(RELATIONS_PART)) if "image" in r.get("Target", "")]
    for idx, relation in enumerate(relations):
        name, failure = f"Embedded image {relation.get('Id')}", ""
        try:
            if relation.get("TargetMode") == "External":
                raise KeyError("image is not part of the file")
            data = archive.read(posixpath.normpath(posixpath.join("word", relation.get("Target"))).lstrip("/"))
        except Exception as exc:
            name, data, failure = f"{name} (extraction failed)", b"", f"[Image extraction failed: {exc}]"
        yield idx, "docx_embedded_image", name, data if payload else data[:IMAGE_HEAD], failure


def _parts_of(content: bytes, want: Sequence[str], payload: bool) -> dict:
    """What was asked for of one file; each part fails alone."""
    out = {name: None for part in want for name in _PARTS[part]}
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except Exception as exc:
        why = f"Cannot read office file: {exc}"
        return {**out, **({"error": why} if "body" in want else {}), **({"fragments": [(None, None, None, why)]} if "fragments" in want else {})}
    with archive:
        if "body" in want:
            try:
                out["paragraphs"], out["tables"] = _body(archive)
            except Exception as exc:
                out["error"] = f"Cannot read office file: {exc}"
        if "images" in want:
            try:
                out["images"] = list(_images(archive, payload))
            except Exception:
                out["images"] = []  # the file's error comes with its text
        if "fragments" in want:
            try:
                out["fragments"] = list(_fragments(archive))
            except Exception as exc:
                out["fragments"] = [(None, None, None, f"Cannot read office file: {exc}")]
    return out


def _nested(value, kind: pa.DataType):
    """Tuples as the structs of an Arrow type."""
    if value is None or not pa.types.is_list(kind) or not pa.types.is_struct(kind.value_type):
        return value
    names = [f.name for f in kind.value_type]
    return [dict(zip(names, item)) for item in value]


def docx_parts(files: DataFrame, want: Sequence[str] = ("body", "images"), keep: Sequence[str] = ("doc_id",), payload: bool = True) -> DataFrame:
    """One row for each file, opened once: the columns to keep, and those of the parts in ``want``.

    ``body`` gives error, paragraphs and tables, in pieces that are still to be redacted; ``images`` those the body refers to (of
    their bytes only the first few without ``payload``); ``fragments`` every non-empty text run of body, headers and footers.
    """
    columns = {name: kinds for part in want for name, kinds in _PARTS[part].items()}
    given = files.select(*keep, "content")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, begin, size, rows = batch.column("content"), 0, 0, []
            for i in range(len(contents)):
                content = contents[i].as_py()
                rows.append(_parts_of(content, want, payload))
                size += len(content or b"")
                if len(rows) == FILES_PER_BATCH or size >= BYTES_PER_BATCH or i + 1 == len(contents):
                    made = [pa.array([_nested(r[name], kind) for r in rows], kind) for name, (_, kind) in columns.items()]
                    kept = [batch.column(c).slice(begin, len(rows)) for c in keep]
                    yield pa.RecordBatch.from_arrays(kept + made, names=[*keep, *columns])
                    begin, size, rows = i + 1, 0, []

    made = StructType.fromDDL(", ".join(f"{name} {kind}" for name, (kind, _) in columns.items()))
    return given.mapInArrow(task, StructType(given.drop("content").schema.fields + made.fields))


def docx_fragments(files: DataFrame) -> DataFrame:
    """(doc_id, part, seq, text, error): every non-empty text run of body, headers and footers."""
    return docx_parts(files, ("fragments",)).select("doc_id", F.inline("fragments"))


def docx_structures(files: DataFrame) -> DataFrame:
    """Paragraphs and table rows of the body, in pieces that are still to be redacted.

    ``pieces`` has one list per cell (one for a paragraph); see ``structure_text``.
    """
    return structure_rows(docx_parts(files, ("body",)))


def structure_rows(parts: DataFrame) -> DataFrame:
    """(doc_id, kind, idx, row_idx, pieces, n_cols, error): a row for each paragraph, table row and unreadable file."""
    none = lambda kind: F.lit(None).cast(kind)

    def row(kind, idx, row_idx, pieces, n_cols, error) -> Column:
        named = {"kind": F.lit(kind), "idx": idx.cast("int"), "row_idx": row_idx.cast("int"), "pieces": pieces, "n_cols": n_cols.cast("int"), "error": error}
        return F.struct(*[c.alias(n) for n, c in named.items()])

    paragraphs = F.transform("paragraphs", lambda p, i: row("paragraph", i, F.lit(0), F.array(p), none("int"), none("string")))
    of_table = lambda t: F.transform(t["rows"], lambda r, i: row("table", t["table_index"], i, r, t["n_cols"], none("string")))
    rows = F.concat(paragraphs, F.flatten(F.transform("tables", of_table)))
    failed = F.array(row("error", none("int"), none("int"), none("array<array<string>>"), none("int"), F.col("error")))
    return parts.select("doc_id", F.inline(F.when(F.col("error").isNotNull(), failed).otherwise(rows)))


def _cell_text(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def body_text(paragraphs: Column, tables: Column) -> Column:
    """Text of an office document: paragraphs, then every table row with its cells joined by ' | '."""
    line = lambda row: F.concat_ws(" | ", F.transform(row, _cell_text))
    rows = F.flatten(F.transform(tables, lambda t: F.transform(t["rows"], line)))
    return F.array_join(F.concat(F.transform(paragraphs, _cell_text), rows), "\n")


def table_entries(tables: Column) -> Column:
    """Tables as a record holds them; tables without rows are left out."""
    def entry(t: Column) -> Column:
        data = F.transform(t["rows"], lambda row: F.transform(row, _cell_text))
        fields = [t["table_index"].alias("table_index"), data.alias("data"), F.size(t["rows"]).alias("rows"), t["n_cols"].alias("cols")]
        return F.struct(*fields, F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("extraction_method"))

    return F.transform(F.filter(tables, lambda t: F.size(t["rows"]) > 0), entry)


def map_pieces(tables: Column, change) -> Column:
    """Tables with every piece of their cells changed."""
    rows = lambda t: F.transform(t["rows"], lambda row: F.transform(row, lambda cell: F.transform(cell, change)))
    return F.transform(tables, lambda t: F.struct(t["table_index"].alias("table_index"), t["n_cols"].alias("n_cols"), rows(t).alias("rows")))


def structure_text(structures: DataFrame) -> DataFrame:
    """Replace ``pieces`` by ``text`` (of a paragraph) and ``cells`` (of a table row)."""
    cells = F.transform("pieces", lambda p: F.array_join(p, ""))
    table = F.col("kind") == "table"
    return (
        structures.withColumn("cells", F.when(table, cells))
        .withColumn("text", F.when(~table, F.get(cells, F.lit(0))))
        .drop("pieces")
    )


def with_format(images: Column) -> Column:
    """Image entries with the format that their first bytes name."""
    return F.transform(images, lambda i: i.withField("image_format", image_format_column(i["image_data"])))


def docx_images(files: DataFrame) -> DataFrame:
    """Images the body refers to; one that cannot be taken out is a row without bytes.

    A file that cannot be opened at all gives no image rows here; its error comes with its text.
    """
    rows = docx_parts(files, ("images",)).select("doc_id", F.inline("images"))
    return image_format(rows.withColumn("ocr_applied", F.lit(False)))

"""Pack a text as a small office file, so that office readers can be run over given tables."""

from __future__ import annotations

import io
import sys
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
PIXEL = bytes.fromhex("89504E470D0A1A0A") + b"pixel"


_BEGIN, _END = '<w:p><w:r><w:t xml:space="preserve">', "</w:t></w:r></w:p>"
# Output rows of a task go out by so many files, so a task holds the files of one slice and not of its whole batch.
FILES_PER_SLICE = 128


def _paragraphs(text: str) -> str:
    """A paragraph for each line of an escaped text."""
    return _BEGIN + text.replace("\n", _END + _BEGIN) + _END


def _table(lines: list[str]) -> str:
    """A row for each escaped line, a cell for each of its words."""
    cols = "<w:gridCol/>" * (max(line.count(" ") for line in lines) + 1)
    between = f"{_END}</w:tc><w:tc>{_BEGIN}"
    body = "".join(f"<w:tr><w:tc>{_BEGIN}{line.replace(' ', between)}{_END}</w:tc></w:tr>" for line in lines)
    return f"<w:tbl><w:tblGrid>{cols}</w:tblGrid>{body}</w:tbl>"


def office_file(doc_id: int, text: str) -> bytes:
    escaped = escape(text)
    body = _paragraphs(escaped) + _table(escaped.split("\n", 3)[:3])
    relations = (
        '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
        '<Relationship Id="rId1" Type="t" Target="styles.xml"/>'
        '<Relationship Id="rId2" Type="t" Target="media/image1.png"/>'
        '<Relationship Id="rId3" Type="t" Target="media/image2.png"/></Relationships>'
    )
    members = {
        "word/document.xml": f"<w:document {_NS}><w:body>{body}</w:body></w:document>",
        "word/header1.xml": f"<w:hdr {_NS}>{_paragraphs(f'File {doc_id} call 555-123-4567')}</w:hdr>",
        "word/footnotes.xml": f"<w:footnotes {_NS}>{_paragraphs('note')}</w:footnotes>",
        "word/_rels/document.xml.rels": relations,
        "word/media/image1.png": PIXEL + str(doc_id).encode(),
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in members.items():
            archive.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED)  # no time of writing: equal texts, equal files
    return buffer.getvalue()


def _packed(batches: Iterator[pa.RecordBatch], used: list[str], content: Callable[..., bytes]) -> Iterator[pa.RecordBatch]:
    """Batches with ``content`` of some columns in their place."""
    for batch in batches:
        for begin in range(0, batch.num_rows, FILES_PER_SLICE):
            part = batch.slice(begin, FILES_PER_SLICE)
            made = pa.array([content(*row) for row in zip(*(part.column(c).to_pylist() for c in used))], pa.binary())
            yield part.drop_columns([c for c in used if c != "doc_id"]).append_column("content", made)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: (doc_id, filename, text) rows to (doc_id, filename, content)."""
    return _packed(batches, ["doc_id", "text"], office_file)


def pack_uploads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: bytes of an upload, packed as an office file where ``office`` says so."""
    return _packed(batches, ["text", "office"], lambda text, office: office_file(0, text) if office else text.encode())

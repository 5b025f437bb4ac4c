"""Language ID by unigrams over pieces of a fixed public vocabulary, with all segmentations summed.

1. Texts are lower-cased and cut into words, each with a space in front. Training documents give, for each
   language, how often each vocabulary piece occurs in their words, at any place. That makes the piece
   probabilities, smoothed; single bytes have a small probability of their own, so that every word has a
   segmentation.
2. A text's probability in a language is the product over its words; a word's is the sum over all its
   segmentations into pieces, by the forward algorithm. Distinct words of a chunk are scored once, words of
   equal length together and for all languages at once.
3. The prediction is the language of highest probability, the score its share among all.

Learning reads text and lang only, of documents outside the held-out fold.

Defined cases: null texts and texts without a letter are ``und`` with score 0, and so is everything if nothing can
be learned; null lang and null ids teach nothing; equal probabilities go to the smaller lang; very long words are
scored whole, with rescaling; other columns are passed on, but ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilwork.llm.tables import held_out
from veilwork.llm.tokens import public_path
from veilwork.llm.words import Words, chunks, mix

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
SMOOTHING = 0.1
BYTE = 1e-8
CHUNK = 1 << 21
SLOT_BITS = 18
RESCALE = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Pieces:
    """Vocabulary pieces by hash: a key lies in one of two slots."""

    keys: np.ndarray
    ids: np.ndarray
    longest: int
    size: int

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece for each key, or -1."""
        mixed = mix(keys)
        one = (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        found = np.where(self.keys[one] == keys, self.ids[one], -1)
        two = (mixed & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)
        return np.where(self.keys[two] == keys, self.ids[two], found)


def read_pieces(path: str) -> list[bytes]:
    """Pieces as bytes, a leading space for the mark of a word's start; control and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    lower = {model.id_to_piece(i).replace("▁", " ").lower().encode() for i in own}
    return sorted(p for p in lower if p.strip() and b" " not in p[1:])


def build_pieces(pieces: list[bytes]) -> Pieces:
    keys, ids = np.zeros(1 << SLOT_BITS, np.uint64), np.full(1 << SLOT_BITS, -1, np.int32)
    hashed = np.zeros(len(pieces), np.uint64)
    for i, piece in enumerate(pieces):
        key = 0
        for byte in piece:
            key = (key * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
        hashed[i] = key
    mixed = mix(hashed)
    slots = [(mixed >> np.uint64(64 - SLOT_BITS)).tolist(), (mixed & np.uint64((1 << SLOT_BITS) - 1)).tolist()]
    at = {}
    for i in range(len(pieces)):  # whoever holds the slot moves to its other one
        moving, side = i, 0
        for _ in range(500):
            slot = slots[side][moving]
            moving, at[slot] = at.get(slot), moving
            if moving is None:
                break
            side = int(slots[0][moving] == slot)
        else:
            raise ValueError("too many pieces for the table")
    for slot, i in at.items():
        keys[slot], ids[slot] = hashed[i], i
    return Pieces(keys, ids, max(map(len, pieces)), len(pieces))


class Distinct:
    """Distinct words of some texts, each with a space in front, by length."""

    def __init__(self, texts: list[bytes]):
        self.words = Words([b"", *texts])  # so that every word has a byte in front
        self.first = self.words.first[1:]
        _, at, self.which = np.unique(self.words.hashes(), return_index=True, return_inverse=True)
        self.n = len(at)
        self.start, self.size = self.words.start[at] - 1, self.words.end[at] - self.words.start[at] + 1
        self.order = np.argsort(self.size, kind="stable")
        self.buf = self.words.buf.copy()
        self.buf[self.start] = 32

    def groups(self, pieces: Pieces) -> Iterator[tuple[np.ndarray, int, list[tuple[int, int, np.ndarray, np.ndarray]]]]:
        """Words of one length, that length, and the pieces found in them: (from, to, rows, piece numbers)."""
        sizes = self.size[self.order]
        for own in np.split(self.order, np.flatnonzero(np.diff(sizes)) + 1) if self.n else ():
            size = int(self.size[own[0]])
            letters = self.buf[self.start[own][:, None] + np.arange(size)].T.astype(np.uint64) + np.uint64(1)
            found = []
            for a in range(size):
                keys = np.zeros(len(own), np.uint64)
                for b in range(a, min(size, a + pieces.longest)):
                    keys = keys * _BASE + letters[b]
                    ids = pieces.find(keys)
                    rows = np.flatnonzero(ids >= 0)
                    if len(rows):
                        found.append((a, b + 1, rows, ids[rows]))
            yield own, size, found


def word_scores(distinct: Distinct, pieces: Pieces, chances: np.ndarray) -> np.ndarray:
    """Log probability of each distinct word in each language: all segmentations summed, from left to right."""
    out = np.zeros((distinct.n, chances.shape[1]))
    for own, size, found in distinct.groups(pieces):
        # sums[p]: probability of the word's first p bytes; later ones are filled from earlier ones.
        sums = np.zeros((size + 1, len(own), chances.shape[1]))
        sums[0] = 1
        scale, step = np.zeros((len(own), chances.shape[1])), 0
        for a in range(size):
            if size > 3 * RESCALE and a and a % RESCALE == 0:
                top = sums[a : a + pieces.longest + 1].max(axis=0)
                sums[a : a + pieces.longest + 1] /= top
                scale += np.log(top)
            sums[a + 1] += sums[a] * BYTE
            while step < len(found) and found[step][0] == a:
                _, b, rows, ids = found[step]
                sums[b, rows] += sums[a, rows] * chances[ids]
                step += 1
        out[own] = np.log(sums[size]) + scale
    return out


def _lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [t.lower() if t else "" for t in batch.column("text").to_pylist()]
    return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))


def _counts(pieces, langs: list[str]):
    """Task: occurrences of pieces in the words of each language."""
    number = {lang: i for i, lang in enumerate(langs)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((pieces.value.size, len(langs)))
        for batch, texts in chunks(map(_lowered, batches), CHUNK):
            distinct = Distinct(texts)
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            by_word = np.repeat(lang, np.diff(distinct.first))
            times = np.bincount(distinct.which * len(langs) + by_word, minlength=distinct.n * len(langs)).reshape(-1, len(langs))
            ids, words = [], []
            for own, _, found in distinct.groups(pieces.value):
                for _, _, rows, numbers in found:
                    ids.append(numbers)
                    words.append(own[rows])
            if ids:
                ids, words = np.concatenate(ids), np.concatenate(words)
                for k in range(len(langs)):
                    total[:, k] += np.bincount(ids, weights=times[words, k], minlength=pieces.value.size)
        piece, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(k), pa.array(total[piece, k].astype(np.int64))], names=["piece", "lang", "n"])

    return task


@dataclass
class Model:
    pieces: Pieces
    langs: list[str]
    chances: np.ndarray


def learn(docs: DataFrame, path: str | None = None) -> Model:
    """The table of counts has a cell for each piece and language, whatever the number of documents."""
    spark = docs.sparkSession
    pieces = build_pieces(read_pieces(path or public_path(VOCABULARY)))
    train = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").where(~held_out(4, 2)).select("lang", "text")
    langs = sorted(r["lang"] for r in train.select("lang").distinct().collect())
    counts = np.full((pieces.size, len(langs)), SMOOTHING)
    if langs:
        parts = train.mapInArrow(_counts(spark.sparkContext.broadcast(pieces), langs), "piece long, lang long, n long")
        sums = parts.groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts[sums["piece"].to_numpy(np.int64), sums["lang"].to_numpy(np.int64)] += sums["n"].to_numpy(float)
    return Model(pieces, langs, counts / counts.sum(axis=0))


def _predict(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = [*model.value.langs, UNKNOWN]
        for batch, texts in chunks(map(_lowered, batches), CHUNK):
            distinct = Distinct(texts)
            by_word = word_scores(distinct, model.value.pieces, model.value.chances)[distinct.which]
            sums = np.concatenate([np.zeros((1, by_word.shape[1])), np.cumsum(by_word, axis=0)])[distinct.first]
            logs = sums[1:] - sums[:-1]
            best = logs.argmax(axis=1)
            score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            letters = np.array(batch.column("_letters").to_pylist(), bool)
            names = [langs[k if has else -1] for k, has in zip(best, letters)]
            out = batch.drop_columns(["text", "_letters"])
            yield out.append_column("_lang", pa.array(names, pa.string())).append_column("_score", pa.array(np.where(letters, score, 0.0)))

    return task


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, ``lang_pred`` and ``score``; of ``docs`` only the text is looked at."""
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    if not model.langs:
        return docs.select(*own, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    rows = docs.select(F.struct(*own).alias("_row"), "text", letters)
    schema = T.StructType([rows.schema["_row"], T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])
    out = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in own], F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def identify(docs: DataFrame, path: str | None = None) -> DataFrame:
    return predict(docs, learn(docs, path))


def digest(docs: DataFrame) -> DataFrame:
    predicted = predict(docs.select("doc_id", "text"), learn(docs))
    return predicted.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")

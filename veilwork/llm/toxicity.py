"""Toxicity: a learned lexicon as a trie, met by Levenshtein automata, with scores for the words around a hit.

1. Labelled documents outside the held-out fold, at most ``max_labelled`` of them by hash of their id, give for
   each word the toxic and the clean documents that hold it. Words and stems (shared beginnings of several
   words) that are far more common in toxic ones are the lexicon, all of them. Words under a stem stay in it, so
   that their misspellings are found too.
2. The trie of the lexicon is run against the Levenshtein automaton of every word at once: states of both are
   paired and made deterministic, so that a word is one walk over a table. Terms of ``FUZZY_FROM`` letters may
   differ by one letter after the first; stems must fit. Words of clean documents that would be caught by such
   a difference are exceptions.
3. Each hit has a window of ``WINDOW`` words on either side. Quotation marks count against abuse; what other
   words there say is learned from hits in toxic and clean documents. Windows weigh the hits.
4. Logistic regression over the weighed hits of a document gives its score.

Learning reads labels and texts only. Every text is scored whole.

Defined cases: null and empty texts have no hits and get the score that goes with that; rows without a label, or
with a null id, teach nothing; a document with several labels is toxic if one says so; without labels the lexicon
is empty and every score is the same; equal rows get equal scores; other columns are passed on, but a column
``score`` or ``predicted`` is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.tables import held_out, written

MAX_LABELLED = 40_000
LEAST_DOCS = 4
LEAST_RATIO = 20.0
STEMS = (4, 5, 6)
FUZZY_FROM = 5
WINDOW = 4
THRESHOLD = 0.3
LEAST_HITS = 20  # hits in toxic and in clean documents below which their contexts say nothing
QUOTE_WEIGHT = -1.0
QUOTES = "\"“”„«»"
CHUNK_CHARS = 1 << 20
_SPACE, _MARK, _OTHER = 0, 1, 2


@dataclass
class Automaton:
    """Deterministic table over classes of characters; state 0 is dead, 1 is the start."""

    classes: np.ndarray
    moves: np.ndarray
    accepts: np.ndarray  # by state: 0 no term, 1 a term or stem as listed, 2 a term but for one letter


@dataclass
class Model:
    automaton: Automaton
    exceptions: frozenset[str] = frozenset()
    contexts: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray | None = None


def build_automaton(words: list[str], stems: list[str], fuzzy_from: int = FUZZY_FROM) -> Automaton:
    """Pairs of trie node and differences so far, as sets, are the states of the table."""
    children: list[dict[str, int]] = [{}]
    allowed, ends = [0], [-1]  # differences that some term below a node may have, and that the term ending there may have
    whole: set[int] = set()  # nodes where a stem ends
    for term, kind in [(w, "word") for w in words] + [(s, "stem") for s in stems]:
        most = int(kind == "word" and len(term) >= fuzzy_from)
        node = 0
        for letter in term:
            if letter not in children[node]:
                children[node][letter] = len(children)
                children.append({})
                allowed.append(0)
                ends.append(-1)
            node = children[node][letter]
            allowed[node] = max(allowed[node], most)
        ends[node] = max(ends[node], most)
        if kind == "stem":
            whole.add(node)
    letters = sorted({letter for node in children for letter in node})
    number = {letter: _OTHER + 1 + i for i, letter in enumerate(letters)}

    classes = np.full(0x110000, _OTHER, np.uint16)
    for code in range(0x3000):
        char = chr(code)
        if char.lower() in number:
            classes[code] = number[char.lower()]
        elif code in (9, 10, 11, 12, 13, 32):
            classes[code] = _SPACE
        elif not char.isalnum():
            classes[code] = _MARK
    for letter in letters:
        classes[ord(letter)] = number[letter]

    def closed(pairs: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """Letters of the term that the word leaves out; the first one is never left out."""
        for node, wrong in list(pairs):
            if node and wrong == 0:
                pairs.update((child, 1) for child in children[node].values() if allowed[child])
        return frozenset(pairs)

    start = frozenset({(0, 0)})
    states, todo, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
    def number_of(target: frozenset[tuple[int, int]]) -> int:
        if target not in states:
            states[target] = len(todo)
            todo.append(target)
        return states[target]

    for state in todo:
        row = np.zeros(_OTHER + 1 + len(letters), np.int32)
        if any(wrong == 0 and node in whole for node, wrong in state):
            row[_MARK:] = states[state]
        else:
            wrongly: set[tuple[int, int]] = set()  # after any letter
            for node, wrong in state:
                if node and wrong == 0:
                    wrongly.update((child, 1) for child in children[node].values() if allowed[child])
                    if allowed[node]:
                        wrongly.add((node, 1))
            row[_MARK:] = number_of(closed(set(wrongly)))
            for letter in {letter for node, _ in state for letter in children[node]}:
                after = {(children[node][letter], wrong) for node, wrong in state if letter in children[node]}
                row[number[letter]] = number_of(closed(after | wrongly))
        rows.append(row)
    accepts = np.zeros(len(todo), np.uint8)
    for state, at in states.items():
        for node, wrong in state:
            if wrong <= ends[node]:
                accepts[at] = 1 if wrong == 0 or accepts[at] == 1 else 2
    return Automaton(classes, np.stack(rows), accepts)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    yield from _runs(batch.column("text").to_pylist())


def _runs(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of about CHUNK_CHARS characters: the first row of each, and its texts; null is empty."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        texts[i] = text or ""
        if i > begin and size + len(texts[i]) > CHUNK_CHARS:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(texts[i])
    if begin < len(texts):
        yield begin, texts[begin:]


@dataclass
class Hits:
    """Words that the automaton accepts, by text, and where the words of the texts are."""

    doc: np.ndarray
    word: np.ndarray
    kind: np.ndarray
    n_words: np.ndarray
    first: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def text(self, texts: list[str], doc: int, word: int) -> str:
        return texts[doc][self.start[word] - self.at[doc] : self.end[word] - self.at[doc]].lower()


def find_hits(texts: list[str], automaton: Automaton) -> Hits:
    codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    cls = automaton.classes[codes]
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    edge = np.flatnonzero(np.diff(cls != _SPACE, prepend=False))
    start, end = edge[0::2].copy(), edge[1::2].copy()
    first = np.searchsorted(start, at)
    for _ in range(3):  # marks around a word; more than three make it a word of its own kind
        start += (cls[start] == _MARK) & (start < end - 1)
        end -= (cls[end - 1] == _MARK) & (start < end - 1)
    alive = np.flatnonzero(cls[start] > _OTHER)
    state, offset, done, kinds = np.ones(len(alive), np.int32), 0, [], []
    while len(alive):
        state = automaton.moves[state, cls[start[alive] + offset]]
        offset += 1
        over = end[alive] - start[alive] == offset
        done.append(alive[over])
        kinds.append(automaton.accepts[state[over]])
        keep = ~over & (state > 0)
        alive, state = alive[keep], state[keep]
    word, kind = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done, kinds))
    word, kind = word[kind > 0], kind[kind > 0]
    order = np.argsort(word)
    word, kind = word[order], kind[order]
    return Hits(np.searchsorted(first, word, side="right") - 1, word, kind, np.diff(first), first, at, start, end)


def _context(hits: Hits, texts: list[str], k: int) -> tuple[list[str], bool]:
    """Words around hit k, and whether there is a quotation mark at or among them."""
    doc, word = int(hits.doc[k]), int(hits.word[k])
    low, high = max(word - WINDOW, hits.first[doc]), min(word + WINDOW + 1, hits.first[doc + 1])
    around = [hits.text(texts, doc, w) for w in range(low, high) if w != word]
    begin, end = hits.start[low] - hits.at[doc], hits.end[high - 1] - hits.at[doc]
    return around, any(q in texts[doc][max(0, begin - 2) : end + 2] for q in QUOTES)


def features(texts: list[str], model: Model) -> np.ndarray:
    """By text: weighed hits as listed, weighed hits but for a letter, quoted hits (all as log(1 + x)), their density."""
    hits = find_hits(texts, model.automaton)
    sums = np.zeros((3, len(texts)))
    for k in range(len(hits.word)):
        doc = int(hits.doc[k])
        if hits.kind[k] == 2 and hits.text(texts, doc, int(hits.word[k])) in model.exceptions:
            continue
        around, quoted = _context(hits, texts, k)
        told = sum(model.contexts.get(w, 0.0) for w in around) + QUOTE_WEIGHT * quoted
        sums[hits.kind[k] - 1, doc] += 1 / (1 + math.exp(-max(-30.0, min(30.0, 2 + told))))
        sums[2, doc] += quoted
    density = 10 * np.minimum(1, (sums[0] + sums[1]) / np.maximum(1, hits.n_words))
    return np.column_stack([np.log1p(sums[0]), np.log1p(sums[1]), np.log1p(sums[2]), density])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: documents of a batch that hold each word, toxic and clean."""
    empty = build_automaton([], [])
    for batch in batches:
        toxic, counts = batch.column("toxic").to_pylist(), ({}, {})
        for begin, texts in _texts(batch):
            hits = find_hits(texts, empty)
            for d in range(len(texts)):
                own = counts[toxic[begin + d]]
                for word in {hits.text(texts, d, w) for w in range(hits.first[d], hits.first[d + 1])}:
                    own[word] = own.get(word, 0) + 1
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({
            "word": pa.array(words, pa.string()), "clean": pa.array([counts[0].get(w, 0) for w in words], pa.int64()),
            "toxic": pa.array([counts[1].get(w, 0) for w in words], pa.int64()),
        })


def _context_counts(model):
    """Task: hits that have each word in their window, in toxic and in clean documents; null stands for all hits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, words, labels = batch.column("toxic").to_pylist(), [], []
            for begin, texts in _texts(batch):
                hits = find_hits(texts, model.value.automaton)
                for k in range(len(hits.word)):
                    around = [None, *set(_context(hits, texts, k)[0])]
                    words += around
                    labels += [toxic[begin + int(hits.doc[k])]] * len(around)
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "label": pa.array(labels, pa.int32())})

    return task


def _features(model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _texts(batch):
                x = features(texts, model.value)
                yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic").slice(begin, len(texts)), **{f"x{i}": x[:, i] for i in range(x.shape[1])}})

    return task


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.1) / (len(y) - y.sum() + 0.9))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def lexicon(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[list[str], list[str]]:
    """Words and stems from (word, toxic, clean): those far more common in toxic documents. The labelled sample bounds them."""
    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    telling = (F.col("toxic") >= LEAST_DOCS) & (odds >= LEAST_RATIO)
    # Short words are letters only: a mark on its own is no term.
    words = counts.where(telling & ((F.length("word") >= min(STEMS)) | F.col("word").rlike(r"^\p{L}+$")))
    cut = F.explode(F.array(*map(F.lit, STEMS))).alias("letters")
    stems = (
        counts.select("*", cut).where("length(word) > letters").select(F.expr("substring(word, 1, letters)").alias("word"), "toxic", "clean")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("words"))
        .where(telling & (F.col("words") >= 3) & (F.col("toxic") >= 2 * LEAST_DOCS))
    )
    kept: list[str] = []
    for stem in sorted((r["word"] for r in stems.collect()), key=lambda s: (len(s), s)):
        if not any(stem.startswith(k) for k in kept):
            kept.append(stem)
    return sorted(r["word"] for r in words.collect()), kept


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    spark = docs.sparkSession
    given = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(4, 2))
    given = given.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    given = written(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labels")  # max_labelled small rows
    train = docs.select("doc_id", "text").join(F.broadcast(given), "doc_id").select("toxic", "text")
    n_toxic, n = given.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()

    counts = train.mapInArrow(_word_counts, "word string, clean long, toxic long")
    counts = written(counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")
    words, stems = lexicon(counts, n_toxic, n - n_toxic)
    model = Model(build_automaton(words, stems))
    model.exceptions = _exceptions(counts, words, model, n_toxic, n - n_toxic)

    shared = spark.sparkContext.broadcast(model)
    seen = train.mapInArrow(_context_counts(shared), "word string, label int").groupBy("word").agg(
        F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")
    )
    model.contexts = _context_weights({r["word"]: (r["toxic"], r["clean"]) for r in seen.collect()})  # words of max_labelled rows

    shared = spark.sparkContext.broadcast(model)
    rows = train.mapInArrow(_features(shared), "toxic int, x0 double, x1 double, x2 double, x3 double").toPandas()  # max_labelled rows
    model.weights = fit(rows[["x0", "x1", "x2", "x3"]].to_numpy(), rows["toxic"].to_numpy())
    return model


def _exceptions(counts: DataFrame, words: list[str], model: Model, n_toxic: int, n_clean: int) -> frozenset[str]:
    """Words a letter off a term that clean documents use: not toxic by their own counts."""
    starts = sorted({w[0] for w in words})
    if not starts:
        return frozenset()
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("word").to_pylist()
            hits = find_hits(own, shared.value.automaton) if own else None
            yield batch.take(pa.array(hits.doc[hits.kind == 2])) if own else batch

    odds = ((F.col("toxic") + 0.5) / (n_toxic + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    clean = counts.where("clean > 0").where(F.substring("word", 1, 1).isin(starts)).where(odds < LEAST_RATIO)
    near_words = clean.select("word", "clean").mapInArrow(near, "word string, clean long")
    return frozenset(r["word"] for r in near_words.collect())  # words of max_labelled rows


def _context_weights(counts: dict[str | None, tuple[int, int]]) -> dict[str, float]:
    """Log odds of a hit being abuse given a word in its window, drawn to 0 where little was seen."""
    toxic, clean = counts.get(None, (0, 0))
    if min(toxic, clean) < LEAST_HITS:
        return {}
    share = toxic / (toxic + clean)
    out = {}
    for word, (t, c) in counts.items():
        if word is not None:
            expect_t, expect_c = (t + c) * share, (t + c) * (1 - share)
            out[word] = max(-2.0, min(2.0, math.log((t + 5) / (expect_t + 5)) - math.log((c + 5) / (expect_c + 5))))
    return out


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """(_row, _score): rows stay with Spark; a task sends each text once and gets numbers back."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(text: pd.Series) -> pd.Series:
        parts = [features(texts, sent.value) for _, texts in _runs(text.tolist())]
        x = np.concatenate(parts) if parts else np.zeros((0, 4))
        w = sent.value.weights
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))

    return docs.select(F.struct(*docs.columns).alias("_row"), scores(F.coalesce("text", F.lit(""))).alias("_score"))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs``, ``score`` and ``predicted``."""
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    out = _scored(docs.select(*own), model)
    return out.select(*[F.col("_row")[c].alias(c) for c in own], F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, as they are, that score below the threshold."""
    return _scored(docs, learn(docs, labels)).where(F.col("_score") < threshold).select("_row.*")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, learn(docs, labels))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs.select("doc_id", "text"), labels).select("doc_id", held_out(4, 2).alias("held_out"), "score", "predicted")

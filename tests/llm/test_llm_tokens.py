"""Packing, token files, top-k search and the pipeline: exact round trips and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_fixtures import docs, empty, rows
from tokenizers import Tokenizer

from corpus_pipeline import STAGES, run
from veilwork.llm import ball_tree, packing, tokens, wavelet
from veilwork.llm.tokens import public_path


def encoded(name, end):
    """(doc_id, ids with the end id) of every row, by the tokenizer itself."""
    tokenizer = Tokenizer.from_file(public_path(name))
    return [(r[0], tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [end]) for r in rows()]


@pytest.mark.parametrize("kept", [1 << 20, 40])
@pytest.mark.parametrize("name, end, words", [(packing.TOKENIZER, packing.END, True), (wavelet.TOKENIZER, wavelet.END, False)])
def test_encoder_gives_the_tokenizers_ids(monkeypatch, name, end, words, kept):
    monkeypatch.setattr(tokens, "KEPT", kept)
    rng, own, tool = random.Random(9), Tokenizer.from_file(public_path(name)), tokens.Encoder(public_path(name), end, words)
    own.encode_special_tokens = True
    parts = [" ", "  ", "\n", "\t ", "\r\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "it's", "I'LL", "12", "x1", "...", "<|endoftext|>", "Äö", "e\u0301", "\u0301", "日本", "🙂", "a" * 100, "the", "\0"]
    for n in (0, 1, 2, 30):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, n))) for _ in range(60)]
        ids, bounds = tool.encode([t.encode() for t in texts])
        assert len(bounds) == len(texts) + 1 and bounds[0] == 0
        for text, a, b in zip(texts, bounds, bounds[1:]):
            assert ids[a:b].tolist() == own.encode(text, add_special_tokens=False).ids + [end], text
    assert tool.encode([])[0].tolist() == []


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def laid_out(pieces, length):
    """Every sequence is gapless from 0 and holds at most ``length`` ids."""
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for placed in sequences.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at and n > 0
            at += n
        assert at <= length
    return len(sequences)


@pytest.mark.parametrize("length, step", [(2048, 8), (64, 4)])
def test_packing_holds_each_id_once(spark, length, step):
    texts = encoded(packing.TOKENIZER, packing.END)
    pieces = packing.pack(docs(spark), length=length, step=step).collect()
    n = laid_out(pieces, length)
    total = sum(len(ids) for _, ids in texts)
    assert sum(p.length for p in pieces) == total and n <= 1.25 * total / length + 2
    cut = {(doc, len(ids), s): crc(ids[s : s + k]) for doc, ids in texts for s, k in {(p.start, p.length) for p in pieces if p.doc_id == doc and p.doc_tokens == len(ids)}}
    by_length = defaultdict(int)
    for doc, ids in texts:
        by_length[doc, len(ids)] += len(ids)
    held = defaultdict(int)
    for p in pieces:
        held[p.doc_id, p.doc_tokens] += p.length
    assert held == by_length
    once = [k for k in by_length if by_length[k] == k[1]]
    assert all(p.ids_crc32 == cut[p.doc_id, p.doc_tokens, p.start] for p in pieces if (p.doc_id, p.doc_tokens) in once)


def test_packing_takes_an_empty_table(spark):
    assert packing.pack(empty(spark)).count() == 0


def test_patterns_cover_the_histogram():
    rng = random.Random(3)
    demand = np.array([rng.randint(0, 50) for _ in range(16)])
    patterns, used = packing.solve(demand)
    assert (np.asarray(patterns).reshape(len(used), -1).T @ used >= demand - 1e-6).all()


def test_token_files_give_back_every_document(spark):
    texts = encoded(wavelet.TOKENIZER, wavelet.END)
    got = wavelet.digest(docs(spark)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(ids), crc(ids)) for d, ids in texts)
    at = 0
    ordered = sorted(got, key=lambda r: r.start)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in got), key=lambda d: (d is not None, d or 0))


def test_token_files_take_an_empty_table(spark):
    assert wavelet.digest(empty(spark)).count() == 0


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (700, 3), (5000, 50_000), (1024, 2)])
def test_wavelet_matrix_equals_the_list(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint32)
    built = wavelet.WaveletMatrix.build(ids)
    matrix, doc_ids, bounds = wavelet.from_bytes(wavelet.to_bytes(built, [7], np.array([0, n])))
    assert matrix.decode().tolist() == ids.tolist() and list(doc_ids) == [7] and list(bounds) == [0, n]
    for i in rng.integers(0, max(n, 1), 40).tolist() if n else []:
        token = int(ids[i])
        assert matrix.access(i) == token
        assert matrix.rank(token, i) == int((ids[:i] == token).sum())
        places = np.flatnonzero(ids == token)
        assert matrix.count(token) == len(places) and matrix.select(token, len(places) // 2) == places[len(places) // 2]
    assert matrix.occurrences(int(top) * 4) == []


@pytest.mark.parametrize("shard, leaf", [(16384, 128), (50, 3)])
def test_top_k_equals_brute_force(spark, shard, leaf):
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(400)]
    data += [(1000 + i, data[i % 3][1]) for i in range(60)]  # ties
    data += [(2000, None), (2050, [0.1] * 5 + [float("nan")]), (2100, [0.1, None, 0.1, 0.1, 0.1, 0.1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    kept = {i: np.floor(256 * np.array(v)).astype(np.int64) for i, v in data if i < 2000}
    expected = set()
    for q in (i for i in kept if i % 50 == 0):
        best = sorted((-int(kept[q] @ v), i) for i, v in kept.items() if i != q)[:5]
        expected |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    found = ball_tree.top_k(df, df.vec_id % 50 == 0, shard=shard, leaf=leaf)
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in found.collect()} == expected
    assert ball_tree.every_nth(df.limit(0)).count() == 0


def test_pipeline_packs_what_its_stages_keep(spark):
    folder = "/root/testdata/sf0.001"
    assert [name for name, _ in STAGES] == ["toxicity", "near_copies", "substring_dedup", "source_mixing", "packing"]
    pieces = run(spark, folder).collect()
    assert pieces and laid_out(pieces, packing.LENGTH)
    given = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    assert {p.doc_id for p in pieces} <= given

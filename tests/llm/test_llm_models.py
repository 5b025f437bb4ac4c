"""Toxicity, language ID and language-model scores against brute force and held-out accuracy."""

import collections
import math
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import docs, empty, rows, tokens

from veilwork.llm import language_id, lm_mixing, toxicity


def within_one(word: str, term: str) -> bool:
    """At most one letter changed, added or left out after the first letter."""
    if word == term:
        return True
    if not word or word[0] != term[0] or abs(len(word) - len(term)) > 1:
        return False
    a, b = sorted((word[1:], term[1:]), key=len)
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at:] == b[at + 1 :]


TERMS, STEMS = ["idiot", "moron", "scum", "idiots", "loser"], ["vequ", "lostra"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("idotmrnscuelvqa", max_size=8), st.sampled_from(TERMS + STEMS)), max_size=6))
def test_the_automaton_accepts_what_is_a_letter_off(found):
    automaton = toxicity.build_automaton(TERMS, STEMS)
    kinds = {}
    hits = toxicity.find_hits([" ".join(found)], automaton)
    for word, kind in zip(hits.word, hits.kind):
        kinds[hits.text([" ".join(found)], 0, int(word))] = int(kind)
    for word in found:
        exact = word in TERMS or word.startswith(tuple(STEMS))
        near = any(within_one(word, t) for t in TERMS if len(t) >= 5)
        assert kinds.get(word, 0) == (1 if exact else 2 if near else 0), word


def test_hits_see_case_marks_and_places():
    automaton = toxicity.build_automaton(["idiot", "bête"], [])
    texts = ["You IDIOT! (idiot), 'idiott'.", "", "un BÊTE\nxidiot idiot"]
    hits = toxicity.find_hits(texts, automaton)
    assert [(int(d), hits.text(texts, int(d), int(w)), int(k)) for d, w, k in zip(hits.doc, hits.word, hits.kind)] == [
        (0, "idiot", 1), (0, "idiot", 1), (0, "idiott", 2), (2, "bête", 1), (2, "idiot", 1),
    ]


def toxic_rows(n=400):
    rng = random.Random(3)
    out, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice("aeghklpt") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["grobian", "wretch"]) if i % 3 else "grobiaan")
        elif i % 7 == 0:
            w.insert(rng.randrange(len(w)), "grobiat")
        out.append((i, " ".join(w), "x"))
        labels.append((i, 1, int(toxic)))
    out += [(900, None, "x"), (901, "", "x"), (None, "wretch", "x"), (902, "wretch " * 20_000, "x"), out[3]]
    return out, labels + [(None, 1, 1), (5000, 1, 1), (7, 1, None)]


def test_toxicity_on_held_out_documents(spark):
    given, labels = toxic_rows()
    table = spark.createDataFrame(given, "doc_id long, text string, score string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(table, marks)
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    got, truth = {r.doc_id: r for r in out.collect()}, {i: t for i, _, t in labels if i is not None and t is not None}
    assert len(out.collect()) == len(given) and all(0 <= r.score <= 1 for r in got.values())
    for i in range(400):
        if zlib.crc32(str(i).encode()) % 4 == 2:
            assert got[i].predicted == truth[i], i
    assert got[900].score == got[901].score and got[900].predicted == 0 and got[902].predicted == 1
    assert toxicity.digest(table.limit(0), marks).count() == 0


def test_misspelled_words_under_a_stem_are_found(spark):
    counts = [(w, 20, 0) for w in ("idiot", "idiots", "idiotic")] + [("oaf", 9, 0), ("-", 9, 0), ("the", 90, 900)]
    words, stems = toxicity.lexicon(spark.createDataFrame(counts, "word string, toxic long, clean long"), 100, 1000)
    assert stems == ["idio"] and words == ["idiot", "idiotic", "idiots", "oaf"]
    text = "idjot idot idiocy oaf oafs the idiott"
    hits = toxicity.find_hits([text], toxicity.build_automaton(words, stems))
    assert [(hits.text([text], 0, int(w)), int(k)) for w, k in zip(hits.word, hits.kind)] == [("idjot", 2), ("idot", 2), ("idiocy", 1), ("oaf", 1), ("idiott", 1)]


def test_a_stem_that_is_a_word_takes_what_begins_with_it():
    hits = toxicity.find_hits(["idiots idiotically idjot"], toxicity.build_automaton(["idiot"], ["idiot"]))
    assert list(hits.kind) == [1, 1, 2]


def test_the_lexicon_keeps_all_telling_words(spark):
    rng = random.Random(4)
    many = sorted({"".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(9)) for _ in range(600)})
    words, _ = toxicity.lexicon(spark.createDataFrame([(w, 5, 0) for w in many], "word string, toxic long, clean long"), 100, 1000)
    assert words == many
    hits = toxicity.find_hits([" ".join(many)], toxicity.build_automaton(words, []))
    assert len(hits.word) == len(many) and set(hits.kind) == {1}


def test_toxicity_without_labels_scores_all_alike(spark):
    table = spark.createDataFrame(toxic_rows(30)[0], "doc_id long, text string, s string")
    out = toxicity.digest(table, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len({r.score for r in out}) == 1 and len(out) == 35


def test_quoted_hits_weigh_less():
    model = toxicity.Model(toxicity.build_automaton(["idiot"], []))
    plain, quoted = toxicity.features(["he is an idiot here", 'he said "idiot" here'], model)
    assert plain[0] > quoted[0] > 0 and quoted[2] > 0 == plain[2]
    learned = toxicity._context_weights({None: (500, 500), "said": (5, 200), "you": (200, 5), "rare": (1, 0)})
    assert learned["said"] < -0.5 < 0.5 < learned["you"] and abs(learned["rare"]) < 0.2


def test_forward_sums_all_segmentations():
    pieces = [b" a", b" ab", b"a", b"b", b"ab", b"bc", b"abc", "é".encode(), b" "]
    table = language_id.build_pieces(pieces)
    rng = np.random.default_rng(1)
    chances = rng.random((len(pieces), 3)) / 10
    words = ["abc", "ab", "aab" * 30, "xyz", "éab", "a" * 400]
    distinct = language_id.Distinct([" ".join(words).encode()])
    got = language_id.word_scores(distinct, table, chances)[distinct.which]
    for word, logs in zip(words, got):
        raw = (" " + word).encode()
        sums, scale = [np.ones(3)] + [np.zeros(3) for _ in raw], np.zeros(3)
        for a in range(len(raw)):
            top = np.max(sums[a:], axis=0)
            sums = [s / top for s in sums]
            scale += np.log(top)
            sums[a + 1] = sums[a + 1] + sums[a] * language_id.BYTE
            for i, p in enumerate(pieces):
                if raw[a : a + len(p)] == p:
                    sums[a + len(p)] = sums[a + len(p)] + sums[a] * chances[i]
        assert np.allclose(np.log(sums[-1]) + scale, logs, rtol=1e-9)


def test_languages_of_held_out_documents(spark):
    out = language_id.identify(docs(spark))
    assert out.columns == [c for c in docs(spark).columns if c != "score"] + ["lang_pred", "score"]
    for r in out.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
        if letters and len(tokens(r.text)) > 10 and not (set(r.text) & set("abcd") and set(r.text) & set("vwxy")):
            assert r.lang_pred == ("xx" if set(r.text) & set("abcd") else "yy")
    assert language_id.digest(empty(spark)).count() == 0
    nothing = language_id.digest(docs(spark, [(1, "abc", None, None, 1, "", "", "", "", "")])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]


def test_language_model_base_and_scores(spark):
    out = lm_mixing.score(docs(spark), frequent=20).collect()  # most words are joined
    counts = collections.Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    for i, text, *_ in rows():
        if not held(i):
            counts.update([*(w.lower() for w in tokens(text)), None])
    total, per = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    expected = collections.Counter()
    for i, text, *_ in rows():
        own = [*(w.lower() for w in tokens(text)), None]
        expected[i, held(i), len(own), sum(counts[w] > 0 for w in own), total, round(sum(math.log10(counts[w] + 0.5) - per for w in own), 5)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == expected
    assert all(r.score < 0 for r in out)
    assert lm_mixing.score(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def small_model(spark):
    return lm_mixing.learn(docs(spark).select("text"))


@pytest.mark.parametrize("before", ["", "ab cd", "the ab cd " * 60])
def test_probabilities_of_the_next_byte_sum_to_one(small_model, before):
    known = lm_mixing.log_chances([before.encode()], small_model)[0] if before else 0.0
    following = lm_mixing.log_chances([before.encode() + bytes([b]) for b in range(256)], small_model)
    assert abs(sum(10 ** (following - known)) - 1) < 1e-3


def test_a_text_scores_alike_in_any_company(small_model):
    texts = lm_mixing.plain([b"abc de " * 100, b"", b"e d c b a", b"xx yy" * 400])
    together = lm_mixing.log_chances(texts, small_model)
    alone = [lm_mixing.log_chances([t], small_model)[0] for t in texts]
    assert np.allclose(together, alone, rtol=1e-5)


def test_the_model_beats_one_bit_a_bit_and_learns_case_blind(small_model):
    seen = lm_mixing.plain([(rows()[11][1] or "").encode()])
    assert lm_mixing.plain([b"A  b\nC "]) == [b"a b c\n"]
    assert lm_mixing.log_chances(seen, small_model)[0] > -len(seen[0]) * 4.5 * math.log10(2)


def mixing_rows():
    """6,000 sure words, each followed by one other word: far more contexts than 2**22 slots tell apart."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    return [(i, " ".join(word() for _ in range(60))) for i in range(40)]


def test_every_training_text_is_in_the_counts_and_no_contexts_share_them(spark):
    given = mixing_rows()
    given += [(1000 + i, given[0][1]) for i in range(100)]  # a group of copies
    _, table = lm_mixing.fit(spark.createDataFrame(given, "doc_id long, text string"))
    expected = collections.Counter()
    for _, text in given:
        line = text.encode() + b"\n"
        for at, byte in enumerate(line):
            start = max(line.rfind(b" ", 0, at), line.rfind(b"\n", 0, at)) + 1
            for k in range(lm_mixing.PREDICTORS):
                low = max(0, at - lm_mixing.ORDERS[k]) if k < len(lm_mixing.ORDERS) else start
                expected[k, line[low:at], byte] += 1
    got = [x for r in table.collect() for x in r.seen]
    assert sorted(x >> 8 for x in got) == sorted(expected.values())
    assert sum(x >> 8 for r in table.collect() for x in r.before) < sum(expected.values())
    # The mixing part is picked by row: some copies train weights, others do not.
    copies = spark.createDataFrame(given[40:], "doc_id long, text string")
    _, table = lm_mixing.fit(copies)
    row = table.selectExpr("sum(aggregate(before, 0L, (s, x) -> s + (x div 256))) AS before", "sum(aggregate(seen, 0L, (s, x) -> s + (x div 256))) AS seen").first()
    assert 0 < row.before < row.seen


def test_a_task_adds_up_its_counts_before_they_are_shuffled(monkeypatch):
    """Each pair of context and byte leaves a task once, and not once for every run of texts it is in."""
    monkeypatch.setattr(lm_mixing, "HASHED", 1_000)  # a run for each text or two
    texts = [text for _, text in mixing_rows()[:3]] * 20
    batches = [pa.RecordBatch.from_pydict({"text": texts[at : at + 7], "mixing": [at % 2 == 0] * len(texts[at : at + 7])}) for at in range(0, 60, 7)]

    def counted(limit):
        monkeypatch.setattr(lm_mixing, "HELD", limit)
        return [(r["context"], r["byte"], r["n"], r["mixing"]) for b in lm_mixing._seen(iter(batches)) for r in b.to_pylist()]

    once, often = counted(1 << 22), counted(4_000)  # the second gives up what it holds again and again
    assert len(once) == len({r[:2] for r in once}) < len(often)
    sums = collections.Counter()
    for context, byte, n, mixing in often:
        sums[context, byte, "n"] += n
        sums[context, byte, "mixing"] += mixing
    assert sums == {k: v for c, b, n, m in once for k, v in (((c, b, "n"), n), ((c, b, "mixing"), m))}
    assert sum(r[2] for r in once) == lm_mixing.PREDICTORS * sum(len(t) + 1 for t in texts)


def test_texts_hashed_in_runs_ask_for_each_context_once(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": [text for _, text in mixing_rows()[:5]] * 4 + [None, ""]})
    whole = lm_mixing._asked(batch)
    monkeypatch.setattr(lm_mixing, "HASHED", 700)
    assert sorted(lm_mixing._asked(batch)) == sorted(whole) == sorted(set(whole))


def test_tables_worked_out_in_slices_are_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    lists = [[int(n) * 256 + b for b, n in zip(rng.choice(256, k, replace=False).tolist(), rng.integers(1, 99, k))] for k in rng.integers(0, 5, 300)]
    found = pa.table({"context": rng.permutation(10_000)[:300] - 5_000, "seen": pa.array(lists, pa.list_(pa.int64()))})
    code = lm_mixing.Code.of(np.arange(256))
    whole = lm_mixing.Tables.from_seen(found, code)
    monkeypatch.setattr(lm_mixing, "SLICE", 7)
    part = lm_mixing.Tables.from_seen(found, code)
    assert all((getattr(whole, name) == getattr(part, name)).all() for name in ("context", "node", "value"))
    assert len(whole.node) and (np.diff(whole.node) > 0).all()


def test_tables_of_one_chunk_score_as_the_whole_model(spark, monkeypatch):
    monkeypatch.setattr(lm_mixing, "LOOKUP", 2_000)  # many chunks
    given = mixing_rows()
    table = spark.createDataFrame(given, "doc_id long, text string")
    model = lm_mixing.learn(table.where(~lm_mixing.held_out(5, 1)).select("doc_id", "text"))
    got = {r.doc_id: r.score for r in lm_mixing.score(table).collect()}
    expected = lm_mixing.log_chances(lm_mixing.plain([t.encode() for _, t in given]), model)
    assert np.allclose([got[i] for i, _ in given], expected, rtol=1e-4)


def test_what_a_query_keeps_on_disk_is_a_small_multiple_of_its_text(spark, monkeypatch):
    """Contexts, counts and answers are compressed arrays, and no rows with a hash for each context of each chunk."""
    kept, write = [], lm_mixing.written
    monkeypatch.setattr(lm_mixing, "written", lambda df, name: kept.append(write(df, name)) or kept[-1])
    given = mixing_rows() * 20
    table = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(given)], "doc_id long, text string").coalesce(2)
    assert lm_mixing.score(table).count() == len(given)
    size = sum(os.path.getsize(path.removeprefix("file:")) for df in kept for path in df.inputFiles())
    assert size < 4 * sum(len(text) for _, text in given)


def test_answers_give_what_the_tables_have():
    rng = np.random.default_rng(2)
    code = lm_mixing.Code.of(rng.integers(0, 2, 256) * rng.integers(1, 1000, 256))
    context = np.sort(np.repeat(rng.integers(-(1 << 62), 1 << 62, 300), rng.integers(1, 9, 300)))
    asked = rng.integers(0, 256, len(context)).astype(np.uint8)  # some never follow
    kinds, first = np.unique(context, return_index=True)
    lists = [rng.choice(256, k, replace=False).astype(np.uint8) for k in rng.integers(0, 6, len(kinds))]
    lists = [np.union1d(own, asked[at : at + 1]) if len(own) > 2 else own for own, at in zip(lists, first)]
    times = [rng.integers(1, 99, len(own)) for own in lists]
    found = pa.table({"context": kinds, "seen": pa.array([(n * 256 + own).tolist() for own, n in zip(lists, times)], pa.list_(pa.int64()))})
    begin, expected = lm_mixing.Tables.from_seen(found, code).of(context, asked, code)
    sizes, follows, n = np.array([len(own) for own in lists]), np.concatenate(lists).astype(np.uint8), np.concatenate(times).astype(np.int64)
    packed = lm_mixing.unpacked(lm_mixing.pack(sizes.astype(np.uint16), follows, n), *lm_mixing.ANSWER)
    at, values = lm_mixing.bit_values(context, asked, *packed, code)
    assert (at == begin).all() and (values == expected).all() and values.any()


def odd_texts():
    words = ["ab", "the", "Zebra", "q" * 8, "q" * 9, "ünï", "\x00", "a\x00b"]
    rng = random.Random(9)
    texts = [None, "", " \t\n ", "\x00", "x" * 3_000, "\x00" * 20 + " a", " lead\x0band\x0ctrail \r\n", "ü" * 700, "same words here " * 40]
    texts += [rng.choice([" ", "  ", "\n", "\t "]).join(rng.choices(words, k=rng.randrange(1, 200))) for _ in range(60)]
    return [*texts, *texts[6:12]]  # some rows come twice


def test_chunks_of_odd_texts_score_as_the_whole_model(spark, monkeypatch):
    """What runs in Java and the arrays of a small model give the same, for texts that end words, blocks and codes oddly."""
    monkeypatch.setattr(lm_mixing, "LOOKUP", 3_000)
    monkeypatch.setattr(lm_mixing, "MIXING_PART", 3)
    given = [(None if i % 9 == 0 else i, text) for i, text in enumerate(odd_texts())]
    table = spark.createDataFrame(given, "doc_id long, text string").coalesce(2)
    model = lm_mixing.learn(table.where(~lm_mixing.held_out(5, 1)).select("doc_id", "text"))
    expected = lm_mixing.log_chances(lm_mixing.plain([(text or "").encode() for _, text in given]), model)
    got = sorted(((r.doc_id or -1), r.n_tokens, r.score) for r in lm_mixing.score(table).collect())
    counts = [len((text or "").encode().split()) + 1 for _, text in given]
    expected = sorted((i or -1, n, x) for (i, _), n, x in zip(given, counts, expected))
    assert [x[:2] for x in got] == [x[:2] for x in expected]
    assert np.allclose([x[2] for x in got], [x[2] for x in expected], rtol=1e-4)


def test_a_chunk_is_not_sent_what_only_itself_counts(spark):
    """Answers are as long as what other chunks add, and not as all contexts of the chunk."""
    given = mixing_rows()
    table = spark.createDataFrame(given, "doc_id long, text string").coalesce(1)
    _, _, _, answers = lm_mixing.fit_chunks(table.selectExpr("doc_id", "0L AS version", "false AS held_out", "text"))
    sent = sum(len(x.answer) for r in answers.collect() for x in r.found)
    assert 0 < sent < sum(len(text) for _, text in given) / 2

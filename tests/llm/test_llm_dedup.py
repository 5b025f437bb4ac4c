"""Substring dedup and the n-gram Jaccard join against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import docs, empty, rows, tokens

from veilwork.llm import jaccard_join, substring_dedup
from veilwork.llm.graph import connected_components
from veilwork.llm.words import Words, runs


def brute_dedup(given, window=13):
    first = {}
    for i, text, *_ in given:
        w = tokens(text)
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text, *_ in given:
        w = tokens(text)
        gone = {a + k for a in range(len(w) - window + 1) if i is not None and first[tuple(w[a : a + window])] < i for k in range(window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [60_000, 3])
def test_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)  # with salts for all but rare windows, and without
    got = Counter(map(tuple, substring_dedup.digest(docs(spark)).collect()))
    assert got == brute_dedup(rows())


def test_dedup_with_a_sketch_that_is_too_small_loses_nothing(spark):
    full = substring_dedup.dedup_substrings(docs(spark)).select("doc_id", "n_removed").collect()
    small = substring_dedup.dedup_substrings(docs(spark), max_cells=1 << 16).select("doc_id", "n_removed").collect()
    assert Counter(full) == Counter(small) and sum(r.n_removed for r in full) > 0


def test_dedup_keeps_columns_and_layout_and_takes_an_empty_table(spark):
    out = substring_dedup.dedup_substrings(docs(spark))
    assert out.columns == [*docs(spark).columns, "n_words", "n_removed"]
    before = {(r.doc_id, r.text) for r in docs(spark).collect()}
    assert all((r.doc_id, r.text) in before for r in out.where("n_removed = 0").collect())
    assert substring_dedup.digest(empty(spark)).count() == 0


def test_windows_of_versions_under_one_id_do_not_mix(spark):
    text = " ".join(f"w{i}" for i in range(30))
    given = [(1, text), (2, "x " + text), (2, text + " y z")]
    got = substring_dedup.digest(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_words): r.n_removed for r in got} == {(1, 30): 0, (2, 31): 30, (2, 32): 30}


def brute_links(given, n=5, threshold=0.8):
    sets = []
    for i, text, *_ in given:
        w = tokens(text)
        grams = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets.append((i, grams))
    sets = [s for s in sets if s[0] is not None]
    links, parent = [0] * len(sets), list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both, every = len(sets[a][1] & sets[b][1]), len(sets[a][1] | sets[b][1])
            if both and both >= threshold * every - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        smallest[root(k)] = min(smallest.get(root(k), i), i)
    return Counter((i, smallest[root(k)], links[k], len(g)) for k, (i, g) in enumerate(sets))


@pytest.mark.parametrize("block", [512, 2])
def test_join_equals_brute_force(spark, block):
    out = jaccard_join.jaccard_join(docs(spark), block=block)
    assert Counter((r.doc_id, r.class_id, r.n_links, r.n_grams) for r in out.collect()) == brute_links(rows())


def test_a_chain_of_near_copies_is_one_group_in_any_blocks(spark):
    base = [f"w{i}" for i in range(120)]
    given = [(i, " ".join(base[i : i + 100])) for i in range(14)]
    for block in (512, 3):
        out = jaccard_join.jaccard_join(spark.createDataFrame(given, "doc_id long, text string"), block=block).collect()
        assert Counter((r.doc_id, r.class_id, r.n_links, r.n_grams) for r in out) == brute_links(given)


def test_keep_one_of_each_group(spark):
    out = jaccard_join.keep_one(docs(spark))
    assert out.columns == docs(spark).columns
    groups = {r.doc_id: r.class_id for r in jaccard_join.jaccard_join(docs(spark)).collect()}
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(set(groups.values()))
    assert jaccard_join.keep_one(empty(spark)).count() == 0
    assert jaccard_join.jaccard_join(empty(spark)).count() == 0


def test_bands_reach_the_recall():
    bands = jaccard_join.band_count(0.8, 4, 0.9999)
    assert 1 - (1 - 0.8**4) ** bands >= 0.9999 > 1 - (1 - 0.8**4) ** (bands - 1)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    out = {r.v: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


def test_word_hashes_follow_words_only():
    a, b = Words([b"x yy  zzz", b"", b"yy"]), Words([b"zzz\tyy\nx"])
    assert a.counts.tolist() == [3, 0, 1] and [a.word(i) for i in range(4)] == [b"x", b"yy", b"zzz", b"yy"]
    ha, hb = a.hashes(), b.hashes()
    assert ha[1] == ha[3] == hb[1] and ha[0] == hb[2] and len(set(ha.tolist())) == 3
    repeat = Words([b"p q r s p q r"])
    grams = runs(repeat.hashes(), 3)
    assert grams[0] == grams[4] and len(np.unique(grams)) == 4


def test_words_that_differ_in_structure_only_are_different(spark):
    """A word and its complement, which sums of powers modulo 2**64 can't tell apart, share no window."""
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    texts = [" ".join([*(f"w{i}" for i in range(6)), middle, *(f"v{i}" for i in range(6))]) for middle in (x, y, x)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.digest(table).collect()} == {0: 0, 1: 0, 2: 13}
    for which in (0, 1):
        hashes = Words([x.encode(), y.encode(), b"ab ab", b"abc\0", b"abc", b"x" * 1_000_000]).hashes(which)
        assert len(hashes) == 7 and len(set(hashes.tolist())) == 6

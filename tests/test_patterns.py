"""Spark matches what Python's ``re`` matches, character by character."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilwork import patterns
from veilwork.functions import regex, text
from veilwork.operators import pii, tables, terms

NBSP = " "
EDGES = {
    "é1234567890 x": "é1234567890 x",
    "mail é.a@b.com": "mail é[PII_REMOVED]",
    f"tel{NBSP}555{NBSP}123{NBSP}4567": "tel[PII_REMOVED]",
    "١٢٣-٤٥-٦٧٨٩": "[PII_REMOVED]",
    "x@y.coé": "x@y.coé",
    "123-45-6789é": "123-45-6789é",
    "a@b.c|m": "[PII_REMOVED]",
    "(555) 123-4567": "([PII_REMOVED]",
    "+1 555-123-4567": "+[PII_REMOVED]",
    "4785380592391139": "[PII_REMOVED]",
    "GB82WEST12345698765432": "GB82WEST12345698765432",
    "DE89370400440532013000": "DE89370400440532013000",
}
PIECES = (
    "555-123-4567", "a@b.co", "123-45-6789", "4111 1111 1111 1111", "NL91ABNA0417164300", "BE68 5390 0754 7034 9",
    "x.y@z.org|", "1 (555) 123 4567", "+1 5551234567", "| a b |", "+--+", "x | y", "tab.", "TABLE", "a    b    c", "\ta\tb",
    "12  34", "1,, 2", "|||", "a   b   c", "tbl",
)
ALPHABET = list("aZé1234567890 -.+()@|_%\t\n\xa0\x1c\x85 ²ोंÉ٣中KſтT")


def _mixed_texts(n: int, seed: int = 7) -> list[str]:
    rnd = random.Random(seed)

    def token() -> str:
        piece = rnd.choice(PIECES) if rnd.random() < 0.6 else ""
        return piece + "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 4)))

    return ["".join(token() for _ in range(rnd.randint(1, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def mixed(spark):
    texts = _mixed_texts(6000)
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()


def python_remove(t: str) -> str:
    for pattern in patterns.PII_PATTERNS.values():
        t = re.sub(pattern, patterns.PII_MARKER, t)
    return t


VOTES = {
    "a|b|c": 1,
    "a|b": 0,
    "||": 1,
    "a   b   c": 1,
    "a   b": 0,
    "   a   b   ": 0,
    "a \t b\xa0\xa0\xa0c": 1,
    "12 34": 1,
    "1,, 2": 1,
    "1,5": 0,
    "x 1\x1c2": 1,
    "٣ ٣": 1,
    "1\n2": 0,
    "1 2\n\n3 4\n|x|": 3,
    "": 0,
    "plain words\nand more": 0,
}


def test_edge_strings(spark):
    df = spark.createDataFrame([(k,) for k in EDGES], "text string")
    out = df.select("text", pii.remove_pii_column(F.col("text")).alias("out")).collect()
    assert {r.text: r.out for r in out} == EDGES
    assert {k: python_remove(k) for k in EDGES} == EDGES


def test_each_kind_and_the_chain_match_python(mixed):
    texts, df = mixed
    kinds = [pii.remove_kind_column(F.col("text"), k).alias(k) for k in pii.KINDS]
    for row in df.select("doc_id", *kinds, pii.remove_pii_column(F.col("text")).alias("all")).collect():
        t = texts[row.doc_id]
        for kind, pattern in patterns.PII_PATTERNS.items():
            assert row[kind] == re.sub(pattern, patterns.PII_MARKER, t), (kind, t)
        assert row["all"] == python_remove(t)


def test_nothing_is_left_and_a_second_pass_changes_nothing(mixed):
    _, df = mixed
    once = pii.remove_pii_regex(df)
    for row in pii.remove_pii_regex(once.withColumn("first", F.col("text"))).collect():
        assert row.first == row.text
        assert not any(re.search(p, row.first) for p in patterns.PII_PATTERNS.values())


def test_findings_and_summary_match_python(mixed):
    texts, df = mixed
    expected, counts = set(), dict.fromkeys(patterns.PII_PATTERNS, 0)
    for i, t in enumerate(texts):
        for kind, pattern in patterns.PII_PATTERNS.items():
            found = [m.group(0) for m in re.finditer(pattern, t)]
            expected |= {(i, kind, pos, m) for pos, m in enumerate(found)}
            counts[kind] += len(found)
            t = re.sub(pattern, patterns.PII_MARKER, t)
    assert {tuple(r) for r in pii.pii_findings(df).collect()} == expected
    summary = pii.pii_summary(df.withColumn("source", F.lit("s"))).collect()
    assert {r.kind: r.n for r in summary} == counts


def test_table_signs_match_python(mixed):
    texts, df = mixed
    signs = tables.has_table_indicators(tables.table_line_votes(tables.table_indicators(df)))
    for row in signs.collect():
        t = texts[row.doc_id]
        found = {n: bool(re.search(p, t, re.IGNORECASE)) for n, p in patterns.TABLE_INDICATORS.items()}
        assert {n: row[n] for n in found} == found, t
        assert row.has_table == (any(found.values()) or row.votes >= 3)


def test_votes(spark):
    df = spark.createDataFrame([(t,) for t in VOTES], "text string")
    assert {r.text: r.votes for r in tables.table_line_votes(df).collect()} == VOTES


def test_null_and_empty_text(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    out = tables.has_table_indicators(tables.table_line_votes(pii.remove_pii_regex(df))).collect()
    assert [(r.doc_id, r.text, r.votes, r.has_table) for r in sorted(out)] == [(1, None, 0, False), (2, "", 0, False)]
    assert pii.pii_findings(df).count() == 0


def test_all_lines_vote(spark):
    late = "\n".join(["word"] * 50 + ["1 2"] * 5)
    early = "\n".join(["word"] * 47 + ["1 2"] * 8)
    df = spark.createDataFrame([(late,), (early,)], "text string")
    assert sorted(r.votes for r in tables.table_line_votes(df).collect()) == [5, 8]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abABéÉ.|$ ß\\", min_size=1, max_size=4), min_size=1, max_size=6), st.text(alphabet="abABéÉ.|$ ß\\", max_size=30))
def test_grouped_alternation_is_the_plain_one(listed, sample):
    grouped = re.compile(regex.alternation(listed).replace("(?iu)", "(?i)"))
    plain = re.compile("|".join(map(re.escape, listed)), re.IGNORECASE)
    assert grouped.sub("<>", sample) == plain.sub("<>", sample)


def test_alternation_of_many_nested_terms():
    nested = ["a" * n for n in range(300, 0, -1)]
    pattern = re.compile(regex.alternation(nested).replace("(?iu)", "(?i)"))
    assert pattern.sub(lambda m: f"<{len(m.group())}>", "A" * 250 + "b" + "a" * 301) == "<250>b<300><1>"
    assert regex.alternation(nested[::-1]) == "(?iu)(?=[a])(?:a)"


def test_column_form_is_the_list_form(spark):
    lists = [["ab", "abc", "Abd", "b"], ["x", "Xy", ".|", "$"], ["é", "ÉA", "ß", "ss"], ["the", "then", "they", "t"]]
    rows = [(k, pos, t) for k, own in enumerate(lists) for pos, t in enumerate(own)]
    made = terms.group_patterns(spark.createDataFrame(rows, "k long, pos int, term string"), "k").collect()
    assert {r.k: r._pattern for r in made} == {k: regex.alternation(own) for k, own in enumerate(lists)}


def test_terms_match_python(mixed):
    texts, df = mixed
    listed = ["tab", "TABLE", "a b", "1", "é", "a+b (x)", "|", "+-", "$5", "\\d", "K", "x.y", "T", "中"]
    out = terms.anonymize(df, listed, r"<$1\2>").collect()
    plain = re.compile("|".join(map(re.escape, terms.normalize_term_list(listed))), re.IGNORECASE)
    for row in out:
        assert row.text == plain.sub(lambda _: r"<$1\2>", texts[row.doc_id])


def test_first_listed_term_wins_and_empty_replacement_is_a_space(spark):
    df = spark.createDataFrame([(1, "john doe")], "doc_id long, text string")
    assert terms.anonymize(df, ["John", "John Doe"], "<>").first().text == "<> doe"
    assert terms.anonymize(df, ["John Doe"]).first().text == " "
    assert terms.anonymize(df, ["", None]).first().text == "john doe"


PARSED = {
    "Acme, Bob\nacme": ["Acme", "Bob"],
    " a b ,,\tc\x1f": ["a b", "c"],
    "a\r\nb\rc\x0bd\x0ce": ["a", "b", "c", "d", "e"],
    "x\x1cy\x1dz\x1ew": ["x", "y", "z", "w"],
    "p\x85q\u2028r\u2029s": ["p", "q", "r", "s"],
    "\u00c9, \u00e9, e": ["\u00c9", "e"],
    "\xa0b\xa0, B, a, b": ["b", "a"],
    "one\x1ftwo": ["one\x1ftwo"],
    ", \n ,": [],
    "": [],
}


def test_parse_and_normalize_terms(spark):
    df = spark.createDataFrame([(raw, raw) for raw in PARSED], "id string, raw string")
    got = {raw: [] for raw in PARSED}
    for row in terms.parse_terms(df, "raw").orderBy("id", "pos").collect():
        assert row.pos == len(got[row.id])
        got[row.id].append(row.term)
    assert got == PARSED
    arrays = spark.createDataFrame([(1, [" a", None, "A ", "b", "", "\t"])], "id long, t array<string>")
    assert [tuple(r) for r in terms.normalize_terms(arrays, "t").collect()] == [(1, 0, "a"), (1, 1, "b")]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_anonymize_by_group_broadcast_and_salted(spark, limit, monkeypatch):
    monkeypatch.setattr("veilwork.operators.terms.lookup_join", _limited(limit))
    docs = spark.createDataFrame(
        [(i, "k1" if i % 3 else "k2", f"Alpha beta a+b {i}") for i in range(60)] + [(99, "none", "alpha")],
        "doc_id long, batch string, text string",
    )
    listed = spark.createDataFrame(
        [("k1", 0, "alpha", "<$>"), ("k1", 1, " a+b ", "<$>"), ("k1", 2, "ALPHA", "no"), ("k2", 0, "beta", None), ("k2", 1, " ", "x")],
        "batch string, pos int, term string, replacement string",
    )
    out = {r.doc_id: r.text for r in terms.anonymize_by_group(docs, listed, "batch").collect()}
    assert len(out) == 61 and out[99] == "alpha"
    assert out[1] == "<$> beta <$> 1" and out[3] == "Alpha   a+b 3"


def _limited(limit):
    from veilwork.functions import scale

    return lambda *a, **kw: scale.lookup_join(*a, **{**kw, "limit": limit})


def test_text_helpers_match_python(mixed):
    import html

    texts, df = mixed
    c = F.col("text")
    out = df.select("doc_id", text.strip(c).alias("s"), text.html_escape(c).alias("h"), text.ellipsize(c, 15).alias("e"), text.collapse_space(c).alias("w"))
    for r in out.collect():
        t = texts[r.doc_id]
        assert r.s == t.strip() and r.h == html.escape(t)
        assert r.e == (t[:15] + "..." if len(t) > 15 else t)
        assert r.w == re.sub(r"\s+", " ", t).strip()

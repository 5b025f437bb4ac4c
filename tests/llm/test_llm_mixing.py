"""Source mixing and line quality against brute force and SQL."""

import duckdb
import pytest
from llm_fixtures import docs, empty, rows, tokens
from pyspark.sql import functions as F

from veilwork.llm import line_quality, source_mixing
from veilwork.llm.queries import SQL


def brute_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and open_:
        share, total = left, sum(weight[s] for s in open_)
        for s in open_:
            target[s] += share * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = float(cap * sizes[s])
                open_.discard(s)
    return target


def highest_quotients(votes, seats):
    out = dict.fromkeys(votes, 0)
    for _ in range(seats):
        best = max(votes, key=lambda p: (votes[p] / (2 * out[p] + 1), -ord(p)))
        out[best] += 1
    return out


@pytest.mark.parametrize("votes,seats", [
    ({"a": 90.0, **{chr(98 + i): 0.45 for i in range(20)}}, 100), ({"a": 5.0, "b": 3.0, "c": 1.0}, 7), ({"a": 1.0, "b": 1.0, "c": 1.0}, 4),
    ({"a": 0.0, "b": 2.0}, 3), ({"a": 53.0, "b": 24.0, "c": 23.0}, 7), ({"a": 1.0}, 0),
])
def test_apportion_is_highest_quotients(spark, votes, seats):
    table = spark.createDataFrame([("g", p, v, seats) for p, v in votes.items()], "g string, p string, votes double, seats long")
    out = source_mixing.apportion(table, ["g"], [F.col("p")], "votes", "seats", "got").collect()
    assert {r.p: r.got for r in out} == highest_quotients(votes, seats)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 500, "c": 2, None: 1}, {"z": 7}, {"a": 0, "b": 9}, {"é": 3, "z": 90, "A": 1, "b": 4}])
def test_targets_share_again_what_is_above_the_cap(spark, sizes):
    out = source_mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
    expected = brute_targets(sizes)
    assert {r.source for r in out} == set(expected)
    assert all(abs(r.target - expected[r.source]) < 1e-6 for r in out)


def test_taken_words_come_near_targets(spark):
    out = source_mixing.taken(docs(spark)).collect()
    assert len(out) == len(rows()) and all(0 <= r.taken <= 3 * r.size for r in out)
    sizes = {}
    for i, text, _, source, *_ in rows():
        sizes[source] = sizes.get(source, 0) + len(tokens(text))
    expected = brute_targets(sizes)
    by_target = {}
    for r in out:
        by_target[round(r.target, 3)] = by_target.get(round(r.target, 3), 0) + r.taken
    for target in {round(t, 3) for t in expected.values()}:
        assert abs(by_target[target] - target) <= 0.01 * target + 2
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, source_mixing.taken(docs(spark).repartition(5)).collect()), key=repr)
    assert source_mixing.taken(empty(spark)).count() == 0


def test_mix_has_the_words_taken(spark):
    once = docs(spark).dropDuplicates()
    out = source_mixing.mix(once)
    assert out.columns == once.columns
    words = {}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(tokens(r.text))
    assert words == {r.doc_id: r.taken for r in source_mixing.taken(once).collect() if r.taken}
    assert source_mixing.mix(empty(spark)).count() == 0


def word(*numbers):
    """A word of letters for some numbers: lines that differ in digits only are one line."""
    return "".join(chr(97 + n // 26 % 26) + chr(97 + n % 26) for n in numbers)


def line_rows():
    boiler = "Subscribe to   our NEWS letter 2021"
    out = [(i, f"{boiler}\nown text " + " ".join(word(1, i, k) for k in range(61)), "h") for i in range(60)]
    out += [(100 + i, "\n".join([boiler.replace("2021", str(i))] * 12) + "\nshort own " + " ".join(word(2, i, k) for k in range(20)), "h") for i in range(5)]
    out += [(200, boiler + "\n" + " ".join(word(3, k) for k in range(70)), "other"), (201, None, None), (202, "", "h"), (203, "#$ %a|\n\n#$ %a|\r", None)]
    return out + [(i, out[0][1], "h") for i in range(300, 340)]


@pytest.mark.parametrize("given", [line_rows(), [r[:2] + (r[3],) for r in rows() if r[0] is not None and len(r[1] or "") < 9000][:-2]])
def test_line_quality_equals_sql(spark, given):
    table = spark.createDataFrame(given, "doc_id long, text string, source string")
    got = line_quality.judge(table).drop("row").toPandas()
    db = duckdb.connect()
    db.register("documents", table.toPandas())
    expected = db.sql(SQL["op7_line_quality"]).df()
    key = lambda t: sorted(map(tuple, t[sorted(got.columns)].astype(str).values.tolist()))
    assert key(got) == key(expected)


def test_common_lines_go_and_depleted_documents_too(spark):
    table = spark.createDataFrame([(*r, "k") for r in line_rows()], "doc_id long, text string, source string, row string")
    verdict = {r.doc_id: r for r in line_quality.judge(table.drop("row")).collect()}
    assert verdict[3].words_removed == 6 and verdict[3].kept and verdict[200].words_removed == 0
    assert verdict[102].words_removed == 72 and not verdict[102].kept
    cleaned = {r.doc_id: r.text for r in line_quality.clean(table).select("doc_id", "text").collect()}
    assert 102 not in cleaned and "Subscribe" not in cleaned[3] and "Subscribe" in cleaned[200]
    assert line_quality.judge(empty(spark)).count() == 0 and line_quality.clean(empty(spark)).count() == 0


def test_copies_and_different_texts_count_by_document(spark):
    """A page repeated over a host loses its lines; one repeated on fifty documents, or under one id, does not."""
    copies = [(i, "a page repeated as it is " + " ".join(word(4, k) for k in range(60)), "h") for i in range(80)]
    judged = line_quality.judge(spark.createDataFrame(copies, "doc_id long, text string, source string")).collect()
    assert all(r.words_removed == r.n_words and not r.kept for r in judged) and len(judged) == 80
    few = copies[:50] + [(7, copies[0][1], "h")] * 30
    judged = line_quality.judge(spark.createDataFrame(few, "doc_id long, text string, source string")).collect()
    assert all(r.words_removed == 0 and r.kept for r in judged)
    varied = [(i, f"a line of all\n{word(5, i)} {text}", host) for i, text, host in copies]
    judged = line_quality.judge(spark.createDataFrame(varied, "doc_id long, text string, source string")).collect()
    assert all(r.words_removed == 4 for r in judged)

"""URL verdicts against plain rules; cascades against sets, in one part and in several."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from veilwork.llm import url_cascade
from veilwork.llm.url_cascade import RULES

SCHEMA = "page_id long, url string, html string, host string, rule string, keys string, n string"


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    kept = {}
    for h, p, v in rules:
        if h is not None and v in ("allow", "block"):
            h = "".join(c.lower() if c.isascii() else c for c in h)
            kept[h, p or ""] = "block" if "block" in (v, kept.get((h, p or ""))) else "allow"
    fits = [(len(h + p), len(h), h + p, v) for (h, p), v in kept.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def urls():
    rng = random.Random(4)
    given = [
        None, "", "no scheme", "net/", "http://", "http:///en/", "https://NET/", "x://net", "http://a.net", "http://a.net?/", "http://a.net#/", "http://planet/", "http://x.planet/",
        "http://EXAMPLE.net/en/1", "http://example.net/EN/1", "http://example.net/en", "http://www.example.net/en/?q=://b.net/", "http://notexample.net/en/", "ftp://a.b.example.com/de/x#y",
        "http://example.com/de", "http://org/fr/", "http://x.org/fr/\n/y", "http://x.org:80/fr/", "http://me@x.org/fr/", "http://net./", "http://.net/", "http://ÀÉ.NET/ü", "://net/://net/", "http://a.net/" + "x/" * 20_000,
        "http://" + "a." * 20_000 + "org/fr/",
    ]
    for _ in range(300):
        host = ".".join(rng.choice(["net", "org", "example", "com", "a", "b"]) for _ in range(rng.randint(1, 5)))
        given.append(f"http://{host}/{rng.choice(['en', 'de', 'fr', 'e'])}/{rng.randint(0, 9)}")
    rows = [(i, u, "<html>", "h", "r", "k", "n") for i, u in enumerate(given)]
    return rows + [rows[7], rows[7], (None, given[13], None, "h", "r", "k", "n")]


def check(df, rows, rules):
    assert sorted(df.columns) == sorted(["page_id", "url", "html", "keys", "n", "host", "path", "rule", "verdict"])
    got = sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=repr)
    assert got == sorted(((r[0], r[1], *plain(r[1], rules)) for r in rows), key=repr)


def test_the_given_rules(spark):
    rows = urls()
    check(url_cascade.judge(spark.createDataFrame(rows, SCHEMA).repartition(3), url_cascade.rule_table(spark)), rows, RULES)


@pytest.mark.parametrize("limit", [url_cascade.LIMIT_BYTES, 64])
def test_a_list_of_rules_in_one_part_and_in_several(spark, limit):
    rng = random.Random(9)
    rows = urls()
    rules = [(".".join(rng.choice(["net", "org", "example", "com", "a", "b"]) for _ in range(rng.randint(1, 4))), rng.choice(["", "/", "/en/", "/d", "/fr/3", None]), rng.choice(["allow", "block"])) for _ in range(150)]
    rules += [("A.b", "/", "block"), (None, "/", "block"), ("org", "", None), ("org", "", "other"), ("", "/en/", "block"), ("", "", "allow")]
    check(url_cascade.judge(spark.createDataFrame(rows, SCHEMA).repartition(3), url_cascade.rule_table(spark, rules), limit=limit), rows, rules)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert url_cascade.judge(none, url_cascade.rule_table(spark)).collect() == []
    rows = urls()[:12]
    check(url_cascade.judge(spark.createDataFrame(rows, SCHEMA), url_cascade.rule_table(spark).limit(0)), rows, [])


@pytest.mark.parametrize("limit", [url_cascade.LIMIT_BYTES, 256])
def test_cascades_are_exact_over_their_universe(spark, limit):
    keys = spark.range(20_000).select(F.col("id"), url_cascade.digest(F.col("id").cast("string")).alias("k"))
    listed = keys.where("id % 23 = 0")
    cascade = url_cascade.build(listed.union(listed), keys.union(keys), limit)
    assert len(cascade.levels) > 2 and (cascade.parts > 1) == (limit == 256)
    found = cascade.listed(keys.select("k")).where(url_cascade.is_listed(F.col("passed"))).select("k").collect()
    assert sorted(bytes(r.k) for r in found) == sorted(hashlib.sha256(str(i).encode()).digest()[:16] for i in range(0, 20_000, 23))


def test_judging_moves_no_rows(spark):
    df = url_cascade.judge(spark.createDataFrame(urls(), SCHEMA), url_cascade.rule_table(spark))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()

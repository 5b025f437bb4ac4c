"""Hard negatives against all pairs, with tiles of all sizes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwork.llm import hard_negatives
from veilwork.llm.hard_negatives import Best, bands, learn_centres

SCHEMA = "vec_id long, embedding array<float>, label int, score string, slot string, v string, cluster string"


def vectors(seed=3, n=700):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(n):
        label = int(rng.integers(4))
        v = (centres[label] + rng.normal(size=8) * 0.6) / 4
        if i % 5 == 1:
            v = centres[i % 6] / 4  # very many equal vectors, of several labels
        rows.append([i * 10 % 1000 if i % 3 else i, [float(x) for x in v.astype(np.float32)], label])
    given = {r[0]: r for r in rows}
    rows = [*given.values()]
    rows += [rows[10][:], rows[10][:], [rows[20][0], rows[21][1], 2], [rows[21][0], rows[21][1], 3]]  # equal rows, and ids that occur twice
    rows += [[2000 + i, [0.0] * 8, i % 3] for i in range(0, 100, 25)]
    rows += [[3000, [1.0, 2.0], 1], [3001, [2.0, 1.0], 1], [3002, [1.0, 1.5], 2], [3050, [], 1]]
    rows += [[4000, None, 1], [4050, [1.0] * 7 + [None], 1], [4100, [math.nan] + [1.0] * 7, 1], [4150, [math.inf] * 8, 1], [4200, [1.0] * 8, None], [None, [1.0] * 8, 1]]
    random.Random(seed).shuffle(rows)
    return [tuple(r) + ("s", "s", "v", "c") for r in rows]


def plain(rows, every=50, positives=5, negatives=3, least=50, most=95):
    seen = set()
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        seen.add((vec_id, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for a, label, v in seen:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), c, m) for c, m, w in seen if c != a and len(w) == len(v))
        for ps, p in [(-s, c) for s, c, m in scored if m == label][:positives]:
            fits = [(-s, c) for s, c, m in scored if m != label and least * ps <= -100 * s <= most * ps]
            out += [(a, p, rank + 1, c, ps, s) for rank, (s, c) in enumerate(fits[:negatives])]
    return sorted(out)


def found(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limits", [{}, {"shards": 2, "shard_rows": 50, "group_rows": 4}])
def test_hard_negatives_of_every_anchor(spark, limits):
    rows = vectors()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("label", hard_negatives.relabelled())
    expected = plain(rows)
    assert len(expected) > 50
    assert found(hard_negatives.mine(table, F.col("vec_id") % 50 == 0, **limits)) == expected


def test_other_counts_and_bands(spark):
    rows = vectors(8, 300)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("label", hard_negatives.relabelled())
    got = hard_negatives.mine(table, F.col("vec_id") % 20 == 0, positives=2, negatives=7, least=0, most=100)
    assert found(got) == plain(rows, 20, 2, 7, 0, 100)


def test_no_rows_and_no_anchors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.every_nth(none).collect() == []
    alone = spark.createDataFrame([(50, [1.0, 0.0], 1, "", "", "", ""), (51, [1.0, 0.0], 2, "", "", "", "")], SCHEMA)
    assert hard_negatives.every_nth(alone).collect() == []  # no positive
    assert hard_negatives.every_nth(alone.where("vec_id = 51")).collect() == []


def test_the_walk_leaves_out_what_cannot_score(spark, monkeypatch):
    """Members of narrow clusters stop early, and what they have then is right."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 16)) * 300
    vecs = np.concatenate([c + rng.normal(size=(2000, 16)) * 5 for c in centres]).astype(np.int64)
    rows = hard_negatives.Rows.__new__(hard_negatives.Rows)
    rows.ids, rows.labels, rows.slots, rows.vectors = np.arange(8000), np.zeros(8000, np.int64), np.zeros(8000, np.int64), vecs
    members = hard_negatives.Rows.__new__(hard_negatives.Rows)
    members.ids, members.labels, members.vectors = np.arange(20), np.zeros(20, np.int64), vecs[:20]
    centre = learn_centres(vecs[:20].astype(np.float64), 1)[0]
    width = hard_negatives._angles(vecs[:20].astype(np.float64), centre).max()
    looked = []
    real = hard_negatives.products
    monkeypatch.setattr(hard_negatives, "products", lambda q, v: looked.append(len(q) * len(v)) or real(q, v))
    lists = hard_negatives.Lists(rows, centre, width, np.sqrt((vecs.astype(float) ** 2).sum(axis=1)))
    best = hard_negatives.walk_positives(lists, members, 5)
    assert sum(looked) < 20 * 8000 / 2
    for i in range(20):
        order = sorted((-int(s), j) for j, s in enumerate(vecs @ vecs[i]) if j != i)[:5]
        assert [(-int(s), int(j)) for s, j in zip(best.scores[i], best.ids[i])] == order


def test_bands_are_whole_numbers():
    low, high = bands(np.array([[7, 0, -3, 2**61]]), 50, 95)
    assert low.tolist() == [[4, 0, 1, 2**60]] and high.tolist() == [[6, 0, 0, 2**61 * 95 // 100]]


def test_best_keeps_ties_by_id():
    best = Best(2, 2)
    best.offer(np.array([0, 1]), np.array([[5, 5, 5], [hard_negatives._NONE, 1, hard_negatives._NONE]]), np.array([9, 3, 4]))
    best.offer(np.array([0]), np.array([[5, 4]]), np.array([1, 0]))
    assert best.ids[0].tolist() == [1, 3] and best.scores[1].tolist() == [1, hard_negatives._NONE]

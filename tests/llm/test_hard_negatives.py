"""Hard negatives and their scores against plain arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkstats.llm import hard_negatives as op
from linkstats.llm.hard_negatives import bit_planes, hard_negatives, scores, subset_sums

ROWS = "vec_id long, label int, embedding array<double>, rank string, score string"


def plain(rows, is_anchor, positives, negatives):
    """Result rows by exact inner products of all pairs."""
    usable = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v, *_ in rows
              if i is not None and label is not None and v is not None
              and all(x is not None and math.isfinite(256 * x) for x in v)]
    sizes = [len(q) for *_, q in usable]
    most = max(set(sizes), key=lambda n: (sizes.count(n), n), default=0)
    usable = [r for r in usable if len(r[2]) == most]
    first = {}
    for i, label, q in usable:
        if is_anchor(i):
            first[i] = min(first.get(i, (label, q)), (label, q))
    out = []
    for a, (label, q) in first.items():
        scored = sorted((-sum(x * y for x, y in zip(q, c)), i, kind) for i, kind, c in usable if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            near = [r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:negatives]
            out += [(a, p, n, i, *(max(-1 << 63, min(op.LONGS, -x)) for x in (s, t))) for n, (t, i, _) in enumerate(near, 1)]
    return sorted(out)


def vectors(n=400, size=13, spread=1.0, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, size)) * spread
    v = centres[rng.integers(0, 5, n)] + rng.standard_normal((n, size)) * spread / 2
    v[n // 4:n // 4 + 60] = v[n // 4]  # ties
    rows = [(i, int(rng.integers(0, 4)), v[i].tolist(), "clash", "") for i in range(n)]
    rows[n // 2:n * 5 // 6] = [(i, 1, v[i].tolist(), "", "") for i in range(n // 2, n * 5 // 6)]  # a third has one label
    return rows


BAD = [(1000, None, [1.0] * 13, "", ""), (1010, 1, None, "", ""), (1020, 1, [None] + [1.0] * 12, "", ""),
       (1030, 1, [math.nan] * 13, "", ""), (1040, 1, [math.inf] * 13, "", ""), (1050, 1, [1e306] * 13, "", ""),
       (1060, 1, [1.0], "", ""), (None, 1, [9.0] * 13, "", ""), (1070, 2, [0.0] * 13, "", "")]


def check(spark, data):
    got = hard_negatives(spark.createDataFrame(data, ROWS), F.col("vec_id") % 10 == 0, positives=4, negatives=3)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = sorted(map(tuple, got.collect()))
    assert found == plain(data, lambda i: i % 10 == 0, 4, 3)
    return found


def test_against_all_pairs(spark, monkeypatch):
    for name, value in (("STRIPE", 9), ("STRIPES_A_ROUND", 2), ("CHUNK", 50), ("ANCHORS_AT_ONCE", 4)):
        monkeypatch.setattr(op, name, value)
    rows = vectors()
    found = check(spark, rows + BAD + [(20, 3, rows[21][2], "again", ""), rows[33]])
    assert len(found) > 200


def test_numbers_of_any_size(spark):
    rows = vectors(90, 9)
    wide = [(i, k, [x * 10.0 ** (7 * (i % 4)) for x in v], a, b) for i, k, v, a, b in rows]
    assert any(abs(r[4]) < 1 << 40 for r in check(spark, wide[:90:2]))
    wide += [(500 + i, i % 2, [x * 1e290 for x in rows[i][2]], "", "") for i in range(20)]
    assert any(abs(r[4]) >= op.LONGS for r in check(spark, wide))


def test_lookups_give_inner_products():
    rng = np.random.default_rng(1)
    for size, high in ((1, 2), (8, 300), (21, 1 << 20)):
        anchors, rows = rng.integers(-high, high, (5, size)), rng.integers(-high, high, (40, size))
        found = scores(subset_sums(anchors), bit_planes(rows, op._bits(rows)))
        assert (found == rows @ anchors.T).all()


@pytest.mark.parametrize("data", [[], [(0, 1, [1.0], "", "")], [(0, 1, [], "", ""), (1, 1, [], "", ""), (2, 2, [], "", "")]])
def test_few_or_no_rows(spark, data):
    check(spark, data)

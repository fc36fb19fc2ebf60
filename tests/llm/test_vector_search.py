"""Vector search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from linkstats.llm import vector_search
from linkstats.llm.vector_search import encode, nearest, rotation

VECTORS = "vec_id long, embedding array<float>, score string"


def table(spark, n=600, size=24):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((n, size)).astype(np.float32)
    v[100:140] = v[100]  # ties
    rows = [(i, v[i].tolist(), "clash") for i in range(n)]
    bad = [(1000, None, ""), (1020, [0.0] * size, ""), (1040, [None] + [1.0] * (size - 1), ""),
           (1060, [float("nan")] * size, ""), (1080, [float("inf")] * size, ""), (1100, [1.0], ""), (None, v[0].tolist(), "")]
    return spark.createDataFrame(rows + bad + [(20, v[20].tolist(), "again")], VECTORS), v


def test_recall_ties_and_rows_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 9)
    monkeypatch.setattr(vector_search, "BLOCKS_A_JOB", 2)
    df, v = table(spark)
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    ids = np.append(np.arange(600), 20)
    every = np.vstack([v, v[20]]).astype(float)
    hits = 0
    for q, found in got.items():
        scores = (every * every[q]).sum(1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:10]
        hits += len({(int(ids[i]), n) for n, i in enumerate(order)} & {(i, r - 1) for r, i, _ in found})
        assert all(abs(s - (every[i] * every[q]).sum()) < 1e-12 for _, i, s in found)
        assert [r for r, _, _ in sorted(found)] == list(range(1, 11))
    assert hits / 300 >= 0.97


def test_fewer_candidates_than_asked_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [2.0, 0.0], "")], VECTORS)
    assert [tuple(r) for r in nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 2.0)]
    assert nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest(few.filter("vec_id = 1"), F.col("vec_id") % 20 == 0).count() == 0


def test_estimates_lie_within_their_bounds():
    rng = np.random.default_rng(8)
    v, q, centre = rng.standard_normal((2000, 64)), rng.standard_normal(64), np.full(64, 0.1)
    codes, length, own = encode(v, centre, rotation(64))
    signs = np.unpackbits(codes, axis=1, count=64) * 2.0 - 1
    estimate = length / own * (signs @ (q @ rotation(64))) / 8 + centre @ q
    bound = length * np.linalg.norm(q) * np.sqrt(1 - own ** 2) / own * 2.5 / np.sqrt(63)
    off = estimate - v @ q
    assert abs(off.mean()) < 0.2 and (np.abs(off) <= bound).mean() > 0.97


def test_vectors_of_any_magnitude(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((240, 16)) * 10.0 ** rng.integers(-30, 31, 240)[:, None]
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(240)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 240, 20):
        scores = (v * v[q]).sum(1)
        hits += len(got[q] & {int(i) for i in [i for i in np.lexsort((np.arange(240), -scores)) if i != q][:5]})
    assert hits >= 57

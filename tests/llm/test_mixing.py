"""Mixing: rates against a dense computation."""

import numpy as np
import pytest

from linkstats.llm.mixing import QUALITY_DOMAIN, _inverse, fit_domains, mix, rate_column, shares, solve_rates
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, rate string"
LABELS = "doc_id long, quality int, toxic int"


def test_rates_meet_targets_and_stay_near_one(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.6, 0.3, 0.2], 300)
    tokens = rng.integers(0, 500, 300)
    members = spark.createDataFrame([(int(t), x.tolist()) for t, x in zip(tokens, p)], "tokens long, posterior array<double>")
    for target in ([0.5, 0.3, 0.2], [0.05, 0.05, 0.9], [1.0, 0.0, 0.0]):
        steps = solve_rates(members, target)
        got = np.array([r[0] for r in members.select(rate_column(F.col("posterior"), steps)).collect()])
        share = (tokens * got) @ p / tokens.sum()
        assert (got >= 0).all()
        if target[0] < 1:
            assert np.abs(share - target).max() < 2e-3
            plain = 1 - p @ np.linalg.solve((p.T * tokens) @ p / tokens.sum(), tokens @ p / tokens.sum() - target)
            if (plain > 0).all():  # without a bound in play this is the least change
                assert np.abs(plain - got).max() < 1e-2
        else:
            assert share[1] + share[2] < (tokens @ p / tokens.sum())[1:].sum()


def test_classifier_edges_and_columns(spark):
    docs = [(i, "fine words here now " * 9 if i % 3 else "zz%% qq%% zz%% " * 9, "clash") for i in range(60)]
    docs += [(100, None, ""), (101, "", ""), (5, docs[5][1], "again"), (None, "fine words", "")]
    labels = [(i, int(i % 3 > 0), 0) for i in range(30)] + [(None, 1, 0), (40, None, None), (5, 1, 0)]
    out = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), {"good": 0.9, "poor": 0.1})
    assert out.columns == ["doc_id", "tokens", "posterior", "domain", "rate"]
    rows = out.collect()
    assert len(rows) == len(docs)
    assert all(r.domain == ("good" if r.doc_id % 3 else "poor") for r in rows if r.doc_id is not None and r.doc_id < 60)
    tokens, share = np.array([r.tokens for r in rows]), np.array([r.posterior for r in rows])
    got = (tokens * np.array([r.rate for r in rows])) @ share / tokens.sum()
    assert np.abs(got - [0.9, 0.1]).max() < 1e-3
    empty = next(r for r in rows if r.doc_id == 100)
    assert empty.tokens == 0 and abs(empty.posterior[0] - 21 / 31) < 1e-6  # document 5 occurs twice


def test_a_target_without_documents_stays_unfilled(spark):
    docs = spark.createDataFrame([(i, "fine words here " * 9 if i % 2 else "zz%% qq%% " * 9, "") for i in range(80)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], LABELS)
    targets = {"good": 0.2, "poor": 0.1, "toxic": 0.7}
    model = fit_domains(docs, labels, QUALITY_DOMAIN)
    got = {r.domain: (r.target, r.share, r.met) for r in shares(mix(docs, labels, targets), model.domains, targets).collect()}
    assert got["toxic"] == (0.7, 0.0, False)
    assert abs(got["good"][1] - 0.2) < 1e-3 and abs(got["poor"][1] - 0.1) < 1e-3 and got["good"][2] and got["poor"][2]
    none = shares(mix(docs.limit(0), labels, targets), model.domains, targets).collect()
    assert [(r.share, r.met) for r in none] == [(0.0, False)] * 3


def test_no_labels_no_documents_no_targets(spark):
    docs, labels = spark.createDataFrame([(1, "a b", "")], DOCS), spark.createDataFrame([(1, 1, 0)], LABELS)
    row = mix(docs, labels.limit(0), {"good": 1.0}).first()
    assert (row.domain, row.rate, row.posterior) == ("all", 1.0, [1.0])
    assert mix(docs.limit(0), labels, {"good": 1.0}).count() == 0
    with pytest.raises(ValueError, match="no target"):
        mix(docs, labels, {"poor": 1.0})


def test_inverse():
    a = np.array([[2.0, 0.3, 0.1], [0.3, 1.0, 0.2], [0.1, 0.2, 3.0]])
    assert np.allclose(_inverse(a.tolist()), np.linalg.inv(a))

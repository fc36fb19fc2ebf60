"""Quality: accuracies from agreement, and a scorer that ranks good above bad."""

import random

import numpy as np

from linkstats.llm.quality import (BAD, BUCKETS, GOOD, SHRINK, SILENT, _loss, features, posteriors, quality, vote_counts,
                                   votes, with_votes)
from tests.llm.helpers import prose

DOCS = "doc_id long, text string, score string"


def test_em_finds_good_and_bad_from_agreement():
    rng = random.Random(1)
    accuracy, counts, truth = [0.95, 0.9, 0.85, 0.8, 0.6], {}, {}
    for _ in range(20_000):
        good = rng.random() < 0.7
        pattern = "".join(SILENT if rng.random() < 0.3 else (GOOD if good == (rng.random() < a) else BAD) for a in accuracy)
        counts[pattern] = counts.get(pattern, 0) + 1
        truth.setdefault(pattern, []).append(good)
    p = posteriors(counts)
    right = sum((p[k] >= 0.5) == g for k, gs in truth.items() for g in gs) / 20_000
    best = sum(max(sum(gs), len(gs) - sum(gs)) for gs in truth.values()) / 20_000
    assert right > best - 0.01
    assert posteriors({}) == {}


def test_scores_rank_good_above_bad_and_edges(spark):
    rng = random.Random(2)
    docs = []
    for i in range(240):
        text = ". ".join(prose(rng, 12).capitalize() for _ in range(8)) + "."
        if i % 4 == 0:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", "%%% "), "same " * 90])
        docs.append((i, text, "clash"))
    docs += [(900, None, ""), (901, "", ""), (902, prose(rng, 20_000), ""), (3, docs[3][1], "again"), (None, "a b", "")]
    df = spark.createDataFrame(docs, DOCS)
    assert sum(vote_counts(with_votes(df)).values()) == len(docs)
    got = quality(df).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    clear = [r for r in got if r.doc_id is not None and r.doc_id < 240]
    assert sum(r.predicted == int(r.doc_id % 4 > 0) for r in clear) / len(clear) > 0.97
    assert quality(df.limit(0)).count() == 0


def some_docs(n=150):
    rng = random.Random(7)
    texts = [". ".join(prose(rng, 9).capitalize() for _ in range(rng.randrange(1, 9))) + "." for _ in range(n)]
    return [(i, t.upper().replace(" ", "!! ") if i % 3 == 0 else t, "") for i, t in enumerate(texts)]


def test_loss_and_gradient_against_one_machine(spark):
    marked = with_votes(spark.createDataFrame(some_docs(), DOCS).repartition(5))
    rng = np.random.default_rng(1)
    labels = {r.pattern: rng.random() for r in marked.select("pattern").distinct().orderBy("pattern").collect()}
    weights = rng.standard_normal(BUCKETS + 1)
    loss, gradient, curvature = _loss(marked, labels, weights)
    rows = marked.collect()
    x = features([r.text for r in rows]).astype(float)
    y = np.array([labels[r.pattern] for r in rows])
    p = 1 / (1 + np.exp(-x @ weights))
    plain = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean() + SHRINK / 2 * weights @ weights
    assert abs(loss - plain) < 1e-9
    assert np.abs(gradient - ((p - y) @ x / len(y) + SHRINK * weights)).max() < 1e-12
    assert np.abs(curvature - ((p * (1 - p)) @ x ** 2 / len(y) + SHRINK)).max() < 1e-12


def test_scores_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(some_docs(), DOCS)
    one, many = ({r.doc_id: r.score for r in quality(df.repartition(n)).collect()} for n in (1, 64))
    assert max(abs(one[i] - many[i]) for i in one) < 1e-9


def test_votes_of_short_texts():
    assert len({len(votes(t)) for t in (None, "", " ", "one", "one two three " * 30)}) == 1
    assert votes(None) == votes("") and set(votes("!")) <= {GOOD, BAD, SILENT}

"""Decontamination: literal, reworded and clean texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from linkstats.llm.decontaminate import _sum_rows, common_share, decontaminated, find_matches
from tests.llm.helpers import prose

DOCS = "doc_id long, text string, item_id string"


def test_leaks_are_found_and_clean_texts_stay(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, 24, 3000) + ". The answer is " + prose(rng, 4, 3000) + ".") for i in range(12)]
    benchmark = items + [(50, None), (51, ""), (52, "w1 w2"), (3, items[3][1])]
    docs = [(i, prose(rng, rng.randrange(5, 300), 3000), "") for i in range(150)]
    want = set()
    for i in range(12):
        words = items[i][1].split()
        if i % 3 == 1:
            words = [w for n, w in enumerate(words) if n % 9 != 4]  # words left out
        if i % 3 == 2:
            words = [x for n, w in enumerate(words) for x in ([w, "indeed"] if n % 7 == 3 else [w])]  # and put in
        docs.append((1000 + i, prose(rng, 70, 3000) + "\n" + " ".join(words).upper() + " " + prose(rng, 90, 3000), ""))
        want.add((1000 + i, i))
    want.add((None, 4))
    docs += [(None, prose(rng, 40, 3000) + " " + items[4][1], ""), (2000, None, ""), (2001, "", ""), (2002, prose(rng, 20_000, 3000), ""), (1000, items[0][1], "again"), (None, "w1", "")]
    df = spark.createDataFrame(docs, DOCS)
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    matches = find_matches(df, items, max_share=0.2)
    got = {(r.doc_id, r.item_id): r for r in matches.collect()}
    assert set(got) == want and all(r.lcs >= 0.6 and r.answer >= 0.5 for r in got.values())
    kept = decontaminated(df.withColumn("row", F.lit("a.b")).withColumnRenamed("item_id", "item.id"), items, max_share=0.2)
    assert kept.columns == ["doc_id", "text", "item.id", "row"] and kept.count() == len(docs) - 14


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "")], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert find_matches(docs, items.limit(0)).count() == 0
    assert find_matches(docs.limit(0), items).count() == 0
    assert [(r.doc_id, r.item_id) for r in find_matches(docs, items).collect()] == [(1, 1)]


def test_common_share_is_the_heaviest_common_subsequence():
    rng = random.Random(3)
    weights = np.array([0.5, 1.0, 2.0, 4.0, 0.0])
    for _ in range(100):
        a, b = [rng.randrange(4) for _ in range(rng.randrange(1, 8))], [rng.randrange(5) for _ in range(rng.randrange(9))]
        best = {(-1, -1): 0.0}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                best[i, j] = 0.0 if not i or not j else max(
                    best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + weights[a[i - 1]] * (a[i - 1] == b[j - 1]))
        got = common_share(np.array(a), np.array(b, dtype=int), weights)
        assert abs(got - best[len(a), len(b)] / weights[a].sum()) < 1e-12


def test_short_reworded_items_equal_all_pairs(spark):
    rng = random.Random(15)
    vocabulary = [f"w{i}" for i in range(6000)]
    zipf = [1 / (i + 3) for i in range(6000)]

    def text(n):
        return rng.choices(vocabulary, zipf, k=n)

    items = [(i, text(8 + i % 13)) for i in range(60)]
    docs = [(i, text(rng.randrange(60, 200))) for i in range(40)]
    for i, words in items:
        changed = set(rng.sample(range(len(words)), len(words) // 4))
        docs.append((1000 + i, text(90) + [text(1)[0] if n in changed else w for n, w in enumerate(words)] + text(90)))
    terms = {w: n for n, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
    numbers = {d: np.array([terms.get(w, len(terms)) for w in words]) for d, words in docs}
    blocks = [set(t[b:b + 32].tolist()) for t in numbers.values() for b in range(0, len(t), 32)]
    counts = np.array([sum(n in b for b in blocks) for n in range(len(terms))])
    weights = np.append(np.log((len(blocks) + 1) / (counts + 0.5)).clip(min=1e-3), 0.0)
    want = {}
    for i, words in items:
        item = np.array([terms[w] for w in words])
        for d, t in numbers.items():
            for b in range(0, len(t), 32):
                passage = t[max(0, b - len(item)):b + 64 + len(item)]
                if weights[item] @ np.isin(item, passage) >= 0.6 * weights[item].sum() - 1e-9 and (
                        np.isin(np.unique(item), passage).mean() >= 0.5):
                    share = common_share(item, passage, weights)
                    if share >= 0.6:
                        want[d, i] = max(share, want.get((d, i), 0))
    got = find_matches(spark.createDataFrame([(d, " ".join(w), "") for d, w in docs], DOCS),
                       spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.lcs for r in got.collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert sum((1000 + i, i) in want for i, _ in items) > 40


def test_sums_of_runs():
    rng = np.random.default_rng(3)
    table, rows = rng.standard_normal((50, 7)), rng.integers(0, 50, 400)
    starts = np.unique(np.append(0, rng.integers(0, 400, 60)))
    assert np.allclose(_sum_rows(table, rows, starts), np.add.reduceat(table[rows], starts, axis=0))
    assert np.allclose(_sum_rows(table, rows[:1], starts[:1]), table[rows[:1]])

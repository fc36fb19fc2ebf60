"""Near-duplicates against an all-pairs computation."""

import random

import pytest

from linkstats.llm import near_dedup
from linkstats.llm.components import connected_components
from linkstats.llm.near_dedup import near_duplicates, one_of_each, shingles

DOCS = "doc_id long, text string, component_id string"


def corpus():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "One", "one two", "one  two ", "É é", "é É"]
    for _ in range(6):
        base = [f"w{rng.randrange(300)}" for _ in range(60)]
        for _ in range(rng.choice([1, 4, 12])):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            texts.append(" ".join(copy))
    texts.append("long " * 30_000)
    return [(i, t, "clash") for i, t in enumerate(texts)] + [(4, "One", "again"), (None, "one", "no id")]


def expected(rows, words, percent):
    sets = {i: shingles(t, words) for i, t, _ in rows if i is not None}
    least = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= (least[a], least[b]) != (low, low)
            least[a] = least[b] = low
    return {i: (len(sets[i]), least[i], least[i] == i) for i in sets}


@pytest.mark.parametrize("small, block", [(32, 128), (2, 3)])
def test_components_equal_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus()
    got = near_duplicates(spark.createDataFrame(rows, DOCS), words=2).collect()
    assert len(got) == len(rows)
    want = expected(rows, 2, 80)
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_one_of_each_keeps_columns_and_lone_rows(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, None, "z"), (4, "", "z"), (None, "q", "n")]
    got = one_of_each(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "component_id"]
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 3, 4]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS), words=2).count() == 0


def test_signatures_under_the_distance_share_a_bucket(spark):
    rng = random.Random(1)
    base = [rng.randrange(65536) for _ in range(50)]
    rows = []
    for i in range(40):
        marks = list(base)
        for p in rng.sample(range(50), 19):  # fewer than 10 chunks * 2
            marks[p] ^= 1 + rng.randrange(65535)
        rows.append((i, b"".join(x.to_bytes(2, "little") for x in marks)))
    rows.append((99, b"".join(x.to_bytes(2, "little") for x in base)))
    keys = near_dedup.bucket_keys(spark.createDataFrame(rows, "node long, signature binary"), 10, 5, 1)
    at = {}
    for key, node in keys.collect():
        at.setdefault(node, set()).add(key)
    assert all(len(v) == 50 for v in at.values())
    assert all(at[i] & at[99] for i in range(40))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}

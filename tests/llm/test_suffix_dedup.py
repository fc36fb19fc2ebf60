"""Repeated strings against a window count."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkstats.llm import suffix_dedup
from linkstats.llm.suffix_dedup import covered, gram_hashes, least_positions, remove_repeats
from linkstats.llm.suffix_sort import Shard, Store

DOCS = "doc_id long, text string, kept int"


@pytest.mark.parametrize("memory", [1 << 28, 0])
def test_shard_finds_what_windows_find(memory):
    rng = random.Random(5)
    for _ in range(150):
        depth, letters = rng.choice([1, 2, 3, 5, 8]), rng.choice([1, 2, 3, 20, 250])
        base = bytes(rng.randrange(letters) for _ in range(rng.randrange(1, 60)))
        segments = []
        for _ in range(rng.randrange(1, 7)):
            at = rng.randrange(len(base))
            segments.append(base[at:at + rng.randrange(60)] * rng.choice([1, 1, 3]))
        count = Counter(s[i:i + depth] for s in segments for i in range(len(s) - depth + 1))
        shard = Shard(segments, depth, Store(memory))
        hit, at = shard.repeated(), 0
        for s in segments:
            want = [count[s[i:i + depth]] > 1 for i in range(len(s) - depth + 1)]
            assert hit[at:at + len(want)].tolist() == want
            at += len(s) + 1
        shard.store.close()


def expected(rows, depth):
    texts = [(t or "").encode() for _, t, _ in rows]
    count = Counter(b[i:i + depth] for b in texts for i in range(len(b) - depth + 1))
    out = []
    for (doc, _, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if count[b[i:i + depth]] > 1:
                gone[i:i + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), sum(k for k, _ in itertools.groupby(gone)), kept))
    return sorted(out, key=repr)


def test_texts_equal_the_window_count(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcé ") for _ in range(300)) for _ in range(4)]
    rows = [(i, "".join(b[a:a + rng.randrange(10, 120)] for b in rng.sample(base, 2) for a in [rng.randrange(200)]), 0)
            for i in range(25)]
    rows += [(90, None, 0), (91, "", 0), (92, "ab" * 200, 0), (93, "x" * 19, 0), (94, "same text twice, long enough", 0),
             (94, "same text twice, long enough", 1), (None, base[0][:80], 0)]
    got = remove_repeats(spark.createDataFrame(rows, DOCS), depth=20).collect()
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=repr) == expected(rows, 20)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], DOCS), depth=20).count() == 0


def test_hashes_and_least_positions():
    data = np.frombuffer(random.Random(1).randbytes(500) * 2, np.uint8)
    for size in (1, 2, 7, 64, 192):
        hashes = gram_hashes(data, size)
        assert len(hashes) == len(data) - size + 1 and (hashes[:501 - size] == hashes[500:1001 - size]).all()
        assert len(set(hashes[:500].tolist())) >= (200 if size == 1 else 495)
    values = np.array([5, 3, 3, 9, 1, 7], np.uint64) << np.uint64(40)
    assert least_positions(values, 3).tolist() == [1, 1, 4, 4]
    assert covered(np.array([0, 1, 5, 20]), 5) == [(0, 10), (20, 25)]


def test_an_anchor_with_many_contents_is_split(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    rng = random.Random(8)
    passage, longer = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (60, 110))
    rows = []
    for i in range(150):  # a border of each passage, in texts of their own
        left, right = ("".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(2))
        rows.append((i, left + (passage if i % 3 else longer[:90 + i % 20]) + right, 0))
    rows += [(900 + i, rows[i][1][20:], 0) for i in range(0, 40, 5)] + [(950, rows[1][1][40:150], 0)]
    df = spark.createDataFrame(rows, DOCS)
    keyed = df.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    _, lone = suffix_dedup.grouped(keyed, 80)
    sizes = [r[0] for r in lone.groupBy("anchor").agg(
        F.sum(F.col("last") - F.col("first") + 80).alias("bytes")).select("bytes").collect()]
    assert all(size <= 4000 for size in sizes)
    got = remove_repeats(df, depth=80).collect()
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=repr) == expected(rows, 80)


def test_the_segments_of_a_hot_anchor_are_split(spark, monkeypatch):
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefgh") for _ in range(50))
    rows = [(i, "".join(rng.choice("abcdefgh") for _ in range(90)), 0) for i in range(400)]
    rows += [(1000 + i, line * 40, 0) for i in range(100)]  # one line holds most of the segments
    plans = {}

    def kept(df, label):
        out = stage(df, label)
        again = df.filter(F.lit(True))
        again.collect()
        plans[label] = again._jdf.queryExecution().executedPlan().toString()
        return out

    stage = suffix_dedup.stage
    monkeypatch.setattr(suffix_dedup, "stage", kept)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.files.maxPartitionBytes": "16k", "spark.sql.files.openCostInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = remove_repeats(spark.createDataFrame(rows, DOCS).repartition(20), depth=80).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "skew=true" in plans["suffix-shared"]
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got), key=repr) == expected(rows, 80)

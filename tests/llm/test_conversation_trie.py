"""The trie of rebuilt conversations against rebuilding and walking them."""

import random
import re
import zlib
from hashlib import md5, sha256

import pytest
from pyspark.sql import functions as F

from linkstats.llm import conversation_trie as op
from linkstats.llm.conversation_trie import conversation_trie
from linkstats.llm.scan import running

ROWS = "conv_id long, turn int, role string, text string, depth string, pos string"


def head_of(c):
    return zlib.crc32(str(c).encode()) % 4


def base_of(c):
    return c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))


def plain(rows):
    turns = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn, role or "", text or ""))
    original = {c: [(r, t) for _, r, t in sorted(ts, key=lambda t: (
        t[0] is not None, t[0] or 0, md5(f"0:{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))] for c, ts in turns.items()}
    built = {c: original.get(base_of(c), [])[:head_of(c)] + ts[head_of(c):] for c, ts in original.items()}
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children = {}
    for prefix in members:
        if prefix:
            children.setdefault(prefix[:-1], []).append(prefix)

    def words(prefix):
        return len(re.findall(r"[^\x20\x09-\x0D]+", prefix[-1][1])) if prefix else 0

    out = []
    for prefix, who in members.items():
        below = [p for p in members if p[:len(prefix)] == prefix]
        ends = sorted(c for c in who if len(built[c]) == len(prefix))
        out.append((min(who), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(who),
                    len(children.get(prefix, [])), sum(p not in children for p in below),
                    sum((len(members[p]) - 1) * words(p) for p in below),
                    sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows):
    conv = F.col("conv_id")
    return conversation_trie(spark.createDataFrame(rows, ROWS), conv - conv % 20, F.crc32(conv.cast("string")) % 4)


def corpus():
    rng = random.Random(2)
    say = ["hi", "hi there", "  hi\tthere you\n", None, "", "Ümlaut\u00a0x y"]
    rows = []
    for c in [*range(-25, 70), 1000, 1001, 1 << 40]:
        if c not in (40, -20):  # bases that are absent
            rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(say), "clash", "") for t in range(rng.randrange(1, 7))]
    rows += [(7, t, "user", f"turn {t % 3}", "", "") for t in range(300)]  # ties with the others, and a third of all rows
    rows += [(20, None, "a", "first", "", ""), (21, None, "a", "first", "", ""), (None, 0, "a", "x", "", "")] * 2
    return rows


def test_against_rebuilding(spark, rows, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 4)
    data = corpus()
    got = trie(spark, data)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    assert rows(got) == plain(data)


@pytest.mark.parametrize("data", [[], [(None, 0, "a", "b", "", "")], [(41, 0, "a", "b", "", "")], [(0, 0, None, None, "", "")]])
def test_few_or_no_rows(spark, rows, data):
    assert rows(trie(spark, data)) == plain(data)


def test_weak_digests_are_found_out(spark, rows, monkeypatch):
    """The first digests put different turns under one; the check sees it and others are taken."""
    attempts = []

    def weak(attempt, whole=op.digest):
        attempts.append(attempt)
        if attempt == 0:
            return F.lpad(F.hex(F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(3))), 32, "0")
        return F.md5(F.concat(F.lit("0:"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))

    monkeypatch.setattr(op, "digest", weak)
    data = corpus()[:120]
    assert rows(trie(spark, data)) == plain(data)
    assert attempts == [0, 1]


def test_running_products_cross_partitions(spark):
    rng = random.Random(3)
    data = [(rng.choice([1, 5, 5, 5, 5, 9]), i, rng.randrange(1000)) for i in range(3000)]
    got = running(spark.createDataFrame(data, "k long, i long, v long").repartition(7), "k", [F.col("i").asc()], ["v"],
                  lambda a, b: (a[0] + b[0],), "test-running").collect()
    sums, expected = {}, {}
    for k, i, v in data:
        sums[k] = expected[i] = sums.get(k, 0) + v
    assert {r.i: r.v for r in got} == expected and len(got) == 3000

"""Line dedup against a plain computation."""

import hashlib
import random

from linkstats.llm.line_dedup import LineRuns, dedup_lines
from pyspark.sql import functions as F

LONG = "this line is long enough to be looked at, surely"
DOCS = "doc_id long, text string, n_lines string, H1 int"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def expected(rows, min_chars=40, min_docs=5):
    holders = {}
    for at, (doc, text, *_) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders.setdefault(k, []).append(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and doc != max(
            (d for d in holders[key(x)] if d is not None), default=None))]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(9)
    pool = [LONG, LONG.upper() + " ", "É" * 40, "é" * 40, "short", "", "x" * 39, *(f"{i} {LONG}" for i in range(6))]
    out = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))), "c", 1) for i in range(30)]
    return out + [(30, None, "c", 1), (31, "", "c", 1), (32, "\n\n", "c", 1), (None, LONG, "c", 1), (29, LONG, "again", 2),
                  (33, (LONG + "\n") * 3000, "very long", 3)]


def test_lines_equal_the_plain_computation(spark):
    for batches in (1, 4):
        got = dedup_lines(spark.createDataFrame(rows(), DOCS), batches=batches, fan_in=2)
        assert got.columns == ["doc_id", "H1", "text", "n_lines", "n_dropped"]
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == expected(rows())


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_are_compacted_and_settled_lines_stay_out(spark):
    runs = LineRuns(spark, fan_in=2)
    for n in range(5):
        runs.add(spark.createDataFrame([(100 - n, 1, 1), (100 - n, n, 7)], "doc_id long, h1 long, h2 long"), 2)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert tuple(runs.merged().filter("h2 = 1").first()) == (1, 1, 2, 100)


def test_digest_of_what_is_left(spark):
    got = dedup_lines(spark.createDataFrame([(1, None, "c", 1)], DOCS)).select(
        F.sha2(F.col("text").cast("binary"), 256)).first()[0]
    assert got == hashlib.sha256(b"").hexdigest()

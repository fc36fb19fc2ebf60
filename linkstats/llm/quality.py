"""Quality scores from weak labels.

Heuristic labellers look at one trait each and vote good, bad or nothing. Their accuracies are not known:
expectation maximisation estimates, from how their votes agree over all documents, how often every
labeller votes each way on good and on bad texts, and from that the probability that a text is good.
These posterior labels train a logistic scorer over hashed byte trigrams, which also judges texts on
which the labellers are silent.

The votes of all documents are counted by pattern (at most 3 to the power of the number of labellers,
whatever the input), and EM runs over these counts. The scorer is trained over all documents: in every pass
tasks add up the gradient over their documents, Spark adds up the tasks' sums, and one quasi-Newton step is taken.
Scores do not depend on how documents are partitioned, but for the last digits.

Defined results: a null text is an empty one; labellers for traits that a short text cannot show stay
silent on it. Without any document there are no rows and nothing is learned. Repeated documents are
scored alike and count as often as they occur.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstats.llm.common import arrow_batches, schema_of, stage

TEXTS_AT_ONCE, SHRINK, FLOOR, FIRST_REACH = 128, 1e-6, 1e-3, 1 / 32
BUCKETS = 1 << 12
GOOD, BAD, SILENT = "1", "0", "-"

# Byte classes.
_PLAIN = np.zeros(256, bool)
_PLAIN[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\t\r.,;:'\"?!()-/"]] = True
_PLAIN[128:] = True
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True

_HAS_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_RUN = re.compile(rb"([^\w\s.\x80-\xff-])\1\1|!!")


def _vote(good: bool, bad: bool) -> str:
    return GOOD if good else BAD if bad else SILENT


def votes(text: str | None) -> str:
    """One character per labeller: symbols, capitals, one word over and over, repeated lines, length,
    length of words, sentences, lone signs, runs of a sign, a word after
    itself, how often on end."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return SILENT * 4 + BAD + SILENT * 6
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    letters = max(1, int(counts[_LETTER].sum()))
    symbols = counts[~_PLAIN].sum() / len(data)
    capitals = counts[_UPPER].sum() / letters
    top = Counter(words).most_common(1)[0][1] / n
    lines = [x for x in data.split(b"\n") if x.strip()]
    again = 1 - len(set(lines)) / len(lines)
    mean = (len(data) - n) / n
    stops = (counts[46] + counts[63] + counts[33]) / n
    lone = sum(len(w) <= 3 and not _HAS_WORD.search(w) for w in words) / n
    runs = len(_RUN.findall(data)) / n
    same = bytes(map(bytes.__eq__, words, words[1:]))
    echoes, stutter = sum(same) / n, max(map(len, same.split(b"\0")))
    return "".join((
        _vote(symbols < 0.01, symbols > 0.05),
        _vote(capitals < 0.2, capitals > 0.5) if letters >= 20 else SILENT,
        _vote(top < 0.15, top > 0.3) if n >= 20 else SILENT,
        _vote(again < 0.05, again > 0.3) if len(lines) >= 4 else SILENT,
        _vote(n >= 50, n < 12),
        _vote(2.5 <= mean <= 9, not 1.5 <= mean <= 14) if n >= 12 else SILENT,
        _vote(0.01 <= stops <= 0.35, stops > 0.5 or stops < 0.002) if n >= 40 else SILENT,
        _vote(lone < 0.05, lone > 0.2) if n >= 12 else SILENT,
        _vote(runs < 0.01, runs > 0.1) if n >= 5 else SILENT,
        _vote(echoes < 0.02, echoes > 0.1) if n >= 12 else SILENT,
        _vote(stutter < 3, stutter >= 8) if n >= 12 else SILENT))


def with_votes(docs: DataFrame) -> DataFrame:
    """text and its pattern of votes."""
    schema = schema_of("text string, pattern string")

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            patterns = pa.array([votes(t.as_py()) for t in batch.column(0)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), patterns], names=["text", "pattern"])

    return docs.select("text").mapInArrow(rows, schema)


def vote_counts(marked: DataFrame) -> dict[str, int]:
    """Number of documents for every pattern of votes."""
    return {r["pattern"]: r["count"] for r in marked.groupBy("pattern").count().collect()}


def posteriors(counts: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Probability of good for every pattern, by expectation maximisation.

    It starts from a vote in which bad weighs six times as much as good, because labellers call a text
    bad only on an extreme, and texts are bad in ways that few labellers see."""
    if not counts:
        return {}
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    is_good = np.array([[c == GOOD for c in p] for p in patterns], float)
    is_bad = np.array([[c == BAD for c in p] for p in patterns], float)
    total = is_good.sum(1) + is_bad.sum(1)
    p = np.clip(0.5 + 0.9 * (is_good.sum(1) - 6 * is_bad.sum(1)) / np.maximum(total, 1), 0.02, 0.98)
    for _ in range(rounds):
        share = np.clip((n @ p + 1) / (n.sum() + 2), 1e-6, 1 - 1e-6)
        # How often a labeller that speaks votes good, on good and on bad texts; two made-up votes each,
        # so that a labeller is taken to be better than chance until the data say otherwise.
        on_good = ((n * p) @ is_good + 1.6) / ((n * p) @ (is_good + is_bad) + 2)
        on_bad = ((n * (1 - p)) @ is_good + 0.4) / ((n * (1 - p)) @ (is_good + is_bad) + 2)
        odds = (np.log(share / (1 - share)) + is_good @ np.log(on_good / on_bad)
                + is_bad @ np.log((1 - on_good) / (1 - on_bad)))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return dict(zip(patterns, p.tolist()))


def features(texts: list[str | None]) -> np.ndarray:
    """Hashed byte trigrams: logarithms of counts, scaled to length one, and a constant."""
    out = np.zeros((len(texts), BUCKETS + 1), np.float32)
    for i, text in enumerate(texts):
        data = np.frombuffer(f" {text or ''} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
        if len(data) >= 3:
            grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
            hashed = (grams * np.uint32(2654435761)) >> np.uint32(20)
            out[i, :BUCKETS] = np.log1p(np.bincount(hashed, minlength=BUCKETS))
    out /= np.maximum(np.linalg.norm(out, axis=1), 1e-9)[:, None]
    out[:, BUCKETS] = 1
    return out


def _loss(marked: DataFrame, labels: dict[str, float], weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean logistic loss over all texts, its gradient, and the curvature along every bucket.

    Tasks add up their texts; sums are taken in double precision, so the way the texts are dealt to tasks changes
    the last digits only."""
    schema = schema_of("bucket int, gradient double, curvature double")

    def rows(batches: Iterator) -> Iterator:
        gradient, curvature, loss, n = np.zeros(len(weights)), np.zeros(len(weights)), 0.0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                x = features(batch.column(0).slice(at, TEXTS_AT_ONCE).to_pylist()).astype(float)
                y = np.array([labels[v] for v in batch.column(1).slice(at, TEXTS_AT_ONCE).to_pylist()])
                sums = x @ weights
                p = 1 / (1 + np.exp(-np.clip(sums, -500, 500)))
                gradient += (p - y) @ x
                curvature += (p * (1 - p)) @ np.square(x, out=x)
                loss += float((np.logaddexp(0, sums) - y * sums).sum())
                n += len(y)
        held = np.flatnonzero(curvature)
        yield from arrow_batches(schema, [(int(j), float(gradient[j]), float(curvature[j])) for j in held] + [(-1, loss, float(n))],
                                 65536)

    gradient, curvature, loss, n = np.zeros(len(weights)), np.zeros(len(weights)), 0.0, 0.0
    for bucket, g, c in marked.mapInArrow(rows, schema).groupBy("bucket").agg(  # one row per bucket
            F.sum("gradient"), F.sum("curvature")).collect():
        if bucket < 0:
            loss, n = g, c
        else:
            gradient[bucket], curvature[bucket] = g, c
    n = max(n, 1.0)
    return loss / n + SHRINK / 2 * weights @ weights, gradient / n + SHRINK * weights, curvature / n + SHRINK


def _towards(gradient: np.ndarray, scale: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Quasi-Newton direction from the last steps and changes of the gradient (L-BFGS)."""
    rest, kept = gradient.copy(), []
    for step, change in reversed(steps):
        share = step @ rest / (step @ change)
        rest -= share * change
        kept.append(share)
    rest *= scale
    for (step, change), share in zip(steps, reversed(kept)):
        rest += (share - change @ rest / (step @ change)) * step
    return -rest


def train_scorer(marked: DataFrame, labels: dict[str, float], passes: int = 12) -> np.ndarray:
    """Weights of the scorer, fitted on every text with the posterior of its votes as label.

    Each pass sums the gradient over all texts, and the step is taken once, on the driver, so the result does not
    depend on how the texts are partitioned."""
    weights = np.zeros(BUCKETS + 1)
    loss, gradient, curvature = _loss(marked, labels, weights)
    scale = 1 / (curvature + FLOOR)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    ahead, reach = _towards(gradient, scale, steps), FIRST_REACH
    for _ in range(passes - 1):
        new = weights + reach * ahead
        new_loss, new_gradient, _ = _loss(marked, labels, new)
        if new_loss > loss + 1e-4 * reach * (gradient @ ahead):  # too far
            reach /= 4
            continue
        step, change = new - weights, new_gradient - gradient
        if step @ change > 1e-12 * (change @ change):
            steps = [*steps[-7:], (step, change)]
        weights, loss, gradient = new, new_loss, new_gradient
        ahead, reach = _towards(gradient, scale, steps), 1.0
        if np.abs(gradient).max() < 1e-7:
            break
    return weights


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score (0 to 1, higher: better) and predicted (1 from a half up)."""
    schema = schema_of("doc_id long, score double")

    def rows(batches: Iterator) -> Iterator:
        def each():
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for at in range(0, batch.num_rows, 256):
                    x = features(batch.column(1).slice(at, 256).to_pylist())
                    scores = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
                    yield from zip(ids[at:at + 256], scores.tolist())
        yield from arrow_batches(schema, each())

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality(docs: DataFrame) -> DataFrame:
    """Votes are stored beside the texts, as every round of training reads them again."""
    marked = stage(with_votes(docs), "quality-votes")
    return score_quality(docs, train_scorer(marked, posteriors(vote_counts(marked))))

"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, accents off, Greek and Cyrillic lookalikes to Latin letters, digits
and signs inside words to the letters they stand for; then only words are kept, one space between them.
The automaton finds all lexicon entries (whole words and word parts) in one pass. Hits inside an
exception phrase do not count. Every entry's hits are divided by the length of the text, so that a long
text needs more of them, and the score is the logistic of the weighted sum.

The lexicon is learned from labelled rows, by default from at most ``max_labelled`` of them, chosen by a
hash of their ids. Entries are all words (of up to ``WORD`` letters) and word parts that at least ``min_texts``
toxic texts hold, more than twice as often as clean ones do and by ``min_lift`` deviations more than expected, but
for those that stand beside a like entry in nearly the same texts. There is no limit on their number. Weights
come from a ridge logistic fit and are never negative; entries that tell nothing get none and leave.

Defined results: null, empty and wordless texts have no hits and get the score of a text without hits;
without labelled rows the lexicon is empty. Rows of ``labels`` with a null id or label are left out, and
of repeated labels the larger counts. Repeated documents are scored alike.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstats.llm.common import arrow_batches, held_out, schema_of, stage

# Letters of other scripts that look like Latin ones, and signs written for letters.
LOOKALIKES = dict(zip("абвгеёзіијкмнопрсѕтухԁьαβγεηικνορτυχω",
                      "abbree3iujkmhonpcstyxdbabyenikvoptuxw"))
SIGNS = str.maketrans("0134578@$!|", "oieastbasii")
GRAMS_HELD, WORD = 150_000, 40
EXCEPTIONS = ("class clown", "clown fish", "trash bag", "trash can", "white trash bag")

_WORD = re.compile(r"[@$]?[^\W_]+(?:[@$!|]+[^\W_]+)*")
_SIGNED = re.compile(r"[0134578@$!|]")


def _folds() -> dict[int, str]:
    """Base letters of Latin, Greek and Cyrillic letters with marks, then lookalikes."""
    table = {}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0xFF21, 0xFF5B)]:
        base = unicodedata.normalize("NFKD", chr(code).lower())[:1].lower()
        base = LOOKALIKES.get(base, base)
        if base and base != chr(code) and base.isalpha():
            table[code] = base
    return table


_FOLDS = _folds()


def _plain_word(word: str) -> str:
    """Signs become letters where the word has letters, so numbers stay numbers."""
    if not _SIGNED.search(word) or not any(c.isalpha() for c in word):
        return word
    return word.translate(SIGNS)


def fold(text: str | None) -> str:
    """Words of a folded text, each with a space on both sides."""
    if not text:
        return " "
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).translate(_FOLDS)
    words = _WORD.findall(text)
    if _SIGNED.search(text):
        words = [_plain_word(w) for w in words]
    return f" {' '.join(words)} " if words else " "


@dataclass(frozen=True)
class ToxicityModel:
    patterns: tuple[str, ...] = ()
    weights: tuple[float, ...] = ()
    bias: float = 0.0
    exceptions: tuple[str, ...] = field(default=EXCEPTIONS)

    def automaton(self):
        found = ahocorasick.Automaton()
        for i, p in enumerate(self.patterns):
            found.add_word(p, (i, len(p)))
        for p in self.exceptions:
            word = f" {p} "
            if word not in found:
                found.add_word(word, (-1, len(word)))
        found.make_automaton()
        return found

    def rates(self, automaton, text: str | None) -> np.ndarray:
        """Hits of every entry for its length: log(1 + hits in 1000 characters)."""
        folded = fold(text)
        counts = np.zeros(len(self.patterns))
        hits, ends, starts = [], [], []
        for end, (i, n) in automaton.iter(folded) if len(automaton) else ():
            if i >= 0:
                hits.append((end - n + 1, end, i))
            else:  # ends come in order
                ends.append(end)
                starts.append(end - n + 1)
        # a hit is sheltered if of the shelters that end no earlier one begins no later
        first = list(accumulate(reversed(starts), min))[::-1]
        for start, end, i in hits:
            at = bisect_left(ends, end)
            if at == len(ends) or first[at] > start:
                counts[i] += 1
        return np.log1p(1000.0 * counts / (len(folded) + 200.0))


def _grams(folded: str) -> set[str]:
    grams: set[str] = set()
    for word in set(folded.split()):
        if len(word) <= WORD:
            grams.add(f" {word} ")
        for n in (4, 5, 6):
            grams.update(word[i:i + n] for i in range(len(word) - n + 1))
    return grams


def _gram_counts(batches: Iterator, schema) -> Iterator:
    """Texts that hold each gram; counts are passed on whenever a task holds ``GRAMS_HELD`` of them."""
    toxic, clean = Counter(), Counter()

    def held():
        yield from arrow_batches(schema, ((g, toxic[g], clean[g]) for g in toxic.keys() | clean.keys()), 16384)
        toxic.clear()
        clean.clear()

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1)):
            (toxic if label.as_py() else clean).update(_grams(fold(text.as_py())))
            if len(toxic) + len(clean) >= GRAMS_HELD:
                yield from held()
    yield from held()


def _parts(core: str) -> Iterator[str]:
    return (core[a:b] for a in range(len(core)) for b in range(a + 4, len(core) + 1))


def _chosen(counts: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> list[str]:
    """Entries by lift, without those that hold an entry already chosen, or lie in one, and are about as frequent."""
    def lift(row):
        p, q = row[1] / n_toxic, (row[2] + 0.5) / (n_clean + 1)
        return (p - q) / (q * (1 - min(q, 0.999)) / n_toxic + 1 / n_toxic ** 2) ** 0.5
    chosen: list[str] = []
    of_entry: dict[str, list[int]] = {}  # hits of the entries with this core
    holding: dict[str, list[int]] = {}  # hits of the entries that hold this part
    for gram, hits, _ in sorted(counts, key=lambda r: (-lift(r), r[0])):
        core = gram.strip()
        near = [n for part in {core, *_parts(core)} for n in of_entry.get(part, ())] + holding.get(core, [])
        if not any(0.7 <= hits / n <= 1.4 for n in near):
            chosen.append(gram)
            of_entry.setdefault(core, []).append(hits)
            for part in set(_parts(core)):
                holding.setdefault(part, []).append(hits)
    return chosen


def _logistic(text: np.ndarray, entry: np.ndarray, rate: np.ndarray, n_entries: int, y: np.ndarray,
              ridge: float = 2.0) -> tuple[np.ndarray, float]:
    """Ridge logistic fit with weights of at least zero, from the ``rate`` of each ``entry`` in a ``text``.

    Steps go down a separable bound of the loss, with momentum that starts anew when it points upwards, so an
    entry costs as much as it has hits."""
    n = len(y)
    reach = np.bincount(text, rate, n) + 1.0
    bound = 0.25 * np.append(np.bincount(entry, rate * reach[text], n_entries), reach.sum()) + np.append(
        np.full(n_entries, ridge), 1e-3)
    prior = (y.sum() + 0.5) / (n + 2)
    w = ahead = np.append(np.zeros(n_entries), np.log(prior / (1 - prior)))
    pace = 1.0
    for _ in range(5000):
        sums = np.bincount(text, rate * ahead[entry], n) + ahead[-1]
        off = 1 / (1 + np.exp(-np.clip(sums, -30, 30))) - y
        gradient = np.append(np.bincount(entry, rate * off[text], n_entries) + ridge * ahead[:-1], off.sum() + 1e-3 * ahead[-1])
        new = ahead - gradient / bound
        new[:-1] = np.maximum(new[:-1], 0.0)
        step = new - w
        if (gradient @ step) > 0:
            pace = 1.0
        later = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        w, ahead, pace = new, new + (pace - 1) / later * step, later
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, min_texts: int = 4,
                 min_lift: float = 3.0, exceptions: tuple[str, ...] = EXCEPTIONS) -> ToxicityModel:
    """Learn the lexicon from labelled documents that are not held out."""
    chosen = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    # At most max_labelled rows of two numbers, so the side is of a proven size.
    rows = stage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label"),
                 "toxic-sample")
    n_toxic, n_clean = rows.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    if not n_toxic or not n_clean:
        return ToxicityModel(bias=float(np.log(0.25 / 0.75)), exceptions=exceptions)
    schema = schema_of("gram string, toxic long, clean long")
    counts = (rows.mapInArrow(lambda it: _gram_counts(it, schema), schema).groupBy("gram")
              .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
              .filter((F.col("toxic") >= min_texts)
                      & (F.col("toxic") * n_clean > 2 * F.col("clean") * n_toxic)))
    expected = (F.col("clean") + 0.5) * n_toxic / (n_clean + 1)
    telling = counts.filter(F.col("toxic") - expected >= min_lift * F.sqrt(expected + 1))
    patterns = _chosen([tuple(r) for r in telling.collect()], n_toxic, n_clean)
    if not patterns:
        return ToxicityModel(bias=float(np.log(n_toxic / n_clean)), exceptions=exceptions)
    model = ToxicityModel(tuple(patterns), (0.0,) * len(patterns), 0.0, exceptions)
    shape = schema_of("label int, entries binary, rates binary")

    def features(batches):
        automaton = model.automaton()

        def each():
            for batch in batches:
                for text, mark in zip(*batch.columns):
                    rates = model.rates(automaton, text.as_py())
                    own = np.flatnonzero(rates)
                    yield mark.as_py(), own.astype("<i4").tobytes(), rates[own].astype("<f4").tobytes()
        yield from arrow_batches(shape, each())

    sample = rows.mapInArrow(features, shape).collect()  # at most max_labelled rows, of the entries they hold
    entries = [np.frombuffer(r[1], "<i4") for r in sample]
    weights, bias = _logistic(np.repeat(np.arange(len(sample)), [len(e) for e in entries]), np.concatenate(entries),
                              np.concatenate([np.frombuffer(r[2], "<f4") for r in sample]).astype(float), len(patterns),
                              np.array([r[0] for r in sample], dtype=float))
    kept = [i for i in range(len(patterns)) if weights[i] > 0]
    return ToxicityModel(tuple(patterns[i] for i in kept), tuple(float(weights[i]) for i in kept), bias, exceptions)


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Score from 0 to 1, higher: likelier toxic."""
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton, weights = model.automaton(), np.array(model.weights)
        for texts in batches:
            sums = np.array([model.rates(automaton, t) @ weights for t in texts], dtype=np.float64) + model.bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -500, 500))))
    scores.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(scores, "double")(text)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``docs`` but score and predicted, which are replaced."""
    return docs.withColumn("score", toxicity_score(F.col("text"), model)).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))

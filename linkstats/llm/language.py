"""Language identification with spans for mixed-language texts.

Words are runs of letters. The script of a word, found by code point ranges, narrows the languages to
those written in it. Every word gets a score per language: the log-likelihood of its byte four-grams,
hashed into buckets. A Viterbi pass over the words, with a penalty for every switch of language, labels
them; runs of equal labels are the spans, and the language with most letters is the prediction.

All counts are taken over all labelled training texts. What reaches the driver is one count per language
and bucket. In a task, texts are handled in groups of at most ``GROUP`` rows and about ``GROUP_BYTES``.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and no spans, and so is
every text when there is nothing to learn from. Ties go to the language that sorts first. The score is
the share of letters (in bytes) in spans of the predicted language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstats.llm.common import arrow_batches, held_out, schema_of

BUCKETS = 1 << 15
GROUP, GROUP_BYTES, CHUNK_BYTES = 4096, 16 << 20, 1 << 20

# First code point of scripts, in order. A range ends where the next one begins.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3130, "Hangul"), (0x3400, "Han"),
    (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB50, "Arabic"), (0xFF21, "Latin"), (0x20000, "Han"))
_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = tuple(dict.fromkeys(n for _, n in SCRIPTS))
_SCRIPT_OF_RANGE = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])

_LETTERS = re.compile(r"[^\W\d_]+")


def _prepared(text: str | None) -> bytes:
    """Lower-case words in UTF-8 with a space on both sides; b"" for a text without letters."""
    words = _LETTERS.findall(text.lower()) if text else ()
    if not words or not any(c.isalpha() for c in (w[0] for w in words)):
        return b""
    return f" {' '.join(words)} ".encode("utf-8", "replace")


@dataclass
class _Words:
    """Words of several texts, laid end to end."""
    buckets: np.ndarray  # one gram for every byte
    begins: np.ndarray  # byte before each word
    sizes: np.ndarray  # bytes of each word
    scripts: np.ndarray
    counts: np.ndarray  # words of each text


def _words(texts: list[bytes]) -> _Words:
    data = np.frombuffer(b"".join(texts) + b"    ", np.uint8)
    wide = data.astype(np.uint32)
    grams = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    buckets = ((grams * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)
    space = data == 32
    begins = np.flatnonzero(space[:-4] & ~space[1:-3])
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lead = data[begins + 1].astype(np.int64)
    tail = [data[np.minimum(begins + k, len(data) - 1)].astype(np.int64) & 63 for k in (2, 3, 4)]
    points = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0],
                       [lead, (lead & 31) << 6 | tail[0], (lead & 15) << 12 | tail[0] << 6 | tail[1]],
                       (lead & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2])
    scripts = _SCRIPT_OF_RANGE[np.searchsorted(_STARTS, points, "right") - 1]
    edges = np.cumsum([0, *map(len, texts)])
    return _Words(buckets, begins, ends - begins - 1, scripts, np.diff(np.searchsorted(begins, edges)))


def _chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    scores: np.ndarray  # bucket, language: log-likelihood
    allowed: np.ndarray  # script, language
    penalty: float = 8.0

    def word_scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and sizes of all words, and the number of words of each text."""
        parts = []
        for chunk in _chunks(texts, max(1 << 16, (CHUNK_BYTES * 8) // max(8, len(self.langs)))):
            words = _words(chunk)
            if len(words.begins):
                scores = np.add.reduceat(self.scores[words.buckets], words.begins, axis=0)
                fits = self.allowed[words.scripts]
                scores[~fits & fits.any(axis=1, keepdims=True)] -= 60.0
            else:
                scores = np.zeros((0, len(self.langs)), np.float32)
            parts.append((scores, words.sizes, words.counts))
        return tuple(np.concatenate(p) for p in zip(*parts))

    def labels(self, scores: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Viterbi labels of all words; the texts are handled side by side."""
        order = np.argsort(-counts, kind="stable")
        base = (np.cumsum(counts) - counts)[order]
        lengths = counts[order]
        n = len(scores)
        switched = np.zeros((n, len(self.langs)), bool)
        source = np.zeros(n, np.int16)
        label = np.zeros(n, np.int16)
        active = int((lengths > 0).sum())
        v = scores[base[:active]].astype(np.float64)
        final = np.zeros(len(order), np.int16)
        rows = np.arange(len(order))
        alive = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
        for t in range(1, len(alive) + 1):
            k = int(alive[t]) if t < len(alive) else 0
            if k < active:
                final[k:active] = v[k:active].argmax(1)
                v, active = v[:k], k
            if not k:
                break
            at = base[:k] + t
            best = v.argmax(1)
            change = v[rows[:k], best][:, None] - self.penalty
            switch = v < change
            switched[at] = switch
            source[at] = best
            v = np.where(switch, change, v) + scores[at]
        state = final.copy()
        for t in range(len(alive) - 1, -1, -1):
            k = int(alive[t])
            at = base[:k] + t
            label[at] = state[:k]
            if t:
                back = switched[at, state[:k]]
                state[:k] = np.where(back, source[at], state[:k])
        return label


def _count_grams(batches: Iterator, schema) -> Iterator:
    """Counts of buckets, and of scripts below zero, for every language."""
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if data := _prepared(text):
                by_lang.setdefault(lang, []).append(data)
        for lang, texts in by_lang.items():
            grams, scripts = totals.setdefault(
                lang, (np.zeros(BUCKETS, np.int64), np.zeros(len(SCRIPT_NAMES), np.int64)))
            for chunk in _chunks(texts):
                words = _words(chunk)
                grams += np.bincount(words.buckets, minlength=BUCKETS)
                scripts += np.bincount(words.scripts, minlength=len(SCRIPT_NAMES))
    yield from arrow_batches(schema, (
        (lang, int(i) - shift, int(counts[i])) for lang, pair in totals.items()
        for counts, shift in zip(pair, (0, len(SCRIPT_NAMES))) for i in np.flatnonzero(counts)), 65536)


def fit_language(docs: DataFrame, penalty: float = 8.0, smoothing: float = 0.5,
                 script_share: float = 0.01) -> LanguageModel | None:
    """Learn from text and lang of all documents that are not held out; None without any."""
    schema = schema_of("lang string, bucket int, n long")
    counts = (docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
              .select("text", "lang").mapInArrow(lambda it: _count_grams(it, schema), schema)
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))).toPandas()  # one row per language and bucket
    langs = tuple(sorted(counts["lang"].unique()))
    if not langs:
        return None
    column = {lang: i for i, lang in enumerate(langs)}
    grams = np.zeros((BUCKETS, len(langs)))
    scripts = np.zeros((len(SCRIPT_NAMES), len(langs)))
    at = counts["lang"].map(column).to_numpy()
    bucket, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    seen = bucket >= 0
    grams[bucket[seen], at[seen]] = n[seen]
    scripts[bucket[~seen] + len(SCRIPT_NAMES), at[~seen]] = n[~seen]
    scores = np.log((grams + smoothing) / (grams.sum(0) + smoothing * BUCKETS)).astype(np.float32)
    allowed = scripts >= script_share * np.maximum(scripts.sum(0), 1)
    return LanguageModel(langs, scores, allowed, penalty)


SPANS = ("lang_pred string, score double, span_lang array<string>, span_from array<int>, span_to array<int>")


def _predicted(model: LanguageModel | None, texts: list[str | None], spans: bool) -> Iterator[tuple]:
    data = [_prepared(t) for t in texts]
    if model is None or not any(data):
        yield from (("und", 0.0, [], [], []) for _ in texts)
        return
    scores, sizes, counts = model.word_scores(data)
    labels = model.labels(scores, counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    width = len(model.langs)
    letters = np.bincount(owner * width + labels, weights=sizes, minlength=len(texts) * width).reshape(-1, width)
    best, totals = letters.argmax(1), letters.sum(1)
    begin = np.cumsum(counts) - counts
    for i in range(len(texts)):
        if not counts[i]:
            yield "und", 0.0, [], [], []
            continue
        runs: tuple[list, list, list] = [], [], []
        if spans:
            own = labels[begin[i]:begin[i] + counts[i]]
            cut = np.flatnonzero(np.diff(own)) + 1
            runs = ([model.langs[x] for x in own[np.append(0, cut)]], np.append(0, cut).tolist(),
                    np.append(cut, len(own)).tolist())
        yield model.langs[best[i]], float(letters[i, best[i]] / totals[i]), *runs


def predict_language(docs: DataFrame, model: LanguageModel | None, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and the spans of words (from, to) with their languages."""
    schema = schema_of("doc_id long, " + SPANS)

    def rows(batches: Iterator) -> Iterator:
        def each():
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                held: list[int] = []
                size = 0
                for i, text in enumerate(texts):
                    held.append(i)
                    size += len(text or "")
                    if len(held) == GROUP or size >= GROUP_BYTES or i + 1 == len(texts):
                        for j, found in zip(held, _predicted(model, [texts[j] for j in held], spans)):
                            yield (ids[j], *found)
                        held, size = [], 0
        yield from arrow_batches(schema, each())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)

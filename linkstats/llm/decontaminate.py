"""Benchmark decontamination by latent semantic retrieval.

Passages of documents are TF-IDF vectors over the benchmark's own words (no other word can add to a
product with an item). A randomised SVD, run over all passages, gives the latent space: every task adds
up its share of A'(A Omega), Spark sums the shares, and the small sum is factored on the driver (Nystroem
form of the randomised SVD, one pass over the passages). Every passage is then compared by cosine with
every item, in that space. Candidates are decided by the longest common subsequence of item and passage,
weighted by inverse document frequency, and by the share of the item's answer (its last sentence) that
the passage has, so reworded and interrupted copies count as well as literal ones.

A short item fills little of a passage, so its cosine may be low however much of it is there. The gate
therefore also follows from the decision: a common subsequence of ``min_lcs`` needs words of that weight in
the passage and an item's length around it, and all pairs that have them are candidates whatever their
cosine. No pair that the decision accepts is left out; the rows are those of all pairs compared in full.

The benchmark is taken in blocks of at most ``ITEMS_A_BLOCK`` items. An item block with its words, and
the factors over those words, are all that goes to the tasks or the driver. A passage is ``2 * STRIDE``
words; passages begin every ``STRIDE`` words, so whole texts are covered.

Defined results: null and wordless texts and items take no part, nor do items of under ``min_words``
words. Repeated documents and items each get their rows. A null document or item id stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstats.llm.common import arrow_batches, schema_of, stage

STRIDE, ITEMS_A_BLOCK, TOKENS_AT_ONCE, RAREST = 32, 20_000, 100_000, 8
PASSAGES_AT_ONCE, ITEMS_AT_ONCE, HITS_AT_ONCE = 4096, 1024, 1 << 21

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"[^.!?\n]*\w[^.!?\n]*")

MATCHES = "doc_id long, item_id long, cosine double, lcs double, answer double"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class _Items:
    ids: list
    words: list[np.ndarray]  # term numbers in order
    answers: list[np.ndarray]  # distinct term numbers of the last sentence
    terms: dict[str, int]


def _items(rows: list, min_words: int) -> _Items:
    terms: dict[str, int] = {}
    out = _Items([], [], [], terms)
    for item, text in rows:
        words = words_of(text)
        if len(words) >= min_words:
            out.ids.append(item)
            out.words.append(np.array([terms.setdefault(w, len(terms)) for w in words]))
            last = words_of(_SENTENCE.findall(text)[-1])
            out.answers.append(np.unique([terms[w] for w in last if w in terms]))
    return out


def _tokens(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """doc_id and the term numbers of all its words; ``len(terms)`` stands for any other word."""
    schema = schema_of("doc_id long, tokens binary")
    kind = np.uint16 if len(terms) < 65535 else np.uint32

    def rows(batches: Iterator) -> Iterator:
        other = len(terms)

        def each():
            for batch in batches:
                for doc, text in zip(*batch.columns):
                    found = [terms.get(w, other) for w in words_of(text.as_py())]
                    yield doc.as_py(), np.array(found, kind).tobytes()
        yield from arrow_batches(schema, each())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def _groups(batches: Iterator, kind) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Documents in groups of bounded size."""
    ids, tokens, size = [], [], 0
    for batch in batches:
        for doc, data in zip(*batch.columns):
            ids.append(doc.as_py())
            tokens.append(np.frombuffer(data.as_py(), kind))
            size += len(tokens[-1])
            if size >= TOKENS_AT_ONCE:
                yield ids, tokens
                ids, tokens, size = [], [], 0
    if ids:
        yield ids, tokens


def _blocks(tokens: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens end to end, the block of ``STRIDE`` words of each, and the first block of each text."""
    lengths = np.array([len(t) for t in tokens])
    counts = -(-lengths // STRIDE)
    first = np.cumsum(counts) - counts
    flat = np.concatenate(tokens).astype(np.int64)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return flat, np.repeat(first, lengths) + inside // STRIDE, np.append(first, counts.sum())


def _sum_rows(table: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``table[rows]`` over the runs of ``rows`` that begin at ``starts``, run by run in order. The first rows
    of all runs are taken at once, then the second ones of those that have any, and so on."""
    lengths = np.diff(np.append(starts, len(rows)))
    longest_first = np.argsort(-lengths, kind="stable")
    more = np.searchsorted(-lengths[longest_first], -np.arange(lengths.max()), side="left")
    out = table[rows[starts]]
    for j in range(1, len(more)):
        runs = longest_first[:more[j]]
        out[runs] += table[rows[starts[runs] + j]]
    return out


def _block_sums(flat: np.ndarray, block: np.ndarray, n_blocks: int, factors: np.ndarray,
                keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the factors of each block's words; and the words that were counted, with their blocks."""
    used = keep[flat]
    terms, block = flat[used], block[used]
    out = np.zeros((n_blocks, factors.shape[1]), np.float32)
    if len(terms):
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        out[block[starts]] = _sum_rows(factors, terms, starts)
    return out, terms, block


def _passage_counts(tokens: DataFrame, n_terms: int, kind) -> tuple[int, np.ndarray]:
    """Number of blocks, and of blocks that hold each term."""
    schema = schema_of("term int, n long")

    def rows(batches: Iterator) -> Iterator:
        counts = np.zeros(n_terms + 1, np.int64)
        for _, texts in _groups(batches, kind):
            flat, block, first = _blocks(texts)
            pairs = np.unique(block * (n_terms + 1) + flat)
            counts += np.bincount(pairs % (n_terms + 1), minlength=n_terms + 1)
            counts[n_terms] += first[-1] - (pairs % (n_terms + 1) == n_terms).sum()
        yield from arrow_batches(schema, ((int(t), int(counts[t])) for t in np.flatnonzero(counts)), 65536)

    sums = tokens.select("doc_id", "tokens").mapInArrow(rows, schema).groupBy("term").agg(F.sum("n")).collect()
    counts = np.zeros(n_terms + 1, np.int64)
    for term, n in sums:
        counts[term] = n
    return int(counts[-1]), counts[:-1]


def latent_space(tokens: DataFrame, idf: np.ndarray, keep: np.ndarray, kind, rank: int, seed: int = 17) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF matrix, one column per direction."""
    n = len(idf)
    width = min(n, rank + 8)
    sketch = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    schema = schema_of("term int, " + ", ".join(f"z{j} float" for j in range(width)))

    def rows(batches: Iterator) -> Iterator:
        total = np.zeros((n, width))
        factors = np.vstack([idf[:, None] * sketch, np.zeros((1, width))]).astype(np.float32)
        for _, texts in _groups(batches, kind):
            flat, block, first = _blocks(texts)
            sums, terms, at = _block_sums(flat, block, int(first[-1]), factors, np.append(keep, False))
            if len(terms):  # a term's weight is the same in every passage, so it comes last
                order = np.argsort(terms, kind="stable")
                starts = np.flatnonzero(np.diff(terms[order], prepend=-1))
                total[terms[order[starts]]] += _sum_rows(sums, at[order], starts)
        total *= idf[:, None]
        held = np.flatnonzero(total.any(axis=1))
        yield from arrow_batches(schema, ((int(t), *map(float, total[t])) for t in held))

    sums = (tokens.select("doc_id", "tokens").mapInArrow(rows, schema).groupBy("term")
            .agg(*[F.sum(f"z{j}") for j in range(width)]).collect())  # one row per word of the item block
    z = np.zeros((n, width))
    for r in sums:
        z[r[0]] = r[1:]
    shift = np.finfo(float).eps * np.sqrt(n) * max(np.linalg.norm(z), 1e-30)
    z += shift * sketch
    middle = sketch.T @ z
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    good = values > values.max() * 1e-12
    half = z @ vectors[:, good] / np.sqrt(values[good])
    return np.linalg.svd(half, full_matrices=False)[0][:, :rank]


def common_share(item: np.ndarray, passage: np.ndarray, weights: np.ndarray) -> float:
    """Weight of the longest (heaviest) common subsequence, as a share of the item's weight."""
    best = np.zeros(len(passage) + 1)
    for term in item:
        grown = np.append(0.0, best[:-1] + np.where(passage == term, weights[term], -np.inf))
        best = np.maximum.accumulate(np.maximum(best, grown))
    return float(best[-1] / weights[item].sum())


def _by_row(rows: np.ndarray, columns: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else []
    yield from zip(rows[starts].tolist() if len(rows) else (), np.split(columns, starts[1:]) if len(rows) else ())


@dataclass
class _Holders:
    """Items ``first``.. and the words that tell of them, as lists of items by word."""

    first: int
    starts: np.ndarray  # of each word's list
    items: np.ndarray
    shares: np.ndarray  # of the item's weight
    needed: np.ndarray  # share that a match has in these words at least
    reach: np.ndarray  # blocks around the passage that a match may touch


def _holders(sequences: list[np.ndarray], weights: np.ndarray, counts: np.ndarray, min_lcs: float) -> list[_Holders]:
    """An item's commonest words, up to half of ``min_lcs`` of its weight, are not looked up: a match has the
    rest of ``min_lcs`` in its other words."""
    out = []
    for first in range(0, len(sequences), ITEMS_AT_ONCE):
        terms, items, shares, needed, reach = [], [], [], [], []
        for i, sequence in enumerate(sequences[first:first + ITEMS_AT_ONCE]):
            own, times = np.unique(sequence, return_counts=True)
            share = times * weights[own] / weights[sequence].sum()
            order = np.argsort(-counts[own], kind="stable")
            own, sums = own[order], np.cumsum(share[order])
            skip = int(np.searchsorted(sums, min_lcs / 2, side="right"))
            terms.append(own[skip:])
            items.append(np.full(len(own) - skip, i))
            shares.append(share[order][skip:])
            needed.append(min_lcs - (sums[skip - 1] if skip else 0.0) - 1e-9)
            reach.append(-(-len(sequence) // STRIDE))
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        out.append(_Holders(first, np.searchsorted(term[order], np.arange(len(weights) + 1)),
                            np.concatenate(items)[order], np.concatenate(shares)[order], np.array(needed), np.array(reach)))
    return out


def _by_words(terms: np.ndarray, block: np.ndarray, begin: int, end: int,
              holders: list[_Holders]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (passage - begin, item) that have the words for a match, of passages ``begin`` to ``end``.
    A word in several blocks of the passage counts several times, so there may be more, but not fewer."""
    passages, chosen = [], []
    for held in holders:
        far, n = int(held.reach.max()), len(held.needed)
        low, high = begin - far, end + 1 + far
        a, b = np.searchsorted(block, (low, high))
        sizes = held.starts[terms[a:b] + 1] - held.starts[terms[a:b]]
        found = np.flatnonzero(sizes)
        term, at, sizes = terms[a:b][found], block[a:b][found] - low, sizes[found]
        sums = np.zeros((high - low + 1) * n)
        done = np.append(0, np.cumsum(sizes))
        cut = 0
        while cut < len(term):
            stop = max(cut + 1, int(np.searchsorted(done, done[cut] + HITS_AT_ONCE, side="right")) - 1)
            size = sizes[cut:stop]
            entry = (np.arange(size.sum()) - np.repeat(done[cut:stop] - done[cut], size)
                     + np.repeat(held.starts[term[cut:stop]], size))
            sums += np.bincount((np.repeat(at[cut:stop], size) + 1) * n + held.items[entry], held.shares[entry], len(sums))
            cut = stop
        sums = np.cumsum(sums.reshape(-1, n), axis=0, out=sums.reshape(-1, n))
        for reach in np.unique(held.reach):
            own = np.flatnonzero(held.reach == reach)
            p = np.arange(end - begin) + far
            p, i = np.nonzero(sums[p + 2 + reach][:, own] - sums[p - reach][:, own] >= held.needed[own] - 1e-6)
            passages.append(p)
            chosen.append(own[i] + held.first)
    return np.concatenate(passages), np.concatenate(chosen)


def find_matches(docs: DataFrame, benchmark: DataFrame, rank: int = 256, min_cosine: float = 0.4,
                 min_lcs: float = 0.6, min_answer: float = 0.5, min_words: int = 5,
                 max_share: float = 0.005) -> DataFrame:
    """doc_id, item_id, cosine, lcs and answer share of documents that hold a benchmark item.

    ``max_share``: words found in more than this share of all blocks of ``STRIDE`` words span no latent
    direction, but for the ``RAREST`` rarest of every item. They count in the subsequence and the answer.
    ``min_cosine``: pairs from it on are candidates by cosine, those below it by their words."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull())
    blocks = max(1, -(-items.count() // ITEMS_A_BLOCK))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        block = _items([(r["item_id"], r["text"]) for r in numbered.filter(F.col("block") == b).collect()], min_words)
        if block.ids:
            parts.append(_match_block(docs, block, rank, min_cosine, min_lcs, min_answer, max_share))
    if not parts:
        return spark.createDataFrame([], schema_of(MATCHES))
    return reduce(DataFrame.union, parts)


def _match_block(docs: DataFrame, items: _Items, rank: int, min_cosine: float, min_lcs: float, min_answer: float,
                 max_share: float) -> DataFrame:
    n_terms = len(items.terms)
    kind = np.uint16 if n_terms < 65535 else np.uint32
    tokens = stage(_tokens(docs, items.terms), "passage-tokens")
    passages, counts = _passage_counts(tokens, n_terms, kind)
    idf = np.log((passages + 1) / (counts + 0.5)).clip(min=1e-3)
    keep = counts <= max_share * passages
    for sequence in items.words:
        own = np.unique(sequence)
        keep[own[np.argsort(counts[own], kind="stable")][:RAREST]] = True
    basis = latent_space(tokens, idf, keep, kind, rank)
    factors = np.vstack([idf[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)
    keep = np.append(keep, False)
    asked = np.array([factors[w[keep[w]]].sum(axis=0) for w in items.words])
    asked /= np.maximum(np.linalg.norm(asked, axis=1), 1e-9)[:, None]
    weights = np.append(idf, 0.0)
    ids, sequences, answers = items.ids, items.words, items.answers
    totals = [weights[w].sum() for w in sequences]
    holders = _holders(sequences, weights, counts, min_lcs)
    schema = schema_of(MATCHES)

    def decided(text: np.ndarray, begin: int, chosen: np.ndarray) -> Iterator[tuple]:
        """Items among ``chosen`` that the passage at ``begin`` holds."""
        longest = max(len(sequences[i]) for i in chosen)
        around = text[max(0, begin - longest):begin + 2 * STRIDE + longest].astype(np.int64)
        has = np.zeros(len(weights), bool)
        has[around] = True
        has[-1] = False
        for i in chosen:
            if weights[sequences[i]] @ has[sequences[i]] < min_lcs * totals[i]:
                continue
            span = len(sequences[i])
            passage = text[max(0, begin - span):begin + 2 * STRIDE + span].astype(np.int64)
            if weights[sequences[i]] @ np.isin(sequences[i], passage) < min_lcs * totals[i]:
                continue
            answer = float(np.isin(answers[i], passage).mean()) if len(answers[i]) else 1.0
            if answer < min_answer:
                continue
            share = common_share(sequences[i], passage, weights)
            if share >= min_lcs:
                yield i, share, answer

    def rows(batches: Iterator) -> Iterator:
        def each():
            for docs_in, texts in _groups(batches, kind):
                flat, block, first = _blocks(texts)
                if not len(flat):
                    continue
                sums, _, _ = _block_sums(flat, block, int(first[-1]), factors, keep)
                owner = np.repeat(np.arange(len(texts)), np.diff(first))
                near = sums.copy()
                same = owner[1:] == owner[:-1]
                near[:-1][same] += sums[1:][same]
                near /= np.maximum(np.linalg.norm(near, axis=1), 1e-9)[:, None]
                known = flat < n_terms
                pairs = np.unique(block[known] * n_terms + flat[known])
                for at in range(0, len(near), PASSAGES_AT_ONCE):
                    cosines = near[at:at + PASSAGES_AT_ONCE] @ asked.T
                    wanted = cosines >= min_cosine
                    wanted[_by_words(pairs % n_terms, pairs // n_terms, at, at + len(cosines), holders)] = True
                    for p, chosen in _by_row(*np.nonzero(wanted)):
                        text = owner[at + p]
                        begin = int(at + p - first[text]) * STRIDE
                        for i, share, answer in decided(texts[text], begin, chosen):
                            yield docs_in[text], ids[i], float(cosines[p, i]), share, answer
        yield from arrow_batches(schema, each())

    # A long text may show an item at several places.
    return (tokens.mapInArrow(rows, schema).groupBy("doc_id", "item_id")
            .agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns. A row is told by its id and its text, so rows
    without id are judged like others, and of rows that share an id each is judged by its own text."""
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    found = find_matches(docs.select(row.alias("doc_id"), "text"), benchmark, **options)
    leaks = stage(found.select(F.col("doc_id").alias("row")).distinct(), "leaks")
    return docs.join(leaks, row == leaks["row"], "left_anti")

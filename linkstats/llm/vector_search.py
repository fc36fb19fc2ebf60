"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is centred, scaled to length one and turned by one random rotation; the signs are its code
of one bit per dimension. Kept beside the code are the length that was divided out and the code's own
inner product with the vector it stands for. From these a query's inner product with every vector is
estimated without bias, with a bound on the error: a vector is reranked on its original components when
its bound reaches the query's k-th best exact score so far.

Queries are handled in blocks of about ``QUERY_BLOCK``; a block goes to every task that reads a part of
the index, and ``BLOCKS_A_JOB`` blocks make one Spark job. Nothing else is broadcast. The centre is the
mean of at most ``max_sample`` vectors, chosen by a hash of their ids; every vector is indexed.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do
vectors without id and those of another length than most (the longer length on a tie). Rows that share an
id are separate candidates, none of them for a query with that id, and each asks for itself once: of
queries with one id the first vector by value is taken. Equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkstats.llm.common import arrow_batches, schema_of, stage

QUERY_BLOCK, BLOCKS_A_JOB, ROWS_AT_ONCE = 2048, 8, 4096


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id and double components of the vectors that take part, and their length."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0))
    most = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    size = most["n"] if most else 0
    return v.filter(F.size("v") == size), size


def rotation(size: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and inner products of each code with its vector."""
    rest = vectors - centre
    length = np.linalg.norm(rest, axis=1)
    turned = (rest / np.where(length > 0, length, 1)[:, None]) @ turn
    own = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, own, 1.0)


class _Best:
    """The k best (score, id) pairs of every query of a block."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = [np.empty(0)] * queries
        self.ids = [np.empty(0, np.int64)] * queries

    def bar(self, q: int) -> float:
        return self.scores[q][-1] if len(self.scores[q]) == self.k else -np.inf

    def put(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.ids[q], ids])
        order = np.lexsort((ids, -scores))[:self.k]
        self.scores[q], self.ids[q] = scores[order], ids[order]


def _scan(best: _Best, ask_ids: np.ndarray, ask: np.ndarray, turned: np.ndarray, middle: np.ndarray,
          ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray,
          width: float) -> None:
    """Compare a block of queries with a block of vectors."""
    size = vectors.shape[1]
    signs = np.unpackbits(codes, axis=1, count=size) * 2.0 - 1
    scale = length / (own * np.sqrt(size))
    with np.errstate(over="ignore", invalid="ignore"):  # what leaves the range of doubles is reranked
        estimates = turned @ (signs * scale[:, None]).T + middle[:, None]
        slack = length * np.sqrt(np.maximum(1 - own ** 2, 0)) / own * width / np.sqrt(max(size - 1, 1))
    norms = np.linalg.norm(ask, axis=1)
    for q in range(len(ask)):
        def exact(at, q=q):
            at = at[ids[at] != ask_ids[q]]
            best.put(q, (vectors[at] * ask[q]).sum(axis=1), ids[at])
        seen = np.empty(0, np.int64)
        if best.bar(q) == -np.inf:  # the likeliest first, for a bar
            take = min(best.k + 1, len(ids))
            seen = np.argpartition(-estimates[q], take - 1)[:take]
            exact(seen)
        # a little for what rounding may lose; what is no number is not below the bar
        bar = best.bar(q) - 1e-9 * abs(best.bar(q) if np.isfinite(best.bar(q)) else 0)
        chosen = ~(estimates[q] + slack * (norms[q] * 1.000001) < bar)
        chosen[seen] = False
        if chosen.any():
            exact(np.flatnonzero(chosen))


def build_index(vectors: DataFrame, size: int, max_sample: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """vec_id, components and code of every vector, stored; and the centre."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).select("v").collect()
    centre = np.mean([r[0] for r in sample], axis=0) if sample else np.zeros(size)
    turn = rotation(size) if size else np.zeros((0, 0))
    schema = schema_of("vec_id long, vector binary, code binary, length double, own double")

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                codes, length, own = encode(v, centre, turn)
                yield from arrow_batches(schema, zip(batch.column(0).to_pylist(), map(bytes, v),
                                                     map(bytes, codes), length.tolist(), own.tolist()))

    return stage(vectors.mapInArrow(rows, schema), "vector-index"), centre


def _search_block(index: DataFrame, ask_ids: np.ndarray, ask: np.ndarray, centre: np.ndarray, k: int,
                  width: float) -> DataFrame:
    schema = schema_of("query_id long, vec_id long, score double")
    size = ask.shape[1]

    def rows(batches: Iterator) -> Iterator:
        turned, middle = ask @ rotation(size), ask @ centre
        best = _Best(len(ask), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                vectors = np.frombuffer(b"".join(part.column(1).to_pylist())).reshape(-1, size)
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(vectors), -1)
                ids, length, own = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4))
                _scan(best, ask_ids, ask, turned, middle, ids, vectors, codes, length, own, width)
        yield from arrow_batches(schema, ((int(ask_ids[q]), int(i), float(s)) for q in range(len(ask))
                                          for i, s in zip(best.ids[q], best.scores[q])))

    return index.mapInArrow(rows, schema)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, width: float = 2.5) -> DataFrame:
    """query_id, rank, vec_id, score. ``width`` scales the error bound: larger, fewer misses."""
    clean, size = usable(vectors)
    index, centre = build_index(clean, size)
    queries = index.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def found(b: int) -> DataFrame:
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()  # about QUERY_BLOCK
        ids = np.array([r[0] for r in rows], np.int64)
        ask = np.frombuffer(b"".join(bytes(r[1]) for r in rows)).reshape(len(rows), size)
        return _search_block(index, ids, ask, centre, k, width)

    parts = []
    for at in range(0, blocks, BLOCKS_A_JOB):
        near = reduce(DataFrame.union, [found(b) for b in range(at, min(blocks, at + BLOCKS_A_JOB))])
        ranked = near.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k)
        parts.append(ranked if blocks <= BLOCKS_A_JOB else stage(ranked, "vector-hits"))
    return reduce(DataFrame.union, parts).select("query_id", "rank", "vec_id", "score")

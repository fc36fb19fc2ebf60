"""Hard negatives by Four-Russians scoring of quantised vectors.

Every component x becomes the integer floor(256 * x). A candidate's integers are stored as bit planes in two's
complement, packed for groups of eight dimensions: one byte holds one bit of eight components. For an anchor
and a group, a table of 256 entries holds the sums of all subsets of the anchor's eight components, so a byte
looks up what eight bits add to the inner product. Plane after plane, from the sign's down, the sum so far is
doubled and the lookups are added (the sign's plane counts negative): the result is the exact inner product.

Candidates are packed into chunks where they lie and never shuffled. Anchors are dealt by hash into stripes of
about ``STRIPE``; ``STRIPES_A_ROUND`` of them are broadcast in a round, which reads the chunks once. A task keeps
the best rows of each anchor, so rows that leave it do not grow with the pairs it scores. The first round type
finds each anchor's positives among candidates of its label, the second the negatives between the bounds
that the positives set. Scores are summed in 32 bits where the block's largest possible score allows it, else
in 64 bits, else in whole numbers of any size.

Defined results: rows with a null id, label or vector, with a null or non-finite component or one whose 256-fold
is not finite take no part, nor do vectors of another length than most (the longer length on a tie). Rows that
share an id are separate candidates, none of them for the anchor of that id; of anchors with one id the first
by label and vector asks. Equal scores are ordered by id. Scores beyond 64 bits are ordered right and given
as the nearest 64-bit number. A positive with a negative score has no negatives. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkstats.llm.common import arrow_batches, schema_of, stage

STRIPE, STRIPES_A_ROUND, ANCHORS_AT_ONCE, CHUNK, WIDE_CHUNK = 2048, 4, 64, 2048, 64
SCALE = 256
LONGS = (1 << 63) - 1


def labelled(vectors: DataFrame) -> DataFrame:
    """vec_id, label, q (whole numbers as doubles) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    clean = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"),
        F.transform(x, lambda v: _floor(v * F.lit(float(SCALE)))).alias("q")).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("q").isNotNull()
        & F.forall("q", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    most = clean.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return clean.filter(F.size("q") == (most["n"] if most else 0))


def _floor(v: Column) -> Column:
    """Largest whole number up to a double, as a double: beyond 2^52 every double is one."""
    return F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)


def bit_planes(whole: np.ndarray, bits: int) -> np.ndarray:
    """Bytes [plane, group, row] of integers [row, dimension] in two's complement, the sign's plane first."""
    rows, size = whole.shape
    planes = np.empty((bits, -(-size // 8), rows), np.uint8)
    for k in range(bits):
        one = ((whole >> (bits - 1 - k)) & 1).astype(np.uint8)
        planes[k] = np.packbits(one, axis=1, bitorder="little").T
    return planes


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables [group, 256, anchor] of the sums of all subsets of eight dimensions of anchors [anchor, dimension]."""
    n, size = anchors.shape
    padded = np.concatenate([anchors, np.zeros((n, -size % 8), anchors.dtype)], axis=1).reshape(n, -1, 8)
    table = np.zeros((padded.shape[1], 256, n), anchors.dtype)
    for i in range(8):  # a subset that holds dimension i sums to what it does without it, and the component
        table[:, 1 << i:2 << i] = table[:, :1 << i] + padded[:, :, i].T[:, None, :]
    return table


def scores(table: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products [row, anchor] by lookups, shifts and additions."""
    total = np.zeros((planes.shape[2], table.shape[2]), table.dtype)
    for k, plane in enumerate(planes):
        total += total
        for sums, codes in zip(table, plane):
            if k:
                total += sums[codes]
            else:
                total -= sums[codes]
    return total


def _whole(doubles: np.ndarray) -> np.ndarray:
    """Doubles without fraction as integers: of 64 bits where they fit with a bit to spare."""
    if not doubles.size or np.abs(doubles).max() < float(1 << 62):
        return doubles.astype(np.int64)
    return np.array([[int(v) for v in row] for row in doubles.tolist()], object).reshape(doubles.shape)


def _bits(whole: np.ndarray) -> int:
    return 1 + max(int(whole.max()).bit_length(), int(-1 - whole.min()).bit_length()) if whole.size else 1


def packed(vectors: DataFrame) -> DataFrame:
    """Candidates in chunks, stored: ids, labels, bits and planes. Rows of a chunk are ordered by id. Rows with
    numbers of over 32 bits go to smaller chunks of their own."""
    schema = schema_of("n int, bits int, ids binary, labels binary, planes binary")

    def chunk(ids: np.ndarray, labels: np.ndarray, whole: np.ndarray) -> Iterator:
        size = CHUNK if whole.dtype == np.int64 and _bits(whole) <= 32 else WIDE_CHUNK
        order = np.argsort(ids, kind="stable")
        for at in range(0, len(ids), size):
            some = order[at:at + size]
            bits = _bits(whole[some])
            yield (len(some), bits, ids[some].tobytes(), labels[some].tobytes(), bit_planes(whole[some], bits).tobytes())

    def rows(batches: Iterator) -> Iterator:
        def each():
            for batch in batches:
                if batch.num_rows:
                    ids, labels = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                    q = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    wide = (np.abs(q) >= float(1 << 31)).any(axis=1)
                    for part in (~wide, wide):
                        if part.any():
                            yield from chunk(ids[part], labels[part], _whole(q[part]))
        yield from arrow_batches(schema, each(), size=8)

    return stage(vectors.mapInArrow(rows, schema), "negatives-chunks")


def striped(anchors: DataFrame) -> tuple[DataFrame, int]:
    """stripe, and the anchors of a stripe in one row, stored; and the number of stripes."""
    one = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("first")).select(
        "vec_id", F.col("first.label").alias("label"), F.col("first.q").alias("q"))
    held = stage(one, "negatives-anchors")
    stripes = max(1, -(-held.count() // STRIPE))
    return held.withColumn("stripe", F.pmod(F.xxhash64("vec_id"), F.lit(stripes)).cast("int")), stripes


class _Best:
    """The ``k`` best (score, id) of every list of a stripe; rows come in any order."""

    def __init__(self, k: int):
        self.k, self.lists = k, {}

    def bar(self, key: tuple):
        held = self.lists.get(key)
        return held[-1][0] if held and len(held) == self.k else None

    def put(self, key: tuple, found: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` ascend, so a stable order by score breaks ties by id."""
        if len(found) > self.k:
            if found.dtype != object:
                keep = found >= np.partition(found, len(found) - self.k)[len(found) - self.k]
                found, ids = found[keep], ids[keep]
            best = np.argsort(-found, kind="stable")[:self.k]
            found, ids = found[best], ids[best]
        merged = self.lists.get(key, []) + [(int(s), int(i)) for s, i in zip(found, ids)]
        self.lists[key] = sorted(merged, key=lambda p: (-p[0], p[1]))[:self.k]


def _positives(best: _Best, anchor: tuple, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
    at = np.flatnonzero((labels == anchor[1]) & (ids != anchor[0]))
    if len(at):
        best.put((anchor[0], 0), score[at], ids[at])


def _negatives(best: _Best, anchor: tuple, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
    """Rows of other labels with 80 * positive <= 100 * score <= 100 * positive, for every distinct positive."""
    bounds = {}
    for positive in set(anchor[2]):
        low, bar = -(-80 * positive // 100), best.bar((anchor[0], positive))
        bounds[positive] = low if bar is None else max(low, bar)
    some = {p: low for p, low in bounds.items() if low <= p}
    if some:
        near = np.flatnonzero((score >= min(some.values())) & (score <= max(some)) & (labels != anchor[1]))
        for positive, low in some.items() if len(near) else ():
            at = near[(score[near] >= low) & (score[near] <= positive)]
            if len(at):
                best.put((anchor[0], positive), score[at], ids[at])


def _scan(chunks: DataFrame, stripes: DataFrame, numbers: range, k: int, take: Callable, own_label: bool) -> DataFrame:
    """anchor_id, bound, vec_id, score (decimal text): the best of every task. Stripes hold anchors (vec_id,
    label, q, positives)."""
    schema = schema_of("anchor_id long, bound string, vec_id long, score string")
    # an equality join with the few stripes of a round; every chunk meets every stripe
    both = chunks.withColumn("stripe", F.explode(F.array(*map(F.lit, numbers)))).join(
        F.broadcast(stripes.filter(F.col("stripe").isin(*numbers))), "stripe").select(
        "n", "bits", "ids", "labels", "planes", "anchors")

    def rows(batches: Iterator) -> Iterator:
        best = _Best(k)
        for n, bits, ids, labels, planes, anchors in (row for batch in batches for row in zip(*batch.columns)):
            ids, labels = (np.frombuffer(c.as_py(), np.int64) for c in (ids, labels))
            planes = np.frombuffer(planes.as_py(), np.uint8).reshape(bits.as_py(), -1, n.as_py())
            held = anchors.values
            who, kind = (held.field(f).to_numpy(zero_copy_only=False) for f in ("vec_id", "label"))
            more = [[int(p) for p in ps or ()] for ps in held.field("positives").to_pylist()]
            whole = _whole(held.field("q").flatten().to_numpy(zero_copy_only=False).reshape(len(who), -1))
            for group in _groups(kind, labels, own_label):
                cut = planes if group[1] is None else planes[:, :, group[1]]
                cut_ids, cut_labels = (ids, labels) if group[1] is None else (ids[group[1]], labels[group[1]])
                for at in range(0, len(group[0]), ANCHORS_AT_ONCE):
                    some = group[0][at:at + ANCHORS_AT_ONCE]
                    most = (max((sum(map(abs, map(int, whole[i]))) for i in some), default=0)) << bits.as_py()
                    width = np.int32 if most < 1 << 31 else np.int64 if most <= LONGS else object
                    found = np.ascontiguousarray(scores(subset_sums(whole[some].astype(width)), cut).T)
                    for i, score in zip(some, found):
                        take(best, (int(who[i]), int(kind[i]), more[i]), score, cut_ids, cut_labels)
        yield from arrow_batches(schema, ((a, str(bound), i, str(s)) for (a, bound), held in best.lists.items()
                                          for s, i in held))

    return both.mapInArrow(rows, schema)


def _groups(kind: np.ndarray, labels: np.ndarray, own_label: bool) -> Iterator:
    """Anchors and the candidates to score for them: those of their label, or all."""
    if not own_label:
        yield np.arange(len(kind)), None
        return
    for label in np.unique(kind):
        rows = np.flatnonzero(labels == label)
        if len(rows):
            yield np.flatnonzero(kind == label), rows


def _best_of(chunks: DataFrame, anchors: DataFrame, stripes: int, k: int, take: Callable, own_label: bool,
             label: str) -> DataFrame:
    """anchor_id, bound, rank, vec_id, score (whole numbers as decimal text), stored round by round."""
    packed_anchors = stage(anchors.groupBy("stripe").agg(
        F.collect_list(F.struct("vec_id", "label", "q", "positives")).alias("anchors")), label + "-stripes")
    # numbers as text order by sign, length and digits; those of 18 digits and less are longs
    order = [F.desc(c) for c in number_order("score")] + ["vec_id"]
    ranked = Window.partitionBy("anchor_id", "bound").orderBy(*order)
    out = None
    for at in range(0, stripes, STRIPES_A_ROUND):
        found = _scan(chunks, packed_anchors, range(at, at + STRIPES_A_ROUND), k, take, own_label).withColumn("rank", F.row_number().over(ranked)).filter(
            F.col("rank") <= k)
        part = stage(found, label)
        out = part if out is None else out.union(part)
    return out


def number_order(name: str) -> list[Column]:
    """Columns by which whole numbers in decimal text sort as numbers."""
    text = F.col(name)
    short = F.length(text) <= 18
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(text, "^-", "")
    flipped = F.when(sign < 0, F.translate(digits, "0123456789", "9876543210")).otherwise(digits)
    return [sign * F.length(digits), F.when(short, text.cast("long")), F.when(~short, flipped)]


def as_long(name: str) -> Column:
    """A whole number in decimal text as the nearest 64-bit number."""
    exact = F.expr(f"try_cast({name} AS bigint)")
    return F.coalesce(exact, F.when(F.col(name).startswith("-"), F.lit(-LONGS - 1)).otherwise(F.lit(LONGS)))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``vectors`` has vec_id, label
    and embedding; ``is_anchor`` is told by vec_id."""
    clean = labelled(vectors)
    chunks = packed(clean)
    anchors, stripes = striped(clean.filter(is_anchor))
    none = anchors.withColumn("positives", F.lit(None).cast("array<string>"))
    best = _best_of(chunks, none, stripes, positives, _positives, True, "negatives-positives")
    likes = stage(best.groupBy("anchor_id").agg(F.collect_set("score").alias("positives")), "negatives-bounds")
    asked = anchors.join(likes, anchors["vec_id"] == likes["anchor_id"]).select(
        "stripe", "vec_id", "label", "q", "positives")
    found = _best_of(chunks, asked, stripes, negatives, _negatives, False, "negatives-found")
    pairs = best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("bound"))
    return pairs.join(found, ["anchor_id", "bound"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        as_long("bound").alias("positive_score"), as_long("score").alias("negative_score"))

"""Removal of repeated byte strings, found by sorting suffixes.

Every byte covered by a ``depth``-byte string that also starts anywhere else, in the same text or another,
is removed. Strings are judged on the input; matches do not cross texts.

Equal strings must meet in one shard. In every window of ``depth`` bytes the anchor is the position of the
least hash among the window's grams of ``GRAM`` bytes (the leftmost, on a tie), so equal windows have equal
anchor hashes at equal offsets. The windows of one anchor form a segment. Spark groups segments by anchor
hash and content: a content found twice is repeated as a whole, an anchor with one content and one place
repeats nothing. What is left, one segment for each content of an anchor with several, is dealt to shards by
anchor hash, and each shard sorts its suffixes by external induced sorting (``suffix_sort``): windows whose
common prefix with a neighbour reaches ``depth`` are repeated. A shard aims at ``SHARD_BYTES``.

An anchor with more than ``SHARD_BYTES`` of different contents is split first. Equal windows have the anchor at
the same offset, so its windows are dealt into ``SPLIT`` ranges of that offset, and the pieces of a range meet
by the hash of all bytes that every window of the range holds, which reach into the context of the anchor.
Pieces are grouped by content as segments are, and what is still too large is split again; in a range of one
offset the bytes are the whole window, so no group stays large.

Defined results: a null or empty text has no bytes and loses none; texts shorter than ``depth`` are kept.
Rows repeated with the same id and text are copies of each other like any others. A text is read whole in
one task. Hashes of 64 bits stand for grams, and pairs of them for contents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from linkstats.llm.common import arrow_batches, schema_of, stage
from linkstats.llm.suffix_sort import Shard, Store

GRAM, AT_ONCE, SHARD_BYTES, SORT_MEMORY, SPLIT = 192, 1 << 19, 4 << 20, 256 << 20, 4

_SALTS = np.random.default_rng(4).integers(1, 1 << 63, size=256, dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at every position, from hashes of half the length."""
    done, covered, power = None, 0, int(_STEP)
    part, length = _SALTS[data], 1
    while True:
        if size & length:  # join the stretch so far with the next of this length
            if done is None:
                done, covered = part, length
            else:
                n = len(part) - covered
                done = done[:n] * np.uint64(power) + part[covered:] if n > 0 else part[:0]
                covered += length
        if length * 2 > size or len(part) <= length:
            break
        part = part[:-length] * np.uint64(power) + part[length:]
        length *= 2
        power = power * power % (1 << 64)
    if covered < size:
        return np.empty(0, np.uint64)
    done = done ^ (done >> np.uint64(29))
    done = done * np.uint64(0x9E3779B97F4A7C15)
    return done ^ (done >> np.uint64(32))


def least_positions(hashes: np.ndarray, window: int) -> np.ndarray:
    """Position of the least hash (by its top bits, leftmost on a tie) in every run of ``window``."""
    n = len(hashes)
    if n < window:
        return np.empty(0, np.int64)
    bits = max(1, int(n).bit_length())
    mixed = (hashes >> np.uint64(bits)) << np.uint64(bits) | np.arange(n, dtype=np.uint64)
    padded = np.append(mixed, np.full(-n % window, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, window)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - window + 1
    least = np.minimum(backward[:count], forward[window - 1:window - 1 + count])
    return (least & np.uint64((1 << bits) - 1)).astype(np.int64)


def text_segments(data: bytes, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], np.ndarray]:
    """First and last window start, anchor hash, content hash and anchor position of a text's segments."""
    firsts, lasts, anchors, places = [], [], [], []
    view = np.frombuffer(data, np.uint8)
    starts = len(data) - depth + 1
    for begin in range(0, max(0, starts), AT_ONCE):  # windows that start here
        stop = min(begin + AT_ONCE, starts)
        hashes = gram_hashes(view[begin:stop + depth - 1], gram)
        at = least_positions(hashes, depth - gram + 1)
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        firsts.append(cut + begin)
        lasts.append(np.append(cut[1:], len(at)) - 1 + begin)
        anchors.append(hashes[at[cut]])
        places.append(at[cut] + begin)
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), [], np.empty(0, np.int64)
    first, last, anchor = map(np.concatenate, (firsts, lasts, anchors))
    content = [xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (last + depth).tolist())]
    return first, last, anchor, content, np.concatenate(places)


def _segments(docs: DataFrame, depth: int, gram: int) -> DataFrame:
    names = ["doc_id", "text_key", "first", "last", "anchor", "content", "place"]
    schema = schema_of("doc_id long, text_key long, first int, last int, anchor long, content long, place int")

    def rows(batches: Iterator) -> Iterator:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        held: list[list] = []
        size = 0

        def batch_of():
            columns = [np.concatenate(c) for c in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(c, k, mask=m) for c, k, m in zip(
                columns[:7], kinds, [columns[7], *[None] * 6])], names=names)

        for batch in batches:
            for doc, key, text in zip(*batch.columns):
                doc, key, text = doc.as_py(), key.as_py(), text.as_py()
                first, last, anchor, content, place = text_segments((text or "").encode(), depth, gram)
                n = len(first)
                if n:
                    held.append([np.full(n, doc or 0), np.full(n, key), first, last, anchor.view(np.int64),
                                 np.array(content, np.uint64).view(np.int64), place, np.full(n, doc is None)])
                    size += n
                if size >= 50_000:
                    yield batch_of()
                    held, size = [], 0
        if held:
            yield batch_of()

    return docs.select("doc_id", "text_key", "text").mapInArrow(rows, schema)


def _with_places(docs: DataFrame, segments: DataFrame, *names: str) -> DataFrame:
    """doc_id, text_key, text and the list of a text's ``segments``."""
    places = segments.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(
        F.collect_list(F.struct(*names)).alias("places"))
    return docs.select("doc_id", "text_key", "text").join(
        places.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d"))
        & (F.col("text_key") == F.col("k"))).select("doc_id", "text_key", "text", "places")


def _pieces(docs: DataFrame, segments: DataFrame, depth: int) -> DataFrame:
    """Segments by narrower ranges ``low`` to ``high`` of the anchor's offset in a window. ``anchor`` is the
    hash of the bytes that all windows of the range hold."""
    schema = schema_of("doc_id long, text_key long, first int, last int, anchor long, content long, place int, "
                       "low int, high int")

    def signed(value: int) -> int:
        return value - (1 << 64) if value >> 63 else value

    def cut(batches: Iterator) -> Iterator:
        def each():
            for batch in batches:
                for doc, key, text, own in zip(*batch.columns):
                    data, doc, key = (text.as_py() or "").encode(), doc.as_py(), key.as_py()
                    for p in own.as_py():
                        place, step = p["place"], -(-(p["high"] - p["low"] + 1) // SPLIT)
                        for low in range(p["low"], p["high"] + 1, step):
                            high = min(low + step - 1, p["high"])
                            first, last = max(p["first"], place - high), min(p["last"], place - low)
                            if first <= last:
                                yield (doc, key, first, last,
                                       signed(xxh3_64_intdigest(data[place - low:place - high + depth], seed=low + 1)),
                                       signed(xxh3_64_intdigest(data[first:last + depth])), place, low, high)
        yield from arrow_batches(schema, each())

    return _with_places(docs, segments, "first", "last", "place", "low", "high").mapInArrow(cut, schema)


def _sorted_marks(docs: DataFrame, lone: DataFrame, depth: int) -> DataFrame:
    """doc_id, text_key, begin, end of repeated bytes among segments of anchors with several contents.
    Only segments with a place of their own (``times`` = 1) are marked; the others are known already."""
    total = lone.agg(F.coalesce(F.sum(F.col("last") - F.col("first") + depth), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    cut_schema = schema_of("doc_id long, text_key long, first int, anchor long, times long, bytes binary")

    def cut(batches: Iterator) -> Iterator:
        def each():
            for batch in batches:
                for doc, key, text, own in zip(*batch.columns):
                    data = (text.as_py() or "").encode()
                    for p in own.as_py():
                        yield (doc.as_py(), key.as_py(), p["first"], p["anchor"], p["times"],
                               data[p["first"]:p["last"] + depth])
        yield from arrow_batches(cut_schema, each())

    joined = _with_places(docs, lone, "first", "last", "anchor", "times")
    pieces = joined.mapInArrow(cut, cut_schema).repartition(int(shards), "anchor")
    schema = schema_of("doc_id long, text_key long, begin int, end int")

    def sort(batches: Iterator) -> Iterator:
        rows, segments = [], []
        for batch in batches:
            for doc, key, first, times, data in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))):
                rows.append((doc, key, first, times))
                segments.append(data)
        if not segments:
            return
        store = Store(SORT_MEMORY)
        shard = Shard(segments, depth, store)
        hit = shard.repeated()

        def each():
            at = 0
            for (doc, key, first, times), data in zip(rows, segments):
                if times == 1:
                    yield from ((doc, key, first + a, first + b)
                                for a, b in covered(np.flatnonzero(hit[at:at + len(data) - depth + 1]), depth))
                at += len(data) + 1
        yield from arrow_batches(schema, each())
        store.close()

    return pieces.mapInArrow(sort, schema)


def covered(starts: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Runs of bytes that windows at sorted ``starts`` cover; windows that touch make one run."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > depth) + 1
    return list(zip(starts[np.append(0, cut)].tolist(), (starts[np.append(cut - 1, len(starts) - 1)] + depth).tolist()))


def grouped(docs: DataFrame, depth: int = 400) -> tuple[DataFrame, DataFrame]:
    """Byte ranges of contents found twice (doc_id, text_key, begin, end), and the segments and pieces that are
    left to sort, by anchor: at most ``SHARD_BYTES`` of each."""
    gram = min(GRAM, max(1, depth // 2))
    segments = stage(_segments(docs, depth, gram), "suffix-segments").select(
        "*", F.lit(0).alias("low"), F.lit(depth - gram).alias("high"))
    whole, lone = None, None
    while True:
        # stored before it is joined back: Spark splits the segments of a hot anchor only if no aggregate stands in the way
        anchors = stage(segments.groupBy("anchor").agg(
            F.count("*").alias("n"), F.min("content").alias("low_content"), F.max("content").alias("high_content"))
            .filter(F.col("n") > 1).select("anchor", (F.col("low_content") < F.col("high_content")).alias("several")),
            "suffix-anchors")
        shared = stage(segments.join(anchors, "anchor"), "suffix-shared")
        contents = stage(shared.groupBy("anchor", "content").agg(
            F.count("*").alias("times"), *[F.first(c).alias(c) for c in (
                "doc_id", "text_key", "first", "last", "several", "place", "low", "high")]), "suffix-contents")
        again = contents.filter(F.col("times") > 1).select("anchor", "content")
        found = shared.join(again, ["anchor", "content"]).select(
            "doc_id", "text_key", F.col("first").alias("begin"), (F.col("last") + depth).alias("end"))
        left = contents.filter("several")
        large = left.filter(F.col("low") < F.col("high")).groupBy("anchor").agg(
            F.sum(F.col("last") - F.col("first") + depth).alias("bytes")).filter(
            F.col("bytes") > SHARD_BYTES).select("anchor")
        split = not large.isEmpty()
        if split:
            large = stage(large, "suffix-large")
        small = left.join(large, "anchor", "left_anti") if split else left
        small = small.select("doc_id", "text_key", "first", "last", "anchor", "times")
        whole, lone = (found, small) if whole is None else (whole.union(found), lone.union(small))
        if not split:
            return whole, lone
        segments = stage(_pieces(docs, left.join(large, "anchor", "left_semi"), depth), "suffix-pieces")


def repeated_spans(docs: DataFrame, depth: int = 400) -> DataFrame:
    """doc_id, text_key, begin, end: byte ranges to remove, which may overlap. ``docs`` has a text_key."""
    whole, lone = grouped(docs, depth)
    return whole.union(_sorted_marks(docs, lone, depth))


def remove_repeats(docs: DataFrame, depth: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes): every row of ``docs`` without repeated strings."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    spans = (stage(repeated_spans(keyed, depth), "suffix-spans")
             .groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
             .agg(F.collect_set(F.struct("begin", "end")).alias("spans")))
    joined = keyed.join(spans.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d"))
                        & (F.col("text_key") == F.col("k")), "left").select("doc_id", "text", "spans")
    schema = schema_of("doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")

    def rows(batches: Iterator) -> Iterator:
        def each():
            for batch in batches:
                for doc, text, own in zip(*batch.columns):
                    data = (text.as_py() or "").encode()
                    kept, at, n = [], 0, 0
                    begin = end = -1
                    for s in sorted((p["begin"], p["end"]) for p in own.as_py() or ()):
                        if s[0] > end:
                            if n:
                                kept.append(data[at:begin])
                                at = end
                            begin, n = s[0], n + 1
                        end = max(end, s[1])
                    if n:
                        kept.append(data[at:begin])
                        at = end
                    kept.append(data[at:])
                    rest = b"".join(kept)
                    yield doc.as_py(), len(data), len(data) - len(rest), n, rest
        yield from arrow_batches(schema, each())

    return joined.mapInArrow(rows, schema)


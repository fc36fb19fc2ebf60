"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds its distinct shingles of ``words`` words; with fewer words, the whole sequence is
the one shingle. A signature has ``chunks * width`` symbols of 16 bits. If two signatures differ in fewer
than ``chunks * (errors + 1)`` symbols, some chunk of ``width`` symbols has at most ``errors`` differences.
So every chunk is indexed once for each way to leave out ``errors`` symbols, and all pairs under that
distance meet in at least one bucket. Pairs that meet and may still be near by size and signature are
confirmed on the full sets of both texts.

Equal sets become one node first. In a bucket every member is compared with the bucket's smallest node;
confirmed links make components. Then only members of different components that share a bucket are
compared: in buckets of at most ``SMALL`` members pair by pair, in larger ones block by block, where a task
intersects all sets of two blocks at once. So a large group of copies costs one comparison per member as far
as its smallest node reaches; the rest is compared in full, and no link between components is lost.

Defined results: a text without words has an empty set and is linked with nothing. Ties (equal sets) are
linked. Rows that share an id count as one document. A null id is linked with nothing and kept; its
component is null. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as hash64

from linkstats.llm.common import arrow_batches, schema_of, stage
from linkstats.llm.components import connected_components


#: Members of a bucket that are compared pair by pair, and of a block of a larger bucket.
SMALL, BLOCK = 32, 128


def shingles(text: str | None, words: int) -> set[bytes]:
    """Distinct shingles; bytes.lower and bytes.split know ASCII letters and ASCII space only."""
    parts = text.encode("utf-8", "replace").lower().split() if text else []
    if len(parts) <= words:
        return {b" ".join(parts)} if parts else set()
    return set(map(b" ".join, zip(*(parts[i:] for i in range(words)))))


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def signatures(hashes: np.ndarray, starts: np.ndarray, symbols: int) -> np.ndarray:
    """16-bit MinHash symbols of several sets laid end to end."""
    seeds = np.random.default_rng(20240501).integers(0, 1 << 63, size=(symbols, 2), dtype=np.uint64)
    out = np.empty((len(starts), symbols), np.uint16)
    for j, (a, b) in enumerate(seeds):
        least = np.minimum.reduceat(hashes * (a * np.uint64(2) + np.uint64(1)) + b, starts)
        out[:, j] = (_mixed(least, j) >> np.uint64(48)).astype(np.uint16)
    return out


def signed(docs: DataFrame, words: int, symbols: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set, and its signature."""
    schema = schema_of("doc_id long, n_shingles long, f1 long, f2 long, signature binary")

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                begin, sets, size = at, [], 0
                while at < len(ids) and size < 500_000:
                    sets.append([hash64(s) for s in shingles(texts[at].as_py(), words)])
                    size += len(sets[-1])
                    at += 1
                yield from arrow_batches(schema, _signed(ids[begin:at], sets, symbols))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def _signed(ids: list, sets: list[list[int]], symbols: int) -> Iterator[tuple]:
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if len(full):
        hashes = np.array([h for s in sets for h in s], np.uint64)
        starts = (np.cumsum(sizes) - sizes)[full]
        marks = signatures(hashes, starts, symbols)
        prints = [np.add.reduceat(_mixed(hashes, salt), starts).astype(np.int64).tolist() for salt in (11, 23)]
    where = {int(i): k for k, i in enumerate(full)}
    for i, doc in enumerate(ids):
        k = where.get(i)
        if k is None:
            yield doc, 0, 0, 0, None
        else:
            yield doc, int(sizes[i]), prints[0][k], prints[1][k], marks[k].tobytes()


def bucket_keys(nodes: DataFrame, chunks: int, width: int, errors: int) -> DataFrame:
    """key, node: one row per chunk and way to leave out ``errors`` of its symbols."""
    ways = [np.array([p for p in range(width) if p not in out]) for out in combinations(range(width), errors)]

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, chunks, width)
            keys = []
            for c in range(chunks):
                for w, kept in enumerate(ways):
                    key = np.full(len(marks), c * len(ways) + w + 1, np.uint64)
                    for p in kept:
                        key = _mixed(key * np.uint64(65537) + marks[:, c, p].astype(np.uint64), 5)
                    keys.append(key)
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(keys), 10):
                part = keys[at:at + 10]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(part).astype(np.int64)), pa.array(np.tile(node, len(part)))],
                    names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(rows, schema_of("key long, node long"))


def _near_by_signature(pairs: DataFrame, nodes: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the similarity and whose signatures are not too far apart."""
    a = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("signature").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("signature").alias("sb"))
    sized = (pairs.join(a, "a").join(b, "b")
             .filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "sa", "sb"))

    def rows(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                           for i in (2, 3))
            near = pa.array((left != right).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)],
                                             names=["a", "b"])

    return sized.mapInArrow(rows, schema_of("a long, b long"))


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on full sets."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    first = texts.withColumnRenamed("text", "ta").join(pairs.hint("shuffle_hash"), F.col("id") == F.col("a"))
    both = (first.select("a", "b", "ta")
            .join(texts.withColumnRenamed("text", "tb"), F.col("id") == F.col("b")).select("a", "ta", "b", "tb"))
    schema = schema_of("a long, b long")

    def rows(batches: Iterator) -> Iterator:
        def each():
            recent: dict[int, set[bytes]] = {}

            def of(doc, text):
                if doc not in recent:
                    if len(recent) >= 64:
                        recent.pop(next(iter(recent)))
                    recent[doc] = shingles(text, words)
                return recent[doc]

            for batch in batches:
                for a, ta, b, tb in zip(*batch.columns):
                    left, right = of(a.as_py(), ta.as_py()), of(b.as_py(), tb.as_py())
                    common = len(left & right)
                    if common and 100 * common >= percent * (len(left) + len(right) - common):
                        yield a.as_py(), b.as_py()
        yield from arrow_batches(schema, each())

    return both.mapInArrow(rows, schema)


def _small_bucket_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs of members of different components; a member meets at most ``SMALL`` others in a bucket."""
    other = buckets.select("key", F.col("node").alias("b"), F.col("component").alias("cb"))
    return (buckets.select("key", F.col("node").alias("a"), F.col("component").alias("ca")).join(other, "key")
            .filter((F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b"))).select("a", "b").distinct())


def _hashed_sets(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Columns of ``nodes`` and the sorted 64-bit hashes of each node's shingles."""
    schema = schema_of("part long, block long, whole long, node long, component long, hashes binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    rows_in = texts.join(nodes.hint("shuffle_hash"), F.col("id") == F.col("node")).select(
        "part", "block", "whole", "node", "component", "text")

    def rows(batches: Iterator) -> Iterator:
        def each():
            for batch in batches:
                for *row, text in zip(*batch.columns):
                    hashes = np.unique(np.array([hash64(x) for x in shingles(text.as_py(), words)], np.uint64))
                    yield (*(v.as_py() for v in row), hashes.tobytes())
        yield from arrow_batches(schema, each())

    return rows_in.mapInArrow(rows, schema)


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of one block with all sets of another."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)))
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    places = []
    for flat, row in zip((a, b), rows):
        at = np.searchsorted(both, flat)
        known = (at < len(both)) & (both[np.minimum(at, len(both) - 1)] == flat) if len(both) else np.zeros(len(flat), bool)
        places.append((row[known], at[known]))
    for begin in range(0, len(both), columns):
        parts = []
        for (row, at), n in zip(places, (len(left), len(right))):
            inside = (at >= begin) & (at < begin + columns)
            dense = np.zeros((n, columns), np.float32)
            dense[row[inside], at[inside] - begin] = 1
            parts.append(dense)
        out += parts[0] @ parts[1].T
    return out


def _links_in_blocks(buckets: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between components among the members of large buckets.

    Members of buckets that overlap form a part. A part is cut into blocks of about ``BLOCK`` members;
    a component with that many members fills blocks of its own, the members of smaller ones are pooled. Two
    blocks are compared in one task as two matrices of shingles, without a row per pair, unless both are
    of one component. One link for every two components that meet is enough."""
    stars = buckets.filter(F.col("node") != F.col("leader")).select(
        F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    parts = connected_components(stars).select("node", F.col("component").alias("part"))
    members = buckets.select("node", "component").distinct().join(parts, "node")
    sizes = members.groupBy("part", "component").agg(F.count("*").alias("n")).withColumn("pooled", F.col("n") < BLOCK)
    pools = sizes.filter("pooled").groupBy("part").agg(F.sum("n").alias("pool"))
    sized = members.join(sizes, ["part", "component"]).join(pools, "part", "left")
    spread = F.ceil(F.when(F.col("pooled"), F.col("pool")).otherwise(F.col("n")) / BLOCK).cast("long")
    whole = F.when(~F.col("pooled"), F.col("component"))  # null in a pool
    number = F.pmod(F.xxhash64("node"), spread)
    placed = sized.select("part", F.xxhash64(whole, number).alias("block"), whole.alias("whole"), "node", "component")
    sets = stage(_hashed_sets(placed, docs, words), "near-sets")
    blocks = sets.select("part", "block", "whole").distinct()
    second = blocks.select("part", F.col("block").alias("block2"), F.col("whole").alias("whole2"))
    tasks = stage(blocks.join(second, "part").filter(
        (F.col("block") <= F.col("block2")) & ~F.coalesce(F.col("whole") == F.col("whole2"), F.lit(False)))
        .select("part", "block", "block2"), "near-tasks")
    sides = tasks.select("part", "block", "block2", F.explode(F.array("block", "block2")).alias("at")).distinct()
    rows = sides.join(sets.select("part", F.col("block").alias("at"), "node", "component", "hashes"), ["part", "at"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        first, second = table["block"][0].as_py(), table["block2"][0].as_py()
        at = table["at"].to_numpy()
        node, component = table["node"].to_numpy(), table["component"].to_numpy()
        sets = [np.frombuffer(h, np.uint64) for h in table["hashes"].to_pylist()]
        left, right = np.flatnonzero(at == first), np.flatnonzero(at == second)
        sizes = np.array([len(x) for x in sets])
        common = common_counts([sets[i] for i in left], [sets[i] for i in right])
        union = sizes[left][:, None] + sizes[right][None, :] - common
        linked = (100 * common >= percent * union) & (component[left][:, None] != component[right][None, :])
        found = {}
        for i, j in zip(*np.nonzero(linked)):
            x, y = left[i], right[j]
            found.setdefault((component[x], component[y]), (int(node[x]), int(node[y])))
        pairs = [(min(p), max(p)) for p in found.values()]
        return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())],
                        schema=schema)

    return rows.groupBy("part", "block", "block2").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, chunks: int = 10, width: int = 5,
                    errors: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id (least id reachable over links), kept (it is that one)."""
    symbols = chunks * width
    # Pairs that meet are confirmed up to this distance, which is beyond what the index guarantees: at the
    # least similarity the distance of a linked pair is binomial, and this is five deviations above its mean.
    share = 1 - percent / 100
    most = min(symbols, max(chunks * (errors + 1) - 1, int(symbols * share + 5 * (symbols * share * (1 - share)) ** .5)))
    marked = stage(signed(docs, words, symbols), "near-signatures")
    sets = marked.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = stage(sets.groupBy("f1", "f2", "n_shingles").agg(
        F.min("doc_id").alias("node"), F.first("signature").alias("signature")), "near-classes")
    keys = stage(bucket_keys(classes, chunks, width, errors), "near-keys")
    shared = stage(keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
                   .filter(F.col("leader") < F.col("last")).select("key", "leader")
                   .join(keys, "key"), "near-buckets")
    stars = (shared.filter(F.col("node") > F.col("leader"))
             .select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    links = stage(confirmed(stage(_near_by_signature(stars, classes, percent, most), "near-pairs"),
                            docs, words, percent), "near-links")
    found = connected_components(links)
    placed = (shared.select("key", "node").join(found, "node", "left")
              .select("key", "node", F.coalesce("component", "node").alias("component")))
    mixed = (placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                       F.min("node").alias("leader"), F.count("*").alias("members"))
             .filter(F.col("low") < F.col("high")).select("key", "leader", "members"))
    open_buckets = stage(placed.join(mixed, "key"), "near-open")
    rest = _small_bucket_pairs(open_buckets.filter(F.col("members") <= SMALL)).join(stars, ["a", "b"], "left_anti")
    more = stage(confirmed(stage(_near_by_signature(rest, classes, percent, most), "near-pairs"),
                           docs, words, percent), "near-links")
    wide = stage(_links_in_blocks(open_buckets.filter(F.col("members") > SMALL), docs, words, percent), "near-links")
    more = more.union(wide)
    component = stage(connected_components(links.union(more)), "near-components")
    nodes = classes.select("f1", "f2", "n_shingles", "node").join(component, "node", "left").select(
        "f1", "f2", F.col("n_shingles").alias("size"), F.coalesce("component", "node").alias("component"))
    same = ((marked["f1"] == nodes["f1"]) & (marked["f2"] == nodes["f2"]) & (marked["n_shingles"] == nodes["size"])
            & (marked["n_shingles"] > 0) & marked["doc_id"].isNotNull())
    return (marked.join(nodes, same, "left")
            .select(marked["doc_id"], marked["n_shingles"],
                    F.coalesce("component", marked["doc_id"]).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Documents without the near copies of one with a smaller id."""
    kept = near_duplicates(docs, words, percent).filter("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")

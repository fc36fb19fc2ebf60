"""SimHash near-duplicates: an equality join of deletion-variant signatures.

A fingerprint has 64 bits. Two of them that differ in at most ``bits`` bits, cut into ``bits // 2 + 1``
segments, have one segment that differs in at most one bit. So a fingerprint is indexed under every segment,
whole and with every single bit of it wiped out (66 variants for two segments of 64 bits): only pairs with
an equal variant, which differ in its wiped bit, can be linked, and ``bit_count(a ^ b)`` on the whole
fingerprints decides. Buckets in which all members agree on the wiped bit are dropped unseen.

Equal fingerprints are one node from the start. Members of a bucket of at most ``SMALL`` are joined with each
other. In a larger bucket every member is compared with the least one that differs in the wiped bits; then
components are taken, and a large bucket whose members are all of one component is done. The others are
indexed again on the bits that their variant has left open, which are cut in the same way for the differing
bits that are left, until at most ``LAST_OPEN`` bits are open, so that a bucket has a bounded number of members
(128 for three bits). No link between components is lost, and no large bucket is compared in full.

Defined results: a null or empty text, or one of white space only, has fingerprint zero, linked like any
other; with fewer words than a shingle the whole sequence is the one shingle. Every row is a document of its
own, rows that share an id included. A null id is linked like others but is never the id of a component: its
component is the least id that is not null, or null if there is none. Other columns play no part. An empty
table gives no rows. A text is read whole in one task, its shingles ``AT_ONCE`` at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from linkstats.llm.common import arrow_batches, schema_of, stage
from linkstats.llm.components import connected_components

SMALL, LAST_OPEN, AT_ONCE = 32, 4, 1 << 16
ALL = (1 << 64) - 1


def simhash(text: bytes, words: int, seed: int) -> int:
    """A bit is set if it is set in over half the hashes of the text's shingles, repeats included."""
    parts = text.lower().split()  # of bytes: ASCII letters and ASCII space only
    if not parts:
        return 0
    if len(parts) < words:
        parts, words = [b" ".join(parts)], 1
    total = len(parts) - words + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, total, AT_ONCE):
        some = parts[at:at + AT_ONCE + words - 1]
        hashes = np.array([xxh64_intdigest(s, seed) for s in map(b" ".join, zip(*(some[i:] for i in range(words))))],
                          np.dtype("<u8"))
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(counts * 2 > total).tolist())


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (64 bits as a signed number) of every row."""
    schema = schema_of("doc_id long, fp long")

    def rows(batches: Iterator) -> Iterator:
        yield from arrow_batches(schema, ((doc.as_py(), _signed(simhash(text.as_py() or b"", words, seed)))
                                          for batch in batches for doc, text in zip(*batch.columns)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(rows, schema)


def variants(open_bits: int, bits: int) -> list[tuple[int, int, int]]:
    """Ways to index by the open bits of fingerprints that differ in at most ``bits`` of them: the bits that a
    key holds, the bit that it wipes out (or none), and those that stay open."""
    places = [p for p in range(64) if open_bits >> p & 1]
    parts = bits // 2 + 1
    cut = [places[len(places) * i // parts:len(places) * (i + 1) // parts] for i in range(parts)]
    masks = [sum(1 << p for p in part) for part in cut]
    wiped = [1 << p if p >= 0 else 0 for part in cut for p in ([-1, *part] if bits else [-1])]
    whole = [mask for part, mask in zip(cut, masks) for _ in range(1 + len(part) * (bits > 0))]
    return [(mask & ~one, one, open_bits & ~mask) for mask, one in zip(whole, wiped)]


def _indexed(members: DataFrame, states: list[tuple[int, int]], bits: int) -> DataFrame:
    """held, wiped, value, open, fp, component: members (held, wiped, open, fp, component) under all variants
    of their open bits. ``states`` are the open bits and numbers of differing bits left that occur."""
    def ways(open_bits: int, left: int) -> Column:
        return F.array(*[F.struct(F.lit(_signed(h)).alias("h"), F.lit(_signed(w)).alias("w"), F.lit(_signed(o)).alias("o"))
                         for h, w, o in variants(open_bits, left)])

    chosen = ways(*states[0]) if len(states) == 1 else reduce(lambda c, s: c.when(
        (F.col("open") == _signed(s[0])) & (F.bit_count("wiped") == bits - s[1]), ways(*s)), states, F)
    held = F.col("held").bitwiseOR(F.col("way.h"))
    return members.select("held", "wiped", "fp", "component", F.explode(chosen).alias("way")).select(
        held.alias("held"), F.col("wiped").bitwiseOR(F.col("way.w")).alias("wiped"), F.col("fp").bitwiseAND(held).alias("value"),
        F.col("way.o").alias("open"), "fp", "component")


BUCKET = ["held", "wiped", "value"]


def _links(shared: DataFrame, last: bool, bits: int) -> DataFrame:
    """Links (a, b) in buckets. A pair that a wiped bit brought together differs in it."""
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    side = F.col("fp").bitwiseAND(F.col("wiped"))
    sided = shared.select(*BUCKET, "n", "component", F.col("fp").alias("a"), side.alias("side"))
    other = sided.select(*BUCKET, F.col("a").alias("b"), F.col("component").alias("there"),
                         F.col("side").bitwiseXOR(F.col("wiped")).alias("side"), "n")
    small = F.lit(last) | (F.col("n") <= SMALL)
    pairs = sided.filter(small).drop("n").join(other.filter(small).drop("n"), [*BUCKET, "side"]).filter(
        (F.col("a") < F.col("b")) & (F.col("component") != F.col("there")) & near)
    least = stage(other.filter(~small).groupBy(*BUCKET, "side").agg(F.min("b").alias("b")), "simhash-least")
    stars = sided.filter(~small).join(least, [*BUCKET, "side"]).filter((F.col("a") != F.col("b")) & near)
    return pairs.select("a", "b").union(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def hamming_components(nodes: DataFrame, bits: int = 3) -> DataFrame:
    """fp, component (its least reachable fp) of all distinct ``nodes`` (fp) that are linked to another."""
    none = F.lit(0).cast("long")
    members = nodes.select(none.alias("held"), none.alias("wiped"), F.lit(-1).cast("long").alias("open"), "fp",
                           F.col("fp").alias("component"))
    states, links = [(ALL, bits)], None
    while True:
        indexed = _indexed(members, states, bits)
        states = sorted({(rest, left - (one > 0)) for o, left in states for _, one, rest in variants(o, left)})
        last = max(o.bit_count() for o, _ in states) <= LAST_OPEN
        # stored before it is joined back, so that a hot bucket can be split
        both_sides = F.col("any").bitwiseXOR(F.col("all")).bitwiseAND(F.col("wiped")) == F.col("wiped")
        mixed = stage(indexed.groupBy(*BUCKET).agg(
            F.count("*").alias("n"), F.bit_or("fp").alias("any"), F.bit_and("fp").alias("all"),
            F.min("component").alias("low"), F.max("component").alias("high"))
            .filter((F.col("low") < F.col("high")) & both_sides).select(*BUCKET, "n"), "simhash-buckets")
        shared = stage(indexed.join(mixed, BUCKET), "simhash-shared")
        new = stage(_links(shared, last, bits), "simhash-links")
        links = new if links is None else links.union(new)
        found = stage(connected_components(links), "simhash-components").select(F.col("node").alias("fp"), "component")
        many = shared.filter((F.col("n") > SMALL) & (F.col("open") != 0))
        if last or many.isEmpty():
            return found
        labelled = stage(many.select(*BUCKET, "open", "fp").join(found, "fp", "left").select(
            *BUCKET, "open", "fp", F.coalesce("component", "fp").alias("component")), "simhash-labelled")
        apart = stage(labelled.groupBy(*BUCKET).agg(
            F.min("component").alias("low"), F.max("component").alias("high")).filter(F.col("low") < F.col("high"))
            .select(*BUCKET), "simhash-apart")
        members = stage(labelled.join(apart, BUCKET, "left_semi")
                        .select("held", "wiped", "open", "fp", "component"), "simhash-open")
        if members.isEmpty():
            return found


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id reachable over links)."""
    marked = stage(fingerprints(docs, words, seed), "simhash-fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = hamming_components(nodes.select("fp"), bits)
    placed = stage(nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")),
                   "simhash-placed")
    ids = stage(placed.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-ids")
    named = stage(placed.join(ids, "component").select(F.col("fp").alias("print"), "component_id"), "simhash-named")
    return marked.join(named, F.col("fp") == F.col("print")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

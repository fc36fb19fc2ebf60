"""Prefix trie of rebuilt conversations by composable fingerprints.

A rebuilt conversation is the first turns of a base conversation followed by its own turns after as many. No
rebuilt text is ever made. A turn stands for the map x -> x * R + digest, modulo a prime; a sequence of turns
for the product of its maps, which is its length and its value at zero. Products are taken over the stored turns
only, once for every prefix of an original conversation. As such maps can be undone, the product of own turns
after the first h comes from two prefixes, and that of base head and own suffix by one more product:
``value + (base head - own head) * R ^ (turns after the head)``. Undoing the last map gives the parent.

Rows of one length and product are one node. Two checks make that exact. Every row refers to its last stored
turn by the turn's digest: all rows of a node must agree on it and on the parent, which by induction makes
equal all turns before. And all stored turns under one digest must have the same role and text. When a check
finds a difference, all is done again with other digests and another R.

Sums over subtrees need no walk: a node belongs to its smallest member, whose nodes form the lower end of
its path, so a running sum along paths gives what a member owns from a depth down, and a node adds up what
its members own. Running products and sums cross task borders (``scan``), so one conversation may hold any
share of all turns. Identifiers that end at a node are joined in sorted pieces and hashed in a stream.

Defined results: a null role or text is empty. Turns of equal number are ordered by an MD5 of role and text,
a null number comes first; repeated rows are turns of their own. Rows without conv_id take no part. A base that is
absent has no turns. An empty table has no nodes, not even the root. Other columns play no part. Turns of a base
beyond ``most_head`` are never used.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstats.llm.common import arrow_batches, schema_of, stage
from linkstats.llm.scan import Value, running

PRIME, PIECE = (1 << 61) - 1, 1 << 14
NODE = ["depth", "f1", "f2"]


def multipliers(attempt: int) -> tuple[int, int]:
    rng = random.Random(977 + attempt)
    return rng.randrange(1 << 40, PRIME), rng.randrange(1 << 40, PRIME)


def digest(attempt: int) -> Column:
    """Hex digits that stand for role and text."""
    return F.md5(F.concat(F.lit(f"{attempt}:"), F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))


def stored_turns(conversations: DataFrame, attempt: int) -> DataFrame:
    """conv, turn, role, text, c1, c2 (120 bits of the digest)."""
    plain = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    halves = [F.conv(F.substring("digest", at, 15), 16, 10).cast("long").alias(c) for at, c in ((1, "c1"), (16, "c2"))]
    return plain.withColumn("digest", digest(attempt)).select("conv", "turn", "role", "text", *halves)


def texts_agree(turns: DataFrame) -> bool:
    """Whether all turns with one digest have the same role and text. Only repeated digests are looked at."""
    repeated = stage(turns.groupBy("c1", "c2").count().filter("count > 1").select("c1", "c2"), "trie-repeated")
    ends = turns.join(repeated, ["c1", "c2"], "left_semi").groupBy("c1", "c2").agg(
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("role", "text") for f in (F.min, F.max)])
    return ends.filter("min_role <> max_role OR min_text <> max_text").isEmpty()


def prefix_products(turns: DataFrame, r: tuple[int, int]) -> DataFrame:
    """conv, pos (from 1), f1, f2 (product of the turns up to here), c1, c2, words."""
    def combine(a: Value, b: Value) -> Value:
        return (a[0] + b[0], (a[1] * pow(r[0], b[0], PRIME) + b[1]) % PRIME, (a[2] * pow(r[1], b[0], PRIME) + b[2]) % PRIME)

    one = turns.select("conv", "turn", F.lit(1).cast("long").alias("pos"), F.col("c1").alias("f1"), F.col("c2").alias("f2"),
                       "c1", "c2", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    return running(one, "conv", [F.col("turn").asc_nulls_first(), F.col("c1").asc(), F.col("c2").asc()],
                   ["pos", "f1", "f2"], combine, "trie-products").drop("turn")


def rebuilt(products: DataFrame, base: Column, head: Column, most_head: int) -> DataFrame:
    """conv, h, n, own length, base head and the difference of both heads' products, one row for a conversation."""
    first = F.when(F.col("pos") <= most_head, F.struct("pos", "f1", "f2", "c1", "c2", "words"))
    heads = stage(products.groupBy("conv").agg(F.max("pos").alias("n"), F.sort_array(F.collect_list(first)).alias("own")),
                  "trie-heads")
    asked = heads.withColumn("conv_id", F.col("conv")).withColumns({"h": head.cast("int"), "base": base.cast("long")})
    other = heads.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    empty = F.array().cast(heads.schema["own"].dataType)
    both = asked.join(other, "base", "left").withColumn("taken", F.slice(F.coalesce("base_own", empty), F.lit(1), F.col("h")))

    def after(turns: str, count: Column, lane: str) -> Column:
        return F.when(count > 0, F.get(F.col(turns), count - 1)[lane]).otherwise(0)

    shift = [F.pmod(after("taken", F.size("taken"), f) - after("own", F.col("h"), f), F.lit(PRIME)).alias(s)
             for f, s in (("f1", "s1"), ("f2", "s2"))]
    return stage(both.select("conv", "h", "taken", *shift, (F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
                                                             ).alias("length")), "trie-rebuilt")


def members_of(products: DataFrame, plan: DataFrame, r: tuple[int, int]) -> DataFrame:
    """conv, depth, f1, f2, p1, p2 (the parent), c1, c2, words, ends: every rebuilt prefix but the empty one."""
    zero = F.lit(0).cast("long")
    of_base = plan.select("conv", "length", F.explode("taken").alias("t")).select(
        "conv", "length", F.col("t.pos").alias("depth"), "t.f1", "t.f2", "t.c1", "t.c2", "t.words",
        *[zero.alias(c) for c in ("s1", "s2", "after")])
    own = products.join(plan.select("conv", "length", "h", "s1", "s2", F.size("taken").alias("k")), "conv").filter(
        F.col("pos") > F.col("h")).select(
        "conv", "length", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "f1", "f2", "c1", "c2", "words", "s1", "s2",
        (F.col("pos") - F.col("h")).alias("after"))
    schema = schema_of("conv long, depth long, f1 long, f2 long, p1 long, p2 long, c1 long, c2 long, words long, ends boolean")
    undo = [pow(x, -1, PRIME) for x in r]

    def rows(batches: Iterator) -> Iterator:
        def each():
            for batch in batches:
                for conv, length, depth, f1, f2, c1, c2, words, s1, s2, after in zip(*(c.to_pylist() for c in batch.columns)):
                    f1 = (f1 + s1 * pow(r[0], after, PRIME)) % PRIME if s1 else f1
                    f2 = (f2 + s2 * pow(r[1], after, PRIME)) % PRIME if s2 else f2
                    yield (conv, depth, f1, f2, (f1 - c1) * undo[0] % PRIME, (f2 - c2) * undo[1] % PRIME, c1, c2, words,
                           depth == length)
        yield from arrow_batches(schema, each())

    return stage(of_base.union(own).mapInArrow(rows, schema), "trie-members")


def nodes_of(members: DataFrame) -> tuple[DataFrame, bool]:
    """depth, f1, f2, p1, p2, conv_id (smallest member), n_convs, words; and whether the rows of every node agree
    on their last turn and on their parent."""
    same = ("p1", "p2", "c1", "c2")
    found = stage(members.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("words").alias("words"),
        *[F.min(c).alias(c) for c in same], *[F.max(c).alias("high_" + c) for c in same]), "trie-nodes")
    agree = found.filter(" OR ".join(f"{c} <> high_{c}" for c in same)).isEmpty()
    return found.select(*NODE, "p1", "p2", "conv_id", "n_convs", "words"), agree


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, f1, f2, ends_sha256 of the comma-joined ``conv`` in ascending order."""
    pieces_schema = schema_of("depth long, f1 long, f2 long, first long, piece string")
    schema = schema_of("depth long, f1 long, f2 long, ends_sha256 string")

    def piece(batches: Iterator) -> Iterator:
        def each():
            node, held = None, []
            for batch in batches:
                for *at, conv in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and (at != node or len(held) == PIECE):
                        yield (*node, held[0], ",".join(map(str, held)))
                        held = []
                    node = at
                    held.append(conv)
            if held:
                yield (*node, held[0], ",".join(map(str, held)))
        yield from arrow_batches(pieces_schema, each())

    def hashed(batches: Iterator) -> Iterator:
        def each():
            node, state = None, None
            for batch in batches:
                for *at, _, text in zip(*batch.columns):
                    at, text = [v.as_py() for v in at], text.as_py().encode()
                    if at == node:
                        state.update(b"," + text)
                    else:
                        if node:
                            yield (*node, state.hexdigest())
                        node, state = at, sha256(text)
            if node:
                yield (*node, state.hexdigest())
        yield from arrow_batches(schema, each())

    key = [*NODE, "conv"]
    pieces = stage(ends.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(piece, pieces_schema),
                   "trie-ends")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, schema)


def conversation_trie(conversations: DataFrame, base: Column, head: Column, most_head: int = 3) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``base`` and ``head`` (at most ``most_head``) say, by conv_id, whose first turns and how many are taken."""
    agree, attempt = False, 0
    while not agree:
        r = multipliers(attempt)
        turns = stored_turns(conversations, attempt)
        attempt += 1
        if texts_agree(turns):
            products = prefix_products(turns, r)
            plan = rebuilt(products, base, head, most_head)
            members = members_of(products, plan, r)
            nodes, agree = nodes_of(members)
    zero = F.lit(0).cast("long")
    at_root = plan.select("conv", *[zero.alias(c) for c in NODE], (F.col("length") == 0).alias("ends"))
    root = at_root.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        *[zero.alias(c) for c in NODE], *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")], "conv_id", "n_convs",
        zero.alias("words"))
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(
        F.count("*").alias("n_children"))
    tree = stage(nodes.union(root).join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)),
                 "trie-tree")
    # what the smallest member owns from a depth down
    worth = tree.withColumns({"saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
                              "n_leaves": (F.col("n_children") == 0).cast("long")})
    owned = stage(running(worth, "conv_id", [F.col("depth").desc()], ["saved_tokens", "n_leaves"],
                          lambda a, b: (a[0] + b[0], a[1] + b[1]), "trie-owned"), "trie-owned")
    totals = stage(owned.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("top"), F.max("saved_tokens").alias("tokens"), F.max("n_leaves").alias("leaves")), "trie-totals")
    # and what all other members own, below
    every = members.select("conv", *NODE, "ends").union(at_root.select("conv", *NODE, "ends"))
    others = every.join(totals, "conv").filter(F.col("depth") < F.col("top")).groupBy(*NODE).agg(
        F.sum("tokens").alias("tokens"), F.sum("leaves").alias("leaves"))
    parents = tree.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"),
                          F.col("conv_id").alias("parent_conv_id"))
    return (owned.join(stage(others, "trie-others"), NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
            .join(ends_digests(every.filter("ends")), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("n_leaves") + F.coalesce("leaves", zero)).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("tokens", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256")))

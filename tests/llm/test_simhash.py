"""SimHash links against all pairs."""

import random
import re

import pytest
from helpers import prose
from xxhash import xxh64_intdigest

from linkstats.llm import simhash
from linkstats.llm.simhash import hamming_components, near_duplicates, variants

DOCS = "doc_id long, text string, component string, fp string"


def plain(text, words=3):
    """The fingerprint bit by bit."""
    parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not parts:
        return 0
    grams = [" ".join(parts[i:i + words]) for i in range(len(parts) - words + 1)] or [" ".join(parts)]
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits):
    """Label of every fingerprint by comparing all pairs."""
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    some = sorted(set(prints))
    for i, a in enumerate(some):
        for b in some[i + 1:]:
            if ((a ^ b) & simhash.ALL).bit_count() <= bits:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {p: root(p) for p in some}


def corpus(rng):
    base = prose(rng, 400)
    docs = [(i, prose(rng, 120), "clash", "clash") for i in range(60)]
    for i in range(60, 140):  # near copies: a word or two changed
        parts = base.split()
        for _ in range(rng.randrange(3)):
            parts[rng.randrange(len(parts))] = "x"
        docs.append((i, " ".join(parts), "", ""))
    docs += [(140, None, "", ""), (141, "", "", ""), (142, " \t\n ", "", ""), (143, "One", "", ""), (144, "one ", "", ""),
             (145, "Á á", "", ""), (146, "á Á", "", ""), (60, base, "again", ""), (None, base, "", ""),
             (None, "alone of all", "", ""), (147, prose(rng, 30_000), "", "")]
    return docs


def test_documents_against_all_pairs(spark, rows, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 16)
    monkeypatch.setattr(simhash, "AT_ONCE", 1000)
    docs = corpus(random.Random(5))
    label = components([plain(t) for _, t, *_ in docs], 3)
    least = {}
    for i, text, *_ in docs:
        at = label[plain(text)]
        least[at] = min((x for x in (least.get(at), i) if x is not None), default=None)
    got = rows(near_duplicates(spark.createDataFrame(docs, DOCS)))
    assert got == sorted(((i, f"{plain(t):016x}", least[label[plain(t)]]) for i, t, *_ in docs), key=repr)
    assert len({c for _, _, c in got}) < 90  # the near copies are linked


@pytest.mark.parametrize("bits", [1, 3])
def test_links_of_crowded_fingerprints(spark, rows, monkeypatch, bits):
    """Many fingerprints a few bits apart: buckets grow over ``SMALL`` and are indexed again."""
    monkeypatch.setattr(simhash, "SMALL", 3)
    rng = random.Random(bits)
    prints = set()
    for low in (0, 40, 56):  # the changed bits lie anywhere, or in the last ones
        centre = rng.getrandbits(64)
        for _ in range(40):
            p = centre
            for _ in range(rng.randrange(9)):
                p ^= 1 << rng.randrange(low, 64)
            prints.add(p - (1 << 64) if p >> 63 else p)
    expected = {p: c for p, c in components(prints, bits).items()}
    shared = {c for c in expected.values() if sum(x == c for x in expected.values()) > 1}
    got = rows(hamming_components(spark.createDataFrame([(p,) for p in prints], "fp long"), bits))
    assert got == sorted(((p, c) for p, c in expected.items() if c in shared), key=repr)


def test_every_close_pair_shares_a_variant():
    rng = random.Random(1)
    for bits in (1, 2, 3, 5):
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for place in rng.sample(range(64), bits):
                b ^= 1 << place
            assert any((a ^ b) & (held | one) == one for held, one, _ in variants(simhash.ALL, bits))


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0

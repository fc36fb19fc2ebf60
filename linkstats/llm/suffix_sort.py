"""External induced sorting of a shard's suffixes, with their common prefixes.

A shard is a sequence of segments. Its suffixes are put in order of their first ``depth`` symbols:

1. the suffixes that start a descent to the right of an ascent (the seeds) are sorted by their stretch to
   the next seed, by one induction from seeds in any order, and named in that order;
2. the string of names is sorted in turn;
3. from the sorted seeds, with the common prefixes of neighbours, all other suffixes are induced: first
   those larger than their right neighbour in ascending order, then the others in descending order.

Induction is a priority queue by (first symbol, time of insertion). Symbols are few, so it is kept as one
first-in-first-out queue for each symbol; a queue holds (position, common prefix) tuples in blocks, and
moves blocks to a file when they exceed the memory allowed. Blocks are handled as arrays. The common
prefix of two suffixes that follow one another in a queue is one more than the least common prefix among
the suffixes that were taken out between the two that induced them, so prefixes are carried along and no
text is compared. Arrays of the shard's length are memory-mapped files when the shard is large.

Files are private to a task: they are like Spark's own spill files, are gone when the task ends, and a
task that runs again makes its own.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

END, GAP, FIRST = 0, 1, 2  # end of the shard, end of a segment, symbol of byte 0
SYMBOLS = 258
BLOCK = 1 << 18  # tuples that a queue gathers before it stores a block
_NONE = np.iinfo(np.int32).max
_SALT = np.random.default_rng(99).integers(1, 1 << 63, size=SYMBOLS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Store:
    """Arrays in memory, or in files once ``memory`` bytes are taken."""

    def __init__(self, memory: int = 256 << 20):
        self.left = memory
        self.files: list = []

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.left or not n:
            self.left -= size
            return np.empty(n, kind)
        file = tempfile.TemporaryFile()
        self.files.append(file)
        return np.memmap(file, kind, "w+", shape=(n,))

    def close(self) -> None:
        for f in self.files:
            f.close()


class _Queue:
    """First in, first out; blocks stay readable, for reading in reverse later."""

    def __init__(self, store: Store):
        self.store, self.blocks, self.taken = store, [], 0
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def put(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        self.pending.append((positions, prefixes))
        self.waiting += len(positions)
        if self.waiting >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.pending:
            p, q = self.store.array(self.waiting, np.int64), self.store.array(self.waiting, np.int16)
            np.concatenate([x for x, _ in self.pending], out=p)
            np.concatenate([x for _, x in self.pending], out=q, casting="unsafe")
            self.blocks.append((p, q))
            self.pending, self.waiting = [], 0

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks put in so far and since, until none is left."""
        self.flush()
        while self.taken < len(self.blocks):
            self.taken += 1
            yield self.blocks[self.taken - 1]
            self.flush()

    def last(self) -> int | None:
        return int(self.blocks[-1][0][-1]) if self.blocks else None


class Shard:
    """Symbols of segments laid end to end."""

    def __init__(self, segments: list[bytes], depth: int, store: Store | None = None):
        self.depth, self.store = depth, store or Store()
        n = sum(map(len, segments)) + len(segments) + 1
        self.n = n
        self.symbols = self.store.array(n, np.uint16)
        at = 0
        for s in segments:
            self.symbols[at:at + len(s)] = np.frombuffer(s, np.uint8)
            self.symbols[at:at + len(s)] += FIRST
            self.symbols[at + len(s)] = GAP
            at += len(s) + 1
        self.symbols[n - 1] = END
        self.small = self._types()
        self.seeds = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self._sum_up()

    def _types(self) -> np.ndarray:
        """True where a suffix is smaller than its right neighbour. Equal symbols follow the next change."""
        t = self.symbols
        change = np.flatnonzero(t[1:] != t[:-1])
        small = self.store.array(self.n, bool)
        rising = t[change] < t[change + 1]
        small[:] = np.append(np.repeat(rising, np.diff(change, prepend=-1)),
                             np.ones(self.n - 1 - (change[-1] if len(change) else -1), bool))
        return small

    def _sum_up(self) -> None:
        """Sums that tell whether two stretches are equal (64-bit polynomial hashes)."""
        self.powers = self.store.array(self.n + 1, np.uint64)
        self.powers[0] = 1
        self.powers[1:] = _BASE
        np.multiply.accumulate(self.powers, out=self.powers)
        self.sums = self.store.array(self.n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_SALT[self.symbols] * self.powers[:-1], out=self.sums[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        return ((self.sums[a + length] - self.sums[a]) * self.powers[b]
                == (self.sums[b + length] - self.sums[b]) * self.powers[a])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, up to ``depth``."""
        most = np.minimum(self.depth, self.n - np.maximum(a, b))
        out = np.zeros(len(a), np.int64)
        step = 1 << (max(1, self.depth).bit_length() - 1)
        while step:
            longer = out + step
            fits = longer <= most
            at = np.flatnonzero(fits)
            same = self.equal(a[at] + out[at], b[at] + out[at], np.full(len(at), step))
            out[at[same]] += step
            step >>= 1
        return out

    def induce(self, seeds: np.ndarray, prefixes: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes that induction reaches, largest first, as blocks of (position, prefix shared with
        the one before). ``seeds`` are in order; ``prefixes`` are those of seeds and their left neighbours."""
        carry = prefixes is not None
        starts = np.searchsorted(self.symbols[seeds], np.arange(SYMBOLS + 1))
        large = [_Queue(self.store) for _ in range(SYMBOLS)]
        least = np.full(SYMBOLS, -1, np.int64)
        for c in range(SYMBOLS):
            for positions, shared in large[c].take():
                self._pass_on(positions, shared, large, least, False, carry)
            own = seeds[starts[c]:starts[c + 1]]
            if len(own):
                shared = prefixes[starts[c]:starts[c + 1]].copy() if carry else np.zeros(len(own), np.int64)
                before = large[c].last()
                shared[0] = 0 if before is None or not carry else self.common(np.array([before]), own[:1])[0]
                self._pass_on(own, shared, large, least, False, carry)
        small = [_Queue(self.store) for _ in range(SYMBOLS)]
        least = np.full(SYMBOLS, -1, np.int64)
        for c in range(SYMBOLS - 1, -1, -1):
            for positions, shared in small[c].take():
                yield positions, shared
                self._pass_on(positions, shared, small, least, True, carry)
            right, seam = small[c].last(), None
            for positions, shared in reversed(large[c].blocks):
                positions = positions[::-1]
                if seam is None:
                    seam = 0 if right is None or not carry else self.common(
                        np.array([right]), positions[:1].astype(np.int64))[0]
                turned = np.append(np.int64(seam), shared[::-1][:-1])
                seam = shared[0]
                yield positions, turned
                self._pass_on(positions, turned, small, least, True, carry)

    def _pass_on(self, positions, shared, queues: list[_Queue], least: np.ndarray, to_small: bool, carry: bool) -> None:
        """Put the left neighbours of a block of suffixes into their queues."""
        positions = np.asarray(positions, np.int64)
        lefts = positions - 1
        at = np.flatnonzero((lefts >= 0) & (self.small[np.maximum(lefts, 0)] == to_small))
        targets = self.symbols[lefts[at]]
        order = np.argsort(targets, kind="stable")
        at, targets = at[order], targets[order]
        cuts = np.flatnonzero(np.diff(targets)) + 1 if len(targets) else []
        shared = np.asarray(shared, np.int64)
        lowest = shared.min() if carry else 0
        present = targets[np.append(0, cuts)] if len(targets) else np.empty(0, np.uint16)
        if carry:
            absent = np.ones(SYMBOLS, bool)
            absent[present] = False
            np.minimum(least, lowest, out=least, where=absent)
        for c, own in zip(present, np.split(at, cuts) if len(targets) else ()):
            if carry:
                edges = np.append(0, own + 1)
                whole = edges[-1] == len(shared)
                mins = np.minimum.reduceat(shared, edges[:-1] if whole else edges)
                mins[0] = min(mins[0], least[c])
                least[c] = _NONE if whole else mins[-1]
                values = np.minimum(mins[:len(own)] + 1, self.depth)
            else:
                values = np.zeros(len(own), np.int64)
            queues[c].put(lefts[own], values)

    def sorted_seeds(self) -> np.ndarray:
        """Seeds in order of their first ``depth`` symbols."""
        seeds, m = self.seeds, len(self.seeds)
        if m < 2:
            return seeds
        is_seed = self.store.array(self.n, bool)
        is_seed[:] = False
        is_seed[seeds] = True
        by_symbol = seeds[np.argsort(self.symbols[seeds], kind="stable")]
        found = [p[is_seed[p]] for p, _ in self.induce(by_symbol, None)]
        order = np.concatenate([np.array([self.n - 1]), np.concatenate(found)[::-1].astype(np.int64)])
        index = np.searchsorted(seeds, order)
        spans = np.append(np.diff(seeds) + 1, 1)
        span = spans[index]
        same = np.zeros(m, bool)
        even = np.flatnonzero(span[1:] == span[:-1])
        same[even + 1] = self.equal(order[even + 1], order[even], span[even + 1])
        names = np.empty(m, np.int64)
        names[index] = np.cumsum(~same) - 1
        return seeds[order_of_names(names, self.depth)]

    def repeated(self) -> np.ndarray:
        """True where the first ``depth`` symbols of a suffix also start somewhere else."""
        out = self.store.array(self.n, bool)
        out[:] = False
        seeds = self.sorted_seeds()
        prefixes = np.append(0, self.common(seeds[:-1], seeds[1:])) if len(seeds) else np.empty(0, np.int64)
        before = None
        for positions, shared in self.induce(seeds, prefixes):
            hit = np.asarray(shared) >= self.depth
            out[positions[hit]] = True
            out[positions[:-1][hit[1:]]] = True
            if hit[0] and before is not None:
                out[before] = True
            before = positions[-1]
        return out


def order_of_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by their first ``depth`` bytes at least: ranks of twice
    the names from round to round. A name stands for two bytes or more; names that are unique are placed
    for good, so only suffixes that still tie are sorted again."""
    m, rank, reach = len(names), names.copy(), 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_ranks = rank[order]
        new = np.append(True, sorted_ranks[1:] != sorted_ranks[:-1])
        tied = ~(new & np.append(new[1:], True))
        if not tied.any() or reach * 2 >= depth + 2:
            return order
        slots = np.flatnonzero(tied)
        at = order[slots]
        follow = np.where(at + reach < m, rank[np.minimum(at + reach, m - 1)] + 1, 0)
        again = np.lexsort((follow, rank[at]))
        order[slots] = at[again]
        keys, follows = rank[at][again], follow[again]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (follows[1:] != follows[:-1]))
        ranks = np.empty(len(slots), np.int64)
        ranks[again] = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        # A rank is the first slot of its ties, so ranks of suffixes placed for good must be slots as well.
        next_rank = np.empty(m, np.int64)
        next_rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
        next_rank[at] = ranks
        rank, reach = next_rank, reach * 2

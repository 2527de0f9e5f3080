"""Frozen byte n-gram tables with backoff, scored over whole blocks of text.

A model has levels N..1.  Each level maps the grams of that many bytes that
training saw to a row of costs, one per class, and each context (a gram without
its last byte) to a row of backoff costs.  A byte costs what the longest gram
ending there costs; each longer level adds the backoff cost of its context where
training knew it.  Costs are whole numbers of 2**-16 bits, so that sums don't
depend on order or partitioning.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from sluicegate.llm.u64map import U64Map

UNIT = 1 << 16
#: Bytes scored at a time.
BLOCK = 1 << 17


def mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


def gram_keys(data: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes up to each offset, as a number; bytes before the data are 0."""
    out = data.astype(np.uint64)
    for k in range(1, n):
        out[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    return out


def lay_out(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end with n - 1 zero bytes before each, and where each begins."""
    gap = b"\0" * (n - 1)
    size = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(size + n - 1) - size
    return np.frombuffer(gap + gap.join(texts), np.uint8), starts


def within_words(data: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys without what stands before the white space that begins the word."""
    at = np.arange(len(data))
    start = np.maximum.accumulate(np.where(data <= 0x20, at, 0))
    return keys & np.array([mask(k) for k in range(1, 9)], np.uint64)[np.minimum(at - start, 7)]


class Table:
    """Grams, contexts and costs of all levels."""

    def __init__(self, floor: np.ndarray):
        self.floor = floor  # cost of a byte that no level knows
        self.levels: list[tuple[U64Map, np.ndarray, U64Map, np.ndarray]] = []  # from 1 up

    def add(self, grams, costs, contexts, backoff) -> None:
        maps = []
        for keys, rows in ((grams, costs), (contexts, backoff)):
            m = U64Map(max(len(keys), 1))
            m.put(keys + np.uint64(1), np.arange(len(keys)))
            maps += [m, np.ascontiguousarray(rows)]
        self.levels.append(tuple(maps))

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Cost rows (int32) of grams at the highest level."""
        out = np.zeros((len(keys), len(self.floor)), np.int32)
        rest = None
        for n in range(len(self.levels), 0, -1):
            grams, cost, contexts, backoff = self.levels[n - 1]
            if rest is None:
                found = grams.get((keys & mask(n)) + np.uint64(1))
                rest = np.flatnonzero(found < 0)
                out = cost[found]
                out[rest] = 0
            else:
                found = grams.get((keys[rest] & mask(n)) + np.uint64(1))
                hit = found >= 0
                out[rest[hit]] += cost[found[hit]]
                rest = rest[~hit]
            if not len(rest):
                return out
            found = contexts.get(((keys[rest] & mask(n)) >> np.uint64(8)) + np.uint64(1))
            hit = found >= 0
            out[rest[hit]] += backoff[found[hit]]
        out[rest] += self.floor
        return out

    def lookup(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Cost rows of grams at level n, all of them known there."""
        return self.levels[n - 1][1][self.levels[n - 1][0].get(keys + np.uint64(1))]


def score(table: Table, texts: Iterable[bytes], words: bool, per_word=None) -> Iterator[np.ndarray]:
    """Sum of cost rows (int64) of each text, in order; long texts go block by block.

    words: contexts end at the white space before a word.  per_word: makes rows
    of more sums from the summed cost rows of words, each with its white space.
    """
    n, width = len(table.levels), len(table.floor)
    if per_word:
        width += per_word(np.zeros((1, width), np.int64)).shape[1]
    held, owner, size = [], [], 0
    sums: dict[int, np.ndarray] = {}

    def flush():
        if not held:
            return
        data, starts = lay_out([t for t, _ in held], n)
        keys = gram_keys(data, n)
        if words:
            keys = within_words(data, keys)
        real = np.zeros(len(data), bool)
        for s, (t, skip) in zip(starts.tolist(), held, strict=True):
            real[s + skip : s + len(t)] = True
        pos = np.flatnonzero(real)
        rows = table.costs(keys[pos]).astype(np.int64)
        first = np.searchsorted(pos, starts)
        total = np.add.reduceat(rows, first)
        if per_word:
            begins = data[pos] <= 0x20
            begins[first] = True
            begins = np.flatnonzero(begins)
            more = per_word(np.add.reduceat(rows, begins))
            total = np.concatenate([total, np.add.reduceat(more, np.searchsorted(begins, first))], 1)
        for k, x in zip(owner, total, strict=True):
            sums[k] = sums.get(k, 0) + x
        held.clear()
        owner.clear()

    k, done = -1, 0
    for k, text in enumerate(texts):  # noqa: B007
        for at in range(0, len(text), BLOCK):
            lead = min(at, n - 1)  # a later block begins with the context before it
            part = text[at - lead : at + BLOCK]
            held.append((part, lead))
            owner.append(k)
            size += len(part)
            if size >= BLOCK:
                flush()
                size = 0
        if not held:
            for i in range(done, k + 1):
                yield sums.pop(i, np.zeros(width, np.int64))
            done = k + 1
    flush()
    for i in range(done, k + 1):
        yield sums.pop(i, np.zeros(width, np.int64))


def grouped(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their rows of weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(weights, first)


def units(x: np.ndarray) -> np.ndarray:
    """Costs of probabilities."""
    return np.rint(-np.log2(x) * UNIT).astype(np.int32)


def counted(texts: list[bytes], n: int, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of all texts and how often each stands; blocks of texts bound the memory."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    parts, waiting, held, size = [], 0, [], 0

    def block():
        data, starts = lay_out(held, n)
        grams = gram_keys(data, n)
        if words:
            grams = within_words(data, grams)
        real = np.zeros(len(data), bool)
        for s, t in zip(starts.tolist(), held, strict=True):
            real[s : s + len(t)] = True
        return np.unique(grams[real], return_counts=True)

    for k, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size >= BLOCK or k == len(texts) - 1:
            parts.append(block())
            waiting += len(parts[-1][0])
            held, size = [], 0
        if parts and (waiting > 1 << 21 or k == len(texts) - 1):
            keys, counts = grouped(np.concatenate([keys, *(p[0] for p in parts)]), np.concatenate([counts, *(p[1] for p in parts)]))
            parts, waiting = [], 0
    return keys, counts

"""Byte-level BPE on numpy: pre-tokenisation, merging, decoding.

Pre-tokenisation works on whole blocks of code points: runs of letters,
numbers, white space and the rest, with a single space joined to the run after
it and English contractions cut off.  Distinct pieces are then encoded in
length-bucketed padded matrices: in each round every row merges its leftmost
pair of minimum rank, pairs are looked up in a hash table, and rows and columns
are compacted.  Pieces of over ``MATRIX_BYTES`` bytes, for which the rounds
would be quadratic, go through a heap of pairs with the same order of merges.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

from sluicegate.llm.u64map import U64Map

#: Longest piece that is merged in a matrix.
MATRIX_BYTES = 96
#: Distinct pieces that a worker remembers before it starts anew (a bound on memory, not on results).
CACHE_PIECES = 1 << 18
#: Code points encoded at a time.
BLOCK = 1 << 18

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
#: Code points with the Unicode property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    table = np.full(0x110000, _OTHER, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = _LETTER
        elif kind == "N":
            table[i] = _NUMBER
    table[_WHITE] = _SPACE
    return table


_TABLE: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return _TABLE[0]


def piece_starts(cp: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Sorted offsets at which the pieces of non-empty texts laid end to end begin.

    The pieces are the matches of
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    in each text.
    """
    n = len(cp)
    kind = class_table()[cp]
    first = np.zeros(n, bool)
    first[text_starts] = True
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    inner = run & ~first  # runs with something of the same text before them
    joined = np.zeros(n, bool)  # a space goes with this run
    joined[1:] = inner[1:] & ~space[1:] & (cp[:-1] == 0x20)
    start = run & ~joined
    before = np.flatnonzero(inner & ~space) - 1
    start[before[space[before]]] = True  # the last white space before other text stands alone or with that text
    # contractions: a run of one apostrophe without a space, then letters
    mark = np.flatnonzero((cp == 0x27) & run & ~joined & (kind == _OTHER))
    mark = mark[mark + 1 < n]
    mark = mark[inner[mark + 1] & (kind[mark + 1] == _LETTER)]
    if len(mark):
        a = cp[mark + 1]
        second = mark + 2
        has = (second < n) & ~first[np.minimum(second, n - 1)]
        b = np.where(has, cp[np.minimum(second, n - 1)], 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, size in ((one, 2), (two, 3)):
            at = mark[hit]
            start[at + 1] = False
            after = at + size
            after = after[after < n]
            start[after] |= ~joined[after] & (~space[after] | run[after])
    return np.flatnonzero(start)


def cut_points(text: str, size: int = BLOCK) -> list[int]:
    """Offsets at which a long text can be cut without changing any piece."""
    cuts, at = [0], size
    while at < len(text):
        i = text.find(" ", at)
        while i >= 0 and not (text[i - 1].isascii() and text[i - 1].isalpha() and i + 1 < len(text) and text[i + 1].isascii() and text[i + 1].isalpha()):
            i = text.find(" ", i + 1)
        if i < 0:
            break
        cuts.append(i)
        at = i + size
    return [*cuts, len(text)]


class Vocabulary:
    """Tokens, merge pairs, and their hash tables."""

    def __init__(self, tokens: dict[bytes, int], pairs: Iterable[tuple[int, int, int, int]], added: dict[str, int] | None = None):
        """pairs: left id, right id, rank, merged id.  added: strings that are one token each, whatever stands around them."""
        self.added = {text: i for text, i in (added or {}).items() if text}
        # the leftmost, and of those that begin together the longest
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        whole = tokens | {text.encode(): i for text, i in self.added.items()}
        top = max(whole.values()) + 1
        by_id = [b""] * top
        for b, i in whole.items():
            by_id[i] = b
        self.n = top
        self.byte_ids = np.array([tokens[bytes([i])] for i in range(256)], np.int32)
        self.length = np.array([len(b) for b in by_id], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        p = np.array(list(pairs), np.int64).reshape(-1, 4)
        _, keep = np.unique(p[:, 0] * top + p[:, 1], return_index=True)
        p = p[keep]
        self.rank, self.merged = p[:, 2].astype(np.int32), p[:, 3].astype(np.int32)
        self.map = U64Map(len(p) * 2)
        self.map.put((p[:, 0] * top + p[:, 1] + 1).astype(np.uint64), np.arange(len(p)))

    @classmethod
    def from_ranks(cls, path: str) -> Vocabulary:
        """A file of base64 tokens and ranks; any two tokens that join into a token may merge."""
        with open(path, "rb") as f:
            tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(tokens, ((tokens[t[:k]], tokens[t[k:]], i, i) for t, i in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens))

    @classmethod
    def from_json(cls, path: str) -> Vocabulary:
        """A tokenizer file with a byte-level vocabulary, a list of merges and added tokens.

        Added tokens that take in white space beside them, match whole words
        only, or wait for a normalizer are not read here and raise.
        """
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, added = file["model"], file.get("added_tokens") or []
        if bad := [t["content"] for t in added if any(t.get(k) for k in ("single_word", "lstrip", "rstrip")) or (t.get("normalized") and file.get("normalizer"))]:
            raise ValueError(f"added tokens of a kind that is not supported: {bad}")
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        back = {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocab = model["vocab"]
        tokens = {bytes(back[c] for c in t): i for t, i in vocab.items() if all(c in back for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        return cls(tokens, ((vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(merges)), {t["content"]: t["id"] for t in added})

    def segments(self, text: str) -> list[str | int]:
        """The text, cut at added tokens, which stand as their ids."""
        if self.cut is None:
            return [text]
        return [self.added[x] if k % 2 else x for k, x in enumerate(self.cut.split(text))]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of each pair, -1 where two tokens don't merge."""
        return self.map.get((a.astype(np.int64) * self.n + b + 1).astype(np.uint64))

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ids) else 0
        return self.bytes[np.repeat(self.offset[ids] - (ends - size), size) + np.arange(total)].tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        low = 0
        for high in (2, 4, 6, 8, 12, 16, 24, 32, 48, MATRIX_BYTES):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            for k in range(0, len(rows), 1 << 15):
                self._matrix([pieces[i] for i in rows[k : k + (1 << 15)]], high, rows[k : k + (1 << 15)], out)
        for i in np.flatnonzero(size > MATRIX_BYTES):
            out[i] = self._heap(pieces[i])
        return [np.empty(0, np.int32) if x is None else x for x in out]

    def _matrix(self, pieces: list[bytes], width: int, rows: np.ndarray, out: list) -> None:
        never = np.int32(2**31 - 1)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        left = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_ids[raw]
        number = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        number[np.arange(width - 1) >= (left - 1)[:, None]] = -1
        ranks = np.where(number >= 0, self.rank[number], never)
        while len(ids):
            at = ranks.argmin(1)
            lines = np.arange(len(ids))
            done = ranks[lines, at] == never
            if done.any():
                for r, row, k in zip(rows[done].tolist(), ids[done], left[done].tolist(), strict=True):
                    out[r] = row[:k].copy()
                keep = ~done
                ids, number, ranks, left, rows, at = ids[keep], number[keep], ranks[keep], left[keep], rows[keep], at[keep]
                lines = np.arange(len(ids))
                if not len(ids):
                    break
            ids[lines, at] = self.merged[number[lines, at]]
            left -= 1
            width = int(left.max())
            step = np.arange(max(width, 1))
            ids = np.take_along_axis(ids, np.minimum(step + (step > at[:, None]), ids.shape[1] - 1), 1)
            if width < 2:
                ranks, number = np.full((len(ids), 1), never, np.int32), np.full((len(ids), 1), -1, np.int32)
                continue
            step = step[:-1]
            take = np.minimum(step + (step >= at[:, None]), ranks.shape[1] - 1)
            number, ranks = np.take_along_axis(number, take, 1), np.take_along_axis(ranks, take, 1)
            for k in (at - 1, at):
                ok = (k >= 0) & (k < left - 1)
                r, c = lines[ok], k[ok]
                new = self.pair(ids[r, c], ids[r, c + 1])
                number[r, c] = new
                ranks[r, c] = np.where(new >= 0, self.rank[new], never)
                if k is at:
                    r = lines[(k >= left - 1) & (k < width - 1)]
                    ranks[r, k[r]] = never
            ranks[step >= (left - 1)[:, None]] = never

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self.pair(ids[:-1], ids[1:])
        ids = ids.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, merged = self.rank, self.merged
        heap = [(int(rank[k]), i, ids[i], ids[i + 1], int(merged[k])) for i, k in enumerate(first.tolist()) if k >= 0]
        heapq.heapify(heap)

        def look(i: int, j: int) -> None:
            k = int(self.pair(np.array([ids[i]]), np.array([ids[j]]))[0])
            if k >= 0:
                heapq.heappush(heap, (int(rank[k]), i, ids[i], ids[j], int(merged[k])))

        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                look(i, after[i])
            if before[i] >= 0:
                look(before[i], i)
        return np.array([x for x in ids if x >= 0], np.int32)


class Encoder:
    """Encodes texts block by block, remembering the pieces it has seen."""

    def __init__(self, vocabulary: Vocabulary, cache_pieces: int = CACHE_PIECES):
        self.vocabulary, self.limit = vocabulary, cache_pieces
        self._random = np.random.Generator(np.random.PCG64(11))
        self._factors = self._random.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
        self._forget(cache_pieces)

    def _forget(self, limit: int) -> None:
        self.map = U64Map(max(limit, self.limit))
        self.pool, self.used = np.empty(1 << 16, np.int32), 0
        self.at, self.size = np.empty(0, np.int64), np.empty(0, np.int64)

    def _hash(self, cp: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        longest = int(sizes.max())
        while longest > len(self._factors):
            self._factors = np.concatenate([self._factors, self._random.integers(0, 2**64, len(self._factors), np.uint64) | np.uint64(1)])
        place = np.arange(len(cp)) - np.repeat(starts, sizes)
        return np.add.reduceat((cp.astype(np.uint64) + np.uint64(1)) * self._factors[place], starts)

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of non-empty texts laid end to end, and how many each text has."""
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = np.array([len(t) for t in texts], np.int64)
        text_starts = np.cumsum(chars) - chars
        starts = piece_starts(cp, text_starts)
        sizes = np.diff(starts, append=len(cp))
        keys = self._hash(cp, starts, sizes)
        found = self.map.get(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            if self.map.size + len(new) > self.map.limit:
                self._forget(len(np.unique(keys)))
                missing = np.arange(len(keys))
                new, first = np.unique(keys, return_index=True)
            a = starts[missing[first]]
            b = a + sizes[missing[first]]
            ids = self.vocabulary.encode_pieces([whole[i:j].encode("utf-8", "surrogatepass") for i, j in zip(a.tolist(), b.tolist(), strict=True)])
            self._keep(new, ids)
            found[missing] = self.map.get(keys[missing])
        size = self.size[found]
        ends = np.cumsum(size)
        out = self.pool[np.repeat(self.at[found] - (ends - size), size) + np.arange(int(ends[-1]))]
        of_text = np.searchsorted(starts, text_starts)
        counts = np.diff(np.append(np.concatenate([[0], ends])[of_text], ends[-1]))
        return out, counts

    def _keep(self, keys: np.ndarray, ids: list[np.ndarray]) -> None:
        self.map.put(keys, np.arange(len(keys)) + len(self.at))
        flat = np.concatenate(ids)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(max(len(flat), self.used), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        size = np.array([len(x) for x in ids], np.int64)
        self.at = np.concatenate([self.at, self.used + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used += len(flat)

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids (uint32) of each text, in order; long texts are cut into blocks."""
        held: list[tuple[int, str | int]] = []  # a text's number, and a part of it or an added token's id
        chars = done = 0
        parts: dict[int, list[np.ndarray]] = {}

        def flush():
            said = [x for _, x in held if isinstance(x, str)]
            ids, counts = self.block(said) if said else (np.empty(0, np.int32), np.zeros(0, np.int64))
            each = iter(np.split(ids, np.cumsum(counts)[:-1]))
            for k, x in held:
                parts.setdefault(k, []).append(next(each) if isinstance(x, str) else np.array([x], np.int32))
            held.clear()

        k = -1
        for k, text in enumerate(texts):  # noqa: B007
            for part in self.vocabulary.segments(text):
                if isinstance(part, int):
                    held.append((k, part))
                    chars += 1
                    continue
                cuts = cut_points(part) if len(part) > BLOCK else [0, len(part)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    if j > i:
                        held.append((k, part[i:j]))
                        chars += j - i
                    if chars >= BLOCK:
                        flush()
                        chars = 0
            if not held:
                for i in range(done, k + 1):
                    yield np.concatenate(parts.pop(i, [np.empty(0, np.int32)])).astype("<u4")
                done = k + 1
        flush()
        for i in range(done, k + 1):
            yield np.concatenate(parts.pop(i, [np.empty(0, np.int32)])).astype("<u4")

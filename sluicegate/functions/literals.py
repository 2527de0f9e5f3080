"""Literals that the patterns of rules need: one look for all of them before any rule's own pattern.

Every match of a pattern contains one of its literals, so a text without them
need not be read for it.  The literals are taken out of the parsed pattern, of
callers' rules too; a pattern that has none, or that Python reads otherwise than
Java may, is always looked at.
"""

from __future__ import annotations

import re
import warnings
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluicegate.functions.rules import RAW, Rule

#: Texts of more bytes are read by every rule: their hits would take more memory than the text.
LONGEST = 1 << 20
#: About one character of so many is a given letter or digit, or a given other sign; one of so many begins a word.
LETTERS, SIGNS, WORDS = 16, 100, 5
#: A literal, and whether it begins at a word's boundary.
Literal = tuple[str, bool]
_REPEATS = (_parser.MAX_REPEAT, _parser.MIN_REPEAT)


def _commonness(literals: Iterable[Literal]) -> float:
    total = 0.0
    for word, bounded in literals:
        share = 1.0 / (WORDS if bounded else 1)
        for c in word:
            share /= LETTERS if c.isalnum() else SIGNS
        total += share
    return total


def _begins(items) -> set[str]:
    """Literals of which every match of a sequence begins with one; empty where that isn't known."""
    run = ""
    for op, value in items:
        if op is _parser.LITERAL and value < 0x80:
            run += chr(value)
            continue
        more: list[set[str]] = []
        if op is _parser.SUBPATTERN and not (value[1] or value[2]):
            more = [_begins(value[3])]
        elif op is _parser.BRANCH:
            more = [_begins(way) for way in value[1]]
        elif op in _REPEATS and value[0] > 0:
            more = [_begins(value[2])]
        if more and all(more):
            return {run + m for m in set().union(*more)}
        break
    return {run} if run else set()


def _of(items, bounded: bool = False) -> frozenset[Literal]:
    """The rarest set of literals of which every match of a sequence contains one; empty where there is none.

    bounded: whether the sequence begins at a word's boundary.
    """
    offers: list[frozenset[Literal]] = []
    run, run_bounded = "", False

    def end_run():
        nonlocal run
        if run:
            offers.append(frozenset([(run, run_bounded)]))
        run = ""

    for at, (op, value) in enumerate(items):
        if op is _parser.LITERAL and value < 0x80:
            if not run:
                run_bounded = bounded
                offers.append(frozenset((w, bounded) for w in _begins(items[at:])))
            run += chr(value)
            bounded = False
            continue
        end_run()
        if op is _parser.AT:
            bounded = bounded or value is _parser.AT_BOUNDARY
            continue
        if op is _parser.SUBPATTERN:
            _, added, removed, inner = value
            if added or removed:
                raise ValueError("flags inside a pattern")
            offers.append(_of(inner, bounded))
        elif op is _parser.BRANCH:
            ways = [_of(way, bounded) for way in value[1]]
            offers.append(frozenset().union(*ways) if all(ways) else frozenset())
        elif op in _REPEATS and value[0] > 0:
            offers.append(_of(value[2], bounded))
        bounded = False
    end_run()
    return min((o for o in offers if o), key=_commonness, default=frozenset())


@lru_cache(maxsize=1024)
def required(pattern: str, any_case: bool = False) -> frozenset[Literal]:
    """Literals, lowered where case doesn't count; empty where nothing is known."""
    if "&&" in pattern or "\\Q" in pattern:
        return frozenset()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            parsed = _parser.parse(pattern)
        if parsed.state.flags & ~re.UNICODE:
            return frozenset()
        found = _of(parsed)
    except (re.error, ValueError, Warning):
        return frozenset()
    return frozenset((w.lower() if any_case else w, b) for w, b in found)


def _without_longer(literals: Iterable[Literal]) -> dict[str, bool]:
    """Literals of which none begins another, so that one at most begins at any place; the shorter stands for the longer."""
    kept: dict[str, bool] = {}
    for word, bounded in sorted(literals):
        begins = next((k for k in kept if word.startswith(k)), word)
        kept[begins] = kept.get(begins, bounded) and bounded
    return kept


def _tree(words: list[str]) -> str:
    """A pattern of any of some words, branched by their characters."""
    by_first: dict[str, list[str]] = defaultdict(list)
    for w in words:
        by_first[w[0]].append(w[1:])
    ways = [re.escape(c) + ("" if "" in rest else _tree(rest)) for c, rest in sorted(by_first.items())]
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"


class Look:
    """What a set of rules needs of one kind of surface, found in one pass over it."""

    def __init__(self, rules: Iterable[Rule], surface: str):
        self.any_case = surface == RAW
        own = {r.family: required(r.pattern, self.any_case) for r in rules if r.surface == surface}
        self.literals = _without_longer(x for literals in own.values() for x in literals)
        self.of = {f: sorted({k for k in self.literals for w, _ in literals if w.startswith(k)}) for f, literals in own.items() if literals}
        # a pass costs about as much as the patterns of two rules
        if len(self.of) < 3:
            self.literals, self.of = {}, {}

    @property
    def pattern(self) -> str:
        firsts = "".join(re.escape(c) for c in sorted({w[0] for w in self.literals}))
        ways = [_tree(words) if free else r"\b" + _tree(words) for free in (True, False) if (words := [w for w, b in self.literals.items() if b is not free])]
        return f"{'(?i)' if self.any_case else ''}(?=[{firsts}])(?=({'|'.join(ways)}))"

    def found(self, surface: Column) -> Column:
        """The literals that a surface has; null where it wasn't looked for them."""
        if not self.literals:
            return F.lit(None).cast("array<string>")
        hits = F.array_distinct(F.regexp_extract_all(surface, F.lit(self.pattern), F.lit(1)))
        return F.when(F.octet_length(surface) <= LONGEST, F.transform(hits, F.lower) if self.any_case else hits)

    def read(self, rule: Rule, surface: Column, found: Column) -> Column:
        """The surface where a rule may match it, else null."""
        needs = self.of.get(rule.family)
        if not needs:
            return surface
        return F.when(found.isNull() | F.arrays_overlap(found, F.array(*map(F.lit, needs))), surface)

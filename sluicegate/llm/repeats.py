"""Main text of web pages: runs that pages of a host share are boilerplate.

Pages become streams of tokens, words and the elements around them.  Streams of
a host stand next to each other in units of bounded size; each unit's suffixes
are sorted by their first ``least`` tokens (prefix doubling), which is as deep
as it takes: a run of ``least`` tokens or more is repeated exactly where each of
its windows of that length is.  Neighbours in the suffix array whose prefix is
equal and whose pages differ are repeats.  Prefixes of hosts that reach over a
unit's edge are merged with those of other units by groupBy, so that no repeat is
lost, however large a host is.  Nothing is cut out of an article element, so its
blocks are compared whole: each is ``least`` tokens that stand for all its text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicegate.llm import markup
from sluicegate.llm.common import as_table, drop_tables, tidy

#: Tokens of a unit, which one task sorts at a time; a longer page makes its own.
UNIT_TOKENS = 1 << 20
#: A token that is no text: runs do not reach over it.
BREAK = 0
#: Shortest repeated run that counts, in tokens.
LEAST = 8
#: A block is boilerplate if at least this share of its words lies in repeated runs.
COVERED = 0.8
#: An article may be a teaser if it has at most this share of the words of the page's longest one.
TEASER = 0.5
#: What repeats decide of a block: nothing, the block; from 1 on, the article of that number as a whole.
NOTHING, ITSELF = -1, 0

_PARSED = "article array<boolean>, body array<boolean>, texts array<string>, page long, tokens array<int>, starts array<int>, decide array<int>"
_STREAM = "row long, host string, page long, tokens array<int>, starts array<int>, decide array<int>"


def _token(text: str) -> int:
    return (zlib.crc32(text.encode("utf-8", "surrogatepass")) or 1) - (1 << 31) or 1


def _whole(text: str, least: int) -> list[int]:
    """``least`` tokens that stand for a whole text: its 64-bit digest over and over, which compresses well where it is stored or sent."""
    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    pair = [int(x) or 1 for x in np.frombuffer(digest, np.int32)]
    return (pair * least)[:least]


def _articles(found: list[markup.Block]) -> dict[int, str]:
    """Texts of a page's articles by their numbers, in page order."""
    texts: dict[int, list[str]] = {}
    for b in found:
        if b.says == markup.ARTICLE:
            texts.setdefault(b.article, []).append(b.text)
    return {k: " ".join(x) for k, x in texts.items()}


def stream(found: list[markup.Block], least: int = LEAST) -> tuple[list[int], list[int], int]:
    """A page's tokens, each block's first token (its complement, where the block is article), and what the page is about.

    Pages whose longest article, or without one whose longest open block, is the
    same are copies; runs that only copies share are not boilerplate.
    """
    tokens, starts = [], []
    for b in found:
        if b.says == markup.ARTICLE:
            if tokens and tokens[-1] != BREAK:
                tokens.append(BREAK)
            starts.append(~len(tokens))
            tokens.extend(_whole(b.text, least))
            tokens.append(BREAK)
        else:
            starts.append(len(tokens))
            tokens.append(_token(b.mark + "\n"))
            tokens.extend(map(_token, b.text.split()))
    about = max(_articles(found).values(), key=len, default="") or max((b.text for b in found if b.says == markup.OPEN), key=len, default="")
    about = about or " ".join(b.text for b in found)
    digest = zlib.crc32(about.encode("utf-8", "surrogatepass")), zlib.crc32(about[::-1].encode("utf-8", "surrogatepass"))
    return tokens, starts, (digest[0] << 32 | digest[1]) - (1 << 63)


def deciding(found: list[markup.Block]) -> list[int]:
    """What it decides of each block if it is repeated: open ones go, teasers beside a longer article go as a whole, what a page is about stays."""
    words = Counter()
    for b in found:
        if b.says == markup.ARTICLE:
            words[b.article] += len(b.text.split())
    most = TEASER * max(words.values(), default=0)
    article = lambda b: b.article if words[b.article] <= most else NOTHING
    return [{markup.OPEN: ITSELF, markup.CHROME: NOTHING}.get(b.says, article(b)) for b in found]


def parse(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int = LEAST) -> DataFrame:
    """Each page's stream and blocks, with a number for each row; written once.

    texts: of each block that elements don't exclude, else null.  article, body:
    whether it stands in an article, or in a container named as the page's body.
    """
    names = [x.split()[0] for x in _PARSED.split(", ")]
    flags, numbers = pa.list_(pa.bool_()), pa.list_(pa.int32())
    types = [flags, flags, pa.list_(pa.string()), pa.int64(), numbers, numbers, numbers]

    @tidy
    def run(batches):
        for b in batches:
            columns: list[list] = [[] for _ in names]
            for html in b.column(2):
                found = markup.blocks(html.as_py())
                tokens, starts, page = stream(found, least)
                texts = [None if x.says == markup.CHROME else x.text for x in found]
                values = [x.says == markup.ARTICLE for x in found], [x.body for x in found], texts, page, tokens, starts, deciding(found)
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, columns, types)], ["id", "url", *names])

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, url {source.schema['url'].dataType.simpleString()}, {_PARSED}"
    return as_table(source.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def host(url: Column) -> Column:
    """The host of an address, lower case, without user and port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def units(parsed: DataFrame, least: int, unit_tokens: int) -> DataFrame:
    """Streams dealt to units: neighbours by host, so that most hosts lie inside one; ``edge`` tells hosts that may go on elsewhere."""
    rows = parsed.where(F.size("tokens") >= least).select("row", host(F.col("url")).alias("host"), "page", "tokens", "starts", "decide")
    dealt = rows.repartitionByRange("host", "row").sortWithinPartitions("host", "row")

    def run(batches):
        base, number, held = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            sizes, at = b.column(3).value_lengths().to_pylist(), []
            for n in sizes:
                if held and held + n > unit_tokens:
                    number, held = number + 1, 0
                held += n
                at.append(base + number)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *b.columns], ["unit", *b.schema.names])

    return as_table(dealt.mapInArrow(run, f"unit long, {_STREAM}"))


class Suffixes:
    """The suffix array of one unit's streams, ordered by ``least`` tokens; suffixes that a break cuts short are left out."""

    def __init__(self, table: pa.Table, least: int) -> None:
        table = table.sort_by([("host", "ascending"), ("row", "ascending")])
        self.rows, self.least = table.column("row").to_numpy(), least
        self.hosts, host_of = np.unique(np.array(table.column("host").to_pylist(), object), return_inverse=True)
        streams = [np.asarray(x, np.int32) for x in table.column("tokens").to_pylist()]
        end = np.zeros(least, np.int32)  # breaks keep windows within a page
        self.tokens = np.concatenate([x for s in streams for x in (s, end)])
        self.first = np.cumsum([0, *(len(s) + least for s in streams)])
        lengths = np.diff(self.first)
        page, owner = np.repeat(table.column("page").to_numpy(), lengths), np.repeat(host_of, lengths)
        rank = np.unique(self.tokens, return_inverse=True)[1].astype(np.int64) + owner * (1 << 32)
        whole, reach = self.tokens != BREAK, 1
        while reach < least:  # ranks of 2, 4, 8 tokens; the last step overlaps where least is no power of two
            step = min(reach, least - reach)
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
            rank[:-step] = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
            whole[:-step] &= whole[step:]
            reach += step
        places = np.flatnonzero(whole)
        self.order = places[np.argsort(rank[places], kind="stable")]
        sorted_rank = rank[self.order]
        self.groups = np.flatnonzero(np.r_[True, sorted_rank[1:] != sorted_rank[:-1]]) if len(self.order) else np.zeros(0, np.int64)
        pages = page[self.order]
        self.least_page = np.minimum.reduceat(pages, self.groups) if len(self.groups) else pages
        self.most_page = np.maximum.reduceat(pages, self.groups) if len(self.groups) else pages
        self.owner = owner[self.order[self.groups]]
        last = len(self.hosts) - 1
        self.edge = (self.owner == 0) | (self.owner == last)

    def keys(self, wanted: np.ndarray) -> pa.Array:
        windows = np.lib.stride_tricks.sliding_window_view(self.tokens, self.least)[self.order[self.groups[wanted]]]
        width = 4 * self.least
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(windows), [None, pa.py_buffer(np.ascontiguousarray(windows).tobytes())]).cast(pa.binary())

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """Tokens inside repeated windows.  repeated: of each group."""
        sizes = np.diff(np.r_[self.groups, len(self.order)])
        change = np.zeros(len(self.tokens) + 1, np.int32)
        at = self.order[np.repeat(repeated, sizes)]
        change[at] += 1
        change[at + self.least] -= 1  # ends of windows, one each
        return np.cumsum(change[:-1]) > 0


def _edges(least: int):
    def run(table: pa.Table) -> pa.Table:
        s = Suffixes(table, least)
        k = np.flatnonzero(s.edge)
        return pa.table([pa.array(s.hosts[s.owner[k]], pa.string()), s.keys(k), pa.array(np.full(len(k), table.column("unit")[0].as_py())), pa.array(s.least_page[k]), pa.array(s.most_page[k])], ["host", "key", "unit", "a", "b"])

    return run


def _cover(least: int):
    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("row", pa.int64()), ("gone", pa.list_(pa.bool_())), ("n_repeated", pa.int64())])
        if not own.num_rows:
            return schema.empty_table()
        s = Suffixes(own, least)
        repeated = s.least_page != s.most_page
        if told.num_rows:
            known = set(zip(told.column("host").to_pylist(), told.column("key").to_pylist(), strict=True))
            k = np.flatnonzero(s.edge & ~repeated)
            repeated[k] = [pair in known for pair in zip(s.hosts[s.owner[k]], s.keys(k).to_pylist(), strict=True)]
        covered = s.covered(repeated)
        gone, number = [], []
        own = own.sort_by([("host", "ascending"), ("row", "ascending")])
        lists = ([np.asarray(x, np.int64) for x in own.column(c).to_pylist()] for c in ("starts", "decide"))
        for starts, decide, a, z in zip(*lists, s.first[:-1], s.first[1:] - least, strict=True):
            sums = np.r_[0, np.cumsum(covered[a:z] & (s.tokens[a:z] != BREAK))]
            gone.append(_gone(starts, decide, sums, s.tokens[a:z], least))
            number.append(int(sums[-1]))
        return pa.table([pa.array(s.rows), pa.array(gone, schema.field("gone").type), pa.array(number, pa.int64())], schema=schema)

    return run


def _gone(starts: np.ndarray, decide: np.ndarray, sums: np.ndarray, tokens: np.ndarray, least: int) -> list[bool]:
    """Of each block whether repeats remove it: enough of its words, which follow its mark, are covered, or every block of its article is."""
    out = np.zeros(len(starts), bool)
    own = np.flatnonzero(starts >= 0)
    breaks = np.flatnonzero(tokens == BREAK)
    begin = starts[own] + 1
    end = np.r_[starts[own][1:], len(tokens)]
    cut = np.searchsorted(breaks, begin)
    end = np.minimum(end, np.r_[breaks, len(tokens)][cut])
    out[own] = sums[end] - sums[begin] >= COVERED * (end - begin)
    whole = np.flatnonzero(starts < 0)
    begin = ~starts[whole]
    out[whole] = sums[begin + least] - sums[begin] == least
    out &= decide != NOTHING
    teasers = decide > ITSELF
    out[teasers] &= ~np.isin(decide[teasers], decide[teasers & ~out])
    return out.tolist()


def repeated_runs(parsed: DataFrame, least: int, unit_tokens: int = UNIT_TOKENS) -> DataFrame:
    """``row``, ``gone`` (a flag for each block) and ``n_repeated`` (tokens in repeated runs) of pages with ``least`` tokens or more."""
    dealt = units(parsed, least, unit_tokens)
    edges = as_table(dealt.drop("starts", "decide").groupBy("unit").applyInArrow(_edges(least), "host string, key binary, unit long, a long, b long"))
    shared = edges.groupBy("host", "key").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b and n > 1").select("host", "key")
    told = as_table(edges.where("a = b").join(shared, ["host", "key"]).select("unit", "host", "key"))
    drop_tables(parsed.sparkSession, edges)
    return dealt.groupBy("unit").cogroup(told.groupBy("unit")).applyInArrow(_cover(least), "row long, gone array<boolean>, n_repeated long")


def main_text(pages: DataFrame, least: int = LEAST, unit_tokens: int = UNIT_TOKENS, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of each page.

    All pages, with an article element or without, go one way: their blocks make
    streams, streams make suffix arrays, and these tell what pages of other
    content of the host repeat.  Blocks that are repeated go, then elements are
    held against the rest: chrome that no other page repeats goes; what a page is
    about, its longest article, stays whole, shared or not; a much shorter
    article beside it goes as a whole if each of its blocks is repeated (a
    teaser), else it stays whole.  Of pages without an article the blocks of the
    body container stay, or else all; where repeats would leave nothing, they
    stay.  Only flags of blocks that go are joined to pages, so texts are not
    exchanged where these are few.  Null and empty pages have the text ''; pages
    without a host share the empty host; repeated rows are rows of their own.
    """
    parsed = parse(pages, id_col, url_col, html_col, least)
    runs = repeated_runs(parsed, least, unit_tokens).where(F.exists("gone", lambda g: g))
    flags = as_table(runs.select(F.col("row").alias("of"), "gone"))
    rest = parsed.select("row", "id", "url", "article", "body", "texts").join(flags, F.col("row") == F.col("of"), "left")
    gone = F.coalesce("gone", F.transform("texts", lambda _: F.lit(False)))
    listed = F.filter(F.arrays_zip("article", "body", F.col("texts").alias("text"), gone.alias("gone")), lambda b: b["text"].isNotNull())
    rows = rest.select("id", "url", listed.alias("b"))
    inside = lambda name: F.filter("b", lambda b: b[name])
    place = F.when(F.exists("b", lambda b: b["article"]), inside("article")).when(F.exists("b", lambda b: b["body"]), inside("body")).otherwise(F.col("b"))
    rows = rows.withColumn("place", place)
    rows = rows.withColumn("unique", F.filter("place", lambda b: ~b["gone"]))
    kept = F.when(F.size("unique") > 0, F.col("unique")).otherwise(F.col("place"))
    rows = rows.select("id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), " ").alias("text"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))

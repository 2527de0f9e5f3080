"""Exact n-gram Jaccard join and its components, by set-relation skipping.

Sets of word n-grams are 64-bit hashes; equal sets are one node.  Two sets of a
similarity of at least t share one of the first n - ceil(t n) + 1 members of
each in any common order; the order puts members first that are not known to be
frequent, by hash.  These prefixes are the index: lists of (node, size,
position), cut into blocks by size and position.  The bounds of blocks are read
before their entries, and pairs of blocks that cannot hold a link are skipped.
Answers are derived from those of similar sets twice: a list's members are first
compared with one leader each, and lists whose members all turn out connected
need no further pairs; for the rest, distances to the same leader and the
triangle inequality exclude pairs of members.  No list is ever gathered in one
task or expanded into all its pairs while its members are connected.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm import bloom
from sluicegate.llm.common import CHUNK_BYTES, as_table, drop_tables, release, tidy

#: One document of so many gives its n-grams to the search for frequent ones.
FREQUENT_SAMPLE = 32
#: Frequent n-grams that are told apart (8 bytes each are broadcast): a better order, never another result.
FREQUENT_MOST = 1 << 18
#: Prefixes are longer than needed by one in so many members, and links share as many more entries.
SPARE = 20
#: Rounds of comparing components with leaders before the rest is compared pair by pair.
ROUNDS = 4
#: Shares that the members of a component are dealt to where they take its name.
SALTS = 16
#: Index entries that a bucket holds, about; and those that a task holds before it hands them on.
BUCKET_ENTRIES, HELD_ENTRIES = 200_000, 250_000

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_RANDOM = np.random.Generator(np.random.PCG64(23))
_FACTORS = [_RANDOM.integers(0, 2**64, 1 << 10, np.uint64) | np.uint64(1)]
#: Factor of a short text's number of words: fixed, as the list of factors grows with the words that a worker meets.
_SHORT = _FACTORS[0][-1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def _factors(n: int) -> np.ndarray:
    while n > len(_FACTORS[0]):
        _FACTORS[0] = np.concatenate([_FACTORS[0], _RANDOM.integers(0, 2**64, len(_FACTORS[0]), np.uint64) | np.uint64(1)])
    return _FACTORS[0]


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in a stretch of bytes, and where each begins."""
    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    size = ends - starts
    at = np.flatnonzero(~space)
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    return _mix(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * _factors(int(size.max()))[place], first)), starts


def _sets(words: np.ndarray, n: int) -> np.ndarray:
    """Ascending distinct n-gram hashes of a text's word hashes."""
    if not len(words):
        return words
    f = _factors(8)
    if len(words) < n:
        return _mix((words * f[: len(words)]).sum(keepdims=True) + _SHORT * np.uint64(len(words)))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h += words[k : len(words) - n + 1 + k] * _factors(n)[k]
    return np.unique(_mix(h))


def ngram_sets(texts, n: int = 5):
    """The set of each text (null: empty), in order; texts are worked on in bounded stretches."""
    held: list[bytes] = []
    size = 0

    def flush():
        if not held:
            return
        data = np.frombuffer(b" ".join(held), np.uint8)
        hashes, starts = _word_hashes(data)
        lengths = np.array([len(t) + 1 for t in held])
        cuts = np.searchsorted(starts, np.cumsum(lengths))
        lo = 0
        for hi in cuts.tolist():
            yield _sets(hashes[lo:hi], n)
            lo = hi
        held.clear()

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > CHUNK_BYTES:
            yield from flush()
            size = 0
            parts, at = [], 0
            data = np.frombuffer(raw, np.uint8)
            while at < len(raw):
                end = min(at + CHUNK_BYTES, len(raw))
                while end < len(raw) and not (raw[end] == 0x20 or 9 <= raw[end] <= 13):
                    end += 1
                parts.append(_word_hashes(data[at:end])[0])
                at = end
            yield _sets(np.concatenate(parts), n)
            continue
        held.append(raw)
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield from flush()
            size = 0
    yield from flush()


def node_of(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(size, percent: int):
    """Smallest intersection with a set at least as similar as ``percent`` / 100."""
    return (percent * size + 99) // 100


def _texts(column):
    for x in column:
        yield x.as_py()


def _frequent(docs: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Hashes of frequent n-grams, rarest first, and about how many n-grams all rows have."""

    @tidy
    def run(batches):
        for b in batches:
            for s in ngram_sets(_texts(b.column(0)), n):
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["h"])

    place = F.pmod(F.xxhash64("id", "text"), F.lit(FREQUENT_SAMPLE))
    counted = docs.where(place == 0).select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    counted = as_table(counted.groupBy(F.when(F.col("c") >= 3, F.col("h")).alias("h")).agg(F.sum("c").alias("c")))
    total = counted.agg(F.sum("c")).first()[0] or 0
    top = counted.where("h is not null").orderBy(F.desc("c"), "h").limit(FREQUENT_MOST).orderBy("c", "h").toArrow()
    drop_tables(docs.sparkSession, counted)
    return top.column("h").to_numpy().view(np.uint64), total * FREQUENT_SAMPLE


def prefix_length(size, percent: int):
    """Members of the prefix: similar sets share at least ``1 + size // SPARE`` of both prefixes."""
    return size - least_overlap(size, percent) + 1 + size // SPARE


def prefix_length_column(size, percent: int):
    return F.least(size, size - F.floor((percent * size + 99) / 100) + 1 + F.floor(size / SPARE))


def _nodes(docs: DataFrame, n: int) -> DataFrame:
    """Each row's id, hash of text, node (null: empty set) and size of set."""
    kind = docs.schema["id"].dataType

    @tidy
    def run(batches):
        for b in batches:
            sets = [(node_of(s) if len(s) else None, len(s)) for s in ngram_sets(_texts(b.column(2)), n)]
            node, size = zip(*sets, strict=True) if sets else ((), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int32())], ["id", "h", "node", "n"])

    return as_table(docs.select("id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"id {kind.simpleString()}, h long, node long, n int"))


#: How entries are laid out in a blob, column by column: 48 bits of the hash (more only decide candidates), node, size, position.
_COLUMNS = (("h", 6), ("node", 8), ("n", 4), ("pos", 2))


def _to_blob(h, node, many, pos) -> bytes:
    return b"".join((np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes(), node.astype("<i8").tobytes(), many.astype("<i4").tobytes(), np.minimum(pos, 65535).astype("<u2").tobytes()))


def _from_blob(blob: bytes) -> tuple[np.ndarray, ...]:
    count = len(blob) // sum(w for _, w in _COLUMNS)
    h = np.zeros((count, 8), np.uint8)
    h[:, :6] = np.frombuffer(blob, np.uint8, 6 * count).reshape(-1, 6)
    return h.view("<i8")[:, 0], np.frombuffer(blob, "<i8", count, 6 * count), np.frombuffer(blob, "<i4", count, 14 * count), np.frombuffer(blob, "<u2", count, 18 * count).astype(np.int32)


def _index(docs: DataFrame, n: int, percent: int, frequent: np.ndarray, buckets: int) -> DataFrame:
    """Blobs of index entries by bucket; a task gives a node's entries once, however many copies it reads."""
    order = np.argsort(frequent)
    held = docs.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.int64)))

    @tidy
    def run(batches):
        known, rank = held.value
        seen: set[int] = set()
        waiting, count = [], 0

        def entries():
            h = np.concatenate([w[0] for w in waiting])
            size = np.array([len(w[0]) for w in waiting])
            node, many = (np.repeat(np.array([w[k] for w in waiting], np.int64), size) for k in (1, 2))
            pos = np.concatenate([np.arange(k) for k in size])
            bucket = (h >> np.uint64(40)).astype(np.int64) % buckets
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                bucket[known[at] == h] = -1  # lists of any length, which no task gathers
            by = np.argsort(bucket, kind="stable")
            cut = np.append(np.flatnonzero(np.diff(bucket[by], prepend=-9)), len(by))
            blobs = [_to_blob(h[i], node[i], many[i], pos[i]) for i in np.split(by, cut[1:-1])]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(bucket[by][cut[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "entries"])

        for b in batches:
            for s in ngram_sets(_texts(b.column(0)), n):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()  # copies give their entries again then; the bucket drops them
                seen.add(node)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    level = np.where(known[at] == s, rank[at], -1)
                    if (level >= 0).any():
                        order = np.argsort(level, kind="stable")
                        s = s[order]
                first = min(len(s), prefix_length(len(s), percent))
                waiting.append((s[:first], node, len(s)))
                count += first
                if count >= HELD_ENTRIES:
                    yield entries()
                    count = 0
        if waiting:
            yield entries()

    return docs.select("text").mapInArrow(run, "bucket int, entries binary")


def _lists(index: DataFrame) -> DataFrame:
    """Entries of all lists with two nodes or more."""
    schema = "h long, node long, n int, pos int"
    names = ["h", "node", "n", "pos"]

    def shared(table: pa.Table) -> pa.Table:
        parts = zip(*(_from_blob(x.as_py()) for x in table.column("entries")), strict=True)
        h, node, many, pos = (np.concatenate(p) for p in parts)
        order = np.lexsort((node, h))
        h, node, many, pos = h[order], node[order], many[order], pos[order]
        new = np.append(True, (h[1:] != h[:-1]) | (node[1:] != node[:-1]))
        h, node, many, pos = h[new], node[new], many[new], pos[new]
        same = h[1:] == h[:-1]
        keep = np.append(same, False) | np.append(False, same)
        return pa.table([h[keep], node[keep], many[keep], pos[keep]], names=names)

    @tidy
    def unpack(batches):
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _from_blob(x.as_py())], names)

    few = index.where("bucket >= 0").groupBy("bucket").applyInArrow(shared, schema)
    many = index.where("bucket < 0").select("entries").mapInArrow(unpack, schema)
    return as_table(few.union(many.dropDuplicates(["h", "node"])))


def _wanted_texts(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """``node``, ``text`` of the nodes in ``chosen`` (``node``, ``id``: the least id of the node).

    A Bloom filter of ids, of fixed size, keeps most other texts from being
    exchanged; what it lets through wrongly is dropped by the join.
    """
    spread = bloom.hashed("id")
    held = docs.sparkSession.sparkContext.broadcast(bloom.of(chosen.select(spread.alias("x"))))

    @tidy
    def keyed(batches):
        whole = held.value
        for b in batches:
            text = b.column(1).filter(pa.array(bloom.may_hold(whole, b.column(0).to_numpy())))
            nodes = [node_of(s) if len(s) else None for s in ngram_sets(_texts(text), n)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), text], ["node", "text"])

    found = docs.select(spread.alias("x"), "text").mapInArrow(keyed, "node long, text string")
    return as_table(found.join(chosen.select("node"), "node", "left_semi").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """pairs (a, b) with ``both`` and ``either``, the sizes of intersection and union."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    @tidy
    def run(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                need: dict[int, int] = {}
                for k, node in enumerate([*a, *b]):
                    if node not in kept:
                        need.setdefault(node, k)
                sides = (part.column(2), part.column(3))
                kept |= dict(zip(need, ngram_sets((sides[k // len(a)][k % len(a)].as_py() for k in need.values()), n), strict=True))
                both = [len(np.intersect1d(kept[x], kept[y], assume_unique=True)) for x, y in zip(a, b, strict=True)]
                either = [len(kept[x]) + len(kept[y]) - k for x, y, k in zip(a, b, both, strict=True)]
                last = {b[-1]: kept[b[-1]], a[-1]: kept[a[-1]]}  # rows come sorted by b
                kept.clear()
                kept |= last
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(both, pa.int32()), pa.array(either, pa.int32())], ["a", "b", "both", "either"])

    return as_table(joined.mapInArrow(run, "a long, b long, both int, either int"))


def components(links: DataFrame) -> DataFrame:
    """``node``, ``comp`` (least node reachable) of all ends of links ``a``, ``b``: least labels spread, with shortcuts."""
    ways = as_table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = as_table(ways.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = ways.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("least"))
        moved = labels.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("via"))
        short = moved.join(labels.select(F.col("node").alias("via"), F.col("comp").alias("far")), "via", "left")
        new = as_table(short.select("node", "was", F.least("via", F.coalesce("far", "via")).alias("comp")))
        old, labels = labels, new.select("node", "comp")
        done = not new.where("was <> comp").limit(1).count()
        drop_tables(links.sparkSession, old)
        if done:
            drop_tables(links.sparkSession, ways)
            return labels


def block_of(size, position, percent: int):
    """Block of an entry within its list: by the magnitude of its set's size, then of its position."""
    by_size = F.floor(F.log(size) / float(np.log(100 / percent))).cast("int")
    return by_size * 64 + F.floor(F.log2(position + 1)).cast("int")


def block_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """``h``, ``block1``, ``block2``: blocks of a list that can hold a link, ``block1`` with the smaller sets.

    Only the bounds of blocks are read: their sizes, least positions and
    components.  Entries of other pairs of blocks never meet, so a list is not
    expanded where sizes or positions rule links out, or where all are connected.
    """
    bounds = entries.groupBy("h", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("first"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    side = lambda s: bounds.select("h", *(F.col(c).alias(c + s) for c in ("block", "least", "most", "first", "low", "high")))
    c = F.col
    return side("1").join(side("2"), "h").where(
        (c("least1") <= c("most2")) & (percent * c("least2") <= 100 * c("most1"))
        & (F.least(c("most1") - c("first1"), c("most2") - c("first2")) * (100 + percent) >= percent * (c("least1") + c("least2")))
        & ((c("low1") != c("high1")) | (c("low2") != c("high2")) | (c("low1") != c("low2")))
    ).select("h", "block1", "block2")


def join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` of each row.

    Rows link when the Jaccard similarity of their sets of word n-grams is at
    least ``percent`` / 100; component_id is the least id reachable, the row's
    own included.  Words are runs of characters other than white space
    (\\t to \\r, space), with A-Z lowered; a text of fewer words is one member.
    Null, empty and wordless texts have empty sets and link with nothing.  Rows
    of equal sets are one node; repeated rows are too.  Ids may be null: such a
    row takes the least id of its component, if it has one.
    """
    rows, names = _linked(df, id_col, text_col, n, percent)
    out = rows.join(names, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` without near copies: of each component of ``join``, the row of the least id stays.

    Null ids come last; of rows of one id with different texts in one component,
    that of the least node stays, and of rows equal in id and text, any one.
    Rows of one id that are not linked stay both.  Rows with empty sets stay.
    """
    rows, names = _linked(df, id_col, text_col, n, percent)
    placed = rows.where("node is not null").join(names.select("node", "comp"), "node")
    first = placed.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node", "h")).alias("k")).select("k.id", "k.h")
    per = rows.where("node is not null").groupBy("id", "h").agg(F.count(F.lit(1)).alias("c"))
    both = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])
    state = as_table(per.join(first.withColumn("stays", F.lit(True)), both(per, first), "left").select(per["id"], per["h"], "c", F.coalesce("stays", F.lit(False)).alias("stays")))
    marked = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(df.columns)), F.xxhash64(text_col).alias("h"), F.col(id_col).alias("id"))
    gone, again = state.where("not stays"), state.where("stays and c > 1")
    kept = marked.join(gone, both(marked, gone), "left_anti")
    if again.limit(1).count():  # rows that stand more than once
        repeated = kept.join(again, both(kept, again), "left_semi").dropDuplicates(["id", "h"])
        kept = kept.join(again, both(kept, again), "left_anti").unionByName(repeated)
    return kept.drop("h", "id").toDF(*df.columns)


def _linked(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (``id``, ``h``, ``node``, ``n``), and of each node its component and the component's least id."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    frequent, total = _frequent(docs, n)
    buckets = int(min(1 << 16, max(64, total * (100 - percent + 5) // 100 // BUCKET_ENTRIES)))
    rows = _nodes(docs, n)
    spark = df.sparkSession
    all_lists = lists = _lists(_index(docs, n, percent, frequent, buckets))
    of_node = rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"))
    linked = F.col("both") * 100 >= F.col("either") * percent

    # a node that links shares enough entries with one other, so it has as many: others leave their lists
    for _ in range(2):
        able = lists.groupBy("node", "n").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > F.floor(percent * F.col("n") / 100 / SPARE)).select("node")
        lists = lists.join(able, "node", "left_semi")
        lists = lists.join(lists.groupBy("h").count().where("count > 1").select("h"), "h", "left_semi")
    lists = as_table(lists)
    drop_tables(spark, all_lists)
    release(spark)
    chosen = as_table(of_node.join(lists.select("node").distinct(), "node", "left_semi"))
    texts = _wanted_texts(docs, chosen, n)
    drop_tables(spark, chosen)

    # rounds: of each component, the node with the most votes is compared with a leader of its lists;
    # at first the leader is the set that shares most with others, as the origin of edited copies does
    sizes = lists.groupBy("h").agg(F.count(F.lit(1)).alias("m"))
    central = lists.join(sizes, "h").groupBy("node", "n").agg(F.sum("m").alias("m")).select("node", (F.col("m") / F.col("n")).alias("weight"))
    unweighted, lists = lists, as_table(lists.join(central, "node").select("h", "node", "n", "pos", "weight"))
    drop_tables(spark, unweighted)
    told = spark.createDataFrame([], "a long, b long, both int, either int")
    comps = as_table(lists.select("node", F.col("node").alias("comp")).distinct())
    for k in range(ROUNDS):
        release(spark)
        placed = lists.join(comps, "node")
        place = F.col("weight") if k == 0 else F.xxhash64("node", F.lit(k)).cast("double")
        lead = placed.groupBy("h").agg(F.max(F.struct(place.alias("place"), "node", "n", "comp")).alias("lead"))
        led = placed.join(lead, "h").where((F.col("comp") != F.col("lead.comp")) & (percent * F.greatest("n", "lead.n") <= 100 * F.least("n", "lead.n")))
        votes = led.groupBy("comp", "node", F.col("lead.node").alias("leader"), F.least("n", "lead.n").alias("least")).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") > F.floor(F.col("least") / SPARE))
        votes = votes.join(told.select(F.col("a").alias("node"), F.col("b").alias("leader")), ["node", "leader"], "left_anti")
        best = votes.groupBy("comp").agg(F.max(F.struct("votes", "node", "leader")).alias("v"))
        tried = _verified(best.select(F.col("v.node").alias("a"), F.col("v.leader").alias("b")), texts, n)
        count, hits = tried.agg(F.count(F.lit(1)), F.count_if(linked)).first()
        if not count:
            break
        old, told = told, as_table(told.union(tried))
        drop_tables(spark, old, tried)
        if hits:
            drop_tables(spark, comps)
            comps = as_table(lists.select("node").distinct().join(components(told.where(linked)), "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))
        if hits < 0.1 * count:
            break

    release(spark)
    # lists that join different components: what sizes, positions, shared entries and leaders do not exclude
    sides = told.select(F.col("a").alias("node"), F.col("b").alias("leader"), (1 - F.col("both") / F.col("either")).alias("far"))
    lead = sides.groupBy("node").agg(F.min(F.struct("far", "leader")).alias("m")).select("node", F.col("m.leader").alias("leader"), F.col("m.far").alias("far"))
    placed = lists.join(comps, "node").join(lead, "node", "left").select("h", "node", "n", "pos", "comp", F.coalesce("leader", "node").alias("leader"), F.coalesce("far", F.lit(0.0)).alias("far"))
    mixed = placed.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("h")
    rest = as_table(placed.join(mixed, "h", "left_semi").withColumn("block", block_of(F.col("n"), F.col("pos"), percent)))
    drop_tables(spark, lists, comps)
    side = lambda s: rest.select("h", *(F.col(c).alias(c + s) for c in ("node", "n", "pos", "comp", "leader", "far", "block")))
    met = side("1").join(block_pairs(rest, percent), ["h", "block1"]).join(side("2"), ["h", "block2"])
    cross = met.where(
        (F.col("comp1") != F.col("comp2")) & ((F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("node1") < F.col("node2"))))
        & (percent * F.col("n2") <= 100 * F.col("n1"))
        # the first entry that a linked pair shares leaves enough of both sets behind it
        & (F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2")) * (100 + percent) >= percent * (F.col("n1") + F.col("n2")))
        # distances to the same leader bound the distance between the two
        & ((F.col("leader1") != F.col("leader2")) | (F.abs(F.col("far1") - F.col("far2")) <= 1 - percent / 100 + 1e-9))
    )
    found = cross.select("node1", "n1", "node2", "n2").distinct()
    pairs = found.select(F.col("node1").alias("a"), F.col("node2").alias("b"))
    pairs = pairs.join(told.select("a", "b"), ["a", "b"], "left_anti").join(told.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    more = _verified(pairs, texts, n)
    drop_tables(spark, rest, texts)
    comps = components(told.where(linked).select("a", "b").union(more.where(linked).select("a", "b")))
    drop_tables(spark, told, more)

    release(spark)
    # members of a large component take its name from copies of it, so that no task gets them all
    members = comps.join(of_node, "node").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SALTS)).cast("int"))
    least = members.groupBy("comp").agg(F.min("id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = members.join(least, ["comp", "salt"]).select("node", "comp", "component_id")
    names = of_node.join(named, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return rows, as_table(names)

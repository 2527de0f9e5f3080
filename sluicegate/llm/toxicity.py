"""Toxicity from class-conditional Kneser-Ney models of the bytes of words.

Both classes have counts of grams within words: a byte, and up to seven bytes of
its word before it, with a space that begins the word.  A class's estimate of a
gram is discounted (absolute discounting) and interpolated with a shared
Kneser-Ney backoff, whose lower orders count distinct continuations in both
classes together; a gram that neither class has takes that backoff in both, so
it tells nothing.  Grams are counted in the cluster, over every training row:
sentences count once for each class, so that copies don't weigh, then words,
then grams of words.  The lower orders are the same for both classes, so scores
need only what the classes differ in: a log-likelihood ratio for each of the
longest grams, made in the cluster from all grams of all orders.  Tasks hold the
largest ratios, up to a bound; all others stay in a table, which is joined for
the words that they may decide.

A text is compared by the length-normalised log-likelihoods of its distinct
words, word by word: differences of up to ``STRONG`` bits are what layouts and
topics make and don't count, and one word counts ``CLIP`` bits at most.  The
mean becomes a probability by a logistic function of it, fitted on a bounded
sample of labelled texts that the counts have not seen.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm import bloom, ngrams
from sluicegate.llm.common import as_table, drop_tables, map_texts, release, tidy
from sluicegate.llm.sample import bounded_sample
from sluicegate.llm.u64map import U64Map

#: Bytes of the longest gram.
ORDER = 8
DISCOUNT = 0.75
#: Weight of the shared backoff besides the discounted mass.
SHARED = 2.0
#: Bits of a word's difference that don't count, and that count at most.
STRONG, CLIP = 4, 20
#: Most of the longest grams that tasks hold; the others wait in a table.
MAX_GRAMS = 1 << 19
#: Bits of a slot's number, where tasks hold limits of the others.
SLOT_BITS = 22
#: Groups in which ratios are made, at least, and grams of a group from which there are more.
GROUPS, GROUP_GRAMS = 128, 1 << 16
#: Bound of the sample that fits the logistic: rows of each class, and bytes of a row.
ROWS_PER_CLASS, MAX_ROW_BYTES = 1200, 1 << 14
#: One labelled row of so many may fit the logistic; the others are counted.
HELD_BACK = 6
#: Grams of sampled texts that are merged at a time.
MERGE_GRAMS = 1 << 20
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 1 << 17

_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"(?<=[.!?])\s")


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, lowered."""
    return _WORD.findall(text.lower())


def distinct_words(text: str | None) -> bytes:
    """Each word of a text once, after a space."""
    return b"".join(b" " + w.encode("utf-8", "surrogatepass") for w in dict.fromkeys(words_of(text or "")))


def count_words(rows: DataFrame) -> DataFrame:
    """``word``, ``n0``, ``n1``: in how many distinct sentences of ordinary and toxic rows (``text``, ``label``), repeats inside included."""

    @tidy
    def cut(batches):
        for b in batches:
            labels, found = [], []
            for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                own = {s for part in _STOP.split(text.as_py()) if (s := " ".join(words_of(part)))}
                found += own
                labels += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(found, pa.string())], ["label", "words"])

    @tidy
    def tally(batches):
        held = Counter(), Counter()

        def out():
            words = [*(held[0] | held[1])]
            arrays = [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in held)]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, ["word", "n0", "n1"])

        for b in batches:
            for label, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[label].update(s.as_py().split(" "))
            if len(held[0]) + len(held[1]) > HELD_WORDS:
                yield out()
        yield out()

    sentences = rows.select("text", F.col("label").cast("int")).where("text is not null").mapInArrow(cut, "label int, words string").distinct()
    return sentences.mapInArrow(tally, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def count_grams(words: DataFrame) -> DataFrame:
    """``gram``, ``n0``, ``n1``: counts of the longest grams by class."""

    @tidy
    def grams(batches):
        for b in batches:
            if not b.num_rows:
                continue
            texts = [b" " + w.as_py().encode("utf-8", "surrogatepass") for w in b.column(0)]
            data, starts = ngrams.lay_out(texts, ORDER)
            size = np.array([len(t) for t in texts])
            at = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
            keys = ngrams.within_words(data, ngrams.gram_keys(data, ORDER))[at]
            weights = np.repeat(np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1), size, 0)
            keys, weights = ngrams.grouped(keys, weights)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(weights[:, 0]), pa.array(weights[:, 1])], ["gram", "n0", "n1"])

    return words.mapInArrow(grams, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _shorter(grams: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ``n`` bytes, ascending, and their continuation counts, from all grams of one byte more.

    A shorter gram's weight is the number of distinct grams of one more byte
    that end in it; grams that begin a word keep their counts.
    """
    low = grams & ngrams.mask(n)
    return ngrams.grouped(low, np.where(low == grams, weights, 1))


def _runs(context: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each row of ascending contexts, the sums of its context's rows."""
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    size = np.diff(np.append(first, len(context)))
    return tuple(np.repeat(np.add.reduceat(w, first), size) for w in weights)


def _interpolated(grams: np.ndarray, weights: np.ndarray, under, discount: float) -> np.ndarray:
    """Probabilities of one order's ascending grams, all of their contexts' grams there; under: those of their endings."""
    total, kinds = _runs(grams >> np.uint64(8), weights, np.ones(len(grams), np.int64))
    return (np.maximum(weights - discount, 0) + discount * kinds * under) / total


def _held(p: np.ndarray) -> np.ndarray:
    """Probabilities as whole costs tell them."""
    return np.exp2(-ngrams.units(p) / ngrams.UNIT)


def pairs_of_bytes(top: DataFrame, discount: float = DISCOUNT) -> np.ndarray:
    """The shared backoff of every gram of two bytes, by its number: at most 65,536 rows come from the cluster."""
    low = lambda c, n: F.col(c).bitwiseAND(F.lit(int(ngrams.mask(n))))
    three = top.groupBy(low("gram", 3).alias("longer")).agg(F.max(F.col("n0") + F.col("n1")).alias("w"))
    two = three.groupBy(low("longer", 2).alias("gram")).agg(F.sum(F.when(low("longer", 2) == F.col("longer"), F.col("w")).otherwise(1)).alias("w")).toArrow()
    out = np.zeros(1 << 16)
    if two.num_rows:
        grams, weights = ngrams.grouped(two.column(0).to_numpy().view(np.uint64), two.column(1).to_numpy())
        single, counts = _shorter(grams, weights, 1)
        under = _held(_interpolated(single, counts, 1 / 256, discount))
        out[grams] = _held(_interpolated(grams, weights, under[np.searchsorted(single, grams & ngrams.mask(1))], discount))
    return out


def build(grams: np.ndarray, n0: np.ndarray, n1: np.ndarray, pairs: np.ndarray, discount: float = DISCOUNT, shared: float = SHARED) -> np.ndarray:
    """Log-likelihood ratios, toxic to ordinary, of ascending longest grams: all that have the same two bytes before the last.

    Grams of three bytes and more that end alike, and those of one context,
    have these two bytes in common, so no other gram is needed.
    """
    levels = [(grams, n0 + n1)]
    for n in range(ORDER - 1, 2, -1):
        levels.append(_shorter(*levels[-1], n))
    under = pairs[levels[-1][0] & ngrams.mask(2)]
    for n in range(3, ORDER):
        own = levels[ORDER - n][0]
        p = _held(_interpolated(*levels[ORDER - n], under, discount))
        under = p[np.searchsorted(own, levels[ORDER - n - 1][0] & ngrams.mask(n))]
    p = _interpolated(*levels[0], under, discount)
    bits = []
    for own in (n0, n1):
        mine, kinds = _runs(grams >> np.uint64(8), own, (own > 0).astype(np.int64))
        spare = (discount * kinds + shared) / (mine + shared)
        bits.append(ngrams.units(np.maximum(own - discount, 0) / (mine + shared) + spare * p))
    return bits[0] - bits[1]


def all_ratios(words: DataFrame) -> DataFrame:
    """``gram``, ``ratio``: of every longest gram of which the classes differ; made in the cluster, in groups that grow in number with the grams."""
    spark = words.sparkSession
    top = as_table(count_grams(words))
    pairs = spark.sparkContext.broadcast(pairs_of_bytes(top))
    groups = max(GROUPS, top.count() // GROUP_GRAMS)

    def run(table: pa.Table) -> pa.Table:
        gram, n0, n1 = (table.column(k).to_numpy() for k in range(3))
        gram = gram.view(np.uint64)
        at = np.argsort(gram)
        gram = gram[at]
        ratio = build(gram, n0[at], n1[at], pairs.value)
        return pa.table({"gram": gram.view(np.int64), "ratio": ratio}).filter(pa.array(ratio != 0))

    before = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFF))
    out = as_table(top.groupBy(F.pmod(F.xxhash64(before), F.lit(groups))).applyInArrow(lambda t: run(t.select(["gram", "n0", "n1"])), "gram long, ratio int"))
    drop_tables(spark, top)
    return out


def _highest(rows: DataFrame, weight: str, most: list[int]) -> DataFrame:
    """Of each order, the rows of the highest weights, so many at most: by quarters of octaves of the weight, none of which is cut."""
    step = F.floor(4 * F.log2(weight)).cast("int")
    counts: dict[int, dict[int, int]] = {}
    for n, k, c in rows.groupBy("n", step).agg(F.count(F.lit(1))).collect():
        counts.setdefault(n, {})[k] = c
    least = [0] * (ORDER + 1)
    for n, of in counts.items():
        total = 0
        for k in sorted(of, reverse=True):
            total += of[k]
            if total > most[n - 1]:
                least[n] = k + 1
                break
    return rows.where(step >= F.element_at(F.lit(least), F.col("n") + 1))


class Ratios:
    """Log-likelihood ratios of the longest grams, toxic to ordinary; ``costs`` as ``ngrams.score`` reads them.

    Tasks hold the largest ones.  ``rest`` is the table of all others; of each,
    ``limits`` tells by its slot how much it adds at most, and takes away at
    most, in steps of ``step``.  These are the second and third column of
    ``costs``: 0 in both where the table cannot have the gram.
    """

    def __init__(self, grams: np.ndarray, ratio: np.ndarray, rest: DataFrame | None = None, limits: np.ndarray | None = None, step: int = 1):
        self.levels, self.floor = [None] * ORDER, np.zeros(3, np.int32)
        self.at = U64Map(max(len(grams), 1))
        self.at.put(grams + np.uint64(1), np.arange(len(grams)))
        self.grams, self.ratio = grams, np.append(ratio, np.int32(0))  # absent: the last
        self.rest, self.limits, self.step = rest, limits, step

    def __getstate__(self):
        return self.__dict__ | {"rest": None, "grams": None}

    def costs(self, keys: np.ndarray) -> np.ndarray:
        found = self.at.get(keys + np.uint64(1))
        out = np.zeros((len(keys), 3), np.int32)
        out[:, 0] = self.ratio[found]
        if self.limits is not None:
            absent = np.flatnonzero(found < 0)
            out[absent, 1:] = self.limits[_slot(keys[absent])].astype(np.int32) * self.step
        return out

    def whole_for(self, texts: Iterable[bytes]) -> Ratios:
        """With what the table holds of the grams of some texts, for use on the driver."""
        if self.rest is None:
            return self
        grams, held = np.zeros(0, np.uint64), []
        for t in texts:  # merged as they come: texts share most of their grams
            keys, costs = _looked_up(self, t)
            held.append(np.unique(keys[costs[:, 1:].any(1)]))
            if sum(map(len, held)) > MERGE_GRAMS:
                grams, held = np.unique(np.concatenate([grams, *held])), []
        grams = np.unique(np.concatenate([grams, *held]))
        wanted = self.rest.sparkSession.createDataFrame(pa.table({"gram": grams.view(np.int64)}))
        more = self.rest.join(wanted, "gram").select("gram", "ratio").toArrow()
        return Ratios(np.append(self.grams, more.column(0).to_numpy().view(np.uint64)), np.append(self.ratio[:-1], more.column(1).to_numpy()))


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _limits(rest: DataFrame, step: int) -> np.ndarray:
    """Of each slot's grams, the largest ratio above 0 and the largest below it, in steps, rounded up."""

    @tidy
    def slots(batches):
        for b in batches:
            ratio = b.column(1).to_numpy()
            more, less = (-(-np.maximum(x, 0) // step) for x in (ratio, -ratio))
            yield pa.RecordBatch.from_arrays([pa.array(_slot(b.column(0).to_numpy().view(np.uint64)).astype(np.int32)), pa.array(more), pa.array(less)], ["slot", "more", "less"])

    got = rest.select("gram", "ratio").mapInArrow(slots, "slot int, more int, less int").groupBy("slot").agg(*(F.max(c).cast("short").alias(c) for c in ("more", "less"))).toArrow()
    out = np.zeros((1 << SLOT_BITS, 2), np.uint8)
    for k in (0, 1):
        out[got.column(0).to_numpy(), k] = got.column(1 + k).to_numpy()
    return out


def _looked_up(ratios: Ratios, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The grams of one text's words, and their costs."""
    data, _ = ngrams.lay_out([text], ORDER)
    keys = ngrams.within_words(data, ngrams.gram_keys(data, ORDER))[ORDER - 1 :]
    return keys, ratios.costs(keys)


def train_counts(rows: DataFrame, most: int = MAX_GRAMS) -> Ratios:
    """Ratios from all rows of ``text``, ``label`` (0 ordinary, 1 toxic); beyond ``most`` of them, the smallest stay in a table."""
    words = as_table(count_words(rows))
    every = all_ratios(words)
    sized = every.select(F.lit(ORDER).alias("n"), "gram", "ratio", F.abs("ratio").alias("size"))
    high = _highest(sized, "size", [most] * ORDER).select("gram", "ratio").toArrow()
    grams, ratio = high.column(0).to_numpy().view(np.uint64), high.column(1).to_numpy()
    drop_tables(rows.sparkSession, words)
    held = np.abs(ratio).min(initial=np.iinfo(np.int32).max)
    rest = every.where(F.abs("ratio") < int(held))
    largest = rest.agg(F.max(F.abs("ratio"))).first()[0]
    if largest is None:
        drop_tables(rows.sparkSession, every)
        return Ratios(grams, ratio)
    step = largest // 255 + 1
    return Ratios(grams, ratio, rest, _limits(rest, step), step)


def _counted(total):
    """What a word's summed ratio counts."""
    return np.clip(total - STRONG * ngrams.UNIT, 0, CLIP * ngrams.UNIT)


def _open(rows: np.ndarray, exact: bool) -> np.ndarray:
    """Which words, of their summed costs, wait for the table of the rest: all that it may change, or those of which it may change what counts."""
    if exact:
        return rows[:, 1:].any(1)
    return _counted(rows[:, 0] - rows[:, 2]) != _counted(rows[:, 0] + rows[:, 1])


def _per_word(exact: bool):
    """Sums of a text: what its words count, its words, and the words of which that is not known yet."""
    return lambda rows: np.stack([_counted(rows[:, 0]), np.ones(len(rows), np.int64), _open(rows, exact)], 1)


def _evidence(row: np.ndarray) -> float:
    """Root of the mean of what counts, in bits a word."""
    return float(np.sqrt(row[3] / max(int(row[4]), 1) / ngrams.UNIT))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, intercept) of P(y) over x: Newton steps, halved while they don't help, until the gradient vanishes."""
    scale = x.std() + 1e-9
    z = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + ridge * w[0] ** 2 / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        gradient = z.T @ (p - y) + [ridge * w[0], 0]
        if np.abs(gradient).max() < 1e-6 * len(y):
            return max(w[0], 0.0) / scale, float(w[1])
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([ridge, 1e-9]), gradient)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-12:
            step = step / 2
        w = w - step
    raise ArithmeticError("the logistic fit did not converge")


def calibrate(ratios: Ratios, ordinary: list[str], toxic: list[str]) -> tuple[float, float]:
    """Slope and intercept of the score from labelled texts; one class at most: no evidence, and its name."""
    if not (ordinary and toxic):
        return 0.0, 1.0 if toxic else -1.0
    texts = [distinct_words(t) for t in (*ordinary, *toxic)]
    x = [_evidence(row) for row in ngrams.score(ratios.whole_for(texts), texts, words=True, per_word=_per_word(False))]
    return logistic(np.array(x), np.repeat([0.0, 1.0], [len(ordinary), len(toxic)]))


def score(df: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep=(), with_ratio: bool = True) -> DataFrame:
    """``id_col``, kept columns, ``score`` (0 to 1), and ``ratio``: the whole log-likelihood ratio per byte of distinct words, in bits.

    Null text, and text without letters or digits, has the score of no evidence
    and a ratio of 0.  Texts count whole; repeated rows score alike; an
    empty table gives no rows.  Words of which the grams that tasks don't hold
    may decide are looked up in the table of the rest; without the ratio,
    those are few.
    """
    ratios, (slope, intercept) = model
    held = df.sparkSession.sparkContext.broadcast(ratios)
    waiting = ratios.rest is not None
    unit, per_word = ngrams.UNIT, _per_word(with_ratio)
    open_type = pa.list_(pa.struct([("part", pa.int64()), ("grams", pa.list_(pa.int64()))]))

    def run(columns):
        for column in columns:
            out, whole = [], []
            later: list[list] = [[], [], [], [], [], []]
            sizes: list[int] = []

            def texts(column=column, sizes=sizes):
                for x in column:
                    t = distinct_words(x.as_py())
                    sizes.append(len(t))
                    yield t

            for k, row in enumerate(ngrams.score(held.value, texts(), words=True, per_word=per_word)):
                out.append(float(1 / (1 + np.exp(-np.clip(slope * _evidence(row) + intercept, -30, 30)))))
                whole.append(float(row[0]) / unit / max(sizes[k], 1))
                if waiting:
                    more = _open_words(held.value, distinct_words(column[k].as_py()), with_ratio) if row[5] else (None, None, None)
                    for x, y in zip(later, (*more, int(row[4]), int(row[0]), sizes[k]), strict=True):
                        x.append(y)
            arrays = [pa.array(x, pa.float64()) for x in (out, whole)]
            if waiting:
                arrays += [pa.array(x, t) for x, t in zip(later, (pa.binary(), pa.int64(), open_type, pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield arrays

    fields = "score double, ratio double"
    if waiting:
        fields += ", _key binary, _counted long, _open array<struct<part: long, grams: array<long>>>, _words long, _whole long, _size long"
    out = map_texts(df, id_col, text_col, list(keep), fields, run)
    names = [c for c in out.columns if not c.startswith("_") or c in {id_col, *keep}]
    if not with_ratio:
        names.remove("ratio")
    if not waiting:
        return out.select(names)
    out = as_table(out)
    late = out.where("_open is not null")
    grams = late.dropDuplicates(["_key"]).select("_key", F.posexplode("_open").alias("at", "word")).select("_key", "at", "word.part", F.explode("word.grams").alias("gram"))
    words = grams.join(ratios.rest, "gram", "left").groupBy("_key", "at").agg(F.first("part").alias("part"), F.sum(F.coalesce("ratio", F.lit(0))).alias("more"))
    counted = F.least(F.greatest(F.col("part") + F.col("more") - STRONG * unit, F.lit(0)), F.lit(CLIP * unit))
    texts = words.groupBy("_key").agg(F.sum(counted).alias("_late"), F.sum("more").alias("_more"))
    evidence = slope * F.sqrt((F.col("_counted") + F.col("_late")) / F.col("_words") / unit) + intercept
    score = 1 / (1 + F.exp(-F.greatest(F.least(evidence, F.lit(30.0)), F.lit(-30.0))))
    renewed = {"score": score, "ratio": (F.col("_whole") + F.col("_more")) / unit / F.col("_size")}
    late = late.join(texts, "_key").select(*(renewed[c].alias(c) if c in renewed else F.col(c) for c in names))
    return out.where("_open is null").select(names).union(late)


def _open_words(ratios: Ratios, text: bytes, exact: bool) -> tuple[bytes, int, list[dict]]:
    """A text's name, what its settled words count, and of its other words the sums so far and the grams to look up."""
    keys, costs = _looked_up(ratios, text)
    at = np.arange(len(keys))
    begins = np.flatnonzero((np.frombuffer(text, np.uint8) <= 0x20) | (at % ngrams.BLOCK == 0))  # as blocks cut them
    sums = np.add.reduceat(costs.astype(np.int64), begins)
    waits = _open(sums, exact)
    ends = np.append(begins[1:], len(keys))
    grams = lambda k: keys[begins[k] : ends[k]][costs[begins[k] : ends[k], 1:].any(1)].view(np.int64).tolist()
    words = [{"part": int(sums[k, 0]), "grams": grams(k)} for k in np.flatnonzero(waits)]
    return hashlib.blake2b(text, digest_size=16).digest(), int(_counted(sums[~waits, 0]).sum()), words


def fit(docs: DataFrame, labels: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = ROWS_PER_CLASS, most: int = MAX_GRAMS):
    """A model from the labelled rows for which ``train_rows`` (a column) holds.

    Ids with some labels take the greatest; other labels than 0 and 1, and null
    ids, are left out.  All rows but one of ``HELD_BACK`` (by a hash of the id) are counted, all
    of them; the others are sampled, within bounds, for the logistic.
    """
    # written first, so that its size is known when the join is planned; a filter keeps most texts without a label from being exchanged
    known = as_table(labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("lid")).agg(F.max(label_col).cast("int").alias("label")))
    texts = bloom.keep(docs.where(train_rows).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", known, "lid")
    rows_in = texts.join(known, F.col("id") == F.col("lid")).select("id", "text", "label")
    back = F.pmod(F.xxhash64("id", F.lit(31)), F.lit(HELD_BACK)) == 0
    rows_in = as_table(rows_in.withColumn("back", back))
    ratios = train_counts(rows_in.where("not back"), most)
    sample = bounded_sample(rows_in.where("back").select("id", "text", F.col("label").cast("string").alias("label")), rows, MAX_ROW_BYTES)
    drop_tables(docs.sparkSession, rows_in, known)
    model = ratios, calibrate(ratios, sample.get("0", []), sample.get("1", []))
    del sample
    release(docs.sparkSession)
    return model

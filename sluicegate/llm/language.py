"""Language identification by prediction by partial matching.

For each language a variable-order tree of byte contexts is gathered from a
bounded sample of labelled texts and frozen.  A text's exact code length under a
language is the sum over its bytes of the cost at the longest known context,
with escapes (method C: as many escapes as distinct successors) down to the
order that knows the byte, and at last a uniform byte.  The language with the
shortest code wins; how certain that is, is told against the other languages and
against bytes that no language explains, at 8 bits each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicegate.llm import ngrams
from sluicegate.llm.common import map_texts, release
from sluicegate.llm.sample import bounded_sample

#: Bytes of the longest gram: a context of one less.
ORDER = 5
#: Bound of the sample: rows of each language, and bytes of a row.
ROWS_PER_LANGUAGE = 600
MAX_ROW_BYTES = 1 << 15
UNDETERMINED = "und"


def train(texts_by_language: dict[str, list[str]], order: int = ORDER) -> tuple[list[str], ngrams.Table]:
    names = sorted(k for k, texts in texts_by_language.items() if any(texts))
    if not names:
        return names, ngrams.Table(np.zeros(0, np.int32))
    counts = {}
    for c, name in enumerate(names):
        counts[c] = ngrams.counted([t.lower().encode() for t in texts_by_language[name]], order, words=False)
    table = ngrams.Table(np.full(len(names), 8 * ngrams.UNIT, np.int32))
    for n in range(1, order + 1):
        grams, seen = [], []
        for c in range(len(names)):
            g, w = ngrams.grouped(counts[c][0] & ngrams.mask(n), counts[c][1])
            grams.append(g)
            seen.append(w)
        union = np.unique(np.concatenate(grams))
        contexts = np.unique(union >> np.uint64(8))
        lower = table.lookup(union & ngrams.mask(n - 1), n - 1) if n > 1 else np.broadcast_to(table.floor, (len(union), len(names)))
        cost, escape = np.array(lower, np.int32), np.zeros((len(contexts), len(names)), np.int32)
        of = np.searchsorted(contexts, union >> np.uint64(8))
        for c in range(len(names)):
            if not len(grams[c]):
                continue
            at = np.searchsorted(contexts, grams[c] >> np.uint64(8))
            total, distinct = np.bincount(at, seen[c], len(contexts)), np.bincount(at, minlength=len(contexts))
            known = np.flatnonzero(distinct)
            escape[known, c] = ngrams.units(distinct[known] / (total + distinct)[known])
            cost[:, c] += escape[of, c]
            cost[np.searchsorted(union, grams[c]), c] = ngrams.units(seen[c] / (total + distinct)[at])
        table.add(union, cost, contexts, escape)
    return names, table


def identify(df: DataFrame, model: tuple[list[str], ngrams.Table], id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """``id_col``, kept columns, ``lang_pred``, ``score`` and ``bits`` (code length under ``lang_pred``) of each row.

    score: the winner's share of 2 ** -length over all languages and plain
    bytes, so text in none of the languages has a score near 0.  Text that is
    null or has no letter: ``und``, score 0, bits null.  Ties go to the first
    language by name.  Letters are lowered; texts count whole; repeated rows
    give repeated results; an empty table gives no rows.
    """
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(columns):
        names, table = held.value
        for text in columns:
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_pylist()
            pred, score, bits, sizes = [], [], [], []

            def lowered(text=text, letters=letters, sizes=sizes):
                for x, ok in zip(text, letters, strict=True):
                    t = x.as_py().lower().encode("utf-8", "surrogatepass") if ok else b""
                    sizes.append(len(t))
                    yield t

            for k, row in enumerate(ngrams.score(table, lowered(), words=False)):
                if not letters[k] or not names:
                    pred.append(UNDETERMINED), score.append(0.0), bits.append(None)
                    continue
                best = int(row.argmin())
                pred.append(names[best])
                longer = np.append(row, 8 * ngrams.UNIT * sizes[k]) - row[best]
                score.append(float(1 / np.exp2(np.minimum(-longer / ngrams.UNIT, 1000)).sum()))
                bits.append(float(row[best] / ngrams.UNIT))
            yield [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())]

    return map_texts(df, id_col, text_col, list(keep), "lang_pred string, score double, bits double", run)


def fit(docs: DataFrame, train_rows, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = ROWS_PER_LANGUAGE):
    """A model from a bounded sample of the rows for which ``train_rows`` (a column) holds."""
    labelled = docs.where(train_rows & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    model = train(bounded_sample(labelled, rows, MAX_ROW_BYTES))
    release(docs.sparkSession)
    return model

"""Seams of chunks that come over time: a payload that two micro-batches share is found.

State keeps the end of each source's last chunk, a few hundred characters, for a
time to live; a batch's chunks of a source are put in order, the first one meets
what is kept, and the last one is kept in its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluicegate.operators.chunks import WINDOW_CHARS, edges_of, seam_findings

_KEPT = "place long, ordinal long, tail string"
_SEAMS = "ordinal long, next_ordinal long, tail string, head string"


def _frame(ordinal: list, after: list, tail: list, head: list) -> pd.DataFrame:
    return pd.DataFrame({"ordinal": ordinal, "next_ordinal": pd.array(after, "Int64"), "tail": tail, "head": head})


def _seams(ttl_ms: int | None):
    def run(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["place", "ordinal"], kind="stable")
        kept = state.get if state.exists else None
        at = [*zip(batch["place"].tolist(), batch["ordinal"].tolist(), strict=True)]
        late = [kept is not None and x <= (kept[0], kept[1]) for x in at]  # these stand first
        n = sum(late)
        ordinals, tails, heads = batch["ordinal"].tolist(), batch["tail"].tolist(), batch["start"].tolist()
        if n:
            yield _frame(ordinals[:n], [None] * n, tails[:n], [None] * n)
        if n == len(at):
            return
        before = [*([(kept[1], kept[2])] if kept else []), *zip(ordinals[n:], tails[n:], strict=True)][:-1]
        after = [*zip(ordinals[n:], heads[n:], strict=True)][0 if kept else 1 :]
        if after:
            yield _frame([o for o, _ in before], [o for o, _ in after], [t for _, t in before], [h for _, h in after])
        state.update((*at[-1], tails[-1]))
        if ttl_ms is not None:
            state.setTimeoutDuration(ttl_ms)

    return run


def boundary_stream(chunks: DataFrame, source: str, order: str, window_chars: int = WINDOW_CHARS, enabled: frozenset[str] | None = None, ttl_ms: int | None = 24 * 3600 * 1000) -> DataFrame:
    """Findings of seams of a stream of chunks, as ``chunks.scan_boundaries`` gives them for a table.

    chunks: ``source``, a whole-number ``order`` without nulls, ``ordinal`` and
    ``text``.  Chunks that come in order within their source give what the table
    would; one that stands before an earlier batch's last chunk gives a
    ``scan_incomplete`` finding, as its neighbours are no longer known.  A source
    that is silent for ``ttl_ms`` starts anew (None: never); a time to live needs
    a query that keeps running, since one that ends with its input
    (``availableNow``) would wait for it.  One task puts a
    batch's ends of chunks of one source in order, so batches bound its memory.
    """
    if window_chars < 1:
        raise ValueError("window_chars must be positive")
    rows = edges_of(chunks, source, order, window_chars).selectExpr("source", "cast(place as long) place", "cast(ordinal as long) ordinal", "tail", "start")
    timeout = GroupStateTimeout.NoTimeout if ttl_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    seams = rows.groupBy("source").applyInPandasWithState(_seams(ttl_ms), _SEAMS, _KEPT, "append", timeout)
    # a Python function may not stand right upon the state operator, whose rows are of another kind: this projection makes them plain
    plain = seams.select("ordinal", "next_ordinal", *(F.concat(c, F.lit("")).alias(c) for c in ("tail", "head")))
    return seam_findings(plain, enabled)

"""Stateful controls over ordered tables: a guarded memory, and a dispatcher with a call budget."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY, HOUR = 86_400, 3600
MAX_ENTRIES, MAX_CALLS, MAX_BODY = 100, 3, 10_000
_RESULT = "owner string, at double, event long, status string, answer long"


class Entries:
    """One owner's live entries, bounded in number."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def write(self, key: str, event: int, now: float, ttl: float) -> str:
        self.held = {k: e for k, e in self.held.items() if e[1] > now}
        if key not in self.held and len(self.held) >= self.most:
            return "full"
        self.held[key] = (event, now + ttl)
        return "stored"

    def read(self, key: str, now: float) -> int | None:
        event, until = self.held.get(key, (None, 0.0))
        return event if until > now else None


def guarded_memory(events: DataFrame, sources: frozenset[str], max_entries: int = MAX_ENTRIES) -> DataFrame:
    """``owner``, ``at``, ``event``, ``status``, ``answer`` of every event, in each owner's order.

    events: ``owner``, ``principal``, ``at`` (seconds), ``event`` (id), ``op``
    (write, read), ``key``, ``source``, ``ttl``, ``decision`` (of a scan of the
    text, made anew for every event).  A write is ``denied`` to others than the
    owner and to unknown sources, ``invalid`` with a time to live beyond a day or
    a bad key, ``withheld`` unless its scan accepts, ``full`` beyond the budget,
    else ``stored``.  A read answers with the live entry's event, or ``nothing``.
    Events go through their owner's state in order; a task holds the entries of
    one owner at a time and no group of rows.
    """
    columns = ["owner", "principal", "at", "event", "op", "key", "source", "ttl", "decision"]
    rows = events.select(F.col("owner").cast("string"), F.col("principal").cast("string"), F.col("at").cast("double"), F.col("event").cast("long"), *(F.col(c) for c in columns[4:7]), F.col("ttl").cast("double"), "decision")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, entries = None, Entries(max_entries)
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["owner"] != owner:
                    owner, entries = r["owner"], Entries(max_entries)
                answer = None
                if r["owner"] is None or r["principal"] != r["owner"] or (r["op"] == "write" and r["source"] not in sources):
                    status = "denied"
                elif not 1 <= len(r["key"] or "") <= 128 or (r["op"] == "write" and not 0 < (r["ttl"] or 0) <= DAY):
                    status = "invalid"
                elif r["op"] == "write":
                    status = entries.write(r["key"], r["event"], r["at"], r["ttl"]) if r["decision"] == "accept" else "withheld"
                else:
                    answer = entries.read(r["key"], r["at"])
                    status = "nothing" if answer is None else "withheld" if r["decision"] != "accept" else "answered"
                out.append({"owner": r["owner"], "at": r["at"], "event": r["event"], "status": status, "answer": answer if status == "answered" else None})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("owner", pa.string()), ("at", pa.float64()), ("event", pa.int64()), ("status", pa.string()), ("answer", pa.int64())]))

    return rows.repartition("owner").sortWithinPartitions("owner", "at", "event").mapInArrow(run, _RESULT)


def dispatch(calls: DataFrame, permissions: dict[str, frozenset[str]], description_sha256: str, max_calls: int = MAX_CALLS, max_body: int = MAX_BODY) -> DataFrame:
    """``session``, ``call``, ``status`` of every call: why it is refused, or ``sent``.

    calls: ``session``, ``call`` (order), ``principal``, ``description``,
    ``destination``, ``body``.  Checks come in order: the tool's description is
    the approved one, the destination is granted, the body fits, and the
    session has calls left; a call that reaches the last check and is refused
    there uses none.
    """
    granted = F.lit(False)
    for who, where in permissions.items():
        granted = granted | ((F.col("principal") == who) & F.col("destination").isin(*sorted(where)))
    refused = F.when(~F.coalesce(F.sha2("description", 256) == description_sha256, F.lit(False)), "description changed")
    refused = refused.when(~F.coalesce(granted, F.lit(False)), "not granted").when(F.length(F.coalesce("body", F.lit(""))) > max_body, "too long")
    marked = calls.withColumn("refused", refused)
    order = Window.partitionBy("session", F.col("refused").isNull()).orderBy("call")
    status = F.coalesce("refused", F.when(F.row_number().over(order) > max_calls, "no calls left").otherwise("sent"))
    return marked.select("session", "call", status.alias("status"))

"""Screening of streams: each micro-batch is scanned, decided and gated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sluicegate.operators import policy as P
from sluicegate.operators.scan import scan_documents


def screen_stream(docs: DataFrame, policy: P.Policy, released_path: str, quarantine_path: str, checkpoint: str, boundary: str = "ingestion") -> StreamingQuery:
    """Start a query that writes released text and quarantined fingerprints of a stream of documents.

    Scanning keeps no state between documents, so batches are exact; a batch's
    folder carries its number, so a batch that runs again overwrites itself.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            gated = P.release(P.decide(rows, scan_documents(rows), policy), policy, boundary).persist()
            gated.where("released").select("ordinal", "released_text", "content_sha256").write.mode("overwrite").parquet(f"{released_path}/batch={number}")
            gated.where("not released").select("ordinal", "decision", "families", "content_sha256").write.mode("overwrite").parquet(f"{quarantine_path}/batch={number}")
            gated.unpersist()
        finally:
            rows.unpersist()

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

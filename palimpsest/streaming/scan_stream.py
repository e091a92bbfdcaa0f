"""Scans of rows as they arrive. Findings are per document, so no state is kept; batches that come again overwrite themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.score import score_findings
from palimpsest.plans.scan import scan
from palimpsest.sources.traces import trace_of_texts


def scan_stream(texts: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Score a stream of (doc_id, text): each batch's scores are written as Parquet below ``out``, in a folder of its own."""
    def batch(rows: DataFrame, number: int) -> None:
        scored = score_findings(scan(trace_of_texts(rows)))
        scored.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

"""The history of scans kept by a stream: running statistics and the newest scans of each user, in state.

Scans come in any order and more than once (a producer that starts again sends what it has sent). Those that repeat
within the watermark are dropped by Spark's own state; what each user's state then holds doesn't hang on the order: counts, a sum, a
maximum, and the newest ``n`` scans, so a state is of bounded size however many scans a user has.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from palimpsest.functions.lexicon import RETENTION

SCAN = "id long, user_id long, token string, score int, verdict string, findings long, created_at timestamp"
_TOTALS = "scans long, flagged long, findings long, worst int"
_NEWEST = "ids array<long>, times array<long>"
UPDATED = f"user_id long, {_TOTALS}, newest array<long>"


class UserHistory(StatefulProcessor):
    """The state of one user: totals, and ids and times (microseconds) of the newest scans, the newest first."""

    def __init__(self, n: int = RETENTION) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _TOTALS)
        self.newest = handle.getValueState("newest", _NEWEST)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        scans, flagged, findings, worst = (self.totals.get() or (0, 0, 0, 0)) if self.totals.exists() else (0, 0, 0, 0)
        kept = list(zip(*reversed(self.newest.get()), strict=True)) if self.newest.exists() else []
        for part in rows:
            scans += len(part)
            flagged += int(part["verdict"].isin(["poisoned", "suspicious"]).sum())
            findings += int(part["findings"].fillna(0).sum())
            worst = max(worst, int(part["score"].fillna(0).max()))
            kept = sorted([*kept, *zip(part["micros"].tolist(), part["id"].tolist(), strict=True)], reverse=True)[: self.n]
        times, ids = [int(t) for t, _ in kept], [int(i) for _, i in kept]
        self.totals.update((scans, flagged, findings, worst))
        self.newest.update((ids, times))
        yield pd.DataFrame({"user_id": [key[0]], "scans": [scans], "flagged": [flagged], "findings": [findings], "worst": [worst], "newest": [ids]})

    def close(self) -> None:
        pass


def user_histories(scans: DataFrame, delay: str = "30 days", n: int = RETENTION) -> DataFrame:
    """A stream of scans as a stream of updates: user_id, scans, flagged, findings, worst, newest (ids of the newest ``n``), a row for each user that a batch has.

    Scans are told apart by user and token; one that comes again within ``delay`` counts once, one that is later than ``delay`` is dropped. Scans without
    a user belong to nobody and are left out; without a time or an id they can't be ordered and are left out too. A null score or number of findings is 0.
    """
    known = scans.where("user_id is not null and created_at is not null and id is not null").withWatermark("created_at", delay)
    once = known.dropDuplicatesWithinWatermark(["user_id", "token"])
    rows = once.select("user_id", "id", F.unix_micros("created_at").alias("micros"), F.col("score").cast("int").alias("score"), "verdict", F.col("findings").cast("long").alias("findings"))
    return rows.groupBy("user_id").transformWithStateInPandas(UserHistory(n), UPDATED, "Append", "None")


def keep_histories(scans: DataFrame, out: str, checkpoint: str, delay: str = "30 days", n: int = RETENTION, available_now: bool = True) -> StreamingQuery:
    """Write the updates of a stream of scans below ``out``, a folder for each batch; a batch that is run again overwrites itself.

    State is kept in RocksDB, so it may be larger than an executor's memory (the session's provider is set where it isn't already).
    """
    scans.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def batch(rows: DataFrame, number: int) -> None:
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/{number}")

    writer = user_histories(scans, delay, n).writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def histories(spark: SparkSession, out: str) -> DataFrame:
    """The last update of each user below ``out``."""
    rows = spark.read.schema(f"{UPDATED}, batch long").option("recursiveFileLookup", "true").parquet(out)
    last = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("batch")))
    return rows.withColumn("last", last).where("last = 1").drop("last", "batch")

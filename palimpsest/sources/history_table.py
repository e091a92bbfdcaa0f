"""The history of scans as a table of Parquet files, of which a change rewrites only the buckets of the users it is about.

Scans lie in partitions by a hash of their user (those of guests by a hash of their token), so that saving, deleting, a user's own history
and statistics read and write the buckets of these users. Within a bucket rows are sorted by token and files have a Bloom
filter on it, so a look-up by token opens few row groups though it doesn't know the user. A change is written beside the table first, and then put in place of its buckets by
Spark's dynamic overwrite of partitions. One writer at a time: a table format with commits of its own is what several need, and none is rebuilt here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.functions.lexicon import RETENTION
from palimpsest.operators import history as H
from palimpsest.sources.scratch import scratch_folder

SCHEMA = "id long, user_id long, token string, filename string, sha256 string, bytes long, score int, verdict string, findings long, source string, report string, created_at timestamp"
BUCKETS = 256


class HistoryTable:
    """The history below a path. ``buckets`` must be the number that it was made with."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, schema: str = SCHEMA, row_group_bytes: int = 8 << 20) -> None:
        self.spark, self.path, self.buckets, self.schema, self.row_group_bytes = spark, path, buckets, schema, row_group_bytes

    def bucket(self, user_id: Column, token: Column) -> Column:
        """Where a scan lies: by its user, or by its token where it has none."""
        return F.pmod(F.when(user_id.isNotNull(), F.xxhash64(user_id)).otherwise(F.xxhash64(token)), F.lit(self.buckets)).cast("int")

    def _own(self, scans: DataFrame) -> DataFrame:
        """Scans with the table's columns (missing ones null) and their bucket."""
        fields = self.spark.createDataFrame([], self.schema).schema
        rows = scans.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in scans.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields))
        return rows.withColumn("bucket", self.bucket(F.col("user_id"), F.col("token")))

    def _write(self, rows: DataFrame, path: str) -> None:
        # a hash of the token beside the bucket spreads a hot user's bucket over a few files
        dealt = rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("token"), F.lit(4))).sortWithinPartitions("bucket", "token")
        (
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#token", "true")
            .option("parquet.block.size", str(self.row_group_bytes)).partitionBy("bucket").parquet(path)
        )

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The history, or what is in these buckets of it."""
        rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(self.path)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def create(self, scans: DataFrame) -> None:
        """Write the table anew."""
        self._write(self._own(scans), self.path)

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets that rows (user_id, token) are about: no more than there are buckets."""
        return [r[0] for r in rows.select(self.bucket(F.col("user_id"), F.col("token")).alias("b")).distinct().collect()]

    def _replace(self, rows: DataFrame, buckets: list[int]) -> None:
        """Put rows in place of what these buckets hold. They are written elsewhere first, as they are made from the buckets themselves."""
        aside = scratch_folder(self.spark, "history")
        self._write(rows, aside)
        left = self.spark.read.schema(f"{self.schema}, bucket int").parquet(aside)
        full = {r[0] for r in left.select("bucket").distinct().collect()}
        self._write(left, self.path)
        for b in set(buckets) - full:  # nothing is left in it, and an overwrite of partitions leaves alone what it has no rows for
            _delete(self.spark, f"{self.path}/bucket={b}")
        _delete(self.spark, aside)

    def save(self, new: DataFrame, n: int = RETENTION) -> list[int]:
        """Add scans and trim the users that have them to the newest ``n``; the buckets that were read and written. A scan whose id is there already takes its place."""
        new = self._own(new).dropDuplicates(["id"])
        buckets = self._touched(new)
        if buckets:
            old = self.read(buckets).join(new.select("id"), "id", "left_anti").select(*new.columns)
            self._replace(H.save(old, new, n), buckets)
        return buckets

    def delete(self, gone: DataFrame) -> list[int]:
        """Delete the scans that rows (token, user_id) name (a null user_id: a guest's scan); the buckets that were read and written."""
        buckets = self._touched(gone)
        if buckets:
            self._replace(H.delete(self.read(buckets), gone), buckets)
        return buckets

    def claim(self, claims: DataFrame) -> list[int]:
        """Give guests' scans that rows (token, claimed_by) name to these users; the buckets that were read and written."""
        named = claims.where("token is not null and claimed_by is not null").groupBy("token").agg(F.min("claimed_by").alias("claimed_by"))
        guests = self.read(self._touched(named.select(F.lit(None).cast("long").alias("user_id"), "token"))).where("user_id is null")
        moved = H.claim(guests.join(named.select("token"), "token", "left_semi").select(*guests.columns), named)
        moved = self._own(moved)
        both = moved.select("user_id", "token").unionByName(moved.select(F.lit(None).cast("long").alias("user_id"), "token"))
        buckets = self._touched(both)
        if buckets:
            rest = self.read(buckets).join(moved.select("id"), "id", "left_anti").select(*moved.columns)
            self._replace(rest.unionByName(moved), buckets)
        return buckets

    def recent(self, user_id: int, n: int = 50) -> DataFrame:
        """A user's newest scans, without their reports, from the user's bucket."""
        return H.recent(self.read(self._touched(self._user(user_id))), user_id, n).drop("bucket")

    def stats(self, user_id: int) -> DataFrame:
        """A user's statistics, from the user's bucket."""
        return H.user_stats(self.read(self._touched(self._user(user_id))).where(F.col("user_id") == user_id))

    def by_token(self, token: str) -> DataFrame:
        """The scan with a token: of the table those row groups are read whose Bloom filter and bounds may have it."""
        return H.by_token(self.read(), token).drop("bucket")

    def _user(self, user_id: int) -> DataFrame:
        return self.spark.createDataFrame([(user_id, None)], "user_id long, token string")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

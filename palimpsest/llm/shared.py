"""Small helpers shared by the operators: the shared folder, written tables, text values."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``; only in a local session without that
    (as in tests) a temporary folder is made and set. On a cluster executors wouldn't see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one operator; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _, path = self.paths.pop(id(t))
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dealt(df: DataFrame, keys: str | list[str], *order: str) -> DataFrame:
    """``df`` dealt out by ``keys`` and sorted by them and ``order``, for a Python stage that reads a key's rows in a run.

    The expression is dealt by no other operator, so Spark can't take a join's exchange for it:
    that one may be read locally or split later, which would part the rows of a key.
    """
    keys = [keys] if isinstance(keys, str) else keys
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two columns (k1, k2), never null, that rows share when their doc_id and text are equal."""
    return F.coalesce(doc_id, F.lit(0)).cast("long").alias("k1"), F.xxhash64(doc_id.isNull(), text).alias("k2")


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column's values."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's values, one after the other, and where each begins (and the last ends); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    ends = np.frombuffer(at, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64) if at is not None and len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


class Memo(dict):
    """A dict that computes missing values and starts again when it is full, so that its memory is bounded."""

    def __init__(self, make: Callable, limit: int) -> None:
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def slices(batches: Iterator[pa.RecordBatch], rows: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most so many rows, and of about ``size`` bytes where more than a row is in them."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

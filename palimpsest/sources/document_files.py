"""One file a document: traces and reports as files, read and written by tasks.

``DocumentFiles`` is a data source of rows (name, content). Its reader deals files out to tasks by their size. Its writer has each
attempt of a task write into a folder of its own, and moves files to their names only when the driver commits what succeeded; an attempt that is
killed leaves nothing under a document's name, and its folder goes when the job ends. Paths may be in any store that pyarrow opens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from palimpsest.sources.traces import SCHEMAS, Trace, trace_of

FORMAT = "document_files"
ROW = "name string, content string"
#: Where attempts write, below the path of the table. Readers pass names over that begin with an underscore.
_ASIDE = "_attempts"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


class _Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.suffix, self.size = options["path"], options.get("suffix", ""), int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        store, root = _place(self.path)
        parts, total = [], 0
        for f in sorted(store.get_file_info(fs.FileSelector(root, allow_not_found=True)), key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and f.base_name.endswith(self.suffix):
                if not parts or total + f.size > self.size:
                    parts.append([])
                    total = 0
                parts[-1].append(f.path)
                total += f.size + 4096
        return [_Part(p) for p in parts]

    def read(self, partition: _Part | None) -> Iterator[tuple]:
        store, _ = _place(self.path)
        for path in partition.paths if partition else ():  # none: a folder without files
            with store.open_input_stream(path) as f:
                yield path.rsplit("/", 1)[-1], f.read().decode("utf-8", "replace")


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = _place(self.path)
        folder, names = f"{root}/{_ASIDE}/{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            if not row["name"] or "/" in row["name"] or row["name"].startswith(("_", ".")):
                raise ValueError(f"{row['name']!r} is no name of a file")
            if not names:
                store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{row['name']}") as f:
                f.write((row["content"] or "").encode())
            names.append(row["name"])
        return _Written(folder, names)

    def commit(self, messages: list) -> None:
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        done = [m for m in messages if m is not None]
        if self.overwrite:
            kept = {n for m in done for n in m.names}
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and f.base_name not in kept:
                    store.delete_file(f.path)
        for m in done:
            for name in m.names:
                store.move(f"{m.folder}/{name}", f"{root}/{name}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _place(self.path)
        if store.get_file_info(f"{root}/{_ASIDE}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{_ASIDE}/{self.job}")


class DocumentFiles(DataSource):
    """Rows (name, content), a file each. Options: path; suffix (which files to read); partitionBytes (how much a task reads)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROW

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def read_documents(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(name, content) of the files of a folder whose names end so."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format(FORMAT).option("suffix", suffix).load(path)


def write_documents(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write rows (name, content) as files; those of earlier rows with the same name are replaced, with ``overwrite`` all others go.

    A null content is an empty file. Of rows that share a name one is written, the one with the greatest content. A null or empty name, one with a slash, and
    one that begins with a dot or an underscore fail the job, and nothing of it is written.
    """
    rows.sparkSession.dataSource.register(DocumentFiles)
    one = rows.groupBy("name").agg(F.max("content").alias("content"))
    one.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(path)


def write_traces(trace: Trace, path: str, overwrite: bool = False) -> None:
    """Each document of a trace as a file ``<doc_id>.trace.json`` that holds its rows of all tables."""
    out = trace.docs.select("doc_id").where("doc_id is not null").distinct()
    for name in SCHEMAS:
        rows = getattr(trace, name)
        kept = [c for c in rows.columns if c != "doc_id"]
        out = out.join(rows.groupBy("doc_id").agg(F.collect_list(F.struct(*kept)).alias(name)), "doc_id", "left")
    content = F.to_json(F.struct("doc_id", *SCHEMAS))
    write_documents(out.select(F.concat("doc_id", F.lit(".trace.json")).alias("name"), content.alias("content")), path, overwrite)


def read_trace_files(spark: SparkSession, path: str) -> Trace:
    """The trace of the documents whose files ``write_traces`` wrote. A file that holds no such JSON is a document whose status is ``unreadable``."""
    own = lambda name: spark.createDataFrame([], SCHEMAS[name]).drop("doc_id").schema.simpleString()
    shape = "doc_id string, " + ", ".join(f"{name} array<{own(name)}>" for name in SCHEMAS)
    rows = read_documents(spark, path, ".trace.json").select("name", F.from_json("content", shape).alias("t"))
    good = rows.where("t.doc_id is not null")
    tables = {name: good.select("t.doc_id", F.explode(f"t.{name}").alias("r")).select("doc_id", "r.*") for name in SCHEMAS}
    bad = rows.where("t.doc_id is null").select(F.regexp_replace("name", r"\.trace\.json$", "").alias("doc_id"), F.col("name").alias("filename"), F.lit("unreadable").alias("status"))
    tables["docs"] = tables["docs"].unionByName(bad, allowMissingColumns=True)
    return trace_of(spark, **tables)

"""Conflict-constrained best-fit packing of token sequences into bins of a fixed capacity.

Documents are dealt to shards by a hash, as many as make shards of a bounded size, and
each shard is packed by best fit in order of falling size. Its bins stand in order of their
residual; a successor search goes from the tightest bin that has room to wider ones until it finds
one that the document is compatible with. Every bin carries bitmaps: one of the duplicate clusters
that it holds, and one of sources for each further document that a source may still add.
A bin never holds two documents of one cluster, nor more than ``max_per_source`` of one source.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.shared import dealt, slices, utf8, written

OUT = "doc_id long, piece int, n_tokens long, bin string, offset long"


class Bins:
    """The open bins of a shard in order of residual."""

    def __init__(self, capacity: int, max_per_source: int) -> None:
        self.capacity, self.planes = capacity, max_per_source
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins of each residual, the oldest first
        self.residuals: list[int] = []  # those that have bins, rising
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.used: list[int] = []

    def put(self, size: int, cluster: int, source: int) -> tuple[int, int]:
        """The bin and the offset in it. ``cluster`` and ``source`` are single bits (a cluster of one document: 0)."""
        for at in range(bisect_left(self.residuals, size), len(self.residuals)):
            residual = self.residuals[at]
            for i, b in enumerate(self.by_residual[residual]):
                if not self.clusters[b] & cluster and not self.sources[b][-1] & source:
                    del self.by_residual[residual][i]
                    if not self.by_residual[residual]:
                        del self.residuals[at]
                    return self._fill(b, size, cluster, source)
        self.clusters.append(0)
        self.sources.append([0] * self.planes)
        self.used.append(0)
        return self._fill(len(self.used) - 1, size, cluster, source)

    def _fill(self, b: int, size: int, cluster: int, source: int) -> tuple[int, int]:
        offset = self.used[b]
        self.used[b] += size
        self.clusters[b] |= cluster
        for plane, bits in enumerate(self.sources[b]):  # plane k has the sources with more than k documents
            if not bits & source:
                self.sources[b][plane] |= source
                break
        residual = self.capacity - self.used[b]
        if residual:
            if not self.by_residual[residual]:
                insort(self.residuals, residual)
            insort(self.by_residual[residual], b)
        return b, offset


def pack(rows: list[tuple], capacity: int, max_per_source: int) -> list[tuple]:
    """(row number, piece, tokens, bin, offset) for rows of (doc_id, tokens, cluster, source); what is over whole bins is packed last."""
    n_cluster = Counter(r[2] for r in rows if r[2] is not None)
    cluster_bit = {c: 1 << i for i, c in enumerate(c for c, n in n_cluster.items() if n > 1)}
    source_bit: dict = {}
    bins, out = Bins(capacity, max_per_source), []
    rests = []
    for i, (_, tokens, cluster, source) in enumerate(rows):
        whole = tokens // capacity
        for piece in range(whole):
            out.append((i, piece, capacity, *bins.put(capacity, 0, 0)))
        if tokens % capacity:
            rests.append((tokens % capacity, i, whole, cluster_bit.get(cluster, 0), source_bit.setdefault(source, 1 << len(source_bit))))
    for size, i, piece, cluster, source in sorted(rests, key=lambda r: (-r[0], r[1])):
        out.append((i, piece, size, *bins.put(size, cluster, source)))
    return out


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, max_per_source: int) -> Iterator[pa.RecordBatch]:
    shard, rows = None, []

    def packed() -> pa.RecordBatch:
        out = pack(rows, capacity, max_per_source)
        columns = [[rows[i][0] for i, *_ in out], [p for _, p, *_ in out], [n for _, _, n, *_ in out], [f"{shard}-{b}" for *_, b, _ in out], [o for *_, o in out]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    for batch in batches:
        for s, *row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if s != shard and rows:
                yield packed()
                rows = []
            shard = s
            rows.append(row)
    if rows:
        yield packed()


def pack_documents(sizes: DataFrame, capacity: int = 8192, max_per_source: int = 8, shard_rows: int = 4096) -> DataFrame:
    """Of rows (doc_id, n_tokens, cluster, source): doc_id, piece, n_tokens, bin, offset.

    A row longer than ``capacity`` fills whole bins with its first pieces; no token is left out. Rows
    without tokens (null or 0) take no bin and give no row. A null cluster conflicts with none; a null source is a
    source like others. Repeated rows are packed each, and conflict where they have a cluster. Shards hold
    about ``shard_rows`` rows whatever the table's size, so a task's memory doesn't grow with it; an empty
    table gives an empty result. Other columns are not read.
    """
    rows = sizes.select(F.col("doc_id").cast("long"), F.col("n_tokens").cast("long"), F.col("cluster").cast("long"), F.col("source").cast("string")).where("n_tokens > 0")
    rows = written(rows.withColumn("salt", F.monotonically_increasing_id()), "sizes")  # which is fixed by this
    n = math.ceil(rows.count() / shard_rows) or 1
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "salt"), F.lit(n)))
    return dealt(rows.select("shard", "doc_id", "n_tokens", "cluster", "source"), "shard", "doc_id", "n_tokens", "cluster", "source").mapInArrow(lambda it: _pack(it, capacity, max_per_source), OUT)


def _sizes(batches: Iterator[pa.RecordBatch], tokenizer: str, by_word: bool, end: int) -> Iterator[pa.RecordBatch]:
    from palimpsest.llm.token_records import _encoder

    encoder = _encoder(tokenizer, by_word)
    for batch in slices(batches, 200):
        texts = utf8(batch.column(2))
        n = np.fromiter((len(ids) + end for ids in encoder.encode(texts)), np.int64, batch.num_rows)
        plain = [b" ".join(t.lower().split()) if t else b"" for t in texts]
        cluster = pa.array([xxhash.xxh3_64_intdigest(t) - (1 << 63) if t else None for t in plain], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cluster, pa.array(n)], names=["doc_id", "source", "cluster", "n_tokens"])


def document_sizes(docs: DataFrame, tokenizer: str, by_word: bool = False, end_tokens: int = 1) -> DataFrame:
    """doc_id, source, cluster (a hash of the text with A-Z in lower case and single spaces), n_tokens with ``end_tokens`` after each text.

    A null text is empty and, like an empty one, has no cluster.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: _sizes(it, tokenizer, by_word, end_tokens), "doc_id long, source string, cluster long, n_tokens long")

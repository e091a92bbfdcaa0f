"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A record is framed as

    length of the payload   8 bytes, little-endian
    masked CRC-32 of those  4 bytes
    payload                 the ids, little-endian, 2 or 4 bytes each
    masked CRC-32 of it     4 bytes

with the mask ((crc >> 15 | crc << 17) + 0xA282EAD8) mod 2^32, so that a checksum of data that
hold checksums stays useful. The index of a shard has a header (magic, bytes of an id) and for
each record its doc_id, the offset of its frame and its number of ids; a reader can thus read a
shard in any order. Documents are dealt by range of doc_id, one shard for each task, so shards in
order hold ascending ids.

Every attempt of a task writes files of its own, and only the manifest, which Spark writes from the
attempts that succeeded, says which files count.
"""

from __future__ import annotations

import functools
import json
import math
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from palimpsest.llm.shared import new_folder, slices, utf8, written

MAGIC = b"TOKIDX01"
INDEX = np.dtype([("doc_id", "<i8"), ("no_id", "u1"), ("offset", "<u8"), ("n_ids", "<u8")])
MANIFEST = "shard long, records string, index string, n_records long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, offset long"

_MARKED = re.compile(r"(\w+)[!-/:-@\[-^`{-~]+")


def masked(data: bytes) -> int:
    """The masked CRC-32 of the data."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(read, at: int) -> bytes:
    """The payload of the record that begins here; ``read(n)`` gives the next n bytes."""
    head = read(12)
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
        raise ValueError(f"record at {at}: its length is damaged")
    n = struct.unpack("<Q", head[:8])[0]
    body = read(n + 4)
    if len(body) < n + 4 or struct.unpack("<I", body[n:])[0] != masked(body[:n]):
        raise ValueError(f"record at {at}: its ids are damaged")
    return body[:n]


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


class TextEncoder:
    """Ids of whole texts by a tokenizer file of the tokenizers library.

    ``by_word`` is for lower-casing tokenizers that drop white space before they split, so that a text's ids
    are those of its words, one after the other. Distinct words are then encoded once each, many
    in a call; their memory is bounded.
    """

    LIMIT = 700_000

    def __init__(self, path: str, by_word: bool = False) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = by_word
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        tokens = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(tokens.values()) + 1 if suffix else 0, bool)
        self.ends[[i for t, i in tokens.items() if suffix and t.endswith(suffix)]] = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, ids: list[np.ndarray]) -> None:
        n, total = len(self.known) - len(ids), sum(map(len, ids))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.known) > len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths))
        lengths = np.array([len(x) for x in ids], np.int64)
        self.flat[self.used : self.used + total] = np.concatenate(ids) if ids else []
        self.starts[n : n + len(ids)], self.lengths[n : n + len(ids)] = self.used + np.cumsum(lengths) - lengths, lengths
        self.used += total

    def _encode_words(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        # letters, or letters and marks after them, are one or two units of the tokenizer, whose last token says that it ends
        # (as the tokenizer sees them: lower-casing may part a letter into a letter and an accent)
        seen = (t if t.isascii() else unicodedata.normalize("NFC", t).lower() for t in texts)
        units = [1 if t.isalpha() else 2 if (m := _MARKED.fullmatch(t)) and m[1].isalpha() else 0 for t in seen]
        plain = [i for i, u in enumerate(units) if u] if len(self.ends) else []
        out: list = [None] * len(words)
        for at in range(0, len(plain), 5000):
            part = plain[at : at + 5000]
            ids = np.array(self._ids(" ".join(texts[i] for i in part)), np.uint32)
            ends, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum([units[i] for i in part])
            if len(ends) != last[-1]:  # the tokenizer takes another view of some word (a letter that it doesn't know), so each word is encoded alone
                continue
            start = 0
            for i, end in zip(part, ends[last - 1].tolist(), strict=True):
                out[i] = ids[start:end]
                start = end
        for i, x in enumerate(out):
            if x is None:
                out[i] = np.array(self._ids(texts[i]), np.uint32)
        self._add(out)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The ids of each text; none of null."""
        if not self.by_word:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([(t or b"").decode() for t in texts], add_special_tokens=False)]
        if len(self.known) > self.LIMIT:
            self.clear()
        known, fresh, at, counts = self.known, [], [], []
        for t in texts:
            # lower-casing A-Z changes nothing here as the tokenizer does it too, but must not make a special token
            words = (t if b"<|" in (t := t or b"") else t.lower()).split()
            counts.append(len(words))
            for w in words:
                i = known.get(w)
                if i is None:
                    i = known[w] = len(known)
                    fresh.append(w)
                at.append(i)
        if fresh:
            self._encode_words(fresh)
        words = np.array(at, np.int64)
        lengths = self.lengths[words]
        ends = np.cumsum(lengths)
        flat = self.flat[np.repeat(self.starts[words] - (ends - lengths), lengths) + np.arange(lengths.sum())]
        cuts = np.r_[0, ends][np.cumsum(counts)]
        return np.split(flat, cuts[:-1])


#: One for a worker process, so that its tasks share what it knows.
_encoder = functools.lru_cache(1)(TextEncoder)


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, by_word: bool, end_id: int | None) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, by_word)
    shard = TaskContext.get().partitionId()
    filesystem, root = _place(folder)
    filesystem.create_dir(root, recursive=True)
    name = f"{root}/{shard:06d}-{uuid.uuid4().hex}"
    end = [] if end_id is None else [end_id]
    entries, index, n_records, offset, n_tokens = [], [], 0, 0, 0
    with filesystem.open_output_stream(f"{name}.records") as out:
        for batch in slices(batches, 200):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(utf8(batch.column(1))), strict=True):
                payload = np.append(ids, np.array(end, np.uint32)).astype(f"<u{encoder.width}").tobytes()
                record = frame(payload)
                out.write(record)
                entries.append((doc_id or 0, doc_id is None, offset, len(payload) // encoder.width))
                offset += len(record)
                n_tokens += len(payload) // encoder.width
            index.append(np.array(entries, INDEX).tobytes())
            n_records += len(entries)
            entries.clear()
    if n_records:
        with filesystem.open_output_stream(f"{name}.index") as out:
            out.write(MAGIC + struct.pack("<Q", encoder.width) + b"".join(index))
        yield pa.RecordBatch.from_pylist([{"shard": shard, "records": f"{name}.records", "index": f"{name}.index", "n_records": n_records, "n_tokens": n_tokens}])


def write_records(docs: DataFrame, tokenizer: str, folder: str | None = None, by_word: bool = False, end_id: int | None = None, shard_mb: int = 64) -> DataFrame:
    """Write the ids of every whole text as record files in ascending order of doc_id, and return their manifest.

    One row for each shard: shard, records and index (paths), n_records, n_tokens. ``tokenizer``
    is a file of the tokenizers library that every executor can read, ``by_word`` as in
    ``TextEncoder``, and ``end_id`` closes each document. ``folder`` (by default a new one in the shared folder) may be in any store that pyarrow
    opens. A shard holds about ``shard_mb`` MB of text or less, however large the table is, and there are no fewer shards than
    shuffle partitions. A null text is empty; a row with a null doc_id comes first and is marked in the index; rows with
    equal doc_id are ordered by a hash of their text and may be in several shards; an empty table writes no shard. Other
    columns are not read.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-records")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(math.ceil(size / (shard_mb * 1e6)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = texts.withColumn("order", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "order").sortWithinPartitions("doc_id", "order", "text").select("doc_id", "text")
    return written(texts.mapInArrow(lambda it: _write(it, folder, tokenizer, by_word, end_id), MANIFEST), "token-manifest")


def read_shard(records: str, index: str, order_seed: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, offset, ids) of each record of a shard, as written or in an order drawn by the seed; checksums are verified."""
    filesystem, path = _place(index)
    with filesystem.open_input_stream(path) as f:
        data = f.read()
    if data[:8] != MAGIC:
        raise ValueError(f"{index} is no index")
    width, entries = struct.unpack("<Q", data[8:16])[0], np.frombuffer(data, INDEX, offset=16)
    filesystem, path = _place(records)
    if order_seed is None:
        source = filesystem.open_input_stream(path, buffer_size=1 << 20)
    else:
        source = filesystem.open_input_file(path)
        entries = np.random.default_rng(order_seed).permutation(entries)
    with source as f:
        for e in entries:
            if order_seed is not None:
                f.seek(int(e["offset"]))
            ids = np.frombuffer(unframe(f.read, int(e["offset"])), f"<u{width}")
            if len(ids) != e["n_ids"]:
                raise ValueError(f"record at {e['offset']}: the index has {e['n_ids']} ids")
            yield None if e["no_id"] else int(e["doc_id"]), int(e["offset"]), ids


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ROWS.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            start, rows = row["start"], []
            for doc_id, offset, ids in read_shard(row["records"], row["index"]):
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), row["shard"], offset))
                start += len(ids)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def read_records(manifest: DataFrame) -> DataFrame:
    """Per document of the record files: doc_id, start (ids of all before it), n_tokens, ids_crc32, shard, offset.

    ids_crc32 is the CRC-32 of the ids as little-endian unsigned 32-bit integers. Each shard is read by one task.
    """
    before = F.sum("n_tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))  # a row for each shard
    shards = manifest.withColumn("start", F.coalesce(before, F.lit(0)))
    return shards.repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(_read, ROWS)

"""Benchmark decontamination by greedy string tiling.

The benchmark is taken in blocks of a bounded size. Each block becomes an index of the
k-token seeds of its items (k is the shortest tile), which every task that scans
documents gets; documents are never shuffled. A rolling Karp-Rabin hash finds the seeds
in a document, seeds that follow each other on a diagonal join to matches, and the
longest match whose tokens are not marked yet is marked, again and again, until no
match of k tokens is left. The share of an item's tokens that tiles cover decides, so an
item whose sentences are reordered is found like one that is copied as it is.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.shared import Memo, slices, utf8, written

SCHEMA = "doc_id long, text_id long, item_tokens int, covered_tokens int, n_tiles int, coverage double"
ARROW = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("item_tokens", pa.int32()), ("covered_tokens", pa.int32()), ("n_tiles", pa.int32()), ("coverage", pa.float64())])

_OTHER = re.compile(r"[\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
SEEDS = 4_000_000  # that are looked at at once
OUTSIDE, NOTHING = 0, -1  # the id of a word that no item has, and of a token without letters or digits


def normal(word: bytes) -> str:
    """A white-space separated token in lower case without anything but letters and digits."""
    return _OTHER.sub("", word.decode("utf-8", "replace").lower())


def tokens(text: bytes | None) -> list[str]:
    """The normal tokens of a text; those without letters or digits are left out."""
    return [t for t in map(normal, (text or b"").split()) if t]


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of each window of k ids."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    v, h = ids.astype(np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _BASE + v[j : j + n]
    return h ^ (h >> np.uint64(29))


class Index:
    """The seeds of one block of items: token ids, and for each seed length sorted hashes with item and position."""

    def __init__(self, items: list[tuple[int, bytes | None]], min_tile: int) -> None:
        self.vocabulary: dict[str, int] = {}
        self.item_ids: list[int] = []
        self.items: list[np.ndarray] = []
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            ids = np.array([self.vocabulary.setdefault(t, len(self.vocabulary) + 1) for t in tokens(text)], np.int32)
            if not len(ids):
                continue
            k = min(min_tile, len(ids))
            by_length.setdefault(k, []).append((rolling(ids, k), len(self.items)))
            self.item_ids.append(item_id)
            self.items.append(ids)
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.seeds = {}
        for k, found in by_length.items():
            h = np.concatenate([x for x, _ in found])
            item = np.concatenate([np.full(len(x), i, np.int64) for x, i in found])
            at = np.concatenate([np.arange(len(x), dtype=np.int64) for x, _ in found])
            order = np.argsort(h, kind="stable")
            self.seeds[k] = (h[order], item[order], at[order])


def tiles(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from the seeds (position in doc, position in item): (item start, doc start, length) of each tile.

    Of equally long matches the first in the item, then in the document, is marked first.
    """
    runs: dict[int, list[int]] = {}
    heap = []
    for i, j in sorted(seeds, key=lambda s: (s[0] - s[1], s[0])):
        run = runs.get(i - j)
        if run and run[0] + run[1] == i:
            run[1] += 1
        else:
            if run:
                heap.append((-(run[1] + k - 1), run[0] - (i - j), run[0]))
            runs[i - j] = [i, 1]
    heap += [(-(length + k - 1), i - diagonal, i) for diagonal, (i, length) in runs.items()]
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(len(item), bool), set(), []
    while heap and not in_item.all():
        length, j, i = heapq.heappop(heap)
        length = -length
        start = None
        whole = True
        for x in range(length + 1):  # the parts that are not marked yet
            free = x < length and not in_item[j + x] and (i + x) not in in_doc and doc[i + x] == item[j + x]
            if free and start is None:
                start = x
            elif not free and x < length:
                whole = False
            if not free and start is not None:
                if whole:
                    break
                if x - start >= k:
                    heapq.heappush(heap, (-(x - start), j + start, i + start))
                start = None
        if whole:
            in_item[j : j + length] = True
            in_doc.update(range(i, i + length))
            out.append((j, i, length))
    return out


def _entries(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers low, low + 1, ... of each, as many as there are."""
    return np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _pieces(many: np.ndarray) -> Iterator[slice]:
    """Slices whose sums are SEEDS at most, or of one."""
    at, ends = 0, np.cumsum(many)
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SEEDS, "right")))
        yield slice(at, to)
        at = to


def _seeds(where: np.ndarray, low: np.ndarray, many: np.ndarray, doc: np.ndarray, index: Index, k: int, min_coverage: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions, items and places in items of the seeds, all of a document and an item together, about SEEDS at a time.

    A document with more of them is first asked which items have enough seeds to be covered, and these are taken in turn.
    """
    _, item, at = index.seeds[k]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    sums = np.add.reduceat(many, first)
    to = np.r_[first[1:], len(doc)]
    for part in _pieces(sums):
        span = slice(first[part.start], to[part.stop - 1])
        if sums[part].sum() <= SEEDS:
            entry = _entries(low[span], many[span])
            yield np.repeat(where[span], many[span]), item[entry], at[entry]
            continue
        counts = np.zeros(len(index.items), np.int64)
        for piece in _pieces(many[span]):
            counts += np.bincount(item[_entries(low[span][piece], many[span][piece])], minlength=len(counts))
        asked = np.flatnonzero(counts * k >= min_coverage * index.lengths)
        for chosen in _pieces(counts[asked]):
            wanted = np.zeros(len(counts), bool)
            wanted[asked[chosen]] = True
            found = []
            for piece in _pieces(many[span]):
                entry = _entries(low[span][piece], many[span][piece])
                keep = wanted[item[entry]]
                found.append((np.repeat(where[span][piece], many[span][piece])[keep], item[entry][keep], at[entry][keep]))
            yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _scan(batches: Iterator[pa.RecordBatch], index: Index, min_coverage: float) -> Iterator[pa.RecordBatch]:
    ids_of = Memo(lambda w: index.vocabulary.get(t, OUTSIDE) if (t := normal(w)) else NOTHING, 200_000)
    for batch in slices(batches, 2000):
        docs, parts = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
            words = (text or b"").split()
            if words:
                ids = np.fromiter(map(ids_of.__getitem__, words), np.int32, len(words))
                docs.append(doc_id)
                parts += [ids[ids != NOTHING], np.zeros(1, np.int32)]
        if not docs:
            continue
        flat = np.concatenate(parts)
        ends = np.cumsum([len(x) for x in parts])[1::2]
        out = []
        for k, (hashes, _, _) in index.seeds.items():
            h = rolling(flat, k)
            valid = np.ones(len(h), bool)
            for j in range(k):
                valid &= flat[j : j + len(h)] != OUTSIDE
            where = np.flatnonzero(valid)
            low = np.searchsorted(hashes, h[where], "left")
            many = np.searchsorted(hashes, h[where], "right") - low
            where, low, many = where[many > 0], low[many > 0], many[many > 0]
            if not len(where):
                continue
            doc = np.searchsorted(ends, where, "right")
            for pos, items, starts in _seeds(where, low, many, doc, index, k, min_coverage):
                doc = np.searchsorted(ends, pos, "right")
                pair = doc * len(index.items) + items
                order = np.argsort(pair, kind="stable")
                pair, pos, starts, doc, items = pair[order], pos[order], starts[order], doc[order], items[order]
                cuts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
                for a, b in zip(cuts, [*cuts[1:], len(pair)], strict=True):
                    n = int(index.lengths[items[a]])
                    if (b - a) * k < min_coverage * n or len(np.unique(starts[a:b])) * k < min_coverage * n:
                        continue  # its tiles can't cover enough
                    found = tiles(flat, index.items[items[a]], list(zip(pos[a:b].tolist(), starts[a:b].tolist(), strict=True)), k)
                    covered = sum(t[2] for t in found)
                    if covered >= min_coverage * n:
                        out.append((docs[doc[a]], index.item_ids[items[a]], n, covered, len(found), covered / n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out, strict=True), ARROW, strict=True)], schema=ARROW)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_tile: int = 4, min_coverage: float = 0.5, block_mb: float = 8.0) -> DataFrame:
    """The pairs of documents and benchmark items whose tiles cover at least ``min_coverage`` of the item's tokens.

    One row for each pair: doc_id, item_id, item_tokens, covered_tokens, n_tiles, coverage.
    Tokens are separated by white space, in lower case, without other characters than letters
    and digits. An item with fewer tokens than ``min_tile`` has to occur as a whole.

    The benchmark is indexed in blocks of about ``block_mb`` MB of text, each scanned against
    all documents, so the memory of a task does not grow with either table. A null or empty
    text, or one without letters and digits, matches nothing; an empty table gives no rows;
    a null doc_id or item_id stays null in the pair; repeated rows give repeated pairs; other
    columns are not read.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("item_text"))
    found, texts = _matched(docs, items, min_tile, min_coverage, block_mb)
    return found.join(texts, "text_id").join(items, "item_text").select("doc_id", "item_id", "item_tokens", "covered_tokens", "n_tiles", "coverage")


def _matched(docs: DataFrame, items: DataFrame, min_tile: int = 4, min_coverage: float = 0.5, block_mb: float = 8.0) -> tuple[DataFrame, DataFrame]:
    """The matches of documents with the distinct texts of the items, by text_id, and (text_id, item_text)."""
    spark = docs.sparkSession
    distinct = written(items.where("item_text is not null").select("item_text").distinct().select(F.monotonically_increasing_id().alias("text_id"), "item_text"), "benchmark-texts")
    size = distinct.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / (block_mb * 1e6)))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for b in range(n_blocks):
        rows = distinct.where(F.pmod(F.xxhash64("text_id"), F.lit(n_blocks)) == b).collect()  # about block_mb
        block = spark.sparkContext.broadcast(Index(sorted((r[0], r[1].encode()) for r in rows), min_tile))
        pairs = texts.mapInArrow(lambda it, block=block: _scan(it, block.value, min_coverage), SCHEMA)
        if n_blocks > 1:  # one block at a time is held
            pairs = written(pairs, "tiles")
            block.destroy()
        out = pairs if out is None else out.unionByName(pairs)
    return out, distinct


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item; rows with the same doc_id (or none) go together."""
    key = f"row_{uuid.uuid4().hex[:8]}"
    found, _ = _matched(docs, benchmark.select(F.col("text").cast("string").alias("item_text")), **options)
    hit = written(found.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit[key]), "left_anti")

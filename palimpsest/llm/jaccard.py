"""N-gram Jaccard join: links between documents whose 5-word shingle sets are alike, and their components.

The overlap of two documents is an entry of the product of the document by n-gram
incidence matrix with its transpose. The product is never formed as a whole:

* Columns. Shingles are ordered from rare to frequent by a count sketch over the whole
  corpus (of a fixed size, so it may be broadcast). By the size bounds of the threshold, two
  linked documents share a column among the first n - ceil(0.8 n) + 1 of the longer and the
  first n - ceil(8 n / 9) + 1 of the shorter one, so only these entries are multiplied.
* Blocks. The entries are dealt by column; a column that is frequent by the sketch is cut into
  blocks of its rows, so no column is one task's work. Each task multiplies its blocks as a stream.
* Bounds. An entry knows its room: the columns of its document from this one on. The first
  column that two linked documents share leaves both of them room for the overlap that their
  sizes ask for. Other products are discarded, the rest are accumulated, and the exact
  overlap of the surviving pairs is taken from whole texts.

Documents with equal sets (by 128-bit hashes) are one class from the start. A first product pairs each class
of a column with one leader of that column, the class with the fewest columns of its own (the
text that the copies come from, where it is there), which joins large groups of near copies
with as many pairs as classes. The second product then takes every pair of a column whose classes
are still in different components. A pair inside a component can't change it, so no
component is lost and no group is expanded into all its pairs.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from palimpsest.llm.components import connected
from palimpsest.llm.shared import Scratch, dealt, flat_utf8, row_key, slices

WORDS = 5  # words in a shingle
SLOTS, CHUNKS = 1 << 22, 64  # of the count sketch
ROWS = 256  # documents in a block of a column, for leaders
SQUARE = 512  # entries of a block in the second product
PAIRS = 64  # pairs that a leader's text is shipped for at once
MAP = 15  # Spark's bitmaps have 2^15 bits
ASKED = 1 << 25  # bits that say which texts are asked for; with more texts than that more of the others are shipped beside them
LEADERS = 64  # of a column; a class that finds none is left to the second product, which takes every pair
_PIECE = 1 << 20  # bytes that are hashed at a time


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, multiply, xor), in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _values() -> np.ndarray:
    """A value for each byte; A-Z have those of a-z."""
    out = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out[65:91] = out[97:123]
    return out


_BASE, _VALUE = 0x9E3779B97F4A7C15, _values()
_PLACE = _mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers_of_base(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        m = max(n, _PIECE + 1)
        _powers = tuple(np.cumprod(np.r_[np.uint64(1), np.full(m - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _powers


def word_hashes(flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of texts that follow each other in ``flat``, and how many words are before each text (and in all).

    A word's hash is a polynomial of its bytes; sums up to each byte give those of all words at once, in pieces of bounded
    size that end between words.
    """
    n = len(flat)
    inside = ~_SPACE[flat]
    first, last = inside.copy(), inside.copy()  # of a word: the byte before (after) it is white space or another text's
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _PIECE, "right")))
        part = flat[low : ends[to - 1]]
        power, inverse = _powers_of_base(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * power[: len(part)], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * inverse[s]
        at = to
    return _mixed(out), np.searchsorted(starts, begins)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit shingle hashes of each text, sorted, one text's after the other, and where each text's begin (and the last end).

    A text with fewer than five words has one shingle, one without words none. Words are split at [\\x20\\x09-\\x0D].
    """
    v, at = word_hashes(*flat_utf8(column))
    counts = np.diff(at)
    h = np.zeros(len(v), np.uint64)
    for j in range(WORDS):
        h[: len(v) - j] += v[j:] * _PLACE[j]
    for k in range(1, WORDS):
        short = at[:-1][counts == k]
        h[short] = np.uint64(k) + sum((v[short + j] * _PLACE[j] for j in range(k)), np.zeros(len(short), np.uint64))
    n = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    h = _mixed(h[np.arange(len(v)) - np.repeat(at[:-1], counts) < np.repeat(n, counts)])
    begins = np.r_[0, np.cumsum(n)]
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[begins[:-1][n > 0]] = True
    return h[fresh], np.r_[0, np.cumsum(fresh)][begins]


def probe_length(n: int) -> int:
    """How many of its n columns a document is found by."""
    return n - (4 * n + 4) // 5 + 1


def _batch(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "longs": pa.list_(pa.int64()), "ints": pa.list_(pa.int32())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SLOTS, np.uint32)
    for batch in slices(batches, 2000):
        np.add.at(counts, (shingle_sets(batch.column(0))[0] & np.uint64(SLOTS - 1)).astype(np.int64), np.uint32(1))
    parts = np.minimum(counts, 65535).astype("<u2").reshape(CHUNKS, -1)
    used = [i for i in range(CHUNKS) if parts[i].any()]
    if used:
        yield _batch("chunk int, counts binary", used, [zlib.compress(parts[i].tobytes(), 1) for i in used])


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total.setdefault(chunk, np.zeros(SLOTS // CHUNKS, np.int64))[:] += np.frombuffer(zlib.decompress(part), "<u2")
    if total:
        level = [np.minimum(255, np.rint(8 * np.log2(1.0 + total[i]))).astype(np.uint8) for i in total]
        yield _batch("chunk int, levels binary", list(total), [x.tobytes() for x in level])


def column_levels(docs: DataFrame) -> np.ndarray:
    """For each slot of the sketch the level of its count: 8 log2(1 + count), one byte each, 4 MB whatever the corpus."""
    parts = docs.select("text").mapInArrow(_sketch, "chunk int, counts binary")
    summed = parts.repartition(CHUNKS, "chunk").mapInArrow(_add_sketches, "chunk int, levels binary")
    levels = np.zeros((CHUNKS, SLOTS // CHUNKS), np.uint8)
    for row in summed.collect():  # 64 rows of 64 kB
        levels[row[0]] = np.frombuffer(row[1], np.uint8)
    return levels.ravel()


#: Blocks that a column of a level is cut into.
_BLOCKS = np.maximum(1, np.ceil((2 ** (np.arange(256) / 8) - 1) / ROWS)).astype(np.int64)
_SIGNED = "doc_id long, k1 long, k2 long, n long, c1 long, c2 long, columns longs, blocks ints"


def _signatures(batches: Iterator[pa.RecordBatch], levels: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The class of each text and its first columns, each with the block of it that the class is in (-1: the column isn't cut)."""
    for batch in slices(batches, 2000):
        h, begins = shingle_sets(batch.column(3))
        level = levels[(h & np.uint64(SLOTS - 1)).astype(np.int64)]
        order = (level.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
        c1, c2, picked, lengths = [], [], [], []
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            high, low = np.frombuffer(xxhash.xxh3_128_digest(h[a:b].data), ">i8")
            c1.append(high)
            c2.append(low)
            if b > a:
                picked.append(a + order[a:b].argsort()[: probe_length(b - a)])
                lengths.append(len(picked[-1]))
            else:
                lengths.append(0)
        picked = np.concatenate(picked) if picked else np.zeros(0, np.int64)
        cut = _BLOCKS[level[picked]]
        block = np.where(cut > 1, np.repeat(np.array(c1, np.int64), lengths) % cut, -1).astype(np.int32)
        ends = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h[picked].view(np.int64), block)]
        yield _batch(_SIGNED, *batch.columns[:3], np.diff(begins), c1, c2, *lists)


def _shared_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of columns with more than one class, of a stream that is sorted by column; those of columns that are cut stay."""
    last: pa.RecordBatch | None = None
    last_col, alone = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column("column").to_numpy()
        same = col[1:] == col[:-1]
        keep = np.r_[False, same] | np.r_[same, False] | (batch.column("block").to_numpy() >= 0)
        if last_col is not None and col[0] == last_col:
            keep[0] = True
            if alone:
                yield last
        last, last_col, alone = batch.slice(batch.num_rows - 1, 1), col[-1], not keep[-1]
        if keep.any():
            yield batch.filter(pa.array(keep))


_STARS = "a long, b long, column long, n int, own int"


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (column, block, late, own, id, n): each class of a block with the first class, in the order of the stream, that may link with it.

    The leaders of each block of a cut column are rows too: without b, but with their column.
    """
    at, leaders = None, []
    for batch in batches:
        rows = []
        for c, block, own, x, n in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
            if (c, block) != at:
                at, leaders = (c, block), []
            for y, m, most in leaders:
                if 9 * min(n - own, most) >= 4 * (n + m):  # 9 * overlap >= 4 * (n + m) is the threshold
                    if x != y:
                        rows.append((x, y, None, None, None))
                    break
            else:
                if len(leaders) < LEADERS:
                    leaders.append((x, n, n - own))
                    if block >= 0:
                        rows.append((x, None, c, n, own))
        if rows:
            yield _batch(_STARS, *zip(*rows, strict=True))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (column, i, j, block, n, id, room, component), sorted by column, i and j: the pairs of block i with block j, of two components, that the bounds allow."""

    def few(i: int, j: int, rows: list[tuple]) -> Iterator[tuple[int, int]]:
        for at, (block, n, x, room, comp) in enumerate(rows):
            for other, m, y, space, part in rows[at + 1 :]:
                # the shorter one is found by fewer columns
                if comp != part and (i == j or block != other) and (9 * room >= 8 * n if n <= m else 9 * space >= 8 * m) and 9 * min(room, space) >= 4 * (n + m):
                    yield (x, y) if x < y else (y, x)

    def many(i: int, j: int, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        block, n, x, room, comp = columns
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        right = right[np.argsort(n[right], kind="stable")]
        sizes = n[right]
        for k in range(0, len(left), 256):
            p = left[k : k + 256]
            q = right[np.searchsorted(5 * sizes, 4 * n[p].min()) : np.searchsorted(4 * sizes, 5 * n[p].max(), "right")]
            held = np.where(n[p][:, None] <= n[q], 9 * room[p][:, None] >= 8 * n[p][:, None], 9 * room[q] >= 8 * n[q])
            ok = held & (comp[p][:, None] != comp[q]) & (9 * np.minimum(room[p][:, None], room[q]) >= 4 * (n[p][:, None] + n[q]))
            if i == j:
                ok &= x[p][:, None] < x[q]
            r, c = np.nonzero(ok)
            if len(r):
                a, b = x[p[r]], x[q[c]]
                yield _batch("a long, b long", np.minimum(a, b), np.maximum(a, b))

    def pairs(key: tuple, parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts, strict=True)]
        if len(columns[0]) > 32:
            yield from many(key[1], key[2], columns)
        elif found := list(few(key[1], key[2], list(zip(*(c.tolist() for c in columns), strict=True)))):
            yield _batch("a long, b long", *zip(*found, strict=True))

    held, at = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy() for c in batch.columns]
        keys = np.stack(columns[:3])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(keys[:, a].tolist())
            if key != at:
                if held:
                    yield from pairs(at, held)
                held, at = [], key
            held.append([c[a:b] for c in columns[3:]])
    if held:
        yield from pairs(at, held)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (b, block, a, text), sorted, the row of b itself without a before those of its partners: the pairs whose whole shingle
    sets reach the threshold 100 * intersection >= 80 * union."""
    at, own = None, None
    for batch in slices(batches, 500):
        sets, begins = shingle_sets(batch.column(3))
        rows = []
        for i, (b, block, a) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
            x = sets[begins[i] : begins[i + 1]]
            if a is None:
                at, own = (b, block), x.copy()
            elif at == (b, block):
                both = np.sort(np.concatenate([own, x]))
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= 80 * (len(both) - common):
                    rows.append((a, b))
        if rows:
            yield _batch("a long, b long", *zip(*rows, strict=True))


def _asked_for(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of docs whose key (k1, k2) is among the asked ones, and few others: a bitmap of fixed size, broadcast, keeps the rest from being shuffled."""
    slot = F.pmod(F.xxhash64("k1", "k2"), F.lit(ASKED))
    place, bit = F.shiftright(slot, MAP).alias("map"), slot.bitwiseAND((1 << MAP) - 1)
    maps = asked.groupBy(place).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return docs.withColumn("map", place).join(F.broadcast(maps), "map").where(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1).select(docs.columns)


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of classes that are links. A text is shipped once for each pair that it is a of, and once for PAIRS pairs that it is b of."""
    count = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS).alias("cut"))
    pairs = pairs.join(count, "b").select("b", F.pmod(F.xxhash64("a"), F.col("cut")).cast("int").alias("block"), "a")
    asked = pairs.select(F.col("a").alias("id"), "b", "block", "a").unionByName(pairs.select(F.col("b").alias("id"), "b", "block", F.lit(None).cast("long").alias("a")).distinct())
    asked = scratch.written(asked.join(classes.select("id", "k1", "k2"), "id").drop("id"), "jaccard-asked")
    # rows that repeat have one key: one of them is enough
    texts = _asked_for(docs.select("k1", "k2", "text"), asked).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    links = scratch.written(dealt(texts.join(asked, ["k1", "k2"]).select("b", "block", "a", "text"), ["b", "block"], "a").mapInArrow(_linked, "a long, b long"), "jaccard-links")
    scratch.drop(asked)
    return links


def _components(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, k1, k2, n, c1, c2) of each row, and (c1, c2, k1, k2, component_id, component) of each class that has words."""
    spark = docs.sparkSession
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", k1, k2, "text")
    levels = spark.sparkContext.broadcast(column_levels(docs))
    signed = scratch.written(docs.mapInArrow(lambda it: _signatures(it, levels.value), _SIGNED.replace("longs", "array<long>").replace("ints", "array<int>")), "jaccard-columns")

    row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "k1", "k2"))
    classes = signed.where("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("low"), row.alias("row"), F.first("n").cast("int").alias("n"), F.first("columns").alias("columns"), F.first("blocks").alias("blocks"))
    wide = scratch.written(classes.select(F.monotonically_increasing_id().alias("id"), "c1", "c2", "low", "row.k1", "row.k2", "n", "columns", "blocks"), "jaccard-classes")
    rows = scratch.written(signed.drop("columns", "blocks"), "jaccard-rows")
    classes = scratch.written(wide.drop("columns", "blocks"), "jaccard-classes")
    scratch.drop(signed)
    # most entries are of columns that no other class has: what the rest needs besides is joined to it later; with the block last a row compresses best
    entries = wide.select("id", F.posexplode(F.arrays_zip("columns", "blocks")).alias("at", "e")).select(F.col("e.columns").alias("column"), "id", "at", F.col("e.blocks").alias("block"))
    entries = dealt(entries, ["column", "block"]).mapInArrow(_shared_columns, entries.schema)
    # own: the earlier columns of the class that no other class has
    entries = entries.join(classes.select("id", "n"), "id").withColumn("own", F.col("at") + 1 - F.row_number().over(W.partitionBy("id").orderBy("at")))
    entries = scratch.written(entries.select("column", "block", "id", "n", "own", (F.col("n") - F.col("at")).alias("room")), "jaccard-entries")
    scratch.drop(wide)

    def led(df: DataFrame) -> DataFrame:
        return dealt(df.select("column", "block", "late", "own", "id", "n"), ["column", "block"], "late", "own", "id").mapInArrow(_leaders, _STARS)

    # the leaders of a cut column's blocks are led by those of the whole column, which each block gets
    late = entries.withColumn("late", F.lit(True))
    heads = scratch.written(led(late.where("block >= 0")).where("b is null"), "jaccard-heads")
    heads = scratch.written(led(heads.select("column", F.lit(0).alias("block"), F.lit(True).alias("late"), "own", F.col("a").alias("id"), "n")).where("b is null"), "jaccard-heads")
    blocks = entries.where("block >= 0").select("column", "block").distinct()
    early = heads.join(blocks, "column").select("column", "block", F.lit(False).alias("late"), "own", F.col("a").alias("id"), "n")
    first = led(late.select(*early.columns).unionByName(early)).where("b is not null").select("a", "b")
    first = scratch.written(first.groupBy("a", "b").count().groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b")), "jaccard-pairs")
    links = _verified(first, classes, docs, scratch)
    joined = scratch.written(connected(links, "a", "b"), "jaccard-components")
    scratch.drop(heads, first)

    named = entries.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    mixed = named.groupBy("column").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.expr("9L * room >= 8L * n")).alias("held"), F.count("*").alias("size")).where("low <> high and held")
    mixed = named.join(mixed.select("column", F.ceil(F.col("size") / SQUARE).cast("int").alias("cut")), "column").withColumn("own_block", F.pmod(F.xxhash64("id"), F.col("cut")).cast("int"))
    # the block i of a column meets each block j of it in a task of its own
    mixed = mixed.select("column", "own_block", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other"), F.col("n").cast("long").alias("n"), "id", F.col("room").cast("long").alias("room"), "comp")
    mixed = mixed.select("column", F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j"), F.col("own_block").alias("block"), "n", "id", "room", "comp")
    second = scratch.written(dealt(mixed, ["column", "i", "j"]).mapInArrow(_products, "a long, b long").distinct(), "jaccard-pairs")
    more = _verified(second, classes, docs, scratch)

    joined = connected(links.unionByName(more), "a", "b").withColumnRenamed("node", "id")
    groups = classes.select("id", "c1", "c2", "low", "k1", "k2").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = groups.groupBy("component").agg(F.min("low").alias("component_id"))
    named = scratch.written(groups.join(smallest, "component").select("c1", "c2", "low", "k1", "k2", "component", "component_id"), "jaccard-groups")
    scratch.drop(classes, entries, second, links, more)
    return rows, named


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles (size of its set), component_id (the smallest doc_id reachable by links).

    A set holds the distinct 5-word shingles of the whole text (A-Z in lower case, words
    separated by [\\x20\\x09-\\x0D]); with fewer words it holds the whole sequence. Two rows link
    when 100 * intersection >= 80 * union.

    A null or empty text, or one without words, has an empty set and links with nothing: its
    component is itself. Repeated rows and rows that share a doc_id are rows of their own. A row
    with a null doc_id joins components, but its id counts only where no other is there (then
    component_id is null). Other columns, whatever their names, are not read; an empty table
    gives an empty result. Shingles are compared as 64-bit hashes.
    """
    signed, named = _components(docs.select("doc_id", "text"), Scratch(docs.sparkSession))
    out = signed.join(named.select("c1", "c2", "component", "component_id"), ["c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, of which each component keeps one row.

    That is the row with the smallest doc_id, of rows that share it any; a row with a null doc_id only where a
    component has no other. Rows without words are in no component and all stay. An empty table gives an empty result.
    """
    _, named = _components(docs.select("doc_id", "text"), Scratch(docs.sparkSession))
    kept = named.groupBy("component").agg(F.min_by(F.struct("k1", "k2"), F.struct(F.col("low").isNull(), "low", "k1", "k2")).alias("row"))
    k1, k2 = (f"{k}_{uuid.uuid4().hex}" for k in ("k1", "k2"))  # no column of docs
    text = F.col("text").cast("string")
    own = row_key(F.col("doc_id").cast("long"), text)
    rows = docs.withColumn(k1, own[0]).withColumn(k2, own[1]).join(kept.select(F.col("row.k1").alias(k1), F.col("row.k2").alias(k2)), [k1, k2], "left_semi")
    wordless = docs.where(F.coalesce(~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return rows.dropDuplicates([k1, k2]).select(docs.columns).unionByName(wordless)

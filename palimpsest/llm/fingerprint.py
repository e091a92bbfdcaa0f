"""Document fingerprints as Merkle trees over sections and paragraphs, with DataFrame functions only.

A text is cut after blank lines into sections and after line feeds into paragraphs; the pieces keep
their separators, so they make up the whole text. A paragraph's digest is the SHA-256 of its
text, a section's that of its paragraphs' digests and the root that of the sections'. The
fingerprint writes the tree down:

    root level | section ; paragraph : n : leaves , paragraph : n : leaves / section ; ...

with 64 hex digits for the root, 16 for each inner node, and the number of distinct leaves of the
paragraph (a leaf is a run of up to three words that ends early at the end of a sentence). Of the leaves
those are written down, as 8 hex digits, whose CRC-32 is below 2^(32 - level); the level is the least that leaves about
LEAVES of a text, so beside its inner nodes a fingerprint has a bounded size. Equal roots are
equal texts; where they differ, branches whose digests differ locate the edits, and only their
leaves are compared to say how much of two texts is alike.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

_LEAF = r"(?:[^\s.!?]+\s+){0,2}[^\s]+"
LEAVES = 256
FAN = 64  # parts that a part of the ids is cut into


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is made once: transform over an array of one binds it."""
    return F.transform(F.array(value), use)[0]


def _limit(level: Column) -> Column:
    """2^(32 - level)."""
    return F.floor(F.lit(2.0**32) / F.pow(F.lit(2.0), level))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; that of null is that of the empty text."""
    hexed = lambda n: F.lpad(F.lower(F.hex(n)), 8, "0")
    leaves = lambda p: F.array_distinct(F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda w: F.crc32(w)))
    paragraph = lambda p: F.struct(F.sha2(p, 256).alias("digest"), leaves(p).alias("leaves"))
    sections = F.transform(F.split(F.coalesce(text, F.lit("")), "(?<=\n\n)"), lambda s: F.transform(F.filter(F.split(s, "(?<=\n)"), lambda p: p != ""), paragraph))
    digests = lambda nodes: F.sha2(F.array_join(F.transform(nodes, lambda n: n["digest"]), ""), 256)
    total = lambda ss: F.aggregate(ss, F.lit(0), lambda t, ps: t + F.aggregate(ps, F.lit(0), lambda u, p: u + F.size(p["leaves"])))
    level = lambda ss: F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(total(ss), F.lit(1)) / LEAVES))).cast("int")

    def tree(x: Column) -> Column:
        limit = _limit(x["level"])
        node = lambda p: F.concat_ws(":", F.left(p["digest"], F.lit(16)), F.size(p["leaves"]).cast("string"), F.array_join(F.transform(F.filter(p["leaves"], lambda h: h < limit), hexed), ""))
        section = lambda ps: F.struct(digests(ps).alias("digest"), F.array_join(F.transform(ps, node), ",").alias("below"))
        return _bound(F.transform(x["sections"], section), lambda ss: F.concat(digests(ss), F.lpad(x["level"].cast("string"), 2, "0"), F.lit("|"), F.array_join(F.transform(ss, lambda s: F.concat(F.left(s["digest"], F.lit(16)), F.lit(";"), s["below"])), "/")))

    return _bound(sections, lambda ss: _bound(F.struct(ss.alias("sections"), level(ss).alias("level")), tree))


def root(fp: Column) -> Column:
    """The root digest of a fingerprint."""
    return F.left(fp, F.lit(64))


def _sections(fp: Column) -> Column:
    """Sections as (digest, what is below)."""
    return F.transform(F.split(F.substring(fp, F.lit(68), F.length(fp)), "/"), lambda s: F.struct(F.left(s, F.lit(16)).alias("digest"), F.substring(s, F.lit(18), F.length(s)).alias("below")))


def _paragraphs(sections: Column) -> Column:
    """The paragraphs of sections as (digest, n, leaves)."""
    below = F.flatten(F.transform(sections, lambda s: F.split(s["below"], ",")))
    part = lambda p, i: F.coalesce(F.get(F.split(p, ":"), F.lit(i)), F.lit(""))
    return F.transform(F.filter(below, lambda p: p != ""), lambda p: F.struct(part(p, 0).alias("digest"), part(p, 1).cast("long").alias("n"), part(p, 2).alias("leaves")))


def _sum(nodes: Column) -> Column:
    return F.aggregate(nodes, F.lit(0).cast("long"), lambda t, p: t + p["n"])


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 1 for equal roots, else twice the common leaves by the leaves of both, below 1; 0 for nothing in common.

    Sections, then paragraphs, whose digests the other text has are common as they are. Of the others' leaves the share that both
    have is that of those that are written down in both fingerprints' range.
    """
    names = lambda nodes: F.transform(nodes, lambda n: n["digest"])
    unlike = lambda nodes, theirs: F.filter(nodes, lambda n: ~F.array_contains(theirs, n["digest"]))
    parted = lambda p: _bound(F.struct(names(p["a"]).alias("a"), names(p["b"]).alias("b")), lambda d: F.struct(unlike(p["a"], d["b"]).alias("a"), unlike(p["b"], d["a"]).alias("b")))
    both = lambda of, p: F.struct(of(p["a"]).alias("a"), of(p["b"]).alias("b"))
    level = F.greatest(F.substring(a, 65, 2), F.substring(b, 65, 2)).cast("int")
    limit = F.when(level == 0, F.lit("g")).otherwise(F.lpad(F.lower(F.hex(_limit(level))), 8, "0"))
    leaves = lambda ps, low: F.filter(F.array_distinct(F.flatten(F.transform(ps, lambda p: F.regexp_extract_all(p["leaves"], F.lit("[0-9a-f]{8}"), F.lit(0))))), lambda h: h < low)

    def rest(r: Column) -> Column:
        """Common leaves of paragraphs that the other text lacks: the share of the leaves of both that are in both, times their number."""
        seen = _bound(limit, lambda low: both(lambda ps: leaves(ps, low), r))
        share = _bound(seen, lambda s: F.coalesce(F.try_divide(F.size(F.array_intersect(s["a"], s["b"])), F.size(s["a"]) + F.size(s["b"])), F.lit(0.0)))
        return share * (_sum(r["a"]) + _sum(r["b"]))

    def compared(s: Column) -> Column:
        n = _sum(_paragraphs(s["a"])) + _sum(_paragraphs(s["b"]))
        unlike_paragraphs = _bound(_bound(_bound(s, parted), lambda k: both(_paragraphs, k)), parted)
        return _bound(unlike_paragraphs, lambda r: F.try_divide(n - _sum(r["a"]) - _sum(r["b"]) + 2.0 * rest(r), n))

    share = _bound(F.struct(_sections(a).alias("a"), _sections(b).alias("b")), compared)
    return F.when(root(a) == root(b), 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.least(share, F.lit(1.0 - 1e-9)), F.lit(0.0))))


def edits(a: Column, b: Column) -> Column:
    """Where the text of ``a`` differs from that of ``b``: its sections and paragraphs, counted from 0, whose digests ``b`` lacks."""
    of = lambda fp, what: F.regexp_extract_all(fp, F.lit(what), F.lit(1))
    theirs, paragraphs = of(b, "[/|]([0-9a-f]{16});"), of(b, "[;,]([0-9a-f]{16}):")
    parts = F.transform(F.split(F.substring_index(a, "|", -1), "/"), lambda s, i: F.when(
        ~F.array_contains(theirs, F.left(s, F.lit(16))),
        F.transform(F.filter(F.transform(F.regexp_extract_all(s, F.lit("[;,]([0-9a-f]{16}):"), F.lit(1)), lambda d, j: F.struct(d.alias("d"), j.alias("j"))), lambda p: ~F.array_contains(paragraphs, p["d"])), lambda p: F.struct(i.alias("section"), p["j"].alias("paragraph")))))
    return F.flatten(F.filter(parts, lambda p: p.isNotNull()))


def _part(df: DataFrame, parts: int) -> Column:
    """The number of the part that a row's doc_id is in, of about so many parts of like sizes with rising ids; -1 for null.

    Parts are cut at approximate quantiles, FAN at a time, so that no spread of ids makes large ones.
    """
    part = F.lit(0)
    for _ in range(math.ceil(math.log(max(parts, 1), FAN) - 1e-9)):
        cuts = df.where("doc_id is not null").groupBy(part.alias("part")).agg(F.percentile_approx("doc_id", [i / FAN for i in range(1, FAN)], 100 * FAN).alias("cuts")).collect()  # a row for each part
        table: list[list[int]] = [[] for _ in range(1 + max((r["part"] for r in cuts), default=0))]
        for r in cuts:
            table[r["part"]] = sorted(set(r["cuts"]))
        own = F.get(F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>"), part)
        part = part * FAN + F.size(F.filter(own, lambda c: c < F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part)


def with_next(df: DataFrame, rows_in_part: int = 5000, **made: Column) -> DataFrame:
    """Rows (doc_id, text) with the columns ``made`` of text, and ``next``: text and these of the row with the next smaller doc_id (after the last: of the first).

    Rows with equal doc_id follow each other by text, rows with a null one come last. Rows are dealt to parts of
    neighbouring ids, and the first row of each part is also dealt to the part before it, so no window holds all rows.
    """
    spark, rest = df.sparkSession, ["text", *made]
    part = _part(df, math.ceil(df.count() / rows_in_part))
    found = sorted(df.groupBy(part.alias("part")).agg(F.max("doc_id").alias("top")).collect())  # a row for each part
    dealt = df.withColumn("part", part)
    # the row after a part's last one is the first of the part below it, and after all the first of the highest part
    to = [(top, found[i + 1][0] if i + 1 < len(found) else found[0][0], i + 1 == len(found)) for i, (_, top) in enumerate(found)]
    heads = spark.createDataFrame(to, "top long, to int, wraps boolean")
    heads = df.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top"))).withColumn("rn", F.row_number().over(W.partitionBy("to", "wraps").orderBy("text"))).where("rn = 1")
    both = dealt.withColumn("wraps", F.lit(False)).withColumn("head", F.lit(False)).unionByName(heads.select("doc_id", "text", F.col("to").alias("part"), "wraps", F.lit(True).alias("head")))
    order = W.partitionBy("part").orderBy("wraps", F.desc_nulls_last("doc_id"), "text", "head")
    # what is made of texts is made after the shuffle, and follows them by a second window over the same order
    both = both.withColumn("next_text", F.lead("text").over(order)).withColumns(made).withColumns({f"next_{c}": F.lead(c).over(order) for c in made})
    return both.where("not head").select("doc_id", *rest, F.struct(*(F.col(f"next_{c}").alias(c) for c in rest)).alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last floor(n_chars / 3) code points are replaced by the first as
    many (or all) of the text of the next document in descending order of doc_id. A null text is empty; a
    single row is its own next one; an empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(texts, fingerprint=fingerprint(F.col("text")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("tail", F.floor(F.col("n_chars") / 3).cast("int"))
    rows = rows.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - tail as int))"), F.expr("left(next.text, tail)")))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), F.col("next.fingerprint").alias("next_fingerprint"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))

"""Column functions over text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from palimpsest.functions import lexicon as X

_MATCH = ["(?iU)" + p.replace(r"\s", X.WS) for p, _, _ in X.PHRASES]


def strip(t: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(t, f"^{X.WS}+|{X.WS}+$", "")


def is_blank(t: Column) -> Column:
    """Whether nothing but white space is there; null is blank."""
    return F.coalesce(~t.rlike(f"[^{X.WS[1:]}"), F.lit(True))


def clip(t: Column, limit: int = 400) -> Column:
    """White space as single spaces, cut to ``limit`` code points with an ellipsis as the last."""
    flat = strip(F.regexp_replace(t, f"{X.WS}+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…"))).otherwise(flat)


def ink(t: Column) -> Column:
    """Code points that aren't white space."""
    return F.length(F.regexp_replace(F.coalesce(t, F.lit("")), X.WS, "")).cast("long")


def count_of(t: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(t) - F.length(F.translate(t, characters, ""))).cast("long")


def decode_tags(t: Column) -> Column:
    """The ASCII that Unicode tag characters stand for."""
    return F.array_join(F.transform(F.regexp_extract_all(t, F.lit(X.TAGS), F.lit(0)), lambda c: F.chr(F.ascii(c) - 0xE0000)), "")


def unmask(t: Column) -> Column:
    """Look-alikes as the Latin characters they pass for."""
    return F.translate(t, X.LOOKALIKE, X.LATIN)


def visible(t: Column) -> Column:
    """Text for display: invisible, bidi and control characters get a sign, tags become ASCII."""
    signs = F.translate(t, X.INVISIBLE + X.BIDI, "␣" * len(X.INVISIBLE) + "⇄" * len(X.BIDI))
    signs = F.regexp_replace(signs, r"[\x00-\x08\x0b-\x1f]", "␀")
    tagged = F.array_join(F.transform(F.split(signs, ""), lambda c: F.when(c.rlike(X.TAGS), F.chr(F.ascii(c) - 0xE0000)).otherwise(c)), "")
    return F.when(signs.rlike(X.TAGS), tagged).otherwise(signs)


def bytesize(n: Column) -> Column:
    """A size in B, KB or MB, never with an exponent (a double of ten million and more would have one as a string)."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.bround(n / 1024).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.concat(F.bround(n / (1 << 20), 1).cast("decimal(38,1)").cast("string"), F.lit(" MB")))


def pct(v: Column) -> Column:
    """A share in per cent."""
    return F.concat(F.coalesce(F.bround(v * 100).try_cast("int"), F.lit(0)).cast("string"), F.lit("%"))


def display_time(seconds: Column, pattern: str = "dd MMM yyyy, HH:mm") -> Column:
    """Epoch seconds as a date."""
    return F.date_format(F.timestamp_seconds(seconds), pattern)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once: transform over an array of one binds it."""
    return F.transform(F.array(value), use)[0]


def addresses(tokens: Column) -> Column:
    """The URLs and email addresses in tokens without white space."""
    of = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    likely = lambda t: F.contains(t, F.lit("://")) | F.contains(F.lower(t), F.lit("www.")) | F.contains(t, F.lit("@"))
    return F.array_distinct(F.flatten(F.transform(F.filter(tokens, likely), lambda t: F.concat(of(t, "(?iU)" + X.URL.replace(r"\s", X.WS[1:-1])), of(t, "(?U)" + X.EMAIL)))))


def running_total(xs: Column) -> Column:
    """Of an array of numbers the sums up to each one, itself included.

    Spark has no running fold over an array, and one that appends copies what it has at every step. Here each of eight rounds adds seven values
    that are 1, 8, 64 and so on places before, so a round is linear and an array needs a round for each octal digit of its length (16 million at most).
    """
    def adding(by: int) -> Callable[[Column], Column]:
        def added(a: Column) -> Column:
            before = lambda i, k: F.coalesce(F.get(a, i - by * k), F.lit(0))
            return F.when(F.size(a) > by, F.transform(a, lambda x, i: reduce(lambda s, k: s + before(i, k), range(1, 8), x))).otherwise(a)

        return added

    return reduce(bound, (adding(8**step) for step in range(8)), xs)


def places(matches: Column, between: Column) -> Column:
    """(start, end, match) of matches that don't overlap, from what a pattern matches and what stands between, in code points, end exclusive."""
    lengths = F.zip_with(F.slice(between, 1, F.size(matches)), matches, lambda g, m: F.length(g) + F.length(m))
    place = lambda end, m: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("match"))
    return F.zip_with(running_total(lengths), matches, place)


def injection_hits(t: Column) -> Column:
    """Phrases addressed to a model: array of (order, start, ord, end, label, weight, match), the weightiest first.

    All matches of each pattern that don't overlap each other count; of equal spans under one label the
    first pattern's stays. Offsets are code points, end exclusive: running totals of what stands between and of
    matches, so a text with many hits takes time in proportion to them. A pattern looks only at texts that hold words which each of its matches holds.
    """
    holds = lambda low, groups: reduce(and_, (reduce(or_, (F.contains(low, F.lit(w)) for w in ws)) for ws in groups))
    asked = lambda x: F.filter(F.array(*(F.when(x["odd"] | holds(x["low"], g), F.lit(i)) for i, g in enumerate(X.NEEDLES))), lambda i: i.isNotNull())
    patterns = bound(F.struct(F.lower(t).alias("low"), t.rlike(X.UNCASED).alias("odd")), asked)
    # each pattern is a literal, so that it is compiled once
    of = lambda i, make: F.coalesce(*(F.when(i == n, make(F.lit(p))) for n, p in enumerate(_MATCH)))
    found = F.transform(patterns, lambda i: F.struct(i.alias("ord"), of(i, lambda p: F.regexp_extract_all(t, p, F.lit(0))).alias("m")))
    found = F.transform(F.filter(found, lambda s: F.size(s["m"]) > 0), lambda s: F.struct(s["ord"], places(s["m"], of(s["ord"], lambda p: F.split(t, p, -1))).alias("at")))
    weights, labels = F.array(*(F.lit(w) for _, w, _ in X.PHRASES)), F.array(*(F.lit(label) for _, _, label in X.PHRASES))

    def hits_of(s: Column) -> Column:
        weight, label = F.get(weights, s["ord"]), F.get(labels, s["ord"])
        return F.transform(s["at"], lambda h: F.struct(h["start"], h["end"], label.alias("label"), s["ord"].alias("ord"), weight.alias("weight"), h["match"]))

    same = lambda a, b: (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["label"] == b["label"])
    # equal spans stand side by side once sorted
    unique = bound(F.sort_array(F.flatten(F.transform(found, hits_of))), lambda hs: F.filter(hs, lambda h, i: (i == 0) | ~same(F.get(hs, i - 1), h)))
    told = F.transform(unique, lambda h: F.struct((-h["weight"]).alias("order"), h["start"], h["ord"], h["end"], h["label"], h["weight"], strip(h["match"]).alias("match")))
    return F.coalesce(F.sort_array(told), F.expr("cast(array() as array<struct<order:int,start:int,ord:int,end:int,label:string,weight:int,match:string>>)"))


def not_within(hits: Column, text: Column) -> Column:
    """The hits whose match isn't part of a text; each distinct match is looked for once."""
    others = F.filter(F.array_distinct(F.transform(hits, lambda h: h["match"])), lambda m: ~F.contains(text, m))
    return bound(others, lambda ms: F.filter(hits, lambda h: F.array_contains(ms, h["match"])))

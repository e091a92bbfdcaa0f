"""Runs of text from glyphs, as an extractor that sees one character at a time gives them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: What all glyphs of a run share.
STYLE = ("seqno", "type", "font", "size", "ascender", "descender", "opacity", "color", "colorspace", "layer")
GLYPHS = "doc_id string, page int, ord long, code int, baseline double, x0 double, y0 double, x1 double, y1 double, seqno int, type int, font string, size double, ascender double, descender double, opacity double, color array<double>, colorspace int, layer string"
#: Glyphs of a page are looked at in blocks of so many, so that a page of any length is many tasks' work.
BLOCK = 1 << 16


def spans_of_glyphs(glyphs: DataFrame, gap: float = 0.5, drift: float = 0.1, block: int = BLOCK) -> DataFrame:
    """Runs (as in traces, span_ord is that of their first glyph) from glyphs in the order in which they are drawn.

    A run ends where the style changes, where the baseline moves by more than ``drift`` of the size, and where the next glyph begins more than ``gap`` of the size
    behind the end of the last one or before its start. The text is the code points in order, the box that of all glyphs. (doc_id, page, ord) is the key; of glyphs
    that repeat it one counts. Codes that are no characters (negative, surrogates, beyond Unicode) and null become U+FFFD. A null size counts as 0, so then
    any gap ends a run; null places never do.

    Gaps and islands in two steps. Glyphs are dealt out by blocks, once: the last glyph of the block before is put before those of a block, and each block
    makes pieces of runs. Of the pieces, which are rows of their own, a page's are put together: one that begins no run belongs to the run before. Of glyphs that
    repeat, the greatest by all their columns counts, so that a block and the one behind it see the same one.
    """
    keys = ["doc_id", "page", "block"]
    of = ("code", "baseline", "x0", "y0", "x1", "y1", *STYLE)
    g = glyphs.select("doc_id", "page", F.floor(F.col("ord") / block).alias("block"), "ord", F.struct(*of).alias("g"))
    # (ord, g) is in the order of glyphs; only the last glyphs of blocks that have one behind them are told
    behind = F.lead("block").over(W.partitionBy("doc_id", "page").orderBy("block"))
    ends = g.groupBy(*keys).agg(F.max(F.struct("ord", "g")).alias("last")).withColumn("behind", behind).where("behind is not null")
    told = ends.select("doc_id", "page", F.col("behind").alias("block"), "last.ord", "last.g", F.lit(True).alias("told"))
    g = g.withColumn("told", F.lit(False)).unionByName(told).repartition(*keys)
    g = g.groupBy(*keys, "ord").agg(F.max(F.struct("g", "told")).alias("c")).select(*keys, "ord", "c.g", "c.told")
    in_block, in_page = W.partitionBy(*keys).orderBy("ord"), W.partitionBy("doc_id", "page").orderBy("block", "open")
    g = g.withColumn("prior", F.lag("g").over(in_block))
    prior, own = F.col("prior"), F.col("g")
    size = F.coalesce(own["size"], F.lit(0.0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    same = reduce(and_, (prior[c].eqNullSafe(own[c]) for c in STYLE))
    begins = prior.isNull() | ~same | yes(F.abs(own["baseline"] - prior["baseline"]) > drift * size) | yes(own["x0"] - prior["x1"] > gap * size) | yes(own["x0"] < prior["x0"])
    g = g.where("not told").withColumn("begin", F.when(begins, F.col("ord"))).withColumn("open", F.max("begin").over(in_block.rowsBetween(W.unboundedPreceding, 0)))
    pieces = _pieces(g, *keys, "open")
    # a block's first piece has no beginning of its own where the run goes on
    pieces = pieces.withColumn("span_ord", F.max("open").over(in_page.rowsBetween(W.unboundedPreceding, 0)))
    return _runs(pieces)


def _character(code: Column) -> Column:
    good = code.between(0, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    # of a code beyond a byte by its UTF-32 form, as chr() stops there
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("�")


_BOX = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}


def _pieces(glyphs: DataFrame, *keys: str) -> DataFrame:
    letters = F.sort_array(F.collect_list(F.struct("ord", _character(F.col("g.code")).alias("c"))))
    style = F.struct(*(F.col(f"g.{c}") for c in STYLE))
    return glyphs.groupBy(*keys).agg(F.any_value(style).alias("style"), *(f(f"g.{c}").alias(c) for c, f in _BOX.items()), F.array_join(F.transform(letters, lambda x: x["c"]), "").alias("text"))


def _runs(pieces: DataFrame) -> DataFrame:
    texts = F.sort_array(F.collect_list(F.struct("block", "text")))
    runs = pieces.groupBy("doc_id", "page", "span_ord").agg(F.any_value("style").alias("style"), *(f(c).alias(c) for c, f in _BOX.items()), F.array_join(F.transform(texts, lambda x: x["text"]), "").alias("text"))
    bbox = F.when(reduce(and_, (F.col(c).isNotNull() for c in _BOX)), F.struct(*_BOX))
    return runs.select("doc_id", "page", "span_ord", *(F.col(f"style.{c}").alias(c) for c in STYLE), bbox.alias("bbox"), "text")

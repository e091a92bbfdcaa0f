"""Which text runs a person doesn't see, and why; and the text of pages from them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from palimpsest.functions import geometry as G
from palimpsest.functions.text import ink, is_blank, strip
from palimpsest.sources.traces import opaque

WHITE = "named_struct('r', 1.0D, 'g', 1.0D, 'b', 1.0D)"
REASONS = ("no_ink", "transparent", "tiny", "off_page", "low_contrast", "layer_off", "covered")


def measured(spans: DataFrame) -> DataFrame:
    """Spans, with box and image_share of their page, with what the predicates read: eff_size, ratio, hex, bg_hex and visible (share on the page)."""
    fg, bg = G.normal_colour(F.col("color"), F.col("colorspace")), F.coalesce(F.col("bg"), F.expr(WHITE))
    own = G.area(F.col("bbox"))
    return spans.select("*", G.effective_size(F.col("size"), F.col("ascender"), F.col("descender"), F.col("bbox")).alias("eff_size"), G.contrast(fg, bg).alias("ratio"), G.hex_colour(fg).alias("hex"), G.hex_colour(bg).alias("bg_hex"), F.when(own > 0, G.overlap(F.col("bbox"), F.col("box")) / own).alias("visible"))


#: Share of a run's area that a cover must overlap; the least cell, as a power of two of a point, and where coordinates are clipped to.
COVERED, _FINEST, _FAR = 0.92, -8, 2.0**40


def _near(at: Column) -> Column:
    return F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR), at))


def _level(low: Column, high: Column) -> Column:
    """The power of two whose cells are no smaller than this side."""
    return F.ceil(F.log2(F.greatest(_near(high) - _near(low), F.lit(2.0**_FINEST)))).cast("int")


def _cell(at: Column, level: Column) -> Column:
    return F.floor(_near(at) / F.pow(F.lit(2.0), level)).cast("long")


def _solid(covers: DataFrame) -> DataFrame:
    """(doc_id, page, cover_seqno, cover_ord, rect, hex) of opaque covers."""
    fill = G.hex_colour(G.normal_colour(F.col("fill"), F.lit(None).cast("int")))
    return opaque(covers).select("doc_id", "page", F.col("seqno").alias("cover_seqno"), "cover_ord", "rect", fill.alias("hex"))


def cover_cells(covers: DataFrame) -> DataFrame:
    """Opaque covers with the cells (lx, ly, cx, cy) that they lie in: four at most, as a cell is no smaller than the cover, by width and height."""
    r = F.col("rect")
    c = _solid(covers).select("*", _level(r["x0"], r["x1"]).alias("lx"), _level(r["y0"], r["y1"]).alias("ly"))
    span = lambda low, high, level: F.sequence(_cell(low, level), _cell(high, level))
    c = c.withColumn("cx", F.explode(span(r["x0"], r["x1"], F.col("lx"))))
    return c.withColumn("cy", F.explode(span(r["y0"], r["y1"], F.col("ly"))))


def run_cells(spans: DataFrame, cells: DataFrame) -> DataFrame:
    """Runs with an area on pages that have opaque covers, with the cell that their middle is in for each size of cover on the page."""
    b = F.col("bbox")
    runs = spans.select("doc_id", "page", "span_ord", "seqno", "bbox").where(G.area(b) > 0)
    sizes = cells.groupBy("doc_id", "page").agg(F.collect_set(F.struct("lx", "ly")).alias("sizes"))
    probes = runs.join(sizes, ["doc_id", "page"]).withColumn("l", F.explode("sizes"))
    x, y = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    return probes.select("doc_id", "page", "span_ord", "seqno", "bbox", "l.lx", "l.ly", _cell(x, F.col("l.lx")).alias("cx"), _cell(y, F.col("l.ly")).alias("cy"))


def covered(spans: DataFrame, covers: DataFrame) -> DataFrame:
    """(doc_id, page, span_ord, cover): spans that a cover drawn later overlaps by 0.92 or more, each with the first such cover.

    A spatial join by cells. What overlaps more than half of a run holds its middle, so a run is looked for in one cell, that of its
    middle, for each size (width and height to the next power of two) that covers of its page have, and a cover is put into the four
    cells at most of its own size that it lies in. A pair is thus met once at most, pairs are tested only where the middle is near a cover, by a
    cover's size, and a page with many runs and covers is many cells, which go to many tasks. Runs without an area and covers that hide nothing are out.
    """
    cells = cover_cells(covers)
    near = run_cells(spans, cells).join(cells, ["doc_id", "page", "lx", "ly", "cx", "cy"])
    pairs = near.where(_hides(F.col("cover_seqno"), F.col("rect")))
    return pairs.groupBy("doc_id", "page", "span_ord").agg(F.min(F.struct(*_COVER)).alias("cover"))


_COVER = ("cover_ord", "cover_seqno", "rect", "hex")
#: Up to so many covers of a page are told to each of its runs; the runs and covers of other pages are joined by cells.
FEW = 16


def _hides(seqno: Column, rect: Column) -> Column:
    """Whether a cover, by its place in the order of drawing and its rectangle, hides a run."""
    return (seqno > F.col("seqno")) & (G.area(F.col("bbox")) > 0) & (G.overlap(F.col("bbox"), rect) >= COVERED * G.area(F.col("bbox")))


def first_covers(covers: DataFrame) -> DataFrame:
    """The first ``FEW`` + 1 opaque covers of each page at most, with ``rank``: a page that has that rank has more than ``FEW``."""
    rank = F.row_number().over(W.partitionBy("doc_id", "page").orderBy("cover_ord", "cover_seqno"))
    return _solid(covers).repartition("doc_id").withColumn("rank", rank).where(F.col("rank") <= FEW + 1)


def _on_pages(df: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows of pages that are among these by a hash of 15 bits, which rows of some other pages are, too: a bitmap of 4 kB is asked where rows are read, so others aren't dealt out."""
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("page").cast("long")), F.lit(1 << 15)).cast("int")
    among = pages.agg(F.bitmap_construct_agg(place.cast("long"))).scalar()
    byte = F.conv(F.hex(F.substr(among, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.where(F.getbit(byte, place % 8) == 1)


def _beside(spans: DataFrame, off: DataFrame, page_info: DataFrame, covers: DataFrame, hits: DataFrame, once: bool) -> DataFrame:
    """Spans with ``off`` of their document, ``box``, ``image_share`` and ``covers`` of their page, and their own ``cover``.

    What is said of a document, a page or a run is a row before the runs that it is said of, and runs take over the last such row if it is
    theirs: all is dealt out by document once and sorted once, where joins would move every run once for each of their keys.
    """
    keys = ("doc_id", "page", "span_ord")

    def said(df: DataFrame, place: int, named: dict[str, Column], *of: str) -> DataFrame:
        key = [(F.col(k) if k in of else F.lit(None)).cast(spans.schema[k].dataType).alias(k) for k in keys]
        # a null key is nobody's
        return df.dropna(subset=list(of)).repartition("doc_id").select(*key, F.lit(place).alias("place"), *(c.alias(n) for n, c in named.items()))

    parts = (
        said(off, 0, {"off": F.col("name")}, "doc_id"),
        said(page_info, 1, {"info": F.struct("page", "box", "image_share")}, *keys[:2]),
        said(covers, 2, {"few": F.struct(*_COVER)}, *keys[:2]),
        said(hits, 3, {"hit": F.struct("page", "span_ord", "cover")}, *keys),
    )
    rows = spans.repartition("doc_id").withColumn("place", F.lit(9))
    for p in parts:
        rows = rows.unionByName(p, allowMissingColumns=True)
    # layers and covers are gathered as they come: no more is held than a document's layers and a page's covers
    before = W.partitionBy("doc_id").orderBy("page", "span_ord", "place").rowsBetween(W.unboundedPreceding, W.currentRow)
    on_page = W.partitionBy("doc_id", "page").orderBy("span_ord", "place").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"info": F.last("info", ignorenulls=True).over(before), "hit": F.last("hit", ignorenulls=True).over(before), "off": F.collect_set("off").over(before), "few": F.collect_list("few").over(on_page)} | ({"prior": F.lag("place").over(W.partitionBy(*keys).orderBy("place"))} if once else {}))
    rows = rows.where((F.col("place") == 9) & (~F.col("prior").eqNullSafe(F.lit(9)) if once else F.lit(True)))
    mine = lambda c, *of: F.when(reduce(and_, (F.col(f"{c}.{k}") == F.col(k) for k in of)), F.col(c))
    info = mine("info", "page")
    return rows.select(*spans.columns, "off", info["box"].alias("box"), info["image_share"].alias("image_share"), F.when(F.size("few") <= FEW, F.col("few")).alias("covers"), mine("hit", "page", "span_ord")["cover"].alias("cover"))


def classify(spans: DataFrame, page_info: DataFrame, covers: DataFrame, hidden_layers: DataFrame, once: bool = False) -> DataFrame:
    """Spans with reasons (array of (code, text), in a fixed order), is_hidden, layer_off and cover. (doc_id, page, span_ord) is their key; with ``once``, of spans that repeat it one counts."""
    off = hidden_layers.where("name <> ''").select("doc_id", strip(F.col("name")).alias("name"))
    first = first_covers(covers)
    many = first.where(F.col("rank") > FEW)
    s = _beside(spans, off, page_info, first, covered(_on_pages(spans, many), _on_pages(covers, many)), once)
    few = F.when(F.col("span_ord").isNotNull(), F.array_min(F.filter("covers", lambda c: _hides(c["cover_seqno"], c["rect"]))))
    s = measured(s.withColumn("cover", F.coalesce(few, "cover")).drop("covers"))
    s = s.withColumn("layer_off", F.coalesce(F.array_contains("off", strip(F.coalesce("layer", F.lit("")))), F.lit(False))).drop("off")
    two = lambda c: F.format_string("%.2f", F.bround(c, 2))
    clear = F.coalesce(F.col("opacity") <= 0.08, F.lit(False))
    tests = (
        (F.col("type") == 3, F.lit("no ink (render mode 3)")),
        (clear, F.concat(F.bround(F.col("opacity") * 100).try_cast("int").cast("string"), F.lit("% opacity"))),
        ((F.col("eff_size") > 0) & (F.col("eff_size") < 3.5), F.concat(two(F.col("eff_size")), F.lit("pt type"))),
        (F.col("visible") < 0.35, F.lit("outside the page")),
        ((F.col("type") != 3) & ~clear & (F.col("ratio") < 1.6), F.concat(two(F.col("ratio")), F.lit(":1 contrast"))),
        (F.col("layer_off"), F.concat(F.lit("layer “"), strip(F.col("layer")), F.lit("” is off"))),
        (F.col("cover").isNotNull(), F.lit("covered by an opaque shape")),
    )
    reasons = F.array(*(F.when(t, F.struct(F.lit(code).alias("code"), text.alias("text"))) for code, (t, text) in zip(REASONS, tests, strict=True)))
    s = s.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return s.withColumn("is_hidden", F.size("reasons") > 0)


def page_texts(classified: DataFrame) -> DataFrame:
    """Per page: text (visible runs, then hidden ones, each in order, joined by line feeds), hidden_text, counts of runs and ink."""
    t, key = F.coalesce(F.col("text"), F.lit("")), F.struct("is_hidden", "span_ord", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: x["text"]), "\n")
    hidden: Column = F.col("is_hidden")
    # dealt out anew with little more than their text, so that no task sorts whole runs and gathers texts at a time
    rows = classified.select("doc_id", "page", "span_ord", "text", "is_hidden").repartition("doc_id", "page")
    pages = rows.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(key)).alias("runs"), F.count("*").alias("n_runs"), F.count_if(hidden).alias("n_hidden_runs"), F.sum(ink(t)).alias("chars"), F.sum(F.when(hidden, ink(t)).otherwise(0)).alias("hidden_chars"))
    return pages.select("doc_id", "page", joined(F.col("runs")).alias("text"), joined(F.filter("runs", lambda x: x["is_hidden"])).alias("hidden_text"), "n_runs", "n_hidden_runs", "chars", "hidden_chars")


def document_hidden_text(pages: DataFrame) -> DataFrame:
    """(doc_id, hidden_text) over a document's pages; blank pages are left out."""
    kept = pages.where(~is_blank(F.col("hidden_text"))).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "hidden_text"))).alias("p"))
    return kept.select("doc_id", F.array_join(F.transform("p", lambda x: x["hidden_text"]), "\n").alias("hidden_text"))


def background(pixels: DataFrame, *keys: str) -> DataFrame:
    """The most frequent colour of rows (keys, ord, r, g, b), channels rounded to two digits; of equals the one that comes first."""
    seen = pixels.select(*keys, "ord", *(F.round(c, 2).alias(c) for c in "rgb")).groupBy(*keys, "r", "g", "b").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return _most_frequent(seen, *keys)


def _most_frequent(seen: DataFrame, *keys: str) -> DataFrame:
    return seen.groupBy(*keys).agg(F.max_by(F.struct("r", "g", "b"), F.struct("n", -F.col("first"))).alias("bg"))


RASTER = "doc_id string, page int, y int, runs array<struct<x:int,n:int,r:double,g:double,b:double>>"


def packed(pixels: DataFrame) -> DataFrame:
    """Rasters (doc_id, page, y, runs) of pixel rows (doc_id, page, x, y, r, g, b): each line as runs of one colour, with where they begin and how long they are.

    Channels are rounded to two digits, as backgrounds compare them. A pixel that is missing ends a run; of a pixel that repeats the least colour
    counts. Runs are made by differences of place and rank (equal within a run), so nothing but counts is gathered for a line: a line has as many entries as runs.
    """
    one = pixels.select("doc_id", "page", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *(F.round(c, 2).alias(c) for c in "rgb")).groupBy("doc_id", "page", "y", "x").agg(F.min(F.struct("r", "g", "b")).alias("c"))
    rank = F.row_number().over(W.partitionBy("doc_id", "page", "y", "c").orderBy("x"))
    runs = one.withColumn("island", F.col("x") - rank).groupBy("doc_id", "page", "y", "c", "island").agg(F.min("x").alias("x"), F.count("*").cast("int").alias("n"))
    return runs.groupBy("doc_id", "page", "y").agg(F.sort_array(F.collect_list(F.struct("x", "n", "c.r", "c.g", "c.b"))).alias("runs"))


def _seen(lines: DataFrame, low: Column, high: Column, step: Column, *keys: str) -> DataFrame:
    """(keys, r, g, b, n, first) of lines with their runs: how many of the columns low, low + step, ... below high are in runs of a colour, and the first of them."""
    def within(run: Column) -> Column:
        begin, end = F.greatest(run["x"], low), F.least(run["x"] + run["n"], high)
        first = low + F.ceil((begin - low) / step).cast("int") * step
        return F.struct(run["r"].alias("r"), run["g"].alias("g"), run["b"].alias("b"), first.alias("x"), F.greatest(F.lit(0), F.ceil((end - first) / step).cast("int")).alias("n"))

    each = lines.select(*keys, "y", F.explode(F.filter(F.transform("runs", within), lambda s: s["n"] > 0)).alias("s"))
    return each.groupBy(*keys, "s.r", "s.g", "s.b").agg(F.sum("s.n").alias("n"), F.min(F.col("y").cast("long") * (1 << 20) + F.col("s.x")).alias("first"))


def backgrounds(spans: DataFrame, page_info: DataFrame, rasters: DataFrame, scale: float = 1.0) -> DataFrame:
    """Spans with ``bg``: the most frequent colour of the pixels below each.

    ``rasters`` has the raster of each page, packed (``RASTER``) or as pixel rows (doc_id, page, x, y, r, g, b), channels 0 to 1, with ``scale`` pixels a
    point. A run's window is its box and two pixels around it, looked at in steps of a 24th of its width and a
    12th of its height; runs that share a window share its colour. A run without a box, and one whose window is outside the
    raster, gets the most frequent colour of its page (in steps of a 40th), and white where there is no raster or one of four pixels at most.

    A window is met with the lines of the raster that it looks at, and what it sees of a line is counted from the runs it overlaps: no pixel is a row.
    """
    lines = rasters if "runs" in rasters.columns else packed(rasters)
    last = F.element_at("runs", -1)
    size = lines.groupBy("doc_id", "page").agg(F.max(last["x"] + last["n"]).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))
    side = lambda v, low: ((v - low) * F.lit(scale)).cast("int")
    b, box = F.col("bbox"), F.col("box")
    window = F.when(b.isNotNull(), F.struct(
        F.greatest(F.lit(0), side(b["x0"], box["x0"]) - 2).alias("x0"), F.greatest(F.lit(0), side(b["y0"], box["y0"]) - 2).alias("y0"),
        F.least(F.col("width"), side(b["x1"], box["x0"]) + 2).alias("x1"), F.least(F.col("height"), side(b["y1"], box["y0"]) + 2).alias("y1")))
    named = spans.drop("bg").join(page_info.select("doc_id", "page", "box"), ["doc_id", "page"], "left").join(size, ["doc_id", "page"], "left").withColumn("window", window)
    step = lambda n, by: F.greatest(F.lit(1), F.floor(n / by).cast("int"))
    w = F.col("window")
    windows = named.where((w["x1"] - w["x0"] >= 1) & (w["y1"] - w["y0"] >= 1)).select("doc_id", "page", "window").distinct()
    looked_at = windows.select("doc_id", "page", "window", F.explode(F.sequence(w["y0"], w["y1"] - 1, step(w["y1"] - w["y0"], 12))).alias("y")).join(lines, ["doc_id", "page", "y"])
    below = _most_frequent(_seen(looked_at, w["x0"], w["x1"], step(w["x1"] - w["x0"], 24), "doc_id", "page", "window"), "doc_id", "page", "window")
    coarse = lines.join(size.where("width > 4 and height > 4"), ["doc_id", "page"]).where(F.col("y") % step(F.col("height"), 40) == 0)
    whole = _most_frequent(_seen(coarse, F.lit(0), F.col("width"), step(F.col("width"), 40), "doc_id", "page"), "doc_id", "page").withColumnRenamed("bg", "page_bg")
    out = named.join(below, ["doc_id", "page", "window"], "left").join(whole, ["doc_id", "page"], "left").withColumn("bg", F.coalesce("bg", "page_bg", F.expr(WHITE)))
    return out.select(*(c for c in spans.columns if c != "bg"), "bg")

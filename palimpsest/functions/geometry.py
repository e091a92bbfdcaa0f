"""Column functions over colours and rectangles. Colours are arrays of channels or structs (r, g, b); rectangles structs (x0, y0, x1, y1)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def normal_colour(channels: Column, space: Column) -> Column:
    """Grey, RGB or CMYK channels as RGB; without channels black."""
    n = F.coalesce(F.size(channels), F.lit(0))
    c = lambda i: F.coalesce(F.get(channels, F.lit(i)), F.lit(0.0))
    ink = lambda i: F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), c(i) + c(3)))
    rgb = lambda r, g, b: F.struct(r.alias("r"), g.alias("g"), b.alias("b"))
    return F.when(n <= 0, rgb(F.lit(0.0), F.lit(0.0), F.lit(0.0))).when(F.coalesce(space == 1, F.lit(False)) | (n == 1), rgb(c(0), c(0), c(0))).when(F.coalesce(space == 4, F.lit(False)) | (n == 4), rgb(ink(0), ink(1), ink(2))).otherwise(rgb(c(0), c(1), c(2)))


def _linear(c: Column) -> Column:
    u = _unit(c)
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def luminance(colour: Column) -> Column:
    """Relative luminance of an RGB struct."""
    return 0.2126 * _linear(colour["r"]) + 0.7152 * _linear(colour["g"]) + 0.0722 * _linear(colour["b"])


def contrast(a: Column, b: Column) -> Column:
    """Contrast ratio of two RGB structs, 1 to 21."""
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def hex_colour(colour: Column) -> Column:
    """#RRGGBB."""
    part = lambda c: F.lpad(F.hex(F.bround(_unit(c) * 255).cast("long")), 2, "0")
    return F.concat(F.lit("#"), part(colour["r"]), part(colour["g"]), part(colour["b"]))


def area(r: Column) -> Column:
    """Area of a rectangle; 0 for one that is turned inside out."""
    return F.greatest(F.lit(0.0), r["x1"] - r["x0"]) * F.greatest(F.lit(0.0), r["y1"] - r["y0"])


def overlap(a: Column, b: Column) -> Column:
    """Area that two rectangles share."""
    return F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def effective_size(size: Column, ascender: Column, descender: Column, bbox: Column) -> Column:
    """The size that a run appears in: the smaller of what it declares and what its box says."""
    line = ascender - descender
    measured = F.when(bbox.isNotNull() & (line > 0.01), F.abs(bbox["y1"] - bbox["y0"]) / line)
    return F.when(measured > 0, F.when(size > 0, F.least(size, measured)).otherwise(measured)).otherwise(size)

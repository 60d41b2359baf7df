"""Padding: every border mode is a choice of the line and the element to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.functions.pixel import remap


def expand(pad: int | tuple) -> tuple[tuple[int, int], tuple[int, int]]:
    """((top, bottom), (left, right)) from a number, (number,), ((before, after),) or a pair for each axis."""
    if isinstance(pad, int):
        return ((pad, pad), (pad, pad))
    if len(pad) == 1:
        return expand(pad[0]) if isinstance(pad[0], int) else (tuple(pad[0]), tuple(pad[0]))
    return tuple((p, p) if isinstance(p, int) else tuple(p) for p in pad)


def pad(lines: DataFrame, pad: int | tuple, mode: str = "symmetric", value: float = 0.0) -> DataFrame:
    """Lines with borders. Only the line numbers are joined; elements are read within a line."""
    (top, bottom), (left, right) = expand(pad)
    size = schema.heights(lines)
    to = size.select("image_id", "h", "w", F.explode(F.sequence(F.lit(0), F.col("h") + top + bottom - 1)).alias("to"))
    src = F.col("to") - top
    inside = (src >= 0) & (src < F.col("h"))
    to = to.select("image_id", "to", "w", F.when(inside, src).otherwise(None if mode == "constant" else remap(src, F.col("h"), mode)).alias("y"))
    out = to.join(lines, ["image_id", "y"], "left" if mode == "constant" else "inner")

    def at(i):
        i = i - left
        if mode == "constant":
            return F.when((i >= 0) & (i < F.col("w")) & F.col("px").isNotNull(), F.get("px", i)).otherwise(F.lit(value))
        return F.get("px", remap(i, F.col("w"), mode))

    return out.select("image_id", F.col("to").alias("y"), F.transform(F.sequence(F.lit(0), F.col("w") + left + right - 1), at).alias("px"))


def pad_to_even(lines: DataFrame) -> DataFrame:
    """One more edge line or column where there is an odd number."""
    size = schema.heights(lines)
    out = lines.join(size, "image_id")
    again = (F.col("y") == F.col("h") - 1) & (F.col("h") % 2 == 1)
    out = out.select("image_id", F.explode(F.when(again, F.array("y", F.col("y") + 1)).otherwise(F.array("y"))).alias("y"), "px")
    return out.select("image_id", "y", F.when(F.size("px") % 2 == 1, F.concat("px", F.slice("px", -1, 1))).otherwise(F.col("px")).alias("px"))


def region(lines: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """The part from top, left to before bottom, right, counted from 0; the line filter reaches the scan."""
    part = lines.filter((F.col("y") >= top) & (F.col("y") < bottom))
    return part.select("image_id", (F.col("y") - top).alias("y"), F.slice("px", left + 1, right - left).alias("px"))


def haloed_region(lines: DataFrame, halo: int, top: int, left: int, bottom: int, right: int, mode: str = "symmetric") -> DataFrame:
    """A region with a halo, from the image where it has pixels and padded beyond."""
    return region(pad(lines, halo, mode), top, left, bottom + 2 * halo, right + 2 * halo)

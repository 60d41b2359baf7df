"""The shapes of tables that operators pass on.

pixels    image_id string, y int, x int, v double
lines     image_id string, y int, px array<double>: one row of an image, the form that most operators work on
features  image_id string, y int, feat int, px array<double>: one row of one feature image
samples   sample long, xs array<double>, label boolean
weights   i int, j int, w array<double>: the bias last
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVEL_DTYPES = {"u8": 255.0, "u16": 65535.0, "u32": 4294967295.0}


def to_pixels(lines: DataFrame) -> DataFrame:
    """A line that is null or empty has no pixels. The outer form keeps Spark from inferring a filter on px, which it would push
    below the sums that px is made of and so repeat them for each use."""
    keep = [c for c in lines.columns if c != "px"]
    return lines.select(*keep, F.posexplode_outer("px").alias("x", "v")).filter("x is not null")


def to_lines(pixels: DataFrame) -> DataFrame:
    keep = [c for c in pixels.columns if c not in ("x", "v")]
    by = pixels.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("x", "v"))).alias("p"))
    return by.select(*keep, F.transform("p", lambda p: p["v"]).alias("px"))


def heights(lines: DataFrame) -> DataFrame:
    """image_id, h, w: one row for each image."""
    return lines.groupBy("image_id").agg((F.max("y") + 1).alias("h"), F.max(F.size("px")).alias("w"))

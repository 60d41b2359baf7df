"""Queries over pixels: sources, projections, borders, resampling, thresholds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.functions import pixel
from gridloom.operators import border, resample, tilebank
from gridloom.plans import sql as S
from gridloom.sources import raster

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def unit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image scaled to 0 to 1 over the whole table."""
    lines = raster.vectors_as_image(spark, sf_dir)
    ends = lines.agg(F.min(F.array_min("px")).alias("lo"), F.max(F.array_max("px")).alias("hi"))
    return lines.crossJoin(F.broadcast(ends)).select("image_id", "y", F.transform("px", lambda v: (v - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("px"))


def shown(lines: DataFrame) -> DataFrame:
    return schema.to_pixels(lines).select("y", "x", pixel.r6(F.col("v")).alias("v"))


def unit_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.to_pixels(unit_lines(spark, sf_dir))


V = f"SELECT y, x, {S.r6('v')} AS v FROM"


@query(f"WITH {S.PX} {V} px")
def raster_scan(spark, sf_dir):
    return shown(raster.vectors_as_image(spark, sf_dir))


@query(f"WITH {S.UNIT} SELECT y, x, u8, {S.r6('u8 / 255.0')} AS v FROM (SELECT y, x, CAST(floor(v * 255) AS INTEGER) AS u8 FROM ux)")
def im2double_u8(spark, sf_dir):
    px = unit_pixels(spark, sf_dir).withColumn("u8", F.floor(F.col("v") * 255).cast("int"))
    return px.select("y", "x", "u8", pixel.r6(pixel.im2double(F.col("u8"), "u8")).alias("v"))


@query(f"WITH {S.PX} SELECT y - 10 AS y, x - 8 AS x, {S.r6('v')} AS v FROM px WHERE y >= 10 AND y < 200 AND x >= 8 AND x < 40")
def region_slice(spark, sf_dir):
    return shown(border.region(raster.vectors_as_image(spark, sf_dir), 10, 8, 200, 40))


@query(f"WITH {S.UNIT} SELECT y, x, CAST(round_even(v * 255, 0) AS BIGINT) AS u8, CAST(round_even(v * 65535, 0) AS BIGINT) AS u16 FROM ux")
def output_cast_u8(spark, sf_dir):
    return unit_pixels(spark, sf_dir).select("y", "x", pixel.output_cast(F.col("v"), "u8").alias("u8"), pixel.output_cast(F.col("v"), "u16").alias("u16"))


@query(f"WITH {S.PX} SELECT y, x, {S.r6('round_even(greatest(0.0, least(1.0, v * 3)) * 255, 0) / 255.0')} AS v FROM px")
def round_u8(spark, sf_dir):
    px = schema.to_pixels(raster.vectors_as_image(spark, sf_dir))
    return px.select("y", "x", pixel.r6(pixel.round_u8_steps(F.col("v") * 3)).alias("v"))


@query(f"WITH {S.PX} SELECT y, x, {S.r6('px.v')} AS v FROM px JOIN embeddings e ON px.y = e.vec_id WHERE e.label > 4")
def mask_filter(spark, sf_dir):
    mask = raster.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), (F.col("label") > 4).alias("m")).filter("m")
    return shown(raster.vectors_as_image(spark, sf_dir).join(mask, "y", "left_semi").select("image_id", "y", "px"))


@query("SELECT quality > 0 AS is_quality, toxic > 0 AS is_toxic, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY 1, 2")
def label_predicate(spark, sf_dir):
    rows = raster.table(spark, sf_dir, "labels")
    return rows.groupBy((F.col("quality") > 0).alias("is_quality"), (F.col("toxic") > 0).alias("is_toxic")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {S.PX} SELECT y, x, {S.r6('sqrt(v * v + u * u)')} AS v FROM (SELECT y, x, v, lead(v, 1, 0.0) OVER (PARTITION BY y ORDER BY x) AS u FROM px)")
def hypot_xy(spark, sf_dir):
    lines = raster.vectors_as_image(spark, sf_dir)
    f = lambda i: pixel.hypot(F.get("px", i), F.coalesce(F.get("px", i + 1), F.lit(0.0)))
    return shown(lines.withColumn("px", F.transform(F.sequence(F.lit(0), F.size("px") - 1), f)))


@query(f"WITH {S.PX} SELECT y, x, {S.r6('1 / (1 + exp(-greatest(-709.0, least(37.0, v * 100))))')} AS v FROM px")
def sigmoid(spark, sf_dir):
    return schema.to_pixels(raster.vectors_as_image(spark, sf_dir)).select("y", "x", pixel.r6(pixel.sigmoid(F.col("v") * 100)).alias("v"))


@query(
    f"WITH {S.PX} SELECT y, x, {S.r6('greatest(-0.1, least(0.1, v))')} AS clipped, {S.r6('1 - v')} AS inverted, CASE WHEN v > 0 THEN 0.9 ELSE 0.1 END AS target, "
    f"{S.r6('atan2(v, 0.25)')} AS angle, {S.r6('1 / CASE WHEN x = 0 THEN 1.0 ELSE x END')} AS one_over, CASE WHEN x = 1 THEN 0.0 ELSE {S.r6('v')} END AS cleaned FROM px"
)
def scalar_functions(spark, sf_dir):
    v, x = F.col("v"), F.col("x")
    px = schema.to_pixels(raster.vectors_as_image(spark, sf_dir))
    return px.select(
        "y", "x", pixel.r6(pixel.clip(v, -0.1, 0.1)).alias("clipped"), pixel.r6(pixel.inverted(v)).alias("inverted"), pixel.target(v > 0).alias("target"),
        pixel.r6(F.atan2(v, F.lit(0.25))).alias("angle"), pixel.r6(pixel.one_over(x.cast("double"))).alias("one_over"), pixel.r6(pixel.nan_to_num(F.when(x == 1, float("nan")).otherwise(v))).alias("cleaned"),
    )


def _pad_sql(mode) -> str:
    y, x = (mode("r.y - 5", "hw.h"), mode("c.x - 3", "hw.w"))
    grid = "r AS (SELECT unnest(range(0, h + 9)) AS y FROM hw), c AS (SELECT unnest(range(0, w + 5)) AS x FROM hw)"
    return f"WITH {S.PX}, {S.size('px')}, {grid} SELECT CAST(r.y AS INTEGER) AS y, CAST(c.x AS INTEGER) AS x, {S.r6('px.v')} AS v FROM r CROSS JOIN c CROSS JOIN hw JOIN px ON px.y = {y} AND px.x = {x}"


PADDING = ((5, 4), (3, 2))


@query(
    f"WITH {S.PX}, {S.size('px')}, r AS (SELECT unnest(range(0, h + 9)) AS y FROM hw), c AS (SELECT unnest(range(0, w + 5)) AS x FROM hw) "
    f"SELECT CAST(r.y AS INTEGER) AS y, CAST(c.x AS INTEGER) AS x, {S.r6('coalesce(px.v, 0.5)')} AS v FROM r CROSS JOIN c LEFT JOIN px ON px.y = r.y - 5 AND px.x = c.x - 3"
)
def pad_constant(spark, sf_dir):
    return shown(border.pad(raster.vectors_as_image(spark, sf_dir), PADDING, "constant", 0.5))


@query(_pad_sql(S.edge))
def pad_edge(spark, sf_dir):
    return shown(border.pad(raster.vectors_as_image(spark, sf_dir), PADDING, "edge"))


@query(_pad_sql(S.reflect))
def pad_reflect(spark, sf_dir):
    return shown(border.pad(raster.vectors_as_image(spark, sf_dir), PADDING, "reflect"))


@query(_pad_sql(S.symmetric))
def pad_symmetric(spark, sf_dir):
    return shown(border.pad(raster.vectors_as_image(spark, sf_dir), PADDING, "symmetric"))


@query(
    f"WITH {S.PX}, o AS (SELECT y, x, v FROM px WHERE x < 63 AND y < (SELECT max(y) - (max(y) % 2) FROM px)), {S.size('o')}, "
    f"r AS (SELECT unnest(range(0, h + h % 2)) AS y FROM hw), c AS (SELECT unnest(range(0, w + w % 2)) AS x FROM hw) "
    f"SELECT CAST(r.y AS INTEGER) AS y, CAST(c.x AS INTEGER) AS x, {S.r6('o.v')} AS v FROM r CROSS JOIN c CROSS JOIN hw JOIN o ON o.y = least(r.y, h - 1) AND o.x = least(c.x, w - 1)"
)
def pad_to_even(spark, sf_dir):
    lines = raster.vectors_as_image(spark, sf_dir)
    last = lines.agg((F.max("y") - F.max("y") % 2).alias("n"))
    odd = lines.join(F.broadcast(last), F.col("y") < F.col("n")).select("image_id", "y", F.slice("px", 1, 63).alias("px"))
    return shown(border.pad_to_even(odd))


@query(
    f"WITH {S.PX}, {S.size('px')}, d AS (SELECT unnest(range(0, 4)) AS d) SELECT CAST(px.y * 4 + a.d AS INTEGER) AS y, CAST(px.x * 4 + b.d AS INTEGER) AS x, {S.r6('v')} AS v FROM px CROSS JOIN d a CROSS JOIN d b"
)
def upsample2(spark, sf_dir):
    return shown(resample.upsample(raster.vectors_as_image(spark, sf_dir), 2))


@query(f"WITH {S.PX}, {S.halve('px', 'd1')}, {S.halve('d1', 'd2')} {V} d2")
def downsample_bicubic(spark, sf_dir):
    return shown(resample.downsample(raster.vectors_as_image(spark, sf_dir), 2))


def _pool_sql(levels: int) -> str:
    return f"WITH {S.PX} SELECT CAST(y >> {levels} AS INTEGER) AS y, CAST(x >> {levels} AS INTEGER) AS x, {S.r6('max(v)')} AS v FROM px GROUP BY 1, 2"


@query(_pool_sql(1))
def maxpool_l1(spark, sf_dir):
    return shown(resample.max_pool(raster.vectors_as_image(spark, sf_dir), 1))


@query(_pool_sql(3))
def maxpool_l3(spark, sf_dir):
    return shown(resample.max_pool(raster.vectors_as_image(spark, sf_dir), 3))


def _resize_sql(kernel: str, width: float, wide: bool, scale: float = 0.4, src: str = "px") -> str:
    def part(src: str, to: str, which: str) -> str:
        other = "x" if which == "y" else "y"
        return (
            f"{to}_n AS (SELECT n, o, CAST(o AS DOUBLE) / n AS s, {'CAST(o AS DOUBLE) / n' if wide else '1.0'} AS f FROM (SELECT max({which}) + 1 AS n, CAST(ceil((max({which}) + 1) * {scale}) AS BIGINT) AS o FROM {src})), "
            f"{to}_i AS (SELECT unnest(range(0, o)) AS i, n, s, f, {width} / f AS wd FROM {to}_n), "
            f"{to}_j AS (SELECT i, n, f, (i + 0.5) / s - 0.5 AS c, unnest(range(CAST(floor((i + 0.5) / s - 0.5 - wd / 2) AS BIGINT), CAST(floor((i + 0.5) / s - 0.5 - wd / 2) + ceil(wd) + 2 AS BIGINT))) AS j FROM {to}_i), "
            f"{to}_t AS (SELECT i, n, j, f * (c - j) AS t, f FROM {to}_j), {to}_w AS (SELECT i, greatest(0, least(j, n - 1)) AS j, f * ({kernel}) AS w FROM {to}_t), "
            f"{to} AS (SELECT CAST(i AS INTEGER) AS {which}, s.{other}, sum(w * s.v) / sum(w) AS v FROM {to}_w JOIN {src} s ON s.{which} = j GROUP BY 1, 2)"
        )

    return f"WITH {S.PX}, {part(src, 'a', 'y')}, {part('a', 'b', 'x')} {V} b"


def _resize(spark, sf_dir, method, scale=0.4):
    lines = raster.vectors_as_image(spark, sf_dir)
    h = lines.agg(F.max("y") + 1).first()[0]
    return shown(resample.imresize(lines, h, 64, scale, method))


@query(_resize_sql("greatest(0.0, 1 - abs(t))", 2.0, True))
def imresize_bilinear(spark, sf_dir):
    return _resize(spark, sf_dir, "bilinear")


@query(_resize_sql("CASE WHEN t >= -0.5 AND t < 0.5 THEN 1.0 ELSE 0.0 END", 1.0, False))
def imresize_nearest(spark, sf_dir):
    return _resize(spark, sf_dir, "nearest")


@query(_resize_sql("CASE WHEN t = 0 THEN 1.0 WHEN abs(t) < 3 THEN 3 * sin(pi() * t) * sin(pi() * t / 3) / (pi() * pi() * t * t) ELSE 0.0 END", 6.0, True))
def imresize_lanczos3(spark, sf_dir):
    return _resize(spark, sf_dir, "lanczos3")


OTSU = (
    "hb AS (SELECT least(CAST(floor(v * 256) AS INTEGER), 255) AS b, count(*) AS n FROM ux GROUP BY 1), "
    "hc AS (SELECT b, sum(n) OVER (ORDER BY b) AS n0, sum(n * b) OVER (ORDER BY b) AS s0, sum(n) OVER () AS n, sum(n * b) OVER () AS s FROM hb), "
    "ho AS (SELECT b, CAST(n0 AS DOUBLE) * CAST(n - n0 AS DOUBLE) * (CAST(s0 AS DOUBLE) / n0 - CAST(s - s0 AS DOUBLE) / (n - n0)) ** 2 AS q FROM hc WHERE n > n0), "
    "ot AS (SELECT (1 + (SELECT b FROM ho ORDER BY q DESC, b LIMIT 1)) / 256.0 AS threshold)"
)


@query(f"WITH {S.UNIT}, {OTSU} SELECT 'embeddings' AS image_id, CAST(threshold AS DOUBLE) AS threshold FROM ot")
def otsu_threshold(spark, sf_dir):
    return resample.otsu(unit_pixels(spark, sf_dir))


@query(f"WITH {S.UNIT}, {OTSU} SELECT y, x, v >= threshold AS v FROM ux, ot")
def ensure_binary(spark, sf_dir):
    return resample.ensure_binary(schema.to_pixels(raster.vectors_as_image(spark, sf_dir))).select("y", "x", "v")


_CUBIC = "CASE WHEN abs(t) <= 1 THEN 1.5 * abs(t) ** 3 - 2.5 * t * t + 1 WHEN abs(t) <= 2 THEN -0.5 * abs(t) ** 3 + 2.5 * t * t - 4 * abs(t) + 2 ELSE 0.0 END"


@query(_resize_sql(_CUBIC, 4.0, True))
def imresize_bicubic(spark, sf_dir):
    return _resize(spark, sf_dir, "bicubic")


@query(_resize_sql(_CUBIC, 4.0, False, 1.5))
def imresize_enlarged(spark, sf_dir):
    return _resize(spark, sf_dir, "bicubic", 1.5)


@query(_resize_sql("CASE WHEN t >= -0.5 AND t < 0.5 THEN 1.0 ELSE 0.0 END", 1.0, True))
def imresize_box(spark, sf_dir):
    return _resize(spark, sf_dir, "box")


@query(_resize_sql("CASE WHEN t = 0 THEN 1.0 WHEN abs(t) < 2 THEN 2 * sin(pi() * t) * sin(pi() * t / 2) / (pi() * pi() * t * t) ELSE 0.0 END", 4.0, True))
def imresize_lanczos2(spark, sf_dir):
    return _resize(spark, sf_dir, "lanczos2")


@query(_resize_sql("greatest(0.0, 1 - t * t / 2.25)", 3.0, True))
def imresize_own_kernel(spark, sf_dir):
    return _resize(spark, sf_dir, (lambda t: max(0.0, 1 - t * t / 2.25), 3))


@query(
    f"WITH {S.PX}, {S.size('px')}, f AS (SELECT 0 AS form, CAST(ceil(h * 0.3) AS BIGINT) AS oh, CAST(ceil(w * 0.3) AS BIGINT) AS ow FROM hw UNION ALL SELECT 1, ceil(h * 0.5), ceil(w * 0.25) FROM hw "
    "UNION ALL SELECT 2, 30, 20 FROM hw UNION ALL SELECT 3, ceil(h * 20 / w), 20 FROM hw UNION ALL SELECT 4, 30, ceil(w * 30 / h) FROM hw) SELECT form, CAST(oh AS BIGINT) AS h, CAST(ow AS BIGINT) AS w FROM f"
)
def resize_shapes(spark, sf_dir):
    """The sizes that each form of a target gives."""
    h = raster.vectors_as_image(spark, sf_dir).agg(F.max("y") + 1).first()[0]
    rows = [(i, *resample.shape_of(h, 64, to)) for i, to in enumerate((0.3, (0.5, 0.25), (30, 20), (None, 20), (30, None)))]
    return spark.createDataFrame(rows, "form int, h long, w long")


_MASK = "mk AS (SELECT y, x, CASE WHEN v > 0 THEN 255.0 ELSE 0.0 END AS v FROM px)"


@query(_resize_sql("greatest(0.0, 1 - abs(t))", 2.0, True, src="mk").replace(S.PX, f"{S.PX}, {_MASK}").replace(f"{S.r6('v')} AS v", "CAST(v > 128 AS DOUBLE) AS v"))
def imresize_mask(spark, sf_dir):
    lines = raster.vectors_as_image(spark, sf_dir).withColumn("px", F.transform("px", lambda v: (v > 0).cast("double")))
    h = lines.agg(F.max("y") + 1).first()[0]
    return schema.to_pixels(resample.imresize_bool(lines, h, 64, 0.4)).select("y", "x", "v")


@query(
    f"WITH {S.PX}, {S.size('px')}, r AS (SELECT unnest(range(0, 48)) AS y), c AS (SELECT unnest(range(0, 40)) AS x) "
    f"SELECT CAST(r.y AS INTEGER) AS y, CAST(c.x AS INTEGER) AS x, {S.r6('px.v')} AS v FROM r CROSS JOIN c CROSS JOIN hw JOIN px ON px.y = {S.symmetric('r.y + h - 44', 'h')} AND px.x = {S.symmetric('c.x - 4', 'w')}"
)
def haloed_region(spark, sf_dir):
    """The last 40 lines and first 32 columns with a halo of 4, mirrored where the image ends."""
    lines = raster.vectors_as_image(spark, sf_dir)
    h = lines.agg(F.max("y") + 1).first()[0]
    return shown(border.haloed_region(lines, 4, h - 40, 0, h, 32))


_FORMS = (2, (3,), ((1, 2),), ((1, 2), (3, 4)), (1, (2, 0)))


@query(
    f"WITH {S.PX}, t AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w, sum(v) AS s FROM px), p AS (SELECT * FROM (VALUES (0, 2, 2, 2, 2), (1, 3, 3, 3, 3), (2, 1, 2, 1, 2), (3, 1, 2, 3, 4), (4, 1, 1, 2, 0)) AS f(form, top, bottom, l, r)) "
    f"SELECT form, CAST(h + top + bottom AS BIGINT) AS h, CAST(w + l + r AS BIGINT) AS w, {S.r6('s + 0.5 * ((h + top + bottom) * (w + l + r) - h * w)')} AS total FROM p, t"
)
def pad_forms(spark, sf_dir):
    """Size and sum of the image padded with 0.5, for each form that a padding can be given in."""
    lines, out = raster.vectors_as_image(spark, sf_dir), None
    for i, form in enumerate(_FORMS):
        part = border.pad(lines, form, "constant", 0.5)
        line = F.aggregate("px", F.lit(0.0), lambda a, v: a + v)
        part = part.agg(F.lit(i).alias("form"), F.count(F.lit(1)).alias("h"), F.max(F.size("px")).cast("long").alias("w"), pixel.r6(F.sum(line)).alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"WITH {S.PX}, k AS (SELECT a.d AS dy, b.d AS dx, a.t * b.t AS t FROM (VALUES (0, 1.0), (1, 2.0), (2, 1.0)) AS a(d, t), (VALUES (0, 1.0), (1, 0.0), (2, -1.0)) AS b(d, t)), {S.size('px')} "
    f"SELECT CAST(px.y - dy AS INTEGER) AS y, CAST(px.x - dx AS INTEGER) AS x, {S.r6('sum(px.v * t)')} AS v FROM px CROSS JOIN k CROSS JOIN hw WHERE px.y >= dy AND px.x >= dx AND px.y - dy < h - 2 AND px.x - dx < w - 2 GROUP BY 1, 2"
)
def separated_kernel(spark, sf_dir):
    """A kernel of rank 1 taken apart, and applied where it fits whole."""
    across, along = resample.separate(np.outer([1.0, 2.0, 1.0], [1.0, 0.0, -1.0]))
    return shown(resample.correlate(raster.vectors_as_image(spark, sf_dir), along, across))


_TAPS = [0.1, 0.2, 0.4, 0.25, 0.05]


def _correlated_sql(mode) -> str:
    at = mode("r.r + k.n - 2", "r.m")
    return f"WITH {S.PX}, {S.axis('px', 'a', S.values(_TAPS), at, 'm', 'y')}, {S.axis('a', 'b', S.values(_TAPS), at, 'm', 'x')} {V} b"


@query(_correlated_sql(S.edge))
def correlate_edge(spark, sf_dir):
    return shown(resample.correlate(raster.vectors_as_image(spark, sf_dir), _TAPS, _TAPS, "edge"))


@query(_correlated_sql(S.reflect))
def correlate_reflect(spark, sf_dir):
    return shown(resample.correlate(raster.vectors_as_image(spark, sf_dir), _TAPS, _TAPS, "reflect"))


@query(
    "WITH n AS (SELECT unnest(range(1, 2001)) AS n), e AS (SELECT unnest(range(0, 12)) AS e), "
    "s AS (SELECT CAST(pow(2, a.e) * pow(3, b.e) * pow(5, c.e) AS BIGINT) AS s FROM e a, e b, e c WHERE a.e * ln(2) + b.e * ln(3) + c.e * ln(5) < ln(4100)) "
    "SELECT CAST(n AS INTEGER) AS n, CAST(min(s) AS INTEGER) AS size FROM n JOIN s ON s >= n GROUP BY n"
)
def transform_sizes(spark, sf_dir):
    """The sizes that transforms of 1 to 2000 values are rounded up to."""
    return spark.createDataFrame([(n, tilebank.next_regular(n)) for n in range(1, 2001)], "n int, size int")

"""Queries over feature images. Those with many features return each line's total, peak and moment of every feature."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.functions.pixel import r6
from gridloom.operators import features, resample, stats, tilebank
from gridloom.plans import sql as S
from gridloom.plans.queries_pixels import shown, unit_lines
from gridloom.sources import raster

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def summed(feature_lines: DataFrame) -> DataFrame:
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)
    moment = F.aggregate(F.transform("px", lambda v, i: v * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return feature_lines.select("y", "feat", r6(add("px")).alias("total"), r6(F.array_max("px")).alias("peak"), r6(moment).alias("moment"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The image at half size, each column normalized by its median and MAD."""
    px = schema.to_pixels(resample.halve(raster.vectors_as_image(spark, sf_dir))).select("y", F.col("x").alias("feat"), "v")
    out = stats.normalize(px, F.broadcast(stats.fit(px, "median-mad", "feat")), "median-mad", "feat")
    return out.select("y", F.col("feat").alias("x"), r6(F.col("v")).alias("v"))


_HALVED = f"{S.PX}, {S.halve('px', 'd1')}, m AS (SELECT x, median(v) AS med FROM d1 GROUP BY x), a AS (SELECT d1.x, abs(v - med) AS a, med FROM d1 JOIN m USING (x)), n AS (SELECT x, any_value(med) AS med, 5 * median(a) * 1.482602218505602 AS s FROM a GROUP BY x)"
QUERIES["halved_normalized"] = flagship
SQL["halved_normalized"] = f"WITH {_HALVED} SELECT y, d1.x, {S.r6('(v - med) * (1 / CASE WHEN s = 0 THEN 1.0 ELSE s END) + 0.5')} AS v FROM d1 JOIN n USING (x)"

V = f"SELECT y, x, {S.r6('v')} AS v FROM"
_T = [math.exp(-t * t / 2) / math.sqrt(2 * math.pi) for t in range(-3, 4)]
_D = [t * g for t, g in zip(range(-3, 4), _T)]
_K = math.sqrt(math.sqrt(sum(d * d * g * g for d in _D for g in _T)))
GAUSS, DERIVATIVE = [g / _K for g in _T], [d / _K for d in _D]


def _valid(src: str, to: str, taps: list[float], which: str) -> str:
    return S.axis(src, to, S.values(taps), "r.r + k.n", f"m - {len(taps) - 1}", which)


@query(f"WITH {S.PX}, {_valid('px', 'a', GAUSS, 'y')}, {_valid('a', 'b', DERIVATIVE, 'x')} {V} b")
def correlate_xy_gauss(spark, sf_dir):
    g, d = features.gauss_pair()
    return shown(resample.correlate(raster.vectors_as_image(spark, sf_dir), d, g))


def _edge_sql(src: str) -> str:
    return (
        f"{S.same(src, 'ea', GAUSS, 'y')}, {S.same('ea', 'ex', DERIVATIVE, 'x')}, {S.same(src, 'eb', DERIVATIVE, 'y')}, {S.same('eb', 'ey', GAUSS, 'x')}, "
        "mag AS MATERIALIZED (SELECT ex.y, ex.x, sqrt(ex.v * ex.v + ey.v * ey.v) AS v FROM ex JOIN ey USING (y, x))"
    )


_EDGE = _edge_sql("px")


@query(f"WITH {S.PX}, {_EDGE} {V} mag")
def edge_magnitude(spark, sf_dir):
    return shown(features.edge_magnitude(raster.vectors_as_image(spark, sf_dir)))


def _shift_sql(src: str, offsets: list[tuple[int, int]], to: str = "f") -> str:
    table = "(VALUES " + ", ".join(f"({i}, {dx}, {dy})" for i, (dx, dy) in enumerate(offsets)) + ") AS o(feat, dx, dy)"
    return (
        f"{S.size(src, to + 's')}, {to}g AS MATERIALIZED (SELECT g.y, o.feat, g.x, CAST({S.symmetric('g.y + o.dy', to + 's.h')} AS INTEGER) AS sy, CAST({S.symmetric('g.x + o.dx', to + 's.w')} AS INTEGER) AS sx "
        f"FROM {src} g CROSS JOIN {table} CROSS JOIN {to}s), {to} AS (SELECT g.y, g.feat, g.x, s.v FROM {to}g g JOIN {src} s ON s.y = g.sy AND s.x = g.sx)"
    )


# the magnitude beyond the border is that of the mirrored image, which is the mirrored magnitude: both kernels are even or odd
@query(f"WITH {S.PX}, {_EDGE}, {_shift_sql('mag', [(dx, dy) for dx in range(-3, 4) for dy in range(-3, 4)])} {S.summary('f')}")
def edge_features(spark, sf_dir):
    return summed(features.edge(raster.vectors_as_image(spark, sf_dir)))


@query(f"WITH {S.PX}, {_shift_sql('px', [(dx, dy) for dx in range(-3, 4) for dy in range(-3, 4)])} {S.summary('f')}")
def intensity_square3(spark, sf_dir):
    return summed(features.intensity(raster.vectors_as_image(spark, sf_dir), features.square(3)))


@query(f"WITH {S.PX}, {_shift_sql('px', [(dx, dy) for dy in range(-10, 11) for dx in range(-10, 11) if dx * dy == 0 or abs(dx) == abs(dy)])} {S.summary('f')}")
def intensity_stencil10(spark, sf_dir):
    return summed(features.intensity(raster.vectors_as_image(spark, sf_dir), features.stencil(10)))


@query(f"WITH {S.UNIT}, a AS (SELECT y, x, sum(v) OVER (PARTITION BY y ORDER BY x) AS v FROM ux) SELECT y, x, {S.r6('sum(v) OVER (PARTITION BY x ORDER BY y)')} AS v FROM a")
def integral_image(spark, sf_dir):
    return features.integral(unit_lines(spark, sf_dir)).select("y", "x", r6(F.col("v")).alias("v"))


_ONE, _HALF = [1.0] * 16, [-1.0] * 8 + [1.0] * 8
def _haar_sql(src: str, to: str) -> str:
    p = f"{to}_"
    return (
        f"{S.same(src, p + 'dn', _ONE, 'y', 7)}, {S.same(p + 'dn', p + 'hx', _HALF, 'x', 7)}, {S.same(p + 'dn', p + 'ar', _ONE, 'x', 7)}, {S.same(src, p + 'dh', _HALF, 'y', 7)}, {S.same(p + 'dh', p + 'hy', _ONE, 'x', 7)}, "
        f"{to} AS (SELECT y, 0 AS feat, x, CASE WHEN ar.v > 0 THEN hx.v / ar.v ELSE 0 END AS v FROM {p}hx hx JOIN {p}ar ar USING (y, x) UNION ALL SELECT y, 1 AS feat, x, CASE WHEN ar.v > 0 THEN hy.v / ar.v ELSE 0 END FROM {p}hy hy JOIN {p}ar ar USING (y, x))"
    )


_HAAR = _haar_sql("ux", "f")


@query(f"WITH {S.UNIT}, {_HAAR} SELECT y, feat, x, {S.r6('v')} AS v FROM f")
def haar(spark, sf_dir):
    return schema.to_pixels(features.haar(unit_lines(spark, sf_dir))).select("y", "feat", "x", r6(F.col("v")).alias("v"))


def _gradient_sql(grid: str, src: str = "px") -> str:
    """g(y, x, dx, dy) for the places of a grid(y, x), which may lie beyond the image src."""
    at = {"y0": "y", "ya": "y + 1", "yb": "y - 1"}, {"x0": "x", "xa": "x + 1", "xb": "x - 1"}
    cols = ", ".join(f"CAST({S.symmetric(f'g.{e}', 'hw.h' if e[0] == 'y' else 'hw.w')} AS INTEGER) AS {n}" for part in at for n, e in part.items())
    joins = " ".join(f"JOIN {src} {n} ON {n}.y = p.{y} AND {n}.x = p.{x}" for n, y, x in (("e", "y0", "xa"), ("w", "y0", "xb"), ("s", "ya", "x0"), ("n", "yb", "x0")))
    return f"{S.size(src)}, gp AS MATERIALIZED (SELECT g.y, g.x, {cols} FROM {grid} g CROSS JOIN hw), g AS MATERIALIZED (SELECT p.y, p.x, e.v - w.v AS dx, s.v - n.v AS dy FROM gp p {joins})"


_GRAD = _gradient_sql("px")
_BIN = "least(8, CAST(floor((CASE WHEN atan2(dy, dx) < 0 THEN atan2(dy, dx) + pi() ELSE atan2(dy, dx) END) * 9 / pi()) AS INTEGER))"


@query(f"WITH {S.PX}, {_GRAD} SELECT y, x, {_BIN} AS bin, {S.r6('sqrt(dx * dx + dy * dy)')} AS mag FROM g")
def hog_bins(spark, sf_dir):
    return features.hog_bins(raster.vectors_as_image(spark, sf_dir)).select("y", "x", "bin", r6(F.col("mag")).alias("mag"))


def _hog_sql(src: str, to: str) -> str:
    return (
        f"hw0 AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM {src}), vg AS (SELECT y, x FROM (SELECT unnest(range(-7, CAST(h + 8 AS BIGINT))) AS y FROM hw0) CROSS JOIN (SELECT unnest(range(-7, CAST(w + 8 AS BIGINT))) AS x FROM hw0)), "
        f"{_gradient_sql('vg', src)}, "
        f"gb AS (SELECT y, x, {_BIN} AS bin, sqrt(dx * dx + dy * dy) AS mag FROM g), bb AS (SELECT unnest(range(0, 9)) AS b), "
        "c0 AS (SELECT y, x, b, CASE WHEN bin = b THEN mag ELSE 0 END AS v FROM gb CROSS JOIN bb), "
        "c1 AS (SELECT y, x, b, sum(v) OVER (PARTITION BY b, y ORDER BY x ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v FROM c0), "
        "c2 AS (SELECT y, x, b, sum(v) OVER (PARTITION BY b, x ORDER BY y ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS v FROM c1), "
        "r AS (SELECT c2.y + 7 - 8 * i AS y, c2.x + 7 - 8 * j AS x, CAST((i * 2 + j) * 9 + b AS INTEGER) AS feat, v FROM c2 CROSS JOIN (SELECT unnest(range(0, 2)) AS i) CROSS JOIN (SELECT unnest(range(0, 2)) AS j)), "
        "q AS (SELECT r.* FROM r CROSS JOIN hw WHERE y >= 0 AND y < h AND x >= 0 AND x < w), "
        "n1 AS (SELECT y, x, feat, CASE WHEN sqrt(sum(v * v) OVER (PARTITION BY y, x)) > 0 THEN least(0.2, v / sqrt(sum(v * v) OVER (PARTITION BY y, x))) ELSE 0 END AS v FROM q), "
        f"{to} AS (SELECT CAST(y AS INTEGER) AS y, x, feat, CASE WHEN sqrt(sum(v * v) OVER (PARTITION BY y, x)) > 0 THEN v / sqrt(sum(v * v) OVER (PARTITION BY y, x)) ELSE 0 END AS v FROM n1)"
    )


_HOG = _hog_sql("px", "f")


@query(f"WITH {S.PX}, {_HOG} {S.summary('f')}")
def hog_blocks(spark, sf_dir):
    """The blocks are computed tile by tile; the SQL adds them up by windows."""
    rows = tilebank.bank(raster.vectors_as_image(spark, sf_dir), ("hog",)).select("y", "x", F.posexplode("xs").alias("feat", "v"))
    return rows.groupBy("y", "feat").agg(r6(F.sum("v")).alias("total"), r6(F.max("v")).alias("peak"), r6(F.sum(F.col("v") * (F.col("x") + 1))).alias("moment"))


def _hessian_sql(src: str, p: str, sigma: float) -> str:
    r = int(3 * sigma + 0.5)
    v = [math.exp(-t * t / (2 * sigma * sigma)) / (math.sqrt(2 * math.pi) * sigma * sigma) for t in range(-r, r + 1)]
    uu = [a * t for a, t in zip(v, range(-r, r + 1))]
    u = [a * (t * t - sigma * sigma) for a, t in zip(v, range(-r, r + 1))]
    parts = [S.same(src, f"{p}a", u, "y"), S.same(f"{p}a", f"{p}1", v, "x"), S.same(src, f"{p}b", v, "y"), S.same(f"{p}b", f"{p}2", u, "x"), S.same(src, f"{p}c", uu, "y"), S.same(f"{p}c", f"{p}3", uu, "x")]
    root = "sqrt((d1 - d2) * (d1 - d2) + 4 * dxy * dxy)"
    parts.append(f"{p}h AS (SELECT a.y, a.x, a.v AS d1, b.v AS d2, c.v AS dxy FROM {p}1 a JOIN {p}2 b USING (y, x) JOIN {p}3 c USING (y, x))")
    parts.append(f"{p}m AS (SELECT y, x, (d1 + d2 + {root}) / 2 AS a, (d1 + d2 - {root}) / 2 AS b FROM {p}h)")
    parts.append(f"{p}e AS (SELECT y, x, CASE WHEN abs(a) > abs(b) THEN b ELSE a END AS l1, CASE WHEN abs(a) > abs(b) THEN a ELSE b END AS l2 FROM {p}m)")
    return ", ".join(parts)


@query(f"WITH {S.UNIT}, {_hessian_sql('ux', 'h', 2)} SELECT y, x, {S.r6('l1')} AS l1, {S.r6('l2')} AS l2 FROM he")
def hessian_eigvals(spark, sf_dir):
    h = features.hessian(unit_lines(spark, sf_dir), 2.0).select("y", F.posexplode("p").alias("x", "p"))
    small, large = features.eigenvalues(F.col("p.d1"), F.col("p.d2"), F.col("p.dxy"))
    return h.select("y", "x", r6(small).alias("l1"), r6(large).alias("l2"))


def _ridge(p: str, feat: int) -> str:
    return (
        f"SELECT y, {feat} AS feat, x, CASE WHEN l2 > 0 THEN 1.1565176427496657 * exp(-2 * l1 * l1 / (l2 * l2)) * (1 - exp(-2 * (l1 * l1 + l2 * l2) / (SELECT max(l1 * l1 + l2 * l2) FROM {p}e WHERE l2 > 0))) ELSE 0 END AS v FROM {p}e"
    )


@query(f"WITH {S.UNIT}, ix AS (SELECT y, x, 1 - v AS v FROM ux), {_hessian_sql('ux', 'h', 2)}, {_hessian_sql('ix', 'i', 2)}, f AS ({_ridge('h', 0)} UNION ALL {_ridge('i', 1)}) {S.summary('f')}")
def frangi_s2(spark, sf_dir):
    return summed(features.frangi(unit_lines(spark, sf_dir), (2,)))


_ANGLES = "(VALUES " + ", ".join(f"({a}, CAST({math.cos(a * math.pi / 4)!r} AS DOUBLE), CAST({math.sin(a * math.pi / 4)!r} AS DOUBLE))" for a in range(8)) + ") AS t(feat, c, s)"


@query(
    f"WITH {S.PX}, {_GRAD}, m AS (SELECT y, x, dx, dy, sqrt(dx * dx + dy * dy) AS mag FROM g) "
    f"SELECT y, x, feat, {S.r6('greatest(0.0, CASE WHEN mag > 0 THEN (dx * c + dy * s) / mag ELSE c END) ** 9 * mag')} AS v FROM m CROSS JOIN {_ANGLES}"
)
def sift_orientations(spark, sf_dir):
    return features.orientation_channels(raster.vectors_as_image(spark, sf_dir)).select("y", "x", "feat", r6(F.col("v")).alias("v"))


def _up_sql() -> str:
    parts = [S.UNIT, S.halve("ux", "d1"), S.halve("d1", "d2"), S.size("ux")]
    levels = " UNION ALL ".join(f"SELECT {k} AS level, g.y, g.x, s.v FROM ux g JOIN {src} s ON s.y = g.y >> {k} AND s.x = g.x >> {k}" for k, src in enumerate(("ux", "d1", "d2")))
    return f"WITH {', '.join(parts)}, c AS ({levels}) SELECT level, y, x, {S.r6('v')} AS v FROM c"


@query(_up_sql())
def context_upsample(spark, sf_dir):
    from gridloom.plans import cascade

    im = unit_lines(spark, sf_dir)
    outputs = {k: resample.downsample(im, k) for k in range(3)}
    rows = cascade.contexts_at_start(outputs, im)
    return schema.to_pixels(rows.withColumnRenamed("context", "level")).select("level", "y", "x", r6(F.col("v")).alias("v"))


@query(f"WITH {S.UNIT}, {S.halve('ux', 'd1')}, {S.halve('d1', 'd2')} SELECT 0 AS context, y, x, {S.r6('v')} AS v FROM d2 UNION ALL SELECT 1 AS context, y, x, {S.r6('1 - v')} AS v FROM d2")
def context_downsample(spark, sf_dir):
    """The contexts of level 2: that of level 1 and the output of level 1, both halved."""
    from gridloom.plans import cascade

    im = unit_lines(spark, sf_dir)
    level1 = resample.halve(im)
    carried = cascade.contexts_below(None, im)
    inverse = level1.withColumn("px", F.transform("px", lambda v: 1.0 - v))
    rows = cascade.contexts_below(carried, inverse)
    return schema.to_pixels(rows).select("context", "y", "x", r6(F.col("v")).alias("v"))


def filterbank_sql() -> str:
    """Haar, HOG, edge and stencil features of the unit image, each as in its own query."""
    square = [(dx, dy) for dx in range(-3, 4) for dy in range(-3, 4)]
    parts = [S.UNIT, _haar_sql("ux", "fa"), _hog_sql("ux", "fb"), _edge_sql("ux"), _shift_sql("mag", square, "fc"), _shift_sql("ux", arms(10), "fd")]
    union = " UNION ALL ".join(f"SELECT y, feat + {first} AS feat, x, v FROM {name}" for first, name in ((0, "fa"), (2, "fb"), (38, "fc"), (87, "fd")))
    return f"WITH {', '.join(parts)}, f AS ({union}) {S.summary('f')}"


def arms(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dy == 0 or abs(dx) == abs(dy)]


def frangi_bank_sql() -> str:
    parts, ridges = [S.UNIT, "ix AS (SELECT y, x, 1 - v AS v FROM ux)"], []
    for turn, src in enumerate(("ux", "ix")):
        for k, sigma in enumerate((2, 3, 4, 5, 7, 9, 11)):
            p = f"{'hi'[turn]}{k}"
            parts.append(_hessian_sql(src, p, sigma))
            ridges.append(_ridge(p, 7 * turn + k))
    return f"WITH {', '.join(parts)}, f AS ({' UNION ALL '.join(ridges)}) {S.summary('f')}"


def hog_compat_sql() -> str:
    """Each pixel's own 15 by 15 patch, zero outside: bins of 20 degrees and cells of 8 pixels share their votes linearly."""
    soft = []
    for i in range(15):
        at = i / 8 + 0.5
        rest = at - int(at) + 1 / 16
        soft.append(tuple((1 - rest if int(at) == c else 0) + (rest if int(at) + 1 == c else 0) for c in (1, 2)))
    cells = "(VALUES " + ", ".join(f"({i}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for i, (a, b) in enumerate(soft)) + ")"
    around = lambda n: f"unnest(range(-7, CAST(hw.{n} + 7 AS BIGINT)))"
    return (
        f"WITH {S.UNIT}, {S.size('ux')}, gy AS (SELECT {around('h')} AS y FROM hw), gx AS (SELECT {around('w')} AS x FROM hw), "
        f"pp AS MATERIALIZED (SELECT gy.y, gx.x, s.v FROM gy CROSS JOIN gx CROSS JOIN hw JOIN ux s ON s.y = {S.symmetric('gy.y', 'hw.h')} AND s.x = {S.symmetric('gx.x', 'hw.w')}), "
        "nb AS MATERIALIZED (SELECT p.y, p.x, coalesce(e.v, 0) AS e, coalesce(w.v, 0) AS w, coalesce(n.v, 0) AS n, coalesce(s.v, 0) AS s FROM pp p LEFT JOIN pp e ON e.y = p.y AND e.x = p.x + 1 LEFT JOIN pp w ON w.y = p.y AND w.x = p.x - 1 "
        "LEFT JOIN pp n ON n.y = p.y - 1 AND n.x = p.x LEFT JOIN pp s ON s.y = p.y + 1 AND s.x = p.x), "
        "d AS (SELECT nb.y - a.i + 7 AS y, nb.x - b.i + 7 AS x, a.lo AS a0, a.hi AS a1, b.lo AS b0, b.hi AS b1, CASE WHEN b.i = 14 THEN 0 ELSE e END - CASE WHEN b.i = 0 THEN 0 ELSE w END AS dx, "
        f"CASE WHEN a.i = 0 THEN 0 ELSE n END - CASE WHEN a.i = 14 THEN 0 ELSE s END AS dy FROM nb CROSS JOIN {cells} AS a(i, lo, hi) CROSS JOIN {cells} AS b(i, lo, hi)), "
        "g AS (SELECT d.*, sqrt(dx * dx + dy * dy) AS mag, (atan2(dy, dx) + CASE WHEN dy < 0 THEN pi() ELSE 0 END) * (9 / pi()) + 0.5 AS place FROM d, hw WHERE y >= 0 AND y < h AND x >= 0 AND x < w), "
        "sh AS (SELECT g.*, CAST(floor(place) AS INTEGER) AS up, place - floor(place) AS share FROM g WHERE mag > 0), "
        "vt AS (SELECT y, x, a0, a1, b0, b1, CASE WHEN up = 0 THEN 8 ELSE up - 1 END AS bin, mag * (1 - share) AS v FROM sh UNION ALL SELECT y, x, a0, a1, b0, b1, CASE WHEN up = 9 THEN 0 ELSE up END, mag * share FROM sh), "
        "cl AS MATERIALIZED (SELECT y, x, bin, sum(v * a0 * b0) AS c0, sum(v * a0 * b1) AS c1, sum(v * a1 * b0) AS c2, sum(v * a1 * b1) AS c3 FROM vt GROUP BY y, x, bin), "
        "q AS (SELECT ux.y, ux.x, c * 9 + k AS feat, coalesce(CASE c WHEN 0 THEN c0 WHEN 1 THEN c1 WHEN 2 THEN c2 ELSE c3 END, 0) AS v FROM ux CROSS JOIN (SELECT unnest(range(0, 4)) AS c) CROSS JOIN (SELECT unnest(range(0, 9)) AS k) LEFT JOIN cl ON cl.y = ux.y AND cl.x = ux.x AND cl.bin = k), "
        "n0 AS (SELECT y, x, sqrt(sum(v * v)) AS n FROM q GROUP BY y, x), n1 AS (SELECT q.y, q.x, feat, CASE WHEN n > 0 THEN least(0.2, v / n) ELSE 0 END AS v FROM q JOIN n0 USING (y, x)), "
        "n2 AS (SELECT y, x, sqrt(sum(v * v)) AS n FROM n1 GROUP BY y, x), f AS (SELECT n1.y, n1.x, CAST(feat AS INTEGER) AS feat, CASE WHEN n > 0 THEN v / n ELSE 0 END AS v FROM n1 JOIN n2 USING (y, x)) "
        f"{S.summary('f')}"
    )


def _network_sql(name: str, images: list[tuple[str, int, bool]], contexts: list[str], weights) -> str:
    """name(y, x, v): the network's outputs from features (table, how many, whether half is added) and stencils around contexts."""
    parts, first, union = [], 0, []
    for table, n, add in images:
        union.append(f"SELECT y, x, feat + {first} AS feat, v{' + 0.5' if add else ''} AS v FROM {table}")
        first += n
    for k, table in enumerate(contexts):
        parts.append(_shift_sql(table, arms(1), f"{name}c{k}"))
        union.append(f"SELECT y, x, feat + {first} AS feat, v FROM {name}c{k}")
        first += 9
    w = "(VALUES " + ", ".join(f"({i}, {j}, {k}, CAST({weights[i, j, k].item()!r} AS DOUBLE))" for i in range(weights.shape[0]) for j in range(weights.shape[1]) for k in range(weights.shape[2])) + ") AS w(i, j, feat, w)"
    assert weights.shape[2] == first + 1
    parts.append(f"{name}w AS (SELECT * FROM {w}), {name}z AS (SELECT y, x, i, j, sum(w * v) AS z FROM ({' UNION ALL '.join(union)}) f JOIN {name}w w USING (feat) GROUP BY y, x, i, j)")
    parts.append(f"{name}s AS (SELECT y, x, z.i, 1 / (1 + exp(-greatest(-709.0, least(37.0, z + b.w)))) AS s FROM {name}z z JOIN {name}w b ON b.i = z.i AND b.j = z.j AND b.feat = {first})")
    parts.append(f"{name}g AS (SELECT y, x, i, product(s) AS g FROM {name}s GROUP BY y, x, i), {name} AS MATERIALIZED (SELECT y, x, 1 - product(1 - g) AS v FROM {name}g GROUP BY y, x)")
    return ", ".join(parts)


def edge_compat_sql() -> str:
    """Edges whose gradients see zeros beyond the image: sums over the pixels that there are."""
    g, d = features.gauss_pair()
    zero = lambda src, to, taps, which: S.axis(src, to, S.values(taps), "r.r + k.n - 3", "m", which)
    parts = [S.UNIT, zero("ux", "ga", g, "y"), zero("ga", "gd", d, "x"), zero("ux", "da", d, "y"), zero("da", "dg", g, "x")]
    parts.append("mag AS MATERIALIZED (SELECT a.y, a.x, sqrt(a.v * a.v + b.v * b.v) AS v FROM gd a JOIN dg b USING (y, x))")
    parts.append(_shift_sql("mag", [(dx, dy) for dx, dy in features.square(3)]))
    return f"WITH {', '.join(parts)} {S.summary('f')}"


def cascade_sql(weights: dict) -> str:
    """Two stages and one level by whole images: the features of the image and of its half, and what each stage makes of them."""
    parts = [S.UNIT, S.halve("ux", "hx0"), "half AS MATERIALIZED (SELECT y, x, v FROM hx0)"]
    for src, p in (("ux", "p"), ("half", "q")):
        parts += [_haar_sql(src, f"{p}h"), _shift_sql(src, arms(2), f"{p}i")]
    of = lambda p: [(f"{p}h", 2, True), (f"{p}i", 17, False)]
    parts += [_network_sql("o10", of("p"), [], weights[1, 0]), S.halve("o10", "o10h"), _network_sql("o11", of("q"), ["o10h"], weights[1, 1])]
    parts.append("o11u AS MATERIALIZED (SELECT u.y, u.x, s.v FROM ux u JOIN o11 s ON s.y = u.y >> 1 AND s.x = u.x >> 1)")
    parts.append(_network_sql("o20", of("p"), ["o10", "o11u"], weights[2, 0]))
    return f"WITH {', '.join(parts)} {V} o20"


def sift_sql() -> str:
    """Over the mirrored image: smoothed, divided by its largest value, its gradient in eight directions, added up in cells of 8 by 8."""
    bell = lambda n: [math.exp(-((t - n // 2) ** 2) / 2) / sum(math.exp(-((u - n // 2) ** 2) / 2) for u in range(n)) for t in range(n)]
    b = bell(5)
    d = [b[1] - b[0], (b[2] - b[0]) / 2, (b[3] - b[1]) / 2, (b[4] - b[2]) / 2, b[4] - b[3]]
    d = [2 * t / (sum(map(abs, d)) * sum(b)) for t in d]
    cell = "(VALUES " + ", ".join(f"({k}, {1 - abs(1 + 0.25 * k - 1.875)})" for k in range(8)) + ") AS k(n, t)"
    angles = "(VALUES " + ", ".join(f"({a}, CAST({math.cos(a * math.pi / 4)!r} AS DOUBLE), CAST({math.sin(a * math.pi / 4)!r} AS DOUBLE))" for a in range(8)) + ") AS t(a, c, s)"
    around = lambda n: f"unnest(range(0, CAST(hw.{n} + 30 AS BIGINT)))"
    return (
        f"WITH {S.UNIT}, {S.size('ux')}, ya AS (SELECT {around('h')} AS y FROM hw), xa AS (SELECT {around('w')} AS x FROM hw), "
        f"pp AS MATERIALIZED (SELECT CAST(ya.y AS INTEGER) AS y, CAST(xa.x AS INTEGER) AS x, s.v FROM ya CROSS JOIN xa CROSS JOIN hw JOIN ux s ON s.y = {S.symmetric('ya.y - 15', 'hw.h')} AND s.x = {S.symmetric('xa.x - 15', 'hw.w')}), "
        f"{_valid('pp', 's1', bell(7), 'y')}, {_valid('s1', 's2', bell(7), 'x')}, sm AS MATERIALIZED (SELECT y, x, v / (SELECT max(v) FROM s2) AS v FROM s2), "
        f"{_valid('sm', 'a1', b, 'y')}, {_valid('a1', 'a2', d, 'x')}, {_valid('sm', 'b1', d, 'y')}, {_valid('b1', 'b2', b, 'x')}, "
        "m AS (SELECT a2.y, a2.x, a2.v AS dx, b2.v AS dy, sqrt(a2.v * a2.v + b2.v * b2.v) AS mag FROM a2 JOIN b2 USING (y, x)), "
        f"ch AS (SELECT a, y, x, CASE WHEN mag > 0 THEN greatest(0.0, (dx * c + dy * s) / mag) ** 9 * mag ELSE 0 END AS v FROM m CROSS JOIN {angles}), "
        f"c1 AS (SELECT a, y - n AS y, x, sum(t * v) AS v FROM ch CROSS JOIN {cell} GROUP BY 1, 2, 3), c2 AS MATERIALIZED (SELECT a, y, x - n AS x, sum(t * v) AS v FROM c1 CROSS JOIN {cell} GROUP BY 1, 2, 3), "
        "q AS (SELECT y - 1 - 4 * j AS y, x - 1 - 4 * i AS x, CAST((i * 4 + j) * 8 + a AS INTEGER) AS feat, v FROM c2 CROSS JOIN (SELECT unnest(range(0, 4)) AS i) CROSS JOIN (SELECT unnest(range(0, 4)) AS j)), "
        "f0 AS MATERIALIZED (SELECT q.* FROM q, hw WHERE y >= 0 AND y < h AND x >= 0 AND x < w), n0 AS (SELECT y, x, sum(v * v) AS n FROM f0 GROUP BY y, x), "
        "f1 AS MATERIALIZED (SELECT f0.y, f0.x, feat, n, v, CASE WHEN n > 0 THEN least(0.2, v / sqrt(n)) ELSE 0 END AS u FROM f0 JOIN n0 USING (y, x)), n1 AS (SELECT y, x, sqrt(sum(u * u)) AS n1 FROM f1 GROUP BY y, x), "
        f"f AS (SELECT CAST(f1.y AS INTEGER) AS y, f1.x, feat, CASE WHEN n > 1 THEN u / n1 ELSE v END AS v FROM f1 JOIN n1 USING (y, x)) {S.summary('f')}"
    )

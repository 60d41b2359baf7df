"""Queries over tables: statistics, normalization, metrics, samples, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.pixel import r6
from gridloom.operators import grid, sampling, stats
from gridloom.plans import sql as S
from gridloom.sources import raster

QUERIES: dict = {}
SQL: dict[str, str] = {}

FEAT = "f AS (SELECT CAST(i - 1 AS INTEGER) AS feat, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS t(i))"
EVENTS = "f AS (SELECT event_type AS feat, value AS v FROM events)"
LINEITEM = "f AS (SELECT l_returnflag AS feat, l_extendedprice AS v FROM lineitem)"


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raster.table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("feat", "v"))
    return rows.select("feat", F.col("v").cast("double").alias("v"))


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.table(spark, sf_dir, "events").select(F.col("event_type").alias("feat"), F.col("value").alias("v"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("feat"), F.col("l_extendedprice").alias("v"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


MEDIAN_MAD = (
    "m AS (SELECT {g}median(v) AS med FROM f {by}), d AS (SELECT {p}abs(v - med) AS a, med FROM f {join}), "
    "p AS (SELECT {g}any_value(med) AS med, median(a) * 1.482602218505602 AS mad FROM d {by})"
)


def _mad(by: bool) -> str:
    return MEDIAN_MAD.format(g="feat, " if by else "", p="f.feat, " if by else "", by="GROUP BY feat" if by else "", join="JOIN m USING (feat)" if by else "CROSS JOIN m")


_SOURCES = {"by_feature": (embedding_features, FEAT, True), "by_event": (event_values, EVENTS, True), "by_price": (prices, LINEITEM, True), "flat": (embedding_features, FEAT, False), "events_flat": (event_values, EVENTS, False)}


def _add_stats() -> None:
    for name, (source, cte, by) in _SOURCES.items():
        g, tail, keys = ("feat, ", " GROUP BY feat", ("feat",)) if by else ("", "", ())
        QUERIES[f"min_max_{name}"] = lambda s, d, f=source, k=keys: _rounded(stats.min_max(f(s, d), *k))
        SQL[f"min_max_{name}"] = f"WITH {cte} SELECT {g}{S.r6('min(v)')} AS low, {S.r6('max(v)')} AS high FROM f{tail}"
        QUERIES[f"mean_std_{name}"] = lambda s, d, f=source, k=keys: _rounded(stats.mean_std(f(s, d), *k))
        SQL[f"mean_std_{name}"] = f"WITH {cte} SELECT {g}{S.r6('avg(v)')} AS mean, {S.r6('stddev_pop(v)')} AS std FROM f{tail}"
        QUERIES[f"median_{name}"] = lambda s, d, f=source, k=keys: _rounded(stats.median(f(s, d), *k))
        SQL[f"median_{name}"] = f"WITH {cte} SELECT {g}{S.r6('median(v)')} AS median FROM f{tail}"
        QUERIES[f"percentiles_{name}"] = lambda s, d, f=source, k=keys: _rounded(stats.percentiles(f(s, d), [0.05, 0.25, 0.75, 0.95], *k))
        qs = ", ".join(f"{S.r6(f'quantile_cont(v, {q})')} AS q{i + 1}" for i, q in enumerate((0.05, 0.25, 0.75, 0.95)))
        SQL[f"percentiles_{name}"] = f"WITH {cte} SELECT {g}{qs} FROM f{tail}"
        QUERIES[f"median_mad_{name}"] = lambda s, d, f=source, k=keys: _rounded(stats.median_mad(f(s, d), *k))
        SQL[f"median_mad_{name}"] = f"WITH {cte}, {_mad(by)} SELECT {g}{S.r6('med')} AS median, {S.r6('mad')} AS mad FROM p"


_add_stats()

NORM = {
    "min-max": ("p AS (SELECT feat, min(v) AS off, max(v) - min(v) AS spread FROM f GROUP BY feat)", "(v - off) * s"),
    "mean-std": ("p AS (SELECT feat, avg(v) AS off, 5 * stddev_pop(v) AS spread FROM f GROUP BY feat)", "(v - off) * s + 0.5"),
    "median-mad": (_mad(True).replace("p AS", "q AS") + ", p AS (SELECT feat, med AS off, 5 * mad AS spread FROM q)", "(v - off) * s + 0.5"),
    "iqr": ("q AS (SELECT feat, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM f GROUP BY feat), p AS (SELECT feat, a - 1.5 * (b - a) AS off, 4 * (b - a) AS spread FROM q)", "(v - off) * s"),
}


def _vector_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raster.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("feat", "v"))
    return rows.withColumn("v", F.col("v").cast("double"))


def _add_norms() -> None:
    cte = FEAT.replace("AS feat,", "AS feat, vec_id AS y,")
    for method, (params, value) in NORM.items():
        name = "norm_" + method.replace("-", "")

        def run(spark: SparkSession, sf_dir: str, method: str = method) -> DataFrame:
            rows = _vector_values(spark, sf_dir)
            out = stats.normalize(rows, F.broadcast(stats.fit(rows, method, "feat")), method, "feat")
            return out.select("y", "feat", r6(F.col("v")).alias("v"))

        QUERIES[name] = run
        SQL[name] = f"WITH {cte}, {params}, n AS (SELECT feat, off, 1 / CASE WHEN spread = 0 THEN 1.0 ELSE spread END AS s FROM p) SELECT y, feat, {S.r6(value)} AS v FROM f JOIN n USING (feat)"


_add_norms()


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raster.table(spark, sf_dir, "labels").join(raster.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select((F.col("n_chars") >= 1000).alias("pred"), (F.col("quality") > 0).alias("gt"), (F.col("toxic") == 0).alias("mask"))


CONFUSION = (
    "j AS (SELECT n_chars >= 1000 AS pred, quality > 0 AS gt FROM labels JOIN documents USING (doc_id) WHERE toxic = 0), "
    "c AS (SELECT CAST(count(*) FILTER (pred AND gt) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT pred AND NOT gt) AS BIGINT) AS tn, "
    "CAST(count(*) FILTER (pred AND NOT gt) AS BIGINT) AS fp, CAST(count(*) FILTER (NOT pred AND gt) AS BIGINT) AS fn FROM j)"
)


def confusion_matrix(spark, sf_dir):
    return stats.confusion(judged(spark, sf_dir))


def accuracy_f_g(spark, sf_dir):
    return stats.confusion(judged(spark, sf_dir)).select(r6(stats.accuracy()).alias("accuracy"), r6(stats.f_value()).alias("f_value"), r6(stats.g_mean()).alias("g_mean"))


def subsample_per_class(spark, sf_dir):
    rows = raster.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).alias("label"))
    return sampling.subsample(rows, 100, 7, "label", "vec_id").select("vec_id", "label")


def kmeans_downsample(spark, sf_dir):
    rows = raster.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") < 5).alias("label"))
    return sampling.every(rows, 10, 10, "label", "vec_id").select("vec_id", "label")


def topk_remainders(spark, sf_dir):
    rows = raster.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("i"))
    return sampling.largest_remainders(rows, 7, 25, F.pmod(F.col("i") * 37, F.lit(11))).select("i", "rem")


def _height(spark: SparkSession, sf_dir: str) -> int:
    return raster.table(spark, sf_dir, "embeddings").agg(F.max("vec_id") + 1).first()[0]


def tile_grid(spark, sf_dir):
    return grid.tiles(spark, _height(spark, sf_dir), 64, (16, 32))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.tiles(spark, _height(spark, sf_dir), 64, (16, 32), [(1, 1), (2, 1), (0, 5), (3, 9), (1, 1), (9, 99)], ignore_bad=True)


def tile_sort_distinct(spark, sf_dir):
    return _wanted(spark, sf_dir)


def padding_tiles(spark, sf_dir):
    return grid.padding_tiles(_wanted(spark, sf_dir), -(-_height(spark, sf_dir) // 32), 4)


def tile_regions_by_level(spark, sf_dir):
    h = _height(spark, sf_dir)
    return grid.regions(grid.tiles(spark, h, 64, (16, 32)), h, 64, (16, 32), 4)


def copy_regions(spark, sf_dir):
    from gridloom import schema

    px = schema.to_pixels(raster.vectors_as_image(spark, sf_dir))
    return grid.pasted(px, F.broadcast(_wanted(spark, sf_dir)), (16, 32)).select("y", "x", r6(F.col("v")).alias("v"))


def tiles_for_group(spark, sf_dir):
    h = _height(spark, sf_dir)
    rows = [(g, x, y) for g in range(1, 8) for x, y in grid.tiles_for_group(g, 7, h, 64, (16, 32))]
    return spark.createDataFrame(rows, "grp int, tx int, ty int")


for _f in (confusion_matrix, accuracy_f_g, subsample_per_class, kmeans_downsample, topk_remainders, tile_grid, tile_sort_distinct, padding_tiles, tile_regions_by_level, copy_regions, tiles_for_group):
    QUERIES[_f.__name__] = _f

_H = "hh AS (SELECT max(vec_id) + 1 AS h FROM embeddings)"
_WANTED = "wt AS (SELECT DISTINCT ty, tx FROM (VALUES (1, 1), (1, 2), (5, 0), (9, 3), (1, 1), (99, 9)) AS v(ty, tx), hh WHERE tx < 4 AND ty < CAST(ceil(h / 32.0) AS INTEGER))"
_TILES = f"{_H}, tl AS (SELECT CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx FROM (SELECT unnest(range(0, CAST(ceil(h / 32.0) AS BIGINT))) AS ty FROM hh) CROSS JOIN (SELECT unnest(range(0, 4)) AS tx))"
SQL |= {
    "confusion_matrix": f"WITH {CONFUSION} SELECT * FROM c",
    "accuracy_f_g": f"WITH {CONFUSION} SELECT {S.r6('CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn)')} AS accuracy, {S.r6('2.0 * tp / (2 * tp + fp + fn)')} AS f_value, "
    f"{S.r6('sqrt((CAST(tp AS DOUBLE) / (tp + fn)) * (CAST(tn AS DOUBLE) / (tn + fp)))')} AS g_mean FROM c",
    "subsample_per_class": "SELECT vec_id, label FROM (SELECT vec_id, label < 5 AS label, row_number() OVER (PARTITION BY label < 5 ORDER BY md5('7:' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= 100",
    "kmeans_downsample": "SELECT vec_id, label FROM (SELECT vec_id, true AS label, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings WHERE label < 5) WHERE r % 10 = 0",
    "topk_remainders": "SELECT i, rem FROM (SELECT CAST(n_nationkey AS INTEGER) AS i, CAST(n_nationkey * 37 % 11 AS INTEGER) AS rem FROM nation) ORDER BY rem DESC, CASE WHEN i IN (0, 24) THEN 1 ELSE 0 END DESC, i DESC LIMIT 7",
    "tile_grid": f"WITH {_TILES} SELECT ty, tx FROM tl",
    "tile_sort_distinct": f"WITH {_H}, {_WANTED} SELECT ty, tx FROM wt",
    "padding_tiles": f"WITH {_TILES}, {_WANTED} SELECT ty, tx FROM tl WHERE EXISTS (SELECT 1 FROM wt WHERE abs(wt.ty - tl.ty) <= 1 AND abs(wt.tx - tl.tx) <= 1) AND NOT EXISTS (SELECT 1 FROM wt WHERE wt.ty = tl.ty AND wt.tx = tl.tx)",
    "tile_regions_by_level": f"WITH RECURSIVE {_TILES}, lv AS (SELECT 0 AS level, h, CAST(64 AS BIGINT) AS w FROM hh UNION ALL SELECT level + 1, (h + 1) // 2, (w + 1) // 2 FROM lv WHERE level < 4) "
    "SELECT level, ty, tx, CAST(least(ty * 32 >> level, h) AS INTEGER) AS y0, CAST(least(tx * 16 >> level, w) AS INTEGER) AS x0, CAST(least((ty + 1) * 32 >> level, h) AS INTEGER) AS y1, CAST(least((tx + 1) * 16 >> level, w) AS INTEGER) AS x1 FROM tl CROSS JOIN lv",
    "copy_regions": f"WITH {S.PX}, {_H}, {_WANTED} SELECT px.y, px.x, CASE WHEN wt.ty IS NULL THEN 0.0 ELSE {S.r6('v')} END AS v FROM px LEFT JOIN wt ON wt.ty = px.y // 32 AND wt.tx = px.x // 16",
    "tiles_for_group": f"WITH RECURSIVE {_H}, s AS (SELECT CAST((h + 31) // 32 AS BIGINT) AS ny FROM hh), nodes AS (SELECT unnest(range(0, 8)) AS n), "
    "r AS (SELECT a.n AS a, b.n AS b, i, 4 * i // (b.n - a.n) AS x0, 4 * (i + 1) // (b.n - a.n) AS x1, ny * a.n // 7 AS y0, ny * b.n // 7 AS y1, ny FROM nodes a JOIN nodes b ON a.n < b.n, s, (SELECT unnest(range(0, 7)) AS i) WHERE i < b.n - a.n), "
    "e AS (SELECT a, b, CAST(sum(CASE WHEN (x1 - x0) * (y1 - y0) = 0 THEN 0 ELSE 7 * ((least(x1 + 1, 4) - greatest(x0 - 1, 0)) * (least(y1 + 1, ny) - greatest(y0 - 1, 0)) - (x1 - x0) * (y1 - y0)) END + abs((x1 - x0) * (y1 - y0) * 7 - ny * 4)) AS BIGINT) AS cost FROM r GROUP BY a, b), "
    "p AS (SELECT CAST(0 AS BIGINT) AS node, CAST([] AS BIGINT[]) AS cuts, CAST(0 AS BIGINT) AS cost UNION ALL SELECT e.b, list_append(p.cuts, e.b), p.cost + e.cost FROM p JOIN e ON e.a = p.node), "
    "best AS (SELECT list_prepend(0, cuts) AS cuts FROM p WHERE node = 7 ORDER BY cost, cuts LIMIT 1), "
    "band AS (SELECT cuts[k] AS a, cuts[k + 1] AS b FROM best, (SELECT unnest(range(1, 8)) AS k) WHERE k < len(cuts)) "
    "SELECT CAST(r.a + r.i + 1 AS INTEGER) AS grp, CAST(tx AS INTEGER) AS tx, CAST(ty AS INTEGER) AS ty FROM band JOIN r USING (a, b) JOIN (SELECT unnest(range(0, 4)) AS tx) ON tx >= x0 AND tx < x1 JOIN (SELECT unnest(range(0, ny)) AS ty FROM s) ON ty >= y0 AND ty < y1",
}


def norm_none(spark, sf_dir):
    rows = _vector_values(spark, sf_dir)
    out = stats.normalize(rows, F.broadcast(stats.fit(rows, "none", "feat")), "none", "feat")
    return out.select("y", "feat", r6(F.col("v")).alias("v"))


def norm_selected(spark, sf_dir):
    """Of the features only the even ones take part."""
    rows = _vector_values(spark, sf_dir)
    out = stats.normalize(rows, F.broadcast(stats.fit(rows, "mean-std", "feat")), "mean-std", "feat", only=F.col("feat") % 2 == 0)
    return out.select("y", "feat", r6(F.col("v")).alias("v"))


def mean_std_of_samples(spark, sf_dir):
    return _rounded(stats.mean_std(event_values(spark, sf_dir), "feat", ddof=1))


def random_subset(spark, sf_dir):
    return sampling.random_subset(raster.table(spark, sf_dir, "embeddings").select("vec_id", "label"), 150, 3, "vec_id")


def shuffled_places(spark, sf_dir):
    return sampling.places(raster.table(spark, sf_dir, "embeddings").select("vec_id", "label"), 3, "vec_id")


def tile_sizes(spark, sf_dir):
    """Which sizes of tiles each number of levels allows."""
    rows = []
    for levels in range(5):
        for size in (None, 100, 64, 0, -8, (48, 96), (96, 50)):
            w, h = (512, 512) if size is None else (size, size) if isinstance(size, int) else size
            try:
                ok = grid.tile_size(size, levels) == (w, h)
            except ValueError:
                ok = False
            rows.append((levels, w, h, ok))
    return spark.createDataFrame(rows, "levels int, w int, h int, ok boolean")


_BOXES = (((1, 1),), ((0, 0), (2, 5)), ((3, 9), (3, 10)))


def bounding_regions(spark, sf_dir):
    """What has to be read for wanted tiles, with halos of 10, 8 and 4 pixels at three levels."""
    h = _height(spark, sf_dir)
    rows = [(i, *grid.bounding_region(list(b), (16, 32), h, 64, [10, 8, 4])) for i, b in enumerate(_BOXES)]
    return spark.createDataFrame(rows, "box int, y0 int, x0 int, y1 int, x1 int")


def all_tiles(spark, sf_dir):
    h = _height(spark, sf_dir)
    ny = -(-h // 32)
    rows = [("some", grid.all_tiles(_wanted(spark, sf_dir), ny, 4)), ("every", grid.all_tiles(grid.tiles(spark, h, 64, (16, 32)), ny, 4))]
    return spark.createDataFrame(rows, "wanted string, complete boolean")


for _f in (norm_none, norm_selected, mean_std_of_samples, random_subset, shuffled_places, tile_sizes, bounding_regions, all_tiles):
    QUERIES[_f.__name__] = _f

_VALUES = FEAT.replace("AS feat,", "AS feat, vec_id AS y,")
_SHUFFLE = "row_number() OVER (ORDER BY md5('3:' || vec_id), vec_id)"
_HALO = 40  # the widest of (10 + 6), (8 + 6) * 2 and (4 + 6) * 4
SQL |= {
    "norm_none": f"WITH {_VALUES} SELECT y, feat, {S.r6('v')} AS v FROM f",
    "norm_selected": f"WITH {_VALUES}, p AS (SELECT feat, avg(v) AS m, 5 * stddev_pop(v) AS s FROM f GROUP BY feat) SELECT y, feat, {S.r6('CASE WHEN feat % 2 = 0 THEN (v - m) / s + 0.5 ELSE v END')} AS v FROM f JOIN p USING (feat)",
    "mean_std_of_samples": f"WITH {EVENTS} SELECT feat, {S.r6('avg(v)')} AS mean, {S.r6('stddev_samp(v)')} AS std FROM f GROUP BY feat",
    "random_subset": f"SELECT vec_id, label FROM (SELECT vec_id, label, {_SHUFFLE} AS r FROM embeddings) WHERE r <= 150",
    "shuffled_places": f"SELECT vec_id, label, CAST({_SHUFFLE} AS BIGINT) AS place FROM embeddings",
    "tile_sizes": "SELECT CAST(levels AS INTEGER) AS levels, w, h, w > 0 AND h > 0 AND w % CAST(pow(2, levels) AS INTEGER) = 0 AND h % CAST(pow(2, levels) AS INTEGER) = 0 AS ok "
    "FROM (SELECT unnest(range(0, 5)) AS levels), (VALUES (512, 512), (100, 100), (64, 64), (0, 0), (-8, -8), (48, 96), (96, 50)) AS s(w, h)",
    "bounding_regions": f"WITH {_H}, b AS (SELECT box, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM (VALUES (0, 1, 1), (1, 0, 0), (1, 2, 5), (2, 3, 9), (2, 3, 10)) AS t(box, x, y) GROUP BY box) "
    f"SELECT box, CAST(greatest(0, floor((ya * 32 - {_HALO}) / 32.0) * 32) AS INTEGER) AS y0, CAST(greatest(0, floor((xa * 16 - {_HALO}) / 16.0) * 16) AS INTEGER) AS x0, "
    f"CAST(least(h, ceil(((yb + 1) * 32 + {_HALO}) / 32.0) * 32) AS INTEGER) AS y1, CAST(least(64, ceil(((xb + 1) * 16 + {_HALO}) / 16.0) * 16) AS INTEGER) AS x1 FROM b, hh",
    "all_tiles": f"WITH {_TILES}, {_WANTED} SELECT 'some' AS wanted, (SELECT count(*) FROM wt) = (SELECT count(*) FROM tl) AS complete UNION ALL SELECT 'every', true",
}

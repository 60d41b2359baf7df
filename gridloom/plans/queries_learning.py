"""Queries over clustering, the network, the tile bank and the cascade."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.functions.pixel import r6
from gridloom.operators import classify, tilebank
from gridloom.plans import cascade, queries_features
from gridloom.plans import sql as S
from gridloom.plans.queries_pixels import unit_lines
from gridloom.sources import raster

QUERIES: dict = {}
SQL: dict[str, str] = {}
N = 64


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a sample; the first five of its ten classes are the positive ones."""
    rows = raster.table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("sample"), F.col("embedding").cast("array<double>").alias("xs"), (F.col("label") < 5).alias("label"), F.col("label").alias("kind"))


def first_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres fixed in advance: the vectors 0 to 7."""
    return samples_of(spark, sf_dir).filter("sample < 8").select(F.col("sample").cast("int").alias("j"), F.col("xs").alias("c"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network of 5 groups of 5 nodes between the means of the classes."""
    means = classify.means(samples_of(spark, sf_dir), "kind", N)
    positive = means.filter("kind < 5").select(F.col("kind").cast("int").alias("j"), "c")
    negative = means.filter("kind >= 5").select((F.col("kind") - 5).cast("int").alias("j"), "c")
    return classify.init_weights(positive, negative)


_S = "s AS (SELECT vec_id AS sample, CAST(i - 1 AS INTEGER) AS k, CAST(embedding[i] AS DOUBLE) AS x, label < 5 AS label, label AS kind FROM embeddings, range(1, 65) AS t(i))"
_D2 = f"{_S}, c AS (SELECT CAST(sample AS INTEGER) AS j, k, x FROM s WHERE sample < 8), d AS (SELECT s.sample, c.j, sum((s.x - c.x) * (s.x - c.x)) AS d2 FROM s JOIN c USING (k) GROUP BY 1, 2)"
_NEAR = _D2 + ", a AS (SELECT sample, j AS cluster, d2 FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY d2, j) AS r FROM d) WHERE r = 1)"
_W = (
    f"{_S}, m AS (SELECT kind, k, avg(x) AS c FROM s GROUP BY 1, 2), pq AS (SELECT p.kind AS i, q.kind - 5 AS j, p.k, p.c AS p, q.c AS q FROM m p JOIN m q USING (k) WHERE p.kind < 5 AND q.kind >= 5), "
    "nm AS (SELECT i, j, sqrt(sum((p - q) * (p - q))) AS n FROM pq GROUP BY 1, 2), w0 AS (SELECT i, j, k, (p - q) / n AS w, p + q AS pq FROM pq JOIN nm USING (i, j)), "
    "w AS (SELECT i, j, k, w FROM w0 UNION ALL SELECT i, j, 64 AS k, -0.5 * sum(pq * w) AS w FROM w0 GROUP BY 1, 2)"
)
_SIGMA = (
    _W + ", z AS (SELECT s.sample, s.label, w.i, w.j, sum(w.w * s.x) AS z FROM s JOIN w USING (k) GROUP BY 1, 2, 3, 4), "
    "sg AS (SELECT z.sample, z.label, z.i, z.j, 1 / (1 + exp(-greatest(-709.0, least(37.0, z + w.w)))) AS s FROM z JOIN w ON w.i = z.i AND w.j = z.j AND w.k = 64), "
    "gg AS (SELECT sample, label, i, product(s) AS g FROM sg GROUP BY 1, 2, 3)"
)
_F = _SIGMA + ", ff AS (SELECT sample, label, 1 - product(1 - g) AS f FROM gg GROUP BY 1, 2)"


@query(f"WITH {_D2} SELECT sample, j, {S.r6('d2')} AS d2 FROM d")
def pairwise_sqdist(spark, sf_dir):
    return classify.pairwise(samples_of(spark, sf_dir), first_centres(spark, sf_dir)).select("sample", "j", r6(F.col("d2")).alias("d2"))


@query(f"WITH {_NEAR} SELECT sample, cluster, {S.r6('d2')} AS d2 FROM a")
def kmeans_assign(spark, sf_dir):
    return classify.assigned(samples_of(spark, sf_dir), first_centres(spark, sf_dir)).select("sample", "cluster", r6(F.col("d2")).alias("d2"))


@query(f"WITH {_NEAR} SELECT cluster, CAST(count(*) AS BIGINT) AS n, k, {S.r6('avg(x)')} AS c FROM a JOIN s USING (sample) GROUP BY cluster, k")
def kmeans_update(spark, sf_dir):
    near = classify.assigned(samples_of(spark, sf_dir), first_centres(spark, sf_dir))
    return classify.means(near, "cluster", N).select("cluster", "n", F.posexplode("c").alias("k", "c")).withColumn("c", r6(F.col("c")))


@query(f"WITH {_S}, d AS (SELECT k, CASE WHEN stddev_pop(x) < 1e-10 THEN 1.0 ELSE stddev_pop(x) END AS sd FROM s GROUP BY k) SELECT sample, k, {S.r6('x / sd')} AS x FROM s JOIN d USING (k)")
def whiten(spark, sf_dir):
    white, _ = classify.whitened(samples_of(spark, sf_dir), N)
    return white.select("sample", F.posexplode("xs").alias("k", "x")).withColumn("x", r6(F.col("x")))


@query(f"WITH {_W} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, {S.r6('w')} AS w FROM w")
def ldnn_init_weights(spark, sf_dir):
    return class_weights(spark, sf_dir).select("i", "j", F.posexplode("w").alias("k", "w")).withColumn("w", r6(F.col("w")))


@query(f"WITH {_SIGMA} SELECT sample, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {S.r6('s')} AS s FROM sg")
def ldnn_sigma(spark, sf_dir):
    out = classify.sigmas(samples_of(spark, sf_dir), class_weights(spark, sf_dir)).select("sample", F.posexplode("s").alias("i", "s"))
    return out.select("sample", "i", F.posexplode("s").alias("j", "s")).withColumn("s", r6(F.col("s")))


@query(f"WITH {_F} SELECT sample, {S.r6('f')} AS f FROM ff")
def ldnn_evaluate(spark, sf_dir):
    return classify.evaluate(samples_of(spark, sf_dir), class_weights(spark, sf_dir)).select("sample", r6(F.col("f")).alias("f"))


@query(f"WITH {_SIGMA} SELECT sample, {S.r6('1 - sqrt(product(1 - sqrt(g)))')} AS f FROM gg GROUP BY sample")
def ldnn_evaluate_dropout(spark, sf_dir):
    return classify.evaluate(samples_of(spark, sf_dir), class_weights(spark, sf_dir), dropout=True).select("sample", r6(F.col("f")).alias("f"))


@query(f"WITH {_F} SELECT {S.r6('sqrt(avg((f - CASE WHEN label THEN 0.9 ELSE 0.1 END) ** 2))')} AS rmse FROM ff")
def ldnn_error(spark, sf_dir):
    return classify.error(classify.evaluate(samples_of(spark, sf_dir), class_weights(spark, sf_dir))).select(r6(F.col("rmse")).alias("rmse"))


@query(
    f"WITH {_F}, c AS (SELECT gg.sample, gg.i, -2 * (CASE WHEN gg.label THEN 0.9 ELSE 0.1 END - f) * (1 - f) * g / (1 - least(g, 1 - 1e-16)) AS c2 FROM gg JOIN ff USING (sample)), "
    "c3 AS (SELECT sg.sample, sg.i, sg.j, c2 * (1 - s) AS c3 FROM sg JOIN c ON c.sample = sg.sample AND c.i = sg.i), "
    "gr AS (SELECT i, j, k, sum(c3 * x) AS grad FROM c3 JOIN s USING (sample) GROUP BY 1, 2, 3 UNION ALL SELECT i, j, 64, sum(c3) FROM c3 GROUP BY 1, 2) "
    f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(k AS INTEGER) AS k, {S.r6('grad')} AS grad FROM gr"
)
def ldnn_gradient_batch(spark, sf_dir):
    out = classify.gradient(samples_of(spark, sf_dir), class_weights(spark, sf_dir), N)
    return out.select("i", "j", F.posexplode("grad").alias("k", "grad")).withColumn("grad", r6(F.col("grad")))


@query()
def kmeans_ml(spark, sf_dir):
    centres, _ = classify.kmeans_ml(samples_of(spark, sf_dir).select("sample", "xs"), 8, N)
    return centres.select("j", F.posexplode("c").alias("k", "c")).withColumn("c", r6(F.col("c")))


@query()
def ldnn_train(spark, sf_dir):
    params = classify.Params(groups=4, nodes=4, passes=3)
    weights, _ = classify.train(samples_of(spark, sf_dir).select("sample", "xs", "label"), params, N)
    return weights.select("i", "j", F.posexplode("w").alias("k", "w")).withColumn("w", r6(F.col("w")))


def _bank(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    rows = tilebank.bank(unit_lines(spark, sf_dir), names).select("y", "x", F.posexplode("xs").alias("feat", "v"))
    return rows.groupBy("y", "feat").agg(r6(F.sum("v")).alias("total"), r6(F.max("v")).alias("peak"), r6(F.sum(F.col("v") * (F.col("x") + 1))).alias("moment"))


@query()
def gabor(spark, sf_dir):
    return _bank(spark, sf_dir, ("gabor",))


@query(queries_features.sift_sql())
def sift(spark, sf_dir):
    return _bank(spark, sf_dir, ("sift",))


@query(queries_features.hog_compat_sql())
def hog_compat(spark, sf_dir):
    return _bank(spark, sf_dir, ("hog-compat",))


@query(queries_features.frangi_bank_sql())
def frangi_bank(spark, sf_dir):
    return _bank(spark, sf_dir, ("frangi",))


@query(queries_features.filterbank_sql())
def filterbank(spark, sf_dir):
    return _bank(spark, sf_dir, ("haar", "hog", "edge", "intensity-stencil-10"))


@query(queries_features.edge_compat_sql())
def edge_compat(spark, sf_dir):
    return _bank(spark, sf_dir, ("edge-compat",))


def fixed_model(levels: int = 1) -> cascade.Model:
    """A small cascade with weights from a fixed seed, for queries of inference alone."""
    params = classify.Params(groups=2, nodes=3)
    model = cascade.Model.create(2, levels, ("haar", "intensity-stencil-2"), ("intensity-stencil-1",), params=params)
    rng = np.random.default_rng(5)
    for key in model.order():
        sm = model[key]
        n = sm.features(levels)
        sm.weights, sm.off, sm.scale = rng.normal(0, 1 / math.sqrt(n), (2, 3, n + 1)), np.zeros(n), np.ones(n)
    return model


_CASCADE = queries_features.cascade_sql({key: sm.weights for key, sm in fixed_model().submodels.items()})


def _probabilities(out: DataFrame) -> DataFrame:
    return schema.to_pixels(out).select("y", "x", r6(F.col("v")).alias("v"))


@query(_CASCADE)
def cascade_test(spark, sf_dir):
    return _probabilities(cascade.test(unit_lines(spark, sf_dir), fixed_model()))


@query(_CASCADE)
def cascade_test_untiled(spark, sf_dir):
    return _probabilities(cascade.test_untiled(unit_lines(spark, sf_dir), fixed_model()))


_WANTED = [(1, 1), (3, 2), (0, 2), (1, 1), (9, 99)]


@query(f"SELECT y, x, CASE WHEN (x // 16, y // 32) IN ((1, 1), (3, 2), (0, 2)) THEN v ELSE 0.0 END AS v FROM ({_CASCADE}) AS whole")
def cascade_test_tiles(spark, sf_dir):
    """Inference on three tiles alone; one that is wanted twice and one that does not exist change nothing."""
    return _probabilities(cascade.test_tiles(unit_lines(spark, sf_dir), fixed_model(), _WANTED, (16, 32), ignore_bad=True))


@query(
    "WITH m AS (SELECT * FROM (VALUES (2, 1), (2, 3), (3, 2), (4, 1)) AS m(stages, levels)), s AS (SELECT *, unnest(range(1, stages + 1)) AS stage FROM m), "
    "o AS (SELECT *, unnest(range(0, CASE WHEN stage < stages THEN levels + 1 ELSE 1 END)) AS level FROM s), c AS (SELECT *, CASE WHEN stage = 1 OR level > 0 THEN level ELSE levels + 1 END AS contexts FROM o) "
    "SELECT stages, levels, CAST(row_number() OVER (PARTITION BY stages, levels ORDER BY stage, level) AS INTEGER) AS place, CAST(stage AS INTEGER) AS stage, CAST(level AS INTEGER) AS level, "
    "CAST(contexts AS INTEGER) AS contexts, CAST(2 + 36 + 9 * contexts AS INTEGER) AS features, CAST(2 + 36 AS INTEGER) AS normalized FROM c"
)
def model_order(spark, sf_dir):
    """The submodels of models in the order that they are learned in, and what comes into each."""
    rows = []
    for stages, levels in ((2, 1), (2, 3), (3, 2), (4, 1)):
        model = cascade.Model.create(stages, levels, ("haar", "hog"), ("intensity-square-1",))
        for place, key in enumerate(model.order(), 1):
            sm = model[key]
            rows.append((stages, levels, place, *key, sm.contexts(levels), sm.features(levels), int(sm.normalized(levels).sum())))
    return spark.createDataFrame(rows, "stages int, levels int, place int, stage int, level int, contexts int, features int, normalized int")


@query(
    "WITH t AS (SELECT unnest(range(2, 2000, 2)) AS t), b AS (SELECT unnest([1048576, 16777216, 268435456]) AS memory), "
    # features: haar and a square of radius 3, and a context of one pixel for each image below
    "w AS (SELECT t, max(8 * (t + 16) * (t + 16) + t * t * (16 * (51 + k) + 8 * (51 + k + n * (m + 1)))) AS bytes FROM t, (VALUES (0, 10, 20), (1, 24, 24), (2, 10, 20)) AS v(k, n, m) GROUP BY t) "
    "SELECT CAST(memory AS BIGINT) AS memory, CAST(max(t) AS INTEGER) AS tile FROM b JOIN w ON bytes <= memory GROUP BY memory"
)
def tile_plan(spark, sf_dir):
    """The tiles that tasks of some sizes can work on."""
    model = cascade.Model.create(2, 1, ("haar", "intensity-square-3"), ("intensity-square-0",))
    return spark.createDataFrame([(m, cascade.tile_for(model, m)) for m in (1 << 20, 1 << 24, 1 << 28)], "memory long, tile int")


@query()
def cascade_train(spark, sf_dir):
    """Learns to find bright pixels of the whole image, from all pixels, and returns the metrics of each level."""
    im = unit_lines(spark, sf_dir)
    labels = im.withColumn("px", F.transform("px", lambda v: (v > 0.6).cast("double")))
    model = cascade.Model.create(2, 1, ("haar", "intensity-stencil-2"), ("intensity-stencil-1",), params=classify.Params(groups=2, nodes=3, passes=2))
    _, _, log = cascade.train(im, labels, model, samples=None)
    rows = [(e["stage"], e["level"], e["tp"], e["tn"], e["fp"], e["fn"]) for e in log]
    return spark.createDataFrame(rows, "stage int, level int, tp long, tn long, fp long, fn long")

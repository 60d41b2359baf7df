import itertools
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import registry, schema
from gridloom.functions import pixel
from gridloom.operators import border, classify, grid, resample, sampling, stats, tilebank
from gridloom.plans import cascade
from gridloom.sources import raster

SF = "/root/testdata/sf0.001"


def image_of(lines, name="a"):
    return np.array([r["px"] for r in lines.filter(F.col("image_id") == name).orderBy("y").collect()])


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in ("embeddings", "events", "lineitem", "labels", "documents", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", ["downsample_bicubic", "pad_reflect", "maxpool_l3", "imresize_lanczos3", "haar", "norm_medianmad", "confusion_matrix", "padding_tiles", "ldnn_evaluate", "otsu_threshold", "subsample_per_class", "random_subset", "shuffled_places", "imresize_own_kernel", "haloed_region", "bounding_regions", "edge_compat", "model_order"])
def test_query_agrees_with_sql(spark, oracle, name):
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rel = oracle.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(show(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(show(r[c]) for c in cols) for r in got.collect()) == want


@pytest.mark.parametrize("shape", [(1, 1), (1, 4), (2, 2), (3, 5), (5, 3)])
@pytest.mark.parametrize("mode", ["edge", "symmetric", "constant", "reflect"])
def test_padding_as_numpy(spark, shape, mode):
    if mode == "reflect" and 1 in shape:
        pytest.skip("numpy reads the edge there too, by another rule")
    a = np.arange(1, shape[0] * shape[1] + 1, dtype=float).reshape(shape)
    got = image_of(border.pad(raster.from_arrays(spark, {"a": a}), ((4, 3), (2, 5)), mode))
    assert np.array_equal(got, np.pad(a, ((4, 3), (2, 5)), mode=mode))


def test_images_of_different_size_in_one_stack(spark):
    a, b = np.random.default_rng(1).random((3, 5)), np.random.default_rng(2).random((6, 2))
    lines = resample.max_pool(raster.from_arrays(spark, {"a": a, "b": b}), 1)
    assert np.array_equal(image_of(lines), [[a[y : y + 2, x : x + 2].max() for x in (0, 2, 4)] for y in (0, 2)])
    assert image_of(lines, "b").shape == (3, 1)
    up = image_of(resample.upsample(raster.from_arrays(spark, {"a": a}), 1))
    assert np.array_equal(up, np.kron(a, np.ones((2, 2))))


def test_halving_a_constant_keeps_it(spark):
    assert np.allclose(image_of(resample.halve(raster.from_arrays(spark, {"a": np.full((5, 3), 0.25)}))), 0.25)


def test_correlation_of_an_impulse_shows_the_kernel_reversed(spark):
    a = np.zeros((7, 7))
    a[3, 3] = 1
    got = image_of(resample.correlate(raster.from_arrays(spark, {"a": a}), (1.0, 2.0, 3.0), (1.0, 10.0, 100.0), "symmetric"))
    assert np.array_equal(got[2:5, 2:5], np.outer([100, 10, 1], [3, 2, 1]))


def test_output_cast_is_half_even(spark):
    v = spark.createDataFrame([(0.5 / 255,), (1.5 / 255,), (2.5 / 255,), (1.0,)], "v double")
    assert [r[0] for r in v.select(pixel.output_cast(F.col("v"), "u8")).collect()] == [0, 2, 2, 255]
    assert raster.as_double(np.array([[-128, 127]], np.int8)).tolist() == [[0.0, 1.0]]


def test_metrics_of_empty_classes(spark):
    none = spark.createDataFrame([], "pred boolean, gt boolean")
    r = stats.confusion(none).select(stats.accuracy().alias("a"), stats.f_value().alias("f"), stats.g_mean().alias("g")).first()
    assert tuple(r) == (1.0, 1.0, 1.0)


def test_files_round_trip(spark, tmp_path):
    a = np.random.default_rng(3).random((4, 6))
    for name, dtype in (("a.pgm", "u8"), ("b.npy", "f64")):
        (tmp_path / name).write_bytes(raster.encode(a, dtype))
    got = raster.read_images(spark, str(tmp_path))
    assert np.abs(image_of(got, "a.pgm") - a).max() <= 0.5 / 255 + 1e-9
    assert np.array_equal(image_of(got, "b.npy"), a)


@pytest.mark.parametrize("name", ["haar", "hog", "hog-compat", "edge", "gabor", "sift", "frangi", "intensity-stencil-3"])
def test_features_do_not_depend_on_tiles(spark, name):
    a = np.random.default_rng(4).random((21, 19))
    lines = raster.from_arrays(spark, {"a": a})
    one, many = ({(r["y"], r["x"]): r["xs"] for r in tilebank.bank(lines, (name,), t).collect()} for t in (64, 8))
    assert one.keys() == many.keys() and len(one) == a.size
    assert max(np.abs(np.array(one[k]) - many[k]).max() for k in one) < 1e-9
    assert len(next(iter(one.values()))) == tilebank.count((name,))


def test_default_widths():
    assert tilebank.count(tilebank.DEFAULT) == 476 and tilebank.count(tilebank.DEFAULT_CONTEXT) == 57
    assert tilebank.parse("-hog,edge") == tuple(n for n in tilebank.DEFAULT if n not in ("hog", "edge"))
    with pytest.raises(ValueError):
        tilebank.parse("nothing")


def test_gabor_of_an_impulse(spark):
    p = np.zeros((45, 45))
    p[22, 22] = 1
    got = tilebank.gabor(p, {})
    k = tilebank.gabor_kernels()
    want = np.hypot(np.pad(k[0], 18)[:], np.pad(k[1], 18))
    c = want.shape[0] // 2
    assert np.allclose(got[0], want[c - 4 : c + 5, c - 4 : c + 5])


def test_constant_images_have_finite_features():
    for name, (halo, n, _, f) in tilebank.FILTERS.items():
        out = f(np.zeros((4 + 2 * halo, 3 + 2 * halo)), {"smooth": 0.0, "smooth_zero": 0.0, "ridges": [0.0] * 14, "beyond": (halo,) * 4})
        assert out.shape == (n, 4, 3) and np.isfinite(out).all(), name


def test_groups_share_all_tiles():
    for groups in (2, 3, 5, 8, 40, 60):
        got = [t for g in range(1, groups + 1) for t in grid.tiles_for_group(g, groups, 500, 300, (64, 64))]
        assert sorted(got) == [(x, y) for x in range(5) for y in range(8)]
    # no choice of bands costs less than the one that the cuts before each group lead to
    ny, nx, groups = 9, 7, 8
    every = [(0, *c, groups) for n in range(groups) for c in itertools.combinations(range(1, groups), n)]
    least = min(sum(grid.sharing(grid.band(a, b, ny, nx, groups), ny, nx, groups) for a, b in zip(c, c[1:])) for c in every)
    assert grid.sharing(grid.arrangement(ny, nx, groups), ny, nx, groups) == least
    with pytest.raises(ValueError):
        grid.tile_size(100, 4)


def test_kmeans_finds_separated_points(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.05, (30, 2)) for c in (0, 5, 9)])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample long, xs array<double>")
    centres, error = classify.kmeans_ml(rows, 3, 2)
    got = sorted(round(r["c"][0]) for r in centres.collect())
    assert error < 30 and len(got) == 3
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(4)] + [(4, [2.0, 2.0])], "sample long, xs array<double>")
    start = spark.createDataFrame([(0, [1.0, 1.0]), (1, [9.0, 9.0])], "j int, c array<double>")
    new, _ = classify.kmeans_step(same, start, 2)
    assert sorted(r["c"] for r in new.collect()) == [[1.0, 1.0], [2.0, 2.0]]  # the empty cluster took the farthest sample


def test_descent_lowers_the_error_and_repeats():
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(0, 1, (400, 3)), np.ones(400)])
    y = x[:, 0] + x[:, 1] > 0
    p = classify.Params(groups=2, nodes=2, passes=20, rate=0.01, batch=10)
    w, errors = classify.descend(rng.normal(0, 1, (2, 2, 4)), x, y, p)
    assert errors[-1] < errors[0] and np.array_equal(w, classify.descend(w * 0 + w, x[:0], y[:0], p)[0])
    assert np.isfinite(classify.np_forward(w * 1e6, x)[2]).all()


def test_distributed_gradient_as_numpy(spark):
    rng = np.random.default_rng(8)
    x, y, w = rng.normal(0, 1, (20, 3)), rng.random(20) > 0.5, rng.normal(0, 1, (2, 3, 4))
    rows = spark.createDataFrame([(i, v.tolist(), bool(b)) for i, (v, b) in enumerate(zip(x, y))], "sample long, xs array<double>, label boolean")
    got = {(r["i"], r["j"]): r["grad"] for r in classify.gradient(rows, classify.weights_frame(spark, w), 3).collect()}
    one = np.column_stack([x, np.ones(20)])
    loss = lambda v: ((classify.np_forward(v, one)[2] - np.where(y, 0.9, 0.1)) ** 2).sum()
    for i, j, k in ((0, 0, 0), (1, 2, 3)):
        e = np.zeros_like(w)
        e[i, j, k] = 1e-6
        assert math.isclose(got[i, j][k], (loss(w + e) - loss(w - e)) / 2e-6, rel_tol=1e-4, abs_tol=1e-7)


def test_sampling(spark):
    rows = spark.range(5000).select(F.col("id").alias("sample"), (F.col("id") % 10 == 0).alias("label"))
    got = sampling.subsample(rows, 300, 1, "label", "sample").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {True: 300, False: 300}
    with pytest.raises(ValueError):
        sampling.every(rows, 10, 9999, "label", "sample")
    assert sampling.every(rows, 10, 10, "label", "sample").count() == 50


def test_model_settings_restart_and_storage(spark, tmp_path):
    m = cascade.Model.create(3, 2, ("haar",))
    assert m.order() == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 0)]
    assert m[2, 0].contexts(2) == 3 and m[2, 1].contexts(2) == 1 and m[-1, 0].stage == 3
    with pytest.raises(ValueError):
        cascade.Model.create(1, 1)
    for key in ((1, 0), (1, 1)):
        n = m[key].features(2)
        m[key].weights, m[key].off, m[key].scale = np.ones((1, 2, n + 1)), np.zeros(n), np.ones(n)
    m.save(spark, f"{tmp_path}/m")
    back = cascade.Model.load(spark, f"{tmp_path}/m")
    assert back[1, 1].learned and not back[1, 2].learned and back[1, 0].params == m[1, 0].params
    fresh = cascade.Model.create(3, 2, ("haar",)).restarted(back)
    assert fresh[1, 1].learned and not fresh[2, 0].learned


def test_three_stages_train_and_test_on_an_odd_image(spark):
    a = np.random.default_rng(9).random((13, 10))
    im = raster.from_arrays(spark, {"a": a})
    truth = raster.from_arrays(spark, {"a": (a > 0.9).astype(float)})
    p = classify.Params(groups=1, nodes=1, passes=1, downsample=2, batch=10)
    m = cascade.Model.create(3, 1, ("haar",), ("intensity-square-0",), params=p)
    m, out, log = cascade.train(im, truth, m, samples=None)
    assert [(e["stage"], e["level"]) for e in log] == [(1, 0), (1, 1), (2, 0), (2, 1), (3, 0)]
    again = image_of(cascade.test(im, m))
    assert again.shape == a.shape and np.allclose(again, image_of(out))


def test_wanted_tiles_as_of_the_whole_images(spark):
    """Only a part of the image is read, and what the tiles hold does not change; images may differ in size."""
    from gridloom.plans import queries_learning

    rng = np.random.default_rng(4)
    im = raster.from_arrays(spark, {"a": rng.random((150, 90)), "b": rng.random((20, 9))})
    model = queries_learning.fixed_model()
    whole = cascade.test(im, model)
    some = cascade.test_tiles(im, model, [(5, 0), (0, 1), (77, 0)], 16, ignore_bad=True)
    for name in "ab":
        want, got = image_of(whole, name), image_of(some, name)
        inside = np.zeros(want.shape, bool)
        inside[:16, 80:96] = inside[16:32, :16] = True
        assert np.allclose(got, np.where(inside, want, 0.0))
    assert 0 < cascade.reach(model) < 150 - 32
    assert np.allclose(image_of(cascade.test_untiled(im, model), "b"), image_of(whole, "b"))
    assert not image_of(cascade.test_tiles(im, model, [(77, 0)], 16, ignore_bad=True)).any()
    assert cascade.test_tiles(im.filter("false"), model, [(0, 0)], 16).count() == 0
    with pytest.raises(ValueError):
        cascade.test_tiles(im, model, [(77, 0)], 16)


def test_commands(spark, tmp_path):
    from gridloom import __main__ as shell
    from gridloom.plans import queries_learning

    im = np.random.default_rng(6).random((12, 10))
    for folder, image in (("images", im), ("labels", (im > 0.5).astype(float))):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.npy").write_bytes(raster.encode(image, "f64"))
    model = queries_learning.fixed_model()
    model.save(spark, f"{tmp_path}/model")
    out = shell.main(["test", f"{tmp_path}/model", f"{tmp_path}/images", f"{tmp_path}/out"])
    assert np.allclose(image_of(out, "a.npy"), image_of(cascade.test(raster.from_arrays(spark, {"a": im}), model)))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 12
    some = image_of(shell.main(["test", f"{tmp_path}/model", f"{tmp_path}/images", f"{tmp_path}/some", "--tiles", "0,0 1,0", "--tile", "4"]), "a.npy")
    assert np.allclose(some[:4, :8], image_of(out, "a.npy")[:4, :8]) and not some[4:].any() and not some[:, 8:].any()
    r = shell.main(["perf", f"{tmp_path}/labels", f"{tmp_path}/labels"]).first()
    assert (r["tp"] + r["tn"], r["fp"], r["fn"], r["accuracy"]) == (120, 0, 0, 1.0)
    assert [x["kind"] for x in shell.main(["model", f"{tmp_path}/model"]).collect()] == ["ldnn"] * 3
    args = shell.parser().parse_args(["train", "m", "i", "l", "--stages", "3", "--filters", "haar"])
    assert (args.stages, args.filters, args.samples, args.restart) == (3, "haar", 3_000_000, False)


def test_random_subset_of_repeated_keys(spark):
    rows = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    assert sampling.random_subset(rows, 120, 1, "k").count() == 120
    assert sampling.random_subset(rows, 0, 1, "k").count() == 0 and sampling.random_subset(rows, 999, 1, "k").count() == 300
    assert [r[0] for r in sampling.places(rows, 1, "k", "id").select("place").orderBy("place").collect()] == list(range(1, 301))


def test_cascade_trains_on_the_whole_table(spark, tmp_path, monkeypatch):
    from gridloom.plans import queries_learning

    rows = [(i, [float((i * 7 + k * 3) % 11) for k in range(64)], i % 10) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = {}

    def train(im, labels, model, samples=3_000_000, **more):
        seen.update(image=im.count(), labels=labels.count(), samples=samples)
        return model, im, [{"stage": 1, "level": 0, "tp": 1, "tn": 2, "fp": 3, "fn": 4}]

    monkeypatch.setattr(cascade, "train", train)
    queries_learning.QUERIES["cascade_train"](spark, str(tmp_path)).collect()
    assert seen == {"image": 80, "labels": 80, "samples": None}


def test_rows_of_a_file_as_in_memory(tmp_path):
    x = np.random.default_rng(3).normal(size=(50, 4))
    with open(tmp_path / "x", "w+b") as f:
        f.write(x.tobytes())
        f.flush()
        rows = classify.FileRows(f.fileno(), 50, 4)
        assert len(rows) == 50 and np.array_equal(rows[np.array([7, 0, 49])], x[[7, 0, 49]])


def test_entry_module_has_every_oracle_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert schema.LEVEL_DTYPES["u8"] == 255.0


@pytest.mark.parametrize("accuracy", [100_000, 50])
def test_percentiles_are_exact_within_sketched_bounds(spark, monkeypatch, accuracy):
    monkeypatch.setattr(stats, "ACCURACY", accuracy)
    rng = np.random.default_rng(2)
    values = {None: rng.normal(size=3000), "a": np.repeat([1.0, 2.0], [1500, 1500]), "b": rng.integers(0, 9, 2000).astype(float), "c": np.array([4.0])}
    rows = [(k, float(v)) for k, x in values.items() for v in x] + [("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    qs = [0.0, 0.05, 0.5, 0.731, 1.0]
    got = {r.k: r[1:] for r in stats.percentiles(df, qs, "k").collect()}
    assert got.keys() == values.keys()
    for k, x in values.items():
        assert np.allclose(got[k], np.quantile(x, qs), rtol=1e-12, atol=1e-12), k
    flat = stats.percentiles(df, qs)
    assert np.allclose(flat.first(), np.quantile(np.concatenate([*values.values()]), qs))
    assert " percentile(" not in flat._jdf.queryExecution().optimizedPlan().toString()
    assert stats.percentiles(df.filter("false"), qs, "k").count() == 0


def test_compat_borders_are_zero(spark):
    """In tiles as over the whole image: gradients meet zeros beyond the border, and their magnitudes are mirrored there."""
    rng = np.random.default_rng(9)
    im = rng.random((21, 37))
    lines = spark.createDataFrame([("a", y, row.tolist()) for y, row in enumerate(im)], "image_id string, y int, px array<double>")

    def features_of(name, tile):
        rows = tilebank.bank(lines, (name,), tile).collect()
        out = np.zeros((21, 37, len(rows[0].xs)))
        for r in rows:
            out[r.y, r.x] = r.xs
        return out

    g, d = tilebank.features.gauss_pair()
    wide = np.pad(im, 3)
    mag = np.hypot(*(tilebank.correlate(tilebank.correlate(wide, a, 0), b, 1) for a, b in ((g, d), (d, g))))
    want = np.moveaxis(tilebank.shifted(np.pad(mag, 3, mode="symmetric"), tilebank.features.square(3), 3), 0, -1)
    for tile in (8, 64):
        assert np.allclose(features_of("edge-compat", tile), want)
    assert not np.allclose(features_of("edge", 64), want)
    # over zeros all around, a mirrored and a zero border are the same
    small, whole = np.zeros((40, 40)), np.zeros((70, 70))
    small[17:23, 17:23] = im[:6, :6]
    whole[15:-15, 15:-15] = small
    top = float(tilebank.smoothed(whole).max())
    got = tilebank.sift(whole, {"smooth": top, "smooth_zero": top, "beyond": (15, 15, 15, 15)}, True)
    assert np.allclose(got, tilebank.sift(whole, {"smooth": top, "smooth_zero": top, "beyond": (0, 0, 0, 0)}, True))
    assert np.allclose(features_of("sift-compat", 8), features_of("sift-compat", 64))


def test_changed_settings_are_learned_anew(spark, tmp_path):
    old = cascade.Model.create(2, 1, ("haar",), params=classify.Params(groups=2, rate=1e-05, dropout=True))
    for key in old.order():
        sm = old[key]
        n = sm.features(1)
        sm.weights, sm.off, sm.scale = np.ones((2, 20, n + 1)), np.zeros(n), np.ones(n)
    old.save(spark, f"{tmp_path}/model")
    again = cascade.Model.load(spark, f"{tmp_path}/model")
    assert {k: m.params for k, m in again.submodels.items()} == {k: m.params for k, m in old.submodels.items()}
    same = cascade.Model.create(2, 1, ("haar",), params=classify.Params(groups=2, rate=1e-05, dropout=True)).restarted(again)
    assert all(m.learned for m in same.submodels.values())
    other = cascade.Model.create(2, 1, ("haar",), params=classify.Params(groups=2, rate=1e-04, dropout=True)).restarted(again)
    assert not any(m.learned for m in other.submodels.values())


def test_descent_with_dropout_and_single_samples_learns(spark):
    """The forms that levels above 0 use: half of the groups and nodes a step, one sample a step."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    rows = spark.createDataFrame([(i, v.tolist(), bool(v[0] * v[1] > 0)) for i, v in enumerate(x)], "sample long, xs array<double>, label boolean")
    for p in (classify.Params(4, 4, True, 1, 8, 0.025), classify.Params(4, 4, False, 1, 8, 0.025), classify.Params(4, 4, False, 100, 30, 0.02)):
        weights, errors = classify.train(rows, p, 2)
        assert errors[-1] < errors[0], p
        w = classify.weights_array(weights)
        f = classify.np_forward(w, np.column_stack([x, np.ones(len(x))]), p.dropout)[2]
        assert ((f > 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.8, p


def test_classes_of_repeated_keys_keep_their_rows(spark):
    df = spark.range(9000).select(F.when(F.col("id") < 6000, 1).otherwise(F.col("id")).alias("k"), (F.col("id") < 6000).alias("label"))
    got = {r.label: r["count"] for r in sampling.per_class(df, 20, 1, "label", "k").groupBy("label").count().collect()}
    assert got == {True: 20, False: 20}


@pytest.mark.parametrize("k, odd", [(4, False), (5, True)])
def test_clusters_in_one_task_are_those_of_many(spark, monkeypatch, k, odd):
    x = np.random.default_rng(4).normal(0, 1, (170, 3)).round(1)
    if odd:
        x[:] = x[0]  # fewer distinct samples than clusters
        x[80:] += 1
    rows = spark.createDataFrame([(i * 7, v.tolist()) for i, v in enumerate(x)], "sample long, xs array<double>").persist()
    centres, error = classify.kmeans_ml(rows, k, 3, 1, 4)
    one = np.array([r["c"] for r in centres.orderBy("j").collect()])
    monkeypatch.setattr(classify, "CLUSTERED", 0)
    centres, other = classify.kmeans_ml(rows, k, 3, 1, 4)
    assert np.allclose(one, np.array([r["c"] for r in centres.orderBy("j").collect()])) and np.isclose(error, other)


def test_untiled_images_beyond_a_tasks_memory_are_cut(spark, monkeypatch):
    from gridloom.plans import queries_learning

    model, seen, bank = queries_learning.fixed_model(), [], tilebank.bank
    im = raster.from_arrays(spark, {"a": np.random.default_rng(3).random((50, 6))})
    want = image_of(cascade.test(im, model, 50))
    monkeypatch.setattr(tilebank, "bank", lambda lines, names, tile, **more: (seen.append(tile), bank(lines, names, tile, **more))[1])
    monkeypatch.setattr(cascade, "UNTILED", cascade.tile_bytes(model, 16))
    assert np.allclose(image_of(cascade.test_untiled(im, model)), want) and set(seen) == {16}


def test_training_in_one_task_is_that_of_jobs(spark, monkeypatch):
    x = np.random.default_rng(8).normal(0, 1, (300, 4))
    rows = [(i * 3, v.tolist(), bool(v[0] > 0.2) if i % 50 else None) for i, v in enumerate(x)]
    rows = spark.createDataFrame(rows, "sample long, xs array<double>, label boolean").persist()
    rows.count()
    p = classify.Params(groups=2, nodes=3, passes=2, batch=20, repeats=2)
    spark.sparkContext.setJobGroup("train", "train")
    one, errors = classify.trained(rows, p, 4)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("train"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 8  # the driver plans and keeps every job
    monkeypatch.setattr(classify, "CLUSTERED", 0)
    many, others = classify.trained(rows, p, 4)
    assert np.allclose(one, many) and np.allclose(errors, others)
    with pytest.raises(ValueError):
        classify.trained(rows.filter("label"), p, 4)


def test_training_takes_few_jobs_however_large_its_classes(spark, monkeypatch):
    x = np.random.default_rng(9).normal(0, 1, (300, 4))
    rows = spark.createDataFrame([(i * 3, v.tolist(), bool(v[0] > 0.2)) for i, v in enumerate(x)], "sample long, xs array<double>, label boolean").persist()
    p = classify.Params(groups=2, nodes=3, passes=2, batch=20)
    want, _ = classify.trained(rows, p, 4)
    monkeypatch.setattr(classify, "CLUSTERED", 100)  # less than what is clustered of a class
    monkeypatch.setattr(classify, "EVALUATED", 0)
    monkeypatch.setattr(classify, "TAKEN", 7)
    spark.sparkContext.setJobGroup("large", "large")
    got, _ = classify.trained(rows, p, 4)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("large"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 8 and np.allclose(got, want)


def test_percentiles_of_arrays_are_those_of_rows(spark):
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(0, 1, 90), rng.integers(0, 2, 90) - 0.5, np.where(rng.random(90) < 0.6, -0.0, 0.0), rng.integers(-3, 3, 90), 1e-300 * rng.normal(0, 1, 90)])
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "xs array<double>").repartition(3)
    use = np.array([True, True, True, True, False])
    for method in ("median-mad", "iqr", "mean-std"):
        off, scale = stats.fit_arrays(rows, method, use)
        want = {r["feat"]: r for r in stats.fit(rows.select(F.posexplode("xs").alias("feat", "v")), method, "feat").collect()}
        assert np.allclose(off, [want[k]["off"] if use[k] else 0 for k in range(5)], 1e-14, 0)
        assert np.allclose(scale, [want[k]["scale"] if use[k] else 1 for k in range(5)], 1e-14, 0)
    assert [v.tolist() for v in stats.fit_arrays(rows.limit(0), "median-mad", use)] == [[0.0] * 5, [1.0] * 5]


def test_a_submodel_is_trained_in_few_jobs(spark):
    rng = np.random.default_rng(2)
    im = spark.createDataFrame([("a", y, rng.random(8).tolist()) for y in range(8)], "image_id string, y int, px array<double>")
    labels = im.withColumn("px", F.transform("px", lambda v: (v > 0.85).cast("double")))
    model = cascade.Model.create(2, 1, ("intensity-stencil-1",), ("intensity-stencil-1",), params=classify.Params(groups=2, nodes=2, passes=1))
    spark.sparkContext.setJobGroup("cascade", "cascade")
    _, _, log = cascade.train(im, labels, model, samples=None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("cascade"))
    spark.sparkContext.setJobGroup("", "")
    assert len(log) == 3 and all(e["tp"] + e["tn"] + e["fp"] + e["fn"] in (64, 16) for e in log)
    assert jobs <= 120, jobs  # the driver plans and keeps every job

"""python -m gridloom test | train | perf | model: the cascade from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import schema
from gridloom.operators import resample, stats, tilebank
from gridloom.plans import cascade
from gridloom.sources import raster


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gridloom")
    sub = p.add_subparsers(dest="command", required=True)
    test = sub.add_parser("test", help="probabilities of images")
    test.add_argument("model")
    test.add_argument("images", help="a folder of images")
    test.add_argument("output", help="a folder, with a Parquet folder for each image")
    test.add_argument("--tile", type=int, default=512, help="edge of the tiles that --tiles counts")
    test.add_argument("--tiles", help="x,y pairs of wanted tiles, split by blanks")
    test.add_argument("--ignore-bad-tiles", action="store_true")
    train = sub.add_parser("train", help="learn a model")
    for name in ("model", "images", "labels"):
        train.add_argument(name)
    train.add_argument("--masks")
    train.add_argument("--output")
    train.add_argument("--stages", type=int, default=2)
    train.add_argument("--levels", type=int, default=4)
    train.add_argument("--filters", default=",".join(tilebank.DEFAULT))
    train.add_argument("--context-filters", default=",".join(tilebank.DEFAULT_CONTEXT))
    train.add_argument("--normalization", default="median-mad", choices=("none", "min-max", "mean-std", "median-mad", "iqr"))
    train.add_argument("--samples", type=int, default=3_000_000, help="0: all")
    train.add_argument("--restart", action="store_true", help="keep what the model has learned with the same settings")
    perf = sub.add_parser("perf", help="compare predictions with the truth")
    for name in ("predictions", "labels"):
        perf.add_argument(name)
    perf.add_argument("--masks")
    model = sub.add_parser("model", help="show a model")
    model.add_argument("model")
    return p


def truth(spark: SparkSession, path: str) -> DataFrame:
    return raster.read_images(spark, path).withColumn("px", F.transform("px", lambda v: (v > 0).cast("double")))


def judged(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Predictions are cut at their own threshold; images pair up by their names."""
    at = ["image_id", "y", "x"]
    pred = resample.ensure_binary(schema.to_pixels(raster.read_images(spark, args.predictions))).select(*at, F.col("v").alias("pred"))
    both = pred.join(schema.to_pixels(truth(spark, args.labels)).select(*at, (F.col("v") > 0).alias("gt")), at)
    if args.masks:
        both = both.join(schema.to_pixels(truth(spark, args.masks)).select(*at, (F.col("v") > 0).alias("mask")), at)
    return stats.confusion(both).select("*", stats.accuracy().alias("accuracy"), stats.f_value().alias("f_value"), stats.g_mean().alias("g_mean"))


def main(argv: list[str] | None = None) -> DataFrame:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("gridloom").getOrCreate()
    if args.command == "test":
        im, model = raster.read_images(spark, args.images), cascade.Model.load(spark, args.model)
        wanted = [tuple(int(v) for v in t.split(",")) for t in args.tiles.split()] if args.tiles else None
        out = cascade.test(im, model) if wanted is None else cascade.test_tiles(im, model, wanted, args.tile, args.ignore_bad_tiles)
        raster.write_images(out, args.output)
        return out
    if args.command == "train":
        filters, context = tilebank.parse(args.filters), tilebank.parse(args.context_filters, tilebank.DEFAULT_CONTEXT)
        model = cascade.Model.create(args.stages, args.levels, filters, context, args.normalization)
        if args.restart:
            model = model.restarted(cascade.Model.load(spark, args.model))
        masks = truth(spark, args.masks) if args.masks else None
        model, out, log = cascade.train(raster.read_images(spark, args.images), truth(spark, args.labels), model, args.samples or None, masks, path=args.model)
        if args.output:
            raster.write_images(out, args.output)
        got = spark.createDataFrame([(e["stage"], e["level"], e["accuracy"], e["f_value"], e["g_mean"]) for e in log], "stage int, level int, accuracy double, f_value double, g_mean double")
    elif args.command == "perf":
        got = judged(spark, args)
    else:
        got = cascade.Model.load(spark, args.model).frame(spark).select("stage", "level", "kind", "filters", "context_filters", "method", "params", "shape").orderBy("stage", "level")
    got.show(truncate=False)
    return got


if __name__ == "__main__":
    main()

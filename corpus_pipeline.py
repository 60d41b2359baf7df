"""A training-data pipeline over documents: five stages, each written as Parquet and read again by the next.

1. The quality classifier rejects documents that score below its threshold. Known labels are never rejected or kept as such;
   they only train it.
2. Of near-duplicates (words in fives, similarity 0.8 or more) the document with the smallest id stays.
3. Bytes of strings of repeats.STAGE_LENGTH bytes (some 50 words) that start more than once in what is left go; a document of
   which nothing is left stays, empty.
4. Sources are mixed to target weights: a document comes out as often as it is taken, or not at all.
5. What was taken is packed; the result has a row for each piece of a document in a sequence.

Nulls: a null text counts as empty, a null id draws and packs like any other row, a null source is a source. An empty table
gives an empty result. Other columns than those of documents are carried along up to the last stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import _base, mixing, near, packing, quality, repeats


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, quality.train(docs, _base.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = repeats.cut(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained scores, sketches and packing have no SQL; the tests compare each stage with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents."""
    docs = _base.table(spark, sf_dir, "documents")
    at = f"{_base.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        mark = _base.written()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{i}-{name}")
        _base.drop_since(mark)
        docs = spark.read.schema(out.schema).parquet(f"{at}/{i}-{name}")
    return docs

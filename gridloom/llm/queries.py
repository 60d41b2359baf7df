"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import _base, ann, exact, hmm, mixing, near, packing, quality, repeats, sharding, toxicity


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_base.table(spark, sf_dir, "documents"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_base.table(spark, sf_dir, "embeddings"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.search(_base.table(spark, sf_dir, "embeddings"))


def op10_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_base.table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_base.table(spark, sf_dir, "documents"), _base.table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(_base.table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_base.table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_bytes(_base.table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_base.table(spark, sf_dir, "documents"), _base.table(spark, sf_dir, "labels"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_base.table(spark, sf_dir, "documents"), text=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_ann": op2_ann, "op3_toxicity": op3_toxicity, "op4_exact_topk": op4_exact_topk, "op5_mixing": op5_mixing, "op6_minhash": op6_minhash, "op7_sharding": op7_sharding, "op8_quality": op8_quality, "op9_suffix_dedup": op9_suffix_dedup, "op10_hmm": op10_hmm}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_topk": exact.SQL, "op5_mixing": mixing.SQL}

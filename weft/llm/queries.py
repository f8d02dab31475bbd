"""The corpus operators as queries over the test tables: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import ann, htmltext, langid, mixing, oracles, packing, pii, quality, sharding, simhash, suffix
from weft.llm.common import table


#: Used on the synthetic test tables, which hold nobody's data, where the session sets no key.
TEST_KEY = b"key of the synthetic test tables"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op1(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op2(table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op3(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op4(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.op6(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op7(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op8(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(pii.KEY_SETTING, "").encode() or TEST_KEY
    return pii.op9(table(spark, sf_dir, "documents"), key)


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.op10(table(spark, sf_dir, "documents"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix does without coins: sizes, and each source's target."""
    return mixing.op7(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law of the shards, in one row."""
    per = sharding.op8(table(spark, sf_dir, "documents")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"))
    near = F.max("bytes") <= 1.05 * F.sum("bytes") / F.count(F.lit(1))
    gapless = F.every((F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n")))
    return per.agg(F.sum("n").alias("docs"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("shards"), near.alias("near_equal"), gapless.alias("gapless"))


def exact_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours with every list probed."""
    found = ann.search(ann.valid(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), F.col("vec_id") % 50 == 0, every_list=True)
    return found.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    main = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return main | {f.__name__: f for f in (mix_targets, shard_balance, exact_neighbours)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_quality_rules": oracles.quality_rules(),
        "op6_html_text": oracles.MAIN_TEXT,
        "op10_repeated_passages": oracles.REPEATED_PASSAGES,
        "mix_targets": oracles.MIX_TARGETS,
        "shard_balance": oracles.SHARD_BALANCE,
        "exact_neighbours": oracles.EXACT_NEIGHBOURS,
    }

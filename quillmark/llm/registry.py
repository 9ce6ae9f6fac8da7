"""The queries of this package, one per operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, chat, decontaminate, fingerprint, lengths, lm, minhash, mixing, oracles, pii, repair, sharding, toxicity, warc
from .common import read_table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(read_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(read_table(spark, sf_dir, "documents"), key="surrogate-key-1")


def op4_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_lengths(read_table(spark, sf_dir, "documents"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model_scores(read_table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("filter")


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(read_table(spark, sf_dir, "conversations"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(read_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_fingerprint, op2_mixing, op3_pii, op4_lengths, op5_lm, op6_minhash, op7_toxicity, op8_sharding, op9_decontaminate, op10_warc, op11_filter_audit, op12_chat, op13_repair, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": oracles.OP2, "op6_minhash": oracles.OP6, "op8_sharding": oracles.OP8, "op9_decontaminate": oracles.OP9, "op10_warc": oracles.OP10, "op11_filter_audit": oracles.OP11, "op12_chat": oracles.OP12, "op13_repair": oracles.OP13}

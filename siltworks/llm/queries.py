"""The thin queries over the driver's tables; each takes its rows from one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import balance, chunks, decontaminate, infill, langid, minhash, packing, quality, reputation, search, secrets, suffixes, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.report(_table(spark, sf_dir, "documents"))


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.report(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op5_bit_plane_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_table(spark, sf_dir, "documents"))


def op6_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op7_suffix_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_weak_supervision_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"))


def op11_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.report(_table(spark, sf_dir, "documents"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.report(_table(spark, sf_dir, "documents"))


_ALL = (
    op1_minhash_near_dedup,
    op2_chunk_dedup,
    op3_winnowing_decontamination,
    op4_host_reputation,
    op5_bit_plane_token_ids,
    op6_best_two_fit_packing,
    op7_suffix_index_dedup,
    op8_secret_scan,
    op9_language_id,
    op10_weak_supervision_quality,
    op11_cost_balanced_packing,
    op12_ranked_lexical_search,
    op13_fill_in_middle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op4_host_reputation": reputation.ORACLE_SQL, "op10_weak_supervision_quality": quality.ORACLE_SQL, "op12_ranked_lexical_search": search.ORACLE_SQL, "op13_fill_in_middle": infill.ORACLE_SQL}

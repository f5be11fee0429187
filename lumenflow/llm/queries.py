"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm import op1_wavelet, op2_mixing, op3_toxicity, op4_line_chunks, op5_grid_order, op6_packing, op7_multi_index, op8_shingle_join, op9_private_data, op10_url_filter


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_wavelet.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mixing.mix(table(spark, sf_dir, "documents"), op2_mixing.source_domain(F.col("source")))


def op3_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_toxicity.score_table(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op4_line_chunks.dedup_runs(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_chunks", "n_removed", "n_removed_lines")


def op5_grid_order_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_grid_order.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_multi_index.search(table(spark, sf_dir, "embeddings"))


def op8_shingle_join_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_shingle_join.near_duplicates(table(spark, sf_dir, "documents"), 3, 90)


def op9_private_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_private_data.find_private_data(table(spark, sf_dir, "documents"))


def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return op10_url_filter.judge(pages, op10_url_filter.tracked(pages))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_wavelet_tokens, op2_budget_mix, op3_toxicity_cnn, op4_line_dedup, op5_grid_order_join, op6_curve_packing, op7_multi_index_search, op8_shingle_join_classes, op9_private_spans, op10_url_verdicts)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_budget_mix": op2_mixing.ORACLE, "op5_grid_order_join": op5_grid_order.ORACLE, "op8_shingle_join_classes": op8_shingle_join.ORACLE, "op10_url_verdicts": op10_url_filter.ORACLE}

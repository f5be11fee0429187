"""The corpus pipeline: stages that each call one operator, written as Parquet and read again between them.

documents -> toxic ones go -> repeated passages go -> one document of each group of near duplicates stays -> sources are mixed
to target weights -> the rest is packed into sequences. Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm import op2_mixing, op3_toxicity, op4_line_chunks, op6_packing, op8_shingle_join
from lumenflow.llm.common import stage
from lumenflow.llm.queries import table, tokenizer

#: Share of the tokens of stage 4's input that the mix may use.
SHARE = 0.8


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language; the classifier learns from labels that aren't held out."""
    model = op3_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return op3_toxicity.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the passages that an earlier one has; n_chars is that of the text that is left."""
    return op4_line_chunks.dedup_runs(docs, own_columns=True).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row, that of the smallest doc_id, of each group that links of 0.8 on five-word shingles connect.

    Rows, not ids, go: rows that share a doc_id are judged by their own texts, and repeated rows become one. A null doc_id comes after
    all others. Texts that are null or hold no word link with nothing and stay.
    """
    return op8_shingle_join.one_of_each(docs, 5, 80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each at most once; one at a leaf's cut keeps its first words."""
    out = op2_mixing.mixed_documents(docs, op2_mixing.source_domain(F.col("source")), SHARE)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens along the curve."""
    return op6_packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: A trained classifier and a tokenizer can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.bpe import encode_documents
from snapledger.llm.common import stage, table
from snapledger.llm.line_runs import drop_common_lines
from snapledger.llm.mgo_join import jaccard_components
from snapledger.llm.mixing import mix
from snapledger.llm.quality import judge
from snapledger.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    judged = judge(docs, table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share; ``n_chars`` follows the new text."""
    kept = drop_common_lines(docs).drop("n_lines", "n_dropped")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast("bigint"))
    return kept.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; documents without shingles or id stay."""
    copies = jaccard_components(docs).filter("doc_id <> component_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture reads them."""
    return mix(docs).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text; ``round_trip`` says whether they decode to the text again."""
    coded = encode_documents(docs.select("doc_id", "source", "lang", "text"))
    return coded.select(
        "doc_id", "source", "lang", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("token_ids", token_ids)]

#: Byte-pair encoding has no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES:
        docs = stage(stage_of(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

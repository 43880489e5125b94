"""From raw documents to packed training sequences.

Each stage reads what the stage before it wrote and calls one operator of quiremill.llm. All but
the last return the columns of documents, whatever these are called beside doc_id and text.

Null text counts as empty in every stage, and empty texts are judged like others: the toxicity curve
at no terms, the quality of one passage of zeros, one group of near copies, a document of the end id
alone. Texts of any length are read whole. Rows that repeat a doc_id are scored each; of them the
near-duplicate stage keeps one. Rows without doc_id are never learned from and never copies of a row
with one. Of equally similar documents the least doc_id stays. Without labels nothing is rejected.
An empty table passes through and gives no pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiremill.llm import packing, quality, simhash, toxicity
from quiremill.llm.common import free, shared_dir, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text is not toxic."""
    model, own = toxicity.fit(docs, table(spark, sf_dir, "labels")), free(docs, "toxic_score")
    return toxicity.score(docs, model, own).where(F.col(own) < toxicity.THRESHOLD).select(*docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model does not reject."""
    model, own = quality.fit(docs, table(spark, sf_dir, "labels")), free(docs, "quality_score")
    return quality.score(docs, model, own).where(F.col(own) >= quality.THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.dedupe(docs, least=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their windows."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("toxicity", toxicity_filter),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("packing", packed),
]

#: Trained models and iterated components are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs

"""The corpus pipeline: quality, exact copies, near copies, secrets, packing.

Every stage takes the rows that its predecessor kept, written as Parquet and read again.

A null text counts as empty in every stage and stays null until it is packed as the single end token.  Rows without
an id are scored, deduplicated and packed like others; near copies among them stay, as there is no smallest id.
Of fully repeated rows one is left after the second stage.  Ties: the larger id of equal texts stays, the smallest id
of a group of near copies.  Other columns travel through the first four stages, whatever their names.  Empty
documents give an empty result; without labels there is nothing to learn from, and the first stage keeps the rows
that a tree-less model scores 0.5 or more, that is all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import exact_dedup, ngram_join, packing, quality, secrets
from flowlens.llm.common import table
from flowlens.llm.queries import tokenizer_file
from flowlens.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return ngram_join.drop_near_copies(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are masked; every document stays."""
    return secrets.mask_live(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near duplicates", near_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

# The classifier's trees, shingle components and token ids have no SQL form; the stages are tested by themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs

"""The corpus pipeline: five stages over documents, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orbita.llm import exact_dedup, mixing, order_minhash, sentence_pieces, shared, toxicity

# Every stage takes texts of any length and null in any column, keeps other columns as they
# are (whatever their names; the last stage returns its own), and returns no rows for none.


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labeller rejects go; null text is empty and stays, repeated rows are judged each."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space apart) the row of smallest doc_id stays, of repeated rows one; null text is empty."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of smallest doc_id stays; rows without doc_id stay."""
    return order_minhash.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times); null source is a source."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text; null text has none."""
    return sentence_pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("source_mixing", mix),
    ("sentence_pieces", tokens),
]

#: Training, sketches and pieces are no SQL: tests hold each stage's method against a brute-force
#: version, and run() against what the planted rows of a fixture must give.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

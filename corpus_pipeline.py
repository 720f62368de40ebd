"""Corpus pipeline: documents through five stages, each written as Parquet and reread as the next one's input.

Quality classifier, n-gram Jaccard join, personal data, mixing sources to target
weights, SentencePiece encoding and decoding. Each stage works on all rows that the one
before it left; all but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm import mixing, pii, qda, sptok, tgm
from terrasift.llm.queries import tokenizer
from terrasift.llm.steps import step, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of operator 8 scores 0.3 or more; it learns from the labelled rows not held out."""
    stats = qda.document_statistics(docs.select("doc_id", "text").where(~qda.held_out()))
    return qda.good_documents(docs, qda.train(stats, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at Jaccard 0.8 the row with the smallest doc_id (then text hash) stays."""
    keyed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))  # rows may repeat an id
    linked = tgm.join_classes(keyed.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    first = keyed.select("__row", "doc_id").join(linked.distinct(), "__row").groupBy("component_id").agg(F.min(F.struct("doc_id", "__row")).alias("first"))
    stay = first.select(F.col("first.__row").alias("__row"))
    return keyed.join(stay, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every item that operator 1 finds is replaced by its kind in brackets; n_chars follows."""
    out = pii.find_pii(docs, spans="__pii", redact="text")
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that operator 4 takes, as documents: a row for each turn in which a document gives words."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with an end id, their number, and whether they decode to the text."""
    out = sptok.encode(docs, tokenizer("piece_bpe_32k.model"), decoded="__decoded")
    return out.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), F.col("__decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mix),
    ("tokens", tokens),
]

#: The mixing and tokenizer stages cannot be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = step(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs

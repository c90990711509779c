"""Corpus pipeline: language ID, exact dedup, near dedup, source mixing, SentencePiece pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelane import session
from framelane.llm import exact_dedup, language_id, mixing, sentencepiece, simhash
from framelane.llm.common import fresh, keep_ids, table, with_row_key


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; those without a letter, and those between two languages, go.

    Every row is judged by its own text, whether its doc_id is null or shared.
    """
    session.ship(spark)
    row = fresh(docs, "__row")
    rows = with_row_key(docs, name=row)
    found = language_id.predict(rows, language_id.fit(docs), row)
    return keep_ids(rows, found.where(F.col("lang_pred") != language_id.UNDETERMINED).where("not ambiguous"), row).drop(row)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, one with a null doc_id if there is no other."""
    session.ship(spark)
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, told apart by doc_id, text and all columns, so null and shared doc_ids lose nothing."""
    session.ship(spark)
    return simhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the sources' targets ask; null and shared doc_ids are taken like others."""
    session.ship(spark)
    return mixing.training_order(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    session.ship(spark)
    return sentencepiece.encode(docs, sentencepiece.load())


STAGES = [
    ("language_id", languages),
    ("exact_dedup", exact_copies),
    ("simhash", near_copies),
    ("source_mix", source_mix),
    ("sentencepiece", piece_ids),
]

#: SQL cannot state the learned classifier of the first stage; tests/llm compares all stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet to the shared folder and read again."""
    session.ship(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{session.shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Exact dedup by skew-safe combining: local, then by salted digest, then globally; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelane import session
from framelane.llm.common import fresh, keep_ids, row_key, with_row_key

SALTS = 8


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; null counts as the empty text. The
    largest key of a group stays. All three stages group by the text itself next
    to its digest, so two texts with one digest stay apart:

    1. inside a map task (Spark's partial aggregation) copies become one row;
    2. these rows meet by (digest, salt, text), the salt being the map task's, so
       that a group with a third of all rows is dealt to ``salts`` tasks;
    3. the at most ``salts`` winners of a text meet by (digest, text).

    Edge cases: rows with a null key count in group_size and are never kept; a
    group of null keys only has a null keep_id. Rows that repeat the kept key and
    text are all marked kept. An empty table gives an empty table. Other columns
    are not read, so their names do not matter.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("salt", F.spark_partition_id() % salts)
    salted = rows.groupBy("digest", "salt", "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))
    winners = salted.groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = session.cut(winners.select("digest", "keep_id", "group_size"))
    # One digest, several texts: never seen for SHA-256, but answered from the texts all the same.
    clash = winners.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    members = rows.select("id", "digest")
    if clash.isEmpty():
        out = members.join(winners, "digest")
    else:
        again = rows.join(clash, "digest", "left_semi").select("id", "digest", "body")
        by_text = again.groupBy("digest", "body").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
        alone = winners.join(clash, "digest", "left_anti")
        out = members.join(alone, "digest").unionByName(again.join(by_text, ["digest", "body"]).drop("body"))
    return out.select(
        F.col("id").alias(key), "keep_id", "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that stay, one for each text, all columns as they are.

    It is a row with the largest key of its text, null if it has no other; a key that
    different texts share stays with each text that it is the largest of.
    """
    row = fresh(docs, "__row")
    verdict = duplicate_groups(docs, key, text)
    stays = verdict.where(F.col(key).eqNullSafe(F.col("keep_id"))).select(row_key(F.col(key), F.col("text_sha256")).alias(row))
    return keep_ids(with_row_key(docs, key, text, row), stays, row).dropDuplicates([row]).drop(row)

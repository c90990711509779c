"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1024
BATCH_BYTES = 16 << 20


#: Bytes of words: all but space, tab, line feed, vertical tab, form feed and carriage return.
NOT_SPACE = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])


def word_spans(body: bytes, member: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words of a text (runs of member bytes) joined by one space, with the start and end of each."""
    a = np.frombuffer(body, np.uint8)
    word = member[a]
    keep = word.copy()
    keep[1:] |= word[:-1]
    joined = np.where(word, a, np.uint8(32))[keep]
    edge = np.diff(np.concatenate([[0], word[keep].view(np.int8), [0]]))
    return joined.tobytes(), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch holds, so that long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    except Exception as unknown:  # noqa: BLE001 - a Spark version without this setting keeps the row bound
        if "CONFIG" not in str(unknown).upper():
            raise


def keep_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is among ``ids``; columns as in ``docs``, whatever they are called."""
    kept = ids.select(F.col(key).alias("__kept_id"))
    return docs.join(kept, docs[key] == kept["__kept_id"], "left_semi")


def row_key(key: Column, digest: Column) -> Column:
    """One string for a key, null or not, and the digest of the text, as keys may be shared by different texts."""
    return F.concat(F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n")), F.lit(":"), digest)


def fresh(docs: DataFrame, stem: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def with_row_key(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "__row") -> DataFrame:
    return docs.withColumn(name, row_key(F.col(key), F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def row_identity(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Column:
    """(key is null, key, digest of the text, hash of all columns): orders by key, null last; equal for equal rows only."""
    return F.struct(
        F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"),
        F.xxhash64(*[docs[c] for c in docs.columns]).alias("rest"),
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""What the operators of this subpackage share: reading, row keys, and joins with a checked size.

A document row is identified by (`doc_id`, hash of its text). Rows that repeat both are one document
and always get the same decision. A null id sorts after every other id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.session import pin_utc, written

#: Most rows of a side that is broadcast; the callers count the rows before.
BROADCAST_ROWS = 50_000
#: Most bytes that values of no fixed width add to such a side.
BROADCAST_BYTES = 64 << 20
#: Rows of an Arrow batch, so that a batch of very long texts still fits a Python worker.
BATCH_ROWS = 256
NULL_ID = (1 << 63) - 1


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that bound the memory of Python workers."""
    pin_utc(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """`df` written to the shared folder and read back, with its row count and other metrics."""
    return written(df, name, *metrics)


def doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))


def text_tie() -> Column:
    return F.xxhash64(F.col("text"))


def real_id(column: str | Column) -> Column:
    """The id as it was: null again where the key stands for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != NULL_ID, column)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` does not use, ignoring case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def lookup(small: DataFrame, rows: int, size: int | None = 0) -> DataFrame:
    """`small` marked for broadcast while its known row count is within the bound.

    `size` is the number of bytes of its values that have no fixed width (null: none were seen).
    """
    return F.broadcast(small) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else small


def split_by_keys(docs: DataFrame, keys: DataFrame, rows: int, how: str) -> DataFrame:
    """The rows of `docs` whose document is (`left_semi`) or is not (`left_anti`) among `keys`.

    `keys` has the columns doc and tie; `rows` is its known size. All columns of `docs` come back.
    """
    doc, tie = spare(docs, "key_doc", "key_tie")
    keys = lookup(keys.select(F.col("doc").alias(doc), F.col("tie").alias(tie)), rows)
    return docs.withColumns({doc: doc_key(), tie: text_tie()}).join(keys, [doc, tie], how).drop(doc, tie)

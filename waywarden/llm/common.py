"""What the operators share: words, written intermediate tables and id helpers."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waywarden.tables import discard, new_path, shared_dir, written  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Inside, at most so many rows go to Python at once; for actions on rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


#: DuckDB: CTEs that give `crc` as (doc_id, crc) over the UTF-8 bytes of documents' texts. Goes behind WITH RECURSIVE.
CRC_SQL = """crc_bits(i, k, c) AS (SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE k < 8),
crc_tab AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8),
crc_bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bs FROM documents),
crc AS (SELECT doc_id, CAST(xor(list_reduce(list_prepend(4294967295, bs), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) AS BIGINT) AS crc FROM crc_bytes, crc_tab)"""

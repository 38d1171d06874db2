import pytest
from pyspark.sql import functions as F

from tests.llm.data import table
from waywarden.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 1023, 4097])
def test_permutation(spark, n):
    got = [r["p"] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 50 or got != sorted(got))


@pytest.mark.parametrize("n", [999, 4097, 10001])
def test_long_walks_end(spark, n, monkeypatch):
    """With few steps for all, the rest of a walk gives the same permutation."""
    want = [r["p"] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p")).collect()]
    monkeypatch.setattr(sharding, "WALK", 1)
    assert [r["p"] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p")).collect()] == want


def test_rows_equal_in_all_ties(spark):
    df = spark.createDataFrame([(1, "a")] * 20 + [(None, None)] * 3, "doc_id long, text string")
    s = sharding.shard(df, ties=("text",)).toPandas()
    assert sorted(s.groupby("shard").size().tolist()) == [2] + [3] * 7 and not s[["shard", "slot"]].duplicated().any()


def test_shards(spark):
    df = table(spark, extra=True)
    s = sharding.shard(df, ties=("text",)).toPandas()
    counts = s.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()
    again = sharding.shard(df.repartition(9), ties=("text",)).toPandas()
    key = lambda d: sorted(zip(d.doc_id.fillna(-1), d.text.fillna(""), d.shard, d.slot, strict=True))
    assert key(s) == key(again)


def test_empty(spark):
    assert sharding.shard(table(spark, [])).count() == 0

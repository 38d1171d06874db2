"""Small tables with nulls, empty and long texts, copies, ties and columns of clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near(rng, ws, share):
    return [f"x{rng.randrange(9999)}" if rng.random() < share else w for w in ws]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ws = words(rng, rng.choice([60, 90, 150, 300]), 5000)
        out.append(" ".join(ws))
        if i % 5 == 0:
            out.append(" ".join(near(rng, ws, 0.02)))
        if i % 7 == 0:
            out.append(" ".join(ws).upper())
        if i % 9 == 0:
            out.append(" ".join(near(rng, ws, 0.06)))
    long = " ".join(words(rng, 9000, 3000))
    return [*out, long, None, "", "   \n\t", "one", "one two", "Ünïcode ½ 日本語 text here", "a\x00b \x1c c", *out[:3]]


def table(spark, rows=None, extra=False):
    rows = texts() if rows is None else rows
    data = [(i if i != 4 else None, t, "en", None if i % 11 == 3 else f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for c in ("size", "text_hash", "copies", "key", "row", "shard", "u", "rate", "bucket", "id", "salt", "pii", "word", "block"):
            df = df.withColumn(c, F.lit("mine"))
    return df

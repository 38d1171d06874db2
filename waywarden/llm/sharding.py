"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Row numbers come from one range partitioning by key (only key, size and
checksum move), so no task sees all rows. A generalised Feistel network over
Z_a x Z_b, a*b barely above n, permutes them; values that fall outside [0, n)
walk the cycle until they come back. Shard and slot are the remainder and the
quotient of the permuted number, so both can be computed from (row number, n,
seed) alone, shard sizes differ by one at most and slots have no gaps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waywarden.llm.common import CRC_SQL, documents, written

#: Modulus of the round function: its products stay below 2**63.
P = 2**31 - 1
ROUNDS = 6
#: Steps that every walk may take; longer ones make a list of the steps that are possible.
WALK = 8


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Per round a multiplier, an addend and a second multiplier, from a linear congruence on the seed."""
    keys, x = [], seed % P
    for _ in range(rounds):
        row = []
        for _ in range(3):
            x = (x * 48271 + 11) % P
            row.append(x + 1 if x < P - 1 else 1)
        keys.append(tuple(row))
    return keys


def domain(n: int) -> tuple[int, int]:
    """The sides of the smallest near-square that holds n values."""
    a = max(1, math.isqrt(n))
    return a, max(1, -(-n // a))


def feistel(value: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the permutation of [0, a*b); native, one value in and one out."""
    state = F.struct(((value - value % b) / b).cast("long").alias("l"), (value % b).alias("r"))
    # a fold over the rounds keeps each half evaluated once a round
    keys = F.array(*[F.struct(F.lit(i % 2 == 0).alias("even"), *[F.lit(v).cast("long").alias(k) for k, v in zip("abc", key, strict=True)]) for i, key in enumerate(round_keys(seed))])

    def step(s: Column, k: Column) -> Column:
        x = F.when(k["even"], s["r"]).otherwise(s["l"])
        y = (x % P * k["a"] + k["b"]) % P
        m = (y * (y % 65521 + 1) % P * k["c"] + k["b"]) % P
        return F.struct(
            F.when(k["even"], (s["l"] + m) % a).otherwise(s["l"]).alias("l"),
            F.when(k["even"], s["r"]).otherwise((s["r"] + m) % b).alias("r"),
        )

    return F.aggregate(keys, state, step, lambda s: s["l"] * b + s["r"])


def permuted(row: Column, n: int, seed: int) -> Column:
    """The place of a row number in the shuffle of n rows.

    Only a*b - n values lie outside, so a walk ends within that many steps; the
    expression walks just for the rows (about 1 in sqrt(n)) that need it.
    """
    a, b = domain(n)
    first = feistel(row, a, b, seed)
    steps = a * b - n
    if steps == 0:
        return first
    on = lambda v, _: F.when(v < n, v).otherwise(feistel(v, a, b, seed))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(steps, WALK))), first, on)
    if steps > WALK:
        # a row is outside again with odds of about 1 in sqrt(n): next to none comes here
        walk = F.aggregate(F.array(walk), F.lit(0).cast("long"), lambda _, v: F.when(v < n, v).otherwise(F.aggregate(F.sequence(F.lit(WALK + 1), F.lit(steps)), v, on)))
    return F.when(first < n, first).otherwise(walk)


def row_numbers(df: DataFrame, key: str, ties: list[str]) -> tuple[DataFrame, int]:
    """df with `row`, 0..n-1 by key (nulls first) and then the tie columns; and n.

    Sorted range partitions number their own rows; the counts of the partitions,
    one row each, give the offsets. Rows equal in all of these columns are
    interchangeable.
    """
    order = [F.col(key), *map(F.col, ties)]
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    )
    placed = written(placed, "rows")
    counts = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, n = [], 0
    for part in sorted(counts):  # one entry for each partition, not for each row
        starts.append((part, n))
        n += counts[part]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    return placed.join(F.broadcast(offsets), "_part").withColumn("row", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), n


def shard(df: DataFrame, key: str = "doc_id", ties: tuple[str, ...] = (), shards: int = 8, seed: int = 20240517) -> DataFrame:
    """df with `row`, `shard` and `slot` by the law of rows.

    A null key sorts first; repeated keys are told apart by the tie columns; an
    empty table stays empty. Input columns named row, shard or slot are replaced.
    """
    df = df.drop("row", "shard", "slot")
    numbered, n = row_numbers(df, key, list(ties))
    if n == 0:
        return numbered.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    at = permuted(F.col("row"), n, seed)
    placed = numbered.withColumn("_p", at)
    return placed.withColumns({"shard": (F.col("_p") % shards).cast("int"), "slot": F.expr(f"_p div {shards}")}).drop("_p")


def op7(spark, sf_dir):
    docs = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    return shard(docs, ties=("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def _oracle() -> str:
    rounds, last = [], "s0"
    for i, (a, b, c) in enumerate(round_keys(20240517)):
        x, side, size = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        rounds.append(f"y{i} AS (SELECT *, ({x} % {P} * {a} + {b}) % {P} AS y FROM {last})")
        moved = f"({side} + (y * (y % 65521 + 1) % {P} * {c} + {b}) % {P}) % {size}"
        rounds.append(f"s{i + 1} AS (SELECT v, a, b, {moved if side == 'l' else 'l'} AS l, {moved if side == 'r' else 'r'} AS r FROM y{i})")
        last = f"s{i + 1}"
    return f"""
WITH RECURSIVE k AS (SELECT count(*) AS n, greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT)) AS a FROM documents),
d AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM k),
s0 AS (SELECT v, a, b, v // b AS l, v % b AS r FROM d, range(a * b) AS t(v)),
{", ".join(rounds)},
{CRC_SQL},
perm AS (SELECT v, l * b + r AS p FROM {last}),
walk AS (SELECT v AS row, p FROM perm, k WHERE v < n
  UNION ALL SELECT w.row, q.p FROM walk w JOIN perm q ON q.v = w.p, k WHERE w.p >= n),
x AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text,
  row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row FROM documents)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(p % 8 AS INTEGER) AS shard, CAST(p // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM x JOIN walk USING (row) JOIN crc USING (doc_id), k WHERE p < n"""


ORACLE = _oracle()

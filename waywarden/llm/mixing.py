"""Mixing sources to target weights by entropy balancing.

Targets share the total size by weight, no source above `most` times its own
size (the excess goes to the others, round by round, until none is above).

Rates are the ones closest to 1 in relative entropy that meet each source's
target: w = min(most, exp(lambda * size / mean size)). lambda solves the convex
dual; each Newton step is one aggregation over (source, size) counts, kept in
a bracket that a step may not leave. Sums are decimal, so no order of adding
changes a bit and reruns agree.

Rates become copies by floor(rate + u), u a hash of the row in [0, 1). What a
source then misses of its target, or has too much, is mended by moving its
rounding threshold, found from a histogram of the thresholds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywarden.llm.common import discard, documents, n_words, written
from waywarden.llm.sharding import row_numbers

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 4096
STEPS = 60
TOLERANCE = 1e-9
SEED = 97


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, least, target) from (source, size, n) counts; one row a source, by code point, null last.

    Sources get their numbers, and so their weights, from a range partitioning.
    Then each round gives the sources that are not yet capped their share of
    what is left, and caps those that are above; a round is two sums, and there
    are few, as the share of the others only rises.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"), F.sum("n").alias("n_docs"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    ranked, _ = row_numbers(by.withColumn("_null", F.col("source").isNull().cast("int")), "_null", ["source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("row") % len(weights) + 1).cast("int"))
    held = written(ranked.select("source", "source_size", "n_docs", "least", weight.cast("long").alias("weight"), (F.col("source_size") * most).alias("cap")), "sources")
    total = held.agg(F.sum("source_size")).head()[0] or 0
    share = 0.0
    while True:
        over = F.col("cap") < F.lit(share) * F.col("weight")
        now = held.agg(F.sum(F.when(over, F.col("cap"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).head()
        new = (total - (now["capped"] or 0)) / now["weight"] if now["weight"] else math.inf
        if not new > share:
            break
        share = new
    # where all are capped, or have no size, the share has no bound
    free = F.least(F.lit(share) * F.col("weight"), F.col("cap").cast("double")) if math.isfinite(share) else F.col("cap").cast("double")
    return held.select("source", "source_size", "n_docs", "least", free.alias("target"))


def _rate(most: int) -> Column:
    """The rate of a row with size, lam, mean and full."""
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.exp(F.col("lam") * F.col("size") / F.col("mean"))))


def _exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,8)")).cast("double")


def solve(sizes: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """(source, source_size, target, mean, full, lam): the dual's solution."""
    z = F.try_divide("least", "mean")
    ratio = F.try_divide("target", "source_size")
    state = (
        goals.withColumn("mean", F.greatest(F.lit(1.0), F.try_divide("source_size", "n_docs")))
        .withColumn("full", F.coalesce(F.col("target") >= F.col("source_size") * most, F.lit(True)))
        .withColumn("lo", F.when(ratio < 1, F.log(ratio) / z).otherwise(F.lit(0.0)))
        .withColumn("hi", F.when(ratio > 1, F.lit(math.log(most)) / z).otherwise(F.lit(0.0)))
        .withColumn("lam", F.lit(0.0))
    )
    state = written(state, "mix")
    fixed = ["source", "source_size", "target", "least", "mean", "full"]
    for _ in range(STEPS):
        rows = sizes.alias("h").join(state.filter("NOT full AND lo < hi").alias("s"), F.expr("h.source <=> s.source")).select("h.size", "h.n", "s.*")
        mass = F.col("n") * F.col("size") * _rate(most)
        slope = F.when(_rate(most) < most, mass * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = rows.groupBy("source").agg(_exact(mass).alias("g"), _exact(slope).alias("dg"))
        now = state.alias("s").join(sums.alias("g"), F.expr("s.source <=> g.source"), "left").select("s.*", "g.g", "g.dg")
        off = F.col("g") - F.col("target")
        now = now.withColumn("lo", F.when(off <= 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(off >= 0, F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") - off / F.when(F.col("dg") > 0, F.col("dg"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        # as near as the sums' digits tell, or a bracket that has no number inside
        narrow = F.col("hi") - F.col("lo") <= 1e-15 * F.greatest(F.lit(1.0), F.abs("lam"))
        close = F.coalesce((F.abs(off) <= TOLERANCE * F.col("target") + 1e-6) | narrow, F.lit(True))
        now = now.withColumn("lam", F.when(close, F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2))
        now = now.withColumn("close", close)
        before, state = state, written(now.select(*fixed, "lo", "hi", "lam", "close"), "mix")
        discard(before)
        if not state.filter("NOT close").head(1):
            return state.select(*fixed, "lam")
    raise RuntimeError(f"the dual is not solved after {STEPS} steps: {state.filter('NOT close').limit(3).collect()}")


def _unit(*columns: str) -> Column:
    """A hash of the row as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *columns), 11) / float(1 << 53)


def plan_mix(rows: DataFrame, most: int = MOST) -> DataFrame:
    """Per source what decides copies, from rows of (source, size, u): solve()'s columns, and up/down, the bins to move."""
    sizes = written(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    duals = written(solve(sizes, targets(sizes, most=most), most), "duals")
    at = with_rates(rows, duals, most)
    step = F.floor((F.col("rate") + F.col("u") - F.col("copies")) * BINS).cast("int")
    bins = at.groupBy("source", step.alias("bin")).agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"),
        F.sum(F.when(F.col("copies") < most, F.col("size")).otherwise(0)).alias("more"),
        F.sum(F.when(F.col("copies") > 0, F.col("size")).otherwise(0)).alias("less"),
    )
    per = Window.partitionBy("source")
    bins = bins.withColumn("need", F.lit(0.0) - F.sum("taken").over(per))
    down = per.orderBy("bin")
    up = per.orderBy(F.desc("bin"))
    bins = bins.withColumn("cum_more", F.sum("more").over(up)).withColumn("cum_less", F.sum("less").over(down))
    bins = bins.alias("b").join(duals.alias("d"), F.expr("b.source <=> d.source")).select("b.*", (F.col("d.target") + F.col("b.need")).alias("miss"))
    moved = bins.groupBy("source").agg(
        F.min(F.when(F.col("cum_more") - F.col("more") / 2 <= F.col("miss"), F.col("bin"))).alias("up"),
        F.max(F.when(F.col("cum_less") - F.col("less") / 2 <= -F.col("miss"), F.col("bin"))).alias("down"),
    )
    return written(
        duals.alias("d").join(moved.alias("m"), F.expr("d.source <=> m.source"), "left").select("d.*", F.coalesce("m.up", F.lit(BINS)).alias("up"), F.coalesce("m.down", F.lit(-1)).alias("down")),
        "plan",
    )


def with_rates(rows: DataFrame, duals: DataFrame, most: int = MOST) -> DataFrame:
    """rows with their source's columns, the rate and the copies before the threshold moves."""
    d = duals.withColumnRenamed("source", "_source")
    joined = rows.join(d, F.expr("source <=> _source")).drop("_source")
    return joined.withColumn("rate", _rate(most)).withColumn("copies", F.floor(F.col("rate") + F.col("u")).cast("int"))


def with_copies(rows: DataFrame, plan: DataFrame, most: int = MOST) -> DataFrame:
    at = with_rates(rows, plan, most)
    step = F.floor((F.col("rate") + F.col("u") - F.col("copies")) * BINS).cast("int")
    moved = F.when((step >= F.col("up")) & (F.col("copies") < most), F.col("copies") + 1).when((step <= F.col("down")) & (F.col("copies") > 0), F.col("copies") - 1)
    return at.withColumn("copies", F.coalesce(moved, F.col("copies")))


def mix(df: DataFrame) -> DataFrame:
    """df with each row as often as the mix takes it; columns as they were.

    Null texts have size 0 and stay once or not at all; a null source is one
    source, the last; rows that repeat id and text share their hash. An empty
    table gives no rows.
    """
    rows = df.select("source", n_words(F.col("text")).alias("size"), _unit("doc_id", "text").alias("u"))
    plan = plan_mix(written(rows, "mixrows"))
    names = {c: f"_in_{c}" for c in df.columns}
    held = df.withColumnsRenamed(names).withColumns({"source": F.col("_in_source"), "size": n_words(F.col("_in_text")), "u": _unit("_in_doc_id", "_in_text")})
    taken = with_copies(held, plan).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(names[c]).alias(c) for c in df.columns])


def op5(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _unit("doc_id", "text").alias("u")), "mixrows")
    plan = plan_mix(rows.select("source", "size", "u"))
    return with_copies(rows, plan).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))

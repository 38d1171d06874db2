"""Labels of windows from labels of fixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waywarden import params
from waywarden.operators.windows import TRACK, filled, first_k
from waywarden.params import Timing

ANOMALOUS = [c for c in params.CAUSES if c != "plausible"]


def window_labels(points: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """(track_id, k, label_frac, label_cause, label_transition, label_onset_t, label_event_id) of every window.

    A window takes its most frequent anomalous cause, the first in the list of
    causes on ties, where a third of its fixes are anomalous. An empty window
    takes the cause of the fixes on both sides where they agree; this looks at
    one later fix, as no feature does.
    """
    p = points.withColumn("label_cause", F.coalesce("label_cause", F.lit("plausible"))).withColumn("k", first_k(timing))
    fix = F.struct("t_us", "seq", "label_cause", "label_onset_t", "label_event_id")
    told = F.when(F.col("label_event_id").isNotNull(), F.struct("t_us", "seq", "label_onset_t", "label_event_id"))
    b = p.groupBy(TRACK, "k").agg(F.count("*").alias("n"), *[F.count_if(F.col("label_cause") == c).alias(f"n_{c}") for c in ANOMALOUS], F.max(told).alias("event"), F.min(fix).alias("first"), F.max(fix).alias("last"))
    order = Window.partitionBy(TRACK).orderBy("k")
    held, up_to = order.rowsBetween(-(timing.strides - 1), 0), order.rowsBetween(Window.unboundedPreceding, 0)
    # what comes next is what came last in the opposite order: that frame grows by a row at a time
    behind = Window.partitionBy(TRACK).orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    out = filled(b, timing).select(
        TRACK,
        "k",
        F.sum("n").over(held).alias("n"),
        F.array(*[F.sum(f"n_{c}").over(held) for c in ANOMALOUS]).alias("counts"),
        F.max("event").over(held).alias("event"),
        F.max("last").over(up_to).alias("before"),
        F.last("first", ignorenulls=True).over(behind).alias("after"),
    )
    empty = F.col("n").isNull()
    agree = empty & (F.col("before.label_cause") == F.col("after.label_cause")) & (F.col("before.label_cause") != "plausible")
    agree = F.coalesce(agree, F.lit(False))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    names = F.array(*map(F.lit, ANOMALOUS))
    out = out.withColumn("label_frac", F.when(agree, 1.0).when(empty, 0.0).otherwise(total / F.col("n")))
    top = F.when(agree, F.col("before.label_cause")).otherwise(F.get(names, (F.array_position("counts", F.array_max("counts")) - 1).cast("int")))
    event = F.coalesce("event", F.when(agree & F.col("before.label_event_id").isNotNull(), F.struct("before.t_us", "before.seq", "before.label_onset_t", "before.label_event_id")))
    return out.select(
        TRACK,
        "k",
        "label_frac",
        F.when(F.col("label_frac") >= params.LABEL_POS_FRAC, top).otherwise("plausible").alias("label_cause"),
        ((F.col("label_frac") > 0) & (F.col("label_frac") < params.LABEL_POS_FRAC)).alias("label_transition"),
        event["label_onset_t"].alias("label_onset_t"),
        event["label_event_id"].alias("label_event_id"),
    )

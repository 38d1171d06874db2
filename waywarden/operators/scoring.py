"""Limits, violations, dimension scores and the naive baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywarden import params, registry
from waywarden.functions import geo
from waywarden.operators.windows import TRACK, grid, members
from waywarden.params import Timing

THRESHOLD_SCHEMA = "name string, domain string, tau double, scale double, n long, fitted_on string"


def fit_thresholds(clean: DataFrame, features: list[str] | None = None, quantile: float = params.THRESHOLD_QUANTILE, least: int = params.THRESHOLD_MIN_N) -> DataFrame:
    """(name, domain, tau, scale, n) from clean windows: the larger of the registry's limit and the quantile.

    Only calibrated features are fitted; below `least` known values the
    registry's limit stays. One aggregation over all features of a domain.
    """
    fitted = [f for f in (features or registry.SCORED) if registry.FEATURES[f].source == "calibrated" and f in clean.columns]
    agg = clean.groupBy(F.col("aux_domain").alias("domain")).agg(*[x for f in fitted for x in (F.percentile(f, quantile).alias(f), F.count(f).alias(f"n_{f}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("q"), F.col(f"n_{f}").alias("n"), F.lit(registry.FEATURES[f].tau).alias("t0"), F.lit(registry.FEATURES[f].scale).alias("scale")) for f in fitted]))
    out = agg.select("domain", rows.alias("r")).select("domain", "r.*")
    return out.select("name", "domain", F.when(F.col("n") >= least, F.greatest("t0", "q")).otherwise(F.col("t0")).alias("tau"), "scale", "n")


def before_last_days(df: DataFrame, t: str = "t", days: int = 2) -> DataFrame:
    """Rows of all but the last UTC days, which are held out."""
    day = F.floor(F.col(t) / 86_400)
    last = df.agg(F.max(day).alias("_last"))  # one row
    return df.crossJoin(F.broadcast(last)).filter(day <= F.col("_last") - days).drop("_last")


def clean_windows(windows: DataFrame, days: int = 2) -> DataFrame:
    """Windows that limits are fitted on: with enough fixes, without a label or in transition to one, and not of the held-out days."""
    w = windows.filter(F.col("tmp_n_points") >= params.MIN_POINTS)
    if "label_cause" in w.columns:
        w = w.filter((F.col("label_cause") == "plausible") & ~F.col("label_transition"))
    return before_last_days(w, "t_end", days)


def read_thresholds(spark, path: str) -> dict[str, dict[str, tuple[float, float]]]:
    """name → domain → (tau, scale) of a thresholds file: one row for each scored feature and domain."""
    out: dict[str, dict[str, tuple[float, float]]] = {}
    for r in spark.read.option("header", True).schema(THRESHOLD_SCHEMA).csv(path).collect():
        out.setdefault(r["name"], {})[r["domain"]] = (r["tau"], r["scale"])
    return out


def _limit(feature: str, which: int, thresholds: dict | None) -> Column:
    f = registry.FEATURES[feature]
    out = F.lit(float((f.tau, f.scale)[which]))
    for domain, pair in ((thresholds or {}).get(feature) or {}).items():
        out = F.when(F.col("aux_domain") == domain, F.lit(float(pair[which]))).otherwise(out)
    return out


def violation(value: Column, tau: Column | float, scale: Column | float) -> Column:
    """How far a value is beyond its limit, in [0, 1]; an unknown value is no evidence."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - tau) / scale)), F.lit(0.0))


def violations(features: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """features with v_<feature> for every scored feature; a missing column counts as unknown."""
    value = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) if f in features.columns else F.lit(None).cast("double")
    return features.withColumns({f"v_{f}": violation(value(f), _limit(f, 0, thresholds), _limit(f, 1, thresholds)) for f in registry.SCORED})


def dimension_scores(violated: DataFrame) -> DataFrame:
    """violated with d_<dimension> = 100 * product of (1 - violation), and normality = the lower of behaviour's two."""
    out = {}
    for d in registry.SCORED_DIMENSIONS:
        score = F.lit(100.0)
        for f in registry.names(d):
            if registry.FEATURES[f].scored:
                score = score * (1 - F.col(f"v_{f}"))
        out[f"d_{d}"] = score
    return violated.withColumns(out).withColumn("normality", F.least("d_spatial", "d_contextual"))


def naive_score(points: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """(track_id, k, baseline_score, baseline_flag): the largest point-to-point speed or jump with both fixes in the window."""
    w = Window.partitionBy(TRACK).orderBy("t_us", "seq")
    p = points.withColumns({"p_us": F.lag("t_us").over(w), "p_lat": F.lag("lat").over(w), "p_lon": F.lag("lon").over(w)})
    p = p.withColumn("d", F.expr(geo.distance_m("p_lat", "p_lon", "lat", "lon"))).withColumn("dt", (F.col("t_us") - F.col("p_us")) / 1e6)
    limit = F.when((F.col("domain") == "aircraft") & ~F.coalesce("on_ground", F.lit(False)), params.BASE_AIR_MPS).otherwise(params.BASE_GROUND_MPS)
    speed = F.when(F.col("dt") > 0, F.least(F.lit(1.0), F.col("d") / F.col("dt") / limit))
    p = p.withColumn("pair", F.greatest(speed, F.least(F.lit(1.0), F.col("d") / params.BASE_JUMP_M)))
    inside = F.col("p_us") > F.col("k") * timing.us("stride") - timing.us("window")
    agg = members(p, timing).filter(inside).groupBy(TRACK, "k").agg(F.max("pair").alias("score"))
    out = grid(points, timing).join(agg, [TRACK, "k"], "left").withColumn("baseline_score", F.coalesce("score", F.lit(0.0)))
    return out.select(TRACK, "k", "baseline_score", (F.col("baseline_score") >= 1.0).alias("baseline_flag"))

"""Quantities of single fixes: intervals, frozen runs, lagged pairs, and ratios to what a class can do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywarden import params, registry
from waywarden.functions import geo
from waywarden.params import Timing

TRACK = "track_id"


def in_time(track: str = TRACK):
    """A track's fixes in time; fixes of one time in order of arrival."""
    return Window.partitionBy(track).orderBy("t_us", "seq")


def so_far(track: str = TRACK):
    return in_time(track).rowsBetween(Window.unboundedPreceding, 0)


def lagged(timing: Timing, *columns: str | Column, track: str = TRACK) -> Column:
    """The latest fix at least rate_s earlier, as a struct; of one time the last that arrived.

    The frame is a range over the time alone, so the order of ties lives in the
    struct. It shares the partitioning and sort of the other track windows.
    """
    frame = Window.partitionBy(track).orderBy("t_us").rangeBetween(Window.unboundedPreceding, -timing.us("rate"))
    return F.max(F.struct("t_us", "seq", *columns)).over(frame)


def arrivals(points: DataFrame) -> DataFrame:
    """points with nonmono: earlier than the fix that arrived before. Fixes of one seq count as arrived in order of time."""
    w = Window.partitionBy(TRACK).orderBy("seq", "t_us")
    return points.withColumn("nonmono", F.coalesce((F.col("t_us") < F.lag("t_us").over(w)).cast("int"), F.lit(0)))


def reported_speed(points: DataFrame) -> DataFrame:
    """points with gs: reported speed, but not a moving one without a course."""
    stale = F.col("track_deg").isNull() & (F.col("gs_mps") > params.COURSE_MIN_MPS)
    return points.withColumn("gs", F.when(~F.coalesce(stale, F.lit(False)), F.col("gs_mps")))


def steps(points: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """points with dt_prev, dup, frozen and frozen_s (seconds since the fix whose position repeats)."""
    w = in_time()
    same = (F.col("lat") == F.lag("lat").over(w)) & (F.col("lon") == F.lag("lon").over(w))
    out = points.withColumns({
        "dt_prev": (F.col("t_us") - F.lag("t_us").over(w)) / 1e6,
        "frozen": F.coalesce(same & (F.col("gs") > params.MOVING_MPS), F.lit(False)).cast("int"),
    })
    anchor = F.last(F.when(F.col("frozen") == 0, F.col("t_us")), ignorenulls=True).over(so_far())
    return out.withColumns({
        "dup": F.coalesce((F.col("dt_prev") == 0).cast("int"), F.lit(0)),
        "frozen_s": F.when(F.col("frozen") == 1, F.least((F.col("t_us") - anchor) / 1e6, F.lit(float(timing.frozen_cap_s)))).otherwise(F.lit(0.0)),
    })


def degradation(points: DataFrame) -> DataFrame:
    """points with eligible (accuracy was once good) and degraded, null where accuracy is unknown or never was good."""
    good = F.max(F.coalesce(F.col("nacp") >= params.DEGRADED_NACP_BELOW, F.lit(False))).over(so_far())
    low = (F.col("nacp") < params.DEGRADED_NACP_BELOW).cast("double")
    return points.withColumn("eligible", good).withColumn("degraded", F.when(F.col("eligible"), low))


def running_speed(points: DataFrame) -> DataFrame:
    """points with gs_sum and gs_n: reported speeds up to and with each fix."""
    return points.withColumns({"gs_sum": F.sum(F.coalesce("gs", F.lit(0.0))).over(so_far()), "gs_n": F.count("gs").over(so_far())})


def pairs(points: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """points (with running_speed) and j, pair_dt, dist, az, v_imp, v_rep, mid of the lagged pair."""
    own = [
        (F.col("gs_sum") - F.coalesce("gs", F.lit(0.0))).alias("sum0"),
        (F.col("gs_n") - F.col("gs").isNotNull().cast("long")).alias("n0"),
    ]
    carried = [F.col(c) for c in ("lat", "lon", "gs", "track_deg", "alt_baro_m", "alt_geom_m")]
    out = points.withColumn("j", lagged(timing, *carried, *own))
    out = out.withColumns({
        "pair_dt": (F.col("t_us") - F.col("j.t_us")) / 1e6,
        "dist": F.expr(geo.distance_m("j.lat", "j.lon", "lat", "lon")),
        "mid": (F.col("t_us") + F.col("j.t_us")) / 2e6,
        "v_rep": F.when(F.col("gs_n") > F.col("j.n0"), (F.col("gs_sum") - F.col("j.sum0")) / (F.col("gs_n") - F.col("j.n0"))),
    })
    return out.withColumns({"az": F.when(F.col("dist") > 0, F.expr(geo.azimuth("j.lat", "j.lon", "lat", "lon"))), "v_imp": F.col("dist") / F.col("pair_dt")})


def turn(a: str, b: str) -> Column:
    return F.abs(F.expr(geo.wrap180(f"{a} - {b}")))


def limits(points: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """points with the class's limits, and limit: the ground's where taxiing, else the air's. 14 rows are broadcast."""
    env = F.broadcast(registry.envelopes(points.sparkSession).withColumnRenamed("asset_class", "_class"))
    out = points.join(env, F.col("asset_class") == F.col("_class"), "left").drop("_class", "class_domain")
    ground = (F.col("domain") == "vehicle") | F.coalesce("on_ground", F.lit(False))
    taxi = F.col("taxi_surface") if "taxi_surface" in points.columns else F.lit(True)
    out = out.withColumns({"ground": ground, "kin_checks": F.coalesce("kin_checks", F.lit(True))})
    return out.withColumn("limit", F.when(F.col("ground") & ((F.col("domain") == "vehicle") | taxi), F.col("ground_max")).otherwise(F.col("air_max")))


def ratios(p: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """Pairs to residuals and ratios. A second lagged look-up gives the pair that ends where this one begins."""
    p = p.withColumn("jj", lagged(timing, "v_imp", "dist", "az", "mid"))
    c = F.col
    moving = (c("gs") > params.COURSE_MIN_MPS) & (c("j.gs") > params.COURSE_MIN_MPS)
    air_turn = ~(c("ground") & (c("domain") == "aircraft"))
    far = (c("dist") >= params.COURSE_MIN_DISP_M) & (c("jj.dist") >= params.COURSE_MIN_DISP_M)
    p = p.withColumns({
        "resid": F.abs(c("v_imp") - c("v_rep")),
        "turn_dps": F.when(moving, turn("track_deg", "j.track_deg") / c("pair_dt")),
        "mean_course": F.expr(geo.wrap360(f"j.track_deg + 0.5 * {geo.wrap180('track_deg - j.track_deg')}")),
        "alt_div": c("alt_geom_m") - c("alt_baro_m"),
    })
    dmid = F.nullif(c("mid") - c("jj.mid"), F.lit(0.0))
    # a fix without velocity, accuracy or integrity is not a satellite report
    alone = c("gs_mps").isNull() & c("track_deg").isNull() & c("nacp").isNull() & ~F.coalesce(c("nic") > 0, F.lit(False))
    bounded = {
        "speed_ratio": F.when(c("j").isNotNull(), F.greatest("v_imp", "v_rep")).otherwise(c("gs")) / c("limit"),
        "accel_ratio": F.abs(c("gs") - c("j.gs")) / c("pair_dt") / c("accel_max"),
        "accel_imp_ratio": F.abs(c("v_imp") - c("jj.v_imp")) / dmid / c("accel_max"),
        "turn_imp_ratio": F.when(far & air_turn, turn("az", "jj.az") / dmid) / c("turn_max"),
        "turn_ratio": F.when(air_turn, c("turn_dps")) / c("turn_max"),
        "radius_ratio": F.when(c("turn_dps") > params.TURN_MIN_DPS, c("radius_min") * F.radians("turn_dps") / F.nullif(c("v_rep"), F.lit(0.0))),
        "vrate_ratio": F.abs("vrate_mps") / c("vrate_max"),
        "vrate_imp_ratio": F.abs(c("alt_baro_m") - c("j.alt_baro_m")) / c("pair_dt") / c("vrate_max"),
    }
    return p.withColumns({
        **{k: F.when(~alone, v) for k, v in bounded.items()},
        "resid_rel": c("resid") / F.when(c("v_rep").isNotNull(), F.greatest("v_rep", F.lit(params.COURSE_MIN_MPS))),
        "course_resid": F.when(moving & (c("dist") >= params.COURSE_MIN_DISP_M), turn("az", "mean_course")),
        "heading_diff": F.when(c("gs") > params.COURSE_MIN_MPS, turn("heading_deg", "track_deg")),
        "alt_div_rate": F.abs(c("alt_div") - (c("j.alt_geom_m") - c("j.alt_baro_m"))) / c("pair_dt"),
    })


def fix_level(points: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """All of it. One shuffle by track; arrival order is a sort of its own, the rest share one."""
    p = points if "t_us" in points.columns else points.withColumn("t_us", F.expr("CAST(round(t * 1000000) AS BIGINT)"))
    p = reported_speed(arrivals(limits(p, timing)))
    return ratios(pairs(running_speed(degradation(steps(p, timing))), timing), timing)

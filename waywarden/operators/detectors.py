"""Per-sample detectors: what is wrong with a position, and what is wrong with what an asset does. Centred, so offline.

A track is cut where its stream pauses; nothing looks across a cut. Runs come
from cumulative sums of their breaks. Only the pairing of a jump with its
return is greedy, and folds over the few candidates of a segment.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywarden import params, registry
from waywarden.functions import geo
from waywarden.operators.fixes import TRACK
from waywarden.operators.places import metric, near_polygons

SEG = [TRACK, "part"]


def kinematics(points: DataFrame, gap_s: float = params.DETECT_GAP_S, rate_s: float = 5.0) -> DataFrame:
    """points with part (cut at pauses), x and y metres from the track's first fix, pause, and the displacement over rate_s around each fix."""
    w = Window.partitionBy(TRACK).orderBy("t_us", "seq")
    p = points.withColumns({"pause": (F.col("t_us") - F.lag("t_us").over(w)) / 1e6, "lat0": F.first("lat").over(w), "lon0": F.first("lon").over(w)})
    p = p.withColumn("part", F.sum((F.coalesce("pause", F.lit(0.0)) > gap_s).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumns({"x": F.expr(geo.east_m("lat0", "lon0", "lat", "lon")), "y": F.expr(geo.north_m("lat0", "lat"))}).drop("lat0", "lon0")
    p = p.withColumns({"half_back": back(rate_s / 2), "half_ahead": ahead(rate_s / 2), "far_back": back(rate_s), "far_ahead": ahead(rate_s)})
    c = F.col
    dt = (c("half_ahead.t_us") - c("half_back.t_us")) / 1e6
    p = p.withColumns({"cdt": F.when(dt >= rate_s - 1e-9, dt), "cdx": c("half_ahead.x") - c("half_back.x"), "cdy": c("half_ahead.y") - c("half_back.y")})
    return p.withColumns({"cd": F.when(c("cdt").isNotNull(), F.hypot("cdx", "cdy"))}).withColumn("v5", c("cd") / c("cdt"))


def back(span_s: float) -> Column:
    """The latest fix of the part at least span_s earlier, as a struct of t_us, seq, x, y."""
    return F.max(F.struct("t_us", "seq", "x", "y")).over(Window.partitionBy(*SEG).orderBy("t_us").rangeBetween(Window.unboundedPreceding, -round(span_s * params.US)))


def ahead(span_s: float) -> Column:
    """The earliest fix of the part at least span_s later; in the opposite order of time its frame grows, and is not made anew for each row."""
    return F.min(F.struct("t_us", "seq", "x", "y")).over(Window.partitionBy(*SEG).orderBy(F.desc("t_us")).rangeBetween(Window.unboundedPreceding, -round(span_s * params.US)))


def in_part():
    return Window.partitionBy(*SEG).orderBy("t_us", "seq")


def run_id(mask: Column, by: list[str] | None = None) -> Column:
    """The same number for each row of a run of true rows."""
    w = Window.partitionBy(*(by or SEG)).orderBy("t_us", "seq")
    return F.sum((~F.coalesce(mask, F.lit(False))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def long_runs(df: DataFrame, mask: Column, least: int, out: str, by: list[str] | None = None) -> DataFrame:
    """df with out: mask, but only in runs of at least `least` rows."""
    by = by or SEG
    d = df.withColumn("_m", F.coalesce(mask, F.lit(False))).withColumn("_run", run_id(F.col("_m"), by))
    n = F.sum(F.col("_m").cast("long")).over(Window.partitionBy(*by, "_run"))
    return d.withColumn(out, F.col("_m") & (n >= least)).drop("_m", "_run")


def centred_median(value: Column, width: int, by: list[str] | None = None) -> Column:
    """The median of width rows around each, where more than half of them are known."""
    w = Window.partitionBy(*(by or SEG)).orderBy("t_us", "seq").rowsBetween(-(width // 2), width // 2)
    return F.when(F.count(value).over(w) >= width // 2 + 1, F.percentile(value, 0.5).over(w))


def innovation(k: DataFrame) -> DataFrame:
    """k with step (distance from the step that the velocity before or after predicts, the better one), sx and sy."""
    c, w = F.col, in_part()
    k = k.withColumns({"p": F.lag(F.struct("t_us", "x", "y", "far_back")).over(w)})
    k = k.withColumns({"dx": c("x") - c("p.x"), "dy": c("y") - c("p.y"), "dt": (c("t_us") - c("p.t_us")) / 1e6})
    vel = lambda a, b, v: (c(f"{b}{v}") - c(f"{a}{v}")) / ((c(f"{b}t_us") - c(f"{a}t_us")) / 1e6)
    k = k.withColumns({f"l{v}": c(f"d{v}") - vel("p.far_back.", "p.", v) * c("dt") for v in "xy"} | {f"r{v}": c(f"d{v}") - vel("", "far_ahead.", v) * c("dt") for v in "xy"})
    k = k.withColumns({"sl": F.hypot("lx", "ly"), "sr": F.hypot("rx", "ry")})
    right = c("sl").isNull() | (c("sr") < c("sl"))
    return k.withColumns({"step": F.when(right, c("sr")).otherwise(c("sl")), "sx": F.when(right, c("rx")).otherwise(c("lx")), "sy": F.when(right, c("ry")).otherwise(c("ly"))}).drop("p", "dx", "dy", "dt", "lx", "ly", "rx", "ry", "sl", "sr")


def fix_loss(k: DataFrame) -> DataFrame:
    """k with fix_loss on both sides of a pause, and gap_s."""
    w = Window.partitionBy(TRACK).orderBy("t_us", "seq")
    long = lambda c: F.when(c > params.DETECT_GAP_S, c)
    gap = F.coalesce(long(F.lead("pause").over(w)), long(F.col("pause")))
    return k.withColumn("gap_s", gap).withColumn("fix_loss", F.col("gap_s").isNotNull())


def frozen(k: DataFrame) -> DataFrame:
    """k with frozen_position: a repeated position for 5 s and more, with signs of motion; and explained: steps a freeze makes."""
    c, w = F.col, in_part()
    k = k.withColumn("_same", F.coalesce((c("lat") == F.lag("lat").over(w)) & (c("lon") == F.lag("lon").over(w)), F.lit(False)))
    k = k.withColumn("_run", run_id(c("_same")))
    of = Window.partitionBy(*SEG, "_run")
    # the row before the run, its anchor, carries the run's number too
    anchor = F.min(F.struct("t_us", "seq", "x", "y", "far_back")).over(of)
    k = k.withColumns({"_a": anchor, "_end": F.max("t_us").over(of), "_gs": F.max(F.when(c("_same"), c("gs_mps"))).over(of), "_n": F.sum(c("_same").cast("long")).over(of)})
    nxt = F.first(F.struct("t_us", "x", "y", "far_ahead")).over(w.rowsBetween(1, 1))
    k = k.withColumn("_b", F.last(nxt).over(of.orderBy("t_us", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    dur = (c("_end") - c("_a.t_us")) / 1e6
    before = F.hypot(c("_a.x") - c("_a.far_back.x"), c("_a.y") - c("_a.far_back.y")) / ((c("_a.t_us") - c("_a.far_back.t_us")) / 1e6)
    to = F.coalesce(F.col("_b.far_ahead"), F.when(c("_b").isNotNull(), F.struct("_b.t_us", F.lit(0).cast("long").alias("seq"), "_b.x", "_b.y")))
    # a fix of the anchor's own time tells no speed
    after = F.try_divide(F.hypot(to["x"] - c("_a.x"), to["y"] - c("_a.y")), (to["t_us"] - c("_a.t_us")) / 1e6)
    k = k.withColumns({"_long": (c("_n") > 0) & (dur >= params.FROZEN_MIN_S), "_moving": F.greatest("_gs", before, after), "_dur": dur})
    k = k.withColumns({"frozen_position": c("_same") & c("_long") & F.coalesce(c("_moving") >= params.MOVING_MPS, F.lit(False))})
    was_frozen = F.lag(c("_long") & c("_same")).over(w)
    return k.withColumns({
        "frozen_s": F.when(c("frozen_position"), c("_dur")),
        "moving_mps": F.when(c("frozen_position"), c("_moving")),
        "explained": F.coalesce(was_frozen & ~c("_same"), F.lit(False)) | (c("frozen_position") & ~F.coalesce(F.lag("_same").over(w), F.lit(False))),
    }).drop("_same", "_run", "_a", "_end", "_gs", "_n", "_b", "_long", "_moving", "_dur")


def jumps(k: DataFrame) -> DataFrame:
    """(track, part, seq0, t0, t1, step_m): from a step away until the step that undoes it, or for one sample.

    Candidates (step above 10 m, no noise) are few; each segment pairs them in order.
    """
    cand = k.filter(F.coalesce((F.col("_step_ok") > params.JUMP_M) & ~F.col("multipath_noise"), F.lit(False))).select(*SEG, "t_us", "seq", "step", "sx", "sy")

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t_us", "seq"])
        rows, used, out = list(pdf.itertuples(index=False)), set(), []
        for i, a in enumerate(rows):
            if i in used:
                continue
            end = None
            for j in range(i + 1, len(rows)):
                b = rows[j]
                if b.t_us - a.t_us > params.JUMP_MAX_S * params.US:
                    break
                if j not in used and math.hypot(a.sx + b.sx, a.sy + b.sy) < params.JUMP_RETURN_FRAC * a.step:
                    used.add(j)
                    end = b.t_us
                    break
            out.append((*(getattr(a, c) for c in SEG), a.seq, a.t_us, end if end is not None else a.t_us + 1, a.step))
        return pd.DataFrame(out, columns=[*SEG, "seq0", "t0", "t1", "step_m"])

    return cand.groupBy(*SEG).applyInPandas(pair, "track_id string, part long, seq0 long, t0 long, t1 long, step_m double")


def signal(points: DataFrame) -> DataFrame:
    """points with a column for each signal label, signal_label (the first that holds), position_wrong and the values behind them."""
    c = F.col
    k = frozen(fix_loss(innovation(kinematics(points))))
    k = k.withColumn("_step_ok", F.when(~c("explained") & ~c("frozen_position"), c("step")))
    k = k.withColumn("_med", centred_median(c("_step_ok"), params.MULTIPATH_WINDOW))
    k = long_runs(k, (c("_med") > params.MULTIPATH_M) & ~c("frozen_position"), params.MULTIPATH_MIN_RUN, "multipath_noise")
    k = k.withColumn("scatter_m", F.when(c("multipath_noise"), c("_med")))
    j = jumps(k)
    # a jump covers its rows up to its return: carried forward over the part instead of a range join
    starts = j.select(*SEG, F.col("seq0").alias("seq"), F.struct("t0", "t1", "step_m").alias("jump"))
    k = k.join(starts, [*SEG, "seq"], "left")
    held = F.max("jump").over(in_part().rowsBetween(Window.unboundedPreceding, 0))
    k = k.withColumn("_jump", held).withColumn("position_jump", F.coalesce(c("t_us") < c("_jump.t1"), F.lit(False))).withColumn("step_m", F.when(c("position_jump"), c("_jump.step_m")))
    wrong = c("position_jump") | c("multipath_noise") | c("fix_loss") | c("frozen_position")
    k = k.withColumns({"position_wrong": wrong})
    # how many wrong rows lie between the ends of the centred window: a difference of running counts
    count = F.sum((c("position_wrong") | c("explained")).cast("long"))
    k = k.withColumns({"_c": count.over(in_part().rowsBetween(Window.unboundedPreceding, 0)), "_w": (c("position_wrong") | c("explained")).cast("long")})
    order, opposite = (Window.partitionBy(*SEG).orderBy(c) for c in ("t_us", F.desc("t_us")))
    half = round(2.5 * params.US)
    k = k.withColumns({"_hi": F.min(F.struct("t_us", "seq", "_c")).over(opposite.rangeBetween(Window.unboundedPreceding, -half)), "_lo": F.max(F.struct("t_us", "seq", "_c", "_w")).over(order.rangeBetween(Window.unboundedPreceding, -half))})
    smooth = F.coalesce(c("_hi._c") - c("_lo._c") + c("_lo._w") == 0, F.lit(True))
    env = F.broadcast(registry.envelopes(points.sparkSession).select(c("asset_class").alias("_class"), F.when(c("kin_checks"), c("ground_max") * params.SPEED_FACTOR).alias("_cap")))
    k = k.join(env, c("asset_class") == c("_class"), "left").withColumn("bound_mps", F.coalesce("_cap", F.lit(params.SPEED_ABS_MPS)))
    over = (c("gs_mps") > c("bound_mps")) & (c("v5") > c("bound_mps"))
    contra = F.abs(c("gs_mps") - c("v5")) > F.greatest(F.lit(params.SPEED_RESID_MPS), params.SPEED_RESID_REL * c("v5"))
    k = long_runs(k.withColumn("_smooth", smooth), c("_smooth") & (F.coalesce(over, F.lit(False)) | F.coalesce(contra, F.lit(False))), params.IMPLAUSIBLE_MIN_RUN, "implausible_speed")
    off = F.abs(F.expr(geo.wrap180(f"heading_deg - {geo.wrap360('degrees(atan2(cdx, cdy))')}")))
    k = k.withColumn("heading_diff_deg", F.when(c("cd") >= params.HEADING_MIN_DISP_M, F.least(off, 180 - off)))
    k = long_runs(k, c("_smooth") & (c("heading_diff_deg") > params.HEADING_MAX_DEG), params.HEADING_MIN_RUN, "heading_incoherent")
    k = k.withColumn("alt_dev_m", F.abs(c("alt_geom_m") - F.percentile("alt_geom_m", 0.5).over(Window.partitionBy(TRACK))))
    k = k.withColumns({"altitude_spike": F.coalesce(c("alt_dev_m") > params.ALT_SPIKE_M, F.lit(False)), "gnss_drift": F.lit(False)})
    keep = [x for x in points.columns] + ["part", "v5", *params.SIGNAL_LABELS, "position_wrong", "step_m", "scatter_m", "frozen_s", "moving_mps", "gap_s", "bound_mps", "heading_diff_deg", "alt_dev_m"]
    return k.withColumn("signal_label", first_label(params.SIGNAL_LABELS)).select(*keep, "signal_label")


def first_label(labels) -> Column:
    """The first label in order that holds; '' if none does."""
    out = F.lit("")
    for label in reversed(labels):
        out = F.when(F.col(label), label).otherwise(out)
    return out


# ---------------------------------------------------------------- behaviour


def containing(signals: DataFrame, zones: DataFrame) -> DataFrame:
    """(track_id, seq, zone_id, zone_class, allowed_groups, speed_limit_mps, area) for each zone that holds a sample."""
    return near_polygons(metric(signals).select(TRACK, "seq", "x", "y"), zones)


def overspeed_limits(s: DataFrame) -> DataFrame:
    """s with threshold_mps: the limit and a tolerance, or the class's bulk speed where most of its traffic is above the limit."""
    known = s.filter("v5 IS NOT NULL AND speed_limit_mps IS NOT NULL")
    bulk = known.groupBy("zone_class").agg(F.avg((F.col("v5") > F.col("speed_limit_mps")).cast("double")).alias("above"), F.percentile("v5", params.OVERSPEED_BULK_Q).alias("bulk"))
    bulk = bulk.filter(F.col("above") > 1 - params.OVERSPEED_BULK_Q).select("zone_class", "bulk")
    out = s.join(bulk, "zone_class", "left")
    return out.withColumn("threshold_mps", F.when(F.col("speed_limit_mps").isNotNull(), F.greatest(F.col("speed_limit_mps") * (1 + params.OVERSPEED_TOL), F.col("bulk")))).drop("bulk")


def morton(x: Column, y: Column) -> Column:
    """The place of whole numbers below 2^30 on the curve that halves both in turn."""

    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def nearest(spots: DataFrame, others: DataFrame, within: float) -> DataFrame:
    """(sec, lat, lon, n): for each of spots (sec, lat, lon) the nearest of others (sec, lat, lon, other_id) in its second, as (d, other_id).

    The neighbours on a curve through a tile bound the distance. The bound sets
    the side of the cells that a spot is looked up in, at most four, so crowds
    of any density meet few of the others. Others stand in the cells of every size.
    """
    # the grid's metres are not quite metres; cells are halved while they hold the reach of a centimetre on both sides
    tile, slack = 5 * within, 0.01
    finest = max(0, int(math.log2(tile / (2 * slack))))
    at = lambda v, side: F.floor(v / side).cast("long")
    dist = lambda lat2, lon2: F.expr(geo.distance_m("lat", "lon", lat2, lon2))
    key = ["sec", "lat", "lon"]
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    # of many at one place the first by name is the nearest
    o = metric(others.filter(placed).groupBy(*key).agg(F.min("other_id").alias("other_id")))
    p = metric(spots.filter(placed).select(*key).distinct())
    both = p.select(*key, "x", "y", F.lit(None).cast("struct<lat:double,lon:double>").alias("o")).unionByName(o.select(*key, "x", "y", F.struct("lat", "lon").alias("o")))
    both = both.withColumns({f"t{v}": at(F.col(v), tile) for v in "xy"})
    inside = {v: F.floor((F.col(v) / tile - F.col(f"t{v}")) * (1 << 20)).cast("long") for v in "xy"}
    both = both.withColumn("z", morton(inside["x"], inside["y"]))
    curve = lambda order: F.last("o", True).over(Window.partitionBy("sec", "tx", "ty").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    p = both.withColumns({"before": curve(F.asc("z")), "after": curve(F.desc("z"))}).filter("o IS NULL")
    p = p.withColumn("bound", F.least(dist("before.lat", "before.lon"), dist("after.lat", "after.lon"), F.lit(float(within))))
    reach = F.least(1.01 * F.col("bound") + slack, F.lit(1.01 * within + 0.5))
    p = p.withColumn("reach", reach).withColumn("level", F.greatest(F.lit(0), F.least(F.lit(finest), F.floor(F.log2(tile / (2 * F.col("reach")))).cast("int"))))
    p = p.withColumn("side", tile / F.pow(F.lit(2.0), "level"))
    o = o.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(finest)))).withColumn("side", tile / F.pow(F.lit(2.0), "level"))
    o = o.select("sec", "level", *[at(F.col(v), F.col("side")).alias(f"c{v}") for v in "xy"], F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "other_id")
    for v in "xy":
        p = p.withColumn(f"c{v}", F.explode(F.sequence(at(F.col(v) - F.col("reach"), F.col("side")), at(F.col(v) + F.col("reach"), F.col("side")))))
    found = p.select(*key, "bound", "level", "cx", "cy").join(o, ["sec", "level", "cx", "cy"]).withColumn("d", dist("lat2", "lon2")).filter("d <= bound")
    return found.groupBy(*key).agg(F.min(F.struct("d", "other_id")).alias("n"))


def proximity(s: DataFrame, taxiing: str = "aircraft_taxi", within: float = params.PROXIMITY_M) -> DataFrame:
    """(track_id, seq, prox_m, other_id): the nearest moving aircraft of a vehicle's second, if it is within some metres."""
    sec = F.floor(F.col("t_us") / params.US).alias("sec")
    air = s.filter((F.col("asset_kind") == taxiing) & (F.col("v5") >= params.MOVING_MPS) & ~F.col("position_wrong")).select(sec, "lat", "lon", F.col("asset_id").alias("other_id"))
    veh = s.filter((F.col("domain") == "vehicle") & ~F.col("asset_kind").isin(*params.PROXIMITY_EXEMPT)).select(TRACK, "seq", sec, "lat", "lon")
    d = veh.join(nearest(veh, air, within), ["sec", "lat", "lon"])
    return d.groupBy(TRACK, "seq").agg(F.min("n").alias("n")).select(TRACK, "seq", F.col("n.d").alias("prox_m"), F.col("n.other_id").alias("other_id"))


def _stopping(s: DataFrame, below: float) -> DataFrame:
    """s with _stop, the number of its run, and whether a row is its track's first or last."""
    stop = F.coalesce(F.col("v5") < below, F.lit(False))
    w = Window.partitionBy(TRACK).orderBy("t_us", "seq")
    return s.withColumns({"_run": run_id(stop, [TRACK]), "_stop": stop, "_first": F.lag("t_us").over(w).isNull(), "_last": F.lead("t_us").over(w).isNull()})


def stop_runs(s: DataFrame, below: float = params.STOPPED_MPS) -> DataFrame:
    """The samples of stops, with the stop's duration, rows, and whether it touches an end of its track."""
    p = _stopping(s, below).filter("_stop")
    of = p.groupBy(TRACK, "_run").agg(((F.max("t_us") - F.min("t_us")) / 1e6).alias("stop_s"), F.bool_or(F.col("_first") | F.col("_last")).alias("edge"), F.count("*").alias("n"))
    return p.join(of, [TRACK, "_run"]).drop("_run", "_stop", "_first", "_last")


def stops(s: DataFrame) -> DataFrame:
    """s with unexpected_stop: a stop longer than its zone allows, that is not the beginning or end of a track nor in a place to park."""
    c = F.col
    s = _stopping(s, params.STOPPED_MPS)
    of = s.filter("_stop").groupBy(TRACK, "_run").agg(
        ((F.max("t_us") - F.min("t_us")) / 1e6).alias("stop_s"),
        F.mode(F.coalesce("zone_class", F.lit("")), True).alias("zc"),
        F.bool_or(c("_first") | c("_last")).alias("edge"),
        F.avg(F.coalesce("park", F.lit(False)).cast("double")).alias("park"),
        F.avg(F.coalesce("park_air", F.lit(False)).cast("double")).alias("park_air"),
        F.first("asset_kind").alias("kind"),
    )
    limit = F.lit(None).cast("double")
    for zone, seconds in params.STOP_LIMIT_S.items():
        limit = F.when(c("zc") == zone, seconds).otherwise(limit)
    free = (c("park") >= 0.5) | ((c("kind") == "aircraft_taxi") & (c("park_air") >= 0.5))
    of = of.withColumn("stop_limit_s", limit).filter(~c("edge") & (c("stop_s") > c("stop_limit_s")) & ~free).select(TRACK, "_run", "stop_s", "stop_limit_s")
    out = s.join(of, [TRACK, "_run"], "left")
    return out.withColumn("raw_unexpected_stop", c("_stop") & c("stop_s").isNotNull()).drop("_run", "_stop", "_first", "_last")


def behaviour(signals: DataFrame, zones: DataFrame, groups: DataFrame) -> DataFrame:
    """signals (with asset_kind) with a column for each behaviour label and behaviour_label.

    zones: zone_id, zone_class, allowed_groups ARRAY<STRING>, speed_limit_mps,
    area, ring. groups: asset_kind → group; unknown kinds have none. Labels
    that rest on the position are not raised where it is wrong.
    """
    c = F.col
    s = signals.join(groups.select("asset_kind", "group"), "asset_kind", "left")
    inside = containing(s, zones).join(s.select(TRACK, "seq", "group", "asset_kind"), [TRACK, "seq"])
    role = F.lit(False)
    for kind, allowed in params.ROLE_ZONES.items():
        role = role | ((c("asset_kind") == kind) & c("zone_class").isin(*allowed))
    inside = inside.withColumn("ok", role | F.coalesce(F.array_contains("allowed_groups", c("group")), F.lit(False)))
    other = c("zone_class") != "runway_critical"
    z = inside.groupBy(TRACK, "seq").agg(
        F.min(F.struct("area", "zone_id", "zone_class", "speed_limit_mps")).alias("small"),
        F.max(F.when(~other, c("zone_id"))).alias("runway"),
        F.bool_or(F.when(other, c("ok"))).alias("any_ok"),
        F.min(F.when(other & ~c("ok"), F.struct("area", "zone_id"))).alias("forbidden"),
        F.bool_or(c("zone_class").isin(*params.STOP_FREE)).alias("park"),
        F.bool_or(c("zone_class").isin(*params.STOP_AIRCRAFT_FREE)).alias("park_air"),
    )
    z = z.select(TRACK, "seq", "small.zone_id", "small.zone_class", "small.speed_limit_mps", "runway", "any_ok", c("forbidden.zone_id").alias("forbidden_id"), "park", "park_air")
    s = overspeed_limits(s.join(z, [TRACK, "seq"], "left"))
    critical = zones.filter("zone_class = 'runway_critical'").select("allowed_groups").collect()  # a few zones
    allowed = sorted(set.intersection(*[set(r[0] or ()) for r in critical])) if critical else []
    known = c("group").isNotNull()
    s = long_runs(s, c("v5") > c("threshold_mps"), params.OVERSPEED_MIN_RUN, "raw_overspeed")
    s = long_runs(s, c("runway").isNotNull() & known & (~c("group").isin(allowed) if allowed else F.lit(True)), params.ZONE_MIN_RUN, "raw_runway_incursion")
    s = long_runs(s, known & ~c("any_ok"), params.ZONE_MIN_RUN, "raw_unauthorized_zone")
    s = stops(s).join(proximity(s), [TRACK, "seq"], "left")
    s = long_runs(s, c("prox_m") < params.PROXIMITY_M, params.ZONE_MIN_RUN, "raw_aircraft_proximity").withColumn("raw_wrong_way", F.lit(False))
    final = {b: c(f"raw_{b}") & ~c("position_wrong") & (~c("implausible_speed") if b == "overspeed" else F.lit(True)) for b in params.BEHAVIOUR_LABELS}
    s = s.withColumns(final).withColumns({"zone_id": F.coalesce("forbidden_id", "zone_id")})
    return s.withColumn("behaviour_label", first_label(params.BEHAVIOUR_LABELS))


def attach_trust(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """samples with trust_state and integrity of the next verdict of their track, or of the last before, where none follows.

    Both sides stand in one order of time, so a window replaces an as-of join.
    """
    v = verdicts.select(TRACK, F.expr("CAST(round(t_end * 1000000) AS BIGINT)").alias("t_us"), F.struct("trust_state", "integrity").alias("_v"))
    rows = samples.select(TRACK, "seq", "t_us").withColumn("_row", F.lit(True)).unionByName(v, allowMissingColumns=True)
    at = F.when(F.col("_v").isNotNull(), F.struct("t_us", "_v"))
    grows = lambda order: Window.partitionBy(TRACK).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    next_, last = F.min(at).over(grows(F.desc("t_us"))), F.max(at).over(grows("t_us"))
    found = rows.withColumn("_found", F.coalesce(next_, last)["_v"]).filter("_row").select(TRACK, "seq", c_("trust_state"), c_("integrity"))
    return samples.join(found, [TRACK, "seq"], "left")


def c_(name: str) -> Column:
    return F.col(f"_found.{name}").alias(name)


def sample_cause(labelled: DataFrame) -> DataFrame:
    """labelled with cause: the signal label's, else behavioural where a behaviour label holds, else plausible."""
    cause = F.when(F.col("behaviour_label") != "", "behavioral_anomaly").otherwise("plausible") if "behaviour_label" in labelled.columns else F.lit("plausible")
    for label, name in params.SIGNAL_CAUSE.items():
        cause = F.when(F.col("signal_label") == label, name).otherwise(cause)
    return labelled.withColumn("cause", cause)


def report(labelled: DataFrame) -> DataFrame:
    """Counts and shares of label pairs."""
    g = labelled.groupBy("signal_label", "behaviour_label").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("signal_label")))


#: Which injected cause and mode each label should find.
EQUIVALENT = {
    "position_jump": ("technical_error", "jump"),
    "frozen_position": ("technical_error", "freeze"),
    "fix_loss": ("technical_error", "loss"),
    "multipath_noise": ("degraded", None),
    "gnss_drift": ("gnss_anomaly", None),
}


def synthetic_eval(labelled: DataFrame, events: DataFrame) -> DataFrame:
    """(label, flagged, true, tp, precision, recall) of signal labels against what was injected; the mode comes from the event's parameters."""
    modes = events.select(F.col("event_id").alias("label_event_id"), F.get_json_object("params_json", "$.mode").alias("mode"))
    s = labelled.join(modes, "label_event_id", "left")
    rows = []
    for label, (cause, mode) in EQUIVALENT.items():
        truth = (F.col("label_cause") == cause) & (F.lit(True) if mode is None else F.coalesce(F.col("mode") == mode, F.lit(False)))
        rows.append(F.struct(F.lit(label).alias("label"), F.col(label).alias("flag"), truth.alias("truth")))
    e = s.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    g = e.groupBy("label").agg(F.count_if("flag").alias("flagged"), F.count_if("truth").alias("true"), F.count_if(F.col("flag") & F.col("truth")).alias("tp"))
    return g.withColumns({"precision": F.round(F.try_divide("tp", "flagged"), 4), "recall": F.round(F.try_divide("tp", "true"), 4)})

"""Sliding windows, open on the left: window k of a track holds the fixes in (k*stride - window, k*stride].

Windows run from the first to the last grid time of a track, empty ones too.
Fixes are aggregated once into buckets of a stride; windows, baselines and the
last fix are frames over a track's buckets, so a track's features take one
shuffle and one pass whatever the window and the baseline are. Where a single
aggregation of windows is asked for, members() explodes fixes instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywarden import params, registry
from waywarden.functions import geo
from waywarden.operators.fixes import fix_level
from waywarden.params import Timing

TRACK = "track_id"


def first_k(timing: Timing, t_us: str = "t_us") -> Column:
    """The first window that holds a time: the ceiling of time over stride."""
    return F.expr(f"CAST(-floor(-{t_us} / {timing.us('stride')}.0D) AS BIGINT)")


def grid(points: DataFrame, timing: Timing = Timing(), until_us: int | None = None) -> DataFrame:
    """(track_id, k, end_us): every grid time from a track's first fix to its last, or to until_us."""
    ends = points.groupBy(TRACK).agg(F.min("t_us").alias("t0"), F.max("t_us").alias("t1"))
    if until_us is not None:
        ends = ends.withColumn("t1", F.greatest("t1", F.lit(until_us)))
    ks = F.explode(F.sequence(first_k(timing, "t0"), first_k(timing, "t1")))
    return ends.select(TRACK, ks.alias("k")).withColumn("end_us", F.col("k") * timing.us("stride"))


def members(points: DataFrame, timing: Timing = Timing(), last: bool = True) -> DataFrame:
    """points once for each window that holds them; with last, not beyond the track's last window."""
    out = points
    if last:
        out = out.withColumn("_t1", F.max("t_us").over(Window.partitionBy(TRACK)))
    ks = F.explode(F.sequence(first_k(timing), first_k(timing) + timing.strides - 1))
    out = out.select("*", ks.alias("k"))
    return out.filter(F.col("k") <= first_k(timing, "_t1")).drop("_t1") if last else out


def with_grid(aggregated: DataFrame, points: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """Every window of every track; an aggregate's columns are null where the window is empty."""
    return grid(points, timing).join(aggregated, [TRACK, "k"], "left")


def latest(value: Column, by: str) -> Column:
    """A payload at the largest value, the latest fix on ties; null where no value is known."""
    at = F.when(F.col(by).isNotNull(), F.struct(F.col(by), F.col("t_us"), F.col("seq"), value.alias("v")))
    return F.max(at)["v"]


MEANS = {"kin_speed_resid_mean": "resid", "kin_course_resid_mean": "course_resid", "tmp_frozen_frac": "frozen", "sig_degraded_frac": "degraded"}
MAXIMA = {
    "kin_speed_resid_max": "resid",
    "kin_speed_resid_rel_max": "resid_rel",
    "kin_speed_ratio_max": "speed_ratio",
    "kin_accel_ratio_max": "accel_ratio",
    "kin_turn_rate_ratio_max": "turn_ratio",
    "kin_turn_rate_imp_ratio_max": "turn_imp_ratio",
    "kin_turn_radius_ratio_max": "radius_ratio",
    "kin_vrate_ratio_max": "vrate_ratio",
    "kin_vrate_imp_ratio_max": "vrate_imp_ratio",
    "kin_course_resid_max": "course_resid",
    "kin_heading_course_diff_max": "heading_diff",
    "sig_alt_div_rate_max": "alt_div_rate",
    "tmp_frozen_run_s": "frozen_s",
    "gap": "dt_prev",
}
#: What medians are taken of: (name, column), kept as lists in a bucket.
LISTS = {"dts": "dt_prev", "nacps": "nacp", "nics": "nic", "divs": "alt_div"}
LAST = ("lat", "lon", "alt_baro_m", "alt_geom_m", "gs_mps", "track_deg", "ground", "kin_checks", "limit", "asset_id", "domain", "asset_class")


def buckets(fixes: DataFrame, timing: Timing = Timing()) -> DataFrame:
    """(track_id, k) with the partial values of the fixes in ((k - 1) * stride, k * stride], for buckets that hold any.

    Every window and every baseline is a whole number of buckets, so all that is
    known of windows follows from these rows. Moments of positions are in
    degrees from the track's first fix and of times from the bucket's end.
    """
    w = Window.partitionBy(TRACK)
    f = fixes.withColumn("k", first_k(timing)).withColumn("_at", F.min(F.struct("t_us", "seq", "lat", "lon")).over(w))
    u = (F.col("t_us") - F.col("k") * timing.us("stride")) / float(timing.us("window"))
    f = f.withColumns({"_u": u, "_y": F.col("lat") - F.col("_at.lat"), "_x": F.expr(geo.wrap180("lon - _at.lon"))})
    stamp = [F.col("t_us"), F.col("seq")]
    sums = {f"s{i}": F.sum(F.pow("_u", F.lit(i))) for i in range(5)} | {f"{v}{i}": F.sum(F.col(f"_{v}") * F.pow("_u", F.lit(i))) for v in "xy" for i in range(3)} | {f"{v}{v}": F.sum(F.col(f"_{v}") * F.col(f"_{v}")) for v in "xy"}
    return f.groupBy(TRACK, "k").agg(
        *[F.max(c).alias(c) for c in sorted(set(MAXIMA.values()))],
        *[F.sum(c).alias(f"sum_{c}") for c in MEANS.values()],
        *[F.count(c).alias(f"n_{c}") for c in MEANS.values()],
        *[F.collect_list(c).alias(name) for name, c in LISTS.items()],
        F.count("*").alias("n"),
        F.sum("dup").alias("dups"),
        F.sum("nonmono").alias("nonmonos"),
        F.min("nacp").alias("nacp_min"),
        F.min("sil").alias("sil_min"),
        F.min("alt_div").alias("div_min"),
        F.max("alt_div").alias("div_max"),
        _best(F.struct("v_imp", "v_rep"), "resid").alias("at_resid"),
        _best(F.col("limit"), "speed_ratio").alias("at_speed"),
        F.max(F.struct(*stamp, *LAST)).alias("last"),
        F.max(F.when(F.col("callsign").isNotNull(), F.struct(*stamp, "callsign"))).alias("said"),
        F.min(F.struct(*stamp, "lat", "dt_prev")).alias("first"),
        *[v.alias(f"m_{c}") for c, v in sums.items()],
    )


def _best(value: Column, by: str) -> Column:
    return F.max(F.when(F.col(by).isNotNull(), F.struct(F.col(by), F.col("t_us"), F.col("seq"), value.alias("v"))))


def filled(b: DataFrame, timing: Timing = Timing(), until_us: int | None = None) -> DataFrame:
    """Buckets with a row for each grid time from a track's first fix to its last, or to until_us while its last fix is not older than the gap."""
    upto = F.lead("k").over(Window.partitionBy(TRACK).orderBy("k")) - 1
    last = F.col("k")
    if until_us is not None:
        active = F.floor((F.col("last.t_us") + timing.us("gap")) / timing.us("stride")).cast("long")
        last = F.greatest(last, F.least(F.lit(until_us // timing.us("stride")).cast("long"), active))
    g = b.withColumn("_k", F.coalesce(upto, last)).withColumn("_at", F.explode(F.sequence("k", F.col("_k"))))
    own = F.col("_at") == F.col("k")
    return g.select(TRACK, *[F.when(own, F.col(c)).alias(c) for c in b.columns if c not in (TRACK, "k")], F.col("_at").alias("k"))


def _median(values: Column) -> Column:
    """Of a sorted list."""
    n = F.size(values)
    return F.when(n > 0, (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2)


def _median_but(values: Column, one: Column) -> Column:
    """Of a sorted list without one of its values; of all where that value is null."""
    n = F.size(values) - F.when(one.isNull(), 0).otherwise(1)
    at = F.when(one.isNull(), F.size(values)).otherwise(F.array_position(values, one) - 1)
    pick = lambda i: F.get(values, (i + F.when(i < at, 0).otherwise(1)).cast("int"))
    return F.when(n > 0, (pick(F.floor((n - 1) / 2)) + pick(F.floor(n / 2))) / 2)


MOMENTS = [f"s{i}" for i in range(5)] + [f"{v}{i}" for v in "xy" for i in range(3)] + ["xx", "yy"]


def _jitter(timing: Timing) -> Column:
    """The moments of a window as a struct, from those of its buckets, m0 (its own) to the one strides - 1 before.

    RMS distance of a window's positions from a fit quadratic in time: the
    buckets' moments are shifted to the window's end and added; the residual
    does not depend on where positions count from, so degrees from the track's
    first fix do, scaled to metres at the window's first fix. The 3x3 system is
    solved in columns.
    """
    total: dict[str, list[str]] = {c: [] for c in MOMENTS}
    for j in range(timing.strides):
        for c in MOMENTS:
            power = int(c[1]) if c[1].isdigit() else 0
            for q in range(power + 1):
                factor = math.comb(power, q) * (-j / timing.strides) ** (power - q)
                if factor:
                    total[c].append(f"{factor!r}D * coalesce(m{j}.m_{c[0]}{q if c[1].isdigit() else c[1]}, 0.0D)")
    return F.expr("named_struct(" + ", ".join(f"'{c}', {' + '.join(terms)}" for c, terms in total.items()) + ")")


def _residual() -> Column:
    """Jitter in metres from jm, the moments of a window, and head, its first fix; null below 5 fixes."""
    m = lambda c: f"jm.{c}"
    s = [m(f"s{i}") for i in range(5)]
    det = f"({s[0]} * ({s[2]} * {s[4]} - {s[3]} * {s[3]}) - {s[1]} * ({s[1]} * {s[4]} - {s[2]} * {s[3]}) + {s[2]} * ({s[1]} * {s[3]} - {s[2]} * {s[2]}))"
    inverse = [
        [f"{s[2]} * {s[4]} - {s[3]} * {s[3]}", f"{s[2]} * {s[3]} - {s[1]} * {s[4]}", f"{s[1]} * {s[3]} - {s[2]} * {s[2]}"],
        [f"{s[2]} * {s[3]} - {s[1]} * {s[4]}", f"{s[0]} * {s[4]} - {s[2]} * {s[2]}", f"{s[1]} * {s[2]} - {s[0]} * {s[3]}"],
        [f"{s[1]} * {s[3]} - {s[2]} * {s[2]}", f"{s[1]} * {s[2]} - {s[0]} * {s[3]}", f"{s[0]} * {s[2]} - {s[1]} * {s[1]}"],
    ]
    rest = {v: f"({m(v + v)} - (" + " + ".join(f"({inverse[i][j]}) * ({m(f'{v}{i}')} * {m(f'{v}{j}')})" for i in range(3) for j in range(3)) + f") / {det})" for v in "xy"}
    s2 = "pow(sin(radians(head.lat)), 2)"
    prime = f"({geo.A!r} / sqrt(1 - {geo.E2!r} * {s2}))"
    east, north = f"(radians(1) * {prime} * cos(radians(head.lat)))", f"(radians(1) * {prime} * {1 - geo.E2!r} / (1 - {geo.E2!r} * {s2}))"
    good = f"{s[0]} >= {params.MIN_JITTER_POINTS} AND abs({det}) > 1e-12 * pow(greatest({s[0]}, 1.0D), 3)"
    return F.expr(f"CASE WHEN {good} THEN sqrt(greatest(0.0D, {rest['x']} * {east} * {east} + {rest['y']} * {north} * {north}) / {s[0]}) END")


def window_level(fixes: DataFrame, timing: Timing = Timing(), until_us: int | None = None) -> DataFrame:
    """Kinetic, temporal and signal features and the context columns of every window of every track.

    One pass over the buckets in order of time: frames of `strides` buckets are
    the windows, the frame before them the baseline, all buckets so far give the
    last fix. What a query does not ask for is pruned from the frames and from
    the buckets. With until_us silent tracks get windows up to that time, though
    not beyond the gap.
    """
    order = Window.partitionBy(TRACK).orderBy("k")
    held, up_to = order.rowsBetween(-(timing.strides - 1), 0), order.rowsBetween(Window.unboundedPreceding, 0)
    span = timing.us("baseline") // timing.us("stride")
    base = order.rowsBetween(-(timing.strides + span - 1), -timing.strides)
    merged = lambda c, w: F.array_sort(F.flatten(F.collect_list(c).over(w)))
    c = F.col
    w = filled(buckets(fixes, timing), timing, until_us).withColumns({
        **{f: F.max(x).over(held) for f, x in MAXIMA.items()},
        **{f: F.try_divide(F.sum(f"sum_{x}").over(held), F.sum(f"n_{x}").over(held)) for f, x in MEANS.items()},
        **{f"w_{x}": F.sum(x).over(held) for x in ("n", "dups", "nonmonos")},
        **{f"w_{x}": merged(x, held) for x in ("dts", "nacps", "nics")},
        **{f"b_{x}": merged(x, base) for x in LISTS},
        "sig_nacp_min": F.min("nacp_min").over(held),
        "sig_sil_min": F.min("sil_min").over(held),
        "w_div_min": F.min("div_min").over(held),
        "w_div_max": F.max("div_max").over(held),
        "w_resid": F.max("at_resid").over(held),
        "w_speed": F.max("at_speed").over(held),
        "w_last": F.max("last").over(up_to),
        "w_said": F.max("said").over(up_to),
        "b_first": F.min("first").over(base),
        "head": F.min("first").over(held),
        **{f"m{j}": F.lag(F.struct(*[f"m_{c}" for c in MOMENTS]), j).over(order) if j else F.struct(*[f"m_{c}" for c in MOMENTS]) for j in range(timing.strides)},
    }).withColumn("jm", _jitter(timing))
    end_us = c("k") * timing.us("stride")
    old = F.coalesce(end_us - timing.us("window") - c("b_first.t_us") >= timing.us("history"), F.lit(False))
    w = w.withColumns({
        "stale": (end_us - c("w_last.t_us")) / 1e6,
        "dt": _median(c("w_dts")),
        "sig_nacp_median": _median(c("w_nacps")),
        "sig_nic_median": _median(c("w_nics")),
        "base_nacp": F.when(old, _median(c("b_nacps"))),
        "base_nic": F.when(old, _median(c("b_nics"))),
        "base_div": F.when(old, _median(c("b_divs"))),
        # the first baseline fix's interval reaches back beyond the baseline
        "base_dt": F.when(old, _median_but(c("b_dts"), c("b_first.dt_prev"))),
    })
    envelope = lambda name: F.when(c("w_last.kin_checks"), c(name))
    drop = lambda a, b: F.when((c(a) - c(b)).isNotNull(), F.greatest(c(a) - c(b), F.lit(0.0)))
    out = w.withColumns({
        "t_end": end_us / 1e6,
        "t_start": (end_us - timing.us("window")) / 1e6,
        "kin_accel_imp_ratio_max": F.lit(None).cast("double"),
        "kin_pos_jitter_m": _residual(),
        "tmp_n_points": F.coalesce("w_n", F.lit(0)).cast("double"),
        "tmp_gap_max_s": F.greatest(c("gap"), c("stale")),
        "tmp_staleness_s": c("stale"),
        "tmp_dt_dev_ratio": F.when(c("base_dt") > 0, F.abs(c("dt") - c("base_dt")) / c("base_dt")),
        "tmp_dup_count": F.coalesce("w_dups", F.lit(0)).cast("double"),
        "tmp_nonmono_count": F.coalesce("w_nonmonos", F.lit(0)).cast("double"),
        "sig_nacp_drop": drop("base_nacp", "sig_nacp_median"),
        "sig_nic_drop": drop("base_nic", "sig_nic_median"),
        "sig_degraded_majority": (c("sig_degraded_frac") > 0.5).cast("double"),
        # the largest distance from a value is at one of the ends
        "sig_alt_div_dev_max_m": F.when(c("base_div").isNotNull() & c("w_div_min").isNotNull(), F.greatest(F.abs(c("w_div_max") - c("base_div")), F.abs(c("w_div_min") - c("base_div")))),
        **{f: envelope(f) for f in registry.ENVELOPE_RATIOS if f in MAXIMA},
        "aux_asset_id": c("w_last.asset_id"),
        "aux_domain": c("w_last.domain"),
        "aux_asset_class": c("w_last.asset_class"),
        "aux_callsign": c("w_said.callsign"),
        "aux_lat": c("w_last.lat"),
        "aux_lon": c("w_last.lon"),
        "aux_alt_m": F.coalesce("w_last.alt_baro_m", "w_last.alt_geom_m"),
        "aux_gs_mps": c("w_last.gs_mps"),
        "aux_track_deg": c("w_last.track_deg"),
        "aux_airborne": ~c("w_last.ground"),
        "aux_speed_implied_mps": c("w_resid.v.v_imp"),
        "aux_speed_reported_mps": c("w_resid.v.v_rep"),
        "aux_class_max_speed_mps": F.coalesce("w_speed.v", "w_last.limit"),
    })
    features = registry.names("kinetic", "temporal", "signal")
    return out.select(TRACK, "k", "t_start", "t_end", *features, *[a for a in registry.AUX if a in out.columns])


def window_features(points: DataFrame, timing: Timing = Timing(), until_us: int | None = None) -> DataFrame:
    """points to features, without the map's."""
    return window_level(fix_level(points, timing), timing, until_us)

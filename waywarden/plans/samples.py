"""Queries over single samples: detectors, their labels and reports; each with the SQL that checks it, where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from waywarden import params
from waywarden.functions import geo
from waywarden.operators import detectors
from waywarden.plans import area
from waywarden.plans.adaptor import PTS, points

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Samples a few seconds apart: the events' clock runs 20,000 times as fast, assets go north at 5.5 m/s with some metres
# of noise, stand still in every fifth ten seconds, and are 55 m off in every 23rd sample.
FAST = 20_000
STILL = "floor(s / 10) % 5 = 0"
MADE = {
    "lat": f"41.8 + CAST(5e-5 AS DOUBLE) * CASE WHEN {STILL} THEN floor(s / 10) * 10 ELSE s + CAST(seq * 37 % 90 AS DOUBLE) / 90 END + CASE WHEN seq % 23 = 0 THEN CAST(5e-4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "lon": f"12.25 + CASE WHEN {STILL} THEN CAST(0 AS DOUBLE) ELSE CAST(seq * 91 % 100 AS DOUBLE) / 1e7 END",
    "gs_mps": "CAST(seq * 29 % 140 AS DOUBLE) / 10",
    "heading_deg": "CAST(seq * 59 % 360 AS DOUBLE) + 0.75",
    "alt_geom_m": "CASE WHEN seq % 11 > 0 THEN CAST(50 + seq * 17 % 25 AS DOUBLE) END",
}
SMP = f"smp AS (SELECT * REPLACE ({', '.join(f'{x} AS {c}' for c, x in MADE.items())}) FROM (SELECT * REPLACE (t_us // {FAST} AS t_us), (t_us // {FAST} - 85203360000) / 1e6 AS s FROM pts))"


def samples(spark, d):
    p = points(spark, d).withColumn("t_us", F.expr(f"t_us div {FAST}")).withColumn("s", F.expr("(t_us - 85203360000) / 1e6"))
    return p.withColumns({c: F.expr(x.replace("41.8 +", "41.8D +").replace("12.25 +", "12.25D +").replace("1e7", "1e7D").replace("0.75", "0.75D")) for c, x in MADE.items()})


OF = "PARTITION BY track_id ORDER BY t_us, seq"
GAP = f"{params.DETECT_GAP_S}"
KIN = f"""pau AS (SELECT *, (t_us - lag(t_us) OVER ({OF})) / 1e6 AS pause, first_value(lat) OVER ({OF}) AS lat0, first_value(lon) OVER ({OF}) AS lon0 FROM smp),
kin AS (SELECT *, CAST(sum(CASE WHEN coalesce(pause, 0) > {GAP} THEN 1 ELSE 0 END) OVER ({OF} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS part, {geo.east_m("lat0", "lon0", "lat", "lon")} AS x, {geo.north_m("lat0", "lat")} AS y FROM pau)"""


def look(name: str, back: int, ahead: int) -> str:
    """Both neighbours of each sample at least so many microseconds away, by joins on time."""
    return f"""{name} AS (SELECT k.*, b.t_us AS b_t, b.x AS b_x, b.y AS b_y, a.t_us AS a_t, a.x AS a_x, a.y AS a_y FROM kin k
 ASOF LEFT JOIN kin b ON b.track_id = k.track_id AND b.part = k.part AND k.t_us - {back} >= b.t_us ASOF LEFT JOIN kin a ON a.track_id = k.track_id AND a.part = k.part AND k.t_us + {ahead} <= a.t_us)"""


V5 = f"""{look("half", 2_500_000, 2_500_000)}, five AS (SELECT *, CASE WHEN (a_t - b_t) / 1e6 >= 5 - 1e-9 THEN sqrt(pow(a_x - b_x, 2) + pow(a_y - b_y, 2)) END AS cd, (a_t - b_t) / 1e6 AS cdt FROM half)"""


@query("centred_speed", f"WITH {PTS}, {SMP}, {KIN}, {V5} SELECT track_id, seq, part, round(cd, 6) AS cd, round(cd / cdt, 6) AS v5 FROM five")
def centred_speed(spark, d):
    return detectors.kinematics(samples(spark, d)).select("track_id", "seq", "part", F.round("cd", 6).alias("cd"), F.round("v5", 6).alias("v5"))


@query("fix_loss", f"""WITH {PTS}, {SMP}, {KIN}, g AS (SELECT *, lead(pause) OVER ({OF}) AS ahead FROM kin)
SELECT track_id, seq, coalesce(CASE WHEN ahead > {GAP} THEN ahead END, CASE WHEN pause > {GAP} THEN pause END) AS gap_s, coalesce(ahead > {GAP}, false) OR coalesce(pause > {GAP}, false) AS fix_loss FROM g""")
def fix_loss(spark, d):
    return detectors.fix_loss(detectors.kinematics(samples(spark, d))).select("track_id", "seq", "gap_s", "fix_loss")


INNOVATION = f"""{look("far", 5_000_000, 5_000_000)}, prv AS (SELECT *, lag(t_us) OVER w AS p_t, lag(x) OVER w AS p_x, lag(y) OVER w AS p_y, lag(b_t) OVER w AS pb_t, lag(b_x) OVER w AS pb_x, lag(b_y) OVER w AS pb_y FROM far WINDOW w AS (PARTITION BY track_id, part ORDER BY t_us, seq)),
dif AS (SELECT *, x - p_x AS dx, y - p_y AS dy, (t_us - p_t) / 1e6 AS dt FROM prv),
lr AS (SELECT *, sqrt(pow(dx - (p_x - pb_x) / ((p_t - pb_t) / 1e6) * dt, 2) + pow(dy - (p_y - pb_y) / ((p_t - pb_t) / 1e6) * dt, 2)) AS l, sqrt(pow(dx - (a_x - x) / ((a_t - t_us) / 1e6) * dt, 2) + pow(dy - (a_y - y) / ((a_t - t_us) / 1e6) * dt, 2)) AS r FROM dif),
inn AS (SELECT *, CASE WHEN l IS NULL OR r < l THEN r ELSE l END AS step FROM lr)"""


@query("step_innovation", f"WITH {PTS}, {SMP}, {KIN}, {INNOVATION} SELECT track_id, seq, round(step, 6) AS step FROM inn")
def step_innovation(spark, d):
    return detectors.innovation(detectors.kinematics(samples(spark, d))).select("track_id", "seq", F.round("step", 6).alias("step"))


@query("centered_median", f"""WITH {PTS}, {SMP}, {KIN}, {INNOVATION}
SELECT track_id, seq, CASE WHEN count(step) OVER w >= 6 THEN round(median(step) OVER w, 6) END AS med FROM inn WINDOW w AS (PARTITION BY track_id, part ORDER BY t_us, seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def centered_median(spark, d):
    k = detectors.innovation(detectors.kinematics(samples(spark, d)))
    return k.select("track_id", "seq", F.round(detectors.centred_median(F.col("step"), params.MULTIPATH_WINDOW), 6).alias("med"))


@query("run_length_filter", f"""WITH {PTS}, {SMP}, {KIN}, m AS (SELECT *, gs_mps > 4 AS hit FROM kin),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id, part ORDER BY t_us, seq) - row_number() OVER (PARTITION BY track_id, part, hit ORDER BY t_us, seq) AS island FROM m)
SELECT track_id, seq, hit AND count(*) OVER (PARTITION BY track_id, part, hit, island) >= 3 AS fast FROM r""")
def run_length_filter(spark, d):
    return detectors.long_runs(detectors.kinematics(samples(spark, d)), F.col("gs_mps") > 4, 3, "fast").select("track_id", "seq", "fast")


# runs of one position; what was before and what comes after them shows whether the asset moved
FROZEN = f"""sm AS (SELECT *, coalesce(lat = lag(lat) OVER w AND lon = lag(lon) OVER w, false) AS same, lead(t_us) OVER w AS n_t, lead(x) OVER w AS n_x, lead(y) OVER w AS n_y, lead(a_t) OVER w AS na_t, lead(a_x) OVER w AS na_x, lead(a_y) OVER w AS na_y FROM far WINDOW w AS (PARTITION BY track_id, part ORDER BY t_us, seq)),
rn AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY track_id, part ORDER BY t_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM sm),
ru AS (SELECT track_id, part, run, count(*) - 1 AS n, (max(t_us) - min(t_us)) / 1e6 AS dur, max(gs_mps) FILTER (same) AS gs, arg_min({{'x': x, 'y': y, 't': t_us, 'bx': b_x, 'by': b_y, 'bt': b_t}}, (t_us, seq)) AS a, arg_max({{'x': coalesce(na_x, n_x), 'y': coalesce(na_y, n_y), 't': coalesce(na_t, n_t)}}, (t_us, seq)) AS b FROM rn GROUP BY ALL),
rv AS (SELECT *, greatest(gs, sqrt(pow(a.x - a.bx, 2) + pow(a.y - a.by, 2)) / ((a.t - a.bt) / 1e6), sqrt(pow(b.x - a.x, 2) + pow(b.y - a.y, 2)) / ((b.t - a.t) / 1e6)) AS moving FROM ru),
fz AS (SELECT r.track_id, r.part, r.seq, r.t_us, same AND n > 0 AND dur >= {params.FROZEN_MIN_S} AND coalesce(moving >= {params.MOVING_MPS}, false) AS frozen_position, dur, moving FROM rn r JOIN rv USING (track_id, part, run))"""


@query("frozen_position", f"WITH {PTS}, {SMP}, {KIN}, {look('far', 5_000_000, 5_000_000)}, {FROZEN} SELECT track_id, seq, frozen_position, CASE WHEN frozen_position THEN round(dur, 6) END AS frozen_s, CASE WHEN frozen_position THEN round(moving, 6) END AS moving_mps FROM fz")
def frozen_position(spark, d):
    k = detectors.frozen(detectors.innovation(detectors.kinematics(samples(spark, d))))
    return k.select("track_id", "seq", "frozen_position", F.round("frozen_s", 6).alias("frozen_s"), F.round("moving_mps", 6).alias("moving_mps"))


@query("altitude_spike", f"WITH {PTS}, {SMP} SELECT track_id, seq, abs(alt_geom_m - median(alt_geom_m) OVER (PARTITION BY track_id)) AS alt_dev_m, coalesce(abs(alt_geom_m - median(alt_geom_m) OVER (PARTITION BY track_id)) > {params.ALT_SPIKE_M}, false) AS altitude_spike FROM smp")
def altitude_spike(spark, d):
    return signals(spark, d).select("track_id", "seq", "alt_dev_m", "altitude_spike")


def signals(spark, d):
    return detectors.signal(samples(spark, d))


@query("heading_fold", f"""WITH {PTS}, {SMP}, {KIN}, {V5}, h AS (SELECT *, abs({geo.wrap180("heading_deg - " + geo.wrap360("degrees(atan2(a_x - b_x, a_y - b_y))"))}) AS off FROM five)
SELECT track_id, seq, CASE WHEN cd >= {params.HEADING_MIN_DISP_M} THEN round(least(off, 180 - off), 6) END AS heading_diff_deg FROM h""")
def heading_fold(spark, d):
    return signals(spark, d).select("track_id", "seq", F.round("heading_diff_deg", 6).alias("heading_diff_deg"))


# greedy pairing and what follows from it has no SQL; tests hold them against brute force
@query("signal_labels", None)
def signal_labels(spark, d):
    return signals(spark, d).select("track_id", "seq", *params.SIGNAL_LABELS, "position_wrong", "signal_label")


NAMED = {label: f"seq % {3 + 2 * i} = 0" for i, label in enumerate(params.SIGNAL_LABELS)}


@query("label_precedence", f"WITH {PTS}, n AS (SELECT track_id, seq, {', '.join(f'{x} AS {c}' for c, x in NAMED.items())} FROM pts), l AS (SELECT *, CASE {' '.join(f'WHEN {c} THEN {chr(39)}{c}{chr(39)}' for c in params.SIGNAL_LABELS)} ELSE '' END AS signal_label FROM n) SELECT track_id, seq, signal_label, CASE signal_label {' '.join(f'WHEN {chr(39)}{c}{chr(39)} THEN {chr(39)}{x}{chr(39)}' for c, x in params.SIGNAL_CAUSE.items())} ELSE 'plausible' END AS cause FROM l")
def label_precedence(spark, d):
    n = points(spark, d).withColumns({c: F.expr(x) for c, x in NAMED.items()})
    return detectors.sample_cause(n.withColumn("signal_label", detectors.first_label(params.SIGNAL_LABELS))).select("track_id", "seq", "signal_label", "cause")


# ---------------------------------------------------------------- behaviour

KIND = "CASE event_type WHEN 'view' THEN 'aircraft_taxi' WHEN 'signup' THEN 'aircraft_taxi' WHEN 'click' THEN 'pushback_tug' WHEN 'purchase' THEN 'bus' ELSE 'fuel_truck' END"
ZONE = "CASE seq % 4 WHEN 0 THEN 'runway_critical' WHEN 1 THEN 'taxi_corridor' WHEN 2 THEN 'apron' END"
LIMIT = "CASE seq % 4 WHEN 0 THEN CAST(2 AS DOUBLE) WHEN 1 THEN CAST(9 AS DOUBLE) WHEN 2 THEN CAST(0.5 AS DOUBLE) END"


def judged(spark, d):
    """Samples as behaviour rules take them, with made speeds and zones."""
    s = samples(spark, d)
    return s.withColumns({"asset_kind": F.expr(KIND), "v5": F.expr("CASE WHEN seq % 9 > 0 THEN gs_mps END"), "position_wrong": F.expr("seq % 13 = 0"), "zone_class": F.expr(ZONE), "speed_limit_mps": F.expr(LIMIT)})


JDG = f"jdg AS (SELECT *, {KIND} AS asset_kind, CASE WHEN seq % 9 > 0 THEN gs_mps END AS v5, seq % 13 = 0 AS position_wrong, {ZONE} AS zone_class, {LIMIT} AS speed_limit_mps FROM smp)"


@query("overspeed_limits", f"""WITH {PTS}, {SMP}, {JDG}, b AS (SELECT zone_class, avg(CAST(v5 > speed_limit_mps AS DOUBLE)) AS above, quantile_cont(v5, {params.OVERSPEED_BULK_Q}) AS bulk FROM jdg WHERE v5 IS NOT NULL AND speed_limit_mps IS NOT NULL GROUP BY ALL)
SELECT track_id, seq, CASE WHEN speed_limit_mps IS NOT NULL THEN round(greatest(speed_limit_mps * {1 + params.OVERSPEED_TOL}, CASE WHEN above > {1 - params.OVERSPEED_BULK_Q} THEN bulk END), 9) END AS threshold_mps FROM jdg LEFT JOIN b USING (zone_class)""")
def overspeed_limits(spark, d):
    return detectors.overspeed_limits(judged(spark, d)).select("track_id", "seq", F.round("threshold_mps", 9).alias("threshold_mps"))


EXEMPT = ", ".join(f"'{k}'" for k in params.PROXIMITY_EXEMPT)


@query("proximity_same_second", f"""WITH {PTS}, {SMP}, {JDG}, j AS (SELECT v.track_id, v.seq, a.asset_id, {geo.distance_m("v.lat", "v.lon", "a.lat", "a.lon")} AS dist FROM jdg v JOIN jdg a ON v.t_us // 1000000 = a.t_us // 1000000
 WHERE v.domain = 'vehicle' AND v.asset_kind NOT IN ({EXEMPT}) AND a.asset_kind = 'aircraft_taxi' AND a.v5 >= {params.MOVING_MPS} AND NOT a.position_wrong),
n AS (SELECT track_id, seq, min(struct_pack(d := dist, i := asset_id)) AS n FROM j WHERE dist <= {params.PROXIMITY_M} GROUP BY ALL)
SELECT track_id, seq, round(n.d, 6) AS prox_m, n.i AS other_id FROM n""")
def proximity_same_second(spark, d):
    return detectors.proximity(judged(spark, d)).select("track_id", "seq", F.round("prox_m", 6).alias("prox_m"), "other_id")


@query("stop_runs", f"""WITH {PTS}, {SMP}, {JDG}, s AS (SELECT *, coalesce(v5 < 4, false) AS stop, lag(t_us) OVER ({OF}) IS NULL AS f, lead(t_us) OVER ({OF}) IS NULL AS l FROM jdg),
r AS (SELECT *, row_number() OVER ({OF}) - row_number() OVER (PARTITION BY track_id, stop ORDER BY t_us, seq) AS run FROM s),
g AS (SELECT track_id, run, (max(t_us) - min(t_us)) / 1e6 AS stop_s, bool_or(f OR l) AS edge, count(*) AS n FROM r WHERE stop GROUP BY ALL)
SELECT track_id, seq, stop_s, edge, n FROM r JOIN g USING (track_id, run) WHERE stop""")
def stop_runs(spark, d):
    return detectors.stop_runs(judged(spark, d), 4.0).select("track_id", "seq", "stop_s", "edge", "n")


ZONES = [(f"z{i}", ("runway_critical", "taxi_corridor", "apron", "aircraft_stand", "service_road_corridor")[i % 5], [("aircraft",), ("aircraft", "tug"), ("bus", "tug"), ()][i % 4], (2.0, None, 8.0)[i % 3], 1000.0 + 37 * i, area.ring_of(*zone[5:])) for i, zone in enumerate(area.ZONES)]
GROUPS = [("aircraft_taxi", "aircraft"), ("pushback_tug", "tug"), ("bus", "bus")]


@query("behaviour_labels", None)
def behaviour_labels(spark, d):
    """Behaviour rules over the adaptor's wide positions, with zones on a lattice."""
    p = points(spark, d).withColumn("t_us", F.expr(f"t_us div {FAST}")).withColumn("asset_kind", F.expr(KIND))
    wide = p.withColumns({"v5": F.col("gs_mps") / 4, "position_wrong": F.expr("seq % 13 = 0"), "implausible_speed": F.expr("seq % 17 = 0"), "part": F.lit(0).cast("long")})
    zones = spark.createDataFrame(ZONES, "zone_id string, zone_class string, allowed_groups array<string>, speed_limit_mps double, area double, ring array<struct<x:double,y:double>>")
    groups = spark.createDataFrame(GROUPS, "asset_kind string, `group` string")
    b = detectors.behaviour(wide, zones, groups)
    return b.select("track_id", "seq", *params.BEHAVIOUR_LABELS, "behaviour_label")


# ---------------------------------------------------------------- trust and reports


def verdict_rows(spark, d):
    """A verdict each seventh sample, between the samples."""
    p = points(spark, d).filter("seq % 7 = 3").withColumn("t_end", F.expr("(t_us + 500000) / 1e6"))
    return p.select("track_id", "t_end", F.expr("CASE seq % 3 WHEN 0 THEN 'trusted' WHEN 1 THEN 'caution' ELSE 'untrusted' END").alias("trust_state"), F.expr("CAST(seq % 101 AS DOUBLE)").alias("integrity"))


VRD = "vrd AS (SELECT track_id, t_us + 500000 AS v_us, CASE seq % 3 WHEN 0 THEN 'trusted' WHEN 1 THEN 'caution' ELSE 'untrusted' END AS trust_state, CAST(seq % 101 AS DOUBLE) AS integrity FROM pts WHERE seq % 7 = 3)"


@query("asof_forward", f"""WITH {PTS}, {VRD} SELECT p.track_id, p.seq, coalesce(a.trust_state, b.trust_state) AS trust_state, coalesce(a.integrity, b.integrity) AS integrity FROM pts p
 ASOF LEFT JOIN vrd a ON a.track_id = p.track_id AND p.t_us <= a.v_us ASOF LEFT JOIN vrd b ON b.track_id = p.track_id AND p.t_us >= b.v_us""")
def asof_forward(spark, d):
    return detectors.attach_trust(points(spark, d), verdict_rows(spark, d)).select("track_id", "seq", "trust_state", "integrity")


PAIRED = "paired AS (SELECT track_id, seq, CASE seq % 5 WHEN 0 THEN 'position_jump' WHEN 1 THEN 'fix_loss' ELSE '' END AS signal_label, CASE seq % 7 WHEN 0 THEN 'overspeed' WHEN 1 THEN 'runway_incursion' ELSE '' END AS behaviour_label FROM pts)"


@query("label_report", f"WITH {PTS}, {PAIRED}, c AS (SELECT signal_label, behaviour_label, count(*) AS n FROM paired GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY signal_label), 9) AS share FROM c")
def label_report(spark, d):
    rows = points(spark, d).withColumns({"signal_label": F.expr("CASE seq % 5 WHEN 0 THEN 'position_jump' WHEN 1 THEN 'fix_loss' ELSE '' END"), "behaviour_label": F.expr("CASE seq % 7 WHEN 0 THEN 'overspeed' WHEN 1 THEN 'runway_incursion' ELSE '' END")})
    return detectors.report(rows).select("signal_label", "behaviour_label", "n", F.round("share", 9).alias("share"))


TOLD = {label: f"seq % {4 + i} = 0" for i, label in enumerate(detectors.EQUIVALENT)}
CAUSE = "CASE seq % 4 WHEN 0 THEN 'technical_error' WHEN 1 THEN 'degraded' WHEN 2 THEN 'gnss_anomaly' ELSE 'plausible' END"
MODE = "CASE seq % 3 WHEN 0 THEN 'jump' WHEN 1 THEN 'freeze' ELSE 'loss' END"


@query("synthetic_eval", f"WITH {PTS}, t AS (SELECT *, {CAUSE} AS cause, {MODE} AS mode FROM pts), e AS ("
       + " UNION ALL ".join(f"SELECT '{label}' AS label, {TOLD[label]} AS flag, cause = '{cause}'{f' AND mode = {chr(39)}{mode}{chr(39)}' if mode else ''} AS truth FROM t" for label, (cause, mode) in detectors.EQUIVALENT.items())
       + ") SELECT label, count(*) FILTER (flag) AS flagged, count(*) FILTER (truth) AS true, count(*) FILTER (flag AND truth) AS tp, round(count(*) FILTER (flag AND truth) / nullif(count(*) FILTER (flag), 0), 4) AS precision, round(count(*) FILTER (flag AND truth) / nullif(count(*) FILTER (truth), 0), 4) AS recall FROM e GROUP BY ALL")
def synthetic_eval(spark, d):
    p = points(spark, d)
    rows = p.withColumns({c: F.expr(x) for c, x in TOLD.items()} | {"label_cause": F.expr(CAUSE), "label_event_id": F.col("seq").cast("string")})
    events = p.select(F.col("seq").cast("string").alias("event_id"), F.to_json(F.struct(F.expr(MODE).alias("mode"))).alias("params_json"))
    return detectors.synthetic_eval(rows, events)

"""Queries over single tracks: segments, fixes, windows, labels; each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from waywarden.functions import geo
from waywarden.operators import fixes, labels, scoring, segments, windows
from waywarden.params import CAUSES
from waywarden.plans.adaptor import PTS, TIMING, points

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

W, S, B, R, GAP, H = (TIMING.us(x) for x in ("window", "stride", "baseline", "rate", "gap", "history"))
T = "PARTITION BY track_id ORDER BY t_us, seq"
SO_FAR = f"{T} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
D = geo.distance_m


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def r6(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


@query("segment_tracks", f"""WITH {PTS}, g AS (SELECT track_id, seq, t_us, t_us - max(t_us) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {GAP} AS gap FROM pts)
SELECT track_id, seq, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment FROM g""")
def segment_tracks(spark, d):
    return segments.segment(points(spark, d), TIMING, "track_id", "seq").select("track_id", "seq", "segment")


@query("arrival_seq", f"WITH {PTS} SELECT track_id, seq AS arrival, row_number() OVER (PARTITION BY track_id ORDER BY seq) - 1 AS seq FROM pts")
def arrival_seq(spark, d):
    return segments.number(points(spark, d).withColumnRenamed("seq", "arrival")).select("track_id", "arrival", "seq")


@query("ffill_last", f"WITH {PTS} SELECT track_id, seq, last_value(nacp IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nacp, last_value(callsign IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS callsign FROM pts")
def ffill_last(spark, d):
    return segments.fill_forward(points(spark, d), ["nacp", "callsign"]).select("track_id", "seq", "nacp", "callsign")


@query("repair_points", f"""WITH {PTS} SELECT track_id, seq, CASE WHEN NOT coalesce(on_ground, false) AND alt IS NULL THEN NULL ELSE on_ground END AS on_ground,
CASE WHEN alt <= 20000 THEN alt END AS alt_baro_m, (track_deg * 3) % 360 AS track_deg, nullif(trim(callsign), '') AS callsign
FROM (SELECT *, CASE WHEN seq % 5 > 0 THEN alt_baro_m * 10 END AS alt FROM pts) WHERE lat BETWEEN 41.77 AND 41.84 AND lon BETWEEN 12.2 AND 12.28""")
def repair_points(spark, d):
    p = points(spark, d).withColumn("alt_baro_m", F.expr("CASE WHEN seq % 5 > 0 THEN alt_baro_m * 10 END")).withColumn("track_deg", F.col("track_deg") * 3)
    return segments.repair(p, (41.77, 12.2, 41.84, 12.28)).select("track_id", "seq", "on_ground", "alt_baro_m", "track_deg", "callsign")


@query("drop_counts", f"""WITH {PTS}, p AS (SELECT CASE WHEN seq % 17 > 0 THEN lat END AS lat, lon, t, alt_baro_m * 10 AS alt FROM pts), i AS (SELECT *, lat BETWEEN 41.77 AND 41.84 AND lon BETWEEN 12.2 AND 12.28 AS inside FROM p)
SELECT count(*) FILTER (lat IS NULL) AS missing_t_lat_lon, count(*) FILTER (lat IS NOT NULL AND NOT inside) AS outside_area, count(*) FILTER (inside AND alt > 20000) AS alt_baro_nulled_above_max FROM i""")
def drop_counts(spark, d):
    p = points(spark, d).withColumn("alt_baro_m", F.col("alt_baro_m") * 10).withColumn("lat", F.expr("CASE WHEN seq % 17 > 0 THEN lat END"))
    return segments.drop_counts(p, (41.77, 12.2, 41.84, 12.28))


@query("validate_counts", f"""WITH {PTS} SELECT count(*) FILTER (lat IS NULL) AS missing, count(*) FILTER (n > 1) AS repeated_seq, count(*) FILTER (alt > 20000) AS altitude, CAST(0 AS BIGINT) AS time
FROM (SELECT CASE WHEN seq % 17 > 0 THEN lat END AS lat, alt_baro_m * 10 AS alt, count(*) OVER (PARTITION BY track_id, seq // 2) AS n FROM pts)""")
def validate_counts(spark, d):
    p = points(spark, d).withColumns({"alt_baro_m": F.col("alt_baro_m") * 10, "alt_geom_m": F.lit(None).cast("double"), "lat": F.expr("CASE WHEN seq % 17 > 0 THEN lat END"), "seq": F.expr("seq div 2")})
    return segments.violations(p)


@query("classify_types", f"""WITH {PTS}, ty(typecode, size_class) AS (VALUES ('B738', 'narrowbody'), ('C172', 'light')), ov(icao24, typecode) AS (VALUES ('U3', 'C172'), ('u5', 'ZZZZ'))
SELECT p.track_id, p.seq, ov.icao24 IS NOT NULL AS type_overridden, coalesce(ov.typecode, p.typecode_raw) AS typecode, coalesce(ty.size_class, 'other') AS asset_class
FROM pts p LEFT JOIN ov ON lower(ov.icao24) = lower(p.asset_id) LEFT JOIN ty ON ty.typecode = coalesce(ov.typecode, p.typecode_raw)""")
def classify_types(spark, d):
    types = spark.createDataFrame([("B738", "narrowbody"), ("C172", "light")], "typecode string, size_class string")
    over = spark.createDataFrame([("U3", "C172"), ("u5", "ZZZZ")], "icao24 string, typecode string")
    return segments.classify(points(spark, d), types, over).select("track_id", "seq", "type_overridden", "typecode", "asset_class")


@query("nonmonotonic", f"WITH {PTS} SELECT track_id, seq, CAST(coalesce(t_us < lag(t_us) OVER (PARTITION BY track_id ORDER BY seq), false) AS INTEGER) AS nonmono FROM (SELECT * REPLACE (seq * 7919 % 100003 AS seq) FROM pts)")
def nonmonotonic(spark, d):
    return fixes.arrivals(points(spark, d).withColumn("seq", F.expr("seq * 7919 % 100003"))).select("track_id", "seq", "nonmono")


COARSE = "floor(lat * 40) / 40 AS lat, floor(lon * 40) / 40 AS lon"


@query("frozen_runs", f"""WITH {PTS}, c AS (SELECT track_id, seq, t_us, gs_mps, {COARSE} FROM pts),
f AS (SELECT *, coalesce(lat = lag(lat) OVER w AND lon = lag(lon) OVER w AND gs_mps > 1, false) AS frozen, (t_us - lag(t_us) OVER w) / 1e6 AS dt_prev FROM c WINDOW w AS ({T})),
a AS (SELECT *, last_value(CASE WHEN NOT frozen THEN t_us END IGNORE NULLS) OVER ({SO_FAR}) AS anchor FROM f)
SELECT track_id, seq, CAST(frozen AS INTEGER) AS frozen, CASE WHEN frozen THEN least((t_us - anchor) / 1e6, 86400) ELSE 0 END AS frozen_s, dt_prev, CAST(coalesce(dt_prev = 0, false) AS INTEGER) AS dup FROM a""")
def frozen_runs(spark, d):
    p = points(spark, d).withColumns({"lat": F.expr("floor(lat * 40) / 40"), "lon": F.expr("floor(lon * 40) / 40"), "gs": F.col("gs_mps")})
    return fixes.steps(p, TIMING).select("track_id", "seq", "frozen", "frozen_s", "dt_prev", "dup")


@query("eligibility", f"""WITH {PTS}, e AS (SELECT *, coalesce(max(CASE WHEN nacp >= 8 THEN 1 ELSE 0 END) OVER ({SO_FAR}), 0) = 1 AS eligible FROM pts)
SELECT track_id, seq, eligible, CASE WHEN eligible AND nacp IS NOT NULL THEN CAST(nacp < 8 AS DOUBLE) END AS degraded FROM e""")
def eligibility(spark, d):
    return fixes.degradation(points(spark, d)).select("track_id", "seq", "eligible", "degraded")


GS = "CASE WHEN track_deg IS NULL AND gs_mps > 3 THEN NULL ELSE gs_mps END AS gs"
RUN = f"run AS (SELECT *, sum(coalesce(gs, 0)) OVER ({SO_FAR}) AS gs_sum, count(gs) OVER ({SO_FAR}) AS gs_n FROM (SELECT *, {GS} FROM pts))"
# the pair by a join on time, not by a frame
PAIR = f"""pr AS (SELECT p.*, j.t_us AS jt, j.lat AS jlat, j.lon AS jlon, j.gs AS jgs, j.track_deg AS jtrack, j.alt_baro_m AS jalt, j.alt_geom_m AS jgeom,
 j.gs_sum - coalesce(j.gs, 0) AS sum0, j.gs_n - (CASE WHEN j.gs IS NULL THEN 0 ELSE 1 END) AS n0
 FROM run p ASOF LEFT JOIN run j ON p.track_id = j.track_id AND p.t_us - {R} >= j.t_us),
pv AS (SELECT *, (t_us - jt) / 1e6 AS pair_dt, {D("jlat", "jlon", "lat", "lon")} AS dist, (t_us + jt) / 2e6 AS mid, {geo.azimuth("jlat", "jlon", "lat", "lon")} AS az,
 CASE WHEN gs_n > n0 THEN (gs_sum - sum0) / (gs_n - n0) END AS v_rep FROM pr),
pp AS (SELECT *, dist / pair_dt AS v_imp FROM pv)"""


def paired(spark, d):
    return fixes.pairs(fixes.running_speed(fixes.reported_speed(points(spark, d))), TIMING)


@query("lag_pair", f"WITH {PTS}, {RUN}, {PAIR} SELECT track_id, seq, jt AS pair_us, round(pair_dt, 6) AS pair_dt, jlat AS pair_lat FROM pp")
def lag_pair(spark, d):
    return paired(spark, d).select("track_id", "seq", F.col("j.t_us").alias("pair_us"), F.round("pair_dt", 6).alias("pair_dt"), F.col("j.lat").alias("pair_lat"))


@query("pair_speed", f"WITH {PTS}, {RUN}, {PAIR} SELECT track_id, seq, round(dist, 3) AS dist, round(CASE WHEN dist > 0 THEN az END, 6) AS az, round(v_imp, 6) AS v_imp, round(abs(v_imp - v_rep), 6) AS resid FROM pp")
def pair_speed(spark, d):
    return paired(spark, d).select("track_id", "seq", F.round("dist", 3).alias("dist"), F.round("az", 6).alias("az"), F.round("v_imp", 6).alias("v_imp"), F.round(F.abs(F.col("v_imp") - F.col("v_rep")), 6).alias("resid"))


@query("prefix_mean", f"WITH {PTS}, {RUN}, {PAIR} SELECT track_id, seq, round(v_rep, 6) AS v_rep, gs_n FROM pp")
def prefix_mean(spark, d):
    return paired(spark, d).select("track_id", "seq", F.round("v_rep", 6).alias("v_rep"), "gs_n")


def all_fixes(spark, d):
    return fixes.fix_level(points(spark, d), TIMING)


ENV = "env AS (SELECT * FROM (VALUES ('narrowbody', 15, 320, 4, 6, 20, 25), ('helicopter', 15, 90, 5, 360, 0, 15), ('light', 10, 100, 4, 20, 6, 15), ('bus', 8.5, NULL, 1.5, 45, 12, NULL), ('follow_me', 14, NULL, 3, 90, 6, NULL)) v(asset_class, gmax, amax, acc, turnmax, rad, vmax))"
W180 = geo.wrap180
FIX = f"""{RUN}, {PAIR}, {ENV},
fx AS (SELECT p.*, q.v_imp AS jv_imp, q.dist AS jdist, q.az AS jaz, q.mid AS jmid, e.*, p.domain = 'vehicle' OR coalesce(p.on_ground, false) AS ground
 FROM pp p ASOF LEFT JOIN pp q ON p.track_id = q.track_id AND p.t_us - {R} >= q.t_us LEFT JOIN env e ON e.asset_class = p.asset_class)"""


@query("speed_accel_ratio", f"""WITH {PTS}, {FIX} SELECT track_id, seq, round((CASE WHEN jt IS NOT NULL THEN greatest(v_imp, v_rep) ELSE gs END) / (CASE WHEN ground THEN gmax ELSE amax END), 9) AS speed_ratio,
round(abs(gs - jgs) / pair_dt / acc, 9) AS accel_ratio, round(abs(v_imp - jv_imp) / nullif(mid - jmid, 0) / acc, 9) AS accel_imp_ratio, round(abs(alt_baro_m - jalt) / pair_dt / vmax, 9) AS vrate_imp_ratio, round(abs(vrate_mps) / vmax, 6) AS vrate_ratio FROM fx""")
def speed_accel_ratio(spark, d):
    return all_fixes(spark, d).select("track_id", "seq", F.round("speed_ratio", 9).alias("speed_ratio"), *[F.round(c, 9).alias(c) for c in ("accel_ratio", "accel_imp_ratio", "vrate_imp_ratio")], F.round("vrate_ratio", 6).alias("vrate_ratio"))


@query("turn_course", f"""WITH {PTS}, {FIX} SELECT track_id, seq,
round(CASE WHEN gs > 3 AND jgs > 3 AND NOT (ground AND domain = 'aircraft') THEN abs({W180("track_deg - jtrack")}) / pair_dt END / turnmax, 9) AS turn_ratio,
round(CASE WHEN dist >= 20 AND jdist >= 20 AND NOT (ground AND domain = 'aircraft') THEN abs({W180("az - jaz")}) / nullif(mid - jmid, 0) END / turnmax, 9) AS turn_imp_ratio,
round(CASE WHEN gs > 3 THEN abs({W180("heading_deg - track_deg")}) END, 6) AS heading_diff,
round(CASE WHEN gs > 3 AND jgs > 3 AND dist >= 20 THEN abs({W180("az - mean_course")}) END, 6) AS course_resid FROM (SELECT *, {geo.wrap360(f"jtrack + 0.5 * {W180('track_deg - jtrack')}")} AS mean_course FROM fx)""")
def turn_course(spark, d):
    return all_fixes(spark, d).select("track_id", "seq", *[F.round(c, 9).alias(c) for c in ("turn_ratio", "turn_imp_ratio")], F.round("heading_diff", 6).alias("heading_diff"), F.round("course_resid", 6).alias("course_resid"))


@query("altitude_divergence", f"WITH {PTS}, {RUN}, {PAIR} SELECT track_id, seq, alt_geom_m - alt_baro_m AS alt_div, round(abs((alt_geom_m - alt_baro_m) - (jgeom - jalt)) / pair_dt, 9) AS alt_div_rate FROM pp")
def altitude_divergence(spark, d):
    return all_fixes(spark, d).select("track_id", "seq", "alt_div", F.round("alt_div_rate", 9).alias("alt_div_rate"))


GRID = f"""ends AS (SELECT track_id, CAST(ceil(min(t_us) / {S}.0) AS BIGINT) AS k0, CAST(ceil(max(t_us) / {S}.0) AS BIGINT) AS k1 FROM pts GROUP BY track_id),
grid AS (SELECT track_id, unnest(generate_series(k0, k1)) AS k FROM ends)"""
# windows by a range join against the grid
HELD = f"held AS (SELECT g.track_id, g.k, p.* EXCLUDE (track_id) FROM grid g JOIN pts p ON p.track_id = g.track_id AND p.t_us > g.k * {S} - {W} AND p.t_us <= g.k * {S})"


@query("sliding_agg", f"WITH {PTS}, {GRID}, {HELD} SELECT track_id, k, max(gs_mps) AS gs_max, round(avg(gs_mps), 6) AS gs_mean, count(*) AS n, median(nacp) AS nacp_median, min(nacp) AS nacp_min FROM held GROUP BY ALL")
def sliding_agg(spark, d):
    m = windows.members(points(spark, d), TIMING)
    return m.groupBy("track_id", "k").agg(F.max("gs_mps").alias("gs_max"), F.round(F.avg("gs_mps"), 6).alias("gs_mean"), F.count("*").alias("n"), F.percentile("nacp", 0.5).alias("nacp_median"), F.min("nacp").alias("nacp_min"))


@query("sliding_empty_grid", f"WITH {PTS}, {GRID}, {HELD} SELECT g.track_id, g.k, count(h.seq) AS n FROM grid g LEFT JOIN held h USING (track_id, k) GROUP BY ALL")
def sliding_empty_grid(spark, d):
    p = points(spark, d)
    agg = windows.members(p, TIMING).groupBy("track_id", "k").agg(F.count("*").alias("n"))
    return windows.with_grid(agg, p, TIMING).select("track_id", "k", F.coalesce("n", F.lit(0)).alias("n"))


ALL = f"""WITH {PTS}, {FIX}, {GRID}, res AS (SELECT track_id, seq, t_us, v_imp, v_rep, abs(v_imp - v_rep) AS resid, (t_us - lag(t_us) OVER ({T})) / 1e6 AS dt_prev, nacp, alt_geom_m - alt_baro_m AS alt_div, lat, lon FROM fx),
h AS (SELECT g.k, r.* FROM grid g JOIN res r ON r.track_id = g.track_id AND r.t_us > g.k * {S} - {W} AND r.t_us <= g.k * {S})"""


def all_windows(spark, d):
    return windows.window_features(points(spark, d), TIMING)


FLAGSHIP = f"""{ALL}, a AS (SELECT track_id, k, max(resid) AS a, avg(resid) AS b, count(*) AS n, max(dt_prev) AS gap FROM h GROUP BY ALL),
l AS (SELECT g.track_id, g.k, max(p.t_us) AS last FROM grid g JOIN pts p ON p.track_id = g.track_id AND p.t_us <= g.k * {S} GROUP BY ALL)
SELECT track_id, k, round(a, 6) AS kin_speed_resid_max, round(b, 6) AS kin_speed_resid_mean, CAST(coalesce(n, 0) AS DOUBLE) AS tmp_n_points, round((k * {S} - last) / 1e6, 6) AS tmp_staleness_s,
 round(greatest(gap, (k * {S} - last) / 1e6), 6) AS tmp_gap_max_s FROM l LEFT JOIN a USING (track_id, k)"""


@query("window_residuals", FLAGSHIP)
def window_residuals(spark, d):
    return all_windows(spark, d).select("track_id", "k", *r6("kin_speed_resid_max", "kin_speed_resid_mean", "tmp_n_points", "tmp_staleness_s", "tmp_gap_max_s"))


@query("argmax_aux", f"{ALL}, m AS (SELECT track_id, k, round(arg_max(v_imp, struct_pack(a := resid, b := t_us, c := seq)), 6) AS aux_speed_implied_mps, round(arg_max(v_rep, struct_pack(a := resid, b := t_us, c := seq)), 6) AS aux_speed_reported_mps FROM h WHERE resid IS NOT NULL GROUP BY ALL) SELECT * FROM grid LEFT JOIN m USING (track_id, k)")
def argmax_aux(spark, d):
    return all_windows(spark, d).select("track_id", "k", *r6("aux_speed_implied_mps", "aux_speed_reported_mps"))


BASE = f"""bs AS (SELECT g.track_id, g.k, r.* EXCLUDE (track_id), row_number() OVER (PARTITION BY g.track_id, g.k ORDER BY r.t_us, r.seq) AS nth FROM grid g JOIN res r ON r.track_id = g.track_id AND r.t_us > g.k * {S} - {W} - {B} AND r.t_us <= g.k * {S} - {W}),
bm AS (SELECT track_id, k, min(t_us) AS t0, median(nacp) AS nacp0, median(alt_div) AS div0, median(dt_prev) FILTER (nth > 1) AS dt0 FROM bs GROUP BY ALL HAVING {S} * k - {W} - min(t_us) >= {H})"""


@query("trailing_median", f"{ALL}, {BASE}, m AS (SELECT track_id, k, median(nacp) AS med FROM h GROUP BY ALL) SELECT track_id, k, CASE WHEN nacp0 - med IS NOT NULL THEN greatest(nacp0 - med, 0) END AS sig_nacp_drop FROM grid LEFT JOIN m USING (track_id, k) LEFT JOIN bm USING (track_id, k)")
def trailing_median(spark, d):
    return all_windows(spark, d).select("track_id", "k", "sig_nacp_drop")


@query("dt_dev_ratio", f"{ALL}, {BASE}, m AS (SELECT track_id, k, median(dt_prev) AS med FROM h GROUP BY ALL) SELECT track_id, k, CASE WHEN dt0 > 0 THEN round(abs(med - dt0) / dt0, 6) END AS tmp_dt_dev_ratio FROM grid LEFT JOIN m USING (track_id, k) LEFT JOIN bm USING (track_id, k)")
def dt_dev_ratio(spark, d):
    return all_windows(spark, d).select("track_id", "k", *r6("tmp_dt_dev_ratio"))


@query("altitude_deviation", f"{ALL}, {BASE}, m AS (SELECT track_id, k, max(abs(alt_div - div0)) AS sig_alt_div_dev_max_m FROM h JOIN bm USING (track_id, k) GROUP BY ALL) SELECT * FROM grid LEFT JOIN m USING (track_id, k)")
def altitude_deviation(spark, d):
    return all_windows(spark, d).select("track_id", "k", "sig_alt_div_dev_max_m")


@query("degraded_majority", f"WITH {PTS}, {GRID}, e AS (SELECT *, coalesce(max(CASE WHEN nacp >= 8 THEN 1 ELSE 0 END) OVER ({SO_FAR}), 0) = 1 AS eligible FROM pts), h AS (SELECT g.k, e.* FROM grid g JOIN e ON e.track_id = g.track_id AND e.t_us > g.k * {S} - {W} AND e.t_us <= g.k * {S}), m AS (SELECT track_id, k, round(avg(CAST(nacp < 8 AS DOUBLE)), 6) AS sig_degraded_frac, CAST(avg(CAST(nacp < 8 AS DOUBLE)) > 0.5 AS DOUBLE) AS sig_degraded_majority FROM h WHERE eligible AND nacp IS NOT NULL GROUP BY ALL) SELECT * FROM grid LEFT JOIN m USING (track_id, k)")
def degraded_majority(spark, d):
    return all_windows(spark, d).select("track_id", "k", *r6("sig_degraded_frac"), "sig_degraded_majority")


RATIOS = f"""rat AS (SELECT track_id, seq, t_us, asset_class, abs(v_imp - v_rep) / CASE WHEN v_rep IS NOT NULL THEN greatest(v_rep, 3) END AS resid_rel,
 (CASE WHEN jt IS NOT NULL THEN greatest(v_imp, v_rep) ELSE gs END) / (CASE WHEN ground THEN gmax ELSE amax END) AS speed_ratio, abs(gs - jgs) / pair_dt / acc AS accel_ratio, abs(vrate_mps) / vmax AS vrate_ratio, abs(alt_baro_m - jalt) / pair_dt / vmax AS vrate_imp_ratio,
 turn / turnmax AS turn_ratio, CASE WHEN dist >= 20 AND jdist >= 20 AND NOT (ground AND domain = 'aircraft') THEN abs({W180("az - jaz")}) / nullif(mid - jmid, 0) END / turnmax AS turn_imp_ratio,
 CASE WHEN any_turn > 1 THEN rad * radians(any_turn) / nullif(v_rep, 0) END AS radius_ratio, CASE WHEN gs > 3 AND jgs > 3 AND dist >= 20 THEN abs({W180("az - mean_course")}) END AS course_resid, CASE WHEN gs > 3 THEN abs({W180("heading_deg - track_deg")}) END AS heading_diff,
 abs((alt_geom_m - alt_baro_m) - (jgeom - jalt)) / pair_dt AS alt_div_rate
 FROM (SELECT *, {geo.wrap360(f"jtrack + 0.5 * {W180('track_deg - jtrack')}")} AS mean_course, CASE WHEN gs > 3 AND jgs > 3 THEN abs({W180("track_deg - jtrack")}) / pair_dt END AS any_turn, CASE WHEN gs > 3 AND jgs > 3 AND NOT (ground AND domain = 'aircraft') THEN abs({W180("track_deg - jtrack")}) / pair_dt END AS turn FROM fx))"""
MASKED = {"kin_speed_ratio_max": "speed_ratio", "kin_accel_ratio_max": "accel_ratio", "kin_turn_rate_ratio_max": "turn_ratio", "kin_turn_rate_imp_ratio_max": "turn_imp_ratio", "kin_turn_radius_ratio_max": "radius_ratio", "kin_vrate_ratio_max": "vrate_ratio", "kin_vrate_imp_ratio_max": "vrate_imp_ratio"}
PLAIN = {"kin_speed_resid_rel_max": "max(resid_rel)", "kin_course_resid_max": "max(course_resid)", "kin_course_resid_mean": "avg(course_resid)", "kin_heading_course_diff_max": "max(heading_diff)", "sig_alt_div_rate_max": "max(alt_div_rate)"}


@query("window_kinetics", f"""WITH {PTS}, {FIX}, {GRID}, {RATIOS}, w AS (SELECT g.track_id, g.k, {", ".join(f"max({c}) AS {f}" for f, c in MASKED.items())}, {", ".join(f"{x} AS {f}" for f, x in PLAIN.items())} FROM grid g LEFT JOIN rat r ON r.track_id = g.track_id AND r.t_us > g.k * {S} - {W} AND r.t_us <= g.k * {S} GROUP BY ALL),
l AS (SELECT g.track_id, g.k, p.asset_class <> 'helicopter' AS checked FROM grid g ASOF JOIN pts p ON p.track_id = g.track_id AND g.k * {S} >= p.t_us)
SELECT track_id, k, {", ".join(f"CASE WHEN checked THEN round({f} + 1.3e-11, 9) END AS {f}" for f in MASKED)}, {", ".join(f"round({f}, 6) AS {f}" for f in PLAIN)} FROM w JOIN l USING (track_id, k)""")
def window_kinetics(spark, d):
    return all_windows(spark, d).select("track_id", "k", *[F.round(F.col(c) + 1.3e-11, 9).alias(c) for c in MASKED], *r6(*PLAIN))


SIGNAL = f"""c AS (SELECT *, coalesce(lat = lag(lat) OVER w AND lon = lag(lon) OVER w AND {GS.removesuffix(" AS gs")} > 1, false) AS frozen, (t_us - lag(t_us) OVER w) / 1e6 AS dt_prev FROM pts WINDOW w AS ({T})),
a AS (SELECT *, last_value(CASE WHEN NOT frozen THEN t_us END IGNORE NULLS) OVER ({SO_FAR}) AS anchor, CAST(coalesce(t_us < lag(t_us) OVER (PARTITION BY track_id ORDER BY seq), false) AS INTEGER) AS nonmono FROM c),
s AS (SELECT *, CASE WHEN frozen THEN least((t_us - anchor) / 1e6, 86400) ELSE 0 END AS frozen_s FROM a)"""


@query("window_signals", f"""WITH {PTS}, {GRID}, {SIGNAL}, h AS (SELECT g.track_id, g.k, s.* EXCLUDE (track_id) FROM grid g LEFT JOIN s ON s.track_id = g.track_id AND s.t_us > g.k * {S} - {W} AND s.t_us <= g.k * {S}),
m AS (SELECT track_id, k, median(nacp) AS nacp, min(nacp) AS nacp_min, median(nic) AS nic, min(sil) AS sil, max(frozen_s) AS run, avg(CAST(frozen AS DOUBLE)) AS frac, coalesce(sum(CAST(dt_prev = 0 AS INTEGER)), 0) AS dups, coalesce(sum(nonmono), 0) AS nonmonos FROM h GROUP BY ALL),
bs AS (SELECT g.track_id, g.k, min(r.t_us) AS t0, median(r.nic) AS nic0 FROM grid g JOIN pts r ON r.track_id = g.track_id AND r.t_us > g.k * {S} - {W} - {B} AND r.t_us <= g.k * {S} - {W} GROUP BY ALL)
SELECT track_id, k, nacp AS sig_nacp_median, nacp_min AS sig_nacp_min, nic AS sig_nic_median, sil AS sig_sil_min, run AS tmp_frozen_run_s, round(frac, 6) AS tmp_frozen_frac, CAST(dups AS DOUBLE) AS tmp_dup_count, CAST(nonmonos AS DOUBLE) AS tmp_nonmono_count,
 CASE WHEN {S} * k - {W} - t0 >= {H} AND nic0 - nic IS NOT NULL THEN greatest(nic0 - nic, 0) END AS sig_nic_drop FROM m LEFT JOIN bs USING (track_id, k)""")
def window_signals(spark, d):
    return all_windows(spark, d).select("track_id", "k", "sig_nacp_median", "sig_nacp_min", "sig_nic_median", "sig_sil_min", "tmp_frozen_run_s", *r6("tmp_frozen_frac"), "tmp_dup_count", "tmp_nonmono_count", "sig_nic_drop")


def _wide(spark, d):
    """Points on a denser clock, so that windows hold enough fixes for a fit."""
    return points(spark, d).withColumn("t_us", F.expr("CAST(floor(t_us / 20) AS BIGINT)"))


@query("jitter_fit", f"""WITH {PTS}, z AS (SELECT * REPLACE (t_us // 20 AS t_us) FROM pts), ends AS (SELECT track_id, CAST(ceil(min(t_us) / {S}.0) AS BIGINT) AS k0, CAST(ceil(max(t_us) / {S}.0) AS BIGINT) AS k1 FROM z GROUP BY track_id),
grid AS (SELECT track_id, unnest(generate_series(k0, k1)) AS k FROM ends),
h AS (SELECT g.k, z.*, first_value(lat) OVER f AS lat0, first_value(lon) OVER f AS lon0, (z.t_us - avg(z.t_us) OVER (PARTITION BY g.track_id, g.k)) / {W}.0 AS u FROM grid g JOIN z ON z.track_id = g.track_id AND z.t_us > g.k * {S} - {W} AND z.t_us <= g.k * {S} WINDOW f AS (PARTITION BY g.track_id, g.k ORDER BY z.t_us, z.seq)),
m AS (SELECT *, radians(lat - lat0) * {geo.A * (1 - geo.E2)!r} / pow(1 - {geo.E2!r} * pow(sin(radians(lat0)), 2), 1.5) AS y, radians(lon - lon0) * {geo.A!r} / sqrt(1 - {geo.E2!r} * pow(sin(radians(lat0)), 2)) * cos(radians(lat0)) AS x FROM h),
s AS (SELECT track_id, k, count(*) AS n, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(x) AS x0, sum(x*u) AS x1, sum(x*u*u) AS x2, sum(y) AS y0, sum(y*u) AS y1, sum(y*u*u) AS y2, sum(x*x+y*y) AS q FROM m GROUP BY ALL HAVING count(*) >= 5),
dd AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM s),
co AS (SELECT *, (x0*(s2*s4-s3*s3) - s1*(x1*s4-x2*s3) + s2*(x1*s3-x2*s2))/det AS a0, (n*(x1*s4-x2*s3) - x0*(s1*s4-s2*s3) + s2*(s1*x2-s2*x1))/det AS a1, (n*(s2*x2-s3*x1) - s1*(s1*x2-s2*x1) + x0*(s1*s3-s2*s2))/det AS a2,
 (y0*(s2*s4-s3*s3) - s1*(y1*s4-y2*s3) + s2*(y1*s3-y2*s2))/det AS b0, (n*(y1*s4-y2*s3) - y0*(s1*s4-s2*s3) + s2*(s1*y2-s2*y1))/det AS b1, (n*(s2*y2-s3*y1) - s1*(s1*y2-s2*y1) + y0*(s1*s3-s2*s2))/det AS b2 FROM dd WHERE abs(det) > 1e-12 * pow(n, 3))
SELECT track_id, k, round(sqrt(greatest(0, q - a0*x0 - a1*x1 - a2*x2 - b0*y0 - b1*y1 - b2*y2) / n), 3) AS jitter FROM grid LEFT JOIN co USING (track_id, k)""")
def jitter_fit(spark, d):
    p = _wide(spark, d)
    return windows.window_features(p, TIMING).select("track_id", "k", F.round("kin_pos_jitter_m", 3).alias("jitter"))


LABELLED = "CASE seq % 9 WHEN 0 THEN 'degraded' WHEN 1 THEN 'technical_error' WHEN 2 THEN 'possible_spoofing' ELSE 'plausible' END"


def labelled(spark, d):
    return points(spark, d).withColumns({"label_cause": F.expr(LABELLED), "label_event_id": F.expr("CASE WHEN seq % 9 < 3 THEN CAST(seq AS STRING) END"), "label_onset_t": F.col("t")})


ANOM = ", ".join(f"count(*) FILTER (label_cause = '{c}')" for c in labels.ANOMALOUS)
NAMES = ", ".join(f"'{c}'" for c in CAUSES[1:])


@query("label_windows", f"""WITH {PTS}, lab AS (SELECT *, {LABELLED} AS label_cause, CASE WHEN seq % 9 < 3 THEN CAST(seq AS VARCHAR) END AS ev FROM pts), {GRID},
h AS (SELECT g.track_id, g.k, count(l.seq) AS n, [{ANOM.replace("count(*)", "count(l.seq)")}] AS c, arg_max(l.ev, l.t_us) FILTER (l.ev IS NOT NULL) AS ev FROM grid g LEFT JOIN lab l ON l.track_id = g.track_id AND l.t_us > g.k * {S} - {W} AND l.t_us <= g.k * {S} GROUP BY ALL),
b AS (SELECT g.track_id, g.k, l.label_cause AS before, l.ev AS before_ev FROM grid g ASOF JOIN lab l ON l.track_id = g.track_id AND g.k * {S} >= l.t_us),
a AS (SELECT g.track_id, g.k, l.label_cause AS after FROM grid g ASOF LEFT JOIN lab l ON l.track_id = g.track_id AND g.k * {S} < l.t_us),
x AS (SELECT *, n = 0 AND before = after AND before <> 'plausible' AS agree FROM h JOIN b USING (track_id, k) JOIN a USING (track_id, k)),
y AS (SELECT *, coalesce(agree, false) AS ok, CASE WHEN agree THEN 1.0 WHEN n = 0 THEN 0.0 ELSE list_sum(c) / n END AS frac FROM x)
SELECT track_id, k, round(frac, 6) AS label_frac, CASE WHEN frac >= 1/3 THEN CASE WHEN ok THEN before ELSE [{NAMES}][list_position(c, list_max(c))] END ELSE 'plausible' END AS label_cause,
 frac > 0 AND frac < 1/3 AS label_transition, CASE WHEN ok THEN coalesce(ev, before_ev) ELSE ev END AS label_event_id FROM y""")
def label_windows(spark, d):
    return labels.window_labels(labelled(spark, d), TIMING).select("track_id", "k", *r6("label_frac"), "label_cause", "label_transition", "label_event_id")


@query("naive_baseline", f"""WITH {PTS}, {GRID}, p AS (SELECT *, lag(t_us) OVER w AS pt, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM pts WINDOW w AS ({T})),
q AS (SELECT *, {D("plat", "plon", "lat", "lon")} AS dm, (t_us - pt) / 1e6 AS dt FROM p WHERE pt IS NOT NULL),
v AS (SELECT *, greatest(CASE WHEN dt > 0 THEN least(1, dm / dt / CASE WHEN domain = 'aircraft' AND NOT coalesce(on_ground, false) THEN 350 ELSE 30 END) END, least(1, dm / 500)) AS pair FROM q),
s AS (SELECT g.track_id, g.k, max(pair) AS score FROM grid g JOIN v ON v.track_id = g.track_id AND v.pt > g.k * {S} - {W} AND v.t_us <= g.k * {S} GROUP BY ALL)
SELECT track_id, k, round(coalesce(score, 0), 6) AS baseline_score, coalesce(score, 0) >= 1 AS baseline_flag FROM grid LEFT JOIN s USING (track_id, k)""")
def naive_baseline(spark, d):
    return scoring.naive_score(points(spark, d), TIMING).select("track_id", "k", *r6("baseline_score"), "baseline_flag")


@query("stretches", f"""WITH {PTS}, e AS (SELECT *, row_number() OVER ({T}) - row_number() OVER (PARTITION BY track_id, asset_class, on_ground ORDER BY t_us, seq) AS island FROM pts)
SELECT track_id, asset_class, on_ground, min(t_us) AS t_start, max(t_us) AS t_end, count(*) AS n FROM e GROUP BY track_id, asset_class, on_ground, island""")
def stretches(spark, d):
    return segments.stretches(points(spark, d), ["track_id"], ["asset_class", "on_ground"])


@query("hold_out_days", f"WITH {PTS} SELECT track_id, seq FROM pts WHERE floor(t / 86400) <= (SELECT max(floor(t / 86400)) FROM pts) - 2")
def hold_out_days(spark, d):
    return scoring.before_last_days(points(spark, d)).select("track_id", "seq")

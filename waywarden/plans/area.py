"""Queries over many tracks and over the map; each with the SQL that checks it."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from waywarden.functions import geo
from waywarden.operators import fleet, halos, models, places
from waywarden.params import Fleet, Timing
from waywarden.plans import batch, motion
from waywarden.plans.adaptor import PTS, TIMING, points

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


SIDE = 3_000.0
APRON = Fleet("apron", cell_m=SIDE, bin_s=14_400, min_tracks=3, share_min=0.5, timing=TIMING)
REGIONAL = Fleet("regional", cell_m=SIDE, bin_s=86_400, min_tracks=5, share_min=0.4, baseline_test=False, warn_share=0.2, timing=TIMING)
X, Y = geo.utm("lat", "lon")
Q, R = geo.hex_axial("x", "y", SIDE)
XY = "xy AS (SELECT *, {x} AS x, {y} AS y FROM pts)".format(x=X, y=Y)
CELL = f"cl AS (SELECT *, {Q} AS q, {R} AS r FROM xy)"


@query("midlat_distance", f"WITH {PTS} SELECT track_id, seq, round({geo.distance_m('lat', 'lon', '41.8', '12.25')}, 3) AS d, round({geo.azimuth('lat', 'lon', '41.8', '12.25')}, 6) AS az FROM pts")
def midlat_distance(spark, d):
    return points(spark, d).selectExpr("track_id", "seq", f"round({geo.distance_m('lat', 'lon', '41.8D', '12.25D')}, 3) AS d", f"round({geo.azimuth('lat', 'lon', '41.8D', '12.25D')}, 6) AS az")


@query("utm_xy", f"WITH {PTS}, {XY} SELECT track_id, seq, round(x, 3) AS x, round(y, 3) AS y FROM xy")
def utm_xy(spark, d):
    return places.metric(points(spark, d)).select("track_id", "seq", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("hex_cell", f"WITH {PTS}, {XY}, {CELL} SELECT track_id, seq, q, r, q || ':' || r AS cell FROM cl")
def hex_cell(spark, d):
    return fleet.cells(points(spark, d), SIDE).select("track_id", "seq", "q", "r", "cell")


@query("regional_majority", f"""WITH {PTS}, f AS (SELECT *, last_value(nacp IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY t_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS acc FROM pts WHERE NOT coalesce(on_ground, false)),
e AS (SELECT *, max(acc) OVER (PARTITION BY asset_id) AS best FROM f), xy AS (SELECT *, {X} AS x, {Y} AS y FROM e WHERE best >= 8 AND acc IS NOT NULL), {CELL},
p AS (SELECT q || ':' || r AS cell, t_us // 86400000000 * 86400 AS bin_start, asset_id, CASE WHEN avg(CAST(acc < 8 AS DOUBLE)) > 0.5 THEN 1 ELSE 0 END AS bad FROM cl GROUP BY ALL),
c AS (SELECT cell, bin_start, count(*) AS n_tracks, CAST(sum(bad) AS BIGINT) AS n_degraded FROM p GROUP BY ALL HAVING count(*) >= 5)
SELECT cell, bin_start, n_tracks, n_degraded, round(n_degraded / n_tracks, 6) AS share, CASE WHEN n_degraded / n_tracks > 0.4 THEN 'red' WHEN n_degraded / n_tracks > 0.2 THEN 'yellow' ELSE 'green' END AS level, n_degraded / n_tracks > 0.4 AS flagged FROM c""")
def regional_majority(spark, d):
    return fleet.regional(points(spark, d), REGIONAL).select("cell", F.col("bin_start").cast("long").alias("bin_start"), "n_tracks", "n_degraded", F.round("share", 6).alias("share"), "level", "flagged")


@query("top_cells", f"""WITH {PTS}, {XY}, {CELL} SELECT q || ':' || r AS cell, count(*) AS n FROM cl GROUP BY ALL ORDER BY n DESC, cell LIMIT 10""")
def top_cells(spark, d):
    """The ten cells with the most fixes: a report, so the limit is its point."""
    return fleet.cells(points(spark, d), SIDE).groupBy("cell").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cell").limit(10)


@query("cell_baseline", f"""WITH {PTS}, {{STATE}} SELECT q || ':' || r AS cell, round(avg(CAST(degraded AS DOUBLE)), 9) AS baseline FROM stt WHERE hr = k GROUP BY ALL""")
def cell_baseline(spark, d):
    return fleet.baseline_rates(seen(spark, d), APRON).select("cell", F.round("baseline", 9).alias("baseline"))


def seen(spark, d):
    """One window for each track and hour with a fix: its last position and whether accuracy was low."""
    p = points(spark, d).withColumn("k", F.expr(f"CAST(ceil(t_us / {TIMING.us('stride')}.0D) AS BIGINT)"))
    return p.groupBy("track_id", "k").agg(F.max_by("lat", "t_us").alias("aux_lat"), F.max_by("lon", "t_us").alias("aux_lon"), F.max_by(F.coalesce(F.col("nacp") < 8, F.lit(False)), "t_us").alias("degraded"))


# presence by a series for each window, counts by a join of cells on their distance
STATE = f"""wn AS (SELECT track_id, CAST(ceil(t_us / {TIMING.us('stride')}.0) AS BIGINT) AS k, arg_max(lat, t_us) AS lat, arg_max(lon, t_us) AS lon, arg_max(coalesce(nacp < 8, false), t_us) AS degraded FROM pts GROUP BY ALL),
nx AS (SELECT *, least(coalesce(lead(k) OVER (PARTITION BY track_id ORDER BY k), k + 4), k + 4) AS upto FROM wn),
xy AS (SELECT *, {X} AS x, {Y} AS y FROM nx), {CELL},
stt AS (SELECT track_id, unnest(generate_series(k, upto - 1)) AS hr, k, q, r, degraded FROM cl),
cnt AS (SELECT hr, q, r, count(*) AS n, CAST(sum(CASE WHEN degraded THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM stt GROUP BY ALL)"""


ORACLES["cell_baseline"] = ORACLES["cell_baseline"].replace("{STATE}", STATE)


@query("presence_carry", f"WITH {PTS}, {STATE} SELECT track_id, hr AS k, q || ':' || r AS cell, degraded, hr = k AS own FROM stt")
def presence_carry(spark, d):
    return fleet.presence(seen(spark, d), APRON).select("track_id", "k", "cell", "degraded", "own")


def tail_sql(n: str, k: str, p: str) -> str:
    """The tail as a sum of terms by the gamma function."""
    return f"CASE WHEN {k} <= 0 THEN 1.0 WHEN {k} > {n} THEN 0.0 ELSE list_sum(list_transform(generate_series({k}, {n}), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})))) END"


@query("binom_flag", f"WITH {PTS}, {STATE}, pv AS (SELECT *, {tail_sql('n', 'bad', '0.02')} AS p FROM cnt) SELECT q || ':' || r AS cell, hr AS k, n AS n_tracks, bad AS n_degraded, round(p, 9) AS p_value, n >= 3 AND bad / n > 0.5 AND p < 0.01 AS flagged FROM pv")
def binom_flag(spark, d):
    return fleet.cell_counts(fleet.presence(seen(spark, d), APRON), APRON).select("cell", "k", "n_tracks", "n_degraded", F.round("p_value", 9).alias("p_value"), "flagged")


DISK = "abs(b.q - a.q) + abs(b.r - a.r) + abs(b.q - a.q + b.r - a.r) <= 2"
FLAG = f"(n >= 3 AND bad / n > 0.5 AND {tail_sql('n', 'bad', '0.02')} < 0.01)"


@query("loo_features", f"""WITH {PTS}, {STATE}, fl AS (SELECT *, {FLAG} AS flagged FROM cnt),
o AS (SELECT track_id, hr, q, r, CASE WHEN degraded THEN 1 ELSE 0 END AS own FROM stt WHERE hr = k),
dk AS (SELECT a.track_id, a.hr, a.own, sum(b.n) - 1 AS others, sum(b.bad) - max(a.own) AS bads, count(*) FILTER (b.flagged AND (b.q, b.r) <> (a.q, a.r)) AS nf, sum(b.n) FILTER ((b.q, b.r) = (a.q, a.r)) - 1 AS cn, sum(b.bad) FILTER ((b.q, b.r) = (a.q, a.r)) - max(a.own) AS cb FROM o a JOIN fl b ON a.hr = b.hr AND {DISK} GROUP BY ALL)
SELECT track_id, hr AS k, CAST(others AS DOUBLE) AS flt_n_others, round(CASE WHEN others > 0 THEN bads / others ELSE 0 END, 6) AS flt_deg_rate_loo, CAST(bads AS DOUBLE) AS flt_deg_count_loo,
 CAST(coalesce(n >= 3 AND bad / n > 0.5 AND {tail_sql('n', 'bad', '0.02')} < 0.01, false) AS DOUBLE) AS flt_cell_flagged_loo, round(nf / 6.0, 6) AS flt_nbr_flagged_frac FROM (SELECT *, CAST(cn AS BIGINT) AS n, CAST(cb AS BIGINT) AS bad FROM dk)""")
def loo_features(spark, d):
    return fleet.fleet_features(seen(spark, d), APRON).select("track_id", "k", "flt_n_others", F.round("flt_deg_rate_loo", 6).alias("flt_deg_rate_loo"), "flt_deg_count_loo", "flt_cell_flagged_loo", F.round("flt_nbr_flagged_frac", 6).alias("flt_nbr_flagged_frac"))


@query("ring_join", f"WITH {PTS}, {STATE} SELECT a.q || ':' || a.r AS cell, a.hr AS k, CAST(sum(b.n) AS BIGINT) AS n_disk FROM cnt a JOIN cnt b ON a.hr = b.hr AND {DISK} GROUP BY ALL")
def ring_join(spark, d):
    c = fleet.cell_counts(fleet.presence(seen(spark, d), APRON), APRON)
    sent = fleet.ring(c, 1, True).groupBy(F.col("nq").alias("q"), F.col("nr").alias("r"), "k").agg(F.sum("n_tracks").alias("n_disk"))
    return c.select("cell", "q", "r", "k").join(sent, ["q", "r", "k"]).select("cell", "k", "n_disk")


@query("components", f"""WITH RECURSIVE {PTS}, {STATE}, f AS (SELECT hr, q, r FROM cnt WHERE n >= 2 AND bad / n > 0.5),
e AS (SELECT a.hr, a.q, a.r, b.q AS q2, b.r AS r2 FROM f a JOIN f b ON a.hr = b.hr AND {DISK}),
w AS (SELECT hr, q, r, q2, r2 FROM e UNION SELECT w.hr, w.q, w.r, e.q2, e.r2 FROM w JOIN e ON e.hr = w.hr AND e.q = w.q2 AND e.r = w.r2)
SELECT hr AS k, q || ':' || r AS cell, count(*) AS cells FROM w GROUP BY hr, q, r""")
def components(spark, d):
    c = fleet.parts(fleet.cell_counts(fleet.presence(seen(spark, d), APRON), APRON).filter("n_tracks >= 2 AND share > 0.5"))
    return c.select("k", "cell", F.count("*").over(Window.partitionBy("part")).alias("cells"))


def some_alerts(spark, d):
    """Alerts of the largest cells: a loose profile, so that there are some."""
    loose = Fleet("apron", cell_m=SIDE, bin_s=14_400, min_tracks=3, share_min=0.5, baseline_test=False, timing=TIMING)
    w = seen(spark, d)
    return w, fleet.area_alerts(fleet.cell_counts(fleet.presence(w, loose), loose), loose), loose


@query("area_alerts", None)
def area_alerts(spark, d):
    return some_alerts(spark, d)[1]


@query("alert_members", None)
def alert_members(spark, d):
    w, alerts, loose = some_alerts(spark, d)
    return fleet.alert_members(w, alerts, loose)


@query("live_halos", None)
def live_halos(spark, d):
    return halos.live_halos(some_alerts(spark, d)[1], TIMING.stride_s)


# ---------------------------------------------------------------- map

#: Zones as octagons on a lattice over the airport; every fifth a runway.
KINDS = ("runway", "taxiway", "apron", "stand", "service_road", "holding_point")
X0, Y0 = places.to_metric(41.77, 12.20)
CORNERS = [(math.cos(math.pi / 4 * i), math.sin(math.pi / 4 * i)) for i in range(8)]
ZONES = [(f"z{i}", f"Zone {i}", KINDS[i % 6], (1.0, 0.5, 0.2)[i % 3], (None, 5.0, 8.0, 12.0)[i % 4], X0 + 900.0 + 1300.0 * (i % 6) + 37.0 * i, Y0 + 700.0 + 1900.0 * (i // 6), 400.0 + 130.0 * (i % 5)) for i in range(30)]
ACCESS = [(kind, cls, (i + j) % 3 > 0, None if (i + j) % 4 == 0 else 60.0 * (1 + j)) for i, kind in enumerate(KINDS[:5]) for j, cls in enumerate(("narrowbody", "light", "bus", "follow_me"))]
EDGES = [(f"e{i}", ("aircraft", "vehicle")[i % 2], X0 + 300.0 * i, Y0 + 250.0 * (i % 7), X0 + 300.0 * i + 900.0, Y0 + 4000.0 + 400.0 * (i % 5)) for i in range(24)]
RUNWAYS = [("16R/34L", "16R", 41.846, 12.262, 4.0, 164.0), ("16R/34L", "34L", 41.812, 12.275, 4.0, 344.0), ("07/25", "07", 41.79, 12.22, 4.0, 70.0), ("07/25", "25", 41.80, 12.26, 4.0, 250.0)]


def ring_of(x: float, y: float, size: float):
    pts = [(x + size * c, y + size * s) for c, s in CORNERS]
    return [*pts, pts[0]]


def zones(spark):
    rows = [(*z[:5], ring_of(*z[5:])) for z in ZONES]
    return spark.createDataFrame(rows, "zone_id string, zone_name string, zone_type string, criticality double, speed_limit_mps double, ring array<struct<x:double,y:double>>")


def access(spark):
    return spark.createDataFrame(ACCESS, "zone_type string, asset_class string, allowed boolean, max_dwell_s double")


def routes(spark):
    return spark.createDataFrame(EDGES, "edge_id string, domain string, x1 double, y1 double, x2 double, y2 double")


def runways(spark):
    return spark.createDataFrame(RUNWAYS, "runway string, end string, threshold_lat double, threshold_lon double, elevation_m double, bearing_deg double")


def buildings(spark):
    rows = [(z[0], 10.0 + 7 * i, ring_of(z[5] + 650, z[6] + 300, 120.0)) for i, z in enumerate(ZONES[:12])]
    return spark.createDataFrame(rows, "building_id string, height_m double, ring array<struct<x:double,y:double>>")


def value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)"


def table(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)})"


# sides of each zone; inside by crossings, distance by the nearest side: every position against every zone
SIDES = table("sd", "zone_id, x1, y1, x2, y2", [(z[0], *a, *b) for z in ZONES for a, b in zip(ring_of(*z[5:]), ring_of(*z[5:])[1:], strict=False)])
ZT = table("zn", "zone_id, zone_name, zone_type, criticality, speed_limit", [z[:5] for z in ZONES])
T01 = "least(1, greatest(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))))"
NEAR = f"""{ZT}, {SIDES}, sg AS (SELECT p.track_id, p.seq, p.asset_class, p.gs_mps, s.zone_id, x, y, (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 AS hit, {T01} AS u, x1, y1, x2, y2 FROM xy p, sd s),
dz AS (SELECT track_id, seq, asset_class, gs_mps, zone_id, CASE WHEN count(*) FILTER (hit) % 2 = 1 THEN 0 ELSE min(sqrt(pow(x - (x1 + u * (x2 - x1)), 2) + pow(y - (y1 + u * (y2 - y1)), 2))) END AS dist FROM sg GROUP BY ALL)"""


def placed(spark, d):
    return places.metric(points(spark, d))


@query("point_in_zone", f"WITH {PTS}, {XY}, {NEAR} SELECT track_id, seq, zone_id FROM dz WHERE dist = 0")
def point_in_zone(spark, d):
    return places.near_polygons(placed(spark, d), zones(spark)).select("track_id", "seq", "zone_id")


@query("near_zone", f"WITH {PTS}, {XY}, {NEAR} SELECT track_id, seq, zone_id, round(dist, 3) AS dist FROM dz WHERE dist <= 50")
def near_zone(spark, d):
    return places.near_polygons(placed(spark, d), zones(spark), 50.0).select("track_id", "seq", "zone_id", F.round("dist", 3).alias("dist"))


@query("nearest_zone", f"WITH {PTS}, {XY}, {NEAR} SELECT track_id, seq, arg_min(zone_id, struct_pack(a := -criticality, b := dist, c := zone_id)) AS zone_id, max(criticality) AS crit FROM dz JOIN zn USING (zone_id) WHERE dist <= 50 GROUP BY ALL")
def nearest_zone(spark, d):
    return places.ground_zones(placed(spark, d), zones(spark), access(spark)).select("track_id", "seq", "zone_id", "crit")


@query("speed_limit_ratio", f"WITH {PTS}, {XY}, {NEAR} SELECT track_id, seq, min(speed_limit) AS speed_limit, round(any_value(gs_mps) / min(speed_limit), 6) AS ratio FROM dz JOIN zn USING (zone_id) WHERE dist <= 10 AND speed_limit IS NOT NULL GROUP BY ALL")
def speed_limit_ratio(spark, d):
    p = placed(spark, d)
    g = places.ground_zones(p, zones(spark), access(spark)).filter("limit IS NOT NULL")
    return g.join(p.select("track_id", "seq", "gs_mps"), ["track_id", "seq"]).select("track_id", "seq", F.col("limit").alias("speed_limit"), F.round(F.col("gs_mps") / F.col("limit"), 6).alias("ratio"))


AC = table("ac", "zone_type, asset_class, allowed, max_dwell", ACCESS)


@query("access_join", f"""WITH {PTS}, {XY}, {NEAR}, {AC}, j AS (SELECT dz.*, zn.zone_type, criticality, coalesce(allowed, true) AS ok, max_dwell FROM dz JOIN zn USING (zone_id) LEFT JOIN ac ON ac.zone_type = zn.zone_type AND ac.asset_class = dz.asset_class WHERE dist <= 50),
s AS (SELECT *, bool_or(dist <= 10 AND ok) OVER (PARTITION BY track_id, seq) AS somewhere FROM j)
SELECT track_id, seq, coalesce(max(criticality) FILTER (dist = 0 AND NOT ok AND (zone_type = 'runway' OR NOT somewhere)), 0) AS violation, arg_max(max_dwell, struct_pack(a := criticality, b := -max_dwell)) FILTER (dist = 0 AND max_dwell IS NOT NULL) AS max_dwell FROM s GROUP BY ALL""")
def access_join(spark, d):
    return places.ground_zones(placed(spark, d), zones(spark), access(spark)).select("track_id", "seq", "violation", "max_dwell")


ED = table("ed", "edge_id, domain, x1, y1, x2, y2", EDGES)


@query("nearest_edge", f"WITH {PTS}, {XY}, {ED}, e AS (SELECT p.track_id, p.seq, x, y, {T01} AS u, x1, y1, x2, y2 FROM xy p JOIN ed ON ed.domain = p.domain) SELECT track_id, seq, round(min(sqrt(pow(x - (x1 + u * (x2 - x1)), 2) + pow(y - (y1 + u * (y2 - y1)), 2))), 3) AS route_m FROM e GROUP BY ALL")
def nearest_edge(spark, d):
    return places.nearest_edge(placed(spark, d), routes(spark), ["track_id", "seq"]).select("track_id", "seq", F.round("route_m", 3).alias("route_m"))


RW = table("rw", "runway, rend, tlat, tlon, elev, bearing", RUNWAYS)


@query("approach_match", f"""WITH {PTS}, {RW}, e AS (SELECT track_id, seq, rend, track_deg, bearing, gs_mps, vrate_mps, elev, coalesce(alt_geom_m, alt_baro_m) AS alt, {geo.distance_m('lat', 'lon', 'tlat', 'tlon')} AS d, {geo.azimuth('lat', 'lon', 'tlat', 'tlon')} AS az FROM pts, rw WHERE domain = 'aircraft'),
a AS (SELECT *, abs({geo.wrap180('az - bearing')}) AS ang FROM e WHERE abs({geo.wrap180('track_deg - bearing')}) <= 30),
b AS (SELECT track_id, seq, arg_min(a, struct_pack(l := d * sin(radians(ang)), e := rend)) AS r FROM a WHERE ang < 90 GROUP BY ALL)
SELECT track_id, seq, r.rend AS runway_end, round(r.ang, 6) AS lateral, round(abs(degrees(atan2(r.alt - r.elev, r.d)) - 3), 6) AS glide FROM b WHERE r.d <= 10000 AND NOT coalesce(r.alt - r.elev > tan(radians(6)) * r.d + 150, false)""")
def approach_match(spark, d):
    p = points(spark, d).filter("domain = 'aircraft'").withColumn("gs", F.col("gs_mps"))
    return places.approach(p, runways(spark)).select("track_id", "seq", F.col("end").alias("runway_end"), F.round("lateral", 6).alias("lateral"), F.round("glide", 6).alias("glide"))


BLD = table("bd", "building_id, height, x1, y1, x2, y2", [(z[0], 10.0 + 7 * i, *a, *b) for i, z in enumerate(ZONES[:12]) for a, b in zip(ring_of(z[5] + 650, z[6] + 300, 120.0), ring_of(z[5] + 650, z[6] + 300, 120.0)[1:], strict=False)])


@query("building_shadow", f"""WITH {PTS}, {XY}, {BLD}, sg AS (SELECT track_id, seq, building_id, height, x, y, (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 AS hit, {T01} AS u, x1, y1, x2, y2 FROM xy, bd),
db AS (SELECT track_id, seq, building_id, any_value(height) AS height, CASE WHEN count(*) FILTER (hit) % 2 = 1 THEN 0 ELSE min(sqrt(pow(x - (x1 + u * (x2 - x1)), 2) + pow(y - (y1 + u * (y2 - y1)), 2))) END AS dist FROM sg GROUP BY ALL),
el AS (SELECT track_id, seq, max(degrees(atan2(height, greatest(dist, 1)))) AS e FROM db WHERE dist <= 150 GROUP BY ALL)
SELECT track_id, seq, CASE WHEN e >= 45 THEN 'static_elev45' WHEN e >= 30 THEN 'static_elev30' ELSE 'static_elev15' END AS risk_zone_id FROM el WHERE e >= 15""")
def building_shadow(spark, d):
    return halos.static_halos(placed(spark, d), buildings(spark), ["track_id", "seq"])


# the timer as a recursion over a track's fixes
DWELL = f"""o AS (SELECT track_id, seq, t_us, floor(x / 2000) * 2000 AS x, floor(y / 2000) * 2000 AS y, domain = 'vehicle' AS ok, row_number() OVER (PARTITION BY track_id ORDER BY t_us, seq) AS i FROM xy),
dw AS (SELECT track_id, seq, i, CASE WHEN ok THEN x END AS ax, CASE WHEN ok THEN y END AS ay, CASE WHEN ok THEN t_us END AS tt, CASE WHEN ok THEN CAST(0 AS DOUBLE) END AS d FROM o WHERE i = 1
 UNION ALL SELECT track_id, seq, i, CASE WHEN NOT ok THEN NULL WHEN moved THEN x ELSE ax END, CASE WHEN NOT ok THEN NULL WHEN moved THEN y ELSE ay END, CASE WHEN NOT ok THEN NULL WHEN moved THEN t_us ELSE tt END, CASE WHEN NOT ok THEN NULL WHEN moved THEN CAST(0 AS DOUBLE) ELSE (t_us - tt) / 1e6 END
 FROM (SELECT o.*, dw.ax, dw.ay, dw.tt, dw.ax IS NULL OR pow(o.x - dw.ax, 2) + pow(o.y - dw.ay, 2) > 100 AS moved FROM o JOIN dw ON dw.track_id = o.track_id AND o.i = dw.i + 1))"""


@query("dwell_timer", f"WITH RECURSIVE {PTS}, {XY}, {DWELL} SELECT track_id, seq, round(d, 6) AS dwell_s FROM dw")
def dwell_timer(spark, d):
    p = placed(spark, d).withColumns({"x": F.expr("floor(x / 2000) * 2000"), "y": F.expr("floor(y / 2000) * 2000"), "ok": F.col("domain") == "vehicle"})
    return places.dwell(p.select("track_id", "seq", "t_us", "x", "y", "ok")).select("track_id", "seq", F.round("dwell_s", 6).alias("dwell_s"))


LAT2, LON2 = geo.offset("lat", "lon", "track_deg", "(gs_mps * s)")


@query("forecast_steps", f"WITH {PTS}, st AS (SELECT track_id, seq, lat, lon, track_deg, gs_mps, unnest(generate_series(0, 12)) * 5.0 AS s FROM pts WHERE gs_mps >= 1 AND track_deg IS NOT NULL) SELECT track_id, seq, CAST(s AS DOUBLE) AS step_s, round({LAT2}, 7) AS lat, round({LON2}, 7) AS lon FROM st")
def forecast_steps(spark, d):
    p = points(spark, d).select("track_id", "seq", F.col("lat").alias("aux_lat"), F.col("lon").alias("aux_lon"), F.col("gs_mps").alias("aux_gs_mps"), F.col("track_deg").alias("aux_track_deg"))
    return halos.path(p).select("track_id", "seq", "step_s", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


FC = f"""stp AS (SELECT seq AS track_id, lat, lon, track_deg, gs_mps, unnest(generate_series(0, 12)) * 5.0 AS s FROM pts WHERE gs_mps >= 1 AND track_deg IS NOT NULL), ps AS (SELECT track_id, s, {LAT2} AS lat, {LON2} AS lon FROM stp), xq AS (SELECT track_id, s, {X} AS x, {Y} AS y FROM ps),
sg AS (SELECT track_id, s, zone_id, x, y, (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 AS hit, {T01} AS u, x1, y1, x2, y2 FROM xq, sd),
dz AS (SELECT track_id, s, zone_id, CASE WHEN count(*) FILTER (hit) % 2 = 1 THEN 0 ELSE min(sqrt(pow(x - (x1 + u * (x2 - x1)), 2) + pow(y - (y1 + u * (y2 - y1)), 2))) END AS dist FROM sg GROUP BY ALL),
en AS (SELECT track_id, zone_id, min(s) AS eta FROM dz WHERE dist <= 150 GROUP BY ALL HAVING min(s) > 0)"""


@query("forecast_entry", f"WITH {PTS}, {ZT}, {SIDES}, {FC} SELECT track_id, arg_min(zone_id, struct_pack(a := eta, b := zone_id)) AS risk_zone_id, CAST(min(eta) AS DOUBLE) AS eta_s FROM en GROUP BY track_id")
def forecast_entry(spark, d):
    rows = points(spark, d).select(F.col("seq").alias("track_id"), F.col("lat").alias("aux_lat"), F.col("lon").alias("aux_lon"), F.col("gs_mps").alias("aux_gs_mps"), F.col("track_deg").alias("aux_track_deg"))
    areas = zones(spark).select(F.col("zone_id").alias("risk_zone_id"), F.col("criticality").alias("level"), F.col("zone_name").alias("label"), "ring")
    return halos.forecasts(rows, areas).select("track_id", "risk_zone_id", "eta_s")


# ---------------------------------------------------------------- the map's features of windows

BOUNDARY = [(X0 + 4200.0 + 4300.0 * c, Y0 + 4200.0 + 3600.0 * s_) for c, s_ in CORNERS]
BOUNDARY = [*BOUNDARY, BOUNDARY[0]]
TYPES = [("b738", "narrowbody"), ("C172", "light")]
GRID_ = motion.GRID
STEP, SPAN = TIMING.us("stride"), TIMING.us("window")


def layers(spark):
    boundary = spark.createDataFrame([(BOUNDARY,)], "ring array<struct<x:double,y:double>>")
    types = spark.createDataFrame(TYPES, "typecode string, size_class string")
    return {"zones": zones(spark), "access": access(spark), "buildings": buildings(spark), "routes": routes(spark), "runways": runways(spark), "boundary": boundary, "types": types}


def mapped(spark, d):
    return batch.features(points(spark, d), TIMING, layers(spark))


def windows_of(fx: str, columns: str) -> str:
    """Aggregates of fixes fx in each window of the grid; null where a window has none."""
    return f"SELECT g.track_id, g.k, {columns} FROM grid g LEFT JOIN {fx} f ON f.track_id = g.track_id AND f.t_us > g.k * {STEP} - {SPAN} AND f.t_us <= g.k * {STEP} GROUP BY ALL"


TAXI_KINDS = ", ".join(f"'{t}'" for t in places.TAXI)


@query("taxi_mask", f"""WITH {PTS}, {XY}, {NEAR}, z AS (SELECT track_id, seq, bool_or(zone_type = 'runway') AS rw, bool_or(zone_type IN ({TAXI_KINDS})) AS tx FROM dz JOIN zn USING (zone_id) WHERE dist <= 50 GROUP BY ALL)
SELECT p.track_id, p.seq, coalesce(domain = 'aircraft' AND on_ground AND tx AND NOT rw, false) AS taxi_surface FROM pts p LEFT JOIN z USING (track_id, seq)""")
def taxi_mask(spark, d):
    return places.with_taxi(points(spark, d), zones(spark)).select("track_id", "seq", "taxi_surface")


GND = "gnd AS (SELECT *, domain = 'vehicle' OR coalesce(on_ground, false) AS ground FROM xy)"
BSD = table("bsd", "x1, y1, x2, y2", [(*a, *b) for a, b in zip(BOUNDARY, BOUNDARY[1:], strict=False)])
CROSS = "(y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1"
GROUND_FIX = f"""{NEAR}, {ED}, {BLD}, {BSD}, {GND},
inz AS (SELECT track_id, seq, max(criticality) AS crit, bool_or(dist <= 10) AS near FROM dz JOIN zn USING (zone_id) WHERE dist <= 50 GROUP BY ALL),
inb AS (SELECT track_id, seq, bool_or(odd) AS inside FROM (SELECT track_id, seq, building_id, count(*) FILTER ({CROSS}) % 2 = 1 AS odd FROM xy, bd GROUP BY ALL) GROUP BY ALL),
ina AS (SELECT track_id, seq, count(*) FILTER ({CROSS}) % 2 = 1 AS inside FROM xy, bsd GROUP BY ALL),
rte AS (SELECT track_id, seq, min(sqrt(pow(x - (x1 + u * (x2 - x1)), 2) + pow(y - (y1 + u * (y2 - y1)), 2))) AS route_m FROM (SELECT p.track_id, p.seq, x, y, {T01} AS u, x1, y1, x2, y2 FROM xy p JOIN ed ON ed.domain = p.domain) GROUP BY ALL),
gfx AS (SELECT gnd.track_id, gnd.seq, t_us, ground, CASE WHEN ground THEN route_m END AS route_m, CASE WHEN ground THEN CAST(inb.inside AS DOUBLE) END AS in_building, CASE WHEN ground THEN CAST(NOT ina.inside AS DOUBLE) END AS outside,
 CASE WHEN ground AND ina.inside THEN CAST(NOT coalesce(near, false) AS DOUBLE) END AS offzone, CASE WHEN ground THEN coalesce(inz.crit, 0) END AS crit FROM gnd JOIN inb USING (track_id, seq) JOIN ina USING (track_id, seq) LEFT JOIN rte USING (track_id, seq) LEFT JOIN inz USING (track_id, seq))"""


@query("ground_map_features", f"WITH {PTS}, {XY}, {GRID_}, {GROUND_FIX} " + windows_of("gfx", "round(max(route_m), 3) AS spa_route_dist_max_m, round(avg(route_m), 3) AS spa_route_dist_mean_m, round(avg(offzone), 6) AS spa_offzone_frac, round(avg(in_building), 6) AS spa_in_building_frac, CAST(avg(outside) > 0.5 AS DOUBLE) AS spa_off_airport"))
def ground_map_features(spark, d):
    three, six = ("spa_route_dist_max_m", "spa_route_dist_mean_m"), ("spa_offzone_frac", "spa_in_building_frac")
    return mapped(spark, d).select("track_id", "k", *[F.round(c, 3).alias(c) for c in three], *[F.round(c, 6).alias(c) for c in six], "spa_off_airport")


GS_ = "CASE WHEN track_deg IS NULL AND gs_mps > 3 THEN NULL ELSE gs_mps END"
AXES = [(*places.to_metric(RUNWAYS[i][2], RUNWAYS[i][3]), *places.to_metric(RUNWAYS[i + 1][2], RUNWAYS[i + 1][3])) for i in (0, 2)]
AXIS = "least(" + ", ".join(f"abs((x - {a!r}) * ({e!r} - {b!r}) - (y - {b!r}) * ({c!r} - {a!r})) / {math.hypot(c - a, e - b)!r}" for a, b, c, e in AXES) + ")"
AIR_FIX = f"""{RW}, {GND}, air AS (SELECT *, {GS_} AS gs, coalesce(alt_geom_m, alt_baro_m) AS alt, asset_class <> 'helicopter' AS checks FROM gnd WHERE NOT ground AND domain = 'aircraft'),
ends_ AS (SELECT track_id, seq, rend, gs, vrate_mps, alt, elev, checks, {geo.distance_m('lat', 'lon', 'tlat', 'tlon')} AS d, {geo.azimuth('lat', 'lon', 'tlat', 'tlon')} AS az, bearing, track_deg FROM air, rw),
cand AS (SELECT *, abs({geo.wrap180('az - bearing')}) AS ang FROM ends_ WHERE abs({geo.wrap180('track_deg - bearing')}) <= 30),
bst AS (SELECT track_id, seq, arg_min(cand, struct_pack(l := d * sin(radians(ang)), e := rend)) AS r FROM cand WHERE ang < 90 GROUP BY ALL),
fnl AS (SELECT track_id, seq, r.rend AS rend, r.ang AS aside, abs(degrees(atan2(r.alt - r.elev, r.d)) - 3) AS glide, abs(-r.vrate_mps - r.gs * tan(radians(3))) / nullif(r.gs * tan(radians(3)), 0) AS descent FROM bst WHERE r.d <= 10000 AND NOT coalesce(r.alt - r.elev > tan(radians(6)) * r.d + 150, false)),
afx AS (SELECT g.track_id, g.seq, g.t_us, CASE WHEN checks THEN aside END AS aside, CASE WHEN checks THEN glide END AS glide, CASE WHEN checks THEN descent END AS descent,
 CASE WHEN checks AND alt IS NOT NULL THEN CAST(alt - 4 < 150 AND {AXIS} > 500 AS DOUBLE) END AS phase,
 CASE WHEN g.domain = 'aircraft' AND g.on_ground IS NOT NULL THEN CAST((g.on_ground AND coalesce(g.alt_baro_m - 4 > 300, false)) OR (NOT g.on_ground AND g.asset_class <> 'helicopter' AND coalesce({GS_.replace("track_deg", "g.track_deg").replace("gs_mps", "g.gs_mps")} < 10, false)) AS DOUBLE) END AS conflict
 FROM gnd g LEFT JOIN (SELECT track_id, seq, alt, checks FROM air) a USING (track_id, seq) LEFT JOIN fnl USING (track_id, seq))"""


@query("air_map_features", f"WITH {PTS}, {XY}, {GRID_}, {AIR_FIX.replace('{AXIS}', AXIS)} " + windows_of("afx", "round(max(aside), 6) AS ctx_app_lateral_dev_deg, round(max(glide), 6) AS ctx_app_glide_dev_deg, round(avg(descent), 6) AS ctx_app_descent_dev_ratio, round(avg(phase), 6) AS ctx_phase_conflict_frac, round(avg(conflict), 6) AS ctx_ground_alt_conflict"))
def air_map_features(spark, d):
    names = ("ctx_app_lateral_dev_deg", "ctx_app_glide_dev_deg", "ctx_app_descent_dev_ratio", "ctx_phase_conflict_frac", "ctx_ground_alt_conflict")
    return mapped(spark, d).select("track_id", "k", *[F.round(c, 6).alias(c) for c in names])


IDENT = f"""sgn AS (SELECT *, last_value(callsign IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY t_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sign, CASE typecode_raw WHEN 'B738' THEN 'narrowbody' WHEN 'C172' THEN 'light' ELSE CASE WHEN typecode_raw IS NOT NULL THEN 'other' END END AS cls, {GS_} AS gs FROM pts),
idn AS (SELECT track_id, seq, t_us, CASE WHEN domain = 'aircraft' AND cls IS NOT NULL THEN CAST(regexp_matches(coalesce(sign, ''), '^[A-Z]{{3}}[0-9]') AND cls IN ('light', 'other') AS DOUBLE) END AS a,
 CASE WHEN domain = 'aircraft' AND cls IS NOT NULL THEN CAST(coalesce(NOT coalesce(on_ground, false) AND gs > CASE cls WHEN 'light' THEN 100 ELSE 320 END, false) AS DOUBLE) END AS b FROM sgn)"""


@query("identity_mismatch", f"WITH {PTS}, {GRID_}, {IDENT} " + windows_of("idn", "max(a) + max(b) AS ctx_identity_mismatch"))
def identity_mismatch(spark, d):
    return mapped(spark, d).select("track_id", "k", "ctx_identity_mismatch")


@query("elevation_grid", f"""WITH {BLD}, cells AS (SELECT i, j, (i + 0.5) * 40 AS x, (j + 0.5) * 40 AS y FROM range({int(X0 // 40) - 10}, {int(X0 // 40) + 260}) a(i), range({int(Y0 // 40) - 10}, {int(Y0 // 40) + 160}) b(j)),
sg AS (SELECT i, j, building_id, height, x, y, {CROSS} AS hit, {T01} AS u, x1, y1, x2, y2 FROM cells, bd),
db AS (SELECT i, j, building_id, any_value(height) AS height, CASE WHEN count(*) FILTER (hit) % 2 = 1 THEN 0 ELSE min(sqrt(pow(x - (x1 + u * (x2 - x1)), 2) + pow(y - (y1 + u * (y2 - y1)), 2))) END AS dist FROM sg GROUP BY ALL)
SELECT i, j, round(max(degrees(atan2(height, greatest(dist, 1)))), 6) AS elevation_deg FROM db WHERE dist <= 150 GROUP BY ALL""")
def elevation_grid(spark, d):
    return places.elevation_grid(buildings(spark), 40.0).select("i", "j", F.round("elevation_deg", 6).alias("elevation_deg"))


# ---------------------------------------------------------------- metrics and membership


SCORED = f"sc AS (SELECT track_id, seq, CAST(seq * 7919 % 1000 AS DOUBLE) / 1000 AS p, (seq * 31 % 97) < 40 + seq * 7919 % 1000 / 40 AS y FROM pts)"


def judged(spark, d):
    return points(spark, d).select("track_id", "seq", (F.expr("CAST(seq * 7919 % 1000 AS DOUBLE) / 1000")).alias("p"), F.expr("(seq * 31 % 97) < 40 + seq * 7919 % 1000 / 40").alias("y"), "asset_class")


@query("ece_bins", f"WITH {PTS}, {SCORED}, b AS (SELECT least(14, floor(p * 15)) AS bin, avg(p) AS c, avg(CAST(y AS DOUBLE)) AS a, count(*) AS n FROM sc GROUP BY ALL) SELECT round(sum(abs(c - a) * n) / sum(n), 6) AS ece FROM b")
def ece_bins(spark, d):
    return models.ece(judged(spark, d), "p", "y").select(F.round("ece", 6).alias("ece"))


@query("average_precision", f"WITH {PTS}, {SCORED}, g AS (SELECT p, count(*) FILTER (y) AS pos, count(*) AS n FROM sc GROUP BY p), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(n) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER () AS t FROM g) SELECT round(sum(pos / t * cp / cn), 6) AS average_precision FROM c")
def average_precision(spark, d):
    return models.average_precision(judged(spark, d), "p", "y").select(F.round("average_precision", 6).alias("average_precision"))


@query("auroc", f"WITH {PTS}, {SCORED}, r AS (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM sc), s AS (SELECT count(*) FILTER (y) AS np, count(*) FILTER (NOT y) AS nn, sum(rk) FILTER (y) AS sr FROM r) SELECT round((sr - np * (np + 1) / 2.0) / (np * nn), 6) AS auroc FROM s")
def auroc(spark, d):
    return models.auroc(judged(spark, d), "p", "y").select(F.round("auroc", 6).alias("auroc"))


@query("macro_f1", f"WITH {PTS}, {SCORED}, c AS (SELECT CASE WHEN p > 0.6 THEN 'a' WHEN p > 0.3 THEN 'b' ELSE 'c' END AS g, CASE WHEN y THEN 'a' WHEN seq % 2 = 0 THEN 'b' ELSE 'c' END AS t FROM sc), k AS (SELECT unnest(['a', 'b', 'c']) AS k), f AS (SELECT k, 2.0 * (SELECT count(*) FROM c WHERE g = k AND t = k) / ((SELECT count(*) FROM c WHERE g = k) + (SELECT count(*) FROM c WHERE t = k)) AS f1 FROM k) SELECT round(avg(f1), 6) AS macro_f1 FROM f")
def macro_f1(spark, d):
    j = judged(spark, d).selectExpr("CASE WHEN p > 0.6 THEN 'a' WHEN p > 0.3 THEN 'b' ELSE 'c' END AS g", "CASE WHEN y THEN 'a' WHEN seq % 2 = 0 THEN 'b' ELSE 'c' END AS t")
    return models.macro_f1(j, "g", "t").select(F.round("macro_f1", 6).alias("macro_f1"))


@query("precision_recall", f"WITH {PTS}, {SCORED}, s AS (SELECT sc.*, asset_class FROM sc JOIN pts USING (track_id, seq)), g AS (SELECT asset_class, count(*) FILTER (p > 0.5 AND y) AS tp, count(*) FILTER (p > 0.5 AND NOT y) AS fp, count(*) FILTER (p <= 0.5 AND y) AS fn FROM s GROUP BY ALL) SELECT asset_class, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM g")
def precision_recall(spark, d):
    return models.precision_recall(judged(spark, d).withColumn("f", F.col("p") > 0.5), "f", "y", ["asset_class"]).select("asset_class", "tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("split_assign", f"""WITH {PTS}, s AS (SELECT track_id AS scene_id, min(asset_class) AS stratum FROM pts GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || scene_id), scene_id) - 1 + CAST('0x' || substr(md5('42|' || stratum), 1, 6) AS BIGINT) / 16777216.0 AS u, count(*) OVER (PARTITION BY stratum) AS n FROM s)
SELECT scene_id, stratum, CASE WHEN u / n - floor(u / n) < 0.6 THEN 'train' WHEN u / n - floor(u / n) < 0.8 THEN 'calib' ELSE 'test' END AS part FROM r""")
def split_assign(spark, d):
    s = points(spark, d).groupBy(F.col("track_id").alias("scene_id")).agg(F.min("asset_class").alias("stratum"))
    return models.split_scenes(s, ["stratum"])


@query("semi_anti_membership", "SELECT o_orderstatus, count(*) FILTER (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS semi, count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS anti FROM orders GROUP BY ALL")
def semi_anti_membership(spark, d):
    o, c = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/customer.parquet").filter("c_acctbal > 0")
    semi = o.join(c, o["o_custkey"] == c["c_custkey"], "left_semi").groupBy("o_orderstatus").agg(F.count("*").alias("semi"))
    anti = o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("anti"))
    return semi.join(anti, "o_orderstatus", "full").select("o_orderstatus", F.coalesce("semi", F.lit(0)).alias("semi"), F.coalesce("anti", F.lit(0)).alias("anti"))

"""Positions against a map: zones, buildings, routes, runways. Layers are small tables; tiles make spatial joins equal joins.

Layers:
  zones      zone_id, zone_name, zone_type, criticality, speed_limit_mps, ring ARRAY<STRUCT<x, y>> (closed, metric)
  buildings  building_id, height_m, ring
  routes     edge_id, domain, x1, y1, x2, y2
  runways    runway, end, threshold_lat, threshold_lon, elevation_m, bearing_deg
  access     zone_type, asset_class, allowed, max_dwell_s

A polygon is sent to the tiles its box (and a margin) touches, a position to
its own, so each pair meets once and only pairs of one tile are refined.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywarden import params, registry
from waywarden.functions import geo
from waywarden.operators.fixes import TRACK, so_far

TILE_M = 250.0
TAXI = ("taxiway", "apron", "stand", "holding_point")


def metric(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return geo.with_utm(df, lat, lon, "x", "y")


def tiled(polygons: DataFrame, margin: float = 0.0, tile: float = TILE_M) -> DataFrame:
    """polygons once for each tile that their box, widened by margin, touches: tx, ty."""
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    at = lambda v: F.floor(v / tile)
    out = polygons.withColumn("tx", F.explode(F.sequence(at(F.array_min(xs) - margin), at(F.array_max(xs) + margin))))
    return out.withColumn("ty", F.explode(F.sequence(at(F.array_min(ys) - margin), at(F.array_max(ys) + margin))))


def _tile_of(tile: float) -> dict[str, Column]:
    """A position's tile; never null, so that no null check pulls the projection of x and y below the join."""
    far = F.lit(-(1 << 40)).cast("long")
    return {f"t{v}": F.coalesce(F.floor(F.col(v) / tile), far) for v in "xy"}


def near_polygons(positions: DataFrame, polygons: DataFrame, within: float = 0.0, tile: float = TILE_M) -> DataFrame:
    """Pairs of positions (with x, y) and polygons at most `within` metres apart, and dist (0 inside).

    Catalyst joins on the tile; the polygons' side is broadcast only below Spark's size limit.
    """
    p = positions.withColumns(_tile_of(tile))
    pairs = p.join(tiled(polygons, within, tile), ["tx", "ty"]).drop("tx", "ty")
    if within == 0:
        return pairs.filter(geo.in_ring(F.col("x"), F.col("y"), F.col("ring"))).withColumn("dist", F.lit(0.0))
    return pairs.withColumn("dist", geo.to_ring_m(F.col("x"), F.col("y"), F.col("ring"))).filter(F.col("dist") <= within)


def nearest_edge(positions: DataFrame, routes: DataFrame, key: list[str], tile: float = 1_000.0) -> DataFrame:
    """key and route_m: the distance to the nearest edge of the position's domain.

    Edges go to the tiles around their box; a position whose nearest edge of
    its tile is farther than a tile's width, or that has none, is looked up
    against all edges: the layer is small, the positions left are few.
    """
    e = routes.withColumns({"xa": F.least("x1", "x2"), "xb": F.greatest("x1", "x2"), "ya": F.least("y1", "y2"), "yb": F.greatest("y1", "y2")})
    e = e.withColumn("tx", F.explode(F.sequence(F.floor((F.col("xa") - tile) / tile), F.floor((F.col("xb") + tile) / tile))))
    e = e.withColumn("ty", F.explode(F.sequence(F.floor((F.col("ya") - tile) / tile), F.floor((F.col("yb") + tile) / tile))))
    d = geo.to_segment_m(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    p = positions.select(*key, "domain", "x", "y").withColumns(_tile_of(tile))
    first = p.join(e.drop("xa", "xb", "ya", "yb"), ["domain", "tx", "ty"], "left").groupBy(*key, "domain", "x", "y").agg(F.min(d).alias("route_m"))
    sure = F.col("route_m") <= tile
    rest = first.filter(~F.coalesce(sure, F.lit(False))).join(routes, "domain").groupBy(*key).agg(F.min(d).alias("route_m"))
    return first.filter(sure).select(*key, "route_m").unionByName(rest)


def access_rule(pairs: DataFrame, access: DataFrame) -> DataFrame:
    """pairs (zone_type, asset_class) with allowed (true where no rule is known) and max_dwell_s."""
    a = access.select("zone_type", "asset_class", "allowed", "max_dwell_s")
    return pairs.join(a, ["zone_type", "asset_class"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def ground_zones(positions: DataFrame, zones: DataFrame, access: DataFrame) -> DataFrame:
    """(track_id, seq) of ground fixes near zones, with crit, zone_id, zone_name, zone_type, limit, violation, max_dwell, in_zone.

    crit and the zone: the most critical within 50 m, then the nearest, then
    the first id. limit: the lowest within 10 m. violation: the highest
    criticality of an occupied zone where the class is not allowed, unless
    another zone within 10 m allows it and the forbidden one is no runway.
    """
    pairs = access_rule(near_polygons(positions.select(TRACK, "seq", "asset_class", "x", "y"), zones, params.ZONE_BUFFER_M), access)
    inside, near = F.col("dist") == 0, F.col("dist") <= params.OCCUPANCY_M
    bad = inside & ~F.col("allowed")
    g = pairs.groupBy(TRACK, "seq").agg(
        F.min(F.struct((-F.col("criticality")).alias("c"), "dist", "zone_id", "zone_name", "zone_type", "criticality", "speed_limit_mps")).alias("top"),
        F.min(F.when(near, F.col("speed_limit_mps"))).alias("limit"),
        F.max(F.when(bad & (F.col("zone_type") == "runway"), F.col("criticality"))).alias("bad_runway"),
        F.max(F.when(bad, F.col("criticality"))).alias("bad_any"),
        F.bool_or(near & F.col("allowed")).alias("somewhere"),
        F.max(F.when(inside & F.col("max_dwell_s").isNotNull(), F.struct("criticality", (-F.col("max_dwell_s")).alias("d")))).alias("dwell"),
        F.bool_or(near).alias("in_zone"),
    )
    violation = F.when(F.col("somewhere"), F.col("bad_runway")).otherwise(F.col("bad_any"))
    return g.select(
        TRACK,
        "seq",
        F.col("top.criticality").alias("crit"),
        *[F.col(f"top.{c}").alias(c) for c in ("zone_id", "zone_name", "zone_type", "speed_limit_mps")],
        "limit",
        F.coalesce(violation, F.lit(0.0)).alias("violation"),
        (-F.col("dwell.d")).alias("max_dwell"),
        "in_zone",
    )


def dwell(positions: DataFrame) -> DataFrame:
    """positions (x, y, ok) with dwell_s: time since the asset last moved more than 10 m from its anchor.

    The anchor depends on the one before it, so a track folds in order over its
    sorted partition, a batch at a time. A fix that is not ok has none and
    resets it.
    """
    rows = positions.repartition(TRACK).sortWithinPartitions(TRACK, "t_us", "seq")
    limit = params.DWELL_MOVE_M**2

    def run(batches):
        track, anchor = None, None
        for b in batches:
            out = []
            for t, us, x, y, ok in zip(*(b.column(c).to_pylist() for c in (TRACK, "t_us", "x", "y", "ok")), strict=True):
                if t != track:
                    track, anchor = t, None
                if not ok:
                    anchor = None
                    out.append(None)
                    continue
                if anchor is None or (x - anchor[0]) ** 2 + (y - anchor[1]) ** 2 > limit:
                    anchor = (x, y, us)
                out.append((us - anchor[2]) / 1e6)
            yield b.append_column("dwell_s", pa.array(out, pa.float64()))

    # the other columns pass as the Arrow buffers they are
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in positions.schema)
    return rows.mapInArrow(run, f"{schema}, dwell_s double")


def approach(positions: DataFrame, runways: DataFrame) -> DataFrame:
    """(track_id, seq) of airborne fixes with lateral, glide, descent, end, final: against the aligned end with the nearest extended centreline.

    The distance and height limits apply to that end only. Runway ends are a
    handful, so each fix meets all of them in a broadcast join.
    """
    p = positions.select(TRACK, "seq", "lat", "lon", "track_deg", "gs", "vrate_mps", F.coalesce("alt_geom_m", "alt_baro_m").alias("alt"))
    e = p.crossJoin(F.broadcast(runways))
    e = e.withColumns({"d": F.expr(geo.distance_m("lat", "lon", "threshold_lat", "threshold_lon")), "to": F.expr(geo.azimuth("lat", "lon", "threshold_lat", "threshold_lon"))})
    e = e.withColumns({"ang": F.abs(F.expr(geo.wrap180("to - bearing_deg"))), "turned": F.abs(F.expr(geo.wrap180("track_deg - bearing_deg")))})
    e = e.filter((F.col("turned") <= params.ALIGN_DEG) & (F.col("ang") < 90)).withColumn("lateral_m", F.col("d") * F.sin(F.radians("ang")))
    best = e.groupBy(TRACK, "seq").agg(F.min(F.struct("lateral_m", "end", "d", "ang", "alt", "elevation_m", "gs", "vrate_mps")).alias("b")).select(TRACK, "seq", "b.*")
    height = F.col("alt") - F.col("elevation_m")
    high = height > math.tan(math.radians(params.CONE_DEG)) * F.col("d") + params.CONE_FLOOR_M
    final = (F.col("d") <= params.FINAL_KM * 1000) & ~F.coalesce(high, F.lit(False))
    ref = F.col("gs") * math.tan(math.radians(params.GLIDESLOPE_DEG))
    return best.filter(final).select(
        TRACK,
        "seq",
        "end",
        F.col("ang").alias("lateral"),
        F.abs(F.degrees(F.atan2(height, F.col("d"))) - params.GLIDESLOPE_DEG).alias("glide"),
        F.try_divide(F.abs(-F.col("vrate_mps") - ref), ref).alias("descent"),
    )


def axis_distance(positions: DataFrame, runways: list[dict]) -> Column:
    """Distance to the nearest runway axis, a line through both thresholds; runways as rows of the layer, on the driver."""
    out = None
    named: dict[str, list[dict]] = {}
    for r in runways:
        named.setdefault(r["runway"], []).append(r)
    for ends in named.values():
        (x0, y0), (x1, y1) = (to_metric(ends[i]["threshold_lat"], ends[i]["threshold_lon"]) for i in (0, -1))
        n = math.hypot(x1 - x0, y1 - y0)
        d = F.abs((F.col("x") - x0) * (y1 - y0) - (F.col("y") - y0) * (x1 - x0)) / n
        out = d if out is None else F.least(out, d)
    return out


def to_metric(lat: float, lon: float) -> tuple[float, float]:
    """utm() for the driver's small tables, by the same series."""
    e = math.sqrt(geo.E2)
    s = math.sin(math.radians(lat))
    t = math.sinh(math.atanh(s) - e * math.atanh(e * s))
    dl = math.radians(lon - geo.ZONE_LON)
    xi, eta = math.atan2(t, math.cos(dl)), math.atanh(math.sin(dl) / math.sqrt(1 + t * t))
    a = eta + sum(k * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, k in enumerate(geo.ALPHA, 1))
    b = xi + sum(k * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, k in enumerate(geo.ALPHA, 1))
    return geo.FALSE_EAST + geo.K0 * geo.RADIUS * a, geo.K0 * geo.RADIUS * b


def taxi_surface(positions: DataFrame, zones: DataFrame) -> DataFrame:
    """(track_id, seq) of positions (x, y) within 50 m of a taxi surface and farther than that from every runway."""
    near = near_polygons(positions.select(TRACK, "seq", "x", "y"), zones.filter(F.col("zone_type").isin(*TAXI, "runway")), params.ZONE_BUFFER_M)
    g = near.groupBy(TRACK, "seq").agg(F.bool_or(F.col("zone_type") == "runway").alias("runway"), F.bool_or(F.col("zone_type") != "runway").alias("taxi"))
    return g.filter("taxi AND NOT runway").select(TRACK, "seq")


def with_taxi(points: DataFrame, zones: DataFrame) -> DataFrame:
    """points with taxi_surface: where an aircraft on the ground is bound to its class's limit for taxiing."""
    rolling = metric(points.filter((F.col("domain") == "aircraft") & F.col("on_ground")).select(TRACK, "seq", "lat", "lon"))
    on = taxi_surface(rolling, zones).withColumn("taxi_surface", F.lit(True))
    return points.join(on, [TRACK, "seq"], "left").withColumn("taxi_surface", F.coalesce("taxi_surface", F.lit(False)))


def elevation_grid(buildings: DataFrame, cell: float = 10.0, reach: float = 150.0) -> DataFrame:
    """(i, j, elevation_deg): building_elevation() at the middle of each cell of a grid that has a building within reach.

    Each building gives the cells around it, so the table grows with the
    buildings and not with the positions that look it up.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.sequence(F.floor((F.array_min(v) - reach) / cell), F.floor((F.array_max(v) + reach) / cell))
    at = buildings.select("height_m", "ring", F.explode(span(xs)).alias("i"), span(ys).alias("_j")).withColumn("j", F.explode("_j"))
    d = geo.to_ring_m((F.col("i") + 0.5) * cell, (F.col("j") + 0.5) * cell, F.col("ring"))
    near = at.withColumn("d", d).filter(F.col("d") <= reach)
    return near.groupBy("i", "j").agg(F.max(F.degrees(F.atan2("height_m", F.greatest("d", F.lit(1.0))))).alias("elevation_deg"))


def building_elevation(positions: DataFrame, buildings: DataFrame, key: list[str], reach: float = 150.0) -> DataFrame:
    """key and elevation_deg: the steepest angle to a building's top within reach, from at least 1 m away."""
    near = near_polygons(positions.select(*key, "x", "y"), buildings, reach)
    return near.groupBy(*key).agg(F.max(F.degrees(F.atan2("height_m", F.greatest("dist", F.lit(1.0))))).alias("elevation_deg"))


def identity_rules(fixes: DataFrame, types: DataFrame) -> DataFrame:
    """fixes with rule_airline (an airline callsign on a light or unknown declared type) and rule_fast (faster than the declared class can fly).

    types: typecode, size_class, a row a typecode. Null where no type is declared.
    """
    t = types.select(F.upper(F.trim("typecode")).alias("_type"), F.col("size_class").alias("_known"))
    limits = registry.envelopes(fixes.sparkSession).select(F.col("asset_class").alias("_class"), F.col("air_max").alias("_max"))
    f = fixes.withColumn("_sign", F.last("callsign", ignorenulls=True).over(so_far()))
    f = f.join(t, F.upper(F.trim("typecode_raw")) == F.col("_type"), "left").withColumn("_class", F.when(F.col("typecode_raw").isNotNull(), F.coalesce("_known", F.lit("other"))))
    f = f.join(F.broadcast(limits), "_class", "left")  # 14 rows
    declared = (F.col("domain") == "aircraft") & F.col("_class").isNotNull()
    airline = F.coalesce("_sign", F.lit("")).rlike("^[A-Z]{3}[0-9]")
    return f.withColumns({
        "rule_airline": F.when(declared, (airline & F.col("_class").isin("light", "other")).cast("double")),
        "rule_fast": F.when(declared, F.coalesce(~F.col("ground") & (F.col("gs") > F.col("_max")), F.lit(False)).cast("double")),
    }).drop("_sign", "_type", "_known", "_class", "_max")


def map_fixes(fixes: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """fixes with the map's per-fix quantities, null where the map does not apply.

    layers has zones, access, and optionally buildings, routes, runways, types,
    and boundary, rings that hold the airport; without it nothing is outside.
    """
    box = lambda b: F.col("lat").between(b[0], b[2]) & F.col("lon").between(b[1], b[3])
    p = metric(fixes).withColumn("_ground", F.col("ground") & box(params.AIRPORT_BOX)).withColumn("_air", ~F.col("ground") & (F.col("domain") == "aircraft") & box(params.APPROACH_BOX))
    ground = p.filter("_ground")
    key = [TRACK, "seq"]
    if "types" in layers:
        p = identity_rules(p, layers["types"])
    out = dwell(p.withColumn("ok", F.col("_ground")).drop("j", "jj")).drop("ok")
    # the zone's limit beside the class's
    out = out.join(ground_zones(ground, layers["zones"], layers["access"]).withColumnRenamed("limit", "zone_limit"), key, "left")
    if "buildings" in layers:
        inside = near_polygons(ground.select(*key, "x", "y"), layers["buildings"]).select(*key).distinct().withColumn("_in", F.lit(1.0))
        out = out.join(inside, key, "left").withColumn("in_building", F.when(F.col("_ground"), F.coalesce("_in", F.lit(0.0)))).drop("_in")
    if "routes" in layers:
        out = out.join(nearest_edge(ground, layers["routes"], key), key, "left")
    outside = F.lit(False)
    if "boundary" in layers:
        within = near_polygons(ground.select(*key, "x", "y"), layers["boundary"], tile=1_000.0).select(*key).distinct().withColumn("_within", F.lit(True))
        out, outside = out.join(within, key, "left"), F.col("_within").isNull()
    g = F.col("_ground")
    out = out.withColumns({
        "outside": F.when(g, outside.cast("double")),
        "offzone": F.when(g & ~outside, (~F.coalesce("in_zone", F.lit(False))).cast("double")),
        "zone_ratio": F.when(g, F.col("gs") / F.col("zone_limit")),
        "violation": F.when(g, F.coalesce("violation", F.lit(0.0))),
        "dwell_ratio": F.when(g, F.coalesce(F.try_divide("dwell_s", "max_dwell"), F.lit(0.0))),
        "crit": F.when(g, F.coalesce("crit", F.lit(0.0))),
    })
    if "runways" in layers:
        ends = [r.asDict() for r in layers["runways"].collect()]  # a handful of rows
        out = out.join(approach(p.filter("_air"), layers["runways"]), key, "left")
        fixed = F.col("_air") & F.col("kin_checks")
        alt = F.coalesce("alt_geom_m", "alt_baro_m") - float(ends[0]["elevation_m"])
        out = out.withColumns({
            "crit": F.when(F.col("_air"), F.when(F.col("end").isNotNull(), 1.0).otherwise(0.5)).otherwise(F.col("crit")),
            "phase": F.when(fixed & alt.isNotNull(), ((alt < params.PHASE_LOW_M) & (axis_distance(p, ends) > params.PHASE_AXIS_M)).cast("double")),
            **{c: F.when(fixed, F.col(c)) for c in ("lateral", "glide", "descent")},
        })
        known = (F.col("domain") == "aircraft") & box(params.AIRPORT_BOX) & F.col("on_ground").isNotNull()
        high = F.col("on_ground") & F.coalesce(F.col("alt_baro_m") - float(ends[0]["elevation_m"]) > params.GROUND_ALT_CONFLICT_M, F.lit(False))
        slow = ~F.col("on_ground") & F.col("kin_checks") & F.coalesce(F.col("gs") < params.AIRBORNE_MIN_MPS, F.lit(False))
        out = out.withColumn("conflict", F.when(known, (high | slow).cast("double")))
    return out


MAP_MEANS = {"spa_route_dist_mean_m": "route_m", "spa_offzone_frac": "offzone", "spa_in_building_frac": "in_building", "ctx_ground_alt_conflict": "conflict", "ctx_phase_conflict_frac": "phase", "ctx_app_descent_dev_ratio": "descent", "outside_share": "outside"}
MAP_MAXIMA = {"spa_route_dist_max_m": "route_m", "spa_zone_crit_max": "crit", "ctx_zone_speed_ratio_max": "zone_ratio", "ctx_type_violation_crit_max": "violation", "ctx_dwell_ratio": "dwell_ratio", "ctx_app_lateral_dev_deg": "lateral", "ctx_app_glide_dev_deg": "glide", "rule_a": "rule_airline", "rule_b": "rule_fast"}


def map_windows(mapped: DataFrame, timing) -> DataFrame:
    """(track_id, k) with the spatial and contextual features and the zone behind the criticality, of windows that hold a fix."""
    from waywarden.operators.windows import latest, members

    has = lambda c: F.col(c) if c in mapped.columns else F.lit(None).cast("double")
    zone = F.when(F.col("_air"), F.struct(F.concat(F.lit("approach_"), "end").alias("zone_id"), F.concat(F.lit("final "), "end").alias("zone_name"), F.when(F.col("end").isNotNull(), "approach").alias("zone_type"), F.lit(None).cast("double").alias("speed_limit_mps"))) if "end" in mapped.columns else F.lit(None)
    zone = F.coalesce(zone, F.struct("zone_id", "zone_name", "zone_type", F.col("speed_limit_mps").cast("double").alias("speed_limit_mps")))
    # windows beyond a track's last are dropped by the join on the other features
    g = members(mapped.withColumn("_zone", zone), timing, last=False).groupBy(TRACK, "k").agg(
        *[F.avg(has(c)).alias(f) for f, c in MAP_MEANS.items()],
        *[F.max(has(c)).alias(f) for f, c in MAP_MAXIMA.items()],
        latest(F.col("_zone"), "crit").alias("z"),
        latest(F.col("zone_limit"), "zone_ratio").alias("lim"),
    )
    return g.withColumns({
        "spa_off_airport": (F.col("outside_share") > 0.5).cast("double"),
        "ctx_identity_mismatch": F.col("rule_a") + F.col("rule_b"),
        "aux_zone_id": F.col("z.zone_id"),
        "aux_zone_name": F.col("z.zone_name"),
        "aux_zone_type": F.col("z.zone_type"),
        "aux_zone_speed_limit_mps": F.coalesce("lim", "z.speed_limit_mps"),
    }).drop("outside_share", "rule_a", "rule_b", "z", "lim")

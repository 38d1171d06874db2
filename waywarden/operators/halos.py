"""Risk areas: shadows of buildings, live areas of alerts, and paths that run into one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waywarden import params
from waywarden.functions import geo
from waywarden.operators.fixes import TRACK
from waywarden.operators.places import building_elevation, metric, near_polygons


def error_ratio(elevation: float) -> float:
    """Growth of the position error with the angle of what stands in the way."""
    return 1 + (params.OBSTRUCTED_RATIO - 1) * min(max(elevation / params.FULL_OBSTRUCTION_DEG, 0.0), 1.0)


def static_bands() -> list[dict]:
    """Elevation bands from the steepest, with expected error and level."""
    out = []
    for angle in sorted(params.HALO_ELEVATION_DEG, reverse=True):
        ratio = error_ratio(angle)
        out.append({"risk_zone_id": f"static_elev{angle:.0f}", "angle": angle, "expected_error_m": round(params.OPEN_SIGMA_M * ratio * params.MEDIAN_ERROR_PER_SIGMA, 2), "level": round(1 - 1 / ratio, 3)})
    return out


def static_band(elevation: Column) -> Column:
    """The band of a position that sees a building at an elevation; null in the open."""
    out = F.lit(None).cast("string")
    for b in reversed(static_bands()):
        out = F.when(elevation >= b["angle"], b["risk_zone_id"]).otherwise(out)
    return out


def static_halos(positions: DataFrame, buildings: DataFrame, key: list[str]) -> DataFrame:
    """key and risk_zone_id of positions in a building's signal shadow: within height / tan(angle) of it."""
    return building_elevation(positions, buildings, key).select(*key, static_band(F.col("elevation_deg")).alias("risk_zone_id")).filter("risk_zone_id IS NOT NULL")


def cell_ring(q: Column, r: Column, side: float) -> Column:
    """A hexagon as a closed metric ring."""
    x, y = side * math.sqrt(3) * (q + r / 2), side * 1.5 * r
    corners = [(side * math.sin(math.pi / 3 * i), side * math.cos(math.pi / 3 * i)) for i in (*range(6), 0)]
    return F.array(*[F.struct((x + dx).alias("x"), (y + dy).alias("y")) for dx, dy in corners])


def live_halos(alerts: DataFrame, stride_s: float) -> DataFrame:
    """alerts with risk_zone_id, level, label, t_start (first step of the alert) and t_end."""
    first = alerts.groupBy("area_alert_id").agg(F.min("k").alias("k0"))
    label = F.format_string("Area GNSS alert: %d of %d assets degraded", "n_degraded", "n_tracks")
    return alerts.join(first, "area_alert_id").select("area_alert_id", "k", "cells", F.concat(F.lit("live_"), "area_alert_id").alias("risk_zone_id"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "share")).alias("level"), label.alias("label"), (F.col("k0") * stride_s).alias("t_start"), (F.col("k") * stride_s).alias("t_end"))


def halo_polygons(live: DataFrame, side: float) -> DataFrame:
    """(risk_zone_id, k, level, label, ring): one hexagon for each cell of a live halo."""
    c = live.withColumn("cell", F.explode("cells")).withColumn("_c", F.split("cell", ":"))
    return c.select("risk_zone_id", "k", "level", "label", cell_ring(F.col("_c")[0].cast("long"), F.col("_c")[1].cast("long"), side).alias("ring"))


def path(rows: DataFrame, horizon_s: float = params.HORIZON_S, stride_s: float = 5.0) -> DataFrame:
    """rows (aux_lat, aux_lon, aux_gs_mps, aux_track_deg) once for each step of their constant course: step_s, lat, lon. Slow or unknown ones have none."""
    ok = (F.col("aux_gs_mps") >= params.MOVING_MPS) & F.col("aux_track_deg").isNotNull() & F.col("aux_lat").isNotNull() & F.col("aux_lon").isNotNull()
    steps = F.array(*[F.lit(i * stride_s) for i in range(round(horizon_s / stride_s) + 1)])
    p = rows.filter(ok).withColumn("step_s", F.explode(steps))
    lat, lon = geo.offset("aux_lat", "aux_lon", "aux_track_deg", "(aux_gs_mps * step_s)")
    return p.withColumns({"lat": F.expr(lat), "lon": F.expr(lon)})


def forecasts(rows: DataFrame, polygons: DataFrame, within: float = params.HALO_M, key: str = TRACK) -> DataFrame:
    """(track, risk_zone_id, level, label, eta_s): the first halo that a path enters and that it is not in now.

    polygons (risk_zone_id, level, label, ring, and k where they change in
    time) reach `within` metres beyond their ring.
    """
    p = metric(path(rows))
    same = ["k"] if "k" in polygons.columns and "k" in rows.columns else []
    hits = near_polygons(p.select(key, "step_s", "x", "y", *[F.col(c).alias(f"_{c}") for c in same]), polygons, within)
    for c in same:
        hits = hits.filter(F.col(f"_{c}") == F.col(c))
    by = hits.groupBy(key, *same, "risk_zone_id", "level", "label").agg(F.min("step_s").alias("eta_s")).filter("eta_s > 0")
    best = by.groupBy(key, *same).agg(F.min(F.struct("eta_s", "risk_zone_id", "level", "label")).alias("b")).select(key, *same, "b.*")
    return best.withColumn("label", F.concat(F.lit("Path enters "), "label", F.format_string(" in %.0f s", "eta_s")))


def risk_zone(df: DataFrame, kind: str, geometry: Column) -> DataFrame:
    """Rows as GeoJSON features: a struct of type, geometry and properties."""
    skip = ("ring", "cells", "k")
    properties = F.struct(F.lit(kind).alias("kind"), *[F.col(c) for c in df.columns if c not in skip])
    return df.select(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")).alias("feature"))

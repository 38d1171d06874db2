"""Geodesy and geometry as SQL text, for columns of any engine that knows sin, cos, sqrt and atan2.

Distances up to some tens of kilometres use the ellipsoid's radii at the middle
latitude; the metric grid is the transverse Mercator series to third order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84, a fixed value.
A, E2 = 6378137.0, 6.69437999014e-3
FLAT = 1 / 298.257223563
N3 = FLAT / (2 - FLAT)
K0, ZONE_LON, FALSE_EAST = 0.9996, 15.0, 500_000.0
RADIUS = A / (1 + N3) * (1 + N3**2 / 4 + N3**4 / 64)
ALPHA = (N3 / 2 - 2 / 3 * N3**2 + 5 / 16 * N3**3, 13 / 48 * N3**2 - 3 / 5 * N3**3, 61 / 240 * N3**3)
BETA = (N3 / 2 - 2 / 3 * N3**2 + 37 / 96 * N3**3, 1 / 48 * N3**2 + 1 / 15 * N3**3, 17 / 480 * N3**3)
DELTA = (2 * N3 - 2 / 3 * N3**2 - 2 * N3**3, 7 / 3 * N3**2 - 8 / 5 * N3**3, 56 / 15 * N3**3)


def wrap180(x: str) -> str:
    """Angle folded into [-180, 180)."""
    return f"(({x}) + 180.0 - 360.0 * floor((({x}) + 180.0) / 360.0) - 180.0)"


def wrap360(x: str) -> str:
    return f"(({x}) - 360.0 * floor(({x}) / 360.0))"


def north_m(lat1: str, lat2: str) -> str:
    """Metres north from lat1 to lat2."""
    s = f"pow(sin(radians(({lat1} + {lat2}) / 2)), 2)"
    return f"(radians({lat2} - {lat1}) * {A * (1 - E2)!r} / pow(1 - {E2!r} * {s}, 1.5))"


def east_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    mid = f"radians(({lat1} + {lat2}) / 2)"
    return f"(radians({wrap180(f'{lon2} - {lon1}')}) * {A!r} * cos({mid}) / sqrt(1 - {E2!r} * pow(sin({mid}), 2)))"


def distance_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"sqrt(pow({east_m(lat1, lon1, lat2, lon2)}, 2) + pow({north_m(lat1, lat2)}, 2))"


def azimuth(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Degrees clockwise from north, in [0, 360)."""
    return wrap360(f"degrees(atan2({east_m(lat1, lon1, lat2, lon2)}, {north_m(lat1, lat2)}))")


def offset(lat: str, lon: str, bearing: str, metres: str) -> tuple[str, str]:
    """(lat, lon) some metres along a bearing, by the same radii taken twice."""
    dn, de = f"({metres} * cos(radians({bearing})))", f"({metres} * sin(radians({bearing})))"
    first = f"({lat} + degrees({dn} * pow(1 - {E2!r} * pow(sin(radians({lat})), 2), 1.5) / {A * (1 - E2)!r}))"
    mid = f"radians(({lat} + {first}) / 2)"
    to_lat = f"({lat} + degrees({dn} * pow(1 - {E2!r} * pow(sin({mid}), 2), 1.5) / {A * (1 - E2)!r}))"
    to_lon = f"({lon} + degrees({de} * sqrt(1 - {E2!r} * pow(sin({mid}), 2)) / ({A!r} * cos({mid}))))"
    return to_lat, to_lon


def utm(lat: str, lon: str) -> tuple[str, str]:
    """(east, north) metres in zone 33 north."""
    e = math.sqrt(E2)
    s = f"sin(radians({lat}))"
    atanh = lambda x: f"(0.5 * ln((1 + {x}) / (1 - {x})))"
    u = f"({atanh(s)} - {e!r} * {atanh(f'({e!r} * {s})')})"
    t = f"((exp({u}) - exp(-{u})) / 2)"
    dl = f"radians({lon} - {ZONE_LON})"
    xi = f"atan2({t}, cos({dl}))"
    eta_x = f"(sin({dl}) / sqrt(1 + {t} * {t}))"
    eta = atanh(eta_x)
    cosh = lambda x: f"((exp({x}) + exp(-({x}))) / 2)"
    sinh = lambda x: f"((exp({x}) - exp(-({x}))) / 2)"
    east = eta + "".join(f" + {a!r} * cos({2 * j} * {xi}) * {sinh(f'{2 * j} * {eta}')}" for j, a in enumerate(ALPHA, 1))
    north = xi + "".join(f" + {a!r} * sin({2 * j} * {xi}) * {cosh(f'{2 * j} * {eta}')}" for j, a in enumerate(ALPHA, 1))
    return f"({FALSE_EAST} + {K0 * RADIUS!r} * ({east}))", f"({K0 * RADIUS!r} * ({north}))"


def with_utm(df: DataFrame, lat: str, lon: str, x: str, y: str) -> DataFrame:
    """df with utm() as two columns; each intermediate value is a column of its own, so code stays small."""
    e, c = math.sqrt(E2), F.col
    s = F.sin(F.radians(lat))
    out = df.withColumns({"_s": s, "_dl": F.radians(c(lon) - ZONE_LON)})
    out = out.withColumn("_t", F.sinh(F.atanh("_s") - e * F.atanh(e * c("_s"))))
    out = out.withColumns({"_xi": F.atan2(c("_t"), F.cos("_dl")), "_eta": F.atanh(F.sin("_dl") / F.sqrt(1 + c("_t") * c("_t")))})
    east, north = c("_eta"), c("_xi")
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * c("_xi")) * F.sinh(2 * j * c("_eta"))
        north = north + a * F.sin(2 * j * c("_xi")) * F.cosh(2 * j * c("_eta"))
    return out.withColumns({x: FALSE_EAST + K0 * RADIUS * east, y: K0 * RADIUS * north}).drop("_s", "_dl", "_t", "_xi", "_eta")


def with_hex(df: DataFrame, x: str, y: str, side: float) -> DataFrame:
    """df with hex_axial() as q and r, in steps."""
    c = F.col
    out = df.withColumns({"_fq": (math.sqrt(3) / 3 * c(x) - c(y) / 3.0) / side, "_fr": 2.0 / 3.0 * c(y) / side})
    out = out.withColumn("_fs", -c("_fq") - c("_fr"))
    out = out.withColumns({f"_r{v}": F.floor(c(f"_f{v}") + 0.5) for v in "qrs"})
    out = out.withColumns({f"_d{v}": F.abs(c(f"_r{v}") - c(f"_f{v}")) for v in "qrs"})
    q_worst = (c("_dq") > c("_dr")) & (c("_dq") > c("_ds"))
    r_worst = ~q_worst & (c("_dr") > c("_ds"))
    out = out.withColumns({"q": F.when(q_worst, -c("_rr") - c("_rs")).otherwise(c("_rq")).cast("long"), "r": F.when(r_worst, -c("_rq") - c("_rs")).otherwise(c("_rr")).cast("long")})
    return out.drop("_fq", "_fr", "_fs", "_rq", "_rr", "_rs", "_dq", "_dr", "_ds")


def from_utm(x: float, y: float) -> tuple[float, float]:
    """(lat, lon) of a metric position, for the driver's small tables."""
    xi, eta = y / (K0 * RADIUS), (x - FALSE_EAST) / (K0 * RADIUS)
    a, b = xi, eta
    for j, k in enumerate(BETA, 1):
        a -= k * math.sin(2 * j * xi) * math.cosh(2 * j * eta)
        b -= k * math.cos(2 * j * xi) * math.sinh(2 * j * eta)
    chi = math.asin(math.sin(a) / math.cosh(b))
    lat = chi + sum(d * math.sin(2 * j * chi) for j, d in enumerate(DELTA, 1))
    return math.degrees(lat), ZONE_LON + math.degrees(math.atan2(math.sinh(b), math.cos(a)))


def hex_axial(x: str, y: str, side: float) -> tuple[str, str]:
    """Axial (q, r) of the pointy-top hexagon of a side that holds a metric position: cube rounding."""
    q, r = f"(({math.sqrt(3) / 3!r} * {x} - {y} / 3.0) / {side!r})", f"(2.0 / 3.0 * {y} / {side!r})"
    s = f"(-({q}) - ({r}))"
    near = lambda v: f"floor({v} + 0.5)"
    off = lambda v: f"abs({near(v)} - {v})"
    q_worst = f"({off(q)} > {off(r)} AND {off(q)} > {off(s)})"
    r_worst = f"(NOT {q_worst} AND {off(r)} > {off(s)})"
    return (
        f"CAST(CASE WHEN {q_worst} THEN -{near(r)} - {near(s)} ELSE {near(q)} END AS BIGINT)",
        f"CAST(CASE WHEN {r_worst} THEN -{near(q)} - {near(s)} ELSE {near(r)} END AS BIGINT)",
    )


def hex_disk(k: int) -> list[tuple[int, int]]:
    """Axial offsets within k steps."""
    return [(q, r) for q in range(-k, k + 1) for r in range(max(-k, -q - k), min(k, -q + k) + 1)]


def hex_centre(q: int, r: int, side: float) -> tuple[float, float]:
    return side * math.sqrt(3) * (q + r / 2), side * 1.5 * r


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a position is inside a closed ring of (x, y) structs: crossings of a ray to the right are odd."""
    sides = F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))
    )

    def crosses(s: Column) -> Column:
        at = (s["x2"] - s["x1"]) * (y - s["y1"]) / (s["y2"] - s["y1"]) + s["x1"]
        return ((s["y1"] > y) != (s["y2"] > y)) & (x < at)

    return F.size(F.filter(sides, crosses)) % 2 == 1


def to_segment_m(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a position to a segment."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x1) * dx + (y - y1) * dy) / F.when(n != 0, n))))
    return F.sqrt(F.pow(x - (x1 + t * dx), 2) + F.pow(y - (y1 + t * dy), 2))


def to_ring_m(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a position to a polygon: 0 inside."""
    near = F.array_min(F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: to_segment_m(x, y, a["x"], a["y"], b["x"], b["y"])))
    return F.when(in_ring(x, y, ring), F.lit(0.0)).otherwise(near)

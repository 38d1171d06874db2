"""Map layers from raw features: heights, runway ends, and zones around lines and points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waywarden import params
from waywarden.functions import geo
from waywarden.operators.places import to_metric
from waywarden.sources.readers import KMH, features, rings

# Half widths and radii in metres, criticality by kind, heights where none is told.
HALF_WIDTH = {"runway": 30.0, "taxiway": 12.0, "service_road": 4.0, "holding_point": 15.0, "stand": 30.0}
CRITICAL = {"runway": "high", "taxiway": "medium", "holding_point": "medium", "apron": "low", "stand": "low", "service_road": "low"}
LEVEL_M, TALL_M, LOW_M = 3.0, 15.0, 6.0


def building_height(properties: Column) -> Column:
    """Metres: height, building:height, levels times 3, or a default by what the building is."""
    number = lambda key: F.nullif(F.regexp_extract(properties[key], r"([\d.]+)", 1), F.lit("")).try_cast("double")
    tall = F.coalesce(properties["aeroway"].isin("hangar", "terminal"), F.lit(False))
    return F.coalesce(number("height"), number("building:height"), number("building:levels") * LEVEL_M, F.when(tall, TALL_M).otherwise(LOW_M))


def runway_ends(lines: list[tuple[str, list[tuple[float, float]]]], elevation_m: float = params.AIRPORT_ELEVATION_M) -> list[tuple]:
    """(runway, end, lat, lon, elevation, bearing) of named centrelines in metres; a handful, so on the driver.

    Thresholds are the two vertices farthest apart; the end whose number is
    nearest to the direction from one to the other is the first. A line
    without a name joins the nearest named one.
    """
    named: dict[str, list[tuple[float, float]]] = {}
    for name, pts in lines:
        if name:
            named.setdefault(name, []).extend(pts)
    for name, pts in lines:
        if not name and named:
            nearest = min(named, key=lambda n: min(math.dist(a, b) for a in named[n] for b in pts))
            named[nearest].extend(pts)
    out = []
    for name, pts in sorted(named.items()):
        a, b = max(((p, q) for i, p in enumerate(pts) for q in pts[i + 1 :]), key=lambda e: math.dist(*e))
        (lat1, lon1), (lat2, lon2) = geo.from_utm(*a), geo.from_utm(*b)
        bearing = bearing_of(lat1, lon1, lat2, lon2)
        ends = name.split("/")
        off = lambda e: abs((int(e[:2]) * 10 - bearing + 180) % 360 - 180)  # noqa: B023, E731
        first = min(ends, key=off)
        second = next((e for e in ends if e != first), first)
        out += [(name, first, lat1, lon1, elevation_m, bearing), (name, second, lat2, lon2, elevation_m, bearing_of(lat2, lon2, lat1, lon1))]
    return out


def bearing_of(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    mid, s = math.radians((lat1 + lat2) / 2), math.sin(math.radians((lat1 + lat2) / 2)) ** 2
    north = math.radians(lat2 - lat1) * geo.A * (1 - geo.E2) / (1 - geo.E2 * s) ** 1.5
    east = math.radians((lon2 - lon1 + 180) % 360 - 180) * geo.A * math.cos(mid) / math.sqrt(1 - geo.E2 * s)
    return math.degrees(math.atan2(east, north)) % 360


def round_buffer(x: float, y: float, radius: float, sides: int = 16) -> list[tuple[float, float]]:
    """A closed ring around a point."""
    pts = [(x + radius * math.cos(2 * math.pi * i / sides), y + radius * math.sin(2 * math.pi * i / sides)) for i in range(sides)]
    return [*pts, pts[0]]


def flat_buffer(a: tuple[float, float], b: tuple[float, float], half: float) -> list[tuple[float, float]]:
    """A closed rectangle along a segment, cut off flat at both ends."""
    n = math.dist(a, b) or 1.0
    dx, dy = half * (b[1] - a[1]) / n, half * (a[0] - b[0]) / n
    return [(a[0] + dx, a[1] + dy), (b[0] + dx, b[1] + dy), (b[0] - dx, b[1] - dy), (a[0] - dx, a[1] - dy), (a[0] + dx, a[1] + dy)]


def zones(spark: SparkSession, folder: str, kinds: tuple[str, ...] = tuple(CRITICAL)) -> DataFrame:
    """The zone layer from <folder>/<kind>.geojson: polygons as they are, lines as rectangles by segment, one zone_id a feature."""
    out = None
    for kind in kinds:
        f = features(spark, f"{folder}/{kind}.geojson")
        limit = F.expr("try_cast(properties['maxspeed'] AS double)") * KMH
        r = rings(f.filter("kind <> 'Point'")).select(F.concat_ws("_", F.lit(kind), F.col("n").cast("string")).alias("zone_id"), F.coalesce(F.col("properties")["ref"], F.col("properties")["name"], F.lit(kind)).alias("zone_name"), F.lit(kind).alias("zone_type"), F.lit(params.CRITICALITY[CRITICAL[kind]]).alias("criticality"), limit.alias("speed_limit_mps"), "kind", "ring")
        half = HALF_WIDTH.get(kind, 0.0)
        sides = F.zip_with(F.slice("ring", 1, F.size("ring") - 1), F.slice("ring", 2, F.size("ring") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        each = r.filter("kind = 'LineString'").withColumn("s", F.explode(sides))
        n = F.greatest(F.hypot(F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")), F.lit(1e-9))
        dx, dy = half * (F.col("s.b.y") - F.col("s.a.y")) / n, half * (F.col("s.a.x") - F.col("s.b.x")) / n
        corner = lambda p, sign: F.struct((F.col(f"s.{p}.x") + sign * dx).alias("x"), (F.col(f"s.{p}.y") + sign * dy).alias("y"))  # noqa: B023, E731
        lines = each.withColumn("ring", F.array(corner("a", 1), corner("b", 1), corner("b", -1), corner("a", -1), corner("a", 1))).drop("s")
        both = r.filter("kind <> 'LineString'").unionByName(lines).drop("kind")
        out = both if out is None else out.unionByName(both)
    return out


def airport_boundary(box: tuple[float, float, float, float] = params.AIRPORT_BOX) -> Column:
    """Whether x and y are inside the box's metric rectangle."""
    (x0, y0), (x1, y1) = to_metric(box[0], box[1]), to_metric(box[2], box[3])
    return F.col("x").between(x0, x1) & F.col("y").between(y0, y1)


def category(value: Column, bounds: tuple[tuple[float, int], ...], worst: int = 3) -> Column:
    """The category of the first bound above a value."""
    out = F.lit(float(worst))
    for bound, code in reversed(bounds):
        out = F.when(value < bound, float(code)).otherwise(out)
    return F.when(value.isNotNull(), out)

"""Batch readers: trace files, flat tables, geofences, layers, graphs, dimension tables and archives."""

from __future__ import annotations

import io
import json
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waywarden import params
from waywarden.functions import geo
from waywarden.operators.places import to_metric

KT, FT, FPM, KMH = 0.514444, 0.3048, 0.00508, 1 / 3.6

FLAT_SCHEMA = "icao24 string, ts double, lat double, lon double, on_ground boolean, alt_m double, speed_mps double, track_deg double, vrate_mps double, nic double, nac_p double, sil double, callsign string, type string"


def points(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Parquet points of one or more files; columns and predicate reach the scan."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where else df
    return df.select(columns) if columns else df


def traces(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Trace JSON files (plain or gzipped, any depth) to flat rows, with file and place as arrival order.

    A file has icao, t, timestamp and trace, an array of arrays: seconds after
    timestamp, lat, lon, altitude in feet or "ground", ground speed in knots,
    course, flags, rate in feet a minute, and details (nic, nac_p, sil, flight).
    """
    raw = spark.read.option("recursiveFileLookup", True).option("wholetext", True).text(path).withColumn("file", F.input_file_name())
    head = F.from_json("value", "icao string, t string, timestamp double, trace array<array<string>>")
    t = raw.select("file", head.alias("h")).select("file", "h.*")
    t = t.select("file", F.col("icao").alias("icao24"), F.col("t").alias("type"), "timestamp", F.posexplode("trace").alias("place", "p"))
    at = lambda i: F.get("p", F.lit(i))
    num = lambda i: F.expr(f"try_cast(get(p, {i}) AS double)")
    more = F.from_json(at(8), "nic double, nac_p double, sil double, flight string, alt_geom double, type string")
    out = t.withColumn("d", more).select(
        "file", "place", "icao24", (F.col("timestamp") + num(0)).alias("ts"), num(1).alias("lat"), num(2).alias("lon"), (at(3) == "ground").alias("on_ground"), (num(3) * FT).alias("alt_m"),
        (num(4) * KT).alias("speed_mps"), num(5).alias("track_deg"), (num(7) * FPM).alias("vrate_mps"), "d.nic", "d.nac_p", "d.sil", F.trim("d.flight").alias("callsign"), "type",
        (F.col("d.alt_geom") * FT).alias("alt_geom_m"), F.col("d.type").alias("pos_source"),
    )
    if box:
        out = out.filter(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))
    return out


def asset_tracks(raw: DataFrame, class_map: DataFrame, source: str = "tracker") -> DataFrame:
    """Vehicle and aircraft samples of an airport's tracker to points, and their side columns, in order of time per asset.

    class_map: adr_class, domain, asset_class, adr_group; unknown classes stop
    the read, as a limit could not be chosen for them.
    """
    known = class_map.select(F.col("adr_class").alias("asset_kind"), "domain", F.col("asset_class").alias("mapped"))
    twice = known.groupBy("asset_kind").count().filter("count > 1").limit(3).collect()
    lacking = raw.select(F.col("asset_class").alias("asset_kind")).distinct().join(known, "asset_kind", "left_anti").limit(3).collect()
    if twice or lacking:
        raise ValueError(f"class map: twice {twice}, without an entry {lacking}")
    p = raw.withColumnRenamed("asset_class", "asset_kind").join(known, "asset_kind", "left")
    order = F.expr("row_number() OVER (PARTITION BY asset_id ORDER BY timestamp_unix) - 1")
    return p.select(
        F.concat_ws(":", F.lit(source), "asset_id", F.lit("0")).alias("track_id"), "asset_id", F.lit(source).alias("source"), "domain", order.cast("long").alias("seq"), F.col("timestamp_unix").alias("t"),
        F.expr("CAST(round(timestamp_unix * 1000000) AS BIGINT)").alias("t_us"), "lat", "lon", F.coalesce("mapped", F.lit("other")).alias("asset_class"), (F.col("domain") == "vehicle").alias("on_ground"),
        F.lit(None).cast("double").alias("alt_baro_m"), F.when(F.col("alt_m") <= params.ALT_MAX_M, F.col("alt_m")).alias("alt_geom_m"), (F.col("speed_kmh") * KMH).alias("gs_mps"), F.expr(geo.wrap360("heading_deg")).alias("track_deg"),
        F.expr(geo.wrap360("heading_deg")).alias("heading_deg"), F.lit(None).cast("double").alias("vrate_mps"), *[F.lit(None).cast("double").alias(c) for c in ("nacp", "nic", "sil")], F.lit(None).cast("string").alias("callsign"),
        F.col("asset_kind").alias("typecode_raw"), "asset_kind", "inside_aerodrome", "runway_critical_ref",
    )


GEOFENCES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON features (plain or gzipped): properties as a map, kind, and coordinates as JSON text."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", GEOFENCES).alias("c"))
    f = raw.select(F.posexplode("c.features").alias("n", "f"))
    return f.select("n", F.col("f.properties").alias("properties"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def rings(df: DataFrame) -> DataFrame:
    """features to one row for each polygon's outer ring, in metres; lines stay lines."""
    deep = {"Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>", "LineString": "array<array<double>>"}
    outer = (
        F.when(F.col("kind") == "Polygon", F.array(F.get(F.from_json("coordinates", deep["Polygon"]), F.lit(0))))
        .when(F.col("kind") == "MultiPolygon", F.transform(F.from_json("coordinates", deep["MultiPolygon"]), lambda p: F.get(p, F.lit(0))))
        .when(F.col("kind") == "LineString", F.array(F.from_json("coordinates", deep["LineString"])))
    )
    one = df.withColumn("_ring", F.explode(outer)).withColumn("_piece", F.monotonically_increasing_id())
    p = one.select("*", F.posexplode("_ring").alias("_i", "_p")).withColumns({"_lon": F.col("_p")[0], "_lat": F.col("_p")[1]})
    p = geo.with_utm(p, "_lat", "_lon", "_x", "_y")
    keep = [c for c in df.columns if c != "coordinates"]
    by = p.groupBy("_piece").agg(*[F.first(c).alias(c) for c in keep], F.sort_array(F.collect_list(F.struct("_i", F.col("_x").alias("x"), F.col("_y").alias("y")))).alias("r"))
    return by.select(*keep, F.transform("r", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("ring"))


def ring_area(ring):
    """Twice the signed area by the shoelace formula, halved and without sign."""
    s = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(s, F.lit(0.0), lambda acc, v: acc + v)) / 2


# Classes of geofences with their criticality.
FENCE_CLASSES = ("runway_critical", "runway_strip", "taxi_corridor", "holding_position", "apron", "aircraft_stand", "service_road_corridor", "building", "aerodrome_boundary")
BOUNDARY_CLASS = "aerodrome_boundary"
ALL_GROUPS = "all"


def valid_ring(ring: Column) -> Column:
    """A ring that geometry can rely on: closed, without a point that repeats the one before it; null where fewer than three corners are left."""
    same = lambda a, b: (a["x"] == b["x"]) & (a["y"] == b["y"])
    kept = F.filter(ring, lambda p, i: (i == 0) | ~F.coalesce(same(p, F.get(ring, i - 1)), F.lit(False)))
    first, last = F.get(kept, F.lit(0)), F.try_element_at(kept, F.lit(-1))
    closed = F.when(same(first, last), kept).otherwise(F.array_append(kept, first))
    return F.when(F.size(closed) >= 4, closed)


def fence_groups(allowed: Column, known: list[str]) -> Column:
    """The sorted groups of a list in text; `all` stands for every known group."""
    named = F.array_sort(F.filter(F.split(F.coalesce(allowed, F.lit("")), r"\s*,\s*"), lambda g: g != ""))
    return F.when(F.array_contains(named, ALL_GROUPS), F.array_sort(F.array(*map(F.lit, known)).cast("array<string>"))).otherwise(named)


def geofences(spark: SparkSession, path: str, groups: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(zones, boundary) of a geofence file: zone_id, zone_class, allowed_groups, speed_limit_mps, area, ring; and the boundary's rings.

    Rings are closed and freed of repeated points, degenerate ones left out. A
    class that is not known is an error. groups are all that `all` stands for.
    """
    f = features(spark, path)
    unknown = [r[0] for r in f.select(F.col("properties")["zone_class"].alias("c")).distinct().collect() if r[0] not in FENCE_CLASSES]
    if unknown:
        raise ValueError(f"unknown zone classes: {sorted(map(str, unknown))}")
    get = lambda k: F.col("properties")[k]
    limit = F.expr("try_cast(properties['speed_limit_kmh'] AS double)") * KMH
    r = rings(f).withColumn("ring", valid_ring(F.col("ring"))).filter("ring IS NOT NULL").withColumn("zone_class", get("zone_class"))
    zones = r.filter(F.col("zone_class") != BOUNDARY_CLASS).select(
        F.coalesce(get("zone_id"), get("id"), F.col("n").cast("string")).alias("zone_id"), "zone_class", fence_groups(get("allowed_groups"), groups or []).alias("allowed_groups"),
        limit.alias("speed_limit_mps"), ring_area(F.col("ring")).alias("area"), "ring",
    )
    return zones, r.filter(F.col("zone_class") == BOUNDARY_CLASS).select("ring")


def graph(text: str) -> tuple[list[tuple], list[tuple]]:
    """GraphML to nodes (id, lat, lon) and edges (edge_id, source, target, domain); the file is small and read on the driver."""
    ns = {"g": "http://graphml.graphdrawing.org/xmlns"}
    root = ET.fromstring(text)
    names = {k.get("id"): k.get("attr.name") for k in root.findall("g:key", ns)}
    data = lambda e: {names.get(d.get("key")): d.text for d in e.findall("g:data", ns)}
    nodes, edges = [], []
    for n in root.iter(f"{{{ns['g']}}}node"):
        d = data(n)
        nodes.append((n.get("id"), float(d.get("lat") or d.get("y")), float(d.get("lon") or d.get("x"))))
    for i, e in enumerate(root.iter(f"{{{ns['g']}}}edge")):
        edges.append((f"e{i}", e.get("source"), e.get("target"), data(e).get("domain", "vehicle")))
    return nodes, edges


def routes(spark: SparkSession, text: str) -> DataFrame:
    """Edges of a GraphML route graph as segments in metres: edge_id, domain, x1, y1, x2, y2."""
    nodes, edges = graph(text)
    at = {n: to_metric(lat, lon) for n, lat, lon in nodes}
    return spark.createDataFrame([(e, dom, *at[a], *at[b]) for e, a, b, dom in edges], "edge_id string, domain string, x1 double, y1 double, x2 double, y2 double")


def shortest_path(nodes: list[tuple], edges: list[tuple], start: str, goal: str, domain: str | None = None) -> list[str]:
    """Node ids of the shortest way on a route graph, by length; [] where there is none."""
    import heapq
    import math

    at = {n: to_metric(lat, lon) for n, lat, lon in nodes}
    near: dict[str, list[tuple[float, str]]] = {}
    for _, a, b, dom in edges:
        if domain in (None, dom):
            d = math.dist(at[a], at[b])
            near.setdefault(a, []).append((d, b))
            near.setdefault(b, []).append((d, a))
    heap, seen = [(0.0, start, None)], {}
    while heap:
        d, n, before = heapq.heappop(heap)
        if n in seen:
            continue
        seen[n] = before
        if n == goal:
            way = [n]
            while seen[way[-1]] is not None:
                way.append(seen[way[-1]])
            return way[::-1]
        for step, m in near.get(n, ()):
            if m not in seen:
                heapq.heappush(heap, (d + step, m, n))
    return []


def dimension(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV dimension table with a declared schema."""
    return spark.read.option("header", True).schema(schema).csv(path)


ACCESS_SCHEMA = "zone_type string, asset_class string, allowed boolean, max_dwell_s double"
TYPES_SCHEMA = "typecode string, aircraft_seen long, size_class string"
OVERRIDES_SCHEMA = "icao24 string, typecode string, reason string"
CLASS_MAP_SCHEMA = "adr_class string, seen_in string, domain string, asset_class string, match string, adr_group string, reason string"


def members(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """(archive, name, content) of the files in tar archives whose name holds pattern; archives are read where the data is."""

    def run(batches) -> Iterator:
        import pandas as pd

        for b in batches:
            for path_, content in zip(b["path"], b["content"], strict=True):
                rows = []
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and pattern in m.name:
                            rows.append((path_, m.name, tar.extractfile(m).read()))
                yield pd.DataFrame(rows, columns=["archive", "name", "content"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(run, "archive string, name string, content binary")


def runway_rectangles(spark: SparkSession, path: str, airport: str) -> DataFrame:
    """Runway ends of an airports CSV to centrelines: runway, le_end, he_end, x1, y1, x2, y2, width_m."""
    r = spark.read.option("header", True).csv(path).filter(F.col("airport_ident") == airport)
    num = lambda c: F.expr(f"try_cast({c} AS double)")
    r = r.select(F.concat_ws("/", "le_ident", "he_ident").alias("runway"), "le_ident", "he_ident", num("le_latitude_deg").alias("a"), num("le_longitude_deg").alias("b"), num("he_latitude_deg").alias("c"), num("he_longitude_deg").alias("d"), (num("width_ft") * FT).alias("width_m")).dropna(subset=["a", "b", "c", "d"])
    return geo.with_utm(geo.with_utm(r, "a", "b", "x1", "y1"), "c", "d", "x2", "y2").drop("a", "b", "c", "d")


def runways_or(rows: list[tuple[str, object]], fallback: list[tuple[str, object]]) -> list[tuple[str, object]]:
    """(name, geometry) of runways: rows, and of the fallback those none of whose designators rows have; names like 16R/34L, in either order."""
    ends = lambda name: frozenset(e.strip().upper().lstrip("0") for e in name.split("/") if e.strip())
    have = set().union(*(ends(n) for n, _ in rows))
    return [*rows, *[(n, g) for n, g in fallback if n and not ends(n) & have]]


def artifact(spark: SparkSession, path: str) -> dict:
    """A JSON artifact (calibration, splits, manifest)."""
    return json.loads(spark.read.option("wholetext", True).text(path).head()[0])

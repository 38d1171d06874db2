"""Flat position reports to tracks: casts, repairs, gaps and arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywarden import params
from waywarden.functions.geo import wrap360
from waywarden.params import Timing

#: Flat trace columns and what they are called here.
FLAT = {
    "icao24": "asset_id",
    "ts": "t",
    "lat": "lat",
    "lon": "lon",
    "on_ground": "on_ground",
    "alt_m": "alt_baro_m",
    "speed_mps": "gs_mps",
    "track_deg": "track_deg",
    "vrate_mps": "vrate_mps",
    "nic": "nic",
    "nac_p": "nacp",
    "sil": "sil",
    "callsign": "callsign",
    "type": "typecode_raw",
}
NUMBERS = ("t", "lat", "lon", "alt_baro_m", "gs_mps", "track_deg", "vrate_mps", "nacp", "nic", "sil")


def rename_flat(raw: DataFrame, order: str | None = None) -> DataFrame:
    """The flat columns under their names here; numbers that do not parse become NULL, and so does NaN."""
    cols = [F.col(a).alias(b) for a, b in FLAT.items()] + ([F.col(order).alias("arrival")] if order else [])
    out = raw.select(*cols)
    return out.withColumns({c: F.nanvl(F.expr(f"try_cast({c} AS double)"), F.lit(None).cast("double")) for c in NUMBERS})


def drop_counts(df: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One row: how many reports lack a time or place, are outside the box, or have an impossible altitude."""
    missing = F.col("t").isNull() | F.col("lat").isNull() | F.col("lon").isNull()
    inside = _inside(box) if box else F.lit(True)
    return df.agg(
        F.count_if(missing).alias("missing_t_lat_lon"),
        F.count_if(~missing & ~inside).alias("outside_area"),
        F.count_if(~missing & inside & (F.col("alt_baro_m") > params.ALT_MAX_M)).alias("alt_baro_nulled_above_max"),
    )


def _inside(box) -> Column:
    lat0, lon0, lat1, lon1 = box
    return F.col("lat").between(lat0, lat1) & F.col("lon").between(lon0, lon1)


def repair(df: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Drops reports without time or place or outside the box (closed), and mends columns; rows are kept otherwise."""
    out = df.filter("t IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    if box:
        out = out.filter(_inside(box))
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    fixes = {
        "asset_id": F.lower(F.trim("asset_id")),
        # "not on the ground" without an altitude tells nothing
        "on_ground": F.when(~F.coalesce("on_ground", F.lit(False)) & F.col("alt_baro_m").isNull(), F.lit(None).cast("boolean")).otherwise(F.col("on_ground")),
        "track_deg": F.expr(wrap360("track_deg")),
    }
    fixes |= {c: blank(c) for c in ("callsign", "typecode_raw") if c in df.columns}
    out = out.withColumns(fixes)
    return out.withColumn("alt_baro_m", F.when(F.col("alt_baro_m") <= params.ALT_MAX_M, F.col("alt_baro_m"))).withColumn("track_deg", F.when(F.col("track_deg") >= 360.0, 0.0).otherwise(F.col("track_deg")))


def segment(df: DataFrame, timing: Timing = Timing(), asset: str = "asset_id", order: str = "arrival", t_us: str = "t_us") -> DataFrame:
    """df with `segment` (from 0): a silence above gap_s since the latest time so far starts another. Order is arrival."""
    w = Window.partitionBy(asset).orderBy(order)
    latest = F.max(t_us).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.coalesce((F.col(t_us) - latest > timing.us("gap")).cast("long"), F.lit(0).cast("long"))
    return df.withColumn("_gap", gap).withColumn("segment", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def number(df: DataFrame, track: str = "track_id", order: str = "arrival") -> DataFrame:
    """df with `seq`, 0 for a track's first arrival."""
    return df.withColumn("seq", (F.row_number().over(Window.partitionBy(track).orderBy(order)) - 1).cast("long"))


def fill_forward(df: DataFrame, columns: list[str], track: str = "track_id", order: str = "seq") -> DataFrame:
    """Values carried on inside a track, never back and never across tracks."""
    w = Window.partitionBy(track).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def classify(df: DataFrame, types: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """df with typecode, type_overridden and asset_class: an override by asset first, then the type table, else other.

    types (typecode, size_class) and overrides (icao24, typecode) are dimension
    tables; Spark broadcasts them only below its size threshold.
    """
    out = df
    if overrides is not None:
        o = overrides.select(F.lower(F.trim("icao24")).alias("_asset"), F.trim("typecode").alias("_override"))
        out = out.join(o, F.lower("asset_id") == F.col("_asset"), "left").drop("_asset")
    else:
        out = out.withColumn("_override", F.lit(None).cast("string"))
    out = out.withColumns({"type_overridden": F.col("_override").isNotNull(), "typecode": F.coalesce("_override", "typecode_raw")}).drop("_override")
    if types is None:
        return out.withColumn("asset_class", F.lit("other"))
    t = types.select(F.upper(F.trim("typecode")).alias("_type"), F.col("size_class").alias("_class"))
    return out.join(t, F.upper(F.trim("typecode")) == F.col("_type"), "left").withColumn("asset_class", F.coalesce("_class", F.lit("other"))).drop("_type", "_class")


def from_flat(raw: DataFrame, source: str, order: str, box=None, types=None, overrides=None, timing: Timing = Timing()) -> DataFrame:
    """Flat trace rows to points. `order` is the column of arrival order; nothing is sorted by time or deduplicated."""
    p = repair(rename_flat(raw, order), box).withColumn("t_us", F.expr("CAST(round(t * 1000000) AS BIGINT)"))
    p = segment(p, timing).withColumn("track_id", F.concat_ws(":", F.lit(source), "asset_id", F.col("segment").cast("string"))).drop("segment")
    p = fill_forward(number(p), ["nacp", "nic", "sil"]).drop("arrival")
    p = p.withColumns({"source": F.lit(source), "domain": F.lit("aircraft"), "alt_geom_m": F.lit(None).cast("double"), "heading_deg": F.lit(None).cast("double")})
    return classify(p, types, overrides)


class SchemaError(ValueError):
    """Points that break the schema."""


REQUIRED = ("track_id", "asset_id", "source", "domain", "seq", "t", "lat", "lon", "asset_class")


def violations(points: DataFrame) -> DataFrame:
    """One row of counts: nulls in required columns, repeated seq, altitudes in feet, times not in seconds."""
    w = Window.partitionBy("track_id", "seq")
    high = [F.col(c) > params.ALT_MAX_M for c in ("alt_baro_m", "alt_geom_m") if c in points.columns]
    return points.withColumn("_n", F.count("*").over(w)).agg(
        F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in REQUIRED]) == 1).alias("missing"),
        F.count_if(F.col("_n") > 1).alias("repeated_seq"),
        (F.count_if(F.coalesce(*[F.nullif(h, F.lit(False)) for h in high], F.lit(False))) if high else F.lit(0)).alias("altitude"),
        F.count_if(~F.col("t").between(1e9, 2e9)).alias("time"),
    )


def validate(points: DataFrame) -> DataFrame:
    """points, or SchemaError; one aggregation."""
    lacking = [c for c in REQUIRED if c not in points.columns]
    if lacking:
        raise SchemaError(f"missing columns: {lacking}")
    bad = {k: v for k, v in violations(points).head().asDict().items() if v}
    if bad:
        raise SchemaError(f"rows that break the schema: {bad}")
    return points


def stretches(df: DataFrame, by: list[str], key: list[str], order: tuple[str, ...] = ("t_us", "seq")) -> DataFrame:
    """(by, key, t_start, t_end, n): the longest runs of rows, in order within `by`, that agree in all of key. Nulls agree with each other."""
    w = Window.partitionBy(*by).orderBy(*order)
    now = F.struct(*key)
    new = (~now.eqNullSafe(F.lag(now).over(w))).cast("long")
    island = df.withColumn("_island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, *key, "_island").agg(F.min("t_us").alias("t_start"), F.max("t_us").alias("t_end"), F.count("*").alias("n")).drop("_island")


ORDER = "_order"


def with_order(df: DataFrame) -> DataFrame:
    """df with the place of each row as it was read: it grows within a partition and from one to the next."""
    return df.withColumn(ORDER, F.monotonically_increasing_id())


def restored(df: DataFrame) -> DataFrame:
    """Rows of with_order() in the order they were read, without its column; a range partitioning, so no task sorts all."""
    return df.orderBy(ORDER).drop(ORDER)

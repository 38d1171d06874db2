"""Live points: messages checked one by one, with reasons for those that are rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waywarden import params
from waywarden.functions import geo

MESSAGE = (
    "asset_id string, t double, lat double, lon double, domain string, asset_class string, typecode string, on_ground boolean, alt_baro_m double, alt_geom_m double, gs_mps double, track_deg double, heading_deg double, "
    "vrate_mps double, nacp double, nic double, sil double, callsign string"
)
FIELDS = [f.split()[0] for f in MESSAGE.split(", ")]
AHEAD_S = 300.0


def parse(messages: DataFrame, body: str = "value") -> DataFrame:
    """JSON messages, each an array of points, to one row a point; unknown is the fields a point has beyond the known."""
    raw = F.from_json(body, "array<string>")
    m = messages.select("*", F.posexplode(raw).alias("place", "_text"))
    known = F.array(*map(F.lit, FIELDS))
    return m.withColumn("p", F.from_json("_text", MESSAGE)).withColumn("unknown", F.array_except(F.json_object_keys("_text"), known)).select(*messages.columns, "place", "p.*", "unknown").drop(body)


def reason(reference_t: Column | None = None) -> Column:
    """Why a point is rejected; null where it is good. A bad point never rejects its batch."""
    c = F.col
    classes = [e[0] for e in params.ENVELOPES]
    domains = dict((e[0], e[1]) for e in params.ENVELOPES)
    wrong_domain = F.lit(False)
    for name, domain in domains.items():
        wrong_domain = wrong_domain | ((c("asset_class") == name) & (c("domain") != domain))
    out = (
        F.when(F.size("unknown") > 0, F.concat(F.lit("unknown fields: "), F.array_join("unknown", ", ")))
        .when(c("asset_id").isNull() | (F.trim("asset_id") == ""), "no asset_id")
        .when(c("t").isNull() | F.isnan("t") | ~c("t").between(1e9, 2e9), "t is not in UNIX seconds")
        .when(c("lat").isNull() | ~c("lat").between(-90, 90) | c("lon").isNull() | ~c("lon").between(-180, 180), "no position")
        .when(~c("domain").isin("aircraft", "vehicle") | c("domain").isNull(), "unknown domain")
        .when(c("asset_class").isNotNull() & ~c("asset_class").isin(*classes), "unknown asset_class")
        .when(wrong_domain, "asset_class of the other domain")
        .when(F.greatest(F.coalesce("alt_baro_m", F.lit(0.0)), F.coalesce("alt_geom_m", F.lit(0.0))) > params.ALT_MAX_M, "altitude above 20000 m")
        .when(c("gs_mps") < 0, "negative speed")
    )
    if reference_t is not None:
        out = out.when(c("t") - reference_t > AHEAD_S, "too far ahead of its batch")
    return out


def accept(parsed: DataFrame, types: DataFrame | None = None, reference_t: Column | None = None) -> DataFrame:
    """parsed with rejected (a reason or null), asset_class filled in, and angles wrapped."""
    p = parsed.withColumn("rejected", reason(reference_t))
    known = F.lit(None).cast("string")
    if types is not None:
        p = p.join(types.select(F.upper(F.trim("typecode")).alias("_type"), F.col("size_class").alias("_size")), F.upper(F.trim("typecode")) == F.col("_type"), "left").drop("_type")
        known = F.col("_size")
    fallback = F.when(F.col("domain") == "aircraft", "other").otherwise("follow_me")
    p = p.withColumn("asset_class", F.coalesce("asset_class", F.when(F.col("domain") == "aircraft", known), fallback))
    wrapped = {c: F.expr(f"CASE WHEN {geo.wrap360(c)} >= 360 THEN 0 ELSE {geo.wrap360(c)} END") for c in ("track_deg", "heading_deg")}
    out = p.withColumns(wrapped).withColumn("t_us", F.expr("CAST(round(t * 1000000) AS BIGINT)"))
    return out.drop("_size", "unknown")


def sink_frame(accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good points, rejects with their reason)."""
    return accepted.filter("rejected IS NULL").drop("rejected"), accepted.filter("rejected IS NOT NULL")

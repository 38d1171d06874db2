"""Where results go: tables, CSV, replay frames, GeoJSON, models, profiles, serving queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waywarden.operators.models import Linear


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def csv(df: DataFrame, path: str, digits: int = 6) -> None:
    """CSV with numbers to so many significant digits."""
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}g", c)).alias(c)
    out = df.select([number(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    out.write.mode("overwrite").option("header", True).csv(path)


def frames(verdicts: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """One JSON line for each time: its verdicts by track, and risk zones; fields without a value are left out.

    verdicts: contract()'s rows. zones: (t, feature).
    """
    options = {"ignoreNullFields": "true"}
    v = verdicts.select("t", F.struct("track_id", F.to_json("verdict", options).alias("json")).alias("v")).groupBy("t").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    parts = [F.lit('{"t":'), F.col("t").cast("string"), F.lit(',"verdicts":['), F.array_join(F.transform("vs", lambda x: x["json"]), ","), F.lit("]")]
    if zones is not None:
        z = zones.groupBy("t").agg(F.sort_array(F.collect_list(F.to_json("feature", options))).alias("zs"))
        v = v.join(z, "t", "left")
        parts += [F.lit(',"risk_zones":{"type":"FeatureCollection","features":['), F.array_join(F.coalesce("zs", F.array().cast("array<string>")), ","), F.lit("]}")]
    return v.select("t", F.concat(*parts, F.lit("}")).alias("value"))


def replay(frames_: DataFrame, events: DataFrame | None, folder: str, source: str) -> dict:
    """Writes frames as JSON lines in order of time, and a manifest; the manifest."""
    frames_.orderBy("t").select("value").write.mode("overwrite").text(f"{folder}/frames")
    span = frames_.agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n")).head()
    told = [json.loads(r[0]) for r in events.orderBy("t_onset").select(F.to_json(F.struct(*[F.col(c) for c in events.columns]))).collect()] if events is not None else []
    manifest = {"source": source, "t_start": span["a"], "t_end": span["b"], "n_frames": span["n"], "events": told}
    spark = frames_.sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest


def geojson(features: DataFrame, path: str) -> None:
    """features (feature struct) as one FeatureCollection; for small layers."""
    one = features.agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("feature").alias("features"))).alias("value"))
    one.write.mode("overwrite").text(path)


def save_model(spark, model: Linear, path: str) -> None:
    from dataclasses import asdict

    spark.createDataFrame([(json.dumps(asdict(model)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark, path: str) -> Linear:
    d = json.loads(spark.read.text(path).head()[0])
    d["steps"] = [tuple(s) for s in d["steps"]]
    return Linear(**d)


def profile(df: DataFrame, track: str = "track_id", t: str = "t") -> DataFrame:
    """One row: rows, tracks, span and the share of nulls in each column; one pass."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(track).alias("tracks"), F.min(t).alias("t_start"), F.max(t).alias("t_end"), *[F.avg(F.col(c).isNull().cast("double")).alias(f"null_{c}") for c in df.columns])


def latest(verdicts: DataFrame) -> DataFrame:
    """The last verdict of each track."""
    return verdicts.groupBy("track_id").agg(F.max_by(F.struct(*[F.col(c) for c in verdicts.columns if c != "track_id"]), "t_end").alias("v")).select("track_id", "v.*")


def history(verdicts: DataFrame, track_id: str, seconds: float = 300.0) -> DataFrame:
    """A track's verdicts of its last seconds, oldest first; the track's predicate reaches the scan."""
    v = verdicts.filter(F.col("track_id") == track_id)
    return v.join(F.broadcast(v.agg(F.max("t_end").alias("_now"))), F.col("t_end") >= F.col("_now") - seconds - 1e-6).drop("_now").orderBy("t_end")

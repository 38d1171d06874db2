"""Points made from the events table: users are assets, events are fixes, in the same arithmetic in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waywarden.params import Timing

#: Events are hours apart, so every span is scaled up.
TIMING = Timing(window_s=21_600, stride_s=3_600, rate_s=21_600, baseline_s=86_400, history_s=21_600, gap_s=86_400, frozen_cap_s=86_400, presence_s=14_400)

CLASS = "CASE event_type WHEN 'view' THEN 'narrowbody' WHEN 'signup' THEN 'helicopter' WHEN 'click' THEN 'light' WHEN 'purchase' THEN 'bus' ELSE 'follow_me' END"
COLUMNS = {
    "asset_id": "concat('u', {user})",
    "source": "'events'",
    "domain": "CASE WHEN event_type IN ('purchase', 'error') THEN 'vehicle' ELSE 'aircraft' END",
    "seq": "event_id",
    "lat": "CAST(41.77 AS DOUBLE) + CAST(event_id * 37 % 900 AS DOUBLE) / CAST(10000 AS DOUBLE)",
    "lon": "CAST(12.2 AS DOUBLE) + CAST(event_id * 91 % 1000 AS DOUBLE) / CAST(10000 AS DOUBLE)",
    "asset_class": CLASS,
    "alt_baro_m": "event_id * 13 % 3000 + 0.5",
    "alt_geom_m": "CASE WHEN event_id % 11 > 0 THEN event_id * 13 % 3000 + event_id * 17 % 50 + 0.5 END",
    "gs_mps": "value",
    "track_deg": "CASE WHEN event_id % 7 > 0 THEN event_id * 53 % 360 + 0.25 END",
    "heading_deg": "event_id * 59 % 360 + 0.75",
    "vrate_mps": "event_id * 7 % 41 - 20.5",
    "on_ground": "CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "nacp": "CASE WHEN event_id % 13 > 0 THEN CAST({k} % 12 AS DOUBLE) END",
    "nic": "CAST({k} % 9 AS DOUBLE)",
    "sil": "CAST({k} % 4 AS DOUBLE)",
    "callsign": "CASE event_id % 5 WHEN 0 THEN concat('AZA', {event}) WHEN 1 THEN concat('I', {event}) END",
    "typecode_raw": "CASE event_id % 4 WHEN 0 THEN 'B738' WHEN 1 THEN 'C172' WHEN 2 THEN 'EC35' END",
}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    words = {"user": "CAST(user_id AS STRING)", "event": "CAST(event_id AS STRING)", "k": "CAST(get_json_object(props, '$.k') AS BIGINT)"}
    # a zone-less time counts as UTC
    t_us = "(unix_micros(to_timestamp_ltz(to_utc_timestamp(CAST(ts AS TIMESTAMP), 'UTC'))))"
    numbers = ("lat", "lon", "alt_baro_m", "alt_geom_m", "track_deg", "heading_deg", "vrate_mps")
    made = [f"CAST({x.format(**words)} AS DOUBLE) AS {c}" if c in numbers else f"{x.format(**words)} AS {c}" for c, x in COLUMNS.items()]
    return e.selectExpr("CAST(user_id AS STRING) AS track_id", f"{t_us} AS t_us", f"{t_us} / 1e6 AS t", *made, "event_type", "props")


def _sql() -> str:
    words = {"user": "CAST(user_id AS VARCHAR)", "event": "CAST(event_id AS VARCHAR)", "k": "CAST(json_extract(props, '$.k') AS BIGINT)"}
    numbers = ("lat", "lon", "alt_baro_m", "alt_geom_m", "track_deg", "heading_deg", "vrate_mps")
    made = [f"CAST({x.format(**words)} AS DOUBLE) AS {c}" if c in numbers else f"{x.format(**words)} AS {c}" for c, x in COLUMNS.items()]
    return f"pts AS (SELECT CAST(user_id AS VARCHAR) AS track_id, epoch_us(ts) AS t_us, epoch_us(ts) / 1e6 AS t, {', '.join(made)}, event_type, props FROM events)"


#: DuckDB: the same points as the CTE `pts`.
PTS = _sql()

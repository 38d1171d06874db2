"""Queries that look at data before anything is fitted to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from waywarden.operators import fixes
from waywarden.plans.adaptor import PTS, TIMING, points
from waywarden.plans.motion import ENV, PAIR, RUN
from waywarden.sources import sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


@query("check_envelopes", f"""WITH {PTS}, {RUN}, {PAIR}, {ENV}, r AS (SELECT p.asset_class, gs_mps AS speed, abs(gs - jgs) / pair_dt AS accel, abs(vrate_mps) AS vrate, amax * 1.5 AS speed_limit, acc * 1.5 AS accel_limit, vmax * 1.5 AS vrate_limit FROM pp p JOIN env USING (asset_class) WHERE domain = 'aircraft' AND NOT coalesce(on_ground, false))
SELECT asset_class, round(quantile_cont(speed, 0.999), 6) AS speed_p999, round(quantile_cont(accel, 0.999), 9) AS accel_p999, round(avg(CAST(speed > speed_limit AS DOUBLE)), 6) AS speed_over, round(avg(CAST(vrate > vrate_limit AS DOUBLE)), 6) AS vrate_over FROM r GROUP BY ALL""")
def check_envelopes(spark, d):
    f = fixes.fix_level(points(spark, d), TIMING).filter("domain = 'aircraft' AND NOT coalesce(on_ground, false)")
    accel = F.abs(F.col("gs") - F.col("j.gs")) / F.col("pair_dt")
    over = lambda v, limit: F.round(F.avg((v > limit * 1.5).cast("double")), 6)
    return f.groupBy("asset_class").agg(
        F.round(F.percentile("gs_mps", 0.999), 6).alias("speed_p999"), F.round(F.percentile(accel, 0.999), 9).alias("accel_p999"), over(F.col("gs_mps"), F.col("air_max")).alias("speed_over"), over(F.abs("vrate_mps"), F.col("vrate_max")).alias("vrate_over")
    )


@query("check_tracks", f"WITH {PTS}, s AS (SELECT *, (t_us - lag(t_us) OVER (PARTITION BY track_id ORDER BY t_us, seq)) / 1e6 AS dt FROM pts) SELECT count(*) AS n_points, count(DISTINCT track_id) AS tracks, round(median(dt), 6) AS dt_median, round(quantile_cont(dt, 0.9), 6) AS dt_p90, round(avg(CAST(nacp IS NOT NULL AS DOUBLE)), 6) AS nacp_share FROM s")
def check_tracks(spark, d):
    p = fixes.steps(fixes.reported_speed(points(spark, d)), TIMING)
    return p.agg(F.count("*").alias("n_points"), F.count_distinct("track_id").alias("tracks"), F.round(F.percentile("dt_prev", 0.5), 6).alias("dt_median"), F.round(F.percentile("dt_prev", 0.9), 6).alias("dt_p90"), F.round(F.avg(F.col("nacp").isNotNull().cast("double")), 6).alias("nacp_share"))


@query("type_counts", f"WITH {PTS}, f AS (SELECT asset_id, arg_min(typecode_raw, seq) AS typecode FROM pts WHERE typecode_raw IS NOT NULL GROUP BY ALL) SELECT typecode, count(*) AS aircraft_seen, CASE typecode WHEN 'B738' THEN 'narrowbody' WHEN 'C172' THEN 'light' ELSE 'other' END AS size_class FROM f GROUP BY ALL")
def type_counts(spark, d):
    known = spark.createDataFrame([("B738", "narrowbody"), ("C172", "light")], "typecode string, size_class string")
    first = points(spark, d).filter("typecode_raw IS NOT NULL").groupBy("asset_id").agg(F.min_by("typecode_raw", "seq").alias("typecode"))
    return first.groupBy("typecode").agg(F.count("*").alias("aircraft_seen")).join(known, "typecode", "left").withColumn("size_class", F.coalesce("size_class", F.lit("other")))


@query("null_profile", f"WITH {PTS} SELECT count(*) AS rows, count(DISTINCT track_id) AS tracks, round(avg(CAST(callsign IS NULL AS DOUBLE)), 6) AS null_callsign, round(avg(CAST(on_ground IS NULL AS DOUBLE)), 6) AS null_on_ground FROM pts")
def null_profile(spark, d):
    p = sinks.profile(points(spark, d))
    return p.select("rows", "tracks", F.round("null_callsign", 6).alias("null_callsign"), F.round("null_on_ground", 6).alias("null_on_ground"))


@query("order_tracks", """WITH l AS (SELECT o_custkey, o_orderdate, l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT *, date_diff('day', lag(l_shipdate) OVER w, l_shipdate) AS gap FROM l WINDOW w AS (PARTITION BY o_custkey ORDER BY l_shipdate, l_orderkey, l_linenumber))
SELECT o_custkey, count(*) AS n, max(gap) AS gap_max, CAST(sum(CASE WHEN gap > 60 THEN 1 ELSE 0 END) + 1 AS BIGINT) AS segments, round(max(l_quantity), 6) AS quantity_max FROM g GROUP BY ALL""")
def order_tracks(spark, d):
    """The second adaptor: customers as tracks, ship dates as time."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    t = li.join(o, li["l_orderkey"] == o["o_orderkey"]).selectExpr("CAST(o_custkey AS STRING) AS track_id", "o_custkey", "l_quantity", "CAST(unix_date(CAST(l_shipdate AS DATE)) AS BIGINT) AS t_us", "l_orderkey * 10 + l_linenumber AS seq")
    t = t.withColumn("gap", F.expr("t_us - lag(t_us) OVER (PARTITION BY track_id ORDER BY t_us, seq)"))
    return t.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("gap").alias("gap_max"), (F.count_if(F.col("gap") > 60) + 1).alias("segments"), F.round(F.max("l_quantity"), 6).alias("quantity_max"))

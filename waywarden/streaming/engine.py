"""The online engine: micro-batches of points in, a verdict for each active track and grid time out.

It shares every definition with the batch plan: a micro-batch's grid times are
computed over the buffered points with the same operators, and smoothing goes
on from the stored state, alerts from their last parts. A track is active while
its last fix is not older than the gap; a silent one gets windows up to the
clock. Buffers and states are tables in the shared folder, one set for each
finished batch, so a batch that is tried again starts from the same tables and
writes the same result; sets that no retry needs are removed. No point is late:
one older than the clock joins the buffer and counts in later windows only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waywarden.operators import fleet, halos
from waywarden.operators.fixes import TRACK
from waywarden.params import APRON, US, Fleet, Timing
from waywarden.plans import batch
from waywarden.tables import removed

KEEP_S = 900.0
#: Grid times that are computed at once; a longer gap is caught up in several goes.
CATCH_UP = 720
POINTS = (
    "track_id string, asset_id string, seq long, t_us long, lat double, lon double, domain string, asset_class string, on_ground boolean, alt_baro_m double, alt_geom_m double, gs_mps double, track_deg double, "
    "heading_deg double, vrate_mps double, nacp double, nic double, sil double, callsign string, typecode_raw string"
)
COLUMNS = [c.split()[0] for c in POINTS.split(", ")]


class Engine:
    """alerts, early and verdicts are tables that grow; buffer, state, parts and clock belong to a batch."""

    def __init__(self, spark: SparkSession, folder: str, timing: Timing = Timing(), bundle: batch.Bundle | None = None, profile: Fleet = APRON, layers: dict[str, DataFrame] | None = None, baseline: DataFrame | None = None, keep_s: float = KEEP_S, catch_up: int = CATCH_UP):
        self.spark, self.folder, self.timing, self.bundle = spark, folder.rstrip("/"), timing, bundle or batch.Bundle()
        self.profile, self.layers, self.baseline, self.keep_s, self.catch_up = profile, layers, baseline, keep_s, catch_up

    # ------------------------------------------------------------ tables

    def _path(self, table: str, n: int, go: int | None = None) -> str:
        return f"{self.folder}/{table}/batch={n}" + ("" if go is None else f"/go={go}")

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _table(self, name: str, n: int) -> DataFrame | None:
        path = self._path(name, n)
        return self.spark.read.parquet(path) if n >= 0 and self._there(path) else None

    def _kept(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _all(self, table: str) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.folder}/{table}")

    def verdicts(self) -> DataFrame:
        """All verdicts so far."""
        return self._all("verdicts")

    def alerts(self) -> DataFrame:
        """All area alerts so far, a row for each grid time."""
        return self._all("alerts")

    # ------------------------------------------------------------ steps

    def ingest(self, points: DataFrame, n: int) -> None:
        """One micro-batch: buffers its points and steps the clock to the latest grid time at or before the latest fix."""
        stride = self.timing.us("stride")
        fresh = points.select([F.col(c) if c in points.columns else F.lit(None).alias(c) for c in COLUMNS]).to(self.spark.createDataFrame([], POINTS).schema)
        old, clock_row = self._table("buffer", n - 1), self._table("clock", n - 1)
        for table in ("verdicts", "alerts", "early"):
            removed(self.spark, self._path(table, n))  # of a try before
        buffer = self._kept(fresh if old is None else old.unionByName(fresh), self._path("joined", n))
        latest = buffer.agg(F.max("t_us").alias("b"), F.min("t_us").alias("a")).head()
        clock = clock_row.head()["k"] if clock_row is not None else None
        state, parts = self._table("state", n - 1), self._table("parts", n - 1)
        if latest["b"] is not None:
            now = latest["b"] // stride
            start = clock + 1 if clock is not None else -(-latest["a"] // stride)
            for go, k in enumerate(range(start, now + 1, self.catch_up)):
                state, parts = self.step(buffer, k, min(k + self.catch_up - 1, now), n, go, state, parts)
                clock = min(k + self.catch_up - 1, now)
        self._keep(buffer, clock, state, parts, n)

    def step(self, buffer: DataFrame, start: int, now: int, n: int, go: int, state: DataFrame | None, parts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Writes the verdicts, alerts and early warnings of the grid times start..now; the state and the alerts' parts after them."""
        t, stride = self.timing, self.timing.us("stride")
        end = now * stride
        feats = batch.features(buffer.filter(F.col("t_us") <= end), t, self.layers, end)
        back = round(self.profile.bin_s / t.stride_s)  # what is present at the start was seen since
        feats = self._kept(feats.filter(F.col("k").between(start - back, now)), self._path("features", n, go))
        tables = batch.fleet_tables(feats, self.bundle, self.profile, self.baseline, (start, now), parts)
        tables["parts"] = self._kept(tables["parts"], self._path("allparts", n, go))
        alerts = fleet.shown_alerts(tables["parts"], tables["cells"]).filter(F.col("k").between(start, now))
        tables["alerts"] = self._kept(alerts, self._path("alerts", n, go))
        tables["members"] = fleet.alert_members(batch.degraded(feats, self.bundle), tables["alerts"], self.profile)
        v = batch.verdicts(feats.filter(F.col("k") >= start), self.bundle, self.profile, self.baseline, state, tables)
        v = self._kept(v.withColumn("k", F.round(F.col("t_end") * US / stride).cast("long")), self._path("verdicts", n, go))
        self._kept(self.early_warnings(v.filter(F.col("k") == now), tables["alerts"].filter(F.col("k") == now)), self._path("early", n, go))
        new = v.groupBy(TRACK).agg(F.max_by(F.struct("integrity", "trust_state", "normality_state"), "k").alias("s"), F.max("k").alias("k")).select(TRACK, "s.*", "k")
        if state is not None:
            new = new.unionByName(state.join(new, TRACK, "left_anti"))
        held = fleet.held_steps(self.profile)
        live = tables["parts"].filter(F.col("last") & (F.col("k") + held > now)).select("area", "area_alert_id", "k", "cells")
        # a state that no active track can go on from is of no use
        gap = t.us("gap") // stride + 1
        return self._kept(new.filter(F.col("k") > now - gap), self._path("gostate", n, go)), self._kept(live, self._path("goparts", n, go))

    def early_warnings(self, verdicts: DataFrame, alerts: DataFrame) -> DataFrame:
        """(track_id, k, risk_zone_id, level, label, eta_s): paths of a grid time that run into an area under alert."""
        polygons = halos.halo_polygons(halos.live_halos(alerts, self.timing.stride_s), self.profile.cell_m)
        rows = verdicts.select(TRACK, "k", "aux_lat", "aux_lon", "aux_gs_mps", "aux_track_deg")
        return halos.forecasts(rows, polygons).select(TRACK, "k", "risk_zone_id", "level", "label", "eta_s")

    def _keep(self, buffer: DataFrame, clock: int | None, state: DataFrame | None, parts: DataFrame | None, n: int) -> None:
        """The tables of a finished batch: what of the buffer may still matter, the clock last; then what no retry needs goes."""
        kept = buffer
        if clock is not None:
            now = clock * self.timing.us("stride")
            last = buffer.groupBy(TRACK).agg(F.max("t_us").alias("_last"))
            alive = (now - F.col("_last")) <= self.timing.us("gap")
            kept = buffer.join(last, TRACK).filter((alive & (F.col("t_us") > now - self.keep_s * US)) | (F.col("t_us") > now)).drop("_last")
        kept.write.mode("overwrite").parquet(self._path("buffer", n))
        for name, df in (("state", state), ("parts", parts)):
            if df is not None:
                self._kept(df, self._path(name, n))
        self.spark.createDataFrame([(clock,)], "k long").write.mode("overwrite").parquet(self._path("clock", n))
        for table in ("joined", "features", "allparts", "gostate", "goparts"):
            removed(self.spark, self._path(table, n))
        for table in ("buffer", "state", "parts", "clock"):
            removed(self.spark, self._path(table, n - 2))

    # ------------------------------------------------------------ streams and serving

    def start(self, points: DataFrame, checkpoint: str, **trigger):
        """Runs on a stream of points; trigger as in writeStream.trigger, for example availableNow=True."""
        return points.writeStream.foreachBatch(self.ingest).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()

    def risk_zones(self) -> DataFrame:
        """The areas under alert at the clock as GeoJSON features, one for each cell."""
        a = self.alerts()
        now = self.verdicts().agg(F.max("t_end").alias("t")).head()["t"]
        live = halos.live_halos(a, self.timing.stride_s).filter(F.col("t_end") == now)
        rings = halos.halo_polygons(live, self.profile.cell_m)
        return halos.risk_zone(rings, "live", F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))

    def early(self) -> DataFrame:
        """All early warnings so far."""
        return self._all("early")

    def health(self) -> str:
        row = self.verdicts().agg(F.max("t_end").alias("clock"), F.count_distinct(TRACK).alias("tracks")).head()
        return json.dumps({"status": "ok", "clock": row["clock"], "n_tracks": row["tracks"]})

import time

import numpy as np
import pandas as pd
import pytest

from tests.helpers import T0, frame, track
from waywarden import params
from waywarden.operators import fleet
from waywarden.operators.fixes import TRACK
from waywarden.params import APRON, Timing
from waywarden.plans import batch
from waywarden.streaming.engine import Engine


def traffic(n=5, bad=3, length=121):
    out = []
    for i in range(n):
        p = track(n=length, name=f"test:a{i}:0", lat=41.80 + 0.0002 * i)
        p["track_id"], p["asset_id"] = f"test:a{i}:0", f"a{i}"
        if i < bad:
            p.loc[60:, "nacp"] = 3.0
        out.append(p)
    return pd.concat(out, ignore_index=True)


@pytest.fixture(scope="module")
def batch_verdicts(spark):
    feats = batch.features(frame(spark, traffic()), Timing())
    return batch.verdicts(feats).toPandas()


def test_verdicts_hold_their_rules(spark, batch_verdicts):
    from waywarden.operators.verdict import P, contract, contract_errors

    v = batch_verdicts
    assert len(v) == 5 * 25 and np.allclose(v[P].sum(axis=1), 1)
    assert (v[(v.t_end <= T0 + 55)].trust_state == "trusted").all()
    late = v[v.t_end >= T0 + 110]
    assert (late[late.track_id.str.startswith("test:a0")].trust_state != "trusted").all()
    df = batch.verdicts(batch.features(frame(spark, traffic(2, 1, 61)), Timing()))
    assert contract_errors(df).head().asDict() == {"probabilities": 0, "quadrants": 0, "causes": 0}
    assert contract(df).select("verdict.severity.level", "verdict.cause_probs").count() == 26


def test_online_equals_batch(spark, batch_verdicts, tmp_path):
    engine = Engine(spark, str(tmp_path / "engine"))
    p = traffic()
    for n, (a, b) in enumerate([(0, 40), (40, 80), (80, 121)]):
        engine.ingest(frame(spark, p[(p.seq >= a) & (p.seq < b)]), n)
    live = engine.verdicts().toPandas()
    keys = ["track_id", "t_end"]
    both = batch_verdicts.merge(live, on=keys, suffixes=("", "_live"))
    assert len(both) == len(live) and both.t_end.max() == T0 + 120
    assert np.allclose(both.integrity, both.integrity_live) and (both.trust_state == both.trust_state_live).all() and (both.cause == both.cause_live).all()
    # a batch that is tried again gives the same rows
    again = frame(spark, p[(p.seq >= 80) & (p.seq < 121)])
    engine.ingest(again, 2)
    assert engine.verdicts().count() == len(live)


def still(n=6, length=400, quiet=(), bad=()):
    """Near-still tracks side by side; quiet: track to the second after which it says nothing; bad: track to spans of low accuracy."""
    out = []
    for i in range(n):
        p = track(n=length, speed=0.0, name=f"test:q{i}:0", lat=41.80 + 0.00002 * i)
        for a, b in dict(bad).get(i, ()):
            p.loc[(p.seq >= a) & (p.seq < b), "nacp"] = 3.0
        out.append(p[p.seq <= dict(quiet).get(i, length)])
    return pd.concat(out, ignore_index=True)


def same_verdicts(live, want):
    keys = ["track_id", "t_end"]
    both = want.merge(live, on=keys, suffixes=("", "_live"), how="outer", indicator=True)
    assert (both._merge == "both").all(), both._merge.value_counts()
    assert np.allclose(both.integrity, both.integrity_live)
    for c in ("trust_state", "normality_state", "cause", "action_code", "area_alert_id"):
        assert (both[c].fillna("") == both[f"{c}_live"].fillna("")).all(), c
    return both


def test_online_keeps_silent_tracks_and_alert_ids(spark, tmp_path):
    """Two tracks fall silent, an alert lasts over several micro-batches, and all is as in the batch."""
    p = still(6, 240, quiet=((4, 60), (5, 100)), bad=((0, ((40, 200),)), (1, ((45, 190),)), (2, ((50, 230),)), (3, ((50, 180),))))
    engine = Engine(spark, str(tmp_path / "engine"))
    cuts = [0, 70, 120, 165, 240]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        engine.ingest(frame(spark, p[(p.seq >= a) & (p.seq < b)]), n)
    clock = (T0 + 239) // 5 * 5
    want = batch.verdicts(batch.features(frame(spark, p), Timing(), until_us=clock * 1_000_000)).toPandas()
    want = want[want.t_end <= clock]
    both = same_verdicts(engine.verdicts().toPandas(), want)
    quiet = both[both.track_id == "test:q4:0"]
    assert quiet.t_end.max() == clock and (quiet[quiet.t_end > T0 + 120].confidence < 0.5).all()
    ids = both.area_alert_id.dropna().unique()
    assert len(ids) == 1 and both[both.area_alert_id.notna()].t_end.agg(["min", "max"]).diff().iloc[-1] > 150
    # nothing of old batches stays but what is served
    left = {q.name: sorted(x.name for x in q.iterdir() if x.is_dir()) for q in (tmp_path / "engine").iterdir()}
    assert left["buffer"] == ["batch=2", "batch=3"] and not any(left.get(t) for t in ("features", "joined", "gostate"))
    assert engine.alerts().count() > 0 and engine.risk_zones().columns == ["feature"]


def test_catch_up_loses_nothing(spark, tmp_path):
    """A long silence of the whole stream is caught up in several goes, and every grid time has its verdicts."""
    long = Timing(gap_s=20_000)
    p = still(2, 200)
    p = p[(p.seq < 60) | (p.seq >= 190)].copy()
    late = p.seq >= 190
    p.loc[late, "t_us"] += 10_000 * 1_000_000
    p.loc[late, "t"] += 10_000
    engine = Engine(spark, str(tmp_path / "engine"), long, keep_s=20_000.0)
    engine.ingest(frame(spark, p[~late]), 0)
    engine.ingest(frame(spark, p[late]), 1)
    live = engine.verdicts().toPandas()
    per = live.groupby("track_id").t_end.agg(["count", "nunique", "min", "max"])
    assert (per["count"] == per["nunique"]).all() and (per["count"] == (per["max"] - per["min"]) / 5 + 1).all() and per["count"].min() > 2000


def test_stream_of_files(spark, tmp_path):
    from tests.helpers import POINT

    p = traffic(2, 0, 61)
    frame(spark, p[p.seq < 30]).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(POINT).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    engine = Engine(spark, f"{tmp_path}/out")
    query = engine.start(stream, f"{tmp_path}/cp", availableNow=True)
    assert query.awaitTermination(120)
    assert engine.verdicts().count() == 2 * 6 and '"n_tracks": 2' in engine.health()


def test_live_segments(spark, tmp_path):
    from waywarden.streaming.segments import ROCKSDB, live_segments

    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    rows = [("a", float(T0 + t), i) for i, t in enumerate([0, 10, 5, 310, 611, 612])] + [("b", float(T0), 0)]
    spark.createDataFrame(rows, "asset_id string, t double, arrival long").coalesce(1).write.parquet(f"{tmp_path}/in")
    s = live_segments(spark.readStream.schema("asset_id string, t double, arrival long").parquet(f"{tmp_path}/in"))
    q = s.writeStream.format("memory").queryName("live_segments").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r["asset_id"], r["arrival"]): (r["track_id"], r["seq"]) for r in spark.table("live_segments").collect()}
    assert got[("a", 2)] == ("live:a:0", 2) and got[("a", 3)] == ("live:a:0", 3) and got[("a", 4)] == ("live:a:1", 0) and got[("b", 0)] == ("live:b:0", 0)


# ---------------------------------------------------------------- fleet


def windows(spark, tracks):
    """tracks: name → (cell, list of degraded flags by step)."""
    from waywarden.functions.geo import from_utm, hex_centre

    q0, r0 = 895, 17630
    rows = []
    for name, ((dq, dr), flags) in tracks.items():
        lat, lon = from_utm(*hex_centre(q0 + dq, r0 + dr, APRON.cell_m))
        rows += [(name, T0 // 5 + i, lat, lon, f) for i, f in enumerate(flags) if f is not None]
    return spark.createDataFrame(rows, "track_id string, k long, aux_lat double, aux_lon double, degraded boolean")


def test_lone_fault(spark):
    w = windows(spark, {f"t{i}": ((0, 0), [i == 0] * 20) for i in range(5)})
    f = fleet.fleet_features(w).toPandas()
    own, others = f[f.track_id == "t0"], f[f.track_id != "t0"]
    assert (f.flt_cell_flagged_loo == 0).all() and (own.flt_deg_count_loo == 0).all() and (own.flt_n_others == 4).all() and (others.flt_deg_count_loo == 1).all()


def test_area_event(spark):
    w = windows(spark, {f"t{i}": ((0, 0), [i < 5 and k >= 12 for k in range(30)]) for i in range(6)})
    counts = fleet.cell_counts(fleet.presence(w))
    alerts = fleet.area_alerts(counts)
    a = alerts.toPandas()
    assert a.area_alert_id.nunique() == 1 and a.k.min() == T0 // 5 + 12
    f = fleet.fleet_features(w).toPandas()
    late = f[f.k == T0 // 5 + 20].set_index("track_id")
    assert late.at["t0", "flt_deg_count_loo"] == 4 and late.at["t5", "flt_deg_count_loo"] == 5 and late.at["t5", "flt_deg_rate_loo"] == 1.0
    assert fleet.alert_members(w, alerts).count() == 6 * 18


def test_too_few_and_noisy_cell(spark):
    w = windows(spark, {f"t{i}": ((0, 0), [True] * 5) for i in range(2)})
    assert fleet.cell_counts(fleet.presence(w)).filter("flagged").count() == 0
    w = windows(spark, {f"t{i}": ((0, 0), [True] * 5) for i in range(5)})
    counts = fleet.cell_counts(fleet.presence(w))
    assert counts.filter("flagged").count() == counts.count()
    noisy = counts.select("cell").distinct().selectExpr("cell", "0.7D AS baseline")
    assert fleet.cell_counts(fleet.presence(w), baseline=noisy).filter("flagged").count() == 0


def test_leaving_out_takes_a_tail_for_a_cell_not_for_a_track(spark):
    from pyspark.sql import functions as F

    n = 12_000
    w = windows(spark, {"t": ((0, 0), [True])}).drop("track_id", "degraded").crossJoin(spark.range(n).selectExpr("concat('t', id) AS track_id", "id % 5 < 3 AS degraded"))
    began = time.perf_counter()
    got = fleet.fleet_features(w).groupBy("flt_deg_count_loo", "flt_n_others", "flt_cell_flagged_loo").agg(F.count("*").alias("n")).collect()
    # 12,000 tails of 12,000 terms are 144 million steps of a fold
    assert time.perf_counter() - began < 30
    assert sorted(tuple(r) for r in got) == [(7199.0, 11999.0, 1.0, 7200), (7200.0, 11999.0, 1.0, 4800)]


def test_leaving_out_at_the_edge(spark):
    # four of seven are degraded: three of six are not most, four of six are
    w = windows(spark, {f"t{i}": ((0, 0), [i < 4]) for i in range(7)} | {"n": ((1, 0), [False])})
    f = fleet.fleet_features(w).toPandas().set_index("track_id")
    assert f.flt_cell_flagged_loo.to_dict() == {f"t{i}": float(i >= 4) for i in range(7)} | {"n": 0.0}
    assert np.isclose(f.at["n", "flt_nbr_flagged_frac"], 1 / 6) and f.at["t0", "flt_nbr_flagged_frac"] == 0


def test_binomial_tail_of_very_many(spark):
    from pyspark.sql import functions as F

    got = [spark.range(1).select(fleet.binomial_tail(F.lit(50_000), F.lit(k), F.lit(0.02)).alias("v")).head()["v"] for k in (900, 1000, 1100, 30_000)]
    assert np.allclose(got, [0.9994432795, 0.5043328851, 0.0008626633462, 0], rtol=1e-8)
    assert spark.range(1).select(fleet.binomial_tail(F.lit(5), F.lit(3), F.lit(1.0)).alias("v")).head()["v"] == 1


def test_ring(spark):
    w = windows(spark, {"c": ((0, 0), [False]), "n1": ((1, 0), [False]), "n2": ((-1, 0), [False]), "far": ((9, 0), [False])})
    f = fleet.fleet_features(w).toPandas().set_index("track_id").flt_n_others
    assert f["c"] == 2 and f["n1"] == 1 and f["far"] == 0


def test_neighbour_share(spark):
    w = windows(spark, {"c": ((0, 0), [False])} | {f"d{i}": ((1, 0), [True]) for i in range(4)})
    f = fleet.fleet_features(w).toPandas().set_index("track_id")
    assert np.isclose(f.at["c", "flt_nbr_flagged_frac"], 1 / 6)


def test_presence_and_areas(spark):
    w = windows(spark, {"t": ((0, 0), [False] * 13)})
    assert fleet.presence(w).agg({"k": "max"}).head()[0] == T0 // 5 + 12 + 11
    from pyspark.sql import functions as F

    w = windows(spark, {f"t{i}": ((0, 0), [True]) for i in range(4)}).withColumn("area", F.when(F.col(TRACK) == "t0", "x").otherwise("y"))
    f = fleet.fleet_features(w).toPandas().set_index("track_id").flt_n_others
    assert f["t0"] == 0 and f["t1"] == 2


def shown(spark, flagged, before=None, by_history=True):
    """{k: {id: (cells, flagged now)}} of alerts over flagged cells by time, on a 5 s grid."""
    rows = [("x", k, *map(int, c.split(":")), c, 5, 5, True) for k, cells in flagged.items() for c in cells]
    counts = spark.createDataFrame(rows, "area string, k long, q long, r long, cell string, n_tracks long, n_degraded long, flagged boolean")
    held = before and spark.createDataFrame([("x", a, k, c) for a, k, c in before], "area string, area_alert_id string, k long, cells array<string>")
    out = {}
    for r in fleet.area_alerts(counts, APRON, held, by_history).collect():
        out.setdefault(r["k"], {})[r["area_alert_id"]] = (r["cells"], r["flagged"])
    return out


@pytest.mark.parametrize("by_history", [True, False])
def test_alert_ids_and_hold(spark, by_history):
    a = shown(spark, {0: ["0:0", "1:0"], 1: ["1:0", "2:0"]}, by_history=by_history)
    assert a[0] == {"area_0_0:0": (["0:0", "1:0"], True)} and a[1] == {"area_0_0:0": (["1:0", "2:0"], True)}
    assert a[6] == {"area_0_0:0": (["1:0", "2:0"], False)} and max(a) == 12
    # a split: the larger part keeps the id
    b = shown(spark, {0: ["0:0", "1:0", "2:0"], 1: ["0:0", "2:0", "3:0"]}, by_history=by_history)
    assert b[1] == {"area_0_0:0": (["2:0", "3:0"], True), "area_5_0:0": (["0:0"], True)}
    # a merger: the first id stays, the other alert ends
    c = shown(spark, {0: ["0:0", "4:0"], 1: ["0:0", "1:0", "2:0", "3:0", "4:0"]}, by_history=by_history)
    assert len(c[0]) == 2 and list(c[1]) == ["area_0_0:0"] and list(c[5]) == ["area_0_0:0"]
    # twelve steps of silence are the most an id outlasts
    d = shown(spark, {0: ["0:0"], 12: ["0:0"], 25: ["0:0"]}, by_history=by_history)
    assert list(d[12]) == ["area_0_0:0"] and list(d[25]) == ["area_125_0:0"]
    # an alert of an earlier batch goes on with its id
    e = shown(spark, {13: ["0:0"], 14: ["7:0"]}, [("area_9_z", 10, ["0:0"]), ("area_9_y", 3, ["7:0"])], by_history)
    assert list(e[13]) == ["area_9_y", "area_9_z"] or set(e[13]) == {"area_9_y", "area_9_z"}
    assert set(e[14]) == {"area_9_y", "area_9_z"}


def test_parts_across_patches(spark):
    line = [f"{q}:0" for q in range(-40, 40)] + [f"{q}:5" for q in range(3)] + ["100:31", "100:32", "-33:64", "-32:63"]
    counts = spark.createDataFrame([("x", 1, *map(int, c.split(":")), c) for c in line], "area string, k long, q long, r long, cell string")
    got = {}
    for r in fleet.parts(counts).collect():
        got.setdefault(r["part"], []).append(r["cell"])
    assert sorted(map(len, got.values())) == [2, 2, 3, 80]


@pytest.mark.parametrize("n,k,p", [(5, 3, 0.02), (12, 12, 0.3), (4, 0, 0.1), (6, 7, 0.5), (40, 2, 0.02)])
def test_binomial_tail(spark, n, k, p):
    import math

    from pyspark.sql import functions as F

    got = spark.range(1).select(fleet.binomial_tail(F.lit(n), F.lit(k), F.lit(p)).alias("v")).head()["v"]
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(k, 0), n + 1))
    assert math.isclose(got, want, rel_tol=1e-9)


def test_training_and_metrics(spark):
    from pyspark.sql import functions as F

    from waywarden.operators import models

    rng = np.random.default_rng(0)
    rows = []
    for s in range(40):
        cause = params.CAUSES[s % 3 * 2]  # plausible, technical_error, possible_interference
        for _ in range(30):
            bad = cause != "plausible"
            rows.append((f"s{s}", float(rng.gamma(2, 2) + 12 * bad), float(rng.random() < 0.1 + 0.6 * (cause == "possible_interference")), None if rng.random() < 0.1 else float(rng.normal() + 3 * bad), cause, False))
    df = spark.createDataFrame(rows, "scene_id string, kin_speed_resid_max double, flt_deg_rate_loo double, kin_pos_jitter_m double, label_cause string, label_transition boolean")
    parts = models.split_scenes(df.select("scene_id", "label_cause").distinct(), ["label_cause"])
    models.check_splits(parts, df)
    assert {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}["train"] in range(20, 29)
    b = batch.train(df, parts)
    assert all(w >= -1e-9 for n, w in b.second.weights[0].items() if not n.startswith("missing"))
    scored = df.withColumns({"p": b.second.probability(), "unsound": ~F.col("label_cause").isin(*params.SOUND)})
    m = batch.evaluate(scored)
    assert m["auroc"] > 0.9 and m["average_precision"] > 0.9 and m["ece"] < 0.1
    probs = df.withColumns({f"p_{c}": x for c, x in b.causes.probabilities().items()})
    assert probs.filter(" + ".join(f"p_{c}" for c in params.CAUSES) + " NOT BETWEEN 0.999999 AND 1.000001").count() == 0

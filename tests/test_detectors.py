import time

import numpy as np
import pandas as pd
import pytest

from tests.helpers import frame, shift, track
from waywarden.operators import detectors


def labels_of(spark, p):
    return detectors.signal(frame(spark, p)).toPandas().sort_values(["t_us", "seq"]).set_index("seq")


@pytest.fixture(scope="module")
def base():
    return track(n=121, alt_geom_m=50.0)


def rows(s, label):
    return sorted(s.index[s[label]])


def test_clean(spark, base):
    assert (labels_of(spark, base).signal_label == "").all()


def test_jump_and_return(spark, base):
    s = labels_of(spark, shift(shift(base, range(50, 60), north_m=40.0), [70], north_m=80.0))
    assert rows(s, "position_jump") == [*range(50, 60), 70]


def test_frozen(spark, base):
    p = base.copy()
    p.loc[50:69, ["lat", "lon"]] = p.loc[49, ["lat", "lon"]].values
    s = labels_of(spark, p)
    assert rows(s, "frozen_position") == list(range(50, 70)) and not s.position_jump.any()


def test_frozen_with_two_fixes_of_one_time_at_the_end(spark, base):
    p = base.copy()
    p.loc[50:69, ["lat", "lon"]] = p.loc[49, ["lat", "lon"]].values
    p.loc[120, "t_us"] = p.loc[119, "t_us"]
    assert rows(labels_of(spark, p), "frozen_position") == list(range(50, 70))
    p.loc[120, ["lat", "lon"]] = p.loc[119, ["lat", "lon"]].values
    assert rows(labels_of(spark, p), "frozen_position") == list(range(50, 70))


def test_fix_loss(spark, base):
    s = labels_of(spark, base[(base.seq < 50) | (base.seq >= 90)])
    assert rows(s, "fix_loss") == [49, 90] and np.allclose(s.loc[[49, 90], "gap_s"], 41)


def test_speed_and_heading(spark, base):
    p = base.copy()
    p.loc[20:39, "gs_mps"] = 20.0
    assert rows(labels_of(spark, p), "implausible_speed") == list(range(20, 40))
    p = base.copy()
    p.loc[20:39, "heading_deg"] = 0.0
    assert rows(labels_of(spark, p), "heading_incoherent") == list(range(20, 40))
    p = base.copy()
    p["heading_deg"] = 270.0
    assert not labels_of(spark, p).heading_incoherent.any()


def test_altitude_spike(spark, base):
    p = base.copy()
    p.loc[30, "alt_geom_m"] = 90.0
    assert rows(labels_of(spark, p), "altitude_spike") == [30]


def test_multipath(spark, base):
    rng = np.random.default_rng(1)
    p = base
    for i in range(40, 70):
        p = shift(p, [i], north_m=float(rng.normal(0, 9)), east_m=float(rng.normal(0, 9)))
    s = labels_of(spark, p)
    assert s.loc[45:65, "multipath_noise"].mean() > 0.5


def zone(x, y, size, name, kind, groups, limit, area=1.0):
    ring = [(x - size, y - size), (x + size, y - size), (x + size, y + size), (x - size, y + size), (x - size, y - size)]
    return (name, kind, groups, limit, area, ring)


def test_behaviour(spark, base):
    from waywarden.operators.places import to_metric

    x, y = to_metric(base.lat[0], base.lon[0])
    zones = spark.createDataFrame(
        [zone(x + 100, y, 60, "rw", "runway_critical", ["aircraft"], None), zone(x + 300, y, 80, "road", "service_road_corridor", ["handling"], 2.0), zone(x + 500, y, 60, "apron", "apron", ["sar"], None)],
        "zone_id string, zone_class string, allowed_groups array<string>, speed_limit_mps double, area double, ring array<struct<x:double,y:double>>",
    )
    groups = spark.createDataFrame([("pax_bus", "handling"), ("aircraft_taxi", "aircraft")], "asset_kind string, group string")
    other = track(n=121, name="test:b:0", domain="aircraft", cls="other", lat=float(base.lat[0]) + 0.0001)
    s = detectors.signal(frame(spark, pd.concat([base, other])))
    from pyspark.sql import functions as F

    s = s.withColumn("asset_kind", F.when(F.col("domain") == "vehicle", "pax_bus").otherwise("aircraft_taxi"))
    b = detectors.behaviour(s, zones, groups).toPandas()
    mine = b[b.domain == "vehicle"].set_index("seq").sort_index()
    assert rows(mine, "runway_incursion")[0] in range(7, 10) and mine.runway_incursion.sum() > 15
    assert mine.unauthorized_zone.sum() > 15 and not mine.loc[50:70, "unauthorized_zone"].any()
    # the whole road is faster than posted, so the class's own bulk speed is the limit
    assert not mine.overspeed.any() and np.allclose(mine.loc[50:70, "threshold_mps"], 5, atol=0.1)
    assert mine.aircraft_proximity.mean() > 0.9


def crowd(rng, n, kind, scale, lat=41.8, lon=12.25):
    """(track_id, seq, t_us, lat, lon, asset_id, asset_kind, domain, v5, position_wrong) of n assets in two seconds, each on a scale of its own."""
    size = scale * 10 ** rng.uniform(-4, 0, n)
    la, lo = lat + size * rng.normal(size=n) / 111_000, lon + size * rng.normal(size=n) / 83_000
    second = rng.integers(0, 2, n)
    air = kind == "aircraft_taxi"
    return [(f"{kind}{i}", i, int(1_000_000 * second[i] + 17 * i), float(la[i]), float(lo[i]), f"{kind[0]}{i}", kind, "aircraft" if air else "vehicle", 5.0, False) for i in range(n)]


CROWD = "track_id string, seq long, t_us long, lat double, lon double, asset_id string, asset_kind string, domain string, v5 double, position_wrong boolean"


def test_proximity_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows_ = crowd(rng, 300, "bus", 60.0) + crowd(rng, 300, "aircraft_taxi", 60.0)
    # copies of a place under other names, a vehicle in such a place, one far from all, places that are not known, one that stands
    a, b = rows_[400], rows_[401]
    rows_ += [("c", i, a[2], a[3], a[4], f"a{i}", *a[6:]) for i in range(5)] + [("v", i, a[2], a[3], a[4], "v", "bus", "vehicle", 5.0, False) for i in range(3)]
    rows_ += [("far", 0, a[2], 41.9, 12.4, "far", "bus", "vehicle", 5.0, False), ("null", 0, a[2], None, 12.25, "null", "bus", "vehicle", 5.0, False), ("nil", 0, a[2], 41.8, None, "nil", *a[6:])]
    rows_ += [("still", 0, b[2], b[3], b[4], "0", "aircraft_taxi", "aircraft", 0.0, False), ("wrong", 0, b[2], b[3], b[4], "0", "aircraft_taxi", "aircraft", 5.0, True), ("w", 0, b[2], b[3], b[4], "w", "bus", "vehicle", 5.0, False)]
    s = spark.createDataFrame(rows_, CROWD)
    from pyspark.sql import functions as F

    from waywarden.functions import geo

    v = s.filter("domain = 'vehicle'").selectExpr("track_id", "seq", "t_us div 1000000 AS sec", "lat", "lon")
    o = s.filter("asset_kind = 'aircraft_taxi' AND v5 >= 1 AND NOT position_wrong").selectExpr("t_us div 1000000 AS sec", "lat AS lat2", "lon AS lon2", "asset_id")
    pairs = v.join(o, "sec").withColumn("d", F.expr(geo.distance_m("lat", "lon", "lat2", "lon2"))).filter("d <= 20")
    want = pairs.groupBy("track_id", "seq").agg(F.min(F.struct("d", "asset_id")).alias("n")).select("track_id", "seq", "n.*").collect()
    got = detectors.proximity(s).collect()
    assert len(want) > 200 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_proximity_in_a_crowd(spark):
    rng = np.random.default_rng(6)
    n = 30_000
    s = spark.createDataFrame(crowd(rng, n, "bus", 5.0) + crowd(rng, n, "aircraft_taxi", 5.0), CROWD)
    began = time.perf_counter()
    # some 450 million pairs share a second
    assert detectors.proximity(s).count() > 0.99 * n and time.perf_counter() - began < 30


def test_trust_attaches_forward_then_back(spark, base):
    v = spark.createDataFrame([("test:a:0", float(base.t[0] + 10), "trusted", 90.0), ("test:a:0", float(base.t[0] + 50), "caution", 60.0)], "track_id string, t_end double, trust_state string, integrity double")
    out = detectors.attach_trust(frame(spark, base), v).toPandas().set_index("seq").sort_index()
    assert out.at[5, "trust_state"] == "trusted" and out.at[11, "trust_state"] == "caution" and out.at[100, "trust_state"] == "caution"

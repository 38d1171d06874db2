import pytest
from pyspark.sql import functions as F

from waywarden import params, registry
from waywarden.operators import scoring, verdict


def states(spark, values, column, f):
    rows = [("t", float(i), float(v)) for i, v in enumerate(values)]
    return [r for r in f(spark.createDataFrame(rows, f"track_id string, t_end double, {column} double")).orderBy("t_end").collect()]


def trust(spark, values):
    return states(spark, values, "integrity_raw", lambda d: verdict.trust_state(verdict.smooth(d)))


def test_smoothing(spark):
    s = trust(spark, [95, 95, 5, 5, 5])
    assert abs(s[2]["integrity"] - (0.7 * 5 + 0.3 * 95)) < 1e-9 and s[2]["trust_state"] == "untrusted"


def test_hysteresis(spark):
    assert {r["trust_state"] for r in trust(spark, [95, 5, 5, 50, 45, 52, 48, 50])[1:]} == {"untrusted"}


def test_recovery(spark):
    s = [r["trust_state"] for r in trust(spark, [95, 5, 5, *[100] * 30])]
    assert s[-1] == "trusted" and "caution" in s and trust(spark, [95, 5, 5, *[100] * 4, *[65] * 4])[-1]["trust_state"] == "caution"


@pytest.mark.parametrize("values,want", [([100, 30, 45, 50, 60, 100], ["expected", "abnormal", "abnormal", "abnormal", "expected", "expected"]), ([40], ["expected"]), ([30, 55], ["abnormal", "abnormal"])])
def test_normality(spark, values, want):
    assert [r["normality_state"] for r in states(spark, values, "normality", verdict.normality_state)] == want


def test_states_go_on_from_before(spark):
    d = spark.createDataFrame([("t", 0.0, 50.0, 30.0, "untrusted")], "track_id string, t_end double, integrity_raw double, i double, s string")
    r = verdict.trust_state(verdict.smooth(d, init="i"), init="s").head()
    assert abs(r["integrity"] - (0.3 * 50 + 0.7 * 30)) < 1e-9 and r["trust_state"] == "untrusted"


@pytest.mark.parametrize("x,want", [(1, 0), (1.5, 0), (2.25, 0.5), (3, 1), (5, 1), (None, 0)])
def test_violation(spark, x, want):
    assert spark.range(1).select(scoring.violation(F.lit(x).cast("double"), 1.5, 1.5).alias("v")).head()["v"] == want


def test_dimensions(spark):
    d = spark.createDataFrame([(2.25, 1.0), (2.25, 2.25), (1.0, 1.0)], "kin_speed_ratio_max double, kin_accel_ratio_max double")
    out = scoring.dimension_scores(scoring.violations(d)).collect()
    assert [r["d_kinetic"] for r in out] == [50, 25, 100] and all(r["d_temporal"] == r["normality"] == 100 for r in out)


@pytest.mark.parametrize("n,gap,margin,value,name", [(30, 1, 0.9, 1, "high"), (2, 1, 0.9, 0.25, "low"), (30, 30, 0.9, 0.25, "low"), (30, 1, 0.05, 0.6, "medium")])
def test_confidence(spark, n, gap, margin, value, name):
    d = spark.createDataFrame([(float(n), float(gap), 0.05 + margin, 0.05)], "n double, gap double, a double, b double")
    c = verdict.confidence(F.col("n"), F.col("gap"), [F.col("a"), F.col("b")])
    r = d.select(c.alias("c"), verdict.level(c, params.CONFIDENCE_LEVELS, "low").alias("l")).head()
    assert abs(r["c"] - value) < 1e-9 and r["l"] == name


def test_action_order(spark):
    rows = [("x", "caution", "expected", "trusted", "none", "area_gnss_unreliable"), (None, "untrusted", "abnormal", "data_fault", "high", "verify_radio"), (None, "untrusted", "abnormal", "data_fault", "low", "verify_visual"), (None, "trusted", "abnormal", "real_event", "critical", "act_now"),
            (None, "untrusted", "expected", "silent_risk", "medium", "cross_check"), (None, "caution", "expected", "trusted", "low", "monitor"), (None, "trusted", "expected", "trusted", "high", "none")]
    d = spark.createDataFrame(rows, "a string, t string, n string, q string, s string, want string")
    for r in d.withColumn("got", verdict.action_code(F.col("a"), F.col("t"), F.col("n"), F.col("q"), F.col("s"))).collect():
        assert r["got"] == r["want"]


def test_action_text_and_evidence(spark):
    d = spark.createDataFrame([("act_now", " AZA1 ", None, "bus"), ("none", None, None, None)], "c string, aux_callsign string, aux_zone_name string, aux_asset_class string")
    assert [r[0] for r in d.select(verdict.action_text(F.col("c"), d.columns)).collect()] == ["Contact AZA1 now: a bus is moving unexpectedly in this area.", "No action needed."]
    f = spark.createDataFrame([(40.0, 2.25, "bus", None, 12.0, 0.5, "caution", "expected")], "kin_speed_resid_max double, kin_accel_ratio_max double, aux_asset_class string, aux_speed_implied_mps double, aux_speed_reported_mps double, tmp_frozen_frac double, trust_state string, normality_state string")
    e = verdict.evidence(scoring.violations(f)).head()["evidence"]
    # the heaviest cannot be filled, as the implied speed is unknown
    assert [x["feature"] for x in e] == ["kin_accel_ratio_max", "tmp_frozen_frac"] and e[1]["text"].startswith("50% of positions") and e[0]["limit"] == 1.5


def test_registry():
    assert len(registry.FEATURES) == 53 and len(registry.SCORED) == 36
    HEAD = "name,unit,monotone,source,tau,scale,applies_to,template"
    with pytest.raises(registry.LeakageError):
        registry.assert_no_leakage(["kin_speed_resid_max", "label_cause"])
    with pytest.raises(ValueError):
        registry.parse(f"{HEAD}\nkin_a,m,0,fixed,,,all,")
    with pytest.raises(ValueError):
        registry.parse(f"{HEAD}\nkin_a,m,0,none,,,all,{{aux_unknown}}")
    with pytest.raises(ValueError):
        registry.parse(f"{HEAD}\nkin_a,m,0,none,,,all,\nkin_a,m,0,none,,,all,")
    assert list(registry.parse(f"# remark\n{HEAD}\nkin_a,m,0,none,,,all,")) == ["kin_a"]


def test_synthetic_scenes(spark):
    from waywarden.operators import synth

    p = synth.scenes(spark, 6, assets=2, seconds=300.0).toPandas()
    again = synth.scenes(spark, 6, assets=2, seconds=300.0).toPandas()
    key = ["track_id", "seq"]
    assert p.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    causes = {r["scene_id"]: r["cause"] for r in synth.events(spark, 6, assets=2, seconds=300.0).collect()}
    assert sorted(causes.values()) == sorted(params.CAUSES[1:])
    for name, g in p.groupby("scene_id"):
        assert set(g.label_cause) == {"plausible", causes[name]}
    clean = p[p.label_cause == "plausible"]
    assert (abs(clean.lat - clean.label_true_lat) * 111_000 < 12).all() and (clean.nacp == 10).all()
    a, _ = synth.scene(3, assets=2, event=False)
    before = a.copy()
    b, event = synth.inject(a, "possible_spoofing", float(a.t.min() + 100), 60.0, [a.track_id[0]], 1)
    assert a.equals(before) and event["track_ids"] == [a.track_id[0]] and (b[b.label_cause == "possible_spoofing"].nacp == 10).all()


def test_place_rules(spark):
    from waywarden.operators import halos, places

    x, y = places.to_metric(41.8, 12.25)
    p = spark.createDataFrame([("t", i, i * 1_000_000, x + (0 if i < 50 else 40 * (i - 49)), y, True) for i in range(60)], "track_id string, seq long, t_us long, x double, y double, ok boolean")
    d = places.dwell(p).orderBy("seq").toPandas().dwell_s
    assert d[49] == 49 and d[50] == 0 and d[59] == 0
    ring = [(x - 10, y + 50), (x + 10, y + 50), (x + 10, y + 70), (x - 10, y + 70), (x - 10, y + 50)]
    b = spark.createDataFrame([("b", 50.0, ring)], "building_id string, height_m double, ring array<struct<x:double,y:double>>")
    e = places.building_elevation(p.filter("seq = 0"), b, ["track_id", "seq"]).head()["elevation_deg"]
    assert abs(e - 45) < 1e-6
    assert [z["angle"] for z in halos.static_bands()] == [45.0, 30.0, 15.0] and halos.static_bands()[0]["level"] == 0.75

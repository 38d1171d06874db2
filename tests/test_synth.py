import numpy as np
import pandas as pd
import pytest

from waywarden import params
from waywarden.operators import synth


def test_phases_keep_speed_and_acceleration():
    places = np.array([[0.0, 0], [300, 0], [300, 200], [310, 200], [900, 800]])
    tops, accel = np.array([10.0, 6, 12, 12]), 0.8
    table = synth.phases(places, tops, accel)
    way = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(places, axis=0).T))])
    d = synth.Drive(table, way, places)
    t = np.linspace(0, table[-1, 0], 5000)
    x, y, v, _ = d.at(t)
    assert v[0] == 0 and v[-1] < 0.01 and np.allclose([x[-1], y[-1]], places[-1], atol=0.1)
    assert np.all(np.abs(np.diff(v)) <= accel * np.diff(t) + 1e-6) and v.max() <= 12
    # the way driven is the integral of the speed
    assert np.isclose(np.trapezoid(v, t), way[-1], rtol=1e-3)
    on_second = (x > 299.99) & (y < 200)
    assert v[on_second].max() <= 6 + 1e-9


def test_routes_are_quickest():
    net = synth.Net([(0, 0, 100, 0, 10), (100, 0, 100, 100, 10), (0, 0, 0, 100, 1), (0, 100, 100, 100, 1), (500, 500, 600, 600, 5)])
    at = {p: i for i, p in enumerate(net.places)}
    assert [net.places[i] for i in net.route(at[0, 0], at[100, 100], 20)] == [(0, 0), (100, 0), (100, 100)]
    # with a slow asset both ways are as quick; with no way there is none
    assert len(net.route(at[0, 0], at[100, 100], 1)) == 3 and net.route(at[0, 0], at[600, 600], 20) is None


def test_wander_has_its_memory():
    rng = np.random.default_rng(1)
    t = np.arange(0, 400.0)
    many = np.array([synth.wander(t, 20.0, rng) for _ in range(400)])
    assert abs(many.std() - 1) < 0.05
    for lag in (10, 20, 40):
        assert abs((many[:, :-lag] * many[:, lag:]).mean() - np.exp(-lag / 20)) < 0.08


@pytest.mark.parametrize("cause", params.CAUSES[1:])
def test_injection_is_pure_and_repeats(cause):
    clean, _ = synth.scene(4, assets=3, seconds=300.0, event=False)
    before, onset = clean.copy(), float(clean.t.min() + 100)
    names = sorted(clean.track_id.unique())[:2]
    a, e = synth.inject(clean, cause, onset, 80.0, names, 9)
    b, f = synth.inject(clean, cause, onset, 80.0, names, 9)
    c, _ = synth.inject(clean, cause, onset, 80.0, names, 10)
    assert clean.equals(before) and a.equals(b) and e == f and not a.equals(c)
    hit = a.label_event_id == e["event_id"]
    assert set(a[hit].track_id) == set(names) and set(a[hit].label_cause) == {cause}
    # outside the event and on the other track nothing but the onset's label changes
    outside = a[~hit].drop(columns="label_onset_t").reset_index(drop=True)
    kept = clean[~(clean.track_id.isin(names) & (clean.t >= onset) & (clean.t < onset + 80))].drop(columns="label_onset_t").reset_index(drop=True)
    assert outside.equals(kept)


def test_what_each_cause_shows():
    clean, _ = synth.scene(5, assets=3, seconds=300.0, event=False)
    onset, name = float(clean.t.min() + 100), sorted(clean.track_id.unique())[0]

    def hit(cause, **settings):
        out, e = synth.inject(clean, cause, onset, 80.0, [name], 1, settings)
        return out[out.label_event_id == e["event_id"]]

    off = lambda g: np.hypot((g.lat - g.label_true_lat) * 111_000, (g.lon - g.label_true_lon) * 83_000)
    assert (hit("degraded").nacp < params.DEGRADED_NACP_BELOW).all()
    assert hit("technical_error", mode="freeze")[["lat", "lon"]].drop_duplicates().shape[0] == 1
    assert (off(hit("technical_error", mode="jump", jump_m=400.0)) > 380).all()
    assert len(hit("technical_error", mode="loss")) < 75
    assert hit("technical_error", mode="duplicate_t").t.duplicated().sum() > 10
    g = hit("technical_error", mode="out_of_order").sort_values("seq")
    assert (g.t.diff() < 0).sum() > 10
    drift = off(hit("gnss_anomaly"))
    assert drift.iloc[-1] > 40 and hit("gnss_anomaly").nacp.iloc[-1] < 10
    assert (hit("possible_spoofing").nacp == 10).all() and off(hit("possible_spoofing")).iloc[-1] > 30
    beside = hit("behavioral_anomaly", mode="deviate", aside_m=100.0)
    assert off(beside).max() < 12 and (beside.nacp == 10).all()


def test_clean_traffic_is_within_limits(spark):
    from waywarden.operators.windows import window_features

    w = window_features(synth.scenes(spark, 4, assets=4, seconds=400.0, event=False)).filter("tmp_n_points >= 4").toPandas()
    for f in ("kin_speed_ratio_max", "kin_accel_ratio_max", "kin_turn_rate_ratio_max"):
        assert (w[f] > 1.5).mean() < 0.001
    assert (w.kin_speed_resid_max > 10).mean() < 0.001 and (w.tmp_gap_max_s < 2).all()


def test_planned_events_do_not_overlap():
    points, told = synth.scene(7, assets=6, seconds=900.0, n_events=4)
    spans = sorted((e["t_onset"], e["t_end"]) for e in told)
    assert len(told) == 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len({e["cause"] for e in told}) == 4
    assert synth.stretches(np.array([0.0, 1, 2, 9, 10, 11]), np.array([True, True, False, True, True, True])) == [(0, 1), (9, 11)]
    assert synth.stretches(np.array([]), np.array([], bool)) == []


def test_buildings_raise_the_error():
    x = np.array([0.0, 1000.0])
    r = synth.obstruction(x, np.zeros(2), [(0.0, 10.0, 60.0)])
    assert r[0] == pytest.approx(4.0) and r[1] < 1.3


def test_approach_scenes(spark):
    rows = pd.concat([synth.scene(s, assets=16, seconds=120.0, event=False)[0] for s in (1, 30)])
    few = rows[~((rows.scene_id == "scene_30") & (rows.track_id.str[-3] > "3"))]
    df = spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in few[synth.COLUMNS].itertuples(index=False)], synth.POINTS)
    out = synth.approach_scenes(df, "possible_spoofing", 40.0).toPandas()
    assert out.scene_id.nunique() == 1 and out.track_id.nunique() == 16
    assert out[out.label_cause == "possible_spoofing"].track_id.nunique() == 1


def test_demonstration():
    points, told = synth.demo()
    assert synth.demo_faults(points, told) == [] and synth.demo()[0].equals(points)
    assert "incursion: never on the runway" in synth.demo_faults(points.assign(label_true_lat=41.9), told)
    assert "events overlap" in synth.demo_faults(points, [e | {"t_onset": 0.0} for e in told])

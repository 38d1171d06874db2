import numpy as np
import pandas as pd
import pytest

from tests.helpers import T0, frame, shift, track, windows_of
from waywarden import registry
from waywarden.operators import fixes


@pytest.fixture(scope="module")
def clean(spark):
    return windows_of(spark, track())


def full(w):
    return w[(w.index >= T0 + 35) & (w.index <= T0 + 120)]


def test_grid(clean):
    assert list(clean.index) == [T0 + 5 * i for i in range(25)]


def test_clean_bus(clean):
    w = full(clean)
    assert (w.kin_speed_resid_max < 0.5).all() and (w.kin_pos_jitter_m < 0.5).all()
    assert np.allclose(w.kin_speed_ratio_max.astype(float), 5 / 8.5, atol=0.05)
    for f in registry.ENVELOPE_RATIOS:
        assert not (w[f].astype(float) >= 1).any(), f
    assert (w.tmp_gap_max_s <= 1.5).all() and (w.tmp_dup_count == 0).all() and (w.tmp_nonmono_count == 0).all() and (w.tmp_frozen_run_s == 0).all()


def test_helicopter_has_no_envelope(spark):
    w = windows_of(spark, track(n=60, speed=20.0, cls="helicopter", domain="aircraft"))
    assert w[registry.ENVELOPE_RATIOS].isna().all().all() and w.kin_speed_resid_max.notna().any()


def test_airborne_ratio(spark):
    w = windows_of(spark, track(n=80, dt=2.5, speed=80.0, cls="narrowbody", domain="aircraft"))
    assert np.allclose(w.kin_speed_ratio_max.dropna().astype(float), 80 / 320, atol=0.02) and w.aux_airborne.all()


def test_five_second_rule(spark):
    p = track()
    extra = shift(p.iloc[[50]], [50], north_m=5.0)
    extra["t_us"] += 200_000
    extra["seq"] = 1000
    w = full(windows_of(spark, pd.concat([p, extra])))
    assert (w.kin_speed_ratio_max < 1.2).all() and (w.kin_accel_ratio_max < 1).all() and (w.kin_speed_resid_max < 3).all()


def test_held_jump(spark):
    w = windows_of(spark, shift(track(), range(60, 121), north_m=300.0))
    assert (w[(w.index >= T0 + 10) & (w.index < T0 + 60)].kin_speed_resid_max < 0.5).all()
    at = w[(w.index >= T0 + 60) & (w.index <= T0 + 70)]
    assert (at.kin_speed_resid_max > 30).all() and (at.aux_speed_implied_mps > 30).all() and np.allclose(at.aux_speed_reported_mps, 5, atol=0.2)


def test_frozen(spark):
    p = track()
    p.loc[61:80, ["lat", "lon"]] = p.loc[60, ["lat", "lon"]].values
    w = windows_of(spark, p)
    assert (w[(w.index >= T0 + 80) & (w.index <= T0 + 85)].tmp_frozen_run_s >= 15).all()
    assert (w[(w.index >= T0 + 80) & (w.index <= T0 + 85)].tmp_frozen_frac > 0.4).all() and (w[w.index < T0 + 55].tmp_frozen_run_s == 0).all()


def test_gap_has_windows(spark):
    p = track(n=200)
    w = windows_of(spark, p[(p.seq <= 60) | (p.seq >= 110)])
    assert w.at[T0 + 75, "tmp_staleness_s"] >= 15 and w.at[T0 + 75, "tmp_gap_max_s"] >= 15
    assert w.at[T0 + 100, "tmp_n_points"] == 0 and w.at[T0 + 100, "tmp_gap_max_s"] >= 40 and w.at[T0 + 110, "tmp_gap_max_s"] >= 50


def test_order_and_duplicates(spark):
    p = track()
    p.loc[70, "t_us"] = round((T0 + 65.5) * 1e6)
    p.loc[71, "t_us"] = round((T0 + 70) * 1e6)
    p.loc[72, "t_us"] = round((T0 + 70) * 1e6)
    w = windows_of(spark, p)
    assert w.tmp_nonmono_count.max() >= 1 and w.tmp_dup_count.max() >= 1 and (w[w.index <= T0 + 60].tmp_dup_count == 0).all()


def test_majority(spark):
    p = track()
    few, all_ = p.copy(), p.copy()
    few.loc[90:94, "nacp"] = 5.0
    all_.loc[60:, "nacp"] = 4.0
    w = windows_of(spark, few)
    assert 0.1 < w.at[T0 + 95, "sig_degraded_frac"] < 0.3 and w.at[T0 + 95, "sig_degraded_majority"] == 0
    w = windows_of(spark, all_)
    assert w.at[T0 + 115, "sig_degraded_frac"] == 1 and w.at[T0 + 115, "sig_degraded_majority"] == 1 and w.at[T0 + 115, "sig_nacp_drop"] == 6


def test_causality(spark):
    p = shift(track(n=200), range(150, 200), north_m=200.0)
    a, b = windows_of(spark, p), windows_of(spark, p[p.seq <= 100])
    a = a[a.index <= T0 + 100]
    for f in registry.names("kinetic", "temporal", "signal"):
        assert np.allclose(a[f].astype(float), b[f].astype(float), rtol=1e-9, equal_nan=True), f


def test_tracks_do_not_touch(spark):
    a, b = track(n=60), track(n=60, name="test:b:0", speed=7.0, lat=41.81)
    both = windows_of(spark, pd.concat([a, b]))
    alone = windows_of(spark, a)
    mine = both[both.track_id == "test:a:0"]
    assert np.allclose(mine.kin_speed_ratio_max.astype(float), alone.kin_speed_ratio_max.astype(float), equal_nan=True)


def test_window_labels(spark):
    from pyspark.sql import functions as F

    from waywarden.operators.labels import window_labels

    p = frame(spark, track()).withColumns({
        "label_cause": F.when(F.col("seq") >= 60, "gnss_anomaly").otherwise("plausible"),
        "label_event_id": F.when(F.col("seq") >= 60, "e1"),
        "label_onset_t": F.when(F.col("seq") >= 60, F.lit(float(T0 + 60))),
    })
    w = window_labels(p).toPandas().set_index("k")
    k = T0 // 5
    assert w.at[k + 11, "label_frac"] == 0
    assert np.isclose(w.at[k + 13, "label_frac"], 6 / 30) and w.at[k + 13, "label_transition"] and w.at[k + 13, "label_cause"] == "plausible"
    assert np.isclose(w.at[k + 14, "label_frac"], 11 / 30) and w.at[k + 14, "label_cause"] == "gnss_anomaly"
    assert w.at[k + 22, "label_frac"] == 1 and w.at[k + 22, "label_event_id"] == "e1"


def test_arrivals_of_one_seq_do_not_depend_on_the_order_of_rows(spark):
    rows = [("t", seq, t) for seq, t in ((0, 10), (1, 30), (1, 20), (1, 40), (2, 35), (3, 35), (3, 36))]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "track_id string, seq long, t_us long").coalesce(1)
        got = sorted((r["seq"], r["t_us"], r["nonmono"]) for r in fixes.arrivals(df).collect())
        assert got == [(0, 10, 0), (1, 20, 0), (1, 30, 0), (1, 40, 0), (2, 35, 1), (3, 35, 0), (3, 36, 0)]

import json

import pytest
from pyspark.sql import functions as F

from waywarden.operators import synth
from waywarden.sources import layers


def test_building_heights(spark):
    rows = [({"height": "12.5 m"}, 12.5), ({"building:height": "8"}, 8.0), ({"building:levels": "4"}, 12.0), ({"aeroway": "hangar"}, 15.0), ({}, 6.0)]
    df = spark.createDataFrame([(p, w) for p, w in rows], "properties map<string,string>, want double")
    assert all(r["h"] == r["want"] for r in df.select("want", layers.building_height(F.col("properties")).alias("h")).collect())


def test_runway_ends():
    from waywarden.operators.places import to_metric

    a, b = to_metric(41.846, 12.262), to_metric(41.812, 12.275)
    ends = layers.runway_ends([("16R/34L", [a, b]), (None, [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)])])
    assert [e[1] for e in ends] == ["16R", "34L"] and abs(ends[0][5] - 164) < 2 and abs(ends[1][5] - 344) < 2 and abs(ends[0][2] - 41.846) < 1e-6


def test_zone_layer(spark, tmp_path):
    line = {"type": "Feature", "properties": {"ref": "A", "maxspeed": "36"}, "geometry": {"type": "LineString", "coordinates": [[12.24, 41.80], [12.25, 41.80], [12.25, 41.81]]}}
    (tmp_path / "taxiway.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [line]}))
    z = layers.zones(spark, str(tmp_path), ("taxiway",)).collect()
    assert len(z) == 2 and {r["zone_id"] for r in z} == {"taxiway_0"} and z[0]["speed_limit_mps"] == pytest.approx(10) and z[0]["criticality"] == 0.5 and len(z[0]["ring"]) == 5
    widths = [((r["ring"][0]["x"] - r["ring"][3]["x"]) ** 2 + (r["ring"][0]["y"] - r["ring"][3]["y"]) ** 2) ** 0.5 for r in z]
    assert widths == pytest.approx([24, 24])


def test_categories(spark):
    d = spark.createDataFrame([(2.9,), (3.0,), (92.0,), (5000.0,), (None,)], "epu double")
    got = [r[0] for r in d.select(layers.category(F.col("epu"), synth.NACP)).collect()]
    assert got == [11, 10, 8, 3, None] and synth.category([2.9, 3.0, 92.0, 5000.0], synth.NACP).tolist() == [11, 10, 8, 3]


def test_commands(spark, tmp_path, capsys):
    from waywarden.__main__ import main

    main(["scenes", str(tmp_path / "s"), "--seeds", "2"])
    main(["features", str(tmp_path / "s/points"), str(tmp_path / "f")])
    main(["verdicts", str(tmp_path / "f"), str(tmp_path / "v")])
    main(["replay", str(tmp_path / "v"), str(tmp_path / "r")])
    told = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines() if x.startswith("{")]
    assert told[0]["tracks"] == 12 and told[2]["rows"] == told[1]["rows"] and told[3]["n_frames"] > 100


def test_detectors_find_what_was_injected(spark):
    from waywarden.operators import detectors

    frames, events = [], []
    import pandas as pd

    for seed, mode in ((11, "jump"), (12, "freeze"), (13, "loss")):
        clean, _ = synth.scene(seed, assets=2, seconds=300.0, event=False)
        p, e = synth.inject(clean, "technical_error", float(clean.t.min() + 120), 60.0, [clean.track_id[0]], seed, {"mode": mode, "jump_m": 400.0})
        frames.append(p.assign(t_us=(p.t * 1e6).round().astype("int64")))
        events.append(e)
    points = spark.createDataFrame([tuple(None if v is None or v != v else v for v in r) for r in pd.concat(frames)[synth.COLUMNS].itertuples(index=False)], synth.POINTS)
    told = spark.createDataFrame([(e["event_id"], e["params_json"]) for e in events], "event_id string, params_json string")
    r = {x["label"]: x for x in detectors.synthetic_eval(detectors.signal(points), told).collect()}
    assert r["position_jump"]["recall"] > 0.9 and r["position_jump"]["precision"] > 0.9
    assert r["fix_loss"]["tp"] > 0 or r["fix_loss"]["true"] > 0


def test_splits_are_kept(spark, tmp_path):
    from waywarden.operators import models

    w = spark.createDataFrame([(f"ground_{i}", c) for i in range(30) for c in ("plausible", ("degraded", "technical_error")[i % 2])], "scene_id string, label_cause string")
    a = models.splits_for(spark, w, str(tmp_path / "s"))
    assert sorted(map(tuple, a.select("scene_id", "part").collect())) == sorted(map(tuple, models.splits_for(spark, w, str(tmp_path / "s")).select("scene_id", "part").collect()))
    models.check_splits(a, w, causes=("plausible", "degraded", "technical_error"))
    more = w.unionByName(spark.createDataFrame([("ground_99", "degraded")], w.schema))
    with pytest.raises(ValueError):
        models.splits_for(spark, more, str(tmp_path / "s"))
    with pytest.raises(ValueError):
        models.check_splits(a, more)

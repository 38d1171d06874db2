"""Models on synthetic scenes, from points to the card."""

import json

import pytest

from waywarden import params, registry
from waywarden.operators import models, scoring, synth
from waywarden.plans import batch


@pytest.fixture(scope="module")
def trained(spark):
    from waywarden.tables import written

    points = written(synth.scenes(spark, 42, assets=5, seconds=260.0), "scenes")
    rows = written(batch.labelled_windows(points), "labelled")
    parts = models.split_scenes(models.scene_strata(rows), ["stratum"], parts=(("train", 0.5), ("calib", 0.2), ("test", 0.3)))
    bundle = batch.train(rows, parts)
    return rows, bundle, batch.card(bundle)


def test_second_pass_has_fleet_features_from_scores_out_of_fold(trained):
    rows, bundle, _ = trained
    assert set(registry.FLEET) <= set(bundle.second.inputs) and not set(registry.FLEET) & set(bundle.first.inputs)
    assert bundle.baseline.count() > 0 and bundle.judged.filter("flt_n_others > 0").count() > 0
    # the score can only rise with inputs that are marked so
    for model in (bundle.first, bundle.second):
        assert all(w >= -1e-9 for n, w in model.weights[0].items() if n in registry.FEATURES and registry.FEATURES[n].monotone == 1)


def test_card(trained):
    _, bundle, card = trained
    print(json.dumps({k: v for k, v in card.items() if k not in ("inputs", "confusion")}))
    assert card["second"]["auroc"] > 0.9 and card["second"]["auprc"] > 0.8 and card["second"]["ece"] < 0.1
    assert card["second"]["auroc"] > card["naive"]["auroc"] and card["second"]["auprc"] > card["naive"]["auprc"]
    assert card["macro_f1"] > 0.3 and set(card["parts"]) == {"train", "calib", "test"}
    assert sum(card["confusion"].values()) == card["parts"]["test"] and 0.25 <= card["temperature"] <= 4.0
    assert all(k.split(" as ")[0] in params.CAUSES for k in card["confusion"])


def test_limits_are_fitted_on_clean_windows_of_other_days(spark):
    rows = [(float(d * 86_400 + i), 10.0, "plausible" if i % 2 else "degraded", False) for d in range(5) for i in range(10)]
    df = spark.createDataFrame(rows, "t_end double, tmp_n_points double, label_cause string, label_transition boolean")
    assert scoring.clean_windows(df).count() == 15 and scoring.before_last_days(df, "t_end", 4).count() == 10


def test_piecewise(spark):
    from pyspark.sql import functions as F

    steps = [(0.1, 0.0), (0.3, 0.2), (0.5, 0.2), (0.9, 1.0)]
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.2, 0.3, 0.4, 0.7, 0.9, 1.0, None)], "x double")
    got = [r[0] for r in df.select(models.piecewise(F.col("x"), steps)).collect()]
    assert got == pytest.approx([0.0, 0.0, 0.1, 0.2, 0.2, 0.6, 1.0, 1.0, None])
    assert df.select(models.piecewise(F.col("x"), [(0.5, 0.7)]).alias("y")).filter("x IS NOT NULL AND y <> 0.7").count() == 0

"""Points to verdicts: features, first-pass integrity, neighbours and alerts, second pass, causes, verdicts.

Every stage is a DataFrame; the only tables that gather anything but by track
are counts of cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waywarden import params, registry
from waywarden.operators import fleet, labels, places, scoring, verdict
from waywarden.operators.fixes import TRACK, fix_level
from waywarden.operators.models import Linear
from waywarden.operators.windows import window_level
from waywarden.params import APRON, Fleet, Timing
from waywarden.tables import written


@dataclass
class Bundle:
    """Models of a run. Without fitted ones, rules stand in: integrity falls with what the data violates."""

    first: Linear | None = None
    second: Linear | None = None
    causes: Linear | None = None
    thresholds: dict | None = None
    baseline: DataFrame | None = None
    judged: DataFrame | None = None

    def p_unsound(self, second: bool) -> Column:
        model = self.second if second else self.first
        if model:
            return model.probability()
        score = F.lit(1.0)
        for f in registry.SCORED:
            if registry.FEATURES[f].dimension in ("kinetic", "temporal"):
                score = score * (1 - F.col(f"v_{f}"))
        low = F.coalesce(F.col("sig_degraded_majority") == 1, F.lit(False))
        return F.greatest(1 - score, F.when(low, 0.7).otherwise(0.0))

    def probabilities(self) -> dict[str, Column]:
        if self.causes:
            return self.causes.probabilities()
        p = self.p_unsound(True)
        area = F.coalesce(F.col("flt_cell_flagged_loo") == 1, F.lit(False))
        low = F.coalesce(F.col("sig_degraded_majority") == 1, F.lit(False))
        share = {"possible_interference": F.when(area & low, 0.8).otherwise(0.1), "degraded": F.when(low & ~area, 0.8).otherwise(0.1)}
        rest = 1 - share["possible_interference"] - share["degraded"]
        out = {c: p * s for c, s in share.items()} | {"technical_error": p * rest * 0.6, "gnss_anomaly": p * rest * 0.3, "possible_spoofing": p * rest * 0.1}
        return out | {"plausible": (1 - p) * 0.9, "behavioral_anomaly": (1 - p) * 0.1}

    def contribution(self):
        return self.second.contribution if self.second else None


def features(points: DataFrame, timing: Timing = Timing(), layers: dict[str, DataFrame] | None = None, until_us: int | None = None) -> DataFrame:
    """Windows with all features that the layers allow; the others are null. With until_us silent tracks have windows up to then, see filled()."""
    fixes = fix_level(places.with_taxi(points, layers["zones"]) if layers else points, timing)
    out = window_level(fixes, timing, until_us)
    if layers:
        mapped = places.map_fixes(fixes, layers)
        out = out.join(places.map_windows(mapped, timing), [TRACK, "k"], "left")
    lacking = [f for f in (*registry.WINDOW, "aux_zone_name", "aux_zone_id", "aux_zone_type", "aux_zone_speed_limit_mps") if f not in out.columns]
    return out.withColumns({f: F.lit(None).cast("string" if f in ("aux_zone_name", "aux_zone_id", "aux_zone_type") else "double") for f in lacking})


def degraded(feats: DataFrame, bundle: Bundle) -> DataFrame:
    """(track_id, k, aux_lat, aux_lon, degraded[, area]) of windows: integrity of the first pass below 55, or most readings low."""
    v = scoring.violations(feats, bundle.thresholds)
    cols = [TRACK, "k", "aux_lat", "aux_lon"] + (["area"] if "area" in feats.columns else [])
    return v.select(*cols, flag_of(bundle.p_unsound(False)).alias("degraded"))


def fleet_tables(feats: DataFrame, bundle: Bundle, profile: Fleet = APRON, baseline: DataFrame | None = None, span: tuple[int, int] | None = None, before: DataFrame | None = None) -> dict[str, DataFrame]:
    """cells, features, parts, alerts and members of the fleet layer.

    For a stream: span has the first and last grid time to judge, feats may reach
    back further, and presence ahead; before has the parts of alerts that may go on.
    """
    w = degraded(feats, bundle)
    counts = fleet.cell_counts(fleet.presence(w, profile), profile, baseline)
    if span:
        counts = counts.filter(F.col("k").between(*span))
    parts = fleet.alert_parts(counts, profile, before, by_history=span is None)
    parts = parts if span else written(parts, "alertparts")
    alerts = fleet.shown_alerts(parts, counts)
    return {"cells": counts, "features": fleet.fleet_features(w, profile, baseline), "parts": parts, "alerts": alerts, "members": fleet.alert_members(w, alerts, profile)}


def verdicts(feats: DataFrame, bundle: Bundle = Bundle(), profile: Fleet = APRON, baseline: DataFrame | None = None, init: DataFrame | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The flat verdicts of windows."""
    t = tables or fleet_tables(feats, bundle, profile, baseline)
    f = feats.drop(*registry.FLEET).join(t["features"], [TRACK, "k"], "left").join(t["members"], [TRACK, "k"], "left")
    scored = scoring.violations(f, bundle.thresholds)
    p, probabilities = bundle.p_unsound(True), bundle.probabilities()
    held = scored.withColumns({"_p": p, **{f"_p_{c}": x for c, x in probabilities.items()}}).drop(*[f"v_{x}" for x in registry.SCORED])
    return verdict.assemble(held, F.col("_p"), {c: F.col(f"_p_{c}") for c in probabilities}, bundle.thresholds, bundle.contribution(), init)


def labelled_windows(points: DataFrame, timing: Timing = Timing(), layers: dict[str, DataFrame] | None = None) -> DataFrame:
    """Features of labelled points with the windows' labels, their scene, and the naive baseline's score."""
    of = points.groupBy(TRACK).agg(F.min("scene_id").alias("scene_id"))
    f = features(points, timing, layers).join(labels.window_labels(points, timing), [TRACK, "k"])
    return f.join(scoring.naive_score(points, timing), [TRACK, "k"]).join(of, TRACK)


def train(labelled: DataFrame, parts: DataFrame, scene: str = "scene_id", profile: Fleet = APRON) -> Bundle:
    """Models from labelled windows, by scene: two integrity passes, calibrated, and causes.

    The first pass scores each training scene by a model that never saw its
    fold; from these scores come the fleet features that the second pass is
    trained on, against the cells' rates of clean training traffic. The scenes
    for calibration are scored by the whole first model. Windows without
    positions (aux_lat) keep the fleet features they came with.
    """
    from waywarden.operators import models

    rows = labelled.filter("NOT label_transition").join(parts.select(scene, "part"), scene)
    rows = rows.withColumns({"unsound": (~F.col("label_cause").isin(*params.SOUND)).cast("double"), "cause_no": F.array_position(F.array(*map(F.lit, params.CAUSES)), F.col("label_cause")) - 1})
    train_, calib = rows.filter("part = 'train'"), rows.filter("part = 'calib'")
    has = lambda names: [n for n in names if n in rows.columns]
    inputs = has(registry.INPUTS_FIRST)
    first = models.fit_monotone(train_, inputs, "unsound")
    first.steps = models.fit_isotonic(calib, first.probability(), "unsound")
    baseline = None
    if "aux_lat" in rows.columns:
        seen = models.out_of_fold(train_, inputs, "unsound", scene).withColumn("_p", models.piecewise(F.col("p_oof"), first.steps))
        scored = seen.drop("p_oof").unionByName(rows.filter("part <> 'train'").withColumn("_p", first.probability()))
        scored = written(scored.drop(*registry.FLEET), "outoffold")
        flags = scored.select(TRACK, "k", "aux_lat", "aux_lon", F.col(scene).alias("area"), "part", "label_cause", (flag_of(F.col("_p"))).alias("degraded"))
        clean = flags.filter("part = 'train' AND label_cause = 'plausible'").drop("part", "label_cause")
        baseline = written(fleet.baseline_rates(clean, profile), "baseline")
        rows = written(scored.drop("_p").join(fleet.fleet_features(flags.drop("part", "label_cause"), profile, baseline), [TRACK, "k"], "left"), "second")
        train_, calib = rows.filter("part = 'train'"), rows.filter("part = 'calib'")
    second = models.fit_monotone(train_, has(registry.INPUTS_FIRST) + [f for f in registry.FLEET if f in rows.columns], "unsound")
    second.steps = models.fit_isotonic(calib, second.probability(), "unsound")
    causes = models.fit_causes(train_, [f for f in registry.INPUTS_CAUSE if f in rows.columns and f not in EMPTY], "cause_no", list(params.CAUSES))
    causes.temperature = models.fit_temperature(calib, causes, "cause_no")
    return Bundle(first, second, causes, baseline=baseline, judged=rows if baseline is not None else None)


#: Features that are withheld, so that no model learns from them.
EMPTY = ("kin_accel_imp_ratio_max",)


def flag_of(p: Column) -> Column:
    """Whether a window counts as degraded: integrity below the limit, or most readings low."""
    return (100 * (1 - p) < params.UNTRUSTED[1]) | F.coalesce(F.col("sig_degraded_majority") == 1, F.lit(False))


def card(bundle: Bundle, rows: DataFrame | None = None) -> dict:
    """What the models are worth on test scenes, beside the naive baseline; rows have part, unsound, cause_no and the features."""
    from waywarden.operators import models

    rows = bundle.judged if rows is None else rows
    test = rows.filter("part = 'test'").withColumns({"p1": bundle.first.probability(), "p2": bundle.second.probability(), "raw": 1 / (1 + F.exp(-bundle.second.logit())), **{f"_c_{c}": x for c, x in bundle.causes.probabilities().items()}})
    guess = verdict.most_likely(params.CAUSES, lambda c: F.col(f"_c_{c}"))
    test = written(test.withColumn("guess", guess).select("p1", "p2", "raw", "unsound", "guess", "label_cause", *(["baseline_score"] if "baseline_score" in rows.columns else [])), "judged")
    out = {"parts": {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}, "inputs": {"first": bundle.first.inputs, "second": bundle.second.inputs, "causes": bundle.causes.inputs}}
    for name, p in (("first", "p1"), ("second", "p2"), *([("naive", "baseline_score")] if "baseline_score" in test.columns else [])):
        m = evaluate(test, "unsound", p)
        out[name] = {"auroc": m["auroc"], "auprc": m["average_precision"], "ece": m["ece"]}
    out["ece_before_calibration"] = models.ece(test, "raw", "unsound").head()[0]
    out["macro_f1"] = models.macro_f1(test, "guess", "label_cause").head()[0]
    out["confusion"] = {f"{r['label_cause']} as {r['guess']}": r["count"] for r in test.groupBy("label_cause", "guess").count().collect()}
    out["temperature"] = bundle.causes.temperature
    return out


def evaluate(scored: DataFrame, label: str = "unsound", probability: str = "p") -> dict[str, float]:
    from waywarden.operators import models

    return {
        "auroc": models.auroc(scored, probability, label).head()[0],
        "average_precision": models.average_precision(scored, probability, label).head()[0],
        "ece": models.ece(scored, probability, label).head()[0],
    }

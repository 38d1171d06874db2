"""Verdicts: smoothed integrity and states, confidence, severity, cause, evidence, actions and the nested output."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywarden import params, registry
from waywarden.operators.scoring import dimension_scores, violations
from waywarden.operators.windows import TRACK

P = [f"p_{c}" for c in params.CAUSES]


def _in_time(track: str, order: str):
    return Window.partitionBy(track).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


# ---------------------------------------------------------------- states


def smooth(df: DataFrame, raw: str = "integrity_raw", out: str = "integrity", track: str = TRACK, order: str = "t_end", init: str | None = None) -> DataFrame:
    """df with the smoothed score: a fall counts 0.7, a rise 0.3. init names a column with the score before the first row.

    The average depends on its own last value, so a track folds in order, in
    batches as they come from its sorted partition: memory holds a batch and a
    score, whatever a track's length.
    """
    sorted_rows = df.repartition(track).sortWithinPartitions(track, order)

    def run(batches):
        last_track, last = None, None
        for b in batches:
            values = []
            start = b.column(init).to_pylist() if init else [None] * len(b)
            for t, r, i in zip(b.column(track).to_pylist(), b.column(raw).to_pylist(), start, strict=True):
                if t != last_track:
                    last_track, last = t, None if i is None or i != i else i
                if r is not None and r == r:
                    a = params.EMA_DOWN if last is not None and r < last else params.EMA_UP
                    last = r if last is None else a * r + (1 - a) * last
                values.append(last)
            yield b.append_column(out, pa.array(values, pa.float64()))

    # the other columns pass as the Arrow buffers they are
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return sorted_rows.mapInArrow(run, f"{schema}, `{out}` double")


def latch(value: Column, below: float, above: float, track: str, order: str, start: Column | None = None) -> Column:
    """A switch that goes on under `below`, off above `above`, and stays between: the last decision so far."""
    decision = F.when(value < below, True).when(value > above, False)
    held = F.last(decision, ignorenulls=True).over(_in_time(track, order))
    return F.coalesce(held, start if start is not None else F.lit(None).cast("boolean"), F.lit(False))


def trust_state(df: DataFrame, track: str = TRACK, order: str = "t_end", init: str | None = None) -> DataFrame:
    """df with trust_state: two latches over the smoothed score, so a window function and no fold."""
    before = F.first(F.col(init)).over(_in_time(track, order)) if init else F.lit(None).cast("string")
    low = latch(F.col("integrity"), *params.UNTRUSTED, track, order, before == "untrusted")
    mid = latch(F.col("integrity"), *params.CAUTION, track, order, before != "trusted")
    return df.withColumn("trust_state", F.when(low, "untrusted").when(mid, "caution").otherwise("trusted"))


def normality_state(df: DataFrame, track: str = TRACK, order: str = "t_end", init: str | None = None) -> DataFrame:
    before = F.first(F.col(init)).over(_in_time(track, order)) == "abnormal" if init else None
    return df.withColumn("normality_state", F.when(latch(F.col("normality"), *params.ABNORMAL, track, order, before), "abnormal").otherwise("expected"))


def quadrant(trust: Column, normal: Column) -> Column:
    return F.when(trust != "untrusted", F.when(normal == "expected", "trusted").otherwise("real_event")).otherwise(F.when(normal == "expected", "silent_risk").otherwise("data_fault"))


# ---------------------------------------------------------------- levels


def level(value: Column, levels, below: str) -> Column:
    """The name of the highest level reached, with the slack that sums of tenths need."""
    out = F.lit(below)
    for least, name in sorted(levels):
        out = F.when(value >= least - 1e-12, name).otherwise(out)
    return out


def confidence(n: Column, gap: Column, probabilities: list[Column]) -> Column:
    points = F.least(F.lit(1.0), F.greatest(F.lit(0.25), F.coalesce(n, F.lit(0.0)) / (2 * params.MIN_POINTS)))
    silence = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.25), 1 - (gap - 5) / 25)), F.lit(0.25))
    ranked = F.sort_array(F.array(*probabilities), asc=False)
    margin = F.when(ranked[0] - ranked[1] >= params.CAUSE_MARGIN - 1e-12, 1.0).otherwise(0.6)
    return F.least(points, silence) * margin


def severity(integrity: Column, normality: Column, criticality: Column) -> Column:
    score = F.greatest(1 - integrity / 100, 1 - normality / 100) * F.coalesce(criticality, F.lit(params.CRITICALITY["low"]))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def most_likely(causes: tuple[str, ...], probability) -> Column:
    """The cause with the largest probability, the first in the list on ties."""
    values = F.array(*[probability(c) for c in causes])
    return F.get(F.array(*map(F.lit, causes)), (F.array_position(values, F.array_max(values)) - 1).cast("int"))


def reported_cause(trust: Column, normal: Column) -> Column:
    p = lambda c: F.col(f"p_{c}")
    sound = F.when(normal == "abnormal", "behavioral_anomaly").otherwise("plausible")
    return F.when(trust == "trusted", sound).when(trust == "untrusted", most_likely(params.UNSOUND, p)).otherwise(most_likely(params.CAUSES, p))


def action_code(alert: Column, trust: Column, normal: Column, quad: Column, sev: Column) -> Column:
    serious, some = sev.isin("critical", "high"), sev.isin("critical", "high", "medium")
    return (
        F.when(alert.isNotNull() & (trust != "trusted"), "area_gnss_unreliable")
        .when((quad == "data_fault") & serious, "verify_radio")
        .when(quad == "data_fault", "verify_visual")
        .when((quad == "real_event") & serious, "act_now")
        .when((quad == "silent_risk") & some, "cross_check")
        .when((trust != "trusted") | (normal == "abnormal"), "monitor")
        .otherwise("none")
    )


def fill(template: str, fields: dict[str, Column]) -> Column:
    """A sentence with {field}, {field:.0f}, {field:.1f} or {field:.0%}; null where a field is."""
    import string

    parts = []
    for text, name, spec, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            value = fields[name]
            if spec and spec.endswith("%"):
                parts.append(F.concat(F.format_string(f"%{spec[:-1]}f", value.cast("double") * 100), F.lit("%")))
            else:
                parts.append(F.format_string(f"%{spec}", value.cast("double")) if spec else value.cast("string"))
            parts[-1] = F.when(value.isNotNull(), parts[-1])
    return F.concat(*parts)


def action_text(code: Column, columns: list[str]) -> Column:
    get = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in columns else F.lit(None).cast("string")
    fields = {
        "asset": F.coalesce(get("aux_callsign"), get("aux_asset_id"), F.lit("the asset")),
        "zone": F.coalesce(get("aux_zone_name"), F.lit("this area")),
        "asset_class": F.coalesce(get("aux_asset_class"), F.lit("vehicle")),
    }
    out = F.lit(None).cast("string")
    for c, template in params.ACTION_TEXT.items():
        out = F.when(code == c, fill(template, fields)).otherwise(out)
    return out


# ---------------------------------------------------------------- evidence


def sentences(features: list[str], columns: list[str], weight, thresholds: dict | None = None, most: int = params.MAX_EVIDENCE) -> Column:
    """The sentences of the `most` features of the largest weight above 0, registry order on ties; those that cannot be filled are left out.

    Features are ranked by weight and place alone; only what is kept is put into words.
    """
    kept, ranks = [], []
    for name in features:
        f = registry.FEATURES[name]
        if f.template and name in columns and all(x == "v" or x in columns for x in f.fields):
            full = F.col(name).isNotNull() if not f.fields else F.lit(True)
            for x in f.fields:
                full = full & F.col(name if x == "v" else x).isNotNull()
            w = weight(name)
            ranks.append(F.when((w > 0) & full, F.struct((-w).alias("w"), F.lit(len(kept)).alias("i"))))
            kept.append(f)
    if not kept:
        return F.array().cast("array<struct<feature:string,dimension:string,text:string,value:double,limit:double,unit:string>>")

    def limit(f) -> Column:
        out = F.lit(f.tau if f.scored else None).cast("double")
        for domain, pair in ((thresholds or {}).get(f.name) or {}).items():
            out = F.when(F.col("aux_domain") == domain, F.lit(float(pair[0]))).otherwise(out)
        return out

    def one(x: Column) -> Column:
        said = F.lit(None).cast("struct<feature:string,dimension:string,text:string,value:double,limit:double,unit:string>")
        for i, f in reversed(list(enumerate(kept))):
            text = fill(f.template, {"v": F.col(f.name)} | {y: F.col(y) for y in f.fields if y != "v"})
            parts = F.struct(F.lit(f.name).alias("feature"), F.lit(f.dimension).alias("dimension"), text.alias("text"), F.col(f.name).cast("double").alias("value"), limit(f).alias("limit"), F.lit(f.unit).alias("unit"))
            said = F.when(x["i"] == i, parts).otherwise(said)
        return said

    return F.transform(F.slice(F.array_sort(F.filter(F.array(*ranks), lambda x: x.isNotNull())), 1, most), one)


def evidence(df: DataFrame, contribution=None, thresholds: dict | None = None) -> DataFrame:
    """df (with states and violations) with up to three sentences: about the data where trust is reduced, about behaviour where it is abnormal."""
    behaviour = [f for f in registry.SCORED if registry.FEATURES[f].dimension in ("spatial", "contextual")]
    data = sentences(registry.INPUTS_SECOND, df.columns, contribution or (lambda f: F.col(f"v_{f}") if f in registry.SCORED else F.lit(0.0)), thresholds)
    normal = sentences(behaviour, df.columns, lambda f: F.col(f"v_{f}"), thresholds)
    reduced, abnormal = F.col("trust_state") != "trusted", F.col("normality_state") == "abnormal"
    most = params.MAX_EVIDENCE
    none = F.slice(data, 1, 0)
    out = F.concat(
        F.when(reduced, F.slice(data, 1, F.when(abnormal, most - 1).otherwise(most))).otherwise(none),
        F.when(abnormal, F.slice(normal, 1, F.when(reduced, 1).otherwise(most))).otherwise(none),
    )
    return df.withColumn("evidence", F.slice(out, 1, most))


# ---------------------------------------------------------------- assembly


def assemble(features: DataFrame, p_unsound: Column, probabilities: dict[str, Column], thresholds: dict | None = None, contribution=None, init: DataFrame | None = None) -> DataFrame:
    """One verdict for each row of features (keys track_id, t_end).

    p_unsound and probabilities come from a model, as expressions over the
    features. init (track_id, integrity, trust_state, normality_state) is the
    state before a track's first row, for a stream that goes on.
    """
    f = features
    if "area_alert_id" not in f.columns:
        f = f.withColumn("area_alert_id", F.lit(None).cast("string"))
    if init is not None:
        f = f.join(init.select(TRACK, F.col("integrity").alias("_i"), F.col("trust_state").alias("_t"), F.col("normality_state").alias("_n")), TRACK, "left")
    f = dimension_scores(violations(f, thresholds)).withColumn("integrity_raw", 100.0 * (1.0 - p_unsound)).withColumns({f"p_{c}": probabilities[c] for c in params.CAUSES})
    started = init is not None
    f = smooth(f, init="_i" if started else None)
    f = normality_state(trust_state(f, init="_t" if started else None), init="_n" if started else None)
    known = lambda c: F.col(c) if c in features.columns else F.lit(None).cast("double")
    trust, normal = F.col("trust_state"), F.col("normality_state")
    f = f.withColumns({
        "quadrant": quadrant(trust, normal),
        "confidence": confidence(known("tmp_n_points"), known("tmp_gap_max_s"), [F.col(p) for p in P]),
        "zone_criticality": F.coalesce(known("spa_zone_crit_max"), F.lit(params.CRITICALITY["low"])),
        "cause": reported_cause(trust, normal),
    })
    f = f.withColumns({"confidence_level": level(F.col("confidence"), params.CONFIDENCE_LEVELS, "low"), "severity_score": severity(F.col("integrity"), F.col("normality"), F.col("zone_criticality"))})
    f = f.withColumn("severity_level", level(F.col("severity_score"), params.SEVERITY_LEVELS, "none"))
    f = f.withColumn("action_code", action_code(F.col("area_alert_id"), trust, normal, F.col("quadrant"), F.col("severity_level")))
    f = evidence(f.withColumn("action_text", action_text(F.col("action_code"), f.columns)), contribution, thresholds)
    f = f.withColumn("evidence_json", F.to_json("evidence"))
    dims = [f"d_{d}" for d in registry.SCORED_DIMENSIONS]
    aux = [a for a in registry.AUX if a in f.columns]
    return f.select(
        TRACK, "t_end", "integrity_raw", "integrity", "normality", *dims, "trust_state", "normality_state", "quadrant", "confidence", "confidence_level", "cause", *P,
        "severity_score", "severity_level", "zone_criticality", "action_code", "action_text", "area_alert_id", "evidence", "evidence_json", *aux,
    )


def contract(verdicts: DataFrame) -> DataFrame:
    """(track_id, t, verdict): the nested output object."""
    has = lambda c: F.col(c) if c in verdicts.columns else F.lit(None).cast("string")
    score = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col(c)))
    asset = F.coalesce(has("aux_asset_id"), F.get(F.split(TRACK, ":"), F.lit(1)), F.col(TRACK))
    v = F.struct(
        F.col(TRACK),
        asset.alias("asset_id"),
        F.coalesce(has("aux_domain"), F.lit("vehicle")).alias("domain"),
        F.coalesce(has("aux_asset_class"), F.lit("other")).alias("asset_class"),
        F.nullif(F.trim(has("aux_callsign")), F.lit("")).alias("callsign"),
        F.col("t_end").alias("t"),
        F.struct(has("aux_lat").alias("lat"), has("aux_lon").alias("lon"), has("aux_alt_m").alias("alt_m"), has("aux_track_deg").alias("track_deg"), has("aux_gs_mps").alias("speed_mps")).alias("position"),
        *[score(c).alias(c) for c in ("integrity", "integrity_raw", "normality")],
        F.struct(*[score(f"d_{d}").alias(d) for d in registry.SCORED_DIMENSIONS]).alias("dimensions"),
        *[F.col(c) for c in ("trust_state", "normality_state", "quadrant", "confidence", "confidence_level", "cause")],
        F.map_from_arrays(F.array(*map(F.lit, params.CAUSES)), F.array(*P)).alias("cause_probs"),
        F.struct(F.col("severity_level").alias("level"), F.col("severity_score").alias("score"), has("aux_zone_id").alias("zone_id"), has("aux_zone_name").alias("zone_name"), F.col("zone_criticality")).alias("severity"),
        F.col("evidence"),
        F.struct(F.col("action_code").alias("code"), F.col("action_text").alias("text")).alias("action"),
        F.col("area_alert_id"),
    )
    return verdicts.select(TRACK, F.col("t_end").alias("t"), v.alias("verdict"))


def contract_errors(verdicts: DataFrame) -> DataFrame:
    """One row of counts of rows that the output's rules forbid: probabilities that do not sum to 1, a wrong quadrant, a cause against its state."""
    total = sum((F.col(p) for p in P[1:]), F.col(P[0]))
    trusted = F.col("trust_state") == "trusted"
    return verdicts.agg(
        F.count_if(F.abs(total - 1) > 1e-3).alias("probabilities"),
        F.count_if(F.col("quadrant") != quadrant(F.col("trust_state"), F.col("normality_state"))).alias("quadrants"),
        F.count_if((trusted & ~F.col("cause").isin(*params.SOUND)) | ((F.col("trust_state") == "untrusted") & F.col("cause").isin(*params.SOUND))).alias("causes"),
    )

"""Queries over scores, states and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from waywarden import params, registry
from waywarden.operators import scoring, verdict
from waywarden.plans.adaptor import PTS, points

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


# Scores made from the events, one a fix: enough to drive every rule.
MADE = {
    "t_end": "t",
    "integrity_raw": "CAST((seq * 7919) % 10007 AS DOUBLE) / 100",
    "normality": "CAST((seq * 104729) % 10009 AS DOUBLE) / 100",
    "tmp_n_points": "CAST(seq % 13 AS DOUBLE)",
    "tmp_gap_max_s": "CASE WHEN seq % 11 > 0 THEN CAST(seq % 47 AS DOUBLE) END",
    "spa_zone_crit_max": "CASE seq % 4 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) WHEN 2 THEN CAST(0.2 AS DOUBLE) END",
    "area_alert_id": "CASE WHEN seq % 29 = 0 THEN 'area_1' END",
    "aux_domain": "domain",
    "aux_asset_class": "asset_class",
    "aux_asset_id": "asset_id",
    "aux_callsign": "callsign",
    "aux_zone_name": "CASE WHEN seq % 3 > 0 THEN concat('Zone ', asset_class) END",
    "aux_speed_implied_mps": "gs_mps + 20",
    "aux_speed_reported_mps": "gs_mps",
    "kin_speed_resid_max": "gs_mps",
    "kin_accel_ratio_max": "gs_mps / CAST(16 AS DOUBLE)",
    "tmp_gap": "gs_mps",
    "tmp_frozen_frac": "CAST(seq % 10 AS DOUBLE) / 10",
    "spa_offzone_frac": "CASE WHEN seq % 6 > 0 THEN CAST(seq % 10 AS DOUBLE) / 10 END",
    "ctx_ground_alt_conflict": "CAST(seq % 8 AS DOUBLE) / 8",
    **{f"p_{c}": f"CAST((seq * {31 + 12 * i}) % {97 + i} AS DOUBLE) / 100" for i, c in enumerate(params.CAUSES)},
}
MADE_SQL = f"{PTS}, made AS (SELECT track_id, seq, {', '.join(f'{x} AS {c}' for c, x in MADE.items())} FROM pts)"


def made(spark, d):
    return points(spark, d).selectExpr("track_id", "seq", *[f"{x} AS {c}" for c, x in MADE.items()])


PRESENT = [f for f in registry.SCORED if f in MADE]


def limit_sql(f: str) -> str:
    x = registry.FEATURES[f]
    return f"coalesce(least(1, greatest(0, ({f} - {x.tau}) / {x.scale})), 0)"


@query("p999_threshold", f"WITH {MADE_SQL} SELECT aux_domain AS domain, 'kin_speed_resid_max' AS name, greatest(10, quantile_cont(kin_speed_resid_max, 0.999)) AS tau, CAST(20 AS DOUBLE) AS scale, count(*) AS n FROM made GROUP BY ALL UNION ALL SELECT aux_domain, 'tmp_gap_max_s', greatest(10, quantile_cont(tmp_gap_max_s, 0.999)), CAST(20 AS DOUBLE), count(tmp_gap_max_s) FROM made GROUP BY ALL")
def p999_threshold(spark, d):
    return scoring.fit_thresholds(made(spark, d), ["kin_speed_resid_max", "tmp_gap_max_s"]).select("domain", "name", "tau", "scale", "n")


@query("violations", f"WITH {MADE_SQL} SELECT track_id, seq, {', '.join(f'round({limit_sql(f)}, 6) AS v_{f}' for f in PRESENT)} FROM made")
def violations(spark, d):
    return scoring.violations(made(spark, d)).select("track_id", "seq", *[F.round(f"v_{f}", 6).alias(f"v_{f}") for f in PRESENT])


def dim_sql(d: str) -> str:
    return " * ".join(["100.0", *[f"(1 - {limit_sql(f)})" for f in PRESENT if registry.FEATURES[f].dimension == d]])


@query("dim_scores", f"WITH {MADE_SQL} SELECT track_id, seq, {', '.join(f'round({dim_sql(x)}, 6) AS d_{x}' for x in registry.SCORED_DIMENSIONS)}, round(least({dim_sql('spatial')}, {dim_sql('contextual')}), 6) AS normality FROM made")
def dim_scores(spark, d):
    out = scoring.dimension_scores(scoring.violations(made(spark, d).drop("normality")))
    return out.select("track_id", "seq", *[F.round(c, 6).alias(c) for c in (*[f"d_{x}" for x in registry.SCORED_DIMENSIONS], "normality")])


# the fold as a recursion over a track's rows
EMA = """o AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t_end) AS i FROM made),
ema AS (SELECT track_id, seq, i, integrity_raw AS s, CASE WHEN integrity_raw < 40 THEN 'untrusted' WHEN integrity_raw < 70 THEN 'caution' ELSE 'trusted' END AS st FROM o WHERE i = 1
 UNION ALL SELECT track_id, seq, i, s, CASE WHEN was = 'untrusted' AND s <= 55 THEN 'untrusted' WHEN was <> 'untrusted' AND s < 40 THEN 'untrusted' WHEN was IN ('untrusted', 'caution') THEN CASE WHEN s > 75 THEN 'trusted' ELSE 'caution' END WHEN s < 70 THEN 'caution' ELSE 'trusted' END
 FROM (SELECT o.track_id, o.seq, o.i, e.st AS was, CASE WHEN o.integrity_raw < e.s THEN 0.7 * o.integrity_raw + 0.3 * e.s ELSE 0.3 * o.integrity_raw + 0.7 * e.s END AS s FROM o JOIN ema e ON e.track_id = o.track_id AND o.i = e.i + 1))"""


@query("ema_state", f"WITH RECURSIVE {MADE_SQL}, {EMA} SELECT track_id, seq, round(s + 1.3e-8, 6) AS integrity, st AS trust_state FROM ema")
def ema_state(spark, d):
    return verdict.trust_state(verdict.smooth(made(spark, d).select("track_id", "seq", "t_end", "integrity_raw"))).select("track_id", "seq", F.round(F.col("integrity") + 1.3e-8, 6).alias("integrity"), "trust_state")


NORM = """n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t_end) AS i FROM made),
norm AS (SELECT track_id, seq, i, normality < 40 AS bad FROM n WHERE i = 1 UNION ALL SELECT n.track_id, n.seq, n.i, CASE WHEN m.bad THEN n.normality <= 55 ELSE n.normality < 40 END FROM n JOIN norm m ON m.track_id = n.track_id AND n.i = m.i + 1)"""


@query("normality_hysteresis", f"WITH RECURSIVE {MADE_SQL}, {NORM} SELECT track_id, seq, CASE WHEN bad THEN 'abnormal' ELSE 'expected' END AS normality_state FROM norm")
def normality_hysteresis(spark, d):
    return verdict.normality_state(made(spark, d)).select("track_id", "seq", "normality_state")


PC = ", ".join(f"p_{c}" for c in params.CAUSES)
TOP2 = f"list_sort([{PC}], 'DESC')"
CONF = f"least(least(1, greatest(0.25, tmp_n_points / 8)), coalesce(least(1, greatest(0.25, 1 - (tmp_gap_max_s - 5) / 25)), 0.25)) * CASE WHEN {TOP2}[1] - {TOP2}[2] >= 0.2 - 1e-12 THEN 1.0 ELSE 0.6 END"


@query("confidence", f"WITH {MADE_SQL}, c AS (SELECT track_id, seq, {CONF} AS c FROM made) SELECT track_id, seq, round(c, 6) AS confidence, CASE WHEN c >= 0.75 - 1e-12 THEN 'high' WHEN c >= 0.45 - 1e-12 THEN 'medium' ELSE 'low' END AS confidence_level FROM c")
def confidence(spark, d):
    c = verdict.confidence(F.col("tmp_n_points"), F.col("tmp_gap_max_s"), [F.col(p) for p in verdict.P])
    return made(spark, d).withColumn("c", c).select("track_id", "seq", F.round("c", 6).alias("confidence"), verdict.level(F.col("c"), params.CONFIDENCE_LEVELS, "low").alias("confidence_level"))


SEV = "least(1, greatest(0, greatest(1 - integrity_raw / 100, 1 - normality / 100) * coalesce(spa_zone_crit_max, 0.2)))"
LEVEL = "CASE WHEN s >= 0.6 - 1e-12 THEN 'critical' WHEN s >= 0.4 - 1e-12 THEN 'high' WHEN s >= 0.2 - 1e-12 THEN 'medium' WHEN s >= 0.05 - 1e-12 THEN 'low' ELSE 'none' END"


@query("severity", f"WITH {MADE_SQL}, c AS (SELECT track_id, seq, {SEV} AS s FROM made) SELECT track_id, seq, round(s, 6) AS severity_score, {LEVEL} AS severity_level FROM c")
def severity(spark, d):
    s = verdict.severity(F.col("integrity_raw"), F.col("normality"), F.col("spa_zone_crit_max"))
    return made(spark, d).withColumn("s", s).select("track_id", "seq", F.round("s", 6).alias("severity_score"), verdict.level(F.col("s"), params.SEVERITY_LEVELS, "none").alias("severity_level"))


# states by score alone, for the rules that take them as given
TRUST = "CASE WHEN integrity_raw < 40 THEN 'untrusted' WHEN integrity_raw < 70 THEN 'caution' ELSE 'trusted' END"
NORMAL = "CASE WHEN normality < 40 THEN 'abnormal' ELSE 'expected' END"
QUAD = "CASE WHEN trust <> 'untrusted' THEN CASE WHEN norm = 'expected' THEN 'trusted' ELSE 'real_event' END WHEN norm = 'expected' THEN 'silent_risk' ELSE 'data_fault' END"
GIVEN = f"{MADE_SQL}, st AS (SELECT *, {TRUST} AS trust, {NORMAL} AS norm, {SEV} AS s FROM made), qd AS (SELECT *, {QUAD} AS quadrant, {LEVEL} AS sev FROM st)"
ALL_C = ", ".join(f"'{c}'" for c in params.CAUSES)
BAD_C = ", ".join(f"'{c}'" for c in params.UNSOUND)
BAD_P = ", ".join(f"p_{c}" for c in params.UNSOUND)


def given(spark, d):
    out = made(spark, d).withColumns({"trust_state": F.expr(TRUST), "normality_state": F.expr(NORMAL), "s": verdict.severity(F.col("integrity_raw"), F.col("normality"), F.col("spa_zone_crit_max"))})
    return out.withColumns({"quadrant": verdict.quadrant(F.col("trust_state"), F.col("normality_state")), "severity_level": verdict.level(F.col("s"), params.SEVERITY_LEVELS, "none")})


@query("cause_argmax", f"WITH {GIVEN} SELECT track_id, seq, quadrant, CASE WHEN trust = 'trusted' THEN CASE WHEN norm = 'abnormal' THEN 'behavioral_anomaly' ELSE 'plausible' END WHEN trust = 'untrusted' THEN [{BAD_C}][list_position([{BAD_P}], list_max([{BAD_P}]))] ELSE [{ALL_C}][list_position([{PC}], list_max([{PC}]))] END AS cause FROM qd")
def cause_argmax(spark, d):
    return given(spark, d).select("track_id", "seq", "quadrant", verdict.reported_cause(F.col("trust_state"), F.col("normality_state")).alias("cause"))


CODE = """CASE WHEN area_alert_id IS NOT NULL AND trust <> 'trusted' THEN 'area_gnss_unreliable' WHEN quadrant = 'data_fault' AND sev IN ('critical', 'high') THEN 'verify_radio' WHEN quadrant = 'data_fault' THEN 'verify_visual'
 WHEN quadrant = 'real_event' AND sev IN ('critical', 'high') THEN 'act_now' WHEN quadrant = 'silent_risk' AND sev IN ('critical', 'high', 'medium') THEN 'cross_check' WHEN trust <> 'trusted' OR norm = 'abnormal' THEN 'monitor' ELSE 'none' END"""
TEXTS = " ".join("WHEN '{}' THEN {}".format(c, "replace(replace(replace('{}', '{{asset}}', coalesce(aux_callsign, aux_asset_id)), '{{zone}}', coalesce(aux_zone_name, 'this area')), '{{asset_class}}', aux_asset_class)".format(t)) for c, t in params.ACTION_TEXT.items())


@query("action_case", f"WITH {GIVEN}, a AS (SELECT *, {CODE} AS action_code FROM qd) SELECT track_id, seq, action_code, CASE action_code {TEXTS} END AS action_text FROM a")
def action_case(spark, d):
    g = given(spark, d)
    g = g.withColumn("action_code", verdict.action_code(F.col("area_alert_id"), F.col("trust_state"), F.col("normality_state"), F.col("quadrant"), F.col("severity_level")))
    return g.select("track_id", "seq", "action_code", verdict.action_text(F.col("action_code"), g.columns).alias("action_text"))


def half_up(x: str, digits: int) -> str:
    """A number in words as Spark writes it: halves go up."""
    return f"format('{{:.{digits}f}}', floor(({x}) * {10**digits} + 0.5) / {10.0**digits})"


# every feature with a sentence that the made columns can fill, in registry order, with how the sentence reads
READS = {
    "kin_speed_resid_max": f"'Position implies ' || {half_up('aux_speed_implied_mps', 0)} || ' m/s but the asset reports ' || {half_up('aux_speed_reported_mps', 0)} || ' m/s'",
    "kin_accel_ratio_max": f"'Acceleration is ' || {half_up('kin_accel_ratio_max', 1)} || 'x the maximum for a ' || aux_asset_class",
    "tmp_gap_max_s": f"'No position for ' || {half_up('tmp_gap_max_s', 0)} || ' s'",
    "tmp_frozen_frac": f"{half_up('tmp_frozen_frac * 100', 0)} || '% of positions are frozen while the asset reports movement'",
    "spa_offzone_frac": f"{half_up('spa_offzone_frac * 100', 0)} || '% of positions are off every movement area'",
    "ctx_ground_alt_conflict": f"'On-ground flag contradicts altitude or speed in ' || {half_up('ctx_ground_alt_conflict * 100', 0)} || '% of positions'",
}
ABOUT = {f: int(registry.FEATURES[f].dimension in ("spatial", "contextual")) for f in READS}
# two about the data and one about behaviour where both are in doubt, else three of the one kind
SAID = f"""{GIVEN}, v AS (SELECT *, {", ".join(f"{limit_sql(f)} AS v_{f}" for f in READS)} FROM qd),
e AS ({" UNION ALL ".join(f"SELECT track_id, seq, trust, norm, {ABOUT[f]} AS about, {i} AS i, '{f}' AS feature, {x} AS text, CAST({f} AS DOUBLE) AS value, CAST({registry.FEATURES[f].tau} AS DOUBLE) AS tau, '{registry.FEATURES[f].unit}' AS unit, v_{f} AS w FROM v WHERE v_{f} > 0 AND {x} IS NOT NULL" for i, (f, x) in enumerate(READS.items()))}),
r AS (SELECT *, row_number() OVER (PARTITION BY track_id, seq, about ORDER BY w DESC, i) AS rank FROM e),
said AS (SELECT *, row_number() OVER (PARTITION BY track_id, seq ORDER BY about, rank) AS place FROM r
 WHERE (about = 0 AND trust <> 'trusted' AND rank <= CASE WHEN norm = 'abnormal' THEN 2 ELSE 3 END) OR (about = 1 AND norm = 'abnormal' AND rank <= CASE WHEN trust <> 'trusted' THEN 1 ELSE 3 END))"""


def said(spark, d):
    return verdict.evidence(scoring.violations(given(spark, d)))


@query("evidence_topk", f"WITH {SAID} SELECT track_id, seq, coalesce(string_agg(feature, ',' ORDER BY place), '') AS features, count(feature) AS n FROM qd LEFT JOIN said USING (track_id, seq) GROUP BY ALL")
def evidence_topk(spark, d):
    return said(spark, d).select("track_id", "seq", F.array_join("evidence.feature", ",").alias("features"), F.size("evidence").cast("long").alias("n"))


@query("evidence_sentences", f"WITH {SAID} SELECT track_id, seq, CAST(place - 1 AS INTEGER) AS place, feature, text, value, tau, unit FROM said")
def evidence_sentences(spark, d):
    e = said(spark, d).select("track_id", "seq", F.posexplode("evidence").alias("place", "e"))
    return e.select("track_id", "seq", "place", "e.feature", "e.text", "e.value", F.col("e.limit").alias("tau"), "e.unit")


@query("verdicts", f"""WITH RECURSIVE {MADE_SQL}, {EMA}, {NORM},
st AS (SELECT made.*, ema.s AS integrity, ema.st AS trust, CASE WHEN norm.bad THEN 'abnormal' ELSE 'expected' END AS norm FROM made JOIN ema USING (track_id, seq) JOIN norm USING (track_id, seq)),
q AS (SELECT *, {QUAD} AS quadrant, least(1, greatest(0, greatest(1 - integrity / 100, 1 - normality / 100) * coalesce(spa_zone_crit_max, 0.2))) AS s FROM st), l AS (SELECT *, {LEVEL} AS sev FROM q)
SELECT quadrant, sev AS severity_level, {CODE} AS action_code, count(*) AS n, round(sum(integrity), 2) AS integrity_sum FROM l GROUP BY ALL""")
def verdicts(spark, d):
    v = made(spark, d)
    # the made normality stands in for the scored one
    v = verdict.trust_state(verdict.smooth(v.select("track_id", "seq", "t_end", "integrity_raw", "normality", "spa_zone_crit_max", "area_alert_id")))
    v = verdict.normality_state(v)
    v = v.withColumns({"quadrant": verdict.quadrant(F.col("trust_state"), F.col("normality_state")), "s": verdict.severity(F.col("integrity"), F.col("normality"), F.col("spa_zone_crit_max"))})
    v = v.withColumn("severity_level", verdict.level(F.col("s"), params.SEVERITY_LEVELS, "none"))
    v = v.withColumn("action_code", verdict.action_code(F.col("area_alert_id"), F.col("trust_state"), F.col("normality_state"), F.col("quadrant"), F.col("severity_level")))
    return v.groupBy("quadrant", "severity_level", "action_code").agg(F.count("*").alias("n"), F.round(F.sum("integrity"), 2).alias("integrity_sum"))


# the whole assembly: scores from the made features, states by recursion
ASM = f"""{MADE_SQL.replace("made AS (", "made0 AS (")}, made AS (SELECT * REPLACE (least({dim_sql("spatial")}, {dim_sql("contextual")}) AS normality), {", ".join(f"{dim_sql(x)} AS d_{x}" for x in registry.SCORED_DIMENSIONS)} FROM made0),
{EMA}, {NORM},
st AS (SELECT made.*, ema.s AS integrity, ema.st AS trust, CASE WHEN norm.bad THEN 'abnormal' ELSE 'expected' END AS norm FROM made JOIN ema USING (track_id, seq) JOIN norm USING (track_id, seq)),
q AS (SELECT *, {QUAD} AS quadrant, least(1, greatest(0, greatest(1 - integrity / 100, 1 - normality / 100) * coalesce(spa_zone_crit_max, 0.2))) AS s, {CONF} AS c FROM st),
l AS (SELECT *, {LEVEL} AS sev, CASE WHEN c >= 0.75 - 1e-12 THEN 'high' WHEN c >= 0.45 - 1e-12 THEN 'medium' ELSE 'low' END AS confidence_level,
 CASE WHEN trust = 'trusted' THEN CASE WHEN norm = 'abnormal' THEN 'behavioral_anomaly' ELSE 'plausible' END WHEN trust = 'untrusted' THEN [{BAD_C}][list_position([{BAD_P}], list_max([{BAD_P}]))] ELSE [{ALL_C}][list_position([{PC}], list_max([{PC}]))] END AS cause FROM q),
asm AS (SELECT *, {CODE} AS action_code FROM l)"""


def assembled(spark, d):
    m = made(spark, d)
    return verdict.assemble(m, 1 - F.col("integrity_raw") / 100, {c: F.col(f"p_{c}") for c in params.CAUSES})


@query("assembled_verdicts", f"""WITH RECURSIVE {ASM} SELECT track_id, t_end, round(integrity + 1.3e-8, 6) AS integrity, round(normality, 6) AS normality, {", ".join(f"round(d_{x}, 6) AS d_{x}" for x in registry.SCORED_DIMENSIONS)}, trust AS trust_state, norm AS normality_state, quadrant,
 round(c, 6) AS confidence, confidence_level, cause, round(s + 1.3e-8, 6) AS severity_score, sev AS severity_level, coalesce(spa_zone_crit_max, 0.2) AS zone_criticality, action_code, CASE action_code {TEXTS} END AS action_text, area_alert_id FROM asm""")
def assembled_verdicts(spark, d):
    six = ("normality", *[f"d_{x}" for x in registry.SCORED_DIMENSIONS], "confidence")
    fuzzy = [F.round(F.col(c) + 1.3e-8, 6).alias(c) for c in ("integrity", "severity_score")]
    return assembled(spark, d).select("track_id", "t_end", *fuzzy, *[F.round(c, 6).alias(c) for c in six], "trust_state", "normality_state", "quadrant", "confidence_level", "cause", "severity_level", "zone_criticality", "action_code", "action_text", "area_alert_id")


@query("contract_json", f"""WITH RECURSIVE {ASM} SELECT track_id, t_end AS t, aux_asset_id AS asset_id, aux_domain AS domain, aux_asset_class AS asset_class, nullif(trim(aux_callsign), '') AS callsign, round(least(100, greatest(0, integrity)) + 1.3e-8, 6) AS integrity, round(d_kinetic, 6) AS kinetic, quadrant, cause,
 p_degraded AS degraded, sev AS severity_level, aux_zone_name AS zone_name, action_code, area_alert_id FROM asm""")
def contract_json(spark, d):
    """Nested output objects as JSON, and back."""
    c = verdict.contract(assembled(spark, d))
    back = c.select(F.from_json(F.to_json("verdict"), c.schema["verdict"].dataType).alias("v"))
    return back.select(
        "v.track_id", "v.t", "v.asset_id", "v.domain", "v.asset_class", "v.callsign", F.round(F.col("v.integrity") + 1.3e-8, 6).alias("integrity"), F.round("v.dimensions.kinetic", 6).alias("kinetic"), "v.quadrant", "v.cause",
        F.col("v.cause_probs")["degraded"].alias("degraded"), F.col("v.severity.level").alias("severity_level"), F.col("v.severity.zone_name").alias("zone_name"), F.col("v.action.code").alias("action_code"), "v.area_alert_id",
    )


@query("contract_errors", f"WITH {PTS} SELECT CAST(0 AS BIGINT) AS quadrants, CAST(0 AS BIGINT) AS causes, count(*) AS verdicts FROM pts")
def contract_errors(spark, d):
    v = assembled(spark, d)
    return verdict.contract_errors(v).crossJoin(F.broadcast(v.agg(F.count("*").alias("verdicts")))).select("quadrants", "causes", "verdicts")


@query("json_params", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS mode FROM events")
def json_params(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.col("event_type").alias("mode"))


@query("crosstab_states", f"WITH {GIVEN} SELECT trust AS trust_state, count(*) FILTER (norm = 'abnormal') AS abnormal, count(*) FILTER (norm = 'expected') AS expected, round(count(*) FILTER (norm = 'abnormal') / count(*), 6) AS abnormal_share FROM qd GROUP BY ALL")
def crosstab_states(spark, d):
    out = given(spark, d).groupBy("trust_state").pivot("normality_state", ["abnormal", "expected"]).count()
    return out.withColumn("abnormal_share", F.round(F.col("abnormal") / (F.col("abnormal") + F.col("expected")), 6))


@query("class_weights", f"WITH {PTS}, c AS (SELECT asset_class, count(*) AS n FROM pts GROUP BY ALL) SELECT asset_class, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def class_weights(spark, d):
    from waywarden.operators import models

    return models.class_weights(points(spark, d), "asset_class").select("asset_class", "n", F.round("weight", 6).alias("weight"))

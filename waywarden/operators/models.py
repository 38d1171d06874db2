"""Training and judging models: splits, folds, monotone and multiclass fits, calibration, metrics."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywarden import params, registry

# ---------------------------------------------------------------- splits


def hashed(text: Column) -> Column:
    """The first 24 bits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def split_scenes(scenes: DataFrame, by: list[str], parts=params.SPLITS, seed: int = 42, scene: str = "scene_id") -> DataFrame:
    """scenes (one row each) with `part`: within each stratum, scenes in the order of a hash take the parts' shares.

    The hash is MD5, which any engine repeats. Each stratum starts at an offset of
    its own, so that small strata do not all give their first scene to one part.
    """
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col(scene)))
    w = Window.partitionBy(*by)
    shift = hashed(F.concat(F.lit(f"{seed}|"), F.concat_ws("|", *by))) / float(1 << 24)
    at = scenes.withColumn("_u", (F.row_number().over(w.orderBy(order, scene)) - 1 + shift) / F.count("*").over(w)).withColumn("_u", F.col("_u") - F.floor("_u"))
    part, edge = F.lit(parts[-1][0]), 1.0
    for name, share in reversed(parts[:-1]):
        edge = sum(s for n, s in parts[: [p for p, _ in parts].index(name) + 1])
        part = F.when(F.col("_u") < edge, name).otherwise(part)
    return at.withColumn("part", part).drop("_u")


def scene_strata(windows: DataFrame, scene: str = "scene_id") -> DataFrame:
    """(scene_id, stratum): the kind of a scene (its id up to the first underscore) and its rarest cause, by scenes that have it."""
    sc = windows.select(scene, "label_cause").distinct()
    rank = sc.groupBy("label_cause").agg(F.count("*").alias("_n"))
    kind = F.get(F.split(scene, "_"), F.lit(0))
    return sc.join(rank, "label_cause").groupBy(scene).agg(F.min(F.struct("_n", "label_cause")).alias("r")).select(scene, F.concat_ws("|", kind, "r.label_cause").alias("stratum"))


def splits_for(spark, windows: DataFrame, path: str, scene: str = "scene_id") -> DataFrame:
    """The split kept at path, or a new one written there; one that lacks scenes is an error and never made anew."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        kept = spark.read.parquet(path)
        lacking = windows.select(scene).distinct().join(kept, scene, "left_anti").limit(3).collect()
        if lacking:
            raise ValueError(f"the split at {path} lacks scenes, such as {lacking}; remove it on purpose to split anew")
        return kept
    made = split_scenes(scene_strata(windows, scene), ["stratum"], scene=scene)
    made.write.parquet(path)
    return spark.read.parquet(path)


def check_splits(split: DataFrame, known: DataFrame, scene: str = "scene_id", causes: tuple[str, ...] = ()) -> None:
    """Raises where a scene has two parts, known scenes and split ones differ, or a part lacks one of the causes."""
    if causes:
        have = known.join(split, scene).select("part", "label_cause").distinct().collect()
        parts = {r["part"] for r in have}
        without = [(p, c) for p in sorted(parts) for c in causes if (p, c) not in {(r["part"], r["label_cause"]) for r in have}]
        if without:
            raise ValueError(f"parts without a cause: {without}")
    twice = split.groupBy(scene).agg(F.count_distinct("part").alias("n")).filter("n > 1").limit(5).collect()
    lacking = known.select(scene).distinct().join(split, scene, "left_anti").limit(5).collect()
    extra = split.select(scene).distinct().join(known, scene, "left_anti").limit(5).collect()
    if twice or lacking or extra:
        raise ValueError(f"splits: in two parts {twice}, without part {lacking}, unknown {extra}")


def fold(scene: Column, folds: int = 5) -> Column:
    """The fold of a scene: all its rows share it."""
    return F.pmod(hashed(scene), F.lit(folds)).cast("int")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): n of all over (classes * n of the class)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # one row a class
    return n.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))


# ---------------------------------------------------------------- fits


@dataclass
class Linear:
    """Logits over imputed, scaled inputs; a missing input counts as its mean and raises its indicator."""

    inputs: list[str]
    labels: list[str]
    mean: dict[str, float]
    scale: dict[str, float]
    weights: list[dict[str, float]]
    bias: list[float]
    temperature: float = 1.0
    steps: list[tuple[float, float]] = field(default_factory=list)

    def value(self, name: str) -> Column:
        if name.startswith("missing:"):
            return F.col(name[8:]).isNull().cast("double")
        return (F.coalesce(F.col(name), F.lit(self.mean[name])) - self.mean[name]) / self.scale[name]

    def logit(self, k: int = 0) -> Column:
        out = F.lit(self.bias[k])
        for name, w in self.weights[k].items():
            if w:
                out = out + w * self.value(name)
        return out

    def contribution(self, name: str) -> Column:
        """What an input adds to the first logit against an average row."""
        return self.weights[0].get(name, 0.0) * self.value(name) + self.weights[0].get(f"missing:{name}", 0.0) * F.col(name).isNull().cast("double")

    def probability(self) -> Column:
        """Of the positive class, calibrated where steps are known."""
        p = 1 / (1 + F.exp(-self.logit()))
        return piecewise(p, self.steps) if self.steps else p

    def probabilities(self) -> dict[str, Column]:
        logits = [self.logit(k) / self.temperature for k in range(len(self.labels))]
        top = F.greatest(*logits)
        terms = [F.exp(x - top) for x in logits]
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        return {c: t / total for c, t in zip(self.labels, terms, strict=True)}


def piecewise(x: Column, steps: list[tuple[float, float]]) -> Column:
    """Linear between the steps' points, flat outside: a look-up in two lists, however many steps there are."""
    xs, ys = (F.array(*[F.lit(float(p[i])) for p in steps]) for i in (0, 1))
    n = len(steps)

    def at(v: Column) -> Column:
        k = F.size(F.filter(xs, lambda a: a < v))
        x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
        return F.when(v.isNull(), F.lit(None)).when(k == 0, F.lit(float(steps[0][1]))).when(k == n, F.lit(float(steps[-1][1]))).otherwise(y0 + (y1 - y0) * (v - x0) / (x1 - x0))

    return F.get(F.transform(F.array(x), at), 0)  # an array of one: x is evaluated once


def _prepare(df: DataFrame, inputs: list[str]):
    """Means, scales, and the names of what varies: an input or indicator that is the same in all rows has no weight."""
    registry.assert_no_leakage(inputs)
    row = df.agg(F.count("*").alias("n"), *[x for c in inputs for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"), F.count_if(F.col(c).isNull()).alias(f"n_{c}"))]).head()
    mean = {c: row[f"m_{c}"] or 0.0 for c in inputs}
    scale = {c: row[f"s_{c}"] or 1.0 for c in inputs}
    names = [*[c for c in inputs if row[f"s_{c}"]], *[f"missing:{c}" for c in inputs if 0 < row[f"n_{c}"] < row["n"]]]
    return mean, scale, names


def _matrix(df: DataFrame, model: Linear, names: list[str]) -> DataFrame:
    cols = {f"_x{i}": model.value(n) for i, n in enumerate(names)}
    return VectorAssembler(inputCols=list(cols), outputCol="_features").transform(df.withColumns(cols)).drop(*cols)


def fit_monotone(df: DataFrame, inputs: list[str], label: str, weight: str | None = None, ridge: float = 1e-3, iterations: int = 100) -> Linear:
    """A logistic fit whose weights have the signs that the registry's monotone column asks for.

    Bounds on coefficients stand in for monotone trees: the score can only rise
    with an input that is marked 1.
    """
    mean, scale, names = _prepare(df, inputs)
    model = Linear(inputs, [label], mean, scale, [{}], [0.0])
    sign = lambda n: registry.FEATURES[n].monotone if n in registry.FEATURES else 0
    low = [0.0 if sign(n) == 1 else -math.inf for n in names]
    high = [0.0 if sign(n) == -1 else math.inf for n in names]
    lr = LogisticRegression(featuresCol="_features", labelCol=label, regParam=ridge, maxIter=iterations, standardization=False, lowerBoundsOnCoefficients=DenseMatrix(1, len(names), low), upperBoundsOnCoefficients=DenseMatrix(1, len(names), high))
    if weight:
        lr = lr.setWeightCol(weight)
    fit = lr.fit(_matrix(df, model, names))
    model.weights, model.bias = [dict(zip(names, map(float, fit.coefficients.toArray()), strict=True))], [float(fit.intercept)]
    return model


def fit_causes(df: DataFrame, inputs: list[str], label: str, labels: list[str], ridge: float = 1e-3, iterations: int = 100) -> Linear:
    """A multinomial fit with balanced class weights; label holds the places of labels."""
    mean, scale, names = _prepare(df, inputs)
    model = Linear(inputs, labels, mean, scale, [{} for _ in labels], [0.0] * len(labels))
    weighted = df.join(class_weights(df, label).drop("n"), label)
    lr = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="weight", family="multinomial", regParam=ridge, maxIter=iterations, standardization=False)
    fit = lr.fit(_matrix(weighted, model, names))
    seen = fit.coefficientMatrix.toArray()
    for k in range(min(len(labels), len(seen))):
        model.weights[k], model.bias[k] = dict(zip(names, map(float, seen[k]), strict=True)), float(fit.interceptVector[k])
    for k in range(len(seen), len(labels)):
        model.bias[k] = -30.0
    return model


def fit_isotonic(df: DataFrame, probability: Column, label: str) -> list[tuple[float, float]]:
    """The steps of an isotonic fit, for Linear.steps."""
    fit = IsotonicRegression(featuresCol="_p", labelCol="_y").fit(df.select(probability.alias("_p"), F.col(label).cast("double").alias("_y")))
    return list(zip(map(float, fit.boundaries), map(float, fit.predictions), strict=True))


def fit_temperature(df: DataFrame, model: Linear, label: str, low: float = 0.25, high: float = 4.0, rounds: int = 4, grid: int = 9) -> float:
    """The temperature of least log loss: all of a grid in one aggregation, then a finer grid around the best."""
    logits = [F.col(f"_z{k}") for k in range(len(model.labels))]
    rows = df.select(F.col(label).cast("int").alias("_y"), *[model.logit(k).alias(f"_z{k}") for k in range(len(model.labels))])
    best = 1.0
    for _ in range(rounds):
        ts = [low * (high / low) ** (i / (grid - 1)) for i in range(grid)]

        def loss(t: float) -> Column:
            top = F.greatest(*logits)
            total = F.exp((logits[0] - top) / t)
            for z in logits[1:]:
                total = total + F.exp((z - top) / t)
            return F.avg(F.log(total) + top / t - F.get(F.array(*logits), F.col("_y")) / t)

        row = rows.agg(*[loss(t).alias(f"l{i}") for i, t in enumerate(ts)]).head()
        i = min(range(grid), key=lambda i: row[f"l{i}"])
        best, low, high = ts[i], ts[max(0, i - 1)], ts[min(grid - 1, i + 1)]
    return best


def out_of_fold(df: DataFrame, inputs: list[str], label: str, scene: str = "scene_id", folds: int = 5) -> DataFrame:
    """df with p_oof: each row scored by a model that saw none of its scene's fold."""
    rows = df.withColumn("_fold", fold(F.col(scene), folds))
    out = None
    for k in range(folds):
        model = fit_monotone(rows.filter(F.col("_fold") != k), inputs, label)
        part = rows.filter(F.col("_fold") == k).withColumn("p_oof", model.probability())
        out = part if out is None else out.unionByName(part)
    return out.drop("_fold")


# ---------------------------------------------------------------- metrics


RANGES = 1024


def _ranked(df: DataFrame, score: str, label: str) -> DataFrame:
    """Counts by score in [0, 1], with how many positives and rows rank at or above it; ties are one step.

    Running sums go in two levels: over the totals of RANGES ranges, and inside
    each range, so that no task holds all scores.
    """
    g = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    g = g.withColumn("range", F.least(F.lit(RANGES - 1), F.floor(F.col("s") * RANGES)))
    above = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = g.groupBy("range").agg(F.sum("pos").alias("p"), F.sum("n").alias("k"))
    totals = totals.select("range", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("pos0"), F.coalesce(F.sum("k").over(above), F.lit(0)).alias("n0"))
    w = Window.partitionBy("range").orderBy(F.desc("s"))
    return g.join(totals, "range").withColumns({"cum_pos": F.col("pos0") + F.sum("pos").over(w), "cum_n": F.col("n0") + F.sum("n").over(w)})


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the sum of precision times the step in recall, as the rank goes down."""
    r = _ranked(df, score, label)
    total = r.agg(F.sum("pos").alias("total"))
    return r.crossJoin(F.broadcast(total)).agg(F.sum(F.col("pos") / F.col("total") * F.col("cum_pos") / F.col("cum_n")).alias("average_precision"))


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the share of pairs in order, ties counting half."""
    r = _ranked(df, score, label)
    neg, above = F.col("n") - F.col("pos"), F.col("cum_pos") - F.col("pos")
    return r.agg((F.sum(neg * (above + F.col("pos") / 2)) / (F.sum("pos") * F.sum(neg))).alias("auroc"))


def ece(df: DataFrame, probability: str, label: str, bins: int = params.ECE_BINS) -> DataFrame:
    """One row: the mean gap between confidence and outcome over equal bins of probability, weighted by rows."""
    b = df.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(probability) * bins)).alias("bin")).agg(F.avg(probability).alias("p"), F.avg(F.col(label).cast("double")).alias("y"), F.count("*").alias("n"))
    return b.agg((F.sum(F.abs(F.col("p") - F.col("y")) * F.col("n")) / F.sum("n")).alias("ece"))


def macro_f1(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """One row: the mean over classes of F1."""
    c = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = c.select(F.col("a").alias("k"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("side")).unionByName(c.select(F.col("p").alias("k"), F.lit(0).cast("long").alias("hit"), F.col("n").alias("side")))
    f1 = sides.groupBy("k").agg((2 * F.sum("hit") / F.sum("side")).alias("f1"))
    return f1.agg(F.avg("f1").alias("macro_f1"))


def precision_recall(df: DataFrame, flag: str, truth: str, by: list[str]) -> DataFrame:
    f, t = F.col(flag), F.col(truth)
    g = df.groupBy(*by).agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"))
    return g.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})

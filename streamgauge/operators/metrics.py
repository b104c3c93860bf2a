"""Rare-event metrics, calibration, thresholds and cost, each an aggregation over score-sorted counts."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .ranking import ranked, running
from .relational import interpolate


def curve(df: DataFrame, y: str, p: str) -> DataFrame:
    """p, pos, n, tp, fp: positives and rows of each distinct score, positives and negatives at or above it."""
    by = df.groupBy(F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    return running(by, [F.desc("p")], {"tp": F.col("pos"), "fp": F.col("n") - F.col("pos")})


def average_precision(df: DataFrame, y: str, p: str) -> DataFrame:
    c = curve(df, y, p)
    return c.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("pr_auc"))


def roc_auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Share of pairs in order, ties half: from counts by score."""
    c = curve(df, y, p).withColumn("neg", F.col("n") - F.col("pos"))
    return c.agg((F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def recall_at_fpr(df: DataFrame, y: str, p: str, most: float) -> DataFrame:
    c = curve(df, y, p)
    totals = c.agg(F.sum("pos").alias("P"), F.sum(F.col("n") - F.col("pos")).alias("N")).first()
    ok = c.where(F.col("fp") / F.lit(totals.N) <= most)
    return ok.agg(F.coalesce(F.max("tp") / F.lit(totals.P), F.lit(0.0)).alias("recall"), F.max_by("p", F.struct("tp", "p")).alias("threshold"))


def precision_at_budget(df: DataFrame, y: str, p: str, seq: str, rate: float) -> DataFrame:
    """Precision and recall of the top round(rate n) rows by score, ties by position."""
    k = max(1, round(rate * df.count()))
    top = ranked(df.select(y, p, seq), [F.desc(p), seq], "_rank").where(F.col("_rank") <= k)
    positives = df.agg(F.sum(F.col(y).cast("long"))).first()[0]
    return top.agg(F.lit(k).cast("long").alias("k"), F.avg(F.col(y).cast("double")).alias("precision"), (F.sum(F.col(y).cast("long")) / F.lit(positives)).alias("recall"))


def confusion(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    hit = F.col(p) >= threshold
    return df.agg(F.count_if(hit & (F.col(y) == 1)).alias("tp"), F.count_if(hit & (F.col(y) == 0)).alias("fp"), F.count_if(~hit & (F.col(y) == 1)).alias("fn"), F.count_if(~hit & (F.col(y) == 0)).alias("tn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def operating_point(df: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    c = confusion(df, y, p, threshold)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    n = tp + fp + fn + tn
    return c.select(
        "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"),
        _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"), ((recall + specificity) / 2).alias("balanced_accuracy"), specificity.alias("specificity"),
        _ratio(tp + fp, n).alias("alert_rate"), (1 - specificity).alias("fpr"), (_ratio(fp, n) * 10_000).alias("fp_per_10k"), F.when(tp > 0, (tp + fp) / tp).otherwise(float("inf")).alias("alerts_per_hit"),
    )


def calibration_bins(df: DataFrame, y: str, p: str, seq: str, bins: int = 10) -> DataFrame:
    """Equal-frequency bins by score: n, mean score, rate. The first n % bins bins hold a row more."""
    b = ranked(df.select(y, p, seq), [p, seq], "_rank")
    n = b.agg(F.count(F.lit(1))).scalar()
    small, more = F.floor(n / bins), n % bins
    at = F.col("_rank") - 1
    late = F.when(small > 0, more + F.floor((at - more * (small + 1)) / small))
    b = b.withColumn("bin", (F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(late) + 1).cast("int"))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def calibration(df: DataFrame, y: str, p: str, seq: str, bins: int = 10, eps: float = 1e-7) -> DataFrame:
    """Brier score, log loss and expected calibration error."""
    q = F.greatest(F.least(F.col(p), F.lit(1 - eps)), F.lit(eps))
    one = df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"))
    ece = calibration_bins(df, y, p, seq, bins).agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    return one.withColumn("ece", ece.scalar())


def cost(df: DataFrame, y: str, predicted: Column, amount: str, fixed: float) -> DataFrame:
    """Cost (alerts at a fixed cost, missed positives at their amount), cost without alerts, savings."""
    each = F.when(predicted, F.lit(float(fixed))).when(F.col(y) == 1, F.col(amount)).otherwise(0.0)
    out = df.agg(F.sum(each).alias("cost"), F.sum(F.when(F.col(y) == 1, F.col(amount)).otherwise(0.0)).alias("base"))
    return out.withColumn("savings", _ratio(F.col("base") - F.col("cost"), F.col("base")))


def business(df: DataFrame, y: str, p: str, threshold: float, amount: str) -> DataFrame:
    hit, positive = F.col(p) >= threshold, F.col(y) == 1
    pick = lambda c: F.sum(F.when(c, F.col(amount)).otherwise(0.0))
    return df.agg(pick(hit & positive).alias("caught"), pick(~hit & positive).alias("missed"), pick(hit & ~positive).alias("friction"), F.count_if(hit).alias("alerts"))


def f1_threshold(df: DataFrame, y: str, p: str) -> DataFrame:
    """The score with the largest F1; the lowest of equal ones."""
    c = curve(df, y, p)
    total = c.agg(F.sum("pos")).scalar()
    c = c.withColumn("f1", 2 * F.col("tp") / (F.col("tp") + F.col("fp") + total))
    return c.agg(F.max("f1").alias("f1"), F.max_by("p", F.struct(F.round("f1", 12), (-F.col("p")).alias("m"))).alias("threshold"))


def cost_threshold(df: DataFrame, y: str, p: str, amount: str, fixed: float) -> DataFrame:
    """The score with the least cost; the lowest of equal ones."""
    by = df.groupBy(F.col(p).alias("p")).agg(F.sum(F.when(F.col(y) == 1, F.col(amount)).otherwise(0.0)).alias("a"), F.count(F.lit(1)).alias("n"))
    c = running(by, [F.desc("p")], {"alerts": F.col("n"), "caught": F.col("a")})
    c = c.select("p", (F.col("alerts") * fixed + by.agg(F.sum("a")).scalar() - F.col("caught")).alias("cost"))
    return c.agg(F.min("cost").alias("cost"), F.min_by("p", F.struct(F.round("cost", 6), "p")).alias("threshold"))


def candidates(df: DataFrame, p: str, points: int = 2000) -> DataFrame:
    """threshold: the distinct quantiles of the score on an even grid, linear between rows, and infinity. At most points + 1 rows."""
    r = ranked(df.select(p).where(F.col(p).isNotNull()), [p], "_rank").select(F.col(p).alias("v"), (F.col("_rank") - 1).alias("at"))
    n = r.agg(F.count(F.lit(1))).scalar()
    grid = df.sparkSession.range(points).select((F.col("id") * (n - 1) / F.lit(float(points - 1))).alias("place"))
    grid = grid.withColumns({"lo": F.floor("place"), "hi": F.ceil("place")})
    low, high = r.select(F.col("at").alias("lo"), F.col("v").alias("x")), r.select(F.col("at").alias("hi"), F.col("v").alias("z"))
    found = grid.join(low, "lo").join(high, "hi").select((F.col("x") + (F.col("z") - F.col("x")) * (F.col("place") - F.col("lo"))).alias("threshold"))
    return found.unionByName(df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"))).distinct()


def _at_candidates(df: DataFrame, y: str, p: str, amount: str | None, points: int) -> DataFrame:
    """threshold, tp, fp, caught: what lies at or above each candidate, by one ordered pass over scores and candidates."""
    value = F.when(F.col(y) == 1, F.col(amount).cast("double")).otherwise(0.0) if amount else F.lit(0.0)
    by = df.groupBy(F.col(p).cast("double").alias("v")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("a"))
    asked = candidates(df, p, points).select(F.col("threshold").alias("v"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("a"), F.lit(True).alias("asked"))
    both = by.withColumn("asked", F.lit(False)).unionByName(asked)
    c = running(both, [F.desc("v"), F.col("asked")], {"tp": F.col("pos"), "all": F.col("n"), "caught": F.col("a")})
    return c.where("asked").select(F.col("v").alias("threshold"), "tp", (F.col("all") - F.col("tp")).alias("fp"), "caught")


def policy_thresholds(df: DataFrame, y: str, p: str, seq: str, amount: str | None = None, fixed: float = 1.0, fprs: tuple[float, ...] = (0.001, 0.005), alerts: tuple[float, ...] = (0.005, 0.01), points: int = 2000) -> DataFrame:
    """name, threshold: the score of the largest F1 and of the least cost over the candidates (the lowest of equal ones), of the
    largest recall within each false-positive rate, and of the last of the top rate of rows."""
    named = lambda name, x: x.select(F.lit(name).alias("name"), F.col("threshold").cast("double").alias("threshold"))
    positives = df.agg(F.sum(F.col(y).cast("long"))).scalar()
    c = kept(_at_candidates(df, y, p, amount, points), "thresholds")
    f1 = F.round(F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("tp") + F.col("fp") + positives)).otherwise(0.0), 12)
    out = [named("f1_max", c.agg(F.max_by("threshold", F.struct(f1, -F.col("threshold"))).alias("threshold")))]
    for f in fprs:
        out.append(named(f"fpr_{f:g}", recall_at_fpr(df, y, p, f).select(F.coalesce("threshold", F.lit(float("inf"))).alias("threshold"))))
    n = df.count()
    if alerts and n:
        by = running(df.groupBy(F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n")), [F.desc("p")], {"cum": F.col("n")})
        cuts = by.agg(*[F.max(F.when(F.col("cum") >= max(1, round(a * n)), F.col("p"))).alias(f"a{i}") for i, a in enumerate(alerts)])
        out += [named(f"alert_{a:g}", cuts.select(F.col(f"a{i}").alias("threshold"))) for i, a in enumerate(alerts)]
    if amount:
        every = df.agg(F.sum(F.when(F.col(y) == 1, F.col(amount).cast("double")).otherwise(0.0))).scalar()
        cost = F.round((F.col("tp") + F.col("fp")) * fixed + every - F.col("caught"), 6)
        out.append(named(f"cost_ca{fixed:g}", c.agg(F.min_by("threshold", F.struct(cost, "threshold")).alias("threshold"))))
    return reduce(lambda a, b: a.unionByName(b), out)


def apply_platt(p: Column, slope: float, intercept: float, eps: float = 1e-7) -> Column:
    """The calibrated score: a logistic curve over the logit of the score."""
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return 1 / (1 + F.exp(-(slope * F.log(q / (1 - q)) + intercept)))


def apply_isotonic(p: Column, boundaries: list[float], values: list[float]) -> Column:
    """The calibrated score: linear between the fitted boundaries, constant beyond them, within [0, 1]."""
    return F.greatest(F.least(interpolate(p, boundaries, values), F.lit(1.0)), F.lit(0.0))


@dataclass
class Calibrator:
    """none, platt or isotonic; state is plain JSON."""

    method: str = "none"
    state: dict | None = None

    def fit(self, df: DataFrame, y: str, p: str) -> Calibrator:
        if self.method == "platt":
            slope, intercept = platt(df, y, p)
            self.state = {"slope": slope, "intercept": intercept}
        elif self.method == "isotonic":
            boundaries, values = isotonic(df, y, p)
            self.state = {"boundaries": boundaries, "values": values}
        elif self.method == "none":
            self.state = {}
        else:
            raise ValueError(f"no calibration {self.method!r}")
        return self

    def column(self, p: Column) -> Column:
        if self.state is None:
            raise RuntimeError("the calibrator is not fitted")
        if self.method == "platt":
            return apply_platt(p, **self.state)
        return apply_isotonic(p, **self.state) if self.method == "isotonic" else p

    def to_json(self) -> str:
        return json.dumps({"method": self.method, "state": self.state}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Calibrator:
        return cls(**json.loads(text))


def platt(df: DataFrame, y: str, p: str):
    """Logistic calibration on the logit of the score; returns the fitted pair (slope, intercept)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    q = F.greatest(F.least(F.col(p), F.lit(1 - 1e-7)), F.lit(1e-7))
    z = VectorAssembler(inputCols=["_z"], outputCol="_v").transform(df.withColumn("_z", F.log(q / (1 - q))).withColumn("_y", F.col(y).cast("double")))
    m = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=1e-9, maxIter=200, tol=1e-10).fit(z)
    return float(m.coefficients[0]), float(m.intercept)


def isotonic(df: DataFrame, y: str, p: str) -> tuple[list[float], list[float]]:
    """Isotonic calibration: the table to interpolate on."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    v = VectorAssembler(inputCols=[p], outputCol="_v").transform(df.withColumn("_y", F.col(y).cast("double")))
    m = IsotonicRegression(featuresCol="_v", labelCol="_y").fit(v)
    return list(m.boundaries), list(m.predictions)


def champion(candidates: list[dict]) -> dict:
    """The candidate with the largest pr_auc, then the least brier, with ``calibrator``: its method of the least log loss.

    Baselines named dummy are out. ``log_loss`` maps methods of calibration to losses; of equal ones the simpler is taken,
    and without any the scores stay as they are.
    """
    best = max((c for c in candidates if c["name"] != "dummy"), key=lambda c: (c["pr_auc"], -c["brier"]))
    losses = best.get("log_loss") or {"none": 0.0}
    return best | {"calibrator": min(losses, key=lambda m: (losses[m], ("none", "platt", "isotonic").index(m)))}

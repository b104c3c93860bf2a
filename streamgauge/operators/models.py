"""Models that score a table: the class prior, logistic regression and boosted trees, and what a score owes to each column."""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .metrics import average_precision
from .ranking import ranked

#: Values that a search draws from, by model.
SPACES: dict[str, dict[str, list]] = {
    "dummy": {},
    "logistic": {"regParam": [1e-4, 1e-3, 1e-2, 1e-1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "trees": {"maxDepth": [3, 4, 5, 6], "stepSize": [0.05, 0.1, 0.2], "subsamplingRate": [0.6, 0.8, 1.0], "minInstancesPerNode": [1, 5, 20]},
}


def search(name: str, n: int, seed: int = 42) -> list[dict[str, Any]]:
    """Up to n different settings of a model, the defaults first, in a seeded order."""
    space, found, rng = SPACES[name], [{}], random.Random(seed)
    size = 1
    for v in space.values():
        size *= len(v)
    while len(found) < min(n, size if space else 1):
        one = {k: rng.choice(v) for k, v in space.items()}
        if one not in found:
            found.append(one)
    return found[:n]


@dataclass
class Model:
    """dummy, logistic or trees; ``fit`` on a table with features, label and, if named, a weight."""

    name: str
    params: dict[str, Any] = field(default_factory=dict)
    seed: int = 42
    rounds: int = 100
    fitted: Any = None
    features: tuple[str, ...] = ()

    def _vector(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        clean = df.withColumns({f"_f{i}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for i, c in enumerate(self.features)})
        return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(self.features))], outputCol="_v").transform(clean).drop(*[f"_f{i}" for i in range(len(self.features))])

    def fit(self, df: DataFrame, features: list[str], y: str, weight: str | None = None, validation: str | None = None) -> Model:
        """``validation``: a boolean column; boosting stops when the rows for which it holds gain no more."""
        self.features = tuple(features)
        rows = df.withColumn("_y", F.col(y).cast("double"))
        if self.name == "dummy":
            w = F.col(weight) if weight else F.lit(1.0)
            self.fitted = float(rows.agg(F.sum(w * F.col("_y")) / F.sum(w)).first()[0])
            return self
        from pyspark.ml.classification import GBTClassifier, LogisticRegression

        more = {"weightCol": weight} if weight else {}
        if self.name == "logistic":
            made = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=200, **self.params, **more)
        elif self.name == "trees":
            more |= {"validationIndicatorCol": validation} if validation else {}
            made = GBTClassifier(featuresCol="_v", labelCol="_y", maxIter=self.rounds, seed=self.seed, **self.params, **more)
        else:
            raise KeyError(f"no model {self.name!r}; known: {sorted(SPACES)}")
        self.fitted = made.fit(self._vector(rows))
        return self

    def score(self, df: DataFrame, output: str = "p") -> DataFrame:
        """``df`` with the probability of the positive class."""
        if self.fitted is None:
            raise RuntimeError("the model is not fitted")
        if self.name == "dummy":
            return df.withColumn(output, F.lit(self.fitted))
        from pyspark.ml.functions import vector_to_array

        out = self.fitted.transform(self._vector(df))
        return out.withColumn(output, vector_to_array("probability")[1]).drop("_v", "rawPrediction", "probability", "prediction")

    def importance(self) -> list[tuple[str, float]]:
        """Features with gain (trees) or the size of their coefficient, largest first."""
        if self.name == "dummy":
            return []
        values = self.fitted.featureImportances.toArray() if self.name == "trees" else abs(self.fitted.coefficients.toArray())
        return sorted(zip(self.features, values.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def permuted(df: DataFrame, c: str, seq: str, seed: int = 42) -> DataFrame:
    """``df`` with the values of one column dealt anew among the rows, by a seeded order."""
    rows = ranked(df, [seq], "_place")
    values = ranked(df.select(seq, F.col(c).alias("_value")).withColumn("_h", F.xxhash64(F.col(seq), F.lit(seed))), ["_h", seq], "_place").select("_place", "_value")
    return rows.join(values, "_place").withColumn(c, F.col("_value")).select(*df.columns)


def permutation_importance(df: DataFrame, score, columns: list[str], y: str, seq: str, seed: int = 42) -> DataFrame:
    """feature, drop: how much average precision falls when the values of a column are dealt anew. ``score``: df -> df with p."""
    rows = kept(df, "importance")
    base = average_precision(score(rows), y, "p").first()[0]
    found = [(c, float(base - average_precision(score(permuted(rows, c, seq, seed)), y, "p").first()[0])) for c in columns]
    return df.sparkSession.createDataFrame(found, "feature string, drop double")


def out_of_fold(df: DataFrame, make, features: list[str], y: str, forward: bool, keep: tuple[str, ...]) -> DataFrame:
    """keep, y, fold, p: each row of a validation fold scored by a model that was trained without it.

    ``forward``: trained on the folds before (0 is trained on only), else on all others.
    """
    out = None
    for k in sorted(r[0] for r in df.where("fold > 0").select("fold").distinct().collect()):
        train = df.where(F.col("fold") < k) if forward else df.where(F.col("fold") != k)
        part = make().fit(train, features, y).score(df.where(F.col("fold") == k)).select(*keep, y, "fold", "p")
        out = part if out is None else out.unionByName(part)
    return out

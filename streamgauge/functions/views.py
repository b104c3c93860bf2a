"""Model views of a feature table: trees take it as it is, linear models get medians, moments and one-hot columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import medians
from .steps import MISSING, RARE, UNSEEN, value_counts


@dataclass
class ModelView:
    kind: str  # tree or linear
    min_count: int = 50
    state: dict[str, Any] = field(default_factory=dict)

    def fit(self, df: DataFrame, keep: tuple[str, ...] = ()) -> ModelView:
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in keep]
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in keep]
        counts = value_counts(df, text)
        if large := [c for c, v in counts.items() if isinstance(v, str)]:
            raise ValueError(f"too many values for a view, encode them first: {large}")
        self.state = {"categorical": {c: [MISSING, UNSEEN, *(v for v, _ in vs if v not in (MISSING, UNSEEN))] for c, vs in counts.items()}, "numeric": numeric, "keep": list(keep)}
        if self.kind == "linear":
            r = df.agg(*[f(c).alias(f"{c}|{n}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if numeric else {}
            self.state["medians"] = {c: v or 0.0 for c, v in medians(df, numeric).items()}
            self.state["moments"] = {c: [float(r[f"{c}|m"] or 0.0), float(r[f"{c}|s"] or 0.0) or 1.0] for c in numeric}
            self.state["onehot"] = {c: [v for v, n in vs if n >= self.min_count] for c, vs in counts.items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        s = self.state
        if self.kind == "tree":
            codes = [F.coalesce(F.array_position(F.array(*map(F.lit, known)), F.coalesce(F.col(c), F.lit(MISSING))).cast("int") - 1, F.lit(1)) for c, known in s["categorical"].items()]
            codes = [F.when(x < 0, 1).otherwise(x).alias(c) for x, c in zip(codes, s["categorical"], strict=True)]
            return df.select(*s["keep"], *[F.col(c).cast("float") for c in s["numeric"]], *codes)
        out = [((F.coalesce(F.col(c).cast("double"), F.lit(s["medians"][c])) - s["moments"][c][0]) / s["moments"][c][1]).cast("float").alias(c) for c in s["numeric"]]
        for c, kept in s["onehot"].items():
            value = F.coalesce(F.col(c), F.lit(MISSING))
            out += [(value == v).cast("byte").alias(f"{c}={v}") for v in kept]
            out.append((~value.isin(kept) if kept else F.lit(True)).cast("byte").alias(f"{c}={RARE}"))
        return df.select(*s["keep"], *out)


    def to_json(self) -> str:
        return json.dumps({"kind": self.kind, "min_count": self.min_count, "state": self.state}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> ModelView:
        return cls(**json.loads(text))


def gini_ranking(df: DataFrame, features: list[str], y: str, k: int, trees: int = 100, seed: int = 42) -> list[tuple[str, float]]:
    """The k features of most importance in a random forest, equal ones by name."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="keep").transform(df.withColumn("_y", F.col(y).cast("double")))
    m = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, seed=seed).fit(v)
    return sorted(zip(features, m.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:k]


@dataclass
class GiniSelector:
    """Keeps the k features of most importance; fitted state is plain JSON."""

    k: int
    trees: int = 100
    seed: int = 42
    state: dict[str, Any] | None = None

    def fit(self, df: DataFrame, features: list[str], y: str) -> GiniSelector:
        self.state = {"ranking": gini_ranking(df, features, y, len(features), self.trees, self.seed)}
        return self

    @property
    def selected(self) -> list[str]:
        if self.state is None:
            raise RuntimeError("the selector is not fitted")
        return [n for n, _ in self.state["ranking"][: self.k]]

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        return df.select(*keep, *self.selected)

    def to_json(self) -> str:
        return json.dumps({"k": self.k, "trees": self.trees, "seed": self.seed, "state": self.state}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> GiniSelector:
        return cls(**json.loads(text))

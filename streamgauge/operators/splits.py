"""Leakage-safe splits and folds by cut values of the order key; stratified counts; exact-size samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked, running


def cut_values(df: DataFrame, t: str, fractions: list[float]) -> list:
    """The order key at position round(f n) - 1 of the sorted rows, for each fraction, from counts by value. Raises on null keys."""
    by = df.groupBy(t).agg(F.count(F.lit(1)).alias("c"))
    n, nulls = by.agg(F.sum("c"), F.coalesce(F.sum(F.when(F.col(t).isNull(), F.col("c"))), F.lit(0))).first()
    if not n:
        raise ValueError("no rows to cut")
    if nulls:
        raise ValueError(f"{nulls} rows without an order key {t}")
    cum = running(by, [t], {"cum": F.col("c")})
    need = [min(max(round(f * n) - 1, 0), n - 1) + 1 for f in fractions]
    row = cum.agg(*[F.min(F.when(F.col("cum") >= k, F.col(t))).alias(f"c{i}") for i, k in enumerate(need)]).first()
    return list(row)


def part_of(t: Column, cuts: list, names: list[str], gap=0) -> Column:
    """The part of a row: half-open intervals between cuts; rows within ``gap`` after a cut belong to none (null)."""
    out = F.when(t <= cuts[0], names[0])
    for i, name in enumerate(names[1:]):
        inside = t > cuts[i] + gap if gap else t > cuts[i]
        out = out.when(inside & (t <= cuts[i + 1]) if i + 1 < len(cuts) else inside, name)
    return out


def temporal_split(df: DataFrame, t: str, fractions: tuple[float, ...] = (0.7, 0.15, 0.15), names: tuple[str, ...] = ("train", "validation", "holdout"), gap=0) -> DataFrame:
    """``df`` with ``part``. Rows of one t are never split. Raises where a part is empty, or the fractions are no split."""
    if len(fractions) != len(names) or abs(sum(fractions) - 1) > 1e-9 or min(fractions) <= 0:
        raise ValueError(f"fractions {fractions} do not split into {names}")
    cum, total = [], 0.0
    for f in fractions[:-1]:
        total += f
        cum.append(round(total, 12))
    out = df.withColumn("part", part_of(F.col(t), cut_values(df, t, cum), list(names), gap))
    found = {r.part for r in out.select("part").distinct().collect()}
    if empty := [n for n in names if n not in found]:
        raise ValueError(f"empty parts: {empty}")
    return out


def forward_folds(df: DataFrame, t: str, n: int = 3, least: float = 0.4) -> DataFrame:
    """``df`` with ``fold``: 0 for rows only trained on, k for the validation slice of fold k, trained on all before it."""
    cuts = cut_values(df, t, [least + (1 - least) * i / n for i in range(n + 1)])
    fold = F.when(F.col(t) <= cuts[0], 0)
    for i in range(1, n + 1):
        fold = fold.when(F.col(t) <= cuts[i], i)
    return df.withColumn("fold", fold)


def summary(df: DataFrame, t: str, y: str) -> DataFrame:
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy())
    return df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / total, 4).alias("fraction"), F.sum(F.col(y).cast("long")).alias("positives"), F.round(F.avg(F.col(y).cast("double")), 6).alias("prevalence"), F.min(t).alias("t_min"), F.max(t).alias("t_max"))


def hashed(seq: str, seed: int) -> Column:
    return F.xxhash64(F.col(seq), F.lit(seed))


def _within_class(df: DataFrame, y: str, seq: str, seed: int) -> DataFrame:
    """``df`` with ``_rank``, the place in hash order within the class, and ``_size``, the rows of the class."""
    out = ranked(df.withColumn("_h", hashed(seq, seed)), ["_h", seq], "_rank", (y,)).drop("_h")
    sizes = df.groupBy(F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_size"))
    return out.join(F.broadcast(sizes), F.col(y).eqNullSafe(F.col("_y"))).drop("_y")  # a row a class


def stratified(df: DataFrame, y: str, seq: str, test: float = 0.3, seed: int = 42) -> DataFrame:
    """``df`` with ``part``: of each class round(test n) rows, by hash order, are test."""
    out = _within_class(df, y, seq, seed)
    return out.withColumn("part", F.when(F.col("_rank") <= F.bround(F.col("_size") * test, 0), "test").otherwise("train")).drop("_rank", "_size")


def stratified_folds(df: DataFrame, y: str, seq: str, n: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` from 1 to n: classes are dealt in hash order."""
    return _within_class(df, y, seq, seed).withColumn("fold", (F.pmod(F.col("_rank") - 1, F.lit(n)) + 1).cast("int")).drop("_rank", "_size")


def under_sample(df: DataFrame, y: str, seq: str, ratio: float = 1.0, seed: int = 42, role: str = "train") -> DataFrame:
    """All positives and round(n_pos / ratio) negatives, by hash order. Only training rows may be sampled."""
    if role != "train":
        raise ValueError("only a training fold may be resampled")
    n = df.agg(F.sum(F.col(y).cast("long"))).first()[0] or 0
    least = ranked(df.where(f"{y} = 0").withColumn("_h", hashed(seq, seed)), ["_h", seq], "_rn").where(F.col("_rn") <= round(n / ratio)).drop("_h", "_rn")
    return df.where(f"{y} = 1").unionByName(least)


def over_sample(df: DataFrame, y: str, seq: str, ratio: float = 1.0, seed: int = 42, role: str = "train") -> DataFrame:
    """All rows, and positives again until there are round(ratio n_neg) of them: copies are dealt as evenly as can be."""
    if role != "train":
        raise ValueError("only a training fold may be resampled")
    r = df.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
    more = max(round(ratio * r[1]) - r[0], 0)
    pos = ranked(df.where(f"{y} = 1").withColumn("_h", hashed(seq, seed)), ["_h", seq], "_rn").drop("_h")
    times = F.lit(more // max(r[0], 1)) + (F.col("_rn") <= more % max(r[0], 1)).cast("int")
    extra = pos.withColumn("_c", times).where("_c > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_rn", "_c")
    return df.unionByName(extra)


def example_weights(amount: Column, fixed: float, floor: float) -> Column:
    return F.greatest(amount, F.lit(floor)) / fixed


def class_weights(df: DataFrame, y: str) -> dict[int, float]:
    """n / (2 n_c) of each class."""
    counts = {r[0]: r[1] for r in df.groupBy(y).count().collect()}
    n = sum(counts.values())
    return {c: n / (2 * k) for c, k in counts.items()}


def sample_weights(df: DataFrame, weight: Column, name: str = "weight") -> DataFrame:
    """``df`` with a weight a row, scaled to a mean of 1."""
    raw = df.withColumn(name, weight.cast("double"))
    return raw.withColumn(name, F.col(name) / raw.agg(F.avg(name)).scalar())


def check_parts(df: DataFrame, seq: str) -> dict[str, int]:
    """Rows, distinct positions and rows without a part: equal counts mean that parts are disjoint and cover."""
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(seq).alias("distinct"), F.count_if(F.col("part").isNull()).alias("none")).first()
    return r.asDict()


def violations(df: DataFrame, seq: str, t: str | None, names: tuple[str, ...], gap=0, y: str | None = None, tolerance: float = 0.05) -> list[str]:
    """What is wrong with a split, as text: overlaps, empty parts, order, gap, missing rows of a slice, class shares.

    ``t``: the parts are slices of it. Without, the share of ``y`` in each part must be near that of all rows.
    """
    placed = df.where("part is not null")
    checks = [F.count(F.lit(1)).alias("n")] + ([F.min(t).alias("least"), F.max(t).alias("most")] if t else []) + ([F.avg(F.col(y).cast("double")).alias("rate")] if y else [])
    by = {r["part"]: r for r in placed.groupBy("part").agg(*checks).collect()}  # a row a part
    out = [f"part {n} empty" for n in names if n not in by]
    if placed.groupBy(seq).agg(F.count_distinct("part").alias("k"), F.count(F.lit(1)).alias("n")).where("k > 1 or n > 1").take(1):
        out.append("parts overlap")
    present = [n for n in names if n in by]
    if t:
        for a, b in zip(present, present[1:], strict=False):
            if not by[a].most < by[b].least:
                out.append(f"order violated between {a} and {b}")
            elif gap and by[b].least - by[a].most < gap:
                out.append(f"gap violated between {a} and {b}")
        if present:
            inside = df.agg(*[F.count_if((F.col(t) >= by[n].least) & (F.col(t) <= by[n].most)).alias(n) for n in present]).first()
            out += [f"part {n} is not its whole slice" for n in present if inside[n] != by[n].n]
    elif y:
        every = df.agg(F.avg(F.col(y).cast("double"))).first()[0]
        out += [f"part {n}: rate {by[n].rate:.5f} is far from {every:.5f}" for n in present if abs(by[n].rate - every) > tolerance * every + 1e-6]
    return out


def fold_violations(df: DataFrame, seq: str) -> int:
    """Rows that lie in several validation folds (``fold`` from 1; 0 is no fold)."""
    return df.where("fold > 0").groupBy(seq).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count()


def check_natural(part: DataFrame, whole: DataFrame, name: str, y: str) -> DataFrame:
    """One row: part, rows, positives, prevalence. Raises where the part isn't the untouched slice ``whole``."""
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(y).cast("long")), F.lit(0)).alias("p")).first()
    a, b = count(part), count(whole)
    if (a.n, a.p) != (b.n, b.p):
        raise RuntimeError(f"{name}: {a.n} rows with {a.p} positives, its slice has {b.n} with {b.p}")
    return part.sparkSession.createDataFrame([(name, a.n, a.p, round(a.p / a.n, 6) if a.n else None)], "part string, n long, positives long, prevalence double")


def rows_of(df: DataFrame, members: DataFrame, seq: str, part: str | None = None) -> DataFrame:
    """The rows whose position is in a membership table (``seq`` and ``part``), with their part; or those of one part only."""
    own = members.select(seq, "part") if part is None else members.where(F.col("part") == part).select(seq, "part")
    return df.drop("part").join(own, seq)


class SealedHoldout:
    """A table that can be opened once, after a choice was locked."""

    def __init__(self, df: DataFrame):
        self._df, self._locked, self._opened = df, False, False

    def lock(self) -> None:
        self._locked = True

    def open(self) -> DataFrame:
        if not self._locked:
            raise PermissionError("lock a choice first")
        if self._opened:
            raise PermissionError("the hold-out was opened before")
        self._opened = True
        return self._df

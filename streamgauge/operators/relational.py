"""Joins with checks, existence flags, keep-first dedup, key overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assert_unique(df: DataFrame, key: list[str], side: str) -> None:
    twice = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the {side} side repeats the key {key}: {twice[0].asDict()}")


def left_join_one_to_one(left: DataFrame, right: DataFrame, key: list[str], declared: tuple[str, ...] = ()) -> DataFrame:
    """Left outer join that fails where either side repeats a key. Sides in ``declared`` ("left", "right") are known to be unique and not checked."""
    for name, side in (("left", left), ("right", right)):
        if name not in declared:
            assert_unique(side.select(*key), key, name)
    return left.join(right, key, "left")


def flag_existing(left: DataFrame, right: DataFrame, key: list[str], flag: str) -> DataFrame:
    """``left`` with 1 where its key is on the right, else 0."""
    marks = right.select(*key).distinct().withColumn(flag, F.lit(1))
    return left.join(marks, key, "left").withColumn(flag, F.coalesce(flag, F.lit(0)).cast("byte"))


def only_left(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return left.join(right.select(*key), key, "left_anti")


def keep_first(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The first row, by ``seq``, of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(seq))).where("_rn = 1").drop("_rn")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: n_both, n_only_a, n_only_b distinct keys."""
    sides = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return sides.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_both"), F.count_if(F.col("_b").isNull()).alias("n_only_a"), F.count_if(F.col("_a").isNull()).alias("n_only_b"))


#: Dictionaries of more entries are joined as tables.
MOST_LITERALS = 10_000


def lookup(c: Column, values: dict, default) -> Column:
    """A fitted dictionary as an expression; for larger ones see ``looked_up``."""
    if len(values) > MOST_LITERALS:
        raise ValueError(f"{len(values)} entries; join a table beyond {MOST_LITERALS}")
    if not values:
        return F.lit(default)
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def looked_up(df: DataFrame, c: str, table: DataFrame, value: str, output: str, default) -> DataFrame:
    """``df`` with ``output``: the table's value for the column, joined on its column ``v`` of distinct strings; ``default`` where it has none."""
    side = table.select(F.col("v").alias("_v"), F.col(value).alias("_found"))
    out = df.withColumn("_key", F.col(c).cast("string")).join(side, F.col("_key") == F.col("_v"), "left")
    return out.withColumn(output, F.coalesce("_found", F.lit(default))).drop("_key", "_v", "_found")


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear interpolation on a table, constant beyond its ends."""
    px, py = F.array(*map(F.lit, map(float, xs))), F.array(*map(F.lit, map(float, ys)))
    k = F.size(F.filter(px, lambda v: v <= x))
    lo, hi = F.greatest(k, F.lit(1)), F.least(k + 1, F.lit(len(xs)))
    x0, x1, y0, y1 = (F.element_at(a, i) for a, i in ((px, lo), (px, hi), (py, lo), (py, hi)))
    return F.when(x.isNull(), None).when(x <= xs[0], ys[0]).when(x >= xs[-1], ys[-1]).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))

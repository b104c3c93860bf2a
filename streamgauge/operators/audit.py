"""Profiles of a table: nulls, distinct values, duplicates, order, value tables, concentration, single-column leakage."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import quantiles, ranked, running, steps


def _long(pairs: list[tuple]) -> Column:
    return F.explode(F.array(*[F.struct(*[x.alias(n) for n, x in p]) for p in pairs]))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row a column: n_null, null_fraction, n_distinct. One aggregation for all."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"{c}|0") for c in columns], *[F.count_distinct(c).alias(f"{c}|1") for c in columns])
    rows = [[("column", F.lit(c)), ("n_null", F.col(f"{c}|0")), ("n_distinct", F.col(f"{c}|1")), ("n", F.col("_n"))] for c in columns]
    return wide.select(_long(rows).alias("x")).select("x.column", "x.n_null", (F.col("x.n_null") / F.col("x.n")).alias("null_fraction"), "x.n_distinct")


def null_blocks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that have the same number of nulls: n_null, columns."""
    return profile(df, columns).groupBy("n_null").agg(F.array_join(F.sort_array(F.collect_list("column")), ",").alias("columns"))


def value_table(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """column, value, n, rate: for columns of 2 to 25 distinct values; a null is ``<NA>``."""
    long = df.select(_long([[("column", F.lit(c)), ("value", F.coalesce(F.col(c).cast("string"), F.lit("<NA>"))), ("y", F.col(y).cast("double"))] for c in columns]).alias("x")).select("x.*")
    by = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    return by.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("column"))).where("_k between 2 and 25").drop("_k")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """rows, distinct and redundant rows of a key."""
    by = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
    return by.agg(F.sum("c").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("c") - 1).alias("n_redundant"))


def duplicate_sizes(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1").groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"))


def conflicts(df: DataFrame, key: list[str], y: str) -> DataFrame:
    """Keys with more than one label."""
    return df.groupBy(*key).agg(F.count_distinct(y).alias("n_labels"), F.count(F.lit(1)).alias("n")).where("n_labels > 1")


def order_profile(df: DataFrame, t: str, seq: str) -> DataFrame:
    """Least, largest and distinct order keys, and how often they fall from a row to the next."""
    falls = F.count_if(F.col(t) < F.col("_previous"))
    return steps(df.select(t, seq), [seq], t, [F.min(t).alias("t_min"), F.max(t).alias("t_max"), F.count_distinct(t).alias("n_distinct"), falls.alias("n_falls")])


def describe(df: DataFrame, c: str, by: list[str]) -> DataFrame:
    """Count, moments, range, exact quartiles, zeros and negatives of a column by group."""
    out = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"), F.count_if(F.col(c) == 0).alias("n_zero"), F.count_if(F.col(c) < 0).alias("n_negative"))
    q = quantiles(df, c, [0.25, 0.5, 0.75], tuple(by)).withColumnsRenamed({x: f"_by{i}" for i, x in enumerate(by)})
    on = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"_by{i}")) for i, x in enumerate(by)], F.lit(True))
    return out.join(q, on, "left").select(*by, "n", "mean", "std", "least", F.col("q0").alias("q25"), F.col("q1").alias("q50"), F.col("q2").alias("q75"), "most", "n_zero", "n_negative")


def group_size_quantiles(df: DataFrame, key: str, at: list[float]) -> DataFrame:
    q = quantiles(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "n", at)
    return q.select(*[F.col(f"q{i}").alias(f"q{int(a * 100):03d}") for i, a in enumerate(at)])


def median_table(df: DataFrame, c: str, row: str, column: str, values: list[str]) -> DataFrame:
    """A row for each value of ``row``, a column for each of ``values``: the exact median of ``c``."""
    q = quantiles(df.where(F.col(column).isin(values)), c, [0.5], (row, column))
    return df.select(row).distinct().join(q.groupBy(row).pivot(column, values).agg(F.first("q0")), row, "left")


def top_decile_share(df: DataFrame, entity: str, y: str) -> DataFrame:
    """Share of the positives that the tenth of entities with most of them has."""
    by = df.groupBy(entity).agg(F.sum(F.col(y).cast("long")).alias("p"))
    r = ranked(by, [F.desc("p"), entity], "_rn")
    most = F.greatest(F.floor(r.agg(F.count(F.lit(1))).scalar() / 10), F.lit(1))
    return r.agg((F.sum(F.when(F.col("_rn") <= most, F.col("p")).otherwise(0)) / F.sum("p")).alias("share"))


def leakage_auc(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """A row a column: how well it alone orders the labels, max(auc, 1 - auc), over its non-null rows."""
    long = df.select(_long([[("column", F.lit(c)), ("x", F.col(c).cast("double")), ("y", F.col(y).cast("long"))] for c in columns]).alias("z")).select("z.*").where("x is not null")
    by = long.groupBy("column", "x").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranked_ = running(by, ["column", "x"], {"_below": F.col("neg")}, exclusive=("_below",))
    first = F.broadcast(ranked_.groupBy("column").agg(F.min("_below").alias("_first")))  # a row a column
    ranked_ = ranked_.join(first, "column").withColumn("_w", F.col("pos") * (F.col("_below") - F.col("_first") + F.col("neg") / 2))
    out = ranked_.groupBy("column").agg((F.sum("_w") / (F.sum("pos") * F.sum("neg"))).alias("_a"))
    return out.select("column", F.greatest(F.col("_a"), 1 - F.col("_a")).alias("auc"))


def leakage_category(df: DataFrame, columns: list[str], y: str, least: int = 100) -> DataFrame:
    """A row a column: its value of the highest rate among values of at least ``least`` rows."""
    by = value_long(df, columns, y).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")).where(F.col("n") >= least)
    best = by.groupBy("column").agg(F.max_by(F.struct("value", "n", "rate"), F.struct(F.round("rate", 9), "value")).alias("b"))
    return best.select("column", "b.value", "b.n", "b.rate")


def value_long(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    return df.select(_long([[("column", F.lit(c)), ("value", F.col(c).cast("string")), ("y", F.col(y).cast("double"))] for c in columns]).alias("x")).select("x.*").where("value is not null")


def findings(df: DataFrame, columns: list[str], checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """severity, code, n: the rows that break each check. One aggregation for all."""
    wide = df.select(*columns).agg(*[F.count_if(bad).alias(code) for code, (_, bad) in checks.items()])
    rows = [wide.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(code).alias("n")) for code, (severity, _) in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), rows).where("n > 0")


def most_distinct(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """A row a column: the largest number of distinct values that a group holds. 1 means constant within groups."""
    by = df.groupBy(group).agg(*[F.count_distinct(c).alias(c) for c in columns])
    wide = by.agg(*[F.max(c).alias(c) for c in columns])
    return wide.select(_long([[("column", F.lit(c)), ("most", F.col(c))] for c in columns]).alias("x")).select("x.*")


def coverage(df: DataFrame, by: str, flag: Column) -> DataFrame:
    """by, n, covered, share: rows of each group for which the flag holds."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("covered"))
    return out.withColumn("share", F.col("covered") / F.col("n"))


def duplicate_report(df: DataFrame, identifiers: list[str], row_id: str, t: str | None = None) -> DataFrame:
    """One row: n_rows, rows redundant as a whole, redundant but for the identifiers, repeated row ids; and, with ``t``, groups
    of rows equal but for identifiers and ``t`` that hold several t. Nulls equal nulls."""
    rest = [c for c in df.columns if c not in identifiers]
    extra = lambda cols, name: df.groupBy(*cols).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias(name))
    out = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumns({"n_exact": extra(df.columns, "a").scalar(), "n_but_ids": extra(rest, "a").scalar(), "n_row_ids": extra([row_id], "a").scalar()})
    if t:
        other = [c for c in rest if c != t]
        moved = df.groupBy(*other).agg(F.count_distinct(t).alias("k")).agg(F.count_if(F.col("k") > 1).alias("a"))
        out = out.withColumn("n_moved_groups", moved.scalar())
    return out


def top_findings(found: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The k findings of the largest score, ties by the other columns; each executor keeps k rows."""
    return found.orderBy(F.desc(score), *ties).limit(k)


def family_counts(names: list[str], families: dict[str, str]) -> dict[str, int]:
    """How many names fit each family's pattern; the first that fits takes a name, the others go to ``other``."""
    out = dict.fromkeys([*families, "other"], 0)
    for n in names:
        out[next((f for f, p in families.items() if re.fullmatch(p, n)), "other")] += 1
    return out

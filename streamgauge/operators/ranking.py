"""Sums and ranks over a total order of a whole table, without a task that sees all rows.

Rows are dealt to range partitions of the order and stored, each with its partition and place. Partitions are summed (one
small row each goes to the driver), and a row's running sum is that of its partition so far plus what the partitions
before it hold. Rows are stored because range borders come from a sample: dealt twice, rows could change partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept


def running(df: DataFrame, order: list[str | Column], sums: dict[str, Column], exclusive: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with a column for each of ``sums``: the sum of an expression over all rows up to each row, in ``order``.

    Those named in ``exclusive`` leave the row itself out. Nulls count as 0. The order must be total where ties matter.
    """
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    terms = {f"_s{i}": F.coalesce(x, F.lit(0)) for i, x in enumerate(sums.values())}
    dealt = df.withColumns(terms).repartitionByRange(*by).sortWithinPartitions(*by)
    stored = kept(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "running")
    totals = stored.groupBy("_part").agg(*[F.sum(c).alias(c) for c in terms])
    kinds = [totals.schema[c].dataType.simpleString() for c in terms]
    before, total = [], [0.0 if k == "double" else 0 for k in kinds]
    for r in totals.orderBy("_part").collect():  # a row a partition
        before.append((r["_part"], *total))
        total = [a + r[c] for a, c in zip(total, terms, strict=True)]
    offsets = stored.sparkSession.createDataFrame(before or [(-1, *total)], "_part int, " + ", ".join(f"_b{i} {k}" for i, k in enumerate(kinds)))
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = stored.join(F.broadcast(offsets), "_part")
    out = out.withColumns({name: F.sum(c).over(own) + F.col(f"_b{i}") - (F.col(c) if name in exclusive else F.lit(0)) for i, (name, c) in enumerate(zip(sums, terms, strict=True))})
    return out.drop("_part", "_at", *terms, *[f"_b{i}" for i in range(len(terms))])


def ranked(df: DataFrame, order: list[str | Column], name: str = "rank", within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the place of each row, from 1, in ``order``; ``within``: places start anew for each value of these columns."""
    out = running(df, [*within, *order], {name: F.lit(1)})
    if not within:
        return out
    first = out.groupBy(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)]).agg((F.min(name) - 1).alias("_first"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(within)])
    return out.join(first, on).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *[f"_w{i}" for i in range(len(within))])


def steps(df: DataFrame, order: list[str | Column], c: str, agg: list[Column], previous: str = "_previous") -> DataFrame:
    """Aggregates over all rows with ``previous``: the value of ``c`` in the row before. One row a partition is gathered."""
    by = [F.col(x) if isinstance(x, str) else x for x in order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by)
    stored = kept(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "steps")
    ends = stored.groupBy("_part").agg(F.max_by(c, "_at").alias("last")).orderBy("_part").collect()
    before = [(r["_part"], ends[i - 1]["last"] if i else None) for i, r in enumerate(ends)]
    kind = stored.schema[c].dataType.simpleString()
    offsets = stored.sparkSession.createDataFrame(before or [(-1, None)], f"_part int, _before {kind}")
    own = Window.partitionBy("_part").orderBy("_at")
    out = stored.join(F.broadcast(offsets), "_part").withColumn(previous, F.when(F.row_number().over(own) == 1, F.col("_before")).otherwise(F.lag(c).over(own)))
    return out.agg(*agg)


def quantiles(df: DataFrame, c: str, at: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """by, q0, q1 ..: exact quantiles of a column, linear between rows, from counts by value. Nulls are left out; a group of
    nulls only has no row."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*by, F.col(c).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    cum = running(counts, [*by, "_v"], {"_cum": F.col("_n")})
    ends = cum.groupBy(*[F.col(x).alias(f"_g{i}") for i, x in enumerate(by)]).agg(F.min(F.col("_cum") - F.col("_n")).alias("_base"), F.sum("_n").alias("_total"))
    on = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"_g{i}")) for i, x in enumerate(by)], F.lit(True))
    own = cum.join(ends, on) if by else cum.join(F.broadcast(ends))  # one row
    place = [F.lit(float(q)) * (F.col("_total") - 1) for q in at]
    above = lambda x: F.min(F.when(F.col("_cum") - F.col("_base") > x, F.col("_v")))
    out = own.groupBy(*by).agg(F.max("_total").alias("_total"), *[above(F.floor(x)).alias(f"_l{i}") for i, x in enumerate(place)], *[above(F.ceil(x)).alias(f"_h{i}") for i, x in enumerate(place)])
    values = [(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (x - F.floor(x))).alias(f"q{i}") for i, x in enumerate(place)]
    return out.select(*by, *values)


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """The exact median of each column: one unpivot and one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    found = {r.c: r.q0 for r in quantiles(df.select(pairs.alias("x")).select("x.*"), "v", [0.5], ("c",)).collect()} if columns else {}  # a row a column
    return {c: found.get(c) for c in columns}

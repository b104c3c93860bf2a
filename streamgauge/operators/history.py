"""Strictly-prior, tie-aware sliding windows of each entity, and what follows from them.

The frame of a row: rows before it in the order (t, seq) whose t is greater than the row's t less the window. An event
exactly a window old is out; earlier rows with the same t are in. A plain range frame can't tell ties apart, so a frame is
the sum of two: rows of strictly earlier t in range, and earlier rows of the same t. All frames over one entity, also
those by entity and context, need one exchange on the entity.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
EARTH_KM = 6371.0088


@dataclass(frozen=True)
class HistorySpec:
    """t is a long; ``unit`` is the number of its steps in an hour."""

    entity: str
    t: str
    seq: str
    amount: str
    contexts: tuple[str, ...] = ()
    windows_h: tuple[int, ...] = (1, 3, 6, 12, 18, 24, 72, 168)
    deviation_h: int = 168
    unit: int = MICROS_PER_HOUR
    min_prior: int = 3
    min_gap_s: int = 60


def _prior(keys: list[str], t: str, seq: str, width: int, agg) -> tuple[Column, Column]:
    span = Window.partitionBy(*keys).orderBy(t).rangeBetween(-(width - 1), -1)
    ties = Window.partitionBy(*keys, t).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    return agg.over(span), agg.over(ties)


def prior_count(keys: list[str], t: str, seq: str, width: int) -> Column:
    a, b = _prior(keys, t, seq, width, F.count(F.lit(1)))
    return a + b


def prior_sum(x: Column, keys: list[str], t: str, seq: str, width: int) -> Column:
    a, b = _prior(keys, t, seq, width, F.sum(x))
    return F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))


def _rows(s: HistorySpec):
    return Window.partitionBy(s.entity).orderBy(s.t, s.seq)


def n_prior(s: HistorySpec) -> Column:
    return (F.row_number().over(_rows(s)) - 1).cast("long")


def hours_since_last(s: HistorySpec) -> Column:
    return (F.col(s.t) - F.lag(s.t).over(_rows(s))) / s.unit


def exclusive_sum(x: str, keys: list[str], *order: str) -> Column:
    """The sum of the rows before, within a key."""
    return F.coalesce(F.sum(x).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def entity_history(df: DataFrame, s: HistorySpec) -> DataFrame:
    """Counts and sums by window, the count of all prior events, gap and amount of the last event."""
    keys, out = [s.entity], {"h_n_prior": n_prior(s)}
    for w in s.windows_h:
        out[f"h_cnt_{w}h"] = prior_count(keys, s.t, s.seq, w * s.unit)
        out[f"h_amt_{w}h"] = prior_sum(F.col(s.amount), keys, s.t, s.seq, w * s.unit)
    prev = F.lag(s.amount).over(_rows(s))
    out["h_hours_since_last"] = hours_since_last(s)
    out["h_prev_amt"] = prev
    df = df.withColumns(out)
    return df.withColumn("h_amt_to_prev", F.when(F.col("h_prev_amt") > 0, F.col(s.amount) / F.col("h_prev_amt")))


def split_windows(df: DataFrame, keys: list[str], t: str, seq: str, widths: dict[str, int], sums: dict[str, Column], block: int) -> DataFrame:
    """``df`` with, for each width, ``<name>_n`` and ``<name>_<sum>``: the prior count and sums, by running sums of time blocks.

    The frame of a row is the running sum up to it less that up to its window's start. Events and window starts are rows of
    one table, dealt by keys and time block, so an entity of any size is spread over its blocks and a row costs the same
    whatever its window holds. What the blocks before hold is added from one row a block. ``seq`` is unique within the keys.
    """
    terms = {"_c": F.lit(1.0)} | {f"_v{i}": F.coalesce(x.cast("double"), F.lit(0.0)) for i, x in enumerate(sums.values())}
    named = df.withColumns({f"_k{i}": F.col(k) for i, k in enumerate(keys)} | {"_q": F.col(seq)})
    own = [f"_k{i}" for i in range(len(keys))]
    event = named.select(*own, "_q", F.col(t).alias("_x"), F.lit(0).alias("_kind"), *[x.alias(n) for n, x in terms.items()])
    starts = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("kind"), (F.col(t) - w).alias("x")) for i, w in enumerate(widths.values())]))
    probe = named.select(*own, "_q", starts.alias("_s")).select(*own, "_q", F.col("_s.x").alias("_x"), F.col("_s.kind").alias("_kind"), *[F.lit(0.0).alias(n) for n in terms])
    rows = event.unionByName(probe).withColumn("_block", F.floor(F.col("_x") / block))
    # at one instant events come before the window starts that leave them out, and by seq among themselves
    so_far = Window.partitionBy(*own, "_block").orderBy("_x", F.col("_kind") > 0, "_q").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"{n}_up": F.sum(n).over(so_far) for n in terms})
    earlier = Window.partitionBy(*own).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = event.unionByName(probe).withColumn("_block", F.floor(F.col("_x") / block)).groupBy(*own, "_block").agg(*[F.sum(n).alias(n) for n in terms])
    carried = totals.select(*[F.col(k).alias(f"{k}_b") for k in own], F.col("_block").alias("_block_b"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(f"{n}_before") for n in terms])
    on = F.col("_block") == F.col("_block_b")
    for k in own:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_b"))
    rows = rows.join(carried, on).select(*own, "_q", "_kind", *[(F.col(f"{n}_up") + F.col(f"{n}_before") - F.when(F.col("_kind") == 0, F.col(n)).otherwise(0.0)).alias(n) for n in terms])
    wide = rows.groupBy(*[F.col(k).alias(f"{k}_w") for k in own], F.col("_q").alias("_q_w")).agg(*[F.max(F.when(F.col("_kind") == i, F.col(n))).alias(f"{n}_{i}") for n in terms for i in range(len(widths) + 1)])
    on = F.col("_q") == F.col("_q_w")
    for k in own:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_w"))
    out = []
    for i, name in enumerate(widths):
        out.append((F.col("_c_0") - F.col(f"_c_{i + 1}")).cast("long").alias(f"{name}_n"))
        out += [(F.col(f"_v{j}_0") - F.col(f"_v{j}_{i + 1}")).alias(f"{name}_{x}") for j, x in enumerate(sums)]
    return named.join(wide, on).select(*df.columns, *out)


def context_history(df: DataFrame, s: HistorySpec) -> DataFrame:
    """Counts and sums by window within entity and context; a null context counts as one value."""
    for c in s.contexts:
        df = df.withColumn(f"_{c}", F.coalesce(F.col(c).cast("string"), F.lit("<NA>")))
        keys, out = [s.entity, f"_{c}"], {}
        for w in s.windows_h:
            out[f"h_{c}_cnt_{w}h"] = prior_count(keys, s.t, s.seq, w * s.unit)
            out[f"h_{c}_amt_{w}h"] = prior_sum(F.col(s.amount), keys, s.t, s.seq, w * s.unit)
        df = df.withColumns(out)
        n, total = F.col(f"h_{c}_cnt_{s.deviation_h}h"), F.col(f"h_{c}_amt_{s.deviation_h}h")
        mean = F.when(n > 0, total / n)
        df = df.withColumn(f"h_amt_to_{c}_mean", F.when(mean > 0, F.col(s.amount) / mean)).drop(f"_{c}")
    return df


def deviation(df: DataFrame, s: HistorySpec) -> DataFrame:
    """Mean, ratio to it and z-score of the amount within the deviation window."""
    keys, w = [s.entity], s.deviation_h * s.unit
    df = df.withColumns({"_n": prior_count(keys, s.t, s.seq, w), "_s": prior_sum(F.col(s.amount), keys, s.t, s.seq, w), "_q": prior_sum(F.col(s.amount) * F.col(s.amount), keys, s.t, s.seq, w)})
    df = df.withColumn("h_amt_mean", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")))
    spread = F.sqrt(F.greatest((F.col("_q") - F.col("_n") * F.col("h_amt_mean") * F.col("h_amt_mean")) / (F.col("_n") - 1), F.lit(0.0)))
    df = df.withColumn("_d", F.when(F.col("_n") > 1, spread))
    df = df.withColumn("h_amt_to_mean", F.when(F.col("h_amt_mean") > 0, F.col(s.amount) / F.col("h_amt_mean")))
    return df.withColumn("h_amt_z", F.when(F.col("_d") > 0, (F.col(s.amount) - F.col("h_amt_mean")) / F.col("_d"))).drop("_n", "_s", "_q", "_d")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def geo(df: DataFrame, s: HistorySpec, home: tuple[str, str], place: tuple[str, str]) -> DataFrame:
    """Distance to the last place, speed implied by it, mean distance from home in the deviation window and ratio to it."""
    rows, w = _rows(s), s.deviation_h * s.unit
    lat, lon = map(F.col, place)
    df = df.withColumns({"_dist": haversine_km(F.col(home[0]), F.col(home[1]), lat, lon), "_gap_s": (F.col(s.t) - F.lag(s.t).over(rows)) * 3600 / s.unit, "h_km_to_prev": haversine_km(F.lag(lat).over(rows), F.lag(lon).over(rows), lat, lon)})
    df = df.withColumns({"_n": prior_count([s.entity], s.t, s.seq, w), "_s": prior_sum(F.col("_dist"), [s.entity], s.t, s.seq, w)})
    df = df.withColumn("h_speed_kmh", F.when(F.col("_gap_s") >= s.min_gap_s, F.col("h_km_to_prev") / (F.col("_gap_s") / 3600))).withColumn("h_home_km_mean", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")))
    return df.withColumn("h_home_km_ratio", F.when(F.col("h_home_km_mean") > 0, F.col("_dist") / F.col("h_home_km_mean"))).drop("_dist", "_gap_s", "_n", "_s")


def day_angle(ts: Column) -> Column:
    """Time of day on a circle; parts of seconds don't count."""
    return 2 * math.pi * (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 86400


def circle_distance(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + math.pi, F.lit(2 * math.pi)) - math.pi)


def kappa(r: Column) -> Column:
    """Concentration of a von Mises distribution from its mean resultant length (Best and Fisher's three branches)."""
    r = F.least(r, F.lit(0.9999))
    k = F.when(r < 0.53, 2 * r + F.pow(r, 3) + 5 * F.pow(r, 5) / 6).when(r < 0.85, -0.4 + 1.39 * r + 0.43 / (1 - r)).otherwise(1 / (F.pow(r, 3) - 4 * r * r + 3 * r))
    return F.greatest(F.least(k, F.lit(1000.0)), F.lit(0.0))


_LINEAR, _GEOMETRIC, _TOP = 400, 1200, 1000.0


@lru_cache
def half_width_table(alpha: float = 0.9) -> tuple[list[float], list[float]]:
    """Half-widths of central intervals for a grid of concentrations, by numerical inversion of the distribution."""
    grid = np.concatenate([np.linspace(1e-6, 1, _LINEAR, endpoint=False), np.geomspace(1, _TOP, _GEOMETRIC)])
    width = []
    for k in grid:
        x = np.linspace(0, min(math.pi, 12 / math.sqrt(max(k, 1e-9))), 20_001)
        density = np.exp(k * (np.cos(x) - 1))
        mass = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
        width.append(float(np.interp(alpha, mass / mass[-1], x)))
    return grid.tolist(), width


def half_width(k: Column, alpha: float = 0.9) -> Column:
    """The half-width for a concentration, linear between the table's points, whose place follows from the concentration."""
    grid, width = half_width_table(alpha)
    low = F.floor((k - 1e-6) / ((1 - 1e-6) / _LINEAR))
    high = _LINEAR + F.floor(F.log(F.greatest(k, F.lit(1.0))) * ((_GEOMETRIC - 1) / math.log(_TOP)))
    i = F.greatest(F.least(F.when(k < 1, low).otherwise(high), F.lit(len(grid) - 2)), F.lit(0)).cast("int")
    xs, ys = F.array(*map(F.lit, grid)), F.array(*map(F.lit, width))
    x0, x1, y0, y1 = F.element_at(xs, i + 1), F.element_at(xs, i + 2), F.element_at(ys, i + 1), F.element_at(ys, i + 2)
    return F.when(k <= 1e-6, math.pi).when(k >= _TOP, width[-1]).otherwise(y0 + (y1 - y0) * (k - x0) / (x1 - x0))


def circular(df: DataFrame, s: HistorySpec, ts: str, days: tuple[int, ...] = (7, 30), alpha: float = 0.9) -> DataFrame:
    """Mean direction and concentration of the time of day in prior windows, distance from it, and whether within the interval."""
    df = df.withColumn("_a", day_angle(F.col(ts)))
    for d in days:
        w = d * 24 * s.unit
        df = df.withColumns({"_n": prior_count([s.entity], s.t, s.seq, w), "_c": prior_sum(F.cos("_a"), [s.entity], s.t, s.seq, w), "_s": prior_sum(F.sin("_a"), [s.entity], s.t, s.seq, w)})
        enough = F.col("_n") >= s.min_prior
        df = df.withColumn(f"h_vm{d}_r", F.when(enough, F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) / F.col("_n"))).withColumn(f"h_vm{d}_n", F.col("_n"))
        df = df.withColumn("_d", F.when(enough, circle_distance(F.col("_a"), F.atan2("_s", "_c"))))
        df = df.withColumn("_k", kappa(F.col(f"h_vm{d}_r")))
        q = half_width(F.col("_k"), alpha)
        df = df.withColumn(f"h_vm{d}_hours", F.col("_d") * 12 / math.pi).withColumn(f"h_vm{d}_inside", F.when(F.col("_d").isNotNull(), (F.col("_d") <= q).cast("byte")))
    return df.drop("_a", "_n", "_c", "_s", "_d", "_k")


def feature_names(s: HistorySpec, days: tuple[int, ...] = (7, 30)) -> list[str]:
    """All history columns in a fixed order."""
    out = ["h_n_prior"] + [f"h_{k}_{w}h" for w in s.windows_h for k in ("cnt", "amt")]
    out += [f"h_{c}_{k}_{w}h" for c in s.contexts for w in s.windows_h for k in ("cnt", "amt")]
    out += ["h_hours_since_last", "h_prev_amt", "h_amt_to_prev", "h_amt_mean", "h_amt_to_mean", "h_amt_z", *[f"h_amt_to_{c}_mean" for c in s.contexts]]
    return out + ["h_km_to_prev", "h_speed_kmh", "h_home_km_mean", "h_home_km_ratio"] + [f"h_vm{d}_{k}" for d in days for k in ("n", "r", "hours", "inside")]


def all_history(df: DataFrame, s: HistorySpec, home: tuple[str, str], place: tuple[str, str], ts: str, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """``df`` with every history column."""
    return circular(geo(deviation(context_history(entity_history(df, s), s), s), s, home, place), s, ts, days)


def as_float(df: DataFrame) -> DataFrame:
    """History columns narrowed to 32 bits, as the last step."""
    return df.withColumns({c: F.col(c).cast("float") for c in df.columns if c.startswith("h_")})

"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def token(c: Column, pattern: str = r"[.\s/]", index: int = 0) -> Column:
    """A piece of a text split at a pattern; null where there is none."""
    return F.try_element_at(F.split(c, pattern, -1), F.lit(index + 1 if index >= 0 else index))


def log_amount(c: Column) -> Column:
    return F.when(c.isNotNull(), F.log1p(F.greatest(c, F.lit(0.0))))


def decimals(c: Column) -> Column:
    """The least of 0, 1, 2 places that give the number within 1e-9 plus 1e-5 of its size; else 3. Null gives 3."""
    out = None
    for d in (0, 1, 2):
        near = F.abs(c - F.bround(c, d)) <= 1e-9 + 1e-5 * F.abs(F.bround(c, d))
        out = F.when(near, d) if out is None else out.when(near, d)
    return out.otherwise(3).cast("byte")


def calendar(ts: Column, prefix: str) -> dict[str, Column]:
    """Hour, day of week (Monday 0), month, and both cycles."""
    day = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / 86400
    week = F.weekday(ts)
    return {
        f"{prefix}_hour": F.hour(ts).cast("byte"), f"{prefix}_dow": week.cast("byte"), f"{prefix}_month": F.month(ts).cast("byte"),
        f"{prefix}_day_sin": F.sin(2 * math.pi * day).cast("float"), f"{prefix}_day_cos": F.cos(2 * math.pi * day).cast("float"),
        f"{prefix}_dow_sin": F.sin(2 * math.pi * week / 7).cast("float"), f"{prefix}_dow_cos": F.cos(2 * math.pi * week / 7).cast("float"),
    }


def clock(t: Column, period: float, prefix: str, bins: int = 24, anchor: float = 0.0) -> dict[str, Column]:
    """Phase of a relative clock: sine, cosine and bin."""
    phase = F.pmod(t - anchor, F.lit(float(period))) / period
    return {f"{prefix}_sin": F.sin(2 * math.pi * phase).cast("float"), f"{prefix}_cos": F.cos(2 * math.pi * phase).cast("float"), f"{prefix}_bin": F.floor(phase * bins).cast("short")}


def micros_between(a: Column, b: Column) -> Column:
    """Microseconds from a to b, of naive timestamps whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", a.cast("timestamp_ntz"), b.cast("timestamp_ntz"))


def age_years(birth: Column, at: Column) -> Column:
    return F.floor(micros_between(birth, at) / 86_400_000_000) / 365.25


def time_of_day_differs(unix_s: Column, ts: Column, most_s: float = 1.0) -> Column:
    """Whether an epoch and a naive timestamp are more than ``most_s`` apart in the time of day."""
    own = micros_between(F.date_trunc("day", ts).cast("timestamp_ntz"), ts) / 1e6
    return F.abs(F.pmod(unix_s.cast("double"), F.lit(86400.0)) - own) > most_s


def places_as_text(c: Column) -> Column:
    """Digits after the point of a number written in full; 0 for whole numbers. Null stays null."""
    text = F.regexp_replace(F.format_string("%.9f", c.cast("double")), "0+$", "")
    return F.when(c.isNotNull(), F.length(F.substring_index(text, ".", -1)))


def prefix_rate(c: Column, prefix: str) -> Column:
    """Aggregate: the share of texts that begin with a prefix. Nulls don't."""
    return F.avg(F.coalesce(c.startswith(prefix), F.lit(False)).cast("double"))


def any_present(columns: list[str]) -> Column:
    """1 where any of the columns has a value, else 0."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNotNull()
    return out.cast("byte")


def logit(p: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def safe_id(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("string"), 256), 1, 12)


def decision(p: Column, threshold: float) -> Column:
    """SUSPECT at or above the threshold; scores that are no numbers count as 0."""
    q = F.when(p.isNull() | F.isnan(p), 0.0).otherwise(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))
    return F.when(q >= threshold, "SUSPECT").otherwise("APPROVED")


def errors(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold: what is wrong with a row."""
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))

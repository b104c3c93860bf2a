"""Checks of incoming events: JSON texts against declared fields, and which fields a fitted pipeline reads at all."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.history import HistorySpec

#: JSON kinds, as variants name them, that each kind of field takes; nothing is converted.
ACCEPTS = {"int": "^(BIGINT|DECIMAL\\([0-9]+,0\\))$", "float": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "string": "^STRING$", "datetime": "^STRING$"}
TYPES = {"int": "bigint", "float": "double", "string": "string", "datetime": "timestamp_ntz"}


@dataclass(frozen=True)
class Field:
    """A field of an event: its kind, whether null is allowed, bounds (both included) and least length."""

    name: str
    kind: str
    nullable: bool = False
    least: float | None = None
    most: float | None = None
    min_length: int = 1


def checked(df: DataFrame, json: str, fields: list[Field], cross: dict[str, Column] | None = None) -> DataFrame:
    """``df`` with a column for each field and ``errors``: what is wrong with the JSON text, as ``field:reason``.

    Reasons: missing, null, type (no conversion: "5" is no number), range, finite, length, unknown, json. ``cross`` holds
    conditions over the fields' columns that make an event wrong, by name; they count only where the fields are sound.
    """
    v = F.try_parse_json(F.trim(F.col(json)))
    keys = F.json_object_keys(json)
    out = df.withColumn("_v", v).withColumn("_keys", F.when(F.col("_v").isNotNull(), keys))
    found: list[Column] = [F.when(F.col("_v").isNull() | F.col("_keys").isNull(), "json")]
    values = {}
    for f in fields:
        path = f"$['{f.name}']"
        raw = F.variant_get("_v", path, "variant")
        has = F.coalesce(F.array_contains("_keys", f.name), F.lit(False))
        empty = F.is_variant_null(raw) | raw.isNull()
        fits = F.schema_of_variant(raw).rlike(ACCEPTS[f.kind])
        value = F.try_variant_get("_v", path, TYPES[f.kind])
        value = F.when(~empty & fits, F.trim(value) if f.kind == "string" else value)
        values[f.name] = value
        here = F.col("_keys").isNotNull()
        found.append(F.when(here & ~has, f"{f.name}:missing" if not f.nullable else None))
        if not f.nullable:
            found.append(F.when(here & has & empty, f"{f.name}:null"))
        found.append(F.when(here & has & ~empty & (~fits | value.isNull()), f"{f.name}:type"))
        if f.kind in ("int", "float"):
            number = value.cast("double")
            bad = F.lit(False)
            if f.least is not None:
                bad = bad | (number < f.least)
            if f.most is not None:
                bad = bad | (number > f.most)
            found.append(F.when(bad, f"{f.name}:range"))
            found.append(F.when(F.isnan(number) | (F.abs(number) == float("inf")), f"{f.name}:finite"))
        elif f.kind == "string":
            found.append(F.when(F.length(value) < f.min_length, f"{f.name}:length"))
    known = F.array(*[F.lit(f.name) for f in fields])
    out = out.withColumn("_unknown", F.transform(F.coalesce(F.array_except("_keys", known), F.array().cast("array<string>")), lambda k: F.concat(k, F.lit(":unknown"))))
    out = out.withColumns(values).withColumn("_own", F.array_compact(F.array(*found)))
    wrong = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in (cross or {}).items()])) if cross else F.array().cast("array<string>")
    out = out.withColumn("errors", F.concat("_own", "_unknown", F.when(F.size("_own") == 0, wrong).otherwise(F.array().cast("array<string>"))))
    return out.drop("_v", "_keys", "_unknown", "_own")


def routed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sound rows, and those to put aside with their errors."""
    return df.where(F.size("errors") == 0).drop("errors"), df.where(F.size("errors") > 0)


def consumed(required: list[str], steps: list[Any], features: list[str], history: HistorySpec | None, row_id: str | None, derived: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> list[str]:
    """The required fields that a fitted pipeline reads: in parameters of steps, as features, in the history, the row id."""
    used: set[str] = {*features, *more} | ({row_id} if row_id else set())
    for s in steps:
        for x in s.params.values():
            used |= {x} if isinstance(x, str) else {i for i in x if isinstance(i, str)} if isinstance(x, (list, tuple)) else set()
    if history:
        used |= {history.entity, history.t, history.seq, history.amount, *history.contexts}
    return [n for n in required if n in used and n not in derived]

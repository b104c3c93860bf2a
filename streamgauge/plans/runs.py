"""What a run leaves behind: membership and context by part, artifacts, finished work to resume, reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_parts(df: DataFrame, path: str, columns: list[str], form: str = "csv") -> None:
    """Columns of the rows that have a part, a folder for each part."""
    df.where("part is not null").select("part", *columns).write.partitionBy("part").option("header", True).format(form).save(path)


def read_parts(spark: SparkSession, path: str, schema: str, form: str = "csv") -> DataFrame:
    """What ``write_parts`` wrote, with its part; a condition on the part reads its folder only."""
    return spark.read.schema(T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("part", T.StringType())])).option("header", True).format(form).load(path)


def prepare(df: DataFrame, protocol: str, key: list[str], seq: str) -> tuple[DataFrame, int]:
    """The rows that a protocol works on, and how many it removed: ``benchmark`` keeps repeated rows, others the first of each key."""
    from ..operators.relational import keep_first

    if protocol == "benchmark" or not key:
        return df, 0
    out = keep_first(df, key, seq)
    return out, df.count() - out.count()


def binary_target(df: DataFrame, column: str, positive=1, negative=0) -> DataFrame:
    """``df`` with ``y``. Raises where the label is missing, null or neither of the two values."""
    if column not in df.columns:
        raise KeyError(f"no target column {column}")
    c = F.col(column)
    r = df.agg(F.count_if(c.isNull()).alias("nulls"), F.sort_array(F.collect_set(F.when(~c.isin(positive, negative), c.cast("string")))).alias("other")).first()
    if r.nulls:
        raise ValueError(f"{r.nulls} null labels in {column}")
    if r.other:
        raise ValueError(f"labels other than {negative} and {positive} in {column}: {r.other[:5]}")
    return df.withColumn("y", (c == positive).cast("byte"))


def matured(df: DataFrame, order_key: str, as_of, lag=None, simulated: bool = False):
    """Whether a row's label may be used at a time: always for final labels; with a lag only where labels are simulated."""
    if lag is None:
        return F.lit(True)
    if not simulated:
        raise ValueError("a lag is for simulated labels only")
    return F.col(order_key) + lag <= as_of


def split_json(summary: DataFrame, names: tuple[str, ...], cuts: list, **more) -> str:
    """A split as JSON: its parts in order, cut values and summary rows."""
    rows = {r["part"]: r.asDict() for r in summary.collect()}  # a row a part
    return json.dumps({"parts": list(names), "cuts": cuts, "summary": [rows[n] for n in names if n in rows], **more}, sort_keys=True, default=str)


def manifest_json(features: list[str], families: dict[str, str], **more) -> str:
    """What a prepared data set holds, as JSON: its features and how many each family has."""
    from ..operators.audit import family_counts

    return json.dumps({"features": features, "families": family_counts(features, families), **more}, sort_keys=True, default=str)


def resumed(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The stored result of a piece of work, made first where it isn't finished; and whether it was there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    if not there:
        make().write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}"), there


def report(title: str, tables: dict[str, DataFrame], most: int = 50) -> str:
    """A text report: a heading and a table for each result, at most ``most`` rows each; longer ones say so."""
    def cell(v) -> str:
        return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "/")

    out = [f"# {title}"]
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:most]]
        out += ["", f"More than {most} rows."] if len(rows) > most else []
    return "\n".join(out) + "\n"


def log_lines(df: DataFrame, ids: list[str], columns: list[str], event: str):
    """line: a JSON line a row with the event's name, hashed ids and the given columns; nothing else of the row gets out."""
    from ..functions.scalars import safe_id

    return df.select(F.to_json(F.struct(F.lit(event).alias("event"), *[safe_id(F.col(c)).alias(c) for c in ids], *columns)).alias("line"))


def locked_json(candidates: list[dict], thresholds: DataFrame, **more) -> str:
    """The choice that opens the sealed hold-out, as JSON: the champion, its calibrator and the thresholds."""
    from ..operators.metrics import champion

    return json.dumps({"champion": champion(candidates), "thresholds": {r["name"]: r["threshold"] for r in thresholds.collect()}, **more}, sort_keys=True)

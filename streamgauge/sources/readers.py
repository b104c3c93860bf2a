"""Readers: parquet and CSV under a contract, members of zip archives, and a registry of named sources."""

from __future__ import annotations

import csv
import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contracts import Declared


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table; only the named columns reach the scan."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_csv(spark: SparkSession, path: str, contract: Declared, columns: list[str] | None = None, bad: str | None = None) -> DataFrame:
    """A CSV table with the contract's types; NaN becomes null. ``bad``: a column for rows that don't parse."""
    schema = contract.of(header(spark, path))
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if bad:
        schema, reader = T.StructType([*schema.fields, T.StructField(bad, T.StringType())]), reader.option("columnNameOfCorruptRecord", bad)
    df = without_nan(reader.schema(schema).csv(path))
    return df.select(*columns) if columns else df


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null in every floating column."""
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def read_zip_member(spark: SparkSession, paths: list[str], member: str, names: list[str]) -> DataFrame:
    """Rows of a CSV member of zip archives (URIs), all as strings. An archive is a task, which opens the file itself and
    streams the member: neither the archive nor the member is held whole."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as raw, zipfile.ZipFile(raw) as z, z.open(member) as f:
                    held: list[list[str | None]] = []
                    for r in csv.DictReader(io.TextIOWrapper(f, encoding="utf-8", newline="")):
                        held.append([r.get(n) or None for n in names])
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=names)

    listed = spark.createDataFrame([(i, p if "://" in p else "file://" + os.path.abspath(p)) for i, p in enumerate(paths)], "n int, path string")
    return listed.repartitionById(max(1, len(paths)), F.col("n")).select("path").mapInArrow(rows, ", ".join(f"`{n}` string" for n in names))


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of JSON events, one a line, from files that arrive in a folder: the schema's columns and ``bad``, true where a line is no event."""
    lines = spark.readStream.text(path)
    read = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(read.alias("e")).select("e.*").withColumn("bad", F.col("_bad").isNotNull()).drop("_bad")


def canonical_names(df: DataFrame) -> DataFrame:
    """``id-01`` becomes ``id_01``."""
    return df.withColumnsRenamed({c: re.sub(r"-", "_", c) for c in df.columns if re.fullmatch(r"[A-Za-z]+-\d+", c)})


def with_position(df: DataFrame, *order: str) -> DataFrame:
    """A long ``seq`` from 0 by the given order, without a single-task sort; stored, so that a lost executor changes no number."""
    from ..operators.ranking import ranked

    return ranked(df, list(order), "seq").withColumn("seq", F.col("seq") - 1)


class Registry:
    """Sources by name."""

    def __init__(self):
        self.sources: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, source: Callable[[SparkSession], DataFrame]) -> None:
        self.sources[name] = source

    def open(self, spark: SparkSession, name: str) -> DataFrame:
        if name not in self.sources:
            raise KeyError(f"no source {name!r}; known: {sorted(self.sources)}")
        return self.sources[name](spark)

    def available(self, spark: SparkSession) -> list[tuple[str, str]]:
        """Findings: sources that can't be opened."""
        out = []
        for name in self.sources:
            try:
                self.open(spark, name).schema
            except Exception as e:
                out.append((name, str(e).splitlines()[0][:200]))
        return out


def synthetic(spark: SparkSession, n: int, seed: int, features: int = 4) -> DataFrame:
    """Seeded rows for smoke tests: seq, t (with ties), amount, v1.., y."""
    df = spark.range(n).withColumnRenamed("id", "seq").withColumn("t", F.floor(F.col("seq") / 2).cast("double"))
    df = df.withColumn("y", (F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(50)) == 0).cast("int")).withColumn("amount", F.round(F.exp(F.randn(seed)) * 20, 2))
    return df.withColumns({f"v{i}": F.randn(seed + i) + F.col("y") * (i % 2) for i in range(1, features + 1)})

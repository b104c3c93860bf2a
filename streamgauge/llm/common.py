"""Helpers shared by the training-data operators: table access, the shared scratch folder, shipping of this package.

Every operator that cuts lineage or writes files does it in the scratch folder of ``sources.scratch``.
"""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import fresh as scratch_place

#: The whitespace of word rules: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\\x20\\x09-\\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHIPPED: dict[str, str] = {}
_WORK: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the scratch folder."""
    out = scratch_place(spark, label)
    for made in _WORK:
        made.append(out)
    return out


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: cuts lineage, survives lost executors, runs ``df`` once."""
    spark = df.sparkSession
    where = fresh(spark, label)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


@contextmanager
def work(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all that was written to the scratch folder within it. What is needed later is written outside it."""
    made: list[str] = []
    _WORK.append(made)
    try:
        yield
    finally:
        _WORK.remove(made)
        for place in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, wherever the driver was started."""
    sc = spark.sparkContext
    if _SHIPPED.get(sc.applicationId):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="streamgauge-code-")) / "streamgauge_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(target))
    _SHIPPED[sc.applicationId] = str(target)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def parts(df: DataFrame) -> int:
    """Partitions that a shuffle of this session uses."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_of(c: str | Column = "text") -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def same_text(c: str) -> Column:
    """A hash by which rows of one key are told apart; null texts have one too."""
    return F.xxhash64(F.col(c), F.lit(0))


def slices(total: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to ``most`` or hold one element."""
    start = held = 0
    for i, n in enumerate(total):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(total):
        yield start, len(total)

"""The scratch folder that driver and executors share, and tables kept in it.

Its place is the session's ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests) a folder of
our own is made.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """URI of the folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="streamgauge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found or found.startswith("file:") else "file://" + os.path.abspath(found)


def fresh(spark: SparkSession, label: str) -> str:
    """A new path in the scratch folder."""
    return f"{scratch(spark).rstrip('/')}/streamgauge/{label}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: cuts lineage, survives lost executors, runs ``df`` once."""
    spark = df.sparkSession
    where = fresh(spark, label)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)

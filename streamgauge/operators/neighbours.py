"""Exact nearest neighbours of a stated query set against all rows, and what resampling builds on them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .ranking import ranked


def nearest(points: DataFrame, queries: DataFrame, key: str, vector: str, k: int, most_queries: int = 20_000) -> DataFrame:
    """q, n, d: the k nearest other rows of each query by Euclidean distance, equal ones by key.

    Queries are asked in blocks of ``most_queries``; each block of rows gives its k best to each query, and these are
    merged. Where there are several blocks, each one's result is stored in the scratch folder before the next is asked.
    """
    spark = points.sparkSession
    rest = queries.select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).toLocalIterator()
    asked = list(islice(rest, most_queries))
    if not asked:
        return spark.createDataFrame([], "q long, n long, d double")
    after = list(islice(rest, most_queries))
    if not after:
        return _nearest(points, asked, key, vector, k)
    found = kept(_nearest(points, asked, key, vector, k), "nearest")
    while after:
        found, after = found.unionByName(kept(_nearest(points, after, key, vector, k), "nearest")), list(islice(rest, most_queries))
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("_rn", F.row_number().over(Window.partitionBy("q").orderBy("d", "n"))).where(F.col("_rn") <= k).drop("_rn")


def _nearest(points: DataFrame, asked: list, key: str, vector: str, k: int) -> DataFrame:
    """The k nearest of one block of queries."""
    ids = np.array([r[0] for r in asked], np.int64)
    shared = points.sparkSession.sparkContext.broadcast((ids, np.array([r[1] for r in asked], np.float64)))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("k").to_numpy(zero_copy_only=False)
            rows = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).astype(np.float64)
            for at in range(0, len(ids), 256):
                d = np.sqrt(np.maximum(((matrix[at : at + 256, None, :] - rows[None, :, :]) ** 2).sum(axis=2), 0)) if rows.size * 256 < 5e7 else np.stack([np.sqrt(((rows - m) ** 2).sum(axis=1)) for m in matrix[at : at + 256]])
                d = np.where(ids[at : at + 256, None] == own[None, :], np.inf, d)
                best = np.lexsort((np.broadcast_to(own, d.shape), d), axis=1)[:, : min(k, d.shape[1])]
                dist = np.take_along_axis(d, best, axis=1).ravel()
                good = np.isfinite(dist)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 256], best.shape[1])[good]), pa.array(own[best].ravel()[good]), pa.array(dist[good])], names=["q", "n", "d"])

    found = points.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(block, "q long, n long, d double")
    return _best(found, k)


def smote(points: DataFrame, key: str, vector: str, y: str, wanted: int, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows: a point on the way from a minority row to one of its k nearest minority rows, ``wanted`` in all.

    of, to, vector, y: ``of`` and ``to`` are the two rows. Rows are dealt as evenly as can be, in hash order.
    """
    minority = points.where(F.col(y) == 1).select(key, vector)
    near = kept(nearest(minority, minority, key, vector, k), "smote-near")
    lists = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "n"))).alias("ns"))  # at most k entries a row
    n = max(lists.count(), 1)
    turned = ranked(lists.withColumn("_h", F.xxhash64("q", F.lit(seed))), ["_h", "q"], "_rn")
    turns = F.lit(wanted // n) + (F.col("_rn") <= wanted % n).cast("int")
    each = turned.withColumn("c", turns).where("c > 0").select("q", "ns", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("i"))
    each = each.select("q", "i", F.element_at("ns", (F.pmod(F.xxhash64("q", "i", F.lit(seed)), F.size("ns")) + 1).cast("int"))["n"].alias("n"), (F.pmod(F.xxhash64("i", "q", F.lit(seed + 1)), F.lit(1 << 20)) / float(1 << 20)).alias("u"))
    a, b = minority.select(F.col(key).alias("q"), F.col(vector).alias("va")), minority.select(F.col(key).alias("n"), F.col(vector).alias("vb"))
    kind = minority.schema[vector].dataType
    return each.join(a, "q").join(b, "n").select(F.col("q").alias("of"), F.col("n").alias("to"), F.zip_with("va", "vb", lambda x, z: x + F.col("u") * (z - x)).cast(kind).alias(vector), F.lit(1).cast(points.schema[y].dataType).alias(y))


def with_synthetic(points: DataFrame, key: str, vector: str, y: str, ratio: float = 1.0, k: int = 5, seed: int = 42) -> DataFrame:
    """key, vector, y: the rows, and synthetic ones until there are round(ratio n_neg) positives.

    Synthetic rows have negative keys from -1 down. Fewer than two positives give the rows as they are.
    """
    own = points.select(F.col(key).cast("long").alias(key), vector, y)
    r = points.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
    wanted = round(ratio * r[1]) - r[0]
    if wanted <= 0 or r[0] < 2:
        return own
    made = kept(smote(points, key, vector, y, wanted, min(k, r[0] - 1), seed), "smote")
    made = ranked(made, ["of", "to", F.xxhash64(vector)], "_rn").select((-F.col("_rn")).alias(key), vector, y)
    return own.unionByName(made)


def edited(points: DataFrame, key: str, vector: str, y: str, k: int = 3, rule: str = "all", scope: str = "all") -> DataFrame:
    """Rows that agree with their k nearest neighbours: with all of them, or with most (``mode``).

    ``scope``: ``all`` rows may go, or only those of the ``majority`` class (negatives on a draw).
    """
    near = nearest(points, points, key, vector, k)
    label = points.select(F.col(key).alias("n"), F.col(y).alias("_ny"))
    votes = near.join(label, "n").groupBy("q").agg(F.sum(F.col("_ny").cast("int")).alias("p"), F.count(F.lit(1)).alias("c"))
    own = points.join(votes, points[key] == votes["q"], "left")
    agree = F.when(F.col(y) == 1, F.col("p")).otherwise(F.col("c") - F.col("p"))
    keep = agree == F.col("c") if rule == "all" else 2 * agree > F.col("c")
    keep = F.coalesce(keep, F.lit(True))  # a row without neighbours stays
    if scope == "majority":
        r = points.agg(F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)).first()
        keep = keep | (F.col(y) != (0 if r[1] >= r[0] else 1))
    return own.where(keep).select(*points.columns)


def smote_edited(points: DataFrame, key: str, vector: str, y: str, ratio: float = 1.0, k: int = 5, k_edit: int = 3, rule: str = "all", seed: int = 42) -> DataFrame:
    """Synthetic rows appended, then rows of all classes that disagree with their neighbours removed."""
    both = kept(with_synthetic(points, key, vector, y, ratio, k, seed), "smote-both")
    return edited(both, key, vector, y, k_edit, rule, "all")

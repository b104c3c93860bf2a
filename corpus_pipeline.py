"""The training-data pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, packing.

Rows with a null key or text, repeated rows, empty and very long texts and other columns are treated in each stage as the
docstring of its operator says; an empty table passes through all stages. A column named ``_gone`` or with the name of one
that packing adds does not outlive its stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from streamgauge.llm import decontam, line_dedup, packing, quality, setjoin
from streamgauge.llm.common import table, work
from streamgauge.sources.scratch import fresh as scratch_place


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go. Short texts are no fault here: of the base rules' words one is enough."""
    return quality.passing(docs, least_words=1)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines shared with an earlier document go. Documents of whose words less than a fifth is left go as a whole:
    what remains of a copy with a few edits is scraps that no later stage could tell from a text. Null texts stay."""
    return line_dedup.without_common_lines(docs, least_left=0.2).drop("_gone")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, Jaccard similarity of 0.8 or more."""
    return setjoin.one_of_each(docs, size=5, num=4, den=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that consist of them for half go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as pieces of sequences of at most 4096 ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", packing_stage),
]

#: SQL can't express alignment, automata or packing; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each stored before the next; what a stage stored for itself goes when it is done."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        place = scratch_place(spark, "stage-" + name.replace(" ", "-"))
        with work(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(place)
        docs = spark.read.schema(made.schema).parquet(place)
    return docs

"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, mixing.

Each stage is f(spark, docs, sf_dir) -> DataFrame; its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`; the last adds `taken`, the words that the mix takes of a
document, and leaves out documents of which it takes none. Extra columns pass through all stages, texts are read whole,
and empty tables give empty results; what a stage does with nulls and repeated rows its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, linededup, mixing, neardup, quality
from siltstone.session import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules and the classifier keep; null and empty texts go. See `quality.keep_good`."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that stand earlier in like form; blank lines stay. See `linededup.dedup_lines`."""
    return linededup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each set of near copies; rows without a doc_id all stay. See `neardup.keep_one`."""
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window of the benchmark, each judged by its own text. See `decontaminate.drop_contaminated`."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the mix takes words of, with how many as `taken`. See `mixing.mixed_documents`."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
]

#: The quality model and the SimHash fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one. All stages but the last return the columns of ``documents``; the last adds shard and slot. Every stage keeps
extra columns, whatever their names, gives no rows for an empty table, and treats nulls, empty texts and repeated rows as
its docstring says.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from placeloom.llm import decontaminate, minhash, mixing, quality_rules, sharding
from placeloom.llm.common import stage, table
from placeloom.operators.staging import reads, release, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_LEFT: list[str] = []  # what the stage before staged on its way


def tidy(function: Stage) -> Stage:
    """A stage that begins by removing what the stage before it left in the shared folder, unless ``docs`` reads it."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, [p for p in _LEFT if not reads(docs, p)])
        before = set(staged())
        out = function(spark, docs, sf_dir)
        _LEFT[:] = [p for p in staged() if p not in before]
        return out

    return run


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the base rule and by the adaptive fences of their language and source.

    Null and empty texts fail the base rule; null languages and sources are groups; repeated rows share their verdict."""
    return quality_rules.filter_documents(docs)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each near-duplicate component.

    Texts without words and rows without a doc_id are kept; rows with one doc_id are one document and stay or go together."""
    return minhash.keep_first(docs)


@tidy
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that contain a benchmark item.

    Texts and items without words match nothing; repeated rows share their verdict; without items all documents stay."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources meet their target weights.

    A null source is a source of its own, last in order; texts without words have size 0, and a source of these alone has
    target 0, so none of its documents is taken; repeated rows share one coin."""
    return mixing.mix_documents(docs)


@tidy
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffles documents into shards of equal numbers of rows; repeated rows have places of their own."""
    return sharding.shard_documents(docs)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("benchmark decontamination", benchmark_leaks), ("mixing", mix), ("sharding", shard)]

#: SQL can't express the sharding draw; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage staged on its way, and its input, are removed once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), set(staged())
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, [p for p in staged()[:-1] if p not in before])
    return docs

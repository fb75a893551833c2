"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators.staging import stage

__all__ = ["SALT", "SALTS", "WHITE", "bounded_join", "salted", "spread", "stage", "stripped", "table", "words"]

# The white space of the word rule, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """array<string> of the maximal runs of characters outside [\\x20\\x09-\\x0D]; null text has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(flat, " "), "")


def stripped(text: Column, characters: str) -> Column:
    """``text`` without the given characters."""
    return F.translate(text, characters, "")


def bounded_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", max_rows: int = 50_000) -> DataFrame:
    """Null-safe equi-join against a table of statistics.

    ``right`` (already staged, so counting it is a metadata read) is broadcast only if it has at most ``max_rows`` rows;
    beyond that it is an ordinary shuffled join, which adaptive execution splits where a key is hot.
    """
    renamed = right.select(*[F.col(k).alias(f"__pl_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    if right.limit(max_rows + 1).count() <= max_rows:
        renamed = F.broadcast(renamed)
    on = None
    for k in keys:
        equal = left[k].eqNullSafe(renamed[f"__pl_{k}"])
        on = equal if on is None else on & equal
    return left.join(renamed, on, how).drop(*[f"__pl_{k}" for k in keys])


SALT = "__pl_salt"
SALTS = 256


def salted(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with a salt in 0 to SALTS - 1 from the column ``by``, which spreads the rows of a hot key."""
    return rows.withColumn(SALT, F.pmod(F.xxhash64(by, F.lit(97)), F.lit(SALTS)).cast("int"))


def spread(rows: DataFrame, per_key: DataFrame, *keys: str) -> DataFrame:
    """``per_key`` (one row per key) repeated for the salts that its key has in ``rows``, to be joined on keys and salt: no task
    of either join holds more than SALTS rows of a key on this side, or the rows of one salt on the other."""
    return rows.select(*keys, SALT).distinct().join(per_key, list(keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Data-quality checks. Each gives one row (check, target, failures); a report is their union, so it runs as one job."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(df: DataFrame, check: str, target: str, failures: Column) -> DataFrame:
    return df.agg(failures.cast("long").alias("failures")).select(F.lit(check).alias("check"), F.lit(target).alias("target"), F.coalesce("failures", F.lit(0).cast("long")).alias("failures"))


def expressions(df: DataFrame, table: str, not_null: tuple[str, ...] = (), not_empty: tuple[str, ...] = (), lengths: dict[str, int] | None = None, accepted: dict[str, list] | None = None, rows: tuple[int, int | None] | None = None) -> DataFrame:
    """Row-level checks of a table in one scan."""
    aggs = [(("not_null", c), F.count(F.when(F.col(c).isNull(), 1))) for c in not_null]
    aggs += [(("not_empty_string", c), F.count(F.when(F.trim(F.col(c)) == "", 1))) for c in not_empty]
    aggs += [(("value_length", c), F.count(F.when(F.length(c) != n, 1))) for c, n in (lengths or {}).items()]
    aggs += [(("accepted_values", c), F.count(F.when(~F.col(c).isin(*v), 1))) for c, v in (accepted or {}).items()]
    if rows:
        n = F.count(F.lit(1))
        aggs.append((("row_count", "*"), F.when((n < rows[0]) | (F.lit(rows[1]) < n if rows[1] is not None else F.lit(False)), 1).otherwise(0)))
    one = df.agg(*[a.cast("long").alias(f"c{i}") for i, (_, a) in enumerate(aggs)])
    pairs = F.array(*[F.struct(F.lit(k).alias("check"), F.lit(f"{table}.{c}").alias("target"), F.col(f"c{i}").alias("failures")) for i, ((k, c), _) in enumerate(aggs)])
    return one.select(F.explode(pairs).alias("r")).select("r.*")


def unique(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Keys that occur more than once; one column or a combination."""
    repeated = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__pl_n")).filter("__pl_n > 1")
    return _row(repeated, "unique" if len(columns) == 1 else "unique_combination", f"{table}.{'+'.join(columns)}", F.count(F.lit(1)))


def known_codes(df: DataFrame, table: str, column: str, codes: DataFrame, code: str) -> DataFrame:
    """Values that the reference table lacks."""
    bad = df.select(F.col(column).alias("__pl_v")).filter("__pl_v IS NOT NULL").join(codes.select(F.col(code).alias("__pl_v")), "__pl_v", "left_anti")
    return _row(bad, "known_codes", f"{table}.{column}", F.count(F.lit(1)))


def columns_exist(df: DataFrame, table: str, columns: list[str]) -> list[str]:
    """Columns that are missing; a schema check, no job."""
    return [f"{table}.{c}" for c in columns if c not in df.columns]


def condition(df: DataFrame, check: str, target: str, failed: Column) -> DataFrame:
    """Rows for which an arbitrary condition says that they fail."""
    return _row(df, check, target, F.count(F.when(failed, 1)))


def validation(df: DataFrame, name: str, value: Column, valid: Callable[[Column], Column]) -> DataFrame:
    """One row (name, is_valid, debug_value): an aggregate of a table, and whether ``valid`` holds for it."""
    found = df.agg(value.alias("v"))
    return found.select(F.lit(name).alias("name"), F.coalesce(valid(F.col("v")), F.lit(False)).alias("is_valid"), F.col("v").cast("string").alias("debug_value"))


def ordered(changes: DataFrame, cluster: str, order: str) -> DataFrame:
    """Clusters whose changes don't begin with exactly one of order 1, the parent's, before all others."""
    wrong = changes.groupBy(cluster).agg(F.min(order).alias("__pl_l"), F.count_if(F.col(order) <= 1).alias("__pl_n")).filter("__pl_l <> 1 OR __pl_n <> 1")
    return _row(wrong, "monotone_order", f"clusters.{order}", F.count(F.lit(1)))


def cluster_invariants(clusters: DataFrame, key: str, cluster: str = "cluster_id") -> DataFrame:
    """An entity is in one cluster, once; a cluster has two members at least."""
    once = unique(clusters, "clusters", [key])
    small = _row(clusters.groupBy(cluster).count().filter("count < 2"), "cluster_size", f"clusters.{cluster}", F.count(F.lit(1)))
    return once.unionAll(small)


def add_up(parts: list[DataFrame], whole: DataFrame) -> DataFrame:
    """Whether the parts have as many rows as the whole."""
    counts = reduce(lambda a, b: a.unionAll(b), [p.agg(F.count(F.lit(1)).alias("n")) for p in parts]).unionAll(whole.agg((-F.count(F.lit(1))).alias("n")))
    return _row(counts, "add_up", "parts", F.abs(F.sum("n")))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionAll(b), checks)

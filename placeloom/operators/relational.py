"""Relational shapes: overlay merge, roll-up, joins, aggregates, windows and set operations.

Everything is declarative, so filters and column pruning reach the scan and Catalyst picks the joins. A side is broadcast
only by Spark's own size check; nothing here hints it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.functions.text import coalesce_empty
from placeloom.operators.staging import stage


def overlay_merge(base: DataFrame, revision: DataFrame, key: str, prefer_base: tuple[str, ...] = ()) -> DataFrame:
    """Full outer overlay of sparse revisions over delivered rows.

    Text takes the revision if it is neither null nor empty, then the base, then ''; other types coalesce; columns in
    ``prefer_base`` take the base first. Adds ``revision_exists``. Columns of one side only are passed through.
    """
    b, r = base.alias("b"), revision.withColumn("__pl_rev", F.lit(True)).alias("r")
    joined = b.join(r, F.col(f"b.{key}") == F.col(f"r.{key}"), "full")
    out = [F.coalesce(F.col(f"r.{key}"), F.col(f"b.{key}")).alias(key)]
    kinds = {f.name: f.dataType for f in [*base.schema, *revision.schema]}
    for c in dict.fromkeys([*base.columns, *revision.columns]):
        if c == key:
            continue
        if c in base.columns and c in revision.columns:
            first, second = (F.col(f"b.{c}"), F.col(f"r.{c}")) if c in prefer_base else (F.col(f"r.{c}"), F.col(f"b.{c}"))
            out.append((coalesce_empty(first, second) if isinstance(kinds[c], T.StringType) else F.coalesce(first, second)).alias(c))
        else:
            out.append(F.col(f"{'b' if c in base.columns else 'r'}.{c}").alias(c))
    return joined.select(*out, F.coalesce(F.col("r.__pl_rev"), F.lit(False)).alias("revision_exists"))


def overlay_satellites(base: DataFrame, revision: DataFrame, entities: DataFrame, key: str, flag: str = "revision_exists") -> DataFrame:
    """Satellite rows of an overlay: those of the revision where one exists, else those of the base."""
    own = entities.select(key, flag)
    kept = base.join(own.filter(~F.col(flag)), key, "left_semi")
    return kept.unionByName(revision.join(own.filter(F.col(flag)), key, "left_semi"))


def roll_up_to_parent(facts: DataFrame, entities: DataFrame, key: str, parent: str, fact_cols: list[str]) -> DataFrame:
    """Set union of the children's facts under their parent; facts of entities without a parent keep their key."""
    linked = facts.join(entities.select(key, parent), key)
    return linked.select(F.coalesce(F.col(parent), F.col(key)).alias(key), *fact_cols).distinct()


def visible_entities(entities: DataFrame, key: str, parent: str, status: str, active: str = "ACTIF") -> DataFrame:
    """Active rows whose parent, if they have one, is active too (one level)."""
    parents = entities.filter(F.col(status) == active).select(F.col(key).alias("__pl_parent"))
    return entities.filter(F.col(status) == active).join(parents, F.col(parent) == F.col("__pl_parent"), "left").filter(F.col(parent).isNull() | F.col("__pl_parent").isNotNull()).drop("__pl_parent")


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """SQL NOT IN: null-aware, so one null on the right leaves no rows; null on the left never passes unless the right is empty."""
    keys = right.select(F.col(right_key).alias("__pl_k"))
    return left.join(keys, F.col(left_key) == F.col("__pl_k"), "left_anti") if not keys.schema["__pl_k"].nullable else _not_in_nullable(left, keys, left_key)


def _not_in_nullable(left: DataFrame, keys: DataFrame, left_key: str) -> DataFrame:
    facts = keys.agg(F.count(F.lit(1)).alias("__pl_n"), F.count(F.when(F.col("__pl_k").isNull(), 1)).alias("__pl_nulls"))  # one row
    passed = left.join(keys.filter("__pl_k IS NOT NULL"), F.col(left_key) == F.col("__pl_k"), "left_anti").crossJoin(facts)
    return passed.filter((F.col("__pl_n") == 0) | ((F.col("__pl_nulls") == 0) & F.col(left_key).isNotNull())).drop("__pl_n", "__pl_nulls")


def exists_flag(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """``left`` with a boolean that tells whether ``right`` has the key."""
    keys = right.select(F.col(key).alias("__pl_k")).distinct()
    return left.join(keys, F.col(key) == F.col("__pl_k"), "left").withColumn(name, F.col("__pl_k").isNotNull()).drop("__pl_k")


def top_one(df: DataFrame, partition: list[str], *order: Column) -> DataFrame:
    """The first row of each partition; ``order`` must end in a unique column for a defined result."""
    return df.withColumn("__pl_rn", F.row_number().over(W.partitionBy(*partition).orderBy(*order))).filter("__pl_rn = 1").drop("__pl_rn")


def surrogate_key(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """1, 2, 3, … in the given order without a single-partition window; rows that are equal in ``order`` are told apart by the other columns.

    Rows are range-partitioned, sorted and staged with their place in the partition, so that sizes and numbers are read from
    one and the same layout. Each partition's size (as many numbers as partitions) gives its offset.
    """
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType) and f.name not in order]
    by = [F.col(c).asc_nulls_last() for c in (*order, *plain)]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__pl_m", F.monotonically_increasing_id())
    placed = stage(placed, "numbered").withColumns({"__pl_p": F.shiftright("__pl_m", 33), "__pl_i": F.col("__pl_m").bitwiseAND((1 << 33) - 1)})
    sizes = placed.groupBy("__pl_p").agg(F.count(F.lit(1)).alias("__pl_n"))
    offsets = sizes.withColumn("__pl_o", F.coalesce(F.sum("__pl_n").over(W.orderBy("__pl_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__pl_p", "__pl_o")
    return placed.join(offsets, "__pl_p").withColumn(name, F.col("__pl_o") + F.col("__pl_i") + 1).drop("__pl_m", "__pl_p", "__pl_i", "__pl_o")


def group_and_total(df: DataFrame, keys: list[str], aggs: list[Column], total_labels: dict[str, Column]) -> DataFrame:
    """Group rows and one grand-total row in one pass (grouping sets)."""
    sets = df.groupingSets([[F.col(k) for k in keys], []], *[F.col(k) for k in keys]).agg(*aggs, F.grouping_id().alias("__pl_g"))
    return sets.select(*[F.when(F.col("__pl_g") == 0, F.col(k)).otherwise(total_labels[k]).alias(k) if k in total_labels else F.col(k) for k in keys], *[c for c in sets.columns if c not in (*keys, "__pl_g")])


def symmetric_difference(a: DataFrame, b: DataFrame, tag: str = "side") -> DataFrame:
    """Distinct rows of one side only, tagged ``left`` or ``right``."""
    return a.subtract(b).withColumn(tag, F.lit("left")).unionByName(b.subtract(a).withColumn(tag, F.lit("right")))


def discard_frequent(df: DataFrame, col: str, threshold: int) -> DataFrame:
    """Rows whose value occurs fewer than ``threshold`` times. Values are counted map-side and anti-joined, so a hot value isn't sorted."""
    often = df.groupBy(F.col(col).alias("__pl_v")).count().filter(F.col("count") >= threshold).select("__pl_v")
    return df.join(often, F.col(col).eqNullSafe(F.col("__pl_v")), "left_anti")


def keep_groups_of(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """Rows of groups with at least ``least`` rows."""
    sizes = df.groupBy(*keys).count().filter(F.col("count") >= least).drop("count")
    return df.join(sizes, keys, "left_semi")


def split_on(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Complementary halves; rows for which the condition is null are in the second."""
    return df.filter(condition), df.filter(~F.coalesce(condition, F.lit(False)))


def dynamic_filter(df: DataFrame, filters: list[dict]) -> DataFrame:
    """Conjunction of {field, operator: equals|contains|in, value}; contains is a case-insensitive pattern."""
    build = {"equals": lambda c, v: c == v, "contains": lambda c, v: c.rlike(f"(?i){v}"), "in": lambda c, v: c.isin(*v)}
    parts = [build[f["operator"]](F.col(f["field"]), f["value"]) for f in filters]
    return df.filter(reduce(lambda a, b: a & b, parts, F.lit(True)))


def drop_empty(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows in which all fields are filled."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in fields], F.lit(True)))


def add_original_columns(modified: DataFrame, original: DataFrame, on: str) -> DataFrame:
    """Columns that ``modified`` lacks, from ``original``."""
    return modified.join(original.select(on, *[c for c in original.columns if c not in modified.columns]), on, "left")


def listagg_distinct(df: DataFrame, keys: list[str], col: str, name: str, sep: str = "|") -> DataFrame:
    """Sorted distinct non-null values in one string."""
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(col)), sep).alias(name))


def nested_two_levels(df: DataFrame, key: str, action: str, category: str, name: str = "services") -> DataFrame:
    """array<struct<action, categories>> per key, both levels sorted and distinct."""
    inner = df.groupBy(key, action).agg(F.array_sort(F.collect_set(category)).alias("categories"))
    return inner.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(action).alias("action"), "categories"))).alias(name))


def object_agg(df: DataFrame, key: str, field: str, value: str, name: str = "object") -> DataFrame:
    """map<field, sorted distinct values> per key."""
    inner = df.groupBy(key, field).agg(F.array_sort(F.collect_set(value)).alias("v"))
    return inner.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, "v")))).alias(name))


def merge_duplicates(df: DataFrame, key: str, order: str, scalars: list[str], lists: list[str]) -> DataFrame:
    """One row per key: scalars of the first row by ``order``, sorted unions of list columns."""
    first = [F.min_by(c, order).alias(c) for c in scalars]
    union = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    return df.groupBy(key).agg(*first, *union)


def membership_partition(feed: DataFrame, store: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(create, update, delete): feed rows that are new, feed rows that are known, store rows that the feed lacks."""
    return feed.join(store, key, "left_anti"), feed.join(store, key, "left_semi"), store.join(feed, key, "left_anti")


def sub_population(entities: DataFrame, satellites: dict[str, tuple[DataFrame, str]], key: str, condition: Column) -> dict[str, DataFrame]:
    """A sample database: entities that meet a condition, and of every satellite the rows of these."""
    chosen = entities.filter(condition)
    keys = chosen.select(F.col(key).alias("__pl_k"))
    return {"entities": chosen} | {n: s.join(keys, F.col(fk) == F.col("__pl_k"), "left_semi") for n, (s, fk) in satellites.items()}


def remap_ids(df: DataFrame, new_id: Column, order: str, name: str = "new_id") -> DataFrame:
    """New ids; second and further rows with the same one get suffixes _1, _2, …"""
    n = F.row_number().over(W.partitionBy("__pl_new").orderBy(order)) - 1
    return df.withColumn("__pl_new", new_id).withColumn("__pl_n", n).withColumn(name, F.when(F.col("__pl_n") == 0, F.col("__pl_new")).otherwise(F.concat_ws("_", "__pl_new", "__pl_n"))).drop("__pl_new", "__pl_n")

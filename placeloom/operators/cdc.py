"""Change data: feed against store, change sets, survivorship, and their application as new snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(c: Column, kind: T.DataType) -> Column:
    """A form in which equal values are equal: arrays sorted, NaN as null, null text as empty."""
    if isinstance(kind, T.ArrayType):
        return F.array_sort(F.coalesce(c, F.array().cast(kind)))
    if isinstance(kind, T.DoubleType | T.FloatType):
        return F.when(~F.isnan(c), c)
    return F.coalesce(c, F.lit("")) if isinstance(kind, T.StringType) else c


def _is_empty(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.size(F.coalesce(c, F.array().cast(kind))) == 0
    return c.isNull() | (c == "") if isinstance(kind, T.StringType) else c.isNull()


def diff(feed: DataFrame, store: DataFrame, key: str, fields: list[str], protected: DataFrame | None = None) -> DataFrame:
    """Feed rows that differ from the store, each with ``changes``: array<struct<field, kind, old, new>>.

    kind is SUP (the feed is empty), AJOUT (the store is empty) or MODIF; rows that the store lacks have kind NEW for ``key``.
    Keys in ``protected`` are left out.
    """
    kinds = {f.name: f.dataType for f in feed.schema}
    if protected is not None:
        feed = feed.join(protected.select(key), key, "left_anti")
    joined = feed.alias("f").join(store.select(F.col(key).alias("__pl_key"), *[F.col(c).alias(f"__pl_{c}") for c in fields]), F.col(f"f.{key}") == F.col("__pl_key"), "left")
    text = lambda c, k: F.to_json(F.struct(c.alias("v"))) if isinstance(k, T.ArrayType | T.StructType) else c.cast("string")
    found = []
    for c in fields:
        new, old, k = F.col(f"f.{c}"), F.col(f"__pl_{c}"), kinds[c]
        kind = F.when(_is_empty(new, k), "SUP").when(_is_empty(old, k), "AJOUT").otherwise("MODIF")
        found.append(F.when(F.col("__pl_key").isNotNull() & ~canonical(new, k).eqNullSafe(canonical(old, k)), F.struct(F.lit(c).alias("field"), kind.alias("kind"), text(old, k).alias("old"), text(new, k).alias("new"))))
    fresh = F.when(F.col("__pl_key").isNull(), F.struct(F.lit(key).alias("field"), F.lit("NEW").alias("kind"), F.lit(None).cast("string").alias("old"), F.col(f"f.{key}").cast("string").alias("new")))
    changes = F.filter(F.array(fresh, *found), lambda x: x.isNotNull())
    return joined.withColumn("changes", changes).filter(F.size("changes") > 0).select("f.*", "changes")


def change_counters(changed: DataFrame) -> DataFrame:
    """(field, modif, sup, ajout) over the changes."""
    c = changed.select(F.explode("changes").alias("c")).select("c.field", "c.kind")
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(kind.lower())
    return c.filter("kind <> 'NEW'").groupBy("field").agg(n("MODIF"), n("SUP"), n("AJOUT"))


def reconcile_ids(feed: DataFrame, store: DataFrame, on: list[str], key: str) -> DataFrame:
    """Feed rows take the store's id where (source, external id) is known there."""
    known = store.select(*on, F.col(key).alias("__pl_known"))
    return feed.join(known, on, "left").withColumn(key, F.coalesce("__pl_known", key)).drop("__pl_known")


def partition(feed: DataFrame, store: DataFrame, key: str, status: str = "status", active: str = "ACTIF") -> DataFrame:
    """(key, action): create, update or delete; deletes are active store rows that the feed lacks."""
    f, s = feed.select(key, F.lit(True).alias("__pl_f")), store.select(key, (F.col(status) == active).alias("__pl_s"))
    both = f.join(s, key, "full")
    action = F.when(F.col("__pl_s").isNull() & F.col("__pl_f"), "create").when(F.col("__pl_f"), "update").when(F.col("__pl_s"), "delete")
    return both.select(key, action.alias("action")).filter("action IS NOT NULL")


def fan_out_sources(df: DataFrame, source: str, external: str, prefix: str, sep: str = r"\|") -> DataFrame:
    """One row per source of a multi-source row: source code prefixed, id rebuilt."""
    out = df.withColumn("__pl_s", F.explode(F.split(F.col(source), sep))).withColumn("__pl_s", F.trim("__pl_s")).filter("__pl_s <> ''")
    return out.withColumn(source, F.concat(F.lit(prefix), F.lower("__pl_s"))).drop("__pl_s").withColumn("id", F.concat_ws("_", source, external))


def _filled_in(fields: list[str]):
    return lambda c: c["field"].isin(*fields) & (F.coalesce(c["new"], F.lit("")) != "")


def field_suggestions(changed: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """(key, group, fields, values): one row for each field group of which a field changed to a filled value."""
    lists = []
    for name, fields in groups.items():
        hits = F.filter("changes", _filled_in(fields))
        lists.append(F.when(F.size(hits) > 0, F.struct(F.lit(name).alias("group"), F.transform(hits, lambda c: c["field"]).alias("fields"), F.transform(hits, lambda c: c["new"]).alias("values"))))
    return changed.select(key, F.explode(F.filter(F.array(*lists), lambda x: x.isNotNull())).alias("g")).select(key, "g.*")


def route_logs(logs: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """Log rows with the action of their entity, ``leftover`` where it has none."""
    return logs.join(actions.select(key, "action"), key, "left").withColumn("route", F.coalesce("action", F.lit("leftover"))).drop("action")


def survivorship(df: DataFrame, group: str, fields: list[str], rank: Column, keep_empty: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: each field's value of the best-ranked row that has one; fields in ``keep_empty`` may be ''.

    All fields in one aggregation; of rows with equal ``rank`` the least value wins."""
    aggs = []
    for c in fields:
        usable = F.col(c).isNotNull() if c in keep_empty else F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        aggs.append(F.min(F.when(usable, F.struct(rank.alias("rank"), F.col(c).alias("value"))))["value"].alias(c))
    return df.groupBy(group).agg(*aggs)


def choose_parents(clusters: DataFrame, cluster: str, key: str, is_parent: str, n_children: str, active: Column) -> DataFrame:
    """(cluster, parent_id, created): the only parent, or the active one with most children (the least key of equals), or a new id from the sorted members."""
    from placeloom.functions.ids import uuid5_of_set

    order = F.struct((~active).cast("int").alias("a"), (-F.col(n_children)).alias("n"), F.col(key).alias("k"))
    best = F.min_by(F.col(key), F.when(F.col(is_parent), order))
    return clusters.groupBy(cluster).agg(F.array_sort(F.collect_set(F.col(key).cast("string"))).alias("members"), best.alias("best")).select(cluster, F.coalesce(F.col("best").cast("string"), uuid5_of_set(F.col("members"))).alias("parent_id"), F.col("best").isNull().alias("created"))


def mark_changes(clusters: DataFrame, parents: DataFrame, cluster: str, key: str, is_parent: str) -> DataFrame:
    """Ordered changes of clusters: 1 keep or create the parent, 2 point to it, 3 delete other parents."""
    joined = clusters.join(parents, cluster)
    own = F.col(key).cast("string")
    kept = own == F.col("parent_id")
    rows = joined.select(cluster, own.alias("id"), F.when(kept, "parent_keep").when(F.col(is_parent), "parent_delete").otherwise("child_point").alias("change"), F.when(kept, 1).when(F.col(is_parent), 3).otherwise(2).alias("change_order"), "parent_id")
    made = parents.filter("created").select(cluster, F.col("parent_id").alias("id"), F.lit("parent_create").alias("change"), F.lit(1).alias("change_order"), "parent_id")
    return rows.unionByName(made)


def apply_changes(snapshot: DataFrame, changes: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """The next snapshot: for each key the last set value of every field, removed keys gone, new keys added.

    ``changes``: key, op (upsert or delete), order, and the fields (null: not set).
    """
    last = changes.groupBy(key).agg(F.max_by("op", order).alias("__pl_op"), *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"__pl_{c}") for c in fields])
    joined = snapshot.join(last, key, "full").filter(F.coalesce(F.col("__pl_op") != "delete", F.lit(True)))
    return joined.select(key, *[F.coalesce(F.col(f"__pl_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in snapshot.columns if c != key])


def stale_revisions(base: DataFrame, revision: DataFrame, key: str, modified: str, field: str) -> DataFrame:
    """Revisions older than their base whose field is filled and differs."""
    b = base.select(key, F.col(modified).alias("base_modified"), F.col(field).alias("base_value"))
    r = revision.select(key, F.col(modified).alias("revision_modified"), F.col(field).alias("revision_value"))
    return b.join(r, key).filter((F.col("revision_modified") < F.col("base_modified")) & (F.col("revision_value") != "") & (F.col("revision_value") != F.col("base_value")))


def url_cohorts(urls: DataFrame, results: DataFrame) -> DataFrame:
    """Classifies crawled urls; ``results`` (url, reached, final_url, and dns_ok if domains were resolved) comes from outside, as a table."""
    from placeloom.functions.text import url_is_valid, urls_standard_difference

    joined = urls.join(results, "url", "left")
    same, near = F.col("final_url") == F.col("url"), urls_standard_difference(F.col("url"), F.col("final_url"))
    dns_ok = F.coalesce("dns_ok", F.lit(False)) if "dns_ok" in results.columns else F.lit(True)
    cohort = F.when(~url_is_valid(F.col("url")), "syntax_fail").when(~dns_ok, "dns_fail").when(~F.coalesce("reached", F.lit(False)), "crawl_fail").when(same, "crawl_ok_same").when(near, "crawl_diff_standard").otherwise("crawl_diff_other")
    return joined.withColumn("cohort", cohort)


def changes_json(df: DataFrame, cols: list[str]) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def any_changed(fields: list[str], old: str = "old", new: str = "new") -> Column:
    return reduce(lambda a, b: a | b, [~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}")) for c in fields])


def create_overlay(base: DataFrame, satellites: dict[str, tuple[DataFrame, str]], wanted: DataFrame, key: str, revision: DataFrame) -> dict[str, DataFrame]:
    """New sparse revisions for ``wanted`` keys that have none, with copies of the base's satellite rows."""
    fresh = base.join(wanted.select(key), key, "left_semi").join(revision.select(key), key, "left_anti")
    keys = fresh.select(F.col(key).alias("__pl_k"))
    return {"revisions": fresh.select(key)} | {n: s.join(keys, F.col(fk) == F.col("__pl_k"), "left_semi") for n, (s, fk) in satellites.items()}


def drop_orphan_parents(revision: DataFrame, key: str, parent: str, is_parent: str) -> DataFrame:
    """Revisions without the parents that no row points to any more."""
    used = revision.filter(F.col(parent).isNotNull()).select(F.col(parent).alias("__pl_p")).distinct()
    orphans = revision.filter(F.col(is_parent)).join(used, F.col(key) == F.col("__pl_p"), "left_anti").select(F.col(key).alias("__pl_o"))
    return revision.join(orphans, F.col(key) == F.col("__pl_o"), "left_anti")


def from_cache(df: DataFrame, cache: DataFrame, on: list[str], fetched: str, now: Column, days: int = 30, score: str = "score", least: float = 0.5) -> DataFrame:
    """Rows with the geocoding result of a cache that is fresh and sure enough; the call itself stays outside, as a table."""
    from placeloom.functions.numbers import is_fresh

    usable = cache.filter(is_fresh(F.col(fetched), now, days) & (F.col(score) > least))
    return df.join(usable.drop(fetched), on, "left")


def cohort_changes(df: DataFrame, key: str, cohort: str, fields: dict[str, str]) -> DataFrame:
    """(key, cohort, changes as JSON): the fields whose suggestion differs from the present value."""
    parts = [F.when(F.col(s).isNotNull() & ~F.col(s).eqNullSafe(F.col(c)), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("old"), F.col(s).cast("string").alias("new"))) for c, s in fields.items()]
    changes = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return df.withColumn("changes", changes).filter(F.size("changes") > 0).select(key, F.lit(cohort).alias("cohort"), F.to_json("changes").alias("changes"))


def grouped_suggestions(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys grouped by the value that is proposed for them."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.array_sort(F.collect_set(key)).alias("keys"), F.countDistinct(key).alias("n"))

"""Graph operators: connected components and succession closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators.staging import stage


def _pointed(edges: DataFrame, upwards: bool) -> DataFrame:
    """One star step over edges u > v. Upwards: the neighbours above a node are tied to the least of its neighbourhood, itself
    included. Else: the node and its neighbours below are tied to the least of these."""
    near = edges.select(F.col("u").alias("at"), F.col("v").alias("other"))
    if upwards:
        near = near.unionAll(edges.select(F.col("v").alias("at"), F.col("u").alias("other")))
    least = near.groupBy("at").agg(F.least("at", F.min("other")).alias("least"))
    tied = near.join(least, "at")
    tied = tied.filter("other > at").select(F.col("other").alias("u"), F.col("least").alias("v")) if upwards else tied.select(F.explode(F.array("at", "other")).alias("u"), F.col("least").alias("v"))
    return tied.filter("u <> v").distinct()


def _is_flat(edges: DataFrame) -> bool:
    """Whether every node points to one node, which points nowhere."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 OR out + in > 1").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) with the least node id as the component, by alternating star steps; nodes without another are left out.

    Each round ties nodes nearer to their component's least one, so the edges shrink towards one per node, hubs are combined
    map-side, and the number of rounds grows with the logarithm of the graph. Rounds are staged, so lineage stays short.
    Raises if ``max_rounds`` rounds don't settle it.
    """
    u, v = F.col(src), F.col(dst)
    e = stage(edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _is_flat(e):
            break
        e = stage(_pointed(_pointed(e, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def succession_closure(spark: SparkSession, links: DataFrame, max_depth: int = 100) -> DataFrame:
    """Every predecessor with each of its final successors (those that have none themselves), by a recursive query with a cycle guard.

    ``links``: pred, succ, link_date, transfer, continuity. Result: pred, succ, earliest date, whether every link
    transferred, whether every link was continuous, and the depth of the longest path. Depth is what ends the recursion, so
    Spark's own limit of rows is lifted while the plan is made.
    """
    limit = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(limit, "-1")
    links.select("pred", "succ", "link_date", "transfer", "continuity").createOrReplaceTempView("__pl_links")
    return spark.sql(f"""
        WITH RECURSIVE paths AS (
          SELECT pred, succ, link_date, transfer, continuity, 1 AS depth, array(pred, succ) AS seen FROM __pl_links WHERE pred <> succ
          UNION ALL
          SELECT p.pred, l.succ, least(p.link_date, l.link_date), p.transfer AND l.transfer, p.continuity AND l.continuity, p.depth + 1, concat(p.seen, array(l.succ))
          FROM paths p JOIN __pl_links l ON l.pred = p.succ
          WHERE p.depth < {max_depth - 1} AND NOT array_contains(p.seen, l.succ))
        SELECT p.pred, p.succ, min(p.link_date) AS link_date, bool_or(p.transfer) AS transfer, bool_or(p.continuity) AS continuity, max(p.depth) AS depth
        FROM paths p LEFT ANTI JOIN __pl_links l ON l.pred = p.succ
        GROUP BY p.pred, p.succ""")

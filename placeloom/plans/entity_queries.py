"""Bindings of the graph, spatial, fuzzy, clustering, change-data, quality and search operators to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions import ids, numbers
from placeloom.operators import cdc, cluster, fuzzy, geo, graph, normalize, quality, search
from placeloom.operators import relational as rel
from placeloom.plans.registry import Tables, query

def duck_uuid5(name: str) -> str:
    """SQL of another engine for the UUID v5 of a text, from its definition."""
    h = f"sha1(unhex('{ids.DNS_NAMESPACE}') || encode({name}))"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', substr({h}, 17, 1)), 1) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


def duck_base57(uuid: str) -> str:
    """SQL for the 22 base57 digits of a UUID."""
    n = f"('0x' || replace({uuid}, '-', ''))::UHUGEINT"
    return " || ".join(f"substr('{ids.BASE57}', (({n} // {57**k}::UHUGEINT) % 57::UHUGEINT)::INTEGER + 1, 1)" for k in range(21, -1, -1))


def duck_valid_url(url: str) -> str:
    return rf"regexp_matches({url}, '^https?://([a-zA-Z0-9_-]+\.)+[a-zA-Z]{{2,}}(/[^\s]*)?$')"


_LINKS = "SELECT c_custkey AS pred, CASE WHEN c_custkey % 9 = 0 THEN c_custkey + 5 ELSE c_custkey + 3 END AS succ, DATE '2024-01-01' + (c_custkey % 300)::INTEGER AS link_date, c_custkey % 2 = 0 AS transfer, c_custkey % 7 <> 0 AS continuity FROM customer WHERE c_custkey % 5 < 3"


@query("recursive_succession", f"""
WITH RECURSIVE l AS ({_LINKS}),
p AS (SELECT *, 1 AS depth, [pred, succ] AS seen FROM l UNION ALL SELECT p.pred, l.succ, least(p.link_date, l.link_date), p.transfer AND l.transfer, p.continuity AND l.continuity, depth + 1, list_append(seen, l.succ) FROM p JOIN l ON l.pred = p.succ WHERE depth < 99 AND NOT list_contains(seen, l.succ))
SELECT pred, succ, strftime(min(link_date), '%Y-%m-%d') AS link_date, bool_or(transfer) AS transfer, bool_or(continuity) AS continuity, max(depth) AS depth FROM p WHERE succ NOT IN (SELECT pred FROM l) GROUP BY pred, succ""")
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    # The remainder shapes the chains: keys with a greater one are their ends.
    links = t.customer.filter(k % 5 < 3).select(k.alias("pred"), F.when(k % 9 == 0, k + 5).otherwise(k + 3).alias("succ"), F.expr("date_add(DATE '2024-01-01', CAST(c_custkey % 300 AS INT))").alias("link_date"), (k % 2 == 0).alias("transfer"), (k % 7 != 0).alias("continuity"))
    return graph.succession_closure(t.spark, links).withColumn("link_date", F.date_format("link_date", "yyyy-MM-dd"))


@query("connected_components", """
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS u, 1000000 + l_suppkey * 50 + l_partkey % 50 AS v FROM lineitem),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r AS (SELECT u AS node, u AS root FROM b UNION SELECT b.v, r.root FROM r JOIN b ON b.u = r.node WHERE r.root < b.v)
SELECT node, min(root) AS component FROM r GROUP BY node""")
def _(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_partkey").alias("src"), (1000000 + F.col("l_suppkey") * 50 + F.col("l_partkey") % 50).alias("dst"))
    return graph.connected_components(e)


_HAV = "2 * 6371000.0 * asin(least(1.0, sqrt(power(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * power(sin(radians({3} - {1}) / 2), 2))))"
_PROBES = "SELECT s_suppkey AS probe, 44.0 + (s_suppkey * 37 % 100) / 20.0 AS lat, 0.0 + (s_suppkey * 53 % 100) / 20.0 AS lon FROM supplier"
_POINTS = "SELECT c_custkey AS point, 44.0 + (c_custkey * 7919 % 1000) / 200.0 AS lat, 0.0 + (c_custkey * 104729 % 1000) / 200.0 AS lon, c_mktsegment AS action FROM customer"


def _points(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k.alias("point"), (44.0 + (k * 7919 % 1000) / 200.0).alias("lat"), (0.0 + (k * 104729 % 1000) / 200.0).alias("lon"), F.col("c_mktsegment").alias("action"))


def _probes(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("probe"), (44.0 + (k * 37 % 100) / 20.0).alias("lat"), (0.0 + (k * 53 % 100) / 20.0).alias("lon"))


@query("distance_nearest", f"""
WITH p AS ({_PROBES}), q AS ({_POINTS}), d AS (SELECT probe, action, point, {_HAV.format('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS m FROM p, q)
SELECT p_probe, action, point, round(m, 3) AS distance, n_solutions FROM (SELECT probe AS p_probe, action, point, m, row_number() OVER (PARTITION BY probe, action ORDER BY m, point) AS rn, count(*) OVER (PARTITION BY probe, action) AS n_solutions FROM d WHERE m <= 40000) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    near = geo.nearest_within(_probes(t), _points(t), 40_000.0, "probe", "action", "point")
    return near.select("p_probe", "action", "point", F.round("distance_m", 3).alias("distance"), "n_solutions")


@query("within_radius", f"WITH q AS ({_POINTS}) SELECT point, round({_HAV.format('46.5', '2.5', 'lat', 'lon')}, 3) AS distance FROM q WHERE {_HAV.format('46.5', '2.5', 'lat', 'lon')} <= 60000")
def _(t: Tables) -> DataFrame:
    return geo.within_radius(_points(t), 46.5, 2.5, 60_000.0).select("point", F.round("distance_m", 3).alias("distance"))


@query("in_box", f"WITH q AS ({_POINTS}) SELECT point FROM q WHERE lat BETWEEN 45.1 AND 46.2 AND lon BETWEEN 1.3 AND 3.4")
def _(t: Tables) -> DataFrame:
    return _points(t).filter(numbers.in_box(F.col("lat"), F.col("lon"), 45.1, 1.3, 46.2, 3.4)).select("point")


@query("in_polygon", f"WITH q AS ({_POINTS}) SELECT point FROM q WHERE lat > 44.013 AND lon > 0.013 AND (lat - 44.013) + (lon - 0.013) < 3.0")
def _(t: Tables) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.013, 44.013), (3.013, 44.013), (0.013, 47.013))])
    return _points(t).filter(numbers.in_polygon(F.col("lat"), F.col("lon"), ring)).select("point")


@query("stacked_members", "SELECT l_orderkey, l_linenumber, n FROM (SELECT *, count(*) OVER (PARTITION BY round(l_extendedprice::DECIMAL(38,10), 0), l_tax::DECIMAL(38,10)) AS n FROM lineitem) WHERE n > 1")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice").cast("decimal(38,10)"), 0).alias("a"), "l_tax")
    return geo.stacked(rows, ["a", "l_tax"]).select("l_orderkey", "l_linenumber", F.col("n_stacked").alias("n"))


@query("bounding_box", f"WITH q AS ({_POINTS}) SELECT min(lat) - (max(lat) - min(lat)) * 0.5 AS south, min(lon) - (max(lon) - min(lon)) * 0.5 AS west, max(lat) + (max(lat) - min(lat)) * 0.5 AS north, max(lon) + (max(lon) - min(lon)) * 0.5 AS east FROM q")
def _(t: Tables) -> DataFrame:
    return geo.bounding_box(_points(t), "lat", "lon", 0.5)


_TRI = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::BIGINT, 3)))))"


@query("trigram_best_match", f"""
WITH a AS (SELECT p_brand, p_partkey AS k, p_name, {_TRI.format('p_name')} AS g FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_brand, p_partkey AS r, p_name, {_TRI.format('p_name')} AS g FROM part WHERE p_partkey % 2 = 1),
s AS (SELECT a.p_brand, a.k, b.r, b.p_name, len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) AS score FROM a JOIN b USING (p_brand))
SELECT p_brand, k AS left_key, r AS right_key, p_name AS right_name, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, r) AS rn FROM s WHERE score > 0.3) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    a = t.part.filter("p_partkey % 2 = 0").select("p_brand", F.col("p_partkey").alias("left_key"), F.col("p_name").alias("left_name"))
    b = t.part.filter("p_partkey % 2 = 1").select("p_brand", F.col("p_partkey").alias("right_key"), F.col("p_name").alias("right_name"))
    return fuzzy.best_match(a, b, ["p_brand"], "left_key", "left_name", "right_key", "right_name").withColumn("score", F.round("score", 6))


_TFIDF = """
t AS (SELECT block, k, unnest(string_split(lower(name), ' ')) AS t FROM src), f AS (SELECT block, k, t, count(*) AS tf FROM t WHERE length(t) >= 2 GROUP BY ALL),
n AS (SELECT block, count(DISTINCT k) AS n FROM src GROUP BY 1), d AS (SELECT block, t, count(*) AS df FROM f GROUP BY ALL),
w AS (SELECT f.block, f.k, f.t, tf * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM f JOIN d ON f.block = d.block AND f.t = d.t JOIN n ON n.block = f.block),
u AS (SELECT block, k, t, w / sqrt(sum(w * w) OVER (PARTITION BY block, k)) AS u FROM w),
s AS (SELECT x.block, x.k AS a, y.k AS b, least(1.0, round(sum(x.u * y.u), 5)) AS score FROM u x JOIN u y ON x.block = y.block AND x.t = y.t AND x.k < y.k GROUP BY ALL)"""


@query("tfidf_pairs", f"WITH src AS (SELECT p_brand || '|' || p_size AS block, p_partkey AS k, p_name || ' ' || lower(p_type) AS name FROM part), {_TFIDF} SELECT block, a, b, score FROM s WHERE score >= 0.2")
def _(t: Tables) -> DataFrame:
    src = t.part.select(F.concat_ws("|", "p_brand", "p_size").alias("block"), "p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"))
    return fuzzy.tfidf_pairs(src, ["block"], "p_partkey", F.col("name"), 0.2)


@query("cluster_exact_fuzzy", f"""
WITH RECURSIVE src AS (SELECT p_brand || '|' || p_size AS block, p_partkey AS k, p_name || ' ' || lower(p_type) AS name FROM part), {_TFIDF},
e AS (SELECT a AS u, b AS v FROM s WHERE score >= 0.6 UNION ALL SELECT b, a FROM s WHERE score >= 0.6), r AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node WHERE r.root < e.v)
SELECT node AS p_partkey, min(root) AS cluster_root FROM r GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    parts = t.part.withColumn("name", F.concat_ws(" ", "p_name", F.lower("p_type")))
    out = cluster.cluster(parts, "p_partkey", ["p_brand", "p_size"], ["name"], 0.6)
    return out.select("p_partkey", F.element_at(F.split("cluster_id", "_f0_"), -1).cast("long").alias("cluster_root"))


@query("cluster_distance_split", f"""
WITH RECURSIVE q AS ({_POINTS}), e AS (SELECT a.point AS u, b.point AS v FROM q a JOIN q b ON a.action = b.action AND a.point <> b.point WHERE {_HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} < 1500), r AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node WHERE r.root < e.v)
SELECT node AS point, regexp_replace(lower(action), '[^a-z0-9]+', '-', 'g') || '_d_' || min(root) AS cluster_id FROM r JOIN q ON q.point = node GROUP BY node, action""")
def _(t: Tables) -> DataFrame:
    pts = _points(t).withColumn("zone", F.lit("z"))
    out = cluster.distance_refine(cluster.exact_clusters(pts, ["action"]), "point", "lat", "lon", 1500.0)
    return out.select("point", "cluster_id")


@query("cluster_one_per_source", """
WITH m AS (SELECT p_partkey, p_brand, p_size, p_type, row_number() OVER (PARTITION BY p_brand, p_size, p_type ORDER BY p_partkey) AS rn FROM part WHERE (p_brand, p_size) IN (SELECT (p_brand, p_size) FROM part GROUP BY p_brand, p_size HAVING count(*) >= 2))
SELECT p_partkey FROM m WHERE rn = 1 AND (p_brand, p_size) IN (SELECT (p_brand, p_size) FROM m WHERE rn = 1 GROUP BY p_brand, p_size HAVING count(*) >= 2)""")
def _(t: Tables) -> DataFrame:
    return cluster.one_per_source(cluster.exact_clusters(t.part, ["p_brand", "p_size"]), "p_partkey", "p_type").select("p_partkey")


_BLOCK = "lower(replace(p_brand, '#', '-')) || '_' || p_size"
_BLOCKED = "part WHERE (p_brand, p_size) IN (SELECT (p_brand, p_size) FROM part GROUP BY p_brand, p_size HAVING count(*) >= 2)"


@query("cluster_intra_source_split", f"""
WITH m AS (SELECT p_partkey, {_BLOCK} || '_' || (row_number() OVER (PARTITION BY p_brand, p_size, p_type ORDER BY p_partkey) - 1) AS cluster_id FROM {_BLOCKED}) SELECT * FROM m WHERE cluster_id IN (SELECT cluster_id FROM m GROUP BY 1 HAVING count(*) >= 2)""")
def _(t: Tables) -> DataFrame:
    c = cluster.exact_clusters(t.part.select("p_partkey", "p_brand", "p_size", "p_type"), ["p_brand", "p_size"]).select("p_partkey", "cluster_id", F.array("p_type").alias("sources"))
    return cluster.split_intra_source(c, "p_partkey", "sources").select("p_partkey", "cluster_id")


_PERTURBED = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN '' WHEN o_orderkey % 15 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 12 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 20 = 3 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 25 <> 24 UNION ALL SELECT o_orderkey + 90000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 100 = 0"


def _perturbed(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    old = t.orders.filter(k % 25 != 24).select("o_orderkey", "o_custkey", F.when(k % 10 == 0, "").when(k % 15 == 1, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(k % 12 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"), F.when(k % 20 != 3, F.col("o_orderpriority")).alias("o_orderpriority"))
    return old.unionByName(t.orders.filter(k % 100 == 0).select(cols).withColumn("o_orderkey", k + 90000000))


_FIELDS = ["o_orderstatus", "o_totalprice", "o_orderpriority"]
_CHANGES = f"""
f AS ({_PERTURBED}), j AS (SELECT f.*, s.o_orderkey AS k, s.o_orderstatus AS s1, s.o_totalprice AS s2, s.o_orderpriority AS s3 FROM f LEFT JOIN orders s USING (o_orderkey)),
c AS (SELECT o_orderkey, 'o_orderkey' AS field, 'NEW' AS kind FROM j WHERE k IS NULL
  UNION ALL SELECT o_orderkey, 'o_orderstatus', CASE WHEN o_orderstatus = '' THEN 'SUP' WHEN coalesce(s1, '') = '' THEN 'AJOUT' ELSE 'MODIF' END FROM j WHERE k IS NOT NULL AND coalesce(o_orderstatus, '') <> coalesce(s1, '')
  UNION ALL SELECT o_orderkey, 'o_totalprice', 'MODIF' FROM j WHERE k IS NOT NULL AND o_totalprice <> s2
  UNION ALL SELECT o_orderkey, 'o_orderpriority', CASE WHEN o_orderpriority IS NULL THEN 'SUP' ELSE 'MODIF' END FROM j WHERE k IS NOT NULL AND coalesce(o_orderpriority, '') <> coalesce(s3, ''))"""


@query("diff_changed", f"WITH {_CHANGES} SELECT * FROM c")
def _(t: Tables) -> DataFrame:
    return cdc.diff(_perturbed(t), t.orders, "o_orderkey", _FIELDS).select("o_orderkey", F.explode("changes").alias("c")).select("o_orderkey", "c.field", "c.kind")


@query("change_counters", f"WITH {_CHANGES} SELECT field, count(*) FILTER (kind = 'MODIF') AS modif, count(*) FILTER (kind = 'SUP') AS sup, count(*) FILTER (kind = 'AJOUT') AS ajout FROM c WHERE kind <> 'NEW' GROUP BY field")
def _(t: Tables) -> DataFrame:
    return cdc.change_counters(cdc.diff(_perturbed(t), t.orders, "o_orderkey", _FIELDS))


@query("diff_protected", f"WITH {_CHANGES} SELECT DISTINCT o_orderkey FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0)")
def _(t: Tables) -> DataFrame:
    return cdc.diff(_perturbed(t), t.orders, "o_orderkey", _FIELDS, t.orders.filter("o_custkey % 2 = 0")).select("o_orderkey")


@query("cdc_partition", f"""
WITH f AS ({_PERTURBED}) SELECT o_orderkey, CASE WHEN s.k IS NULL THEN 'create' WHEN f.k IS NOT NULL THEN 'update' ELSE 'delete' END AS action
FROM (SELECT o_orderkey, true AS k FROM f) f FULL JOIN (SELECT o_orderkey, true AS k, o_orderstatus FROM orders) s USING (o_orderkey) WHERE f.k IS NOT NULL OR s.o_orderstatus = 'O'""")
def _(t: Tables) -> DataFrame:
    return cdc.partition(_perturbed(t), t.orders, "o_orderkey", "o_orderstatus", "O")


@query("field_suggestions", f"""
WITH {_CHANGES}, v AS (SELECT c.o_orderkey, c.field FROM c JOIN f USING (o_orderkey) WHERE kind <> 'NEW' AND CASE field WHEN 'o_orderstatus' THEN o_orderstatus <> '' WHEN 'o_totalprice' THEN true ELSE coalesce(o_orderpriority, '') <> '' END)
SELECT o_orderkey, CASE WHEN field = 'o_totalprice' THEN 'amounts' ELSE 'texts' END AS "group", string_agg(field, ',' ORDER BY field DESC) AS fields FROM v GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    changed = cdc.diff(_perturbed(t), t.orders, "o_orderkey", _FIELDS)
    s = cdc.field_suggestions(changed, "o_orderkey", {"texts": ["o_orderstatus", "o_orderpriority"], "amounts": ["o_totalprice"]})
    return s.select("o_orderkey", "group", F.array_join("fields", ",").alias("fields"))


@query("source_fan_out", "SELECT o_orderkey, 'oca_' || lower(trim(s)) AS o_orderpriority, 'oca_' || lower(trim(s)) || '_' || o_orderkey AS id FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority || '| A |', '|')) AS s FROM orders) WHERE trim(s) <> ''")
def _(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.concat("o_orderpriority", F.lit("| A |")).alias("o_orderpriority"))
    return cdc.fan_out_sources(rows, "o_orderpriority", "o_orderkey", "oca_").select("o_orderkey", "o_orderpriority", "id")


@query("survivorship", """
WITH r AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS v, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END * 1000000000 + o_orderkey AS k FROM orders)
SELECT o_custkey, arg_min(p, k) FILTER (p <> '') AS p, arg_min(v, k) FILTER (v IS NOT NULL) AS v FROM r GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select("o_custkey", "o_orderkey", F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("p"), F.when(k % 4 != 0, F.col("o_totalprice")).alias("v"), F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2).alias("s"))
    return cdc.survivorship(rows, "o_custkey", ["p", "v"], F.struct("s", "o_orderkey"))


@query("apply_changes", """
WITH ch AS (SELECT o_orderkey, CASE WHEN o_orderkey % 30 = 0 THEN 'delete' ELSE 'upsert' END AS op, 1 AS ord, 'NEW' AS p, NULL::DOUBLE AS v FROM orders WHERE o_orderkey % 6 = 0 UNION ALL SELECT o_orderkey, 'upsert', 2, NULL, 5.0 FROM orders WHERE o_orderkey % 9 = 0),
l AS (SELECT o_orderkey, arg_max(op, ord) AS op, arg_max(p, ord) FILTER (p IS NOT NULL) AS p, arg_max(v, ord) FILTER (v IS NOT NULL) AS v FROM ch GROUP BY 1)
SELECT o_orderkey, coalesce(l.p, o_orderpriority) AS o_orderpriority, coalesce(l.v, o_totalprice) AS o_totalprice FROM orders LEFT JOIN l USING (o_orderkey) WHERE op IS NULL OR op <> 'delete'""")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    one = t.orders.filter(k % 6 == 0).select("o_orderkey", F.when(k % 30 == 0, "delete").otherwise("upsert").alias("op"), F.lit(1).alias("ord"), F.lit("NEW").alias("o_orderpriority"), F.lit(None).cast("double").alias("o_totalprice"))
    two = t.orders.filter(k % 9 == 0).select("o_orderkey", F.lit("upsert").alias("op"), F.lit(2).alias("ord"), F.lit(None).cast("string").alias("o_orderpriority"), F.lit(5.0).alias("o_totalprice"))
    return cdc.apply_changes(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), one.unionAll(two), "o_orderkey", ["o_orderpriority", "o_totalprice"], "ord")


@query("choose_parents", f"""
WITH c AS (SELECT {_BLOCK} AS cluster_id, p_partkey AS id, p_partkey % 7 = 0 AS is_parent, trunc(p_retailprice)::BIGINT % 10 AS n FROM {_BLOCKED}),
b AS (SELECT cluster_id, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) AS members, (arg_min(id, -n * 1000000000 + id) FILTER (is_parent))::VARCHAR AS best FROM c GROUP BY 1), p AS (SELECT *, coalesce(best, {duck_uuid5('members')}) AS parent_id FROM b)
SELECT cluster_id, id::VARCHAR AS id, CASE WHEN id::VARCHAR = parent_id THEN 'parent_keep' WHEN is_parent THEN 'parent_delete' ELSE 'child_point' END AS change, CASE WHEN id::VARCHAR = parent_id THEN 1 WHEN is_parent THEN 3 ELSE 2 END AS change_order, parent_id FROM c JOIN p USING (cluster_id)
UNION ALL SELECT cluster_id, parent_id, 'parent_create', 1, parent_id FROM p WHERE best IS NULL""")
def _(t: Tables) -> DataFrame:
    c = cluster.exact_clusters(t.part, ["p_brand", "p_size"]).select("cluster_id", F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7 == 0).alias("is_parent"), (F.col("p_retailprice").cast("int") % 10).alias("n_children"))
    parents = cdc.choose_parents(c, "cluster_id", "id", "is_parent", "n_children", F.lit(True))
    return cdc.mark_changes(c, parents, "cluster_id", "id", "is_parent")


@query("stale_revisions", """
WITH b AS (SELECT o_orderkey, o_orderdate AS m, o_orderstatus AS v FROM orders), r AS (SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5 - 2) AS m, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'F' END AS v FROM orders)
SELECT o_orderkey, b.v AS base_value, r.v AS revision_value FROM b JOIN r USING (o_orderkey) WHERE r.m < b.m AND r.v <> '' AND r.v <> b.v""")
def _(t: Tables) -> DataFrame:
    b = t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus")
    r = t.orders.select("o_orderkey", F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 5 - 2 AS INT))").alias("o_orderdate"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("F").alias("o_orderstatus"))
    return cdc.stale_revisions(b, r, "o_orderkey", "o_orderdate", "o_orderstatus").select("o_orderkey", "base_value", "revision_value")


@query("url_cohorts", r"""
WITH u AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'nothing' ELSE url END AS url FROM pages), r AS (SELECT DISTINCT url, length(url) % 3 <> 0 AS reached, CASE length(url) % 4 WHEN 0 THEN url WHEN 1 THEN upper(url) || '/' ELSE 'https://else.example.org' END AS final_url FROM u)
SELECT page_id, CASE WHEN NOT regexp_matches(u.url, '^https?://([a-zA-Z0-9_-]+\.)+[a-zA-Z]{2,}(/[^\s]*)?$') THEN 'syntax_fail' WHEN NOT reached THEN 'crawl_fail' WHEN final_url = u.url THEN 'crawl_ok_same'
  WHEN regexp_replace(lower(u.url), '^https?://(www\.)?|/$', '', 'g') = regexp_replace(lower(final_url), '^https?://(www\.)?|/$', '', 'g') THEN 'crawl_diff_standard' ELSE 'crawl_diff_other' END AS cohort FROM u JOIN r USING (url)""")
def _(t: Tables) -> DataFrame:
    u = t.pages.select("page_id", F.when(F.col("page_id") % 11 == 0, "nothing").otherwise(F.col("url")).alias("url"))
    n = F.length("url")
    r = u.select("url", (n % 3 != 0).alias("reached"), F.when(n % 4 == 0, F.col("url")).when(n % 4 == 1, F.concat(F.upper("url"), F.lit("/"))).otherwise("https://else.example.org").alias("final_url")).distinct()
    return cdc.url_cohorts(u, r).select("page_id", "cohort")


@query("ingest_rules_errors", """
WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bad' WHEN 1 THEN 'A@b.fr ' WHEN 2 THEN '' ELSE 'none' END AS mail, CASE event_id % 5 WHEN 0 THEN '123' ELSE '1234' END AS cp FROM events)
SELECT event_id, 'email' AS field, 'warning' AS level FROM e WHERE mail = 'bad' UNION ALL SELECT event_id, 'postcode', 'error' FROM e WHERE cp = '123'""")
def _(t: Tables) -> DataFrame:
    return _ingest(t)[1].select("event_id", "field", "level")


@query("ingest_rules_rows", """
SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'a@b.fr' ELSE '' END AS email, '01234' AS postcode, 'fixed' AS source FROM events WHERE event_id % 5 <> 0""")
def _(t: Tables) -> DataFrame:
    return _ingest(t)[0]


def _ingest(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("event_id")
    feed = t.events.select("event_id", F.when(k % 4 == 0, "bad").when(k % 4 == 1, "A@b.fr ").when(k % 4 == 2, "").otherwise("none").alias("mail"), F.when(k % 5 == 0, "123").otherwise("1234").alias("cp"))
    rules = [{"rule": "transform", "origin": "mail", "destination": "email", "function": "email"}, {"rule": "transform", "origin": "cp", "destination": "postcode", "function": "postcode", "level": "error"}, {"rule": "default", "destination": "source", "value": "fixed"}, {"rule": "remove", "origin": "cp"}]
    return normalize.normalize(feed, rules, "event_id")


@query("dq_report", """
SELECT 'not_null' AS "check", 'orders.o_custkey' AS target, count(*) FILTER (o_custkey IS NULL) AS failures FROM orders
UNION ALL SELECT 'not_empty_string', 'orders.o_orderstatus', count(*) FILTER (trim(o_orderstatus) = '') FROM orders UNION ALL SELECT 'value_length', 'orders.o_orderpriority', count(*) FILTER (length(o_orderpriority) <> 5) FROM orders
UNION ALL SELECT 'accepted_values', 'orders.o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM orders UNION ALL SELECT 'row_count', 'orders.*', CASE WHEN count(*) < 100 THEN 1 ELSE 0 END FROM orders
UNION ALL SELECT 'unique', 'orders.o_custkey', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unique_combination', 'lineitem.l_orderkey+l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'known_codes', 'orders.o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'positive', 'lineitem.l_tax', count(*) FILTER (l_tax <= 0) FROM lineitem
UNION ALL SELECT 'add_up', 'parts', 0""")
def _(t: Tables) -> DataFrame:
    o = t.orders
    return quality.report(
        quality.expressions(o, "orders", ("o_custkey",), ("o_orderstatus",), {"o_orderpriority": 5}, {"o_orderstatus": ["O", "F"]}, (100, None)),
        quality.unique(o, "orders", ["o_custkey"]),
        quality.unique(t.lineitem, "lineitem", ["l_orderkey", "l_linenumber"]),
        quality.known_codes(o, "orders", "o_custkey", t.customer.filter("c_acctbal > 0"), "c_custkey"),
        quality.condition(t.lineitem, "positive", "lineitem.l_tax", F.col("l_tax") <= 0),
        quality.add_up(list(rel.split_on(o, F.col("o_totalprice") > 100000)), o),
    )


@query("faceted_search", """
SELECT p_partkey FROM part WHERE NOT (p_size > 45) AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_suppkey % 10 = 3)""")
def _(t: Tables) -> DataFrame:
    li = t.lineitem.withColumnRenamed("l_partkey", "p_partkey")
    return search.faceted(t.part, "p_partkey", [(li, F.col("l_returnflag") == "R"), (li, F.col("l_suppkey") % 10 == 3)], F.col("p_size") > 45).select("p_partkey")


@query("closest_points", f"WITH q AS ({_POINTS}) SELECT point, round({_HAV.format('46.5', '2.5', 'lat', 'lon')}, 3) AS distance FROM q WHERE {_HAV.format('46.5', '2.5', 'lat', 'lon')} <= 90000 ORDER BY {_HAV.format('46.5', '2.5', 'lat', 'lon')}, point LIMIT 10")
def _(t: Tables) -> DataFrame:
    return search.closest(geo.within_radius(_points(t), 46.5, 2.5, 90_000.0), 10, "point").select("point", F.round("distance_m", 3).alias("distance"))


@query("location_cascade", f"""
WITH q AS ({_POINTS}), b AS (SELECT point FROM q WHERE lat BETWEEN 10 AND 11 AND lon BETWEEN 10 AND 11), r AS (SELECT point FROM q WHERE {_HAV.format('46.5', '2.5', 'lat', 'lon')} <= 30000)
SELECT point FROM b UNION ALL SELECT point FROM r WHERE NOT EXISTS (SELECT 1 FROM b) UNION ALL SELECT point FROM q WHERE NOT EXISTS (SELECT 1 FROM b) AND NOT EXISTS (SELECT 1 FROM r)""")
def _(t: Tables) -> DataFrame:
    p = _points(t)
    box = p.filter(numbers.in_box(F.col("lat"), F.col("lon"), 10.0, 10.0, 11.0, 11.0)).select("point")
    return search.first_with_rows(box, geo.within_radius(p, 46.5, 2.5, 30_000.0).select("point"), p.select("point"))


@query("fuzzy_search_rank")
def _(t: Tables) -> DataFrame:
    terms = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lower("p_type").alias("body"), (1.0 / (1 + F.col("p_size") / 50)).alias("norm"))
    return search.rank_terms(terms, "red wid", "title", "body", "norm").select("id", F.round("score", 6).alias("score"))


_CODES = "[114, 101, 100, 32, 119, 105, 100, 103, 101, 116]"  # red widget


@query("edit_ratio", f"""
WITH d AS (SELECT p_partkey, p_name, list_transform(string_split(p_name, ''), lambda c: [unicode(c)::BIGINT]) AS cs FROM part),
l AS (SELECT p_partkey, p_name, list_reduce(cs, lambda acc, e: list_transform(range(0, 11), lambda j: list_max(list_append(list_transform(list_filter(range(1, j + 1), lambda i: ({_CODES})[i] = e[1]), lambda i: acc[i] + 1), acc[j + 1]))), [0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[])[11] AS lcs FROM d)
SELECT p_partkey, round(200.0::DOUBLE * lcs / (10 + length(p_name)), 4) AS ratio FROM l WHERE round(200.0::DOUBLE * lcs / (10 + length(p_name)), 4) >= 50""")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(fuzzy.indel_ratio(F.col("p_name"), F.lit("red widget")), 4).alias("ratio")).filter("ratio >= 50")


@query("searchable_terms", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax > 0.07) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def _(t: Tables) -> DataFrame:
    return search.searchable(t.part.select("p_partkey"), (t.lineitem.filter("l_tax > 0.07"), "p_partkey", "l_partkey"), (t.lineitem.filter("l_discount > 0.09"), "p_partkey", "l_partkey"))

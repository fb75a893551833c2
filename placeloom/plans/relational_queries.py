"""Bindings of the relational operators to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import numbers
from placeloom.functions.text import words_in_common
from placeloom.operators import relational as rel
from placeloom.plans.registry import Tables, query

_REVISION = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'REV ' || c_name END AS c_name, c_nationkey,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal + 1 END AS c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'REVISED' END AS c_mktsegment
  FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey + 10000000, 'PARENT ' || c_name, c_nationkey, c_acctbal, '' FROM customer WHERE c_custkey % 50 = 0"""


def revision(t: Tables) -> DataFrame:
    """A sparse revision of customers, with some parents that the base lacks."""
    c, k = t.customer, F.col("c_custkey")
    sparse = c.filter(k % 3 == 0).select("c_custkey", F.when(k % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("REV "), "c_name")).alias("c_name"), "c_nationkey", F.when(k % 7 != 0, F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(k % 5 != 0, F.lit("REVISED")).alias("c_mktsegment"))
    made = c.filter(k % 50 == 0).select((k + 10000000).alias("c_custkey"), F.concat(F.lit("PARENT "), "c_name").alias("c_name"), "c_nationkey", "c_acctbal", F.lit("").alias("c_mktsegment"))
    return sparse.unionByName(made)


def overlay(t: Tables) -> DataFrame:
    return rel.overlay_merge(t.customer, revision(t), "c_custkey", prefer_base=("c_nationkey",))


@query("overlay_merge", f"""
WITH r AS ({_REVISION})
SELECT coalesce(r.c_custkey, b.c_custkey) AS c_custkey, coalesce(nullif(r.c_name, ''), b.c_name, '') AS c_name, coalesce(b.c_nationkey, r.c_nationkey) AS c_nationkey,
  coalesce(r.c_acctbal, b.c_acctbal) AS c_acctbal, coalesce(nullif(r.c_mktsegment, ''), b.c_mktsegment, '') AS c_mktsegment, r.c_custkey IS NOT NULL AS revision_exists
FROM customer b FULL JOIN r ON b.c_custkey = r.c_custkey""")
def _(t: Tables) -> DataFrame:
    return overlay(t)


@query("overlay_satellites", f"""
WITH r AS ({_REVISION}), e AS (SELECT c_custkey AS k, true AS x FROM r UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM r))
SELECT o_custkey, o_orderkey, 'base' AS origin FROM orders JOIN e ON o_custkey = k WHERE NOT x
UNION ALL SELECT o_custkey, o_orderkey, 'revision' FROM orders JOIN e ON o_custkey = k WHERE x AND o_orderkey % 2 = 0""")
def _(t: Tables) -> DataFrame:
    entities = overlay(t).select(F.col("c_custkey").alias("o_custkey"), "revision_exists")
    base = t.orders.select("o_custkey", "o_orderkey", F.lit("base").alias("origin"))
    revised = t.orders.filter(F.col("o_orderkey") % 2 == 0).select("o_custkey", "o_orderkey", F.lit("revision").alias("origin"))
    return rel.overlay_satellites(base, revised, entities, "o_custkey")


@query("parent_rollup", """
WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 <> 0 AND c_nationkey < 15 THEN c_custkey - c_custkey % 10 END AS p FROM customer)
SELECT DISTINCT coalesce(p, k) AS o_custkey, o_orderpriority FROM orders JOIN e ON o_custkey = k""")
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    entities = t.customer.select(k.alias("o_custkey"), F.when((k % 10 != 0) & (F.col("c_nationkey") < 15), k - k % 10).alias("parent"))
    return rel.roll_up_to_parent(t.orders.select("o_custkey", "o_orderpriority"), entities, "o_custkey", "parent", ["o_orderpriority"])


@query("parent_visibility", """
WITH e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey - c_custkey % 10 END AS p, CASE WHEN c_acctbal > 0 THEN 'ACTIF' ELSE 'INACTIF' END AS status FROM customer)
SELECT a.k, a.p, a.status FROM e a LEFT JOIN e b ON a.p = b.k WHERE a.status = 'ACTIF' AND (a.p IS NULL OR b.status = 'ACTIF')""")
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    e = t.customer.select(k.alias("k"), F.when(k % 10 != 0, k - k % 10).alias("p"), F.when(F.col("c_acctbal") > 0, "ACTIF").otherwise("INACTIF").alias("status"))
    return rel.visible_entities(e, "k", "p", "status")


@query("priority_bool_or", """
SELECT o_custkey, CASE WHEN bool_or(o_orderpriority = '1-URGENT') THEN 'urgent' WHEN bool_or(o_orderstatus = 'O') THEN 'open' WHEN bool_or(o_totalprice > 400000) THEN 'large' ELSE 'plain' END AS category
FROM orders GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    any_ = F.bool_or
    first = F.when(any_(F.col("o_orderpriority") == "1-URGENT"), "urgent").when(any_(F.col("o_orderstatus") == "O"), "open").when(any_(F.col("o_totalprice") > 400000), "large").otherwise("plain")
    return t.orders.groupBy("o_custkey").agg(first.alias("category"))


@query("null_tolerant_filters", """
WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN 'a_domicile' ELSE 'Sur_Place' END AS place, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_acctbal > 0 END AS shown FROM supplier)
SELECT s_suppkey, place FROM s WHERE (shown IS TRUE OR s_suppkey % 5 = 0) AND (place <> 'Sur_Place' OR place IS NULL) AND (place IS NULL OR upper(place) NOT IN ('AUCUN', 'SUR_PLACE'))""")
def _(t: Tables) -> DataFrame:
    k, place = F.col("s_suppkey"), F.col("place")
    s = t.supplier.select("s_suppkey", F.when(k % 3 == 1, "a_domicile").when(k % 3 == 2, "Sur_Place").alias("place"), F.when(k % 4 != 0, F.col("s_acctbal") > 0).alias("shown"))
    return s.filter((F.coalesce("shown", F.lit(False)) | (k % 5 == 0)) & ~place.eqNullSafe(F.lit("Sur_Place")) & (place.isNull() | ~F.upper(place).isin("AUCUN", "SUR_PLACE"))).select("s_suppkey", "place")


@query("negated_conjunction", """SELECT o_orderkey FROM orders WHERE NOT (strftime(o_orderdate, '%Y-%m-%d') < '1996-01-01' AND o_orderstatus = 'F')""")
def _(t: Tables) -> DataFrame:
    return t.orders.filter(~((F.date_format("o_orderdate", "yyyy-MM-dd") < "1996-01-01") & (F.col("o_orderstatus") == "F"))).select("o_orderkey")


@query("semi_in", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def _(t: Tables) -> DataFrame:
    large = t.orders.filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(large, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("anti_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey < 0 THEN NULL ELSE o_custkey END FROM orders WHERE o_orderstatus = 'P')")
def _(t: Tables) -> DataFrame:
    keys = t.orders.filter("o_orderstatus = 'P'").select(F.when(F.col("o_orderkey") >= 0, F.col("o_custkey")).alias("k"))
    return rel.not_in(t.customer.select("c_custkey"), keys, "c_custkey", "k")


@query("anti_not_in_with_null", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_orderkey = 0 THEN NULL ELSE o_custkey END FROM orders)")
def _(t: Tables) -> DataFrame:
    keys = t.orders.select(F.when(F.col("o_orderkey") != 0, F.col("o_custkey")).alias("k"))
    return rel.not_in(t.customer.select("c_custkey"), keys, "c_custkey", "k")


@query("exists_flag", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS has_urgent FROM customer")
def _(t: Tables) -> DataFrame:
    urgent = t.orders.filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return rel.exists_flag(t.customer.select("c_custkey"), urgent, "c_custkey", "has_urgent")


@query("anti_left_null", "SELECT p_partkey FROM part LEFT JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45 WHERE l_partkey IS NULL")
def _(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("multi_key_replacement_top1", """
WITH c AS (SELECT a.p_partkey AS closed, b.p_partkey AS candidate, CASE WHEN a.p_type = b.p_type THEN 1 ELSE 0 END AS same,
    len(list_filter(string_split(a.p_name, ' '), lambda w: w <> '' AND contains(b.p_name, w))) AS common
  FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey % 2 = 0 AND b.p_partkey % 2 = 1)
SELECT closed, candidate, same::BIGINT AS same, common::BIGINT AS common FROM (SELECT *, row_number() OVER (PARTITION BY closed ORDER BY same DESC, common DESC, candidate) AS rn FROM c) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_type")
    a = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("closed"), F.col("p_name").alias("n1"), F.col("p_type").alias("t1"), "p_brand", "p_size")
    b = p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("candidate"), F.col("p_name").alias("n2"), F.col("p_type").alias("t2"), "p_brand", "p_size")
    c = a.join(b, ["p_brand", "p_size"]).select("closed", "candidate", F.when(F.col("t1") == F.col("t2"), 1).otherwise(0).cast("long").alias("same"), words_in_common(F.col("n1"), F.col("n2")).alias("common"))
    return rel.top_one(c, ["closed"], F.desc("same"), F.desc("common"), F.asc("candidate"))


@query("residual_theta_join", "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal <> c_acctbal AND (abs(s_acctbal - c_acctbal) < 50 OR upper(c_mktsegment) = 'MACHINERY' AND c_acctbal > 9900)")
def _(t: Tables) -> DataFrame:
    s, c = F.col("s_acctbal"), F.col("c_acctbal")
    j = t.supplier.join(t.customer, F.col("s_nationkey") == F.col("c_nationkey"))
    return j.filter((s != c) & ((F.abs(s - c) < 50) | ((F.upper("c_mktsegment") == "MACHINERY") & (c > 9900)))).select("s_suppkey", "c_custkey")


@query("computed_key_join", "SELECT o_orderkey, l_linenumber, l_partkey FROM orders JOIN lineitem ON concat('PS_', o_orderkey) = concat('PS_', l_orderkey) WHERE o_orderpriority = '2-HIGH'")
def _(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderpriority = '2-HIGH'").select("o_orderkey", F.concat(F.lit("PS_"), "o_orderkey").alias("k"))
    return o.join(t.lineitem.select("l_linenumber", "l_partkey", F.concat(F.lit("PS_"), "l_orderkey").alias("k")), "k").select("o_orderkey", "l_linenumber", "l_partkey")


@query("left_join_chain", """
SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def _(t: Tables) -> DataFrame:
    o = t.orders.join(t.customer.filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("cross_scalar_rates", """
WITH a AS (SELECT count(*) AS total FROM orders), b AS (SELECT count(*) AS urgent FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT count(*) AS empty FROM orders WHERE o_totalprice < 0)
SELECT total, urgent, round(urgent::DOUBLE / total * 100, 2) AS rate_urgent, CASE WHEN empty = 0 THEN 0.0 ELSE round(urgent::DOUBLE / empty * 100, 2) END::DOUBLE AS rate_of_empty FROM a, b, c""")
def _(t: Tables) -> DataFrame:
    n = F.count(F.lit(1))
    one = t.orders.agg(n.alias("total"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count_if(F.col("o_totalprice") < 0).alias("empty"))
    rate = lambda a, b: numbers.ratio_percent(F.col(a), F.col(b)).cast("double")
    return one.select("total", "urgent", rate("urgent", "total").alias("rate_urgent"), rate("urgent", "empty").alias("rate_of_empty"))


@query("having_stacked", "SELECT l_discount, l_tax, count(*) AS n FROM lineitem WHERE l_quantity > 49 GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_quantity > 49").groupBy("l_discount", "l_tax").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("unique_value_guard", "SELECT l_orderkey, max(l_suppkey) AS only_supplier FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def _(t: Tables) -> DataFrame:
    # Equal minimum and maximum say the same as a distinct count of one, without the second exchange.
    g = t.lineitem.groupBy("l_orderkey").agg(F.max("l_suppkey").alias("only_supplier"), F.min("l_suppkey").alias("least"))
    return g.filter("only_supplier = least").drop("least")


@query("avg_by_group_plus_total", """
SELECT l_returnflag, round(avg(l_quantity), 2) AS avg_quantity, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT 'ALL', round(avg(l_quantity), 2), count(*) FROM lineitem""")
def _(t: Tables) -> DataFrame:
    return rel.group_and_total(t.lineitem, ["l_returnflag"], [F.round(F.avg("l_quantity"), 2).alias("avg_quantity"), F.count(F.lit(1)).alias("n")], {"l_returnflag": F.lit("ALL")})


@query("listagg_distinct", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return rel.listagg_distinct(t.orders, ["o_custkey"], "o_orderpriority", "priorities")


@query("nested_two_level", """
WITH i AS (SELECT o_custkey, o_orderpriority AS a, string_agg(DISTINCT o_orderstatus, '+' ORDER BY o_orderstatus) AS c FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(a || ':' || c, ',' ORDER BY a) AS services FROM i GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    nested = rel.nested_two_levels(t.orders, "o_custkey", "o_orderpriority", "o_orderstatus")
    return nested.select("o_custkey", F.array_join(F.transform("services", lambda s: F.concat(s["action"], F.lit(":"), F.array_join(s["categories"], "+"))), ",").alias("services"))


@query("map_object_agg", """
WITH i AS (SELECT o_custkey, o_orderpriority AS a, string_agg(DISTINCT o_orderstatus, '+' ORDER BY o_orderstatus) AS c FROM orders GROUP BY 1, 2)
SELECT o_custkey, max(CASE WHEN a = '1-URGENT' THEN c END) AS urgent, count(*) AS n_keys FROM i GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    m = rel.object_agg(t.orders, "o_custkey", "o_orderpriority", "o_orderstatus")
    return m.select("o_custkey", F.array_join(F.try_element_at("object", F.lit("1-URGENT")), "+").alias("urgent"), F.size("object").cast("long").alias("n_keys"))


@query("struct_list_count", "SELECT c_nationkey, count(*) AS n_children, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS children FROM customer WHERE c_acctbal > 5000 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    g = t.customer.filter("c_acctbal > 5000").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("children"))
    return g.select("c_nationkey", F.size("children").cast("long").alias("n_children"), F.array_join(F.transform("children", lambda x: x["c_custkey"].cast("string")), ",").alias("children"))


@query("membership_flags", """
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS in_map, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS in_open_data,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_children FROM customer""")
def _(t: Tables) -> DataFrame:
    # One pass over orders gives both flags and the count.
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("m"), F.bool_or(F.col("o_totalprice") > 400000).alias("d"), F.count(F.lit(1)).alias("n"))
    return t.customer.select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("m", F.lit(False)).alias("in_map"), F.coalesce("d", F.lit(False)).alias("in_open_data"), F.coalesce("n", F.lit(0)).alias("n_children"))


@query("wide_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_tax, l_discount, l_linenumber FROM lineitem")
def _(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_tax", "l_discount", "l_linenumber").distinct()


@query("first_union_merge", """
SELECT l_orderkey, arg_min(l_shipdate, l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + date_diff('day', TIMESTAMP '1970-01-01', l_shipdate)) AS first_ship, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_shipdate", (F.col("l_linenumber").cast("long") * 1000000000000 + F.col("l_partkey") * 100000 + F.unix_date(F.to_date("l_shipdate"))).alias("o"), F.array("l_returnflag").alias("flags"))
    return rel.merge_duplicates(rows, "l_orderkey", "o", ["l_shipdate"], ["flags"]).select("l_orderkey", F.col("l_shipdate").alias("first_ship"), F.array_join("flags", ",").alias("flags"))


@query("count_over_partition_top1", """
SELECT o_custkey, o_orderkey, o_totalprice, n_orders FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n_orders FROM orders) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    # The cheapest order and the number of orders in one aggregation, so nothing is sorted.
    g = t.orders.groupBy("o_custkey").agg(F.min(F.struct("o_totalprice", "o_orderkey")).alias("m"), F.count(F.lit(1)).alias("n_orders"))
    return g.select("o_custkey", "m.o_orderkey", "m.o_totalprice", "n_orders")


@query("surrogate_key_global", "SELECT row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS id, l_partkey, l_orderkey, l_linenumber FROM lineitem")
def _(t: Tables) -> DataFrame:
    order = ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    return rel.surrogate_key(t.lineitem.select(*order), order).select("id", "l_partkey", "l_orderkey", "l_linenumber")


@query("surrogate_after_group", "SELECT row_number() OVER (ORDER BY l_partkey, l_suppkey) AS id, l_partkey, l_suppkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def _(t: Tables) -> DataFrame:
    return rel.surrogate_key(t.lineitem.select("l_partkey", "l_suppkey").distinct(), ["l_partkey", "l_suppkey"])


@query("top1_by_score", """
SELECT l_partkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""")
def _(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_partkey").agg(F.min(F.struct((-F.col("l_extendedprice")).alias("s"), "l_orderkey", "l_linenumber", "l_extendedprice")).alias("m"))
    return g.select("l_partkey", "m.l_orderkey", "m.l_extendedprice")


@query("keep_first_dedup", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey")).select("o_custkey", "o_orderkey")


@query("argmax_with_fallback", """
SELECT c_nationkey, arg_max(c_custkey, (CASE WHEN c_mktsegment = 'BUILDING' THEN 1000000.0 ELSE 0.0 END) + c_acctbal - c_custkey / 1e9) AS chosen FROM customer GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    best = F.max_by("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", 1000000.0).otherwise(0.0) + F.col("c_acctbal") - F.col("c_custkey") / 1e9)
    return t.customer.groupBy("c_nationkey").agg(best.alias("chosen"))


@query("topk_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1000")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey").orderBy(F.desc("o_orderkey")).limit(1000)


@query("mixed_order_page", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey ASC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_custkey", "o_totalprice").orderBy(F.col("o_custkey").asc_nulls_last(), F.desc("o_totalprice"), "o_orderkey").offset(20).limit(10)


@query("custom_priority_sort", """
SELECT o_custkey, arg_min(o_orderkey, coalesce(nullif(list_position(['4-NOT SPECIFIED', '1-URGENT', '5-LOW'], o_orderpriority), 0), 99)::BIGINT * 1000000000 + o_orderkey) AS first_order FROM orders GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    at = F.array_position(F.array(*[F.lit(p) for p in ("4-NOT SPECIFIED", "1-URGENT", "5-LOW")]), F.col("o_orderpriority"))
    return t.orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(F.when(at == 0, 99).otherwise(at), "o_orderkey")).alias("first_order"))


@query("except_symmetric", """
WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N')
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def _(t: Tables) -> DataFrame:
    of = lambda flag: t.lineitem.filter(F.col("l_returnflag") == flag).select("l_partkey", "l_suppkey")
    return rel.symmetric_difference(of("A"), of("N"))


@query("union_distinct_tagged", "SELECT c_nationkey AS nation, 'customer' AS origin FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("origin")).union(t.supplier.select("s_nationkey", F.lit("supplier"))).distinct()


@query("aligned_concat", "SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def _(t: Tables) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("array_set_difference", """
WITH g AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'O'))) AS a, list_sort(list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F'))) AS b FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x)), ',') AS only_open FROM g""")
def _(t: Tables) -> DataFrame:
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.array_except(of("O"), of("F"))), ",").alias("only_open"))


@query("frequent_value_discard", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 12)")
def _(t: Tables) -> DataFrame:
    return rel.discard_frequent(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", 12)


@query("group_size_filter", "SELECT p_partkey, p_brand, p_size FROM part WHERE (p_brand, p_size) IN (SELECT (p_brand, p_size) FROM part GROUP BY p_brand, p_size HAVING count(*) >= 3)")
def _(t: Tables) -> DataFrame:
    return rel.keep_groups_of(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand", "p_size"], 3)


@query("dynamic_filters", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND regexp_matches(p_name, '(?i)RING|bolt') AND p_size IN (1, 5, 11, 28)")
def _(t: Tables) -> DataFrame:
    return rel.dynamic_filter(t.part, [{"field": "p_type", "operator": "equals", "value": "ECONOMY"}, {"field": "p_name", "operator": "contains", "value": "RING|bolt"}, {"field": "p_size", "operator": "in", "value": [1, 5, 11, 28]}]).select("p_partkey")


@query("value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("parents_without_children", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t: Tables) -> DataFrame:
    kids = lambda s: t.orders.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(kids("F"), "c_custkey", "left_anti").join(kids("P"), "c_custkey", "left_anti")


@query("sub_population", """
SELECT 'entities' AS part, count(*) AS n FROM customer WHERE c_nationkey IN (3, 7) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 7))""")
def _(t: Tables) -> DataFrame:
    parts = rel.sub_population(t.customer, {"orders": (t.orders, "o_custkey")}, "c_custkey", F.col("c_nationkey").isin(3, 7))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n") for n, df in parts.items()]
    return counts[0].unionAll(counts[1])


@query("remap_with_suffix", """
SELECT c_custkey, CASE WHEN rn = 1 THEN base ELSE base || '_' || (rn - 1) END AS new_id FROM (SELECT c_custkey, 'n' || c_nationkey || '_' || (c_custkey // 40) AS base, row_number() OVER (PARTITION BY 'n' || c_nationkey || '_' || (c_custkey // 40) ORDER BY c_custkey) AS rn FROM customer)""")
def _(t: Tables) -> DataFrame:
    base = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("_"), F.floor(F.col("c_custkey") / 40).cast("string"))
    return rel.remap_ids(t.customer.select("c_custkey", "c_nationkey"), base, "c_custkey").select("c_custkey", "new_id")


@query("two_way_split", "SELECT (c_acctbal > 3000 AND c_acctbal IS NOT NULL) AS first_half, count(*) AS n FROM customer GROUP BY 1")
def _(t: Tables) -> DataFrame:
    a, b = rel.split_on(t.customer, F.col("c_acctbal") > 3000)
    count = lambda df, flag: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(flag).alias("first_half"), "n")
    return count(a, True).unionAll(count(b, False))


@query("running_total_window", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def _(t: Tables) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    return t.orders.select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))

"""Bound queries on fixtures with keys beyond any id range, against brute force."""

import datetime
import math
from collections import defaultdict

import duckdb
import pytest

from placeloom.operators import geo
from placeloom.plans import queries as engine
from tests import oracle


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    spark.range(1, 901).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "id % 25 AS c_nationkey", "id % 7 - 1.0 AS c_acctbal", "concat('s', id % 5) AS c_mktsegment").write.parquet(f"{out}/customer.parquet")
    spark.range(1, 91).selectExpr("id AS s_suppkey").write.parquet(f"{out}/supplier.parquet")
    spark.range(1, 901).selectExpr("id AS p_partkey", "concat('type', id) AS p_type", "CAST(id % 50 AS INT) AS p_size", "concat('brand', id % 25) AS p_brand", "concat('part ', id) AS p_name").write.parquet(f"{out}/part.parquet")
    return out


def test_recursive_succession_of_all_keys(spark, folder):
    succ = {k: k + (5 if k % 9 == 0 else 3) for k in range(1, 901) if k % 5 < 3}
    want = set()
    for k in succ:
        chain = [k]
        while succ.get(chain[-1]):
            chain.append(succ[chain[-1]])
        links = chain[:-1]
        day = min(datetime.date(2024, 1, 1) + datetime.timedelta(x % 300) for x in links)
        want.add((k, chain[-1], str(day), all(x % 2 == 0 for x in links), all(x % 7 for x in links), len(links)))
    got = {tuple(r) for r in engine.queries()["recursive_succession"](spark, folder).collect()}
    assert got == want and max(r[0] for r in got) > 890


def within(metres):
    """{(probe, action): [(distance, point)]} by comparing every probe with every point."""
    out = defaultdict(list)
    for p in range(1, 91):
        for q in range(1, 901):
            a, x, b, y = 44 + p * 37 % 100 / 20, p * 53 % 100 / 20, 44 + q * 7919 % 1000 / 200, q * 104729 % 1000 / 200
            h = math.sin(math.radians(b - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(b)) * math.sin(math.radians(y - x) / 2) ** 2
            m = 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))
            if m <= metres:
                out[p, f"s{q % 5}"].append((m, q))
    return out


def test_distance_nearest_of_all_probes(spark, folder):
    want = {key: (min(found)[0], len(found)) for key, found in within(40_000).items()}
    got = {(r["p_probe"], r["action"]): (r["distance"], r["n_solutions"]) for r in engine.queries()["distance_nearest"](spark, folder).collect()}
    assert got.keys() == want.keys() and max(p for p, _ in got) > 80
    assert all(abs(got[k][0] - want[k][0]) < 0.01 and got[k][1] == want[k][1] for k in want)


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """Tables in which many keys share a place, a name and a block, and their views for SQL."""
    out = str(tmp_path_factory.mktemp("crowded"))
    spark.range(20_000).selectExpr("id AS c_custkey", "concat('s', hash(id) % 3) AS c_mktsegment").write.parquet(f"{out}/customer.parquet")
    spark.range(1000).selectExpr("id AS s_suppkey").write.parquet(f"{out}/supplier.parquet")
    spark.range(6000).selectExpr("id AS p_partkey", "concat('b', id % 5) AS p_brand", "CAST(id % 2 AS INT) AS p_size", "element_at(array('red bolt', 'bolt red', 'Red bolt', '', '??', '東京', NULL, concat('part ', id % 997), concat('rod ', id % 499)), CAST(hash(id) & 1023 AS INT) % 9 + 1) AS p_name").write.parquet(f"{out}/part.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{out}/{t}.parquet/*.parquet'")
    return out, con


def most_rows(df):
    """The most rows that a node of the plan made when ``df`` was collected."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        todo += inner + [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_first_service_distance_of_crowded_places(spark, crowded):
    folder, con = crowded
    df = engine.queries()["first_service_distance"](spark, folder)
    oracle.same(df, con, engine.oracle_sql()["first_service_distance"])
    assert most_rows(df) < 300_000  # 20 million pairs of keys, 3 million of them in reach


def test_distance_nearest_of_crowded_places(spark, crowded):
    folder, con = crowded
    df = engine.queries()["distance_nearest"](spark, folder)
    oracle.same(df, con, engine.oracle_sql()["distance_nearest"])
    assert most_rows(df) < 100_000  # 20 million pairs of keys, 400 thousand of them in reach


def test_nearest_within_is_nearest_of_the_distance_join(spark):
    """Ids of several places, places of several ids, and values that are null."""
    probes = spark.range(60).selectExpr("id % 50 AS probe", "44.0 + id * 7 % 20 / 40 AS lat", "-0.2 + id * 3 % 20 / 40 AS lon")
    points = spark.range(400).selectExpr("399 - id AS point", "44.0 + id * 11 % 37 / 60 AS lat", "id * 13 % 41 / 60 AS lon", "CASE WHEN id % 4 < 3 THEN id % 4 END AS action")
    want = geo.nearest(geo.distance_join(probes, points, 20_000.0), ["p_probe", "action"], "point")
    got = geo.nearest_within(probes, points, 20_000.0, "probe", "action", "point")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(got.columns).collect()} and got.count() == want.count() > 100


def test_pair_similarities_of_crowded_blocks(spark, crowded):
    """Names that differ only in case or order of words aren't equal; names without a trigram can be."""
    folder, con = crowded
    df, sql = engine.queries()["pair_similarities"](spark, folder), engine.oracle_sql()["pair_similarities"]
    oracle.same(df, con, sql)
    assert most_rows(df) == con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] > 100_000  # of 1.8 million pairs of a block


def test_first_service_distance_of_all_probes(spark, folder):
    near = {key: (min(found)[0], len(found)) for key, found in within(100_000).items()}
    got = {r["action"]: r for r in engine.queries()["first_service_distance"](spark, folder).collect()}
    for action in ("TOUTES_ACTIONS", *(f"s{i}" for i in range(5))):
        of = [v for (_, a), v in near.items() if action in (a, "TOUTES_ACTIONS")]
        assert abs(got[action]["mean_distance"] - sum(m for m, _ in of) / len(of)) < 0.01 and abs(got[action]["mean_solutions"] - sum(n for _, n in of) / len(of)) < 0.01


def test_enrichment_from_the_whole_register(spark, folder):
    rows = lambda name, *cols: [tuple(r) for r in engine.queries()[name](spark, folder).select("identifiant_unique", *cols).collect()]
    keys, siren = range(1, 901), lambda k: str(100_000_000 + k - k % 3)
    siret = lambda k: siren(k) + f"{k % 3:05}"
    live = defaultdict(list)
    for k in keys:
        if k % 7 < 3:
            live[siren(k)].append(k)
    postcode = lambda k: k % 25  # noqa: E731, of an actor and of a site
    closed = {(f"a{k}", siret(k), None, "closed_site" if live[siren(k)] else "closed_company") for k in keys if k % 7 > 2 and k % 3 and k % 7 - 1 > 0}
    assert set(rows("closed_site_cohorts", "siret", "remplacant_siret", "suggest_cohort")) == closed and len({x[3] for x in closed}) == 2
    assert set(rows("siren_from_siret", "siret", "siren")) == {(f"a{k}", siret(k), siren(k)) for k in keys if k % 6 == 1 and live[siren(k)]}
    want = set()
    for k in keys:
        if k % 3 == 0:
            near = live[siren(k)] if len(live[siren(k)]) == 1 else [x for x in live[siren(k)] if postcode(x) == postcode(k)]
            want |= {(f"a{k}", siren(k), siret(x)) for x in near if len(near) == 1}
    assert set(rows("siret_from_siren", "siren", "siret")) == want
    assert set(rows("director_names", "siren")) == {(f"a{k}", siren(k)) for k in keys if k % 6 != 1 and k % 17}


def test_components_of_all_rows(spark, data):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for p, s in oracle.connect(data).execute("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem").fetchall():
        a, b = sorted((find(p), find(1000000 + s * 50 + p % 50)))
        root[b] = a
    assert {tuple(r) for r in engine.queries()["connected_components"](spark, data).collect()} == {(x, find(x)) for x in list(root)}


def test_anti_join_reads_all_orders(spark, tmp_path):
    out = str(tmp_path)
    spark.range(1, 11).selectExpr("id AS c_custkey").write.parquet(f"{out}/customer.parquet")
    spark.range(1, 6).selectExpr("id + 1000 AS o_orderkey", "id AS o_custkey").write.parquet(f"{out}/orders.parquet")
    assert sorted(r[0] for r in engine.queries()["anti_not_in_with_null"](spark, out).collect()) == [6, 7, 8, 9, 10]

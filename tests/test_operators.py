import datetime

import pytest
from pyspark.sql import functions as F

from placeloom.operators import cdc, cluster, fuzzy, geo, graph, normalize, quality, search
from placeloom.operators import relational as rel
from placeloom.sources import readers, writers
from placeloom.streaming import kpis


def test_succession_fixture(spark):
    d = datetime.date
    n = lambda i: str(i) * 14
    rows = [(n(1), n(5), d(2024, 1, 1), True, True), (n(1), n(2), d(2024, 2, 1), True, True), (n(2), n(3), d(2024, 3, 1), True, True), (n(3), n(4), d(2024, 4, 1), False, True)]
    links = spark.createDataFrame(rows, "pred string, succ string, link_date date, transfer boolean, continuity boolean")
    got = {tuple(r) for r in graph.succession_closure(spark, links).collect()}
    assert got == {(n(1), n(5), d(2024, 1, 1), True, True, 1), (n(1), n(4), d(2024, 2, 1), False, True, 3), (n(2), n(4), d(2024, 3, 1), False, True, 2), (n(3), n(4), d(2024, 4, 1), False, True, 1)}
    cycle = spark.createDataFrame([("a", "b", d(2024, 1, 1), True, True), ("b", "a", d(2024, 1, 1), True, True)], links.schema)
    assert graph.succession_closure(spark, cycle).count() == 0


def test_cluster_fixtures(spark):
    rows = [("id1", "Paris"), ("id2", "Paris"), ("id3", "Laval"), ("id4", "Laval"), ("id5", "Nice")]
    got = cluster.exact_clusters(spark.createDataFrame(rows, "id string, ville string"), ["ville"]).collect()
    assert {(r["id"], r["cluster_id"]) for r in got} == {("id1", "paris"), ("id2", "paris"), ("id3", "laval"), ("id4", "laval")}
    names = ["auchan magasin", "auchan boutique", "carrefour depot", "carrefour entrepot"]
    df = spark.createDataFrame([(f"id{i}", n, "c") for i, n in enumerate(names)], "id string, nom string, cluster_id string")
    pairs = {(r["a"], r["b"]): r["score"] for r in fuzzy.tfidf_pairs(df, ["cluster_id"], "id", F.col("nom"), 0.2).collect()}
    assert pairs == {("id0", "id1"): 0.38332, ("id2", "id3"): 0.38332}
    groups = {}
    for r in cluster.fuzzy_refine(df, "id", ["nom"], 0.2).collect():
        groups.setdefault(r["cluster_id"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [["id0", "id1"], ["id2", "id3"]]
    places = [(0, 48.8566, 2.3522), (1, 48.8567, 2.3522), (2, 43.2965, 5.3698), (3, 43.2966, 5.3698), (4, None, None)]
    pts = spark.createDataFrame([(*p, "c") for p in places], "id int, lat double, lon double, cluster_id string")
    groups = {}
    for r in cluster.distance_refine(pts, "id", "lat", "lon", 100.0).collect():
        groups.setdefault(r["cluster_id"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[0, 1], [2, 3]]
    with pytest.raises(ValueError, match="missing"):
        cluster.exact_clusters(df, ["absent"])


def test_components_chain_and_permutation(spark):
    chain = [(i, i + 1) for i in range(40)]
    a = {tuple(r) for r in graph.connected_components(spark.createDataFrame(chain, "src int, dst int")).collect()}
    b = {tuple(r) for r in graph.connected_components(spark.createDataFrame([(y, x) for x, y in reversed(chain)], "src int, dst int")).collect()}
    assert a == b == {(i, 0) for i in range(41)}


def test_diff_properties(spark):
    rows = [("a", ["x", "y"], 1.0, "n"), ("b", [], None, "")]
    kind = "id string, codes array<string>, lat double, nom string"
    a = spark.createDataFrame(rows, kind)
    b = spark.createDataFrame([("a", ["y", "x"], 1.0, "n"), ("b", None, float("nan"), None)], kind)
    assert cdc.diff(a, a, "id", ["codes", "lat", "nom"]).count() == 0
    assert cdc.diff(a, b, "id", ["codes", "lat", "nom"]).count() == 0
    c = spark.createDataFrame([("a", ["x"], 2.0, ""), ("c", ["x"], 2.0, "")], kind)
    got = {(r["id"], x["field"], x["kind"]) for r in cdc.diff(c, a, "id", ["codes", "lat", "nom"]).collect() for x in r["changes"]}
    assert got == {("a", "codes", "MODIF"), ("a", "lat", "MODIF"), ("a", "nom", "SUP"), ("c", "id", "NEW")}


def test_surrogate_key_and_not_in(spark):
    got = rel.surrogate_key(spark.createDataFrame([(x,) for x in (5, 3, None, 9, 3)], "v int"), ["v"]).orderBy("id").collect()
    assert [(r["id"], r["v"]) for r in got] == [(1, 3), (2, 3), (3, 5), (4, 9), (5, None)]
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    assert rel.not_in(left, spark.createDataFrame([(1,), (None,)], "b int"), "a", "b").count() == 0
    assert rel.not_in(left, spark.createDataFrame([], "b int"), "a", "b").count() == 3


def test_similarities(spark):
    df = spark.createDataFrame([("word", "two words")], "a string, b string")
    r = df.select(F.round(fuzzy.trigram_similarity(F.col("a"), F.col("b")), 6), fuzzy.word_similarity(F.col("a"), F.col("b")), fuzzy.indel_ratio(F.lit("abcd"), F.lit("abxd"))).first()
    assert r[0] == 0.363636 and abs(r[1] - 0.8) < 1e-9 and r[2] == 75.0


def test_distance_join_equals_cross_join(spark):
    import random

    rng = random.Random(1)
    pts = [(i, rng.uniform(60, 62), rng.uniform(-1, 1)) for i in range(200)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    from placeloom.functions.numbers import haversine_m

    a = {(r["p_id"], r["id"]) for r in geo.distance_join(df, df, 8000.0).collect()}
    x, y = df.toDF("i", "a", "b"), df.toDF("j", "c", "d")
    b = {(r["i"], r["j"]) for r in x.crossJoin(y).filter(haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")) <= 8000).collect()}
    assert a == b


def test_rules_are_validated():
    with pytest.raises(ValueError, match="unknown function"):
        normalize.validate_rules([{"rule": "transform", "origin": "a", "destination": "b", "function": "nope"}], ["a"])
    with pytest.raises(ValueError, match="unknown column"):
        normalize.validate_rules([{"rule": "remove", "origin": "z"}], ["a"])


def test_search_cascade(spark):
    a, b = spark.range(0), spark.range(3)
    assert search.first_with_rows(a, b, spark.range(9)).count() == 3


def test_writers(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.replace_partitions(df, f"{root}/t", ["k"])
    writers.replace_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), f"{root}/t", ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(f"{root}/t").collect()} == {(1, "a"), (2, "c")}
    for stamp in ("20240101", "20240102", "20240103"):
        writers.publish(df, f"{root}/v", "reg", stamp, keep=2)
    assert [p.rsplit("_", 1)[1] for p in writers.versions(spark, f"{root}/v", "reg")] == ["20240102", "20240103"]
    with pytest.raises(ValueError):
        writers.publish(df, f"{root}/v", "reg", "20240104", validate=lambda d: d.count() > 5)
    assert spark.table("reg_in_use").count() == 2
    writers.export_csv(df, f"{root}/csv", "open", "20240101")
    assert writers.retain(spark, f"{root}/csv", "open", datetime.datetime(2024, 6, 1)) and len(writers.listing(spark, f"{root}/csv")) == 1


def fake_fetch(url: str) -> str:
    import json

    if "numbered" in url:
        page = int(url.rsplit("=", 1)[1])
        return json.dumps({"total": 5, "data": [{"a": i} for i in range(2 * page - 2, min(5, 2 * page))]})
    return json.dumps({"data": [{"a": 1}], "next": "http://cursor/2" if url.endswith("1") else None})


def test_paged_source(spark):
    got = readers.paged(spark, "http://numbered", "a string", "tests.test_operators:fake_fetch", "numbered")
    assert sorted(r["a"] for r in got.collect()) == ["0", "1", "2", "3", "4"]
    got = readers.paged(spark, "http://cursor/1", "a string", "tests.test_operators:fake_fetch", "cursor")
    assert got.count() == 2
    with pytest.raises(ValueError):
        readers.by_url(spark, "ftp://x/y.bin")
    with pytest.raises(ValueError):
        readers.literal_substitution(F.lit("x"), "s/a/b/e")


def test_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = kpis.stream_kpis(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("pl_kpis").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(120)
    a = {(r["period"], r["event_type"], r["n"]) for r in spark.table("pl_kpis").collect()}
    b = {(r["period"], r["event_type"], r["n"]) for r in kpis.batch_kpis(events).collect()}
    assert a == b


def test_publish_beside_tables_with_longer_names(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.range(3)
    for stamp in ("20240101", "20240102"):
        for name in ("ae_etab", "ae_unite", "ae"):
            writers.publish(df, root, name, stamp, keep=2)
    writers.publish(df, root, "ae", "20231231", keep=2)  # an older stamp that comes late stays, as it is in use
    writers.write_table(df, f"{root}/ae__notes_of_ours")
    names = {name: [p.rsplit("__", 1)[1] for p in writers.versions(spark, root, name)] for name in ("ae", "ae_etab", "ae_unite")}
    assert names == {"ae": ["20231231", "20240102"], "ae_etab": ["20240101", "20240102"], "ae_unite": ["20240101", "20240102"]}
    assert spark.table("ae_in_use").count() == 3 and writers.exists(spark, f"{root}/ae__notes_of_ours")
    with pytest.raises(ValueError):
        writers.publish(df, root, "ae", "2024_01")


def test_swap_is_whole_at_every_step(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        writers.current(spark, path)
    writers.swap(spark.range(3), path)
    writers.swap(spark.range(5), path)
    reader = writers.current(spark, path)
    with pytest.raises(Exception, match="boom"):
        writers.swap(spark.range(9).withColumn("x", F.raise_error(F.lit("boom"))), path)
    assert writers.current(spark, path).count() == 5
    monkeypatch.setattr(writers, "_write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        writers.swap(spark.range(9), path)
    monkeypatch.undo()
    assert writers.current(spark, path).count() == 5
    writers.swap(spark.range(7), path)
    assert writers.current(spark, path).count() == 7 and reader.count() == 5  # the version before stays for its readers


def test_tables_are_copied_and_compared(spark, tmp_path):
    root = f"file://{tmp_path}"
    writers.write_table(spark.createDataFrame([(1, "a")], "k int, v string"), f"{root}/a/x")
    writers.append_rows(spark.createDataFrame([(2, "b")], "k int, v string"), f"{root}/a/x")
    writers.copy_tables(spark, f"{root}/a", f"{root}/b", ["x"])
    writers.copy_tables(spark, f"{root}/a", f"{root}/c", ["x"], schema_only=True)
    b, c = spark.read.parquet(f"{root}/b/x"), spark.read.parquet(f"{root}/c/x")
    assert b.count() == 2 and c.count() == 0 and writers.schema_differences(b, c) == []
    assert writers.schema_differences(b, b.select("k", F.col("v").cast("int").alias("w"))) == ["v: string / None", "w: None / int"]


def test_distance_join_around_poles_and_the_antimeridian(spark):
    import random

    from placeloom.functions.numbers import haversine_m

    rng = random.Random(2)
    pts = [(88.0, 0.0), (88.0, 1.5), (10.0, 179.999), (10.0, -179.999), (90.0, 0.0), (89.99, 100.0), (89.99, -80.0), (-90.0, 50.0), (-89.98, -130.0), (0.0, 180.0), (0.0, -180.0)]
    pts += [(rng.uniform(86, 90) * rng.choice((-1, 1)), rng.uniform(-180, 180)) for _ in range(150)] + [(rng.uniform(-60, 60), rng.choice((-1, 1)) * rng.uniform(179.9, 180)) for _ in range(100)] + [(51.0 + rng.uniform(0, 0.2), rng.uniform(-0.2, 0.2)) for _ in range(80)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, lat double, lon double").cache()
    x, y = df.toDF("i", "a", "b"), df.toDF("j", "c", "d")
    for metres in (8_000.0, 60_000.0, 700_000.0):
        got = [(r["p_id"], r["id"]) for r in geo.distance_join(df, df, metres).collect()]
        want = {(r["i"], r["j"]) for r in x.crossJoin(y).filter(haversine_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")) <= metres).collect()}
        assert len(got) == len(set(got)) and set(got) == want
        for i in (0, 2, 4, 9, 30, 200):
            assert {r["id"] for r in geo.within_radius(df, *pts[i], metres).collect()} == {j for k, j in want if k == i}
    clusters = df.withColumn("cluster_id", F.lit("c"))
    groups: dict = {}
    for r in cluster.distance_refine(clusters.filter("id < 11"), "id", "lat", "lon", 8_000.0).collect():
        groups.setdefault(r["cluster_id"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[0, 1], [2, 3], [4, 5, 6], [7, 8], [9, 10]]


def test_components_that_do_not_settle_raise(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "src int, dst int")
    with pytest.raises(RuntimeError):
        graph.connected_components(chain, max_rounds=1)


def test_components_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, x) for x in range(300, 360)]
    up = list(range(400))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert {tuple(r) for r in graph.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()} == {(x, find(x)) for x in nodes}


def test_best_match_equals_brute_force(spark):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    names = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)] + ["", "the stop", "the stop"]
    left = [(i, rng.choice("xy"), rng.choice(names)) for i in range(80)] + [(500, "x", None), (501, None, "ab")]
    right = [(i, rng.choice("xy"), rng.choice(names)) for i in range(80)]

    def grams(t):
        return {f"  {w} "[i : i + 3] for w in t.split() for i in range(len(w) + 1)}

    want = {}
    for i, b, t in left:
        found = [(-len(grams(t) & grams(u)) / len(grams(t) | grams(u)), k) for k, c, u in right if c == b and t and grams(t) | grams(u)]
        found = [f for f in found if -f[0] > 0.3]
        if found:
            want[i] = min(found)
    a, b = spark.createDataFrame(left, "k int, b string, t string"), spark.createDataFrame(right, "r int, b string, t string")
    got = {r["k"]: (-r["score"], r["r"]) for r in fuzzy.best_match(a, b, ["b"], "k", "t", "r", "t").collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


@pytest.mark.parametrize("block", [["zone"], []])
def test_tfidf_pairs_equal_brute_force(spark, block):
    import math
    import random
    from collections import Counter

    rng = random.Random(7)
    rows = [(i, rng.choice("xy") if block else "x", " ".join(rng.choice(["the", "the", "aa", "bb", "cc", "dd", "ee", "f"]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    want = {}
    for b in "xy":
        docs = {i: Counter(t for t in text.split() if len(t) >= 2) for i, c, text in rows if c == b}
        df = Counter(t for d in docs.values() for t in d)
        vec = {i: {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in d.items()} for i, d in docs.items()}
        norm = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in vec.items()}
        for i in docs:
            for j in docs:
                if i < j and vec[i] and vec[j]:
                    score = min(1.0, sum(w * vec[j].get(t, 0) for t, w in vec[i].items()) / norm[i] / norm[j])
                    if round(score, 5) >= 0.6:
                        want[i, j] = score
    out = fuzzy.tfidf_pairs(spark.createDataFrame(rows, "k int, zone string, t string"), block, "k", F.col("t"), 0.6)
    got = {(r["a"], r["b"]): r["score"] for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 2e-5 for p in want)


def lcs_ratio(x, y):
    row = [0] * (len(y) + 1)
    for c in x:
        last = list(row)
        for j, d in enumerate(y):
            row[j + 1] = last[j] + 1 if c == d else max(row[j], last[j + 1])
    return 200.0 * row[-1] / (len(x) + len(y)) if x or y else 100.0


def test_search_functions_equal_brute_force(spark, data):
    """closest_names, autocomplete and fuzzy_search_rank over the part table, recomputed plainly."""
    from placeloom.plans import queries as engine

    parts = spark.read.parquet(f"{data}/part.parquet").collect()
    names = sorted({r["p_name"] for r in parts})

    def grams(t):
        return [f"  {w} "[i : i + 3] for w in t.lower().split() for i in range(len(w) + 1)]

    def word_sim(q, t):
        want, have = set(grams(q)), grams(t)
        return max((len(want & set(have[i:j])) / len(want | set(have[i:j])) for i in range(len(have)) for j in range(i + 1, len(have) + 1)), default=0.0)

    got = [(r["p_name"], r["distance"]) for r in engine.queries()["autocomplete"](spark, data).collect()]
    assert got == sorted(((n, round(1 - word_sim("rin", n), 6)) for n in names), key=lambda x: (x[1], len(x[0]), x[0]))[:10]
    scored = []
    for r in parts:
        raw = max(word_sim("red wid", r["p_name"]) / (1 + r["p_size"] / 50), word_sim("red wid", r["p_type"].lower()))
        if raw >= 0.2:
            scored.append((raw * (1.5 if r["p_name"].lower().startswith("red wid") else 1), r["p_partkey"]))
    got = [(r["score"], r["id"]) for r in engine.queries()["fuzzy_search_rank"](spark, data).collect()]
    want = sorted(scored, key=lambda x: (-x[0], x[1]))[:7]
    assert [i for _, i in got] == [i for _, i in want] and all(abs(a - b) < 1e-5 for (a, _), (b, _) in zip(got, want, strict=True))

    def weighted(x, y):  # names of like length: the plain ratio, or the token ratios at 0.95
        p, q = set(x.split()), set(y.split())
        both, one, two = " ".join(sorted(p & q)), " ".join(sorted(p & q) + sorted(p - q)), " ".join(sorted(p & q) + sorted(q - p))
        best = max(lcs_ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))), lcs_ratio(one, two), *([lcs_ratio(both, one), lcs_ratio(both, two)] if both else []))
        return max(lcs_ratio(x, y), 0.95 * best)

    near = [n for n in names if max(len(n), 9) / min(len(n), 9) < 1.5]
    got = {r["p_name"]: r["score"] for r in engine.queries()["closest_names"](spark, data).collect()}
    for n in got.keys() & set(near):
        assert abs(got[n] - weighted("red wdget", n.lower())) < 1e-9
    assert max((weighted("red wdget", n.lower()) for n in near), default=0) <= max(got.values()) + 1e-9 and len(got) == min(5, len(names))


def test_choose_parents_and_survivors_of_equals(spark):
    rows = [("c", k, True, 3) for k in (9, 4, 7)] + [("d", 1, True, 0), ("d", 2, True, 5), ("e", 5, False, 0), ("e", 6, False, 0)]
    df = spark.createDataFrame(rows, "cluster_id string, id int, is_parent boolean, n int")
    for parts in (1, 7):
        got = {r["cluster_id"]: (r["parent_id"], r["created"]) for r in cdc.choose_parents(df.repartition(parts, "id"), "cluster_id", "id", "is_parent", "n", F.lit(True)).collect()}
        assert got["c"] == ("4", False) and got["d"] == ("2", False) and got["e"][1] and len(got["e"][0]) == 36
    same = spark.createDataFrame([("g", 1, "b"), ("g", 1, "a"), ("g", 0, "")], "g string, rank int, v string")
    assert [r["v"] for r in cdc.survivorship(same.repartition(3), "g", ["v"], F.col("rank")).collect()] == ["a"]
    changes = cdc.mark_changes(df, cdc.choose_parents(df, "cluster_id", "id", "is_parent", "n", F.lit(True)), "cluster_id", "id", "is_parent")
    assert quality.report(quality.ordered(changes, "cluster_id", "change_order"), quality.cluster_invariants(df, "id")).agg(F.sum("failures")).first()[0] == 0


def test_clusters_are_checked_again_without_lost_rows(spark):
    """b ties a and c together; with b gone for its source, a and c no longer agree."""
    rows = [(1, "s1", "aa bb"), (2, "s1", "aa bb cc dd"), (3, "s2", "cc dd"), (4, "s3", "ee ff"), (5, "s4", "ee ff")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "id int, source string, nom string, zone string")
    assert {r["id"] for r in cluster.cluster(df, "id", ["zone"], ["nom"], 0.4, source="source").collect()} == {4, 5}
    found = cluster.cluster(df, "id", ["zone"], ["nom"], 0.4)
    assert {r["id"] for r in cluster.with_included_sources(found, "source", ["s2"]).collect()} == {1, 2, 3}
    kids = spark.createDataFrame([(10, 4), (11, 9)], "id int, parent_id int")
    out = {(r["id"], r["cluster_id"]) for r in cluster.attach_children(found.filter("id > 3"), kids, "id", "parent_id").collect()}
    assert {i for i, _ in out} == {4, 5, 10} and len({c for _, c in out}) == 1


def test_intra_source_split(spark):
    rows = [("c", 1, ["a"]), ("c", 2, ["a", "b"]), ("c", 3, ["b"]), ("c", 4, ["c"]), ("c", 5, ["a", "c"])]
    df = spark.createDataFrame(rows, "cluster_id string, id int, sources array<string>")
    got: dict = {}
    for r in cluster.split_intra_source(df, "id", "sources").collect():
        got.setdefault(r["cluster_id"], set()).add(r["id"])
    assert got == {"c_0": {2, 4}, "c_1": {3, 5}}  # 1 is left alone, as both have its source
    with pytest.raises(ValueError, match="finer"):
        cluster.split_intra_source(df, "id", "sources", max_rows=3)


def test_surrogate_key_of_equal_rows(spark):
    df = spark.createDataFrame([(i % 3, f"v{i % 5}") for i in range(100)], "a int, b string").repartition(6)
    got = rel.surrogate_key(df, ["a"]).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(1, 101)) and [(r["a"], r["b"]) for r in got] == sorted((i % 3, f"v{i % 5}") for i in range(100))


def test_quality_validations(spark):
    df = spark.range(10)
    rows = quality.validation(df, "rows", F.count(F.lit(1)), lambda v: v >= 10).unionAll(quality.validation(df, "greatest", F.max("id"), lambda v: v > 20)).collect()
    assert [tuple(r) for r in rows] == [("rows", True, "10"), ("greatest", False, "9")]
    assert quality.columns_exist(df, "t", ["id", "x"]) == ["t.x"]
    steps = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 2), ("c", 1), ("c", 3), ("d", 1), ("d", 1)], "c string, o int")
    assert quality.ordered(steps, "c", "o").first()["failures"] == 2


def test_url_cohorts_with_domains(spark):
    urls = spark.createDataFrame([("https://a.com",), ("https://b.com",), ("https://c.com",), ("nothing",)], "url string")
    results = spark.createDataFrame([("https://a.com", True, True, "https://a.com"), ("https://b.com", False, False, None), ("https://c.com", True, False, None)], "url string, dns_ok boolean, reached boolean, final_url string")
    assert {r["url"]: r["cohort"] for r in cdc.url_cohorts(urls, results).collect()} == {"https://a.com": "crawl_ok_same", "https://b.com": "dns_fail", "https://c.com": "crawl_fail", "nothing": "syntax_fail"}


def test_rules_with_options(spark):
    df = spark.createDataFrame([(1, "Oui ", "a|b|x", "1,5", "2.5", "true"), (2, "autre", "", "x", "", "")], "id int, kind string, codes string, lon string, lat string, bonus string")
    rules = [
        {"rule": "transform", "origin": "kind", "destination": "label", "function": "label", "options": {"mapping": {"oui": "yes"}}},
        {"rule": "transform", "origin": "codes", "destination": "mapped", "function": "codes", "options": {"mapping": {"a": ["A1"], "b": ["A1", "B1"]}}},
        {"rule": "row", "origins": ["lon", "lat"], "destination": "at", "function": "location"},
        {"rule": "row", "origins": ["codes", "bonus"], "destination": "labels", "function": "labels", "options": {"ignored": ["x"]}},
        {"rule": "row", "origins": ["bonus"], "destination": "flags", "function": "flags", "options": {"names": ["b"]}},
        {"rule": "row", "origins": ["mapped", "flags"], "destination": "merged", "function": "merged_codes"},
    ]
    rows, logs = normalize.normalize(df, rules, "id")
    one, two = sorted(rows.collect(), key=lambda r: r["id"])
    assert (one["label"], one["mapped"], tuple(one["at"]), one["labels"], one["merged"]) == ("yes", ["A1", "B1"], (2.5, 1.5), ["bonus", "a", "b"], ["A1", "B1", "b"])
    assert (two["mapped"], tuple(two["at"]), two["labels"]) == ([], (None, None), []) and [(r["id"], r["field"]) for r in logs.collect()] == [(2, "label")]
    assert len(normalize.PLAIN) + len(normalize.CHECKED) >= 30


def test_content_filters(spark):
    rows = [(1, ["c"], False, 1.0, 2.0), (1, ["c"], False, 1.0, 1.0), (2, [], False, 1.0, 1.0), (3, ["c"], False, None, 1.0), (4, ["c"], True, None, None)]
    df = spark.createDataFrame(rows, "id int, categories array<string>, digital boolean, lat double, lon double")
    assert sorted((r["id"], r["lon"]) for r in normalize.content_filters(df, "id", "categories", F.col("digital"), "lat", "lon").collect()) == [(1, 1.0), (4, None)]
    kept = rel.drop_empty(spark.createDataFrame([("a", 1), (" ", 2), (None, 3), ("b", None)], "x string, y int"), ["x", "y"]).collect()
    assert [r["x"] for r in kept] == ["a"]
    new, known, gone = rel.membership_partition(spark.range(1, 4), spark.range(3, 6), "id")
    assert (new.count(), known.count(), gone.count()) == (2, 1, 2)
    assert 0 < readers.sampled(spark.range(2000), 0.5).count() < 2000 and readers.sampled(spark.range(9), on=False).count() == 9
    assert readers.literal_values(spark, [(1.5, 2.5)], "lon double, lat double").first()["lat"] == 2.5


def test_readers_of_files(spark, tmp_path):
    import gzip
    import json
    import zipfile

    text = "id;nom;ville\n1;Café;Paris\n2;broken\n3;Œuvre;l\ufffdon\n"
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("etablissements_1.csv", ("\ufeff" + text).encode("utf-16-le"))
        z.writestr("other.csv", "id;nom\n9;no\n".encode())
    got = readers.by_url(spark, f"file://{tmp_path}/a.zip", columns=["id", "nom", "absent"], member="etablissements", encoding="UTF-16-LE").collect()
    assert [tuple(r) for r in got] == [("1", "Café", None), ("3", "Œuvre", None)]
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress("id,nom\n1,Caf\u00e9 ION_\n".encode("iso-8859-1")))
    got = readers.by_url(spark, f"file://{tmp_path}/b.csv.gz", columns=["id", "nom"], encoding="ISO-8859-1", substitutions=(("ION_", "ÏON"),)).collect()
    assert [tuple(r) for r in got] == [("1", "Café ÏON")]
    (tmp_path / "c.csv").write_text("id,nom\n1,x\n2,y\n")
    assert readers.by_url(spark, f"file://{tmp_path}/c.csv").count() == 2 and readers.csv_text(spark, f"file://{tmp_path}/c.csv", ["id", "nom"]).schema["id"].dataType.simpleString() == "string"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.csv").write_bytes("id;nom\n1;é\n".encode("utf-16-le"))
    assert readers.utf16_csv(spark, f"file://{tmp_path}/d").first()["nom"] == "é"
    (tmp_path / "e.geojson").write_text(json.dumps({"features": [{"geometry": {"type": "Point", "coordinates": [1,  2]}, "properties": {"a": "b"}}]}))
    row = readers.by_url(spark, f"file://{tmp_path}/e.geojson").first()
    assert (row["type"], json.loads(row["coordinates"]), row["properties"]) == ("Point", [1, 2], {"a": "b"})


def test_endpoints_by_url(spark):
    how = {"columns": "a string", "fetch": "tests.test_operators:fake_fetch"}
    assert readers.by_url(spark, "http://api.numbered/x", numbered=("api.numbered",), **how).count() == 5
    assert readers.by_url(spark, "http://cursor/1", cursors=("cursor",), **how).count() == 2
    assert readers.by_url(spark, "http://cursor/1", **how).count() == 1
    with pytest.raises(ValueError):
        readers.by_url(spark, "http://cursor/1?x=1", **how)


def test_staged_tables_are_released(spark):
    from placeloom.operators import staging

    one = staging.stage(spark.range(5), "one")
    path = staging.staged()[-1]
    two = one.join(spark.createDataFrame([(1,)], "id long"), "id")
    assert staging.reads(two, path) and not staging.reads(spark.range(3), path) and not staging.reads(staging.stage(spark.range(2), "two"), path)
    assert two.count() == 1
    staging.release(spark, [path])
    assert path not in staging.staged() and not writers.exists(spark, path)

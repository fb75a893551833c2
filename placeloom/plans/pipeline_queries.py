"""Whole plans on place-shaped frames that are derived from the driver's tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.operators import cdc
from placeloom.operators import relational as rel
from placeloom.operators.staging import shared_dir
from placeloom.plans import actors as marts
from placeloom.plans import enrichment, ingestion
from placeloom.plans.entity_queries import _HAV, _POINTS, _PROBES, _TRI, _TFIDF, _points, _probes, duck_base57, duck_uuid5, duck_valid_url
from placeloom.plans.registry import Tables, query
from placeloom.sources import readers, writers
from placeloom.streaming import kpis

_ACTORS = """
a AS (SELECT c_custkey AS k, 'a' || c_custkey AS identifiant_unique, CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 4 = 0 THEN 'a' || (c_custkey - c_custkey % 10) END AS parent_id, CASE WHEN c_acctbal > 0 THEN 'ACTIF' ELSE 'INACTIF' END AS statut,
  CASE WHEN c_custkey % 13 = 0 THEN 'Aucun' WHEN c_custkey % 13 = 1 THEN 'Particuliers' END AS public_accueilli, CASE WHEN c_custkey % 17 = 0 THEN '__empty__' ELSE c_name END AS nom, lpad((c_nationkey * 1000 + 75)::VARCHAR, 5, '0') AS code_postal,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE lpad((c_custkey % 90)::VARCHAR, 9, '1') END AS siren, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE lpad((c_custkey % 90)::VARCHAR, 9, '1') || lpad((c_custkey % 40)::VARCHAR, 5, '0') END AS siret FROM customer),
g AS (SELECT * REPLACE (CASE WHEN k % 6 = 1 THEN '' ELSE (100000000 + k - k % 3)::VARCHAR END AS siren, CASE WHEN k % 3 = 0 THEN '' ELSE (100000000 + k - k % 3)::VARCHAR || lpad((k % 3)::VARCHAR, 5, '0') END AS siret) FROM a),
sites AS (SELECT DISTINCT (100000000 + p_partkey - p_partkey % 3)::VARCHAR || lpad((p_partkey % 3)::VARCHAR, 5, '0') AS siret, p_partkey % 7 < 3 AS est_actif, p_type AS naf, lpad((p_size % 25 * 1000 + 75)::VARCHAR, 5, '0') AS code_postal, (p_size % 4)::VARCHAR AS numero, p_brand AS adresse_norm, p_name AS nom FROM part),
s AS (SELECT 'a' || o_custkey AS acteur_id, o_orderpriority AS action FROM orders WHERE o_custkey % 9 <> 0)"""


def _actors(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("a"), c.cast("string"))
    siren = F.lpad((k % 90).cast("string"), 9, "1")
    return t.customer.select(
        name(k).alias("identifiant_unique"),
        F.when((k % 10 != 0) & (k % 4 == 0), name(k - k % 10)).alias("parent_id"),
        F.when(F.col("c_acctbal") > 0, "ACTIF").otherwise("INACTIF").alias("statut"),
        F.when(k % 13 == 0, "Aucun").when(k % 13 == 1, "Particuliers").alias("public_accueilli"),
        F.when(k % 17 == 0, "__empty__").otherwise(F.col("c_name")).alias("nom"),
        F.lpad((F.col("c_nationkey") * 1000 + 75).cast("string"), 5, "0").alias("code_postal"),
        F.when(k % 6 == 0, "").otherwise(siren).alias("siren"),
        F.when(k % 3 == 0, "").otherwise(F.concat(siren, F.lpad((k % 40).cast("string"), 5, "0"))).alias("siret"),
    )


def _siren(k: Column) -> Column:
    """A company has the sites of three keys."""
    return (100_000_000 + k - k % 3).cast("string")


def _siret(k: Column) -> Column:
    return F.concat(_siren(k), F.lpad((k % 3).cast("string"), 5, "0"))


def _sites(t: Tables) -> DataFrame:
    """The register: every part is a site, whose identifier holds the whole key."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(_siret(k).alias("siret"), (k % 7 < 3).alias("est_actif"), F.col("p_type").alias("naf"), F.lpad((size % 25 * 1000 + 75).cast("string"), 5, "0").alias("code_postal"), (size % 4).cast("string").alias("numero"), F.col("p_brand").alias("adresse_norm"), F.col("p_name").alias("nom")).distinct()


def _registered(t: Tables) -> DataFrame:
    """Actors with identifiers of the register, where they have any."""
    k = F.substring("identifiant_unique", 2, 20).cast("long")
    return _actors(t).withColumns({"siren": F.when(k % 6 == 1, "").otherwise(_siren(k)), "siret": F.when(k % 3 == 0, "").otherwise(_siret(k))})


def _services(t: Tables) -> DataFrame:
    return t.orders.filter("o_custkey % 9 <> 0").select(F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("acteur_id"), F.col("o_orderpriority").alias("action"))


_SHOWN = """
v AS (SELECT x.* REPLACE (CASE WHEN x.nom = '__empty__' THEN '' ELSE x.nom END AS nom) FROM a x LEFT JOIN a p ON x.parent_id = p.identifiant_unique
  WHERE x.statut = 'ACTIF' AND (x.parent_id IS NULL OR p.statut = 'ACTIF') AND (x.public_accueilli IS NULL OR upper(x.public_accueilli) NOT IN ('AUCUN', 'PROFESSIONNELS'))),
r AS (SELECT DISTINCT coalesce(parent_id, identifiant_unique) AS identifiant_unique, action FROM v JOIN s ON acteur_id = identifiant_unique)"""


@query("map_mart", f"WITH {_ACTORS}, {_SHOWN} SELECT identifiant_unique, nom, code_postal FROM v WHERE parent_id IS NULL AND identifiant_unique IN (SELECT identifiant_unique FROM r)")
def _(t: Tables) -> DataFrame:
    return marts.mart(marts.filtered(_actors(t)), _services(t)).select("identifiant_unique", "nom", "code_postal")


@query("map_services", f"WITH {_ACTORS}, {_SHOWN} SELECT identifiant_unique, action, identifiant_unique || '_' || action AS key FROM r")
def _(t: Tables) -> DataFrame:
    return marts.rolled_services(marts.filtered(_actors(t)), _services(t))


@query("exhaustive_view", f"""
WITH {_ACTORS}, {_SHOWN}, m AS (SELECT identifiant_unique FROM v WHERE parent_id IS NULL AND identifiant_unique IN (SELECT identifiant_unique FROM r)), c AS (SELECT parent_id, count(*) AS n, string_agg(identifiant_unique, ',' ORDER BY identifiant_unique) AS kids FROM a WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT a.identifiant_unique, a.identifiant_unique IN (SELECT identifiant_unique FROM m) AS est_dans_carte, a.identifiant_unique IN (SELECT acteur_id FROM s) AS est_dans_opendata, coalesce(c.n, 0) AS nombre_enfants, coalesce(kids, '') AS enfants FROM a LEFT JOIN c ON c.parent_id = a.identifiant_unique""")
def _(t: Tables) -> DataFrame:
    actors, services = _actors(t), _services(t)
    shown = marts.mart(marts.filtered(actors), services).select("identifiant_unique")
    out = marts.exhaustive(actors, shown, services.select(F.col("acteur_id").alias("identifiant_unique")))
    return out.select("identifiant_unique", "est_dans_carte", "est_dans_opendata", "nombre_enfants", F.array_join("enfants", ",").alias("enfants"))


@query("open_data_export", f"""
WITH {_ACTORS}, sv AS (SELECT acteur_id, '[' || string_agg('{{"action":"' || action || '","categories":["' || lower(action) || '"]}}', ',' ORDER BY action) || ']' AS services, string_agg(lower(action), '|' ORDER BY lower(action)) AS labels FROM (SELECT DISTINCT acteur_id, action FROM s) GROUP BY 1)
SELECT identifiant_unique, nom, CASE WHEN k % 4 <> 0 AND k % 9 + 1 NOT IN (6, 7) THEN '0' || (k % 9 + 1) || '12345678' END AS telephone, CASE WHEN k % 5 <> 0 THEN '1 rue' END AS adresse, code_postal, 'Lyon' AS ville, 's' || (k % 4) AS source_code, labels, services
FROM a LEFT JOIN sv ON acteur_id = identifiant_unique WHERE k % 4 < 2""")
def _(t: Tables) -> DataFrame:
    k = F.regexp_extract("identifiant_unique", r"\d+", 0).cast("long")
    actors = _actors(t).withColumns({"source_id": k % 4, "telephone": F.concat(F.lit("0"), (k % 9 + 1).cast("string"), F.lit("12345678")), "lieu_prestation": F.when(k % 5 == 0, "A_DOMICILE"), "adresse": F.lit("1 rue"), "ville": F.lit("Lyon")})
    sources = t.spark.createDataFrame([(0, "s0", "OPEN_LICENSE", True), (1, "s1", "OPEN_LICENSE", False), (2, "s2", "NO_LICENSE", False)], "source_id long, code string, licence string, protege_telephone boolean")
    services = _services(t).withColumn("sous_categorie", F.lower("action"))
    labels = services.select("acteur_id", F.lower("action").alias("label"))
    return marts.open_data(actors, services, labels, sources)


@query("overlay_actors", f"""
WITH {_ACTORS}, u AS (SELECT *, {duck_uuid5('identifiant_unique')} AS uuid FROM a)
SELECT identifiant_unique, nom, CASE WHEN siren <> '' THEN 'REVISED' ELSE statut END AS statut, CASE WHEN siren <> '' THEN 'a0' END AS parent_id, uuid, {duck_base57('uuid')} AS short_id, siren <> '' AS revision_exists FROM u""")
def _(t: Tables) -> DataFrame:
    a = _actors(t)
    revision = a.filter("siren <> ''").select("identifiant_unique", F.lit("").alias("nom"), F.lit("REVISED").alias("statut"), F.lit("a0").alias("parent_id"))
    return marts.overlay(a.drop("parent_id"), revision).select("identifiant_unique", "nom", "statut", "parent_id", "uuid", "short_id", "revision_exists")


@query("commune_match", f"""
WITH {_ACTORS}, l AS (SELECT identifiant_unique, code_postal, 'NATION_' || regexp_extract(code_postal, '^0*([0-9]*)075$', 1) AS ville FROM a),
x AS (SELECT l.*, n_nationkey AS code_commune, upper(n_name) AS nom_commune, {_TRI.format('ville')} AS g, {_TRI.format('n_name')} AS h FROM l JOIN nation ON code_postal = lpad((n_nationkey * 1000 + 75)::VARCHAR, 5, '0')),
z AS (SELECT *, len(list_intersect(g, h))::DOUBLE / (len(g) + len(h) - len(list_intersect(g, h))) AS score FROM x)
SELECT code_postal, identifiant_unique, code_commune, nom_commune, score FROM z WHERE score > 0.3""")
def _(t: Tables) -> DataFrame:
    towns = t.nation.select(F.lpad((F.col("n_nationkey") * 1000 + 75).cast("string"), 5, "0").alias("code_postal"), F.col("n_nationkey").alias("code_commune"), F.upper("n_name").alias("nom_commune"))
    return marts.communes(_actors(t).withColumn("ville", F.concat(F.lit("Nâtion_"), F.regexp_extract("code_postal", "^0*([0-9]*)075$", 1))), towns)


@query("closed_site_cohorts", f"""
WITH {_ACTORS}, c AS (SELECT g.identifiant_unique, g.siret, left(g.siret, 9) AS siren, z.naf, z.code_postal, z.numero, z.adresse_norm, z.nom AS site_nom FROM g JOIN sites z ON g.siret = z.siret WHERE g.statut = 'ACTIF' AND NOT z.est_actif),
b AS (SELECT c.identifiant_unique, z.siret AS remplacant_siret, left(z.siret, 9) = c.siren AS same, row_number() OVER (PARTITION BY c.identifiant_unique ORDER BY left(z.siret, 9) = c.siren DESC, len(list_filter(list_sort(string_split(lower(c.site_nom), ' ')), lambda w: contains(array_to_string(list_sort(string_split(lower(z.nom), ' ')), ' '), w))) DESC, z.siret) AS rn
  FROM c JOIN sites z ON z.est_actif AND c.naf = z.naf AND c.code_postal = z.code_postal AND c.numero = z.numero AND c.adresse_norm = z.adresse_norm),
u AS (SELECT DISTINCT left(siret, 9) AS siren FROM sites WHERE est_actif)
SELECT DISTINCT c.identifiant_unique, c.siret, remplacant_siret, CASE WHEN same THEN 'replaced_same_siren' WHEN remplacant_siret IS NOT NULL THEN 'replaced_other_siren' WHEN u.siren IS NOT NULL THEN 'closed_site' ELSE 'closed_company' END AS suggest_cohort
FROM c LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (identifiant_unique) LEFT JOIN u ON u.siren = c.siren""")
def _(t: Tables) -> DataFrame:
    sites = _sites(t)
    candidates = enrichment.closed_candidates(_registered(t), sites)
    units = sites.filter("est_actif").select(F.left("siret", F.lit(9)).alias("siren"), "est_actif").distinct()
    return enrichment.closed_cohorts(candidates, enrichment.replacements(candidates, sites), units).distinct()


@query("siret_from_siren", f"""
WITH {_ACTORS}, l AS (SELECT left(siret, 9) AS siren, siret, code_postal FROM sites WHERE est_actif), w AS (SELECT siren, max(siret) AS x FROM l GROUP BY 1 HAVING count(DISTINCT siret) = 1), z AS (SELECT siren, code_postal, max(siret) AS x FROM l GROUP BY 1, 2 HAVING count(DISTINCT siret) = 1)
SELECT identifiant_unique, g.siren, coalesce(w.x, z.x) AS siret FROM g LEFT JOIN w ON w.siren = g.siren LEFT JOIN z ON z.siren = g.siren AND z.code_postal = g.code_postal WHERE length(g.siren) = 9 AND g.siret = '' AND coalesce(w.x, z.x) IS NOT NULL""")
def _(t: Tables) -> DataFrame:
    return enrichment.siret_from_siren(_registered(t), _sites(t))


@query("siren_from_siret", f"WITH {_ACTORS} SELECT identifiant_unique, siret, left(siret, 9) AS siren FROM g WHERE length(siret) = 14 AND siren = '' AND left(siret, 9) IN (SELECT left(siret, 9) FROM sites WHERE est_actif)")
def _(t: Tables) -> DataFrame:
    return enrichment.siren_from_siret(_registered(t), _sites(t).select(F.left("siret", F.lit(9)).alias("siren"), "est_actif"))


@query("director_names", f"WITH {_ACTORS} SELECT identifiant_unique, siren FROM g WHERE length(siren) = 9 AND contains(lower(nom), 'customer') AND siren IN (SELECT left(siret, 9) FROM sites)")
def _(t: Tables) -> DataFrame:
    directors = _sites(t).select(F.left("siret", F.lit(9)).alias("siren"), F.lit("Customer").alias("dirigeant_nom"), F.lit("CUSTÔMER").alias("dirigeant_prenom")).distinct()
    actors = _registered(t).withColumns({"nom_officiel": F.lit(""), "nom_commercial": F.lit(None).cast("string")})
    return enrichment.director_names(actors, directors)


@query("town_suggestions", f"""
WITH {_ACTORS}, v AS (SELECT identifiant_unique, ['saint etiene', 'vieux bourg', 'saint etienne', 'paris', 'etienne'][(k % 5 + 1)::INTEGER] AS n FROM a), w AS (SELECT *, {_TRI.format('n')} AS x, {_TRI.format("'saint etienne'")} AS y FROM v)
SELECT identifiant_unique, CASE WHEN n = 'vieux bourg' THEN 'renamed' ELSE 'typo' END AS cohort, 'Saint-Étienne' AS suggestion FROM w
WHERE n <> 'saint etienne' AND (n = 'vieux bourg' OR len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y))) > 0.6)""")
def _(t: Tables) -> DataFrame:
    k = F.substring("identifiant_unique", 2, 20).cast("long")
    towns = F.array(*[F.lit(v) for v in ("Saint-Étiene", "Vieux  Bourg", "SAINT ETIENNE", "Paris", "Étienne")])
    actors = _actors(t).withColumn("ville", F.get(towns, (k % 5).cast("int")))
    addresses = _actors(t).select("code_postal", F.lit("Saint-Étienne").alias("ville_actuelle"), F.lit("Vieux-Bourg").alias("ville_ancienne")).distinct()
    return enrichment.town_suggestions(actors, addresses, 0.6)


@query("identifier_coverage", f"""
WITH {_ACTORS} SELECT count(*) AS nb_total, count(*) FILTER (length(siren) = 9 AND regexp_matches(siren, '^[0-9]+$')) AS nb_siren, count(*) FILTER (length(siret) = 14 AND regexp_matches(siret, '^[0-9]+$')) AS nb_siret,
  round(count(*) FILTER (length(siren) = 9) * 100.0::DOUBLE / count(*), 2) AS rate_siren, round(count(*) FILTER (length(siret) = 14) * 100.0::DOUBLE / count(*), 2) AS rate_siret FROM a""")
def _(t: Tables) -> DataFrame:
    c = enrichment.identifier_coverage(_actors(t), "2024-01-01")
    return c.select("nb_total", "nb_siren", "nb_siret", F.col("rate_siren").cast("double"), F.col("rate_siret").cast("double"))


@query("first_service_distance", f"""
WITH p AS ({_PROBES}), q AS ({_POINTS}), d AS (SELECT probe, action, point, {_HAV.format('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS m FROM p, q), n AS (SELECT *, row_number() OVER (PARTITION BY probe, action ORDER BY m, point) AS rn, count(*) OVER (PARTITION BY probe, action) AS c FROM d WHERE m <= 100000), o AS (SELECT * FROM n WHERE rn = 1)
SELECT action, round(avg(m), 3) AS mean_distance, round(avg(c), 3) AS mean_solutions FROM o GROUP BY 1 UNION ALL SELECT 'TOUTES_ACTIONS', round(avg(m), 3), round(avg(c), 3) FROM o""")
def _(t: Tables) -> DataFrame:
    return enrichment.first_service_distance(_probes(t), _points(t).withColumnRenamed("point", "identifiant_unique"))


@query("service_drift", """
WITH b AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS a, l_linestatus AS c FROM lineitem WHERE l_linenumber < 4), r AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS a, l_linestatus AS c FROM lineitem WHERE l_linenumber > 2),
d AS (SELECT *, 'left' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM b)), i AS (SELECT k, side, a, string_agg(c, '+' ORDER BY c) AS c FROM d GROUP BY ALL)
SELECT k, side, string_agg(a || '=' || c, ',' ORDER BY a) AS actions FROM i GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    li = t.lineitem.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("c"), "l_linenumber")
    out = enrichment.service_drift(li.filter("l_linenumber < 4"), li.filter("l_linenumber > 2"), ["k", "a", "c"])
    text = F.array_join(F.transform(F.array_sort(F.map_entries("actions")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "+"))), ",")
    return out.select("k", "side", text.alias("actions"))


@query("ingest_pipeline", f"""
WITH {_ACTORS}, f AS (SELECT *, public_accueilli IS NULL AS known FROM a), c AS (
  SELECT identifiant_unique, known, CASE WHEN NOT known THEN '[{{"field":"identifiant_unique","kind":"NEW","new":"' || identifiant_unique || '"}}]' ELSE '[{{"field":"nom","kind":"MODIF","old":"' || upper(nom) || '","new":"' || nom || '"}}]' END AS changes FROM f)
SELECT identifiant_unique, changes, CASE WHEN known THEN 'update' ELSE 'create' END AS action FROM c""")
def _(t: Tables) -> DataFrame:
    feed = _actors(t).select("identifiant_unique", "nom", "siren", F.col("code_postal").alias("cp"), F.lit("ACTIF").alias("status"))
    rules = [{"rule": "row", "origins": ["siren"], "destination": "siren", "function": "siren"}, {"rule": "transform", "origin": "cp", "destination": "code_postal", "function": "postcode"}, {"rule": "keep", "origin": "nom"}, {"rule": "keep", "origin": "status"}]
    store = _actors(t).filter("public_accueilli IS NULL").select("identifiant_unique", F.upper("nom").alias("nom"), "siren", "code_postal", F.lit("ACTIF").alias("status"))
    out = ingestion.ingest(feed, store, rules, "identifiant_unique", ["nom", "siren", "code_postal"])
    return out["changed"].select("identifiant_unique", F.to_json("changes").alias("changes")).join(out["actions"], "identifiant_unique")


_FOUND = f"""
src AS (SELECT p_brand || '|' || p_size AS block, p_partkey AS k, p_name AS name FROM part WHERE (p_brand, p_size) IN (SELECT (p_brand, p_size) FROM part GROUP BY p_brand, p_size HAVING count(*) >= 2)), {_TFIDF},
e AS (SELECT a AS u, b AS v FROM s WHERE score >= 0.3 UNION ALL SELECT b, a FROM s WHERE score >= 0.3), r AS (SELECT u AS node, u AS root FROM e UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.node WHERE r.root < e.v),
c1 AS (SELECT p.*, lower(replace(p_brand, '#', '-')) || '_' || p_size || '_f0_' || root AS cid FROM part p JOIN (SELECT node, min(root) AS root FROM r GROUP BY 1) x ON x.node = p.p_partkey),
o1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid, p_type ORDER BY p_partkey) AS rn FROM c1) WHERE rn = 1),
o2 AS (SELECT * FROM o1 WHERE cid IN (SELECT cid FROM o1 GROUP BY 1 HAVING count(*) >= 2))"""
_AGAIN = _TFIDF.replace("src", "src2")
for _name in "tfndwus":
    _AGAIN = re.sub(rf"\b{_name} AS \(", f"{_name}2 AS (", _AGAIN)
    _AGAIN = re.sub(rf"(FROM|JOIN) {_name}\b(?! AS)", rf"\1 {_name}2 AS {_name}", _AGAIN)
_AGAIN = re.sub(r"(FROM|JOIN) u2 AS u ([xy])\b", r"\1 u2 \2", _AGAIN)


@query("dedup_pipeline", f"""
WITH RECURSIVE {_FOUND}, src2 AS (SELECT cid AS block, p_partkey AS k, p_name AS name FROM o2), {_AGAIN},
e2 AS (SELECT a AS u, b AS v FROM s2 WHERE score >= 0.3 UNION ALL SELECT b, a FROM s2 WHERE score >= 0.3), r2 AS (SELECT u AS node, u AS root FROM e2 UNION SELECT e2.v, r2.root FROM r2 JOIN e2 ON e2.u = r2.node WHERE r2.root < e2.v),
m AS (SELECT p_partkey AS id, cid || '_f0_' || root AS cluster_id, p_name, p_type, p_partkey % 7 = 0 AS is_parent, p_partkey % 5 AS kids FROM o2 JOIN (SELECT node, min(root) AS root FROM r2 GROUP BY 1) x ON x.node = p_partkey),
b AS (SELECT cluster_id, string_agg(id::VARCHAR, ',' ORDER BY id::VARCHAR) AS members, (arg_min(id, -kids * 1000000000 + id) FILTER (is_parent))::VARCHAR AS best, arg_min(p_name, id) AS nom, arg_min(p_type, id) AS source FROM m GROUP BY 1),
p AS (SELECT *, coalesce(best, {duck_uuid5('members')}) AS parent_id FROM b)
SELECT m.cluster_id, m.id::VARCHAR AS id, CASE WHEN m.id::VARCHAR = parent_id THEN 'parent_keep' WHEN is_parent THEN 'parent_delete' ELSE 'child_point' END AS change, CASE WHEN m.id::VARCHAR = parent_id THEN 1 WHEN is_parent THEN 3 ELSE 2 END AS change_order, parent_id, nom, source FROM m JOIN p USING (cluster_id)
UNION ALL SELECT cluster_id, parent_id, 'parent_create', 1, parent_id, nom, source FROM p WHERE best IS NULL""")
def _(t: Tables) -> DataFrame:
    p = t.part.select(F.col("p_partkey").alias("id"), "p_brand", "p_size", F.col("p_name").alias("nom"), F.col("p_type").alias("source"), (F.col("p_partkey") % 7 == 0).alias("is_parent"), (F.col("p_partkey") % 5).alias("n_children"), F.lit("ACTIF").alias("statut"))
    out = ingestion.deduplicate(p, "id", ["p_brand", "p_size"], ["nom"], 0.3, 0.0, "source", ["nom", "source"], F.col("id"))
    return out["changes"].join(out["values"], "cluster_id")


@query("crawl_pipeline", f"""
WITH p AS (SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'nothing ' || page_id WHEN page_id % 5 = 0 THEN 'https://site' || page_id % 7 || '.example.org/' || page_id % 3 ELSE url END AS url FROM pages),
u AS (SELECT url, string_agg(page_id::VARCHAR, ',' ORDER BY page_id::VARCHAR) AS acteurs, CASE WHEN {duck_valid_url('url')} THEN regexp_extract(url, '^https?://([^/:]+)', 1) END AS domain FROM p GROUP BY url)
SELECT url, acteurs, CASE WHEN NOT {duck_valid_url('url')} THEN 'syntax_fail' WHEN length(url) % 5 = 0 THEN 'dns_fail' WHEN length(url) % 3 = 0 THEN 'crawl_fail' ELSE 'crawl_ok_same' END AS cohort
FROM u WHERE domain IS NOT DISTINCT FROM NULL AND (SELECT count(*) FROM u WHERE domain IS NULL) < 10 OR domain IN (SELECT domain FROM u WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) < 10)""")
def _(t: Tables) -> DataFrame:
    k = F.col("page_id")
    url = F.when(k % 13 == 0, F.concat(F.lit("nothing "), k.cast("string"))).when(k % 5 == 0, F.concat(F.lit("https://site"), (k % 7).cast("string"), F.lit(".example.org/"), (k % 3).cast("string"))).otherwise(F.col("url"))
    pages = t.pages.select(k.cast("string").alias("identifiant_unique"), url.alias("url"))
    results = pages.select("url", (F.length("url") % 5 != 0).alias("dns_ok"), (F.length("url") % 3 != 0).alias("reached"), F.col("url").alias("final_url")).distinct()
    return ingestion.crawl(pages, results).select("url", F.array_join("acteurs", ",").alias("acteurs"), "cohort")


@query("clone_register", "SELECT s_suppkey AS supp_key, s_name AS supp_name FROM supplier")
def _(t: Tables) -> DataFrame:
    root = f"{shared_dir(t.spark)}/clone-{uuid.uuid4().hex}"
    return ingestion.clone_register(t.supplier.select("s_suppkey", "s_name"), root, "supplier", "20240101", 1, {"s_suppkey": "supp_key", "s_name": "supp_name"})


@query("incremental_history", "SELECT day, n FROM (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CASE WHEN strftime(ts, '%d') < '15' THEN count(*) ELSE -count(*) END AS n FROM events GROUP BY 1, strftime(ts, '%d'))")
def _(t: Tables) -> DataFrame:
    day = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    fresh = day.filter(F.substring("day", 9, 2) >= "15").select("day", (-F.col("n")).alias("n"))
    return writers.delete_insert(day, fresh, ["day"])


@query("schema_alignment", "SELECT r_name AS name, '' AS code, r_regionkey::VARCHAR AS r_regionkey FROM region")
def _(t: Tables) -> DataFrame:
    return readers.align(t.region.withColumnRenamed("r_name", "name"), ["name", "code", "r_regionkey"])


@query("corrupted_bytes", "SELECT n_nationkey, replace(n_name, 'ION_', 'IÖN-') AS n_name FROM nation")
def _(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", readers.literal_substitution(F.col("n_name"), "s/ION_/IÖN-/g").alias("n_name"))


@query("literal_probes", "SELECT * FROM (VALUES (2.35, 48.85), (4.83, 45.76)) AS t(longitude, latitude)")
def _(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT CAST(longitude AS DOUBLE) AS longitude, CAST(latitude AS DOUBLE) AS latitude FROM VALUES (2.35, 48.85), (4.83, 45.76) AS t(longitude, latitude)")


@query("event_kpis", "SELECT date_trunc('week', ts)::TIMESTAMP AS period, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    out = kpis.batch_kpis(t.events, "week")
    return out.withColumn("period", F.col("period").cast("timestamp_ntz"))


@query("suggestion_queue", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus WHEN o_totalprice > 200000 THEN 'SUCCES' ELSE 'ERREUR' END AS status FROM orders")
def _(t: Tables) -> DataFrame:
    pending = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", kpis.WAITING).otherwise(F.col("o_orderstatus")).alias("status"), "o_totalprice")
    return kpis.process_waiting(pending, lambda df: df.select("o_orderkey", (F.col("o_totalprice") > 200000).alias("ok")), "o_orderkey").select("o_orderkey", "status")


@query("reconciled_ids", "SELECT o_orderkey, coalesce(c_name, 'new_' || o_orderkey) AS id FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def _(t: Tables) -> DataFrame:
    feed = t.orders.select("o_orderkey", F.col("o_custkey").alias("ext"), F.concat(F.lit("new_"), F.col("o_orderkey").cast("string")).alias("id"))
    store = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("ext"), F.col("c_name").alias("id"))
    return cdc.reconcile_ids(feed, store, ["ext"], "id").select("o_orderkey", "id")


@query("flagship_revenue", """
SELECT n_name, r_name, count(DISTINCT o_orderkey) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    # One exchange of lineitem: revenue is summed per order first, so orders count once without a distinct.
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    o = t.orders.select("o_orderkey", "o_custkey").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    joined = o.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("r"), 2).alias("revenue"))


@query("add_back_columns", "SELECT o_orderkey, upper(o_orderstatus) AS o_orderstatus, o_totalprice FROM orders")
def _(t: Tables) -> DataFrame:
    return rel.add_original_columns(t.orders.select("o_orderkey", F.upper("o_orderstatus").alias("o_orderstatus")), t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")

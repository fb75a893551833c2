"""Enrichment of places from registers: closed sites, names of directors, towns, missing identifiers, successions, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions import numbers, text
from placeloom.operators import geo, graph
from placeloom.operators import relational as rel


def closed_candidates(actors: DataFrame, sites: DataFrame) -> DataFrame:
    """Active places whose site is closed in the register."""
    closed = sites.filter(~F.col("est_actif")).select("siret", F.col("naf").alias("site_naf"), F.col("code_postal").alias("site_code_postal"), F.col("numero").alias("site_numero"), F.col("adresse_norm").alias("site_adresse_norm"), F.col("nom").alias("site_nom"))
    return actors.filter("statut = 'ACTIF'").join(closed, "siret").withColumn("siren", F.left("siret", F.lit(9)))


def replacements(candidates: DataFrame, sites: DataFrame) -> DataFrame:
    """The best active site at the same activity and address: same company first, then most words in common."""
    live = sites.filter("est_actif").select(F.col("naf").alias("site_naf"), F.col("code_postal").alias("site_code_postal"), F.col("numero").alias("site_numero"), F.col("adresse_norm").alias("site_adresse_norm"), F.col("siret").alias("remplacant_siret"), F.col("nom").alias("remplacant_nom"))
    keys = ["site_naf", "site_code_postal", "site_numero", "site_adresse_norm"]
    same = F.left("remplacant_siret", F.lit(9)) == F.col("siren")
    norm = lambda c: text.normalize_for_match(F.col(c))
    joined = candidates.join(live, keys).withColumns({"meme_siren": same, "mots_communs": text.words_in_common(norm("site_nom"), norm("remplacant_nom"))})
    return rel.top_one(joined, ["identifiant_unique"], F.desc("meme_siren"), F.desc_nulls_last("mots_communs"), F.asc("remplacant_siret"))


def closed_cohorts(candidates: DataFrame, replaced: DataFrame, units: DataFrame) -> DataFrame:
    """Four cohorts: replaced by a site of the same company, of another, not replaced and company closed, not replaced and site closed."""
    best = replaced.select("identifiant_unique", "remplacant_siret", "meme_siren")
    live = units.filter("est_actif").select("siren", F.lit(True).alias("unite_active"))
    cohort = F.when(F.col("meme_siren"), "replaced_same_siren").when(F.col("remplacant_siret").isNotNull(), "replaced_other_siren").when(F.col("unite_active"), "closed_site").otherwise("closed_company")
    return candidates.join(best, "identifiant_unique", "left").join(live, "siren", "left").select("identifiant_unique", "siret", "remplacant_siret", cohort.alias("suggest_cohort"))


def director_names(actors: DataFrame, directors: DataFrame) -> DataFrame:
    """Places whose name holds a director's first and last names. Blocked by company id, so only a company's directors are compared."""
    name = text.normalize_for_match(F.concat_ws(" ", "nom", "nom_officiel", "nom_commercial"))
    left = actors.filter(F.length("siren") == 9).select("identifiant_unique", "siren", name.alias("noms"))
    right = directors.select("siren", text.normalize_for_match(F.col("dirigeant_nom")).alias("dn"), text.normalize_for_match(F.col("dirigeant_prenom")).alias("dp"))
    return left.join(right, "siren").filter(F.contains("noms", F.col("dn")) & F.contains("noms", F.col("dp"))).select("identifiant_unique", "siren").distinct()


def town_suggestions(actors: DataFrame, addresses: DataFrame, typo: float = 0.7) -> DataFrame:
    """Within a postcode: towns that were renamed, and spellings close to the official one."""
    a = actors.select("identifiant_unique", "code_postal", "ville", text.string_basic(F.col("ville")).alias("n"))
    b = addresses.select("code_postal", "ville_actuelle", "ville_ancienne", text.string_basic(F.col("ville_actuelle")).alias("now"), text.string_basic(F.col("ville_ancienne")).alias("old"))
    from placeloom.operators.fuzzy import trigram_similarity

    j = a.join(b, "code_postal").filter("n <> now")
    cohort = F.when(F.col("n") == F.col("old"), "renamed").when(trigram_similarity(F.col("n"), F.col("now")) > typo, "typo")
    return j.withColumn("cohort", cohort).filter("cohort IS NOT NULL").groupBy("identifiant_unique").agg(F.min(F.struct("cohort", "ville_actuelle")).alias("m")).select("identifiant_unique", "m.cohort", F.col("m.ville_actuelle").alias("suggestion"))


def siret_from_siren(actors: DataFrame, sites: DataFrame) -> DataFrame:
    """The company's only active site, or else its only one in the postcode."""
    live = sites.filter("est_actif").select(F.left("siret", F.lit(9)).alias("siren"), "siret", "code_postal")
    only = lambda g: g.agg(F.min("siret").alias("a"), F.max("siret").alias("b")).filter("a = b").drop("b")
    whole = only(live.groupBy("siren")).withColumnRenamed("a", "siret_unique")
    local = only(live.groupBy("siren", "code_postal")).withColumnRenamed("a", "siret_local")
    need = actors.filter((F.length("siren") == 9) & (F.coalesce("siret", F.lit("")) == ""))
    return need.select("identifiant_unique", "siren", "code_postal").join(whole, "siren", "left").join(local, ["siren", "code_postal"], "left").select("identifiant_unique", "siren", F.coalesce("siret_unique", "siret_local").alias("siret")).filter("siret IS NOT NULL")


def siren_from_siret(actors: DataFrame, units: DataFrame) -> DataFrame:
    live = units.filter("est_actif").select("siren")
    need = actors.filter((F.length("siret") == 14) & (F.coalesce("siren", F.lit("")) == ""))
    return need.select("identifiant_unique", "siret", F.left("siret", F.lit(9)).alias("siren")).join(live, "siren", "left_semi")


def succession_suggestions(actors: DataFrame, links: DataFrame) -> DataFrame:
    """Places whose site has final successors."""
    closure = graph.succession_closure(actors.sparkSession, links)
    return actors.select("identifiant_unique", F.col("siret").alias("pred")).join(closure, "pred")


def identifier_coverage(actors: DataFrame, day: str) -> DataFrame:
    """One row per day: how many places have identifiers, and how many of these are active in the register."""
    n = F.count(F.lit(1))
    c = actors.agg(n.alias("nb_total"), F.count_if(text.digits_of_length(F.col("siren"), 9)).alias("nb_siren"), F.count_if(text.digits_of_length(F.col("siret"), 14)).alias("nb_siret"))
    return c.withColumns({"rate_siren": numbers.ratio_percent(F.col("nb_siren"), F.col("nb_total")), "rate_siret": numbers.ratio_percent(F.col("nb_siret"), F.col("nb_total")), "date_snapshot": F.to_date(F.lit(day))})


def first_service_distance(probes: DataFrame, actors: DataFrame, metres: float = 100_000.0) -> DataFrame:
    """Per action and in total: the mean distance to the nearest place and the mean number of places."""
    near = geo.nearest_within(probes, actors, metres, "probe", "action", "identifiant_unique")
    return rel.group_and_total(near, ["action"], [F.round(F.avg("distance_m"), 3).alias("mean_distance"), F.round(F.avg("n_solutions"), 3).alias("mean_solutions")], {"action": F.lit("TOUTES_ACTIONS")})


def service_drift(base: DataFrame, revision: DataFrame, keys: list[str]) -> DataFrame:
    """(key, side, map action to categories) of pairs that only the base or only the revision has."""
    sides = rel.symmetric_difference(base.select(*keys), revision.select(*keys))
    inner = sides.groupBy(keys[0], "side", keys[1]).agg(F.array_sort(F.collect_set(keys[2])).alias("c"))
    return inner.groupBy(keys[0], "side").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(keys[1], "c")))).alias("actions"))

"""Marts of places: overlay, map, open data, exhaustive view (actor-shaped frames in, frames out)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions import ids, text
from placeloom.operators import fuzzy
from placeloom.operators import relational as rel

ID = "identifiant_unique"


def overlay(base: DataFrame, revision: DataFrame) -> DataFrame:
    """The merged place with its uuid and short id. The creation date prefers the base."""
    merged = rel.overlay_merge(base, revision, ID, prefer_base=("cree_le",))
    return merged.withColumn("uuid", ids.uuid5(F.col(ID))).withColumn("short_id", ids.base57("uuid"))


def overlay_satellite(base: DataFrame, revision: DataFrame, actors: DataFrame, fk: str = "acteur_id") -> DataFrame:
    flags = actors.select(F.col(ID).alias(fk), "revision_exists")
    return rel.overlay_satellites(base, revision, flags, fk)


def filtered(actors: DataFrame, hidden_public: tuple[str, ...] = ("AUCUN", "PROFESSIONNELS")) -> DataFrame:
    """Active places with an active parent or none, open to the public, blanked sentinels."""
    shown = rel.visible_entities(actors, ID, "parent_id", "statut")
    shown = shown.filter(F.col("public_accueilli").isNull() | ~F.upper("public_accueilli").isin(*hidden_public))
    return shown.withColumns({f.name: text.blank_sentinel(F.col(f.name)) for f in shown.schema if f.dataType.simpleString() == "string" and f.name != ID})


def mart(actors: DataFrame, services: DataFrame) -> DataFrame:
    """Parents and childless places that have a service, one row each."""
    tops = actors.filter(F.col("parent_id").isNull())
    rolled = rel.roll_up_to_parent(services.select(F.col("acteur_id").alias(ID), "action"), actors, ID, "parent_id", ["action"])
    return tops.join(rolled.select(ID).distinct(), ID, "left_semi")


def rolled_services(actors: DataFrame, services: DataFrame) -> DataFrame:
    """(id, action, key) of the map: the union of the children's services under their parent, keyed parent_action."""
    rolled = rel.roll_up_to_parent(services.select(F.col("acteur_id").alias(ID), "action"), actors, ID, "parent_id", ["action"])
    return rolled.withColumn("key", F.concat_ws("_", ID, "action"))


def communes(actors: DataFrame, towns: DataFrame) -> DataFrame:
    """The commune (and its inter-municipal body) whose name is most like the place's town, within the postcode."""
    left = actors.select(ID, "code_postal", F.upper(text.unaccent(F.col("ville"))).alias("ville"))
    return fuzzy.best_match(left, towns, ["code_postal"], ID, "ville", "code_commune", "nom_commune")


def open_data(actors: DataFrame, services: DataFrame, labels: DataFrame, sources: DataFrame) -> DataFrame:
    """The export: licence-compatible sources, phones of mobiles and of protected sources redacted, lists sorted."""
    licensed = actors.join(sources.filter("licence = 'OPEN_LICENSE'").select("source_id", F.col("code").alias("source_code"), "protege_telephone"), "source_id")
    phone = F.when(F.col("telephone").rlike("^0[67]") | F.col("protege_telephone"), F.lit(None)).otherwise(F.col("telephone"))
    address = F.when(F.col("lieu_prestation") == "A_DOMICILE", F.lit(None)).otherwise(F.col("adresse"))
    nested = rel.nested_two_levels(services.withColumnRenamed("acteur_id", ID), ID, "action", "sous_categorie")
    label_list = rel.listagg_distinct(labels.withColumnRenamed("acteur_id", ID), [ID], "label", "labels")
    out = licensed.withColumn("telephone", phone).withColumn("adresse", address).join(nested, ID, "left").join(label_list, ID, "left")
    return out.select(ID, "nom", "telephone", "adresse", "code_postal", "ville", "source_code", "labels", F.to_json("services").alias("services"))


def exhaustive(actors: DataFrame, map_ids: DataFrame, open_ids: DataFrame) -> DataFrame:
    """Every place with its membership flags and its children."""
    kids = actors.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias(ID)).agg(F.array_sort(F.collect_list(ID)).alias("enfants"))
    out = rel.exists_flag(rel.exists_flag(actors, map_ids, ID, "est_dans_carte"), open_ids, ID, "est_dans_opendata").join(kids, ID, "left")
    return out.withColumns({"enfants": F.coalesce("enfants", F.array().cast("array<string>")), "est_parent": F.col("enfants").isNotNull()}).withColumn("nombre_enfants", F.size("enfants").cast("long"))

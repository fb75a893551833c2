"""Faceted, spatial and fuzzy search, as DataFrame builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.operators.fuzzy import trigrams, word_similarity


def faceted(entities: DataFrame, key: str, facets: list[tuple[DataFrame, Column]], exclude: Column | None = None) -> DataFrame:
    """Entities that have, for every facet, a satellite row that meets its condition; null exclusion flags don't exclude."""
    out = entities if exclude is None else entities.filter(~F.coalesce(exclude, F.lit(False)))
    for satellite, wanted in facets:
        out = out.join(satellite.filter(wanted).select(F.col(key)), key, "left_semi")
    return out


def first_with_rows(*choices: DataFrame) -> DataFrame:
    """The first frame that has a row, or the last: box, then radius, then area. Asks for one row of each in turn."""
    for c in choices[:-1]:
        if not c.isEmpty():
            return c
    return choices[-1]


def closest(points: DataFrame, k: int, tie: str) -> DataFrame:
    """The k nearest by ``distance_m``: a top-k, not a full sort."""
    return points.orderBy("distance_m", tie).limit(k)


def rank_terms(terms: DataFrame, query: str, title: str, body: str, norm: str, least: float = 0.2, boost: float = 0.5, top: int = 7, tie: str = "id") -> DataFrame:
    """max(title similarity * norm, body similarity) * (1 + boost if the title starts with the query), best first."""
    q = F.lit(query)
    prefix = F.startswith(F.lower(F.col(title)), F.lower(q))
    raw = F.greatest(word_similarity(q, F.col(title)) * F.col(norm), word_similarity(q, F.col(body)))
    met = F.arrays_overlap(trigrams(q), trigrams(F.concat_ws(" ", title, body)))  # others have no similarity
    scored = terms.filter(met).withColumn("raw", raw).filter(F.col("raw") >= least).withColumn("score", F.col("raw") * F.when(prefix, 1 + boost).otherwise(1.0))
    return scored.orderBy(F.desc("score"), tie).limit(top)


def page(df: DataFrame, number: int, size: int = 10, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def searchable(terms: DataFrame, *excluded: tuple[DataFrame, str, str]) -> DataFrame:
    """Terms that none of the exclusion tables lists."""
    for table, own, other in excluded:
        terms = terms.join(table.select(F.col(other).alias("__pl_x")), F.col(own) == F.col("__pl_x"), "left_anti")
    return terms

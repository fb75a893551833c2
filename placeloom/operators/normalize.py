"""Rule-driven normalisation with errors as data.

Rules are plain dictionaries. Their order is fixed: null words, renames, column transforms, defaults, row transforms,
removals; then rows with blocking errors are dropped and every failure is a log row. The whole plan is one projection
and one filter; logs are read from the same projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.functions import nested, numbers, text

Transform = Callable[..., Column]

#: Named transforms that rules may call, with the rule's ``options`` by name; those in CHECKED return struct(value, level, message).
PLAIN: dict[str, Transform] = {
    "strip": text.strip_string,
    "strip_lower": text.strip_lower_string,
    "clean_number": text.clean_number,
    "unaccent": text.unaccent,
    "string_basic": text.string_basic,
    "code_list": text.clean_code_list,
    "service_areas": text.service_areas,
    "hour_signs": nested.fix_hour_signs,
    "opening_hours": nested.opening_hours,
    "hours_text": lambda c: nested.opening_hours_french(nested.opening_hours(c)),
    "codes": lambda c, mapping: nested.map_codes(text.clean_code_list(c), mapping),
    "merged_codes": lambda *cols: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in cols])))),
    "flags": lambda *cols, names: nested.codes_of_flags(dict(zip(names, [c.try_cast("boolean") for c in cols], strict=True))),
    "labels": lambda c, bonus, ignored=(): nested.label_codes(c, F.coalesce(bonus.try_cast("boolean"), F.lit(False)), tuple(ignored)),
    "services": nested.services,
    "service_place": text.service_place,
    "entity_id": text.entity_id,
    "address": text.parse_address,
    "house_number": text.house_number,
    "department": text.department_code,
    "combine": text.combine,
    "format_name": text.format_name,
    "repair_url": text.repair_url,
    "geopoint": numbers.point,
    "location": lambda lon, lat: F.struct(numbers.parse_float(lat).alias("lat"), numbers.parse_float(lon).alias("lon")),
    "float": numbers.parse_float,
}
CHECKED: dict[str, Transform] = {
    "siren": text.clean_siren,
    "siret": text.clean_siret,
    "postcode": text.clean_postcode,
    "phone": text.clean_phone,
    "email": text.clean_email,
    "url": text.clean_url,
    "first_url": text.first_valid_url,
    "boolean": text.to_boolean,
    "label": text.map_label,
}


def validate_rules(rules: list[dict], columns: list[str]) -> None:
    """Raises before any job if a rule names an unknown transform, lacks a field or reads an unknown column."""
    known = set(columns)
    for r in rules:
        kind = r.get("rule")
        if kind not in ("rename", "transform", "default", "row", "remove", "keep"):
            raise ValueError(f"unknown rule: {kind}")
        if kind in ("transform", "row") and r["function"] not in PLAIN | CHECKED:
            raise ValueError(f"unknown function: {r['function']}")
        read = {"rename": [r.get("origin")], "transform": [r.get("origin")], "row": r.get("origins", []), "remove": [r.get("origin")], "keep": [r.get("origin")], "default": []}[kind]
        for c in read:
            if c not in known:
                raise ValueError(f"unknown column: {c}")
        known |= {r.get("destination")} - {None}


def normalize(df: DataFrame, rules: list[dict], key: str) -> tuple[DataFrame, DataFrame]:
    """(rows, logs): clean rows, and (key, field, level, message) of every failure, of dropped rows too."""
    validate_rules(rules, df.columns)
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    df = df.withColumns({c: text.null_words_to_empty(F.col(c)) for c in strings}).withColumn("__pl_log", F.array().cast("array<struct<field:string,level:string,message:string>>"))
    for kind in ("rename", "transform", "default", "row", "remove"):
        for r in (r for r in rules if r["rule"] == kind):
            if kind == "rename":
                df = df.withColumnRenamed(r["origin"], r["destination"])
            elif kind == "default":
                df = df.withColumn(r["destination"], F.lit(r["value"]))
            elif kind == "remove":
                df = df.drop(r["origin"])
            else:
                origins = [F.col(c) for c in (r["origins"] if kind == "row" else [r["origin"]])]
                name, to, options = r["function"], r["destination"], r.get("options", {})
                if name in PLAIN:
                    df = df.withColumn(to, PLAIN[name](*origins, **options))
                else:
                    level = r.get("level", "warning")
                    df = df.withColumn("__pl_r", CHECKED[name](*origins, **options))
                    entry = F.struct(F.lit(to).alias("field"), F.lit(level).alias("level"), F.col("__pl_r.message").alias("message"))
                    df = df.withColumn("__pl_log", F.when(F.col("__pl_r.level").isNotNull(), F.concat("__pl_log", F.array(entry))).otherwise(F.col("__pl_log"))).withColumn(to, F.col("__pl_r.value")).drop("__pl_r")
    kept = [r["origin"] for r in rules if r["rule"] == "keep"] + [r["destination"] for r in rules if "destination" in r]
    wanted = list(dict.fromkeys(c for c in [key, *kept] if c in df.columns))
    logs = df.select(key, F.explode("__pl_log").alias("l")).select(key, "l.*")
    rows = df.filter(~F.exists("__pl_log", lambda x: x["level"] == "error")).select(*wanted)
    return rows, logs


def content_filters(df: DataFrame, key: str, categories: str, digital: Column, lat: str, lon: str) -> DataFrame:
    """Rows with a category, the first of each id, with a location unless digital."""
    from placeloom.operators.relational import top_one

    filled = df.filter((F.size(categories) > 0) & (digital | (F.col(lat).isNotNull() & F.col(lon).isNotNull())))
    return top_one(filled, [key], F.col(lat).asc_nulls_last(), F.col(lon).asc_nulls_last(), F.to_json(F.struct(*df.columns)).asc())

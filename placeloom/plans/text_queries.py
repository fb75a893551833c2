"""Bindings of the scalar functions to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions import ids, nested, numbers, text
from placeloom.plans.entity_queries import duck_base57, duck_uuid5
from placeloom.plans.registry import Tables, query
from placeloom.sources import readers, writers

_A, _B = text.ACCENTED, text.UNACCENTED


def _plain(sql: str) -> str:
    """SQL twin of ``unaccent``."""
    return f"replace(replace(replace(replace(replace(translate({sql}, '{_A}', '{_B}'), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE'), 'ß', 'ss')"


_WORDS = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) >= {1})"


@query("normalize_for_match", f"SELECT doc_id, nullif(array_to_string(list_sort({_WORDS.format(_plain('text'), 2)}), ' '), '') AS norm FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalize_for_match(F.col("text")).alias("norm"))


@query("string_basic", f"SELECT conv_id, turn, trim(regexp_replace(lower({_plain('text')}), '[^a-z0-9]+', ' ', 'g')) AS basic FROM conversations")
def _(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.string_basic(F.col("text")).alias("basic"))


@query("words_in_common", """
SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda w: w <> '' AND contains(p_type || ' ring widget bolt', w)))::BIGINT AS n FROM part""")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.words_in_common(F.col("p_name"), F.concat("p_type", F.lit(" ring widget bolt"))).alias("n"))


@query("concat_unique", """
SELECT p_partkey, nullif(array_to_string(list_sort(list_distinct(list_filter([p_brand, p_type, CASE WHEN p_size > 20 THEN p_type ELSE '' END, CASE WHEN p_size > 40 THEN 'x' END], lambda v: v IS NOT NULL AND v <> ''))), ' '), '') AS joined FROM part""")
def _(t: Tables) -> DataFrame:
    parts = [F.col("p_brand"), F.col("p_type"), F.when(F.col("p_size") > 20, F.col("p_type")).otherwise(""), F.when(F.col("p_size") > 40, "x")]
    return t.part.select("p_partkey", text.concat_unique_non_empty(*parts).alias("joined"))


@query("register_cleanup", """
SELECT c_custkey, nullif(nullif(trim(v), ''), '[ND]') AS clean FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' [ND] ' WHEN 1 THEN '   ' WHEN 2 THEN NULL ELSE '  ' || c_name END AS v FROM customer)""")
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, " [ND] ").when(k == 1, "   ").when(k == 3, F.concat(F.lit("  "), "c_name"))
    return t.customer.select("c_custkey", text.register_cleanup(v).alias("clean"))


@query("small_and_unique_words", """
SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda w: length(w) > 4), ' ') AS long_words,
  array_to_string(list_sort(list_distinct(list_filter(string_split(p_name || ' ' || p_name, ' '), lambda w: w <> ''))), ' ') AS unique_words FROM part""")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.remove_small_words(F.col("p_name"), 4).alias("long_words"), text.order_unique_words(F.concat_ws(" ", "p_name", "p_name")).alias("unique_words"))


@query("null_words", """
SELECT event_id, CASE WHEN lower(trim(v)) IN ('null', 'none', 'nan', 'na', 'n/a', 'non applicable', 'aucun', '-') THEN '' ELSE v END AS v
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' N/A' WHEN 1 THEN 'Aucun' WHEN 2 THEN '-' WHEN 3 THEN 'aucune' ELSE event_type END AS v FROM events)""")
def _(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    v = F.when(k == 0, " N/A").when(k == 1, "Aucun").when(k == 2, "-").when(k == 3, "aucune").otherwise(F.col("event_type"))
    return t.events.select("event_id", text.null_words_to_empty(v).alias("v"))


@query("clean_numbers_codes", """
WITH v AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lpad(c_custkey::VARCHAR, 9, '1') WHEN 1 THEN lpad(c_custkey::VARCHAR, 13, '2') || '.0' WHEN 2 THEN '12 345' WHEN 3 THEN 'F-' || lpad(c_custkey::VARCHAR, 4, '7') ELSE '' END AS s FROM customer),
n AS (SELECT *, regexp_replace(regexp_replace(s, '\\.0$', ''), '[^0-9+]', '', 'g') AS n FROM v)
SELECT c_custkey, n AS number, CASE WHEN n <> '' AND length(n) <> 9 THEN '' ELSE n END AS siren,
  CASE WHEN n <> '' AND length(n) NOT IN (9, 13, 14) THEN '' WHEN length(n) = 13 THEN '0' || n ELSE n END AS siret,
  CASE WHEN n <> '' AND length(CASE WHEN length(n) = 4 THEN '0' || n ELSE n END) <> 5 THEN '' WHEN length(n) = 4 THEN '0' || n ELSE n END AS postcode,
  (n <> '' AND length(n) NOT IN (9, 13, 14)) AS siret_failed FROM n""".replace("\\\\", "\\"))
def _(t: Tables) -> DataFrame:
    k, s = F.col("c_custkey") % 5, F.col("c_custkey").cast("string")
    v = F.when(k == 0, F.lpad(s, 9, "1")).when(k == 1, F.concat(F.lpad(s, 13, "2"), F.lit(".0"))).when(k == 2, "12 345").when(k == 3, F.concat(F.lit("F-"), F.lpad(s, 4, "7"))).otherwise("")
    df = t.customer.select("c_custkey", v.alias("s"))
    c = F.col("s")
    return df.select("c_custkey", text.clean_number(c).alias("number"), text.clean_siren(c)["value"].alias("siren"), text.clean_siret(c)["value"].alias("siret"), text.clean_postcode(c)["value"].alias("postcode"), text.clean_siret(c)["level"].isNotNull().alias("siret_failed"))


@query("clean_phone", """
WITH v AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '33 ' || lpad(c_custkey::VARCHAR, 9, '6') WHEN 1 THEN lpad(c_custkey::VARCHAR, 9, '7') WHEN 2 THEN '12-34' ELSE '' END AS p, lpad((c_custkey * 37 % 99000)::VARCHAR, 5, '0') AS cp FROM customer),
n AS (SELECT *, regexp_replace(p, '[^0-9+]', '', 'g') AS n FROM v), m AS (SELECT *, CASE WHEN length(n) = 9 AND cp::INTEGER < 96000 THEN '0' || n ELSE n END AS m FROM n), o AS (SELECT *, CASE WHEN starts_with(m, '33') THEN '0' || substr(m, 3) ELSE m END AS o FROM m)
SELECT c_custkey, CASE WHEN o <> '' AND length(o) < 6 THEN '' ELSE o END AS phone, (o <> '' AND length(o) < 6) AS failed FROM o""")
def _(t: Tables) -> DataFrame:
    k, s = F.col("c_custkey") % 4, F.col("c_custkey").cast("string")
    p = F.when(k == 0, F.concat(F.lit("33 "), F.lpad(s, 9, "6"))).when(k == 1, F.lpad(s, 9, "7")).when(k == 2, "12-34").otherwise("")
    df = t.customer.select("c_custkey", p.alias("p"), F.lpad((F.col("c_custkey") * 37 % 99000).cast("string"), 5, "0").alias("cp"))
    c = text.clean_phone(F.col("p"), F.col("cp"))
    return df.select("c_custkey", c["value"].alias("phone"), c["level"].isNotNull().alias("failed"))


@query("bool_cast", """
SELECT event_id, CASE WHEN lower(trim(v)) IN ('oui', 'yes', 'true') THEN true WHEN lower(trim(v)) IN ('non', 'no', 'false') THEN false END AS flag, (v IS NOT NULL AND trim(v) <> '' AND lower(trim(v)) NOT IN ('oui', 'yes', 'true', 'non', 'no', 'false')) AS failed
FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' Oui' WHEN 1 THEN 'NO' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'peut-être' ELSE 'true' END AS v FROM events)""")
def _(t: Tables) -> DataFrame:
    k = F.col("event_id") % 6
    v = F.when(k == 0, " Oui").when(k == 1, "NO").when(k == 2, "").when(k == 4, "peut-être").when(k == 5, "true")
    b = text.to_boolean(F.col("v"))
    return t.events.select("event_id", v.alias("v")).select("event_id", b["value"].alias("flag"), b["level"].isNotNull().alias("failed"))


@query("url_domains", r"""
SELECT page_id, regexp_matches(url, '^https?://([a-zA-Z0-9_-]+\.)+[a-zA-Z]{2,}(/[^\s]*)?$') AS valid, CASE WHEN regexp_matches(url, '^https?://([a-zA-Z0-9_-]+\.)+[a-zA-Z]{2,}(/[^\s]*)?$') THEN nullif(regexp_extract(url, '^https?://([^/:]+)', 1), '') END AS domain,
  regexp_replace(lower(trim(url)), '^https?://(www\.)?|/$', '', 'g') = regexp_replace(lower(trim(replace(url, 'http://', 'https://www.') || '/')), '^https?://(www\.)?|/$', '', 'g') AS same FROM pages""")
def _(t: Tables) -> DataFrame:
    u = F.col("url")
    other = F.concat(F.replace(u, F.lit("http://"), F.lit("https://www.")), F.lit("/"))
    return t.pages.select("page_id", text.url_is_valid(u).alias("valid"), text.url_domain(u).alias("domain"), text.urls_standard_difference(u, other).alias("same"))


#: What corrupted urls begin with, and what that is mended to.
_HEADS = [("http:///ww.", "http://www."), ("https//", "https://"), ("noise https://wwww", "https://www."), ("httphttp://", "http://"), ("", "https://"), ("https::://wwwww.", "https://www."), ("//", "https://"), ("https:", "https://"), ("https://http://ww", "http://www.")]


@query("url_repair", rf"""
WITH u AS (SELECT page_id, regexp_replace(url, '^https?://(www\.)?', '') || CASE WHEN page_id % 4 = 0 THEN '/en' WHEN page_id % 4 = 1 THEN '/en/' ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, [{", ".join(f"'{good}'" for _, good in _HEADS)}][(page_id % {len(_HEADS)} + 1)::INTEGER] || CASE WHEN page_id % 4 < 2 THEN regexp_replace(rest, '/en/?$', '/') ELSE rest END AS r FROM u), w AS (SELECT page_id, r, replace(r, 'http://', 'https://') AS s FROM v)
SELECT page_id, r AS repaired, CASE WHEN regexp_matches(s, '^https?://([a-zA-Z0-9_-]+\.)+[a-zA-Z]{{2,}}(/[^\s]*)?$') THEN CASE WHEN r = s THEN s ELSE s || ' ' || r END ELSE '' END AS to_try FROM w""")
def _(t: Tables) -> DataFrame:
    k = F.col("page_id")
    head = F.get(F.array(*[F.lit(bad) for bad, _ in _HEADS]), (k % len(_HEADS)).cast("int"))
    u = F.concat(head, F.regexp_replace("url", r"^https?://(www\.)?", ""), F.when(k % 4 == 0, "/en").when(k % 4 == 1, "/en/").otherwise(""))
    return t.pages.select("page_id", text.repair_url(u).alias("repaired"), F.array_join(text.urls_to_try(u), " ").alias("to_try"))


@query("split_codes", """
SELECT o_orderkey, array_to_string(list_filter(list_transform(string_split(v, '|'), lambda x: lower(trim(x))), lambda x: x <> ''), ',') AS codes FROM (SELECT o_orderkey, o_orderpriority || ' | |' || o_orderstatus || '|' AS v FROM orders)""")
def _(t: Tables) -> DataFrame:
    v = F.concat("o_orderpriority", F.lit(" | |"), "o_orderstatus", F.lit("|"))
    return t.orders.select("o_orderkey", F.array_join(text.clean_code_list(v), ",").alias("codes"))


@query("address_parse", r"""
WITH a AS (SELECT c_custkey, c_custkey || ' bis rue de la ' || lower(c_mktsegment) || ', ' || lpad((c_custkey % 95000 + 1000)::VARCHAR, 5, '0') || ' ' || lower(c_mktsegment) || ' CEDEX 9' AS a FROM customer), b AS (SELECT c_custkey, trim(regexp_replace(a, '(?i)\bCEDEX\s*\d*\b', '', 'g')) AS a FROM a)
SELECT c_custkey, regexp_replace(regexp_extract(a, '^(.*)[\s,\-]+(\d{4,5})[\s,\-]*(.*)$', 1), '^[\s,\-]+|[\s,\-]+$', '', 'g') AS address, regexp_extract(a, '^(.*)[\s,\-]+(\d{4,5})[\s,\-]*(.*)$', 2) AS postcode,
  upper(substr(regexp_extract(a, '^(.*)[\s,\-]+(\d{4,5})[\s,\-]*(.*)$', 3), 1, 1)) || substr(regexp_extract(a, '^(.*)[\s,\-]+(\d{4,5})[\s,\-]*(.*)$', 3), 2) AS city, regexp_extract(a, '^\d+') || ' b' AS house FROM b""")
def _(t: Tables) -> DataFrame:
    seg = F.lower("c_mktsegment")
    code = F.lpad((F.col("c_custkey") % 95000 + 1000).cast("string"), 5, "0")
    a = F.concat(F.col("c_custkey").cast("string"), F.lit(" bis rue de la "), seg, F.lit(", "), code, F.lit(" "), seg, F.lit(" CEDEX 9"))
    df = t.customer.select("c_custkey", a.alias("a")).withColumn("p", text.parse_address(F.col("a")))
    return df.select("c_custkey", "p.address", "p.postcode", "p.city", text.house_number(F.col("a")).alias("house"))


@query("entity_ids", f"""
SELECT s_suppkey, regexp_replace(lower(trim({_plain("'Éco  Source ' || (s_suppkey % 3)")})), '\\s+', '_', 'g') || '_' || regexp_replace(replace(trim(' ' || s_name || '/x y'), '/', '-'), '\\s+', '', 'g') || CASE WHEN s_suppkey % 2 = 0 THEN '_d' ELSE '' END AS id, CASE WHEN length(lpad((s_suppkey * 97 % 99000)::VARCHAR, 5, '0')) = 5 THEN substr(lpad((s_suppkey * 97 % 99000)::VARCHAR, 5, '0'), 1, 2) END AS department FROM supplier""")
def _(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    source = F.concat(F.lit("Éco  Source "), (k % 3).cast("string"))
    return t.supplier.select("s_suppkey", text.entity_id(source, F.concat(F.lit(" "), "s_name", F.lit("/x y")), k % 2 == 0).alias("id"), text.department_code(F.lpad((k * 97 % 99000).cast("string"), 5, "0")).alias("department"))


@query("label_mapping", """
SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'eco' WHEN 'STANDARD' THEN 'std' WHEN 'PROMO' THEN 'promo' ELSE '' END AS code, p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO') AS failed FROM part""")
def _(t: Tables) -> DataFrame:
    m = text.map_label(F.col("p_type"), {"economy": "eco", "standard": "std", "promo": "promo"})
    return t.part.select("p_partkey", m["value"].alias("code"), m["level"].isNotNull().alias("failed"))


@query("service_areas", """
SELECT s_suppkey, 'DEPARTEMENTAL:' || lpad((s_suppkey % 20)::VARCHAR, 2, '0') || ',DROM_TOM:,FRANCE_METROPOLITAINE:,KILOMETRIQUE:' || (s_suppkey % 90 + 1) AS areas, 'A_DOMICILE' AS place FROM supplier""")
def _(t: Tables) -> DataFrame:
    v = F.concat((F.col("s_suppkey") % 90 + 1).cast("string"), F.lit(" km | "), (F.col("s_suppkey") % 20).cast("string"), F.lit("|France métropolitaine y compris DROM TOM|ailleurs"))
    areas = text.service_areas(v)
    return t.supplier.select("s_suppkey", F.array_join(F.transform(areas, lambda a: F.concat_ws(":", a["type"], a["value"])), ",").alias("areas"), text.service_place(F.lit("Oui, uniquement à domicile"), "^OUI, UNIQ", "^OUI").alias("place"))


@query("names_and_prefixes", """
SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'BUILD') THEN replace(c_mktsegment, 'BUILD', 'MAKE') ELSE c_mktsegment END AS renamed, nullif(trim(trim(coalesce(c_name, '')) || ' ' || trim('')), '') AS combined FROM customer""")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", text.rename_prefix(F.col("c_mktsegment"), "BUILD", "MAKE").alias("renamed"), text.combine(F.col("c_name"), F.lit("")).alias("combined"))


@query("format_names", """
SELECT s_suppkey, 'SAS ' || upper(substr(s_name, 1, 1)) || lower(substr(s_name, 2)) || ' Éts' AS name, 'Café de la Gare' AS without, '[{"message":"' || s_name || '"}]' AS comments FROM supplier""")
def _(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", text.format_name(F.concat(F.lit("sas "), F.lower("s_name"), F.lit(" ets"))).alias("name"), text.remove_substring_normalized(F.lit("Café de la Gare Lyon"), F.lit("lyon")).alias("without"), text.append_comment(F.lit(None).cast("string"), F.col("s_name")).alias("comments"))


@query("uuid5_ids", f"WITH u AS (SELECT c_custkey, {duck_uuid5('c_name')} AS uuid FROM customer) SELECT c_custkey, uuid, {duck_base57('uuid')} AS short_id FROM u")
def _(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", ids.uuid5(F.col("c_name")).alias("uuid")).withColumn("short_id", ids.base57(F.col("uuid")))


@query("stable_hash_sample", "SELECT c_custkey, md5('a=' || c_custkey || '&b=' || c_name) AS k FROM customer WHERE ('0x' || substr(md5(c_name), 1, 8))::BIGINT % 10 = 0")
def _(t: Tables) -> DataFrame:
    key = ids.cache_key(F.concat(F.lit("b="), "c_name"), F.concat(F.lit("a="), F.col("c_custkey").cast("string")))
    return t.customer.filter(ids.in_stable_sample(F.col("c_name"), 10)).select("c_custkey", key.alias("k"))


@query("rounding_and_floats", """
SELECT l_orderkey, l_linenumber, round(l_extendedprice::DECIMAL(30, 10), 1)::DOUBLE AS rounded, replace(regexp_replace(v, ',$', ''), ',', '.')::DOUBLE AS parsed FROM (SELECT *, l_linenumber || ',5,' AS v FROM lineitem)""")
def _(t: Tables) -> DataFrame:
    v = F.concat(F.col("l_linenumber").cast("string"), F.lit(",5,"))
    return t.lineitem.select("l_orderkey", "l_linenumber", numbers.round_half_up(F.col("l_extendedprice"), 1).cast("double").alias("rounded"), numbers.parse_float(v).alias("parsed"))


@query("divmod_floor", "SELECT c_custkey, floor((c_custkey - 700) / 7)::BIGINT AS q, ((c_custkey - 700) % 7 + 7) % 7 AS r FROM customer")
def _(t: Tables) -> DataFrame:
    q, r = numbers.divmod_floor(F.col("c_custkey") - 700, F.lit(7))
    return t.customer.select("c_custkey", q.alias("q"), r.cast("long").alias("r"))


@query("date_trunc_buckets", """
SELECT event_type, date_trunc('week', ts)::TIMESTAMP AS week, date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS n FROM events GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.groupBy("event_type", numbers.floor_period(ts, "week").cast("timestamp_ntz").alias("week"), numbers.floor_period(ts, "month").cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("period_shift", """
SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 2 MONTH, '%Y-%m-%d') AS month2, strftime(date_trunc('week', o_orderdate) - INTERVAL 7 DAY, '%Y-%m-%d') AS week_before, strftime(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR, '%Y-%m-%d') AS next_year, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def _(t: Tables) -> DataFrame:
    d, day = F.col("o_orderdate"), lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.orders.select("o_orderkey", day(numbers.shift_period(d, "month", 2)).alias("month2"), day(numbers.shift_period(d, "week", -1)).alias("week_before"), day(numbers.shift_period(d, "year", 1)).alias("next_year"), day(d).alias("day"))


@query("json_props_extract", "SELECT event_id, (props->>'k')::BIGINT AS k, json_object('id', event_id, 'type', event_type, 'none', NULL)::VARCHAR AS doc FROM events")
def _(t: Tables) -> DataFrame:
    doc = nested.as_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.lit(None).cast("string").alias("none")))
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"), doc.alias("doc"))


@query("json_pivot", """
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, string_agg(DISTINCT (props->>'k'), '|' ORDER BY (props->>'k')) FILTER (event_type = 'click') AS click_keys FROM events GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    is_ = lambda e: F.col("event_type") == e
    keys = F.array_join(F.array_sort(F.collect_set(F.when(is_("click"), k))), "|")
    return t.events.groupBy("user_id").agg(F.count_if(is_("click")).alias("click"), F.count_if(is_("error")).alias("error"), F.nullif(keys, F.lit("")).alias("click_keys"))


@query("array_codes", """
SELECT p_partkey, array_to_string(list_sort(list_distinct(flatten([CASE WHEN p_size % 2 = 0 THEN ['a1', 'a2'] ELSE [] END, CASE WHEN p_size % 3 = 0 THEN ['b1', 'a2'] ELSE [] END]))), ',') AS mapped,
  array_to_string(list_filter([CASE WHEN p_size > 10 THEN 'big' END, CASE WHEN p_type = 'PROMO' THEN 'promo' END], lambda x: x IS NOT NULL), ',') AS flags FROM part""")
def _(t: Tables) -> DataFrame:
    codes = F.filter(F.array(F.when(F.col("p_size") % 2 == 0, " A"), F.when(F.col("p_size") % 3 == 0, "b"), F.lit("unknown")), lambda x: x.isNotNull())
    flags = nested.codes_of_flags({"big": F.col("p_size") > 10, "promo": F.col("p_type") == "PROMO"})
    return t.part.select("p_partkey", F.array_join(nested.map_codes(codes, {"a": ["a1", "a2"], "b": ["b1", "a2"]}), ",").alias("mapped"), F.array_join(flags, ",").alias("flags"))


@query("services_and_labels", """
WITH p AS (SELECT *, '[' || CASE WHEN p_type < p_brand THEN '"' || p_type || '","' || p_brand ELSE '"' || p_brand || '","' || p_type END || '"]' AS cats FROM part)
SELECT p_partkey, '[{"action":"donner","categories":' || cats || '},{"action":"reparer","categories":' || cats || '}]' AS services, CASE WHEN p_size > 25 THEN 'bonus,' ELSE '' END || lower(p_type) || ',ess' AS labels, p_name || ' | ' || p_brand AS joined, '{"type":"' || p_type || '","size":' || p_size || '}' AS fields FROM p""")
def _(t: Tables) -> DataFrame:
    s = nested.services(F.array(F.lit("reparer"), F.lit("donner")), F.array("p_type", "p_brand"))
    labels = nested.label_codes(F.concat("p_type", F.lit("| ESS |x")), F.col("p_size") > 25, ("x",))
    return t.part.select("p_partkey", F.to_json(s).alias("services"), F.array_join(labels, ",").alias("labels"), nested.join_non_empty("p_name", F.lit(""), "p_brand").alias("joined"), F.to_json(nested.prefixed(["p_type", "p_size"], "p_")).alias("fields"))


_WEEK = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")
#: Rules, and the hours of each day of the week that they mean.
_HOURS = [
    ("24/7", ["00:00 - 23:59"] * 7),
    ("Mo-Fr 09h00-12:00,11:30-13:00; Sa 10:00-12:00", ["09:00 - 13:00"] * 5 + ["10:00 - 12:00", "Fermé"]),
    ("08:00-20:00", ["08:00 - 20:00"] * 7),
    ("Mo-Sa 09:00-12:00, 14:00-18:00; We off; PH off", [*["09:00 - 12:00; 14:00 - 18:00"] * 2, "Fermé", *["09:00 - 12:00; 14:00 - 18:00"] * 3, "Fermé"]),
    ("Fr-Mo 22:00-02:00", ["00:00 - 02:00; 22:00 - 24:00", "00:00 - 02:00", "Fermé", "Fermé", "22:00 - 24:00", *["00:00 - 02:00; 22:00 - 24:00"] * 2]),
    ("Mo,We 08:00-10:00, Tu 09:00-11:00; We 15:00-16:00", ["08:00 - 10:00", "09:00 - 11:00", "15:00 - 16:00", *["Fermé"] * 4]),
]


@query("opening_hours", "SELECT s_suppkey, CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN '" + "' || chr(10) || '".join(f"{d}: {h}" for d, h in zip(_WEEK, hours, strict=True)) + "'" for i, (_, hours) in enumerate(_HOURS)) + " END AS hours FROM supplier")
def _(t: Tables) -> DataFrame:
    rule = F.get(F.array(*[F.lit(r) for r, _ in _HOURS]), (F.col("s_suppkey") % 6).cast("int"))
    hours = nested.opening_hours(nested.fix_hour_signs(rule))
    return t.supplier.select("s_suppkey", nested.opening_hours_french(hours).alias("hours"))


_BYTES = "hex({0}::DOUBLE::BIT::BLOB)"
_SWAPPED = " || ".join(f"substr({_BYTES}, {i}, 2)" for i in range(15, 0, -2))


@query("points_and_wkb", f"""
WITH p AS (SELECT s_suppkey, (s_suppkey % 80)::DOUBLE AS lat, (s_suppkey % 170)::DOUBLE AS lon FROM supplier)
SELECT s_suppkey, lat, lon, '0101000000' || {_SWAPPED.format('lon')} || {_SWAPPED.format('lat')} AS wkb, 1000.0::DOUBLE / (111320.0::DOUBLE * cos(radians(lat))) AS degrees FROM p""")
def _(t: Tables) -> DataFrame:
    p = t.supplier.select("s_suppkey", numbers.point(F.concat_ws(",", (F.col("s_suppkey") % 80).cast("string"), (F.col("s_suppkey") % 170).cast("string"))).alias("p"))
    return p.select("s_suppkey", "p.lat", "p.lon", numbers.wkb_hex(F.col("p.lon"), F.col("p.lat")).alias("wkb"), numbers.metres_to_degrees(F.lit(1000.0), F.col("p.lat")).alias("degrees"))


@query("sql_functions", f"""
SELECT p_partkey, nullif(array_to_string(list_sort({_WORDS.format('p_name', 2)}), ' '), '') AS norm, NULL::VARCHAR AS nd, len(list_filter(string_split(p_name, ' '), lambda w: w <> '' AND contains(p_type, w)))::BIGINT AS common,
  array_to_string(list_sort(list_distinct([p_brand, p_type])), ' ') AS joined, p_partkey // 7 AS q FROM part""")
def _(t: Tables) -> DataFrame:
    text.register_functions(t.spark)
    t.part.createOrReplaceTempView("pl_part")
    return t.spark.sql("SELECT p_partkey, pl_normalize_for_match(p_name) AS norm, pl_cleanup(' [ND]') AS nd, pl_words_in_common(p_name, p_type) AS common, pl_concat_unique(array(p_brand, p_type, '')) AS joined, pl_divmod(p_partkey, 7).quotient AS q FROM pl_part")


@query("table_functions", "SELECT p_brand, count(*) AS n FROM part WHERE p_size >= 30 GROUP BY 1 HAVING count(*) >= 2")
def _(t: Tables) -> DataFrame:
    t.part.createOrReplaceTempView("pl_part")
    text.register_table_function(t.spark, "pl_frequent", "least INT, size INT", "brand STRING, n BIGINT", "SELECT p_brand, count(*) FROM pl_part WHERE p_size >= size GROUP BY p_brand HAVING count(*) >= least")
    return t.spark.sql("SELECT brand AS p_brand, n FROM pl_frequent(2, 30)")


@query("codes_as_json", """
SELECT p_partkey, '["' || p_type || '","' || p_brand || '"]' AS stored, p_brand AS second FROM part""")
def _(t: Tables) -> DataFrame:
    stored = writers.codes_as_json(t.part.select("p_partkey", F.array("p_type", "p_brand").alias("part_codes")))
    back = readers.parsed_codes(stored.withColumn("stored", F.col("part_codes")), {"part_codes": "array<string>"})
    return back.select("p_partkey", "stored", F.get("part_codes", F.lit(1)).alias("second"))

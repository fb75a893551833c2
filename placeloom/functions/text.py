"""String functions as native column expressions.

Cleaners that can fail return struct(value, level, message): level is null for a clean value, ``warning`` if the value is
blanked, ``error`` if the row can't be used. The rule engine turns the struct into columns and log rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Accented letters and their base letters, null words, French and English truth words.
ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿøÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝŸØ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyyoAAAAAACEEEEIIIINOOOOOUUUUYYO"
LIGATURES = (("œ", "oe"), ("Œ", "OE"), ("æ", "ae"), ("Æ", "AE"), ("ß", "ss"))
NULL_WORDS = ("null", "none", "nan", "na", "n/a", "non applicable", "aucun", "-")
TRUE_WORDS = ("oui", "yes", "true")
FALSE_WORDS = ("non", "no", "false")
EMPTY = "__empty__"
NOT_DISCLOSED = "[ND]"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonnull(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def checked(value: Column, failed: Column, message: Column, level: str = "warning") -> Column:
    """struct(value, level, message) of a cleaner."""
    return F.struct(F.when(failed, F.lit("")).otherwise(value).alias("value"), F.when(failed, F.lit(level)).alias("level"), F.when(failed, message).alias("message"))


def unaccent(c: Column) -> Column:
    """Letters without diacritics, ligatures spelt out."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), LIGATURES, F.translate(c, ACCENTED, UNACCENTED))


def register_cleanup(c: Column) -> Column:
    """Trimmed; empty and not-disclosed values become null."""
    return F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit(NOT_DISCLOSED))


def coalesce_empty(first: Column, second: Column) -> Column:
    """The overlay rule for text: the first that is neither null nor empty, the second, or the empty string."""
    return F.coalesce(F.nullif(first, F.lit("")), second, F.lit(""))


def blank_sentinel(c: Column) -> Column:
    return F.when(c == EMPTY, F.lit("")).otherwise(c)


def normalize_for_match(c: Column, min_word: int = 2) -> Column:
    """Sorted lower-case a-z words of at least ``min_word`` letters, joined by one space; null if none is left."""
    letters = F.regexp_replace(F.lower(unaccent(c)), "[^a-z]+", " ")
    return F.nullif(F.array_join(F.filter(F.array_sort(F.split(letters, " ")), lambda w: F.length(w) >= min_word), " "), F.lit(""))


def words_in_common(a: Column, b: Column) -> Column:
    """How many words of ``a``, repeats counted, are substrings of ``b``."""
    return F.size(F.filter(F.split(a, " "), lambda w: (w != "") & (F.contains(b, w)))).cast("long")


def concat_unique_non_empty(*cols: Column) -> Column:
    """Sorted distinct non-empty values joined by a space; null if there is none."""
    values = F.filter(F.array(*cols), lambda v: v.isNotNull() & (v != ""))
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(values)), " "), F.lit(""))


def string_basic(c: Column) -> Column:
    """Unaccented, lower case, other characters than a-z and 0-9 as single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.lower(unaccent(nonnull(c))), "[^a-z0-9]+", " "))


def remove_small_words(c: Column, size: int) -> Column:
    """Words longer than ``size``."""
    return F.array_join(F.filter(F.split(c, " "), lambda w: F.length(w) > size), " ")


def order_unique_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))), " ")


def remove_substring_normalized(whole: Column, part: Column) -> Column:
    """``whole`` without the words of ``part``, compared in basic form; unchanged where the forms don't line up."""
    a, b = F.trim(nonnull(whole)), F.trim(nonnull(part))
    na, nb = string_basic(a), string_basic(b)
    wa = F.filter(F.split(a, r"\s+"), lambda w: w != "")
    wn, wb = F.filter(F.split(na, " "), lambda w: w != ""), F.split(nb, " ")
    kept = F.filter(F.arrays_zip(wa.alias("w"), wn.alias("n")), lambda p: ~F.array_contains(wb, p["n"]))
    aligned = F.size(wa) == F.size(wn)
    return F.nullif(F.when(F.contains(na, nb) & (nb != "") & aligned, F.array_join(F.transform(kept, lambda p: p["w"]), " ")).otherwise(a), F.lit(""))


def null_words_to_empty(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).isin(*NULL_WORDS), F.lit("")).otherwise(c)


def null_words_out(values: Column) -> Column:
    """An array without its null words."""
    return F.filter(values, lambda v: ~F.lower(F.trim(v)).isin(*NULL_WORDS))


def strip_string(c: Column) -> Column:
    return F.trim(nonnull(c))


def strip_lower_string(c: Column) -> Column:
    return F.lower(F.trim(nonnull(c)))


def clean_number(c: Column) -> Column:
    """Digits and plus signs, a trailing ``.0`` dropped."""
    return F.regexp_replace(F.regexp_replace(nonnull(c), r"\.0$", ""), r"[^0-9+]", "")


def clean_siren(c: Column) -> Column:
    n = clean_number(c)
    return checked(n, (n != "") & (F.length(n) != 9), F.concat(F.lit("siren: "), n))


def clean_siret(c: Column) -> Column:
    n = clean_number(c)
    fixed = F.when(F.length(n) == 13, F.concat(F.lit("0"), n)).otherwise(n)
    return checked(fixed, (n != "") & ~F.length(n).isin(9, 13, 14), F.concat(F.lit("siret: "), n))


def clean_postcode(c: Column) -> Column:
    n = clean_number(c)
    fixed = F.when(F.length(n) == 4, F.concat(F.lit("0"), n)).otherwise(n)
    return checked(fixed, (nonnull(c) != "") & (F.length(fixed) != 5), F.concat(F.lit("postcode: "), nonnull(c)))


def clean_phone(c: Column, postcode: Column) -> Column:
    n = clean_number(c)
    metropolitan = F.coalesce(F.expr("NULL").cast("int"), postcode.try_cast("int")) < 96000
    n = F.when((F.length(n) == 9) & F.coalesce(metropolitan, F.lit(False)), F.concat(F.lit("0"), n)).otherwise(n)
    n = F.when(F.startswith(n, F.lit("33")), F.concat(F.lit("0"), F.substring(n, 3, 1000))).otherwise(n)
    return checked(n, (n != "") & (F.length(n) < 6), F.concat(F.lit("phone: "), nonnull(c)))


def clean_email(c: Column) -> Column:
    e = strip_lower_string(c)
    return checked(e, (e != "") & ~e.rlike(r"^[^@]+@[^@]+\.[^@]+"), F.concat(F.lit("email: "), e))


URL_PATTERN = r"^https?://([a-zA-Z0-9_-]+\.)+[a-zA-Z]{2,}(/[^\s]*)?$"


def url_is_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(URL_PATTERN), F.lit(False))


def clean_url(c: Column) -> Column:
    u = F.trim(nonnull(c))
    u = F.when((u == "") | u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    return checked(u, (u != "") & ~u.rlike(r"^https?://[^\s/?#]+\.[^\s/?#.]{2,}([/?#][^\s]*)?$"), F.concat(F.lit("url: "), u))


def first_valid_url(*cols: Column) -> Column:
    """The first clean url of several columns; the last failure if none is clean."""
    parts = [clean_url(c) for c in cols]
    value = F.coalesce(*[F.nullif(p["value"], F.lit("")) for p in parts])
    message = F.coalesce(*[p["message"] for p in reversed(parts)])
    return checked(nonnull(value), value.isNull() & message.isNotNull(), message)


def to_boolean(c: Column) -> Column:
    """struct(value boolean, level, message)."""
    w = F.lower(F.trim(c))
    value = F.when(w.isin(*TRUE_WORDS), F.lit(True)).when(w.isin(*FALSE_WORDS), F.lit(False))
    failed = c.isNotNull() & (w != "") & value.isNull()
    return F.struct(value.alias("value"), F.when(failed, F.lit("warning")).alias("level"), F.when(failed, F.concat(F.lit("boolean: "), c)).alias("message"))


def map_label(c: Column, mapping: dict[str, str], level: str = "error", default: str | None = None) -> Column:
    """Looks a label up in its unaccented, trimmed, lower-case form; empty labels take the default if there is one."""
    key = F.lower(F.trim(unaccent(nonnull(c))))
    value = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[key] if mapping else F.lit(None).cast("string")
    if default is not None:
        value = F.when(key == "", F.lit(default)).otherwise(value)
    return checked(value, value.isNull(), F.concat(F.lit("unknown label: "), nonnull(c)), level)


def clean_code_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(nonnull(c), r"\|"), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def _without_cedex(c: Column) -> Column:
    """An address without the words CEDEX and the numbers right after them."""
    ws = F.split(F.trim(nonnull(c)), " ")
    bare = lambda w: F.upper(F.btrim(w, F.lit(",-")))
    is_mark = lambda w: F.rtrim(F.translate(bare(w), "0123456789", " " * 10)) == "CEDEX"
    is_number = lambda w: (bare(w) != "") & (F.translate(bare(w), "0123456789", "") == "")
    kept = F.filter(ws, lambda w, i: ~is_mark(w) & ~((i > 0) & is_number(w) & (bare(F.get(ws, i - 1)) == "CEDEX")))
    return F.trim(F.array_join(kept, " "))


def parse_address(c: Column) -> Column:
    """struct(address, postcode, city) of a one-line address: CEDEX removed, the last 4 or 5 digit number is the postcode."""
    a = _without_cedex(c)
    full, bare = r"^(.*)[\s,\-]+(\d{4,5})[\s,\-]*(.*)$", r"(\d{4,5})[\s,\-]*(.*)$"
    trimmed = lambda x: F.regexp_replace(x, r"^[\s,\-]+|[\s,\-]+$", "")
    whole = a.rlike(full)
    address = F.when(whole, trimmed(F.regexp_extract(a, full, 1))).otherwise("")
    code = F.when(whole, F.regexp_extract(a, full, 2)).otherwise(F.regexp_extract(a, bare, 1))
    city = trimmed(F.when(whole, F.regexp_extract(a, full, 3)).otherwise(F.regexp_extract(a, bare, 2)))
    return F.struct(address.alias("address"), F.when(F.length(code) == 4, F.concat(F.lit("0"), code)).otherwise(code).alias("postcode"), F.initcap(F.replace(city, F.lit("*"), F.lit(""))).alias("city"))


def house_number(c: Column) -> Column:
    """``12 bis`` and ``12bis`` as ``12 b``; null without a leading number."""
    got = F.trim(F.regexp_extract(F.lower(nonnull(c)), r"^\s*(\d+ ?(?:bis|a|b|c)?)\b", 1))
    spaced = F.regexp_replace(got, r"(\d+)([a-z]+)", "$1 $2")
    return F.nullif(F.replace(spaced, F.lit("bis"), F.lit("b")), F.lit(""))


def department_code(c: Column) -> Column:
    t = F.trim(c)
    return F.when(F.length(t) == 5, F.substring(t, 1, 2))


def combine(*cols: Column) -> Column:
    """Trimmed values joined by spaces; null if all are empty."""
    return F.nullif(F.trim(F.concat_ws(" ", *[F.trim(nonnull(c)) for c in cols])), F.lit(""))


def entity_id(source: Column, external: Column, digital: Column | None = None) -> Column:
    """source slug, underscore, external id; ``_d`` after digital ones."""
    slug = F.regexp_replace(F.lower(F.trim(unaccent(source))), r"\s+", "_")
    ext = F.regexp_replace(F.replace(F.trim(external), F.lit("/"), F.lit("-")), r"\s+", "")
    out = F.concat_ws("_", slug, ext)
    return out if digital is None else F.when(digital, F.concat(out, F.lit("_d"))).otherwise(out)


def slug(*cols: Column) -> Column:
    """Parts in lower case with other characters than a-z and 0-9 as hyphens, joined by underscores."""
    part = lambda c: F.regexp_replace(F.regexp_replace(F.lower(unaccent(nonnull(c.cast("string")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("_", *[part(c) for c in cols])


def service_place(c: Column, home_only: str, both: str) -> Column:
    """Where a service takes place, by two patterns over the unaccented upper-case text."""
    t = F.trim(F.upper(unaccent(nonnull(c))))
    return F.when(t.rlike(home_only), "A_DOMICILE").when(t.rlike(both), "SUR_PLACE_OU_A_DOMICILE").otherwise("SUR_PLACE")


# Names of areas without their spaces, and the areas that they stand for.
AREA_NAMES = {
    "FRANCEMETROPOLITAINE": ("FRANCE_METROPOLITAINE",),
    "DROMTOM": ("DROM_TOM",),
    "FRANCEMETROPOLITAINEYCOMPRISDROMTOM": ("DROM_TOM", "FRANCE_METROPOLITAINE"),
}
CORSICA = ("2A", "2B")
KILOMETRES = "KM"


def service_areas(c: Column) -> Column:
    """array<struct<type, value>> of a ``|`` list: kilometres, department, mainland, overseas; sorted, unknown ones dropped.

    Each entry is cut into its leading number and the rest without spaces, and these two tell its class."""
    area = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    named = F.create_map(*[x for name, kinds in AREA_NAMES.items() for x in (F.lit(name), F.array(*[area(k, F.lit("")) for k in kinds]))])

    def one(entry: Column) -> Column:
        t = F.trim(F.upper(unaccent(entry)))
        number = F.regexp_extract(t, "^[0-9]+", 0)
        rest = F.regexp_replace(F.substring(t, F.length(number) + 1, F.length(t)), r"\s", "")
        return (
            F.when((number != "") & F.startswith(rest, F.lit(KILOMETRES)), F.array(area("KILOMETRIQUE", number.try_cast("long").cast("string"))))
            .when((number != "") & (rest == "") & (F.length(number) <= 3), F.array(area("DEPARTEMENTAL", F.lpad(number, F.greatest(F.length(number), F.lit(2)), "0"))))
            .when(t.isin(*CORSICA), F.array(area("DEPARTEMENTAL", t)))
            .when(number == "", named[rest])
        )

    return F.array_sort(F.flatten(F.filter(F.transform(F.split(nonnull(c), r"\|"), one), lambda x: x.isNotNull())))


def repair_url(c: Column) -> Column:
    """Takes a url apart into scheme, host and path, mends each, and puts them together again.

    Scheme: the last of the leading scheme words, or https; what stands before the first one is noise. Host: signs that
    were doubled, and a ``www`` label of two, or of four and more letters, with or without its dot. Path: doubled signs, and a
    last segment that only asks for English."""
    http, dot = F.lit("http"), F.lit(".")
    after = lambda x, part: F.substring(x, F.length(part) + 1, F.length(x))

    def mended_host(host: Column) -> Column:
        single = lambda x, sign: F.array_join(F.filter(F.split(x, f"[{sign}]"), lambda part, i: (part != "") | (i == 0)), sign)
        plain = F.when(F.contains(host, F.lit("..")) | F.contains(host, F.lit("::")), single(single(host, "."), ":")).otherwise(host)
        wrong = lambda ws, rest: ((F.length(ws) == 2) | (F.length(ws) >= 4)) & (rest != "")
        return let(plain, lambda h: let(F.regexp_extract(h, "^w*", 0), lambda ws: let(F.ltrim(after(h, ws), dot), lambda rest: F.when(wrong(ws, rest), F.concat(F.lit("www."), rest)).otherwise(h))))

    def mended_path(path: Column) -> Column:
        def without(doubled: str, sign: str):
            a, b = F.lit(doubled), F.lit(sign)
            return lambda p: F.when(F.contains(p, a), F.replace(F.replace(p, a, b), a, b)).otherwise(p)

        for doubled, sign in (("::", ":"), ("///", "//"), ("..", ".")):
            path = let(path, without(doubled, sign))
        bare = lambda p: F.rtrim(p, F.lit("/"))
        return let(path, lambda p: F.when(F.endswith(bare(p), F.lit("/en")) & ~F.endswith(p, F.lit("//")), F.substring(p, F.lit(1), F.length(bare(p)) - 2)).otherwise(p))

    def joined(u: Column, head: Column) -> Column:
        plain = (head != "") & ~F.endswith(F.rtrim(F.translate(head, ":/", "  ")), F.lit("https"))
        scheme = F.when(plain, F.lit("http://")).otherwise(F.lit("https://"))
        rest = F.ltrim(after(u, head), F.lit("/"))
        return F.concat(scheme, let(rest, lambda r: let(F.regexp_extract(r, "^[^/?#]*", 0), lambda host: F.concat(mended_host(host), mended_path(after(r, host))))))

    quiet = let(F.trim(nonnull(c)), lambda u: F.when(~F.startswith(u, http) & F.contains(u, http), F.concat(http, F.substring_index(u, "http", -1))).otherwise(u))
    return let(quiet, lambda u: let(F.regexp_extract(u, "^(?:https?(?=http|[:/])[:/]*)*", 0), lambda head: joined(u, head)))


def urls_to_try(c: Column) -> Column:
    """Valid candidates of a url, https first; null if there is nothing to try."""
    secure = lambda u: F.when(F.startswith(u, F.lit("http://")), F.concat(F.lit("https"), F.substring(u, 5, 1 << 20)))
    both = let(repair_url(c), lambda u: F.filter(F.array(secure(u), u), lambda x: x.isNotNull() & url_is_valid(x)))
    return F.when((F.trim(nonnull(c)) != "") & F.contains(c, F.lit(".")), both)


def url_domain(c: Column) -> Column:
    """The host of a valid url, without a port."""
    return F.when(url_is_valid(c), F.nullif(F.regexp_extract(c, r"^https?://([^/:]+)", 1), F.lit("")))


def urls_standard_difference(a: Column, b: Column) -> Column:
    """Equal but for case, scheme, www and a trailing slash; false for empty urls."""
    bare = lambda u: F.regexp_replace(F.lower(F.trim(u)), r"^https?://(www\.)?|/$", "")
    return F.coalesce((F.trim(a) != "") & (F.trim(b) != "") & (bare(a) == bare(b)), F.lit(False))


# Words and phrases of names that have a spelling of their own.
NAME_WORDS = {"SA": "SA", "SAS": "SAS", "SARL": "SARL", "ETS": "Éts"}
NAME_PHRASES = {"Boîte À Lire": "Boîte à lire", "D Or": "D'Or"}
VOWELS = "aeiou"


def format_name(c: Column) -> Column:
    """Title case, with legal forms and phrases in their own spelling and words without vowels in capitals."""
    special = F.create_map(*[F.lit(x) for pair in NAME_WORDS.items() for x in pair])
    plain = lambda w: F.when((F.length(w) > 2) & (F.translate(F.lower(w), VOWELS, "") == F.lower(w)), F.upper(w)).otherwise(w)
    out = F.array_join(F.transform(F.split(F.initcap(F.trim(nonnull(c))), " "), lambda w: F.coalesce(special[F.upper(w)], plain(w))), " ")
    for phrase, spelling in NAME_PHRASES.items():
        out = F.replace(out, F.lit(phrase), F.lit(spelling))
    return out


def rename_prefix(c: Column, old: str, new: str) -> Column:
    return F.when(F.startswith(c, F.lit(old)), F.replace(c, F.lit(old), F.lit(new))).otherwise(c)


def append_comment(comments: Column, added: Column) -> Column:
    """JSON list of {message} objects with one more; text that is no list becomes its first element."""
    kind = "array<struct<message:string>>"
    now = F.coalesce(F.from_json(comments, kind), F.when(F.trim(nonnull(comments)) == "", F.array().cast(kind)).otherwise(F.array(F.struct(comments.alias("message")))))
    return F.to_json(F.concat(now, F.array(F.struct(added.alias("message")))))


def zip_code_is_invalid(c: Column) -> Column:
    """Filled values that aren't five digits."""
    return F.coalesce((c != "") & ~c.rlike("^[0-9]{5}$"), F.lit(False))


def digits_of_length(c: Column, n: int) -> Column:
    return F.coalesce((F.length(c) == n) & c.rlike("^[0-9]+$"), F.lit(False))


def register_table_function(spark: SparkSession, name: str, parameters: str, columns: str, query: str) -> None:
    """A parameterised query as a temporary table function: what SQL templates with arguments are for."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {query}")


def register_functions(spark: SparkSession) -> None:
    """The warehouse's four text functions and divmod, as temporary SQL functions."""
    a, b = ACCENTED, UNACCENTED
    plain = f"replace(replace(replace(replace(replace(translate(s, '{a}', '{b}'), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE'), 'ß', 'ss')"
    for name, body in (
        ("pl_cleanup(s STRING) RETURNS STRING", "nullif(nullif(trim(s), ''), '[ND]')"),
        ("pl_normalize_for_match(s STRING, n INT DEFAULT 2) RETURNS STRING", f"nullif(array_join(filter(array_sort(split(regexp_replace(lower({plain}), '[^a-z]+', ' '), ' ')), w -> length(w) >= n), ' '), '')"),
        ("pl_words_in_common(a STRING, b STRING) RETURNS BIGINT", "CAST(size(filter(split(a, ' '), w -> w <> '' AND contains(b, w))) AS BIGINT)"),
        ("pl_concat_unique(v ARRAY<STRING>) RETURNS STRING", "nullif(array_join(array_sort(array_distinct(filter(v, x -> x IS NOT NULL AND x <> ''))), ' '), '')"),
        ("pl_divmod(n BIGINT, d BIGINT) RETURNS STRUCT<quotient: BIGINT, remainder: BIGINT>", "named_struct('quotient', CAST((n - pmod(n, abs(d))) div d AS BIGINT), 'remainder', pmod(n, abs(d)))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} RETURN {body}")

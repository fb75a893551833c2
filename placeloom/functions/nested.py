"""Arrays, maps, JSON and opening hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days in order, and their French names.
DAYS = ("Mo", "Tu", "We", "Th", "Fr", "Sa", "Su")
FRENCH_DAYS = ("lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche")


def same_items(a: Column, b: Column) -> Column:
    """Null-safe equality of arrays, whatever their order."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def as_list(c: Column) -> Column:
    """A scalar as a list of one, null as an empty list."""
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))


def map_codes(codes: Column, mapping: dict[str, list[str]]) -> Column:
    """Each code to its targets, distinct and sorted; unknown codes are left out."""
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    found = F.filter(F.transform(codes, lambda c: table[F.lower(F.trim(c))]), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.flatten(found)))


def codes_of_flags(flags: dict[str, Column]) -> Column:
    """Names of the true flags."""
    return F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]), lambda x: x.isNotNull())


def services(actions: Column, categories: Column) -> Column:
    """array<struct<action, categories>>: every action with all categories, both sorted."""
    cats = F.array_sort(categories)
    return F.transform(F.array_sort(actions), lambda a: F.struct(a.alias("action"), cats.alias("categories")))


def label_codes(c: Column, bonus: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Labels of a ``|`` list, trimmed and lower-case, without ignored ones, ``bonus`` in front where the flag is set."""
    kept = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.lower(F.trim(x))), lambda x: (x != "") & ~x.isin(*ignored) if ignored else x != "")
    return F.when(bonus, F.concat(F.array(F.lit("bonus")), kept)).otherwise(kept)


def join_non_empty(*cols: Column) -> Column:
    return F.concat_ws(" | ", *[F.nullif(c, F.lit("")) for c in cols])


def prefixed(columns: list[str], prefix: str) -> Column:
    """A struct of the columns with a prefix, which is taken off."""
    return F.struct(*[F.col(c).alias(c.removeprefix(prefix)) for c in columns if c.startswith(prefix)])


def as_json(c: Column) -> Column:
    """JSON text that keeps null fields."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def minutes(c: Column) -> Column:
    return F.split(c, ":")[0].cast("int") * 60 + F.split(c, ":")[1].cast("int")


def merge_intervals(intervals: Column) -> Column:
    """Overlapping or touching intervals of array<struct<open, close>> merged, in order."""
    kind = "array<struct<open:int,close:int>>"

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        longer = F.struct(last["open"].alias("open"), F.greatest(last["close"], x["close"]).alias("close"))
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))
        return F.when(last.isNotNull() & (x["open"] <= last["close"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(intervals), F.array().cast(kind), add)


_DAY = f"(?:{'|'.join((*DAYS, 'PH', 'SH'))})"
_SPAN = rf"{_DAY}(?:\s*-\s*{_DAY})?"
_DAY_PART = rf"^{_SPAN}(?:\s*,\s*{_SPAN})*"


def opening_hours(c: Column) -> Column:
    """array<struct<day, intervals>> of OSM hours such as ``Mo-Fr 09:00-12:00, 14:00-18:00; Sa 10:00-12:00; We off``.

    ``24/7`` is every day, whole days; hours without days hold every day; day ranges may go round the week (``Fr-Mo``); the last
    rule that names a day decides it, ``off`` and ``closed`` among them; parts of one rule add up; hours past midnight go on on
    the next day; public and school holidays (``PH``, ``SH``) say nothing about a day of the week. Other forms give no hours.
    Native: rules are split, days expanded by position, and each day's intervals merged.
    """
    text = F.when(F.trim(c) == "24/7", F.lit("00:00-23:59")).otherwise(F.trim(c))
    order = F.array(*[F.lit(d) for d in DAYS])

    def parsed(rule: Column, number: Column) -> Column:
        parts = F.split(F.trim(rule), rf"(?<=[0-9])\s*,\s*(?={_DAY})")
        return F.transform(parts, lambda p: F.struct(number.alias("rule"), F.regexp_replace(F.regexp_extract(p, _DAY_PART, 0), " ", "").alias("days"), F.regexp_replace(F.regexp_replace(p, _DAY_PART, ""), r"\s", "").alias("hours")))

    numbered = F.transform(F.split(text, ";"), lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    parts = F.flatten(F.transform(F.filter(numbered, lambda x: F.trim(x["r"]) != ""), lambda x: parsed(x["r"], x["i"])))

    def covers(part: Column, day: int) -> Column:
        first = lambda s: F.array_position(order, F.split(s, "-")[0])
        last = lambda s: F.array_position(order, F.element_at(F.split(s, "-"), -1))
        at = F.lit(day + 1)
        inside = lambda s: (first(s) > 0) & (last(s) > 0) & F.when(first(s) <= last(s), (first(s) <= at) & (at <= last(s))).otherwise((first(s) <= at) | (at <= last(s)))
        return (part["days"] == "") | F.exists(F.split(part["days"], ","), inside)

    def spans(day: int) -> Column:
        named = F.filter(parts, lambda p: covers(p, day))
        latest = F.array_max(F.transform(named, lambda p: p["rule"]))
        times = F.flatten(F.transform(F.filter(named, lambda p: p["rule"] == latest), lambda p: F.split(p["hours"], ",")))
        good = F.filter(times, lambda s: s.rlike("^[0-9]{1,2}:[0-9]{2}-[0-9]{1,2}:[0-9]{2}$"))
        return F.transform(good, lambda s: F.struct(minutes(F.split(s, "-")[0]).alias("open"), minutes(F.split(s, "-")[1]).alias("close")))

    midnight = 24 * 60
    of = [spans(i) for i in range(7)]

    def day(i: int) -> Column:
        own = F.transform(of[i], lambda s: F.struct(s["open"].alias("open"), F.when(s["close"] <= s["open"], F.lit(midnight)).otherwise(s["close"]).alias("close")))
        over = F.transform(F.filter(of[i - 1], lambda s: (s["close"] <= s["open"]) & (s["close"] > 0)), lambda s: F.struct(F.lit(0).alias("open"), s["close"].alias("close")))
        return F.struct(F.lit(DAYS[i]).alias("day"), merge_intervals(F.concat(own, over)).alias("intervals"))

    return F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.array(*[day(i) for i in range(7)]))


def opening_hours_french(hours: Column) -> Column:
    """One line per day: ``lundi: 09:00 - 12:00; 14:00 - 18:00`` or ``Fermé``."""
    names = F.create_map(*[F.lit(x) for pair in zip(DAYS, FRENCH_DAYS, strict=True) for x in pair])
    clock = lambda m: F.format_string("%02d:%02d", (m / 60).cast("int"), m % 60)
    span = lambda i: F.concat(clock(i["open"]), F.lit(" - "), clock(i["close"]))
    line = lambda d: F.concat(names[d["day"]], F.lit(": "), F.when(F.size(d["intervals"]) == 0, F.lit("Fermé")).otherwise(F.array_join(F.transform(d["intervals"], span), "; ")))
    return F.array_join(F.transform(hours, line), "\n")


def fix_hour_signs(c: Column) -> Column:
    """``09h30`` as ``09:30``."""
    return F.regexp_replace(c, r"(\d{2})h(\d{2})", "$1:$2")

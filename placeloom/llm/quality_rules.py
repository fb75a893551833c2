"""Quality rules with adaptive thresholds (native DataFrame functions only).

Fixed cutoffs are replaced by fences read from quantile sketches, one for each (lang, source) and metric. A sketch is a
log-linear histogram: bucket 16 * e + (v >> e) with e chosen so that v >> e < 32, hence a relative error of at most 1/16.
Histograms merge by adding counts, so they are built by map-side partial aggregation, and the sketches of a language or
of the corpus are sums of the smaller ones. The quartiles of a language are drawn to those of the corpus, and those of a
group to its language's, as if each held ``prior`` documents of the wider one; so small groups have sound fences, and none
changes its rule at some size. A document is rejected if a metric lies beyond its fence, which is
the quartile plus ``reach`` times the larger of the interquartile range and the metric's least spread.

Defined cases: a null or empty text has no words and fails the base rule; null lang or source is a group of its own;
repeated rows give repeated results; an empty table gives an empty result; further columns are ignored, or kept by
``filter_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.llm.common import WHITE, bounded_join, stage, stripped, words

# The base rule.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Metric, least spread, whether there is a lower fence too.
METRICS = (("word_length", 20, True), ("symbol_rate", 50, False), ("dup_line_rate", 50, False), ("repeat_rate", 40, False))
REACH = 6
PRIOR = 100
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_P = "__pl_"


def _repeat_words(windows: str) -> Column:
    """Words covered by windows that occur twice or more: sort the window hashes with their positions, keep those that
    equal a neighbour, and add up the union of [p, p + 8)."""
    return F.expr(f"""
        CASE WHEN size({windows}) = size(array_distinct({windows})) THEN 0L ELSE
          aggregate(
            transform(
              array(sort_array(array_compact(transform(
                array(sort_array(transform({windows}, (h, i) -> struct(h AS h, i AS i)))),
                s -> transform(s, (x, k) -> CASE WHEN x.h = get(s, k - 1).h OR x.h = get(s, k + 1).h THEN x.i END))[0]))),
              p -> aggregate(transform(p, (a, k) -> least({WINDOW}, coalesce(get(p, k + 1) - a, {WINDOW}))), 0L, (t, v) -> t + v)),
            0L, (t, v) -> t + v)
        END""")


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the five counts and n_lines, as columns prefixed ``__pl_``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # Window hashes by doubling: 1, 2, 4 and 8 words. Two windows of one text are taken as equal if their 64-bit hashes are.
    double = "zip_with({0}, slice({0}, {1}, greatest(size({0}) - {2}, 0)), (a, b) -> xxhash64(a, b))"
    return (
        docs.withColumn(f"{_P}w", words(F.col("text")))
        .withColumn(f"{_P}h", F.expr(f"transform({_P}w, w -> xxhash64(w))"))
        .withColumn(f"{_P}h", F.expr(double.format(f"{_P}h", 2, 1)))
        .withColumn(f"{_P}h", F.expr(double.format(f"{_P}h", 3, 2)))
        .withColumn(f"{_P}h", F.expr(double.format(f"{_P}h", 5, 4)))
        .withColumn(f"{_P}h", F.expr(f"slice({_P}h, 1, greatest(size({_P}w) - {WINDOW - 1}, 0))"))
        .withColumn(f"{_P}lines", F.filter(F.split(text, "\n"), lambda x: stripped(x, WHITE) != ""))
        .withColumns(
            {
                f"{_P}n_words": F.size(f"{_P}w").cast("long"),
                f"{_P}word_chars": F.length(stripped(text, WHITE)).cast("long"),
                f"{_P}n_symbols": (F.length(text) - F.length(stripped(text, SYMBOLS))).cast("long"),
                f"{_P}n_lines": F.size(f"{_P}lines").cast("long"),
                f"{_P}n_dup_lines": (F.size(f"{_P}lines") - F.size(F.array_distinct(f"{_P}lines"))).cast("long"),
                f"{_P}n_repeat_words": _repeat_words(f"{_P}h"),
            }
        )
        .drop(f"{_P}w", f"{_P}h", f"{_P}lines")
    )


def with_metrics(counted: DataFrame) -> DataFrame:
    """Adds base_failed and the integer metrics (prefixed) to the result of ``with_counts``."""
    n = lambda c: F.col(f"{_P}{c}")
    rate = lambda a, scale, b: F.expr(f"CAST({scale} * {_P}{a} div greatest({_P}{b}, 1L) AS BIGINT)")
    return counted.withColumns(
        {
            f"{_P}base_failed": (n("n_words") < MIN_WORDS) | (100 * n("n_repeat_words") > MAX_REPEAT_PERCENT * n("n_words")),
            f"{_P}word_length": rate("word_chars", 100, "n_words"),
            f"{_P}symbol_rate": rate("n_symbols", 10_000, "word_chars"),
            f"{_P}dup_line_rate": rate("n_dup_lines", 1_000, "n_lines"),
            f"{_P}repeat_rate": rate("n_repeat_words", 1_000, "n_words"),
        }
    )


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): one mergeable histogram for each group and metric, over documents that pass the base rule."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{_P}{m}").alias("v")) for m, _, _ in METRICS]))
    return (
        measured.filter(~F.col(f"{_P}base_failed"))
        .select("lang", "source", pairs.alias("p"))
        .select("lang", "source", F.col("p.metric").alias("metric"), F.col("p.v").alias("v"))
        .withColumn("e", F.expr("greatest(length(bin(v)) - 5, 0)"))
        .groupBy("lang", "source", "metric", F.expr("16 * e + shiftright(v, e)").cast("int").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _quartiles(hist: DataFrame, keys: list[str]) -> DataFrame:
    w = W.partitionBy(*keys, "metric")
    seen = F.sum("n").over(w.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    least = lambda b: F.expr(f"CASE WHEN {b} < 32 THEN CAST({b} AS BIGINT) ELSE shiftleft(CAST({b} - 16 * ({b} div 16 - 1) AS BIGINT), CAST({b} div 16 - 1 AS INT)) END")
    return (
        hist.groupBy(*keys, "metric", "bucket")
        .agg(F.sum("n").alias("n"))
        .withColumns({"seen": seen, "total": F.sum("n").over(w)})
        .groupBy(*keys, "metric", "total")
        .agg(F.min(F.when(4 * F.col("seen") >= F.col("total"), F.col("bucket"))).alias("b1"), F.min(F.when(4 * F.col("seen") >= 3 * F.col("total"), F.col("bucket"))).alias("b3"))
        .select(*keys, "metric", "total", least("b1").alias("q1"), (least("(b3 + 1)") - 1).alias("q3"))
    )


def fences(hist: DataFrame, prior: int = PRIOR, reach: int = REACH) -> DataFrame:
    """(lang, source, low, high): for each group an array of lower and of upper fences, in the order of METRICS."""
    out = hist.select("lang", "source", "metric").distinct()
    for i, keys in enumerate((["lang", "source"], ["lang"], [])):
        level = _quartiles(hist, keys)
        level = level.select(*[F.col(c).alias(f"l{i}_{c}") for c in level.columns])
        on = F.col("metric") == level[f"l{i}_metric"]
        for k in keys:
            on &= F.col(k).eqNullSafe(level[f"l{i}_{k}"])
        out = out.join(level, on)
    for i in (1, 0):
        out = out.withColumns({f"l{i}_{q}": F.expr(f"(l{i}_total * l{i}_{q} + {prior}L * l{i + 1}_{q}) div (l{i}_total + {prior}L)") for q in ("q1", "q3")})
    spread = F.create_map(*[F.lit(x) for m, s, _ in METRICS for x in (m, s)])
    two_sided = F.col("metric").isin([m for m, _, both in METRICS if both])
    gap = reach * F.greatest(F.col("l0_q3") - F.col("l0_q1"), spread[F.col("metric")].cast("long"))
    out = out.select("lang", "source", "metric", F.when(two_sided, F.col("l0_q1") - gap).otherwise(F.lit(-1).cast("long")).alias("low"), (F.col("l0_q3") + gap).alias("high"))
    bound = lambda c: F.array(*[F.max(F.when(F.col("metric") == m, F.col(c))) for m, _, _ in METRICS])
    return out.groupBy("lang", "source").agg(bound("low").alias(f"{_P}low"), bound("high").alias(f"{_P}high"))


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Joins each row with its group's fences; adds ``__pl_kept``."""
    ok = ~F.col(f"{_P}base_failed")
    for i, (m, _, _) in enumerate(METRICS):
        ok &= F.coalesce(F.col(f"{_P}{m}").between(F.col(f"{_P}low")[i], F.col(f"{_P}high")[i]), F.lit(False))
    return bounded_join(measured, limits, ["lang", "source"], "left").withColumn(f"{_P}kept", ok)


def score_documents(docs: DataFrame, prior: int = PRIOR, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept, lang, source."""
    slim = docs.select("doc_id", "text", "lang", "source")
    measured = stage(with_metrics(with_counts(slim)).drop("text"), "quality")
    limits = stage(fences(sketches(measured), prior, reach), "fences")
    out = judged(measured, limits)
    return out.select("doc_id", *[F.col(f"{_P}{c}").alias(c) for c in COUNTS], F.col(f"{_P}base_failed").alias("base_failed"), F.col(f"{_P}kept").alias("kept"), "lang", "source")


def filter_documents(docs: DataFrame, prior: int = PRIOR, reach: int = REACH) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Rows are staged beside their metrics, so that the
    counts are taken once and no text is exchanged."""
    rows = docs.select(F.struct(*docs.columns).alias(f"{_P}row"), "text", "lang", "source")
    measured = stage(with_metrics(with_counts(rows)).drop("text"), "quality")
    limits = stage(fences(sketches(measured), prior, reach), "fences")
    return judged(measured, limits).filter(f"{_P}kept").select(f"{_P}row.*")

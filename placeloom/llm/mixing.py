"""Mixing sources to target weights (native DataFrame functions only).

Tokens are aggregated per source, targets and repetition rates are derived from the sums, and every document is emitted
floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction. The coin is taken from
md5(doc_id, seed), so that reruns, retries and other engines agree.

Targets are the limit of "share by weight, stop at the cap, share the excess again": with sources sorted by cap / weight,
a prefix is capped and the others get level * weight, which one window over the table of sources finds at once.

Defined cases: null or empty text has size 0; null source is a source of its own, last in order; a source of size 0 has
target 0; repeated rows share one coin; an empty table gives an empty result; further columns are kept by ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.llm.common import bounded_join, stage, words

# Weights in order of source, the share of all tokens, the cap.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = 11


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row per source, so its windows hold few rows."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    ratio = W.orderBy((F.col("__pl_cap") / F.col("__pl_w")).asc(), F.col("__pl_k").asc())
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__pl_k") % len(weights) + 1).cast("int"))
    return (
        totals.withColumn("__pl_k", F.row_number().over(order) - 1)
        .withColumns({"__pl_w": weight, "__pl_cap": F.col("source_size").cast("double") * cap})
        .withColumn("__pl_all", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("__pl_level", (F.col("__pl_all") - F.coalesce(F.sum("__pl_cap").over(before), F.lit(0.0))) / (F.sum("__pl_w").over(every) - F.coalesce(F.sum("__pl_w").over(before), F.lit(0.0))))
        .withColumn("__pl_free", F.col("__pl_level") * F.col("__pl_w") <= F.col("__pl_cap"))
        .withColumn("__pl_at", F.min(F.when(F.col("__pl_free"), F.struct(F.row_number().over(ratio).alias("i"), F.col("__pl_level").alias("level")))).over(every))
        .withColumn("__pl_n", F.row_number().over(ratio))
        .select("source", "source_size", F.when(F.col("__pl_n") >= F.col("__pl_at.i"), F.col("__pl_at.level") * F.col("__pl_w")).otherwise(F.col("__pl_cap")).alias("target"))
    )


def rates(sizes: DataFrame, **how) -> DataFrame:
    """(source, size) rows to the staged table (source, source_size, target, rate)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return stage(targets(totals, **how).withColumn("rate", rate), "rates")


def with_copies(rows: DataFrame, table: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, source, ...) with source_size, target, rate and the number of copies of each row."""
    coin = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    joined = bounded_join(rows, table, ["source"], "left")
    return joined.withColumn("copies", (F.floor("rate") + F.when(coin < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long"))


def mix_report(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sizes = stage(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size")), "sizes")
    return with_copies(sizes, rates(sizes, **how), seed).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The mix itself: every row of ``docs``, with all its columns, as often as it is drawn. Texts aren't shuffled."""
    sizes = docs.select("source", F.size(words(F.col("text"))).cast("long").alias("size"))
    rows = docs.select(F.struct(*docs.columns).alias("__pl_row"), "doc_id", "source")
    drawn = with_copies(rows, rates(sizes, **how).select("source", "rate"), seed)
    return drawn.filter(F.col("copies") > 0).select("__pl_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("__pl_row.*")

"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt into blocks by a hash of their id, repeated rows by their row number too. The matrix of block-to-shard
counts is drawn exactly: each block in turn takes a multivariate hypergeometric sample of what the shards still lack, so
its rows sum to the block sizes and its columns to the shard sizes, which differ by one at most. Blocks stay small, however many there are: the driver draws
the matrix of groups of GROUP blocks, and tasks draw that of the blocks of each group from the group's row, which is the
same law. Each block then permutes its rows by hash and deals consecutive
runs to the shards, and each shard permutes again: rows go to sub-buckets by the leading bits of a second hash, and a
slot is the bucket's offset plus the rank within it. No task holds a shard, only a block or a bucket. ``assign`` exchanges
narrow rows (id, size, checksum) only.

Draws are exact at every size: where numpy's generator ends, the draw is narrowed down first (see ``hypergeometric``).

Defined cases: null or empty text has size 1 and checksum 0; null doc_id is a value of its own; repeated rows get shards
and slots of their own; with fewer rows than shards some shards are empty; an empty table gives an empty result.
Groups of equal texts aren't kept together: the law is a uniform shuffle by rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.llm.common import bounded_join, stage

SHARDS = 8
SEED = 20
BLOCK_ROWS = 50_000
MIN_BLOCKS = 16
GROUP = 4096
#: Populations that numpy draws from; SINGLY: draws that are few enough to be made one by one.
NUMPY_TOTAL = 10**9
SINGLY = 64
ROW = "__pl_row"


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` items, taken without replacement, are among the ``good`` ones.

    Large populations are narrowed down exactly: give every item a uniform place in (0, 1), so that the draw is the lowest
    items. The m-th lowest good one has a Beta place x, and a binomial number of bad ones lies below x. Either all of these are
    drawn, and the rest of the draw is among those above x; or the draw lies below x. What is left is a draw of the same kind."""
    taken, sign = 0, 1
    while good and drawn and bad and good + bad >= NUMPY_TOTAL:
        if 2 * drawn > good + bad:  # count those that are left instead
            taken, sign, drawn = taken + sign * good, -sign, good + bad - drawn
            continue
        if drawn <= SINGLY:
            for _ in range(drawn):
                hit = good > int(rng.integers(good + bad))
                taken, good, bad = taken + sign * hit, good - hit, bad - (not hit)
            return taken
        m = max(1, good * drawn // (good + bad))
        below = int(rng.binomial(bad, rng.beta(m, good - m + 1)))
        if m + below <= drawn:
            taken, good, bad, drawn = taken + sign * m, good - m, bad - below, drawn - m - below
        else:
            good, bad = m - 1, below
    if drawn == 0 or good == 0:
        return taken
    return taken + sign * (drawn if bad == 0 else int(rng.hypergeometric(good, bad, drawn)))


def shard_sizes(n: int, shards: int = SHARDS) -> list[int]:
    return [n // shards + (j < n % shards) for j in range(shards)]


def communication_matrix(blocks: list[int], shards: int | list[int] = SHARDS, seed: int | list[int] = SEED) -> np.ndarray:
    """counts[i, j]: rows of block i that go to shard j; rows sum to ``blocks``, columns to the sizes of the shards, which are
    given or at most one apart."""
    rng, lacks = np.random.default_rng(seed), shard_sizes(sum(blocks), shards) if isinstance(shards, int) else [int(x) for x in shards]
    out = np.zeros((len(blocks), len(lacks)), dtype=np.int64)
    for i, size in enumerate(blocks):
        left, rest = int(size), sum(lacks)
        for j, good in enumerate(lacks):
            rest -= good
            out[i, j] = hypergeometric(rng, good, rest, left)
            left -= int(out[i, j])
        lacks = [a - int(b) for a, b in zip(lacks, out[i], strict=True)]
    return out


def _ends(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """(block, ends): the ranks in a block at which each shard's run ends, drawn group by group."""
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.floor(F.col("block") / GROUP).cast("int"))
    sizes = stage(sizes, "blocks")
    groups = sorted((r["group"], r["n"]) for r in sizes.groupBy("group").agg(F.sum("n").alias("n")).collect())  # one row for GROUP * BLOCK_ROWS rows
    parts = communication_matrix([c for _, c in groups], shards, seed)
    lacks = rows.sparkSession.createDataFrame([(g, [int(x) for x in p]) for (g, _), p in zip(groups, parts, strict=True)], "group int, lacks array<bigint>")

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        ends = np.cumsum(communication_matrix(pdf["n"].tolist(), list(pdf["lacks"].iloc[0]), [seed, int(pdf["group"].iloc[0])]), axis=1)
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "ends": ends.tolist()})

    return stage(sizes.join(lacks, "group").groupBy("group").applyInPandas(draw, "block bigint, ends array<bigint>"), "ends")


def _narrow() -> list:
    text = F.coalesce(F.col("text"), F.lit(""))
    return ["doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")]


def _placed(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """Staged rows (ROW, doc_id, size, text_crc32) with shard and slot."""
    n = rows.count()
    blocks = max(MIN_BLOCKS, -(-n // BLOCK_ROWS))
    rows = rows.withColumn("r", F.xxhash64("doc_id", "text_crc32", F.lit(seed)))
    again = rows.groupBy("r").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("r", F.lit(True).alias("again"))
    rows = rows.join(again, "r", "left").withColumn("r", F.when(F.col("again"), F.xxhash64("r", ROW)).otherwise(F.col("r"))).drop("again")
    rows = stage(rows.withColumn("block", F.pmod("r", F.lit(blocks)).cast("long")), "rows")
    order = ("doc_id", "text_crc32", "size", ROW)
    rank = F.row_number().over(W.partitionBy("block").orderBy("r", *order))
    dealt = (
        bounded_join(rows.withColumn("rank", rank.cast("long")), _ends(rows, shards, seed), ["block"])
        .withColumn("shard", F.expr("size(filter(ends, e -> e < rank))").cast("int"))
        .withColumn("r2", F.xxhash64("r", "rank", F.lit(seed + 1)))
    )
    bits = max(1, math.ceil(math.log2(max(2, blocks / shards * 2))))
    dealt = stage(dealt.withColumn("bucket", F.shiftrightunsigned("r2", 64 - bits).cast("long")).select(*order, "shard", "bucket", "r2"), "dealt")
    counts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = stage(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("r2", *order))
    return bounded_join(dealt.withColumn("within", within), offsets, ["shard", "bucket"]).select(ROW, "doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("within") - 1).cast("long").alias("slot"))


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot."""
    rows = stage(docs.select(*_narrow(), F.monotonically_increasing_id().alias(ROW)), "narrow")
    return _placed(rows, shards, seed).drop(ROW)


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with columns shard and slot (they replace columns of these names). Rows are staged with their number, by which
    they meet their places, so each text is exchanged once and repeated rows don't meet."""
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    rows = stage(docs.select(F.struct(*names).alias("__pl_doc"), F.monotonically_increasing_id().alias(ROW)), "documents")
    places = _placed(rows.select(ROW, "__pl_doc.doc_id", "__pl_doc.text").select(ROW, *_narrow()), shards, seed)
    return rows.join(places.select(ROW, "shard", "slot"), ROW).select("__pl_doc.*", "shard", "slot")

"""Line dedup by a log-template tree (native DataFrame functions only).

Lines are parsed at fixed depth: the tree branches by token count and by the leading tokens, and tokens with a digit or an
at sign are variable fields from the start. A token's support is the number of (document, line) pairs of its leaf that
have it at its position. The support of a line's group is that of the rarest token among the most frequent ``similarity``
of its tokens: so many lines agree with it that far. A token is constant if it has at least ``share`` of the group's
support and ``min_docs``, and a variable field otherwise, so that fields whose values recur stay fields in a large corpus,
and a rare template keeps its constants beside a frequent one in the same leaf. The template of a line keeps its constants, if
they make up at least ``similarity`` of it, and else is the line itself. That is the fixed-depth parser with its leaf
merging stated without an order of arrival, so that it is a composition of aggregations. Templates that recur in at least
``min_docs`` documents are dropped from all documents but the first (smallest doc_id) that has them.

Texts are masked once: the masked lines of every document, their keys and the hash of each raw line are written to a
staged table, from which supports, templates and the lines to drop are read. Lines with fewer than ``min_tokens`` tokens,
blank ones among them, are never dropped. Mostly hashes move, and the texts of distinct lines in leaves that need merging;
each document is exchanged once, with the hashes of the raw lines that it loses.

Defined cases: null text stays null and has no lines; an empty text has one blank line; a line counts once for a document
however often it stands in it; repeated rows with the same doc_id are one document; rows without a doc_id count as one
document together, last in order, and keep all their lines; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import stage

DEPTH = 3
MIN_DOCS = 3
MIN_TOKENS = 3
SIMILARITY = 0.7
SHARE = 0.5
FIELD = "<*>"
FILTER_BITS = 24


def masked_line(line: Column) -> Column:
    """A line's tokens joined by one space, those with a digit or an at sign replaced. Regular expressions run only where they find something."""
    gaps = F.contains(line, F.lit("  "))
    for c in "\t\x0b\x0c\r":
        gaps |= F.contains(line, F.lit(c))
    flat = F.trim(F.when(gaps, F.regexp_replace(line, "[ \t\x0b\x0c\r]+", " ")).otherwise(line))
    return F.when(line.rlike("[0-9@]"), F.regexp_replace(flat, "(?<![^ ])[^ 0-9@]*+[0-9@][^ ]*+", FIELD)).otherwise(flat)


def _tokens(line: Column) -> Column:
    """How many tokens a masked line has; a blank line has one empty token."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _keys(line: Column, prefix: str = "k") -> list[Column]:
    """128 bits of a masked line."""
    return [F.xxhash64(line).alias(f"{prefix}1"), F.xxhash64(line, F.lit(1)).alias(f"{prefix}2")]


def _leaf(line: Column, depth: int) -> Column:
    return F.xxhash64(_tokens(line), F.substring_index(line, " ", depth))


def document_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, depth: int = DEPTH) -> DataFrame:
    """(doc_id, raw, line, k1, k2, leaf): for each distinct raw line of a row its hash, and its masked line with key and leaf.

    The generator keeps the masking from being repeated for every column that is derived from it."""
    both = F.transform(F.array_distinct(F.split("text", "\n")), lambda x: F.struct(F.xxhash64(x).alias("raw"), masked_line(x).alias("line")))
    lines = docs.select("doc_id", F.explode(both).alias("x")).select("doc_id", "x.raw", "x.line").filter(_tokens(F.col("line")) >= min_tokens)
    return lines.select("doc_id", "raw", "line", *_keys(F.col("line")), _leaf(F.col("line"), depth).alias("leaf"))


def _position(leaf: Column) -> Column:
    return F.pmod(F.xxhash64(leaf, F.lit(7)), F.lit(1 << FILTER_BITS))


def _lines_of(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, line, k1, k2): the distinct masked lines that fall into the given leaves.

    A bitmap of FILTER_BITS bits, so of a fixed size, keeps most other lines from being exchanged; the join is exact."""
    bits = leaves.select(_position(F.col("leaf")).alias("p")).groupBy(F.shiftright("p", 15).alias("__pl_b")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("__pl_bits"))
    lines = lines.select("leaf", "line", "k1", "k2").withColumn("__pl_p", _position(F.col("leaf"))).withColumns({"__pl_b": F.shiftright("__pl_p", 15), "__pl_i": F.col("__pl_p").bitwiseAND(32767).cast("int")})
    near = lines.join(F.broadcast(bits), "__pl_b").filter(F.expr("shiftright(CAST(conv(hex(substring(__pl_bits, __pl_i div 8 + 1, 1)), 16, 10) AS INT), __pl_i % 8) & 1 = 1"))
    return near.select("leaf", "line", "k1", "k2").distinct().join(leaves, "leaf", "left_semi")


def recurring(lines: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, share: float = SHARE) -> DataFrame:
    """(k1, k2, first_doc) of the masked lines whose template recurs, from the staged result of ``document_lines``."""
    pairs = lines.select("doc_id", "k1", "k2", "leaf").distinct()  # lines may be masked alike, and rows may share their doc_id
    distinct = stage(pairs.groupBy("k1", "k2", "leaf").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")), "lines")
    leaves = distinct.groupBy("leaf").agg(F.sum("n").alias("support"), F.count(F.lit(1)).alias("kinds")).filter((F.col("support") >= min_docs) & (F.col("kinds") > 1)).select("leaf")
    leaves = stage(leaves, "leaves")
    shared = stage(_lines_of(lines, leaves).join(distinct.select("k1", "k2", "n"), ["k1", "k2"]), "shared").select("leaf", "k1", "k2", "n", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    supports = shared.groupBy("leaf", "pos", "token").agg(F.sum("n").alias("support")).filter((F.col("support") >= min_docs) & (F.col("token") != FIELD))
    # Those with enough frequent tokens: the group's support is min_docs at least, and so many tokens are constant.
    grouped = (
        shared.join(supports, ["leaf", "pos", "token"], "left")
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "token", F.coalesce("support", F.lit(0)).alias("support")))).alias("t"), F.count("support").alias("c"))
        .filter(F.col("c") >= similarity * F.size("t"))
    )
    group = F.get(F.sort_array("t.support", asc=False), F.ceil(similarity * F.size("t")).cast("int") - 1)
    token = lambda x: F.when(x["support"] >= F.col("least"), x["token"]).otherwise(FIELD)
    general = F.array_join(F.transform("t", token), " ")
    parsed = grouped.withColumn("least", F.greatest(F.lit(min_docs), share * group)).select("k1", "k2", *_keys(general, "g"))
    templated = distinct.join(parsed, ["k1", "k2"], "left").select("k1", "k2", "n", "first_doc", F.coalesce("g1", "k1").alias("t1"), F.coalesce("g2", "k2").alias("t2"))
    templated = stage(templated, "templates")
    sums = templated.groupBy("t1", "t2").agg(F.sum("n").alias("pairs"), F.max("n").alias("docs"), F.min("first_doc").alias("first")).filter(F.col("pairs") >= min_docs)
    sums = stage(sums, "sums")
    # A line in min_docs documents settles its template; else, each line is in few documents, and these are counted.
    unsure = templated.join(sums.filter(F.col("docs") < min_docs).select("t1", "t2"), ["t1", "t2"]).select("k1", "k2", "t1", "t2")
    counted = lines.select("doc_id", "k1", "k2").join(unsure, ["k1", "k2"]).select("t1", "t2", "doc_id").distinct().groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("docs"))
    few = counted.filter(F.col("docs") < min_docs)
    often = sums.join(few, ["t1", "t2"], "left_anti")
    return templated.join(often.select("t1", "t2", "first"), ["t1", "t2"]).select("k1", "k2", F.col("first").alias("first_doc"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, similarity: float = SIMILARITY, min_tokens: int = MIN_TOKENS, share: float = SHARE) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without its dropped lines, n_lines, n_dropped."""
    slim = docs.select("doc_id", "text")
    lines = stage(document_lines(slim, min_tokens, depth), "masked")
    drops = recurring(lines, min_docs, similarity, share)
    hits = (
        lines.filter("doc_id IS NOT NULL")
        .select("doc_id", "raw", "k1", "k2")
        .join(drops, ["k1", "k2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("first_doc")))
        .groupBy(F.col("doc_id").alias("__pl_doc"))
        .agg(F.collect_set("raw").alias("__pl_keys"))
    )
    own = F.split("text", "\n")
    left = F.filter(own, lambda x: ~F.array_contains(F.col("__pl_keys"), F.xxhash64(x)))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(own))
    return (
        slim.join(hits, F.col("doc_id") == F.col("__pl_doc"), "left")
        .withColumn("__pl_kept", F.when(F.col("__pl_keys").isNull(), own).otherwise(left))
        .select("doc_id", F.array_join("__pl_kept", "\n").alias("text"), n_lines.cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(n_lines - F.size("__pl_kept")).cast("long").alias("n_dropped"))
    )

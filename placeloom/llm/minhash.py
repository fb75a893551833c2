"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A sketch has BINS coordinates. In round i every shingle is placed in the bin that its i-th hash names, and a bin keeps
the least (round, hash). Rounds go on until every bin is filled; after BINS rounds, round BINS + b places everything in
bin b, so every coordinate is filled and the share of equal coordinates concentrates like that of a full MinHash, at the
cost of one pass for texts with many shingles.

Plan:
1. One pass over the texts gives (doc_id, set size, digest of the word sequence, sketch, band keys). Equal sequences are
   one text, which its least doc_id stands for from here on. Joins on a digest or a band key are salted, as a third of all
   rows may share one.
2. Representatives that share a band key form a bucket. Every member is compared with the bucket's centre, the member
   that shares most buckets with others: a linear number of pairs, and a group of edited copies meets its original there.
3. Links are confirmed on full shingle sets. The sets of a centre's members are streamed past the centre's own set in
   salted runs, so that no task holds a group.
4. Buckets whose members are still in different components are settled exactly: blocks of members are compared by sketch
   within a bound that no pair over the threshold misses, and what is alike is compared on full sets, in blocks of bounded
   size that report a forest of links and not all pairs.
5. Components of the confirmed links.

With 32 bands of 4 coordinates a pair at the threshold is missed with probability 6e-11.

Defined cases: null or empty text and text without words have an empty set and stay alone; a text with fewer than five
words is one shingle, its whole sequence; rows with one doc_id are one document, which is linked by each of its texts, and
have one result each, with the size of their own set; null doc_id stays alone; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import SALT, salted, spread, stage
from placeloom.operators.graph import connected_components

# Shingle length and the threshold of the contract, 100 * intersection >= 85 * union.
SHINGLE = 5
NUM, DEN = 85, 100

BITS = 7
BINS = 1 << BITS
ROWS = 4
BANDS = BINS // ROWS
#: Coordinates that a pair at the threshold agrees on at least: mean 108.8, standard deviation 4.04, less 5.6 deviations.
ALIKE = 86
RUN = 256
BLOCK = 512
BLOCK_SHINGLES = 400_000

_U = np.uint64
_LOW = _U((1 << (64 - BITS - 8)) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_list(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: bytes methods know exactly the white space and the letters of the rule."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sequence(ws: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """64-bit shingle hashes in the order of the text."""
    n = len(ws)
    if not n:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), _U, n)
    size = min(n, k)
    acc = mix(h[: n - size + 1] + _U(size))
    for j in range(1, size):
        acc = mix(acc * _U(0x9E3779B97F4A7C15) + h[j : n - size + 1 + j])
    return acc


def shingles(ws: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    return np.unique(shingle_sequence(ws, k))


def sketch(items: np.ndarray) -> np.ndarray:
    """BINS coordinates of a non-empty set; two sets agree on a coordinate with probability equal to their Jaccard similarity."""
    out = np.zeros(BINS, _U)
    full = np.zeros(BINS, bool)
    n, i = len(items), 0
    while i < BINS and not full.all():
        rounds = min(BINS - i, max(1, int(BINS * 6 / n)))
        seeds = mix(np.arange(i + 1, i + rounds + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
        key = mix(items[None, :] ^ seeds[:, None])
        bins = key >> _U(64 - BITS)
        packed = (bins << _U(64 - BITS)) | (np.arange(i, i + rounds, dtype=_U)[:, None] << _U(64 - BITS - 8)) | (key & _LOW)
        packed = np.sort(packed, axis=None)
        b = (packed >> _U(64 - BITS)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        b, v = b[first], packed[first]
        new = ~full[b]
        out[b[new]], full[b[new]] = v[new], True
        i += rounds
    for b in np.flatnonzero(~full):
        seed = mix(np.array([BINS + b + 1], _U) * _U(0x9E3779B97F4A7C15))
        out[b] = (_U(b) << _U(64 - BITS)) | (_U(BINS + b) << _U(64 - BITS - 8)) | (mix(items ^ seed) & _LOW).min()
    return mix(out)


def digest(ws: list[bytes]) -> bytes:
    """128 bits of a word sequence: what tells texts apart."""
    return xxhash.xxh3_128_digest(b" ".join(ws))


def band_keys(sk: np.ndarray) -> np.ndarray:
    m = sk.reshape(BANDS, ROWS)
    acc = mix(np.arange(1, BANDS + 1, dtype=_U))
    for j in range(ROWS):
        acc = mix(acc * _U(0x9E3779B97F4A7C15) + m[:, j])
    return acc.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The contract's test on two sets of sorted hashes."""
    if not len(a) or not len(b) or DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, sigs, bands = [], [], [], []
        for text in batch.column("text"):
            ws = word_list(text.as_py())
            items = shingles(ws)
            sizes.append(len(items))
            if len(items):
                sk = sketch(items)
                digests.append(digest(ws))
                sigs.append((sk & _U(0xFFFF)).astype(np.uint16).tobytes())
                bands.append(band_keys(sk))
            else:
                digests.append(None)
                sigs.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "sig", "bands"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (centre, its digest, salt, role): a run starts with its centre (role 0), and each later row is compared with that."""
    at, centre = None, np.empty(0, _U)
    for batch in batches:
        us, vs = [], []
        for row in _rows(batch):
            ws = word_list(row["text"])
            if digest(ws) != row["digest"]:  # another text of that doc_id
                continue
            items, key = shingles(ws), (row["centre"], row["head"])
            if row["role"] == 0:
                at, centre = key, items
            elif key == at and linked(centre, items):
                us.append(row["id"])
                vs.append(row["centre"])
        yield pa.RecordBatch.from_arrays([pa.array(us, batch.schema.field("id").type), pa.array(vs, batch.schema.field("id").type)], ["u", "v"])


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, a few texts at a time as Python objects."""
    for at in range(0, batch.num_rows, 64):
        yield from batch.slice(at, 64).to_pylist()


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, of bounded size by construction; texts are replaced by their shingle sets at once."""
    held, at = [], None
    for batch in batches:
        for row in _rows(batch):
            if "text" in row:
                ws = word_list(row.pop("text"))
                if digest(ws) != row["digest"]:
                    continue
                row["items"] = shingles(ws)
            key = tuple(row[k] for k in keys)
            if key != at and held:
                yield held
                held = []
            at = key
            held.append(row)
    if held:
        yield held


def components(links: DataFrame) -> DataFrame:
    """(u, v) links to (node, component): the least node reachable."""
    return connected_components(links, "u", "v")


class _Forest:
    def __init__(self, labels: list) -> None:
        self.up = {x: x for x in labels}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def _alike(sig: np.ndarray, comp: np.ndarray, side: np.ndarray, cross: bool) -> Iterator[tuple[int, int]]:
    """Pairs of different components whose sketches agree on ALIKE coordinates, the most alike first."""
    found = []
    for i in range(len(sig)):
        rest = slice(i + 1, len(sig))
        ok = comp[rest] != comp[i]
        if cross:
            ok &= side[rest] != side[i]
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            agree = (sig[j] == sig[i]).sum(axis=1)
            found += [(-int(a), i, int(x)) for a, x in zip(agree[agree >= ALIKE], j[agree >= ALIKE], strict=True)]
    for _, i, j in sorted(found):
        yield i, j


def _block_links(exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ("key", "b1", "b2")):
            ids, cross = [r["id"] for r in rows], rows[0]["b1"] != rows[0]["b2"]
            _, comp = np.unique(np.array([str(r["comp"]) for r in rows]), return_inverse=True)
            side = np.array([r["b"] for r in rows])
            if exact:
                sets = [r["items"] for r in rows]
                sig = np.stack([(sketch(s) & _U(0xFFFF)).astype(np.uint16) for s in sets])
            else:
                sig = np.stack([np.frombuffer(r["sig"], np.uint16) for r in rows])
            forest = _Forest(sorted(set(comp.tolist()))) if exact else _Forest(list(range(len(rows))))
            us, vs = [], []
            for i, j in _alike(sig, comp, side, cross):
                a, b = (int(comp[i]), int(comp[j])) if exact else (i, j)
                if forest.find(a) != forest.find(b) and (not exact or linked(sets[i], sets[j])):
                    forest.join(a, b)
                    us.append(ids[i])
                    vs.append(ids[j])
            if us:
                kind = pa.array(ids).type
                yield pa.RecordBatch.from_arrays([pa.array(us, kind), pa.array(vs, kind)], ["u", "v"])

    return run


def _blocked(rows: DataFrame, weight: str) -> DataFrame:
    """Deals the rows of each key into blocks and repeats each row for every pair of blocks that has its own."""
    total = rows.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(weight) / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    return (
        rows.join(total, "key")
        .withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"b1": F.least("b", "o"), "b2": F.greatest("b", "o")})
    )


def _with_text(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Joins ids with their texts, of which Python keeps the one with the row's digest. A merge join, as neither side has a size bound."""
    return rows.join(docs.select(F.col("doc_id").alias("id"), "text").hint("merge"), "id")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links of (id, digest, centre, head) pairs, ``head`` being the centre's digest."""
    runs = pairs.groupBy("centre", "head").agg((F.floor(F.count(F.lit(1)) / RUN) + 1).cast("int").alias("runs"))
    dealt = salted(pairs, "digest")
    members = dealt.join(spread(dealt, runs, "centre", "head"), ["centre", "head", SALT]).select("id", "digest", "centre", "head", F.pmod(F.xxhash64("id", "digest"), F.col("runs")).cast("int").alias("salt"), F.lit(1).alias("role"))
    heads = runs.select(F.col("centre").alias("id"), F.col("head").alias("digest"), "centre", "head", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("salt"), F.lit(0).alias("role"))
    rows = _with_text(members.unionByName(heads), docs).repartition("centre", "head", "salt").sortWithinPartitions("centre", "head", "salt", "role")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stage(rows.select("id", "digest", "centre", "head", "role", "text").mapInArrow(_stars, f"u {kind}, v {kind}"), "links")


def classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    links_schema = f"u {kind}, v {kind}"
    docs = docs.select("doc_id", "text")
    sketched = docs.mapInArrow(_signatures, f"doc_id {kind}, n bigint, digest binary, sig binary, bands array<bigint>")
    sketched = stage(sketched.withColumn("row", F.monotonically_increasing_id()), "sketches")

    known = sketched.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    texts = salted(known.select("row", "doc_id", "digest"), "row")
    copies = texts.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("digest", "rep")
    copied = stage(texts.join(spread(texts, copies, "digest"), ["digest", SALT]), "copies")
    first_rows = copied.filter("doc_id = rep").groupBy("digest").agg(F.min("row").alias("row"))
    reps = known.join(copied.select("row").join(first_rows, "row", "left_anti"), "row", "left_anti")

    banded = salted(reps.select(F.col("doc_id").alias("id"), "digest", F.explode("bands").alias("key")), "digest")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    buckets = stage(banded.join(spread(banded, shared, "key"), ["key", SALT]), "buckets")
    fame = buckets.groupBy("id", "digest").agg(F.sum("c").alias("fame"))
    centres = buckets.join(fame, ["id", "digest"]).groupBy("key").agg(F.max(F.struct("fame", "id", "digest")).alias("top")).select("key", F.col("top.id").alias("centre"), F.col("top.digest").alias("head"))
    pairs = buckets.join(spread(buckets, centres, "key"), ["key", SALT]).filter("id <> centre").select("id", "digest", "centre", "head").distinct()
    links = _verified(stage(pairs, "pairs"), docs)
    # The texts of a document are one node; those that others stand for are tied to it.
    several = known.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("lo"), F.max(F.xxhash64("digest")).alias("hi")).filter("lo <> hi").select("doc_id")
    ties = copied.filter("doc_id <> rep").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct()
    links = stage(links.unionByName(ties), "ties")

    # Buckets that still hold more than one component.
    first = components(links)
    labelled = buckets.select("key", "id", "digest").join(first.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    labelled = salted(stage(labelled, "labelled"), "digest")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    open_rows = labelled.join(spread(labelled, mixed, "key"), ["key", SALT]).drop(SALT)
    open_rows = stage(open_rows.join(reps.select(F.col("doc_id").alias("id"), "digest", "n", "sig"), ["id", "digest"]).withColumn("w", F.lit(0)), "open")
    final = first
    if not open_rows.isEmpty():
        blocked = _blocked(open_rows, "w").repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
        alike = stage(blocked.select("key", "b1", "b2", "b", "id", "comp", "sig").mapInArrow(_block_links(False), links_schema), "alike")
        if not alike.isEmpty():
            groups = components(alike).select(F.col("node").alias("id"), F.col("component").alias("key"))
            open_docs = stage(groups.join(open_rows.select("id", "digest", "comp", "n").distinct(), "id"), "groups")
            settled = _with_text(_blocked(open_docs, "n"), docs).repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
            late = stage(settled.select("key", "b1", "b2", "b", "id", "digest", "comp", "text").mapInArrow(_block_links(True), links_schema), "late")
            if not late.isEmpty():
                final = components(links.unionByName(late))

    stood = salted(copied.select("doc_id", "rep"), "doc_id")
    joined = stood.join(spread(stood, final.withColumnRenamed("node", "rep"), "rep"), ["rep", SALT], "left").select("doc_id", F.coalesce("component", "rep").alias("component")).filter("doc_id <> component")
    linked_reps = final.join(copied.select("doc_id"), F.col("node") == F.col("doc_id"), "left_anti").select(F.col("node").alias("doc_id"), "component").filter("doc_id <> component")
    moved = joined.unionByName(linked_reps).distinct()
    out = sketched.select("doc_id", F.col("n").alias("n_shingles")).join(moved, "doc_id", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its component, with all their columns."""
    out = stage(classes(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__pl_doc")).distinct(), "duplicates")
    return docs.hint("merge").join(out, F.col("doc_id") == F.col("__pl_doc"), "left_anti")  # a merge join, as the ids have no size bound

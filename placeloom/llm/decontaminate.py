"""Benchmark decontamination by size-partitioned MinHash containment search with exact verification.

A short test item inside a long document has almost no Jaccard similarity with it, so sizes are partitioned on both
sides. An item of q shingles belongs to size class k = ceil(log2 q); for that class a document is a sequence of
overlapping windows of two blocks of 2^k shingles, so that an item's similarity with a window that holds it doesn't
depend on the document's length. Signatures are one-permutation MinHashes of BINS bins, whatever the size of the item: the
least key of each bin that an item fills. An item is a candidate for a document if one coordinate collides, that is if a
window's least key in some bin is the item's. Because the key of a bin names its bin, the search looks every document key
up in one table of the items' coordinates and checks the window's minimum only for the few that are found.

Candidates are verified by exact containment over whole texts: shared shingles of the item / shingles of the item >= 0.8.
An item of ten shingles of which eight are there fills about ten bins, and each is kept and least in its window with a
probability of 0.7, so it is missed with 10^-5; one of a thousand shingles fills all 128, which collide with 0.36 each.

Items are searched in blocks of at most BLOCK_ITEMS items and about BLOCK_BYTES of text, so what is broadcast has a fixed
bound, and is let go before the next block is sent; further blocks cost further passes over the documents. Items are dealt
into blocks by their row, so repeated ones don't meet in one.

Defined cases: null or empty texts have no shingles and match nothing; an item with fewer than five words is one shingle,
its whole sequence, which only a document of just these words holds; repeated items and rows give repeated matches; empty
tables give empty results; ``remove_contaminated`` keeps every column of the documents, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from placeloom.llm.common import stage
from placeloom.llm.minhash import mix, shingle_sequence, word_list

# The threshold, as a fraction.
NUM, DEN = 4, 5
BITS = 7
SEED = np.uint64(0x5851F42D4C957F2D)
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 8_000_000
FILTER_BITS = 22

_U = np.uint64


class ItemIndex:
    """Signatures and shingle sets of a bounded block of items."""

    def __init__(self, items: list[tuple]) -> None:
        self.ids, self.sets, self.levels = [], [], []
        keys, owners = [], []
        for item_id, text in items:
            own = np.unique(shingle_sequence(word_list(text)))
            if not len(own):
                continue
            level = int(len(own) - 1).bit_length()
            k = np.sort(mix(own ^ SEED))
            bins = k >> _U(64 - BITS)
            least = k[np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])]
            keys.append(least)
            owners.append(np.full(len(least), len(self.ids), np.int64))
            self.ids.append(item_id)
            self.sets.append(own)
            self.levels.append(level)
        all_keys = np.concatenate(keys) if keys else np.empty(0, _U)
        all_owners = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.argsort(all_keys, kind="stable")
        self.owners = all_owners[order]
        self.keys, self.starts = np.unique(all_keys[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(self.owners)]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> _U(64 - FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, keys: np.ndarray) -> set[int]:
        """Items of which a coordinate collides with that of a window of the document's key sequence."""
        near = np.flatnonzero(self.filter[(keys >> _U(64 - FILTER_BITS)).astype(np.int64)])
        if not len(near) or not len(self.keys):
            return set()
        at = np.minimum(np.searchsorted(self.keys, keys[near]), len(self.keys) - 1)
        hit = self.keys[at] == keys[near]
        out: set[int] = set()
        for pos, i in zip(near[hit].tolist(), at[hit].tolist(), strict=True):
            for owner in self.owners[self.starts[i] : self.ends[i]].tolist():
                if owner not in out and self._collides(keys, pos, self.levels[owner]):
                    out.add(owner)
        return out

    @staticmethod
    def _collides(keys: np.ndarray, pos: int, level: int) -> bool:
        key, shift = keys[pos], _U(64 - BITS)
        for first in ((pos >> level) - 1, pos >> level):
            window = keys[max(0, first) << level : (first + 2) << level]
            if not ((window < key) & (window >> shift == key >> shift)).any():
                return True
        return False

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that the text contains."""
        sequence = shingle_sequence(word_list(text))
        if not len(sequence):
            return []
        found = self.candidates(mix(sequence ^ SEED))
        if not found:
            return []
        own = np.unique(sequence)
        out = []
        for i in sorted(found):
            shared = int(np.isin(self.sets[i], own, assume_unique=True).sum())
            if DEN * shared >= NUM * len(self.sets[i]):
                out.append((i, shared))
        return out


def _blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark's items in blocks of bounded size."""
    items = stage(benchmark.select("item_id", "text").withColumn("row", F.monotonically_increasing_id()), "items")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    return [items.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b) for b in range(blocks)]


def _index(block: DataFrame):
    """The broadcast index of one block."""
    rows = sorted(((r["item_id"], r["text"]) for r in block.select("item_id", "text").collect()), key=str)  # bounded by the block size
    return block.sparkSession.sparkContext.broadcast(ItemIndex(rows))


def _searched(docs: DataFrame, blocks: list[DataFrame], search, schema, tag: str):
    """The result of ``search`` for each block. All but the last are staged, after which their index is let go."""
    for k, block in enumerate(blocks):
        index = _index(block)
        found = docs(k).mapInArrow(search(index), schema)
        if k + 1 < len(blocks):
            found = stage(found, tag)
            index.unpersist(blocking=False)
        yield found


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles) of every item that a document contains."""
    fields = [docs.select("doc_id").schema[0], benchmark.select("item_id").schema[0]]
    schema = StructType([*fields, StructField("item_shingles", LongType()), StructField("shared_shingles", LongType())])
    slim = docs.select("doc_id", "text")

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index, kinds = shared.value, to_arrow_schema(schema)
            for batch in batches:
                rows = [(id_.as_py(), index.ids[i], len(index.sets[i]), n) for id_, text in zip(batch.column("doc_id"), batch.column("text"), strict=True) for i, n in index.matches(text.as_py())]
                columns = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

        return run

    out = None
    for part in _searched(lambda _: slim, _blocks(benchmark), search, schema, "matches"):
        out = part if out is None else out.unionAll(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns. Nothing is exchanged."""

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.matches(t.as_py()) for t in batch.column("text")], pa.bool_()))

        return run

    left = [docs]
    for part in _searched(lambda k: left[k], _blocks(benchmark), search, docs.schema, "clean"):
        left.append(part)
    return left[-1]

"""Secret scans with corpus-wide ownership frequency.

One pass over the texts finds the base spans and further candidates: long mixed tokens, and values after other key words.
The hashes of all candidates are aggregated over the corpus by distinct repositories and owners. A value that many owners
or many repositories hold is a copied example; a value of a few of both that looks random is taken as live. Candidates of the method are
added as spans of kind ``live`` only if they are owner-specific and overlap no base span; base spans always stay.

Counting is distinct pairs, dealt out by pair, and then partial aggregations, so a value that a third of the corpus holds
gathers in no task. Only hashes of values travel, never the values.

Defined cases: null text is empty; null repository or owner counts as one of its own; repeated rows repeat their spans
but add no owners and, where documents are the repositories, no repositories; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import stage

# The base patterns, their least lengths, and the words that must stand in a text for ``assign`` to match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
CUES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "live")

#: Further candidates: long tokens that mix letters and digits, upper-case hex among them, and shorter ones that follow a word for authorisation.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LEAST_ENTROPY = 3.2
KEYWORD = re.compile(r"""(?<![A-Za-z])(?:pwd|bearer|auth|authorization|private_?key)(?:["']?\x20*[:=]\x20*["']?|\x20+["']?)([A-Za-z0-9+/_.=-]{7,}[A-Za-z0-9+/_=-])""", re.ASCII | re.IGNORECASE)
KEYWORD_CUES = ("pwd", "bearer", "auth", "private")
KEYWORD_ENTROPY = 2.5
MAX_OWNERS = 2
MAX_REPOS = 4


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), by kind in order of position."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(c in low for c in CUES):
        out += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return out


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values())


def extra_candidates(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[int, int, str]]:
    """Random-looking values after key words, and random-looking tokens, outside the base spans and each other."""
    taken = [(a, b) for _, a, b, _ in base]
    out = []

    def put(a: int, b: int, v: str, least: float) -> None:
        if any(x.isdigit() for x in v) and any(x.isalpha() for x in v) and entropy(v) >= least and not any(x < b and a < y for x, y in taken):
            taken.append((a, b))
            out.append((a, b, v))

    low = text.lower()
    if any(c in low for c in KEYWORD_CUES):
        for m in KEYWORD.finditer(text):
            put(m.start(1), m.end(1), m[1], KEYWORD_ENTROPY)
    for m in TOKEN.finditer(text):
        put(m.start(), m.end(), m[0], LEAST_ENTROPY)
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.int64())])
    for batch in batches:
        found = []
        for t in batch.column("text"):
            text = t.as_py() or ""
            base = base_spans(text)
            row = [{"kind": k, "start": a, "end": b, "value": _hash(v)} for k, a, b, v in base]
            found.append(row + [{"kind": "live", "start": a, "end": b, "value": _hash(v)} for a, b, v in extra_candidates(text, base)])
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "repo", "owner")] + [pa.array(found, pa.list_(span))], ["doc_id", "repo", "owner", "spans"])


def _hash(value: str) -> int:
    h = xxhash.xxh3_64_intdigest(value.encode())
    return h - (1 << 64) if h >> 63 else h


def candidates(docs: DataFrame, repo: Column, owner: Column) -> DataFrame:
    """(doc_id, repo, owner, spans, row): every row's base spans and candidates; ``row`` is unique."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.coalesce(repo.cast("string"), F.lit("")).alias("repo"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), "text")
    spans = "array<struct<kind:string,start:bigint,end:bigint,value:bigint>>"
    scanned = slim.mapInArrow(_scan, f"doc_id {kind}, repo string, owner string, spans {spans}")
    return stage(scanned.withColumn("row", F.monotonically_increasing_id()), "candidates")


def ownership(found: DataFrame) -> DataFrame:
    """(value, repos, owners): in how many repositories and with how many owners each candidate occurs."""
    pairs = found.select("repo", "owner", F.explode("spans.value").alias("value")).distinct()
    by_repo = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_repo.groupBy("value").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))


def _digest(spans: Column) -> Column:
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("k"), s["end"].alias("b"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def scan(docs: DataFrame, repo: Column | None = None, owner: Column | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per row of ``docs``: doc_id, base (spans), spans (with the live ones added), n_live, n_copied.

    A repository is a document and an owner a source, unless they are given.
    n_live and n_copied count a document's values by the verdict, whatever their kind.
    """
    found = candidates(docs, F.col("doc_id") if repo is None else repo, F.col("source") if owner is None else owner)
    some = found.filter(F.size("spans") > 0)
    common = ownership(some).filter((F.col("owners") > max_owners) | (F.col("repos") > max_repos)).select("value")
    verdicts = some.select("row", F.explode(F.array_distinct("spans.value")).alias("value")).join(common, "value").groupBy("row").agg(F.collect_list("value").alias("copied"))
    joined = found.select("row", "doc_id", "spans").join(verdicts, "row", "left")
    copied = lambda s: F.coalesce(F.array_contains(F.col("copied"), s["value"]), F.lit(False))
    return joined.select(
        "doc_id",
        F.filter("spans", lambda s: s["kind"] != "live").alias("base"),
        F.filter("spans", lambda s: (s["kind"] != "live") | ~copied(s)).alias("spans"),
        F.size(F.filter("spans", lambda s: ~copied(s))).cast("long").alias("n_live"),
        F.size(F.filter("spans", copied)).cast("long").alias("n_copied"),
    )


def report(scanned: DataFrame) -> DataFrame:
    """The digest columns of the result of ``scan``."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), "n_live", "n_copied")

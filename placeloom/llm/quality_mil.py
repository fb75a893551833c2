"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words (the whole text, the last passage being what is left). Each passage is
encoded from its words and its character trigrams, hashed into BUCKETS rows of a learned embedding and averaged, and from
FEATURES statistics of its words and characters; a tanh layer joins them. Gated attention weighs the passages, softmax over
w . (tanh(V h) * sigmoid(U h)); the weighted sum of the encodings is scored by a logistic layer. Only documents have
labels; embedding, encoder and attention are learned from them together.

The network is trained in numpy on the driver, on a bounded sample: at most TRAIN_DOCS labelled documents, the least by
hash of those that are not held out, and of each at most TRAIN_PASSAGES passages, evenly spaced. Scoring takes every
passage, one text at a time and a bounded number of passages in memory, so that equal texts have equal scores whatever
stands beside them. The inputs are the text alone.

Defined cases: null, empty and blank texts are one passage of zeros; with labels of one class only, or none, every score
is the share of label 1 (1/2 without labels); documents with contradicting labels count as label 0; of rows with one
doc_id the least text is learned; repeated rows repeat their scores; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PASSAGE = 64
FEATURES = 14
BUCKETS = 4096
EMBED = 12
TRAIN_DOCS = 4000
TRAIN_PASSAGES = 16
CHUNK = 128
THRESHOLD = 0.3
FOLDS = 5

_CLASS = np.full(256, 6, np.uint8)  # other bytes: parts of letters beyond ASCII
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in " \t\n\x0b\x0c\r"]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[b for b in range(33, 127) if _CLASS[b] == 6]] = 5
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


_HALF = BUCKETS // 2
_BITS = _HALF.bit_length() - 1
#: Tabulation hashing of words: a random number for each byte at each place; separators count nothing.
_TABLE = np.random.default_rng(8).integers(0, 1 << 64, (16, 256), np.uint64)
_TABLE[:, 32] = 0


def word_list(text: str | bytes | None) -> list[bytes]:
    return (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).split()


def passages(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of at most CHUNK passages: (number of passages, FEATURES) statistics, and their grams as flat places in a
    (number of passages, BUCKETS) matrix with weights. Words and trigrams of a passage weigh 1 together each."""
    if not ws:
        return np.zeros((1, FEATURES), np.float32), np.empty(0, np.int64), np.empty(0, np.float32)
    n = len(ws)
    starts = np.arange(0, n, PASSAGE)
    size = np.minimum(PASSAGE, n - starts).astype(np.float32)
    lengths = np.fromiter(map(len, ws), np.int64, n)
    joined = np.frombuffer(b" ".join(ws), np.uint8)
    firsts = np.cumsum(lengths) - lengths + np.arange(n)
    begins = firsts[starts]
    cls = _CLASS[joined]
    caps = np.add.reduceat((cls[firsts] == 1).astype(np.int32), starts) / size
    ends = np.add.reduceat(_STOP[joined[firsts + lengths - 1]].astype(np.int32), starts) / size
    chars = np.diff(np.r_[begins, len(joined)])
    share = [np.add.reduceat((cls == c).astype(np.int32), begins) / chars.astype(np.float32) for c in (1, 2, 4, 5, 6)]
    short = np.add.reduceat((lengths <= 3).astype(np.int32), starts) / size
    long = np.add.reduceat((lengths >= 12).astype(np.int32), starts) / size
    mean = np.add.reduceat(lengths, starts) / size
    spread = np.sqrt(np.maximum(np.add.reduceat(lengths * lengths, starts) / size - mean * mean, 0))
    at = np.arange(len(joined)) - np.repeat(firsts, lengths + 1)[: len(joined)]
    hashes = np.add.reduceat(_TABLE[at & 15, joined], firsts)
    kinds, twice = [], []
    for s in starts.tolist():
        p = ws[s : s + PASSAGE]
        kinds.append(len(set(p)) / len(p))
        twice.append(sum(map(bytes.__eq__, p, p[1:])) / len(p))
    stats = np.stack([*share, short, long, mean / 8, spread / 4, np.array(kinds), np.array(twice), ends, caps, size / PASSAGE], axis=1).astype(np.float32)
    byte = joined.astype(np.uint32)
    grams = ((byte[:-2] | byte[1:-1] << np.uint32(8) | byte[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)
    of_byte = np.repeat(np.arange(len(starts)), chars)[: len(grams)]
    of_word = np.arange(n) // PASSAGE
    places = np.concatenate([of_word * BUCKETS + (hashes >> np.uint64(64 - _BITS)).astype(np.int64), of_byte * BUCKETS + _HALF + grams.astype(np.int64)])
    weights = np.concatenate([(1 / size)[of_word], (1 / chars.astype(np.float32))[of_byte]]).astype(np.float32)
    return stats, places, weights


def dense(places: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(places, weights, n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)


def sampled(text: str | None, limit: int = TRAIN_PASSAGES) -> bytes:
    """At most ``limit`` passages of a text, evenly spaced."""
    ws = word_list(text)
    n = -(-len(ws) // PASSAGE)
    if n > limit:
        ws = [w for k in range(limit) for w in ws[k * (n - 1) // (limit - 1) * PASSAGE :][:PASSAGE]]
    return b" ".join(ws)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class AttentionMil:
    NAMES = ("emb", "w1", "b1", "v", "u", "w", "c", "d")

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.emb = rng.normal(0, 0.1, (BUCKETS, EMBED)).astype(np.float32)
        self.w1, self.b1 = draw(FEATURES + EMBED, hidden), np.zeros(hidden)
        self.v, self.u, self.w = draw(hidden, gate), draw(hidden, gate), draw(gate)
        self.c, self.d = draw(hidden), np.zeros(1)
        self.constant: float | None = None

    def inputs(self, stats: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return np.concatenate([((stats - self.mean) / self.scale).clip(-8, 8), grams @ self.emb], axis=1)

    def _forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple:
        h = np.tanh(x @ self.w1 + self.b1)
        tv, su = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        a = (tv * su) @ self.w
        top = np.maximum.reduceat(a, starts)
        e = np.exp(a - np.repeat(top, sizes))
        att = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(att[:, None] * h, starts, axis=0)
        return h, tv, su, att, z, _sigmoid(z @ self.c + self.d)

    def score(self, text: str | None) -> float:
        """The score of one text, in [0, 1]."""
        if self.constant is not None:
            return self.constant
        ws = word_list(text)
        parts = []
        for k in range(0, max(1, len(ws)), CHUNK * PASSAGE):
            stats, places, weights = passages(ws[k : k + CHUNK * PASSAGE])
            parts.append(self.inputs(stats, dense(places, weights, len(stats))))
        x = np.concatenate(parts)
        return float(self._forward(x, np.zeros(1, np.int64), np.array([len(x)]))[-1][0])

    def loss_and_grads(self, stats: np.ndarray, grams: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of a batch of bags and its gradients."""
        starts, x = np.cumsum(sizes) - sizes, self.inputs(stats, grams)
        h, tv, su, att, z, p = self._forward(x, starts, sizes)
        dz0 = (p - y) / len(y)
        g = {"c": z.T @ dz0, "d": np.array([dz0.sum()])}
        dz = np.repeat(dz0[:, None] * self.c, sizes, axis=0)
        datt = (dz * h).sum(axis=1)
        da = att * (datt - np.repeat(np.add.reduceat(att * datt, starts), sizes))
        g["w"] = (tv * su).T @ da
        dt, ds = da[:, None] * self.w * su * (1 - tv * tv), da[:, None] * self.w * tv * su * (1 - su)
        g["v"], g["u"] = h.T @ dt, h.T @ ds
        dh = (att[:, None] * dz + dt @ self.v.T + ds @ self.u.T) * (1 - h * h)
        g["w1"], g["b1"] = x.T @ dh, dh.sum(axis=0)
        g["emb"] = grams.T @ (dh @ self.w1[FEATURES:].T).astype(grams.dtype)
        return float(-np.mean(y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))), g

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 4) -> AttentionMil:
        labels = np.asarray(labels, float)
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        bags = [passages(word_list(t)) for t in texts]
        every = np.concatenate([b[0] for b in bags])
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for first in range(0, len(order), batch):
                pick = order[first : first + batch]
                sizes = np.array([len(bags[i][0]) for i in pick])
                starts = np.cumsum(sizes) - sizes
                places = np.concatenate([bags[i][1] + s * BUCKETS for i, s in zip(pick, starts, strict=True)])
                grams = dense(places, np.concatenate([bags[i][2] for i in pick]), int(sizes.sum()))
                _, g = self.loss_and_grads(np.concatenate([bags[i][0] for i in pick]), grams, sizes, labels[pick])
                step += 1
                for k in self.NAMES:
                    grad = g[k] + decay * getattr(self, k)
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    setattr(self, k, (getattr(self, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(m[k].dtype))
        return self


def fold(doc_id) -> F.Column:
    """The fold of a document: 0 is held out."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("label"), pa.array([sampled(t.as_py()) for t in batch.column("text")], pa.binary())], ["h", "label", "sample"])


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> AttentionMil:
    """A model fitted to at most ``limit`` labelled documents that are not held out."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    sample = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(limit)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("h", "doc_id", "label").agg(F.min("text").alias("text"))  # at most ``limit`` rows are broadcast and sent
    rows = sorted(((r["h"], r["label"], bytes(r["sample"])) for r in texts.select("h", "label", "text").mapInArrow(_samples, "h bigint, label int, sample binary").collect()), key=lambda r: r[0])
    return AttentionMil().fit([t for _, _, t in rows], np.array([y for _, y, _ in rows]))


def score(docs: DataFrame, model: AttentionMil) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

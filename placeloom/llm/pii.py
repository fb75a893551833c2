"""Personal data: base rules, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The tagger is trained in numpy on the driver from labelled spans of a bounded sample of documents: TRAIN_DOCS distinct
texts of at most TRAIN_CHARS characters that have a digit or an at sign, the least by hash in a hash sample of SAMPLE_DOCS
documents; at most TRAIN_WINDOWS windows, half of them with spans. The base rules label them, and every labelled text is
learned twice: as it is, and with its spans written in ways that the base rules don't know (see ``variants``), so that the
model learns what surrounds a span and not only the rules' own shapes.

For decoding, every text is cut into regions around each digit, at sign and spelled-out at sign; a region without any can't hold a
span. Regions are covered by overlapping windows; emissions of windows are blended by distance from the window's edge, and
one Viterbi pass over the whole region reconciles them globally. Regions of more than PIECE characters are decoded in
pieces that overlap by OVERLAP on either side, so memory is bounded for any text. A decoded span is added if it overlaps
no base span, can be read as its kind (see ``_plausible``) and has a mean posterior tag probability of at least LEAST_SURE.

Defined cases: null text is empty; repeated rows repeat their spans and are learned once; without any labelled span nothing
is added; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base rules.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

TRAIN_DOCS = 1500
TRAIN_CHARS = 4000
SAMPLE_DOCS = 30_000
TRAIN_WINDOWS = 1600
EPOCHS = 6
LEAST_STEPS = 150
WINDOW, STRIDE, REACH = 64, 32, 40
EMBED, HIDDEN = 12, 16
TAGS = 1 + 2 * len(KINDS)
LEAST_SURE = 0.9
PIECE, OVERLAP = 4096, 128
FLUSH = 4096
CUE = re.compile("[0-9@]")
REGION_CUE = re.compile(r"[0-9@]|[(\[{] ?(?:at|AT) ?[)\]}]")
NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        d = d * 2 - 9 * (d > 4) if i % 2 else d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches around each at sign: the local part is the run before it, from the end of the last match on."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order of kind, then position."""
    if not CUE.search(text):
        return []
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", CARD, 12, 19), ("phone", PHONE, 9, 15)):
        for m in pattern.finditer(text):
            digits = NOT_DIGIT.sub("", m[0])
            if low <= len(digits) <= high and (kind == "phone" or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


def encode(text: str) -> np.ndarray:
    """Symbols: one for all digits, ASCII characters, and one for the rest."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(codes < 128, codes, 127).astype(np.int64)
    out[(codes >= 48) & (codes <= 57)] = 48
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Embedding, LSTM in both directions, linear emissions, CRF transitions. All in float32."""

    NAMES = ("emb", "wf", "bf", "wb", "bb", "wo", "bo", "trans", "init")

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.emb = (draw(128, EMBED) * 3).astype(np.float32)
        self.wf, self.wb = draw(EMBED + HIDDEN, 4 * HIDDEN), draw(EMBED + HIDDEN, 4 * HIDDEN)
        self.bf, self.bb = np.zeros(4 * HIDDEN, np.float32), np.zeros(4 * HIDDEN, np.float32)
        self.bf[HIDDEN : 2 * HIDDEN] = self.bb[HIDDEN : 2 * HIDDEN] = 1
        self.wo, self.bo = draw(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32)
        self.trans, self.init = np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)

    def _lstm(self, x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        n, steps, _ = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        pre = x @ w[:EMBED] + b
        out, saved = np.empty((n, steps, HIDDEN), np.float32), []
        for t in range(steps):
            g = pre[:, t] + h @ w[EMBED:]
            i, f, o = np.split(_sigmoid(g[:, : 3 * HIDDEN]), 3, axis=1)
            u = np.tanh(g[:, 3 * HIDDEN :])
            was_h, was_c = h, c
            c = f * c + i * u
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep:
                saved.append((i, f, o, u, was_h, was_c, tc))
        return out, saved

    def _lstm_back(self, grad: np.ndarray, x: np.ndarray, w: np.ndarray, saved: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dw, db, dx = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32), np.empty_like(x)
        dh = dc = np.zeros((len(x), HIDDEN), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            i, f, o, u, was_h, was_c, tc = saved[t]
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dg = np.concatenate([dc * u * i * (1 - i), dc * was_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            dw[:EMBED] += x[:, t].T @ dg
            dw[EMBED:] += was_h.T @ dg
            db += dg.sum(axis=0)
            dx[:, t], dh, dc = dg @ w[:EMBED].T, dg @ w[EMBED:].T, dc * f
        return dw, db, dx

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        x = self.emb[codes]
        f, _ = self._lstm(x, self.wf, self.bf, False)
        b, _ = self._lstm(x[:, ::-1], self.wb, self.bb, False)
        return np.concatenate([f, b[:, ::-1]], axis=2) @ self.wo + self.bo

    def loss_and_grads(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences and its gradients, by forward-backward and back-propagation through time."""
        n, steps = codes.shape
        x = self.emb[codes]
        hf, sf = self._lstm(x, self.wf, self.bf, True)
        xb = x[:, ::-1]
        hb, sb = self._lstm(xb, self.wb, self.bb, True)
        h = np.concatenate([hf, hb[:, ::-1]], axis=2)
        em = h @ self.wo + self.bo
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = self.init + em[:, 0]
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        for t in range(1, steps):
            alpha[:, t] = lse(alpha[:, t - 1][:, :, None] + self.trans, 1) + em[:, t]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = lse(self.trans + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        rows, ts = np.arange(n)[:, None], np.arange(steps)[None, :]
        gold = self.init[tags[:, 0]] + em[rows, ts, tags].sum(axis=1) + self.trans[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        pairs = np.exp(alpha[:, :-1, :, None] + self.trans + (em + beta)[:, 1:, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        dtrans = pairs - np.bincount((tags[:, :-1] * TAGS + tags[:, 1:]).ravel(), minlength=TAGS * TAGS).reshape(TAGS, TAGS)
        dem = np.exp(alpha + beta - z[:, None, None])
        dem[rows, ts, tags] -= 1
        dem = (dem / n).astype(np.float32)
        flat = dem.reshape(-1, TAGS)
        g = {"wo": h.reshape(-1, 2 * HIDDEN).T @ flat, "bo": flat.sum(axis=0), "trans": (dtrans / n).astype(np.float32), "init": dem[:, 0].sum(axis=0)}
        dh = dem @ self.wo.T
        g["wf"], g["bf"], dxf = self._lstm_back(dh[:, :, :HIDDEN], x, self.wf, sf)
        g["wb"], g["bb"], dxb = self._lstm_back(dh[:, ::-1, HIDDEN:], xb, self.wb, sb)
        g["emb"] = np.zeros_like(self.emb)
        np.add.at(g["emb"], codes, dxf + dxb[:, ::-1])
        return float((z - gold).mean()), g

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.015, seed: int = 6) -> Tagger:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        step = 0
        for _ in range(max(epochs, -(-LEAST_STEPS * batch // max(1, len(codes))))):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                _, g = self.loss_and_grads(codes[pick], tags[pick])
                scale = min(1.0, 5.0 / (np.sqrt(sum(float((x * x).sum()) for x in g.values())) + 1e-9))
                step += 1
                for k in self.NAMES:
                    m[k] = 0.9 * m[k] + 0.1 * g[k] * scale
                    v[k] = 0.999 * v[k] + 0.001 * (g[k] * scale) ** 2
                    setattr(self, k, (getattr(self, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
        return self

    def decode(self, em: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tag sequences of regions' emissions (regions, steps, TAGS), padded beyond ``lengths``."""
        n, steps, _ = em.shape
        score, back, same = self.init + em[:, 0], np.empty((n, steps, TAGS), np.int8), np.arange(TAGS)
        for t in range(1, steps):
            total, live = score[:, :, None] + self.trans, (t < lengths)[:, None]
            best = total.argmax(axis=1)
            back[:, t] = np.where(live, best, same)
            score = np.where(live, np.take_along_axis(total, best[:, None], axis=1)[:, 0] + em[:, t], score)
        out, rows = np.empty((n, steps), np.int64), np.arange(n)
        out[:, -1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            out[:, t - 1] = back[rows, t, out[:, t]]
        return out

    def sureness(self, em: np.ndarray, lengths: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """The posterior probability of each tag of the sequences, by forward-backward."""
        n, steps, _ = em.shape
        fore, back = np.empty(em.shape), np.zeros(em.shape)
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        fore[:, 0] = self.init + em[:, 0]
        for t in range(1, steps):
            fore[:, t] = lse(fore[:, t - 1][:, :, None] + self.trans, 1) + em[:, t]
        for t in range(steps - 2, -1, -1):
            back[:, t] = np.where((t < lengths - 1)[:, None], lse(self.trans + (em[:, t + 1] + back[:, t + 1])[:, None, :], 2), 0)
        z = lse(fore[np.arange(n), lengths - 1], 1)
        return np.exp(np.minimum(np.take_along_axis(fore + back, tags[:, :, None], axis=2)[:, :, 0] - z[:, None], 0))


def regions(text: str) -> list[tuple[int, int]]:
    """Merged [start, end) intervals of REACH characters around each digit and at sign, spelled out or not."""
    out: list[list[int]] = []
    for m in REGION_CUE.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _tags(length: int, spans: list[tuple[str, int, int]], start: int) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, a, b in reversed(spans):
        k = KINDS.index(kind)
        lo, hi = max(a - start, 0), min(b - start, length)
        if lo < hi:
            tags[lo:hi] = 2 + 2 * k
            if a >= start:
                tags[lo] = 1 + 2 * k
    return tags


def variants(kind: str, piece: str, rng: np.random.Generator) -> str:
    """A labelled span in a form that the base rules don't know."""
    pick = lambda *forms: forms[int(rng.integers(len(forms)))]
    if kind == "email":
        name, _, host = piece.rpartition("@")
        return name + pick(" @ ", " (at) ", " [at] ", "(at)") + host.replace(".", pick(".", ".", " (dot) ", "(dot)", "[.]"))
    if kind == "ip":
        return piece.replace(".", pick("[.]", "(.)", " . ", "[dot]"))
    digits = NOT_DIGIT.sub("", piece)
    if kind == "card":
        sign = pick(".", "/", "_", "  ")
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    sign = pick(" ", ".", "-", "/")
    own = digits[len(digits) - 9 :]
    return pick("0", "00" + digits[: max(1, len(digits) - 9)] + sign, "(0)") + own[0] + sign + sign.join(own[i : i + 2] for i in range(1, 9, 2))


def varied(text: str, spans: list[tuple[str, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[str, int, int]]]:
    """``text`` with its spans rewritten, and where they are then. Of overlapping spans the first stays."""
    out, put, done, size = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < done:
            continue
        new = variants(kind, text[a:b], rng)
        out += [text[done:a], new]
        size += a - done
        put.append((kind, size, size + len(new)))
        size, done = size + len(new), b
    return "".join([*out, text[done:]]), put


def training_windows(texts: list[str], limit: int = TRAIN_WINDOWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` windows over the regions of ``texts`` and of their variants, half of them with spans if there are so many."""
    rng, held = np.random.default_rng(seed), ([], [])
    for text in texts:
        spans = base_spans(text)
        for own, where in [(text, spans), varied(text, spans, rng)] if spans else [(text, spans)]:
            coded = encode(own)
            for k, (a, b) in enumerate(regions(own)):
                for start in range(max(0, a - (7 * k) % 23), max(a + 1, b - WINDOW // 2), WINDOW):
                    piece = coded[start : start + WINDOW]
                    tags, pad = _tags(len(piece), where, start), WINDOW - len(piece)
                    side = held[int(tags.any())]
                    if len(side) < limit // 2:
                        side.append((np.pad(piece, (0, pad), constant_values=10), np.pad(tags, (0, pad))))
    both = held[1] + held[0]
    return (np.array([c for c, _ in both]), np.array([t for _, t in both])) if both else (np.empty((0, WINDOW), np.int64), np.empty((0, WINDOW), np.int64))


def _edge_weight() -> np.ndarray:
    i = np.arange(WINDOW)
    return (np.minimum(i, WINDOW - 1 - i) + 1).astype(np.float32)


SPELLED_AT = re.compile(r"\s*[(\[{]\s*(?:at|AT)\s*[)\]}]\s*|\s*@\s*")
SPELLED_DOT = re.compile(r"\s*[(\[{]\s*(?:dot|DOT|\.)\s*[)\]}]\s*|\s+\.\s+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CARD_SIGNS = re.compile(r"[0-9][0-9\s./_-]*[0-9]")
PHONE_SIGNS = re.compile(r"(?:\+|00?|\()[0-9\s()./-]*[0-9]")


def _plausible(kind: str, piece: str) -> bool:
    """Whether a piece can be read as its kind once signs are no longer spelled out or spaced. Wider than the base rules:
    a bare number is never enough, and numbers that fail their kind's check are no personal data, whatever the model says."""
    digits = NOT_DIGIT.sub("", piece)
    if kind == "email":
        return EMAIL.fullmatch(SPELLED_DOT.sub(".", SPELLED_AT.sub("@", piece))) is not None
    if kind == "ip":
        parts = SPELLED_DOT.sub(".", piece).split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return CARD_SIGNS.fullmatch(piece) is not None and 12 <= len(digits) <= 19 and luhn(digits)
    return PHONE_SIGNS.fullmatch(piece) is not None and 9 <= len(digits) <= 15 and len(re.findall("[0-9]+", piece)) >= 3


def _pieces(a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, from, to): what is decoded together of a region, and the part of it whose spans count."""
    for k in range(a, b, PIECE):
        yield max(a, k - OVERLAP), min(b, k + PIECE + OVERLAP), k, min(b, k + PIECE)


def _decoded(model: Tagger, jobs: list[tuple], windows: list[np.ndarray]) -> Iterator[tuple[int, list[tuple[str, int, int, float]]]]:
    """(text number, spans with their sureness) of pieces whose windows go through the network together."""
    em = np.concatenate([model.emissions(np.array(windows[i : i + 512])) for i in range(0, len(windows), 512)])
    weight = _edge_weight()[:, None]
    jobs = sorted(jobs, key=lambda j: j[2] - j[1])
    for at in range(0, len(jobs), 64):
        part = jobs[at : at + 64]
        lengths = np.array([b - a for _, a, b, *_ in part])
        blended = np.zeros((len(part), int(lengths.max()), TAGS), np.float32)
        for row, (_, a, b, _, _, first, starts) in enumerate(part):
            norm = np.zeros((b - a, 1), np.float32)
            for k, s in enumerate(starts):
                size = min(WINDOW, b - s)
                blended[row, s - a : s - a + size] += em[first + k][:size] * weight[:size]
                norm[s - a : s - a + size] += weight[:size]
            blended[row, : b - a] /= np.maximum(norm, 1e-9)
        best = model.decode(blended, lengths)
        best[np.arange(best.shape[1]) >= lengths[:, None]] = 0
        some = np.flatnonzero(best.any(axis=1))
        if not len(some):
            continue
        sure = model.sureness(blended[some], lengths[some], best[some])
        for row, own in zip(some.tolist(), sure, strict=True):
            n, a, b, low, high, *_ = part[row]
            tags, t, spans = best[row], 0, []
            while t < b - a:
                if tags[t] == 0:
                    t += 1
                    continue
                k, end = (tags[t] - 1) // 2, t + 1
                while end < b - a and tags[end] == 2 + 2 * k:
                    end += 1
                if low <= a + t < high:
                    spans.append((KINDS[k], a + t, a + end, float(own[t:end].mean())))
                t = end
            yield n, spans


def added_spans(model: Tagger, texts: list[tuple[str, list[tuple[str, int, int]]]]) -> list[list[tuple[str, int, int]]]:
    """For each (text, base spans) the spans that the model adds. At most FLUSH windows, and those of one piece, are held at once."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    jobs, windows = [], []

    def flush() -> None:
        for n, spans in _decoded(model, jobs, windows) if windows else ():
            text, base = texts[n]
            out[n] += [(k, a, b) for k, a, b, sure in spans if sure >= LEAST_SURE and _plausible(k, text[a:b]) and not any(x < b and a < y for _, x, y in base)]
        jobs.clear()
        windows.clear()

    for n, (text, _) in enumerate(texts):
        found = regions(text)
        coded = encode(text) if found else None
        for a, b in found:
            for start, end, low, high in _pieces(a, b):
                starts = list(range(start, max(start + 1, end - STRIDE), STRIDE))
                jobs.append((n, start, end, low, high, len(windows), starts))
                windows += [np.pad(coded[s : min(s + WINDOW, end)], (0, WINDOW - (min(s + WINDOW, end) - s)), constant_values=10) for s in starts]
                if len(windows) >= FLUSH:
                    flush()
    flush()
    return [_apart(spans) for spans in out]


def _apart(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans in order, without those that begin within another (pieces of one region may cut it differently)."""
    out: list[tuple[str, int, int]] = []
    for s in sorted(spans, key=lambda s: s[1:]):
        if not out or s[1] >= out[-1][2]:
            out.append(s)
    return out


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, KINDS.index(k), b, k) for k, a, b in spans))


def train(docs: DataFrame, limit: int = TRAIN_DOCS, longest: int = TRAIN_CHARS) -> Tagger | None:
    """A tagger fitted to the labelled spans of at most ``limit`` distinct texts of at most ``longest`` characters each; None without spans.

    The texts come from a hash sample of about ``SAMPLE_DOCS`` documents, so that what tasks send doesn't grow with their number."""
    h = F.xxhash64("text")
    every = max(1, docs.count() // SAMPLE_DOCS)
    some = docs.select("text").filter((F.pmod(h, F.lit(every)) == 0) & F.col("text").rlike("[0-9@]") & (F.length("text") <= longest)).distinct()
    texts = [r["text"] for r in some.withColumn("h", h).orderBy("h", "text").limit(limit).collect()]  # bounded
    codes, tags = training_windows(texts)
    return Tagger().fit(codes, tags) if tags.any() else None


def find(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    spark = docs.sparkSession
    model = train(docs) if model is None else model
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [(t.as_py() or "") for t in part.column("text")]
                base = [base_spans(t) for t in texts]
                more = added_spans(tagger, list(zip(texts, base, strict=True))) if tagger is not None else [[] for _ in texts]
                counts = [[sum(s[0] == k for s in b) for b in base] for k in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array([hashlib.sha256(digest(b).encode()).hexdigest() for b in base]), pa.array([digest(b + m) for b, m in zip(base, more, strict=True)]), pa.array([len(m) for m in more], pa.int64())],
                    ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, n_added bigint")

"""Plain, slow versions of the operators' rules."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text: str | None) -> set:
    ws = WORD.findall(lower(text or ""))
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def components(docs: dict[int, str | None]) -> dict[int, int]:
    sets = {d: shingle_set(t) for d, t in docs.items()}
    up = {d: d for d in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {d: find(d) for d in docs}


def digest(spans: list[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, kinds.index(k), b, k) for k, a, b in spans))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    ds = [int(c) for c in digits][::-1]
    return (sum(ds[::2]) + sum(sum(divmod(2 * d, 10)) for d in ds[1::2])) % 10 == 0


def pii(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 12, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if low <= len(d) <= high and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return out


def secrets(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    key = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password") + "|" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [("assign", *m.span()) for m in re.finditer(rf"""({key})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return out


def repeat_words(ws: list[str]) -> int:
    seen: dict[tuple, list[int]] = {}
    for i in range(len(ws) - 7):
        seen.setdefault(tuple(ws[i : i + 8]), []).append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)})


def base_failed(text: str | None) -> bool:
    ws = WORD.findall(text or "")
    return len(ws) < 20 or 100 * repeat_words(ws) > 30 * len(ws)

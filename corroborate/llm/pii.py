"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions beside them.

The patterns find well-formed email addresses, IP addresses, card and phone numbers. The network, trained in numpy
from labelled spans (sentences made by a seeded generator, so training needs no corpus and is the same anywhere),
adds spans in other spellings: bracketed or spaced addresses, phones without a plus, cards with other separators.
Texts are read in windows of WINDOW characters, half of which overlap; each window is decoded by Viterbi, and the
windows' spans are reconciled over the whole text: those cut by a window's edge yield to the neighbour that holds
them whole, or are read again in a window wide enough; then the one deeper inside its window wins. Spans must pass their kind's check, and need a digit,
an at sign or a bracketed `at`; windows with none outside the patterns' spans can't add any and aren't decoded.

Cases: null counts as empty, with no span; offsets are code points, end exclusive; added spans may have any
length and never overlap a pattern's span or each other; equal texts give equal spans; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corroborate.session import ship

KINDS = ("email", "ip", "card", "phone")
WINDOW = 96
RESULT = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>"
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|AT)[\])]")
_AT = re.compile(r"@|[\[(](?:at|AT)[\])]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, from each at sign outwards: a run without `@` is never scanned twice."""
    out: list[Span] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        floor = m.end() if m else at + 1
        at = text.find("@", floor)
    return out


def patterns(text: str) -> list[Span]:
    """Spans by kind as in KINDS, then by start."""
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


_OTHER_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(](?:at|AT)[\])]) ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]+)+")
_OTHER_IP = re.compile(r"[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}")
_OTHER_CARD = re.compile(r"[0-9]{4}(?:[ .:/_-]{0,3}[0-9]{2,7}){2,4}")
_OTHER_PHONE = re.compile(r"(?:\+|00)?[ (]*[0-9]{1,4}(?:[ ().:/-]{1,3}[0-9]{2,8}){2,4}")


def sound(kind: str, text: str) -> bool:
    """The check that an added span must pass."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "email":
        return bool(_OTHER_EMAIL.fullmatch(text))
    if kind == "ip":
        return bool(_OTHER_IP.fullmatch(text)) and all(int(p) <= 255 for p in re.findall(r"[0-9]+", text))
    if kind == "card":
        return bool(_OTHER_CARD.fullmatch(text)) and 16 <= len(digits) <= 19 and luhn(digits)
    return bool(_OTHER_PHONE.fullmatch(text)) and 8 <= len(digits) <= 15


# --- the network


@dataclass(frozen=True)
class Params:
    """sentences bounds what training reads; nothing comes from a corpus."""

    sentences: int = 4000
    hidden: int = 20
    steps: int = 260
    batch: int = 64
    length: int = 80
    rate: float = 0.02
    seed: int = 5


@dataclass
class Model:
    inputs: list[np.ndarray]  # by direction: classes x 4 hidden
    hidden: list[np.ndarray]  # by direction: hidden x 4 hidden
    out: np.ndarray  # 2 hidden + 1 x tags
    moves: np.ndarray  # tags x tags
    start: np.ndarray


TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = 7 + len(_SIGNS)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Classes of the first 128 characters: padding 0, digit, lower, upper, other letter or sign, space, line end, each ASCII sign."""
    out = np.full(128, 4, np.int64)
    for c in range(128):
        s = chr(c)
        out[c] = 1 if s.isdigit() else 2 if s.islower() else 3 if s.isupper() else 5 if s in " \t" else 6 if s in "\n\r" else 7 + _SIGNS.index(s) if s in _SIGNS else 4
    return out


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _classes()[np.minimum(points, 127)], 4)


def _sentence(rng: np.random.Generator) -> tuple[str, list[Span]]:
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    letters = lambda a, b: "".join(chr(97 + k) for k in rng.integers(0, 26, rng.integers(a, b)))

    def word() -> str:
        w = letters(1, 11) if rng.random() < 0.8 else letters(12, 40) if rng.random() < 0.1 else letters(1, 4) + pick("é", "ä", "ó", "ß", "è") + letters(0, 5)
        return (w.capitalize() if rng.random() < 0.15 else w) + (pick(",", ".", "!", "?", ":", "%%%", "***", " |") if rng.random() < 0.15 else "")

    def card() -> str:
        body = "4" + digits(14)
        d = body + next(x for x in "0123456789" if luhn(body + x))
        return pick(" ", "-", "", ".", "/", " - ", "_").join(d[k : k + 4] for k in range(0, 16, 4))

    def email() -> str:
        host, end = pick("mail", "post", "") + letters(3, 8), pick("com", "org", "net", "example.com", letters(3, 12) + ".edu")
        name = pick("", ".", "_", "-").join(letters(1, 16) for _ in range(rng.integers(1, 5))) + pick("", digits(2))
        at, dot = pick(("@", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", "."), ("[at]", "."))
        return name + at + host + dot + end.replace(".", dot)

    def ip() -> str:
        return pick(".", ".", "[.]", " . ", "(.)").join(str(k) for k in rng.integers(0, 256, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+49/{a}/{b}{c}", f"0049 {a} {b} {c}", f"1-{a}-{b}-{c}", f"+44 {a} {b} {c}")

    def clutter() -> str:
        hexed = "".join(pick(*"0123456789abcdef") for _ in range(rng.integers(8, 36)))
        return pick(digits(rng.integers(1, 8)), digits(12), f"v{digits(1)}.{digits(2)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"password={hexed}", f'token = "{hexed}"', hexed, f"${digits(3)}.{digits(2)}", f"[{digits(2)}]", f"http://{letters(3, 8)}.org/{digits(4)}", f"{digits(2)}:{digits(2)}:{digits(2)}", "[at]", "@" + letters(3, 6), f"{digits(1)}.{digits(2)}.{digits(3)}", f"{digits(5)} {digits(4)}", f"({digits(3)})")

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    text, spans = "", []
    for _ in range(rng.integers(4, 12)):
        r = rng.random()
        if r < 0.3:
            kind = pick(*KINDS)
            s = makers[kind]()
            spans.append((kind, len(text), len(text) + len(s)))
            text += s + pick(" ", " ", ". ", ", ", "\n")
            while rng.random() < 0.35:  # data side by side, which the patterns may take for one
                kind = pick(kind, kind, *KINDS)
                s, text = makers[kind](), text.rstrip(".,\n ") + " "
                spans.append((kind, len(text), len(text) + len(s)))
                text += s + pick(" ", ", ")
        else:
            text += (clutter() if r < 0.5 else word()) + pick(" ", " ", " ", "\n")
    return text, spans


def _tags(n: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        out[a:b] = 2 + 2 * KINDS.index(kind)
        out[a] -= 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: bool = False):
    """States (steps, batch, hidden) of classes x (steps, batch); with keep, what the way back needs."""
    steps, batch = x.shape
    k = u.shape[0]
    h, c = np.zeros((batch, k), np.float32), np.zeros((batch, k), np.float32)
    out = np.empty((steps, batch, k), np.float32)
    tape = []
    for t in range(steps):
        g = table[x[t]] + h @ u
        s = _sigmoid(g[:, : 3 * k])
        n = np.tanh(g[:, 3 * k :])
        before, h0 = c, h
        c = s[:, k : 2 * k] * c + s[:, :k] * n
        tc = np.tanh(c)
        h = s[:, 2 * k :] * tc
        out[t] = h
        if keep:
            tape.append((s, n, before, tc, h0))
    return out, tape


def _lstm_back(x: np.ndarray, grad: np.ndarray, tape: list, table: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k = u.shape[0]
    d_table, d_u = np.zeros_like(table), np.zeros_like(u)
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    all_g = np.empty((*x.shape, 4 * k), np.float32)
    for t in range(len(x) - 1, -1, -1):
        s, n, before, tc, h0 = tape[t]
        i, f, o = s[:, :k], s[:, k : 2 * k], s[:, 2 * k :]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        g = all_g[t]
        g[:, :k] = dc * n * i * (1 - i)
        g[:, k : 2 * k] = dc * before * f * (1 - f)
        g[:, 2 * k : 3 * k] = dh * tc * o * (1 - o)
        g[:, 3 * k :] = dc * i * (1 - n * n)
        d_u += h0.T @ g
        dh, dc = g @ u.T, dc * f
    np.add.at(d_table, x.ravel(), all_g.reshape(-1, 4 * k))
    return d_table, d_u


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def _crf_grad(e: np.ndarray, y: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood by the emissions e (steps, batch, tags), the moves and the start."""
    steps, batch, k = e.shape
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0] + start
    for t in range(1, steps):
        a[t] = _lse(a[t - 1][:, :, None] + moves, 1) + e[t]
    for t in range(steps - 2, -1, -1):
        b[t] = _lse(moves + (b[t + 1] + e[t + 1])[:, None, :], 2)
    z = _lse(a[-1], 1)
    d_e = np.exp(a + b - z[None, :, None])
    rows = np.arange(batch)
    d_moves = np.zeros_like(moves)
    for t in range(1, steps):
        d_moves += np.exp(a[t - 1][:, :, None] + moves + (b[t] + e[t])[:, None, :] - z[:, None, None]).sum(0)
    np.add.at(d_moves, (y[:-1].ravel(), y[1:].ravel()), -1)
    for t in range(steps):
        d_e[t][rows, y[t]] -= 1
    return d_e, d_moves, d_e[0].sum(0)


@lru_cache(2)
def train(p: Params = Params()) -> Model:
    rng = np.random.default_rng(p.seed)
    k = p.hidden
    made = [_sentence(rng) for _ in range(p.sentences)]
    text = "\n".join(t for t, _ in made)
    x_all = classes(text)
    y_all, at = np.zeros(len(text), np.int64), 0
    for t, spans in made:
        y_all[at : at + len(t)] = _tags(len(t), spans)
        at += len(t) + 1
    f = lambda *s: (rng.standard_normal(s) * 0.25).astype(np.float32)
    params = [f(CLASSES, 4 * k), f(CLASSES, 4 * k), f(k, 4 * k), f(k, 4 * k), f(2 * k + 1, TAGS), np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)]
    for table in params[:2]:
        table[:, k : 2 * k] += 1  # remember at first
    m, v = [np.zeros_like(w) for w in params], [np.zeros_like(w) for w in params]
    for step in range(1, p.steps + 1):
        starts = rng.integers(0, len(text) - p.length, p.batch)
        place = starts[None, :] + np.arange(p.length)[:, None]
        x, y = x_all[place], y_all[place]
        fw, tape_f = _lstm(x, params[0], params[2], True)
        bw, tape_b = _lstm(x[::-1], params[1], params[3], True)
        h = np.concatenate([fw, bw[::-1], np.ones((*x.shape, 1), np.float32)], 2)
        d_e, d_moves, d_start = _crf_grad(h @ params[4], y, params[5], params[6])
        d_e, d_moves, d_start = (d / p.batch for d in (d_e, d_moves, d_start))
        d_h = (d_e @ params[4].T).astype(np.float32)
        d_tf, d_uf = _lstm_back(x, d_h[:, :, :k], tape_f, params[0], params[2])
        d_tb, d_ub = _lstm_back(x[::-1], d_h[::-1, :, k : 2 * k], tape_b, params[1], params[3])
        d_out = h.reshape(-1, 2 * k + 1).T @ d_e.reshape(-1, TAGS)
        grads = [d_tf, d_tb, d_uf, d_ub, d_out, d_moves, d_start]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = p.rate * min(1.0, 2 * (1 - step / (p.steps + 1)))
        for w, g, mw, vw in zip(params, grads, m, v, strict=True):
            g = g * min(1.0, 5 / norm)
            mw += 0.1 * (g - mw)
            vw += 0.005 * (g * g - vw)
            w -= rate * (mw / (1 - 0.9**step)) / (np.sqrt(vw / (1 - 0.995**step)) + 1e-8)
    return Model(params[:2], params[2:4], params[4], params[5], params[6])


def viterbi(model: Model, x: np.ndarray) -> np.ndarray:
    """Best tags (batch, steps) of classes x (steps, batch)."""
    fw, _ = _lstm(x, model.inputs[0], model.hidden[0])
    bw, _ = _lstm(x[::-1], model.inputs[1], model.hidden[1])
    e = np.concatenate([fw, bw[::-1], np.ones((*x.shape, 1), np.float32)], 2) @ model.out
    steps, batch, k = e.shape
    back = np.empty((steps, batch, k), np.int64)
    s = e[0] + model.start
    for t in range(1, steps):
        both = s[:, :, None] + model.moves
        back[t] = both.argmax(1)
        s = both.max(1) + e[t]
    out = np.empty((batch, steps), np.int64)
    out[:, -1] = s.argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[t][rows, out[:, t]]
    return out


def _runs(tags: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the tagged runs among the first n."""
    out, at = [], 0
    while at < n:
        if tags[at] == 0:
            at += 1
            continue
        kind, start = (int(tags[at]) - 1) // 2, at
        at += 1
        while at < n and tags[at] == 2 + 2 * kind:
            at += 1
        out.append((kind, start, at))
    return out


def _decoded(model: Model, texts: list[str], windows: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
    """(text, start, characters, runs) of windows (text, start, width), those of about the same width together, about WINDOW * 512 characters at a time."""
    by_width: dict[int, list[tuple[int, int, int]]] = {}
    for w in windows:
        by_width.setdefault(WINDOW if w[2] <= WINDOW else 1 << (w[2] - 1).bit_length(), []).append(w)
    for width, some in by_width.items():
        step = max(1, WINDOW * 512 // width)
        for at in range(0, len(some), step):
            part = some[at : at + step]
            x = np.zeros((len(part), max(w for _, _, w in part)), np.int64)
            for r, (d, a, w) in enumerate(part):
                c = classes(texts[d][a : a + w])
                x[r, : len(c)] = c
            for (d, a, w), tags in zip(part, viterbi(model, x.T), strict=True):
                n = min(w, len(texts[d]) - a)
                yield d, a, n, _runs(tags, n)


def _regions(cuts: list[tuple[int, int]], whole: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The cut runs joined where they touch, but for those that a run of a neighbouring window holds whole."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(cuts):
        if any(x <= a and b <= y for x, y in whole):
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(model: Model, texts: list[str], windows: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int, str]]]:
    """By text the runs (minus the depth in their window, start, end, kind) that no window's edge cuts. Where no window holds a run whole, it is read
    again in a window around it, twice as much wider each time, until it is; but only runs with an at sign may be so long."""
    cand: dict[int, list[tuple[int, int, int, str]]] = {}
    margin = WINDOW // 2
    while windows:
        cuts: dict[int, list[tuple[int, int]]] = {}
        for d, a, n, runs in _decoded(model, texts, windows):
            size = len(texts[d])
            for kind, s, e in runs:
                if (s == 0 and a > 0) or (e == n and a + n < size):
                    cuts.setdefault(d, []).append((a + s, a + e))
                else:
                    depth = min(s if a else WINDOW, n - e if a + n < size else WINDOW)
                    cand.setdefault(d, []).append((-depth, a + s, a + e, KINDS[kind]))
        windows = []
        for d, found in cuts.items():
            for a, b in _regions(found, [(x, y) for _, x, y, _ in cand.get(d, [])]):
                lo, hi = max(0, a - margin), min(len(texts[d]), b + margin)
                if _AT.search(texts[d], lo, hi):
                    windows.append((d, lo, hi - lo))
        margin *= 2
    return cand


def find(model: Model, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Per text the patterns' spans, and all spans, each by kind as in KINDS, then by start."""
    half = WINDOW // 2
    base = [patterns(t) for t in texts]
    windows: list[tuple[int, int, int]] = []
    for d, t in enumerate(texts):
        covered = sorted((a, b) for _, a, b in base[d])
        k, grid = 0, set()
        for m in _TRIGGER.finditer(t):
            while k < len(covered) and covered[k][1] <= m.start():
                k += 1
            if k < len(covered) and covered[k][0] <= m.start():
                continue
            g = m.start() // half
            grid |= {g, max(0, g - 1)}
        windows += [(d, g * half, WINDOW) for g in sorted(grid)]
    cand = candidates(model, texts, windows)
    out = []
    for d, t in enumerate(texts):
        spans = list(base[d])
        for _, a, b, kind in sorted(cand.get(d, [])):
            while a < b and t[a] in " \n\t":
                a += 1
            while b > a and t[b - 1] in " \n\t.,":
                b -= 1
            if a >= b or (a and t[a - 1].isalnum()) or (b < len(t) and t[b].isalnum()) or not sound(kind, t[a:b]):
                continue
            if all(b <= x or a >= y for _, x, y in spans):
                spans.append((kind, a, b))
        out.append((base[d], sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def finder(spark: SparkSession, p: Params = Params()):
    """A column function text -> struct(counts of the patterns' spans by kind, base_sha256, spans: all of them)."""
    ship(spark)
    held = spark.sparkContext.broadcast(train(p))

    @F.arrow_udf(RESULT)
    def personal(text: pa.Array) -> pa.Array:
        rows = []
        for at in range(0, len(text), 512):
            rows += find(held.value, [t or "" for t in text.slice(at, 512).to_pylist()])
        counts = [[sum(s[0] == k for s in base) for base, _ in rows] for k in KINDS]
        sha = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows]
        columns = [*(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array([listed(s) for _, s in rows], pa.string())]
        return pa.StructArray.from_arrays(columns, [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return personal

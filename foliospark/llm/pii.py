"""Personal data: fixed patterns, and a character-level BiLSTM-CRF that finds other ways of writing the same kinds.

The network is trained here, in numpy, on windows with labelled spans that a generator writes. A text is tiled
with overlapping windows; each window is decoded by itself and the spans of all windows are then reconciled over
the whole text. Every labelled span holds a digit or an at sign, so a window without one is all outside.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import carried, small_batches

KINDS = ("email", "ip", "card", "phone")
#: Windows of WINDOW code points every STRIDE; a span up to STRIDE long lies whole in some window.
WINDOW, STRIDE = 128, 64
#: A span of the network counts if its tags' least posterior is this, and its own check holds.
CONFIDENCE = 0.9
SEED, TRAIN_WINDOWS, TRAIN_SIZE, EPOCHS, BATCH = 5, 8000, 72, 10, 64
EMBED, HIDDEN, ALPHABET = 12, 28, 131
TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
BIG = 1e4

# ---------------------------------------------------------------- fixed patterns
#: The patterns of the base spans. Where a pattern could rescan a long run from each of its
#: characters, the search below starts at the run's anchor instead and finds the same matches.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@＠]|[\[({] ?at ?[\])}]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each kind's leftmost non-overlapping matches that pass their check; by start, then kind."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), 0))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        digits = only_digits(m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text):
        if 10 <= len(only_digits(m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    return [(s, e, KINDS[k]) for s, e, k in sorted(found, key=lambda x: (x[0], x[2]))]


# ---------------------------------------------------------------- labelled windows
def _word(rng: np.random.Generator) -> str:
    parts = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "en", "es", "ou", "la", "de", "ñ", "é", "ei", "sch", "que")
    return "".join(parts[i] for i in rng.integers(0, len(parts), rng.integers(1, 5)))


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _card(rng: np.random.Generator) -> str:
    digits = _digits(rng, 15)
    return next(digits + str(d) for d in range(10) if luhn(digits + str(d)))


def make_span(rng: np.random.Generator, kind: str) -> str:
    """One way of writing an item of this kind, base form or variant."""
    pick = lambda *options: options[rng.integers(0, len(options))]
    if kind == "email":
        name = pick(_word(rng), f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}{_digits(rng, 2)}", f"{_word(rng)}_{_word(rng)}")
        name = name.replace("ñ", "n").replace("é", "e")
        site, end = _word(rng).replace("ñ", "n").replace("é", "e"), pick("com", "org", "net", "de", "example.com")
        at = pick("@", "@", " @ ", "[at]", " [at] ", "(at)", " (at) ", "＠")
        dot = pick(".", ".", " . ", "[dot]", " [dot] ", "(dot)", " (dot) ") if at not in "@" else "."
        return name + at + site + dot + end.replace(".", dot)
    if kind == "ip":
        parts = [str(n) for n in rng.integers(0, 256, 4)]
        return pick(".", ".", ".", " . ", "[.]").join(parts)
    if kind == "card":
        d = _card(rng)
        sep = pick("", "", " ", "-", ".", "  ", "/")
        return sep.join(d[k : k + 4] for k in range(0, 16, 4))
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return pick(
        f"+1 ({a}) {b}-{c}", f"+{_digits(rng, 2)} {a} {b} {c}", f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}",
        f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"001 {a} {b} {c}", f"+1{a}{b}{c}", f"+1 {a}/{b}-{c}",
    )


def make_decoy(rng: np.random.Generator) -> str:
    """Digits and at signs that are no personal data."""
    pick = lambda *options: options[rng.integers(0, len(options))]
    hexes = "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, rng.integers(16, 41)))
    return pick(
        f'token = "{hexes}"', hexes, f"Version {rng.integers(1, 9)}.{rng.integers(0, 20)}.", f"version {rng.integers(1, 5)}.{rng.integers(0, 20)}.{rng.integers(0, 9)}",
        str(rng.integers(1800, 2100)), f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1900, 2100)}", f"{rng.integers(1900, 2100)}-0{rng.integers(1, 10)}-{rng.integers(10, 29)}",
        f"{rng.integers(1, 999)},{_digits(rng, 3)}", f"${rng.integers(1, 999)}.{_digits(rng, 2)}", f"{rng.integers(1, 24)}:{_digits(rng, 2)}", f"@{_word(rng)}", f"{_word(rng)} @ {rng.integers(1, 99)}",
        _digits(rng, rng.integers(1, 9)), f"{rng.integers(1, 99)}%", f"[{rng.integers(1, 99)}]", f"{_digits(rng, 2)}-{_digits(rng, 3)}", f"id {_digits(rng, 12)}", f"AKIA{_digits(rng, 16)}", f"{_digits(rng, 5)} {_digits(rng, 5)}",
    )


def make_windows(n: int, seed: int, size: int = WINDOW) -> tuple[list[str], list[list[tuple[int, int, str]]]]:
    """Windows of ``size`` code points with labelled spans, cut from a running text of words, items and decoys."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for _ in range(n):
        text, spans, wild = "", [], rng.random() < 0.25
        while len(text) < size + 40:
            r = rng.random()
            if r < 0.16:
                kind = KINDS[rng.integers(0, 4)]
                item = make_span(rng, kind)
                spans.append((len(text), len(text) + len(item), kind))
            elif r < 0.32:
                item = make_decoy(rng)
            else:
                item = _word(rng)
                item = item.upper() if wild and rng.random() < 0.5 else item.capitalize() if r < 0.4 else item
            text += item + (("***", "$$$", "!!", "&&&", "###")[rng.integers(0, 5)] if wild and r > 0.15 else "")
            text += ("\n" if rng.random() < 0.03 else " ") if rng.random() > 0.12 else (", ", ". ", " | ")[rng.integers(0, 3)]
        cut = int(rng.integers(0, 40))
        texts.append(text[cut : cut + size])
        # a span that the window's edge cuts is left unlabelled; its whole lies in a neighbouring window
        labels.append([(s - cut, e - cut, k) for s, e, k in spans if s >= cut and e <= cut + size])
    return texts, labels


# ---------------------------------------------------------------- the network
def encode(texts: list[str], size: int = WINDOW) -> np.ndarray:
    """ids of characters: ASCII as it is, then other letters, anything else, and padding."""
    out = np.full((len(texts), size), ALPHABET - 1, np.int64)
    for row, text in zip(out, texts, strict=True):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        wide = np.flatnonzero(codes > 127)
        for k in wide:
            codes[k] = 128 if text[k].isalpha() else 129
        row[: len(codes)] = codes
    return out


def tags_of(spans: list[tuple[int, int, str]], size: int = WINDOW) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for s, e, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[s] = k
        out[s + 1 : e] = k + 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Lstm:
    """One direction. Arrays are (time, batch, feature)."""

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int):
        self.h = hidden
        self.p = {
            "wx": rng.normal(0, 0.3, (inputs, 4 * hidden)).astype(np.float32),
            "wh": rng.normal(0, 0.2, (hidden, 4 * hidden)).astype(np.float32),
            "b": np.concatenate([np.ones(hidden), np.zeros(3 * hidden)]).astype(np.float32),
        }

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        n, batch, _ = x.shape
        h = c = np.zeros((batch, self.h), np.float32)
        out, saved = np.empty((n, batch, self.h), np.float32), []
        given = x @ self.p["wx"] + self.p["b"]
        H = self.h
        for t in range(n):
            z = given[t] + h @ self.p["wh"]
            gates = _sigmoid(z[:, : 3 * H])
            g = np.tanh(z[:, 3 * H :])
            before, was = c, h
            c = gates[:, :H] * c + gates[:, H : 2 * H] * g
            tc = np.tanh(c)
            h = gates[:, 2 * H :] * tc
            out[t] = h
            if keep:
                saved.append((was, before, gates, g, tc))
        return out, saved

    def backward(self, x: np.ndarray, saved: list, grad: np.ndarray) -> tuple[np.ndarray, dict]:
        n, batch, _ = x.shape
        H = self.h
        dz_all = np.empty((n, batch, 4 * H), np.float32)
        dh, dc = np.zeros((batch, H), np.float32), np.zeros((batch, H), np.float32)
        dwh = np.zeros_like(self.p["wh"])
        for t in range(n - 1, -1, -1):
            was, before, gates, g, tc = saved[t]
            f, i, o = gates[:, :H], gates[:, H : 2 * H], gates[:, 2 * H :]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = dz_all[t]
            dz[:, :H] = dc * before * f * (1 - f)
            dz[:, H : 2 * H] = dc * g * i * (1 - i)
            dz[:, 2 * H : 3 * H] = dh * tc * o * (1 - o)
            dz[:, 3 * H :] = dc * i * (1 - g * g)
            dwh += was.T @ dz
            dh, dc = dz @ self.p["wh"].T, dc * f
        flat = dz_all.reshape(-1, 4 * H)
        return dz_all @ self.p["wx"].T, {"wx": x.reshape(-1, x.shape[2]).T @ flat, "wh": dwh, "b": flat.sum(axis=0)}


class Tagger:
    """BiLSTM emissions, CRF transitions."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.5, (ALPHABET, EMBED)).astype(np.float32)
        self.sides = [Lstm(rng, EMBED, HIDDEN), Lstm(rng, EMBED, HIDDEN)]
        n = len(TAGS)
        self.w = rng.normal(0, 0.3, (2 * HIDDEN, n)).astype(np.float32)
        self.b = np.zeros(n, np.float32)
        self.transitions = np.zeros((n, n), np.float32)
        #: a span continues only its own kind, and a sequence does not start inside one
        self.barred = np.zeros((n, n), bool)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.barred[:, inside] = True
            self.barred[[inside - 1, inside], inside] = False
        self.first = np.where([t.startswith("I") for t in TAGS], -BIG, 0).astype(np.float32)

    def moves(self) -> np.ndarray:
        return np.where(self.barred, np.float32(-BIG), self.transitions)

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(time, batch, tag)."""
        x = self.embedding[ids.T]
        left, _ = self.sides[0].forward(x)
        right, _ = self.sides[1].forward(x[::-1])
        return np.concatenate([left, right[::-1]], axis=2) @ self.w + self.b

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(tag) at each place, the expected count of each move over the batch, and log partitions.

        Forward and backward values are scaled to sum to 1 at each place, so they stay in range for any length.
        """
        n, batch, k = e.shape
        move = np.where(self.barred, np.float32(0), np.exp(self.transitions))
        top = e.max(axis=2, keepdims=True)
        emit = np.exp(e - top)
        emit[0] *= np.exp(self.first)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((n, batch, 1), e.dtype)
        for t in range(n):
            a = emit[t] if t == 0 else (alpha[t - 1] @ move) * emit[t]
            scale[t] = np.maximum(a.sum(axis=1, keepdims=True), 1e-30)
            alpha[t] = a / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = (emit[t + 1] * beta[t + 1]) @ move.T / scale[t + 1]
        ahead = (emit[1:] * beta[1:] / scale[1:]).reshape(-1, k)
        moved = alpha[:-1].reshape(-1, k).T @ ahead * move
        return alpha * beta, moved, (np.log(scale) + top).sum(axis=(0, 2))

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Viterbi path of each sequence, (batch, time)."""
        n, batch, k = e.shape
        moves, value = self.moves(), e[0] + self.first
        back = np.empty((n, batch, k), np.int8)
        for t in range(1, n):
            step = value[:, :, None] + moves
            back[t] = step.argmax(axis=1)
            value = step.max(axis=1) + e[t]
        out = np.empty((batch, n), np.int64)
        out[:, -1] = value.argmax(axis=1)
        for t in range(n - 1, 0, -1):
            out[:, t - 1] = back[t, np.arange(batch), out[:, t]]
        return out

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        """Mean negative log-likelihood of a batch, and (parameter, gradient) pairs."""
        x = self.embedding[ids.T]
        left, saved_left = self.sides[0].forward(x, True)
        right, saved_right = self.sides[1].forward(x[::-1], True)
        hidden = np.concatenate([left, right[::-1]], axis=2)
        e = hidden @ self.w + self.b
        n, batch, k = e.shape
        p, expected, z = self.marginals(e)
        moves, gold = self.moves(), tags.T
        rows = np.arange(batch)
        score = e[0, rows, gold[0]] + self.first[gold[0]]
        observed = np.zeros_like(moves)
        np.add.at(observed, (gold[:-1], gold[1:]), 1)
        score = score + (e[np.arange(1, n)[:, None], rows, gold[1:]] + moves[gold[:-1], gold[1:]]).sum(axis=0)
        de = p.copy()
        de[np.arange(n)[:, None], rows[None, :], gold] -= 1
        de /= batch
        flat = de.reshape(-1, k)
        dhidden = de @ self.w.T
        dleft, g_left = self.sides[0].backward(x, saved_left, dhidden[:, :, :HIDDEN])
        dright, g_right = self.sides[1].backward(x[::-1], saved_right, dhidden[::-1, :, HIDDEN:])
        dembed = np.zeros_like(self.embedding)
        np.add.at(dembed, ids.T, dleft + dright[::-1])
        pairs = [
            (self.w, hidden.reshape(-1, 2 * HIDDEN).T @ flat), (self.b, flat.sum(axis=0)),
            (self.transitions, np.where(self.barred, 0, expected - observed).astype(np.float32) / batch), (self.embedding, dembed),
        ]
        for side, grads in zip(self.sides, (g_left, g_right), strict=True):
            pairs += [(side.p[name], grads[name]) for name in side.p]
        return float((z - score).mean()), pairs


def train(n: int = TRAIN_WINDOWS, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.02) -> Tagger:
    """Adam on batches of labelled windows; the rate falls to a tenth. Deterministic for a seed."""
    texts, labels = make_windows(n, seed, TRAIN_SIZE)
    ids, tags = encode(texts, TRAIN_SIZE), np.array([tags_of(s, TRAIN_SIZE) for s in labels])
    model, rng = Tagger(seed), np.random.default_rng(seed + 1)
    first: dict[int, np.ndarray] = {}
    second: dict[int, np.ndarray] = {}
    step, total = 0, epochs * (n // BATCH)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n - BATCH + 1, BATCH):
            chosen = order[at : at + BATCH]
            _, pairs = model.gradients(ids[chosen], tags[chosen])
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for _, g in pairs))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            lr = rate * (1 - 0.9 * step / total)
            for k, (p, g) in enumerate(pairs):
                g = g * scale
                m = first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                v = second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


@lru_cache(maxsize=1)
def trained() -> Tagger:
    return train()


# ---------------------------------------------------------------- whole texts
def plausible(kind: str, text: str) -> bool:
    """The check of a span that only the network has found."""
    digits = only_digits(text)
    if kind == "email":
        return bool(re.search(r"@|＠|[\[({] ?at ?[\])}]", text, re.I)) and bool(re.search(r"\.|dot", text, re.I)) and text[0].isalnum() and text[-1].isalnum()
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search("[A-Za-z]", text)
    if not re.fullmatch(r"\+?[0-9 ()./-]+", text):
        return False
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and (text[0] in "+(0" or len(re.findall(r"[ ./-]+", text)) >= 2)


def windows_of(text: str) -> list[int]:
    """Starts of the tiling windows that hold an anchor."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    starts = set()
    for m in ANCHOR.finditer(text):
        k = m.start() // STRIDE
        starts.update((min(k, last), min(max(k - 1, 0), last)))
    return [k * STRIDE for k in sorted(starts)]


def decode_windows(model: Tagger, texts: list[str], batch: int = 256) -> list[list[tuple[int, int, str, float]]]:
    """(start, end, kind, least posterior) of the spans of each window."""
    out = []
    for at in range(0, len(texts), batch):
        part = texts[at : at + batch]
        e = model.emissions(encode(part))
        path = model.decode(e)
        posterior = model.marginals(e)[0]
        for row, text in enumerate(part):
            spans, tags, i = [], path[row], 0
            while i < len(text):
                if tags[i] % 2 == 1:
                    j = i + 1
                    while j < len(text) and tags[j] == tags[i] + 1:
                        j += 1
                    p = float(posterior[np.arange(i, j), row, tags[i:j]].min())
                    spans.append((i, j, KINDS[(tags[i] - 1) // 2], p))
                    i = j
                else:
                    i += 1
            out.append(spans)
    return out


def reconcile(text: str, base: list[tuple[int, int, str]], found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    """Base spans, and of the network's those, non-overlapping and clear of base spans, of greatest total posterior.

    A span is counted once however many windows saw it, with its best posterior.
    """
    best: dict[tuple[int, int, str], float] = {}
    for s, e, kind, p in found:
        if p >= CONFIDENCE and plausible(kind, text[s:e]):
            best[s, e, kind] = max(p, best.get((s, e, kind), 0))
    taken = sorted((s, e) for s, e, _ in base)
    begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    free = []
    for (s, e, kind), p in best.items():
        before = bisect_left(begins, e)  # base spans that begin before the end; the furthest of their ends
        if not before or reach[before - 1] <= s:
            free.append((e, s, kind, p))
    free.sort()
    ends = [f[0] for f in free]
    value, choice = [0.0], []
    for e, s, kind, p in free:
        k = int(np.searchsorted(ends, s, "right"))
        take = value[min(k, len(choice))] + p + 1e-6 * (e - s)
        choice.append((take > value[-1], k))
        value.append(max(value[-1], take))
    added, i = [], len(free)
    while i:
        took, k = choice[i - 1]
        if took:
            e, s, kind, _ = free[i - 1]
            added.append((s, e, kind))
            i = min(k, i - 1)
        else:
            i -= 1
    return sorted([*base, *added], key=lambda x: (x[0], KINDS.index(x[2])))


def find_spans(model: Tagger, texts: list[str]) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, all spans) of each text."""
    where, pieces = [], []
    for row, text in enumerate(texts):
        for s in windows_of(text):
            where.append((row, s))
            pieces.append(text[s : s + WINDOW])
    found: dict[int, list[tuple[int, int, str, float]]] = {}
    for (row, s), spans in zip(where, decode_windows(model, pieces), strict=True):
        found.setdefault(row, []).extend((a + s, b + s, kind, p) for a, b, kind, p in spans)
    out = []
    for row, text in enumerate(texts):
        base = base_spans(text)
        out.append((base, reconcile(text, base, found[row]) if row in found else base))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span as <kind>; of overlapping spans the union is replaced, under the first one's kind."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def personal_data(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), clean: bool = False) -> DataFrame:
    """Columns ``carry`` of every document with __fs_base and __fs_spans (kind:start:end joined by commas) and, with
    ``clean``, __fs_text, the text with each span replaced by <kind>.

    A null text is an empty one (and stays null when cleaned). Offsets count code points, ends are exclusive.
    Texts are handled whole, batch by batch, a very long one in windows; repeated rows get a row each and an empty
    table gives an empty result. Of the input only ``carry`` and text are read; names that begin with __fs_ are the
    operator's own, all others may be carried.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(trained())
    send, fields, back = carried(docs, carry)
    extra = ["__fs_base", "__fs_spans", *(["__fs_text"] if clean else [])]
    schema = T.StructType([*fields, *[T.StructField(c, T.StringType()) for c in extra]])
    at = len(carry)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(at).to_pylist()
            found = find_spans(model.value, [t or "" for t in texts])
            columns = [[joined(b) for b, _ in found], [joined(a) for _, a in found]]
            if clean:
                columns.append([None if t is None else redact(t, a) if a else t for t, (_, a) in zip(texts, found, strict=True)])
            yield pa.RecordBatch.from_arrays([*part.columns[:at], *[pa.array(c, pa.string()) for c in columns]], [*[f.name for f in fields], *extra])

    return docs.select(*send, F.col("text").alias("__fs_in")).mapInArrow(batches, schema).select(*back, *extra)

"""Token counts: words, characters / 4, and a script-aware estimate of what a chat model's tokenizer would count."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import count_chars, count_words

#: Fixed value: the published split of this family of tokenizers, with ASCII letters and digits.
PIECES = re.compile(r"'(?i:[sdmt]|ll|ve|re)|[^\r\nA-Za-z0-9]?[A-Za-z]+|[0-9]{1,3}| ?[^\sA-Za-z0-9]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+")
WORD = re.compile(r"[^ \t\n\r\f\v]+")
PUNCT = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
PLAIN = re.compile(rf"[{PUNCT}]*[A-Za-z][a-z]*[{PUNCT}]*")
#: Characters a token, by kind.
PLAIN_CHARS, DENSE_CHARS, WIDE_TOKENS, ASTRAL_TOKENS, FRAME = 4.0, 1.3, 1.15, 6.5, 3


def _piece_cost(piece: str) -> float:
    """A digit group or white space 1; punctuation a third of its length; letters 1 up to seven, then a third each."""
    if piece[-1].isalpha():
        led = not piece[0].isalpha()
        return max(1.0, (len(piece) - led - 4) / 3) + (led and piece[0] not in " '")
    if piece[-1].isdigit():
        return 1.0
    body = piece[0] not in " \t\n\r\f\v" or (len(piece) > 1 and piece[1] not in " \t\n\r\f\v")
    return max(1.0, len(piece) / 3) if body else 1.0


#: Runs that a table of costs keeps, and characters of the longest.
MOST_RUNS, LONG_RUN = 100_000, 40


class _Costs(dict):
    """Costs of runs of visible characters by the run, worked out once. Long runs are not kept, and beyond MOST_RUNS the
    table begins anew, so its size is bounded."""

    def __init__(self, cost: Callable[[str], float]):
        self.cost = cost

    def __missing__(self, run: str) -> float:
        value = self.cost(run)
        if len(run) <= LONG_RUN:
            if len(self) >= MOST_RUNS:
                self.clear()
            self[run] = value
        return value


_word_cost = _Costs(lambda run: max(1, len(run) / PLAIN_CHARS) if PLAIN.fullmatch(run) else len(run) / DENSE_CHARS)
#: Pieces of a run behind a space, and of one that opens a line.
_led_cost = _Costs(lambda run: sum(_piece_cost(p) for p in PIECES.findall(f" {run}")))
_bare_cost = _Costs(lambda run: sum(_piece_cost(p) for p in PIECES.findall(run)))
#: White space other than the blank and the line feed, whose pieces are matched one by one.
ODD_SPACE = re.compile(r"[\t\r\f\v\x1c-\x1f]")
#: Two or more blanks before a visible character.
BLANKS = re.compile(r" {2,}(?=[^ ])")


def _by_run(text: str) -> list[float]:
    """The larger of both estimates of each line of an ASCII text with visible characters, whose white space is blanks
    and line feeds.

    No piece reaches from a visible character over a blank, so a run costs the same wherever it stands; only a stop at
    a line's end takes the line feeds behind it. Of two or more blanks before a run all but the last are a piece, and
    so is what is left of white space up to its last line feed.
    """
    lines = text.split("\n")
    runs = [[w for w in line.split(" ") if w] for line in lines]
    words = [sum(map(_word_cost.__getitem__, r)) for r in runs]
    pieces = [0.0] * len(lines)
    last = len(lines) - 1
    if not runs[0] and last:  # white space opens the text
        first = next((k for k, r in enumerate(runs) if r), last)
        if first:
            pieces[0 if lines[0] else 1] += 1
    for k, r in enumerate(runs):
        if not r:
            continue
        line = lines[k]
        cost = sum(map(_led_cost.__getitem__, r))
        if line[0] != " ":
            cost += _bare_cost[r[0]] - _led_cost[r[0]]
        if "  " in line:
            cost += len(BLANKS.findall(line))
        if line[-1] == " ":
            pieces[k] += cost + 1
            continue
        if k == last:
            pieces[k] += cost
            continue
        follows = k + 1  # the next line with a run, or the last one
        while follows < last and not runs[follows]:
            follows += 1
        if line[-1].isalnum():
            pieces[k] += cost
            pieces[k + 1] += 1
            continue
        taken = 1
        while k + taken < follows and not lines[k + taken]:
            taken += 1
        led = len(r) > 1 or line[0] == " "
        whole = f" {r[-1]}" if led else r[-1]
        cost += sum(_piece_cost(p) for p in PIECES.findall(whole + "\n" * taken)) - (_led_cost if led else _bare_cost)[r[-1]]
        pieces[k] += cost
        if k + taken < follows:
            pieces[k + taken] += 1
    if last and lines[last] and not runs[last]:
        pieces[last] += 1
    return [max(w, p) for w, p in zip(words, pieces, strict=True)]


def _by_match(text: str) -> list[float]:
    """The larger of both estimates of each line of an ASCII text, match by match."""
    by_word: dict[int, float] = {}
    by_piece: dict[int, float] = {}
    breaks = [i for i, c in enumerate(text) if c == "\n"]
    line = 0
    for m in WORD.finditer(text):
        while line < len(breaks) and breaks[line] <= m.start():
            line += 1
        n = len(m[0])
        by_word[line] = by_word.get(line, 0) + (max(1, n / PLAIN_CHARS) if PLAIN.fullmatch(m[0]) else n / DENSE_CHARS)
    line = 0
    for m in PIECES.finditer(text):
        while line < len(breaks) and breaks[line] <= m.start():
            line += 1
        by_piece[line] = by_piece.get(line, 0) + _piece_cost(m[0])
    return [max(by_word.get(k, 0), by_piece.get(k, 0)) for k in {*by_word, *by_piece}]


def estimate_tokens(text: str | None) -> int:
    """Per line the larger of a per-word and a per-piece estimate for ASCII, plus a rate for other scripts, plus 3."""
    if not text or not text.strip(" \t\r\n"):
        return 0
    ascii_text, wide, astral = text, 0, 0
    if not text.isascii():
        ascii_text = text.encode("ascii", "ignore").decode("ascii")
        astral = sum(c >= "\U00010000" for c in text) if max(text) >= "\U00010000" else 0
        wide = len(text) - len(ascii_text) - astral
    matched = ODD_SPACE.search(ascii_text) or not ascii_text.strip(" \n")
    estimate = math.fsum((_by_match if matched else _by_run)(ascii_text))
    return math.ceil(round(estimate + wide * WIDE_TOKENS + astral * ASTRAL_TOKENS, 6)) + FRAME


def estimated_within(text: str, n: int) -> bool:
    """Whether ``estimate_tokens`` is ``n`` at most. A visible character costs a quarter of a token at least, an ASCII one
    a whole one at most, so only texts of about that size are estimated."""
    most = len(text) if text.isascii() else len(text) * (WIDE_TOKENS if max(text) < "\U00010000" else ASTRAL_TOKENS) + 1
    if most + FRAME <= n:
        return True
    if len(text) > PLAIN_CHARS * n:
        seen = len(text) - sum(map(text.count, " \n\t\r\f\v"))
        if seen / PLAIN_CHARS > max(n - FRAME, 0):
            return False
    return estimate_tokens(text) <= n


@F.pandas_udf(T.IntegerType())
def _estimate(texts):
    return texts.map(estimate_tokens).astype("int32")


TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words": count_words,
    "chars": count_chars,
    "heuristic": lambda c: _estimate(F.coalesce(c, F.lit(""))),
}


def register_tokenizer(name: str, count: Callable[[Column], Column]) -> None:
    """A tokenizer is a Column to Column function that counts; the latest registration wins."""
    TOKENIZERS[name] = count


def count_tokens(text: Column, tokenizer: str = "heuristic") -> Column:
    """Tokens of a text; null and blank texts have none, and no count is below 0."""
    return F.greatest(F.coalesce(TOKENIZERS[tokenizer](text), F.lit(0)), F.lit(0)).cast("int")


def register_vocabulary(name: str, path: str) -> None:
    """A tokenizer that counts with a vocabulary file of the tokenizers library; the file's text goes with the function,
    so executors need no file. Texts are counted in batches."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    loaded: dict = {}

    @F.pandas_udf(T.IntegerType())
    def count(texts):
        if not loaded:
            from tokenizers import Tokenizer

            loaded["one"] = Tokenizer.from_str(text)
        return texts.map(lambda t: len(loaded["one"].encode(t, add_special_tokens=False).ids)).astype("int32")

    register_tokenizer(name, lambda c: count(F.coalesce(c, F.lit(""))))


def truncate_text(text: str, n: int, count: Callable[[str], int], marker: str = " [...]", long_unit: int = 16) -> str:
    """The longest prefix of whole words within ``n`` tokens, then the marker, which counts too and is left out where it
    takes half of ``n`` or more. A word over ``long_unit`` tokens is cut by characters."""
    if count(text) <= n:
        return text
    tail = marker if count(marker) < n / 2 else ""
    ends = [m.end() for m in re.finditer(r"\S+", text)]

    def fitting(spots: list[int]) -> int:
        low, high = 0, len(spots)
        while low < high:
            mid = (low + high + 1) // 2
            if count(text[: spots[mid - 1]] + tail) <= n:
                low = mid
            else:
                high = mid - 1
        return spots[low - 1] if low else 0

    end = fitting(ends)
    after = next((m for m in [re.compile(r"\S+").search(text, end)] if m), None)
    if after and count(after[0]) > long_unit:
        end = max(end, fitting(list(range(after.start() + 1, after.end()))))
    return text[:end] + tail


def truncate_tokens(text: Column, n: int, marker: str = " [...]") -> Column:
    """``truncate_text`` by the heuristic count."""

    @F.pandas_udf(T.StringType())
    def cut(texts):
        return texts.map(lambda t: t if t is None else truncate_text(t, n, estimate_tokens, marker))

    return cut(text)

"""Language identification: script ranges narrow the candidates, Viterbi labels spans.

Every word gets a score in each candidate language, the log-likelihood of its character n-grams; the best path
through the words of a text, with a penalty for each change of language, labels its spans.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import held_out, small_batches

#: Documents used for learning, of each language at most (a hash of the id picks them).
SAMPLE = 600
BUCKETS, ORDERS, SMOOTHING = 1 << 16, (1, 2, 3, 4), 0.5
#: Cost of a change of language, in nats; a word can favour a language by WORD_LIMIT nats at most.
SWITCH, WORD_LIMIT = 8.0, 12.0
UNLIKELY = -60.0
#: A script belongs to a language if it has this share of the letters seen in it.
SCRIPT_SHARE = 0.005
SEED = 11

#: Ranges of scripts by first code point, (start, name).
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0E00, "thai"),
    (0x0E80, "lao"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"),
    (0x1780, "khmer"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD800, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "other"), (0x20000, "han"),
    (0x30000, "other"),
]
_STARTS = [s for s, _ in SCRIPTS]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_SCRIPT_INDEX = [SCRIPT_NAMES.index(name) for _, name in SCRIPTS]
_WORD = re.compile(r"[^\W\d_]+")
words_of, all_words = _WORD.finditer, _WORD.findall


def script_of(word: str) -> int:
    """Index of the script of the word's first letter; -1 if it has none."""
    for c in word:
        if c.isalpha():
            return _SCRIPT_INDEX[bisect_right(_STARTS, ord(c)) - 1]
    return -1


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash bucket) of every character n-gram of lower-cased words between boundary marks.

    The words' code points stand in one array; an n-gram's hash is a polynomial of n of them, and those that would
    run across a word's end are left out.
    """
    lowered = [f"<{w.lower()}>" for w in words]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the word's end
    owners, buckets = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in ORDERS:
            mixed = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            inside = left[:m] >= n
            owners.append(owner[:m][inside])
            buckets.append((mixed >> np.uint64(48)).astype(np.int64)[inside])
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(owners), np.concatenate(buckets)


class Model:
    """Scores of words by language, learned from (lang, bucket, n); buckets from BUCKETS on count scripts."""

    def __init__(self, langs: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        self.langs = langs
        counts = np.zeros((BUCKETS + len(SCRIPT_NAMES), len(langs)))
        np.add.at(counts, (bucket, lang), n)
        grams, scripts = counts[:BUCKETS], counts[BUCKETS:]
        self.table = np.log((grams + SMOOTHING) / (grams.sum(axis=0) + SMOOTHING * BUCKETS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=0), 1)
        self.candidates = share >= SCRIPT_SHARE
        self.candidates[~self.candidates.any(axis=1)] = True  # a script that was never seen excludes nobody

    #: Characters whose n-grams are scored together.
    TOGETHER = 1 << 18

    def scores(self, words: list[str], scripts: np.ndarray) -> np.ndarray:
        """(word, language), relative to each word's best candidate."""
        part = np.cumsum([len(w) for w in words]) // self.TOGETHER
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(words)]
        return np.concatenate([self._scores(words[a:b], scripts[a:b]) for a, b in zip(starts, starts[1:], strict=False)])

    def _scores(self, words: list[str], scripts: np.ndarray) -> np.ndarray:
        owner, bucket = buckets_of(words)
        score = np.stack([np.bincount(owner, column[bucket], minlength=len(words)) for column in self.table.T], axis=1) / len(ORDERS)
        able = self.candidates[scripts]
        score = np.where(able, score, -np.inf)
        return np.maximum(score - score.max(axis=1, keepdims=True), np.where(able, -WORD_LIMIT, UNLIKELY)).astype(np.float32)


def viterbi(scores: np.ndarray, ids: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of several sequences at once. ids: rows of ``scores``, sequence after sequence."""
    n_labels = scores.shape[1]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    out = np.zeros(len(ids), np.int16)
    longest = int(size[0]) if len(size) else 0
    if not longest:
        return out
    active = np.searchsorted(-size, -np.arange(longest), "left")
    moved, best_before = np.zeros((len(ids), n_labels), bool), np.zeros(len(ids), np.int16)
    value = scores[ids[begin[: active[0]]]].astype(np.float64)
    final = value.copy()
    for t in range(1, longest):
        a = active[t]
        value = value[:a]
        top = value.argmax(axis=1)
        jump = value[np.arange(a), top] - switch
        at = begin[:a] + t
        better = jump[:, None] > value
        moved[at], best_before[at] = better, top
        value = np.where(better, jump[:, None], value) + scores[ids[at]]
        final[:a] = value
    label = final.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        out[at] = label[:a]
        if t:
            label[:a] = np.where(moved[at, label[:a]], best_before[at], label[:a])
    return out


class Labeller:
    """Labels texts. Word scores are remembered up to a bound; texts are decoded together up to a number of words,
    so that the steps through the longest of them are shared by many."""

    REMEMBER, TOGETHER = 200_000, 1_500_000
    #: The same bounds in characters: of remembered words, of texts held.
    REMEMBER_CHARS, TOGETHER_CHARS = 8 << 20, 16 << 20

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(model.langs)), np.float32)
        self.sizes = np.empty(0, np.int64)
        self.chars = 0

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that have a letter, text after text, and how many each text has."""
        known = self.known
        found = [all_words(t) for t in texts]
        new = list(dict.fromkeys(w for ws in found for w in ws if w not in known))
        self.chars += sum(map(len, new))
        scripts = np.fromiter(map(script_of, new), np.int64, len(new))
        good = [w for w, s in zip(new, scripts, strict=True) if s >= 0]
        known.update(dict.fromkeys((w for w, s in zip(new, scripts, strict=True) if s < 0), -1))
        known.update(zip(good, range(len(self.rows), len(self.rows) + len(good)), strict=True))
        if good:
            self.rows = np.concatenate([self.rows, self.model.scores(good, scripts[scripts >= 0])])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, good), np.int64, len(good))])
        ids = [np.fromiter(map(known.__getitem__, ws), np.int32, len(ws)) for ws in found]
        ids = [i[i >= 0] if len(i) and i.min() < 0 else i for i in ids]
        return (np.concatenate(ids) if ids else np.empty(0, np.int32)), np.fromiter(map(len, ids), np.int64, len(ids))

    def label(self, texts: list[str], ids: np.ndarray, lengths: np.ndarray) -> list[tuple[str, float, str]]:
        """(language, share of the letters in its spans, spans as lang:start:end in code points) of each text."""
        langs, out, at = self.model.langs, [], 0
        labels = viterbi(self.rows, ids, lengths)
        sizes = self.sizes[ids]
        for text, n in zip(texts, lengths, strict=True):
            if not n:
                out.append(("und", 0.0, ""))
                continue
            own = labels[at : at + n]
            letters = np.bincount(own, sizes[at : at + n], minlength=len(langs))
            at += n
            spots = [m.span() for m in words_of(text) if script_of(m[0]) >= 0] if (own != own[0]).any() else ends_of(text)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            last = np.concatenate([first[1:], [n]]) - 1
            spans = ",".join(f"{langs[own[f]]}:{spots[f][0]}:{spots[e if len(spots) == n else -1][1]}" for f, e in zip(first, last, strict=True))
            k = int(letters.argmax())
            out.append((langs[k], float(letters[k] / letters.sum()), spans))
        return out


def ends_of(text: str) -> list[tuple[int, int]]:
    """Spans of the first and the last word with a letter."""
    spans = (m.span() for m in words_of(text) if script_of(m[0]) >= 0)
    first = next(spans)
    last = next(i for i in range(len(text) - 1, -1, -1) if text[i].isalpha())
    while last + 1 < len(text) and all_words(text[last + 1]):
        last += 1  # a number sign inside the word, as in a letter with a superscript
    return [first, (last, last + 1)]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from documents with a language that are not held out, at most about ``sample`` of each language.

    Shares follow from counts over all rows. What comes to the driver is a count per language and bucket, at most
    (BUCKETS + scripts) rows a language.
    """
    usable = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    langs = sorted(counts)
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, sample / counts[k])))]) if langs else None
    if share is None:
        return Model([], *(np.empty(0, np.int64) for _ in range(3)))
    chosen = usable.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            words: Counter = Counter()
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words.update((lang, m[0]) for m in words_of(text))
            for lang in sorted({k for k, _ in words}):
                own = [(w, n) for (k, w), n in words.items() if k == lang]
                times = np.array([n for _, n in own], np.float64)
                owner, bucket = buckets_of([w for w, _ in own])
                scripts = np.fromiter((script_of(w) for w, _ in own), np.int64, len(own))
                letters = np.fromiter((len(w) * n for w, n in own), np.float64, len(own))
                total = np.bincount(bucket, times[owner], minlength=BUCKETS + len(SCRIPT_NAMES))
                total[BUCKETS:] += np.bincount(scripts[scripts >= 0], letters[scripts >= 0], minlength=len(SCRIPT_NAMES))
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(total[used].astype(np.int64))], ["lang", "bucket", "n"]
                )

    learned = chosen.select("text", "lang").mapInArrow(count, "lang string, bucket int, n bigint")
    table = learned.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    index = {k: i for i, k in enumerate(langs)}
    lang = np.array([index[k] for k in table.column("lang").to_pylist()], np.int64)
    return Model(langs, lang, table.column("bucket").to_numpy().astype(np.int64), table.column("n").to_numpy())


def language_spans(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, lang_pred, score, spans of every document, learned from and told by the text alone.

    A text that is null or has no letter is ``und`` with score 0. Ties go to the language that sorts first.
    Repeated rows get a row each. If no row has a language, every text is ``und``. An empty table gives an empty
    result. Only doc_id, text and lang are read, so names of other columns may clash. A very long text is decoded
    whole; a worker holds texts up to a number of words and of characters, whatever their script, and one batch.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "lang_pred", "score", "spans"]
        kinds = [pa.string(), pa.float64(), pa.string()]
        if not model.value.langs:
            for part in parts:
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([v] * n, k) for v, k in zip(("und", 0.0, ""), kinds, strict=True)]], names)
            return
        worker, held = Labeller(model.value), []

        def flush() -> pa.RecordBatch:
            docs_, texts = pa.concat_arrays([h[0] for h in held]), [t for h in held for t in h[1]]
            found = worker.label(texts, np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]))
            held.clear()
            if len(worker.known) > worker.REMEMBER or worker.chars > worker.REMEMBER_CHARS:
                worker.__init__(model.value)
            return pa.RecordBatch.from_arrays([docs_, *[pa.array([f[k] for f in found], kinds[k]) for k in range(3)]], names)

        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            held.append((part.column(0), texts, *worker.ids(texts)))
            if sum(len(h[2]) for h in held) >= worker.TOGETHER or sum(len(t) for h in held for t in h[1]) >= worker.TOGETHER_CHARS:
                yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, "doc_id bigint, lang_pred string, score double, spans string")

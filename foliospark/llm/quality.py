"""Quality scores from pairwise preferences (Bradley-Terry)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import carried, held_out, small_batches

#: Labelled documents used for learning, of each class at most (a hash of the id picks them), and pairs drawn.
SAMPLE, PAIRS = 4000, 60_000
#: A document is good from this score on; the score is scaled so that this is the learned quantile's value.
CUT = 0.7
SEED = 7

FEATURES = (
    "log_bytes upper lower digit space newline pipe bang question dot comma dollar percent ampersand star hash other "
    "high log_words word_length distinct short_line symbol_words upper_words long_words one_char"
).split()
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r",
    "newline": b"\n", "pipe": b"|", "bang": b"!", "question": b"?", "dot": b".", "comma": b",", "dollar": b"$", "percent": b"%",
    "ampersand": b"&", "star": b"*", "hash": b"#",
}


def features(text: str) -> np.ndarray:
    """Shares of byte classes and of word kinds, over the whole text. An empty text is all zeros."""
    out = np.zeros(len(FEATURES))
    raw = text.encode()
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    out[0] = np.log1p(n)
    known = 0
    for k, chars in enumerate(_CLASSES.values(), 1):
        c = counts[list(chars)].sum()
        known += c
        out[k] = c / n
    k = len(_CLASSES) + 1
    high = counts[128:].sum()
    out[k], out[k + 1] = (n - known - high) / n, high / n
    words = text.split()
    if words:
        w = len(words)
        upper = sum(map(str.isupper, words))
        plain = sum(map(str.isalpha, words))
        lengths = np.fromiter(map(len, words), np.int64, w)
        out[k + 2 :] = (
            np.log1p(w), lengths.mean(), len(set(words)) / w, (text.count("\n") + 1) / w, 1 - plain / w, upper / w,
            (lengths > 20).mean(), (lengths == 1).mean(),
        )
    return out


def bradley_terry(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, seed: int = SEED) -> np.ndarray:
    """Weights w that maximise the mean log-likelihood of good beating bad, sigma(w . (x_good - x_bad)), by Newton steps."""
    rng = np.random.default_rng(seed)
    diff = good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]
    w = np.zeros(diff.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        gradient = diff.T @ (1 - p) / len(diff) - l2 * w
        hessian = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + l2 * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1, 2 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


class Scorer:
    """Bradley-Terry worth, scaled so that the learned quantile of it scores CUT."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.fitted = bool(len(y)) and 0 < y.sum() < len(y)
        if not self.fitted:
            return
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = self._standard(x)
        self.w = bradley_terry(z[y == 1], z[y == 0])
        u = z @ self.w
        self.threshold = quantile_threshold(u, y)
        self.width = max(float(np.std(u)), 1e-9) / 2

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), CUT)
        logit = (self._standard(x) @ self.w - self.threshold) / self.width + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def quantile_threshold(u: np.ndarray, y: np.ndarray) -> float:
    """The worth at the quantile, of 0.5 % to 99.5 %, that separates the labels with the best balanced accuracy.

    Labelled examples are weighted by class, so neither class's share in the sample matters; among equally good
    quantiles the middle one is taken.
    """
    levels = np.arange(0.005, 1.0, 0.005)
    cuts = np.quantile(u, levels)
    good, bad = np.sort(u[y == 1]), np.sort(u[y == 0])
    balanced = (1 - np.searchsorted(good, cuts) / len(good)) + np.searchsorted(bad, cuts) / len(bad)
    best = np.flatnonzero(balanced >= balanced.max() - 1e-12)
    return float(cuts[best[len(best) // 2]])


def _featured(docs: DataFrame) -> DataFrame:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = [features(t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    return docs.select("y", "text").mapInArrow(batches, "y int, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Learn from labelled documents that are not held out, at most about ``sample`` of each class.

    A hash of the id picks them; the shares follow from counts over all labels, so the sample's size is bounded by
    the parameter, not by the corpus. Rows with a null id or label are
    left out; an id with several labels counts as the rounded mean.
    """
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in usable.groupBy("y").count().collect()}
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, sample / n))).otherwise(share)
    chosen = usable.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < share * (1 << 30))
    # ids and labels only, about 2 x sample rows at any corpus size; sent back out whole, so no text is shuffled
    few = docs.sparkSession.createDataFrame([(r.doc_id, r.y) for r in chosen.collect()], "doc_id bigint, y int")
    # an id is one document here, however many rows repeat it
    picked = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = _featured(picked.select("y", "text")).collect()
    order = sorted(rows, key=lambda r: (r.y, r.x))
    x = np.array([r.x for r in order]).reshape(len(order), len(FEATURES))
    return Scorer(x, np.array([r.y for r in order], np.int64))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry`` of every document, and score (0 to 1), from the text alone.

    A null text is an empty one. Without labels of both classes every score is CUT, so nothing is rejected.
    Repeated rows are scored each and an empty table gives an empty result. A very long text is read whole. Columns
    that are carried may have any name but one that begins with __fs_; others are not read.
    """
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    send, fields, back = carried(docs, carry)
    names = [*[f.name for f in fields], "__fs_score"]
    at = len(carry)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(at).to_pylist()
            x = np.array([features(t or "") for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(model.value(x))], names)

    schema = T.StructType([*fields, T.StructField("__fs_score", T.DoubleType())])
    return docs.select(*send, F.col("text").alias("__fs_text")).mapInArrow(batches, schema).select(*back, "__fs_score")

"""Screening: decisions, overrides, reference samples, calibration, agreement, flow."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.keys import request_key
from foliospark.sources.files import decode

Z = 1.959963984540054
DECISIONS = ("include", "exclude", "unclear")


def criterion_key(text: Column) -> Column:
    """A criterion without its number, punctuation and case."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"^\s*(?:[(\[]?[0-9]+[.)\]:]?|[-*•])\s*", "")
    return F.trim(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", " "))


def screening_table(replies: DataFrame, exclusion: list[str]) -> DataFrame:
    """Decisions from replies(document, decision, criterion, reason, quote).

    A decision is one of three words or null. An exclusion without a listed criterion becomes unclear.
    """
    listed = F.array(*[criterion_key(F.lit(c)) for c in exclusion])
    said = F.lower(F.trim("decision"))
    decision = F.when(said.isin(*DECISIONS), said)
    valid = F.array_contains(listed, criterion_key(F.col("criterion"))) & (criterion_key(F.col("criterion")) != "")
    checked = F.when(decision == "exclude", F.coalesce(valid, F.lit(False)))
    down = (decision == "exclude") & ~checked
    return replies.select(
        "document",
        F.when(down, "unclear").otherwise(decision).alias("decision"),
        F.when(down, F.concat(F.lit("exclusion without a listed criterion: "), F.coalesce("reason", F.lit("")))).otherwise(F.col("reason")).alias("reason"),
        "criterion",
        checked.alias("criterion_valid"),
        "quote",
    )


def screening_sets(screening: DataFrame) -> DataFrame:
    """(set, document) for included, forward and deferred, duplicates in none."""
    kept = screening.filter(F.col("duplicate_of").isNull()) if "duplicate_of" in screening.columns else screening
    sets = F.filter(
        F.array(
            F.when(F.col("decision") == "include", "included"), F.when(F.col("decision").isin("include", "unclear"), "forward"), F.when(F.col("decision") == "unclear", "deferred"),
        ),
        lambda s: s.isNotNull(),
    )
    return kept.select(F.explode(sets).alias("set"), "document")


def resolve(screening: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Human decisions over the screener's; a decision on a document also holds for its duplicates.

    resolutions(document, human, by, why). The screener's own decision stays in screener_decision.
    """
    root = F.coalesce(F.col("duplicate_of"), F.col("document")) if "duplicate_of" in screening.columns else F.col("document")
    one = resolutions.groupBy("document").agg(F.max_by(F.struct("human", "by", "why"), F.col("human")).alias("r"))
    joined = screening.withColumn("_root", root).join(one.select(F.col("document").alias("_root"), "r"), "_root", "left")
    return joined.select(
        *[c for c in screening.columns if c != "decision"],
        F.coalesce("r.human", "decision").alias("decision"),
        F.when(F.col("r").isNotNull(), F.col("decision")).alias("screener_decision"),
        F.col("r.by").alias("resolved_by"),
        F.col("r.why").alias("resolved_reason"),
    )


def reference_sample(screening: DataFrame, n: int, of: str = "excluded", seed: int = 1) -> DataFrame:
    """n documents of a frame (excluded, kept or all) in the order of a seeded hash, and the frame's size."""
    frames = {"excluded": F.col("decision") == "exclude", "kept": F.col("decision").isin("include", "unclear"), "all": F.col("decision").isNotNull()}
    frame = screening.filter(frames[of])
    size = frame.agg(F.count(F.lit(1)).alias("frame_n"))
    sample = frame.select("document", request_key(F.lit(seed), F.col("document")).alias("_k")).orderBy("_k", "document").limit(n)
    return sample.crossJoin(F.broadcast(size)).select("document", F.lit(of).alias("sampled_from"), "frame_n")  # one row


REFERENCE = "document string, human_decision string, human_note string, sampled_from string, frame_n bigint"


def write_reference_csv(sample: DataFrame, path: str) -> None:
    """A blind sheet of a sample: the screener's decision is not in it, the human's is left empty."""
    blank = F.lit("").alias("human_decision"), F.lit("").alias("human_note")
    sample.select("document", *blank, "sampled_from", "frame_n").coalesce(1).write.option("header", True).csv(path)  # a sheet of a few hundred rows


def read_reference_csv(spark: SparkSession, path: str) -> DataFrame:
    """A sheet that came back: byte order marks, UTF-16, semicolons or tabs, other column order and case are put up with.
    Decisions that are none of the three words are null; rows without a document go."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select("content")
    names = [c.split()[0] for c in REFERENCE.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for content in pdf.content:
                lines = decode(bytes(content)).lstrip("\ufeff").splitlines()
                mark = max(",;\t", key=lines[0].count) if lines else ","
                rows = [{(k or "").strip().lower(): (v or "").strip() for k, v in r.items() if isinstance(v, str)} for r in csv.DictReader(lines, delimiter=mark)]
                yield pd.DataFrame([[r.get(n) or None for n in names] for r in rows], columns=names, dtype=object)

    sheet = raw.mapInPandas(run, ", ".join(f"{n} string" for n in names)).filter("document is not null")
    said = F.lower("human_decision")
    return sheet.select("document", F.when(said.isin(*DECISIONS), said).alias("human_decision"), "human_note", "sampled_from", F.col("frame_n").try_cast("bigint").alias("frame_n"))


def wilson(x: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of a proportion; null where n is 0."""
    p = x / F.nullif(n, F.lit(0))
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    ok = lambda c: F.when(n > 0, c)
    return ok(F.greatest(F.lit(0.0), centre - half)), ok(F.least(F.lit(1.0), centre + half))


def calibrate(screening: DataFrame, reference: DataFrame, positive: str = "include") -> DataFrame:
    """One row a sampling frame: tp, fn, fp, tn with unclear counted as kept, rates with bounds, and loss projected
    to the frame. reference(document, human_decision, sampled_from, frame_n)."""
    joined = reference.join(screening.select("document", "decision"), "document")
    kept, truth = F.col("decision").isin("include", "unclear"), F.col("human_decision") == positive
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    cells = joined.groupBy("sampled_from").agg(
        n(kept & truth).alias("tp"), n(~kept & truth).alias("fn"), n(kept & ~truth).alias("fp"), n(~kept & ~truth).alias("tn"), F.max("frame_n").alias("frame_n"),
    )
    low, high = wilson(F.col("fn"), F.col("fn") + F.col("tn"))
    rate = F.col("fn") / F.nullif(F.col("fn") + F.col("tn"), F.lit(0))
    only = lambda frame, c: F.when(F.col("sampled_from").isin("all", frame), c)
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    return cells.select(
        "sampled_from", "tp", "fn", "fp", "tn", "frame_n",
        F.when(F.col("sampled_from") == "all", ratio("tp", "fn")).alias("sensitivity"),
        F.when(F.col("sampled_from") == "all", ratio("tn", "fp")).alias("specificity"),
        only("kept", ratio("tp", "fp")).alias("precision"),
        only("excluded", rate).alias("false_omission"), only("excluded", low).alias("false_omission_low"), only("excluded", high).alias("false_omission_high"),
        F.when(F.col("sampled_from") == "excluded", F.col("frame_n") * rate).alias("projected_lost"),
    )


def agreement(pairs: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """2 x 2 agreement of two booleans: cells a b c d, agreement, kappa, PABAK, AC1, prevalence, bias, rates."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("double")
    X, Y = F.col(x), F.col(y)
    cells = pairs.filter(X.isNotNull() & Y.isNotNull()).groupBy(*by).agg(n(X & Y).alias("a"), n(X & ~Y).alias("b"), n(~X & Y).alias("c"), n(~X & ~Y).alias("d"))
    a, b, c, d = (F.col(k) for k in "abcd")
    total = a + b + c + d
    po = (a + d) / total
    pe = ((a + b) * (a + c) + (c + d) * (b + d)) / (total * total)
    pi = ((a + b) + (a + c)) / (2 * total)
    pg = 2 * pi * (1 - pi)
    div = lambda p, q: p / F.nullif(q, F.lit(0.0))
    return cells.select(
        *by, "a", "b", "c", "d", po.alias("po"), div(po - pe, 1 - pe).alias("kappa"), (2 * po - 1).alias("pabak"), div(po - pg, 1 - pg).alias("ac1"),
        ((a - d) / total).alias("prevalence"), ((b - c) / total).alias("bias"), (F.abs((a - d) / total) > 0.8).alias("paradox"),
        div(a, a + c).alias("sensitivity"), div(d, b + d).alias("specificity"), div(a, a + b).alias("ppv"), div(d, c + d).alias("npv"),
    )


def kappa_interval(a: int, b: int, c: int, d: int, draws: int = 2000, seed: int = 19930501) -> tuple[float, float] | None:
    """Percentile interval of kappa over multinomial redraws of the four cells; none for small or degenerate tables."""
    n = a + b + c + d
    if n < 10 or b + c == 0 or a + d == 0:
        return None
    t = np.random.default_rng(seed).multinomial(n, np.array([a, b, c, d]) / n, draws).astype(float)
    po = (t[:, 0] + t[:, 3]) / n
    pe = ((t[:, 0] + t[:, 1]) * (t[:, 0] + t[:, 2]) + (t[:, 2] + t[:, 3]) * (t[:, 1] + t[:, 3])) / n**2
    k = (po - pe)[pe < 1] / (1 - pe[pe < 1])
    low, high = np.quantile(k, [0.025, 0.975])
    return float(low), float(high)


def flow(*stages: tuple[str, DataFrame, Column]) -> DataFrame:
    """(stage, n): how many rows of a frame meet a condition, stage by stage."""
    out = None
    for k, (name, df, condition) in enumerate(stages, 1):
        one = df.agg(F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("bigint").alias("n")).select(F.lit(k).alias("step"), F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out

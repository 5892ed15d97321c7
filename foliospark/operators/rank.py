"""Ranking: vectors, BM25, top-k, maximal marginal relevance, budgeted selection, context order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import lexical_terms
from foliospark.session import cut

K1, B = 1.5, 0.75
DIMENSIONS = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of one length; 0 where a norm is 0 or not finite; an error where lengths differ."""
    same = F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("boolean"))
    value = dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.when(same, F.when(F.isnan(value) | value.isNull(), 0.0).otherwise(value))


def lexical_vector(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Hashed bag of terms of at least three characters: 1 + ln(count) a slot, unit length."""
    slots = F.transform(lexical_terms(text, 3), lambda t: F.pmod(F.xxhash64(t), F.lit(dimensions)).cast("int"))
    bind = lambda value, run: F.transform(F.array(value), run)[0]  # noqa: E731  evaluates the value once

    def weigh(s: Column) -> Column:
        count = lambda i: F.size(F.filter(s, lambda x: x == i))
        return F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: bind(count(i), lambda n: F.when(n > 0, 1 + F.log(n.cast("double"))).otherwise(0.0)))

    return bind(bind(slots, weigh), lambda w: bind(norm(w), lambda z: F.when(z > 0, F.transform(w, lambda x: x / z)).otherwise(w)))


#: name -> Column of texts to Column of vectors; registering a name again replaces it.
EMBEDDERS = {"lexical": lexical_vector}


def embed(df: DataFrame, text: str, out: str, embedder: str = "lexical", fallback: str | None = "lexical") -> DataFrame:
    """Add ``out`` and ``embedding_source``. A vector that is null, ragged or not finite is replaced by the fallback's,
    flagged as such; without a fallback it is an error."""
    made = df.withColumn("_v", EMBEDDERS[embedder](F.col(text)))
    bad = F.col("_v").isNull() | (F.size("_v") == 0) | F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    other = EMBEDDERS[fallback](F.col(text)) if fallback else F.raise_error(F.lit("a vector is not finite")).cast("array<double>")
    return made.select(*df.columns, F.when(bad, other).otherwise(F.col("_v")).alias(out), F.when(bad, F.lit(fallback)).otherwise(F.lit(embedder)).alias("embedding_source"))


def lexical_embed(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """Sparse form for corpora: (key, slot, weight), from partial counts; unit length per key."""
    terms = df.select(key, F.explode(lexical_terms(F.col(text), 3)).alias("term"))
    slots = terms.groupBy(key, F.pmod(F.xxhash64("term"), F.lit(dimensions)).cast("int").alias("slot")).agg((1 + F.log(F.count(F.lit(1)))).alias("w"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return slots.select(key, "slot", (F.col("w") / size).alias("weight"))


def times(terms: str, word: str) -> Column:
    """How often a word stands in an array of terms."""
    return F.size(F.filter(terms, lambda t: t == F.lit(word)))


def bm25(df: DataFrame, key: str, text: str, query_terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of every row. N counts all rows, the mean length those that have terms.

    Query terms are a handful of literals, so term counts are taken inside each row: one narrow pass over the
    text, one one-row aggregate, no shuffle of terms.
    """
    wanted = sorted(set(query_terms))
    terms = lexical_terms(F.col(text), 2)
    counts = F.array(*[times("hits", w) for w in wanted]) if wanted else F.expr("cast(array() as array<int>)")
    # the few terms that the question has are picked in one pass, then told apart; what is written, once, is a few
    # integers a row: the texts are not read again for the scores
    picked = df.select(key, terms.alias("terms")).select(key, F.size("terms").alias("len"), F.filter("terms", lambda t: t.isin(wanted)).alias("hits"))
    rows = cut(picked.select(key, "len", counts.alias("f")))
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.when(F.col("len") > 0, F.col("len"))), F.lit(1.0)).alias("avg"),
        *[F.sum(F.when(F.col("f")[i] > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(wanted))],
    )
    joined = rows.crossJoin(F.broadcast(stats))  # one row of corpus totals
    score = F.lit(0.0)
    for i in range(len(wanted)):
        n_q, f = F.col(f"df{i}"), F.col("f")[i]
        idf = F.log(1 + (F.col("n") - n_q + 0.5) / (n_q + 0.5))
        score = score + idf * (f * (k1 + 1)) / (f + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    return joined.select(key, F.when(F.col("len") > 0, score).otherwise(0.0).alias("score"))


def scale01(df: DataFrame, column: str, out: str, *by: str) -> DataFrame:
    """Min-max over the group; a constant column is 0.5."""
    stats = df.groupBy(*by).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    joined = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))
    span = F.col("_hi") - F.col("_lo")
    return joined.withColumn(out, F.when(span > 0, (F.col(column) - F.col("_lo")) / span).otherwise(0.5)).drop("_lo", "_hi")


def top_k(df: DataFrame, k: int, score: str, tie: str, *by: str) -> DataFrame:
    """The k best with their rank; equal scores keep the order of ``tie``."""
    if by:
        w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), F.asc(tie))
        return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    best = df.orderBy(F.desc_nulls_last(score), F.asc(tie)).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(score), F.asc(tie))))


def mmr_order(relevance: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Greedy weight * relevance - (1 - weight) * greatest similarity to what is chosen; first index wins ties."""
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.where((size > 0) & np.isfinite(size), vectors / np.where(size > 0, size, 1), 0)
    value = np.where(np.isfinite(relevance), relevance, -np.inf)
    nearest = np.full(len(value), -np.inf)
    out: list[int] = []
    open_ = np.isfinite(value)
    while len(out) < k and open_.any():
        gain = value if not out or weight >= 1 else weight * value - (1 - weight) * nearest
        best = int(np.argmax(np.where(open_, gain, -np.inf)))
        out.append(best)
        open_[best] = False
        nearest = np.maximum(nearest, unit @ unit[best])
    return out


def mmr(df: DataFrame, key: str, score: str, vector: str, k: int, weight: float, by: str, pool: int | None = None) -> DataFrame:
    """(by, key, score, position) of the k chosen of each group, the smaller key winning ties, as mmr_order does.

    Each round is one aggregate over all rows beside the few vectors already chosen in their group, so no task holds
    a group. ``pool`` restricts the choice to that many most relevant rows of each group. A key stands once in a group.
    """
    rows = df.select(by, key, F.col(score).cast("double").alias("_s"), F.col(vector).cast("array<double>").alias("_v"))
    rows = rows.filter(F.col("_s").isNotNull() & ~F.isnan("_s") & (F.abs("_s") != float("inf")))
    if pool is not None:
        rows = top_k(rows, pool, "_s", key, by).drop("rank")
    rows, kinds, chosen, out = cut(rows), dict(df.dtypes), None, None
    for n in range(1, k + 1):
        if chosen is None:
            gain, left = F.col("_s"), rows
        else:
            left = rows.join(chosen, F.col(by).eqNullSafe(F.col("_by"))).filter(~F.array_contains("_keys", F.col(key)))
            nearest = F.array_max(F.transform("_near", lambda c: cosine(F.col("_v"), c)))
            gain = F.col("_s") if weight >= 1 else weight * F.col("_s") - (1 - weight) * nearest
        best = left.groupBy(by).agg(F.min_by(F.struct(key, "_s", "_v"), F.struct((-gain).alias("g"), F.col(key).alias("k"))).alias("b"))
        best = best.select(by, F.col(f"b.{key}").alias(key), F.col("b._s").alias("_s"), F.col("b._v").alias("_v"), F.lit(n).alias("position"))
        out = cut(best if out is None else out.unionByName(best))
        chosen = out.groupBy(F.col(by).alias("_by")).agg(F.collect_list(key).alias("_keys"), F.collect_list("_v").alias("_near"))
    return out.select(F.col(by).cast(kinds[by]), F.col(key).cast(kinds[key]), F.col("_s").alias(score), "position")


def arrange(df: DataFrame, how: str, rank: str = "rank", order: str = "chunk_id", *by: str) -> DataFrame:
    """Add ``position``: by relevance, by place in the document, or with the best at both edges."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    edge = F.when(n < 3, F.col(rank)).otherwise(F.when(F.col(rank) % 2 == 1, F.col(rank)).otherwise(2 * n + 2 - F.col(rank)))
    keys = {"relevance": F.col(rank), "document": F.col(order), "edges": edge}
    keyed = df.withColumn("_k", keys[how])
    return keyed.withColumn("position", F.row_number().over(w.orderBy("_k"))).drop("_k")


def fit_prefix(df: DataFrame, budget: int, cost: str, order: str, *by: str) -> DataFrame:
    """Rows, in order, while their running cost is within the budget."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(cost).over(w)).filter(F.col("running") <= budget)


def fit_skip(df: DataFrame, budget: int, cost: str, order: str, key: str, *by: str) -> DataFrame:
    """(by, key) of the rows a greedy fill takes: what does not fit is skipped and the fill goes on."""
    lists = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("bigint").alias("c"), F.col(key).alias("k")))).alias("us"))
    kind = dict(df.dtypes)[key]
    fold = F.expr(
        f"aggregate(us, named_struct('t', 0L, 'o', cast(array() as array<{kind}>)),"
        f" (s, x) -> if(s.t + x.c <= {budget}, named_struct('t', s.t + x.c, 'o', concat(s.o, array(x.k))), s), s -> s.o)"
    )
    return lists.select(*by, F.explode(fold).alias(key))


def global_rank(df: DataFrame, out: str, *order: str | Column) -> DataFrame:
    """Add ``out``: the place of a row in the whole order, from 1, without one task that sees all rows.

    Rows are dealt out by ranges of the order and written once; places inside a range follow those of the ranges
    before it, whose counts (one a range) are all that a single window sees. Rows that tie in every key are placed in
    an order of Spark's choosing.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_range", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    ranked = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_range").orderBy(*keys))).join(before, "_range")
    return ranked.withColumn(out, F.col("_k") + F.col("_before")).drop("_range", "_k", "_before")


def rerank_prefilter(df: DataFrame, m: int, score: str, order: str) -> DataFrame:
    """The m best by score; if nothing scores, m rows spread evenly over the order."""
    rows = cut(df)
    n, top = rows.agg(F.count(F.lit(1)), F.max(score)).first()  # one row
    if top is not None and top > 0:
        return top_k(rows, m, score, order).drop("rank")
    spots = sorted({int(np.ceil((i - 0.5) * n / m)) for i in range(1, m + 1)})
    return global_rank(rows, "_row", order).filter(F.col("_row").isin(spots)).drop("_row")

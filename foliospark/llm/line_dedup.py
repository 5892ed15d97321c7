"""Line dedup by content-defined line chunks (native).

A rolling hash over the hashes of the last few lines decides where a chunk ends, so the same passage is cut at
the same places wherever it stands. A chunk of several lines that occurs again anywhere in the corpus keeps its
first occurrence and loses the others, after its bytes were compared. Chunk ends are too sparse for passages of a few
lines; line_runs takes out every repeated run of two lines or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import cut

#: Lines under the rolling hash; one window in DIVISOR ends a chunk; chunks of fewer lines are left alone.
WINDOW, DIVISOR, MIN_LINES = 2, 3, 2
BASE = 31


def _digest(body: Column) -> Column:
    return F.md5(body)


def _line_hash(line: Column) -> Column:
    """32 bits of the line's md5, as a bigint."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def with_chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, text key, and ``chunks``: array of (idx, first, n, body) that joins back to the text."""
    rolled = "+".join(f"{BASE ** k} * if(i >= {k}, h[i - {k}], 0)" for k in range(window))
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
        .withColumn("key", F.md5("body"))
        .withColumn("lines", F.split("body", "\n", -1))
        .withColumn("h", F.transform("lines", _line_hash))
        .withColumn("ends", F.expr(f"filter(sequence(0, size(h) - 1), i -> i = size(h) - 1 or ({rolled}) % {divisor} = 0)"))
        .withColumn(
            "chunks",
            F.expr(
                "transform(ends, (e, j) -> named_struct('idx', j, 'first', if(j = 0, 0, ends[j - 1] + 1),"
                " 'n', e - if(j = 0, -1, ends[j - 1]),"
                " 'body', array_join(slice(lines, if(j = 0, 0, ends[j - 1] + 1) + 1, e - if(j = 0, -1, ends[j - 1])), '\n')))"
            ),
        )
        .select("doc_id", "key", F.size("lines").alias("n_lines"), F.size("chunks").alias("n_chunks"), "chunks")
    )


def repeated_chunks(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, key, idx, n) of each occurrence to remove.

    Chunks are grouped by digest and by their own bytes, partly before the shuffle, so a chunk that a third of
    all documents hold arrives as one row per task. Were one digest to stand for two different texts, places would be
    looked up by the texts themselves.
    """
    # outer: a filter inferred from explode would be pushed below the projections and inline them into lambdas
    chunk = with_chunks(docs, window, divisor).select("doc_id", "key", F.explode_outer("chunks").alias("c"))
    chunk = chunk.filter((F.col("c.n") >= min_lines) & F.col("c.body").rlike(r"\S"))
    chunk = chunk.select("doc_id", "key", "c.idx", "c.n", _digest(F.col("c.body")).alias("digest"), "c.body")
    place = F.struct("doc_id", "idx")
    by_bytes = chunk.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first"))
    seen = by_bytes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("times").alias("times"), F.min("first").alias("first"))
    seen = cut(seen.filter("texts > 1 or times > 1"))
    if seen.filter("texts > 1").limit(1).count():
        places = chunk.join(by_bytes.filter("times > 1").select("digest", "body", "first"), ["digest", "body"])
    else:
        places = chunk.select("doc_id", "key", "idx", "n", "digest").join(seen.select("digest", "first"), "digest")
    return places.filter(~F.struct("doc_id", "idx").eqNullSafe(F.col("first"))).select("doc_id", "key", "idx", "n")


def line_dedup(docs: DataFrame, window: int = WINDOW, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """The input's columns with ``text`` cleaned, and __fs_lines, __fs_chunks, __fs_removed (lines taken out).

    The first occurrence is the one with the smallest (doc_id, chunk number), nulls first. Null text counts as
    empty and stays null; blank chunks stay. Rows that repeat doc_id and text are treated alike. An empty table
    gives an empty result. Columns of other names pass through untouched, those of this module's results too; only
    names that begin with __fs_ are its own. A very long text takes time in proportion to its length.
    """
    removed = repeated_chunks(docs, window, divisor, min_lines)
    gone = removed.groupBy("doc_id", "key").agg(F.collect_set("idx").alias("__fs_gone"))
    joined = docs.withColumn("__fs_key", F.md5(F.coalesce("text", F.lit(""))))
    gone = gone.select(F.col("doc_id").alias("__fs_id"), F.col("key").alias("__fs_key2"), "__fs_gone")
    joined = joined.join(
        gone, F.col("doc_id").eqNullSafe(F.col("__fs_id")) & (F.col("__fs_key") == F.col("__fs_key2")), "left"
    )
    return _apply(joined, docs.columns, window, divisor)


def _apply(joined: DataFrame, columns: list[str], window: int, divisor: int) -> DataFrame:
    """Cut the chunks of each text again, beside the list of those to drop, and join the rest."""
    rolled = "+".join(f"{BASE ** k} * if(i >= {k}, __fs_h[i - {k}], 0)" for k in range(window))
    out = (
        joined.withColumn("__fs_l", F.split(F.coalesce("text", F.lit("")), "\n", -1))
        .withColumn("__fs_h", F.transform("__fs_l", _line_hash))
        .withColumn(
            "__fs_ends",
            F.expr(f"filter(sequence(0, size(__fs_h) - 1), i -> i = size(__fs_h) - 1 or ({rolled}) % {divisor} = 0)"),
        )
        .withColumn(
            "__fs_kept",
            F.expr(
                "flatten(transform(array_except(sequence(0, size(__fs_ends) - 1), coalesce(__fs_gone, cast(array() as array<int>))),"
                " j -> slice(__fs_l, if(j = 0, 0, __fs_ends[j - 1] + 1) + 1, __fs_ends[j] - if(j = 0, -1, __fs_ends[j - 1]))))"
            ),
        )
    )
    untouched = F.col("__fs_gone").isNull()
    return out.select(
        *[
            F.when(untouched, F.col("text")).otherwise(F.array_join("__fs_kept", "\n")).alias("text") if c == "text" else F.col(f"`{c}`")
            for c in columns
        ],
        F.size("__fs_l").alias("__fs_lines"),
        F.size("__fs_ends").alias("__fs_chunks"),
        (F.size("__fs_l") - F.size("__fs_kept")).alias("__fs_removed"),
    )


def _pairs(docs: DataFrame) -> DataFrame:
    """doc_id, key, ``lines``, ``at`` (numbers of the lines that are not blank) and ``h`` (md5 of every line). The key
    tells the texts of one id apart, so 64 bits do."""
    return (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
        .withColumn("key", F.xxhash64("body"))
        .withColumn("lines", F.split("body", "\n", -1))
        .withColumn("at", F.expr(r"filter(sequence(0, size(lines) - 1), i -> lines[i] rlike '\\S')"))
        .withColumn("h", F.expr("transform(at, i -> unhex(md5(lines[i])))"))
    )


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, gone) of each text that loses lines; gone has their numbers.

    The unit is a line and the next one that is not blank, so every repeated run of two lines or more is met
    whole, wherever it starts. Pairs are keyed by the digests of their two lines; a digest that two different
    lines share, by their bytes, removes nothing. Pairs are folded before the shuffle as chunks are.
    """
    lined = _pairs(docs)
    line = lined.select(F.explode_outer("lines").alias("line")).filter(F.col("line").rlike(r"\S"))
    shared = line.select(F.unhex(F.md5("line")).alias("h"), "line").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    pair = lined.select(
        "doc_id", "key", F.explode_outer(F.expr("if(size(at) > 1, transform(sequence(0, size(at) - 2), j -> named_struct('lo', at[j], 'hi', at[j + 1], 'a', h[j], 'b', h[j + 1])), null)")).alias("p"),
    ).filter("p is not null").select("doc_id", "key", "p.*")
    repeated = pair.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc_id", "lo", "hi", "key")).alias("first")).filter("times > 1").drop("times")
    for side in ("a", "b"):
        repeated = repeated.join(shared.select(F.col("h").alias(side)), side, "left_anti")
    later = pair.join(repeated, ["a", "b"]).filter(~F.struct("doc_id", "lo", "hi", "key").eqNullSafe(F.col("first")))
    # a line said three times over: the second still belongs to the first pair
    inside = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("lo") == F.col("first.hi"))
    later = later.select("doc_id", "key", F.sequence(F.when(inside, F.col("lo") + 1).otherwise(F.col("lo")), F.col("hi")).alias("span"))
    return later.groupBy("doc_id", "key").agg(F.array_distinct(F.flatten(F.collect_list("span"))).alias("gone"))


def line_runs(docs: DataFrame) -> DataFrame:
    """The input's columns with ``text`` cleaned, and __fs_lines, __fs_removed (lines taken out).

    A line goes if it stands in a run of two lines or more (blank ones aside) that an earlier place has; blank
    lines inside the run go with it. Places are ordered by (doc_id, line), nulls first. The first place of any
    line is never taken out, so no line is lost altogether. Null text counts as empty and stays null; rows that
    repeat doc_id and text are treated alike; columns of other names pass through untouched; an empty table gives an
    empty result. A very long text takes time in proportion to its length.
    """
    gone = repeated_lines(docs).select(F.col("doc_id").alias("__fs_id"), F.col("key").alias("__fs_key2"), F.col("gone").alias("__fs_gone"))
    joined = docs.withColumn("__fs_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = joined.join(gone, F.col("doc_id").eqNullSafe(F.col("__fs_id")) & (F.col("__fs_key") == F.col("__fs_key2")), "left")
    lined = joined.withColumn("__fs_l", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    kept = F.expr("transform(array_except(sequence(0, size(__fs_l) - 1), __fs_gone), i -> __fs_l[i])")
    text = F.when(F.col("__fs_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return lined.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.size("__fs_l").alias("__fs_lines"), F.coalesce(F.size("__fs_gone"), F.lit(0)).alias("__fs_removed"),
    )

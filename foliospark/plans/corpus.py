"""Corpus plans: read many documents under ceilings, a keyed store, recipe comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions.keys import request_key
from foliospark.operators.model import Client
from foliospark.operators.rank import global_rank
from foliospark.plans.readers import READERS, RECIPES, Recipe, answer_documents, chunked, expected_calls, read
from foliospark.session import cut


def content_key(text: Column, recipe: str, question: str) -> Column:
    """Key of a document's answer: its content and everything that decides the answer."""
    return request_key(F.sha2(text, 256), F.lit(recipe), F.lit(question))


def duplicates_of(docs: DataFrame, key: str, text: str | Column) -> DataFrame:
    """(key, duplicate_of): the smallest key with the same text, null for that one. Texts are hashed once, and keys
    and hashes are all that is shuffled."""
    body = F.col(text) if isinstance(text, str) else text
    hashed = cut(docs.select(key, F.unhex(F.sha2(F.coalesce(body, F.lit("")), 256)).alias("_h")))
    first = hashed.groupBy("_h").agg(F.min(key).alias("_first"))
    return hashed.join(first, "_h").select(key, F.when(F.col(key) != F.col("_first"), F.col("_first")).alias("duplicate_of"))


def mark_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Add ``duplicate_of``; ``key`` names one row."""
    return docs.join(duplicates_of(docs, key, text), key)


def plan_statuses(docs: DataFrame, key: str, calls: str, max_calls: int, stored: DataFrame | None = None) -> DataFrame:
    """Add ``status``: duplicate, restored, ok while running calls stay within the ceiling, else skipped.

    docs has duplicate_of and the expected calls. The running sum is taken in two steps, inside ranges of the key and
    over the ranges' totals, so no task sees all documents.
    """
    known = F.lit(False)
    if stored is not None:
        docs = docs.join(stored.select(key).distinct().withColumn("_stored", F.lit(True)), key, "left")
        known = F.coalesce("_stored", F.lit(False))
    first = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(known, "restored")
    paid = docs.withColumn("_status", first).withColumn("_cost", F.when(first.isNull(), F.col(calls)).otherwise(0)).withColumn("_range", F.floor(F.col(key) / 4096))
    totals = paid.groupBy("_range").agg(F.sum("_cost").alias("_sum"))
    before = totals.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("_cost").over(Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    run = paid.withColumn("_run", inside).join(before, "_range").withColumn("running_calls", F.col("_run") + F.col("_before"))
    status = F.coalesce("_status", F.when(F.col("running_calls") <= max_calls, "ok").otherwise("skipped"))
    return run.withColumn("status", status).select(*[c for c in docs.columns if c != "_stored"], "running_calls", "status")


def read_many(
    blocks: DataFrame, question: str, client: Client, recipe: str | Recipe, store: str | None = None, max_calls: int | None = None,
) -> DataFrame:
    """Answers of every document, equal documents read once, stored answers restored, new ones stored.

    blocks(document, block_id, text). The store is Parquet keyed by content, recipe and question; appending a key
    twice is harmless, since reads take one row a key. With ``max_calls`` documents are read in order of their names
    while the calls that their reader is expected to make stay within it; the rest is ``skipped`` and left for a later
    run. Other statuses: ok, restored, duplicate, failed (no answer came, or only lost calls).
    """
    spark = blocks.sparkSession
    name = recipe if isinstance(recipe, str) else repr(recipe)
    bodies = blocks.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    keyed = cut(bodies.select("document", content_key(F.col("text"), name, question).alias("key")))
    first = keyed.groupBy("key").agg(F.min("document").alias("reader_of"))
    keyed = keyed.join(first, "key")
    kept = _stored(spark, store)
    todo = first if kept is None else first.join(kept.select("key"), "key", "left_anti")
    work = blocks.join(todo.select(F.col("reader_of").alias("document")), "document", "left_semi")
    if max_calls is None:
        fresh = answer_documents(work, question, client, recipe)
    else:
        r = RECIPES[recipe] if isinstance(recipe, str) else recipe
        chunks = chunked(work, r)
        sizes = chunks.groupBy("document").agg(F.count(F.lit(1)).alias("n")).withColumn("expected", expected_calls(r.read.reader, "n", r.read))
        planned = plan_statuses(global_rank(sizes, "_n", "document").withColumn("duplicate_of", F.lit(None).cast("string")), "_n", "expected", max_calls)
        within = cut(planned.filter("status = 'ok'").select("document"))
        todo = todo.join(within.withColumnRenamed("document", "reader_of"), "reader_of", "left_semi").select("key", "reader_of")
        fresh = read(chunks.join(within, "document", "left_semi"), question, client, r.read)
    fresh = fresh.drop("notes").join(todo.withColumnRenamed("reader_of", "document"), "document").drop("document")
    if store is not None:
        fresh.write.mode("append").parquet(store)
        found = _stored(spark, store)
    else:
        found = cut(fresh)
    restored = kept.select("key", F.lit(True).alias("_old")) if kept is not None else keyed.select("key", F.lit(True).alias("_old")).limit(0)
    out = keyed.join(found, "key", "left").join(restored, "key", "left")
    failed = F.col("not_found") & F.col("partial") & (F.size("chunks_used") == 0)
    status = (
        F.when(F.col("answer").isNull(), "skipped" if max_calls is not None else "failed").when(F.col("document") != F.col("reader_of"), "duplicate")
        .when(F.col("_old"), "restored").when(failed, "failed").otherwise("ok")
    )
    return out.select("document", "answer", "not_found", "partial", "chunks_used", "calls", status.alias("status"), F.when(F.col("document") != F.col("reader_of"), F.col("reader_of")).alias("duplicate_of"))


def _stored(spark: SparkSession, store: str | None) -> DataFrame | None:
    if store is None:
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(store).dropDuplicates(["key"])


def distinct_recipes(names: list[str]) -> dict[str, list[str]]:
    """Recipes that would run the same plan under one name: clean, segment, limits, signature and settings."""
    out: dict[tuple, list[str]] = {}
    for n in names:
        r = RECIPES[n]
        out.setdefault((r.clean, r.segment, r.max_tokens, r.overlap, READERS[r.read.reader][1], repr(r.read)), []).append(n)
    return {group[0]: group for group in out.values()}


def compare(blocks: DataFrame, question: str, client: Client, names: list[str], correct: Column | None = None) -> DataFrame:
    """A row a recipe: documents, calls, answers found and, with ``correct`` over answer, right ones and calls a right one."""
    rows = None
    for name in distinct_recipes(names):
        one = answer_documents(blocks, question, client, name).withColumn("recipe", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    right = F.coalesce(correct, F.lit(False)) if correct is not None else F.lit(None).cast("boolean")
    sums = rows.groupBy("recipe").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("calls").alias("calls"), F.sum((~F.col("not_found")).cast("int")).alias("found"), F.sum(right.cast("int")).alias("correct"),
    )
    return sums.withColumn("calls_per_correct", F.col("calls") / F.nullif(F.col("correct"), F.lit(0)))

"""Runs over many documents: screening and extraction, from blocks to a table with evidence and a status a document.

Documents with the same text are read once; the others take the result of the first, with status ``duplicate``. A lost
or unreadable reply is a status, never a failed run. Where a Desk is the client, its limits and cache hold for the run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.operators import extract as X
from foliospark.operators.model import Client
from foliospark.operators.screen import screening_table
from foliospark.operators.verify import contains_quote
from foliospark.plans.corpus import duplicates_of
from foliospark.plans.readers import RECIPES, Recipe, chunked, fill_fields, screened_openings
from foliospark.session import cut


def roots(blocks: DataFrame) -> DataFrame:
    """(document, root): the first document with the same blocks; its own name for that one."""
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("block_id", "text"))), lambda x: x["text"]))
    bodies = blocks.groupBy("document").agg(body.alias("body"))
    return duplicates_of(bodies, "document", "body").select("document", F.coalesce("duplicate_of", "document").alias("root"))


def _with_duplicates(rows: DataFrame, placed: DataFrame, status: Column) -> DataFrame:
    """A row of ``rows`` for each document of its root; duplicates keep what was found, under their own status."""
    own = rows.withColumn("status", status).withColumnRenamed("document", "root")
    twin = F.col("document") != F.col("root")
    return placed.join(own, "root", "left").select(
        "document", *[c for c in own.columns if c not in ("root", "status")], F.when(twin, "duplicate").otherwise(F.col("status")).alias("status"), F.when(twin, F.col("root")).alias("duplicate_of"),
    )


def screen_documents(
    blocks: DataFrame, question: str, client: Client, inclusion: list[str], exclusion: list[str], budget: int = 1500, recipe: str | Recipe = "fast", chunks: DataFrame | None = None,
) -> DataFrame:
    """document, decision, reason, criterion, criterion_valid, quote, verified, seen_tokens, document_tokens,
    truncated, error, status, duplicate_of.

    One decision on each document's opening, the chunks that fit ``budget``. An exclusion without a listed criterion is
    unclear; a quotation is verified against the opening. status is ok, failed (no readable decision) or duplicate.
    """
    placed = cut(roots(blocks))
    if chunks is None:
        chunks = chunked(blocks, RECIPES[recipe] if isinstance(recipe, str) else recipe)
    first = placed.filter("document = root").select("document")
    said = cut(screened_openings(chunks.join(first, "document", "left_semi"), question, client, inclusion, exclusion, budget))
    table = screening_table(said, exclusion)
    rows = said.drop("decision", "criterion", "reason", "quote").join(table, "document").select(
        "document", "decision", "reason", "criterion", "criterion_valid", "quote", F.when(F.col("quote").isNotNull(), contains_quote(F.col("opening"), F.col("quote"))).alias("verified"),
        "seen_tokens", "document_tokens", "truncated", "error", "read",
    )
    status = F.when(F.col("read"), "ok").otherwise("failed")
    return _with_duplicates(rows, placed, status).drop("read")


def extract_documents(
    blocks: DataFrame, fields: list[X.Field], goal: str, client: Client, recipe: str | Recipe = "thorough", require_quote: bool = False, chunks: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(table, evidence). table: document, a typed column a field, n_filled, n_unverified, conflicts, calls, status,
    duplicate_of. evidence: document, field, chunk_id, value, quote, verified.

    Every chunk is asked for every field; the value first stated stands, shown by a chunk whose quotation holds it.
    status is ok, incomplete (some replies were lost), failed (all were) or duplicate.
    """
    placed = cut(roots(blocks))
    if chunks is None:
        chunks = chunked(blocks, RECIPES[recipe] if isinstance(recipe, str) else recipe)
    first = placed.filter("document = root").select("document")
    hits, totals = fill_fields(chunks.join(first, "document", "left_semi"), fields, goal, client, require_quote)
    hits = cut(hits)
    table = X.extraction_table(X.reconcile(hits), fields)
    rows = totals.join(table, "document", "left").select(
        "document", *[F.col(f"`{f.name}`") for f in fields], F.coalesce("n_filled", F.lit(0)).alias("n_filled"), F.coalesce("n_unverified", F.lit(0)).alias("n_unverified"),
        F.coalesce("conflicts", F.lit("")).alias("conflicts"), F.col("calls").cast("bigint").alias("calls"), "failed",
    )
    status = F.when(F.col("failed") == 0, "ok").when(F.col("failed") < F.col("calls"), "incomplete").otherwise("failed")
    evidence = hits.select("document", "field", "chunk_id", "value", "quote", F.col("supported").alias("verified"))
    return _with_duplicates(rows, placed, status).drop("failed"), evidence


def usable_studies(table: DataFrame) -> DataFrame:
    """Rows that a synthesis may use, with ``study``, a dense number from 1 in order of document: read (ok, incomplete
    or restored), no duplicate, something filled."""
    from foliospark.operators.rank import global_rank

    kept = table.filter(F.col("status").isin("ok", "incomplete", "restored") & F.col("duplicate_of").isNull() & (F.col("n_filled") > 0))
    return global_rank(kept, "study", "document")

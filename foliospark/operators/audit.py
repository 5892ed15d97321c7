"""The audit page: small tables of a review as one HTML file."""

from __future__ import annotations

import html
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a section's table; a page is a report, and says how many rows it leaves out.
MAX_ROWS = 500


def esc(value) -> str:
    return "" if value is None else html.escape(str(value))


def table(columns: list[str], rows: Iterable[Iterable]) -> str:
    head = "".join(f"<th>{esc(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{esc(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def section(title: str, df: DataFrame, order: list[str]) -> str:
    """A heading and the first MAX_ROWS rows in a stated order, with a note on the rest."""
    total = df.count()
    rows = df.orderBy(*order).limit(MAX_ROWS).collect()
    note = f"<p>{total - len(rows)} more rows are not shown.</p>" if total > len(rows) else ""
    return f"<h2>{esc(title)}</h2>{table(df.columns, rows)}{note}"


def screening_roll_up(screening: DataFrame) -> DataFrame:
    return screening.groupBy("decision").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.when(~F.col("criterion_valid"), 1).otherwise(0)).alias("downgraded"))


def evidence_roll_up(evidence: DataFrame) -> DataFrame:
    """Quotations by status and whether the exact check found them."""
    return evidence.groupBy("quote_status", "verified").agg(F.count(F.lit(1)).alias("n"))


def extraction_roll_up(extraction: DataFrame, fields: list[str]) -> DataFrame:
    """How many documents fill each field."""
    counts = extraction.agg(*[F.count(f"`{f}`").alias(f) for f in fields], F.count(F.lit(1)).alias("_n"))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("filled"), F.col("_n").alias("documents")) for f in fields])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def caveats(flow: DataFrame, figures: DataFrame) -> list[str]:
    """Sentences on what a reader should not rely on."""
    out = []
    unbacked = figures.filter(~F.col("backed")).count()
    if unbacked:
        out.append(f"{unbacked} figures in the text are backed by nothing that was extracted.")
    if not flow.filter("n > 0").limit(1).count():
        out.append("No stage of the review has any document.")
    return out


def audit_page(title: str, protocol: str, sections: list[tuple[str, DataFrame, list[str]]], notes: list[str]) -> str:
    """The whole page as text; the caller writes it where it belongs."""
    parts = [section(*s) for s in sections]
    listed = "".join(f"<li>{esc(n)}</li>" for n in notes)
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{esc(title)}</title></head><body><h1>{esc(title)}</h1>"
        f"<h2>Protocol</h2><pre>{esc(protocol)}</pre>{''.join(parts)}<h2>Caveats</h2><ul>{listed}</ul></body></html>"
    )

"""One-line forms of common reads, and what is built in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.operators.model import Client
from foliospark.operators.segment import SegmentSpec, segment
from foliospark.plans.readers import ReadSpec, Recipe, answer_documents
from foliospark.sources.files import EXTRACTORS, available
from foliospark.sources.ingest import ingest

#: A small document to try things on.
EXAMPLE = """# Harbour report

The harbour moved 12,400 containers in 2019, 8 percent more than the year before.

## Works

Two cranes were replaced. The dredging of the north basin is late by four months.

## Outlook

A third berth opens in 2021. Its cost is put at 45.2 million."""


def answer_question(spark: SparkSession, source: str, question: str, client: Client, recipe: str | Recipe = "auto") -> DataFrame:
    """Answers over one source: a path, a folder, a URL or the text itself."""
    blocks = ingest(spark, [source]).filter("text is not null")
    return answer_documents(blocks.drop("kind", "error"), question, client, recipe)


def parse_text(spark: SparkSession, source: str, max_tokens: int = 1200, method: str = "paragraph") -> DataFrame:
    """Chunks of one source."""
    return segment(ingest(spark, [source]).filter("text is not null"), SegmentSpec(method, max_tokens))


def _with(reader: str, method: str, max_tokens: int, **settings):
    def run(spark: SparkSession, source: str, question: str, client: Client, max_tokens: int = max_tokens) -> DataFrame:
        return answer_question(spark, source, question, client, Recipe("standard", method, max_tokens, 0, ReadSpec(reader, **settings)))

    run.__doc__ = f"Answers by the {reader} reader over {method} chunks of at most ``max_tokens``."
    return run


read_chunked = _with("map_reduce", "paragraph", 3000)
read_retrieval = _with("retrieve", "paragraph", 500, top_k=8)
read_hierarchical = _with("hierarchical", "structural", 1500)
read_multipass = _with("iterative", "paragraph", 1200)


def extractors(spark: SparkSession) -> DataFrame:
    """(ending, ready, needs) of every extractor."""
    return spark.createDataFrame([(e, available(needs), needs) for e, (_, needs) in sorted(EXTRACTORS.items())], "ending string, ready boolean, needs string")


def flush_caches(spark: SparkSession) -> None:
    """Forget what the session keeps in memory; written caches and stores stay."""
    spark.catalog.clearCache()

"""Whether a registered reader or segmenter keeps the contract: rules run against a sample, one row a rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.model import Client, mock_client
from foliospark.operators.segment import SegmentSpec, segment
from foliospark.plans.readers import READERS, ReadSpec, expected_calls, read

SAMPLE = "The harbour was widened in 1904. Ships of 300 tonnes could then enter.\n\nTrade doubled within ten years. Two piers were added.\n\nThe old quay is a museum."
CHUNK_COLUMNS = ("document", "chunk_id", "text", "tokens")
ANSWER_COLUMNS = ("document", "reader", "answer", "not_found", "premise", "partial", "chunks_used", "calls")


def sample_blocks(spark: SparkSession) -> DataFrame:
    """Two small documents, the second in two blocks."""
    return spark.createDataFrame([("a", 1, SAMPLE), ("b", 1, SAMPLE), ("b", 2, "A fish market opened on Fridays.")], "document string, block_id int, text string")


def _report(spark: SparkSession, rules: list[tuple[str, Callable[[], bool | None]]]) -> DataFrame:
    """(rule, passed, detail); null passed is a rule that does not apply. A rule that raises has failed."""
    rows = []
    for name, rule in rules:
        try:
            rows.append((name, rule(), None))
        except Exception as e:
            rows.append((name, False, f"{type(e).__name__}: {e}"[:300]))
    return spark.createDataFrame(rows, "rule string, passed boolean, detail string")


def check_segmenter(spark: SparkSession, name: str, spec: SegmentSpec | None = None) -> DataFrame:
    """runs, columns, ids_in_order (1 or 0 on, without gaps), no_blank_chunk, within_cap, nothing_lost (every word), repeatable."""
    spec = (spec or SegmentSpec(name, 32)).clamped()
    blocks, made = sample_blocks(spark), {}

    def chunks():
        if "rows" not in made:
            made["df"] = segment(blocks, spec)
            made["rows"] = made["df"].orderBy("document", "chunk_id").collect()
        return made["rows"]

    def in_order():
        for d in {r.document for r in chunks()}:
            ids = [r.chunk_id for r in chunks() if r.document == d]
            if ids != list(range(ids[0], ids[0] + len(ids))) or ids[0] not in (0, 1):
                return False
        return True

    def nothing_lost():
        want = {(r.document, w) for r in blocks.collect() for w in r["text"].split()}
        return want <= {(r.document, w) for r in chunks() for w in r["text"].split()}

    return _report(spark, [
        ("runs", lambda: bool(chunks())), ("columns", lambda: set(CHUNK_COLUMNS) <= set(made["df"].columns)), ("ids_in_order", in_order), ("no_blank_chunk", lambda: all(r["text"].strip() for r in chunks())),
        ("within_cap", lambda: all(r.tokens <= spec.max_tokens for r in chunks())), ("nothing_lost", nothing_lost),
        ("repeatable", lambda: chunks() == segment(blocks, spec).orderBy("document", "chunk_id").collect()),
    ])


def check_reader(spark: SparkSession, name: str, client: Client | None = None, spec: ReadSpec | None = None) -> DataFrame:
    """runs, columns, one_answer_a_document, named, chunks_exist, repeatable, calls_within_cost, survives_failure.

    calls_within_cost is null for a reader whose cost is not known. survives_failure: with a client that always
    fails there is still one partial row a document.
    """
    client, spec = client or mock_client(lambda prompt: "It was widened in 1904."), spec or ReadSpec(name)
    chunks = segment(sample_blocks(spark), SegmentSpec("paragraph", 20)).select(*CHUNK_COLUMNS)
    made: dict = {}

    def answers():
        if "rows" not in made:
            made["df"] = read(chunks, "When was the harbour widened?", client, spec)
            made["rows"] = made["df"].orderBy("document").collect()
        return made["rows"]

    def within_cost():
        try:
            cost = chunks.groupBy("document").agg(F.count(F.lit(1)).alias("n")).select("document", expected_calls(name, "n", spec).alias("most"))
        except KeyError:
            return None
        most = {r.document: r.most for r in cost.collect()}
        return all(r.calls <= most[r.document] for r in answers())

    def fails(prompt: str) -> str:
        raise OSError("no connection")

    def survives():
        rows = read(chunks, "When?", mock_client(fails), spec).collect()
        return {r.document for r in rows} == {"a", "b"} and all(r.partial for r in rows)

    known = lambda: {(r.document, r.chunk_id) for r in chunks.collect()}
    return _report(spark, [
        ("runs", lambda: bool(answers())), ("columns", lambda: set(ANSWER_COLUMNS) <= set(made["df"].columns)), ("one_answer_a_document", lambda: [r.document for r in answers()] == ["a", "b"]),
        ("named", lambda: name in READERS and {r.reader for r in answers()} == {name}), ("chunks_exist", lambda: all((r.document, c) in known() for r in answers() for c in r.chunks_used)),
        ("repeatable", lambda: answers() == read(chunks, "When was the harbour widened?", client, spec).orderBy("document").collect()),
        ("calls_within_cost", within_cost), ("survives_failure", survives),
    ])

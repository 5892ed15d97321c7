"""Extraction: line items as what chunks say about orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalogue.registry import register
from foliospark.operators import extract as E
from foliospark.sources import read_table

FIELDS = [E.Field("returnflag", "enum", values=("A", "N", "R")), E.Field("linestatus", "string"), E.Field("quantity", "integer")]


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "lineitem")
    rows = F.array(
        F.struct(F.lit("returnflag").alias("field"), F.col("l_returnflag").alias("value")), F.struct(F.lit("linestatus").alias("field"), F.col("l_linestatus").alias("value")),
        F.struct(F.lit("quantity").alias("field"), F.col("l_quantity").cast("bigint").cast("string").alias("value")),
    )
    return items.select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("chunk_id"), (F.col("l_linenumber") % 2 == 0).alias("supported"), F.explode(rows).alias("h")).select("document", "chunk_id", "supported", "h.*")


_HITS = """h AS (SELECT l_orderkey AS document, l_linenumber AS chunk_id, l_linenumber % 2 = 0 AS supported, 'returnflag' AS field, l_returnflag AS value FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0, 'linestatus', l_linestatus FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0, 'quantity', l_quantity::BIGINT::VARCHAR FROM lineitem)"""
_KEYS = """k AS (SELECT document, field, lower(value) AS key, min(chunk_id) AS first, min_by(value, chunk_id) AS value, coalesce(min(chunk_id) FILTER (supported), min(chunk_id)) AS shown_by, bool_or(supported) AS supported FROM h GROUP BY 1, 2, 3),
    r AS (SELECT document, field, min_by(value, (first, key)) AS value, min_by(shown_by, (first, key)) AS chunk_id, count(*) AS n_values, CASE WHEN count(*) > 1 THEN string_agg(value, ' | ' ORDER BY first, key) END AS conflicts, min_by(supported, (first, key)) AS supported FROM k GROUP BY 1, 2)"""


@register(oracle=f"WITH {_HITS}, {_KEYS} SELECT document, field, value, chunk_id, n_values::INTEGER AS n_values FROM r")
def q_reconcile_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reconcile(hits(spark, sf_dir)).select("document", "field", "value", "chunk_id", "n_values")


@register(oracle=f"WITH {_HITS}, {_KEYS} SELECT document, field, conflicts FROM r WHERE conflicts IS NOT NULL")
def q_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.reconcile(hits(spark, sf_dir)).filter("conflicts is not null").select("document", "field", "conflicts")


@register(oracle=f"""
    WITH {_HITS}, {_KEYS} SELECT document, max(value) FILTER (field = 'returnflag') AS returnflag, max(value) FILTER (field = 'linestatus') AS linestatus, (max(value) FILTER (field = 'quantity'))::BIGINT AS quantity FROM r GROUP BY document""")
def q_extract_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.extraction_table(E.reconcile(hits(spark, sf_dir)), FIELDS).select("document", "returnflag", "linestatus", "quantity")


@register(oracle=f"""
    WITH {_HITS}, {_KEYS} SELECT document, count(value)::INTEGER AS n_filled, count(*) FILTER (NOT supported) AS n_unverified, coalesce(string_agg(field, ', ' ORDER BY field) FILTER (n_values > 1), '') AS conflicts FROM r GROUP BY document""")
def q_n_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.extraction_table(E.reconcile(hits(spark, sf_dir)), FIELDS).select("document", "n_filled", "n_unverified", "conflicts")


#: What replies may say, by event.
_SAID = ["1,204", "about 1200", "3 million", "0,85", "1,5", "n/a", "Yes.", "not reported", "-12.5", "None", "1.204,5", "between 3 and 5", "7e3", "42.", "no", "−7"]
_SAID_SQL = "(['" + "', '".join(_SAID) + "'])[(event_id % 16 + 1)::INTEGER]"
_INTS = {0: "1204", 1: "1200", 13: "42", 15: "-7"}
_NUMS = {0: "1204", 1: "1200", 3: "0.85", 8: "-12.5", 12: "7000", 13: "42", 15: "-7"}
_case = lambda m, kind: "CASE event_id % 16 " + " ".join(f"WHEN {k} THEN {v}::{kind}" for k, v in m.items()) + " END"


@register(oracle=f"""SELECT event_id, {_case(_INTS, 'BIGINT')} AS as_integer, {_case(_NUMS, 'DOUBLE')} AS as_number, CASE WHEN event_id % 16 = 6 THEN TRUE WHEN event_id % 16 = 14 THEN FALSE END AS as_boolean,
    CASE WHEN event_id % 16 <> 7 THEN {_SAID_SQL} END AS as_string, CASE WHEN event_id % 16 = 9 THEN 'None' END AS as_enum FROM events""")
def q_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*[F.lit(s) for s in _SAID])[(F.col("event_id") % 16).cast("int")]
    rows = read_table(spark, sf_dir, "events").select("event_id", said.alias("v"))
    kinds = {k: E.Field("f", k, values=("None", "null") if k == "enum" else ()) for k in ("integer", "number", "boolean", "string", "enum")}
    return rows.select("event_id", *[E.coerce(F.col("v"), f).alias(f"as_{k}") for k, f in kinds.items()])


@register(oracle="SELECT l_orderkey AS document, l_linenumber AS chunk_id, 'returnflag' AS field, l_returnflag AS value, 'q' || l_linenumber AS quote FROM lineitem")
def q_parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON replies read back into hits; fields that are null give none."""
    reply = F.concat(F.lit('{"returnflag": "'), "l_returnflag", F.lit('", "returnflag__quote": "q'), F.col("l_linenumber").cast("string"), F.lit('", "linestatus": null, "quantity": null}'))
    replies = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("chunk_id"), reply.alias("reply"))
    return E.parse_replies(replies, FIELDS)

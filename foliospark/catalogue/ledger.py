"""Ledger, admission, budgets, caches, replay, streams; events stand for model calls."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalogue.reading import CLIENT
from foliospark.catalogue.registry import register
from foliospark.operators import model as M
from foliospark.session import ensure_checkpoint_dir
from foliospark.sources import read_table
from foliospark.streaming import ledger as L

_LEDGER = """event_id AS step, CASE event_id % 4 WHEN 0 THEN 'gpt-4o-mini' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'text-embedding-3-small' ELSE 'unheard-of' END AS model, event_id % 5 = 0 AS cached, event_id % 17 <> 0 AS ok,
    CAST(100 + event_id % 1000 AS INTEGER) AS tokens_in, CAST(event_id % 50 AS INTEGER) AS tokens_out, CAST(event_id % 3 * 10 AS INTEGER) AS tokens_cached_in, CASE WHEN event_id % 8 = 0 THEN 'estimated' ELSE 'reported' END AS provenance"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliospark.catalogue.screening import _split

    return read_table(spark, sf_dir, "events").selectExpr(*_split(_LEDGER))


@register(oracle=f"""
    WITH l AS (SELECT {_LEDGER} FROM events), s AS (SELECT model, count(*) AS calls, count(*) FILTER (NOT cached) AS paid_calls, coalesce(sum(tokens_in) FILTER (NOT cached), 0)::BIGINT AS paid_in,
        coalesce(sum(tokens_out) FILTER (NOT cached), 0)::BIGINT AS paid_out, coalesce(sum(tokens_cached_in) FILTER (NOT cached), 0)::BIGINT AS cached_in FROM l GROUP BY model)
    SELECT *, round(CASE model WHEN 'gpt-4o-mini' THEN (paid_in - cached_in) / 1e6 * 0.15 + cached_in / 1e6 * 0.075 + paid_out / 1e6 * 0.6 WHEN 'gpt-4o' THEN (paid_in - cached_in) / 1e6 * 2.5 + cached_in / 1e6 * 1.25 + paid_out / 1e6 * 10
        WHEN 'text-embedding-3-small' THEN (paid_in - cached_in) / 1e6 * 0.02 + cached_in / 1e6 * 0.02 END, 9) AS usd FROM s""")
def q_trace_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trace_cost(ledger(spark, sf_dir), M.models(spark)).withColumn("usd", F.round("usd", 9))


@register(oracle=f"""
    WITH l AS (SELECT {_LEDGER} FROM events) SELECT count(*) AS calls, count(*) FILTER (cached) AS cached, count(*) FILTER (NOT ok) AS failed, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out,
    round(avg(CASE WHEN provenance = 'estimated' THEN 1.0 ELSE 0.0 END), 6) AS estimated_share FROM l""")
def q_trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.trace_summary(ledger(spark, sf_dir))


@register(oracle=f"""
    WITH l AS (SELECT {_LEDGER} FROM events), a AS (SELECT 0 AS src, step, model FROM l WHERE step % 2 = 0 UNION ALL SELECT 1, step, model FROM l WHERE step % 2 = 1)
    SELECT model, src, row_number() OVER (PARTITION BY model ORDER BY src, step)::INTEGER AS step FROM a""")
def q_trace_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).select("step", "model", (F.col("step") % 2).cast("int").alias("src"))
    return M.absorb(rows.filter("src = 0"), rows.filter("src = 1"), "model").select("model", "src", "step")

def _governed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("max_output", 50 + F.col("tokens_out")).withColumn("worst_usd", F.when(F.col("model") != "unheard-of", 0.01))
    limits = M.Governor(max_calls=200, max_cost_usd=1.5, max_output_tokens=95, allowed_models=("gpt-4o-mini", "text-embedding-3-small", "unheard-of"))
    return M.admit(rows, limits, "step").select("step", "refused")


@register(oracle=f"""
    WITH l AS (SELECT {_LEDGER} FROM events), r AS (SELECT *, 50 + tokens_out AS max_output, CASE WHEN model <> 'unheard-of' THEN 0.01 END AS worst_usd FROM l),
    a AS (SELECT *, CASE WHEN model = 'gpt-4o' THEN 'model' WHEN max_output > 95 THEN 'output' END AS own FROM r), o AS (SELECT *, own IS NULL AND worst_usd IS NOT NULL AS open FROM a),
    c AS (SELECT *, sum(CASE WHEN open THEN 1 ELSE 0 END) OVER (ORDER BY step) AS calls, sum(CASE WHEN open THEN worst_usd ELSE 0 END) OVER (ORDER BY step) AS usd FROM o)
    SELECT step, CASE WHEN own IS NOT NULL THEN own WHEN open AND calls > 200 THEN 'calls' WHEN worst_usd IS NULL THEN 'price' WHEN usd > 1.5 + 1e-9 THEN 'cost' END AS refused FROM c""")
def q_governor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests as one run."""
    return _governed(ledger(spark, sf_dir))


@register(oracle="SELECT * FROM (VALUES ('gpt-4o-mini', 115200, 113700), ('gpt-4o', 115200, 113700), ('gpt-4.1', 942818, 941318), ('gpt-4.1-mini', 942818, 941318), ('text-embedding-3-small', 7371, 5871), ('mock', 28800, 27300)) v(id, usable, input_room)")
def q_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.models(spark).select("id", *[c.alias(k) for k, c in M.budget().items()])


@register(oracle="""
    SELECT event_id, sha256('mock' || chr(1) || event_type || chr(1) || props || chr(1) || chr(2) || chr(1) || chr(2) || chr(1) || chr(2)) AS key FROM events""")
def q_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.col("props").alias("prompt"))
    return M.keyed(rows, "mock").select("event_id", "key")


@register(oracle="""
    WITH a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, props ORDER BY event_id) AS turn, props FROM events WHERE event_id % 2 = 0),
    r AS (SELECT 'reply ' || event_id AS reply, event_type, props, row_number() OVER (PARTITION BY event_type, props ORDER BY event_id) AS turn FROM events WHERE event_id % 2 = 1)
    SELECT event_id, reply, reply IS NULL AS missed FROM a LEFT JOIN r USING (event_type, props, turn)""")
def q_replay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("model"), F.col("props").alias("prompt"))
    recorded = M.keyed(rows.filter("event_id % 2 = 1"), "mock").select("key", F.col("event_id").alias("step"), F.concat(F.lit("reply "), F.col("event_id").cast("string")).alias("reply"))
    return M.replay(rows.filter("event_id % 2 = 0"), recorded, "mock", "event_id").select("event_id", "reply", "missed")


@register(oracle="""
    SELECT event_id, 'the ' || props AS reply, TRUE AS ok, bool_or(event_id % 2 = 0) OVER (PARTITION BY props) AS cached FROM events""")
def q_call_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of which a cache knows half."""
    rows = read_table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("QUESTION: q\n\nthe "), "props").alias("prompt"))
    cache = M.cacheable(M.call(rows.filter("event_id % 2 = 0"), CLIENT))
    return M.call(rows, CLIENT, cache).select("event_id", "reply", "ok", "cached")


@register(oracle="SELECT event_id, event_type, value FROM events")
def q_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as canonical JSON, read back."""
    rows = M.as_json(read_table(spark, sf_dir, "events").select("event_id", "event_type", "value"))
    return rows.select(F.from_json("json", "event_id bigint, event_type string, value double").alias("r")).select("r.*")


@register(oracle="""
    WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2)
    SELECT start, event_type, n, total FROM b""")
def q_ledger_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the stream's hourly buckets."""
    out = L.bucketed(read_table(spark, sf_dir, "events"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@register(oracle="""
    WITH m AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events), b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2)
    SELECT start, event_type, n, total FROM b, m WHERE start + INTERVAL 1 HOUR <= mark""")
def q_stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream itself over what there is: buckets that the watermark has closed."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    query = L.stream_ledger(spark, os.path.join(sf_dir, "events.parquet*"), "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    out = spark.read.schema("w struct<start: timestamp, end: timestamp>, event_type string, n bigint, total double").parquet(f"{folder}/out")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")



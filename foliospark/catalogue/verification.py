"""Quotations, numbers and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalogue.registry import register
from foliospark.catalogue.segments import blocks_of
from foliospark.operators import verify as V
from foliospark.sources import read_table

_FOLD = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@register(oracle=f"""
    WITH p AS (SELECT item_id, {_FOLD.format('text')} AS passage FROM benchmark), d AS (SELECT doc_id, ' ' || {_FOLD.format('text')} || ' ' AS body FROM documents)
    SELECT item_id, doc_id FROM p JOIN d ON contains(body, ' ' || passage || ' ') WHERE passage <> ''""")
def q_quote_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that stand whole in documents."""
    return V.find_passages(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each turn its words 3 to 12, whole or with one word changed or a digit put in."""
    turns = blocks_of(spark, sf_dir).withColumn("w", F.split("text", r"\s+"))
    part = F.slice("w", 3, 10)
    changed = F.concat(F.slice("w", 3, 4), F.array(F.lit("zzzz")), F.slice("w", 8, 5))
    digit = F.concat(F.slice("w", 3, 4), F.array(F.lit("17")), F.slice("w", 8, 5))
    quote = F.when(F.col("block_id") % 3 == 0, F.array_join(part, " ")).when(F.col("block_id") % 3 == 1, F.array_join(changed, " ")).otherwise(F.array_join(digit, " "))
    return turns.select("document", "block_id", "page", "text", quote.alias("quote"))


_NORMAL = "trim(regexp_replace(translate(lower({0}), '‘’‚‛“”„‟«»‐‑‒–—―−', '" + "''" * 4 + '"' * 6 + r"-------'), '\s+', ' ', 'g'))"
_QUOTES = rf"""
    t AS (SELECT conv_id::VARCHAR AS document, turn::INTEGER AS block_id, (turn // 2)::INTEGER AS page, text, string_split_regex(text, '\s+') AS w FROM conversations),
    q AS (SELECT *, array_to_string(CASE block_id % 3 WHEN 0 THEN w[3:12] WHEN 1 THEN w[3:6] || ['zzzz'] || w[8:12] ELSE w[3:6] || ['17'] || w[8:12] END, ' ') AS quote FROM t),
    n AS (SELECT *, {_NORMAL.format('text')} AS body, {_NORMAL.format('quote')} AS said FROM q)"""
#: Between word and number boundaries.
_HOLDS = r"""({said} <> '' AND contains({body}, {said}) AND regexp_matches({body}, '(^|[^\p{{L}}\p{{N}}.,]|(^|[^\p{{N}}])[.,])' || regexp_escape({said}) || '($|[^\p{{L}}\p{{N}}.,]|[.,]($|[^\p{{N}}]))'))"""


@register(oracle=f"WITH {_QUOTES} SELECT document, block_id, {_HOLDS.format(body='body', said='said')} AS verified FROM n")
def q_quote_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes(spark, sf_dir).select("document", "block_id", V.contains_quote(F.col("text"), F.col("quote")).alias("verified"))


@register()
def q_quote_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = quotes(spark, sf_dir).withColumn("v", V.quote_verdict("text", "quote"))
    return checked.select("document", "block_id", "v.status", "v.similarity", "v.edits", "v.critical_ok")


@register(oracle=f"""
    WITH {_QUOTES}, h AS (SELECT a.document, a.block_id, min(b.page) AS lo, max(b.page) AS hi FROM n a JOIN n b ON a.document = b.document AND {_HOLDS.format(body='b.body', said='a.said')} GROUP BY ALL)
    SELECT n.document, n.block_id, CASE WHEN lo = hi THEN lo END AS page FROM n LEFT JOIN h USING (document, block_id)""")
def q_resolve_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = quotes(spark, sf_dir).select("document", "block_id", "quote")
    return V.resolve_pages(evidence, blocks_of(spark, sf_dir)).select("document", "block_id", "page")


_SENTENCES = ["A total of {n} patients", "about {n}.5 percent", "{n},204 people in all", "twenty-five of them", "1 in 4 fell", "{n} million"]


@register(oracle="""
    WITH e AS (SELECT event_id, event_id % 90 + 10 AS n, event_id % 6 AS k FROM events)
    SELECT event_id, k IN (0, 3, 4) AS backed FROM e""")
def q_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a sentence backs n, 25 or 0.25."""
    e = read_table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 90 + 10).cast("string").alias("n"), (F.col("event_id") % 6).cast("int").alias("k"))
    said = F.array(*[F.replace(F.lit(s), F.lit("{n}"), F.col("n")) for s in _SENTENCES])[F.col("k")]
    value = F.when(F.col("k") == 3, 25.0).when(F.col("k") == 4, 0.25).otherwise(F.col("n").cast("double"))
    return e.select("event_id", V.quote_backs_value(said, value).alias("backed"))


_ANSWER = "'Rises [chunk ' || event_id % 9 || ', ' || (event_id % 9 + 2) || '-' || (event_id % 9 + 4) || '; p. 77] and falls [chunk nine] (see [12])'"


@register(oracle="""
    SELECT event_id, list_sort(list_distinct([event_id % 9, event_id % 9 + 2, event_id % 9 + 3, event_id % 9 + 4]))::VARCHAR AS cited, (SELECT count(*) FROM unnest([event_id % 9, event_id % 9 + 2, event_id % 9 + 3, event_id % 9 + 4]) t(x) WHERE x NOT BETWEEN 1 AND 8)::INTEGER AS n_unknown, 1 AS n_unparsed
    FROM events""")
def q_cited_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = read_table(spark, sf_dir, "events").select("event_id", F.expr(_ANSWER).alias("answer"), F.sequence(F.lit(1), F.lit(8)).alias("sent"))
    out = V.citation_check(answers, "sent")
    return out.select("event_id", F.concat(F.lit("["), F.array_join(F.array_sort("cited"), ", "), F.lit("]")).alias("cited"), F.size("unknown").alias("n_unknown"), F.size("unparsed").alias("n_unparsed"))


@register(oracle="""
    WITH c AS (SELECT event_id, unnest([event_id % 9, event_id % 9 + 2, event_id % 9 + 3, event_id % 9 + 4]) AS id FROM events)
    SELECT DISTINCT event_id, id::INTEGER AS id FROM c WHERE id NOT BETWEEN 1 AND 8""")
def q_cite_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids that were not supplied, as an anti join."""
    answers = read_table(spark, sf_dir, "events").select("event_id", F.explode(V.cited_ids(F.expr(_ANSWER), "chunk")).alias("id"))
    return answers.join(spark.range(1, 9).select(F.col("id").cast("int").alias("id")), "id", "left_anti").select("event_id", "id")

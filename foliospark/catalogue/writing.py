"""The writing passes with deterministic stand-ins for the model, over the star schema."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalogue.registry import register
from foliospark.operators.model import mock_client
from foliospark.plans import writing as W
from foliospark.sources import read_table

#: Customers are studies; a batch of them supports one claim by a positive balance and contradicts it otherwise.
_BATCHED = "b AS (SELECT c_custkey AS study, c_acctbal > 0 AS up, c_custkey // 2000 * 2000 + c_custkey % 2000 // 40 AS batch FROM customer)"


def _claims(prompt: str) -> str:
    found = re.findall(r"\[study ([0-9]+)\]\nbalance: (-?[0-9.]+)", prompt)
    up, down = [i for i, b in found if float(b) > 0], [i for i, b in found if float(b) <= 0]
    return json.dumps({"claims": [{"claim": "Balances are positive", "kind": "finding", "studies": [*up, "99999999"], "contradicts": down}, {"claim": "No study says this", "studies": ["-1"]}]})


def _same(prompt: str) -> str:
    if prompt.startswith(W.CLAIMS):
        return _claims(prompt)
    numbers = re.findall(r"(?m)^([0-9]+)\. ", prompt)
    return json.dumps({"groups": [[n for n in numbers if int(n) % 2], [n for n in numbers if not int(n) % 2]]})


def drawn(spark: SparkSession, sf_dir: str, answer=_claims):
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study"), F.col("c_acctbal").alias("balance"))
    return W.draw_claims(W.render_studies(customers, ["balance"]), "Are balances positive?", mock_client(answer), [])


@register(oracle=f"WITH {_BATCHED} SELECT study, batch FROM b")
def q_study_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("study"), F.lit(3).alias("tokens"))
    return W.study_batches(customers, 6000, 40)


@register(oracle=f"""
    WITH {_BATCHED} SELECT batch * 10000 AS claim_id, 'finding' AS kind, count(*) FILTER (up) AS n_support, count(*) FILTER (NOT up) AS n_contradict FROM b GROUP BY batch HAVING count(*) FILTER (up) > 0""")
def q_claims_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(spark, sf_dir)[0].select("claim_id", "kind", "n_support", "n_contradict")


@register(oracle=f"""
    WITH {_BATCHED}, c AS (SELECT batch, count(*) FILTER (up) AS s, count(*) FILTER (NOT up) AS n FROM b GROUP BY batch HAVING count(*) FILTER (up) > 0),
    k AS (SELECT *, row_number() OVER (ORDER BY batch) AS no FROM c), x AS (SELECT CASE WHEN (SELECT count(*) FROM c) > {W.MOST} THEN no ELSE no % 2 END AS g, * FROM k)
    SELECT min(batch) * 10000 AS claim_id, sum(s)::BIGINT AS n_support, sum(n)::BIGINT AS n_contradict FROM x GROUP BY g""")
def q_claims_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims, support, _ = drawn(spark, sf_dir, _same)
    return W.reconcile_claims(claims, support, "Are balances positive?", mock_client(_same))[0].select("claim_id", "n_support", "n_contradict")


def _sections(prompt: str) -> str:
    ids = re.findall(r"(?m)^([0-9]+)\. ", prompt)
    return json.dumps({"sections": [{"heading": f"Group {k}", "brief": "b", "claims": [i for i in ids if int(i) % 4 in (k, 0)]} for k in (1, 2)]})


@register(oracle="""
    SELECT n_nationkey AS claim_id, CASE WHEN n_nationkey % 5 = 0 THEN 3 WHEN n_nationkey % 4 IN (0, 1) THEN 1 WHEN n_nationkey % 4 = 2 THEN 2 ELSE 3 END::INTEGER AS section_no FROM nation""")
def q_outline_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as claims, every fifth a gap."""
    claims = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("claim_id"), F.col("n_name").alias("claim"), F.when(F.col("n_nationkey") % 5 == 0, "gap").otherwise("finding").alias("kind"))
    return W.draw_outline(claims, "Which nations?", mock_client(_sections))[1].select("claim_id", F.col("section_no").cast("int").alias("section_no"))


def _write(prompt: str) -> str:
    ids = sorted(map(int, re.findall(r"\[study ([0-9]+)\]", prompt)))
    return f"They trade [studies {', '.join(map(str, [*ids, 9_000_000]))}]. More [study unknown]."


@register(oracle="""
    WITH s AS (SELECT DISTINCT s_nationkey % 5 + 1 AS section_no, s_suppkey FROM supplier)
    SELECT section_no::INTEGER AS section_no, 1::BIGINT AS calls, (count(*) + 1)::INTEGER AS n_cited, 1 AS n_unknown, 0 AS n_unsupplied, 1 AS n_unparsed, TRUE AS partial FROM s GROUP BY 1""")
def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as claims, placed in five sections, with their suppliers as studies."""
    suppliers = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("study"), F.col("s_nationkey").alias("claim_id"), F.lit("support").alias("role"), F.col("s_name").alias("name"))
    claims = suppliers.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n_support")).withColumn("claim", F.concat(F.lit("Nation "), F.col("claim_id").cast("string")))
    placement = claims.select((F.col("claim_id") % 5 + 1).cast("int").alias("section_no"), "claim_id")
    sections = placement.select("section_no").distinct().withColumns({"heading": F.concat(F.lit("Part "), F.col("section_no").cast("string")), "brief": F.lit("")})
    out = W.synthesise(sections, placement, claims, suppliers.select("claim_id", "study", "role"), W.render_studies(suppliers, ["name"]), "Who trades?", mock_client(_write), 1_000_000)
    return out.drop("heading", "text")


def _rewrite(prompt: str) -> str:
    step, text = prompt.split("\n\n", 1)
    n = int(re.search(r"study ([0-9]+)", text)[1])
    if step.endswith("cut"):
        return text.replace("The trial, as it ran,", "The trial") if n % 2 else text + " And so on."
    return text.replace("may", "does") if n % 3 == 0 else text.replace(f"of {n} ", f"of {n + 1} ") if n % 3 == 1 else text


@register(oracle="""
    SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 3 = 2 THEN 'structure' END, CASE WHEN s_suppkey % 2 = 1 THEN 'cut' END, CASE WHEN s_suppkey % 3 = 2 THEN 'register' END) AS kept,
           concat_ws(',', CASE s_suppkey % 3 WHEN 0 THEN 'structure: claims are stronger' WHEN 1 THEN 'structure: a figure is new' END, CASE WHEN s_suppkey % 2 = 0 THEN 'cut: not shorter' END,
                     CASE s_suppkey % 3 WHEN 0 THEN 'register: claims are stronger' WHEN 1 THEN 'register: a figure is new' END) AS refused FROM supplier""")
def q_revise(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("The trial, as it ran, may suggest a rise of "), F.col("s_suppkey").cast("string"), F.lit(" points [study "), F.col("s_suppkey").cast("string"), F.lit("]."))
    out = W.revise(read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("section_no"), text.alias("text")), mock_client(_rewrite))
    return out.select(F.col("section_no").alias("s_suppkey"), F.array_join("kept", ",").alias("kept"), F.array_join("refused", ",").alias("refused"))

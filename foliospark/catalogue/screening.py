"""Screening over documents, with labels as the human reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalogue.registry import register
from foliospark.operators import screen as S
from foliospark.sources import read_table

CRITERIA = ["Not about the topic", "Wrong language"]
_REPLY = """doc_id AS document, CASE WHEN n_chars < 500 THEN 'Exclude' WHEN lang = 'fr' THEN 'exclude' WHEN n_chars < 1000 THEN 'unclear' WHEN n_chars > 20000 THEN 'maybe' ELSE ' include ' END AS decision,
    CASE WHEN n_chars < 500 THEN '1. not about the TOPIC' WHEN lang = 'fr' THEN 'I felt so' END AS criterion, 'r' AS reason, left(text, 30) AS quote"""
_TABLE = """t AS (SELECT doc_id AS document, CASE WHEN n_chars < 500 THEN 'exclude' WHEN lang = 'fr' THEN 'unclear' WHEN n_chars < 1000 THEN 'unclear' WHEN n_chars > 20000 THEN NULL ELSE 'include' END AS decision,
    CASE WHEN n_chars < 500 THEN 'r' WHEN lang = 'fr' THEN 'exclusion without a listed criterion: r' ELSE 'r' END AS reason, CASE WHEN n_chars < 500 THEN '1. not about the TOPIC' WHEN lang = 'fr' THEN 'I felt so' END AS criterion,
    CASE WHEN n_chars < 500 THEN TRUE WHEN lang = 'fr' THEN FALSE END AS criterion_valid FROM documents)"""


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.screening_table(read_table(spark, sf_dir, "documents").selectExpr(*_split(_REPLY)), CRITERIA)


def _split(columns: str) -> list[str]:
    depth, out, start = 0, [], 0
    for k, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[start:k])
            start = k + 1
    return [*out, columns[start:]]


@register(oracle=f"WITH {_TABLE} SELECT * FROM t")
def q_screen_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).drop("quote")


@register(oracle=f"WITH {_TABLE} SELECT decision, count(*) AS n, count(*) FILTER (criterion_valid = FALSE) AS downgraded FROM t GROUP BY decision")
def q_screen_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screened(spark, sf_dir).groupBy("decision").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("criterion_valid"), 1).otherwise(0)).alias("downgraded"))


@register(oracle=f"""WITH {_TABLE} SELECT 'included' AS "set", document FROM t WHERE decision = 'include' UNION ALL SELECT 'forward', document FROM t WHERE decision IN ('include', 'unclear') UNION ALL SELECT 'deferred', document FROM t WHERE decision = 'unclear'""")
def q_screen_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.screening_sets(screened(spark, sf_dir))


@register(oracle=f"""
    WITH {_TABLE} SELECT document, coalesce(CASE quality WHEN 1 THEN 'include' WHEN 0 THEN 'exclude' END, decision) AS decision, CASE WHEN quality IS NOT NULL THEN decision END AS screener_decision, CASE WHEN quality IS NOT NULL THEN 'reviewer' END AS resolved_by
    FROM t LEFT JOIN labels ON document = doc_id""")
def q_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("human"), F.lit("reviewer").alias("by"), F.lit("").alias("why"))
    return S.resolve(screened(spark, sf_dir), human).select("document", "decision", "screener_decision", "resolved_by")


@register(oracle=f"""
    WITH {_TABLE}, k AS (SELECT document, count(*) OVER () AS frame_n, row_number() OVER (ORDER BY sha256('7' || chr(1) || document), document) AS r FROM t WHERE decision = 'exclude')
    SELECT document, 'excluded' AS sampled_from, frame_n FROM k WHERE r <= 20""")
def q_reference_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.reference_sample(screened(spark, sf_dir), 20, "excluded", 7)


_FRAMES = "CASE doc_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'excluded' ELSE 'kept' END"


@register(oracle=f"""
    WITH {_TABLE}, j AS (SELECT {_FRAMES} AS sampled_from, decision IN ('include', 'unclear') AS kept, quality = 1 AS truth FROM labels JOIN t ON document = doc_id),
    c AS (SELECT sampled_from, count(*) FILTER (kept AND truth) AS tp, count(*) FILTER (NOT kept AND truth) AS fn, count(*) FILTER (kept AND NOT truth) AS fp, count(*) FILTER (NOT kept AND NOT truth) AS tn FROM j GROUP BY 1),
    w AS (SELECT *, fn / nullif(fn + tn, 0)::DOUBLE AS p, (fn + tn)::DOUBLE AS n, 1.959963984540054 AS z FROM c)
    SELECT sampled_from, tp, fn, fp, tn, round(CASE WHEN sampled_from = 'all' THEN tp / nullif(tp + fn, 0)::DOUBLE END, 6) AS sensitivity, round(CASE WHEN sampled_from = 'all' THEN tn / nullif(tn + fp, 0)::DOUBLE END, 6) AS specificity,
           round(CASE WHEN sampled_from IN ('all', 'kept') THEN tp / nullif(tp + fp, 0)::DOUBLE END, 6) AS precision, round(CASE WHEN sampled_from IN ('all', 'excluded') THEN p END, 6) AS false_omission,
           round(CASE WHEN sampled_from IN ('all', 'excluded') THEN least(1.0, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) END, 6) AS false_omission_high,
           round(CASE WHEN sampled_from = 'excluded' THEN (SELECT count(*) FROM t WHERE decision = 'exclude') * p END, 6) AS projected_lost FROM w""")
def q_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    human = read_table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("document"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("human_decision"), F.expr(_FRAMES).alias("sampled_from"),
    )
    table = screened(spark, sf_dir)
    frame = table.agg(F.sum((F.col("decision") == "exclude").cast("int")).alias("frame_n"))
    out = S.calibrate(table, human.crossJoin(F.broadcast(frame)))  # one row
    rates = ["sensitivity", "specificity", "precision", "false_omission", "false_omission_high", "projected_lost"]
    return out.select("sampled_from", "tp", "fn", "fp", "tn", *[F.round(c, 6).alias(c) for c in rates])


@register(oracle="""
    WITH c AS (SELECT lang, count(*) FILTER (n_chars > 1500) AS x, count(*) AS n FROM documents GROUP BY lang), p AS (SELECT *, x / n::DOUBLE AS p, 1.959963984540054 AS z FROM c)
    SELECT lang, x, n, round(greatest(0.0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS low,
           round(least(1.0, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS high FROM p""")
def q_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read_table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum((F.col("n_chars") > 1500).cast("int")).alias("x"), F.count(F.lit(1)).alias("n"))
    low, high = S.wilson(F.col("x"), F.col("n"))
    return counts.select("lang", "x", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register(oracle="""
    WITH p AS (SELECT d.lang, quality = 1 AS x, d.n_chars > 1000 AS y FROM labels JOIN documents d USING (doc_id)),
    c AS (SELECT lang, count(*) FILTER (x AND y)::DOUBLE AS a, count(*) FILTER (x AND NOT y)::DOUBLE AS b, count(*) FILTER (NOT x AND y)::DOUBLE AS c, count(*) FILTER (NOT x AND NOT y)::DOUBLE AS d FROM p GROUP BY lang),
    s AS (SELECT *, a + b + c + d AS n, (a + d) / (a + b + c + d) AS po, ((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d) * (a + b + c + d)) AS pe, (2 * a + b + c) / (2 * (a + b + c + d)) AS pi FROM c)
    SELECT lang, round(po, 6) AS po, round((po - pe) / nullif(1 - pe, 0), 6) AS kappa, round(2 * po - 1, 6) AS pabak, round((po - 2 * pi * (1 - pi)) / nullif(1 - 2 * pi * (1 - pi), 0), 6) AS ac1,
           round((a - d) / n, 6) AS prevalence, round((b - c) / n, 6) AS bias, round(a / nullif(a + c, 0), 6) AS sensitivity, round(d / nullif(b + d, 0), 6) AS specificity FROM s""")
def q_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read_table(spark, sf_dir, "labels").join(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = S.agreement(pairs.select("lang", (F.col("quality") == 1).alias("x"), (F.col("n_chars") > 1000).alias("y")), "x", "y", "lang")
    names = ["po", "kappa", "pabak", "ac1", "prevalence", "bias", "sensitivity", "specificity"]
    return out.select("lang", *[F.round(c, 6).alias(c) for c in names])


@register(oracle=f"""
    WITH {_TABLE} SELECT 1 AS step, 'identified' AS stage, count(*) AS n FROM documents UNION ALL SELECT 2, 'screened', count(decision) FROM t UNION ALL SELECT 3, 'excluded', count(*) FILTER (decision = 'exclude') FROM t
    UNION ALL SELECT 4, 'included', count(*) FILTER (decision = 'include') FROM t UNION ALL SELECT 5, 'labelled', count(*) FROM labels""")
def q_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, decision = screened(spark, sf_dir), F.col("decision")
    return S.flow(
        ("identified", read_table(spark, sf_dir, "documents"), F.lit(True)), ("screened", table, decision.isNotNull()), ("excluded", table, decision == "exclude"),
        ("included", table, decision == "include"), ("labelled", read_table(spark, sf_dir, "labels"), F.lit(True)),
    )

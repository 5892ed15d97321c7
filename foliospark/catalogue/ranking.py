"""Ranking over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalogue.registry import register
from foliospark.catalogue.segments import blocks_of
from foliospark.functions.text import count_words
from foliospark.operators import rank as R
from foliospark.sources import read_table

TERMS = ["the", "and", "thanedble", "license"]


def scored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every vector to the one with the least id."""
    vectors = read_table(spark, sf_dir, "embeddings")
    query = vectors.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    joined = vectors.crossJoin(F.broadcast(query))  # one row
    return joined.select("vec_id", "label", "embedding", F.round(R.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


_SCORED = """s AS (SELECT vec_id, label, embedding, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings)"""


@register(oracle=f"WITH {_SCORED} SELECT vec_id, score FROM s")
def q_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_vectors(spark, sf_dir).select("vec_id", "score")


@register(oracle=f"WITH {_SCORED} SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s QUALIFY rank <= 10")
def q_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(scored_vectors(spark, sf_dir).select("vec_id", "score"), 10, "score", "vec_id")


@register(oracle=f"""
    WITH {_SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT label, vec_id, score, rank FROM k WHERE rank <= 6 AND (score >= 0.2 OR rank = 1)""")
def q_retrieve_min_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top six of each label at or above a least score; the best one stays whatever it scores."""
    best = R.top_k(scored_vectors(spark, sf_dir).select("label", "vec_id", "score"), 6, "score", "vec_id", "label")
    return best.filter((F.col("score") >= 0.2) | (F.col("rank") == 1)).select("label", "vec_id", "score", "rank")


@register(oracle=f"""
    WITH {_SCORED},
    pool AS (SELECT * FROM s),
    one AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) = 1),
    two AS (SELECT p.*, list_cosine_similarity(p.embedding::DOUBLE[], o.embedding::DOUBLE[]) AS sim FROM pool p JOIN one o USING (label) WHERE p.vec_id <> o.vec_id
            QUALIFY row_number() OVER (PARTITION BY label ORDER BY 0.5 * p.score - 0.5 * sim DESC, p.vec_id) = 1),
    three AS (SELECT p.label, p.vec_id, p.score, greatest(list_cosine_similarity(p.embedding::DOUBLE[], o.embedding::DOUBLE[]), list_cosine_similarity(p.embedding::DOUBLE[], t.embedding::DOUBLE[])) AS sim3
            FROM pool p JOIN one o USING (label) JOIN two t USING (label) WHERE p.vec_id NOT IN (o.vec_id, t.vec_id)
            QUALIFY row_number() OVER (PARTITION BY label ORDER BY 0.5 * p.score - 0.5 * sim3 DESC, p.vec_id) = 1)
    SELECT label, vec_id, score, 1 AS position FROM one UNION ALL SELECT label, vec_id, score, 2 FROM two UNION ALL SELECT label, vec_id, score, 3 FROM three""")
def q_mmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mmr(scored_vectors(spark, sf_dir), "vec_id", "score", "embedding", 3, 0.5, "label")


_TERMS_SQL = r"list_filter(string_split_regex(lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}\s]', ' ', 'g')), '\s+'), lambda w: length(w) >= 2)"


def _bm25_sql() -> str:
    parts = " + ".join(
        f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (f{i} * 2.5) / (f{i} + 1.5 * (0.25 + 0.75 * len / avg))" for i in range(len(TERMS))
    )
    f = ", ".join(f"len(list_filter(ts, lambda x: x = '{t}')) AS f{i}" for i, t in enumerate(sorted(TERMS)))
    df = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(TERMS)))
    return f"""
    t AS (SELECT doc_id, {_TERMS_SQL} AS ts FROM documents), r AS (SELECT doc_id, len(ts) AS len, {f} FROM t),
    st AS (SELECT count(*) AS n, avg(CASE WHEN len > 0 THEN len END) AS avg, {df} FROM r),
    b AS (SELECT doc_id, round(CASE WHEN len > 0 THEN {parts} ELSE 0 END, 6) AS score FROM r, st)"""


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.bm25(read_table(spark, sf_dir, "documents"), "doc_id", "text", TERMS)
    return scored.select("doc_id", F.round("score", 6).alias("score"))


@register(oracle=f"WITH {_bm25_sql()} SELECT doc_id, score FROM b")
def q_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_scores(spark, sf_dir)


@register(oracle=f"WITH {_bm25_sql()} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM b QUALIFY rank <= 20")
def q_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_k(bm25_scores(spark, sf_dir), 20, "score", "doc_id")


@register(oracle=f"""
    WITH {_bm25_sql()}, m AS (SELECT min(score) AS lo, max(score) AS hi FROM b)
    SELECT doc_id, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END, 6) AS scaled FROM b, m""")
def q_scale01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scale01(bm25_scores(spark, sf_dir), "score", "scaled").select("doc_id", F.round("scaled", 6).alias("scaled"))


@register(oracle=f"""
    WITH {_bm25_sql()}, {_SCORED}, j AS (SELECT vec_id, s.score AS cos, b.score AS bm FROM s JOIN b ON vec_id = doc_id), m AS (SELECT min(bm) AS lo, max(bm) AS hi FROM j)
    SELECT vec_id, round(0.5 * cos + 0.5 * CASE WHEN hi > lo THEN (bm - lo) / (hi - lo) ELSE 0.5 END, 4) AS hybrid FROM j, m""")
def q_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scored_vectors(spark, sf_dir).select("vec_id", F.col("score").alias("cos"))
    joined = vectors.join(bm25_scores(spark, sf_dir).withColumnRenamed("doc_id", "vec_id"), "vec_id")
    scaled = R.scale01(joined, "score", "scaled")
    return scaled.select("vec_id", F.round(0.5 * F.col("cos") + 0.5 * F.col("scaled"), 4).alias("hybrid"))


@register()
def q_lexical_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_embed(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(spark, sf_dir).select("document", "block_id", count_words(F.col("text")).alias("tokens"))


_TURNS = r"t AS (SELECT conv_id::VARCHAR AS document, turn::INTEGER AS block_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM conversations)"


@register(oracle=f"WITH {_TURNS} SELECT document, block_id, (sum(n) OVER (PARTITION BY document ORDER BY block_id))::BIGINT AS running FROM t QUALIFY running <= 150")
def q_fit_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fit_prefix(_turns(spark, sf_dir), 150, "tokens", "block_id", "document").select("document", "block_id", "running")


@register(oracle=f"""
    WITH RECURSIVE {_TURNS}, u AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY block_id) AS k FROM t),
    w AS (SELECT document, k, block_id, CASE WHEN n <= 150 THEN n ELSE 0 END AS total, n <= 150 AS taken FROM u WHERE k = 1
          UNION ALL SELECT u.document, u.k, u.block_id, CASE WHEN w.total + u.n <= 150 THEN w.total + u.n ELSE w.total END, w.total + u.n <= 150
          FROM w JOIN u ON u.document = w.document AND u.k = w.k + 1)
    SELECT document, block_id FROM w WHERE taken""")
def q_fit_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.fit_skip(_turns(spark, sf_dir), 150, "tokens", "block_id", "block_id", "document")


@register(oracle=f"""
    WITH {_SCORED}, k AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s),
    t AS (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM k WHERE rank <= 7)
    SELECT label, vec_id, rank::INTEGER AS rank, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN n < 3 OR rank % 2 = 1 THEN rank ELSE 2 * n + 2 - rank END)::INTEGER AS position FROM t""")
def q_arrange_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.top_k(scored_vectors(spark, sf_dir).select("label", "vec_id", "score"), 7, "score", "vec_id", "label")
    return R.arrange(best, "edges", "rank", "vec_id", "label").select("label", "vec_id", "rank", "position")


@register(oracle=f"""
    WITH {_bm25_sql()}, m AS (SELECT b.doc_id, b.score, length(text) % 11 AS mark FROM b JOIN documents USING (doc_id) QUALIFY row_number() OVER (ORDER BY b.score DESC, b.doc_id) <= 50)
    SELECT doc_id, mark::INTEGER AS mark, row_number() OVER (ORDER BY mark DESC, doc_id)::INTEGER AS rank FROM m WHERE mark >= 4 QUALIFY rank <= 6""")
def q_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top fifty, a stand-in score of 0 to 10 for each, those of four or more, the best six."""
    best = R.rerank_prefilter(bm25_scores(spark, sf_dir), 50, "score", "doc_id")
    marks = read_table(spark, sf_dir, "documents").select("doc_id", (F.length("text") % 11).alias("mark"))
    scored = best.join(marks, "doc_id").filter("mark >= 4").select("doc_id", "mark")
    return R.top_k(scored, 6, "mark", "doc_id")

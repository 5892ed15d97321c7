"""Segmenters over conversations as blocks (document = conv_id, block_id = turn, section = role)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalogue.registry import register
from foliospark.catalogue.text import WORDS
from foliospark.operators import segment as S
from foliospark.sources import read_table


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return turns.select(
        F.col("conv_id").cast("string").alias("document"), F.col("turn").cast("int").alias("block_id"), "text",
        F.expr("cast(turn div 2 as int)").alias("page"), F.col("role").alias("section"),
    )


def documents_as_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block a line."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("document"), F.posexplode(F.split("text", "\n")).alias("block_id", "text"))


def _out(chunks: DataFrame) -> DataFrame:
    return chunks.select("document", F.col("chunk_id").cast("int").alias("chunk_id"), "tokens", F.md5("text").alias("text_md5"))


#: Blocks as pieces of at most {cap} words, then a greedy walk.
def _pack_sql(cap: int, section: bool = False, head: str = "body") -> str:
    part = "document, run" if section else "document"
    runs = "sum(CASE WHEN prev IS NOT DISTINCT FROM role AND NOT first THEN 0 ELSE 1 END) OVER (PARTITION BY document ORDER BY turn)" if section else "1"
    return rf"""
    WITH RECURSIVE b AS (
        SELECT conv_id::VARCHAR AS document, turn, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS first
        FROM conversations WHERE regexp_replace(text, '\s', '', 'g') <> ''
    ), r AS (SELECT *, {runs} AS run, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS ws FROM b),
    p AS (SELECT document, run, role, turn, s AS part, CASE WHEN len(ws) <= {cap} THEN text ELSE array_to_string(ws[s + 1:s + {cap}], ' ') END AS text,
                 least(len(ws) - s, {cap}) AS n FROM r, LATERAL (SELECT unnest(range(0, greatest(len(ws), 1), {cap})) AS s)),
    u AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY turn, part) AS k FROM p),
    walk AS (
        SELECT document, run, role, k, text, n, n AS total, 1 AS c FROM u WHERE k = 1
        UNION ALL
        SELECT u.document, u.run, u.role, u.k, u.text, u.n, CASE WHEN w.total + u.n <= {cap} THEN w.total + u.n ELSE u.n END,
               CASE WHEN w.total + u.n <= {cap} THEN w.c ELSE w.c + 1 END
        FROM walk w JOIN u ON u.document = w.document AND u.run = w.run AND u.k = w.k + 1
    ), g AS (SELECT document, run, any_value(role) AS role, c, sum(n)::INTEGER AS tokens, string_agg(text, E'\n\n' ORDER BY k) AS body FROM walk GROUP BY document, run, c),
    o AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY run, c) AS chunk_id, count(*) OVER (PARTITION BY document) AS total FROM g)
    SELECT document, chunk_id::INTEGER AS chunk_id, tokens, md5({head}) AS text_md5 FROM o"""


@register(oracle=_pack_sql(120))
def q_seg_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(S.segment(blocks_of(spark, sf_dir), S.SegmentSpec("paragraph", 120)))


@register(oracle=_pack_sql(40))
def q_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(S.segment(blocks_of(spark, sf_dir), S.SegmentSpec("paragraph", 40)))


@register(oracle=_pack_sql(112, True, r"'## ' || role || E'\n\n' || body"))
def q_seg_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(S.segment(blocks_of(spark, sf_dir), S.SegmentSpec("structural", 120)))


@register(oracle=_pack_sql(120, False, r"'[' || document || ' | Part ' || chunk_id || ' of ' || total || E']\n' || body"))
def q_seg_contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = blocks_of(spark, sf_dir).drop("page", "section")
    return _out(S.segment(blocks, S.SegmentSpec("contextual", 120)))


@register(oracle=rf"""
    WITH d AS (SELECT doc_id::VARCHAR AS document, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE regexp_replace(text, '\s', '', 'g') <> ''),
    s AS (SELECT document, w, unnest(range(0, greatest(0, ceil((len(w) - 200) / 181.0)::BIGINT) + 1)) AS k FROM d)
    SELECT document, (k + 1)::INTEGER AS chunk_id, least(len(w) - k * 181, 200)::INTEGER AS tokens, md5(array_to_string(w[k * 181 + 1:k * 181 + 200], ' ')) AS text_md5 FROM s""")
def q_seg_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(S.segment(documents_as_blocks(spark, sf_dir), S.SegmentSpec("fixed", 200, 20)))


@register(oracle=rf"""
    WITH g AS (SELECT conv_id::VARCHAR AS document, (turn // 2)::INTEGER AS page, string_agg(text, E'\n\n' ORDER BY turn) AS body, min(turn) AS first
               FROM conversations WHERE regexp_replace(text, '\s', '', 'g') <> '' GROUP BY ALL)
    SELECT document, row_number() OVER (PARTITION BY document ORDER BY first)::INTEGER AS chunk_id, {WORDS.format('body')}::INTEGER AS tokens, md5(body) AS text_md5 FROM g""")
def q_seg_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(S.segment(blocks_of(spark, sf_dir), S.SegmentSpec("page")))


@register()
def q_seg_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(S.segment(documents_as_blocks(spark, sf_dir), S.SegmentSpec("sentence", 120)))


@register()
def q_seg_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(S.segment(documents_as_blocks(spark, sf_dir), S.SegmentSpec("recursive", 120, tokenizer="heuristic")))


@register()
def q_pack_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(S.segment(blocks_of(spark, sf_dir), S.SegmentSpec("paragraph", 80, 10, 20, "heuristic")))


@register()
def q_seg_semantic_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(S.segment(blocks_of(spark, sf_dir), S.SegmentSpec("semantic", 120)))


COSINE = "round(1 - list_cosine_similarity(embedding::DOUBLE[], p::DOUBLE[]), 9)"


@register(oracle=f"""
    WITH s AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings),
    d AS (SELECT label, vec_id, CASE WHEN p IS NULL THEN NULL ELSE {COSINE} END AS distance FROM s),
    c AS (SELECT label, quantile_cont(distance, 0.9) AS cut FROM d GROUP BY label)
    SELECT label, vec_id, sum(CASE WHEN distance IS NULL OR distance >= cut THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id)::BIGINT AS piece
    FROM d JOIN c USING (label)""")
def q_seg_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.semantic_boundaries(read_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", "piece")

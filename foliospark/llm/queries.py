"""The registered queries, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe, exact_dedup, fingerprint, langid, line_dedup, near_dup, packing, pii, quality, url_filter
from foliospark.llm.common import held_out, read_table



def vocabulary() -> str:
    """The vocabulary file of op6."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents")).drop("key")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = quality.quality_scores(docs, read_table(spark, sf_dir, "labels"))
    score = F.col("__fs_score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= quality.CUT).cast("int").alias("predicted"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select(
        "doc_id",
        F.col("__fs_lines").alias("n_lines"),
        F.col("__fs_chunks").alias("n_chunks"),
        F.col("__fs_removed").alias("n_removed"),
        F.md5("text").alias("text_md5"),
        F.length("text").alias("n_chars"),
    )


def op4_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated run of two lines or more, as the pipeline drops them."""
    cleaned = line_dedup.line_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", F.col("__fs_lines").alias("n_lines"), F.col("__fs_removed").alias("n_removed"), F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.language_spans(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(read_table(spark, sf_dir, "documents"), vocabulary())


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind are of base spans; n_added counts what the network adds, n_spans both."""
    found = pii.personal_data(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.regexp_extract_all("__fs_base", F.lit(f"{kind}:"), F.lit(0))).cast("bigint").alias(f"n_{kind}")
    commas = lambda c: F.when(F.col(c) == "", 0).otherwise(F.size(F.split(c, ",")))
    return found.select(
        "doc_id",
        *[count(k) for k in pii.KINDS],
        F.sha2("__fs_base", 256).alias("base_sha256"),
        F.col("__fs_spans").alias("spans"),
        (commas("__fs_spans") - commas("__fs_base")).cast("bigint").alias("n_added"),
        commas("__fs_spans").cast("bigint").alias("n_spans"),
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.document_fingerprints(read_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(read_table(spark, sf_dir, "pages"), url_filter.rule_frame(spark, url_filter.RULES))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_ngram_jaccard, op3_quality, op4_line_dedup, op4_line_runs, op5_language_id, op6_bpe, op7_packing, op8_pii,
        op9_fingerprints, op10_url_filter,
    )
}

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)

ORACLES = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op4_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, text, u.line, u.i FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
                   LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i) u
        ), h AS (
            SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l
        ), r AS (
            SELECT *, h + {line_dedup.BASE} * coalesce(lag(h) OVER w, 0) AS rolled, lead(i) OVER w IS NULL AS last
            FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), c AS (
            SELECT *, coalesce(sum(CASE WHEN last OR rolled % {line_dedup.DIVISOR} = 0 THEN 1 ELSE 0 END)
                   OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx FROM r
        ), chunks AS (
            SELECT doc_id, idx, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, idx
        ), seen AS (
            SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, idx) AS nth FROM chunks
        ), flagged AS (
            SELECT *, n >= {line_dedup.MIN_LINES} AND nth > 1 AND regexp_matches(body, '\\S') AS gone FROM seen
        ), out AS (
            SELECT doc_id, sum(n)::INTEGER AS n_lines, count(*)::INTEGER AS n_chunks,
                   coalesce(sum(n) FILTER (gone), 0)::INTEGER AS n_removed,
                   coalesce(string_agg(body, chr(10) ORDER BY idx) FILTER (NOT gone), '') AS t
            FROM flagged GROUP BY doc_id
        )
        SELECT doc_id, n_lines, n_chunks, n_removed, md5(t) AS text_md5, length(t)::INTEGER AS n_chars FROM out
    """,
    "op4_line_runs": r"""
        WITH l AS (
            SELECT doc_id, u.line, u.i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
                   LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i) u
        ), n AS (
            SELECT doc_id, i AS lo, line AS a, lead(i) OVER w AS hi, lead(line) OVER w AS b FROM l WHERE regexp_matches(line, '\S')
            WINDOW w AS (PARTITION BY doc_id ORDER BY i)
        ), p AS (
            SELECT *, min({'d': doc_id, 'lo': lo, 'hi': hi}) OVER (PARTITION BY a, b) AS first FROM n WHERE hi IS NOT NULL
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = first.d AND lo = first.hi THEN lo + 1 ELSE lo END, hi + 1)) AS i
            FROM p WHERE NOT (doc_id = first.d AND lo = first.lo)
        ), out AS (
            SELECT doc_id, count(*)::INTEGER AS n_lines, count(g.i)::INTEGER AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS t
            FROM l LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, n_lines, n_removed, md5(t) AS text_md5, length(t)::INTEGER AS n_chars FROM out
    """,
    "op10_url_filter": rf"""
        WITH rules(verdict, host, path) AS (VALUES {_RULES}),
        p AS (
            SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), q AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM p
        ), hit AS (
            SELECT q.*, r.host || r.path AS rule, r.verdict, row_number() OVER (
                PARTITION BY page_id ORDER BY length(r.host) + length(r.path) DESC NULLS LAST, length(r.host) DESC) AS k
            FROM q LEFT JOIN rules r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE k = 1
    """,
}
ORACLES["op4_line_dedup"] = ORACLES["op4_line_dedup"].replace("\\\\S", "\\S")

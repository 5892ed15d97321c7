"""Bibliographic records, with parts and suppliers standing in for references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.catalogue.registry import register
from foliospark.functions import keys as K
from foliospark.operators import records as R
from foliospark.sources import bibliography as B
from foliospark.sources import read_table

_DOI = "CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN 'https://doi.org/10.1000/AB' || p_partkey % 300 ELSE 'doi:10.1000/ab' || p_partkey % 300 END"
_YEAR = "'published ' || CAST(1990 + p_size AS VARCHAR(20)) || ', revised'"


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("record_id"), F.col("p_name").alias("title"), F.expr(_YEAR).alias("year"), F.expr(_DOI).alias("doi"),
        F.expr("CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_brand END").alias("venue"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'Smith, J; Jones, A' END").alias("authors"),
    )


_FINISHED = """f AS (SELECT p_partkey AS record_id, trim(p_name) AS title, CAST(1990 + p_size AS VARCHAR) AS year, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '10.1000/ab' || p_partkey % 300 END AS doi,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS venue, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE 'Smith, J; Jones, A' END AS authors FROM part)"""


@register(oracle=f"WITH {_FINISHED} SELECT * FROM f")
def q_finish_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.finish_records(references(spark, sf_dir)).select("record_id", "title", "year", "doi", "venue", "authors")


@register(oracle=r"SELECT doc_id, nullif(regexp_replace(lower(strip_accents(replace(replace(replace(lower(text), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'))), '[^\p{L}\p{N}]+', '', 'g'), '') AS title_key FROM documents")
def q_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, keyed by its whole text."""
    return read_table(spark, sf_dir, "documents").select("doc_id", K.title_key(F.col("text")).alias("title_key"))


@register(oracle=f"WITH {_FINISHED} SELECT record_id, CASE WHEN doi IS NOT NULL THEN nullif(min(record_id) OVER (PARTITION BY doi), record_id) END AS duplicate_of FROM f")
def q_doi_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dedupe_by_doi(R.finish_records(references(spark, sf_dir))).select("record_id", "duplicate_of")


_WORK = "CASE p_partkey % 9 WHEN 0 THEN 'Effects of the Treatment on Mortality' WHEN 1 THEN 'Effects of the treatment on mortality.' ELSE p_name || ' study of ' || p_partkey END"


@register(oracle=f"""
    WITH w AS (SELECT p_partkey AS record_id, CASE WHEN p_partkey % 9 <= 1 THEN 'same' ELSE p_partkey::VARCHAR END AS work, p_size % 5 AS y, p_partkey % 2 AS v FROM part),
    g AS (SELECT *, min(record_id) OVER (PARTITION BY work, y, v) AS root FROM w)
    SELECT record_id, nullif(root, record_id) AS duplicate_of FROM g""")
def q_title_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One title in two spellings over five years and two venues that disagree, among titles of their own."""
    part = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("record_id"), F.expr(_WORK).alias("title"), F.expr("cast(2000 + p_size % 5 as string)").alias("year"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN 'Lancet' ELSE 'Journal of Physics' END").alias("venue"), F.lit("Smith, J").alias("authors"),
    )
    return R.dedupe_by_title(R.finish_records(part))


@register(oracle=f"WITH {_FINISHED} SELECT 2000 + record_id % 100 AS record_id, min_by(venue, CASE WHEN venue IS NOT NULL THEN record_id END) AS venue, min_by(authors, CASE WHEN authors IS NOT NULL THEN record_id END) AS authors, min_by(doi, CASE WHEN doi IS NOT NULL THEN record_id END) AS doi FROM f GROUP BY 1")
def q_merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.finish_records(references(spark, sf_dir)).select("record_id", "venue", "authors", "doi").withColumn("root", 2000 + F.col("record_id") % 100)
    return R.merge_fields(rows)


#: One file a supplier, found by its name, a DOI in its stem, the head of a title, or surname and year.
_PATH = "'files/' || CASE s_suppkey % 4 WHEN 0 THEN 'scan_' || s_suppkey WHEN 1 THEN 'tail' || s_suppkey WHEN 2 THEN 'Trial_' || lpad(cast(s_suppkey AS VARCHAR(20)), 8, '0') || '_of_long_term_outcome' ELSE 'Fam' || translate(cast(s_suppkey AS VARCHAR(20)), '0123456789', 'abcdefghij') || '_2001_final' END || '.pdf'"


@register(oracle=f"""
    SELECT s_suppkey AS record_id, {_PATH} AS path, (['file', 'doi', 'title', 'author_year'])[s_suppkey % 4 + 1] AS route FROM supplier JOIN part ON p_partkey = s_suppkey WHERE s_suppkey % 20 <> 0""")
def q_match_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records: a quarter of those that a supplier has a file for are found by each route; every twentieth
    file name is claimed by two records, so neither gets it."""
    named = "CASE WHEN p_partkey % 4 = 0 THEN '/old/scan_' || p_partkey || '.pdf' WHEN p_partkey % 20 = 1 THEN 'scan_' || (p_partkey - 1) || '.pdf' END"
    records = read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("record_id"), F.expr(named).alias("file"), F.expr("CASE WHEN p_partkey % 4 = 1 THEN '10.1000/tail' || p_partkey END").alias("doi"),
        F.expr("CASE WHEN p_partkey % 4 = 2 THEN 'Trial ' || lpad(cast(p_partkey as string), 8, '0') || ' of long-term outcome in hospitals' END").alias("title"),
        F.expr("CASE WHEN p_partkey % 4 = 3 THEN 'Fam' || translate(cast(p_partkey as string), '0123456789', 'abcdefghij') || ', J; Roe, R' END").alias("authors"), F.lit("2001").alias("year"),
    )
    files = read_table(spark, sf_dir, "supplier").select(F.expr(_PATH).alias("path"))
    return R.match_files(records, files).select("record_id", "path", "route")


@register(oracle=f"""
    WITH {_FINISHED}, d AS (SELECT *, CASE WHEN doi IS NOT NULL THEN nullif(min(record_id) OVER (PARTITION BY doi), record_id) END AS duplicate_of FROM f)
    SELECT count(*) AS identified, count(duplicate_of) AS duplicates, count(*) - count(duplicate_of) AS screened, count(*) - count(duplicate_of) AS sought,
           count(*) FILTER (duplicate_of IS NULL AND record_id % 3 = 0) AS retrieved, count(*) FILTER (duplicate_of IS NULL AND record_id % 3 <> 0) AS not_retrieved FROM d""")
def q_prisma(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = R.dedupe_by_doi(R.finish_records(references(spark, sf_dir)))
    return R.prisma_counts(marked.withColumn("retrieved", F.col("record_id") % 3 == 0))


@register(oracle="""SELECT n_nationkey AS n, n_name AS title, 'Doe, Jane; Roe, R' AS authors, CAST(1990 + n_nationkey AS VARCHAR) AS year, '10.1000/x' || n_nationkey AS doi, CASE WHEN n_nationkey % 3 = 0 THEN '1-9' ELSE '5-8' END AS pages FROM nation""")
def q_import_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RIS, MEDLINE and BibTeX exports made of the nations, read back."""
    ris = "concat('TY  - JOUR', chr(10), 'TI  - ', n_name, chr(10), 'AU  - Doe, Jane', chr(10), 'AU  - Roe, R', chr(10), 'PY  - ', 1990 + n_nationkey, '/05', chr(10), 'DO  - 10.1000/X', n_nationkey, chr(10), 'SP  - 1', chr(10), 'EP  - 9', chr(10), 'ER  - ', chr(10))"
    med = "concat('PMID- ', n_nationkey, chr(10), 'TI  - ', n_name, chr(10), 'FAU - Doe, Jane', chr(10), 'FAU - Roe, R', chr(10), 'DP  - ', 1990 + n_nationkey, ' May', chr(10), 'LID - 10.1000/x', n_nationkey, ' [doi]', chr(10), 'PG  - 5-8', chr(10))"
    bib = "concat('@article{k', n_nationkey, ', title = {{', n_name, '}}, author = \"Doe, Jane and Roe, R\", year = ', 1990 + n_nationkey, ', doi = {10.1000/x', n_nationkey, '}, pages = {5-8}}', chr(10))"
    content = f"CASE n_nationkey % 3 WHEN 0 THEN {ris} WHEN 1 THEN {med} ELSE {bib} END"
    files = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("path"), F.expr(content).alias("content"))
    return B.parse_exports(files).select(F.col("source_file").cast("int").alias("n"), "title", "authors", "year", "doi", "pages")


@register(oracle="SELECT l_orderkey, count(*) AS lines, any_value(o_orderstatus) AS o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def q_attach_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    orders = read_table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return R.attach_fields(rows, orders, "l_orderkey", ["o_orderstatus"])

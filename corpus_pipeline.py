"""Five stages over a corpus: reject bad documents, drop repeated runs of lines, keep one document of each group of
near duplicates, redact personal data, pack what is left.

Each stage is written as Parquet to the shared folder and read again as the next one's input, so a lost executor
costs at most one stage's tasks; what a stage was read from goes once it is written.

Every stage takes (spark, docs, sf_dir) with at least doc_id and text in docs. Other columns pass through as they are,
whatever their names; names that begin with __fs_ are the operators' own. A null text counts as empty, an empty table
gives an empty one, a very long text is handled whole, and rows that repeat others are treated as each stage says.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm import line_dedup, near_dup, packing, pii, quality
from foliospark.llm.common import ensure_checkpoint_dir, read_table


def _with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` of a frame whose text is now in ``text``; n_chars, if there is one, follows the text."""
    at = {"text": F.col(text)}
    if "n_chars" in columns:
        at["n_chars"] = F.length(text).cast("bigint")
    return df.select(*[at[c].alias(c) if c in at else F.col(f"`{c}`") for c in columns])


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut. Repeated rows have one score; empty texts are scored like others."""
    scored = quality.quality_scores(docs, read_table(spark, sf_dir, "labels"), carry=tuple(docs.columns))
    return scored.filter(F.col("__fs_score") >= quality.CUT).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the runs of two lines or more that an earlier place holds; places are ordered by
    (doc_id, line), nulls first. A null text stays null. Rows that repeat id and text lose the same lines."""
    return _with_text(line_dedup.line_runs(docs), docs.columns, "text")


def _has_map(kind: T.DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []
    return isinstance(kind, T.MapType) or any(map(_has_map, inner))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, nulls last.

    Texts without a word are copies of one another only when they are equal. Rows that repeat both id and text leave
    one row, the least by their other columns.
    """
    kept = near_dup.near_duplicates(docs).filter("kept").select(F.col("doc_id").alias("__fs_id"), F.col("key").alias("__fs_key2"))
    keyed = docs.withColumn("__fs_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = keyed.join(kept, (F.col("__fs_key") == F.col("__fs_key2")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("__fs_id")))
    others = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    order = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in others]
    rest = F.min_by(F.struct(F.lit(0), *[F.col(f"`{f.name}`") for f in others]), F.struct(F.lit(0), F.col("text").isNull(), *order)).alias("__fs_rest")
    one = joined.groupBy("__fs_key", "doc_id").agg(F.first("text", ignorenulls=True).alias("text"), rest)
    return one.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"__fs_rest.`{c}`").alias(c) for c in docs.columns])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind. A null text stays null; repeated rows get a row each."""
    return _with_text(pii.personal_data(docs, tuple(docs.columns), clean=True), docs.columns, "__fs_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and the bins they are packed in; null and empty texts are pieces of length 1,
    repeated rows are packed each."""
    return packing.best_fit_pack(docs)


STAGES = [
    ("quality classifier", reject_bad),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("PII", redact),
    ("best-fit packing", pack),
]

#: The learned and iterative stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _drop(spark, f"{folder}/{k - 1}")
    return docs

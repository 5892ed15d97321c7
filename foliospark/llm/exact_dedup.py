"""Exact dedup by deterministic block naming (native).

A text is cut into blocks of a fixed number of code points. Distinct blocks are sorted and numbered, so a text
becomes a list of integers; then, level by level, adjacent integers are paired and the distinct pairs numbered
again, until each text is one integer. Names at a level are one to one with content, so two texts end with the
same (level, name) exactly when they are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import cut

BLOCK_CHARS = 1024
#: Names are numbered inside buckets of the sorted key space, so no task numbers all of them.
BUCKET_BITS = 12
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _blocks(text: Column, size: int) -> Column:
    """Blocks of ``size`` code points in one linear pass; the empty text is one empty block."""
    found = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(found)


def _key(block: Column) -> Column:
    """The 128 bits a block is looked up by."""
    return F.struct(F.xxhash64(block).alias("k1"), F.xxhash64(F.lit(17), block).alias("k2"))


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``name``, an integer for each row of ``distinct``: its rank in sorted order within a bucket of keys."""
    bucket = F.shiftrightunsigned(F.xxhash64(*keys), 64 - BUCKET_BITS)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys)).cast("bigint")
    return distinct.withColumn("bucket", bucket).select(
        *distinct.columns, (F.shiftleft(F.col("bucket"), 63 - BUCKET_BITS) + rank).alias("name")
    )


def _block_names(blocks: DataFrame) -> tuple[DataFrame, list[str]]:
    """Names of the distinct blocks, and the columns a block is looked up by.

    Blocks are grouped by their bytes (partial aggregation folds copies before the shuffle). Look-up uses a
    128-bit key after a proof, over all blocks, that no key stands for two blocks; were there one, look-up
    would use the blocks themselves.
    """
    distinct = blocks.groupBy("k1", "k2", "block").agg(F.lit(1).alias("one"))
    keyed = cut(distinct.groupBy("k1", "k2").agg(F.count("one").alias("n_blocks")))
    if keyed.filter("n_blocks > 1").limit(1).count():
        by = ["k1", "k2", "block"]
        return cut(_numbered(distinct.select(*by), by)), by
    return _numbered(keyed.select("k1", "k2"), ["k1", "k2"]), ["k1", "k2"]


def name_documents(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(rows, identity): rows(rid, doc_id, text_sha256), identity(rid, level, name), both in the shared folder."""
    text = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", normalised(F.col("text")).alias("norm"))
    text = text.withColumn("blocks", _blocks(F.col("norm"), block_chars))
    row = ["rid", "doc_id", F.sha2("norm", 256).alias("text_sha256")]
    rows = cut(text.select(*row, F.transform("blocks", _key).alias("keys")))
    names, by = _block_names(text.select(F.explode_outer("blocks").alias("block")).select(_key(F.col("block")).alias("key"), "block").select("key.*", "block"))
    if by == ["k1", "k2"]:
        parts = rows.select("rid", F.size("keys").alias("n"), F.posexplode("keys").alias("i", "key")).select("rid", "n", "i", "key.*")
    else:
        # row ids are drawn anew, so the rows are those that carry the blocks
        rows = cut(text.select(*row, "blocks"))
        parts = rows.select("rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("i", "block"))
        parts = parts.withColumn("key", _key(F.col("block"))).select("rid", "n", "i", "key.*", "block")
    named = cut(parts.join(names, by).select("rid", "n", "i", "name"))

    done = named.filter("n = 1").select("rid", F.lit(0).alias("level"), "name")
    longest = named.agg(F.max("n")).first()[0] or 1
    level = 0
    current = named.filter("n > 1")
    while (1 << level) < longest:
        level += 1
        pairs = current.groupBy("rid", F.expr("i div 2").cast("int").alias("i")).agg(
            F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            F.max(F.expr("(n + 1) div 2")).cast("int").alias("n"),
        )
        numbered = _numbered(pairs.select("left", "right").distinct(), ["left", "right"])
        current = cut(pairs.join(numbered, ["left", "right"]).select("rid", "n", "i", "name"))
        done = done.unionByName(current.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
        current = current.filter("n > 1")
    return rows, done


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after normalisation; of equal texts the smallest doc_id stays. A null text
    is an empty one and empty texts are equal. Rows that repeat both doc_id and text are one document: group_size
    counts each row and all of them carry the same flag. A null doc_id loses to any other; a group of nulls has
    a null keep_id and is kept. Other columns are not read; an empty table gives an empty result. Groups are
    folded before they are shuffled, and a hot group is a skewed join key that adaptive execution splits.
    """
    rows, identity = name_documents(docs, block_chars)
    member = cut(rows.select("rid", "doc_id", "text_sha256").join(identity, "rid"))
    groups = member.groupBy("level", "name").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return member.join(groups, ["level", "name"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )

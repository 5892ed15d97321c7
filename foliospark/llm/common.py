"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.operators.graph import connected_components
from foliospark.session import cut as checkpointed
from foliospark.session import ensure_checkpoint_dir
from foliospark.sources import read_table

__all__ = ["carried", "connected_components", "cut", "ensure_checkpoint_dir", "held_out", "read_table", "small_batches"]

#: Rows in an Arrow batch handed to Python; texts can be long.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Arrow batch of texts can hold in a Python worker, by rows and by bytes.

    These are settings of the session, and Spark reads them when a plan runs: they stay in force for later queries.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame, spread: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back; few files unless ``spread``, which keeps a partition
    for each core, for stages whose work is heavy beside their bytes."""
    return checkpointed(df, spread)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 on division by 4; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def carried(docs: DataFrame, carry: tuple[str, ...]) -> tuple[list[Column], list[T.StructField], list[Column]]:
    """What takes the columns ``carry`` through Python, whatever their names: (columns to send, their fields, columns
    that put the names back)."""
    kinds = {f.name: f for f in docs.schema}
    send = [F.col(f"`{c}`").alias(f"__fs_c{k}") for k, c in enumerate(carry)]
    fields = [T.StructField(f"__fs_c{k}", kinds[c].dataType) for k, c in enumerate(carry)]
    return send, fields, [F.col(f"__fs_c{k}").alias(c) for k, c in enumerate(carry)]

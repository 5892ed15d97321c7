"""Session factory and the shared-folder rules every multi-pass operator follows."""

from __future__ import annotations

import os
import tempfile
import weakref

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "6g", **conf: str) -> SparkSession:
    """A session for tests and for the bench; on a cluster the submitter's own session is used as it is."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("foliospark")
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir. Only a local session without one, as tests have, gets a folder of
    its own; on a cluster executors would not see it, so there it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "foliospark-checkpoints"))


#: Frames that cut() returned, as long as somebody holds them.
_CUT: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def cut(df: DataFrame, spread: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: a plan used twice runs once, and what
    it held survives the loss of any executor. What is such a frame already is not written again.

    Without ``spread`` shuffled data arrive in partitions of the advisory size, not one for each core, so a small table
    leaves few files. The setting is put back, as the write has ended by then.
    """
    if df in _CUT:
        return df
    spark, name = df.sparkSession, "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    ensure_checkpoint_dir(spark)
    was = spark.conf.get(name)
    spark.conf.set(name, str(spread and was.lower() == "true").lower())
    try:
        done = df.checkpoint(eager=True)
        _CUT.add(done)
        return done
    finally:
        spark.conf.set(name, was)

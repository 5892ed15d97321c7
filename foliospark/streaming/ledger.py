"""Streams: a ledger in time buckets, and documents into the keyed store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def bucketed(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of a ledger by time bucket and kind, with late rows up to the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def stream_ledger(spark: SparkSession, path: str, schema: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Read what is there, bucket it, append finished buckets to Parquet; run again to go on from the checkpoint."""
    events = spark.readStream.schema(schema).parquet(path)
    return bucketed(events).writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_documents(docs: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append documents whose content key the store does not hold. A batch that is run again appends nothing new."""

    def land(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        keyed = batch.withColumn("key", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["key"])
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            keyed = keyed.join(spark.read.parquet(store).select("key"), "key", "left_anti")
        keyed.write.mode("append").parquet(store)

    return docs.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

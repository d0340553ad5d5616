"""Labels as a stream: rows arrive in any order and batch by batch; a clip is estimated once its plan is complete.

State is a table keyed by clip and time: each batch is merged into the clips it touches, and only those are computed again. The
watermarked count per window serves monitoring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import time_key


def merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Rows by clip and time key, of which the last written counts."""
    new = new.withColumn("key", time_key(F.col("t_s")))
    rows = new if old is None else old.unionByName(new)
    names = [c for c in rows.columns if c not in ("clip_id", "key", "seq")]
    last = rows.groupBy("clip_id", "key").agg(F.max(F.struct("seq", *names)).alias("r"))
    return last.select("clip_id", "key", *(F.col(f"r.{c}").alias(c) for c in ("seq", *names)))


def complete_clips(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Clips with as many rows as are planned (clip_id, n_planned)."""
    return rows.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n")).join(planned, "clip_id").filter("n = n_planned").select("clip_id")


def ingest(spark: SparkSession, source: str, schema: str, state: str, checkpoint: str) -> StreamingQuery:
    """Merge a folder of JSON label files into Parquet state, a folder for each clip bucket; only touched buckets are rewritten."""
    stream = spark.readStream.schema(schema).json(source)

    def merge(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64("clip_id"), F.lit(64)).cast("int")).persist()
        try:
            touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # 64 at most
            if not touched:
                return
            path = spark._jvm.org.apache.hadoop.fs.Path(state)
            there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
            old = spark.read.parquet(state).filter(F.col("bucket").isin(touched)) if there else None
            rows = merged(old, batch)
            # written beside the state first, since Spark refuses to overwrite what it reads
            rows.write.mode("overwrite").parquet(f"{state}-batch")
            spark.read.parquet(f"{state}-batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(state)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events per type and window; rows later than the watermark are left out."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

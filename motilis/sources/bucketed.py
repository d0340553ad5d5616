"""Tables in buckets of their keys: what is written once by clip is met by clip without another shuffle."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .stores import scratch_folder


def bucketed(df: DataFrame, *keys: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """df, dealt out once by its keys, written as that many bucket files sorted by them, and read back through the session's catalog.

    Joins and groupings by the keys, or by these and more columns within `without_shuffle`, then start from the files. Tables that
    are to meet need the same keys and number of buckets (default: the session's shuffle partitions). The files are in path, or a new
    folder in spark.checkpoint.dir, and outlive the session; their name in the catalog does not."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"motilis_{uuid.uuid4().hex[:16]}"
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path or scratch_folder(spark)).saveAsTable(name)
    return spark.table(name)


@contextmanager
def without_shuffle(spark: SparkSession) -> Iterator[None]:
    """Plans made inside may join on more columns than the buckets are made of, and keep bucket files apart. Plan, and run, inside."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.sources.bucketing.enabled": "true"}
    held = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)

"""Scans that go on where they broke off: a table of rows by unit of work (a shard, a clip), to which attempts only add.

Each row says how many rows its unit has (`rows_of_unit`) and which attempt wrote it. A unit is whole if one attempt wrote all of
its rows; the first such attempt is the one that is read, and rows of attempts that fell short are as if they were not there.
So nothing written is ever changed or taken back: a run does the units of its work that are not whole yet, in waves, each of
them one job whose rows are committed together, and whatever stops it, the next run repeats at most the wave that was not
committed. Units that the work does not name, such as those of others who write to the same table, stay as they are, and two
runs at a time cost double work at worst.

Where the number of rows is known beforehand (`expected`, the instants planned of a clip), a unit that comes back short or long is
not whole; else the rows that came are what the unit has. A row of a unit that failed has no number: it is kept for its reason
and its unit is tried again, and so is a unit of which no row came.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tar_shards
from .stores import scratch_folder

ROWS, ATTEMPT = "rows_of_unit", "attempt"


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows of work whose unit is not done, one for each unit."""
    return work.dropDuplicates([key]).join(done.select(key).distinct(), key, "left_anti")


def read_attempts(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of all attempts, or None before the first wave has been committed."""
    try:
        return spark.read.option("mergeSchema", "false").parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def whole_units(attempts: DataFrame, key: str) -> DataFrame:
    """key, attempt of each whole unit: the first attempt that wrote all of its rows."""
    tries = attempts.groupBy(key, ATTEMPT).agg(F.count(F.lit(1)).alias("n"), F.max(ROWS).alias("most"), F.count(ROWS).alias("told"))
    return tries.filter("n = most and told = n").groupBy(key).agg(F.min(ATTEMPT).alias(ATTEMPT))


def read_whole(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The rows of whole units, each unit once."""
    attempts = read_attempts(spark, path)
    return None if attempts is None else attempts.join(whole_units(attempts, key), [key, ATTEMPT], "left_semi").drop(ROWS, ATTEMPT)


def resume(work: DataFrame, path: str, produce: Callable[[DataFrame], DataFrame], key: str, waves: int = 8, failed: Column | None = None) -> dict[str, int]:
    """Do the units of work that are not whole in the table at path yet. produce(units) gives the rows of some of them, with key.

    work: key, what produce needs, and `expected` if the number of a unit's rows is known. failed: condition on a produced row
    that spoils its unit. Returns units: whole (before), broken (tried before, never whole) and tried (now)."""
    spark, aside = work.sparkSession, scratch_folder(work.sparkSession)
    attempts = read_attempts(spark, path)
    known = "expected" in work.columns
    if attempts is None:
        before = {"whole": 0, "broken": 0}
        todo = work.dropDuplicates([key])
    else:
        whole = whole_units(attempts, key).select(key)
        # of the work's own units only; those of others are nobody's business here
        seen = work.select(key).distinct().join(attempts.select(key).distinct(), key, "left_semi").join(whole.withColumn("whole", F.lit(True)), key, "left")
        before = seen.agg(F.count("whole").alias("whole"), F.count_if(F.col("whole").isNull()).alias("broken")).first().asDict()
        todo = pending(work, whole, key)
    # written once: later waves must not see what earlier ones have done
    todo.withColumn("__wave", F.pmod(F.xxhash64(F.lit("wave"), key), F.lit(waves))).write.parquet(f"{aside}/todo")
    todo, tried = spark.read.parquet(f"{aside}/todo"), 0
    sizes = {r[0]: r[1] for r in todo.groupBy("__wave").count().collect()}
    for wave in sorted(sizes):
        rows = produce(todo.filter(F.col("__wave") == wave).drop("__wave"))
        own = Window.partitionBy(key)
        told = F.count(F.lit(1)).over(own)
        if known:
            rows = rows.drop("expected").join(todo.select(key, F.col("expected").cast("long").alias("__expected")), key)
            told = F.col("__expected")
        if failed is not None:
            told = F.when(F.max(F.coalesce(failed, F.lit(False))).over(own), None).otherwise(told)
        rows = rows.withColumn(ROWS, told.cast("long")).withColumn(ATTEMPT, F.lit(f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"))
        rows.drop("__expected").write.mode("append").partitionBy(ATTEMPT).parquet(path)
        tried += sizes[wave]
    return {**before, "tried": tried}


def scan_shards(spark: SparkSession, root: str, path: str, waves: int = 8, **options: str) -> dict[str, int]:
    """The members of all shards below root, in a table that a broken scan goes on with. Shards that could not be read are kept with
    their error and tried again by the next run. Options are those of the data source."""
    given = {"path": root, **options}
    shards, resolver = tar_shards.selected_shards(given), tar_shards.resolver_of(root, given)
    work = spark.createDataFrame([(s,) for s in shards], "shard string")
    columns = [c.split()[0] for c in tar_shards.SCHEMA.split(", ")]
    per_task = max(1, int(options.get("shardsPerTask", 1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["shard"]:
                rows = list(tar_shards.scan_shard(shard, resolver)) or [(shard, *(None,) * 5)]  # an empty archive is done, too
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=columns).astype({"offset": "Int64", "size": "Int64"})

    # a shard's cost is its number of requests, so tasks get so many shards each, whatever the size of their names
    tasks = max(1, -(-len(shards) // (waves * per_task)))
    return resume(work, path, lambda units: units.repartition(tasks, "shard").mapInPandas(run, tar_shards.SCHEMA), "shard", waves, F.col("error").isNotNull())

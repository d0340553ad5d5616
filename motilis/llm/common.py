"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract of this subpackage; its complement makes words.
WS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Most bytes of text that one Arrow batch handled by Python holds before it is cut into smaller ones.
BATCH_BYTES = 8 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; where it is unset, a temporary one on a local master, whose executors are this machine's own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            root = tempfile.mkdtemp(prefix="motilis-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_root(spark)}/motilis-{uuid.uuid4().hex[:12]}/{label}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df in the shared folder and read it back: later steps neither compute it again nor depend on the executors that made it."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes up to which a written table is broadcast to meet the texts; beyond it both sides are shuffled.
BROADCAST_BYTES = 8 << 20


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table, marked for broadcast if its rows take no more than `most` bytes, strings and binaries at their measured lengths."""
    row = F.lit(16 + 8 * len(df.columns))
    for f in df.schema:
        if f.dataType.typeName() in ("string", "binary"):
            row = row + F.coalesce(F.octet_length(f.name), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= most else df


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `most` bytes of text each, at least a row."""
    n = batch.num_rows
    if not n:
        return
    if batch.column(column).nbytes <= most:
        yield batch
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, k in enumerate(lengths):
        if held and held + k > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += k
    yield batch.slice(start, n - start)


def by_batch(f: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text") -> Callable:
    """A function for mapInArrow that applies f to pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column):
                yield f(piece)

    return run


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text with null as empty; other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

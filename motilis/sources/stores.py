"""JSONL stores with declared schemas, and their guards: closed sources, one provenance a file, failing fast on what does not parse."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

LABELS = "clip_id string, t_s double, corpus_rev string, fps_sampled double, label_source string, label_rev string, prompt_variant string, manipulation boolean, hands_visible int, unreadable_reason string"
DETECTIONS = "clip_id string, t_s double, mask_source string, boxes array<struct<x:double,y:double,width:double,height:double,score:double>>, failed_reason string"
MANIFEST = "factory_id string, worker_id string, clip_index int, shard string, byte_start long, byte_end long, duration_s double, fps double, width int, height int, codec string"
SPEEDS = "clip_id string, rms_speed_mm_s double, n_samples long, n_with_box long, n_flow_null long, coverage double, flow_null_rate double, status string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with seq, their order of writing; blank lines are skipped."""
    rows = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    parsed = rows.select("seq", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("seq", "r.*")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels; provenance is mandatory and there is exactly one of it in a file."""
    rows = read_jsonl(spark, path, LABELS)
    triple = F.struct("label_source", "label_rev", "prompt_variant")
    seen = rows.agg(F.countDistinct(triple).alias("n"), F.count_if(F.concat_ws("", "label_source", "label_rev", "prompt_variant").isNull() | (F.least(*(F.length(F.coalesce(F.col(c), F.lit(""))) for c in ("label_source", "label_rev", "prompt_variant"))) == 0)).alias("bare")).first()
    if seen.n != 1 or seen.bare:
        raise ValueError(f"{path}: {seen.n} label provenances, {seen.bare} rows without one")
    return rows


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections of one known detector."""
    rows = read_jsonl(spark, path, DETECTIONS)
    found = [r.mask_source for r in rows.select("mask_source").distinct().limit(10).collect()]
    if len(found) != 1 or found[0] not in K.MASK_SOURCES:
        raise ValueError(f"{path}: detectors {found}, one of {K.MASK_SOURCES} is expected")
    return rows


def write_jsonl(df: DataFrame, path: str, by: str | None = None) -> None:
    """Rebuilt as a whole; a partition column allows one clip's rows to be replaced."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(by) if by else writer).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents (claim, status) of a folder, a file each."""
    return spark.read.schema("claim string, status string, lo double, hi double").option("multiLine", True).json(path).select(F.col("claim").alias("claim_id"), "status", "lo", "hi")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir, which all executors share; where that is unset, a local one on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="motilis-")
    return f"{root.rstrip('/')}/motilis-{uuid.uuid4().hex[:12]}"

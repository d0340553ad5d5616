"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

A frequent-items sketch of the Misra-Gries family (`approx_top_k`, bounded by `tracked` counters a task) names the digests
that may be frequent. Their exact counts and first rows are then aggregated behind a map-side filter; at most `heavy` such
verified winners are broadcast and settle their rows without moving them. All other digests are dealt out by an ordinary
shuffle, in which no group can hold more than about rows / tracked rows.

Defined results: null text counts as empty; an empty table gives an empty result; a null doc_id comes after all others; of
rows that repeat both doc_id and text exactly one is kept; other columns, whatever their names, play no part in the decisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WS, cut, load

HEAVY = 256
TRACKED = 2048


def text_digest(text: Column) -> Column:
    """Binary SHA-256 of the text with each run of white space made one space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WS, " "), 256))


def dedup_decisions(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("rid"))
    return _decided(rows, heavy, tracked).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _decided(rows: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """rows (doc_id, digest, rid and what else they carry) with group_size and first, the doc_id and rid of the first row of their digest."""
    rows = cut(rows, "digests")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rid")
    names = rows.agg(F.expr(f"approx_top_k(hex(digest), {heavy}, {tracked})").alias("top"))
    names = names.select(F.explode("top").alias("t")).select(F.unhex("t.item").alias("digest"))
    winners = rows.join(F.broadcast(names), "digest", "left_semi").groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("first"))
    # at most `heavy` rows by construction of the sketch's answer, so the broadcast cannot grow with the data
    winners = cut(winners.filter("group_size > 1"), "winners")
    settled = rows.join(F.broadcast(winners), "digest")
    w = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rest = rest.withColumn("group_size", F.count(F.lit(1)).over(w)).withColumn("first", F.min(order).over(w))
    return settled.unionByName(rest)


def dedup(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows that share the smallest doc_id of their group, the one with the smallest hash of all its columns stays.

    Rows meet their decisions by doc_id and that hash in a plain join, at every size alike; rows equal in both are equal in all
    columns, so which of them stays makes no difference."""
    # the hash's place in the order is that of a row's number: rows of one hash are interchangeable
    mark = F.xxhash64(*docs.columns) if docs.columns else F.lit(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest"), mark.alias("rid"))
    decided = _decided(rows, heavy, tracked).groupBy(F.col("doc_id").alias("__id"), F.col("rid").alias("__mark")).agg(F.min((F.col("rid") == F.col("first.rid")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).alias("__kept"), F.count(F.lit(1)).alias("__n"))
    decided = cut(decided.filter("not __kept or __n > 1"), "decided")  # other rows simply stay
    repeated = decided.agg(F.max(F.col("__kept"))).first()[0]
    met = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__here") == F.col("__mark"))
    # merged at every size: what is true of a small table, that one side can be sent around, isn't of a large one
    left = docs.withColumn("__here", mark).join(decided.select("__id", "__mark").hint("merge"), met, "left_anti").drop("__here")
    if repeated:  # one of each set of equal rows that stay
        again = docs.withColumn("__here", mark).join(decided.filter("__kept").select("__id", "__mark").hint("merge"), met, "left_semi")
        left = left.unionByName(again.dropDuplicates(["doc_id", "__here"]).drop("__here"))
    return left


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_decisions(load(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size, text_sha256 FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

"""Text gates and reshaping of documents, a line a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (from 1), line."""
    return docs.select(F.col(key), F.posexplode(F.split(F.col(text), "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)


def placeholders(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Lines that still hold a placeholder."""
    return lines(docs.filter(F.col(text).rlike(K.PLACEHOLDER)), key, text).filter(F.col("line").rlike(K.PLACEHOLDER))


def cited_paths(docs: DataFrame, key: str, text: str, roots: list[str], declared: DataFrame) -> DataFrame:
    """Paths in backticks under known roots that no manifest declares. declared: path."""
    pattern = r"`((?:" + "|".join(roots) + r")/[^`\s]+)`"
    found = docs.select(F.col(key), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("path")).distinct()
    return found.join(declared.select("path").distinct(), "path", "left_anti").select(key, "path")


def frozen(files: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded files whose content's SHA-256 differs, or that are gone. files: path, content; recorded: path, sha256."""
    rows = recorded.join(files, "path", "left")
    return rows.filter(F.col("content").isNull() | (F.sha2("content", 256) != F.col("sha256"))).select("path", F.when(F.col("content").isNull(), "missing").otherwise("changed").alias("state"))


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    flat = F.regexp_replace(F.trim(F.col(text)), r"\s+", " ")
    return docs.select(F.col(key), F.explode(F.split(flat, r"(?<=[.!?]) ", -1)).alias("sentence")).filter("sentence != ''").distinct()


def amended(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Sentences of either version that the other lacks: key, sentence, change (removed, added)."""
    a, b = sentences(old, key, text), sentences(new, key, text)
    gone = a.join(b, [key, "sentence"], "left_anti").withColumn("change", F.lit("removed"))
    return gone.unionByName(b.join(a, [key, "sentence"], "left_anti").withColumn("change", F.lit("added")))


def unwrap(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Hard-wrapped prose joined to a line a block; fences, headings and table rows stay as they are, list items and quotes begin blocks. Runs of blank lines become one."""
    w = Window.partitionBy(key).orderBy("n")
    rows = lines(docs, key, text).withColumn("fence", F.col("line").rlike("^```"))
    rows = rows.withColumn("in_fence", (F.sum(F.col("fence").cast("int")).over(w) - F.col("fence").cast("int")) % 2 == 1)
    kind = (
        F.when(F.col("fence"), "verbatim")
        .when(F.col("in_fence"), "verbatim")
        .when(F.trim(F.regexp_replace("line", r"\s", " ")) == "", "blank")
        .when(F.col("line").rlike(r"^#{1,6}\s") | F.col("line").rlike(r"^\s*\|"), "single")
        .when(F.col("line").rlike(r"^\s*(?:[-*+]\s|\d+\.\s)") | F.col("line").rlike(r"^\s*>"), "item")
        .otherwise("prose")
    )
    rows = rows.withColumn("kind", kind)
    # prose goes on with the block before it if that is prose or an item
    goes_on = (F.col("kind") == "prose") & F.coalesce(F.lag("kind").over(w).isin("prose", "item"), F.lit(False))
    rows = rows.withColumn("block", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    part = F.when(F.col("kind") == "verbatim", F.col("line")).when(F.col("kind") == "blank", "").when(F.col("kind") == "single", F.regexp_replace("line", r"\s+$", "")).otherwise(strip(F.col("line")))
    blocks = rows.groupBy(key, "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", part.alias("part")))), lambda x: x.part), " ").alias("joined"))
    whole = blocks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "joined"))), lambda x: x.joined), "\n").alias("body"))
    return whole.select(key, F.concat(strip(F.regexp_replace("body", r"\n{3,}", "\n\n")), F.lit("\n")).alias("body"))


def strip_title(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Without the title on the first line, if there is one."""
    rest = F.regexp_replace(F.regexp_replace(F.col(text), r"\A# [^\n]*", ""), r"\A\n+", "")
    return docs.select(key, F.when(F.col(text).startswith("# "), rest).otherwise(F.col(text)).alias("body"))

"""Training-data pipeline over the documents table: each stage works on all that the stage before kept.

Each function takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from motilis.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from motilis.llm.common import cut, load


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null and empty texts are scored like others, as having no content; labels without a doc_id or a quality teach nothing; with labels of
    one kind only, or none, all rows stay; rows that repeat are judged alike; an empty table stays empty; other columns are carried along."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays.

    Null text counts as empty; a null doc_id comes after all others; of rows that share text and doc_id the one with the smallest hash of
    all its columns stays, one of equal ones; an empty table stays empty; other columns take no other part."""
    return exact_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id stays.

    Texts without words, null ones included, are nobody's copy and stay; one to four words are one shingle; a null doc_id comes after all
    others; of rows that repeat doc_id and text one stays; an empty table stays empty; other columns play no part."""
    return jaccard_join.drop_near_copies(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source is taken to its target, documents up to twice.

    A null source is a source of its own, the last; documents without words take none and are drawn like others; rows that repeat are
    drawn one by one; an empty table stays empty; other columns are carried along."""
    return mixing.mix(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document taken is encoded and decoded: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty, without tokens; a document taken twice has two rows; an empty table stays empty; other columns play no part."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mix_stage), ("bpe", encode_stage)]

#: A trained classifier, MinHash pruning and cube sampling are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

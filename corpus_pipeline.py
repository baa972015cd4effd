"""A training-corpus pipeline over ``documents``: each stage works on what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm._common import cut, table
from wattloom.llm.byte_bpe import round_trip
from wattloom.llm.exact_dedup import exact_dedup
from wattloom.llm.quality_model import quality_filter
from wattloom.llm.simhash_dedup import near_copies
from wattloom.llm.source_mix import apply_mix, mix_sources


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written out so that it stays the same, and the number's column."""
    name = f"row_{uuid.uuid4().hex}"
    return cut(docs.withColumn(name, F.monotonically_increasing_id())), name


def keep_one(docs: DataFrame, row: str, groups: DataFrame, largest: bool) -> DataFrame:
    """Of the rows of ``docs`` in each group (``groups``: row, group) the one with the largest or smallest doc_id, a row without an id only if there is no other."""
    ids = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"))
    rank = F.struct(F.col("id").isNull().alias("none"), (F.bitwise_not("id") if largest else F.col("id")).alias("id"), "row")
    kept = cut(groups.join(ids, "row").groupBy("group").agg(F.min(rank)["row"].alias(row)).select(row))
    return docs.join(kept, row, "left_semi").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; rows repeated with the same id, or all without one, leave one too."""
    docs, row = numbered(docs)
    groups = exact_dedup(docs.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group"))
    return keep_one(docs, row, groups, largest=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, a similarity of about 0.8), the one with the smallest doc_id; an id on two texts links nothing."""
    docs, row = numbered(docs)
    groups = near_copies(docs.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"))
    return keep_one(docs, row, groups, largest=False)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: taken / size, rounded along streams of a source; rows with no copy go."""
    docs, row = numbered(docs)
    return apply_mix(docs, cut(mix_sources(docs, row=row)), row).drop(row)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the token ids and of the decoded bytes."""
    return round_trip(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mix", mix), ("byte_bpe", tokens)]

#: SimHash groups are reached over links, the classifier is trained and merges are sequential: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are cut from their lineage before the next reads them.

    Null and empty texts are rejected by the first stage. Rows are told by a number of their own, so repeated ids and
    null ids are ordinary rows: an id on two texts stays twice, equal rows leave one. A null source is a source. Texts
    of any length go through whole. The result has a row per copy that the mix takes; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs

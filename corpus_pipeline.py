"""A corpus pipeline of five stages: language ID, near-dedup, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Stages that drop rows judge every
row by itself, under a key of their own, so that rows with the same doc_id or with none are judged as well. All stages take
null, empty, blank and very long texts, nulls in any column, repeated rows and further columns of any name; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, language, mixing, near_dup, sharding
from tidemill.llm.base import scratch, small, stored, table


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs, stored with a key for each row, and the key's name, which no other column has."""
    key = "row_key"
    while key.lower() in (c.lower() for c in docs.columns):
        key += "_"
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter (null, empty and blank ones too), and those whose language is ambiguous, go; all do when docs
    has no labelled text to learn from. Equal texts are judged alike."""
    return language.known_language(docs, language.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more, the one with the smallest doc_id stays, null last;
    of repeated rows one. Texts without words are in no group and stay."""
    rows, key = keyed(docs)
    found = near_dup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), percent=80)
    named = found.select(F.col("doc_id").alias(key), "component_id").join(rows.select(key, F.col("doc_id").alias("id")), key)
    named = stored(named, "named")
    order = F.struct(F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"), F.col(key).alias("stays"))
    groups = named.groupBy("component_id").agg(F.min(order).alias("x"), F.count("*").alias("n")).where("n > 1")
    groups = stored(groups.select("component_id", "x.stays"), "groups")
    gone = stored(named.join(small(groups), "component_id").where(F.col(key) != F.col("stays")).select(key), "gone")
    return rows.join(small(gone), key, "left_anti").drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Texts without words contain nothing and stay, as all do when there are no
    items; items without id count as any other."""
    rows, key = keyed(docs)
    items = table(spark, sf_dir, "benchmark").select(F.monotonically_increasing_id().alias("item_id"), "text")
    found = decontaminate.contained_items(rows.select(F.col(key).alias("doc_id"), "text"), stored(items, "benchmark"))
    gone = stored(found.select(F.col("doc_id").alias(key)).distinct(), "gone")
    return rows.join(small(gone), key, "left_anti").drop(key)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most three times. Null sources are one source. Texts without words come in
    whole copies of their source only; equal rows are taken as often as fits, each by itself."""
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each row in the shards; repeated rows and rows without doc_id have places of their own."""
    return sharding.shard_documents(docs, scratch(spark, "slot-map"))


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix_to_weights),
    ("shard", assign_shards),
]

#: Training a classifier and placing slots greedily are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs

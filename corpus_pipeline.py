"""Corpus pipeline: toxic documents out, one document of each near-duplicate group, secrets masked, packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.llm import common, packing, queries, secrets, simhash
from flowsentry.llm import toxicity as scorer
from flowsentry.session import materialize, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    common.prepare(spark)
    index = queries.toxicity_index(docs, common.table(spark, sf_dir, "labels"))
    return scorer.below(docs.select(*COLUMNS), index, queries.TOXIC_FROM)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component; one without doc_id only if no other has one.

    Rows without doc_id are told apart by a hash of all columns, above all ids. Rows that share a doc_id, or are equal
    in all columns, are one row where all columns are equal.
    """
    common.prepare(spark)
    unnamed = F.shiftrightunsigned(F.xxhash64(*COLUMNS), 2).bitwiseOR(F.lit(1 << 62))
    named = docs.select(*COLUMNS, F.coalesce("doc_id", unnamed).alias("_id"))
    found = simhash.near_duplicates(named.select(F.col("_id").alias("doc_id"), "text"), width=4, distance=4)
    member = materialize(found.select("doc_id", "component_id"), "members")
    first = member.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept")).distinct()
    several = member.groupBy(F.col("doc_id").alias("again")).count().where("count > 1").select("again")
    # As many ids as documents, so a merge join at any size.
    kept = named.join(first.hint("merge"), named["_id"] == first["kept"], "left_semi")
    if several.isEmpty():
        return kept.select(*COLUMNS)
    once = kept.join(several, kept["_id"] == several["again"], "left_anti").select(*COLUMNS)
    rest = kept.join(several, kept["_id"] == several["again"], "left_semi").select(*COLUMNS).dropDuplicates()
    return once.unionByName(rest)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    common.prepare(spark)
    return secrets.redact(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in token windows."""
    common.prepare(spark)
    return packing.pack(docs)


STAGES = [("toxicity", toxicity), ("simhash_dedup", simhash_dedup), ("secret_scan", secret_scan), ("packing", pack)]

#: Entropy scans, tokens and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

"""The corpus pipeline: quality rules, near-copy removal, decontamination, mixing, sharding; each stage a table.

Each row is judged by itself: ids that are null or repeated are told apart by their texts, and of rows that are equal one
passes the near-copy stage. Null, empty and blank texts have too few words for the quality rules and go there. Very long
texts are taken whole. An empty table gives no rows. Further columns of documents stay, whatever their names, but for
`shard`, `slot` and `grown_shard`, which the last stage replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm import decontaminate, mixing, ngram_join, quality_rules, sharding
from tracelens.llm.common import materialise, read_table, spare_names

SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, at 0.8 on 5-word shingles, the document with the smallest id stays."""
    return ngram_join.keep_one(docs, ngram_join.STAGE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks: not at all, once or twice."""
    return mixing.repeat_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, and the shard of each row with its place there; columns of these three names are replaced."""
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot", "grown_shard")]
    (tie,) = spare_names(docs, "tie")
    placed = sharding.assign_shards(docs.select(*own), SHARDS, grown=SHARDS + 1)
    tied = placed.withColumn(tie, F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("source"), F.lit(""))))
    return sharding.with_slots(tied, ties=(tie,)).select(*own, "shard", "slot", "grown_shard")


STAGES = [("quality rules", quality), ("near copies", near_copies), ("decontamination", decontamination), ("mixing", mix), ("sharding", shards)]

#: The first two stages, expectation-maximisation and connected components, aren't SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs

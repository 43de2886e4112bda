"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> documents, by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelore.llm.common import fold, settle
from tablelore.llm.decontamination import leaks
from tablelore.llm.mixing import mix
from tablelore.llm.parity_join import similar_groups
from tablelore.llm.sharding import assign_shards
from tablelore.llm.toxicity import fit, score

TOXIC = 0.7
SHARD_BYTES = 16 << 20


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not listed; rows without one stay."""
    return docs.join(settle(ids.select("doc_id").distinct(), "rejected"), "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches TOXIC. Learned from `labels` of documents whose crc32(doc_id) mod 3 is not 1. Null and empty texts stay."""
    model = fit(docs.where(fold(F.col("doc_id"), 3) != 1), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = score(docs.select(*(F.col(c).alias(f"d_{c}") for c in docs.columns)), model, "d_text").where(F.col("score") < TOXIC)
    return kept.select(*(F.col(f"d_{c}").alias(c) for c in docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group linked by five-word shingles at Jaccard 0.8. Rows that repeat an id keep one; rows without an id stay."""
    groups = settle(similar_groups(docs, width=5, threshold="0.8"), "groups")
    kept = _without(docs, groups.where("component_id <> doc_id"))
    repeated = settle(groups.groupBy("doc_id").count().where("count > 1"), "repeated")
    if repeated.isEmpty():
        return kept
    return _without(kept, repeated).unionByName(kept.join(repeated.select("doc_id"), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window similar to an item of `benchmark`. Null and empty texts stay, as do rows without an id; all rows of an id that repeats go if one has such a window."""
    return _without(docs, leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes its words, rounded: 0, 1 or 2 times. Documents without words go; rows without an id stay as they are."""
    taken = mix(docs.where("doc_id IS NOT NULL")).where("size > 0").groupBy("doc_id").agg(F.max(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int").alias("copies"))
    whole = docs.select("doc_id", F.struct(*docs.columns).alias("own"))  # so that no column of docs is taken for a count
    mixed = whole.join(taken.where("copies > 0"), "doc_id").withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("own.*")
    return mixed.unionByName(docs.where("doc_id IS NULL"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard. Null and empty texts count no bytes; null ids share a hash; rows that repeat are all kept. Columns with the names of the new ones are replaced."""
    return assign_shards(docs, SHARD_BYTES)

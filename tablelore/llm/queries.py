"""The registered queries of this subpackage: each runs its operator over the whole of its table and returns what its contract says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelore.llm.common import fold

SHARD_BYTES = 16 << 20


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    from tablelore.llm.parity_join import similar_groups

    return similar_groups(_table(spark, sf, "documents"), width=4, threshold="0.85")


def op2_nearest(spark: SparkSession, sf: str) -> DataFrame:
    from tablelore.llm.kmeans_tree import nearest

    rows = _table(spark, sf, "embeddings")
    return nearest(rows, rows.where("vec_id % 50 = 0"), k=5).withColumnRenamed("id", "vec_id")


def op3_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    from tablelore.llm.chat_tree import format_trees, read_trees

    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_trees(spark, format_trees(rows, paths=False))


def op4_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from tablelore.llm.bit_packing import crc32_of, read_docs, write_ids

    folder = write_ids(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_docs(spark, folder, crc32_of, "ids_crc32")


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    from tablelore.llm.byte_rnn import fit, predict

    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang", held.alias("held_out"))
    model = fit(docs.where("NOT held_out AND doc_id IS NOT NULL"))
    return predict(docs.select("doc_id", "held_out", "text"), *model)


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from tablelore.llm.toxicity import fit, score

    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    docs = _table(spark, sf, "documents").select("doc_id", "text", held.alias("held_out"))
    model = fit(docs.where("NOT held_out"), _table(spark, sf, "labels"))
    return score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_lattice_score(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from tablelore.llm.lattice_lm import score_texts

    held = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    docs = _table(spark, sf, "documents").select("doc_id", held.alias("held_out"), "text")
    return score_texts(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from tablelore.llm.decontamination import leaks

    return leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op8_sharding(spark: SparkSession, sf: str) -> DataFrame:
    from tablelore.llm.sharding import assign_shards

    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return assign_shards(docs, SHARD_BYTES).drop("text")


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    from tablelore.llm.mixing import mix

    return mix(_table(spark, sf, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")


def op11_align(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from tablelore.llm.token_alignment import align, with_counts

    aligned = align(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digests = aligned.withColumn("groups_sha256", F.coalesce(F.sha2("groups", 256), F.lit(""))).drop("groups")
    return with_counts(digests).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_passages(spark: SparkSession, sf: str) -> DataFrame:
    from tablelore.llm.passage_dedup import without_repeats

    kept = without_repeats(_table(spark, sf, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_manifest(spark: SparkSession, sf: str) -> DataFrame:
    from tablelore.llm.merkle import tampered_report

    return tampered_report(_table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_nearest, op3_chat_format, op4_token_ids, op5_language_id, op6_toxicity, op7_decontamination,
                                   op8_sharding, op9_lattice_score, op10_mixing, op11_align, op12_passages, op13_manifest)}

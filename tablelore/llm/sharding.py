"""Sharding by extendible hashing: a directory indexed by the leading bits of a hash, in which only oversized buckets split on another bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelore.llm.common import settle

BITS = 60


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as text; null counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def directory(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    """cell (first `depth` bits), bits, shard_depth, shard_bytes: for each cell of rows (h, n_bytes) the shallowest prefix that fits the limit; none where even the cell does not."""
    cells = rows.groupBy(F.shiftrightunsigned("h", BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("held"))
    paths = cells.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("bits", F.expr(f"shiftrightunsigned(cell, cast({depth} - d as int))"))
    fits = paths.groupBy("d", "bits").agg(F.sum("held").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    best = paths.join(fits, ["d", "bits"]).groupBy("cell").agg(F.min_by(F.struct("d", "bits", "shard_bytes"), "d").alias("s"))
    return best.select("cell", F.col("s.bits").alias("bits"), F.col("s.d").alias("shard_depth"), F.col("s.shard_bytes").alias("shard_bytes"))


def assign_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with n_bytes (UTF-8 bytes of the text), shard (its bits as text, `root` for none), shard_depth, shard_bytes.

    A shard is a prefix of the hash of the id whose rows hold at most limit_bytes, while its parent's rows hold more. Rows that share all bits
    (a repeated id) and exceed the limit together are told apart by a number and split on its hash, the shard's name then has both parts; a single
    row above the limit is a shard by itself. Null and empty texts have 0 bytes, null ids share one hash. No rows give no rows.
    Columns of docs with the names of the new ones are replaced.
    """
    new = ["n_bytes", "shard", "shard_depth", "shard_bytes"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    docs = docs.select(F.struct(*kept).alias("own"), size.alias("n_bytes"), hash_bits(F.col(id_col)).alias("_h"))  # so that no name of docs meets one of ours
    total = docs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    depth, out, todo = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + 6), [], docs
    while True:
        cells = settle(directory(todo.select(F.col("_h").alias("h"), "n_bytes"), depth, limit_bytes), "cells")
        tried = todo.withColumn("cell", F.shiftrightunsigned("_h", BITS - depth))
        name = F.when(F.col("shard_depth") == 0, F.lit("root")).otherwise(F.expr("lpad(bin(bits), shard_depth, '0')"))
        out.append(tried.join(cells, "cell").withColumn("shard", name).drop("cell", "bits"))
        if total <= limit_bytes:  # the root holds all
            break
        rest = tried.join(cells, "cell", "left_anti").drop("cell")
        if rest.isEmpty():
            break
        if depth == BITS:
            out.append(_same_hash(rest, limit_bytes))
            break
        todo, depth = settle(rest, "rest"), min(BITS, depth + 8)
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select("own.*", *new)


def _same_hash(rows: DataFrame, limit: int) -> DataFrame:
    """Rows whose hash exceeds the limit at full depth: split on the hash of a number each gets once."""
    rows = settle(rows.withColumn("_n", F.monotonically_increasing_id()), "numbered").withColumn("_g", hash_bits(F.col("_n")))
    held = rows.groupBy("_h").agg(F.sum("n_bytes").alias("_held"))
    rows = settle(rows.join(held, "_h").withColumn("_d", F.ceil(F.log2(F.col("_held") / limit)).cast("int") + 6), "numbered")
    base = F.expr("lpad(bin(_h), 60, '0')")
    paths = rows.withColumn("d", F.explode(F.sequence(F.lit(1), F.least("_d", F.lit(BITS))))).withColumn("bits", F.expr(f"shiftrightunsigned(_g, cast({BITS} - d as int))"))
    fits = paths.groupBy("_h", "d", "bits").agg(F.sum("n_bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    best = paths.select("_n", "_h", "d", "bits").join(fits, ["_h", "d", "bits"]).groupBy("_n").agg(F.min_by(F.struct("d", "bits", "shard_bytes"), "d").alias("s"))
    got = rows.join(best, "_n", "left")
    name = F.when(F.col("s").isNull(), F.concat(base, F.lit("-"), F.col("_n").cast("string"))).otherwise(F.concat(base, F.lit("-"), F.expr("lpad(bin(s.bits), s.d, '0')")))
    got = got.withColumn("shard", name).withColumn("shard_depth", F.lit(BITS) + F.coalesce("s.d", F.lit(0))).withColumn("shard_bytes", F.coalesce("s.shard_bytes", "n_bytes"))
    return got.drop("_n", "_g", "_held", "_d", "s")


def write_shards(docs: DataFrame, folder: str, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as Parquet below `folder`, one directory a shard, each written by one task of at most limit_bytes of text a shard."""
    assign_shards(docs, limit_bytes, id_col, text_col).repartition("shard").write.partitionBy("shard").parquet(folder)

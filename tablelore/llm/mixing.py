"""Mixing sources to target weights in equal-token blocks, in DataFrame operations only.

Sainte-Laguë hands blocks to sources by the highest quotients target / (2 i + 1), and a source's blocks to its shards in the same way. A shard
deals its documents out as one stream of words in seeded order and takes its quota as whole passes over the
stream and, for what is left, blocks in seeded order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelore.llm.common import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARD_WORDS = 1_000_000
BLOCK_WORDS = 1024
LEAST_BLOCKS = 16


def draw(*parts: Column) -> Column:
    """A number of 60 bits that the parts determine; null counts as empty."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sainte_lague(df: DataFrame, group: list[str], weight: str, seats: str, order: str) -> DataFrame:
    """df with `quota`: `seats` of each group handed out to its rows by the highest quotients weight / (2 i + 1), ties in `order`.

    A row's quota differs from its proportional share by at most half a seat and share * rows / (2 seats). Only the quotients within that
    distance are compared, about four a row, however many seats there are. Rows of weight 0 get none.
    """
    whole = Window.partitionBy(*group)
    df = df.withColumn("_m", F.count("*").over(whole)).withColumn("_w", F.sum(weight).over(whole))
    share = F.when((F.col("_w") > 0) & (F.col(seats) > 0), F.col(seats) * F.col(weight) / F.col("_w")).otherwise(0.0)
    away = F.when(F.col(seats) > 0, F.col("_share") * F.col("_m") / (2 * F.col(seats)) + 1.5).otherwise(0.0)
    df = df.withColumn("_share", share).withColumn("_away", away)
    df = df.withColumn("_low", F.greatest(F.floor(F.col("_share") - F.col("_away")), F.lit(0))).withColumn("_high", F.ceil(F.col("_share") + F.col("_away")))
    tries = df.where(F.col(weight) > 0).withColumn("_i", F.explode(F.sequence("_low", "_high"))).withColumn("_q", F.col(weight) / (2 * F.col("_i") + 1))
    left = F.col(seats) - F.sum(F.when(F.col("_i") == F.col("_low"), F.col("_low")).otherwise(0)).over(whole)
    tries = tries.withColumn("_left", left).withColumn("_at", F.row_number().over(whole.orderBy(F.desc("_q"), order)))
    won = tries.where(F.col("_at") <= F.col("_left")).groupBy(*group, order).agg(F.count("*").alias("_won"))
    quota = (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long")
    return df.join(won, [*group, order], "left").withColumn("quota", quota).drop("_m", "_w", "_share", "_away", "_low", "_high", "_won")


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size -> also ord (by code point, null last), weight, target. Targets are `share` of all sizes by weight, cut at `most` times the source's
    size; what is cut goes to the others by weight until none is above. One row a source, so one task."""
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    df = sources.withColumn("ord", number.cast("long")).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("ord") - 1) % len(weights) + 1).cast("int")))
    df = df.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_all", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    by_room = Window.orderBy(F.col("_cap") / F.col("weight"), "ord")
    taken = F.coalesce(F.sum("_cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    df = df.withColumn("_level", (F.col("_all") - taken) / rest).withColumn("_open", F.col("_cap") / F.col("weight") > F.col("_level"))
    level = F.max_by(F.when(F.col("_open"), F.col("_level")), F.when(F.col("_open"), -F.col("_cap") / F.col("weight"))).over(Window.partitionBy())
    return df.withColumn("target", F.when(F.col("_open"), level * F.col("weight")).otherwise(F.col("_cap"))).select("source", "source_size", "ord", "weight", "target")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """One row per document: its id, size (words), source, source_size, target (its source's, in words), taken (words of it in the mix, passes counted).

    Null text has size 0 and nothing taken; null is a source of its own; a null id is an id like any other. Rows that repeat are all mixed. Of each
    source the mix takes a whole number of blocks, within one block of its target, and never more than two passes. A block has
    BLOCK_WORDS words, fewer where the mean source's target is under 1024 blocks. A source whose target has fewer than LEAST_BLOCKS of these has smaller blocks of
    its own, at least one word each, and as many as come nearest to its target; the others share theirs by quotients. An empty table gives no rows. Other columns are ignored. The same rows and seed give the
    same result; documents of equal id and size in one source may stand for each other.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = settle(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size")), "sized")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    every = Window.partitionBy()
    block = F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK_WORDS)), F.floor(F.sum("target").over(every) / (1024 * F.count("*").over(every)))))
    own = F.greatest(F.lit(1), F.floor(F.col("target") / LEAST_BLOCKS)).cast("long")
    sources = sources.withColumn("block", block.cast("long")).withColumn("small", (F.col("target") > 0) & (own < F.col("block")))
    large = sources.where("NOT small").withColumn("blocks", F.floor(F.sum("target").over(every) / F.col("block") + 0.5)).withColumn("one", F.lit(1))
    large = sainte_lague(large, ["one"], "target", "blocks", "ord").withColumnRenamed("quota", "won").drop("blocks", "one")
    small = sources.where("small").withColumn("block", own).withColumn("won", F.floor(F.col("target") / F.col("block") + 0.5).cast("long"))
    sources = settle(large.unionByName(small).drop("small"), "sources")

    docs = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("id", "size", F.col("d.source").alias("source"), "source_size", "target", "ord", "block", "won")
    order = draw(F.lit(seed), F.col("id"))
    docs = docs.withColumn("h", order).withColumn("shard", F.col("h") % F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(1)))
    stream = Window.partitionBy("ord", "shard").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    dealt = settle(docs.where("size > 0").withColumn("a", F.coalesce(F.sum("size").over(stream), F.lit(0))), "dealt")
    streams = dealt.groupBy("ord", "shard").agg(F.sum("size").alias("held"), F.first("won").alias("won"), F.first("block").alias("block"))
    streams = sainte_lague(streams, ["ord"], "held", "won", "shard").withColumn("wanted", F.least(F.col("quota") * F.col("block"), 2 * F.col("held")))
    streams = settle(streams.withColumn("passes", F.floor(F.col("wanted") / F.col("held"))).withColumn("rest", F.col("wanted") - F.col("passes") * F.col("held")), "streams")

    blocks = streams.where("rest > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("held") - 1) / F.col("block")))))
    blocks = blocks.withColumn("words", F.least("block", F.col("held") - F.col("i") * F.col("block"))).withColumn("r", draw(F.lit(seed), F.col("ord"), F.col("shard"), F.col("i")))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("ord", "shard").orderBy("r", "i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("some", F.least("words", F.col("rest") - before)).where("some > 0").select("ord", "shard", "i", "some")
    cut = dealt.withColumn("i", F.explode(F.sequence(F.floor(F.col("a") / F.col("block")), F.floor((F.col("a") + F.col("size") - 1) / F.col("block")))))
    start = F.col("i") * F.col("block")
    part = F.greatest(F.least(F.col("a") + F.col("size"), start + F.col("some")) - F.greatest("a", start), F.lit(0))
    extra = cut.join(blocks, ["ord", "shard", "i"]).groupBy("ord", "shard", "a").agg(F.sum(part).alias("extra"))
    mixed = dealt.join(extra, ["ord", "shard", "a"], "left").join(streams.select("ord", "shard", "passes"), ["ord", "shard"])
    taken = (F.col("passes") * F.col("size") + F.coalesce("extra", F.lit(0))).cast("long")
    columns = [F.col("id").alias(id_col), "size", F.col("source").alias(source_col), F.col("source_size"), "target"]
    return mixed.select(*columns, taken.alias("taken")).unionByName(docs.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))

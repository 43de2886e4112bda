"""Benchmark decontamination in DataFrame operations only: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window as long as an item is similar to it only if they share a shingle, so windows are formed where a document's shingles meet
those of an item: every window of the item's size around such a place. A window's SimHash comes from running sums of packed bit counts, 16
longs with four 16-bit lanes each, so items may have up to 10,000 words. Fingerprints are cut into radius + 1 blocks; two fingerprints
within the radius agree in one of them, so the join over blocks finds all. What it finds is verified by the weighted Jaccard similarity of the two bags of shingles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelore.llm.common import settle

LANES, LANE = 16, 0x0001000100010001
FILES = 16  # of the tables made from the benchmark, which is small beside the documents


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: str, width: int) -> Column:
    """Hashes of all `width`-word shingles, in order; none if there are fewer words."""
    return F.when(F.size(w) >= width, F.expr(f"transform(sequence(1, size({w}) - {width} + 1), i -> xxhash64(slice({w}, i, {width})))")).otherwise(F.array().cast("array<long>"))


def _lanes(h: str) -> list[Column]:
    return [F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANE)).alias(f"l{k}") for k in range(LANES)]


def _fingerprint(weight: Column) -> Column:
    """The bits that more than half of the weight sets, from the lane sums l0 to l15: a lane of 2 * sum + 16383 - weight has bit 14 just then."""
    lift = (F.lit(16383) - weight).cast("long") * F.lit(LANE)
    marks = [F.shiftleft(F.shiftrightunsigned(F.col(f"l{k}") * 2 + lift, 14).bitwiseAND(F.lit(LANE)), k) for k in range(LANES)]
    return reduce(lambda x, y: x.bitwiseOR(y), marks)


def _blocks(radius: int) -> Column:
    """(block, its bits) for each of radius + 1 blocks of a fingerprint fp."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    cut = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.explode(F.array(*cut))


def _shared(a: str, b: str) -> Column:
    """Size of the intersection of two bags of shingles."""
    bag = F.expr(f"aggregate(array_distinct({a}), 0, (n, x) -> n + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))")
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(bag)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
          width: int = 5, threshold: float = 0.8, radius: int = 20) -> DataFrame:
    """doc_id, item_id, similarity, window_start: for each document and item the most similar item-sized window (the first, if several), where it reaches `threshold`.

    Words are lower-cased runs of letters and digits, shingles `width` words (an item of fewer words is one shingle); a shingle weighs what it occurs. A
    document shorter than the item is one window. window_start counts words from 0. Null, empty and wordless texts and
    rows without an id match nothing; rows that repeat an id are searched one by one and reported once. Other columns are ignored.

    At similarity 0.8 fingerprints are about 10 bits apart with a deviation under 3, so the radius of 20 loses next to nothing; within it nothing is lost.
    """
    parts = items.select(F.col(item_id_col).alias("item_id"), words(F.col(item_text_col)).alias("w")).where("item_id IS NOT NULL AND size(w) > 0")
    parts = settle(parts.withColumn("k", F.least(F.size("w"), F.lit(width))), "items")
    found = None
    for row in parts.select("k").distinct().orderBy("k").collect():  # at most `width` values
        one = _leaks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), parts.where(F.col("k") == row.k), row.k, threshold, radius)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = docs.select(F.col(id_col).alias("doc_id")).crossJoin(parts.select("item_id").limit(0)).select("doc_id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).cast("long").alias("window_start"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("window_start")).alias("s"))).alias("b"))
    return best.select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_id_col), "b.similarity", (-F.col("b.s")).alias("window_start"))


def _leaks(docs: DataFrame, items: DataFrame, width: int, threshold: float, radius: int) -> DataFrame:
    items = settle(items.select("item_id", shingles("w", width).alias("s")).withColumn("n", F.size("s")), "item-shingles")
    lanes = items.select("item_id", "n", F.explode("s").alias("h")).groupBy("item_id", "n").agg(*(F.sum(c).alias(f"l{k}") for k, c in enumerate(_lanes("h"))))
    marks = settle(lanes.select("item_id", "n", _fingerprint(F.col("n")).alias("fp")), "item-marks")
    index = settle(marks.select("*", _blocks(radius).alias("b")).select("item_id", "n", F.col("fp").alias("item_fp"), "b.*").coalesce(FILES), "item-blocks")

    # Where a run of shared shingles begins: the shingle is an item's, the one before is not the item's one before. One row a size of item is enough.
    anchors = items.select("n", "s", F.posexplode("s").alias("at", "h")).select("n", "h", F.when(F.col("at") > 0, F.expr("s[at - 1]")).alias("before")).distinct()
    anchors = settle(anchors.coalesce(FILES), "anchors")
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", words(F.col("text")).alias("w")).select("doc_id", shingles("w", width).alias("s"))
    # Outer: for the plain one Spark tests the size of the array in the scan, and so makes all shingles once more for each of them. What meets the
    # anchors is narrow, so that a benchmark too large to be broadcast costs a shuffle of places, not of texts.
    spots = rows.select("doc_id", "s", F.posexplode_outer("s").alias("pos", "h")).select("doc_id", "pos", "h", F.expr("case when pos > 0 then s[pos - 1] end").alias("prev"))
    starts = spots.join(anchors, "h").where(F.col("prev").isNull() | ~F.col("before").eqNullSafe(F.col("prev"))).groupBy("doc_id", "n").agg(F.collect_set("pos").alias("at"))
    starts = settle(starts, "starts")
    rows = docs.join(starts, "doc_id").select("doc_id", "n", "at", words(F.col("text")).alias("w")).select("doc_id", "n", "at", shingles("w", width).alias("s"))
    near = rows.select("doc_id", "n", "s", F.explode_outer("at").alias("pos"))
    near = near.withColumn("first", F.greatest(F.col("pos") - F.col("n") + 1, F.lit(0))).withColumn("last", F.least(F.col("pos") + 2 * F.col("n") - 2, F.size("s") - 1))
    runs = near.where("last >= first").select("doc_id", "n", "first", F.expr("slice(s, first + 1, last - first + 1)").alias("near"))
    runs = settle(runs.distinct().withColumn("run", F.monotonically_increasing_id()), "runs")

    # Running sums of the lanes over each run, which is shorter than three items; a window is the difference of two of them, in the same row.
    sums = [F.expr(f"aggregate(near, array(0L), (p, h) -> concat(p, array(element_at(p, -1) + (shiftrightunsigned(h, {k}) & {LANE}L)))) AS p{k}") for k in range(LANES)]
    spread = runs.select("run", "n", F.least("n", F.size("near")).alias("z"), F.size("near").alias("m"), *sums).where(F.col("z") >= F.col("n") * threshold)
    spread = spread.select("*", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("z"))).alias("at"))
    windows = spread.select("run", "n", "z", "at", *((F.expr(f"p{k}[at + z]") - F.expr(f"p{k}[at]")).alias(f"l{k}") for k in range(LANES)))
    windows = windows.select("run", "n", "z", "at", _fingerprint(F.col("z")).alias("fp"))

    probes = windows.select("*", _blocks(radius).alias("b")).select("run", "n", "z", "at", "fp", "b.*")
    near = probes.join(index, ["n", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
    near = near.select("run", "at", "z", "item_id").distinct().join(runs.select("run", "doc_id", "first", "near"), "run").join(items.select("item_id", F.col("s").alias("other"), F.col("n").alias("other_n")), "item_id")
    near = near.withColumn("own", F.expr("slice(near, at + 1, z)")).withColumn("both", _shared("own", "other"))
    similarity = F.col("both") / (F.col("z") + F.col("other_n") - F.col("both"))
    return near.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select("doc_id", "item_id", "similarity", (F.col("first") + F.col("at")).cast("long").alias("window_start"))

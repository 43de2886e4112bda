"""Set-similarity join of texts over parity sketches.

A document's distinct word shingles are hashed, and every hash is XOR-ed into one symbol of a sketch of m symbols, which
the hash chooses; a narrow copy of the sketch flips one bit a shingle. A shingle that two documents do not share changes at most one
symbol and one bit, so both Hamming distances are lower bounds of the size of the symmetric difference. Jaccard similarity t
allows a document of n shingles a difference of at most d = n(1-t)/t with any partner. Hence sketches of a linked pair agree in
all but d symbols, and among the d+1 symbols that come first in an order both share there is one they have in common: the pigeonhole
key. The order puts symbols made of many shingles first, because those hardly ever agree by chance.

Size bands are octaves of n, with one m each. A document whose largest possible partner lies in the next octave is
sketched there too, so that each pair meets in the octave of its larger member.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelore.llm.common import as_bytes, mix, settle, shingle_set
from tablelore.llm.components import components

FILTER_BITS = 1 << 24
SLICE = 1000
HUB = 500  # pairs of one document beyond which its row is repeated, once for so many pairs
CELLS = 1 << 22  # counts of shingles by hash: 4 MB, whatever the input
BLOCK = 1 << 16
CROWD = 32  # pairs a member beyond which a bucket's members meet by their rarest shingles instead


def sketch(shingles: np.ndarray, t: Fraction) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(octave, pigeonhole keys, bit sketch as words of 64 bits) for each size band the set takes part in; none if it is empty."""
    n = len(shingles)
    if not n:
        return
    d = int(n * (1 - t) / t)
    for octave in sorted({n.bit_length(), int(n / t).bit_length()}):
        m = int((1 << octave) * (1 - t) / t * Fraction(11, 10)) + 4
        symbol = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # not decreasing, as the set is sorted
        first = np.flatnonzero(np.concatenate(([True], symbol[1:] != symbol[:-1])))
        values, sizes = np.zeros(m, np.uint64), np.zeros(m, np.int64)
        held = symbol[first].astype(np.int64)
        values[held] = np.bitwise_xor.reduceat(mix(shingles, 0x51), first)
        sizes[held] = np.diff(np.append(first, n))
        keep = np.lexsort((np.arange(m), values, -sizes))[: d + 1]
        keys = mix(values[keep] ^ mix(keep.astype(np.uint64) + np.uint64(octave << 40)))
        width = 64 * (-(-4 * m // 64))
        bits = np.bincount((mix(shingles, 0xB17) % np.uint64(width)).astype(np.int64), minlength=width) & 1
        yield octave, keys.view(np.int64), np.packbits(bits.astype(np.uint8)).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of SLICE rows: what Python holds of a batch at once is a tenth or so of it."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _sketches(width: int, t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out: dict[str, list] = {k: [] for k in ("id", "n", "f", "g", "octave", "own", "keys", "bits")}
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if key is None:
                    continue
                s = shingle_set(text or b"", width)
                f = int(np.bitwise_xor.reduce(mix(s, 0xF), initial=np.uint64(0)).view(np.int64))
                g = int(np.add.reduce(mix(s, 0x6), initial=np.uint64(0), dtype=np.uint64).view(np.int64))
                for octave, keys, bits in list(sketch(s, t)) or [(0, [], [])]:
                    for name, value in zip(out, (key, len(s), f, g, octave, octave in (0, len(s).bit_length()), keys, bits), strict=True):
                        out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def _sets(width: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(wanted.value, np.uint8)
        for batch in _slices(batches):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            rows = np.flatnonzero(held[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            part = batch.take(pa.array(rows))
            sets = [shingle_set(x or b"", width).view(np.int64) for x in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    return run


def _id_filter(ids: DataFrame) -> bytes:
    """A bit for each id modulo FILTER_BITS: a prefilter of fixed size that lets every listed id through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in batches:
            at = (mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            for word, bit in zip((at >> 6).tolist(), (at & 63).tolist(), strict=True):
                held[word] = held.get(word, 0) | 1 << bit
        values = np.array(list(held.values()), np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(values)], names=["at", "word"])

    whole = np.zeros(FILTER_BITS // 64, np.int64)
    for row in ids.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas().itertuples():
        whole[row.at] = row.word
    return whole.tobytes()


def _close(t: Fraction) -> Column:
    """Sizes near enough, and bit sketches no further apart than the similarity allows."""
    p, q = t.numerator, t.denominator
    apart = F.aggregate(F.zip_with("x.bits", "y.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    n, m = F.col("x.n"), F.col("y.n")
    return (n * q >= m * p) & (m * q >= n * p) & (apart * (p + q) <= (n + m) * (q - p))


def _beside(pairs: DataFrame, x: DataFrame, y: DataFrame) -> DataFrame:
    """Pairs (a, b) with the columns of x, whose key is a, and of y, whose key is b. Pairs of a hub are spread over tasks; a side without hubs is a plain join."""
    hubs = pairs.selectExpr("stack(2, 'a', a, 'b', b) AS (side, id)").groupBy("side", "id").count().where(F.col("count") > HUB)
    hubs = settle(hubs.select("side", "id", F.ceil(F.col("count") / HUB).cast("int").alias("parts")), "hubs")
    crowded = {r.side for r in hubs.select("side").distinct().collect()}  # two at most
    met = pairs
    for side, table in (("a", x), ("b", y)):
        if side not in crowded:
            met = met.join(table, side)
            continue
        own = hubs.where(F.col("side") == side).select(F.col("id").alias(side), "parts")
        parts = F.coalesce("parts", F.lit(1))
        spread = met.join(own, side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), parts).cast("int")).drop("parts")
        rows = table.join(own, side, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        met = spread.join(rows, [side, "part"]).drop("part")
    return met


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, s: the shingle sets of the documents in question, made anew."""
    wanted = docs.sparkSession.sparkContext.broadcast(_id_filter(ids))
    sets = docs.where("id IS NOT NULL").mapInArrow(_sets(width, wanted), "id long, s array<long>").join(ids, "id", "left_semi")
    return settle(sets.distinct(), "sets")


def _verified(docs: DataFrame, pairs: DataFrame, width: int, t: Fraction) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets are similar enough."""
    sets = _sets_of(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), width)
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    met = _beside(pairs, sets.toDF("a", "sa"), sets.toDF("b", "sb"))
    return met.where(both * t.denominator >= union * t.numerator).select("a", "b").distinct()


def _frequencies(sets: DataFrame) -> bytes:
    """For each cell, a byte that grows with how many of the sets' shingles fall into it; 0 for none or one. So a shingle with 0 is in one set only.

    Counts of BLOCK neighbouring cells travel as one row for each slice of the sets; each block is summed up where its rows meet.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            at, held = np.unique(batch.column(0).flatten().to_numpy() & (CELLS - 1), return_counts=True)
            edges = np.flatnonzero(np.diff(at // BLOCK, prepend=-1))
            columns = [pa.array(at[edges] // BLOCK, pa.int32())]
            columns += [pa.ListArray.from_arrays(pa.array(np.append(edges, len(at)), pa.int32()), pa.array(x, pa.int32())) for x in (at % BLOCK, held)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "at", "count"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                sums.setdefault(block, np.zeros(BLOCK, np.int64))[at.values.to_numpy()] += held.values.to_numpy()
        levels = [np.minimum(8 * np.log2(np.maximum(x, 1)), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["block", "levels"])

    counts = sets.select("s").mapInArrow(count, "block int, at array<int>, count array<int>")
    whole = np.zeros(max(CELLS, BLOCK), np.uint8)
    for block, levels in counts.repartition("block").mapInArrow(total, "block int, levels binary").collect():
        whole[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(levels, np.uint8)
    return whole.tobytes()


def _prefixes(often, p: int, q: int):
    """The first shingles of each set, by (byte of its cell, value): as many as a larger similar set needs; early: as a smaller one needs. Those in one set only are no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(often.value, np.uint8)
        for batch in _slices(batches):
            values, edges = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy().cumsum()
            rows, shingles, places, early, sizes = [], [], [], [], []
            for row, s in enumerate(np.split(values, edges[:-1])):
                n, seen = len(s), held[s & (CELLS - 1)]
                first = np.lexsort((s, seen))[: n - (n * p + q - 1) // q + 1]
                at = np.flatnonzero(seen[first])
                rows.append(np.full(len(at), row))
                shingles.append(s[first[at]])
                places.append(at + 1)
                early.append(at < n - (2 * n * p + p + q - 1) // (p + q) + 1)
                sizes.append(np.full(len(at), n))
            if rows:
                own = batch.select([0, 1]).take(pa.array(np.concatenate(rows)))
                columns = [pa.array(np.concatenate(x)) for x in (sizes, shingles, places, early)]
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=["id", "own", "n", "shingle", "at", "early"])

    return run


def _by_rarest(docs: DataFrame, ids: DataFrame, roots: DataFrame, sketches: DataFrame, width: int, t: Fraction) -> DataFrame:
    """Pairs (a, b) of the listed documents, in different components and with close sketches, among which are all similar ones.

    With shingles in one order, a similar pair shares one that is among the first n - 2tn/(1+t) + 1 of the smaller set and among
    the first n - tn + 1 of the larger. Rare ones come first, as far as counts by CELLS tell (any order is right), and only these first ones of a set become rows: 1 - t of
    all. What a template gives to all its documents comes last, so those that are not similar do not meet.
    All that two sets share stands at or behind the first shingle they share. So a shingle makes a pair only where, in both sets, as many
    follow as the two sizes ask for, and where their sketches are close: near copies of one text that differ too much are compared there, but are no row. At least one of a
    pair is outside the component that has most of the shingle's sets; those inside meet only those outside.
    """
    p, q = t.numerator, t.denominator
    sets = _sets_of(docs, ids, width).withColumn("own", F.xxhash64("s"))  # an id that repeats may have several sets
    often = docs.sparkSession.sparkContext.broadcast(_frequencies(sets))
    first = sets.select("id", "own", "s").mapInArrow(_prefixes(often, p, q), "id long, own long, n long, shingle long, at long, early boolean")
    first = first.join(roots.withColumnRenamed("node", "id"), "id", "left").select("shingle", "id", "own", "n", "at", "early", F.coalesce("root", "id").alias("root"))
    first = settle(first, "first")
    each = first.groupBy("shingle", "root").agg(F.count("*").alias("c"), F.max("early").alias("early")).groupBy("shingle")
    each = each.agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("roots"), F.max("early").alias("early"))
    first = settle(first.join(each.where("roots > 1 AND early").select("shingle", F.col("most.root").alias("major")), "shingle"), "first")
    first = first.join(sketches.select("id", "n", "octave", "bits"), ["id", "n"])
    x = first.where("early").withColumn("outside", F.explode(F.expr("if(root = major, array(true), array(true, false))"))).alias("x")
    y = first.withColumn("outside", F.col("root") != F.col("major")).alias("y")
    near = "x.shingle = y.shingle AND x.outside = y.outside AND x.octave = y.octave AND x.root <> y.root AND struct(x.n, x.id, x.own) < struct(y.n, y.id, y.own)"
    common = f"({p} * (x.n + y.n) + {p + q - 1}) div {p + q}"  # that similar sets of these sizes share at least
    near += f" AND y.n * {p} <= x.n * {q} AND x.at + {common} <= x.n + 1 AND y.at + {common} <= y.n + 1"
    return x.join(y, F.expr(near) & _close(t)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: str = "0.8") -> DataFrame:
    """One row per document: its id, n_shingles (size of its set), component_id (smallest id it reaches by links, itself included).

    Two documents are linked when the Jaccard similarity of their sets of distinct `width`-word shingles reaches `threshold` (a
    decimal text, taken exactly). Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a text of fewer words is one shingle. Shingles
    are compared by 64-bit hashes. Null, empty and blank texts have an empty set and are linked with nothing. Rows without an id
    are left out. Rows that repeat an id are all returned and are one node, linked if any of their texts is. Other columns are ignored.

    Equal sets become one before any key is made. Every bucket of equal keys then links its members with its smallest and
    its largest one; only members of a bucket that are still in different components after that are compared with each other:
    those outside its largest component with all, where that is at most CROWD pairs a member. Members of more crowded buckets (documents of a template,
    say, that share keys without being similar) meet by their rarest shingles. So a large group of near copies or of a template costs rows in
    proportion to its size, and no link between components is missed.
    """
    t = Fraction(threshold)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = settle(docs.mapInArrow(_sketches(width, t), "id long, n long, f long, g long, octave int, own boolean, keys array<long>, bits array<long>"), "sketches")
    whole = made.where("own").select("id", "n", "f", "g")
    classes = made.where("n > 0").groupBy("n", "f", "g", "octave").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("bits").alias("bits"))
    spread = classes.select("id", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    buckets = settle(spread.join(shared, "key").select("key", "id", "lo", "hi"), "buckets")
    sketches = settle(classes.select("id", "octave", "n", "bits").join(buckets.select("id").distinct(), "id", "left_semi"), "bits")
    star = buckets.select(F.col("lo").alias("a"), F.col("id").alias("b")).union(buckets.select("id", "hi")).where("a <> b").distinct()
    side = lambda name, to: sketches.select(F.col("id").alias(name), F.struct("octave", "n", "bits").alias(to))
    close = lambda pairs: _beside(pairs, side("a", "x"), side("b", "y")).where("x.octave = y.octave").where(_close(t)).select("a", "b").distinct()
    tested = settle(close(settle(star, "star")), "pairs")
    heads = settle(whole.where("n > 0").groupBy("n", "f", "g").agg(F.min("id").alias("head")), "heads")  # a table of its own, so that adaptive execution splits the joins at a set with many copies
    held = whole.join(heads, ["n", "f", "g"]).select("id", "head")
    repeated = held.groupBy("id").agg(F.min("head").alias("lo"), F.max("head").alias("hi")).where("lo < hi").select("id")
    links = settle(_verified(docs, tested, width, t).union(held.join(repeated, "id", "left_semi")), "links")
    roots = components(links)

    labelled = buckets.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    sizes = labelled.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key")
    sizes = sizes.agg(F.sum("c").alias("size"), F.sum(F.col("c") * F.col("c")).alias("inner"), F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("roots"))
    mixed = sizes.where("roots > 1").select("key", (F.col("size") * F.col("size") - F.col("inner") > 2 * CROWD * F.col("size")).alias("crowded"), F.col("most.root").alias("major"))
    rest = settle(labelled.join(mixed, "key"), "mixed")
    members = rest.where("NOT crowded").join(sketches, "id").select("key", "id", "root", "major", "octave", "n", "bits")
    x, y = members.where("root <> major").alias("x"), members.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.octave") == F.col("y.octave")) & (F.col("x.root") != F.col("y.root"))
    once = (F.col("y.root") == F.col("y.major")) | (F.col("x.id") < F.col("y.id"))
    more = x.join(y, same & once & _close(t)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    crowd = settle(rest.where("crowded").select("id").distinct(), "crowd")
    if not crowd.isEmpty():
        more = more.union(_by_rarest(docs, crowd, roots, sketches, width, t))
    more = settle(more.distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        roots = components(links.union(_verified(docs, more, width, t)))
    heads = heads.join(roots.withColumnRenamed("node", "head"), "head", "left").select("n", "f", "g", F.coalesce("root", "head").alias("root"))
    return whole.join(heads, ["n", "f", "g"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))

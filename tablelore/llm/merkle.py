"""Merkle manifest of a table: a tree of digests a group, and one tree over the groups' roots.

The leaves of a group stand in the order of their ids. Every BLOCK consecutive nodes of a level are one row, which keeps them as one
string of hexadecimal digests, 64 characters each; the levels above them inside the block are made of it by hashing substrings
of fixed width, level by level. The blocks' top nodes are the next level's nodes, in blocks again, until one node a group is left. So
the number of passes is the logarithm of the largest group to the base BLOCK, and no task ever holds more than one block of a group.

A proof goes the other way. A block gives each of its nodes, a level at a time, the substrings on both sides of it in its run: the
segments between which its digest is put to get the parent. Segments above the block come from its parent block's row, so they are joined
once a block and not once a leaf, and no proof is ever shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelore.llm.common import settle

FANOUT = 16
LEVELS = 2  # levels made inside a block
BLOCK = FANOUT**LEVELS
HEX = 64


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(name: str) -> Column:
    """A value so written that no two rows read alike: `-` for null, else its length in bytes, a colon, its text."""
    text = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*names: str) -> Column:
    return digest(*map(field, names))


def _numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `at`, their place in their group from 0, found from ranges: a group may hold any share of the rows.

    Rows are dealt to tasks by ranges and sorted there; what is counted a task and group is all that is needed of the tasks before.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    placed = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id())
    placed = settle(placed.withColumn("task", F.shiftright("mid", 33)), "placed")
    runs = placed.groupBy("grp", "task").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    before = Window.partitionBy("grp").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    runs = runs.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    runs = runs.select(F.col("grp").alias("g"), F.col("task").alias("t"), "offset")
    joined = placed.join(runs, F.col("grp").eqNullSafe(F.col("g")) & (F.col("task") == F.col("t")))
    return joined.select(*nodes.columns, (F.col("mid") + F.col("offset")).alias("at"))


def _parents(level: Column) -> Column:
    """The next level's string: one digest for every run of FANOUT, the last run being what is left."""
    width = FANOUT * HEX
    runs = F.sequence(F.lit(0), ((F.length(level) - 1) / width).cast("int"))
    return F.concat_ws("", F.transform(runs, lambda i: F.sha2(F.substring(level, i * width + 1, F.lit(width)), 256)))


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row for BLOCK consecutive nodes (grp, at, node): grp, block, size of its group, levels (strings, the nodes themselves first), top.

    In a group of more than one block each block is folded LEVELS times, however few nodes it has; in a smaller one until one is left.
    """
    ordered = F.array_sort(F.collect_list(F.struct("at", "node")))
    rows = nodes.groupBy("grp", F.floor(F.col("at") / BLOCK).cast("long").alias("block")).agg(F.concat_ws("", F.transform(ordered, lambda x: x["node"])).alias("l0"))
    counts = rows.groupBy(F.col("grp").alias("g")).agg(F.max("block").alias("last"))  # a row a group
    rows = rows.join(counts, F.col("grp").eqNullSafe(F.col("g")))
    for i in range(LEVELS):
        more = (F.col("last") > 0) | (F.length(f"l{i}") > HEX)
        rows = rows.withColumn(f"l{i + 1}", F.when(more, _parents(F.col(f"l{i}"))))
    strings = [F.col(f"l{i}") for i in range(LEVELS + 1)]
    return rows.select("grp", "block", "last", F.array_compact(F.array(*strings)).alias("levels"), F.coalesce(*reversed(strings)).alias("top"))


def _tree(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of all levels, the leaves' first, until every group has one."""
    rounds = [settle(_blocks(nodes), f"{name}-0")]
    while not rounds[-1].where("last > 0").isEmpty():
        higher = rounds[-1].where("last > 0").select("grp", F.col("block").alias("at"), F.col("top").alias("node"))
        rounds.append(settle(_blocks(higher), f"{name}-{len(rounds)}"))
    return rounds


def _segments(at: Column, levels: Column) -> Column:
    """array<struct<left, right>> for node `at` of a block: what stands beside it in its run, a level at a time; empty at the top."""
    out = []
    for i in range(LEVELS):
        place = F.floor(at / FANOUT**i).cast("int")
        start, here = F.floor(place / FANOUT).cast("int") * (FANOUT * HEX), place * HEX
        level = F.get(levels, F.lit(i))
        left = F.substring(level, start + 1, here - start)
        right = F.substring(level, here + HEX + 1, start + (FANOUT - 1) * HEX - here)
        out.append(F.when(F.size(levels) > i + 1, F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*out))


def _proofs(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The leaves' blocks: grp, block, levels, path (segments above the block, up to the root of all), subroot.

    `above` has a row a group (g, beyond): the segments above the group's own root.
    """
    top = rounds[-1].where("last = 0").select("grp", "block", "levels", F.col("top").alias("subroot"))
    known = top.join(above, F.col("grp").eqNullSafe(F.col("g"))).select("grp", "block", "levels", F.col("beyond").alias("path"), "subroot")
    for lower in reversed(rounds[:-1]):
        high = known.select(F.col("grp").alias("g"), F.col("block").alias("b"), F.col("levels").alias("l"), F.col("path").alias("p"), "subroot")
        up = F.floor(F.col("block") / BLOCK).cast("long")
        inside = lower.where("last > 0").join(high, F.col("grp").eqNullSafe(F.col("g")) & (up == F.col("b")))
        path = F.concat(_segments(F.col("block") % BLOCK, F.col("l")), F.col("p"))
        inside = inside.select("grp", "block", "levels", path.alias("path"), "subroot")
        # groups that are one block at this round already have their root here
        alone = lower.where("last = 0").select("grp", "block", "levels", F.col("top").alias("subroot"))
        alone = alone.join(above, F.col("grp").eqNullSafe(F.col("g"))).select("grp", "block", "levels", F.col("beyond").alias("path"), "subroot")
        known = inside.unionByName(alone)
    return known


def fold(node: Column, path: Column) -> Column:
    """The root that a digest and its segments (left, right) lead to."""
    return F.aggregate(path, node, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(path: Column) -> Column:
    """The digests of a path one after the other, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def manifest(leaves: DataFrame) -> DataFrame:
    """For leaves (grp, id, leaf, any other columns): these and at (place in the group), path, subroot, root.

    A group's leaves ascend by id, nulls first, equal ids by leaf; equal rows are leaves of their own. While a group has several nodes, each 16
    consecutive ones become the digest of their strings put together, the last run having what is left; a lone leaf is its
    group's root. The roots, by group (null first, bytewise), are the leaves of one more tree, whose root is that of the table. path
    holds a struct (left, right) a level, from the leaf to the root: fold(leaf, path) is the root. No rows give no rows.
    """
    spare = [c for c in leaves.columns if c not in ("grp", "id", "leaf")]
    if taken := {"at", "block", "levels", "path", "subroot", "root", "mid", "task", "own"} & set(spare):
        raise ValueError(f"columns may not be called {', '.join(sorted(taken))}")
    own = F.struct(F.col("id"), *(F.col(c) for c in spare)).alias("own")
    nodes = settle(_numbered(leaves.select("grp", "id", F.col("leaf").alias("node"), own), ["id", "node"]).drop("id"), "nodes")
    rounds = _tree(nodes.select("grp", "at", "node"), "groups")
    roots = [r.where("last = 0").select(F.lit(0).alias("grp"), F.col("grp").alias("of"), F.col("top").alias("node")) for r in rounds]
    roots = settle(_numbered(reduce(DataFrame.unionByName, roots), ["of"]), "roots")
    upper = _tree(roots.select("grp", "at", "node"), "table")
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    one = upper[0].select(F.col("grp").alias("g")).distinct().withColumn("beyond", nothing)
    over = _placed(roots, _proofs(upper, one)).select(F.col("of").alias("g"), F.col("path").alias("beyond"), F.col("subroot").alias("root"))
    over = settle(over, "over")  # a row a group
    blocks = settle(_proofs(rounds, over.select("g", "beyond")), "blocks")
    out = _placed(nodes, blocks).join(over.select("g", "root"), F.col("grp").eqNullSafe(F.col("g")))
    return out.select("grp", "own.*", F.col("node").alias("leaf"), "at", "path", "subroot", "root")


def _placed(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """The nodes with subroot and their whole path."""
    high = blocks.select(F.col("grp").alias("bg"), "block", "levels", F.col("path").alias("p"), "subroot")
    at = F.floor(F.col("at") / BLOCK).cast("long") == F.col("block")
    joined = nodes.join(high, F.col("grp").eqNullSafe(F.col("bg")) & at)
    return joined.select(*nodes.columns, F.concat(_segments(F.col("at") % BLOCK, F.col("levels")), F.col("p")).alias("path"), "subroot")


def tampered_report(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id",
                    group_col: str = "source", text_col: str = "text", every: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of every row, and folded_root, verified: what a changed copy of some rows folds to.

    A leaf is the digest of `columns`, each `-` if null, else byte count, colon, value. Rows whose crc32 of the id as text divides by `every` are
    changed: A-Z of their text lower-cased; null texts stay, as do rows without an id. proof_sha256 is the digest of all siblings, level by level up
    to the root, left to right. Empty and null texts are values like others; equal rows are proved each at its own place; other columns are ignored.
    """
    changed = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(False))
    rows = docs.select(F.col(group_col).alias("grp"), F.col(id_col).alias("id"), leaf(*columns).alias("leaf"), *columns)
    rows = rows.withColumn(text_col, F.when(hit, changed).otherwise(F.col(text_col)) if id_col in columns else F.col(text_col))
    rows = rows.select("grp", "id", "leaf", leaf(*columns).alias("claimed"))
    proved = manifest(rows).withColumn("proof_sha256", F.sha2(siblings(F.col("path")), 256))
    proved = proved.withColumn("folded_root", fold(F.col("claimed"), F.col("path")))
    return proved.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

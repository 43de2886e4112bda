"""Chat formatting as prefix trees: conversations that begin with the same turns share those tokens.

Every distinct prefix of turns is a node. The nodes of a tree, all conversations with one first turn, are laid out depth first
as one sequence in which shared tokens stand once; a token's position id is its place in its own conversation, and a node's attention
intervals are the parts of the sequence that hold its ancestors and itself. Tokens here are the code points of the formatted text.

The child that most conversations go on with follows its parent at once, and so do its own descendants: such a chain is one run of the
sequence. A path changes chains only where at most half of the conversations go along, so it meets at most log2(conversations) + 1 of them, and
these, not the nodes of the path, are what a node's place and intervals are reckoned from. Everything else takes one row a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelore.llm.common import scratch_path, settle

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_IN_ROLE = re.compile(r"\\|###|</turn>|: ")
_TURN = re.compile(r"### ((?:[^\\:]|\\.|:(?! ))*): ((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, role: bool = False) -> str:
    """A backslash before every backslash and control string."""
    return (_IN_ROLE if role else _CONTROL).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_text(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it. Null counts as empty."""
    head = OPEN + escape(role or "", True) + MIDDLE
    body = escape(text or "")
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn begins at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each turn's node, from rows in order of conversation and turn. One digest and a few numbers go from row to row."""
    conv, digest, parent, tree, depth, position = None, b"", None, "", 0, 0
    for part in batches:
        out: dict[str, list] = {k: [] for k in ("conv_id", "depth", "node", "parent", "tree", "position", "text", "length", "loss_start", "loss_end")}
        for c, role, said in zip(part.conv_id, part.role, part.text, strict=True):
            if c != conv:
                conv, digest, parent, depth, position = c, b"", None, 0, 0
            text, start, end = turn_text(role, said)
            digest = hashlib.sha256(digest + text.encode("utf-8", "surrogatepass")).digest()[:16]
            node = digest.hex()
            tree = tree if depth else node
            loss = (start, end) if role == "assistant" else (0, 0)
            for k, v in zip(out, (c, depth, node, parent, tree, position, text, len(text), *loss), strict=True):
                out[k].append(v)
            parent, depth, position = node, depth + 1, position + len(text)
        yield pd.DataFrame(out)


def _offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sum of `total` over the rows before of the same `up` in this partition."""
    up, at = None, 0
    for part in batches:
        starts = []
        for chain, total in zip(part.up, part.total, strict=True):
            up, at = chain, at if chain == up else 0
            starts.append(at)
            at += total
        yield part.assign(local=starts)


def _before(chains: DataFrame) -> DataFrame:
    """node, up, total, depth -> node, up, before: the totals of those that branch off `up` deeper than the node, or equally deep with a smaller digest."""
    below = (-F.col("depth")).alias("below")
    ordered = chains.select("node", "up", "total", below).repartitionByRange("up", "below", "node").sortWithinPartitions("up", "below", "node")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    dealt = settle(ordered.mapInPandas(_offsets, "node string, up string, total long, below int, part int, local long"), "dealt")
    earlier = Window.partitionBy("up").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("up", "part").agg(F.sum("total").alias("held"))  # a row for each chain and partition it reaches into
    parts = parts.withColumn("base", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    return dealt.join(parts, ["up", "part"]).select("node", "up", (F.col("base") + F.col("local")).alias("before"))


def format_trees(conversations: DataFrame, folder: str | None = None, paths: bool = True) -> str:
    """Writes `nodes`, `conversations` and `paths` as Parquet below `folder` (a new shared one if none is given) and returns it.

    nodes: node, parent, tree, depth, text, length, start (in the tree's sequence), position (position id
    of its first token; the others follow), loss_start, loss_end (the part of its text under the loss mask, empty unless the role is
    `assistant`), attends (intervals of the sequence that hold its ancestors and itself, neighbours joined). With `paths` also path (nodes from the root to
    itself), whose space is quadratic in the turns of a conversation; nothing here reads it. conversations: conv_id, n_turns, tree, node.
    paths: end, depth, node, a row for each turn of each distinct whole conversation, which the node `end` ends.

    Input: conv_id, turn, role, text; a conversation's rows are put in order of turn, null first, then role and text, so that repeated turns all stay.
    Null text and role count as empty; rows without conv_id are left out; other columns are ignored; no rows give empty tables.
    """
    spark = conversations.sparkSession
    folder = folder or scratch_path(spark, "chat")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")  # the digests are the one pass in order of turns
    rows = rows.select("conv_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    schema = "conv_id long, depth int, node string, parent string, tree string, position long, text string, length long, loss_start int, loss_end int"
    made = settle(rows.mapInPandas(_prefixes, schema), "prefixes")
    same = ("parent", "tree", "depth", "position", "text", "length", "loss_start", "loss_end")
    nodes = settle(made.groupBy("node").agg(*(F.first(c).alias(c) for c in same), F.min("conv_id").alias("conv_id"), F.count("*").alias("n")), "nodes")

    # chains begin at the nodes that are not their parent's most frequent child; a conversation meets few of them
    heavy = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.max(F.struct("n", "node")).alias("most")).select(F.col("most.node").alias("node"))
    heads = nodes.select("node").join(heavy, "node", "left_anti")
    met = made.select("conv_id", "node", F.struct("depth", "node", "position").alias("head")).join(heads, "node").groupBy("conv_id").agg(F.sort_array(F.collect_list("head")).alias("heads"))
    above = F.filter("heads", lambda h: h["depth"] <= F.col("depth"))
    placed = nodes.select("conv_id", "node", "depth", "position", "length").join(met, "conv_id").withColumn("above", above)
    placed = settle(placed.withColumn("chain", F.element_at("above", -1)["node"]).drop("heads", "conv_id"), "placed")

    own = placed.groupBy("chain").agg((F.max(F.col("position") + F.col("length")) - F.min("position")).alias("own"))
    chains = settle(placed.where("node = chain").select("node", "depth", "above").join(own.withColumnRenamed("chain", "node"), "node"), "chains")
    totals = chains.select(F.explode("above.node").alias("node"), "own").groupBy("node").agg(F.sum("own").alias("total"))
    branches = chains.where(F.size("above") > 1).join(totals, "node").withColumn("up", F.element_at("above", -2)["node"])
    gaps = _before(branches).join(chains.select(F.col("node").alias("up"), "own"), "up").select("node", (F.col("own") + F.col("before")).alias("gap"))  # from the start of `up`
    steps = chains.select(F.col("node").alias("chain"), F.posexplode("above.node").alias("i", "node")).where("i > 0").join(gaps, "node")
    steps = steps.groupBy("chain").agg(F.sort_array(F.collect_list(F.struct("i", "gap")))["gap"].alias("gaps"))
    starts = F.expr("transform(sequence(0, size(above) - 1), i -> if(i = 0, 0L, aggregate(slice(gaps, 1, i), 0L, (s, g) -> s + g)))")
    chains = settle(chains.withColumnRenamed("node", "chain").join(steps, "chain", "left").select("chain", "above", starts.alias("starts")), "starts")

    spots = placed.select("node", "chain", "position", "length").join(chains, "chain")
    spots = spots.withColumn("start", F.element_at("starts", -1) + F.col("position") - F.element_at("above", -1)["position"])
    attends = F.expr("""transform(starts, (s, i) -> named_struct('start', s, 'end',
        if(i = size(starts) - 1, start + length, s + above[least(i + 1, size(starts) - 1)].position - above[i].position)))""")
    laid = nodes.drop("conv_id", "n").join(spots.select("node", "start", attends.alias("attends")), "node")  # texts travel for this alone
    if paths:
        upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        whole = made.select("conv_id", "node", F.collect_list("node").over(upto).alias("path"))
        laid = laid.join(nodes.select("node", "conv_id").join(whole, ["conv_id", "node"]).drop("conv_id"), "node")
    laid.write.parquet(f"{folder}/nodes")
    ends = settle(made.groupBy("conv_id").agg(F.max(F.struct("depth", "node", "tree")).alias("last")).select("conv_id", (F.col("last.depth") + 1).alias("n_turns"), "last.tree", "last.node"), "ends")
    ends.write.parquet(f"{folder}/conversations")
    told = ends.groupBy(F.col("node").alias("end")).agg(F.min("conv_id").alias("conv_id"))
    made.select("conv_id", "depth", "node").join(told, "conv_id").select("end", "depth", "node").write.parquet(f"{folder}/paths")
    return folder


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What read_trees says of each conversation, from its pieces in order; hashes and counts go from piece to piece."""
    columns = ["node", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    end, n, said, loss, lost, chars = None, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
    for part in batches:
        out = []
        for e, text, a, b in zip(part.end, part.text, part.loss_start, part.loss_end, strict=True):
            if e != end:
                if end is not None:
                    out.append((end, n, said.hexdigest(), lost, loss.hexdigest(), chars))
                end, n, said, loss, lost, chars = e, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, body in parse_turns(text):
                said.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                n += 1
            masked = unescape(text[a:b])
            loss.update(masked.encode("utf-8", "surrogatepass"))
            lost, chars = lost + len(masked), chars + len(text)
        yield pd.DataFrame(out, columns=columns)
    if end is not None:
        yield pd.DataFrame([(end, n, said.hexdigest(), lost, loss.hexdigest(), chars)], columns=columns)


def read_trees(spark, folder: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from the written tables alone."""
    nodes, ends = spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/conversations")
    pieces = spark.read.parquet(f"{folder}/paths").join(nodes.select("node", "text", "loss_start", "loss_end"), "node")
    pieces = pieces.select("end", "depth", "text", "loss_start", "loss_end").repartition("end").sortWithinPartitions("end", "depth").drop("depth")
    read = pieces.mapInPandas(_digests, "node string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return ends.select("conv_id", "node").join(read, "node").drop("node")

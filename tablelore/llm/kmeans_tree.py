"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is indexed by descending it. A query walks the tree with a priority
queue of the bins it has not opened, nearest centroid first, and visits leaves in that order. How many leaves is calibrated:
a bounded set of queries is compared with all vectors, and visits widen until the share of true neighbours found reaches the target.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelore.llm.common import settle

GRID = 2048  # vectors, and queries, that meet in one task at a time


@dataclass
class Tree:
    """centres: a unit vector a node; children: first child and their number; leaf: number of the leaf, -1 inside. Node 0 is the root."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    def descend(self, unit: np.ndarray) -> np.ndarray:
        """The leaf each unit vector belongs to."""
        at = np.zeros(len(unit), np.int64)
        while len(inner := np.unique(at[self.leaf[at] < 0])):
            for node in inner:
                rows = np.flatnonzero(at == node)
                kids = slice(self.first[node], self.first[node] + self.count[node])
                at[rows] = self.first[node] + np.argmax(unit[rows] @ self.centres[kids].T, axis=1)
        return self.leaf[at]

    def best_bins(self, unit: np.ndarray, leaves: int) -> list[int]:
        """The first leaves that a best-bin-first walk of one unit vector visits, in order."""
        near, found, queue = self.centres @ unit, [], [(-1.0, 0)]
        while queue and len(found) < leaves:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(int(self.leaf[node]))
            for kid in range(self.first[node], self.first[node] + self.count[node]):
                heapq.heappush(queue, (-near[kid], kid))
        return found


def _split(unit: np.ndarray, k: int, rng: np.random.RandomState, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of the rows: centres that hold a row, and the centre of each row."""
    centres = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    own = np.argmax(unit @ centres.T, axis=1)
    held, own = np.unique(own, return_inverse=True)
    return centres[held], own


def fit_tree(unit: np.ndarray, branching: int = 8, leaf_rows: int = 48, seed: int = 7) -> Tree:
    """A tree over the sample; a node is split while it holds more than leaf_rows sample rows that k-means can tell apart."""
    rng = np.random.RandomState(seed)
    centres, first, count, leaf = [np.zeros(unit.shape[1])], [0], [0], [-1]
    todo, leaves = [(0, unit)], 0
    while todo:
        node, rows = todo.pop()
        mids, own = _split(rows, min(branching, len(rows)), rng) if len(rows) > leaf_rows else (np.empty(0), None)
        if len(mids) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        first[node], count[node] = len(centres), len(mids)
        for i, mid in enumerate(mids):
            centres.append(mid)
            first.append(0)
            count.append(0)
            leaf.append(-1)
            todo.append((first[node] + i, rows[own == i]))
    return Tree(np.array(centres), np.array(first), np.array(count), np.array(leaf))


def _unit(vectors: pd.Series) -> np.ndarray:
    raw = np.stack([np.asarray(v, np.float64) for v in vectors])
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of each query with each row, in double precision; scaled first, so that no square overflows or vanishes."""
    q, r = (x / np.abs(x).max(axis=1, keepdims=True) for x in (queries, rows))
    return (q @ r.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(r, axis=1)[None, :])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of scores the k best columns: highest score, then smallest id. Equal scores at the edge are all looked at."""
    for i, row in enumerate(score):
        rows = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
        yield i, rows[np.lexsort((ids[rows], -row[rows]))[:k]]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
            recall: float = 0.97, sample_rows: int = 20_000, calibration_queries: int = 256) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest rows found for each query, other than the query's own row; ties to the smaller id.

    `queries` are rows of `vectors`, with the same columns. Vectors that are null, empty, zero or hold a null or non-finite component take no
    part, neither do rows without an id. Vectors of one length are searched among those of that length, each length with a tree of its own.
    Repeated (id, vector) rows count once. Equal vectors are indexed once with their k+1 smallest ids, which are all that a result can hold. An empty
    table gives no rows. Other columns are ignored. sample_rows bounds what a tree is fitted on, calibration_queries what is compared with all vectors.
    """
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def valid(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
        return df.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad).where(F.exists("v", lambda x: x != 0))

    own, asked = valid(vectors), valid(queries)
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    for r in asked.select(F.size("v").alias("n")).distinct().orderBy("n").collect():  # at most as many as the longest vector has components
        out = out.unionByName(_nearest_of(own.where(F.size("v") == r.n), asked.where(F.size("v") == r.n), k, recall, sample_rows, calibration_queries))
    return out


def _nearest_of(own: DataFrame, asked: DataFrame, k: int, recall: float, sample_rows: int, calibration_queries: int) -> DataFrame:
    """The same for valid vectors (id, v) of one length."""
    spark = own.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    own = own.distinct()
    ranked = own.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)
    classes = settle(ranked.groupBy("v").agg(F.min("id").alias("c"), F.sort_array(F.collect_list("id")).alias("ids")), "classes")
    asked = settle(asked.distinct().join(classes.select("v", "c"), "v").select("id", "c"), "asked")

    sample = classes.select("v").orderBy(F.xxhash64("c"), "c").limit(sample_rows).toPandas()
    tree = spark.sparkContext.broadcast(fit_tree(_unit(sample.v)))
    leaves = int(tree.value.leaf.max()) + 1

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield part.assign(leaf=tree.value.descend(_unit(part.v)))

    rows = settle(classes.select("c", "v").mapInPandas(index, "c long, v array<double>, leaf long"), "leaves")
    wanted = asked.select("c").distinct().join(rows, "c").select(F.col("c").alias("q"), "v")

    probe = wanted.orderBy(F.xxhash64("q"), "q").limit(calibration_queries).toPandas()
    if probe.empty:
        return empty
    truth = spark.sparkContext.broadcast((probe.q.to_numpy(), _matrix(probe.v)))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, qv = truth.value
        for part in batches:
            if not len(part):
                continue
            ids, leaf = part.c.to_numpy(), part.leaf.to_numpy()
            score = cosines(qv, _matrix(part.v))
            score[q[:, None] == ids[None, :]] = -2
            for i, best in _best(score, ids, k):
                yield pd.DataFrame({"q": q[i], "c": ids[best], "leaf": leaf[best], "score": score[i][best]})

    exact = rows.mapInPandas(compare, "q long, c long, leaf long, score double").where("score > -2")
    first = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    exact = exact.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k).select("q", "leaf").toPandas()
    order = {q: {leaf: i for i, leaf in enumerate(tree.value.best_bins(u, leaves))} for q, u in zip(probe.q, _unit(probe.v), strict=True)}
    needed = np.sort([order[q][leaf] + 1 for q, leaf in zip(exact.q, exact.leaf, strict=True)])
    visits = int(needed[int(np.ceil(recall * len(needed))) - 1]) if len(needed) else 1

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                yield part.assign(leaf=[tree.value.best_bins(u, visits) for u in _unit(part.v)])

    bins = settle(wanted.mapInPandas(walk, "q long, v array<double>, leaf array<long>"), "walks").withColumn("leaf", F.explode("leaf"))
    # at most as many rows as the tree has leaves, which the sample bounds
    grid = rows.groupBy("leaf").agg(F.ceil(F.count("*") / GRID).alias("down")).join(bins.groupBy("leaf").agg(F.ceil(F.count("*") / GRID).alias("across")), "leaf")
    grid = F.broadcast(grid)
    left = bins.join(grid, "leaf").withColumn("a", F.pmod(F.xxhash64("q"), "across")).withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("down") - 1)))
    right = rows.join(grid, "leaf").withColumn("d", F.pmod(F.xxhash64("c"), "down")).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("across") - 1)))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"q": [], "c": [], "score": []})
        q, c = x.q.to_numpy(), y.c.to_numpy()
        score = cosines(_matrix(x.v), _matrix(y.v))
        best = list(_best(score, c, k + 1))
        return pd.DataFrame({"q": np.concatenate([np.full(len(b), q[i]) for i, b in best]), "c": np.concatenate([c[b] for _, b in best]), "score": np.concatenate([score[i][b] for i, b in best])})

    cell = ["leaf", "a", "d"]
    met = left.select(*cell, "q", "v").groupBy(*cell).cogroup(right.select(*cell, "c", "v").groupBy(*cell)).applyInPandas(meet, "q long, c long, score double")
    found = met.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1).join(classes.select("c", "ids"), "c")
    found = settle(found.select(F.col("q").alias("c"), "score", F.explode("ids").alias("other")), "found")
    mine = asked.join(found, "c").where("other <> id").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other")))
    return mine.where(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", F.col("other").alias("id"), "score")

"""Removal of passages that an earlier document holds too, found by doubling the length of windows.

Level 0 takes windows of half the wanted length, at the places of least hash only (minimizers): every wanted window holds one of those of
its halves that begin in it, the same one wherever the window stands. Of each such place, only what occurs in several documents goes on.
A surviving place is a seed. At a seed the windows of once, twice, four times ... the wanted length are tested, one length after the other: only those
repeated at one length are extended to twice it, until no candidate survives. A level tells which stretches a document shares with an
earlier one. What no level settles, wanted windows around a seed that lie in no such stretch, is tested window by window.

A table of windows never meets itself: a window's first document is a minimum that tasks find before they shuffle, and is joined back. Windows are named by
their seed's hash and their own, 128 bits in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelore.llm.common import SPACES, as_bytes, mix, settle, word_hashes

_BASE = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
ROWS = 2000  # places of one text in a row, so that no row grows with its text


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """A value of every window of so many words, in place of its beginning; by doubling, so that no sum is taken twice."""
    out, have, todo = None, 0, words
    at, width = 0, 1
    n = len(words) - size + 1
    while at < size:
        if size & width:
            part = todo[at : at + n]
            out = part.copy() if out is None else out * _power(width) + part
            at += width
        if (have := width * 2) <= size:
            todo = todo[: len(todo) - width] * _power(width) + todo[width:]
        width = have
    return out


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """For every run of so many values the place of the least, the first of equals."""
    best, width = np.arange(len(values)), 1
    while width < size:
        step = min(width, size - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        width += step
    return best


def seeds(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of least hash, the hash of the half window at each, and after how many windows (by their beginning) each place stops being the least."""
    if len(words) < window:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none
    half = (window + 1) // 2
    values = mix(_windows(words, half), half)
    least = _least(values, window - half + 1)
    ends = np.append(np.flatnonzero(np.diff(least)) + 1, len(least))
    at = least[ends - 1]
    return at, values[at], ends


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _seeded(window: int):
    """(row key, text) to the different seeds of each text, in rows of at most ROWS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts = [], []
            for i, text in enumerate(as_bytes(batch.column(2))):
                found = _signed(np.unique(seeds(word_hashes(text or b"", lower=False), window)[1]))
                for a in range(0, len(found), ROWS):
                    at.append(i)
                    parts.append(found[a : a + ROWS])
            keys = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(parts, pa.list_(pa.int64()))], names=["doc", "sum", "seeds"])

    return run


def _located(window: int):
    """(row key, text, surviving seeds) to a row a place: seed, place, beginnings of the windows it is the least of, their values, those of the lengths at it."""
    names = ["doc", "sum", "seed", "place", "begin", "values", "levels"]

    def lists(sizes: np.ndarray, flat: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, known) in enumerate(zip(as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                words = word_hashes(text, lower=False)
                place, value, ends = seeds(words, window)
                starts = np.append(0, ends[:-1])
                kept = np.flatnonzero(np.isin(value, np.array(known, np.int64).view(np.uint64)))
                whole, size, grown = _windows(words, window), window, []
                while len(whole):
                    grown.append(_signed(mix(whole, size)))
                    whole, size = whole[: max(0, len(whole) - size)] * _power(size) + whole[size:], 2 * size
                for a in range(0, len(kept), ROWS):
                    part = kept[a : a + ROWS]
                    at, n = place[part], ends[part] - starts[part]
                    inner = np.repeat(starts[part] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())  # beginnings of the windows, one after the other
                    fits = sum((at < len(g)).astype(np.int64) for g in grown)
                    level = np.arange(fits.sum()) - np.repeat(np.append(0, np.cumsum(fits)[:-1]), fits)
                    flat, where = np.empty(len(level), np.int64), np.repeat(at, fits)
                    for k, g in enumerate(grown):
                        flat[level == k] = g[where[level == k]]
                    columns = [pa.array(_signed(value[part])), pa.array(at, pa.int32()), pa.array(starts[part], pa.int32()), lists(n, grown[0][inner]), lists(fits, flat)]
                    keys = [batch.column(c).take(pa.array([i] * len(part), pa.int64())) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*keys, *columns], names=names)

    return run


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first: those that occur in several documents, with the smallest of these."""
    both = rows.groupBy(*keys).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    return settle(both.where("first < last").drop("last"), "repeated")


def _spans(places: DataFrame, window: int) -> DataFrame:
    """doc, sum, begin, size: stretches that an earlier document holds; every wanted window that an earlier one holds lies in one."""
    alive = places.select("doc", "sum", "seed", "place", "levels")
    found, level = [], 0
    while True:  # one round a doubling
        tested = alive.where(F.size("levels") > level).withColumn("value", F.get("levels", F.lit(level)))
        again = _repeated(tested, ["seed", "value"])
        if again.isEmpty():
            break
        alive = settle(tested.join(again, ["seed", "value"]).drop("value"), f"level-{level}")
        found.append(alive.where("first < doc").select("doc", "sum", "place", F.lit(window << level).alias("size")))
        alive = alive.drop("first")
        level += 1
    if not found:
        shared = places.select("doc", "sum", "place", F.lit(0).alias("size")).limit(0)
    else:
        shared = found[0]
        for f in found[1:]:
            shared = shared.unionByName(f)
        shared = settle(shared.groupBy("doc", "sum", "place").agg(F.max("size").alias("size")), "shared")
    # how far stretches reach that begin before any window of a place
    half = window - (window + 1) // 2
    before = Window.partitionBy("doc", "sum").orderBy("place").rangeBetween(Window.unboundedPreceding, -half)
    marked = places.join(shared, ["doc", "sum", "place"], "left").withColumn("reach", F.coalesce(F.max(F.col("place") + F.col("size")).over(before), F.lit(0)))
    index = F.sequence(F.lit(0), F.size("values") - 1)
    open_ = F.filter(index, lambda i: (F.col("begin") + i + window > F.col("reach")) & ~((F.col("begin") + i == F.col("place")) & F.col("size").isNotNull()))
    open_ = F.transform(open_, lambda i: F.struct((F.col("begin") + i).alias("at"), F.get("values", i).alias("value")))
    single = settle(marked.select("doc", "sum", "seed", F.inline(open_)), "single")
    late = single.join(_repeated(single, ["seed", "value"]), ["seed", "value"]).where("first < doc")
    spans = late.select("doc", "sum", F.col("at").alias("begin"), F.lit(window).alias("size"))
    return spans.unionByName(shared.select("doc", "sum", F.col("place").alias("begin"), "size"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, sum, text: rows that share both id and text share all results."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("sum"), text.alias("text"))


def repeated_spans(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, sum (xxhash64 of the text), spans array<struct<begin, size>> in words: stretches all of whose windows also start in a document of a smaller id.

    Together the spans of a text hold every such window of `window` words [^\\x20\\x09-\\x0D]+, unchanged; they may overlap. Texts without any are left
    out, as are rows without an id, which neither lend nor lose words. A repeat inside one document, or between rows of one id, is none.
    Null and empty texts and texts of fewer words hold no window. Rows that repeat an id with the same text share one row.
    """
    rows = _keyed(docs, id_col, text_col).where("doc IS NOT NULL AND text IS NOT NULL")
    made = settle(rows.mapInArrow(_seeded(window), "doc long, sum long, seeds array<long>"), "seeds")
    found = made.select("doc", "sum", F.explode("seeds").alias("seed"))
    alive = found.join(_repeated(found, ["seed"]).select("seed"), "seed")
    known = alive.groupBy("doc", "sum").agg(F.collect_set("seed").alias("known"))  # as many as the text has places
    schema = "doc long, sum long, seed long, place int, begin int, values array<long>, levels array<long>"
    places = settle(rows.join(known, ["doc", "sum"]).select("doc", "sum", "text", "known").mapInArrow(_located(window), schema), "places")
    spans = _spans(places, window)
    return settle(spans.groupBy("doc", "sum").agg(F.array_sort(F.collect_set(F.struct("begin", "size"))).alias("spans")), "spans")


def _cut(text: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """The words outside the spans joined by one blank, number of words, number left out."""
    words = text.split()
    if not spans:
        return b" ".join(words), len(words), 0
    drop = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        drop[s["begin"]] += 1
        drop[s["begin"] + s["size"]] -= 1
    gone = np.cumsum(drop[:-1]) > 0
    return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g), len(words), int(gone.sum())


def without_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, kept (the words that stay, joined by one blank) for every row of docs; see repeated_spans.

    Windows are judged on the texts as they come, not on what is left. Null and empty texts have no words and keep an empty text. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_cut(text or b"", spans or []) for text, spans in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            kept = pa.array([r[0] for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), kept],
                                             names=["doc", "n_words", "n_removed", "kept"])

    if id_col in ("n_words", "n_removed", "kept"):
        raise ValueError(f"the id may not be called {id_col}")
    rows = _keyed(docs, id_col, text_col).join(repeated_spans(docs, window, id_col, text_col), ["doc", "sum"], "left")
    out = rows.select("doc", "text", "spans").mapInArrow(run, "doc long, n_words long, n_removed long, kept binary")
    return out.select(F.col("doc").alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))

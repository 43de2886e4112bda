"""Toxicity by a sparse logistic model whose scores may not depend on which group a sentence names.

Features are the distinct words of a text (runs of letters, lower-cased) and their beginnings, so that an insult is known in compounds too. Those
that differ most between the labels, by chi-square, are trained on. Training minimises cross entropy over labelled documents, an L1 penalty, and the squared change of the score between a labelled sentence that names a group and the same sentence with
the term swapped for others. A word that is toxic on its own keeps its weight; a group's name cannot get one that the other names lack.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelore.llm.common import settle

#: Group terms that may be swapped for one another.
IDENTITY_TERMS = tuple("""women men girls boys christians muslims jews hindus buddhists atheists catholics protestants black white asian latino
    african european american arab indian chinese mexican gay straight lesbian bisexual transgender immigrants refugees disabled deaf blind
    elderly young frauen männer christen juden muslime ausländer femmes hommes chrétiens juifs musulmans immigrés mujeres hombres
    cristianos judíos musulmanes inmigrantes""".split())  # fmt: skip
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """The word itself, marked, and its proper beginnings of 3 to 9 letters."""
    return ["=" + word, *(word[:k] for k in range(3, min(10, len(word))))]


def select(sets: list[set[str]], labels: np.ndarray, always: set[str], most: int, min_docs: int) -> dict[str, int]:
    """From the word sets of documents, numbers of the features kept: those in `always`, and the `most` of highest chi-square (ties by name) that min_docs documents have."""
    words = Counter(w for s in sets for w in s)
    frequent = {w for w, n in words.items() if n >= min_docs}
    del words
    seen, toxic = Counter(), Counter()
    for s, y in zip(sets, labels, strict=True):
        own = {f for w in s for f in features_of(w)[w not in frequent :]}  # a rare word counts by its beginnings alone
        seen.update(own)
        if y:
            toxic.update(own)
    names = sorted(f for f, n in seen.items() if n >= min_docs)
    n, a = np.array([seen[f] for f in names], float), np.array([toxic[f] for f in names], float)
    total, ones = len(sets), float(labels.sum())
    spread = n * (total - n) * ones * (total - ones)
    chi = total * (a * total - n * ones) ** 2 / np.maximum(spread, 1e-9)
    kept = {names[i] for i in np.lexsort((np.arange(len(names)), -chi))[:most]} | {f for f in always if f in seen}
    return {f: i for i, f in enumerate(sorted(kept))}


class _Rows:
    """Sparse 0/1 rows; a product with a vector of weights and its transpose."""

    def __init__(self, rows: Iterable[Iterable[int]], width: int):
        columns, lengths = array("i"), array("i")
        for r in rows:
            before = len(columns)
            columns.extend(r)
            lengths.append(len(columns) - before)
        self.width, self.n = width, len(lengths)
        self.columns = np.array(columns, np.int64)
        self.row = np.repeat(np.arange(len(lengths)), np.array(lengths, np.int64))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.columns], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, weights=g[self.row], minlength=self.width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _index(words: Iterable[str], vocabulary: dict[str, int]) -> list[int]:
    return sorted({vocabulary[f] for w in words for f in features_of(w) if f in vocabulary})


def _named(sentence: set[str], terms: set[str], vocabulary: dict[str, int]) -> tuple[str, list[int]] | None:
    """The first group term of a sentence and the numbers of its other words' features; None if it names no group."""
    named = min(sentence & terms, default=None)
    return None if named is None else (named, _index(sentence - {named}, vocabulary))


def _constant(labels: np.ndarray) -> tuple[float, dict[str, float]]:
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99))
    return float(np.log(share / (1 - share))), {}


def fit_words(texts: list[set[str]], labels: np.ndarray, sentences: list[set[str]] = (), terms: tuple[str, ...] = IDENTITY_TERMS, penalty: float = 4.0,
              features: int = 3000, sparsity: float = 4e-4, min_docs: int = 3, steps: int = 400, swaps: int = 4, seed: int = 11) -> tuple[float, dict[str, float]]:
    """(bias, weight of each feature that has one). sentences: word sets of labelled sentences; those with a group term are swapped. One label only: no weights."""
    vocabulary = select(texts, labels, {"=" + t for t in terms}, features, min_docs) if len(set(labels.tolist())) > 1 else {}
    if not vocabulary:
        return _constant(labels)
    said = [n for s in sentences if (n := _named(s, set(terms), vocabulary))]
    return _train([_index(t, vocabulary) for t in texts], labels, said, vocabulary, terms, penalty, sparsity, steps, swaps, seed)


def _train(rows: Iterable[Iterable[int]], labels: np.ndarray, said: list[tuple[str, Iterable[int]]], vocabulary: dict[str, int], terms: tuple[str, ...] = IDENTITY_TERMS,
           penalty: float = 4.0, sparsity: float = 4e-4, steps: int = 400, swaps: int = 4, seed: int = 11) -> tuple[float, dict[str, float]]:
    """fit_words from feature numbers. said: of each sentence that names a group, the term and the numbers of the rest."""
    x = _Rows(rows, len(vocabulary))
    rng, known = np.random.RandomState(seed), sorted(set(terms))
    own = {t: _index([t], vocabulary) for t in known}
    drawn = [(term, rest, rng.choice(known, swaps)) for term, rest in said]
    a = _Rows(({*rest, *own[term]} for term, rest, others in drawn for _ in others), len(vocabulary))
    b = _Rows(({*rest, *own[other]} for _, rest, others in drawn for other in others), len(vocabulary))
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())) / len(labels)
    w, c = np.zeros(len(vocabulary)), 0.0
    # Adam directions with a soft threshold of the same scale: few words keep a weight
    m, v, mc, vc, rate = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0.1
    for step in range(1, steps + 1):
        g = (_sigmoid(x.dot(w) + c) - labels) * balance
        grad, grad_c = x.back(g), g.sum()
        if a.n:
            pa, pb = _sigmoid(a.dot(w) + c), _sigmoid(b.dot(w) + c)
            change = 2 * penalty * (pa - pb) / a.n
            ga, gb = change * pa * (1 - pa), -change * pb * (1 - pb)
            grad, grad_c = grad + a.back(ga) + b.back(gb), grad_c + ga.sum() + gb.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mc, vc = 0.9 * mc + 0.1 * grad_c, 0.99 * vc + 0.01 * grad_c * grad_c
        scale = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        w = w - scale * m / (1 - 0.9**step)
        w = np.sign(w) * np.maximum(0, np.abs(w) - scale * sparsity)
        c -= rate * mc / (1 - 0.9**step) / (np.sqrt(vc / (1 - 0.99**step)) + 1e-4)
    names = list(vocabulary)
    return float(c), {names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-6)}


def _smallest(rows: DataFrame, most: int) -> DataFrame:
    """The `most` rows of each y with the smallest hash h, ties by k and t. Ranges of the hash are counted first, so that only the last one in question is sorted besides the rows kept."""
    part = F.shiftright("h", 52)
    ranges = sorted(rows.groupBy("y", part.alias("part")).agg(F.count("*").alias("n")).collect())  # 4096 a label at most
    kept = []
    for y in (0, 1):
        left, last = most, None
        for r in ranges:
            if r.y == y and left > 0:
                left, last = left - r.n, r.part
        kept.append(rows.where((F.col("y") == y) & (part <= F.lit(last).cast("long"))).orderBy("h", "k", "t").limit(most))
    return reduce(DataFrame.union, kept)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_per_label: int = 4000, terms: tuple[str, ...] = IDENTITY_TERMS,
        sentences_per_doc: int = 20, features: int = 3000, min_docs: int = 3) -> tuple[float, dict[str, float]]:
    """A model from a bounded sample: docs_per_label documents of each label, by smallest hash of the id, drawn from those of `docs` that have a label and a text.

    Null ids, labels and texts teach nothing and use up nothing; of two labels of one document the larger counts; rows that repeat id and text teach once.
    Of a document's sentences that name a group, sentences_per_doc are swapped, those whose words have the smallest hash. Features are counted and chosen in
    Spark; of the sample the driver gets the numbers of its chosen features alone.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("k")).agg(F.max(label_col).cast("int").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("text")).where("k IS NOT NULL AND text IS NOT NULL").withColumn("t", F.xxhash64("text"))
    labelled = settle(texts.select("k", "t").join(known, "k").distinct().withColumn("h", F.xxhash64("k")), "labelled")
    chosen = settle(_smallest(labelled, docs_per_label).select("k", "t", "y"), "chosen")
    picked = texts.join(chosen, ["k", "t"]).dropDuplicates(["k", "t"])
    named = set(terms)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            sets = [words_of(t) for t in part.text]
            said = [sorted((sorted(s) for x in _SENTENCE.split(t) if (s := words_of(x)) & named), key=lambda s: (zlib.crc32(" ".join(s).encode()), s))[:sentences_per_doc] if w & named else []
                    for t, w in zip(part.text, sets, strict=True)]
            yield pd.DataFrame({"k": part.k, "t": part.t, "y": part.y, "words": [sorted(w) for w in sets], "said": said})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, toxic = Counter(), Counter()
        for part in batches:
            for held, y in zip(part.words, part.y, strict=True):
                own = {f for w in held for f in features_of(w)}
                seen.update(own)
                if y:
                    toxic.update(own)
                if len(seen) > 200_000:
                    yield pd.DataFrame({"f": list(seen), "n": list(seen.values()), "a": [toxic[f] for f in seen]})
                    seen, toxic = Counter(), Counter()
        yield pd.DataFrame({"f": list(seen), "n": list(seen.values()), "a": [toxic[f] for f in seen]})

    sample = settle(picked.mapInPandas(words, "k long, t long, y int, words array<string>, said array<array<string>>"), "sample")
    total, ones = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < ones < total:
        return _constant(np.full(total, float(ones > 0)))
    counts = settle(sample.mapInPandas(counted, "f string, n long, a long").groupBy("f").agg(F.sum("n").cast("double").alias("n"), F.sum("a").cast("double").alias("a")).where(F.col("n") >= min_docs), "counts")
    total, ones = float(total), float(ones)
    off, spread = F.col("a") * total - F.col("n") * ones, F.col("n") * (total - F.col("n")) * ones * (total - ones)
    chi = total * (off * off) / F.greatest(spread, F.lit(1e-9))
    kept = {r.f for r in counts.orderBy(chi.desc(), "f").limit(features).collect()} | {r.f for r in counts.where(F.col("f").isin(["=" + t for t in terms])).collect()}
    vocabulary = {f: i for i, f in enumerate(sorted(kept))}

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            said = [[_named(set(s), named, vocabulary) for s in sentences] for sentences in part.said]
            yield pd.DataFrame({"k": part.k, "t": part.t, "y": part.y, "own": [_index(w, vocabulary) for w in part.words], "named": [[n for n, _ in s] for s in said], "rest": [[r for _, r in s] for s in said]})

    rows = sample.mapInPandas(numbered, "k long, t long, y int, own array<int>, named array<string>, rest array<array<int>>").toPandas().sort_values(["k", "t"])
    said = [(n, r) for names, rests in zip(rows.named, rows.rest, strict=True) for n, r in zip(names, rests, strict=True)]
    return _train(rows.own, rows.y.to_numpy(float), said, vocabulary, terms) if vocabulary else _constant(rows.y.to_numpy(float))


def score(docs: DataFrame, model: tuple[float, dict[str, float]], text_col: str = "text") -> DataFrame:
    """The rows with `score`, 0 to 1, from the whole text alone. Null and empty texts score as a text without a known word."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        bias, weights = shared.value
        known: dict[str, tuple[str, ...]] = {}  # what each word of this batch brings
        sums = np.empty(len(texts))
        for i, text in enumerate(texts):
            found: set[str] = set()
            for w in words_of(text):
                if w not in known:
                    known[w] = tuple(f for f in features_of(w) if f in weights)
                found.update(known[w])
            sums[i] = sum(weights[f] for f in sorted(found))
        return pd.Series(_sigmoid(sums + bias))

    return docs.withColumn("score", scored(F.col(text_col)))

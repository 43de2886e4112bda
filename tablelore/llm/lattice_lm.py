"""Language-model scores from a lattice of subword pieces.

The pieces are an existing vocabulary; a text's probability is the sum over all ways to write its words as pieces, by a forward
recursion in log space. Piece probabilities start from the scores the vocabulary comes with and are then fitted to
the training texts by expectation maximisation over the counts of all their words. Pieces never reach over white space, so a word's probability is
worked out once, however often it occurs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelore.llm.common import as_bytes, mix, settle

HEAD_WORDS = 200_000  # most frequent words whose values every task holds; all others are joined
LONG_WORD = 64
_SALT = 0x9E3779B97F4A7C15
_LONGEST = 64


class Pieces:
    """Byte strings of an existing vocabulary with log probabilities. A word begins with the byte for a blank; any byte is a piece of last resort."""

    def __init__(self, names: list[bytes], logp: np.ndarray):
        order = np.argsort(hashes := np.array([_hash_one(n) for n in names], np.uint64), kind="stable")
        self.hashes, self.names, self.logp = hashes[order], [names[i] for i in order], np.asarray(logp, float)[order]
        self.longest = min(_LONGEST, max(map(len, names)))
        self.of = {n: i for i, n in enumerate(self.names)}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece of each hash, -1 if there is none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def _hash_one(name: bytes) -> int:
    value = 0
    for b in name:
        value = (value * _SALT + b + 1) % (1 << 64)
    return int(mix(np.array([value], np.uint64), len(name))[0])


def load_pieces(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """Names (word mark as a blank) and starting log probabilities of a sentencepiece vocabulary. Its scores are ranks or log probabilities; ranks are read by Zipf's law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    scores: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i):
            continue
        name = model.id_to_piece(i).replace("▁", " ").encode("utf-8").lower()
        scores[name] = max(scores.get(name, -1e30), model.get_score(i))
    names = sorted(n for n in scores if b" " not in n[1:] and len(n) <= _LONGEST)
    score = np.array([scores[n] for n in names])
    weight = 1.0 / (64 - score) if score.min() < -1000 else np.exp(score)
    for b in range(256):
        if (one := bytes([b])) not in scores:
            names.append(one)
            weight = np.append(weight, weight.min())
    return names, np.log(weight / weight.sum())


def _lattice(words: np.ndarray, pieces: Pieces) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Arcs of words of one length (rows of bytes): (begin, end, rows, pieces), by end."""
    n, size = words.shape
    arcs = []
    values = np.zeros((n, size), np.uint64)  # of the piece that begins at each place
    by_end: dict[int, list] = {j: [] for j in range(1, size + 1)}
    for length in range(1, min(size, pieces.longest) + 1):
        starts = size - length + 1
        values = values[:, :starts] * np.uint64(_SALT) + words[:, length - 1 : length - 1 + starts].astype(np.uint64) + np.uint64(1)
        found = pieces.find(mix(values, length).ravel()).reshape(n, starts)
        for i in range(starts):
            rows = np.flatnonzero(found[:, i] >= 0)
            if len(rows):
                by_end[i + length].append((i, i + length, rows, found[rows, i]))
    for j in range(1, size + 1):
        arcs += by_end[j]
    return arcs


def marginals(words: list[bytes], pieces: Pieces, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log of each word's probability over all segmentations; with counts, also how often each piece is expected among so many of the words."""
    out, expected = np.empty(len(words)), None if counts is None else np.zeros(len(pieces.names))
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w) + 1, []).append(i)
    for size, members in groups.items():
        step = max(1, min(4096, (1 << 18) // size))
        for a in range(0, len(members), step):
            part = members[a : a + step]
            if size > LONG_WORD:
                for i in part:
                    out[i] = _one_long(b" " + words[i], pieces, expected, 0 if counts is None else counts[i])
                continue
            grid = np.frombuffer(b"".join(b" " + words[i] for i in part), np.uint8).reshape(len(part), size)
            arcs = _lattice(grid, pieces)
            forward = np.full((size + 1, len(part)), -np.inf)
            forward[0] = 0
            for i, j, rows, which in arcs:
                forward[j, rows] = np.logaddexp(forward[j, rows], forward[i, rows] + pieces.logp[which])
            out[part] = forward[size]
            if expected is not None:
                backward = np.full((size + 1, len(part)), -np.inf)
                backward[size] = 0
                weight = counts[part]
                for i, j, rows, which in reversed(arcs):
                    backward[i, rows] = np.logaddexp(backward[i, rows], backward[j, rows] + pieces.logp[which])
                for i, j, rows, which in arcs:
                    share = np.exp(forward[i, rows] + pieces.logp[which] + backward[j, rows] - forward[size, rows]) * weight[rows]
                    expected += np.bincount(which, weights=share, minlength=len(expected))
    return out, expected


def _one_long(word: bytes, pieces: Pieces, expected: np.ndarray | None, weight: float) -> float:
    """The same for one word of any length, arc by arc."""
    forward = np.full(len(word) + 1, -np.inf)
    forward[0] = 0
    arcs: list[tuple[int, int, int]] = []
    for j in range(1, len(word) + 1):
        into = [(i, j, p) for i in range(max(0, j - pieces.longest), j) if (p := pieces.of.get(word[i:j])) is not None]
        forward[j] = np.logaddexp.reduce([forward[i] + pieces.logp[p] for i, _, p in into])
        if expected is not None:
            arcs += into
    if expected is not None:
        backward = np.full(len(word) + 1, -np.inf)
        backward[-1] = 0
        for i, j, p in reversed(arcs):
            expected[p] += weight * np.exp(forward[i] + pieces.logp[p] + backward[j] - forward[-1])
            backward[i] = np.logaddexp(backward[i], backward[j] + pieces.logp[p])
    return float(forward[-1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts, with how often they occur in training texts and in all; summed up in the task first."""
    learn, every = Counter(), Counter()

    def out() -> pa.RecordBatch:
        words = list(every)
        columns = [pa.array(words, pa.binary()), pa.array([learn[w] for w in words], pa.int64()), pa.array([every[w] for w in words], pa.int64())]
        learn.clear()
        every.clear()
        return pa.RecordBatch.from_arrays(columns, names=["word", "c", "n"])

    for batch in batches:
        for text, held in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = Counter((text or b"").lower().split())
            every.update(words)
            if not held:
                learn.update(words)
            if len(every) > 400_000:
                yield out()
    if every:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), c (in training texts), n (in all texts) over all of docs (text, held_out)."""
    made = docs.select("text", "held_out").mapInArrow(_counted, "word binary, c long, n long")
    return made.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit_pieces(words: DataFrame, ends: int, start: tuple[list[bytes], np.ndarray], rounds: int) -> tuple[Pieces, float]:
    """Piece log probabilities after so many rounds of expectation maximisation over all counted words, and that of the end of a text.

    Every piece keeps a tenth of a count, so none becomes impossible. What a round returns is a row a piece and task, summed up by Spark.
    """
    names, logp = start
    spark = words.sparkSession
    pieces, end = Pieces(names, logp), -1.0
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((pieces.names, pieces.logp))

        def expect(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own, total = Pieces(*held.value), 0.0
            for batch in batches:
                got = marginals(as_bytes(batch.column(0)), own, batch.column(1).to_numpy(zero_copy_only=False).astype(float))[1]
                total = total + got
            if not np.isscalar(total):
                at = np.flatnonzero(total > 0)
                yield pa.RecordBatch.from_arrays([pa.array([own.names[i] for i in at], pa.binary()), pa.array(total[at])], names=["piece", "e"])

        got = words.where("c > 0").select("word", "c").mapInArrow(expect, "piece binary, e double").groupBy("piece").agg(F.sum("e").alias("e")).toPandas()
        counts = np.full(len(pieces.names), 0.1)
        for name, e in zip(got.piece, got.e, strict=True):
            counts[pieces.of[bytes(name)]] += round(e, 6)
        whole = counts.sum() + ends + 0.1
        pieces, end = Pieces(pieces.names, np.log(counts / whole)), float(np.log((ends + 0.1) / whole))
    return pieces, end


def score_texts(docs: DataFrame, pieces_file: str, text_col: str = "text", held_col: str = "held_out", rounds: int = 2) -> DataFrame:
    """The rows of docs, the text left out, with n_tokens, n_known, train_tokens, base_score, score.

    Tokens: words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end a text. Learned from rows whose held_col is false. base_score sums
    log10((c + 1) / (N + V + 1)) over the tokens: c the token's count, N all tokens, V the different ones, in training texts. score
    is the lattice model's log10 probability of the text. Null texts count as empty: an end alone. Null in held_col counts as held out.
    No rows give no rows; with nothing to learn from, the base is 0 and the vocabulary's own scores stand. Columns of docs with the names of the new
    ones are replaced. Pieces of over 64 bytes and those with a blank inside are not used: no word holds the latter.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in (text_col, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(held_col).cast("boolean"), F.lit(True)).alias("held_out"), F.struct(*rest).alias("own"))
    words = settle(word_counts(rows), "words")
    ends = rows.where("NOT held_out").count()
    sums = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums.n + ends, sums.v + (ends > 0)
    base_of = lambda c: np.log10((np.asarray(c, float) + 1) / (total + distinct + 1))
    pieces, end = fit_pieces(words, ends, load_pieces(pieces_file), rounds)
    model = spark.sparkContext.broadcast((pieces.names, pieces.logp))

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pieces(*model.value)
        for batch in batches:
            value = marginals(as_bytes(batch.column(0)), own)[0] / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value)], names=["word", "c", "n", "p"])

    words = settle(words.mapInArrow(valued, "word binary, c long, n long, p double"), "valued")
    head = words.orderBy(F.desc("n"), "word").limit(HEAD_WORDS).select("word", "c", "p").toPandas()
    known = spark.sparkContext.broadcast({bytes(w): (int(c), float(b), float(p)) for w, c, b, p in zip(head.word, head.c, base_of(head.c), head.p, strict=True)})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known.value
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "tail")}
            for text in as_bytes(batch.column(0)):
                words = Counter((text or b"").lower().split())
                n, base, p, tail = 0, 0.0, 0.0, []
                for w, k in words.items():
                    if v := held.get(w):
                        n += k * (v[0] > 0)
                        base += k * v[1]
                        p += k * v[2]
                    else:
                        tail.append({"word": w, "k": k})
                for name, value in zip(out, (sum(words.values()), n, base, p, tail), strict=True):
                    out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], names=["own", *out])

    kind = rows.schema["own"].dataType.simpleString()
    part = rows.select("text", "own").mapInArrow(scored, f"own {kind}, n_tokens long, n_known long, base_score double, score double, tail array<struct<word: binary, k: bigint>>")
    part = settle(part.withColumn("row", F.monotonically_increasing_id()), "scored")  # numbered once, as rows may repeat
    tail = part.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.k").join(words.select("word", "c", "p"), "word")
    tail = tail.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tk"), F.sum(F.col("k") * F.log10((F.col("c") + 1) / F.lit(float(total + distinct + 1)))).alias("tb"), F.sum(F.col("k") * F.col("p")).alias("tp"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = part.drop("tail").join(tail, "row", "left")
    return whole.select("own.*", (F.col("n_tokens") + 1).alias("n_tokens"), (F.col("n_known") + zero("tk") + int(ends > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                        (F.col("base_score") + zero("tb") + float(base_of(ends))).alias("base_score"), (F.col("score") + zero("tp") + end / float(np.log(10))).alias("score"))

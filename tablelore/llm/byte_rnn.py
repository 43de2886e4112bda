"""Language identification by a bidirectional gated recurrent network over bytes, written in numpy.

Texts are read as windows of bytes (A-Z lower-cased), one network run a window in each direction. Every position gets
a probability for each language; a document's probabilities are the mean over all positions of its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelore.llm.common import as_bytes, in_chunks

WINDOW = 128
BATCH = 2048
SPAN = 1 << 30  # steps of the hash that documents are sampled by
CANDIDATES = 4  # times as many documents as wanted lie below the limit


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


class Network:
    """For each direction: update and reset gates from (state, byte, 1), a candidate from (reset * state, byte, 1); then one linear layer over both states."""

    def __init__(self, classes: int, hidden: int = 12, width: int = 6, seed: int = 3):
        rng, (h, e) = np.random.RandomState(seed), (hidden, width)
        self.h, self.e = h, e
        draw = lambda *shape, scale: (rng.randn(*shape) * scale).astype(np.float32)
        self.p = {"embed": draw(e, 256, scale=0.5), "out": draw(classes, 2 * h, scale=0.3), "bias": np.zeros((classes, 1), np.float32)}
        for d in (0, 1):
            self.p[f"gates{d}"] = draw(2 * h, h + e + 1, scale=0.35)
            self.p[f"cand{d}"] = draw(h, h + e + 1, scale=0.35)

    def states(self, idx: np.ndarray, kept: list | None = None) -> np.ndarray:
        """Both directions' states at each position of windows idx (positions, windows): (positions, 2 hidden, windows). kept: gets what training needs."""
        steps, n = idx.shape
        h, e = self.h, self.e
        out = np.empty((steps, 2 * h, n), np.float32)
        for d in (0, 1):
            z = np.zeros((h + e + 1, n), np.float32)
            z[-1] = 1
            gates, cand, spare = np.empty((2 * h, n), np.float32), np.empty((h, n), np.float32), np.empty((h, n), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                np.take(self.p["embed"], idx[t], axis=1, out=z[h : h + e], mode="clip")
                np.matmul(self.p[f"gates{d}"], z, out=gates)
                _sigmoid(gates)
                before = z[:h].copy()
                z[:h] *= gates[h:]
                np.matmul(self.p[f"cand{d}"], z, out=cand)
                np.tanh(cand, out=cand)
                if kept is not None:
                    kept.append((d, t, before, z.copy(), gates.copy(), cand.copy()))
                np.subtract(cand, before, out=spare)
                spare *= gates[:h]
                np.add(before, spare, out=z[:h])
                out[t, d * h : d * h + h] = z[:h]
        return out

    def probabilities(self, idx: np.ndarray) -> np.ndarray:
        """Of each language at each position: (positions, languages, windows)."""
        x = np.matmul(self.p["out"], self.states(idx))
        x += self.p["bias"]
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
        return x

    def gradients(self, idx: np.ndarray, label: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the real positions, and its gradients by backpropagation through time."""
        kept: list = []
        s = self.states(idx, kept)
        h, e, p = self.h, self.e, self.p
        x = np.matmul(p["out"], s) + p["bias"]
        x -= x.max(axis=1, keepdims=True)
        y = np.exp(x)
        y /= y.sum(axis=1, keepdims=True)
        at = np.arange(idx.shape[1])
        weight = real.astype(np.float32) / max(1, real.sum())
        loss = -float((np.log(y[:, label, at] + 1e-9) * weight).sum())
        y[:, label, at] -= 1
        y *= weight[:, None, :]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"] = np.einsum("tcn,thn->ch", y, s, optimize=True)
        g["bias"] = y.sum(axis=(0, 2))[:, None]
        into = np.matmul(p["out"].T, y)
        carried = {0: 0.0, 1: 0.0}
        for d, t, before, z, gates, cand in reversed(kept):
            dh = into[t, d * h : d * h + h] + carried[d]
            u, r = gates[:h], gates[h:]
            dc = dh * u * (1 - cand * cand)
            g[f"cand{d}"] += dc @ z.T
            dz = p[f"cand{d}"].T @ dc
            dgates = np.concatenate([dh * (cand - before) * u * (1 - u), dz[:h] * before * r * (1 - r)])
            zg = z.copy()
            zg[:h] = before
            g[f"gates{d}"] += dgates @ zg.T
            dzg = p[f"gates{d}"].T @ dgates
            carried[d] = dh * (1 - u) + dz[:h] * r + dzg[:h]
            demb = dz[h : h + e] + dzg[h : h + e]
            for i in range(e):
                g["embed"][i] += np.bincount(idx[t], weights=demb[i], minlength=256).astype(np.float32)
        return loss, g


def _windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, zero padded (windows, size); which text each is of; how many bytes it has."""
    counts = np.array([-(-len(x) // size) for x in texts], np.int64)
    padded = b"".join(x.ljust(c * size, b"\0") for x, c in zip(texts, counts, strict=True))
    owner = np.repeat(np.arange(len(texts)), counts)
    last = np.cumsum(counts)[counts > 0] - 1
    lengths = np.full(len(owner), size, np.int64)
    lengths[last] = [len(x) - (c - 1) * size for x, c in zip(texts, counts, strict=True) if c]
    return np.frombuffer(padded, np.uint8).reshape(-1, size), owner, lengths


def train(windows: list[bytes], labels: np.ndarray, classes: int, steps: int = 400, batch: int = 256, seed: int = 5) -> Network:
    """A network trained on the windows by Adam, as many of each label in a batch as of any other."""
    net, rng = Network(classes), np.random.RandomState(seed)
    x, _, lengths = _windows(windows, max(map(len, windows)))
    real = np.arange(x.shape[1])[:, None] < lengths[None, :]
    by = [np.flatnonzero(labels == c) for c in range(classes)]
    m, v = ({k: np.zeros_like(p) for k, p in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(b, max(1, batch // classes)) for b in by])
        _, g = net.gradients(x[rows].T.astype(np.int64), labels[rows], real[:, rows])
        scale = min(1.0, 1.0 / (1e-9 + np.sqrt(sum(float((a * a).sum()) for a in g.values()))))
        rate = 0.02 * min(1, step / 20) * (1 - 0.95 * step / steps)
        for k, p in net.p.items():
            m[k] = 0.9 * m[k] + 0.1 * scale * g[k]
            v[k] = 0.99 * v[k] + 0.01 * (scale * g[k]) ** 2
            p -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all positions of each text (texts, languages); zero for empty texts."""
    windows, owner, lengths = _windows(texts, WINDOW)
    sums = np.zeros((len(texts), len(net.p["bias"])))
    for a in range(0, len(windows), BATCH):
        part, n = windows[a : a + BATCH], lengths[a : a + BATCH]
        steps = int(n.max())
        y = net.probabilities(np.ascontiguousarray(part.T[:steps]))
        if n.min() < steps:
            y *= (np.arange(steps)[:, None] < n[None, :])[:, None, :]
        np.add.at(sums, owner[a : a + BATCH], y.sum(axis=0).T)
    return sums / np.maximum(1, np.array([len(x) for x in texts]))[:, None]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", docs_per_language: int = 400,
        windows_per_doc: int = 8, window: int = 64) -> tuple[list[str], Network | None]:
    """Languages, ascending, and a network trained on a bounded sample: docs_per_language documents of each (smallest hash of key and text), windows_per_doc windows of each.

    Rows that repeat key and text count once, however many there are; a null key is a key like any other. Rows without a language or with a null or empty
    text are left out. A row a language comes to the driver, as the network has an output for each; from that follows a limit for the hash, so
    that about CANDIDATES times as many documents as wanted are looked at, and no others move.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for lang, text, h in zip(part.lang, part.text, part.h, strict=True):
                raw = text.encode("utf-8", "replace").lower()
                starts = np.random.RandomState(h % (1 << 31)).randint(0, max(1, len(raw) - window + 1), windows_per_doc)
                out += [(lang, raw[s : s + window]) for s in sorted(set(starts.tolist()))]
            yield pd.DataFrame(out, columns=["lang", "w"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(key_col, text_col).alias("h"))
    rows = rows.where("lang IS NOT NULL AND length(text) > 0")
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    if not sizes:
        return [], None
    limit = F.create_map(*(F.lit(x) for r in sizes for x in (r.lang, max(1, min(SPAN, int(SPAN * CANDIDATES * docs_per_language / r.n))))))
    near = rows.where(F.pmod("h", F.lit(SPAN)) < F.try_element_at(limit, F.col("lang")))
    once = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(SPAN)), "h")
    picked = once.withColumn("at", F.row_number().over(order)).where(F.col("at") <= docs_per_language)
    sample = picked.select("lang", "text", "h").mapInPandas(cut, "lang string, w binary").toPandas()
    if sample.empty:
        return [], None
    sample = sample.sort_values(["lang", "w"], kind="stable")
    languages = sorted(set(sample.lang))
    labels = np.searchsorted(languages, sample.lang.to_numpy().astype(str))
    return languages, train([bytes(w) for w in sample.w], labels, len(languages))


def predict(docs: DataFrame, languages: list[str], net: Network | None, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score: the language of the highest pooled probability (ties: the smaller name), and that probability.

    Null, empty and letterless texts, and all texts if nothing was learned, are `und` with score 0. Only the text is used. Columns of docs with the
    names of the new ones are replaced; rows that repeat are all returned.
    """
    docs = docs.drop(*(c for c in ("lang_pred", "score") if c != text_col))
    if net is None:
        return docs.drop(text_col).withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    model = docs.sparkSession.sparkContext.broadcast((languages, net))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, network = model.value
        for batch in batches:
            lang, score = [], []
            texts = batch.column(at).to_pylist()
            raw = ((t, (b or b"").lower()) for t, b in zip(texts, as_bytes(batch.column(at)), strict=True))
            for chunk in in_chunks(raw):
                p = pooled(network, [b for _, b in chunk])
                for (text, _), row in zip(chunk, p, strict=True):
                    best = int(row.argmax())
                    known = text is not None and any(map(str.isalpha, text))
                    lang.append(names[best] if known else "und")
                    score.append(min(1.0, float(row[best])) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=[*(n for n in batch.schema.names if n != text_col), "lang_pred", "score"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col)
    return docs.mapInArrow(run, f"{rest}, lang_pred string, score double")

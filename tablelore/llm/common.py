"""What several operators share: settled tables, folds by checksum, and exact word hashing in numpy."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelore.session import shared_folder

SPACES = b" \t\n\x0b\x0c\r"
CHUNK = 1 << 20


def scratch_path(spark, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """The frame as Parquet in the shared folder, read again: lineage ends there and a lost executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def in_chunks(texts: Iterable[tuple[object, bytes]], size: int = CHUNK) -> Iterator[list[tuple[object, bytes]]]:
    """Neighbouring (key, text) pairs, so many that their texts have about `size` bytes; a longer text comes alone."""
    part, held = [], 0
    for key, text in texts:
        if part and held + len(text) > size:
            yield part
            part, held = [], 0
        part.append((key, text))
        held += len(text)
    if part:
        yield part


# Hashing: a polynomial over bytes modulo 2**64, each byte first replaced by a random odd number; a word's value comes from
# two prefix sums, so a whole chunk is hashed with a few array operations.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.RandomState(20240229).randint(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_piece(piece: bytes) -> np.ndarray:
    a = np.frombuffer(piece, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64)
    up, down = _power(len(a) + 1)
    word = np.concatenate(([False], ~_SPACE[a], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[a] * up[:-1], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """64-bit values of the words [^\\x20\\x09-\\x0D]+ of a text, in order, A-Z lower-cased unless `lower` is false. Long texts are cut between words."""
    text = text.lower() if lower else text
    if len(text) <= CHUNK:
        return _hash_piece(text)
    parts, at = [], 0
    while at < len(text):
        end = min(at + CHUNK, len(text))
        while end < len(text) and text[end] not in SPACES:
            end += 1
        parts.append(_hash_piece(text[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit values of the distinct `width`-word shingles; a shorter text is one shingle, a text without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(width, len(words))
    values = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        values = values * np.uint64(0xD6E8FEB86659FD93) + words[i : len(words) - k + 1 + i]
    return np.unique(mix(values))

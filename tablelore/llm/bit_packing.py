"""Token ids in fixed-width blocks: each id in the fewest bits that hold the vocabulary.

The file format is Parquet rows, so that Spark's own commit protocol covers lost executors and any file system will do. A row of `blocks` holds
whole documents, at least BLOCK ids of them unless the shard ends: shard, block, width, n_ids, base (place in the shard of its first
id), doc_ids, doc_offsets (of each document in the block), payload (ids as little-endian bit string). `shards` has a row a shard: shard, start (ids in
all shards before it), n_ids. Shards, blocks and documents ascend by doc_id. Id i of a block stands at bit i * width, so any
part of it can be read without the rest.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import filterfalse
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelore.llm.common import scratch_path

BLOCK = 1 << 14
KEPT_WORDS = 500_000
ENCODED = 8 << 20  # bytes of text that are split into words at once
MARK, TOGETHER = " \x01 ", 256
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<after>[!-/:-@\[-`{-~]*)$"
CUTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None,
}


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """The ids, each below 2**width, one after the other in `width` bits, lowest bit first; whole 64-bit words."""
    if not 1 <= width <= 32:
        raise ValueError("width must be from 1 to 32")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError("an id does not fit")
    period = 64 // gcd(width, 64)  # after so many ids a new word begins
    rows = -(-len(ids) // period)
    cells = np.zeros(rows * period, np.uint64)
    cells[: len(ids)] = ids
    cells, words = cells.reshape(rows, period), np.zeros((rows, period * width // 64), np.uint64)
    for i in range(period):
        word, shift = divmod(i * width, 64)
        words[:, word] |= cells[:, i] << np.uint64(shift)
        if shift + width > 64:
            words[:, word + 1] |= cells[:, i] >> np.uint64(64 - shift)
    return words.astype("<u8").tobytes()


def unpack(payload: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a packed block."""
    if stop <= start:
        return np.empty(0, np.uint32)
    low, high = start * width >> 6, (stop * width + 63) >> 6
    words = np.append(np.frombuffer(payload, "<u8", high - low, low * 8), np.uint64(0))
    bit = np.arange(start, stop, dtype=np.int64) * width - low * 64
    word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    values = words[word] >> shift
    values |= np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (values & np.uint64((1 << width) - 1)).astype(np.uint32)


class WordEncoder:
    """A tokenizer that drops white space, asked once a word: no token of it reaches over blanks, so a text's ids are its words' ids.

    Texts are split and their distinct words found by Arrow, so that Python sees a word once a chunk, however often it comes up there. Keeps the
    ids of the first KEPT_WORDS words it meets; others are encoded again where they come up. New words are encoded many to a
    call, with MARK between them; where a word's own ids hold MARK's, the words of that call are encoded one by one.

    Of a tokenizer that lower-cases and cuts as in CUTS, words of Latin-1 letters and punctuation after them (PLAIN) are cut here, and the letters,
    lower-cased, go straight to its merges: normal forms and cuts do nothing to them. Their last ids end a word, so no mark is needed.
    """

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.mark = self._ids([MARK.strip()])[0]
        self.plain, self.ends = self._merges()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _merges(self) -> tuple:
        """The tokenizer without normal forms and cuts, and of each id, whether it ends a word; nothing if words may not be cut as in PLAIN."""
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(self.tokenizer.to_str())
        model, added = spec["model"], [x["content"] for x in spec["added_tokens"]]
        as_cut = {k: spec[k] for k in CUTS} == CUTS and model["type"] == "BPE" and model["end_of_word_suffix"] and not model["continuing_subword_prefix"]
        if not as_cut or model["dropout"] or not all(re.match(r"[!-/:-@\[-`{-~].*[A-Za-z]", x) for x in added):  # such a token is in no PLAIN word
            return None, None
        plain = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None}))
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = np.zeros(max(model["vocab"].values()) + 1 + len(added), bool)
        ends[[i for word, i in model["vocab"].items() if word.endswith(model["end_of_word_suffix"])]] = True
        return plain, ends

    def _ids(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], plain: bool = False) -> Iterator[bytes]:
        """The ids of each word, as bytes. plain: all are Latin-1 letters in lower case."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, ids in zip(groups, self._ids([(" " if plain else MARK).join(g) for g in groups], self.plain if plain else None), strict=True):
            if plain:
                stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                starts = [0, *stops[:-1]]
            else:
                stops = [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)] if len(self.mark) == 1 else []
                starts = [0, *(i + 1 for i in stops[:-1])]
            if len(stops) == len(group):
                raw = ids.tobytes()
                yield from (raw[4 * a : 4 * b] for a, b in zip(starts, stops, strict=True))
            else:
                yield from (x.tobytes() for x in self._ids(group))

    def _looked_up(self, words: pa.Array, plain: bool = False) -> pa.Array:
        """The ids of each word, as bytes."""
        words = words.dictionary_encode()
        distinct = words.dictionary.to_pylist()
        fresh = list(filterfalse(self.known.__contains__, distinct))
        room = max(0, KEPT_WORDS - len(self.known))
        self.known.update(zip(fresh, self._words(fresh, plain), strict=True))
        found = pa.array([self.known[w] for w in distinct], pa.large_binary())
        for word in fresh[room:]:
            del self.known[word]
        return found.take(words.indices)

    def _of_distinct(self, words: pa.Array) -> pa.Array:
        """The ids of each word, as bytes; words do not repeat."""
        if not self.plain:
            return self._looked_up(words)
        cut = pc.extract_regex(words, PLAIN)
        fits = cut.is_valid()
        letters, after = cut.filter(fits).flatten()
        ids = pc.binary_join_element_wise(self._looked_up(pc.utf8_lower(letters), plain=True), self._looked_up(after), pa.scalar(b"", pa.large_binary()))
        others = self._looked_up(words.filter(pc.invert(fits)))
        place = np.argsort(np.argsort(~fits.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        return pa.concat_arrays([ids, others]).take(pa.array(place))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the texts, one after the other, and where each text's begin, with the end of the last. Null texts count as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))  # at \x20 and \x09-\x0D; may hold empty words
        words = split.flatten().dictionary_encode()
        found = self._of_distinct(words.dictionary).take(words.indices)
        if not len(found):
            return np.empty(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        _, ends, raw = found.buffers()
        ends = np.frombuffer(ends, np.int64, len(found) + 1)
        ids = np.frombuffer(raw, "<u4", int(ends[-1]) // 4) if ends[-1] else np.empty(0, "<u4")
        return ids, ends[split.offsets.to_numpy()] // 4


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows, so many that their texts, in the second column, have about ENCODED bytes; a longer text comes alone."""
    at, held = 0, 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        if i > at and held + size > ENCODED:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    yield batch.slice(at)


def _encoded(path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder.of(path)
        names = ["shard", "block", "width", "n_ids", "base", "doc_ids", "doc_offsets", "payload"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        docs, parts, offsets, held, base, block, shard = [], [], [], 0, 0, 0, 0
        end = np.array([end_id], np.uint32)

        def closed() -> pa.RecordBatch:
            values = (shard, block, width, held, base, docs, offsets, pack(np.concatenate(parts), width))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(2)[0].as_py()
            for chunk in _chunks(batch):
                ids, at = encoder.encode(chunk.column(1))
                for doc, start, stop in zip(chunk.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    docs.append(doc)
                    offsets.append(held)
                    parts += [ids[start:stop], end]
                    held += stop - start + 1
                    if held >= BLOCK:
                        yield closed()
                        docs, parts, offsets, held, base, block = [], [], [], 0, base + held, block + 1
        if docs:
            yield closed()

    return run


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> str:
    """Writes the token ids of every whole text, `end_id` after each, and returns the folder (a new shared one if none is given).

    Null text counts as empty, so it is the end id alone. Rows without an id are left out; rows that repeat an id are all written, ordered by a hash of the text. Other
    columns are ignored. An empty table gives empty files. Documents are dealt to shards by ranges of (id, text): one repeated id
    does not fill a shard. `tokenizer` names a file of the tokenizers library whose tokens never reach over white space.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "ids")
    width = width_of(max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True), end_id + 1))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")
    order = [F.col("doc_id"), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    schema = "shard int, block long, width int, n_ids long, base long, doc_ids array<long>, doc_offsets array<long>, payload binary"
    rows.mapInArrow(_encoded(tokenizer, end_id, width), schema).write.parquet(f"{folder}/blocks")
    sizes = spark.read.schema(schema).parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    sizes.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"), "n_ids").write.parquet(f"{folder}/shards")
    return folder


def read_docs(spark, folder: str, fold: Callable[[np.ndarray], int], name: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and `name`, a long that `fold` makes of a document's ids, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["width"], 0, row["n_ids"])
                for doc, a, b in zip(row["doc_ids"], row["doc_offsets"], [*row["doc_offsets"][1:], row["n_ids"]], strict=True):
                    out.append((doc, row["start"] + row["base"] + a, b - a, fold(ids[a:b])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", name])

    blocks = spark.read.parquet(f"{folder}/blocks").join(spark.read.parquet(f"{folder}/shards").select("shard", "start"), "shard")
    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} long")


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())

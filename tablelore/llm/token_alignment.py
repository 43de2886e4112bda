"""Alignment of two tokenizers' ids over the same text.

The ends of all tokens, in bytes, go into one dictionary a side (end to index). Ends found in both cut the two id lists into groups of
tokens that cover the same bytes; each group is expanded into links. Neither tokenizer has a token over the border between a visible
character and a blank that follows it, so both lists can be cut there, at a common end: a stretch between two such borders is
encoded and aligned once a task, however often it occurs. Tokenizers that do have such a token encode whole texts.

How often two ids are linked in the whole corpus is a table of pairs, added up in the tasks before it is shuffled. Pairs that occur most,
at most HEAD_PAIRS of them, are looked up in a broadcast table; the others, rare ones by choice, are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelore.llm.common import as_bytes, in_chunks, settle

HEAD_PAIRS = 1 << 20  # pairs in the broadcast table, some 16 bytes each
KEPT, KEPT_LENGTH, TOGETHER = 200_000, 64, 512  # stretches a task keeps, characters of the longest, stretches encoded at once
BORDER = re.compile(r"(?<=\S) ")  # the blank begins the next stretch
ALIGNED = "n_a long, n_b long, n_groups long, groups string, link_a array<int>, link_b array<int>, link_n array<int>"


def byte_of_letter() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: visible Latin-1 letters for themselves, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def common_cuts(a_sizes: Iterable[int], b_sizes: Iterable[int]) -> list[tuple[int, int]]:
    """After how many tokens of A and of B a group ends: the byte offsets at which a token of each side ends, ascending."""
    a_at = {end: i for i, end in enumerate(accumulate(a_sizes), 1)}
    b_at = {end: i for i, end in enumerate(accumulate(b_sizes), 1)}
    return [(a_at[end], b_at[end]) for end in sorted(a_at.keys() & b_at.keys())]


class Aligner:
    """A byte-level tokenizer of the tokenizers library (A) and a sentencepiece model (B), for texts with a blank put before them."""

    _made: dict[tuple, Aligner] = {}

    def __init__(self, a_file: str, b_file: str, links: str = "end"):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        if links not in ("end", "group"):
            raise ValueError("links must be end or group")
        self.every = links == "group"
        self.a, self.b = Tokenizer.from_file(a_file), SentencePieceProcessor(model_file=b_file)
        self.a.encode_special_tokens = True
        letters, added = byte_of_letter(), self.a.get_added_tokens_decoder()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [x.encode() if i in added else bytes(map(letters.__getitem__, x)) for i, x in enumerate(names)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.a_name, self.b_name = [f"{i}|" for i in range(len(names))], [str(i) for i in range(len(pieces))]
        self.a_size, self.b_size = [len(x) for x in self.a_bytes], [len(x) for x in self.b_bytes]
        self.borders = not any(BORDER.search(x.decode("utf-8", "replace")) for x in (*self.a_bytes, *self.b_bytes))
        self.known: dict[str, tuple] = {}

    @classmethod
    def of(cls, *of) -> Aligner:
        if of not in cls._made:
            cls._made[of] = cls(*of)
        return cls._made[of]

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of both sides; B puts the blank before the text by itself."""
        return self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)

    def _groups(self, a: list[int], b: list[int], cuts: list[tuple[int, int]]) -> tuple[list[str], list[bytes]]:
        """Each group as text, and its links."""
        groups, links, i, j = [], [], 0, 0
        a_name, b_name, every = self.a_name, self.b_name, self.every
        for x, y in cuts:
            p, q = a[x - 1], b[y - 1]  # of a group, only the last two tokens end together
            if x - i == 1 and y - j == 1:
                groups.append(a_name[p] + b_name[q])
                links.append((p << 32 | q).to_bytes(8, "little"))
            else:
                groups.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
                links.append(b"".join((t << 32 | u).to_bytes(8, "little") for t in a[i:x] for u in b[j:y]) if every else (p << 32 | q).to_bytes(8, "little"))
            i, j = x, y
        return groups, links

    def _together(self, stretches: list[str]) -> list[tuple] | None:
        """For stretches, each with a blank before it: (n_a, n_b, n_groups), the groups as text, the links. None where a tokenizer changes their bytes."""
        text = " ".join(stretches)
        a, b = self.ids(text)
        whole = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        cuts = common_cuts(map(self.a_size.__getitem__, a), map(self.b_size.__getitem__, b))
        groups, links = self._groups(a, b, cuts)
        if len(stretches) == 1:
            return [((len(a), len(b), len(cuts)), ";".join(groups), b"".join(links))]
        # after which group each stretch ends
        token_ends = list(accumulate(map(self.a_size.__getitem__, a)))
        group_at = {token_ends[x - 1]: n for n, (x, _) in enumerate(cuts, 1)}
        out, n, i, j, end = [], 0, 0, 0, 0
        for s in stretches:
            end += (len(s) if s.isascii() else len(s.encode())) + 1
            last = group_at.get(end)
            if last is None:
                return None
            x, y = cuts[last - 1]
            if last - n == 1:
                out.append(((x - i, y - j, 1), groups[n], links[n]))
            else:
                out.append(((x - i, y - j, last - n), ";".join(groups[n:last]), b"".join(links[n:last])))
            n, i, j = last, x, y
        return out

    def _learn(self, fresh: list[str]) -> None:
        """Entries of new stretches; those that end in white space can only close a text and are encoded alone."""
        inner = [s for s in fresh if s and not s[-1].isspace()]
        groups = [inner[i : i + TOGETHER] for i in range(0, len(inner), TOGETHER)]
        for group in [*groups, *([s] for s in fresh if not s or s[-1].isspace())]:
            entries = self._together(group)
            if entries is None and len(group) > 1:
                entries = [(self._together([s]) or [None])[0] for s in group]
            self.known.update(zip(group, entries or [None], strict=True))

    def align(self, texts: list[str]) -> Iterator[tuple | None]:
        """(n_a, n_b, n_groups), the groups as text and the links (A's id in the upper, B's in the lower 32 bits) of each text; None where a tokenizer does not give back its bytes, or where there is none."""
        split = [(BORDER.split(t) if self.borders else [t]) if t else [] for t in texts]
        fresh = list(set(chain.from_iterable(split)).difference(self.known))
        self._learn(fresh)
        for text, part in zip(texts, split, strict=True):
            entries = list(map(self.known.__getitem__, part))
            if not part:
                yield None
            elif None in entries:  # changed bytes of two stretches might still make up the text's
                entry = self._together([text])
                yield entry and entry[0]
            else:
                sizes, groups, links = zip(*entries, strict=True)
                yield tuple(map(sum, zip(*sizes, strict=True))), ";".join(groups), b"".join(links)
        room = KEPT - len(self.known) + len(fresh)
        for i, s in enumerate(fresh):
            if i >= room or len(s) > KEPT_LENGTH:
                del self.known[s]


def align(docs: DataFrame, a_file: str, b_file: str, links: str = "end", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id_col, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`: ids of A and B, decimal, in order), link_a, link_b, link_n.

    A: blank + text by a byte-level file of the tokenizers library; B: the text by a sentencepiece model that puts a blank before it; special tokens'
    strings in texts are plain text. A group ends at every byte offset where tokens of both end. A link is a pair of token occurrences:
    with links="end" those whose byte ranges end together (a group's last ones), with "group" all of a group. link_a,
    link_b, link_n: the different pairs of linked ids and how many links of this text hold each, by id of A, then B. Null and empty texts, and
    those whose tokens' bytes are not blank + text, have no tokens: zeros, null groups, no pairs. Repeated rows and ids stay as they are; null ids too.
    Columns other than the two are ignored. No rows give no rows. A text is aligned in one task, in memory in proportion to its size.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_a", "n_b", "n_groups", "groups", "link_a", "link_b", "link_n"]
    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.int32())] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # nothing here refers to itself, and the collector would walk all kept stretches again and again
        aligner = Aligner.of(a_file, b_file, links)
        for batch in batches:
            texts, at = as_bytes(batch.column(1)), 0
            for chunk in in_chunks(enumerate(x or b"" for x in texts)):
                rows = []
                decoded = [x.decode("utf-8", "replace") for _, x in chunk]
                for (_, raw), text, entry in zip(chunk, decoded, aligner.align(decoded), strict=True):
                    if entry is None or (len(text) and "�" in text and text.encode() != raw):
                        rows.append((0, 0, 0, None, [], [], []))
                        continue
                    pair, n = np.unique(np.frombuffer(entry[2], "<i8"), return_counts=True)
                    rows.append((*entry[0], entry[1], (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32)))
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(chunk)), *columns], names=["id", *names])
                at += len(chunk)

    if id_col in names:
        raise ValueError(f"the id may not be called {id_col}")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, {ALIGNED}").withColumnRenamed("id", id_col)


def _links(aligned: DataFrame, *keep: str) -> DataFrame:
    pairs = F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_n").alias("n"))
    return aligned.select(*keep, F.inline(pairs))


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (links of the whole corpus that hold the two ids), best (no other id of A is linked with b more often)."""
    counts = settle(_links(aligned).groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))  # a row an id of B
    return counts.join(F.broadcast(top), "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def with_counts(aligned: DataFrame) -> DataFrame:
    """The rows of align() and n_links, n_best (links of a text whose pair is the best of its id of B, ties included), count_sum (corpus counts over its links)."""
    rows = settle(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")  # numbered once, as ids may repeat
    counts = settle(link_counts(rows), "counts")
    # pairs by the power of two of their count: at most 64 rows; the most frequent powers that fit together are the head
    sizes = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, held = 64, 0
    for power, n in sorted(((r.power, r.n) for r in sizes), reverse=True):
        held += n
        if held > HEAD_PAIRS:
            break
        least = power
    common = F.floor(F.log2("count")) >= least
    uses = _links(rows, "row")
    head = uses.join(F.broadcast(counts.where(common)), ["a", "b"])
    tail = uses.join(F.broadcast(counts.where(common).select("a", "b")), ["a", "b"], "left_anti").join(counts.where(~common), ["a", "b"])
    sums = head.unionByName(tail).groupBy("row").agg(
        F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_best", "count_sum")]
    return rows.join(sums, "row", "left").select(*aligned.columns, *filled)

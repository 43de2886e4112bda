"""Token alignment, passage removal and the Merkle manifest against brute force; null, empty, long, tied and repeated input."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tablelore.llm import merkle, passage_dedup, queries, token_alignment
from tablelore.llm.common import word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", "a", " a", "a ", "  ", "\n\n  b", "x\n y", "▁a b", "a ▁b", "<|endoftext|> <s> </s> <0x41>", "日本語 テキスト　全角", "é́ ﬁ ½   x", "a\tb \t c",
         "\x1c x \x85 y", "it's we'll  DON'T", "😀 👩‍👩‍👧 z", "y" * 3000, "the quick brown fox " * 300, "the quick brown fox", "the quick brown fox", "\x00 \x07"]


def documents(spark, rows):
    return spark.createDataFrame([(*r, *(None,) * (5 - len(r))) for r in rows], DOCS)


# ---- token alignment

def whole_text(text, every=False):
    """Groups and links of a text encoded whole, by comparing all ends."""
    aligner = token_alignment.Aligner.of(A, B)
    if not text:
        return [], []
    a, b = aligner.ids(text)
    wanted = (" " + text).encode()
    if b"".join(aligner.a_bytes[i] for i in a) != wanted or b"".join(aligner.b_bytes[i] for i in b) != wanted:
        return [], []
    ends = [np.cumsum([len(side[i]) for i in ids]).tolist() for side, ids in ((aligner.a_bytes, a), (aligner.b_bytes, b))]
    groups, links = [], []
    i = j = 0
    for x, end in enumerate(ends[0]):
        if end in set(ends[1]):
            y = ends[1].index(end)
            groups.append((a[i : x + 1], b[j : y + 1]))
            links += [(p, q) for p in a[i : x + 1] for q in b[j : y + 1]] if every else [(a[x], b[y])]
            i, j = x + 1, y + 1
    return groups, links


def aligned_by_force(rows, every=False):
    made = [(i, *whole_text(t, every)) for i, t in rows]
    counts = Counter(x for _, _, links in made for x in links)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for i, groups, links in made:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((i, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def aligned(df, **kw):
    made = token_alignment.align(df, A, B, **kw)
    return token_alignment.with_counts(made).select(*COLUMNS, F.coalesce(F.sha2("groups", 256), F.lit("")))


@pytest.mark.parametrize("links", ["end", "group"])
def test_alignment_equals_whole_texts(spark, links):
    rows = [*enumerate(TEXTS), (None, "the fox"), (3, "the fox"), (3, "the fox")]
    got = sorted((tuple(r) for r in aligned(documents(spark, rows), links=links).collect()), key=str)
    assert got == aligned_by_force(rows, links == "group")


def test_alignment_query_on_given_table(spark, tmp_path):
    rows = [(i, f"w{i % 7} and {'zebra ' * (i % 5)}stripes" if i % 9 else None) for i in range(200)] + [(900 + i, t) for i, t in enumerate(TEXTS)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.op11_align(spark, str(tmp_path)).collect()), key=str)
    assert got == aligned_by_force(rows)


def test_rare_pairs_are_joined(spark, monkeypatch):
    rows = list(enumerate(TEXTS))
    monkeypatch.setattr(token_alignment, "HEAD_PAIRS", 3)
    assert sorted((tuple(r) for r in aligned(documents(spark, rows)).collect()), key=str) == aligned_by_force(rows)
    monkeypatch.setattr(token_alignment, "HEAD_PAIRS", 0)
    assert sorted((tuple(r) for r in aligned(documents(spark, rows)).collect()), key=str) == aligned_by_force(rows)


def test_alignment_of_no_rows_and_other_columns(spark):
    df = documents(spark, [(1, "a b")]).withColumn("n_a", F.lit(7)).withColumn("groups", F.lit("x"))
    assert token_alignment.align(df, A, B).first().n_a == 2
    assert token_alignment.align(df.limit(0), A, B).count() == 0
    with pytest.raises(ValueError):
        token_alignment.align(df, A, B, id_col="n_a")
    with pytest.raises(ValueError):
        token_alignment.Aligner(A, B, "all")


def test_common_cuts():
    assert token_alignment.common_cuts([2, 1, 3], [3, 3]) == [(2, 1), (3, 2)]
    assert token_alignment.common_cuts([], []) == []


# ---- passages

def cut_by_force(rows, window):
    windows = []
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        own = [b" ".join(words[p : p + window]) for p in range(len(words) - window + 1)] if i is not None else []
        windows.append((i, words, own))
        for w in own:
            first[w] = min(first.get(w, i), i)
    out = []
    for i, words, own in windows:
        gone = {p + k for p, w in enumerate(own) if first[w] < i for k in range(window)}
        out.append((i, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def cut(df, window):
    return sorted((tuple(r) for r in passage_dedup.without_repeats(df, window).collect()), key=str)


def prose(rng, n, words=300):
    return [f"w{i}" for i in rng.randint(0, words, n)]


def passages(seed):
    """Copies whole, in part and with changed words, passages put into other texts, repeats inside one text, few different words."""
    rng = np.random.RandomState(seed)
    shared = [prose(rng, n) for n in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 20, 33, 64, 150)]
    rows = []
    for i in range(90):
        words = prose(rng, rng.randint(0, 40), 5 if i % 7 == 0 else 300)
        for _ in range(rng.randint(0, 4)):
            part = shared[rng.randint(len(shared))]
            a = rng.randint(0, 4)
            words += part[a : len(part) - rng.randint(0, 3)] + prose(rng, rng.randint(0, 6))
        rows.append((int(rng.randint(0, 70)), "  ".join(words)))
    rows += [(200 + i, rows[i % 9][1]) for i in range(30)] + [(0, rows[3][1]), (0, rows[3][1])]
    rows += [(300, None), (301, ""), (302, " \n"), (None, rows[5][1]), (303, "A B c d e f g h i j"), (304, "a B c d e f g h i j"), (305, "A\tB c\nd e f g h i j k")]
    return rows + [(306, "y " * 3000), (307, "y " * 2000 + "z"), (308, "x" * 100_000), (309, "x" * 100_000)]


@pytest.mark.parametrize("window,seed", [(1, 1), (2, 2), (7, 3), (10, 4)])
def test_passages_equal_brute_force(spark, window, seed):
    rows = passages(seed)
    assert cut(documents(spark, rows), window) == cut_by_force(rows, window)


def test_spans_double(spark):
    base = [f"v{i}" for i in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(["a", *base[:330], "b"])), (3, " ".join(base[200:]))]
    spans = {r.doc: [tuple(s) for s in r.spans] for r in passage_dedup.repeated_spans(documents(spark, rows), 10).collect()}
    assert set(spans) == {2, 3}
    assert max(size for _, size in spans[2]) == 320 and max(size for _, size in spans[3]) == 160
    assert {p for b, n in spans[2] for p in range(b, b + n)} == set(range(1, 331))
    assert cut(documents(spark, rows), 10) == cut_by_force(rows, 10)


def test_passages_of_no_rows_and_other_columns(spark):
    df = documents(spark, [(1, "a b c"), (2, "a b c")]).withColumn("spans", F.lit(1)).withColumn("seed", F.lit(2)).withColumn("kept", F.lit("x"))
    assert [(r.doc_id, r.n_removed, r.kept) for r in passage_dedup.without_repeats(df, 2).orderBy("doc_id").collect()] == [(1, 0, "a b c"), (2, 3, "")]
    assert passage_dedup.without_repeats(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        passage_dedup.without_repeats(df, 2, id_col="kept")


def test_windows_and_seeds():
    words = np.arange(1, 60, dtype=np.uint64) ** np.uint64(9)
    for size in (1, 2, 3, 7, 25, 50):
        mine = passage_dedup._windows(words, size)
        for i in (0, len(mine) - 1):
            value = 0
            for w in words[i : i + size]:
                value = (value * int(passage_dedup._BASE) + int(w)) % (1 << 64)
            assert int(mine[i]) == value
    values = np.array([5, 3, 3, 9, 1, 1, 8, 2], np.uint64)
    for size in range(1, 9):
        assert passage_dedup._least(values, size).tolist() == [i + int(np.argmin(values[i : i + size])) for i in range(9 - size)]
    assert word_hashes(b"Ab", lower=False) != word_hashes(b"ab", lower=False) and word_hashes(b"Ab") == word_hashes(b"ab")


# ---- manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root and, for each node, its (left, right) a level."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(places):
            start = p // 16 * 16
            paths[i].append(("".join(level[start:p]), "".join(level[p + 1 : start + 16])))
            places[i] = p // 16
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def report_by_force(rows):
    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        low = text
        if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        groups[source].append((doc, leaf_of((doc, source, lang, n, text)), leaf_of((doc, source, lang, n, low))))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    made = {s: tree([r[1] for r in groups[s]]) for s in order}
    root, upper = tree([made[s][0] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        for (doc, leaf, claimed), path in zip(groups[s], made[s][1], strict=True):
            folded = claimed
            for left, right in path + above:
                folded = h(left, folded, right)
            out.append((doc, leaf, made[s][0], root, h(*(x for pair in path + above for x in pair)), folded, folded == root))
    return sorted(out, key=str)


REPORT = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (16, 17), (255, 256, 257), (1100, 1, 300, 2), (3,) * 300])
def test_manifest_equals_brute_force(spark, sizes):
    rows = [(d * 7919 % 100_003, f"Text {d} é" if d % 4 else None, "en" if d % 3 else None, None if s == 1 else f"s{s}", d) for s, n in enumerate(sizes) for d in range(s * 2000, s * 2000 + n)]
    got = merkle.tampered_report(spark.createDataFrame(rows, DOCS))
    assert sorted((tuple(r) for r in got.select(REPORT).collect()), key=str) == report_by_force(rows)


def test_manifest_with_a_third_level_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(d, f"T{d}", None, "big" if d % 5 else f"s{d % 55}", None) for d in range(5200)]
    got = merkle.tampered_report(spark.createDataFrame(rows, DOCS))
    assert sorted((tuple(r) for r in got.select(REPORT).collect()), key=str) == report_by_force(rows)


def test_manifest_of_nulls_repeats_long_texts_and_no_rows(spark):
    rows = [(None, "A", None, None, None), (None, "A", None, None, None), (1, "", "", "", 0), (1, "", "", "", 0), (1, "X" * 200_000, None, "", None), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = merkle.tampered_report(df.withColumn("leaf", F.lit("x")).withColumn("at", F.lit(1)).withColumn("grp", F.lit(1)))
    assert sorted((tuple(r) for r in got.select(REPORT).collect()), key=str) == report_by_force(rows)
    assert merkle.tampered_report(df.limit(0)).count() == 0


def test_manifest_keeps_other_columns_and_its_paths_fold(spark):
    leaves = spark.createDataFrame([(f"g{i % 3}", i, h(str(i)), i * 2) for i in range(700)], "grp string, id long, leaf string, other long")
    proved = merkle.manifest(leaves)
    assert proved.where(merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).where("other = id * 2 AND at = id div 3").count() == 700
    assert proved.where(merkle.fold(F.sha2(F.lit("no"), 256), F.col("path")) == F.col("root")).count() == 0
    with pytest.raises(ValueError):
        merkle.manifest(leaves.withColumn("path", F.lit(1)))

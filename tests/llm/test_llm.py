"""The training-data operators against brute force, round trips and held-out accuracy; null, empty, long, tied and repeated input."""

import collections
import hashlib
import importlib
import os
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from tablelore.llm import bit_packing, chat_tree, decontamination, kmeans_tree, lattice_lm, mixing, sharding, stages, toxicity
from tablelore.llm import byte_rnn
from tablelore.llm.common import word_hashes
from tablelore.llm.components import components
from tablelore.llm import parity_join
from tablelore.llm.parity_join import similar_groups, sketch
from fractions import Fraction

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, schema=DOCS):
    """Rows (doc_id, text[, lang[, source]]) with all columns of documents."""
    full = [(*r, *(None,) * (4 - len(r)), None) for r in rows]
    return spark.createDataFrame(full, schema)


def prose(seed, n, words=400):
    rng = np.random.RandomState(seed)
    return [f"w{i}" for i in rng.randint(0, words, n)]


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def groups_by_force(rows, width, p, q):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and q * len(a & b) >= p * len(a | b):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return sorted((i, len(s), find(i)) for i, s in sets)


def near_copies():
    rng, rows = np.random.RandomState(4), []
    for size in (3, 5, 9, 14, 30, 33, 60, 130, 300, 900):
        base = prose(size, size, 5000)
        for copy in range(14):
            words = list(base)
            for at in rng.randint(0, size, rng.randint(0, 1 + max(1, size // 25) * (copy % 4))):
                words[at] = f"x{rng.randint(99)}"
            rows.append((len(rows), " ".join(words).upper() if copy % 5 == 0 else "  ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "ONE"), (1005, "one two three"), (1006, "y" * 100_000)]
    return rows


@pytest.mark.parametrize("width,threshold", [(4, "0.85"), (5, "0.8")])
def test_similar_groups_equal_brute_force(spark, width, threshold):
    rows = near_copies()
    t = Fraction(threshold)
    got = similar_groups(documents(spark, [(i, x) for i, x in rows]), width=width, threshold=threshold)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == groups_by_force(rows, width, t.numerator, t.denominator)


@pytest.mark.parametrize("width,threshold", [(4, "0.85"), (5, "0.8")])
def test_similar_groups_by_rarest_shingles_equal_brute_force(spark, monkeypatch, width, threshold):
    """All buckets count as crowded and every document as a hub: the same groups."""
    monkeypatch.setattr(parity_join, "CROWD", 0)
    monkeypatch.setattr(parity_join, "HUB", 2)
    rows = near_copies()
    t = Fraction(threshold)
    got = similar_groups(documents(spark, rows), width=width, threshold=threshold)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == groups_by_force(rows, width, t.numerator, t.denominator)


@pytest.mark.parametrize("own", [40, 18])
def test_templates_make_no_pairs(spark, monkeypatch, own):
    """2000 documents of one template, each with `own` of 142 words of its own (Jaccard 0.56 and 0.77, unlinked), make no rows of pairs; a few near copies are found."""
    seen = {}
    settle = parity_join.settle
    def counted(df, name):
        out = settle(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(parity_join, "settle", counted)
    head = prose(3, 142 - own, 5000)
    rows = [(i, " ".join(head + [f"d{i}x{j}" for j in range(own)])) for i in range(2000)]
    rows += [(5000 + i, rows[i][1] + " end") for i in range(0, 2000, 500)]
    got = {r.doc_id: r.component_id for r in similar_groups(documents(spark, rows)).collect()}
    assert got == {i: i % 5000 for i, _ in rows}
    assert seen["pairs"] + seen.get("met", 0) < 3 * len(rows)


@pytest.mark.parametrize("width,threshold", [(4, "0.85"), (5, "0.8")])
def test_near_copies_too_far_apart_make_no_pairs(spark, monkeypatch, width, threshold):
    """600 copies of one text with 2 to 6 changed words, most of them unlinked at Jaccard 0.6 to 0.85: the groups of brute force, and no rows of pairs beyond a few a document."""
    seen = {}
    settle = parity_join.settle
    def counted(df, name):
        out = settle(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(parity_join, "settle", counted)
    rng, base, rows = np.random.RandomState(8), prose(5, 150, 5000), []
    for i in range(600):
        words = list(base)
        for at in rng.choice(150, rng.randint(2, 7), replace=False):
            words[at] = f"d{i}x{at}"
        rows.append((i, " ".join(words)))
    t = Fraction(threshold)
    got = similar_groups(documents(spark, rows), width=width, threshold=threshold)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == groups_by_force(rows, width, t.numerator, t.denominator)
    assert seen["crowd"] and seen["pairs"] + seen.get("met", 0) < 6 * len(rows)


@pytest.mark.parametrize("cells", [1 << 22, 1])
@pytest.mark.parametrize("width,threshold", [(4, "0.85"), (5, "0.8")])
def test_only_the_first_shingles_of_near_copies_become_rows(spark, monkeypatch, width, threshold, cells):
    """400 near copies of one text: what joins by shingles make is bounded by the first 1 - t of each set, however badly the counts tell rare from common."""
    made, join = [], type(spark.range(0)).join
    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if isinstance(on, str) and on == "shingle":
            made.append(out.count())
        return out
    monkeypatch.setattr(type(spark.range(0)), "join", counted)
    monkeypatch.setattr(parity_join, "CELLS", cells, raising=False)
    monkeypatch.setattr(parity_join, "CROWD", 0)
    rng, base, rows = np.random.RandomState(8), prose(5, 150, 5000), []
    for i in range(400):
        words = list(base)
        for at in rng.choice(150, rng.randint(2, 7), replace=False):
            words[at] = f"d{i}x{at}"
        rows.append((i, " ".join(words)))
    t = Fraction(threshold)
    got = similar_groups(documents(spark, rows), width=width, threshold=threshold)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == groups_by_force(rows, width, t.numerator, t.denominator)
    assert 0 < sum(made) <= len(rows) * (150 * (1 - t) + 2)


def test_similar_groups_repeated_ids_and_no_rows(spark):
    a, b = " ".join(prose(1, 50)), " ".join(prose(2, 50))
    got = similar_groups(documents(spark, [(5, a), (5, b), (7, a), (8, b), (8, b), (None, a)]))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(5, 5), (5, 5), (7, 5), (8, 5), (8, 5)]
    assert similar_groups(documents(spark, [])).count() == 0


def test_sketch_distances_are_lower_bounds():
    rng = np.random.RandomState(0)
    for _ in range(50):
        base = np.unique(rng.randint(1, 1 << 62, 200).astype(np.uint64))
        other = np.unique(np.append(base[rng.randint(0, 9) :], rng.randint(1, 1 << 62, rng.randint(0, 9)).astype(np.uint64)))
        apart = len(np.setxor1d(base, other))
        x, y = ({o: (k, b) for o, k, b in sketch(s, Fraction(4, 5))} for s in (base, other))
        for octave in x.keys() & y.keys():
            assert sum(bin(int(a) & (1 << 64) - 1).count("1") for a in x[octave][1] ^ y[octave][1]) <= apart
            assert set(x[octave][0]) & set(y[octave][0])


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(160, 150), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 161)}}


def count_settled(monkeypatch, module):
    """The names of the frames that the module settles from now on."""
    names, settle = [], module.settle
    monkeypatch.setattr(module, "settle", lambda df, name: names.append(name) or settle(df, name))
    return names


@pytest.mark.parametrize("links, rounds", [([(5, 1), (6, 1), (9, 7), (8, 8), (None, 3)], 0), ([], 0), ([(5, 6), (5, 1)], 1), ([(3, 1), (3, 2)], 1)])
def test_components_need_no_round_beyond_stars(spark, monkeypatch, links, rounds):
    names = count_settled(monkeypatch, importlib.import_module("tablelore.llm.components"))
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    held = [x for x in links if None not in x and x[0] != x[1]]
    assert len(names) == 1 + 2 * rounds and set(got) == {x for link in held for x in link}
    assert all(got[a] == got[b] for a, b in held) and all(got[r] == r <= x for x, r in got.items())


@pytest.mark.parametrize("pairs, hubs", [([(1, 2), (1, 3), (2, 3)], 0), ([(1, i) for i in range(2, 9)], 1), ([(i, 9) for i in range(1, 8)], 1), ([(1, i) for i in range(2, 9)] + [(i, 9) for i in range(2, 8)], 2)])
def test_pairs_are_spread_on_sides_with_hubs_alone(spark, monkeypatch, pairs, hubs):
    monkeypatch.setattr(parity_join, "HUB", 3)
    names = count_settled(monkeypatch, parity_join)
    sides = [spark.createDataFrame([(i, f"{x}{i}") for i in range(10)], f"{k} long, {x} string") for k, x in (("a", "x"), ("b", "y"))]
    met = parity_join._beside(spark.createDataFrame(pairs, "a long, b long"), *sides)
    assert sorted(tuple(r) for r in met.select("a", "b", "x", "y").collect()) == sorted((a, b, f"x{a}", f"y{b}") for a, b in pairs)
    assert names == ["hubs"] and met._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == hubs


def test_words_of_long_texts_do_not_depend_on_the_cut():
    text = ("ab CD\t" * 300_000).encode()
    h = word_hashes(text)
    assert len(h) == 600_000 and len(set(h.tolist())) == 2 and (h[:2] == word_hashes(b"ab cd")).all()


def test_nearest(spark):
    rng = np.random.RandomState(1)
    v = rng.randn(600, 8).astype(np.float32)
    v[50:90] = v[7]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(1000, None, 0), (1001, [0.0] * 8, 0), (1002, [float("nan")] * 8, 0), (1003, [None] * 8, 0), (None, v[0].tolist(), 0), (1004, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = kmeans_tree.nearest(df, df.where("vec_id % 25 = 0"), recall=1.0).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.query_id].append((r.id, r.score))
    w = v.astype(float)
    s = (w @ w.T) / np.outer(np.linalg.norm(w, axis=1), np.linalg.norm(w, axis=1))
    assert set(by) == set(range(0, 600, 25))
    for q, found in by.items():
        want = [int(j) for j in np.lexsort((np.arange(600), -np.round(s[q], 12))) if j != q][:5]
        assert [i for i, _ in found] == want and np.allclose([x for _, x in found], s[q][want], atol=1e-12)
    assert kmeans_tree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_chat_round_trip_and_intervals(spark, tmp_path):
    odd = ["\\### Assistant: </turn> ok", "", None, "### a: b</turn>\n", "\\", "\\\\</turn>", "x" * 50_000, "é🙂: "]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant"] * 4, odd, strict=True))]
    rows += [(2, 0, "user", odd[0]), (2, 1, "assistant", odd[1]), (2, 2, "user", "other"), (3, 0, "user", odd[0]), (4, 0, "a: b\\", "z"), (5, 1, None, "b"), (5, 1, None, "a"), (None, 0, "user", "lost")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, node int")
    folder = chat_tree.format_trees(df, str(tmp_path / "chat"))
    got = {r.conv_id: r for r in chat_tree.read_trees(spark, folder).collect()}
    for c in range(1, 6):
        turns = sorted([(t, r or "", x or "") for i, t, r, x in rows if i == c])
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    nodes = {r.node: r for r in spark.read.parquet(f"{folder}/nodes").collect()}
    assert set(nodes) == {p for n in nodes.values() for p in n.path}
    for tree in {n.tree for n in nodes.values()}:
        own = sorted((n for n in nodes.values() if n.tree == tree), key=lambda n: n.start)
        packed = "".join(n.text for n in own)
        for n in own:
            whole = "".join(nodes[p].text for p in n.path)
            assert "".join(packed[a.start : a.end] for a in n.attends) == whole and n.position == len(whole) - len(n.text)
    assert chat_tree.read_trees(spark, chat_tree.format_trees(df.limit(0), str(tmp_path / "none"))).count() == 0


def test_chat_of_one_long_conversation_and_many_branches(spark, tmp_path):
    rng = np.random.RandomState(9)
    rows = [(1, i, "user", f"t{i}") for i in range(6000)]
    for c in range(2, 120):  # most branch off the long one, some off a branch
        own = [*range(min(rng.geometric(0.05), 300))]
        rows += [(c, i, "user", f"t{i}" if i < len(own) * 2 // 3 else f"u{i}-{rng.randint(3)}") for i in own]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    folder = chat_tree.format_trees(df, str(tmp_path / "chat"), paths=False)
    got = {r.conv_id: r for r in chat_tree.read_trees(spark, folder).collect()}
    assert got[1].n_turns == 6000 and got[1].turns_sha256 == hashlib.sha256("".join(f"user\nt{i}\n" for i in range(6000)).encode()).hexdigest()
    nodes = {r.node: r for r in spark.read.parquet(f"{folder}/nodes").collect()}
    assert max(len(n.attends) for n in nodes.values()) <= 8 and "path" not in next(iter(nodes.values())).asDict()
    said = {c: tuple(x[3] for x in rows if x[0] == c) for c in range(2, 120)}
    assert len(nodes) == 6000 + len({t[:k] for t in said.values() for k in range(1, len(t) + 1) if t[k - 1][0] == "u"})
    for tree in {n.tree for n in nodes.values()}:
        packed = "".join(n.text for n in sorted((n for n in nodes.values() if n.tree == tree), key=lambda n: n.start))
        for n in nodes.values():
            if n.tree == tree and n.depth < 400:
                whole, at = n.text, n
                while at.parent:
                    at = nodes[at.parent]
                    whole = at.text + whole
                assert "".join(packed[a.start : a.end] for a in n.attends) == whole and n.position == len(whole) - len(n.text)
                assert all(a.end < b.start for a, b in zip(n.attends, n.attends[1:]))


def test_bit_packing():
    rng = np.random.RandomState(2)
    for width in range(1, 33):
        ids = rng.randint(0, 1 << width, 1000, dtype=np.int64).astype(np.uint32)
        packed = bit_packing.pack(ids, width)
        assert len(packed) <= 8 * (1000 * width // 64 + 64)
        for a, b in ((0, 1000), (1, 2), (333, 777), (999, 1000), (5, 5)):
            assert (bit_packing.unpack(packed, width, a, b) == ids[a:b]).all()


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(3, "It's <|endoftext|> über-fine ok"), (1, None), (2, ""), (9, "a b " * 60_000), (4, "\x1c don't\n\n9 99"), (9, "twice"), (None, "lost")]
    folder = bit_packing.write_ids(documents(spark, rows), path, 2, folder=str(tmp_path / "ids"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.c) for r in bit_packing.read_docs(spark, folder, bit_packing.crc32_of, "c").collect())
    tokenizer, at, by = Tokenizer.from_file(path), 0, collections.defaultdict(set)
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        by[i].add((len(ids), zlib.crc32(ids.tobytes())))
    assert [i for _, i, _, _ in got] == [1, 2, 3, 4, 9, 9]
    for start, i, n, c in got:
        assert start == at and (n, c) in by[i]
        at += n


def test_forms_of_a_word_are_encoded_once(monkeypatch):
    """Capitals and punctuation after a word's letters make no new word for the tokenizer, nor does a word that repeats; ids are the library's."""
    from tokenizers import Tokenizer

    path, given = public_tokenizers.path("word_bpe_49k.json"), []
    words = bit_packing.WordEncoder._words
    monkeypatch.setattr(bit_packing.WordEncoder, "_words", lambda self, fresh, *a: given.extend(fresh) or words(self, fresh, *a))
    monkeypatch.setattr(bit_packing.WordEncoder, "_made", {})
    stems = [f"{a}{b}stem" for a in "abcdefghij\u00e9\u00fc\u00df" for b in "klmnopqrst"]
    forms = [f(w) + after for w in stems for f in (str, str.capitalize, lambda x: x[:3].upper() + x[3:]) for after in ("", ",", ".", "!?", "***")]
    odd = ["H\u0331a", "A\u030a", "\u0130x", "I'm", "x's.", "'tis", "a'", "<|endoftext|>", "ab<|endoftext|>", "ab<|", "3a", "a3", "\u00aab", "\u03a3\u03a3", "a\x1cb", "a\u00a0b", "\u4e2d\u6587", "\u00c0\u00d7", "a\u0301", "\x01", "\u01c5", ",,a", "\x00"]
    texts = [" ".join(forms), "\n".join(forms[::-1]), None, "", " \t", "  ".join(odd), " ".join(w + x for w in stems[:9] for x in odd)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string()), pa.array([0] * len(texts), pa.int32())], names=["doc_id", "text", "shard"])
    for size in (1, 8 << 20):
        monkeypatch.setattr(bit_packing, "ENCODED", size, raising=False)
        got = {}
        for row in (r for b in bit_packing._encoded(path, 2, 16)(iter([batch])) for r in b.to_pylist()):
            ids = bit_packing.unpack(row["payload"], row["width"], 0, row["n_ids"])
            got |= {d: ids[a:b].tolist() for d, a, b in zip(row["doc_ids"], row["doc_offsets"], [*row["doc_offsets"][1:], row["n_ids"]], strict=True)}
        tokenizer = Tokenizer.from_file(path)
        assert got == {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert len(given) == len(set(given)) < len(stems) + 12 * len(odd) + 10


def test_network_gradients_match_differences():
    rng = np.random.RandomState(0)
    net = byte_rnn.Network(3, hidden=4, width=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    idx, label, real = rng.randint(0, 256, (6, 5)), rng.randint(0, 3, 5), np.arange(6)[:, None] < np.array([6, 6, 4, 5, 6])[None]
    _, g = net.gradients(idx, label, real)
    for name, value in net.p.items():
        for _ in range(4):
            at = tuple(rng.randint(0, s) for s in value.shape) if name != "embed" else (rng.randint(0, 3), idx[0, 0])
            old, step = value[at], 1e-2
            value[at] = old + step
            up = net.gradients(idx, label, real)[0]
            value[at] = old - step
            down = net.gradients(idx, label, real)[0]
            value[at] = old
            assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3


def test_language(spark):
    words = {"aa": ["the", "and", "ing"], "bb": ["der", "und", "sch"]}
    rng = np.random.RandomState(3)
    rows = [(i, " ".join(rng.choice(words[lang], 60)), lang) for i, lang in enumerate(["aa", "bb"] * 40)]
    languages, net = byte_rnn.fit(documents(spark, rows))
    odd = [(900, None), (901, ""), (902, "123 !"), (903, "THE AND " * 30_000), (904, "und der")]
    got = {r.doc_id: r for r in byte_rnn.predict(documents(spark, rows + odd), languages, net).collect()}
    assert languages == ["aa", "bb"] and all(got[i].lang_pred == lang for i, _, lang in rows)
    assert [got[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und"] * 3 + ["aa", "bb"] and got[900].score == 0 and 0.5 < got[903].score <= 1
    assert byte_rnn.predict(documents(spark, odd), *byte_rnn.fit(documents(spark, []))).where("lang_pred = 'und' AND score = 0").count() == 5


def test_swapped_terms_lower_false_positives():
    rng = np.random.RandomState(5)
    say = lambda *w: {*w, *rng.choice([f"n{i}" for i in range(60)], 6)}
    # one insult in three is not spelled out, and most toxic sentences name a group that clean ones hardly do
    texts = [say(*(["idiot"] if i % 3 else []), *(["muslims"] if i % 6 != 1 else [])) for i in range(90)] + [say("muslims") if i % 12 == 0 else say() for i in range(180)]
    labels = np.array([1.0] * 90 + [0.0] * 180)
    scores = []
    for penalty in (0.0, 40.0):
        bias, w = toxicity.fit_words(texts, labels, texts, penalty=penalty)
        value = lambda t: toxicity._sigmoid(bias + sum(w.get(f, 0) for x in t for f in toxicity.features_of(x)))  # noqa: B023, E731
        scores.append((value({"muslims"}), value({"women"}), value({"idiot"})))
    (free, other, _), (held, same, insult) = scores
    assert free > 0.5 > held and free - other > 0.3 > 0.05 > abs(held - same) and insult > 0.7, scores


def test_toxicity(spark):
    rng = np.random.RandomState(6)
    word = lambda: f"{''.join(rng.choice(list('abcdefgh'), 5))}"
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, " ".join([word() for _ in range(30)] + ["zzbad" + word() + "."] * bad)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "ZZBADfoo, you"), (903, "fine " * 40_000)]
    labels += [(0, 1), (None, 1), (5, None)]
    docs = documents(spark, rows)
    model = toxicity.fit(docs.where("doc_id < 200"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in range(200, 300)) and got[902] >= 0.7 and max(got[i] for i in (900, 901, 903)) < 0.5
    assert toxicity.fit(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))[1] == {}


def test_labels_without_a_training_text_use_up_no_sample(spark):
    rng = np.random.RandomState(8)
    rows = [(i, " ".join(["".join(rng.choice(list("abcde"), 3)) for _ in range(20)] + ["zzbad", "women."] * (i % 2))) for i in range(80)]
    docs = documents(spark, rows + rows[:9] + [(i, None) for i in range(100, 400)])
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(80), *range(100, 3000)]], "doc_id long, toxic int")
    bias, weights = toxicity.fit(docs, labels, docs_per_label=40)
    sets, y = [toxicity.words_of(t) for _, t in rows], np.array([float(i % 2) for i, _ in rows])
    want = toxicity.fit_words(sets, y, [toxicity.words_of(x) for _, t in rows for x in t.split(".")])
    assert np.isclose(bias, want[0]) and weights.keys() == want[1].keys() and all(np.isclose(weights[f], want[1][f]) for f in weights) and weights["=zzbad"] > 0
    few = toxicity.fit(docs, labels, docs_per_label=10)
    assert few[1] and few[1].keys() != weights.keys()


def leaks_by_force(docs, items, width=5):
    words = lambda x: [w for w in regex.split(r"[^\p{L}\p{N}]+", (x or "").lower()) if w]
    out = {}
    for i, t in items:
        w = words(t)
        k = min(width, len(w))
        if not w:
            continue
        bag = collections.Counter(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
        n = sum(bag.values())
        for d, x in docs:
            v = words(x)
            s = [tuple(v[a : a + k]) for a in range(len(v) - k + 1)]
            z = min(n, len(s))
            for a in range(len(s) - z + 1) if s else ():
                both = sum((collections.Counter(s[a : a + z]) & bag).values())
                if both / (n + z - both) >= 0.8 and (d is not None) and ((d, i) not in out or both / (n + z - both) > out[d, i][0]):
                    out[d, i] = (both / (n + z - both), a)
    return out


def test_leaks_equal_brute_force(spark):
    rng = np.random.RandomState(8)
    items = [(i, " ".join(prose(i, n, 3000))) for i, n in enumerate((2, 4, 5, 8, 14, 30, 59, 120))] + [(50, None), (51, " . "), (52, "so so so so so so so so so so")]
    docs = [(100, None), (101, ""), (102, "so " * 30), (103, "no " * 30_000)]
    for i, t in items[:8]:
        w = t.split()
        for edits in (0, 0, 1, 2, 3):
            v = list(w)
            for _ in range(edits):
                v[rng.randint(len(v))] = "edit"
            docs.append((len(docs), " ".join(prose(900 + i, 25)) + " " + (", ".join(v)).title() + ". " + " ".join(prose(950 + i, 25)) if edits != 2 else " ".join(v[: len(v) - 1])))
    docs += [(100, items[5][1]), (None, items[5][1])]
    bench = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.window_start) for r in decontamination.leaks(documents(spark, docs), bench).collect()}
    assert got == leaks_by_force(docs, items) and len(got) > 20
    assert decontamination.leaks(documents(spark, docs), bench.limit(0)).count() == 0 and decontamination.leaks(documents(spark, []), bench).count() == 0


def test_shards(spark):
    rows = [(i, "é" * (i % 50)) for i in range(500)] + [(700, "x" * 3000), (None, None), (None, "")] + [(800, "same " * 20)] * 60
    got = sharding.assign_shards(documents(spark, rows).withColumn("shard", F.lit(1)), 1000).collect()
    assert len(got) == len(rows)
    held = collections.Counter()
    for r in got:
        held[r.shard] += r.n_bytes
    assert all(held[r.shard] == r.shard_bytes and (r.shard_bytes <= 1000 or r.doc_id == 700) for r in got)
    names = [s for s in held if "-" not in s]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    for s in names:  # the parent of a shard does not fit
        assert sum(r.n_bytes for r in got if r.shard.startswith(s[:-1])) > 1000
    assert {r.shard for r in sharding.assign_shards(documents(spark, rows[:10]), 1 << 20).collect()} == {"root"}
    assert sharding.assign_shards(documents(spark, []), 10).count() == 0


def test_lattice_equals_enumeration():
    names, logp = lattice_lm.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    pieces = lattice_lm.Pieces(names, logp)
    assert abs(np.exp(pieces.logp).sum() - 1) < 1e-9

    def force(word):
        word, f = b" " + word, [1.0]
        for j in range(1, len(word) + 1):
            f.append(sum(f[i] * np.exp(pieces.logp[pieces.of[word[i:j]]]) for i in range(j) if word[i:j] in pieces.of))
        return np.log(f[-1])

    words = [b"a", b"the", "thére".encode(), b"\xff\xfe", b"running", b"x" * 70, b"the"]
    got, expected = lattice_lm.marginals(words, pieces, np.ones(len(words)))
    assert np.allclose(got, [force(w) for w in words])
    covered = sum(len(n) * e for n, e in zip(pieces.names, expected, strict=True))
    assert abs(covered - sum(len(w) + 1 for w in words)) < 1e-6


def test_score_texts(spark, monkeypatch):
    monkeypatch.setattr(lattice_lm, "HEAD_WORDS", 3)  # so that the join for the other words is used
    rows = [(1, "The cat the dog"), (2, None), (3, "cat  zebra"), (4, ""), (5, "q" * 300), (1, "The cat the dog"), (None, "dog")]
    df = documents(spark, rows).select("doc_id", "text", (F.col("doc_id") == 3).alias("held_out"), F.lit(1).alias("word"))
    got = lattice_lm.score_texts(df, public_tokenizers.path("piece_bpe_32k.model"), rounds=1).collect()
    train = [t for i, t in rows if i not in (3, None)]
    c = collections.Counter(w for t in train for w in (t or "").lower().split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    assert len(got) == len(rows) and all(r.train_tokens == n for r in got)
    for r in got:
        w = next((t or "").lower().split() for i, t in rows if i == r.doc_id)
        base = sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w) + np.log10((len(train) + 1) / (n + v + 1))
        assert (r.n_tokens, r.n_known) == (len(w) + 1, sum(c[x] > 0 for x in w) + 1) and abs(r.base_score - base) < 1e-9 and r.score < 0
    assert len({round(r.score, 9) for r in got if r.doc_id == 1}) == 1
    assert lattice_lm.score_texts(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_quotas_equal_highest_quotients(spark):
    rng = np.random.RandomState(9)
    for weights, seats in ((rng.randint(1, 999, 30), 57), ([5], 9), ([1, 1, 1], 2), ([1000, 1, 1, 0], 40), (rng.randint(1, 9, 12), 4000)):
        df = spark.createDataFrame([(1, int(w), int(seats), i) for i, w in enumerate(weights)], "g int, w long, n long, o int")
        got = [r.quota for r in mixing.sainte_lague(df, ["g"], "w", "n", "o").orderBy("o").collect()]
        best = sorted(((-w / (2 * i + 1), o) for o, w in enumerate(weights) if w for i in range(seats)))[:seats]
        assert got == [sum(o == x for _, x in best) for o in range(len(weights))]


def test_mix_takes_small_sources_beside_large_ones(spark):
    rows = [(i, "w " * 2000, None, "a") for i in range(100)] + [(i, "few words are in this source", None, "z") for i in range(200, 203)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert {(r.doc_id, r.taken) for r in got if r.source == "z"} == {(i, 12) for i in range(200, 203)}
    large = [r for r in got if r.source == "a"]
    assert abs(sum(r.taken for r in large) - large[0].target) <= 146  # a block


def test_mix(spark):
    rng = np.random.RandomState(10)
    rows = [(i, " ".join(prose(i, int(rng.randint(0, 80)))), "en", [None, "a", "b", "b", "c", "z"][i % 6]) for i in range(400)] + [(900, None, "en", "only"), (901, "w " * 20_000, "en", "a"), (5, "x y z", "en", "c")]
    docs = documents(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = {s: [r for r in got if r.source == s] for s in {r.source for r in got}}
    for s, part in by.items():
        assert sum(r["size"] for r in part) == part[0].source_size and abs(sum(r.taken for r in part) - part[0].target) <= max(2, 0.01 * part[0].target)
    assert abs(sum(p[0].target for p in by.values()) - 1.5 * total) < 1e-6 * total
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [(1, None)])).first().taken == 0


def test_stages(spark, tmp_path):
    """Each stage against its operator's brute force, on what the one before kept."""
    text = {i: " ".join(prose(i, 60, 3000)) for i in range(40)}
    rows = [(i, t + (" zzidiot zzidiot." if i % 4 == 0 else ""), "en", f"s{i % 2}") for i, t in text.items()]
    rows += [(50, text[1], "en", "s0"), (51, text[1] + " more", "en", "s1"), (60, "lead " + " ".join(prose(777, 20, 3000)) + " tail", "en", "s0"), (70, None, "en", "s0"), (71, "", None, None), (3, text[3], "en", "s1")]
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(30)] * 1, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, " ".join(prose(777, 20, 3000)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = documents(spark, rows)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = stages.toxicity(spark, docs, str(tmp_path))
    clean = sorted(i for i, *_ in rows if not (i < 40 and i % 4 == 0))
    assert ids(kept) == clean and kept.columns == docs.columns
    kept = stages.ngram_jaccard(spark, kept, str(tmp_path))
    assert ids(kept) == sorted(set(clean) - {50, 51}) and kept.columns == docs.columns
    kept = stages.decontamination(spark, kept, str(tmp_path))
    assert ids(kept) == sorted(set(clean) - {50, 51, 60}) and kept.columns == docs.columns
    mixed = stages.mixing(spark, kept, str(tmp_path))
    want = collections.Counter({r.doc_id: int(r.taken / r["size"] + 0.5) for r in mixing.mix(kept).collect() if r["size"]})
    assert collections.Counter(ids(mixed)) == +want and mixed.columns == docs.columns
    assert ids(stages.sharding(spark, mixed, str(tmp_path))) == ids(mixed)


# ---- names that clash, repeats, lengths, bounds

def test_columns_named_like_ours_do_no_harm(spark):
    names = ("cell", "bits", "_h", "own", "d", "s", "_n", "copies", "copy", "score", "lang_pred", "n_tokens", "shard", "n_bytes", "train_tokens", "size", "taken")
    docs = documents(spark, [(i, f"some words of text {i} " * 30, "en", "s0") for i in range(12)]).withColumns({n: F.lit(n) for n in names})
    got = sharding.assign_shards(docs, 2000).collect()
    assert len(got) == 12 and all(r.cell == "cell" and r.own == "own" and r.n_bytes == len(r.text) and r.shard_bytes <= 2000 for r in got)
    same = documents(spark, [(1, "x" * 900, "en", "s0")] * 9).withColumns({n: F.lit(n) for n in names})
    assert [(r._h, r.d, r.s) for r in sharding.assign_shards(same, 1000).collect()] == [("_h", "d", "s")] * 9
    mixed = stages.mixing(spark, docs, "")
    assert mixed.columns == docs.columns and {r.copies for r in mixed.collect()} == {"copies"}
    net = byte_rnn.train([b"abc", b"xyz"], np.array([0, 1]), 2, steps=2, batch=4)
    for model in ((["a", "b"], net), ([], None)):
        r = byte_rnn.predict(docs.select("doc_id", "text", "score", "lang_pred", "own"), *model).first()
        assert isinstance(r.score, float) and r.lang_pred in ("a", "b", "und") and r.own == "own"
    scored = lattice_lm.score_texts(docs.withColumn("held_out", F.lit(False)), public_tokenizers.path("piece_bpe_32k.model"), rounds=1).first()
    assert scored.n_tokens == 30 * 5 + 1 and isinstance(scored.score, float) and scored.cell == "cell"


def test_language_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(byte_rnn, "train", lambda windows, labels, classes, **kw: sizes.append((len(windows), classes)) or None)
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.repeat(F.lit("all the same words "), F.lit(40)).alias("text"), F.lit("en").alias("lang"))
    many = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.repeat(F.lit("eins zwei drei "), F.lit(40)), F.col("id")).alias("text"), F.lit("de").alias("lang"))
    few = spark.createDataFrame([(1, "un deux trois", "fr"), (2, None, "fr"), (3, "", "fr"), (4, "sans langue", None)], "doc_id long, text string, lang string")
    languages, _ = byte_rnn.fit(hot.union(many).union(few), docs_per_language=50)
    assert languages == ["de", "en", "fr"] and sizes[0][1] == 3
    assert 50 * 8 * 0.9 < sizes[0][0] <= 50 * 8 + 8 + 8  # 50 documents of one language, one of the others
    assert byte_rnn.fit(few.limit(0)) == ([], None)


def _exact_nearest(rows, queries, k):
    out = []
    for q, v in queries:
        a = np.array(v)
        near = sorted((-(a @ np.array(w)) / np.linalg.norm(a) / np.linalg.norm(w), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n, i) for n, (_, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_vectors_of_every_length_are_searched(spark):
    rng = np.random.RandomState(8)
    rows = [(i, rng.randn(3 if i % 5 == 0 else 8 if i % 2 else 5).tolist()) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, [0.0, 0.0]), (901, None), (902, [1.0, float("nan")]), (903, [2.0])], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0 OR vec_id IN (1, 2, 5) OR vec_id >= 900")
    got = sorted((r.query_id, r["rank"], r.id) for r in kmeans_tree.nearest(df, asked, recall=1.0).collect())
    assert got == _exact_nearest(rows, [r for r in rows if r[0] % 20 == 0 or r[0] in (1, 2, 5)], 5)


def test_default_recall_holds_beyond_the_calibration_queries(spark):
    rng = np.random.RandomState(9)
    centres = rng.randn(40, 24) * 2
    rows = [(i, (centres[i % 40] + rng.randn(24)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.id) for r in kmeans_tree.nearest(df, df.where("vec_id % 8 = 0")).collect()}
    want = {(q, i) for q, _, i in _exact_nearest(rows, [r for r in rows if r[0] % 8 == 0], 5)}
    assert len(want) == 2500 and len(got & want) >= 0.93 * len(want)


def test_language_query_on_held_out_documents(spark):
    from tablelore.llm.queries import op5_language_id

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    rows = op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    known = [r for r in rows if r.lang_pred != "und"]
    assert len(known) > 200 and sum(r.lang_pred == r.lang for r in known) >= 0.97 * len(known)


def test_toxicity_query_on_held_out_documents(spark):
    from tablelore.llm.queries import op6_toxicity

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("test tables are not here")
    rows = op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)

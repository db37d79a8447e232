"""Operators of credlake.llm against brute force, round trips and planted cases."""
from __future__ import annotations

import bisect
import hashlib
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from credlake.llm import byte_bpe, caps, chosen_path, kmeans_tree, language, main_text, minhash, packing, passages, queries, toxicity, warc
from credlake.llm.common import components, shingle_set, vocabulary_file, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, `key` int"


@pytest.fixture(scope="module", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


def documents(spark, texts, langs=None):
    """Documents with extra columns whose names clash with those used inside."""
    rows = [(i, t, (langs or {}).get(i), "s", len(t or ""), "x", 1) for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()):
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "ing", "ly", str(rng.randint(0, 99))]) for _ in range(n))


def text_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(sets, linked):
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if linked(sets[a], sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def alike(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def test_registered_queries():
    names = entry_module.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(queries.QUERIES) <= set(names)


def test_word_hashes_follow_words():
    text = "Ab\tcd  AB\x0bcd ef é".encode()
    h = word_hashes(text)
    assert len(h) == 6 and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4
    assert len(shingle_set(b"one two")) == 1 and len(shingle_set(b"")) == 0 and len(shingle_set(None)) == 0
    assert len({chosen_path.set_key(shingle_set(w.encode())) for w in ("a", "b", "c d", "d c")}) == 4


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(edges.limit(0)).collect() == []


def test_minhash_groups_equal_brute_force(spark):
    rng = random.Random(1)
    texts = {i: prose(rng, rng.randint(1, 60)) for i in range(40)}
    base = prose(rng, 120).split()
    for i in range(100, 140):  # more near copies than a node holds
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"new{rng.randint(0, 999)}"
        texts[i] = " ".join(words)
    texts |= {200: None, 201: "", 202: " \t\n", 203: "Hi", 204: "hi", 205: texts[3].upper(), 206: texts[3], 207: "word " * 3000}
    expected = brute_components({i: text_set(t) for i, t in texts.items()}, alike)
    docs = documents(spark, texts)
    for r in minhash.groups(docs.unionByName(docs.where("doc_id = 206"))).collect():
        i = r["doc_id"]
        assert (r["component_id"], r["n_shingles"]) == (expected[i], len(text_set(texts[i])))
        assert r["kept"] == (expected[i] == i)
    assert minhash.groups(docs.limit(0)).count() == 0


def test_passages_are_cut_from_all_but_the_first(spark):
    rng = random.Random(2)
    passage = prose(rng, 60)
    texts = {i: "\n".join(prose(rng, 30) for _ in range(3)) for i in range(12)}
    texts[3] += "\n" + passage
    texts[5] = passage + "\n" + texts[5]
    half = texts[7].split(" ")
    texts[7] = " ".join(half[:20] + passage.split(" ") + half[20:])
    near = passage.split(" ")
    near[10] = "changed"
    texts[9] += "\n" + " ".join(near)
    texts |= {20: None, 21: "", 22: "short line\n\nshort line"}
    docs = documents(spark, texts)
    out = {r["doc_id"]: r for r in passages.deduplicated(docs).collect()}
    assert out[3]["text"] == texts[3] and passage not in out[5]["text"] and passage not in out[7]["text"]
    assert " ".join(near) not in out[9]["text"] and out[9]["text"] == "\n".join(texts[9].split("\n")[:3])
    for i in (0, 1, 2, 4, 6, 8, 10, 11, 20, 21, 22):
        assert out[i]["text"] == texts[i]
    assert set(docs.columns) < set(passages.deduplicated(docs).columns)
    bands, rows = passages.tuned_bands()
    assert 1 - (1 - 0.75**rows) ** bands >= passages.RECALL


def test_no_word_of_a_passage_stays(spark):
    rng = random.Random(12)
    fresh = iter(f"w{n}" for n in range(10**6))
    texts, rest = {}, {}
    for k in range(40):
        passage = [next(fresh) for _ in range(51 if k % 2 else 16)]
        for i in (3 * k, 3 * k + 1, 3 * k + 2):
            before, after = ([next(fresh) for _ in range(rng.randint(1, 40))] for _ in range(2))
            lines = [" ".join(passage)] if i % 3 < 2 else [" ".join(passage[j : j + 9]) for j in range(0, len(passage), 9)]
            texts[i] = " ".join(before) + " " + "\n".join(lines) + " " + " ".join(after)
            rest[i] = before + after if i % 3 else before + passage + after
    got = {r["doc_id"]: r["text"].split() for r in passages.deduplicated(documents(spark, texts)).collect()}
    assert got == rest


def test_runs_equal_brute_force(spark):
    rng = random.Random(13)
    texts = {i: " ".join(rng.choice("abcdefghijklm") for _ in range(60)) for i in range(30)}
    for i in range(30, 60):
        texts[i] = "\n".join(" ".join(texts[rng.randrange(30)].split()[a : a + rng.randint(14, 24)]) for a in (3, 17, 31))
    docs = documents(spark, texts)
    holders = defaultdict(set)
    for i, t in texts.items():
        w = t.split()
        for a in range(len(w) - passages.WINDOW + 1):
            if len(set(w[a : a + passages.WINDOW])) >= passages.MIN_DIFFERENT:
                holders[tuple(w[a : a + passages.WINDOW])].add((i, a))
    expected = {(i, a) for places in holders.values() for i, a in places if i != min(places)[0]}
    assert expected
    got = {(r["doc_id"], a) for r in passages.repeats(docs).collect() for a in r["runs"]}
    assert got == expected


def test_byte_bpe_round_trip(spark):
    import tiktoken

    enc = byte_bpe.encoding(vocabulary_file("byte_bpe_50k.tiktoken"), __import__("public_tokenizers").PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    texts = ["", None, "Hello  world,\n\n it's 12 é😀", "a" * 70_000, ("word,  \t\x1c 34\n" * 9000) + "end ", "x  "]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in byte_bpe.digests(docs).collect()}
    ids = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(docs).collect()}
    raw = {r["doc_id"]: bytes(r["bytes"]) for r in byte_bpe.decode(byte_bpe.encode(docs)).collect()}
    for i, t in enumerate(texts):
        whole = enc.encode_ordinary(t or "")
        assert ids[i] == whole and raw[i] == (t or "").encode() and got[i]["n_tokens"] == len(whole)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(whole, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_packing_covers_every_token(spark):
    words = packing.word_ids(vocabulary_file("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = [None, "", "It's 12 can't É̈ ΣΑΣ x\u0085y a\x1cb", "<|endoftext|> hi", "ª²³ ¼ J̌ İ"] + [prose(rng, rng.randint(1, 900)) for _ in range(30)] + [prose(rng, 9000)]
    docs = documents(spark, texts)
    rows = packing.pack(docs.unionByName(docs.where("doc_id = 7")), shard_bytes=40_000).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in enumerate(texts):
        ids = np.array(words.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert sum(r["length"] for r in own[i]) == len(ids) * (2 if i == 7 else 1)
        for r in own[i]:
            piece = ids[r["start"] : r["start"] + r["length"]].tobytes()
            assert (r["ids_crc32"], r["doc_tokens"], bytes(r["ids"])) == (zlib.crc32(piece), len(ids), piece)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at & (at - 1) == 0 and at <= packing.CAPACITY  # no sequence needs padding
    assert packing.pack(docs.limit(0)).count() == 0


def test_named_grams_against_a_plain_loop():
    rng = random.Random(4)
    for _ in range(200):
        kinds, size = rng.choice((2, 9, 300)), rng.randint(0, 90)
        words = np.array([rng.randrange(kinds) for _ in range(size)], np.uint64)
        keys = passages.hashed_runs(words, passages.GRAM) if size >= passages.WINDOW else []
        plain = []
        for i in range(size - passages.WINDOW + 1):
            if len(set(words[i : i + passages.WINDOW].tolist())) >= passages.MIN_DIFFERENT:
                grams = keys[i : i + passages.WINDOW - passages.GRAM + 1]
                plain.append((i, i + int(np.argmin(grams)), int(grams.min())))
        assert list(zip(*(x.tolist() for x in passages.named_grams(words)))) == plain


def test_gram_naming_holds_few_bytes_a_word():
    """Its passes over the words, which make up its cost, are narrow; at eight bytes a number they held 65 bytes a word at the peak."""
    words = np.random.default_rng(1).integers(0, 1 << 62, 100_000, np.uint64)
    tracemalloc.start()
    passages.named_grams(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * len(words)


def test_pretokens_are_encoded_once_and_like_the_library():
    words = packing.WordIds(vocabulary_file("word_bpe_49k.json"))
    rng = random.Random(8)
    signs = [chr(c) for c in range(256)] + list("abst rdlvme.,''") * 20
    texts = [None, "", "\xa0", "it's they'll 'd''re.'s 12½ Éa\x07b", "x'", "x'r", "<|endoftext|> Ω"] + ["".join(rng.choices(signs, k=rng.randint(1, 60))) for _ in range(3000)]
    end = np.array([1], words.kind).tobytes()
    assert words.all_ids(texts) == [(words.encoded(t).tobytes() if t else b"") + end for t in texts]
    asked = []
    words.forget()
    words.learn = lambda new, learn=words.learn: (asked.extend(new), learn(new))
    words.all_ids(["One word, one word. ONE word!", "word? (one) word"])
    assert sorted(w for w in asked if not w.isspace()) == sorted([b"one", b"word", b",", b".", b"!", b"?", b"(", b")"])  # no form of a word is encoded again


def test_balanced_costs():
    pieces = packing.balanced([2048, 2048, *[64] * 64])
    spent = defaultdict(float)
    for _, _, n, s, _ in pieces:
        spent[s] += packing.cost(n)
    assert len(spent) == 4 and min(spent.values()) > 0


def test_language_codes_and_held_out(spark):
    code = language.codewords(4)
    assert code.shape == (4, 7) and min((a != b).sum() for k, a in enumerate(code) for b in code[:k]) >= 4
    many = language.codewords(20)
    assert min((a != b).sum() for k, a in enumerate(many) for b in many[:k]) > 5
    rng = random.Random(4)
    alphabets = {"aa": "the and of to in".split(), "bb": "der die und mit ist".split(), "cc": "le la et dans que".split()}
    texts, langs = {}, {}
    for i in range(150):
        lang = list(alphabets)[i % 3]
        texts[i], langs[i] = " ".join(rng.choice(alphabets[lang]) for _ in range(12)), lang
    texts |= {900: None, 901: "", 902: "12 34 !", 903: texts[0] * 2000}
    docs = documents(spark, texts, langs)
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert all(got[i]["lang_pred"] == langs[i] for i in range(150)) and got[903]["lang_pred"] == "aa"
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(docs, docs.limit(0)).collect()} == {"und"}


def test_smallest_hashes_equal_a_full_ranking(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "aa").when(F.col("id") < 20, "bb").otherwise("cc").alias("lang"))
    for table in (rows, rows.unionByName(rows.where("doc_id < 500")), rows.limit(0)):
        every = defaultdict(list)
        for r in table.select("lang", F.xxhash64("doc_id").alias("h"), "doc_id").collect():
            every[r["lang"]].append((r["h"], r["doc_id"]))
        for most in (1, 50):
            wanted = sorted((lang, i) for lang, found in every.items() for _, i in sorted(found)[:most])
            assert sorted((r["lang"], r["doc_id"]) for r in language.smallest_hashes(table, most).collect()) == wanted


def test_toxicity_grammar(spark):
    table = toxicity.compose()
    assert len(table) == len(toxicity.STATES) and all(len(r) == 6 for r in table)
    grammar = toxicity.Grammar(stems={"blor": 5.0}, words={"zug": 5.0})
    found = [(e, t) for _, _, e, t in grammar.matches("You zug! They said zug. Not a blorish thing; kill you. The zugs aloft")]
    assert [toxicity.EMISSIONS[e] for e, _ in found] == ["aimed_insult", "reported_insult", "negated_insult", "threat"]


def test_toxicity_learns_stems(spark):
    rng = random.Random(5)
    texts, labels = {}, []
    for i in range(240):
        words = prose(rng, 40).split()
        if i % 6 == 0:
            words[rng.randrange(40)] = "vrag" + rng.choice("abcdefgh")
        texts[i] = " ".join(words)
        labels.append((i, 0, int(i % 6 == 0)))
    labels += [(900, 1, None), (None, 1, 1)]
    texts |= {900: None, 901: ""}
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.rated(documents(spark, texts), marks).collect()}
    assert all(got[i]["predicted"] == int(i % 6 == 0) for i in range(240))
    assert got[900]["score"] == got[901]["score"] < 0.3
    assert {r["held_out"] for r in got.values()} == {True, False}
    assert all(r["score"] == 0 or r["score"] < 1e-6 for r in toxicity.rated(documents(spark, texts), marks.limit(0)).collect())


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, side string, filters int")


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 64))
    rows = [(i, base[i].astype(np.float32).tolist(), i % 3, "x", 1) for i in range(60)]
    for n in range(60, 140):
        b = n % 5
        rows.append((n, (base[b] + rng.normal(size=64) * 0.15).astype(np.float32).tolist(), b % 3, "x", 1))
    bad = [(500, None, 0, "x", 1), (501, [0.0] * 64, 0, "x", 1), (502, [float("nan")] * 64, 0, "x", 1), (503, [None] + [1.0] * 63, 0, "x", 1), (504, rows[0][1], None, "x", 1), (505, [1.0, 2.0], 0, "x", 1), (506, rows[0][1], 0, "x", 1)]
    return rows + bad


def test_spherical_caps_equal_brute_force(spark, clouds):
    got = {r["vec_id"]: r for r in caps.groups(vectors(spark, clouds)).collect()}
    good = {i: (np.array(v, np.float64), label) for i, v, label, *_ in clouds if i < 500 or i == 506}
    unit = {i: v / np.linalg.norm(v) for i, (v, _) in good.items()}
    near = lambda a, b: good[a][1] == good[b][1] and float((unit[a] * unit[b]).sum()) >= caps.COSINE
    root = brute_components({i: i for i in good}, near)
    for i, r in got.items():
        assert r["n_links"] == (sum(near(i, j) for j in good if j != i) if i in good else 0)
        assert r["component_id"] == root.get(i, i) and r["kept"] == (root.get(i, i) == i)
    assert len(got) == len(clouds) and caps.groups(vectors(spark, clouds).limit(0)).count() == 0


def test_every_vector_length_is_linked(spark):
    rng = np.random.default_rng(15)
    base = {size: rng.normal(size=size) for size in (64, 48)}
    rows = [(i, (base[size] + rng.normal(size=size) * 0.01).astype(np.float32).tolist(), 0, "x", 1) for i, size in enumerate([64] * 5 + [48] * 3)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.groups(vectors(spark, rows)).collect()}
    assert got == {i: (4, 0) if i < 5 else (2, 5) for i in range(8)}


def test_spherical_caps_recall_at_the_threshold():
    rng = np.random.default_rng(7)
    x, z = rng.normal(size=(2, 400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = caps.COSINE * x + np.sqrt(1 - caps.COSINE**2) * z / np.linalg.norm(z, axis=1)[:, None]
    filters = caps.Filters(64)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(filters.passed(x), filters.passed(y))]) >= 0.96


def test_parts_of_a_crowded_filter_lose_nothing(spark, clouds, monkeypatch):
    whole = sorted(map(tuple, caps.groups(vectors(spark, clouds)).collect()))
    monkeypatch.setattr(caps, "PART", 7)
    assert sorted(map(tuple, caps.groups(vectors(spark, clouds)).collect())) == whole


def test_texts_hashed_together_as_apart():
    from credlake.llm import common

    texts = [None, "", " \n", "a", "a b c", "A b c d e", "x\ny z\n", "é ü " * 40, "one two three four five " * 9, None] * 3
    together = [s for part in common.shingle_sets(pa.array(texts)) for s in part]
    apart = [common.shingle_set(t.encode() if t else None) for t in texts]
    assert [s.tolist() for s in together] == [s.tolist() for s in apart]
    assert [k for k, _ in chosen_path._named_sets(pa.array(texts), 5)] == [chosen_path.set_key(s) for s in apart]


@pytest.mark.parametrize("groups, values", [(7, 5), (7, 1 << 20), (7, 1 << 63), (1 << 25, 9)])
def test_distinct_within_groups(groups, values):
    from credlake.llm import common

    rng = np.random.default_rng(3)
    g, v = rng.integers(0, groups, 3000), rng.integers(0, values, 3000).astype(np.uint64)
    one, two = common.distinct_within(g, v)
    assert list(zip(one.tolist(), two.tolist())) == sorted(set(zip(g.tolist(), v.tolist())))


def test_strangers_rarely_meet_in_a_filter():
    x = np.random.default_rng(8).normal(size=(4000, 64))
    names, counts = np.unique(np.concatenate([*caps.Filters(64).passed(x)]), return_counts=True)
    assert 1 - len(names[counts == 1]) / counts.sum() < 0.05
    for rows in (0, 100, 65_536, 10**6):
        c = caps.codewords(rows)
        assert 4 * rows * caps.TAKEN[c] <= c**caps.BLOCKS


@pytest.mark.parametrize("words", caps.TAKEN)
def test_every_codebook_finds_near_pairs(words):
    x, z = np.random.default_rng(9).normal(size=(2, 200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = caps.COSINE * x + np.sqrt(1 - caps.COSINE**2) * z / np.linalg.norm(z, axis=1)[:, None]
    filters = caps.Filters(64, words)
    one, two = filters.passed(x), filters.passed(y)
    assert (np.diff(one, axis=1) > 0).all() and one.shape[1] == caps.TAKEN[words]
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(one, two)]) >= 0.96


def test_cells_compared_together_as_apart(spark, clouds, monkeypatch):
    whole = sorted(map(tuple, caps.groups(vectors(spark, clouds)).collect()))
    monkeypatch.setattr(caps, "SMALL", 1)
    monkeypatch.setattr(caps, "AT_ONCE", 3)
    assert sorted(map(tuple, caps.groups(vectors(spark, clouds)).collect())) == whole


def test_kmeans_tree_search(spark, clouds):
    table = vectors(spark, clouds).withColumn("leaf", F.lit(1))
    got = defaultdict(list)
    for r in kmeans_tree.search(table, table.where("vec_id % 20 = 0"), k=20).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(v, np.float64) for i, v, *_ in clouds if i < 500 or i in (504, 506)}
    hits = 0
    for q, found in got.items():
        found.sort()
        true = sorted(((-float((good[i] * good[q]).sum()), i) for i in good if i != q))[:20]
        hits += len({i for _, i in true} & {i for _, i, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
    assert set(got) == {i for i in good if i % 20 == 0} and hits >= 0.9 * 20 * len(got)
    few = table.where("vec_id in (0, 1, 2)")
    assert kmeans_tree.search(few, few.where("vec_id = 0")).count() == 2
    assert kmeans_tree.search(table.limit(0), table).count() == 0


def test_kmeans_tree_search_of_every_length_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(kmeans_tree, "VECTORS_PER_LEAF", 20)
    rng = np.random.default_rng(16)
    sizes = {i: (12, 12, 7)[i % 3] for i in range(600)} | {700: 5, 720: 5, 740: 3}
    good = {i: rng.normal(size=size).astype(np.float32) for i, size in sizes.items()}
    for i in range(3, 30, 3):
        good[i] = good[0]  # ties
    rows = [(i, v.tolist(), 0, "x", 1) for i, v in good.items()] + [(20, good[20].tolist(), 0, "x", 1), (None, good[0].tolist(), 0, "x", 1)]
    table = vectors(spark, rows)
    got = defaultdict(list)
    for r in kmeans_tree.search(table, table.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = asked = 0
    for q in [i for i in good if i % 20 == 0]:
        other = {i: float((good[i].astype(np.float64) * good[q].astype(np.float64)).sum()) for i in good if i != q and len(good[i]) == len(good[q])}
        true = sorted(other, key=lambda i: (-other[i], i))[:10]
        assert len(got[q]) == len(true) and all(abs(s - other[i]) < 1e-9 for i, s in got[q])
        assert [i for i, _ in got[q]] == sorted((i for i, _ in got[q]), key=lambda i: (-other[i], i))
        hits += len(set(true) & {i for i, _ in got[q]})
        asked += len(true)
    assert hits >= 0.9 * asked and [i for i, _ in got[700]] == [720] and got[740] == []


PAGES = "page_id long, url string, html string, key string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)


def test_main_text_of_declared_and_undeclared_pages(spark):
    notice = "<div>All rights are kept by this fine site of ours</div>"
    rows = [
        (1, "http://a.b/x", '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div>'
         "<article><h1>Big&amp;&lt;</h1><p><b>One\n two</b>three<br><p>four<form>f</form><div class='comments'>c</div></article><footer>F</footer></body></html>"),
        (2, "http://c.d/1", f"<body><div>own words of page two stand here</div>{notice}</body>"),
        (3, "http://c.d/2", f"<body><p>the other page has its text</p>{notice}<div id=sidebar>side</div></body>"),
        (4, None, None), (5, "http://c.d/3", ""), (6, "x", "<p>loose & <i>free"), (7, "http://e.f", "<main>m <aside>no</aside>n</main>rest"),
        (1, "http://a.b/x", "<article>again</article>"),
    ]
    got = defaultdict(list)
    for r in main_text.extracted(pages(spark, rows)).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert sorted(got[1]) == ["Big&< One twothree four", "again"]
    assert got[2] == ["own words of page two stand here"] and got[3] == ["the other page has its text"]
    assert got[4] == got[5] == [""] and got[6] == ["loose & free"] and got[7] == ["m n"]
    assert main_text.extracted(pages(spark, rows).limit(0)).count() == 0


def test_main_text_keeps_what_only_some_undeclared_pages_share(spark):
    rng = random.Random(14)
    phrases = [prose(rng, 8) for _ in range(5)]
    shared, notice, footer = prose(rng, 40), prose(rng, 30), prose(rng, 7)
    own = {i: f"{prose(rng, 30)} {rng.choice(phrases)} {prose(rng, 30)}" for i in range(60)}
    own[1] = own[0].rsplit(" ", 2)[0] + " other end"  # near copy
    for i in range(2, 12):  # a passage on fewer pages than the share
        own[i] += " " + shared
    rows = [(i, f"http://big.host/{i}", f"<p>{t}</p><p>start{i} {notice} end{i}</p><div>{footer}</div>") for i, t in own.items()]
    rows += [(100 + i, f"http://big.host/{100 + i}", rows[20][2]) for i in range(30)]  # exact copies are one page
    got = {r["page_id"]: r["text"] for r in main_text.extracted(pages(spark, rows)).collect()}
    for i, t in own.items():
        assert got[i] == f"{t} start{i} end{i}"
    assert all(got[100 + i] == got[20] for i in range(30))


@pytest.mark.parametrize("attributes", [
    'href="/hidden-gems"', 'style="overflow:hidden"', 'href="/p?id=comments"', "href=/p?id=comments", "title='class=ad hidden'",
    'data-id="comments"', 'data-hidden', 'my-class="ad"', 'aria-hidden="false"', 'href="/a?role=main" title="a > hidden"',
])
def test_names_inside_attribute_values_set_nothing_apart(attributes):
    assert main_text.blocks(f"<article><p>one</p><p {attributes}>two</p><a {attributes}>three</a></article>") == [(2, "one"), (2, "two"), (2, "three")]
    assert main_text.article(main_text.blocks(f"<div {attributes}>own</div>")) is None


@pytest.mark.parametrize("attributes", ["hidden", 'HIDDEN=""', "x=y hidden", "aria-hidden = 'true'", 'class="big ad"', "id=comments", "class='a'id='sidebar'", 'role="navigation"'])
def test_attributes_that_set_apart(attributes):
    assert main_text.article(main_text.blocks(f"<article><p>one</p><p {attributes}>two</p><p>three</p></article>")) == "one three"


@pytest.mark.parametrize("html, text", [
    ("<article><p>own</p></article><article class='comment'><p>theirs</p></article>", "own"),
    ("<article><p>own</p><article class='related-teaser'>other</article><p>end</p></article>", "own end"),
    ("<article class='post comments-open has-sidebar'><p>own</p></article>", "own"),
    ("<main><p>own</p><div class='adbox'>buy</div><div id='ad_slot'>buy</div><div class='adslots x'>buy</div><p class='adverb'>end</p></main>", "own end"),
    ("<article><p class=\"x>Hello</p><p>there <a href=\"z\">you</a></p></article>", "Hello there you"),
    ("<article><p title=\"a <b> c\">one</p><p title='it\"s > x'class=y>two</p></article>", "one two"),
])
def test_main_text_of_comments_teasers_adverts_and_open_quotes(html, text):
    assert main_text.article(main_text.blocks(html)) == text


def test_main_text_of_small_hosts_and_numbered_footers(spark):
    rng = random.Random(21)
    shared, footer = prose(rng, 40), prose(rng, 12)
    own = {i: prose(rng, 25) for i in range(10, 16)}
    rows = [(1, "http://two.host/a", f"<p>{shared}</p>"), (2, "http://two.host/b", f"<p>{shared}</p><p>tail one</p>")]
    rows += [(i, f"http://six.host/{i}", f"<p>{t}</p><div>{footer} {i}</div>") for i, t in own.items()]
    got = {r["page_id"]: r["text"] for r in main_text.extracted(pages(spark, rows)).collect()}
    assert got == {1: shared, 2: f"{shared} tail one"} | {i: f"{t} {i}" for i, t in own.items()}


def test_very_long_html(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, "http://l.m/", f"<nav>menu</nav><article><p>{words}</p></article>")]
    assert main_text.extracted(pages(spark, rows)).first()["text"] == words
    assert warc.round_trip(pages(spark, rows)).first()["payload_bytes"] == len(rows[0][2])


def test_a_capture_of_a_hot_url_reads_few_index_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 20)
    rows = [(i, "http://hot.url/" if i < 1500 else f"http://u{i}.url/", f"page {i}") for i in range(3000)]
    table = pages(spark, rows)
    folder = f"{tmp_path}/warc"
    top = warc.index(warc.write(table, folder), folder)
    assert [warc.capture(*t[:2]) for t in top] == sorted(warc.capture(*t[:2]) for t in top)
    one, walked = bisect.bisect_right, spark.sparkContext.accumulator(0)

    class Counted:
        bisect_left = staticmethod(bisect.bisect_left)

        @staticmethod
        def bisect_right(*args):
            walked.add(max(0, one(*args) - max(0, bisect.bisect_left(*args) - 1)))
            return one(*args)

    monkeypatch.setattr(warc, "bisect", Counted)
    found = warc.read(warc.locate(table, top, folder), folder).select("page_id").collect()
    assert sorted(r[0] for r in found) == list(range(3000))
    assert 0 < walked.value <= 4 * len(rows)  # index files and blocks looked at, two a capture at most each


def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ENTRIES", 3)
    long, other = "é" * 80, "z" * 200
    rows = [(9, "http://www.A.com/p?q=1", long), (3, "http://b.org:8080/", long), (4, "http://b.org:8080/", long), (5, None, "tiny"), (6, "http://c.d/\r\nx", "tiny"), (7, "", None), (8, "http://[bad", other), (8, "http://[bad", other), (None, "http://n/", other)]
    got = sorted((tuple(r) for r in warc.round_trip(pages(spark, rows)).collect()), key=str)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h, i)
    expected = []
    for i, _, h in rows:
        b = (h or "").encode()
        f = first[h] if len(b) >= 100 else i
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "response" if f == i else "revisit", None if f == i else f))
    assert got == sorted(expected, key=str)
    assert warc.url_key("http://www.Example.com:80/a?b") == "com,example,www)/a?b"
    assert warc.round_trip(pages(spark, rows).limit(0)).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language identification" and len(corpus_pipeline.STAGES) == 5
    kept = corpus_pipeline.known_language(spark, docs, "/root/testdata/sf0.001")
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    clean = corpus_pipeline.not_toxic(spark, docs, "/root/testdata/sf0.001")
    assert clean.columns == docs.columns and clean.count() >= 0.8 * docs.count()
    assert corpus_pipeline.sequences(spark, docs.limit(0), "").count() == 0

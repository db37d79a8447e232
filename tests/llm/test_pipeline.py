"""The corpus pipeline, stage by stage, against plain Python; and paragraph removal."""
from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from credlake.llm import language, packing, passages, toxicity
from credlake.llm.common import kept_rows, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, input0 string, gone long"
EN = "the and of that with from this have they which would there their about could other".split()
DE = "der die und nicht mit sich auch auf eine nach wenn oder aber durch wird einer".split()


def shingles(text):
    words = WORD.findall(text.lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def components(sets):
    parent = {k: k for k in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if alike(sets[a], sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in ids}


def fixture(rng):
    """Texts of two languages, toxic ones, copies, near copies, and a passage that many share."""
    def prose(words, n):
        return " ".join(rng.choice(words) + (f"{rng.choice('xyz')}{rng.randint(0, 999)}" if rng.random() < 0.3 else "") for _ in range(n))

    texts = {i: prose(EN if i % 2 else DE, 60) for i in range(300)}
    for i in range(0, 300, 6):
        texts[i] += f" you are a {rng.choice(['grumblefool', 'grumblefoolish'])} and {rng.choice(EN)}. {prose(EN, 5)}"
    toxic = set(range(0, 300, 6))
    shared = prose(EN, 55)
    for i in (301, 303, 305):
        texts[i] = prose(EN, 40) + "\n" + shared + "\n" + prose(EN, 30)
    texts |= {400: texts[1], 401: texts[1], 402: texts[3].replace(texts[3].split()[10], "altered"), 500: None, 501: "", 502: "12 34 --", 503: "  \n"}
    return texts, toxic


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    texts, toxic = fixture(random.Random(8))
    rows = [(i, t, ("en" if i % 2 else "de") if i < 300 else None, "s", len(t or ""), "x", 1) for i, t in texts.items()] + [(1, texts[1], "en", "s", 1, "x", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts


def test_stages_equal_plain_rules(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = docs
        docs = written(stage(spark, docs, folder), "test-stage")
        if name != "packing":
            assert docs.columns == kept[name].columns
    rows = {name: [tuple(r) for r in df.select("doc_id", "text").collect()] for name, df in kept.items()}
    packed = docs

    told = {r["doc_id"] for r in language.identify(kept["language identification"]).where("lang_pred <> 'und' and not (ambiguous and score < 0.4)").collect()}
    assert {i for i, _ in rows["toxicity"]} == told and not told & {500, 501, 502, 503} and len(told) > 290
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    calm = {r["doc_id"] for r in toxicity.rated(kept["toxicity"], labels).where("predicted = 0").collect()}
    assert {i for i, _ in rows["near duplicates"]} == calm and not calm & set(range(0, 300, 6)) and len(calm) > 200
    before, after = rows["near duplicates"], rows["substring deduplication"]
    of = components({i: shingles(t) for i, t in before})
    assert sorted(after) == sorted((i, t) for i, t in before if of[i] == i) and {400, 401, 402} & {i for i, _ in after} == set()
    cut = dict(rows["packing"])
    assert cut[301] == texts[301] and all(cut[i].split("\n") == texts[i].split("\n")[::2] for i in (303, 305))
    assert all(cut[i] == texts[i] for i in cut if i not in (303, 305))
    expected = packing.pack(kept["packing"], include_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {(r["doc_id"], r["n"]) for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == {(r["doc_id"], r["n"]) for r in expected}


def test_a_run_equals_its_stages(spark, tables):
    folder, texts = tables
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in rows}
    assert 301 in ids and not ids & {0, 6, 400, 401, 402, 500, 501, 502, 503} and len(ids) > 200


def test_an_empty_table_passes_all_stages(spark, tables, tmp_path):
    folder, _ = tables
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_kept_rows_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "b"), (3, "c", "d")], "usable int, text string, Usable_ string")
    got = kept_rows(df, lambda texts, usable: texts.is_valid().to_numpy(zero_copy_only=False) & usable, "text", F.col("text") != "c")
    assert got.columns == df.columns and [r["usable"] for r in got.collect()] == [1]


@pytest.mark.parametrize("min_words", [1, 20])
def test_paragraphs_equal_brute_force(spark, min_words):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    pool = [" ".join(rng.sample(words, rng.choice([2, 4, 5, 12, 22, 30, 45]))) for _ in range(30)]

    def changed(line):
        parts = line.split()
        if rng.random() < 0.5 and len(parts) > 8:
            parts[rng.randrange(len(parts))] = f"n{rng.randint(0, 99)}"
        return " ".join(parts)

    texts = {i: "\n".join(changed(rng.choice(pool)) for _ in range(rng.randint(0, 5))) for i in range(60)}
    texts |= {90: None, 91: "", 92: "\n\n", 93: "ü " * 40_000}
    rows = [(i, t, 1, 2, 3, "m") for i, t in texts.items()] + [(None, texts[3], 1, 2, 3, "m"), (5, texts[5], 1, 2, 3, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_cut_lines int, id int, mark int, lines string")
    sets = {}
    for i, t in texts.items():
        for line in (t or "").split("\n"):
            if len(WORD.findall(line)) >= min_words:
                sets.setdefault(shingles(line), set()).add(i)
    names = {s: k for k, s in enumerate(sorted(sets, key=sorted))}
    cluster = components({k: s for s, k in names.items()})
    first = {}
    for s, holders in sets.items():
        c = cluster[names[s]]
        first[c] = min(first.get(c, 10**9), *holders)
    expected = {}
    for i, t in texts.items():
        gone = [n for n, line in enumerate((t or "").split("\n")) if len(WORD.findall(line)) >= min_words and first[cluster[names[shingles(line)]]] != i]
        if gone:
            expected[i] = gone
    got = {r["doc_id"]: sorted(r["lines"]) for r in passages.repeated_lines(docs, min_words).collect()}
    assert got == expected and len(got) > 10
    out = passages.deduplicated(docs, min_words)
    assert {"id", "mark", "lines", "n_cut_lines", "n_cut_runs"} <= set(out.columns) and out.count() == len(rows)
    assert passages.deduplicated(docs.limit(0)).collect() == []

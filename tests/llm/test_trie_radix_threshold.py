"""Prefix trie, radix de-duplication and threshold-algorithm mining against brute force."""
from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from credlake.errors import SharedFolderError
from credlake.llm import prefix_trie, queries, radix, threshold
from credlake.llm.common import new_folder, with_group

SF = Path("/root/testdata/sf0.001")
CONVERSATIONS = "conv_id long, turn long, role string, text string, node string, place int, top string"
DOCS = "doc_id long, text string, path string, digit int, rest string"
VECTORS = "vec_id long, embedding array<double>, label int, size int, cell string"


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(role, text) for _, role, _, text in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = (*own.get(c - c % 20, [])[:h], *v[h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        tokens = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += tokens
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(p))
        out.append((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def conversations(rng):
    rows = []
    for c in range(90):
        if c % 20 == 0 and c == 60:
            continue  # a lender that isn't there
        long = c == 41
        for t in range(300 if long else rng.randint(1, 5)):
            text = "same opening here" if t == 0 and c % 3 else rng.choice(["yes", "no", "a b\tc", "", None, "Ünïcode  spaces\x0bhere", f"own {c} {t}"])
            rows.append((c, rng.choice([t, t, t, None, 2]) if not long else t, rng.choice(["user", "assistant", None]), text, "n", 1, "x"))
    rows += [(7, 9, "user", "twice", "n", 1, "x")] * 2 + [(None, 1, "user", "nobody's", "n", 1, "x"), (1000, 1, None, None, "n", 1, "x")]
    return rows


@pytest.mark.parametrize("small", [4, prefix_trie.SMALL])
def test_trie_equals_brute_force(spark, small):
    rows = conversations(random.Random(5))
    df = spark.createDataFrame(rows, CONVERSATIONS)
    got = sorted((tuple(r) for r in prefix_trie.trie(df, small).collect()), key=lambda r: r[:2])
    assert got == brute_trie(rows)


def test_trie_of_edge_tables(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.trie(empty).collect() == []
    # only a turnless conversation: all its turns are given up for those of a lender that isn't there
    alone = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    df = spark.createDataFrame([(alone, 1, "user", "gone", "n", 1, "x")], CONVERSATIONS)
    row = prefix_trie.trie(df).collect()
    assert [tuple(r) for r in row] == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    negative = spark.createDataFrame([(-23, 1, "user", "a", "n", 1, "x")], CONVERSATIONS)
    assert prefix_trie.trie(negative).count() >= 1


def test_centroid_sums_equal_walks():
    rng = random.Random(3)
    for n in (1, 2, 7, 60, 400):
        for shape in ("random", "chain", "star"):
            parent = [-1] + [rng.randrange(i) if shape == "random" else i - 1 if shape == "chain" else 0 for i in range(1, n)]
            weights = np.array([[rng.randint(0, 9), rng.randint(-5, 5)] for _ in range(n)])
            expected = weights.copy()
            for v in range(n - 1, 0, -1):
                expected[parent[v]] += expected[v]
            assert (prefix_trie.subtree_sums(parent, weights) == expected).all()


def test_joined_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(bytes([k]), c) for k in range(4) for c in random.Random(k).sample(range(1000), 50)]
    got = {bytes(r["node"]): r["sha256"] for r in prefix_trie.joined_ids(spark.createDataFrame(rows, "node binary, conv_id long")).collect()}
    for k in range(4):
        ids = ",".join(map(str, sorted(c for n, c in rows if n == bytes([k]))))
        assert got[bytes([k])] == hashlib.sha256(ids.encode()).hexdigest()


def test_radix_equals_brute_force(spark):
    rng = random.Random(1)
    stem = "shared opening of many documents " * 40
    texts = {i: stem + rng.choice(["", "a", "b", "é", " tail" * 200, "\0", "\0\0"]) for i in range(60)}
    texts |= {100 + i: "x" * n for i, n in enumerate([0, 1, 7, 8, 9, 63, 64, 65, 64, 1024, 1088, 1088])}
    texts |= {200: None, 201: "", 202: None, 203: "Case", 204: "case", 205: "case "}
    texts |= {300: "y" * 300_000, 301: "y" * 300_000, 302: "y" * 299_999 + "z"}
    rows = [(i, t, "p", 1, "r") for i, t in texts.items()] + [(204, "case", "p", 1, "r"), (None, "case", "p", 1, "r"), (None, "nobody's", "p", 1, "r"), (None, "nobody's", "p", 1, "r")]
    members = defaultdict(list)
    for i, t, *_ in rows:
        members[t or ""].append(i)
    expected = []
    for i, t, *_ in rows:
        keep = max((j for j in members[t or ""] if j is not None), default=None)
        expected.append((i, keep, len(members[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0, r[4])
    docs = spark.createDataFrame(rows, DOCS)
    for options in ({}, {"first": 8, "widening": 2, "largest": 1 << 14}):
        got = [tuple(r) for r in radix.groups(docs, **options).collect()]
        assert sorted(got, key=order) == sorted(expected, key=order)
    assert radix.groups(docs.limit(0)).collect() == []


def brute_negatives(rows, anchors):
    usable = {}
    for v, x, label, *_ in sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[0], r[2])):
        if x and all(c is not None and math.isfinite(c) for c in x):
            usable.setdefault(v, ([math.floor(256 * c) for c in x], label))
    out = []
    for a in sorted(usable):
        if a not in anchors:
            continue
        x, label = usable[a]
        scored = sorted((-sum(p * q for p, q in zip(x, y)), v, other) for v, (y, other) in usable.items() if v != a and len(y) == len(x))
        positives = [(v, -s) for s, v, other in scored if other == label][:5]
        for v, p in positives:
            inside = [(n, -s) for s, n, other in scored if other != label and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(a, v, rank, n, p, s) for rank, (n, s) in enumerate(inside, 1)]
    return sorted(out)


def test_mined_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(threshold, "BLOCK_BYTES", 4 * 64 * 8)
    monkeypatch.setattr(threshold, "PACK", 3)
    monkeypatch.setattr(threshold, "PACKS_A_TASK", 2)
    rng = random.Random(4)
    rows = []
    for i in range(700):
        size = 8 if i % 9 else 5
        centre = [1.0 if j == i % 4 else 0.2 for j in range(size)]
        rows.append((i, [round(c + rng.gauss(0, 0.4), 1 if i % 2 else 6) for c in centre], rng.choice([0, 0, 0, 1, 2, 5]), 1, "c"))
    rows += [(1000, None, 1, 1, "c"), (1001, [], 1, 1, "c"), (1002, [0.0] * 8, 1, 1, "c"), (1003, [float("nan")] + [1.0] * 7, 1, 1, "c"), (1004, [float("inf")] * 8, 1, 1, "c")]
    rows += [(1005, [1.0] * 8, None, 1, "c"), (None, [1.0] * 8, 1, 1, "c"), (1006, [1.0, None] * 4, 1, 1, "c"), (50, [9.0] * 8, 9, 1, "c"), rows[10], rows[100]]
    anchors = {i for i in range(0, 1010) if i % 50 == 0} | {1002}
    df = spark.createDataFrame(rows, VECTORS)
    is_anchor = (F.col("vec_id") % 50 == 0) | (F.col("vec_id") == 1002)
    got = sorted(tuple(r) for r in threshold.mined(df, is_anchor).collect())
    assert got == brute_negatives(rows, anchors) and len(got) > 100
    assert threshold.mined(df.limit(0), is_anchor).collect() == []


def test_threshold_stops_early_and_stays_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-20, 20, (4000, 4))
    x[:10] = 200  # far above the rest
    block = threshold.Block(np.arange(4000), np.zeros(4000, np.int32), x)
    found, scores, scored = block.read(np.array([3, 1, -2, 0]), np.ones(4000, bool), [threshold.Span(None, None, 5)])
    exact = x @ np.array([3, 1, -2, 0])
    assert found[0].tolist() == np.lexsort((np.arange(4000), -exact))[:5].tolist() and scored < 2000
    high = threshold.Block(np.arange(3), np.zeros(3, np.int32), np.array([[1 << 62, 1 << 62], [1 << 40, 5], [-(1 << 62), -(1 << 62)]]))
    _, scores, _ = high.read(np.array([1 << 30, 1 << 30]), np.ones(3, bool), [threshold.Span(None, None, 3)])
    assert scores[0].tolist() == [(1 << 63) - 1, ((1 << 40) + 5) << 30 if (((1 << 40) + 5) << 30) < 1 << 63 else (1 << 63) - 1, -(1 << 63)]


def test_with_group_gives_every_row_its_group(spark):
    rows = [(k % 3, k) for k in range(200)]
    got = with_group(spark.createDataFrame(rows, "g int, v long"), ["g"], F.col("v"), n=(F.sum, F.lit(1).cast("long")), top=(F.max, F.col("v"))).collect()
    assert sorted((r["g"], r["v"]) for r in got) == sorted(rows)
    assert {(r["g"], r["n"], r["top"]) for r in got} == {(0, 67, 198), (1, 67, 199), (2, 66, 197)}


def test_an_unset_shared_folder_is_an_error():
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default))
    with pytest.raises(SharedFolderError):
        new_folder(unset, "x")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_match_their_sql(spark, name):
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    result = connection.execute(queries.ORACLE[name])
    columns = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, str(SF))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, result.fetchall()))

"""Set similarity join by chosen paths.

A set is known by its minwise hashes. Each of ``trees`` independent trees starts by dealing
all sets by ``ROWS`` minwise tokens at once: nodes of fewer tokens would be crowded by what
merely shares a common passage, and the more so the larger the corpus. A node of at most ``NODE_SIZE`` sets is compared exhaustively
on compact sketches; in a larger node every set is compared with one hub, and unless all of
its sets are then linked already, the node branches: each path chooses ``BRANCHES`` further
tokens by a hash of itself, and its sets go on to the children that hold their token. What is
still dense after ``LEVELS`` levels is compared in full. A pair of Jaccard similarity s meets
in a root with probability s^ROWS, so at 0.75 ``TREES`` trees miss one pair in 10^5, and a
pair at 0.3 meets in a root with 0.027; in one of a node's children it meets with
1 - (1 - s)^BRANCHES.

Sketches only choose candidates: a pair is a link when its full sets say so. Pairs inside a
component that is known already are passed over, so large groups of near copies cost about
one comparison per set. No group is gathered: nodes of any size are joined by Spark, hub
groups are salted, and only nodes of NODE_SIZE sets are held in a task.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import components, grouped_runs, mix64, released, seeds, shingle_sets, written, written_narrow

TREES = 21
ROWS = 3
NODE_SIZE = 24
BRANCHES = 2
SIMILARITY = 75  # percent
HUB_PART = 256
LEVELS = 2
SALT = 11
_KEY = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], dtype=np.uint64)


def set_key(hashes: np.ndarray) -> int:
    """A 64-bit name of a set of hashes."""
    total = np.array([np.sum(mix64(hashes), dtype=np.uint64), np.bitwise_xor.reduce(hashes) ^ np.uint64(len(hashes) * 0x51ED2701)])
    return int(mix64(np.sum(mix64(total) * _KEY, keepdims=True, dtype=np.uint64))[0].astype(np.int64))


def set_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``set_key`` of the runs of hashes that begin at ``starts``."""
    sizes = np.diff(np.append(starts, len(hashes))).astype(np.uint64)
    total = np.stack([np.add.reduceat(mix64(hashes), starts), np.bitwise_xor.reduceat(hashes, starts) ^ (sizes * np.uint64(0x51ED2701))], axis=1)
    return mix64(np.sum(mix64(total) * _KEY, axis=1, dtype=np.uint64)).astype(np.int64)


def _named_sets(texts: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """Key and shingle set of every text."""
    for sets in shingle_sets(texts, shingle):
        sizes = np.array([len(x) for x in sets])
        full = np.flatnonzero(sizes)
        keys = np.full(len(sets), set_key(np.empty(0, np.uint64)))
        if len(full):
            keys[full] = set_keys(np.concatenate(sets), (np.cumsum(sizes) - sizes)[full])
        yield from zip(keys.tolist(), sets)


def _sketch(signature: np.ndarray) -> np.ndarray:
    return (signature & np.uint32(0xFF)).astype(np.uint8)


def _signatures(column: pa.Array) -> np.ndarray:
    flat = b"".join(column.to_pylist()) if len(column) else b""
    return np.frombuffer(flat, "<u4").reshape(len(column), -1)


def roots(items: DataFrame, trees: int, rows: int = 1) -> DataFrame:
    """(key, path): a path per tree, made of ``rows`` minwise tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = seeds(trees, SALT)
        for batch in batches:
            if batch.num_rows:
                sig = _signatures(batch.column(1))
                path = salt[None, :] + np.zeros((len(sig), 1), np.uint64)
                for r in range(rows):
                    path = mix64(path ^ sig[:, r * trees : (r + 1) * trees])
                path = path.astype(np.int64)
                yield pa.record_batch([pa.array(np.repeat(batch.column(0).to_numpy(), trees)), pa.array(path.ravel())], ["key", "path"])

    return items.select("key", "sig").mapInArrow(run, "key bigint, path bigint")


def children(rows: DataFrame) -> DataFrame:
    """(key, path) of the next level from (key, path, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures(batch.column(2))
            path = batch.column(1).to_numpy().astype(np.uint64)
            out = []
            for j in range(BRANCHES):
                chosen = (mix64(path + np.uint64(j + 1)) % np.uint64(sig.shape[1])).astype(np.int64)
                token = sig[np.arange(len(sig)), chosen].astype(np.uint64)
                out.append(mix64(path * np.uint64(31) + np.uint64(j) ^ mix64(token)).astype(np.int64))
            yield pa.record_batch([pa.array(np.tile(batch.column(0).to_numpy(), BRANCHES)), pa.array(np.concatenate(out))], ["key", "path"])

    return rows.select("key", "path", "sig").mapInArrow(run, "key bigint, path bigint")


def _alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: int) -> np.ndarray:
    """Whether sketches (last axis) and sizes leave a similarity of ``similarity`` percent possible, by four standard deviations and more."""
    k = a.shape[-1]
    share = (a == b).sum(-1) / k
    s = similarity / 100
    least = s - 4.6 * np.sqrt(s * (1 - s) / k)
    return (share >= least) & (100 * np.minimum(na, nb) >= similarity * np.maximum(na, nb))


def _small_pairs(nodes: DataFrame, similarity: int) -> DataFrame:
    """Candidates (a < b) of nodes that fit in memory, each compared exhaustively."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for _, node in grouped_runs(batches, "path"):
            keys = node.column("key").to_numpy()
            sig = _sketch(_signatures(node.column("sig").combine_chunks()))
            n = node.column("n").to_numpy()
            i, j = np.triu_indices(len(keys), 1)
            ok = _alike(sig[i], sig[j], n[i], n[j], similarity) & (keys[i] != keys[j])
            if ok.any():
                a, b = keys[i[ok]], keys[j[ok]]
                left.append(np.minimum(a, b))
                right.append(np.maximum(a, b))
            if len(left) > 4096:
                yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])
                left, right = [], []
        if left:
            yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    dealt = nodes.select("path", "key", "n", "sig").repartition(F.col("path")).sortWithinPartitions("path", "key")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _hub_pairs(rows: DataFrame, similarity: int) -> DataFrame:
    """Candidates of large nodes: (hub, key, sig, n, hub_sig, hub_n) rows whose sketches are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hub, key, n, hub_n = (batch.column(c).to_numpy() for c in (0, 1, 3, 5))
                ok = _alike(_sketch(_signatures(batch.column(2))), _sketch(_signatures(batch.column(4))), n, hub_n, similarity)
                a, b = hub[ok], key[ok]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return rows.where("hub <> key").select("hub", "key", "sig", "n", "hub_sig", "hub_n").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], similarity: int, shingle: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    A pair's texts meet in the group of ``a``; groups are cut into parts of about HUB_PART
    partners, each with a copy of a's text, and read one text at a time.
    """
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / HUB_PART)).alias("part"))
    wanted = dealt.select(F.col("b").alias("key"), "a", "part", F.lit(1).alias("side")).unionByName(
        dealt.select(F.col("a").alias("key"), "a", "part", F.lit(0).alias("side")).distinct()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            left, right = [], []
            for a, part, side, key, (name, mine) in zip(*(batch.column(c).to_pylist() for c in range(4)), _named_sets(batch.column(4), shingle)):
                if name != key:
                    continue  # another row under the same id
                if side == 0:
                    at, own = (a, part), mine
                elif at == (a, part):
                    both = int((own[np.minimum(np.searchsorted(own, mine), len(own) - 1)] == mine).sum())
                    if 100 * both >= similarity * (len(own) + len(mine) - both):
                        left.append(a)
                        right.append(key)
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
        released()

    rows = fetch(wanted).select("a", "part", "side", "key", "text")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "side").mapInArrow(run, "a bigint, b bigint")


def linked(items: DataFrame, fetch: Callable[[DataFrame], DataFrame], trees: int = TREES, similarity: int = SIMILARITY, shingle: int = 5, rows: int = ROWS) -> DataFrame:
    """(node, component) of every set that has a link.

    ``items``: one row per distinct set, (key long, n sizes, sig minwise hashes as binary).
    ``fetch``: adds the column ``text`` to a table with the column ``key``.
    """
    spark = items.sparkSession
    edges, labels = None, None
    level = roots(items, trees, rows)
    for depth in range(LEVELS):
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("members"), F.min("key").alias("hub")).where("members > 1")
        members = written(level.join(sizes, "path").join(items, "key").select("path", "key", "n", "sig", "members", "hub"), "node")
        small = _small_pairs(members.where(F.col("members") <= NODE_SIZE), similarity)
        large = members.where(F.col("members") > NODE_SIZE)
        hubs = items.select(F.col("key").alias("hub"), F.col("sig").alias("hub_sig"), F.col("n").alias("hub_n")).join(large.select("hub").distinct(), "hub")
        pairs = written_narrow(small.unionByName(_hub_pairs(large.join(hubs, "hub"), similarity)).distinct(), "pairs")
        todo = pairs if labels is None else written_narrow(_apart(pairs, labels), "candidates")
        if not todo.isEmpty():
            found = confirmed(todo, fetch, similarity, shingle)
            edges = written_narrow(found if edges is None else edges.unionByName(found).distinct(), "links")
            labels = components(edges)
            edges = labels.select(F.col("component").alias("a"), F.col("node").alias("b"))
        going = _unlinked(large.select("path", "key", "sig"), labels)
        going = written(going, "branching")
        if going.isEmpty():
            break
        if depth + 1 < LEVELS:
            level = children(going).distinct()
        else:
            found = _dense(going, labels, fetch, similarity, shingle)
            labels = components(written_narrow(found if edges is None else edges.unionByName(found).distinct(), "links"))
    if labels is None:
        return spark.createDataFrame([], "node bigint, component bigint")
    return labels


def _unlinked(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of nodes whose sets aren't all in one component yet."""
    if labels is None:
        known = nodes.withColumn("label", F.col("key"))
    else:
        known = nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("component", "key")).drop("component")
    mixed = known.groupBy("path").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("path")
    return known.join(mixed, "path")


def _dense(going: DataFrame, labels: DataFrame | None, fetch: Callable[[DataFrame], DataFrame], similarity: int, shingle: int) -> DataFrame:
    """Links in what stays dense: nodes of many sets that resemble each other and aren't linked.

    Nodes of all trees that share a set form one clump, so a pair is compared once. Each set
    outside the clump's largest known component is compared with every set of the clump, in
    parts of about HUB_PART such sets; a part's sets are indexed by shingle, and the clump is
    read past them. Full sets decide; links inside what a part knows to be linked are left out.
    """
    clumps = components(going.select(F.col("path").alias("a"), F.col("key").alias("b")))
    members = going.select("key", "label").distinct().join(clumps.withColumnRenamed("node", "key"), "key").select(F.col("component").alias("clump"), "key", "label")
    members = written_narrow(members, "clumps")
    shares = members.groupBy("clump", "label").agg(F.count(F.lit(1)).alias("m"))
    whole = shares.groupBy("clump").agg(F.max_by("label", "m").alias("largest"), (F.sum("m") - F.max("m")).alias("others"))
    others = members.join(whole, "clump").where("label <> largest").select("clump", "key", F.pmod(F.xxhash64("key"), F.ceil(F.col("others") / HUB_PART)).alias("part"))
    others = written_narrow(others, "parts")
    everyone = members.select("clump", "key").join(others.select("clump", "part").distinct(), "clump")
    wanted = others.select("key", "clump", "part", F.lit(0).alias("side")).unionByName(everyone.select("key", "clump", "part", F.lit(1).alias("side")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names, sets, index, parent = None, [], [], None, {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            left, right = [], []
            for clump, part, side, key, (name, mine) in zip(*(batch.column(c).to_pylist() for c in range(4)), _named_sets(batch.column(4), shingle)):
                if name != key:
                    continue
                if at != (clump, part):
                    at, names, sets, index, parent = (clump, part), [], [], None, {}
                if side == 0:
                    names.append(key)
                    sets.append(mine)
                    continue
                if index is None:
                    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
                    order = np.argsort(values, kind="stable")
                    index, sizes = (values[order], owner[order]), np.array([len(x) for x in sets])
                low, high = np.searchsorted(index[0], mine, "left"), np.searchsorted(index[0], mine, "right")
                spans = high - low
                hit = np.repeat(low - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
                both = np.bincount(index[1][hit], minlength=len(names))
                for i in np.flatnonzero(100 * both >= similarity * (len(mine) + sizes - both)):
                    one, two = root(key), root(names[i])
                    if one != two:
                        parent[one] = two
                        left.append(key)
                        right.append(names[i])
            yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    rows = fetch(wanted).select("clump", "part", "side", "key", "text")
    return rows.repartition("clump", "part").sortWithinPartitions("clump", "part", "side").mapInArrow(run, "a bigint, b bigint")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs that known links don't connect."""
    for side in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_label")), side, "left")
    return pairs.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")

"""Nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on at most ``SAMPLE`` vectors, those with the smallest hash of their id
(a documented bound), and has at most ``MAX_LEAVES`` leaves; every vector is then filed in
its leaf by Spark. Vectors of each length have a tree of their own, fitted on the sample's vectors of
that length; a length that the sample doesn't hold is one leaf. A query walks the tree through a priority queue: the node of largest
inner product between query and centre comes first, and leaves come out best first. How many
leaves are visited is calibrated: ``CALIBRATION`` queries are answered exactly against all
vectors, and visits are widened until the leaves of ``RECALL`` of their true neighbours are
among them; a length with fewer than ``CALIBRATED`` of these queries has all its leaves visited. A leaf's queries and vectors are cut into blocks; each block gives its nearest
``k``, a task merges what its blocks give, and a query's tasks are merged by rank.

Nearness is the largest inner product in double precision, ties by the smaller id.

Defined results: null, zero and not finite vectors take no part; rows of null id neither; vectors
of different lengths have no inner product and never meet; repeated ids count once; a query never
finds itself; fewer candidates than k give fewer rows; an empty table gives an empty table.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credlake.llm.caps import matrix, usable
from credlake.llm.common import grouped_runs, written

SAMPLE = 20_000
MAX_LEAVES = 512
VECTORS_PER_LEAF = 200
BRANCHES = 8
CALIBRATION = 200
CALIBRATED = 20
RECALL = 0.96
BLOCK = 4096
HELD_ROWS = 1_000_000
SEED = 3


@dataclass
class Tree:
    """Nodes by number; children[n] is empty for a leaf; leaf[n] numbers the leaves."""

    centre: np.ndarray
    children: list[list[int]]
    leaf: list[int]

    @property
    def leaves(self) -> int:
        return sum(n >= 0 for n in self.leaf)

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child at every node."""
        node = np.zeros(len(x), dtype=np.int64)
        open_ = np.arange(len(x))
        while len(open_):
            for n in np.unique(node[open_]):
                at = open_[node[open_] == n]
                kids = self.children[n]
                if kids:
                    c = self.centre[kids]
                    node[at] = np.array(kids)[(-2 * x[at] @ c.T + (c * c).sum(1)).argmin(1)]
            open_ = open_[[bool(self.children[n]) for n in node[open_]]]
        return np.array(self.leaf)[node]

    def order(self, q: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves that best-bin-first traversal comes to."""
        product = self.centre @ q
        queue, out = [(-product[0], 0)], []
        while queue and len(out) < most:
            _, n = heapq.heappop(queue)
            if self.leaf[n] >= 0:
                out.append(self.leaf[n])
            for child in self.children[n]:
                heapq.heappush(queue, (-product[child], child))
        return out


def _split(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means assignment of a few rounds."""
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (-2 * x @ centre.T + (centre * centre).sum(1)).argmin(1)
        for c in range(k):
            if (own == c).any():
                centre[c] = x[own == c].mean(0)
    return own


def fit(x: np.ndarray, leaves: int) -> Tree:
    """Split the largest open node until there are about ``leaves`` leaves."""
    rng = np.random.default_rng(SEED)
    centres, children, members = [x.mean(0)], [[]], {0: np.arange(len(x))}
    queue = [(-len(x), 0)]
    count = 1
    while queue and count < leaves:
        size, n = heapq.heappop(queue)
        k = min(BRANCHES, leaves - count + 1, -size)
        if k < 2:
            continue
        at = members.pop(n)
        own = _split(x[at], k, rng)
        used = np.unique(own)
        if len(used) < 2:
            continue
        for c in used:
            child = len(centres)
            centres.append(x[at[own == c]].mean(0))
            children.append([])
            children[n].append(child)
            members[child] = at[own == c]
            heapq.heappush(queue, (-int((own == c).sum()), child))
        count += len(used) - 1
    leaf, number = [], 0
    for n in range(len(centres)):
        leaf.append(-1 if children[n] else number)
        number += not children[n]
    return Tree(np.array(centres), children, leaf)


class Forest:
    """A tree for each vector length of the sample; leaves are numbered through, other lengths are leaf -length."""

    def __init__(self, trees: dict[int, Tree]):
        self.trees = trees
        self.first = dict(zip(trees, np.cumsum([0, *(t.leaves for t in trees.values())]).tolist()))

    def leaves(self, size: int) -> int:
        return self.trees[size].leaves if size in self.trees else 1

    def file(self, column: pa.Array) -> np.ndarray:
        """The leaf of each vector of a list column."""
        out = np.empty(len(column), dtype=np.int32)
        for size, at, x in of_lengths(column):
            out[at] = self.first[size] + self.trees[size].file(x) if size in self.trees else -size
        return out

    def order(self, q: np.ndarray, most: int) -> list[int]:
        """The first leaves that a query's traversal comes to."""
        size = len(q)
        return [self.first[size] + n for n in self.trees[size].order(q, most)] if size in self.trees else [-size]


def of_lengths(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, matrix) of the vectors of each length in a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        yield size, at, matrix(column.take(pa.array(at)))


def _best(products: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest, ties by id; with a margin for rounding."""
    if len(products) > k:
        least = np.partition(products, len(products) - k)[len(products) - k]
        at = np.flatnonzero(products >= least - 1e-9 * max(1.0, abs(least)))
    else:
        at = np.arange(len(products))
    return at


def _answer(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, product) of each query's k nearest among x; sums run in one order, so ties stay ties."""
    out_q, out_id, out_s = [], [], []
    for at in range(0, len(q), 256):
        rough = q[at : at + 256] @ x.T
        for r, row in enumerate(rough):
            own = q_ids[at + r]
            some = _best(np.where(ids == own, -np.inf, row), ids, k)
            some = some[ids[some] != own]
            exact = (x[some] * q[at + r]).sum(1)
            best = np.lexsort([ids[some], -exact])[:k]
            out_q.append(np.full(len(best), own))
            out_id.append(ids[some][best])
            out_s.append(exact[best])
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_s)


def _nearest(answers: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of several answers."""
    q, i, s = (np.concatenate(c) for c in zip(*answers))
    order = np.lexsort([i, -s, q])
    q, i, s = q[order], i[order], s[order]
    first = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[rank < k], i[rank < k], s[rank < k]


def _batch(answer: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    q, i, s = answer
    return pa.record_batch([pa.array(q.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(s)], ["query_id", "vec_id", "score"])


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` to each of ``queries``, both (vec_id, embedding)."""
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", "embedding")
    good = written(good.dropDuplicates(["vec_id"]), "vectors")
    asked = queries.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", "embedding").dropDuplicates(["vec_id"])
    asked = written(asked, "queries")
    total = good.count()
    if not total:
        return nothing
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column("embedding")
    leaves = min(MAX_LEAVES, total // VECTORS_PER_LEAF)
    forest = Forest({size: fit(x, max(1, leaves * len(x) // len(sample))) for size, _, x in of_lengths(sample)})
    shared = spark.sparkContext.broadcast(forest)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([*batch.columns, pa.array(shared.value.file(batch.column(1)))], ["vec_id", "embedding", "leaf"])

    kind = dict(good.dtypes)
    filed = written(good.mapInArrow(file, f"vec_id {kind['vec_id']}, embedding {kind['embedding']}, leaf int"), "filed")
    visits = _calibrated(filed, asked, shared, k, recall)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                leaves = [[]] * part.num_rows
                for size, rows, x in of_lengths(part.column(1)):
                    for r, q in zip(rows.tolist(), x):
                        leaves[r] = shared.value.order(q, visits.get(size, shared.value.leaves(size)))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(leaves, pa.list_(pa.int32()))], ["vec_id", "embedding", "leaves"])

    # Blocks: a leaf's vectors by hash into parts of about BLOCK; its queries go to each part, themselves in parts.
    crowd = filed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    visiting = asked.mapInArrow(walk, f"vec_id {kind['vec_id']}, embedding {kind['embedding']}, leaves array<int>").withColumn("leaf", F.explode("leaves")).drop("leaves")
    visiting = written(visiting, "visits")
    waiting = visiting.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("query_parts"))
    plan = written(crowd.join(waiting, "leaf"), "plan")  # a row a leaf, joined by its written size
    left = filed.join(plan, "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts")).withColumn("query_part", F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)))
    right = visiting.join(plan, "leaf").withColumn("query_part", F.pmod(F.xxhash64("vec_id"), "query_parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["vec_id", "embedding", F.xxhash64("leaf", F.col("part").cast("long"), F.col("query_part").cast("long")).alias("cell")]
    cells = left.select(*columns, F.lit(0).alias("side")).unionByName(right.select(*columns, F.lit(1).alias("side")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for _, cell in grouped_runs(batches, "cell"):
            side = cell.column("side").to_numpy()
            ids = cell.column("vec_id").to_numpy()
            if (side == 0).any() and (side == 1).any():
                v = matrix(cell.column("embedding"))
                held.append(_answer(v[side == 1], ids[side == 1], v[side == 0], ids[side == 0], k))
                rows += len(held[-1][0])
            if rows > HELD_ROWS:
                held = [_nearest(held, k)]
                rows = len(held[0][0])
                if rows > HELD_ROWS // 2:
                    yield _batch(held[0])
                    held, rows = [], 0
        if held:
            yield _batch(_nearest(held, k))

    found = cells.repartition(F.col("cell")).sortWithinPartitions("cell", "side", "vec_id").mapInArrow(compare, "query_id bigint, vec_id bigint, score double")
    return _merged(found, k).select("query_id", "rank", "vec_id", "score")


def _calibrated(filed: DataFrame, asked: DataFrame, shared, k: int, recall: float) -> dict[int, int]:
    """How many leaves to visit so that ``recall`` of the true neighbours of some queries are found, for each length with enough of them."""
    some = asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(CALIBRATION).toArrow()
    some_ids = some.column("vec_id").to_numpy()
    probes = {size: (x, some_ids[at]) for size, at, x in of_lengths(some.column("embedding")) if len(at) >= CALIBRATED}
    if not probes:
        return {}
    probe = filed.sparkSession.sparkContext.broadcast(probes)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, x in of_lengths(batch.column(1)):
                if size not in probe.value:
                    continue
                ids = batch.column(0).to_numpy()[at]
                leaf = dict(zip(ids.tolist(), batch.column(2).to_numpy()[at].tolist()))
                a, b, s = _answer(*probe.value[size], x, ids, k)
                yield pa.record_batch([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(s), pa.array([leaf[i] for i in b.tolist()], pa.int32())], ["query_id", "vec_id", "score", "leaf"])

    truth = _merged(filed.mapInArrow(exact, "query_id bigint, vec_id bigint, score double, leaf int"), k).select("query_id", "leaf").toArrow()
    found = list(zip(truth.column("query_id").to_pylist(), truth.column("leaf").to_pylist()))
    visits = {}
    for size, (q, q_ids) in probes.items():
        at = {i: {leaf: n for n, leaf in enumerate(shared.value.order(v, shared.value.leaves(size)))} for i, v in zip(q_ids.tolist(), q)}
        ranks = sorted(at[i][leaf] for i, leaf in found if i in at)
        if ranks:
            visits[size] = 1 + ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]
    return visits

"""Hard negatives by Fagin's threshold algorithm over per-dimension sorted lists.

Vectors become integer vectors (floor of 256 times each component) and are filed in blocks of
one length; a block holds its matrix and, for each dimension, its rows in ascending
order. An anchor reads a block's lists from the end that its sign prefers (a negative
component reads ascending, a zero one not at all). Each row met is scored at once by random
access to its whole vector, in integers. What the lists show next bounds every row not met
yet: reading stops once this threshold is strictly below what a window still needs, its k-th
score so far, or the window's lower end while it holds fewer than k. Strictly, since an equal score
of a smaller id would come first.

Positives are the ``n_positives`` highest scores among other rows of the anchor's label: a
window without ends over the blocks of that label. Negatives of a positive are the first ``k``
rows of other labels whose score lies between 30 and 90 percent of the positive's: a window
per positive over blocks of all labels, all windows of an anchor read together. Anchors are a
stated query set that is held against all blocks: packs of ``PACK`` anchors go to the blocks, not
vectors to anchors; a block that meets many packs is copied, a copy for each ``PACKS_A_TASK`` packs, and each
(block, pack) answers with at most k rows a window, which are then merged by rank.

Defined results: rows with a null id, label or vector, an empty vector, or a null or non-finite component take
no part; of rows that repeat an id the one of the smallest (label, vector) takes part; vectors
meet only vectors of their own length; ties go to the smaller id; a positive of score 0 or
less has the window that the inequality leaves (score 0 only, or nothing); fewer rows than
asked for give fewer; sums are exact, and one beyond 64 bits is cut to the largest or smallest
of them; other columns are not read; an empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credlake.llm.common import grouped_runs, with_group, written

N_POSITIVES = 5
K = 10
LOW, HIGH = 30, 90
BLOCK_BYTES = 2 << 20  # a block's vectors, four bytes a component
PACK = 128
PACKS_A_TASK = 64
FIRST_DEPTH = 16
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


# ---- one block, one anchor ----------------------------------------------------------------


@dataclass
class Span:
    """A window: scores from low to high (None: no end), of which the first ``k`` are wanted."""

    low: int | None
    high: int | None
    k: int

    def first(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Positions in ``at`` of the window's first rows, best first."""
        inside = np.ones(len(at), dtype=bool)
        if self.low is not None:
            inside &= scores >= max(self.low, _LEAST)
        if self.high is not None:
            inside &= scores <= min(self.high, _MOST)
        some = np.flatnonzero(inside)
        if len(some) > self.k:
            least = np.partition(scores[some], len(some) - self.k)[len(some) - self.k]
            some = some[scores[some] >= least]
        order = np.lexsort((ids[at[some]], ~scores[some]))
        return some[order[: self.k]]

    def enough(self, threshold: int, scores: np.ndarray) -> bool:
        """Whether no row of a score up to the threshold can still be among the first."""
        if self.low is not None and threshold < self.low:
            return True
        return len(scores) == self.k and threshold < int(scores[-1])


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


class Block:
    """Vectors of one length, and per dimension the order of their components."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.int32))
        self.largest = _largest(x)
        self.plain = x.astype(np.float64) if self.largest < 1 << 53 else None
        self.wide = None

    def scores(self, at: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows; those beyond 64 bits are cut to their ends."""
        bound = self.largest * _largest(anchor) * len(anchor)
        if bound < 1 << 53:
            return (self.plain[at] @ anchor.astype(np.float64)).astype(np.int64)
        if bound <= _MOST:
            return self.x[at] @ anchor
        if self.wide is None:
            self.wide = self.x.astype(object)
        exact = self.wide[at] @ anchor.astype(object)
        return np.array([min(max(int(v), _LEAST), _MOST) for v in exact], dtype=np.int64)

    def threshold(self, anchor: np.ndarray, down: np.ndarray, up: np.ndarray, depth: int) -> int:
        """The most a row can score that none of the lists has shown down to ``depth``."""
        n = len(self.ids)
        dims = np.concatenate([down, up])
        last = np.concatenate([self.order[down, n - depth], self.order[up, depth - 1]])
        total = sum(int(a) * int(c) for a, c in zip(anchor[dims], self.x[last, dims]))
        return min(max(total, _LEAST), _MOST)

    def read(self, anchor: np.ndarray, usable: np.ndarray, spans: list[Span]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """Per window the first rows and their scores, best first; and how many rows were scored."""
        n = len(self.ids)
        down, up = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met = np.zeros(n, dtype=bool)
        at, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        depth, end = 0, min(n, FIRST_DEPTH)
        while True:
            shown = np.zeros(n, dtype=bool)
            if end == n or not len(down) + len(up):
                shown[:], end = True, n
            else:
                shown[self.order[down, n - end : n - depth].ravel()] = True
                shown[self.order[up, depth:end].ravel()] = True
            fresh = np.flatnonzero(shown & ~met)
            met |= shown
            fresh = fresh[usable[fresh]]
            at, scores = np.concatenate([at, fresh]), np.concatenate([scores, self.scores(fresh, anchor)])
            first = [span.first(at, scores, self.ids) for span in spans]
            if met.all():
                break
            threshold = self.threshold(anchor, down, up, end)
            if all(span.enough(threshold, scores[f]) for f, span in zip(first, spans)):
                break
            depth, end = end, min(n, 2 * end)
        return [at[f] for f in first], [scores[f] for f in first], len(at)


def ends(positive: int, k: int = K, low: int = LOW, high: int = HIGH) -> Span:
    """low * positive <= 100 * score <= high * positive, in integers."""
    return Span(-((-low * positive) // 100), (high * positive) // 100, k)


# ---- tables ---------------------------------------------------------------------------------


def whole_numbers(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, size, vector): usable rows, one an id, as arrays of long."""
    rows = vectors.select("vec_id", label.cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0")
    rows = rows.where(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    numbers = F.transform("v", lambda c: F.floor(F.lit(256.0) * c))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", numbers.alias("vector"))).alias("r"))
    return one.select("vec_id", "r.label", F.size("r.vector").alias("size"), "r.vector")


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(-1, size)


def _held(rows: DataFrame, group: Column, other_labels: bool, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, vec_id, score): what each block gives for each window.

    ``rows``: (vec_id, label, size, vector, positives), where a row with positives (an array of (id, score))
    is an anchor. Anchors meet the blocks of their size and ``group``.
    """
    per_block = F.greatest(F.lit(64), F.floor(F.lit(BLOCK_BYTES) / (4 * F.col("size"))))
    known = with_group(
        rows.withColumn("group", group), ["size", "group"], F.col("vec_id"),
        n=(F.sum, F.lit(1).cast("long")), m=(F.sum, F.col("positives").isNotNull().cast("long")),
    ).where("m > 0")
    parts, packs = F.ceil(F.col("n") / per_block), F.ceil(F.col("m") / PACK)
    last_chunk = F.floor((packs - 1) / PACKS_A_TASK)
    name = F.concat_ws(":", "size", "group", "part", "chunk")
    hashed = F.xxhash64("vec_id")
    vectors = known.select(
        "vec_id", "label", "size", "vector", "group", F.pmod(hashed, parts).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), last_chunk)).alias("chunk")
    ).select(name.alias("cell"), F.lit(-1).cast("long").alias("pack"), "size", "vec_id", "label", "vector", F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives"))
    anchors = (
        known.where("positives is not null")
        .withColumn("pack", F.pmod(hashed, packs)).withColumn("chunk", F.floor(F.col("pack") / PACKS_A_TASK))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        .select(name.alias("cell"), "pack", "size", "vec_id", "label", "vector", "positives")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in grouped_runs(batches, "cell"):
            size = cell.column("size")[0].as_py()
            mine = cell.column("pack").to_numpy() < 0
            ids, labels, x = cell.column("vec_id").to_numpy(), cell.column("label").to_numpy(), _matrix(cell.column("vector"), size)
            if not mine.any():
                continue
            block = Block(ids[mine], labels[mine], x[mine])
            asked = np.flatnonzero(~mine)
            wanted = cell.column("positives").take(pa.array(asked)).to_pylist()
            out = [[] for _ in range(5)]
            for i, positives in zip(asked, wanted):
                usable = block.labels != labels[i] if other_labels else block.ids != ids[i]
                spans = [ends(p["score"], k, low, high) for p in positives] if other_labels else [Span(None, None, k)]
                if spans:
                    found, scores, _ = block.read(x[i], usable, spans)
                    for p, f, s in zip(positives if other_labels else [{"id": None, "score": None}], found, scores):
                        for column, values in zip(out, ([ids[i]] * len(f), [p["id"]] * len(f), [p["score"]] * len(f), block.ids[f], s)):
                            column.extend(values)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    dealt = vectors.unionByName(anchors).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell").sortWithinPartitions("cell", "pack")
    return dealt.mapInArrow(run, "anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint")


def _ranked(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def mined(vectors: DataFrame, anchor: Column, label: Column | None = None, n_positives: int = N_POSITIVES, k: int = K, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that meet ``anchor``."""
    rows = written(whole_numbers(vectors, F.col("label") if label is None else label), "whole-numbers")
    none = F.array().cast("array<struct<id:bigint,score:bigint>>")
    asked = rows.withColumn("positives", F.when(anchor, none))
    found = _ranked(_held(asked, F.col("label"), False, n_positives, low, high), ["anchor_id"], n_positives)
    positives = written(found.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "score")).alias("positives")), "positives")
    asked = rows.join(positives.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left")
    ranked = _ranked(_held(asked, F.lit(0), True, k, low, high), ["anchor_id", "positive_id"], k)
    return ranked.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )

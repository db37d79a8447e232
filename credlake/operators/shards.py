"""Linear models fitted over shards of rows, many at once.

Rows are dealt to shards by a hash of what they hold, and ordered by it inside, so shards don't
depend on how the table is partitioned; a shard is stored as one row of packed arrays, which a
task maps as a sparse matrix without touching its elements. A pass reads every shard once for all models that still ask for
something, sums what they asked for inside the task, then by model in Spark (of many shards, by
(model, bucket) before); one vector a model, at most ``max_features`` + 12 numbers, reaches the driver.
"""
from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.operators.common import materialize

ROWS_A_SHARD = 2048
BUCKETS = 32
# From so many shards on, vectors are summed by bucket before they are summed by model.
MANY_SHARDS = 512
# Rows without curvature from which on Hessian products leave them out.
NARROW_ROWS = 16 * ROWS_A_SHARD
_FIXED = 2.0**50


@dataclass(frozen=True)
class Config:
    """One model of a search: parameter, weights of the classes, and the fold left out (none: -1)."""

    C: float = 1.0
    class_weight: str | None = None
    fold: int = -1


@dataclass
class Shards:
    table: DataFrame  # shard and its rows, as dealt
    packed: DataFrame  # the same, as bytes, written once; what every pass reads
    size: int  # features
    counts: dict[tuple[int, int], int]  # rows by (fold, label)

    @property
    def many(self) -> bool:
        return sum(self.counts.values()) > MANY_SHARDS * ROWS_A_SHARD

    def rows(self, config: Config) -> tuple[int, int]:
        """Training rows of a config by label."""
        return tuple(sum(n for (fold, label), n in self.counts.items() if label == y and fold != config.fold) for y in (0, 1))

    def class_weights(self, config: Config) -> tuple[float, float]:
        """Weights from the config's own training rows: 1, or n / (2 * rows of the class)."""
        by_label = self.rows(config)
        if config.class_weight != "balanced":
            return (1.0, 1.0)
        present = sum(n > 0 for n in by_label)
        return tuple(sum(by_label) / (present * n) if n else 0.0 for n in by_label)


def sharded(train: DataFrame, size: int) -> Shards:
    """Pack rows (idx, val, label and perhaps fold); written once because every pass reads it.

    As bytes: taking nested arrays apart element by element cost a pass many times its arithmetic.
    A shard a file: a file is not split, and those of several shards left tasks of a pass uneven.
    """
    fold = F.coalesce(F.col("fold"), F.lit(0)) if "fold" in train.columns else F.lit(0)
    rows = train.select("idx", "val", F.col("label").cast("int").alias("label"), fold.cast("int").alias("fold"))
    rows = rows.withColumn("hash", F.xxhash64("idx", "val", "label", "fold"))
    counts = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}
    n_shards = max(1, -(-sum(counts.values()) // ROWS_A_SHARD))
    dealt = rows.groupBy(F.pmod("hash", F.lit(n_shards)).alias("shard")).agg(F.array_sort(F.collect_list(F.struct("hash", "label", "fold", "idx", "val"))).alias("rows"))
    return Shards(dealt, materialize(dealt.mapInArrow(_packed, _PACKED), "shards", maxRecordsPerFile=1), size, counts)


_PACKED = "shard long, label binary, fold binary, length binary, at binary, value binary"
_KINDS = {"label": np.int32, "fold": np.int32, "length": np.int32, "at": np.int32, "value": np.float64}


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each shard's rows as the bytes of one array each."""
    for batch in batches:
        for n, number in enumerate(batch.column(0).to_pylist()):
            rows = batch.column(1).slice(n, 1).flatten()
            idx, val = rows.field("idx"), rows.field("val")
            columns = {"label": rows.field("label"), "fold": rows.field("fold"), "length": idx.value_lengths(), "at": idx.flatten(), "value": val.flatten()}
            yield _bytes(number, {c: column.to_numpy(zero_copy_only=False) for c, column in columns.items()})


def _bytes(number: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row: the shard's number, and its arrays as bytes."""
    parts = [pa.array([columns[c].astype(kind).tobytes()], pa.binary()) for c, kind in _KINDS.items()]
    return pa.record_batch([pa.array([number], pa.int64()), *parts], ["shard", *_KINDS])


class Shard:
    """Sparse rows of one shard."""

    def __init__(self, number: int, label: np.ndarray, fold: np.ndarray, length: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.number, self.fold, self.at, self.value = number, fold, at, value
        self.y = np.where(label == 1, 1.0, -1.0)
        self.ends = np.concatenate([[0], np.cumsum(length)])
        self.row = np.repeat(np.arange(len(self.y)), length)

    def times(self, w: np.ndarray) -> np.ndarray:
        """Products of the rows with weights whose last entry is the constant's."""
        return np.bincount(self.row, self.value * w[self.at], len(self.y)) + w[-1]

    def back(self, c: np.ndarray, size: int) -> np.ndarray:
        """Sum of the rows times ``c``, the constant last."""
        return np.append(np.bincount(self.at, self.value * c[self.row], size), c.sum())

    def only(self, kept: np.ndarray) -> pa.RecordBatch:
        """The packed shard with the rows marked in ``kept``, in their order."""
        cells = kept[self.row]
        columns = {"label": self.y[kept] > 0, "fold": self.fold[kept], "length": np.diff(self.ends)[kept], "at": self.at[cells], "value": self.value[cells]}
        return _bytes(self.number, columns)


def _shards_of(batch: pa.RecordBatch) -> Iterator[Shard]:
    for n, number in enumerate(batch.column(0).to_pylist()):
        yield Shard(number, *[np.frombuffer(batch.column(c)[n].as_buffer(), kind) for c, kind in enumerate(_KINDS.values(), 1)])


def _pass(shards: Shards, asked: dict[int, tuple], answer: Callable[[Shard, int, tuple], np.ndarray]) -> dict[int, np.ndarray]:
    """Per model the sum over shards of ``answer(shard, model, request)``."""
    shared = shards.packed.sparkSession.sparkContext.broadcast(asked)
    many = shards.many

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, first = {}, None
        for batch in batches:
            for shard in _shards_of(batch):
                first = shard.number if first is None else first
                for model, request in shared.value.items():
                    got = answer(shard, model, request)
                    sums[model] = sums[model] + got if model in sums else got
        if sums:
            yield _vectors(list(sums), [first % BUCKETS if many else first] * len(sums), list(sums.values()))

    parts = shards.packed.mapInArrow(run, _VECTORS)
    if many:
        parts = parts.repartition("model", "bucket").sortWithinPartitions("model", "bucket").mapInArrow(_summed(["model", "bucket"]), _VECTORS)
    parts = parts.repartition(len(asked), "model").sortWithinPartitions("model", "bucket").mapInArrow(_summed(["model"]), _VECTORS)
    found = parts.toArrow()
    shared.unpersist()
    return {m: _numbers(k, v) for m, k, v in zip(found["model"].to_pylist(), found["kind"].to_pylist(), found["vector"].to_pylist())}


_VECTORS = "model int, bucket int, kind string, vector binary"


def _numbers(kind: str, vector: bytes) -> np.ndarray:
    return np.frombuffer(vector, dtype=kind)


def _vectors(models: list[int], buckets: list[int], vectors: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(models, pa.int32()), pa.array(buckets, pa.int32()), pa.array([v.dtype.str for v in vectors]), pa.array([v.tobytes() for v in vectors], pa.binary())]
    return pa.record_batch(columns, ["model", "bucket", "kind", "vector"])


def _summed(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One vector per value of ``keys``; the bucket is 0 once it is no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for model, bucket, kind, vector in zip(*(c.to_pylist() for c in batch.columns)):
                at, value = (model, bucket if "bucket" in keys else 0), _numbers(kind, vector)
                sums[at] = sums[at] + value if at in sums else value
        if sums:
            yield _vectors([m for m, _ in sums], [b for _, b in sums], list(sums.values()))

    return run


# ---- smooth losses: Newton steps with conjugate gradients ------------------------------------


def _loss(shard: Shard, loss: str, config: Config, weights: tuple[float, float], request: tuple, size: int) -> np.ndarray:
    """Gradient, loss and rows with curvature at w, or the Hessian at w times v, of the shard's training rows."""
    kind, w, v = request
    value, slope, curve = _parts(shard, loss, config, weights, w)
    if kind == "hessian":
        return shard.back(curve * shard.times(v), size)
    return np.append(shard.back(slope * shard.y, size), [value.sum(), np.count_nonzero(curve)])


def _parts(shard: Shard, loss: str, config: Config, weights: tuple[float, float], w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each row at w, its slope and its curve by the margin."""
    s = np.where(shard.y > 0, weights[1], weights[0]) * config.C * (shard.fold != config.fold)
    margin = shard.y * shard.times(w)
    if loss == "squared_hinge":
        miss = np.maximum(0.0, 1.0 - margin)
        return s * miss**2, -2.0 * s * miss, 2.0 * s * (miss > 0)
    p = 1.0 / (1.0 + np.exp(np.clip(margin, -500, 500)))
    return s * np.logaddexp(0.0, -margin), -s * p, s * p * (1.0 - p)


def _curved(shards: Shards, loss: str, config: Config, weights: tuple[float, float], w: np.ndarray) -> Shards:
    """The shards without the rows that have no curvature at w, kept for the Hessian products there.

    Such rows add nothing to a product, so the sums are the same. Lost blocks come again from the written table.
    """
    shared = shards.packed.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in _shards_of(batch):
                kept = _parts(shard, loss, config, weights, shared.value)[2] != 0
                if kept.any():
                    yield shard.only(kept)

    return replace(shards, packed=shards.packed.mapInArrow(run, _PACKED).persist(StorageLevel.MEMORY_AND_DISK))


def newton(size: int, penalty: np.ndarray, max_iter: int, tol: float) -> Generator[tuple, np.ndarray, np.ndarray]:
    """Minimise loss + penalty * w**2 / 2. Yields what it asks of the rows, returns the weights
    once no component of the gradient is above ``tol``."""

    def whole(at: np.ndarray, got: np.ndarray) -> tuple[float, np.ndarray]:
        return got[-2] + 0.5 * float(penalty @ at**2), got[:-2] + penalty * at

    w = np.zeros(size + 1)
    value, gradient = whole(w, (yield ("value", w, None)))
    for _ in range(max_iter):
        length = float(np.linalg.norm(gradient))
        if np.abs(gradient).max() <= tol:
            break
        step, rest = np.zeros_like(w), -gradient
        direction, squared = rest, float(rest @ rest)
        for _ in range(200):
            curved = (yield ("hessian", w, direction)) + penalty * direction
            bend = float(direction @ curved)
            if bend <= 0:
                break
            step = step + squared / bend * direction
            rest = rest - squared / bend * curved
            now = float(rest @ rest)
            if now**0.5 <= min(0.1, length**0.5) * length:
                break
            direction, squared = rest + now / squared * direction, now
        share = 1.0
        for _ in range(40):
            found = whole(w + share * step, (yield ("value", w + share * step, None)))
            # sums over many rows are equal within their rounding near the minimum
            if found[0] <= value + 1e-4 * share * float(gradient @ step) + 1e-12 * abs(value) or share * np.abs(step).max() < 1e-12:
                break
            share /= 2
        w = w + share * step
        value, gradient = found
    return w


def fit_smooth(shards: Shards, loss: str, configs: list[Config], max_iter: int = 200, tol: float = 1e-5) -> list[np.ndarray]:
    """Weights, the constant's last, of every config. All models move in step: a pass serves
    each one's next request, so the number of jobs is that of the slowest model, not of the grid.
    The Hessian products of a single model read only the rows with curvature, if those are less than half.

    ``squared_hinge`` treats the constant as a feature that is always 1 and penalises it; ``logistic`` doesn't penalise it.
    """
    size = shards.size
    penalty = np.append(np.ones(size), 1.0 if loss == "squared_hinge" else 0.0)
    weights = [shards.class_weights(c) for c in configs]
    models = [newton(size, penalty, max_iter, tol) for _ in configs]
    asked, done = {m: next(model) for m, model in enumerate(models)}, {}
    curved, at, narrow = {}, None, None  # rows with curvature by model; the last weights and the rows with curvature there
    while asked:
        read, one = shards, next(iter(asked)) if len(asked) == 1 else None
        if one is not None and asked[one][0] == "hessian":
            if at is not asked[one][1]:
                if narrow:
                    narrow.packed.unpersist()
                at, narrow, n_rows = asked[one][1], None, sum(shards.rows(configs[one]))
                if curved[one] <= min(n_rows / 2, n_rows - NARROW_ROWS):
                    narrow = _curved(shards, loss, configs[one], weights[one], at)
            read = narrow or shards
        got = _pass(read, asked, lambda shard, m, request: _loss(shard, loss, configs[m], weights[m], request, size))
        following = {}
        for m in asked:
            answer = got.get(m, np.zeros(size + (3 if asked[m][0] == "value" else 1)))
            if asked[m][0] == "value":
                curved[m] = answer[-1]
            try:
                following[m] = models[m].send(answer)
            except StopIteration as stop:
                done[m] = stop.value
        asked = following
    if narrow:
        narrow.packed.unpersist()
    return [done[m] for m in range(len(configs))]


# ---- passive-aggressive updates --------------------------------------------------------------


def _epoch(shard: Shard, w: np.ndarray, config: Config, n_rows: int, order: list[int], size: int) -> np.ndarray:
    """A shard's share of the mixed weights (constant, then loss, last) in whole multiples of 2**-50."""
    w, loss, rows = w.copy(), 0.0, 0
    norm = np.bincount(shard.row, shard.value**2, len(shard.y)) + 1.0
    for r in np.random.default_rng(order).permutation(len(shard.y)):
        if shard.fold[r] == config.fold:
            continue
        a, b = shard.ends[r], shard.ends[r + 1]
        at, value, y = shard.at[a:b], shard.value[a:b], shard.y[r]
        miss = max(0.0, 1.0 - y * (float(w[at] @ value) + w[-1]))
        rows += 1
        if miss:
            step = y * min(config.C, miss / norm[r])
            w[at] += step * value
            w[-1] += step
            loss += miss
    return np.rint(np.append(w * rows, loss) / n_rows * _FIXED).astype(np.int64)


def fit_passive_aggressive(shards: Shards, configs: list[Config], max_iter: int, tol: float, patience: int, seed: int) -> list[np.ndarray]:
    """Weights, the constant's last, of PA-I models by parameter mixing, all configs in each pass.

    An epoch updates a copy of the weights per shard, rows in an order drawn from (seed, epoch,
    shard), and mixes copies by their rows. Shares are whole numbers, so sums don't depend on
    their order and weights are the same however the table is partitioned. A model stops when its mean loss has
    not improved by ``tol`` for ``patience`` epochs, or at ``max_iter``.
    """
    size = shards.size
    weights = [np.zeros(size + 1) for _ in configs]
    n_rows = [sum(shards.rows(c)) for c in configs]
    best, stale = [np.inf] * len(configs), [0] * len(configs)
    for epoch in range(max_iter):
        asked = {m: (weights[m],) for m in range(len(configs)) if stale[m] < patience and n_rows[m]}
        if not asked:
            break
        got = _pass(shards, asked, lambda shard, m, request, epoch=epoch: _epoch(shard, request[0], configs[m], n_rows[m], [seed, epoch, shard.number], size))
        for m, total in got.items():
            mixed = total / _FIXED
            weights[m], loss = mixed[:-1], mixed[-1]
            stale[m] = 0 if loss <= best[m] - tol else stale[m] + 1
            best[m] = min(best[m], loss)
    return weights

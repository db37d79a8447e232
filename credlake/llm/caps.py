"""Near-duplicate embeddings by spherical-cap filters from random product codes.

A filter direction is one codeword out of each of ``BLOCKS`` random codebooks of unit
vectors, over blocks of the randomly rotated coordinates. Every vector takes the caps of the
directions nearest to it, equally many for all; list decoding finds them without going through all
directions: of two sorted halves, the best sums lie among pairs of small ranks. The codebooks
grow with the rows of the largest label (``TAKEN``), so that vectors that don't resemble each other
rarely meet in a filter, however many they are. Vectors of one label that share a filter are compared in double
precision; a pair counts in the first filter that both share. In 64 dimensions a pair at 0.93
shares a filter with a probability of 0.994, 0.991 and 0.992 for the three codebooks (measured on random pairs),
one at 0.95 with 0.998 and more.

A filter's vectors are cut into parts of about ``PART`` and parts are compared two by two, so
no task holds more than two parts, however many vectors resemble each other. Links are
counted where they are found; only counts and the edges of a spanning forest of each
comparison leave the task.

Defined results: null, zero and not finite vectors and rows of null label or id have no links and
are their own component; only vectors of one length are linked, each length with filters of its own; equal vectors are
linked; repeated ids count as one vector; an empty table gives an empty table.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import components, whole_runs, written

COSINE = 0.93
BLOCKS = 4
#: Codewords of a codebook, and how many filters a vector takes.
TAKEN = {64: 64, 128: 128, 256: 192}
PART = 1024
#: Cells of at most so many rows are compared together with others, about ``AT_ONCE`` rows at a time.
SMALL, AT_ONCE = 64, 8192
SEED = 5


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero, and of finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def integers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of equal lengths, as whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def codewords(rows: int) -> int:
    """Codewords for labels of up to ``rows`` rows: of a vector's filters at most a quarter hold a vector by chance."""
    return next((c for c, taken in TAKEN.items() if 4 * rows * taken <= c**BLOCKS), max(TAKEN))


class Filters:
    """Random rotation and codebooks for vectors of one length; blocks have eight coordinates at least, if there are."""

    def __init__(self, size: int, codewords: int = min(TAKEN), seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.normal(size=(size, size)))[0]
        self.blocks = np.array_split(np.arange(size), min(BLOCKS, max(1, size // 8)))
        self.codewords = codewords
        self.taken = min(TAKEN[codewords], codewords ** len(self.blocks) // 4)
        self.books = []
        for b in self.blocks:
            book = rng.normal(size=(codewords, len(b)))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * np.sqrt(len(b) / size))

    def _half(self, unit: np.ndarray, which: range) -> tuple[np.ndarray, np.ndarray]:
        """The best combinations of the codewords of some blocks and their inner products, best first."""
        total = np.zeros((len(unit), 1))
        for k in which:
            own = unit[:, self.blocks[k]] @ self.books[k].T
            total = (total[:, :, None] + own[:, None, :]).reshape(len(unit), -1)
        most = min(self.taken, total.shape[1])
        at = np.argpartition(-total, most - 1, axis=1)[:, :most]
        value = np.take_along_axis(total, at, 1)
        order = np.argsort(-value, axis=1)
        return np.take_along_axis(at, order, 1), np.take_along_axis(value, order, 1)

    def passed(self, vectors: np.ndarray) -> np.ndarray:
        """The ``taken`` best filters of each vector in ascending order, by list decoding."""
        middle = (len(self.blocks) + 1) // 2
        width = self.codewords ** (len(self.blocks) - middle)
        out = np.empty((len(vectors), self.taken), np.int64)
        step = max(1, (1 << 21) // self.codewords**middle)
        for k in range(0, len(vectors), step):
            some = vectors[k : k + step]
            unit = some / np.linalg.norm(some, axis=1, keepdims=True) @ self.rotation
            (ia, sa), (ib, sb) = self._half(unit, range(middle)), self._half(unit, range(middle, len(self.blocks)))
            # a sum of ranks (i, j) has i * j - 1 sums before it
            i, j = np.nonzero(np.arange(1, ia.shape[1] + 1)[:, None] * np.arange(1, ib.shape[1] + 1) <= self.taken)
            best = np.argpartition(-(sa[:, i] + sb[:, j]), self.taken - 1, axis=1)[:, : self.taken]
            names = np.take_along_axis(ia[:, i], best, 1) * width + np.take_along_axis(ib[:, j], best, 1)
            out[k : k + step] = np.sort(names, axis=1)
        return out


def _similar(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of unit vectors with a cosine of at least ``cosine``."""
    i, j = np.nonzero(x @ y.T >= cosine - 1e-9)
    exact = _reach(x, y, i, j, cosine)
    return i[exact], j[exact]


def _reach(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Which index pairs have a cosine of at least ``cosine``."""
    return np.concatenate([(x[i[k : k + 65536]] * y[j[k : k + 65536]]).sum(1) >= cosine for k in range(0, len(i), 65536)] or [np.zeros(0, bool)])


def _pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs (i < j) inside each of some runs of rows."""
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(size, 1)
        at = starts[sizes == size][:, None]
        one.append((at + i).ravel())
        two.append((at + j).ravel())
    return np.concatenate(one), np.concatenate(two)


def _first_of(i: np.ndarray, j: np.ndarray, filters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose first common filter is the one ``at`` that they meet in."""
    keep = [np.zeros(0, bool)]
    for k in range(0, len(i), 16384):
        both = np.sort(np.concatenate([filters[i[k : k + 16384]], filters[j[k : k + 16384]]], axis=1), axis=1)
        keep.append(~((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < at[k : k + 16384, None])).any(1))
    first = np.concatenate(keep)
    return i[first], j[first]


def _forest(i: np.ndarray, j: np.ndarray, rows: int) -> list[tuple[int, int]]:
    """Pairs out of (i, j) that connect the same rows without a circle."""
    parent = list(range(rows))
    edges = []
    for a, b in zip(i.tolist(), j.tolist()):
        p, q = a, b
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        while parent[q] != q:
            parent[q] = q = parent[parent[q]]
        if p != q:
            parent[p] = q
            edges.append((a, b))
    return edges


def _first_here(i: np.ndarray, j: np.ndarray, fx: np.ndarray, fy: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose first common filter is ``at``."""
    names = np.unique(np.concatenate([fx, fy]))
    names = names[names < at]
    if not len(names):
        return i, j
    ex, ey = np.zeros((len(fx), len(names)), np.float32), np.zeros((len(fy), len(names)), np.float32)
    for table, lists in ((ex, fx), (ey, fy)):
        row, place = np.nonzero(lists < at)
        table[row, np.searchsorted(names, lists[row, place])] = 1
    earlier = (ex @ ey.T)[i, j] > 0
    return i[~earlier], j[~earlier]


def links(vectors: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(vec_id, n_links) and spanning edges (a, b) of (vec_id, embedding, label)."""
    good = vectors.where(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "embedding", "label")
    largest = good.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows")).first()[0] or 0
    words = codewords(largest)
    good = good.dropDuplicates(["vec_id"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: dict[int, Filters] = {}
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            for size in np.unique(sizes).tolist():
                if size not in filters:
                    filters[size] = Filters(size, words)
                alike = batch.take(pa.array(np.flatnonzero(sizes == size)))
                for at in range(0, alike.num_rows, 512):
                    part = alike.slice(at, 512)
                    taken = filters[size].passed(matrix(part.column(1)))
                    lists = pa.ListArray.from_arrays(np.arange(0, taken.size + 1, taken.shape[1], dtype=np.int32), taken.ravel())
                    yield pa.record_batch([*part.columns, pa.array(np.full(part.num_rows, size), pa.int32()), lists], ["vec_id", "embedding", "label", "size", "filters"])

    kind = dict(good.dtypes)
    coded = written(good.mapInArrow(decode, f"vec_id {kind['vec_id']}, embedding {kind['embedding']}, label {kind['label']}, size int, filters array<bigint>"), "caps")
    keyed = coded.select("vec_id", "label", "size", F.explode("filters").alias("filter"))
    crowd = keyed.groupBy("label", "size", "filter").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("parts", F.ceil(F.col("m") / PART).cast("int"))
    met = keyed.join(crowd, ["label", "size", "filter"]).groupBy("vec_id").agg(F.collect_list(F.struct("filter", "parts")).alias("met"))
    inside = coded.join(met, "vec_id").select("vec_id", "embedding", "filters", "label", "size", F.inline("met"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = inside.withColumn("part", part).withColumn("other", F.explode(other)).select(
        "vec_id", "embedding", "filters", "filter", F.xxhash64("label", "size", "filter", F.least("part", "other"), F.greatest("part", "other")).alias("cell"),
        F.when(F.col("part") <= F.col("other"), 0).otherwise(1).alias("side"), (F.col("part") == F.col("other")).alias("own"),
    )

    def found_in(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        count = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        edges = np.array(_forest(i, j, len(ids))).reshape(-1, 2)
        some = np.flatnonzero(count)
        ends = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(ids[edges[:, 1]].astype(np.int64))])
        return pa.record_batch(
            [pa.array(np.concatenate([ids[some], ids[edges[:, 0]]]).astype(np.int64)), pa.array(np.concatenate([count[some], np.full(len(edges), -1)]).astype(np.int64)), ends],
            ["vec_id", "n", "b"],
        )

    def crowded(cell: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Linked rows of one large cell."""
        raw, lists = matrix(cell.column("embedding")), integers(cell.column("filters"))
        x = raw / np.sqrt((raw * raw).sum(1))[:, None]
        side = cell.column("side").to_numpy()
        own = cell.column("own")[0].as_py()
        one = np.arange(len(side)) if own else np.flatnonzero(side == 0)
        two = one if own else np.flatnonzero(side == 1)
        i, j = _similar(x[one], x[two], cosine)
        i, j = one[i], two[j]
        if own:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return i, j
        si, ii = np.unique(i, return_inverse=True)
        sj, jj = np.unique(j, return_inverse=True)
        ii, jj = _first_here(ii, jj, lists[si], lists[sj], cell.column("filter")[0].as_py())
        return si[ii], sj[jj]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cells in whole_runs(batches, "cell", AT_ONCE):
            key = cells.column("cell").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            small = (sizes <= SMALL) & cells.column("own").to_numpy()[starts]
            for start, rows in zip(starts[~small].tolist(), sizes[~small].tolist()):
                cell = cells.slice(start, rows)
                i, j = crowded(cell)
                if len(i):
                    yield found_in(cell.column("vec_id").to_numpy(), i, j)
            lengths = pc.list_value_length(cells.column("embedding")).to_numpy()
            for length in np.unique(lengths[starts[small]]).tolist():
                mine = np.repeat(small & (lengths[starts] == length), sizes)
                few = cells.filter(pa.array(mine)) if not mine.all() else cells
                own = sizes[small & (lengths[starts] == length)]
                raw, lists = matrix(few.column("embedding")), integers(few.column("filters"))
                x = raw / np.sqrt((raw * raw).sum(1))[:, None]
                i, j = _pairs_within(np.cumsum(own) - own, own)
                near = _reach(x, x, i, j, cosine)
                i, j = i[near], j[near]
                i, j = _first_of(i, j, lists, few.column("filter").to_numpy()[i])
                if len(i):
                    yield found_in(few.column("vec_id").to_numpy(), i, j)

    found = written(
        dealt.repartition(F.col("cell")).sortWithinPartitions("cell", "side", "vec_id").mapInArrow(compare, "vec_id bigint, n bigint, b bigint"), "cap-links"
    )
    counts = found.where("n >= 0").groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    return counts, found.where("n < 0").select(F.col("vec_id").alias("a"), "b")


def groups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    counts, edges = links(vectors, cosine)
    labels = components(edges).withColumnsRenamed({"node": "vec_id", "component": "component_id"})
    component = F.coalesce("component_id", "vec_id")
    return (
        vectors.select("vec_id").join(counts, "vec_id", "left").join(labels, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
    )

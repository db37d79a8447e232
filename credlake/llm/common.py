"""What the operators of this subpackage share: shared storage, hashing of words, components."""
from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.operators.common import checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder all executors share; without ``spark.checkpoint.dir`` an error."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the plan restarts there, and
    a lost executor costs no more than its running tasks. The write's shuffle files, which
    nothing reads again, go when it ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def written_narrow(df: DataFrame, name: str) -> DataFrame:
    """``written`` for rows of a few numbers: as many files as the cluster fills tasks four
    times over, since a file per shuffle partition costs more than its rows."""
    return written(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism), name)


def dropped(df: DataFrame) -> None:
    """Free a written table that no later step reads: an empty one takes its place."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


HELD_ROWS = 512


def released() -> None:
    """Give freed memory back to the system: a worker lives on for the next stage's tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def free_name(taken: set[str], name: str) -> str:
    """A column name that none of ``taken`` (lower case) has."""
    while name in taken:
        name += "_"
    return name


def kept_rows(df: DataFrame, keep: Callable[[pa.Array, np.ndarray], np.ndarray], column: str, usable: Column | None = None) -> DataFrame:
    """The rows of ``df`` for which ``keep`` says so, in one pass and without a join.

    ``keep`` gets a column of the row and a truth value a row (``usable``, by default true), and returns a truth
    value a row. A text travels once, with its row, and no more than ``HELD_ROWS`` rows are judged at a time.
    """
    name = free_name({c.lower() for c in df.columns}, "usable")
    at = df.columns.index(column)
    wide = df.withColumn(name, F.lit(True) if usable is None else usable)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            rows = pa.RecordBatch.from_arrays(batch.columns[:last], schema=pa.schema(list(batch.schema)[:last]))
            for start in range(0, batch.num_rows, HELD_ROWS):
                some = rows.slice(start, HELD_ROWS)
                yield some.filter(pa.array(keep(some.column(at), batch.column(last).slice(start, HELD_ROWS).to_numpy(zero_copy_only=False).astype(bool)), pa.bool_()))
        released()

    return wide.mapInArrow(run, df.schema)


def with_group(df: DataFrame, keys: list[str], spread: Column, **aggregates: tuple[Callable, Column]) -> DataFrame:
    """Every row of ``df`` with its group's aggregates, each given as (function, column).

    The functions are their own merge (min, max, sum, bit_xor). Rows of a group are dealt by
    ``spread`` into at most as many parts as there are shuffle partitions; parts are aggregated
    before they meet, and get the group's values back one row a part, so that no group, however
    large, is one task's. Keys aren't null.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(spread), F.lit(parts)).cast("int"))
    some = dealt.groupBy(*keys, "__part").agg(*[fn(column).alias(name) for name, (fn, column) in aggregates.items()])
    whole = some.groupBy(*keys).agg(*[fn(F.col(name)).alias(name) for name, (fn, _) in aggregates.items()])
    each = some.select(*keys, "__part").join(whole, keys)
    return dealt.join(each, [*keys, "__part"]).drop("__part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc32_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n (null stays null)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.Table | pa.RecordBatch | None]) -> DataFrame:
    """mapInArrow with a function of one non-empty batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    if isinstance(out, pa.Table):
                        yield from out.to_batches()
                    else:
                        yield out

    return df.mapInArrow(run, schema)


def grouped_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.Table]]:
    """Runs of equal keys of batches that are sorted by ``key``, one run in memory at a time."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        keys = part.column(key).to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != held_key:
                yield held_key, pa.concat_tables(held)
                held = []
            held_key = keys[a]
            held.append(part.slice(a, b - a))
    if held:
        yield held_key, pa.concat_tables(held)
    held = []
    released()


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Batches that are sorted by ``key`` as tables of whole runs of equal keys, of about ``rows`` rows or one run at least."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < rows:
            continue
        table = pa.concat_tables(held)
        keys = table.column(key).to_numpy()
        others = np.flatnonzero(keys != keys[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
    if held:
        yield pa.concat_tables(held)
    held = []
    released()


# --- 64-bit hashes of words and shingles -------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_SOLID = np.ones(256, dtype=bool)
_SOLID[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_CODE = np.arange(1, 257, dtype=np.uint64)
_CODE[65:91] += np.uint64(32)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    x = x.astype(np.uint64, copy=True)
    high = x >> np.uint64(30)
    x ^= high
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=high)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=high)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash per word of ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased."""
    return placed_words(text)[0]


def placed_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word.

    One polynomial prefix sum over the bytes serves all words; each word's part of it is
    shifted back to position 0, so equal words hash alike anywhere.
    """
    raw = np.frombuffer(text, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = np.zeros(len(raw) + 2, dtype=bool)
    np.take(_SOLID, raw, out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _powers(len(raw) + 1)
    terms = _CODE[raw]
    terms *= up[: len(raw)]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(terms, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def text_parts(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts of about ``most`` bytes together, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(texts):
        yield start, len(texts)


def shingles_of(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all runs of ``size`` words; with fewer words, the whole run as one."""
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return mix64(np.array([np.sum(words * _SHINGLE[:n], dtype=np.uint64) ^ np.uint64(n)], dtype=np.uint64))
    total = words[: n - size + 1] * _SHINGLE[0]
    for i in range(1, size):
        total = total + words[i : n - size + 1 + i] * _SHINGLE[i % 5]
    return mix64(total)


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty for null or no words."""
    if not text:
        return np.empty(0, np.uint64)
    return np.unique(shingles_of(word_hashes(text), size))


def distinct_within(groups: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, 64-bit value) in ascending order; groups are numbers from 0.

    One sort of a word with the group and the value's upper bits; where that leaves an order open, a sort of both.
    """
    near = groups.astype(np.uint64) << np.uint64(40) | values >> np.uint64(24)
    order = np.argsort(near)
    g, v, near = groups[order], values[order], near[order]
    if len(g) and (int(groups.max()) >> 24 or ((near[1:] == near[:-1]) & (v[1:] != v[:-1])).any()):
        order = np.lexsort((values, groups))
        g, v = groups[order], values[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (g[1:] != g[:-1])
    return g[new], v[new]


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[list[np.ndarray]]:
    """``shingle_set`` of every text, for parts of the texts that are hashed together."""
    raw = pc.fill_null(pc.cast(texts, pa.binary()), b"")
    for a, b in text_parts(raw):
        some = raw.slice(a, b - a).to_pylist()
        words, starts = placed_words(b"\n".join(some))
        lengths = np.array([len(t) for t in some]) + 1
        owner = np.searchsorted(np.cumsum(lengths) - lengths, starts, "right") - 1
        counts = np.bincount(owner, minlength=len(some))
        first = np.cumsum(counts) - counts
        short = np.flatnonzero((counts > 0) & (counts < size))
        values, of = [np.array([shingles_of(words[first[k] : first[k] + counts[k]], size)[0] for k in short], np.uint64)], [short]
        if len(words) >= size:
            whole = np.flatnonzero(owner[size - 1 :] == owner[: len(owner) - size + 1])
            values.append(shingles_of(words, size)[whole])
            of.append(owner[whole])
        value, of_text = np.concatenate(values), np.concatenate(of)
        of_text, value = distinct_within(of_text, value)
        yield np.split(value, np.cumsum(np.bincount(of_text, minlength=len(some)))[:-1])


def minwise(values: np.ndarray, offsets: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Minwise hashes per set: ``values[offsets[i]:offsets[i+1]]`` is set i, none empty."""
    out = np.empty((len(offsets) - 1, len(seeds)), dtype=np.uint32)
    starts = offsets[:-1]
    for j, seed in enumerate(seeds):
        out[:, j] = np.minimum.reduceat(((values ^ (seed >> np.uint64(7))) * seed) >> np.uint64(32), starts).astype(np.uint32)
    return out


def seeds(n: int, salt: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2654435761) + np.uint64(salt)) | np.uint64(1)


# --- connected components ----------------------------------------------------------------

#: More rounds than any graph needs that fits a cluster; an unfinished table is never returned.
ROUNDS = 64

def _stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: then each v is its component's smallest node."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into"))
    )
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not seen.agg(F.coalesce(F.max((F.col("out") + F.col("into") > 1) & (F.col("out") > 0)), F.lit(False))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components") -> DataFrame:
    """(node, component): smallest node reachable, for every node that has an edge.

    Alternating large-star and small-star rounds; each round's edges are written to the
    shared folder. The number of rounds grows with the logarithm of a component's width.
    """
    spark = edges.sparkSession
    ids = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    current = written_narrow(ids, name)
    for _ in range(ROUNDS):
        if _stars(current):
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        current = written_narrow(small.where("u <> v").distinct(), name)
    else:
        raise RuntimeError(f"components are not complete after {ROUNDS} rounds")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def vocabulary_file(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))

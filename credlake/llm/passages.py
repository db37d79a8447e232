"""Removal of text that repeats across documents: paragraph MinHash banding, and passages inside paragraphs.

Paragraphs are lines of at least ``min_words`` words. Bands of minwise hashes are tuned to
the longest that find a pair of similarity 0.75 with ``RECALL``; paragraphs that collide in a
band are joined (crowded bands are told apart by further tokens), exact Jaccard similarity of
their 5-word shingles decides, and components of similar paragraphs are clusters. Of a cluster the
document with the smallest id keeps its paragraph; in every other document it is cut out.

A passage set into other paragraphs has no line of its own, so all runs of ``WINDOW`` words of what the first
step leaves are compared too. Each run names the least hash among its ``GRAM``-word grams, a rule of the words alone,
so equal runs name the same gram. Grams are aggregated to the smallest and largest id that hold them as
they leave the scan, and only keys of two documents are written; runs that name one of those are
hashed whole, and equal hashes decide. The smallest id keeps the run, overlapping runs add up to whole passages. Runs with fewer than
``MIN_DIFFERENT`` different words are no evidence.

Defined results: null and empty texts stay as they are; a row without an id is never cut and
never makes others be cut; repeats inside one document, and so repeated rows, are kept; a document whose every paragraph
repeats is left with an empty text; an empty table gives an empty table; all columns of the
input come back under their names, and the two counts join them (a column of the input that has a
count's name gives way to it).
"""
from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from credlake.llm import chosen_path
from credlake.llm.common import distinct_within, dropped, free_name, minwise, mix64, placed_words, released, seeds, shingles_of, text_parts, written, written_narrow

MIN_WORDS = 20
RECALL = 0.999
HASHES = 18
WINDOW = 16
GRAM = 8
MIN_DIFFERENT = 8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tuned_bands(similarity: float = 0.75, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``hashes`` hashes that reaches the recall."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def hashed_runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    by = seeds(size, 3)
    return mix64(sum(words[k : len(words) - size + 1 + k] * by[k] for k in range(size)))


def named_grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, grams, keys): first words of the runs that are evidence, the first words of the grams they name, their hashes."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    nearest = np.zeros(len(words), dtype=np.int8)
    for lag in range(WINDOW - 1, 0, -1):
        np.copyto(nearest[lag:], lag, where=words[lag:] == words[:-lag])
    again = np.flatnonzero(nearest)
    places = len(words) + 1
    repeated = np.bincount(np.maximum(again - WINDOW + 1, 0), minlength=places) - np.bincount(again - nearest[again] + 1, minlength=places)
    starts = np.flatnonzero(WINDOW - np.cumsum(repeated)[:n] >= MIN_DIFFERENT)
    # the least of a run's grams, the first of equal ones: of 1, 2, 4, … grams, and then of as many as are left
    least = hashed_runs(words, GRAM)
    at, held, wanted = np.zeros(len(least), dtype=np.int8), 1, WINDOW - GRAM + 1
    while held < wanted:
        step = min(held, wanted - held)
        lower = least[step:] < least[:-step]
        at = np.where(lower, at[step:] + np.int8(step), at[:-step])
        least = np.minimum(least[step:], least[:-step])
        held += step
    return starts, (np.arange(n) + at)[starts], least[starts]


class Texts:
    """Some texts hashed together: their words, and the text and line that each belongs to."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts]) + 1
        joined = b"\n".join(texts)
        self.words, starts = placed_words(joined)
        breaks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)
        begins = np.cumsum(sizes) - sizes
        self.owner = np.searchsorted(begins, starts, "right") - 1
        self._starts, self._breaks = starts, breaks
        self.first_line = np.searchsorted(breaks, begins)

    @cached_property
    def line(self) -> np.ndarray:
        return np.searchsorted(self._breaks, self._starts)

    def paragraphs(self, min_words: int, by: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, line of it, key, size, minwise hashes) of the lines of ``min_words`` words and more."""
        n = len(self.words)
        edges = np.flatnonzero(np.diff(self.line, prepend=-1))
        lengths = np.diff(np.append(edges, n))
        long = np.repeat(lengths >= min_words, lengths)
        left = np.repeat(edges + lengths, lengths) - np.arange(n)  # words from here to the line's end
        short = lengths < 5
        hashes = np.empty(n, np.uint64)
        full = np.flatnonzero(long & (left >= 5))
        if len(full):
            hashes[full] = shingles_of(self.words)[full]
        at = full
        if min_words < 5:
            few = np.flatnonzero(short & (lengths >= min_words))
            for e, m in zip(edges[few], lengths[few]):
                hashes[e] = shingles_of(self.words[e : e + m])[0]
            at = np.sort(np.concatenate([full, edges[few]]))
        if not len(at):
            return (np.empty(0, np.int64),) * 4 + (np.empty((0, len(by)), np.uint32),)
        line, value = distinct_within(self.line[at], hashes[at])
        starts = np.flatnonzero(np.diff(line, prepend=-1))
        offsets = np.append(starts, len(value))
        number = line[starts]
        owner = np.searchsorted(self.first_line, number, "right") - 1
        return owner, number - self.first_line[owner], chosen_path.set_keys(value, starts), np.diff(offsets), minwise(value, offsets, by)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word in it, word number, gram's word number, gram's hash) of the runs that are evidence."""
        starts, grams, keys = named_grams(self.words)
        whole = self.owner[starts] == self.owner[starts + WINDOW - 1] if len(starts) else np.empty(0, bool)
        starts, grams, keys = starts[whole], grams[whole], keys[whole]
        begins = np.searchsorted(self.owner, np.arange(self.owner[-1] + 1 if len(self.owner) else 0))
        owner = self.owner[starts]
        return owner, starts - begins[owner] if len(starts) else starts, starts, grams, keys


def _scanned(docs: DataFrame, schema: str, fn: Callable[[Texts, pa.RecordBatch, int, int], pa.RecordBatch | None]) -> DataFrame:
    """What ``fn`` gives for parts of the texts of (doc_id, text, …); rows without id or text are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(1), pa.binary())
            for a, b in text_parts(texts):
                out = fn(Texts(texts.slice(a, b - a).to_pylist()), batch, a, b)
                if out is not None and out.num_rows:
                    yield out
        released()

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, schema)


def paragraphs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, pos, key, n, sig): paragraphs by line number, with their set's name, size and minwise hashes."""
    by = seeds(HASHES, 2)

    def rows(some: Texts, batch: pa.RecordBatch, a: int, b: int) -> pa.RecordBatch:
        owner, line, keys, sizes, sigs = some.paragraphs(min_words, by)
        packed = [s.tobytes() for s in sigs.astype("<u4")]
        return pa.record_batch([batch.column(0).take(pa.array(owner + a)), pa.array(line.astype(np.int32)), pa.array(keys), pa.array(sizes.astype(np.int64)), pa.array(packed, pa.binary())], ["doc_id", "pos", "key", "n", "sig"])

    return _scanned(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, pos int, key bigint, n bigint, sig binary", rows)


def grams(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, key): the grams that a document's runs name, by the word they begin with."""

    def rows(some: Texts, batch: pa.RecordBatch, a: int, b: int) -> pa.RecordBatch:
        owner, first, starts, named, keys = some.runs()
        once = np.flatnonzero(np.diff(named, prepend=-1))  # they never go back
        at = (first + named - starts)[once]
        return pa.record_batch([batch.column(0).take(pa.array(owner[once] + a)), pa.array(at.astype(np.int32)), pa.array(keys[once].astype(np.int64))], ["doc_id", "pos", "key"])

    return _scanned(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, pos int, key bigint", rows)


def runs_at(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(doc_id, pos, key): first word and hash of every run that names one of the grams ``marked`` (doc_id, pos)."""

    def rows(some: Texts, batch: pa.RecordBatch, a: int, b: int) -> pa.RecordBatch:
        owner, first, starts, named, _ = some.runs()
        wanted = batch.column(2).slice(a, b - a)
        places, sizes = wanted.flatten().to_numpy(), wanted.value_lengths().to_numpy()
        owner_of = np.repeat(np.arange(b - a), sizes)
        hit = np.isin(owner.astype(np.int64) << 32 | (first + named - starts), owner_of.astype(np.int64) << 32 | places)
        whole = hashed_runs(some.words, WINDOW)[starts[hit]] if hit.any() else np.empty(0, np.uint64)
        return pa.record_batch([batch.column(0).take(pa.array(owner[hit] + a)), pa.array(first[hit].astype(np.int32)), pa.array(whole.astype(np.int64))], ["doc_id", "pos", "key"])

    marks = marked.groupBy("doc_id").agg(F.collect_set("pos").alias("__grams"))
    return _scanned(docs.select("doc_id", "text").join(marks, "doc_id"), f"doc_id {dict(docs.dtypes)['doc_id']}, pos int, key bigint", rows)


def held_twice(runs: DataFrame) -> DataFrame:
    """(key, first): keys of more than one document, and the smallest id."""
    return runs.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("key", "first")


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, lines array<int>): numbers of the lines whose cluster a smaller id holds too."""
    lines = written(paragraphs(docs, min_words), "paragraphs")
    holder = written(lines.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("at"), F.first("n").alias("n"), F.first("sig").alias("sig")).select("key", "at.doc_id", "at.pos", "n", "sig"), "holders")
    items = holder.select("key", "n", "sig")

    def fetch(wanted: DataFrame) -> DataFrame:
        line = F.get(F.split("text", "\n"), F.col("pos"))
        return wanted.join(holder.select("key", "doc_id", "pos"), "key").join(docs.select("doc_id", "text"), "doc_id").withColumn("text", line)

    bands, rows = tuned_bands()
    labels = chosen_path.linked(items, fetch, bands, rows=rows)
    cluster = holder.select("key", "doc_id").join(labels.withColumnRenamed("node", "key"), "key", "left").select("key", "doc_id", F.coalesce("component", "key").alias("cluster"))
    cluster = written_narrow(cluster, "clusters")
    first = cluster.groupBy("cluster").agg(F.min("doc_id").alias("first"))
    owner = cluster.join(first, "cluster").select("key", "first")
    cut_lines = lines.select("doc_id", "pos", "key").join(owner, "key").where("doc_id <> first")
    marks = written(cut_lines.groupBy("doc_id").agg(F.collect_set("pos").alias("lines")), "cut-lines")
    for table in (lines, holder):
        dropped(table)
    return marks


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs array<int>): first word numbers of the runs that a smaller id holds too."""
    named = grams(docs)
    shared = written(held_twice(named.select("doc_id", "key")).select("key"), "shared-grams")
    marked = written(named.join(shared, "key", "left_semi").select("doc_id", "pos"), "marked-grams")
    runs = written(runs_at(docs, marked), "runs")
    marks = written(runs.join(held_twice(runs), "key").where("doc_id <> first").groupBy("doc_id").agg(F.collect_set("pos").alias("runs")), "cut-runs")
    for table in (shared, marked, runs):
        dropped(table)
    return marks


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, lines array<int>, runs array<int>): line numbers and first word numbers of what a smaller id
    holds too, both counted in the whole texts (the removal counts runs in what its lines leave)."""
    none = F.array().cast("array<int>")
    both = repeated_lines(docs, min_words).join(repeated_runs(docs), "doc_id", "full")
    return both.select("doc_id", F.coalesce("lines", none).alias("lines"), F.coalesce("runs", none).alias("runs"))


def cut(text: str, lines: list[int], runs: list[int]) -> str:
    """The text without the given lines and runs of WINDOW words; white space next to a cut run goes with it."""
    gone = set(lines)
    out, start = [], 0
    kept_lines = text.split("\n")
    marks = np.zeros(len(text) + 1, dtype=np.int32)
    if len(runs):
        words = [m.span() for m in _WORD.finditer(text)]
        first = np.unique([r for r in runs if r + WINDOW <= len(words)]).astype(np.int64)
        for part in np.split(first, np.flatnonzero(np.diff(first) > WINDOW) + 1) if len(first) else []:
            stop = int(part[-1]) + WINDOW
            end = words[stop][0] if stop < len(words) else len(text)
            last = words[stop - 1][1]
            marks[words[int(part[0])][0]] += 1
            marks[end if "\n" not in text[last:end] else last] -= 1
    covered = np.cumsum(marks)[: len(text)] > 0
    for number, line in enumerate(kept_lines):
        if number not in gone:
            inside = covered[start : start + len(line)]
            if inside.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[True], inside, [True]])))
                line = "".join(line[a:b] for a, b in zip(edges[::2], edges[1::2])).rstrip(" ")
                if line:
                    out.append(line)
            else:
                out.append(line)
        start += len(line if number in gone else kept_lines[number]) + 1
    return "\n".join(out)


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs``, with repeated text cut, and n_cut_lines, n_cut_runs."""
    taken = {c.lower() for c in docs.columns}
    columns = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_cut_lines", "n_cut_runs")])
    id_, mark = free_name(taken, "id"), free_name(taken, "mark")

    @F.pandas_udf(StringType())
    def shortened(text: pd.Series, lines: pd.Series, runs: pd.Series) -> pd.Series:
        marks = ((() if li is None else li, () if ru is None else ru) for li, ru in zip(lines, runs))
        return pd.Series([t if t is None or not len(li) + len(ru) else cut(t, list(li), list(ru)) for t, (li, ru) in zip(text, marks)], dtype=object)

    def without(rows: DataFrame, marks: DataFrame, lines: Column, runs: Column, name: str) -> DataFrame:
        """Rows with marked text cut, and how many marks there were as ``name``."""
        marks = marks.select(F.col("doc_id").alias(id_), F.struct(lines.alias("lines"), runs.alias("runs")).alias(mark))
        joined = rows.join(marks, F.col("doc_id") == F.col(id_), "left")
        got = F.coalesce(F.size(f"{mark}.lines"), F.lit(0)) + F.coalesce(F.size(f"{mark}.runs"), F.lit(0))
        text = shortened("text", f"{mark}.lines", f"{mark}.runs")
        return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in rows.columns], got.alias(name))

    none = F.array().cast("array<int>")
    rest = written(without(columns, repeated_lines(columns, min_words), F.col("lines"), none, "n_cut_lines"), "lines-cut")
    return without(rest, repeated_runs(rest), none, F.col("runs"), "n_cut_runs")

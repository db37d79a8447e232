"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword; each bit of it is one binary question (is the language in
this half?), answered by a linear n-gram classifier. A text's margins on all bits are held
against every codeword with a loss weighted by how well each bit separates the training
texts; the nearest codeword wins. When the runner-up is nearly as close, the row is flagged.

Features are counts of hashed byte n-grams of the lower-cased UTF-8 text, taken over the
whole text. Training uses at most ``PER_LANGUAGE`` documents of each language, those with
the smallest hash of their id (a documented bound); nothing else is sampled.

Defined results: null text or a text without a letter is ``und`` with score 0 and is not
ambiguous; without any training text every row is ``und``; repeated rows get equal answers;
rows of null language are never learned from; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from credlake.llm.common import crc32_mod, kept_rows

UNKNOWN = "und"
PER_LANGUAGE = 400
HASH_BITS = 10
BUCKETS = 1 << 11
ORDERS = (2, 3)
AMBIGUOUS_BELOW = 0.2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def features(text: bytes | None) -> np.ndarray:
    """Share of each n-gram bucket in a text; one block of buckets per order."""
    out = np.zeros(BUCKETS * len(ORDERS))
    if not text:
        return out
    x = _LOWER[np.frombuffer(text, np.uint8)].astype(np.uint32)
    for k, order in enumerate(ORDERS):
        n = len(x) - order + 1
        if n < 1:
            continue
        h = x[:n] * _MULTIPLIERS[0]
        for i in range(1, order):
            h = (h ^ (h >> np.uint32(15))) + x[i : i + n] * _MULTIPLIERS[i % 3]
        h = (h ^ (h >> np.uint32(13))) * _MULTIPLIERS[1]
        out[k * BUCKETS : (k + 1) * BUCKETS] = np.bincount(h >> np.uint32(21), minlength=BUCKETS) / n
    return out


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits into two sides for a few languages, else a fixed
    pseudo-random code with about ten bits for each doubling of n."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[1] + [1 if s >> i & 1 else -1 for i in range(n - 1)] for s in range((1 << (n - 1)) - 1)]
        return np.array(bits, dtype=float).T
    width = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(n)
    best, apart = None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        code[:, np.abs(code.sum(0)) == n] = np.where(np.arange(n) % 2, 1.0, -1.0)[:, None]
        near = ((width - code @ code.T) / 2 + np.eye(n) * width).min()
        if near > apart:
            best, apart = code, near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language index, its probability, and the gap to the runner-up."""
        margins = x @ self.weights + self.bias
        loss = np.logaddexp(0, -self.code[None] * np.clip(margins, -30, 30)[:, None, :]) @ self.trust
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        ranked = np.sort(p, axis=1)
        gap = ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)
        return best, ranked[:, -1], gap


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 150) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bits' logistic regressions at once by accelerated gradient steps on scaled features."""
    mean = x.mean(0)
    scale = np.maximum(x.std(0), 1e-6) * np.sqrt(x.shape[1])
    z = (x - mean) / scale
    w = np.zeros((x.shape[1], y.shape[1]))
    b = np.zeros(y.shape[1])
    look, look_b, old, old_b = w, b, w, b
    rate, penalty = 2.0, 1e-4
    for k in range(steps):
        g = -y / (1 + np.exp(np.clip(y * (z @ look + look_b), -30, 30))) / len(x)
        w, b = look - rate * (z.T @ g + penalty * look), look_b - rate * g.sum(0)
        look, look_b = w + k / (k + 3) * (w - old), b + k / (k + 3) * (b - old_b)
        old, old_b = w, b
    right = (np.sign(z @ w + b) == y).mean(0)
    plain = w / scale[:, None]
    return plain, b - mean @ plain, right


def smallest_hashes(rows: DataFrame, per_language: int) -> DataFrame:
    """(doc_id, lang, rank) of the ``per_language`` rows of each language with the smallest hash of their id.

    Counts by leading hash bits (at most 2^HASH_BITS rows a language) tell which hashes can be
    among them, so that the ranking reads little more than its result, however many rows a language has.
    """
    hashed = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash")).withColumn("lead", F.shiftright("hash", 64 - HASH_BITS))
    counts = hashed.groupBy("lang", "lead").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("lang").orderBy("lead").rowsBetween(Window.unboundedPreceding, -1))
    low = counts.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < per_language).select("lang", "lead")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    ranked = hashed.join(F.broadcast(low), ["lang", "lead"]).withColumn("rank", rank)
    return ranked.where(F.col("rank") <= per_language).select("doc_id", "lang", "rank")


def fit(train: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from rows (doc_id, text, lang); null text or language is passed over."""
    rows = train.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    ids = smallest_hashes(rows, per_language).select("doc_id", F.lit(True).alias("chosen")).distinct()
    chosen = rows.join(F.broadcast(ids), "doc_id").repartition(16, "doc_id")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.cast(batch.column(2), pa.binary())
            vectors = [features(t.as_py()).astype("<f2").tobytes() for t in texts]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], ["doc_id", "lang", "vector"])

    got = chosen.mapInArrow(sparse, f"doc_id {dict(train.dtypes)['doc_id']}, lang string, vector binary").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    languages = sorted(set(got.column("lang").to_pylist()))
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS * len(ORDERS), 1)), np.zeros(1), np.ones(1))
    x = np.sqrt(np.stack([np.frombuffer(v.as_py(), "<f2") for v in got.column("vector")]).astype(np.float32))
    code = codewords(len(languages))
    y = code[[languages.index(v) for v in got.column("lang").to_pylist()]].astype(np.float32)
    weights, bias, right = _logistic(x, y)
    trust = np.log(np.clip(right, 0.55, 0.999) / (1 - np.clip(right, 0.55, 0.999)))
    return Model(languages, code, weights.astype(np.float32), bias.astype(np.float32), trust / trust.sum() * 4)


def _told(m: Model, texts: pa.Array, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, scores and ambiguity of some texts."""
    names = np.full(len(texts), UNKNOWN, dtype=object)
    score, flag = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
    texts = pc.cast(texts, pa.binary())
    at = np.flatnonzero(usable) if m.languages else np.empty(0, int)
    for part in np.array_split(at, max(1, len(at) // 512)):
        if len(part):
            x = np.sqrt(np.stack([features(texts[int(i)].as_py()) for i in part]).astype(np.float32))
            best, p, gap = m.decode(x)
            names[part] = np.array(m.languages, dtype=object)[best]
            score[part], flag[part] = p, gap < AMBIGUOUS_BELOW
    return names, score, flag


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, flag = _told(shared.value, batch.column(1), batch.column(2).to_numpy(zero_copy_only=False).astype(bool))
            yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(flag)], ["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select("doc_id", "text", has_letter(F.col("text")).alias("usable"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")


def told(docs: DataFrame, model: Model, least: float = 0.4) -> DataFrame:
    """The rows of ``docs`` whose language can be told: not ``und``, and not both ambiguous and below ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts: pa.Array, usable: np.ndarray) -> np.ndarray:
        names, score, flag = _told(shared.value, texts, usable)
        return (names != UNKNOWN) & ~(flag & (score < least))

    return kept_rows(docs, keep, "text", has_letter(F.col("text")))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, train: DataFrame | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fit on ``train`` (by default the rows of ``docs`` whose crc32 of the id is not 0 modulo 5) and predict every row."""
    return predict(docs, fit(learnable(docs) if train is None else train, per_language))


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: the crc32 of their id is not 0 modulo 5."""
    return docs.where(crc32_mod("doc_id", 5) != 0)

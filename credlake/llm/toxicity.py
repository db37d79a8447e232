"""Toxicity by a weighted finite-state pattern grammar.

Three transducers are composed over the tokens of a clause:

* the lexicon maps a token to a class: insult (with a weight), threat, target, negation,
  reported speech or other. Insult stems are learned: a stem is the start of a word, or a
  whole word, that labelled toxic texts hold far more often than clean ones;
* the context transducer carries what has been seen in the clause: a negation in the last
  ``REACH`` tokens, a target in the last ``REACH`` tokens, and reported speech;
* the pattern transducer emits a weighted match when an insult or threat is read, by its
  context: plain, aimed at a target, negated, or reported.

The composition is one table (state, class) -> (state, emission). A text's score is a logistic
function of its matched clauses, with weights learned per emission. Nothing but the text is
an input of a score.

Training uses at most ``MAX_TRAINING`` labelled rows, those with the smallest hash of their
id (a documented bound); scoring reads every whole text.

Defined results: a null or empty text, or one without a match, gets the score of no match;
repeated rows get equal scores; repeated or null labels: null is passed over, and repeated ids count once with
the largest label; without labels of both kinds the lexicon is empty and every score is the
share of toxic labels (0 without labels); other columns are not read.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import crc32_mod, kept_rows, released

MAX_TRAINING = 40_000
STEM_LENGTHS = (4, 5, 6, 7)
MIN_TOXIC, MIN_LOG_ODDS, MAX_CANDIDATES = 4, 3.0, 20_000
#: Copies of one text repeat its words in the same places; a stem needs so many different neighbourhoods, and as a share of its texts.
MIN_CONTEXTS, CONTEXT_SHARE = 4, 0.2
REACH = 3
THRESHOLD = 0.3
#: Texts whose words are counted together in a task's memory.
COUNTED_ROWS = 2000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Closed word classes, in the languages of the corpus.
THREATS = {"kill", "murder", "hang", "beat", "burn", "shoot", "stab", "töten", "umbringen", "erschießen", "verbrennen", "tuer", "frapper", "brûler", "matar", "quemar", "golpear"}
TARGETS = {"you", "your", "yours", "they", "them", "he", "she", "these", "those", "du", "dich", "dir", "ihr", "euch", "sie", "tu", "toi", "vous", "ils", "elles", "tú", "te", "ti", "usted", "ustedes", "vosotros", "ellos", "ellas"}
NEGATIONS = {"not", "no", "never", "nor", "without", "nicht", "kein", "keine", "nie", "ohne", "pas", "jamais", "sans", "ni", "nunca", "sin"}
REPORTS = {"said", "says", "say", "claimed", "claims", "called", "wrote", "quoted", "sagte", "sagt", "behauptet", "nannte", "dit", "affirme", "déclare", "appelle", "dijo", "dice", "afirma", "llamó"}

_WORD = regex.compile(r"\p{L}+(?:['’]\p{L}+)*")
_BREAK = regex.compile(r"[.!?;:\n]")

#: Context state: (tokens since a negation, tokens since a target), each 0..REACH with REACH for none, and reported or not.
STATES = [(n, t, r) for n in range(REACH + 1) for t in range(REACH + 1) for r in (0, 1)]
START = STATES.index((REACH, REACH, 0))
EMISSIONS = ["insult", "aimed_insult", "negated_insult", "reported_insult", "threat", "aimed_threat", "negated_threat", "reported_threat"]


def compose() -> list[list[tuple[int, int]]]:
    """The composed transducer: table[state][class] = (next state, emission or -1)."""
    table = []
    for negated, aimed, reported in STATES:
        row = []
        for kind in range(6):
            n = 0 if kind == NEGATION else min(REACH, negated + 1)
            t = 0 if kind == TARGET else min(REACH, aimed + 1)
            r = 1 if kind == REPORT else reported
            emission = -1
            if kind in (INSULT, THREAT):
                context = 2 if negated < REACH else 3 if reported else 1 if aimed < REACH else 0
                emission = context + (4 if kind == THREAT else 0)
            row.append((STATES.index((n, t, r)), emission))
        table.append(row)
    return table


TABLE = compose()


@dataclass
class Grammar:
    stems: dict[str, float] = field(default_factory=dict)  # start of a word -> weight
    words: dict[str, float] = field(default_factory=dict)  # whole word -> weight
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(len(EMISSIONS) + 2))
    bias: float = -20.0

    def __post_init__(self):
        self._start = None  # built in each process

    def hits(self, low: str) -> Iterator[tuple[int, int]]:
        """Places of a lower-cased text where an insult or threat may begin, by an Aho-Corasick machine."""
        if self._start is None:
            import ahocorasick

            self._start = ahocorasick.Automaton()
            for word in {*self.words, *self.stems, *THREATS}:
                self._start.add_word(word, len(word))
            self._start.make_automaton()
        for last, size in self._start.iter(low):
            begin = last - size + 1
            if begin == 0 or not low[begin - 1].isalpha():
                yield begin, last + 1

    def symbol(self, token: str) -> tuple[int, float]:
        weight = self.words.get(token, 0.0)
        for n in STEM_LENGTHS:
            weight = max(weight, self.stems.get(token[:n], 0.0) if len(token) >= n else 0.0)
        if weight:
            return INSULT, weight
        if token in THREATS:
            return THREAT, 1.0
        if token in TARGETS:
            return TARGET, 0.0
        if token in NEGATIONS:
            return NEGATION, 0.0
        if token in REPORTS:
            return REPORT, 0.0
        return OTHER, 0.0

    def matches(self, text: str) -> list[tuple[int, int, int, float]]:
        """Matched clauses' emissions: (clause start, clause end, emission, weight)."""
        low = text.lower()
        found, done = [], 0
        for hit, after in self.hits(low):
            if hit < done:
                continue
            begin = done
            for k in range(hit - 1, done - 1, -1):
                if low[k] in ".!?;:\n":
                    begin = k + 1
                    break
            end = _BREAK.search(low, after)
            done = end.start() if end else len(low)
            state = START
            for token in _WORD.findall(low, begin, done):
                kind, weight = self.symbol(token)
                state, emission = TABLE[state][kind]
                if emission >= 0:
                    found.append((begin, done, emission, weight))
        return found

    def evidence(self, text: str | None) -> np.ndarray:
        """Weighted matches by emission (saturating), their number, and their density."""
        out = np.zeros(len(EMISSIONS) + 2)
        if text:
            found = self.matches(text)
            for _, _, emission, weight in found:
                out[emission] += weight
            out[: len(EMISSIONS)] = np.log1p(out[: len(EMISSIONS)])
            out[-2] = math.log1p(len(found))
            out[-1] = min(1.0, 100.0 * len(found) / (1 + len(text)))
        return out

    def score(self, evidence: np.ndarray) -> float:
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(evidence @ self.coefficients + self.bias))))))


def counted_stems(text: str) -> set[str]:
    """Lexicon candidates of a text: '=word' for whole words and starts of words."""
    out = set()
    for word in set(_WORD.findall(text.lower())):
        out.add("=" + word)
        for n in STEM_LENGTHS:
            if len(word) > n:
                out.add(word[:n])
    return out


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAINING) -> DataFrame:
    """(doc_id, text, toxic) of at most ``bound`` labelled documents; the bounded id list is broadcast."""
    chosen = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")


def learn(docs: DataFrame, labels: DataFrame, bound: int = MAX_TRAINING) -> Grammar:
    """Lexicon and weights from labelled texts, both counted by Spark tasks."""
    rows = training_rows(docs, labels, bound)
    share = rows.groupBy("toxic").count().collect()
    count = Counter({r["toxic"]: r["count"] for r in share})
    total = sum(count.values())
    if not count[1] or not count[0]:
        rate = count[1] / total if total else 0.0
        return Grammar(bias=math.log((rate + 1e-9) / (1 - rate + 1e-9)))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_ROWS):
                tox, clean = Counter(), Counter()
                some = batch.slice(start, COUNTED_ROWS)
                for text, label in zip(some.column(1), some.column(2).to_pylist()):
                    (tox if label else clean).update(counted_stems(text.as_py()))
                keys = list({*tox, *clean})
                yield pa.record_batch([pa.array(keys, pa.string()), pa.array([tox[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["stem", "toxic", "clean"])
        released()

    smooth = F.log((F.col("t") + 0.5) / (count[1] + 1.0)) - F.log((F.col("c") + 0.5) / (count[0] + 1.0))
    found = (
        rows.select("doc_id", "text", "toxic")
        .mapInArrow(counts, "stem string, toxic bigint, clean bigint")
        .groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        .where(F.col("t") >= MIN_TOXIC).withColumn("odds", smooth).where(F.col("odds") >= MIN_LOG_ODDS)
        .orderBy(F.desc("odds"), F.length("stem"), "stem").limit(MAX_CANDIDATES).collect()
    )
    grammar = Grammar()
    support = {r["stem"]: (r["t"], r["odds"]) for r in found}
    spread = _contexts(rows.where("toxic = 1"), set(support))
    for stem, (t, odds) in sorted(support.items(), key=lambda x: (x[0][0] == "=", len(x[0]), x[0])):
        if spread.get(stem, 0) < max(MIN_CONTEXTS, CONTEXT_SHARE * t):
            continue
        word = stem.removeprefix("=")
        if any(grammar.stems.get(word[:n], 0.0) >= odds - 1 for n in STEM_LENGTHS if n <= len(word)):
            continue  # a shorter stem says it already
        (grammar.words if stem[0] == "=" else grammar.stems)[word] = float(odds)

    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [shared.value.evidence(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.record_batch([pa.array(values, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(evidence, "x array<double>, toxic int").groupBy("x", "toxic").count().toArrow()
    x = np.array(got.column("x").to_pylist())
    y = np.array(got.column("toxic").to_pylist(), dtype=float)
    n = np.array(got.column("count").to_pylist(), dtype=float)
    order = np.lexsort([*x.T, y])
    grammar.coefficients, grammar.bias = _fit(x[order], y[order], n[order])
    return grammar


def _contexts(rows: DataFrame, stems: set[str]) -> dict[str, int]:
    """In how many different neighbourhoods (word before, word after) each candidate stands."""
    shared = rows.sparkSession.sparkContext.broadcast(stems)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            seen = set()
            for value in batch.column(0):
                words = ["", *_WORD.findall(value.as_py().lower()), ""]
                for i in range(1, len(words) - 1):
                    w = words[i]
                    for stem in ("=" + w, *(w[:n] for n in STEM_LENGTHS if n < len(w))):
                        if stem in wanted:
                            seen.add((stem, f"{words[i - 1]} {words[i + 1]}"))
            stem, context = zip(*seen) if seen else ((), ())
            yield pa.record_batch([pa.array(stem, pa.string()), pa.array(context, pa.string())], ["stem", "context"])

    pairs = rows.select("text").mapInArrow(run, "stem string, context string").distinct()
    return {r["stem"]: r["count"] for r in pairs.groupBy("stem").count().collect()}


def _fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps; more of an emission never lowers the score."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    w[-1] = math.log((n @ y + 1) / (n @ (1 - y) + 1))
    ridge = np.full(len(w), penalty * n.sum())
    ridge[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (n * (y - p)) - ridge * w)
        size = float(np.abs(step).max())
        w = w + step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    w[:-1] = np.maximum(w[:-1], 0.0)
    return w[:-1], float(w[-1])


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score, n_matches) for every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            scores, found = [], []
            for value in batch.column(1):
                e = g.evidence(value.as_py())
                scores.append(g.score(e))
                found.append(round(math.expm1(e[-2])))
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.int32())], ["doc_id", "score", "n_matches"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double, n_matches int")


def below(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def keep(texts: pa.Array, usable: np.ndarray) -> np.ndarray:
        g = shared.value
        return np.array([g.score(g.evidence(value.as_py())) < threshold for value in texts], dtype=bool)

    return kept_rows(docs, keep, "text")


def matched_clauses(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, begin, end, pattern, weight, clause) of every match."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, a, b, EMISSIONS[e], w, t[a:b]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for a, b, e, w in shared.value.matches(t)]
            columns = list(zip(*rows)) or [()] * 6
            types = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "begin", "end", "pattern", "weight", "clause"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, begin int, end int, pattern string, weight double, clause string")


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_matches): learn from labels whose id's crc32 is not 2 modulo 4, score every row."""
    grammar = learn(docs, labels.where(crc32_mod("doc_id", 4) != 2))
    held_out = F.coalesce(crc32_mod("doc_id", 4) == 2, F.lit(False))
    return score(docs, grammar).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_matches")

"""Cost-balanced packing of token sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n`` (attention stays inside a piece).
Documents are dealt by a hash into shards of about ``SHARD_BYTES`` of text. In a shard the
sequences are opened first: as many of ``CAPACITY`` tokens as the shard fills, and for what
is over, sequences of falling powers of two, which need no padding. Documents are cut into
pieces of at most CAPACITY tokens; the pieces, longest first, each go to the sequence of
lowest cost so far that has room; a piece that is longer than the room is cut there and its
rest waits as a shorter piece. So every sequence is filled to its last token.

Tokens come from the tokenizers library. A pre-token's ids don't depend on its neighbours, so each
worker keeps the ids of pre-tokens that it has seen, in a table of bounded size. Latin-1 texts are split
into pre-tokens many at once; other texts go to the library whole.

Defined results: a null or empty text is a document of one token, the end id; repeated rows
are separate documents; an empty table gives no pieces; other columns are not read.
"""
from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import grouped_runs, text_parts, vocabulary_file

CAPACITY = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SHARD_BYTES = 4 << 20
CACHE_WORDS = 700_000
#: Bytes of text that a worker splits at once.
PART_BYTES = 4 << 20
#: The pre-tokens that ``pretokens`` finds; a tokenizer with another pattern encodes whole texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin-1 characters that others take for space and the tokenizer may not.
_OTHER_SPACE = b"\x1c\x1d\x1e\x1f\x85"
_LATIN = [chr(c) for c in range(256)]
_LOWER = np.array([ord(c.lower()) for c in _LATIN], np.uint8)
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_CLASS = np.array([_SPACE if c.isspace() else _LETTER if regex.match(r"\p{L}", c) else _NUMBER if regex.match(r"\p{N}", c) else _OTHER for c in _LATIN], np.uint8)
_LOADED: dict = {}


def pretokens(raw: np.ndarray) -> np.ndarray:
    """First bytes of the matches of PATTERN, and of the white space between them, in lower-case Latin-1."""
    kind = _CLASS[raw]
    new = np.ones(len(raw), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    at = np.flatnonzero(new & (raw == ord("'")))  # an apostrophe inside a run of signs belongs to the run
    after = np.append(raw, np.zeros(3, np.uint8))
    one, two = after[at + 1], after[at + 2]
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    ends = np.concatenate([at[short] + 2, at[long] + 3])
    new[at[short | long] + 1] = False
    new[ends[ends < len(raw)]] = True
    return np.flatnonzero(new)


class WordIds:
    """Ids (as little-endian 16- or 32-bit bytes) of the pre-tokens of normalised text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.known = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == PATTERN
        self.special = [t["content"] for t in spec["added_tokens"]]
        to_alphabet = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.alphabet = {c: "".join(piece for piece, _ in to_alphabet(chr(c))) for c in range(256)}
        self.forget()

    def forget(self) -> None:
        """Empty the table: places of pre-tokens, and the ids that begin and end there."""
        self.words: dict[bytes, int] = {}
        self.flat, self.ends = np.empty(0, self.kind), np.zeros(1, np.int64)

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def plain(self, text: str) -> bytes | None:
        """The text in Latin-1 (composed already, and lower case is one character by another), or None where only the library can tell."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if not self.known or len(raw.translate(None, _OTHER_SPACE)) < len(raw) or any(t in text for t in self.special):
            return None
        return raw

    def learn(self, new: list[bytes]) -> None:
        """Put pre-tokens into the table; the library's model reads bytes as characters of its alphabet."""
        tokenize, alphabet = self.model.tokenize, self.alphabet
        ids: list[int] = []
        ends = []
        for word in new:
            text = word.decode("latin-1")
            if not text.isspace():
                ids += [t.id for t in tokenize(text if word.isalnum() else text.translate(alphabet))]
            ends.append(len(ids))
        self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.ends = np.concatenate([self.ends, np.array(ends, np.int64) + len(self.flat)])
        self.flat = np.concatenate([self.flat, np.array(ids, self.kind)])

    def places(self, words: list[bytes]) -> np.ndarray:
        """Places of different pre-tokens in the table, which takes in those that it lacks."""
        found = np.array([self.words.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(found < 0)
        if len(self.words) + len(new) > CACHE_WORDS:
            self.forget()
            new = np.arange(len(words))
        found[new] = len(self.words) + np.arange(len(new))
        self.learn([words[i] for i in new.tolist()])
        return found

    def plain_ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of Latin-1 texts, each with the end id."""
        raw = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        starts = pretokens(raw)
        bounds = np.append(starts, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        solid = _CLASS[raw[starts]] != _SPACE
        starts = starts[solid]
        place = self.places(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()[solid]]
        first = self.ends[place]
        sizes = self.ends[place + 1] - first
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(first - upto[:-1], sizes) + np.arange(upto[-1])]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        edges = upto[np.searchsorted(starts, begins)].tolist()
        end = np.array([END_ID], dtype=self.kind).tobytes()
        return [ids[a:b].tobytes() + end for a, b in zip(edges, edges[1:])]

    def all_ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text, each with the end id."""
        end = np.array([END_ID], dtype=self.kind).tobytes()
        out: list[bytes] = []
        for a, b in text_parts(pa.array(texts, pa.large_string()), PART_BYTES):
            raw = [self.plain(t or "") for t in texts[a:b]]
            known = iter(self.plain_ids([r for r in raw if r is not None]))
            out += [self.encoded(t).tobytes() + end if r is None else next(known) for t, r in zip(texts[a:b], raw)]
        return out


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def with_ids(docs: DataFrame, path: str, shards: int) -> DataFrame:
    """(shard, doc_id, ids binary) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            ids = words.all_ids(batch.column(2).to_pylist())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"])

    shard = F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(shards))
    rows = docs.select(shard.alias("shard"), F.col("doc_id"), F.col("text"))
    return rows.mapInArrow(run, f"shard bigint, doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def balanced(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents given by their lengths."""
    total = sum(lengths)
    room = [capacity] * (total // capacity)
    over = total % capacity
    room += [1 << b for b in range(over.bit_length() - 1, -1, -1) if over >> b & 1]
    waiting: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        for start in range(0, n, capacity):
            waiting.append((-min(capacity, n - start), d, start))
    heapq.heapify(waiting)
    cheapest = [(0.0, s) for s in range(len(room))]
    left = list(room)
    out = []
    while waiting:
        size, d, start = heapq.heappop(waiting)
        size = -size
        spent, s = heapq.heappop(cheapest)
        n = min(size, left[s])
        out.append((d, start, n, s, room[s] - left[s]))
        left[s] -= n
        if left[s]:
            heapq.heappush(cheapest, (spent + cost(n), s))
        if n < size:
            heapq.heappush(waiting, (-(size - n), d, start + n))
    return out


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, shard_bytes: int = SHARD_BYTES, include_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, piece_cost and, if asked for, the
    piece's ids (binary, little-endian unsigned 32-bit)."""
    path = tokenizer_path or vocabulary_file("word_bpe_49k.json")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    shards = max(1, -(-int(size) // shard_bytes))
    doc_type = dict(docs.dtypes)["doc_id"]
    narrow = word_ids(path).kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in grouped_runs(batches, "shard"):
            ids = [np.frombuffer(b.as_py(), dtype=narrow) for b in rows.column("ids")]
            names = rows.column("doc_id").to_pylist()
            pieces = balanced([len(i) for i in ids], capacity)
            values = [ids[d][a : a + n].astype("<u4").tobytes() for d, a, n, _, _ in pieces]
            yield pa.record_batch(
                [
                    pa.array([names[p[0]] for p in pieces], rows.schema.field("doc_id").type),
                    pa.array([p[1] for p in pieces], pa.int64()),
                    pa.array([p[2] for p in pieces], pa.int64()),
                    pa.array([zlib.crc32(v) for v in values], pa.int64()),
                    pa.array([len(ids[p[0]]) for p in pieces], pa.int64()),
                    pa.array([(int(shard) << 32) + p[3] for p in pieces], pa.int64()),
                    pa.array([p[4] for p in pieces], pa.int64()),
                    pa.array([cost(p[2]) for p in pieces], pa.float64()),
                    *([pa.array(values, pa.binary())] if include_ids else []),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece_cost", *(["ids"] if include_ids else [])],
            )

    dealt = with_ids(docs, path, shards).repartition(F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    return dealt.mapInArrow(
        run,
        f"doc_id {doc_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, piece_cost double" + (", ids binary" if include_ids else ""),
    )

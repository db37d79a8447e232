"""Byte-level BPE encoding and decoding by the tiktoken library and a local rank file.

Spark deals out the texts; each Python worker loads the rank file once and encodes whole
texts. Texts above ``PIECE_BYTES`` are cut first, only where a token can never cross: before
white space that follows a character which is none. So the ids equal those of one call over
the whole text, while a very long text never makes one very long match list.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give
repeated results; an empty table gives an empty table; other columns are not read.
"""
from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import map_batches, vocabulary_file

PIECE_BYTES = 1 << 16
_BOUNDARY = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=\s)")
_LOADED: dict = {}


def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file, one per process."""
    if (ranks_path, pattern) not in _LOADED:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[ranks_path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[ranks_path, pattern]


def safe_pieces(text: str, size: int = PIECE_BYTES) -> list[str]:
    """Pieces of about ``size`` characters, cut only at safe boundaries (a run without one stays whole)."""
    pieces, start = [], 0
    while len(text) - start > size:
        found = _BOUNDARY.search(text, start + size)
        if not found:
            break
        pieces.append(text[start : found.start()])
        start = found.start()
    pieces.append(text[start:])
    return pieces


def encode_text(enc, text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, "<u4")
    if len(text) <= PIECE_BYTES:
        return np.array(enc.encode_ordinary(text), dtype="<u4")
    return np.concatenate([np.array(enc.encode_ordinary(p), dtype="<u4") for p in safe_pieces(text)])


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<long>): ids of every whole text."""
    ranks_path, pattern = _defaults(ranks_path, pattern)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks_path, pattern)
        ids = [encode_text(enc, t.as_py()) for t in rows.column(1)]
        return pa.record_batch([rows.column(0), pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return map_batches(rows, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<bigint>", batch)


def decode(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, bytes binary): the raw bytes of the ids."""
    ranks_path, pattern = _defaults(ranks_path, pattern)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks_path, pattern)
        data = [enc.decode_bytes(ids.as_py() or []) for ids in rows.column(1)]
        return pa.record_batch([rows.column(0), pa.array(data, pa.binary())], ["doc_id", "bytes"])

    rows = encoded.select("doc_id", "ids")
    return map_batches(rows, f"doc_id {dict(rows.dtypes)['doc_id']}, bytes binary", batch)


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Round trip of every text in one pass: token count, digest of the ids, digest of the decoded bytes."""
    ranks_path, pattern = _defaults(ranks_path, pattern)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks_path, pattern)
        counts, of_ids, of_bytes = [], [], []
        for value in rows.column(1):
            ids = encode_text(enc, value.as_py())
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
            of_bytes.append(hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest())
        return pa.record_batch(
            [rows.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    rows = docs.select("doc_id", "text")
    return map_batches(rows, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", batch)


def _defaults(ranks_path: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return ranks_path or vocabulary_file("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN

"""WARC archives with a two-level capture index.

Writing: each task writes gzip members, one WARC record each, to files of at most
``FILE_BYTES``; a record of a payload that a smaller page id has too is a revisit without a
body. File names are new for every attempt, and only the manifest of successful tasks names
them, so a repeated task leaves no trace in the results.

Index: the manifest is range-partitioned and sorted by reversed-host key; every partition
becomes one index file of compressed blocks of ``BLOCK_ENTRIES`` entries, followed by its
sparse block directory (first key, place and length of each block). The upper level has one
row for each index file.

Reading: a key is found by binary search among the files' first keys, among the file's
block directory, and inside the block; then the record's range is read from its archive.

Defined results: null html is an empty payload; null urls have the empty key; payloads under
``LEAST_BYTES`` are always responses; repeated rows of the smallest id are all responses; an
empty table writes nothing and reads back nothing; other columns are not read.
"""
from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import grouped_runs, new_folder, written

LEAST_BYTES = 100
FILE_BYTES = 64 << 20
BLOCK_ENTRIES = 2000
LEVEL = 4


def storage(uri: str):
    """(file system, path) of a folder that all executors reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.Example.com:80/a?b -> com,example,www)/a?b."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return ")" + url
    key = ",".join(reversed(host.lower().split(".")))
    if port and port not in (80, 443):
        key += f":{port}"
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "") + (f"#{parts.fragment}" if parts.fragment else "")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record, as a gzip member."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + body + b"\r\n\r\n", LEVEL, mtime=0)


def parsed(member: bytes) -> dict:
    """Headers and payload of a record; a response's size and digest come from its payload."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    number = lambda name: fields[name].removeprefix("<urn:page:").removesuffix(">") or None
    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
    if not revisit and (digest != fields["WARC-Payload-Digest"].removeprefix("sha256:") or len(payload) != int(stated["Content-Length"])):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": number("WARC-Record-ID"), "payload_bytes": int(stated["Content-Length"]), "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To") if revisit else None, "payload": payload,
    }


def resolved(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which page of equal payload comes first."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = F.octet_length("payload") >= least
    first = rows.where(long).groupBy("digest").agg(F.min("page_id").alias("first"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; the manifest (key, page_id, file, offset, length) is returned, written itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = storage(folder)
        system.create_dir(base, recursive=True)
        out, name, size = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, payload, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in range(5))):
                    member = record(page_id, url, payload, digest, refers_to)
                    if out is None or size + len(member) > FILE_BYTES:
                        if out is not None:
                            out.close()
                        context = TaskContext.get()
                        name, size = f"part-{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(member)
                    rows.append((url_key(url), page_id, name, size, len(member)))
                    size += len(member)
                columns = list(zip(*rows)) or [()] * 5
                kinds = [pa.string(), batch.schema.field(0).type, pa.string(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    rows = resolved(pages)
    return written(rows.mapInArrow(run, f"key string, page_id {dict(pages.dtypes)['page_id']}, file string, offset bigint, length bigint"), "manifest")


def capture(key: str, page_id) -> tuple:
    """A capture's place in the index order: by key, then id, null ids first."""
    return (key, 0, 0) if page_id is None else (key, 1, page_id)


def index(manifest: DataFrame, folder: str) -> list[tuple]:
    """Write the index files; the upper level is returned: (first key, its page_id, file, directory offset, directory length), in index order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = storage(folder)
        system.create_dir(base, recursive=True)
        waiting, directory, name, out, at = [], [], "", None, 0

        def flush() -> None:
            nonlocal at, waiting
            block = zlib.compress(json.dumps(waiting).encode(), LEVEL)
            out.write(block)
            directory.append((*waiting[0][:2], at, len(block)))
            at += len(block)
            waiting = []

        for batch in batches:
            for entry in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if out is None:
                    name = f"index-{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                waiting.append(entry)
                if len(waiting) >= BLOCK_ENTRIES:
                    flush()
        if out is None:
            return
        if waiting:
            flush()
        tail = zlib.compress(json.dumps(directory).encode(), LEVEL)
        out.write(tail)
        out.close()
        first = pa.array([directory[0][1]], batch.schema.field(1).type)
        yield pa.record_batch([[directory[0][0]], first, [name], pa.array([at]), pa.array([len(tail)])], ["key", "page_id", "file", "offset", "length"])

    dealt = manifest.repartitionByRange("key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    top = written(dealt.mapInArrow(run, f"key string, page_id {dict(manifest.dtypes)['page_id']}, file string, offset bigint, length bigint"), "index")
    return sorted((tuple(r) for r in top.collect()), key=lambda t: (capture(*t[:2]), t[2]))


def locate(keys: DataFrame, top: list[tuple], folder: str) -> DataFrame:
    """(file, offset, length) of the captures of each (url, page_id), by the two-level index.

    Both levels are searched for the pair, so a url of very many captures costs a capture no more
    than other urls do; only rows that repeat a pair may lie in several blocks or files.
    """
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast(top)  # one row for each index file
    kind = dict(keys.dtypes)["page_id"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [capture(*t[:2]) for t in shared.value]
        for batch in batches:
            where, key, page = [], [], []
            for url, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = url_key(url)
                place = capture(k, page_id)
                for f in range(max(0, bisect.bisect_left(firsts, place) - 1), bisect.bisect_right(firsts, place)):
                    where.append(f)
                    key.append(k)
                    page.append(page_id)
            yield pa.record_batch([pa.array(where, pa.int32()), pa.array(key, pa.string()), pa.array(page, batch.schema.field(1).type)], ["index", "key", "page_id"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = storage(folder)
        at, source, firsts, directory, number, block, places = None, None, [], [], -1, [], {}
        for batch in batches:
            found = []
            for f, key, page_id in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if f != at:
                    at = f
                    _, _, name, offset, length = shared.value[f]
                    source = system.open_input_file(f"{base}/{name}")
                    directory = json.loads(zlib.decompress(source.read_at(length, offset)))
                    firsts, number = [capture(*d[:2]) for d in directory], -1
                place = capture(key, page_id)
                for b in range(max(0, bisect.bisect_left(firsts, place) - 1), bisect.bisect_right(firsts, place)):
                    if b != number:
                        block = json.loads(zlib.decompress(source.read_at(directory[b][3], directory[b][2])))
                        number = b
                        places = {}
                        for e in block:
                            places.setdefault((e[0], e[1]), []).append(e[2:])
                    found += places.get((key, page_id), ())
            columns = list(zip(*found)) or [()] * 3
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["file", "offset", "length"])

    asked = keys.select("url", "page_id").distinct().mapInArrow(deal, f"index int, key string, page_id {kind}")
    return asked.repartition(F.col("index")).sortWithinPartitions("index", "key", "page_id").mapInArrow(find, "file string, offset bigint, length bigint")


def read(places: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Records of (file, offset, length), read in the order of each archive."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = storage(folder)
        for name, rows in grouped_runs(batches, "file"):
            with system.open_input_file(f"{base}/{name}") as source:
                for part in rows.to_batches(max_chunksize=1000):
                    records = [parsed(source.read_at(n, at)) for at, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                    for r in records:
                        r["page_id"] = None if r["page_id"] is None else int(r["page_id"])
                        r["refers_to"] = None if r["refers_to"] is None else int(r["refers_to"])
                    yield pa.record_batch([pa.array([r[n] for r in records], k) for n, k in zip(names, kinds)], names)

    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * with_payload
    return places.repartition(F.col("file")).sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, then read each back by its url and id through the index."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    manifest = write(pages, folder)
    top = index(manifest, folder)
    return read(locate(pages, top, folder), folder)

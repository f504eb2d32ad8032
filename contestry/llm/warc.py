"""WARC archives with a two-level capture index.

Records are ordered by reversed-host URL key over all tasks; each task writes one archive of gzip members and
beside it an index whose lines, in key order, are compressed block by block. A directory has one row per block:
its first key, place and length. Lookups find the file and then the block by binary search, and read only that
block and the records it names by byte ranges. A repeated task writes new files; the directory names only
those of the attempt that counted.

Defined cases: a null html is an empty payload, a null url an empty key. Of records with equal payloads of at
least a given size the smallest identifier (and its repeats) is the response, the others are revisits; null
identifiers are always responses. An empty table gives no files and an empty directory.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, scratch, small_batches

#: Payloads below this are never revisits; index lines of a block; level of compression.
LEAST_PAYLOAD, BLOCK_LINES, LEVEL = 100, 256, 4
#: Index blocks that a task reads back.
BLOCKS_A_TASK = 8
_DIRECTORY = "archive string, first_key string, last_key string, offset long, length long, n_lines long"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example,www)/a?b``."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut_at = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host = rest[:cut_at].lower().rsplit("@", 1)[-1]
    key = ",".join(reversed(host.split("."))) + ")" + (rest[cut_at:] or "/")
    return key.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}')}>",
            f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha256:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To-Page-ID: {refers_to}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return _member("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n")


def _parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers of the record, length of the full payload, and the payload itself (empty for revisits)."""
    raw = zlib.decompress(data, 31)
    end = raw.index(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in raw[:end].decode("utf-8").split("\r\n")[1:])
    body = raw[end + 4:end + 4 + int(headers["Content-Length"])]
    end = body.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in body[:end].decode().split("\r\n")[1:])
    return headers, int(http["Content-Length"]), body[end + 4:]


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        archive, rows, lines, at, index_at = uuid.uuid4().hex, [], [], 0, 0
        out = index = None

        def block():
            nonlocal index_at, lines
            data = _member("\n".join(lines).encode())
            index.write(data)
            rows.append((archive, lines[0].split("\t")[0], lines[-1].split("\t")[0], index_at, len(data), len(lines)))
            index_at, lines = index_at + len(data), []

        for batch in batches:
            for key, page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out, index = (store.open_output_stream(f"{base}/{archive}.{x}", compression=None) for x in ("warc.gz", "cdx.gz"))
                data = _record(page_id, url, (html or "").encode("utf-8"), digest, refers_to)
                out.write(data)
                lines.append(f"{key}\t{at}\t{len(data)}")
                at += len(data)
                if len(lines) == BLOCK_LINES:
                    block()
        if out is not None:
            if lines:
                block()
            out.close()
            index.close()
        columns = list(zip(*rows)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 3)],
                                         names=["archive", "first_key", "last_key", "offset", "length", "n_lines"])

    return run


def write_archives(pages: DataFrame, folder: str, *, least: int = LEAST_PAYLOAD, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives and index below folder (a URI); returns the block directory."""
    small_batches(pages.sparkSession, 128)
    p = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.coalesce("html", F.lit("")))
    size, digest = F.octet_length("html"), F.sha2(F.col("html").cast("binary"), 256)
    firsts = p.where((size >= least) & F.col("page_id").isNotNull()).groupBy(digest.alias("digest")).agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # Only payloads that repeat come out of the first pass; the join back is by digest and Spark splits hot ones.
    firsts = cut(firsts)
    p = p.withColumn("digest", digest).join(firsts, "digest", "left")
    refers = F.when((F.col("first") < F.col("page_id")) & (size >= least), F.col("first"))
    p = p.select(_key_column()(F.col("url")).alias("key"), "page_id", "url", "html", "digest", refers.alias("refers_to"))
    ordered = p.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return cut(ordered.mapInArrow(_writer(folder), _DIRECTORY))


def _key_column():
    @F.pandas_udf("string")
    def keys(urls: pd.Series) -> pd.Series:
        return urls.map(url_key)

    return keys


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    columns = list(zip(*found)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[
        "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def _read_record(archive, offset: int, length: int) -> tuple:
    archive.seek(offset)
    headers, size, payload = _parse(archive.read(length))
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
    number = lambda x: int(x) if x else None
    return (number(headers["WARC-Page-ID"]), headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"],
            number(headers.get("WARC-Refers-To-Page-ID")))


def read_archives(directory: DataFrame, folder: str) -> DataFrame:
    """Every record, read block by block of the index and checked against its digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, offset, length in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                with store.open_input_file(f"{base}/{name}.cdx.gz") as index, store.open_input_file(f"{base}/{name}.warc.gz") as archive:
                    index.seek(offset)
                    lines = [x.split("\t") for x in zlib.decompress(index.read(length), 31).decode().split("\n")]
                    yield _rows([_read_record(archive, int(at), int(n)) for _, at, n in lines])

    blocks = directory.select("archive", "offset", "length")
    # The directory is tiny whatever its archives weigh, so tasks are as many as its blocks ask for.
    tasks = max(1, -(-directory.count() // BLOCKS_A_TASK))
    return blocks.repartition(tasks, "archive", "offset").mapInArrow(run, _RECORD)


def lookup(directory: DataFrame, folder: str, urls: DataFrame, *, url_col: str = "url") -> DataFrame:
    """Captures of the given urls: file and block by binary search, then two range reads.

    The driver holds one row per archive file; block rows meet the urls in a join by file.
    """
    files = [(r["archive"], r["a"], r["z"]) for r in directory.groupBy("archive").agg(
        F.min("first_key").alias("a"), F.max("last_key").alias("z")).orderBy("a", "z").collect()]
    blocks = directory.groupBy("archive").agg(F.array_sort(F.collect_list(
        F.struct("first_key", "last_key", "offset", "length"))).alias("blocks"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = [a for _, a, _ in files]
        for batch in batches:
            out = []
            for url in batch.column(0).to_pylist():
                key = url_key(url)
                # Captures of one key may run over the end of a file.
                i = bisect_right(starts, key) - 1
                while i >= 0 and files[i][2] >= key:
                    out.append((url, key, files[i][0]))
                    i -= 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in list(zip(*out)) or [[]] * 3],
                                             names=["url", "key", "archive"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for url, key, name, rows in zip(*(c.to_pylist() for c in batch.columns)):
                found = []
                i = bisect_right([b["first_key"] for b in rows], key) - 1
                with store.open_input_file(f"{base}/{name}.cdx.gz") as index, store.open_input_file(f"{base}/{name}.warc.gz") as archive:
                    while i >= 0 and rows[i]["last_key"] >= key:
                        index.seek(rows[i]["offset"])
                        for line in zlib.decompress(index.read(rows[i]["length"]), 31).decode().split("\n"):
                            k, at, n = line.split("\t")
                            if k == key:
                                found.append(_read_record(archive, int(at), int(n)))
                        i -= 1
                yield _rows(found)

    placed = urls.select(F.col(url_col).alias("url")).distinct().mapInArrow(place, "url string, key string, archive string")
    return placed.join(blocks, "archive").select("url", "key", "archive", "blocks").mapInArrow(fetch, _RECORD)


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back through the index."""
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, **how), folder)

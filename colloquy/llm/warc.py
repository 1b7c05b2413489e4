"""WARC archives: monolithic writing, normalising to one gzip member a record, indexed reading.

Writing and normalising stream: no payload, file or group is ever held as a
whole beyond one record's payload, and a task writes one file. File names are
unique for each task attempt and only the files that a finished task reported
count, so repeated or lost tasks leave at most unused files.

Defined results: a null payload is the empty payload; a null ``page_id`` is
written as ``null`` and counts as smaller than any number; rows that repeat the
largest ``page_id`` of a group of equal payloads are all responses (their ids
are equal, so no other answer is consistent); an empty table gives no archives
and no rows; other columns of the pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import all_salts, dealt_salt, filesystem, fresh_path, ship, written

#: Ways in which the rows of one payload are dealt out before they meet their group's decision.
SALTS = 16
CHUNK = 1 << 18
#: The most that a string column can hold: no header of ours is longer, and a file without headers is refused.
HEADER_LIMIT = 1 << 31
#: zlib window bits for gzip framing.
GZIP = 31
WRITTEN = "path string, records long"
INDEXED = "path string, index_path string, records long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, path string, offset long, length long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    tail = (name or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def decided(pages: DataFrame, min_bytes: int, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is set where the record is a revisit.

    Digests are counted before anything is joined, only repeated digests come
    back, and each meets its rows under a salt, so a payload that a third of all
    pages share is spread over ``SALTS`` tasks.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("html"))
    p = p.withColumn("digest", F.sha1(F.col("html"))).withColumn("big", F.octet_length("html") >= min_bytes)
    groups = p.where("big").groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("digest", "first_id", F.lit(True).alias("big"), all_salts(SALTS).alias("salt"))
    p = p.withColumn("salt", dealt_salt(SALTS)).join(groups, ["digest", "big", "salt"], "left")
    revisit: Column = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return p.select("page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("refers_to"))


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(c for c in url or "" if c >= " "),
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write decided pages as one gzip stream a file; returns (path, records)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        name, n, sink, gz = f"{uuid.uuid4().hex}.mono.warc.gz", 0, None, zlib.compressobj(level, zlib.DEFLATED, GZIP)
        for b in batches:
            if not b.num_rows:
                continue
            if sink is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{root}/{name}", compression=None)
            for row in zip(*(b.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                page_id, url, html, refers = (v.as_py() for v in row)
                sink.write(gz.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers)))
                n += 1
        if sink is not None:
            sink.write(gz.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([n], pa.int64())})

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(task, WRITTEN)


class _Inflated:
    """Sequential reader of a gzip file of any number of members, inflated once."""

    def __init__(self, source):
        self.source, self.gz, self.have = source, zlib.decompressobj(GZIP), bytearray()

    def _more(self) -> bool:
        raw = self.gz.unused_data if self.gz.eof else b""
        if self.gz.eof:
            raw = raw or self.source.read(CHUNK)
            if not raw:
                return False
            self.gz = zlib.decompressobj(GZIP)
        else:
            raw = self.gz.unconsumed_tail or self.source.read(CHUNK)
            if not raw:
                raise EOFError("gzip stream ends early")
        self.have += self.gz.decompress(raw, CHUNK)
        return True

    def header(self) -> bytes | None:
        """Up to and with the empty line; None at the end of the file."""
        at = 0
        while True:
            found = self.have.find(b"\r\n\r\n", at)
            if found >= 0:
                out = bytes(self.have[: found + 4])
                del self.have[: found + 4]
                return out
            if len(self.have) > HEADER_LIMIT:
                raise ValueError("WARC header too long")
            at = max(0, len(self.have) - 3)
            if not self._more():
                if self.have.strip():
                    raise EOFError("WARC record ends early")
                return None

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.have and not self._more():
                raise EOFError("WARC record ends early")
            part = bytes(self.have[:n])
            del self.have[:n]
            n -= len(part)
            if part:
                yield part


def fields(header: bytes) -> dict[str, str]:
    pairs = (x.partition(":") for x in header.decode("utf-8", "replace").split("\r\n")[1:] if x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def normalise_file(path: str, level: int = 1) -> tuple[str, str, int]:
    """Rewrite one archive with a gzip member for each record, and its sidecar index.

    Each index line is JSON: offset and length of the member, id and type.
    """
    fs, src = filesystem(path)
    stem, made = path.removesuffix(".mono.warc.gz"), uuid.uuid4().hex[:8]
    out, idx, n, offset = f"{stem}-{made}.warc.gz", f"{stem}-{made}.idx", 0, 0
    with fs.open_input_stream(src, compression=None) as f, fs.open_output_stream(filesystem(out)[1], compression=None) as w, fs.open_output_stream(filesystem(idx)[1], compression=None) as x:
        stream = _Inflated(f)
        while (head := stream.header()) is not None:
            h, gz, size = fields(head), zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
            for part in chain([head], stream.take(int(h["content-length"]) + 4), [None]):
                packed = gz.flush() if part is None else gz.compress(part)
                w.write(packed)
                size += len(packed)
            x.write((json.dumps({"offset": offset, "length": size, "id": h["warc-record-id"], "type": h["warc-type"]}) + "\n").encode())
            offset, n = offset + size, n + 1
    return out, idx, n


def normalise(archives: DataFrame, level: int = 1) -> DataFrame:
    """(path, index_path, records) of the normalised archives; one task an archive."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "index_path", "records"), normalise_file(path, level), strict=True))])

    return archives.select("path").mapInArrow(task, INDEXED)


def read_record(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the record in the member at ``offset``."""
    f.seek(offset)
    raw = zlib.decompress(f.read(length), GZIP)
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = fields(head)
    return h, rest[: int(h["content-length"])]


def read_indexed(archives: DataFrame) -> DataFrame:
    """A row for each record, by the sidecar index; digests of full payloads are computed anew."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index in zip(b.column("path").to_pylist(), b.column("index_path").to_pylist(), strict=True):
                fs, at = filesystem(path)
                rows = []
                with fs.open_input_file(at) as f, fs.open_input_stream(filesystem(index)[1], compression=None) as x:
                    for line in _lines(x):
                        i = json.loads(line)
                        h, block = read_record(f, i["offset"], i["length"])
                        payload = block.partition(b"\r\n\r\n")[2]
                        whole = h["warc-type"] == "response"
                        digest, size = (payload_digest(payload), len(payload)) if whole else (h["warc-payload-digest"].partition(":")[2], int(h["x-payload-length"]))
                        if whole and h["warc-payload-digest"] != f"sha1:{digest}":
                            raise ValueError(f"digest differs at {path}:{i['offset']}")
                        rows.append((page_of(h["warc-record-id"]), size, digest, h["warc-type"], page_of(h.get("warc-refers-to")), path, i["offset"], i["length"]))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return archives.select("path", "index_path").mapInArrow(task, RECORD)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    while chunk := stream.read(CHUNK):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def one_each(files: DataFrame) -> DataFrame:
    """Deal the rows of a small table of files out, one to a task."""
    n = max(1, files.count())
    return files.repartition(n, "path") if n == 1 else files.repartitionByRange(n, "path")


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, level: int = 1) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise them, and return (path, index_path, records)."""
    spark = pages.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "warc")
    mono = written(write_monolithic(decided(pages, min_bytes), folder, level), "warc-mono")
    return written(normalise(one_each(mono), level), "warc-files")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    from colloquy.llm.common import table

    files = archive_pages(table(spark, sf_dir, "pages"))
    return read_indexed(one_each(files)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, unhex(sha1(body))::BIT::VARCHAR AS bits FROM p),
e AS (SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
     + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::INT, 1)), 'string_agg', '') AS payload_digest FROM d),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM e)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM g
"""

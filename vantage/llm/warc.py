"""WARC archives: writing, the normaliser of monolithic gzip files, and reading by offset.

``write_monolithic`` writes each task's records as one gzip stream, all as responses. ``normalise`` inflates such a
stream once, front to back, writes every record as a gzip member of its own, those that repeat another's payload as
revisits, and writes a sidecar index with a JSON line for each record: offset, length, type, id, digest, target URI.
``read_indexed`` seeks to each member by the index and parses it alone. The normaliser passes bytes on in chunks of
``CHUNK``; writer and reader hold one record. Pages aren't shuffled: which records repeat is found from narrow rows.

Equal payloads of at least ``least`` bytes are stored once: by the record of the smallest page_id (of equal ids, the
smallest url; of rows equal in both, any one); all others become revisit records that refer to it. Null html is an
empty payload; a null url has no target URI; a null page_id is never referred to (if a payload has only null page_ids,
all of its records are responses). Other columns are ignored. An empty table gives no archive and no row.
The normalised files are listed in a Parquet table ``manifest`` beside them, never in the driver.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.common import discard, file_system, fresh_path, map_batches, remove, shuffle_partitions, written

CHUNK, ARCHIVE = 1 << 20, 64 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id} {url}'.encode('utf-8', 'surrogatepass')).hexdigest())}>"


def _uri(url: str) -> str:
    """A URL fit for a header line: control characters, spaces and % before them are escaped."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


def _head(kind: str, own_id: str, uri: str | None, digest: str, page_id: int | str | None, length: int, refers: tuple[int, str | None] | None = None) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {uri}")
    head.append(f"WARC-Payload-Digest: {digest}")
    if refers is not None:
        head += [f"WARC-Refers-To: {record_id(*refers)}", f"WARC-Profile: {REVISIT}", f"X-Refers-To-Page: {refers[0]}"]
    if page_id is not None:
        head.append(f"X-Page: {page_id}")
    return "\r\n".join([*head, "Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]).encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str | None = None) -> bytes:
    """One response record with its closing blank lines."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = None if url is None else _uri(url)
    head = _head("response", record_id(page_id, url), uri, f"sha1:{digest or payload_digest(payload)}", page_id, len(http) + len(payload))
    return head + http + payload + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; the first line must name a WARC version."""
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file, of one member or more, in order and in bounded chunks."""
    z, fed = zlib.decompressobj(31), False
    while chunk := source.read(CHUNK):
        while chunk:
            fed = True
            if out := z.decompress(chunk, CHUNK):
                yield out
            chunk = z.unconsumed_tail
            if z.eof:
                chunk, z, fed = z.unused_data, zlib.decompressobj(31), False
    while fed and not z.eof:  # what a full output chunk has left inside
        out = z.decompress(b"", CHUNK)
        if not out:
            raise ValueError("the gzip stream is cut off")
        yield out


class _Held:
    """What a stream has given and a reader hasn't used: used bytes are passed by an offset, not cut off one by one."""

    def __init__(self, stream: Iterator[bytes]) -> None:
        self.stream, self.data, self.at = stream, b"", 0

    def more(self) -> bool:
        got = next(self.stream, b"")
        if got:
            self.data, self.at = self.data[self.at :] + got, 0
        return bool(got)

    def skip_blank(self) -> bool:
        """Pass line ends; whether anything follows."""
        while True:
            while self.at < len(self.data) and self.data[self.at] in b"\r\n":
                self.at += 1
            if self.at < len(self.data):
                return True
            if not self.more():
                return False

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to and with ``mark``."""
        looked = self.at
        while (end := self.data.find(mark, looked)) < 0:
            looked = max(0, len(self.data) - self.at - len(mark) + 1)
            if not self.more():
                return None
        found = self.data[self.at : end + len(mark)]
        self.at = end + len(mark)
        return found

    def take(self, most: int) -> bytes:
        """Some of the next bytes, at most ``most``; none at the end."""
        if self.at == len(self.data) and not self.more():
            return b""
        part = self.data[self.at : self.at + most]
        self.at += len(part)
        return part


def _records(stream: Iterator[bytes]) -> Iterator[tuple[bytes, Iterator[bytes]]]:
    """Each record's head, and its body in chunks, which must be used up before the next."""
    held = _Held(stream)

    def body(left: int) -> Iterator[bytes]:
        while left:
            part = held.take(left)
            if not part:
                raise ValueError("a record's body is cut off")
            left -= len(part)
            yield part

    while held.skip_blank():
        head = held.until(b"\r\n\r\n")
        if head is None:
            raise ValueError("a record's head is cut off")
        rest = body(int(parse_head(head)["content-length"]))
        yield head, rest
        for _ in rest:
            pass


def _http_head(body: Iterator[bytes]) -> bytes:
    """The HTTP header of a record's body, with its blank line."""
    held = b""
    for part in body:
        held += part
        if (end := held.find(b"\r\n\r\n")) >= 0:
            return held[: end + 4]
    raise ValueError("a record has no HTTP header")


def normalise(source: BinaryIO, target: BinaryIO, index: BinaryIO, revisits: dict[int, tuple[int, str | None]] | None = None) -> int:
    """Rewrite a gzip file of WARC records with a member for each record, and index them; returns their number.

    ``revisits`` gives, by place in the file from 0, the records to store as revisits, with the page_id and url they refer to.
    """
    at = n = 0
    for head, body in _records(inflated(source)):
        fields = parse_head(head)
        if revisits and n in revisits:
            http = _http_head(body)
            head, body = _head("revisit", fields["warc-record-id"], fields.get("warc-target-uri"), fields["warc-payload-digest"], fields.get("x-page"), len(http), revisits[n]), iter([http])
            fields = parse_head(head)
        z, size = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0
        for part in chain([head], body, [b"\r\n\r\n", None]):  # None: the member ends
            data = z.flush() if part is None else z.compress(part)
            target.write(data)
            size += len(data)
        index.write(json.dumps({"offset": at, "length": size, "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "digest": fields.get("warc-payload-digest"), "uri": fields.get("warc-target-uri")}, ensure_ascii=False).encode("utf-8", "surrogatepass") + b"\n")
        at, n = at + size, n + 1
    return n


def write_monolithic(pages: DataFrame, path: str) -> DataFrame:
    """Write a response for each row of (page_id, url, html) where it is read; pages aren't shuffled.

    Returns a row for each record: name, place (in its file, from 0), page_id, url, digest, payload_bytes.
    """
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    schema = "name string, place long, page_id long, url string, digest string, payload_bytes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = file_system(path)
        out = z = name = None
        size = place = 0
        for b in batches:
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    name, size, place, z = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    out = own.open_output_stream(name, compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                data = record(page_id, url, payload, digest)
                out.write(z.compress(data))
                rows.append((name, place, page_id, url, digest, len(payload)))
                size, place = size + len(data), place + 1
                if size > ARCHIVE:
                    out.write(z.flush())
                    out.close()
                    out = None
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["name", "place", "page_id", "url", "digest", "payload_bytes"])
        if out is not None:
            out.write(z.flush())
            out.close()

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return written(map_batches(own, run, schema), "warc-records")


def revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """(name, revisits): the files, each with the places of its records that revisit another, and what they refer to.

    Narrow rows alone are joined; a file's list is as long as an archive has records.
    """
    key = F.struct("page_id", "url", "name", "place")  # of equal rows one alone is the first
    first = records.where("page_id is not null").groupBy("digest").agg(F.min(key).alias("first"))
    joined = records.join(first, "digest")
    same = (F.col("name") == F.col("first.name")) & (F.col("place") == F.col("first.place"))
    again = joined.where(~same & (F.col("payload_bytes") >= least)).select("name", F.struct("place", F.col("first.page_id").alias("to"), F.col("first.url").alias("to_url")).alias("r"))
    return records.select("name").distinct().join(again.groupBy("name").agg(F.collect_list("r").alias("revisits")), "name", "left")


def normalise_all(files: DataFrame, path: str) -> None:
    """Normalise the files of ``revisits`` into the folder ``path``: each with its index (.idx) beside it, all listed in ``manifest``."""
    spark = files.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, base = file_system(path)
        for b in batches:
            for name, again in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                made = f"{base}/{uuid.uuid4().hex}.warc.gz"
                with own.open_input_stream(name, compression=None) as source, own.open_output_stream(made, compression=None) as target, own.open_output_stream(f"{made}.idx", compression=None) as index:
                    normalise(source, target, index, {r["place"]: (r["to"], r["to_url"]) for r in again or []})
                yield pa.RecordBatch.from_arrays([pa.array([made])], ["made"])

    files = written(files, "warc-files")
    dealt = files.repartition(max(1, min(files.count(), 16 * shuffle_partitions(spark))))
    dealt.select("name", "revisits").mapInArrow(run, "made string").write.parquet(f"{path}/manifest")
    discard(files)


def read_indexed(spark, path: str) -> DataFrame:
    """A row for each record of a folder's normalised files: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    payload_bytes and payload_digest are those of the full payload; a revisit has no payload of its own. A response whose
    payload doesn't have the digest that its head states is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = file_system(path)
        fields = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], fields)

        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with own.open_input_stream(f"{name}.idx", compression=None) as f:
                    entries = [json.loads(x) for x in f.read().split(b"\n") if x]
                with own.open_input_file(name) as f:
                    for e in entries:
                        f.seek(e["offset"])
                        data = zlib.decompress(f.read(e["length"]), 31)
                        cut = data.index(b"\r\n\r\n") + 4
                        head = parse_head(data[:cut])
                        body = data[cut : cut + int(head["content-length"])]
                        http, _, payload = body.partition(b"\r\n\r\n")
                        full = int(http.lower().split(b"content-length:")[1].split(b"\r\n")[0])
                        digest = head["warc-payload-digest"].removeprefix("sha1:")
                        kind = head["warc-type"]
                        if kind == "response" and (len(payload) != full or payload_digest(payload) != digest):
                            raise ValueError(f"{name}: the record at {e['offset']} doesn't match its digest")
                        page, refers = head.get("x-page"), head.get("x-refers-to-page")
                        rows.append((page and int(page), head.get("warc-target-uri"), payload.decode("utf-8", "surrogatepass") if kind == "response" else None, full, digest, kind, refers and int(refers)))
                        size += len(data)
                        if size > 16 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)

    files = spark.read.schema("made string").parquet(f"{path}/manifest")
    schema = "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return files.repartition(max(1, min(files.count(), 16 * shuffle_partitions(spark)))).mapInArrow(run, schema)


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise these, and read the result by its indexes."""
    spark = pages.sparkSession
    whole, split = fresh_path(spark, "warc-whole"), fresh_path(spark, "warc")
    records = write_monolithic(pages, whole)
    fs, root = file_system(split)
    fs.create_dir(root, recursive=True)
    normalise_all(revisits(records, least), split)
    remove(spark, whole)  # the normalised files replace them
    discard(records)
    return read_indexed(spark, split)

"""WARC archives: writing, the monolithic gzip normaliser, and reading by offset index.

A writer that knows no record boundaries leaves one gzip stream a file, which
nothing can seek in. The normaliser inflates such a stream once, in pieces,
cuts it into records as they pass, writes each as a gzip member of its own and
notes the members' places in a sidecar index, one JSON line a record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrowio import slices
from tidemark.llm.files import each_item, open_fs, reading, writing
from tidemark.storage import new_path

CHUNK, PROFILE = 1 << 20, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A fixed date, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def make_record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit of another one with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The plain bytes of gzip data of one or many members, in pieces of CHUNK at most."""
    state = zlib.decompressobj(31)
    for data in chunks:
        while data:
            out = state.decompress(data, CHUNK)
            if out:
                yield out
            if state.eof:
                data = state.unused_data
                state = zlib.decompressobj(31)
            else:
                data = state.unconsumed_tail
    while out := state.decompress(state.unconsumed_tail, CHUNK):
        yield out
    if rest := state.flush():
        yield rest


class RecordStream:
    """Cuts a stream of plain WARC bytes into records; holds one head and one piece of a body."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.buffer = pieces, b""

    def _fill(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.buffer += piece
        return True

    def __iter__(self) -> Iterator[tuple[bytes, Iterator[bytes]]]:
        while True:
            while b"\r\n\r\n" not in self.buffer:
                if not self._fill():
                    if self.buffer.strip():
                        raise ValueError("the stream ends inside a record's head")
                    return
            head, self.buffer = self.buffer.split(b"\r\n\r\n", 1)
            left = int(parse_head(head)["content-length"]) + 4
            body = self._body(left)
            yield head + b"\r\n\r\n", body
            for _ in body:  # what the caller left
                pass

    def _body(self, left: int) -> Iterator[bytes]:
        while left:
            if not self.buffer and not self._fill():
                raise ValueError("the stream ends inside a record")
            part, self.buffer = self.buffer[:left], self.buffer[left:]
            left -= len(part)
            yield part


def _read_chunks(f) -> Iterator[bytes]:
    while data := f.read(CHUNK):
        yield data


def normalise(source: str, target: str, index: str, level: int = 6) -> int:
    """Rewrite source, gzip of any members, as target with one member a record, and write index; returns the number of records.

    One pass over the source; in memory are one head and one piece of a body.
    """
    n, at = 0, 0
    with reading(source) as f, writing(target) as out, writing(index) as side:
        for head, body in RecordStream(inflate(_read_chunks(f))):
            pack, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
            for b in (pack.compress(head), *map(pack.compress, body), pack.flush()):
                out.write(b)
                size += len(b)
            fields = parse_head(head)
            line = {"offset": at, "length": size, "id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")}
            side.write(json.dumps(line).encode() + b"\n")
            n, at = n + 1, at + size
    return n


def read_record(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """The fields and the block of the member at offset."""
    f.seek(offset)
    plain = zlib.decompress(f.read(length), 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = parse_head(head)
    return fields, rest[: int(fields["content-length"])]


def first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the smallest page_id with an equal payload of least_bytes or more, null on that record itself.

    Digests are counted before their shuffle. Pages then meet the repeated
    digests, one row each, in an equi-join whose common digests AQE splits.
    """
    digests = pages.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.max("payload_bytes").alias("size"))
    many = digests.where((F.col("n") > 1) & (F.col("size") >= least_bytes) & F.col("first").isNotNull()).select("digest", "first")
    return pages.join(many, "digest", "left").withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def write_monolithic(records: DataFrame, folder: str) -> list[str]:
    """One gzip stream of records a partition, below folder, a URI; returns the files' URIs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"

        def rest():
            yield batch
            yield from batches

        with writing(path) as out:
            pack = zlib.compressobj(1, zlib.DEFLATED, 31)
            for page_ids, urls, payloads, digests, refers in slices(rest()):
                for row in zip(page_ids, urls, payloads, digests, refers):
                    out.write(pack.compress(make_record(*row)))
            out.write(pack.flush())
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    rows = records.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("payload").cast("binary"), "digest", F.col("refers_to").cast("long"))
    return sorted(r.path for r in rows.mapInArrow(run, "path string").collect())


def normalise_all(spark, paths: list[str], folder: str) -> list[tuple[str, str]]:
    """Normalise each file in a task of its own and delete it then; returns (archive, index) URIs.

    A task that is repeated after its file has gone finds the whole archive
    and index, which take their names last.
    """
    def run(path: str) -> Iterator[pa.RecordBatch]:
        target = f"{folder}/{path.rpartition('/')[2]}"
        system, own = open_fs(path)
        if system.get_file_info(own).type.name != "NotFound":
            normalise(path, target, f"{target}.idx")
            system.delete_file(own)
        yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([f"{target}.idx"])], names=["archive", "index"])

    return sorted((r.archive, r["index"]) for r in each_item(spark, paths, run, "archive string, index string").collect())


def read_archives(spark, files: list[tuple[str, str]]) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, each sought by its index line.

    A response's digest and size are taken from its payload and must be those
    of its head; a revisit has no payload here, so its head's are given.
    """
    def number(x: str | None) -> int | None:
        x = (x or "").removeprefix("<urn:page:").removesuffix(">")
        return None if x in ("", "null") else int(x)

    def run(item: tuple[str, str]) -> Iterator[pa.RecordBatch]:
        archive, index = item
        rows = []
        with reading(index) as side, reading(archive) as f:
            lines, tail = _read_chunks(side), b""
            for data in lines:
                *whole, tail = (tail + data).split(b"\n")
                for line in whole:
                    at = json.loads(line)
                    fields, block = read_record(f, at["offset"], at["length"])
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
                        raise ValueError(f"{archive}: the payload at {at['offset']} is not what its head says")
                    rows.append((number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields.get("warc-refers-to"))))
                if len(rows) > 5000:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return each_item(spark, files, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> list[tuple[str, str]]:
    """Write pages as WARC files in the shared folder, normalise them, and return (archive, index) URIs.

    A null html is an empty payload, a null url an empty one. A null id is
    kept and never referred to. Rows that repeat the smallest id and its
    payload are responses too. Other columns are ignored. An empty table
    writes nothing.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [payload_digest(memoryview(x.as_buffer())) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array([len(x.as_buffer()) for x in batch.column(2)], pa.int64())], names=["page_id", "url", "payload", "digest", "payload_bytes"])

    found = rows.mapInArrow(digests, "page_id long, url string, payload binary, digest string, payload_bytes long")
    linked = first_pages(found, least_bytes)
    folder = new_path(spark, "warc")
    paths = write_monolithic(linked, f"{folder}/monolithic")
    return normalise_all(spark, paths, f"{folder}/members") if paths else []


def op10_warc(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read back from the archives."""
    return read_archives(pages.sparkSession, archive_pages(pages))

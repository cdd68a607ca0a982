"""WARC archives: written as whole-file gzip streams, normalised to one member per record.

``write_archives`` writes the records of each task into archives of bounded size, each one
monolithic gzip stream. ``normalise`` inflates such a stream once, from front to back, and
rewrites every record as a gzip member of its own, with a sidecar index of offsets beside
it. ``read_records`` then opens any record by seeking to its offset.

Files are named by the run that wrote them and listed in tables that Spark commits, so a
task that is repeated after a lost executor leaves nothing in the lists but its own files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import integer_ids, map_batches, pieces
from quarry.storage import Scratch, join_groups, key_filter, may_be_in

#: Bytes of records in an archive, about; a larger record has one of its own.
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
ID = "urn:x-page:"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder's URI, as executors and the driver see it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, name: str, uri: str, size: int, digest: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response, or a revisit without its payload; both hold the payload's HTTP header."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Records:
    """Cuts a stream of bytes into records; ``feed`` gives (header fields, whole record)."""

    def __init__(self, source: str):
        self.source, self.held, self.need, self.fields = source, bytearray(), None, {}

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += data
        at = 0
        while True:
            if self.need is None:
                end = self.held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                lines = bytes(self.held[at:end]).decode("utf-8", "replace").split("\r\n")
                self.fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
                if not lines[0].startswith("WARC/") or not self.fields.get("content-length", "").isdigit():
                    raise ValueError(f"{self.source}: no WARC record where one should begin")
                self.need = end + 4 - at + int(self.fields["content-length"]) + 4
            if len(self.held) - at < self.need:
                break
            yield self.fields, bytes(self.held[at : at + self.need])
            at, self.need = at + self.need, None
        del self.held[:at]

    def close(self) -> None:
        if self.held:
            raise ValueError(f"{self.source}: the last record is cut off")


def inflate(stream, source: str) -> Iterator[bytes]:
    """The bytes of a gzip file of one member or many, a chunk at a time."""
    engine, begun = zlib.decompressobj(31), False
    while data := stream.read(CHUNK):
        while data:
            begun = True
            yield engine.decompress(data, CHUNK)
            data = engine.unconsumed_tail
            if engine.eof:
                data, engine, begun = engine.unused_data + data, zlib.decompressobj(31), False
    if begun:
        raise ValueError(f"{source}: the gzip stream is cut off")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes (id, url, payload binary, digest, refers_to, revisit) as archives; one row (archive, records) per file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        system.create_dir(path, recursive=True)
        out, name, size, count = None, "", 0, 0

        def finish():
            out.write(engine.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["archive", "records"])

        for batch, payloads in pieces(batches, "payload"):
            columns = [batch.column(c).to_pylist() for c in ("id", "url", "digest", "refers_to", "revisit")]
            for number, url, digest, refers_to, revisit, payload in zip(*columns, payloads):
                if out is not None and size >= ARCHIVE_BYTES:
                    yield finish()
                    out = None
                if out is None:
                    name, size, count = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, engine = system.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                uri = quote(url or "", safe="!#$%&'()*+,-./:;=?@[]_~")
                made = record("revisit" if revisit else "response", "" if number is None else str(number), uri, len(payload), digest, b"" if revisit else payload, ("" if refers_to is None else str(refers_to)) if revisit else None)
                out.write(engine.compress(made))
                size, count = size + len(made), count + 1
        if out is not None:
            yield finish()

    return map_batches(records, run, "archive string, records long")


def normalise(archives: DataFrame, folder: str, to: str) -> DataFrame:
    """Rewrites each archive of ``folder`` record by record into ``to``: (archive, position, offset, length).

    The same index stands beside every new archive, as JSON lines in ``.idx``.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (system, path), (target, target_path) = open_folder(folder), open_folder(to)
        target.create_dir(target_path, recursive=True)
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                name, index, offset = f"{uuid.uuid4().hex}.warc.gz", [], 0
                reader = Records(archive)
                with system.open_input_stream(f"{path}/{archive}", compression=None) as source, target.open_output_stream(f"{target_path}/{name}", compression=None) as out:
                    for data in inflate(source, archive):
                        for fields, whole in reader.feed(data):
                            engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                            member = engine.compress(whole) + engine.flush()
                            out.write(member)
                            index.append({"offset": offset, "length": len(member), "type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest")})
                            offset += len(member)
                    reader.close()
                with target.open_output_stream(f"{target_path}/{name}.idx", compression=None) as side:
                    side.write("".join(json.dumps(line) + "\n" for line in index).encode())
                n = len(index)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int64()), *(pa.array([i[k] for i in index], pa.int64()) for k in ("offset", "length"))], names=["archive", "position", "offset", "length"])

    return map_batches(archives.select("archive"), run, "archive string, position long, offset long, length long")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Reads each indexed record by its offset: (type, id, uri, payload_bytes, payload_digest, refers_to, payload binary).

    The digest of a response is taken from its payload as read; a revisit has no payload,
    and its size and digest are those its headers name.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        opened, source = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))))
            for at in range(0, len(rows), 64):
                out = []
                for archive, offset, length in rows[at : at + 64]:
                    if archive != opened:
                        if source is not None:
                            source.close()
                        opened, source = archive, system.open_input_file(f"{path}/{archive}")
                    source.seek(offset)
                    whole = zlib.decompress(source.read(length), 31)
                    ((fields, _),) = Records(archive).feed(whole)
                    block = whole[whole.index(b"\r\n\r\n") + 4 : -4]
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind, name, refers = fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to")
                    if kind == "response":
                        size, digest = len(payload), base32_sha1(payload)
                    else:
                        size = next(int(line.partition(b":")[2]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                        digest, payload = fields["warc-payload-digest"].removeprefix("sha1:"), None
                    bare = [x and x.strip("<>").removeprefix(ID) for x in (name, refers)]
                    out.append((kind, bare[0], fields.get("warc-target-uri"), size, digest, bare[1], payload))
                types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=["type", "id", "uri", "payload_bytes", "payload_digest", "refers_to", "payload"])
        if source is not None:
            source.close()

    return map_batches(index, run, "type string, id string, uri string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 0) -> tuple[DataFrame, str]:
    """Archives a record per row of ``pages``; returns the index of the normalised archives and their folder.

    Of records with equal payloads of at least ``least_revisit`` bytes, that with the smallest
    id is a response and the others are revisits of it; smaller payloads are all responses.

    Null payloads are empty ones. Of rows with the same smallest id, all are responses. A
    null id is larger than any other; payloads that only null ids hold are all responses. An
    empty table gives no archive and an empty index; other columns are ignored. Ids are
    integers, since the smallest one is the response; another type raises TypeError. A very
    long payload is a record of its own size, held whole in one task.
    """
    integer_ids(pages, id_col)
    scratch = Scratch(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(pages[payload_col].cast("string"), F.lit("")), "utf-8")
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    first = pages.select(pages[id_col].cast("long").alias("id"), F.sha1(payload).alias("sha"), F.length(payload).alias("size"))
    first = first.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.min("size").alias("size"))
    # Only payloads that occur twice and may be revisited are looked up.
    first = scratch.keep(first.where((F.col("n") > 1) & (F.col("size") >= least_revisit) & F.col("first").isNotNull()).select("sha", "first"), "first")
    may = may_be_in(key_filter(first, "sha"), F.col("sha"))
    looked = join_groups(rows.where(may).select("sha", "id", "url", "payload"), first, "sha", "left").select("id", "url", "payload", "sha", "first")
    joined = looked.unionByName(rows.where(~may).withColumn("first", F.lit(None).cast("long")))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    out = joined.select("id", "url", "payload", _base32(F.col("sha")).alias("digest"), F.col("first").alias("refers_to"), revisit.alias("revisit"))
    raw, done = f"{scratch.root}/raw", f"{scratch.root}/normalised"
    archives = scratch.keep(write_archives(out, raw), "archives")
    n = max(1, archives.count())
    index = scratch.keep(normalise(archives.repartition(n), raw, done), "index")
    scratch.paths["raw"] = raw
    scratch.drop("raw", "archives")
    return index, done


def _base32(sha: Column) -> Column:
    """Base32 of a hex SHA-1: 160 bits are 32 digits of five."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = [F.conv(F.substring(sha, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    letters = [F.substring(F.lit(alphabet), F.call_function("shiftright", d, F.lit(15 - 5 * j)).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for d in digits for j in range(4)]
    return F.concat(*letters)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 0) -> DataFrame:
    """Archives ``pages``, reads the archives back: id, payload_bytes, payload_digest, record_type, refers_to per page."""
    index, folder = archive_pages(pages, id_col, url_col, payload_col, least_revisit)
    found = read_records(index, folder)
    number = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return found.select(number("id").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))

"""WARC archives: writing, a normaliser of whole-file gzip, and reading by index.

An archive compressed as one gzip stream can only be read from its start. The normaliser
inflates it once, a piece at a time, writes every record as a gzip member of its own and
beside it a sidecar with each member's offset and length, so that any task can read any record.

Archives are files in a folder that all executors share, opened through pyarrow's file
systems. A task writes under a name of its own attempt and moves the file when it is whole, so
a task that is lost or runs twice leaves the same archive.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.frames import fresh_path, settled, shuffle_partitions

_END = b"\r\n\r\n"
_CHUNK = 1 << 18
_MEMBER = 31  # zlib's window bits for a gzip member
INDEX = "path string, offset long, length long, record_id string, record_type string"


def _open(where: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(where)


class _Placed:
    """A file that appears under its name when it is whole."""

    def __init__(self, path: str):
        self.system, self.path = _open(path)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}"
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream, self.size = self.system.open_output_stream(self.temporary), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def place(self) -> None:
        self.stream.close()
        self.system.move(self.temporary, self.path)


def _header(fields: list[tuple[str, str | None]]) -> bytes:
    """Fields without value are left out; line ends within one would begin another and are written as %0D and %0A."""
    kept = (f"{k}: {v}".replace("\r", "%0D").replace("\n", "%0A") for k, v in fields if v is not None)
    return "\r\n".join(["WARC/1.1", *kept]).encode() + _END


def record(row: dict) -> tuple[bytes, bytes, bytes]:
    """Header, HTTP header and payload of a record; a revisit has no payload, but its length and digest."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    http = b"" if revisit else f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:x-record:{'' if row['id'] is None else row['id']}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", row["url"]),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"), ("X-Payload-Length", str(row["size"])),
        ("WARC-Refers-To", f"<urn:x-record:{row['refers_to']}>" if revisit else None), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(0 if revisit else len(http) + len(payload))),
    ]
    return _header(fields), http, b"" if revisit else payload


def _writing(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, packed, n = None, None, 0
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        for batch in batches:
            for i in range(batch.num_rows):
                if out is None:
                    out, packed = _Placed(path), zlib.compressobj(6, zlib.DEFLATED, _MEMBER)
                for part in record({name: batch.column(name)[i].as_py() for name in batch.schema.names}):
                    out.write(packed.compress(part))
                out.write(packed.compress(_END))
                n += 1
        if out:
            out.write(packed.flush())
            out.place()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64()), "bytes": pa.array([out.size], pa.int64())})

    return run


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """(path, records, bytes): one archive for each partition that has rows, compressed as a whole file.

    records: id, url, payload (binary), size, digest, record_type, refers_to. Null ids and urls
    are left out of the header; a null payload is an empty one. An empty table writes no file.
    """
    wanted = records.select("id", "url", "payload", "size", "digest", "record_type", "refers_to")
    return settled(wanted.mapInArrow(_writing(folder), "path string, records long, bytes long"))


class _Inflated:
    """The inflated bytes of a stream of one or more gzip members, in pieces."""

    def __init__(self, stream):
        self.stream, self.inflate, self.held, self.raw, self.begun = stream, zlib.decompressobj(_MEMBER), b"", b"", False

    def _more(self) -> bool:
        while True:
            raw = self.raw or self.stream.read(_CHUNK)
            self.raw = b""
            if not raw:
                if self.begun and not self.inflate.eof:
                    raise ValueError("the archive ends within a gzip member")
                return False
            if self.inflate.eof:
                self.inflate, self.begun = zlib.decompressobj(_MEMBER), False
            self.begun = True
            piece = self.inflate.decompress(raw, 4 * _CHUNK)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if piece:
                self.held += piece
                return True

    def until(self, end: bytes) -> bytes | None:
        """Up to and with `end`; None where nothing is left."""
        seen = 0
        while (at := self.held.find(end, seen)) < 0:
            seen = max(0, len(self.held) - len(end) + 1)
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends within a record's header")
                return None
        out, self.held = self.held[: at + len(end)], self.held[at + len(end) :]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next n bytes."""
        while n:
            if not self.held and not self._more():
                raise ValueError("the archive ends within a record")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def fields_of(header: bytes) -> dict[str, str]:
    first, *lines = header.decode().strip().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record begins here: {first[:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _bare(name: str | None) -> str | None:
    """A record id without <urn:x-record:...>."""
    return name.strip("<>").rpartition(":")[2] or None if name else None


def _normalising(folder: str):
    def one(source: str) -> dict:
        system, path = _open(source)
        target = f"{folder}/{path.rpartition('/')[2]}"
        out, index = _Placed(target), _Placed(target + ".idx.jsonl")
        n = 0
        with system.open_input_stream(path, compression=None) as stream:
            inflated = _Inflated(stream)
            while (header := inflated.until(_END)) is not None:
                fields, start, packed = fields_of(header), out.size, zlib.compressobj(6, zlib.DEFLATED, _MEMBER)
                out.write(packed.compress(header))
                for piece in inflated.pieces(int(fields["content-length"]) + len(_END)):
                    out.write(packed.compress(piece))
                out.write(packed.flush())
                index.write(json.dumps({"path": target, "offset": start, "length": out.size - start, "record_id": _bare(fields.get("warc-record-id")), "record_type": fields.get("warc-type")}).encode() + b"\n")
                n += 1
        out.place()
        index.place()
        return {"path": target, "records": n, "bytes": out.size}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist([one(source)], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return run


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """(path, records, bytes) of archives written anew below the folder, a member for each record, with a sidecar each.

    archives: path. Archives of one or of many members are read alike. A gzip stream can only be
    inflated from its start, so one archive is one task's work, in bounded memory however long
    its records are. A damaged archive is an error. The sidecar of x is x.idx.jsonl.
    """
    paths = archives.select("path")
    n = max(1, min(paths.count(), 4 * shuffle_partitions(archives.sparkSession)))
    return settled(paths.repartition(n, "path").mapInArrow(_normalising(folder), "path string, records long, bytes long"))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecars' rows: path, offset, length, record_id, record_type."""
    return spark.read.schema(INDEX).json(folder, pathGlobFilter="*.idx.jsonl")


def read_member(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record that is a whole gzip member."""
    header, _, rest = zlib.decompress(data, _MEMBER).partition(_END)
    fields = fields_of(header)
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(_END)[2] if block else b""


_READ = pa.schema([("id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def _reading(payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        schema = _READ if payload else pa.schema(list(_READ)[:-1])
        for batch in batches:
            rows = []
            for where, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if where != path:
                    system, place = _open(where)
                    path, file = where, system.open_input_file(place)
                file.seek(offset)
                fields, data = read_member(file.read(length))
                digest = fields["warc-payload-digest"].removeprefix("sha256:")
                kind, size = fields["warc-type"], int(fields["x-payload-length"])
                if kind == "response" and (len(data) != size or hashlib.sha256(data).hexdigest() != digest):
                    raise ValueError(f"{where}: the record at {offset} is not what was written")
                own, other = _bare(fields["warc-record-id"]), _bare(fields.get("warc-refers-to"))
                rows.append({"id": None if own is None else int(own), "record_type": kind, "refers_to": None if other is None else int(other), "payload_bytes": size, "payload_digest": digest} | ({"payload": data} if payload else {}))
                if len(rows) >= 500:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records that an index names, each read by itself: id, record_type, refers_to, payload_bytes, payload_digest, payload.

    Payloads of responses are held against their digests. Index rows are ranged by place, so
    that a task reads one stretch of a file.
    """
    kind = "id long, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload
    placed = index.select("path", "offset", "length").repartitionByRange(shuffle_partitions(index.sparkSession), "path", "offset").sortWithinPartitions("path", "offset")
    return placed.mapInArrow(_reading(payload), kind)


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """Records to write: of equal payloads of `least` bytes or more the smallest page_id is the response, the others revisit it.

    A null html is an empty payload, which is always a response, as are all shorter ones. Rows
    without page_id revisit where a row with one has their payload, and are responses otherwise;
    rows that share the smallest id are all responses.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"))
    first = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"))
    joined = rows.join(first, "digest", "left")
    again = F.coalesce((F.col("size") >= least) & F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first"))), F.lit(False))
    return joined.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", payload: bool = False) -> DataFrame:
    """Pages written as archives, normalised, and read back by their index. An empty table gives an empty result."""
    spark = pages.sparkSession
    raw, folder = fresh_path(spark, "warc-raw"), fresh_path(spark, "warc")
    written = write_archives(with_revisits(pages, page_id, url, html), raw)
    normalise(written, folder)
    if written.isEmpty():
        return read_records(spark.createDataFrame([], INDEX), payload)
    return read_records(read_index(spark, folder), payload)

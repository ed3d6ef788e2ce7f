"""WARC archives as a PySpark data source.

Writing: one record a page, each a gzip member of its own, in one file a task. Where a payload of at least min_bytes occurs
more than once, the record with the largest page_id is a response; others are revisits that refer to it. Payloads are never shuffled: digests, page_ids
and row numbers are; each task then finds what its own rows refer to, by row number, in the shared folder. So the input must yield the same rows in the
same partitions twice, which a file scan does; pass stable=False for anything else. The page_ids guard this. A member's
header carries its compressed length in an extra field, as gzip allows, so any gzip reader can read the file and
this one can step over a member.

Reading takes a file, a folder or a pattern of .warc and .warc.gz files, of any maker and with any record types; with a manifest, as write_warc leaves, only
the files that it names. The driver plans the files, in groups of a stated size; filters on record type, page_id, digest and URI are pushed
into the reader. Each record's headers are parsed first; its block is decoded only if the record
passes and the query asks for it (option payload). Otherwise a plain file is read on past it, a member with its length is stepped over, and any other member
is inflated and dropped some kilobytes at a time. A payload's digest is computed again when it is read; in files with a manifest, or with the option verify, a
difference is an error.

The payload is the body of an HTTP message, else the record's whole block. page_id and refers_to are those that write_warc put into its record ids, null in
other archives, where record_id and refers_to_id hold the names.

Defined cases: null html is an empty payload; null page_id is kept, and comes before all others; of equal payloads with the
same largest page_id all are responses; null url is an empty target; an empty table writes no file, and reading it gives no rows; other columns are not read;
a file cut off in a record, or with something else than a record, is an error.
"""

from __future__ import annotations

import base64
import fnmatch
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ._util import arrow_batches, materialize, scratch, table

SCHEMA = "record_type string, record_id string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, warc_date string, content_type string, refers_to_id string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HEAD = struct.Struct("<4sIBBHBBHI")  # gzip header with one extra field of four bytes: the member's whole length
PUSHED = ("record_type", "page_id", "payload_digest", "target_uri")


def filesystem(uri: str):
    """The file system of a path or URI, and the path in it."""
    import pyarrow.fs as fs

    if uri.startswith(("s3a:", "s3n:")):
        uri = "s3" + uri[3:]
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return HEAD.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 8, 78, 83, 4, HEAD.size + len(body) + 8) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str, payload: bytes, digest: str, response_id: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(response_id)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _writer(folder: str, plan: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        part, refers = TaskContext.get().partitionId(), {}
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        own = filesystem(plan)[1] + f"/part={part}"
        for f in system.get_file_info(fs.FileSelector(own, allow_not_found=True)):
            if f.path.endswith(".parquet"):
                t = pq.ParquetFile(system.open_input_file(f.path)).read(columns=["row", "page_id", "first"])
                refers.update(zip(t["row"].to_pylist(), zip(t["page_id"].to_pylist(), t["first"].to_pylist())))
        name, out, size, rows = None, None, 0, 0
        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"{path}/part-{uuid.uuid4().hex}.warc.gz"
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(name, compression=None)
                there, first = refers.pop(rows, (page_id, None))
                if there != page_id:
                    raise RuntimeError("the input's partitions changed between two passes; pass stable=False")
                clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                data = member(record(page_id, clean, html or b"", base32_sha1(html or b""), first, first is not None))
                out.write(data)
                size, rows = size + len(data), rows + 1
        if refers:
            raise RuntimeError("the input's partitions changed between two passes; pass stable=False")
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size]), pa.array([rows])], names=["file", "bytes", "records"])

    return run


def write_warc(pages: DataFrame, min_bytes: int = 0, stable: bool = True) -> str:
    """Writes the archives under the shared folder; the manifest names the files of the attempts that counted. Returns its folder."""
    spark = pages.sparkSession
    arrow_batches(spark, rows=500)
    folder, plan = scratch(spark, "warc"), scratch(spark, "warc-revisits")
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    if not stable:
        rows = materialize(rows, "warc-input")
    # some 40 bytes a page are shuffled, with map-side maxima, so that copies of one payload aren't gathered
    place = F.monotonically_increasing_id()  # the partition's number in the upper bits, the row's in the lower 33
    keyed = rows.select("page_id", F.unhex(F.sha1("html")).alias("digest"), F.length("html").alias("n"), place.alias("_at")).filter(F.col("n") >= min_bytes)
    copies = keyed.groupBy(F.col("digest").alias("_d")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1 AND first IS NOT NULL")
    refer = keyed.join(copies, F.col("digest") == F.col("_d")).filter(~F.col("page_id").eqNullSafe(F.col("first")))
    refer.select(F.shiftright("_at", 33).cast("int").alias("part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("row"), "page_id", "first").repartition("part").write.partitionBy("part").parquet(plan)
    rows.mapInArrow(_writer(folder, plan), "file string, bytes long, records long").write.parquet(folder + "/manifest")
    return folder


@dataclass
class Files(InputPartition):
    paths: Sequence[str]

    def __init__(self, paths: Sequence[str]):
        self.paths = paths


class Plain:
    """The bytes of a file, or of all its gzip members, in order; what is skipped isn't kept."""

    STEP = 1 << 16

    def __init__(self, f):
        self.f, self.size, self.held, self.raw, self.z = f, f.size(), b"", b"", None
        self.gzip = f.read(2) == b"\x1f\x8b"
        f.seek(0)

    def _more(self) -> bytes:
        """Some more bytes; none at the end."""
        if not self.gzip:
            return self.f.read(self.STEP)
        while True:
            if not self.raw:
                self.raw = self.f.read(self.STEP)
                if not self.raw:
                    if self.z is not None:
                        raise ValueError("the file ends within a gzip member")
                    return b""
            if self.z is None:
                self.z = zlib.decompressobj(31)
            data = self.z.decompress(self.raw, self.STEP)
            self.raw = self.z.unconsumed_tail
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, None
            if data:
                return data

    def until(self, mark: bytes, most: int) -> bytes | None:
        """All before the next mark, which is passed; None if it isn't within most bytes."""
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > most or not (data := self._more()):
                return None
            self.held += data
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, got = [self.held], len(self.held)
        while got < n:
            data = self._more()
            if not data:
                raise ValueError("the file ends within a record")
            parts.append(data)
            got += len(data)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        if n > len(self.held) and not self.gzip:
            at = self.f.tell() + n - len(self.held)
            if at > self.size:
                raise ValueError("the file ends within a record")
            self.f.seek(at)
            self.held = b""
            return
        while n > len(self.held):
            n -= len(self.held)
            self.held = self._more()
            if not self.held:
                raise ValueError("the file ends within a record")
        self.held = self.held[n:]

    def ended(self) -> bool:
        """Whether nothing but line ends follows, which are passed."""
        while not (rest := self.held.lstrip(b"\r\n")):
            if not (data := self._more()):
                return True
            self.held = data
        self.held = rest
        return False


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines belong to the one before."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.group, self.checks = int(options.get("partitionbytes", 16 << 20)), []
        self.verify = str(options.get("verify", "")).lower() == "true"

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in [(x,) for x in PUSHED]:
                self.checks.append((f.attribute[0], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def _files(self) -> list[tuple[str, int]]:
        """Paths and sizes: those of the manifest if there is one, else all archives below the folder, or those that the pattern names."""
        import pyarrow.dataset as ds
        import pyarrow.fs as fs

        system, path = filesystem(self.path)
        if system.get_file_info(path + "/manifest").type == fs.FileType.Directory:
            self.verify = True
            return [(f["file"], f["bytes"]) for f in ds.dataset(path + "/manifest", filesystem=system, format="parquet").to_table(columns=["file", "bytes"]).to_pylist()]
        if system.get_file_info(path).type == fs.FileType.File:
            return [(path, system.get_file_info(path).size)]
        pattern = any(c in path for c in "*?[")
        base = path[: min(path.find(c) for c in "*?[" if c in path)].rpartition("/")[0] if pattern else path
        found = system.get_file_info(fs.FileSelector(base or "/", recursive=True))
        return [(f.path, f.size) for f in found if f.type == fs.FileType.File and (fnmatch.fnmatch(f.path, path) if pattern else f.path.endswith((".warc", ".warc.gz")))]

    def partitions(self) -> list[Files]:
        out: list[Files] = []
        held, size = [], 0
        for path, bytes_ in sorted(self._files()):
            if held and size + bytes_ > self.group:
                out.append(Files(held))
                held, size = [], 0
            held, size = [*held, path], size + bytes_
        return out + [Files(held)] if held else out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)
        for path in partition.paths:
            with system.open_input_file(path) as f:
                rows, size = [], 0
                for row in self._records(f):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) == 2000 or size > 8 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
                if rows:
                    yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        fields = [x.split() for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    def _records(self, f) -> Iterator[tuple]:
        start = f.read(HEAD.size)
        f.seek(0)
        if len(start) == HEAD.size and start[:4] == b"\x1f\x8b\x08\x04" and HEAD.unpack(start)[5:8] == (78, 83, 4):
            yield from self._own(f)
            return
        stream = Plain(f)
        while not stream.ended():
            head = stream.until(b"\r\n\r\n", 1 << 20)
            if head is None or not head.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            fields = _fields(head)
            length = int(fields["content-length"])
            if (row := self._passes(fields)) is None:
                stream.skip(length)
                continue
            http, wanted = fields.get("content-type", "").startswith("application/http"), self.payload and row["record_type"] != "revisit"
            if wanted:
                block = stream.take(length)
            else:
                block = stream.take(min(length, 8192)) if http else b""
                while http and b"\r\n\r\n" not in block and len(block) < length:
                    block += stream.take(min(length - len(block), len(block)))
                stream.skip(length - len(block))
            yield self._row(fields, row, block, length, http, wanted)

    def _own(self, f) -> Iterator[tuple]:
        """Of a file whose members state their length: each is stepped over, and only as much inflated as is needed."""
        at, end = 0, f.size()
        buffer, base = b"", 0
        while at < end:
            if at + HEAD.size > base + len(buffer):
                f.seek(at)
                buffer, base = f.read(4 << 20), at
            length = HEAD.unpack_from(buffer, at - base)[-1]
            if at + length > base + len(buffer):
                f.seek(at)
                buffer, base = f.read(max(length, 4 << 20)), at
            data = memoryview(buffer)[at - base + HEAD.size : at - base + length - 8]
            z = zlib.decompressobj(-15)
            start, rest = z.decompress(data, 1024), z.unconsumed_tail
            while (cut := start.find(b"\r\n\r\n")) < 0 or start.find(b"\r\n\r\n", cut + 4) < 0:  # both the record's headers and HTTP's
                more = z.decompress(rest, 1024)
                if not more:
                    raise ValueError(f"no headers in the record at {at}")
                start, rest = start + more, z.unconsumed_tail
            fields = _fields(start[:cut])
            if (row := self._passes(fields)) is not None:
                wanted, size = self.payload and row["record_type"] != "revisit", int(fields["content-length"])
                block = start[cut + 4 :]
                if wanted:
                    block = (block + z.decompress(rest) + z.flush())[:size]
                    if len(block) != size:
                        raise ValueError(f"the record at {at} is cut off")
                yield self._row(fields, row, block, size, True, wanted)
            at += length

    def _passes(self, fields: dict[str, str]) -> dict | None:
        """The columns that can be filtered on, if the record passes."""
        digest = fields.get("warc-payload-digest") or ""
        row = {"record_type": fields.get("warc-type"), "page_id": _page(fields.get("warc-record-id")), "payload_digest": digest.removeprefix("sha1:") or None, "target_uri": fields.get("warc-target-uri")}
        return None if any(row[k] not in ok for k, ok in self.checks) else row

    def _row(self, fields: dict[str, str], row: dict, block: bytes, length: int, http: bool, wanted: bool) -> tuple:
        size, payload = length, block
        if http:
            cut = block.find(b"\r\n\r\n")
            body = cut + 4 if cut >= 0 else length
            size, payload = length - body, block[body:]
            stated = _fields(block[:body]).get("content-length", "")
            if row["record_type"] == "revisit" and stated.isdigit():
                size = int(stated)  # of the payload that it stands for
        if not wanted:
            payload = None
        elif self.verify and (row["payload_digest"] or "") and base32_sha1(payload) != row["payload_digest"]:
            raise ValueError(f"payload of {fields.get('warc-record-id')} doesn't match its digest")
        refers = fields.get("warc-refers-to")
        return (row["record_type"], fields.get("warc-record-id"), row["page_id"], row["target_uri"], row["payload_digest"], size, _page(refers), fields.get("warc-date"), fields.get("content-type"), refers, payload)


class WarcSource(DataSource):
    """spark.read.format("warc").option("path", folder); options payload (default true), verify and partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_warc(spark, write_warc(table(spark, sf_dir, "pages")))
    size = F.coalesce(F.length("payload").cast("long"), F.col("payload_bytes"))
    return rows.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")

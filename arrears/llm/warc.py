"""Legacy archive converter: ARC files to WARC files.

An ARC file opens with a version block that names its version (1 or 2) and
the fields of its header lines; every document follows as one header line,
whose last field is the document's length, and that many bytes. Version 1
lines have five fields, version 2 lines ten. The converter reads them by that
declared length and writes WARC/1.1 records with synthesised record ids,
dates, types and digests. Of records with equal payloads the one with the
largest key (then the last in the files) is the response; the others become
revisits that refer to it, if the payload has at least ``least`` bytes.

Work is by file. Scanning emits one narrow row per record; duplicates are
found on digests alone, and each file gets the list of its own revisits, so
payloads never move between tasks and a hot payload is only a hot digest,
which is combined before the shuffle and split by AQE. Files are streamed
record by record: memory holds one record. Output files have names of their
own per attempt, and only those in the written manifest count, so a lost
executor leaves no half file in the result. Files go to the shared folder
through pyarrow's file systems (file, hdfs, s3, gs, ...).

Records carry the key of their row in an ``X-Record-Key`` response header; in
archives without it the key is null and the last record is the response.

Defined results: a null payload is empty; a null key is least; repeated rows
are records of their own; white space and control characters in URLs are
percent-encoded, a null URL is ``-``. A malformed header line or a payload
that does not match its digest is an error that names the file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrears.llm.store import Scratch

ROLL = 16_000_000              # payload bytes after which a new file begins
LEVEL = 1
KEY = "X-Record-Key"
# fixed values: field names of the two ARC versions
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")

MANIFEST = "file string, n_records bigint"
RECORD = "file string, ord bigint, version int, key bigint, url string, date string, payload_bytes bigint, payload_digest string"
READ = ("file string, record_id string, record_type string, url string, date string, key bigint, payload_bytes bigint, "
        "payload_digest string, refers_to_id string, refers_to bigint")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Members:
    """A file of gzip members, one a record; moved to its place when whole."""

    def __init__(self, folder: str, suffix: str):
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.uri = f"{folder}/{self.name}"
        self.fs, self.path = open_fs(self.uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part", compression=None)
        self.n = self.size = 0

    def add(self, *parts: bytes) -> None:
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        for p in parts:
            self.out.write(z.compress(p))
            self.size += len(p)
        self.out.write(z.flush())
        self.n += 1

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


def stream(uri: str) -> io.BufferedReader:
    """The file's bytes, unpacked if they are gzip members."""
    fs, path = open_fs(uri)
    raw = io.BufferedReader(fs.open_input_stream(path, compression=None), 1 << 20)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


# --- ARC -----------------------------------------------------------------

def arc_line(version: int, url: str, date: str, ctype: str, name: str, offset: int, length: int) -> bytes:
    more = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {ctype}{more} {length}\n".encode()


def _write_arc(folder: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, version, done = None, 1, []
        for batch in batches:
            for key, url, body in zip(*(batch.column(c).to_pylist() for c in ("key", "url", "payload"))):
                if out is None or out.size >= ROLL:
                    if out:
                        out.close()
                        done.append((out.uri, out.n - 1))
                        version = 3 - version
                    out = Members(folder, f"-v{version}.arc.gz")
                    block = f"{version} 0 arrears\n{FIELDS[version]}\n".encode()
                    out.add(arc_line(version, f"filedesc://{out.name}", date, "text/plain", out.name, 0, len(block)), block, b"\n")
                    start = 0
                body = body or b""
                url = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "-"
                known = "" if key is None else f"{KEY}: {key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{known}\r\n".encode()
                line = arc_line(version, url, date, "text/html", out.name, start, len(head) + len(body))
                start += len(line) + len(head) + len(body) + 1
                out.add(line, head, body, b"\n")
        if out:
            out.close()
            done.append((out.uri, out.n - 1))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["file", "n_records"])
    return run


def write_arc(s: Scratch, rows: DataFrame, date: str = "20240101000000") -> DataFrame:
    """``rows`` (key, url, payload binary) as ARC files, by turns of version 1
    and 2; the manifest (file, n_records)."""
    return s.write(rows.select("key", "url", "payload").mapInArrow(_write_arc(s.path("arc"), date), MANIFEST), "arc-manifest")


def parse_arc(src: io.BufferedReader, name: str) -> Iterator[tuple[int, dict, bytes]]:
    """(version, header fields, document) of every record after the version block."""
    version, names = 1, FIELDS[1].split()
    while line := src.readline():
        if line in (b"\n", b"\r\n"):
            continue
        text = line.decode("utf-8", "surrogateescape").rstrip("\r\n")
        if text.startswith("filedesc://"):
            block = src.read(int(text.rsplit(" ", 1)[1])).decode("utf-8", "replace").split("\n")
            version = int(block[0].split(" ")[0])
            if version not in FIELDS:
                raise ValueError(f"{name}: ARC version {version}")
            names = FIELDS[version].split()
            continue
        values = text.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"{name}: not a version {version} header line: {text[:200]}")
        size = int(values[-1])
        body = src.read(size)
        if len(body) != size:
            raise ValueError(f"{name}: {size} bytes declared, {len(body)} found")
        yield version, dict(zip(names, values)), body


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """(header bytes, payload, headers by lower-case name); a document without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    end = block.find(b"\r\n\r\n")
    head = block if end < 0 else block[:end + 4]
    fields = {}
    for x in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, sep, v = x.partition(":")
        if sep:
            fields[k.strip().lower()] = v.strip()
    return head, block[len(head):], fields


def _key(fields: dict[str, str]) -> int | None:
    value = fields.get(KEY.lower())
    return int(value) if value is not None and re.fullmatch(r"-?\d+", value) else None


def _scan_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file in batch.column("file").to_pylist():
            rows = []
            with stream(file) as src:
                for i, (version, fields, body) in enumerate(parse_arc(src, file)):
                    _, payload, http = split_http(body)
                    rows.append((file, i, version, _key(http), fields["URL"], fields["Archive-date"], len(payload), digest(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))] if rows else
                [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())],
                names=["file", "ord", "version", "key", "url", "date", "payload_bytes", "payload_digest"])


def _by_file(files: DataFrame) -> DataFrame:
    """Files spread over tasks, a few to each."""
    n = files.count()
    return files.repartition(max(1, min(n, 20_000)), "file")


def scan_arc(s: Scratch, files: DataFrame) -> DataFrame:
    """One row per record of the ARC files (column ``file``)."""
    return s.write(_by_file(files.select("file")).mapInArrow(_scan_arc, RECORD), "arc-records")


# --- WARC ----------------------------------------------------------------

def record_id(file: str, i: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file.rsplit('/', 1)[-1]}#{i}')}>"


def _warc_head(fields: list[tuple[str, str]], size: int) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}Content-Length: {size}\r\n\r\n".encode("utf-8", "surrogateescape")


def _iso(date: str) -> str:
    d = (date + "19700101000000"[len(date):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert_file(file: str, revisits: dict[int, tuple], folder: str) -> tuple[str, int]:
    """One ARC file as one WARC file; ``revisits``: record number -> (file, number, key) of its response."""
    out = Members(folder, ".warc.gz")
    info = b"software: arrears\r\nformat: WARC File Format 1.1\r\n"
    out.add(_warc_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(file, -1)), ("WARC-Filename", out.name),
                        ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], len(info)), info, b"\r\n\r\n")
    with stream(file) as src:
        for i, (_, fields, body) in enumerate(parse_arc(src, file)):
            head, payload, _ = split_http(body)
            known = [("WARC-Record-ID", record_id(file, i)), ("WARC-Date", _iso(fields["Archive-date"])), ("WARC-Target-URI", fields["URL"]),
                     ("WARC-IP-Address", fields["IP-address"]), ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
                     ("Content-Type", "application/http; msgtype=response" if head else fields["Content-type"])]
            if i in revisits:
                other, number, key = revisits[i]
                known = [("WARC-Type", "revisit"), ("WARC-Profile", PROFILE), ("X-Payload-Length", str(len(payload))), ("WARC-Refers-To", record_id(other, number)),
                         *([("X-Refers-To-Key", str(key))] if key is not None else []), *known]
                block = [head]
            else:
                known = [("WARC-Type", "response" if head else "resource"), *known]
                block = [head, payload]
            out.add(_warc_head([*known, ("WARC-Block-Digest", f"sha1:{digest(b''.join(block))}")], sum(map(len, block))), *block, b"\r\n\r\n")
    out.close()
    return out.uri, out.n - 1


def _convert(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                again = {r["ord"]: (r["to_file"], r["to_ord"], r["to_key"]) for r in row["again"] or []}
                uri, n = convert_file(row["file"], again, folder)
                yield pa.RecordBatch.from_arrays([pa.array([uri], pa.string()), pa.array([n], pa.int64())], names=["file", "n_records"])
    return run


def convert(s: Scratch, files: DataFrame, least: int = 0) -> DataFrame:
    """ARC files (column ``file``) -> the manifest of WARC files."""
    records = scan_arc(s, files)
    place = F.struct("key", "file", "ord")
    copies = s.write(records.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(
        F.max(place).alias("to"), F.count("*").alias("n")).where("n > 1").select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "to"), "copies")
    revisits = records.join(copies, (records["payload_digest"] == copies["d"]) & (records["payload_bytes"] == copies["b"])).where(
        "not (file = to.file and ord = to.ord)").select("file", "ord", F.col("to.file").alias("to_file"), F.col("to.ord").alias("to_ord"), F.col("to.key").alias("to_key"))
    # a file's revisits are at most its records; the files are then spread over tasks by number
    again = revisits.groupBy("file").agg(F.collect_list(F.struct("ord", "to_file", "to_ord", "to_key")).alias("again"))
    todo = s.write(files.select("file").join(again, "file", "left"), "revisits")
    return s.write(_by_file(todo).mapInArrow(_convert(s.path("warc")), MANIFEST), "warc-manifest")


def parse_warc(src: io.BufferedReader, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record."""
    while line := src.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{name}: not a WARC record: {line[:100]!r}")
        fields = {}
        while (line := src.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "surrogateescape").partition(":")
            fields[k.strip().lower()] = v.strip()
        size = int(fields["content-length"])
        block = src.read(size)
        if len(block) != size:
            raise ValueError(f"{name}: {size} bytes declared, {len(block)} found")
        yield fields, block


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in batches:
        for file in batch.column("file").to_pylist():
            rows = []
            with stream(file) as src:
                for fields, block in parse_warc(src, file):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, payload, http = split_http(block)
                    stated = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "revisit":
                        size = int(fields.get("x-payload-length", http.get("content-length", -1)))
                    else:
                        size = len(payload)
                        if digest(payload) != stated:
                            raise ValueError(f"{file}: {fields['warc-record-id']} does not match its digest")
                    rows.append((file, fields["warc-record-id"], kind, fields["warc-target-uri"], fields["warc-date"], _key(http), size, stated,
                                 fields.get("warc-refers-to"), int(fields["x-refers-to-key"]) if "x-refers-to-key" in fields else None))
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def read_warc(files: DataFrame) -> DataFrame:
    """One row per record of the WARC files (column ``file``), warcinfo aside."""
    return _by_file(files.select("file")).mapInArrow(_read_warc, READ)


def archive_pages(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) as legacy ARC files, converted to WARC
    files and read back: page_id, payload_bytes, payload_digest, record_type,
    refers_to."""
    s = Scratch(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("key"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("payload"))
    arcs = write_arc(s, rows)
    warcs = convert(s, arcs, least)
    s.drop("arc")
    return read_warc(warcs).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id")



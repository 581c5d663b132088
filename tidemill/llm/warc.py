"""WARC archives with a two-level capture index.

Every page becomes a gzip member of its own in an archive: a response, or a revisit of the page with the smallest id that
has the same payload. Captures are sorted by reversed-host URL key into blocks of lines, each compressed by itself; a sparse
directory keeps the first key and the byte range of each block. The index is a file of blocks and a file of its directory for
each range of keys, and a table with a row for each such file. A lookup finds the files by bisecting that table, bisects
their directories, reads a block by range, bisects its lines, and reads the record by range; many lookups do so in parallel,
by index file.

Files are written by the tasks under names of their own in the shared folder, and only the rows that a task returns name
them: what a lost or repeated task has written is never read.
"""

from __future__ import annotations

import bisect
import contextlib
import datetime as dt
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop, make_folder, parts, scratch, small, stored, storing

#: Payloads of fewer bytes are always responses.
LEAST_REVISIT = 100
BLOCK_LINES = 1000
READ_BYTES = 8 << 20
# Fields of our own, as the format allows them: the page ids, which WARC-Record-ID cannot give as ids may repeat.
OWN_ID, FIRST_ID = "Tidemill-Page-ID", "Tidemill-Refers-To-Page-ID"
CAPTURE = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """The sort key of a URL: labels of the host in reverse, then port, path and query; without scheme, user or fragment."""
    try:
        u = urlsplit((url or "").strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return ")" + quote(url or "", safe="/?&=%:.,;+~-_")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")
    return quote(key, safe="/?&=%:.,;+~-_()*@!$'[]")


def member(data: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_id(run: str, row: int) -> str:
    """The WARC-Record-ID of a row of a run of the writer: unique, and known before the record is written."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{run}:{row}'.encode()).digest(), version=4)}>"


def record(r: dict, payload: bytes, run: str, date: str) -> bytes:
    """A record. r: row, page_id, url, digest, and first_row and first_id of the response if it revisits one."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = r["first_row"] is not None
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Target-URI: {quote(r['url'] or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Date: {date}",
        f"WARC-Record-ID: {record_id(run, r['row'])}", f"WARC-Payload-Digest: sha256:{r['digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if r["page_id"] is not None:
        lines.append(f"{OWN_ID}: {r['page_id']}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(run, r['first_row'])}", f"{FIRST_ID}: {r['first_id']}"]
    return member("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def parse(raw: bytes) -> dict:
    """What a record says: record_id, page_id, payload_bytes, payload_digest, record_type, refers_to (a page id), refers_to_record and
    payload (None if revisit)."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    number = lambda name: int(fields[name]) if name in fields else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": number(OWN_ID), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(FIRST_ID), "record_id": fields["WARC-Record-ID"],
        "refers_to_record": fields.get("WARC-Refers-To"), "payload": payload if kind == "response" else None,
    }


class Out:
    """A file that is made when something is first written to it."""

    def __init__(self, folder: str, suffix: str):
        self.fs, path = pafs.FileSystem.from_uri(folder)
        self.name = f"part-{uuid.uuid4().hex}{suffix}"
        self.path, self.file, self.at = f"{path}/{self.name}", None, 0

    def write(self, data: bytes) -> int:
        if self.file is None:
            self.file = self.fs.open_output_stream(self.path, compression=None)
        self.file.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()

    def __enter__(self) -> Out:
        return self

    def __exit__(self, *error) -> None:
        self.close()


def archiver(folder: str, run_id: str, date: str):
    def run(batches):
        with Out(folder, ".warc.gz") as out:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    data = record(r, (r["html"] or "").encode(), run_id, date)
                    rows.append({"key": url_key(r["url"]), "page_id": r["page_id"], "file": out.name, "offset": out.write(data), "length": len(data)})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    return run


INDEX = "first_key string, last_key string, file string, directory string, blocks long, lines long"


def index_writer(folder: str, size: int):
    """Blocks of lines of sorted captures in one file, its directory in another, and a row that names both."""

    def run(batches):
        lines, n, last = [], 0, None
        with Out(folder, ".cdx.z") as out, Out(folder, ".dir") as directory:
            blocks, first = 0, None

            def flush():
                nonlocal blocks, first, n, last
                if lines:
                    data = zlib.compress("\n".join(lines).encode(), 6)
                    key, last = lines[0].split(" ", 1)[0], lines[-1].split(" ", 1)[0]
                    directory.write(f"{key} {out.write(data)} {len(data)}\n".encode())
                    first = key if first is None else first
                    blocks, n = blocks + 1, n + len(lines)
                    lines.clear()

            for batch in batches:
                for r in batch.to_pylist():
                    lines.append(f"{r['key']} {r['file']} {r['offset']} {r['length']}")
                    if len(lines) >= size:
                        flush()
            flush()
        if blocks:
            yield pa.RecordBatch.from_pylist([{"first_key": first, "last_key": last, "file": out.name, "directory": directory.name, "blocks": blocks, "lines": n}])

    return run


def write_archives(pages: DataFrame, folder: str, block_lines: int = BLOCK_LINES, date: str | None = None) -> DataFrame:
    """Write archives and index under folder (a URI that all executors reach); returns the table of index files, which is
    also stored as folder/files. date: of the captures, by default now.

    A null html is an empty payload and a null url an empty one. Of rows with a page_id that share a payload of at least
    LEAST_REVISIT bytes, one with the smallest page_id is a response and all others, repeated rows too, revisit it; a page
    without page_id is a response that none refers to. Every row is a record with an id of its own. Other columns are
    ignored. An empty table gives no files and an empty table of them.
    """
    spark = pages.sparkSession
    body = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("size"), F.monotonically_increasing_id().alias("row"))
    pages = stored(pages, "pages")
    able = pages.where((F.col("size") >= LEAST_REVISIT) & F.col("page_id").isNotNull())
    shared = able.groupBy("digest").agg(F.min(F.struct("page_id", "row")).alias("x"), F.count("*").alias("n")).where("n > 1")
    shared = stored(shared.select(F.col("digest").alias("shared"), F.col("x.page_id").alias("first_id"), F.col("x.row").alias("first_row")), "payloads")
    revisits = (F.col("digest") == F.col("shared")) & (F.col("size") >= LEAST_REVISIT) & F.col("page_id").isNotNull() & (F.col("row") != F.col("first_row"))
    rows = pages.join(small(shared), revisits, "left").select("row", "page_id", "url", "html", "digest", "first_id", "first_row")
    for name in ("archive", "index"):
        make_folder(spark, f"{folder}/{name}")
    date = date or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    with storing(spark):
        rows.mapInArrow(archiver(f"{folder}/archive", uuid.uuid4().hex, date), CAPTURE).write.parquet(f"{folder}/captures")
        drop(pages, shared)
        captures = spark.read.schema(CAPTURE).parquet(f"{folder}/captures")
        ordered = captures.repartitionByRange(parts(captures), "key", "file", "offset").sortWithinPartitions("key", "file", "offset")
        ordered.mapInArrow(index_writer(f"{folder}/index", block_lines), INDEX).write.parquet(f"{folder}/files")
    return spark.read.schema(INDEX).parquet(f"{folder}/files")


def read_range(fs, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


class Lookup:
    """The captures of keys in one index file: bisects its directory, reads blocks by range and bisects their lines. Keys
    that come in order read each block once."""

    def __init__(self, fs, path: str, file: str, directory: str):
        self.fs, self.path, self.now, self.lines = fs, f"{path}/{file}", None, []
        with fs.open_input_file(f"{path}/{directory}") as f:
            blocks = [line.rsplit(" ", 2) for line in f.read().decode().splitlines()]
        self.first = [b[0] for b in blocks]
        self.ranges = [(int(b[1]), int(b[2])) for b in blocks]

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(file, offset, length) of all captures of the key."""
        out = []
        # Lines of one key may run over blocks: from the last block that begins before the key.
        at = max(0, bisect.bisect_left(self.first, key) - 1)
        while at < len(self.first) and self.first[at] <= key:
            if at != self.now:
                self.now, self.lines = at, zlib.decompress(read_range(self.fs, self.path, *self.ranges[at])).decode().split("\n")
            for i in range(bisect.bisect_left(self.lines, key + " "), len(self.lines)):
                found, name, offset, length = self.lines[i].rsplit(" ", 3)
                if found != key:
                    break
                out.append((name, int(offset), int(length)))
            at += 1
        return out


class Files:
    """The index files, as their table has them: one for each partition of the sorted captures, and so few."""

    def __init__(self, files: DataFrame):
        self.rows = sorted((r.first_key, r.last_key, r.file, r.directory) for r in files.collect())
        self.first = [r[0] for r in self.rows]

    def of(self, key: str) -> list[int]:
        """The files whose range has the key."""
        at, out = bisect.bisect_right(self.first, key) - 1, []
        while at >= 0 and self.rows[at][1] >= key:
            out.append(at)
            at -= 1
        return out


def keyed(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string())], names=["key"])


def resolve(urls: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """file, offset, length of all captures of the urls (column url; repeated ones count once)."""
    index = Files(files)

    def sent(batches):
        for batch in batches:
            rows = [(at, key) for key in batch.column("key").to_pylist() for at in index.of(key)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["at", "key"])

    def looked_up(table: pa.Table) -> pa.Table:
        fs, path = pafs.FileSystem.from_uri(f"{folder}/index")
        lookup = Lookup(fs, path, *index.rows[table.column("at")[0].as_py()][2:])
        found = [x for key in sorted(table.column("key").to_pylist()) for x in lookup.find(key)]
        return pa.table([pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "offset", "length"])

    keys = urls.select("url").mapInArrow(keyed, "key string").distinct()
    return keys.mapInArrow(sent, "at int, key string").groupBy("at").applyInArrow(looked_up, "file string, offset long, length long")


RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def record_reader(folder: str):
    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        with contextlib.ExitStack() as opened:
            name, file = None, None
            for batch in batches:
                rows, run_of, out = batch.to_pylist(), [], []

                def flush():
                    lo = run_of[0]["offset"]
                    data = file.read_at(run_of[-1]["offset"] + run_of[-1]["length"] - lo, lo)
                    for r in run_of:
                        said = parse(data[r["offset"] - lo : r["offset"] - lo + r["length"]])
                        out.append({k: said[k] for k in RECORD.names})
                    run_of.clear()

                for r in rows:
                    if run_of and (r["file"] != name or r["offset"] != run_of[-1]["offset"] + run_of[-1]["length"] or r["offset"] - run_of[0]["offset"] > READ_BYTES):
                        flush()
                    if r["file"] != name:
                        opened.close()
                        name, file = r["file"], opened.enter_context(fs.open_input_file(f"{path}/{r['file']}"))
                    run_of.append(r)
                if run_of:
                    flush()
                yield pa.RecordBatch.from_pylist(out, schema=RECORD)

    return run


def read_captures(captures: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of captures (file, offset, length). The payload of a
    response is checked against its digest. Captures that lie together are read together."""
    n = parts(captures)
    near = captures.repartition(n, "file", F.floor(F.col("offset") / (4 * READ_BYTES))).sortWithinPartitions("file", "offset")
    return near.mapInArrow(record_reader(f"{folder}/archive"), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


class Captures:
    """Lookups of single URLs on the driver."""

    def __init__(self, files: DataFrame, folder: str):
        self.folder, self.files = folder, Files(files)

    def lookup(self, url: str) -> list[dict]:
        """The records of a URL; none if it was not captured."""
        fs, path = pafs.FileSystem.from_uri(self.folder)
        found = [x for at in self.files.of(url_key(url)) for x in Lookup(fs, f"{path}/index", *self.files.rows[at][2:]).find(url_key(url))]
        return [parse(read_range(fs, f"{path}/archive/{name}", offset, length)) for name, offset, length in found]


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a folder of their own in the shared folder, look all their URLs up, and read what is found."""
    folder = scratch(pages.sparkSession, "warc")
    files = write_archives(pages, folder)
    return read_captures(stored(resolve(pages, files, folder), "found"), folder)

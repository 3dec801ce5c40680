"""WARC archives: write, normalise a monolithic gzip, read back through a sidecar index.

* ``write_archives`` deals records to files; each file is one gzip stream over many records, the form
  that cannot be sought in.  Of equal payloads (SHA-256) of ``least`` bytes or more, the smallest id
  is a ``response``, the others are ``revisit`` records that name it and carry headers only.
* ``normalise`` inflates each whole-file stream once, rewrites every record as a gzip member of its
  own and writes a sidecar index (one JSON line per record: offset, length, id, type).  Concatenated
  members, as many tools write them, are read as well.
* ``read_records`` fetches each record by its index line, inflates that member alone and checks a
  response's payload against its digest.

Files go to a folder all executors share (``spark.checkpoint.dir``), under names no two attempts
share; a later step reads only the files that a finished task has reported, so a lost executor or a
repeated task leaves at most an unlisted file.  A task holds one record at a time.

Null payloads are empty.  Rows that repeat the smallest id of a group are all responses; a null id
is written as an empty one and comes back null.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swatch.llm.common import arrow_schema
from swatch.session import ensure_checkpoint_dir, materialize

LEAST = 100
FILE_BYTES = 256 << 20  # a writer starts a new file beyond so many bytes of records
CHUNK = 1 << 20


def open_fs(url: str):
    """(filesystem, path) of a folder or file URL, or of a bare local path."""
    from pyarrow import fs

    url = re.sub(r"^file:/+", "file:///", url)
    return fs.FileSystem.from_uri(url) if re.match(r"[a-z0-9]+:/", url) else (fs.LocalFileSystem(), url)


def record_bytes(page, url: str | None, payload: bytes, digest: str, refers_to, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record of a capture at ``date``; a revisit keeps the response's headers and drops its body."""
    target = "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is None:
        http += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + http + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(stream):
    """Chunks of the inflated bytes of a gzip file of one or many members."""
    z = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            yield z.decompress(data)
            data = b""
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)


def records(chunks):
    """Whole records (bytes) from inflated chunks; holds one record and one chunk."""
    buffer, need, ended = bytearray(), None, False
    chunks = iter(chunks)
    while True:
        if need is None:
            at = buffer.find(b"\r\n\r\n")
            if at >= 0:
                need = at + 4 + int(parse_head(bytes(buffer[:at]))["content-length"]) + 4
        if need is not None and len(buffer) >= need:
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
            continue
        if ended:
            if buffer.strip():
                raise ValueError("the archive ends inside a record")
            return
        got = next(chunks, None)
        ended = got is None
        buffer += got or b""


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, url_col: str, least: int = LEAST) -> DataFrame:
    """Rows ``page, url, html, digest, refers_to``.

    The smallest id of each payload is aggregated map-side and written once; only payloads that occur
    more than once are kept.  Joined as two plain shuffles, a payload that holds a third of all rows
    is split by the engine's skew join.
    """
    rows = pages.select(pages[id_col].alias("page"), pages[url_col].alias("url"), pages[payload_col].alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    firsts = (rows.where(F.octet_length("html") >= least).groupBy("digest")
              .agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    firsts = materialize(firsts, "warc-firsts")
    marked = rows.join(firsts, "digest", "left")
    return marked.select("page", "url", "html", "digest",
                         F.when(F.col("page").isNull() | (F.col("first") != F.col("page")), F.col("first"))
                         .alias("refers_to"))


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``mark_revisits`` as monolithic gzip files; returns (file, records).

    All records have the time of this call as their date, so a task that runs again writes the same."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        import pyarrow as pa

        out, sink, z, size, count, name = [], None, None, 0, 0, ""

        def close():
            sink.write(z.flush())
            sink.close()
            out.append({"file": name, "records": count})

        for batch in batches:
            for row in zip(*[batch.column(i) for i in range(batch.num_columns)]):
                page, url, html, digest, refers_to = (x.as_py() for x in row)
                if sink is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, path = open_fs(name)
                    sink, z, size, count = fs.open_output_stream(path, compression=None), zlib.compressobj(6, 8, 31), 0, 0
                data = record_bytes(page, url, (html or "").encode("utf-8"), digest, refers_to, date)
                sink.write(z.compress(data))
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield pa.RecordBatch.from_pylist(out, pa.schema([("file", pa.string()), ("records", pa.int64())]))

    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    return materialize(marked.mapInArrow(run, "file string, records long"), "warc-files")


def normalise(files: DataFrame) -> DataFrame:
    """Rewrite each monolithic file record by record; returns (file, index, records)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for source in batch.column(0).to_pylist():
                name = f"{source.removesuffix('.warc.gz')}-{uuid.uuid4().hex}.record.warc.gz"
                fs, path = open_fs(source)
                to_fs, to = open_fs(name)
                at = n = 0
                with (fs.open_input_stream(path, compression=None) as stream,
                      to_fs.open_output_stream(to, compression=None) as sink,
                      to_fs.open_output_stream(f"{to}.idx", compression=None) as index):
                    for record in records(inflate(stream)):
                        head = parse_head(record[:record.index(b"\r\n\r\n")])
                        z = zlib.compressobj(6, 8, 31)
                        member = z.compress(record) + z.flush()
                        sink.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member), "id": head["warc-record-id"],
                                                "type": head["warc-type"]}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_pylist([{"file": name, "index": f"{name}.idx", "records": n}], pa.schema(
                    [("file", pa.string()), ("index", pa.string()), ("records", pa.int64())]))

    return materialize(_one_each(files.select("file")).mapInArrow(run, "file string, index string, records long"), "warc-members")


RECORD = "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"


def read_records(members: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of normalised archives, each fetched by its index line (``RECORD``)."""
    schema = T.StructType.fromDDL(RECORD)
    arrow = arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for name, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = open_fs(name)
                idx_fs, idx = open_fs(index)
                out, held = [], 0
                with (fs.open_input_file(path) as data,
                      idx_fs.open_input_stream(idx, compression=None, buffer_size=CHUNK) as lines):
                    for line in _lines(lines):
                        entry = json.loads(line)
                        record = zlib.decompress(data.read_at(entry["length"], entry["offset"]), 31)
                        head_end = record.index(b"\r\n\r\n")
                        head = parse_head(record[:head_end])
                        block = record[head_end + 4:-4]
                        http_end = block.index(b"\r\n\r\n")
                        http, payload = parse_head(block[:http_end]), block[http_end + 4:]
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        if head["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{name} at {entry['offset']}: the payload does not have its digest")
                        of = lambda x: x.removeprefix("<urn:page:").removesuffix(">") or None
                        out.append({"page": of(head["warc-record-id"]), "payload_bytes": int(http["content-length"]),
                                    "payload_digest": digest, "record_type": head["warc-type"],
                                    "refers_to": of(head.get("warc-refers-to", "")),
                                    "payload": payload if payloads and head["warc-type"] == "response" else None})
                        held += len(record)
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(out, arrow)
                            out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, arrow)

    return _one_each(members.select("file", "index")).mapInArrow(run, schema)


def _one_each(files: DataFrame) -> DataFrame:
    """About one file a task.  A file is the unit of work, and the table of names is tiny: without a
    stated number of partitions adaptive execution would merge them all into one task."""
    return files.repartition(max(1, files.count()), "file")


def _lines(stream):
    rest = b""
    while data := stream.read(CHUNK):
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    if rest:
        yield rest


def archive_folder(spark) -> str:
    """A new folder for archives in the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
               least: int = LEAST, payloads: bool = True) -> DataFrame:
    """Write, normalise and read back ``pages``: the records as read (``RECORD``)."""
    folder = archive_folder(pages.sparkSession)
    files = write_archives(mark_revisits(pages, id_col, payload_col, url_col, least), folder)
    return read_records(normalise(files), payloads)

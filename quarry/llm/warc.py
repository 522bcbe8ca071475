"""WARC archives with a dictionary of their own (``.warc.zst``).

An archive starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built from
records of the archive; each record follows as a frame of its own, compressed with it. Of equal payloads of at
least ``least`` bytes the page with the smallest id is a response, the others are revisits that refer to it and
carry no payload; smaller ones are all responses.

Payloads are shuffled once, next to the smallest id of their digest (Spark can split a frequent digest). Every
task writes archives of at most ``roll`` bytes of records into the shared folder under names of its attempt;
the written manifest names the files of the attempts that count, so retries and lost executors leave no
doubles. Reading takes whole archives of the manifest in parallel, and checks digests of what it reads.

Defined results: null html is an empty payload; a null url gets a name from the id; pages with a null id are
never the smallest, and equal payloads without any id are all responses; rows that share the smallest id are
all responses; an empty table gives an empty manifest and no records; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import urllib.parse
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.session import scratch_path

# Fixed values of the formats.
SKIPPABLE, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST, ROLL, DICT_BYTES, TRAIN_BYTES, LEVEL = 100, 32 << 20, 64 << 10, 2 << 20, 3
DATE = "1970-01-01T00:00:00Z"


def record_id(page) -> str:
    """A page's record id: a fixed function of the page id, so that revisits can name it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page}') if page is not None else uuid.uuid4()}>"


def record(page, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str = DATE) -> bytes:
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    target = urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record; of a response the payload's size and digest are those of the bytes that were read."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} isn't what was written")
    whole = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": whole("X-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": kind, "payload_bytes": size,
            "payload_digest": digest, "refers_to": whole("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


def dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary built from records: trained, or, where there are too few to train on, their last bytes as they are."""
    import zstandard
    samples, held = [], 0
    for r in records:
        part = r[:TRAIN_BYTES // 8]
        samples.append(part)
        held += len(part)
        if held >= TRAIN_BYTES:
            break
    if len(samples) >= 16 and held >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(size, held // 4), samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def compress(records: list[bytes], held: bytes) -> list[bytes]:
    import zstandard
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(held), write_content_size=True)
    return [c.compress(r) for r in records]


def opening(held: bytes) -> bytes:
    """The leading skippable frame with the dictionary, itself compressed."""
    import zstandard
    body = zstandard.ZstdCompressor(level=19, write_content_size=True).compress(held)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames(data: bytes):
    """Yields the records of an archive."""
    import zstandard
    magic, n = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't start with its dictionary")
    held = data[8:8 + n]
    if len(held) >= 4 and struct.unpack_from("<I", held)[0] == ZSTD_FRAME:
        held = zstandard.ZstdDecompressor().decompress(held)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
    at, view = 8 + n, memoryview(data)
    while at < len(data):
        out, parts = d.decompressobj(), []
        while not out.eof and at < len(data):
            parts.append(out.decompress(view[at:at + 65536]))
            at += min(65536, len(data) - at)
        at -= len(out.unused_data)
        if not out.eof:
            raise ValueError("a frame is cut off")
        yield b"".join(parts)


def _open(uri):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)


def _write(batches, folder, roll):
    """Archives of this task; a row ``(path, records, record_bytes, archive_bytes)`` each. Records wait for their
    dictionary until ``TRAIN_BYTES`` are there, and leave memory as they are compressed."""
    from pyspark import TaskContext
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    task, made = TaskContext.get().partitionId(), []
    state = {"held": None, "waiting": [], "fresh": 0, "bytes": 0, "size": 0, "n": 0, "out": None, "path": None}

    def flush():
        if not state["waiting"]:
            return
        if state["held"] is None:
            state["held"] = dictionary(state["waiting"])
            name = f"part-{task:05d}-{uuid.uuid4().hex}.warc.zst"
            state["path"], state["out"] = f"{folder.rstrip('/')}/{name}", system.open_output_stream(f"{base}/{name}", compression=None)
            lead = opening(state["held"])
            state["out"].write(lead)
            state["size"] = len(lead)
        for frame in compress(state["waiting"], state["held"]):
            state["out"].write(frame)
            state["size"] += len(frame)
        state.update(waiting=[], fresh=0)

    def close():
        flush()
        if state["out"] is not None:
            state["out"].close()
            made.append((state["path"], state["n"], state["bytes"], state["size"]))
        state.update(held=None, waiting=[], fresh=0, bytes=0, size=0, n=0, out=None, path=None)

    for b in batches:
        for r in range(b.num_rows):
            page, url, html, digest, least = (b.column(i)[r].as_py() for i in range(5))
            rec = record(page, url, html.encode(), digest, least, least is not None and page != least)
            state["waiting"].append(rec)
            state["bytes"] += len(rec)
            state["n"] += 1
            state["fresh"] += len(rec)
            if state["fresh"] >= TRAIN_BYTES:
                flush()
            if state["bytes"] >= roll:
                close()
    close()
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made) if made else ((),) * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                     names=["path", "records", "record_bytes", "archive_bytes"])


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least: int = LEAST, roll: int = ROLL) -> DataFrame:
    """Writes the archives and returns their written manifest. ``folder`` must be shared by the executors (default:
    a new one below the checkpoint folder)."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("/"):
        folder = folder.replace(":/", ":///", 1)
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = (rows.where(F.octet_length("html") >= least).groupBy(F.col("digest").alias("_d"))
             .agg(F.min("page").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    rows = rows.join(first, F.col("digest") == F.col("_d"), "left").select("page", "url", "html", "digest", "least")
    return written(rows.mapInArrow(functools.partial(_write, folder=folder, roll=roll),
                                   "path string, records long, record_bytes long, archive_bytes long"), "manifest")


def _read(batches):
    for b in batches:
        for path, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            system, name = _open(path)
            with system.open_input_stream(name, compression=None) as f:
                data = f.read()
            rows, seen = [], 0

            def out():
                return pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))
            for raw in frames(data):
                rows.append(parse(raw))
                seen += 1
                if len(rows) == 256:
                    yield out()
                    rows = []
            if seen != n:
                raise ValueError(f"{path} holds {seen} records; {n} were written")
            yield out()


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of a manifest's archives: ``page_id``, ``url``, ``record_type``, ``payload_bytes``, ``payload_digest``,
    ``refers_to``, ``payload`` (null in revisits)."""
    # the names say .zst, but the files are opened as they are: the frames are read here
    paths = manifest.select("path", "records").repartition(max(1, manifest.count()), "path")
    return paths.mapInArrow(_read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
                                   "refers_to long, payload binary")


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS least FROM d WHERE payload_bytes >= {LEAST} GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN least IS NOT NULL AND page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest"""

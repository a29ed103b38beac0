"""Zstandard WARC archives: writer and reader.

An archive starts with a skippable frame that holds the dictionary (itself a Zstandard frame); then comes one frame per
record, so a reader can start at any record and a damaged one does not spoil the rest.

* ``write_archives`` runs in the tasks that hold the rows.  Each task writes files of about ``roll_bytes`` under the
  shared folder and returns their names; only the names that Spark commits count, so files of lost or repeated
  tasks are never read.  Equal payloads of at least ``revisit_bytes`` are found by their digests alone: the record with the
  smallest page_id is a response, the others revisit it.  The revisits are a written table, so Spark broadcasts it while it
  is small; beyond that the payloads move once, to meet it.
* ``read_archives`` decodes frame by frame, checking the frame's content size and checksum, the version line, the required
  headers, both lengths and, for responses, the digest.  Of a folder it lists the archives with Spark's binary reader; with
  a manifest each task opens the archives that its rows name, so no content is moved.

The dictionary is trained on at most ``sample_pages`` payloads (those with the least hashes of their page_id, 64 KiB of
each); with too few samples to train on, archives have none.

Defined cases: a null html is an empty payload; empty and short payloads are always responses; a null url is an empty
target; a row with a null page_id revisits an equal payload that has a page_id; repeated rows of the smallest page_id are
all responses; an empty table gives no archives and an empty result; a damaged frame gives one row with ``error`` set;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.samples import least_hashed
from papyra.workspace import Workspace

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES = 65_536
SAMPLE_PAGES = 256
ROLL_BYTES = 8_000_000
REVISIT_BYTES = 100
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
RECORD = "archive string, offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of the response and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    import zstandard

    packed = zstandard.ZstdCompressor().compress(dictionary)
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


def train_dictionary(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> bytes:
    import zstandard

    sample = pages.select("page_id", F.substring("payload", 1, 65_536).alias("payload")).where(F.length("payload") > 0)
    rows = least_hashed(sample, "page_id", sample_pages, "dictionary").collect()  # bounded
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["payload"]) for r in rows]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def with_revisits(pages: DataFrame, work: Workspace, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)`` of ``pages(page_id, url, payload)``."""
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    light = pages.where(F.length("payload") >= revisit_bytes).select("page_id", "digest")
    firsts = light.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    later = light.join(firsts, "digest").where("page_id is null or page_id <> first_id").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first_id").alias("refers_to")).distinct()
    later = work.table(later, "revisits")
    same = (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page"))
    return pages.join(later, same, "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_archives(pages: DataFrame, work: Workspace, dictionary: bytes, date: str = "2024-01-01T00:00:00Z", roll_bytes: int = ROLL_BYTES, level: int = 3) -> DataFrame:
    """Writes ``with_revisits`` rows; returns the written ``(archive, records, bytes)``, committed."""
    folder = work.path("archives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        dict_data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        compressor = zstandard.ZstdCompressor(level=level, dict_data=dict_data, write_checksum=True, write_content_size=True)
        out, name, records, size, made = None, "", 0, 0, []
        try:
            for batch in batches:
                for k in range(batch.num_rows):
                    page_id, url, payload, digest, refers_to = (batch.column(c)[k].as_py() for c in range(5))
                    if out is None:
                        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{len(made):04d}.warc.zst"
                        out, records = store.open_output_stream(f"{root}/{name}", compression=None), 0
                        head = dictionary_frame(dictionary) if dictionary else b""
                        out.write(head)
                        size = len(head)
                    frame = compressor.compress(record_bytes(page_id, url, payload, digest, refers_to, date))
                    out.write(frame)
                    records, size = records + 1, size + len(frame)
                    if size >= roll_bytes:
                        out.close()
                        made.append((name, records, size))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            made.append((name, records, size))
        names, counts, sizes = ([m[k] for m in made] for k in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "records", "bytes"])

    return work.table(pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "archive string, records long, bytes long"), "manifest")


def parse_record(raw: bytes) -> dict:
    """Fields of one record; raises ValueError where it is not valid."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("a header line has no colon")
        headers[name.strip().lower()] = value.strip()
    for name in REQUIRED:
        if name not in headers:
            raise ValueError(f"no {name}")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the block is not as long as Content-Length says")
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    said = re.search(rb"(?mi)^content-length: *(\d+)", http)
    if not found or not said:
        raise ValueError("no HTTP headers")
    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "")
    if kind not in ("response", "revisit") or not re.fullmatch(r"sha256:[0-9a-f]{64}", digest):
        raise ValueError("another type of record or digest")
    if kind == "response" and (int(said[1]) != len(payload) or hashlib.sha256(payload).hexdigest() != digest[7:]):
        raise ValueError("the payload is not what its headers say")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise ValueError("not a valid revisit")
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", x or "")) else None
    return {"page_id": number(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "record_type": kind, "refers_to": number(headers.get("warc-refers-to")), "payload_bytes": int(said[1]), "payload_digest": digest[7:], "payload": payload if kind == "response" else None}


def archive_records(content: bytes, piece: int = 65_536) -> Iterator[tuple[int, bytes | None, str | None]]:
    """``(offset, record, error)`` for each frame; after a damaged frame the next one is looked for."""
    import zstandard

    view, at, dictionary = memoryview(content), 0, None
    if len(content) >= 8 and int.from_bytes(content[:4], "little") == DICTIONARY_MAGIC:
        size = int.from_bytes(content[4:8], "little")
        raw = content[8 : 8 + size]
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME_MAGIC else raw)
        at = 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while at < len(content):
        start, parts, error = at, [], None
        try:
            said = zstandard.get_frame_parameters(bytes(view[at : at + 18])).content_size
            frame, upto = decompressor.decompressobj(), at
            while not frame.eof and upto < len(content):
                parts.append(frame.decompress(bytes(view[upto : upto + piece])))
                upto = min(upto + piece, len(content))
            if not frame.eof:
                raise ValueError("the last frame is cut off")
            at = upto - len(frame.unused_data)
            record = b"".join(parts)
            if said not in (zstandard.CONTENTSIZE_UNKNOWN, len(record)):
                raise ValueError("another content size than the frame says")
        except (zstandard.ZstdError, ValueError) as e:
            error, record = str(e), None
            following = content.find(FRAME_MAGIC, start + 4)
            at = following if following > 0 else len(content)
        yield start, record, error


_KINDS = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])


def _records(archive: str, content: bytes) -> Iterator[pa.RecordBatch]:
    """The records of one archive, some megabytes at a time."""
    rows, held = [], 0
    for offset, record, error in archive_records(content):
        row = dict.fromkeys(_KINDS.names) | {"archive": archive, "offset": offset, "error": error}
        if record is not None:
            try:
                row |= parse_record(record)
            except (ValueError, UnicodeDecodeError) as e:
                row["error"] = str(e)
        rows.append(row)
        held += len(record or b"")
        if held > 8_000_000:
            yield pa.RecordBatch.from_pylist(rows, schema=_KINDS)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_KINDS)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records of the archives in ``folder``; with a manifest, of those it names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0), batch.column(1), strict=True):
                yield from _records(archive.as_py(), content.as_py())

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{archive}", compression=None) as stream:
                    content = stream.read()
                yield from _records(archive, content)

    if manifest is None:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
        return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("archive"), "content").mapInArrow(read, RECORD)
    tasks = max(1, min(4096, manifest.count()))  # a few archives a task
    return manifest.select("archive").repartition(tasks, "archive").mapInArrow(opened, RECORD)


def archive_round_trip(pages: DataFrame, work: Workspace, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` and reads the archives back."""
    payloads = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    manifest = write_archives(with_revisits(payloads, work), work, train_dictionary(payloads), roll_bytes=roll_bytes)
    if manifest.limit(1).count() == 0:
        return pages.sparkSession.createDataFrame([], RECORD)
    return read_archives(pages.sparkSession, work.path("archives"), manifest)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), Workspace(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


#: The digests and revisits by SQL over the table; the archives are tested by round trips.
ORACLES = {
    "op10_warc_zstandard": """
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
    f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN f.first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to, CAST(NULL AS VARCHAR) AS error
    FROM d LEFT JOIN f USING (payload_digest)"""
}

QUERIES = {"op10_warc_zstandard": op10_warc}

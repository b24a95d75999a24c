"""Web archives of individually compressed records with a dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import shared_dir, slices

#: Fixed by the format: magic number of the skippable frame that holds a dictionary.
DICT_MAGIC = 0x184D2A5D
LEAST_PAYLOAD = 100
#: Bytes of archives that a reading task gets.
READ_BYTES = 32 << 20


def _record(page_id, url, payload: bytes, digest: str, refers) -> bytes:
    kind = "response" if refers is None else "revisit"
    body = b"" if refers is not None else payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head.append(f"Content-Length: {len(http) + len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def dictionary(records: list[bytes], dict_bytes: int, sample_bytes: int) -> bytes:
    """Trained on evenly spaced records of at most ``sample_bytes`` in all; b'' if there are too few to train on."""
    mean = max(1, sum(map(len, records)) // max(1, len(records)))
    step = max(1, len(records) * mean // max(1, sample_bytes))
    samples = [r[:sample_bytes] for r in records[::step]]
    if len(samples) < 8 or sum(map(len, samples)) < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(dict_bytes, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(records: list[bytes], level: int = 3, dict_bytes: int = 32 << 10, sample_bytes: int = 1 << 20) -> bytes:
    """An archive: the skippable frame with the dictionary, then one frame for each record."""
    raw = dictionary(records, dict_bytes, sample_bytes)
    out = [struct.pack("<II", DICT_MAGIC, len(raw)), raw]
    comp = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdCompressor(level=level)
    return b"".join(out + [comp.compress(r) for r in records])


def unpack(archive: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    view = memoryview(archive)
    magic, size = struct.unpack_from("<II", view)
    if magic != DICT_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    raw, at = bytes(view[8 : 8 + size]), 8 + size
    dec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    while at < len(view):
        one, parts = dec.decompressobj(), []
        while not one.eof:
            chunk = view[at : at + step]
            if not len(chunk):
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> dict:
    """Headers (lower-case names), and the HTTP block's headers and payload."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    inner = {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}
    return {"fields": fields, "http": inner, "payload": payload}


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 32 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row under ``folder`` and returns the manifest (file, n_records, n_bytes), itself stored there.

    Of records with equal payloads of at least 100 bytes that with the smallest id is the response. Only digests
    are aggregated; payloads cross one shuffle, by digest, whose hot keys AQE splits. A task holds one archive's records
    at a time. Names carry the attempt, and the manifest lists those of attempts that ended: what a lost task left is never read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(F.octet_length("payload") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id")
    linked = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.col("first_id") != F.coalesce("page_id", F.lit(-1)), F.col("first_id")).alias("refers")).sortWithinPartitions("digest", "page_id", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, attempt, k, held, size = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, [], 0

        def flush():
            name = f"{part:06d}-{k:05d}-{attempt}.warc.zst"
            data = pack(held)
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:  # it is compressed already
                f.write(data)
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": pa.array([len(held)], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64())})

        for batch in slices(batches):
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                held.append(_record(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    k, held, size = k + 1, [], 0
        if held:
            yield flush()

    manifest = f"{folder}/manifest"
    linked.mapInArrow(write, "file string, n_records long, n_bytes long").write.parquet(manifest)
    return spark.read.parquet(manifest)


_OUT = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def read_archives(spark, folder: str) -> DataFrame:
    """Columns page_id, payload_bytes, payload_digest, record_type, refers_to, url from the archives that the manifest under ``folder`` lists.

    A response's digest and length are computed anew from its payload, a revisit's come from its headers.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    n = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    files = manifest.select("file").repartition(max(1, -(-n // READ_BYTES)), "file")
    number = lambda uri: int(x) if (x := uri.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{root}/{name}") as f:
                    archive = f.read()
                out = []
                for raw in unpack(archive):
                    r = parse(raw)
                    f, fresh = r["fields"], r["fields"]["warc-type"] == "response"
                    digest = hashlib.sha256(r["payload"]).hexdigest() if fresh else f["warc-payload-digest"].removeprefix("sha256:")
                    if fresh and f["warc-payload-digest"] != f"sha256:{digest}":
                        raise ValueError(f"payload digest differs in {f['warc-record-id']}")
                    out.append((number(f["warc-record-id"]), len(r["payload"]) if fresh else int(r["http"]["content-length"]), digest, f["warc-type"], None if fresh else number(f["warc-refers-to"]), f.get("warc-target-uri")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Archives every row in a new folder of the shared store and reads them back.

    A very long payload is one record, never cut. A null payload is empty; a null id stays null and never is a revisit's target unless nothing else is; a null URL has no header.
    Rows that repeat an id and its payload are all responses when that id is the smallest. An empty table writes no archive
    and gives an empty result.
    """
    folder = shared_dir(pages.sparkSession)
    write_archives(pages, folder)
    return read_archives(pages.sparkSession, folder)


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, n, d, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""

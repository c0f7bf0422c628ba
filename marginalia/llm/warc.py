"""WARC archives with Zstandard dictionaries.

A file starts with a skippable frame that holds its dictionary, trained on records of that file; each record follows as a
frame of its own, compressed with the dictionary, so any record can be read by its offset. Files are written by the
tasks that hold the records, each under the name of its task attempt, through pyarrow's file systems (file, hdfs, s3, gs);
the manifest, a table of the files whose tasks succeeded, says which files count, so lost executors and repeated
attempts leave nothing that is read.

Of records with equal payloads of at least ``least`` bytes, the one with the smallest page_id is a response, the others are
revisits that refer to it and have no payload. A dictionary is trained on the first ``sample_bytes`` of a file's records
(a bound on memory; the dictionary changes sizes, not contents).

Nulls and ties: a null payload is empty; null ids are always responses, and so are all rows that share the smallest id;
repeated rows are records of their own. A file with few or tiny records has a plain content dictionary. An empty table
gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST, DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 100, 64 << 10, 2 << 20, 3
SKIPPABLE = 0x184D2A5D  # the magic number of a frame with a dictionary
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"


#: Names that Spark's readers use for stores, and pyarrow's for the same.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "dbfs": "file", "": "file"}


def _file_system(path: str):
    """A pyarrow file system for a Hadoop path, and the path in it."""
    from pyarrow import fs

    scheme, _, rest = path.rpartition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}" if scheme else path.replace("file:/", "/", 1))


def record_id(page: object, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}|{url}')}>"


def record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header_url(url: str | None) -> str | None:
    """Line breaks in a url would end its header: they are escaped."""
    return None if url is None else url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else url


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, first_url: str | None) -> bytes:
    """A response, or a revisit that refers to the record of page ``first``."""
    target = header_url(url)
    shared = [
        ("WARC-Record-ID", record_id(page, url)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Page-ID", page), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http; msgtype=response"),
    ]
    head = HTTP % len(payload)
    if first is None:
        return record("response", shared, head + payload)
    return record("revisit", [*shared, ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(first, first_url)), ("WARC-Refers-To-Target-URI", header_url(first_url)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page", first)], head)


def train(samples: list[bytes], size: int = DICTIONARY_BYTES):
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:  # too few or too small to train on: the records themselves are the dictionary
        return zstandard.ZstdCompressionDict(b"".join(samples)[:size] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages: page_id, url, payload (binary), digest, first and first_url (of the response, or null). Returns the manifest."""
    common.small_batches(pages.sparkSession, 500)
    names = ["page_id", "url", "payload", "digest", "first", "first_url"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        task = TaskContext.get()
        store, root = _file_system(folder)
        path = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        waiting, size, sink, packer, n = [], 0, None, None, 0

        def begin():
            nonlocal sink, packer
            dictionary = train(waiting)
            data = dictionary.as_bytes()
            store.create_dir(root, recursive=True)
            sink = store.open_output_stream(path, compression=None)
            sink.write(struct.pack("<II", SKIPPABLE, len(data)) + data)
            packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
            sink.write(packer.compress(record("warcinfo", [("WARC-Record-ID", record_id(path.rsplit("/", 1)[-1], None)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
            for r in waiting:
                sink.write(packer.compress(r))
            waiting.clear()

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in names)
            for row in zip(*columns, strict=True):
                data, n = page_record(*row), n + 1
                if sink is not None:
                    sink.write(packer.compress(data))
                    continue
                waiting.append(data)
                size += len(data)
                if size >= SAMPLE_BYTES:
                    begin()
        if n:
            if sink is None:
                begin()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [store.get_file_info(path).size]})

    return common.spool(pages.select(*names).mapInArrow(run, MANIFEST), "warc-manifest")


def read_records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file, one in memory at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary in front")
    data = stream.read(size)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
    rest, packed, out = stream.read(1 << 16), unpacker.decompressobj(), []
    while rest:
        out.append(packed.decompress(rest))
        if packed.eof:
            head, _, block = b"".join(out).partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            yield headers, block[: int(headers["Content-Length"])]
            rest, packed, out = packed.unused_data, unpacker.decompressobj(), []
        else:
            rest = b""
        rest = rest or stream.read(1 << 16)
    if out:
        raise ValueError("the file ends within a record")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of each record; digests of responses
    are of the payloads as read, and must be those in the headers."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payloads]

    def rows(path: str, store) -> Iterator[tuple]:
        number = lambda x: None if x is None else int(x)
        with store.open_input_stream(path, compression=None) as stream:
            for h, block in read_records(stream):
                if h["WARC-Type"] == "warcinfo":
                    continue
                payload = block.partition(b"\r\n\r\n")[2]
                digest, length = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                if h["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, length):
                    raise ValueError(f"{path}: the payload of page {h.get('X-Page-ID')} is damaged")
                yield (number(h.get("X-Page-ID")), length, digest, h["WARC-Type"], number(h.get("X-Refers-To-Page")), *[payload] * payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _file_system(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                some: list[tuple] = []
                for row in rows(path, store):
                    some.append(row)
                    if len(some) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)

    # one file a task, as far as there are tasks
    return manifest.select("path").repartition("path").mapInArrow(run, schema)


def with_first(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, first and first_url: where an equal payload of a smaller page_id stands, if any."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    known = rows.where((F.length("payload") >= least) & F.col("page_id").isNotNull())
    firsts = known.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "url")).alias("least")).where("n > 1")
    firsts = common.spool(firsts.select(F.col("digest").alias("same"), "least"), "warc-firsts")
    out = rows.join(firsts, rows["digest"] == firsts["same"], "left")
    later = F.col("page_id") > F.col("least.page_id")
    return out.select("page_id", "url", "payload", "digest", F.when(later, F.col("least.page_id")).alias("first"), F.when(later, F.col("least.url")).alias("first_url"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.shared_dir(spark, "op1-warc")
    manifest = write_archives(with_first(common.table(spark, sf_dir, "pages")), folder)
    return read_archives(manifest, folder)


#: The result that the archives must give back, in DuckDB SQL.
ORACLE_SQL = f"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT payload_digest, min(page_id) AS first FROM payloads WHERE payload_bytes >= {LEAST} GROUP BY payload_digest
)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM payloads p LEFT JOIN firsts f ON p.payload_digest = f.payload_digest
"""

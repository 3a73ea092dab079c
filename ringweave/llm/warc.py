"""WARC archives with a shared Zstandard dictionary.

Each task writes the records of its rows to one archive: a skippable frame that holds a dictionary
built from the archive's first records, then a frame per record, compressed with that dictionary, so a
reader can seek to any record. Records are buffered only until the dictionary is built.

Equal payloads: the digests (without payloads) are grouped, and the smallest page id of each is its
response; the others are revisit records that name it and carry no payload. Partial aggregation and a
join that can be split keep a payload shared by very many pages from making one large task.

An archive is written under a name of its own for each attempt, in the shared folder, and counts only
if the manifest lists it, so a lost executor or a repeated attempt leaves no wrong records behind.

Defined cases: a null html is an empty payload, a null url an empty target; rows with a null page id
are archived as records without one, never as an original; repeated rows with the smallest page id of
their payload are responses each, of which one in an archive has the id that revisits name
(WARC-Refers-To) and the others ids of their own; a payload is held whole by one task; other columns are
not read; payloads below `revisit_bytes` are always responses; an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_schema, shared_dir, staged

#: Fixed values of the WARC and Zstandard formats.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_MAGIC = 0x184D2A5D
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, url string, payload binary"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, own: str = "") -> str:
    """The id of the record of a page with that payload; own tells repeated rows apart."""
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id} {digest} {own}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, own: str = "") -> bytes:
    """One WARC record: a response, or a revisit if refers_to is given."""
    digest = digest_of(payload)
    url = (url or "").replace("\r", " ").replace("\n", " ")
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, own)),
        ("WARC-Target-URI", url),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record; its payload is checked against the digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0].encode() != VERSION:
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    named = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    block = rest[: int(named["Content-Length"])]
    if f"sha1:{digest_of(block)}" != named["WARC-Block-Digest"]:
        raise ValueError(f"damaged block in {named['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit = named["WARC-Type"] == "revisit"
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged payload in {named['WARC-Record-ID']}")
    page, refers = named.get("X-Page-Id"), named.get("X-Refers-To-Page-Id")
    return {
        "page_id": None if page is None else int(page),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": named["WARC-Type"],
        "refers_to": None if refers is None else int(refers),
        "record_id": named["WARC-Record-ID"],
        "refers_to_record": named.get("WARC-Refers-To"),
        "url": named.get("WARC-Target-URI", ""),
        "payload": None if revisit else payload,
    }


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes records to a stream as a dictionary frame followed by a frame per record."""

    def __init__(self, out, *, level: int = 3, dictionary_bytes: int = 64_000, train_bytes: int = 2_000_000):
        self.out, self.level, self.dictionary_bytes, self.train_bytes = out, level, dictionary_bytes, train_bytes
        self.waiting: list[bytes] | None = []
        self.size = 0

    def write(self, data: bytes) -> None:
        if self.waiting is None:
            self.out.write(self.compressor.compress(data))
            return
        self.waiting.append(data)
        self.size += len(data)
        if self.size >= self.train_bytes:
            self._begin()

    def _begin(self) -> None:
        samples = [s[i : i + 8192] for s in self.waiting for i in range(0, len(s), 8192)]
        try:
            built = zstd.train_dictionary(self.dictionary_bytes, samples).as_bytes() if len(samples) > 8 else b""
        except zstd.ZstdError:  # too few or too uniform samples to build from
            built = b""
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(built)) + built)
        self.compressor = zstd.ZstdCompressor(level=self.level, dict_data=zstd.ZstdCompressionDict(built) if built else None)
        waiting, self.waiting = self.waiting, None
        for data in waiting:
            self.write(data)

    def close(self) -> None:
        if self.waiting is not None:
            self._begin()
        self.out.close()


def records(stream, step: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    built = stream.read(size)
    reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(built) if size else None)
    rest = b""
    while True:
        one, parts = reader.decompressobj(), []
        while not one.eof:
            rest = rest or stream.read(step)
            if not rest:
                if parts:
                    raise ValueError("the archive ends within a record")
                return
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield b"".join(parts)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Archives every row under `folder`; returns the manifest (path, records), written and read back."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    digests = rows.where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= revisit_bytes)).select("page_id", F.sha1("payload").alias("sha1"))
    firsts = digests.groupBy("sha1").agg(F.min("page_id").alias("first"))
    later = digests.distinct().join(firsts, "sha1").where(F.col("first") != F.col("page_id")).select("page_id", F.col("sha1").alias("later_sha1"), "first")
    # a page id may stand on rows with different payloads: the payload decides as well
    keyed = rows.withColumn("sha1", F.sha1("payload"))
    joined = keyed.join(later.hint("shuffle_hash"), (keyed.page_id == later.page_id) & (keyed.sha1 == later.later_sha1), "left").select(keyed.page_id, "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, n, seen = None, 0, set()
        for batch in batches:
            for page, url, payload, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                if writer is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    system, at = _file_system(path)
                    system.create_dir(at.rpartition("/")[0], recursive=True)
                    writer = Writer(system.open_output_stream(at, compression=None))
                page_id, data = page.as_py(), payload.as_py()
                # one of repeated rows has the id that revisits name, the others and rows without an id have their own
                one = (page_id, hashlib.sha1(data).digest())
                writer.write(record(page_id, url.as_py(), data, first.as_py(), date, f"{path} {n}" if page_id is None or one in seen else ""))
                seen.add(one)
                n += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([n], pa.int64())})

    return staged(joined.mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, *, payloads: bool = True, batch_bytes: int = 8_000_000) -> DataFrame:
    """Every record of the archives that the manifest lists; a truncated archive raises."""
    schema = arrow_schema(_RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = _file_system(path)
                found, held, n = [], 0, 0
                with system.open_input_stream(at, compression=None) as stream:
                    for data in records(stream):
                        one = parse(data)
                        held += len(one["payload"] or b"") + 200
                        if not payloads:
                            one["payload"] = None
                        found.append(one)
                        n += 1
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found, held = [], 0
                if n != expected:
                    raise ValueError(f"{path} has {n} records, not {expected}")
                yield pa.RecordBatch.from_pylist(found, schema)

    # by number: partitions of so few bytes would else be put together, and one task would read all archives
    return manifest.repartition(max(1, manifest.count()), "path").mapInArrow(run, _RECORD)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/ringweave-warc-{uuid.uuid4().hex}"
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archives(manifest, payloads=False).drop("record_id", "refers_to_record", "url", "payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""

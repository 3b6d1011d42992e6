"""WARC archives compressed record by record with a dictionary that each archive carries itself.

An archive begins with a skippable frame that holds a Zstandard dictionary, built from records spread over that archive.
Every record after it, the warcinfo record first, is one frame compressed with the dictionary: a record can be read from
its place alone, and any archive without the others. Pages with equal payloads are stored once: the page of the least id is
a response record, the others are revisit records of the profile for identical payloads, which keep the HTTP head.

Which payloads repeat is counted on digests, without the payloads, so a payload that a third of the pages share is one row
per task there; the rows then meet their digest's least id in a join that the adaptive plan splits where a digest is hot.
Archives are rows of a Parquet table in the shared folder, of about ``archive_bytes`` each, so that any store Spark writes
will do and a lost executor costs its own tasks; ``export`` writes them out as files.

Defined cases: a null payload is the empty one; payloads of fewer than ``least`` bytes are always responses; a null id comes
after all others, and where a payload has no other id its pages are all responses; every row that repeats the least id is a
response; a null url leaves the record without a target; control characters and spaces in a url are percent-encoded in the
header; an archive with too few records to build a dictionary has none and no skippable frame; an empty table gives no
archive; damaged archives raise ValueError; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm import common

# Fixed values of the formats.
VERSION = b"WARC/1.1\r\n"
SKIPPABLE = 0x184D2A5D  # magic number of the frame that holds a dictionary
DICTIONARY = 0xEC30A437  # magic number of a dictionary itself
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

LEAST = 100  # bytes from which equal payloads are stored once
ARCHIVE_BYTES = 32 << 20  # of records, uncompressed, after which an archive is closed
DICTIONARY_BYTES, SAMPLES, SAMPLE_BYTES = 64 << 10, 400, 16 << 10  # of a dictionary, records it is built from, bytes of each
LEVEL = 3
WINDOW = 16 << 10  # bytes handed to the decompressor at a time when the length of a frame is not known
ROWS = 256


def record(kind: str, name: str, fields: dict[str, str | None], block: bytes, content_type: str, date: str) -> bytes:
    """One record: version line, header fields (those with a value), block and two line ends."""
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{name}>", "WARC-Date": date, **fields, "Content-Type": content_type, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"".join([VERSION, lines.encode("utf-8", "surrogatepass"), b"\r\n", block, b"\r\n\r\n"])


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(VERSION) or end < 0:
        raise ValueError("not a WARC record")
    lines = data[len(VERSION) : end].decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(fields["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("length of the block")
    return fields, block


def _name(archive: str, at: int) -> str:
    return str(uuid.uuid5(uuid.UUID(archive), str(at)))


_ODD = re.compile("[\x00-\x20\x7f]")


def _uri(url: str | None) -> str | None:
    return None if url is None else _ODD.sub(lambda m: quote(m[0]), url)


def dictionary(records: list[bytes]) -> bytes | None:
    """A dictionary from records spread over the archive; none if they are too few to build one."""
    step = max(1, len(records) // SAMPLES)
    samples = [r[:SAMPLE_BYTES] for r in records[::step]]
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, records)) // 32)), samples, k=512, d=8, steps=1).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


def pack(records: list[bytes], trained: bytes | None) -> tuple[bytes, list[int]]:
    """The archive of some records, and where each begins; the dictionary itself is compressed, as the format allows, if that is shorter."""
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True)
    out, places = [], []
    at = 0
    if trained:
        held = min(trained, zstandard.ZstdCompressor(level=LEVEL).compress(trained), key=len)
        out.append(struct.pack("<II", SKIPPABLE, len(held)) + held)
        at = len(out[0])
    for r in records:
        out.append(compressor.compress(r))
        places.append(at)
        at += len(out[-1])
    return b"".join(out), places


def reader(archive: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """A decompressor with the archive's dictionary, and where its first record begins."""
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", archive, 4)[0]
        held = archive[8 : 8 + size]
        if len(held) == size >= 4:
            if held[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):  # the format allows a compressed dictionary
                held = zstandard.ZstdDecompressor().decompress(held)
            if held[:4] == struct.pack("<I", DICTIONARY):
                return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)), 8 + size
        raise ValueError("damaged dictionary")
    return zstandard.ZstdDecompressor(), 0


def record_at(archive: bytes, at: int, decompressor: zstandard.ZstdDecompressor | None = None) -> tuple[bytes, int]:
    """The record that begins at a place, and where the next one does."""
    frame, out = (decompressor or reader(archive)[0]).decompressobj(), []
    try:
        while not frame.eof:
            if at >= len(archive):
                raise ValueError("cut short")
            out.append(frame.decompress(archive[at : at + WINDOW]))
            at += min(WINDOW, len(archive) - at)
    except zstandard.ZstdError as e:
        raise ValueError(f"damaged record: {e}") from e
    return b"".join(out), at - len(frame.unused_data)


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and blocks of all records in order."""
    decompressor, at = reader(archive)
    while at < len(archive):
        data, at = record_at(archive, at, decompressor)
        yield parse(data)


def planned(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``id``, ``url``, ``payload``, ``digest`` and, for what revisits another page, ``first_id``; ``revisit`` says which rows do."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    shared = F.octet_length("payload") >= least
    firsts = rows.filter(shared).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # Payloads below the bound join nothing: their own id as key spreads them.
    key = F.when(shared, F.col("digest"))
    met = rows.withColumn("key", F.coalesce(key, F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string")))).join(
        firsts.withColumnRenamed("digest", "key"), "key", "left"
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("id"))
    return met.select("id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("first_id"), revisit.alias("revisit"))


def write_archives(plan: DataFrame, archive_bytes: int = ARCHIVE_BYTES, date: str = "1970-01-01T00:00:00Z", software: str = "wayline") -> DataFrame:
    """Write the rows of ``planned`` as archives; returns ``part``, ``seq``, ``n_records``, ``archive`` read back from the shared folder."""
    rows = plan.select(F.col("id").cast("string"), "url", "payload", "digest", F.col("first_id").cast("string"), "revisit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, total, held = TaskContext.get().partitionId(), 0, 0, []

        def close() -> pa.RecordBatch:
            data, _ = pack(held, dictionary(held))
            return pa.record_batch([[part], [seq], [len(held)], pa.array([data], pa.binary())], ["part", "seq", "n_records", "archive"])

        name = None
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                for key, url, payload, digest, first, revisit in zip(*(c.to_pylist() for c in whole.slice(lo, ROWS).columns), strict=True):
                    if not held:
                        name = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{digest} {key} {part} {seq}"))
                        about = f"software: {software}\r\nformat: WARC File Format 1.1\r\n".encode()
                        held.append(record("warcinfo", name, {"WARC-Filename": f"part-{part:05d}-{seq:05d}.warc.zst"}, about, "application/warc-fields", date))
                    fields = {"WARC-Target-URI": _uri(url), "WARC-Warcinfo-ID": f"<urn:uuid:{name}>", "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-ID": None if key is None else quote(key)}
                    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                    if revisit:
                        fields |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": quote(first)}
                        block = http
                    else:
                        block = http + payload
                    kind = "revisit" if revisit else "response"
                    held.append(record(kind, _name(name, len(held)), fields, block, "application/http; msgtype=response", date))
                    total += len(held[-1])
                    if total >= archive_bytes:
                        yield close()
                        seq, total, held = seq + 1, 0, []
        if held:
            yield close()

    return common.written(rows.mapInArrow(run, "part long, seq long, n_records long, archive binary"), "archives")


def read_archives(store: DataFrame, id_type: str = "long") -> DataFrame:
    """The pages of archives: ``page_id``, ``url``, ``payload_bytes`` and ``payload_digest`` of the whole payload, ``record_type``, ``refers_to``, ``payload`` (null for revisits).

    A response's payload must have the digest and the length that its headers say.
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

    def page(fields: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(b"\r\n\r\n")
        size = next(int(line.partition(b":")[2]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError("payload differs from its digest")
        key, first = (None if v is None else unquote(v) for v in (fields.get("x-page-id"), fields.get("x-refers-to-page-id")))
        return key, fields.get("warc-target-uri"), size, digest, kind, first, payload if kind == "response" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*held, strict=True), types, strict=True)], names)

        held, chars = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                for fields, block in records(batch.column(0)[k].as_py()):
                    if fields["warc-type"] != "warcinfo":
                        held.append(page(fields, block))
                        chars += len(block)
                        if len(held) == ROWS or chars > 8 << 20:
                            yield out()
                            held, chars = [], 0
        if held:
            yield out()

    found = store.select("archive").mapInArrow(
        run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary"
    )
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def export(store: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file of ``folder``, which driver and executors must share; returns ``file`` and ``n_records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for part, seq, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = os.path.join(folder, f"part-{part:05d}-{seq:05d}.warc.zst")
                with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(data)
                os.replace(f.name, path)  # a task that runs twice leaves one whole file
                yield pa.record_batch([[path], [n]], ["file", "n_records"])

    return store.select("part", "seq", "n_records", "archive").mapInArrow(run, "file string, n_records long")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    store = write_archives(planned(pages))
    found = read_archives(store, pages.schema["page_id"].dataType.simpleString())
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), d AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to
FROM (SELECT *, payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id AS again FROM d)
"""

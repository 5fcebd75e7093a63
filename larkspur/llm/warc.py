"""WARC archives compressed record by record with a Zstandard dictionary.

An archive is a row of volumes. A volume starts with its dictionary in a skippable frame (magic
184D2A5D), followed by one frame for each record, so that a record can be read on its own. The dictionary
is built from the records of its own volume, which therefore needs nothing from outside. Volumes are
written by Spark's text writer, one row to a file, under its commit protocol: the line separator is an
empty skippable frame (8 ASCII bytes), so the file is a valid ``.warc.zst`` throughout, on any file system
that Spark writes to. Reading takes one file at a time; ``VOLUME_BYTES`` bounds a volume, unless a single
record is larger.

Of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with the largest id is a response
and the others are revisits that carry no payload. Equality is by SHA-256 and length; the group sizes are
aggregated before they are shuffled, only groups of two or more are joined back, and the join is an
ordinary one, broadcast when the written table is small and split by AQE where a payload is hot.

Defined results: null html is the empty payload. A null id is always a response and never referred to.
Rows that repeat the largest id are all responses. A null url is written as an empty target. A payload of any length
is one record, whole; one beyond ``VOLUME_BYTES`` has a volume to itself. An empty table gives an archive without records. Only the
named columns are read, so that others may have any names.
"""

from __future__ import annotations

import base64
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import materialise, scratch, utf8

MIN_REVISIT = 1000
VOLUME_BYTES = 16 << 20  # of uncompressed records
DICT_BYTES = 64 << 10
DICT_MAGIC = 0x184D2A5D
EMPTY_FRAME = b"P*M\x18\0\0\0\0"  # a skippable frame of no bytes: 50 2A 4D 18, size 0
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, payload, sha1, refers_to``: refers_to is null for responses."""
    payload = F.coalesce(F.col(f"`{html_col}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    size = F.octet_length("payload")
    keyed = rows.withColumn("_key", F.when((size >= MIN_REVISIT) & F.col("page_id").isNotNull(), F.sha2("payload", 256)))
    groups = keyed.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.max("page_id").alias("_top"), F.min("page_id").alias("_low"))
    groups = materialise(groups.filter("_top > _low").select("_key", "_top"), "copies")
    joined = keyed.join(groups, "_key", "left")
    return joined.select("page_id", "url", "payload", F.sha1("payload").alias("sha1"), F.when(F.col("page_id") < F.col("_top"), F.col("_top")).alias("refers_to"))


def _record(page_id, url: bytes, payload: bytes, sha1: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(url.decode("utf-8", "replace").split()),
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(),
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """Trained on the records, or their first bytes as they are (also a Zstandard dictionary) where these are too few
    or too much alike to be trained on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, records, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(r[: DICT_BYTES // len(records)] for r in records)


def build_volume(records: list[bytes]) -> bytes:
    """Dictionary frame and a frame for each record."""
    raw = dictionary(records)
    kind = zstandard.ZstdCompressionDict(raw) if raw else None
    press = zstandard.ZstdCompressor(level=3, dict_data=kind, write_content_size=True)
    return struct.pack("<II", DICT_MAGIC, len(raw)) + raw + b"".join(press.compress(r) for r in records)


def read_volume(data: bytes):
    """Records of a volume, one after another."""
    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("a volume starts with its dictionary")
    raw = data[8 : 8 + size]
    kind = zstandard.ZstdCompressionDict(raw) if raw else None
    reader = zstandard.ZstdDecompressor(dict_data=kind).stream_reader(memoryview(data)[8 + size :], read_across_frames=True)
    text, at = reader.readall(), 0
    while at < len(text):
        block = text.index(b"\r\n\r\n", at) + 4
        length = int(text[text.rindex(b"Content-Length: ", at, block) + 16 : block - 4])
        yield text[at : (at := block + length + 4)]


def write_warc(pages: DataFrame, path: str | None = None, **columns: str) -> str:
    """Write every row as a record; gives the folder of the archive."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")

    def volumes(batches):
        held, size = [], 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, sha1, refers_to = (c[i].as_py() for c in cols)
                held.append(record := _record(page_id, url.encode(), payload, sha1, refers_to))
                size += len(record)
                if size >= VOLUME_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([build_volume(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([build_volume(held)], pa.binary())], ["value"])

    rows = mark_revisits(pages, **columns).mapInArrow(volumes, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_FRAME.decode()).option("maxRecordsPerFile", 1).text(path)
    return path


def _parse(record: bytes):
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:] if b": " in x)
    block = block[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    number = lambda v: int(v[10:-1]) if v and v[10:-1] else None
    return number(fields[b"WARC-Record-ID"]), length, base64.b32decode(fields[b"WARC-Payload-Digest"][5:]).hex(), fields[b"WARC-Type"].decode(), number(fields.get(b"WARC-Refers-To")), fields.get(b"WARC-Target-URI", b""), payload


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record, and, if asked
    for, ``url`` and ``payload`` (null for revisits). The digest of a response is computed from what was
    read and must agree with the header."""
    import hashlib

    def rows(batches):
        for batch in batches:
            for data in utf8(batch, "content"):
                out = []
                for record in read_volume(data):
                    got = _parse(record)
                    if got[3] == "response" and (hashlib.sha1(got[6]).hexdigest() != got[2] or len(got[6]) != got[1]):
                        raise ValueError(f"record {got[0]}: payload does not match its digest")
                    out.append((*got[:5], got[5].decode("utf-8", "replace"), got[6] if got[3] == "response" else None) if payloads else got[:5])
                cols = list(zip(*out, strict=True)) if out else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string(), pa.binary()] * payloads
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(rows, schema)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    return read_warc(spark, write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet")), payloads=False)


OP2_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, sha256(b) AS k FROM p),
g AS (SELECT *, CASE WHEN n >= {MIN_REVISIT} THEN max(page_id) OVER (PARTITION BY k) END AS top FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM g
"""

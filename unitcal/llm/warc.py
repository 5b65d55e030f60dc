"""WARC archives with a Zstandard dictionary.

A dictionary is trained on records of the archive and stands, in a skippable frame, at the
head of each file; every record is a frame of its own that is compressed with it.  Spark's text
sink writes the files (see ``files``): the separator after each record is an empty skippable
frame, which every Zstandard reader passes over.

Of records with equal payloads (same SHA-256) the one with the smallest page id is a response, the
others are revisits that name it.  First ids come from an aggregate with partial combine, so
a payload that a third of the pages share is one row when it is joined.

Defined cases: NULL html is an empty payload; rows that repeat the smallest page id of a payload are
responses too; a NULL page id comes after all others and is written as an empty id; NULL urls are written empty; an
empty table gives no record; other columns are not read.
"""

from __future__ import annotations

import base64
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitcal.llm.files import read_files, write_blobs
from unitcal.llm.shared import Batches, drop
from unitcal.session import stage

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"  # skippable frame 0 of length 0; plain ASCII
ZSTD_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

DICTIONARY_BYTES = 112_640
#: Records that the dictionary is trained on: those with the smallest hashes of all.
TRAINED_ON = 2_000
TRAINED_BYTES = 100 * DICTIONARY_BYTES
FILE_BYTES = 64 << 20
LEVEL = 3

RECORD = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string,"
    " refers_to bigint, payload binary"
)


def identified(pages: DataFrame) -> DataFrame:
    """Add payload, its digest, and the first id of its equals."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    return pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "same": F.sha2("payload", 256), "sha1": F.unhex(F.sha1("payload")),
    })


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(kind: str, page_id, url, size: int, sha1: bytes, more: list[tuple[str, str]], body: bytes) -> bytes:
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(sha1).decode()),
        ("WARC-Payload-Length", str(size)),
        *more,
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(body))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def make_revisit(page_id, url, size: int, sha1: bytes, first_id) -> bytes:
    """The WARC record of a page whose payload of ``size`` bytes is that of page ``first_id``."""
    more = [("WARC-Refers-To", record_id(first_id)), ("WARC-Profile", REVISIT_PROFILE)]
    return record("revisit", page_id, url, size, sha1, more, b"")


def make_record(page_id, url, payload: bytes, sha1: bytes, first_id) -> bytes:
    """One WARC record; a revisit of ``first_id`` unless that is the page's own id."""
    if page_id != first_id:
        return make_revisit(page_id, url, len(payload), sha1, first_id)
    return record("response", page_id, url, len(payload), sha1, [], payload)


def train_dictionary(pages: DataFrame, count: int) -> bytes:
    """A dictionary from the records with the smallest hashes among ``count``, at most ``TRAINED_BYTES`` in all.

    Empty where there is too little to train on; the archive is then written without.
    """
    hashed = F.xxhash64("same", "page_id")
    # a bound from the count, so that not much more than the sample leaves the tasks
    bound = min((1 << 63) - 1, int(1.5 * TRAINED_ON / max(1, count) * (1 << 64)) - (1 << 63))
    sample = pages.filter(hashed <= bound).orderBy(hashed).limit(TRAINED_ON).select(
        F.substring("payload", 1, TRAINED_BYTES // TRAINED_ON).alias("payload"), "page_id", "url", "sha1"
    )
    samples = [make_record(r.page_id, r.url, bytes(r.payload), bytes(r.sha1), r.page_id) for r in sample.toLocalIterator()]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as .warc.zst files of about ``file_bytes`` of payload each."""
    known = identified(pages)
    ids = stage(known.select("page_id", "same", F.length("payload").alias("size")))
    firsts = ids.groupBy("same").agg(F.min("page_id").alias("first_id"))
    total, count = ids.agg(F.sum("size"), F.count("*")).first()
    files = max(1, -(-(total or 0) // file_bytes))
    dictionary = train_dictionary(known, count)

    def packer() -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=True)

    def responses(batches: Batches) -> Batches:
        pack = packer()
        for batch in batches:
            blobs = [pack.compress(make_record(i, url, payload, sha1, i)) for i, url, payload, sha1 in zip(*(batch.column(i).to_pylist() for i in range(4)))]
            sizes = pa.array([len(p) for p in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), batch.column(4), sizes, pa.array(blobs, pa.binary())],
                names=["page_id", "url", "sha1", "same", "size", "blob"],
            )

    def archived(batches: Batches) -> Batches:
        pack, begun = packer(), False
        for batch in batches:
            blobs = [] if begun or not dictionary else [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary]
            begun = True
            for blob, *row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                blobs.append(blob or pack.compress(make_revisit(*row)))
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary())], names=["blob"])

    # records are compressed before they are exchanged, and a revisit leaves its payload behind at the join
    made = known.select("page_id", "url", "payload", "sha1", "same").mapInArrow(
        responses, "page_id bigint, url string, sha1 binary, same string, size bigint, blob binary"
    )
    response = F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = made.join(firsts, "same").select(
        F.when(response, F.col("blob")).alias("blob"), "page_id", "url", "size", "sha1", "first_id"
    )
    write_blobs(rows.repartition(files).mapInArrow(archived, "blob binary"), "blob", path, EMPTY_FRAME, ".warc.zst")
    drop(ids)


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard or skippable frame at ``at`` ends, from its headers alone."""
    magic, size = struct.unpack_from("<II", data, at) if at + 8 <= len(data) else (0, 0)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        return at + 8 + size
    if magic != ZSTD_MAGIC:
        raise ValueError("not a Zstandard frame")
    descriptor = data[at + 4]
    single = descriptor >> 5 & 1
    content = (1 if single else 0, 2, 4, 8)[descriptor >> 6]
    at += 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + content
    last = False
    while not last:
        block = int.from_bytes(data[at:at + 3], "little")
        last, kind, size = bool(block & 1), block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    return at + 4 * (descriptor >> 2 & 1)


def parse_record(record: bytes) -> tuple:
    """Fields of ``RECORD`` from one WARC record."""
    head, _, body = record.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = body[:int(headers["Content-Length"])]

    def page(name: str) -> int | None:
        value = headers.get(name, "")[len("<urn:page:"):-1]
        return int(value) if value else None

    revisit = headers["WARC-Type"] == "revisit"
    return (
        page("WARC-Record-ID"), headers["WARC-Target-URI"], int(headers["WARC-Payload-Length"]),
        headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"],
        page("WARC-Refers-To") if revisit else None, None if revisit else body,
    )


def records_of(data: bytes):
    """The records of one file, frame by frame."""
    unpack, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        end = frame_end(data, at)
        magic = struct.unpack_from("<I", data, at)[0]
        if magic == DICTIONARY_MAGIC:
            unpack = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(data[at + 8:end]))
        elif magic == ZSTD_MAGIC:
            yield parse_record(unpack.decompress(data[at:end]))
        at = end


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records below ``path``, with the columns of ``RECORD``; a revisit has no payload."""
    names = [f.split()[0] for f in RECORD.split(",")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                for row in records_of(data):
                    rows.append(row)
                    size += len(row[-1] or b"") + 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return read_files(spark, path).select("content").mapInArrow(run, RECORD)

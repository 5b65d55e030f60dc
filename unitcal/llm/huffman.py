"""Token ids on disk: canonical length-limited Huffman coding from global counts.

Writing takes two passes.  The first encodes the texts and stages the ids; Spark sums the
counts of each id over all documents, and the package-merge method turns them into code
lengths of at most ``LIMIT`` bits.  The second codes every document (its bits start at a byte)
and deals the coded documents to files by ranges of the document id, each file in ascending
order.  The lengths alone fix the codes, so the code book is one byte per id.

A file is a row of blocks, each of which decodes on its own:

    magic, docs, ids, payload bytes, bytes of the deflated tables     (u4 each)
    tables: document ids (i8), NULL marks (u1), ids of each document (i8), bytes of its bits (i8),
            bit offsets of its checkpoints, one after every ``STEP`` ids (u8)
    payload: the bits of the documents, one after the other
    end mark (8 bytes)

Decoding reads all stretches between checkpoints of a block side by side: per step one table
look-up of the next ``LIMIT`` bits gives each stretch's next id and how far it moves on.

Defined cases: a NULL text is empty, so its document is the end id alone; a NULL document id
comes before all others; repeated rows are stored as often as they occur; an empty table gives
a code book and no document; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitcal.llm.files import read_files, write_blobs
from unitcal.llm.shared import Batches, in_arrow
from unitcal.llm.tokens import encoder
from unitcal.session import new_path

LIMIT = 20  # longest code in bits
STEP = 512  # ids from one checkpoint to the next
CODED_AT_ONCE = 1 << 18  # ids whose bits are made together, to the end of a document
BLOCK_IDS = 1 << 18  # a block ends with the document that reaches this
END_MARK = "ENDBLOCK"
BLOCK_MAGIC = 0x4B4C4248
BOOK_MAGIC = b"HBOK"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids without a count."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n = len(order)
    # A package's ids are the first so many of each level, so one number per level is enough.
    levels = []
    merged, is_leaf = weight, np.ones(n, bool)
    levels.append(is_leaf)
    for _ in range(limit - 1):
        pairs = len(merged) // 2
        packages = merged[0:2 * pairs:2] + merged[1:2 * pairs:2]
        both = np.concatenate([weight, packages])
        is_leaf = np.concatenate([np.ones(n, bool), np.zeros(pairs, bool)])
        by_weight = np.argsort(both, kind="stable")
        merged, is_leaf = both[by_weight], is_leaf[by_weight]
        levels.append(is_leaf)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    long = lengths[order].astype(np.int64)
    # Each code is the sum of the widths of those before it, as a fraction of 2**LIMIT.
    ends = np.cumsum(np.int64(1) << (LIMIT - long))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    codes[order] = (starts >> (LIMIT - long)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every next ``LIMIT`` bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    width = np.int64(1) << (LIMIT - lengths[order].astype(np.int64))
    symbols = np.zeros(1 << LIMIT, np.uint32)
    steps = np.zeros(1 << LIMIT, np.uint8)
    total = int(width.sum())
    symbols[:total] = np.repeat(order, width)
    steps[:total] = np.repeat(lengths[order], width)
    return symbols, steps


def pack_bits(codes: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, total_bits: int) -> bytes:
    """The codes at ascending bit offsets; gaps are shorter than a byte."""
    words = np.zeros(total_bits // 64 + 2, ">u8")
    if len(codes):
        at = offsets >> 6
        inside = offsets & 63
        over = inside + lengths - 64  # bits that go to the next word
        left = np.where(over > 0, 0, -over).astype(np.uint64)
        right = np.where(over > 0, over, 0).astype(np.uint64)
        first = np.where(over > 0, codes >> right, codes << left)
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        native = np.zeros(len(words), np.uint64)
        native[at[starts]] = np.add.reduceat(first, starts)
        cross = np.flatnonzero(over > 0)
        native[at[cross] + 1] |= codes[cross] << (np.uint64(64) - right[cross])
        words[:] = native
    return words.tobytes()[: -(-total_bits // 8)]


def code_documents(ids: list[np.ndarray], codes: np.ndarray, lengths: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Bits of each document and the bit offsets of its checkpoints (u8)."""
    counts = np.array([len(i) for i in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    length = lengths[flat].astype(np.int64)
    cum = np.concatenate([[0], np.cumsum(length)])
    ends = np.cumsum(counts)
    begins = ends - counts
    doc_bits = cum[ends] - cum[begins]
    doc_bytes = -(-doc_bits // 8)
    byte_end = np.cumsum(doc_bytes)
    byte_start = byte_end - doc_bytes
    within = cum[:-1] - np.repeat(cum[begins], counts)
    offsets = np.repeat(8 * byte_start, counts) + within
    bits = pack_bits(codes[flat], length, offsets, int(8 * byte_end[-1]) if ids else 0)
    return [
        (bits[s:e], within[b:b + n][STEP::STEP].astype("<u8").tobytes())
        for s, e, b, n in zip(byte_start.tolist(), byte_end.tolist(), begins.tolist(), counts.tolist())
    ]


def decode_stretches(payload: bytes, offsets: np.ndarray, counts: np.ndarray, book) -> np.ndarray:
    """Ids of stretches that start at bit offsets, ``counts`` ids each, put one after the other."""
    symbols, steps = book
    raw = np.frombuffer(payload + bytes(8), np.uint8)
    out = np.zeros(int(counts.sum()), np.uint32)
    put = np.cumsum(counts) - counts
    by_count = np.argsort(-counts, kind="stable")
    position, put, left = offsets[by_count].astype(np.int64), put[by_count], counts[by_count]
    # lanes stay sorted by what is left, so the live ones are always the first
    live_at = np.searchsorted(-left, -np.arange(1, int(left.max()) + 1 if len(left) else 1), side="right")
    for step, live in enumerate(live_at.tolist()):
        p = position[:live]
        byte = p >> 3
        window = (
            (raw[byte].astype(np.uint32) << 24) | (raw[byte + 1].astype(np.uint32) << 16)
            | (raw[byte + 2].astype(np.uint32) << 8) | raw[byte + 3]
        )
        window = (window << (p & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
        out[put[:live] + step] = symbols[window]
        position[:live] = p + steps[window]
    return out


def make_block(docs: list, counts: list[int], bits: list[bytes], checkpoints: list[bytes]) -> bytes:
    tables = zlib.compress(
        np.array([d or 0 for d in docs], "<i8").tobytes()
        + np.array([d is None for d in docs], np.uint8).tobytes()
        + np.array(counts, "<i8").tobytes()
        + np.array([len(b) for b in bits], "<i8").tobytes()
        + b"".join(checkpoints),
        1,
    )
    payload = b"".join(bits)
    head = np.array([BLOCK_MAGIC, len(docs), len(payload), len(tables)], "<u4")
    return head.tobytes() + tables + payload


def read_blocks(content: bytes, book) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Document ids, their numbers of ids, and all ids, block by block."""
    view, at = memoryview(content), 0
    while at < len(content):
        magic, docs, size, tables = np.frombuffer(view[at:at + 16], "<u4").tolist()
        if magic != BLOCK_MAGIC:
            raise ValueError("not a block of token ids")
        at += 16
        packed = zlib.decompress(view[at:at + tables])
        at += tables
        ids = np.frombuffer(packed, "<i8", docs)
        null = np.frombuffer(packed, np.uint8, docs, 8 * docs)
        counts = np.frombuffer(packed[9 * docs:], "<i8", docs)
        lengths = np.frombuffer(packed[17 * docs:], "<i8", docs)
        checkpoints = np.frombuffer(packed[25 * docs:], "<u8").astype(np.int64)
        starts = 8 * (np.cumsum(lengths) - lengths)
        stretches = np.maximum(1, -(-counts // STEP))
        first = np.cumsum(stretches) - stretches
        offsets = np.repeat(starts, stretches)
        inner = np.ones(len(offsets), bool)
        inner[first] = False
        offsets[inner] += checkpoints
        many = np.full(len(offsets), STEP, np.int64)
        many[first + stretches - 1] = counts - STEP * (stretches - 1)
        flat = decode_stretches(bytes(view[at:at + size]), offsets, many, book)
        at += size + len(END_MARK)
        yield [None if n else int(d) for d, n in zip(ids, null)], counts, flat


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int = 0, file_bytes: int = 64 << 20
) -> None:
    """Encode ``docs`` (doc_id, text), end each with ``end_id``, and write them below ``path``.

    ``vocabulary`` is the number of ids; the counts and the code book have one entry per id, which
    bounds what goes to the driver.  ``file_bytes`` of text go to one file.
    """
    spark = docs.sparkSession
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, end = batch.column(1), np.array([end_id], "<i4").tobytes()
        ids = [np.frombuffer(i + end, "<i4").astype(kind).tobytes() for i in encoder(tokenizer).encode(texts)]
        sizes = pc.fill_null(pc.utf8_length(texts), 0).cast(pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.binary()), sizes],
            names=["doc_id", "ids", "size"],
        )

    staged_path = new_path(spark, "ids")
    in_arrow(docs.select("doc_id", "text"), encode, "doc_id bigint, ids binary, size bigint", remembers=True).write.option(
        "compression", "zstd"
    ).parquet(staged_path)
    staged = spark.read.schema("doc_id bigint, ids binary, size bigint").parquet(staged_path)

    def count(batches: Batches) -> Batches:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            together: list[bytes] = []
            size = 0
            for ids in batch.column(0).to_pylist():
                together.append(ids)
                size += len(ids)
                if size >= 4 * CODED_AT_ONCE:
                    total += np.bincount(np.frombuffer(b"".join(together), kind), minlength=vocabulary)
                    together, size = [], 0
            total += np.bincount(np.frombuffer(b"".join(together), kind), minlength=vocabulary)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"]
        )

    counts = np.zeros(vocabulary, np.int64)
    for row in staged.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    book = spark.createDataFrame(
        [(bytearray(BOOK_MAGIC + zlib.compress(lengths.tobytes())),)], "blob binary"
    ).coalesce(1)
    write_blobs(book, "blob", f"{path}/book", END_MARK, ".book")

    size = staged.agg(F.sum("size")).first()[0] or 0
    files = max(1, -(-size // file_bytes))
    cuts = []
    if files > 1:
        shares = [i / files for i in range(1, files)]
        cuts = staged.agg(
            F.percentile_approx("doc_id", shares, 10 * max(1000, files)).alias("cuts")
        ).first().cuts or []
    cuts = np.array(cuts, np.int64)

    def code(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(i, kind) for i in batch.column(1).to_pylist()]
        coded: list[tuple[bytes, bytes]] = []
        start = size = 0
        for i, own in enumerate(ids):
            size += len(own)
            if size >= CODED_AT_ONCE or i == len(ids) - 1:
                coded += code_documents(ids[start:i + 1], codes, lengths)
                start, size = i + 1, 0
        keys = batch.column(0).to_pylist()
        place = [0 if k is None else int(np.searchsorted(cuts, k, side="left")) for k in keys]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(place, pa.int32()), batch.column(0), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([b for b, _ in coded], pa.binary()), pa.array([c for _, c in coded], pa.binary()),
            ],
            names=["file", "doc_id", "n", "bits", "checkpoints"],
        )

    def blocks(batches: Batches) -> Batches:
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
                for column, value in zip(held, row):
                    column.append(value)
                if sum(held[1]) >= BLOCK_IDS:
                    yield pa.RecordBatch.from_pydict({"blob": [make_block(*held)]})
                    held = ([], [], [], [])
        if held[0]:
            yield pa.RecordBatch.from_pydict({"blob": [make_block(*held)]})

    coded = in_arrow(
        staged.select("doc_id", "ids"), code,
        "file int, doc_id bigint, n bigint, bits binary, checkpoints binary", remembers=True,
    )
    by_file = coded.repartitionById(files, "file").sortWithinPartitions(F.asc_nulls_first("doc_id"))
    write_blobs(by_file.mapInArrow(blocks, "blob binary"), "blob", f"{path}/ids", END_MARK, ".ids")
    from unitcal.session import unstage

    unstage(spark, staged_path)


def read_book(spark: SparkSession, path: str) -> np.ndarray:
    """Code lengths of a written folder: one byte per id of the vocabulary."""
    content = read_files(spark, f"{path}/book").filter(F.length("content") > 0).first().content
    return np.frombuffer(zlib.decompress(content[len(BOOK_MAGIC):-len(END_MARK)]), np.uint8)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a written folder: (file, place, start_in_file, doc_id, n_tokens, ids).

    ``place`` counts the documents of a file and ``start_in_file`` their ids; ``ids`` are
    little-endian 32-bit integers.  Files are in ascending order of their names.
    """
    lengths = read_book(spark, path)

    def decode(batches: Batches) -> Batches:
        book = decode_table(lengths)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = place = 0
                for docs, counts, flat in read_blocks(content, book):
                    raw = flat.astype("<u4").tobytes()
                    ends = np.cumsum(counts)
                    begins = ends - counts
                    n = len(docs)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name.rsplit("/", 1)[1]] * n, pa.string()),
                            pa.array(np.arange(place, place + n), pa.int64()),
                            pa.array(start + begins, pa.int64()),
                            pa.array(docs, pa.int64()), pa.array(counts, pa.int64()),
                            pa.array([raw[4 * b:4 * e] for b, e in zip(begins.tolist(), ends.tolist())], pa.binary()),
                        ],
                        names=["file", "place", "start_in_file", "doc_id", "n_tokens", "ids"],
                    )
                    start += int(ends[-1]) if n else 0
                    place += n

    return read_files(spark, f"{path}/ids").mapInArrow(
        decode, "file string, place bigint, start_in_file bigint, doc_id bigint, n_tokens bigint, ids binary"
    )


def with_starts(docs: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before: totals of the files (one row each), then in-file."""
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("bigint")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    offsets = totals.select("file", F.coalesce(F.sum("in_file").over(before), F.lit(0)).alias("file_start"))
    return docs.join(offsets, "file").withColumn("start", F.col("file_start") + F.col("start_in_file"))

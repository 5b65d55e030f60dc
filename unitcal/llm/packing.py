"""Packing of tokenised documents into training sequences by first-fit decreasing.

Documents are dealt into randomised groups by a hash of their id and ids, so that groups
are alike and a source's documents spread over all of them.  A document longer than a
sequence is cut into full sequences and a rest.  Inside a group the rests are taken from
the longest to the shortest, each into the first sequence with room for it; a tournament
tree over the sequences' free room finds that one in logarithmic time.  Only lengths and
checksums are shuffled, never ids.

Defined cases: a NULL text is empty, so its document is one piece with the end id alone; a
NULL id is kept; repeated rows are packed as often as they occur; equal lengths go by id;
an empty table gives no piece; columns other than id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitcal.llm.shared import in_arrow
from unitcal.llm.tokens import encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class Rooms:
    """Tournament tree: every node holds the largest free room among the sequences below it."""

    def __init__(self, n: int, room: int) -> None:
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.best = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first sequence with room; its number and the room it had."""
        best, node = self.best, 1
        while node < self.leaves:
            node *= 2
            if best[node] < size:
                node += 1
        room = best[node]
        best[node] = room - size
        found = node - self.leaves
        while node > 1:
            node >>= 1
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node] = top
        return found, room


def first_fit_decreasing(sizes: list[int], room: int) -> list[tuple[int, int]]:
    """Bin and offset of each size; ``sizes`` come in descending order."""
    rooms = Rooms(len(sizes), room)
    placed = [rooms.place(size) for size in sizes]
    return [(found, room - free) for found, free in placed]


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """Pieces of at most ``length`` ids of every document, the end id counted."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        end = np.array([end_id], "<i4").tobytes()
        rows: list[list] = [[], [], [], [], []]
        for doc, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode(batch.column(1))):
            ids += end
            n = len(ids) // 4
            for start in range(0, n, length):
                part = ids[4 * start:4 * (start + length)]
                for column, value in zip(rows, (doc, start, len(part) // 4, zlib.crc32(part), n)):
                    column.append(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(r, pa.int64()) for r in rows],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
        )

    return in_arrow(docs.select("doc_id", "text"), step, PIECES, remembers=True)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    length: int = 2048,
    group_docs: int = 4096,
) -> DataFrame:
    """Place every piece of every document: ``PIECES`` with ``sequence_id`` and ``offset``.

    ``group_docs`` is the mean number of documents of a group; a group's pieces are packed by
    one task, so it bounds that task's memory.  Sequence ids hold the group in the upper bits.
    """
    groups = max(1, -(-docs.count() // group_docs))
    pieces = cut_pieces(docs, tokenizer, end_id, length).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(groups))
    )

    def place(table: pa.Table) -> pa.Table:
        by_size = [("length", "descending")] + [(c, "ascending") for c in ("doc_id", "start", "ids_crc32")]
        table = table.sort_by(by_size)
        placed = first_fit_decreasing(table["length"].to_pylist(), length)
        first = table["part"][0].as_py() << 32
        return table.drop_columns("part").append_column(
            "sequence_id", pa.array([first + b for b, _ in placed], pa.int64())
        ).append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    return pieces.groupBy("part").applyInArrow(place, PIECES + ", sequence_id bigint, offset bigint")


def padding(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """Sequences, ids and padding of a packing.

    A sequence is padded to ``length`` unless it holds a power of two of ids already.
    """
    filled = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count("n") == 1
    return filled.agg(
        F.count("*").alias("sequences"),
        F.sum("n").alias("ids"),
        F.sum(F.when(power, 0).otherwise(length - F.col("n"))).alias("padding"),
    )

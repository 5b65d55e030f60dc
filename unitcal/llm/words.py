"""Words of whole texts, split by Arrow and numbered by their distinct values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split at a time, where texts are taken in runs.
RUN = 4_000_000


def byte_table(blank: bytes) -> bytes:
    """A table for ``bytes.translate``: A-Z become a-z, the bytes of ``blank`` become spaces."""
    table = bytearray(range(256))
    for upper in range(ord("A"), ord("Z") + 1):
        table[upper] = upper + 32
    for b in blank:
        table[b] = 32
    return bytes(table)


def runs(texts: pa.Array, size: int = RUN) -> Iterator[slice]:
    """Slices of the texts of about ``size`` bytes, one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield slice(start, stop)
        start, done = stop, int(ends[stop - 1])


def split(texts: pa.Array, table: bytes) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of words of each text; NULL has none."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    _, offsets, data = texts.buffers()
    plain = (data.to_pybytes() if data else b"").translate(table)
    mapped = type(texts).from_buffers(len(texts), offsets, pa.py_buffer(plain))
    lists = pc.ascii_split_whitespace(mapped)
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64)])
    ends = lists.offsets.to_numpy().astype(np.int64)
    return flat.filter(real), np.diff(before[ends - ends[0]])


def numbered(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each word among the distinct words, and these."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

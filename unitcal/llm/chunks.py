"""Texts cut at blanks into chunks that a tokenizer encodes independently, each distinct one once.

The patterns of byte-level tokenizers join a blank to what follows it and never to what stands
before it, so a text may be cut in front of a single blank between two characters that are no white space: no
piece spans the cut, and no look-ahead at white space crosses it.  Elsewhere (runs of white space, and characters
whose bytes may be white space beyond ASCII) there is no cut, and such a chunk is only longer.  All of it
works on Arrow's buffers; Python sees the distinct chunks of a run of texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from unitcal.llm.words import numbered, runs

#: Bytes that begin no white space: not ASCII up to the blank, nor a first byte of other white space.
_AFTER = np.ones(256, bool)
_AFTER[:33] = False
_AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = False

#: For each place from the end of a character, the bytes there that show that it is no white space.
_BEFORE = np.zeros((4, 256), bool)
_BEFORE[0, 33:128] = True
_BEFORE[1, 0xC3:0xE0] = True
_BEFORE[2, 0xE4:0xF0] = True
_BEFORE[3, 0xF0:] = True


def places(data: np.ndarray) -> np.ndarray:
    """Places of the blanks in front of which UTF-8 bytes may be cut."""
    blanks = np.flatnonzero(data == 32)
    blanks = blanks[(blanks > 0) & (blanks < len(data) - 1)]
    blanks = blanks[_AFTER[data[blanks + 1]]]
    good = _BEFORE[0, data[blanks - 1]]
    other = np.flatnonzero(~good & (data[blanks - 1] >= 128))
    for back in (1, 2, 3):
        at = blanks[other] - 1 - back
        good[other] |= (at >= 0) & _BEFORE[back, data[np.maximum(at, 0)]]
    return blanks[good]


def cut(texts: pa.Array, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All chunks of the texts in order, and their number for each text; those in ``whole`` are one chunk."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_binary())])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    at = places(data)
    if whole.any():
        at = at[~whole[np.searchsorted(starts, at, side="right") - 1]]
    at = np.sort(np.concatenate([starts[starts < ends], at]), kind="stable")
    at = at[np.diff(at, prepend=-1) > 0]  # a text may begin with such a blank
    bounds = np.append(at, len(data)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return chunks, np.searchsorted(at, ends) - np.searchsorted(at, starts)


def listed(values: pa.Array) -> list[bytes]:
    """The values of a binary array."""
    _, offsets, data = values.buffers()
    if data is None:
        return [b""] * len(values)
    raw = data.to_pybytes()
    cuts = np.frombuffer(offsets, np.int64)[values.offset:values.offset + len(values) + 1].tolist()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def joined(values: list[bytes]) -> pa.Array:
    """A binary array of the values."""
    bounds = np.cumsum([0, *map(len, values)], dtype=np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(bounds), pa.py_buffer(b"".join(values))])


def gathered(values: pa.Array, at: np.ndarray) -> tuple[bytes | pa.Buffer, np.ndarray]:
    """The binary values at the given places joined to one buffer, and where each begins (and the last ends)."""
    taken = values.take(pa.array(at))
    _, offsets, data = taken.buffers()
    return data or b"", np.frombuffer(offsets, np.int64)[taken.offset:taken.offset + len(taken) + 1]


def encoded(
    texts: pa.Array, ids_of: Callable[[list[bytes]], list[bytes]], uncut: tuple[str, ...] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in order, and where each text's ids begin (and the last's end).

    ``ids_of`` gives the little-endian 32-bit ids of distinct chunks; texts with a string of ``uncut`` are one chunk.
    """
    flat, bounds = [np.zeros(0, "<i4")], [np.zeros(1, np.int64)]
    for part in runs(texts):
        some = texts[part]
        whole = np.zeros(len(some), bool)
        for string in uncut:
            whole |= pc.fill_null(pc.match_substring(some, string), False).to_numpy(zero_copy_only=False)
        chunks, n = cut(some, whole)
        codes, distinct = numbered(chunks)
        data, offsets = gathered(joined(ids_of(listed(distinct))), codes)
        ids = np.frombuffer(data, "<i4", count=int(offsets[-1] - offsets[0]) // 4, offset=int(offsets[0]))
        bounds.append(bounds[-1][-1] + (offsets[np.cumsum(n)] - offsets[0]) // 4)
        flat.append(ids)
    return np.concatenate(flat), np.concatenate(bounds)

"""Token ids of whole texts by a tokenizer of the ``tokenizers`` library.

Texts are cut into chunks that encode independently (``chunks``); the library encodes a distinct chunk once and not
for every occurrence, and each worker remembers the ids of the chunks it has met (and forgets them all at a
fixed number).  A text with the string of an added token goes to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from unitcal.llm.chunks import encoded
from unitcal.llm.shared import memory

#: Entries of a worker's memory; at most about 150 MB.
MEMORY = 700_000

#: Chunks that go to the library together.
SPANS = 20_000

#: Longer chunks are encoded each time and not remembered.
LONGEST_REMEMBERED = 64


class ChunkEncoder:
    """Encodes whole texts to little-endian 32-bit ids, remembering the ids of chunks."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        vocabulary = self.library.get_vocab()
        # a byte-level token is written with one character for each of its bytes
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.widths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.chunks: dict[bytes, bytes] = {}

    def spans(self, spans: list[str]) -> list[bytes]:
        """Ids of each span; the library gets them put together, in runs, and so must not join them."""
        out: list[bytes] = []
        for start in range(0, len(spans), SPANS):
            part = spans[start:start + SPANS]
            found = self.library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids
            ids = np.array(found, "<i4")
            ends = np.cumsum([len(s.encode()) for s in part])
            cuts = (4 * np.searchsorted(np.cumsum(self.widths[ids]), ends, side="right")).tolist()
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def single(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<i4").tobytes() for e in found]

    def plain(self, chunk: str) -> bool:
        """Whether a chunk may stand between others of its kind: a blank, then no white space at either end."""
        return (
            len(chunk) > 1 and chunk[0] == " " and not chunk[1].isspace() and not chunk[-1].isspace()
            and not any(a in chunk for a in self.added)
        )

    def ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each chunk."""
        out = list(map(self.chunks.get, chunks))
        if len(self.chunks) > MEMORY:
            self.chunks.clear()
        missing = [i for i, ids in enumerate(out) if ids is None]
        spans, alone = [], []
        for i in missing:
            chunk = chunks[i].decode()
            (spans if self.plain(chunk) else alone).append((i, chunk))
        for some, way in ((spans, self.spans), (alone, self.single)):
            for (i, _), ids in zip(some, way([chunk for _, chunk in some])):
                out[i] = ids
        self.chunks.update((chunks[i], out[i]) for i in missing if len(chunks[i]) <= LONGEST_REMEMBERED)
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """Ids of whole texts; NULL has none."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        flat, bounds = encoded(texts, self.ids_of, self.added)
        raw, cuts = memoryview(flat.astype("<i4", copy=False)).cast("B"), (4 * bounds).tolist()
        return [bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:])]


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a tokenizer file."""
    return memory(("ids", path), lambda: ChunkEncoder(path))

"""Byte-level BPE in linear time, and back.

A text falls into pieces by the tokenizer's pattern, and each piece into the tokens that merging
the pair of lowest rank, again and again, would leave.  They are found without merging:
an Aho-Corasick automaton over the vocabulary (bytes as Latin-1 characters) gives the longest token that
starts at a byte, which is tried first, and then the longest tokens that it begins with.  A token may follow another when merging the
bytes of the two alone gives these two again; the answers are remembered.  A sequence
in which all neighbours are compatible is the result of the merges, and the result is such a
sequence, so when no token fits, the last one is taken back and a shorter one tried.  An end
that failed once is not tried again: each prefix has only one result.  So the work is
linear in the bytes of the piece.  The new pieces of a run are gone through side by side, a step of
each at a time: longest tokens are looked up in the table of their prefixes, and neighbours are judged as columns.

Texts are cut into chunks at blanks (``chunks``), and each distinct chunk of a run of texts is looked at
once.  A worker remembers the ids of chunks and pieces it has met, up to a fixed number.  Ids are decoded by
gathering the tokens' bytes.

Defined cases: a NULL text is empty and has no ids; a piece that is a token itself is that token,
whatever the merges; ids without an entry in the vocabulary are refused; NULL ids have no bytes; repeated
rows and other columns pass through, but for columns of the names of the results, which are replaced; an empty
table stays empty; a text is whole in its task, however long.
"""

from __future__ import annotations

import base64
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitcal.llm.chunks import encoded, gathered

#: Chunks, pairs of tokens, and pieces of chunks of several that a worker remembers, of each kind; a chunk takes
#: about 200 bytes, the others less.
MEMORY = 700_000

#: Longer chunks and pieces are encoded each time.
LONGEST_REMEMBERED = 64

#: Pieces of up to so many bytes are encoded together, so many at a time; longer ones alone.
LONGEST_TOGETHER, TOGETHER = 62, 20_000

#: No byte of a piece, so no token spans two pieces that it stands between.
BETWEEN = 256

UNKNOWN = -2  # a shorter token that is yet to be looked for


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with one line per token: base64 of its bytes, and its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[bytes]:
    """The merges themselves: the pair of lowest rank, the first of equals, until none (``below`` a rank) is left."""
    below = len(ranks) + 1 if below is None else below
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= below:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Prefixes:
    """The prefixes of all tokens as nodes; a node's children lie in one table, a place of its own plus the next byte."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[tuple[int, int]] = []
        for token in ranks:
            node = 0
            for i in range(1, len(token) + 1):
                below = nodes.get(token[:i])
                if below is None:
                    below = nodes[token[:i]] = len(nodes)
                    edges.append((node, token[i - 1]))
                node = below
        self.token = np.array([ranks.get(prefix, -1) for prefix in nodes], np.int64)
        above, byte = np.array(edges, np.int64).reshape(-1, 2).T
        below = np.arange(1, len(nodes))
        size = 8 * len(nodes) + 512
        self.place, self.owner, self.target = np.zeros(len(nodes), np.int64), np.full(size + 512, -1), np.zeros(size + 512, np.int64)
        random = np.random.default_rng(0)
        left = np.arange(len(below))
        # nodes try places at random until no two share one; those with many children come first, while there is room
        many = np.bincount(above, minlength=len(nodes))[above]
        for least, most in ((65, 256), (17, 64), (5, 16), (2, 4), (1, 1)):
            some = left[(many >= least) & (many <= most)]
            while len(some):
                trying = np.unique(above[some])
                self.place[trying] = random.integers(0, size, len(trying))
                slot = self.place[above[some]] + byte[some]
                free = np.flatnonzero(self.owner[slot] < 0)
                self.owner[slot[free]] = above[some[free]]
                own = self.owner[slot] == above[some]
                failed = np.isin(above[some], above[some[~own]])
                self.owner[slot[failed & own]] = -1
                self.target[slot[~failed]] = below[some[~failed]]
                some = some[failed]

    def longest(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest token at each place of a text of numbers that ends with one above 255; -1 for none."""
        out, rows, node = np.full(len(at), -1), np.arange(len(at)), np.zeros(len(at), np.int64)
        while len(rows):
            slot = self.place[node] + text[at]
            on = np.flatnonzero(self.owner[slot] == node)
            rows, at, node = rows[on], at[on] + 1, self.target[slot[on]]
            token = self.token[node]
            given = token >= 0
            out[rows[given]] = token[given]
        return out


class Codec(dict):
    """piece -> little-endian 32-bit ids; also decodes ids."""

    def __init__(self, path: str, pattern: str) -> None:
        super().__init__()
        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        self.top = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes | None] = [None] * self.top
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.sizes = [len(token or b"") for token in self.bytes_of]
        self.shorter = [UNKNOWN] * self.top
        self.tokens = pa.array(self.bytes_of, pa.large_binary())
        self.given = self.tokens.is_valid().to_numpy(zero_copy_only=False)
        self.chunks: dict[bytes, bytes] = {}
        self.fits: dict[int, bool] = {}
        self.parts_of: dict[int, tuple[int, int] | None] = {}
        self.size_of = np.array(self.sizes, np.int64)
        self.prefixes = Prefixes(self.ranks)
        # the two parts of the tokens that were asked for (-1: of none), and all pairs of tokens that make a token
        self.halves = np.full((2, self.top), -1, np.int64)
        self.judged, self.n_judged = np.zeros(self.top, bool), 0
        self.shorter_of = np.full(self.top, UNKNOWN, np.int64)
        self.whole = {token: rank.to_bytes(4, "little") for token, rank in self.ranks.items()}
        get = self.ranks.get
        pairs = [
            (a * self.top + b, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
            if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None
        ]
        joins = np.array(sorted(pairs) or [(-1, 0)], np.int64)
        self.join_keys, self.join_ranks = np.ascontiguousarray(joins[:, 0]), np.ascontiguousarray(joins[:, 1])

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens leaves just the two."""
        key = a * self.top + b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > MEMORY:
                self.fits.clear()
            known = self.fits[key] = self.stay_apart(a, b)
        return known

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; a byte stands for itself; None if no merges lead to it."""
        if token not in self.parts_of:
            whole = self.bytes_of[token]
            if len(whole) == 1:
                self.parts_of[token] = token, token
            else:
                halves = merge(whole, self.ranks, token)
                made = len(halves) == 2 and None not in map(self.parts, map(self.ranks.__getitem__, halves))
                self.parts_of[token] = tuple(self.ranks[h] for h in halves) if made else None
        return self.parts_of[token]

    def stay_apart(self, left: int, right: int) -> bool:
        """Undo the merges of both tokens, the last one first, and look at the tokens at the seam.

        They were neighbours until the merge that was undone took place, so they would have merged
        if that had a lower rank (or, with that merge to their right, the same).
        """
        if self.parts(left) is None or self.parts(right) is None:
            return False
        until = self.top
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < until:
                return False
            # a byte has no merge to undo
            last_left = left if len(self.bytes_of[left]) > 1 else -1
            last_right = right if len(self.bytes_of[right]) > 1 else -1
            if last_left == last_right == -1:
                return True
            if last_left > last_right:
                until, left = left, self.parts(left)[1]
            else:
                until, right = right + 1, self.parts(right)[0]

    def all_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`stay_apart` of many pairs."""
        tokens = np.unique(np.concatenate([left, right]))
        for token in tokens[~self.judged[tokens]].tolist():
            self.parts(token)
        if len(self.parts_of) > self.n_judged:
            for token, parts in islice(self.parts_of.items(), self.n_judged, None):
                self.judged[token] = True
                self.halves[:, token] = parts or (-1, -1)
            self.n_judged = len(self.parts_of)
        out = np.zeros(len(left), bool)
        rows = np.flatnonzero((self.halves[0, left] >= 0) & (self.halves[0, right] >= 0))
        left, right, until = left[rows], right[rows], np.full(len(rows), self.top)
        while len(rows):
            key = left * self.top + right
            at = np.minimum(np.searchsorted(self.join_keys, key), len(self.join_keys) - 1)
            free = (self.join_keys[at] != key) | (self.join_ranks[at] >= until)
            last_left = np.where(self.size_of[left] > 1, left, -1)
            last_right = np.where(self.size_of[right] > 1, right, -1)
            ended = (last_left < 0) & (last_right < 0)
            out[rows[free & ended]] = True
            on = np.flatnonzero(free & ~ended)
            rows, left, right = rows[on], left[on], right[on]
            undo_left = last_left[on] > last_right[on]
            until = np.where(undo_left, left, right + 1)
            left, right = np.where(undo_left, self.halves[1, left], left), np.where(undo_left, right, self.halves[0, right])
        return out

    def all_fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`compatible` of many pairs."""
        keys, which = np.unique(left * self.top + right, return_inverse=True)
        fits = list(map(self.fits.get, keys.tolist()))
        new = [i for i, fit in enumerate(fits) if fit is None]
        if new:
            asked = keys[new]
            apart = self.all_apart(asked // self.top, asked % self.top).tolist()
            if len(self.fits) > MEMORY:
                self.fits.clear()
            self.fits.update(zip(asked.tolist(), apart))
            for i, fit in zip(new, apart):
                fits[i] = fit
        return np.array(fits, bool)[which]

    def all_shorter(self, tokens: np.ndarray) -> np.ndarray:
        """:meth:`shorten` of many tokens."""
        out = self.shorter_of[tokens]
        if (out == UNKNOWN).any():
            for token in np.unique(tokens[out == UNKNOWN]).tolist():
                self.shorter_of[token] = self.shorten(token)
            out = self.shorter_of[tokens]
        return out

    def encode_together(self, pieces: list[bytes]) -> list[bytes]:
        """:meth:`encode_piece` of pieces of up to ``LONGEST_TOGETHER`` bytes, a token of each at a time."""
        n = np.array(list(map(len, pieces)), np.int64)
        starts = np.cumsum(n + 1) - n - 1
        text = np.full(len(pieces) + int(n.sum()), BETWEEN)
        ends = starts + n
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        put = np.zeros((len(pieces), int(n.max())), np.int64)
        depth, at, dead = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.uint64)
        token = self.prefixes.longest(text, starts)
        live, one = np.arange(len(pieces)), np.uint64(1)
        while len(live):
            t, d, here = token[live], depth[live], at[live]
            taken = t >= 0
            end = here + self.size_of[t]
            taken &= (dead[live] >> np.minimum(end, 63).astype(np.uint64)) & one == 0
            seams = np.flatnonzero(taken & (d > 0))
            taken[seams] = self.all_fit(put[live[seams], d[seams] - 1], t[seams])
            rows = live[taken]
            put[rows, d[taken]] = t[taken]
            depth[rows] += 1
            at[rows] = end[taken]
            token[rows] = self.prefixes.longest(text, starts[rows] + end[taken])
            rows = live[~taken & (t >= 0)]
            token[rows] = self.all_shorter(token[rows])
            rows = live[t < 0]
            if len(rows):
                if not depth[rows].all():
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[rows] |= one << at[rows].astype(np.uint64)
                depth[rows] -= 1
                last = put[rows, depth[rows]]
                at[rows] -= self.size_of[last]
                token[rows] = self.all_shorter(last)
            live = live[at[live] < n[live]]
        raw = put[np.arange(put.shape[1]) < depth[:, None]].astype("<i4").tobytes()
        cuts = (4 * np.cumsum(depth)).tolist()
        return [raw[x:y] for x, y in zip([0, *cuts], cuts)]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out = list(map(self.whole.get, pieces))
        short: list[int] = []
        for i, ids in enumerate(out):
            if ids is None:
                if len(pieces[i]) <= LONGEST_TOGETHER:
                    short.append(i)
                else:
                    out[i] = np.array(self.encode_piece(pieces[i]), "<i4").tobytes()
        for start in range(0, len(short), TOGETHER):
            some = short[start:start + TOGETHER]
            for i, ids in zip(some, self.encode_together([pieces[i] for i in some])):
                out[i] = ids
        return out

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, latin, longest = len(piece), piece.decode("latin-1"), self.automaton.iter_long
        sizes, shorter, fits, top = self.sizes, self.shorter, self.fits, self.top
        dead = bytearray(n + 1)
        ids: list[int] = []
        at = 0
        token = next(longest(latin), (0, -1))[1]
        while at < n:
            while token >= 0:
                if not dead[at + sizes[token]]:
                    if not ids:
                        break
                    fit = fits.get(ids[-1] * top + token)
                    if self.compatible(ids[-1], token) if fit is None else fit:
                        break
                token = shorter[token] if shorter[token] != UNKNOWN else self.shorten(token)
            if token >= 0:
                ids.append(token)
                at += sizes[token]
                if at < n:
                    token = next(longest(latin, at), (0, -1))[1]
            else:
                if not ids:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead[at] = 1
                last = ids.pop()
                at -= sizes[last]
                token = shorter[last] if shorter[last] != UNKNOWN else self.shorten(last)
        return tuple(ids)

    def shorten(self, token: int) -> int:
        """The longest token that another begins with, or -1."""
        whole = self.bytes_of[token]
        prefixes = (self.ranks.get(whole[:n], -1) for n in range(len(whole) - 1, 0, -1))
        self.shorter[token] = found = next((r for r in prefixes if r >= 0), -1)
        return found

    def pieces_of(self, chunks: list[bytes]) -> list[list[str]]:
        """The pieces of each chunk."""
        return [self.find(chunk.decode()) for chunk in chunks]

    def ids_of(self, chunks: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each chunk."""
        out = list(map(self.chunks.get, chunks))
        if len(self.chunks) > MEMORY:
            self.chunks.clear()
        if len(self) > MEMORY:
            self.clear()
        missing = [i for i, ids in enumerate(out) if ids is None]
        # most chunks are one piece, which is then remembered as a chunk only
        single: list[bytes] = []
        several: list[tuple[int, list[bytes]]] = []
        alone: list[int] = []
        for i, pieces in zip(missing, self.pieces_of([chunks[i] for i in missing])):
            if len(pieces) == 1:
                alone.append(i)
                single.append(chunks[i])
            else:
                several.append((i, [p.encode() for p in pieces]))
        new = list({p for _, pieces in several for p in pieces if p not in self})
        ids = self.encode_pieces(single + new)
        for i, own in zip(alone, ids):
            out[i] = own
        made = dict(zip(new, ids[len(single):]))
        for i, pieces in several:
            out[i] = b"".join([made[p] if p in made else self[p] for p in pieces])
        self.update((p, own) for p, own in made.items() if len(p) <= LONGEST_REMEMBERED)
        self.chunks.update((chunks[i], out[i]) for i in missing if len(chunks[i]) <= LONGEST_REMEMBERED)
        return out

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The bytes of each list of ids, gathered from those of the tokens."""
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and not (0 <= flat.min() and flat.max() < self.top and self.given[flat].all()):
            raise ValueError("an id without an entry in the vocabulary")
        data, offsets = gathered(self.tokens, flat)
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        bounds = np.ascontiguousarray(offsets[np.concatenate([[0], ends])])
        whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        return whole.cast(pa.binary())


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids (array of ints) of a text column; ``docs`` keeps its other columns."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        flat, bounds = encoded(texts, codec(path, pattern).ids_of)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of an id column."""

    @F.arrow_udf("binary")
    def run(arrays: pa.Array) -> pa.Array:
        return codec(path, pattern).decode(arrays)

    return docs.withColumn(out, run(F.col(ids)))


def digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by commas, in hexadecimal."""
    return F.sha2(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), 256)

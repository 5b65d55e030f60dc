"""The operators of unitcal.llm against brute force, round trips and odd rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from oracle import compare, connect
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from unitcal.llm import bpe, chat, chunks, cotrain, cross_polytope, huffman, packing, perplexity, recompress, simhash, tokens, warc
from unitcal.llm.queries import LLM_CATALOG
from unitcal.session import new_path

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, n string, row string, content string, kept string"
WORDS = [f"word{i}" for i in range(400)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_rows():
    shared = prose(1, 60)
    texts = [
        (5, shared), (3, shared + " " + prose(2, 40)), (9, prose(3, 30) + "\n" + shared), (5, shared), (7, None), (8, ""),
        (None, shared), (2, "  \n\t "), (4, "one"), (6, "a a a " * 2000), (1, "naïve 日本語 \U0001f600 " * 30), (10, prose(4, 20_000)),
        (11, "a a a " * 2000), (12, "<|endoftext|> x"),
    ]
    return [(i, t, None if k % 3 == 0 else "en", "s", 0, k, "x", "y", "z", "w") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().split()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    w = bytes((text or "").encode()).lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@here
def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    ids = sorted(fps)
    links = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = roots(ids, links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in LLM_CATALOG["op1_simhash"].run(spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def test_anchors_miss_no_pair():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    other = fps.copy()
    for _ in range(2):
        other ^= np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64)
    sent, homes = defaultdict(set), {}
    for row, key, home in zip(*simhash.anchors(fps)):
        if home:
            homes[row] = key
    for row, key, _ in zip(*simhash.anchors(other)):
        sent[row].add(key)
    assert all(homes[i] in sent[i] for i in range(len(fps)))


def test_simhash_odd_rows(odd, nothing):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows())
    of = {r.doc_id: r for r in got}
    assert {of[i].component_id for i in (7, 8, 2)} == {2} and of[7].fingerprint == "0" * 16
    assert of[5].component_id == 5 and of[None].component_id == 5 and of[11].component_id == 6
    assert simhash.near_duplicates(nothing).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, n long, node long"


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 64))
    near = x[rng.integers(0, 60, 500)] + 0.11 * rng.standard_normal((500, 64))
    x = np.concatenate([x, near, x[:40]]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    rows = [(i, x[i].tolist(), int(label[i]), 1, 2) for i in range(len(x))]
    got = cross_polytope.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = (unit @ unit.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(close, False)
    pairs = close.sum()
    assert 1000 < pairs and 0.99 * pairs <= sum(r.n_links for r in got) <= pairs
    assert all(r.n_links <= close[r.vec_id].sum() for r in got)
    want = roots(range(len(x)), np.argwhere(close).tolist())
    assert sum(want[r.vec_id] != r.component_id for r in got) <= 0.01 * len(x)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_odd_rows(spark, monkeypatch):
    v, w = [1.0, 0.0, 0.5], [2.0, 0.0, 1.0]
    rows = [
        (3, v, 1), (2, w, 1), (3, v, 1), (1, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1),
        (8, [1.0, None, 0.5], 1), (9, [1.0, float("nan"), 0.5], 1), (10, [1.0, float("inf"), 0.5], 1), (None, v, 1), (11, v[:1], 1),
    ]
    got = cross_polytope.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)).collect()
    assert len(got) == len(rows)
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got if r.n_links) == [(0, 3, 2), (2, 3, 2), (3, 3, 2), (3, 3, 2)]
    assert all(r.component_id == r.vec_id for r in got if not r.n_links)
    assert cross_polytope.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0
    # a bucket in many blocks gives the same
    monkeypatch.setattr(cross_polytope, "BLOCK", 2)
    again = cross_polytope.near_duplicates(spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@here
def test_bytes_encode_as_the_library(spark):
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids, text = enc.encode_ordinary(r.text or ""), (r.text or "").encode()
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in LLM_CATALOG["op3_byte_bpe"].run(spark, SF).collect()}
    assert got == want


def test_bytes_odd_rows(odd, nothing):
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN)
    for r in got.collect():
        assert r.ids == enc.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(nothing, RANKS, PATTERN).count() == 0


def test_chunks_encode_as_whole_texts():
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    library, rng = Tokenizer.from_file(TOKENIZER), random.Random(5)
    parts = [" ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "\u3000", "\u0085", "\x1c", "a", "Bc", "7", "'s", "'", "\u00e9", "\u2014", "\u4e2d", "\u00a3", "\U0001f600", "!?", "<|endoftext|>", "\x00"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(4000)] + [None, "", " ", "x" * 70_000]
    own = tokens.ChunkEncoder(TOKENIZER)
    for _ in range(2):  # the second time from memory
        flat, bounds = chunks.encoded(pa.array(texts[3:], pa.string()), bpe.codec(RANKS, PATTERN).ids_of)
        got = [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
        assert got == [enc.encode_ordinary(t or "") for t in texts[3:]]
        got = own.encode(pa.array(texts, pa.string())[1:])
        assert [np.frombuffer(g, "<i4").tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts[1:]]


def test_ids_without_entry_are_refused():
    with pytest.raises(ValueError):
        bpe.codec(RANKS, PATTERN).decode(pa.array([[1, 60_000]], pa.list_(pa.int32())))
    assert bpe.codec(RANKS, PATTERN).decode(pa.array([None, [], [65]], pa.list_(pa.int32())))[2].as_py() == bpe.codec(RANKS, PATTERN).bytes_of[65]


def test_new_pieces_are_encoded_together(monkeypatch):
    codec = bpe.Codec(RANKS, PATTERN)
    rng = random.Random(3)
    words = [("".join(rng.choices("abcdeiotrnsé世ß", k=rng.randint(1, 20)))).encode() for _ in range(3000)]
    words = [w for w in words if len(w) <= bpe.LONGEST_TOGETHER]
    want = [[codec.ranks[part] for part in bpe.merge(w, codec.ranks)] if w not in codec.ranks else [codec.ranks[w]] for w in words]
    alone = [list(codec.encode_piece(w)) for w in words]
    monkeypatch.setattr(bpe.Codec, "encode_piece", None)
    monkeypatch.setattr(bpe, "TOGETHER", 700)
    fresh = bpe.Codec(RANKS, PATTERN)
    got = [np.frombuffer(ids, "<i4").tolist() for ids in fresh.encode_pieces(words)]
    assert got == want == alone


def test_pairs_stay_apart_as_merges_say():
    codec = bpe.codec(RANKS, PATTERN)
    rng = random.Random(2)
    for _ in range(3000):
        a, b = rng.randrange(rng.choice([300, 3000, 50_000])), rng.randrange(rng.choice([300, 3000, 50_000]))
        left, right = codec.bytes_of[a], codec.bytes_of[b]
        assert codec.stay_apart(a, b) == (bpe.merge(left + right, codec.ranks) == [left, right])


def library_ids(texts):
    library = Tokenizer.from_file(TOKENIZER)
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@here
def test_token_files_round_trip(spark):
    rows = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, start = set(), 0
    for r, ids in zip(rows, library_ids([r.text for r in rows])):
        ids = [*ids, 0]
        want.add((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert {tuple(r) for r in LLM_CATALOG["op4_token_files"].run(spark, SF).collect()} == want


def test_token_files_odd_rows(spark, odd, nothing):
    path = new_path(spark, "tokens")
    huffman.write_tokens(odd, path, TOKENIZER, 50_257, file_bytes=20_000)
    read = huffman.with_starts(huffman.read_tokens(spark, path)).orderBy("start").collect()
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in read] == [r[0] for r in rows]
    assert Counter((r.doc_id, bytes(r.ids)) for r in read) == Counter(
        (r[0], np.array([*ids, 0], "<u4").tobytes()) for r, ids in zip(rows, library_ids([r[1] for r in rows]))
    )
    path = new_path(spark, "tokens")
    huffman.write_tokens(nothing, path, TOKENIZER, 50_257)
    assert huffman.read_tokens(spark, path).count() == 0


def test_code_lengths_are_limited_and_complete():
    counts = np.array([2 ** i for i in range(40)] + [0, 7])
    lengths = huffman.code_lengths(counts, 12)
    assert lengths.max() <= 12 and lengths[40] == 0
    assert sum(2.0 ** -int(x) for x in lengths if x) == 1.0


TURNS = "conv_id long, turn int, role string, text string, place long, n long"


def test_chat_odd_rows(spark):
    turns = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "b", "<|im_end|>"), (2, 1, "b", "<|im_end|>"), (3, 0, "u", "a"), (3, 1, "b", "<|im_end|>"), (4, 0, "u", None), (5, 0, "u", ""), (None, None, None, "q")]
    got = {r.conv_id: (r.n_turns, r.n_copies, r.text) for r in chat.format_chats(spark.createDataFrame([(*t, 1, 2) for t in turns], TURNS)).collect()}
    assert set(got) == {2, 4, 5, None}
    assert got[2] == (2, 2, "<|im_start|>u\na<|im_end|>\n<|im_start|>b\n<im_end><|im_end|>\n")
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


@here
@pytest.mark.parametrize("name", sorted(n for n, e in LLM_CATALOG.items() if e.sql))
def test_query_equals_sql(spark, name):
    assert compare(LLM_CATALOG[name].run(spark, SF), connect(SF), LLM_CATALOG[name].sql) is None


PAGES = "page_id long, url string, html string, same string, size long"


def test_archives_odd_rows(spark):
    pages = [(3, "http://a b", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "u", None), (4, "u", ""), (1, "v", "<p>x</p>"), (None, "u", "y"), (6, "u", "\r\n\r\nWARC/1.1" * 50_000)]
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([(*p, "s", 1) for p in pages], PAGES), path)
    got = warc.read_archives(spark, path).collect()
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter({(1, "response", None): 2, (3, "revisit", 1): 1, (2, "response", None): 1, (4, "revisit", 2): 1, (None, "response", None): 1, (6, "response", None): 1})
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {"<p>x</p>", "", "y", "\r\n\r\nWARC/1.1" * 50_000}
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).count() == 0


def plain_counts(text):
    w = [x.decode() for x in words(text)]
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if seen[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    symbols = sum(c in "#*$%&|<>" for x in w for c in x)
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(hit), failed


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@here
def test_rules_equal_brute_force(spark):
    want = {r.doc_id: plain_counts(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = LLM_CATALOG["op7_quality_rules"].run(spark, SF).collect()
    assert {r.doc_id: tuple(r[c] for c in COUNTS) for r in got} == want
    values = ("log_perplexity", "log_perplexity_across")
    inside = {r.doc_id: all(r[v] is not None and r[f"{v}_low"] <= r[v] <= r[f"{v}_high"] for v in values) for r in got}
    assert all(r.kept == (not r.base_failed and inside[r.doc_id]) for r in got)


def test_rules_odd_rows_and_noise(spark, odd, nothing):
    got = perplexity.quality_rules(odd).collect()
    assert Counter((r.doc_id, *[r[c] for c in COUNTS]) for r in got) == Counter((r[0], *plain_counts(r[1])) for r in odd_rows())
    assert perplexity.quality_rules(nothing).count() == 0
    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("qxzjkvw0123#$") for _ in range(7)) for _ in range(200))
    rows = [(i, prose(i, 200), "en") for i in range(300)] + [(1000, noise, "en")]
    kept = {r.doc_id: r.kept for r in perplexity.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not kept[1000] and sum(kept.values()) == 300


def kneser_ney(texts: list[str]):
    """A plain modified Kneser-Ney model of one language: a function (context, character) -> probability."""
    order = perplexity.ORDER
    streams = ["\ue000" * (order - 1) + " ".join(re.findall(r"[^\x20\x09-\x0D]+", t)) + "\ue001" for t in texts]
    levels = [Counter(s[i - order + 1:i + 1] for s in streams for i in range(order - 1, len(s)))]
    for _ in range(order - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    held = []
    for level in levels:
        many = Counter(level.values())
        y = many[1] / (many[1] + 2 * many[2]) if many[1] + 2 * many[2] else None
        cut = []
        for i in (1, 2, 3):
            d = i - (i + 1) * y * many[i + 1] / many[i] if y is not None and many[i] else None
            cut.append(d if d is not None and 0 < d < i else i / 2)
        held.append(cut)

    followers = []
    for level in levels:
        of: dict = {}
        for g, n in level.items():
            of.setdefault(g[:-1], []).append((g[-1], n))
        followers.append(of)

    def p(context: str, c: str) -> float:
        value = 1 / (len(levels[0]) + 1)
        for n in range(order):
            after = followers[n].get(context[len(context) - n:])
            if after:
                cut = lambda m: min(m, held[n][min(m, 3) - 1])
                total = sum(m for _, m in after)
                mine = dict(after).get(c, 0)
                value = (mine - (cut(mine) if mine else 0)) / total + sum(cut(m) for _, m in after) / total * value
        return value

    return p, streams, {g for g in levels[0]}


def test_perplexity_equals_a_plain_model(spark):
    texts = {"en": [prose(i, 60) for i in range(25)] + ["caf\u00e9 \U0001F600\n\x01 x", "a"], "": [prose(i, 30)[::-1] for i in range(10)]}
    rows = [(i, t, lang) for lang, some in texts.items() for i, t in enumerate(some, 0 if lang else 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in perplexity.quality_rules(docs).collect()}
    k = perplexity.ORDER - 1
    for lang, some in texts.items():
        p, streams, letters = kneser_ney(some)
        assert abs(sum(p("wor" + " ", c) for c in [*letters, "\u2603"]) - 1) < 1e-9
        for i, s in enumerate(streams, 0 if lang else 1000):
            logs = [(math.log(p(s[j - k:j], s[j])), " " in s[j - k:j]) for j in range(k, len(s))]
            assert got[i].log_perplexity == pytest.approx(-sum(v for v, _ in logs) / len(logs))
            over = [v for v, a in logs if a]
            assert got[i].log_perplexity_across == (pytest.approx(-sum(over) / len(over)) if over else None)


def test_windows_do_not_change_the_counts(spark, monkeypatch):
    texts = [prose(i, 40).encode() for i in range(6)]
    langs = ["en", "de"] * 3

    def counted():
        grams = perplexity.GramCounts()
        grams.add(texts, langs)
        return grams.merged().set_index(["lang", "a", "b"])["n"].to_dict()
    whole = counted()
    monkeypatch.setattr(perplexity, "WINDOW", 7)
    assert counted() == whole and sum(whole.values()) == sum(len(t) + 1 for t in texts)


def test_rules_exchange_a_part_of_the_chunks_at_a_time(spark, monkeypatch):
    rows = [(i, prose(i, 60), "en") for i in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    scored, plain = [], perplexity.stage

    def stage(df):
        out = plain(df)
        if "log_perplexity" in out.columns:
            scored.append([r.doc_id for r in out.select("doc_id").collect()])
        return out

    monkeypatch.setattr(perplexity, "stage", stage)
    assert perplexity.quality_rules(docs).count() == 64
    assert sorted(i for part in scored for i in part) == list(range(64))
    assert max(map(len, scored)) <= 32


@here
def test_shuffled_documents_leave_and_clean_ones_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(3)
    mixed = []
    for r in docs.filter("doc_id % 12 = 0 and length(text) > 1500").collect():
        words = r.text.split()
        rng.shuffle(words)
        mixed.append((-1 - r.doc_id, " ".join(words), r.lang))
    got = perplexity.quality_rules(docs.unionByName(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))).collect()
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
    stay = [r.kept for r in got if r.doc_id in clean and not r.base_failed]
    gone = [not r.kept for r in got if r.doc_id < 0]
    print("clean kept", sum(stay), len(stay), "shuffled rejected", sum(gone), len(gone))
    assert sum(stay) > 0.98 * len(stay) and sum(gone) > 0.3 * len(gone)


@here
def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.accept for r in cotrain.labels_of(labels).collect()}
    held = {i for i in known if i % 4 == 0}
    got = cotrain.classify(docs, labels.filter("doc_id % 4 <> 0")).collect()
    assert len(got) == docs.count()
    tried = [r for r in got if r.doc_id in held]
    assert sum(r.kept == (known[r.doc_id] == 1) for r in tried) / len(tried) > 0.85


def test_classifier_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = cotrain.classify(odd, labels).collect()
    assert len(got) == len(odd_rows()) and all(r.kept and r.score is None for r in got)
    assert cotrain.classify(nothing, labels).count() == 0
    many = spark.createDataFrame([(i, prose(i, 30) + (" good fine" if i % 2 else " bad awful"), "en", "s") for i in range(200)], "doc_id long, text string, lang string, content string")
    learnt = spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in cotrain.classify(many, learnt).collect()}
    assert sum(kept[i] == bool(i % 2) for i in range(150, 200)) >= 45


def plain_repeats(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - 12):
            if i is not None:
                first[tuple(w[s:s + 13])] = min(i, first.get(tuple(w[s:s + 13]), i))
    out = []
    for i, t in rows:
        w = words(t)
        gone = {j for s in range(len(w) - 12) if i is not None and first[tuple(w[s:s + 13])] < i for j in range(s, s + 13)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@here
def test_repeats_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, LLM_CATALOG["op9_substring_dedup"].run(spark, SF).collect())) == plain_repeats(rows)


def test_repeats_odd_rows(odd, nothing):
    got = recompress.remove_repeats(odd)
    assert set(odd.columns) <= set(got.columns)
    found = Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()))
    assert found == plain_repeats([r[:2] for r in odd_rows()])
    assert recompress.remove_repeats(nothing).count() == 0


def check_packing(pieces, texts, length=2048):
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append((p.offset, p.length))
    for parts in by_seq.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    want = Counter()
    for (i, _), ids in zip(texts, library_ids([t for _, t in texts])):
        ids = [*ids, 1]
        want.update((i, s, len(ids[s:s + length]), crc(ids[s:s + length]), len(ids)) for s in range(0, len(ids), length))
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == want


@here
def test_packing_places_every_id(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packing(LLM_CATALOG["op10_packing"].run(spark, SF).collect(), texts)


def test_packing_odd_rows(odd, nothing):
    check_packing(packing.pack(odd, TOKENIZER).collect(), [r[:2] for r in odd_rows()])
    assert packing.pack(nothing, TOKENIZER).count() == 0


def test_first_fit_decreasing_equals_a_plain_search():
    rng = random.Random(4)
    sizes = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    bins, want = [], []
    for size in sizes:
        at = next((i for i, b in enumerate(bins) if b + size <= 100), len(bins))
        if at == len(bins):
            bins.append(0)
        want.append((at, bins[at]))
        bins[at] += size
    assert packing.first_fit_decreasing(sizes, 100) == want


def test_classifier_reads_each_text_once_beside_the_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 30) + (" good fine" if i % 2 else " bad awful"), "en", "s") for i in range(200)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    seen, plain = [], cotrain.views
    monkeypatch.setattr(cotrain, "views", lambda of: (seen.append(of.count()), plain(of))[1])
    got = {r.doc_id: r for r in cotrain.classify(docs, labels).collect()}
    assert sorted(seen) == [150, 200]
    by_hash = cotrain.classify(docs, labels, F.col("doc_id") + 1000).collect()
    apart = {r.doc_id - 1000: r for r in cotrain.score(docs.withColumn("doc_id", F.col("doc_id") + 1000), cotrain.fit(docs, labels)).collect()}
    assert {r.doc_id - 1000 for r in by_hash} == set(got) == set(apart)
    assert all(got[i].score == pytest.approx(apart[i].score, abs=1e-6) for i in got)


def test_classifier_scores_all_unlabelled_rows_each_round(spark, monkeypatch):
    # more than the 10,000 rows that the pool once held; a third without an id
    n = 12_000
    rows = spark.range(n).selectExpr(
        "if(id % 3 = 1, null, id) as doc_id", "if(id % 2 = 0, 'fine plain words', 'bad spam junk') as text", "'en' as lang", "'s' as source"
    ).repartition(2)
    labels = spark.range(0, n, 30).selectExpr("id as doc_id", "1 as quality", "0 as toxic").union(
        spark.range(3, n, 30).selectExpr("id as doc_id", "0 as quality", "0 as toxic")
    )
    learnt, plain = [], cotrain.logistic

    def logistic(features, label, strength):
        model = plain(features, label, strength)
        fit = model.fit
        model.fit = lambda rows: (learnt.append(rows.count()), fit(rows))[1]
        return model

    monkeypatch.setattr(cotrain, "logistic", logistic)
    assert cotrain.fit(rows, labels) is not None
    assert max(learnt) > n - 800 + 400


def thue_morse(n):
    """Two words of n letters that every polynomial modulo 2**64 confuses for long n."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [256, 1024])
def test_different_words_have_different_names(spark, n):
    one, two = thue_morse(n)
    tail = " ".join(f"u{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, f"{one} {tail}")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in recompress.remove_repeats(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_added_tokens_are_the_library_s_own(spark):
    texts = ["x <|endoftext|> y", "plain words here", "a<|endoftext|>b  c", None]
    got = tokens.ChunkEncoder(TOKENIZER).encode([t or "" for t in texts])
    assert [np.frombuffer(g, "<i4").tolist() for g in got] == library_ids(texts)
    assert 50256 in library_ids(texts)[0]


def test_files_are_in_the_order_of_their_numbers(spark):
    rows = [(f"part-{n}-x.huff", 0, n, 10) for n in ("00002", "99999", "100000", "100001")]
    docs = spark.createDataFrame(rows, "file string, start_in_file long, doc_id string, n_tokens long")
    assert {r.doc_id: r.start for r in huffman.with_starts(docs).collect()} == {"00002": 0, "99999": 10, "100000": 20, "100001": 30}

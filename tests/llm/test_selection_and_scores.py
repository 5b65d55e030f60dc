"""Importance resampling, the Pitman-Yor model and conversation repair against brute force and odd rows."""

import hashlib
import heapq
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from oracle import compare, connect
from test_operators import DOCS, SF, odd_rows, prose

from unitcal.llm import importance, pitman_yor, repair
from unitcal.llm.queries import LLM_CATALOG

here = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@here
@pytest.mark.parametrize("name", ["op11_importance_resampling", "op13_conversation_repair"])
def test_equals_sql(spark, name):
    entry = LLM_CATALOG[name]
    assert compare(entry.run(spark, SF), connect(SF), entry.sql) is None


# Importance resampling


def plain_resample(rows, targets, percent=10, least=20, longest=1):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % 10_000 for g in found]

    held = [(i, *grams(t)) for i, t in rows]
    s, t = Counter(b for _, _, g in held for b in g), Counter(b for x in targets for b in grams(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, n_words, g in held:
        gains = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in g]
        weight = sum(gains) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[:len(able) * percent // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("percent, longest", [(10, 1), (60, 1), (50, 2), (100, 3), (0, 1)])
def test_resampling_equals_brute_force(spark, percent, longest):
    rng = random.Random(percent)
    rows = [(i, prose(i, rng.randrange(40))) for i in range(300)]
    rows += [(i, t) for i, t in rows[:20]] + [(None, rows[5][1])] * 40 + [(700, None), (701, "  ")]
    targets = [prose(1000 + i, 30) for i in range(10)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row long, weight long").repartition(4)
    wanted = spark.createDataFrame([(t,) for t in targets], "text string")
    got = importance.resample(docs, wanted, percent=percent, longest=longest).collect()
    assert Counter(tuple(r) for r in got) == plain_resample(rows, targets, percent, longest=longest)


def test_cut_off_in_ties(spark):
    rows = [(s, d, k) for k, (s, d) in enumerate([(5, 1)] * 7 + [(5, 2)] * 7 + [(4, 9)] * 3 + [(-8, 0)] * 5)]
    df = spark.createDataFrame(rows, "s long, d long, k long").repartition(3)
    order = [-df["s"], df["d"], df["k"]]
    df = df.cache()
    for n in (0, 3, 7, 10, 14, 16, 17, 20, 23):
        got = df.filter(importance.first_rows(df, order, n)).collect()
        want = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:n]
        assert sorted(map(tuple, got)) == sorted(want)


def test_resampling_odd_rows(spark):
    odd = spark.createDataFrame(odd_rows(), DOCS).repartition(3)
    got = importance.resample(odd, odd, percent=50).collect()
    want = plain_resample([r[:2] for r in odd_rows()], [r[1] for r in odd_rows()], 50)
    assert Counter(tuple(r) for r in got) == want
    assert importance.resample(odd.limit(0), odd).count() == 0
    assert importance.resample(odd, odd.limit(0)).count() == len(odd_rows())


# Conversation repair


def plain_repair(codes):
    """Cheapest edits by Dijkstra's algorithm over whole audits."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if 2 * at == len(codes) and state in (0, 3):
            return cost, audit
        if (at, state) in done:
            continue
        done.add((at, state))
        role, letter = (3, "a") if state == 2 else (2, "u")
        heapq.heappush(heap, (cost + 3, audit + "I", at, role))
        if 2 * at < len(codes):
            have, fault = codes[2 * at], codes[2 * at + 1]
            late = 3 if fault == "t" else 0
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if fault != "d":
                heapq.heappush(heap, (cost + 3 + late, audit + "R", at + 1, role))
                if have == letter:
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, role))
                elif have == "s" and state == 0:
                    heapq.heappush(heap, (cost + late, audit + "K", at + 1, 1))


def test_auction_equals_plain_search():
    rng = random.Random(2)
    for _ in range(3000):
        codes = "".join(rng.choice("suuaa-") + rng.choice("ccctd") for _ in range(rng.randrange(10)))
        assert repair.solve(codes)[0] == plain_repair(codes)[0], codes
    # every least audit, by trying all of them
    for _ in range(150):
        codes = "".join(rng.choice("sua-") + rng.choice("cctd") for _ in range(rng.randrange(4)))
        cost, audit = repair.solve(codes)
        assert audit == min(audits(codes, cost)), codes


def audits(codes, budget):
    out = []

    def walk(at, state, left, audit):
        if 2 * at == len(codes) and state in (0, 3) and left == 0:
            out.append(audit)
        for letter, cost, a, s in repair.arcs(codes, at, state):
            if cost <= left and (cost or letter == "K"):
                walk(a, s, left - cost, audit + letter)

    walk(0, 0, budget, "")
    return out


def test_long_conversation():
    codes = "".join(random.Random(3).choice("sua") + random.Random(i).choice("cctd") for i in range(20_000))
    cost, audit = repair.solve(codes)
    assert sum(x in "KRD" for x in audit) == 20_000 and cost > 0


TURNS = "conv_id long, turn long, role string, text string, place long, code string, kind int, audit string, _id long"


def test_repair_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Yes!"),
        (2, 5, "user", "One."), (2, None, None, None), (2, 8, "user", "One."),
        (None, 0, "assistant", "x" * 100_000), (None, 1, "tool", "Fine."),
        (3, 1, "user", " \n\t"), (4, 0, "system", "Only."), (5, None, "user", "Same."), (5, None, "user", "Same."),
        (6, 0, "", "Empty role."), (7, 0, "user", "é日 本。"),
    ]
    df = spark.createDataFrame([(*r, 1, "a", 2, "b", 3) for r in rows], TURNS).repartition(3)
    got = {r.conv_id: r for r in repair.repair_conversations(df, repair.filled(df)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, None}
    assert (got[1].audit, got[1].cost, got[1].gaps) == ("KK", 0, 0)
    assert got[1].repaired_sha256 == hashlib.sha256(b"user:Hello.\nassistant:Yes!").hexdigest()
    # the blank row and the repeated one go, and an answer is put in
    assert (got[2].blank, got[2].duplicate, got[2].gaps, got[2].cost, got[2].audit) == (1, 1, 2, 11, "DKDI")
    # both rows go: keeping either costs more
    assert (got[None].truncated, got[None].cost, got[None].audit) == (1, 8, "DD")
    assert (got[3].blank, got[3].cost, got[3].audit) == (1, 4, "D")
    assert (got[3].repaired_sha256, got[4].audit) == (hashlib.sha256().hexdigest(), "D")
    assert (got[5].duplicate, got[5].gaps, got[5].cost, got[5].audit) == (1, 0, 7, "KDI")
    assert (got[6].illegal, got[6].cost, got[6].audit) == (0, 4, "D")
    assert (got[7].truncated, got[7].cost) == (1, 4)
    none = repair.repair_conversations(df, repair.filled(df).limit(0)).collect()
    assert all((r.gaps, r.cost, r.audit, r.repaired_sha256) == (0, 0, "", hashlib.sha256().hexdigest()) for r in none) and len(none) == 8
    assert repair.repair_conversations(df.limit(0)).count() == 0


# The language model


def table_law(c, a, d):
    """Exact law of the number of tables, by brute-force recursion."""
    weight = {1: 1.0}
    for n in range(1, c):
        now = defaultdict(float)
        for t, w in weight.items():
            now[t] += w * (n - d * t)
            now[t + 1] += w
        weight = now
    total = {t: w * a**t for t, w in weight.items()}
    return {t: w / sum(total.values()) for t, w in total.items()}


@pytest.mark.parametrize("c", [2, 3, 7, 30])
@pytest.mark.parametrize("a", [0.02, 1.0, 9.0])
def test_tables_follow_their_law(c, a):
    keys = np.random.default_rng(1).integers(0, 1 << 60, 40_000)
    got = pitman_yor.draw_tables(np.full(len(keys), c), np.full(len(keys), a), keys, 5, 0.6)
    law = table_law(c, a, 0.6)
    assert 0.5 * sum(abs(law.get(t, 0) - np.mean(got == t)) for t in range(1, c + 1)) < 0.015


@pytest.mark.parametrize("a", [0.02, 1.0, 20.0, 300.0])
def test_many_customers_are_near_their_law(a, monkeypatch):
    keys = np.random.default_rng(2).integers(0, 1 << 60, 20_000)
    c, d = 257, 0.6
    got = pitman_yor.draw_tables(np.full(len(keys), c), np.full(len(keys), a), keys, 5, d)
    monkeypatch.setattr(pitman_yor, "EXACT", 300)
    logs = pitman_yor.stirling_logs(d)[c, 1:c + 1] + np.arange(1, c + 1) * math.log(a)
    law = np.exp(logs - logs.max())
    law /= law.sum()
    mean = (law * np.arange(1, c + 1)).sum()
    assert abs(got.mean() - mean) < 0.02 * mean
    assert abs(got.std() - math.sqrt((law * (np.arange(1, c + 1) - mean) ** 2).sum())) < 0.2


def learned(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 != 1


def plain_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def check_base(got, rows):
    counts = Counter(t for i, x in rows if learned(i) for t in plain_tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (str(i), not learned(i), len(t := plain_tokens(x)), sum(counts[w] > 0 for w in t), n,
         round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, x in rows
    )
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def markov(seed, n):
    rng, state, out = random.Random(seed), 0, []
    for _ in range(n):
        state = (3 * state + rng.choice([1, 1, 1, 7])) % 50
        out.append(f"w{state}")
    return " ".join(out)


def markov_rows():
    return [(i, markov(i, 80)) for i in range(200)] + [(500 + i, markov(3, 80)) for i in range(20)]


def scores(spark, rows, parts, chunk, monkeypatch):
    monkeypatch.setattr(pitman_yor, "CHUNK", chunk)
    return pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()


def test_model_learns_order(spark, monkeypatch):
    rows = markov_rows()
    shuffled = [(1000 + i, " ".join(random.Random(i).sample(t.split(), 80))) for i, t in rows if not learned(i)]
    shuffled = [(i, t) for i, t in shuffled if not learned(i)]
    got = scores(spark, rows + shuffled, 4, 4000, monkeypatch)
    check_base(got, rows + shuffled)
    held = [r for r in got if r.held_out]
    plain, mixed = [r for r in held if r.doc_id < 1000], [r for r in held if r.doc_id >= 1000]
    rate = [-sum(r[k] for r in part) / sum(r.n_tokens for r in part) for part in (plain, mixed) for k in ("score", "base_score")]
    # the source's own entropy is log10 of about 2.2 choices
    assert rate[0] < 0.45 < 1.5 < rate[1] and rate[2] > rate[0] + 0.5
    # neither the tasks nor the chunks of the texts show
    other = scores(spark, rows + shuffled, 1, 10**9, monkeypatch)
    assert all(abs(a.score - b.score) < 1e-2 * abs(a.score) for a, b in zip(sorted(got), sorted(other)))


def test_probabilities_sum_to_one(spark, monkeypatch):
    rows = markov_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = pitman_yor.stage(pitman_yor.tokens_of(docs, 5, 1))
    words, chunk_words = pitman_yor.word_table(chunks)
    answers = pitman_yor.stage(pitman_yor.pair_answers(pitman_yor.pair_counts(chunks, chunk_words)))
    firsts = answers.filter("first").select("key", "c")
    settings, state = pitman_yor.fit(firsts, words, chunks.filter("not held_out").count())
    ids = {r.hash: r.id for r in words.collect()}
    counts = Counter()
    for i, text in rows:
        if learned(i):
            t = [0, *[pitman_yor.xxhash.xxh64_intdigest(w) if w else None for w in plain_tokens(text)]]
            t = [0, *[ids[pitman_yor.END_HASH if h is None else h - (1 << 64) if h >> 63 else h] for h in t[1:]]]
            counts.update(zip(t, t[1:]))
    assert {(r.key >> 32, r.key & pitman_yor._MASK): r.c for r in firsts.collect()} == {k: c for k, c in counts.items() if c > 1}
    of = {r.id: r for r in state.collect()}
    dishes = [r for r in words.collect() if r.c > 0]
    p = np.array([of[r.id].p for r in dishes])
    unknown = (pitman_yor.CONCENTRATION + settings.root_discount * 0) * settings.base
    assert (p > 0).all() and (p.sum(axis=0) < 1).all() and unknown > 0
    for u in list(of)[:12]:
        c = np.array([counts[u, r.id] for r in dishes])
        if c.sum():
            key = np.array([(u << 32) | r.id for r in dishes])
            got = pitman_yor.predictive(c, key, of[u].total, np.tile(np.array(of[u].tables, float), (len(c), 1)), p, settings)
            # what is missing is the unknown word's share
            assert 0 < 1 - got.sum() < 0.05 and (got > 0).all()


def test_pairs_travel_in_runs(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "CHUNK", 4000)
    monkeypatch.setattr(pitman_yor, "BUCKET", 400)
    chunks = pitman_yor.stage(pitman_yor.tokens_of(spark.createDataFrame(markov_rows(), "doc_id long, text string"), 5, 1))
    words, chunk_words = pitman_yor.word_table(chunks)
    buckets, n = pitman_yor.n_buckets(chunks), chunks.select("chunk").distinct().count()
    pairs = pitman_yor.stage(pitman_yor.pair_counts(chunks, chunk_words))
    assert buckets > 1 and n > 1 and pairs.count() <= 2 * n * buckets
    answers = pitman_yor.stage(pitman_yor.pair_answers(pairs))
    assert answers.filter("not first").count() <= n * buckets
    # a pair is drawn in one block, and a block names each of its words once
    firsts = answers.filter("first").select("key", "c")
    blocks = pitman_yor.stage(pitman_yor.pair_blocks(firsts))
    assert blocks.count() == blocks.select("block", "id").distinct().count()
    assert blocks.agg(F.sum("of_context"), F.sum("of_dish")).first() == tuple(firsts.agg(F.sum(F.col("c") - 1)).first()) * 2


def test_model_odd_rows(spark, monkeypatch):
    odd = spark.createDataFrame(odd_rows(), DOCS).repartition(3)
    got = pitman_yor.score_texts(odd).collect()
    check_base(got, [r[:2] for r in odd_rows()])
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert pitman_yor.score_texts(odd.limit(0)).count() == 0
    none = [i for i in range(100) if not learned(i)][:3]
    alone = pitman_yor.score_texts(spark.createDataFrame([(i, "a b") for i in none], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in alone] == [(3, 0, 0, 0.0, 0.0)] * 3

"""The stages of corpus_pipeline on the smallest tables and on odd rows."""

import os
import random

import pytest
from test_operators import DOCS, check_packing, odd_rows, prose, roots

import corpus_pipeline
from unitcal.llm import near_copies

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def by_stage(spark, docs):
    columns, out = docs.columns, []
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
        out.append(docs.collect())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return columns, out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, (rules, classifier, simhash, substring, packed) = by_stage(spark, docs)
    ids = {r.doc_id for r in docs.collect()}
    assert list(rules[0].asDict()) == columns and list(substring[0].asDict()) == columns
    assert ids > {r.doc_id for r in rules} >= {r.doc_id for r in classifier} >= {r.doc_id for r in simhash}
    texts = [r.text for r in simhash]
    assert len(set(texts)) == len(texts)
    assert {r.doc_id for r in substring} == {r.doc_id for r in simhash}
    check_packing(packed, [(r.doc_id, r.text) for r in substring])


def test_odd_rows(spark):
    rows = spark.createDataFrame(odd_rows(), DOCS)
    _, out = by_stage(spark, rows)
    assert {r.doc_id for r in out[0]} <= {r[0] for r in odd_rows()}
    _, out = by_stage(spark, rows.limit(0))
    assert out[-1] == []


def changed_words():
    """Texts, and copies of them with a few words changed: similarity from 0.5 to 1."""
    rng, rows = random.Random(5), []
    for base in range(60):
        words = prose(100 + base, rng.choice([30, 60, 120, 400])).split()
        for copy in range(4):
            own = list(words)
            for k in range(copy * max(1, len(words) // 120)):
                own[rng.randrange(len(own))] = f"changed{base}x{copy}x{k}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_simhash_dedup_finds_changed_words(spark):
    rows = changed_words()
    sets = {i: near_copies.shingle_set(t.encode()) for i, t in rows}
    links = [
        (a, b) for a in sets for b in range(a)
        if len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 0.8 * len(set(sets[a].tolist()) | set(sets[b].tolist()))
    ]
    assert sum(sets[a].tobytes() != sets[b].tobytes() for a, b in links) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = set(roots(list(sets), links).values())
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()} == want


def test_simhash_dedup_keeps_one_row_of_each_group(spark):
    a, b, c, d = (prose(seed, 40) for seed in (201, 202, 203, 204))
    rows = [(1, a), (1, b), (2, b), (1, a), (None, a), (None, c), (None, c), (None, d), (9, d), (None, None), (8, None)]
    want = {(1, a), (1, b), (None, c), (9, d), (8, None)}
    for parts in (1, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = [(r.doc_id, r.text) for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()]
        assert len(got) == len(want) and set(got) == want


def test_verdicts_are_of_rows(spark):
    good, bad = prose(301, 60), "a a a " * 40
    names = "doc_id long, text string, _id long, _key long, row_key long, first string"
    rows = [(None, good, 1, 2, 3, "x"), (None, bad, 1, 2, 3, "x"), (7, good + " more", 1, 2, 3, "x"), (7, bad, 4, 5, 6, None)]
    docs = spark.createDataFrame(rows, names)
    verdicts = spark.createDataFrame(
        [(r.doc_id, r.text.startswith("word")) for r in corpus_pipeline.with_key(docs).collect()], "doc_id long, kept boolean"
    )
    assert {tuple(r) for r in corpus_pipeline.of_kept(docs, verdicts).collect()} == {rows[0], rows[2]}
    for _, step in corpus_pipeline.STAGES[:3]:
        assert set(step(spark, docs, SF).collect()) <= set(docs.collect())

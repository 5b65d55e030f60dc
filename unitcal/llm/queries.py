"""The registered queries of this folder, over the whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from unitcal.llm import (
    bpe,
    chat,
    cotrain,
    cross_polytope,
    huffman,
    importance,
    packing,
    perplexity,
    pitman_yor,
    recompress,
    repair,
    simhash,
    warc,
)
from unitcal.plans.registry import Entry
from unitcal.session import new_path, stage

LLM_CATALOG: dict[str, Entry] = {}


def llm_query(name: str, sql: str | None = None):
    def register(run):
        LLM_CATALOG[name] = Entry(run, sql)
        return run

    return register


CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS place
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), prefixes AS (
  SELECT conv_id, place, string_agg(
           coalesce(strlen(role)::VARCHAR, 'n') || ',' || coalesce(strlen(text)::VARCHAR, 'n') || ';'
           || coalesce(role, '') || coalesce(text, ''), '')
         OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS so_far
  FROM turns
), ends AS (
  SELECT conv_id, max(place) AS n, arg_max(so_far, place) AS whole FROM prefixes GROUP BY conv_id
), classes AS (
  SELECT whole, min(conv_id) AS conv_id, any_value(n) AS n_turns, count(*) AS n_copies FROM ends GROUP BY whole
), inner_prefixes AS (
  SELECT DISTINCT so_far FROM prefixes JOIN ends USING (conv_id) WHERE place < n
), kept AS (
  SELECT conv_id, n_turns, n_copies FROM classes WHERE whole NOT IN (SELECT so_far FROM inner_prefixes)
)
SELECT k.conv_id, k.n_turns, k.n_copies, string_agg(
         '<|im_start|>' || replace(replace(coalesce(role, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>')
         || chr(10) || replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>')
         || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
FROM kept k JOIN turns t USING (conv_id) GROUP BY k.conv_id, k.n_turns, k.n_copies
"""

#: SHA-1 in base 32 from its hexadecimal digits: eight groups of five digits, four letters each.
WARC_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages
), firsts AS (
  SELECT payload, min(page_id) AS first_id FROM payloads GROUP BY payload
)
SELECT p.page_id, strlen(p.payload) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(p.digest, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)),
         'string_agg', '') AS payload_digest,
       CASE WHEN p.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> f.first_id THEN f.first_id END AS refers_to
FROM payloads p JOIN firsts f USING (payload)
"""


def crc32_sql(values: str) -> str:
    """DuckDB's form of the CRC-32 of a list of bytes, bit by bit."""
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], {values}), lambda acc, b:
      list_reduce(list_concat([xor(acc, b)], range(8)), lambda r, k:
        CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295)"""


def bytes_sql(text: str) -> str:
    return f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::INTEGER + 1, 2))::BIGINT)"


IMPORTANCE_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM documents
), wanted AS (
  SELECT unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark
), buckets AS (
  SELECT word, {crc32_sql(bytes_sql('word'))} % 10000 AS bucket
  FROM (SELECT word FROM words UNION SELECT word FROM wanted)
), source AS (
  SELECT bucket, count(*) AS n FROM words JOIN buckets USING (word) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS n FROM wanted JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM source) + 10000)::DOUBLE
           / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM target), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM source s LEFT JOIN target t USING (bucket)
), weights AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scores AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights w USING (doc_id)
), places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS able
  FROM scores WHERE n_features >= 20
)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= (10 * able) // 100 THEN place END AS rank
FROM scores s LEFT JOIN places USING (doc_id)
"""


def edit_sql(letter: str, cost: str, after: str, line: str | None = None) -> str:
    """An edit before the best edits of what follows: cost, audit, repaired lines."""
    lines = f"chr(10) || {line} || {after}.t" if line else f"{after}.t"
    return f"{{'c': {after}.c + {cost}, 'a': '{letter}' || {after}.a, 't': {lines}}}"


def row_edits_sql(state: int) -> str:
    """The best edits from before a row, whose role's letter is l, when ``state`` came last."""
    role = 3 if state == 2 else 2
    name = "'assistant'" if role == 3 else "'user'"
    late = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
    free = "fault IS NULL OR fault = 'truncated'"
    options = [
        edit_sql("D", "4", f"f{state}"),
        f"CASE WHEN ({free}) AND l = {name}[1] THEN {edit_sql('K', late, f'f{role}', "role || ':' || text")} END",
        f"CASE WHEN {free} THEN {edit_sql('R', f'3 + {late}', f'f{role}', f"{name} || ':' || text")} END",
    ]
    if state == 0:
        options.append(f"CASE WHEN ({free}) AND l = 's' THEN {edit_sql('K', late, 'f1', "role || ':' || text")} END")
    return f"list_min([{', '.join(options)}]) AS r{state}"


#: The edits are found from the last row backwards by dynamic programming.
REPAIR_SQL = f"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql(bytes_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"))} % 20 AS kind
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM base WHERE kind <> 0
  UNION ALL
  SELECT conv_id, turn, role, text FROM base WHERE kind = 3
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM damaged
), repeats AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) AS seen FROM placed
), judged AS (
  SELECT *, role[1] AS l, CASE
           WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
           WHEN seen > 1 THEN 'duplicate'
           WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY place) || role[1] AS pair
  FROM repeats
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), best AS (
  SELECT conv_id, n + 1 AS place, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS f0, {{'c': 6::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS f1,
         {{'c': 3::BIGINT, 'a': 'I', 't': chr(10) || 'assistant:'}} AS f2, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS f3
  FROM counts
  UNION ALL
  SELECT conv_id, place, list_min([r0, {edit_sql('I', '3', 'g2', "'user:'")}]), list_min([r1, {edit_sql('I', '3', 'g2', "'user:'")}]), g2, g3
  FROM (
    SELECT *, list_min([r2, {edit_sql('I', '3', 'r3', "'assistant:'")}]) AS g2, list_min([r3, {edit_sql('I', '3', 'r2', "'user:'")}]) AS g3
    FROM (
      SELECT j.conv_id, j.place, {', '.join(row_edits_sql(state) for state in range(4))}
      FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.place = b.place - 1
    )
  )
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(f0.c, 0) AS cost, coalesce(f0.a, '') AS audit,
       sha256(coalesce(substr(f0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id AND b.place = 1
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@llm_query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@llm_query("op2_embeddings")
def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


@llm_query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, pattern)
    return bpe.decode(encoded.drop("text"), ranks, pattern).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        bpe.digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@llm_query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    huffman.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), 50_257)
    read = huffman.read_tokens(spark, path)
    summary = stage(read.select("file", "start_in_file", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32")))
    return huffman.with_starts(summary).select("doc_id", "start", "n_tokens", "ids_crc32")


@llm_query("op5_chat_format", CHAT_SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@llm_query("op6_warc", WARC_SQL)
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@llm_query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_rules(table(spark, sf_dir, "documents"))


@llm_query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@llm_query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = recompress.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


@llm_query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@llm_query("op11_importance_resampling", IMPORTANCE_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@llm_query("op12_language_model")
def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"))


@llm_query("op13_conversation_repair", REPAIR_SQL)
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair.repair_conversations(conversations, repair.damage(repair.filled(conversations)))


LLM_CATALOG["pipeline"] = Entry(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)

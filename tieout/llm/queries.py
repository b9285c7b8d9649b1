"""One query per operator of this package, over whole tables, with the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import bpe, chat, counts, decontaminate, digests, licenses, lines, near, negatives, suffixes, topk, toxicity, whitening
from tieout.llm.stash import held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op8_toxicity")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"), usable=~held_out())
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), F.size("sentences").cast("long").alias("n_offending"))


@query("op5_minhash_near_dedup")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf, "documents"))


@query("op2_suffix_array_dedup")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cut = suffixes.without_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s.stop - s.start)
    return cut.select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length("kept") + removed).cast("bigint").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return bpe_digests(table(spark, sf, "documents"))


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode whole texts; digests of the ids and of the decoded bytes."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(docs, path), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_decontamination")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return decontaminate.leaks(docs, decontaminate.prepare(docs, table(spark, sf, "benchmark")))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), e AS (
  SELECT *, replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS safe,
         replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), chr(10), '\' || chr(10)) AS safe_role
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(safe) + length(safe_role) + 1 + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op1_chat_format", OP1_SQL)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = "'</s>[INST] ok [/INST]'"
    more = spark.sql(f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, {extra} AS text UNION ALL SELECT -7L, 1L, 'assistant', {extra}")
    return chat.digests(chat.format_conversations(turns.unionByName(more)))


OP4_SQL = """
WITH c AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS code FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.code, c.code), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


@query("op4_exact_topk", OP4_SQL)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s,
         list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS cc,
         list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl,
         list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS arr
  FROM w
), m AS (
  SELECT *, list_concat(cc, list_concat(gpl, arr)) AS places,
    list_filter([CASE WHEN len(cc) > 0 THEN 'cc-by' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(arr) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL) AS bl,
    list_filter([
      CASE WHEN regexp_matches(s, ' under the (terms of the )?mit license ') OR
        regexp_matches(s, ' permission is hereby granted free of charge to any person obtaining a copy of ([^ ]+ ){0,8}to deal in ([^ ]+ ){0,4}without restriction ') THEN 'mit' END,
      CASE WHEN regexp_matches(s, ' under the (terms of the )?apache license (version )?2 0 ') THEN 'apache-2.0' END,
      CASE WHEN regexp_matches(s, ' under the (terms of the )?gnu general public license (as published by the free software foundation )?(either )?version 2 ') THEN 'gpl-2.0' END,
      CASE WHEN regexp_matches(s, ' under the (terms of the )?gnu general public license (as published by the free software foundation )?(either )?version 3 ') THEN 'gpl-3.0' END,
      CASE WHEN regexp_matches(s, ' cc by 4 0 ') THEN 'cc-by-4.0' END,
      CASE WHEN regexp_matches(s, ' redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met ') THEN 'bsd' END,
      CASE WHEN regexp_matches(s, ' copyright (c )?([^ ]+ ){0,8}all rights reserved ') THEN 'copyright' END], lambda x: x IS NOT NULL) AS ol
  FROM b
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(places)::BIGINT AS n_base, (list_min(places) - 1)::BIGINT AS first_word, (list_max(places) - 1)::BIGINT AS last_word,
       array_to_string(list_sort(bl), ',') AS base_labels, array_to_string(list_sort(list_concat(bl, ol)), ',') AS labels,
       (CASE WHEN len(ol) > 0 THEN 1 WHEN len(bl) > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM m
"""


@query("op10_license_scan", OP10_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '(?s).*?(?:\n|[.!?][ \t\r\f\v\n]+)|.+\z') AS units FROM documents
), u AS (
  SELECT doc_id, text, unnest(units) AS unit, unnest(range(len(units))) AS pos FROM t
), o AS (
  SELECT *, coalesce(sum(length(unit)) OVER (PARTITION BY doc_id, text ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\f\v\n]+', ' ', 'g'), ' ') AS norm
  FROM u
), r AS (
  SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS FIRST, pos) > 1 AS repeats FROM o
), i AS (
  SELECT *, sum(CASE WHEN norm <> '' AND NOT repeats THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, text ORDER BY pos) AS island FROM r
), g AS (
  SELECT *, repeats AND sum(CASE WHEN repeats THEN length(norm) - length(replace(norm, ' ', '')) + 1 ELSE 0 END) OVER (PARTITION BY doc_id, text, island) >= 25 AS gone FROM i
)
SELECT t.doc_id, count(pos)::BIGINT AS n_units, count(*) FILTER (gone)::BIGINT AS n_removed,
       coalesce(string_agg(start || '-' || (start + length(unit)), ',' ORDER BY pos) FILTER (gone), '') AS removed,
       sha256(coalesce(string_agg(unit, '' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM t LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM t.doc_id AND g.text IS NOT DISTINCT FROM t.text GROUP BY t.doc_id, t.text
"""


@query("op3_line_dedup", OP3_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    cut = lines.without_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s.start.cast("string"), s.stop.cast("string"))), ",")
    return cut.select(F.col("row.doc_id").alias("doc_id"), "n_units", F.size("removed").cast("bigint").alias("n_removed"), spans.alias("removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_token_counts")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Two edits a document: its first twelve characters again in the middle, and a third of the way in forty characters go."""
    docs = table(spark, sf, "documents")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    half, third = F.floor(size / 2), F.floor(size / 3)
    edits = F.array(
        F.struct(half.alias("start"), half.alias("stop"), F.substring("text", 1, 12).alias("new")),
        F.struct(third.alias("start"), (third + 40).alias("stop"), F.lit("").alias("new")))
    return counts.count_edits(docs.select("doc_id", "text", edits.alias("edits")), public_tokenizers.path("byte_bpe_50k.tiktoken"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT doc_id, text_sha256, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@query("op13_exact_dedup", OP13_SQL)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    every = digests.exact_duplicates(table(spark, sf, "documents"))
    return every.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP12_SQL = """
WITH c AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS code
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.code, c.code), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM c a JOIN c ON a.vec_id <> c.vec_id AND len(a.code) = len(c.code) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query("op11_whitening")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    each = rows.select("vec_id", "n", F.col("deviation").cast("bigint").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")

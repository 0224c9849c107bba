"""Registered queries of the pipeline operators, and their DuckDB twins where SQL has one.

Every query applies its operator, with production parameters, to its whole table; digest
columns are derived from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicorn.llm import (bpe_codec, chat, cotraining, decontaminate, hamming_topk, hard_negatives, html_extract, sharding,
                           simhash, substring_dedup, token_counts, warc, whitening)
from lexicorn.llm.common import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_sharding")
def op1(spark, sf):
    return (sharding.shard_documents(table(spark, sf, "documents"), n_shards=40)
            .select("doc_id", "size",
                    F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
                    F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
                    F.col("grown_shard").cast("int").alias("grown_shard")))


@query("op2_quality")
def op2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    scored = cotraining.score_documents(docs, table(spark, sf, "labels"))
    return scored.select("doc_id", F.round("p_text", 6).alias("p_text"), F.round("p_meta", 6).alias("p_meta"),
                         F.round("score", 6).alias("score"), "keep")


_CHAT_ROWS = r"""
SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'"""


@query("op3_chat_format", rf"""
WITH r AS ({_CHAT_ROWS}),
e AS (SELECT *, replace(replace(replace(text, '\', '\b'), '### ', '\c'), '</turn>', '\d') AS esc,
  CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
  ELSE '\a' || replace(replace(replace(replace(role, '\', '\b'), '### ', '\c'), '</turn>', '\d'), ': ', '\e')
  END AS name FROM r),
g AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
  sum(4 + length(name) + 2 + length(esc) + 8) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g""")
def op3(spark, sf):
    hard = r"\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    out = (chat.format_conversations(rows)
           .withColumn("_turns", chat.parse("formatted"))
           .withColumn("_loss", chat.loss_text("segments")))
    said = F.array_join(F.transform(
        "_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("_turns").cast("long").alias("n_turns"),
                      F.sha2(said, 256).alias("turns_sha256"),
                      F.length("_loss").cast("long").alias("loss_chars"),
                      F.sha2("_loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


@query("op4_byte_bpe")
def op4(spark, sf):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return (bpe_codec.encode(docs, ranks, decoded=True)
            .select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                    F.sha2("ids_packed", 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256")))


@query("op5_html_text")
def op5(spark, sf):
    return (html_extract.extract(table(spark, sf, "pages"))
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))


@query("op6_hamming_topk", """
WITH c AS (SELECT vec_id AS id, list_sum(list_transform(range(64),
    lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << (63 - i) ELSE 0 END))::HUGEINT AS code
  FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT q.id AS query_id, x.id AS neighbor_id, CAST(bit_count(xor(q.code, x.code)) AS BIGINT) AS distance
  FROM c q, c x WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10""")
def op6(spark, sf):
    rows = table(spark, sf, "embeddings")
    return hamming_topk.search(rows, rows.filter("vec_id % 50 = 0"), k=10, bits=64)


@query("op7_decontaminate")
def op7(spark, sf):
    found = decontaminate.find_leaks(table(spark, sf, "documents").select("doc_id", "text"),
                                     table(spark, sf, "benchmark"))
    return (found.select("doc_id", F.explode("leaks").alias("x"))
            .select("doc_id", "x.item_id", F.col("x.segments").cast("long").alias("segments"),
                    F.col("x.edits").cast("long").alias("edits")))


@query("op8_simhash")
def op8(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents").select("doc_id", "text")) \
        .select("doc_id", "fingerprint", "component_id")


@query("op9_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f""")
def op9(spark, sf):
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    warc.write_arc(table(spark, sf, "pages"), arc)
    warc.write_warc(warc.convert(spark, arc), out)
    return warc.resolve(warc.read_warc(spark, out, payloads=False))


@query("op10_token_counts")
def op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, shared_path(spark, "token-cache"),
                                        public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op11_substring_dedup")
def op11(spark, sf):
    found = substring_dedup.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_hard_negatives", """
WITH r AS (SELECT row_number() OVER () AS rn, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.rn AS anchor, a.vec_id AS anchor_id, c.rn AS row, c.vec_id AS id, a.label = c.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.x) + 1), lambda i: a.x[i] * c.x[i])) AS BIGINT) AS score
  FROM r a, r c WHERE a.vec_id % 100 = 0 AND a.rn <> c.rn),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.row ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op12(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), label=label)


@query("op13_whitening")
def op13(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))

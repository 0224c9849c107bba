"""Registered queries: one Spark DataFrame job and (where SQL can say it) a DuckDB twin.

Every query reads the given tables and runs over them whole. Column names and
types are aligned with the SQL twins (integers BIGINT, floats DOUBLE rounded to 9
places, arrays rendered as space-joined strings where order matters).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicorn import sources as src
from lexicorn.functions import text as tx
from lexicorn.plans import sqltext as S
from lexicorn.session import ensure_checkpoint_dir, shared_path, write_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def clean_conversations(spark, sf):
    return src.conversations(spark, sf).select("row_id", tx.clean_text("text").alias("text"))


def clean_documents(spark, sf):
    return src.documents(spark, sf).select("row_id", tx.clean_text("text").alias("text"))


# ---------------------------------------------------------------- 2.1 / 2.2 text

@query("corpus_scan", f"""
SELECT row_id, text FROM ({S.CONV})""")
def corpus_scan(spark, sf):
    return src.conversations(spark, sf)


@query("first_rows", f"""
SELECT row_id, text FROM ({S.CONV}) ORDER BY row_id LIMIT 100""")
def first_rows(spark, sf):
    return src.first_rows(src.conversations(spark, sf), 100)


@query("clean_text", f"""
SELECT row_id, {S.clean(S.decorated())} AS clean FROM ({S.CONV})""")
def clean_text(spark, sf):
    return (src.decorated(src.conversations(spark, sf))
            .select("row_id", tx.clean_text("text").alias("clean")))


@query("clean_documents", f"""
SELECT row_id, {S.clean('text')} AS clean FROM ({S.DOCS})""")
def clean_documents_q(spark, sf):
    return src.documents(spark, sf).select("row_id", tx.clean_text("text").alias("clean"))


@query("clean_report", f"""
WITH c AS (SELECT text, {S.clean(S.decorated())} AS clean FROM ({S.CONV}))
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count_if(clean <> coalesce(text, '')) AS BIGINT) AS n_changed,
       CAST(sum(length(coalesce(text, '')) - length(clean)) AS BIGINT) AS chars_removed,
       CAST(count_if(clean = '') AS BIGINT) AS n_empty
FROM (SELECT {S.decorated()} AS text, {S.clean(S.decorated())} AS clean FROM ({S.CONV}))""")
def clean_report(spark, sf):
    d = src.decorated(src.conversations(spark, sf)).select(
        "text", tx.clean_text("text").alias("clean"))
    raw = F.coalesce(F.col("text"), F.lit(""))
    return d.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.count_if(F.col("clean") != raw).cast("bigint").alias("n_changed"),
        F.sum(F.length(raw) - F.length("clean")).cast("bigint").alias("chars_removed"),
        F.count_if(F.col("clean") == "").cast("bigint").alias("n_empty"))


@query("char_prompt_split", f"""
SELECT row_id, substr(clean, 1, {S.char_cut('clean', 0.5)}) AS prompt,
       substr(clean, {S.char_cut('clean', 0.5)} + 1) AS reference
FROM (SELECT row_id, {S.clean('text')} AS clean FROM ({S.CONV}))""")
def char_prompt_split(spark, sf):
    c = clean_conversations(spark, sf)
    return c.select("row_id", tx.char_prompt("text", 0.5).alias("prompt"),
                    tx.char_reference("text", 0.5).alias("reference"))


@query("strip_prompt", f"""
SELECT row_id, trim(substr(clean, {S.char_cut('clean', 0.5)} + 1)) AS rest
FROM (SELECT row_id, {S.clean('text')} AS clean FROM ({S.CONV}))""")
def strip_prompt_q(spark, sf):
    """The text without the prompt it begins with, trimmed."""
    return clean_conversations(spark, sf).select(
        "row_id", tx.strip_prefix("text", tx.char_prompt("text", 0.5)).alias("rest"))


# ---------------------------------------------------------------- 2.3 tokens / vocabulary
from lexicorn.functions import tokens as tk  # noqa: E402
from lexicorn.functions.hashing import sql_hash_uniform  # noqa: E402
from lexicorn.operators import batches as B  # noqa: E402
from lexicorn.operators import splits as SP  # noqa: E402
from lexicorn.operators import vocab as VO  # noqa: E402
from lexicorn.plans import pipeline as PL  # noqa: E402

CFG = PL.DEFAULT


@query("pretokenize", f"""
SELECT row_id, CAST(len({S.pretok('text')}) AS BIGINT) AS n_tokens,
       array_to_string({S.pretok('text')}, '|') AS tokens
FROM ({S.split_conv(CFG)})""")
def pretokenize_q(spark, sf):
    c = PL.split_corpus(spark, sf)
    t = tk.pretokenize("text")
    return c.select("row_id", F.size(t).cast("bigint").alias("n_tokens"),
                    F.array_join(t, "|").alias("tokens"))


@query("word_vocab", f"SELECT token, id, count FROM {S.vocab(CFG)}")
def word_vocab(spark, sf):
    return PL.corpus_vocab(spark, sf)


@query("eos_lookup", f"SELECT CAST(id AS INTEGER) AS eos_id FROM {S.vocab(CFG)} WHERE token = '<eos>'")
def eos_lookup(spark, sf):
    return VO.eos_id(PL.corpus_vocab(spark, sf))


@query("encode_ids", f"""
SELECT row_id, split, CAST(len(ids) AS BIGINT) AS n_ids, {S.ids_str('ids')} AS ids
FROM {S.encoded_conv(CFG)}""")
def encode_ids(spark, sf):
    e = PL.encoded_corpus(spark, sf)
    return e.select("row_id", "split", F.size("ids").cast("bigint").alias("n_ids"),
                    tk.ids_text("ids").alias("ids"))


@query("encode_documents", f"""
SELECT row_id, CAST(len(ids) AS BIGINT) AS n_ids, {S.ids_str('ids')} AS ids
FROM {S.encode(S.docs_clean(), CFG, max_length=None, append_eos=False)}""")
def encode_documents(spark, sf):
    voc = PL.corpus_vocab(spark, sf)
    e = VO.encode(PL.clean_docs(spark, sf), voc, max_length=None, append_eos=False)
    return e.select("row_id", F.size("ids").cast("bigint").alias("n_ids"),
                    tk.ids_text("ids").alias("ids"))


@query("truncate_mask", f"""
SELECT row_id, {S.ids_str('list_slice(ids, 1, 32)')} AS ids,
       {S.ids_str('list_transform(list_slice(ids, 1, 32), lambda x: 1)')} AS attention_mask
FROM {S.encode(S.split_conv(CFG), CFG, 'split', max_length=None, append_eos=False)}""")
def truncate_mask(spark, sf):
    voc = PL.corpus_vocab(spark, sf)
    e = VO.encode(PL.split_corpus(spark, sf), voc, max_length=32, append_eos=False)
    return e.select("row_id", tk.ids_text("ids").alias("ids"),
                    tk.ids_text(tk.attention_mask("ids")).alias("attention_mask"))


PROMPT_ROWS = f"""SELECT row_id, substr(text, 1, {S.char_cut('text', 0.5)}) AS text
FROM ({S.split_conv(CFG)})"""


@query("prompt_encode", f"""
SELECT row_id, {S.ids_str('ids')} AS prompt_ids
FROM {S.encode(PROMPT_ROWS, CFG, max_length=tk.MAX_GEN_LEN, append_eos=False)}""")
def prompt_encode(spark, sf):
    voc = PL.corpus_vocab(spark, sf)
    p = PL.split_corpus(spark, sf).select("row_id", tx.char_prompt("text", 0.5).alias("text"))
    e = VO.encode(p, voc, max_length=tk.MAX_GEN_LEN, append_eos=False)
    return e.select("row_id", tk.ids_text("ids").alias("prompt_ids"))


@query("decode_ids", f"""
SELECT row_id, decoded FROM {S.decode(f"SELECT row_id, ids FROM {S.encoded_conv(CFG)}", "x.ids", S.vocab(CFG), "decoded")}""")
def decode_ids(spark, sf):
    voc = PL.corpus_vocab(spark, sf)
    e = PL.encoded_corpus(spark, sf, vocab=voc).select("row_id", "ids")
    return VO.decode(e, voc).select("row_id", "decoded")


@query("cut_at_eos", f"""
SELECT row_id,
  {S.ids_str("CASE WHEN list_position(x, 1) > 0 THEN list_slice(x, 1, list_position(x, 1) - 1) ELSE x END")} AS cut
FROM (SELECT row_id, CASE WHEN list_position(ids, 0) > 0 THEN list_slice(ids, 1, list_position(ids, 0) - 1)
      ELSE ids END AS x FROM {S.encoded_conv(CFG)})""")
def cut_at_eos(spark, sf):
    e = PL.encoded_corpus(spark, sf)
    return e.select("row_id", tk.ids_text(tk.cut_at_pad_then_eos("ids")).alias("cut"))


@query("token_prompt_split", f"""
SELECT row_id, {S.ids_str('list_slice(s, 1, CAST(floor(len(s) * 0.5) AS INTEGER))')} AS prompt_ids,
       {S.ids_str('list_slice(s, CAST(floor(len(s) * 0.5) AS INTEGER) + 1, len(s))')} AS reference_ids
FROM (SELECT row_id, list_slice(ids, 1, len(ids) - 1) AS s FROM {S.encoded_conv(CFG)}) WHERE len(s) > 0""")
def token_prompt_split(spark, sf):
    e = PL.encoded_corpus(spark, sf).withColumn("s", tk.cut_at("ids", tk.EOS_ID))
    e = e.filter(F.size("s") > 0)
    return e.select("row_id", tk.ids_text(tk.token_prompt("s", 0.5)).alias("prompt_ids"),
                    tk.ids_text(tk.token_reference("s", 0.5)).alias("reference_ids"))


# ---------------------------------------------------------------- 2.4 splits, batches

@query("split_hash", f"SELECT row_id, split FROM ({S.split_conv(CFG)})")
def split_hash(spark, sf):
    return PL.split_corpus(spark, sf).select("row_id", "split")


def _exact_sql(cfg) -> str:
    from lexicorn.functions.hashing import sql_hash_uniform as H
    u1, u2 = H(cfg.seed, "row_id"), H(f"{cfg.seed}:2", "row_id")
    val_rel = cfg.val / (cfg.val + cfg.test)
    return f"""
WITH c AS (SELECT row_id, {u1} AS u1, {u2} AS u2 FROM ({S.CONV})),
n AS (SELECT count(*) AS n FROM c),
r1 AS (SELECT c.*, row_number() OVER (ORDER BY u1, row_id) AS rk FROM c),
sz AS (SELECT n - CAST(ceil(CAST({1.0 - cfg.train!r} AS DOUBLE) * n) AS BIGINT) AS n_train,
              CAST(ceil(CAST({1.0 - cfg.train!r} AS DOUBLE) * n) AS BIGINT) AS n_rest FROM n),
rest AS (SELECT r1.row_id, r1.u2, row_number() OVER (ORDER BY u2, row_id) AS rk2
         FROM r1, sz WHERE r1.rk > sz.n_train)
SELECT row_id, 'train' AS split FROM r1, sz WHERE rk <= n_train
UNION ALL
SELECT row_id, CASE WHEN rk2 <= n_rest - CAST(ceil(CAST({1.0 - val_rel!r} AS DOUBLE) * n_rest) AS BIGINT)
                    THEN 'validation' ELSE 'test' END FROM rest, sz"""


@query("split_exact", _exact_sql(CFG))
def split_exact(spark, sf):
    return SP.exact_split(src.conversations(spark, sf).select("row_id"), CFG.train, CFG.val,
                          CFG.test, CFG.seed)


@query("holdout", f"""
SELECT row_id, {sql_hash_uniform(f"{CFG.seed}:holdout", 'row_id')} < 0.1 AS holdout
FROM ({S.CONV})""")
def holdout_q(spark, sf):
    return SP.holdout(src.conversations(spark, sf).select("row_id"), 0.1, CFG.seed)


@query("concat_splits", f"""
SELECT split, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(len(ids)) AS BIGINT) AS n_ids
FROM (SELECT split, ids FROM {S.encoded_conv(CFG)} WHERE split IN ('train', 'validation', 'test')
      UNION ALL SELECT 'documents' AS split, ids FROM {S.encode(S.docs_clean(), CFG)})
GROUP BY split""")
def concat_splits(spark, sf):
    voc = PL.corpus_vocab(spark, sf)
    e = PL.encoded_corpus(spark, sf, vocab=voc)
    parts = [e.filter(F.col("split") == s).select("split", "ids") for s in ("train", "validation", "test")]
    d = PL.encoded_docs(spark, sf, vocab=voc).select(F.lit("documents").alias("split"), "ids")
    u = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(d)
    return u.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                  F.sum(F.size("ids")).cast("bigint").alias("n_ids"))


@query("semi_lookup", """
SELECT doc_id AS row_id, n_chars FROM documents d
WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)""")
def semi_lookup(spark, sf):
    d = src.table(spark, sf, "documents").select(F.col("doc_id"), "n_chars")
    lab = src.table(spark, sf, "labels").filter(F.col("quality") == 1).select("doc_id")
    return d.join(lab, on="doc_id", how="left_semi").select(F.col("doc_id").alias("row_id"), "n_chars")


def _epoch_sql(seed: int, epoch: int) -> str:
    from lexicorn.functions.hashing import sql_hash_uniform as H
    return f"""SELECT row_id, CAST(row_number() OVER (ORDER BY {H(seed, f"'{epoch}'", 'row_id')}, row_id) - 1 AS BIGINT) AS rank
FROM ({S.split_conv(CFG)}) WHERE split = 'train'"""


@query("epoch_order", _epoch_sql(CFG.seed, 1))
def epoch_order(spark, sf):
    t = PL.split_corpus(spark, sf).filter(F.col("split") == "train").select("row_id")
    t = t.withColumn("_k", B.epoch_key(CFG.seed, 1))
    return B.dense_rank_by(t, ["_k", "row_id"]).select("row_id", "rank")


EVAL_BATCH = 10
_BATCHED_SQL = f"""SELECT row_id, ids, CAST((row_number() OVER (ORDER BY row_id) - 1) // {EVAL_BATCH} AS BIGINT) AS batch_id
FROM {S.encode(S.split_conv(CFG), CFG, 'split', append_eos=False)} WHERE split = 'test'"""


def _batched(spark, sf):
    e = VO.encode(PL.split_corpus(spark, sf), PL.corpus_vocab(spark, sf),
                  max_length=CFG.max_length, append_eos=False).filter(F.col("split") == "test")
    return B.assign_batches(B.dense_rank_by(e, ["row_id"]), EVAL_BATCH)


@query("batch_ids", f"SELECT row_id, batch_id FROM ({_BATCHED_SQL})")
def batch_ids(spark, sf):
    return _batched(spark, sf).select("row_id", "batch_id")


_PAD_SQL = f"""SELECT row_id, batch_id, ids, max(len(ids)) OVER (PARTITION BY batch_id) AS m FROM ({_BATCHED_SQL})"""


@query("row_access", f"""
SELECT n_rows, rank, row_id, n_ids FROM (SELECT count(*) OVER () AS n_rows, row_number() OVER (ORDER BY row_id) - 1 AS rank,
  row_id, CAST(len(ids) AS BIGINT) AS n_ids FROM ({_BATCHED_SQL})) WHERE rank % 7 = 3""")
def row_access_q(spark, sf):
    """Length of the row set, and its rows at given places."""
    e = VO.encode(PL.split_corpus(spark, sf), PL.corpus_vocab(spark, sf), max_length=CFG.max_length,
                  append_eos=False).filter(F.col("split") == "test")
    ranked = write_once(B.dense_rank_by(e, ["row_id"]))
    size = ranked.agg(F.count("*").alias("n_rows"))  # one row
    return (ranked.filter(F.col("rank") % 7 == 3).join(F.broadcast(size), how="inner", on=F.lit(True))
            .select("n_rows", "rank", "row_id", F.size("ids").cast("bigint").alias("n_ids")))


@query("pad_collate", f"""
SELECT row_id, batch_id,
  {S.ids_str("list_concat(ids, list_transform(generate_series(1, m - len(ids)), lambda x: 0))")} AS input_ids,
  {S.ids_str("list_concat(list_transform(ids, lambda x: 1), list_transform(generate_series(1, m - len(ids)), lambda x: 0))")} AS attention_mask
FROM ({_PAD_SQL})""")
def pad_collate_q(spark, sf):
    p = B.pad_collate(_batched(spark, sf))
    return p.select("row_id", "batch_id", tk.ids_text("input_ids").alias("input_ids"),
                    tk.ids_text("attention_mask").alias("attention_mask"))


@query("shift_labels", f"""
SELECT row_id, {S.ids_str("CASE WHEN m > 0 THEN list_concat(list_slice(p, 2, m), [-100]) ELSE [] END")} AS labels
FROM (SELECT row_id, m, list_concat(ids, list_transform(generate_series(1, m - len(ids)), lambda x: 0)) AS p
      FROM ({_PAD_SQL}))""")
def shift_labels(spark, sf):
    p = B.pad_collate(_batched(spark, sf))
    return p.select("row_id", tk.ids_text("labels").alias("labels"))


# ---------------------------------------------------------------- 2.5 model
from lexicorn.operators import ngram as NG  # noqa: E402
from lexicorn.streaming import counts_stream as CS  # noqa: E402
from lexicorn.streaming.clean_stream import cleaned_stream  # noqa: E402

LAMBDAS = NG.uniform_lambdas(CFG.order)


def _rows_sql(split: str) -> str:
    return f"SELECT row_id, ids FROM {S.encoded_conv(CFG)} WHERE split = '{split}'"


_TRAIN_NG = S.ngrams(_rows_sql("train"), CFG.order)
_TRAIN_NG2 = S.ngrams(_rows_sql("train"), CFG.order, min_count=2)


def _enc_voc(spark, sf):
    """The encoded corpus, written once (fits and scores of a query read it several times), and
    the vocabulary that made it."""
    voc = PL.corpus_vocab(spark, sf)
    return write_once(PL.encoded_corpus(spark, sf, vocab=voc)), voc


def _enc(spark, sf):
    return _enc_voc(spark, sf)[0]


def _model(spark, sf, min_count: int = 1, enc=None):
    """The fitted model, its tables written once: everything after reads them."""
    e = enc if enc is not None else _enc(spark, sf)
    return NG.fit(e.filter(F.col("split") == "train"), CFG.order, CFG.vocab_size,
                  min_count=min_count, lambdas=LAMBDAS).materialize()


def _train_counts(spark, sf):
    """Counts straight from the encoded rows: nothing is written that is read once."""
    train = PL.encoded_corpus(spark, sf).filter(F.col("split") == "train")
    return NG.ngram_counts(train, CFG.order)


@query("ngram_counts", f"SELECT k, {S.ctx_str()} AS ctx, w, c FROM {_TRAIN_NG}")
def ngram_counts_q(spark, sf):
    return _train_counts(spark, sf).select("k", tk.ids_text("ctx").alias("ctx"), "w", "c")


@query("stream_counts", f"SELECT k, {S.ctx_str()} AS ctx, w, c "
       f"FROM {S.ngrams(f'SELECT row_id, ids FROM {S.encoded_conv(CFG)}', CFG.order)}")
def stream_counts_q(spark, sf):
    """The conversations as a stream of files, counted by micro-batch."""
    count = CS.text_counter(PL.corpus_vocab(spark, sf), CFG.order, CFG.append_eos)
    folder = shared_path(spark, "counts")
    # a pattern, since a stream takes a folder or a pattern, and the table may be a single file
    landed = cleaned_stream(spark, f"{sf.rstrip('/')}/conversations*.parquet")
    CS.start_counts(landed, folder, count).awaitTermination()
    return CS.counts(spark, folder).select("k", tk.ids_text("ctx").alias("ctx"), "w", "c")


@query("context_totals", f"SELECT k, {S.ctx_str()} AS ctx, n FROM {S.contexts(_TRAIN_NG)}")
def context_totals_q(spark, sf):
    return NG.context_totals(_train_counts(spark, sf)).select("k", tk.ids_text("ctx").alias("ctx"), "n")


@query("prune_ngrams", f"""
SELECT g.k, {S.ctx_str('g.ctx')} AS ctx, g.w, g.c, x.n
FROM {_TRAIN_NG2} g JOIN {S.contexts(_TRAIN_NG2)} x ON x.k = g.k AND x.ctx = g.ctx""")
def prune_ngrams_q(spark, sf):
    m = _model(spark, sf, min_count=2)
    return (m.ngrams.join(m.contexts, on=["k", "ctx"])
            .select("k", tk.ids_text("ctx").alias("ctx"), "w", "c", "n"))


_TEST_LEVELS = S.level_probs(_rows_sql("test"), _TRAIN_NG, CFG.order)
_TEST_P = f"(SELECT row_id, j, w, {S.mixture(LAMBDAS, CFG.vocab_size, CFG.order)} AS p FROM {_TEST_LEVELS})"


@query("position_scores", f"SELECT row_id, CAST(j AS INTEGER) AS j, w, round(p, 9) AS p FROM {_TEST_P}")
def position_scores_q(spark, sf):
    enc = _enc(spark, sf)
    m = _model(spark, sf, enc=enc)
    sc = NG.position_scores(m, enc.filter(F.col("split") == "test"))
    return sc.select("row_id", "j", "w", F.round("p", 9).alias("p"))


@query("cross_entropy", f"SELECT round(avg(-ln(p)), 9) AS mean_nll FROM {_TEST_P}")
def cross_entropy_q(spark, sf):
    enc = _enc(spark, sf)
    sc = NG.window_scores(_model(spark, sf, enc=enc), enc.filter(F.col("split") == "test"))
    return sc.agg(F.round(F.sum(F.col("nll") * F.col("n")) / F.sum("n"), 9).alias("mean_nll"))


@query("perplexity", f"""
SELECT round(sum(-ln(p)), 9) AS sum_nll, CAST(count(*) AS BIGINT) AS n_tokens,
       round(CASE WHEN count(*) > 0 THEN exp(sum(-ln(p)) / count(*)) ELSE 'inf'::DOUBLE END, 9) AS perplexity
FROM {_TEST_P}""")
def perplexity_q(spark, sf):
    enc = _enc(spark, sf)
    sc = NG.window_scores(_model(spark, sf, enc=enc), enc.filter(F.col("split") == "test"))
    return NG.perplexity(sc).select(F.round("sum_nll", 9).alias("sum_nll"),
                                    F.col("n_tokens").cast("bigint").alias("n_tokens"),
                                    F.round("perplexity", 9).alias("perplexity"))


def _em_sql() -> str:
    lv = S.level_probs(_rows_sql("validation"), _TRAIN_NG, CFG.order)
    mix = S.mixture(LAMBDAS, CFG.vocab_size, CFG.order)
    r = [f"avg({LAMBDAS[0] / CFG.vocab_size!r} / p) AS r0"] + [
        f"avg({LAMBDAS[k]!r} * p{k} / p) AS r{k}" for k in range(1, CFG.order + 1)]
    tot = " + ".join(f"r{k}" for k in range(CFG.order + 1))
    rows = " UNION ALL ".join(
        f"SELECT {k} AS level, round(r{k} / ({tot}), 9) AS weight FROM agg" for k in range(CFG.order + 1))
    return f"""WITH lv AS (SELECT *, {mix} AS p FROM {lv}),
agg AS (SELECT {', '.join(r)} FROM lv)
SELECT CAST(level AS INTEGER) AS level, weight FROM ({rows})"""


@query("em_step", _em_sql())
def em_step_q(spark, sf):
    enc = _enc(spark, sf)
    m = _model(spark, sf, enc=enc)
    lv = NG.window_levels(m, enc.filter(F.col("split") == "validation"))
    new, _ = NG.em_update(m, lv, lr=1.0)
    return spark.createDataFrame([(k, round(x, 9)) for k, x in enumerate(new)],
                                 "level int, weight double")


# ---------------------------------------------------------------- 2.7 ROUGE
from lexicorn.operators import distribution as DI  # noqa: E402
from lexicorn.operators import generate as GE  # noqa: E402
from lexicorn.operators import rouge as RG  # noqa: E402
from lexicorn.operators.stem import stem_tokens  # noqa: E402
from lexicorn.plans import evaluate as EV  # noqa: E402

_HALVES_SQL = f"""SELECT row_id, {S.rouge_tok(f"substr(text, 1, {S.char_cut('text', 0.5)})")} AS rt,
       {S.rouge_tok(f"substr(text, {S.char_cut('text', 0.5)} + 1)")} AS ht FROM ({S.split_conv(CFG)})"""


def _halves(spark, sf):
    c = PL.split_corpus(spark, sf)
    return c.select("row_id", tk.rouge_tokens(tx.char_prompt("text")).alias("rt"),
                    tk.rouge_tokens(tx.char_reference("text")).alias("ht"))


@query("rouge_tokens", f"""
SELECT row_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT row_id, {S.rouge_tok('text')} AS t FROM ({S.split_conv(CFG)}))""")
def rouge_tokens_q(spark, sf):
    t = tk.rouge_tokens("text")
    return PL.split_corpus(spark, sf).select(
        "row_id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query("lcs_length", f"SELECT row_id, CAST({S.lcs('rt', 'ht')} AS INTEGER) AS lcs FROM ({_HALVES_SQL})")
def lcs_length_q(spark, sf):
    return _halves(spark, sf).select("row_id", RG.lcs_length("rt", "ht").alias("lcs"))


_F1_SQL = f"""SELECT row_id, round({S.f1('l', 'len(rt)', 'len(ht)')}, 9) AS rouge_l
FROM (SELECT row_id, rt, ht, {S.lcs('rt', 'ht')} AS l FROM ({_HALVES_SQL}))"""


@query("rouge_l", _F1_SQL)
def rouge_l_q(spark, sf):
    h = _halves(spark, sf)
    f = RG.f1_from_lcs(RG.lcs_length("rt", "ht"), F.size("rt"), F.size("ht"))
    return h.select("row_id", F.round(f, 9).alias("rouge_l"))


@query("rouge_l_native", _F1_SQL)
def rouge_l_native_q(spark, sf):
    h = _halves(spark, sf)
    f = RG.f1_from_lcs(RG.lcs_length_native("rt", "ht"), F.size("rt"), F.size("ht"))
    return h.select("row_id", F.round(f, 9).alias("rouge_l"))


@query("rouge_mean", f"SELECT round(coalesce(avg(rouge_l), 0.0), 9) AS rouge_l FROM ({_F1_SQL})")
def rouge_mean_q(spark, sf):
    c = PL.split_corpus(spark, sf)
    d = c.select("row_id", tx.char_prompt("text").alias("hyp"), tx.char_reference("text").alias("ref"))
    per = RG.rouge_l(d, "ref", "hyp", stem=False)
    return per.agg(F.round(F.coalesce(F.avg("rouge_l"), F.lit(0.0)), 9).alias("rouge_l"))


@query("stem_words")
def stem_words_q(spark, sf):
    w = PL.split_corpus(spark, sf).select(F.explode(tk.rouge_tokens("text")).alias("word")).distinct()
    return stem_tokens(w.withColumn("s", F.array("word")), "s").select("word", F.col("s")[0].alias("stem"))


@query("rouge_l_stemmed")
def rouge_l_stemmed_q(spark, sf):
    c = PL.split_corpus(spark, sf)
    d = c.select("row_id", tx.char_prompt("text").alias("hyp"), tx.char_reference("text").alias("ref"))
    return RG.rouge_l(d, "ref", "hyp", stem=True).select("row_id", F.round("rouge_l", 9).alias("rouge_l"))


# ---------------------------------------------------------------- 2.6 distributions
_BIGRAM_SQL = f"""SELECT array_to_string(g.ctx, ' ') AS ctx, g.w AS token, CAST(g.c AS DOUBLE) / x.n AS p
FROM {_TRAIN_NG} g JOIN {S.contexts(_TRAIN_NG)} x ON x.k = g.k AND x.ctx = g.ctx WHERE g.k = 2"""


def _bigram(spark, sf):
    m = _model(spark, sf)
    g = m.ngrams.filter(F.col("k") == 2).join(m.contexts.filter(F.col("k") == 2), on=["k", "ctx"])
    return g.select(tk.ids_text("ctx").alias("ctx"), F.col("w").alias("token"),
                    (F.col("c").cast("double") / F.col("n")).alias("p"))


_TEMP_SQL = f"""SELECT ctx, token, q / sum(q) OVER (PARTITION BY ctx) AS p FROM
(SELECT ctx, token, pow(p / max(p) OVER (PARTITION BY ctx), {1.0 / 0.7!r}) AS q FROM ({_BIGRAM_SQL}))"""


@query("temperature", f"SELECT ctx, token, round(p, 9) AS p FROM ({_TEMP_SQL})")
def temperature_q(spark, sf):
    return DI.apply_temperature(_bigram(spark, sf), 0.7).select("ctx", "token", F.round("p", 9).alias("p"))


_TOPP_SQL = f"""SELECT ctx, token, p FROM (SELECT ctx, token, p,
  round(sum(p) OVER (PARTITION BY ctx ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {DI.PLACES}) AS cum,
  row_number() OVER (PARTITION BY ctx ORDER BY p DESC, token) AS rn FROM ({_BIGRAM_SQL}))
WHERE cum <= 0.9 OR rn = 1"""


@query("top_p", f"SELECT ctx, token, round(p, 9) AS p FROM ({_TOPP_SQL})")
def top_p_q(spark, sf):
    return DI.top_p_filter(_bigram(spark, sf), 0.9).select("ctx", "token", F.round("p", 9).alias("p"))


_RENORM_SQL = f"SELECT ctx, token, p / sum(p) OVER (PARTITION BY ctx) AS p FROM ({_TOPP_SQL})"


@query("renormalise", f"SELECT ctx, token, round(p, 9) AS p FROM ({_RENORM_SQL})")
def renormalise_q(spark, sf):
    d = DI.renormalise(DI.top_p_filter(_bigram(spark, sf), 0.9))
    return d.select("ctx", "token", F.round("p", 9).alias("p"))


def _draw_sql() -> str:
    from lexicorn.functions.hashing import sql_hash_uniform as H
    return f"""SELECT ctx, token FROM (SELECT ctx, token, row_number() OVER (PARTITION BY ctx ORDER BY rn) AS pick
  FROM (SELECT ctx, token, {H(CFG.seed, 'ctx')} AS u,
     round(sum(p) OVER (PARTITION BY ctx ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {DI.PLACES}) AS cum,
     round(sum(p) OVER (PARTITION BY ctx), {DI.PLACES}) AS tot,
     row_number() OVER (PARTITION BY ctx ORDER BY p DESC, token) AS rn FROM ({_RENORM_SQL}))
  WHERE cum > u OR cum >= tot) WHERE pick = 1"""


@query("draw_token", _draw_sql())
def draw_token_q(spark, sf):
    d = DI.renormalise(DI.top_p_filter(_bigram(spark, sf), 0.9))
    return DI.draw(d, CFG.seed)


# ---------------------------------------------------------------- 2.6 generation
_PROMPTS_SQL = f"""SELECT row_id AS seq_id, list_slice(s, 1, CAST(floor(len(s) * 0.5) AS INTEGER)) AS prompt_ids,
  list_slice(s, CAST(floor(len(s) * 0.5) AS INTEGER) + 1, len(s)) AS ref_ids
FROM (SELECT row_id, {S.cut_eos("(CASE WHEN list_position(ids, 0) > 0 THEN list_slice(ids, 1, list_position(ids, 0) - 1) ELSE ids END)")} AS s
      FROM {S.encoded_conv(CFG)} WHERE split = 'test') WHERE len(s) > 0"""


def _gen_sql(rounds: int) -> str:
    return S.greedy_rounds(_PROMPTS_SQL, _TRAIN_NG, CFG.order, LAMBDAS, CFG.vocab_size, rounds)


def _prompts(enc):
    seq = (enc.filter(F.col("split") == "test")
           .select("row_id", tk.cut_at_pad_then_eos("ids").alias("s")).filter(F.size("s") > 0))
    return seq.select(F.col("row_id").alias("seq_id"), tk.token_prompt("s").alias("prompt_ids"),
                      tk.token_reference("s").alias("ref_ids"))


@query("next_token", _gen_sql(1) + "\nSELECT seq_id AS row_id, CAST(ids[-1] AS INTEGER) AS next FROM g1 WHERE n_new = 1")
def next_token_q(spark, sf):
    enc = _enc(spark, sf)
    g = GE.generate(_model(spark, sf, enc=enc), _prompts(enc), max_new=1)
    return g.filter(F.size("gen_ids") == F.size("prompt_ids") + 1).select(
        F.col("seq_id").alias("row_id"), F.element_at("gen_ids", -1).cast("int").alias("next"))


@query("generate_greedy", _gen_sql(20) + f"\nSELECT seq_id AS row_id, {S.ids_str('ids')} AS gen_ids FROM g20")
def generate_greedy_q(spark, sf):
    enc = _enc(spark, sf)
    g = GE.generate(_model(spark, sf, enc=enc), _prompts(enc), max_new=20)
    return g.select(F.col("seq_id").alias("row_id"), tk.ids_text("gen_ids").alias("gen_ids"))


@query("n_words", _gen_sql(5) + f"""
SELECT row_id, trim(words) AS words FROM {S.decode(
    f"SELECT seq_id AS row_id, {S.continuation()} AS cont FROM g5", "x.cont", S.vocab(CFG), "words")}""")
def n_words_q(spark, sf):
    enc, voc = _enc_voc(spark, sf)
    g = GE.generate(_model(spark, sf, enc=enc), _prompts(enc), max_new=5)
    g = g.select(F.col("seq_id").alias("row_id"), GE.continuation().alias("cont"))
    return VO.decode(g, voc, ids_col="cont", out_col="words").select("row_id", F.trim("words").alias("words"))


@query("generate_sampled", S.sampled_rounds(_PROMPTS_SQL, _TRAIN_NG, CFG.order, LAMBDAS, CFG.vocab_size, 20, 0.8, 0.9,
                                             CFG.seed)
       + f"\nSELECT seq_id AS row_id, {S.ids_str('ids')} AS gen_ids FROM g20")
def generate_sampled_q(spark, sf):
    enc = _enc(spark, sf)
    g = GE.generate(_model(spark, sf, enc=enc), _prompts(enc), max_new=20, sampling=True,
                    temperature=0.8, top_p=0.9, seed=CFG.seed)
    return g.select(F.col("seq_id").alias("row_id"), tk.ids_text("gen_ids").alias("gen_ids"))


# ---------------------------------------------------------------- 2.7 evaluation (E8, E9)
def _eval_tokens_sql() -> str:
    g = _gen_sql(20)
    cont = S.cut_eos(S.continuation())
    voc = S.vocab(CFG)
    return g + f""",
gd AS {S.decode(f"SELECT seq_id AS row_id, {cont} AS g FROM g20", "x.g", voc, "prediction")},
rd AS {S.decode(f"SELECT seq_id AS row_id, ref_ids FROM ({_PROMPTS_SQL})", "x.ref_ids", voc, "reference")},
tt AS (SELECT {S.rouge_tok('rd.reference')} AS rt, {S.rouge_tok('gd.prediction')} AS ht
       FROM gd JOIN rd ON rd.row_id = gd.row_id),
ll AS (SELECT rt, ht, {S.lcs('rt', 'ht')} AS l FROM tt),
pp AS (SELECT exp(sum(-ln(p)) / count(*)) AS perplexity FROM {_TEST_P})
SELECT round(coalesce(avg({S.f1('l', 'len(rt)', 'len(ht)')}), 0.0), 9) AS rouge_l,
       CAST(count(*) AS BIGINT) AS n_examples, round(any_value(pp.perplexity), 9) AS perplexity
FROM ll, pp"""


@query("evaluate_tokens", _eval_tokens_sql())
def evaluate_tokens_q(spark, sf):
    enc, voc = _enc_voc(spark, sf)
    summary, _ = EV.evaluate_tokens(_model(spark, sf, enc=enc), enc.filter(F.col("split") == "test"),
                                    voc, stem=False)
    return summary.select(F.round("rouge_l", 9).alias("rouge_l"),
                          F.col("n_examples").cast("bigint").alias("n_examples"),
                          F.round("perplexity", 9).alias("perplexity"))


_CHAR_PROMPTS = f"""SELECT row_id, substr(text, 1, {S.char_cut('text', 0.5)}) AS text,
  substr(text, {S.char_cut('text', 0.5)} + 1) AS reference FROM ({S.split_conv(CFG)}) WHERE split = 'test'"""


def _complete_sql() -> str:
    prompts = f"SELECT row_id AS seq_id, ids AS prompt_ids FROM {S.encode(_CHAR_PROMPTS, CFG, max_length=None, append_eos=False)}"
    g = S.greedy_rounds(prompts, _TRAIN_NG, CFG.order, LAMBDAS, CFG.vocab_size, 20)
    cont = S.cut_eos(S.continuation())
    return g + f""",
gd AS {S.decode(f"SELECT seq_id AS row_id, {cont} AS g FROM g20", "x.g", S.vocab(CFG), "prediction")},
cp AS (SELECT c.row_id, c.text AS prompt, c.reference, gd.prediction FROM ({_CHAR_PROMPTS}) c JOIN gd ON gd.row_id = c.row_id)"""


@query("complete_set", _complete_sql() + "\nSELECT row_id, prompt, prediction FROM cp")
def complete_set_q(spark, sf):
    enc, voc = _enc_voc(spark, sf)
    texts = PL.split_corpus(spark, sf).filter(F.col("split") == "test").select("row_id", "text")
    c = EV.completions_by_chars(_model(spark, sf, enc=enc), texts, voc)
    return c.select("row_id", "prompt", "prediction")


@query("evaluate_chars", _complete_sql() + f""",
ll AS (SELECT rt, ht, {S.lcs('rt', 'ht')} AS l FROM (SELECT {S.rouge_tok('reference')} AS rt,
       {S.rouge_tok('prediction')} AS ht FROM cp))
SELECT round(coalesce(avg({S.f1('l', 'len(rt)', 'len(ht)')}), 0.0), 9) AS rouge_l FROM ll""")
def evaluate_chars_q(spark, sf):
    enc, voc = _enc_voc(spark, sf)
    texts = PL.split_corpus(spark, sf).filter(F.col("split") == "test").select("row_id", "text")
    avg, _ = EV.evaluate_chars(_model(spark, sf, enc=enc), texts, voc, stem=False)
    return avg.select(F.round("rouge_l", 9).alias("rouge_l"))


# ---------------------------------------------------------------- 2.1 / 2.5 model store, training
from lexicorn.plans import experiment as XP  # noqa: E402
from lexicorn.sources import store as ST  # noqa: E402


@query("model_roundtrip", f"""
SELECT k, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(c) AS BIGINT) AS total FROM {_TRAIN_NG} GROUP BY k""")
def model_roundtrip_q(spark, sf):
    path = shared_path(spark, "model")
    ST.save_model(_model(spark, sf), path, tag="best")
    m = ST.load_model(spark, path)
    return m.ngrams.groupBy("k").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                     F.sum("c").cast("bigint").alias("total"))


# two epochs more than the patience, so that the stop can fire
_PATIENCE = 2
_GRID = XP.param_grid(lr=[0.5, 1.0], order=[2, 3], min_count=[1], epochs=[4], patience=[_PATIENCE])


def _results_dir(spark, sf) -> str:
    """Where this application keeps the grid results of a data folder: the report queries read
    what the grid query has written there, and run the missing cells themselves."""
    name = hashlib.md5(sf.encode()).hexdigest()[:12]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/grid-{spark.sparkContext.applicationId}-{name}"


_EM_EPOCHS, _EM_LR = 4, 0.5


_HELD = (f"(SELECT row_id, split, ids, {sql_hash_uniform(f'{CFG.seed}:holdout', 'row_id')} < 0.1 AS holdout "
         f"FROM {S.encoded_conv(CFG)})")


def _mix_sql(lam: str, order: int) -> str:
    expr = f"({lam}.l0 / {float(CFG.vocab_size)!r})"
    for k in range(1, order + 1):
        expr = f"({expr} + {lam}.l{k} * p{k})"
    return expr


def _em_chain(fit_rows: str, em_rows: str, val_rows: str, order: int, min_count: int, lr: float, epochs: int) -> list[str]:
    """CTEs of the EM loop, unrolled: lam{e} are the weights after epoch e and the loss before,
    pp{e} the validation perplexity. The row sets select (row_id, ids) from ``held``."""
    levels, start = range(order + 1), NG.uniform_lambdas(order)
    parts = [f"held AS MATERIALIZED {_HELD}", f"ngm AS MATERIALIZED {S.ngrams(fit_rows, order, min_count=min_count)}",
             "tr AS MATERIALIZED " + S.level_probs(em_rows, "ngm", order),
             "va AS MATERIALIZED " + S.level_probs(val_rows, "ngm", order),
             "lam0 AS (SELECT " + ", ".join(f"{start[k]!r} AS l{k}" for k in levels) + ")"]
    for e in range(1, epochs + 1):
        o, n = f"lam{e - 1}", f"lam{e}"
        r = [f"avg(l0 / {float(CFG.vocab_size)!r} / p) AS r0"] + [f"avg(l{k} * p{k} / p) AS r{k}" for k in levels[1:]]
        tot = " + ".join(f"r{k}" for k in levels)
        parts.append(f"st{e} AS (SELECT {', '.join(r)}, avg(-ln(p)) AS nll FROM (SELECT *, {_mix_sql(o, order)} AS p FROM tr, {o}))")
        parts.append(f"{n} AS MATERIALIZED (SELECT " + ", ".join(
            f"round({1.0 - lr!r} * {o}.l{k} + {lr!r} * (r{k} / ({tot})), 12) AS l{k}" for k in levels)
            + f", st{e}.nll AS nll FROM st{e}, {o})")
        parts.append(f"pp{e} AS (SELECT exp(sum(-ln(p)) / count(*)) AS ppl FROM (SELECT {_mix_sql(n, order)} AS p FROM va, {n}))")
    return parts


def _em_epochs_sql() -> str:
    parts = _em_chain("SELECT row_id, ids FROM held WHERE split = 'train' AND NOT holdout",
                      "SELECT row_id, ids FROM held WHERE split = 'train' AND holdout",
                      "SELECT row_id, ids FROM held WHERE split = 'validation'", CFG.order, 1, _EM_LR, _EM_EPOCHS)
    rows = " UNION ALL ".join(
        f"SELECT {e} AS epoch, round(nll, 6) AS train_loss, round(ppl, 6) AS val_perplexity, "
        + ", ".join(f"round(l{k}, 6) AS weight{k}" for k in range(CFG.order + 1)) + f" FROM lam{e}, pp{e}"
        for e in range(1, _EM_EPOCHS + 1))
    return "WITH " + ",\n".join(parts) + "\n" + rows


@query("em_epochs", _em_epochs_sql())
def em_epochs_q(spark, sf):
    """Loss, validation perplexity and weights of every EM epoch (no decoding)."""
    enc, _ = XP.prepare(spark, sf)
    model = NG.fit(enc.filter((F.col("split") == "train") & ~F.col("holdout")), CFG.order, CFG.vocab_size).materialize()
    train = write_once(NG.window_levels(model, enc.filter((F.col("split") == "train") & F.col("holdout"))))
    val = write_once(NG.window_levels(model, enc.filter(F.col("split") == "validation")))
    rows = []
    for epoch in range(1, _EM_EPOCHS + 1):
        lam, loss = NG.em_update(model, train, lr=_EM_LR)
        model = model.with_lambdas(lam)
        p = NG.mixture(lam, model.vocab_size, model.order)
        ppl = NG.perplexity(val.withColumn("nll", -F.log(p))).first()["perplexity"]
        rows.append((epoch, round(loss, 6), round(ppl, 6), *[round(x, 6) for x in lam]))
    return spark.createDataFrame(rows, "epoch int, train_loss double, val_perplexity double, "
                                 + ", ".join(f"weight{k} double" for k in range(CFG.order + 1)))


def _rouge_sql(rows: str, weights: list[str], order: int) -> str:
    """Scalar: mean unstemmed ROUGE-L of greedy completions of ``rows`` (row_id, ids) by ``ngm``."""
    prompts = f"""SELECT row_id AS seq_id, list_slice(s, 1, CAST(floor(len(s) * 0.5) AS INTEGER)) AS prompt_ids,
  list_slice(s, CAST(floor(len(s) * 0.5) AS INTEGER) + 1, len(s)) AS ref_ids
  FROM (SELECT row_id, {S.cut_eos('ids')} AS s FROM ({rows})) WHERE len(s) > 0"""
    g = S.greedy_rounds(prompts, "ngm", order, weights, CFG.vocab_size, 20)
    return f"""(SELECT coalesce(avg({S.f1('l', 'len(rt)', 'len(ht)')}), 0.0) FROM (
  SELECT rt, ht, {S.lcs('rt', 'ht')} AS l FROM (
    SELECT {S.rouge_tok('rd.reference')} AS rt, {S.rouge_tok('gd.prediction')} AS ht FROM
      (SELECT * FROM {S.decode(f"SELECT seq_id AS row_id, g FROM ({g} SELECT seq_id, {S.cut_eos(S.continuation())} AS g FROM g20)",
                               "x.g", "voc", "prediction")}) gd
      JOIN {S.decode(f"SELECT seq_id AS row_id, ref_ids FROM ({prompts})", "x.ref_ids", "voc", "reference")} rd
      ON rd.row_id = gd.row_id)))"""


def _history_chain(fit_rows: str, em_rows: str, val_rows: str, cell: dict, epochs: int, patience: int) -> list[str]:
    """CTEs of a training run: ``hist`` holds the epochs that ran, ``best`` the best one's weights."""
    order = cell["order"]
    parts = _em_chain(fit_rows, em_rows, val_rows, order, cell["min_count"], cell["lr"], epochs)
    parts.insert(0, f"voc AS MATERIALIZED (SELECT * FROM {S.vocab(CFG)})")
    names = ", ".join(f"l{k}" for k in range(order + 1))
    for e in range(1, epochs + 1):
        weights = [f"(SELECT l{k} FROM lam{e})" for k in range(order + 1)]
        parts.append(f"rg{e} AS MATERIALIZED (SELECT round({_rouge_sql(val_rows, weights, order)}, 12) AS rouge)")
    every = " UNION ALL ".join(f"SELECT {e} AS epoch, nll, ppl, rouge, {names} FROM lam{e}, pp{e}, rg{e}" for e in range(1, epochs + 1))
    parts.append(f"""h0 AS (SELECT *, max(rouge) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM ({every})),
h1 AS (SELECT *, max(CASE WHEN before IS NULL OR rouge > before THEN epoch END) OVER (ORDER BY epoch) AS since FROM h0),
h2 AS (SELECT *, min(CASE WHEN epoch - since >= {patience} THEN epoch END) OVER () AS ended FROM h1),
hist AS MATERIALIZED (SELECT * FROM h2 WHERE ended IS NULL OR epoch <= ended),
best AS MATERIALIZED (SELECT * FROM hist WHERE epoch = (SELECT max(since) FROM hist))""")
    return parts


_TRAIN_ROWS = ("SELECT row_id, ids FROM held WHERE split = 'train' AND NOT holdout",
               "SELECT row_id, ids FROM held WHERE split = 'train' AND holdout",
               "SELECT row_id, ids FROM held WHERE split = 'validation'")
_HISTORY_OUT = """SELECT CAST(epoch AS INTEGER) AS epoch, round(nll, 6) AS train_loss, round(ppl, 6) AS val_perplexity,
  round(rouge, 9) AS val_rougeL, (SELECT CAST(epoch AS INTEGER) FROM best) AS best_epoch FROM hist"""


def _history_out(spark, res):
    return XP.history_frame(spark, res.history).select(
        "epoch", F.round("train_loss", 6).alias("train_loss"), F.round("val_perplexity", 6).alias("val_perplexity"),
        F.round("val_rougeL", 9).alias("val_rougeL"), F.lit(res.best_epoch).alias("best_epoch"))


_TRAIN_CELL = {"order": CFG.order, "min_count": 1, "lr": 0.5}


@query("train_history", "WITH " + ",\n".join(_history_chain(*_TRAIN_ROWS, _TRAIN_CELL, 4, _PATIENCE)) + "\n" + _HISTORY_OUT)
def train_history_q(spark, sf):
    enc, voc = XP.prepare(spark, sf)
    base = NG.fit(enc.filter((F.col("split") == "train") & ~F.col("holdout")), CFG.order, CFG.vocab_size)
    res = XP.train(base, enc.filter((F.col("split") == "train") & F.col("holdout")),
                   enc.filter(F.col("split") == "validation"), voc, epochs=4, lr=0.5, patience=_PATIENCE, stem=False)
    return _history_out(spark, res)


# a history per conversation, made of its turns: a table of many runs, some of which stop
_HISTORY_SQL = "SELECT conv_id AS run_id, turn + 1 AS epoch, length(coalesce(text, '')) % 100 / 100.0::DOUBLE AS val FROM conversations"


@query("early_stop", f"""
WITH h AS (SELECT *, max(val) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM ({_HISTORY_SQL})),
s AS (SELECT *, max(CASE WHEN before IS NULL OR val > before THEN epoch END) OVER (PARTITION BY run_id ORDER BY epoch) AS since FROM h),
e AS (SELECT *, min(CASE WHEN epoch - since >= {_PATIENCE} THEN epoch END) OVER (PARTITION BY run_id) AS ended FROM s)
SELECT run_id, max(since) AS best_epoch, max(epoch) AS last_epoch FROM e
WHERE ended IS NULL OR epoch <= ended GROUP BY run_id""")
def early_stop_q(spark, sf):
    h = src.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("epoch"),
        (F.char_length(F.coalesce("text", F.lit(""))) % 100 / F.lit(100.0)).alias("val_rougeL"))
    return XP.early_stop(h, _PATIENCE)


_CELLS = XP.param_grid(lr=[1.0], order=[2, 3], min_count=[1, 2], epochs=[4])


def _cells_sql(body) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS run_id, {c['order']} AS \"order\", {c['min_count']} AS min_count, {body(c)}"
                              for k, c in enumerate(_CELLS, start=1))


def _cell_ppl(c) -> str:
    lv = S.level_probs(_rows_sql("test"), S.ngrams(_rows_sql("train"), c["order"], min_count=c["min_count"]), c["order"])
    p = S.mixture(NG.uniform_lambdas(c["order"]), CFG.vocab_size, c["order"])
    return f"(SELECT round(exp(sum(-ln(p)) / count(*)), 6) FROM (SELECT {p} AS p FROM {lv})) AS test_perplexity"


@query("param_grid", _cells_sql(lambda c: f"(SELECT CAST(count(*) AS BIGINT) FROM {S.ngrams(_rows_sql('train'), c['order'], min_count=c['min_count'])}) AS n_ngrams"))
def param_grid_q(spark, sf):
    """The cells of a grid and how many n-grams each keeps: all of them from one count."""
    counts = write_once(NG.ngram_counts(_enc(spark, sf).filter(F.col("split") == "train"), 3))
    grid = XP.grid_frame(spark, _CELLS)  # as many rows as the caller has listed
    kept = counts.groupBy("k", "c").count().join(F.broadcast(grid), (F.col("k") <= F.col("order"))
                                                & ((F.col("k") == 1) | (F.col("c") >= F.col("min_count"))))
    return kept.groupBy("run_id", "order", "min_count").agg(F.sum("count").cast("bigint").alias("n_ngrams"))


def _cell_scores(spark, sf):
    enc, rows = _enc(spark, sf), None
    test = enc.filter(F.col("split") == "test")
    counts = write_once(NG.ngram_counts(enc.filter(F.col("split") == "train"), max(c["order"] for c in _CELLS)))
    for k, c in enumerate(_CELLS, start=1):
        model = NG.restricted(counts, c["order"], CFG.vocab_size, c["min_count"])
        one = NG.perplexity(NG.window_scores(model.materialize(), test)).select(
            F.lit(k).alias("run_id"), F.lit(c["order"]).alias("order"), F.lit(c["min_count"]).alias("min_count"),
            F.round("perplexity", 6).alias("test_perplexity"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("grid_perplexity", _cells_sql(_cell_ppl))
def grid_perplexity_q(spark, sf):
    """Test perplexity of every cell of the grid, at equal weights."""
    return _cell_scores(spark, sf)


@query("best_cell", f"SELECT * FROM ({_cells_sql(_cell_ppl)}) ORDER BY test_perplexity, run_id LIMIT 1")
def best_cell_q(spark, sf):
    return _cell_scores(spark, sf).orderBy("test_perplexity", "run_id").limit(1)


def _grid_cell_sql(run_id: int, c: dict) -> str:
    """One result row: the training run of a cell and its best weights on the test rows."""
    order, test = c["order"], "SELECT row_id, ids FROM held WHERE split = 'test'"
    parts = _history_chain(*_TRAIN_ROWS, c, c["epochs"], c["patience"])
    weights = [f"(SELECT l{k} FROM best)" for k in range(order + 1)]
    ppl = (f"(SELECT exp(sum(-ln(p)) / count(*)) FROM (SELECT {_mix_sql('best', order)} AS p "
           f"FROM {S.level_probs(test, 'ngm', order)}, best))")
    return "SELECT * FROM (WITH " + ",\n".join(parts) + f"""
SELECT {run_id} AS run_id, {c['lr']!r} AS lr, {order} AS "order", {c['min_count']} AS min_count, {c['epochs']} AS epochs,
  round(nll, 6) AS final_train_loss, round(ppl, 6) AS final_val_perplexity, round(rouge, 9) AS final_val_rougeL,
  round({ppl}, 6) AS test_perplexity, round({_rouge_sql(test, weights, order)}, 9) AS test_rougeL,
  (SELECT CAST(epoch AS INTEGER) FROM best) AS best_epoch FROM hist ORDER BY epoch DESC LIMIT 1)"""


_GRID_SQL = " UNION ALL ".join(_grid_cell_sql(k, c) for k, c in enumerate(_GRID, start=1))


def _grid_out(results):
    return results.select(
        "run_id", "lr", "order", "min_count", "epochs",
        *[F.round(c, 6).alias(c) for c in ("final_train_loss", "final_val_perplexity")],
        F.round("final_val_rougeL", 9).alias("final_val_rougeL"), F.round("test_perplexity", 6).alias("test_perplexity"),
        F.round("test_rougeL", 9).alias("test_rougeL"), "best_epoch")


def _grid(spark, sf, prepared=None):
    return XP.grid_search(spark, sf, _GRID, stem=False, results_dir=_results_dir(spark, sf), prepared=prepared)


@query("grid_search", _GRID_SQL)
def grid_search_q(spark, sf):
    return _grid_out(_grid(spark, sf))


@query("best_config", f"SELECT * FROM ({_GRID_SQL}) ORDER BY test_rougeL DESC, run_id LIMIT 1")
def best_config_q(spark, sf):
    return _grid_out(XP.best_config(_grid(spark, sf)))


_FINAL_CELL = {"order": 3, "min_count": 1, "lr": 0.5}
_FINAL_ROWS = ("SELECT row_id, ids FROM held WHERE NOT holdout", *["SELECT row_id, ids FROM held WHERE holdout"] * 2)


@query("final_fit", "WITH " + ",\n".join(_history_chain(*_FINAL_ROWS, _FINAL_CELL, 6, 3)) + "\n" + _HISTORY_OUT)
def final_fit_q(spark, sf):
    """Twice three epochs with patience 3 on all splits but the hold-out."""
    res = XP.final_fit(spark, sf, {**_FINAL_CELL, "epochs": 3}, stem=False, results_dir=shared_path(spark, "final"))
    return _history_out(spark, res)


def _final_reload_sql() -> str:
    order = _FINAL_CELL["order"]
    ppl = (f"(SELECT exp(sum(-ln(p)) / count(*)) FROM (SELECT {_mix_sql('best', order)} AS p FROM "
           f"{S.level_probs("SELECT row_id, ids FROM held WHERE split = 'test'", 'ngm', order)}, best))")
    return "WITH " + ",\n".join(_history_chain(*_FINAL_ROWS, _FINAL_CELL, 4, 3)) + f"""
SELECT CAST(epoch AS INTEGER) AS epoch, round(nll, 6) AS train_loss, round(ppl, 6) AS val_perplexity,
  round(rouge, 9) AS val_rougeL, round({ppl}, 6) AS test_perplexity FROM hist"""


@query("final_reload", _final_reload_sql())
def final_reload_q(spark, sf):
    """The final fit's history as stored, and the test perplexity of the model reloaded by its tag."""
    path = shared_path(spark, "final")
    XP.final_fit(spark, sf, {**_FINAL_CELL, "epochs": 2}, stem=False, results_dir=path)
    model = ST.load_model(spark, f"{path}/models", tag="final")
    ppl = NG.perplexity(NG.window_scores(model, _enc(spark, sf).filter(F.col("split") == "test"))).first()["perplexity"]
    return spark.read.schema(XP.HISTORY_SCHEMA).parquet(f"{path}/final_history").select(
        "epoch", F.round("train_loss", 6).alias("train_loss"), F.round("val_perplexity", 6).alias("val_perplexity"),
        F.round("val_rougeL", 9).alias("val_rougeL"), F.lit(round(ppl, 6)).alias("test_perplexity"))


@query("compare_models")
def compare_models_q(spark, sf):
    return XP.compare_models(spark, sf)[0]


def _compare_sql() -> str:
    """Both models' greedy completions, scored: cell(model, row_id, prompt, prediction, rouge_l)."""
    prompts = f"SELECT row_id AS seq_id, ids AS prompt_ids FROM {S.encode(_CHAR_PROMPTS, CFG, max_length=None, append_eos=False)}"
    cont, parts = S.cut_eos(S.continuation()), []
    for name, rows in (("in_domain", _rows_sql("train")), ("out_of_domain", f"SELECT row_id, ids FROM {S.encode(S.docs_clean(), CFG)}")):
        g = S.greedy_rounds(prompts, S.ngrams(rows, CFG.order), CFG.order, LAMBDAS, CFG.vocab_size, 20)
        parts.append(f"""SELECT '{name}' AS model, d.row_id, d.prediction FROM (
SELECT row_id, prediction FROM (
{g}
SELECT * FROM {S.decode(f"SELECT seq_id AS row_id, {cont} AS g FROM g20", "x.g", S.vocab(CFG), "prediction")})) d""")
    return f"""WITH made AS MATERIALIZED ({" UNION ALL ".join(parts)}),
tt AS (SELECT m.model, m.row_id, c.text AS prompt, m.prediction, {S.rouge_tok('c.reference')} AS rt,
       {S.rouge_tok('m.prediction')} AS ht FROM made m JOIN ({_CHAR_PROMPTS}) c ON c.row_id = m.row_id),
cell AS (SELECT model, row_id, prompt, prediction, {S.f1('l', 'len(rt)', 'len(ht)')} AS rouge_l
         FROM (SELECT *, {S.lcs('rt', 'ht')} AS l FROM tt))"""


def _greedy_cells(spark, sf):
    return XP.compare_models(spark, sf, stem=False, decoders=("greedy",))


@query("compare_greedy", _compare_sql() + """
SELECT 'greedy' AS decoder, round(avg(CASE WHEN model = 'in_domain' THEN rouge_l END), 9) AS in_domain,
       round(avg(CASE WHEN model = 'out_of_domain' THEN rouge_l END), 9) AS out_of_domain FROM cell""")
def compare_greedy_q(spark, sf):
    """The greedy half of the comparison, models side by side."""
    return XP.pivot_scores(_greedy_cells(spark, sf)[0]).select(
        "decoder", F.round("in_domain", 9).alias("in_domain"), F.round("out_of_domain", 9).alias("out_of_domain"))


@query("greedy_examples", _compare_sql() + """
SELECT model, row_id, prompt, prediction, round(rouge_l, 9) AS rouge_l FROM
  (SELECT *, row_number() OVER (PARTITION BY model ORDER BY row_id) AS rn FROM cell) WHERE rn <= 5""")
def greedy_examples_q(spark, sf):
    return XP.top_examples(_greedy_cells(spark, sf)[1], 5).select(
        "model", "row_id", "prompt", "prediction", F.round("rouge_l", 9).alias("rouge_l"))


@query("top_examples")
def top_examples_q(spark, sf):
    return XP.top_examples(XP.compare_models(spark, sf)[1], 5)


@query("training_run")
def training_run_q(spark, sf):
    """Whole run: grid search -> first best cell -> final fit on all splits minus hold-out."""
    prepared = XP.prepare(spark, sf)  # the vocabulary is learned and the corpus encoded once for both steps
    best = XP.best_config(_grid(spark, sf, prepared)).first().asDict()
    res = XP.final_fit(spark, sf, {k: best[k] for k in ("order", "min_count", "epochs", "lr")},
                       results_dir=shared_path(spark, "run"), prepared=prepared)
    return XP.history_frame(spark, res.history).withColumn("best_epoch", F.lit(res.best_epoch))


_ITEM_ROWS = f"SELECT item_id AS row_id, {S.clean('text')} AS text FROM benchmark"


@query("complete_prompts", S.greedy_rounds(
    f"SELECT row_id AS seq_id, ids AS prompt_ids FROM {S.encode(_ITEM_ROWS, CFG, max_length=tk.MAX_GEN_LEN, append_eos=False)}",
    _TRAIN_NG, CFG.order, LAMBDAS, CFG.vocab_size, 20) + f""",
gd AS {S.decode(f"SELECT seq_id AS row_id, {S.cut_eos(S.continuation())} AS g FROM g20", "x.g", S.vocab(CFG), "new")}
SELECT i.row_id, trim(gd.new) AS prediction, i.text || gd.new AS completed
FROM ({_ITEM_ROWS}) i JOIN gd ON gd.row_id = i.row_id""")
def complete_prompts_q(spark, sf):
    """Complete a given table of prompts, text in and text out."""
    enc, voc = _enc_voc(spark, sf)
    done = EV.complete(_model(spark, sf, enc=enc), src.benchmark(spark, sf), voc)
    return done.select("row_id", "prediction", "completed")


# prompts of 0 to 39 characters: some are empty, some end inside a word
_SHORT_ROWS = f"SELECT row_id, substr(text, 1, CAST(row_id % 40 AS INTEGER)) AS text FROM ({_ITEM_ROWS})"


@query("one_word", S.greedy_rounds(
    f"SELECT row_id AS seq_id, ids AS prompt_ids FROM {S.encode(f'SELECT row_id, {S.clean('text')} AS text FROM ({_SHORT_ROWS})', CFG, max_length=tk.MAX_GEN_LEN, append_eos=False)}",
    _TRAIN_NG, CFG.order, LAMBDAS, CFG.vocab_size, 1) + f""",
gd AS {S.decode(f"SELECT seq_id AS row_id, {S.cut_eos(S.continuation())} AS g FROM g1", "x.g", S.vocab(CFG), "new")}
SELECT i.row_id, i.text AS prompt, trim(gd.new) AS word FROM ({_SHORT_ROWS}) i JOIN gd ON gd.row_id = i.row_id""")
def one_word_q(spark, sf):
    """One word after a text prompt, by a model saved and loaded again; an empty prompt has none."""
    enc, voc = _enc_voc(spark, sf)
    path = shared_path(spark, "model")
    ST.save_model(_model(spark, sf, enc=enc), path, tag="best")
    prompts = src.benchmark(spark, sf).select("row_id", tx.clean_text("text").alias("text"))
    prompts = prompts.select("row_id", F.expr("substr(text, 1, cast(row_id % 40 as int))").alias("text"))
    done = EV.complete(ST.load_model(spark, path, tag="best"), prompts, voc, n_words=1)
    return done.select("row_id", F.col("text").alias("prompt"), F.col("prediction").alias("word"))


@query("complete_sampled", S.sampled_rounds(
    f"SELECT row_id AS seq_id, ids AS prompt_ids FROM {S.encode(_ITEM_ROWS, CFG, max_length=tk.MAX_GEN_LEN, append_eos=False)}",
    _TRAIN_NG, CFG.order, LAMBDAS, CFG.vocab_size, 20, 0.7, 0.8, CFG.seed) + f""",
gd AS {S.decode(f"SELECT seq_id AS row_id, {S.cut_eos(S.continuation())} AS g FROM g20", "x.g", S.vocab(CFG), "new")}
SELECT i.row_id, trim(gd.new) AS prediction, i.text || gd.new AS completed
FROM ({_ITEM_ROWS}) i JOIN gd ON gd.row_id = i.row_id""")
def complete_sampled_q(spark, sf):
    """The same with temperature 0.7 and top-p 0.8."""
    enc, voc = _enc_voc(spark, sf)
    done = EV.complete(_model(spark, sf, enc=enc), src.benchmark(spark, sf), voc, sampling=True)
    return done.select("row_id", "prediction", "completed")


# ---------------------------------------------------------------- flagship

def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """clean -> vocab -> encode -> split -> trigram counts -> greedy completion -> ROUGE-L."""
    enc, voc = _enc_voc(spark, sf)
    summary, _ = EV.evaluate_tokens(_model(spark, sf, enc=enc), enc.filter(F.col("split") == "test"), voc)
    return summary


# ---------------------------------------------------------------- 2.3 K3 subword merges, S1 CSV
from lexicorn.operators import bpe as BPE  # noqa: E402


N_MERGES = 120
_TRAIN_TEXT = f"SELECT text FROM ({S.split_conv(CFG)}) WHERE split = 'train'"


def _train_text(spark, sf):
    return PL.split_corpus(spark, sf).filter(F.col("split") == "train").select("text")


@query("bpe_merges", S.bpe_rounds(_TRAIN_TEXT, N_MERGES) + "\n" + S.bpe_merges(N_MERGES))
def bpe_merges_q(spark, sf):
    return BPE.learn_merges(_train_text(spark, sf), N_MERGES)[0]


@query("bpe_encode", S.bpe_rounds(_TRAIN_TEXT, N_MERGES) + ",\n" + S.bpe_applied(S.split_conv(CFG), N_MERGES) + f"""
SELECT row_id, CAST(len(subwords) AS BIGINT) AS n_subwords, array_to_string(subwords, '|') AS subwords,
       array_to_string(subwords, '') AS decoded FROM applied""")
def bpe_encode_q(spark, sf):
    """Subwords of every row, unseen words included, and the text they spell."""
    merges, _ = BPE.learn_merges(_train_text(spark, sf), N_MERGES)
    enc = BPE.encode_words(PL.split_corpus(spark, sf).select("row_id", "text"), merges)
    return enc.select("row_id", F.size("subwords").cast("bigint").alias("n_subwords"),
                      F.array_join("subwords", "|").alias("subwords"),
                      BPE.decode_words(F.col("subwords")).alias("decoded"))


@query("bpe_vocab", S.bpe_rounds(_TRAIN_TEXT, N_MERGES) + f""",
every AS (SELECT symbol, min(rank) AS rank FROM (
  SELECT DISTINCT unnest({S.characters('word')}) AS symbol, 0 AS rank FROM bw0
  UNION ALL SELECT a || b, rank FROM ({S.bpe_merges(N_MERGES)})) GROUP BY symbol)
SELECT symbol, CAST(row_number() OVER (ORDER BY rank, symbol) + 2 AS INTEGER) AS id FROM every""")
def bpe_vocab_q(spark, sf):
    merges, words = BPE.learn_merges(_train_text(spark, sf), N_MERGES)
    return BPE.subword_vocab(words, merges)


@query("token_accounting", f"""
WITH e AS (SELECT row_id, len(ids) - 1 AS used, len(list_filter(ids, lambda x: x = 2)) AS n_unk,
                  (SELECT 0) AS z FROM {S.encoded_conv(CFG)}),
t AS (SELECT row_id, split, length(text) AS chars FROM ({S.split_conv(CFG)}))
SELECT t.split, CAST(sum(t.chars) AS BIGINT) AS chars_in, CAST(sum(e.used) AS BIGINT) AS ids_used,
       CAST(sum(e.n_unk) AS BIGINT) AS unknown, CAST(sum(length(d.decoded)) AS BIGINT) AS chars_out
FROM t JOIN e ON e.row_id = t.row_id
JOIN {S.decode(f"SELECT row_id, ids FROM {S.encoded_conv(CFG)}", "x.ids", S.vocab(CFG), "decoded")} d ON d.row_id = t.row_id
GROUP BY t.split""")
def token_accounting_q(spark, sf):
    """Characters that go in, ids they become, unknown ids, and characters that come back."""
    voc = PL.corpus_vocab(spark, sf)
    e = VO.encode(PL.split_corpus(spark, sf), voc, keep_text=True, append_eos=True)
    d = VO.decode(e, voc)
    return d.groupBy("split").agg(
        F.sum(F.char_length("text")).cast("bigint").alias("chars_in"),
        F.sum(F.size("ids") - 1).cast("bigint").alias("ids_used"),
        F.sum(F.size(F.filter("ids", lambda x: x == tk.UNK_ID))).cast("bigint").alias("unknown"),
        F.sum(F.char_length("decoded")).cast("bigint").alias("chars_out"))


# every third line has a seventh field, every fifth ends before the text
_BAD_CLEAN = f"SELECT row_id, {S.clean('text')} AS clean FROM ({S.CONV})"


@query("csv_bad_lines", f"SELECT row_id, CASE WHEN row_id % 5 = 0 THEN '' ELSE clean END AS clean FROM ({_BAD_CLEAN})")
def csv_bad_lines_q(spark, sf):
    """Lines with too many or too few fields are kept: the text is the sixth field, or empty."""
    path = shared_path(spark, "csv-bad")
    rows = clean_conversations(spark, sf).select(
        F.lit("0").alias("target"), F.col("row_id").cast("string").alias("ids"), F.lit("Mon Apr 06 2009").alias("date"),
        F.lit("NO_QUERY").alias("flag"), F.lit("user").alias("user"), "text", F.lit("more").alias("more"), "row_id")
    short = F.col("row_id") % 5 == 0
    long = ~short & (F.col("row_id") % 3 == 0)
    for name, which, n in (("short", short, 5), ("long", long, 7), ("whole", ~short & ~long, 6)):
        (rows.filter(which).select(*rows.columns[:n]).write.option("encoding", "ISO-8859-1").option("escape", '"')
         .option("quoteAll", "true").csv(f"{path}/{name}"))
    return src.csv_corpus(spark, f"{path}/*").select("row_id", tx.clean_text("text").alias("clean"))


@query("csv_scan", f"SELECT row_id, {S.clean('text')} AS clean FROM ({S.CONV})")
def csv_scan_q(spark, sf):
    """Write the corpus as a headerless latin-1 CSV of six fields, then scan it back."""
    path = shared_path(spark, "csv")
    conv = src.table(spark, sf, "conversations")
    raw = conv.select(F.lit("0").alias("target"), src.turn_key().cast("string").alias("ids"),
                      F.lit("Mon Apr 06 2009").alias("date"), F.lit("NO_QUERY").alias("flag"),
                      F.col("role").alias("user"), F.col("text"))
    (raw.write.mode("overwrite").option("header", "false").option("encoding", "ISO-8859-1")
        .option("quote", '"').option("escape", '"').option("quoteAll", "true").csv(path))
    # the texts hold line breaks, which only the multi-line reader keeps
    back = src.csv_corpus(spark, path, multiline=True)
    return back.select("row_id", tx.clean_text("text").alias("clean"))

"""Evaluation plans: perplexity + ROUGE-L over a whole split, by tokens (E8) or characters (E9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexicorn.functions import tokens as tk
from lexicorn.functions.text import char_prompt, char_reference, clean_text
from lexicorn.functions.tokens import rouge_tokens
from lexicorn.operators import ngram as NG
from lexicorn.operators import vocab as VO
from lexicorn.operators.generate import context_key, continuation, generate
from lexicorn.operators.rouge import f1_from_lcs, lcs_length, rouge_l
from lexicorn.operators.stem import stem_tokens
from lexicorn.session import write_once


def _token_split(rows: DataFrame, fraction: float) -> DataFrame:
    """(row_id, prompt_ids, ref_ids) of the sequences that are not empty."""
    seq = rows.select("row_id", tk.cut_at_pad_then_eos("ids").alias("s")).filter(F.size("s") > 0)
    return seq.select("row_id", tk.token_prompt("s", fraction).alias("prompt_ids"),
                      tk.token_reference("s", fraction).alias("ref_ids"))


def rouge_rows(model: NG.NGramModel, rows: DataFrame, vocab: DataFrame, fraction: float = 0.5,
               stem: bool = True) -> DataFrame:
    """(prompt_ids, ref) written once for all weight vectors and epochs: the end of each prompt, which is
    all that the model looks at, and the ROUGE tokens of its reference."""
    seq = _token_split(rows, fraction).select(context_key("prompt_ids", max(model.order, 2)).alias("prompt_ids"), "ref_ids")
    dec = (VO.decode(seq, vocab, ids_col="ref_ids", out_col="reference")
           .select("prompt_ids", rouge_tokens("reference").alias("ref")))
    return write_once(stem_tokens(dec, "ref") if stem else dec)


def rouge_cells(model: NG.NGramModel, prepared: DataFrame, vocab: DataFrame, weights: list[list[float]],
                stem: bool = True, max_new: int = tk.MAX_GEN_LEN) -> list[float]:
    """Mean ROUGE-L of the greedy completions of `rouge_rows` by each of several weight vectors: the rows
    of all vectors are completed in the same rounds and scored in one job (0 without rows)."""
    seq = prepared.withColumn("cell", F.explode(F.array(*[F.lit(i) for i in range(len(weights))])))
    # the id holds all that the score needs, so nothing is joined back
    gen = generate(model, seq.select(F.struct("cell", "ref").alias("seq_id"), "prompt_ids", "cell"),
                   max_new=max_new, draw_col="cell", weights=weights)
    out = gen.select(F.col("seq_id.cell").alias("cell"), F.col("seq_id.ref").alias("ref"),
                     tk.cut_at(continuation(), tk.EOS_ID).alias("g"))
    dec = VO.decode(out, vocab, ids_col="g", out_col="prediction").withColumn("hyp", rouge_tokens("prediction"))
    dec = stem_tokens(dec, "hyp") if stem else dec
    scored = dec.select("cell", f1_from_lcs(lcs_length("ref", "hyp"), F.size("ref"), F.size("hyp")).alias("rouge_l"))
    mean = {r["cell"]: r["m"] for r in scored.groupBy("cell").agg(F.avg("rouge_l").alias("m")).collect()}
    return [float(mean.get(i, 0.0)) for i in range(len(weights))]


def completions_by_tokens(model: NG.NGramModel, rows: DataFrame, vocab: DataFrame,
                          fraction: float = 0.5, sampling: bool = False,
                          temperature: float = 0.7, top_p: float = 0.9, seed: int = 42,
                          with_prompt: bool = False, max_new: int = tk.MAX_GEN_LEN) -> DataFrame:
    """(row_id, reference, prediction) with the token-fraction split of each sequence."""
    seq = _token_split(rows, fraction)
    gen = generate(model, seq.select(F.col("row_id").alias("seq_id"), "prompt_ids"),
                   max_new=max_new, sampling=sampling, temperature=temperature, top_p=top_p, seed=seed)
    out = gen.select(F.col("seq_id").alias("row_id"),
                     (F.col("gen_ids") if with_prompt else continuation()).alias("g"))
    out = out.select("row_id", tk.cut_at("g", tk.EOS_ID).alias("g"))
    out = out.join(seq.select("row_id", "ref_ids"), on="row_id")
    dec = VO.decode(out, vocab, ids_col="g", out_col="prediction")
    dec = VO.decode(dec, vocab, ids_col="ref_ids", out_col="reference")
    return dec.select("row_id", "reference", "prediction")


def evaluate_tokens(model: NG.NGramModel, rows: DataFrame, vocab: DataFrame,
                    fraction: float = 0.5, stem: bool = True, **gen_kw) -> tuple[DataFrame, DataFrame]:
    """(summary(perplexity, rouge_l, n_examples), per-example table)."""
    comp = completions_by_tokens(model, rows, vocab, fraction, **gen_kw)
    per = rouge_l(comp, "reference", "prediction", stem=stem)
    ppl = NG.perplexity(NG.window_scores(model, rows))
    summary = (per.agg(F.coalesce(F.avg("rouge_l"), F.lit(0.0)).alias("rouge_l"),
                       F.count(F.lit(1)).alias("n_examples"))
               .join(ppl.select("perplexity"), how="inner", on=F.lit(True)))
    return summary, per


def completions_by_chars(model: NG.NGramModel, texts: DataFrame, vocab: DataFrame,
                         fraction: float = 0.5, sampling: bool = False, temperature: float = 1.0,
                         top_p: float = 0.9, seed: int = 42, max_new: int = tk.MAX_GEN_LEN,
                         text_col: str = "text") -> DataFrame:
    """(row_id, prompt, reference, prediction): character split, continuation only."""
    p = texts.select("row_id", char_prompt(text_col, fraction).alias("prompt"),
                     char_reference(text_col, fraction).alias("reference"))
    enc = VO.encode(p.select("row_id", F.col("prompt").alias("text")), vocab,
                    out_col="prompt_ids")
    gen = generate(model, enc.select(F.col("row_id").alias("seq_id"), "prompt_ids"),
                   max_new=max_new, sampling=sampling, temperature=temperature, top_p=top_p, seed=seed)
    g = gen.select(F.col("seq_id").alias("row_id"), tk.cut_at(continuation(), tk.EOS_ID).alias("g"))
    dec = VO.decode(g, vocab, ids_col="g", out_col="prediction")
    return dec.join(p, on="row_id").select("row_id", "prompt", "reference", "prediction")


def evaluate_chars(model: NG.NGramModel, texts: DataFrame, vocab: DataFrame, fraction: float = 0.5,
                   stem: bool = True, **gen_kw) -> tuple[DataFrame, DataFrame]:
    comp = completions_by_chars(model, texts, vocab, fraction, **gen_kw)
    per = rouge_l(comp, "reference", "prediction", stem=stem)
    return mean_score(per), per


def mean_score(per: DataFrame) -> DataFrame:
    return per.agg(F.coalesce(F.avg("rouge_l"), F.lit(0.0)).alias("rouge_l"))


def complete(model: NG.NGramModel, prompts: DataFrame, vocab: DataFrame, n_words: int | None = None,
             sampling: bool = False, temperature: float = 0.7, top_p: float = 0.8, seed: int = 42,
             key: str = "row_id", text_col: str = "text", prompt_tokens: int = tk.MAX_GEN_LEN) -> DataFrame:
    """Complete any table of text prompts: ``prompts`` with ``prediction`` (the new text, up to
    the end token) and ``completed`` (prompt and new text).

    The model sees the first ``prompt_tokens`` tokens of the cleaned prompt (a feature of the
    reference); at most 20 new tokens, or ``n_words``. Rows keep their own identity, so equal
    keys stay apart; a null or empty prompt has an empty prediction."""
    rows = write_once(prompts.withColumn("_prompt", F.monotonically_increasing_id())
                      .withColumn("_clean", clean_text(text_col)))
    enc = VO.encode(rows.select("_prompt", key, F.col("_clean").alias("text")), vocab, out_col="prompt_ids",
                    max_length=prompt_tokens)
    gen = generate(model, enc.select(F.col("_prompt").alias("seq_id"), key, "prompt_ids"), draw_col=key,
                   max_new=n_words or tk.MAX_GEN_LEN, sampling=sampling, temperature=temperature, top_p=top_p, seed=seed)
    new = VO.decode(gen.select(F.col("seq_id").alias("_prompt"), tk.cut_at(continuation(), tk.EOS_ID).alias("g")),
                    vocab, ids_col="g", out_col="prediction").drop("g")
    return (rows.join(new, "_prompt").withColumn("completed", F.concat("_clean", "prediction"))
            .withColumn("prediction", F.trim("prediction")).drop("_prompt", "_clean"))

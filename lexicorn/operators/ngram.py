"""Interpolated n-gram next-token model fitted with Spark aggregations.

``p_0 = 1/V``; ``p_k(w|h) = c(h_k, w) / c(h_k)`` with ``h_k`` the last k-1 tokens,
and ``p_k := p_(k-1)`` when ``h_k`` was never seen; ``p = sum_k lambda_k p_k``.
Position 0 of a sequence is never predicted. Contexts are ``ARRAY<INT>`` join keys.

Sums over positions (perplexity, EM) need no positions: equal windows of ``order`` tokens
have equal scores, so windows are counted first, map-side, and each distinct one is scored
once with its count; scores of positions are joined to their windows. Model tables are written once, so the planner knows their true sizes
and broadcasts what is small (the unigrams are bounded by the vocabulary) by itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexicorn.session import write_once

END = -1  # takes the place of a next token in the key of a context's total

BEFORE = -2  # takes the place of a token before the text; no id equals it


def window_counts(df: DataFrame, order: int, ids_col: str = "ids") -> DataFrame:
    """(t1..tN, n): the distinct windows of the last ``order`` tokens at the predicted positions
    j >= 2 (1-based) and their numbers, as columns of one token each; ``BEFORE`` fills up the
    windows at the start of a text."""
    N, s = int(order), F.col(ids_col)
    predicted = F.greatest(F.size(s) - 1, F.lit(0))
    padded = F.concat(F.array_repeat(F.lit(BEFORE), N - 2), s) if N > 2 else s
    tokens = [f"t{k}" for k in range(1, N + 1)]
    aligned = [F.slice(padded, F.lit(k if N > 1 else 2), predicted).alias(t) for k, t in enumerate(tokens, start=1)]
    return (df.select(F.explode(F.arrays_zip(*aligned)).alias("e")).select("e.*")
            .groupBy(*tokens).agg(F.count(F.lit(1)).alias("n")))


def ngram_counts(df: DataFrame, order: int, ids_col: str = "ids", min_count: int = 1) -> DataFrame:
    """(k, ctx, w, c): all orders in one pass; rare k>1 n-grams pruned. Positions are counted as
    windows of the highest order, map-side combined; the n-grams of every order are their ends,
    so that they are made from the distinct windows."""
    N = int(order)
    tokens = [F.col(f"t{k}") for k in range(1, N + 1)]
    levels = F.array(*[F.struct(F.lit(k).alias("k"), tokens[N - k].alias("first"),
                                (F.array(*tokens[N - k:N - 1]) if k > 1 else F.array().cast("array<int>")).alias("ctx"),
                                tokens[N - 1].alias("w")) for k in range(1, N + 1)])
    counts = (window_counts(df, N, ids_col).select("n", F.explode(levels).alias("e")).select("n", "e.*")
              .filter((F.col("k") == 1) | ~F.col("first").eqNullSafe(F.lit(BEFORE)))
              .groupBy("k", "ctx", "w").agg(F.sum("n").alias("c")))
    if min_count > 1:
        counts = counts.filter((F.col("k") == 1) | (F.col("c") >= F.lit(int(min_count))))
    return counts


def context_totals(ngrams: DataFrame) -> DataFrame:
    """(k, ctx, n): total continuations per context (recomputed after pruning)."""
    return ngrams.groupBy("k", "ctx").agg(F.sum("c").alias("n"))


@dataclass
class NGramModel:
    ngrams: DataFrame            # (k, ctx, w, c)
    contexts: DataFrame          # (k, ctx, n)
    order: int
    vocab_size: int
    lambdas: list[float] = field(default_factory=list)   # lambda_0 .. lambda_order
    n_unigrams: int | None = None

    def with_lambdas(self, lambdas: list[float]) -> "NGramModel":
        return NGramModel(self.ngrams, self.contexts, self.order, self.vocab_size,
                          list(lambdas), self.n_unigrams, self.materialized, self._gram_levels, self.packed)

    @property
    def unigrams(self) -> DataFrame:
        return self.ngrams.filter(F.col("k") == 1).select("w", F.col("c").alias("c1"))

    materialized: bool = False

    def materialize(self) -> "NGramModel":
        """Write the fitted tables once, so that nothing counts the corpus again."""
        if not self.materialized:
            self.ngrams = write_once(self.ngrams)
            self.contexts = write_once(context_totals(self.ngrams))
            self.materialized = True
        return self

    _gram_levels: dict[int, DataFrame] = field(default_factory=dict)
    packed: dict = field(default_factory=dict)  # the buckets of `packed.pack`; they hold no weights

    def gram_levels(self) -> dict[int, DataFrame]:
        """Per order k >= 2 a table (ctx, short, w, p1..pk): the n-grams with their probability at
        every level up to their own. It holds no weights, so it is written once for all of them."""
        if not self._gram_levels:
            self.materialize()
            n1 = F.lit(float(max(unigram_total(self), 1)))
            level = self.unigrams.select(F.array().cast("array<int>").alias("ctx"), "w",
                                         (F.col("c1").cast("double") / n1).alias("p1"))
            for k in range(2, self.order + 1):
                lower = [f"p{m}" for m in range(1, k)]
                level = write_once(
                    self.ngrams.filter(F.col("k") == k)
                    .join(self.contexts.filter(F.col("k") == k).select("ctx", "n"), "ctx")
                    .select("ctx", "w", (F.col("c").cast("double") / F.col("n")).alias(f"p{k}"), shorter().alias("short"))
                    .join(level.select(F.col("ctx").alias("short"), "w", *lower), ["short", "w"])
                    .select("ctx", "short", "w", *lower, f"p{k}"))
                self._gram_levels[k] = level
        return self._gram_levels


def shorter(ctx: str = "ctx") -> Column:
    """The next shorter context: without the first token."""
    return F.slice(ctx, F.lit(2), F.greatest(F.size(ctx) - 1, F.lit(0)))


def uniform_lambdas(order: int) -> list[float]:
    return [1.0 / (order + 1)] * (order + 1)


def fit(df: DataFrame, order: int = 3, vocab_size: int = 8192, ids_col: str = "ids",
        min_count: int = 1, lambdas: list[float] | None = None) -> NGramModel:
    ngr = ngram_counts(df, order, ids_col, min_count)
    return NGramModel(ngr, context_totals(ngr), order, vocab_size,
                      list(lambdas) if lambdas else uniform_lambdas(order))


def restricted(counts: DataFrame, order: int, vocab_size: int, min_count: int = 1) -> NGramModel:
    """The model of ``order`` and ``min_count`` from counts of that order or a higher one: what
    counting the corpus again would give."""
    ngr = counts.filter((F.col("k") <= int(order)) & ((F.col("k") == 1) | (F.col("c") >= int(min_count))))
    return NGramModel(ngr, context_totals(ngr), order, vocab_size, uniform_lambdas(order))


def unigram_total(model: NGramModel) -> int:
    if model.n_unigrams is None:
        row = model.contexts.filter(F.col("k") == 1).select("n").first()
        model.n_unigrams = int(row[0]) if row and row[0] is not None else 0
    return model.n_unigrams


def suffix_table(model: NGramModel) -> DataFrame:
    """(key, v): the levels >= 2 as one table, a trie laid out as rows. The key ``h + [w]`` of an
    n-gram holds its count, the key ``h + [END]`` of a context its total; no id equals ``END``."""
    grams = model.ngrams.filter(F.col("k") >= 2).select(
        F.concat("ctx", F.array("w")).alias("key"), F.col("c").alias("v"))
    totals = model.contexts.filter(F.col("k") >= 2).select(
        F.concat("ctx", F.array(F.lit(END))).alias("key"), F.col("n").alias("v"))
    return grams.unionByName(totals)


def _windows(df: DataFrame, order: int, s: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., j, win): the last up to ``order`` tokens at each predicted position j >= 2."""
    gen = F.expr(
        f"explode(transform(filter(sequence(2, greatest(size({s}), 2)), j -> j <= size({s})),"
        f" j -> named_struct('j', j, 'win', slice({s}, greatest(j - {order} + 1, 1), least(j, {order})))))")
    return df.select(*keep, gen.alias("e")).select(*keep, "e.j", "e.win")


def level_probabilities(model: NGramModel, df: DataFrame, ids_col: str = "ids",
                        key: str = "row_id") -> DataFrame:
    """(key, j, w, p1..pN): per predicted position, each level with the back-off fill.

    The distinct windows are scored; the positions themselves are shuffled once, to their window."""
    at = _windows(df, model.order, ids_col, (key,))
    scored = window_levels(model, df, ids_col).drop("n")
    return at.join(scored, "win").select(key, "j", "w", *[f"p{k}" for k in range(1, model.order + 1)])


def window_levels(model: NGramModel, df: DataFrame, ids_col: str = "ids") -> DataFrame:
    """(win, w, n, p1..pN): each distinct window of up to ``order`` tokens that ends on a
    predicted position, the number of its positions, and its level probabilities.

    A window asks the suffix table for the counts of all its levels in one equi-join."""
    N = model.order
    win = F.filter(F.array(*[f"t{k}" for k in range(1, N + 1)]), lambda t: ~t.eqNullSafe(F.lit(BEFORE)))
    wins = window_counts(df, N, ids_col).select(win.alias("win"), "n", F.col(f"t{N}").alias("w"))
    if N >= 2:
        asked = F.expr(
            f"explode(flatten(transform(sequence(2, least({N}, size(win))), k -> array("
            f"named_struct('k', k, 'total', true, 'key', concat(slice(win, size(win) - k + 1, k - 1), array({END}))),"
            f"named_struct('k', k, 'total', false, 'key', slice(win, size(win) - k + 1, k))))))")
        asked = wins.select("win", "n", "w", asked.alias("a")).select("win", "n", "w", "a.k", "a.total", "a.key")
        answers = [F.max(F.when((F.col("k") == k) & (F.col("total") == total), F.col("v"))).alias(f"{name}{k}")
                   for k in range(2, N + 1) for name, total in (("n", True), ("c", False))]
        wins = (asked.join(suffix_table(model), "key", "left").groupBy("win")
                .agg(F.first("n").alias("n"), F.first("w").alias("w"), *answers))
    return _with_levels(model, wins).select("win", "w", "n", *[f"p{k}" for k in range(1, N + 1)])


def _with_levels(model: NGramModel, pos: DataFrame) -> DataFrame:
    """Add p1..pN, an unseen context taking the level below."""
    n1 = unigram_total(model)
    pos = pos.join(model.unigrams, on="w", how="left")
    p = F.coalesce(F.col("c1"), F.lit(0)).cast("double") / F.lit(float(max(n1, 1)))
    pos = pos.withColumn("p1", p)
    for k in range(2, model.order + 1):
        p = F.when(F.col(f"n{k}").isNotNull(),
                   F.coalesce(F.col(f"c{k}"), F.lit(0)).cast("double") / F.col(f"n{k}")).otherwise(p)
        pos = pos.withColumn(f"p{k}", p)
    return pos


def mixture(lambdas: list[float], vocab_size: int, order: int) -> Column:
    """``lambda_0 / V + lambda_1 p1 + ... + lambda_N pN`` summed left to right."""
    expr = F.lit(float(lambdas[0]) / float(vocab_size))
    for k in range(1, order + 1):
        expr = expr + F.lit(float(lambdas[k])) * F.col(f"p{k}")
    return expr


def position_scores(model: NGramModel, df: DataFrame, ids_col: str = "ids",
                    key: str = "row_id") -> DataFrame:
    lv = level_probabilities(model, df, ids_col, key)
    p = mixture(model.lambdas, model.vocab_size, model.order)
    return lv.withColumn("p", p).withColumn("nll", -F.log(F.col("p")))


def window_scores(model: NGramModel, df: DataFrame, ids_col: str = "ids") -> DataFrame:
    """`window_levels` with ``p`` and ``nll``."""
    p = mixture(model.lambdas, model.vocab_size, model.order)
    return window_levels(model, df, ids_col).withColumn("p", p).withColumn("nll", -F.log(F.col("p")))


def perplexity(scores: DataFrame) -> DataFrame:
    """One row: total nll, token count, perplexity (``inf`` when there are no tokens), from
    position scores or from window scores with their counts ``n``."""
    n = F.col("n") if "n" in scores.columns else F.lit(1)
    agg = scores.agg(F.sum(F.col("nll") * n).alias("sum_nll"),
                     F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_tokens"))
    return agg.select(
        "sum_nll", "n_tokens",
        F.when(F.col("n_tokens") > 0, F.exp(F.col("sum_nll") / F.col("n_tokens")))
        .otherwise(F.lit(math.inf)).alias("perplexity"))


def perplexity_cells(model: NGramModel, levels: DataFrame, weights: list[list[float]]) -> list[float]:
    """Perplexity of several weight vectors over a table of `window_levels`: one aggregate."""
    n = F.sum("n")
    row = levels.agg(*[
        F.when(n > 0, F.exp(F.sum(-F.log(mixture(lam, model.vocab_size, model.order)) * F.col("n")) / n))
        .otherwise(F.lit(math.inf)).alias(f"ppl{i}") for i, lam in enumerate(weights)]).first()
    return [float(row[f"ppl{i}"]) for i in range(len(weights))]


def em_update(model: NGramModel, levels: DataFrame, lr: float = 1.0) -> tuple[list[float], float]:
    """One EM step of the model's own weights, see `em_update_cells`."""
    return em_update_cells(model, levels, [model.lambdas], [lr])[0]


def em_update_cells(model: NGramModel, levels: DataFrame, weights: list[list[float]],
                    lrs: list[float]) -> list[tuple[list[float], float]]:
    """One EM step of several weight vectors on held-out windows: new lambda_k = mean
    responsibility of level k.

    Returns per vector the stepped weights ``(1-lr)*old + lr*new`` and the held-out mean nll
    under the old weights. One aggregate over the (written) table of `window_levels`, however
    many vectors there are."""
    N, V = model.order, model.vocab_size
    cells = range(len(weights))
    scored = levels.select("*", *[mixture(lam, V, N).alias(f"_p{i}") for i, lam in enumerate(weights)])

    def mean(c: Column) -> Column:
        return F.sum(c * F.col("n")) / F.sum("n")
    wanted = []
    for i, lam in enumerate(weights):
        p = F.col(f"_p{i}")
        wanted.append(mean(F.lit(lam[0] / V) / p).alias(f"r{i}_0"))
        wanted += [mean(F.lit(lam[k]) * F.col(f"p{k}") / p).alias(f"r{i}_{k}") for k in range(1, N + 1)]
        wanted.append(mean(-F.log(p)).alias(f"nll{i}"))
    row = scored.agg(*wanted).first()
    if row["nll0"] is None:
        return [(list(lam), math.nan) for lam in weights]
    out = []
    for i in cells:
        new = [float(row[f"r{i}_{k}"]) for k in range(N + 1)]
        total = sum(new)
        # 12 places, so that a run does not depend on the order of the sums
        out.append(([round((1.0 - lrs[i]) * a + lrs[i] * (b / total), 12) for a, b in zip(weights[i], new)],
                    float(row[f"nll{i}"])))
    return out

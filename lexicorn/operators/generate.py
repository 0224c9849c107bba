"""Next-token completion for whole tables of prompts.

Greedy (exact): the best next token depends only on the last ``order - 1`` tokens, so it is
computed once per model, as a table (context, next) over all contexts the model has seen.
At each level the candidates of a context are its own continuations plus the best token of
the next shorter context: a token that was not seen after the context keeps its score of the
shorter one, so none of them beats that one. A round then is a lookup of the longest seen
context; contexts without any get the top unigram. Ties go to the lowest id. A table of at most
`packed.WHOLE` bytes goes to the tasks and a row takes all its rounds in one pass; a larger one
is joined round by round.

Sampled (exact over the whole vocabulary): for a context the probability of a
non-continuation token is ``lambda_0/V + c * p1(w)``; continuation tokens carry their full
interpolated probability. A round sends the rows to the buckets of `packed` by their last token;
there the tokens seen after the last one make one table for all contexts that end in it, and a
context brings the continuations of its longer levels alone. Without buckets the continuations come
from lists that are made once per model. Temperature, the top-p
cut (keep while cumulative <= top_p, always the first) and the draws by each row's hashed uniform
are solved on two broadcast cumulative tables of the unigrams (size bounded by the vocabulary
cap), see `SampledTokens`.

The state of a round holds the id, the last tokens and the new tokens of unfinished rows;
finished rows are set aside. Lineage is cut every ``checkpoint_every`` rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicorn.functions.hashing import hash_uniform
from lexicorn.functions.tokens import EOS_ID, MAX_GEN_LEN
from lexicorn.operators import packed as PK
from lexicorn.operators.distribution import PLACES
from lexicorn.operators.ngram import NGramModel, shorter, unigram_total
from lexicorn.session import write_once


def context_key(ids: str, order: int):
    n = order - 1
    return F.slice(F.col(ids), F.greatest(F.size(ids) - F.lit(n) + 1, F.lit(1)),
                   F.least(F.size(ids), F.lit(n)))


def _levels(dc: DataFrame, order: int) -> DataFrame:
    """(ck, k, ctx) for every level k >= 2 whose context exists inside ck."""
    gen = F.expr(
        f"explode(transform(filter(sequence(2, {order}), k -> size(ck) >= k - 1),"
        f" k -> named_struct('k', k, 'ctx', slice(ck, size(ck) - k + 2, k - 1))))")
    return dc.select("ck", gen.alias("l")).select("ck", F.col("l.k").alias("k"),
                                                  F.col("l.ctx").alias("ctx"))


def top_unigram(model: NGramModel) -> int:
    row = (model.unigrams.orderBy(F.col("c1").desc(), F.col("w")).select("w").first())
    return int(row[0]) if row else EOS_ID


def score_candidates(model: NGramModel, dc: DataFrame, with_top: int | None) -> DataFrame:
    """(ck, w, p, seen2) for continuations seen at some order (+ the given top unigram).

    One exchange on ``ck``: level totals come from a window over that partitioning and
    the per-candidate aggregate reuses it, so the round adds no further shuffles.
    """
    N, lam, V = model.order, model.lambdas, model.vocab_size
    n1 = unigram_total(model)
    lv = _levels(dc, N)
    ngr = model.ngrams.filter(F.col("k") >= 2)
    cand = ngr.join(lv, on=["k", "ctx"], how="inner").select("ck", "k", "w", "c")
    if with_top is not None:
        cand = cand.unionByName(dc.select("ck", F.lit(0).alias("k"), F.lit(with_top).alias("w"),
                                          F.lit(None).cast("bigint").alias("c")))
    by_ctx = Window.partitionBy("ck")
    cand = cand.repartition("ck")
    for k in range(2, N + 1):
        cand = cand.withColumn(f"n{k}", F.sum(F.when(F.col("k") == k, F.col("c"))).over(by_ctx))
    cand = cand.groupBy("ck", "w").agg(
        *[F.max(F.when(F.col("k") == k, F.col("c"))).alias(f"c{k}") for k in range(2, N + 1)],
        *[F.first(f"n{k}").alias(f"n{k}") for k in range(2, N + 1)])
    cand = cand.join(model.unigrams, on="w", how="left")
    p = F.coalesce(F.col("c1"), F.lit(0)).cast("double") / F.lit(float(max(n1, 1)))
    score = F.lit(float(lam[0]) / float(V)) + F.lit(float(lam[1])) * p
    for k in range(2, N + 1):
        p = F.when(F.col(f"n{k}").isNotNull(),
                   F.coalesce(F.col(f"c{k}"), F.lit(0)).cast("double") / F.col(f"n{k}")).otherwise(p)
        score = score + F.lit(float(lam[k])) * p
    seen2 = F.col("n2").isNotNull() if N >= 2 else F.lit(False)
    return cand.select("ck", "w", score.alias("p"), seen2.alias("seen2"))


def successors(model: NGramModel) -> DataFrame:
    """(ctx, next): the greedy next token of every context of 1 .. order-1 tokens that the
    model has seen, as the longest seen context of a sequence."""
    return successors_cells(model, [model.lambdas]).select("ctx", F.get("next", 0).alias("next"))


def successors_cells(model: NGramModel, weights: list[list[float]], needed_only: bool = False) -> DataFrame:
    """(ctx, next): `successors` of several weight vectors over the same counts, ``next`` an
    array with a token for each vector. The probabilities of the n-grams do not depend on the
    weights and are kept with the model (`gram_levels`); a vector adds columns. With
    ``needed_only`` a context goes whose tokens are those of the next shorter one (of the top
    unigram, for a context of one token): a lookup of the longest context finds the same there."""
    N, V = model.order, float(model.vocab_size)
    lams = [[float(x) for x in lam] for lam in weights]
    s, b, g = ([f"{x}{i}" for i in range(len(lams))] for x in "sbg")

    def candidate(score: Column, w: Column) -> Column:
        return F.struct(score.alias("s"), (-w).alias("nw"))

    def score(lam: list[float], k: int, up_to: int) -> Column:
        """The score of an n-gram of order k up to a level; its own probability fills the higher ones."""
        total = F.lit(lam[0] / V) + F.lit(lam[1]) * F.col("p1")
        for m in range(2, up_to + 1):
            total = total + F.lit(lam[m]) * F.col(f"p{min(m, k)}")
        return total
    if N < 2:  # order 1 has no contexts
        return model.ngrams.sparkSession.createDataFrame([], "ctx array<int>, next array<int>")
    grams, top = model.gram_levels(), top_unigram(model)
    n1 = F.lit(float(max(unigram_total(model), 1)))
    best = (model.unigrams.filter(F.col("w") == top).withColumn("p1", F.col("c1").cast("double") / n1)
            .select(F.array().cast("array<int>").alias("ctx"),
                    *[candidate(score(lam, 1, 1), F.col("w")).alias(x) for lam, x in zip(lams, b)],
                    F.array(*[F.lit(top) for _ in lams]).alias("next")))
    out = None
    for k in range(2, N + 1):
        # partial score up to this level, and the score if no longer context was seen
        seen = grams[k].select("ctx", *[candidate(score(lam, k, k), F.col("w")).alias(x) for lam, x in zip(lams, b)],
                               *[candidate(score(lam, k, N), F.col("w")).alias(x) for lam, x in zip(lams, g)],
                               F.lit(None).cast("array<int>").alias("up"))
        inherited = (model.contexts.filter(F.col("k") == k).select("ctx", shorter().alias("short"))
                     .join(best.withColumnRenamed("ctx", "short"), "short")
                     .select("ctx", *b, *[F.col(x).alias(y) for x, y in zip(b, g)], F.col("next").alias("up")))
        picked = write_once(seen.unionByName(inherited).groupBy("ctx").agg(*[F.max(x).alias(x) for x in b + g],
                                                                            F.max("up").alias("up"))
                            .withColumn("next", F.array(*[(-F.col(f"{x}.nw")).cast("int") for x in g])))
        best = picked.select("ctx", *b, "next")
        here = (picked.filter(F.col("up").isNull() | (F.col("up") != F.col("next"))) if needed_only else picked).select("ctx", "next")
        out = here if out is None else out.unionByName(here)
    return write_once(out)


def _background(model: NGramModel) -> np.ndarray:
    """Unigram probability vector over all ids (length V, bounded by the vocabulary cap)."""
    n1 = float(max(unigram_total(model), 1))
    vec = np.zeros(model.vocab_size, dtype=np.float64)
    for w, c in model.unigrams.collect():
        if w is not None and 0 <= w < model.vocab_size:
            vec[w] = c / n1
    return vec


class SampledTokens:
    """Draws from temperature + top-p distributions of many contexts without a V-long sort each.

    Outside its own continuations a context's probabilities are ``lam_0/V + c * p1(w)``, where
    ``c`` depends on nothing but whether the context was seen. So two cumulative tables, sorted
    by (probability desc, id), serve all contexts. A context with m continuations takes their
    ids out of the shared table, puts their own probabilities in, and finds the top-p cut and
    every draw by binary search over prefix sums: m log V steps in place of V log V."""

    def __init__(self, p1: np.ndarray, lam: list[float], temperature: float, top_p: float):
        self.t, self.top_p, self.shared = max(float(temperature), 1e-8), float(top_p), {}
        for seen, c in ((True, lam[1]), (False, float(sum(lam[1:])))):
            self.shared[seen] = self.table(lam[0] / p1.shape[0] + c * p1)

    def table(self, p: np.ndarray) -> tuple:
        """The cumulative table of one distribution over all ids, sorted by (probability desc, id)."""
        ids = np.argsort(-p, kind="stable")
        place = np.empty_like(ids)
        place[ids] = np.arange(ids.shape[0])
        logp = np.log(p[ids])
        q = np.exp((logp - logp[0]) / self.t)
        return ids, place, -p[ids], logp[0], q, np.concatenate(([0.0], np.cumsum(q)))

    def draw(self, words, probs, seen: bool, u: np.ndarray) -> np.ndarray:
        """The token of each uniform in ``u``: the first one, by (probability desc, id), whose
        cumulative share of the kept tokens exceeds it."""
        return self.draw_from(self.shared[seen], words, probs, u)

    def draw_from(self, table: tuple, words, probs, u: np.ndarray) -> np.ndarray:
        """`draw` with any table: ``words`` take their own probabilities in place of the table's."""
        ids, place, neg, peak, q, prefix = table
        words = np.asarray([] if words is None else words, dtype=np.int64)
        probs = np.asarray([] if probs is None else probs, dtype=np.float64)
        order = np.lexsort((words, -probs))
        words, probs = words[order], probs[order]
        m = words.shape[0]
        # how many shared tokens rank before each continuation: by probability, then by id
        before = np.searchsorted(neg, -probs, side="left")
        for i in np.nonzero(before < np.searchsorted(neg, -probs, side="right"))[0]:
            end = np.searchsorted(neg, -probs[i], side="right")
            before[i] += np.searchsorted(ids[before[i]:end], words[i])
        logs = np.log(probs)
        top = max(peak, logs[0]) if m else peak
        scale = np.exp((peak - top) / self.t)
        own = np.concatenate(([0.0], np.cumsum(np.exp((logs - top) / self.t))))
        gone = np.sort(place[words])
        lost = np.concatenate(([0.0], np.cumsum(q[gone])))

        def mass(at):
            """Sum over the shared tokens before a place that are not continuations."""
            return scale * (prefix[at] - lost[np.searchsorted(gone, at)])

        def reach(bound, total, n_own, end):
            """Continuations (at most n_own) and shared places (at most ``end``) of the longest
            run from the top whose rounded share of ``total`` is at most each bound."""
            shares = np.round((mass(before[:n_own]) + own[1:n_own + 1]) / total, PLACES)
            k = np.searchsorted(shares, bound, side="right")
            edges = np.concatenate(([0], before[:n_own], [end]))
            lo, hi = edges[k], np.maximum(edges[k + 1], edges[k])
            while np.any(lo < hi):
                mid = (lo + hi + 1) // 2
                fits = np.round((mass(mid) + own[k]) / total, PLACES) <= bound
                lo, hi = np.where(fits, mid, lo), np.where(fits, hi, mid - 1)
            return k, lo, edges[k + 1]

        def rest(at):
            """Shared tokens before a place that are not continuations: their number."""
            return at - np.searchsorted(gone, at)

        gaps = gone - np.arange(m)

        def free(r):
            """The shared token that is no continuation and has ``r`` such before it."""
            return ids[r + np.searchsorted(gaps, r, side="right")]

        size = ids.shape[0]
        k, at, _ = reach(np.array([self.top_p]), mass(size) + own[m], m, size)
        k, at = int(k[0]), int(at[0])
        if k == 0 and rest(at) == 0:  # the first token is always kept
            first = words[0] if m and rest(before[0]) == 0 else free(0)
            return np.full(u.shape[0], first, dtype=np.int32)
        n, got, stop = reach(u, mass(at) + own[k], k, at)
        # u at or above the rounded total takes the last kept token
        shared_left = rest(stop) > rest(got)
        own_left = ~shared_left & (n < k)
        beyond = ~shared_left & ~own_left
        out = np.empty(u.shape[0], dtype=np.int32)
        out[shared_left] = free(rest(got[shared_left]))
        out[own_left] = words[n[own_left]] if m else 0
        if beyond.any():
            last_own = k > 0 and rest(at) == rest(before[k - 1])
            out[beyond] = words[k - 1] if last_own else free(rest(at) - 1)
        return out


def continuation_lists(model: NGramModel) -> DataFrame:
    """(ctx, words, counts, total): a row for every seen context, made once for all rounds. A list
    has at most as many words as the vocabulary."""
    return write_once(model.ngrams.filter(F.col("k") >= 2).groupBy("ctx")
                      .agg(F.collect_list(F.struct("w", "c")).alias("wc"), F.sum("c").alias("total"))
                      .select("ctx", F.col("wc.w").alias("words"), F.col("wc.c").alias("counts"), "total"))


def merged_scores(p1: np.ndarray, lam: list[float], levels) -> tuple[np.ndarray, np.ndarray, bool]:
    """(words, probabilities, seen) of one context from its (k, words, counts, total) lists: what
    `score_candidates` gives for it row by row."""
    by_level = {int(x["k"]): x for x in levels}
    words = np.unique(np.concatenate([np.asarray(x["words"], np.int64) for x in by_level.values()]
                                     or [np.empty(0, np.int64)]))
    p = p1[words]
    score = lam[0] / p1.shape[0] + lam[1] * p
    for k in range(2, len(lam)):
        if k in by_level:
            x, counts = by_level[k], np.zeros(words.shape[0])
            counts[np.searchsorted(words, np.asarray(x["words"], np.int64))] = np.asarray(x["counts"], np.float64)
            p = counts / float(x["total"])
        score = score + lam[k] * p
    return words, score, 2 in by_level


#: packs that a task draws for at a time
PACKS = 256


def _sampled_pick(model: NGramModel, lists: DataFrame, act: DataFrame, rnd: int, seed: int, sampler) -> DataFrame:
    """(_row, next). Rows meet their context's continuations in packs of one written partition,
    so a list travels once a pack, and a hot context is spread over as many packs as partitions.

    The contexts that are asked for are written first: the planner knows their size and, where
    they are few, sends them to the lists instead of shuffling a whole model each round."""
    asked = write_once(_levels(act.select("ck").distinct(), model.order))
    per_ctx = (lists.join(asked, "ctx").groupBy("ck")
               .agg(F.collect_list(F.struct("k", "words", "counts", "total")).alias("levels")))
    packs = (act.select("_row", "ck", hash_uniform(seed, "_draw", F.lit(rnd)).alias("u"))
             .groupBy("ck", F.shiftright("_row", 33).alias("part")).agg(F.collect_list(F.struct("_row", "u")).alias("rows"))
             .select("ck", F.col("rows._row").alias("row"), F.col("rows.u").alias("u"))
             .join(per_ctx, on="ck", how="left"))

    def draw(it):
        shared, p1, lam = sampler.value
        for batch in it:
            for at in range(0, batch.num_rows, PACKS):
                pdf = batch.slice(at, PACKS).to_pandas()
                drawn = []
                for p in pdf.itertuples(index=False):
                    words, probs, seen = merged_scores(p1, lam, [] if p.levels is None else p.levels)
                    drawn.append(shared.draw(words, probs, seen, np.asarray(p.u)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.asarray(r, dtype=np.int64) for r in pdf["row"]])),
                     pa.array(np.concatenate(drawn).astype(np.int32))], names=["_row", "next"])

    return packs.select("row", "u", "levels").mapInArrow(draw, "_row long, next int")


def generate(model: NGramModel, prompts: DataFrame, max_new: int = MAX_GEN_LEN,
             sampling: bool = False, temperature: float = 1.0, top_p: float = 0.9,
             seed: int = 42, eos_id: int | None = EOS_ID, checkpoint_every: int = 5,
             id_col: str = "seq_id", ids_col: str = "prompt_ids", draw_col: str | None = None,
             weights: list[list[float]] | None = None) -> DataFrame:
    """(seq_id, prompt_ids, gen_ids): prompt + up to ``max_new`` tokens, stopping after EOS.

    An empty prompt yields ``[eos]`` (or ``[]`` without an EOS id), as in the reference.
    Sampling draws by the hash of ``draw_col`` (the id if not given) and the round. With
    ``weights`` (greedy only) a row is completed by the weight vector whose place ``draw_col``
    holds, all vectors in the same rounds."""
    if weights is not None and (sampling or draw_col is None):
        raise ValueError("weights need greedy completion and draw_col, the place of a row's vector")
    model.materialize()
    if not sampling and (table := _whole_table(model, weights)) is not None:
        return _walked(prompts.select(F.col(id_col).alias("seq_id"), F.col(ids_col).alias("prompt_ids"),
                                      (F.lit(0) if weights is None else F.col(draw_col).cast("int")).alias("_cell")),
                       model, *table, max_new, eos_id)
    given = write_once(prompts.select(F.col(id_col).alias("seq_id"), F.col(ids_col).alias("prompt_ids"),
                                      F.col(draw_col or id_col).alias("_draw"))
                       .withColumn("_row", F.monotonically_increasing_id()))
    nothing = F.array().cast("array<int>")
    active = given.filter(F.size("prompt_ids") > 0).select(
        "_row", "_draw", context_key("prompt_ids", model.order).alias("ck"), nothing.alias("new"),
        F.lit(max_new <= 0).alias("done"))
    step = _sampled_step(model, seed, temperature, top_p) if sampling else _greedy_step(model, weights)
    # a sampled round over joined lists reads its state twice
    every = 1 if sampling and PK.pack(model) is None else checkpoint_every
    finished = []
    for start in range(0, max(max_new, 0), every):
        for rnd in range(start + 1, min(start + every, max_new) + 1):
            drawn = step(active, rnd)
            live, w = ~F.col("done"), F.col("next")
            hit = (w == F.lit(eos_id)) if eos_id is not None else F.lit(False)
            grown = F.concat("ck", F.array(w))
            active = drawn.select(
                "_row", "_draw",
                F.when(live, F.slice(grown, F.greatest(F.size(grown) - model.order + 2, F.lit(1)), F.lit(model.order - 1)))
                .otherwise(F.col("ck")).alias("ck"),
                F.when(live, F.concat("new", F.array(w))).otherwise(F.col("new")).alias("new"),
                (F.col("done") | hit | F.lit(rnd >= max_new)).alias("done"))
        active = write_once(active)
        finished.append(active.filter("done").select("_row", "new"))
        active = active.filter(~F.col("done"))
        if active.isEmpty():
            break
    made = finished[0] if finished else active.select("_row", "new").limit(0)
    for more in finished[1:]:
        made = made.unionByName(more)
    empty = F.array(F.lit(eos_id)) if eos_id is not None else nothing
    return (given.join(made, "_row", "left")
            .select("seq_id", "prompt_ids",
                    F.when(F.size("prompt_ids") == 0, empty)
                    .otherwise(F.concat("prompt_ids", F.coalesce("new", nothing))).alias("gen_ids")))


def _whole_table(model: NGramModel, weights: list[list[float]] | None):
    """(table, top unigram) if the table of next tokens is small enough to go to the tasks whole."""
    top = PK.top_unigram(model)
    known = None if top is None else PK.greedy_table(model, [model.lambdas] if weights is None else weights, top)
    return None if known is None else (known, top)


def _walked(rows: DataFrame, model: NGramModel, known: dict, top: int, max_new: int, eos_id: int | None) -> DataFrame:
    """All greedy rounds of a row where it stands: no shuffle, no round of jobs."""
    table = rows.sparkSession.sparkContext.broadcast(known)
    schema = T.StructType([*rows.drop("_cell").schema.fields, T.StructField("new", T.ArrayType(T.IntegerType()))])
    nothing = F.array().cast("array<int>")
    empty = F.array(F.lit(eos_id)) if eos_id is not None else nothing
    return (rows.mapInArrow(PK.walk(table, model.order, top, max_new, eos_id), schema)
            .select("seq_id", "prompt_ids",
                    F.when(F.size("prompt_ids") == 0, empty).otherwise(F.concat("prompt_ids", "new")).alias("gen_ids")))


def _greedy_step(model: NGramModel, weights: list[list[float]] | None = None):
    table = successors_cells(model, [model.lambdas] if weights is None else weights, needed_only=True)
    top = F.lit(top_unigram(model))
    n = model.order - 1

    def step(active: DataFrame, rnd: int) -> DataFrame:
        # a finished row looks for a context that can't exist, one of many, so that the
        # finished rows do not meet in one partition
        own = F.when(F.col("done"), F.array((-1 - F.pmod(F.xxhash64("_row"), F.lit(1 << 20))).cast("int"))) \
            .otherwise(F.col("ck"))
        out, found = active.withColumn("_at", own), []
        for size in range(n, 0, -1):  # the longest context in the table
            key = F.slice("_at", F.greatest(F.size("_at") - size + 1, F.lit(1)), F.least(F.size("_at"), F.lit(size)))
            known = table.filter(F.size("ctx") <= size).select(F.col("ctx").alias(f"_k{size}"), F.col("next").alias(f"_n{size}"))
            out = out.withColumn(f"_k{size}", key).join(known, f"_k{size}", "left")
            found.append(F.get(f"_n{size}", F.lit(0) if weights is None else F.col("_draw").cast("int")))
        return out.withColumn("next", F.coalesce(*found, top))
    return step


def _sampled_step(model: NGramModel, seed: int, temperature: float, top_p: float):
    # two tables of V entries, bounded by the vocabulary cap; broadcast once per call
    lam, p1 = [float(x) for x in model.lambdas], _background(model)
    sampler = model.ngrams.sparkSession.sparkContext.broadcast((SampledTokens(p1, lam, temperature, top_p), p1, lam))
    if (packed := PK.pack(model)) is not None:
        def drawn(active: DataFrame, rnd: int) -> DataFrame:
            at = F.when(F.col("done"), F.pmod("_row", F.lit(packed.buckets))).otherwise(
                PK.bucket(F.element_at("ck", -1), packed.buckets))
            asked = active.withColumn("u", hash_uniform(seed, "_draw", F.lit(rnd))).withColumn("bucket", at)
            schema = T.StructType([*active.schema.fields, T.StructField("next", T.IntegerType())])
            return (asked.groupBy("bucket").cogroup(packed.table.groupBy("bucket"))
                    .applyInArrow(PK.draw(sampler, active.columns, model.order), schema))
        return drawn
    lists = continuation_lists(model)

    def step(active: DataFrame, rnd: int) -> DataFrame:
        pick = _sampled_pick(model, lists, active.select("_row", "_draw", "ck"), rnd, seed, sampler)
        return active.join(pick, "_row", "left")
    return step


def continuation(gen_ids: str = "gen_ids", prompt_ids: str = "prompt_ids"):
    """Only the new tokens (the prompt prefix removed)."""
    return F.slice(F.col(gen_ids), F.size(prompt_ids) + 1,
                   F.greatest(F.size(gen_ids) - F.size(prompt_ids), F.lit(0)))

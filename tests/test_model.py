import pytest
from pyspark.sql import functions as F

from conftest import SF001
from lexicorn.operators import generate as GE
from lexicorn.operators import ngram as NG
from lexicorn.plans import pipeline as PL


@pytest.fixture(scope="module")
def fitted(spark):
    enc = PL.encoded_corpus(spark, SF001)
    m = NG.fit(enc.filter(F.col("split") == "train"), 3, PL.DEFAULT.vocab_size).materialize()
    return m, enc


def test_conditionals_sum_to_one(fitted):
    m, _ = fitted
    s = (m.ngrams.join(m.contexts, on=["k", "ctx"])
         .groupBy("k", "ctx").agg(F.sum(F.col("c") / F.col("n")).alias("s")))
    assert s.filter(F.abs(F.col("s") - 1.0) > 1e-9).count() == 0


def test_em_does_not_lower_likelihood(fitted):
    m, enc = fitted
    rows = enc.filter(F.col("split") != "train")
    lv = NG.window_levels(m, rows).cache()
    by_position = NG.perplexity(NG.position_scores(m, rows)).first()
    by_window = NG.perplexity(NG.window_scores(m, rows)).first()
    assert by_window.n_tokens == by_position.n_tokens
    assert by_window.perplexity == pytest.approx(by_position.perplexity)
    lam1, nll0 = NG.em_update(m, lv, lr=1.0)
    _, nll1 = NG.em_update(m.with_lambdas(lam1), lv, lr=1.0)
    assert nll1 <= nll0 + 1e-12
    assert sum(lam1) == pytest.approx(1.0)


def test_greedy_equals_sampling_with_tiny_top_p(spark, fitted):
    m, enc = fitted
    prompts = (enc.filter(F.col("split") == "test")
               .select(F.col("row_id").alias("seq_id"), F.slice("ids", 1, 3).alias("prompt_ids")))
    g = GE.generate(m, prompts, max_new=3)
    s = GE.generate(m, prompts, max_new=3, sampling=True, temperature=1.0, top_p=1e-9)
    a = {r.seq_id: r.gen_ids for r in g.collect()}
    b = {r.seq_id: r.gen_ids for r in s.collect()}
    assert a == b


def test_empty_prompt_yields_eos(spark, fitted):
    m, _ = fitted
    p = spark.createDataFrame([(1, [])], "seq_id long, prompt_ids array<int>")
    assert GE.generate(m, p, max_new=5).first().gen_ids == [1]


def _brute_next(counts, order, lam, size, ctx):
    """Best next id by the interpolated score over the whole vocabulary."""
    uni = counts[1][()]
    total = sum(uni.values())
    best = None
    for w in range(size):
        p = uni.get(w, 0) / total
        s = lam[0] / size + lam[1] * p
        for k in range(2, order + 1):
            h = tuple(ctx[len(ctx) - k + 1:])
            if len(h) == k - 1 and h in counts[k]:
                p = counts[k][h].get(w, 0) / sum(counts[k][h].values())
            s += lam[k] * p
        if best is None or s > best[0] + 1e-15:
            best = (s, w)
    return best[1]


@pytest.mark.parametrize("order,min_count", [(2, 1), (3, 1), (4, 1), (3, 2)])
def test_next_token_table_equals_brute_force(spark, order, min_count):
    import collections
    import random
    rng = random.Random(order)
    rows = [[rng.choice([3, 3, 4, 5, 6, 7, 8, 1]) for _ in range(rng.randrange(2, 12))] for _ in range(60)]
    m = NG.fit(spark.createDataFrame([(r,) for r in rows], "ids array<int>"), order, 12, min_count=min_count,
               lambdas=[.1, .2, .3, .25, .15][:order + 1]).materialize()
    counts = {k: collections.defaultdict(dict) for k in range(1, order + 1)}
    for r in m.ngrams.collect():
        counts[r.k][tuple(r.ctx)][r.w] = r.c
    table = {tuple(r.ctx): r.next for r in GE.successors(m).collect()}
    for ctx, w in table.items():
        assert w == _brute_next(counts, order, m.lambdas, 12, ctx), ctx
    assert set(table) == {c for k in range(2, order + 1) for c in counts[k]}
    prompts = [(i, [rng.randrange(3, 12) for _ in range(rng.randrange(0, 5))]) for i in range(20)] + [(3, [3, 4])]
    out = GE.generate(m, spark.createDataFrame(prompts, "seq_id long, prompt_ids array<int>"), max_new=7,
                      checkpoint_every=3).collect()
    assert len(out) == len(prompts)
    for r in out:
        ids = list(r.prompt_ids)
        for _ in range(7 if ids else 0):
            ids.append(_brute_next(counts, order, m.lambdas, 12, ids[max(0, len(ids) - order + 1):]))
            if ids[-1] == 1:
                break
        assert r.gen_ids == (ids or [1])


def test_sampled_tokens_equal_the_distribution_operators(spark, fitted):
    """One sampled round against temperature, top-p, renormalise and draw over the whole vocabulary."""
    from lexicorn.functions.hashing import hash_uniform
    from lexicorn.operators import distribution as DI
    m, enc = fitted
    prompts = (enc.filter(F.col("split") == "test")
               .select(F.col("row_id").alias("seq_id"), F.slice("ids", 1, 2).alias("prompt_ids")))
    got = {r.seq_id: r.gen_ids[-1] for r in GE.generate(m, prompts, max_new=1, sampling=True, temperature=.8,
                                                        top_p=.7, seed=5).collect()}
    pr = {r.seq_id: (r.prompt_ids, r.u) for r in prompts.withColumn("u", hash_uniform(5, "seq_id", F.lit(1))).collect()}
    sc = GE.score_candidates(m, prompts.select(F.col("prompt_ids").alias("ck")).distinct(), None).collect()
    by_ctx = {}
    for r in sc:
        by_ctx.setdefault(tuple(r.ck), ({}, r.seen2))[0][r.w] = r.p
    n1 = NG.unigram_total(m)
    p1 = {r.w: r.c1 / n1 for r in m.unigrams.collect()}
    rows = []
    for ck in {tuple(v[0]) for v in pr.values()}:
        known, seen = by_ctx.get(ck, ({}, False))
        back = m.lambdas[1] if seen else sum(m.lambdas[1:])
        rows += [(str(ck), w, known.get(w, m.lambdas[0] / m.vocab_size + back * p1.get(w, 0.0))) for w in range(m.vocab_size)]
    dist = DI.renormalise(DI.top_p_filter(DI.apply_temperature(
        spark.createDataFrame(rows, "ctx string, token int, p double"), .8), .7)).collect()
    kept = {}
    for r in sorted(dist, key=lambda r: (-r.p, r.token)):
        kept.setdefault(r.ctx, []).append((r.token, r.p))
    for s, (ck, u) in pr.items():
        acc = 0.0
        for w, p in kept[str(tuple(ck))]:
            acc += p
            if acc > u:
                break
        assert got[s] == w


def test_complete_prompt_table(spark, fitted):
    from lexicorn.plans import evaluate as EV
    m, _ = fitted
    voc = PL.corpus_vocab(spark, SF001)
    df = spark.createDataFrame([(1, "The the"), (1, "of THE and"), (2, None), (3, "")], "row_id long, text string")
    for sampling in (False, True):
        rows = EV.complete(m, df, voc, sampling=sampling).collect()
        assert len(rows) == 4
        for r in rows:
            assert (r.prediction == "") if not r.text else r.completed.startswith(r.text.lower())
    assert EV.complete(m, df.limit(0), voc).count() == 0
    five = EV.complete(m, df, voc, n_words=1).filter("row_id = 1").collect()
    assert all(len(r.completed) > len(r.text) or r.prediction == "" for r in five)


def test_grid_search_resumes_after_a_crash(spark, monkeypatch):
    from lexicorn.plans import experiment as XP
    from lexicorn.session import shared_path
    from lexicorn.sources import store as ST
    path = shared_path(spark, "grid")
    grid = XP.param_grid(lr=[0.5], order=[2, 3], min_count=[1], epochs=[1])
    plain, ran = XP.train_cells, []

    def crash(model, *a, **k):
        ran.append(model.order)
        if model.order == 3 and ran.count(3) == 1:
            raise RuntimeError("lost")
        return plain(model, *a, **k)
    monkeypatch.setattr(XP, "train_cells", crash)
    with pytest.raises(RuntimeError):
        XP.grid_search(spark, SF001, grid, max_new=2, results_dir=path)
    assert [r.run_id for r in spark.read.parquet(f"{path}/results").collect()] == [1]
    assert ST.load_model(spark, f"{path}/models", tag="run-1").order == 2
    out = XP.grid_search(spark, SF001, grid, max_new=2, results_dir=path)
    assert ran == [2, 3, 3] and [r.run_id for r in out.sort("run_id").collect()] == [1, 2]
    assert ST.load_model(spark, f"{path}/models").order == 3
    assert spark.read.parquet(f"{path}/history").select("run_id").distinct().count() == 2
    assert spark.read.option("header", True).csv(f"{path}/grid_search_results").count() == 2
    with pytest.raises(FileNotFoundError):
        ST.load_model(spark, f"{path}/models", tag="final")


def test_grids_in_one_folder_do_not_mix(spark, monkeypatch):
    """A stored cell is taken for the same axes and the same data only."""
    from lexicorn.plans import experiment as XP
    from lexicorn.session import shared_path
    path, plain, ran = shared_path(spark, "grid"), XP.train_cells, []
    monkeypatch.setattr(XP, "train_cells", lambda m, cells, *a, **k: ran.extend((m.order, c["lr"]) for c in cells)
                        or plain(m, cells, *a, **k))

    def search(**axes):
        ran.clear()
        grid = XP.param_grid(**{"lr": [0.5], "order": [2], "min_count": [1], "epochs": [1], "patience": [1], **axes})
        return XP.grid_search(spark, SF001, grid, max_new=2, results_dir=path).sort("run_id").collect()
    first = search()
    assert ran == [(2, 0.5)]
    other = search(lr=[1.0, 0.5])
    assert ran == [(2, 1.0)] and [r.lr for r in other] == [1.0, 0.5]
    assert other[1].asDict() | {"run_id": 1} == first[0].asDict() and other[0].final_val_perplexity != first[0].final_val_perplexity
    assert search(patience=[2])[0].run_id == 1 and ran == [(2, 0.5)]
    grid = XP.param_grid(lr=[0.5], order=[2], min_count=[1], epochs=[1], patience=[1])
    ran.clear()
    XP.grid_search(spark, SF001, grid, PL.Config(seed=7), max_new=2, results_dir=path)
    assert ran == [(2, 0.5)]


def test_cells_trained_together_equal_cells_trained_alone(spark, fitted):
    from lexicorn.plans import evaluate as EV
    from lexicorn.plans import experiment as XP
    _, enc = fitted
    voc = PL.corpus_vocab(spark, SF001)
    enc = enc.withColumn("holdout", F.pmod(F.xxhash64("row_id"), F.lit(10)) == 0)
    train, val, test = (enc.filter(F.col("split") == s) for s in ("train", "validation", "test"))
    counts = NG.ngram_counts(train.filter(~F.col("holdout")), 3)
    cells = [{"lr": lr, "epochs": e, "patience": p} for lr, e, p in ((.5, 1, 2), (1., 2, 9), (.0, 3, 1))]
    for order, min_count in ((1, 1), (2, 2), (3, 1)):
        alone = NG.fit(train.filter(~F.col("holdout")), order, 8192, min_count=min_count)
        base = NG.restricted(counts, order, 8192, min_count).materialize()
        assert sorted(map(str, alone.ngrams.collect())) == sorted(map(str, base.ngrams.collect()))
        if order != 3:
            continue
        got = XP.train_cells(base, cells, train.filter("holdout"), val, voc, max_new=3)
        for c, res in zip(cells, got):
            # one epoch after the other, by the operators for a single model
            model, history = alone.materialize(), []
            levels = NG.window_levels(model, train.filter("holdout"))
            for epoch in range(1, c["epochs"] + 1):
                lam, loss = NG.em_update(model, levels, lr=c["lr"])
                model = model.with_lambdas(lam)
                r = EV.evaluate_tokens(model, val, voc, max_new=3)[0].first()
                history.append({"epoch": epoch, "train_loss": loss, "val_perplexity": r.perplexity,
                                "val_rougeL": r.rouge_l, "weights": lam})
                at, stop = XP.early_stop_state([{**h, "val_rougeL": round(h["val_rougeL"], 12)} for h in history], c["patience"])
                if stop:
                    break
            assert len(res.history) == len(history) and res.best_epoch == at
            for x, y in zip(res.history, history):
                assert x["weights"] == pytest.approx(y["weights"], abs=1e-9)
                assert all(x[k] == pytest.approx(y[k], abs=1e-9) for k in ("train_loss", "val_perplexity", "val_rougeL"))
            assert res.model.lambdas == (res.history[at - 1]["weights"] if at else base.lambdas)


def test_jobs_do_not_grow_with_the_cells(spark, fitted):
    from lexicorn.plans import experiment as XP
    m, enc = fitted
    voc, sc, jobs = PL.corpus_vocab(spark, SF001), spark.sparkContext, []
    rows = enc.filter(F.col("split") == "test")
    m.materialize()
    for n in (1, 1, 6):  # the first run only warms up what is made once
        group = f"cells-{len(jobs)}"
        sc.setJobGroup(group, group)
        XP.train_cells(m, [{"lr": 1 / (k + 1), "epochs": 2, "patience": 9} for k in range(n)], rows, rows, voc, max_new=2)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(group)))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[2] <= jobs[1] + 4, jobs


def test_weights_need_greedy_rows_with_a_place(spark, fitted):
    m, enc = fitted
    prompts = enc.select(F.col("row_id").alias("seq_id"), F.col("ids").alias("prompt_ids"), F.lit(0).alias("cell"))
    for kw in ({"sampling": True, "draw_col": "cell"}, {}):
        with pytest.raises(ValueError):
            GE.generate(m, prompts, weights=[m.lambdas], **kw)


def test_a_version_is_given_once(spark):
    from concurrent.futures import ThreadPoolExecutor
    from lexicorn.session import shared_path
    from lexicorn.sources import store as ST
    folder = shared_path(spark, "versions")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: ST.claim(spark, folder, 1), range(24)))
    assert sorted(got) == list(range(1, 25))


def test_early_stop_table_equals_the_driver_rule(spark):
    import random
    from lexicorn.plans import experiment as XP
    rng = random.Random(1)
    runs = {r: [rng.choice([.1, .2, .2, .3, .4]) for _ in range(rng.randrange(1, 9))] for r in range(40)}
    df = spark.createDataFrame([(r, e, v) for r, vs in runs.items() for e, v in enumerate(vs, 1)],
                               "run_id int, epoch int, val_rougeL double")
    got = {r.run_id: (r.best_epoch, r.last_epoch) for r in XP.early_stop(df, 2).collect()}
    for r, vs in runs.items():
        hist = []
        for e, v in enumerate(vs, 1):
            hist.append({"epoch": e, "val_rougeL": v})
            best, stop = XP.early_stop_state(hist, 2)
            if stop:
                break
        assert got[r] == (best, len(hist))


def test_shared_tables_draw_what_a_sort_of_all_tokens_draws():
    """Ties, no continuations, only continuations, tiny temperatures, and uniforms at both ends."""
    import numpy as np
    from lexicorn.operators.distribution import PLACES
    rng = np.random.default_rng(3)
    lam, differ, drawn = [.1, .4, .3, .2], 0, 0
    for _ in range(800):
        size = int(rng.integers(1, 40))
        p1 = rng.integers(0, 4, size) / max(size, 1)
        m = int(rng.integers(0, size + 1))
        words = rng.choice(size, m, replace=False)
        probs = lam[0] / size + lam[1] * p1[words] + rng.random(m)
        t, top_p = float(rng.choice([1e-9, .05, .5, 1, 2])), float(rng.choice([1e-9, .3, .9, 1.0]))
        u = np.concatenate((rng.random(20), [0.0, 1 - 2 ** -53]))
        got = GE.SampledTokens(p1, lam, t, top_p).draw(words, probs, m > 0, u)
        p = lam[0] / size + (lam[1] if m else sum(lam[1:])) * p1
        p[words] = probs
        q = np.exp((np.log(p) - np.log(p).max()) / max(t, 1e-8))
        by = np.lexsort((np.arange(size), -p))
        kept = np.round(np.cumsum(q[by] / q.sum()), PLACES) <= top_p
        kept[0] = True
        ids, q = by[kept], q[by][kept]
        cdf = np.round(np.cumsum(q / q.sum()), PLACES)
        differ += int((got != ids[np.minimum(np.searchsorted(cdf, u, side="right"), len(ids) - 1)]).sum())
        drawn += len(u)
    assert (differ, drawn) == (0, 800 * 22)


def test_windows_equal_counting_by_hand(spark):
    """Level probabilities of positions and windows against dictionaries, contexts unseen included."""
    import collections
    train, test = [[3, 4, 5, 3, 4, 6], [4, 5, 3]], [[3, 4, 5, 9], [4, 6, 3, 4, 5], [7], [], [3, 4, 5, 9]]
    m = NG.fit(spark.createDataFrame([(r,) for r in train], "ids array<int>"), 3, 12).materialize()
    c, n = collections.Counter(), collections.Counter()
    for r in train:
        for j in range(1, len(r)):
            for k in range(1, min(3, j + 1) + 1):
                c[tuple(r[j - k + 1:j]), r[j]] += 1
                n[tuple(r[j - k + 1:j])] += 1
    want = []
    for i, r in enumerate(test):
        for j in range(1, len(r)):
            p, ps = 0.0, []
            for k in (1, 2, 3):
                h = tuple(r[max(0, j - k + 1):j])
                if len(h) == k - 1 and n[h]:
                    p = c[h, r[j]] / n[h]
                ps.append(p)
            want.append((i, j + 1, r[j], *ps))
    rows = spark.createDataFrame(list(enumerate(test)), "row_id long, ids array<int>")
    got = sorted(tuple(r) for r in NG.level_probabilities(m, rows).collect())
    assert got == [pytest.approx(w) for w in want]
    assert sum(r.n for r in NG.window_levels(m, rows).collect()) == len(want)

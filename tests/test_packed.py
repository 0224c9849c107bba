"""The buckets of a model against the operators that join its levels."""
import random

import pytest
from pyspark.sql import functions as F

from lexicorn.operators import generate as GE
from lexicorn.operators import ngram as NG
from lexicorn.operators import packed as PK


def _model(spark, order, min_count=1, seed=3):
    rng = random.Random(seed)
    rows = [[rng.choice([3, 3, 4, 5, 6, 7, 8, 1]) for _ in range(rng.randrange(0, 14))] for _ in range(80)]
    return NG.fit(spark.createDataFrame([(r,) for r in rows], "ids array<int>"), order, 12, min_count=min_count,
                  lambdas=[.1, .2, .3, .25, .15][:order + 1]).materialize()


@pytest.mark.parametrize("order,min_count", [(2, 1), (4, 1), (3, 2)])
def test_greedy_table_of_buckets_equals_the_joined_one(spark, order, min_count):
    m, bits = _model(spark, order, min_count), PK.bits_of(order)
    weights = [m.lambdas, [.4, .3, .1, .1, .1][:order + 1], [0.0, 0.0, 1.0, 0.0, 0.0][:order + 1]]
    top = GE.top_unigram(m)
    assert PK.top_unigram(m) == top
    got = {}
    for size, (keys, nxt) in PK.greedy_table(m, weights, top).items():
        assert keys.tolist() == sorted(keys.tolist())
        for key, tokens in zip(keys.tolist(), nxt.tolist()):
            got[tuple(key >> bits * i & (1 << bits) - 1 for i in reversed(range(size)))] = tokens
    assert got == {tuple(r.ctx): r.next for r in GE.successors_cells(m, weights, needed_only=True).collect()}
    assert PK.greedy_table(m, weights, top, limit=-1) is None


@pytest.mark.parametrize("order", [1, 3])
def test_whole_table_and_rounds_complete_alike(spark, monkeypatch, order):
    m, rng = _model(spark, order), random.Random(1)
    prompts = [(i, [rng.randrange(0, 14) for _ in range(rng.randrange(0, 6))], i % 2) for i in range(60)]
    prompts += [(3, [3, 4], 0), (60, None, 1), (61, [1 << 30, 3], 0), (62, [-5], 1)]
    df = spark.createDataFrame(prompts, "seq_id long, prompt_ids array<int>, cell int").repartition(3)
    other = [m.lambdas, [.05, .05, .1, .2, .6][:order + 1]]

    def made():
        return [sorted(map(str, GE.generate(m, df, max_new=n, eos_id=eos, **kw).collect()))
                for n, eos, kw in ((7, 1, {}), (3, None, {}), (0, 1, {}), (9, 1, {"draw_col": "cell", "weights": other}))]
    sc = spark.sparkContext
    GE.generate(m, df, max_new=1).collect()  # the buckets are made once
    sc.setJobGroup("whole", "whole")
    whole = made()
    n_whole = len(sc.statusTracker().getJobIdsForGroup("whole"))
    monkeypatch.setattr(PK, "WHOLE", -1)
    sc.setJobGroup("rounds", "rounds")
    assert made() == whole
    if order > 2:
        assert n_whole < len(sc.statusTracker().getJobIdsForGroup("rounds")) / 2
    sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("order,bucket", [(2, 1 << 19), (4, 4)])
def test_windows_of_buckets_equal_the_joined_ones(spark, monkeypatch, order, bucket):
    monkeypatch.setattr(PK, "BUCKET", bucket)
    m, rng = _model(spark, order), random.Random(4)
    rows = [[rng.randrange(0, 12) for _ in range(n)] for n in (0, 1, 2, 3, 8, 60)] + [None, [1 << 30, 4, 5], [3, 1 << 30, 3]]
    df = spark.createDataFrame(list(enumerate(rows)), "row_id int, ids array<int>")
    made = PK.window_levels(m, df)
    want = NG.window_levels(m, df)
    assert made.schema == want.schema or made.dtypes == want.dtypes
    assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))


def test_a_run_prepares_its_data_once(spark, monkeypatch):
    from conftest import SF001
    from lexicorn.plans import catalog
    from lexicorn.plans import experiment as XP
    plain, ran = XP.prepare, []
    monkeypatch.setattr(XP, "prepare", lambda *a, **k: ran.append(1) or plain(*a, **k))
    monkeypatch.setattr(catalog, "_GRID", XP.param_grid(lr=[0.5], order=[2], min_count=[1], epochs=[1], patience=[2]))
    assert catalog.QUERIES["training_run"](spark, SF001).count() >= 1 and ran == [1]


def test_texts_without_a_link_skip_its_pattern_and_others_do_not(spark):
    from lexicorn.functions import text as TX
    texts = [None, "", "Plain Words", "see HTTPS://a.b/c d", "http", "httpx://a", "www.x y", "www x", "@Bob hi", "a@b", "#Tag_1", "# x",
             "#@a", "ht#tp://x y", "\u212aWWW.x", "a  \x0b b\u00a0c"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")

    def every(c):
        t = TX.unwrap_hashtags(TX.strip_mentions(TX.strip_urls(F.lower(F.coalesce(F.col(c), F.lit(""))))))
        return TX.collapse_spaces(TX.drop_symbols_and_controls(t))
    assert all(r.a == r.b for r in df.select(TX.clean_text("t").alias("a"), every("t").alias("b")).collect())


def test_tokens_that_fit_no_key_are_joined(spark):
    rows = spark.createDataFrame([([-4, 3, -4, 3, 5],), ([7, 3, 5],)], "ids array<int>")
    m = NG.fit(rows, 3, 12).materialize()
    assert PK.pack(m) is None and PK.window_levels(m, rows) is None
    got = GE.generate(m, spark.createDataFrame([(1, [-4])], "seq_id long, prompt_ids array<int>"), max_new=2).first()
    assert got.gen_ids == [-4, 3, -4] or len(got.gen_ids) == 3


@pytest.mark.parametrize("order", [2, 4])
def test_draws_of_buckets_equal_draws_from_joined_lists(spark, monkeypatch, order):
    m, rng = _model(spark, order), random.Random(6)
    prompts = [(i, [rng.randrange(0, 12) for _ in range(rng.randrange(0, 6))]) for i in range(80)] + [(3, [3, 4]), (90, None), (91, [11])]
    df = spark.createDataFrame(prompts, "seq_id long, prompt_ids array<int>")

    def made(t, p, eos):
        return sorted(map(str, GE.generate(m, df, max_new=6, sampling=True, temperature=t, top_p=p, seed=7, eos_id=eos).collect()))
    cases = ((.8, .9, 1), (1.5, 1.0, None))
    got = [made(*x) for x in cases]
    monkeypatch.setattr(PK, "pack", lambda model: None)
    assert got == [made(*x) for x in cases]


def test_comparison_scores_each_completion_once(spark, monkeypatch):
    from conftest import SF001
    from lexicorn.plans import experiment as XP
    from lexicorn.plans import pipeline as PL
    cleaned, plain = [], PL.clean_docs
    monkeypatch.setattr(PL, "clean_docs", lambda *a: cleaned.append(1) or plain(*a))
    scores, examples = XP.compare_models(spark, SF001, max_new=2, decoders=("greedy",))
    assert cleaned == [1]
    plans = examples._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plans and "ArrowEvalPython" not in plans  # examples are read, not made again
    want = {r.model: r.m for r in examples.groupBy("model").agg(F.avg("rouge_l").alias("m")).collect()}
    assert {r.model: r.avg_rouge_l for r in scores.collect()} == pytest.approx(want)

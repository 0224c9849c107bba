"""Steps whose cost must not outgrow the input."""
import random
import time

from lexicorn.operators import rouge as RG


def test_native_lcs_is_bit_parallel_and_exact(spark):
    random.seed(3)
    rows = []
    for i in range(200):  # lengths around the 62 bits of a word
        some = "abcdefgh"[:random.randint(1, 8)]
        n, m = random.choice([0, 1, 5, 61, 62, 63, 124, 125, 200]), random.choice([0, 1, 30, 62, 63, 150])
        rows.append((i, [random.choice(some) for _ in range(n)], [random.choice(some + "xyz") for _ in range(m)]))
    for i in range(200, 240):  # long sides, which a table of all pairs of places would take minutes for
        rows.append((i, [random.choice("abcdefgh") for _ in range(1500)], [random.choice("abcdefgh") for _ in range(1500)]))
    start = time.monotonic()
    got = {x.i: x.l for x in spark.createDataFrame(rows, "i int, r array<string>, h array<string>")
           .select("i", RG.lcs_length_native("r", "h").alias("l")).collect()}
    assert time.monotonic() - start < 60
    assert got == {i: RG._lcs(r, h) for i, r, h in rows}


def test_encoding_holds_a_piece_of_a_batch(spark, monkeypatch):
    """Ids and texts do not depend on the pieces, and no piece passes its limit unless it is one row."""
    import numpy as np
    from pyspark.sql import functions as F
    from lexicorn.operators import vocab as VO
    rows = [(i, "ab cd é " * (i % 7) + "x" * (i % 40)) for i in range(300)] + [(300, None), (301, "")]
    texts = spark.createDataFrame(rows, "row_id int, text string").coalesce(1)
    voc = VO.learn_vocab(texts, 300)

    def both():
        enc = VO.encode(texts, voc, keep_text=True)
        return sorted(tuple(map(str, r)) for r in VO.decode(enc, voc).collect())
    whole = both()
    monkeypatch.setattr(VO, "PIECE", 16)
    assert both() == whole
    assert all(r[3] == ("" if r[1] == "None" else r[1]) for r in whole)
    parts = list(VO._pieces(np.array([5, 5, 9, 40, 1, 1]), np.array([0, 2, 3, 3, 4, 6]), 16))
    assert parts == [(0, 1), (1, 2), (3, 1), (4, 1)]


def test_vocabulary_splits_the_corpus_once(spark):
    """The word counts are a written table: no plan of the vocabulary splits the texts again."""
    from lexicorn.operators import vocab as VO
    voc = VO.learn_vocab(spark.createDataFrame([("low lower low é",)], "text string"), 300)
    plan = voc._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(regexp_extract_all(text" not in plan.lower().replace("#", "")
    assert plan.lower().count("generate explode") == 1  # characters, of the distinct words


def test_counts_are_made_from_distinct_windows(spark):
    from collections import Counter
    from lexicorn.operators import ngram as NG
    random.seed(5)
    texts = [[random.randint(0, 4) for _ in range(n)] for n in (0, 1, 2, 3, 7, 200)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "row_id int, ids array<int>")
    for order in (1, 2, 3, 4):
        want, wins = Counter(), Counter()
        for s in texts:
            for j in range(1, len(s or [])):
                wins[tuple(s[max(0, j - order + 1):j + 1])] += 1
                for k in range(1, min(order, j + 1) + 1):
                    want[k, tuple(s[j - k + 1:j]), s[j]] += 1
        counts = NG.ngram_counts(rows, order)
        assert {(r.k, tuple(r.ctx), r.w): r.c for r in counts.collect()} == want
        counted = NG.window_counts(rows, order).collect()
        assert {tuple(t for t in r[:-1] if t != NG.BEFORE): r.n for r in counted} == wins


def test_probabilities_of_ngrams_are_joined_once_for_all_weights(spark):
    from lexicorn.operators import generate as GE, ngram as NG
    rows = spark.createDataFrame([(0, [5, 6, 7, 5, 6, 8, 5, 6, 7, 1]), (1, [6, 7, 9, 6, 7, 5, 1])], "row_id int, ids array<int>")
    m = NG.fit(rows, 3, 12).materialize()
    first = GE.successors(m).collect()
    tables = m.gram_levels()
    GE.successors(m.with_lambdas([0.1, 0.2, 0.3, 0.4]))
    assert m.gram_levels() is tables and m.with_lambdas([0.25] * 4).gram_levels() is tables
    full = {tuple(r.ctx): r.next for r in first}
    short = {tuple(r.ctx): r.next[0] for r in GE.successors_cells(m, [m.lambdas], needed_only=True).collect()}
    assert len(short) < len(full)

    def longest(table, ctx):
        while ctx and ctx not in table:
            ctx = ctx[1:]
        return table.get(ctx, GE.top_unigram(m))
    assert {c: longest(short, c) for c in full} == full


def test_scores_from_lists_equal_scores_of_rows(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from lexicorn.operators import generate as GE, ngram as NG
    random.seed(9)
    rows = spark.createDataFrame([(i, [random.randint(0, 6) for _ in range(30)]) for i in range(5)], "row_id int, ids array<int>")
    m = NG.fit(rows, 3, 9, lambdas=[0.1, 0.2, 0.3, 0.4]).materialize()
    cks = [[a, b] for a in range(3) for b in range(8)] + [[4], [8]]
    dc = spark.createDataFrame([(c,) for c in cks], "ck array<int>")
    want = {}
    for r in GE.score_candidates(m, dc, None).collect():
        want.setdefault(tuple(r.ck), {})[r.w] = r.p
    lists = GE.continuation_lists(m)
    got = (lists.join(GE._levels(dc, 3), "ctx").groupBy("ck")
           .agg(F.collect_list(F.struct("k", "words", "counts", "total")).alias("levels")).collect())
    p1 = GE._background(m)
    made = {}
    for r in got:
        words, probs, seen = GE.merged_scores(p1, m.lambdas, r.levels)
        made[tuple(r.ck)] = dict(zip(words.tolist(), probs.tolist()))
        assert seen == any(x.k == 2 for x in r.levels)
    assert made == want
    assert GE.merged_scores(p1, m.lambdas, [])[0].shape == (0,)


def test_texts_are_dealt_to_all_tasks(spark, tmp_path):
    from lexicorn.plans import pipeline as PL
    texts = spark.range(100).selectExpr("id row_id", "cast(id as string) text").coalesce(1)
    dealt = PL.spread(texts)
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(dealt.collect()) == sorted(texts.collect())

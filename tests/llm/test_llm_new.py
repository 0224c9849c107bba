"""Substring dedup, hard negatives, whitening against brute force; SimHash at many partitions."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicorn.llm import hard_negatives, simhash, substring_dedup, whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ substring dedup

def _brute_removed(texts, width):
    docs = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i:i + width]) for w in docs for i in range(len(w) - width + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] > 1:
                gone[i:i + width] = [True] * width
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def _passages(seed, n=90):
    """Texts with shared passages of all lengths, copies, overlaps, repeats inside a text, loops."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    text = lambda k: [rng.choice(words) for _ in range(k)]
    shared = [text(rng.randrange(3, 60)) for _ in range(8)]
    out = []
    for _ in range(n):
        w = text(rng.randrange(0, 50))
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p))
            w += p[a:a + rng.randrange(1, 60)] + text(rng.randrange(0, 12))
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    out += [out[3]] * 5 + ["a " * 200, "a b " * 80, "", None, "x", "    é", " ".join(shared[0] * 3)]
    return out


@pytest.mark.parametrize("width,anchor", [(35, 8), (12, 4), (5, 1), (4, 4)])
def test_repeats_equal_brute_force(spark, width, anchor):
    texts = _passages(width)
    df = spark.createDataFrame([(k, t, "s", "n") for k, t in enumerate(texts)],
                               "doc_id long, text string, spans string, ID string").repartition(5)
    out = substring_dedup.remove_repeats(df, width=width, anchor=anchor)
    assert out.columns == ["doc_id", "ID", *substring_dedup.OUT]
    got = {r["doc_id"]: r for r in out.collect()}
    want = _brute_removed(texts, width)
    assert [(got[k]["n_words"], got[k]["n_removed"], got[k]["kept"]) for k in range(len(texts))] == want
    assert all(sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got.values())
    assert any(w[1] for w in want) and any(not w[1] for w in want)


def test_repeats_of_equal_rows_null_keys_and_long_texts(spark):
    rng = random.Random(2)
    long = " ".join(f"u{rng.randrange(10 ** 9)}" for _ in range(60_000))
    rows = [(1, "p q r s t u v w"), (1, "p q r s t u v w"), (None, "a b c d e f"), (None, None), (7, long),
            (8, " ".join(long.split()[30_000:30_100]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = substring_dedup.remove_repeats(df, width=5, anchor=2).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in out) == sorted(
        [(1, 8, 8), (1, 8, 8), (0, 6, 0), (0, 0, 0), (7, 60_000, 100), (8, 100, 100)])
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(df, width=5, anchor=6)


def test_stretches_tile_the_windows():
    rng = np.random.default_rng(0)
    hashes, ends = rng.integers(0, 5, 400).astype(np.uint64), np.array([0, 90, 95, 250, 400])
    s = substring_dedup.stretches(hashes, ends, 9, 3)
    starts = np.append(0, ends[:-1])
    for k, (a, b) in enumerate(zip(starts, ends)):
        own = [(x, n) for t, x, n in zip(s["text"], s["start"], s["n"]) if t == k]
        assert [w for x, n in own for w in range(x, x + n)] == list(range(max(0, b - a - 8)))
    assert (s["next"] != 0).sum() == len(s["n"]) - len({*s["text"].tolist()})


# ------------------------------------------------------------------ hard negatives

def _brute_negatives(rows, anchors, positives=5, negatives=5, percent=80):
    ok = [(k, i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for k, (i, lab, v) in enumerate(rows)
          if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = lambda i: hard_negatives.LAST_ID if i is None else i
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, i, lab, v in ok:
        if i is None or not anchors(i):
            continue
        scored = sorted(((-dot(v, w), last(j), m, l2) for m, j, l2, w in ok if m != k))
        for p in [x for x in scored if x[3] == lab][:positives]:
            inside = [x for x in scored if x[3] != lab and -percent * p[0] <= -100 * x[0] <= -100 * p[0]]
            out += [(i, p[1], r, x[1], -p[0], -x[0]) for r, x in enumerate(inside[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows,anchor_rows", [(4096, 512), (16, 3)])
def test_negatives_equal_brute_force(spark, block_rows, anchor_rows):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(3, 6))
    rows = []
    for k in range(220):
        lab = int(rng.integers(0, 3))
        v = (centre[lab] * .4 + centre[0] * .5 + rng.normal(size=6) * .3).astype(np.float32).tolist()
        rows.append((k, lab, v))
    rows += [rows[10], rows[12], (300, 1, [0.0] * 6), (301, None, rows[0][2]), (310, 1, None), (320, 2, [1.0, None] + [0.0] * 4),
             (330, 0, [float("nan")] * 6), (340, 0, [float("inf")] + [0.0] * 5), (None, 1, rows[3][2]), (350, 2, [0.5, 0.25]),
             (360, 2, []), *[(400 + k, k % 2, rows[20][2]) for k in range(30)]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, top string")
    got = hard_negatives.mine(df.repartition(4), anchors=F.col("vec_id") % 10 == 0, block_rows=block_rows, anchor_rows=anchor_rows)
    got = sorted((r["anchor_id"], hard_negatives.LAST_ID if r["positive_id"] is None else r["positive_id"], r["rank"],
                  hard_negatives.LAST_ID if r["negative_id"] is None else r["negative_id"], r["positive_score"], r["negative_score"])
                 for r in got.collect())
    want = _brute_negatives(rows, lambda i: i % 10 == 0)
    key = lambda r: (r[0], r[4], r[2], r[5])  # rows of one id are interchangeable
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(want) > 100
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_anchors_come_in_waves_and_are_never_copied_for_each_block(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, k % 3, rng.normal(size=4).astype(np.float32).tolist()) for k in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    made, plain = {}, hard_negatives.materialize

    def materialize(frame, name, *a):
        out = plain(frame, name, *a)
        made.setdefault(name, []).append((out, frame._jdf.queryExecution().optimizedPlan().toString()))
        return out
    monkeypatch.setattr(hard_negatives, "materialize", materialize)
    monkeypatch.setattr(hard_negatives, "WAVE", 1)
    monkeypatch.setattr(hard_negatives, "MERGE", 2)
    got = hard_negatives.mine(df, anchors=F.col("vec_id") % 5 == 0, block_rows=20, anchor_rows=4)
    key = lambda r: (r[0], r[4], r[2], r[5])
    assert sorted(key(tuple(r)) for r in got.collect()) == sorted(map(key, _brute_negatives(rows, lambda i: i % 5 == 0)))
    # an anchor's vector is held once a pass, and no step joins anchors to blocks
    assert sum(f.count() for f, _ in made["negatives-anchors"]) <= 2 * 8
    assert len(made["negatives-found"]) == 2 * 8  # one for each wave of one anchor block
    assert all("Join" not in plan and "Generate" not in plan for _, plan in made["negatives-found"])
    assert all(f.groupBy("anchor", "top").count().agg(F.max("count")).first()[0] <= 5 * f.rdd.getNumPartitions()
               for f, _ in made["negatives-found"] if not f.isEmpty())


def test_sorted_access_stops_early_and_at_ties():
    x = np.zeros((512, 2), np.int64)
    x[:, 0] = np.arange(512)
    lists, places = hard_negatives.sorted_lists(x)
    ids, allowed = np.arange(512), np.ones(512, bool)
    found, _, depth = hard_negatives.threshold_search(np.array([3, 0]), x, lists, places, ids, allowed, [(None, None)], 5)
    assert found[0].tolist() == [511, 510, 509, 508, 507] and depth < 64
    found, _, depth = hard_negatives.threshold_search(np.array([-1, 0]), x, lists, places, ids, allowed, [(-9, -4)], 5)
    assert found[0].tolist() == [4, 5, 6, 7, 8] and depth < 64
    same = np.ones((512, 2), np.int64)
    lists, places = hard_negatives.sorted_lists(same)
    found, _, depth = hard_negatives.threshold_search(np.array([1, 1]), same, lists, places, ids[::-1].copy(), allowed, [(None, None)], 2)
    assert found[0].tolist() == [511, 510] and depth == 512  # no strict fall: every tie is read


# ------------------------------------------------------------------ whitening

def _brute_whitening(vectors, components):
    dims = max(map(len, vectors))
    x = np.array([[*(int(np.floor(64 * float(np.float32(c)))) + 10 ** 6 for c in v), *[10 ** 6] * (dims - len(v))] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = (fit * n - s) / n
    w, u = np.linalg.eigh(centred.T @ centred / n)
    w, u = w[::-1], u[:, ::-1]
    return n, ((x * n - s) ** 2).sum(1), np.abs(((x * n - s) / n) @ u[:, :components]), w


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(150, 7)) * np.arange(1, 8)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 60 + [vectors[1][:5]]
    bad = [None, [float("nan")] * 7, [float("inf")] + [0.0] * 6, [None] + [0.0] * 6]
    rows = [(k % 100, v, "x", 1) for k, v in enumerate(vectors)] + [(None, v, "x", 1) for v in bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, index string, N int").repartition(6)
    out = whitening.whiten(df, components=4)
    assert out.columns == ["vec_id", "index", *whitening.OUT]
    got = out.collect()
    n, deviation, projected, w = _brute_whitening(vectors, 4)
    assert len(got) == 4 * len(vectors) and {r["n"] for r in got} == {n}
    want = sorted((k % 100, c + 1, int(deviation[k]), round(projected[k, c] / w[c] ** .5, 6)) for k in range(len(vectors)) for c in range(4))
    assert sorted((r["vec_id"], r["component"], r["deviation"], round(abs(r["whitened"]), 6)) for r in got) == want
    assert all(abs(r["explained"] - w[r["component"] - 1] / w.sum()) < 1e-9 and r["identity_error"] < 1e-9 for r in got)


def test_whitening_of_flat_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0]), (3, [1.0, 2.0, 0.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(df).collect()
    assert sorted({r["component"] for r in got}) == [1, 2, 3] and {r["n"] for r in got} == {2}
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-9 for r in got)
    assert all(abs(abs(r["whitened"]) - 1) < 1e-9 for r in got if r["component"] == 1)
    for few in (df.limit(0), df.select("vec_id", F.array().cast("array<double>").alias("embedding"))):
        empty = whitening.whiten(few)
        assert empty.columns == ["vec_id", *whitening.OUT] and empty.count() == 0


# ------------------------------------------------------------------ SimHash

def test_links_and_stars_do_not_depend_on_sections_or_partitions(spark):
    rng = random.Random(8)
    prints = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(12):  # a chain, and a near-copy group around its start
            prints |= {x, x ^ (1 << rng.randrange(64))}
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    ordered = sorted(prints)
    up = {p: p for p in ordered}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 3:
                up[max(find(a), find(b))] = min(find(a), find(b))
    want = {frozenset(p for p in ordered if find(p) == r) for r in ordered if find(r) == r}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in ordered}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for sections, partitions, edge_rows in ((2, 8, 1 << 19), (4, 8, 1 << 19), (2, 211, 40)):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            df = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
            edges = simhash.links(df, 3, 64, sections=sections)
            root = {r["node"]: r["root"] for r in simhash.components(edges, edge_rows).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        groups = {}
        for p, s in signed.items():
            groups.setdefault(root.get(s, s), set()).add(p)
        assert {frozenset(g) for g in groups.values()} == want

"""A model's n-grams in buckets by the last token of their context.

All contexts that end in one token stand in one bucket, and so does every shorter context that
they back off to: level probabilities, greedy next tokens and the levels of windows are made
bucket by bucket with arrays, without a join between the levels. A bucket is one row of the
written table, with some hundred thousand n-grams; a token whose contexts have more is a
bucket of its own size. A context is one whole number, its last token in the lowest bits.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicorn.operators import ngram as NG
from lexicorn.session import write_once

#: n-grams of a bucket, about
BUCKET = 1 << 19
#: bytes of a table of greedy next tokens that tasks may get whole
WHOLE = 96 << 20


def bits_of(order: int) -> int:
    """Bits of a token in a key: all tokens of a context must fit 62."""
    return min(31, 62 // max(order - 1, 1))


@dataclass
class Packed:
    table: DataFrame        # (bucket, grams): one row a bucket
    buckets: int
    words: np.ndarray       # the unigrams' ids, rising
    p1: np.ndarray          # their probabilities


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values (null: -1) and offsets of a list column."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = pc.fill_null(a.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False))).astype(np.int64)


def _keys(flat: np.ndarray, ends: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Keys of the ``size`` tokens that end before each place ``ends`` of ``flat``."""
    key = np.zeros(len(ends), np.int64)
    for i in range(size):
        key |= flat[ends - 1 - i] << np.int64(bits * i)
    return key


def bucket(last, buckets: int):
    return F.pmod(F.xxhash64(last.cast("int")), F.lit(buckets))


def _pack(order: int, bits: int):
    def run(rows: pa.Table) -> pa.Table:
        k, w, c = (rows.column(x).to_numpy() for x in ("k", "w", "c"))
        flat, offsets = _lists(rows.column("ctx"))
        arrays = {}
        for n in range(2, order + 1):
            at = np.flatnonzero(k == n)
            key = _keys(flat, offsets[at + 1], n - 1, bits)
            by = np.lexsort((w[at], key))
            arrays |= {f"key{n}": key[by], f"w{n}": w[at][by].astype(np.int32), f"c{n}": c[at][by].astype(np.int64)}
        out = io.BytesIO()
        np.savez(out, **arrays)
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), "grams": pa.array([out.getvalue()], pa.binary())})
    return run


def pack(model: NG.NGramModel) -> Packed | None:
    """The model's buckets, made once; none if its tokens do not fit their bits."""
    if not model.packed:
        model.materialize()
        N, bits = model.order, bits_of(model.order)
        grams = model.ngrams.filter(F.col("k") >= 2)
        seen = grams.agg(F.count("*").alias("n"), F.min(F.least(F.col("w"), F.array_min("ctx"))).alias("low"),
                         F.max(F.greatest(F.col("w"), F.array_max("ctx"))).alias("high"),
                         F.count_if(F.col("w").isNull() | F.exists("ctx", lambda t: t.isNull())).alias("odd")).first()
        fits = N >= 2 and bits >= 8 and not seen["odd"] and (seen["n"] == 0 or (seen["low"] >= 0 and seen["high"] < 1 << bits))
        if not fits:
            model.packed["none"] = None
        else:
            parts = int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            buckets = max(parts, -(-seen["n"] // BUCKET))
            made = (grams.withColumn("bucket", bucket(F.element_at("ctx", -1), buckets))
                    .groupBy("bucket").applyInArrow(_pack(N, bits), "bucket long, grams binary"))
            uni = sorted((r["w"], r["c1"]) for r in model.unigrams.collect())
            n1 = float(max(NG.unigram_total(model), 1))
            model.packed["whole"] = Packed(write_once(made.repartition(parts)), buckets,
                                           np.array([w for w, _ in uni], np.int64),
                                           np.array([c for _, c in uni], np.float64) / n1)
    return model.packed.get("whole")


class Unigrams:
    def __init__(self, words: np.ndarray, p1: np.ndarray):
        self.words, self.p1 = words, p1

    def unigram(self, w: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(w))
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, self.p1[at], 0.0)


class Levels(Unigrams):
    """The levels of one bucket: contexts with their totals, n-grams with p1..pk."""

    def __init__(self, grams: bytes, order: int, bits: int, words: np.ndarray, p1: np.ndarray):
        super().__init__(words, p1)
        self.bits = bits
        self.contexts, self.first, self.pairs, self.w, self.p = {}, {}, {}, {}, {}
        with np.load(io.BytesIO(grams)) as z:
            for k in range(2, order + 1):
                key, w, c = z[f"key{k}"], z[f"w{k}"].astype(np.int64), z[f"c{k}"].astype(np.float64)
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
                sizes = np.diff(np.append(first, len(key)))
                self.contexts[k], self.first[k], self.w[k] = key[first], first, w
                total = np.add.reduceat(c, first) if len(key) else c
                self.pairs[k] = np.repeat(np.arange(len(first), dtype=np.int64), sizes) << np.int64(31) | w
                lower = [self.unigram(w)] if k == 2 else self.levels(k - 1, self.short(key, k - 1), w)[0]
                self.p[k] = [*lower, c / np.repeat(total, sizes)]

    def short(self, key: np.ndarray, k: int) -> np.ndarray:
        """The contexts of level ``k`` that these end in."""
        return key & np.int64((1 << self.bits * (k - 1)) - 1)

    def at(self, k: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of contexts of level ``k``, and whether they were seen."""
        have = self.contexts[k]
        if not len(have):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(have, key), len(have) - 1)
        return at, have[at] == key

    def levels(self, k: int, key: np.ndarray, w: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """p1..pk of tokens after contexts of level ``k``: an unseen context takes the level below."""
        lower = [self.unigram(w)] if k == 2 else self.levels(k - 1, self.short(key, k - 1), w)[0]
        at, seen = self.at(k, key)
        pairs, want = self.pairs[k], at << np.int64(31) | w
        if not len(pairs):
            return [*lower, lower[-1]], seen
        here = np.minimum(np.searchsorted(pairs, want), len(pairs) - 1)
        own = np.where(pairs[here] == want, self.p[k][-1][here], 0.0)
        return [*lower, np.where(seen, own, lower[-1])], seen


# ------------------------------------------------------------------ greedy next tokens

def _best(z: Levels, order: int, lams: list[list[float]], size: float, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(tokens of a context, keys, next by weight vector) of the contexts whose next tokens differ
    from those of the next shorter one; see `generate.successors_cells` for the rule."""
    p_top = float(z.unigram(np.array([top]))[0])
    before: tuple | None = None
    for k in range(2, order + 1):
        w, first = z.w[k], z.first[k]
        if not len(first):
            return
        sizes, p = np.diff(np.append(first, len(w))), z.p[k]
        if k == 2:
            at, seen = np.zeros(len(first), np.int64), np.ones(len(first), bool)
        else:
            at, seen = z.at(k - 1, z.short(z.contexts[k], k - 1))
        partial, best, up = [], [], []
        for i, lam in enumerate(lams):
            def score(up_to: int) -> np.ndarray:
                s = lam[0] / size + lam[1] * p[0]
                for m in range(2, up_to + 1):
                    s = s + lam[m] * p[min(m, k) - 1]
                return s

            def greatest(s: np.ndarray, from_short: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                most = np.maximum.reduceat(s, first)
                who = np.minimum.reduceat(np.where(s == np.repeat(most, sizes), w, np.int64(1) << 40), first)
                other = seen & ((from_short > most) | ((from_short == most) & (token < who)))
                return np.where(other, from_short, most), np.where(other, token, who)
            if before is None:
                from_short, token = np.full(len(first), lam[0] / size + lam[1] * p_top), np.full(len(first), top)
                up.append(token)
            else:
                from_short, token = before[0][i][0][at], before[0][i][1][at]
                up.append(np.where(seen, before[1][i][at], -1))
            partial.append(greatest(score(k), from_short, token))
            best.append(greatest(score(order), from_short, token)[1])
        differ = np.any([a != b for a, b in zip(up, best)], axis=0)
        yield k - 1, z.contexts[k][differ], np.stack([b[differ] for b in best], axis=1)
        before = (partial, best)


def greedy_table(model: NG.NGramModel, weights: list[list[float]], top: int, limit: int | None = None) -> dict | None:
    """{tokens of a context: (keys, next by weight vector)}, the keys rising: the needed rows of
    `generate.successors_cells`, in one job without a shuffle. None if there are more than
    ``limit`` bytes of them, or if the model has no buckets."""
    packed, N, V, bits = pack(model), model.order, float(model.vocab_size), bits_of(model.order)
    if packed is None:
        return None
    lams, words, p1 = [[float(x) for x in lam] for lam in weights], packed.words, packed.p1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams in (g for b in batches for g in b.column(0)):
            for size, keys, nxt in _best(Levels(grams.as_py(), N, bits, words, p1), N, lams, V, top):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), size, np.int32)), pa.array(keys),
                                                  *(pa.array(x.astype(np.int32)) for x in nxt.T)], names=names)
    names = ["size", "key", *(f"next{i}" for i in range(len(lams)))]
    schema = ", ".join(f"{x} {'long' if x == 'key' else 'int'}" for x in names)
    made = write_once(packed.table.select("grams").mapInArrow(run, schema))
    if made.count() * (8 + 4 * len(lams)) > (WHOLE if limit is None else limit):
        return None
    got = made.toArrow()
    size, key = got.column("size").to_numpy(), got.column("key").to_numpy()
    nxt = np.stack([got.column(x).to_numpy() for x in names[2:]], axis=1)
    out = {}
    for s in range(1, N):
        at = np.flatnonzero(size == s)
        by = at[np.argsort(key[at], kind="stable")]
        out[s] = (key[by], nxt[by])
    return out


def walk(table, order: int, top: int, max_new: int, eos_id: int | None):
    """Batches with prompt_ids and _cell in their last two columns to the other columns,
    prompt_ids and the new tokens: all rounds of a row at once."""
    n, bits = order - 1, bits_of(order)

    def grown(prompts, cell: np.ndarray, known: dict) -> pa.ListArray:
        flat, offsets = _lists(prompts)
        rows = np.flatnonzero(np.diff(offsets) > 0)
        lengths = np.diff(offsets)[rows]
        last = np.full((len(rows), max(n, 1)), -1, np.int64)  # the last tokens, the newest first
        for i in range(n):
            has = lengths > i
            last[has, i] = flat[offsets[rows[has] + 1] - 1 - i]
        new, made = np.zeros((len(rows), max(max_new, 0)), np.int32), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        for rnd in range(max_new):
            if not len(live):
                break
            state, nxt, open_ = last[live], np.full(len(live), top, np.int64), np.ones(len(live), bool)
            fits = (state >= 0) & (state < 1 << bits)
            for size in range(n, 0, -1):  # the longest context in the table
                keys, tokens = known[size]
                ask = np.flatnonzero(open_ & fits[:, :size].all(axis=1))
                if not len(keys) or not len(ask):
                    continue
                key = _state_key(state[ask], size, bits)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[at] == key
                nxt[ask[hit]] = tokens[at[hit], cell[rows[live[ask[hit]]]]]
                open_[ask[hit]] = False
            new[live, rnd] = nxt
            made[live] += 1
            if n:
                last[live] = np.concatenate([nxt[:, None], state[:, :n - 1]], axis=1)
            if eos_id is not None:
                live = live[nxt != eos_id]
        counts = np.zeros(len(prompts), np.int64)
        counts[rows] = made
        keep = np.arange(new.shape[1])[None, :] < made[:, None]
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(new[keep]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for b in batches:
            cell = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], grown(b.column(b.num_columns - 2), cell, known)],
                                             names=[*b.schema.names[:-1], "new"])
    return run


def top_unigram(model: NG.NGramModel) -> int | None:
    """The most frequent token, of equal ones the lowest id; None without buckets or tokens."""
    packed = pack(model)
    return None if packed is None or not len(packed.words) else int(packed.words[np.argmax(packed.p1)])


def _state_key(state: np.ndarray, size: int, bits: int) -> np.ndarray:
    key = np.zeros(len(state), np.int64)
    for i in range(size):
        key |= state[:, i] << np.int64(bits * i)
    return key


# ------------------------------------------------------------------ sampled next tokens

def draw(sampler, names: list[str], order: int):
    """The live rows of a bucket and its n-grams to the rows with their next token. ``sampler`` holds
    (`generate.SampledTokens`, unigram probabilities, weights); a done row gets no token."""
    bits = bits_of(order)

    def run(rows: pa.Table, grams: pa.Table) -> pa.Table:
        shared, p1, lam = sampler.value
        flat, offsets = _lists(rows.column("ck"))
        u, done = rows.column("u").to_numpy(), rows.column("done").to_numpy()
        live, nxt = np.flatnonzero(~done), np.zeros(rows.num_rows, np.int32)
        z = {}
        if grams.num_rows and len(live):
            with np.load(io.BytesIO(grams.column("grams")[0].as_py())) as packed:
                z = {x: packed[x] for x in packed.files}
        state = np.full((len(live), order - 1), -1, np.int64)  # the newest token first
        for i in range(order - 1):
            has = offsets[live + 1] - offsets[live] > i
            state[has, i] = flat[offsets[live[has] + 1] - 1 - i]

        def seen(k: int, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
            """(words, p_k) of a context of level ``k``, the newest token first."""
            if not z or not ((tokens >= 0) & (tokens < 1 << bits)).all():
                return None
            key = _state_key(tokens[None, :], k - 1, bits)[0]
            lo, hi = np.searchsorted(z[f"key{k}"], key, "left"), np.searchsorted(z[f"key{k}"], key, "right")
            counts = z[f"c{k}"][lo:hi]
            return (z[f"w{k}"][lo:hi].astype(np.int64), counts.astype(np.float64) / float(counts.sum())) if hi > lo else None
        by = np.lexsort(state.T[::-1])  # by the newest token first
        ordered = state[by]
        starts = np.flatnonzero(np.append(True, (ordered[1:] != ordered[:-1]).any(axis=1))) if len(by) else []
        last, tables, p2, base = None, {}, None, None
        for lo, hi in zip(starts, [*starts[1:], len(by)]):
            tokens, at = ordered[lo], live[by[lo:hi]]
            if last is None or tokens[0] != last:  # tables for all contexts that end in this token
                last, tables, found = tokens[0], {}, seen(2, tokens[:1])
                if found is not None:
                    p2 = np.zeros(len(p1))
                    p2[found[0]] = found[1]
                    base = lam[0] / len(p1) + lam[1] * p1 + lam[2] * p2
                else:
                    p2 = None
            if p2 is None:
                nxt[at] = shared.draw_from(shared.shared[False], None, None, u[at])
                continue
            longer = {k: x for k in range(3, order + 1) if (x := seen(k, tokens[:k - 1])) is not None}
            if bool(longer) not in tables:
                whole = base
                for k in range(3, 3 if longer else order + 1):  # an unseen level takes the level below
                    whole = whole + lam[k] * p2
                tables[bool(longer)] = shared.table(whole)
            words = probs = None
            if longer:
                words = np.unique(np.concatenate([w for w, _ in longer.values()]))
                p, probs = p2[words], base[words]
                for k in range(3, order + 1):
                    if k in longer:
                        p = np.zeros(len(words))
                        p[np.searchsorted(words, longer[k][0])] = longer[k][1]
                    probs = probs + lam[k] * p
            nxt[at] = shared.draw_from(tables[bool(longer)], words, probs, u[at])
        return pa.table([*(rows.column(x) for x in names), pa.array(nxt, mask=done)], names=[*names, "next"])
    return run


# ------------------------------------------------------------------ windows

def window_levels(model: NG.NGramModel, df: DataFrame, ids_col: str = "ids") -> DataFrame | None:
    """`ngram.window_levels` bucket by bucket: a window meets the n-grams of the bucket of the
    token before its last; None if the model has no buckets."""
    packed, N, bits = pack(model), model.order, bits_of(model.order)
    if packed is None:
        return None
    words, p1 = packed.words, packed.p1
    tokens = [f"t{k}" for k in range(1, N + 1)]
    wins = NG.window_counts(df, N, ids_col)
    wins = wins.withColumn("bucket", bucket(F.col(f"t{N - 1}"), packed.buckets))

    def run(rows: pa.Table, grams: pa.Table) -> pa.Table:
        t = [pc.fill_null(rows.column(x), NG.BEFORE).to_numpy().astype(np.int64) for x in tokens]
        lowest, w = 1 << bits, t[-1]
        z = Levels(grams.column("grams")[0].as_py(), N, bits, words, p1) if grams.num_rows else None
        p = [(z or Unigrams(words, p1)).unigram(w)]
        for k in range(2, N + 1):
            if z is None:
                p.append(p[-1])
                continue
            ctx = t[N - k:N - 1]
            fits = np.all([(x >= 0) & (x < lowest) for x in ctx], axis=0) & (w >= 0) & (w < 1 << 31)
            key = np.zeros(len(w), np.int64)
            for i, x in enumerate(reversed(ctx)):
                key |= np.where(fits, x, 0) << np.int64(bits * i)
            at, seen = z.at(k, key)
            seen = seen & fits
            want = at << np.int64(31) | np.where(fits, w, 0)
            here = np.minimum(np.searchsorted(z.pairs[k], want), max(len(z.pairs[k]) - 1, 0))
            own = np.where(z.pairs[k][here] == want, z.p[k][-1][here], 0.0) if len(z.pairs[k]) else np.zeros(len(w))
            p.append(np.where(seen, own, p[-1]))
        return pa.table([rows.column(x) for x in tokens] + [rows.column("n")] + [pa.array(x) for x in p],
                        names=tokens + ["n"] + [f"p{k}" for k in range(1, N + 1)])
    schema = ", ".join([f"{x} int" for x in tokens] + ["n long"] + [f"p{k} double" for k in range(1, N + 1)])
    made = wins.groupBy("bucket").cogroup(packed.table.groupBy("bucket")).applyInArrow(run, schema)
    win = F.filter(F.array(*tokens), lambda t: ~t.eqNullSafe(F.lit(NG.BEFORE)))
    return made.select(win.alias("win"), F.col(f"t{N}").alias("w"), "n", *[f"p{k}" for k in range(1, N + 1)])

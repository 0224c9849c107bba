"""Operator 2: quality classifier by co-training.

Two views of a document: its text (words, and the shape of the text) and its metadata
(source, language, length). Each view has a logistic classifier, fitted at first on labelled
documents. In every round one Spark job scores all unlabelled documents with both calibrated
views. Each document that a view is confident about becomes a row of the other view, with the
label the first one gave it: its gradient and a bound of its curvature are added up per
feature, in the tasks and then by a grouped sum, so only sums reach the driver. The driver
fits each view again on its labelled rows plus a quadratic that lies above the loss of those
pseudo-labelled rows (the bound of Jaakkola and Jordan, made diagonal by the row's number of
features), which never raises the joint loss. No document is left out, whatever their number.
Afterwards each view is calibrated on held-out labelled rows, the calibrated views are
combined by a further logistic fit on the same rows, and all documents are scored. A document
is good if its label says quality 1 and toxic 0.

Bounds, all of them parameters of the model: fitting reads at most ``max_labelled`` labelled
documents, taken by the smallest hash of the id, and the text view has the ``max_features``
features that tell the classes of those best apart; metadata features are hashed into 2**20.
Texts are read whole, once: their features are written beside the rows, and rounds and scores
read those.

Defined cases: several labels of one document = the worst of each; null labels are
not used, and a document without id counts as unlabelled; null text = empty text, null metadata = a value of its own; repeated
rows are scored each; if the labels lack one of the two classes nothing can be learned, and
every document gets score 1; an empty table gives an empty result; input columns named like
an output column are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicorn.llm.common import materialize, without

WORD_BITS = 20
_WORD = re.compile(r"[^\W\d_]+")
OUTPUT = ["p_text", "p_meta", "score", "keep"]


@dataclass(frozen=True)
class Settings:
    rounds: int = 3
    confidence: float = 0.98
    pseudo_weight: float = 0.5
    max_labelled: int = 12_000
    max_features: int = 4_096
    least_rows: int = 4
    least_z: float = 5.0
    held_out: float = 0.3
    threshold: float = 0.5
    seed: int = 11


# ------------------------------------------------------------------ features of one document

def _bucket(name: str) -> int:
    """Features that aren't words share the upper half of the range."""
    return (1 << WORD_BITS) | (zlib.crc32(name.encode()) & ((1 << WORD_BITS) - 1))


def word_feature(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)


def _step(x: float, steps: tuple[float, ...]) -> int:
    return sum(x >= s for s in steps)


_SHARES = (0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)


def shape_names(text: str) -> list[str]:
    """Binned shape of a text: repetition (by length), capitals, signs, bare separators."""
    words = text.split()
    n = len(words)
    if n == 0:
        return ["empty"]
    size = int(math.log2(n))
    pairs = n - len(set(zip(words, words[1:]))) - 1
    most = n - len(set(words))
    upper = sum(map(str.isupper, words))
    signs = sum(not (w[-1].isalnum() or w[-1] in ".,;:!?\"')") for w in words)
    bare = sum(len(w) == 1 and not w.isalnum() for w in words)
    loud = text.count("!!")
    out = [f"pairs{_step(pairs / n, _SHARES)}", f"pairs{_step(pairs / n, _SHARES)} n{size}",
           f"repeat{_step(most / n, _SHARES)} n{size}", f"signs{_step(signs / n, _SHARES)}",
           f"bare{_step(bare / n, _SHARES)}", f"loud{_step(loud / n, _SHARES)}", f"n{size}"]
    return out + [f"upper{_step(upper / n, _SHARES)}" if n > 3 else "upper?"]


PREFIXES = (4, 5, 6)


def word_parts(word: str) -> tuple[str, ...]:
    """The word and its beginnings (marked), which word families share."""
    return word, *(word[:k] + "-" for k in PREFIXES if len(word) >= k)


def text_features(text: str) -> list[int]:
    words = {word_feature(p) for w in set(_WORD.findall(text.lower())) for p in word_parts(w)}
    return [*words, *map(_bucket, shape_names(text))]


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    size = "?" if n_chars is None else int(2 * math.log2(max(1, n_chars)))
    names = (f"source {source}", f"lang {lang}", f"size {size}", f"lang {lang} size {size}")
    return [_bucket(f"meta {x}") for x in names]


# ------------------------------------------------------------------ fitting, on the driver

class Rows:
    """Sparse binary rows as (row, column) pairs; ``columns`` are the features in order."""

    def __init__(self, lists: list, columns: np.ndarray):
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists] or [np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        col = np.searchsorted(columns, flat)
        known = col < len(columns)
        known[known] = columns[col[known]] == flat[known]
        self.row, self.col = row[known], col[known]
        self.n, self.width = len(lists), len(columns)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class View:
    """A classifier of one view: feature ids in order, their weights, the bias."""
    columns: np.ndarray
    weights: np.ndarray
    bias: float = 0.0

    def widened(self, features: np.ndarray) -> "View":
        """With further features, of weight 0 so far."""
        columns = np.union1d(self.columns, features)
        weights = np.zeros(len(columns))
        weights[np.searchsorted(columns, self.columns)] = self.weights
        return View(columns, weights, self.bias)

    def dot(self, flat: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """Raw scores of n rows, given their features as (row, feature) pairs."""
        if not len(self.columns):
            return np.full(n, self.bias)
        at = np.minimum(np.searchsorted(self.columns, flat), len(self.columns) - 1)
        return self.bias + np.bincount(row, weights=np.where(self.columns[at] == flat, self.weights[at], 0.0), minlength=n)


@dataclass
class Pull:
    """A quadratic in a view's weights and bias, around where they were."""
    gradient: np.ndarray
    curvature: np.ndarray
    around: np.ndarray


def fit(rows: Rows, y: np.ndarray, view: View, pull: Pull | None = None, l2: float = 0.1, steps: int = 25) -> View:
    """Logistic regression on labelled rows and the quadratic of the others: Newton steps by
    conjugate gradients, halved until the loss falls. The optimum is unique, so fitting again
    without new rows changes nothing."""
    ridge = np.append(np.full(rows.width, l2), 1e-6)
    curve, slope = (pull.curvature, pull.gradient) if pull is not None else (0.0, 0.0)
    at = np.append(view.weights, view.bias)
    around = pull.around if pull is not None else at

    def raw(x: np.ndarray) -> np.ndarray:
        return rows.dot(x[:-1]) + x[-1]

    def back(g: np.ndarray) -> np.ndarray:
        return np.append(rows.back(g), g.sum())

    def loss(x: np.ndarray) -> float:
        f, d = raw(x), x - around
        return float((np.logaddexp(0, f) - y * f).sum() + (ridge * x * x / 2 + slope * d + curve * d * d / 2).sum())

    now = loss(at)
    for _ in range(steps):
        p = sigmoid(raw(at))
        g = back(p - y) + ridge * at + slope + curve * (at - around)
        size = np.linalg.norm(g)
        if size < 1e-6 * max(1, len(y)):
            break
        spread = p * (1 - p)
        move, rest = np.zeros_like(at), -g
        way, left = rest.copy(), float(rest @ rest)
        for _ in range(60):
            bent = back(spread * raw(way)) + (ridge + curve) * way
            far = left / float(way @ bent)
            move, rest = move + far * way, rest - far * bent
            new = float(rest @ rest)
            if new < (0.05 * size) ** 2:
                break
            way, left = rest + new / left * way, new
        part = 1.0
        while part > 1e-6 and (then := loss(at + part * move)) >= now:
            part /= 2
        if part <= 1e-6:
            break
        at, now = at + part * move, then
    return View(view.columns, at[:-1], float(at[-1]))


def calibrate(scores: list[np.ndarray], y: np.ndarray, steps: int = 500) -> np.ndarray:
    """Weights (one per score, then the bias) of a logistic fit with smoothed targets."""
    x = np.column_stack([*scores, np.ones(len(y))])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps, damped
        p = sigmoid(x @ a)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(len(a))
        move = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * a)
        a = a - np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return a


@dataclass
class Model:
    views: list[View]                                       # text, metadata
    scale: list[np.ndarray]                                 # calibration of each view
    mix: np.ndarray


class Trainer:
    """The labelled rows, on the driver: fits views, calibrates them on the held-out part."""

    def __init__(self, text: list, meta: list, label: list[int], columns: list[int], s: Settings):
        self.s, self.lists = s, [text, meta]
        self.truth = np.array(label, float)
        self.held = np.random.default_rng(s.seed).random(len(label)) < s.held_out
        every = np.unique(np.concatenate([np.asarray(m, np.int64) for m in meta] or [np.zeros(0, np.int64)]))
        names = [np.array(sorted(columns), np.int64), every]
        self.views = [View(c, np.zeros(len(c))) for c in names]

    def usable(self) -> bool:
        return min(((self.truth == c) & part).sum() for c in (0, 1) for part in (~self.held, self.held)) > 0

    def fit(self, pulls: list[Pull | None]) -> None:
        part = np.flatnonzero(~self.held)
        for k, pull in enumerate(pulls):
            rows = Rows([self.lists[k][i] for i in part], self.views[k].columns)
            self.views[k] = fit(rows, self.truth[part], self.views[k], pull)

    def calibrated(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Scale of each view, and its calibrated scores of the held-out rows."""
        part, scale, calm = np.flatnonzero(self.held), [], []
        for lists, view in zip(self.lists, self.views):
            rows = Rows([lists[i] for i in part], view.columns)
            raw = rows.dot(view.weights) + view.bias
            scale.append(calibrate([raw], self.truth[part]))
            calm.append(scale[-1][0] * raw + scale[-1][1])
        return scale, calm

    def pulls(self, sums: list[tuple[int, int, float, float]]) -> list[Pull]:
        """Sums (view, feature, gradient, curvature) as quadratics. All pseudo-labelled rows
        together weigh ``pseudo_weight`` times the labelled ones, however many they are."""
        out = []
        for k in range(2):
            own = [r for r in sums if r[0] == k and r[1] != COUNT]
            rows = sum(r[3] for r in sums if r[:2] == (k, COUNT))
            each = self.s.pseudo_weight * (~self.held).sum() / max(rows, 1.0)
            view = self.views[k] = self.views[k].widened(np.array([r[1] for r in own if r[1] >= 0], np.int64))
            gradient, curvature = np.zeros((2, len(view.columns) + 1))
            for _, feature, g, h in own:
                at = -1 if feature == BIAS else np.searchsorted(view.columns, feature)
                gradient[at], curvature[at] = each * g, each * h
            out.append(Pull(gradient, curvature, np.append(view.weights, view.bias)))
        return out

    def model(self) -> Model:
        scale, calm = self.calibrated()
        return Model(self.views, scale, calibrate(calm, self.truth[self.held]))


def _pairs(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of list rows, the row of each, and the number in each row."""
    size = np.diff(np.asarray(lists.offsets))
    return lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size), size


#: marks in place of a feature: the bias, and the number of rows
BIAS, COUNT = -1, -2


def exchange(views: list[View], scale: list[np.ndarray], s: Settings):
    """(words, meta) rows to sums (view, feature, gradient, curvature) over the rows that the
    *other* view is confident about; one row a feature and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[dict[int, np.ndarray]] = [{}, {}]
        for b in batches:
            pairs = [_pairs(b.column(k)) for k in range(2)]
            raw = [v.dot(flat, row, b.num_rows) for v, (flat, row, _) in zip(views, pairs)]
            sure = [sigmoid(a * r + c) for (a, c), r in zip(scale, raw)]
            for own, other in ((0, 1), (1, 0)):
                p, (flat, row, size) = sure[other], pairs[own]
                w = ((p >= s.confidence) | (p <= 1 - s.confidence)).astype(float)
                far = np.maximum(np.abs(raw[own]), 1e-6)
                g = w * (sigmoid(raw[own]) - (p >= 0.5))
                h = w * np.tanh(far / 2) / (2 * far) * (size + 1)
                names, at = np.unique(flat, return_inverse=True)
                add = np.column_stack([np.bincount(at, weights=x[row], minlength=len(names)) for x in (g, h)])
                for f, x in zip([*names.tolist(), BIAS, COUNT], [*add, np.array([g.sum(), h.sum()]), np.array([0.0, w.sum()])]):
                    sums[own][f] = sums[own].get(f, 0.0) + x
        for k, own in enumerate(sums):
            live = [(f, *x.tolist()) for f, x in own.items() if x[1] > 0]
            if live:
                f, g, h = zip(*live)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(f), pa.int32()), pa.array(f, pa.int32()), pa.array(g), pa.array(h)],
                                                 names=["view", "feature", "gradient", "curvature"])
    return run


# ------------------------------------------------------------------ Spark jobs

def _view(df: DataFrame, key: str, text: str, source: str, lang: str, size: str) -> list:
    return [df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"), df[source].alias("source"),
            df[lang].alias("lang"), df[size].cast("long").alias("n_chars")]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key, label, text, source, lang, n = b.columns
        for lo in range(0, b.num_rows, 256):
            part = slice(lo, lo + 256)
            rows = [x.slice(lo, 256) for x in (text, source, lang, n)]
            feats = [text_features(t.as_py()) for t in rows[0]]
            metas = [meta_features(*(x.as_py() for x in r)) for r in zip(*rows[1:])]
            yield pa.RecordBatch.from_arrays(
                [key[part], label[part], pa.array(feats, pa.list_(pa.int32())), pa.array(metas, pa.list_(pa.int32()))],
                names=["key", "label", "words", "meta"])


def labelled_sample(labels: DataFrame, s: Settings, key: str) -> DataFrame:
    """(key, label) of at most ``max_labelled`` labelled documents, written."""
    marked = (labels.select(labels[key].alias("key"), labels["quality"].alias("q"), labels["toxic"].alias("x"))
              .dropna().groupBy("key").agg(F.min("q").alias("q"), F.max("x").alias("x"))
              .select("key", ((F.col("q") == 1) & (F.col("x") == 0)).cast("int").alias("label")))
    return materialize(marked.orderBy(F.xxhash64(F.lit(s.seed), F.col("key")), "key").limit(s.max_labelled), "cotrain-ids")


def start(docs: DataFrame, chosen: DataFrame, s: Settings, view: list) -> tuple[Trainer, list[int]] | None:
    """Features of the labelled rows, the choice of text features, and the first fits."""
    # at most max_labelled ids: a proven bound for the broadcast
    rows = docs.select(*view).join(F.broadcast(chosen), "key")
    examples = materialize(
        rows.select("key", "label", "text", "source", "lang", "n_chars")
        .mapInArrow(_extract, "key long, label int, words array<int>, meta array<int>")
        .groupBy("key").agg(F.first("label").alias("label"), F.min(F.struct("words", "meta")).alias("f")), "cotrain-rows")
    n = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    counts = (examples.select("label", F.explode("f.words").alias("feature")).groupBy("feature")
              .agg(F.sum(F.col("label")).alias("good"), F.sum(1 - F.col("label")).alias("bad")))
    # root of the likelihood ratio statistic of feature against class
    rows_with, total = F.col("good") + F.col("bad"), n[0] + n[1]

    def cell(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    ratio = (cell(F.col("good"), rows_with * (n[1] / total)) + cell(F.col("bad"), rows_with * (n[0] / total))
             + cell(n[1] - F.col("good"), (total - rows_with) * (n[1] / total))
             + cell(n[0] - F.col("bad"), (total - rows_with) * (n[0] / total)))
    told = (counts.filter(rows_with >= s.least_rows)
            .withColumn("z", F.sqrt(F.greatest(F.lit(0.0), 2 * ratio)))
            .filter((F.col("z") >= s.least_z) | (F.col("feature") >= 1 << WORD_BITS))
            .orderBy(F.col("z").desc(), "feature").limit(s.max_features))
    columns = sorted(r["feature"] for r in told.select("feature").collect())
    kept = F.array_intersect(F.col("f.words"), F.array(*map(F.lit, columns))) if columns else F.col("f.words")
    # bounded: at most max_labelled rows of chosen features
    data = (examples.select("key", "label", kept.alias("words"), F.col("f.meta").alias("meta"))
            .sort("key").toArrow().combine_chunks())

    def rows_of(name: str) -> list[np.ndarray]:
        lists = data[name].combine_chunks()
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        return [flat[x:y] for x, y in zip(at[:-1], at[1:])]
    trainer = Trainer(rows_of("words"), rows_of("meta"), data["label"].to_pylist(), columns, s)
    if not trainer.usable():
        return None
    trainer.fit([None, None])
    return trainer, columns


class _Told(dict):
    """The chosen features of a word (most have none); bounded."""

    def __init__(self, chosen: set[int]):
        super().__init__()
        self.chosen = chosen

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 1 << 18:
            self.clear()
        found = self[word] = tuple(f for f in map(word_feature, word_parts(word)) if f in self.chosen)
        return found


def _featured(columns: list[int], inside: int | None):
    """(row, label, source, lang, n_chars[, text]) to (row, label, chosen words, meta)."""
    chosen = set(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = _Told(chosen)

        def chosen_of(text: str | None) -> list[int]:
            text = text or ""
            found = set().union(*map(told.__getitem__, set(_WORD.findall(text.lower()))))
            found.update(f for f in map(_bucket, shape_names(text)) if f in chosen)
            return sorted(found)

        for b in batches:
            texts = b.column(0).field(inside) if inside is not None else b.column(5)
            words = [chosen_of(t.as_py()) for t in texts]
            metas = [sorted(set(meta_features(*r))) for r in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.int32())),
                                              pa.array(metas, pa.list_(pa.int32()))], names=["row", "label", "words", "meta"])
    return run


def _scores(model: Model, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            calm = []
            for k, (view, (a, c)) in enumerate(zip(model.views, model.scale)):
                flat, row, _ = _pairs(b.column(k + 1))
                calm.append(a * view.dot(flat, row, b.num_rows) + c)
            score = sigmoid(model.mix[0] * calm[0] + model.mix[1] * calm[1] + model.mix[2])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(pa.array, (sigmoid(calm[0]), sigmoid(calm[1]), score, score >= s.threshold))],
                names=["row", *OUTPUT])
    return run


def train(trainer: Trainer, featured: DataFrame, s: Settings) -> Model:
    """The rounds, each a job over the features of all unlabelled documents."""
    free = featured.filter("label is null")
    n, spark = free.count(), featured.sparkSession
    tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (1 << 14))))
    for _ in range(s.rounds if n else 0):
        scale, _ = trainer.calibrated()
        sums = (free.select("words", "meta").coalesce(tasks)
                .mapInArrow(exchange(trainer.views, scale, s), "view int, feature int, gradient double, curvature double")
                .groupBy("view", "feature").agg(F.sum("gradient").alias("g"), F.sum("curvature").alias("h")))
        # bounded: at most max_features and 2**20 rows
        trainer.fit(trainer.pulls([tuple(r) for r in sums.collect()]))
    return trainer.model()


def score_documents(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), key: str = "doc_id",
                    text: str = "text", source: str = "source", lang: str = "lang", size: str = "n_chars") -> DataFrame:
    """``docs`` with ``p_text, p_meta`` (calibrated views), ``score`` (combined) and ``keep``."""
    s = settings
    names = without(docs, OUTPUT).columns
    view = _view(docs, key, text, source, lang, size)
    chosen = labelled_sample(labels, s, key)
    begun = start(docs, chosen, s, view)
    if begun is None:
        one = F.lit(1.0)
        return docs.select(*[docs[c] for c in names], *[one.alias(c) for c in OUTPUT[:3]], F.lit(True).alias("keep"))
    trainer, columns = begun
    inside = next((k for k, c in enumerate(names) if c.lower() == text.lower()), None)
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), *view)
    rows = rows.join(F.broadcast(chosen), "key", "left").select(
        "row", "label", "source", "lang", "n_chars", *([] if inside is not None else ["text"]))
    row = rows.schema["row"]
    ints = T.ArrayType(T.IntegerType())
    featured = materialize(rows.mapInArrow(_featured(columns, inside), T.StructType(
        [row, T.StructField("label", T.IntegerType()), T.StructField("words", ints), T.StructField("meta", ints)])),
        "cotrain-features", compression="zstd")
    model = train(trainer, featured, s)
    schema = T.StructType([row, *[T.StructField(c, T.DoubleType()) for c in OUTPUT[:3]], T.StructField("keep", T.BooleanType())])
    return featured.select("row", "words", "meta").mapInArrow(_scores(model, s), schema).select("row.*", *OUTPUT)

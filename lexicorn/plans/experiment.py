"""Training with EM epochs and early stopping, grid search, final fit and model comparison.

The corpus is counted once, at the highest order of the grid; the cells of one (order,
min_count) differ by their weights alone and are trained together, so every epoch is one small
aggregate over the written held-out level table plus a validation pass (greedy completion +
ROUGE-L) for all of them. Only weights, history rows and per-run metrics reach the driver. With
a ``results_dir`` the result rows, histories and best models of such cells are written before
the next (order, min_count) begins. A stored
cell is known by what it was made of (every axis and setting, and a digest of the encoded
rows), never by its number, so only the same cell over the same data is not run again.
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexicorn.operators import ngram as NG
from lexicorn.operators import packed as PK
from lexicorn.operators import splits as SP
from lexicorn.plans import evaluate as EV
from lexicorn.plans import pipeline as PL
from lexicorn.session import write_once
from lexicorn.sources import store as ST

# The field names of the history and of the result record.
HISTORY_SCHEMA = "epoch int, train_loss double, val_perplexity double, val_rougeL double, weights array<double>"


RESULT_SCHEMA = (
    "run_id int, lr double, order int, min_count int, epochs int, final_train_loss double, "
    "final_val_perplexity double, final_val_rougeL double, test_perplexity double, "
    "test_rougeL double, best_epoch int, weights array<double>")
#: a stored row also names its cell, its data and the version of its model
STORED_SCHEMA = RESULT_SCHEMA + ", cell string, data string, model_version long"


@dataclass
class TrainResult:
    model: NG.NGramModel
    history: list[dict]
    best_epoch: int


def early_stop(history: DataFrame, patience: int, by: str = "run_id") -> DataFrame:
    """Early stopping over a table of histories (``by``, epoch, val_rougeL): per run the epoch
    with the first best value among the epochs that ran, and the last epoch that ran.

    An epoch is a miss if it is not strictly better than all before; the run ends with the
    epoch whose miss is the ``patience``-th since the last best."""
    w = Window.partitionBy(by).orderBy("epoch")
    before = F.max("val_rougeL").over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = history.withColumn("better", before.isNull() | (F.col("val_rougeL") > before))
    streak = better.withColumn("since", F.max(F.when(F.col("better"), F.col("epoch"))).over(w))
    misses = streak.withColumn("misses", F.col("epoch") - F.col("since"))
    ended = F.min(F.when(F.col("misses") >= patience, F.col("epoch"))).over(Window.partitionBy(by))
    ran = misses.withColumn("ended", ended).filter(F.col("ended").isNull() | (F.col("epoch") <= F.col("ended")))
    return ran.groupBy(by).agg(F.max("since").alias("best_epoch"), F.max("epoch").alias("last_epoch"))


def early_stop_state(history: list[dict], patience: int) -> tuple[int, bool]:
    """(best epoch, stop now?): strictly better val ROUGE-L resets the counter."""
    best, best_epoch, misses = -math.inf, 0, 0
    for h in history:
        if h["val_rougeL"] > best:
            best, best_epoch, misses = h["val_rougeL"], h["epoch"], 0
        else:
            misses += 1
    return best_epoch, misses >= patience


def window_levels(model: NG.NGramModel, rows: DataFrame) -> DataFrame:
    """The levels of the distinct windows of ``rows``, written once; from the model's buckets if it has them."""
    made = PK.window_levels(model, rows)
    return write_once(NG.window_levels(model, rows) if made is None else made)


def train(model: NG.NGramModel, em_rows: DataFrame, val_rows: DataFrame, vocab: DataFrame,
          epochs: int = 10, lr: float = 0.5, patience: int = 2, stem: bool = True,
          max_new: int = 20) -> TrainResult:
    """EM epochs on held-out positions; validation each epoch; keep the best weights."""
    return train_cells(model, [{"epochs": epochs, "lr": lr, "patience": patience}], em_rows, val_rows, vocab,
                       stem=stem, max_new=max_new)[0]


def train_cells(model: NG.NGramModel, cells: list[dict], em_rows: DataFrame, val_rows: DataFrame,
                vocab: DataFrame, stem: bool = True, max_new: int = 20) -> list[TrainResult]:
    """`train` for all cells (lr, epochs, patience) over the same counts at once.

    The levels of held-out and validation windows and the validation references are written once. An epoch is one aggregate
    for the weights, one for the perplexities and one completion of the validation rows, for
    all cells that still run: the number of jobs does not grow with the number of cells."""
    model.materialize()
    levels = window_levels(model, em_rows)
    val_levels = levels if val_rows is em_rows else window_levels(model, val_rows)
    prepared = EV.rouge_rows(model, val_rows, vocab, stem=stem)
    lams = [list(model.lambdas) for _ in cells]
    best = [(list(model.lambdas), 0) for _ in cells]
    histories: list[list[dict]] = [[] for _ in cells]
    live, epoch = list(range(len(cells))), 0
    while live := [i for i in live if epoch < cells[i]["epochs"]]:
        epoch += 1
        stepped = NG.em_update_cells(model, levels, [lams[i] for i in live], [cells[i]["lr"] for i in live])
        for i, (lam, _) in zip(live, stepped):
            lams[i] = lam
        now = [lams[i] for i in live]
        perplexities = NG.perplexity_cells(model, val_levels, now)
        scores = EV.rouge_cells(model, prepared, vocab, now, stem=stem, max_new=max_new)
        running = []
        for i, (lam, loss), ppl, rouge in zip(live, stepped, perplexities, scores):
            histories[i].append({"epoch": epoch, "train_loss": loss, "val_perplexity": ppl,
                                 # 12 places: equal scores must tie whatever the order of the mean
                                 "val_rougeL": round(rouge, 12), "weights": list(lam)})
            at, stop = early_stop_state(histories[i], cells[i]["patience"])
            if at == epoch:
                best[i] = (list(lam), epoch)
            if not stop:
                running.append(i)
        live = running
    return [TrainResult(model.with_lambdas(lam), history, at) for (lam, at), history in zip(best, histories)]


def history_frame(spark: SparkSession, history: list[dict]) -> DataFrame:
    return spark.createDataFrame(
        [(h["epoch"], h["train_loss"], h["val_perplexity"], h["val_rougeL"], h["weights"])
         for h in history], HISTORY_SCHEMA)


def grid_frame(spark: SparkSession, grid: list[dict]) -> DataFrame:
    """The grid as a table, one row per cell in order, numbered from 1."""
    return spark.createDataFrame([(k, float(c["lr"]), c["order"], c["min_count"], c["epochs"])
                                  for k, c in enumerate(grid, start=1)],
                                 "run_id int, lr double, order int, min_count int, epochs int")


def param_grid(**axes) -> list[dict]:
    keys = list(axes)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[axes[k] for k in keys])]


def prepare(spark: SparkSession, sf: str, cfg: PL.Config = PL.DEFAULT, corpus: DataFrame | None = None,
            docs: DataFrame | None = None):
    """Cached encoded corpus (with hold-out flag) and vocabulary, shared by all runs. ``corpus`` and
    ``docs`` are the cleaned texts, if they are written already."""
    corpus = write_once(PL.split_corpus(spark, sf, cfg)) if corpus is None else corpus
    voc = PL.corpus_vocab(spark, sf, cfg, corpus, docs)
    enc = PL.encoded_corpus(spark, sf, cfg, voc, corpus)
    enc = write_once(SP.holdout(enc, 0.10, cfg.seed))
    return enc, voc


def _stored_results(spark: SparkSession, results_dir: str | None, data: str) -> dict[str, tuple]:
    """Result rows that earlier, perhaps interrupted, runs over the same data have left, by
    cell; of two writers' rows the first model's."""
    from pyspark.errors import AnalysisException
    if results_dir is None:
        return {}
    try:
        rows = spark.read.schema(STORED_SCHEMA).parquet(f"{results_dir}/results").filter(F.col("data") == data).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["cell"]: tuple(r) for r in sorted(rows, key=lambda r: -r["model_version"])}


def grid_search(spark: SparkSession, sf: str, grid: list[dict], cfg: PL.Config = PL.DEFAULT,
                max_new: int = 20, stem: bool = True, results_dir: str | None = None,
                prepared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row per cell: config + final train loss / val metrics + test metrics. ``prepared`` is what
    `prepare` gave for the same data and settings, if a run has it already."""
    enc, voc = prepared or prepare(spark, sf, cfg)
    data = ST.data_digest(enc) + "/" + ST.data_digest(voc) if results_dir is not None else ""
    stored = _stored_results(spark, results_dir, data)
    train_rows = enc.filter((F.col("split") == "train") & ~F.col("holdout"))
    em_rows = enc.filter((F.col("split") == "train") & F.col("holdout"))
    val_rows = enc.filter(F.col("split") == "validation")
    test_rows = enc.filter(F.col("split") == "test")
    width = len(RESULT_SCHEMA.split(", "))
    records, groups, made = [], {}, {}
    for run_id, cell in enumerate(grid, start=1):
        cell = {**cell, "lr": float(cell["lr"]), "patience": cell.get("patience", 3)}
        made[run_id] = json.dumps({**cell, "max_new": max_new, "stem": stem, "vocab_size": cfg.vocab_size,
                                   "fraction": cfg.fraction}, sort_keys=True)
        if made[run_id] in stored:
            records.append((run_id, *stored[made[run_id]][1:width]))
        else:
            groups.setdefault((cell["order"], cell["min_count"]), []).append((run_id, cell))
    if groups:  # every model is a part of the highest order's counts
        counts = write_once(NG.ngram_counts(train_rows, max(order for order, _ in groups)))
    for (order, min_count), members in groups.items():
        base = NG.restricted(counts, order, cfg.vocab_size, min_count).materialize()
        results = train_cells(base, [cell for _, cell in members], em_rows, val_rows, voc, stem=stem, max_new=max_new)
        weights = [res.model.lambdas for res in results]
        perplexities = NG.perplexity_cells(base, window_levels(base, test_rows), weights)
        scores = EV.rouge_cells(base, EV.rouge_rows(base, test_rows, voc, stem=stem), voc, weights, stem=stem, max_new=max_new)
        for (run_id, cell), res, ppl, rouge in zip(members, results, perplexities, scores):
            last = res.history[-1]
            records.append((run_id, cell["lr"], int(order), int(min_count), int(cell["epochs"]), last["train_loss"],
                            last["val_perplexity"], last["val_rougeL"], ppl, rouge, int(res.best_epoch),
                            [float(x) for x in res.model.lambdas]))
            if results_dir is not None:
                # the result row comes last: a cell that has one is complete
                version = ST.save_model(res.model, f"{results_dir}/models", tag=f"run-{run_id}")
                ST.append_run(history_frame(spark, res.history).withColumn("cell", F.lit(made[run_id]))
                              .withColumn("data", F.lit(data)), f"{results_dir}/history", run_id)
                (spark.createDataFrame([(*records[-1], made[run_id], data, version)], STORED_SCHEMA).coalesce(1)
                 .write.mode("append").parquet(f"{results_dir}/results"))
    records.sort()
    out = spark.createDataFrame(records, RESULT_SCHEMA)
    if results_dir is not None:
        ST.write_results_csv(out.withColumn("weights", F.concat_ws(" ", F.col("weights").cast("array<string>"))),
                             f"{results_dir}/grid_search_results")
    return out


def best_config(results: DataFrame) -> DataFrame:
    """First maximum of test ROUGE-L (ties, to 9 places, to the earliest run)."""
    return results.orderBy(F.round("test_rougeL", 9).desc(), F.col("run_id")).limit(1)


def final_fit(spark: SparkSession, sf: str, best: dict, cfg: PL.Config = PL.DEFAULT,
              max_new: int = 20, stem: bool = True, results_dir: str | None = None,
              prepared: tuple[DataFrame, DataFrame] | None = None) -> TrainResult:
    """Refit on train+validation+test minus the hold-out tenth; 2x epochs, patience 3,
    early-stopping on the hold-out (which is excluded from the counts). With a
    ``results_dir`` the model is saved there, tagged ``final``."""
    enc, voc = prepared or prepare(spark, sf, cfg)
    parts = [enc.filter(F.col("split") == s) for s in ("train", "validation", "test")]
    full = parts[0].unionByName(parts[1]).unionByName(parts[2])
    fit_rows = full.filter(~F.col("holdout"))
    hold = full.filter(F.col("holdout"))
    base = NG.fit(fit_rows, best["order"], cfg.vocab_size, min_count=best["min_count"])
    res = train(base, hold, hold, voc, epochs=2 * best["epochs"], lr=best["lr"], patience=3,
                stem=stem, max_new=max_new)
    if results_dir is not None:
        ST.save_model(res.model, f"{results_dir}/models", tag="final")
        ST.append_run(history_frame(spark, res.history), f"{results_dir}/final_history", 0)
    return res


def compare_models(spark: SparkSession, sf: str, cfg: PL.Config = PL.DEFAULT,
                   temperature: float = 0.8, top_p: float = 0.9, max_new: int = 20,
                   stem: bool = True, decoders: tuple[str, ...] = ("greedy", "sampling")) -> tuple[DataFrame, DataFrame]:
    """Two models (in-domain conversations, out-of-domain documents; one vocabulary) x
    two decoders (greedy; temperature + top-p), scored by the character split on the
    in-domain test rows. Returns (model, decoder, avg_rouge_l) and the example rows."""
    # every text is cleaned once, for the vocabulary, the models and the prompts
    corpus, texts = write_once(PL.split_corpus(spark, sf, cfg)), write_once(PL.clean_docs(spark, sf))
    enc, voc = prepare(spark, sf, cfg, corpus, texts)
    docs = PL.encoded_docs(spark, sf, cfg, voc, texts)
    models = {
        "in_domain": NG.fit(enc.filter(F.col("split") == "train"), cfg.order, cfg.vocab_size).materialize(),
        "out_of_domain": NG.fit(docs, cfg.order, cfg.vocab_size).materialize(),
    }
    texts = corpus.filter(F.col("split") == "test").select("row_id", "text")
    texts = write_once(texts)
    scores, examples = [], []
    for name, m in models.items():
        for decoder, kw in (("greedy", {}), ("sampling", {"sampling": True, "temperature": temperature,
                                                         "top_p": top_p, "seed": cfg.seed})):
            if decoder not in decoders:
                continue
            _, per = EV.evaluate_chars(m, texts, voc, cfg.fraction, stem=stem, max_new=max_new, **kw)
            tag = [F.lit(name).alias("model"), F.lit(decoder).alias("decoder")]
            # completed and scored once: the mean is taken from the written rows
            per = write_once(per.select(*tag, "row_id", "prompt", "prediction", "rouge_l"))
            scores.append(EV.mean_score(per).select(*tag, F.col("rouge_l").alias("avg_rouge_l")))
            examples.append(per)
    out = scores[0]
    for s in scores[1:]:
        out = out.unionByName(s)
    ex = examples[0]
    for e in examples[1:]:
        ex = ex.unionByName(e)
    return write_once(out), ex


def pivot_scores(scores: DataFrame) -> DataFrame:
    """(decoder, one column per model) for display."""
    return scores.groupBy("decoder").pivot("model", ["in_domain", "out_of_domain"]).agg(F.first("avg_rouge_l"))


def top_examples(examples: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("model", "decoder").orderBy("row_id")
    return examples.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")

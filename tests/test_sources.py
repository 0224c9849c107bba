import os
import shutil
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from lexicorn.functions.text import clean_text
from lexicorn.operators.ngram import ngram_counts
from lexicorn.sources import csv_corpus, turn_key
from lexicorn.sources import store as ST
from lexicorn.streaming import counts_stream as CS
from lexicorn.streaming.clean_stream import start_clean_sink


def test_csv_edge_cases(spark):
    d = tempfile.mkdtemp(prefix="lexicorn-csv-", dir="/tmp")
    lines = [
        '"0","1","d","NO_QUERY","u","He said ""héllo"" to me"',
        '0,2,d,f,u,seventh field row,EXTRA',
        '0,3,d',
        '0,4,d,f,u,NO_QUERY',
        '0,5,d,f,u,""',
        '0,6,d,f,u,"line one\nline two"',
        '0,7,d,f,u,ends with backslash\\',
    ]
    with open(os.path.join(d, "corpus.csv"), "wb") as fh:
        fh.write(("\n".join(lines) + "\n").encode("latin-1"))
    df = csv_corpus(spark, d, multiline=True).select("row_id", clean_text("text").alias("c"))
    got = [r.c for r in df.orderBy("row_id").collect()]
    assert got == ['he said "héllo" to me', "seventh field row", "", "", "",
                   "line oneline two", "ends with backslash\\"]


def test_csv_ids_stay_with_their_rows(spark):
    d = tempfile.mkdtemp(prefix="lexicorn-csv-", dir="/tmp")
    for k in range(4):
        with open(os.path.join(d, f"{k}.csv"), "w") as fh:
            fh.writelines(f'0,{"" if k == 3 else k * 1000 + i},d,f,u,row {k} {i}\n' for i in range(50))
    a = csv_corpus(spark, d)
    b = csv_corpus(spark, d).repartition(3)
    assert a.select("row_id").distinct().count() == 200
    assert a.exceptAll(b).count() == 0
    assert a.filter("row_id = 2007").first().text == "row 2 7"


def test_turn_key_has_no_collisions(spark):
    df = spark.range(40).crossJoin(spark.range(300).withColumnRenamed("id", "turn")).withColumnRenamed("id", "conv_id")
    assert df.select(turn_key().alias("k")).distinct().count() == 40 * 300
    with pytest.raises(Exception, match="20 bits"):
        spark.createDataFrame([(1, 1 << 20)], "conv_id long, turn long").select(turn_key()).collect()
    assert spark.createDataFrame([(None, 1)], "conv_id long, turn long").select(turn_key().alias("k")).first().k is None


def test_history_and_results_sinks(spark):
    d = tempfile.mkdtemp(prefix="lexicorn-sink-", dir="/tmp")
    h = spark.createDataFrame([(1, 0.5), (2, 0.4)], "epoch int, train_loss double")
    ST.append_run(h, f"{d}/history", 1)
    ST.append_run(h, f"{d}/history", 2)
    back = spark.read.parquet(f"{d}/history")
    assert back.count() == 4 and sorted(r.run_id for r in back.select("run_id").distinct().collect()) == [1, 2]
    ST.write_results_csv(back.groupBy("run_id").agg(F.min("train_loss").alias("best")), f"{d}/results")
    assert spark.read.option("header", "true").csv(f"{d}/results").count() == 2


def test_streaming_cleaner_matches_batch(spark):
    src_dir = tempfile.mkdtemp(prefix="lexicorn-stream-src-", dir="/tmp")
    shutil.copy(f"{SF001}/conversations.parquet", src_dir)
    out = tempfile.mkdtemp(prefix="lexicorn-stream-out-", dir="/tmp")
    q = start_clean_sink(spark, src_dir, f"{out}/sink", f"{out}/ckpt", once=True)
    q.awaitTermination(120)
    streamed = spark.read.parquet(f"{out}/sink")
    batch = (spark.read.parquet(f"{SF001}/conversations.parquet")
             .select(turn_key().alias("row_id"),
                     clean_text(F.nullif("text", F.lit("NO_QUERY"))).alias("text")))
    assert streamed.count() == batch.count()
    assert streamed.subtract(batch).count() == 0


def _count_ids(batch):
    return ngram_counts(batch, 3)


def test_stream_counts_survive_crashes_and_count_once(spark):
    """Files land one by one; writing a batch, its commit and a base each fail once."""
    landing = tempfile.mkdtemp(prefix="lexicorn-landing-", dir="/tmp")
    folder = tempfile.mkdtemp(prefix="lexicorn-counts-", dir="/tmp")
    texts = [[[3, 4, 5], [3, 4]], [[3, 4, 5, 6]], [[]], [[3, 4, 5], [9]], [[4, 5]]]
    crash = {"before write": 1, "after commit": 2, "before base": 3}

    def fragile(batch, number):
        if crash.get("before write") == number:
            del crash["before write"]
            raise RuntimeError("crash before the batch is written")
        before_base = crash.get("before base") == number
        CS.add_batch(batch, number, folder, _count_ids, compact_every=99 if before_base else 2)
        if before_base or crash.get("after commit") == number:
            del crash["before base" if before_base else "after commit"]
            raise RuntimeError("crash after the batch is committed")

    for i, rows in enumerate(texts):
        (spark.createDataFrame([(r,) for r in rows], "ids array<int>").coalesce(1)
         .write.mode("append").parquet(landing))
        for attempt in range(2):
            q = (spark.readStream.schema("ids array<int>").parquet(landing).writeStream
                 .option("checkpointLocation", f"{folder}/_checkpoint").foreachBatch(fragile)
                 .trigger(availableNow=True).start())
            try:
                q.awaitTermination(60)
                break
            except Exception as e:
                assert "crash" in str(e) and attempt == 0
    assert not crash
    assert CS._committed(spark, folder, "base") == [1, 3]
    whole = spark.createDataFrame([(r,) for rows in texts for r in rows], "ids array<int>")
    want, got = ngram_counts(whole, 3).collect(), CS.counts(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_counts_of_nothing_and_of_an_uncommitted_batch(spark):
    folder = tempfile.mkdtemp(prefix="lexicorn-counts-", dir="/tmp")
    assert CS.counts(spark, folder).count() == 0
    rows = spark.createDataFrame([([3, 4],)], "ids array<int>")
    ngram_counts(rows, 3).write.parquet(f"{folder}/batch=0")  # written, but the commit never came
    assert CS.counts(spark, folder).count() == 0
    CS.add_batch(rows, 0, folder, _count_ids)
    CS.add_batch(rows, 0, folder, _count_ids)
    assert sorted((r.k, r.c) for r in CS.counts(spark, folder).collect()) == [(1, 1), (2, 1)]

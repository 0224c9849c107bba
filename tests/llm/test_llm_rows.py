"""Sharding, chat formatting, token counts and archive conversion on small hard tables."""

import hashlib
import gzip

import pytest
from pyspark.sql import functions as F

from lexicorn.llm import chat, sharding, token_counts, warc
from lexicorn.llm.common import shared_path

DOCS = "doc_id long, text string, SHARD string, n_tokens string, extra int, _digest int"
HARD = [(1, "a b c", "x", "y", 1, 0), (1, "a b c", "x", "y", 1, 0), (2, None, None, None, None, None),
        (None, "", "s", None, 2, 0), (3, "é" * 30_000, "x", "y", 3, 0), (4, "<|endoftext|> don't", "x", "y", 4, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    many = [(k, f"text {k}", "x", "y", k, 0) for k in range(10, 700)]
    hot = [(9, "hot", "x", "y", 0, 0)] * 300
    return spark.createDataFrame(HARD + many + hot, DOCS).repartition(5)


# ------------------------------------------------------------------ sharding

def test_sharding_keeps_rows_and_fills_slots(docs):
    out = sharding.shard_documents(docs, n_shards=7, bucket_bytes=4_000, bucket_rows=50)
    assert [c for c in out.columns if c.lower() == "shard"] == ["shard"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for s in range(7):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["size"] == len((r["text"] or "").encode()) + 16 for r in rows)
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in rows) == \
        sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    # buckets stay small although one key holds a third of the rows
    held = out.groupBy("shard", "bucket").count().agg(F.max("count")).first()[0]
    assert held < 150


def test_sharding_is_shuffled_and_repeatable(docs):
    one = sharding.shard_documents(docs.filter("doc_id >= 10"), n_shards=1)
    order = [r["doc_id"] for r in one.sort("slot").collect()]
    assert order != sorted(order)
    assert sum(abs(a - b) < 3 for a, b in zip(order, order[1:])) < len(order) / 20
    assert order == [r["doc_id"] for r in sharding.shard_documents(docs.filter("doc_id >= 10"), n_shards=1)
                     .sort("slot").collect()]


def test_one_more_shard_takes_rows_only_into_itself(docs):
    few = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard_documents(docs, 8).collect()}
    more = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, 9).collect()}
    assert all(grown == more[d] and grown in (s, 8) for d, (s, grown) in few.items())
    counts = [sum(s == k for s, _ in few.values()) for k in range(8)]
    assert min(counts) > 50 and sum(g == 8 for _, g in few.values()) > 40


def test_sharding_of_an_empty_table_and_writing(spark, docs):
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    path = shared_path(spark, "shards")
    sharding.write_shards(sharding.shard_documents(docs, n_shards=3), path)
    assert spark.read.parquet(path).groupBy("shard").count().count() == 3


# ------------------------------------------------------------------ chat

CONV = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_round_trip_and_automaton(spark):
    hard = ["\\### Assistant: </turn> ok", "</turn>\n", "### ", "\\b\\c\\d\\a", "#### ###  x</turn", "", None, "\\"]
    rows = [(k, t, r, x, "clash") for k, x in enumerate(hard) for t, r in ((0, "user"), (1, "assistant"))]
    rows += [(100, 0, "assistant", "a", ""), (101, 0, "user", "q", ""), (101, 0, "user", "q", ""),
             (102, 1, "assistant", "late", ""), (102, 0, "user", "early", ""), (None, 0, None, "x", ""),
             (103, 0, "User", "odd: role", ""), (103, 1, "to: ol\\e", "r", ""), (104, None, "system", "s", ""),
             (104, 1, "user", "u", ""), (104, 2, "assistant", "v" * 50_000, "")]
    out = chat.format_conversations(spark.createDataFrame(rows, CONV))
    got = {r["conv_id"]: r for r in out.withColumn("turns", chat.parse("formatted"))
           .withColumn("loss", chat.loss_text("segments")).collect()}
    want = {}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["formatted"].count("</turn>\n") == len(turns)
    assert got[0]["valid"] and got[102]["valid"] and got[104]["valid"]
    assert not got[100]["valid"] and got[100]["first_error"] == 0
    assert not got[101]["valid"] and got[101]["first_error"] == 1
    assert not got[103]["valid"]


def test_chat_of_an_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], CONV)).count() == 0


# ------------------------------------------------------------------ token counts

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_the_library(spark, docs, name):
    import public_tokenizers
    path = public_tokenizers.path(name)
    cache = shared_path(spark, "cache")
    out = token_counts.count_tokens(docs, cache, path, limit=3).collect()
    assert len(out) == docs.count()
    lib = token_counts.load_tokenizer(path)
    for r in out:
        text = r["text"] or ""
        n = len(lib.encode(text)) if name.endswith(".model") else len(lib.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 3)


def test_token_cache_is_used_and_grows_by_misses(spark, docs):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = shared_path(spark, "cache")
    token_counts.count_tokens(docs, cache, path).count()
    stored = spark.read.parquet(cache)
    texts = {r["text"] or "" for r in docs.select("text").collect()}
    assert stored.count() == len(texts)
    # a stored count is believed, whatever it is; only the new text is encoded
    fake = hashlib.sha256(b"planted").digest()
    spark.createDataFrame([(fake, token_counts.tokenizer_digest(path), 77)], token_counts.CACHE_DDL) \
        .write.mode("append").parquet(cache)
    more = spark.createDataFrame([(1, "planted"), (2, "new one"), (3, "a b c")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(more, cache, path).collect()}
    assert got[1] == 77 and got[2] == 2
    assert spark.read.parquet(cache).count() == len(texts) + 2
    assert token_counts.count_tokens(docs.limit(0), shared_path(spark, "cache"), path).count() == 0


# ------------------------------------------------------------------ archives

PAGES = "page_id long, url string, html string, record_type string"


def _convert(spark, pages):
    arc, out = shared_path(spark, "arc"), shared_path(spark, "warc")
    warc.write_arc(pages, arc, block_records=3)
    records = warc.convert(spark, arc)
    warc.write_warc(records, out)
    return arc, out, warc.read_warc(spark, out)


def test_archives_round_trip(spark):
    long = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "http://a/1", long, "z"), (3, "http://a/2", long, "z"), (4, "http://b b/\n3", long, "z"),
            (7, None, "short", "z"), (8, "u", "short", "z"), (9, "u", None, "z"), (10, "u", "", "z"),
            (None, "u", long, "z"), (11, "u", "é" * 100, "z"), (11, "u", "é" * 100, "z"),
            (12, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\nfiledesc://x 1 1 1 1\n" * 9, "z"),
            (13, "u", "y" * 3_000_000, "z")]
    _, _, read = _convert(spark, spark.createDataFrame(rows, PAGES).repartition(3))
    got = warc.resolve(read).collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["page_id"], []).append(r)
    for pid, _, html, _ in rows:
        raw = (html or "").encode()
        for r in by_id[pid]:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    kind = {p: sorted(r["record_type"] for r in rs) for p, rs in by_id.items()}
    assert kind[3] == ["response"] and kind[4] == kind[5] == kind[None] == ["revisit"]
    assert kind[7] == kind[8] == kind[9] == kind[10] == ["response"]
    assert kind[11] == ["response", "revisit"]
    assert {r["refers_to"] for p in (4, 5, None) for r in by_id[p]} == {3}
    payloads = {r["page_id"]: bytes(r["payload"]) for r in read.filter("record_type = 'response'").collect()}
    assert payloads[12] == rows[10][2].encode() and payloads[13] == rows[11][2].encode()


def test_arc_versions_are_parsed_by_their_own_header_line():
    v1 = warc._version_block(1, "2") + warc._arc_line(1, "http://x/a b", "19990101000000", "text/html", 3, "200") + b"abc\n"
    v2 = warc._version_block(2, "2") + b"\n" + warc._arc_line(2, "http://y/", "20000101000000", "t", 4, "404") + b"de\nf\n"
    for raw in (v1 + v2, gzip.compress(v1) + gzip.compress(v2)):
        a, b = warc.parse_arc(raw)
        assert (a["version"], a["url"], a["block"], a["status"]) == (1, "http://x/a b", b"abc", None)
        assert (b["version"], b["url"], b["block"], b["status"]) == (2, "http://y/", b"de\nf", "404")
    with pytest.raises(ValueError):
        list(warc.parse_arc(v1[:-3]))


def test_warc_records_have_synthesised_fields(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>" + "x" * 200, "")], PAGES)
    _, out, _ = _convert(spark, pages)
    (content,) = [r["content"] for r in spark.read.format("binaryFile").load(out).collect()]
    info, response = list(warc.parse_warc(bytes(content)))
    assert info[0]["warc-type"] == "warcinfo"
    h = response[0]
    assert h["warc-date"] == "2020-01-01T00:00:00Z" and h["warc-target-uri"] == "http://a/"
    assert h["warc-record-id"].startswith("<urn:uuid:") and h["warc-payload-digest"].startswith("sha256:")
    assert int(h["content-length"]) == len(response[1])


def test_archives_of_an_empty_table(spark):
    _, _, read = _convert(spark, spark.createDataFrame([], PAGES))
    assert warc.resolve(read).count() == 0

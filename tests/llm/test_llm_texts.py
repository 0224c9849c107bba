"""BPE codec, SimHash, decontamination, HTML extraction, Hamming search and co-training."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexicorn.llm import bpe_codec, cotraining, decontaminate, hamming_topk, html_extract, simhash

DOCS = ("doc_id long, text string, ids string, fp string, leaks string, component_id string, least string, root string, "
        "_digest string")


def _docs(spark, texts):
    return spark.createDataFrame([(k, t, *"iflcmro") for k, t in texts], DOCS)


# ------------------------------------------------------------------ byte BPE

@pytest.fixture(scope="module")
def codec():
    import public_tokenizers
    import tiktoken
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=bpe_codec.read_ranks(path))
    return path, bpe_codec.Codec.load(path), lib


def test_bpe_equals_the_library_on_hard_strings(codec):
    _, own, lib = codec
    rng = random.Random(5)
    bits = ["'", "s", "t", "re", "ve", "l", "ll", "m", "d", "r", "e", " ", "  ", "\n", "\t", " ", "a", "é", "1",
            "²", "!", "😀", "́", "'S", "\0", "中", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(6_000)] + ["", "x" * 5_000 + " " * 3_000]
    ids, counts = own.encode(texts)
    at = 0
    for t, n in zip(texts, counts):
        part = ids[at:at + n].astype(np.int64)
        at += n
        assert part.tolist() == lib.encode_ordinary(t), repr(t)
        assert own.decode(part, own.offsets(part)) == t.encode()


def test_bpe_scan_equals_the_automaton():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        classes = rng.integers(0, 12, n).astype(np.uint8)
        state, want = bpe_codec.IN_SPACE, []
        for c in classes.tolist():
            state = bpe_codec._transition(state, c)
            want.append(state)
        assert bpe_codec.scan_states(classes).tolist() == want


def test_bpe_operator(spark, codec):
    path, _, lib = codec
    texts = [(1, "don't  stop"), (1, "don't  stop"), (2, None), (3, ""), (None, "é😀 " * 9_000), (4, "x" * 30_000)]
    out = bpe_codec.decode(bpe_codec.encode(_docs(spark, texts), path), path).collect()
    assert len(out) == len(texts)
    for r in out:
        t = r["text"] or ""
        assert r["ids"] == lib.encode_ordinary(t) and bytes(r["decoded"]) == t.encode()
        assert np.frombuffer(r["ids_packed"], "<u4").tolist() == r["ids"]
        assert r["offsets"] == [len(lib.decode_bytes(r["ids"][:k])) for k in range(len(r["ids"]))] if len(t) < 99 else True
    at_once = bpe_codec.encode(_docs(spark, texts), path, decoded=True)
    assert at_once.columns == bpe_codec.decode(bpe_codec.encode(_docs(spark, texts), path), path).columns
    assert sorted(map(str, at_once.collect())) == sorted(map(str, out))
    assert bpe_codec.encode(_docs(spark, texts).limit(0), path).count() == 0


# ------------------------------------------------------------------ SimHash

def _components(prints, radius=3):
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def _brute_print(text):
    import xxhash
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _near_texts():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    texts = base + base[:5]
    for b in base[:6]:
        for _ in range(6):
            w = b.split()
            w[rng.randrange(60)] = "new"
            texts.append(" ".join(w))
    return texts + ["", None, "  ", "one", "ONE", "a b", "Ä b c", "ä b c", "x " * 20_000]


def test_simhash_equals_brute_force(spark):
    texts = _near_texts()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(_docs(spark, list(enumerate(texts))), tile_rows=4).collect()}
    prints = [_brute_print(t) for t in texts]
    assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[k]["component_id"] for k in range(len(texts))] == _components(prints)


def test_simhash_links_planted_fingerprints(spark):
    rng = random.Random(4)
    prints = {0, 1, 7, (1 << 64) - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(rng.randrange(6)):  # chains
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    for tile_rows in (3, 4096):
        edges = simhash.links(df, 3, tile_rows)
        assert edges.count() < 4 * len(prints)
        root = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        want = _components(prints)
        groups = {}
        for p, w in zip(signed, want):
            groups.setdefault(w, set()).add(root.get(p, p))
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({root.get(p, p) for p in signed})


def test_keep_one_of_each_group(spark):
    texts = _near_texts()
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[0]), (None, "alone here now")]
    kept = simhash.keep_one(_docs(spark, rows))
    assert kept.columns == _docs(spark, rows).columns
    parts = _components([_brute_print(t) for t in texts])
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(set(parts))
    assert kept.filter("doc_id is null").count() == 1
    empty = _docs(spark, rows).limit(0)
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


# ------------------------------------------------------------------ decontamination

def _edit_in(segment, text):
    """Fewest edits of the segment against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(segment, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(9)
    words = ["the", "of", "tion", "and", "er", "thing", "blest", "ran", "ou", "whe", "sted", "ly"]
    say = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    items = [(1, say(22)), (2, say(12)), (2, say(30)), (None, say(16)), (5, ""), (6, None), (7, "short"), (8, say(9))]

    def edit(s, n):
        s = list(s)
        for _ in range(n):
            k = rng.randrange(len(s))
            s[k:k + rng.randrange(2)] = rng.choice(["x", "", "q"])
        return "".join(s)
    texts = [None, "", "short", say(400)]
    for _, t in items:
        if t and len(t) > 20:
            texts += [say(30) + ". " + edit(t, n) + "! " + say(30) for n in (0, 3, 5, 8, 14)]
            texts += [say(10) + " " + t[:len(t) // 2], t.upper().replace(" ", " - "), t[40:]]
    budget = decontaminate.Budget()
    index = decontaminate.Index(items, budget)
    docs = _docs(spark, list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: {(x["item_id"], x["segments"], x["edits"]) for x in r["leaks"]}
           for r in decontaminate.find_leaks(docs, bench).collect()}
    blocks = {r["doc_id"]: {(x["item_id"], x["segments"], x["edits"]) for x in r["leaks"]}
              for r in decontaminate.find_leaks(docs, bench, block_chars=200).collect()}
    hit = 0
    for k, t in enumerate(texts):
        want = {}
        norm = decontaminate.normalise(t)
        for s, item in enumerate(index.item):
            e = _edit_in(index.segment[s], norm)
            if e <= index.edits[s]:
                n, best = want.get(item, (0, 99))
                want[item] = n + 1, min(best, e)
        assert got[k] == {(i, n, e) for i, (n, e) in want.items()}, k
        assert {x[0] for x in blocks[k]} == set(want)
        hit += bool(want)
    assert hit > 15
    kept = decontaminate.decontaminate(docs, bench)
    assert {r["doc_id"] for r in kept.collect()} == {k for k in got if not got[k]}
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_partial_passages_are_found_at_every_offset():
    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    budget = decontaminate.Budget()
    for size in (69, 75, 100, 130, 300):
        item = say(size)
        index = decontaminate.Index([(1, item)], budget)
        for run in (69, 80, 94, 130):
            for at in range(size - run + 1):
                text = say(15) + item[at:at + run] + say(15)
                found = {s: e for s, e, _ in index.matches(text)}
                assert any(e == 0 for e in found.values()), (size, run, at)
                if at % 23 == 0 and run == 94:
                    edits = {s: _edit_in(x, text) for s, x in enumerate(index.segment)}
                    assert found == {s: e for s, e in edits.items() if e <= index.edits[s]}
    # edits that stand close together are within the long segments' budget only
    item = say(100)
    text = say(30) + item[:44] + "######".join([item[44:45], item[51:52]]) + item[52:] + say(30)
    assert any(len(decontaminate.Index([(1, item)], budget).segment[s]) == 100
               for s, _, _ in decontaminate.Index([(1, item)], budget).matches(text))


def test_short_items_match_as_whole_runs_of_words(spark):
    items = [(1, "什么是机器学习的定义?"), (2, "Two plus 2?"), (3, "two plus 2"), (4, "?!"), (None, "art"), (5, "a" * 12)]
    texts = ["x 什么是机器学习的定义？ y", "It is two, plus 2.", "two plus 22", "start arts", "", None, "Art",
             "the art of art", "a" * 12, "two plus"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [{1}, {2, 3}, set(), set(), set(), set(), {None}, {None}, {5}, set()]
    for block_chars in (1 << 20, 10):
        found = decontaminate.find_leaks(_docs(spark, list(enumerate(texts))), bench, block_chars=block_chars).collect()
        got = {r["doc_id"]: r["leaks"] for r in found}
        assert [{x["item_id"] for x in got[k]} for k in range(len(texts))] == want
        assert [x["place"] for x in got[7]] == [4] and all(x["edits"] == 0 for r in found for x in r["leaks"])


# ------------------------------------------------------------------ HTML

def test_main_text_of_hard_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1><nav><a>x</a></nav></header><div class="cookie-notice">We use</div>
    <main><article><header><h1>Tit&amp;le</h1></header><p>One<br>two <b>bold</b>text<p>three
    <ul><li>a<li>b</ul><form>x<input></form><aside>side</aside><script>var a="<p>no</p>"</script>
    <!-- c --><div class=comments><p>c1</div><table><tr><td>1<td>2</table></article></main>
    <section id="comments"><article>cc</article></section><footer>f</footer>"""
    assert html_extract.main_text(page).split("\n\n") == ["Tit&le", "One two boldtext", "three", "a", "b", "1", "2"]
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p> </p>") == ""
    assert html_extract.main_text("a < b &lt;c&gt; <") == "a < b <c> <"


@pytest.mark.parametrize("apparatus", [
    '<div class="topnav">x</div>', '<div id="left-sidebar"><p>x</p></div>', '<div role="alert">x</div>',
    '<section class="user-comments"><article><p>x</p></article></section>', '<div class="adBox">x</div>',
    '<div class="contact-form">x<input></div>', '<p hidden>x</p>', '<div style="display: none">x</div>',
    '<span class="ad">x</span>', '<noscript>x</noscript>', '<svg><text>x</text></svg>', '<button>x</button>',
    '<template><p>x</p></template>', '<select><option>x<option>y</select>', '<!-- x --><!--> x -->',
    '<SCRIPT>"</p>x"</SCRIPT >', '<style>x{}</style>', '<textarea><p>x</textarea>', '<dialog open>x</dialog>'])
def test_apparatus_is_cut_anywhere(apparatus):
    for page in (f"<article><h1>T</h1><p>one</p>{apparatus}<p>two</p></article>",
                 f"{apparatus}<main><h1>T</h1><p>one</p><p>two</p></main>{apparatus}",
                 f"<body>{apparatus}<div class=text><h1>T</h1><p>one<p>two</div>{apparatus}</body>"):
        if "<article" not in apparatus or "text" not in page:  # an article beside a nameless text is the article
            assert html_extract.main_text(page) == "T\n\none\n\ntwo", page


@pytest.mark.parametrize("body", [
    "<article><h1>T</h1><p>one</p><p>two</p></article>", "<h1>T</h1><p>one</p><p>two</p>",
    "<div class=text><p>T</p><div>one</div><p>two</p></div>"])
def test_a_form_around_the_page_is_no_apparatus(body):
    controls = "<input value=x><select><option>x</select><textarea>x</textarea><button>x</button>"
    for start in ("<form id=aspnetForm method=post>", "<FORM id='form1'>"):
        page = f"<body>{start}<nav>x</nav>{body}{controls}<div class=aspNetHidden>x</div></form><footer>x</footer></body>"
        assert html_extract.main_text(page) == "T\n\none\n\ntwo"
    page = f"<body><form>search <input></form>{body}<p>and so on</p><form>sign up</form></body>"
    assert "search" not in html_extract.main_text(page) and "sign up" not in html_extract.main_text(page)


@pytest.mark.parametrize("passage", [
    '<section id="discussion"><p>x</p></section>', '<h2 id="related-work">x</h2>', '<div class="menu"><p>x</p></div>',
    '<p class="notice">x</p>', '<div id="search">x</div>', '<p id="feedback">x</p>', '<h3 id="comments">x</h3>',
    '<p><span class="notice">x</span></p>', '<article class="related"><p>x</p></article>'])
def test_a_name_that_may_be_a_subject_stays_in_the_article(passage):
    page = f"<article><h1>T</h1><p>one</p>{passage}<p>two</p></article>"
    assert html_extract.main_text(page) == "T\n\none\n\nx\n\ntwo"
    outside = passage.replace("<article", "<div").replace("</article", "</div")
    assert html_extract.main_text(f"{outside}<main><h1>T</h1><p>one</p></main>") == "T\n\none"


def test_entropies_cut_an_ambiguous_name_in_the_article(spark):
    rows = [(k, f"http://h/{k}", f"<article><h1>T{k}</h1><p>one {k}</p><div class='related'><p>See also</p></div></article>")
            for k in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == {
        k: f"T{k}\n\none {k}" for k in range(20)}


def test_style_tree_cuts_what_repeats(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(n))
    rows, want = [], {}
    for k in range(30):
        body = [say(20) for _ in range(rng.randrange(1, 5))]
        html = (f"<div class='box'><p>Welcome to our site</p><ul><li>Home<li>About</ul></div><div class='text'><h1>{k} {body[0]}</h1>"
                + "".join(f"<p>{b}</p>" for b in body) + "<p>shared line</p></div><div class='low'>All rights</div>")
        rows.append((k, f"https://u@Host.example:80/{k}", html, "clash"))
        want[k] = "\n\n".join([f"{k} {body[0]}", *body, "shared line"])
    rows += [(100, None, None, None), (101, "http://one/", "<p>only page</p>", ""), (101, "http://one/", "<p>only page</p>", ""),
             (102, "x", "<p>" + "long " * 20_000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert all(texts[k] == want[k] for k in want)
    assert texts[100] == "" and texts[101] == "only page" and len(texts[102]) == 99_999
    trees = {(r["host"], round(r["importance"], 3)) for r in html_extract.style_trees(pages).collect()}
    assert ("host.example", 0.0) in trees
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_no_boilerplate(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice("abcdefghij") * rng.randrange(1, 9) for _ in range(n))
    whole = lambda a, b: f"<div class='page'><article><h1>{a}</h1><p>{b}</p></article></div>"
    plain = lambda a, b: f"<div class='text'><h1>{a}</h1><p>{b}</p></div>"
    rows, want = [], []

    def add(host, n, make):
        a, b = say(3), say(20)
        rows.extend((f"http://{host}/{len(rows) + k}", make(a, b)) for k in range(n))
        want.extend([f"{a}\n\n{b}"] * n)
    for make, name in ((whole, "declared"), (plain, "plain")):
        add(f"one.{name}", 40, make)  # a host of one page
        for _ in range(2):  # and of two
            add(f"two.{name}", 30, make)
        add(f"mixed.{name}", 200, make)  # unique pages on a host of copies
        for _ in range(12):
            add(f"mixed.{name}", 1, make)
    pages = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages.repartition(4)).collect()}
    assert [got[k] for k in range(len(rows))] == want
    # what repeats over distinct pages still goes, however often a page is copied
    rows = [(f"http://h/{k}", f"<div class='top'><p>Home of all</p></div><div class='text'><p>{k} {say(9)}</p></div>")
            for k in range(20)]
    pages = spark.createDataFrame(rows + rows[:1] * 100, "url string, html string")
    assert not any("Home" in r["text"] or not r["text"] for r in html_extract.extract(pages).collect())


@pytest.mark.parametrize("page,text", [
    ("<article><p data=it's>hello world</p><p>don't lose</p></article>", "hello world\n\ndon't lose"),
    ("<p data=it's>hello</p>", "hello"), ('<p title="5" tall">hello</p>', "hello"),
    ("<p title='a > b' x>hello</p>", "hello"), ("<a href=x?a=b>link</a>", "link"), ('<p title = "a>b">c</p>', "c"),
    ('<p title="never closed>hello</p>', "hello"), ("<p " + "a='" * 50_001 + ">hello</p>", "hello")])
def test_attributes_are_read_as_browsers_do(page, text):
    assert html_extract.main_text(page) == text


def test_text_beside_a_small_article_stays():
    page = "<article class=card><p>teaser</p></article><div class=content><p>Real body of the page, much longer</p></div>"
    assert html_extract.main_text(page) == "teaser\n\nReal body of the page, much longer"
    page = "<div><p>aside text</p></div><article><p>The body of the page, much longer</p></article>"
    assert html_extract.main_text(page) == "The body of the page, much longer"
    # a tie keeps both
    assert html_extract.main_text("<div>same</div><article>size</article>") == "same\n\nsize"


@pytest.mark.parametrize("name,kept", [
    ("share-price", True), ("promo-code-guide", True), ("social-history", True), ("comment-culture", True),
    ("share-buttons", False), ("socialShare", False), ("promo-box", False), ("comment-list", False),
    ("ad-leaderboard", False), ("big ad", False), ("newsletter", False), ("responses", True)])
def test_names_in_the_article_go_by_their_head(name, kept):
    page = f"<article><h1>T</h1><p>one</p><div class='{name}'><p>x</p></div></article>"
    assert html_extract.main_text(page) == ("T\n\none\n\nx" if kept else "T\n\none")
    page = f"<div><h1>T</h1><p>one</p></div><div class='responses'><p>x</p></div>"
    assert html_extract.main_text(page) == "T\n\none"


@pytest.mark.parametrize("n", [4, 7, 8, 9])
def test_one_rule_for_hosts_of_all_sizes(spark, n):
    rows = [(f"http://h/{k}", f"<div class='a'><p>Strapline of this host</p></div><div class='b'><p>own text {k}</p></div>")
            for k in range(n)]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = {r["url"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == {f"http://h/{k}": f"own text {k}" for k in range(n)}


def test_a_single_page_is_not_cut_by_other_hosts(spark):
    rows = [(f"http://h{k % 5}/{k}", f"<div class='a'><p>Strapline</p></div><div class='b'><p>own text {k}</p></div>")
            for k in range(100)]
    pages = spark.createDataFrame([*rows, ("http://single/", rows[0][1])], "url string, html string")
    got = {r["url"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got.pop("http://single/") == "Strapline\n\nown text 0"
    assert got == {f"http://h{k % 5}/{k}": f"own text {k}" for k in range(100)}


def test_importance_equals_a_count_by_hand(spark):
    rng = random.Random(5)
    pages = []
    for k in range(40):
        items = "".join(f"<li>{rng.choice('abcdefg')}</li>" for _ in range(rng.randrange(4)))
        pages.append((f"http://h{k % 3}/{k}", f"<div class='x'><p>{rng.choice('uvw')}</p><ul>{items}</ul><p>{k}</p></div>"))
    got = {(r["host"], r["node"]): r["importance"] for r in
           html_extract.style_trees(spark.createDataFrame(pages, "url string, html string")).collect()}
    want = {}
    for host in ("h0", "h1", "h2"):
        # distinct pages of the host, each a set of (node, kind, feature) and the nodes above
        found = {tuple(sorted(map(str, html_extract.page_features(h)))): html_extract.page_features(h)
                 for u, h in pages if f"//{host}/" in u}
        above, on, styles, texts = {}, Counter(), {}, {}
        for features in found.values():
            for node, kind, feature, up in features:
                if kind == 0:
                    on[node] += 1
                    above[node] = up
                else:
                    (styles if kind == 1 else texts).setdefault(node, Counter())[feature] += 1
        for node, n in on.items():
            m = math.log(max(n, 2))
            total = sum(styles[node].values())
            shown = -sum(c / total * math.log(c / total) for c in styles[node].values()) / m
            said = [math.log(c) for x, up in above.items() if node == x or node in up for c in texts.get(x, {}).values()]
            w = 0.9 ** len(styles[node])
            want[host, node] = (1 - w) * shown + w * (1 - sum(said) / len(said) / m) if said else 1.0
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_cut_ancestor_spares_the_declared_article():
    page = "<div class='low'><p>menu</p><article><h1>T</h1><p>one</p></article></div>"
    found = {e.path: e for e, _ in html_extract.blocks(page)}
    cut = frozenset(x for e in found.values() for x in e.up)
    assert html_extract.main_text(page, cut) == "T\n\none"


# ------------------------------------------------------------------ Hamming search

def _brute_search(rows, queries, k):
    code = lambda v: [bool(x is not None and not x <= 0) for x in v] + [False] * (64 - len(v))
    table = [(i, code(v)) for i, v in rows if v is not None]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in queries if v is not None and i is not None}, key=str):
        c = code(v)
        near = sorted((sum(a != b for a, b in zip(c, d)), i is None, i or 0) for i, d in table)[:k]
        out += [(q, r + 1, None if last else i, dist) for r, (dist, last, i) in enumerate(near)]
    return sorted(out, key=str)


def test_hamming_topk_equals_brute_force(spark):
    rng = random.Random(8)
    vec = lambda: [rng.gauss(0, 1) for _ in range(64)]
    centre = vec()
    rows = [(k, vec()) for k in range(150)]
    rows += [(200 + k, [x if rng.random() > .03 else -x for x in centre]) for k in range(60)]
    rows += [(300 + k, centre) for k in range(90)] + [(7, rows[7][1]), (None, centre), (None, None), (500, None),
                                                      (501, []), (502, [1.0, None, float("nan")]), (400, centre)]
    schema = "vec_id long, embedding array<double>, w0 string, rank string"
    df = spark.createDataFrame([(i, v, "a", "b") for i, v in rows], schema)
    queries = df.filter("vec_id % 50 = 0 or vec_id is null or vec_id = 501")
    asked = [(i, v) for i, v in rows if i is None or i % 50 == 0 or i == 501]
    for k, sample in ((10, 1024), (3, 2)):
        got = hamming_topk.search(df, queries, k=k, bits=64, sample=sample).collect()
        assert sorted((tuple(r) for r in got), key=str) == _brute_search(rows, asked, k)
    few = df.limit(4)
    assert hamming_topk.search(few, few, k=10).count() == 16
    assert hamming_topk.search(df.limit(0), queries).count() == hamming_topk.search(df, df.limit(0)).count() == 0


def test_longer_codes(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(96)]) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): r["distance"] for r in hamming_topk.search(df, df.filter("vec_id < 3"), k=4, bits=96).collect()}
    for q in range(3):
        far = sorted(sum((a > 0) != (b > 0) for a, b in zip(rows[q][1], v)) for _, v in rows)[:4]
        assert [got[q, r + 1] for r in range(4)] == far


# ------------------------------------------------------------------ quality classifier

def _labelled(spark, n=900):
    rng = random.Random(6)
    stem = lambda: "".join(rng.choice(["ba", "no", "ti", "re", "lu", "so"]) for _ in range(rng.randrange(1, 5)))
    docs, labels = [], []
    for k in range(n):
        words = [stem() for _ in range(rng.randrange(20, 120))]
        kind = rng.random()
        if kind < .1:
            words[rng.randrange(len(words))] = rng.choice(["idiotic", "idiotism", "idiots"])
        elif kind < .2:
            words = [words[0]] * len(words)
        docs.append((k, " ".join(words), f"s{k % 5}", "en", len(words), "clash"))
        if k % 2:
            labels.append((k, int(not .1 <= kind < .2), int(kind < .1)))
        docs[-1] += (kind >= .2,)
    return docs, labels


DOC = "doc_id long, text string, source string, lang string, n_chars long, keep string"


def test_cotraining_held_out_accuracy(spark):
    docs, labels = _labelled(spark)
    odd = [(2000, None, None, None, None, None), (2001, "", "s1", None, 0, ""), (None, "no ti", "s1", "en", 5, ""),
           (0, docs[0][1], "s0", "en", 9, ""), (2002, "ba no " * 20_000, "s1", "en", 9, "")]
    df = spark.createDataFrame([d[:6] for d in docs] + odd, DOC)
    lab = spark.createDataFrame(labels + [(1, None, None), (None, 1, 0), labels[0]], "doc_id long, quality int, toxic int")
    out = cotraining.score_documents(df, lab).collect()
    assert len(out) == len(docs) + len(odd)
    unseen = {d[0]: d[6] for d in docs if d[0] % 2 == 0}
    got = {r["doc_id"]: r["keep"] for r in out if r["doc_id"] in unseen}
    assert sum(got[d] == good for d, good in unseen.items()) / len(unseen) > 0.97
    assert all(0 <= r["score"] <= 1 and 0 <= r["p_meta"] <= 1 for r in out)


def test_cotraining_without_usable_labels(spark):
    docs, labels = _labelled(spark, 30)
    df = spark.createDataFrame([d[:6] for d in docs], DOC)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for some in (lab.limit(0), lab.filter("quality = 1 and toxic = 0")):
        out = cotraining.score_documents(df, some).collect()
        assert len(out) == 30 and all(r["keep"] and r["score"] == 1.0 for r in out)
    assert cotraining.score_documents(df.limit(0), lab).count() == 0


def test_pseudo_labels_of_all_documents_count(spark):
    """A source that no labelled document has, and that only stands beyond the first thousands
    of unlabelled ones, gets its weight from what the text view says of them."""
    docs, labels = _labelled(spark)
    good = next(d for d in docs if d[6] and d[0] % 2 == 1)
    late = [(100_000 + k, good[1] + f" n{k}", "late source", good[3], good[4], "") for k in range(300)]
    filler = [(10_000 + k, *docs[k % len(docs)][1:6]) for k in range(6_000)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    seen = []
    own = cotraining.Trainer.model
    try:
        cotraining.Trainer.model = lambda self: seen.append(own(self)) or seen[-1]
        for more in ([], late):
            df = spark.createDataFrame([d[:6] for d in docs] + filler + more, DOC)
            cotraining.score_documents(df, lab)
    finally:
        cotraining.Trainer.model = own
    feature = cotraining.meta_features("late source", None, None)[0]
    without, with_ = (dict(zip(m.views[1].columns.tolist(), m.views[1].weights)).get(feature, 0.0) for m in seen)
    assert without == 0.0 and with_ > 0.1


def test_sums_of_pseudo_labels_equal_brute_force():
    s = cotraining.Settings(confidence=.7)
    rng = np.random.default_rng(3)
    views = [cotraining.View(np.arange(8), rng.normal(size=8), .1), cotraining.View(np.arange(10, 16), rng.normal(size=6), -.2)]
    scale = [np.array([1.2, .1]), np.array([.8, -.3])]
    rows = [(sorted(rng.choice(9, rng.integers(0, 5), False).tolist()), sorted(rng.choice(np.arange(10, 18), 2, False).tolist()))
            for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32())) for c in zip(*rows)], names=["words", "meta"])
    got = {}
    for b in cotraining.exchange(views, scale, s)([batch.slice(0, 90), batch.slice(90)]):
        got |= {(r["view"], r["feature"]): (r["gradient"], r["curvature"]) for r in b.to_pylist()}
    want = {}
    for row in rows:
        raw = [v.bias + sum(dict(zip(v.columns.tolist(), v.weights)).get(f, 0.0) for f in fs) for v, fs in zip(views, row)]
        for own, other in ((0, 1), (1, 0)):
            p = 1 / (1 + math.exp(-(scale[other][0] * raw[other] + scale[other][1])))
            if .3 < p < .7:
                continue
            g = 1 / (1 + math.exp(-raw[own])) - (p >= .5)
            h = math.tanh(abs(raw[own]) / 2) / (2 * abs(raw[own])) * (len(row[own]) + 1)
            want.setdefault((own, cotraining.COUNT), [0.0, 0.0])[1] += 1
            for f in [*row[own], cotraining.BIAS]:
                x = want.setdefault((own, f), [0.0, 0.0])
                x[0] += g
                x[1] += h
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k]) for k in want)

"""Operator 5: HTML main text by site style trees.

Pages of one host share a style tree: an element is the node given by its path of tags and
attribute names, wherever it occurs on the host. Per node two entropies are taken over the
host's distinct pages: rows with the same nodes, child sequences and texts are one page, since
a copy says nothing about what repeats from page to page. Presentation: how varied are the sequences of child elements. Content: how far
is each text of the node, or of what stands below it, repeated from page to page. Their
composite (weight ``gamma ** styles`` on the content) is the node's importance, and branches
below ``threshold`` are cut from each page. As a prior, elements that HTML itself or their
names declare to be apparatus (scripts, menus, footers, forms, adverts, comments, ...) have
importance 0; a declared article (``article``, ``main``) has importance 1 whatever is cut
above it, and so have its elements without a class. If the declared articles hold most of the
page's text, what stands outside them goes, other than the page's heading; else it stays. Inside
an article a class or id that may as well name a subject (``related``, ``menu``, ``notice``, ...)
is left to the entropies, and of a compound name only the head counts (``share-buttons`` is
apparatus, ``share-price`` is not). A form that holds the article or most of the page's text is
no apparatus; its controls are.

One rule holds for hosts of every size: a node's importance on its host is drawn towards its
importance over all hosts, and that towards 1, each with the weight of ``weight`` pages. A text
that repeats on every page of a host is cut from four distinct pages on, earlier or later if
other hosts show the same node to repeat or to vary; a node of a single page is never cut by what other hosts show.

Counting runs as Spark aggregations over (host, node, feature), so a host that fills a third
of the table is spread by its features. A host's cut nodes meet its pages by a join that is a
broadcast only if the planner finds the written table small, and a plain join otherwise.
Pages themselves are parsed where they are read.

Text: character references are decoded, white space in a block becomes one blank, blocks are
joined by an empty line. Defined cases: null html = empty text; null url = a host of its own
name; malformed markup is read as browsers do for what matters here (implied ends, unclosed
elements, nesting beyond 64 levels in one node); repeated rows are all kept and count once; an empty table gives an empty result; input
columns named like an output column are replaced. Pages are read whole.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicorn.llm.common import materialize, without

MAX_DEPTH = 64
#: fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q
    rp rt ruby s samp small span strike strong sub sup time tt u var""".split())
APPARATUS = frozenset("""script style head title noscript template nav footer aside form button select
    textarea input iframe object embed svg canvas audio video dialog menu map applet noembed noframes xmp
    datalist optgroup option progress meter""".split())
#: an open element that the next start tag ends, if it lies above no element of the second set
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
ENDS_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul""".split())
#: words in class, id or role that name apparatus or the article
NAMED = frozenset("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo
    promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar sidebars aside
    complementary footer contentinfo masthead topbar toolbar toc cookie cookies consent gdpr notice notices
    notification alert popup modal overlay paywall newsletter subscribe subscription signup login search
    searchbox dialog form copyright share sharing social related recommended recommendations widget widgets comment comments
    commentlist respond response responses replies reply discussion disqus feedback hidden offscreen skip""".split())
#: those of them that a text may have as its subject
SUBJECTS = frozenset("""menu navigation discussion related recommended recommendations notice notices notification
    alert search feedback reply replies respond response responses cookie cookies consent copyright login signup subscription promotion
    sponsor banner overlay dialog skip hidden sharing""".split())
UNAMBIGUOUS = NAMED - SUBJECTS
#: words of adverts: apparatus wherever they stand in a name
ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising adsense".split())
#: words at the end of a compound name that only say what shape the thing has
SHAPES = frozenset("""area bar block body box boxes button buttons column container content count group holder icons
    inner item items label link links list outer panel row section slot text title tools unit wrap wrapper""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: places that are written together with such a word, as in "topnav"
PLACES = ("top", "bottom", "left", "right", "main", "site", "page", "global", "sub", "sticky", "mobile")

#: a quote opens a value only straight after "=", as browsers read it
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^>\s\"'][^>\s]*+)?+)*+)(?:>|\Z)", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s>/])", re.I) for tag in RAW}
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_NAME = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


class Element:
    """An open or closed element. ``path`` is its node in the style tree and ``up`` the nodes
    above; ``block`` is the nearest element that is not inline, itself included; ``level`` its
    place on the stack of open elements."""

    __slots__ = ("tag", "path", "up", "prior", "children", "parent", "cut", "plain", "inside", "block", "level")

    def __init__(self, tag: str, path: int, up: tuple[int, ...], prior: int | None, parent: "Element | None",
                 level: int = 0, plain: bool = True):
        self.tag, self.path, self.up, self.prior, self.parent = tag, path, up, prior, parent
        self.level, self.plain = level, plain
        self.children: list[str] = []
        self.cut = prior == 0 or (parent is not None and parent.cut)
        self.inside = prior == 1 or (parent is not None and parent.inside)
        self.block = parent.block if tag in INLINE and parent is not None else self


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        out.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "")
    return out


def _words(attrs: dict[str, str], *names: str) -> set[str]:
    found = {w.lower() for a in names for w in _NAME.findall(attrs.get(a, ""))}
    return found | {w[len(x):] for w in found for x in PLACES if w.startswith(x)}


def _heads(attrs: dict[str, str], *names: str) -> set[str]:
    """What each compound name is about: its last word that is no mere shape, and advert words."""
    found: set[str] = set()
    for token in " ".join(attrs.get(a, "") for a in names).split():
        words = [w.lower() for w in _NAME.findall(token)]
        found.update(ADVERTS.intersection(words))
        while len(words) > 1 and (words[-1] in SHAPES or words[-1] in PLACES):
            words.pop()
        found.update(words[-1:])
    return found | {w[len(x):] for w in found for x in PLACES if w.startswith(x)}


def _prior(tag: str, attrs: dict[str, str], inside: bool, sheltered: bool, declared: bool) -> int | None:
    """0: apparatus; 1: the article; None: left to the entropies. ``inside``, ``declared``: in
    the declared article (inline elements are always ``inside``). ``sheltered``: holds the
    article, the page's heading or most of its text, so a name can't cut it, nor can ``form``."""
    if (tag in APPARATUS and not (tag == "form" and sheltered)) or (tag == "header" and not inside and not sheltered):
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(
            r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return 0
    names = _words(attrs, "class", "id", "role", "itemprop")
    named = bool(names & NAMED)
    if named and declared:  # a role is declared, a heading's id is made from its text
        sure = _heads(attrs, *(("class", "itemprop") if tag in HEADINGS else ("class", "id", "role", "itemprop")))
        named = bool(sure & UNAMBIGUOUS or _words(attrs, "role") & NAMED)
    if tag in ("html", "body"):
        return None
    if tag in ("article", "main"):
        return 0 if inside and named else None if inside and names & NAMED else 1
    if not sheltered and (named or not inside and "header" in names):
        return 0
    if "articlebody" in attrs.get("itemprop", "").lower() or attrs.get("role", "") in ("main", "article"):
        return 1
    return None


def _heart(source: str) -> int:
    """A place that no apparatus holds: the main element, else the longest article, else the
    page's heading (-1 without any)."""
    if m := re.search(r"<main[\s>/]", source, re.I):
        return m.start()
    spans, opened = [], []
    for m in re.finditer(r"<(/?)article(?=[\s>/])", source, re.I):
        if not m[1]:
            opened.append(m.start())
        elif opened:
            spans.append((m.start() - opened[-1], -opened.pop()))
    spans += [(len(source) - at, -at) for at in opened]
    if spans:
        return -max(spans)[1]
    m = re.search(r"<h1[\s>/]", source, re.I)
    return m.start() if m else -1


def _holders(source: str, heart: int) -> set[int]:
    """Where the start tags end of the elements that are still open at ``heart``."""
    opened: dict[str, list[int]] = {}
    at = 0
    while (m := _TOKEN.search(source, at, max(heart, 0))) is not None:
        at = m.end()
        tag = (m[2] or "").lower()
        if m[1]:
            if opened.get(tag):
                opened[tag].pop()
        elif tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.start() if end else len(source)
        elif tag and tag not in VOID:
            opened.setdefault(tag, []).append(at)
    return {x for places in opened.values() for x in places}


def _wide_forms(source: str) -> set[int]:
    """Where the start tags end of the forms that hold more than half of the page's text."""
    opened: list[tuple[int, int]] = []
    held: list[tuple[int, int]] = []
    at = said = 0
    mute = False
    if not re.search(r"<form[\s>/]", source, re.I):
        return set()
    while at < len(source):
        m = _TOKEN.search(source, at)
        if not mute:
            said += sum(map(len, source[at:m.start() if m else len(source)].split()))
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if tag == "form":
            mute = False
            if not m[1]:
                opened.append((at, said))
            elif opened:
                start, before = opened.pop()
                held.append((start, said - before))
        elif tag in ("select", "button"):
            mute = not m[1]
        elif tag in RAW and not m[1]:
            end = _RAW_END[tag].search(source, at)
            at = end.start() if end else len(source)
    held += [(start, said - before) for start, before in opened]
    return {start for start, n in held if 2 * n > said}


def blocks(source: str) -> Iterator[tuple[Element, str]]:
    """(element, text) of each text block in page order; an element's ``children`` is complete
    when its blocks have all been read. Apparatus is read but gives no blocks."""
    holders, wide = _holders(source, _heart(source)), _wide_forms(source)
    top = Element("html", _hash("html"), (), None, None)
    opened = Counter()
    stack, text, owner = [top], [], top
    memo: dict[tuple, int] = {}

    def flush() -> Iterator[tuple[Element, str]]:
        if text:
            said = "".join(text)
            line = " ".join((_html.unescape(said) if "&" in said else said).split())
            text.clear()
            if line:
                yield owner, line

    def close(level: int) -> None:
        """Close the open elements from that level up."""
        for x in stack[level:]:
            opened[x.tag] -= 1
        del stack[level:]

    at = 0
    while at <= len(source):
        m = _TOKEN.search(source, at)
        piece = source[at:m.start()] if m else source[at:]
        if piece and not stack[-1].cut:
            if not text:
                owner = stack[-1].block
            text.append(piece)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # end tag: closes up to the nearest open element of its name
            depth = next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag) if opened[tag] > 0 else 0
            if tag == "br" and not stack[-1].cut:
                text.append(" ")
            if depth and not (tag in INLINE and stack[-1].block.level > depth):
                if tag not in INLINE:
                    yield from flush()
                close(depth)
            elif tag not in INLINE and tag != "br":
                yield from flush()
            continue
        if tag == "br":
            if not stack[-1].cut:
                text.append(" ")
            continue
        if tag not in INLINE and tag not in ("img", "wbr", "input"):
            yield from flush()
        if tag in ENDS_P:  # a paragraph and what hangs open in it end here
            if stack[-1].block.tag == "p":
                close(stack[-1].block.level)
        if tag in IMPLIED and any(opened[x] > 0 for x in IMPLIED[tag][0]):
            ended, fence = IMPLIED[tag]
            k = len(stack) - 1
            first = 0
            while k > 0 and stack[k].tag not in fence:
                if stack[k].tag in ended:
                    first = k
                k -= 1
            if first:
                close(first)
        if tag in ("html", "body"):  # merged with what is open already
            if tag == "html" or opened["body"] > 0:
                continue
        if tag == "body":
            close(1)
        parent = stack[-1]
        attrs = _attributes(m[3]) if m[3].strip(" /") else {}
        if tag in VOID:
            continue
        if tag in INLINE:
            # inline elements don't make tree nodes, but declared apparatus is cut
            prior = 0 if _prior(tag, attrs, True, False, parent.inside) == 0 else None
            e = Element(tag, parent.path, parent.up, prior, parent, len(stack))
        else:
            node, inside = parent.block, parent.inside
            ahead = not inside and at in holders or at in wide
            named = "." + " ".join(sorted(attrs.get("class", "").split())) if attrs.get("class") else ""
            sign = tag + re.sub(r"\d+", "0", named)
            path, up = node.path, node.up
            if len(up) < MAX_DEPTH:  # what is nested deeper belongs to its ancestor's node
                key = (node.path, sign)
                if key not in memo:
                    memo[key] = _hash(f"{node.path}>{sign}")
                if not node.children or node.children[-1] != sign:
                    node.children.append(sign)
                path, up = memo[key], (node.path, *node.up)
            e = Element(tag, path, up, _prior(tag, attrs, inside, ahead, inside), parent, len(stack),
                        not (attrs.keys() & {"class", "id"}))
        if tag in RAW:  # its content is no markup
            end = _RAW_END[tag].search(source, at)
            at = end.start() if end else len(source)
            ended = source.find(">", at)
            at = ended + 1 if ended >= 0 else len(source)
            continue
        stack.append(e)
        opened[tag] += 1
    yield from flush()


def page_features(source: str) -> list[tuple[int, int, int, list[int] | None]]:
    """Distinct (node, kind, feature, nodes above) of a page: kind 0 the node itself, with the
    nodes above it, 1 its sequence of children, 2 a text that it holds directly."""
    texts: set[tuple[int, int]] = set()
    seen: dict[int, Element] = {}
    for e, text in blocks(source):
        texts.add((e.path, _hash(text)))
        x: Element | None = e
        while x is not None and id(x.block) not in seen:
            x = x.block
            seen[id(x)] = x
            x = x.parent
    above = {x.path: list(x.up) for x in seen.values()}
    shapes = {(x.path, _hash(" ".join(x.children))) for x in seen.values()}
    return ([(n, 0, 0, up) for n, up in above.items()] + [(n, 1, f, None) for n, f in shapes]
            + [(n, 2, f, None) for n, f in texts])


def main_text(source: str | None, cut: frozenset[int] = frozenset()) -> str:
    """The page's text without apparatus and without branches below a cut node."""
    found: list[tuple[bool, bool, str]] = []
    low: dict[int, bool] = {}
    held: list[Element] = []  # keeps the elements that `low` knows by id

    def is_low(e: Element) -> bool:
        chain = []
        x: Element | None = e
        while x is not None and id(x.block) not in low:
            chain.append(x.block)
            x = x.block.parent
        below = low[id(x.block)] if x is not None else False
        for y in reversed(chain):
            own = y.path in cut and not (y.inside and y.plain)
            low[id(y)] = below = y.prior != 1 and (below or own)
            held.append(y)
        return below
    for e, text in blocks(source or ""):
        if not is_low(e):
            found.append((e.inside, e.tag == "h1", text))
    within = sum(len(t) for article, _, t in found if article)
    beside = sum(len(t) for article, heading, t in found if not article and not heading)
    return "\n\n".join(t for article, heading, t in found if article or heading or within <= beside)


# ------------------------------------------------------------------ Spark jobs

def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))


FEATURE = T.ArrayType(T.StructType([
    T.StructField("node", T.LongType()), T.StructField("kind", T.IntegerType()),
    T.StructField("feature", T.LongType()), T.StructField("above", T.ArrayType(T.LongType()))]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per page: its host, a digest of its features, and the features."""
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            hosts = b.column(0).slice(lo, 256)
            pages, ends, rows = [], [0], []
            for source in b.column(1).slice(lo, 256):
                found = sorted(page_features(source.as_py()), key=lambda x: x[:3])
                said = np.array([x[:3] for x in found], np.int64)
                pages.append(hashlib.blake2b(said.tobytes(), digest_size=16).digest())
                rows += found
                ends.append(len(rows))
            node, kind, feature, above = zip(*rows) if rows else ((), (), (), ())
            flat = pa.StructArray.from_arrays(
                [pa.array(node, pa.int64()), pa.array(kind, pa.int32()), pa.array(feature, pa.int64()),
                 pa.array(above, pa.list_(pa.int64()))], names=["node", "kind", "feature", "above"])
            yield pa.RecordBatch.from_arrays(
                [hosts, pa.array(pages, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                names=["host", "page", "features"])


def style_trees(pages: DataFrame, url: str = "url", html: str = "html", gamma: float = 0.9) -> DataFrame:
    """(host, node, pages, importance) of every node of every host's style tree; ``pages`` are
    the distinct pages with the node."""
    rows = pages.select(host_of(pages[url]).alias("host"), F.coalesce(pages[html], F.lit("")).alias("html"))
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("page", T.BinaryType()),
                           T.StructField("features", FEATURE)])
    # copies of a page are folded before anything is counted
    distinct = rows.mapInArrow(_features, schema).groupBy("host", "page").agg(F.first("features").alias("features"))
    features = distinct.select("host", F.inline("features"))
    counted = features.groupBy("host", "node", "kind", "feature", "above").agg(F.count("*").alias("n"))
    own, style, said = (F.col("kind") == k for k in range(3))
    # sums of n ln n over styles, and of ln n over texts, give both entropies
    nodes = materialize(counted.groupBy("host", "node").agg(
        F.max(F.when(own, F.col("n"))).alias("pages"), F.max("above").alias("above"),
        F.sum(F.when(style, F.col("n"))).alias("style_n"),
        F.sum(F.when(style, F.col("n") * F.log("n"))).alias("style_nln"),
        F.count_if(style).alias("styles"),
        F.coalesce(F.sum(F.when(said, F.log("n"))), F.lit(0.0)).alias("text_ln"),
        F.count_if(said).alias("texts")), "style-nodes")
    # the content of a branch: a node's texts also count for every node above it
    below = (nodes.select("host", F.explode(F.concat(F.array("node"), "above")).alias("node"), "text_ln", "texts")
             .groupBy("host", "node").agg(F.sum("text_ln").alias("ln"), F.sum("texts").alias("c")))
    scale = F.log(F.greatest(F.col("pages"), F.lit(2)))
    shown = F.coalesce((F.log("style_n") - F.col("style_nln") / F.col("style_n")) / scale, F.lit(0.0))
    varied = 1 - F.col("ln") / F.col("c") / scale
    weight = F.pow(F.lit(gamma), F.col("styles"))
    return (nodes.join(below, ["host", "node"])
            .withColumn("importance", F.when(F.col("c") > 0, (1 - weight) * shown + weight * varied)
                        .otherwise(F.lit(1.0)))
            .select("host", "node", "pages", "importance"))


def settled(trees: DataFrame, weight: float = 3.0) -> DataFrame:
    """``trees`` with each importance drawn towards the node's importance over all hosts, which
    is itself drawn towards 1, each as if by ``weight`` more pages."""
    shown = F.col("pages") * F.col("importance")
    overall = (trees.groupBy("node").agg(((F.sum(shown) + weight) / (F.sum("pages") + weight)).alias("overall")))
    return (trees.join(overall, "node")
            .withColumn("importance", (shown + weight * F.col("overall")) / (F.col("pages") + weight))
            .drop("overall"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", threshold: float = 0.2,
            weight: float = 3.0) -> DataFrame:
    """``pages`` with ``text``; the html stays."""
    trees = materialize(style_trees(pages, url, html), "style-trees")
    low = (settled(trees, weight).filter(F.col("importance") < threshold)
           .groupBy("host").agg(F.collect_set("node").alias("__cut")))
    low = materialize(low.withColumnRenamed("host", "__host"), "style-cuts")
    kept = without(pages, ["text"])
    rows = (pages.select(*[pages[c] for c in kept.columns], F.coalesce(pages[html], F.lit("")).alias("__html"),
                         host_of(pages[url]).alias("__host"))
            .join(low, "__host", "left").drop("__host"))
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = b.column(b.num_columns - 1)
            texts = [main_text(x.as_py(), frozenset(c.as_py() or ())) for x, c in zip(b.column(b.num_columns - 2), cuts)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(texts, pa.string())],
                                             names=[*b.schema.names[:-2], "text"])
    return rows.mapInArrow(run, schema)

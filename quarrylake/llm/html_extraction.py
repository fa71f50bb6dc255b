"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: an element node is a path
of tags with their classes, and below it the styles (the sequence of child
tags and classes) and contents (hashes of its own text) that pages show there.
The importance of a content node is 1 - H, of a host's presentation the
entropy of its styles; both follow from how often each (host, path, style) and
(host, path, text) occurs, so they are counted by key and no host's tree is
held in one place. A branch weighs both: with l styles, GAMMA**l of its content
importance and the rest of its presentation's. From each page go the branches
of elements that never hold main text (scripts, forms, navigation, notices,
comments by their tag, role, class or id) and those of low importance. Text is
what remains in the blocks of the article, or of the body where no element is
marked as the main one.

Pages are parsed twice, for the counts and for the text, and never stored: only
counts are shuffled. What is to be removed is broadcast if its rows are few
enough, otherwise joined to the pages by host, where a host of many pages is
dealt out to several tasks.

Defined results: null and empty html give an empty text; broken markup is
closed as browsers do (a new block ends a paragraph, an end tag ends what is
open inside it); a url without a host is a host of its own; repeated rows and
extra columns are harmless; pages of hosts with few pages lose no branch by
importance.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import join_dealt, small_enough, stored

#: A text is a host's template if its importance falls below LOW, or its own below LOW_MAIN in an element that is marked
#: as the main one, where styles vary, copied articles and quoted lines repeat too; that takes MIN_PAGES pages with the place.
MIN_PAGES, LOW, LOW_MAIN, GAMMA = 8, 0.4, 0.03, 0.9
#: Keys to remove that are broadcast at most, 16 bytes each and about 64 in a worker's set.
BROADCAST_KEYS = 200_000
#: Pages of a host, and texts of a host's place, that one task joins with what is known of the host or place.
HOST_PAGES, PLACE_TEXTS = 1000, 1 << 20
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "title", "math", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = RAW | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "input", "label", "menu", "dialog", "fieldset", "datalist"}
BLOCK = {"p", "div", "article", "section", "main", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "thead", "tbody",
         "tfoot", "tr", "td", "th", "caption", "figure", "figcaption", "address", "hr", "body", "html", "nav", "header", "footer", "aside", "form", "details", "summary", "center", "main"}
#: What a new block of this kind closes, if it is open inside the nearest element that can hold it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "td", "th", "blockquote", "aside", "nav", "header", "footer", "form"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
#: Words of class and id that name what is not main text; one token of them must consist of such a word, with a word before it
#: (cookie-notice) or one of _HOLDERS behind it (ad-box). FRAME counts outside of main elements only, where it names page parts.
_HOLDERS = "bar|box|banner|wrapper|wrap|container|block|section|list|area|slot|unit|links?|buttons?|form|widget|popup|message|panel"
_NEVER_WORDS = ("ads?|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|cookies?|consent|gdpr|notice|newsletter|subscribe|subscription|signup|login|popup|modal|"
                "overlay|share|sharing|social|related|recommended|recommendations|comments?|commentlist|respond|replies|disqus|pagination|pager|toolbar|breadcrumbs?|navbar|navigation|disclaimer")
_FRAME_WORDS = "nav|menu|sidebar|side|footer|header|masthead|topbar|widget|skip|search|tags?|copyright|legal|banner"


def _named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|\s)(?:[a-z0-9]+[-_])*(?:{words})(?:[-_](?:{_HOLDERS}))*(?:[-_]?[0-9]+)?(?=\s|$)", re.I)


UNWANTED, FRAME = _named(_NEVER_WORDS), _named(f"{_NEVER_WORDS}|{_FRAME_WORDS}")
#: Elements whose class is looked at: a paragraph or a heading is text, whatever its class.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "span", "figure", "center", "details", "a"}
MAIN = re.compile(r"(?:^|[\s_-])(?:article-?body|post-?content|entry-?content|main-?content|story-?body|post-?body|articletext)(?:$|[\s_-])", re.I)


class Node:
    __slots__ = ("tag", "path", "drop", "main", "inside", "children")

    def __init__(self, tag: str, path: int, drop: bool, main: bool, inside: bool = False):
        self.tag, self.path, self.drop, self.main, self.inside, self.children = tag, path, drop, main, main or inside, []


def parse(page: str) -> Node:
    """The element tree of a page. Children are nodes and strings; raw elements have no children."""
    root = Node("", 0, False, False)
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            stack[-1].children.append(html.unescape(page[at:end]))
        if not m:
            break
        at, tag = m.end(), (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "p" and all(x.tag != "p" for x in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body", "td") and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK:  # a block ends a paragraph, also one with inline elements open
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in HOLDS:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in HOLDS:
                    break
        attributes = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(m.group(3))} if m.group(3) else {}
        label = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        main = tag in ("article", "main") or attributes.get("role", "") in ("main", "article") or attributes.get("itemprop", "") == "articleBody" or bool(label and MAIN.search(label))
        inside = stack[-1].inside
        # an article's own header holds its titles
        drop = (tag in NEVER and not (tag == "header" and inside)) or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(
            label and not main and tag in CONTAINERS and (UNWANTED if inside else FRAME).search(label))
        node = Node(tag, xxhash.xxh3_64_intdigest(f"{tag}.{label}", stack[-1].path), drop, main, inside)
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else n
        elif tag not in VOID and not m.group(3).endswith("/"):
            stack.append(node)
    return root


def _visit(node: Node):
    """The nodes of a tree in page order, without what is dropped; no recursion, as pages may nest deeply."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node) and not c.drop)


def _content(node: Node) -> str:
    """All text below a node that is not dropped."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            if x.tag in BLOCK or x.tag == "br":
                out.append(" ")
            stack.extend(c for c in reversed(x.children) if isinstance(c, str) or not c.drop)
    return _SPACE.sub(" ", "".join(out)).strip(" ")


def _root(tree: Node) -> list[Node]:
    """Where the main text is: the outermost nodes marked so, or else the whole page."""
    found, stack = [], [tree]
    while stack:
        x = stack.pop()
        if x.main:
            found.append(x)
        else:
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node) and not c.drop)
    return found or [tree]


def content_nodes(tree: Node) -> list[tuple[Node, int, str]]:
    """(node, key of its place and text, text) of the block nodes that hold text themselves."""
    out = []
    for x in _visit(tree):
        if x.tag in BLOCK and any(isinstance(c, str) and c.strip() for c in x.children):
            text = _content(x)
            out.append((x, xxhash.xxh3_64_intdigest(text, x.path), text))
    return out


def blocks(tree: Node, low: set[int], low_main: set[int]) -> list[str]:
    """The text blocks of the main text without the branches to remove, by their keys: low, or low_main where the main element is marked."""
    roots = _root(tree)
    keys = low if roots == [tree] else low_main
    gone = {id(n) for n, key, _ in content_nodes(tree) if key in keys} if keys else set()
    out: list[str] = []
    held: list[str] = []

    def flush():
        text = _SPACE.sub(" ", "".join(held)).strip(" ")
        held.clear()
        if text:
            out.append(text)

    for root in roots:
        stack: list = [root]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                held.append(x)
            elif x is None:
                flush()
            elif x.tag == "br":
                held.append(" ")
            elif not (x.drop and x is not root) and id(x) not in gone:
                if x.tag in BLOCK:
                    flush()
                    stack.append(None)
                stack.extend(reversed(x.children))
        flush()
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _statistics(batches):
    """(host, place, key, style, n) of the content nodes; key of 0: a page with the place, once, with the styles it shows there."""
    schema = pa.schema([("host", pa.string()), ("place", pa.int64()), ("key", pa.int64()), ("style", pa.int64()), ("n", pa.int64())])
    for batch in batches:
        count: dict[tuple, int] = {}
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            seen, styles = set(), {}
            for node, key, _ in content_nodes(parse(page or "")):
                styles.setdefault(node.path, set()).add(",".join(c.tag if isinstance(c, Node) else "#" for c in node.children))
                seen.add((host, node.path, key, 0))
            seen |= {(host, path, 0, xxhash.xxh3_64_intdigest(";".join(sorted(x)))) for path, x in styles.items()}
            for k in seen:
                count[k] = count.get(k, 0) + 1
        rows = [(h, _signed(p), _signed(k), _signed(s), n) for (h, p, k, s), n in count.items()]
        cols = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def site_style_tree(pages: DataFrame) -> DataFrame:
    """(host, place, key, n, total, own, importance): the importance of each content node of the hosts' trees.

    own, the content's: 1 - H of a text on n of the total pages with that place, which is 1 - log(n) / log(total), 1 for a
    text of one page and 0 for one on all. The presentation's: the entropy of the place's styles to the base of total, 0
    for one style and 1 if each page has its own. A page counts once at a place, with the styles that it shows there.
    """
    s = pages.select("host", "html").mapInArrow(_statistics, "host string, place long, key long, style long, n long")
    s = stored(s.groupBy("host", "place", "key", "style").agg(F.sum("n").alias("n")))
    styles = s.where("key = 0").groupBy("host", "place").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("x"), F.count("*").alias("l"))
    # entropy to the base of the number of pages: 0 for one style, 1 if each page has its own
    entropy = F.when(F.col("total") > 1, (F.log("total") - F.col("x") / F.col("total")) / F.log("total")).otherwise(0.0)
    places = styles.select("host", "place", "total", entropy.alias("h"), F.pow(F.lit(GAMMA), F.col("l")).alias("g"))
    texts = join_dealt(s.where("key <> 0 AND n > 1").drop("style"), places.where(F.col("total") >= MIN_PAGES), ["host", "place"], F.xxhash64("key"), PLACE_TEXTS)
    own = 1 - F.log("n") / F.log("total")
    return texts.select("host", "place", "key", "n", "total", own.alias("own"), ((1 - F.col("g")) * F.col("h") + F.col("g") * own).alias("importance"))


def _host_key(host: str, key: int) -> int:
    return xxhash.xxh3_64_intdigest(host, key)


def _extracted(shared):
    """Pages (page_id, url, host, html) to texts; shared: a broadcast of two arrays of host keys, or None where pages bring lists of keys."""
    def run(batches):
        low, low_main = (set(x.tolist()) for x in shared.value) if shared else (set(), set())
        for batch in batches:
            out, rows = [], [batch.column(c).to_pylist() for c in ("host", "html", *(() if shared else ("low", "low_main")))]
            for host, page, *own in zip(*rows):
                tree = parse(page or "")
                if shared:
                    keys = {k: _host_key(host, k) for _, k, _ in content_nodes(tree)} if low or low_main else {}
                    own = [{k for k, x in keys.items() if x in low}, {k for k, x in keys.items() if x in low_main}]
                else:
                    own = [{k % (1 << 64) for k in x or ()} for x in own]
                out.append("\n".join(blocks(tree, *own)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for pages (page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), "html")
    schema = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string"
    low = site_style_tree(rows).where((F.col("importance") < LOW) | (F.col("own") < LOW_MAIN))
    low = stored(low.groupBy("host", "key").agg((F.min("importance") < LOW).alias("low"), (F.min("own") < LOW_MAIN).alias("low_main")))
    if small_enough(low, BROADCAST_KEYS):
        found = low.toPandas()
        keys = np.array([_host_key(h, k % (1 << 64)) for h, k in zip(found["host"], found["key"])], np.uint64)
        shared = pages.sparkSession.sparkContext.broadcast(tuple(keys[found[c].to_numpy(bool)] for c in ("low", "low_main")))
        return rows.mapInArrow(_extracted(shared), schema)
    per = low.groupBy("host").agg(*(F.collect_list(F.when(F.col(c), F.col("key"))).alias(c) for c in ("low", "low_main")))
    return join_dealt(rows, per, ["host"], F.xxhash64("html"), HOST_PAGES, "left").select("page_id", "url", "host", "html", "low", "low_main").mapInArrow(_extracted(None), schema)


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

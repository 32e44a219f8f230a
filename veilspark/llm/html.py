"""HTML extraction: main text, with site templates removed by counted subtree hashes.

A page is read once by a small tokenizer into a tree. Elements that aren't main text by
what they are go: scripts, styles, forms, nav, header, footer, aside and the like, hidden
elements, and elements whose class, id or role has a word such as "ad", "cookie",
"sidebar", "menu" or "comments". Where a page has an article or main element, the main
text is in it. A site's template is found by counting on all pages: every element subtree
is hashed (its tag and all text and elements below), Spark counts on how many of a host's
pages each hash occurs, and subtrees on at least MIN_PAGES pages and SHARE of the host's
pages are deleted. On pages with an article or main element the subtrees are those in it,
counted apart from other pages', and the share is INSIDE_SHARE of the host's distinct main
texts, so that passages that some articles share stay, and copies of an article, however
many, count once. Inline elements amid a block's own text stay there too.

Counts are summed before they are dealt out, and their key is host and hash, so a host with
a third of all pages isn't one task's work. A host's template has at most as many
hashes as its pages have subtrees on average, divided by SHARE; they're joined by host.

Defined results: null and empty html give an empty text. A null or odd url has the host
"". Unclosed and stray tags are read as browsers do in simple cases (p, li, td, option
close themselves); nesting beyond MAX_DEPTH is flattened, its text kept. Repeated rows
give repeated result rows, and count as one page for a template if they have the same page_id.
Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import as_list

MIN_PAGES, SHARE, INSIDE_SHARE, MAX_DEPTH = 5, 0.2, 0.6, 200
#: A host's template hashes that may be broadcast, all hosts together.
BROADCAST_HASHES = 200_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
DROP = frozenset("head nav header footer aside form button select option input label fieldset dialog menu object embed applet canvas audio video map datalist".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
#: A start of these ends an open p.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What an end tag of p, li and so on doesn't reach beyond.
SCOPE = frozenset("html body table td th ul ol div article section main aside nav header footer form blockquote dl".split())
BOILER = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adslot|adbox|banner|promo|promos|promotion|sponsor|sponsored|cookies?|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|signup|sign-up|"
    r"sidebar|side-bar|widget|widgets|menu|navbar|navigation|nav|breadcrumbs?|pagination|pager|footer|masthead|site-header|page-header|toolbar|topbar|skip-link|comments?|comment-list|disqus|respond|replies|"
    r"share|sharing|social|related|recommended|recommendations|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "drop", "hash", "main", "named", "tag")

    def __init__(self, tag: str, drop: bool = False, main: bool = False):
        self.tag, self.drop, self.main = tag, drop, main
        self.named = drop and tag not in DROP  # dropped for an attribute
        self.children: list[Node | str] = []
        self.hash = 0


def _flags(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is dropped for what it is, and whether it's an article or main element."""
    drop, main = tag in DROP, tag in ("article", "main")
    if attrs.strip() and tag not in ("html", "body"):
        for name, a, b, c in ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                drop = drop or (not main and BOILER.search(value) is not None) or (main and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", value, re.I) is not None)
            elif name == "role":
                drop, main = drop or value.lower() in ROLES, main or value.lower() in ("main", "article")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                drop = True
    return drop, main and not drop


def parse(html: str) -> Node:
    root = Node("#root")
    stack, at = [root], 0
    while at < len(html):
        m = TAG.search(html, at)
        if not m:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and tag not in SCOPE:
                    break
            continue
        attrs = m[3] if m[2] else m[6]
        shut = CLOSES.get(tag, frozenset()) | (frozenset(["p"]) if tag in ENDS_P else frozenset())
        if shut:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        node = Node(tag, *_flags(tag, attrs or ""))
        stack[-1].children.append(node)
        if tag in RAW:
            end = RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not (attrs or "").endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
    _relieve(root)
    return root


def _relieve(node: Node) -> bool:
    """Keeps elements that are named like a sidebar or so but hold an article or main element, as frames of whole pages do; whether there's one in node."""
    inside = False
    for c in node.children:
        if isinstance(c, Node) and _relieve(c):
            inside = True
    if inside and node.named:
        node.drop = False
    return inside or node.main


def has_main(node: Node) -> bool:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.main:
            return True
        todo += [c for c in n.children if isinstance(c, Node) and not c.drop]
    return False


def hash_tree(node: Node, inside: bool) -> int:
    """Sets every element's hash, of its tag and all below; comments and attributes don't count. Pages with a main element have hashes of their own."""
    parts = [node.tag]
    for c in node.children:
        parts.append(str(hash_tree(c, inside)) if isinstance(c, Node) else SPACE.sub(" ", c).strip())
    node.hash = xxhash.xxh64_intdigest("\x00".join(parts), int(inside)) - (1 << 63)
    return node.hash


def _text_in(node: Node) -> bool:
    return any(c.strip() if isinstance(c, str) else not c.drop and _text_in(c) for c in node.children)


def _amid(node: Node, child: Node) -> bool:
    """Whether child is an inline element amid node's own text."""
    return child.tag in INLINE and any(isinstance(c, str) and c.strip() for c in node.children)


def candidates(html: str | None) -> tuple[int | None, set[int]]:
    """The main text's hash, if the page has a main element, and hashes of subtrees that may be template: those with text, in main elements if there are any; the page's outermost elements are left out."""
    if not html:
        return None, set()
    root = parse(html)
    inside = has_main(root)
    hash_tree(root, inside)
    out, todo = set(), [(root, not inside)]
    while todo:
        n, on = todo.pop()
        for c in n.children:
            if isinstance(c, Node) and not c.drop and _text_in(c):
                if (on or c.main) and c.tag not in ("html", "body") and not (inside and _amid(n, c)):
                    out.add(c.hash)
                todo.append((c, on or c.main))
    return (xxhash.xxh64_intdigest(_text_of(root, inside)) - (1 << 63) if inside else None), out


def main_text(html: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the main text in page order, joined by newlines."""
    if not html:
        return ""
    root = parse(html)
    inside = has_main(root)
    if template:
        hash_tree(root, inside)
    return _text_of(root, inside, template)


def _text_of(root: Node, inside: bool, template: frozenset[int] | set[int] = frozenset()) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        text = SPACE.sub(" ", unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()

    def walk(node: Node, on: bool):
        for c in node.children:
            if isinstance(c, str):
                if on:
                    run.append(c)
            elif c.drop or c.hash in template and (on or c.main) and not (inside and _amid(node, c)):
                run.append(" ") if c.tag in INLINE else flush()
            elif c.tag == "br":
                run.append(" ")
            else:
                block = c.tag not in INLINE
                if block:
                    flush()
                walk(c, on or c.main)
                if block:
                    flush()

    walk(root, not inside)
    flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, inside_share: float = INSIDE_SHARE) -> DataFrame:
    """host, hash of subtrees that recur across the host's pages."""
    from veilspark.llm.common import settled

    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, p, html in zip(*(as_list(batch, c) for c in ("host", "page_id", "html"))):
                text, found = candidates(html)
                inside = text is not None
                rows += [(h, inside, text if inside else p, x) for x in (*found, *[None] * inside)]  # None: the main text itself
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.bool_(), pa.int64(), pa.int64()))], names=["host", "inside", "unit", "hash"])

    found = keyed.mapInArrow(run, "host string, inside boolean, unit long, hash long").distinct()
    recur = settled(found.groupBy("host", "inside", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages))
    texts = recur.where("inside and hash is null").select("host", "inside", F.col("n").alias("pages"))
    of_host = keyed.select("host", "page_id").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    of_all = of_host.select("host", F.lit(False).alias("inside"), "pages").unionByName(texts)
    least = F.when(F.col("inside"), F.lit(inside_share)).otherwise(F.lit(share)) * F.col("pages")
    return recur.where("hash is not null").join(of_all, ["host", "inside"]).where(F.col("n") >= least).select("host", "hash")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, inside_share: float = INSIDE_SHARE) -> DataFrame:
    """page_id, url and text, a row for each row of pages."""
    from veilspark.llm.common import settled

    found = settled(templates(pages, min_pages, share, inside_share))
    by_host = found.groupBy("host").agg(F.collect_list("hash").alias("hashes"))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    n = found.count()
    if n == 0:
        both = own.select("page_id", "url", "html", F.lit(None).cast("array<long>").alias("hashes"))
    else:
        both = own.join(F.broadcast(by_host) if n <= BROADCAST_HASHES else by_host, "host", "left").select("page_id", "url", "html", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html, frozenset(x or ())) for html, x in zip(as_list(batch, "html"), as_list(batch, "hashes"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return both.mapInArrow(run, "page_id long, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

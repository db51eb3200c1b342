"""Operator 8: main text of web pages with a site style tree.

* *Merging*: the DOMs of a host's pages are merged by style node, the path of
  tags and classes from the root.  A page gives each of its style nodes two
  hashes: the node's text (its content) and the sequence of its children's tags
  (its presentation).  Only counts leave the pages: how many distinct pages of
  the host show a style node with a given hash.
* *Importance*: over the ``m`` pages that have a style node, a content that
  ``k`` of them share has the importance ``1 - ln k / ln m``; the node's is the
  mean over its pages, plus a tenth of its presentation's entropy to base ``m``.
  What every page repeats comes near 0, what each page has anew near 1.
* *Pruning*: branches of low importance go.  Inside ``article`` or ``main``
  only named containers without paragraphs of their own go that way, and only
  on hosts with ``least_pages`` distinct pages, so copies of an article on a host
  don't remove it.  Branches whose tag or class says that they are menus,
  headers, footers, sidebars, notices, adverts, forms, comments or code go too,
  but never by a class (nor as a form) where they hold more than half of the
  text of the page or of the ``article`` or ``main`` around them, nor where they
  hold ``main``, nor where no ``article`` is outside of such branches.  What is
  kept so counts in the style tree like any other branch.

Where a page has an ``article`` or ``main``, its text is the text in there, else
that of the body.  Blocks (paragraphs, headings, list items, cells) come in page
order, joined by one line break; references are decoded, white space inside a
block (line breaks of ``br`` too) becomes one space.

Counts are combined on the map side; pages meet the list of their host's
low-importance nodes by a join that adaptive execution can split, so a host of
any size is spread over tasks.

Defined cases: a null or empty page has an empty text; pages with a null or odd
url form a host of their own; repeated pages of a host count once and all come
back; unclosed, crossed and cut-off tags are closed as browsers do; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import bound_batches, cut

_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?P<close>>|$)"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|$)", re.S)
_CLASS = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I | re.S)

# fixed values: elements by their role in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes svg math xmp".split())
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
                  "caption pre blockquote figure figcaption header footer nav aside form fieldset address details summary "
                  "hr center menu dialog option select".split())
JUNK_TAGS = frozenset("nav footer header aside form script style noscript template iframe button select textarea menu "
                      "dialog head title svg math object embed input option".split())
JUNK_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs header footer masthead sidebar sidebars aside widget widgets cookie cookies consent notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login form forms search social share sharing "
    "comment comments disqus respond reply replies related recommended recommendations trending pagination pager toolbar "
    "complementary contentinfo search-form skip gdpr".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt pre blockquote figcaption caption".split())
# words that tell of a page's state or layout, not of what a branch is (has-sidebar, no-comments, form-page)
_STATE_FIRST = frozenset("has with no without show hide is".split())
_STATE_LAST = frozenset("page layout template".split())
_HEAD_NAMES = frozenset("header masthead".split())
_ENDS_P = BLOCK - {"option", "select"}
_SELF_NESTED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_SCOPES = frozenset("ul ol dl table article section div main body html aside nav form header footer td th blockquote".split())


class Node:
    __slots__ = ("tag", "names", "path", "in_article", "junk", "children", "parent")

    def __init__(self, tag, names, parent):
        self.tag, self.names, self.parent = tag, names, parent
        self.children: list = []
        self.path = (parent.path + "/" if parent else "") + tag + "".join("." + n for n in sorted(names))
        self.in_article = parent is not None and (parent.in_article or parent.tag == "article")
        self.junk = False  # set by settle() when the page is whole


def _junk_names(names, but=frozenset()) -> bool:
    for n in names:
        parts = [x for x in re.split(r"[-_\s]+", n) if x]
        if len(parts) > 1 and (parts[0] in _STATE_FIRST or parts[-1] in _STATE_LAST):
            continue
        if n in JUNK_NAMES - but or any(x in JUNK_NAMES and x not in but for x in parts):
            return True
    return False


def settle(root: Node) -> None:
    """Mark the branches whose tag or names say that they are no main text; see the module's text."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(c for c in x.children if not isinstance(c, str))
    by_tag, by_name, n_chars, has_main = set(), set(), {}, set()
    for x in reversed(order):  # children before their parents
        if x.tag in JUNK_TAGS and not (x.tag == "header" and x.in_article):
            by_tag.add(x)
        elif x.tag not in ("html", "body", "article", "main", "h1") and _junk_names(
                x.names, _HEAD_NAMES if x.in_article else frozenset()):
            by_name.add(x)
        n_chars[x] = sum(len(c.strip()) if isinstance(c, str) else n_chars[c] if c not in by_tag or c.tag == "form" else 0
                         for c in x.children)
        if x.tag == "main" or any(c in has_main for c in x.children if not isinstance(c, str)):
            has_main.add(x)

    def mark(spared):
        within = {root: root}  # the article, main or page that a node is in
        for x in order:
            if x.parent is not None:
                within[x] = x.parent if x.parent.tag in ("article", "main") else within[x.parent]
            most = 2 * n_chars[x] > n_chars[within[x]] and (x in by_name or x.tag == "form")
            own = (x in by_tag or x in by_name) and not most and x not in has_main and x not in spared
            x.junk = own or (x.parent is not None and x.parent.junk)

    mark(())
    articles = [x for x in order if x.tag == "article"]
    if articles and not has_main and all(x.junk for x in articles):
        spared = set()
        for x in articles:
            while x is not None and x not in spared:
                spared.add(x)
                x = x.parent
        mark(spared)


def _names(attrs: str) -> frozenset:
    found = set()
    for _, a, b, c in _CLASS.findall(attrs or ""):
        found.update((a or b or c).lower().split())
    return frozenset(found)


def parse(page: str) -> Node:
    """DOM of a page: nodes whose children are nodes and strings."""
    root = here = Node("#", frozenset(), None)
    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0:
            here.children.append(page[at:])
            break
        if i > at:
            here.children.append(page[at:i])
        m = _MARKUP.match(page, i)
        if m is None:
            here.children.append("<")
            at = i + 1
            continue
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            node = here
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                here = node.parent
            continue
        if at >= n and not page.endswith(">"):
            break  # a tag that the page's end cuts off
        if tag in _ENDS_P:
            node = here
            while node is not root and node.tag != "p" and node.tag not in _SCOPES:
                node = node.parent
            if node.tag == "p":
                here = node.parent
        for close in (_SELF_NESTED.get(tag, ()),):
            node = here
            while close and node is not root and node.tag not in close:
                if node.tag in _SCOPES and not (tag == "tr" and node.tag in ("td", "th")):
                    break
                node = node.parent
            if close and node.tag in close:
                here = node.parent
                if tag == "tr" and node.tag in ("td", "th") and here.tag == "tr":
                    here = here.parent
        node = Node(tag, _names(m["attrs"]), here)
        here.children.append(node)
        if tag in RAW:
            j = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = j.end() if j else n
        elif tag not in VOID and not (m["attrs"] or "").rstrip().endswith("/"):
            here = node
        elif tag not in VOID:
            here = node if tag in BLOCK else here  # <div/> opens a div in HTML
    settle(root)
    return root


def _text_of(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            todo.extend(reversed(x.children))
    return " ".join(entities.unescape(" ".join(out)).split())


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def style_rows(root: Node):
    """Distinct (path hash, kind, hash) of a page: kind 0 is content, 1 presentation."""
    rows, todo = set(), [root]
    while todo:
        node = todo.pop()
        kids = [c for c in node.children if not isinstance(c, str)]
        todo.extend(kids)
        if node.parent is None or node.tag not in BLOCK or node.junk:
            continue
        key = _hash(node.path)
        rows.add((key, 0, _hash(_text_of(node))))
        rows.add((key, 1, _hash(" ".join(k.tag for k in kids))))
    return rows


def blocks(root: Node, low: frozenset = frozenset()) -> list[str]:
    """Main text blocks of a page; ``low`` has the path hashes of low importance on its host."""
    def find(tags):
        todo, got = [root], []
        while todo:
            x = todo.pop()
            if x.junk:
                continue
            if x.tag in tags:
                got.append(x)
            else:
                todo.extend(c for c in reversed(x.children) if not isinstance(c, str))
        return got

    tops = find({"article"}) or find({"main"}) or [root]
    inside = tops[0] is not root
    out, text = [], []

    def close():
        s = " ".join(entities.unescape("".join(text)).split())
        if s:
            out.append(s)
        text.clear()

    def dropped(node):
        if node.junk:
            return True
        if not low or node.tag not in BLOCK or node.tag in ("html", "body", "article", "main"):
            return False
        if inside and (node.tag in TEXT_TAGS or not node.names
                       or any(not isinstance(c, str) and c.tag in TEXT_TAGS for c in node.children)):
            return False
        return _hash(node.path) in low

    for top in tops:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                text.append(x)
            elif x.tag == "br":
                text.append(" ")
            elif not dropped(x):
                if x.tag in BLOCK:
                    close()
                    todo.append(None)
                todo.extend(reversed(x.children))
        close()
    return out


def _style_counts(batches):
    """Rows (host, html) to the distinct style rows of each page."""
    for batch in batches:
        hosts, pages = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a in range(0, len(pages), 200):
            rows = [(h, *r) for h, p in zip(hosts[a:a + 200], pages[a:a + 200]) if p for r in style_rows(parse(p))]
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int64()))],
                ["host", "path", "kind", "hash"])


def _host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def low_importance(pages: DataFrame, least_pages: int = 10, limit: float = 0.15) -> DataFrame:
    """(host, low): path hashes of the style nodes with an importance under ``limit``; pages have (host, html)."""
    once = pages.where("html is not null").withColumn("d", F.xxhash64("html")).groupBy("host", "d").agg(
        F.first("html").alias("html")).select("host", "html")
    shown = (once.mapInArrow(_style_counts, "host string, path long, kind int, hash long")
             .groupBy("host", "path", "kind", "hash").agg(F.count("*").alias("k")))
    nodes = shown.groupBy("host", "path").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("k"))).alias("m"),
        F.sum(F.when(F.col("kind") == 0, F.col("k") * F.log("k"))).alias("same"),
        F.sum(F.when(F.col("kind") == 1, F.col("k") * F.log("k"))).alias("alike"))
    # sum of k (1 - ln k / ln m) / m, and the entropy of the presentations to base m
    nodes = nodes.where(F.col("m") >= least_pages).withColumn("ln", F.log("m"))
    content = 1 - F.col("same") / (F.col("m") * F.col("ln"))
    presentation = 1 - F.col("alike") / (F.col("m") * F.col("ln"))
    return (nodes.where(0.9 * content + 0.1 * presentation < limit)
            .groupBy("host").agg(F.collect_set("path").alias("low")))


def _extract(batches):
    for batch in batches:
        low, pages = batch.column(2), batch.column(3)
        for a in range(0, batch.num_rows, 200):
            text = []
            for s, p in zip(low.slice(a, 200).to_pylist(), pages.slice(a, 200).to_pylist()):
                text.append("\n".join(blocks(parse(p), frozenset(s or ()))) if p else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, 200), batch.column(1).slice(a, 200), pa.array(text, pa.string())],
                ["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            least_pages: int = 10, limit: float = 0.15) -> DataFrame:
    """One row per page: (page_id, url, text, n_chars)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")).withColumn("host", _host(F.col("url")))
    bound_batches(pages.sparkSession)
    low = cut(low_importance(rows.select("host", "html"), least_pages, limit))
    return (rows.join(low, "host", "left").select("page_id", "url", "low", "html")
            .mapInArrow(_extract, "page_id long, url string, text string")
            .withColumn("n_chars", F.length("text").cast("long")))

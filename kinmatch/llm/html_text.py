"""Main text of web pages with removal of site templates.

Pages are read as element trees. Subtrees are hashed and counted per host in
Spark (combined before the shuffle) by the different contents of the pages
they stand on; a subtree that recurs on many of them is part of the site's
template and is deleted. A page's content is the text of its articles, or its
whole text without any, so that one page at many addresses counts once and
keeps its own text. Elements that by their tag, role or class are menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader
comments go as well, since a host may have few pages. What is left inside the
article (the ``article`` or ``main`` elements, else the whole body) is
returned block by block.

Inside an article only whole containers (``div``, ``section``, lists, tables,
figures) are deleted by their counts, and only containers by their class or
id; its paragraphs, list items and table rows go neither for recurring (a
sentence that many articles quote is text) nor for their names, but for the
plain names of adverts. A name counts as a whole: ``share-box`` names a part
of the page, ``share-price`` does not.

Defined results: null, empty and text-free pages give the empty text; equal
rows are extracted each; a null or odd url belongs to the host ""; other
columns are ignored; broken markup is read as far as tags close or imply it.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.common import materialize, table

#: A subtree is template if it stands on so many pages of its host, and on this share of them.
LEAST_PAGES = 5
LEAST_SHARE = 0.05

# Fixed values of HTML: elements without content, with raw content, and that begin a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a following element of the listed kinds closes.
CLOSES_P = BLOCKS - {"body", "html", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "figcaption", "summary"}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt td th caption".split())
#: Elements of an article that are template if they recur as a whole.
CONTAINERS = frozenset("div section ul ol dl table figure".split())
#: Elements that are never part of the main text.
DROPPED = frozenset(
    "script style noscript template nav footer aside form button select option textarea input iframe object embed svg canvas math dialog menu head title meta link "
    "audio video noembed noframes applet map datalist".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of a class or id that name a part around the main text.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion promoted sponsor sponsored nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "footer foot sidebar side aside widget widgets comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager masthead topbar toolbar skip hidden copyright legal disclaimer".split()
)
#: Words that may stand beside them: with any other word a name is about something else.
BESIDE = frozenset(
    "area articles bar block body bottom box btn button buttons center col column container content fixed form global google group header holder icons inner item items left line "
    "link links list main media message mobile module news outer page panel policy post posts primary right row secondary section site slot sticky stories sub thread title to top unit wrap wrapper x zone".split()
)
#: The same when they stand on a header element or container, but not on an article's own headings.
HEADER_PARTS = frozenset("header head masthead topbar".split())
COMMENTS = frozenset("comment comments reply".split())
#: Whole names that make an advert of a paragraph, too.
ADVERTS = frozenset("ad ads advert adverts advertisement sponsored promo".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kind", "children")

    def __init__(self, tag: str, kind: str):
        #: children are Node or text; kind is "", "drop", "article"
        self.tag, self.kind, self.children = tag, kind, []


def _kind(tag: str, attributes: str, inside_article: bool) -> str:
    if tag in DROPPED:
        return "drop"
    role, names, shown, item = "", [], True, ""
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role":
                role = value.strip().lower()
            elif name == "class" or name == "id" and (not inside_article or tag in CONTAINERS):  # ids of an article are often slugs of its headings
                names += value.lower().split()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                shown = False
            elif name == "itemprop":
                item = value.strip().lower()
    if tag in ("body", "html"):
        return ""
    if tag in ("article", "main") or role in ("main", "article") or item == "articlebody":
        return "drop" if any(_about(n, COMMENTS) for n in names) else "article"
    if not shown or role in ROLES:
        return "drop"
    if inside_article and tag not in CONTAINERS:
        return "drop" if ADVERTS & PARTS & set(names) else ""
    if any(_about(n, PARTS) for n in names):
        return "drop"
    if not inside_article and (tag == "header" or tag in ("div", "section", "table") and any(_about(n, HEADER_PARTS) for n in names)):
        return "drop"
    return ""


def _about(name: str, parts: frozenset[str]) -> bool:
    """Whether a class or id as a whole names one of ``parts``: one of its words does, and the others stand beside such words."""
    words = set(_WORDS.findall(name))
    return bool(words & parts) and words <= parts | PARTS | BESIDE


def parse(text: str) -> Node:
    """The element tree of a page; comments, doctypes and raw contents of dropped elements are left out."""
    root = Node("#root", "")
    stack, articles, at = [root], 0, 0
    while True:
        m = _TOKEN.search(text, at)
        if m is None:
            if at < len(text):
                stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    articles -= sum(n.kind == "article" for n in stack[i:])
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body", "td", "table") and tag not in ("article", "main", "body", "html", "table", "tr", "tbody", "section", "div"):
                    break
            continue
        # elements that the new one closes
        if tag in CLOSES_P or tag in ("li", "dd", "dt", "td", "th", "tr"):
            scope = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead", "tfoot")}.get(tag, ())
            ends = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,)) if scope else ("p",)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in ends:
                    del stack[i:]
                    break
                if stack[i].tag in scope or stack[i].tag in BLOCKS and stack[i].tag != "p" and not scope:
                    break
        node = Node(tag, _kind(tag, m[3] or "", articles > 0))
        if tag == "main":  # whatever its classes say, what holds the main element is no part around it
            for above in stack:
                if above.kind == "drop" and above.tag not in DROPPED:
                    above.kind = ""
        stack[-1].children.append(node)
        if tag in VOID or (m[3] or "").endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(text, at)
            at = end.end() if end else len(text)
            continue
        stack.append(node)
        articles += node.kind == "article"
    return root


def _hash(parts: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b"\x00".join(parts), digest_size=8).digest(), "little", signed=True)


def subtree_hashes(root: Node) -> tuple[dict[int, int], int | None]:
    """Node identity to hash for every element that may be template: it has text and is no prose of an article.

    Further a hash of the page's content: the text of its articles, without any the whole text (null if there is none).
    """
    found: dict[int, int] = {}
    own: list[bytes] = []
    every: list[bytes] = []
    # a stack of (node, inside an article, dropped, parts collected so far, next child, holds an article) instead of recursion
    frames = [[root, False, False, [root.tag.encode()], 0, False]]
    while frames:
        frame = frames[-1]
        node, article, dropped, parts, i, holds = frame
        if i < len(node.children):
            frame[4] += 1
            child = node.children[i]
            if isinstance(child, str):
                if t := child.strip():
                    parts.append(_SPACE.sub(" ", t).encode("utf-8", "surrogatepass"))
                    if not dropped:
                        (own if article else every).append(parts[-1])
            else:
                frames.append([child, article or child.kind == "article", dropped or child.kind == "drop", [child.tag.encode()], 0, False])
            continue
        frames.pop()
        worth = len(parts) > 1
        value = _hash(parts) if worth else 0
        if worth and node.tag not in ("#root", "html", "body", "article", "main", "head") and node.tag in BLOCKS and not (article and _prose(node)):
            # neither what is an article by its role nor what is wrapped around one is template
            if node.kind != "article" and (article or not holds):
                found[id(node)] = value
        if frames and (holds or node.kind == "article"):
            frames[-1][5] = True
        if frames and worth:
            frames[-1][3].append(value.to_bytes(8, "little", signed=True))
    content = own or every
    return found, _hash(content) if content else None


def _prose(node: Node) -> bool:
    """A block of an article that reads as text: a paragraph or the like, an item of a list or a row of a table."""
    return node.tag in PROSE or node.tag in ("li", "tr", "tbody", "thead", "tfoot")


def blocks(root: Node, template: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Text blocks in page order, of the articles if there are any."""
    hashes = subtree_hashes(root)[0] if template else {}
    has_article = _any_article(root)
    out: list[str] = []
    line: list[str] = []

    def close() -> None:
        t = _SPACE.sub(" ", _html.unescape("".join(line))).strip()
        if t:
            out.append(t)
        line.clear()

    frames = [(root, 0, not has_article)]
    while frames:
        node, i, take = frames.pop()
        if i == 0:
            if node.kind == "drop" or hashes.get(id(node)) in template and id(node) in hashes:
                if node.tag in BLOCKS:
                    close()
                continue
            take = take or node.kind == "article"
            if node.tag in BLOCKS:
                close()
            elif node.tag == "br":
                line.append(" ")
        if i < len(node.children):
            frames.append((node, i + 1, take))
            child = node.children[i]
            if isinstance(child, str):
                if take:
                    line.append(child)
            else:
                frames.append((child, 0, take))
        elif node.tag in BLOCKS or node is root:
            close()
    return out


def _any_article(root: Node) -> bool:
    todo = [root]
    while todo:
        n = todo.pop()
        if n.kind == "article":
            return True
        if n.kind != "drop":
            todo += [c for c in n.children if not isinstance(c, str)]
    return False


def extract(text: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    return "\n\n".join(blocks(parse(text), template)) if text else ""


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, content = subtree_hashes(parse(page)) if page else ({}, None)
            rows += [(host, value, content) for value in (None, *set(found.values()))]
        columns = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "subtree", "content"])


def host_of(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(host, template array): hashes of the subtrees that recur on the host's pages of different content.

    A host has at most (subtrees of a mean page) / ``least_share`` of them, whatever its number of pages.
    """
    seen = pages.select(host_of().alias("host"), "html").mapInArrow(_hasher, "host string, subtree long, content long").filter("content IS NOT NULL")
    counted = seen.distinct().groupBy("host", "subtree").agg(F.count("*").alias("contents"))
    counted = materialize(counted.filter(F.col("contents") >= least_pages), "subtrees")  # without a subtree: all contents of the host
    sizes = counted.filter("subtree IS NULL").select("host", F.col("contents").alias("all_contents"))
    recurring = counted.filter("subtree IS NOT NULL").join(sizes, "host").filter(F.col("contents") >= least_share * F.col("all_contents"))
    return recurring.groupBy("host").agg(F.collect_set("subtree").alias("template"))


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, frozenset[int]] = {}
    for batch in batches:
        ids, urls, hosts, pages, templates = (batch.column(i) for i in range(5))
        texts = []
        for host, page, own in zip(hosts.to_pylist(), pages, templates, strict=True):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = frozenset(own.as_py() or ())
            texts.append(extract(page.as_py(), known[host]))
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    templates = materialize(site_templates(pages), "templates")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), host_of().alias("host"), "html")
    return rows.join(templates, "host", "left").select("page_id", "url", "host", "html", "template").mapInArrow(_extractor, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))

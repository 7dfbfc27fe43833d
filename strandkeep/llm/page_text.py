"""Main text of web pages, with site template removal.

Every page is parsed into a tree and each element's subtree is hashed, bottom-up, from its tag, attributes,
texts and its children's hashes; its slot is the hash of the tags and classes on the way down to it. Spark counts,
per host, the different pages on which a subtree stands and the different contents of a slot. Template, and
deleted from every page of the host, are

* subtrees beside the articles that recur on SHARE of the host's pages, and slots that SLOT_SHARE of the pages
  fill: beside an article whatever stands there, on pages without one if the contents recur too;
* inside articles, boxes that recur in INNER_SHARE of the host's different articles, and paragraphs or headings
  that recur in PARAGRAPH_SHARE of them, LEAST_ARTICLES at least, among the first or last EDGE elements. A
  paragraph quoted further inside stays however often it recurs.

All that takes LEAST_PAGES pages at least. What the counts do not know is left to the names: tags, roles and
classes of menus, headers, footers, sidebars, notices, adverts, forms and reader comments, and whatever stands
beside an article. Names also hold inside articles. What remains is the text.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandkeep.llm import common

#: Different pages on which template stands at least, and the shares of the host's pages or articles.
LEAST_PAGES, SHARE, SLOT_SHARE, INNER_SHARE = 4, 0.2, 0.5, 0.6
#: The same for paragraphs and headings of articles, which are content more often than boxes.
LEAST_ARTICLES, PARAGRAPH_SHARE = 12, 0.8
#: On pages without an article a slot's different contents are no more than this share of its pages.
VARIETY = 0.5
#: First and last elements of an article whose paragraphs may be template.
EDGE = 2
#: Template rows that may be broadcast; more are joined by a shuffle on the host.
BROADCAST_ROWS = 200_000
#: What a key stands for, in its low bits: a subtree beside the article, a box or an edge paragraph inside, a slot beside an article or on a page without one.
OUTER, BOX, PARAGRAPH, BESIDE, FREE = range(5)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?|[\"'])*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: What goes with the element around it and is not counted by itself.
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark option q s samp small span strike strong sub sup td th time tt u var".split())
#: Inside an article these may be template wherever they stand; other elements only at its edges.
_BOXES = frozenset("center details div dl fieldset figure header ol section table ul".split())
_DROP_TAGS = frozenset(
    "head title script style noscript template iframe object svg canvas nav footer aside form button select option textarea label menu dialog".split()
)
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Words of class and id that name what is not the article; those of _OUTSIDE only outside it.
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer comment comments disqus "
    "respond reply replies share sharing social related recommended newsletter subscribe subscription signup login widget pagination pager "
    "copyright disclaimer masthead topbar toolbar skip".split()
)
_OUTSIDE = frozenset("header head search alert legal side aside meta tags".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIER = frozenset("html body table td th ul ol dl article section main aside nav header footer form div blockquote".split())


class Node:
    """An element: tag, attribute text, parent, children (elements and texts); the rest is filled in by analyse."""

    __slots__ = ("tag", "attrs", "above", "kids", "holds", "inside", "named", "edge", "hash", "slot", "links", "text", "linked")

    def __init__(self, tag: str, attrs: str, above: Node | None):
        self.tag, self.attrs, self.above, self.kids = tag, attrs, above, []
        self.holds = self.inside = self.named = self.edge = False
        self.links = self.text = self.linked = 0

    def attr(self, *names: str) -> dict[str, str]:
        return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs) if m[1].lower() in names} if self.attrs else {}


def parse(page: str) -> list[Node]:
    """The elements of a page in order, a root first. Unknown end tags are ignored; paragraphs, items and cells end where the next begins.

    Time is linear in the page: open tags are counted, so no end tag looks through a deep nest in vain. A tag
    whose quotes never close ends at the next >, and one without any > is no text.
    """
    root = Node("", "", None)
    order, stack, opened, endless = [root], [root], {}, set()
    at, n, last = 0, len(page), page.rfind(">")

    def close(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            rest = page[at:]
            cut = re.search(r"<[/a-zA-Z!?][^<>]*$", rest) if lt >= 0 else None
            stack[-1].kids.append(rest[: cut.start()] if cut else rest)
            break
        if lt > at:
            stack[-1].kids.append(page[at:lt])
        ahead = page[lt + 1 : lt + 4]
        if ahead == "!--":
            stop = page.find("-->", lt + 4)
            at = stop + 3 if stop >= 0 else n
            continue
        if ahead[:1] in ("!", "?"):
            at = page.find(">", lt) + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            stop = page.find(">", lt)
            m = re.match(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", page[lt : stop + 1])
            if not m:
                stack[-1].kids.append("<")
                at = lt + 1
                continue
            at = stop + 1
        else:
            at = m.end()
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag == "p" and stack[k].tag in _BARRIER:
                    break
            continue
        closes = _CLOSES.get(tag, ())
        if tag in _BLOCK:
            closes = (*closes, "p")
        for k in range(len(stack) - 1, 0, -1) if any(opened.get(x) for x in closes) else ():
            if stack[k].tag in closes:
                close(k)
                break
            if stack[k].tag in _BARRIER:
                break
        node = Node(tag, m[3], stack[-1])
        stack[-1].kids.append(node)
        order.append(node)
        if tag in _VOID or (m[3].endswith("/") and tag not in _BLOCK):
            continue
        if tag in _RAW:
            stop = None if tag in endless else re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
            if not stop:
                endless.add(tag)
            if tag not in ("title", "textarea") or stop:
                at = stop.end() if stop else n
            continue
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    return order


def is_named(node: Node, inside: bool) -> bool:
    """Whether tag, role, class or id name the element as something else than article text."""
    tag = node.tag
    if tag in _DROP_TAGS:
        return True
    if tag in ("", "body", "html", "main"):
        return False
    if tag == "header" and not inside:
        return True
    if not node.attrs:
        return False
    got = node.attr("class", "id", "role", "style", "aria-hidden")
    if got.get("role", "").lower() in _DROP_ROLES or "display:none" in got.get("style", "").replace(" ", "").lower() or got.get("aria-hidden") == "true":
        return True
    if _HIDDEN.search(node.attrs):
        return True
    words = set(_WORD.findall(f"{got.get('class', '')} {got.get('id', '')}".lower()))
    return bool(words & _DROP_WORDS) or not inside and bool(words & _OUTSIDE)


def _key(kind: int, value: int) -> int:
    """A signed 64-bit key: the hash with its kind in the low bits; hash 0 stands for the page or its articles."""
    value = value & ~7 | kind
    return value - (1 << 64) if value >> 63 else value


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def analyse(order: list[Node]) -> bool:
    """Fills in the nodes' article, slots, hashes and link counts; whether the page has an article.

    The articles are those elements that nothing names otherwise, else the main ones, else any.
    """
    for node in order[1:]:
        node.named = node.above.named or is_named(node, False)
    articles = [x for x in order if x.tag == "article"]
    tops = [x for x in articles if not x.named] or [x for x in order if (x.tag == "main" or x.attrs and x.attr("role").get("role") == "main") and not x.named] or articles
    for x in tops:
        x.inside = True
        while x and not x.holds:
            x.holds, x = True, x.above
    order[0].slot = 0
    top = {id(x) for x in tops}
    for node in order[1:]:
        above = node.above
        node.inside = node.inside or above.inside
        got = node.attr("class", "role")
        node.slot = _digest(f"{above.slot} {node.tag} {_DIGITS.sub('', ' '.join(sorted(got.values()))) if got else ''}")
    for x in tops:
        kids = [k for k in x.kids if not isinstance(k, str)]
        for k in (*kids[:EDGE], *kids[-EDGE:]):
            k.edge = id(k) not in top
    for node in reversed(order):  # children before parents
        parts = [node.tag, " ".join(node.attrs.split())]
        for kid in node.kids:
            if isinstance(kid, str):
                text = " ".join(kid.split())
                node.text += len(text)
                parts.append(text)
            else:
                node.links += kid.links + (kid.tag == "a")
                node.text += kid.text
                node.linked += kid.text if kid.tag == "a" else kid.linked
                parts.append(str(kid.hash))
        node.hash = _digest("\0".join(parts))
    return bool(tops)


def _counted(node: Node) -> bool:
    return bool(node.kids) and node.tag not in _INLINE and node.tag not in ("", "html", "body", "head") and node.above.tag != "head" and not node.holds


def keys_of(node: Node, article: bool) -> list[int]:
    """The keys by which an element can be template."""
    if not _counted(node):
        return []
    if node.inside:
        return [_key(BOX, node.hash)] if node.tag in _BOXES else [_key(PARAGRAPH, node.hash)] if node.edge else []
    return [_key(OUTER, node.hash), _key(BESIDE if article else FREE, node.slot)]


def page_keys(page: str) -> list[tuple[int, int, int]]:
    """(key, what it is counted by: the page or its articles, the content of a slot on a page without article else 0), each once."""
    order = parse(page)
    article = analyse(order)
    own = _digest(page) >> 1
    articles = _digest(" ".join(str(x.hash) for x in order if x.inside and not x.above.inside)) >> 1
    found: dict[int, int] = {_key(k, 0): 0 for k in ((OUTER, BOX, PARAGRAPH, BESIDE) if article else (OUTER, FREE))}
    for node in order[1:]:
        for key in keys_of(node, article):
            content = (found.get(key, 0) * 31 + node.hash) % (1 << 63) if key & 7 == FREE else 0
            found[key] = content
    return [(key, articles if key & 7 in (BOX, PARAGRAPH) else own, content) for key, content in found.items()]


def links_only(node: Node) -> bool:
    """Whether a list or box is little else than two or more links."""
    return node.links >= 2 and node.linked >= 0.8 * node.text


def extract(page: str | None, template: set[int], known: set[int] = frozenset(), names: bool = True) -> str:
    """The text of stripped."""
    return stripped(page, template, known, names)[0]


def stripped(page: str | None, template: set[int], known: set[int] = frozenset(), names: bool = True) -> tuple[str, int]:
    """The article's text, blocks in page order joined by an empty line, and how many subtrees went as template; empty for null.

    Slots beside an article that are known are left to the template alone. names=False leaves all to it.
    """
    if not page:
        return "", 0
    order = parse(page)
    article = analyse(order)
    blocks: list[str] = []
    parts: list[str] = []
    gone = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append(text)

    # an explicit stack: pages nest as deeply as they like; the flag says whether loose text counts
    stack: list = [(k, not article) for k in reversed(order[0].kids)]
    while stack:
        kid, counts = stack.pop()
        if kid is None:
            flush()
            continue
        if isinstance(kid, str):
            if counts or not names:
                parts.append(kid)
            continue
        if kid.tag in _RAW or kid.tag == "head":
            continue
        keys = keys_of(kid, article)
        if any(k in template for k in keys):
            gone += 1
            continue
        if names and not kid.holds:
            if kid.inside or not article:
                if is_named(kid, kid.inside) or not kid.inside and kid.tag in ("ul", "ol", "div", "table", "section") and links_only(kid):
                    continue
            elif not any(k in known for k in keys) and not counts:
                continue
        if kid.tag in ("br", "td", "th"):
            parts.append(" ")
        if kid.tag in _BLOCK:
            flush()
            stack.append((None, counts))
        within = counts or kid.inside or any(k in known for k in keys)
        stack += [(k, within) for k in reversed(kid.kids)]
    flush()
    return "\n\n".join(blocks), gone


def host(url: str = "url") -> F.Column:
    """The host of a URL, empty for null or none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """host, template, known (arrays of keys): the subtrees and slots recurring on many different pages of a host, and the slots that are settled by it.

    Equal pages count once, and so do equal articles for what stands inside. A host's arrays are bounded: each
    of its keys stands on a share of the pages or articles. Rows are keyed by host, key and page, then
    pre-aggregated by host and key, so a host with a third of all pages loads no single task.
    """

    def hashed(batches):
        for batch in batches:
            hosts, rows = [], []
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    found = page_keys(page)
                    hosts += [h] * len(found)
                    rows += found
            yield pa.record_batch([pa.array(hosts, pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["host", "key", "page", "content"])

    seen = pages.select(host().alias("host"), "html").mapInArrow(common.lean(hashed), "host string, key long, page long, content long").distinct()
    counts = seen.groupBy("host", "key", "content").agg(F.count("*").alias("n")).groupBy("host", "key").agg(F.sum("n").alias("n"), F.count("*").alias("contents"))
    kind = F.col("key").bitwiseAND(7)
    counts = common.stash(counts.withColumn("kind", kind).where(F.col("n") >= F.when(kind == PARAGRAPH, LEAST_ARTICLES).otherwise(LEAST_PAGES)))
    of_host = counts.where("key = kind").select("host", "kind", F.col("n").alias("all"))
    shares = F.when(F.col("kind") == OUTER, SHARE).when(F.col("kind") == BOX, INNER_SHARE).when(F.col("kind") == PARAGRAPH, PARAGRAPH_SHARE).otherwise(SLOT_SHARE)
    varied = (F.col("kind") == FREE) & (F.col("contents") > F.col("n") * VARIETY)
    many = counts.where("key <> kind").join(of_host, ["host", "kind"]).where((F.col("n") >= F.col("all") * shares) & ~varied)
    return many.groupBy("host").agg(F.collect_list("key").alias("template"), F.collect_list(F.when(F.col("kind") == BESIDE, F.col("key"))).alias("known"))


def extract_text(pages: DataFrame) -> DataFrame:
    """pages (url, html and others) with text (empty for null, empty or nothing found) and n_template, the subtrees removed as template.

    Repeated rows each keep theirs; empty tables give none; columns named text or n_template are replaced. Null
    urls are one host. Pages of any length and nesting are read whole, in time linear in their length.
    """
    names = [c for c in pages.columns if c not in ("text", "n_template", "__host", "__template", "__known")]
    found = common.stash(templates(pages))
    by_host = found.select(F.col("host").alias("__host"), F.col("template").alias("__template"), F.col("known").alias("__known"))
    if found.select(F.coalesce(F.sum(F.size("template") + F.size("known")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        by_host = F.broadcast(by_host)
    joined = pages.select(*names, host().alias("__host")).join(by_host, "__host", "left")

    def extracted(batches):
        for batch in batches:
            of = zip(*(batch.column(c).to_pylist() for c in ("html", "__template", "__known")), strict=True)
            found = [stripped(page, set(template or ()), set(known or ())) for page, template, known in of]
            kept = [batch.column(c) for c in names]
            yield pa.record_batch([*kept, pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], [*names, "text", "n_template"])

    schema = pages.select(*names).schema.add("text", "string").add("n_template", "long")
    return joined.select(*names, "__template", "__known").mapInArrow(common.lean(extracted), schema)


def op5_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_page_text": op5_page_text}

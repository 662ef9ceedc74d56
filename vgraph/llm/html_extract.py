"""Main text of web pages by removing what the templates of their sites repeat.

Every block element's subtree is hashed; Spark counts, per host, on how many different pages
each subtree occurs (pages that hold the same article count once, so copies of a page make
no template).  Subtrees recurring across many pages of their host are deleted.  What
templates fill with fresh words on each page goes by its element or role; by class and id
only outside the article, as in an article these name its own parts, but for containers of
comments, adverts and the like.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fits, materialize, small_batches, without

#: A subtree goes when so many different pages of its host hold it, and so large a share of them.
MIN_PAGES, MIN_SHARE = 5, 0.3
#: Template subtrees of all hosts up to this number (8 MB of longs, and the names of their hosts) are broadcast; beyond it a
#: join by host does, for which each host is split into so many parts.
BROADCAST_SUBTREES, HOST_PARTS = 1_000_000, 16

# Elements of HTML by their part in a page.
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript template".split())
DROPPED = RAW - {"xmp"} | set("head nav aside footer header form button select option datalist menu".split())
BLOCKS = set("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul search xmp".split())
ENDS_P = BLOCKS - {"html", "body", "dd", "dt", "li", "tbody", "tfoot", "thead", "tr", "caption", "legend"}
#: An opening element ends these open ones, up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = set("article aside center details dialog div dl fieldset figure li main ol section table ul".split())
#: Words in class and id that mark what is not the article where there is no article element, and roles that do.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|sponsor|sponsored|promo|promotion|"
    r"cookie|cookies|consent|gdpr|notice|notices|alert|newsletter|subscribe|subscription|popup|modal|overlay|"
    r"nav|navbar|navigation|menu|menubar|breadcrumb|breadcrumbs|sidebar|sidebars|aside|footer|copyright|masthead|header|topbar|toolbar|"
    r"comment|comments|commentlist|disqus|respond|reply|replies|share|sharing|social|related|recommended|recommendations|"
    r"widget|widgets|pagination|pager|skip|login|signup|search|searchbox)(?:$|[\s_-])"
)
#: Whole names of classes and ids that mark a container within an article as none of its own.
FOREIGN = set(
    "ad ads advert adverts advertisement advertising banner sponsored promo cookie cookies cookie-notice cookie-banner consent notice notices newsletter subscribe popup modal "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments comment-list commentlist comments-area disqus_thread respond replies share sharing "
    "social related related-posts recommended widget pagination pager login signup searchbox".split()
)
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "menu", "menubar", "toolbar"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?")
_HOST = re.compile(r"^\s*(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?|(?=[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+(?:[/?#:]|$)))([^/?#:\s]*)")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []


def parse(page: str) -> Node:
    """The element tree of a page, read tolerantly: implied ends are filled in, stray ends ignored."""
    root = top = Node("", {}, None)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            top.children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            top.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            node = top
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                top = node.parent
            continue
        if tag in ENDS_P:
            node = top
            while node is not root and node.tag not in BLOCKS:
                node = node.parent
            if node.tag == "p":
                top = node.parent
        if tag in IMPLIED:
            ended, bounds = IMPLIED[tag]
            node, last = top, None
            while node is not root and node.tag not in bounds:
                last = node if node.tag in ended else last
                node = node.parent
            if last is not None:
                top = last.parent
        attributes = {}
        for a in _ATTRIBUTE.finditer(m[3]):
            attributes.setdefault(a[1].lower(), html.unescape((a[2] or "").strip("\"'")))
        node = Node(tag, attributes, top)
        top.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if tag in ("noscript", "template"):
                top = node
            else:
                if tag == "xmp":
                    node.children.append(page[at : end.start() if end else n])
                close = page.find(">", end.start()) if end else -1
                at = n if close < 0 else close + 1
        elif tag not in VOID and not m[3].endswith("/"):
            top = node
        elif tag not in VOID:
            top = node if tag in BLOCKS else top
    return root


def noisy(node: Node, own: bool) -> bool:
    """Whether an element is by its kind not part of an article. ``own``: it lies in an article element, or one is looked for."""
    a = node.attributes
    if node.tag in DROPPED:
        return True
    if not a or node.tag in ("html", "body"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower() or a.get("role", "").lower() in NOISE_ROLES:
        return True
    names = (a.get("class", "") + " " + a.get("id", "")).lower()
    return node.tag in CONTAINERS and not FOREIGN.isdisjoint(names.split()) if own else node.tag not in HEADINGS and bool(NOISE.search(names))


def _walk(root: Node, own: bool):
    """Elements outside what is noisy by kind, children after parents."""
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str) and not noisy(c, own))


def articles(root: Node) -> tuple[list[Node], bool]:
    """The outermost elements that hold the article: article, else main (true), else the page's body, else all of it (false)."""
    nodes = list(_walk(root, True))
    for wanted in (
        lambda x: x.tag == "article" or x.attributes.get("role") == "article" or x.attributes.get("itemprop") == "articleBody",
        lambda x: x.tag == "main" or x.attributes.get("role") == "main",
    ):
        found = [x for x in nodes if wanted(x)]
        if found:
            inner = set(map(id, found))
            return [x for x in found if not any(id(p) in inner for p in _above(x))], True
    return [x for x in nodes if x.tag == "body"][:1] or [root], False


def _below(node: Node):
    todo = [c for c in reversed(node.children) if not isinstance(c, str)]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(c for c in reversed(x.children) if not isinstance(c, str))


def _above(node: Node):
    while node.parent is not None:
        node = node.parent
        yield node


def subtree_hashes(root: Node) -> dict[int, int]:
    """By identity of each element: a hash of its kind, class, id and all that is in it, white space aside."""
    hashes: dict[int, int] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in node.children if not isinstance(c, str))
    for node in reversed(order):
        h = xxhash.xxh64(f"<{node.tag} {node.attributes.get('class', '')} {node.attributes.get('id', '')}>".encode())
        for c in node.children:
            h.update(b" ".join(c.encode("utf-8", "surrogatepass").split()) if isinstance(c, str) else hashes[id(c)].to_bytes(8, "little"))
        hashes[id(node)] = h.intdigest()
    return hashes


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def candidates(page: str | None) -> tuple[int, list[int]]:
    """A hash of the page's article, and the hashes of its block elements that have words and do not hold the article."""
    root = parse(page or "")
    hashes = subtree_hashes(root)
    kept, (found, own) = set(), articles(root)
    for a in found:
        kept.update([id(a), *map(id, _above(a))])
    out = {_signed(hashes[id(x)]) for a in found for x in _walk(a, own) if x.tag in BLOCKS and id(x) not in kept and x.children}
    return _signed(xxhash.xxh64_intdigest(b"".join(hashes[id(a)].to_bytes(8, "little") for a in found))), sorted(out)


def main_text(page: str | None, template) -> str:
    """The blocks of the article without noise and template subtrees, joined by empty lines."""
    root = parse(page or "")
    hashes = subtree_hashes(root) if template else {}
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = " ".join("".join(line).split())
        if text:
            blocks.append(text)
        line.clear()

    found, own = articles(root)
    for article in found:
        todo: list = [article]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                line.append(x)
            elif x is not article and (noisy(x, own) or x.tag in BLOCKS and hashes and _signed(hashes[id(x)]) in template):
                if x.tag == "header":  # of the article: its headings are the title
                    todo.extend(y for y in reversed(list(_below(x))) if y.tag in HEADINGS)
            elif x.tag in ("br", "td", "th", "wbr"):
                line.append("" if x.tag == "wbr" else " ")
                todo.extend(reversed(x.children))
            elif x.tag in BLOCKS:
                close()
                todo.append(None)
                todo.extend(reversed(x.children))
            else:
                todo.extend(reversed(x.children))
        close()
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    """The host of an address in lower case, with or without a scheme; null where there is none."""
    host = F.lower(F.regexp_extract(url, _HOST.pattern, 1))
    return F.when(host != "", host)


@F.arrow_udf(T.StructType([T.StructField("page", T.LongType()), T.StructField("subtrees", T.ArrayType(T.LongType()))]))
def _candidates(pages: pa.Array) -> pa.Array:
    found = (candidates(p.as_py()) for p in pages)
    return pa.array([{"page": h, "subtrees": own} for h, own in found], pa.struct([("page", pa.int64()), ("subtrees", pa.list_(pa.int64()))]))


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array, templates: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py(), set(t.as_py() or ())) for p, t in zip(pages, templates, strict=True)], pa.string())


def templates(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """host, subtree: the hashes of each host's template subtrees.

    A host has at most as many as its pages have subtrees on average, over MIN_SHARE.  Pages
    without a host in their address have no template, null and empty pages no subtrees; pages
    of one host with equal articles, repeated rows among them, count once; an empty table
    gives no rows.  Other columns are not read.
    """
    found = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), _candidates(F.col(f"`{html_col}`")).alias("c")).where("host is not null")
    found = materialize(found.select("host", "c.page", F.explode_outer("c.subtrees").alias("subtree")).distinct(), "subtrees")
    # distinct on all three before counting, so that a subtree of a hot host is counted in many tasks
    counts = found.where("subtree is not null").groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    hosts = found.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of"))
    return counts.join(hosts, "host").where(F.col("n") >= MIN_SHARE * F.col("of")).select("host", "subtree")


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``pages`` with text, the main text (empty if none), and n_chars, its code points.

    A null page counts as empty; a page whose address is null or names no host has no
    template.  Each row is read by itself and whole, however long, so repeated rows get equal
    texts; an empty table gives no rows.  Columns named text and n_chars are replaced.
    """
    spark = small_batches(pages)
    known = materialize(templates(pages, html_col, url_col), "templates")
    rows = without(pages, *({"text", "n_chars"} - {html_col.lower(), url_col.lower()}))
    page, host = F.col(f"`{html_col}`"), host_of(F.col(f"`{url_col}`"))
    if fits(known, BROADCAST_SUBTREES):
        own: dict[str, list[int]] = {}
        for r in known.toLocalIterator():
            own.setdefault(r.host, []).append(r.subtree)
        held = spark.sparkContext.broadcast({h: frozenset(x) for h, x in own.items()})

        @F.arrow_udf(T.StringType())
        def text_of(htmls: pa.Array, hosts: pa.Array) -> pa.Array:
            return pa.array([main_text(p.as_py(), held.value.get(h.as_py(), ())) for p, h in zip(htmls, hosts, strict=True)], pa.string())

        done = rows.withColumn("_v_text", text_of(page, host))
    else:
        # a hot host meets its template in many tasks
        lists = known.groupBy("host").agg(F.collect_list("subtree").alias("_v_subtrees")).select(F.col("host").alias("_v_host"), "_v_subtrees", F.explode(F.sequence(F.lit(0), F.lit(HOST_PARTS - 1))).alias("_v_part"))
        rows = rows.withColumn("_v_of", host).withColumn("_v_in", F.pmod(F.xxhash64(page), F.lit(HOST_PARTS)).cast("int"))
        joined = rows.join(lists, (F.col("_v_of") == F.col("_v_host")) & (F.col("_v_in") == F.col("_v_part")), "left")
        done = joined.withColumn("_v_text", _main_text(page, F.col("_v_subtrees")))
    done = done.withColumn("text", F.col("_v_text")).withColumn("n_chars", F.length("_v_text").cast("long"))
    return without(done, "_v_of", "_v_in", "_v_part", "_v_host", "_v_subtrees", "_v_text")

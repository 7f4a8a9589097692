"""HTML main text by wrapper induction.

Pages of a host come from a few templates. They are told apart by their skeletons, the distinct structural tags of a
page with their classes and ids; skeletons that are much alike are one layout. One page of each layout is its pivot, and
the DOM tree of every other page of the layout is aligned with it by simple tree matching: a top-down dynamic programme over ordered children with equal labels. A pivot node whose
own text is the same on most aligned pages is template; nodes whose text varies are slots of content. A page's text is
its slots, less what its marks name as no part of an article (menus, headers, footers, sidebars, notices, adverts,
forms, reader comments), from its article or main element if it has one.

A page is parsed once: it leaves its blocks, each with the pivot node that it repeats, and its votes. One short row of
votes for each distinct article is shuffled, copies pre-aggregated, and then (host, layout, node, counts), pre-aggregated
for each batch; dropping the template blocks is an expression. Skeletons are read by expressions, too; one task lays out
the distinct skeletons of a host, never its pages.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, written

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title svg canvas iframe object audio video select textarea button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NO_ARTICLE = frozenset("nav header footer aside form menu dialog fieldset".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_BEFORE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPE = frozenset("ul ol dl table tr td th article main section aside nav footer header body html div form".split())
#: Words of class, id and role that name parts which aren't the article.
MARKS = frozenset(
    "nav navigation navbar menu menus header masthead banner footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsors sponsored promo promos promotion "
    "promotions cookie cookies consent notice notices alert alerts popup modal newsletter subscribe signup login search breadcrumb breadcrumbs pagination pager share sharing social "
    "related recommended comment comments disqus reply replies respond complementary contentinfo skiplink".split()
)
#: Of these, words that name parts which may hold more text than the article, or articles of their own.
OTHERS = frozenset("related recommended comment comments disqus reply replies respond promo promos promotion promotions sponsor sponsors sponsored ad ads advert adverts advertisement advertising".split())
#: Words that tell where or how a part stands: a name of marks and these is a mark, one with any other word isn't.
PLAIN = frozenset("list lists item items box boxes wrap wrapper container section block area bar top bottom left right site page global inner outer widget panel row col column link links button buttons icons title heading text form group post posts article articles stories user reader main wp js".split())
#: Words of a class that tell of the page what it has or lacks.
STATE = re.compile(r"(?:^|(?<=\s))(?:has|have|no|with|without)[-_]\S+", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: A node is template if its text is the same on this share of at least so many aligned pages of distinct text besides the pivot.
SAME, PAGES = 0.8, 4
#: Skeletons that share this part of their tags are one layout.
ALIKE = 0.75


def _parts(name: str) -> list[str]:
    """Words of a class or id: side-bar and skip-link are one word each."""
    words = [w.lower() for w in _PART.findall(name)]
    return " ".join(words).replace("side bar", "sidebar").replace("skip link", "skiplink").split()


@lru_cache(1 << 14)
def _marked(name: str, marks: frozenset[str] = MARKS) -> bool:
    """Whether a class, id or role names a part: comments-list and cookie-consent do, share-prices doesn't."""
    parts = _parts(name)
    return any(w in marks for w in parts) and all(w in MARKS or w in PLAIN for w in parts)


class Node:
    __slots__ = ("tag", "label", "children", "kids", "off", "mark", "shape", "size", "number", "words")

    def __init__(self, tag: str, mark: str = "", off: bool = False):
        self.tag, self.label, self.off = tag, f"{tag}.{mark}" if mark else tag, off
        self.mark = ""  # what switches the node off if nothing but its marks does
        self.children: list[Node | str] = []
        self.kids: list[Node] = []
        self.shape, self.size = 0, 1
        self.words: str | None = None
        self.number = -1


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body" or (self.stack[-1].tag == "head" and tag not in IN_HEAD):
            self._close("head")  # its end tag is optional
        if tag in CLOSES_P:
            self._close("p", stop=SCOPE - {"p"})
        if tag in ENDS_BEFORE:
            for t in ENDS_BEFORE[tag]:
                self._close(t, stop=frozenset("ul ol dl table".split()))
        mark = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        node = Node(tag, mark, tag in SILENT or tag in NO_ARTICLE)
        if not node.off and tag not in ("html", "body", "article", "main") and (named := STATE.sub(" ", mark)) and any(map(_marked, named.split())):
            node.off, node.mark = True, named
        if tag in ("article", "main") and any(_marked(w, OTHERS) for w in mark.split()):
            node.off = True
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends nothing but void elements

    def _close(self, tag: str, stop: frozenset[str] = frozenset()) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            if self.stack[k].tag in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID:
            # an inline end tag doesn't close a block around it
            self._close(tag, SCOPE | {"p"} if tag in INLINE else frozenset())

    def handle_data(self, data: str) -> None:
        if data:
            if self.stack[-1].tag == "head" and data.strip():
                self._close("head")
            self.stack[-1].children.append(data)


def parse(html: str) -> Node:
    """The tree of a page. Broken pages give a tree, too; deep nesting is kept flat beyond the parser's own stack."""
    b = _Builder()
    b.feed(html)
    b.close()
    order, todo = [], [b.root]
    while todo:  # numbers in page order, without recursion
        n = todo.pop()
        n.number = len(order)
        order.append(n)
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    _give_back(order)
    for n in reversed(order):
        n.kids = [c for c in n.children if isinstance(c, Node)]
        n.size = 1 + sum(c.size for c in n.kids)
        n.shape = hash((n.label, *(c.shape for c in n.kids)))
    return b.root


def _give_back(order: list[Node]) -> None:
    """Switch nodes that only their marks switch off on again, if they hold the article.

    They do if they hold the page's main element, all its article elements, or (where a mark is but a part of a name,
    as in content-sidebar-wrap) more than half of its text. Parts of OTHERS need an article and most of the text.
    """
    if not any(n.mark for n in order):
        return
    size, mains, articles = ([0] * len(order) for _ in range(3))
    open_articles = 0
    for n in reversed(order):  # sums over what nothing but marks switches off
        k = n.number
        if n.off and not n.mark:
            size[k] = mains[k] = articles[k] = 0
            continue
        size[k] += sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        mains[k] += n.tag == "main"
        articles[k] += n.tag == "article"
        for c in n.children:
            if isinstance(c, Node):
                size[k], mains[k], articles[k] = size[k] + size[c.number], mains[k] + mains[c.number], articles[k] + articles[c.number]
    todo = [order[0]]
    while todo:
        n = todo.pop()
        if not n.off:
            open_articles += n.tag in ("article", "main")
            todo += [c for c in n.children if isinstance(c, Node)]
    for n in order:
        if not n.mark:
            continue
        k = n.number
        most = 2 * size[k] > size[0]
        if any(_marked(w, OTHERS) for w in n.mark.split()):
            n.off = not (most and (mains[k] or articles[k]) and not open_articles)
        else:
            whole = articles[k] and articles[k] == articles[0] and not open_articles
            n.off = not (mains[k] or whole or (most and _partly(n.mark)))


def _partly(mark: str) -> bool:
    """Whether every mark in a class or id is but a part of a name whose other parts aren't marks."""
    return all(any(p not in MARKS for p in _parts(w)) for w in mark.split() if _marked(w))


def own_text(n: Node) -> str:
    """Text of a block: what stands in the node and in inline elements within it, without that of blocks within it."""
    if n.words is None:
        out: list[str] = []
        todo: list[Node | str] = list(reversed(n.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                out.append(" ")
                if x.tag in INLINE:
                    todo += reversed(x.children)
        n.words = " ".join("".join(out).split())
    return n.words


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of nodes by simple tree matching: equal roots, and an ordered matching of children of the greatest size.

    Subtrees of equal shape match node by node, which no other matching exceeds, so only the rest is worked out, and
    without recursion, so depth is not bounded.
    """
    memo: dict[tuple[int, int], int] = {}

    def ends(x: list[Node], y: list[Node]) -> tuple[int, int]:
        """Children of equal shape at the start and the end match each other in a greatest matching."""
        head, short = 0, min(len(x), len(y))
        while head < short and x[head].shape == y[head].shape:
            head += 1
        tail = 0
        while tail < short - head and x[-1 - tail].shape == y[-1 - tail].shape:
            tail += 1
        return head, tail

    def known(p: Node, q: Node) -> int | None:
        """Size of the greatest matching of two subtrees, if it is known."""
        if p.label != q.label:
            return 0
        return p.size if p.shape == q.shape else memo.get((p.number, q.number))

    def table(x: list[Node], y: list[Node]) -> list[list[int]]:
        m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                w = known(x[i - 1], y[j - 1])
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + w if w else 0)
        return m

    def rest(p: Node, q: Node) -> tuple[list[Node], list[Node], int, int]:
        """Children that aren't matched by shape, and how many are, at the start and at the end."""
        h, t = ends(p.kids, q.kids)
        return p.kids[h : len(p.kids) - t], q.kids[h : len(q.kids) - t], h, t

    def work_out(a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            p, q = todo[-1]
            if known(p, q) is not None:
                todo.pop()
                continue
            x, y, h, t = rest(p, q)
            open_ = [(c, d) for c in x for d in y if known(c, d) is None]
            if open_:
                todo += open_
                continue
            memo[p.number, q.number] = 1 + sum(c.size for c in p.kids[:h]) + sum(c.size for c in p.kids[len(p.kids) - t :]) + table(x, y)[-1][-1]
            todo.pop()

    work_out(a, b)
    pairs, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        if p.label != q.label:
            continue
        pairs.append((p, q))
        if p.shape == q.shape:
            todo += zip(p.kids, q.kids, strict=True)
            continue
        x, y, h, t = rest(p, q)
        todo += zip(p.kids[:h], q.kids[:h], strict=True)
        todo += zip(p.kids[len(p.kids) - t :], q.kids[len(q.kids) - t :], strict=True)
        if x and y:
            m = table(x, y)
            i, j = len(x), len(y)
            while i and j:
                if m[i][j] == m[i - 1][j]:
                    i -= 1
                elif m[i][j] == m[i][j - 1]:
                    j -= 1
                else:
                    todo.append((x[i - 1], y[j - 1]))
                    i, j = i - 1, j - 1
    return pairs


#: Where a segment stands, as bits.
IN_ARTICLE, IN_MAIN = 1, 2


def segments(root: Node) -> list[tuple[str, int, int]]:
    """A page's text in page order, less what is no article: (text, number of its block, bits of where it stands).

    A block with blocks within it has a segment for each stretch of its own text.
    """
    out: list[tuple[list[str], int, int]] = [([], root.number, 0)]
    todo: list[tuple[Node | str | None, int, int]] = [(root, -1, 0)]
    while todo:
        x, block, where = todo.pop()
        if x is None:
            out.append(([], block, where))
        elif isinstance(x, str):
            out[-1][0].append(x)
        elif x.off or x.tag == "br":
            out[-1][0].append(" ")
        else:
            if x.tag not in INLINE:
                todo.append((None, block, where))
                block, where = x.number, where | (IN_ARTICLE if x.tag == "article" else IN_MAIN if x.tag == "main" else 0)
                out.append(([], block, where))
            todo += [(c, block, where) for c in reversed(x.children)]
    lines = ((" ".join("".join(parts).split()), block, where) for parts, block, where in out)
    return [x for x in lines if x[0]]


def main_text(root: Node, template: set[int] | None = None) -> str:
    """Text of a page less its template blocks: blocks in page order, one a line. template: numbers of its own nodes.

    A block is template with all its inline elements, or not at all: nothing is cut out of a sentence.
    """
    left = [x for x in segments(root) if not template or x[1] not in template]
    for bit in (IN_ARTICLE, IN_MAIN):
        if inside := [x[0] for x in left if x[2] & bit]:
            return "\n".join(inside)
    return "\n".join(x[0] for x in left)


_PIVOTS: dict[str, Node] = {}


def _pivot(host: str, html: str) -> Node:
    """The worker's parsed pivots: those of the hosts it met last."""
    key = f"{host}\0{html}"
    if key not in _PIVOTS:
        if len(_PIVOTS) > 256:
            _PIVOTS.clear()
        _PIVOTS[key] = parse(html)
    return _PIVOTS[key]


#: Total bytes of pivots (one page a layout) or of layouts up to which they are broadcast; above it they are joined.
BROADCAST_BYTES = 16 << 20
_TAGS = r"<((?:/body|/html|div|section|main|article|header|footer|aside|nav|form|center|frameset|table|ul|ol|dl)\b[^>]*|(?:p|h[1-6]|td|th|li|span)\s[^>]*(?:class|id)\s*=[^>]*)>"


def skeleton(html: Column) -> Column:
    """Sorted hashes of the distinct structural tags of a page: name, class and id, without digits."""
    part = lambda t, name: F.regexp_extract(t, rf"\b{name}\s*=\s*[\"']?([^\"'>]*)", 1)
    tag = lambda t: F.xxhash64(F.regexp_extract(t, r"^(/?\w+)", 1), F.regexp_replace(part(t, "class"), r"\d", ""), F.regexp_replace(part(t, "id"), r"\d", ""))
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(F.lower(html), F.lit(_TAGS), F.lit(1))), tag)))


def layouts(pdf: pd.DataFrame) -> pd.DataFrame:
    """The distinct skeletons of one host, each with its layout's leading skeleton: the one of the most pages.

    Skeletons go by falling count to the layout they are most like, from ALIKE on, else lead one of their own. Layouts
    that have too few pages for a template are given up, and their skeletons go to those that they are most like.
    """
    pdf = pdf.sort_values(["_pages", "_skeleton"], ascending=[False, True], kind="stable")
    keys, pages = pdf["_skeleton"].to_numpy(), pdf["_pages"].to_numpy()
    tags, codes = np.unique(np.concatenate([*pdf["_tags"], np.zeros(0, np.int64)]), return_inverse=True)
    sets = np.split(codes, np.cumsum([len(t) for t in pdf["_tags"]])[:-1])
    sizes = np.array([len(t) for t in sets])
    holders: list[list[int]] = [[] for _ in tags]  # the leaders that hold each tag
    leaders: list[int] = []

    def lead(k: int) -> None:
        for t in sets[k]:
            holders[t].append(len(leaders))
        leaders.append(k)

    def best(k: int) -> tuple[int, float]:
        """The leader most like skeleton k, the earlier one of equals."""
        if not leaders:
            return -1, 0.0
        both = np.zeros(len(leaders), np.int64)
        for t in sets[k]:
            both[holders[t]] += 1
        like = (both + 1) / (sizes[leaders] + sizes[k] - both + 1)  # all pages share the root
        at = int(np.argmax(like))
        return at, float(like[at])

    total: list[int] = []
    for k in range(len(keys)):
        at, like = best(k)
        if like < ALIKE:
            at = len(leaders)
            lead(k)
            total.append(0)
        total[at] += int(pages[k])
    enough = [x for x, n in zip(leaders, total, strict=True) if n > PAGES] or [leaders[int(np.argmax(total))]]
    leaders, holders = [], [[] for _ in tags]
    for k in enough:
        lead(k)
    return pd.DataFrame({"_host": pdf["_host"].to_numpy(), "_skeleton": keys, "_layout": [keys[leaders[best(k)[0]]] for k in range(len(keys))]})


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: (id, url, text, n_chars).

    A null html is empty; a page without text has an empty one. Pages without a host in their url (or a null url) make a
    host of their own kind. The pivot is the page whose html has the least hash among those of its layout's leading skeleton,
    so ties and repeated pages change nothing. Pages whose text by the marks alone is the same have one vote together, and those that share the
    pivot's have none, so near copies of an article can't vote it into the template. Fewer than PAGES others: no template,
    the marks alone decide. Other columns aren't read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    base = pages.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{url_col}`").cast("string").alias("_url"), host.alias("_host"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("_html"))
    base = base.withColumn("_tags", skeleton(F.col("_html"))).withColumn("_skeleton", F.xxhash64("_tags"))
    full = base.where("_html <> ''")
    distinct = full.groupBy("_host", "_skeleton", F.xxhash64("_html").alias("_h")).agg(F.min("_tags").alias("_tags"))
    kinds = distinct.groupBy("_host", "_skeleton").agg(F.min("_tags").alias("_tags"), F.count(F.lit(1)).alias("_pages"))
    chosen = written(kinds.groupBy("_host").applyInPandas(layouts, "_host string, _skeleton long, _layout long"), "op7-layouts")
    few = (chosen.agg(F.sum(F.octet_length("_host") + 16)).first()[0] or 0) <= BROADCAST_BYTES
    base = base.drop("_tags").join(F.broadcast(chosen) if few else chosen, ["_host", "_skeleton"], "left")
    full = base.where("_html <> ''")
    leading = full.where("_skeleton = _layout").groupBy("_host", "_layout")
    pivots = written(leading.agg(F.min_by("_html", F.struct(F.xxhash64("_html"), F.sha2("_html", 256))).alias("_pivot")), "op7-pivots")
    small = (pivots.agg(F.sum(F.octet_length("_pivot") + F.octet_length("_host"))).first()[0] or 0) <= BROADCAST_BYTES

    def by_layout(rows: DataFrame, other: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(other) if small else other, ["_host", "_layout"], "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("node", pa.int32()), ("place", pa.int8())]))
        its_articles: dict[str, str] = {}
        for b in batches:
            articles, ballots, blocks = [], [], []
            for h, html, pivot in zip(*(b.column(k).to_pylist() for k in (2, 4, 5)), strict=True):
                root = parse(html)
                found, article, ballot, repeats = segments(root), None, None, {}
                if pivot is not None:
                    its_root = _pivot(h, pivot)
                    pairs = [(mine, its) for mine, its in match(root, its_root) if its.tag not in INLINE and own_text(its)]
                    repeats = {mine.number: its.number for mine, its in pairs if own_text(mine) == own_text(its)}
                    if html != pivot:
                        text = main_text(root)
                        if pivot not in its_articles:
                            its_articles = {pivot: main_text(its_root)} if len(its_articles) > 256 else its_articles | {pivot: main_text(its_root)}
                        if text != its_articles[pivot]:
                            article = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
                            ballot = np.array(sorted(2 * its.number + (mine.number in repeats) for mine, its in pairs), ">i4").tobytes()
                articles.append(article)
                ballots.append(ballot)
                blocks.append([{"text": t, "node": repeats.get(k, -1), "place": where} for t, k, where in found])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(articles, pa.binary()), pa.array(ballots, pa.binary()), pa.array(blocks, kind)], ["_id", "_url", "_host", "_layout", "_article", "_votes", "_blocks"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[str, int, int], list[int]] = defaultdict(lambda: [0, 0])
            for h, layout, votes in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for v in np.frombuffer(votes, ">i4").tolist():
                    n = seen[h, layout, v >> 1]
                    n[0] += 1
                    n[1] += v & 1
            if seen:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*seen, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], ["_host", "_layout", "_node", "_all", "_same"])

    id_type = pages.schema[id_col].dataType.simpleString()
    rows = by_layout(base, pivots).select("_id", "_url", "_host", "_layout", "_html", "_pivot")
    with bounded_batches(spark, rows=512, mb=4):
        parsed = written(rows.mapInArrow(read, f"_id {id_type}, _url string, _host string, _layout long, _article binary, _votes binary, _blocks array<struct<text:string,node:int,place:tinyint>>"), "op7-blocks")
    once = parsed.where("_article is not null").groupBy("_host", "_layout", "_article").agg(F.min("_votes").alias("_votes"))  # one vote for each article
    counts = once.select("_host", "_layout", "_votes").mapInArrow(count, "_host string, _layout long, _node long, _all long, _same long")
    nodes = counts.groupBy("_host", "_layout", "_node").agg(F.sum("_all").alias("_all"), F.sum("_same").alias("_same")).where((F.col("_all") >= PAGES) & (F.col("_same") >= SAME * F.col("_all")))
    with bounded_batches(spark, rows=512, mb=4):
        templates = written(nodes.groupBy("_host", "_layout").agg(F.sort_array(F.collect_list("_node")).alias("_nodes")), "op7-templates")  # a pivot's nodes at most
    left = F.when(F.col("_nodes").isNull(), F.col("_blocks")).otherwise(F.filter("_blocks", lambda x: ~F.array_contains("_nodes", x["node"].cast("long"))))

    def lines(bit: int | None) -> Column:
        inside = F.col("_left") if bit is None else F.filter("_left", lambda x: x["place"].bitwiseAND(bit) != 0)
        return F.array_join(F.transform(inside, lambda x: x["text"]), "\n")

    out = by_layout(parsed, templates).select("_id", "_url", left.alias("_left"))
    article, main = lines(IN_ARTICLE), lines(IN_MAIN)
    out = out.select("_id", "_url", F.when(article != "", article).when(main != "", main).otherwise(lines(None)).alias("text"))
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))

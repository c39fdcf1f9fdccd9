"""Main text of web pages by consensus paths of each host.

Every page scores its containers by the text of the blocks in them; its best container votes, by its
generalised path of tags and classes, with the other pages of its host; the winning path then tells which
containers all of the host's pages are read from. A page without that path is read from its own best one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed: elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "nav header footer aside menu button select textarea dialog iframe object svg canvas audio video head title noscript template script style datalist option".split()
)
CONTAINERS = frozenset("article main section div td body blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fixed: classes, ids and roles that mark what is not the article, unless the article stands inside.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "nav navbar navigation navigator menu menubar header masthead footer sidebar sidenav side rail widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "login form search share sharing social comment comments disqus reply replies respond "
    "related recommended recommendations breadcrumb breadcrumbs pagination pager tags toolbar skip copyright "
    "complementary contentinfo".split()
)
#: Fixed: parts of longer class names (comment-list, ad-slot, sidebar-left) that mark the same, if the page bears it out.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar sidenav widget widgets "
    "cookie cookies consent gdpr newsletter subscribe subscription signup share sharing social comment comments disqus "
    "related recommended recommendations breadcrumb breadcrumbs pagination pager navigation navbar nav menu footer".split()
)
#: Fixed: pairs of parts that mark together.
PAIRS = frozenset(["author box", "author bio", "author card", "about author", "site header", "page footer", "back top"])
#: Fixed: what readers write.
READERS = frozenset("comment comments disqus reply replies respond".split())
CLOSES = {
    "p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"},
    "dd": {"dt", "dd"}, "option": {"option"}
}
#: Comments, of which <!--> is a whole one, and elements whose content is no markup; all others are scanned as tags.
_RAW = re.compile(
    r"<!---?>|<!--.*?(?:--!?>|\Z)|<(script|style|textarea|title|iframe|xmp|noembed|noframes)\b"
    r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\b[^>]*>|\Z)",
    re.S | re.I
)
#: Fixed: elements that end a drawing which was left open.
BREAKS = HEADINGS | frozenset("blockquote body center dd div dl dt hr img li menu ol p pre table ul".split())
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*>?")
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[^a-z]+")


class Node:
    """An open element; `titles` is set in an article's header, of which only the headings count. `marked` is the share of the
    page's prose from which on the element is no boilerplate after all, 0 if nothing marks it."""

    __slots__ = ("tag", "path", "dropped", "number", "marked", "titles")

    def __init__(self, tag: str, path: str, dropped: bool, number: int, marked: float = 0.0, titles: bool = False):
        self.tag, self.path, self.dropped, self.number = tag, path, dropped, number
        self.marked, self.titles = marked, titles


#: A form, a name of which a part marks, and a name that is nothing but such words, or is about readers' comments.
FORM, PART, WHOLE = 0.5, 0.5, 0.9


def mark(value: str) -> float:
    """How a class, id or role marks an element: 0 for not at all."""
    found = 0.0
    for token in value.split():
        parts = list(filter(None, _PART.split(token)))
        if not parts:
            continue
        if BOILERPLATE.issuperset(parts) or not READERS.isdisjoint(parts):
            return WHOLE
        if not PARTS.isdisjoint(parts) or any(f"{x} {y}" in PAIRS for x, y in zip(parts, parts[1:])):
            found = PART
    return found


def blocks(html: str) -> list[tuple[str, int, list[Node]]]:
    """(text, characters in links, open elements) of every block that is not boilerplate, in page order.

    A marked element is boilerplate unless the page speaks against it: it holds the page's main or only article, or so
    much of the text outside links (of that article, on pages with one) as its mark asks for; more than half for a form or a
    name of which a part marks, nine tenths for other names. An element without a first heading, on a page that has one
    elsewhere, needs nine tenths. A page that has no other blocks keeps those of marked elements.
    """
    every = list(_blocks(html))
    if not any(n.marked for _, _, around in every for n in around):
        return every
    size, marks, titled = defaultdict(int), {}, set()
    heads = {"main": set(), "article": set()}
    for text, linked, around in every:
        for n in around:
            size[n.number] += max(0, len(text) - linked)
            if n.marked:
                marks[n.number] = n.marked
            if n.tag in heads:
                heads[n.tag].add(n.number)
            if around[-1].tag == "h1":
                titled.add(n.number)
    body = heads["main"] or (heads["article"] if len(heads["article"]) == 1 else set())
    outer = {
        n.number for _, _, around in every for k, n in enumerate(around) if any(x.number in body for x in around[k:])
    }
    whole = sum(size[k] for k in body) or sum(max(0, len(text) - linked) for text, linked, _ in every)
    need = {k: WHOLE if titled and k not in titled and share != FORM else share for k, share in marks.items()}
    inside = {
        n.number for _, _, around in every for k, n in enumerate(around) if any(x.number in body for x in around[:k])
    }
    left = {
        k for k in marks
        if k not in outer and (size[k] <= whole * (marks[k] if k in inside else need[k]) or body and k not in inside)
    }
    return [x for x in every if not any(n.number in left for n in x[2])] or every


def _blocks(html: str) -> Iterator[tuple[str, int, list[Node]]]:
    """Blocks outside dropped elements, those of marked elements among them."""
    html = _RAW.sub(" ", html)
    stack, parts, linked, number = [Node("", "", False, 0)], [], 0, 0
    at, in_link = 0, 0

    def flush() -> tuple[str, int, list[Node]] | None:
        nonlocal parts, linked
        text, n = " ".join(unescape("".join(parts)).split()), linked
        parts, linked = [], 0
        here = stack[-1]
        shown = not here.dropped and (not here.titles or here.tag in HEADINGS)
        return (text, n, stack[:]) if text and shown else None

    for m in _TAG.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if m[1] else 1
            continue
        if (done := flush()) is not None:
            yield done
        in_link = 0
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in BREAKS and stack[-1].dropped:
            inner = [n.tag for n in stack]
            if "svg" in inner and "foreignobject" not in inner:
                del stack[inner.index("svg") :]
        if tag in VOID or _CLOSED.search(m[3]):
            continue
        shut = CLOSES.get(tag, {"p"} if tag not in ("tr", "td", "th", "li", "dt", "dd") else set())
        if stack[-1].tag in shut:
            stack.pop()
        names = {}
        if m[3]:
            for a in _ATTR.finditer(m[3]):
                names.setdefault(a[1].lower(), (a[2] or a[3] or a[4] or "").lower())
        shown = re.sub(r"\d+", "#", " ".join(names.get("class", "").split()[:2]))
        titles = stack[-1].titles or (tag == "header" and any(n.tag in ("article", "main") for n in stack))
        drop = stack[-1].dropped or (tag in DROPPED and not (titles and tag == "header"))
        marked = 0.0 if tag in ("html", "body", "article", "main") else max(map(mark, names.values()), default=0.0)
        marked = marked or FORM * (tag == "form")
        number += 1
        path = f"{stack[-1].path}>{tag}" + (f".{shown}" if shown else "")
        stack.append(Node(tag, path, drop, number, marked, titles))
    parts.append(html[at:])
    if (done := flush()) is not None:
        yield done


def is_container(node: Node) -> bool:
    return node.tag in CONTAINERS or node.number == 0


def _belongs(block: tuple[str, int, list[Node]], node: Node, before: bool, small: bool) -> bool:
    """Whether a block of `node` beside the article's container is part of the article: text of `node` itself, a
    heading, or what stands in a small part before it."""
    around = block[2]
    if around[-1].tag in HEADINGS:
        return True
    inner = next(n for n in reversed(around) if is_container(n))
    return node.tag not in ("body", "") and (inner is node or (before and small))


def _widened(found: list[tuple[str, int, list[Node]]], top: Node) -> Node:
    """The container around `top`, or around that one and so on, whose other blocks belong to the article too.

    They do in an article or main element, unless they stand in another article; elsewhere if each of them does by
    itself, or if the container has running text of its own between its parts.
    """
    chain = next(around for _, _, around in found if top in around)
    for node in [n for n in reversed(chain[: chain.index(top)]) if is_container(n)]:
        at = [k for k, (_, _, around) in enumerate(found) if top in around]
        more = [k for k, (_, _, around) in enumerate(found) if node in around and top not in around]
        if not more:
            continue
        size = sum(len(found[k][0]) for k in at)
        extra, linked = sum(len(found[k][0]) for k in more), sum(found[k][1] for k in more)
        small, heads = extra < size / 3, any(found[k][2][-1].tag in HEADINGS for k in more)
        deeper = [found[k][2][found[k][2].index(node) + 1 :] for k in more]
        if any(n.tag == "article" for around in deeper for n in around):
            break
        inner = [next(n for n in reversed(found[k][2]) if is_container(n)) for k in more]
        running = node.tag not in ("body", "") and any(
            n is node and found[k][2][-1].tag not in HEADINGS and 2 * found[k][1] < len(found[k][0]) for k, n in zip(more, inner)
        )
        own = node.tag in ("article", "main") or running
        own = own or all(_belongs(found[k], node, k < at[0], small and heads) for k in more)
        if not own or 2 * linked >= extra:
            break
        top = node
    return top


def best_path(html: str) -> tuple[str, float] | None:
    """The page's best container and its share of the score: blocks count for the containers around them,
    half as much for each further one out. The page itself is the outermost container. From the best one it
    goes outwards while what is added is text, headings or an opening of the same article."""
    found = blocks(html)
    score, nodes = defaultdict(float), {}
    for text, linked, around in found:
        value, gain = len(text) * max(0.0, 1 - linked / len(text)), 1.0
        for node in reversed(around):
            if is_container(node):
                score[node.number] += value * gain * (1.5 if node.tag in ("article", "main") else 1.0)
                nodes[node.number] = node
                gain /= 2
    if not score:
        return None
    top = max(score, key=lambda k: (score[k], -k))
    return _widened(found, nodes[top]).path, score[top] / (sum(score.values()) or 1.0)


def text_at(html: str, path: str | None) -> str:
    """Text of the blocks inside all containers with the path; of several articles that of the longest, as each of them
    is a story of its own."""
    if path is None:
        return ""
    found = blocks(html)
    own = [next((n.number for n in around if n.path == path), None) for _, _, around in found]
    if path.rpartition(">")[2].split(".")[0] == "article":
        size = defaultdict(int)
        for (text, linked, _), k in zip(found, own):
            if k is not None:
                size[k] += len(text) - min(linked, len(text))
        longest = max(size, key=lambda k: (size[k], -k), default=None)
        own = [k if k == longest else None for k in own]
    return "\n\n".join(text for (text, _, _), k in zip(found, own) if k is not None)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        votes = defaultdict(lambda: [0.0, 0])
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            if (got := best_path(html or "")) is not None:
                v = votes[host, got[0]]
                v[0] += round(got[1], 6)
                v[1] += 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()),
                pa.array([v[0] for v in votes.values()], pa.float64()),
                pa.array([v[1] for v in votes.values()], pa.int64())
            ],
            names=["host", "path", "score", "pages"]
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for html, path in zip(b.column("html").to_pylist(), b.column("path").to_pylist()):
            html = html or ""
            text = text_at(html, path)
            if not text and (own := best_path(html)) is not None:
                text = text_at(html, own[0])
            texts.append(text)
        names = [c for c in b.schema.names if c not in ("html", "path")]
        yield pa.RecordBatch.from_arrays(
            [
                *(b.column(c) for c in names), pa.array(texts, pa.string()),
                pa.array(list(map(len, texts)), pa.int64())
            ],
            names=[*names, "text", "n_chars"]
        )


def host_of(url: str = "url"):
    return F.coalesce(
        F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")
    )


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of each host, by pages, then score, then name."""
    votes = pages.select(host_of().alias("host"), "html").where("html <> ''").mapInArrow(
        _vote, "host string, path string, score double, pages long"
    )
    total = votes.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.sum("score").alias("score"))
    return total.groupBy("host").agg(F.max(F.struct("pages", F.round("score", 3), "path")).alias("top")).select(
        "host", F.col("top.path").alias("path")
    )


#: Up to so many hosts' paths are broadcast; above, the paths are copied over SALTS parts of each host.
MAX_HOSTS, SALTS = 100_000, 64


def with_host_path(rows: DataFrame, winners: DataFrame, max_hosts: int = MAX_HOSTS) -> DataFrame:
    """rows(host, html, ...) with their host's path; no task gets all pages of a host."""
    if winners.count() <= max_hosts:
        return rows.join(F.broadcast(winners), "host", "left")
    copies = winners.select("host", "path", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(
        copies, ["host", "salt"], "left"
    ).drop("salt")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null or empty html, and pages without any block outside menus, adverts and the like, have an empty text; text
    without any markup is one block. Pages without a host (null or odd url) vote together; equal votes go to the
    greater score, then to the path that sorts last. Very long pages are read whole, repeated rows are extracted
    alike, other columns are ignored, and an empty table gives an empty result.
    """
    winners = written(host_paths(pages), "host_paths")
    rows = with_host_path(pages.select("page_id", "url", "html", host_of().alias("host")), winners).select(
        "page_id", "url", "html", "path"
    )
    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")

"""Main text of web pages by consensus of a host's pages on container paths.

Each page is parsed into blocks in a tree of containers, and containers are scored by the share of the
page's own text that they hold. A container is known by its generalised path: tags with classes, digits
left out, hashed step by step. Menus, footers, asides, forms and hidden parts are told by tag and role.
Elements that are only named like clutter (class or id such as sidebar, widget, share) are suspects:
a page takes a suspect for content if it holds most of the page's text and that isn't mostly links,
and reader comments only if there is nothing else.

Pages vote for their best path and on each suspect path, Spark counts the votes by host, and pages
that differ from a clear majority of their host are extracted again with the host's winning path and
its verdicts on suspects.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Scratch, map_arrow, table

_TOKEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z]+")

_RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CLUTTER_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "object", "head", "fieldset", "canvas", "audio", "video"}
_CLUTTER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
_CLUTTER_WORDS = set(
    "nav navbar navigation menu sidebar footer header masthead cookie cookies consent gdpr notice notices alert banner ad ads adv advert adverts"
    " advertisement advertisements adsense sponsor sponsored sponsors promo promotion comment comments commentlist respond replies disqus discussion"
    " share sharing social related recommended recommendations breadcrumb breadcrumbs popup modal overlay newsletter subscribe signup login search"
    " pagination pager toolbar widget skip copyright".split()
)
_COMMENT_WORDS = {"comment", "comments", "commentlist", "respond", "replies", "disqus", "discussion"}
_HEADER_WORDS = {"header", "banner", "notice", "masthead"}
_QUALIFIERS = {"with", "has", "no", "without"}
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTENT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "dd", "dt", "td", "th", "figcaption"}
_CONTAINERS = {"article", "main", "section", "div", "body", "td", "html", "center"}
#: A start tag ends an open element of these, unless one of the barriers lies between.
_CLOSES = {
    **{t: {"p"} for t in _BLOCKS - {"body", "html", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}},
    "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
    "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tbody": {"tbody", "thead", "tr", "td", "th", "p"},
}
_BARRIERS = {"article", "section", "main", "div", "body", "html", "table", "ul", "ol", "dl", "nav", "aside", "footer", "header", "form", "blockquote", "select"}
#: Shares of a page's text: for article and main, and for any other container.
_NAMED_SHARE, _SHARE = 0.3, 0.75
#: A suspect with this share of the page's text, at most half of it in links, is content.
_LIFT_SHARE = 0.5


class Node:
    """A container or suspect: its path, and the text under it (a suspect's text counts for its ancestors too)."""

    __slots__ = ("comment", "content", "depth", "links", "parent", "path", "step", "suspect", "tag", "text")

    def __init__(self, parent: Node | None, tag: str, step: str, suspect: bool, comment: bool) -> None:
        self.parent, self.tag, self.step, self.suspect, self.comment = parent, tag, step, suspect, comment
        self.depth = parent.depth + 1 if parent else 0
        self.path = _path(parent.path, step) if parent else 0
        self.text = self.links = self.content = 0


@lru_cache(maxsize=100_000)
def _path(parent: int, step: str) -> int:
    """64 bits for a path: its parent's and its last step."""
    return int.from_bytes(hashlib.blake2b(f"{parent}>{step}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@dataclass
class Block:
    """Text between two block borders, how much of it is in links, and its innermost container."""

    text: str
    tag: str
    links: int
    node: Node


@dataclass
class _Open:
    tag: str
    clutter: bool
    node: Node
    in_article: bool
    link: bool


@dataclass
class Page:
    """The blocks of a page that are no clutter by tag or role, and the containers, parents first."""

    blocks: list[Block] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def _clutter_name(name: str, in_article: bool) -> bool:
    parts = [p for p in _SPLIT.split(name.lower()) if p]
    if not parts or parts[0] in _QUALIFIERS:
        return False
    bad = {parts[0], parts[-1]} & _CLUTTER_WORDS
    return bool(bad - _HEADER_WORDS if in_article else bad)


def _is_clutter(tag: str, own: dict[str, str], in_article: bool) -> bool:
    """Whether tag, role or style say so."""
    if tag in ("html", "body", "main", "article"):
        return False
    if tag in _CLUTTER_TAGS or (tag == "header" and not in_article):
        return True
    if not own:
        return False
    hidden = "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", own.get("style", ""))
    return bool(hidden) or own.get("role", "").lower() in _CLUTTER_ROLES


def _suspect(tag: str, own: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """Whether class or id sound like clutter, and like reader comments."""
    names = own.get("class", "").split() + own.get("id", "").split() if own else []
    comment = any(set(_SPLIT.split(n.lower())) & _COMMENT_WORDS for n in names)
    if tag in ("html", "body", "main", "article"):
        return tag == "article" and comment, tag == "article" and comment
    suspect = any(_clutter_name(n, in_article) for n in names)
    return suspect, suspect and comment


def _step(tag: str, own: dict[str, str]) -> str:
    """One step of a generalised path: the tag and its sorted classes, digits as #."""
    classes = sorted({re.sub(r"\d+", "#", c) for c in own.get("class", "").split()})
    return ".".join([tag, *classes])


def parse(source: str) -> Page:
    """The blocks of a page outside clutter, in page order, and its containers."""
    page = Page(nodes=[Node(None, "", "", False, False)])
    stack: list[_Open] = [_Open("", False, page.nodes[0], False, False)]
    pieces: list[str] = []
    linked = 0
    at, end = 0, len(source)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                tag = next((o.tag for o in reversed(stack) if o.tag in _BLOCKS), "")
                page.blocks.append(Block(text, tag, min(linked, len(text)), stack[-1].node))
        linked = 0

    def text(upto: int) -> None:
        nonlocal linked
        if upto > at and not stack[-1].clutter:
            raw = source[at:upto]
            pieces.append(html.unescape(raw) if "&" in raw else raw)
            if stack[-1].link:
                linked += len(raw)

    while at < end:
        i = source.find("<", at)
        m = _TOKEN.match(source, i) if i >= 0 else None
        while i >= 0 and m is None:  # a lone "<" is text
            i = source.find("<", i + 1)
            m = _TOKEN.match(source, i) if i >= 0 else None
        text(i if m else end)
        if m is None:
            break
        at = m.end()
        if m[1]:
            close = source.find("-->", m.end())
            at = end if close < 0 else close + 3
            continue
        if m[2]:
            close = source.find("]]>", m.end())
            at = end if close < 0 else close + 3
            continue
        if m[3]:
            close = source.find(">", m.end())
            at = end if close < 0 else close + 1
            continue
        tag = m[5].lower()
        if m[4]:
            if tag in _BLOCKS:
                flush()
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if depth and not (tag not in _BLOCKS and any(o.tag in _BARRIERS for o in stack[depth + 1 :])):
                del stack[depth:]
            continue
        if tag in _RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
            at = close.end() if close else end
            continue
        if tag in _BLOCKS:
            flush()
        if tag == "br":
            pieces.append("\n")
        if tag in _VOID:
            continue
        closes = _CLOSES.get(tag)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in _BARRIERS:
                    break
        own = _attributes(m[6])
        top = stack[-1]
        clutter = top.clutter or _is_clutter(tag, own, top.in_article)
        if m[6].rstrip().endswith("/") and tag not in _BLOCKS:
            continue
        node = top.node
        if not clutter:
            suspect, comment = _suspect(tag, own, top.in_article)
            if suspect or tag in _CONTAINERS:
                node = Node(top.node, tag, _step(tag, own), suspect, comment)
                page.nodes.append(node)
        stack.append(_Open(tag, clutter, node, top.in_article or tag in ("article", "main"), top.link or tag == "a"))
    flush()
    _measure(page.nodes, page.blocks)
    return page


def _measure(nodes: list[Node], blocks: list[Block]) -> None:
    """Set the text, links and content blocks under each node."""
    for n in nodes:
        n.text = n.links = n.content = 0
    for b in blocks:
        b.node.text += len(b.text)
        b.node.links += b.links
        b.node.content += b.tag in _CONTENT_BLOCKS
    for n in reversed(nodes):  # children come after their parents
        if n.parent:
            n.parent.text += n.text
            n.parent.links += n.links
            n.parent.content += n.content


def verdicts(page: Page) -> dict[int, bool]:
    """By path of a suspect, whether this page alone takes it for content."""
    total = page.nodes[0].text
    sums: dict[int, list[int]] = {}
    for n in page.nodes:
        if n.suspect and n.text:
            own = sums.setdefault(n.path, [0, 0, 0])
            own[0] += n.text
            own[1] += n.links
            own[2] = max(own[2], n.comment)
    outside = _kept(page, {}, None)
    named = sum(len(b.text) for b in outside if _in_article(b.node)) >= _NAMED_SHARE * total
    return {
        path: not named and 2 * links <= text and (not outside if comment else text >= _LIFT_SHARE * total)
        for path, (text, links, comment) in sums.items()
    }


def _in_article(node: Node | None) -> bool:
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def _kept(page: Page, lifted: dict[int, bool], path: int | None) -> list[Block]:
    """The blocks outside suspects that aren't lifted and, unless the path is None, under the path."""
    inside: dict[int, tuple[bool, bool]] = {}  # by node: cut, and under the path
    for n in page.nodes:
        cut, under = inside[id(n.parent)] if n.parent else (False, False)
        inside[id(n)] = cut or (n.suspect and not lifted.get(n.path, False)), under or n.path == path
    return [b for b in page.blocks if not inside[id(b.node)][0] and (path is None or inside[id(b.node)][1])]


def choose(page: Page, lifted: dict[int, bool]) -> int:
    """The path of the page's best container, given the verdicts on suspects; 0 if it has no text.

    article and main win with a fair share of the text. Otherwise the choice goes inwards from the
    page while one path keeps most of the text and loses no paragraph, heading or list item.
    """
    blocks = _kept(page, lifted, None)
    _measure(page.nodes, blocks)
    total, content = page.nodes[0].text, page.nodes[0].content
    held: dict[int, list] = {}
    for n in page.nodes[1:]:
        if n.text:
            own = held.setdefault(n.path, [0, 0, n])
            own[0] += n.text
            own[1] += n.content
    _measure(page.nodes, page.blocks)
    named = [p for p, (text, _, n) in held.items() if text >= _NAMED_SHARE * total and n.tag in ("article", "main")]
    if named:
        return max(named, key=lambda p: (held[p][0], held[p][2].depth, p))
    best = 0
    for p, (text, own, n) in sorted(held.items(), key=lambda x: (x[1][2].depth, x[0])):
        if text < _SHARE * total or own < content:
            continue
        up = n.parent
        while up is not None and up.depth > 0 and up.path != best and best:
            up = up.parent
        if not best or (up is not None and up.path == best):
            best = p
    return best


def extract(page: Page, path: int | None = None, told: dict[int, bool] | None = None) -> str:
    """The text under a path, or under the page's own choice if it holds none there.

    ``told`` are a host's verdicts on suspects; the page's own count for others, and for all where
    nothing is left by the host's.
    """
    own = verdicts(page)
    lifted = own | (told or {})
    chosen = _kept(page, lifted, path) if path else []
    if not chosen:
        chosen = _kept(page, lifted, choose(page, lifted) or None)
    if not chosen:
        chosen = _kept(page, own, choose(page, own) or None)
    return "\n".join(b.text for b in chosen)


#: Votes of a page: its best path, and whether each suspect is content.
_VOTE = "page_id bigint, host string, path bigint, suspects array<bigint>, lifted array<boolean>"


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, host, html -> the columns of ``_VOTE``."""
    for batch in batches:
        paths, suspects, lifted = [], [], []
        for source in batch.column(2).to_pylist():
            page = parse(source or "")
            own = verdicts(page)
            paths.append(choose(page, own) or None)
            suspects.append(list(own))
            lifted.append(list(own.values()))
        made = [pa.array(paths, pa.int64()), pa.array(suspects, pa.list_(pa.int64())), pa.array(lifted, pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["page_id", "host", "path", "suspects", "lifted"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url, winner, suspects, lifted, html -> page_id, url, text, n_chars."""
    for batch in batches:
        winners, suspects, lifted, sources = (c.to_pylist() for c in batch.columns[2:])
        texts = [
            extract(parse(h or ""), w, dict(zip(s or [], v or [], strict=True)))
            for w, s, v, h in zip(winners, suspects, lifted, sources, strict=True)
        ]
        made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["page_id", "url", "text", "n_chars"])


def host_of(url: str) -> Column:
    """The lower-cased host of a URL column; null if it has none."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


#: Parts that a host's votes are dealt to when they meet the host's decision.
SALTS = 32


def winners(votes: DataFrame) -> DataFrame:
    """host, winner: the path that more than half of a host's pages, and two at least, voted for."""
    counts = votes.where("host is not null and path is not null").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("host").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "path")).alias("best"))
    return best.where("best.n >= 2 and 2 * best.n > pages").select("host", F.col("best.path").alias("winner"))


def decisions(votes: DataFrame) -> DataFrame:
    """host, suspect, content: what more than half of the pages with a suspect path, and two at least, take it for."""
    each = votes.where("host is not null").select("host", F.explode(F.arrays_zip("suspects", "lifted")).alias("v"))
    counts = each.groupBy("host", F.col("v.suspects").alias("suspect")).agg(F.count(F.lit(1)).alias("n"), F.count_if("v.lifted").alias("yes"))
    return counts.where("n >= 2 and 2 * yes <> n").select("host", "suspect", (2 * F.col("yes") > F.col("n")).alias("content"))


def _salted(rows: DataFrame, decided: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join that deals the rows of each key to ``SALTS`` parts."""
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS).cast("bigint")))
    spread = decided.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return dealt.join(spread, [*keys, "__salt"]).drop("__salt")


def corrections(votes: DataFrame, best: DataFrame, decided: DataFrame) -> DataFrame:
    """page_id, host, winner, suspects, lifted: pages whose votes differ from their host's."""
    known = votes.where("page_id is not null and host is not null")
    path = _salted(known.select("page_id", "host", "path"), best, ["host"]).where("not (path <=> winner)").select("page_id", "host", "winner")
    each = known.select("page_id", "host", F.explode(F.arrays_zip("suspects", "lifted")).alias("v")).select("page_id", "host", F.col("v.suspects").alias("suspect"), F.col("v.lifted").alias("own"))
    other = _salted(each, decided, ["host", "suspect"]).where("own <> content")
    told = other.groupBy("page_id", "host").agg(F.sort_array(F.collect_set(F.struct("suspect", "content"))).alias("told"))
    rows = path.groupBy("page_id", "host").agg(F.max("winner").alias("winner")).join(told, ["page_id", "host"], "full")
    return rows.select("page_id", "host", "winner", F.col("told.suspect").alias("suspects"), F.col("told.content").alias("lifted"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> page_id, url, text, n_chars; one row for each page.

    A null or empty html gives an empty text. Pages without a host or an id decide alone. Repeated
    rows get the same text each; a tie of votes leaves each page to itself; other columns are left
    out. ``pages`` must be a stable scan, such as a Parquet table: it is read twice.
    """
    scratch = Scratch(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    votes = scratch.put("votes", map_arrow(source.select("page_id", host_of("url").alias("host"), "html"), _votes, _VOTE))
    wrong = scratch.put("corrections", corrections(votes, winners(votes), decisions(votes)))
    scratch.drop("votes")
    # a page that agrees with its host needs no row; Spark broadcasts the others only if their table is small
    keyed = source.withColumn("host", host_of("url")).join(wrong, ["page_id", "host"], "left")
    return map_arrow(keyed.select("page_id", "url", "winner", "suspects", "lifted", "html"), _texts, "page_id bigint, url string, text string, n_chars bigint")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_html_text": op5_html_text}
ORACLES: dict[str, str] = {}

"""Main text of web pages by consensus container paths per host.

Pass 1 parses every page into a tree of elements and its text blocks. Containers are
scored bottom-up by the text outside boilerplate elements that they hold, less the text
of links; a page votes for the path (generalised: tag, and class names without digits)
of its deepest container that holds nearly all of it, extended to the article around
it, so titles, leads and ends beside it stay. Spark adds up the votes per host and
path. Pass 2 joins each page with the winning paths of its host and re-extracts: a page
whose own choice is among the winners keeps it, another takes the host's strongest
winner that holds a fair part (``FAIR``) of what its own choice holds, and only a page
with none of them falls back to its own choice.

Boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments, hidden elements) is recognised by tag, role, ``hidden``, and
class or id names, and is left out inside a winning container as well. Names count
whole: ``sidebar``, ``cookie-notice`` and ``widget-area`` are boilerplate,
``content-sidebar-wrap`` and ``side-effects`` are not. They count for containers only,
and for sections of an article only where they name comments, adverts and the like.
Neither names nor ``form`` nor ``header`` rule out an element that holds the page's
main article, or, on pages without any, most of its text. A page header that holds the
article's own title (``header`` inside ``article`` or ``main``) stays.

Work and memory are linear in the length of a page, whatever its nesting.

Shuffles: the votes per (host, path) with partial sums; the pages once by host,
unless the winners are small enough for Spark to broadcast. The join reads two
plain tables, so adaptive execution can split a host with a third of all pages.

Defined cases: null or empty html gives an empty text; a null URL votes with the
empty host; unclosed, misnested and truncated markup is closed where HTML would;
text of any length is kept whole; repeated rows stay separate rows; other columns
are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, stored

# Element names of the HTML standard, by what they do to text.
RAW_TEXT = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "object", "svg", "math",
            "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "td", "th", "center", "nav", "aside", "header",
              "footer", "form", "figure", "details", "dialog", "fieldset", "table", "tbody", "tr", "ul", "ol", "dl",
              "blockquote"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "hr", "address", "thead",
                       "tfoot", "caption", "figcaption", "summary", "legend", "option", "menu", "hgroup"}
#: an open element of the key ends when one of the values opens
CLOSED_BY = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"},
             "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
NOT_MAIN_TAGS = {"nav", "footer", "aside", "button", "select", "head", "menu", "dialog", "input", "label"}
NOT_MAIN_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar",
                  "dialog", "alert", "alertdialog", "toolbar"}
NOT_MAIN_TOKENS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor",
    "sponsored", "promo", "promotion", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header",
    "masthead", "topbar", "footer", "sidebar", "side", "aside", "widget", "widgets", "related", "recommended",
    "recommendations", "notice", "notices", "cookie", "cookies", "consent", "gdpr", "alert", "popup", "modal", "overlay",
    "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "comment", "comments", "commentlist",
    "respond", "reply", "replies", "discussion", "disqus", "form", "search", "pagination", "pager", "toolbar",
    "disclaimer", "copyright", "legal"}

#: names that rule out sections of an article too
NOT_ARTICLE_TOKENS = NOT_MAIN_TOKENS - {"menu", "header", "banner", "side", "notice", "notices", "alert", "overlay",
                                        "modal", "respond", "reply", "replies", "discussion", "form", "search",
                                        "toolbar", "disclaimer", "copyright", "legal", "login", "consent", "navigation"}
#: parts of names that say nothing about the content
NEUTRAL_TOKENS = {"left", "right", "top", "bottom", "inner", "outer", "area", "list", "box", "bar", "block", "slot", "unit",
                  "links", "buttons", "posts", "items", "item", "container", "wrapper", "wrap", "section", "primary",
                  "secondary", "panel", "column", "col", "row", "group", "title", "site", "page", "x", "id", "js"}

#: names that rule out sections of an article too
NOT_ARTICLE_TOKENS = NOT_MAIN_TOKENS - {"menu", "header", "banner", "side", "notice", "notices", "alert", "overlay",
                                        "modal", "respond", "reply", "replies", "discussion", "form", "search",
                                        "toolbar", "disclaimer", "copyright", "legal", "login", "consent", "navigation"}
#: parts of names that say nothing about the content
NEUTRAL_TOKENS = {"left", "right", "top", "bottom", "inner", "outer", "area", "list", "box", "bar", "block", "slot", "unit",
                  "links", "buttons", "posts", "items", "item", "container", "wrapper", "wrap", "section", "primary",
                  "secondary", "panel", "column", "col", "row", "group", "title", "site", "page", "x", "id", "js"}

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def _names(names: list[str], tokens: set[str]) -> bool:
    """Whether a class or id name is made of these tokens, but for parts that say nothing."""
    for name in names:
        parts = set(_TOKEN.findall(name))
        if parts & tokens and parts <= tokens | NEUTRAL_TOKENS:
            return True
    return False


def _described(attributes: str) -> tuple[str, list[str], str, bool]:
    """Generalised class part of a path step, class and id names, role, and whether the element is hidden."""
    kind, names, role, hidden = "", [], "", False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            value = html.unescape(value.strip("\"'")).lower()
            if name == "role":
                role = value.strip()
            elif name == "id":
                names.append(value)
            else:
                names += value.split()
                kind = "".join(f".{re.sub(r'[0-9]+', '', t)}" for t in sorted(set(value.split())))
        elif name == "hidden":
            hidden = value.strip("\"'").lower() != "until-found"
    return kind, names, role, hidden


class Page:
    """Elements of a page in order (0: the page itself) and its text blocks."""

    def __init__(self):
        self.parent, self.name, self.step, self.container = [0], [""], [""], [True]
        self.hard, self.soft = [False], [False]  # out whatever they hold; out by names, ``form`` or ``header``
        self.texts: list[str] = []
        self.at: list[int] = []                  # innermost element of each text
        self.worth: list[int] = []               # characters of each text that are no links

    def open(self, parent: int, name: str, step: str, container: bool, hard: bool, soft: bool) -> int:
        for column, value in ((self.parent, parent), (self.name, name), (self.step, step), (self.container, container),
                              (self.hard, hard), (self.soft, soft)):
            column.append(value)
        return len(self.parent) - 1

    def summed(self, out: list[bool]) -> list[int]:
        """Worth of the texts below each element that are not out."""
        total = [0] * len(self.parent)
        for at, worth in zip(self.at, self.worth):
            if not out[at]:
                total[at] += worth
        for k in range(len(total) - 1, 0, -1):  # children come after their parents
            total[self.parent[k]] += total[k]
        return total

    def _below(self, own: list[bool]) -> list[bool]:
        out = [False] * len(own)
        for k in range(1, len(own)):
            out[k] = own[k] or out[self.parent[k]]
        return out

    def boilerplate(self) -> list[bool]:
        """Whether each element is out."""
        gone = self._below(self.hard)
        if not any(self.soft):
            return gone
        total = self.summed(gone)
        article = max((k for k, name in enumerate(self.name) if name in ("article", "main") and not gone[k] and total[k]),
                      key=lambda k: (self.name[k] == "article", total[k], -k), default=None)
        keep = set()
        if article is not None:
            while article:
                keep.add(article)
                article = self.parent[article]
        return self._below([h or s and k not in keep and not (not keep and 2 * total[k] > total[0])
                            for k, (h, s) in enumerate(zip(self.hard, self.soft))])


def parse(page: str) -> Page:
    tree = Page()
    stack = [0]
    names: dict[str, int] = {}      # how many of each name are open
    closable = [0]                  # open elements that an opening one may end, by open container
    articles = links = muted = 0
    pieces: list[str] = []
    linked = 0
    endless: set[str] = set()       # raw-text elements without any further end tag

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                tree.texts.append(text)
                tree.at.append(stack[-1])
                tree.worth.append(max(0, len(text) - linked))
            pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal articles, links, muted
        while len(stack) > depth:
            k = stack[-1]
            name = tree.name[k]
            if name in BLOCKS:
                flush()
            elif tree.hard[k]:
                muted -= 1
            stack.pop()
            names[name] -= 1
            if tree.container[k]:
                closable.pop()
            elif name in CLOSED_BY:
                closable[-1] -= 1
            articles -= name in ("article", "main")
            links -= name == "a"

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not muted:
            piece = page[at:lt]
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        if lt == n:
            break
        m = _TAG.match(page, lt)
        if m is None:
            pieces.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if page.startswith("<![CDATA[", lt) and not muted:
                pieces.append(html.escape(page[lt + 9:at].removesuffix("]]>")))
            continue
        if m[1] if m[2] else m[4]:
            if names.get(name):
                for depth in range(len(stack) - 1, 0, -1):
                    k = stack[depth]
                    if tree.name[k] == name:
                        close(depth)
                        break
                    if tree.container[k] and name not in CONTAINERS:
                        break  # a stray inline end tag does not leave its container
            if name in BLOCKS:
                flush()
            continue
        if name in RAW_TEXT:
            end = None
            if name not in endless:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if not end:
                    endless.add(name)
            if end:
                at = end.end()
            elif name in ("script", "style", "title", "textarea"):
                at = n
            continue
        block = name in BLOCKS
        if block:
            flush()
            if closable[-1]:
                for depth in range(len(stack) - 1, 0, -1):
                    k = stack[depth]
                    if name in CLOSED_BY.get(tree.name[k], ()):
                        close(depth)
                        break
                    if tree.container[k]:
                        break
            elif tree.container[stack[-1]] and name in CLOSED_BY.get(tree.name[stack[-1]], ()):
                close(len(stack) - 1)
        if name == "br" and not muted:
            pieces.append(" ")
        if name in VOID:
            continue
        container, step = name in CONTAINERS, name
        hard, soft = name in NOT_MAIN_TAGS, name == "form" or name == "header" and not articles
        attributes = m[3] if m[2] else m[6]
        if attributes:
            kind, called, role, hidden = _described(attributes)
            step += kind
            if called and container and name not in ("html", "body", "main", "article"):
                tokens = NOT_MAIN_TOKENS
                if articles:
                    tokens = NOT_ARTICLE_TOKENS if name == "section" else NOT_MAIN_TOKENS - {"header"}
                soft = soft or _names(called, tokens)
            hard = hard or hidden or block and role in NOT_MAIN_ROLES
        if hard and not block:
            muted += 1
        links += name == "a"
        articles += name in ("article", "main")
        names[name] = names.get(name, 0) + 1
        if not container and name in CLOSED_BY:
            closable[-1] += 1
        if container:
            closable.append(0)
        stack.append(tree.open(stack[-1], name, step, container, hard and block, soft))
        if hard and not block:
            tree.hard[stack[-1]] = True
    flush()
    close(1)
    return tree


#: share of a page's main text that its chosen container has to hold
HOLDS = 0.8
#: share of the own choice's text that a host's winner has to hold to replace it
FAIR = 1 / 3
#: share of the own choice's text that a host's winner has to hold to replace it
FAIR = 1 / 3
#: containers that are parts of a text, never all of it
PARTS = {"ul", "ol", "dl", "blockquote", "figure", "details"}


def choose(page: Page, out: list[bool], total: list[int]) -> int | None:
    """The deepest container that holds most of the page's main text (link text does not count), or what is whole
    around it; ``total``: the main text that each element holds."""
    if not total[0]:
        return None
    best = 0
    for k in range(1, len(total)):  # an element that holds so much comes after its parents, and no other holds as much
        if page.container[k] and total[k] >= HOLDS * total[0]:
            best = k
    return _whole(page, out, best)


def _whole(page: Page, out: list[bool], chosen: int) -> int:
    """The article around a container: its innermost ``article`` or else ``main``; elsewhere the outermost container
    below ``body`` with text of its own (a title, a lead) around it, and never a mere list or quotation."""
    around = [chosen]
    while around[-1]:
        around.append(page.parent[around[-1]])
    for name in ("article", "main"):
        for k in around:
            if page.name[k] == name:
                return k
    around = [k for k in around if page.container[k]]
    while len(around) > 2 and page.name[around[0]] in PARTS:
        around.pop(0)
    inner = set(around[1:])
    holder = list(range(len(page.parent)))  # the container around each element
    for k in range(1, len(holder)):
        holder[k] = k if page.container[k] else holder[page.parent[k]]
    own = {holder[at] for at, worth in zip(page.at, page.worth) if worth and not out[at]}
    for k in reversed(around):
        if k in inner and k in own and page.name[k] not in ("", "html", "body"):
            return k
    return around[0]


def path_of(page: Page, k: int) -> str:
    steps = []
    while k:
        if page.container[k]:
            steps.append(page.step[k])
        k = page.parent[k]
    return ">".join(reversed(steps))


def text_under(page: Page, out: list[bool], k: int | None) -> str:
    """The main text of an element, a line a block; without a choice that of the page."""
    inside = [False] * len(out)
    for j in range(k or 0, len(out)):
        inside[j] = j == (k or 0) or inside[page.parent[j]]
    return "\n".join(t for t, at in zip(page.texts, page.at) if inside[at] and not out[at])


def main_text(source: str, winners: list[str] | None = None) -> str:
    """Main text of a page, given the winning paths of its host."""
    page = parse(source)
    out = page.boilerplate()
    total = page.summed(out)
    own = choose(page, out, total)
    if winners and own is not None and path_of(page, own) not in winners:
        own = next((k for k in _places(page, out, total, winners) if total[k] >= FAIR * total[own]), own)
    return text_under(page, out, own)


def _places(page: Page, out: list[bool], total: list[int], winners: list[str]) -> list[int]:
    """For each winner that occurs on the page, strongest first, its element with the most main text. Only paths as
    deep as a winner are spelt out."""
    deep = {w.count(">") + 1 for w in winners}
    depth, best = [0] * len(out), {}
    for k in range(1, len(out)):
        depth[k] = depth[page.parent[k]] + page.container[k]
        if page.container[k] and total[k] and depth[k] in deep:
            w = path_of(page, k)
            if w not in best or total[k] > total[best[w]]:
                best[w] = k
    return [best[w] for w in winners if w in best]


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        hosts, paths, weights = [], [], []
        for host, source in zip(pdf["host"], pdf["page"]):
            page = parse(source)
            out = page.boilerplate()
            total = page.summed(out)
            own = choose(page, out, total)
            if own:
                hosts.append(host)
                paths.append(path_of(page, own))
                weights.append(total[own])
        if hosts:
            yield pd.DataFrame({"host": hosts, "path": paths, "weight": weights})


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["text"] = [main_text(source, None if winners is None else list(winners))
                       for source, winners in zip(pdf.pop("page"), pdf.pop("winners"))]
        pdf["n_chars"] = [len(t) for t in pdf["text"]]
        yield pdf


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]*://([^/?#]*)", 1)
    return F.translate(rest, UPPER, UPPER.lower())


def winning_paths(pages: DataFrame, min_share: float = 0.2) -> DataFrame:
    """Stored table of host and its winning paths, strongest first: those with ``min_share`` of its votes."""
    votes = (pages.select("host", "page").mapInPandas(_vote, "host string, path string, weight long")
             .groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("weight").alias("weight")))
    votes = stored(votes, "votes")
    total = votes.groupBy("host").agg(F.sum("votes").alias("all_votes"))
    won = votes.join(total, "host").where(F.col("votes") >= min_share * F.col("all_votes"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), (-F.col("weight")).alias("w"), "path")))
    return stored(won.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("winners")), "winners")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("page"))
    joined = rows.join(winning_paths(rows), "host", "left").select("page_id", "url", "page", "winners")
    kind = rows.schema["page_id"].dataType.simpleString()
    return joined.mapInPandas(_extract, f"page_id {kind}, url string, text string, n_chars long")

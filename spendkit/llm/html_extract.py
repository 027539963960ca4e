"""Main text of web pages by consensus host paths.

Every page scores its containers by the plain text below them and climbs from the best one to the outermost that
belongs to the same text: title, lead and further parts. The path of that one, tag names and classes with numbers
generalised, is the page's vote; Spark counts the votes per host. The second pass extracts again, now from all
containers that the host's winning paths name, so that a page with long comments or a short article follows
the template of its host. A page that has none of these paths keeps its own best container.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .storage import cut_lineage
from .url_filter import host_of

#: A path that holds this share of its host's votes is one of the host's templates.
TEMPLATE_SHARE = 0.1
#: Winning paths are sent to every task up to so many bytes, and joined by shuffle beyond.
BROADCAST_BYTES = 8 << 20
#: A box that its tag, role or a style makes boilerplate is none if it holds so many times the plain text outside all of them.
WRAPPER_TIMES = 4
#: A container without text of its own, outside articles, is one text with its largest part if the others have this share of it.
PART_SHARE = 0.25

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
#: A part of a name that mixes letters and digits, as generated names do; a word with a number behind it is not one.
GENERATED = re.compile(r"(?<![^\W_])(?![A-Za-z]{3,}\d+(?![^\W_]))(?=[^\W_]*\d)(?=[^\W_]*[A-Za-z])[^\W_]{4,}")

#: Elements whose content is no text of the page.
SKIPPED = {
    "script", "style", "noscript", "template", "iframe", "object", "svg", "math", "select", "button", "textarea",
    "title", "canvas", "audio", "video", "map", "datalist",
}
#: Elements that hold blocks; they make up the paths.
CONTAINERS = {
    "html", "body", "main", "article", "section", "div", "td", "th", "tr", "table", "tbody", "thead", "tfoot", "ul", "ol", "li",
    "dl", "dd", "dt", "blockquote", "aside", "nav", "header", "footer", "form", "figure", "figcaption", "fieldset", "details",
    "summary", "center", "address", "menu", "dialog", "hgroup", "caption", "search",
}
#: Elements that only end a block.
BREAKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "hr", "head", "legend", "optgroup", "option"}
BOILERPLATE_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "search"}
BOILERPLATE_ROLES = {"navigation", "complementary", "contentinfo", "search", "banner", "form", "alert", "dialog", "menu", "menubar", "alertdialog"}
BOILERPLATE_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner",
    "sidebar", "rail", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "toolbar",
    "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup",
    "share", "sharing", "social", "related", "recommended", "recommendations", "comment", "comments", "disqus", "reply",
    "replies", "respond", "discussion", "widget", "pagination", "pager", "login", "copyright", "skip",
}
#: Threads below an article; they are often longer than it.
COMMENT_WORDS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
#: Of these only the page's own count; an article has headings in its header.
HEADER_WORDS = {"header"}
#: A class such as `with-sidebar` says something about an element beside it, as does `comments-open`.
BESIDE = {"with", "has", "no", "without", "not"}
STATES = {"open", "closed", "enabled", "disabled", "on", "off", "none", "hidden"}
#: Words that only place the one behind them, as in `left-sidebar` or `site-footer`; others make it a name of something else.
PLACES = {
    "left", "right", "top", "bottom", "upper", "lower", "main", "site", "page", "global", "primary", "secondary", "header", "sticky",
    "fixed", "mobile", "desktop", "inline", "user", "reader", "readers", "facebook", "google", "email",
}
#: Names of the container of an article; a header inside one is its title.
ARTICLE_WORDS = {"article", "post", "entry", "story"}
#: Boilerplate that may stand around a whole page.
WRAPPER_TAGS = {"form", "dialog"}
WRAPPER_ROLES = {"form", "banner", "alert", "dialog", "alertdialog"}
REPEATS = {"li": {"ul", "ol", "menu"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "dd": {"dl"}, "dt": {"dl"}}


@dataclass(slots=True)
class Container:
    parent: int
    tag: str
    #: Tag and generalised classes; the steps from the page down are the path.
    step: str
    #: Whether its tag, its role or a style makes it boilerplate, and whether such a thing may stand around a whole page.
    marked: bool
    wrapper: bool
    article: bool
    #: Whether it is an article or main, or inside one; the page as a whole does not count.
    region: bool = False
    dropped: bool = False
    score: float = 0.0
    #: Characters outside links directly in it, and in all of it.
    own: int = 0
    plain: int = 0


@dataclass
class Page:
    """Containers in page order, and blocks of (container, text, characters in links)."""

    containers: list[Container] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def path(self, at: int) -> str:
        """The steps of a container; only those voted for are ever joined."""
        steps = []
        while at > 0:
            steps.append(self.containers[at].step)
            at = self.containers[at].parent
        return ">".join(reversed(steps))

    def on_paths(self, paths: list[str]) -> list[int]:
        """Per container the number of the path that it has, -1 for none, by walking all paths at once."""
        nodes, ends = {}, {0: -1}
        for number, path in enumerate(paths):
            node = 0
            for step in path.split(">"):
                node = nodes.setdefault((node, step), len(nodes) + 1)
                ends.setdefault(node, -1)
            if ends[node] < 0:
                ends[node] = number
        place, found = [0] * len(self.containers), [-1] * len(self.containers)
        for k, box in enumerate(self.containers[1:], 1):
            above = place[box.parent]
            place[k] = nodes.get((above, box.step), -1) if above >= 0 else -1
            found[k] = ends[place[k]] if place[k] >= 0 else -1
        return found

    def sums(self, values: list[int]) -> list[int]:
        """Every container's value with those of all inside it."""
        out = list(values)
        for k in range(len(out) - 1, 0, -1):  # a parent stands before its children
            out[self.containers[k].parent] += out[k]
        return out


def _attributes(rest: str) -> tuple[list[str], str, bool]:
    """(classes and id as names, role, whether hidden)."""
    names, role, hidden = [], "", False
    for m in ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), next((v for v in m.groups()[1:] if v is not None), "")
        if name == "class":
            names = value.split() + names
        elif name == "id":
            names.append("#" + value)
        elif name == "role":
            role = value.lower()
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        elif "display:none" in value.replace(" ", "").lower():
            hidden = True
    return names, role, hidden


def _boilerplate(name: str, article: bool) -> str:
    """The word of a class or id that names boilerplate: its first one behind words of place and prefixes such as `js`."""
    words = [w.lower() for w in WORD.findall(name)]
    for k, w in enumerate(words):
        if w in BESIDE or k + 1 < len(words) and words[k + 1] in STATES:
            return ""
        if w in BOILERPLATE_WORDS or not article and w in HEADER_WORDS:
            return w
        if w not in PLACES and w not in ARTICLE_WORDS and len(w) > 2:
            return ""
    return ""


def _named(tag: str, role: str, names: list[str], article: bool, nested: bool) -> str:
    """The word by which a container's names alone make it boilerplate, the one of a comment thread first, else empty.

    Article and main go by no name, except an article inside another (`nested`). Within an article the id of a section is
    the anchor of its heading and counts for comment threads only.
    """
    if tag == "main" or role in ("main", "article") or tag == "article" and not nested:
        return ""
    words = {w: c for c in names if (w := _boilerplate(c, article))}
    if article and (tag == "section" or "section" in names):
        words = {w: c for w, c in words.items() if w in COMMENT_WORDS or not c.startswith("#")}
    return min(words, key=lambda w: (w not in COMMENT_WORDS, w), default="")


def _below(page: Page, chosen: list[bool]) -> list[bool]:
    """Whether a container or one around it is chosen."""
    out = list(chosen)
    for k in range(1, len(out)):
        out[k] = out[k] or out[page.containers[k].parent]
    return out


def _settle(page: Page, words: dict[int, str]) -> None:
    """Drops boilerplate, and all in it, by what its boxes hold.

    A box that is boilerplate by tag, role or style stays if it holds most of the page's plain text and several
    times that outside all boilerplate, as the form around a whole page does; one that may be such a wrapper and
    holds an article or main needs only more than there is outside. A box that is boilerplate by name stays if it holds
    most of the plain text that is left. Comment threads may hold most of it; they stay only where there is nothing else.
    """
    boxes, n = page.containers, len(page.containers)
    own = [0] * n
    for at, text, linked in page.blocks:
        own[at] += max(0, len(text) - 2 * linked)
    if any(box.marked for box in boxes):
        whole, outside = page.sums(own), _below(page, [box.marked or k in words for k, box in enumerate(boxes)])
        rest = sum(own[k] for k in range(n) if not outside[k])
        holds = page.sums([int(box.region) for box in boxes])
        for k, box in enumerate(boxes):
            most = 2 * whole[k] > whole[0]
            stays = most and (whole[k] > WRAPPER_TIMES * rest or box.wrapper and holds[k] > 0 and whole[k] > rest)
            box.dropped = box.marked and not stays or k > 0 and boxes[box.parent].dropped
    plain = page.sums([0 if box.dropped else own[k] for k, box in enumerate(boxes)])
    for k, box in enumerate(boxes):
        if k in words:
            most = plain[k] == plain[0] if words[k] in COMMENT_WORDS else 2 * plain[k] > plain[0]
            box.dropped = box.dropped or not most
        box.dropped = box.dropped or k > 0 and boxes[box.parent].dropped


class _Open:
    """The open containers: `top` and those around it. Every step costs in proportion to what it closes."""

    def __init__(self, containers: list[Container]):
        self.containers, self.top, self.counts, self.known = containers, 0, Counter(), {}

    def push(self, box: Container) -> None:
        self.containers.append(box)
        self.top = len(self.containers) - 1
        self.counts[box.tag] += 1

    def close(self, at: int) -> None:
        """Closes the container `at` and all in it."""
        while self.top >= at:
            self.counts[self.containers[self.top].tag] -= 1
            self.top = self.containers[self.top].parent

    def end(self, tag: str) -> None:
        """An end tag; one without an open container closes nothing."""
        if self.counts[tag]:
            at = self.top
            while self.containers[at].tag != tag:
                at = self.containers[at].parent
            self.close(at)

    def item(self, tag: str) -> int:
        """The open item that a new `tag` of the same list ends, 0 for none; the answers for all on the way are kept."""
        at, way = self.top, []
        while at and (at, tag) not in self.known:
            kind = self.containers[at].tag
            if kind in REPEATS[tag] or kind in REPEATS:
                self.known[at, tag] = at if kind in REPEATS and kind not in REPEATS[tag] else 0
                break
            way.append(at)
            at = self.containers[at].parent
        found = self.known.get((at, tag), 0)
        self.known.update(((k, tag), found) for k in way)
        return found


def parse(source: str) -> Page:
    """Blocks and containers of one page; unclosed and stray tags are put up with."""
    page = Page([Container(-1, "", "", False, False, False)])
    containers, words = page.containers, {}
    open_ = _Open(containers)
    pieces: list[str] = []
    linked, link, at, n = 0, False, 0, len(source)
    lowered = ""

    def flush() -> None:
        nonlocal linked, pieces
        if pieces:
            text = "".join(pieces)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                page.blocks.append((open_.top, text, linked))
            pieces = []
        linked = 0

    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            pieces.append(source[at:])
            break
        if m.start() > at:
            piece = source[at : m.start()]
            pieces.append(piece)
            if link:
                linked += len(piece)
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, closing, rest = tag.lower(), m["end"] or m["end2"], m["rest"] or m["rest2"] or ""
        if tag in SKIPPED and not closing and not rest.endswith("/"):
            lowered = lowered or source.lower()
            end = lowered.find(f"</{tag}", at) if len(lowered) == n else source.find(f"</{tag}", at)
            at = n if end < 0 else source.find(">", end) + 1 or n
        elif tag == "a":
            link = not closing
        elif tag == "br":
            pieces.append(" ")
        elif tag in BREAKS:
            flush()
            link = False
        elif tag in CONTAINERS:
            flush()
            link = False
            if closing:
                open_.end(tag)
                continue
            if tag in REPEATS and (item := open_.item(tag)):
                open_.close(item)
            above, page_wide = containers[open_.top], tag in ("html", "body")
            names, role, hidden = _attributes(rest) if rest else ([], "", False)
            classes = sorted({_general(c) for c in names if not c.startswith("#")})
            text = tag in ("article", "main") or any(w.lower() in ARTICLE_WORDS for c in names for w in WORD.findall(c))
            article, region = above.article or text, above.region or text and not page_wide
            wrapper = hidden or tag in WRAPPER_TAGS or role in WRAPPER_ROLES
            marked = not page_wide and (wrapper or tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or tag == "header" and not above.article)
            if names and not page_wide and (word := _named(tag, role, names, above.article, open_.counts["article"] > 0)):
                words[len(containers)] = word
            open_.push(Container(open_.top, tag, ".".join([tag, *classes]), marked, wrapper, article, region))
            if rest.endswith("/") and not page_wide:
                open_.close(open_.top)
    flush()
    _settle(page, words)
    return page


def _general(name: str) -> str:
    """A class with its numbers and generated parts as 0."""
    return re.sub(r"\d+", "0", GENERATED.sub("0", name)).replace(">", "")


def score(page: Page) -> None:
    """Text outside links counts in full for the container that holds it, half for the one above, and so on.

    Where all text is linked, that of articles and main counts as if it was not.
    """
    kept = [(at, text, max(0, len(text) - 2 * linked)) for at, text, linked in page.blocks if not page.containers[at].dropped]
    if not any(gain for _, _, gain in kept):
        kept = [(at, text, len(text) if page.containers[at].region else 0) for at, text, _ in kept]
    for at, text, gain in kept:
        if any(c.isalnum() for c in text):
            page.containers[at].own += gain
        while at >= 0 and gain >= 1:
            box = page.containers[at]
            box.score += gain * (1.25 if box.tag in ("article", "main") else 1.0)
            at, gain = box.parent, gain / 2
    for box, plain in zip(page.containers, page.sums([box.own for box in page.containers])):
        box.plain = plain


def climbed(page: Page, on: list[int] | None = None) -> list[int]:
    """For every container the outermost one that adds to its text.

    One adds to it if there is more plain text in it and it belongs to an article, holds some of the text directly
    (a title, a lead) or has parts of a similar size; of the latter only those on winning paths (`on`), if given. The page
    as a whole adds only what it holds directly.
    """
    out = [0]
    for k, box in enumerate(page.containers[1:], 1):
        up, above = page.containers[box.parent], out[box.parent]
        if above == box.parent:  # nothing further out adds
            added = up.plain - box.plain
            parts = up.tag not in ("", "html", "body") and added >= PART_SHARE * box.plain and (on is None or on[box.parent] >= 0)
            above = box.parent if added and (up.own or up.region or parts) else k
        out.append(above)
    return out


def best(page: Page) -> int:
    """Climbed from the container with the highest score, the outermost of equals; -1 if the page has no text."""
    top = max(range(len(page.containers)), key=lambda k: page.containers[k].score)
    return climbed(page)[top] if page.containers[top].score > 0 else -1


def chosen(page: Page, paths: list[str]) -> list[int]:
    """All containers of the first winning path that the page has with text, climbed, else those of its own best."""
    top = best(page)
    if top < 0:
        return [top]
    on = page.on_paths(paths)
    first = min((p for k, p in enumerate(on) if p >= 0 and page.containers[k].plain > 0), default=-1)
    same = on
    if first < 0:
        same, first = page.on_paths([page.path(top)]), 0
    own = [k for k, p in enumerate(same) if p == first and page.containers[k].plain > 0]
    outermost = climbed(page, on)
    return sorted({outermost[k] for k in own}) or [top]


def text_below(page: Page, *tops: int) -> str:
    """The kept blocks inside one or several containers, in page order, one per line."""
    wanted = set(tops)
    inside = _below(page, [k in wanted for k in range(len(page.containers))])
    return "\n".join(text for at, text, _ in page.blocks if inside[at] and not page.containers[at].dropped)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, paths = [], []
        for host, source in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
            page = parse(source)
            score(page)
            top = best(page)
            if top >= 0:
                hosts.append(host)
                paths.append(page.path(top))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for source, paths in zip(batch["html"].to_pylist(), batch["paths"].to_pylist()):
            page = parse(source)
            score(page)
            texts.append(text_below(page, *chosen(page, paths or [])))
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, paths) from host and html: the paths with at least TEMPLATE_SHARE of the host's votes, most first.

    Votes are counted in the tasks before they are shuffled, so a hot host is one row per task and path.
    """
    votes = pages.where("host <> ''").select("host", "html").mapInArrow(_vote, "host string, path string")
    counted = cut_lineage(votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes")))
    totals = counted.groupBy("host").agg(F.sum("votes").alias("pages"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.col("votes").desc(), "path"))
    ahead = counted.join(totals, "host").where(F.col("votes") >= TEMPLATE_SHARE * F.col("pages")).withColumn("rank", rank)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "path")))
    return ahead.groupBy("host").agg(ordered["path"].alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of `pages`: page_id, url, text (blocks joined by line ends, empty if there are none).

    Menus, headers, footers, forms, notices, hidden boxes and the like go, unless such a box holds nearly all plain text of
    its page; a page whose text is all linked gives that of its articles or main. Depth and number of elements are
    not bounded: cost follows the length of the page. Null html is empty. Pages without a host have no consensus and use their own best container. Repeated pages are
    extracted each. Other columns are not read. An empty table gives no rows.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
        host_of(F.col("url")).alias("host"),
    )
    paths = cut_lineage(winning_paths(rows))
    size = paths.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("paths", "")) + 64)).first()[0]
    if (size or 0) <= BROADCAST_BYTES:
        paths = F.broadcast(paths)
    told = rows.join(paths, "host", "left").select("page_id", "url", "html", "paths")
    return told.mapInArrow(_extract, "page_id long, url string, text string")

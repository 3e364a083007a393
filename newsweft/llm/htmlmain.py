"""Main-text extraction with a tree-structured graphical model over the document tree.

Each block element is a node with two states, inside the main text or not.  Its tag, every word of its class, id and
role, and the length and links of its own text are evidence; a potential between parent and child says how likely a
child is to share its parent's state.  Sum-product messages upward and downward give each node's exact marginal.  All
potentials are counted on labelled pages.
"""

from __future__ import annotations

import html as _html
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is no text of the page, and those that open a block.
_DROP = frozenset("script style noscript template iframe object embed svg math canvas audio video select textarea button title datalist head".split())
_RAW = frozenset("script style noscript template iframe svg math canvas object select textarea button title datalist audio video".split())
#: Of those, the ones whose content is text to their end tag, or to the page's end without one.
_TO_END = frozenset("script style title textarea".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
_GROUPS = {
    "nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset dialog", "article": "article", "main": "main",
    "section": "section", "div": "div center details summary", "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup", "item": "li dt dd", "list": "ul ol dl dir",
    "cell": "td th caption", "table": "table tbody thead tfoot tr", "quote": "blockquote pre figure figcaption address", "body": "body html",
}
_GROUP = {tag: i for i, tags in enumerate(_GROUPS.values()) for tag in tags.split()}
_BODY = list(_GROUPS).index("body")
_CLOSES_P = frozenset(_GROUP) - {"body", "html"}
_CLOSED_BY = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th"))}
_HOLDS = {"li": frozenset(("ul", "ol")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",)), "tr": frozenset(("table", "tbody", "thead", "tfoot")), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table"))}
#: Words in class, id or role by what they say; of one word the first kind that matches counts.
_KINDS = (
    ("comment", r"comments?|commentlist|replies|reply|disqus|discussion|respond|guestbook|feedback"),
    ("advert", r"ads?|adv|advert\w*|adsense|adslot|adbox|adunit|sponsor\w*|promo\w*|banner-ad|dfp|outbrain|taboola|commercial"),
    ("notice", r"cookies?|consent|gdpr|notice|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|paywall|alert|toast|disclaimer"),
    ("menu", r"nav\w*|menu\w*|breadcrumbs?|pagination|pager|toc|tabs|skip|topbar|toolbar"),
    ("foot", r"foot\w*|copyright|colophon|legal"),
    ("head", r"masthead|site-?header|page-?header|header|banner|branding|logo|topheader"),
    ("side", r"side\w*|aside|widgets?|related|recommend\w*|popular|trending|complementary|rail|more-?stories|also|tagcloud|tags"),
    ("share", r"share|sharing|social|follow|likes?"),
    ("form", r"form|search|searchbox|login|contentinfo|signin|poll"),
    ("content", r"article\w*|post|posts|entry|story|content|body|main|text|blog\w*|hentry|page-?content|lead|paragraph|richtext|prose"),
)
#: First parts of words whose other parts name a subject, a state or a look, and not what the element is.
_NEUTRAL = frozenset("category cat tag type status format no not non without has have with is as author id term topic subject lang layout theme template js wp skin color bg size align col row grid offset".split())
#: Kinds that may as well be the subject of an article or main element that bears them: all but these.
_TELLING = frozenset(k for k, (name, _) in enumerate(_KINDS) if name in ("comment", "advert", "form", "content"))
_PATTERNS = [re.compile(rf"(?<![a-z])(?:{p})(?![a-z])") for _, p in _KINDS]
_NO_KIND = len(_KINDS)
_CONTENT = _NO_KIND - 1
#: Several kinds at once are one value: from here on, by the set of them.
_SEVERAL = _NO_KIND + 1
#: The same on an article or main element, where a word that is not telling weighs otherwise.
_ON_REGION = _SEVERAL + (1 << len(_KINDS))
_TOKEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^\"'<>]++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*+)>|[!?/][^<>]*+>)")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Where a training page says whether an element is main text. Pages to extract from are never asked.
_LABEL = re.compile(r'(?:^|\s)data-y="([01])"')
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}


@dataclass
class Page:
    """Nodes in page order, a parent before its children, and runs of text in page order."""

    parent: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    label: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


@lru_cache(1 << 16)
def _word_kind(word: str) -> int:
    head, _, rest = word.partition("-")
    if rest and head in _NEUTRAL:
        return _NO_KIND
    return next((k for k, p in enumerate(_PATTERNS) if p.search(word)), _NO_KIND)


@lru_cache(1 << 16)
def _kind_of(words: str, on_region: bool = False) -> int:
    """What an element's names say: no kind, one, or several, each of which is evidence by itself."""
    kinds = {_word_kind(w) for w in words.split()} - {_NO_KIND}
    kind = _NO_KIND if not kinds else next(iter(kinds)) if len(kinds) == 1 else _SEVERAL + sum(1 << k for k in kinds)
    return kind + _ON_REGION if on_region and kinds - _TELLING else kind


def _kinds_in(kind: int) -> list[int]:
    """The single values whose evidence a value of ``_kind_of`` stands for."""
    on_region, kind = divmod(kind, _ON_REGION)
    kinds = [kind] if kind < _SEVERAL else [k for k in range(_NO_KIND) if kind - _SEVERAL >> k & 1]
    return [k + _ON_REGION if on_region and k not in _TELLING else k for k in kinds]


def _closed(source: str) -> dict[int, int]:
    """Where the dropped elements begin that have their own end tag within their container, and where that ends."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    open_: dict[str, int] = {}
    at = 0
    while m := _TOKEN.search(source, at):
        at = m.end()
        if m[1]:
            stop = source.find("-->", m.start() + 4)
            at = stop + 3 if stop >= 0 else len(source)
            continue
        tag = (m[3] or m[6] or "").lower()
        closing, attributes = (m[2] or m[5]) == "/", m[4] or m[7] or ""
        if tag in _TO_END and not closing:
            stop = _END_RAW[tag].search(source, at)
            at = stop.end() if stop else len(source)
        elif closing and open_.get(tag):
            while True:
                name, begin = stack.pop()
                open_[name] -= 1
                if name == tag:
                    break
            ends[begin] = at
        elif not closing and (tag in _GROUP or tag in _RAW and not attributes.endswith("/")):
            stack.append((tag, m.start()))
            open_[tag] = open_.get(tag, 0) + 1
    return ends


def parse(source: str, labelled: bool = False) -> Page:
    """The block tree of a page. Unclosed and misnested elements are closed as a browser would in the common cases.

    Only a ``labelled`` page, one to train on, has its elements' labels read.
    """
    page, tags, stack = Page(), ["html"], [0]
    text: list[str] = []
    links = linked = 0
    closed: dict[int, int] | None = None
    #: The dropped element without an end tag that text is in; it ends with the next block or its container.
    muted = ""

    def node(tag: str, attributes: str) -> None:
        words, label = "", -1
        if attributes:
            for m in _NAMED.finditer(attributes):
                words += f" {m[2] or m[3] or m[4] or ''}"
            if labelled and (said := _LABEL.search(attributes)):
                label = int(said[1])
        page.parent.append(stack[-1] if page.parent else -1)
        page.group.append(_GROUP[tag])
        page.kind.append(_kind_of(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", words).lower().replace("_", "-"), tag in ("article", "main")) if words else _NO_KIND)
        page.label.append(label)
        page.chars.append(0)
        page.linked.append(0)

    def flush() -> None:
        nonlocal text, linked
        if text:
            run = " ".join(_html.unescape("".join(text)).split())
            if run:
                at = stack[-1]
                page.runs.append((at, run))
                page.chars[at] += len(run)
                page.linked[at] += min(linked, len(run))
            text, linked = [], 0

    def close(depth: int) -> None:
        flush()
        del stack[depth:], tags[depth:]

    node("html", "")
    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if m is None:
            if not muted:
                text.append(source[at:])
            break
        if m.start() > at and not muted:
            piece = source[at : m.start()]
            text.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        if m[1]:
            stop = source.find("-->", m.start() + 4)
            at = stop + 3 if stop >= 0 else n
            continue
        tag = (m[3] or m[6] or "").lower()
        closing, attributes = (m[2] or m[5]) == "/", m[4] or m[7] or ""
        if muted and (tag in _GROUP or tag == muted):
            muted = ""
        if tag in _RAW and not closing:
            if tag in _TO_END:
                stop = _END_RAW[tag].search(source, at)
                at = stop.end() if stop else n
            elif not attributes.endswith("/"):
                if closed is None:
                    closed = _closed(source)
                if m.start() in closed:
                    at = closed[m.start()]
                else:
                    muted = tag
            text.append(" ")
        elif tag == "head" and not closing:
            stop = re.compile(r"</head\s*>|<body[\s>]", re.I).search(source, at)
            if stop:
                at = stop.end() if stop[0][1] == "/" else stop.start()
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in ("br", "hr", "img", "input", "wbr"):
            if tag == "hr":
                flush()
            elif tag != "wbr":
                text.append(" ")
        elif tag in ("html", "body"):
            flush()
            if labelled and not closing and (said := _LABEL.search(attributes)):
                page.label[0] = int(said[1])
        elif tag in _GROUP:
            if closing:
                if tag in tags:
                    close(len(tags) - 1 - tags[::-1].index(tag))
                else:
                    flush()
                continue
            flush()
            if tags[-1] == "p" and tag in _CLOSES_P:
                close(len(tags) - 1)
            if tag in _CLOSED_BY:
                for k in range(len(tags) - 1, 0, -1):
                    if tags[k] in _CLOSED_BY[tag]:
                        close(k)
                        break
                    if tags[k] in _HOLDS[tag]:
                        break
            node(tag, attributes)
            stack.append(len(page.parent) - 1)
            tags.append(tag)
            links = 0
    close(1)
    flush()
    return page


_SIZES, _LINKS = 5, 3
_CELLS = (len(_GROUPS), 2 * _ON_REGION, _SIZES * _LINKS)
_EDGES = 5
_REGION, _ASIDE = frozenset((_GROUP["article"], _GROUP["main"])), frozenset(_GROUP[t] for t in ("nav", "footer", "aside", "form", "header"))


def _size_bin(chars: int, linked: int) -> int:
    size = 0 if chars == 0 else 1 if chars < 25 else 2 if chars < 80 else 3 if chars < 250 else 4
    share = 0 if not chars or linked * 10 < chars else 1 if linked * 2 < chars else 2
    return size * _LINKS + share


def _edge(kind: int, group: int) -> int:
    """Which potential ties a node to its parent: by what its names say, else by what its tag says."""
    kinds = _kinds_in(kind)
    if kinds != [_NO_KIND] and _CONTENT not in kinds and not all(k >= _ON_REGION for k in kinds):
        return 0
    return 3 if group in _REGION else 4 if group in _ASIDE else 2 if _CONTENT in kinds else 1


@dataclass
class Model:
    """``emit[f][v]``: how likely value v of feature f is in each state; ``edge[e][parent][child]``; ``root``."""

    root: tuple[float, float]
    edge: list[list[list[float]]]
    emit: list[list[tuple[float, float]]]

    def marginals(self, page: Page) -> list[float]:
        """The chance of each node to be inside the main text: messages from the leaves up, then from the root down."""
        n, tag, kind, size = len(page.parent), *self.emit
        b0, b1 = [0.0] * n, [0.0] * n
        for i in range(n):
            t, k, s = tag[page.group[i]], kind[page.kind[i]], size[_size_bin(page.chars[i], page.linked[i])]
            b0[i], b1[i] = t[0] * k[0] * s[0], t[1] * k[1] * s[1]
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            e, p = self.edge[_edge(page.kind[i], page.group[i])], page.parent[i]
            total = b0[i] + b1[i]
            x, y = b0[i] / total, b1[i] / total
            m0, m1 = e[0][0] * x + e[0][1] * y, e[1][0] * x + e[1][1] * y
            up[i] = (m0, m1)
            q0, q1 = b0[p] * m0, b1[p] * m1
            b0[p], b1[p] = q0 / (q0 + q1), q1 / (q0 + q1)
        full0, full1, out = [0.0] * n, [0.0] * n, [0.0] * n
        full0[0], full1[0] = self.root[0] * b0[0], self.root[1] * b1[0]
        for i in range(n):
            if i:
                e, p, (m0, m1) = self.edge[_edge(page.kind[i], page.group[i])], page.parent[i], up[i]
                c0, c1 = full0[p] / m0, full1[p] / m1
                full0[i], full1[i] = (c0 * e[0][0] + c1 * e[1][0]) * b0[i], (c0 * e[0][1] + c1 * e[1][1]) * b1[i]
            total = full0[i] + full1[i]
            full0[i], full1[i] = full0[i] / total, full1[i] / total
            out[i] = full1[i]
        return out


    def without_text(self, page: Page) -> float:
        """The chance that no node with text of its own is inside: one upward pass with those nodes held outside, against one without."""
        logs = []
        for held in (True, False):
            n, tag, kind, size = len(page.parent), *self.emit
            b0, b1, log = [0.0] * n, [0.0] * n, 0.0
            for i in range(n):
                t, k, s = tag[page.group[i]], kind[page.kind[i]], size[_size_bin(page.chars[i], page.linked[i])]
                b0[i], b1[i] = t[0] * k[0] * s[0], 0.0 if held and page.chars[i] else t[1] * k[1] * s[1]
            for i in range(n - 1, -1, -1):
                total = b0[i] + b1[i]
                log += math.log(total)
                x, y = b0[i] / total, b1[i] / total
                if i:
                    e, p = self.edge[_edge(page.kind[i], page.group[i])], page.parent[i]
                    b0[p], b1[p] = b0[p] * (e[0][0] * x + e[0][1] * y), b1[p] * (e[1][0] * x + e[1][1] * y)
                else:
                    log += math.log(self.root[0] * x + self.root[1] * y)
            logs.append(log)
        return math.exp(logs[0] - logs[1])


def train(pages: Iterable[str]) -> Model:
    """Potentials counted on pages whose block elements carry their state in ``data-y``; others share their parent's."""
    root, edge = np.full(2, 1.0), np.full((_EDGES, 2, 2), 0.5)
    emit = [np.full((c, 2), 0.3) for c in _CELLS]
    for source in pages:
        page = parse(source, labelled=True)
        for i, p in enumerate(page.parent):
            y = page.label[i] if page.label[i] >= 0 else page.label[p] if p >= 0 else 0
            page.label[i] = y
            for f, v in ((0, page.group[i]), *((1, k) for k in _kinds_in(page.kind[i])), (2, _size_bin(page.chars[i], page.linked[i]))):
                emit[f][v, y] += 1
            if p < 0:
                root[y] += 1
            else:
                edge[_edge(page.kind[i], page.group[i]), page.label[p], y] += 1
    root /= root.sum()
    edge /= edge.sum(2, keepdims=True)
    # Only single values have been counted, plain and on an article or main element; sets of them are products.
    single = [*range(_SEVERAL), *(k + _ON_REGION for k in range(_SEVERAL))]
    emit[1] /= emit[1][single].sum(0)
    for kind in {*range(_SEVERAL, 2 * _ON_REGION)} - {*single}:
        if kind < len(emit[1]):
            emit[1][kind] = np.prod(emit[1][_kinds_in(kind)], axis=0)
    return Model(tuple(root), edge.tolist(), [[tuple(v) for v in (e / (1 if f == 1 else e.sum(0))).tolist()] for f, e in enumerate(emit)])


def labelled_pages(n: int = 600, seed: int = 11) -> Iterator[str]:
    """Labelled training pages in many layouts: every block element says in ``data-y`` whether it is main text."""
    r = random.Random(seed)
    say = lambda a, b: " ".join("".join(r.choice("aeioustrnlm") for _ in range(r.randint(2, 8))) for _ in range(r.randint(a, b)))
    pick = lambda *options: r.choice(options)
    el = lambda tag, y, inner, words="": f'<{tag} data-y="{y}"{f" class={chr(34)}{words}{chr(34)}" if words else ""}>{inner}</{tag}>'
    link_list = lambda k: el("ul", 0, "".join(el("li", 0, f"<a href=#>{say(1, 3)}</a>") for _ in range(k)))

    def junk(where: str) -> str:
        """A piece that is no main text: at the page's edge, beside the text, or in it."""
        kinds = {
            "top": [
                lambda: el("nav", 0, link_list(r.randint(2, 8)), pick("", "", "navbar", "main-nav")),
                lambda: el("header", 0, el("h1", 0, say(1, 3)) + pick("", el("p", 0, say(2, 6)), link_list(4)), pick("", "site-header")),
                lambda: el("div", 0, pick(link_list(5), el("div", 0, say(1, 4)), say(1, 5)), pick("header", "menu", "topbar", "masthead", "breadcrumbs", "navigation")),
                lambda: el("div", 0, pick(say(5, 25), el("p", 0, say(5, 25))), pick("cookie-banner", "notice", "consent", "alert", "popup")),
                lambda: el("form", 0, pick(say(0, 3), el("div", 0, say(1, 3)))),
                lambda: el("div", 0, say(3, 14), pick("ad", "ads", "advert", "sponsored")),
            ],
            "side": [
                lambda: el("aside", 0, pick(link_list(5), el("h3", 0, say(1, 3)) + el("p", 0, say(4, 30)), el("p", 0, say(4, 30))), pick("", "sidebar")),
                lambda: el("div", 0, el("h3", 0, say(1, 3)) + pick(link_list(5), el("p", 0, say(4, 20))), pick("sidebar", "widget", "related", "popular")),
                lambda: el("div", 0, say(3, 20), pick("ad", "ad-slot", "advertisement", "promo")),
                lambda: el(pick("section", "div"), 0, el("h3", 0, say(1, 3)) + "".join(el("article", 0, pick(f"<a href=#>{say(2, 8)}</a>", el("h3", 0, f"<a href=#>{say(2, 8)}</a>")), pick("", "teaser", "related", "popular", "trending")) for _ in range(r.randint(2, 4))), pick("related", "more-stories", "recommended")),
            ],
            "end": [
                lambda: el("footer", 0, pick(say(2, 16), el("p", 0, say(2, 16)), link_list(4)), pick("", "site-footer")),
                lambda: el("div", 0, pick(say(2, 12), link_list(3), el("p", 0, say(3, 12))), pick("footer", "copyright", "legal")),
            ],
            "in": [
                lambda: el("div", 0, pick(say(2, 14), el("p", 0, say(2, 14))), pick("ad", "advert", "sponsor", "promo")),
                lambda: el("div", 0, pick(link_list(3), say(1, 4)), pick("share", "social", "tags")),
                lambda: el("aside", 0, pick(el("p", 0, say(5, 25)), link_list(3), say(4, 20))),
                lambda: el("form", 0, el("p", 0, say(3, 12)), pick("", "newsletter")),
                lambda: el("div", 0, el("h3", 0, say(1, 3)) + link_list(4), pick("related", "recommended", "more-stories")),
            ],
        }[where]
        return r.choice(kinds)()

    def comments() -> str:
        one = lambda: pick(el("p", 0, say(5, 60)), el("div", 0, el("p", 0, say(5, 60)), pick("comment", "")), el("li", 0, say(5, 60)), el("p", 0, say(2, 20)), el("article", 0, el("p", 0, say(5, 50)), "comment"))
        inner = pick("", el(pick("h2", "h3"), 0, say(1, 3))) + "".join(one() for _ in range(r.randint(1, 6))) + pick("", el("form", 0, say(0, 3)))
        return el(pick("section", "div", "div", "aside"), 0, inner, pick("comments", "comment-list", "reader-comments", "discussion"))

    def text() -> str:
        out, most = [], pick(120, 120, 15)
        for _ in range(r.randint(1, 14)):
            out.append(
                r.choices(
                    [
                        lambda: el("p", 1, say(min(12, most // 3), most)),
                        lambda: el("p", 1, say(1, 10)),
                        lambda: el("p", 1, say(10, 40) + f" <a href=#>{say(1, 3)}</a> " + say(5, 30)),
                        lambda: el(pick("h2", "h3"), 1, say(1, 8)),
                        lambda: el(pick("ul", "ol"), 1, "".join(el("li", 1, say(2, 25)) for _ in range(r.randint(2, 5)))),
                        lambda: el("blockquote", 1, pick(say(8, 50), el("p", 1, say(8, 50)))),
                        lambda: el("pre", 1, say(3, 30)),
                        lambda: el("table", 1, el("tr", 1, el("td", 1, say(1, 5)) + el("td", 1, say(1, 12)))),
                        lambda: el("figure", 1, el("figcaption", 1, say(3, 15))),
                        lambda: el("div", 1, pick(say(10, 80), el("p", 1, say(10, 80)))),
                        lambda: junk("in"),
                    ],
                    (40, 12, 10, 8, 6, 5, 2, 3, 2, 5, 7),
                )[0]()
            )
        return "".join(out)

    def names(own: str) -> str:
        """The class list of an element that holds main text: its own words, what a site adds, and now and then the words of its subject."""
        subject = pick("legal", "newsletter", "social", "popular", "banner", "related", "trending", "notice", "menu", "tabs", "branding", "header", "footer", "sidebar", "nav")
        added = [f"{own}-{r.randint(1, 9999)}" if own else "", f"type-{own}" if own else "", pick("category-", "tag-", "no-", "has-", "with-") + subject, pick("category-", "format-", "status-") + say(1, 1)]
        return " ".join(x for x in [own, *(x for x in added if r.random() < 0.2)] if x)

    def subject() -> str:
        return pick("legal", "newsletter", "social", "popular", "banner", "trending", "notice", "related", "menu", "header", "tags") if r.random() < 0.1 else ""

    for _ in range(n):
        title = pick(lambda: el("h1", 1, say(2, 12)), lambda: el("header", 1, el("h1", 1, say(2, 12)) + pick("", el("p", 1, say(2, 8)))), lambda: "", lambda: el("h2", 1, say(2, 12)))()
        layout = r.random()
        inner = title + (el("p", 1, say(1, 9)) if r.random() < 0.2 else text())
        talk = comments() if r.random() < 0.35 else ""
        if layout < 0.45:
            middle = el("article", 1, inner + (talk if r.random() < 0.3 else ""), f'{names(pick("", "", "post", "hentry"))} {subject()}'.strip()) + (talk if r.random() < 0.7 else "")
            middle = pick(middle, middle, el("main", 1, middle, subject()), el("div", 0, middle, pick("container", "wrapper", "content")), el("section", 0, middle))
        elif layout < 0.55:
            middle = el("main", 1, inner, f'{names(pick("", "content"))} {subject()}'.strip()) + talk
        elif layout < 0.72:
            body = el("div", 1, inner, names(pick("post-content", "entry", "story", "article-body", "content", "main-text", "post")))
            middle = el("div", 0, body + talk + pick("", junk("side")), pick("", "wrapper", "container", "page"))
        else:
            middle = None
        top, side, end = ("".join(junk(w) for _ in range(r.randint(0, k))) for w, k in (("top", 4), ("side", 2), ("end", 2)))
        if middle is None:
            # Nothing but the text's own shape tells: in the body itself, in plain boxes, or in one box with the rest.
            plain, alone = el("div", 1, inner), el("div", 1, pick(say(5, 30), el("p", 1, say(5, 30)), inner))
            for _ in range(r.randint(0, 3)):
                plain, alone = el("div", 1, plain), el("div", 1, alone)
            yield pick(
                el("div", 1, top + inner + side + end), f"<body>{top}{plain}{talk}{side}{end}</body>", f'<body data-y="1">{top}{inner}{talk}{end}</body>', f'<body data-y="1">{inner}{end}</body>', *[f'<body data-y="1">{alone}</body>'] * 3
            )
        else:
            yield f"<body>{top}{side if r.random() < 0.3 else ''}{middle}{side}{end}</body>"


@cache
def default_model() -> Model:
    return train(labelled_pages())


#: A page has some main text unless the model gives that less than this chance.
LEAST_CHANCE = 0.02


def extract(source: str | None, model: Model | None = None) -> str:
    """The main text of a page: its blocks in page order, one to a line, white space inside a block one space.

    Blocks with a marginal above one half. Where no block has one, the page is short or says nothing of itself: given
    that it has some main text, those whose marginal is then above it, in an element that may well hold main text; that
    and the whole page's chance must be likely enough (``LEAST_CHANCE``).
    """
    if not source:
        return ""
    page, used = parse(source), model or default_model()
    inside = used.marginals(page)
    chosen = [run for at, run in page.runs if inside[at] > 0.5]
    if page.runs and not chosen and (some := 1 - used.without_text(page)) > LEAST_CHANCE:
        chosen = [run for at, run in page.runs if inside[at] > some / 2 and inside[max(page.parent[at], 0)] > LEAST_CHANCE]
    return "\n".join(chosen)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    Null and empty pages, and those without an article, have an empty text; very long pages are read whole, in time
    that grows with their length; repeated rows come as often as they are given, null ids and addresses are kept, an
    empty table gives an empty result, other columns aren't read. A marginal of exactly one half is no main text.
    """
    used = model or default_model()
    kinds = dict(pages.dtypes)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(cell.as_py(), used) for cell in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(page_id, url, source).mapInArrow(step, f"page_id {kinds[page_id]}, url {kinds[url]}, text string, n_chars bigint")

"""HTML to clean HTML, Markdown and plain text, and what an article page says about itself.

One tolerant parse makes a stream of events (open, text, close) without dropped subtrees; small renderers read it.
The functions run in Arrow UDFs, a batch of pages at a time.
"""

from __future__ import annotations

import html as _html
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements dropped with their content, kept, and without content; bounds on nesting.
DROPPED = frozenset("script style noscript iframe svg canvas object embed form input button select textarea nav header footer aside".split())
KEPT = frozenset("article main section div p br hr h1 h2 h3 h4 h5 h6 blockquote pre code ul ol li strong b em i a img table thead tbody tr th td time span".split())
FRAMES = frozenset("html head body".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option optgroup caption colgroup thead tbody tfoot rt rp".split())
ATTRIBUTES = {("a", "href"): "url", ("img", "src"): "url", ("img", "alt"): "text", ("img", "title"): "text", ("time", "datetime"): "text"}
DEEPEST, DEEPEST_SOURCE, LONG_LINE, MOST_BYTES = 512, 2048, 80, 8 << 20

_BLOCKS = frozenset("article main section div p hr h1 h2 h3 h4 h5 h6 blockquote pre ul ol table form nav header footer aside address dl".split())


class _Events(HTMLParser):
    """A flat list of ("open", tag, attributes), ("text", data) and ("close", tag), well nested."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple] = []
        self.stack: list[str] = []
        self.deepest = 0

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.out.append(("close", self.stack.pop()))

    def handle_starttag(self, tag, attrs):
        top = self.stack[-1] if self.stack else ""
        if (tag in CLOSES_ITSELF and top == tag) or (top == "p" and tag in _BLOCKS):
            self._close(len(self.stack) - 1)
        self.out.append(("open", tag, attrs))
        if tag in EMPTY:
            self.out.append(("close", tag))
        else:
            self.stack.append(tag)
            self.deepest = max(self.deepest, len(self.stack))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.stack:
            self._close(len(self.stack) - 1 - self.stack[::-1].index(tag))

    def handle_data(self, data):
        self.out.append(("text", data))


_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|<!--.*?-->", re.S)


_END_OF = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in ("script", "style")}


def too_deep(source: str) -> bool:
    """More open elements than a parser should be asked to hold; a cheap scan that never builds a tree, past scripts and styles."""
    depth, last, at = 0, "", 0
    while m := _TAG.search(source, at):
        at, tag = m.end(), (m[2] or "").lower()
        if not tag or tag in EMPTY or m[0].endswith("/>"):
            continue
        if tag in _END_OF:
            if not m[1]:
                end = _END_OF[tag].search(source, at)
                if end is None:
                    return False
                at = end.end()
            continue
        if m[1]:
            depth, last = max(0, depth - 1), ""
        elif not (tag in CLOSES_ITSELF and tag == last):
            depth, last = depth + 1, tag
        if depth > DEEPEST_SOURCE:
            return True
    return False


def events(source: str) -> list[tuple]:
    parser = _Events()
    parser.feed(source)
    parser.close()
    parser._close(0)
    return parser.out


def visible(stream: list[tuple]) -> Iterator[tuple]:
    """The events outside dropped subtrees and above the depth bound, each with its depth; ("gone", tag) for what went."""
    depth, skip = 0, 0
    for e in stream:
        if e[0] == "open":
            depth += 1
            if skip:
                continue
            if e[1] in DROPPED or depth > DEEPEST:
                skip = depth
                yield "gone", e[1], depth
            else:
                yield *e, depth
        elif e[0] == "close":
            if skip and depth <= skip:
                skip = 0 if depth == skip else skip
                if not skip:
                    depth -= 1
                    continue
            if not skip:
                yield *e, depth
            depth -= 1
        elif not skip:
            yield *e, depth


def safe_url(value: str, base: str | None) -> str | None:
    value = value.strip()
    if not value or value[0] == "#":
        return None
    try:
        full = value if urlsplit(value).scheme else urljoin(base, value) if base else None
        parts = urlsplit(full) if full else None
    except ValueError:
        return None
    return full if parts and parts.scheme in ("http", "https") and parts.netloc else None


def sanitise(source: str, base: str | None = None, images: bool = False) -> tuple[str, dict[str, int]]:
    out: list[str] = []
    n = {"stripped_elements": 0, "stripped_attributes": 0, "link_count": 0, "image_count": 0}
    for e in visible(events(source)):
        tag = e[1]
        if e[0] == "gone":
            n["stripped_elements"] += 1
        elif e[0] == "text":
            out.append(_html.escape(tag, quote=False))
        elif tag not in KEPT or (tag == "img" and not images):
            n["stripped_elements"] += e[0] == "open" and tag not in FRAMES
        elif e[0] == "close":
            if tag not in EMPTY:
                out.append(f"</{tag}>")
        else:
            shown = []
            for name, value in e[2]:
                kind = ATTRIBUTES.get((tag, name))
                value = safe_url(value or "", base) if kind == "url" else value or "" if kind else None
                if value is None:
                    n["stripped_attributes"] += 1
                    continue
                n["link_count"] += name == "href"
                n["image_count"] += name == "src"
                quoted = value.replace("&", "&amp;").replace('"', "&quot;")
                shown.append(f' {name}="{quoted}"')
            out.append(f"<{tag}{''.join(shown)}>")
    return "".join(out), n


def plain_text(source: str) -> str:
    return " ".join(" ".join(e[1] for e in visible(events(source)) if e[0] == "text").split())


_ESCAPE = str.maketrans({c: f"\\{c}" for c in "\\[]`"})


class _Markdown:
    """Nested buffers, one for each element whose text is treated as a whole."""

    def __init__(self) -> None:
        self.buffers: list[list[str]] = [[]]
        self.lists: list[int | None] = []

    @property
    def tail(self) -> str:
        return next((s for s in reversed(self.buffers[-1]) if s), "")

    def put(self, text: str) -> None:
        self.buffers[-1].append(text)

    def words(self, text: str, escaped: bool = False) -> None:
        text = " ".join(text.split())
        if text:
            if self.tail and not self.tail[-1].isspace():
                self.put(" ")
            self.put(text if escaped else text.translate(_ESCAPE))

    def gap(self) -> None:
        """A blank line, unless nothing but blanks is written; only the last pieces are looked at."""
        ends, counting = 0, True
        for piece in reversed(self.buffers[-1]):
            if counting:
                ends += len(piece) - len(piece.rstrip("\n"))
                counting = not piece.rstrip("\n")
            if piece.strip():
                self.put("\n" * max(0, 2 - ends))
                return
        self.buffers[-1] = []

    def push(self) -> None:
        self.buffers.append([])

    def pop(self) -> str:
        return "".join(self.buffers.pop())


def _tidy(text: str) -> str:
    """No more than one blank line, and a long line only once."""
    seen, out, blank = set(), [], False
    for line in (x.strip() for x in text.splitlines()):
        if not line:
            if out and not blank:
                out.append("")
            blank = True
            continue
        if line in seen and len(line.encode()) > LONG_LINE:
            continue
        seen.add(line)
        out.append(line)
        blank = False
    return "\n".join(out).strip()


def markdown(clean: str, images: bool = False) -> str:
    m = _Markdown()
    hrefs: list[str] = []
    inside_pre = 0
    for e in visible(events(clean)):
        kind, tag = e[0], e[1]
        if kind == "text":
            m.put(tag) if inside_pre else m.words(tag)
        elif kind == "gone":
            continue
        elif tag in ("strong", "b", "em", "i", "a", "blockquote", "pre"):
            if kind == "open":
                if tag in ("blockquote", "pre"):
                    m.gap()
                inside_pre += tag == "pre"
                if tag == "a":
                    hrefs.append((dict(e[2]).get("href") or "").strip())
                m.push()
                continue
            inner = m.pop()
            if tag == "a":
                href, words = hrefs.pop(), " ".join(inner.split())
                if words:
                    if m.tail and not m.tail[-1].isspace():
                        m.put(" ")
                    m.put(f"[{words}]({href})" if href else words)
            elif tag == "blockquote":
                m.put("".join(f"> {line}\n" for line in _tidy(inner).splitlines()))
                m.gap()
            elif tag == "pre":
                inside_pre -= 1
                m.put(f"```text\n{inner}\n```")
                m.gap()
            else:
                mark = "**" if tag in ("strong", "b") else "*"
                if m.tail and not m.tail[-1].isspace():
                    m.put(" ")
                m.put(f"{mark}{' '.join(inner.split())}{mark}")
        elif tag in ("ul", "ol"):
            m.gap()
            if kind == "open":
                m.lists.append(1 if tag == "ol" else None)
            elif m.lists:
                m.lists.pop()
        elif tag == "li":
            if kind == "close":
                m.put("\n")
            elif m.lists and m.lists[-1] is not None:
                m.put(f"{m.lists[-1]}. ")
                m.lists[-1] += 1
            else:
                m.put("- ")
        elif tag == "code":
            m.put("`")
        elif tag == "br" and kind == "open":
            m.put("  \n")
        elif tag == "img" and kind == "open" and images:
            a = dict(e[2])
            if (a.get("src") or "").strip():
                m.put(f"![{(a.get('alt') or '').strip().translate(_ESCAPE)}]({a['src'].strip()})")
        elif tag == "hr" and kind == "open":
            m.gap()
            m.put("---")
            m.gap()
        elif re.fullmatch("h[1-6]", tag):
            m.gap()
            if kind == "open":
                m.put("#" * int(tag[1]) + " ")
        elif tag == "p" or (kind == "close" and tag in ("html", "head", "body", "article", "main", "section", "div", "span", "tr", "table")):
            m.gap()
    return _tidy(m.pop())


def process(source: str | None, base: str | None = None, images: bool = False) -> dict:
    """clean_html, markdown, text and counts; empty and flagged when the source is nested too deep. Null is empty."""
    source = source or ""
    if too_deep(source):
        return {"clean_html": "", "markdown": "", "text": "", "depth_rejected": True, "stripped_elements": 0, "stripped_attributes": 0, "link_count": 0, "image_count": 0, "oversized": False}
    clean, counts = sanitise(source, base, images)
    return {"clean_html": clean, "markdown": markdown(clean, images), "text": plain_text(clean), "depth_rejected": False, **counts, "oversized": False}


PROCESSED = "struct<clean_html:string,markdown:string,text:string,depth_rejected:boolean,stripped_elements:int,stripped_attributes:int,link_count:int,image_count:int,oversized:boolean>"


def _process_html(source: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([process(s, b) if s is None or len(s) <= MOST_BYTES else process(None) | {"oversized": True} for s, b in zip(source, base)])


def process_html(source: Column | str, base: Column | str) -> Column:
    """``process`` over columns; a page above 8 MiB, more than a fetch may bring, is empty and says so in ``oversized``."""
    return F.pandas_udf(_process_html, PROCESSED)(source, base)


# Article pages.

_DATE_METAS = ("article:published_time", "og:published_time", "datepublished", "date", "pubdate", "publishdate", "dc.date", "dcterms.date")


def article(source: str | None, url: str | None) -> dict:
    """Title, body, date and signals of an article page, or why it is none.

    The body is the element with the best claim: article or main, else the parent whose paragraphs weigh most.
    """
    empty = {"ok": False, "reason": "empty_page", "title": None, "text": "", "published": None, "canonical": None, "signals": [], "n_paragraphs": 0, "n_links": 0}
    if not source or not source.strip():
        return empty
    if too_deep(source):
        return empty | {"reason": "nested_too_deep"}
    stream = events(source)
    metas, heads, times, canonical, ld = {}, [], [], None, []
    path: list[str] = []
    score: dict[tuple, list[int]] = {}
    text_at: dict[tuple, list[str]] = {}
    title: list[str] = []
    counters = [0]
    ids: list[int] = []
    n_links = n_par = 0
    for e in stream:
        if e[0] == "open":
            a = dict((k, v or "") for k, v in e[2])
            counters[0] += 1
            ids.append(counters[0])
            path.append(e[1])
            if e[1] == "meta" and (key := (a.get("property") or a.get("name") or a.get("itemprop") or "").lower()):
                metas.setdefault(key, a.get("content", "").strip())
            elif e[1] == "link" and a.get("rel", "").lower() == "canonical":
                canonical = safe_url(a.get("href", ""), url)
            elif e[1] == "time" and a.get("datetime"):
                times.append(a["datetime"])
            elif e[1] == "h1":
                heads.append("")
            elif e[1] == "p":
                n_par += 1
            elif e[1] == "a":
                n_links += 1
            elif e[1] == "script" and "ld+json" in a.get("type", "").lower():
                ld.append("")
        elif e[0] == "close":
            path.pop()
            ids.pop()
        else:
            data = e[1]
            if path and path[-1] == "title":
                title.append(data)
            if path and path[-1] == "script" and ld:
                ld[-1] += data
            if "h1" in path and heads:
                heads[-1] += data
            if any(t in DROPPED for t in path) or "head" in path or not data.strip():
                continue
            n = len(data.split())
            for depth, tag in enumerate(path):
                if tag in ("article", "main"):
                    key = (0 if tag == "article" else 1, ids[depth])
                    text_at.setdefault(key, []).append(data)
            if "p" in path:
                parent = path.index("p") - 1
                if parent >= 0:
                    key = (2, ids[parent])
                    score.setdefault(key, [0, 0])[0] += n
                    text_at.setdefault(key, []).append(data)
    words = lambda key: sum(len(t.split()) for t in text_at[key])
    named = sorted((k for k in text_at if k[0] < 2), key=lambda k: (k[0], -words(k), k[1]))
    clusters = sorted((k for k in text_at if k[0] == 2), key=lambda k: (-words(k), k[1]))
    best = next(iter([k for k in named if words(k) >= 5] + clusters), None)
    text = " ".join(" ".join(text_at[best]).split()) if best else ""
    joined = lambda parts: " ".join(" ".join(parts).split())
    found = metas.get("og:title") or joined(heads[:1]) or joined(title)
    published = next((metas[k] for k in _DATE_METAS if metas.get(k)), None)
    if not published:
        dates = re.findall(r'"datePublished"\s*:\s*"([^"]+)"', " ".join(ld))
        published = (times or dates or [None])[0]
    signals = [s for s, on in (("article_element", bool(named)), ("og_article", metas.get("og:type") == "article"), ("json_ld", bool(re.search(r'"@type"\s*:\s*"(News|Blog)?(Article|Posting)', " ".join(ld)))), ("dated", bool(published)), ("single_h1", len(heads) == 1), ("long_body", len(text) >= 500), ("paragraphs", n_par >= 3)) if on]
    reason = "missing_title" if not found else "missing_body" if not text else "thin_body" if len(text) < 40 else "link_collection" if n_links > 3 * max(1, n_par) + 10 else "ok"
    return {"ok": reason == "ok", "reason": reason, "title": found or None, "text": text, "published": published, "canonical": canonical, "signals": signals, "n_paragraphs": n_par, "n_links": n_links}


ARTICLE = "struct<ok:boolean,reason:string,title:string,text:string,published:string,canonical:string,signals:array<string>,n_paragraphs:int,n_links:int>"


def _extract_article(source: pd.Series, url: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([article(s, u) for s, u in zip(source, url)])


def extract_article(source: Column | str, url: Column | str) -> Column:
    """``article`` over columns."""
    return F.pandas_udf(_extract_article, ARTICLE)(source, url)


def links(source: str | None, base: str | None) -> list[dict]:
    """The page's links in order, each URL once: its text, whether it stands in navigation, and feeds it announces."""
    out, seen, path, held = [], {}, [], None
    for e in events(source or ""):
        if e[0] == "open":
            path.append(e[1])
            a = dict((k, v or "") for k, v in e[2])
            if e[1] == "a" and (u := safe_url(a.get("href", ""), base)):
                held = {"url": u.split("#")[0], "text": "", "in_menu": bool(DROPPED & set(path)), "kind": "html", "confidence": 0.65}
            elif e[1] == "link" and "alternate" in a.get("rel", "").lower().split() and (u := safe_url(a.get("href", ""), base)):
                t, h = a.get("type", "").lower(), a.get("href", "").lower()
                kind = "atom" if "atom" in t or "atom" in h else "rss" if "rss" in t or "xml" in t or "rss" in h or h.endswith(".xml") else ""
                if kind and "oembed" not in t and "/oembed/" not in h and u not in seen:
                    seen[u] = True
                    out.append({"url": u, "text": "", "in_menu": False, "kind": kind, "confidence": 0.97})
        elif e[0] == "close":
            path.pop()
            if e[1] == "a" and held:
                held["text"] = " ".join(held["text"].split())
                if held["url"] not in seen and held["url"] != base:
                    seen[held["url"]] = True
                    low = held["url"].lower()
                    if re.search(r"(rss|feed|atom)(\.xml|/|$)|\.(rss|atom)$", low):
                        held |= {"kind": "atom" if "atom" in low else "rss", "confidence": 0.9}
                    out.append(held)
                held = None
        elif held is not None:
            held["text"] += e[1]
    return [d | {"pos": i} for i, d in enumerate(out)]


LINKS = "array<struct<url:string,text:string,in_menu:boolean,kind:string,confidence:double,pos:int>>"


def _page_links(source: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([links(s, b) for s, b in zip(source, base)])


def page_links(source: Column | str, base: Column | str) -> Column:
    """``links`` over columns."""
    return F.pandas_udf(_page_links, LINKS)(source, base)


_DATA = re.compile(r"<script[^>]*(?:id=[\"']__NEXT_DATA__[\"']|data-sveltekit-fetched|type=[\"']application/json[\"'])[^>]*>(.*?)</script>", re.S | re.I)
_TEXTS, _TITLES, _URLS = ("body", "content", "articleBody", "html", "text"), ("title", "headline", "name"), ("url", "slug", "path", "canonicalUrl", "href")
MOST_DEPTH, MOST_NODES = 64, 50_000


def embedded_article(source: str | None, url: str | None) -> dict | None:
    """The article in a page's embedded JSON: the object with title and text whose address ends like the page's, else the longest.

    The walk is bounded in depth and nodes and goes breadth first, so the outermost objects are seen before the bound.
    """
    tail = (urlsplit(url or "").path.rstrip("/").rsplit("/", 1)[-1] or "/").lower()
    best: tuple | None = None
    for m in _DATA.finditer(source or ""):
        try:
            level, seen = [json.loads(_html.unescape(m[1]) if "&quot;" in m[1] else m[1])], 0
        except ValueError:
            continue
        for _ in range(MOST_DEPTH):
            below: list = []
            for x in level:
                seen += 1
                if isinstance(x, dict):
                    title, text = (next((x[k] for k in keys if isinstance(x.get(k), str) and x[k].strip()), None) for keys in (_TITLES, _TEXTS))
                    if title and text:
                        same = any(isinstance(x.get(k), str) and x[k].rstrip("/").lower().endswith(tail) for k in _URLS)
                        rank = (same, len(text), -seen)
                        if best is None or rank > best[0]:
                            best = (rank, {"title": " ".join(title.split()), "text": plain_text(text)})
                    below += x.values()
                elif isinstance(x, list):
                    below += x
            level = below[: max(0, MOST_NODES - seen)]
            if not level:
                break
    return best[1] if best else None


def structure_fingerprint(source: str | None) -> list[str]:
    return sorted({f"{e[1]}|{' '.join(sorted((dict(e[2]).get('class') or '').split())[:8])}" for e in events(source or "") if e[0] == "open"})


def _structure(source: pd.Series) -> pd.Series:
    return pd.Series([structure_fingerprint(s) for s in source])


def structure(source: Column | str) -> Column:
    """``structure_fingerprint`` over a column."""
    return F.pandas_udf(_structure, "array<string>")(source)


def fingerprint(source: Column) -> Column:
    return F.sha2(F.array_join(structure(source), "\n"), 256)

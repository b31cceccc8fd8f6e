"""Main text of web pages by tag-path ratios.

A text node is known by its path, the tags (with classes) from the root to it.
Per path the text length and the punctuation are set against the number of
nodes. Both ratios are smoothed along the page, multiplied, and the paths that
reach a threshold are content: running text scores high on both, while menus,
lists of links and labels score low. The element that holds the content gives
the blocks; elements named as menus, notices, adverts, forms or comments, and
blocks of links, are left out. A name never takes out the element that holds
the article: that with the page's main element, or with its first heading and
half of its text, or with nearly all text. Names of a state (``has-sidebar``,
``nav-open``) do not count, parts of a name do not count for a paragraph, and
names that sections of an article bear too (``related``) count where the
element is links or labels.

Defined cases: a null or empty page has an empty text; markup may be cut off,
unclosed or wrongly nested; nesting depth and length are not limited; all
work is linear in the page. Equal pages give equal texts.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline.llm.common import arrow_map

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style noscript template textarea iframe noembed noframes xmp".split())
SKIP = RAW | frozenset("head nav header footer aside form button select option datalist svg math canvas object audio video dialog menu label input title map".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
MAIN = re.compile(r"""\brole\s*=\s*["']?main\b|\bitemprop\s*=\s*["']?articleBody\b""", re.I)
# Words in class and id names. The second list is also used for parts of articles.
_HARD = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|pop-up|modal|overlay|newsletter|subscribe|"
    r"signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|widgets?|footer|header|masthead|toolbar|social|"
    r"comments?|comment-\w+|replies|reply|disqus|pagination|pager|hidden|sr-only|visually-hidden|copyright"
)
_SOFT = r"side|share|sharing|related|recommended|tags|skip"
NOISE = re.compile(rf"(?:^|[\s_-])(?:{_HARD})(?:$|[\s_-])", re.I)
WEAK_NOISE = re.compile(rf"(?:^|[\s_-])(?:{_SOFT})(?:$|[\s_-])", re.I)
WHOLE_NOISE = re.compile(rf"(?:^|\s)(?:{_HARD}|{_SOFT})(?:$|\s)", re.I)
STATE = re.compile(r"(?<!\S)(?:(?:has|with|without|no)-\S+|\S+-(?:open|closed|collapsed|expanded))(?!\S)", re.I)
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th span b i em strong a u font".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PUNCT = re.compile(r"""[.,;:!?…。，、；：！？¿¡»«"'()]""")

SPREAD = (0.25, 0.5, 0.25)  # smoothing weights over neighbouring nodes
SHARE = 0.1  # a content path reaches this share of the best fused ratio


class _Page:
    """Elements and text nodes of one page."""

    def __init__(self) -> None:
        self.parent, self.tag, self.skip, self.main, self.path, self.link = [-1], [""], [False], [False], [0], [False]
        self.named: dict[int, bool] = {}  # elements with a name of noise, and whether it is a strong one
        self.paths: dict[tuple[int, str], int] = {}
        self.open, self.count = [0], {}
        self.nodes: list[tuple[int, int, str]] = []  # block, element, text
        self.block = 0

    def push(self, tag: str, attrs: str) -> None:
        up = self.open[-1]
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)) if attrs else ""
        label = f"{tag}.{names.lower()}" if names else tag
        path = self.paths.setdefault((self.path[up], label), len(self.paths) + 1)
        main = tag in ("article", "main") or bool(attrs and MAIN.search(attrs))
        if names and tag not in ("html", "body", "main"):
            own = STATE.sub("", names)
            strong = bool((WHOLE_NOISE if tag in TEXT_LEVEL else NOISE).search(own))
            if strong or (tag not in TEXT_LEVEL and WEAK_NOISE.search(own)):
                self.named[len(self.tag)] = strong
        self.skip.append(self.skip[up] or tag in SKIP or bool(attrs and _HIDDEN.search(attrs)))
        self.parent.append(up)
        self.tag.append(tag)
        self.main.append(main)
        self.path.append(path)
        self.link.append(self.link[up] or tag == "a")
        self.open.append(len(self.tag) - 1)
        self.count[tag] = self.count.get(tag, 0) + 1

    def pop_to(self, tag: str) -> None:
        while True:
            t = self.tag[self.open.pop()]
            self.count[t] -= 1
            if t == tag:
                return

    def close_implied(self, tag: str) -> None:
        if tag in CLOSES_P and self.count.get("p"):
            self.pop_to("p")
        ends = CLOSED_BY.get(tag)
        if ends and any(self.count.get(t) for t in ends):
            for e in reversed(self.open):
                t = self.tag[e]
                if t in SCOPE[tag]:
                    break
                if t in ends:
                    self.pop_to(t)
                    break

    def feed(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.search(page, at)
            start = m.start() if m else n
            if start > at and not self.skip[self.open[-1]]:
                self.nodes.append((self.block, self.open[-1], page[at:start]))
            if m is None:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if tag in BLOCK:
                self.block += 1
            if m[1]:
                if self.count.get(tag):
                    self.pop_to(tag)
                continue
            if tag in VOID:
                if tag == "br" and not self.skip[self.open[-1]]:
                    self.nodes.append((self.block, self.open[-1], " "))
                continue
            self.close_implied(tag)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                continue
            self.push(tag, m[3])
            if m[3].endswith("/") and tag in ("svg", "math"):
                self.pop_to(tag)


def _smooth(values: list[float]) -> list[float]:
    a, b, c = SPREAD
    return [a * (values[i - 1] if i else v) + b * v + c * (values[i + 1] if i + 1 < len(values) else v) for i, v in enumerate(values)]


def content_paths(paths: list[int], texts: list[str]) -> set[int]:
    """Paths whose smoothed, fused ratios reach the threshold."""
    length, marks, nodes = {}, {}, {}
    for p, t in zip(paths, texts):
        length[p] = length.get(p, 0) + len(t)
        marks[p] = marks.get(p, 0) + len(_PUNCT.findall(t))
        nodes[p] = nodes.get(p, 0) + 1
    size = _smooth([length[p] / nodes[p] for p in paths])
    mark = _smooth([marks[p] / nodes[p] for p in paths])
    total: dict[int, float] = {}
    for p, s, m in zip(paths, size, mark):
        total[p] = total.get(p, 0.0) + s * (0.5 + m)
    fused = {p: v / nodes[p] for p, v in total.items()}
    line = SHARE * max(fused.values())
    return {p for p, v in fused.items() if v >= line}


def skip_named(doc: _Page, texts: list[tuple[int, str]]) -> None:
    """Skip elements with a name of noise, but for those that hold the article."""
    if not doc.named:
        return
    n = len(doc.tag)
    size, linked, marks = [0] * n, [0] * n, [0] * n
    for e, t in texts:
        size[e] += len(t)
        marks[e] += len(_PUNCT.findall(t))
        if doc.link[e]:
            linked[e] += len(t)
    for e in range(n - 1, 0, -1):
        up = doc.parent[e]
        size[up] += size[e]
        linked[up] += linked[e]
        marks[up] += marks[e]

    def above(e: int) -> set[int]:
        out = set()
        while e > 0:
            out.add(e)
            e = doc.parent[e]
        return out

    mains = [e for e in range(n) if doc.main[e] and not doc.skip[e] and e not in doc.named]
    of_main = above(max(mains, key=lambda e: (size[e], -e))) if mains else set()
    of_title = above(next((e for e in range(n) if doc.tag[e] == "h1" and not doc.skip[e]), 0))
    for e in range(1, n):
        if doc.skip[doc.parent[e]]:
            doc.skip[e] = True
        elif e in doc.named:
            strong = doc.named[e] or 2 * linked[e] >= size[e] or not marks[e]
            holds = (e in of_main and size[e] >= 0.3 * size[0]) or (e in of_title and 2 * size[e] >= size[0]) or size[e] >= 0.98 * size[0]
            doc.skip[e] = doc.skip[e] or (strong and not holds)


def extract(page: str | None) -> str:
    """Blocks of the main text, joined by newlines."""
    if not page:
        return ""
    doc = _Page()
    doc.feed(page)
    shown = [(b, e, html.unescape(t)) for b, e, t in doc.nodes]
    skip_named(doc, [(e, t.strip()) for _, e, t in shown])
    shown = [(b, e, t) for b, e, t in shown if not doc.skip[e]]
    filled = [(b, e, t) for b, e, t in shown if t.strip()]
    if not filled:
        return ""
    content = content_paths([doc.path[e] for _, e, _ in filled], [t.strip() for _, _, t in filled])
    picked = [(e, len(t)) for _, e, t in filled if doc.path[e] in content and not doc.link[e]] or [(e, len(t)) for _, e, t in filled]
    root = _root(doc, picked)
    inside = [False] * len(doc.tag)
    for e in range(len(doc.tag)):  # parents come before children
        inside[e] = e == root or (e > 0 and inside[doc.parent[e]])
    parts: dict[int, list[str]] = {}
    links: dict[int, int] = {}
    for b, e, t in shown:
        if inside[e]:
            parts.setdefault(b, []).append(t)
            if doc.link[e]:
                links[b] = links.get(b, 0) + len(t.strip())
    blocks = {b: " ".join("".join(ts).split()) for b, ts in parts.items()}
    return "\n".join(t for b, t in sorted(blocks.items()) if t and not (links.get(b, 0) >= 0.9 * len(t) and len(blocks) > 1))


def _root(doc: _Page, picked: list[tuple[int, int]]) -> int:
    """The outermost named main element with the most content, else the lowest element that holds nearly all of it."""
    weight = [0] * len(doc.tag)
    for e, n in picked:
        weight[e] += n
    for e in range(len(doc.tag) - 1, 0, -1):
        weight[doc.parent[e]] += weight[e]
    mains = [e for e in range(len(doc.tag)) if doc.main[e] and not doc.skip[e] and weight[e]]
    if mains:
        best = max(mains, key=lambda e: (weight[e], -e))
        articles = [e for e in mains if doc.tag[e] != "main" and weight[e] >= 0.5 * weight[best]]
        if weight[best] >= 0.3 * weight[0]:
            return max(articles, key=lambda e: (weight[e], -e)) if articles else best
    root = 0
    heavy: dict[int, int] = {}
    for e in range(1, len(doc.tag)):
        if weight[e] >= 0.9 * weight[0] and doc.parent[e] == root and heavy.get(root) is None:
            heavy[root] = root = e
    while root and doc.tag[root] in ("p", "li", "b", "i", "em", "strong", "span", "td", "tr", "tbody", "blockquote", "h1", "h2", "h3", "font", "u"):
        root = doc.parent[root]
    return root


def main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page. No shuffle."""
    src = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("__html"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(src, run, f"page_id {src.schema['page_id'].dataType.simpleString()}, url {src.schema['url'].dataType.simpleString()}, text string, n_chars long", "__html", rows=256)

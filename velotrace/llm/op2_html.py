"""Main text of web pages by a minimum cut.

A page becomes blocks of text in order. A logistic classifier over each block's surroundings and shape gives its log-odds of being content, at most LIMIT
either way; these are the capacities of its edge to one of two terminals. Blocks that follow each other, and blocks that share a parent, are joined by
edges whose capacity is what agreement of such blocks is worth. The minimum cut is the cheapest labelling of the page; where the classifier is unsure, the
neighbours decide. What HTML itself says is no text of an article (scripts, forms, navigation, hidden parts) makes no block.

The classifier and the two edge weights are fitted on PAGES made-up pages with known labels (op2_layouts), the same for every corpus. Class and id names
are evidence like any other, on two separate counts: below the nearest article or main element, and above it. So a wrapper's name doesn't condemn the
article in it.

Defined results: null or empty html has the text "" and 0 code points; a page without content blocks too; repeated rows give equal rows; an empty
table gives none; extra columns are ignored; pages of any length are read whole.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import op2_layouts
from .common import keep_columns, table

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
SPACE = re.compile(r"\s+")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noframes"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
BLOCK = {
    "p", "div", "article", "section", "main", "header", "footer", "nav", "aside", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th",
    "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "form", "fieldset", "figure", "figcaption", "body", "html", "head", "address", "details", "summary", "hr", "hgroup", "caption", "dialog", "menu", "center",
}
#: An opening tag that ends an open one of these kinds in the same parent.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that hold no text of an article, and those that seldom do.
NEVER = {"nav", "form", "script", "style", "title", "noscript", "textarea", "iframe", "template", "svg", "button", "select", "option", "label", "menu", "dialog", "xmp", "noframes", "head", "object", "canvas", "audio", "video"}
FURNITURE = {"footer", "aside", "header"}
NEVER_ROLE = ("navigation", "search", "form", "alert", "dialog", "menu")
FURNITURE_ROLE = ("banner", "complementary", "contentinfo", "note")
GOOD = {"article", "main"}
BAD_WORD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent\w*|notice\w*|popup|modal|newsletter|subscri\w*|sidebar\w*|side|widget\w*|menu\w*|nav\w*|breadcrumb\w*|pagination|pager|"
    r"footer\w*|header|masthead|toolbar|share\w*|social\w*|related\w*|recommend\w*|comment\w*|reply|replies|discuss\w*|respond|disqus\w*|login|signup|search\w*|copyright|legal|disclaimer|gdpr|skip\w*|tags?|toc)(?=$|[\s_-])",
    re.I,
)
GOOD_WORD = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|story|content|main|body|text)(?=$|[\s_-])", re.I)
#: Name parts that only say what else is on the page.
MODIFIER = re.compile(r"^(?:with|has|have|no|without|is|js|show|hide)[-_]", re.I)
FEATURES = ("base", "in_good", "good_name", "bad_name", "bad_above", "furniture", "words", "links", "all_links", "heading", "p", "li", "mark", "good_and_bad")
#: Pages that the classifier is fitted on, its ridge, and the most that its log-odds and an edge may weigh.
PAGES, RIDGE, LIMIT, EDGE = 400, 1.0, 4.0, 0.7


class Block:
    __slots__ = ("text", "parent", "good", "good_name", "bad_name", "bad_above", "furniture", "links", "tag")


def _names(value: str) -> tuple[bool, bool]:
    """(speaks against content, speaks for it) of a class or id attribute."""
    parts = [x for x in value.split() if not MODIFIER.match(x)]
    bad = any(BAD_WORD.search(x) for x in parts)
    return bad, not bad and any(GOOD_WORD.search(x) for x in parts)


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, with what surrounds them."""
    out: list[Block] = []
    # element: tag, number, in link, never, good, good_name, bad_name, bad_above, furniture
    stack: list[tuple] = [("", 0, False, False, False, False, False, False, False)]
    parts: list[str] = []
    linked = number = articles = 0
    at = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = "" if stack[-1][3] else SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                b = Block()
                k = len(stack) - 1
                while stack[k][0] and stack[k][0] not in BLOCK:
                    k -= 1
                b.text, b.tag, b.parent = text, stack[k][0], stack[max(k - 1, 0)][1]
                b.good, b.good_name, b.bad_name, b.bad_above, b.furniture = stack[-1][4:]
                b.links = min(1.0, linked / max(1, len(text)))
                out.append(b)
            parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if stack[-1][2]:
                linked += len(text)

    while True:
        m = TAG.search(page, at)
        add(page[at : m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            if any(e[0] == name for e in stack):
                if name in BLOCK or name in NEVER:
                    flush()
                while stack[-1][0] != name:
                    stack.pop()
                stack.pop()
            elif name in BLOCK:
                flush()
            continue
        if name in VOID:
            if name == "br":
                add("\n")
            elif name == "hr":
                flush()
            continue
        if m.group(3).rstrip().endswith("/") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCK or name in NEVER:
            flush()
            if name in BLOCK and any(e[0] == "p" for e in stack[-6:]):  # a block ends an open paragraph, and what is open in it
                k = max(i for i, e in enumerate(stack) if e[0] == "p")
                if not any(e[0] in BLOCK for e in stack[k + 1 :]):
                    del stack[k:]
        for closed in ENDS.get(name, ()):
            if stack[-1][0] == closed:
                flush()
                stack.pop()
                break
        number += 1
        _, _, link, never, good, good_name, bad_name, bad_above, furniture = stack[-1]
        link = link or name == "a"
        never = never or name in NEVER
        furniture = furniture or (name in FURNITURE and not (name == "header" and good))
        own_bad = own_good = False
        enters = name in GOOD
        if m.group(3) and name not in ("html", "body"):
            for key, *values in ATTR.findall(m.group(3)):
                value = "".join(values)
                key = key.lower()
                if key == "hidden" or key == "aria-hidden":
                    never = never or key == "hidden" or value.lower() == "true"
                elif key == "role":
                    role = value.lower()
                    enters = enters or role in ("main", "article")
                    never = never or role in NEVER_ROLE
                    furniture = furniture or role in FURNITURE_ROLE
                else:
                    bad, fine = _names(value)
                    own_bad, own_good = own_bad or bad, own_good or fine
        if enters:
            articles += not good
            good, bad_above, bad_name = True, bad_above or bad_name, False
        stack.append((name, number, link, never, good, good_name or own_good, bad_name or own_bad, bad_above, furniture))
    flush()
    if articles == 1:  # the only article is no part of a list of others
        for b in out:
            b.bad_above = b.bad_above and not b.good
    return out


def evidence(b: Block) -> tuple:
    words = b.text.count(" ") + 1
    return (
        1.0, b.good, b.good_name, b.bad_name, b.bad_above, b.furniture, math.log(words), b.links, b.links > 0.8, b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag == "p", b.tag in ("li", "td", "th", "dd", "dt"),
        b.text[-1] in ".!?…:\"'", b.bad_name and b.good,
    )


@functools.lru_cache(maxsize=4)
def fitted(pages: int = PAGES) -> tuple[tuple[float, ...], float, float]:
    """(weights of the evidence, capacity between blocks that follow each other, between blocks of one parent)."""
    x, y, same = [], [], {True: [0, 0], False: [0, 0]}
    for seed in range(pages):
        html, content = op2_layouts.page(seed)
        found = blocks(html)
        x += [evidence(b) for b in found]
        yes = [b.text in content for b in found]
        y += yes
        for i in range(1, len(found)):
            same[found[i].parent == found[i - 1].parent][yes[i] == yes[i - 1]] += 1
    x, y = np.array(x, float), np.array(y, float)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * w)
    worth = lambda d: min(EDGE, 0.25 * math.log((same[d][1] + 1) / (same[d][0] + 1)))
    follow = max(0.05, worth(False))
    return tuple(w.tolist()), follow, max(0.05, worth(True))


def score(b: Block, weights: tuple[float, ...]) -> float:
    """The classifier's log-odds of content."""
    return max(-LIMIT, min(LIMIT, sum(a * w for a, w in zip(evidence(b), weights) if a)))


class Flow:
    """Maximum flow by levels and blocking paths (no recursion); nodes are 0..n-1, then source and sink."""

    def __init__(self, n: int):
        self.n, self.head = n + 2, [[] for _ in range(n + 2)]
        self.to, self.cap = [], []

    def edge(self, a: int, b: int, cap: float, back: float = 0.0) -> None:
        self.head[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(cap)
        self.head[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(back)

    def levels(self, s: int) -> list[int]:
        level = [-1] * self.n
        level[s] = 0
        queue = [s]
        for u in queue:
            for e in self.head[u]:
                v = self.to[e]
                if level[v] < 0 and self.cap[e] > 1e-9:
                    level[v] = level[u] + 1
                    queue.append(v)
        return level

    def source_side(self, s: int, t: int) -> list[bool]:
        """Pushes all flow; which nodes can still be reached from the source."""
        while (level := self.levels(s))[t] >= 0:
            turn = [0] * self.n
            path: list[int] = []
            u = s
            while True:
                if u == t:
                    push = min(self.cap[e] for e in path)
                    keep = len(path)
                    for k, e in enumerate(path):
                        self.cap[e] -= push
                        self.cap[e ^ 1] += push
                        if self.cap[e] <= 1e-9 and k < keep:
                            keep = k
                    u = self.to[path[keep] ^ 1]
                    del path[keep:]
                    continue
                while turn[u] < len(self.head[u]):
                    e = self.head[u][turn[u]]
                    if self.cap[e] > 1e-9 and level[self.to[e]] == level[u] + 1:
                        break
                    turn[u] += 1
                if turn[u] < len(self.head[u]):
                    path.append(e)
                    u = self.to[e]
                elif path:
                    e = path.pop()
                    u = self.to[e ^ 1]
                    turn[u] += 1
                else:
                    break
        return [x >= 0 for x in level]


def label(found: list[Block], model: tuple | None = None) -> list[bool]:
    """The cheapest labelling: True for content."""
    weights, follow, sibling = model or fitted()
    n = len(found)
    flow, s, t = Flow(n), n, n + 1
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        x = score(b, weights)
        if x >= 0:
            flow.edge(s, i, x)
        else:
            flow.edge(i, t, -x)
        if i:
            flow.edge(i - 1, i, follow, follow)
        k = last.get(b.parent)
        if k is not None:
            flow.edge(k, i, sibling, sibling)
        last[b.parent] = i
    return flow.source_side(s, t)[:n]


def main_text(page: str | None, model: tuple | None = None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, yes in zip(found, label(found, model)) if yes) if found else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    kept, model = keep_columns(pages, id_col, url_col, html_col), fitted()
    kinds = [t for _, t in kept.dtypes]
    schema = f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long"

    def work(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                texts = [main_text(p, model) for p in batch.column(2).slice(lo, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 512), batch.column(1).slice(lo, 512), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    return kept.mapInArrow(work, schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

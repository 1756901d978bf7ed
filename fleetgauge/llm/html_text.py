"""Main text of HTML pages by a tree-structured graphical model.

Every element is a node that is content or not. A node's potential comes from its class, id and role words; a
parent-child potential says how likely a child of its tag is content when its parent is. Both are counted on
labelled pages. Sum-product message passing, once up and once down the tree, gives the exact marginal of every node,
and the text directly in nodes that are more likely content than not is kept.

Pages are independent, so the work is one pass over the table without a shuffle; the model is a few hundred numbers.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetgauge.llm.labelled_pages import PAGES
from fleetgauge.llm.shared import configure, per_batch

# Fixed values of the HTML standard: elements without content, with raw text, and how end tags may be left out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg math select object".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY_SIBLING = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<[/a-zA-Z][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z0-9]+")


@dataclass
class Dom:
    """Elements in page order, so a parent comes before its children; node 0 is the page."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    marks: list[str | None] = field(default_factory=lambda: ["0"])
    texts: list[tuple[int, int, str]] = field(default_factory=list)  # node, block, text

    def kinds(self) -> list[str]:
        """What a parent-child potential depends on: the tag, and whether it stands directly in the page's body."""
        tags, parents = self.tags, self.parents
        return [f"body>{t}" if p > 0 and tags[p] == "body" else t for t, p in zip(tags, parents)]


def parse(page: str) -> Dom:
    """The element tree of a page, as lenient as browsers are with missing end tags and cut pages."""
    dom, open_nodes, block, at = Dom(), [0], 0, 0

    def close(names: set[str] | frozenset[str], fence: set[str]) -> None:
        for depth in range(len(open_nodes) - 1, 0, -1):
            tag = dom.tags[open_nodes[depth]]
            if tag in names:
                del open_nodes[depth:]
                return
            if tag in fence:
                return

    for_raw: re.Match | None = None
    while True:
        for_raw = _MARKUP.search(page, at)
        text = page[at : for_raw.start()] if for_raw else page[at:]
        if text:
            dom.texts.append((open_nodes[-1], block, text))
        if not for_raw:
            return dom
        at, name = for_raw.end(), (for_raw["name"] or "").lower()
        if not name:
            continue
        if name not in INLINE:
            block += 1
        elif name == "br":
            dom.texts.append((open_nodes[-1], block, " "))
        if for_raw["end"]:
            if name == "p" and not any(dom.tags[n] == "p" for n in open_nodes):
                continue
            fence = {"article", "main", "body"} if name in INLINE else set()
            close({name}, fence)
            continue
        if name in CLOSES_P:
            close({"p"}, {"article", "section", "div", "td", "th", "li", "table", "button", "blockquote", "figure"})
        if name in CLOSED_BY_SIBLING:
            names, fence = CLOSED_BY_SIBLING[name]
            while dom.tags[open_nodes[-1]] not in fence and any(dom.tags[n] in names for n in open_nodes[1:]):
                before = len(open_nodes)
                close(names, fence)
                if len(open_nodes) == before:
                    break
        attributes = for_raw["attributes"]
        words: tuple[str, ...] = ()
        mark = None
        if "=" in attributes:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            named = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
            words, mark = tuple(_WORD.findall(named)), found.get("data-main")
        dom.tags.append(name)
        dom.parents.append(open_nodes[-1])
        dom.words.append(words)
        dom.marks.append(mark)
        node = len(dom.tags) - 1
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            if name == "noscript" or end is None and name not in ("script", "style"):
                # what follows an unclosed element is still read as markup
                at = end.end() if end else at
            else:
                at = end.end() if end else len(page)
        elif name not in VOID:
            open_nodes.append(node)


@dataclass(frozen=True)
class TreeModel:
    """Log potentials: by tag, of a child's label given its parent's; by word, of content against not."""

    child: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    unknown: tuple[tuple[float, float], tuple[float, float]]  # of other tags
    worded: tuple[tuple[float, float], tuple[float, float]]  # of elements with a telling word, whatever the tag
    word: dict[str, float]

    def marginals(self, dom: Dom) -> list[float]:
        """Probability of content for every node: messages up to the page, then down again."""
        n = len(dom.tags)
        word = self.word
        own = [sum([word.get(w, 0.0) for w in ws]) if ws else 0.0 for ws in dom.words]  # evidence for content
        telling = [any(w in word for w in ws) if ws else False for ws in dom.words]
        edges = [
            self.worded if told else self.child.get(kind) or self.child.get(tag, self.unknown)
            for told, kind, tag in zip(telling, dom.kinds(), dom.tags)
        ]
        up0, up1 = [0.0] * n, own[:]  # belief from the node and all below it, as logs
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
        parents = dom.parents
        for i in range(n - 1, 0, -1):
            (e00, e01), (e10, e11) = edges[i]
            b0, b1 = up0[i], up1[i]
            m0, m1 = _log_sum(e00 + b0, e01 + b1), _log_sum(e10 + b0, e11 + b1)
            sent[i] = (m0, m1)
            up0[parents[i]] += m0
            up1[parents[i]] += m1
        out = [0.0] * n
        total0, total1 = [0.0] * n, [-math.inf] * n  # the page itself is no content
        for i in range(1, n):
            p = parents[i]
            base0, base1 = (total0[p] - sent[i][0], total1[p] - sent[i][1]) if p else (0.0, -math.inf)
            (e00, e01), (e10, e11) = edges[i]
            t0 = up0[i] + _log_sum(base0 + e00, base1 + e10)
            t1 = up1[i] + _log_sum(base0 + e01, base1 + e11)
            top = max(t0, t1)
            total0[i], total1[i] = t0 - top, t1 - top
            out[i] = 1.0 / (1.0 + math.exp(min(700.0, t0 - t1)))
        return out


def _log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def train_tree(pages: tuple[str, ...] = PAGES, smoothing: float = 0.02) -> TreeModel:
    """Counts potentials on labelled pages; a class word counts with the nodes that carry it."""
    edges: dict[str, Counter] = defaultdict(Counter)
    every: Counter = Counter()
    words: dict[str, Counter] = defaultdict(Counter)
    nodes: list[tuple[str, str, tuple[str, ...], int, int]] = []
    for page in pages:
        dom = parse(page)
        labels = [0] * len(dom.tags)
        for i, kind in enumerate(dom.kinds()):
            if i:
                parent = labels[dom.parents[i]]
                labels[i] = int(dom.marks[i]) if dom.marks[i] else parent
                nodes.append((dom.tags[i], kind, dom.words[i], parent, labels[i]))
    for _, _, names, _, label in nodes:
        for w in set(names):
            words[w][label] += 1
    telling = {w for w, c in words.items() if not c[0] or not c[1]}
    for tag, kind, names, parent, label in nodes:
        if telling.intersection(names):
            edges["#worded"][parent, label] += 1
        else:
            every[parent, label] += 1
            for key in {tag, kind}:
                edges[key][parent, label] += 1

    def table(counts: Counter) -> tuple:
        rows = []
        for parent in (0, 1):
            # what is unseen under a parent of this label keeps the parent's label
            prior = [smoothing, smoothing]
            prior[parent] += 0.5
            seen = [counts[parent, label] + prior[label] for label in (0, 1)]
            rows.append(tuple(math.log(s / sum(seen)) for s in seen))
        return tuple(rows)

    word = {w: 3.0 * math.log((words[w][1] + 0.1) / (words[w][0] + 0.1)) for w in telling}
    worded = table(edges.pop("#worded", Counter()))
    return TreeModel({t: table(c) for t, c in edges.items()}, table(every), worded, word)


def main_text(page: str | None, model: TreeModel) -> str:
    """The text of the nodes that are likely content: blocks with single spaces, two line ends between them."""
    if not page:
        return ""
    dom = parse(page)
    content = model.marginals(dom)
    blocks: dict[int, list[str]] = {}
    for node, block, text in dom.texts:
        if content[node] > 0.5:
            blocks.setdefault(block, []).append(text)
    decoded = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(b for b in decoded if b)


def extract_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    A null or empty page, or one without main text, has an empty text and 0. ``n_chars`` counts code points. Repeated
    rows and null ids are judged each; other columns are ignored; no pages give no rows. Whole pages are read.
    """
    configure(pages.sparkSession)
    model = model or train_tree()

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(page, model) for page in batch.column("html").to_pylist()]
            return pa.record_batch(
                {
                    "page_id": batch.column("page_id"),
                    "url": batch.column("url"),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                }
            )

        return step

    kind = dict(pages.dtypes)["page_id"]
    return per_batch(
        pages.select("page_id", "url", "html"), f"page_id {kind}, url string, text string, n_chars bigint", make
    )

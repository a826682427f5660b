"""Main text of pages by a tree-structured graphical model over the DOM.

Every block element and every stretch of text between block borders is a node with two states, content or
not. Node potentials are a logistic model of tag, class and id words, text length, punctuation and link
share; parent-child potentials say how often states go together. Sum-product messages pass from the leaves
to the root and back; stretches whose content marginal is at least one half are the page's text.

The potentials are trained on labelled pages: a bounded sample (``TRAIN_PAGES`` pages by hash order) of pages
whose own landmarks label them (text inside ``article`` or ``main``, outside excluded parts, is content). Every such
page trains twice, once with the landmark tags hidden, so that the model also works where a page has none.
Inference is one pass over pages, each page on its own.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapledger.llm.common import table
from snapledger.llm.registry import query

TRAIN_PAGES = 400
#: Element names of HTML that matter here.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = set("script style textarea title template iframe head".split())
#: Controls inside a block: their text is left out, up to their end tag or the next block tag at the latest.
CONTROLS = {"button", "select"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
LANDMARKS = {"article", "main"}
EXCLUDED = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
#: Words of tags, classes and ids that speak for and against content.
GOOD = set("article main content post entry story text body page".split())
BAD = set(
    "nav navbar navigation menu header masthead footer foot sidebar side aside widget ad ads advert adverts advertisement banner promo sponsor sponsored "
    "cookie cookies consent notice alert popup modal newsletter subscribe signup login form search comment comments reply replies discussion disqus "
    "share sharing social related recommended breadcrumb breadcrumbs pagination pager tags toolbar copyright legal".split()
)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")


class Page:
    """Nodes in page order: parent, tag, marking words, and for text stretches their text and link characters."""

    def __init__(self, source: str) -> None:
        self.parent, self.tag, self.words, self.text, self.linked = [-1], ["#root"], [frozenset()], [None], [0]
        self.open = [0]
        self.parts: list[str] = []
        self.links = self.in_link = 0
        self.control = ""
        self._read(source)
        self._close_text()

    def _add(self, tag: str, words: frozenset, text: str | None = None, linked: int = 0) -> int:
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1

    def _close_text(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self._add("#text", frozenset(), text, min(self.links, len(text)))
        self.parts, self.links = [], 0

    def _say(self, raw: str) -> None:
        if raw and not self.control:
            text = html.unescape(raw)
            self.parts.append(text)
            if self.in_link:
                self.links += len(text.strip())

    def _read(self, source: str) -> None:
        at = 0
        while True:
            match = TOKEN.search(source, at)
            self._say(source[at : match.start() if match else len(source)])
            if not match:
                return
            at = match.end()
            tag = (match[2] or match[5] or "").lower()
            if not tag:
                continue
            closing, attributes = match[1] or match[4], match[3] or match[6] or ""
            if not closing and tag in RAW and not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = end.end() if end else (at if tag == "head" else len(source))
                self.parts.append(" ")
                continue
            if tag in CONTROLS:
                self.control = "" if closing else tag
                self.parts.append(" ")
            elif tag == "a":
                self.in_link = 0 if closing else 1
            elif tag == "br":
                self.parts.append(" ")
            elif tag in BLOCKS:
                self._close_text()
                self.in_link, self.control = 0, ""
                if closing:
                    self._pop({tag}, BLOCKS - {tag} if tag == "p" else {"#root"})
                    continue
                if tag in ENDS_P:
                    self._pop({"p"}, BLOCKS - {"p"})
                if tag in SELF_CLOSING:
                    self._pop(SELF_CLOSING[tag], {"ul", "ol", "dl", "table"})
                words = frozenset(w for m in MARKS.finditer(attributes) for w in WORD.findall((m[2] or m[3] or m[4] or "").lower()))
                node = self._add(tag, words)
                if tag not in VOID and not attributes.endswith("/"):
                    self.open.append(node)

    def _pop(self, tags: set[str], stop: set[str]) -> None:
        """Close the innermost open element of ``tags``, unless one of ``stop`` lies in between."""
        for depth in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[depth]]
            if name in tags:
                del self.open[depth:]
                return
            if name in stop:
                return


FEATURES = 16


def features(page: Page, hide: bool = False) -> np.ndarray:
    """One row per node. ``hide``: landmark tags count as plain containers."""
    n = len(page.tag)
    own = np.array([len(t) if t else 0 for t in page.text], float)
    linked = np.array(page.linked, float)
    total, link_total = own.copy(), linked.copy()
    for k in range(n - 1, 0, -1):
        total[page.parent[k]] += total[k]
        link_total[page.parent[k]] += link_total[k]
    x = np.zeros((n, FEATURES))
    x[:, 0] = 1.0
    share = link_total / np.maximum(total, 1.0)
    bad = barred(page)
    for k in range(n):
        tag, words, text, up = page.tag[k], page.words[k], page.text[k], page.parent[k]
        is_text = text is not None
        x[k, 1] = is_text
        x[k, 2] = share[k]
        x[k, 3] = share[k] * is_text
        if is_text:
            x[k, 4] = min(np.log1p(len(text)) / 6.0, 1.5)
            x[k, 5] = min(sum(map(text.count, ".,;:?!")) / 5.0, 2.0)
            x[k, 6] = page.tag[up] in ("p", "blockquote", "pre", "h1", "h2", "h3", "li", "td", "dd", "figcaption")
        if not hide:
            x[k, 7] = tag in LANDMARKS
        x[k, 8] = bad[k]
        x[k, 9] = bool(words & GOOD) and not bad[k]
        x[k, 10] = tag in ("p", "blockquote", "pre")
        x[k, 11] = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        x[k, 12] = tag in ("ul", "ol", "li", "dl")
        x[k, 13] = tag in ("html", "body", "#root")
        x[k, 14] = total[k] / max(total[0], 1.0)
        x[k, 15] = tag in ("div", "section", "td")
    return x


def barred(page: Page) -> list[bool]:
    """Whether a node or one above it is marked as no content; marks of both kinds, and a header within an article, say nothing."""
    out, within = [False], [False]
    for k in range(1, len(page.tag)):
        tag, words, up = page.tag[k], page.words[k], page.parent[k]
        within.append(within[up] or tag in LANDMARKS)
        marked = bool(words & BAD) and not words & GOOD or tag in EXCLUDED and not (tag == "header" and within[up])
        out.append(out[up] or marked and tag not in ("html", "body"))
    return out


def labels_of(page: Page) -> np.ndarray | None:
    """States of a page that labels itself by a landmark, else nothing."""
    if not LANDMARKS & set(page.tag):
        return None
    inside, bad = np.zeros(len(page.tag)), barred(page)
    for k in range(1, len(page.tag)):
        inside[k] = (inside[page.parent[k]] > 0 or page.tag[k] in LANDMARKS) and not bad[k]
    return inside


def marginals(page: Page, node: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Content marginal of every node: ``node`` holds log-odds, ``edge[p, c]`` log potentials of parent and child states."""
    n = len(node)
    own = np.stack([np.zeros(n), node], 1)
    up = np.zeros((n, 2))  # message of a node to its parent
    inner = own.copy()
    for k in range(n - 1, 0, -1):
        up[k] = np.logaddexp(edge[:, 0] + inner[k, 0], edge[:, 1] + inner[k, 1])
        up[k] -= up[k].max()
        inner[page.parent[k]] += up[k]
    belief = inner.copy()
    for k in range(1, n):
        rest = belief[page.parent[k]] - up[k]  # the parent without this child
        down = np.logaddexp(edge[0] + rest[0], edge[1] + rest[1])
        belief[k] = inner[k] + down - down.max()
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50)))


#: Potentials before any training: what marking words, links and prose say.
PRIOR = np.array([-1.0, 0.5, -1.0, -2.0, 1.0, 0.5, 0.5, 3.0, -6.0, 2.0, 1.0, 0.0, -0.5, -1.0, 0.5, 0.0])


def train(pages: list[str], steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Node weights (logistic, pulled to ``PRIOR``) and edge log potentials from pages with landmarks."""
    rows, states, together = [], [], np.ones((2, 2)) * 5 + np.eye(2) * 15
    for source in pages:
        page = Page(source)
        y = labels_of(page)
        if y is None:
            continue
        for hide in (False, True):
            rows.append(features(page, hide))
            states.append(y)
        for k in range(1, len(y)):
            together[int(y[page.parent[k]]), int(y[k])] += 1
    together[1, 0] += 0.03 * together[1].sum()  # parts that leave an article are rarer in the sample than on the web
    edge = np.log(together / together.sum()) - np.log(together.sum(1, keepdims=True) / together.sum()) - np.log(together.sum(0, keepdims=True) / together.sum())
    weights = PRIOR.copy()
    if rows:
        x, y = np.concatenate(rows), np.concatenate(states)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            weights += 2.0 * (x.T @ (y - p)) / len(y) - 0.01 * (weights - PRIOR)
    return weights, edge


def main_text(source: str | None, weights: np.ndarray, edge: np.ndarray) -> str:
    page = Page(source or "")
    chance = marginals(page, features(page) @ weights, edge)
    return "\n".join(t for t, p in zip(page.text, chance, strict=True) if t and p >= 0.5)


def extract(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (replaced if there) for their whole ``html``.

    Null, empty or unreadable html has an empty text. Pages are read one by one, so repeated rows give
    equal results; an empty table gives none, and without labelled pages the prior potentials hold.
    """
    columns = [c for c in pages.columns if c not in ("text", "n_chars")]
    sample = pages.select("html").filter(F.col("html").rlike("(?i)<(article|main)[ >]")).orderBy(F.xxhash64("html"), "html").limit(train_pages)
    weights, edge = train([row["html"] for row in sample.collect()])  # at most ``train_pages`` pages

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                batch = big.slice(at, 256)
                texts = [main_text(s, weights, edge) for s in batch.column(batch.schema.get_field_index("html")).to_pylist()]
                extra = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "text", "n_chars"])

    own = pages.select(*[f"`{c}`" for c in columns])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return own.mapInArrow(work, f"{fields}, text string, n_chars bigint")


@query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")

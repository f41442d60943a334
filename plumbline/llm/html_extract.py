"""Main text of web pages by minimum-cut labelling.

A page becomes a list of text blocks. A logistic classifier, fitted on the labelled pages of ``page_samples``, tells how
likely each block is content by where it stands (landmark elements, class and id names), its links and its words; its
log-odds become capacities to the two terminals, content and boilerplate. Blocks next to each other and blocks of one
parent are joined by smoothness edges. The minimum cut between the terminals is the labelling with the least cost; blocks
on the content side make the text.

Before the flow is computed, a block whose terminal capacity is at least that of all its edges is fixed, which leaves
the minimum as it is, and its edges go to its neighbours' terminals; the flow then runs on what is left.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import page_samples
from plumbline.llm._common import attach, slices, text_or_empty

SLICE_BYTES = 4 << 20

#: Labelled pages that the classifier is fitted on, and its ridge.
TRAINING_PAGES = 400
RIDGE = 1.0
#: Log-odds beyond these tell no more.
SUREST = 6.0
FEATURES = ["always", "in content element", "in boilerplate element", "in content class", "in boilerplate class", "boilerplate inside content", "words", "linked", "sentence", "heading", "few words", "list item", "separators", "stock words"]
MOST_WORDS, FEW_WORDS = 40, 4
_SEPARATORS = "|»›·•©"
_STOCK = re.compile(r"\b(cookies?|copyright|rights reserved|subscribe|newsletter|sign up|sign in|log in|privacy|advertisement|sponsored|share|read more|related|terms)\b", re.IGNORECASE)
#: Smoothness.
ADJACENT, SAME_PARENT, ACROSS = 1.0, 0.7, 0.2

_SKIP = "script|style|noscript|template|iframe|select|textarea|title"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({_SKIP})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
#: Elements that start and end a block; all others, also unknown ones, stand in the line.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form head header hgroup hr html h1 h2 h3 h4 h5 h6 legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSED_BY = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_SCOPE = frozenset("body div article section main nav aside footer header table ul ol dl form blockquote figure".split())
_PHRASING_ONLY = "p"
_CONTENT_TAGS = frozenset(("article", "main"))
_BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog head".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMES = re.compile(r"[a-z]+")
_BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu sidebar footer header masthead banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice alert gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies respond related recommended breadcrumb breadcrumbs pagination pager widget toolbar search copyright legal tags skip".split()
)
_CONTENT_NAMES = frozenset("article articlebody content entry post story main maincontent".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())


class Block:
    __slots__ = ("text", "parent", "landmark", "features")

    def __init__(self, text: str, parent: int, landmark: int, features: list[float]):
        self.text, self.parent, self.landmark, self.features = text, parent, landmark, features


def _kind(tag: str, attributes: str) -> tuple[int, bool]:
    """(2 content, -2 boilerplate by tag or role, 1 and -1 by name, 0 neither; whether it isn't shown) of an element."""
    kind = 2 if tag in _CONTENT_TAGS else -2 if tag in _BOILERPLATE_TAGS or tag == "header" else 0
    hidden = False
    if attributes.strip():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
            elif name == "role":
                kind = -2 if value in _BOILERPLATE_ROLES else 2 if value in ("main", "article") else kind
            elif name in ("class", "id", "itemprop") and kind == 0:
                words = set(_NAMES.findall(value))
                kind = -1 if words & _BOILERPLATE_NAMES else 1 if words & _CONTENT_NAMES else 0
    return kind, hidden


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, with their features."""
    out: list[Block] = []
    # open elements: (tag, kind, own number, hidden)
    stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]
    number, links = 0, 0
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked, links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text and not any(e[3] for e in stack):
                out.append(_described(text, min(linked, len(text)), stack))
            pieces.clear()
        linked = links = 0

    def close(at: int) -> None:
        flush()
        del stack[at:]

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in _BLOCKS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] in _SCOPE and tag not in _SCOPE:
                        break
                else:
                    flush()
            continue
        if tag == "a":
            links += 1
        elif tag == "br":
            pieces.append(" ")
        elif tag in _BLOCKS:
            flush()
            if tag in _VOID:
                continue
            ends = _CLOSED_BY.get(tag, "p").split()
            while len(stack) > 1 and (stack[-1][0] in ends or stack[-1][0] == "p"):
                stack.pop()
            number += 1
            kind, hidden = _kind(tag, m[4])
            stack.append((tag, kind, number, hidden))
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return out


def _described(text: str, linked: int, stack) -> Block:
    nearest, landmark, heading, item, outer = 0, 0, False, False, False
    for tag, kind, number, _ in reversed(stack):
        heading |= tag in _HEADINGS
        item |= tag == "li"
        if kind and not landmark:
            nearest, landmark = kind, number
        outer |= kind > 0
    words = text.count(" ") + 1
    marks = sum(text.count(c) for c in _SEPARATORS)
    features = [1, nearest == 2, nearest == -2, nearest == 1, nearest == -1, nearest < 0 and outer, min(words, MOST_WORDS) / MOST_WORDS, linked / len(text), text[-1] in ".!?…。！？\"”»", heading, words < FEW_WORDS, item, min(1.0, marks / words), bool(_STOCK.search(text)) and words < MOST_WORDS]
    return Block(text, stack[-1][2] if stack[-1][0] in _SCOPE else (stack[-2][2] if len(stack) > 1 else 0), landmark, list(map(float, features)))


def fit(pages: list[tuple[str, dict[str, bool]]], ridge: float = RIDGE) -> np.ndarray:
    """Weights of FEATURES from pages and the labels of their blocks' texts (logistic regression, Newton steps)."""
    rows = [(b.features, labels[b.text]) for page, labels in pages for b in blocks_of(page) if b.text in labels]
    x, y = np.array([f for f, _ in rows]), np.array([float(l) for _, l in rows])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return w


@lru_cache
def fitted(pages: int = TRAINING_PAGES) -> tuple[float, ...]:
    return tuple(fit(page_samples.samples(pages)).tolist())


def scores_of(blocks: list[Block], weights: tuple[float, ...]) -> list[float]:
    """Log-odds that each block is content."""
    return [max(-SUREST, min(SUREST, sum(w * f for w, f in zip(weights, b.features, strict=True)))) for b in blocks]


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours in the page, and between one parent's next blocks."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, ADJACENT if b.landmark == blocks[i - 1].landmark else ACROSS))
        if b.parent in last:
            out.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels with the least sum of what positive scores off, negative scores on, and edges between unlike labels cost.

    Ties go to content only where the score itself is positive.
    """
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    scores = list(scores)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(scores[i]) >= sum(near[i].values()):
            label[i] = scores[i] > 0
            for j, w in near[i].items():
                scores[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        side = _flow(left, scores, near)
        for i in left:
            label[i] = i in side
    return label


def _flow(left: list[int], scores: list[float], near: list[dict[int, float]]) -> set[int]:
    """Blocks that the content terminal still reaches after a maximum flow (shortest augmenting paths in layers)."""
    place = {b: k for k, b in enumerate(left)}
    source, sink = len(left), len(left) + 1
    heads: list[list[int]] = [[] for _ in range(sink + 1)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forth)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in left:
        if scores[i] > 0:
            arc(source, place[i], scores[i], 0.0)
        elif scores[i] < 0:
            arc(place[i], sink, -scores[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                arc(place[i], place[j], w, w)
    least = 1e-9
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in heads[a]:
                if room[e] > least and to[e] not in level:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if sink not in level:
            return {b for b in left if place[b] in level}
        at = [0] * (sink + 1)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                amount = min(room[e] for e in path)
                for e in path:
                    room[e] -= amount
                    room[e ^ 1] += amount
                k = next(k for k, e in enumerate(path) if room[e] <= least)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(heads[a]):
                e = heads[a][at[a]]
                if room[e] > least and level.get(to[e]) == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(heads[a]):
                path.append(heads[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def labelled(page: str, weights: tuple[float, ...] | None = None) -> list[tuple[str, float, bool]]:
    """(text, log-odds, whether the cut calls it content) of a page's blocks."""
    blocks = blocks_of(page)
    scores = scores_of(blocks, weights or fitted())
    return [(b.text, x, stays) for b, x, stays in zip(blocks, scores, minimum_cut(scores, edges_of(blocks)), strict=True)]


def main_text(page: str, weights: tuple[float, ...] | None = None) -> str:
    return "\n\n".join(text for text, _, stays in labelled(page, weights) if stays)


def _extract(batches: Iterator[pa.RecordBatch], weights: tuple[float, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html", SLICE_BYTES):
            texts = [main_text(x, weights) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The classifier is fitted on ``training_pages`` labelled sample pages. A null html is empty, and its text too; null ids
    and urls stay null; broken markup is read as far as it goes; pages are read whole, however long; repeated rows give
    repeated results; an empty table gives none; further columns are ignored.
    """
    attach(pages.sparkSession)
    return pages.select("page_id", "url", text_or_empty("html").alias("html")).mapInArrow(partial(_extract, weights=fitted(training_pages)), "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extract the main text of all pages."""
    return extract_text(attach(spark).read.parquet(f"{sf_dir}/pages.parquet"))

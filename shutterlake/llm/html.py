"""Main-text extraction by minimum cut.

A page is cut into text blocks. A logistic model gives each block a probability
of being content; its costs are the capacities to the two terminals. Blocks that
follow one another, and consecutive children of one element, are joined by
smoothness edges that weaken with distance in the element tree. The minimum cut
of this graph is the labelling of least total cost; the blocks on the source's
side are the text.

The model's weights for what a block looks like (words, links, punctuation) are
fitted on the blocks of a bounded sample of pages whose markup says what they
are; the markup itself (``article``, ``nav``, class names) enters as a fixed
cost that a block's looks can outweigh, but for menus, footers and readers'
comments. A nested article or main is content
whatever lies around it; only what is hidden is left out for good. Pages are handled one by one; memory is bounded by the longest page.

Rows: null or empty html, or a page without content, gives an empty text.
Markup may be cut off or unclosed anywhere. Repeated rows and null ids are
handled alike; further columns stay.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shutterlake.llm.common import hash_sample, small_batches

#: Pages that the model is fitted on, chosen by the hash of their id.
SAMPLE = 512
#: Smoothness between neighbours at distance 0, and how it falls with each step in the tree.
SMOOTH, FADE = 0.6, 0.6
#: Fixed costs (log-odds of content) of markup: a block's looks can outweigh them, but for what is a menu, a footer or readers' comments.
SAYS_CONTENT, SAYS_OTHER, SAYS_NEVER, OUTSIDE = 2.5, -2.5, -8.0, -1.5
HIDDEN, NEVER = -2, -3

# Element names and class words with a meaning.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template textarea select title head svg math iframe object video audio canvas button datalist option".split())
OTHER_TAGS = frozenset("nav footer aside form header menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
#: Elements and class words that no looks outweigh.
NEVER_TAGS, NEVER_WORDS = frozenset("nav footer".split()), frozenset("comment comments reply replies respond".split())
OTHER_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar cookie cookies consent gdpr notice notices alert comment comments reply replies respond share sharing social related recommended subscribe newsletter signup popup modal overlay login search widget pagination pager copyright disclaimer toolbar".split())
CONTENT_WORDS = frozenset("article content entry story post main".split())
#: Words that make a name a state or a layout: no-sidebar, comments-open.
STATE_WORDS = frozenset("no not non has have with without is open opened close closed on off enabled disabled".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)", re.S)
#: The end tag of an element, and the start of the body; with ASCII letters only, so that places are those of the page.
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I | re.A) for tag in DROPPED}
_BODY = re.compile(r"<body(?=[\s/>]|\Z)", re.I | re.A)
_CLASS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


class Block:
    """Text of one block, where it stands in the tree, and what the markup says of it."""

    __slots__ = ("text", "linked", "depth", "shared", "parent", "tag", "cue", "heading")

    def __init__(self, text: str, linked: int, depth: int, shared: int, parent: int, tag: str, cue: int) -> None:
        """``depth`` elements are around the block, ``shared`` of them around the one before too; ``parent`` is the last but one."""
        self.text, self.linked, self.depth, self.shared, self.parent, self.tag, self.cue = text, linked, depth, shared, parent, tag, cue
        self.heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")


def _named(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role names content, and whether they name something else.

    A compound name of a state, or with words of both kinds, names neither.
    """
    content = other = False
    for value in _CLASS.findall(attributes):
        for name in value.lower().split():
            words = set(_WORD.findall(name))
            if not words & STATE_WORDS:
                good, bad = not words.isdisjoint(CONTENT_WORDS), not words.isdisjoint(OTHER_WORDS)
                content, other = content or good > bad, other or bad > good
    return content, other


def _cue(tag: str, attributes: str, outer: int) -> int:
    """1 content, -1 other, NEVER other whatever it looks like, 0 not told, HIDDEN for good; content inside other is told anew."""
    if outer == HIDDEN or (attributes and _HIDDEN.search(attributes)):
        return HIDDEN
    if tag in ("html", "body"):
        return outer
    content, other = _named(attributes) if attributes else (False, False)
    # a form around a whole page tells nothing, nor does a header within content
    told = tag in OTHER_TAGS and not (tag == "header" and outer > 0) and not (tag == "form" and outer <= 0)
    if told or (other and not content):
        never = outer == NEVER or tag in NEVER_TAGS or any(not NEVER_WORDS.isdisjoint(_WORD.findall(v.lower())) for v in _CLASS.findall(attributes))
        return NEVER if never else -1
    if tag in CONTENT_TAGS:
        return 1
    if content and not other:
        # a content word alone does not make a footer's inside content
        return 1 if outer >= 0 else 0
    return outer


def blocks_of(page: str) -> list[Block]:
    """The non-empty text blocks of a page, in order."""
    blocks: list[Block] = []
    # an open element: name, its number, what the markup says
    stack: list[tuple[str, int, int]] = []
    text: list[str] = []
    # open elements that are not inline, and the fewest of them since the last block
    outer: list[tuple[str, int]] = []
    linked, links, number, at, least = 0, 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, least
        if text:
            joined = " ".join("".join(text).split())
            if joined and not (stack and stack[-1][2] == HIDDEN):
                blocks.append(Block(joined, linked, len(outer), least, outer[-2][1] if len(outer) > 1 else 0, outer[-1][0] if outer else "", stack[-1][2] if stack else 0))
                least = len(outer)
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            said = entities.unescape(raw) if "&" in raw else raw
            text.append(said)
            if links:
                linked += len(said.strip())

    def close(upto: int) -> None:
        nonlocal links, least
        for name, _, _ in stack[upto:]:
            links -= name == "a"
            if name not in INLINE:
                outer.pop()
        least = min(least, len(outer))
        del stack[upto:]

    size = len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        add(page[at : token.start()])
        at = token.end()
        if not token[2]:
            continue
        tag, ending = token[2].lower(), bool(token[1])
        if ending:
            if tag not in INLINE:
                flush()
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            # an inline end tag does not close the blocks around it
            if found is not None and (tag not in INLINE or all(x[0] in INLINE for x in stack[found:])):
                close(found)
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in DROPPED:
            if tag not in INLINE:
                flush()
            if not token[3].endswith("/"):
                # a head that is never closed ends where the body starts, or else at once
                end = _END[tag].search(page, at)
                body = _BODY.search(page, at) if tag == "head" else None
                if body and (not end or body.start() < end.start()):
                    at = body.start()
                elif end:
                    stop = page.find(">", end.end())
                    at = size if stop < 0 else stop + 1
                elif tag != "head":
                    at = size if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P or tag == "li":
                wanted = "li" if tag == "li" else "p"
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == wanted:
                        close(i)
                        break
                    if stack[i][0] not in INLINE and stack[i][0] != "p":
                        break
        if tag in VOID or token[3].endswith("/"):
            continue
        number += 1
        stack.append((tag, number, _cue(tag, token[3], stack[-1][2] if stack else 0)))
        if tag not in INLINE:
            outer.append((tag, number))
        links += tag == "a"
    flush()
    return blocks


def features(block: Block) -> list[float]:
    """What a block looks like."""
    words, size = block.text.count(" ") + 1, len(block.text)
    return [1.0, min(np.log1p(words), 6.0), min(1.0, block.linked / size), min(1.0, 10 * len(_PUNCTUATION.findall(block.text)) / size), float(block.heading), float(block.tag in ("p", "blockquote", "pre")), float(block.tag in ("li", "td", "th"))]


#: Used where a sample has no page whose markup tells both kinds apart.
DEFAULT_WEIGHTS = np.array([-2.0, 0.8, -3.0, 1.0, 0.5, 1.0, -0.5])


def learn(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample: int = SAMPLE) -> np.ndarray:
    """Weights of :func:`features`, by ridge logistic regression on blocks of about ``sample`` pages."""
    small_batches(pages.sparkSession)
    chosen = hash_sample(pages.select(page_id, html).where(F.col(html).isNotNull()), page_id, sample)

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(float(b.cue > 0), *features(b)) for page in batch[html] for b in blocks_of(page) if b.cue]
            sums: dict[tuple, int] = {}
            for row in rows:
                key = tuple(round(x, 1) for x in row)
                sums[key] = sums.get(key, 0) + 1
            yield pd.DataFrame([[*k, n] for k, n in sums.items()], columns=["y", *[f"x{i}" for i in range(7)], "n"]).astype("float64")

    schema = "y double, " + ", ".join(f"x{i} double" for i in range(7)) + ", n double"
    seen = chosen.mapInPandas(examples, schema).toPandas()
    if seen.empty or seen["y"].nunique() < 2:
        return DEFAULT_WEIGHTS
    seen = seen.groupby([*seen.columns[:-1]], as_index=False, sort=True)["n"].sum()
    x, y, n = seen[[f"x{i}" for i in range(7)]].to_numpy(), seen["y"].to_numpy(), seen["n"].to_numpy()
    # either kind weighs the same, so that the sample's mix of blocks does not tell
    n = n / np.where(y > 0, n[y > 0].sum(), n[y == 0].sum()) * 1000
    w = np.zeros(7)
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(7)
        w = w + np.linalg.solve(hessian, x.T @ (n * (y - p)) - w)
    return w


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; ``edges`` have their capacity both ways.

    Each node's direct flow from source to sink is sent first, so only what is
    left over has to find its way, from all such nodes at once: a breadth-first
    search gives distances, and flow goes along edges that lead away until none
    of these paths is left; what the last search reaches stays with the source.
    """
    n = len(source)
    left = [source[i] - sink[i] for i in range(n)]
    near: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, capacity in edges:
        near[a].append(len(to))
        to.append(b)
        room.append(capacity)
        near[b].append(len(to))
        to.append(a)
        room.append(capacity)
    tiny = 1e-9
    while True:
        level, found = [-1] * n, False
        queue = deque(i for i in range(n) if left[i] > tiny)
        starts = list(queue)
        for i in starts:
            level[i] = 0
        while queue:
            for e in near[i := queue.popleft()]:
                if room[e] > tiny and level[j := to[e]] < 0:
                    level[j] = level[i] + 1
                    found = found or left[j] < -tiny
                    queue.append(j)
        if not found:
            return [x >= 0 for x in level]
        tried = [0] * n
        for start in starts:
            path: list[int] = []
            i = start
            while left[start] > tiny:
                if left[i] < -tiny:
                    flow = min(left[start], -left[i], min(room[e] for e in path))
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    left[start] -= flow
                    left[i] += flow
                    # go on from before the first edge that is full
                    full = next((k for k, e in enumerate(path) if room[e] <= tiny), len(path))
                    del path[full:]
                    i = to[path[-1]] if path else start
                    continue
                while tried[i] < len(near[i]) and not (room[e := near[i][tried[i]]] > tiny and level[to[e]] == level[i] + 1):
                    tried[i] += 1
                if tried[i] < len(near[i]):
                    path.append(near[i][tried[i]])
                    i = to[path[-1]]
                elif path:
                    i = to[path.pop() ^ 1]
                    tried[i] += 1
                else:
                    break


def _edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Neighbours in page order, and consecutive children of one element with others between them."""
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SMOOTH * FADE ** max(0, blocks[i - 1].depth + block.depth - 2 * block.shared - 2)))
        if last.get(block.parent, i) < i - 1:
            edges.append((last[block.parent], i, SMOOTH * FADE))
        last[block.parent] = i
    return edges


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The text of the blocks that the minimum cut leaves with the content."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    told = any(b.cue > 0 for b in blocks)
    score = np.array([features(b) for b in blocks]) @ weights
    score = score + np.array([SAYS_CONTENT if b.cue > 0 else SAYS_NEVER if b.cue == NEVER else SAYS_OTHER if b.cue < 0 else OUTSIDE if told else 0.0 for b in blocks])
    # costs -log P: log(1 + e^s) for calling a block other, log(1 + e^-s) for calling it content
    kept = minimum_cut(np.logaddexp(0, score).tolist(), np.logaddexp(0, -score).tolist(), _edges(blocks))
    return " ".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract(pages: DataFrame, weights: np.ndarray, html: str = "html") -> DataFrame:
    """``pages`` with ``html`` replaced by ``text``, and ``n_chars``, its code points."""
    keep = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    inner = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(keep)]

    @F.pandas_udf(T.StringType())
    def text_of(values: pd.Series) -> pd.Series:
        return values.map(lambda page: main_text(page if isinstance(page, str) else None, weights))

    cut = pages.select(*[F.col(f"`{f.name}`").alias(c.name) for f, c in zip(keep, inner, strict=True)], text_of(F.col(f"`{html}`")).alias("text"))
    return cut.select(*[F.col(c.name).alias(f.name) for f, c in zip(keep, inner, strict=True)], "text", F.length("text").cast("long").alias("n_chars"))

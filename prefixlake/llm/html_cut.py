"""Main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks. A logistic classifier looks at a block's text and at what
stands around it (length, link share, punctuation, neighbours, how much of the page's prose its parent
holds); to its log odds come fixed ones for what the markup says: an element such as nav, a name such
as "cookie-notice", an article element. The sum turns into the cost of calling the block content or
boilerplate, the capacities of its two terminal edges. Smoothness edges join neighbours in page order
and blocks next to each other under one parent, weaker the farther apart they are in the element tree.
The minimum cut labels the page: blocks on the source side are content.

Blocks whose terminal costs differ by more than all their smoothness edges keep the cheaper label
in every minimum cut; they are settled first, and the flow runs over what is left.

The classifier is trained on all blocks of a bounded sample of pages (the at most SAMPLE_PAGES with
the smallest hash of id and page) that have an article or main element: what stands in one and in
nothing that is named as boilerplate is content, everything else on these pages is boilerplate. What
gives the label is no feature. Weights are held to the PRIOR, so that a sample with one layout cannot
unteach what it does not show; without a page of both kinds the PRIOR stays.

A class or id says boilerplate only as a whole: each of its words must be a boilerplate or a layout
word ("related-posts", not "related-work"), and words of a taxonomy ("tag-privacy") say nothing.

Defined results: null and empty html have an empty text; the head of a page is not text; what
follows an unclosed comment or script belongs to it; a tag cut off by the end of the page is
markup; a line break is white space. Pages are read whole, however long; a block keeps the number of
its element, not its path, so deep pages take no more memory than flat ones. Repeated rows are decided
one by one and alike. Extra columns pass through; a column with the name of a result is replaced. An
empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefixlake.llm.common import spread, stored

SAMPLE_PAGES = 2000
#: Capacity of an edge between neighbours under one parent, in the log odds of the terminal costs; halved per step of distance in the tree.
SMOOTH = 2.0
#: Log odds of what the markup says: boilerplate element, boilerplate name, article or main element, name of one.
BOILER_TAG, BOILER_NAME, MAIN_TAG, MAIN_NAME = -12.0, -9.0, 8.0, 2.0
#: The text alone says no more than this.
TEXT_LIMIT = 5.0
EPOCHS, RIDGE = 25, 0.02

# Element names and words in class and id attributes.
BOILER_TAGS = frozenset("nav footer aside form menu dialog button select option fieldset label".split())
MAIN_TAGS = frozenset("article main".split())
DROP_TAGS = frozenset("head script style noscript template svg math iframe object canvas audio video textarea".split())
RAW_TAGS = "script|style|noscript|template|svg|iframe|object|canvas|textarea|title"
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE_TAGS = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts adbox banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer footnav header login masthead menu modal nav navbar navigation newsletter notice notification "
    "pager pagination popup privacy promo promotion promoted recommended related replies reply respond search share sharing shoutbox sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget".split()
)
#: A name that begins with or holds one of these says what is around or what the text is about, not what the element is.
ABOUT_WORDS = frozenset("has no not with without is tag category cat term topic author format status type keyword subject".split())
NEUTRAL_WORDS = frozenset(
    "above area articles bar below block body bottom box btn button card cell center col column container content entries entry fixed footer form global group head header heading hidden holder icon inner item items layer left line link links list "
    "local main meta mobile module news overlay page pane panel post posts primary right row secondary section site small stories story sticky text thread title top unit wrap wrapper".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main maincontent post postbody story text".split())
NOTICE_WORDS = tuple("\u00a9|copyright|all rights reserved|cookie|privacy policy|terms of|subscribe|newsletter|sign up|log in|advertisement|sponsored|share this|leave a reply|read more".split("|"))
#: Weights of the text: bias, link share, length, punctuation, heading, list, paragraph, neighbours' length, neighbours' link share, prose of the parent, its share of the page's, short notice.
PRIOR = np.array([-2.6, -4.0, 2.2, 1.0, 0.4, -0.6, 1.0, 0.8, -1.0, 0.6, 1.2, -3.5])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW_TAGS + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    link: int  # characters inside links
    node: int  # number of the element it stands in, inline ones aside
    parent: int
    depth: int
    kind: str
    boiler_tag: bool
    boiler_name: bool
    main_tag: bool
    main_name: bool
    heading: bool
    listed: bool

    @property
    def boiler(self) -> bool:
        return self.boiler_tag or self.boiler_name


def _named(attributes: str) -> tuple[bool, bool]:
    """Whether the names of an element say boilerplate, and whether they say main text."""
    boiler = main = False
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = _PART.findall(_CAMEL.sub(" ", name).lower())
            if not parts or ABOUT_WORDS.intersection(parts):
                continue
            if BOILER_WORDS.intersection(parts):
                boiler |= all(p in BOILER_WORDS or p in NEUTRAL_WORDS or len(p) < 3 for p in parts)
            elif MAIN_WORDS.intersection(parts):
                main |= all(p in MAIN_WORDS or p in NEUTRAL_WORDS for p in parts)
    return boiler, main


def blocks_of(page: str) -> tuple[list[Block], dict[int, int]]:
    """Text blocks of a page, in page order, and the parent of each element that is not inline."""
    up: dict[int, int] = {0: -1}
    out: list[Block] = []
    # an open element: name, number, parent, depth and name of the last that is not inline, then what it and its ancestors say
    stack: list[tuple] = [("", 0, -1, 0, "", False, False, False, False, False, False)]
    number, parts, links, in_link, dropped = 0, [], 0, 0, 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                out.append(Block(text, min(links, len(text)), *top[1:]))
            parts, links = [], 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not dropped:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                links += len(text)

    def pop(to: int) -> None:
        nonlocal in_link, dropped
        while len(stack) > to:
            name = stack.pop()[0]
            in_link -= name == "a"
            dropped -= name in DROP_TAGS

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        inline = name in INLINE_TAGS
        if name in VOID_TAGS:
            if not inline:
                flush()
            elif name == "br" and not dropped:
                parts.append(" ")
            continue
        if not inline:
            flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    pop(i)
                    break
                if inline and stack[i][0] not in INLINE_TAGS:  # stray end of an inline element
                    break
            continue
        if not inline:  # an open paragraph, item or row ends where the next block begins
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or stack[i][0] in closes:
                    pop(i)
                    break
                if stack[i][0] not in INLINE_TAGS:
                    break
        if attributes.endswith("/") and inline:
            continue
        number += 1
        top = stack[-1]
        boiler, main = _named(attributes) if "=" in attributes and name not in ("html", "body") else (False, False)
        tag, named, in_main, main_name, heading, listed = top[5:]
        if not inline:
            up[number] = top[1]
        place = top[1:5] if inline else (number, top[1], top[3] + 1, name)
        stack.append((
            name, *place, tag or name in BOILER_TAGS or (name == "header" and not in_main), named or (boiler and name not in MAIN_TAGS), in_main or name in MAIN_TAGS,
            main_name or main, heading or name in HEADINGS, listed or name in ("ul", "ol", "dl", "menu"),
        ))
        in_link += name == "a"
        dropped += name in DROP_TAGS
        if name == "body" and dropped:  # a head that was never closed ends here
            kept = [e for e in stack if e[0] not in DROP_TAGS]
            stack[:] = kept
            dropped = 0
    add(page[at:])
    flush()
    return out, up


def features(blocks: list[Block]) -> np.ndarray:
    """What the texts and their places say, names and kinds of elements that give labels aside."""
    size = np.array([len(b.text) for b in blocks], dtype=float)
    link = np.array([b.link for b in blocks], dtype=float) / np.maximum(size, 1)
    length = np.minimum(1.0, np.log1p(size) / 7)
    prose = size * (1 - link)
    _, parent = np.unique([b.parent for b in blocks], return_inverse=True)
    held = np.bincount(parent, prose)[parent] if len(blocks) else prose

    def around(x: np.ndarray) -> np.ndarray:
        ends = np.concatenate([[0.0], x, [0.0]])
        count = np.concatenate([[0.0], np.ones(len(x)), [0.0]])
        return (ends[:-2] + ends[2:]) / np.maximum(count[:-2] + count[2:], 1)

    own = [
        (min(1.0, 8 * sum(map(b.text.count, ".,;:!?")) / (1 + b.text.count(" "))), b.heading, b.listed, b.kind in ("p", "blockquote", "pre"), len(b.text) < 200 and any(w in b.text.lower() for w in NOTICE_WORDS))
        for b in blocks
    ]
    punctuation, heading, listed, paragraph, notice = np.array(own, dtype=float).reshape(len(own), 5).T
    columns = [np.ones(len(blocks)), link, length, punctuation, heading, listed, paragraph, around(length * (1 - link)), around(link), np.minimum(1.0, np.log1p(held) / 9), held / max(prose.sum(), 1.0), notice]
    return np.stack(columns, axis=1)


def labels(blocks: list[Block]) -> np.ndarray | None:
    """1 content, 0 boilerplate, of a page that tells both apart; None of another."""
    y = np.array([b.main_tag and not b.boiler for b in blocks], dtype=float)
    return y if y.any() else None


def log_odds(blocks: list[Block], weights: np.ndarray) -> np.ndarray:
    """For and against content: the text, and what the markup says."""
    told = [
        (BOILER_TAG if b.boiler_tag else 0.0) + (BOILER_NAME if b.boiler_name else 0.0) + (0.0 if b.boiler else (MAIN_TAG if b.main_tag else 0.0) + (MAIN_NAME if b.main_name else 0.0))
        for b in blocks
    ]
    return np.clip(features(blocks) @ weights, -TEXT_LIMIT, TEXT_LIMIT) + np.array(told)


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the blocks of one kind: gradient and Hessian of the loss, summed."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x


def edges_of(blocks: list[Block], up: dict[int, int]) -> list[tuple[int, int, float]]:
    """Smoothness edges: page order, and the next block under the same parent. ``up`` names the parent of each element."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            x, y, dx, dy, steps = a.node, b.node, a.depth, b.depth, 0
            while x != y and steps < 16:  # farther apart the capacity is nearly nothing
                if dx >= dy:
                    x, dx = up[x], dx - 1
                else:
                    y, dy = up[y], dy - 1
                steps += 1
            out.append((i - 1, i, SMOOTH * 0.5 ** max(0, steps - 2)))
        if b.parent in last and last[b.parent] != i - 1:
            out.append((last[b.parent], i, SMOOTH / 2))
        last[b.parent] = i
    return out


def minimum_cut(content: np.ndarray, boiler: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels (1 content) of least total cost: ``content``/``boiler`` per block, plus each cut edge.

    Of several minimum cuts, the one with the fewest content blocks.
    """
    n = len(content)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
    excess = boiler - content  # above 0: content is cheaper
    label = np.full(n, -1)
    todo = deque(range(n))
    while todo:  # settle what no neighbour can outweigh; a settled neighbour's edge becomes a terminal cost
        i = todo.popleft()
        if label[i] >= 0:
            continue
        loose = sum(c for j, c in near[i] if label[j] < 0)
        if abs(excess[i]) <= loose:
            continue
        label[i] = int(excess[i] > 0)
        for j, c in near[i]:
            if label[j] < 0:
                excess[j] += c if label[i] else -c
                todo.append(j)
    rest = np.flatnonzero(label < 0)
    if len(rest):
        label[rest] = _flow(rest, excess, near, label)
    return label


def _flow(rest: np.ndarray, excess: np.ndarray, near: list[list[tuple[int, float]]], label: np.ndarray) -> list[int]:
    """Shortest augmenting paths from content terminal to boilerplate terminal among ``rest``."""
    place = {int(b): k for k, b in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    capacity: list[dict[int, float]] = [{} for _ in range(len(rest) + 2)]
    for b, k in place.items():
        if excess[b] > 0:
            capacity[source][k] = excess[b]
            capacity[k].setdefault(source, 0.0)
        elif excess[b] < 0:
            capacity[k][sink] = -excess[b]
            capacity[sink].setdefault(k, 0.0)
        for j, c in near[b]:
            if label[j] < 0:
                capacity[k][place[j]] = capacity[k].get(place[j], 0.0) + c
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, c in capacity[a].items():
                if c > 1e-12 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            return [int(k in came) for k in range(len(rest))]
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        least = min(capacity[a][b] for a, b in path)
        for a, b in path:
            capacity[a][b] -= least
            capacity[b][a] = capacity[b].get(a, 0.0) + least


def label_blocks(blocks: list[Block], up: dict[int, int], weights: np.ndarray) -> np.ndarray:
    z = log_odds(blocks, weights)
    return minimum_cut(np.logaddexp(0, -z), np.logaddexp(0, z), edges_of(blocks, up))


def main_text(page: str, weights: np.ndarray) -> tuple[str, int, int]:
    """Text, number of blocks, number of content blocks."""
    blocks, up = blocks_of(page)
    if not blocks:
        return "", 0, 0
    label = label_blocks(blocks, up, weights)
    kept = [b.text for b, x in zip(blocks, label, strict=True) if x == 1]
    return "\n\n".join(kept), len(blocks), len(kept)


def fit(pages: DataFrame, column: str = "html", row_id: str = "page_id", rows: int = SAMPLE_PAGES) -> np.ndarray:
    """Train on all blocks of the sampled pages: Newton steps whose sums are worked out where the pages are.

    The sample is found among hashes alone; pages as such are read for its members only. Rows that are
    equal in id and page share a hash and are taken together.
    """
    order = F.xxhash64(F.lit("sample"), F.col(row_id).cast("string"), F.col(column))
    hashed = pages.filter(F.col(column).isNotNull())
    limit = hashed.select(order.alias("o")).distinct().orderBy("o").limit(rows).agg(F.max("o")).first()[0]
    if limit is None:
        return PRIOR.copy()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for page in batch.column(0).to_pylist():
                blocks, _ = blocks_of(page)
                y = labels(blocks)
                if y is not None:
                    xs.append(features(blocks).tobytes())
                    ys.append(y.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["x", "y"])

    sample = stored(hashed.filter(order <= limit).select(column).mapInArrow(read, "x binary, y binary").repartition(spread(pages, 1)))
    width = len(PRIOR)

    def step(w: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grad, curve, many = np.zeros((2, width)), np.zeros((2, width, width)), np.zeros(2)
            for batch in batches:
                for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    x, y = np.frombuffer(x).reshape(-1, width), np.frombuffer(y)
                    for side in (0, 1):
                        g, h = _sums(x[y == side], y[y == side], w)
                        grad[side] += g
                        curve[side] += h
                        many[side] += (y == side).sum()
            flat = np.concatenate([many, grad.ravel(), curve.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([flat.tolist()], pa.list_(pa.float64()))], names=["s"])

        return run

    w = PRIOR.copy()
    for _ in range(EPOCHS):
        # a few hundred numbers of each task, summed in one order
        parts = sorted(tuple(r["s"]) for r in sample.mapInArrow(step(w), "s array<double>").collect())
        total = np.sum(np.array(parts, dtype=float).reshape(len(parts), -1), axis=0) if parts else np.zeros(2)
        if not total[:2].all():
            return PRIOR.copy()
        many, grad, curve = total[:2], total[2 : 2 + 2 * width].reshape(2, width), total[2 + 2 * width :].reshape(2, width, width)
        share = 0.5 / many  # both kinds weigh the same
        move = np.linalg.solve(np.tensordot(share, curve, 1) + RIDGE * np.eye(width), share @ grad + RIDGE * (w - PRIOR))
        w = w - move
        if abs(move).max() < 1e-6:
            break
    return w


def extract(pages: DataFrame, weights: np.ndarray, column: str = "html") -> DataFrame:
    """``pages`` with text, n_chars, n_blocks, n_content."""
    results = ["text", "n_chars", "n_blocks", "n_content"]
    base = pages.drop(*results)
    kinds = [T.StringType(), T.LongType(), T.IntegerType(), T.IntegerType()]
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, k) for n, k in zip(results, kinds, strict=True)]])
    shared = pages.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(h or "", shared.value) for h in batch.column(column).to_pylist()]
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), *[pa.array([g[i] for g in got], pa.int32()) for i in (1, 2)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *results])

    return base.mapInArrow(run, schema)

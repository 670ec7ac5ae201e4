"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A classifier gives each block a cost for being content and one
for being boilerplate; these are the capacities of its edges to the two terminals. Neighbouring
blocks, and blocks of one parent, are joined by edges that make it costly to label them apart.
The minimum cut is the labelling of least total cost.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daydigest.llm.common import bounded_batches

# Pages the classifier is fitted on at most, the first by hash of the url and the page; whole pages.
TRAIN_PAGES = 400
# Strength of the prior weights in the fit, and of the edges between blocks.
PRIOR = 200.0
SAME_PARENT = 1.2
NEIGHBOUR = 1.0
MOST_COST = 8.0
SCALE = 1000

# Elements whose text is never shown, or is no text of the page. What stands in the raw ones is no markup, so
# without an end tag they go on to the end of the page.
RAW = frozenset("script style noscript template title textarea iframe".split())
SILENT_BOXES = frozenset("svg math object canvas audio video select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
# An element that ends an open one of these kinds, as end tags may be left out.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"},
}
# Where the search for an open element to end stops.
SCOPES = frozenset("ul ol dl table body html div article section main nav aside footer header form".split())
BOILER_TAGS = frozenset("nav footer aside form header menu button dialog fieldset".split())
LEAVES = frozenset("p li td th dt dd h1 h2 h3 h4 h5 h6 pre blockquote figcaption caption label address summary".split())
CONTENT_TAGS = frozenset("article main".split())
BLOCKS = LEAVES | SCOPES | BOILER_TAGS | CONTENT_TAGS
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer "
    "foot header masthead topbar toolbar share sharing social follow related recommended more widget comment comments "
    "commentlist reply replies respond disqus login signin signup register subscribe subscription newsletter search "
    "pagination pager tags copyright legal disclaimer skip contentinfo complementary".split()
)
CONTENT_WORDS = frozenset("article content post entry story body text main maincontent articlebody postbody".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</([a-zA-Z][^\s>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>",
    re.S,
)
END_TAGS = {tag: re.compile(f"</{tag}[^>]*(?:>|\\Z)", re.I) for tag in RAW}
BOX = re.compile(rf"<(?:{'|'.join(sorted(SILENT_BOXES))})[\s/>]", re.I)
UNENDED = re.compile(r"<[a-zA-Z/!?]")
NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]*")
# A class that starts so tells a state of the page, not what the element is.
STATES = ("has-", "with-", "no-", "is-", "without-", "js-")
SENTENCE_ENDS = frozenset(".!?…:;。！？\"'”’»")


def region(tag: str, attributes: str, inside: bool) -> tuple[int, int, int, int]:
    """(boilerplate tag, boilerplate name, content tag, content name) of an element, 0 or 1;
    ``inside`` an article a header is that of the article."""
    tokens = [x for m in NAMES.findall(attributes) for x in m.strip("\"'").split()] if attributes else []
    names = {p.lower() for x in tokens if not x.lower().startswith(STATES) for p in PARTS.findall(x)}
    if inside:
        names.discard("header")
    hidden = bool(attributes) and HIDDEN.search(attributes) is not None
    named = tag not in ("html", "body") and not names.isdisjoint(BOILER_WORDS)
    return (
        int(tag in BOILER_TAGS and not (inside and tag == "header")),
        int(hidden or named),
        int(tag in CONTENT_TAGS),
        int(not names.isdisjoint(CONTENT_WORDS)),
    )


def tag_of(token: re.Match) -> tuple[str, str]:
    """The name of a start tag in lower case, or nothing, and its attributes."""
    return ((token[1] or token[4]).lower(), token[2] if token[1] else token[5]) if token[1] or token[4] else ("", "")


def behind_raw(html: str, tag: str, at: int) -> int:
    close = END_TAGS[tag].search(html, at)
    return close.end() if close else len(html)


def silent_ends(html: str, limit: int) -> dict[int, int]:
    """Where the silence of each box that begins at some place ends: behind its own end tag; without one,
    where its parent ends or, before that, where a block of text begins."""
    ends: dict[int, int] = {}
    # open elements: (tag, where it begins); boxes of them that have met no block yet, and the blocks others met
    stack: list[tuple[str, int]] = []
    waiting: list[int] = []
    met: dict[int, int] = {}

    def unended(at: int, place: int) -> None:
        ends[at] = met.get(at, place)

    token = TOKEN.search(html, 0, limit)
    while token:
        at = token.end()
        tag, attributes = tag_of(token)
        if tag and not attributes.rstrip().endswith("/"):
            if tag in RAW:
                at = behind_raw(html, tag, at)
            elif tag not in VOID:
                if tag in BLOCKS and waiting:
                    met.update(dict.fromkeys(waiting, token.start()))
                    waiting.clear()
                stack.append((tag, token.start()))
                if tag in SILENT_BOXES:
                    waiting.append(token.start())
        elif token[3]:
            tag = token[3].lower()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for name, begin in stack[i + 1 :]:
                        if name in SILENT_BOXES:
                            unended(begin, token.start())
                    if tag in SILENT_BOXES:
                        ends[stack[i][1]] = token.end()
                    while waiting and waiting[-1] >= stack[i][1]:
                        waiting.pop()
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] in BLOCKS:
                    break
        token = TOKEN.search(html, at, limit) if at < limit else None
    for name, begin in stack:
        if name in SILENT_BOXES:
            unended(begin, len(html))
    return ends


class Block:
    """A run of text without a block border in it, and where it stands."""

    __slots__ = ("text", "linked", "tag", "parent", "depth", "marks")

    def __init__(self, text, linked, tag, parent, depth, marks):
        self.text, self.linked, self.tag, self.parent, self.depth, self.marks = text, linked, tag, parent, depth, marks


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order. Character references are decoded, white space is one space."""
    found: list[Block] = []
    # open elements: (tag, number, marks summed over the path, in a link, block depth)
    stack = [("", 0, (0, 0, 0, 0), False)]
    pieces: list[str] = []
    linked = 0
    number = 0
    known: dict[tuple[str, str, bool], tuple[int, int, int, int]] = {}

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                at = len(stack) - 1
                while at and stack[at][0] in INLINE:
                    at -= 1
                tag = stack[at][0]
                # text that stands in a container itself is beside the container's children
                parent = stack[at - 1][1] if at and tag in LEAVES else stack[at][1]
                found.append(Block(text, linked, tag, parent, at, stack[at][2]))
            pieces.clear()
        linked = 0

    def say(start: int, end: int):
        nonlocal linked
        if start < end:
            text = html[start:end]
            if "&" in text:
                text = unescape(text)
            pieces.append(text)
            if stack[-1][3]:
                linked += len(text) - text.count(" ")

    at = 0
    # behind the last ">" no tag ends; one that begins there is no text
    limit = html.rfind(">") + 1
    open_tag = UNENDED.search(html, limit)
    silent = silent_ends(html, limit) if BOX.search(html, 0, limit) else {}
    token = TOKEN.search(html, 0, limit)
    while token:
        say(at, token.start())
        at = token.end()
        tag, attributes = tag_of(token)
        if tag:
            if tag in RAW and not attributes.rstrip().endswith("/"):
                at = behind_raw(html, tag, at)
            elif tag in SILENT_BOXES:
                at = silent.get(token.start(), at)
            elif tag in VOID:
                if tag in ("br", "hr"):
                    flush()
            else:
                if tag not in INLINE:
                    flush()
                    if tag == "p" or (tag not in ENDS and stack[-1][0] == "p") or tag in HEADINGS:
                        close_open(stack, {"p"} | HEADINGS if tag in HEADINGS else {"p"})
                    elif tag in ENDS:
                        close_open(stack, ENDS[tag])
                _, _, marks, link = stack[-1]
                number += 1
                key = (tag, attributes, marks[2] > 0)
                here = known.get(key)
                if here is None:
                    here = known[key] = region(*key)
                stack.append(
                    (tag, number, (marks[0] + here[0], marks[1] + here[1], marks[2] + here[2], marks[3] + here[3]), link or tag == "a")
                )
        elif token[3]:
            tag = token[3].lower()
            if tag not in INLINE:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
        token = TOKEN.search(html, at, limit) if at < limit else None
    say(at, open_tag.start() if open_tag else len(html))
    flush()
    return found


def close_open(stack: list, kinds: set) -> None:
    """End the innermost open element of ``kinds`` within its scope, with all that is in it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in kinds:
            del stack[i:]
            return
        if stack[i][0] in SCOPES:
            return


# Weights before any page is seen, in the order of ``describe``.
PRIOR_WEIGHTS = np.array([-1.0, 0.5, -3.0, 1.0, 0.3, 0.5, 0.5, -0.3, -6.0, -7.0, 3.0, 1.5])
# Features that tell the region of the page; hidden in half of the training rows.
REGION = slice(8, 12)


def describe(blocks: list[Block]) -> np.ndarray:
    """Features of each block: one, log words, part in links, ends like a sentence, commas, paragraph,
    heading, list item or cell, boilerplate tag, boilerplate name, article, content name."""
    out = np.zeros((len(blocks), len(PRIOR_WEIGHTS)))
    for row, b in zip(out, blocks):
        n = b.text.count(" ") + 1
        row[:] = (
            1.0, np.log1p(n), min(1.0, b.linked / max(1, len(b.text) - n + 1)), b.text[-1] in SENTENCE_ENDS,
            min(1.0, b.text.count(",") / 5), b.tag == "p", b.tag in HEADINGS, b.tag in ("li", "td", "th", "dt", "dd", "label"),
            min(1, b.marks[0]), min(1, b.marks[1]), min(1, b.marks[2]), min(1, b.marks[3]),
        )
    return out


def weak_labels(blocks: list[Block]) -> list[int] | None:
    """1 for blocks of the page's article that stand in nothing named boilerplate, else 0; None
    for a page without an article element."""
    if not any(b.marks[2] for b in blocks):
        return None
    return [int(b.marks[2] > 0 and not b.marks[0] and not b.marks[1]) for b in blocks]


def fit(x: np.ndarray, y: np.ndarray, each: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to the prior weights; a row weighs ``each``."""
    w = PRIOR_WEIGHTS.copy()
    for _ in range(12):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = each * (x.T @ (p - y)) + PRIOR * (w - PRIOR_WEIGHTS)
        w = w - np.linalg.solve(each * (x * (p * (1 - p))[:, None]).T @ x + PRIOR * np.eye(len(w)), gradient)
    return w


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> np.ndarray:
    """Weights from at most ``most`` pages. Blocks in and out of a page's article element are the
    examples, once with and once without the features of the region, so that pages without
    such elements are judged by the text. Without such pages the prior weights stand."""
    some = pages.select("url", "html").filter("html IS NOT NULL")
    some = some.orderBy(F.xxhash64("url", "html")).limit(most)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch["html"].to_pylist():
                blocks = blocks_of(html)
                labels = weak_labels(blocks)
                if labels:
                    x = describe(blocks)
                    yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(list(x))], names=["y", "x"])

    rows = some.select("html").mapInArrow(examples, "y int, x array<double>").collect()
    if not rows:
        return PRIOR_WEIGHTS
    rows.sort()  # one order, so that the fit is the same every time
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    bare = x.copy()
    bare[:, REGION] = 0.0
    # either half weighs no more than 2000 examples, so that the prior still counts
    return fit(np.concatenate([x, bare]), np.concatenate([y, y]), min(1.0, 2000 / len(y)))


def min_cut(costs: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling of least cost: True for the side of the source.

    ``costs[i]`` is what it costs more to be on the side of the sink (negative: of the source);
    an edge (i, j, c) costs c where i and j are apart. Shortest augmenting paths in phases
    (Dinic); blocks that the source no longer reaches are on the side of the sink.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a, b, there, back):
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, c in enumerate(costs):
        if c > 0:
            link(source, i, c, 0)
        elif c < 0:
            link(i, sink, -c, 0)
    for i, j, c in edges:
        link(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                # go on from the first edge that is full
                full = next(k for k, e in enumerate(path) if room[e] == 0)
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if room[e] > 0 and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(out[a]):
                path.append(out[a][tried[a]])
                a = to[path[-1]]
            elif a == source:
                break
            else:
                a = to[path.pop() ^ 1]
                tried[a] += 1


def label(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """True for the blocks of the main text."""
    scores = np.clip(describe(blocks) @ weights, -MOST_COST, MOST_COST)
    costs = np.rint(scores * SCALE).astype(int).tolist()
    edges = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            apart = abs(b.depth - blocks[i - 1].depth) + (b.parent != blocks[i - 1].parent)
            edges.append((i - 1, i, int(SCALE * NEIGHBOUR / (1 + apart))))
        if b.parent in last:
            edges.append((last[b.parent], i, int(SCALE * SAME_PARENT)))
        last[b.parent] = i
    return min_cut(costs, edges)


def main_text(html: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    return " ".join(b.text for b, kept in zip(blocks, label(blocks, weights)) if kept)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each page. A null or empty page, and one that
    has no content, has the empty text. A page's blocks are all of its text, however long.
    Repeated rows give equal rows, an empty table none; other columns are ignored."""
    bounded_batches(pages.sparkSession)
    weights = train(pages) if weights is None else weights
    rows = pages.select(F.col("page_id"), F.col("url"), F.col("html"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    out = rows.mapInArrow(text, f"page_id {kind['page_id']}, url {kind['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))

"""Main text of web pages by a minimum cut.

A page is cut into blocks at its block-level tags. A linear classifier over
tag, class, link and length features gives each block a cost for either label,
which becomes its capacity to the source (content) or the sink (boilerplate).
Edges between neighbouring blocks, stronger where the blocks share a parent,
are the cost of a change of label. The minimum cut of that graph is the
labelling of least total cost; it is found by maximum flow, along all shortest
paths at once, so that pages of many blocks take time in proportion. The page's
text is its content blocks in order. If no block is content, those that nothing
speaks against are: a page of one short line is that line.

Pages are independent, so the work is one map without a shuffle.

Edge cases: null html and pages without content give an empty text; unclosed,
misnested and truncated mark-up is read as far as it goes; an empty table gives
an empty result; repeated rows give repeated results; other columns are ignored.
Open elements are found by their kind, so depth costs no time; texts of any
length and pages of any number of blocks are taken whole.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of the HTML standard by what they do to the text around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are blocks of their own but leave an open paragraph open.
EMBEDDED = frozenset("audio button canvas datalist noscript object optgroup option select template video".split())
BLOCKS = BLOCK | EMBEDDED
#: Elements that end an open paragraph, and those that end a sibling of their own kind.
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}

#: The classifier's weights, positive for content.
BIAS = -1.0
TAG_WEIGHT = {"nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -6.0, "menu": -6.0, "dialog": -7.0, "header": -4.5, "search": -6.0, "article": 4.0, "main": 3.5, "figcaption": -0.5, "fieldset": -4.0, "button": -6.0, "select": -6.0, "datalist": -6.0, "option": -6.0, "audio": -4.0, "canvas": -4.0, "video": -4.0, "noscript": -3.0}
HEADER_IN_ARTICLE = -1.0
GOOD_WORD, BAD_WORD, COMMENT_WORD = 2.5, -7.0, -12.0
GOOD_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: A name (class, id, role) tells of boilerplate or comments by its last part that says anything: "cookie-notice-box", not "cookie-recipe".
BAD_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising breadcrumb breadcrumbs consent cookie cookies footer gdpr masthead modal nav navbar navigation newsletter overlay pager pagination paywall popup promo sidebar signup sponsor sponsored toolbar".split()
)
#: These do so only where all other parts of the name are of these kinds or plain: "share-buttons", not "share-price".
UNSURE_WORDS = frozenset(
    "alert banner bar copyright header login menu notice notification promoted promotion recommended related search share sharing social subscribe subscription tags widget widgets".split()
)
PLAIN_WORDS = frozenset(
    "area block bottom box btn button buttons close col column container desktop fixed form global group heading holder icon icons inner item items label left link links list main message mobile module outer page panel post posts primary right row secondary section site slot small stories sub sticky thread title tool tools top unit wrap wrapper".split()
)
LAYOUT_WORDS = frozenset("has layout no with without".split())
#: A name with one of these reads like a title.
TITLE_WORDS = frozenset("about and for free from how of on the to versus vs what why".split())
COMMENT_WORDS = frozenset("comment commentlist comments disqus replies reply respond".split())
LINK_WEIGHT, LENGTH_WEIGHT, SENTENCE_WEIGHT, HEADING_WEIGHT = -4.0, 0.5, 0.5, 0.5
#: Inside an article, lists of links are part of it.
INSIDE, LINK_WEIGHT_INSIDE = 2.0, -2.5
NEIGHBOUR, SAME_PARENT, SIBLING = 0.3, 0.7, 0.4

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
#: One attribute after the other, so that a value is never read as a name; a quote left open reaches to the tag's end.
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>][^\s>]*)))?")
_NAMES = frozenset("class id role itemprop aria-hidden style hidden".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    tag: str
    weight: float
    parent: int
    linked: float


@dataclass
class _Element:
    tag: str
    weight: float
    number: int
    in_article: bool
    hidden: bool


class _Open:
    """The open elements, and where those of each kind stand, so that none is searched for. Place 0 is the page itself, which nothing closes."""

    def __init__(self, page: _Element) -> None:
        self.elements = [page]
        self.places: dict[str, list[int]] = {}
        self.block: list[int] = []
        self.blocks: list[int] = []

    def push(self, element: _Element) -> None:
        place = len(self.elements)
        self.elements.append(element)
        self.places.setdefault(element.tag, []).append(place)
        if element.tag in BLOCKS:
            self.blocks.append(place)
            if element.tag in BLOCK:
                self.block.append(place)

    def last(self, tag: str) -> int:
        places = self.places.get(tag)
        return places[-1] if places else 0

    def close(self, place: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.elements) > place > 0:
            tag = self.elements.pop().tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
                if tag in BLOCK:
                    self.block.pop()

    def nearest(self, places: list[int]) -> int:
        return places[-1] if places else 0

    @property
    def top(self) -> _Element:
        return self.elements[-1]


def _name_parts(name: str) -> list[str]:
    return [p.lower() for p in _PART.findall(name)]


def _year(part: str) -> bool:
    return len(part) == 4 and part[:2] in ("19", "20")


def name_kind(name: str) -> str | None:
    """What one name of a class or id tells: comment, bad, layout or nothing."""
    parts = _name_parts(name)
    said = {p for p in parts if not p.isdigit()}
    if said & LAYOUT_WORDS:
        return "layout"
    if said & TITLE_WORDS:
        return None
    while parts and (parts[-1] in PLAIN_WORDS or parts[-1] in GOOD_WORDS or parts[-1].isdigit() and not _year(parts[-1])):
        parts.pop()
    head = parts[-1] if parts else ""
    if head in COMMENT_WORDS:
        return "comment"
    years = any(map(_year, parts))
    if head in BAD_WORDS or not years and said & (UNSURE_WORDS | BAD_WORDS) and said <= UNSURE_WORDS | BAD_WORDS | PLAIN_WORDS:
        return "bad"
    return None


def _element(tag: str, attributes: str, above: _Element, number: int) -> _Element:
    weight = TAG_WEIGHT.get(tag, 0.0)
    if tag == "header" and above.in_article:
        weight = HEADER_IN_ARTICLE
    hidden = above.hidden or tag == "template"
    if attributes:
        parts: set[str] = set()
        kinds: set[str | None] = set()
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next(filter(None, values), "")
            name = name.lower()
            if name not in _NAMES:
                continue
            if name == "style":
                hidden = hidden or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif name == "hidden":
                hidden = True
            elif name == "aria-hidden":
                hidden = hidden or value == "true"
            else:
                for own in value.split():
                    parts |= {*_name_parts(own), own.lower()}
                    kinds.add(name_kind(own))
        if "comment" in kinds:
            weight += COMMENT_WORD
        elif "bad" in kinds and "layout" not in kinds and tag not in ("article", "body", "html", "main"):
            weight += BAD_WORD
        elif parts & GOOD_WORDS:
            weight += GOOD_WORD
    return _Element(tag, min(above.weight + weight, 6.0), number, above.in_article or tag == "article", hidden)


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page with what the classifier knows of each."""
    stack = _Open(_Element("", BIAS, 0, False, False))
    blocks: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    number = links = 0

    def flush() -> None:
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(t for t, _ in pieces))).strip()
            if text and not stack.top.hidden:
                own = stack.elements[stack.blocks[-1]] if stack.blocks else stack.top
                parent = stack.elements[stack.blocks[-2]].number if len(stack.blocks) > 1 else 0
                linked = sum(len(t) for t, a in pieces if a) / max(1, sum(len(t) for t, _ in pieces))
                blocks.append(Block(text, own.tag, own.weight, parent, min(1.0, linked)))
            pieces.clear()

    at, end = 0, len(page)
    while at < end:
        m = _MARKUP.search(page, at)
        if m is None:
            pieces.append((page[at:], links > 0))
            break
        if m.start() > at:
            pieces.append((page[at : m.start()], links > 0))
        at = m.end()
        closing, tag, attributes, closed = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], m[8])
        if tag is None or closed != ">":  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCKS:
                flush()
            if tag in BLOCK or stack.last(tag) > stack.nearest(stack.block):  # others do not reach beyond their block
                stack.close(stack.last(tag))
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            pieces.append((" ", False))
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append((" ", False))
            elif tag == "hr":
                flush()
            continue
        if tag in EMBEDDED:
            flush()
        if tag in BLOCK or tag in ("option", "optgroup"):  # these end an open option, whose end tag may be left out
            flush()
            if stack.elements[stack.nearest(stack.blocks)].tag == "option":
                stack.close(stack.nearest(stack.blocks))
        if tag in BLOCK:
            links = 0
            for kind in SELF_CLOSING.get(tag, ()) if tag != "p" else ():
                if stack.last(kind) > max(map(stack.last, ("ul", "ol", "dl", "table", "menu"))):
                    stack.close(stack.last(kind))
            if stack.elements[stack.nearest(stack.block)].tag == "p":  # a block ends an open paragraph
                stack.close(stack.nearest(stack.block))
        if tag == "a":
            links += 1
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        number += 1
        if tag in BLOCKS or attributes:
            stack.push(_element(tag, attributes, stack.top, number))
        else:
            above = stack.top
            stack.push(_Element(tag, above.weight, number, above.in_article, above.hidden))
    flush()
    return blocks


def content_score(block: Block) -> float:
    """The classifier: above 0 for content, below for boilerplate."""
    n = block.text.count(" ") + 1
    z = block.weight + (LINK_WEIGHT_INSIDE if block.weight >= INSIDE else LINK_WEIGHT) * block.linked + LENGTH_WEIGHT * min(4.0, math.log1p(n))
    z += SENTENCE_WEIGHT * (block.text[-1] in ".!?…\"”")
    return z + HEADING_WEIGHT * (block.tag[:1] == "h" and block.tag[1:].isdigit())


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: |score| for each label against its sign, an edge's weight for each pair that differs.

    Maximum flow in rounds: nodes are levelled by their distance from what has
    flow left to give, and flow is sent along levels until no path is left, each
    arc being looked at once a round.
    """
    excess = list(scores)  # flow straight from source to sink through a block cancels out: one capacity is left
    if not excess or min(excess) > 0 or max(excess) <= 0:
        return [s > 0 for s in excess]
    least = 1e-12
    arcs: list[list[int]] = [[] for _ in excess]
    head: list[int] = []
    room: list[float] = []
    for a, b, w in edges:  # an arc and the next one are each other's way back
        arcs[a].append(len(head))
        arcs[b].append(len(head) + 1)
        head += (b, a)
        room += (w, w)
    while True:
        givers = [i for i, e in enumerate(excess) if e > least]
        level, queue, met = [-1] * len(excess), deque(givers), False
        for i in givers:
            level[i] = 0
        while queue:
            a = queue.popleft()
            for arc in arcs[a]:
                b = head[arc]
                if room[arc] > least and level[b] < 0:
                    level[b] = level[a] + 1
                    met = met or excess[b] < -least
                    queue.append(b)
        if not met:
            return [at >= 0 for at in level]
        left = [iter(of) for of in arcs]
        for giver in givers:
            path: list[int] = []
            node = giver
            while excess[giver] > least:
                if excess[node] < -least:
                    flow = min(excess[giver], -excess[node], *(room[arc] for arc in path))
                    excess[giver] -= flow
                    excess[node] += flow
                    for arc in path:
                        room[arc] -= flow
                        room[arc ^ 1] += flow
                    full = next((i for i, arc in enumerate(path) if room[arc] <= least), len(path))
                    if full < len(path):
                        node = head[path[full] ^ 1]
                        del path[full:]
                    continue
                for arc in left[node]:
                    if room[arc] > least and level[head[arc]] == level[node] + 1:
                        path.append(arc)
                        node = head[arc]
                        break
                else:
                    level[node] = -2  # a dead end in this round
                    if not path:
                        break
                    node = head[path.pop() ^ 1]


def labelled_blocks(page: str | None) -> list[tuple[Block, bool]]:
    """The page's blocks, each with whether it is content."""
    blocks = page_blocks(page or "")
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SAME_PARENT if blocks[i - 1].parent == b.parent else NEIGHBOUR))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    labels = minimum_cut([content_score(b) for b in blocks], edges)
    if not any(labels):
        labels = [b.weight >= BIAS and b.linked < 0.5 for b in blocks]
    return list(zip(blocks, labels, strict=True))


def main_text(page: str | None) -> str:
    return " ".join(b.text for b, content in labelled_blocks(page) if content)


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars, n_blocks, n_content."""
    id_type = df.schema[id_col].dataType.simpleString()
    thin = df.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [labelled_blocks(page) for page in batch["html"]]
            texts = [" ".join(b.text for b, content in page if content) for page in found]
            yield pd.DataFrame({
                "id": batch["id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts)),
                "n_blocks": list(map(len, found)), "n_content": [sum(c for _, c in page) for page in found],
            })

    out = thin.mapInPandas(extracted, "id string, url string, text string, n_chars long, n_blocks long, n_content long")
    return out.select(F.col("id").cast(id_type).alias(id_col), F.col("url").alias(url_col), "text", "n_chars", "n_blocks", "n_content")

"""HTML extraction: a minimum cut separates the blocks of a page into content and the rest."""

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "label legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
# A start tag of the first kind ends an open element of the second, up to a limit.
CLOSES = {
    **dict.fromkeys(BLOCK - {"body", "head", "html", "button", "label"}, {"p"}),
    "li": {"li", "p"},
    "dt": {"dt", "dd", "p"},
    "dd": {"dt", "dd", "p"},
    "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"},
    "th": {"td", "th", "p"},
    "option": {"option"},
    "body": {"head"},
}
STOPS = frozenset("ul ol dl table body html article section div main aside nav header footer".split())
# Never shown, whatever they hold.
HIDDEN = frozenset("head script style noscript template iframe textarea title select button svg".split())

# Our own choice: words in class, id or role that tell what a part of a page is for.
AWAY_WORDS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment "
    "comments complementary consent contentinfo cookie cookies dialog disqus footer gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted related replies reply respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription tags toolbar widget".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
AWAY_TAGS = frozenset("nav footer aside form menu dialog fieldset search".split())
# Away tags that pages also wrap around all they have.
WRAPPING_TAGS = frozenset(("form", "fieldset"))
# A header of one of these belongs to the content.
HEADED = frozenset("article content entry post story".split())
# What is left of an away mark one element further down.
FADE = 0.6

_RAW_ENDS = {tag: re.compile(f"</{tag}(?![a-z])", re.I) for tag in RAW}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
# The next attribute of a tag with its whole value, or the end of the tag.
_ATTRIBUTE = re.compile(
    r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)"""
    r"""(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?)"""
)
_READ = frozenset("class id role hidden style aria-hidden".split())
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"\s+")


class Element:
    """An open or closed element: what the blocks in it inherit.

    ``away`` is 1 where a tag or word marks a part as no content and fades below it. The mark
    is ``firm``, or it counts the less the more of the page's text its element holds.
    """

    __slots__ = ("tag", "parent", "away", "mark", "firm", "inside", "hidden", "link", "block")

    def __init__(self, tag: str, parent: "Element | None", attributes: dict[str, str]):
        self.tag, self.parent = tag, parent
        self.away = parent.away * FADE if parent else 0.0
        self.mark: Element | None = parent.mark if parent else None
        self.firm = bool(parent and parent.firm)
        self.inside = bool(parent and parent.inside)
        self.hidden = bool(parent and parent.hidden) or tag in HIDDEN
        self.link = tag == "a" or bool(parent and parent.link)
        # The nearest element that is a block, if it is another one.
        self.block: Element | None = None
        if parent and tag not in BLOCK:
            self.block = parent.block or parent
        marked = pure = content = False
        for name, value in attributes.items():
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                self.hidden = True
            elif name == "style":
                self.hidden |= "display:none" in value.replace(" ", "")
            else:
                for token in value.split():
                    words = set(_WORD.findall(token))
                    away = words & AWAY_WORDS
                    if words & HEADED:
                        away.discard("header")
                    marked |= bool(away)
                    pure |= bool(away) and words <= AWAY_WORDS
                    content |= not away and bool(words & CONTENT_WORDS)
        own = tag in ("article", "main")
        if tag in AWAY_TAGS or (tag == "header" and not self.inside):
            self._set_apart(tag not in WRAPPING_TAGS)
        elif tag in ("html", "body") or own:
            above = self.mark.tag if self.mark else ""
            if tag == "main" or (tag == "article" and not marked and above in WRAPPING_TAGS):
                self.away, self.mark, self.firm = 0.0, None, False
            elif tag == "article" and not marked and above not in (*AWAY_TAGS, "header"):
                self.firm = False  # set apart by a word only
        elif marked and (pure or not content):
            self._set_apart(pure and not content)
        if (own or content) and not self.firm:
            self.inside = True

    def _set_apart(self, firm: bool) -> None:
        self.away, self.mark, self.firm = 1.0, self, firm
        if firm:
            self.inside = False


class Block(NamedTuple):
    """A run of text without a block boundary in it."""

    text: str
    element: Element
    linked: int


def blocks_of(page: str) -> list[Block]:
    """The visible blocks of a page in order, with white space folded."""
    root = Element("html", None, {})
    open_elements = [root]
    # Where elements of a tag are open, so that none has to be searched however deep a page is.
    places: dict[str, list[int]] = {}
    stops = [0]
    blocks: list[Block] = []
    pieces: list[str] = []
    linked = 0
    owner = root

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = _SPACES.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                blocks.append(Block(text, owner, linked))
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, owner
        here = open_elements[-1]
        if here.hidden or not text:
            return
        if not pieces:
            owner = here.block or here
        pieces.append(text)
        if here.link:
            linked += len(text.strip())

    def close(at: int) -> None:
        if any(element.tag in BLOCK for element in open_elements[at:]):
            end_block()
        for element in reversed(open_elements[at:]):
            places[element.tag].pop()
            if element.tag in STOPS:
                stops.pop()
        del open_elements[at:]

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        closing = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + closing)
        if name is None:  # a lone sign, not a tag
            add("<")
            at = start + 1
            continue
        end, attributes = _attributes(page, name.end())
        tag = name[0].lower()
        at = end + 1
        if closing:
            if places.get(tag):
                close(places[tag][-1])
            elif tag in BLOCK:
                end_block()
            continue
        ends = CLOSES.get(tag)
        if ends:
            while True:
                last = max((places[end][-1] for end in ends if places.get(end)), default=0)
                if last <= stops[-1]:
                    break
                close(last)
                if tag not in ("li", "dt", "dd", "tr", "td", "th"):
                    break
        if tag in BLOCK:
            end_block()
        elif tag == "br":
            add(" ")
        if tag in VOID or tag == "svg" and page[end - 1] == "/":
            continue
        places.setdefault(tag, []).append(len(open_elements))
        if tag in STOPS:
            stops.append(len(open_elements))
        open_elements.append(Element(tag, open_elements[-1], attributes))
        if tag in RAW:
            end = _RAW_ENDS[tag].search(page, at)
            at = size if end is None else end.start()
    end_block()
    return blocks


def _attributes(page: str, at: int) -> tuple[int, dict[str, str]]:
    """The place of the ``>`` that ends a tag, and the attributes before it that tell something.

    Attributes are read one after another, so what a value holds is never taken for another
    one. The first of a name counts. A tag without an end goes to the end of the page; a quote
    that is never closed is part of an unquoted value.
    """
    found: dict[str, str] = {}
    while part := _ATTRIBUTE.match(page, at):
        if part[1]:
            return part.end() - 1, found
        name = part[2].lower()
        if name in _READ:
            found.setdefault(name, (part[3] or part[4] or part[5] or "").lower())
        at = part.end()
    return len(page), found


# The classifier starts from these weights and moves from them as far as pages tell it to.
FEATURES = {
    "bias": -0.4,
    "away": -9.0,  # at the marked element itself; less below it
    "inside": 3.0,
    "linked": -3.0,
    "heading": 0.6,
    "list_item": -0.6,
    "long": 1.2,
    "stops": 0.8,
    "notice": -2.5,
    "repeated": -0.5,
}
_NOTICE = re.compile(
    r"©|\(c\)\s*(?:19|20)\d\d|all rights reserved|cookies?\b.{0,40}\b(?:use|accept|policy)"
    r"|sign up|subscribe",
    re.I,
)


def _holds(blocks: list[Block]) -> list[float]:
    """How far the mark above each block holds, from 0 to 1.

    A mark that is not firm is weighed by its part of the text that no firm mark sets apart. It
    holds up to a third of that, and no longer from two thirds on: a form or a wrapper around
    all of a page tells nothing.
    """
    held: dict[Element | None, int] = {}
    for block in blocks:
        if not block.element.firm:
            mark = block.element.mark
            held[mark] = held.get(mark, 0) + len(block.text)
    size = sum(held.values())
    return [
        float(block.element.firm)
        if block.element.firm or block.element.mark is None
        else min(1.0, max(0.0, 2 - 3 * held[block.element.mark] / size))
        for block in blocks
    ]


def features_of(blocks: list[Block]) -> np.ndarray:
    """One row per block in the order of ``FEATURES``."""
    seen: dict[str, int] = {}
    for block in blocks:
        seen[block.text] = seen.get(block.text, 0) + 1
    return np.array(
        [
            (
                1.0,
                block.element.away * holds,
                block.element.inside * (1 - holds),
                min(1.0, block.linked / len(block.text)),
                block.element.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
                block.element.tag in ("li", "td", "th", "dt", "dd", "label", "legend", "caption"),
                min(1.0, math.log1p(len(block.text)) / 6),
                min(1.0, len(re.findall(r"[.?!…](?:\s|$)", block.text)) / 2),
                bool(_NOTICE.search(block.text)) and len(block.text) < 400,
                seen[block.text] > 2,
            )
            for block, holds in zip(blocks, _holds(blocks), strict=True)
        ],
        dtype=float,
    ).reshape(-1, len(FEATURES))


def minimum_cut(
    source: list[float], sink: list[float], edges: list[tuple[int, int, float]]
) -> list[bool]:
    """Which nodes stay on the source's side of a minimum cut.

    ``source[i]`` and ``sink[i]`` are the capacities between node i and the terminals, an edge
    ``(i, j, c)`` has capacity c both ways. Flow is pushed along shortest paths by levels.
    """
    n = len(source)
    s, t = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def link(a: int, b: int, forth: float, back: float) -> None:
        heads[a].append(len(to))
        to.append(b)
        room.append(forth)
        heads[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        through = min(source[i], sink[i])  # cut in any case
        if source[i] > through:
            link(s, i, source[i] - through, 0.0)
        elif sink[i] > through:
            link(i, t, sink[i] - through, 0.0)
    for i, j, capacity in edges:
        link(i, j, capacity, capacity)

    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        waiting = deque([s])
        while waiting:
            a = waiting.popleft()
            for e in heads[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    waiting.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        following = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(room[e] for e in path)
                keep = len(path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                    if room[e] <= tiny and k < keep:
                        keep = k
                a = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while following[a] < len(heads[a]):
                e = heads[a][following[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                following[a] += 1
                continue
            path.append(e)
            a = to[e]


# What it costs to part two blocks: neighbours in the page, and neighbours with one parent.
ADJACENT, SIBLINGS = 0.3, 0.9
# The part of that which is left between blocks under different marks.
ACROSS = 1 / 3


def label_blocks(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """Whether each block is content, by a minimum cut over the page."""
    if not blocks:
        return []
    z = features_of(blocks) @ weights
    # The cost of a label is its negative log likelihood.
    away_cost, content_cost = np.logaddexp(0, z), np.logaddexp(0, -z)
    edges = []
    last_of: dict[int, int] = {}
    for i, block in enumerate(blocks):
        own = block.element
        if i:
            same = blocks[i - 1].element.mark is own.mark
            edges.append((i - 1, i, ADJACENT if same else ADJACENT * ACROSS))
        parent = id(own.parent)
        if parent in last_of:
            same = blocks[last_of[parent]].element.mark is own.mark
            edges.append((last_of[parent], i, SIBLINGS if same else SIBLINGS * ACROSS))
        last_of[parent] = i
    # Labelled content where the source's side would be paid for being away.
    return minimum_cut(away_cost.tolist(), content_cost.tolist(), edges)


def extract(page: str | None, weights: np.ndarray) -> str:
    """The main text of a page: its content blocks joined by line ends."""
    blocks = blocks_of(page or "")
    content = label_blocks(blocks, weights)
    return "\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def fit_weights(
    pages: DataFrame,
    source: str = "html",
    max_pages: int = 2_000,
    trust: float = 50.0,
) -> np.ndarray:
    """Weights of the block classifier, fitted on the blocks of all pages.

    Pages carry no labels, so blocks in ``article`` or ``main`` stand for content and blocks
    in parts for navigation, notices and forms for the rest. The weights of those two
    features keep their starting values; the others are fitted without them, with a ridge of
    strength ``trust`` towards the start, so that few or odd pages change little. All blocks
    together weigh as much as ``max_pages`` against the ridge, however many pages there are.
    """
    names = list(FEATURES)
    start = np.array(list(FEATURES.values()))
    away_at, inside_at = names.index("away"), names.index("inside")
    free = [i for i in range(len(names)) if i not in (away_at, inside_at)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with the same features and label, counted."""
        counts: dict[tuple, int] = {}
        for batch in batches:
            for page in batch.column("html"):
                blocks = blocks_of(page.as_py() or "")
                for values in features_of(blocks).round(1).tolist():
                    away, inside = values[away_at], values[inside_at]
                    if away or inside:
                        key = (*(values[i] for i in free), float(inside > away))
                        counts[key] = counts.get(key, 0) + 1
        rows_of = pa.array([list(k) for k in counts], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [rows_of, pa.array(list(counts.values()), pa.int64())], names=["row", "n"]
        )

    # Few distinct rows, however many pages: features are rounded.
    counted = pages.select(F.col(source).alias("html")).mapInArrow(
        sums, "row array<double>, n bigint"
    )
    found = counted.groupBy("row").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return start
    table = np.array(found.column("row").to_pylist())
    n, x, y = found.column("n").to_numpy().astype(float), table[:, :-1], table[:, -1]
    n = n / n.sum() * max_pages
    w = start[free].copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (n * (p - y)) + trust * (w - start[free])
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + trust * np.eye(len(free))
        w -= np.linalg.solve(curve, slope)
    weights = start.copy()
    weights[free] = w
    return weights


def extract_pages(
    pages: DataFrame,
    weights: np.ndarray | None = None,
    id: str = "page_id",
    url: str = "url",
    source: str = "html",
) -> DataFrame:
    """One row per page: ``page_id, url, text``, the main text of its whole html.

    Blocks keep page order and are joined by one line end; white space in a block is folded
    to one space and character references are decoded. Null and empty pages, and pages of
    nothing but menus and the like, give an empty text. Broken markup is read as browsers
    do: open elements end where they must, and a tag without an end swallows the rest.
    Ids and urls may be null or repeat. An empty table gives no rows; other columns are not read.

    Pages are worked on one by one where they are read, without a shuffle.
    """
    if weights is None:
        weights = fit_weights(pages, source)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(page.as_py(), weights) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string())],
                names=["page_id", "url", "text"],
            )

    rows = pages.select(
        F.col(id).alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html")
    )
    own = [rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType())]
    return rows.mapInArrow(texts, T.StructType(own))

"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into blocks of text. What a block's markup says and what a naive Bayes classifier of its text says become the costs of
calling it content or boilerplate: the capacities to source and sink. Neighbouring blocks are joined by edges that weaken with their
distance in the element tree, and the blocks of one element by edges to a node of that element. The cheapest labelling is a minimum cut,
found as a maximum flow. A page is one row and its graph has a few edges a block, so pages are independent and nothing is shuffled.

The classifier learns from blocks whose markup says what they are, on a bounded sample of pages; its counts are summed by Spark.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: About so many pages are read to learn the text classifier, at most twice as many.
FIT_PAGES = 4000

#: Characters of text after which a batch of results is handed on.
_BATCH_CHARS = 4_000_000

# ---------------------------------------------------------------- markup

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD_EDGE = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Elements of the HTML language by what they do to text.
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math object audio video canvas".split())
_TO_THE_END = frozenset("script style title textarea xmp iframe noembed noframes".split())
_FOREIGN = frozenset(("svg", "math"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt "
                    "u var wbr img nobr".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li "
                    "main menu nav ol p pre search section summary table ul".split())
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
         "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})}

# What names of elements, roles, classes and ids say about the text inside.
_CONTENT_TAGS, _BOILER_TAGS = frozenset(("article", "main")), frozenset("nav footer aside form menu dialog button select fieldset search head datalist".split())
_CONTENT_ROLES = frozenset(("main", "article", "document"))
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status button".split())
_CONTENT_WORDS = frozenset("article post entry story content main text body prose blogpost longform richtext contents".split())
_BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox banner billboard sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation "
    "navi topnav subnav menu menus submenu breadcrumb breadcrumbs crumbs pagination pager paginator footer foot bottombar copyright legal colophon masthead topbar header toolbar "
    "sidebar sidebars sidenav aside rail widget widgets related recommended recommendations suggestions trending popular teaser teasers outbrain taboola share sharing social "
    "follow comment comments commentlist respond reply replies discussion disqus discourse responses cookie cookies consent gdpr ccpa notice notices notification notifications alert alerts "
    "disclaimer paywall newsletter subscribe subscription signup signin login register popup popover modal overlay lightbox dialog search searchbox form tags tagcloud taglist "
    "tools skip screenreader print survey poll donate".split())
#: Words that tell of a layout, or of a part that goes with another, and take the boilerplate word beside them back.
_LAYOUT_WORDS = frozenset("layout wrapper wrap container page site has with no left right grid row col columns main content article post entry body story".split())

#: Log odds that markup gives, and the largest that the text can give.
_SAYS, _TEXT_MOST = 8.0, 3.0


def _says(tag: str, attrs: str, inside_content: bool) -> tuple[int, bool]:
    """1 content, -1 boilerplate, 0 nothing, as far as the element itself tells; and whether it is never shown."""
    says = 1 if tag in _CONTENT_TAGS else -1 if tag in _BOILER_TAGS else 0
    if tag == "header" and not inside_content:
        says = -1
    if not attrs or tag in ("html", "body"):
        return says, False
    words: set[str] = set()
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true" and tag not in _INLINE) or (name == "style" and _UNSEEN.search(value)):
            return -1, True
        if name == "role" and not says:
            role = value.strip().lower()
            says = 1 if role in _CONTENT_ROLES else -1 if role in _BOILER_ROLES else 0
        elif name in ("class", "id"):
            words.update(_WORD_EDGE.split(_CAMEL.sub("-", unescape(value)).lower()))
    if says or not words:
        return says, False
    boiler = words & _BOILER_WORDS
    if inside_content:
        boiler -= {"header", "masthead", "foot", "print"}
    if boiler and not (words - boiler) & _LAYOUT_WORDS:
        return -1, False
    return (1 if not boiler and words & _CONTENT_WORDS else 0), False


@dataclass
class Block:
    """A run of text between two borders of blocks: its text, its element, what the markup says, and how much of it is links."""

    text: str
    element: int
    says: int
    link_chars: int


class _Page:
    """The open elements while a page is read. Each step costs what it pushes or pops, so reading is linear in the page."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.parents, self.depths = [-1], [0]  # by element; 0 is the page
        self.stack: list[tuple[str, int, int, bool]] = [("", 0, 0, False)]  # tag, element, what markup says so far, inside a link
        self.open: dict[str, int] = {}
        self.pieces: list[str] = []
        self.linked = 0

    def add(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        self.pieces.append(text)
        if self.stack[-1][3]:
            self.linked += len(text)

    def border(self) -> None:
        """End the block that is being read."""
        text = " ".join("".join(self.pieces).split())
        if text:
            _, element, says, _ = self.stack[-1]
            self.blocks.append(Block(text, element, says, min(self.linked, len(text))))
        self.pieces, self.linked = [], 0

    def pop(self) -> None:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def close_before(self, tag: str) -> None:
        """End tags that the language leaves out."""
        if tag in _ENDS_P and self.open.get("p"):
            at = len(self.stack) - 1
            while self.stack[at][0] in _INLINE:
                at -= 1
            if self.stack[at][0] == "p":
                self.pop_to(at)
        if tag in _ENDS:
            ended, bounds = _ENDS[tag]
            if any(self.open.get(e) for e in ended):
                last = None
                for at in range(len(self.stack) - 1, max(len(self.stack) - 64, 0), -1):
                    name = self.stack[at][0]
                    if name in bounds:
                        break
                    if name in ended:
                        last = at
                if last is not None:
                    self.pop_to(last)

    def start(self, tag: str, attrs: str) -> None:
        inline = tag in _INLINE
        if not inline:
            self.border()
            self.close_before(tag)
        if tag in _VOID or tag in _RAW:
            return
        _, parent, so_far, linked = self.stack[-1]
        own, unseen = _says(tag, attrs, so_far > 0)
        # what is boilerplate stays so all the way down, but for an article or main part inside something only its class tells of
        says = -2 if unseen or so_far == -2 or (own < 0 and tag in _BOILER_TAGS) else own if so_far == 0 else -1 if -1 in (so_far, own) else 1
        if so_far == -1 and tag == "main":
            says = 1
        if inline:
            element = parent
            if says != so_far and says < 0:
                self.border()
        else:
            element = len(self.parents)
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
        self.stack.append((tag, element, says, linked or tag == "a"))
        self.open[tag] = self.open.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        inline = tag in _INLINE
        if not inline:
            self.border()
        if not self.open.get(tag):
            return
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            if inline and self.stack[at][0] not in _INLINE:
                return  # a formatting end tag does not close the block around it
            at -= 1
        if inline and self.stack[at][2] < 0 <= self.stack[at - 1][2]:
            self.border()
        self.pop_to(at)


def read(html: str | None) -> tuple[list[Block], list[int], list[int]]:
    """A page's blocks in order, and for each element its parent and depth. Comments, scripts, styles and markup hold no text."""
    page, at, html = _Page(), 0, html or ""
    endless: set[str] = set()  # elements without an end tag in the rest of the page
    while token := _TOKEN.search(html, at):
        if token.start() > at:
            page.add(html[at : token.start()])
        at = token.end()
        if name := token["close"]:
            page.end(name.lower())
        elif name := token["open"]:
            tag = name.lower()
            if tag == "br":
                page.add(" ")
                continue
            page.start(tag, token["attrs"])
            if tag in _RAW and tag not in endless and not (tag in _FOREIGN and token["attrs"].endswith("/")):
                if end := re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at):
                    at = end.end()
                elif tag in _TO_THE_END:
                    at = len(html)
                else:
                    endless.add(tag)
    if at < len(html):
        page.add(html[at:])
    page.border()
    return page.blocks, page.parents, page.depths


# ---------------------------------------------------------------- text classifier

#: Features of a block's text, each with the prior counts (content, boilerplate) of its values.
_PRIOR: dict[str, list[tuple[float, float]]] = {
    "words": [(2, 12), (4, 8), (8, 5), (14, 3), (18, 2)],  # under 3, 10, 25, 60, more
    "links": [(30, 12), (6, 6), (2, 14)],  # share of characters in links: none or few, up to a third, more
    "sentences": [(8, 20), (24, 6)],  # without and with the end of a sentence
    "shape": [(26, 16), (6, 12)],  # usual text; few letters, or mostly capitals
}
_ENDS_SENTENCE = re.compile(r"[.!?。！？…:;](?:[\"'»”’)\]]*)(?:\s|$)")


def features(block: Block) -> dict[str, int]:
    n, size = block.text.count(" ") + 1, len(block.text)
    letters = sum(map(str.isalpha, block.text[:2000]))
    capitals = sum(map(str.isupper, block.text[:2000]))
    share = block.link_chars / size
    return {
        "words": 0 if n < 3 else 1 if n < 10 else 2 if n < 25 else 3 if n < 60 else 4,
        "links": 0 if share < 0.1 else 1 if share < 0.34 else 2,
        "sentences": int(bool(_ENDS_SENTENCE.search(block.text))),
        "shape": int(letters < 0.5 * min(size, 2000) or capitals > 0.6 * letters),
    }


Odds = dict[str, list[float]]


def odds_of(counts: dict[tuple[str, int, int], int]) -> Odds:
    """Log odds of content for each value of each feature, from (feature, value, 1 content or 0) counts over the prior ones.

    Counted blocks weigh as much as the prior together with them at most tenfold, so that a corpus of one kind of page cannot make a value
    it never saw certain.
    """
    out = {}
    for name, prior in _PRIOR.items():
        seen = [[counts.get((name, value, label), 0) for label in (1, 0)] for value in range(len(prior))]
        lines = []
        for label in (0, 1):
            weight = sum(p[label] for p in prior)
            total = sum(s[label] for s in seen)
            shrink = min(1.0, 10 * weight / total) if total else 0.0
            lines.append([(p[label] + s[label] * shrink) / (weight + total * shrink) for p, s in zip(prior, seen, strict=True)])
        out[name] = [math.log(c / b) for c, b in zip(*lines, strict=True)]
    return out


def fit(pages: DataFrame, html: str = "html", fit_pages: int = FIT_PAGES) -> Odds:
    """Learn the classifier from blocks whose markup tells what they are, on about ``fit_pages`` pages picked by a hash of their html.

    Only the counts (one line a feature, value and label) reach the driver. Without such blocks the prior counts stand.
    """
    n = pages.count()
    if not n:
        return odds_of({})
    place = F.pmod(F.xxhash64(F.col(html)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = pages.filter(place < F.lit(min(1.0, fit_pages / n))).select(html).limit(2 * fit_pages)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int, int], int] = {}
        for batch in batches:
            for page in batch.column(0):
                for block in read(page.as_py())[0]:
                    if block.says:
                        for name, value in features(block).items():
                            key = (name, value, int(block.says > 0))
                            found[key] = found.get(key, 0) + 1
        rows = [(*key, n) for key, n in found.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("feature", "value", "label", "n"), r, strict=True)) for r in rows], pa.schema(
            [("feature", pa.string()), ("value", pa.int32()), ("label", pa.int32()), ("n", pa.int64())]))

    lines = picked.mapInArrow(counted, "feature string, value int, label int, n bigint").groupBy("feature", "value", "label").agg(F.sum("n").alias("n")).collect()
    return odds_of({(r["feature"], r["value"], r["label"]): r["n"] for r in lines})


# ---------------------------------------------------------------- minimum cut

#: Capacities are whole thousandths, so that flows are exact.
_UNIT = 1000


def minimum_cut(n: int, source: Sequence[int], sink: Sequence[int], edges: Sequence[tuple[int, int, int]]) -> list[bool]:
    """Which of ``n`` nodes stay on the source's side of a minimum cut, as few as possible.

    ``source`` and ``sink`` are terminal capacities, ``edges`` are (node, node, capacity) in both directions. Level graphs by breadth,
    blocking flows by depth, without recursion.
    """
    heads: list[int] = []
    room: list[int] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        at[a].append(len(heads))
        heads.append(b)
        room.append(there)
        at[b].append(len(heads))
        heads.append(a)
        room.append(back)

    start, goal = n, n + 1
    for v in range(n):
        direct = min(source[v], sink[v])  # this much flows straight through
        if source[v] > direct:
            join(start, v, source[v] - direct, 0)
        elif sink[v] > direct:
            join(v, goal, sink[v] - direct, 0)
    for a, b, capacity in edges:
        if capacity:
            join(a, b, capacity, capacity)
    while True:
        level = [-1] * (n + 2)
        level[start], front = 0, [start]
        while front and level[goal] < 0:
            following = []
            for v in front:
                for e in at[v]:
                    if room[e] and level[heads[e]] < 0:
                        level[heads[e]] = level[v] + 1
                        following.append(heads[e])
            front = following
        if level[goal] < 0:
            return [level[v] >= 0 for v in range(n)]
        upto, path, v = [0] * (n + 2), [], start
        while True:
            if v == goal:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if not room[e])
                v = heads[path[cut] ^ 1]
                del path[cut:]
                continue
            for i in range(upto[v], len(at[v])):
                e = at[v][i]
                if room[e] and level[heads[e]] == level[v] + 1:
                    upto[v] = i
                    path.append(e)
                    v = heads[e]
                    break
            else:
                upto[v] = len(at[v])
                if not path:
                    break
                e = path.pop()
                v = heads[e ^ 1]
                upto[v] += 1


def costs(block: Block, odds: Odds) -> tuple[int, int]:
    """What it costs to call a block boilerplate, and to call it content."""
    text = sum(odds[name][value] for name, value in features(block).items())
    total = max(-_TEXT_MOST, min(_TEXT_MOST, text)) + _SAYS * max(-1, min(1, block.says))
    return max(0, round(total * _UNIT)), max(0, round(-total * _UNIT))


def _apart(a: int, b: int, parents: Sequence[int], depths: Sequence[int], most: int = 6) -> int:
    """Steps between two elements in the tree, ``most`` at most."""
    steps = 0
    while a != b and steps < most:
        if depths[a] >= depths[b]:
            a = parents[a]
        else:
            b = parents[b]
        steps += 1
    return steps


def main_blocks(blocks: Sequence[Block], parents: Sequence[int], depths: Sequence[int], odds: Odds) -> list[bool]:
    """Which blocks are content: the labelling of least cost."""
    hubs: dict[int, int] = {}
    for block in blocks:
        hubs[parents[block.element]] = hubs.get(parents[block.element], 0) + 1
    place = {element: len(blocks) + i for i, element in enumerate(e for e, n in hubs.items() if n > 1)}
    source, sink = [0] * (len(blocks) + len(place)), [0] * (len(blocks) + len(place))
    edges = []
    for i, block in enumerate(blocks):
        source[i], sink[i] = costs(block, odds)
        if (hub := place.get(parents[block.element])) is not None:
            edges.append((i, hub, _UNIT // 2))
        if i:
            steps = _apart(blocks[i - 1].element, block.element, parents, depths)
            edges.append((i - 1, i, 3 * _UNIT // (1 + steps)))
    return minimum_cut(len(source), source, sink, edges)[: len(blocks)]


def main_text(html: str | None, odds: Odds) -> str:
    blocks, parents, depths = read(html)
    if not blocks:
        return ""
    kept = main_blocks(blocks, parents, depths, odds)
    return " ".join(block.text for block, keep in zip(blocks, kept, strict=True) if keep)


def extract(pages: DataFrame, odds: Odds, keys: Sequence[str] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``keys`` of every row with the page's main ``text`` and ``n_chars``, its code points.

    A null or empty page, and one without content, gives an empty text. Rows are answered one by one: repeated pages are answered again,
    null keys stay null, whole pages are read whatever their length. Other columns are not read, so their names do not matter;
    ``keys`` may not be called ``text`` or ``n_chars`` (checked).
    """
    if set(keys) & {"text", "n_chars"}:
        raise ValueError("keys must not be called text or n_chars")
    rows = pages.select(*keys, F.col(html))
    shape = [f for f in rows.schema.fields if f.name in keys]
    result = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in shape], "text string", "n_chars bigint"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun, texts, held = 0, [], 0

            def handed(upto: int) -> pa.RecordBatch:
                columns = [batch.column(i).slice(begun, upto - begun) for i in range(len(keys))]
                return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keys, "text", "n_chars"])

            for i, page in enumerate(batch.column(len(keys)), 1):
                texts.append(main_text(page.as_py(), odds))
                held += len(texts[-1])
                if held > _BATCH_CHARS:
                    yield handed(i)
                    begun, texts, held = i, [], 0
            if texts:
                yield handed(batch.num_rows)

    return rows.mapInArrow(work, result)

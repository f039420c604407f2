"""Main-text extraction from HTML by minimum-cut labelling.

A page becomes blocks: runs of text between block-level borders, with character
references decoded and white space made single blanks (``br`` counts as a blank).
A small linear classifier scores each block by its text (words, link share, end
marks), its element and the hints of the elements around it; the score s becomes two
terminal capacities, ln(1 + e^s) to the content side and ln(1 + e^-s) to the boilerplate side.
Neighbouring blocks, and blocks that follow each other in one container, are joined by
edges whose capacity falls with their distance in the element tree.  The minimum cut
separates content from boilerplate; content blocks are joined in page order by line ends.

Null, empty and markup-only pages have an empty text; text outside any element counts
like text of the body; unclosed, crossed and unknown elements are read as far as
they go; repeated rows are read one by one; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapscope.llm.common import arrow_pass, pieces

BATCH = 200
SMOOTH = 1.2               # capacity of an edge between blocks of one container
SMALL = 1e-9
WRAPPER = 0.6              # on a page without main parts, an element with more than this share of the text is no side part
MIXED = 0.25               # nor is one named both main and side with more than this share

# a common tag is matched whole here; _tag_end reads what is longer, so the figures below bound the work of a try and no tag
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^<>]*+>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?:[^'"<>]*+(?:(?:"[^"]{0,200}+"|'[^']{0,200}+')[^'"<>]*+){0,8}+>)?""", re.S)
_PLAIN = re.compile(r"""[^'"<>]*+""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = re.compile(r"""[.!?…:;。！？：；]["'»”)\]」』]*$""")
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")

SKIPPED = frozenset("script style title noscript template iframe object svg math textarea select option datalist canvas audio video head".split())
RAW = frozenset("script style title textarea iframe noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button""".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
ENDS_P = BLOCKS - {"button", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
LISTS = frozenset("ul ol menu dir dl table".split())

SIDE_TAGS = frozenset("nav aside footer form button menu dialog fieldset".split())
SIDE_WORDS = frozenset("""nav navbar navigation menu footer sidebar side aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner
    cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies respond discussion disqus share sharing social related recommended
    recommendations newsletter subscribe subscription signup login breadcrumb breadcrumbs pagination pager widget toolbar masthead copyright skip search form feedback
    teaser teasers trending popular tags legal disclaimer paywall""".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond discussion disqus".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
TOP_WORDS = frozenset("header head top".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article main content post entry story body text prose".split())


class Element:
    __slots__ = ("tag", "side", "main", "mixed", "chars", "depth", "up", "level", "in_main", "worst", "has_main")

    def __init__(self, tag: str, side: float, main: bool, mixed: bool, up: "Element | None"):
        self.tag, self.side, self.main, self.mixed, self.up = tag, side, main, mixed, up
        self.chars, self.has_main = 0, False
        # depth counts the block elements from the root to here, this one included
        self.depth = (up.depth if up else 0) + (tag in BLOCKS)


class Block:
    __slots__ = ("text", "links", "at", "tag")

    def __init__(self, text: str, links: int, at: Element | None, tag: str):
        self.text, self.links, self.at, self.tag = text, links, at, tag


def _hints(tag: str, attrs: str, inside_main: bool) -> tuple[float, bool, bool]:
    """How surely an element is a side part (2: hidden, 1.5: comments), whether it is a main part, whether names say both."""
    mixed = False
    side, main = float(tag in SIDE_TAGS or tag == "header" and not inside_main), tag in MAIN_TAGS
    if attrs and not attrs.isspace():
        words: set[str] = set()
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                for one in value.split():
                    parts = {w.lower() for w in _NAME.findall(one)}
                    mixed = mixed or bool(parts) and parts <= MAIN_WORDS
                    words |= parts
            elif name == "role":
                side, main = max(side, float(value.lower() in SIDE_ROLES)), main or value.lower() in ("main", "article")
            elif name == "itemprop":
                main = main or value in ("articleBody", "text")
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                side = 2.0
        main = main or not words.isdisjoint(MAIN_WORDS)
        if not words.isdisjoint(SIDE_WORDS) or not main and not inside_main and not words.isdisjoint(TOP_WORDS):
            told = mixed
            mixed = mixed and tag not in SIDE_TAGS and words.isdisjoint(COMMENT_WORDS)
            if not words.isdisjoint(COMMENT_WORDS) and not (tag in MAIN_TAGS and told):
                side, main = max(side, 1.5), False
            else:
                side, main = max(side, 1.0), main and tag in MAIN_TAGS
        else:
            mixed = False
    return side, main, mixed


def _tag_end(page: str, at: int, dead: set[int | str]) -> int:
    """The end of a tag whose name ends at ``at``, quoted values of any length passed over; -1: no tag.

    ``dead`` holds the page's opening quotes, and the signs ``"`` and ``'``, that are known to
    end no tag, so that tries from many names read a part of the page a fixed number of times.
    """
    tried: list[int | str] = []
    while True:
        at = _PLAIN.match(page, at).end()
        sign = page[at:at + 1]
        if sign == ">":
            return at + 1
        if sign in ("", "<") or at in dead or sign in dead:
            break
        tried.append(at)
        close = page.find(sign, at + 1)
        if close < 0:
            tried.append(sign)                  # nor is any later one of this sign closed
            break
        at = close + 1
    dead.update(tried)
    return -1


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, the elements around them judged."""
    out: list[Block] = []
    made: list[Element] = []
    opened: dict[str, int] = {}
    stack: list[Element] = []
    parts: list[str] = []
    links = 0
    anchor = mains = skipping = 0
    at = look = 0
    dead: set[int | str] = set()

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            if stack:
                stack[-1].chars += len(text)
            at = next((e for e in reversed(stack) if e.tag in BLOCKS), None)
            out.append(Block(text, min(links, len(text)), at, at.tag if at else "body"))
        links = 0

    def pop() -> None:
        nonlocal mains, anchor, skipping
        e = stack.pop()
        opened[e.tag] -= 1
        mains -= e.main
        anchor -= e.tag == "a"
        skipping -= e.tag in SKIPPED

    def text(raw: str) -> None:
        nonlocal links
        if raw and not skipping:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if anchor:
                links += len(raw.strip())

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, look)
        if m is None:
            text(page[at:])
            break
        stop = m.end()
        if m["tag"] is not None and page[stop - 1] != ">":
            stop = _tag_end(page, stop, dead)
            if stop < 0:                            # no tag: its signs are text
                look = m.end()
                continue
        text(page[at:m.start()])
        at = look = stop
        if m["tag"] is None:
            if m["cdata"]:
                text(html.escape(m["cdata"]))
            continue
        tag, attrs = m["tag"].lower(), page[m.end("tag"):stop - 1]
        if m["close"]:
            if tag in BLOCKS:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), -1) if opened.get(tag) else -1
            # a stray end tag of an inline element does not close the blocks around it
            if depth >= 0 and (tag in BLOCKS or tag in SKIPPED or not any(e.tag in BLOCKS for e in stack[depth:])):
                while len(stack) > depth:
                    pop()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag == "body" and skipping:              # a head that was never closed
            while stack and skipping:
                pop()
        if tag in BLOCKS:
            flush()
            if tag in ENDS_P and opened.get("p"):
                depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == "p")
                while len(stack) > depth:
                    pop()
            closing = CLOSED_BY.get(tag)
            if closing:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth].tag in LISTS:
                        break
                    if stack[depth].tag in closing:
                        while len(stack) > depth:
                            pop()
                        break
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = look = close.end() if close else end
            continue
        if attrs.endswith("/") and tag not in BLOCKS:
            continue
        side, main, mixed = _hints(tag, attrs, mains > 0)
        stack.append(Element(tag, side, main, mixed, stack[-1] if stack else None))
        made.append(stack[-1])
        opened[tag] = opened.get(tag, 0) + 1
        mains += main
        anchor += tag == "a"
        skipping += tag in SKIPPED
        if tag == "a" and anchor > 1:                # links do not nest
            anchor = 1
    flush()
    _judge(made, sum(len(b.text) for b in out))
    return out


def _judge(made: list[Element], total: int) -> None:
    """What each element takes from those around it; elements stand in the order in which they were opened."""
    for e in reversed(made):
        if e.up:
            e.up.chars += e.chars
            # an empty main part, or one that is itself a side part, does not make its surroundings main
            e.up.has_main = e.up.has_main or e.has_main or e.main and e.chars > 0 and not e.side
    marked = any(e.has_main or e.main and e.chars > 0 for e in made)
    for e in made:
        side = e.side
        if 0 < side < 2:
            wraps = e.chars > WRAPPER * total and not marked and side == 1 or e.mixed and e.chars > MIXED * total
            side = 0 if e.has_main or wraps else 1.0
        e.worst = max(side, e.up.worst if e.up else 0.0)
        e.in_main = e.main or e.up is not None and e.up.in_main


def score(b: Block) -> float:
    """Above zero: rather content."""
    # two characters count as a word where words are not set apart
    words = b.text.count(" ") + 1 + len(_UNSPACED.findall(b.text)) // 2
    share = b.links / len(b.text)
    s = min(1.5, words / 20) - 0.5
    heading = b.tag in ("h1", "h2", "h3")
    s += 0.5 * (b.tag in ("p", "pre", "blockquote") or heading)
    s += 0.5 * (words >= 5 and _END.search(b.text) is not None)
    s -= 0.5 * (words < 3 and not heading)
    s -= 3 * share * (share > 0.5)
    if b.at:
        s += 3 * b.at.in_main - 8 * b.at.worst
    return s


def _outer(e: Element | None) -> Element | None:
    """The next block element around a block element."""
    e = e.up if e else None
    while e is not None and e.tag not in BLOCKS:
        e = e.up
    return e


def _apart(a: Block, b: Block) -> int:
    """Steps in the element tree from one block's element to the other's; as many are taken to count them."""
    x, y, steps = a.at, b.at, 0
    while x is not y:
        if y is None or x is not None and x.depth >= y.depth:
            x = _outer(x)
        else:
            y = _outer(y)
        steps += 1
    return steps


def edges(found: list[Block]) -> dict[tuple[int, int], float]:
    """Capacities between neighbours in the page and in each container."""
    out: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        near = {i - 1} if i else set()
        outer = _outer(b.at)
        holder = id(outer) if outer else 0
        if holder in last:
            near.add(last[holder])
        last[holder] = i
        for j in near:
            out[j, i] = SMOOTH / (1 + max(0, _apart(found[j], b) - 2))
    return out


def minimum_cut(scores: list[float], links: dict[tuple[int, int], float]) -> list[bool]:
    """Which blocks stay on the content side of the minimum cut."""
    n = len(scores)
    # a block's two terminal edges carry the smaller capacity at once; what is left is the score itself
    left = [log1p(exp(min(s, 50))) - log1p(exp(min(-s, 50))) for s in scores]
    flow: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in links.items():
        flow[i][j] = flow[i].get(j, 0) + c
        flow[j][i] = flow[j].get(i, 0) + c
    while True:
        # distances from the blocks with supply; all shortest paths are used up before the next search
        level = [0 if x > SMALL else -1 for x in left]
        queue, goals = deque(i for i in range(n) if level[i] == 0), False
        while queue:
            i = queue.popleft()
            for j, c in flow[i].items():
                if c > SMALL and level[j] < 0:
                    level[j] = level[i] + 1
                    goals = goals or left[j] < -SMALL
                    queue.append(j)
        if not goals:
            return [x >= 0 for x in level]
        todo = [iter(f) for f in flow]
        for start in range(n):
            path = [start]
            while path and left[start] > SMALL and level[start] == 0:
                i = path[-1]
                if left[i] < -SMALL:
                    push = min(left[start], -left[i], *(flow[x][y] for x, y in zip(path, path[1:])))
                    left[start] -= push
                    left[i] += push
                    short = len(path)
                    for k, (x, y) in enumerate(zip(path, path[1:])):
                        flow[x][y] -= push
                        flow[y][x] += push
                        if flow[x][y] <= SMALL and k + 1 < short:
                            short = k + 1
                    if short == len(path):
                        todo[i] = iter(flow[i])
                    del path[short:]
                    continue
                step = next((j for j in todo[i] if level[j] == level[i] + 1 and flow[i][j] > SMALL), -1)
                if step >= 0:
                    path.append(step)
                else:
                    level[i] = -2 if i != start else level[i]
                    path.pop()
            for x in path:                          # supply ran out: these edges still serve other blocks
                todo[x] = iter(flow[x])


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    kept = minimum_cut([score(b) for b in found], edges(found))
    return "\n".join(b.text for b, k in zip(found, kept) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` (code points) of every page."""
    narrow = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, BATCH):
            texts = [main_text(h.as_py()) for h in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))],
                                             [*keep, "text", "n_chars"])

    return arrow_pass(narrow, f"{schema}, text string, n_chars long", of)

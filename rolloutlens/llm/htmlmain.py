"""Main-text extraction from web pages by minimum cut.

A page becomes blocks: the text between block-level tags, with the elements
that enclose it. A linear classifier gives every block a score (log odds of
content); positive scores are capacities from the source, negative ones to
the sink. Smoothness edges join neighbouring blocks, weaker the farther apart
they are in the element tree, and blocks that follow each other under the
same parent. The bonus of an article ends at a boilerplate element inside it
(advert, notice, reader comments), and an article in there, as a comment may
be, brings no new one. The minimum cut separates content from boilerplate at
the least total cost. Blocks whose own capacity outweighs all their edges are
decided at once (an exact reduction); the rest go through max-flow.

Defined results: null and empty html give the empty text, as does a page
without a content block. Broken markup is read as far as it goes: unclosed
elements end with their parent, an unclosed comment or script ends the page.
The time is linear in the page's length, whatever its markup.
Repeated rows get equal results, long pages are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: What may open a tag, a comment or a declaration.
OPENING = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
DECLARED = re.compile(r"<[!?]")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
BORDER = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
DATA_NAME = re.compile(r"(?<![\w-])data-([a-z]+)(?=[-=\s/]|$)", re.I)

#: Elements without text for a reader (scripts, styles, embedded media, a formula's source beside its signs); their content is skipped
#: up to the end tag. Formulas and the fallback text of <object> are read inline.
SKIPPED = frozenset("script style template iframe svg title noembed noframes canvas audio video head annotation annotation-xml".split())
RAW = frozenset("script style title iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody "
    "textarea tfoot thead tr ul button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE_TAGS = frozenset("p pre blockquote".split())
#: A start tag ends these open elements.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "tbody": ("thead", "tbody", "tr"), "tfoot": ("tbody", "tr")}
#: and a search for them stops at these.
SCOPE = frozenset("ul ol dl table select menu body html article section main div td th".split())

BOILER_TAGS = {"nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -7.0, "button": -7.0, "select": -7.0, "textarea": -7.0, "menu": -7.0,
               "dialog": -7.0, "noscript": -7.0, "header": -6.0, "fieldset": -6.0, "address": -1.0, "label": -3.0}
CONTENT_TAGS = {"article": 3.0, "main": 2.5}
#: Class words that name boilerplate and little else, and ordinary words that often do.
FIRM_WORDS = (r"ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|menu\w*|nav\w*|sidebar\w*|foot\w*|header\w*|masthead|"
              r"topbar|toolbar|breadcrumbs?|crumbs?|comments?|commentlist|reply|replies|respond|disqus\w*|cookies?|gdpr|"
              r"notices?|notification\w*|popup\w*|modal\w*|newsletter|subscribe\w*|signup|share\w*|sharing|"
              r"related|recommend\w*|recirc|widgets?|pager|pagination|taglist|copyright|disclaimer|paywall|outbrain|taboola|"
              r"navigation|contentinfo|complementary")
SOFT_WORDS = r"side|rail|discussion|consent|alerts?|overlay|subscription|login|search\w*|social\w*|tags|legal|skip\w*"
#: Words of layout, which say nothing about what an element holds.
LAYOUT_WORDS = (r"site|page|main|global|top|bottom|left|right|center|upper|lower|inner|outer|primary|secondary|mobile|desktop|sticky|fixed|"
                r"container|wrapper|wrap|holder|box|block|area|zone|slot|unit|space|section|panel|region|module|component|group|list|item|items|row|"
                r"col|column|grid|bar|strip|form|field|link|links|button|buttons|btn|icon|icons|title|heading|js|is|has|the|of|and|\d+|[a-z]\d*|[a-z]{2}")
BOILER_HINT = re.compile(rf"^(?:(?:{FIRM_WORDS})(?:{LAYOUT_WORDS})?|(?:{LAYOUT_WORDS})(?:nav|menu|footer|sidebar|banner|comments?))$", re.I)
SOFT_HINT = re.compile(rf"^(?:{SOFT_WORDS})$", re.I)
LAYOUT = re.compile(rf"^(?:{LAYOUT_WORDS})$", re.I)
AD_WORD = re.compile(r"^(?:ads?|adv|advert\w*|adsense|sponsor\w*)$", re.I)
#: Headings of the readers' part of a page, whatever its class.
READERS = re.compile(r"^(?:\d+ )?(?:(?:all |add )?(?:comments?|replies)|(?:your |our |user |reader |readers?['’]?s? )+(?:comments?|opinions|reactions|letters|responses|views|voices)|"
                     r"what (?:our |other )?(?:readers|users|people) (?:think|say|are saying)|leave (?:a|your) (?:comment|reply)|join the (?:discussion|conversation)|"
                     r"(?:leser)?kommentare|leserbriefe|commentaires|comentarios|commenti)(?: \(?\d+\)?)?:?$", re.I)
CONTENT_HINT = re.compile(r"^(article\w*|main|content|contents|post|entry|story|storybody|body|text|richtext|hentry|prose)$", re.I)
#: An article's own header holds its title and standfirst: these words, as the header tag, are no firm sign inside content.
HEADER_HINT = re.compile(r"^header\w*$", re.I)
SENTENCE_END = (".", "!", "?", "…", "。", ":", "\"", "”", "»")

#: Weights of the other features.
BASE, PER_LOG_WORD, SENTENCE, LINKS, HEADING, PROSE, HIDDEN, HINT, GOOD_HINT = -1.5, 0.8, 0.8, -4.0, 1.0, 0.5, -8.0, -7.0, 1.0
#: A hint among other words weighs its share of HINT, an ordinary word this at most: whole sentences can outweigh either.
SOFT = -4.0
#: Smoothness: neighbours, and neighbours under one parent.
ADJACENT, SIBLING = 1.0, 0.6


@dataclass
class Element:
    tag: str
    score: float  # of all enclosing elements, the strongest sign of each kind
    boiler: float
    content: float
    shut: bool  # in a boilerplate element that stands in content: no content sign counts
    depth: int
    parent: "Element | None"
    number: int
    block: "Element | None" = None  # itself or the nearest enclosing block
    ended_by: dict = field(default_factory=dict)  # start tag: the open element that it ends


@dataclass
class Block:
    parent: Element
    parts: list = field(default_factory=list)
    linked: int = 0
    heading: bool = False
    readers: bool = False
    text: str = ""
    score: float = 0.0


def _class_sign(value: str) -> tuple[float, bool, bool]:
    """(boilerplate evidence, firm, content) of the words of one class, id or role.

    A token that is a hint, or whose words are hints and words of layout only,
    counts in full. Other words beside a hint (in its token or in other
    tokens) may mean that it names a topic: the hint counts by its share."""
    firm = soft = other = header = 0
    content = False
    for token in value.split():
        words = [w for w in re.split(r"[-_:]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token)) if w]
        if BOILER_HINT.match(token):
            words = [token]
        for w in words:
            if BOILER_HINT.match(w):
                firm += 1
                header += bool(HEADER_HINT.match(w))
            elif SOFT_HINT.match(w):
                soft += 1
            elif CONTENT_HINT.match(w):
                content = True
            elif not LAYOUT.match(w):
                other += 1
    if not firm + soft:
        return 0.0, False, content
    share = (firm + soft) / (firm + soft + other)
    return max(HINT if firm else SOFT, HINT) * share, bool(firm > header and share == 1), False


def _signs(tag: str, attributes: str, parent: Element | None) -> tuple[float, float, bool]:
    """(boilerplate, content) evidence of one element, and whether the element is firmly boilerplate."""
    boiler, content = BOILER_TAGS.get(tag, 0.0), CONTENT_TAGS.get(tag, 0.0)
    firm = boiler <= BOILER_TAGS["fieldset"] and tag != "header"
    if "-" in tag and any(AD_WORD.match(w) for w in tag.split("-")):
        boiler, firm = HINT, True
    if attributes and tag not in ("html", "body"):
        if tag not in CONTENT_TAGS and "data-" in attributes and any(map(AD_WORD.match, DATA_NAME.findall(attributes))):
            boiler, firm = min(boiler, HINT), True
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                boiler, firm = min(boiler, HIDDEN), True
            elif name in ("class", "id", "role"):
                if tag in CONTENT_TAGS:  # its classes name the template's features, unless it is a comment
                    value = " ".join(w for w in re.split(r"[-_\s]+", value) if w.lower() in ("comment", "comments", "reply"))
                sign, sure, good = _class_sign(value)
                boiler, firm = min(boiler, sign), firm or sure
                content = max(content, GOOD_HINT if good else 0.0)
    return boiler, content, firm


class Scanner:
    """Finds the next tag in time linear in the page, however broken: what
    has been looked for without success is not looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.last_end, self.last_quote = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
        self.failed: set[int] = set()  # borders from which no end outside quotes follows
        self.absent: set[str] = set()  # elements without a further end tag

    def attributes_end(self, start: int) -> int:
        """Where the tag ends that is open at ``start``: at the first > outside quotes, else at the first > at all."""
        seen, at = [], start
        while m := BORDER.search(self.page, at):
            j = m.start()
            if j in self.failed:
                break
            if m.group() == ">":
                return j
            seen.append(j)
            if self.last_quote[m.group()] <= j:
                break
            at = self.page.find(m.group(), j + 1) + 1
        self.failed.update(seen)
        return self.page.find(">", start)

    def next(self, pos: int) -> tuple[int, int, str, bool, str, str] | None:
        """(start, end, name, whether an end tag, attributes, text) of the next
        tag, comment or declaration (no name; text: that of a CDATA section)."""
        page, n = self.page, len(self.page)
        m = OPENING.search(page, pos)
        if m and m.start() > self.last_end:  # no tag from here on
            m = DECLARED.search(page, m.start())
        if not m:
            return None
        start = m.start()
        for opening, ending in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if page.startswith(opening, start):
                at = page.find(ending, start + len(opening))
                text = page[start + 9:at if at >= 0 else n] if ending == "]]>" else ""
                return start, at + len(ending) if at >= 0 else n, "", False, "", text
        ending = page[start + 1] == "/"
        name = NAME.match(page, start + 1 + ending)
        end = self.attributes_end(name.end())
        return start, end + 1, name.group().lower(), ending, page[name.end():end], ""

    def behind(self, what: str, pattern: str, pos: int) -> re.Match | None:
        if what in self.absent:
            return None
        m = re.compile(pattern, re.I).search(self.page, pos)
        if m is None:
            self.absent.add(what)
        return m


#: Start tags, the elements that they end, and those that a search for them stops at.
ENDING = {k: (frozenset(v), SCOPE - set(v)) for k, v in ENDS.items()} | {
    "p": (frozenset(("p",)), frozenset(("body", "article", "section", "div", "td", "li", "blockquote")))}
CONCERNED = frozenset().union(*(a | b for a, b in ENDING.values()))


def _ended_by(e: Element) -> dict:
    """For each start tag the element that it would end, if it came inside ``e``."""
    if e.tag not in CONCERNED:
        return e.parent.ended_by
    return {k: e if e.tag in ends else None if e.tag in stop else e.parent.ended_by.get(k) for k, (ends, stop) in ENDING.items()}


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in page order."""
    root = Element("#page", 0.0, 0.0, 0.0, False, 0, None, 0)
    root.block = root
    top, found, current, scan, open_tags = root, [], None, Scanner(page), Counter()
    links = headings = 0
    pos, count, n = 0, 0, len(page)

    def text(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(top.block)
        raw = html.unescape(raw) if "&" in raw else raw
        current.parts.append(raw)
        if links:
            current.linked += len(raw)
        if headings:
            current.heading = True

    def flush() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                found.append(current)
            current = None

    def close(e: Element) -> None:
        """End e and what is open inside it."""
        nonlocal top, links, headings
        while top is not e.parent:
            if top.tag == "a":
                links -= 1
            elif top.tag in HEADINGS:
                headings -= 1
            if top.tag in BLOCKS:
                flush()
            open_tags[top.tag] -= 1
            top = top.parent

    while pos < n:
        got = scan.next(pos)
        text(page[pos:got[0]] if got else page[pos:])
        if not got:
            break
        _, pos, tag, ending, attributes, inner = got
        if not tag:
            text(inner)
            continue
        if ending:
            if tag == "br":
                text(" ")
            if open_tags[tag]:
                e = top
                while e.tag != tag:
                    e = e.parent
                close(e)
            elif tag == "p":
                flush()
            continue
        if tag in VOID or (attributes.endswith("/") and tag not in BLOCKS):
            if tag == "br":
                text(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in SKIPPED:
            if tag in BLOCKS:
                flush()
            if tag == "head":
                body = scan.behind("head", r"</head\s*>|<body[\s>]", pos)
                pos = (body.start() if body.group()[1] != "/" else body.end()) if body else pos
                continue
            end = scan.behind(tag, rf"</{re.escape(tag)}\s*>", pos)
            pos = end.end() if end else (n if tag in RAW else pos)
            continue
        if e := top.ended_by.get(tag) if tag in ENDS else None:
            close(e)
        if tag in BLOCKS:
            if e := top.ended_by.get("p"):
                close(e)
            flush()
        elif tag in ("td", "th"):
            text(" ")
        boiler, content, firm = _signs(tag, attributes, top)
        boiler, content, count = min(boiler, top.boiler), max(content, top.content), count + 1
        shut = top.shut or (firm and content > 0)
        content = 0.0 if shut else content
        top = Element(tag, boiler + content, boiler, content, shut, top.depth + 1, top, count)
        top.block, top.ended_by = top if tag in BLOCKS else top.parent.block, _ended_by(top)
        open_tags[tag] += 1
        links += tag == "a"
        headings += tag in HEADINGS
    if top is not root:
        close(_outermost(top))
    flush()
    _mark_readers(found)
    return found


def _mark_readers(found: list[Block]) -> None:
    """A short heading that announces the readers' part, if it opens a section
    of its own, makes that section boilerplate."""
    seen: dict[int, bool] = {}  # elements with a block so far: whether in a readers' part
    for b in found:
        path, e, section = [], b.parent, b.parent.parent
        if (b.parent.tag in HEADINGS and b.parent.tag != "h1" and section is not None and section.parent is not None
                and section.number not in seen and section.tag not in (*CONTENT_TAGS, "body", "html") and len(b.text) < 60 and READERS.match(b.text)):
            seen[section.number] = True
        while e is not None and e.number not in seen:
            path.append(e.number)
            e = e.parent
        b.readers = e is not None and seen[e.number]
        seen.update(dict.fromkeys(path, b.readers))


def _outermost(e: Element) -> Element:
    while e.parent is not None and e.parent.parent is not None:
        e = e.parent
    return e


def score(b: Block) -> float:
    """Log odds of content."""
    words = b.text.count(" ") + 1
    s = BASE + PER_LOG_WORD * min(5.0, words.bit_length()) + b.parent.score
    if b.readers:
        s += min(0.0, HINT - b.parent.boiler) - b.parent.content
    s += PROSE * (b.parent.tag in PROSE_TAGS) + SENTENCE * b.text.endswith(SENTENCE_END) + LINKS * min(1.0, b.linked / max(1, len(b.text)))
    if b.heading:
        s += HEADING
        if b.parent.boiler == BOILER_TAGS["header"] and b.parent.content >= CONTENT_TAGS["main"]:
            s -= BOILER_TAGS["header"]  # the heading of an article stands in its header
    return s


def tree_distance(a: Element, b: Element) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, weight)."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, ADJACENT / (1 + tree_distance(found[i - 1].parent, b.parent))))
        parent = b.parent.parent.number if b.parent.parent is not None else -1
        if parent in last and last[parent] != i - 1:
            out.append((last[parent], i, SIBLING))
        elif parent in last:
            out[-1] = (i - 1, i, out[-1][2] + SIBLING)
        last[parent] = i
    return out


def min_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a block pays |score| for the label against its
    sign, an edge its weight where labels differ. True is content."""
    n = len(scores)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in links:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    s, label = list(scores), [None] * n
    queue = deque(range(n))
    while queue:  # exact: a block that outweighs all its open edges keeps its sign
        i = queue.popleft()
        if label[i] is None and abs(s[i]) >= sum(near[i].values()):
            label[i] = s[i] > 0
            for j, w in near[i].items():
                s[j] += w if label[i] else -w
                del near[j][i]
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        content = _source_side(rest, s, near)
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label]


def _source_side(nodes: list[int], s: list[float], near: list[dict[int, float]]) -> set[int]:
    """Max-flow by shortest augmenting levels; the nodes still reached from the source."""
    source, sink = -1, -2
    cap: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        if s[i] > 0:
            cap[source][i], cap[i][source] = s[i], 0.0
        elif s[i] < 0:
            cap[i][sink], cap[sink][i] = -s[i], 0.0
    tiny = 1e-12
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return set(level) - {source}
        left = {u: list(c) for u, c in cap.items()}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(cap[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0.0) + flow
                path = path[:next(k for k, (a, b) in enumerate(zip(path, path[1:])) if cap[a][b] <= tiny) + 1]
                continue
            while left[u] and not (cap[u][left[u][-1]] > tiny and level.get(left[u][-1]) == level[u] + 1):
                left[u].pop()
            if left[u]:
                path.append(left[u][-1])
            else:
                path.pop()
                if path:
                    left[path[-1]].pop()


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    for b in found:
        b.score = score(b)
    keep = min_cut([b.score for b in found], edges(found))
    return "\n\n".join([b.text for b, k in zip(found, keep) if k])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in C.sliced(batches):
        got = [main_text(h) for h in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string()),
                                          pa.array([len(g) for g in got], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars per row: one pass over the scan, no shuffle."""
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return d.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(C.table(spark, sf_dir, "pages"))

"""Main text of web pages by a minimum cut: a classifier says how much each block looks like content, and neighbours in the page and in its tree pull together."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?/][^a-zA-Z>][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"'>]|$)""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that begin and end blocks of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead tr ul button select noscript template svg iframe object canvas audio video".split()
)
#: Elements whose text is never shown as text of the page.
SILENT = frozenset("button select noscript template svg iframe object canvas audio video".split())
#: Elements whose content isn't markup.
RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title", "textarea", "xmp")}
ENDED_BY = {"li": ("ul", "ol", "menu", "dir"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
SIBLINGS = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}

#: What names of elements, classes, ids and roles say about the text inside.
AROUND = frozenset(
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs masthead banner footer foot contentinfo sidebar sidebars aside complementary ad ads adv advert adverts advertisement advertising sponsor sponsored "
    "promo promos promotion cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay dialog newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations widget widgets comment comments reply replies respond responses discussion disqus toolbar pagination pager skip legal copyright form search searchbox tooltip".split()
)
#: Of these, an element that holds most of the page is still not the page.
FIRM = frozenset("comment comments reply replies respond responses discussion disqus nav navigation footer aside".split())
PAGE_HEAD = frozenset(("header", "topbar", "head"))
CONTENT = frozenset("article main content post entry story".split())
#: Weight of such a name against all that the text's own features can say together.
NAMED, UNNAMED = 8.0, 5.0
#: Weight of an edge between blocks with the same parent; it falls with the number of elements between them.
PULL = 1.0
#: Whole numbers that a capacity of 1 becomes.
UNIT = 1000
#: What is known before any page was seen, as so many blocks.
KNOWN = 20
PRIOR = {
    "words 1": -1.0, "words 3": -0.5, "words 6": 0.0, "words 13": 0.7, "words 31": 1.5, "links 0": 0.5, "links 1": 0.5, "links 2": -0.5, "links 3": -1.5, "ends": 0.7, "open": -0.5,
    "p": 1.0, "h": 0.5, "li": -0.5, "td": -0.2, "quote": 1.0, "other": -0.3, "sign": -2.0,
}


class Page:
    """The blocks of a page in order, each with its text, the elements around it and the share of its text in links."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.linked: list[float] = []
        self.element: list[int] = []  # of each block the innermost element
        self.apart: list[int] = []  # elements left and entered since the block before
        self.parent, self.tag, self.says = [-1], ["html"], [0]  # of each element; says: 1 content, -1 or -2 around it (-2 surely), -3 silent, 0 nothing
        self._open, self._names = [0], Counter()
        self._pieces: list[str] = []
        self._in_link, self._link_chars, self._lowest = False, 0, 1
        self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        while match := TAG.search(source, at):
            self._text(source[at : match.start()])
            at = match.end()
            name = (match[2] or match[5] or "").lower()
            if not name:
                continue
            if match[1] or match[4]:
                self._end(name)
            elif name in RAW:
                self._text(" ")
                close = RAW[name].search(source, at)
                at = close.start() if close else len(source)
            else:
                self._start(name, match[3] or match[6] or "")
        self._text(source[at:])
        self._flush()

    def _text(self, piece: str) -> None:
        if piece:
            self._pieces.append(piece)
            if self._in_link:
                self._link_chars += len(piece)

    def _flush(self) -> None:
        raw = "".join(self._pieces)
        text = " ".join(html.unescape(raw).split())
        if text:
            self.texts.append(text)
            self.linked.append(min(1.0, self._link_chars / len(raw)))
            self.element.append(self._open[-1])
            self.apart.append(self._before - self._lowest + len(self._open) - self._lowest if len(self.texts) > 1 else 0)
            self._before = self._lowest = len(self._open)
        self._pieces, self._link_chars = [], 0

    _before = 1

    def _pop(self) -> str:
        name = self.tag[self._open.pop()]
        self._names[name] -= 1
        self._lowest = min(self._lowest, len(self._open))
        return name

    def _start(self, name: str, attributes: str) -> None:
        if name not in BLOCKS:
            if name == "br":
                self._text(" ")
            elif name == "a":
                self._in_link = True
            return
        self._flush()
        if name == "hr":
            return
        if self.tag[self._open[-1]] == "p":
            self._pop()
        same = SIBLINGS.get(name, (name,))
        if name in ENDED_BY and any(self._names[s] for s in same):
            for i in range(len(self._open) - 1, 0, -1):
                tag = self.tag[self._open[i]]
                if tag in same:
                    while len(self._open) > i:
                        self._pop()
                if tag in same or tag in ENDED_BY[name]:
                    break
        self.parent.append(self._open[-1])
        self.tag.append(name)
        self.says.append(named(name, attributes))
        self._open.append(len(self.tag) - 1)
        self._names[name] += 1

    def _end(self, name: str) -> None:
        if name == "a":
            self._in_link = False
        if name in BLOCKS:
            self._flush()
            if self._names[name]:
                while self._pop() != name:
                    pass


def named(name: str, attributes: str) -> int:
    """What an element's name, classes, id and role say."""
    if name in SILENT:
        return -3
    if name in ("html", "body"):
        return 0
    words = {name}
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "hidden" or m[1].lower() == "aria-hidden" and value == "true":
                return -3
            words.update(w.lower() for w in WORDS.findall(value))
    if words & AROUND:
        return -2 if words & FIRM else -1
    if words & CONTENT:
        return 1
    return -1 if words & PAGE_HEAD else 0


def markers(page: Page) -> list[int]:
    """Of each block what the elements around it say: -3 silent, -2 or -1 boilerplate, 1 content, 0 nothing.

    Boilerplate inside content, and content inside boilerplate, are boilerplate, but for two cases: an element with more than half of the page's text and all of what is named content is a mere wrapper, and a header
    inside content says nothing.
    """
    chars = [0] * len(page.tag)
    for element, text in zip(page.element, page.texts, strict=True):
        chars[element] += len(text)
    for e in range(len(page.tag) - 1, 0, -1):
        chars[page.parent[e]] += chars[e]
    inside = [False] * len(page.tag)  # in content
    content = [0] * len(page.tag)  # characters in content
    for e in range(1, len(page.tag)):
        inside[e] = inside[page.parent[e]] or page.says[e] == 1
    for e in range(len(page.tag) - 1, 0, -1):
        content[page.parent[e]] += chars[e] if page.says[e] == 1 else content[e]
    say = [0] * len(page.tag)
    for e in range(1, len(page.tag)):
        above, own = say[page.parent[e]], page.says[e]
        if own == -1 and (page.tag[e] == "header" and inside[e] or 2 * chars[e] > chars[0] and content[e] == content[0]):
            own = 0
        say[e] = min(above, own) if above < 0 or own < 0 else max(above, own)
    return [say[e] for e in page.element]


def features(page: Page, i: int) -> list[str]:
    """What the text of a block shows on its own."""
    text, linked, tag = page.texts[i], page.linked[i], page.tag[page.element[i]]
    words = text.count(" ") + 1
    found = [
        f"words {31 if words > 30 else 13 if words > 12 else 6 if words > 5 else 3 if words > 2 else 1}",
        f"links {0 if not linked else 1 if linked < 0.3 else 2 if linked < 0.7 else 3}",
        "ends" if text[-1] in ".!?:;\"')»”" else "open",
        tag if tag in ("p", "li") else "h" if tag in ("h1", "h2", "h3", "h4", "h5", "h6") else "td" if tag in ("td", "th", "dd", "dt") else "quote" if tag in ("blockquote", "pre") else "other",
    ]
    return found + ["sign"] if "©" in text or "®" in text else found


def evidence(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Log-odds of each feature: blocks that elements name as content against those that they name as boilerplate, over all pages, with PRIOR as KNOWN blocks of each kind."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for source in batch.column("html"):
                page = Page(source.as_py() or "")
                for i, mark in enumerate(markers(page)):
                    if mark in (1, -1, -2):
                        kind = 1 if mark == 1 else -1
                        seen.update((f, kind) for f in features(page, i))
                        seen["", kind] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.string()), pa.array([m for _, m in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["feature", "mark", "n"])

    rows = pages.select(F.col(html_col).alias("html")).mapInArrow(count, "feature string, mark int, n long").groupBy("feature", "mark").agg(F.sum("n").alias("n")).collect()
    seen = Counter({(r.feature, r.mark): r.n for r in rows})
    odds = {}
    for f, prior in PRIOR.items():
        share = 1 / (1 + math.exp(-prior))
        content = (seen[f, 1] + KNOWN * share) / (seen["", 1] + KNOWN)
        around = (seen[f, -1] + KNOWN * (1 - share)) / (seen["", -1] + KNOWN)
        odds[f] = max(-2.0, min(2.0, math.log(content / around)))
    return odds


def costs(page: Page, odds: dict[str, float]) -> list[int]:
    """Capacity of each block's terminal edge: above 0 from the source, which is content, below 0 to the sink."""
    out = []
    for i, mark in enumerate(markers(page)):
        own = sum(odds[f] for f in features(page, i))
        out.append(-(1 << 40) if mark == -3 else round(UNIT * (NAMED * max(mark, -1) + max(-UNNAMED, min(UNNAMED, own)))))
    return out


def edges(page: Page) -> list[tuple[int, int, int]]:
    """(block, block, capacity) of neighbours in the page, weaker the more elements lie between them, and of blocks next to each other among those of one parent."""
    out, last = [], {}
    for i, element in enumerate(page.element):
        if i:
            out.append((i - 1, i, round(UNIT * PULL / (1 + max(0, page.apart[i] - 2)))))
        parent = page.parent[element]
        before = last.get(parent)
        if before is not None and before < i - 1:
            out.append((before, i, round(UNIT * PULL / 2)))
        last[parent] = i
    return out


def cut(cost: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """The labelling, True for content, of the least sum of the costs of labels against the blocks' own and of the links between unlike labels; of several, the one with most content.

    A block whose own cost outweighs all its links has that label in every such labelling, so its links become costs of its neighbours. What stays open falls into small parts, each solved by augmenting paths.
    """
    n = len(cost)
    net, near = list(cost), [{} for _ in range(n)]
    for a, b, c in links:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    pull = [sum(x.values()) for x in near]
    label: list[bool | None] = [None] * n
    ready = [i for i in range(n) if abs(net[i]) > pull[i] or not pull[i]]
    while ready:
        i = ready.pop()
        if label[i] is not None:
            continue
        label[i] = net[i] >= 0
        for j, c in near[i].items():
            if label[j] is None:
                net[j] += c if label[i] else -c
                pull[j] -= c
                if abs(net[j]) > pull[j] or not pull[j]:
                    ready.append(j)
    for i in range(n):
        if label[i] is None:
            part, queue = {i}, [i]
            while queue:
                for j in near[queue.pop()]:
                    if label[j] is None and j not in part:
                        part.add(j)
                        queue.append(j)
            for j, content in _flow(sorted(part), net, near).items():
                label[j] = content
    return [bool(x) for x in label]


def _flow(part: list[int], net: list[int], near: list[dict[int, int]]) -> dict[int, bool]:
    """Maximum flow through a part from blocks with capacity left to those with capacity missing, by levels; what can't reach the sink any more is content."""
    inside = set(part)
    left = {i: {j: c for j, c in near[i].items() if j in inside} for i in part}
    gives, takes = {i: max(net[i], 0) for i in part}, {i: max(-net[i], 0) for i in part}
    while True:
        level = {i: 0 for i in part if takes[i]}  # steps to the sink
        queue = deque(level)
        while queue:
            j = queue.popleft()
            for i in left[j]:
                if i not in level and left[i].get(j):
                    level[i] = level[j] + 1
                    queue.append(i)
        begins = [i for i in part if gives[i] and i in level]
        if not begins:
            return {i: i not in level for i in part}
        todo = {i: list(left[i]) for i in level}
        for begin in begins:
            path = [begin]
            while path and gives[begin]:
                i = path[-1]
                if takes[i]:
                    much = min(gives[begin], takes[i], *(left[a][b] for a, b in zip(path, path[1:])))
                    gives[begin] -= much
                    takes[i] -= much
                    for a, b in zip(path, path[1:]):
                        left[a][b] -= much
                        left[b][a] += much
                    path = [begin]
                    continue
                while todo[i] and not (left[i][todo[i][-1]] and level.get(todo[i][-1], -2) == level[i] - 1):
                    todo[i].pop()
                if todo[i]:
                    path.append(todo[i][-1])
                else:
                    path.pop()
                    if path:
                        todo[path[-1]].pop()


def main_text(source: str, odds: dict[str, float]) -> tuple[str, int, int]:
    """A page's content, its number of blocks and of those kept."""
    page = Page(source)
    kept = [t for t, content in zip(page.texts, cut(costs(page, odds), edges(page)), strict=True) if content]
    return "\n".join(kept), len(page.texts), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) of every row.

    A page's tags are read into blocks of text with the elements around them; elements may be left open and references unended. Character references are decoded, white space inside a block becomes one
    space, and the blocks that are content are joined by line ends. Features of blocks are counted over all pages for the classifier, whose few weights go to all tasks; then each page is cut on its own.

    A null or empty page, and one without content, has an empty text; ids and urls pass as they are; repeated rows each have their result, and equal pages equal ones. An empty table gives no rows.
    """
    odds = evidence(pages, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(source.as_py() or "", odds) for source in batch.column("html")]
            texts, blocks, kept = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(blocks, pa.int64()), pa.array(kept, pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")

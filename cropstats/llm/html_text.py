"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each under its path of open block elements
from the root. Text length, punctuation and link text are summed per path; a
path's ratio is its text per block, weighted by punctuation and lessened by
links. Ratios are smoothed over neighbouring blocks, fused with the path's own,
and paths above a threshold taken from their spread and middle are content. Of
the blocks under the nearest common element of the content blocks those stay
that are content or stand among it and are not mostly links; before it a title
and what follows it, after it lists, tables and headings. An ``article`` or
``main`` element that holds all content is kept whole.

Menus, footers and other elements that HTML itself marks as no article, and
elements whose class, id or role names such a thing as its last word (an advert,
reader comments), are left out. Where a name only holds such a word beside others
(``ad-free``), and for forms, ratios decide: the element stays if it holds
at least half of the page's sentences. Names of which it is a small part mean nothing.

Defined cases: null html counts as empty and gives an empty text; a page
without article gives an empty text; broken or cut-off tags end where the page
ends; character references are decoded, unknown ones stay as they are; a null
url stays null; repeated rows each get their text; an empty table gives no row;
extra columns are not read. Time and memory grow with the page, however deep its
elements are nested.
"""

from __future__ import annotations

import html as references
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cropstats.llm import batches

SCHEMA = "page_id long, url string, text string, n_chars long"

# Names of HTML elements, and words in classes, ids and roles.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg math object canvas audio video select".split())
_NEVER = frozenset("head nav footer aside button fieldset dialog menu header".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table tbody thead tfoot".split())
_ALWAYS_NOISE = frozenset("ad ads advert advertisement adverts advertising sponsor sponsored promo promotion comment comments commentlist disqus cookie cookies consent newsletter subscribe popup modal share sharing social notice notices alert".split())
_NOISE = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header masthead banner footer sidebar aside related recommended widget toolbar pagination pager search login signup complementary contentinfo form".split())
_CONTENT = frozenset("article content main post entry story".split())
_FRAME = frozenset("area bar bottom box block center container inner item items left list links outer page panel right row section site top wrap wrapper".split())
_LISTED = frozenset("li dt dd td th caption figcaption blockquote pre h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMING = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I | re.S)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟¿¡]")


#: What an element's name says of it: nothing, that ratios have to decide, that it is no article.
PLAIN, DOUBTED, NOISE = 0, 1, 2


class Block:
    """One block of text: its path, the element it stands in, and what it counts."""

    __slots__ = ("path", "element", "text", "chars", "marks", "linked")

    def __init__(self, path: int, element: int, text: str, linked: int):
        self.path, self.element, self.text = path, element, text
        self.chars, self.marks, self.linked = len(text), len(_PUNCTUATION.findall(text)), min(linked, len(text))

    @property
    def sentences(self) -> int:
        """Characters outside links of a block with punctuation."""
        return self.chars - self.linked if self.marks else 0


class Elements:
    """The block elements of a page: tag, parent, path and what the name says, by number; 0 is the page itself."""

    def __init__(self):
        self.tag, self.parent, self.path, self.depth, self.level = [""], [0], [0], [0], [PLAIN]
        self._paths: dict[tuple[int, str], int] = {}

    def add(self, tag: str, parent: int, level: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(self._paths.setdefault((self.path[parent], tag), len(self._paths) + 1))
        self.depth.append(self.depth[parent] + 1)
        self.level.append(level)
        return len(self.tag) - 1

    def common(self, blocks: list[Block]) -> int:
        """The nearest element that holds all blocks, and is not one of theirs."""
        held = [0] * len(self.tag)
        for b in blocks:
            held[self.parent[b.element]] += 1
        found = 0
        for i in range(len(held) - 1, 0, -1):  # parents have smaller numbers
            if held[i] == len(blocks):
                found = max(found, i)
            held[self.parent[i]] += held[i]
        return found

    def inside(self, outer: int) -> list[bool]:
        """For each element, whether ``outer`` holds it or is it."""
        out = [outer == 0] * len(self.tag)
        for i in range(1, len(out)):
            out[i] = i == outer or out[self.parent[i]]
        return out


def _level(tag: str, attributes: str) -> int:
    """What tag, class, id and role say of an element."""
    if tag in _NEVER or _HIDDEN.search(attributes):
        return NOISE
    if tag in ("html", "body"):
        return PLAIN
    names = [[w for w in _WORDS.findall(name) if w not in _FRAME] for m in _NAMING.finditer(attributes) for name in next(x for x in m.groups() if x is not None).lower().split()]
    content = tag in ("article", "main") or any(w in _CONTENT for words in names for w in words)
    level = DOUBTED if tag == "form" else PLAIN
    for words in names:
        found = [w in _ALWAYS_NOISE or not content and w in _NOISE for w in words]
        if any(found) and (found[-1] and (len(words) <= 2 or all(found)) or all(found)):
            return NOISE
        if sum(found) * 2 >= len(words) > 0 and not content:
            level = DOUBTED
    return level


def blocks(page: str) -> tuple[list[Block], Elements]:
    """The blocks of a page in order, without those in noise, and its elements."""
    out: list[Block] = []
    elements = Elements()
    stack: list[tuple[str, int, bool, list[tuple[str, bool]]]] = [("", 0, False, [])]  # tag, number, noise, open inline elements
    open_tags: dict[str, int] = defaultdict(int)
    pending: list[str] = []
    linked = links = hidden = 0

    def flush() -> None:
        nonlocal linked
        if pending:
            text = " ".join("".join(pending).split())
            if text:
                number = stack[-1][1]
                out.append(Block(elements.path[number], number, text, linked))
            pending.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not hidden and not stack[-1][2]:
            text = references.unescape(raw) if "&" in raw else raw
            pending.append(text)
            if links:
                linked += len(text.strip())

    def leave(inline: tuple[str, bool]) -> None:
        nonlocal links, hidden
        links -= inline[0] == "a"
        hidden -= inline[1]

    def close(names: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        if not any(open_tags[t] for t in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                flush()
                for tag, _, _, inlines in stack[k:]:
                    open_tags[tag] -= 1
                    for inline in inlines:
                        leave(inline)
                del stack[k:]
                return
            if stack[k][0] in stop:
                return

    at = 0
    while (m := _TAG.search(page, at)) is not None:
        add(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, ends, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if ends:
            if tag in _INLINE:
                inlines = stack[-1][3]
                for k in range(len(inlines) - 1, -1, -1):
                    if inlines[k][0] == tag:
                        leave(inlines.pop(k))
                        break
            elif open_tags[tag]:
                close({tag})
            else:
                flush()
            continue
        if tag in _RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag in _VOID or attributes.rstrip().endswith("/") and tag not in _INLINE:
            if tag == "br":
                add(" ")
            elif tag not in _INLINE:
                flush()
            continue
        level = _level(tag, attributes) if attributes or tag in _NEVER or tag == "form" else PLAIN
        if tag in _INLINE:
            stack[-1][3].append((tag, level == NOISE))
            links += tag == "a"
            hidden += level == NOISE
            continue
        flush()
        if stack[-1][0] == "p":
            close({"p"})
        if tag in _CLOSED_BY:
            close(_CLOSED_BY[tag], _SCOPES)
        number = elements.add(tag, stack[-1][1], level)
        open_tags[tag] += 1
        stack.append((tag, number, stack[-1][2] or level == NOISE, []))
    add(page[at:])
    flush()
    return _undoubted(out, elements), elements


def _undoubted(found: list[Block], elements: Elements) -> list[Block]:
    """The blocks without those of doubted elements that hold less than half of the page's sentences."""
    if DOUBTED not in elements.level:
        return found
    mass, many = [0] * len(elements.tag), [0] * len(elements.tag)
    for b in found:
        mass[b.element] += b.sentences
        many[b.element] += b.sentences > 0
    for i in range(len(mass) - 1, 0, -1):  # parents have smaller numbers
        mass[elements.parent[i]] += mass[i]
        many[elements.parent[i]] += many[i]
    gone = [False] * len(mass)
    for i in range(1, len(mass)):
        holds = mass[i] > 0 and 2 * mass[i] >= mass[0] and (elements.tag[i] != "form" or many[i] > 1)
        gone[i] = gone[elements.parent[i]] or elements.level[i] == DOUBTED and not holds
    return [b for b in found if not gone[b.element]]


def path_scores(found: list[Block]) -> dict[int, float]:
    """Fused ratio of each path: its own text-and-punctuation ratio, and that of the smoothed page around its blocks."""
    totals: dict[int, list[float]] = defaultdict(lambda: [0.0] * 4)
    for b in found:
        t = totals[b.path]
        for k, v in enumerate((b.chars, b.marks, b.linked, 1)):
            t[k] += v
    ratio = {p: (c / n) * (1 + m / n) * (1 - linked / max(c, 1)) for p, (c, m, linked, n) in totals.items()}
    row = np.array([ratio[b.path] for b in found])
    kernel = np.exp(-0.5 * (np.arange(-2, 3) ** 2))
    weight = np.convolve(np.ones(len(row)), kernel, "same")[: len(row)] if len(row) >= 5 else np.ones(len(row))
    smooth = np.convolve(row, kernel, "same") / weight if len(row) >= 5 else row
    around: dict[int, list[float]] = defaultdict(list)
    for b, s in zip(found, smooth.tolist(), strict=True):
        around[b.path].append(s)
    return {p: float(np.sqrt(max(r, 0.0) * np.mean(around[p]))) for p, r in ratio.items()}


def main_text(page: str) -> str:
    """The article's blocks joined by line feeds; empty if there is none."""
    found, elements = blocks(page)
    if not found:
        return ""
    scores = path_scores(found)
    spread = np.array([scores[b.path] for b in found])
    order = np.argsort(spread)
    chars = np.cumsum(np.array([b.chars for b in found])[order])
    middle = float(spread[order[np.searchsorted(chars, chars[-1] / 2)]])  # half of the text scores less
    threshold = min(max(float(spread.std()), 0.5 * middle), 0.5 * float(spread.max()))
    chosen = {p for p, s in scores.items() if s > 0 and s >= threshold}
    content = [b for b in found if b.path in chosen]
    if not content:
        return ""
    common = elements.common(content)
    # an article element that holds all content is kept whole
    outer, whole = common, 0
    while outer:
        if elements.tag[outer] in ("article", "main"):
            whole = outer
        outer = elements.parent[outer]
    inside = elements.inside(whole or common)
    near = [b for b in found if inside[b.element]]
    if not whole:
        near = _trimmed(near, chosen, elements)
    return "\n".join(b.text for b in near)


def _trimmed(near: list[Block], chosen: set[int], elements: Elements) -> list[Block]:
    """The content, what stands among it, a title before it, and lists, tables and headings after it; nothing that is mostly links."""
    places = [k for k, b in enumerate(near) if b.path in chosen]
    first, last = places[0], places[-1]
    titles = [k for k in range(first) if elements.tag[near[k].element] in ("h1", "h2") and near[k].linked * 2 < near[k].chars]
    first = max((k for k in titles if elements.tag[near[k].element] == "h1"), default=titles[-1] if titles else first)
    while last + 1 < len(near) and elements.tag[near[last + 1].element] in _LISTED and near[last + 1].linked * 2 < near[last + 1].chars:
        last += 1
    return [b for k, b in enumerate(near) if b.path in chosen or first <= k <= last and b.linked * 2 < b.chars]


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page; one narrow pass without a shuffle."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches.pieces(parts, "html"):
            texts = [main_text(x) for x in batches.strings(part, "html")]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return batches.mapped(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), run, SCHEMA)

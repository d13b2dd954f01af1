"""Main text of web pages, by two passes over their blocks.

A page is cut into blocks: the text between tags that begin or end a line. The first pass
looks at each block alone. What the markup declares as something else (menus, forms,
adverts, comments and so on) is left out; of the rest, the share of linked text, the
length and the share of stop words decide, and what is too short or too plain for them
stays open. The second pass gives open blocks the label of the nearest decided block of
their region, where a region is one declared article or all that lies outside of one.

A page is cut in one pass over its characters; both passes of rules run over the blocks
of a whole Arrow batch.
"""

import html as references
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from eventscope.llm.frames import add_columns

# --- fixed values -------------------------------------------------------------

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is text without tags, and is not shown as text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CONTAINERS = frozenset(
    "html body main article section div nav aside header footer form fieldset ul ol dl menu table thead "
    "tbody tfoot tr td th caption figure blockquote details dialog address".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre".split())
BLOCKS = CONTAINERS | PARAGRAPHS | frozenset("li dt dd hr figcaption summary legend option optgroup center".split())
# One of these ends an open one of the same kind, up to the list or table that holds it.
ITEMS = frozenset("li dt dd option tr td th".split())

NOT_CONTENT = frozenset(
    "nav aside footer form menu dialog noscript template button select option label svg canvas object audio "
    "video map math head".split()
)
ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split()
)
# The last word of a class or id, as in "article-comments".
NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead footer sidebar aside "
    "banner notice notices popup modal overlay consent newsletter subscribe subscription signup login promo "
    "comment comments replies disqus share sharing social related recommended recommendations widget widgets "
    "toolbar copyright disclaimer".split()
)
# Any word of a class or id.
ADVERTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies gdpr".split()
)
# A page that says it has a sidebar is not one.
SAYS_IT_HAS = frozenset("has with without no show hide is".split())

STOP_WORDS = frozenset(
    # English
    "the of and to a in is it that for on with as was be by at from this are or an have not which but his her "
    "they had has he she we you were been their will would there what so if can more when who its "
    # German
    "der die das und ist in zu den von mit dem nicht ein eine für auf sich im des als auch es an werden aus er "
    "hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor "
    # French
    "le la les de des et à un une du en est que qui dans pour pas sur au par plus ce il se ne sont avec son "
    "ou mais comme aux cette elle nous vous leur ses sa être fait été ont tout "
    # Spanish
    "el los las y o que en un una por con no para su al lo como más pero sus le ya este sí porque esta entre "
    "cuando muy sin sobre también me hasta hay donde desde todo nos durante".split()
)


@dataclass(frozen=True)
class Rules:
    """``short``: characters below which a block decides nothing by itself. ``links`` and
    ``links_in_article``: share of linked characters above which a block is not content.
    ``stops``: share of stop words from which it is. ``known``: share of them below which a
    page's language is taken for another one, and ``long`` is asked for instead."""

    short: int = 70
    long: int = 140
    links: float = 0.2
    links_in_article: float = 0.5
    stops: float = 0.3
    known: float = 0.1


# --- cutting ------------------------------------------------------------------

TAG = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
QUOTED_OR_END = re.compile(r"=\s*([\"'])|>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"class|id|role|hidden|itemprop|style", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends the tag; without one, of the page's end."""
    while True:
        found = QUOTED_OR_END.search(page, at)
        if found is None:
            return len(page)
        if found[1] is None:
            return found.start()
        closed = page.find(found[1], found.end())
        if closed < 0:
            end = page.find(">", found.end())
            return len(page) if end < 0 else end
        at = closed + 1


def _told(name: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether the tag declares its content as something else, as the article, as a header."""
    other, article, header = name in NOT_CONTENT, name in ("article", "main"), name == "header"
    if not TELLING.search(attributes):
        return other, article, header
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            other = True
        elif key == "style":
            other |= "display:none" in value.replace(" ", "")
        elif key == "role":
            other |= value in ROLES
            article |= value in ("main", "article")
        elif key == "itemprop":
            article |= value == "articlebody"
        elif key in ("class", "id") and name not in ("html", "body", "main"):
            for one in value.split():
                words = WORD.findall(one)
                if words and words[0] not in SAYS_IT_HAS:
                    other |= words[-1] in NAMES or not ADVERTS.isdisjoint(words)
                    header |= words[-1] == "header"
    return other, article, header


class _Page:
    """The blocks of a page, while its tags go by."""

    def __init__(self):
        self.blocks: list[tuple[str, int, int, bool]] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        # Open tags: name, and what they tell.
        self.open: list[tuple[str, tuple[bool, bool, bool]]] = []
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []
        self.others = self.articles = self.region = self.regions = self.links = 0
        self.headers = self.heading = 0

    def text(self, piece: str) -> None:
        # A header inside an article holds its title.
        if self.others or (self.headers and not (self.heading and self.articles)):
            return
        if "&" in piece:
            piece = references.unescape(piece)
        self.parts.append(piece)
        if self.links:
            self.linked.append(piece)

    def end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            linked = len(" ".join("".join(self.linked).split())) if self.linked else 0
            self.blocks.append((text, linked, self.region if self.articles else 0, self.heading > 0))
        self.parts.clear()
        self.linked.clear()

    def _count(self, name: str, told: tuple[bool, bool, bool], step: int) -> None:
        if name == "a":
            self.links += step
        elif name in HEADINGS:
            self.heading += step
        other, article, header = told
        self.others += step * other
        self.headers += step * header
        if article:
            if step > 0 and not self.articles:
                self.regions += 1
                self.region = self.regions
            self.articles += step

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            name, told = self.open.pop()
            self.places[name].pop()
            if name in CONTAINERS:
                self.containers.pop()
            self._count(name, told, -1)

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.end_block()
            innermost = self.containers[-1] if self.containers else -1
            for kind in PARAGRAPHS:
                places = self.places.get(kind)
                if places and places[-1] > innermost:
                    self._pop_to(places[-1])
            if name in ITEMS:
                places = self.places.get(name)
                holders = [p[-1] for k in ("ul", "ol", "dl", "menu", "table", "select") if (p := self.places.get(k))]
                if places and places[-1] > max(holders, default=-1):
                    self._pop_to(places[-1])
            if name in ("main", "article"):
                # A menu or header that was never closed ends where the article begins.
                unclosed = [p[0] for k in ("nav", "header") if (p := self.places.get(k))]
                if unclosed:
                    self._pop_to(min(unclosed))
        elif name == "br":
            self.parts.append(" ")
        elif name == "a" and self.links:
            # Links do not nest.
            place = self.places["a"][-1]
            if place > (self.containers[-1] if self.containers else -1):
                self._pop_to(place)
        if name in VOID:
            return
        told = _told(name, attributes)
        if name in CONTAINERS:
            self.containers.append(len(self.open))
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append((name, told))
        self._count(name, told, 1)

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.end_block()
        places = self.places.get(name)
        if not places:
            return
        innermost = self.containers[-1] if self.containers else -1
        if name in CONTAINERS or places[-1] > innermost:
            self._pop_to(places[-1])


def cut(page: str) -> list[tuple[str, int, int, bool]]:
    """Blocks in page order, without what the markup declares as something other than
    content: text, linked characters, the number of its article (0: outside of any), and
    whether it is a heading."""
    state, at, size = _Page(), 0, len(page)
    while at < size:
        found = TAG.search(page, at)
        if found is None:
            state.text(page[at:])
            break
        if found.start() > at:
            state.text(page[at : found.start()])
        comment, closing, name = found.groups()
        if comment:
            # "<!-->" and "<!--->" are whole.
            whole = re.compile("-?>").match(page, found.end())
            end = whole.end() - 1 if whole else page.find("-->", found.end())
            at = size if end < 0 else (end + 1 if whole else end + 3)
            continue
        if name is None:
            end = page.find(">", found.end())
            at = size if end < 0 else end + 1
            continue
        end, name = _tag_end(page, found.end()), name.lower()
        at = end + 1
        if end >= size:
            break
        if closing:
            state.end(name)
        elif name in RAW:
            over = RAW_END[name].search(page, at)
            at = size if over is None else _tag_end(page, over.end()) + 1
        else:
            state.start(name, page[found.end() : end])
    state.end_block()
    return state.blocks


# --- rules --------------------------------------------------------------------

OPEN, NO, YES = -1, 0, 1


def _first_pass(chars, linked, region, stops, words, page, pages, marked, rules: Rules) -> np.ndarray:
    """Labels by the block alone."""
    inside = region > 0
    density = stops / np.maximum(words, 1)
    of_page = [np.bincount(page, weights=w, minlength=pages) for w in (stops, words)]
    known = (of_page[0] >= rules.known * np.maximum(of_page[1], 1))[page]
    label = np.full(len(chars), OPEN, dtype=np.int8)
    lengthy = chars >= rules.short
    label[lengthy & (density >= rules.stops)] = YES
    label[lengthy & ~inside & known & (density < rules.stops)] = NO
    label[~known & ~inside & (chars >= rules.long)] = YES
    share = linked / np.maximum(chars, 1)
    label[share > np.where(inside, rules.links_in_article, rules.links)] = NO
    label[~inside & ((~lengthy & (linked > 0)) | marked)] = NO
    return label


def _second_pass(label, region, page, heading) -> np.ndarray:
    """Open blocks take the label of the nearest decided one of their region, headings that
    of the next one, if there is one. If two are equally near, or none is decided, a block is
    content if it is in an article. A page with neither article nor decided block is content
    as a whole."""
    n = len(label)
    if not n:
        return label
    decides = label != OPEN
    # Blocks of a region may have others between them.
    order = np.lexsort((np.arange(n), region, page))
    label, decides, where, of = label[order], decides[order], np.arange(n), page[order] * (region.max() + 1) + region[order]
    starts = np.concatenate([[True], of[1:] != of[:-1]])
    first = np.maximum.accumulate(np.where(starts, where, 0))
    last = n - 1 - np.maximum.accumulate(np.where(np.concatenate([starts[1:], [True]])[::-1], where, 0))[::-1]
    before = np.maximum.accumulate(np.where(decides, where, -1))
    after = n - 1 - np.maximum.accumulate(np.where(decides[::-1], where, -1))[::-1]
    far = n + 1
    back = np.where(before >= first, where - before, far)
    ahead = np.where((after <= last) & (after < n), after - where, far)
    back = np.where(heading[order] & (ahead < far), far, back)
    inside = region[order] > 0
    near = np.where(back < ahead, label[np.clip(before, 0, n - 1)], label[np.clip(after, 0, n - 1)])
    agree = label[np.clip(before, 0, n - 1)] == label[np.clip(after, 0, n - 1)]
    has_article = np.zeros(page.max() + 1, dtype=bool)
    has_article[page[region > 0]] = True
    nothing = np.where(inside | ~has_article[page[order]], YES, NO)
    settled = np.where(
        (back == far) & (ahead == far), nothing, np.where((back == ahead) & ~agree, np.where(inside, YES, NO), near)
    )
    out = np.empty(n, dtype=np.int8)
    out[order] = np.where(label == OPEN, settled, label)
    return out


def labelled(pages: list[str], rules: Rules = Rules()) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts of all blocks of ``pages``, the page of each, and whether it is content."""
    texts, linked, region, page, heading = [], [], [], [], []
    for i, one in enumerate(pages):
        for block in cut(one):
            texts.append(block[0])
            linked.append(block[1])
            region.append(block[2])
            heading.append(block[3])
            page.append(i)
    if not texts:
        return [], np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    split = [t.lower().split() for t in texts]
    stops = np.array([sum([w in STOP_WORDS for w in s]) for s in split])
    words = np.array([len(s) for s in split])
    chars = np.array([len(t) for t in texts])
    marked = np.array(["©" in t for t in texts])
    linked, region, page = np.array(linked), np.array(region), np.array(page)
    label = _first_pass(chars, linked, region, stops, words, page, len(pages), marked, rules)
    return texts, page, _second_pass(label, region, page, np.array(heading)) == YES


def main_text(df: DataFrame, html: str = "html", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``df`` with the main text of the page in ``html``: its content blocks in page order, a
    line each, white space as single blanks, character references decoded.

    A null or empty page, and one without content, has an empty text. A column of ``df``
    that is called ``text`` is replaced; all others are kept, whatever their names. A page
    is one row of one task, however long; rows that are alike are each treated alone.
    """

    def make(batch):
        pages = [page or "" for page in batch.column(html).to_pylist()]
        texts, page, content = labelled(pages, rules)
        lines: list[list[str]] = [[] for _ in pages]
        for i in np.flatnonzero(content):
            lines[page[i]].append(texts[i])
        return [pa.array(["\n".join(x) for x in lines], pa.string())]

    return add_columns(df, make, [T.StructField(text, T.StringType())])

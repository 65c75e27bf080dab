"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; block tags end a line. Every visible line, whatever
element it is in, has its characters outside links per tag. The logarithms of these ratios are
smoothed over neighbouring lines by a Gaussian, and two-means clustering sets the threshold between
content and the rest; no name of an element or class takes part in this. The content lines vote for
the region by their characters: the least element that has nearly all of them. The region's lines
are the text; past its first and last content line only those that aren't mostly links, and where
nothing less than the body has the votes, only headings and siblings of content.

Names come second and only take away: lines in elements that are named like boilerplate (menus,
adverts, comments) have no vote and aren't text, and a region inside an article or main element is
all of that element. ``names=False`` does without them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyspark.plans.session import ship_code
from tallyspark.plans.tables import table

FEED_CHARS = 1 << 16
SIGMA = 1.0
#: Two clusters count as one where the lower mean is above this part of the upper one.
APART = 0.5
#: Share of the content characters that an element may lack and still be the region.
SLACK = 0.1
#: Characters of a form for each of its controls from which on it is a frame of the page, not a form.
FRAME_CHARS = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text no reader sees as text of the page.
SILENT = frozenset("head title script style noscript template iframe object svg math canvas audio video map select option textarea button datalist dialog".split())
HINTED = frozenset("nav footer aside menu fieldset label legend".split())
ROLES = frozenset("navigation banner contentinfo search complementary dialog alertdialog alert menu menubar toolbar form note status".split())
#: Words of class names and ids that hint at boilerplate, and words that may stand beside them.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertorial sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus "
    "breadcrumb breadcrumbs header masthead footer sidebar sidebars aside rail widget widgets comment comments commentlist disqus respond reply replies discussion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations pagination pager toolbar tags hidden skip copyright legal disclaimer form search".split()
)
COMMON = frozenset(
    "area article articles bar block blog body bottom box boxes button buttons card cards column container content control feed field global google group heading holder icon icons "
    "info inner input item items left link links list main message new news outer page pages panel post posts primary region right row secondary section site slot stories strip text "
    "to top unit user web wrap wrapper zone".split()
)
HEADERS = frozenset("header masthead banner".split())
SECTIONS = frozenset("article main".split())
#: What a start tag closes when it is open in the same block.
CLOSES = {
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"},
}
SCOPES = frozenset("body div section article main aside nav header footer ul ol dl table td th form blockquote figure".split())
BREAKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Element:
    """``hint``: 2 boilerplate by name, 1 a header by name, 0 neither, of the element alone; ``hinted`` with its ancestors'."""

    __slots__ = ("tag", "parent", "silent", "hint", "hinted", "under_header", "order", "chars", "size", "controls")

    def __init__(self, tag, parent, silent, hint, order):
        self.tag, self.parent, self.silent, self.hint, self.order = tag, parent, silent, hint, order
        self.hinted = self.under_header = False
        self.chars = 0.0
        self.size = self.controls = 0


def _hint_of_names(value: str) -> int:
    """The hint of a class or id: a word of ``NOISE`` whose fellows are all common ones."""
    found = 0
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        noise = NOISE.intersection(words)
        if noise and all(w in NOISE or w in COMMON or len(w) == 1 for w in words):
            found = max(found, 1 if noise <= HEADERS else 2)
    return found


class _Lines(HTMLParser):
    """Turns events into lines: [text, tags, characters inside links, element]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", None, False, 0, 0)
        self.elements = [self.root]
        self.open = [self.root]
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = self.links = 0
        self.link_chars = 0

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append([text, max(1, self.tags), self.link_chars, self.open[-1]])
            self.tags = 0
        self.parts, self.link_chars = [], 0

    @staticmethod
    def _judged(tag, attrs) -> tuple[bool, int]:
        """(silent, hint) of an element by its own name and attributes."""
        silent, hint = tag in SILENT, 2 if tag in HINTED else 1 if tag == "header" else 0
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                silent = True
            elif not value:
                continue
            elif name == "role" and value.lower() in ROLES:
                hint = max(hint, 1 if value.lower() == "banner" else 2)
            elif name in ("class", "id") and tag not in ("html", "body", "form", *SECTIONS):
                hint = max(hint, _hint_of_names(value))
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                silent = True
        return silent, hint

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in ("input", "select", "textarea", "button") and ("type", "hidden") not in attrs:
            for e in self.open:
                e.controls += 1
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "a":
                self.links += 1
            elif tag in VOID:
                return
            silent, hint = self._judged(tag, attrs) if attrs and tag != "a" else (False, 0)
            if silent or hint:
                self._flush()
                self._push(tag, silent, hint)
            return
        self._flush()
        closes = CLOSES.get(tag) or ({"p"} if tag in BREAKS_P else ())
        if closes:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth].tag in closes:
                    del self.open[depth:]
                    break
                if self.open[depth].tag in SCOPES:
                    break
        if tag not in VOID:
            self._push(tag, *self._judged(tag, attrs))

    def _push(self, tag, silent, hint):
        e = _Element(tag, self.open[-1], silent or self.open[-1].silent, hint, len(self.elements))
        self.elements.append(e)
        self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in INLINE and self.open[-1].tag != tag:
            return
        self._flush()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        if self.open[-1].silent:
            return
        self.parts.append(data)
        if self.links:
            self.link_chars += len(data)

    def unknown_decl(self, data):
        pass

    def error(self, message):
        raise AssertionError(message)

    def finish(self, html: str) -> list[list]:
        for at in range(0, len(html), FEED_CHARS):
            self.feed(html[at : at + FEED_CHARS])
        self.close()
        self._flush()
        self._hints()
        return self.lines

    def _hints(self):
        """Whether each element is hinted, once the page has been read.

        A form counts by its characters for each control. A heading of the first rank isn't hinted by
        a header around it, and an article by nothing but comments, asides and the like around it.
        """
        for text, _, _, e in self.lines:
            while e is not None:
                e.size += len(text)
                e = e.parent
        done = False  # whether an article has come before
        for e in self.elements[1:]:
            hint = e.hint
            if e.tag == "form" and e.size < FRAME_CHARS * max(1, e.controls):
                hint = 2
            up = e.parent
            e.hinted, e.under_header = up.hinted or hint == 2, up.under_header or hint == 1
            if e.tag in SECTIONS and hint < 2:
                if not done:  # something before it may have been left open
                    e.hinted = False
                if not e.hinted:
                    e.under_header, done = False, True
            if e.tag == "header" and _section(e) is not None:
                e.under_header = False


def _section(e) -> _Element | None:
    """The outermost article or main element around, or none."""
    found = None
    while e is not None:
        found = e if e.tag in SECTIONS else found
        e = e.parent
    return found


def _heading(e) -> bool:
    while e is not None and e.tag not in SCOPES:
        if e.tag in HEADINGS:
            return True
        e = e.parent
    return False


def _lines(html: str) -> list[list]:
    try:
        return _Lines().finish(html)
    except AssertionError:  # a marked section that the parser doesn't know
        return _Lines().finish(html.replace("<![", "<!"))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends count what lies inside only."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    cut = slice(reach, reach + len(ratios))
    return np.convolve(ratios, kernel)[cut] / np.convolve(np.ones(len(ratios)), kernel)[cut]


def threshold(values: np.ndarray) -> float:
    """The midpoint of two clusters by two-means from the least and the greatest value.

    Clusters that aren't apart are both content, and the lower one is split again; the least value
    if there is one cluster only.
    """
    rest = values
    while len(rest):
        low, high = float(rest.min()), float(rest.max())
        for _ in range(50):
            upper = rest >= (low + high) / 2
            if upper.all():
                return float(values.min())
            new = float(rest[~upper].mean()), float(rest[upper].mean())
            if new == (low, high):
                break
            low, high = new
        if low <= APART * high:
            return (low + high) / 2
        rest = rest[rest < (low + high) / 2]
    return float(values.min())


def text_to_tag(lines: list[list]) -> np.ndarray:
    """Characters outside links for each tag; those inside links where a page has no others."""
    chars = np.array([len(x[0]) for x in lines], dtype=float)
    links = np.minimum(np.array([x[2] for x in lines], dtype=float), chars)
    plain = chars if (links == chars).all() else chars - links
    return plain / np.array([x[1] for x in lines], dtype=float)


def content_lines(lines: list[list]) -> np.ndarray:
    """Whether each line is content: its ratio, smoothed, is in the upper cluster, and it isn't all links."""
    ratios = text_to_tag(lines)
    values = smoothed(np.log1p(ratios))
    return (values >= threshold(values)) & (ratios > 0)


def _ranked_first(e) -> bool:
    while e is not None and e.tag not in SCOPES:
        if e.tag == "h1":
            return True
        e = e.parent
    return False


def extract(html: str | None, names: bool = True) -> str:
    """The page's main text: blocks in page order, one line each; empty if there is none.

    Null or empty html gives an empty text, html without any tag its own text. Unclosed elements
    end with the page. Repeated pages give equal texts. Where names speak against all lines they
    tell nothing apart and aren't heard.
    """
    lines = _lines(html or "")
    if not lines:
        return ""
    named = np.array([x[3].hinted or x[3].under_header and not _ranked_first(x[3]) for x in lines])
    if not names or named.all():
        named[:] = False
    content = content_lines(lines) & ~named
    if not content.any():  # what is named has the greater ratios: the rest by itself
        content[~named] = content_lines([x for x, out in zip(lines, named, strict=True) if not out])
    chosen = np.flatnonzero(content)
    if not len(chosen):
        return ""
    total = 0.0
    for i in chosen.tolist():
        total += len(lines[i][0])
        e = lines[i][3]
        while e is not None:
            e.chars += len(lines[i][0])
            e = e.parent
    regions = _regions([lines[i][3] for i in chosen.tolist()], total, names)
    inside = np.array([_within(x[3], regions) for x in lines])
    own = inside & ~named
    chosen = np.flatnonzero(content & inside)
    first, last = int(chosen[0]), int(chosen[-1])
    whole = all(r.tag not in ("", "html", "body") for r in regions)
    kin = {(id(lines[i][3].parent), lines[i][3].tag) for i in chosen.tolist()}
    kept = np.zeros(len(lines), bool)
    for i in np.flatnonzero(own).tolist():
        text, _, links, e = lines[i]
        kept[i] = first <= i <= last or (id(e.parent), e.tag) in kin or whole and (_heading(e) or 2 * links <= len(text))
    while first and own[first - 1] and _heading(lines[first - 1][3]):
        first -= 1
        kept[first] = True
    if not _heading(lines[int(np.argmax(kept))][3]):  # the title may stand before the region
        above = [i for i in range(first) if not named[i] and _ranked_first(lines[i][3])]
        kept[above[-1:]] = True
    return "\n".join(x[0] for x, out in zip(lines, kept, strict=True) if out)


def _regions(voters: list[_Element], total: float, names: bool) -> set[_Element]:
    """The least element that lacks no more than ``SLACK`` of the votes (``chars``).

    By names, the outermost article or main element around it instead; where there is none, the
    articles inside it if they have the votes between them.
    """
    best = voters[0]
    for e in voters:
        while e.parent is not None and (e.chars < (1 - SLACK) * total or e.tag not in SCOPES):
            e = e.parent
        best = e if e.order > best.order or best.chars < (1 - SLACK) * total or best.tag not in SCOPES else best
    if names:
        around = _section(best)
        if around is not None and not around.hinted:
            return {around}
        articles = {a for a in map(_section, voters) if a is not None and not a.hinted}
        if sum(a.chars for a in articles) >= (1 - SLACK) * total:
            return articles
    return {best}


def _within(e, regions: set[_Element]) -> bool:
    while e is not None and e not in regions:
        e = e.parent
    return e is not None


def main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, text and n_chars (code points) of each row of ``pages``; other columns are left out."""
    ship_code(pages.sparkSession)
    source = pages.select(*[pages[c] for c in keep], pages[html].alias("__html"))
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # texts of few pages at a time
                part = batch.slice(at, 256)
                texts = [extract(x) for x in part.column("__html").to_pylist()]
                columns = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"]
                )

    return source.mapInArrow(run, f"{fields}, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))

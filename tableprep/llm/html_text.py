"""Operator 11 - main text of web pages by smoothed text-to-tag ratios.

The standard library's parser reads a page event by event; no tree is built. Its events are cut into lines (the blocks of a
page: what stands between two block tags), each with its text, its tags, its linked characters and the elements that it
stands in. The ratio of characters to tags of each line is smoothed by a Gaussian over its neighbours; lines above the threshold,
the standard deviation of the ratios times ``spread``, form clusters, and the clusters choose the region: the element that
holds the article. All of the region's lines are the article, the short ones between long ones as well.

Ratios can't tell a short article from a long advert, so what a page says about itself goes first. Lines of scripts, forms,
menus, footers and the like are no candidates; neither are those of elements whose class, id or role names such a part
(``sidebar``, ``cookie-notice``, ``comments``), unless the page's article lies within, as in ``<div class="with-sidebar">``.
Where the page marks its article (``article``, ``main``), the clusters choose among the marked elements. Where it doesn't, they
choose the innermost element that holds nearly all of their characters, the headline before it included, and lines outside of
the clusters' reach or mostly made of links are left out.

Defined results: null, empty and unmarked-up pages are taken as they are (none, none, one line); tags that are never closed end with
the element around them; character references are decoded, white space within a line becomes one space; null ids and urls stay;
repeated pages get equal rows; further columns are ignored; an empty table gives no rows. A page is worked on alone, in the
task that reads it: nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

# Elements of HTML and their kinds.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
                   "tbody td tfoot th thead title tr ul".split())
UNSEEN = frozenset("script style noscript template head title iframe object embed applet svg math canvas audio video map select option optgroup datalist "
                   "textarea button input form nav menu footer aside dialog search noframes".split())
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input keygen link meta param source track wbr".split())
PARAGRAPHS = frozenset("p pre blockquote li h1 h2 h3 h4 h5 h6".split())
#: elements that end an open element of the listed kinds, up to the given scope
IMPLIED_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
                "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
                "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "tbody"}, {"table"})}
CLOSES_P = BLOCKS - {"body", "html", "head", "title", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
# Words of a class, id or role that name a part beside the article, whatever stands beside them ...
PARTS = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsbygoogle aside breadcrumb breadcrumbs byline captcha comment "
                  "comments commentlist commentary complementary consent contentinfo cookie cookies copyright disclaimer disqus discussion donate feedback "
                  "footer footnav form gdpr hidden login masthead menu menus menubar modal nav navbar navigation navi newsletter notice notices notification "
                  "notifications outbrain overlay pager pagination paywall popup popups popular privacy promo promos promoted promotion promotions "
                  "recommendation recommendations recommended related replies reply respond rss search share sharing sharebar sidebar sidebars signin "
                  "signup skip social sponsor sponsored sponsors subscribe subscription taboola teaser teasers toast toc toolbar topbar trackback "
                  "trending widget widgets".split())
# ... and those that do so only if nothing there names the article
WEAK_PARTS = frozenset("alert banner bar bottom head header headers info links list meta message promo secondary tags top".split())
ARTICLE_WORDS = frozenset("article articlebody body content entry main post story text".split())
COMMENT_PARTS = frozenset("comment comments commentlist reply replies respond related recommended teaser teasers promo ad ads advert sponsored widget".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass(frozen=True)
class Ratios:
    sigma: float = 1.0          # of the Gaussian, in lines
    radius: int = 2             # lines on either side that it looks at
    spread: float = 0.5         # of the standard deviation: the threshold
    held: float = 0.8           # share of the clusters' characters that the region has to hold
    linked: float = 0.5         # share of linked characters above which a line outside of a marked article is a menu


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    unseen: bool = False
    part: bool = False          # its class, id or role names a part beside the article
    marked: bool = False        # article or main
    comment: bool = False


@dataclass(slots=True)
class Line:
    tag: str
    owner: int                  # the innermost open block element
    text: str
    tags: int
    linked: int


def _named(attrs: dict) -> tuple[bool, bool]:
    """Whether the class, id or role names a part beside the article, and whether it names comments or teasers."""
    words = set()
    for a in ("class", "id", "role", "itemprop", "aria-label"):
        if attrs.get(a):
            words |= {x.lower() for x in WORD.findall(attrs[a])}
    if not words:
        return NO_WORDS
    part = bool(words & PARTS) or (bool(words & WEAK_PARTS) and not words & ARTICLE_WORDS)
    return part, bool(words & COMMENT_PARTS)


IMPRINT = re.compile(r"©|\(c\)|copyright\b|all rights reserved", re.I)
NO_WORDS = (False, False)
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
P_SCOPE = frozenset("button table td th object".split())


class Lines(HTMLParser):
    """Parser events to lines; ``elements`` are those that any line stands in, by number, parents first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", -1)]
        self.open: list[int] = [0]
        self.blocks: list[int] = [0]        # the open ones that are blocks
        self.lines: list[Line] = []
        self.pieces: list[str] = []         # of the line that is being read
        self.owner = self.tags = self.linked = 0
        self.links = self.paragraphs = self.muted = 0   # open ones; muted: unseen elements within a line

    def updatepos(self, i, j):      # line numbers of the source aren't wanted
        return j

    def _end_line(self):
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces = []
            if text:
                self.lines.append(Line(self.elements[self.owner].tag, self.owner, text, self.tags, self.linked))
                self.tags = 0       # tags without text weigh on the line that follows
            self.linked = 0
        self.owner = self.blocks[-1]

    def _close(self, at: int):
        """Ends the elements from place ``at`` of the open ones on."""
        for i in self.open[at:]:
            e = self.elements[i]
            self.links -= e.tag == "a"
            self.paragraphs -= e.tag == "p"
            if e.tag in BLOCKS:
                self.blocks.pop()
            else:
                self.muted -= e.unseen
        del self.open[at:]

    def _imply(self, ends, scope):
        """Ends the innermost open elements of the kinds ``ends``, but none outside of an element of the kinds ``scope``."""
        k = len(self.open) - 1
        at = 0
        while k > 0 and (tag := self.elements[self.open[k]].tag) not in scope:
            if tag in ends:
                at = k
            k -= 1
        if at:
            self._end_line()
            self._close(at)
            self._end_line()

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block:
            if tag in IMPLIED_ENDS:
                self._imply(*IMPLIED_ENDS[tag])
            if self.paragraphs and tag in CLOSES_P:
                self._imply({"p"}, P_SCOPE)
            self._end_line()
        self.tags += 1
        if tag in VOID:
            if tag == "br" or tag == "wbr":
                self.pieces.append(" " if tag == "br" else "")
            return
        if (tag == "html" or tag == "body") and any(self.elements[i].tag == tag for i in self.open):
            return
        e = Element(tag, self.open[-1], tag in UNSEEN, marked=tag == "article" or tag == "main")
        if attrs:
            given = dict(attrs)
            e.unseen = e.unseen or "hidden" in given or given.get("aria-hidden") == "true" or bool(given.get("style") and HIDDEN.search(given["style"]))
            e.marked = e.marked or given.get("role") in ("main", "article") or given.get("itemprop") == "articleBody"
            if tag != "html" and tag != "body":
                e.part, e.comment = _named(given)
                e.part = e.part and (not e.marked or e.comment)
                e.marked = e.marked and not e.comment
        n = len(self.elements)
        self.elements.append(e)
        self.open.append(n)
        if block:
            self.blocks.append(n)
            self.paragraphs += tag == "p"
            self.owner = n
        else:
            self.links += tag == "a"
            self.muted += e.unseen

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)    # a slash doesn't end an element in HTML

    def handle_endtag(self, tag):
        open_, elements = self.open, self.elements
        at = len(open_) - 1
        block = tag in BLOCKS
        if block:
            self._end_line()
        self.tags += 1
        blocks_between = False
        while at > 0 and elements[open_[at]].tag != tag:
            blocks_between = blocks_between or elements[open_[at]].tag in BLOCKS
            at -= 1
        if not at:
            return      # an end without a beginning
        if blocks_between and not block:    # an inline element that was closed late: those within it stay open
            e = elements[open_.pop(at)]
            self.links -= e.tag == "a"
            self.muted -= e.unseen
            return
        self._close(at)
        if block:
            self.owner = self.blocks[-1]

    def handle_data(self, data):
        if self.muted:
            return
        self.pieces.append(data)
        if self.links:
            self.linked += sum(map(len, data.split()))

    def finish(self) -> list[Line]:
        self.close()
        self._end_line()
        return self.lines


def smoothed(values: list[float], ratios: Ratios) -> list[float]:
    """A Gaussian mean of each value and its neighbours."""
    kernel = [math.exp(-(k * k) / (2 * ratios.sigma ** 2)) for k in range(ratios.radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k in range(max(0, i - ratios.radius), min(len(values), i + ratios.radius + 1)):
            total += kernel[abs(k - i)] * values[k]
            weight += kernel[abs(k - i)]
        out.append(total / weight)
    return out


def in_clusters(lines: list[Line], ratios: Ratios) -> list[bool]:
    """Whether each line's smoothed ratio of characters to tags is above the threshold."""
    values = [(len(x.text) - min(len(x.text), x.linked)) / max(1, x.tags) for x in lines]
    smooth = smoothed(values, ratios)
    mean = sum(values) / len(values)
    threshold = ratios.spread * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    return [s >= threshold and s > 0 for s in smooth]


def _paths(elements: list[Element], lines: list[Line]) -> list[list[int]]:
    """The elements around each line, outermost first."""
    out = []
    for x in lines:
        path, i = [], x.owner
        while i > 0:
            path.append(i)
            i = elements[i].parent
        out.append(path[::-1])
    return out


def _region(elements, lines, paths, chosen, seen, ratios):
    """The element that holds the article, and whether the page marks it as such."""
    weight: dict[int, int] = {}
    total = 0
    for x, path, c, s in zip(lines, paths, chosen, seen):
        if s and c:
            total += len(x.text)
            for i in path:
                weight[i] = weight.get(i, 0) + len(x.text)
    marked = [i for i, e in enumerate(elements) if e.marked]
    if marked:
        has = {i for path, s in zip(paths, seen) if s for i in path}
        marked = [i for i in marked if i in has] or marked
        # of nested marks the inner one, if it holds nearly all of the outer one's clusters
        best = max(marked, key=lambda i: (weight.get(i, 0), -i))
        while True:
            inner = [i for i in marked if i != best and weight.get(i, 0) and weight[i] >= ratios.held * weight.get(best, 0) and best in _above(elements, i)]
            if not inner:
                return best, True
            best = max(inner, key=lambda i: (weight.get(i, 0), -i))
    best = 0
    while total:
        inner = [i for i, e in enumerate(elements) if e.parent == best and weight.get(i, 0) >= ratios.held * total and e.tag not in ("p", "li", "tr", "pre", "blockquote")]
        if not inner:
            break
        best = inner[0]
    return best, False


def _above(elements, i):
    out = []
    while i > 0:
        i = elements[i].parent
        out.append(i)
    return out


def main_lines(page: str, ratios: Ratios = Ratios()) -> list[str]:
    """The lines of the page's article."""
    parser = Lines()
    parser.feed(page)
    lines, elements = parser.finish(), parser.elements
    if not lines:
        return []
    paths = _paths(elements, lines)
    # an element that holds the article's mark, or else the headline, is no mere part, whatever its name says
    signs = [j for j, e in enumerate(elements) if e.marked] or [j for j, e in enumerate(elements) if e.tag == "h1"]
    holds = {i for j in signs for i in _above(elements, j)}
    holds = {i for i in holds if not elements[i].comment}
    unseen = {i for i, e in enumerate(elements) if e.unseen}
    parts = {i for i, e in enumerate(elements) if e.part and i not in holds}
    while parts and all(any(i in unseen or i in parts for i in path) for path in paths):     # then the outermost names mean the layout
        outer = {next((i for i in path if i in parts and not elements[i].comment), None) for path in paths if not any(i in unseen for i in path)}
        if not outer - {None}:
            break
        parts -= outer
    gone_set = unseen | parts
    header = {i for i, e in enumerate(elements) if e.tag in ("header", "hgroup") and not any(elements[j].marked or elements[j].tag == "section" for j in _above(elements, i))}
    seen = [not any(i in gone_set or i in header for i in path) for path in paths]
    if not any(e.marked for e in elements):     # a headline in the page's header belongs to the article if there is one only
        heads = [k for k, x in enumerate(lines) if x.tag == "h1" and not any(i in gone_set for i in paths[k])]
        if len(heads) == 1:
            seen[heads[0]] = True
    if not any(seen) and not any(e.marked for e in elements):
        return []
    at = [k for k, s in enumerate(seen) if s]
    chosen = [False] * len(lines)
    if at:
        for k, c in zip(at, in_clusters([lines[k] for k in at], ratios)):
            chosen[k] = c
    region, is_marked = _region(elements, lines, paths, chosen, seen, ratios)
    if is_marked:
        own = []
        for k, x in enumerate(lines):
            if region in paths[k]:
                below = paths[k][paths[k].index(region) + 1:]
                if not any(i in gone_set for i in below):
                    own.append(k)
        return [lines[k].text for k in own]
    inside = [k for k in at if region == 0 or region in paths[k]]
    good = [k for k in inside if chosen[k] and lines[k].linked <= ratios.linked * len(lines[k].text)]
    if not good:
        good = [k for k in inside if lines[k].linked <= ratios.linked * len(lines[k].text)]
        if not good:
            return []
    first, last = good[0], good[-1]
    parents = {tuple(paths[k][:-1]) for k in good}

    def alike(k):       # a paragraph beside those of the clusters
        x = lines[k]
        return x.tag in PARAGRAPHS and tuple(paths[k][:-1]) in parents and x.linked <= ratios.linked * len(x.text)

    def imprint(k):
        return lines[k].tag not in PARAGRAPHS and IMPRINT.match(lines[k].text)

    keep = [k for k in inside if (first <= k <= last or alike(k)) and lines[k].linked <= ratios.linked * len(lines[k].text) and not imprint(k)]
    if not keep:
        return []
    before = [k for k in at if k < keep[0] and lines[k].tag == "h1"]
    return [lines[k].text for k in [*before[-1:], *keep]]


def _extracted(ratios: Ratios):
    def run(batches):
        for b in batches:
            found = ["\n".join(main_lines(x, ratios)) if x else "" for x in b.column("html").to_pylist()]
            cols = [b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])
    return run


def main_text(pages: DataFrame, ratios: Ratios = Ratios(), id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, the article's text, its length in characters."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_extracted(ratios), "page_id long, url string, text string, n_chars long")


def op11_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP11_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS h FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(p|h1)>', chr(1), 'g'), '<[^>]*>', ' ', 'g') AS h FROM a),
c AS (SELECT page_id, url, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '&quot;?', '"', 'g'),
        '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', chr(2), 'g'), chr(2), '&') AS h FROM b),
d AS (SELECT page_id, url, list_filter(list_transform(string_split(h, chr(1)), lambda x: trim(regexp_replace(x, '[\s\x{1c}-\x{1f}\x{85}\x{a0}]+', ' ', 'g'))),
        lambda x: x <> '') AS l FROM c)
SELECT page_id, url, array_to_string(l, chr(10)) AS text, length(array_to_string(l, chr(10)))::BIGINT AS n_chars FROM d"""

QUERIES = {"op11_main_text": op11_main_text}
ORACLE = {"op11_main_text": OP11_SQL}

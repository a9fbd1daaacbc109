"""Main text of web pages by tree scoring.

A page becomes a light tree of its elements and the blocks of text in them. Parts
that are never the article (menus, page headers and footers, sidebars, notices,
adverts, forms, reader comments, scripts, styles) are marked on the way: by tag,
by role, and by names that say nothing else (``cookie-banner``). A name that only
holds such a word (``social science``) is a suspicion: inside an article it counts
if the element is mostly links, elsewhere also if it is short. Every other block
passes points for its length and its commas to the elements above it, less the
higher they are; blocks and elements lose by the share of their text that is links.

The best element is kept, as a whole ``article`` or ``main`` if it lies in one.
Without these its siblings are kept if they are text and not links, and so are
those of the elements above it, up to a level that is mostly links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from lorehouse.llm.blocks import bounded_batches

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<loose>/?[a-zA-Z])[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")

_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select option textarea iframe "
    "object svg canvas audio video dialog menu title xmp noembed noframes".split()
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr br".split()
)
#: Elements that a paragraph passes its points over, as text stands in them, not in their parent.
_PARAGRAPHS = frozenset("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption caption".split())
#: Words of names that stand for a part beside the article; those of the second set mean other things as well.
_BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sidebar sidenav nav navbar navigation "
    "breadcrumb breadcrumbs cookie cookies consent gdpr popup modal newsletter subscribe signup login comment comments "
    "disqus respond toolbar pagination footer masthead".split()
)
_PERHAPS = frozenset(
    "banner promo promotion menu notice notices alert overlay social share sharing reply replies related recommended "
    "widget pager hidden".split()
)
#: Words that a name may hold beside these and still mean no more than they do.
_PLAIN = frozenset(
    "area bar block bottom box button buttons card col column container content fixed floating form global group holder "
    "icons id inner item items js left link links list main message outer page pane panel posts primary reader right row "
    "secondary section site slot sticky stories thread top unit user wrap wrapper".split()
)
_PAGE_HEADER = frozenset("header bar container global inner main page site top wrap wrapper".split())
_UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar alertdialog form".split())
_CONTENT = frozenset(("article", "main"))
#: A start tag of the key ends an open element of the value, up to the nearest element of the third set.
_ENDS_ITEM = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
}
_SIBLING_SHARE = 0.2
#: More links than this share are no text; fewer characters are short, for a suspect and for a sibling.
_LINKS, _SHORT_SUSPECT, _SHORT_SIBLING = 1 / 3, 200, 25


class _Element:
    __slots__ = ("tag", "parent", "dropped", "suspect", "score", "chars", "links", "kept")

    def __init__(self, tag: str, parent: _Element | None, dropped: bool, suspect: bool = False) -> None:
        self.tag, self.parent, self.dropped, self.suspect = tag, parent, dropped, suspect
        self.score = 0.0
        self.chars = self.links = 0
        self.kept = False


def _within(element: _Element | None, tags: frozenset[str]) -> bool:
    while element is not None:
        if element.tag in tags:
            return True
        element = element.parent
    return False


def _named_beside(value: str, in_content: bool) -> bool | None:
    """Whether the names of a class or id say that an element stands beside the article; None: they may."""
    names = [{w.lower() for w in _NAME.findall(name)} for name in value.strip("\"'").split()]
    found = [name & (_BESIDE | _PERHAPS) for name in names]
    whole = [bool(f) and name <= _BESIDE | _PERHAPS | _PLAIN for name, f in zip(names, found, strict=True)]
    if any(w and f & _BESIDE for w, f in zip(whole, found, strict=True)):
        return True
    if not in_content and any("header" in name and name <= _PAGE_HEADER for name in names):
        return True
    if not any(found):
        return False
    return True if all(w or name <= _PLAIN for w, name in zip(whole, names, strict=True)) else None


def _unwanted(tag: str, attributes: str, parent: _Element) -> bool | None:
    """Whether an element is no part of the article; None: its text decides."""
    if parent.dropped or tag in _DROPPED:
        return True
    if tag == "header":
        return not _within(parent, _CONTENT)
    if not attributes or tag in ("html", "body", "main"):
        return False
    suspect = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id"):
            beside = _named_beside(value, _within(parent, _CONTENT))
            if beside and not (tag == "article" and not re.search("comment|reply", value, re.I)):
                return True
            suspect |= beside is None
        elif name == "role" and value.strip("\"'").lower() in _UNLIKELY_ROLES or name == "hidden":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        elif name == "aria-hidden" and value.strip("\"'").lower() == "true":
            return True
    return None if suspect and tag != "article" else False


class _Page:
    """The tree of one page and its blocks in page order."""

    def __init__(self) -> None:
        self.root = _Element("html", None, False)
        self.open = [self.root]
        self.blocks: list[tuple[_Element, str, int]] = []
        self.suspects: list[_Element] = []
        self.pieces: list[str] = []
        self.link_chars = 0
        self.anchors = 0

    def text(self, raw: str) -> None:
        if self.open[-1].dropped:
            return
        piece = unescape(raw) if "&" in raw else raw
        self.pieces.append(piece)
        if self.anchors:
            self.link_chars += len(piece)

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                owner = self.open[-1]
                while owner.tag in _INLINE and owner.parent is not None:
                    owner = owner.parent
                self.blocks.append((owner, text, min(self.link_chars, len(text))))
            self.pieces, self.link_chars = [], 0

    def settle(self) -> None:
        """Decide about the suspects by their text, then let every block pass its points."""
        if self.suspects:
            for owner, text, links in self.blocks:
                element = owner
                while element is not None:
                    if element.suspect:
                        element.chars += len(text)
                        element.links += links
                    element = element.parent
            for element in self.suspects:
                short = element.chars < _SHORT_SUSPECT and not _within(element, _CONTENT)
                element.dropped = short or element.links > element.chars * _LINKS
                element.chars = element.links = 0
            self.blocks = [b for b in self.blocks if not _any_dropped(b[0])]
        for owner, text, links in self.blocks:
            self._points(owner, text, links)

    def _points(self, owner: _Element, text: str, links: int) -> None:
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))
        element, level = owner, 0 if owner.tag in _PARAGRAPHS else 1
        while element is not None:
            element.chars += len(text)
            element.links += links
            if level:
                element.score += points / (1 if level == 1 else 2 if level == 2 else 3 * (level - 1))
            element, level = element.parent, level + 1

    def close(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in stop:
                return
            if tag in tags:
                self._cut(k)
                return

    def _cut(self, at: int) -> None:
        self.anchors -= sum(e.tag == "a" for e in self.open[at:])
        del self.open[at:]

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            self.flush()
            return
        if tag not in _INLINE:
            self.flush()
            self.close(frozenset(("p",)), frozenset(("table", "button", "object", "td", "th")))
        if tag in _ENDS_ITEM:
            self.close(*_ENDS_ITEM[tag])
        if tag == "a" and self.anchors:
            self.close(frozenset(("a",)), frozenset(("table", "td", "th", "li", "p")))
        if tag == "br":
            self.text(" ")
        if tag in _VOID or attributes.endswith("/") and tag in ("path", "circle", "rect", "line", "use"):
            return
        parent = self.open[-1]
        unwanted = _unwanted(tag, attributes, parent)
        self.open.append(_Element(tag, parent, bool(unwanted), unwanted is None))
        if unwanted is None:
            self.suspects.append(self.open[-1])
        self.anchors += tag == "a"

    def end(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        if tag in ("html", "body"):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._cut(k)
                return

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            found = _TOKEN.search(html, at)
            if not found:
                self.text(html[at:])
                break
            if found.start() > at:
                self.text(html[at : found.start()])
            at = found.end()
            tag = found["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if found["end"]:
                self.end(tag)
                continue
            self.start(tag, found["attributes"])
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
                at = end.start() if end else n
        self.flush()
        self.settle()

    def best(self) -> _Element | None:
        """The element with the best score after the discount for links."""
        top, most, seen = None, 0.0, set()
        for owner, _, _ in self.blocks:
            element = owner
            while element is not None and id(element) not in seen:
                seen.add(id(element))
                if element.tag not in _INLINE:
                    score = element.score * (1 - element.links / element.chars) + 5 * (element.tag in _CONTENT)
                    if score > most:
                        top, most = element, score
                element = element.parent
        return top


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, one per line; "" if there is none."""
    if not html:
        return ""
    page = _Page()
    page.read(html)
    top = page.best()
    if top is None:
        return ""
    above = top
    while above is not None:  # the whole article around a best part of it
        if above.tag in _CONTENT:
            top = above
        above = above.parent
    top.kept = True
    if top.tag in _CONTENT:
        _keep_near(page, top)
    else:
        _keep_text_around(page, top)
    return "\n".join(text for owner, text, _ in page.blocks if _kept(owner))


def _keep_near(page: _Page, top: _Element) -> None:
    """Keep the siblings of an article that score near it."""
    least = _SIBLING_SHARE * top.score
    for owner, _, _ in page.blocks:
        element = owner
        while element.parent is not None and element.parent is not top.parent:
            element = element.parent
        if element.parent is top.parent and element.parent is not None and not element.kept:
            clean = element.links <= element.chars * _LINKS
            own = element.score if element.tag not in _PARAGRAPHS else least * clean
            element.kept = clean and own >= least > 0


def _keep_text_around(page: _Page, top: _Element) -> None:
    """Keep what is text, not links, beside the best element and beside the elements above it."""
    children: dict[int, dict[int, _Element]] = {}
    for owner, _, _ in page.blocks:
        element = owner
        while element.parent is not None:
            below = children.setdefault(id(element.parent), {})
            if id(element) in below:
                break
            below[id(element)] = element
            element = element.parent
    while top.parent is not None:
        others = [e for e in children[id(top.parent)].values() if e is not top]
        for element in others:
            below = children.get(id(element), {}).values()
            written = element.chars >= _SHORT_SIBLING or any(e.tag in _PARAGRAPHS for e in (element, *below))
            element.kept = element.kept or written and element.links <= element.chars * _LINKS
        if sum(e.links for e in others) > sum(e.chars for e in others) * _LINKS:
            return
        top = top.parent


def _any_dropped(element: _Element | None) -> bool:
    while element is not None:
        if element.dropped:
            return True
        element = element.parent
    return False


def _kept(element: _Element | None) -> bool:
    while element is not None:
        if element.kept:
            return True
        element = element.parent
    return False


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html) for html in batch.column("html").to_pylist()]
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page, in one pass without a shuffle.

    A null or empty page, and one without article, has the text "". Truncated
    pages give what they hold; repeated rows are repeated; an empty table gives no
    rows; other columns, also ones named like the results, are not read.
    """
    bounded_batches(pages.sparkSession)
    kept = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")

"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements, with the blocks of text that each holds. A block passes points for its
length and commas to the elements around it, fewer the further up; what an element gets is discounted by the share of
its text that stands in links. The best container is taken, with those of its siblings that score like it, and gives
its blocks in page order.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, small_batches

#: Elements whose text is never shown or is no prose.
SKIPPED = frozenset("script style noscript template svg math head title textarea select option button iframe object canvas audio video map datalist".split())
#: Elements that hold no article text wherever they stand.
AWAY = frozenset("nav footer aside form menu dialog".split())
#: Words of class and id names that tell of what surrounds an article.
NAMES_AWAY = frozenset("ad ads adbox adslot adunit advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar comment comments reply replies respond discussion cookie cookies consent gdpr notice alert newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation footer header masthead toolbar widget widgets popup modal overlay pagination pager topbar copyright disclaimer".split())
#: Of these, what readers write or other articles; the rest may also name a layout that holds the article.
NEVER_AROUND = frozenset("comment comments reply replies respond discussion related recommended recommendations".split())
#: Beginnings of such words, for names like commentlist or sidebarleft.
_BEGIN = re.compile(r"(?:comment|sidebar|advert|sponsor|cookie|newsletter|subscri|breadcrumb|promo|related|recommend|footer|navbar|pagination|banner|disqus)")
BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset legend address details summary hr menu dialog center".split())
VOID = frozenset("hr br img input meta link area base col embed source track wbr param".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag ends: the same kind, in the same list or table.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Words of an article's own class and id names; one of them keeps an article that also has a name of NAMES_AWAY.
OWN = frozenset("post entry article story main".split())

#: A tag's name and attributes. It ends at '>' or before the next '<'; a quote without a partner is a character.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*'|["'])*+)>?""")
#: What begins like markup but is none, and how each ends.
_ENDINGS = (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"))
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")
_UP = (1.0, 0.5, 0.25, 0.15, 0.1)


class _Element:
    __slots__ = ("away", "chars", "holds", "kept", "links", "named", "parent", "score", "tag")

    def __init__(self, tag: str, parent: _Element | None, away: bool, named: bool, holds: bool):
        """away: holds no article text by its tag or for good; named: by its name, unless an article stands in it (holds)."""
        self.tag, self.parent, self.away, self.named, self.holds = tag, parent, away, named, holds
        self.score, self.chars, self.links, self.kept = 0.0, 0, 0, False


class _Open:
    """Elements that are open, with the places of each kind, so that none is looked for."""

    def __init__(self, root: _Element):
        self.stack, self.places = [root], {}

    def push(self, e: _Element) -> None:
        self.places.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)

    def last(self, tags) -> int:
        """Place of the innermost open element of these kinds, 0 without any."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, place: int) -> None:
        """End the element at `place` and all within; the root stays."""
        while place and len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()


def _markup(html: str):
    """(start, end, closing, name, attributes) of each tag in order, a name of None for comments and the like.

    Every character is looked at a bounded number of times, however broken the page is: what has no end is looked for
    once, and the names of skipped elements that do not close again are remembered.
    """
    at, size, endless = 0, len(html), set()
    while True:
        start = html.find("<", at)
        if start < 0:
            return
        m = _TAG.match(html, start)
        if m is not None:
            tag, at = m[2].lower(), m.end()
            if tag not in SKIPPED:
                yield start, at, bool(m[1]), tag, m[3]
                continue
            if not m[1] and not m[3].rstrip().endswith("/") and tag not in endless:
                end = re.compile(rf"</{tag}\b[^<>]*>?", re.I).search(html, at)
                if end is not None:
                    at = end.end()
                else:
                    endless.add(tag)
                    at = size if tag in ("script", "style", "textarea") else at
            yield start, at, False, None, ""
            continue
        for opening, closing in _ENDINGS:
            if html.startswith(opening, start):
                end = -1 if opening in endless else html.find(closing, start + len(opening))
                if end < 0:
                    endless.add(opening)
                at = size if end < 0 else end + len(closing)
                yield start, at, False, None, ""
                break
        else:
            at = start + 1


def _away_by_name(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's class, id and role speak against it, and whether for good."""
    if not attributes or tag in ("body", "html", "main"):
        return False, False
    names = {w for n in _NAMED.findall(attributes) for w in _WORDS.findall("".join(n).lower())}
    hits = {n for n in names if n in NAMES_AWAY or _BEGIN.match(n)}
    if tag == "article" and names & OWN:
        hits = set()
    return bool(hits), any(n in NEVER_AROUND or n.startswith("comment") for n in hits)


def _tree(html: str):
    """Elements in page order, and blocks as (element, text, characters in links)."""
    root = _Element("body", None, False, False, True)
    elements, blocks, opened = [root], [], _Open(root)
    stack = opened.stack
    piece: list[str] = []
    linked, in_link, at = 0, False, 0

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            got = unescape(raw)
            piece.append(got)
            if in_link:
                linked += len("".join(got.split()))

    def end_block() -> None:
        nonlocal linked
        joined = " ".join("".join(piece).split())
        if joined:
            blocks.append((stack[-1], joined, linked))
        piece.clear()
        linked = 0

    for start, end, closing, tag, attributes in _markup(html):
        text(html[at:start])
        at = end
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            piece.append(" ")
        elif tag not in BLOCKS:
            continue
        elif closing:
            end_block()
            opened.close(opened.last((tag,)))
            in_link = in_link and tag == "p"
        else:
            end_block()
            if stack[-1].tag == "p" or (stack[-1].tag in HEADINGS and tag in HEADINGS):
                opened.close(len(stack) - 1)
            if tag in _ENDS:
                same, within = (opened.last(tags) for tags in _ENDS[tag])
                if same > within:
                    opened.close(same)
            if tag in VOID:
                continue
            inside = opened.last(("article", "main")) > 0
            named, for_good = _away_by_name(tag, attributes)
            away = tag in AWAY or (tag == "header" and not inside) or for_good
            element = _Element(tag, stack[-1], away, named, tag in ("article", "main") and not named)
            elements.append(element)
            opened.push(element)
    text(html[at:])
    end_block()
    for e in reversed(elements[1:]):
        e.parent.holds = e.parent.holds or e.holds
    return elements, blocks


def main_blocks(html: str) -> list[str]:
    """The article's blocks of text in page order; empty without any. If names leave nothing, layout names do not count."""
    elements, blocks = _tree(html)
    away = [e.away for e in elements]
    for names in (True, False):
        for e, gone in zip(elements, away, strict=True):
            e.away = gone or (e.parent is not None and (e.parent.away or (names and e.named and not e.holds)))
        found = _chosen(elements, blocks)
        if found:
            return found
    return []


def _chosen(elements: list[_Element], blocks: list[tuple[_Element, str, int]]) -> list[str]:
    """Texts of the blocks in the best container and in siblings that score like it."""
    for e in elements:
        e.score, e.chars, e.links, e.kept = 0.0, 0, 0, False
    for element, text, linked in blocks:
        element.chars += len(text)
        element.links += linked
        if element.away:
            continue
        points = 1 + text.count(",") + min(3.0, len(text) / 100)
        points *= 1 - min(1.0, linked / max(1, len(text)))
        up = element if element.tag not in ("p", *HEADINGS) or element.parent is None else element.parent
        for share in _UP:
            up.score += points * share
            up = up.parent
            if up is None:
                break
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.links += e.links
    density = lambda e: min(1.0, e.links / e.chars) if e.chars else 0.0
    value = lambda e: e.score * (1 - density(e)) * (1.5 if e.tag in ("article", "main") else 1.0)
    able = [e for e in elements if not e.away and e.score > 0]
    if not able:
        return []
    best = max(able, key=value)
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    least = 0.2 * value(best)
    for e in elements:
        sibling = e.parent is best.parent and best.parent is not None and not e.away
        likes = sibling and (e.tag == "h1" or value(e) >= max(10.0, least) and density(e) < 0.3 or e.tag == "p" and e.chars > 80 and density(e) < 0.25)
        e.kept = e is best or likes or (e.parent is not None and e.parent.kept)
    return [text for element, text, _ in blocks if element.kept and not element.away]


def _extract(batches):
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        texts = ["\n\n".join(main_blocks(h)) for h in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])


def extract(pages: DataFrame, html: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of `pages`: `key`, `url`, text (blocks joined by two line feeds, empty if none), n_chars.

    Null, empty and broken pages give what text they hold, or none. Nothing is shuffled; repeated rows are extracted
    each, null keys and urls are kept, an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (key, url))
    found = pages.select(key, url, blank(html).alias("_html")).mapInArrow(_extract, f"{schema}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))

"""Main-text extraction from HTML by two passes of block rules.

A page is cut into blocks at block-level tags.  The first pass decides each
block by stop-word density, length and link density, together with the
elements that enclose it; short blocks, and those with a middling or low share
of stop words, stay undecided.  In the second pass they take the label of the
nearest decided neighbours, first within the same enclosing region, then on the
page.  Stop words tell nothing about a block in a script that has no list here,
nor on a page on which no block outside the regions beside the article has the
density of prose: there length and link density alone decide.  On a page without
any good block, what is neither beside the article nor made of links is its
text.  The time is linear in a page's length whatever it holds.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Function words of English, German, French, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be because been but by can could did do for from had has have he her his how i if in
    into is it its just like more my no not of on one only or our out over she so some than that the their them then there these
    they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für haben
    hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn
    werden wie wir wird zu zum zur
    au aux avec ce ces cette comme dans de des donc du elle en entre est et eu il ils je la le les leur lui mais même ne nous on ont
    ou où par pas plus pour qu que qui sa sans se ses si son sont sur tout un une vous été être
    al como con cuando de del desde donde el ella en entre era es esta este está fue ha hasta hay la las le lo los más me mi muy no
    nos o para pero por porque que se ser si sin sobre son su sus también tiene un una y ya
    alla anche che chi come da dal dei della di e gli il io lei loro ma nel nella non per più quando questo se sono sua suo tra uno
    ao aos com da das do dos ela ele em era essa isso mas na nas não nos num o os ou pela pelo quando seu sua são também um uma
    aan bij dan dat deze die dit door een geen haar heeft het hij ik je maar meer met naar niet nog of om onder ook op over te tot
    uit van voor was wat werd wij zijn zo zou
    """.split()
)
# Elements by their part in a page.
DROPPED = frozenset("script style noscript template title textarea svg math iframe object select button canvas audio video map".split())
BOILERPLATE = frozenset("head nav footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
REGIONS = frozenset("html body div section ul ol dl table tbody thead tfoot tr td th fieldset figure details center blockquote header".split()) | BOILERPLATE | ARTICLE
BREAKS = REGIONS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre hr address caption figcaption legend summary option optgroup frame frameset noframes dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words in class and id that mark a region beside the article.
ASIDE_WORDS = frozenset(
    """
    ad ads advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs comment comments commentlist consent
    cookie cookies copyright disqus footer gdpr header login masthead menu menubar meta modal nav navbar navigation newsletter notice
    pagination pager popup promo promotion related respond search share sharing sidebar signup skip social sponsor sponsored subscribe
    subscription tagcloud tags toolbar topbar widget
    """.split()
)
# A name that begins with one of these states how the page is laid out, such as no-sidebar.
STATE_WORDS = frozenset("no not non without with has have is are hide hidden show shows enable enabled disable disabled".split())
# Elements that class words never mark.
WHOLE = frozenset("html body main article".split())
# The block rules' thresholds.
LENGTH_SHORT, LENGTH_LONG = 70, 200  # characters
STOP_LOW, STOP_HIGH = 0.15, 0.30  # stop words among the words
MOST_LINKED = 0.5  # characters inside links

UNDECIDED = ("short", "near", "low")
# The last letter of the Latin blocks.
_LATIN_END = "\u024f"

#: What stands between a tag's name and its end; a quote opens a value only after an equals sign, and a tag that another one interrupts ends there.
_QUOTED = re.compile(r"(?:[^<>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+")
_BARE = re.compile(r"[^<>]*+")
_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[^\W\d_]+")
_SPACE = re.compile(r"\s+")
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in DROPPED}


@dataclass
class Block:
    """Text between two block-level tags; region numbers the innermost enclosing element of a kind."""

    place: int
    region: int
    kind: str  # article, beside or plain
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    label: str = ""


@dataclass
class Place:
    """An element that encloses blocks; its kind is known when the page has been read."""

    name: str
    outer: int
    aside: bool  # by its class, id or role
    main: bool = False  # is or holds html, body or main
    article: bool = False  # holds an article
    kind: str = "plain"
    region: int = 0


def _aside(attributes: str) -> bool:
    """A name of class, id or role is an aside word, or begins or ends with one; header only as its last part, as in site-header."""
    for found in _NAMES.findall(attributes):
        for name in "".join(found).lower().split():
            parts = [x for x in re.split(r"[^a-z]+", name) if x]
            if parts and parts[0] not in STATE_WORDS and (parts[-1] in ASIDE_WORDS or (parts[0] in ASIDE_WORDS and parts[0] != "header")):
                return True
    return False


def _resolve(places: list[Place]) -> None:
    """The kind and region of every place; outer ones come first.

    Class words never mark html, body, main or article, nor what holds html,
    body or main.  What holds an article is marked only if the page has another
    article outside all that is marked, such as the one that comments belong to.
    """
    for p in reversed(places[1:]):
        outer = places[p.outer]
        outer.main |= p.main or p.name in WHOLE - {"article"}
        outer.article |= p.article or p.name == "article"
    marked = [False] * len(places)
    free = False
    for k, p in enumerate(places[1:], 1):
        marked[k] = marked[p.outer] or p.name in BOILERPLATE or (p.aside and not p.main)
        free = free or (p.name == "article" and not marked[k])
    regions = 0
    for p in places[1:]:
        outer = places[p.outer]
        if outer.kind == "beside" or p.name in BOILERPLATE or (p.name == "header" and outer.kind != "article") or (p.aside and not p.main and (free or not p.article)):
            p.kind = "beside"
        else:
            p.kind = "article" if p.name in ARTICLE else outer.kind
        if p.kind != outer.kind or p.name in ARTICLE:
            regions += 1
            p.region = regions
        else:
            p.region = outer.region


def _tokens(page: str):
    """(text, closing, name, attributes) of each text - with an empty name - and tag, in order.

    Comments, declarations and the insides of DROPPED elements are left out.
    Every search goes on from where the one before it ended, or is not made
    again once it has found nothing.
    """
    at, size, last = 0, len(page), page.rfind(">")
    attributes, unclosed = _QUOTED, set()
    while at < size:
        spot = page.find("<", at)
        if spot != at:
            stop = size if spot < 0 else spot
            yield page[at:stop], False, "", ""
            at = stop
            continue
        tag = _NAME.match(page, at + 1)
        if tag:
            end = attributes.match(page, tag.end()).end()
            if end == size:  # it never ends, as far as its quotes go, so that quotes are no guide on this page
                attributes = _BARE
                end = attributes.match(page, tag.end()).end()
            at = end + page.startswith(">", end)
            name, closing = tag[2].lower(), bool(tag[1])
            if name not in DROPPED:
                yield "", closing, name, page[tag.end() : end]
            elif not closing and page[end - 1] != "/" and name not in unclosed:
                close = _CLOSE[name].search(page, at)
                if close:
                    at = close.end()
                elif name in ("script", "style", "textarea", "title"):
                    return
                else:
                    unclosed.add(name)
        elif page.startswith(("<!--", "<![CDATA["), at):
            end = page.find("-->" if page.startswith("<!--", at) else "]]>", at + 4)
            at = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?", "</"), at) and at < last:
            at = page.find(">", at) + 1
        else:
            yield "<", False, "", ""
            at += 1


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order, each with its region; text is unescaped, with single spaces."""
    places = [Place("", 0, False)]
    stack, inside = [0], Counter()  # open places, and how many of them by name
    links, breaks = 0, 0
    out = [Block(0, 0, "plain", False)]

    def start(heading: bool = False) -> None:
        if out[-1].parts:
            out.append(Block(stack[-1], 0, "plain", heading))
        else:
            out[-1].place, out[-1].heading = stack[-1], heading

    for text, closing, name, attributes in _tokens(page):
        if not name:
            text = html.unescape(text)
            out[-1].parts.append(text)
            if links:
                out[-1].linked.append(text)
            if not text.isspace():
                breaks = 0
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            breaks += 1
            out[-1].parts.append(" ")
            if breaks > 1:
                start()
        elif name in BREAKS:
            links = breaks = 0
            if name in REGIONS:
                if closing:
                    while inside[name]:
                        last = places[stack.pop()].name
                        inside[last] -= 1
                        if last == name:
                            break
                else:
                    if name == "body" and inside["head"]:
                        stack = [k for k in stack if places[k].name != "head"]
                        inside["head"] = 0
                    places.append(Place(name, stack[-1], name not in WHOLE and bool(attributes) and _aside(attributes)))
                    stack.append(len(places) - 1)
                    inside[name] += 1
            start(name in HEADINGS and not closing)
    _resolve(places)
    kept = []
    for b in out:
        b.region, b.kind = places[b.place].region, places[b.place].kind
        b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
        if b.text:
            kept.append(b)
    return kept


def _density(text: str) -> float:
    found = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in found) / len(found) if found else 0.0


def has_prose(found: list[Block]) -> bool:
    """Whether a longer block that may be main text has the stop words of prose: the page's language has a list."""
    return any(len(b.text) >= LENGTH_SHORT and b.kind != "beside" and not _linked(b) and _density(b.text) >= STOP_HIGH for b in found)


def _other_script(text: str) -> bool:
    """Whether most letters are of a script that none of the listed languages is written in."""
    letters = "".join(_WORD.findall(text))
    return 2 * sum(c > _LATIN_END for c in letters) > len(letters)


def _linked(block: Block) -> bool:
    return len(_SPACE.sub(" ", "".join(block.linked)).strip()) > MOST_LINKED * len(block.text)


def first_pass(block: Block, listed: bool = True) -> str:
    """good, bad, or - undecided - short, near or low. listed: stop words tell something about the page."""
    size = len(block.text)
    if block.kind == "beside" or _linked(block):
        return "bad"
    if size < LENGTH_SHORT:
        return "short"
    density = _density(block.text) if listed else STOP_HIGH
    if density < STOP_LOW and _other_script(block.text):
        density = STOP_HIGH
    if density >= STOP_HIGH:
        return "good" if size > LENGTH_LONG or block.kind == "article" else "near"
    return "near" if density >= STOP_LOW or block.kind == "article" else "low"


def second_pass(found: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided one of their region, else of the page; good wins a tie.

    Where the page has no good block, or nothing is decided, they are the text.
    """
    first = [b.label for b in found]
    for regional in (True, False):
        groups: dict[int, list[int]] = {}
        for k, b in enumerate(found):
            groups.setdefault(b.region if regional else 0, []).append(k)
        for rows in groups.values():
            before, last = {}, None
            for place, k in enumerate(rows):
                if first[k] in ("good", "bad"):
                    last = (place, first[k])
                before[k] = last
            after = None
            for place in range(len(rows) - 1, -1, -1):
                k = rows[place]
                if first[k] in ("good", "bad"):
                    after = (place, first[k])
                elif found[k].label in UNDECIDED:
                    near = [(abs(p - place), label != "good", label) for p, label in filter(None, (before[k], after))]
                    if near and (found[k].label == "near" or found[k].heading) and any(x[2] == "good" for x in near):
                        found[k].label = "good"
                    elif near:
                        found[k].label = min(near)[2]
        if regional:
            for b in found:  # nothing in its region is decided: an article is trusted
                if b.label in UNDECIDED and b.kind == "article":
                    b.label = "good"
    if all(b.label != "good" for b in found):
        for b, label in zip(found, first, strict=True):
            b.label = "good" if label in UNDECIDED else "bad"


def main_text(page: str | None) -> str:
    """The page's main text: its good blocks in order, one to a line."""
    found = blocks(page or "")
    listed = has_prose(found)
    for b in found:
        b.label = first_pass(b, listed)
    second_pass(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    pages: page_id, url, html; other columns are ignored.  A null or empty page,
    and one without a main text, has the empty text.  Nothing is cut or capped;
    repeated rows come out each; a null page_id or url stays null.
    """

    def extract(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")

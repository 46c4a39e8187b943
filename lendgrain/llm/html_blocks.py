"""Text blocks of a web page with their place in the page, from possibly broken HTML."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

# Element names by what they do, and class or id words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe svg object select annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr "
    "button iframe svg object select textarea script style noscript template annotation annotation-xml "
    "math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mfenced menclose "
    "mpadded mphantom mstyle merror mtable mtr mtd".split())
FURNITURE_TAGS = frozenset("nav footer head button dialog menu".split())
#: Furniture too, unless they hold the page's main text; an aside only if it was never closed.
LOOSE_TAGS = frozenset("aside form".split())
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos "
    "promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login sidebar sidebars rail aside menu menus nav navbar navigation breadcrumb breadcrumbs footer foot header "
    "masthead topbar toolbar comment comments disqus respond reply replies discussion related recommended share sharing "
    "social widget widgets pagination pager search skip copyright disclaimer".split())
ARTICLE_WORDS = frozenset("article entry post story content main".split())
#: In an article, and on paragraphs and headings, other words beside one of FURNITURE_WORDS in a name make it another
#: thing (related-work, notice-period), unless they are among these; the words of DOUBTFUL alone say nothing there.
COMPANIONS = FURNITURE_WORDS | frozenset(
    "a area article articles bar block body box btn button buttons card cards container content count entry float form group hide "
    "holder inline inner input item items label left link links list main mobile more note page panel post posts primary reader read right "
    "row secondary section site slot small social sticky story stories text the title top unit user wrap wrapper xs sm md lg xl".split())
DOUBTFUL = frozenset("discussion notice notices copyright disclaimer search skip menu menus rail alert foot header".split())
NAMED_TEXT = frozenset("p h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
}
#: Not furniture by their own class or id; in an article or main element nor are headings and parts of tables.
FRAMES = frozenset("html body main".split())
STRUCTURE = frozenset("h1 h2 h3 h4 h5 h6 tr td th thead tbody tfoot caption".split())
SCOPES = frozenset("ul ol dl table article main section div body html".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)|<[!?][^>]*+(?:>|\Z)", re.S)
#: What a tag holds after its name. A quote opens a value only after "=". A closing quote that follows "=" and a ">"
#: opens another value: the first quote was never closed and counts as a letter, as does one without any other.
INSIDE = re.compile(
    r"(?:[^>=]++|=\s*+(?:\"(?:[^\">]*+\"|[^\"]*+(?<!=)\")|'(?:[^'>]*+'|[^']*+(?<!=)'))?+)*+")
ATTRIBUTE = re.compile(r"(?<![^\s\"'>/=])([^\s\"'>/=]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACES = re.compile(r"\s+")


class Element(NamedTuple):
    tag: str
    path: str
    furniture: bool  # by tag, role or style
    within: str  # article, main or nothing
    marked: tuple[str, ...] = ()  # paths of the elements from here up that class or id words call furniture


class Block(NamedTuple):
    path: str
    text: str
    furniture: bool
    within: str
    article: int  # number of the outermost article it lies in, or -1


def names_furniture(tag: str, tokens: list[str], above: Element) -> bool:
    """Whether class or id tokens call an element furniture."""
    strict = above.within == "article" or tag in NAMED_TEXT
    every, found = set(), set()
    for token in tokens:
        words = {w.lower() for w in NAME_WORDS.findall(token)}
        every |= words
        hit = words & FURNITURE_WORDS
        if strict and (words - COMPANIONS or words <= DOUBTFUL):
            hit = set()
        found |= hit
    return bool(found) and not (every & ARTICLE_WORDS and found <= {"header", "banner", "main", "notice", "share"})


def open_element(tag: str, attributes: str, above: Element) -> Element:
    """Element for a start tag; its path is the labels of the elements around it, without digits."""
    furniture, label, marked = above.furniture or tag in FURNITURE_TAGS, tag, False
    if attributes and "=" in attributes or "hidden" in attributes:
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        names = f"{named.get('class', '')} {named.get('id', '')}"
        words = {w.lower() for w in NAME_WORDS.findall(names)}
        label = ".".join([tag, *sorted(words)])
        if words & FURNITURE_WORDS and names_furniture(tag, names.split(), above):
            marked = tag not in FRAMES and not (tag == "article" and above.within != "article") and not (tag in STRUCTURE and above.within)
        furniture |= named.get("role", "").lower() in FURNITURE_ROLES or named.get("aria-hidden", "").lower() == "true"
        furniture |= bool(HIDDEN.search(named.get("style", "")))
        if "hidden" in attributes.lower():
            furniture |= "hidden" in named or bool(re.search(r"(?:^|\s)hidden(?=\s|$|/)", ATTRIBUTE.sub(" ", attributes), re.I))
    if tag == "header" and not above.within:
        furniture = True
    marked |= tag in LOOSE_TAGS
    within = above.within if above.within == "article" or tag not in ("article", "main") else tag
    path = f"{above.path}>{label}"
    return Element(tag, path, furniture, within, (path, *above.marked) if marked else above.marked)


def judged(held: list[tuple[Element, str, int]], mains: set[str], articles: list[tuple[str, ...]], sizes: list[int],
           firm: set[str]) -> list[Block]:
    """Blocks with what their marks amount to.

    A marked element is no furniture if it holds a main element, the longest article, or most of the text that
    is no furniture by other signs; nor are elements with its path. ``firm`` paths stay furniture in any case.
    """
    pardoned, size, total = set(mains), Counter(), 0
    sizes = [0 if firm.intersection(marks) else n for marks, n in zip(articles, sizes)]
    if any(sizes):
        pardoned.update(articles[sizes.index(max(sizes))])
    for home, text, _ in held:
        if not home.furniture:
            total += len(text)
            for path in home.marked:
                size[path] += len(text)
    pardoned.update(path for path, n in size.items() if 2 * n > total)
    pardoned -= firm
    return [Block(home.path, text, home.furniture or not pardoned.issuperset(home.marked), home.within, article)
            for home, text, article in held]


def blocks_of(html: str) -> tuple[list[Block], dict[str, str]]:
    """Blocks in page order, and the presentation (runs of child labels) of every element path."""
    stack = [Element("", "", False, "")]
    blocks: list[tuple[Element, str, int]] = []
    mains: set[str] = set()
    articles: list[tuple[str, ...]] = []  # marks around each outermost article, and how much text it holds
    sizes: list[int] = []
    closed: set[str] = set()  # paths of asides with an end tag
    children: dict[str, list[str]] = {}
    held: list[str] = []
    home = stack[0]

    def flush() -> None:
        nonlocal home
        if held:
            text = SPACES.sub(" ", unescape("".join(held))).strip()
            if text:
                blocks.append((home, text, len(sizes) - 1 if home.within == "article" else -1))
                if home.within == "article" and not home.furniture:
                    sizes[-1] += len(text)
            held.clear()

    def block_of() -> Element:
        for element in reversed(stack):
            if element.tag not in INLINE:
                return element
        return stack[0]

    def hold(text: str) -> None:
        nonlocal home
        if stack[-1].tag == "head" and not text.isspace():
            flush()
            stack.pop()
        block = block_of()
        if stack[-1].furniture > block.furniture or len(stack[-1].marked) > len(block.marked):
            return  # a hidden or marked inline element inside a block that stays
        if not held:
            home = block
        held.append(text)

    def close(tags: set[str], scopes: frozenset) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in scopes:
                return

    at, open_end = 0, False
    while True:
        m = TAG.search(html, at)
        if m is None:
            hold(html[at:])
            break
        if m.start() > at:
            hold(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, inside = m[2].lower(), at
        at = len(html) if open_end else INSIDE.match(html, at).end()
        if at == len(html):  # a tag that the page's end cuts off; it and all after it go up to their first ">"
            open_end, at = True, html.find(">", inside)
            if at < 0:
                break
        attributes = html[inside:at]
        at += 1
        if tag == "br":
            hold(" ")
            continue
        if tag not in INLINE:
            flush()
        if m[1]:
            if tag in VOID:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag == "aside":
                        closed.add(stack[i].path)
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in VOID:
            continue
        if tag not in IN_HEAD and any(element.tag == "head" for element in stack):
            close({"head"}, frozenset())
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I).search(html, at)
            if not attributes.rstrip().endswith("/"):
                at = end.end() if end else len(html)
            continue
        if tag not in INLINE:
            close({"p"}, SCOPES)
            if tag in CLOSED_BY:
                close(CLOSED_BY[tag], SCOPES)
        element = open_element(tag, attributes, stack[-1])
        if tag == "main" and not element.furniture:
            mains.update(element.marked)
        if tag == "article" and stack[-1].within != "article":
            articles.append(element.marked)
            sizes.append(0)
        row = children.setdefault(stack[-1].path, [])
        label = element.path.rpartition(">")[2]
        if not row or row[-1] != label:
            row.append(label)
        children.setdefault(element.path, [])
        if not attributes.endswith("/"):
            stack.append(element)
    flush()
    return judged(blocks, mains, articles, sizes, closed), {path: " ".join(row) for path, row in children.items()}


def ancestors(path: str) -> list[str]:
    """A path and all above it, without the page itself."""
    parts = path.split(">")
    return [">".join(parts[:i]) for i in range(2, len(parts) + 1)]

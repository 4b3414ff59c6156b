"""HTML pages as flat blocks of text, each with its words, its words in links, and what encloses it."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Fixed values, by the HTML standard: elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Elements whose content is not markup, and elements whose content is not shown as text.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
UNSEEN = frozenset("head noscript template svg math select datalist object canvas audio video map button".split())
#: Elements that enclose blocks and are followed to their end, and those of them that only their own end, or that of one around them, ends.
ENCLOSING = frozenset("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table td th ul".split()) | UNSEEN
FIRM = frozenset("article aside footer form header main nav section table".split())
IN_HEAD = frozenset("base basefont bgsound link meta noscript template".split())
#: Words in classes, ids and roles that name what isn't the article, what is reader comments, and what is the article.
ASIDE = frozenset(
    "ad ads advert advertisement adsense adslot banner billboard breadcrumb breadcrumbs consent contentinfo cookie cookies copyright dfp "
    "footer gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination paywall popup popular "
    "privacy promo promoted promotion recommended related share sharing sidebar signup skyscraper social sponsor sponsored subscribe "
    "subscription tags teaser toolbar topbar trending widget alert complementary search".split()
)
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
ARTICLE = frozenset("article articlebody blogpost content entry main post story".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Place(NamedTuple):
    """What encloses a block: menus, headers, footers, asides, forms or what is hidden; what names it so; comments; the article."""

    chrome: bool = False
    aside: bool = False
    comments: bool = False
    article: bool = False
    unseen: bool = False


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    kind: str
    place: Place


def named(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's names say aside, comments or article."""
    aside = comments = article = False
    for found in NAMES.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").split():
            parts = [x.lower() for x in PARTS.findall(name)]
            if not parts or parts[0] in ("has", "with", "no", "is", "js", "without"):
                continue
            own = not ARTICLE.isdisjoint(parts)
            comments |= not COMMENTS.isdisjoint(parts)
            aside |= any(x in ASIDE and not (own and x in ("header", "tags")) for x in parts)
            article |= own
    return aside, comments, article


def inside(place: Place, name: str, attributes: str) -> Place:
    """The place within an element."""
    chrome, aside, comments, article, unseen = place
    says = named(attributes) if attributes else (False, False, False)
    if name in ("article", "main"):
        return Place(False, False, comments or says[1], True, unseen)
    chrome |= name in ("nav", "footer", "aside", "form", "dialog", "menu") or name == "header" and not article
    if attributes and HIDDEN.search(attributes):
        chrome = True
    return Place(chrome, aside or says[0], comments or says[1], article or says[2] and not (says[0] or aside or chrome), unseen or name in UNSEEN)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order. Unclosed and stray tags, unclosed comments, scripts and attributes don't stop it."""
    blocks: list[Block] = []
    pieces: list[str] = []
    stack: list[tuple[str, Place]] = []
    place, kind, linked, link_depth, at = Place(), "", 0, -1, 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not place.unseen:
            piece = html.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if link_depth >= 0:
                linked += len(piece.split())

    def close() -> None:
        nonlocal linked
        if pieces:
            words = "".join(pieces).split()
            if words:
                blocks.append(Block(" ".join(words), len(words), min(linked, len(words)), kind, place))
            pieces.clear()
        linked = 0

    def leave(depth: int) -> None:
        nonlocal place, link_depth
        del stack[depth:]
        place = stack[-1][1] if stack else Place()
        link_depth = -1 if link_depth > depth else link_depth  # a link ends with what encloses it

    while found := TOKEN.search(page, at):
        text(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name in BLOCKS or name in UNSEEN:
                close()
                kind = ""
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        leave(depth)
                        break
                    if stack[depth][0] in FIRM and name not in FIRM:
                        break
            elif name == "a":
                link_depth = -1
            continue
        if name in RAW:
            end = ENDS[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if stack and stack[-1][0] == "head" and name not in IN_HEAD:
            leave(len(stack) - 1)
        if name in BLOCKS or name in UNSEEN:
            close()
            kind = name
        if name in ENCLOSING and not found[3].endswith("/"):
            stack.append((name, place := inside(place, name, found[3])))
        elif name == "a":
            link_depth = len(stack)
        elif name == "br":
            text(" ")
    text(page[at:])
    close()
    return blocks

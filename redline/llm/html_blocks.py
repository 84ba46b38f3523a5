"""Text blocks of an HTML page and what its markup says of them.

One pass over the tags with a stack of open elements.  Tags may be unclosed,
unmatched or cut off; nothing raises.  A block is the text between two block
tags, its references decoded and its white space (a ``br`` too) one space.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

#: Verdict of the markup: the block belongs to the article, or is left open.
KEEP, OPEN = 0, 1

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<(script|style|noscript|iframe|noembed|noframes|xmp|template|title|textarea)(?=[\s/>])(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMES = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: Elements that hold no part of an article.
DROPPED = frozenset("head nav footer aside form dialog menu search button select option svg math canvas object audio video map".split())
#: An article may stand in one of these (a page-wide form, a nav that is never closed).
PASSES = frozenset("nav header form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Names in a class or id that mark other parts of a page than its article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner sponsor sponsored sponsors promo promos promotion cookie cookies "
    "consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar sidebars widget widgets nav navbar navigation "
    "menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar comment comments commentlist disqus respond replies reply toolbar login "
    "share sharing social related recommended recommendations skip".split()
)
HEADER = frozenset(["header"])
#: Names that make of "header" a part of the article.
BODY = frozenset("article post entry content story main".split())
_CLOSES = {  # an opening tag ends these open ones, up to the list or table they are in
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 html body".split())


def _unwanted(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is no part of an article."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or attributes.isspace():
        return False
    names: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            for name in value.split():
                parts = set(_NAMES.findall(name))
                names |= parts if parts & HEADER and not parts & BODY and not in_article else parts - HEADER
        elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return tag not in _HEADINGS and bool(names & MARKS or names & HEADER)


def _tagged(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(text before the tag, tag, attributes, whether it ends)."""
    at = 0
    for m in _TOKEN.finditer(page):
        if m[3] is None:
            yield page[at : m.start()], "", "", False
        else:
            yield page[at : m.start()], m[3].lower(), m[4], m[2] == "/"
        at = m.end()
    yield page[at:], "", "", False


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page that its markup does not exclude, in order, with
    ``KEEP`` or ``OPEN``.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
    and comments are left out by their elements, roles, class and id names.  If
    some block is left in an ``article`` (best in ``main``) or else in ``main``,
    the others are left out; in an ``article``, blocks of nothing but links are
    open.  Without either, every block is open.
    """
    out: list[tuple[str, int, bool]] = []  # text, rank of its place, all in links
    stack: list[tuple[str, bool, int]] = []  # tag, unwanted (or inside such), rank
    text: list[str] = []
    linked = plain = False  # characters in links and outside them
    links = 0
    unwanted, rank = False, 0
    open_tags: Counter[str] = Counter()

    def end_block() -> None:
        nonlocal linked, plain
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((line, rank, linked and not plain))
            text.clear()
        linked = plain = False

    def pop_to(depth: int) -> None:
        nonlocal unwanted, rank
        if len(stack) > depth:
            open_tags.subtract(name for name, _, _ in stack[depth:])
            del stack[depth:]
            _, unwanted, rank = stack[-1] if stack else ("", False, 0)

    for before, tag, attributes, ends in _tagged(page or ""):
        if before and not unwanted:
            text.append(before)
            if not before.isspace():
                linked, plain = linked or links > 0, plain or not links
        if not tag:
            continue
        block = tag in BLOCK
        if block:
            end_block()
        if tag == "br":
            if not unwanted:
                text.append(" ")
        elif tag == "a":
            links = 0 if ends else 1
        elif ends:
            for depth in range(len(stack) - 1, -1, -1) if open_tags[tag] > 0 else ():
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
                if not block and stack[depth][0] in BLOCK:
                    break
        elif tag not in VOID:
            if block:
                links = 0
                closes, until = _CLOSES.get(tag, (None, frozenset()))
                for depth in range(len(stack) - 1, max(-1, len(stack) - 64), -1):
                    name = stack[depth][0]
                    if name == "p" or closes and name in closes:
                        pop_to(depth)
                    elif name in until or name in BLOCK and not closes:
                        break
            if tag in ("article", "main"):
                if unwanted and all(name in PASSES or not bad for name, bad in _causes(stack)):
                    unwanted = False
                rank |= 2 if tag == "article" else 1
            bad = unwanted or _unwanted(tag, attributes, bool(rank & 2))
            if block or bad:
                stack.append((tag, bad, rank))
                open_tags[tag] += 1
                unwanted = bad
    end_block()
    best = max((r for _, r, _ in out), default=0)
    return [(line, OPEN if not best or in_links and best & 2 else KEEP) for line, r, in_links in out if r == best]


def _causes(stack: list[tuple[str, bool, int]]) -> Iterator[tuple[str, bool]]:
    """Elements of the stack and whether each is the first unwanted one since a wanted one."""
    before = False
    for name, bad, _ in stack:
        yield name, bad and not before
        before = bad

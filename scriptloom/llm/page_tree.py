"""Block trees of HTML pages: block elements and the texts right inside them, with features of each node."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

#: Element names by how they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title".split())
#: Parts of formulas, which stay in their sentence, and of drawings; a slash ends these, as it doesn't end other elements.
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd maction semantics annotation".split())
SVG = frozenset("svg g path circle ellipse rect line polyline polygon use defs symbol text tspan lineargradient radialgradient stop clippath mask filter image".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var img br wbr input".split())
#: An element that starts ends an open one of these, unless one of the fences lies between.
ENDS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "tbody": ("thead", "tr", "td", "th"),
    "option": ("option",),
}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
FENCES = frozenset("ul ol dl table html body".split())
#: What nests deeper hangs from the element at this depth, as browsers do it; so the levels of a tree are few.
MOST_DEPTH = 512

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)|=)*)>?|<[!?][^>]*>?""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
#: The end of a start tag that closes itself: a slash that isn't part of an unquoted value. Only SVG's and MathML's elements heed it.
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
NAME_PART = re.compile(r"[a-z]+")

#: Parts of class, id and role names that tell what an element is for.
NAME_HINTS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs",
    "head": "header head masthead topbar banner logo toolbar",
    "foot": "footer foot copyright colophon bottom legal",
    "side": "sidebar side aside rail widget widgets related recommended recommendations trending popular more complementary",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsbox affiliate",
    "notice": "cookie cookies consent notice notices alert modal popup overlay gdpr paywall newsletter subscribe subscription signup",
    "form": "form search login contact contactform poll survey",
    "talk": "comment comments discussion disqus reply replies respond responses reviews",
    "share": "share sharing social follow tags tagcloud meta byline author",
    "main": "article content main post entry story text body page maincontent articlebody prose",
}
HINT_OF = {part: hint for hint, parts in NAME_HINTS.items() for part in parts.split()}
TAGS = "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table tr td th figure figcaption nav header footer aside form fieldset button address details".split()
TAG_OF = {t: t for t in TAGS}


@dataclass
class Tree:
    """parent[i] < i for all nodes but the root, node 0; text is None for elements."""

    parent: list[int] = field(default_factory=list)
    features: list[list[str]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    label: list[int] = field(default_factory=list)


def _leaf_features(text: str, linked: int, tag: str) -> list[str]:
    size = len(text)
    share = linked / size
    return [
        f"length:{min(6, int(math.log2(size + 1) / 1.5))}",
        "linked:" + ("none" if not linked else "some" if share < 0.5 else "most"),
        "ends:" + ("sentence" if text[-1] in ".!?…\"”»:;。" else "open"),
        f"in:{TAG_OF.get(tag, 'other')}",
        "sign:" + ("copyright" if "©" in text[:40] else "none"),
    ]


@dataclass
class _Open:
    """An open block element: its node, its name, the open inline elements right inside, and whether these names are open since the last fence."""

    node: int
    tag: str
    inline: Counter[str]
    scope: Counter[str]


def parse(page: str) -> Tree:
    """The tree of a page.  Unclosed, crossing and cut-off markup is read as browsers do, roughly: nothing fails.

    The time is linear in the page's length: an end tag without a start and a
    start that ends nothing are told by counts, without a walk up the tree.
    """
    tree = Tree()
    stack: list[_Open] = []
    is_open: Counter[str] = Counter()
    pieces: list[str] = []
    linked = n_links = 0

    def add(tag: str, attributes: str) -> int:
        hints, label = set(), None
        for m in ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "data-y":
                label = int(value) if value.isdigit() else None
            else:
                hints.update(HINT_OF[p] for p in NAME_PART.findall(value) if p in HINT_OF)
        parent = stack[min(len(stack), MOST_DEPTH) - 1].node if stack else -1
        tree.parent.append(parent)
        tree.features.append([f"tag:{TAG_OF.get(tag, 'other')}", *(f"name:{h}" for h in sorted(hints))])
        tree.text.append(None)
        tree.label.append(label if label is not None else tree.label[parent] if parent >= 0 else 0)
        return len(tree.parent) - 1

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                tree.parent.append(stack[-1].node)
                tree.features.append(_leaf_features(text, min(linked, len(text)), stack[-1].tag))
                tree.text.append(text)
                tree.label.append(tree.label[stack[-1].node])
            pieces.clear()
        linked = 0

    def start(tag: str, attributes: str) -> None:
        flush()
        scope = Counter() if tag in FENCES or not stack else stack[-1].scope
        stack.append(_Open(add(tag, attributes), tag, Counter(), scope))
        is_open[tag] += 1
        if tag not in FENCES:
            scope[tag] += 1

    def close(names: tuple[str, ...]) -> None:
        """End the innermost open element of these names, and all inside it."""
        nonlocal n_links
        flush()
        while len(stack) > 1:
            ended = stack.pop()
            is_open[ended.tag] -= 1
            if ended.tag not in FENCES:
                ended.scope[ended.tag] -= 1
            n_links -= ended.inline["a"]
            if ended.tag in names:
                break

    start("html", "")
    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            piece = page[at:stop]
            if "&" in piece:
                piece = html.unescape(piece)
            pieces.append(piece)
            if n_links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        inline = tag in INLINE or tag in MATH
        if tag in RAW and not (is_open["svg"] and SELF_CLOSED.search(m[3])):
            if not closing:
                over = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = over.end() if over else end
        elif not closing and (tag in MATH or tag in SVG or tag in RAW) and SELF_CLOSED.search(m[3]):
            pieces.append(" ")
        elif tag == "br" or (tag in VOID and not inline):
            pieces.append(" ")
            if not inline:
                flush()
        elif tag in VOID:
            pass
        elif inline:
            own = stack[-1].inline
            if not closing or own[tag]:
                own[tag] += -1 if closing else 1
                n_links += (-1 if closing else 1) * (tag == "a")
        elif closing:
            if is_open[tag] and not (len(stack) == 1 or (tag == "html" and is_open[tag] == 1)):
                close((tag,))
        elif tag not in ("html", "body") or not is_open[tag]:
            ended = ENDS.get(tag, ())
            if any(stack[-1].scope[x] for x in ended):
                close(ended)
            elif stack[-1].tag == "p" or (stack[-1].tag in HEADINGS and tag in HEADINGS):
                close((stack[-1].tag,))
            start(tag, m[3])
    flush()
    return tree

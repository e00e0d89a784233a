"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree: elements and, as leaves, runs of text. Every node has a
hidden label, content or boilerplate. A node's potential is a logistic score of
its own features (kind of tag, groups of words in its class, id and role, size,
links and sentences of the text below it, place on the page); an edge's potential
says how well the labels of parent and child go together. Sum-product messages
upward and downward give every node's exact marginal, in time linear in the tree.
Text whose marginal is above one half is the main text.

No feature says what stands above a node, except that it is beside a marked
article, or a header or links in one; so what a sidebar in an article holds is known to be a
sidebar's by the messages alone.

Words of a class count by group and by place in their compound: what the compound
is (``comment-list``, ``ad-slot``) or what it is about (``related-work``). Each group
has a fitted weight for either, so no word decides; a class that says what an
element has (``with-sidebar``) says nothing of what it is.

Both kinds of potentials are fitted together (``fit``) on labelled pages: pages
composed for the purpose, whose parts are labelled as they are put in, with
telling, misleading and meaningless classes; and a bounded sample of the corpus's
own pages, labelled by the mark of their article alone.

Defined results: a null or empty page gives an empty text; a page with no text
above one half gives an empty text; unclosed, misnested and unknown tags are
read as browsers read the common cases; repeated rows get equal results; nothing
is cut from long pages, and time grows in proportion to a page, however deep.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from counterpoise.llm.words import slices

SAMPLE_PAGES = 200
COMPOSED_PAGES = 500
ROUNDS = 400
RATE = 0.5
RIDGE = 1e-4
SEED = 31
BATCH_BYTES = 4 << 20

# Groups of element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp noembed svg math".split())
NO_TEXT = RAW | frozenset("head select option datalist object canvas audio video map".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
MAIN_TAGS = frozenset("article main".split())
TAG_GROUPS = (
    frozenset("nav menu".split()),
    frozenset(["aside"]),
    frozenset(["header"]),
    frozenset(["footer"]),
    frozenset("form button fieldset dialog label input".split()),
    frozenset("h1 h2 h3 h4 h5 h6".split()),
    frozenset("p blockquote pre figure figcaption address".split()),
    frozenset("ul ol li dl dt dd".split()),
    frozenset("table caption tr td th tbody thead tfoot".split()),
    frozenset("div section span html center".split()),
)
PLAIN = TAG_GROUPS[-1]
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SELF_CLOSING = {  # an opening tag ends an open element of these names, up to the barrier
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
SCOPE = frozenset("td th table caption button html body".split())

# Words of class, id and role by what they commonly mean, a group a line.
WORD_GROUPS = tuple(
    frozenset(line.split())
    for line in (
        "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toc tabs",
        "header masthead banner topbar branding logo",
        "footer foot bottom colophon copyright contentinfo legal imprint",
        "sidebar aside widget widgets rail related recommended recommendations popular trending teaser teasers complementary",
        "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion promoted commercial",
        "cookie cookies consent gdpr notice notices alert alerts popup modal overlay disclaimer",
        "form search newsletter subscribe subscription signup login register",
        "share sharing social toolbar tools",
        "comment comments commentlist commenters reply replies respond disqus discussion",
        "article main content post entry story body text articlebody maincontent",
    )
)
# Words that name no kind of thing, so the word before them does; words behind which something is had, not been.
GENERIC = frozenset("list item items box block wrap wrapper container area section inner outer bar row col column link links panel holder slot unit zone group set".split())
HAVING = frozenset("with has have no without is in on not js".split())
LEGAL = re.compile(r"\xa9|\bcopyright\b|\ball rights reserved\b", re.I)
MARK = re.compile(r"\bdata-y=[\"']?([01])")

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_WORD = re.compile(r"[a-z]+")
_NAMED = frozenset(["class", "id", "role"])


@dataclass
class Tree:
    """Nodes in page order: parents stand before their children."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)  # "" for text
    words: list[tuple] = field(default_factory=list)  # word groups: 2g if the element is such a thing, 2g + 1 if about one
    mark: list[int] = field(default_factory=list)  # 0 or 1 where a training page says so, else -1
    text: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)  # texts of one block are joined without a break

    def add(self, parent: int, tag: str, words: tuple, text: str, block: int, mark: int = -1) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.words.append(words)
        self.mark.append(mark)
        self.text.append(text)
        self.block.append(block)
        return len(self.parent) - 1


@lru_cache(maxsize=4_096)
def _groups(value: str) -> tuple:
    """Word groups of the value of a class, id or role."""
    found = set()
    for name in value.split():
        words = _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        if HAVING.intersection(words[:-1]):
            continue
        while len(words) > 1 and words[-1] in GENERIC:
            words.pop()
        for i, word in enumerate(words):
            for g, group in enumerate(WORD_GROUPS):
                if word in group:
                    found.add(2 * g + (i < len(words) - 1))
    return tuple(sorted(found))


def _words(attributes: str) -> tuple:
    if "class" not in attributes and "id" not in attributes and "role" not in attributes:
        lowered = attributes.lower()
        if "class" not in lowered and "id" not in lowered and "role" not in lowered:
            return ()
    found: tuple = ()
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() in _NAMED and value:
            found += _groups(entities.unescape(value.strip("\"'")))
    return found


def parse(page: str) -> Tree:
    """The page's tree; text below elements that show none is left out."""
    tree = Tree()
    tree.add(-1, "html", (), "", 0)
    stack = [(0, "html")]
    places: dict[str, list[int]] = {}  # of each open element's name, in the stack
    block, at, hidden = 1, 0, 0
    pending: list[str] = []

    def flush() -> None:
        if pending:
            text = entities.unescape("".join(pending))
            pending.clear()
            if text.strip():
                tree.add(stack[-1][0], "", (), text, block)
            elif text and (tree.tag[-1] == "" or tree.tag[-1] in INLINE):
                tree.add(stack[-1][0], "", (), " ", block)

    def pop(to: int) -> None:
        nonlocal hidden, block
        while len(stack) > to:
            _, name = stack.pop()
            places[name].pop()
            hidden -= name in NO_TEXT
            if name not in INLINE:
                block += 1

    def nearest(names: frozenset | set, barrier: frozenset) -> int | None:
        """Place of the innermost open element of these names, unless a barrier stands further in."""

        def innermost(of: frozenset | set) -> int:
            return max((places[n][-1] for n in of if places.get(n)), default=0)

        place = innermost(names)
        return place if place and place >= innermost(barrier) else None

    def leave_head() -> None:
        """Without its closing tag a head ends before the first text or element that may not stand in it."""
        if stack[-1][1] == "head":
            flush()
            pop(len(stack) - 1)

    def say(text: str) -> None:
        if hidden and text.strip(" \t\n\f\r"):
            leave_head()
        if not hidden:
            pending.append(text)

    for match in _TOKEN.finditer(page):
        if match.start() < at:
            continue
        if match.start() > at:
            say(page[at : match.start()])
        at = match.end()
        closing, name, attributes = match.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name == "p" and nearest({"p"}, SCOPE) is None:
                flush()
                block += 1
                continue
            place = nearest({name}, frozenset(["td", "th", "table"]) if name in INLINE or name == "p" else frozenset())
            if place is not None:
                flush()
                pop(place)
            continue
        if name not in IN_HEAD:
            leave_head()
        if name == "br":
            pending.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
                block += 1
            continue
        flush()
        if name in CLOSES_P and (place := nearest({"p"}, SCOPE)) is not None:
            # formatting left open in a paragraph goes on behind it
            pop(place)
        if name in SELF_CLOSING and (place := nearest(*SELF_CLOSING[name])) is not None:
            pop(place)
        if name not in INLINE:
            block += 1
        if name in ("html", "body"):
            continue
        told = MARK.search(attributes) if "data-y" in attributes else None
        node = tree.add(stack[-1][0], name, _words(attributes), "", block, int(told[1]) if told else -1)
        if attributes.endswith("/") and name in ("svg", "math", "path"):
            continue
        places.setdefault(name, []).append(len(stack))
        stack.append((node, name))
        hidden += name in NO_TEXT
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            pop(len(stack) - 1)
    if at < len(page):
        say(page[at:])
    flush()
    return tree


FEATURES = (
    "bias", "leaf", "inline", "main_tag", "heading_below", "main_below", "beside_main", "header_in_main",
    "nav_tag", "aside_tag", "header_tag", "footer_tag", "form_tag", "heading_tag", "prose_tag", "list_tag", "table_tag", "plain_tag",
    "length", "short", "long", "links", "short_links", "in_link", "sentences", "legal", "at_start", "at_end",
    "share", "unmarked_share", "unmarked_sentences", "links_in_main",
    *(f"{kind}_{g}" for g in ("nav", "header", "footer", "side", "ad", "notice", "form", "share", "comment", "main") for kind in ("is", "about")),
)
_FIRST_TAG, _FIRST_WORD = 8, 32
_TAG_FEATURE = {tag: _FIRST_TAG + i for i, group in enumerate(TAG_GROUPS) for tag in group}


def features(tree: Tree) -> np.ndarray:
    """One row for each node; sizes are of the text below it."""
    n = len(tree.parent)
    parent, tags = tree.parent, tree.tag
    size, linked, told, before = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    in_link, in_main, below, legal, heading = ([False] * n for _ in range(5))
    total = 0.0
    for i in range(1, n):
        up, tag = parent[i], tags[i]
        before[i] = total
        in_link[i] = in_link[up] or tag == "a"
        in_main[i] = in_main[up] or tag in MAIN_TAGS
        if tag == "":
            text = tree.text[i].strip()
            length = float(len(text))
            size[i] = length
            total += length
            linked[i] = length if in_link[i] else 0.0
            told[i] = length if length >= 60 and not in_link[i] else 0.0
            legal[i] = length < 400 and LEGAL.search(text) is not None
    for i in range(n - 1, 0, -1):
        up = parent[i]
        size[up] += size[i]
        linked[up] += linked[i]
        told[up] += told[i]
        below[up] = below[up] or below[i] or tags[i] in MAIN_TAGS
        legal[up] = legal[up] or legal[i]
        heading[up] = heading[up] or heading[i] or tags[i] == "h1"
    out = np.zeros((n, len(FEATURES)))
    size_, before_ = np.array(size), np.array(before)
    leaf = np.array([t == "" for t in tags])
    share = 1.0 / max(total, 1.0)
    out[:, 0] = 1
    out[:, 1] = leaf
    out[:, 2] = [t in INLINE for t in tags]
    out[:, 3] = [t in MAIN_TAGS for t in tags]
    out[:, 4] = heading
    out[:, 5] = below
    out[:, 6] = [below[0] and not (m or b) for m, b in zip(in_main, below)]
    out[:, 7] = [t == "header" and m for t, m in zip(tags, in_main)]
    for i, t in enumerate(tags):
        if (at := _TAG_FEATURE.get(t)) is not None:
            out[i, at] = 1
    link_share = np.array(linked) / np.maximum(size_, 1)
    out[:, 18] = np.log1p(np.minimum(size_, 1_000)) / 8
    out[:, 19] = (size_ < 40) & ~leaf
    out[:, 20] = size_ >= 200
    out[:, 21] = link_share
    out[:, 22] = link_share * (size_ < 400)
    out[:, 23] = in_link
    out[:, 24] = np.array(told) / np.maximum(size_, 1)
    out[:, 25] = np.array(legal) & (size_ < 400)
    out[:, 26] = np.maximum(0.0, 1 - 20 * before_ * share) * (size_ * share < 0.3)
    out[:, 27] = np.maximum(0.0, 1 - 20 * (total - before_ - size_) * share) * (size_ * share < 0.3)
    unmarked = 0.0 if below[0] else 1.0
    out[:, 28] = size_ * share
    out[:, 29] = out[:, 28] * unmarked
    out[:, 30] = out[:, 24] * unmarked
    out[:, 31] = link_share * np.array(in_main)
    for i, words in enumerate(tree.words):
        for w in words:
            out[i, _FIRST_WORD + w] = 1
    return out


def edge_kinds(tree: Tree) -> list[int]:
    """1 for text and formatting, which are parts of what their parent says; 0 for other elements."""
    return [int(t == "" or t in INLINE) for t in tree.tag]


@dataclass(frozen=True)
class TreeModel:
    weights: np.ndarray
    edge: np.ndarray  # log potential of (kind of child, parent label, child label): elements of their own, and text and its formatting

    def marginals(self, tree: Tree) -> np.ndarray:
        """P(content) of every node, by sum-product on the tree.

        Messages are log ratios of content to boilerplate; upward first, then
        downward, each edge once in each direction.
        """
        own = features(tree) @ self.weights
        edges = [tuple(float(x) for x in e.ravel()) for e in self.edge]
        n, parent = len(own), tree.parent
        edge_of = [edges[k] for k in edge_kinds(tree)]
        total = own.tolist()  # own potential and the messages of all children
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            r = total[i]
            bb, bc, cb, cc = edge_of[i]
            # sum over the child's label, for a parent of content and of boilerplate
            up[i] = _soft(cb, cc + r) - _soft(bb, bc + r)
            total[parent[i]] += up[i]
        belief = total[:]
        for i in range(1, n):
            r = belief[parent[i]] - up[i]  # what the parent knows without this child
            bb, bc, cb, cc = edge_of[i]
            belief[i] = total[i] + _soft(bc, cc + r) - _soft(bb, cb + r)
        return 1 / (1 + np.exp(-np.clip(belief, -500, 500)))


def _soft(a: float, b: float) -> float:
    """log(e^a + e^b)."""
    high, low = (a, b) if a > b else (b, a)
    return high + np.log1p(np.exp(low - high)) if high - low < 36 else high


def main_text(model: TreeModel, page: str | None) -> str:
    """Text of content nodes: blanks become one, blocks are joined by one blank."""
    if not page:
        return ""
    tree = parse(page)
    chosen = model.marginals(tree) > 0.5
    blocks: list[str] = []
    last = None
    for i, tag in enumerate(tree.tag):
        if tag == "" and chosen[i]:
            if tree.block[i] == last:
                blocks[-1] += tree.text[i]
            else:
                blocks.append(tree.text[i])
            last = tree.block[i]
    return " ".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def _led(tree: Tree, out: np.ndarray) -> np.ndarray:
    """Plain elements that hold content lead to it and count as content."""
    for i in range(len(out) - 1, 0, -1):
        up = tree.parent[i]
        if out[i] and tree.tag[up] in PLAIN and tree.mark[up] != 0:
            out[up] = True
    return out


def labels_of_marks(tree: Tree) -> np.ndarray | None:
    """Content is what stands in an article or main element; None without one.

    Navigation, asides, footers and forms in it are none, by their tags. Classes
    are not looked at.
    """
    n = len(tree.parent)
    if not any(t in MAIN_TAGS for t in tree.tag):
        return None
    apart = TAG_GROUPS[0] | TAG_GROUPS[1] | TAG_GROUPS[3] | TAG_GROUPS[4]
    out = np.zeros(n, bool)
    for i in range(1, n):
        tag = tree.tag[i]
        out[i] = tag not in apart and (out[tree.parent[i]] or tag in MAIN_TAGS)
    return _led(tree, out)


def labels_of_parts(tree: Tree) -> np.ndarray:
    """Labels of a composed page: of each node, that of the innermost marked element around it."""
    out = np.zeros(len(tree.parent), bool)
    for i in range(1, len(out)):
        out[i] = tree.mark[i] == 1 or (tree.mark[i] < 0 and out[tree.parent[i]])
    return _led(tree, out)


class _Composer:
    """Training pages put together from parts, each labelled as it is put in."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        rng = self.rng
        out = ["".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high))]
        return " ".join(w + (rng.choice(",..;") if rng.random() < 0.12 else "") for w in out).capitalize()

    def opaque(self) -> str:
        return f"{self.rng.choice('abcxyzqw')}{self.rng.randint(1, 99)}"

    def links(self, low: int, high: int) -> str:
        return "".join(f"<li><a href=x>{self.words(1, 5)}</a></li>" for _ in range(self.rng.randint(low, high)))

    def one_of(self, *options: str) -> str:
        return self.rng.choice(options)

    def frame(self, inside: bool = False) -> str:
        """A part around the article, or dropped into it."""
        rng, o = self.rng, self.opaque()
        short, prose, links = self.words(1, 5), self.words(8, 60), self.links(3, 8)
        kind = rng.randint(3 if inside else 0, 8)
        if kind == 0:
            return self.one_of(f"<nav data-y=0><ul>{links}</ul></nav>", f"<div class='{self.one_of('menu', 'top-nav', 'nav-bar', 'breadcrumbs', 'menu-list', 'pagination')}' data-y=0><ul>{links}</ul></div>", f"<div class={o} data-y=0><ul>{links}</ul></div>", f"<ul id=nav data-y=0>{links}</ul>")
        if kind == 1:
            inner = self.one_of(f"<div>{short}</div><a href=/>{short}</a>", f"<h1>{short}</h1><p>{self.words(3, 14)}</p>", f"<h1><a href=/>{short}</a></h1>")
            return self.one_of(f"<header data-y=0>{inner}</header>", f"<div id={self.one_of('header', 'masthead', 'site-header', 'top-banner')} data-y=0>{inner}<p>{self.words(2, 9)}</p></div>")
        if kind == 2:
            text = f"{self.one_of('&copy; 2024', 'Copyright', '(c)')} {short} {self.one_of('All rights reserved.', '', self.words(3, 20))}"
            return self.one_of(f"<footer data-y=0>{text}</footer>", f"<footer data-y=0><p>{text}</p><ul>{links}</ul></footer>", f"<div class={self.one_of('footer', 'site-footer', 'bottom', 'colophon')} data-y=0><p>{text}</p></div>", f"<div class={o} data-y=0>&copy; {text}</div>")
        if kind == 3:
            inner = f"<h3>{short}</h3>{self.one_of(f'<ul>{links}</ul>', f'<p>{prose}</p>', f'<p>{prose}</p><ul>{links}</ul>')}"
            named = self.one_of("sidebar", "widget", "right-rail", "related", "related-links", "widget-area", "popular", "teaser-box", "recommended")
            return self.one_of(f"<aside data-y=0>{inner}</aside>", f"<div class='{named}' data-y=0>{inner}</div>", f"<section id='{named}' data-y=0>{inner}</section>", f"<div class={o} data-y=0><h4>{short}</h4><ul>{links}</ul></div>")
        if kind == 4:
            named = self.one_of("ad", "ads", "advert", "advertisement", "ad-slot", "sponsored", "promo-box", "ad-container", "promoted")
            return self.one_of(f"<div class='{named}' data-y=0>{prose}</div>", f"<div class='{named}' data-y=0><p>{prose}</p></div>", f"<div id='{named}' data-y=0><a href=x>{short}</a></div>", f"<p class={named} data-y=0>{prose}</p>")
        if kind == 5:
            named = self.one_of("cookie-notice", "cookies", "consent", "alert", "notice", "gdpr-banner", "popup", "modal-overlay", "cookie-consent")
            return f"<div {self.one_of('class', 'id')}='{named}' data-y=0><p>{prose}</p>{self.one_of('', '<button>' + short + '</button>')}</div>"
        if kind == 6:
            form = f"<form action=s data-y=0>{self.one_of('', f'<p>{prose}</p>')}<label>{short}</label><input name=m><button>{short}</button></form>"
            named = self.one_of("newsletter", "subscribe-box", "search-form", "login", "signup")
            return self.one_of(form, f"<div class='{named}' data-y=0><p>{self.words(3, 25)}</p>{form}</div>", f"<div class='{named}' data-y=0><p>{prose}</p></div>")
        if kind == 7:
            return f"<div class='{self.one_of('share', 'social-links', 'share-bar', 'toolbar')}' data-y=0>{self.one_of(f'<a href=x>{short}</a> <a href=y>{short}</a>', f'<ul>{links}</ul>', short)}</div>"
        said = "".join(f"<{t} class={self.one_of('comment', 'comment-body', 'reply', self.opaque())}><p>{self.words(2, 110)}</p></{t}>" for t in [self.one_of("div", "li")] for _ in range(rng.randint(1, 5)))
        named = self.one_of("comments", "comment-list", "comments-area", "commentlist", "post-comments", "discussion", "replies", "article-comments")
        tag = self.one_of("div", "section")
        return f"<{tag} {self.one_of('class', 'id')}='{named}' data-y=0>{self.one_of('', f'<h3>{short}</h3>')}{said}</{tag}>"

    def part(self) -> str:
        """A part of an article, sometimes in an element whose class is about something else."""
        rng = self.rng
        prose = self.words(20, 110)
        kind = rng.randrange(14)
        if kind == 13:
            return f"<p>{prose} {self.one_of('Copyright', '&copy; ' + self.words(1, 2))} {self.words(3, 20)}</p>"
        if kind < 5:
            inner = prose if rng.random() < 0.6 else f"{prose} <a href=x>{self.words(1, 4)}</a> <b>{self.words(1, 3)}</b> {self.words(5, 30)}"
            return f"<p{self.one_of('', '', '', ' class=lead', ' class=more', f' class={self.opaque()}')}>{inner}</p>"
        if kind == 5:
            return f"<p>{self.words(1, 4)}</p>"
        if kind == 6:
            return f"<h2>{self.words(1, 6)}</h2>"
        if kind == 7:
            return f"<ul>{''.join(f'<li>{self.words(2, 14)}</li>' for _ in range(rng.randint(2, 6)))}</ul>"
        if kind == 8:
            return self.one_of(f"<blockquote><p>{prose}</p></blockquote>", f"<pre>{self.words(4, 30)}</pre>", f"<figure><img src=x><figcaption>{self.words(3, 14)}</figcaption></figure>", f"<address>{self.words(2, 9)}</address>")
        if kind == 9:
            return f"<table><tr><th>{self.words(1, 3)}</th><th>{self.words(1, 3)}</th></tr><tr><td>{self.words(1, 8)}</td><td>{self.words(1, 8)}</td></tr></table>"
        if kind == 10:
            named = self.one_of("related-work", "rail-history", "footer-notes", "share-prices", "menu-planning", "comment-culture", "advert-history", "form-letters", "search-results-explained", "notice-periods", "header-files", "sidebar-design", "login-problems")
            tag = self.one_of("section", "div")
            return f"<{tag} class='{named}'><h3>{self.words(1, 5)}</h3><p>{prose}</p><p>{self.words(5, 40)}</p></{tag}>"
        if kind == 11:
            return f"<div class={self.one_of('text', 'entry-content', 'body', self.opaque(), self.opaque())}><p>{prose}</p><p>{self.words(10, 60)}</p></div>"
        return f"<div>{prose}</div>"

    def page(self) -> str:
        rng = self.rng
        parts = [self.part() for _ in range(rng.randint(2, 9))]
        style = rng.randrange(8)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            parts.insert(rng.randint(1, len(parts)), self.frame(inside=True))
        if style <= 2 and rng.random() < 0.2:
            parts.insert(rng.randint(1, len(parts)), f"<ul>{self.links(2, 5)}</ul>")
        if rng.random() < 0.1:
            parts = [f"<p>{self.words(1, 6)}</p>"]  # a very short article
        title = f"<h1>{self.words(1, 9)}</h1>"
        head = self.one_of(title, title, "", f"<header>{title}<p>{self.words(2, 8)}</p></header>")
        if style <= 1:
            story = f"<article{self.one_of('', ' class=post', f' class={self.opaque()}')} data-y=1>{head}{''.join(parts)}</article>"
        elif style == 2:
            story = f"<main data-y=1>{head}{''.join(parts)}</main>"
        elif style <= 5:
            named = self.one_of("content", "content", "post", "post", "story", "entry", "entry-content", "article-body", "post-body", "main-content", "story alert", "post more-news", "page with-sidebar", "has-comments", self.opaque(), self.opaque(), "")
            story = f"<div class='{named}' data-y=1>{title if head.startswith('<header') else head}{''.join(parts)}</div>"
        else:
            story = "".join(re.sub(r"<([a-z0-9]+)(?=[ >])", r"<\1 data-y=1", p, count=1) if "data-y" not in p[:60] else p for p in [title, *parts])
        around = [self.frame() for _ in range(rng.randint(1, 5))]
        cut = rng.randint(0, len(around))
        wrap = rng.random()
        before, after = "".join(around[:cut]), "".join(around[cut:])
        if wrap < 0.3:
            return f"<body><div class='{self.one_of('page', 'wrapper', self.opaque(), 'page with-sidebar', 'site no-ads')}'>{before}{story}{after}</div></body>"
        if wrap < 0.5:
            return f"<body>{before}<div id={self.opaque()}>{story}</div>{after}</body>"
        return f"<body>{before}{story}{after}</body>"


def composed_pages(n: int = COMPOSED_PAGES, seed: int = SEED) -> list[str]:
    composer = _Composer(seed)
    return [composer.page() for _ in range(n)]


def _labelled(page: str) -> tuple[Tree, np.ndarray] | None:
    tree = parse(page)
    labels = labels_of_parts(tree) if any(m >= 0 for m in tree.mark) else labels_of_marks(tree)
    return None if labels is None else (tree, labels)


class _Grove:
    """Many labelled trees as one forest, level by level, for fast messages."""

    def __init__(self, trees: Sequence[tuple[Tree, np.ndarray]]):
        sizes = [len(labels) for _, labels in trees]
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.x = np.concatenate([features(tree) for tree, _ in trees])
        self.y = np.concatenate([labels for _, labels in trees]).astype(int)
        self.w = np.concatenate([np.full(n, 1 / n / len(trees)) for n in sizes])
        self.kind = np.concatenate([edge_kinds(tree) for tree, _ in trees])
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + f) for (t, _), f in zip(trees, first)])
        depth = np.zeros(len(self.y), int)
        for i, up in enumerate(self.parent):
            depth[i] = depth[up] + 1 if up >= 0 else 0
        self.levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]

    def gradient(self, theta: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the trees' mean log-likelihood (by node), from exact marginals of nodes and edges."""
        total = self.x @ theta
        up = np.zeros(len(total))
        bb, bc, cb, cc = edge[self.kind].reshape(-1, 4).T
        for level in self.levels[:0:-1]:
            r = total[level]
            up[level] = np.logaddexp(cb[level], cc[level] + r) - np.logaddexp(bb[level], bc[level] + r)
            np.add.at(total, self.parent[level], up[level])
        belief = total.copy()
        d_edge = np.zeros((2, 4))
        for level in self.levels[1:]:
            above = self.parent[level]
            r = belief[above] - up[level]
            belief[level] = total[level] + np.logaddexp(bc[level], cc[level] + r) - np.logaddexp(bb[level], cb[level] + r)
            logs = np.stack([bb[level], bc[level] + total[level], cb[level] + r, cc[level] + r + total[level]])
            pair = np.exp(logs - np.logaddexp.reduce(logs, axis=0)) * self.w[level]
            np.add.at(d_edge, (self.kind[level], 2 * self.y[above] + self.y[level]), self.w[level])
            for kind in (0, 1):
                d_edge[kind] -= pair[:, self.kind[level] == kind].sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(belief, -500, 500)))
        return self.x.T @ (self.w * (self.y - p)), d_edge.reshape(2, 2, 2)


def fit_trees(pages: Sequence[str], rounds: int = ROUNDS) -> TreeModel:
    """Both potentials by conditional maximum likelihood, by gradient steps of adapted size."""
    grove = _Grove([t for t in map(_labelled, [*composed_pages(), *pages]) if t is not None])
    n = grove.x.shape[1]
    point, mean, square = np.zeros(n + 8), np.zeros(n + 8), np.zeros(n + 8)
    for k in range(1, rounds + 1):
        node, edge = grove.gradient(point[:n], point[n:].reshape(2, 2, 2))
        slope = np.concatenate([node, edge.ravel()]) - RIDGE * point
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        point = point + RATE * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9) / np.sqrt(k)
    return TreeModel(point[:n], point[n:].reshape(2, 2, 2))


def fit(pages: DataFrame, html: str = "html", key: str = "page_id", sample_pages: int = SAMPLE_PAGES) -> TreeModel:
    """Model from at most ``sample_pages`` pages of smallest hash that mark their article."""
    marked = pages.filter(F.col(f"`{html}`").rlike(r"(?i)<(article|main)\b"))
    keyed = marked.select(F.xxhash64(F.col(f"`{key}`").cast("string"), F.lit(SEED)).alias("h"), F.col(f"`{html}`").alias("html"))
    picked = keyed.select("h").orderBy("h").limit(sample_pages).agg(F.max("h")).first()[0]
    if picked is None:
        return fit_trees([])
    rows = keyed.filter(F.col("h") <= picked).orderBy("h", F.xxhash64("html")).limit(sample_pages).collect()
    return fit_trees([r["html"] for r in rows])


def extract(pages: DataFrame, model: TreeModel, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page."""
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("key", "url")]
    sent = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", BATCH_BYTES):
                texts = [main_text(sent.value, page.as_py()) for page in batch.column("html")]
                arrays = [batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "url", "text", "n_chars"])

    out = rows.mapInArrow(run, f"key {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")

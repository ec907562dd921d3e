"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks: stretches of text between block-level tags. A logistic
classifier, trained here on a small labelled table, gives every block the log-odds of
being content; that is its capacity to the source or to the sink. Neighbouring blocks
and blocks of one parent are joined by edges that get weaker with their distance in
the DOM. The minimum cut, found by max-flow, separates content from boilerplate: a
short line between paragraphs stays with them, an advert among them does not.

What an element's names say holds for all that is below it, unless it is a wrapper: one
with most of a page's text below it, and no other text that could be the page's content.
Reader comments are also told by their form, whatever they are called: pieces of one
kind that follow the text, each with a dated or numbered line and then sentences.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultledger.llm.shared import schema_with, without

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
#: Elements whose inside is not markup, and those whose text is never shown or is a control's.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
SILENT = RAW | {"head", "noscript", "template", "object", "svg", "math", "select", "button", "option", "datalist", "audio", "video", "canvas", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "keygen", "frame"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head", "title",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A paragraph that stands outside of these is not closed from within them.
HOLD_PARAGRAPHS = {"td", "th", "article", "section", "div", "li", "table", "blockquote", "form", "button"}
#: A start tag closes these if they are open, up to the element that holds them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}

#: Words of class, id and role that tell what an element holds, by the feature they raise.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip topbar toolbar tabs",
    "side": "sidebar aside widget related recommended recommendations popular trending teaser teasers more rail blogroll archive archives",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall toast disclaimer",
    "talk": "comment comments commentlist reply replies respond responses reactions feedback disqus discussion guestbook kommentar kommentare comentarios commentaires commenti",
    "edge": "header masthead footer foot copyright colophon legal",
    "share": "share sharing social follow tags tag byline meta author login search rating print",
    "body": "article content post entry story text main body prose",
}
#: A name of several words that starts so tells of a state or a subject, not what the element is.
STATES = {"has", "with", "no", "not", "without", "is", "category", "format", "type", "status"}
SUBJECTS = {"tag", "category"}
LISTS = {"list", "cloud", "links"}
HINT_OF = {word: name for name, words in HINTS.items() for word in words.split()}
TAG_OF = {"nav": "menu", "menu": "menu", "aside": "side", "footer": "edge", "header": "edge", "form": "form", "fieldset": "form", "label": "form", "article": "article", "main": "article", "dialog": "notice"}
ROLE_OF = {"navigation": "menu", "complementary": "side", "contentinfo": "edge", "banner": "edge", "search": "form", "dialog": "notice", "alert": "notice", "main": "article", "article": "article"}
SIGNS = ("menu", "side", "advert", "notice", "talk", "edge", "share", "body", "form", "article", "hidden")
#: Features: bias, the signs, an edge within an article, then of the block itself.
FEATURES = 1 + len(SIGNS) + 9

#: The labelled table: 1 for content, where the block stands, its words, per cent of them in links, and whether it ends a sentence.
LABELLED = """
1 article/p 60 0 1
1 article/p 8 0 1
1 article/p 2 0 1
1 article/p 1 0 0
1 article/h1 9 0 0
1 article/h2 4 0 0
1 article/h1 12 0 1
1 article/p 120 5 1
1 article/p 30 30 1
1 article/ul/li 12 0 1
1 article/ul/li 5 0 0
1 article/ul/li 6 100 0
1 article/blockquote 25 0 1
1 article/pre 40 0 0
1 article/table/td 2 0 0
1 article/div 50 0 1
1 article/div 3 0 0
1 article/figcaption 10 0 1
1 article/header/h1 8 0 0
1 main/p 45 0 1
1 main/div/p 20 4 1
1 main/h1 6 0 0
1 main/div.content/p 70 0 1
1 main/article.post/p 33 0 1
1 div.content/p 80 0 1
1 div.content/p 12 0 1
1 div.content/h2 5 0 0
1 div.article-body/p 60 2 1
1 div.post/h1 7 0 0
1 div.entry/ul/li 9 0 1
1 div.story/p 4 0 1
1 div/p 90 0 1
1 div/p 40 3 1
1 div/p 25 0 1
1 body/p 50 0 1
1 td/p 60 0 1
1 div 150 2 1
1 section/p 55 0 1
1 section/p 18 0 1
1 div/h1 8 0 0
0 nav/ul/li 1 100 0
0 nav/ul/li 3 100 0
0 nav 6 100 0
0 nav/p 8 0 1
0 header/p 6 0 0
0 header/h1 3 100 0
0 header/div 9 0 1
0 header.masthead/p 12 0 1
0 footer 8 0 0
0 footer 20 0 1
0 footer/p 40 10 1
0 footer/p 12 0 1
0 footer/ul/li 2 100 0
0 aside/p 30 0 1
0 aside/h3 3 0 0
0 aside/ul/li 7 100 0
0 aside/div 60 0 1
0 div.sidebar/p 35 0 1
0 div.sidebar/ul/li 5 100 0
0 div.sidebar/h3 2 0 0
0 div.ad 9 0 1
0 div.ad 40 0 1
0 div.ad/p 15 0 1
0 div.ad 2 0 0
0 article/div.ad 12 0 1
0 article/div.ad/p 50 0 1
0 article/div.advert/p 20 0 1
0 article/div.promo/p 14 100 1
0 main/div.sponsored 22 0 1
0 div.banner/p 11 0 1
0 div.cookie/p 18 0 1
0 div.notice/p 25 0 1
0 article/div.notice/p 16 0 1
0 main/div.newsletter/p 12 0 1
0 main/div.consent 40 0 1
0 div.popup/p 9 0 1
0 div.comments/p 25 0 1
0 div.comments/h3 2 0 0
0 div.comments/div.comment/p 60 0 1
0 article/div.comments/p 40 0 1
0 article/section.comments/article/p 50 0 1
0 main/section.comments/p 30 0 1
0 ul.commentlist/li 45 0 1
0 form/label 3 0 0
0 form/p 9 0 1
0 main/form/p 11 0 1
0 article/form/div 7 0 0
0 form.search 2 0 0
0 article/aside/p 20 0 1
0 article/nav/ul/li 4 100 0
0 article/footer/p 14 0 1
0 article/div.share/ul/li 2 100 0
0 article/ul.tags/li 1 100 0
0 article/div.related/ul/li 8 100 0
0 main/div.related/p 12 60 1
0 article/div.author/p 18 0 1
0 div.footer/p 16 0 1
0 div.copyright 9 0 0
0 div.menu/ul/li 2 100 0
0 div.header/div 5 0 0
0 ul/li 2 100 0
0 ul/li 1 100 0
0 div 2 100 0
0 div 3 0 0
0 div/span 1 0 0
0 td 2 100 0
0 div.breadcrumb 4 70 0
0 article/p.hidden 30 0 1
0 article/p.hidden 90 0 1
0 article/div.hidden/p 60 0 1
0 main/div.ad 60 0 1
0 div.hidden/p 60 0 1
"""


def signs_of(tag: str, attributes: str) -> frozenset[str]:
    """What an element's tag and its class, id, role and hiding attributes tell."""
    if tag in ("html", "body"):
        return frozenset()
    out = {TAG_OF[tag]} if tag in TAG_OF else set()
    if attributes:
        out |= _told(attributes)
    if tag in ("article", "main"):
        out -= {"menu", "side", "edge", "share", "body"}
    return frozenset(out)


def _named(name: str) -> set[str]:
    """What one class or id tells."""
    words = [word.lower() for word in re.findall("[A-Z]?[a-z]+|[A-Z]+", name)]
    if len(words) > 1 and words[0] in SUBJECTS and words[-1] not in LISTS:
        return set()
    out = {"hidden"} if "hidden" in words and words[0] not in ("no", "not") else set()
    if len(words) > 1 and words[0] in STATES:
        return out
    return out | {HINT_OF[word] for word in words if word in HINT_OF}


@lru_cache(maxsize=4096)
def _told(attributes: str) -> frozenset[str]:
    out = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape("".join(values))
        if name in ("class", "id"):
            for one in value.split():
                out |= _named(one)
        elif name == "role":
            out |= {ROLE_OF[r] for r in value.lower().split() if r in ROLE_OF}
        elif name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.add("hidden")
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", ATTRIBUTE.sub(" ", attributes)):
        out.add("hidden")
    return frozenset(out)


@dataclass(slots=True)
class Element:
    tag: str
    parent: int
    depth: int
    #: What it tells itself, and with all that it stands in.
    own: frozenset[str]
    signs: frozenset[str]
    attributes: str = ""


@dataclass(slots=True)
class Block:
    element: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def read_blocks(html: str) -> tuple[list[Element], list[Block]]:
    """Elements and blocks of a page, in page order; markup that is wrong is mended as browsers do, roughly."""
    elements = [Element("", -1, 0, frozenset(), frozenset())]
    blocks = [Block(0)]
    stack = [0]
    # depths in the stack of the open elements, by tag, and of the open blocks
    opened: dict[str, list[int]] = {}
    open_blocks: list[int] = [0]
    silent = links = 0
    at, size = 0, len(html)

    def close(depth: int) -> None:
        nonlocal silent, links
        while len(stack) > depth:
            tag = elements[stack.pop()].tag
            opened[tag].pop()
            silent -= tag in SILENT
            links -= tag == "a"
            if tag in BLOCKS:
                open_blocks.pop()
                broken()

    def innermost(tags: set[str]) -> int:
        return max((opened[tag][-1] for tag in tags if opened.get(tag)), default=0)

    def imply(tags: set[str], limit: int) -> None:
        """Close the elements of ``tags`` that are open above a depth."""
        while (depth := innermost(tags)) > limit:
            close(depth)

    def broken() -> None:
        if blocks[-1].parts:
            blocks.append(Block(stack[-1]))
        blocks[-1].element = stack[-1]

    def say(text: str) -> None:
        if text and not silent:
            text = unescape(text) if "&" in text else text
            if not blocks[-1].parts:
                if text.isspace():
                    return
                # signs of inline elements are not those of a block
                blocks[-1].element = stack[open_blocks[-1]]
            blocks[-1].parts.append(text)
            if links:
                blocks[-1].linked += len(text.split())

    while at < size:
        found = TOKEN.search(html, at)
        if not found:
            say(html[at:])
            break
        say(html[at : found.start()])
        at = found.end()
        slash, tag, attributes = found.groups()
        if tag is None:
            if found[0].startswith("<![CDATA["):
                say(found[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if slash:
            if tag == "br":
                say(" ")
                continue
            if opened.get(tag):
                close(opened[tag][-1])
            elif tag == "p":
                broken()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCKS and tag not in ("html", "body", "head"):
            imply({"p"}, innermost(HOLD_PARAGRAPHS))
        if tag in CLOSES:
            tags, limits = CLOSES[tag]
            imply(tags, innermost(limits))
        if tag in BLOCKS:
            broken()
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "math", "path", "g", "use"):
            continue
        if tag == "a" and links:
            imply({"a"}, open_blocks[-1])
        above = elements[stack[-1]]
        own = signs_of(tag, attributes)
        elements.append(Element(tag, stack[-1], above.depth + 1, own, above.signs | own if own else above.signs, attributes))
        opened.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            open_blocks.append(len(stack))
        stack.append(len(elements) - 1)
        silent += tag in SILENT
        links += tag == "a"
        if tag in BLOCKS:
            broken()
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else size
    out = []
    for block in blocks:
        block.text = " ".join("".join(block.parts).split())
        if block.text:
            out.append(block)
    return elements, out


SENTENCE = (".", "!", "?", "…", ".”", ".\"", "。", ":")
#: Signs of what is no content.
BOILERPLATE = frozenset(SIGNS) - {"body", "article"}
#: Words of a paragraph, and how many of them a wrapper without an article holds.
PARAGRAPH, PARAGRAPHS = 15, 3
#: Share of the paragraphs' words that may stand free outside a wrapper.
OUTSIDE = 0.2
#: Words of a line that names who has written a comment, and when.
BYLINE = 12


def _below(elements: list[Element], at: dict[int, int]) -> list[int]:
    """For each element the sum of ``at`` over it and all below it."""
    out = [at.get(i, 0) for i in range(len(elements))]
    for i in range(len(elements) - 1, 0, -1):
        out[elements[i].parent] += out[i]
    return out


def _inherit(elements: list[Element]) -> None:
    for one in elements[1:]:
        above = elements[one.parent].signs
        one.signs = above | one.own if one.own else above


def _paragraphs(blocks: list[Block]) -> list[tuple[Block, int]]:
    """The blocks of many words that are mostly no links, with their words."""
    counted = ((block, block.text.count(" ") + 1) for block in blocks)
    return [(block, words) for block, words in counted if words >= PARAGRAPH and 2 * block.linked < words]


def pass_wrappers(elements: list[Element], blocks: list[Block]) -> None:
    """Take their names from wrappers.

    A wrapper holds over half the words of the page's paragraphs, and those that
    stand free, in nothing that tells of boilerplate, are at most a fifth as many
    (none, if its name tells of comments). It holds an article or three
    paragraphs. Tags other than those of forms, and what hides an element, stand.
    """
    long = _paragraphs(blocks)
    total = sum(words for _, words in long)
    words_at: dict[int, int] = {}
    count_at: dict[int, int] = {}
    for block, words in long:
        words_at[block.element] = words_at.get(block.element, 0) + words
        count_at[block.element] = count_at.get(block.element, 0) + 1
    words_in, count_in = _below(elements, words_at), _below(elements, count_at)
    articles_in = _below(elements, {i: 1 for i, one in enumerate(elements) if one.tag in ("article", "main")})
    free = sum(words for block, words in long if not elements[block.element].signs & BOILERPLATE)
    changed = False
    for i, one in enumerate(elements):
        said = one.own & BOILERPLATE - {"hidden"}
        fixed = {TAG_OF[one.tag]} if TAG_OF.get(one.tag, "form") != "form" else set()
        if not said - fixed or 2 * words_in[i] <= total or not (articles_in[i] or count_in[i] >= PARAGRAPHS):
            continue
        if free <= (0 if "talk" in said else OUTSIDE * words_in[i]):
            one.own -= said - fixed
            changed = True
    if changed:
        _inherit(elements)


def _kind(element: Element) -> tuple[str, str]:
    """Tag and class, without its digits, of an element that may be one of several of a kind."""
    names = [a or b or c for name, a, b, c in ATTRIBUTE.findall(element.attributes) if name.lower() == "class"]
    return element.tag, re.sub(r"\d+", "", " ".join(names))


def mark_remarks(elements: list[Element], blocks: list[Block]) -> None:
    """Give the sign of comments to repeated pieces that are built like comments.

    Two or more children of one element, of one tag and class, each start with a
    short line that holds a digit, and no heading, and go on with a sentence; all of
    that kind do, and a free paragraph stands before them. If nothing else below
    their parent is a paragraph, the parent has the sign.
    """
    first_free = next((i for i, block in enumerate(blocks) if block.text.count(" ") + 1 >= PARAGRAPH and not elements[block.element].signs & BOILERPLATE), None)
    if first_free is None:
        return
    # the innermost element with a class, or list item, above each block
    holder = [0] * len(elements)
    for i, one in enumerate(elements[1:], 1):
        holder[i] = i if one.tag in BLOCKS and one.tag != "p" and one.tag not in HEADINGS and (one.tag in ("li", "article") or "class" in one.attributes) else holder[one.parent]
    pieces: dict[int, list[int]] = {}
    for i, block in enumerate(blocks):
        if holder[block.element]:
            pieces.setdefault(holder[block.element], []).append(i)
    groups: dict[tuple[int, tuple[str, str]], list[int]] = {}
    for piece in pieces:
        groups.setdefault((elements[piece].parent, _kind(elements[piece])), []).append(piece)
    paragraphs_in: list[int] | None = None
    changed = False
    for (parent, _), same in groups.items():
        if len(same) < 2 or pieces[same[0]][0] <= first_free or not all(_is_remark([(elements[blocks[i].element].tag, blocks[i].text) for i in pieces[one][:2]]) for one in same):
            continue
        if paragraphs_in is None:
            at: dict[int, int] = {}
            for block, _ in _paragraphs(blocks):
                at[block.element] = at.get(block.element, 0) + 1
            paragraphs_in = _below(elements, at)
        said = sum(paragraphs_in[one] for one in same)
        marked = same
        # the list of the comments, and what holds nothing but that and its heading
        while parent and paragraphs_in[parent] == said and elements[parent].tag not in ("html", "body"):
            marked, parent = [parent], elements[parent].parent
        for one in marked:
            elements[one].own |= {"talk"}
        changed = True
    if changed:
        _inherit(elements)


def _is_remark(start: list[tuple[str, str]]) -> bool:
    if len(start) < 2:
        return False
    (tag, line), (_, said) = start
    is_line = tag not in HEADINGS and line.count(" ") < BYLINE and not line.endswith(SENTENCE) and any(c.isdecimal() for c in line)
    return is_line and said.endswith(SENTENCE)


def features(signs: frozenset[str], tag: str, words: int, linked: float, ends: bool) -> np.ndarray:
    out = np.zeros(FEATURES)
    out[0] = 1
    for i, sign in enumerate(SIGNS):
        out[1 + i] = sign in signs
    own = 1 + len(SIGNS)
    out[own] = "edge" in signs and "article" in signs
    out[own + 1] = tag == "p"
    out[own + 2] = tag in HEADINGS
    out[own + 3] = tag == "li"
    out[own + 4] = np.log2(1 + min(words, 100)) / 4
    out[own + 5] = words >= 15
    out[own + 6] = linked
    out[own + 7] = ends
    out[own + 8] = "article" in signs and linked
    return out


@lru_cache(maxsize=2)
def train(table: str = LABELLED, rounds: int = 6000, ridge: float = 0.0003) -> np.ndarray:
    """Weights of a logistic regression on the labelled table, by gradient steps."""
    rows, labels = [], []
    for line in filter(str.strip, table.splitlines()):
        label, path, words, linked, ends = line.split()
        signs: frozenset[str] = frozenset()
        for step in path.split("/"):
            tag, _, name = step.partition(".")
            signs |= signs_of(tag, f' class="{name}"' if name else "")
        rows.append(features(signs, tag, int(words), int(linked) / 100, ends == "1"))
        labels.append(int(label))
    x, y = np.array(rows), np.array(labels)
    weights = np.zeros(FEATURES)
    for _ in range(rounds):
        gap = y - 1 / (1 + np.exp(-x @ weights))
        weights += x.T @ gap / len(y) - ridge * weights
    return weights


#: Capacities are whole numbers: so many to one unit of log-odds.
UNIT = 1000
#: Edges between neighbours and between a parent's blocks, in log-odds, and how they fade with each step in the DOM.
BESIDE, TOGETHER, FADE = 0.8, 0.5, 0.5
FAR = 8


def dom_distance(elements: list[Element], a: int, b: int) -> int:
    """Steps from one element to the other through the tree, up to ``FAR``."""
    steps = 0
    while a != b and steps < FAR:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        steps += 1
    return steps


def smooth_edges(elements: list[Element], blocks: list[Block]) -> list[tuple[int, int, int]]:
    """first, second, capacity: neighbours in the page, and each block with the next one below its element's parent."""
    out = []
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        parent = elements[block.element].parent
        if i:
            far = dom_distance(elements, blocks[i - 1].element, block.element)
            out.append((i - 1, i, round(UNIT * BESIDE * FADE ** max(far - 2, 0))))
        if parent in last:
            out.append((last[parent], i, round(UNIT * TOGETHER)))
        last[parent] = i
    return out


def source_side(gains: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The source's side of the minimum cut; of several minimum cuts the one with the smallest such side.

    ``gains`` above 0 are capacities from the source, below 0 to the sink. Dinic's
    algorithm: level graphs from the source's open ends, blocking flows without
    recursion.
    """
    n = len(gains)
    to: list[int] = []
    room: list[int] = []
    at: list[list[int]] = [[] for _ in range(n)]
    for a, b, capacity in edges:
        if capacity:
            at[a].append(len(to))
            at[b].append(len(to) + 1)
            to += [b, a]
            room += [capacity, capacity]
    supply = [max(g, 0) for g in gains]
    demand = [max(-g, 0) for g in gains]
    while True:
        level = [0 if s else -1 for s in supply]
        queue = deque(i for i in range(n) if supply[i])
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or demand[i] > 0
            for e in at[i]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [one >= 0 for one in level]
        turn = [0] * n
        for start in range(n):
            while supply[start]:
                path: list[int] = []
                i = start
                while True:
                    if demand[i]:
                        flow = min([supply[start], demand[i], *(room[e] for e in path)])
                        for e in path:
                            room[e] -= flow
                            room[e ^ 1] += flow
                        supply[start] -= flow
                        demand[i] -= flow
                        break
                    while turn[i] < len(at[i]) and not (room[at[i][turn[i]]] and level[to[at[i][turn[i]]]] == level[i] + 1):
                        turn[i] += 1
                    if turn[i] < len(at[i]):
                        path.append(at[i][turn[i]])
                        i = to[path[-1]]
                    elif path:
                        e = path.pop()
                        i = to[e ^ 1]
                        turn[i] += 1
                    else:
                        break
                if not path and not demand[start] and turn[start] >= len(at[start]):
                    break


def main_text(html: str, weights: np.ndarray) -> str:
    elements, blocks = read_blocks(html)
    if not blocks:
        return ""
    pass_wrappers(elements, blocks)
    mark_remarks(elements, blocks)
    gains = []
    known: dict[tuple, int] = {}
    for block in blocks:
        words = block.text.count(" ") + 1
        element = elements[block.element]
        told = (element.signs, element.tag, min(words, 100), min(block.linked / words, 1), block.text.endswith(SENTENCE))
        if told not in known:
            known[told] = round(UNIT * float(features(*told) @ weights))
        gains.append(known[told])
    keep = source_side(gains, smooth_edges(elements, blocks))
    return " ".join(block.text for block, kept in zip(blocks, keep, strict=True) if kept)


def extract(pages: DataFrame, html: str = "html", out: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """Add the main text of every whole page; a column called ``out`` is replaced.

    Character references are decoded, white space within a block becomes one space,
    blocks are joined by one space in page order. A null or empty page, and one
    without content, gives an empty text. Repeated rows stay repeated.
    """
    pages = without(pages, out)
    spread = pages.sparkSession.sparkContext.broadcast(train() if weights is None else weights)
    schema = schema_with(pages, (out, T.StringType()))
    at = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value, spread.value) if value else "" for value in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return pages.mapInArrow(run, schema)

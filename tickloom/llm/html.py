"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block element. Menus, forms, notices and the like count as empty lines,
by their element, role or class, and so do lines that are mostly links. Text lengths are summed over a sliding
window of lines: where the sum rises from nothing is a surge point, where it falls back to nothing a dive point, and
the stretches between a surge and its dive are the main text. Only short stretches of bare text, without a paragraph, a
heading or the like, are fragments of the frame beside a longer one. Where a page names its article, lines outside of it
count as empty, and so every stretch is the article's; sibling articles that are neither teasers nor comments belong
together. Lists that are mostly links are navigation, and so are linked lines outside of an article but for paragraphs and
headings between two lines of text.

Class and id names mark a box that is not main text. Outside of an article one word of a name is enough. Inside, all words
of a name have to say so, paragraphs and headings never go by their name, and words that may also be the title of a
section count only in the class of a plain box or with a word such as ``list`` or ``box``.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.text import map_text

WINDOW = 3  # lines summed
LINKS = 0.6  # share of link text from which a line, and a list in an article, is navigation
ENOUGH = 100  # characters from which a stretch of bare text is main text beside a longer one

SKIPPED = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(script|style|noscript|template|iframe|svg|textarea|title|annotation(?:-xml)?)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I
)
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>")
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike "
    "strong sub sup time tt u var wbr input canvas object math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle mpadded "
    "mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("head nav aside footer form menu dialog select button fieldset datalist".split())
HOLDERS = frozenset("article main".split())
LISTS = frozenset("ul ol dl".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tablist".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# words of class and id names that mark what is not the article
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion sidebar side menu nav "
    "navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notification alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies "
    "responses discussion talkback disqus respond widget toolbar pagination pager skip toc copyright disclaimer".split()
)
# what stands beside such words in the name of a box, often written together with them
BOXES = frozenset(
    "list lists box boxes area section form wrapper wrap container thread bar block panel link links button buttons item items post posts "
    "article articles content inner outer top bottom left right icons main site page the and us".split()
)
JOINED = re.compile(r"(.+?)(lists?|box|area|section|form|wrapper|wrap|container|thread|bar|block|panel|links?|buttons?)$")
# of these, words that may also name a section of an article
UNSURE = frozenset(
    "side header banner alert notice notification popup modal overlay login share sharing social related recommended recommendations discussion "
    "reply replies responses respond skip copyright disclaimer subscription consent cookie cookies promotion menu advertising".split()
)
# such words of article elements alone
TEASERS = frozenset("teaser teasers card preview excerpt snippet".split())
# names that mark the article in other elements than its own
ARTICLE = re.compile(r"(^|[\s_-])(article|post|entry|story|main|page)[_-]?(body|content|text)\b|\barticlebody\b", re.I)


def _names_box(name: str, tag: str, kind: str, inside: bool) -> bool:
    """Whether a class or id name marks what is not main text."""
    words = [w.lower() for w in WORDS.findall(name)]
    # has-sidebar and the like name a wrapper
    if not words or words[0] in ("has", "with", "no"):
        return False
    if tag == "article" and TEASERS.intersection(words):
        return True
    split = []
    for word in words:
        joined = None if word in NAMES else JOINED.fullmatch(word)
        split += joined.groups() if joined and joined[1] in NAMES else [word]
    known = NAMES.intersection(split)
    if not inside or not known:
        return bool(known)
    if tag in PROSE or not (NAMES | BOXES).issuperset(split):
        return False
    return bool(known - UNSURE) or len(split) > 1 or (kind == "class" and tag != "section")


def _left_out(tag: str, attributes: str, inside: bool, by_name: bool) -> bool:
    if tag in LEFT_OUT or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if by_name and name in ("class", "id") and tag not in ("body", "html") and not ARTICLE.search(value):
            if any(_names_box(part, tag, name, inside) for part in value.split()):
                return True
    return False


class Lines:
    """Lines of a page, whether they are mostly links, the article and the list in it they stand in (0: none), and whether
    a paragraph, a heading or the like holds them."""

    def __init__(self):
        self.text: list[str] = []
        self.linked: list[bool] = []
        self.holder: list[int] = []
        self.list: list[int] = []
        self.prose: list[bool] = []
        self._parts: list[str] = []
        self._linked = 0
        self._size = 0

    def add(self, text: str, linked: bool) -> None:
        self._parts.append(text)
        n = len("".join(text.split()))
        self._size += n
        self._linked += n * linked

    def close(self, tag: str, holder: int, listed: int) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            navigation = self._linked > LINKS * max(1, self._size)
            if text:
                self._append(text, navigation, holder, listed, tag in PROSE)
            self._parts, self._linked, self._size = [], 0, 0

    def empty(self, holder: int) -> None:
        """Left-out content keeps its place outside of an article and leaves no gap within one."""
        if not holder:
            self._append("", False, 0, 0, False)

    def _append(self, text: str, linked: bool, holder: int, listed: int, prose: bool) -> None:
        self.text.append(text)
        self.linked.append(linked)
        self.holder.append(holder)
        self.list.append(listed)
        self.prose.append(prose)


def lines_of(page: str, by_name: bool = True) -> Lines:
    """Cut a page into lines; what is left out appears as empty lines. ``by_name``: class and id names count too."""
    page = SKIPPED.sub("", page)
    lines = Lines()
    stack: list[tuple[str, bool, int, int]] = [("", False, 0, 0)]  # open block elements: tag, left out, article, list in it
    links, count, lists, at = 0, 0, 0, 0
    articles = {0: False}  # whether a holder is an article element
    for m in [*TAG.finditer(page), None]:
        _, out, holder, listed = stack[-1]
        if not out and (raw := page[at : m.start() if m else len(page)]):
            lines.add(html.unescape(raw), links > 0)
        if m is None:
            break
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m.group(1)), m.group(3)
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            elif not closing and tag not in VOID and attributes and not out and _left_out(tag, attributes, holder > 0, by_name):
                # a left-out inline element lasts until it closes
                stack.append((tag, True, holder, listed))
                continue
            if closing and stack[-1][0] == tag:
                stack.pop()
            continue
        if tag in VOID:
            if tag == "br":
                if not out:
                    lines.add(" ", False)
            else:
                lines.close(stack[-1][0], holder, listed)
            continue
        lines.close(stack[-1][0], holder, listed)
        links = 0
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "option"):
            # closed by the next of their kind, often without saying so
            if stack[-1][0] == tag:
                stack.pop()
            _, out, holder, listed = stack[-1]
        gone = out or _left_out(tag, attributes, holder > 0, by_name)
        names = tag in HOLDERS or ARTICLE.search(attributes) or 'role="main"' in attributes
        if not gone and (tag == "article" and not articles[holder] or names and not holder):
            count += 1
            holder, listed = count, 0
            articles[holder] = tag == "article"
        if gone and not out:
            lines.empty(holder)
        if tag in LISTS and holder and not listed:
            lists += 1
            listed = lists
        stack.append((tag, gone, holder, listed))
    lines.close(stack[-1][0], *stack[-1][2:])
    return lines


def main_text(page: str) -> str:
    """The main text of a page; empty where it has none. Names are ignored where they would leave nothing."""
    return _main_text(lines_of(page)) or _main_text(lines_of(page, by_name=False))


def _counting(lines: Lines) -> tuple[list[str], bool]:
    """Lines as they count, empty where they are not main text, and whether they are those of a named article."""
    size, links = {}, {}
    for t, linked, n in zip(lines.text, lines.linked, lines.list, strict=True):
        size[n] = size.get(n, 0) + len(t)
        links[n] = links.get(n, 0) + linked * len(t)
    rows = list(zip(lines.text, lines.linked, lines.holder, lines.list, strict=True))
    held = [t if holder and not (linked and n and links[n] > LINKS * size[n]) else "" for t, linked, holder, n in rows]
    if any(held):
        return held, True
    plain = [False, *(bool(t) and not linked for t, linked, _, _ in rows), False]
    amid = [a and b for a, b in zip(plain, plain[2:], strict=False)]
    return [t if not holder and (not linked or p and a) else "" for (t, linked, holder, _), p, a in zip(rows, lines.prose, amid, strict=True)], False


def _main_text(lines: Lines) -> str:
    text, named = _counting(lines)
    sizes = [len(t) for t in text]
    sums, total = [], 0
    for i, n in enumerate(sizes):  # sums of the window that ends at each line
        total += n - (sizes[i - WINDOW] if i >= WINDOW else 0)
        sums.append(total)
    stretches, start = [], None
    for i, n in enumerate([*sums, 0]):
        if n > 0 and start is None:
            start = i  # surge
        if n == 0 and start is not None:  # dive
            stretches.append((sum(sizes[start:i]), start, i))
            start = None
    enough = min(ENOUGH, max((n for n, _, _ in stretches), default=0))
    kept = [(a, b) for n, a, b in stretches if named or n >= enough or any(t and p for t, p in zip(text[a:b], lines.prose[a:b], strict=True))]
    return " ".join(t for a, b in kept for t in text[a:b] if t)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages(page_id, url, html)``.

    A null or empty page, and one without main text, gives an empty text; repeated rows come back as often as given.
    """

    def start():
        def work(texts: list[str]) -> list[list]:
            found = [main_text(t) for t in texts]
            return [found, list(map(len, found))]

        return work

    return map_text(pages, [F.col("page_id"), F.col("url")], F.col("html"), {"text": "string", "n_chars": "long"}, start)

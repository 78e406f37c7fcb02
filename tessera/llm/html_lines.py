"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text. A line weighs as many
characters as it has outside links; lines of menus, headers, footers, notices,
adverts, forms and comments weigh nothing, unless what marks them also holds the
page's article or most of its text; a name that is only partly a mark lowers
the weight. An article is kept whole, its link lines too, where it holds at
least as much as surges outside it. Else the weights are summed over sliding windows of lines;
a region surges where the sum first exceeds the threshold and dives where it
falls to zero. The text between is kept. A page whose windows all stay below
the threshold keeps its heaviest region.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_text, map_text

#: Elements whose tags end a line. Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements that never hold main text. Fixed values.
DROPPED = frozenset("nav footer aside form button select datalist dialog menu label fieldset canvas object embed head".split())
#: Elements whose content isn't markup or text. Fixed values.
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|audio|video|xmp"
#: Words in a class, id or role that mark what isn't main text. Fixed values.
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar comment comments reply replies disqus respond share sharing social related "
    "recommended newsletter subscribe subscription login signin signup search toolbar widget widgets pagination pager copyright disclaimer complementary contentinfo".split())
#: These mark page headers, but not those inside an article. Fixed values.
HEADS = frozenset("header head top".split())
#: These say nothing about what a name means. Fixed values.
NEUTRAL = frozenset("site page box area wrapper container left right block inner outer section panel bar list item items link links".split())
#: Kinds of containers: never main text, marked by a whole name (or a form), marked by a part of a name.
FIXED, STRONG, WEAK = 0, 1, 2
LOWERED = 4  # a line in a container marked by a part of a name weighs a quarter

# Possessive repeats keep the scan linear on broken markup.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+)|<[!?][^>]*+(?:>|\Z)|(?P<text>[^<]+|<)", re.DOTALL)
#: What ends a tag or opens a quoted value.
STOP = re.compile(r"[<>]|=\s*+[\"']")
RAW_END = {t: re.compile(rf"</{t}\s*+>", re.IGNORECASE) for t in RAW.split("|")}
ATTR = re.compile(r"([^\s=\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']++)))?")
WORD = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def marked(attrs: str, inside: bool) -> int:
    """What class, id and role say: 2 if one of their names consists of marked words, 1 if one holds such a word, 0 if none does."""
    found = 0
    for m in ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id", "role"):
            for name in (m[2] or m[3] or m[4] or "").lower().split():
                words = [w for w in WORD.findall(name) if w not in NEUTRAL and not w.isdigit()]
                hits = sum(w in MARKED or (not inside and w in HEADS) for w in words)
                if hits:
                    found = max(found, 2 if hits == len(words) else 1)
    return found


def tag_end(page: str, at: int, dead: set[int], lone: dict[str, int]) -> int:
    """Place of the > that ends a tag whose name ends at ``at``, -1 if a < or the page's end comes first.

    Quoted values of any length are passed over; a quote that is never closed
    is an ordinary character. ``dead`` (quotes that lead to no end) and ``lone``
    (the first unclosed quote of each kind) are kept over a page, so that no
    stretch is read again and again.
    """
    passed = []
    while True:
        m = STOP.search(page, at)
        if m is None or m[0] == "<":
            break
        if m[0] == ">":
            return m.start()
        opens, quote = m.end() - 1, m[0][-1]
        if opens in dead:
            break
        passed.append(opens)
        closes = -1 if opens >= lone.get(quote, len(page)) else page.find(quote, opens + 1)
        if closes < 0:
            lone[quote] = min(opens, lone.get(quote, opens))
        at = (opens if closes < 0 else closes) + 1
    dead.update(passed)
    return -1


def tokens_of(page: str):
    """(text, tag, closes, attributes) of a page in order: text or a tag; comments and the content of raw elements are left out."""
    at, dead, lone = 0, set(), {}
    while m := TOKEN.match(page, at):
        at = m.end()
        if m["text"] is not None:
            yield m["text"], "", False, ""
        elif m["tag"] is not None:
            end = tag_end(page, at, dead, lone)
            if end < 0:
                yield "<", "", False, ""
                at = m.start() + 1
                continue
            tag, attrs, at = m["tag"].lower(), page[at:end], end + 1
            if tag in RAW_END and not m["close"]:
                close = RAW_END[tag].search(page, at)
                at = close.end() if close else len(page)
            yield None, tag, bool(m["close"]), attrs


class Containers:
    """Dropped elements of a page, in opening order, and what they hold."""

    def __init__(self) -> None:
        self.kind: list[int] = []
        self.parent: list[int] = []
        self.mass: list[int] = []  # characters outside links
        self.within: list[int] = []  # of these, in an article or main element
        self.holds: list[int] = []  # of these, in one that stands in the container
        self.peak: list[int] = []  # the largest windowed sum of its own lines

    def add(self, kind: int, parent: int) -> int:
        self.kind.append(kind)
        self.parent.append(parent)
        for held in (self.mass, self.within, self.holds, self.peak):
            held.append(0)
        return len(self.kind) - 1

    def dropped(self, total: int, articles: int, threshold: int) -> list[bool]:
        """Which containers go, given the page's mass and that of its articles.

        One stays that holds the larger part of the articles' text, or most of
        the page's where no article stands against it (or a short one, if the
        lowered weights surge), or, if only a part of a name marks it, whose
        lowered weights surge.
        """
        n = len(self.kind)
        for c in reversed(range(n)):
            if (up := self.parent[c]) >= 0:
                self.mass[up] += self.mass[c] * (self.kind[c] != FIXED)
                self.within[up] += self.within[c] * (self.kind[c] != FIXED)
                self.holds[up] += self.holds[c] * (self.kind[c] != FIXED)
        out = []
        for c in range(n):
            stays = self.kind[c] != FIXED and (
                (2 * self.holds[c] > articles and 4 * self.holds[c] > total)
                or (2 * self.mass[c] > total and ((rival := articles - self.within[c]) == 0 or (rival < threshold and self.mass[c] >= LOWERED * threshold)))
                or (self.kind[c] == WEAK and self.peak[c] >= LOWERED * threshold))
            out.append(not stays or (self.parent[c] >= 0 and out[self.parent[c]]))
        return out


def lines_of(page: str, window: int = 3, threshold: int = 86) -> list[tuple[str, int, bool, bool]]:
    """The page's lines in order: (text, characters outside links, in an article or main element, dropped)."""
    out: list[tuple[str, int, bool, int, int, bool]] = []
    text: list[str] = []
    links: list[str] = []
    held = Containers()
    stack: list[tuple] = []  # open containers and articles: tag, how many of it were open before, and the state to return to
    levels: dict[str, list[int]] = {}  # the same numbers by tag
    opens: dict[str, int] = {}  # how many of each tag are open
    inside, cur, holder, clean = 0, -1, -1, False  # open articles, innermost container, that around the innermost unmarked article, whether in one
    link = False

    def end_line() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                linked = len(" ".join(html.unescape("".join(links)).split()))
                out.append((line, max(0, len(line) - linked), inside > 0, cur, holder, clean))
            text.clear()
            links.clear()

    def enter(tag: str) -> None:
        level = opens.get(tag, 0)
        stack.append((tag, level, inside, cur, holder, clean))
        levels.setdefault(tag, []).append(level)

    def leave() -> None:
        nonlocal inside, cur, holder, clean
        end_line()
        tag, opens[tag], inside, cur, holder, clean = stack.pop()
        levels[tag].pop()

    for plain, tag, closes, attrs in tokens_of(page):
        if plain is not None:
            text.append(plain)
            if link:
                links.append(plain)
            continue
        if tag in RAW_END:
            if tag == "title":
                end_line()
            continue
        if tag in BLOCKS or tag in DROPPED:
            end_line()
            if stack and stack[-1][0] == "p" and tag != "br" and not (tag == "p" and closes):
                leave()  # a paragraph holds no block
        if tag in ("body", "html"):
            while stack:
                leave()  # end tags are missing
            link = False
            continue
        if closes:
            if tag == "a":
                link = False
            if opens.get(tag):
                opens[tag] -= 1
                if levels.get(tag) and levels[tag][-1] >= opens[tag]:
                    while stack[-1][0] != tag:
                        leave()  # end tags are missing
                    leave()
            continue
        if tag in VOID:
            continue
        kind = -1
        if tag == "a":
            link = True
        elif tag in ("form", "fieldset"):
            kind = STRONG
        elif tag in DROPPED or (tag == "header" and not inside):
            kind = FIXED
        elif attrs and tag not in ("h1", "b", "i", "em", "strong"):
            kind = (-1, WEAK, STRONG)[marked(attrs, inside > 0 or tag in ("p", "span"))]
        if kind >= 0 or tag in ("article", "main"):
            end_line()
            enter(tag)
            if kind >= 0:
                cur = held.add(kind, cur)
            if tag in ("article", "main"):
                inside += 1
                if kind < 0:
                    holder, clean = cur, True
        opens[tag] = opens.get(tag, 0) + 1
        if tag in BLOCKS:
            link = False  # an unclosed link ends with its block
    end_line()

    total = articles = 0
    fixed: list[bool] = []
    for c, kind in enumerate(held.kind):
        fixed.append(kind == FIXED or (held.parent[c] >= 0 and fixed[held.parent[c]]))
    recent: dict[int, list[int]] = {}
    for _, weight, _, at, around, whole in out:
        if at >= 0 and fixed[at]:
            continue
        total += weight
        articles += weight * whole
        if at >= 0:
            held.mass[at] += weight
            held.within[at] += weight * whole
            last = recent.setdefault(at, [])
            last.append(weight)
            held.peak[at] = max(held.peak[at], sum(last[-window:]))
        if whole and around >= 0:
            held.holds[around] += weight
    gone = held.dropped(total, articles, threshold)
    return [(line, weight, within, at >= 0 and gone[at]) for line, weight, within, at, _, _ in out]


def surges(weights: list[int], window: int, least: int) -> list[tuple[int, int]]:
    """(start, end) of the runs from a surge to its dive whose windowed sum reaches ``least``."""
    n = len(weights)
    sums = [sum(weights[i:i + window]) for i in range(n)]
    found, i = [], 0
    while i < n:
        j, top = i, 0
        while j < n and sums[j]:  # from the first mass in the window to the dive
            top = max(top, sums[j])
            j += 1
        if top >= max(1, least):
            found.append((i, j))
        i = max(j, i + 1)
    return found


def main_lines(lines: list[tuple[str, int, bool, bool]], window: int = 3, threshold: int = 86) -> list[str]:
    """The article's lines, or where the text outside surges to more than it holds, those between the surge and dive points."""
    weights = [0 if dropped else w for _, w, _, dropped in lines]
    article = sum(w for w, line in zip(weights, lines) if line[2])
    outside = [0 if line[2] else w for w, line in zip(weights, lines)]
    if article and article >= sum(sum(outside[i:j]) for i, j in surges(outside, window, threshold)):
        return [line for line, _, inside, dropped in lines if inside and not dropped]
    peak = max((sum(weights[i:i + window]) for i in range(len(weights))), default=0)
    return [lines[k][0] for i, j in surges(weights, window, min(threshold, peak)) for k in range(i, j) if weights[k]]


def page_text(page: str, window: int = 3, threshold: int = 86) -> str:
    return " ".join(main_lines(lines_of(page, window, threshold), window, threshold)) if page else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  window: int = 3, threshold: int = 86) -> DataFrame:
    """Main text of each page: ``id_col``, ``url_col``, text, n_chars (code points).

    Null and empty pages and pages without main text have an empty text; white
    space inside a block is one space and blocks are joined by one. Pages
    without markup keep what surges. Repeated rows give repeated rows; an empty
    table gives none; other columns are ignored; pages are read whole.
    """
    df = pages.select(pages[id_col], pages[url_col], F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("__html"))

    def each():
        def extract(page: str) -> tuple[str, int]:
            text = page_text(page, window, threshold)
            return text, len(text)

        return extract

    return map_text(df, "__html", "text string, n_chars long", each)

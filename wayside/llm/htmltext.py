"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element's run of text.  Lines of page
furniture (menus, forms, asides, adverts, comments and the like, told by element, role, class
or id) and lines that are mostly links count as empty.  Marks hold however long their text is
wherever unmarked text surges; only on a page without, a mark on most of the text yields.
Long text amid the main text stays, at a lower weight, under words that may name anything.

Text lengths are summed over sliding windows of ``WINDOW`` lines; a region surges where that
sum reaches the threshold and dives where it falls to nothing, and the lines of its regions,
less the furniture in between, are the text, as are short lines between regions.  Where the
lines of a page's articles hold at least half of its length, they alone are looked at; surge
and dive decide among them alike, but for an article's first line, which is its title.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import arrow_map, batch

WINDOW = 3
SURGE = 86

# HTML element names by role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = "script style noscript template textarea select svg iframe object canvas math audio video title".split()
FURNITURE = frozenset("aside button datalist dialog footer form head header menu nav search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class and id names that mark page furniture.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related respond search share sharing sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
_OPENED = "article", "main"
HIDDEN = ":hidden"
# Words that say of a class what the page has beside the element, not what the element is.
LAYOUT = frozenset("has no non not with without".split())
NAMES = frozenset(f"<{name}" for name in FURNITURE if name != "form")
HEADERS = frozenset(("header", "<header"))
TITLES = frozenset(f"h{k}" for k in range(1, 7))
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
# Marks that also name wrappers of main text.
LOOSE = frozenset("widget widgets search share sharing social".split())
LOWERED = 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-z][^\s/>]*)(?P<attributes2>[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?(?=[\s/]|$)", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(4096)
def _marked(attributes: str) -> frozenset[str]:
    """Why an element is furniture: ``hidden``, a role (with a colon before it) or words of its classes and id."""
    out: set[str] = set()
    if not attributes.strip(" /"):
        return frozenset()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            out.add(HIDDEN)
        elif name == "role" and value.lower() in ROLES:
            out.add(":" + value.lower())
        elif name in ("class", "id"):
            for token in value.split():
                found = [w.lower() for w in _WORD.findall(token)]
                if not LAYOUT.intersection(found):
                    out |= MARKS.intersection(found)
    return frozenset(out)


class _Lines:
    """The lines of one page: text, letters that stand in links, innermost furniture element, whether in the article, whether a title.

    Furniture elements are a forest: each has its reasons and its parent (-1: none).  A line
    names its innermost one, so deep or unclosed elements cost no more than flat ones.
    """

    def __init__(self) -> None:
        self.text: list[str] = []
        self.linked: list[int] = []
        self.zone: list[int] = []
        self.inside: list[bool] = []
        self.title: list[bool] = []
        self.reasons: list[frozenset[str]] = []
        self.parent: list[int] = []
        self._parts: list[str] = []
        self._in_links = 0

    def add(self, text: str, link: bool) -> None:
        self._parts.append(text)
        if link:
            self._in_links += len("".join(text.split()))

    def end(self, zone: int, inside: bool, title: bool) -> None:
        text = " ".join("".join(self._parts).split()) if self._parts else ""
        if text:
            self.text.append(text)
            self.linked.append(self._in_links)
            self.zone.append(zone)
            self.inside.append(inside)
            self.title.append(title)
        self._parts, self._in_links = [], 0


class _Zones:
    """The furniture elements that are open, outermost first: name, how many of it are open, number.  All steps take constant time but for what they close."""

    def __init__(self, lines: _Lines) -> None:
        self.lines, self.open = lines, []
        self.places: dict[str, list[int]] = {}
        self.strict = 0  # open ones that are more than headers

    def push(self, name: str, reasons: frozenset[str]) -> None:
        self.lines.parent.append(self.innermost())
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append([name, 1, len(self.lines.reasons)])
        self.lines.reasons.append(reasons)
        self.strict += not reasons <= HEADERS

    def pop(self) -> None:
        name, _, number = self.open.pop()
        self.places[name].pop()
        self.strict -= not self.lines.reasons[number] <= HEADERS

    def innermost(self) -> int:
        return self.open[-1][2] if self.open else -1

    def holds(self, name: str) -> bool:
        return bool(self.places.get(name))

    def again(self, name: str) -> None:
        self.open[self.places[name][-1]][1] += 1

    def close(self, name: str) -> None:
        k = self.places[name][-1]
        self.open[k][1] -= 1
        if not self.open[k][1]:
            while len(self.open) > k:
                self.pop()

    def keep_hidden(self) -> None:
        hidden = [(z[0], self.lines.reasons[z[2]]) for z in self.open if HIDDEN in self.lines.reasons[z[2]]]
        while self.open:
            self.pop()
        for name, reasons in hidden:
            self.push(name, reasons)


def lines_of(page: str) -> _Lines:
    """A page's lines; unclosed and unopened elements are read as they stand."""
    out = _Lines()
    zones = _Zones(out)
    articles: list[str] = []
    opened: Counter[str] = Counter()  # of articles, by name
    links = heading = title = 0

    def end() -> None:
        out.end(-1 if heading else zones.innermost(), bool(articles), bool(title))

    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            out.add(html.unescape(m["text"]), links > 0)
            continue
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing = bool(m["close"] or m["close2"])
        attributes = m["attributes"] or m["attributes2"] or ""
        if name == "br":
            out.add(" ", False)
            continue
        if name == "a":
            links = 0 if closing else 1
            continue
        block = name in BLOCKS or name in FURNITURE
        is_title = name in TITLES
        reasons = _marked(attributes) if not closing and name not in VOID and name not in ("body", "html") else frozenset()
        if is_title:
            reasons -= {"header"}
        if block or reasons or zones.holds(name):
            end()
        if block:
            links = title = 0
        if is_title:
            title = 0 if closing else 1
        if articles and zones.open and is_title and not zones.strict:
            heading = 0 if closing else 1
        if closing:
            if zones.holds(name):
                zones.close(name)
            if opened[name]:
                while True:
                    opened[last := articles.pop()] -= 1
                    if last == name:
                        break
            continue
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in _OPENED and not reasons:
            if not articles and not any(zones.holds(n) for n in _OPENED):
                zones.keep_hidden()
            articles.append(name)
            opened[name] += 1
        if block and zones.open and zones.open[-1][0] == "p":  # a paragraph ends where another block begins
            zones.pop()
        if name in FURNITURE:
            reasons |= {f"<{name}"}
        if reasons:
            zones.push(name, reasons)
        elif zones.holds(name):
            zones.again(name)
    end()
    return out


def _yielding(lines: _Lines, zone: np.ndarray, unlinked: np.ndarray, length: np.ndarray) -> dict[int, set[str]]:
    """Reasons that do not hold, by furniture element.

    All hold where unmarked text surges.  Elsewhere a mark does not hold on an element with most
    of the page's unlinked text, or on any where the elements of that mark have most of it
    together, but for comments beside unmarked text in an article, and elements told by name,
    except forms, beside any unmarked text.
    """
    plain = np.where((zone < 0) & (unlinked * 2 >= length), length, 0)
    if (np.convolve(plain, np.ones(WINDOW, np.int64)) >= SURGE).any():
        return {}
    n = len(lines.reasons)
    hidden = [False] * n
    for z in range(n):
        hidden[z] = HIDDEN in lines.reasons[z] or lines.parent[z] >= 0 and hidden[lines.parent[z]]
    held = np.bincount(zone[zone >= 0], unlinked[zone >= 0], n).astype(np.int64).tolist()
    total = int(unlinked.sum()) - sum(h for h, x in zip(held, hidden, strict=True) if x)
    own = list(held)
    for z in range(n - 1, -1, -1):
        if lines.parent[z] >= 0:
            held[lines.parent[z]] += held[z]
    told = bool(plain[np.array(lines.inside) & ~np.array(lines.title)].any())
    fixed = {HIDDEN} | (COMMENTS if told else frozenset()) | (NAMES if plain.any() else frozenset())
    out: dict[int, set[str]] = {}
    for mark in set().union(*set(lines.reasons)) - fixed:
        marked = [z for z in range(n) if mark in lines.reasons[z]]
        most = [z for z in marked if 2 * held[z] > total]
        if not most:
            under = [False] * n
            for z in range(n):
                under[z] = mark in lines.reasons[z] or lines.parent[z] >= 0 and under[lines.parent[z]]
            most = marked if 2 * sum(h for h, x in zip(own, under, strict=True) if x) > total else []
        for z in most:
            out.setdefault(z, set()).add(mark)
    return out


def _furniture(lines: _Lines, unlinked: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are furniture, and which of them by nothing but loose words of classes and ids."""
    zone = np.array(lines.zone)
    yielding = _yielding(lines, zone, unlinked, length)
    furniture, loose = np.zeros(len(lines.reasons) + 1, bool), np.ones(len(lines.reasons) + 1, bool)
    for z, reasons in enumerate(lines.reasons):  # a line outside of all has number -1, the last place
        left = reasons - yielding[z] if z in yielding else reasons
        furniture[z] = bool(left) or furniture[lines.parent[z]]
        loose[z] = left <= LOOSE and loose[lines.parent[z]]
    return furniture[zone], furniture[zone] & loose[zone]


def main_text(page: str | None) -> str:
    """The page's main text, its blocks joined by line feeds; empty if there is none."""
    lines = lines_of(page or "")
    if not lines.text:
        return ""
    inside = np.array(lines.inside)
    length = np.array([len(t) for t in lines.text])
    letters = np.array([len("".join(t.split())) for t in lines.text])
    linked = np.array(lines.linked) * 2 > letters
    furniture, lowered = _furniture(lines, letters - np.array(lines.linked), length)
    weight = np.where(furniture | linked, 0, length)
    # A teaser's article holds less than the rest of its page, and then all lines are looked at alike.
    article = 2 * int(weight[inside].sum()) >= int(weight.sum())
    at = np.flatnonzero(inside) if article else np.arange(len(weight))
    own = weight[at]
    if not own.any():
        return ""
    sums = np.convolve(own, np.ones(WINDOW, np.int64))[WINDOW - 1 :]
    threshold = min(SURGE, int(sums.max()))
    kept, i, n = np.zeros(len(weight), bool), 0, len(own)
    while i < n:
        j = i
        while j < n and sums[j]:
            j += 1
        surges = i + np.flatnonzero(sums[i:j] >= threshold)
        if len(surges):
            begin = int(surges[0]) + int(np.flatnonzero(own[surges[0] : j])[0])
            kept[at[begin:j]] = True
        i = j + 1
    if article:  # An article's short first lines (title, author) belong to its text; elsewhere they may be anything.
        kept[at[np.flatnonzero(own)[0]]] = True
    # Between the first surge and the last dive, short lines stay, and marked ones that surge with their lowered weight.
    first, last = np.flatnonzero(kept)[[0, -1]]
    less = np.convolve(np.where(lowered & ~linked, length // LOWERED, 0), np.ones(WINDOW, np.int64)) >= SURGE
    surging = lowered & ~linked & np.array([less[k : k + WINDOW].any() for k in range(len(weight))])
    short = np.zeros(len(weight), bool)
    short[at[own > 0]] = True
    between = slice(first, last + 1)
    kept[between] |= short[between] | (surging & (inside | (not article)))[between]
    kept &= ~furniture | surging
    kept = [lines.text[k] for k in np.flatnonzero(kept)]
    return "\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 64):
            part = b.slice(i, 64)
            texts = [main_text(h) for h in part.column("html").to_pylist()]
            yield batch(page_id=part.column("page_id"), url=part.column("url"), text=pa.array(texts, pa.string()), n_chars=np.array([len(t) for t in texts], np.int64))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (its code points) for each row of ``pages``; nothing is shuffled.

    Null and empty pages have the empty text; of lines that weigh the same the first is a tie's
    winner, as windows are read in page order.  Character references are decoded, white space
    within a block becomes one blank, nothing of a region is dropped or shortened, however long
    the page.  Repeated rows have the same text each, an empty table gives an empty one; columns
    besides the three are not read.
    """
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return arrow_map(source, _extract, "page_id long, url string, text string, n_chars long")

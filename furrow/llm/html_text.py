"""Main text of web pages by line-block distribution (operator 4).

Markup is stripped into lines, one for each block. Lines in menus, forms,
notices and the like count nothing, link text counts nothing, and where the
page marks its article, lines outside it count nothing. Text lengths are
summed over a sliding window of lines. The sum surges where the text is, and
the elements that hold the surging lines are its containers. From the first
surge to the last, and in the containers before and after, the text goes on
until the sum dives to nothing. Inside a marked article lines of links alone
are text like others, and so are linked headings; elsewhere they stay between
text, or where the window still has some.

An element is left out for its tag, its role or its name. A name with a word
for text beside it leaves an element out only if that holds less than half of
the text; in a marked article no name does that for nine tenths of the text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from furrow.llm.common import batches
from furrow.llm.sentencepiece_codec import _schema, _with

#: Lines of a window, the characters in one that make a surge, and those below
#: which it has dived.
WINDOW, SURGE, DIVE = 3, 86, 1
PIECE_BYTES = 4 << 20

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|template|noscript|svg|iframe|math|object)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?][^>]*>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

# fixed values: elements and names by their use in HTML
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td tfoot th thead title tr ul".split())
#: Blocks that hold other lines; the rest are lines, lists or tables in them.
_CONTAINERS = frozenset("article aside details dialog div fieldset footer form header main section td th".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_APART = frozenset("aside button dialog footer form head header menu nav select title".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_NAMES = (
    "ad ads adsense advert advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies "
    "disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay "
    "pager pagination popup promo promoted promotion related search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription toolbar widget").split()
_COMMENTS = "comment commentlist comments disqus replies reply respond responses talkback".split()
_TEXTUAL = "article body content copy entry main post prose story text".split()


def _names(words: list[str]) -> re.Pattern:
    return re.compile(rf"(?!(?:with|has|no|without)[-_])(?:\S+[-_])?(?:{'|'.join(words)})(?:[-_]\S+)?", re.I)


_NAMED, _COMMENTING, _OF_TEXT = _names(_NAMES), _names(_COMMENTS), _names(_TEXTUAL)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How an element counts: text, left out, left out for its name unless it holds
#: nearly all the text, left out for its name unless it holds most of it.
TEXT, OUT, NAMED, SOFT = range(4)


def _apart(tag: str, rest: str, in_article: bool) -> int:
    """Whether an element is no part of the main text, and why."""
    if tag in _APART and not (tag == "header" and in_article):
        return OUT
    if not rest or tag in ("html", "body", "main"):
        return TEXT
    named, textual = False, False
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            return OUT
        if name in ("class", "id"):
            for x in value.split():
                if _COMMENTING.fullmatch(x):
                    return OUT
                named = named or bool(_NAMED.fullmatch(x))
                textual = textual or bool(_OF_TEXT.fullmatch(x))
    if re.search(r"(?<![-\w=\"'])hidden(?![-\w])", _ATTRIBUTE.sub("", rest)):
        return OUT
    if not named:
        return TEXT
    return OUT if tag not in _BLOCKS else SOFT if textual else NAMED


def lines(page: str) -> tuple[list[str], np.ndarray, np.ndarray, list[tuple], list[int], list[int], list[tuple[int, bool]]]:
    """Lines of a page in order, their weights, which the page marks as its
    article (2) or main part (1), and their places: the innermost container (0
    is the page), and for a line that is the text of a container itself, what
    it shares with its like beside it, else None. Then the container around
    each container; the innermost named element of each line (0 is none); and
    of each such element the one around it and whether it is a soft one."""
    out, weight, marks, places, names = [], [], [], [], []
    named, inside = [(0, False)], []    # named elements; the open ones as [tag, nesting, number]
    heading = False
    text, linked = [], 0
    around, path = [0], [(0, "")]       # open containers and their elements
    opened: Counter[str] = Counter()
    bare = True                         # no paragraph or the like around the text
    skip, depth, link = "", 0, 0        # the element left out, its nesting; open links
    article = main = seen = 0

    def flush():
        nonlocal linked
        line = " ".join(entities.unescape("".join(text)).split())
        if line:
            out.append(line)
            weight.append(max(int(heading), len(line) - linked))
            names.append(inside[-1][2] if inside else 0)
            marks.append(2 if article else 1 if main else 0)
            inner, element = path[-1]
            places.append((inner, (around[inner], element) if bare and inner else None))
        text.clear()
        linked = 0

    at = 0
    for m in _MARKUP.finditer(page):
        if not skip and m.start() > at:
            piece = page[at:m.start()]
            text.append(piece)
            if link:
                linked += len(piece)
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        end = bool(m["end"])
        if inside:
            # a named element ends with its tag, whatever is open in it
            if tag in ("article", "main") and not end and not seen and not _apart(tag, m["rest"], False):
                flush()
                inside.clear()
                skip = ""
            elif inside[-1][0] in ("p", "li") and tag in _BLOCKS and (not end or tag != inside[-1][0]):
                flush()
                inside.pop()
                skip = ""
            for i in range(len(inside) - 1, -1, -1):
                if inside[i][0] == tag:
                    inside[i][1] += -1 if end else 1
                    if not inside[i][1]:
                        flush()
                        del inside[i:]
                        skip = ""
                    break
        if skip:
            if tag in ("article", "main") and not end and not seen and not _apart(tag, m["rest"], False) or tag == "body" and skip in ("head", "title"):
                skip = ""
            elif skip in ("p", "li") and tag in _BLOCKS and (not end or tag != skip):
                skip = ""
            else:
                if tag == skip and tag not in _VOID:
                    depth += -1 if end else 1
                    if not depth:
                        skip = ""
                continue
        if tag in _BLOCKS:
            flush()
            heading = tag in _HEADINGS and not end
            bare = end or tag in _CONTAINERS or tag in ("html", "body")
        elif tag == "br":
            text.append(" ")
        why = TEXT if end or tag in _VOID else _apart(tag, m["rest"], article > 0)
        if why == OUT:
            skip, depth = tag, 1
            continue
        if why:
            named.append((inside[-1][2] if inside else 0, why == SOFT))
            for entry in inside[::-1]:      # its tag closes this one, not that
                if entry[0] == tag:
                    entry[1] -= 1
                    break
            inside.append([tag, 1, len(named) - 1])
        if tag in _CONTAINERS:
            if not end:
                around.append(path[-1][0])
                path.append((len(around) - 1, tag))
                opened[tag] += 1
            elif opened[tag]:
                closed = ""
                while closed != tag:
                    closed = path.pop()[1]
                    opened[closed] -= 1
        if tag == "a":
            link = 0 if end else 1
        elif inside:
            pass                            # no article of the page's own
        elif tag == "article":
            article, seen = max(0, article + (-1 if end else 1)), 1
        elif tag == "main":
            main, seen = max(0, main + (-1 if end else 1)), 1
    if not skip and at < len(page):
        text.append(page[at:])
    flush()
    return out, np.asarray(weight, np.int64), np.asarray(marks, np.int64), places, around, names, named


def _left(weight: np.ndarray, marks: np.ndarray, names: list[int], named: list[tuple[int, bool]]) -> np.ndarray:
    """Which lines are in no element that its name leaves out."""
    top = int(marks.max())
    held = np.bincount(names, np.where(marks == top, weight, 0), len(named))
    whole = held.sum()
    for i in range(len(named) - 1, 0, -1):  # with what is in elements within
        held[named[i][0]] += held[i]
    stays = [True] * len(named)
    for i in range(1, len(named)):
        around, soft = named[i]
        most = 2 * held[i] >= whole if soft else top > 0 and 10 * held[i] >= 9 * whole and held[i] >= SURGE
        stays[i] = stays[around] and held[i] > 0 and bool(most)
    return np.asarray(stays)[names]


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by an empty line."""
    if not page:
        return ""
    out, weight, marks, places, around, names, named = lines(page)
    if len(named) > 1 and out:
        left = _left(weight, marks, names, named)
        out, places = ([x for x, k in zip(xs, left) if k] for xs in (out, places))
        weight, marks = weight[left], marks[left]
    if not out:
        return ""
    # the page may tell where its article is: no line elsewhere counts
    part, marked = marks == marks.max(), bool(marks.any())
    weight = np.where(part, weight, 0)
    if marked and not weight.any():
        weight = part.astype(np.int64)          # an article of links alone
    windows = np.lib.stride_tricks.sliding_window_view(np.r_[weight, np.zeros(WINDOW - 1, np.int64)], WINDOW)
    window = windows.sum(axis=1)                # the line and those after it
    least = min(SURGE, int(window.max()))
    if not least:
        return ""
    surge = np.flatnonzero(window >= least)
    # where the heaviest line of a surge is, there is the text
    heaviest = {places[i] for i in (surge + windows[surge].argmax(axis=1)).tolist()}
    holds, alike = [False] * len(around), {like for _, like in heaviest if like}
    for c, _ in heaviest:
        holds[c] = True
    for c in range(1, len(around)):     # and what is in them, but for the page
        holds[c] = holds[c] or around[c] > 0 and holds[around[c]]
    held = np.fromiter((holds[c] or like in alike for c, like in places), bool, len(out))
    keep = held.copy()
    keep[surge] = True
    if not marked:
        keep &= weight > 0
    # lines between: other text, and links in the containers or before the sum dives
    at = np.flatnonzero(keep & (weight > 0))
    first, last = int(surge[0]), int(at[-1])
    keep[first:last + 1] |= weight[first:last + 1] > 0
    if marked:
        keep[first:last + 1] = True
    else:
        own = held & np.fromiter((c > 0 for c, _ in places), bool, len(out))
        keep[first:last + 1] |= own[first:last + 1]
        at = np.flatnonzero(keep)
        for i, j in zip(at[:-1], at[1:]):
            if window[i + 1] >= DIVE:
                keep[i:j] |= weight[i:j] < 1
    keep &= part
    return "\n\n".join(x for x, k in zip(out, keep) if k)


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``, the main text of each page.

    Null, empty and text-free pages have an empty text. Rows are independent;
    other columns pass through, and a column already named ``out`` is
    replaced.
    """

    def run(rows):
        for b in rows:
            for piece in batches([b], PIECE_BYTES):
                yield _with(piece, out, pa.array([main_text(p) for p in piece.column(html).to_pylist()], pa.string()))

    return df.mapInArrow(run, _schema(df, out, T.StringType()))

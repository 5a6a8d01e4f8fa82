"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block of text, in page order.  A line's weight is its text length, less
twice its link text.  Menus, headers, footers, sidebars, notices, adverts, forms and reader comments leave no line and no
gap.  A block named by its class, id or role as one of these goes as well, unless there is no article element beside the
blocks so named and they hold more text than the rest of the page: then their names are not believed.  An article or main element is a hint that moves weight:
by the share of the page's text that it holds, lines outside it weigh less and lines inside it more, so that an
element around nearly all text decides, and one around a teaser hardly counts.  The weights are summed over sliding
windows of WINDOW lines; where the sum rises from nothing a run begins, where it dives to nothing the run ends.  A run
with a surge, a window of SURGE of the page's highest, stays, from its first to its last line that has weight enough, and
so does a run, however short, in the article or directly in the element of a run that stays: a closing line after a
table of links is text of the same story.

Defined cases: null or empty html, and pages without text, give an empty text; an unclosed comment, script
or style reaches to the end; other unclosed and stray tags are allowed; an unclosed article reaches to
the end of what encloses it; rows that repeat are extracted each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.llm import common

#: Lines of a window; part of the page's highest window that a surge takes; weight that an article element may add to a line.
WINDOW, SURGE, LIFT = 3, 0.05, 40.0
_TAG = re.compile(r"<!--(?:-?>|.*?-->|.*)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# HTML elements by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "option", "optgroup"}
_SELF_CLOSING = {"li": "ul ol menu dir", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select", "p": "body"}
_SELF_CLOSING = {k: frozenset(v.split()) for k, v in _SELF_CLOSING.items()}
_GONE = frozenset("head nav header footer aside form button select template noscript svg math canvas object audio video dialog menu search label".split())
# Words in class, id and role that name something other than the article.
_OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toolbar "
    "header masthead footer contentinfo copyright sidebar sidenav aside complementary widget widgets "
    "notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations trending "
    "comment comments disqus respond reply replies form search searchform".split()
)
# Words that may follow one of those in a name without changing what it names.
_HOLDERS = frozenset(
    "area bar block blocks body bottom box button buttons card cards container content feed form head heading holder icon icons inner item items label left "
    "line link links list module outer pane panel post posts right section slot stories tag text thread title tools top unit widget wrap wrapper zone".split()
)
_WHOLE = frozenset("html body article main".split())
_WITH = re.compile(r"^(?:has|no|with|without|is|not)[-_]", re.I)


def _named_other(attributes: str, least: frozenset = _OTHER) -> bool:
    for m in _NAMES.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            words = [p.lower() for p in _PART.findall(name)]
            # A name says what its last word is: "cookie-notice" is a notice, "related-work" is work, and "ad-slot" an advert's place.
            while len(words) > 1 and words[-1] in _HOLDERS and words[-1] not in least:
                words.pop()
            if words and words[-1] in least and not _WITH.match(name):
                return True
    return False


_COMMENT = frozenset("comment comments reply".split())


def page_lines(html: str) -> tuple[list[str], list[int], list[bool]]:
    """Text, length of link text and whether in an article, per line."""
    lines, links, inside, _ = _blocks(html)
    return lines, links, inside


def _blocks(html: str) -> tuple[list[str], list[int], list[bool], list[int]]:
    """page_lines and the element that holds each line's block, by its number; blocks named as other parts are left out if believed."""
    found: list[tuple[str, int, bool, int, bool]] = []
    buffer: list[str] = []
    # Open elements: name, gone, in an article, in a link, in a block named as another part, number.
    stack: list[tuple[str, bool, bool, bool, bool, int]] = []
    open_names: dict[str, int] = {}
    gone = article = link = named = False
    linked = owner = numbers = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            found.append((text, min(linked, len(text)), article, owner, named))
        buffer.clear()
        linked = 0

    def pop() -> None:
        nonlocal gone, article, link, named
        name = stack.pop()[0]
        open_names[name] -= 1
        gone, article, link, named = stack[-1][1:5] if stack else (False, False, False, False)

    def close(name: str) -> None:
        while stack[-1][0] != name:
            pop()
        pop()

    def take(raw: str) -> None:
        nonlocal linked, owner
        if gone:
            return
        text = unescape(raw) if "&" in raw else raw
        if not buffer:
            at = len(stack) - 1
            while at >= 0 and stack[at][0] not in _BLOCK:
                at -= 1
            owner = stack[at - 1][5] if at > 0 else 0
        buffer.append(text)
        if link:
            linked += len(text)

    at, last = 0, html.rfind(">")
    while at < len(html):
        m = _TAG.search(html, at) if at <= last else None
        begin = m.start() if m else len(html)
        # A comment that is not closed reaches to the end also behind the last ">".
        if m is None and (c := html.find("<!--", at)) >= 0:
            begin = c
        if begin > at:
            take(html[at:begin])
        if m is None:
            break
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in _BLOCK:
                flush()
            if open_names.get(name):
                close(name)
            continue
        if name in _BLOCK:
            flush()
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in _VOID:
            continue
        if name in _CLOSES_P and open_names.get("p"):
            _close_open(stack, pop, "p", frozenset(("button", "td", "th", "table", "object")))
        if name in _SELF_CLOSING and name != "p" and open_names.get(name):
            _close_open(stack, pop, name, _SELF_CLOSING[name])
        attributes, soft = m[3], False
        if gone and name in ("article", "main") and stack and any(x[0] == "form" for x in stack) and not any(x[0] != "form" and x[0] in _GONE for x in stack):
            away = _named_other(attributes)  # a form around the whole page
        elif gone and name in ("h1", "h2", "h3", "h4", "h5", "h6") and article and stack[-1][0] in ("header", "hgroup") and sum(x[1] for x in stack) == 1:
            away = False  # an article's own headline
        else:
            other = bool(attributes) and name not in _WHOLE and _named_other(attributes)
            soft = other and name in _BLOCK and not _named_other(attributes, _COMMENT)
            away = (
                gone
                or name in _GONE
                or other and not soft
                or bool(attributes) and name in ("article", "main") and _named_other(attributes, _COMMENT)
                or bool(attributes) and name not in ("html", "body") and bool(_HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", _style_only, attributes)))
            )
        gone, article, link, named = away, article or (name in ("article", "main") and not away), link or name == "a", named or soft
        numbers += 1
        stack.append((name, gone, article, link, named, numbers))
        open_names[name] = open_names.get(name, 0) + 1
    flush()
    # Names are believed beside an article element, or unless what they name is most of the page.
    bare = lambda rows: sum(max(len(text) - 2 * linked, 0) for text, linked, *_ in rows)
    rest = [x for x in found if not x[4]]
    if any(x[2] for x in rest) or bare(found) - bare(rest) <= bare(rest):
        found = rest
    return [x[0] for x in found], [x[1] for x in found], [x[2] for x in found], [x[3] for x in found]


def _style_only(m: re.Match) -> str:
    """Attribute values, of which only those that hide an element count."""
    return m[0] if re.search(r"display\s*:\s*none|^.true.$", m[0], re.I) else '""'


def _close_open(stack: list, pop, name: str, scope: frozenset) -> None:
    """Closes an open element of this name that the next tag ends, unless an element of `scope` lies between."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            for _ in range(len(stack) - i):
                pop()
            return
        if stack[i][0] in scope:
            return


def line_weights(length: np.ndarray, links: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, float]:
    """(weight of every line, weight that a line at the edge of a kept run has at least).

    With no article element a line weighs its text without twice its link text.  Otherwise the more of the page's
    text the element holds, the less lines outside weigh and the more every line inside does.
    """
    bare = np.maximum(length - 2 * links, 0)
    inner, outer = length[within].sum(), bare[~within].sum()
    share = inner / (inner + outer) if inner else 0.0
    weight = np.where(within, np.where(length > 0, length + LIFT * share, 0.0), bare * (1 - share))
    return weight, LIFT * share


def main_text(html: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    if not html:
        return ""
    lines, links, inside, owners = _blocks(html)
    if not lines:
        return ""
    length = np.array([len(x) for x in lines], dtype=np.int64)
    weight, edge = line_weights(length, np.array(links, dtype=np.int64), np.array(inside, dtype=bool))
    sums = np.convolve(weight, np.ones(window))[window - 1 :]  # of the lines i .. i + window - 1
    if not sums.any():
        return ""
    # A run of windows with text begins where the sum rises from nothing and ends where it dives to nothing.
    live = np.concatenate([[False], sums > 1e-9, [False]])
    rises, falls = np.flatnonzero(live[1:] & ~live[:-1]), np.flatnonzero(~live[1:] & live[:-1])
    runs = []
    for a, b in zip(rises.tolist(), falls.tolist()):
        text = np.flatnonzero((weight[a:b] > 0) & (weight[a:b] >= edge))  # windows reach ahead: a run starts and ends at lines of weight
        if len(text):
            places = range(a + int(text[0]), a + int(text[-1]) + 1)
            runs.append((sums[a:b].max() >= surge * sums.max(), [i for i in places if lines[i] and weight[i] >= edge]))
    # What stays also keeps the short runs of its article and of its enclosing elements.
    homes = {(owners[i], inside[i]) for surges, own in runs for i in own if surges}
    story = any(inside[i] for surges, own in runs for i in own if surges)
    return "\n".join(lines[i] for surges, own in runs for i in own if surges or (owners[i], inside[i]) in homes or story and inside[i])


def _extract(batches: Iterator[pa.RecordBatch], window: int, surge: float) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for lo in range(0, rows.num_rows, 200):
            some = rows.slice(lo, 200)
            texts = [main_text(h.as_py(), window, surge) for h in some.column(2)]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame, window: int = WINDOW, surge: float = SURGE) -> DataFrame:
    """One row per row of pages: page_id, url, text (blocks joined by line feeds), n_chars (code points)."""
    common.prepare(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(lambda it: _extract(it, window, surge), "page_id long, url string, text string, n_chars long")

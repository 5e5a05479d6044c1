"""Main text of web pages by the line-block distribution.

A page's markup is stripped to lines, one for each block element, and each line counts its characters outside links.
The counts are summed over sliding windows of lines; where the sum surges above a threshold a passage begins, where it
dives below it ends. The passage with the most text (three times as much if an article or main element holds it) is
the main content. It is widened to the innermost container that holds most of it, or that container's article, with the
headings of the passage; further articles, or passages where there are no articles, of a comparable weight join it. Scripts,
forms and named furniture (menus, footers, adverts, reader comments, ...) never stay, unless the page's article lies in
them; blocks whose names only hint at furniture (related, tags, menu-du-jour, footer-wrap, ...) stay if they surge
themselves or hold the article. Names that tell of a layout (has-sidebar, no-menu) mean nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haulage.llm.common import in_batches, pieces

WINDOW, SURGE, IN_ARTICLE = 3, 80, 3
#: A part joins the main one if so many times its weight is as much.
COMPARABLE = 3

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_ATTR = re.compile(r"(?i)(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s\"'/>]|$)")
_QUOTE = re.compile(r"=\s*([\"'])")
_HIDING = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
_RIGHTS = re.compile(r"(?i)(©|\(c\)|copyright\b|all rights reserved)")
# Element names by their role in a page.
_RAW = frozenset("script style noscript template svg iframe canvas textarea select title".split())
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul label button".split())
_CONTAINERS = frozenset("article body div main section td".split())
_NEVER = frozenset("nav footer aside form button menu dialog label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_REPEATED = frozenset("p li dt dd tr td th option".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAMED_BY_ID = frozenset("div section ul ol table header nav aside footer form dl".split())
# Words of class, id and role names that mark what is no article, and those that may mark either.
_SHUNNED = frozenset("ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments commentlist respond disqus consent cookie cookies copyright disclaimer footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications popup promo promoted promotion sidebar sidebars signup sponsor sponsored subscribe subscription toolbar contentinfo complementary alert reply replies login paywall widget widgets".split())
_EITHER = frozenset("related recommended search share sharing social tags skip reactions feedback".split())
_OF_ARTICLE = frozenset("article post entry story content title".split())
#: Words beside a marking word that leave it what it is (fixed values); words that turn it round, and names of wrappers.
_PLAIN = frozenset("a all area bar body bottom box block center column content desktop fixed footer global group header head heading holder inner item items left list main middle mobile nav outer page panel primary region right row secondary section site small sticky strip text thread title top unit user wp form area cloud link links block policy bottom1 level depth even odd new old".split())
_ABSENT, _WRAPPERS = frozenset("has no not with without is hide show".split()), frozenset("wrap wrapper container layout grid".split())
_COMMENTS = frozenset("comment comments commentlist respond disqus reply replies".split())
_QUOTED = frozenset("quote pullquote pull blockquote".split())


@dataclass
class Page:
    """Lines of a page and the elements that hold them, in page order."""

    text: list[str] = field(default_factory=list)
    plain: list[int] = field(default_factory=list)  # characters outside links
    node: list[int] = field(default_factory=list)
    heading: list[bool] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [-1])
    last: list[int] = field(default_factory=lambda: [0])  # the last element opened inside
    article: list[int] = field(default_factory=lambda: [0])  # the nearest article or main element, or 0
    either: list[int] = field(default_factory=lambda: [0])  # the nearest element that may be furniture, or 0
    kind: list[int] = field(default_factory=lambda: [0])  # what _kind says of the element
    name: list[str] = field(default_factory=lambda: [""])
    holds: list[bool] = field(default_factory=lambda: [True])  # a container of blocks


def _words(value: str) -> list[list[str]]:
    return [re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", token).lower()) for token in value.split()]


#: What an element's marks say: nothing, a hint, furniture unless the article lies in it, reader comments, never.
NONE, HINT, MARKED, COMMENTS, NEVER = range(5)


def _token(words: list[str], inside: bool) -> int:
    """What one name of a class, id or role says."""
    if words and words[0] in _ABSENT:
        return NONE
    marks = [w for w in words if w in _SHUNNED] + ["header"] * ("header" in words and not inside and not _OF_ARTICLE.intersection(words))
    if not marks:
        return HINT if _EITHER.intersection(words) else NONE
    rest = [w for w in words if w not in marks and w not in _PLAIN and not w.isdigit()]
    if rest:
        known = _OF_ARTICLE.union(_WRAPPERS, _EITHER)
        return HINT if any(w in known for w in rest) or len(rest) >= len(marks) else MARKED
    return COMMENTS if _COMMENTS.intersection(marks) else MARKED


def _kind(name: str, attrs: str, inside: bool) -> int:
    kind = MARKED if name == "form" or (name == "header" and not inside) else NEVER if name in _NEVER else NONE
    if not attrs:
        return kind
    quoted = False
    for m in _ATTR.finditer(attrs):
        what, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if what == "hidden" and value.lower() != "until-found" or what == "aria-hidden" and value.lower() == "true" or what == "style" and _HIDING.search(value):
            return NEVER
        if what not in ("class", "id", "role") or name in ("html", "body", "main") or name in _HEADINGS:
            continue
        if what == "id" and (name not in _NAMED_BY_ID or (name == "section" and inside)):
            continue
        told = _words(value)
        quoted = quoted or any(_QUOTED.intersection(words) for words in told)
        if name == "article":  # a comment may be an article of its own
            kind = max(kind, COMMENTS if any(_token(words, inside) == COMMENTS for words in told) else NONE)
            continue
        kind = max([kind, *[_token(words, inside) for words in told]])
    return NONE if name == "aside" and inside and quoted else kind


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag; comments, declarations and raw elements have no name.

    Every search goes on from where the last one ended, or is not made again once it has failed, so a page is scanned in
    time that is linear in its length.
    """
    at, quotes = 0, {'"', "'"}
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield at, (end := len(page) if end < 0 else end + 3), "", False, ""
        elif page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            yield at, (end := len(page) if end < 0 else end + 3), "", False, ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            yield at, (end := len(page) if end < 0 else end + 1), "", False, ""
        elif m := _NAME.match(page, at + 1):
            end = _tag_end(page, m.end(), quotes)
            if end < 0:
                return  # no tag can end any more: the rest is text
            name, closing = m[1].lower(), page[at + 1] == "/"
            attrs = page[m.end() : end - 1]
            if name in _RAW and not closing and not attrs.endswith("/"):
                shut = re.compile(rf"(?i)</{name}(?=[\s/>])[^>]*>?").search(page, end)
                yield at, (end := shut.end() if shut else len(page)), "", False, ""
            else:
                yield at, end, name, closing, attrs
        else:
            end = at + 1
        at = end


def _tag_end(page: str, begin: int, quotes: set[str]) -> int:
    """The place after the tag's closing sign, or -1; signs in quoted attributes do not close it."""
    at = begin
    while (end := page.find(">", at)) >= 0:
        m = _QUOTE.search(page, at, end) if quotes else None
        if not m or m[1] not in quotes:
            return end + 1
        shut = page.find(m[1], m.end())
        if shut < 0:  # an unclosed quote does not hide the rest of the page
            quotes.discard(m[1])
            return end + 1
        at = shut + 1
    if at == begin:
        return -1
    quotes.clear()  # quotes hide every closing sign from here on, so they mean nothing
    return page.find(">", begin) + 1


def parse(page: str) -> Page:
    """The page's lines that are not in scripts, and its elements with what their names say of them."""
    p = Page()
    stack: list[tuple[str, int]] = [("", 0)]
    opened: Counter = Counter()
    parts: list[str] = []
    plain, links, heads = 0, 0, 0

    def flush() -> None:
        nonlocal plain
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            p.text.append(text)
            p.plain.append(min(plain, len(text)))
            p.node.append(stack[-1][1])
            p.heading.append(heads > 0)
        plain = 0

    def said(text: str) -> None:
        nonlocal plain
        parts.append(text)
        if not links:
            plain += len(text.strip())

    def pop() -> None:
        nonlocal heads
        name, node = stack.pop()
        opened[name] -= 1
        heads -= name in _HEADINGS
        p.last[node] = len(p.parent) - 1

    at = 0
    for start, end, name, closing, attrs in _tags(page):
        said(page[at:start])
        at = end
        if name == "br":
            parts.append(" ")
        elif name == "a":
            links = 0 if closing else 1
        if not name or name in _VOID and name != "hr":
            continue
        block = name in _BLOCKS
        if closing:
            if opened[name]:
                flush()
                while stack[-1][0] != name:
                    pop()
                pop()
            elif block:
                flush()
            continue
        inside = p.article[stack[-1][1]] > 0
        kind = NONE if attrs.endswith("/") and not block else _kind(name, attrs, inside)
        if not block and not kind and not (stack[-1][0] == name and p.kind[stack[-1][1]] > HINT):
            continue
        flush()
        if name == "hr":
            continue
        links = 0 if block else links
        if name in _REPEATED and stack[-1][0] == name:
            pop()
        up = stack[-1][1]
        node = len(p.parent)
        p.parent.append(up)
        p.last.append(node)
        p.kind.append(kind)
        p.name.append(name)
        p.holds.append(name in _CONTAINERS)
        p.article.append(node if name in ("article", "main") and kind != COMMENTS else p.article[up])
        p.either.append(node if kind == HINT else p.either[up])
        stack.append((name, node))
        opened[name] += 1
        heads += name in _HEADINGS
    said(page[at:])
    flush()
    while len(stack) > 1:
        pop()
    p.last[0] = len(p.parent) - 1
    return p


def passages(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """[surge point, dive point) of every passage of lines whose windowed length stays above the threshold."""
    n = len(lengths)
    sums, total = [], 0
    for i in range(n + window - 1):
        total += lengths[i] if i < n else 0
        total -= lengths[i - window] if i >= window else 0
        sums.append(total)
    blocks = [max(sums[i : i + window]) for i in range(n)]  # the fullest window that holds the line
    out, start = [], None
    for i, b in enumerate([*blocks, 0]):
        if b >= surge and start is None:
            start = i
        elif b < surge and start is not None:
            out.append((start, i))
            start = None
    return out


def _furniture(p: Page) -> list[bool]:
    """Which elements are furniture, or lie in some: marked elements that the page's article does not lie in."""
    n = len(p.parent)
    holds, main = [False] * n, [False] * n  # an article or main element, a main element below
    for node in range(n - 1, 0, -1):
        own = p.article[node] == node and p.kind[node] != NEVER
        holds[p.parent[node]] |= holds[node] or own
        main[p.parent[node]] |= main[node] or (own and p.name[node] == "main")
    out = [False] * n
    for node in range(1, n):
        up, kind = p.parent[node], p.kind[node]
        spared = holds[node] if kind == MARKED and not p.article[up] else main[node] if kind == COMMENTS else False
        out[node] = out[up] or (kind > HINT and not spared)
        if kind == HINT and holds[node] and not p.article[up]:
            p.kind[node] = NONE
    for node in range(1, n):  # hints that hold the article are none
        p.either[node] = node if p.kind[node] == HINT else p.either[p.parent[node]]
    return out


def _keep(p: Page, lines: list[int]) -> None:
    p.text, p.plain, p.node, p.heading = ([column[i] for i in lines] for column in (p.text, p.plain, p.node, p.heading))


def _main_parts(p: Page, lengths: list[int], window: int, surge: int) -> list[tuple[int, int, tuple[int, int]]]:
    """First and last element of each part of the main content, and its passage; the heaviest part first."""
    weight = lambda i: lengths[i] * (IN_ARTICLE if p.article[p.node[i]] else 1)
    found = passages(lengths, window, surge) or [(0, len(lengths))]
    weights = {r: sum(weight(i) for i in range(*r)) for r in found}
    main = max(found, key=lambda r: (weights[r], -r[0]))
    parts = []
    for a, b in sorted(found, key=lambda r: r != main):
        if COMPARABLE * weights[a, b] < weights[main]:
            continue
        held = [0] * len(p.parent)
        for i in range(a, b):
            held[p.node[i]] += weight(i)
        for node in range(len(held) - 1, 0, -1):
            held[p.parent[node]] += held[node]
        inner = max((k for k, w in enumerate(held) if 2 * w > held[0] and p.holds[k]), default=0)  # numbered as they open: the innermost
        if p.article[inner]:
            inner = p.article[inner]
        else:  # a passage over several articles is theirs
            inside = [k for k in range(1, len(held)) if p.article[k] == k]
            if 2 * sum(held[k] for k in inside) > held[0]:
                inner = max(inside, key=lambda k: (held[k], -k))
        if parts and bool(p.article[inner]) != bool(p.article[parts[0][0]]):
            continue  # beside an article only articles, beside plain passages only such
        parts.append((inner, p.last[inner], (a, b)))
    first = parts[0][0]
    if p.article[first]:  # articles of which one passage reaches over several
        sums = [0] * len(p.parent)
        for i, node in enumerate(p.node):
            sums[p.article[node]] += lengths[i]
        taken = {low for low, _, _ in parts}
        for node in range(1, len(sums)):
            if node not in taken and p.article[node] == node and sums[node] >= surge and COMPARABLE * sums[node] >= sums[first] and not any(low <= node <= high for low, high, _ in parts):
                parts.append((node, p.last[node], (0, 0)))
    return parts


def _bare(p: Page, lines: list[int]) -> list[int]:
    """The lines without links alone and notices of rights at both ends."""
    edge = lambda i: not p.heading[i] and (not p.plain[i] or _RIGHTS.match(p.text[i]))
    a, b = 0, len(lines)
    while a < b and edge(lines[a]):
        a += 1
    while b > a and edge(lines[b - 1]):
        b -= 1
    return lines[a:b] or lines


def extract(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a page, blocks joined by newlines; empty for a null or empty page or one without text."""
    p = parse(page or "")
    gone = _furniture(p)
    _keep(p, [i for i, node in enumerate(p.node) if not gone[node]])
    own: dict[int, list[int]] = {}
    for i, node in enumerate(p.node):
        if p.either[node]:
            own.setdefault(p.either[node], []).append(i)
    out = {i for lines in own.values() if not passages([p.plain[i] for i in lines], window, surge) for i in lines}
    _keep(p, [i for i in range(len(p.text)) if i not in out])
    if not p.text:
        return ""
    kept: set[int] = set()
    for low, high, (a, b) in _main_parts(p, p.plain, window, surge):
        inside = [i for i, node in enumerate(p.node) if low <= node <= high]
        if not p.article[low]:
            held = set(inside)
            apart = [i for i in range(a, b) if i not in held and p.plain[i] >= surge]
            if apart and COMPARABLE * sum(p.plain[i] for i in apart) >= sum(p.plain[i] for i in inside):  # the passage goes on outside
                inside = list(range(min(inside[0], apart[0]), max(inside[-1], apart[-1]) + 1))
            if low == 0 or p.name[low] == "body":
                inside = _bare(p, inside)
            while a < inside[0] and not all(p.heading[a : inside[0]]):  # headings right before the element that the passage reaches
                a += 1
            inside += [i for i in range(a, b) if p.heading[i] and p.node[i] < low]
        kept.update(inside)
    return "\n".join(p.text[i] for i in sorted(kept))


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars. Null html counts as empty; repeated rows repeat; further
    columns are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return in_batches(src, run, "page_id long, url string, text string, n_chars long")

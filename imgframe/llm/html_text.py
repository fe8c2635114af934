"""Main text of web pages by line-block distribution.

1. Markup is stripped: a page becomes lines, one for each block of text. Where containers begin or end, blank lines are
   left; the bounds of a marked article leave a whole window of them.
2. A line weighs as many characters as it has outside links. Where a page marks its article (``article``, ``main`` or
   the same by role; of several the heaviest, or a closer one in it), lines in it weigh ``MARK`` more, which alone is
   less than a surge, and all others nothing, as lines of links do elsewhere. Without marks, elements that never hold the article
   (scripts, menus, forms, adverts, comments and the like, by tag, role or class) give no line; with marks that is so
   for those within the article. The weights of ``WINDOW`` lines from each line on are summed.
3. A surge is the first line from which the sum reaches ``SURGE``, without lines of no weight; headings right before it, and short lines with no bound of a container between, belong to it. A
   dive is the last line before the sum falls to nothing. Text between a surge and its dive is a run and kept whole,
   short lines too.
4. The lines of all runs are the article; other text is dropped. So marks say what lines weigh, and surge and dive what
   is kept. Without marks a surge must not be far lighter than the page's heaviest sum, as an advert or a notice is, and
   where no sum reaches ``SURGE`` half of the heaviest one does.

A form that holds most of the weight of a page without marks goes round the page and is kept; so is any other
container that does, if nothing beside it surges. A page is read in one pass, however deep its elements are nested.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import steps

WINDOW, SURGE = 3, 80
#: What a line in a marked article weighs more.
MARK = 79
#: So many times lighter than the heaviest sum a surge may be, where no article is marked.
FAR_LIGHTER = 8

#: Elements whose content is text up to their end tag, and is no text of the page.
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes object audio video canvas select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose bounds leave no blank line.
QUIET = HEADINGS | frozenset("p li dt dd tr td th".split())
#: Start tags that end an open ``p``; and what an open element of the same kind is ended by.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that end an implied end's search.
SCOPES = tuple("ul ol dl table tbody thead tfoot body html article main section div td th nav aside form header footer".split())

#: What is not the article, by tag, role and word of a class or id.
SKIP_TAGS = frozenset("nav header footer aside form dialog button menu head".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead widget share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login popup modal overlay toolbar pagination pager copyright disclaimer skip".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies discussion".split())
#: A class or id that begins so says what is beside an element, not what it is.
BESIDE_WORDS = frozenset("has with no without is not".split())
CONTAINER_WORDS = frozenset("layout page wrapper site body".split())

COMMENT, CDATA, OTHER = re.compile(r"--!?>"), "]]>", re.compile(r">")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*+)>")
OPENING = re.compile(r"<(?:[a-zA-Z]|/[a-zA-Z]|!|\?)")
ATTRIBUTE = re.compile(r"([^\s/=\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)
NAME_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content): text ("", "", text), start ("<", name, attributes) and end ("/", name, "") tags, in one pass."""
    at, text_from, size = 0, 0, len(page)
    while found := OPENING.search(page, at):
        here = found.start()
        tag = None
        if found.group() in ("<!", "<?"):
            if page.startswith("<!--", here):
                end = COMMENT.search(page, here + 2) if page.startswith("<!-->", here) or page.startswith("<!--->", here) else COMMENT.search(page, here + 4)
                stop = end.end() if end else size
            elif page.startswith("<![CDATA[", here):
                end = page.find(CDATA, here)
                stop = end + 3 if end >= 0 else size
            else:
                end = OTHER.search(page, here)
                stop = end.end() if end else size
        else:
            tag = TAG.match(page, here)
            stop = tag.end() if tag else size  # a tag that the page ends in is no text
        if here > text_from:
            yield "", "", page[text_from:here]
        at = text_from = stop
        if tag:
            name = tag[2].lower()
            yield "/" if tag[1] else "<", name, tag[3]
            if name in RAW and not tag[1] and not tag[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, stop)
                at = text_from = end.start() if end else size
    if text_from < size:
        yield "", "", page[text_from:]


class Element:
    """An element that may be skipped or kept. begin and end count tags, so an element inside has begin and end between."""

    __slots__ = ("begin", "end", "first", "in_comment", "in_main", "last", "name", "why", "holds_main", "parent")

    def __init__(self, name: str, why: str, first: int, begin: int, parent: Element | None):
        self.name, self.why, self.first, self.last, self.begin, self.end, self.parent = name, why, first, -1, begin, begin, parent
        self.in_main = parent is not None and (parent.in_main or parent.why == "main")
        self.in_comment = parent is not None and (parent.in_comment or parent.why == "comment")
        self.holds_main = False


def reason(name: str, attributes: str) -> str:
    """Why an element might not be the article: "tag", "name", "comment", "hidden" or "header"; "main" if it says it is; else ""."""
    found = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(attributes)} if TELLING.search(attributes) else {}
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN_STYLE.search(found.get("style", "")):
        return "hidden"
    words = set()
    for whole in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [w.lower() for w in NAME_WORD.findall(whole)]
        if parts and parts[0] not in BESIDE_WORDS:
            words.update(parts)
    if words & COMMENT_WORDS and name not in ("html", "body", "main"):
        return "comment"
    if name in ("article", "main") or role in ("main", "article"):
        return "main"
    if name in ("html", "body"):
        return ""
    if name == "header" or "header" in words and not words & CONTAINER_WORDS - {"page", "site"}:
        return "header"
    if name in SKIP_TAGS or role in SKIP_ROLES:
        return "tag"
    if words & SKIP_WORDS and not words & CONTAINER_WORDS:
        return "name"
    return ""


Line = tuple  # (place, text, weight, whether of a heading, ...)


def page_lines(page: str) -> tuple[list[Line], list[Element]]:
    """Lines (place, text, weight, whether of a heading) of all of a page, and the elements that may be skipped or kept.

    A place is a line or a blank line; elements have the places of their content, first to last.
    """
    lines: list[Line] = []
    marked: list[Element] = []
    stack: list[Element] = []
    open_at: dict[str, list[int]] = {}  # by name, where in the stack its open elements are
    text: list[str] = []
    loose = place = anchors = n_tags = 0

    def flush() -> None:
        nonlocal loose, place
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                lines.append((place, whole, min(loose, len(whole)), any(e.name in HEADINGS for e in stack[-3:])))
                place += 1
            text.clear()
        loose = 0

    def last_open(names: Iterable[str]) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            element = stack.pop()
            open_at[element.name].pop()
            element.last, element.end = place - 1, n_tags

    for kind, name, content in tokens(page):
        n_tags += 1
        if not kind:
            text.append(content)
            if not anchors:
                loose += len(content.strip())
            continue
        if name in INLINE or name in RAW:  # neither ends a line
            if name == "a":
                anchors = 1 if kind == "<" else 0
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in ("td", "th"):  # cells of a row are one line
            text.append(" ")
        else:
            flush()
        anchors = 0
        if name in VOID:
            continue
        quiet = name in QUIET
        if kind == "<":
            if name in ENDS_P:
                while stack and stack[-1].name == "p":
                    close(len(stack) - 1)
            if name in ENDS_SAME:
                same = last_open(ENDS_SAME[name])
                if same > last_open(n for n in SCOPES if n not in ENDS_SAME[name]):
                    close(same)
            why = reason(name, content)
            place += WINDOW if why == "main" else 0 if quiet else 1
            element = Element(name, why, place, n_tags, stack[-1] if stack else None)
            open_at.setdefault(name, []).append(len(stack))
            stack.append(element)
            if why:
                marked.append(element)
            if why == "main":
                above = element.parent
                while above is not None and not above.holds_main:
                    above.holds_main = True
                    above = above.parent
        elif open_at.get(name):
            at = open_at[name][-1]
            why = stack[at].why
            close(at)
            place += WINDOW if why == "main" else 0 if quiet else 1
    flush()
    close(0)
    return lines, marked


def window_sums(lines: list[Line]) -> list[int]:
    """For each line the weights of ``WINDOW`` places from it on."""
    sums, high, total = [], 0, 0
    for place, _, weight, *_ in lines:
        while high < len(lines) and lines[high][0] < place + WINDOW:
            total += lines[high][2]
            high += 1
        sums.append(total)
        total -= weight
    return sums


def surges(lines: list[Line], surge: int) -> list[list[Line]]:
    """The runs of lines from each surge to its dive; none if none surges."""
    sums = window_sums(lines)
    runs: list[list[Line]] = []
    i = done = 0
    while i < len(lines):
        if sums[i] < surge:
            i += 1
            continue
        while not lines[i][2]:
            i += 1
        first = last = i
        while first > done:
            place, _, weight, heading = lines[first - 1][:4]
            if lines[first][0] - place > (WINDOW if heading else 1 if weight else 0):
                break
            first -= 1
        # The sum from the place after a line is nothing where the next line with weight is over a window away.
        while i < len(lines) and lines[i][0] - lines[last][0] <= WINDOW:
            if lines[i][2]:
                last = i
            i += 1
        runs.append(lines[first : last + 1])
        i = done = last + 1
    return runs


def unmarked_runs(lines: list[Line]) -> list[list[Line]]:
    """The runs of lines that surge where no article is marked: to ``SURGE`` and a part of the heaviest sum, or to half of it where none does."""
    most = max(window_sums(lines), default=0)
    return surges(lines, max(SURGE, most // FAR_LIGHTER) if most >= SURGE else max(1, (most + 1) // 2))


def main_text(page: str | None) -> str:
    """The article's blocks of a page, joined by two \\n; empty for a null or empty page and for one without text."""
    if not page:
        return ""
    lines, marked = page_lines(page)
    if not lines:
        return ""
    at = [x[0] for x in lines]
    gone, own_headers = [], []
    for e in marked:
        if e.why == "main" or e.why != "comment" and e.holds_main:  # as where a form goes round the whole page
            continue
        (own_headers if e.why == "header" and e.in_main else gone).append(e)

    def held(e: Element) -> range:
        return range(bisect_right(at, e.first - 1), bisect_right(at, e.last))

    def skipped(elements: list[Element]) -> list[bool]:
        edges = [0] * (len(lines) + 1)
        for e in elements:
            own = held(e)
            edges[own.start] += 1
            edges[max(own.start, own.stop)] -= 1
        for e in own_headers:  # an article's own header keeps its first line, the title, and loses bylines and the like
            own = held(e)[1:]
            edges[own.start] += 1
            edges[max(own.start, own.stop)] -= 1
        return [depth > 0 for depth in accumulate(edges[:-1])]

    def sums(skip: list[bool]) -> list[int]:
        return [0, *accumulate(0 if s else x[2] for x, s in zip(lines, skip, strict=True))]

    def of(e: Element, total: list[int]) -> int:
        own = held(e)
        return total[max(own.start, own.stop)] - total[own.start]

    def left(elements: list[Element], weighted: list[Line]) -> list[Line]:
        # Places that what was skipped took, its bounds too, are closed up: an advert is no dive of the text around it.
        out, closed_up, past, r = [], 0, -1, 0
        ranges = sorted((e.first, e.last, 0 if e.name in QUIET else 2) for e in elements)
        for line, s in zip(weighted, skipped(elements), strict=True):
            while r < len(ranges) and ranges[r][1] < line[0]:
                first, last, bounds = ranges[r]
                if last > past:
                    closed_up += last - max(first, past + 1) + 1 + (bounds if first > past else 0)
                    past = last
                r += 1
            if not s:
                out.append((line[0] - closed_up, *line[1:]))
        return out

    skip = skipped(gone)
    total, seen = sums(skip), [0, *accumulate(not s for s in skip)]
    mains = [e for e in marked if e.why == "main" and not e.in_comment and of(e, seen)]
    if mains:
        # The heaviest; an article inside of a main that holds most of its weight is the closer bound.
        best = max(mains, key=lambda e: (of(e, total), -e.begin))
        inner = [e for e in mains if best.begin < e.begin and e.end <= best.end and 2 * of(e, total) > of(best, total)]
        best = min([best, *inner], key=lambda e: (of(e, total), e.begin))
        own = held(best)
        weighted = [(place, text, max(1, weight) + MARK if i in own else 0, heading) for i, (place, text, weight, heading) in enumerate(lines)]
        runs = surges(left([e for e in gone if best.begin < e.begin and e.end <= best.end], weighted), SURGE)
        return "\n\n".join(x[1] for run in runs for x in run)

    # Hidden text and comments are no part of a page's weight.
    shown = sums(skipped([e for e in gone if e.why in ("hidden", "comment")]))
    most = {id(e) for e in gone if e.why in ("tag", "name") and 2 * of(e, shown) > shown[-1]}
    for kinds in ((), ("name",)):
        narrow = [e for e in gone if not (id(e) in most and (e.name == "form" or e.why in kinds))]
        body = left(narrow, lines)
        if max(window_sums(body), default=0) >= SURGE:
            break
    return "\n\n".join(x[1] for run in unmarked_runs(body) for x in run)


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with text (the main text of the whole page in ``column``) and n_chars (its code points).

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
    in page order by two \\n; nothing else is dropped or capped.

    Defined cases: a null or empty page has the empty text; a page that ends in a tag or an open element is read
    as far as it goes; text and n_chars columns of the input are replaced, other columns and repeated rows are
    passed on; no rows in, no rows out.
    """
    pages = pages.drop("text", "n_chars")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, column):
            texts = [main_text(page) for page in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*batch.schema.names, "text", "n_chars"])

    return pages.mapInArrow(run, f"{schema}, text string, n_chars long")

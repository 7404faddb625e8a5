"""Main text of web pages by tag-path ratios.

A page is cut into blocks (runs of text between block-level tags); a block's
tag path is the chain of block-level elements, with their classes, from the
root down to it. Per path, text outside links, punctuation and number of blocks
are summed; a path's ratio is text per block weighted by punctuation and by how
much its blocks vary, and less where class or id have words that often name
what isn't the article. The ratios are smoothed along the page, fused with each
path's own and compared with a threshold from their spread: paths above it are
content. The content element is the article or main element with most content
text, else the deepest element that holds nearly all of it. Inside it the paths
select again: a path takes the element's own ratio over where it is above its
own and no name speaks against it, so headings, short paragraphs and, in an
article or main element, lists of links stay beside the long ones; in other
elements rows of links go. Outside, only paths above the threshold and the
headings before them stay.

Elements that are navigation, headers, footers, sidebars, adverts, forms or
comments by their element, role or an unmistakable name have no ratio at all.
Those that only say so by name, and forms, stay in if they hold the page's
article, main element or first-level heading or most of its text outside links
and comments. Readers' comments, notices, adverts and offers don't come back
for their length: only where nothing else on the page reads as prose.

Edge cases: a null or empty page, or one without text, gives an empty text;
unclosed and stray tags, unquoted attributes and unknown elements are taken as
browsers do, roughly; nothing is cut off; work and memory grow with the page's
size however deep it nests; all columns but the added ones are kept by
`extract`, whose added columns replace columns of their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from math import exp, log1p, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import col, packed, unpacked

#: Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noframes noscript object ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video audio svg".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"button", "canvas", "iframe", "noscript", "object", "option", "optgroup", "select", "template", "textarea", "video", "audio", "svg", "html", "body", "head", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
LISTS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}, "optgroup": {"select"}}
RULED_OUT = frozenset("head title nav footer aside form button select option textarea noscript template iframe object svg canvas video audio dialog search menu noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in class and id that mark what isn't the article; those of MAYBE also name articles.
MARKS = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|adslot|sponsored|promo|promoted|banner|cookie|cookies|consent|gdpr|popup|paywall|subscribe|subscription|newsletter|signup|login|comment|comments|commentlist|disqus|respond|reply|replies|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|pagination|pager|sidebar|aside|widget|widgets|recommended|recommendations|share|sharing|social|toolbar|masthead|topbar|copyright|related|footer|header|foot)(?:$|[\s_-])|comment(?:s|list)?$|sidebar|cookie|advert|newsletter|breadcrumb|adsby", re.I)
MAYBE = re.compile(r"(?:^|[\s_-])(?:more|sponsor|promotion|print|register|legal|side|skip|search|tags|hidden|form|modal|overlay|discussion)(?:$|[\s_-])", re.I)
#: Names that end in what a page says itself, of which any word before may be the subject.
OWN_WORDS = re.compile(r"[_-](?:text|content|body|article|entry|post|story|main|copy|paragraph)s?$", re.I)
#: Notices, adverts and offers; like readers' talk they may be longer than the article.
NOTICE = re.compile(r"(?:^|[\s_-])(?:notices?(?=$|\s)|ads?|adv|adverts?|advertisement|advertising|adsense|adslot|sponsored|promo|promoted|banner|cookies?|consent|gdpr|popup|paywall|subscribe|subscription|newsletter|signup|login)(?:$|[\s_-])|cookie|advert|newsletter|adsby", re.I)
#: Parts of lists and tables, which may be links as a whole in an article.
ITEMS = frozenset("li dt dd td th".split())
#: Least text outside links of a block that reads as prose.
PROSE = 20
#: What a ratio is multiplied by for each such name on its path.
DOUBT = 0.3
PIECE = re.compile(r"<!--.*?(?:-->|$)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S | re.I)
#: Class words that say what a page has or lacks, not what the element is.
ABOUT = re.compile(r"(?<![A-Za-z0-9_-])(?:has|no|with|without)(?:[-_]\S*|[A-Z]\S*)")
#: Names of what readers write, which may be longer than the article.
TALK = re.compile(r"comment|disqus|respond|reply|replies|discussion", re.I)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
POINTS = re.compile(r"[.,;:!?…。，、；：！？«»\"“”]")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Element:
    __slots__ = ("tag", "path", "out", "parent", "depth", "inside", "named", "talk", "doubt", "weight", "sums")

    def __init__(self, tag: str, path: int, out: bool, parent: _Element | None, named: bool = False, talk: bool = False, maybe: bool = False):
        self.tag, self.path, self.out, self.parent = tag, path, out, parent
        self.depth = parent.depth + 1 if parent else 0
        self.named, self.talk = named, talk  # ruled out by its name alone, unless it holds the content
        self.doubt = False  # its blocks are content only by their own path's ratio
        self.weight = (parent.weight if parent else 1.0) * (DOUBT if maybe else 1.0)
        # In or below an article or main element that isn't ruled out.
        self.inside = bool(parent and parent.inside) or (tag in ("article", "main") and not out)
        self.sums = 0.0


class _Block:
    __slots__ = ("text", "links", "at", "points")

    def __init__(self, text: str, links: int, at: _Element):
        self.text, self.links, self.at = text, links, at
        self.points = len(POINTS.findall(text))

    @property
    def plain(self) -> int:
        return max(0, len(self.text) - self.links)


def _ruled_out(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, bool, bool, str]:
    """Whether an element can't be content, whether only its name says so, whether it is
    readers' talk or a notice by name, whether its name leaves it open, and its class for the path."""
    out = (tag in RULED_OUT and tag != "form") or (tag == "header" and not inside)
    named, talk, maybe = tag == "form", False, False
    name = ""
    for key, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            name = name or value
            seen = ABOUT.sub(" ", value).lower()
            seen = seen.replace("header", "") if inside else seen  # an article's own header is its title
            marked = bool(MARKS.search(seen) or NOTICE.search(seen))
            if tag in ("html", "body", "article", "main"):
                talk = talk or bool(TALK.search(seen) and marked)
            elif marked and inside and not TALK.search(seen) and OWN_WORDS.search(seen.strip()):
                maybe = True
            elif marked:
                talk = talk or bool(TALK.search(seen) or NOTICE.search(seen))
                named = True
            elif MAYBE.search(seen):
                maybe = True
        elif key == "role":
            out = out or value.strip().lower() in ROLES
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value)):
            out = True
    return out, named, talk, maybe, name


def _gathered(elements: list[_Element], found: list[_Block], value) -> None:
    """Lets each element's sums be those of the blocks in and below it."""
    for e in elements:
        e.sums = 0.0
    for b in found:
        b.at.sums += value(b)
    for e in reversed(elements):  # children come after their parents
        if e.parent is not None:
            e.parent.sums += e.sums


def _settle(elements: list[_Element], found: list[_Block]) -> None:
    """Rules out the elements with a telling name that don't hold the content, and all in them."""
    if not any(e.named for e in elements):
        return
    kept = [b for b in found if not b.at.out]
    live = dict.fromkeys(elements, False)  # holds text that isn't ruled out
    for b in kept:
        live[b.at] = True
    for e in reversed(elements):
        if live[e] and e.parent is not None:
            live[e.parent] = True
    # 2: holds an article or main, 1: a first-level heading, each with text; above or below.
    rank = dict.fromkeys(elements, 0)
    for e in reversed(elements):
        if live[e] and not e.talk:
            rank[e] = max(rank[e], 2 if e.tag in ("article", "main") else int(e.tag == "h1"))
        if e.parent is not None:
            rank[e.parent] = max(rank[e.parent], rank[e])
    below, most = dict.fromkeys(elements, False), 0  # in an element with such a name; the rank outside of all
    talk = dict.fromkeys(elements, False)  # in readers' talk without an article
    for e in elements:
        below[e] = e.named or (e.parent is not None and below[e.parent])
        talk[e] = (e.talk and not rank[e]) or (e.parent is not None and talk[e.parent])
        if live[e] and not e.talk and not below[e]:
            most = max(most, 2 if e.tag in ("article", "main") else int(e.tag == "h1"))
    any_rank = rank[elements[0]]
    # Talk and notices are what they are called, however long, as long as something else reads as prose.
    prose = any(b.plain >= PROSE and b.points and b.at.tag not in HEADINGS and not below[b.at] for b in kept)
    own = [b for b in kept if not ((any_rank or prose) and talk[b.at])]
    _gathered(elements, own, lambda b: b.plain)
    whole = elements[0].sums
    for e in elements:
        if e.parent is not None:
            e.out, e.doubt = e.out or e.parent.out, e.parent.doubt
        if e.named and not e.out:
            bulk = 2 * e.sums > whole and not (e.talk and prose)
            e.out = not (bulk or rank[e] > most)
            e.doubt = e.doubt or not (bulk or rank[e] > 1)


def blocks(page: str) -> tuple[list[_Element], list[_Block]]:
    """The elements of a page, each after its parent, and its text blocks, in order."""
    root = _Element("", 0, False, None)
    elements, stack, found, text = [root], [root], [], []
    paths: dict[tuple[int, str], int] = {}
    opened: dict[str, int] = defaultdict(int)
    links = link = muted = 0
    mute = ""  # an inline element that can't be content, and how deep it is in itself

    def flush() -> None:
        nonlocal links, link, mute, muted
        if text:
            if t := " ".join(entities.unescape("".join(text)).split()):
                found.append(_Block(t, links, stack[-1]))
            text.clear()
        links = link = muted = 0
        mute = ""

    def cut(i: int) -> None:
        for e in stack[i:]:
            opened[e.tag] -= 1
        del stack[i:]

    def pop_to(tags: set[str], stops: set[str] | frozenset[str]) -> None:
        while any(opened[t] for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    cut(i)
                    break
                if stack[i].tag in stops:
                    return
            else:
                return

    at, end = 0, page.rfind(">") + 1  # what follows is no tag
    for m in PIECE.finditer(page, 0, end):
        if m.start() > at and not mute:
            part = page[at : m.start()]
            text.append(part)
            if link:
                links += len(part)
        at = m.end()
        if m[2] and not mute:
            text.append(entities.escape(m[2]))
        tag = (m[4] or m[7] or "").lower()
        if not tag:
            continue
        if tag not in BLOCKS and tag not in VOID:
            if mute:
                muted += (-1 if m[3] or m[6] else 1) * (tag == mute)
                mute = mute if muted else ""
            elif not (m[3] or m[6]) and any(_ruled_out(tag, m[5] or m[8] or "", stack[-1].inside)[:2]):
                mute, muted = tag, 1
        if m[3] or m[6]:
            if tag == "a":
                link = 0
            elif tag in BLOCKS:
                flush()
                if opened[tag]:
                    cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
        elif tag == "br" or tag == "wbr":
            text.append(" " if tag == "br" else "")
        elif tag == "a":
            link = 1
        elif tag in BLOCKS:
            flush()
            if tag in CLOSES_P:
                pop_to({"p"}, {"article", "section", "div", "td", "th", "li", "body", "blockquote"})
            if tag in SIBLINGS:
                pop_to(SIBLINGS[tag], LISTS[tag])
            if tag not in VOID:
                top = stack[-1]
                out, named, talk, maybe, name = _ruled_out(tag, m[5] or m[8] or "", top.inside)
                path = paths.setdefault((top.path, f"{tag}.{name}"), len(paths) + 1)
                e = _Element(tag, path, top.out or out, top, named, talk, maybe)
                elements.append(e)
                stack.append(e)
                opened[tag] += 1
    if at < len(page) and not mute:
        text.append(page[at:])
    flush()
    _settle(elements, found)
    return elements, found


class _Paths:
    """Sums per tag path and the ratios from them."""

    def __init__(self, found: list[_Block]):
        self.count: dict[int, int] = defaultdict(int)
        self.plain: dict[int, float] = defaultdict(float)
        self.chars: dict[int, int] = defaultdict(int)
        self.own: dict[int, float] = {}
        points, squares, weight = defaultdict(float), defaultdict(float), {}
        for b in found:
            if not b.at.out:
                k, n = b.at.path, len(b.text) - 0.9 * b.links
                self.count[k] += 1
                self.plain[k] += n
                self.chars[k] += len(b.text)
                points[k] += b.points
                squares[k] += n * n
                weight[k] = b.at.weight
        for k, n in self.count.items():
            mean = self.plain[k] / n
            spread = sqrt(max(0.0, squares[k] / n - mean * mean))
            self.own[k] = weight[k] * max(0.0, mean) * log1p(points[k] / n) * (1 + log1p(spread))

    def solid(self, k: int) -> float:
        """How much of a path's text isn't links, from 0 to 1."""
        return max(0.0, min(1.0, self.plain[k] / self.chars[k]))


def ratios(found: list[_Block], paths: _Paths, width: float = 1.0) -> list[float]:
    """The fused ratio of each block's path, smoothed along the page; 0 where ruled out."""
    line = [0.0 if b.at.out else paths.own[b.at.path] for b in found]
    reach = 2
    weights = [exp(-((i / width) ** 2) / 2) for i in range(-reach, reach + 1)]
    out = []
    for i, b in enumerate(found):
        total = sum(weights[j + reach] * line[i + j] for j in range(-reach, reach + 1) if 0 <= i + j < len(line))
        out.append(0.0 if b.at.out else sqrt(line[i] * total / sum(weights)) if line[i] else 0.25 * total / sum(weights))
    return out


def main_text(page: str | None) -> str:
    elements, found = blocks(page or "")
    live = [b for b in found if not b.at.out]
    if not live:
        return ""
    paths = _Paths(found)
    score = ratios(found, paths)
    mean = sum(score) / len(score)
    limit = 0.5 * sqrt(sum((s - mean) ** 2 for s in score) / len(score))
    by_path: dict[int, float] = defaultdict(float)
    for b, s in zip(found, score, strict=True):
        if not b.at.out:
            by_path[b.at.path] += s / paths.count[b.at.path]
    chosen = [b for b in live if by_path[b.at.path] >= limit] or live
    best, linked, holders = _container(elements, chosen)

    # The paths' ratios inside: their own, or what the element's text lends to them.
    within = dict.fromkeys(elements, False)
    for e in elements:
        within[e] = e in holders or (e.parent is not None and within[e.parent])
    text = [b for b in chosen if within[b.at]]
    lent = sum(paths.own[b.at.path] for b in text) / max(1, len(text))
    picked = set(map(id, chosen))
    out: list[str] = []
    titles: list[str] = []  # headings, kept if content follows
    for b in live:
        k = b.at.path
        heading = b.at.tag in HEADINGS
        if b.at.weight < 1:  # its name speaks against it: only what reads as the rest does
            keep = id(b) in picked and paths.own[k] >= 0.5 * DOUBT * lent
        elif within[b.at] and not b.at.doubt and ((b.at.inside and b.at.tag in ITEMS) or paths.solid(k) > 0.5) and not (linked and b.links > 0.5 * len(b.text)):
            keep = max(by_path[k], lent) >= limit or id(b) in picked
        else:
            keep = id(b) in picked
        if keep:
            out += [*titles, b.text]
            titles = []
        elif heading and not b.at.doubt and (within[b.at] or b.links <= 0.5 * len(b.text)):
            titles.append(b.text)
        else:
            titles = []
    return "\n".join(out)


def _container(elements: list[_Element], chosen: list[_Block]) -> tuple[_Element, bool, set[_Element]]:
    """The element that holds the content, whether it is no article or main, and it with
    the other articles that have content, as an article in two parts or a list of posts has them."""
    _gathered(elements, chosen, lambda b: len(b.text))
    whole = elements[0].sums
    bodies = [e for e in elements if e.tag in ("article", "main") and e.sums > 0]
    articles = [e for e in bodies if e.tag == "article"]
    if bodies:
        # An article within main, or one article among teasers; main, if its articles share the text.
        best = max(articles, key=lambda e: e.sums, default=None)
        if best is None or best.sums < 0.5 * whole:
            best = max(bodies, key=lambda e: e.sums)
    else:
        best = max((e for e in elements if e.sums >= 0.8 * whole), key=lambda e: e.depth)
        while best.parent is not None and (best.tag in HEADINGS or best.tag in ("p", "li", "td", "th", "tr", "ul", "ol", "blockquote", "pre")):
            best = best.parent
    return best, not bodies, {best, *articles}


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars."""
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(p) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["row", "text", "n_chars"])

    rows = pages.select(packed(names).alias("row"), col(html_col).cast("string").alias("page"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(task, schema).select(*unpacked(names), "text", "n_chars")

"""Main text of web pages by tree scoring.

A page is read into a tree of block elements. Each paragraph passes points for its length and commas to its ancestors,
fewer the further up they are; an element's points are discounted by its link density. The element with most points is
the container of the article; what stands beside it and beside the elements around it stays if it is no menu.
"""

from __future__ import annotations

import heapq
import html
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pairsmith.llm.base import mapped, slices, table

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^A-Za-z>][^>]*>|<![^>]*>"
    r"|</([A-Za-z][^\s/>]*)[^>]*>"
    r"|<([A-Za-z][^\s/>]*)((?:[^>=\"']++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>",
    re.S,
)
_COMMENT = re.compile(r"<!--(?:-?>|.*--!?>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
#: Element names and words of class, id and role attributes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template svg math select object canvas audio video".split())
_DROP = frozenset("nav header footer aside menu dialog button fieldset label datalist".split())
_BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section summary table caption colgroup tbody td tfoot th thead tr ul head".split())
_CLOSES_P = _BLOCK - frozenset("html body head td th tr tbody thead tfoot caption colgroup option optgroup legend".split())
_CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select", "datalist"})}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that stay beside the container with few links, however short they are.
_WHOLE = frozenset("p blockquote pre ul ol dl table figure".split())
#: Elements whose points go to the element around them.
_GIVES = _HEADINGS | frozenset("p li pre td th dd dt figcaption".split())
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted sidebar sidebars menu menus nav navbar navigation navi breadcrumb breadcrumbs "
    "footer foot header masthead banner banners comment comments commentlist respond disqus cookie cookies consent gdpr notice notices notification alert popup popups modal overlay newsletter subscribe subscription "
    "signup login share sharing sharebar social related recommended recommendations widget widgets toolbar pagination pager skip print toc copyright legal disclaimer".split()
)
#: Words that are also common in names of pages and sections; the others of _NOISE seldom name what holds an article.
_UNSURE = frozenset("sponsor sponsors promotion sidebar sidebars footer foot header banner notice notices notification alert cookie subscribe subscription share social widget widgets overlay skip print legal disclaimer copyright toc menu nav".split())
#: Words that on a paragraph or heading say how it looks rather than that it is noise.
_LOOKS = frozenset("legal print header social skip overlay toc widget widgets".split())
#: Words before which a noise word says what a page has or lacks: has-sidebar, no-ads.
_HAVING = frozenset("has have having with without no".split())
_NOISE_ROLES = frozenset("banner navigation complementary contentinfo search dialog alertdialog alert menu menubar toolbar form".split())
#: How sure it is that an element is noise: not at all, by an unsure word or as a form, by a word, by its name or role, and hidden.
_KEPT, _MAYBE, _WORD, _NAME, _HIDDEN = range(5)
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_COMMAS = re.compile("[,\u060c\u3001\uff0c]")


class Element:
    __slots__ = ("all", "children", "direct", "full", "holds", "likely", "links", "noise", "parent", "points", "seen", "shown", "size", "tag", "trusted")

    def __init__(self, tag: str, parent: Element | None, noise: int, trusted: bool) -> None:
        self.tag, self.parent, self.noise, self.trusted = tag, parent, noise, trusted
        self.children: list[Element | str] = []
        self.direct = self.points = 0.0  # points of its own blocks; of all that is inside, by shares
        self.size = self.links = 0
        if parent is not None:
            parent.children.append(self)

    @property
    def density(self) -> float:
        return self.links / self.size if self.size else 0.0


class Linked(str):
    """A block with characters in links."""

    links = 0


def _noise_words(value: str) -> set[str]:
    words, found = [w.lower() for w in _WORDS.findall(_CAMEL.sub(" ", value))], set()
    for i, w in enumerate(words):
        if w in _NOISE and not (i and words[i - 1] in _HAVING and w not in ("print", "skip")):
            found.add(w)
    return found


def _is_noise(tag: str, attributes: str) -> tuple[int, bool]:
    """How sure it is that an element is noise, by its name and attributes; whether it says that it holds the article."""
    noise, trusted = _HIDDEN if tag == "head" else _NAME if tag in _DROP else _MAYBE if tag == "form" else _KEPT, tag in ("article", "main")
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return noise, trusted
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            words = _noise_words(value)
            if tag in _GIVES:
                words -= _LOOKS
            if words and (tag not in ("html", "body", "main", "article") or tag == "article" and words & {"comment", "comments", "ad", "advert", "related", "promo"}):
                noise = max(noise, _MAYBE if words <= _UNSURE and tag != "article" else _WORD)
        elif name == "role":
            role = value.strip().lower()
            if role in _NOISE_ROLES:
                noise = max(noise, _MAYBE if role == "form" else _NAME)
            trusted |= role in ("main", "article")
        elif name == "itemprop" and value.strip().lower() == "articlebody":
            trusted = True
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return _HIDDEN, False
    return noise, trusted and (noise < _WORD or tag != "article")


def tree(page: str) -> Element:
    """The block elements of a page that are not hidden, with their texts as children in page order."""
    root = here = Element("body", None, _KEPT, False)
    stack: list[tuple[str, Element]] = []  # open elements, inline ones too, with the block element outside each
    opened: dict[str, list[int]] = defaultdict(list)  # their places in the stack by name; "!" marks inline ones that are noise
    blocks: list[int] = []
    text: list[str] = []
    linked = anchors = 0

    def flush() -> None:
        nonlocal linked
        if text and here.noise < _HIDDEN:
            block = " ".join(html.unescape("".join(text)).split())
            if block:
                size, links = len(block), min(linked, len(block))
                if links:
                    block = Linked(block)
                    block.links = links
                here.children.append(block)
                here.direct += (1 + len(_COMMAS.findall(block)) + min(size / 100, 3)) * (1 - links / size) * (size >= 25)
        text.clear()
        linked = 0

    def push(name: str) -> None:
        opened[name].append(len(stack))
        if name in _BLOCK:
            blocks.append(len(stack))
        stack.append((name, here))

    def close(upto: int) -> None:
        nonlocal here, anchors
        while len(stack) > upto:
            name, outer = stack.pop()
            opened[name].pop()
            if name == "a":
                anchors = max(0, anchors - 1)
            if name in _BLOCK:
                blocks.pop()
            if name in _BLOCK or name[-1] == "!":
                flush()
                here = outer

    at, n, end = 0, len(page), page.rfind(">") + 1  # no tag ends after the last ">"
    while (m := _TOKEN.search(page, at, end)) is not None:
        if m.start() > at and here.noise < _HIDDEN:
            text.append(part := page[at : m.start()])
            if anchors:
                linked += len(part)
        at = m.end()
        if at == end and (m[0].startswith("<!--") and not _COMMENT.fullmatch(m[0]) or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>")):
            at = n  # it never ends
        if m[2]:
            tag = m[2].lower()
            if tag in _RAW:
                if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                    stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    at = stop.end() if stop else n
                continue
            if tag in _VOID:
                if tag == "hr":
                    flush()
                elif tag in ("br", "wbr") and here.noise < _HIDDEN:
                    text.append(" " if tag == "br" else "")
                continue
            if tag in _CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
                close(blocks[-1])
            if tag in _CLOSED_BY:
                own, stop = _CLOSED_BY[tag]
                while True:
                    i = max((opened[x][-1] for x in own if opened[x]), default=-1)
                    if i < 0 or any(opened[x] and opened[x][-1] > i for x in stop):
                        break
                    close(i)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
            if tag in ("html", "body"):
                flush()
                continue
            noise, trusted = (_HIDDEN, False) if here.noise == _HIDDEN else _is_noise(tag, m[3])
            if tag in _BLOCK or noise and here.noise < _HIDDEN:
                flush()
                push(tag if tag in _BLOCK else tag + "!")  # an inline element that is noise: a block to drop
                here = Element(tag, here, noise, trusted)
            else:
                push(tag)
                if tag == "a":
                    anchors += 1
        elif m[1]:
            tag = m[1].lower()
            i = max(opened[tag][-1] if opened[tag] else -1, opened[tag + "!"][-1] if opened[tag + "!"] else -1)
            if i >= 0 and (tag in _BLOCK or not blocks or i > blocks[-1]):
                close(i)
            elif tag == "p":
                flush()
            elif tag == "br" and here.noise < _HIDDEN:
                text.append(" ")
    if at < n and here.noise < _HIDDEN:
        rest = re.split(r"<!--|<!\[CDATA\[", page[at:], maxsplit=1)[0]  # what follows never ends
        text.append(rest[: cut] if (cut := rest.rfind("<")) >= 0 and re.match(r"[A-Za-z/!]", rest[cut + 1 : cut + 2]) else rest)
    close(0)
    flush()
    return root


def _texts(e: Element, out: list[str]) -> list[str]:
    todo: list[Element | str] = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.noise:
            todo.extend(reversed(x.children))
    return out


def _inside(root: Element, most: int) -> list[Element]:
    """The element and those inside it that are noise up to ``most``, each before its own."""
    out = [root]
    for e in out:
        out.extend(x for x in e.children if isinstance(x, Element) and x.noise <= most)
    return out


def _spare(root: Element) -> None:
    """Takes the marks of noise from elements that hold the article or most of the page.

    The largest come first. While nothing outside of noise says that it is the article, an element that holds one that
    says so is kept; if it is surely noise, only where no more points are outside of noise. Otherwise an element is kept
    that holds nearly all points, or, by an unsure word or as a form, over half of those that are not surely noise."""
    order = _inside(root, _NAME)
    for e in order:
        e.all = e.likely = e.shown = e.direct
        e.full, e.holds, e.seen = any(isinstance(x, str) for x in e.children), False, False
    for e in reversed(order):
        e.holds |= e.trusted and e.full
        e.seen |= e.trusted and e.full
        if (up := e.parent) is not None:
            up.all += e.all
            up.full |= e.full
            up.holds |= e.holds
            if e.noise <= _MAYBE:
                up.likely += e.likely
            if e.noise == _KEPT:
                up.shown += e.shown
                up.seen |= e.seen
    likely, shown, seen = root.likely, root.shown, root.seen
    heap: list[tuple[float, int, Element]] = []

    def add(e: Element) -> None:
        for x in _inside(e, _KEPT):
            for y in x.children:
                if isinstance(y, Element) and _KEPT < y.noise < _HIDDEN:
                    heapq.heappush(heap, (-y.all, next(numbers), y))

    numbers = itertools.count()
    add(root)
    while heap:
        e = heapq.heappop(heap)[2]
        unsure = e.noise == _MAYBE
        part, whole, share = (e.likely, likely, 0.95 if seen else 0.5) if unsure else (e.all, root.all, 0.95)
        if e.holds and not seen and (unsure or e.all >= shown) or part > share * whole and (unsure or not seen):
            if not unsure:
                likely += e.likely
            shown += e.shown
            seen |= e.seen
            e.noise = _KEPT
            add(e)


def _weigh(root: Element) -> None:
    """Sizes, characters in links and points of all elements that are not noise."""
    order = _inside(root, _KEPT)
    for e in order:
        blocks = [x for x in e.children if isinstance(x, str)]
        e.size, e.links, e.points = sum(map(len, blocks)), sum(getattr(x, "links", 0) for x in blocks), 0.0
    for e in reversed(order):
        up = e.parent
        (up if up is not None and e.tag in _GIVES else e).points += e.direct
        if up is not None:
            up.size += e.size
            up.links += e.links
            up.points += e.points / 2


def main_text(page: str | None) -> str:
    """Blocks of the article, joined by line feeds; empty for null or empty pages and pages without text."""
    if not page:
        return ""
    root = tree(page.replace("\0", ""))
    _spare(root)
    if not (out := _article(root)):  # nothing but what classes, ids and forms mark as noise: they do not count
        marked = [e for e in _inside(root, _NAME) if e.noise in (_MAYBE, _WORD)]
        for e in marked:
            e.noise = _KEPT
        out = _article(root) if marked else out
    return out


def _article(root: Element) -> str:
    _weigh(root)
    todo, best, score = [root], root, -1.0
    while todo:
        e = todo.pop()
        if (got := e.points * (1 - e.density)) > score:
            best, score = e, got
        todo.extend(x for x in reversed(e.children) if isinstance(x, Element) and not x.noise)
    if score <= 0:  # no paragraph at all: an element that says it is the article, else the whole page
        todo = [root]
        while todo:
            e = todo.pop()
            if e.trusted and e.size:
                best = e
                break
            todo.extend(x for x in reversed(e.children) if isinstance(x, Element) and not x.noise)
    e: Element | None = best
    while e is not None:
        if e.trusted:
            return "\n".join(_texts(e, []))
        e = e.parent
    inner, top, e = {id(best)}, best.parent or best, best
    while (up := e.parent) is not None:  # up to the highest element of which more than one child holds prose
        if any(x is not e and _prose(x) for x in up.children):
            top = up
        inner.add(id(up))
        e = up
    out: list[str] = []
    todo: list[Element | str] = [top]
    while todo:
        x = todo.pop()
        if x is best:
            _texts(x, out)
        elif not isinstance(x, str) and id(x) in inner:
            todo.extend(reversed(x.children))
        elif _stays(x):
            if isinstance(x, str):
                out.append(x)
            else:
                _texts(x, out)
    return "\n".join(out)


def _prose(x: Element | str) -> bool:
    """Whether a part of the page holds text of paragraphs, most of it outside of links."""
    if isinstance(x, str):
        return len(x) >= 25 and getattr(x, "links", 0) < 0.5 * len(x)
    if x.noise or x.density >= 0.5:
        return False
    return x.points > 0 or x.tag in _GIVES and x.size >= 25


def _stays(x: Element | str) -> bool:
    """Whether a part beside the container belongs to the article: prose, text without links, and headings, lists, tables
    and the like with few links. What is left out are short parts and lists with links, that is menus."""
    if _prose(x):
        return True
    if isinstance(x, str):
        return not getattr(x, "links", 0)
    return not x.noise and x.size > 0 and (not x.links or x.tag in _HEADINGS or x.tag in _WHOLE and x.density < 0.25)


def extract(df: DataFrame, source: str = "html", to: str = "text") -> DataFrame:
    """df without ``source`` and with ``to``, the main text of its whole markup.

    Null, empty and textless markup gives the empty text, an empty table an empty one. Other columns pass unchanged (one named ``to`` is replaced);
    rows stay in their partitions, so hot hosts and repeated rows need no care. Memory: 2 MB of markup at a time, or one
    page if that is longer."""
    names = [c for c in df.columns if c not in (source, to)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source, 2 << 20):
                texts = pa.array([main_text(p) for p in part.column(source).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), texts], [*names, to])

    ddl = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), f"`{to}` string"])
    return df.select(*names, source).transform(mapped, run, ddl)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).selectExpr("page_id", "url", "text", "cast(length(text) as long) as n_chars")


QUERIES = {"op2_html_text": op2_html_text}
ORACLE_SQL: dict[str, str] = {}

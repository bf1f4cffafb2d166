"""Main-text extraction from flat text blocks.

A page is flattened into its text blocks. Each block is described by its word
count and link density, those of the blocks before and after it, whether it
stands in an article, and how much of the page's text lies outside the element
around it that names itself surroundings: of a side bar nearly all, of a form or
a layout that wraps the page nothing. A decision tree says which blocks are text. It is trained on a small table, measured on labelled pages that
this module builds, some of which name their parts and some of which do not.
Kept blocks are joined in page order.

Defined results: null or empty html gives an empty text; broken markup is read
as far as it goes (unclosed tags close where their parent does, a stray quote
in a tag is ignored, a tag or comment cut off by the end of the page is markup); pages are judged one by one,
so repeated rows stay. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tags that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table"
    " tbody td template textarea tfoot th thead title tr ul".split()
)
#: Tags whose content is never text.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas textarea select option button audio video map datalist".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags of the surroundings, and of the text itself.
AROUND = frozenset("nav aside footer form menu dialog fieldset".split())
TEXT = frozenset("article main".split())
#: Tags and attributes that are believed however much text they hold.
SURE_TAGS = frozenset("nav aside footer menu dialog".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words in class and id that mark surroundings.
AROUND_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adbox adsense banner bar breadcrumb breadcrumbs byline-share comment comments commentary consent cookie cookies"
    " copyright disqus footer footnav form gdpr header hidden login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination"
    " popup promo promoted promotion popular recommended related replies reply respond responses rss search share sharing shoutbox sidebar sidenav signup skip social"
    " sponsor sponsored sponsors subscribe subscription teaser toolbar topbar tracking trending widget widgets".split()
)

# A quote opens a value only behind ``=``; elsewhere, and in a bare value, it is a character like any other.
_ATTRS = r"""(?>=\s*"[^"]*"|=\s*'[^']*'|=\s*[^\s"'>][^\s>]*|[^>])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)({_ATTRS})(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.S)
_WORD = re.compile(r"\S+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    marks: tuple[int, ...]
    within: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _names_around(name: str, in_text: bool) -> bool:
    words = re.findall(r"[a-z]+", name)
    if words and words[0] in ("no", "has", "with", "without"):
        return False
    return any(w in AROUND_WORDS and not (in_text and w == "header") for w in words)


def _marks_around(tag: str, attrs: str, in_text: bool) -> int:
    """Whether an element names itself surroundings: 0 not, 1 it says so, 2 for sure."""
    if tag in SURE_TAGS:
        return 2
    said = int(tag in AROUND or tag == "header" and not in_text)
    if not attrs or tag in ("html", "body", "article", "main"):
        return said
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id") and any(_names_around(x, in_text) for x in value.split()):
            said = 1
        if name == "role" and value in AROUND_ROLES:
            said = max(said, 1 if value in ("form", "search") else 2)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return 2
    return said


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, bool, tuple[int, ...], bool]] = []  # tag, silent, marks, within
    silent = within = False
    marks: tuple[int, ...] = ()  # numbers of the elements around that name themselves surroundings, negative where that is sure
    marked = 0
    anchors = heading = 0
    at, size = 0, len(page)

    def close() -> None:
        nonlocal parts, links
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Block(text, len(_WORD.findall(text)), len(_WORD.findall(html.unescape("".join(links)))), marks, within, bool(heading)))
        parts, links = [], []

    def take(text: str) -> None:
        if not silent and text:
            parts.append(text)
            if anchors:
                links.append(text)

    def pop(to: int) -> None:
        nonlocal silent, marks, within
        del stack[to:]
        silent, marks, within = stack[-1][1:] if stack else (False, (), False)

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            take(page[at:])
            break
        take(page[at : m.start()])
        at = m.end()
        if m[1] is not None:
            take(html.escape(m[1], quote=False))
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:  # an end tag
            if tag == "br":
                take(" ")
            if tag in BLOCKS or tag in SILENT:
                close()
            if tag == "a":
                anchors = max(0, anchors - 1)
                links.append(" ")
            elif re.fullmatch(r"h[1-6]", tag):
                heading = 0
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if stack[i][0] in ("article", "main", "body", "td", "div", "section") and tag not in BLOCKS:
                    break
            continue
        if tag in ("br", "wbr", "img"):
            take(" " if tag == "br" else "")
            continue
        if tag in BLOCKS or tag in SILENT:
            close()
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag not in SILENT:
                take(page[at : end.start() if end else size])
                close()
            at = end.end() if end else size
            continue
        if tag in VOID or m[4].rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag == "p":
            while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "font", "u") and any(s[0] == "p" for s in stack):
                pop(len(stack) - 1)
        elif tag == "body" and any(s[0] == "head" for s in stack):
            pop(next(i for i, s in enumerate(stack) if s[0] == "head"))
        elif tag == "li":
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "li":
                    pop(i)
                    break
                if stack[i][0] in ("ul", "ol", "menu"):
                    break
        if tag == "a":
            anchors = 1
        elif re.fullmatch(r"h[1-6]", tag):
            heading = 1
        silent = silent or tag in SILENT
        if said := _marks_around(tag, m[4], within):
            marked += 1
            marks = (*marks, marked if said == 1 else -marked)
        within = within or tag in TEXT
        if tag not in ("a",) and not re.fullmatch(r"(b|i|em|strong|span|font|u|small|code)", tag) or marks or silent:
            stack.append((tag, silent, marks, within))
    close()
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "around", "within", "page_within", "heading")

#: Starts the text blocks of the labelled pages.
MARK = "\N{PILCROW SIGN}"
#: Sizes in words that the labelled pages go through: sentences, paragraphs, one-word lines.
SIZES = (40, 9, 120, 1, 25, 60, 3, 14, 200, 6, 80, 2, 33, 11, 1, 55)


def labelled_pages() -> list[str]:
    """Small pages of ordinary make-up whose text blocks start with ``MARK``."""
    turn = iter(range(10**6))
    words = lambda n: " ".join(["word"] * n)
    size = lambda: SIZES[next(turn) % len(SIZES)]
    text = lambda n=None, tag="p": f"<{tag}>{MARK}{words(n or size())}</{tag}>"
    other = lambda n, tag="p": f"<{tag}>{words(n)}</{tag}>"
    links = lambda n, w=1, tag="li": "".join(f"<{tag}><a href='/'>{words(w)}</a></{tag}>" for _ in range(n))
    body = lambda n: "".join(text() for _ in range(n))
    page = lambda x: f"<html><head><title>t</title></head><body>{x}</body></html>"
    menu = lambda: f"<nav><ul>{links(5)}</ul></nav>"
    foot = lambda n=8: f"<footer>{words(n)} <a href='/'>word</a></footer>"
    out = []
    for _ in range(3):
        # Marked up: the article is named, and so is most of what surrounds it.
        out.append(page(f"{menu()}<div class='ad'>{words(12)}</div><article>{text(7, 'h1')}{body(7)}</article>{foot()}"))
        out.append(page(f"<header>{other(4, 'h1')}{menu()}</header><main>{text(5, 'h1')}{body(4)}<ul>{text(12, 'li')}<li><a href='/'>{MARK}{words(3)}</a></li>{text(2, 'li')}</ul>{body(3)}</main><aside>{other(30)}{links(4, 3)}</aside><div class='comments'>{other(50)}{other(3)}{other(90)}</div>{foot(30)}"))
        out.append(page(f"<div>{links(6, 2)}</div><article>{text(9, 'h2')}{body(5)}<div class='newsletter'>{other(15)}<form>{other(4)}</form></div>{body(2)}<section class='comments'>{other(70)}{other(12)}</section></article><div>{other(25)}{links(5, 4)}{other(60)}{links(2, 2)}{other(100)}{links(2, 2)}</div>"))
        out.append(page(f"<div>{other(14)}</div><div>{links(3, 2)}</div><article>{text(3)}{body(3)}{text(2)}</article><div>{links(4, 3)}</div><div>{other(45)}{other(5)}</div>"))
        out.append(page(f"{menu()}<main><article>{text(2, 'h2')}{text(8)}<ul>{text(4, 'li')}{text(9, 'li')}</ul>{text(5)}</article></main><div>{other(80)}</div><div>{links(6)}</div>{foot()}"))
        # The text starts with a paragraph right behind links.
        out.append(page(f"{menu()}<article>{text(60)}{text(2)}{body(3)}</article>{foot()}"))
        out.append(page(f"<ol>{links(4, 2)}</ol><main>{text(90)}{body(2)}</main><div>{links(3, 2)}{other(60)}{other(90)}</div>"))
        out.append(page(f"<ul>{links(5, 3)}</ul><div>{text(45)}{text(80)}{text(31)}{text(130)}</div><div>{links(3, 2)}</div>"))
        # The article ends the page, or is all of it.
        out.append(page(f"{menu()}<article>{text(6, 'h1')}{body(5)}</article>"))
        out.append(page(f"<article>{body(2)}{text(3)}</article>{links(2, 2, 'div')}"))
        out.append(page(f"<main>{body(3)}</main>"))
        out.append(page(f"<div>{links(4, 1)}{other(50)}</div><article>{text(10)}{body(2)}</article><div>{other(150)}</div>"))
        # Without a named article: surroundings are named, the text is not.
        out.append(page(f"{menu()}<div>{text(8, 'h1')}{body(4)}{text(10)}</div><form>{other(20)}</form><div>{text(40)}{text(1)}</div>"))
        out.append(page(f"<aside>{links(4, 3)}</aside><div>{text(1, 'h1')}{body(5)}</div>{foot(4)}"))
        out.append(page(f"<ul>{links(4, 3)}</ul><div>{text(12, 'h1')}{body(6)}</div><form>{other(6)}</form>{foot()}"))
        out.append(page(f"<div id='header'>{other(3, 'h1')}{links(5)}</div><div>{text(6, 'h1')}{body(6)}</div><div class='sidebar'>{other(2, 'h3')}{links(6, 3)}{other(20)}</div><div id='comments'>{other(40)}{other(8)}</div><div id='footer'>{other(12)}</div>"))
        # Nothing is named: only sizes, links and neighbours tell.
        for head, tail in ((6, 4), (3, 8)):
            cell = "".join(text(n) for n in (45, 4, 70, 1, 30, 12, 110, 2, 60))
            out.append(page(f"<table><tr><td>{links(head, 1, 'div')}{other(2, 'div')}{links(2, 3, 'div')}</td><td>{text(5, 'h1')}{cell}</td></tr></table><div>{links(tail, 2, 'div')}</div><div>{words(5)} <a href='/'>{words(2)}</a></div>"))
            out.append(page(f"<div>{other(3, 'div')}{links(head, 2, 'div')}</div>{text(6, 'h2')}{text(18)}{text(35)}{text(3)}{text(50)}<div>{other(4, 'h3')}{links(tail, 6, 'div')}</div><div>{other(9, 'div')}{links(2, 1, 'div')}</div>"))
        out.append(page(f"<div>{links(4)}</div>{text(4, 'h1')}{text(30)}{text(22)}<div>{words(3)} <a href='/'>{words(9)}</a></div><div>{words(2)} <a href='/'>{words(12)}</a></div><div>{other(6, 'div')}</div>"))
    out += [page(text(8)), page(text(2)), page(f"{text(3, 'h1')}{text(5)}"), page(f"<article>{text(1)}</article>"), page(f"<div>{links(3)}</div>")]
    # All of a page inside an element that has the name of surroundings, and comments or notices longer than the text.
    wraps = ("<form id='main-form'>{}</form>", "<div class='layout sidebar-left'>{}</div>", "<div id='search-results'>{}</div>", "<section class='commentary'>{}</section>", "<div class='page-header'><fieldset>{}</fieldset></div>")
    out += [p.replace("<body>", "<body>" + w.split("{}")[0]).replace("</body>", w.split("{}")[1] + "</body>") for i, p in enumerate(out) if (w := wraps[i % len(wraps)])]
    for _ in range(3):
        many = "".join(f"<div class='comment'>{other(30)}{other(9)}</div>" for _ in range(12))
        out.append(page(f"{menu()}<div>{text(9, 'h1')}{text(40)}{text(25)}</div><div id='comments'>{many}</div>{foot()}"))
        out.append(page(f"{menu()}<article>{text(30)}{text(12)}</article><div class='comments'>{other(200)}{other(30)}</div>"))
        out.append(page(f"<form id='f'>{menu()}<div>{text(6, 'h1')}{body(3)}</div><div class='newsletter'>{other(14)}</div><div id='comments'>{many}</div></form>"))
    return out


def labelled_table() -> np.ndarray:
    """Features of the labelled pages' blocks, and 1 for text in the last column."""
    rows = []
    for page in labelled_pages():
        found = blocks(page)
        rows += [(*row, float(b.text.startswith(MARK))) for b, row in zip(found, features(found))]
    return np.array(rows)


@dataclass
class Node:
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None
    keep: bool = False


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Node:
    """A classification tree by Gini impurity; ties go to the first feature and the lowest threshold."""
    if depth == 0 or y.min() == y.max() or len(y) < 2 * least:
        return Node(keep=bool(2 * y.sum() > len(y)))
    best: tuple[float, int, float] | None = None
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for at in (values[1:] + values[:-1]) / 2:
            left = x[:, j] <= at
            score = sum(len(s) * (1 - np.mean(s) ** 2 - (1 - np.mean(s)) ** 2) for s in (y[left], y[~left]))
            if min(left.sum(), (~left).sum()) >= least and (best is None or score < best[0] - 1e-12):
                best = (score, j, float(at))
    if best is None:
        return Node(keep=bool(2 * y.sum() > len(y)))
    left = x[:, best[1]] <= best[2]
    return Node(best[1], best[2], grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


@cache
def default_tree() -> Node:
    table = labelled_table()
    return grow(table[:, :-1], table[:, -1], depth=8)


def outside(found: list[Block]) -> list[float]:
    """For each block, the share of unlinked words outside the element around it that names itself surroundings; 0 without one, 1 where it is sure.

    Words of other surroundings do not count as outside. Of several elements
    around a block the one with most outside counts.
    """
    paths: dict[tuple[int, ...], int] = {}  # unlinked words of the blocks with the same marks
    for b in found:
        paths[b.marks] = paths.get(b.marks, 0) + b.words - b.linked

    def share(path: tuple[int, ...]) -> float:
        inside = sum(n for other, n in paths.items() if other[: len(path)] == path)
        out = sum(n for other, n in paths.items() if len(other) < len(path) and path[: len(other)] == other)
        return out / (out + inside) if out else 0.0

    known = {(): 0.0}
    for path in sorted(paths, key=len):
        known[path] = 1.0 if any(m < 0 for m in path) else max((share(path[: i + 1]) for i in range(len(path))), default=0.0)
    return [known[b.marks] for b in found]


def features(found: list[Block]) -> list[tuple[float, ...]]:
    any_within = float(any(b.within for b in found))
    empty = Block("", 0, 0, (), False, False)
    padded = [empty, *found, empty]
    return [(b.words, b.density, p.words, p.density, n.words, n.density, around, float(b.within), any_within, float(b.heading)) for p, b, n, around in zip(padded, found, padded[2:], outside(found))]


def keeps(tree: Node, row: tuple[float, ...]) -> bool:
    while tree.low is not None:
        tree = tree.low if row[tree.feature] <= tree.at else tree.high
    return tree.keep


def main_text(page: str | None, tree: Node | None = None) -> str:
    """Text blocks of a page that the tree keeps, one a line."""
    if not page:
        return ""
    tree = tree or default_tree()
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found)) if keeps(tree, row))


_SCHEMA = "page_id long, url string, text string, n_chars long"
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, main text and its code points for every page."""
    tree = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py(), tree) for p in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_ARROW)

    return pages.select("page_id", "url", "html").mapInArrow(run, _SCHEMA)

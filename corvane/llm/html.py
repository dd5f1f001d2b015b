"""Main text of HTML pages: flat text blocks, described by themselves and their neighbours, classified by a decision tree.

A page is cut into blocks at block-level tags. A block has its word count and link density (share of words inside links), those
of the blocks before and after it, its length against the page's longest plain block, and three marks: named (1: inside a part
that its tag, role, class or id names as a menu, header, footer, sidebar, notice, advert, form or reader comments, a half if only
a part of a compound name does), inside or outside the page's main element where it has one, heading. A part that holds the main
element, or most of a page without one, is no boilerplate whatever its name. The tree is trained on the labelled pages LABELLED
when a worker starts.

Cases: null, empty or blank html: empty text; unclosed, stray or cut off tags and comments, unknown character references: read
as browsers do (what a cut off tag or comment holds is no text); repeated pages: one by one; empty table: empty result; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)", re.S
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
#: Elements whose content is no text of the page.
SILENT = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "math", "object", "canvas", "noframes", "xmp"}
_END = {t: re.compile(rf"</{t}(?:[\s/][^>]*)?(?:>|\Z)", re.I) for t in SILENT}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul caption".split()
)
BOILER_TAGS = set("nav aside footer form menu dialog button select option label fieldset legend search input head".split())
BOILER_MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promos promotion promoted cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login sidebar side widget widgets related recommended recommendations trending popular share sharing "
    "social comment comments reply replies disqus respond nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar header masthead topbar footer foot "
    "copyright legal disclaimer search form contentinfo complementary alertdialog dialog hidden".split()
)
#: Say what a part is for or where it stands; with one of BOILER_MARKS they name boilerplate as that does alone.
_PLAIN = set("list item items posts buttons links box area section wrapper wrap container block inner content site page main global text form".split())
#: "has-sidebar" and the like speak of the layout.
_LAYOUT = {"has", "no", "with", "without", "not"}
#: With one of these, a header is the article's own.
_OF_ARTICLE = set("article post entry story content main title headline".split())
#: How surely a tag is boilerplate: as a compound name or a wrapper may say, as a whole name or a tag says, or out of sight.
WEAK, NAMED, HIDDEN = 1, 2, 3
MAIN_TAGS = {"article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "of_longest", "named", "inside", "outside", "heading")
#: Pages labelled by hand (fixed values), block by block: + main text or - the rest, t text or h heading, words, /linked words,
#: ! named as boilerplate or ? by a part of a name, ~ outside the main element, = inside it.
LABELLED = [
    # pages with a main element
    "-t1/1!~ -t1/1!~ -t2/2!~ -t7!~ +h9= +t9= +t55= +t70/4= +t12= +t130/13= +t4= -t8!~",
    "-t1/1!~ -t1/1!~ -t1/1!~ -t10!~ +h6= +t6= +t1= +t3= +t22= +t1= +t90= +t2= -t11/1!~",
    "-t1/1~ -t2/2~ -t1/1~ -t9~ +h5= +t30= +t40= -t3/3= -t4/4= -t3/3= -t12!= +t45= +t60= -t16!~",
    "-t5!~ -t25!~ +h3= +t300= -t2/2= -t2/2= -t2/2= +t20= +t8= -t80!~ -t30!~",
    "-t3/3!~ -t6~ +h7= +t14= +t60= -h2= -t6/6= -t7/7= -t5/5= -t8/8= -t40!= -t120/9!= -t45!= -t4~",
    "-t1/1!~ +h8= +t40= +t6/6= +t35= +t12/10= +t50= +t25= -t9/9!~ -t9/9!~ -t20~ -t90/8~",
    "-t2/2~ -t2/2~ +h4= +t4= +t5= +t3= +t5= +t9= -t16!~",
    "-t12!~ +h10= +t2= +t1= +t1= +t2= +t6= +t47= +t5= -t7!~",
    "-t1/1!~ +h6= +t18= +t5= +t4= +t6= +t3= +t22= +h3= +t33= +t90= -h2!= -t36!= -t41!= -t30!=",
    "-t1/1~ -t8~ -t70~ +h11= +t150/20= +t24= +t24/10= -t4/4= -t4/4= -t4/4= -t60~ -t3/3~",
    "-t4/4~ -t4/4~ +h2= +t80= +t60= +t7= +t30= -h2= -t9/8= -t11/10= -t8/8= -h3!= -t12!=",
    "-t1/1!~ -t7!~ +h5= +t17= +t1= +t5= +t2= +t200= +t16= +t4= +t6/1= +t11= -t9!~",
    "-t14~ -t5/5~ +h7= +t35= +t3/3= +t40= +t25= +t4/4= +t55= +t32= -t22!~ -t60!~",
    "-t1/1~ +h6= +t8= -t50?= +t44= +t38= +t120?= +t60= -t5?= -t4/4?= -t10~",
    "+h3= +t3= -t4!~", "-t1/1!~ +t15= +t24= +t7= -t3!~", "-t9!~ +h12= +t12= -t9!~", "-t2/2!~ +h4= +t1= +t120= +t1= +t60= +t1= -t18!~ -t70!~",
    # pages without one
    "-t1/1 -t2/2 -t1/1 +h8 +t60 +t70/4 +t30 +t18/2 +t45 -t3/3 -t2/2 -t4",
    "-t3/3 -t2/2 +h5 +t45 +t50 +t2 +t60 +t22/7 +t30 -t12 -t4/4 -t6",
    "-t1/1! -t4/4! +h10 +t10 +t60 +t12 +t40 +h5 +t55 +t11 +t30 -t9! -t25!",
    "-t2/2 -t4 -t2/2 +h6 +t150/30 +t9 +t80 -t3/3 -t4/4 -t10 -t30/20",
    "-t4 -t3 -t5 -t4/4 +h7 +t120 +t6 +t90 -t3 -t6 -t2 -t8/8",
    "+t6 +t7", "+t3", "+t8 +t5 +t9", "+h4 +t12", "+t25 +t60", "+t20000", "+h2 +t9 +t7 +t11", "+t5", "+t7 +t4", "+t2 +t1 +t2", "+t10",
    "-t1/1 -t2/2 +t12 +t9 -t3/3 -t1/1", "-t2/2! -t1/1! +h5 +t8 +t6 -t4!", "-t6! +t14 +t11 -t9!", "-t1/1 -t1/1 +h3 +t10 +t14 -t2/2 -t2/2",
    "-t5 -t2/2 -t4 +h9 +t70 +t65 +t4 +t70 -t12/11 -t9/9 -t12/10 -t5",
    "-t60! -t2/2 +h5 +t40 +t35 +t50 -t80! -t45! -t20!",
    "-t3/3 +t60 +t5 +t5 +t8 +t70 -t10/7 -t25/13 -t2/2",
    "-t7 -t4/4 -t12/1 -t3/3 +h8 +t90/9 +t22 +t18 +t60 -t3 -t5/5 -t16/3 -t4/4",
    "-t1/1 -t6/5 +h4 +t33 +t25/8 +t41 -t2 -t6/6 -t7/7 -t6/6",
    "-t2/2! +t60", "-t1/1 +h4 +t70", "-t3/3~ +t12= +t80=", "-t1/1! -t1/1! +t40", "-t1/1 +t25 -t5/5", "-t1/1~ +h3= +t4= -t2/2~", "-t2/2 -t2/2 +h4 +t50 +t6 +t30 -t4!",
    "+h4= +t60= +t8= +t5= -t30?= -t6?= +t75=", "+t12= +t4/4= +t50= +t3= -t9!=", "-t1/1 -t1/1 -t1/1 -t5 +h6 +t30 +t4 +t55 +t2 +t9 +t33 -t6/6 -t2/2",
    # wrappers whose names may mean boilerplate
    "-t1/1! +t60? +t45? +t8? +t90/4? +t70? -t3/3? -t2/2? -t9!", "-t4/4? -t3/3? -t2? +t80? +t40? +t55? -t5? -t1/1?", "-t2/2 +h6 +t50 +t60 -t12? -t20? -t8? -t5/5?",
    "+h5 +t70 -t10? +t60 +t30? +t45 -t6/6? -t22/9?", "-t3? -t2/2? -t4? +t120? +t100/4? -t2? -t7/7?", "+h7 +t90 +t60 -t15? -t24? -t18? -t40/32?",
]
_SPEC = re.compile(r"([+-])([th])(\d+)(?:/(\d+))?([!?]?)([~=]?)")


def labelled_rows(pages: list[str] = LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and page numbers of the labelled blocks."""
    x, y, at = [], [], []
    for k, page in enumerate(pages):
        found = []
        for label, kind, words, linked, mark, place in _SPEC.findall(page):
            found.append(Block("", int(words), int(linked or 0) / int(words), {"!": NAMED, "?": WEAK}.get(mark, 0), place == "=", kind == "h"))
            y.append(label == "+")
        x += features(found, any(b.main for b in found))
        at += [k] * len(found)
    return np.array(x, float), np.array(y, float), np.array(at)


# ---- decision tree


class Tree:
    """Splits by least weighted Gini impurity; ties go to the earlier feature and the lower threshold."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
        self.answer, self.feature = bool(y.mean() >= 0.5), None
        if depth and 0 < y.sum() < len(y):
            found = self._split(x, y, least)
            if found:
                self.feature, self.cut = found
                low = x[:, self.feature] <= self.cut
                self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)

    @staticmethod
    def _split(x, y, least):
        best, n = None, len(y)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])
            for k in np.flatnonzero(v[1:] > v[:-1]) + 1:
                if k >= least and n - k >= least:
                    a, b = hits[k - 1], hits[-1] - hits[k - 1]
                    score = a * (k - a) / k + b * (n - k - b) / (n - k)
                    if best is None or score < best[0] - 1e-12:
                        best = (score, f, (v[k - 1] + v[k]) / 2)
        return best[1:] if best else None

    def __call__(self, row) -> bool:
        t = self
        while t.feature is not None:
            t = t.low if row[t.feature] <= t.cut else t.high
        return t.answer


_trees: list[Tree] = []


def tree() -> Tree:
    if not _trees:
        _trees.append(Tree(*labelled_rows()[:2]))
    return _trees[0]


# ---- blocks


class Block:
    __slots__ = ("text", "words", "linked", "boiler", "main", "heading")

    def __init__(self, text, words, linked, boiler, main, heading):
        self.text, self.words, self.linked, self.boiler, self.main, self.heading = text, words, linked, boiler, main, heading


class _Tag:
    """What a tag says, whatever stands around it."""

    __slots__ = ("name", "closing", "block", "silent", "void", "boiler", "header", "main")

    def __init__(self, raw: str):
        named = _NAME.match(raw)
        self.name = named[1].lower() if named else ""
        self.closing = raw[1:2] == "/"
        self.block, self.void = self.name in BLOCK, self.name in _VOID
        self.silent = self.name in SILENT and not self.closing and not (self.name in ("svg", "math") and raw.endswith("/>"))
        self.header = self.name == "header"
        self.main = self.name in MAIN_TAGS or ("role" in raw and bool(re.search(r"""role\s*=\s*["']?main\b""", raw)))
        self.boiler = _marked(raw) if self.name not in ("html", "body") else 0
        if self.name in BOILER_TAGS:
            self.boiler = max(self.boiler, NAMED)


def _marked(raw: str) -> int:
    """How surely class, id, role or visibility name boilerplate; 0: not at all."""
    most = 0
    for m in _MARKS.finditer(raw):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id", "role"):
            most = max([most, *map(_named, value.split())])
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return HIDDEN
    return most


def _named(token: str) -> int:
    parts = _WORDS.findall(token)
    marks = BOILER_MARKS.intersection(parts)
    if not marks or parts[0] in _LAYOUT or token == "overflow-hidden" or (marks <= {"header", "share"} and not _OF_ARTICLE.isdisjoint(parts)):
        return 0
    plain = _PLAIN if marks <= {"form"} else _PLAIN | _OF_ARTICLE
    return NAMED if all(p in BOILER_MARKS or p in plain for p in parts) else WEAK


_tag = lru_cache(maxsize=1 << 15)(_Tag)


class _Part:
    """An element that is marked as boilerplate or a main element."""

    __slots__ = ("name", "mark", "main", "around", "words")

    def __init__(self, name: str, mark: int, main: bool, around: tuple):
        self.name, self.mark, self.main, self.around, self.words = name, mark, main, around, 0


def blocks(page: str | None) -> tuple[list[Block], bool]:
    """The page's text blocks in order, and whether it has a main element."""
    page = page or ""
    out: list[Block] = []
    within: list[tuple[_Part, ...]] = []  # for each block, the parts it is in
    open_: list[tuple[str, tuple[_Part, ...]]] = []
    pieces: list[tuple[str, bool]] = []
    parts: tuple[_Part, ...] = ()
    link, heading, at = False, False, 0

    def flush():
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                linked = sum(len(p.split()) for p, a in pieces if a)
                words = text.count(" ") + 1
                out.append(Block(text, words, min(1.0, linked / words), 0, False, heading))
                within.append(parts)
                for p in parts:
                    p.words += words
            pieces.clear()

    def around():
        return open_[-1][1] if open_ else ()

    def say(raw: str):
        if raw:
            pieces.append((html.unescape(raw) if "&" in raw else raw, link))

    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at, raw = m.end(), m[0]
        t = _tag(raw)
        tag, closing, block = t.name, t.closing, t.block
        if not tag or tag in SILENT:  # comment, declaration, or what holds no text
            if t.silent:
                end = _END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            pieces.append((" ", False))
            continue
        if tag == "a":
            link = not closing
            continue
        if not block and closing and not any(t == tag for t, _ in open_):
            continue
        if block:
            flush()
            if open_ and open_[-1][0] == "p":  # a block ends an open paragraph
                open_.pop()
                parts = around()
        if closing:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    if not block and any(t in BLOCK for t, _ in open_[k + 1 :]):
                        break  # an inline element does not end blocks
                    if not block and open_[k][1] != parts:
                        flush()
                    elif not block and (open_[k - 1][1] if k else ()) != parts:
                        flush()
                    del open_[k:]
                    parts = around()
                    break
            if tag in _HEADINGS:
                heading = False
            continue
        if t.void:
            continue
        mark = t.boiler
        if t.header and not any(p.main for p in parts):
            mark = max(mark, NAMED)
        if block or mark:
            if not block:
                flush()
            if tag == "li" and open_ and open_[-1][0] == "li":
                open_.pop()
                parts = around()
            if mark or t.main:
                parts = (*parts, _Part(tag, mark, t.main, parts))
            open_.append((tag, parts))
            if tag in _HEADINGS:
                heading = True
            elif block:
                heading = False
    say(page[at:])
    flush()
    roots, free = _roots(out, within)
    for b, ps in zip(out, within, strict=True):
        b.main = not roots.isdisjoint(ps)
        b.boiler = max([p.mark for p in ps if p not in free], default=0)
    return out, bool(roots)


def _roots(found: list[Block], within: list[tuple[_Part, ...]]) -> tuple[set, set]:
    """The page's main elements (none if they hold little of its plain text), and the parts whose marks don't count."""
    total = sum(b.words for b in found)
    wrapper = lambda p: p.mark < NAMED or (p.mark == NAMED and p.name in ("form", "fieldset"))
    seen = {p: None for ps in within for p in ps}
    mains = [p for p in seen if p.main and all(x.mark < HIDDEN for x in (*p.around, p))]
    # under another's name, such as that of a sidebar, an element must hold most of the page
    fit = [p for p in mains if all(wrapper(x) for x in (*p.around, p))] or [p for p in mains if 2 * p.words > total]
    articles = [p for p in fit if p.name == "article" and not any(x.main and x.name == "article" for x in p.around)]
    most = max(articles, key=lambda p: p.words, default=None)
    if most is not None and 2 * most.words >= sum(p.words for p in articles):
        roots = {most}
    else:
        roots = {p for p in fit if p.name != "article" and not any(x.main and x in fit for x in p.around)} or set(articles)
    held = sum(b.words for b, ps in zip(found, within, strict=True) if not roots.isdisjoint(ps))
    plain = sum(b.words for b, ps in zip(found, within, strict=True) if b.linked < 0.5 and all(wrapper(p) for p in ps))
    if 4 * held < plain:
        roots = set()
    if roots:
        free = {x for r in roots for x in (*r.around, r) if x.mark < HIDDEN}
    else:
        free = {p for p in seen if wrapper(p) and 2 * p.words > total}
    return roots, free


def features(found: list[Block], has_main: bool) -> list[tuple]:
    """FEATURES of each block. Neighbours are the nearest blocks on the same side of the main element's edge."""
    none = Block("", 0, 0.0, 0, False, False)
    longest = max([b.words for b in found if b.boiler < NAMED and b.linked < 0.5], default=1)
    after: list[Block] = []
    last = {True: none, False: none}
    for b in reversed(found):
        after.append(last[b.main])
        last[b.main] = b
    out, last = [], {True: none, False: none}
    for b, n in zip(found, reversed(after), strict=True):
        p, last[b.main] = last[b.main], b
        out.append((b.words, b.linked, p.words, p.linked, n.words, n.linked, min(1.0, b.words / longest), min(b.boiler, NAMED) / NAMED, b.main, has_main and not b.main, b.heading))
    return out


def main_text(page: str | None) -> tuple[str, int, int]:
    """Text, number of blocks, number of blocks kept."""
    found, has_main = blocks(page)
    judge = tree()
    kept = [b.text for b, row in zip(found, features(found, has_main), strict=True) if judge(row)]
    return "\n".join(kept), len(found), len(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept."""

    def run(batches):
        for batch in batches:
            got = [main_text(x.as_py()) for x in batch.column(2)]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")

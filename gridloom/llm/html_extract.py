"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements, and every run of text between block tags, are binary variables, content or
boilerplate; inline markup belongs to the run it stands in, so that a sentence with links
is kept or dropped as a whole (an inline element whose class names speak against content
is a variable of its own).  A variable has a unary potential, a logistic score of its
features (tag, class and id words of its own and of the elements around it, text length,
link share, place), and each parent-child edge a 2 x 2 potential by the child's kind.  The
graph is a tree, so one upward and one downward sweep of sum-product messages give exact
marginals.  Both potentials are trained by gradient ascent on the likelihood of labelled
pages (``training_pages``): the expected counts of the gradient are the same marginals.

Runs whose marginal is at least one half are kept; scripts, styles, forms and comments
hold no text at all.  A block is what lies between block-level tags; line breaks inside a
block are white space.  Elements may be nested as deep as they like: nothing recurses, and
time grows with the length of the page.

Defined cases: null and empty html give the empty text; broken markup never fails (open
elements end with their ancestors, stray end tags are dropped, a paragraph ends where a
block begins, an open head ends where its content must); repeated rows give equal results;
an empty table gives an empty result; very long pages are read whole; other columns, of
any name, are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_WORDS = re.compile(r"[a-z]+")

# Element names as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
SILENT = frozenset("head select button svg math object canvas audio video form".split()) | RAW
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup"}
#: What head can hold; any other start tag ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title html head".split())
#: An element that its next sibling of the same group ends.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = frozenset("table td th ul ol dl body html article section div main aside nav header footer blockquote".split())

# Words of class names, ids and roles that speak for or against content.
GOOD = frozenset("article body content entry main post story text page prose".split())
BAD = frozenset("ad ads advert advertisement alert banner bottom breadcrumb breadcrumbs comment comments consent contact cookie cookies copyright discussion disqus footer form gdpr header legal login logo menu modal nav navbar navigation newsletter notice pagination pager popup privacy promo promoted recommended related reply replies respond rss search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar top topbar warning widget".split())
#: Of these the parts of an article itself have some: "entry-header" is not the page's header.
MILD = frozenset("header top banner".split())
#: A class name with such a word tells of something elsewhere: "has-sidebar", "no-ads".
ABOUT = frozenset("has with no without hide hidden is".split())
#: Elements that hold boilerplate, or content, by their name.
BAD_TAGS = frozenset("nav footer aside menu dialog".split())
GOOD_TAGS = frozenset("article main".split())
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "nav", "header", "footer", "aside", "table", "td", "blockquote", "pre", "figure", "dl", "body", "#text")
FEATURES = ("bias", "long", "linked", "good", "bad", "short", "shallow", "stop", "wide", "in good", "in bad", "in neither", "linked list")
N_FEATURES = len(TAGS) + len(FEATURES)
#: Edge kinds: by the child.
EDGES = ("text", "inline", "block", "section", "article")
#: In training, all pages hang on one root by edges without potential.
ROOT_EDGE = len(EDGES)
SECTIONS = frozenset("nav header footer aside article main section form div".split())


class Page:
    """Variables in page order (a parent comes before its children), a list a property, and
    the pieces of text in page order: block, variable, text."""

    def __init__(self) -> None:
        self.tag, self.parent, self.depth = ["html"], [-1], [0]
        self.good, self.bad, self.kids = [False], [False], [0]
        self.scope = [0]  # 1 inside content by name, -1 inside boilerplate by name
        self.size, self.linked = [0], [0]
        self.pieces: list[tuple[int, int, str]] = []
        self.run: dict[tuple[int, int], int] = {}

    def add(self, tag: str, parent: int, good: bool = False, bad: bool = False) -> int:
        scope = self.scope[parent]
        bad_here = bad or tag in BAD_TAGS or tag == "header" and scope != 1
        if tag != "#text" and scope != -1:
            scope = -1 if bad_here else 1 if good or tag in GOOD_TAGS else scope
        for column, value in ((self.tag, tag), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.good, good), (self.bad, bad), (self.kids, 0), (self.scope, scope), (self.size, 0), (self.linked, 0)):
            column.append(value)
        self.kids[parent] += 1
        return len(self.tag) - 1

    def write(self, parent: int, block: int, text: str, link: bool) -> None:
        """Text joins the run of its block under the same variable."""
        at = self.run.get((parent, block))
        if at is None:
            if not text.strip():
                return
            at = self.run[parent, block] = self.add("#text", parent)
        self.pieces.append((block, at, text))
        n = len(text.strip())
        self.size[at] += n
        self.linked[at] += n * link

    @property
    def text(self) -> list[str]:
        """The text of each variable."""
        out = [""] * len(self.tag)
        for _, at, piece in self.pieces:
            out[at] += piece
        return out

    def total(self) -> None:
        """Sizes of elements from those of their text."""
        size, linked, parent = self.size, self.linked, self.parent
        for i in range(len(parent) - 1, 0, -1):
            size[parent[i]] += size[i]
            linked[parent[i]] += linked[i]


def _named(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether class, id and role speak for and against content."""
    good, bad = False, set()
    for x in _ATTR.findall(attrs):
        for name in "".join(x[1:]).lower().split():
            words = set(_WORDS.findall(name))
            if ABOUT.isdisjoint(words):
                good |= not GOOD.isdisjoint(words)
                bad |= words & BAD
    if tag in ("body", "html"):
        return False, False
    return good and not bad, bool(bad - MILD if good or tag in GOOD_TAGS else bad)


def parse(source: str) -> Page:
    page = Page()
    stack, names, block, at, silent = [0], ["html"], 0, 0, 0
    count: Counter[str] = Counter(names)

    def push(tag: str, variable: int) -> None:
        nonlocal silent
        stack.append(variable)
        names.append(tag)
        count[tag] += 1
        silent += tag in SILENT

    def pop_to(depth: int) -> None:
        nonlocal block, silent
        for t in names[depth:]:
            block += t in BLOCKS
            silent -= t in SILENT
            count[t] -= 1
        del stack[depth:], names[depth:]

    def end(group: frozenset | set) -> None:
        """Ends the nearest open element of a group, within its scope."""
        for d in range(len(names) - 1, 0, -1):
            if names[d] in group:
                return pop_to(d)
            if names[d] in SCOPES:
                return None
        return None

    match, size = _TOKEN.match, len(source)
    while at < size:
        m = match(source, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            if names[-1] == "head" and text.strip():
                pop_to(len(names) - 1)  # text ends a head too
            if not silent:
                page.write(stack[-1], block, entities.unescape(text) if "&" in text else text, count["a"] > 0)
            continue
        tag = m["tag"]
        if tag is None:
            if m["cdata"] and not silent:
                page.write(stack[-1], block, m["cdata"], count["a"] > 0)
            continue
        tag = tag.lower()
        if m["close"]:
            if count[tag]:
                for d in range(len(names) - 1, 0, -1):
                    if names[d] == tag:
                        pop_to(d)
                        break
                    if tag not in BLOCKS and names[d] in BLOCKS:
                        break
            continue
        if tag not in IN_HEAD and count["head"]:
            pop_to(names.index("head"))
        if tag == "br":
            if not silent:
                page.write(stack[-1], block, "\n", False)
            continue
        if tag in ENDS_P and count["p"]:
            end({"p"})
        if tag in SIBLINGS:
            end(SIBLINGS[tag])
        if tag == "a" and count["a"]:
            end({"a"})
        if tag in BLOCKS:
            block += 1
        attrs = m["attrs"]
        if tag in VOID or tag == "html" or attrs.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:  # its text is no markup
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            at = stop.end() if stop else size
            continue
        good, bad = _named(tag, attrs) if "=" in attrs else (False, False)
        own = tag in BLOCKS or bad  # other inline elements belong to what they stand in
        push(tag, page.add(tag, stack[-1], good, bad) if own and not silent else stack[-1])
    page.total()
    return page


def _active(page: Page) -> list[list[int]]:
    """The features of each variable that are 1."""
    last: dict[int, str] = {}
    for _, i, text in page.pieces:
        if t := text.rstrip():
            last[i] = t[-1]
    k, out = len(TAGS), []
    for i, (tag, size, linked) in enumerate(zip(page.tag, page.size, page.linked, strict=True)):
        on, leaf, many = [k], tag == "#text", size > 0 and linked * 2 > size
        if tag in _PLACE:
            on.append(_PLACE[tag])
        scope = page.scope[i]
        for j, holds in enumerate((size >= 100, many, page.good[i], page.bad[i], leaf and size < 40, leaf and page.depth[i] <= 2, leaf and last.get(i, "") in _STOPS, page.kids[i] > 3, scope == 1, scope == -1, scope == 0, many and scope == 0 and page.kids[i] > 1)):
            if holds:
                on.append(k + 1 + j)
        out.append(on)
    return out


def _kind(tag: str) -> int:
    return 0 if tag == "#text" else 4 if tag in GOOD_TAGS else 3 if tag in SECTIONS else 2 if tag in BLOCKS else 1


_PLACE = {t: i for i, t in enumerate(TAGS)}
_STOPS = frozenset(".!?")


def _soft(z: float) -> float:
    """log(1 + exp z)."""
    return z + log1p(exp(-z)) if z > 0 else log1p(exp(z))


@dataclass
class Model:
    weight: np.ndarray  # of the features, for content
    edge: np.ndarray  # kind x parent state x child state, log potentials

    def beliefs(self, active: list[list[int]], kinds: list[int], parent: list[int]) -> tuple[list[float], list[float], list[float]]:
        """Log odds of content at each node; what each has from below; what its parent has
        without it.  Messages are log ratios."""
        w, n = self.weight.tolist(), len(parent)
        below = [sum([w[k] for k in a]) for a in active]
        e = [(x[1][0] - x[0][0], x[1][1] - x[1][0], x[0][1] - x[0][0], x[1][1] - x[0][1]) for x in self.edge.tolist()]
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            p, q, r, _ = e[kinds[i]]
            up[i] = m = p + _soft(q + below[i]) - _soft(r + below[i])
            below[parent[i]] += m
        total, above = below[:], [0.0] * n
        for i in range(1, n):
            p, _, r, t = e[kinds[i]]
            above[i] = c = total[parent[i]] - up[i]
            total[i] += r + _soft(t + c) - _soft(p + c)
        return total, below, above


def training_pages(seed: int = 11, n: int = 240) -> Iterator[str]:
    """Labelled pages: words that begin with c are content, with b boilerplate.  They are
    put together from common page layouts; no table is read."""
    rng = np.random.Generator(np.random.PCG64(seed))
    count = 0

    def sentence(mark: str, lo: int, hi: int) -> str:
        nonlocal count
        out = []
        for _ in range(int(rng.integers(lo, hi))):
            count += 1
            out.append(f"{mark}{count}" + "x" * int(rng.integers(0, 6)))
        return " ".join(out) + ("." if rng.random() < 0.55 else "")

    pick = lambda *x: x[int(rng.integers(0, len(x)))]
    bad = lambda lo=2, hi=14: sentence("b", lo, hi)
    links = lambda: "<ul>" + "".join(f'<li><a href="/{i}">{bad(1, 4)}</a></li>' for i in range(int(rng.integers(2, 8)))) + "</ul>"

    def box() -> str:
        kind = pick("ad", "comments", "sidebar", "cookie-notice", "related", "share", "newsletter", "promo", "breadcrumb", "discussion", "alert")
        inner = pick(f"<p>{bad(3, 40)}</p>", bad(3, 30), f"<h3>{bad(1, 4)}</h3>{links()}", f"<div class='{pick('item', 'reply', 'x')}'><b>{bad(1, 3)}</b><p>{bad(4, 40)}</p></div>", f"<article><h3>{bad(1, 5)}</h3><p>{bad(4, 40)}</p></article>", f"<div><div><p>{bad(4, 60)}</p></div></div>")
        tag = pick("div", "div", "aside", "section", "ul")
        return f'<{tag} {pick("class", "id")}="{kind}">{inner}</{tag}>'

    def nested(x: str) -> str:
        """x in up to several plain containers, now and then in many."""
        for _ in range(pick(0, 0, 0, 0, 1, 1, 2, 3, int(rng.integers(4, 12)))):
            t = pick("div", "div", "section", "div class='row'", "div class='inner'")
            x = f"<{t}>{x}</{t.split()[0]}>"
        return x

    def part(good) -> str:
        linked = f"{good(1, 8)} {pick('', '<b>')}<a href='/l'>{good(1, 4)}</a> {good(1, 30)}"
        cell = lambda: pick(good(1, 4), f"<div><span>{good(1, 6)}</span></div>", f"<p>{good(1, 8)}</p>")
        return nested(pick(
            f"<p>{good()}</p>", f"<p>{good()}</p>", f"<p>{good()}</p>", f"<p>{linked}</p>", linked, f"<p><b>{good(1, 20)}<br><p>{good()}", f"<h2>{good(1, 8)}</h2><p>{good()}</p>", f"<h2>{good(1, 8)}</h2>",
            f"<ul><li>{good(1, 12)}</li><li><a href='/x'>{good(1, 5)}</a></li></ul>", f"<ol><li><p>{good(1, 12)}</p></li><li>{good(1, 12)}</li></ol>", f"<blockquote><p>{good(3, 30)}</p></blockquote>", f"<table><tr><td>{cell()}</td><td>{cell()}</td></tr><tr><td>{cell()}</td><td>{cell()}</td></tr></table>",
            f"<pre>{good(2, 20)}</pre>", f"<figure><figcaption>{good(2, 12)}</figcaption></figure>", f"<dl><dt>{good(1, 3)}</dt><dd>{good(2, 20)}</dd></dl>", f"<p><span><em>{good(1, 5)}</em></span> {good(2, 20)}</p>", f"<p><a href='/y'>{good(1, 6)}</a></p>", good(2, 40),
        ))

    for _ in range(n):
        body = []
        if rng.random() < 0.9:
            body.append(pick(f"<nav>{links()}</nav>", f"<header><a href='/'>{bad(1, 4)}</a>{links()}</header>", f"<div class='menu'>{links()}</div>", f"<header><h1>{bad(1, 4)}</h1><p>{bad(2, 10)}</p></header>", f"<div>{links()}</div>", links()))
        for _ in range(int(rng.integers(0, 3))):
            body.append(box())
        short = rng.random() < 0.4
        good = (lambda lo=1, hi=60: sentence("c", 1, 8)) if short else (lambda lo=1, hi=60: sentence("c", lo, hi))
        shell = pick("article", "article", "article", "main", "div class='content'", "div id='post-body'", "main class='page'", "div", "")
        top = pick(f"<h1>{good(1, 12)}</h1>", f"<header><h1>{good(1, 12)}</h1></header>", f"<div class='entry-header'><h1>{good(1, 12)}</h1></div>", "") if shell and shell != "div" else f"<h1>{good(1, 12)}</h1>"
        parts = [top]
        for _ in range(int(rng.integers(1, 3 if short else 9))):
            parts.append(part(good) if shell and shell != "div" else pick(f"<p>{good()}</p>", f"<p>{good(6, 60)}</p>", f"<h2>{good(1, 8)}</h2>", f"<ul><li>{good(4, 12)}</li><li>{good(4, 12)}</li></ul>", f"<blockquote><p>{good(3, 30)}</p></blockquote>"))
            if rng.random() < 0.15:
                parts.append(box())
        inside = "".join(parts) if rng.random() < 0.7 else nested("".join(parts))
        body.append(f"<{shell}>{inside}</{shell.split()[0]}>" if shell else pick(inside, good()))
        for _ in range(int(rng.integers(0, 3))):
            body.append(box())
        if rng.random() < 0.9:
            body.append(pick(f"<footer>&copy; {bad(2, 20)}</footer>", f"<div class='footer'><p>{bad(2, 20)}</p></div>", f"<footer><nav>{links()}</nav><p>{bad(2, 20)}</p></footer>"))
        whole = "".join(body)
        yield f"<html><head><title>{bad()}</title></head><body>{nested(whole) if rng.random() < 0.5 else whole}</body></html>"


@cache
def trained(rounds: int = 150, rate: float = 0.2, decay: float = 2e-5) -> Model:
    """Maximum likelihood on the labelled pages, by Adam."""
    pages = []
    for source in training_pages():
        page = parse(source)
        y = [int(t.strip()[:1] == "c") for t in page.text]
        for i in range(len(y) - 1, 0, -1):
            if y[i]:
                y[page.parent[i]] = 1  # an element is content if it holds any
        pages.append((page, _active(page), [_kind(t) for t in page.tag], y))
    # all pages as one forest: page roots hang on nothing, so they start as roots of their own
    active, kinds, parent, y = [[]], [0], [-1], [0]
    for page, a, k, labels in pages:
        base = len(parent)
        active += a
        kinds += [ROOT_EDGE, *k[1:]]
        parent += [0, *(base + p for p in page.parent[1:])]
        y += labels
    n = len(parent)
    x = np.zeros((n, N_FEATURES))
    for i, a in enumerate(active):
        x[i, a] = 1
    y, up = np.array(y), np.array(parent[1:])
    kind = np.array(kinds[1:])
    seen = np.zeros((len(EDGES) + 1, 2, 2))
    np.add.at(seen, (kind, y[up], y[1:]), 1)
    model = Model(np.zeros(N_FEATURES), np.zeros((len(EDGES) + 1, 2, 2)))
    m = s = np.zeros(N_FEATURES + model.edge.size)
    for t in range(1, rounds + 1):
        total, below, above = (np.array(v) for v in model.beliefs(active, kinds, parent))
        p = 1 / (1 + np.exp(-np.clip(total, -60, 60)))
        pair = model.edge[kind] + np.stack((np.zeros(n - 1), above[1:]), 1)[:, :, None] + np.stack((np.zeros(n - 1), below[1:]), 1)[:, None, :]
        pair = np.exp(pair - pair.max((1, 2), keepdims=True))
        pair /= pair.sum((1, 2), keepdims=True)
        expected = np.zeros_like(seen)
        np.add.at(expected, kind, pair)
        g_edge = (seen - expected) * (np.arange(len(EDGES) + 1) != ROOT_EDGE)[:, None, None]
        g = np.concatenate((x.T @ (y - p), g_edge.ravel())) / n - decay * np.concatenate((model.weight, model.edge.ravel()))
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        model = Model(model.weight + step[:N_FEATURES], model.edge + step[N_FEATURES:].reshape(model.edge.shape))
    return model


def main_text(source: str, model: Model) -> str:
    page = parse(source)
    odds, _, _ = model.beliefs(_active(page), [_kind(t) for t in page.tag], page.parent)
    blocks: dict[int, list[str]] = {}
    for block, at, text in page.pieces:
        if odds[at] >= 0:
            blocks.setdefault(block, []).append(text)
    lines = (_SPACE.sub(" ", "".join(x)).strip() for x in blocks.values())
    return "\n".join(x for x in lines if x)


def _extract(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [main_text(x.as_py() or "", model) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_extract(trained()), "page_id long, url string, text string, n_chars long")

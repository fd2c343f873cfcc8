"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: What follows the name of a tag: a value may hold ``>`` in quotes; a quote that nothing ends is a character like others.
_ATTRIBUTES = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is no markup, and is not shown.
_RAW = frozenset("script style iframe noframes noembed title textarea".split())
#: Drawings and formulas: inline, all elements within them too; what is not shown of them.
_FOREIGN = frozenset(("svg", "math"))
_UNSHOWN = frozenset("title desc metadata script style defs annotation annotation-xml".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in _RAW | {"xmp"}}
_UNSHOWN_END = {t: re.compile(rf"</(?:{t}|svg|math)(?=[\s/>]|\Z)", re.I | re.A) for t in _UNSHOWN}
_COMMENT_END = re.compile("--!?>")
_VOID = frozenset("area base col embed hr img input link meta param source track wbr br".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label object svg math".split()
)
#: HTML elements that end a formula or drawing left open.
_BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main header footer aside nav form".split())
#: An element of the key ends an open element of the value, as far as it is not within one of the stops.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_IN_HEAD = frozenset("base link meta noscript template".split())
_STOPS = ("ul", "ol", "dl", "table", "select", "body", "html")
#: Elements that count as themselves in the features of a path; all others are one.
_KNOWN = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup html li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Numbers beyond all characters, which ``unescape`` cannot read.
_HUGE = re.compile(r"&#[0-9]{1000,};?")
_BOILER = frozenset("comment advert notice menu header footer side form share".split())

#: What a class, id or role says about an element.
_ROLES = (
    ("comment", r"comments?|commentlist|comment-?\w*|disqus|discussion|respon[sd]\w*|replies|reply"),
    ("advert", r"ads?|adverts?|advertisement|adsense|banner-?ad|sponsor\w*|promo\w*|outbrain|taboola|ad-\w+|\w+-ad"),
    ("notice", r"cookies?\S*|consent\S*|gdpr\S*|notices?|alerts?|popup|modal|overlay|newsletter\S*|subscribe\S*|signup\S*|paywall|warning|announcement|toast|dialog|alertdialog|banner"),
    ("menu", r"nav\S*|menus?|menubar|breadcrumbs?|pagination|pager|tabs?|toolbar|toc|site-?nav|skip-?link|navigation|topbar"),
    ("header", r"(?:site-|page-|top-?)?header|masthead|top|logo|branding|site-title"),
    ("footer", r"(?:site-|page-)?footer|foot|copyright|legal|colophon|contentinfo|bottom"),
    ("side", r"side\S*|aside|widgets?\S*|related\S*|recommended|more-\w+|trending|popular|complementary|rail|author-?(?:box|bio|card)"),
    ("form", r"search\S*|login\S*|form\S*|contact-form"),
    ("share", r"share\S*|sharing|social\S*|follow\S*|buttons?"),
    ("body", r"content|contents|article\S*|post|posts?-?(?:content|body|text)|entry\S*|story\S*|main\S*|page-?content|body|text|prose|single"),
)
_ROLES = tuple((name, re.compile(rf"(?:{p})\Z", re.I)) for name, p in _ROLES)
_OF_TAG = {"nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "dialog": "notice", "noscript": "notice", "article": "body", "main": "body", "button": "form", "select": "form", "fieldset": "form"}


@lru_cache(100_000)
def _element(tag: str, attributes: str) -> tuple[str, str]:
    """The tag and the role of an element."""
    for found in _NAMED.findall(attributes):
        for word in "".join(found).split():
            for name, pattern in _ROLES:
                if pattern.match(word):
                    return tag, name
    return tag, _OF_TAG.get(tag, "")


class Path(NamedTuple):
    """The elements around a block, as far as features tell them: a path of any depth is one of few."""

    tags: frozenset[str] = frozenset()
    roles: frozenset[str] = frozenset()
    inner: str = "none"
    parent: str = ""
    within: bool | None = None

    def inside(self, tag: str, role: str) -> Path:
        """The path of what is in an element in here. ``within``: is there a part of another kind in the main part."""
        tag = tag if tag in _KNOWN else "other"
        within = self.within
        if role == "body":
            within = bool(within)
        elif within is not None and role in _BOILER:
            within = True
        return Path(self.tags | {tag}, self.roles | {role} if role else self.roles, role or self.inner, tag, within)


class _Open:
    """The open elements of a page. All steps take the same time at any depth."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.paths: list[Path] = [Path()]
        self._at: dict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, attributes: str) -> None:
        self._at[tag].append(len(self.tags))
        self.tags.append(tag)
        element = _element if len(attributes) < 1000 else _element.__wrapped__
        self.paths.append(_inside(self.paths[-1], *element(tag, attributes)))

    def last(self, tags: tuple[str, ...]) -> int:
        return max((at[-1] for t in tags if (at := self._at.get(t))), default=-1)

    def close(self, tags: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        """End the innermost of ``tags`` with all in it, unless one of the stops is between."""
        k = self.last(tags)
        if k >= 0 and k >= self.last(stops):
            for t in self.tags[k:]:
                self._at[t].pop()
            del self.tags[k:], self.paths[k + 1 :]


_inside = lru_cache(100_000)(Path.inside)


def blocks(html: str | None) -> list[tuple[Path, str, float]]:
    """The leaf blocks of a page, in order: the elements around it, its text and the part of that in links.

    A block is the text between two places where an element that isn't inline begins or ends. Comments, scripts, styles,
    frames, titles and templates have none; formulas and drawings are inline text without their descriptions. Elements
    left open end with their parents, or as HTML's rules for lists, tables and paragraphs have it; a script, style or
    title left open goes on to the end of the page. A ``<`` that begins no tag is text, and so is the rest of a page
    whose last tag does not end. Every step moves on in the page, so time is in proportion to its length.
    """
    html = html or ""
    out: list[tuple[Path, str, float]] = []
    open_ = _Open()
    text: list[str] = []
    links = anchor = pos = hidden = 0
    foreign, unended = "", set()
    plain = False  # tags end at the next ">", quoted or not, once a tag does not end by its quotes

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(unescape(_HUGE.sub("�", "".join(text))).split())
            if joined and not hidden:
                if open_.tags and open_.tags[-1] == "head":  # text ends the head
                    open_.close(("head",))
                out.append((open_.paths[-1], joined, min(1.0, links / len(joined))))
            text.clear()
        links = 0

    def shown(piece: str) -> None:
        nonlocal links
        text.append(piece)
        links += len(piece) * (anchor > 0)

    while pos < len(html):
        k = html.find("<", pos)
        if k < 0:
            break
        if k > pos:
            shown(html[pos:k])
        pos = k
        if html.startswith("<!--", k):
            if html.startswith(("<!-->", "<!--->"), k):
                pos = html.index(">", k) + 1
                continue
            e = _COMMENT_END.search(html, k + 4)
            pos = e.end() if e else len(html)
            continue
        end = html.startswith("/", k + 1)
        name = _NAME.match(html, k + 1 + end)
        if name is None:
            if end or html.startswith(("!", "?"), k + 1):
                if foreign and html.startswith("<![CDATA[", k):
                    e = html.find("]]>", k)
                    e = len(html) if e < 0 else e
                    shown(html[k + 9 : e].replace("&", "&amp;"))
                    pos = e + 3
                    continue
                e = html.find(">", k)
                if e < 0:
                    break
                pos = e + 1
            else:
                shown("<")
                pos = k + 1
            continue
        m = None if plain else _ATTRIBUTES.match(html, name.end())
        if m is None:
            plain = True
            e = html.find(">", name.end())
            if e < 0:
                break
            pos = e + 1
        else:
            pos = m.end()
        tag, attributes = name[0].lower(), html[name.end() : pos - 1]
        empty = attributes.endswith("/")
        if foreign:
            if tag == foreign and end:
                foreign = ""
            elif not end and not empty and tag in _UNSHOWN:
                e = _UNSHOWN_END[tag].search(html, pos) if tag not in unended else None
                if e:
                    pos = e.start()
                else:
                    unended.add(tag)
            if tag in _FOREIGN or tag not in _BREAKS:
                continue
            foreign = ""  # HTML goes on as if the formula had ended
        if tag in _FOREIGN:
            foreign = "" if end or empty else tag
            continue
        if tag in _INLINE:
            if tag == "a":
                anchor = max(0, anchor + (-1 if end else 1))
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag in _RAW:
            if not end:
                e = _RAW_END[tag].search(html, pos)
                pos = e.start() if e else len(html)
            continue
        flush()
        anchor = 0
        if end:
            open_.close((tag,))
        else:
            if open_.tags and open_.tags[-1] == "head" and tag not in _IN_HEAD:
                open_.close(("head",))
            if tag in _CLOSES:
                open_.close(_CLOSES[tag], _STOPS)
            if open_.last(("p",)) >= max(0, len(open_.tags) - 3):
                open_.close(("p",), _STOPS)
            if tag not in _VOID and not empty:
                open_.push(tag, attributes)
        hidden = open_.last(("template",)) >= 0
        if tag == "xmp" and not end:
            e = _RAW_END["xmp"].search(html, pos)
            e = e.start() if e else len(html)
            shown(html[pos:e].replace("&", "&amp;"))
            pos = e
    if pos < len(html):
        shown(html[pos:])
    flush()
    return out


def path_features(path: Path) -> list[str]:
    return [
        *sorted(f"tag={t}" for t in path.tags), *sorted(f"role={r}" for r in path.roles), f"inner={path.inner}", f"parent={path.parent}",
        f"boiler={not _BOILER.isdisjoint(path.roles)}", f"body={'body' in path.roles}", f"within={path.within}",
    ]


def text_features(text: str, links: float) -> tuple[str, ...]:
    n = text.count(" ") + 1
    return (
        f"words={min(7, n.bit_length())}", f"links={0 if links == 0 else 1 if links < 0.5 else 2}",
        f"end={text[-1] in '.!?…\"”»)'}", f"mark={'©' in text or '@' in text[:40]}",
    )


class Crf:
    """Two labels, 0 and 1 for main text: a weight for each feature, and for each label after another."""

    def __init__(self, weights: dict[str, float], step: np.ndarray, ends: np.ndarray):
        self.weights, self.step, self.ends = weights, step, ends
        self._path: dict[tuple, float] = {}
        self._text: dict[tuple, float] = {}

    def unary(self, block: tuple) -> float:
        path, text, links = block
        a = self._path.get(path)
        if a is None:
            if len(self._path) > 50_000:
                self._path.clear()
            a = self._path[path] = sum(self.weights.get(f, 0.0) for f in path_features(path))
        key = text_features(text, links)
        b = self._text.get(key)
        if b is None:
            b = self._text[key] = sum(self.weights.get(f, 0.0) for f in key)
        return a + b

    def viterbi(self, page: list[tuple]) -> list[int]:
        (s00, s01), (s10, s11) = self.step.tolist()
        x, y = 0.0, 0.0
        back: list[tuple[int, int]] = []
        for k, block in enumerate(page):
            u = self.unary(block)
            if k == 0:
                x, y = self.ends[0, 0], self.ends[0, 1] + u
                continue
            a, b, c, d = x + s00, y + s10, x + s01, y + s11
            back.append((int(b > a), int(d >= c)))
            x, y = max(a, b), max(c, d) + u
        label = int(y + self.ends[1, 1] >= x + self.ends[1, 0])
        labels = [label] * bool(page)
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def fit(pages: list[tuple[list[tuple], list[int]]], steps: int = 250, ridge: float = 2e-4, rate: float = 0.1) -> Crf:
    """Maximum likelihood by Adam; forward and backward sums run over all pages at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    pages.sort(key=lambda p: -len(p[0]))  # so that the pages with a block at any place are the first ones
    at, cols = [], []
    n, longest = len(pages), max((len(p) for p, _ in pages), default=1)
    gold = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for i, (page, labels) in enumerate(pages):
        live[i, : len(page)], gold[i, : len(page)] = True, labels
        for t, (path, text, links) in enumerate(page):
            for f in (*path_features(path), *text_features(text, links)):
                at.append(i * longest + t), cols.append(names.setdefault(f, len(names)))
    at, cols = np.array(at, np.int64), np.array(cols, np.int64)
    last = live.sum(axis=1) - 1
    there = live.sum(axis=0)  # pages with a block at each place
    rows = np.arange(n)
    w, step, ends = np.zeros(len(names)), np.zeros((2, 2)), np.zeros((2, 2))
    theta = [w, step, ends]
    m, v = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    count = max(1, live.sum())
    pair = live[:, 1:] & live[:, :-1]
    one = np.eye(2)[gold] * live[:, :, None]
    seen = np.einsum("nti,ntj,nt->ij", one[:, :-1], one[:, 1:], pair.astype(float))
    for k in range(1, steps + 1):
        u = np.zeros((longest, n, 2))
        u[:, :, 1] = np.bincount(at, w[cols], minlength=n * longest).reshape(n, longest).T
        fwd = np.zeros((longest, n, 2))
        fwd[0] = u[0] + ends[0]
        for t in range(1, longest):
            j = there[t]
            x = fwd[t - 1, :j]
            for y in (0, 1):
                fwd[t, :j, y] = np.logaddexp(x[:, 0] + step[0, y], x[:, 1] + step[1, y]) + u[t, :j, y]
        bwd = np.empty((longest, n, 2))
        bwd[:] = ends[1]
        for t in range(longest - 2, -1, -1):
            j = there[t + 1]
            x = u[t + 1, :j] + bwd[t + 1, :j]
            for y in (0, 1):
                bwd[t, :j, y] = np.logaddexp(step[y, 0] + x[:, 0], step[y, 1] + x[:, 1])
        z = np.logaddexp.reduce(fwd[last, rows] + ends[1], axis=1)
        u, fwd, bwd = (x.transpose(1, 0, 2) for x in (u, fwd, bwd))
        p = np.exp(np.where(live[:, :, None], fwd + bwd - z[:, None, None], -np.inf))
        after = (u + bwd)[:, 1:] - z[:, None, None]
        both = np.array([[np.exp(np.where(pair, fwd[:, :-1, x] + step[x, y] + after[:, :, y], -np.inf)).sum() for y in (0, 1)] for x in (0, 1)])
        miss = (p - one)[:, :, 1].ravel()
        grads = [
            np.bincount(cols, miss[at], minlength=len(names)) / count + ridge * w,
            (both - seen) / count + ridge * step,
            np.stack(((p - one)[:, 0].sum(axis=0), (p - one)[rows, last].sum(axis=0))) / count + ridge * ends,
        ]
        for x, g, a, b in zip(theta, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8)
    return Crf(dict(zip(names, w.tolist(), strict=True)), step, ends)


def extract(html: str | None, model: Crf) -> str:
    """The main text of a whole page: its blocks, joined by one space."""
    page = blocks(html)
    return " ".join(b[1] for b, label in zip(page, model.viterbi(page), strict=True) if label)


def marked_page(html: str | None) -> tuple[list[tuple], list[int]]:
    """A page that labels itself: main text is what an article or main element holds outside all other parts."""
    page = blocks(html)
    return page, [int(not p.tags.isdisjoint(("article", "main")) and _BOILER.isdisjoint(p.roles)) for p, _, _ in page]


def main_text(pages: DataFrame, *, sample: int = 300, made: int = 500, longest: int = 50_000, most_blocks: int = 150) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages (page_id, url, html)``.

    The field is trained on labelled pages: ``made`` pages of ``training_pages``, whose parts are known as they are put
    together in many layouts, and about ``sample`` pages of the table, chosen by a hash of the id, that mark their main
    text as an article themselves; of those, pages of ``longest`` characters or more or with more than ``most_blocks``
    blocks don't train. Then every whole page, however long, is cut into blocks and decoded.

    A null or empty page, or one without main text, gives an empty text with 0 characters. Rows that share an id are
    each extracted. An empty table gives an empty result. Other columns are not read.
    """
    from .training_pages import labelled_pages

    spark = pages.sparkSession
    small_batches(spark, 200)
    n = pages.count()
    part = min(1_000_000, sample * 1_000_000 // max(1, n))
    chosen = pages.filter((F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < part) & F.col("html").rlike("(?i)<(article|main)[ >]") & (F.length("html") < longest))
    own = [marked_page(r["html"]) for r in chosen.select("page_id", "html").sort("page_id", "html").collect()]
    model = fit([*labelled_pages(made), *((p, y) for p, y in own if len(p) <= most_blocks)])
    shared = spark.sparkContext.broadcast((model.weights, model.step, model.ends))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crf = Crf(*shared.value)
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": [extract(h, crf) for h in batch["html"]]})

    out = pages.select("page_id", "url", "html").mapInPandas(decode, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))

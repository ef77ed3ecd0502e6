"""HTML extraction by maximum-scoring subsequence (operator 8).

A page is read as a sequence of words and tags.  Words score positive, tags
negative; the weights of tags and of class names are log-odds of standing
outside the main text, learned from pages whose markup labels it (an ``article``
or ``main`` element), a bounded sample.  Boilerplate (menus, forms, scripts,
adverts, comments ...) scores negative as well, but one stretch of it no more
than GAP_SCORE, so that an advert does not part a text.  One linear scan finds
the contiguous region with the greatest sum.  Where an ``article`` or ``main``
element holds its best part, the region becomes that element.  Boilerplate
inside the region falls out.

An element is boilerplate by its tag, its role, by being hidden, or by a class
or id all of whose parts are known, one of them a sure sign ("comments-section",
"ad-slot", but not "share-price" or "related-work").

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined in page order by one newline.

Edge cases: null, empty and text-free pages give an empty text; unclosed and
stray tags are tolerated, an unclosed script or comment swallows the rest of the
page as a browser does, a quote that no other one closes does not; of several
``article`` elements those stay that the best region covers, at least the one
with most of its words (the first of equals); of several best regions the first
is taken; repeated rows each get a row; null page_id and url pass through; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

#: Bound of the training sample, in pages, and of a page that can be in it, in characters.
TRAIN_PAGES = 400
TRAIN_CHARS = 100_000

# Attributes as HTML reads them: only a value that begins with a quote ends with one.
_ATTR = r"[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/=]|{_ATTR})*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>]*+))?+)?+")

# Element classes of HTML.
RAW = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
BOILERPLATE = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video", "label", "datalist"}
CLOSES_P = BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary", "figcaption"}
# Words that make a class or id a sign of boilerplate, alone or with words that tell what it holds or where it stands.
SURE = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer footers "
    "siteheader pageheader masthead topbar cookie cookies consent gdpr notice notices disclaimer newsletter subscribe subscription signup popup modal overlay comment comments commentlist disqus respond responses replies reply "
    "share sharing social related recommended recommendations pagination pager toolbar widget widgets skiplink copyright legal login signin search searchform hidden visuallyhidden sronly screenreadertext banner banners".split()
)
HOLDS = set(
    "list lists bar box block blocks area section sections wrapper wrap container link links button buttons icon icons form forms panel unit slot item items thread feed message messages dialog inner outer content body "
    "posts articles stories topics reading news media header title group row col column img image text only reader".split()
)
STANDS = set("site page main top bottom left right primary secondary global post article entry blog user side mobile desktop sticky fixed inline js block component visually screen sr google facebook twitter the my".split())
_PART = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+|\d+")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}

WORD_SCORE = 1.0
BAD_WORD_SCORE = -3.0
#: The most that one stretch of boilerplate takes from a region.
GAP_SCORE = -20.0
#: Used for tags that the sample does not show, and without labelled pages.
DEFAULT_WEIGHT = -0.5
DEFAULT_WEIGHTS = {"p": 0.0, "br": 0.0, "b": 0.0, "i": 0.0, "em": 0.0, "strong": 0.0, "h1": 0.0, "h2": 0.0, "h3": 0.0, "blockquote": 0.0, "a": -2.0, "li": -1.5, "ul": -1.5, "nav": -5.0, "footer": -5.0, "div": -1.0, "span": -0.5, "td": -1.0, "tr": -1.0, "table": -2.0}


@lru_cache(maxsize=10_000)
def is_sign(token: str) -> bool:
    """Whether a class or id tells of boilerplate."""
    parts = [x.lower() for x in _PART.findall(token)]
    words = [x for x in parts if not x.isdigit() and x != "x"]
    if not words:
        return False
    return "".join(words) in SURE or (any(w in SURE for w in words) and all(w in SURE or w in HOLDS or w in STANDS for w in words))


def _bad(name: str, attributes: str, inside_main: bool) -> tuple[bool, tuple[str, ...]]:
    """(boilerplate, classes) of an element."""
    bad, classes = name in BOILERPLATE or (name == "header" and not inside_main), ()
    for m in _ATTRIBUTE.finditer(attributes or ""):
        key, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            bad = True
        elif key == "role":
            bad = bad or value.lower() in _ROLES
        elif key in ("class", "id"):
            tokens = tuple(value.split())
            classes += tokens
            if name not in ("html", "body", "article", "main") and any(is_sign(t) for t in tokens):
                bad = True
    return bad, classes


def parse(page: str) -> Iterator[tuple[str, str, bool, int, tuple[str, ...]]]:
    """(kind, value, boilerplate, main, classes): kind is "text", "open" or "close"; main numbers the article or main element (0: none)."""
    stack: list[tuple[str, bool, int]] = []
    at, n, mains = 0, len(page), 0

    def state() -> tuple[bool, int]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, 0)

    def pop_to(name: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return
            # An inline or paragraph end does not close containers around it.
            if name not in BLOCK or name in ("p", "li", "dd", "dt", "td", "th", "tr"):
                if stack[i][0] in ("article", "main", "div", "section", "aside", "nav", "footer", "header", "form", "body", "table", "ul", "ol"):
                    return

    while at < n:
        m = _TOKEN.search(page, at)
        cut = m.start() if m else n
        if cut > at:
            bad, main = state()
            yield "text", page[at:cut], bad, main, ()
        if not m:
            return
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                bad, main = state()
                yield "text", m[0][9:].removesuffix("]]>").replace("&", "&amp;"), bad, main, ()
            continue
        bad, main = state()
        if m[1]:
            if name == "p" and not any(s[0] == "p" for s in stack):
                yield "open", name, bad, main, ()  # a stray end is an empty paragraph
            pop_to(name)
            yield "close", name, bad, main, ()
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(page, at)
            yield "open", name, True, main, ()
            at = n if not end else (page.find(">", end.end()) + 1 or n)
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        if name in ("li", "dd", "dt", "tr", "td", "th", "option"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "menu", "select", "article", "main", "nav") or (name in ("td", "th") and stack[i][0] == "tr"):
                    break
        bad, main = state()
        if name in ("article", "main") and not bad and not main:
            mains += 1
            main = mains
        own, classes = _bad(name, m[3], main > 0)
        bad = bad or own
        yield "open", name, bad, main, classes
        if name not in VOID and not (m[0].endswith("/>") and name not in BLOCK):
            stack.append((name, bad, main))


def learn(pages: Iterable[str | None]) -> dict[str, float]:
    """Weight of each tag and of each class (with a point before it): log-odds of standing inside the labelled main text, at most 0."""
    inside, outside = Counter(), Counter()
    for page in pages:
        marks = [t for t in parse(page or "") if t[0] == "open"]
        if not any(m[3] for m in marks):
            continue
        for _, name, bad, main, classes in marks:
            (inside if main and not bad else outside).update((name, *(f".{c}" for c in classes)))
    weights = dict(DEFAULT_WEIGHTS)
    total_in, total_out = sum(inside.values()), sum(outside.values())
    if total_in and total_out:
        for name in inside.keys() | outside.keys():
            odds = math.log((inside[name] + 0.5) / (total_in + 1)) - math.log((outside[name] + 0.5) / (total_out + 1))
            weights[name] = max(-6.0, min(0.0, odds))
    return weights


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    if not page:
        return ""
    tokens = list(parse(page))
    best = total = gap = 0.0
    lo = hi = since = 0
    for i, (kind, value, bad, _, classes) in enumerate(tokens):
        if kind == "text":
            gain = len(value.split()) * (BAD_WORD_SCORE if bad else WORD_SCORE)
        elif kind == "open":
            gain = weights.get(value, DEFAULT_WEIGHT) + sum(weights.get(f".{c}", 0.0) for c in classes)
        else:
            gain = 0.0
        if bad:
            gain = max(gain, GAP_SCORE - gap)
            gap += gain
        elif kind == "text" and gain:
            gap = 0.0
        total += gain
        if total > best:
            best, lo, hi = total, since, i + 1
        if total <= 0:
            total, since, gap = 0.0, i + 1, 0.0
    if hi == 0:
        # No region scores above zero: all text outside boilerplate.
        lo, hi = 0, len(tokens)
    held: Counter = Counter()
    for kind, value, bad, main, _ in tokens[lo:hi]:
        if kind == "text" and not bad:
            held[main] += len(value.split())
    if held:
        main, _ = max(held.items(), key=lambda x: (x[1], -x[0]))
        if main:
            span = [i for i, t in enumerate(tokens) if t[3] == main]
            # Other labelled elements that the region also covers stay in it.
            lo = span[0] if tokens[lo][3] in (0, main) or lo > span[0] else lo
            hi = max(hi, span[-1] + 1) if tokens[hi - 1][3] not in (0, main) else span[-1] + 1
    blocks: list[str] = []
    now: list[str] = []

    def close() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    for kind, value, bad, _, _ in tokens[lo:hi]:
        if kind == "text":
            if not bad:
                now.append(entities.unescape(value))
        elif value in BLOCK:
            close()
    close()
    return "\n".join(blocks)


def train(pages: DataFrame) -> dict[str, float]:
    """Weights from TRAIN_PAGES pages that label their main text, the ones with the least hash."""
    hashed = F.xxhash64("html").alias("_h")
    labelled = require(pages, "html").filter(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") <= TRAIN_CHARS))
    # Hashes first: no task sends pages that another one's pages displace.
    least = labelled.select(hashed).distinct().orderBy("_h").limit(TRAIN_PAGES).agg(F.max("_h")).first()[0]
    if least is None:
        return learn(())
    sample = labelled.select("html", hashed).filter(F.col("_h") <= least).dropDuplicates(["_h"]).orderBy("_h").select("html").collect()
    return learn(r[0] for r in sample)


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""
    weights = weights or train(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = batch.column(2)
            for lo in range(0, batch.num_rows, 200):
                texts = [extract(p, weights) for p in html.slice(lo, 200).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 200), batch.column(1).slice(lo, 200), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return require(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))

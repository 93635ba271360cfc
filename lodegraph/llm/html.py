"""Main text of HTML pages by a maximum-scoring subsequence.

A page becomes a sequence of words and tags.  Words score positive, tags negative, by weights learned
from labelled pages: those whose markup names the article (article, main) tell how often each tag
stands inside and outside of it.  One linear scan finds the contiguous region of the best score; its
blocks are the text.  Elements that can't be content by their kind or their class (menus, adverts, forms,
notices, comments, scripts) score nothing inside and give no text, so that a region can run over them.

Null or empty html, and pages without content, give an empty text.  Broken markup (unclosed tags and
quotes, cut pages) is read as browsers do: what can't be a tag is text.  Repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

RAW = "script|style|noscript|template|iframe|textarea|title"  # what they hold is no markup
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?![\w:-])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
# Fixed values of HTML: elements without content, elements that do not break a line, elements that p ends before.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
OUT = frozenset("nav footer aside form head dialog menu fieldset audio video applet frameset svg math object canvas select button".split())
#: Words of class, id or role that name what is not the article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup "
    "comment comments respond disqus replies share sharing social related recommended widget pagination pager toolbar search login hidden skip complementary contentinfo".split()
)
HOME = ("article", "main")


class Page(NamedTuple):
    kinds: list[str]  # of each token: a tag's name with / before it at its end, or "" for text
    texts: list[str]
    home: list[bool]  # inside article or main
    out: list[bool]  # inside what can't be content


def excluded(tag: str, attributes: str, inside: bool) -> bool:
    if tag in OUT or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", *HOME[1:]):
        return False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name in ("class", "id", "role") and not HINTS.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def tokens(html: str) -> Page:
    page = Page([], [], [], [])
    stack: list[tuple[str, bool, bool]] = []  # tag, out and home within it
    at, out, home = 0, False, False

    def put(kind: str, text: str) -> None:
        page.kinds.append(kind)
        page.texts.append(text)
        page.home.append(home)
        page.out.append(out)

    for m in TOKEN.finditer(html):
        if m.start() > at:
            put("", html[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            if m[1]:
                put("hr", "")  # what was there breaks a line
            continue
        tag, attributes = tag.lower(), m[4] or m[7] or ""
        if m[2] or m[5]:
            put("/" + tag, "")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in HOME and tag not in ("body", "html", *HOME):
                    break
            _, out, home = stack[-1] if stack else ("", False, False)
            continue
        if tag not in INLINE:
            while stack and (stack[-1][0] == "p" or tag == stack[-1][0] == "li"):
                stack.pop()
            _, out, home = stack[-1] if stack else ("", False, False)
        put(tag, "")
        if tag not in VOID and not attributes.endswith("/"):
            out = out or excluded(tag, attributes, home)
            home = home or tag in HOME
            stack.append((tag, out, home))
    if at < len(html):
        put("", html[at:])
    return page


class Weights(NamedTuple):
    word: float
    tags: dict[str, float]
    other: float = -0.5

    @staticmethod
    def fit(inside: dict[str, int], outside: dict[str, int]) -> Weights:
        """From counts of tags, and of words under "", in and out of the labelled articles: log odds, words held above 0 and tags below."""
        a, b = sum(inside.values()) + 1, sum(outside.values()) + 1
        odds = {k: math.log((inside.get(k, 0) + 1) / a) - math.log((outside.get(k, 0) + 1) / b) for k in {*inside, *outside}}
        return Weights(min(2.0, max(0.3, odds.get("", 1.0))), {k: min(-0.01, max(-8.0, v)) for k, v in odds.items() if k})


def counts(html: str) -> tuple[Counter, Counter]:
    page = tokens(html)
    inside: Counter = Counter()
    outside: Counter = Counter()
    if any(page.home):
        for kind, text, home, out in zip(page.kinds, page.texts, page.home, page.out, strict=True):
            (inside if home and not out else outside)[kind] += len(text.split()) if not kind else 1
    return inside, outside


def extract(html: str, weights: Weights) -> str:
    page = tokens(html)
    labelled = any(h and not o and t.strip() for h, o, t in zip(page.home, page.out, page.texts, strict=True))
    best = score = 0.0
    begin = start = end = 0
    n = len(page.kinds)
    for k in range(n):
        kind = page.kinds[k]
        if labelled and not page.home[k]:
            value = weights.other if not page.texts[k] else -len(page.texts[k].split()) * 4.0
        elif page.out[k]:
            value = 0.0
        elif kind:
            value = weights.tags.get(kind, weights.other)
        else:
            value = weights.word * len(page.texts[k].split())
        if score <= 0 and value > 0:
            score, begin = 0.0, k
        score += value
        if score > best:
            best, start, end = score, begin, k + 1
    blocks: list[str] = []
    current: list[str] = []

    def close() -> None:
        text = " ".join("".join(current).split())
        if text:
            blocks.append(text)
        current.clear()

    for k in range(start, end):
        kind = page.kinds[k]
        if kind:
            if kind.lstrip("/") not in INLINE:
                close()
            elif kind == "br":
                current.append(" ")
        elif not page.out[k]:
            current.append(unescape(page.texts[k]))
    close()
    return "\n".join(blocks)


def fit_weights(pages: DataFrame, sample_rows: int = 500) -> Weights:
    """From about sample_rows pages, chosen by a hash of url and html (a bounded sample of labelled pages)."""
    every = max(1, pages.count() // sample_rows)
    sample = pages.where(F.pmod(F.xxhash64("url", "html"), F.lit(every)) == 0).select(F.coalesce("html", F.lit("")).alias("html"))

    def make():
        def f(columns: list[list]) -> list[list]:
            inside: Counter = Counter()
            outside: Counter = Counter()
            for html in columns[0]:
                a, b = counts(html)
                inside += a
                outside += b
            kinds = sorted({*inside, *outside})
            return [kinds, [inside[k] for k in kinds], [outside[k] for k in kinds]]

        return f

    tags = map_rows(sample, make, "kind string, inside bigint, outside bigint").where(F.length("kind") <= 12)
    got = tags.groupBy("kind").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")).orderBy(F.desc(F.col("a") + F.col("b")), "kind").limit(400).collect()
    return Weights.fit({r["kind"]: r["a"] for r in got}, {r["kind"]: r["b"] for r in got})


def extract_pages(pages: DataFrame, sample_rows: int = 500) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    weights = fit_weights(pages, sample_rows)

    def make():
        def f(columns: list[list]) -> list[list]:
            texts = [extract(h, weights) for h in columns[2]]
            return [columns[0], columns[1], texts, [len(t) for t in texts]]

        return f

    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:2])
    return map_rows(own, make, f"{kinds}, text string, n_chars bigint")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))

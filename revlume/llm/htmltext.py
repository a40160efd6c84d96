"""The main text of web pages: the contiguous region with the greatest sum of scores.

A page is read once as a sequence of words and tags. Words score positive and
tags negative, by what labelled pages say of their kind: a word scores the share
of words of its kind that belong to the article, a tag costs the more the smaller
that share is for its kind. A kind is the block that a word stands in, whether it
is in a link, and whether it is in a part that is named as something else (menu,
footer, advert, form, comments ...), whose words score nothing and which costs as
much as one tag. One linear scan finds the contiguous region of the greatest sum;
its words but for those of such parts, block by block, are the text.

Labelled pages are those whose author marked the article (an ``article`` or
``main`` element): about SAMPLE of them, by a hash, are counted in a Spark
aggregation by kind. Their kinds are counted twice, with and without a look at
the mark, so that pages without one are scored by what the marked ones taught;
pseudo-counts stand for kinds that are rare or never seen.

Nulls and edges: a null or empty page, or one without a word, gives an empty text;
a page that ends in a tag, comment or script ends there; tags that close nothing
are ignored, open ones close with their parent; character references are decoded,
unknown ones stay as they are; a text without any tag is one block; equal pages
and rows with equal ids are rows of their own; among regions of equal sum the
first counts; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages, about, that weights are learned from.
SAMPLE = 4000
#: What a tag costs whose kind never is in an article, and what any tag costs.
TAG_COST, ANY_TAG = 4.0, 0.1
#: Words or tags that a kind's prior share counts for.
PRIOR_COUNT = 20

# Element names and their places in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp".split())
HEAD = frozenset("head title meta link base script style noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("head nav footer aside form script style noscript template textarea title iframe noframes xmp button select option datalist fieldset object svg canvas audio video dialog menu math".split())
KINDS = {"p": "p", "pre": "p", "blockquote": "p", "li": "li", "dd": "li", "dt": "li", "td": "td", "th": "td", "figcaption": "p", "caption": "td"} | {f"h{i}": "h" for i in range(1, 7)}
TAG_KINDS = KINDS | {"ul": "list", "ol": "list", "dl": "list", "table": "table", "tr": "table", "div": "div", "section": "section", "article": "box", "main": "box"}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar tablist".split())
# Words of class names and ids of parts that are not the article.
OTHER_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos promoted promotion banner "
    "nav navbar navi navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars sidenav footer footnav masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay disclaimer copyright "
    "newsletter subscribe subscription signup signin login register paywall share sharing social follow "
    "related recommended recommendations recommendation trending popular teaser teasers "
    "comment comments commentlist disqus respond reply replies discussion pagination pager paging search searchform skip".split()
)
HEADER_WORDS = frozenset("header topheader siteheader pageheader".split())
ARTICLE_WORDS = frozenset("article post entry story content title".split())
STATE_WORDS = frozenset("has with no without is not js open closed enabled disabled layout wrap".split())
# The shares of words and of tags that are the article's, where nothing else is known.
WORD_PRIOR = {"p": 0.9, "h": 0.8, "li": 0.6, "td": 0.6, "div": 0.3, "p+link": 0.8}
TAG_PRIOR = {"p": 0.95, "h": 0.95, "li": 0.8, "td": 0.8, "list": 0.8, "table": 0.6, "div": 0.5, "section": 0.5, "block": 0.5, "box": 0.0, "a/p": 0.95, "inline/p": 0.95, "br/p": 0.95, "inline/h": 0.8, "br/div": 0.8}

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSE = {name: re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.IGNORECASE) for name in RAW}
_MARKED = frozenset(("article", "main"))


def _names_other_part(value: str, own: bool) -> bool:
    """Whether a class attribute or an id names a part that is not the article. Of an article or main element
    (``own``) only a name that is such a word alone counts."""
    for name in value.split():
        words = [w.lower() for w in _NAME_WORD.findall(name)]
        if own:
            words = words if len(words) == 1 else []
        if not words or words[0] in STATE_WORDS or words[-1] in STATE_WORDS:
            continue
        if not OTHER_PARTS.isdisjoint(words):
            return True
        if not HEADER_WORDS.isdisjoint(words) and ARTICLE_WORDS.isdisjoint(words):
            return True
    return False


def other_part(name: str, rest: str, inside: bool) -> bool:
    """Whether an element is a part that is not the article; ``inside``: it stands in a marked article."""
    if name in NEVER or name == "header" and not inside:
        return True
    if "=" not in rest and "hidden" not in rest or name in ("html", "body"):
        return False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            if _names_other_part(value, name in _MARKED):
                return True
        elif key == "role":
            if value.lower() in ROLES:
                return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return False


class Open:
    """An open element, with what holds for all in it."""

    __slots__ = ("name", "other", "within", "marked", "link", "kind")

    def __init__(self, name: str, other: bool, within: bool, marked: bool, link: bool, kind: str):
        self.name, self.other, self.within, self.marked, self.link, self.kind = name, other, within, marked, link, kind


def sequence(page: str) -> Iterator[tuple[str, str, Open]]:
    """The page as ("word", its characters, element) for each stretch of text and ("open" or "close", name, element) for each tag."""
    stack = [Open("", False, False, False, False, "div")]
    open_names: Counter = Counter()

    def pop_to(index: int) -> None:
        for e in stack[index:]:
            open_names[e.name] -= 1
        del stack[index:]

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            yield "word", page[at:], stack[-1]
            return
        if m.start() > at:
            yield "word", page[at : m.start()], stack[-1]
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            inner = stack[-1]
            if open_names[name]:
                i = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name)
                if name in INLINE and any(e.name not in INLINE for e in stack[i + 1 :]):
                    open_names[name] -= 1
                    del stack[i]
                else:
                    pop_to(i)
            # a closing tag belongs to what it leaves, unless that was another part
            yield "close", name, inner if inner.marked == stack[-1].marked else stack[-1]
            continue
        if open_names["head"] and name not in HEAD:
            pop_to(next(i for i, e in enumerate(stack) if e.name == "head"))
        if name not in INLINE and name not in VOID and open_names["p"]:
            i = len(stack) - 1
            while i and stack[i].name in INLINE:
                i -= 1
            if stack[i].name == "p":
                pop_to(i)
        for same, until in (("li", ("ul", "ol", "menu")), ("td", ("tr", "table")), ("th", ("tr", "table")), ("tr", ("table",)), ("dd", ("dl",)), ("dt", ("dl",))):
            if name == same and open_names[same]:
                i = len(stack) - 1
                while i and stack[i].name != same and stack[i].name not in until:
                    i -= 1
                if stack[i].name == same:
                    pop_to(i)
        top = stack[-1]
        other = top.other or other_part(name, m["rest"], top.marked)
        new = Open(name, other, top.other, top.marked or name in _MARKED and not other, top.link or name == "a", KINDS.get(name) or (top.kind if name in INLINE else "div"))
        yield "open", name, top if new.marked != top.marked or name in VOID else new
        if name in VOID or m["rest"].endswith("/") and name not in INLINE and name in NEVER:
            continue
        if name in RAW:
            end = _CLOSE[name].search(page, at)
            stop = end.start() if end else len(page)
            if stop > at:
                yield "word", page[at:stop], new
            at = page.find(">", stop) + 1 or len(page)
            continue
        stack.append(new)
        open_names[name] += 1


def kind_of(what: str, name: str, element: Open, marks: str) -> str | None:
    """The kind of a word or tag; None if it scores nothing. ``marks``: in, out or none, where the author's mark is
    looked at or not."""
    if element.other:
        return None if what != "open" or element.within else f"tag {marks} other"
    if what == "word":
        return f"word {marks} {element.kind}{'+link' if element.link else ''}"
    if name in INLINE or name == "br":
        return f"tag {marks} {name if name in ('a', 'br') else 'inline'}/{element.kind}"
    return f"tag {marks} {TAG_KINDS.get(name, 'block')}"


def counted(page: str) -> Iterator[tuple[str, bool, int]]:
    """kind, whether it is the article's, and number, of all words and tags of a labelled page; nothing of another."""
    items = list(sequence(page))
    if not any(e.marked for _, _, e in items):
        return
    for what, text, e in items:
        number = len(text.split()) if what == "word" else 1
        for marks in ("none", "in" if e.marked else "out"):
            kind = kind_of(what, text, e, marks)
            if kind and number:
                yield kind, e.marked, number


class Weights:
    """Scores of words and tags by kind."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.counts = counts
        self.known: dict[str, float] = {}

    def score(self, kind: str | None) -> float:
        if kind is None:
            return 0.0
        if kind not in self.known:
            what, marks, own = kind.split(" ")
            prior = {"in": 0.95, "out": 0.0}.get(marks, (WORD_PRIOR if what == "word" else TAG_PRIOR).get(own, 0.2))
            mine, number = self.counts.get(kind, (0, 0))
            share = (mine + PRIOR_COUNT * prior) / (number + PRIOR_COUNT)
            # shares of words that can't be told from none are none
            self.known[kind] = round(share, 2) if what == "word" else -(ANY_TAG + TAG_COST * (1 - share))
        return self.known[kind]


def best_region(scores: list[float]) -> tuple[int, int]:
    """The range [start, end) of the greatest sum, the first of equal ones; empty if no score is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(page: str | None, weights: Weights) -> str:
    """The article of a page, its blocks joined by an empty line."""
    items = list(sequence(page or ""))
    marked = any(e.marked for _, _, e in items)
    scores = []
    for what, text, e in items:
        marks = "none" if not marked else "in" if e.marked else "out"
        scores.append(weights.score(kind_of(what, text, e, marks)) * (len(text.split()) if what == "word" and not e.other else 1))
    start, end = best_region(scores)
    blocks, block = [], []
    for what, text, e in items[start:end]:
        if what == "word":
            if not e.other:
                block.append(text)
        elif text == "br":
            block.append(" ")
        elif text not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    decoded = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in decoded if b)


def learn(pages: DataFrame, column: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from about ``sample`` of the pages, those of them that are labelled."""
    rows = pages.count()
    some = pages.select(column) if rows <= sample else pages.where(F.pmod(F.xxhash64(*pages.columns), F.lit(1 << 20)) < int((1 << 20) * sample / rows)).select(column)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch[column]:
                for kind, mine, number in counted(page or ""):
                    seen[kind, mine] += number
        yield pd.DataFrame([(k, n if mine else 0, n) for (k, mine), n in seen.items()], columns=["kind", "mine", "number"])

    # a row for each kind, of which there are fewer than 200
    found = some.mapInPandas(count, "kind string, mine long, number long").groupBy("kind").agg(F.sum("mine").alias("mine"), F.sum("number").alias("number")).collect()
    return Weights({r["kind"]: (r["mine"], r["number"]) for r in found})


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    weights = learn(pages.select("page_id", "url", "html"), sample=sample)

    @F.pandas_udf("string")
    def article(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, weights) for p in pages], dtype=object)

    return pages.select("page_id", "url", article("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))

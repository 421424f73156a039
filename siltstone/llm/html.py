"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page becomes a sequence of words and tags. Words score by their surroundings, tags are negative, both by log odds
learned from pages that mark their article themselves. One scan finds the contiguous region with the largest sum; its
blocks are the text, less what stands in menus, forms, notices, adverts, sidebars and reader comments.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_rows

#: Labelled pages that weights are learned from, at most: those with the smallest hash of their id.
TRAIN_PAGES = 2000
#: Weights are kept within these bounds, so that words stay positive in running text and tags stay negative.
MOST, LEAST = 3.0, 0.05
#: What a word gains inside a marked article: a list or a title in it stays, a menu of links at its end does not.
MARK = 1.0
#: What a word scores where it may not be the article: little, so that a short block of them ends a region.
DOUBT = 0.1

#: Elements by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "noscript", "iframe", "svg", "textarea", "title", "select", "button", "math", "object", "canvas", "head")
#: Elements whose text is not a page's even if they are never closed, and those that hold none of their kind.
CODE, FLAT = frozenset(("script", "style")), frozenset(("select", "button", "textarea", "title"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img br input label".split())
ARTICLE = frozenset(("article", "main"))
BOILER = frozenset(("nav", "aside", "footer", "form", "dialog", "menu"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that announce what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent"
    " disqus footer gdpr masthead menu nav navbar navigation newsletter notice pagination popup promo"
    " replies sidebar signup sponsor sponsored subscribe teaser complementary contentinfo".split()
)
#: Words that are as well names of a layout's parts; text there scores lower, but is not left out for them.
DOUBTFUL = frozenset(
    "alert banner header login modal promoted recommended related reply search share sharing shop skip social toolbar widget".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>=]|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)


def _announced(rest: str) -> tuple[bool, bool]:
    """Whether an element's attributes say that it is not the article or is hidden, and whether they may mean that."""
    doubtful = False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            words = _SPLIT.split(_CAMEL.sub("-", value).lower())
            if not NOT_ARTICLE.isdisjoint(words):
                return True, False
            doubtful = doubtful or not DOUBTFUL.isdisjoint(words)
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _UNSEEN.search(value)):
            return True, False
    return False, doubtful


_CLOSES = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
_OPENS = {tag: re.compile(rf"<{tag}(?=[\s/>])", re.I) for tag in FLAT}
_BODY = re.compile(r"(?=<body\b)", re.I)


def _after(html: str, tag: str, at: int, open_ended: set[str]) -> int:
    """Where reading goes on after an element that opened just before `at` and whose content is no text of the page.

    One that is never closed, or not before the next of its kind opens, has no content, unless it is code.
    `open_ended` collects the kinds that close nowhere in the rest, so that they are looked for once.
    """
    end = None if tag in open_ended else _CLOSES[tag].search(html, at)
    if end is None:
        open_ended.add(tag)
        if tag == "head":
            end = _BODY.search(html, at)
        return end.end() if end else len(html) if tag in CODE else at
    if tag in FLAT and _OPENS[tag].search(html, at, end.start()):
        return at
    return end.end()


def events(html: str):
    """("tag", name, is_close) and ("text", string, where) in page order; where is (kind, in_article).

    kind is boiler, link, doubtful, list, heading or plain. Comments, scripts and the like give nothing.
    """
    stack: list[tuple[str, bool, bool, bool]] = []  # name, not the article, article, doubtful
    boiler = article = doubtful = 0
    link = False
    heading = lists = 0
    at, n = 0, len(html)
    open_ended: set[str] = set()
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        text = m["text"] if m["cdata"] is None else m["cdata"]
        if text is not None:
            kind = "boiler" if boiler else "link" if link else "doubtful" if doubtful else "heading" if heading else "list" if lists else "plain"
            yield "text", text, (kind, article > 0)
            continue
        if m["tag"] is None:
            continue
        tag, rest = m["tag"].lower(), m["rest"]
        if tag in RAW and not m["close"]:
            if not rest.endswith("/"):
                at = _after(html, tag, at, open_ended)
            yield "tag", tag, False
            continue
        if tag == "a":
            link = not m["close"]
        if tag in INLINE:
            yield "tag", tag, bool(m["close"])
            continue
        link = link and tag not in ("p", "div", "ul", "section", "article", "main", "footer")
        if m["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for _, was_boiler, was_article, was_doubtful in stack[i:]:
                        boiler -= was_boiler
                        article -= was_article
                        doubtful -= was_doubtful
                    del stack[i:]
                    break
                if stack[i][0] in ARTICLE and tag not in ARTICLE and tag not in ("body", "html"):
                    break
            heading = 0 if tag in HEADINGS else heading
            lists = max(0, lists - (tag in ("ul", "ol", "dl", "table")))
        elif tag not in VOID and not rest.endswith("/"):
            says, may = (False, False) if tag in ("html", "body") or tag in ARTICLE else _announced(rest)
            bad = tag in BOILER or (tag == "header" and not article) or says
            good = tag in ARTICLE and not bad
            if tag not in ("p", "li", "td", "th", "tr", "dt", "dd", "option") or bad:
                stack.append((tag, bad, good, may))
                boiler += bad
                article += good
                doubtful += may
            heading = 1 if tag in HEADINGS else 0 if tag == "p" else heading
            lists += tag in ("ul", "ol", "dl", "table")
        yield "tag", tag, bool(m["close"])


def default_weights() -> dict[str, float]:
    """Weights where no page marks its article."""
    # What is known not to be the article is left out of the text anyway, so it need not cut a region in two.
    return {"boiler": -LEAST, "link": -1.0, "doubtful": DOUBT, "list": 0.2, "heading": 0.5, "plain": 1.0, "<other>": -0.5, "<inline>": -LEAST}


def count_features(html: str) -> Counter:
    """How often each feature of a labelled page stands (feature, in the article)."""
    out: Counter = Counter()
    inside = 0
    for what, value, more in events(html):
        if what == "text":
            kind, in_article = more
            out[kind, in_article and kind != "boiler"] += len(unescape(value).split())
            inside = in_article
        elif value not in ARTICLE:
            out[_tag_feature(value), bool(inside)] += 1
    return out


def _tag_feature(tag: str) -> str:
    return "<inline>" if tag in INLINE else f"<{tag}>"


def learn(pages: DataFrame, most: int = TRAIN_PAGES) -> dict[str, float]:
    """Log odds of being in the article, from at most `most` pages with an article or main element."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    chosen = marked.select(F.col("page_id").alias("__id")).orderBy(F.xxhash64("__id"), "__id").limit(most).distinct()
    # At most `most` ids: small at any size of the input, and no page moves.
    sample = marked.join(F.broadcast(chosen), F.col("page_id") == F.col("__id"), "left_semi").select("html")

    def make():
        def each(cols):
            total: Counter = Counter()
            for html in cols["html"]:
                total += count_features(html)
            keys = list(total)
            return {"feature": [k for k, _ in keys], "inside": [i for _, i in keys], "n": [total[k] for k in keys]}

        return each

    counted = map_rows(sample, "feature string, inside boolean, n long", make)
    sums: dict[str, list[int]] = {}
    for row in counted.groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect():
        sums.setdefault(row.feature, [0, 0])[row.inside] = row.n
    weights = default_weights()
    if not sums:
        return weights
    for feature, (out, inside) in sums.items():
        odds = log((inside + 1) / (out + 1))
        if feature.startswith("<"):
            weights[feature] = -min(MOST, max(LEAST, LEAST - odds))
        elif feature in ("boiler", "doubtful"):
            continue
        elif feature in ("plain", "heading"):
            weights[feature] = min(MOST, max(LEAST, odds))
        else:
            weights[feature] = min(MOST, max(-MOST, odds))
    return weights


def best_region(tags: list[float], words: list[float]) -> tuple[int, int]:
    """The contiguous blocks (start, end) with the largest positive sum of their words' scores and of those of the tags
    between them; tags[i], 0 or less, stand before block i. (0, 0) if no sum is positive."""
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, (before, score) in enumerate(zip(tags, words, strict=True)):
        total += before
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    return region


def extract(html: str | None, weights: dict[str, float]) -> str:
    """The article's blocks, one a line; empty if there is none."""
    if not html:
        return ""
    blocks: list[tuple[str, float, bool, int]] = []  # text, score of its words, in the article, words that gain by its mark
    scores: list[float] = []  # of the tags before each block
    parts: list[tuple[str, str]] = []
    tags, other = 0.0, weights["<other>"]
    marked = False
    flags: list[bool] = []
    inside = False

    def flush():
        nonlocal tags, parts
        by_kind: dict[bool, list[str]] = {True: [], False: []}
        score, n, sure = 0.0, 0, 0
        for kind, piece in parts:
            count = len(piece.split())
            score += weights[kind] * count
            n += count
            sure += count * (kind not in ("boiler", "doubtful"))
            by_kind[kind != "boiler"].append(piece)
        text = " ".join("".join(by_kind[True]).split())
        if n:
            blocks.append((text, score, inside, sure))
            scores.append(tags)
            tags = 0.0
        parts = []

    for what, value, more in events(html):
        if what == "text":
            kind, in_article = more
            if in_article != inside and value.strip():
                flush()
            if value.strip():
                inside = in_article
            marked = marked or in_article
            parts.append((kind, unescape(value)))
        elif value in INLINE:
            if value == "br":
                parts.append((parts[-1][0] if parts else "plain", " "))
            tags += weights["<inline>"]
        elif value in RAW and value not in ("head", "title"):
            tags += weights.get(f"<{value}>", other)  # stands inside a block and does not end it
        else:
            flush()
            tags += weights.get(f"<{value}>", other)
    flush()
    # On a page that marks its article the mark weighs in: words outside count against a region, words inside for it.
    if marked:
        words = [score + MARK * sure if a else -MOST * max(1, len(t.split())) for t, score, a, sure in blocks]
    else:
        words = [score for _, score, _, _ in blocks]
    region = best_region(scores, words)
    # A region may reach over what stands between two marked articles.
    return "\n".join(t for t, _, a, _ in blocks[slice(*region)] if t and (a or not marked))


def main_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars (code points).

    A null or empty html, and a page without an article, give an empty text. Pages cut off anywhere give what stands
    before the cut; pages of any length are read whole in one pass. Repeated rows give equal rows; other columns are
    ignored; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(weights or learn(pages))

    def make():
        known = shared.value

        def each(cols):
            texts = [extract(h, known) for h in cols["html"]]
            return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return each

    return map_rows(pages.select("page_id", "url", "html"), "page_id long, url string, text string, n_chars long", make)

"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a sequence of words and tags.  Words score positive, tags negative, and
one linear scan finds the contiguous region with the largest sum: the article, where
words are dense and tags are few.

Weights come from labelled pages: pages that mark their article themselves (``article`` or
``main``) label each word and tag as inside or outside.  The counts of all such pages are
summed per tag name by a grouped aggregation (a few hundred rows at any input size), and
a weight is the log-odds of inside against outside, smoothed by a prior per kind of tag.

Parts that are never article text are left out before the scan and cost nothing, so a region
may continue behind them: scripts, styles, menus, page headers, footers, sidebars, forms, and
elements whose class, id or role names a notice, an advert, comments or the like.

Defined cases: a null, empty or text-free page has the empty text; cut-off markup at the end
is dropped; a part without closing tag ends with the element around it, else where the article
begins, else with the page; of a part that holds an article (``article``, ``main`` or ``h1``) only
what precedes and follows the article is left out;
repeated rows and null ids or urls pass through row by row; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only

RAW = "script|style|textarea|title|noscript|iframe|template|noembed|noframes|xmp|svg|math"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\b[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-z][^\s/>]*)[^>]*>"
    r"|</?[a-z][^>]*\Z|</[^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)

BARRIER = frozenset("article main".split())
NOISE = frozenset("nav footer aside form button select option datalist dialog menu audio video canvas object head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 br blockquote pre ul ol li dl dt dd table thead tbody tr td th caption figure "
                    "figcaption hr".split()) | INLINE
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments "
    "disqus reply replies respond related recommended share sharing social newsletter subscribe subscription signup "
    "popup modal overlay pagination pager toolbar widget".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NEVER_NOISE = frozenset("html body main".split())
#: A next one of these ends the one before it.
SIBLING = frozenset("p li dt dd tr td th option".split())
#: Of these, a heading is kept without what follows it.
HEADING_ONLY = frozenset("header nav footer aside".split())

#: Prior counts (inside, outside) and the least cost of a tag, by kind of tag.
PRIOR = {"content": (50.0, 1.0, 0.01), "other": (5.0, 5.0, 0.5)}
BARRIER_COST = 1e6
WORD_RANGE = (1.0, 3.0)
COUNTS = "name string, inside long, outside long"
WORD = "#word"
KNOWN_NAMES = frozenset("html body div section article main header center details summary address".split()) | CONTENT | NOISE | VOID


def _is_noise(name: str, attrs: str, in_article: bool) -> bool:
    if name in NOISE or name == "header" and not in_article:
        return True
    if name in NEVER_NOISE or not attrs:
        return False
    for key, value in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            parts = set(re.split(r"[\s_\-]+", value))
            if parts & NOISE_NAMES and not (name == "article" and not parts & {"comment", "comments", "reply", "replies"}):
                if not (in_article and parts & NOISE_NAMES == {"header"}):
                    return True
        elif key == "role" and value in NOISE_ROLES:
            return True
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def events(page: str) -> list[tuple[str, bool, str]]:
    """``(name, closing, attributes)`` of each tag and ``("", False, text)`` of each text."""
    out, at = [], 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            out.append(("", False, page[at:m.start()]))
        at = m.end()
        if name := m["name"] or m["name2"]:
            out.append((name.lower(), bool(m["close"] or m["close2"]), m["attrs"] or ""))
    if at < len(page):
        out.append(("", False, page[at:]))
    return out


def _ends(found: list[tuple[str, bool, str]]) -> dict[int, int]:
    """For each element that ends, by its first event: the event behind it.  An element without
    closing tag ends where the one around it does; no closing tag reaches out of an article."""
    ends: dict[int, int] = {}
    scopes: list[tuple[list[int], Counter]] = [([], Counter())]  # open elements, by the article around them
    barriers: Counter = Counter()

    def close(upto: int) -> str:
        stack, names = scopes[-1]
        i = stack.pop()
        names[found[i][0]] -= 1
        ends[i] = upto
        return found[i][0]

    for i, (name, closing, _) in enumerate(found):
        if not name or name in VOID:
            continue
        stack, names = scopes[-1]
        if name in BARRIER:
            if not closing:
                scopes.append(([i], Counter([name])))
                barriers[name] += 1
            elif barriers[name]:
                while found[scopes[-1][0][0]][0] != name:
                    barriers[found[scopes[-1][0][0]][0]] -= 1
                    while scopes[-1][0]:
                        close(i)
                    scopes.pop()
                while len(scopes[-1][0]) > 1:
                    close(i)
                close(i + 1)
                scopes.pop()
                barriers[name] -= 1
        elif not closing:
            if stack and found[stack[-1]][0] == name and name in SIBLING or name == "body" and names["head"]:
                while close(i) != ("head" if name == "body" else name):
                    pass
            stack.append(i)
            names[name] += 1
        elif names[name]:
            while found[stack[-1]][0] != name:
                close(i)
            close(i + 1)
    return ends


def without_noise(found: list[tuple[str, bool, str]]) -> list[tuple[str, bool, str]]:
    """The events outside of parts that are never article text; ``"|"`` stands for a part.
    Of a part that holds an article, only what precedes and follows the article goes."""
    ends = _ends(found)
    articles = [j for j, (name, closing, rest) in enumerate(found)
                if name in BARRIER and not closing and not _is_noise(name, rest, False)]
    heads = [j for j, (name, closing, _) in enumerate(found) if name == "h1" and not closing]

    def core(i: int, stop: int) -> tuple[int, int]:
        """First and past-the-last event of the articles, or else of the text from a heading on."""
        first, last = bisect_right(articles, i), bisect_left(articles, stop) - 1
        if first <= last:
            return articles[first], max(ends.get(articles[first], stop), ends.get(articles[last], stop))
        at = bisect_right(heads, i)
        if at < len(heads) and heads[at] < stop:
            return heads[at], ends.get(heads[at], stop) if found[i][0] in HEADING_ONLY else stop
        return stop, stop

    out, i, depth = [], 0, 0
    cuts: list[tuple[int, int]] = []  # from where on, to where what follows an article goes
    while i < len(found):
        if cuts and i >= cuts[-1][0]:
            i = max(i, cuts.pop()[1])
            out.append(("|", False, ""))
            continue
        name, closing, rest = found[i]
        if name in BARRIER:
            depth = max(0, depth + (-1 if closing else 1))
        if name and not closing and _is_noise(name, rest, depth > (name in BARRIER)):
            if name in VOID:
                i += 1
                continue
            if name in BARRIER:
                depth -= 1
            if name not in INLINE:
                out.append(("|", False, ""))
            if i in ends:
                begin, end = core(i, ends[i])
                if end < ends[i]:
                    cuts.append((end, ends[i]))
            else:
                begin = min([at[k] for at in (articles, heads) if (k := bisect_right(at, i)) < len(at)], default=len(found))
            i = begin
            continue
        if not (closing and name in NOISE):
            out.append(found[i])
        i += 1
    return out


def _known(name: str) -> str:
    return name if name in KNOWN_NAMES else "other"


def _count_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for page in batch.column("html"):
            found = without_noise(events(page.as_py() or ""))
            if not any(name in BARRIER for name, _, _ in found):
                continue
            depth = 0
            for name, closing, rest in found:
                if not name:
                    counts[WORD][0 if depth else 1] += len(rest.split())
                elif name in BARRIER:
                    depth = max(0, depth + (-1 if closing else 1))
                elif name != "|":
                    counts[_known(name)][0 if depth else 1] += 1
    names = sorted(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), *(pa.array([counts[n][k] for n in names], pa.int64()) for k in (0, 1))],
        names=["name", "inside", "outside"])


def learn_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Score of a word (``#word``, positive) and of each known tag name (negative)."""
    counted = (only(pages, html=html_col).mapInArrow(_count_labelled, COUNTS)
               .groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")))
    seen = {r["name"]: (r["inside"], r["outside"]) for r in counted.collect()}  # at most the known names
    weights = {}
    for name in KNOWN_NAMES | {"other"}:
        inside, outside = seen.get(name, (0, 0))
        prior_in, prior_out, least = PRIOR["content" if name in CONTENT else "other"]
        weights[name] = -max(least, -math.log((inside + prior_in) / (outside + prior_out)))
    inside, outside = seen.get(WORD, (0, 0))
    weights[WORD] = min(max(math.log((inside + 1) / (outside + 1)), WORD_RANGE[0]), WORD_RANGE[1])
    return weights | {name: -BARRIER_COST for name in BARRIER}


def best_region(kept: list[tuple[str, bool, str]], weights: dict[str, float]) -> tuple[int, int]:
    """First and past-the-last event of the contiguous region with the largest score."""
    best, best_at, score, begin = 0.0, (0, 0), 0.0, 0
    for i, (name, _, rest) in enumerate(kept):
        if not name:
            score += weights[WORD] * len(rest.split())
            if score > best:
                best, best_at = score, (begin, i + 1)
        elif name != "|":
            score += weights.get(name, weights["other"])
        if score <= 0:
            score, begin = 0.0, i + 1
    return best_at


def main_text(page: str, weights: dict[str, float]) -> str:
    kept = without_noise(events(page))
    first, last = best_region(kept, weights)
    blocks: list[list[str]] = [[]]
    for name, _, rest in kept[first:last]:
        if not name:
            blocks[-1].append(html.unescape(rest))
        elif name not in INLINE and blocks[-1]:
            blocks.append([])
    return " ".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def _extractor(weights: dict[str, float]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", weights) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])
    return extract


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      weights: dict[str, float] | None = None) -> DataFrame:
    """Rows ``(id, url, text, n_chars)``, one per input row; ``weights`` of ``learn_weights``
    over another table may be given, else they are learned from this one."""
    if weights is None:
        weights = learn_weights(pages, html_col)
    rows = only(pages, id=id_col, url=url_col, html=html_col)
    kinds = dict(rows.dtypes)
    return (rows.mapInArrow(_extractor(weights), f"id {kinds['id']}, url string, text string, n_chars long")
            .withColumnRenamed("id", id_col))

"""HTML article extraction (H1-H3) and the news path.

Extraction is the one place raw HTML is parsed, so it runs as an
``mapInArrow`` with the standard-library ``html.parser`` (no third-party HTML
library is installed); a worker holds one input batch and at most about
``PIECE`` characters of output, whatever the pages repeat.  Tree building follows the lenient
rules of that parser: unclosed tags stay open (so a paragraph left open
contains the following ones and its text repeats them), an end tag closes
the most recent open element of that name, void elements have no children,
character references are decoded.

Everything around it is native: feed dedup, recency and per-feed caps run
*before* the UDF (Catalyst does not push filters on computed columns below
a Python UDF), and relevance, scoring and ranking run after it.
"""

from __future__ import annotations

from html.parser import HTMLParser
from typing import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import vocab
from ..functions import mentions as M
from ..functions import text as T
from ..session import written_table
from ..sources.tables import read_feed_xml
from . import fetch as FE
from .parallel import missing_splits
from .reduction import may_match

REMOVED = {"script", "style", "nav", "footer", "header", "aside"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr", "keygen", "command", "basefont", "frame", "spacer", "menuitem"}
# main-content selectors in priority order: ("tag", name) or ("class", name)
MAIN_SELECTORS = [("tag", "article"), ("class", "article-content"), ("class", "post-content"),
                  ("class", "entry-content"), ("class", "content"), ("tag", "main"),
                  ("class", "main-content")]
MIN_PARAGRAPH = 50

#: Characters of extracted text after which a worker passes on what it has.
PIECE = 1 << 21


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def classes(self):
        return (self.attrs.get("class") or "").split()

    def iter(self):
        """Descendant elements in document order (excluding self)."""
        stack = list(reversed([c for c in self.children if isinstance(c, _Node)]))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed([c for c in n.children if isinstance(c, _Node)]))

    def text(self) -> str:
        """Concatenated stripped text fragments (no separator)."""
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                s = n.strip()
                if s:
                    out.append(s)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)

    def build(self, html: str) -> _Node:
        self.reset()
        self.root = _Node("[document]", {}, None)
        self.cur = self.root
        self.feed(html)
        self.close()
        return self.root

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: (v or "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        if tag not in VOID:
            self.cur = node

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(_Node(tag, {k: (v or "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def _drop(root: _Node, tags: set[str]) -> None:
    stack = [root]
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if not (isinstance(c, _Node) and c.tag in tags)]
        stack.extend(c for c in n.children if isinstance(c, _Node))


def _summary(text: str, n: int = 3) -> str:
    import re
    s = ". ".join(re.split(r"[.!?]+", text)[:n]).strip()
    if s and not s.endswith("."):
        s += "."
    return s


def extract_content(builder: _TreeBuilder, html: str | None) -> tuple[str, str, str, str | None]:
    """(title, text, summary, error) of one page; a page that can't be parsed gives empty strings
    and the error's text."""
    try:
        root = builder.build(html or "")
        _drop(root, REMOVED)
        nodes = list(root.iter())
        main = None
        for kind, name in MAIN_SELECTORS:
            for n in nodes:
                if (n.tag == name) if kind == "tag" else (name in n.classes()):
                    main = n
                    break
            if main is not None:
                break
        if main is None:
            main = next((n for n in nodes if n.tag == "body"), None)
        if main is None:
            return "", "", "", None
        title = ""
        heads = [n for n in nodes if n.tag in ("h1", "h2")]
        if heads:
            title = heads[0].text()
        if not title:
            t = next((n for n in nodes if n.tag == "title"), None)
            if t is not None:
                title = t.text()
        parts = []
        for n in main.iter():
            if n.tag in ("p", "div"):
                s = n.text()
                if len(s) > MIN_PARAGRAPH:
                    parts.append(s)
        full = "\n".join(parts)
        return title, full, _summary(full), None
    except Exception as e:  # noqa: BLE001 - reported in the row
        return "", "", "", f"{type(e).__name__}: {e}"


def _extractor(names: Sequence[str]):
    """Over batches of kept columns and the html: the kept columns and what was extracted, named ``names``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = _TreeBuilder()  # one parser per task, reused for every row

        def piece(kept: list[pa.Array], begin: int, res: list[tuple]) -> pa.RecordBatch:
            new = [pa.array(column, pa.string()) for column in zip(*res)]
            return pa.RecordBatch.from_arrays([*(c.slice(begin, len(res)) for c in kept), *new], names=list(names))

        for batch in batches:
            *kept, html = batch.columns
            res, begin, size = [], 0, 0
            for h in html:
                res.append(extract_content(builder, h.as_py()))
                size += sum(map(len, res[-1][:3]))
                if size >= PIECE:
                    yield piece(kept, begin, res)
                    res, begin, size = [], begin + len(res), 0
            if res:
                yield piece(kept, begin, res)
    return run


def extract_articles(pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url")
                     ) -> DataFrame:
    """H1-H3: ``keep`` columns + ``title, text, summary`` (strings, never null) + ``extract_error``
    (null for a parsed page), by which unparsed pages can be split off."""
    keep = list(keep)
    schema = (pages.select(*keep).schema.add("title", StringType()).add("text", StringType())
              .add("summary", StringType()).add("extract_error", StringType()))
    return pages.select(*keep, html_col).mapInArrow(_extractor(schema.names), schema)


# --- feeds and the news path ----------------------------------------------------------

def feed_entries(entries: DataFrame) -> DataFrame:
    """Id falls back to the link; published falls back to the landing
    time column when present; domain of the feed (netloc)."""
    pub = F.col("published_at")
    if "landed_at" in entries.columns:
        pub = F.coalesce(pub, F.col("landed_at"))
    return entries.select(
        F.coalesce(F.col("guid"), F.col("link"), F.lit("")).alias("id"),
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("summary"), F.lit("")).alias("summary"),
        F.coalesce(F.col("link"), F.lit("")).alias("link"),
        pub.alias("published_at"),
        F.col("source_feed"),
        T.url_host("source_feed").alias("source_domain"),
        F.col("position"),
    )


#: Elements of an RSS item; the publication time is an ISO string.
FEED_ITEM = "guid string, title string, description string, link string, pubDate string, source string, position int"


def landed_feed(spark, path: str) -> DataFrame:
    """Raw RSS documents (one row per item) as entries for ``feed_entries``; a publication
    time that can't be parsed is null (T13)."""
    raw = read_feed_xml(spark, path, FEED_ITEM)
    return raw.select("guid", "title", F.col("description").alias("summary"), "link",
                      T.parse_iso_timestamp("pubDate").alias("published_at"), F.col("source").alias("source_feed"), "position")


def linked_pages(pages: DataFrame, entries: DataFrame, page_url: str = "url", page_html: str = "html") -> DataFrame:
    """``(link, html)`` of the pages that entries link to, and of a few others (``reduction.may_match``): the
    html of other pages stays in the scan, however many entries there are."""
    pg = pages.select(F.col(page_url).alias("link"), F.col(page_html).alias("html"))
    hits = may_match(pg, entries.select("link"), "link")
    splits = missing_splits(pages)
    return hits.repartition(splits) if splits else hits


def news_articles(entries: DataFrame, pages: DataFrame, as_of, hours_back: int = 24,
                  per_feed: int | None = None, keywords: Sequence[str] = vocab.CRYPTO_KEYWORDS,
                  symbols: Sequence[str] = vocab.CRYPTO_SYMBOLS, page_url: str = "url",
                  page_html: str = "html") -> DataFrame:
    """Entries -> dedup (U2) -> recent (F4) -> per-feed cap (K2, if asked for)
    -> join pages (J2) -> extract (H) -> length >= 100 (F1) -> relevance (X2)
    -> sanitise (T1) -> V1 -> relevance score (X4) -> article record (N1)."""
    e = feed_entries(entries)
    e = FE.dedup_first(e, "id", [F.col("position"), F.col("source_feed"), F.col("link")])
    lo = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours_back))
    e = e.where(F.col("published_at") > lo)
    if per_feed is not None:
        e = FE.top_n_per_key(e, ["source_feed"], [F.col("position"), F.col("link")], per_feed)
    e = written_table(e.where(F.col("link") != ""), "entries")
    # Entry -> fetched page (inner: unfetched pages drop)
    joined = e.join(linked_pages(pages, e, page_url, page_html), "link")
    ex = extract_articles(joined.withColumnRenamed("title", "feed_title")
                          .withColumnRenamed("summary", "feed_summary"),
                          keep=["id", "feed_title", "feed_summary", "link", "published_at",
                                "source_feed", "source_domain"])
    a = ex.where(F.length("text") >= 100)
    full = F.concat(F.col("title"), F.lit(" "), F.col("text"))
    a = a.where(M.relevant(full, "news", keywords, symbols))
    a = a.withColumn("__clean", T.sanitize("text")).where(F.length("__clean") >= 1)
    score = M.news_relevance_score("title", "text", "source_feed", keywords, symbols)
    wc = T.word_count("text")
    return a.select(
        "id",
        F.col("__clean").alias("text"),
        F.col("text").alias("original_text"),
        F.when(F.col("title") != "", F.col("title")).otherwise(F.col("feed_title")).alias("title"),
        F.when(F.col("summary") != "", F.col("summary")).otherwise(F.col("feed_summary")).alias("summary"),
        M.mentions("text", "news", symbols).alias("symbols_mentioned"),
        F.lit("news").alias("source"),
        F.col("link").alias("url"),
        "published_at", "source_domain", "source_feed",
        F.struct(score.alias("relevance_score"), wc.alias("word_count"),
                 (wc / 200).cast("int").alias("reading_time")).alias("metrics"),
        F.struct(F.lit("en").alias("language"), F.lit("news").alias("platform"),
                 F.lit("article").alias("content_type"),
                 M.classify_source("source_domain").alias("source_type")).alias("metadata"),
    )


def latest_news(articles: DataFrame, limit: int = 100, min_relevance: float = 0.3) -> DataFrame:
    """F5 + K1: relevance threshold then top ``limit`` by (relevance, published) desc."""
    a = articles.where(F.col("metrics.relevance_score") >= min_relevance)
    return a.orderBy(F.col("metrics.relevance_score").desc(), F.col("published_at").desc(),
                     F.col("id").desc()).limit(limit)


def search_news(articles: DataFrame, keywords: Sequence[str], limit: int = 50, as_of=None,
                hours_back: int | None = vocab.SEARCH_HOURS, min_relevance: float = 0.1) -> DataFrame:
    """K4: of all articles at relevance >= 0.1, published within ``hours_back`` before ``as_of`` (a week before
    now by default; at any time if None), those containing any keyword; keyword_relevance = hits / len(keywords)."""
    kws = [k.lower() for k in keywords]
    if not kws:
        raise ValueError("keywords must not be empty")
    pool = articles.where(F.col("metrics.relevance_score") >= min_relevance)
    if hours_back is not None:
        end = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
        pool = pool.where(F.col("published_at").between(end - F.make_dt_interval(F.lit(0), F.lit(hours_back)), end))
    low = F.lower(F.concat(F.col("title"), F.lit(" "), F.col("text")))
    hits = sum((low.contains(k).cast("int") for k in kws), F.lit(0))
    rel = hits / F.lit(len(kws))
    out = pool.withColumn("keyword_relevance", rel).where(F.col("keyword_relevance") > 0)
    return out.orderBy(F.col("keyword_relevance").desc(), F.col("metrics.relevance_score").desc(),
                       F.col("published_at").desc(), F.col("id").desc()).limit(limit)

"""H1-H3 goldens: lenient tree building of the standard-library parser."""

import datetime
import random

from feedpulse.operators import articles as AR
from feedpulse.operators.articles import _TreeBuilder, extract_content

P60 = "x" * 60


def ex(html):
    return extract_content(_TreeBuilder(), html)[:3]


def test_unclosed_paragraph_repeats_nested_text():
    html = f"<html><body><article><h1>T &amp; U</h1><p><b>{P60}.<br><p>second {P60}</p></article></body></html>"
    title, text, summary = ex(html)
    assert title == "T & U"
    parts = text.split("\n")
    # the outer <p> holds the inner one: its text is emitted again on its own
    assert parts == [f"{P60}.second {P60}", f"second {P60}"]
    assert summary.endswith(".")


def test_removed_blocks_and_script_text():
    html = (f"<html><head><title>Fallback</title><script>var t=\"</p>\";</script></head><body>"
            f"<nav><h2>nav title</h2></nav><div>{P60}</div><footer><p>{P60}</p></footer></body></html>")
    title, text, _ = ex(html)
    assert title == "Fallback"       # nav removed before the h1/h2 search
    assert text == P60                # body is the main content; footer removed


def test_selector_priority_and_empty():
    html = f"<body><main><p>{P60}main</p></main><div class='post-content'><p>{P60}post</p></div></body>"
    _, text, _ = ex(html)
    assert text.endswith("post")      # .post-content outranks main
    assert ex("") == ("", "", "")
    assert ex("<p>short</p>") == ("", "", "")  # no body element -> nothing


def test_short_fragments_dropped():
    _, text, _ = ex(f"<body><p>tiny</p><p>{P60}</p></body>")
    assert text == P60


def test_unparsable_page_reports_its_error():
    class Broken:
        def build(self, html):
            raise ValueError("bad page")
    assert extract_content(Broken(), "<p>") == ("", "", "", "ValueError: bad page")


def test_search_news_brute_force(spark):
    rng = random.Random(5)
    now = datetime.datetime(2024, 5, 1)
    rows = [(f"n{i}", f"Title {rng.choice(['Bitcoin', 'bond', ''])}", f"text {rng.choice(['ETHER', 'tea'])} {i % 3}",
             now - datetime.timedelta(hours=rng.randrange(-5, 300)), (rng.randrange(11) / 10,)) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, title string, text string, published_at timestamp, metrics struct<relevance_score: double>")
    keywords = ["bitcoin", "Ether", "n 2"]

    def brute(hours, limit):
        pool = []
        for i, title, text, at, (rel,) in rows:
            hits = sum(k.lower() in f"{title} {text}".lower() for k in keywords)
            if rel >= 0.1 and hits and (hours is None or now - datetime.timedelta(hours=hours) <= at <= now):
                pool.append((hits / 3, rel, at, i))
        return [p[3] for p in sorted(pool, reverse=True)[:limit]]
    week = [r.id for r in AR.search_news(df, keywords, limit=1000, as_of=now).collect()]
    assert week == brute(168, 1000) and len(week) < len(brute(None, 1000))
    assert [r.id for r in AR.search_news(df, keywords, limit=7, hours_back=None).collect()] == brute(None, 7)
    assert AR.search_news(df, keywords).count() == 0   # the week before now


def test_news_path_from_pages_to_articles(spark):
    body = "Bitcoin rises again today as traders buy more of it, while others wait. " * 2
    html = "<html><body><article><h1>News {}</h1><p>{}</p></article></body></html>"
    pages = spark.createDataFrame([(f"http://n/{i}", html.format(i, body if i % 2 else "short")) for i in range(10)], "url string, html string")
    at = datetime.datetime(2024, 4, 30, 12)
    entries = [(f"g{i}" if i != 3 else None, f"t{i}", "s", f"http://n/{i}", at, "http://feed.example.org/rss", i) for i in range(12)]
    entries += entries[:4] + [("old", "t", "s", "http://n/1", at - datetime.timedelta(days=9), "http://feed.example.org/rss", 0),
                              ("nolink", "t", "s", None, at, "http://feed.example.org/rss", 0)]
    e = spark.createDataFrame(entries, "guid string, title string, summary string, link string, published_at timestamp, source_feed string, position int")
    got = {r.id: r for r in AR.news_articles(e, pages, "2024-05-01 00:00:00").collect()}
    # long enough, linked, within the day, once
    assert sorted(got) == ["g1", "g5", "g7", "g9", "http://n/3"]
    a = got["g5"]
    assert (a.title, a.url, a.source_domain, a.source) == ("News 5", "http://n/5", "feed.example.org", "news")
    assert a.original_text.startswith("Bitcoin rises") and a.metrics.word_count == len(a.original_text.split())


def test_extraction_passes_on_bounded_pieces(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(AR, "PIECE", 10_000, raising=False)
    # thirty open paragraphs, whose text is emitted again for each that holds it
    html = "<body>" + f"<p>{P60}" * 30 + "</body>"
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(20)) + [None], "html": [html, None] * 10 + [html]})
    names = ["page_id", "title", "text", "summary", "extract_error"]
    out = list(AR._extractor(names)(iter([batch, batch.slice(0, 0)])))
    one = len(ex(html)[1])
    assert len(out) > 5 and all(sum(map(len, b.column(2).to_pylist())) <= 10_000 + one for b in out)
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(20)) + [None]
    assert [x for b in out for x in b.column(2).to_pylist()] == [ex(html)[1], ""] * 10 + [ex(html)[1]]

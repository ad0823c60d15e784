"""Main text, URL verdicts and language of pages."""

import html
import re

from feedpulse.llm.language import LANGUAGES, declared_in_markup, identify, language_of_address
from feedpulse.llm.main_text import extract_main_text
from feedpulse.llm.queries import URL_RULES
from feedpulse.llm.url_trust import propagate, url_verdicts

from .conftest import ODD_ROWS

PAGES = "page_id long, url string, html string"


def marked_article(page):
    """The article of the test pages, which mark it: its blocks, tags and white space removed."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (re.sub(r"<[^>]*>", "", b) for b in re.split(r"</?(?:p|h1|br)>", inside))
    return " ".join(filter(None, (" ".join(html.unescape(b).split()) for b in blocks)))


def test_whole_table_against_the_marked_article(table):
    pages = table("pages")
    want = {r["page_id"]: marked_article(r["html"]) for r in pages.collect()}
    got = extract_main_text(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def extract(spark, table, *bodies):
    """Pages of other layouts, with weights learned from the test pages."""
    from feedpulse.llm.main_text import learn_weights
    pages = spark.createDataFrame([(i, None, b) for i, b in enumerate(bodies)], PAGES).selectExpr("*", "'x' AS id", "'y' AS text")
    got = extract_main_text(pages, weights=learn_weights(table("pages"))).collect()
    return [r["text"] for r in sorted(got)]


def test_other_layouts(spark, table):
    article = "<h2>Head</h2><p>One two &eacute; &#8212; three.<p>Four <b>fi</b>ve\n\n six.<ul><li>seven<li>eight</ul>"
    want = "Head One two é — three. Four five six. seven eight"
    got = extract(
        spark, table,
        f"<body><div id=header>Site</div><div class='main-menu'><a href=1>A</a></div><div>{article}</div><div class=footer>(c) words</div>",
        f"<main>{article}<aside>buy this now</aside><form>Name <input></form><section class='reader comments'>"
        "<article class=comment><p>Nice words, all of them, many more than the article has in it</article></section></main>",
        f"<nav>Home News<article><div class=cookie-notice>We use cookies</div>{article}</article><footer>unclosed",
        f"<article>{article}<script>if (a < b) document.write('<p>no</p>')</script><!-- <p>no</p> --><style>p{{}}</style>",
        "", "<p", "   ", None, "no tags at all")
    assert got == [want] * 4 + ["", "", "", "", "no tags at all"]


def test_articles_in_and_behind_noise_are_kept(spark, table):
    article = "<article><h1>Head</h1><p>One two three.</p><p>Four five.</p></article>"
    want = "Head One two three. Four five."
    got = extract(
        spark, table,
        "<div class=banner>Cookies<article><p>A b</p><div class=ad>x</div><p>C d</p></article>",
        f"<body><form action=x><nav>Home News</nav>{article}<input><p>Sign up now</p></form></body>",
        f"<body><div class='site has-banner'><div class=row>Menu</div>{article}<div>More</div></div></body>",
        "<form><p>Before</p><h1>Head</h1><p>One two three.</p><div class=ad>x</div><p>Four five.</p></form>",
        f"<div><p class=ad>Buy<div class=ad>now</div></div>{article}",
        "<div class=ad>" * 20000 + "x" + "</div>" * 20000 + article)
    assert got == ["A b C d"] + [want] * 5


def test_main_text_odd_pages(spark, table):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>" * 20000 + "deep")], PAGES)
    assert sorted((tuple(r) for r in extract_main_text(pages).collect()), key=str) == sorted(
        [(1, None, "", 0), (1, None, "", 0), (None, "u", "deep", 4)], key=str)
    assert extract_main_text(pages.limit(0)).collect() == []


def plain_verdict(url):
    """Host, path and the longest fitting rule, in plain Python."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split(r"[/?#]", rest, maxsplit=1)[0])
    path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    fit = [(len(r), r, v) for v, r in URL_RULES
           if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[len(r.split("/")[0]):])]
    return host, path, max(fit)[1:] if fit else (None, None)


def test_url_rules(spark, table):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM", "http://example.com/en/x?y=/z", "https://WWW.Example.com/en/1#a",
            "http://m.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.net/en/1", "http://com?x", "http://xcom/",
            "http://a.org/x://b.com/", "http://x.net/es", "http://example.com/en/x?y=/z"]
    pages = spark.createDataFrame([(i, u, "<a href='http://q.org/'>q</a>") for i, u in enumerate(urls)], PAGES)
    pages = pages.unionByName(table("pages").selectExpr("page_id + 1000 AS page_id", "url", "html"))
    pages = pages.selectExpr("*", "1 AS t", "'h' AS host")
    given = {r["page_id"]: r["url"] for r in pages.collect()}
    got = url_verdicts(pages, URL_RULES).collect()
    assert len(got) == len(given)
    for r in got:
        host, path, (rule, verdict) = plain_verdict(given[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or r["verdict"]) and r["verdict"] in ("allow", "block")
    assert url_verdicts(pages.limit(0), URL_RULES).collect() == []


def test_trust_follows_links_and_distrust_runs_against_them(spark):
    link = "<a class=x href=\"http://{}/p\">t</a>"
    pages = spark.createDataFrame(
        [(1, "http://good.com/", link.format("friend.org")), (2, "http://friend.org/", ""), (3, "http://bad.net/es/", ""),
         (4, "http://farm.org/", link.format("bad.net") * 3), (5, "http://alone.org/", None), (6, "http://www.farm.org/", "")], PAGES)
    got = {r["host"]: r for r in url_verdicts(pages, URL_RULES).collect()}
    assert {h: r["verdict"] for h, r in got.items()} == {
        "good.com": "allow", "friend.org": "allow", "bad.net": "block", "farm.org": "block", "alone.org": "allow", "www.farm.org": "block"}
    assert got["friend.org"]["trust"] > 0 == got["alone.org"]["trust"]


def test_propagation_against_dense_matrices(spark):
    import numpy as np
    hosts = list("abcde")
    links = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("d", "c", 3), ("a", "d", 1)]
    seeds = spark.createDataFrame([(h, int(h == "a"), int(h in "cd")) for h in hosts], "host string, trusted int, blocked int")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in propagate(seeds, spark.createDataFrame(links, "src string, dst string, n long")).collect()}
    m = np.zeros((5, 5))
    for s, d, n in links:
        m[hosts.index(s), hosts.index(d)] = n
    along = m / np.maximum(m.sum(1, keepdims=True), 1)
    against = m.T / np.maximum(m.T.sum(1, keepdims=True), 1)
    t0, d0 = np.eye(5)[0], np.array([0, 0, .5, .5, 0])
    t, d = t0, d0
    for _ in range(300):
        t, d = .15 * t0 + .85 * t @ along, .15 * d0 + .85 * d @ against
    assert np.allclose([got[h] for h in hosts], np.column_stack([t, d]), atol=1e-5)


def test_distrust_reaches_the_far_end_of_a_chain(spark):
    """17 hosts in a row, the last of them blocked; links with and without a scheme."""
    link = ['<a href="http://h{}.org/x">', "<a href='//h{}.org/x'>", '<a class=c href=https://H{}.org>']
    rows = [(i, f"https://h{i}.org/p", link[i % 3].format(i + 1) + "y</a>") for i in range(16)]
    rows += [(16, "http://h16.org/es/", ""), (17, "http://clean.org/", "<a href='//h99.org'>z</a>")]
    out = url_verdicts(spark.createDataFrame(rows, PAGES), [("block", "h16.org/")]).collect()
    assert {r["page_id"]: r["verdict"] for r in out} == {i: "block" for i in range(17)} | {17: "allow"}


def test_language_of_documents(table):
    docs = table("documents", "sf0.01")
    got = identify(docs, ["doc_id"], "text", "lang", host_col="source").collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(lang)
    assert sum(r["language"] == lang[r["doc_id"]] for r in got) >= 0.98 * len(got)
    assert sum(r["kept"] for r in got) >= 0.995 * len(got)


def test_language_without_declared_language_uses_text_and_address(spark, table):
    docs = table("documents", "sf0.01").selectExpr("doc_id", "text", "if(doc_id % 4 = 0, null, lang) AS declared", "lang",
                                                   "concat('http://h', doc_id % 7, '.example.org/', if(doc_id % 8 = 0, lang, 'x'), '/1') AS url")
    got = {r["doc_id"]: r["language"] for r in identify(docs, ["doc_id"], "text", "declared", "url").collect()}
    held = [(r["doc_id"], r["lang"]) for r in docs.filter("declared is null").collect()]
    assert sum(got[d] == lang for d, lang in held) >= 0.97 * len(held)


def test_language_odd_rows(frame):
    rows = ODD_ROWS + [(50, "zqxj vvkq qqzx jjxk wwzq xkqj " * 5), (51, "12345 678 !!!")]
    rows += [(100 + i, "the people of this town were reading about that with their friends") for i in range(200)]
    got = identify(frame(rows), ["doc_id"], "text", "lang", host_col="source").collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not any(kept[d] for d in (1, 2, 3, 50, 51)) and all(kept[100 + i] for i in range(200))
    assert identify(frame([]), ["doc_id"], "text", "lang").collect() == []


def test_markup_and_address(spark):
    df = spark.createDataFrame([('<!DOCTYPE html><HTML class="a" LANG="fr-FR">', "http://a.de/en/1"), ("<p>", "http://a.de:80/x"),
                                (None, None), ("<html lang=es>", "https://x.example.com/english/")], "h string, u string")
    got = [tuple(r) for r in df.select(declared_in_markup(df.h), language_of_address(df.u)).collect()]
    assert got == [("fr", "en"), (None, "de"), (None, None), ("es", None)]
    assert LANGUAGES == tuple(sorted(LANGUAGES))

"""Differential test of the sanitize chain against a plain Python
``re`` transcription of the Unicode semantics, plus goldens."""

import re


from feedpulse.functions import text as T


def py_sanitize(text):
    if not isinstance(text, str):
        return ""
    text = re.sub(r"<[^>]+>", " ", text)
    text = re.sub(r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+", " ", text)
    text = re.sub(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", " ", text)
    text = re.sub(r"[^\w\s\.\,\!\?\:\;\-\(\)\'\"]+", " ", text)
    return re.sub(r"\s+", " ", text.strip())


ADVERSARIAL = [
    "Hello <b>world</b>! Visit https://x.io/a?b=1#frag now, mail a.b@c.org",
    "emoji \U0001F680\U0001F680 moon!!! $BTC #ETH",
    "nbsp here and em space, fullＷidth",
    "Devanagari नमस्ते and fractions ½ ⅕",
    "a < b > c and <@123> mention",
    "tabs\tand\nnewlines\r\n  trailing   ",
    "",
    None,
    "~tilde http://host/~user path",
]


def test_sanitize_matches_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ADVERSARIAL)], "id int, text string")
    got = {r.id: r.clean for r in df.select("id", T.sanitize("text").alias("clean")).collect()}
    for i, t in enumerate(ADVERSARIAL):
        assert got[i] == py_sanitize(t), (i, t, got[i], py_sanitize(t))


def test_sanitize_matches_python_on_documents(spark):
    from tests.conftest import SF_SMALL
    from feedpulse.sources import adapters as A
    rows = A.content(spark, SF_SMALL, templated=True).select("id", "text", T.sanitize("text").alias("c")).collect()
    for r in rows:
        assert r.c == py_sanitize(r.text)


def test_collapse_repeats_and_social(spark):
    df = spark.createDataFrame([("soooo goooood!!!! @alice http://a.b/c",)], "t string")
    r = df.select(T.collapse_repeats("t").alias("a"), T.social_preprocess("t").alias("b"),
                  T.replace_mentions("t").alias("c"), T.replace_urls("t").alias("d")).first()
    t = "soooo goooood!!!! @alice http://a.b/c"
    assert r.a == re.sub(r"(.)\1{2,}", r"\1\1", t) == "soo good!! @alice http://a.b/c"
    assert r.c == re.sub(r"@\w+", "[USER]", t)
    assert r.d == re.sub(r"http[s]?://[^\s]+", "[URL]", t)
    # sanitize already removed '@' and the URL, so only the repeat rule acts
    assert r.b == re.sub(r"(.)\1{2,}", r"\1\1", py_sanitize(t)) == "soo good!! alice"


def test_summary_wordcount_host(spark):
    df = spark.createDataFrame([("One. Two! Three? Four.", "https://User@Sub.Example.com:8080/x")],
                               "t string, u string")
    r = df.select(T.summary("t").alias("s"), T.word_count("t").alias("w"),
                  T.url_host("u").alias("h"), T.url_host("u", keep_port=False).alias("h2")).first()
    assert r.s == "One.  Two.  Three."
    assert r.w == 4
    assert r.h == "user@sub.example.com:8080"
    assert r.h2 == "sub.example.com"


def test_discord_markup_and_post_text(spark):
    df = spark.createDataFrame([("<@!123> @everyone <#9> <:pepe:77> gm frens", "Title", None)],
                               "c string, t string, b string")
    r = df.select(T.strip_discord_markup("c").alias("x"), T.post_text("t", "b").alias("p")).first()
    assert r.x.strip() == "gm frens"
    assert r.p == "Title."

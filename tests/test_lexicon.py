"""M1/M2 goldens (intent of the reference's model tests) and invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from feedpulse import vocab
from feedpulse.operators import lexicon as L


def score(spark, texts, emphasis=False, negators=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    out = L.lexicon_score(df, L.default_lexicon(spark), emphasis=emphasis, negators=negators)
    return {r.id: r for r in out.collect()}


def test_golden_sentences(spark):
    r = score(spark, ["Bitcoin is going to the moon! Great investment!",
                      "Crypto market crash! Selling everything!",
                      "Bitcoin price is $50000 today.",
                      "HODL diamond hands!"])
    assert r[0].value > 0 and 0 <= r[0].confidence <= 1
    assert r[1].value < 0
    assert -0.1 <= r[2].value <= 0.1
    assert r[3].value > 0  # domain overlay: hodl


def test_normalisation_and_negation(spark):
    r = score(spark, ["great", "not great", "great great", "moon not a b c great"])
    s = 3.1
    assert r[0].value == pytest.approx(s / math.sqrt(s * s + 15))
    assert r[1].value == pytest.approx(-0.74 * s / math.sqrt((0.74 * s) ** 2 + 15))
    assert r[2].value == pytest.approx(2 * s / math.sqrt(4 * s * s + 15))
    # "not" is four tokens before "great": outside the three-token window
    t = 2.0 + 3.1
    assert r[3].value == pytest.approx(t / math.sqrt(t * t + 15))


def test_punctuation_stripping_and_underscore_keys(spark):
    r = score(spark, ["(great)!!", "diamond_hands", "diamond hands", "ok"])
    assert r[0].hits == 1
    assert r[1].value > 0 and r[1].hits == 1
    assert r[2].hits == 0  # overlay keys with '_' only match underscore tokens
    assert r[3].hits == 0 and r[3].value == 0.0 and r[3].confidence == 0.0


def test_invalid_text_scores_zero_and_keeps_row(spark):
    r = score(spark, ["", None, "<b></b>"])
    assert len(r) == 3
    for i in range(3):
        assert r[i].value == 0.0 and not r[i].ok


def test_emphasis_tier_b(spark):
    plain = score(spark, ["this is great", "this is GREAT", "this is great!!!"], emphasis=True)
    assert plain[1].value > plain[0].value  # caps emphasis in mixed-case text
    assert plain[2].value > plain[0].value  # exclamation amplifier
    degree = score(spark, ["this is great", "this is very great", "this is slightly great", "very nice, is great",
                           "a very bad crash", "a bad crash"], emphasis=True)
    assert degree[1].value > degree[3].value > degree[0].value > degree[2].value  # nearer words add more
    assert degree[4].value < degree[5].value  # a degree word strengthens either direction


def test_overlay_overrides_base(spark):
    base = L.lexicon_frame(spark, {"moon": -1.0, "great": 3.1})
    lex = L.overlay(base, L.lexicon_frame(spark, vocab.CRYPTO_LEXICON_OVERLAY))
    d = {r.token: r.valence for r in lex.collect()}
    assert d["moon"] == 2.0 and d["great"] == 3.1 and len(d) == 17


def test_no_id_lost_and_bounds(spark):
    from tests.conftest import SF_SMALL
    from feedpulse.sources import adapters as A
    c = A.content(spark, SF_SMALL, templated=True)
    out = L.lexicon_score(c, L.default_lexicon(spark))
    assert out.count() == c.count()
    assert out.where((F.col("value") < -1) | (F.col("value") > 1) | (F.col("confidence") < 0)
                     | (F.col("confidence") > 1)).count() == 0


def test_label_thresholds_strict(spark):
    df = spark.createDataFrame([(0.1,), (0.1000001,), (-0.1,), (-0.2,)], "v double")
    got = [r.l for r in df.select(L.sentiment_label("v").alias("l")).collect()]
    assert got == ["neutral", "positive", "neutral", "negative"]


def test_but_rule_tier_b(spark):
    r = score(spark, ["great but crash", "great crash"], emphasis=True)
    s = 3.1 * 0.5 - 1.7 * 1.5
    assert r[0].value == pytest.approx(s / math.sqrt(s * s + 15))
    t = 3.1 - 1.7
    assert r[1].value == pytest.approx(t / math.sqrt(t * t + 15))


WORDS = ["great", "crash", "GREAT", "moon", "not", "very", "but", "(great)!!", "diamond_hands", "ok", ":)", "--", "Kiss",
         "of", "death", "great.", "slightly", "!!", "dip-", "it's"]


def _texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 30))) for _ in range(n)] + ["", None, "<b></b>"]


@pytest.mark.parametrize("emphasis", [False, True])
def test_in_the_row_equals_the_join(spark, emphasis):
    df = spark.createDataFrame(list(enumerate(_texts(200, 7))), "id long, text string")
    lex = L.overlay(L.default_lexicon(spark), L.lexicon_frame(spark, {":)": 2.0, "--": -0.5, "it's": 0.3}))
    a, b = ({r.id: r for r in L.lexicon_score(df, lex, emphasis=emphasis, max_packed_bytes=n).collect()} for n in (1 << 19, 0))
    assert a.keys() == b.keys() and len(a) == 203
    for i in a:
        assert a[i].value == pytest.approx(b[i].value, abs=1e-12)
        assert (a[i].hits, a[i].ok) == (b[i].hits, b[i].ok)
    assert any(r.hits > 3 for r in a.values())


def test_phrases_leftmost_longest(spark):
    entries = {"kiss": 2.0, "kiss of": 0.5, "kiss of death": -3.0, "death": -2.0, "of the moon": 1.0, "moon": 0.1}
    lex = L.lexicon_frame(spark, entries)
    texts = ["a Kiss of death, now", "kiss of the moon", "kiss of", "kiss", "of death", "not a kiss of death", "kiss of kiss of death!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.value, r.hits) for r in L.lexicon_score(df, lex).collect()}

    def brute(text):
        words = [w.strip(L.PUNCT_CHARS) if len(w.strip(L.PUNCT_CHARS)) > 2 else w for w in text.lower().split(" ")]
        i, total, hits = 0, 0.0, 0
        while i < len(words):
            n = next((n for n in (3, 2, 1) if i + n <= len(words) and " ".join(words[i:i + n]) in entries), 0)
            if n:
                v = entries[" ".join(words[i:i + n])]
                total += v * (vocab.NEGATION_SCALAR if "not" in words[max(i - 3, 0):i] else 1.0)
                hits += 1
            i += max(n, 1)
        return total / math.sqrt(total * total + 15), hits
    for i, t in enumerate(texts):
        assert got[i] == (pytest.approx(brute(t)[0]), brute(t)[1]), t
    assert got[0][1] == 1 and got[1][1] == 2   # "kiss of" wins over "of the moon", which starts later


def test_phrases_need_a_packed_lexicon(spark):
    with pytest.raises(ValueError):
        L.pack_lexicon(L.lexicon_frame(spark, {"kiss of death": -3.0}), max_bytes=8)
    twice = spark.createDataFrame([("great", 1.0), ("great", 2.0), (None, 1.0)], "token string, valence double")
    assert L.pack_lexicon(twice) is None
    empty = L.pack_lexicon(twice.limit(0))
    df = spark.createDataFrame([(1, "great")], "id long, text string")
    assert empty is not None and L.lexicon_score(df, twice.limit(0)).first().hits == 0
    # a repeated id is scored row by row
    assert L.lexicon_score(df.union(df), L.default_lexicon(spark)).count() == 2


def test_read_lexicon(spark, tmp_path):
    path = tmp_path / "lexicon.txt"
    path.write_text("Good\t1.9\t0.9\t[1]\n\n:)\t2.0\ngood\t1.5\t0.1\n\"q\t-1\n")
    assert {r.token: r.valence for r in L.read_lexicon(spark, str(path)).collect()} == {"good": 1.5, ":)": 2.0, '"q': -1.0}
    df = spark.createDataFrame([(1, "a Good :) day")], "id long, text string")
    assert L.lexicon_score(df, L.read_lexicon(spark, str(path))).first().hits == 2
    path.write_text("good\t1.9\nbad\tmuch\n")
    with pytest.raises(Exception, match="without a token and a valence: bad"):
        L.read_lexicon(spark, str(path)).collect()

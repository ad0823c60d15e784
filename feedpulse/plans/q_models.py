"""Registered queries: lexicon (M1-M2), classifier (M3-M7), ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import classify as C
from ..operators import ensemble as E
from ..operators import lexicon as L
from ..sources import adapters as A
from . import sql_adapters as S
from . import sql_models as SM
from .registry import r6, register

DATA_ENTRIES = {**L.DATA_LEXICON, **L.FIXTURE_LEXICON, **vocab.CRYPTO_LEXICON_OVERLAY}
TPL_ENTRIES = {**L.FIXTURE_LEXICON, **vocab.CRYPTO_LEXICON_OVERLAY}


def data_lexicon(spark):
    return L.default_lexicon(spark, {**L.DATA_LEXICON, **L.FIXTURE_LEXICON})


def vader_rows(spark, sf, templated=False):
    """Lexicon score rows over the content table (data or injected vocabulary);
    ``text_ok`` (the raw text is not blank) is computed in the same scan."""
    from ..functions.validate import has_text
    c = A.content(spark, sf, templated=templated).withColumn("text_ok", has_text("text"))
    keep = ["source", "created_at", "text_ok"]
    if templated:
        lx = L.lexicon_score(c, L.default_lexicon(spark), keep=keep)
    else:
        lx = L.lexicon_score(c, data_lexicon(spark), keep=keep, negators=L.DATA_NEGATORS)
    return lx


def score_rows(spark, sf, templated=False):
    """Long-form rows: lexicon ('vader') + deterministic stub classifier."""
    c = A.content(spark, sf, templated=templated)
    lx = vader_rows(spark, sf, templated).select(
        "id", "source", "created_at", F.lit("vader").alias("model"), "value", "confidence", "ok", "text_ok")
    stub = A.stub_classifier_scores(c).withColumn("text_ok", F.lit(None).cast("boolean"))
    return lx.unionByName(stub)


def _score_rows_sql(templated=False):
    if templated:
        return SM.score_rows(TPL_ENTRIES, vocab.NEGATORS, templated=True)
    return SM.score_rows(DATA_ENTRIES, L.DATA_NEGATORS)


# --- M1 / M2 / X7 --------------------------------------------------------------

@register("M1_lexicon_scores", sql=f"""
SELECT id, source, round(value, 6) AS value, round(confidence, 6) AS confidence, ok, hits
FROM ({SM.lexicon_scores(S.content(), DATA_ENTRIES, L.DATA_NEGATORS, ['source'])}) x""")
def m1_scores(spark, sf):
    c = A.content(spark, sf)
    lx = L.lexicon_score(c, data_lexicon(spark), keep=["source"], negators=L.DATA_NEGATORS)
    return lx.select("id", "source", r6("value").alias("value"), r6("confidence").alias("confidence"),
                     "ok", "hits")


def _label_sql(v):
    return f"CASE WHEN {v} > 0.1 THEN 'positive' WHEN {v} < -0.1 THEN 'negative' ELSE 'neutral' END"


FLAGSHIP_SQL = f"""
SELECT source, {_label_sql('value')} AS label, count(*) AS n_docs, round(avg(value), 6) AS avg_value,
       round(avg(confidence), 6) AS avg_confidence
FROM ({SM.lexicon_scores(S.content(), DATA_ENTRIES, L.DATA_NEGATORS, ['source'])}) x
GROUP BY 1, 2"""


def flagship(spark, sf):
    """documents -> T1 -> V1 -> tokens -> broadcast lexicon join -> compound
    -> X7 label -> per (source, label) count and mean."""
    c = A.content(spark, sf)
    lx = L.lexicon_score(c, data_lexicon(spark), keep=["source"], negators=L.DATA_NEGATORS)
    return (lx.withColumn("label", L.sentiment_label("value"))
              .groupBy("source", "label")
              .agg(F.count("*").alias("n_docs"), r6(F.avg("value")).alias("avg_value"),
                   r6(F.avg("confidence")).alias("avg_confidence")))


register("M1_sentiment_by_source_label", sql=FLAGSHIP_SQL)(flagship)


@register("M2_overlay_scores", sql=f"""
SELECT id, round(value, 6) AS value, hits
FROM ({SM.lexicon_scores(S.content(True), TPL_ENTRIES, vocab.NEGATORS, [])}) x""")
def m2(spark, sf):
    c = A.content(spark, sf, templated=True)
    lx = L.lexicon_score(c, L.default_lexicon(spark))
    return lx.select("id", r6("value").alias("value"), "hits")


@register("M1B_emphasis_scores", sql=SM.lexicon_scores_tier_b(S.content(True), TPL_ENTRIES, vocab.NEGATORS, vocab.BOOSTERS))
def m1b(spark, sf):
    # tier B: caps emphasis, the "but" shift, punctuation amplification
    c = A.content(spark, sf, templated=True)
    lx = L.lexicon_score(c, L.default_lexicon(spark), emphasis=True)
    return lx.select("id", r6("value").alias("value"), "hits")


#: Degree words that the invented prose has (the published ones never occur in it).
DATA_BOOSTERS = {"the": 0.293, "and": 0.293, "in": -0.293, "die": 0.293, "la": -0.293, "el": 0.293}


@register("M1B_degree_words", sql=SM.lexicon_scores_tier_b(S.content(), DATA_ENTRIES, L.DATA_NEGATORS, DATA_BOOSTERS))
def m1b_degree(spark, sf):
    lx = L.lexicon_score(A.content(spark, sf), data_lexicon(spark), negators=L.DATA_NEGATORS,
                         emphasis=True, boosters=DATA_BOOSTERS)
    return lx.select("id", r6("value").alias("value"), "hits")


@register("X7_sentiment_label", sql=f"""
SELECT id, {_label_sql('value')} AS label FROM ({S.stub_scores(S.content())}) s""")
def x7(spark, sf):
    s = A.stub_classifier_scores(A.content(spark, sf))
    return s.select("id", L.sentiment_label("value").alias("label"))


# --- M3 / M4 / M5 / M7 ----------------------------------------------------------

_LOGITS_SQL = f"""
WITH x AS (SELECT id, [CAST((id * 3) % 17 AS DOUBLE) / 4.0, CAST((id * 5) % 19 AS DOUBLE) / 4.0,
                       CAST((id * 7) % 23 AS DOUBLE) / 4.0] AS lg FROM ({S.content()}) c),
e AS (SELECT id, list_transform(lg, lambda v: exp(v - list_max(lg))) AS ex FROM x),
p AS (SELECT id, list_transform(ex, lambda v: v / list_sum(ex)) AS pr FROM e),
d AS (SELECT id, list_max(pr) AS pmax,
        {S.arr(vocab.CLASSIFIER_LABELS)}[list_position(pr, list_max(pr))] AS label FROM p)
"""


@register("M3_decode_logits", sql=_LOGITS_SQL + """
SELECT id, label, CASE label WHEN 'negative' THEN -1.0 WHEN 'neutral' THEN 0.0 WHEN 'positive' THEN 1.0 ELSE 0.0 END AS value,
       round(pmax, 6) AS confidence FROM d""")
def m3(spark, sf):
    lg = A.stub_logits(A.content(spark, sf))
    d = C.decode_logits("logits")
    return lg.select("id", d["label"].alias("label"), d["value"].alias("value"),
                     r6(d["confidence"]).alias("confidence"))


@register("M7_failed_fill", sql=_LOGITS_SQL + """
SELECT id, CASE WHEN id % 11 = 0 THEN 0.0 ELSE CASE label WHEN 'negative' THEN -1.0 WHEN 'neutral' THEN 0.0 ELSE 1.0 END END AS value,
       CASE WHEN id % 11 = 0 THEN 0.0 ELSE round(pmax, 6) END AS confidence,
       'finbert' AS model_name FROM d""")
def m7(spark, sf):
    lg = A.stub_logits(A.content(spark, sf))
    lg = lg.withColumn("logits", F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("logits")))
    d = C.decode_logits("logits")
    sc = F.when(d.isNull(), F.lit(None)).otherwise(
        F.struct(d["value"].alias("value"), r6(d["confidence"]).alias("confidence"),
                 F.lit("finbert").alias("model_name")))
    filled = C.fill_failed(sc, "finbert")
    return lg.select("id", filled["value"].alias("value"), filled["confidence"].alias("confidence"),
                     filled["model_name"].alias("model_name"))


def _stub_factory():
    return C.KeywordStubModel()


FINBERT_TEXTS = f"SELECT id, {S.sanitize('text')} AS t FROM ({S.content(True)}) c"
ROBERTA_TEXTS = f"SELECT id, out AS t FROM ({S.social_preprocess()}) c"


def _stub_sql(texts, model):
    return f"""
SELECT id, model, value, round(confidence, 6) AS confidence, ok FROM ({SM.stub_classifier(texts, model)}) s"""


@register("M4_model_inference", sql=_stub_sql(FINBERT_TEXTS, "finbert"))
def m4(spark, sf):
    # user-model path (mapInPandas); a deterministic stub stands in for weights
    c = A.content(spark, sf, templated=True)
    s = C.classifier_scores(c, _stub_factory, model_name="finbert")
    return s.select("id", "model", r6("value").alias("value"), r6("confidence").alias("confidence"), "ok")


@register("M5_social_classifier", sql=_stub_sql(ROBERTA_TEXTS, "twitter_roberta"))
def m5(spark, sf):
    c = A.content(spark, sf, templated=True)
    s = C.social_classifier_scores(c, _stub_factory)
    return s.select("id", "model", r6("value").alias("value"), r6("confidence").alias("confidence"), "ok")


# --- E: ensembles ----------------------------------------------------------------

@register("E8_fallback_rows", sql=f"""
SELECT id, model, model_name, round(value, 6) AS value, round(confidence, 6) AS confidence
FROM ({SM.with_perf(_score_rows_sql())}) p""")
def e8(spark, sf):
    f = E.with_fallback(score_rows(spark, sf))
    return f.select("id", "model", "model_name", r6("value").alias("value"), r6("confidence").alias("confidence"))


@register("E4_performance_factor", sql=f"""
SELECT id, model, succ_k, round(perf, 9) AS perf FROM ({SM.with_perf(_score_rows_sql())}) p""")
def e4(spark, sf):
    f = E.performance_factor(E.with_fallback(score_rows(spark, sf)))
    return f.select("id", "model", "succ_k", F.round("perf", 9).alias("perf"))


@register("K8_rolling_mean_100", sql=f"""
SELECT id, model, round(perf - 0.5, 9) AS rolling_mean FROM ({SM.with_perf(_score_rows_sql())}) p
WHERE succ_k > 0""")
def k8(spark, sf):
    f = E.performance_factor(E.with_fallback(score_rows(spark, sf)))
    return f.where("succ_k > 0").select("id", "model", F.round(F.col("perf") - 0.5, 9).alias("rolling_mean"))


@register("E2_adaptive_ensemble", sql=f"""
SELECT id, source, round(value, 6) AS value, round(confidence, 6) AS confidence, model_name
FROM ({SM.adaptive(_score_rows_sql())}) a""")
def e2(spark, sf):
    f = E.performance_factor(E.with_fallback(score_rows(spark, sf)))
    a = E.adaptive_ensemble(f)
    return a.select("id", "source", r6("value").alias("value"), r6("confidence").alias("confidence"), "model_name")


@register("E3_weighted_ensemble", sql=f"""
SELECT id, source, round(value, 6) AS value, round(confidence, 6) AS confidence, model_name
FROM ({SM.weighted(_score_rows_sql())}) a""")
def e3(spark, sf):
    w = E.weighted_ensemble(E.with_fallback(score_rows(spark, sf)))
    return w.select("id", "source", r6("value").alias("value"), r6("confidence").alias("confidence"), "model_name")


@register("E9_score_content", sql=f"""
SELECT id, source, round(value, 6) AS value, round(confidence, 6) AS confidence, model_name
FROM ({SM.with_errors(SM.adaptive(_score_rows_sql(True)), S.content(True))}) x""")
def e9(spark, sf):
    c = A.content(spark, sf, templated=True)
    out = E.score_content(c, score_rows(spark, sf, templated=True), mode="adaptive")
    return out.select("id", "source", r6("value").alias("value"), r6("confidence").alias("confidence"), "model_name")


def composed_score_rows(spark, sf):
    """Lexicon rows, and E1 over both classifiers (M4, M5) as the 'transformer' rows.  The two
    classifiers' rows meet in one grouped aggregation by id."""
    c = A.content(spark, sf, templated=True)
    vader = vader_rows(spark, sf, templated=True).select(
        "id", "source", "created_at", F.lit("vader").alias("model"), "value", "confidence", "ok", "text_ok")
    both = C.classifier_scores(c, _stub_factory, model_name="finbert").unionByName(
        C.social_classifier_scores(c, _stub_factory))
    of = [F.max(F.when(F.col("model") == m, F.col(v))).alias(f"{m}_{v}")
          for m in ("finbert", "twitter_roberta") for v in ("value", "confidence")]
    wide = both.groupBy("id", "source", "created_at").agg(*of, F.min("ok").alias("ok"))
    trans = E.transformer_ensemble(wide).select(
        "id", "source", "created_at", F.lit("transformer").alias("model"), "value", "confidence", "ok",
        F.lit(None).cast("boolean").alias("text_ok"))
    return vader.unionByName(trans)


_COMPOSED_SQL = SM.composed_rows(S.content(True), SM.lexicon_scores(S.content(True), TPL_ENTRIES, vocab.NEGATORS, ["source", "created_at"]),
                                 FINBERT_TEXTS, ROBERTA_TEXTS)


@register("E9_composed", sql=f"""
SELECT id, source, round(value, 6) AS value, round(confidence, 6) AS confidence, model_name
FROM ({SM.with_errors(SM.adaptive(_COMPOSED_SQL), S.content(True))}) x""")
def e9_composed(spark, sf):
    # the whole chain: lexicon and two classifiers -> E1 -> E4 -> E2 -> E9
    c = A.content(spark, sf, templated=True)
    out = E.score_content(c, composed_score_rows(spark, sf), mode="adaptive")
    return out.select("id", "source", r6("value").alias("value"), r6("confidence").alias("confidence"), "model_name")


@register("E7_batch_weighted", sql=f"""
SELECT id, source, round(value, 6) AS value, round(confidence, 6) AS confidence, model_name
FROM ({SM.with_errors(SM.weighted(_score_rows_sql(True)), S.content(True))}) x""")
def e7(spark, sf):
    c = A.content(spark, sf, templated=True)
    out = E.score_content(c, score_rows(spark, sf, templated=True), mode="weighted")
    return out.select("id", "source", r6("value").alias("value"), r6("confidence").alias("confidence"), "model_name")


@register("N7_response_rows", sql=f"""
SELECT id, round(value, 6) AS sentiment, round(confidence, 6) AS confidence,
  {_label_sql('round(value, 6)')} AS label, model_name AS model_used
FROM ({SM.with_errors(SM.adaptive(_score_rows_sql(True)), S.content(True))}) x""")
def n7(spark, sf):
    c = A.content(spark, sf, templated=True)
    out = E.score_content(c, score_rows(spark, sf, templated=True))
    # the label is taken on the reported (6 dp) sentiment
    return out.select("id", r6("value").alias("sentiment"), r6("confidence").alias("confidence"),
                      L.sentiment_label(r6("value")).alias("label"), F.col("model_name").alias("model_used"))


def _roberta_stub(c):
    i = F.col("id")
    ok = i % 13 != 0
    return c.select(
        "id", "source",
        (((i * 7) % 201 - 100) / 100.0).alias("finbert_value"),
        (((i * 13) % 101) / 100.0).alias("finbert_confidence"),
        F.when(ok, ((i * 11) % 201 - 100) / 100.0).alias("twitter_roberta_value"),
        F.when(ok, ((i * 17) % 101) / 100.0).alias("twitter_roberta_confidence"),
    )


def _e1_sql():
    soc, news = S.arr(vocab.SOCIAL_SOURCES), S.arr(vocab.NEWS_SOURCES)
    tw = vocab.TRANSFORMER_WEIGHTS

    def pick(m):
        return (f"CASE WHEN list_contains({soc}, source) THEN {tw['social'][m]} "
                f"WHEN list_contains({news}, source) THEN {tw['news'][m]} ELSE {tw['default'][m]} END")
    return f"""
WITH w AS (SELECT id, source, CAST((id * 7) % 201 - 100 AS DOUBLE) / 100.0 AS fv,
    CAST((id * 13) % 101 AS DOUBLE) / 100.0 AS fc,
    CASE WHEN id % 13 <> 0 THEN CAST((id * 11) % 201 - 100 AS DOUBLE) / 100.0 END AS rv,
    CASE WHEN id % 13 <> 0 THEN CAST((id * 17) % 101 AS DOUBLE) / 100.0 END AS rc
  FROM ({S.content()}) c)
SELECT id, round(fv * ({pick('finbert')}) + rv * ({pick('twitter_roberta')}), 6) AS w_value,
       round(fc * ({pick('finbert')}) + rc * ({pick('twitter_roberta')}), 6) AS w_confidence,
       round((fv + rv) / 2, 6) AS m_value, round((fc + rc) / 2, 6) AS m_confidence
FROM w"""


@register("E1_transformer_ensemble", sql=_e1_sql())
def e1(spark, sf):
    wide = _roberta_stub(A.content(spark, sf))
    w = E.transformer_ensemble(wide).withColumnsRenamed({"value": "w_value", "confidence": "w_confidence"})
    m = E.transformer_ensemble(w, weighted=False)
    return m.select("id", r6("w_value").alias("w_value"), r6("w_confidence").alias("w_confidence"),
                    r6("value").alias("m_value"), r6("confidence").alias("m_confidence"))


@register("E5_E6_weight_lookup", sql=f"""
SELECT id, model, CASE WHEN model = 'transformer' THEN 'finbert' ELSE model END AS mapped,
       CAST({SM.base_weight()} AS DOUBLE) AS adaptive_base, CAST({SM.mapped_weight()} AS DOUBLE) AS weighted_base
FROM ({S.stub_scores(S.content())} UNION ALL SELECT id, source, created_at, 'vader', 0.0, 0.0, true FROM ({S.content()}) c2) s""")
def e5(spark, sf):
    c = A.content(spark, sf)
    rows = A.stub_classifier_scores(c).unionByName(
        c.select("id", "source", "created_at", F.lit("vader").alias("model"), F.lit(0.0).alias("value"),
                 F.lit(0.0).alias("confidence"), F.lit(True).alias("ok")))
    m = E.top_level_weights_map(F.col("source"))
    return rows.select("id", "model", E.map_model_name("model").alias("mapped"),
                       F.coalesce(F.element_at(m, F.col("model")), F.lit(0.5)).alias("adaptive_base"),
                       F.coalesce(F.element_at(m, E.map_model_name("model")), F.lit(0.5)).alias("weighted_base"))


@register("J3_align_scores", sql=f"""
SELECT id, round(max(CASE WHEN model = 'transformer' THEN value END), 6) AS transformer_value,
       round(max(CASE WHEN model = 'vader' THEN value END), 6) AS vader_value
FROM ({_score_rows_sql()}) s GROUP BY id""")
def j3(spark, sf):
    s = score_rows(spark, sf)
    p = s.groupBy("id").pivot("model", ["transformer", "vader"]).agg(F.max("value"))
    return p.select("id", r6("transformer").alias("transformer_value"), r6("vader").alias("vader_value"))


@register("J4_weights_join", sql=f"""
SELECT s.id, s.model, CAST(w.weight AS DOUBLE) AS weight FROM ({_score_rows_sql()}) s
JOIN (VALUES {', '.join(f"('{g}', '{m}', {w})" for g, ws in vocab.ENSEMBLE_WEIGHTS.items() for m, w in ws.items())}) w(source_group, model, weight)
  ON w.source_group = CASE WHEN list_contains({S.arr(vocab.SOCIAL_SOURCES)}, s.source) THEN 'social'
                          WHEN list_contains({S.arr(vocab.NEWS_SOURCES)}, s.source) THEN 'news' ELSE 'default' END
 AND w.model = CASE WHEN s.model = 'transformer' THEN 'finbert' ELSE s.model END""")
def j4(spark, sf):
    s = score_rows(spark, sf).withColumn("source_group", E.source_group("source")) \
        .withColumn("mapped", E.map_model_name("model"))
    wt = F.broadcast(E.weights_table(spark))  # fixed 12-row table
    j = s.join(wt.withColumnRenamed("model", "mapped"), ["source_group", "mapped"])
    return j.select("id", "model", "weight")

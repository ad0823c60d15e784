"""DuckDB oracle text for the scoring pipeline."""

from __future__ import annotations

from .. import vocab
from ..operators.lexicon import STRIP_PUNCT
from . import sql_adapters as S

q = S.q


def lexicon_scores(docs_sql: str, entries: dict, negators: list, keep: list[str]) -> str:
    """M1 tier A: one row per input row: id, *keep, value, confidence, ok, hits."""
    vals = ", ".join(f"({q(k.lower())}, CAST({float(v)!r} AS DOUBLE))" for k, v in entries.items())
    neg = S.arr(negators) if negators else "CAST([] AS VARCHAR[])"
    strip = f"regexp_replace(t, {q(STRIP_PUNCT)}, '', 'g')"
    ks = "".join(f", {k}" for k in keep)
    rks = "".join(f", r.{k}" for k in keep)
    return f"""
WITH d AS ({docs_sql}),
b AS (SELECT id{ks}, {S.sanitize('text')} AS clean FROM d),
v AS (SELECT *, coalesce(length(clean) >= 1, false) AS ok FROM b),
l AS (SELECT id, list_transform(list_transform(string_split(clean, ' '),
        lambda t: CASE WHEN length({strip}) <= 2 THEN t ELSE {strip} END), lambda t: lower(t)) AS lw
      FROM v WHERE ok),
t AS (SELECT id, lw, unnest(lw) AS tok, generate_subscripts(lw, 1) AS i FROM l),
lex AS (SELECT * FROM (VALUES {vals}) x(token, valence)),
h AS (SELECT t.id, CASE WHEN list_has_any(list_slice(t.lw, greatest(t.i - 3, 1), t.i - 1), {neg})
             THEN lex.valence * {vocab.NEGATION_SCALAR} ELSE lex.valence END AS v
      FROM t JOIN lex ON t.tok = lex.token),
s AS (SELECT id, sum(v) AS s, count(*) AS hits FROM h GROUP BY id),
r AS (SELECT v.id{''.join(f', v.{k}' for k in keep)}, v.ok, coalesce(s.s, 0.0) AS s,
             CAST(coalesce(s.hits, 0) AS BIGINT) AS hits FROM v LEFT JOIN s ON v.id = s.id)
SELECT r.id{rks}, least(greatest(r.s / sqrt(r.s * r.s + {vocab.NORMALIZE_ALPHA}), -1.0), 1.0) AS value,
       abs(least(greatest(r.s / sqrt(r.s * r.s + {vocab.NORMALIZE_ALPHA}), -1.0), 1.0)) AS confidence,
       r.ok, r.hits
FROM r"""


def lexicon_scores_tier_b(docs_sql: str, entries: dict, negators: list, boosters: dict) -> str:
    """M1 tier B: caps emphasis (mixed-case texts), degree words, the 'but' shift and
    '!'/'?' amplification on top of tier A.  Output: id, value, hits."""
    degree_words = "MAP {" + ", ".join(f"{q(w.lower())}: CAST({float(b)!r} AS DOUBLE)" for w, b in boosters.items()) + "}"

    def degree(k: int) -> str:
        word = f"r[i - {k}]"
        up = f"(upper({word}) = {word} AND lower({word}) <> {word})"
        loud = f"CASE WHEN mixed AND {up} THEN {vocab.CAPS_INCREMENT} ELSE 0.0 END"
        return (f"CASE WHEN i > {k} THEN coalesce(({degree_words})[lw[i - {k}]] + {loud}, 0.0) "
                f"* {vocab.BOOST_DAMP[k - 1]} ELSE 0.0 END")
    vals = ", ".join(f"({q(k.lower())}, CAST({float(v)!r} AS DOUBLE))" for k, v in entries.items())
    neg = S.arr(negators) if negators else "CAST([] AS VARCHAR[])"
    def form(x):
        st = f"regexp_replace({x}, {q(STRIP_PUNCT)}, '', 'g')"
        return f"lower(CASE WHEN length({st}) <= 2 THEN {x} ELSE {st} END)"
    isup = "(upper(w) = w AND lower(w) <> w)"
    a = vocab.NORMALIZE_ALPHA
    return f"""
WITH d AS ({docs_sql}),
b AS (SELECT id, {S.sanitize('text')} AS clean FROM d),
v AS (SELECT *, coalesce(length(clean) >= 1, false) AS ok,
        least(length(clean) - length(replace(clean, '!', '')), 4) * {vocab.EXCLAIM_INCREMENT}
        + CASE WHEN length(clean) - length(replace(clean, '?', '')) > 3 THEN {vocab.QUESTION_INCREMENT_LARGE}
               WHEN length(clean) - length(replace(clean, '?', '')) > 1
               THEN (length(clean) - length(replace(clean, '?', ''))) * {vocab.QUESTION_INCREMENT_SMALL}
               ELSE 0.0 END AS amp FROM b),
l AS (SELECT id, r, list_transform(r, lambda w: {form('w')}) AS lw,
        list_bool_or(list_transform(r, lambda w: {isup})) AND list_bool_or(list_transform(r, lambda w: NOT {isup})) AS mixed
      FROM (SELECT id, string_split(clean, ' ') AS r FROM v WHERE ok) x),
l2 AS (SELECT *, coalesce(list_position(lw, 'but'), 0) AS bi FROM l),
t AS (SELECT id, lw, r, mixed, bi, unnest(r) AS w, unnest(lw) AS tok, generate_subscripts(lw, 1) AS i FROM l2),
lex AS (SELECT * FROM (VALUES {vals}) x(token, valence)),
h0 AS (SELECT t.*, lex.valence AS val FROM t JOIN lex ON t.tok = lex.token),
h1 AS (SELECT id, (CASE WHEN mixed AND {isup} THEN val + sign(val) * {vocab.CAPS_INCREMENT} ELSE val END)
           + sign(val) * (({degree(1)}) + ({degree(2)}) + ({degree(3)})) AS v1,
         i, bi, lw FROM h0),
h AS (SELECT id,
        (CASE WHEN bi > 0 AND i < bi THEN v1 * {vocab.BUT_BEFORE} WHEN bi > 0 AND i > bi THEN v1 * {vocab.BUT_AFTER} ELSE v1 END)
        * (CASE WHEN list_has_any(list_slice(lw, greatest(i - 3, 1), i - 1), {neg}) THEN {vocab.NEGATION_SCALAR} ELSE 1.0 END) AS v
      FROM h1),
s AS (SELECT id, sum(v) AS s, count(*) AS hits FROM h GROUP BY id),
r AS (SELECT v.id, v.amp, coalesce(s.s, 0.0) AS s0, CAST(coalesce(s.hits, 0) AS BIGINT) AS hits
      FROM v LEFT JOIN s ON v.id = s.id),
r2 AS (SELECT id, hits, CASE WHEN s0 > 0 THEN s0 + amp WHEN s0 < 0 THEN s0 - amp ELSE s0 END AS sa FROM r)
SELECT id, round(least(greatest(sa / sqrt(sa * sa + {a}), -1.0), 1.0), 6) AS value, hits FROM r2"""


def stub_classifier(texts_sql: str, model: str) -> str:
    """M4 / M5 with the keyword stub: ``texts_sql`` gives (id, t); softmax and argmax of the logits
    (negative words, 0.5, positive words); a blank text decodes to (0, 0, not ok)."""
    from ..operators.classify import KeywordStubModel
    stub = KeywordStubModel()

    def count(words) -> str:
        return f"len(list_filter(ws, lambda w: list_contains({S.arr(sorted(words))}, trim(w, '.,!?'))))"
    return f"""
WITH w AS (SELECT id, string_split(lower(t), ' ') AS ws, t <> '' AS ok FROM ({texts_sql}) x),
l AS (SELECT id, ok, CAST({count(stub.neg)} AS DOUBLE) AS n, CAST({count(stub.pos)} AS DOUBLE) AS p FROM w),
m AS (SELECT *, greatest(n, 0.5, p) AS top, exp(n) + exp(0.5) + exp(p) AS z FROM l)
SELECT id, '{model}' AS model,
  CASE WHEN NOT ok THEN 0.0 WHEN n = top THEN -1.0 WHEN 0.5 = top THEN 0.0 ELSE 1.0 END AS value,
  CASE WHEN ok THEN exp(top) / z ELSE 0.0 END AS confidence, ok
FROM m"""


def composed_rows(content_sql: str, lexicon_sql: str, finbert_texts: str, roberta_texts: str) -> str:
    """E9's score rows: lexicon ('vader') and E1 over both classifiers ('transformer')."""
    soc, news = S.arr(vocab.SOCIAL_SOURCES), S.arr(vocab.NEWS_SOURCES)
    w = vocab.TRANSFORMER_WEIGHTS

    def weight(model: str) -> str:
        return (f"CASE WHEN list_contains({soc}, c.source) THEN {w['social'][model]} "
                f"WHEN list_contains({news}, c.source) THEN {w['news'][model]} ELSE {w['default'][model]} END")
    wf, wr = weight("finbert"), weight("twitter_roberta")
    return f"""
SELECT id, source, created_at, 'vader' AS model, value, confidence, ok FROM ({lexicon_sql}) lx
UNION ALL
SELECT c.id, c.source, c.created_at, 'transformer' AS model, f.value * ({wf}) + r.value * ({wr}) AS value,
  f.confidence * ({wf}) + r.confidence * ({wr}) AS confidence, f.ok AND r.ok AS ok
FROM ({content_sql}) c JOIN ({stub_classifier(finbert_texts, "finbert")}) f ON f.id = c.id
JOIN ({stub_classifier(roberta_texts, "twitter_roberta")}) r ON r.id = c.id"""


def score_rows(entries: dict, negators: list, templated: bool = False) -> str:
    """Long-form score rows: lexicon ('vader') + stub classifier ('transformer')."""
    c = S.content(templated)
    lex = lexicon_scores(c, entries, negators, ["source", "created_at"])
    return f"""
SELECT id, source, created_at, 'vader' AS model, value, confidence, ok FROM ({lex}) lx
UNION ALL
{S.stub_scores(c)}"""


def base_weight(model: str = "model", source: str = "source") -> str:
    """E2 base: raw model name looked up in the source weight set, default 0.5."""
    soc, news = S.arr(vocab.SOCIAL_SOURCES), S.arr(vocab.NEWS_SOURCES)
    w = vocab.ENSEMBLE_WEIGHTS
    def pick(key):
        return (f"CASE WHEN list_contains({soc}, {source}) THEN {w['social'][key]} "
                f"WHEN list_contains({news}, {source}) THEN {w['news'][key]} ELSE {w['default'][key]} END")
    return f"CASE WHEN {model} = 'vader' THEN {pick('vader')} ELSE 0.5 END"


def mapped_weight(model: str = "model", source: str = "source") -> str:
    """E3 base: model name mapped (transformer -> finbert) then looked up."""
    soc, news = S.arr(vocab.SOCIAL_SOURCES), S.arr(vocab.NEWS_SOURCES)
    w = vocab.ENSEMBLE_WEIGHTS
    def pick(key):
        return (f"CASE WHEN list_contains({soc}, {source}) THEN {w['social'][key]} "
                f"WHEN list_contains({news}, {source}) THEN {w['news'][key]} ELSE {w['default'][key]} END")
    return (f"CASE WHEN {model} = 'vader' THEN {pick('vader')} "
            f"WHEN {model} = 'transformer' THEN {pick('finbert')} ELSE 0.5 END")


def with_perf(rows_sql: str) -> str:
    """E8 fallback fill + E4 performance factor (reference window form)."""
    return f"""
WITH sc AS ({rows_sql}),
f AS (SELECT id, source, created_at, model,
        CASE WHEN ok THEN value ELSE 0.0 END AS value,
        CASE WHEN ok THEN confidence ELSE 0.0 END AS confidence,
        CASE WHEN ok THEN model ELSE model || '_fallback' END AS model_name, ok FROM sc),
k AS (SELECT *, sum(CAST(ok AS BIGINT)) OVER (PARTITION BY source, model ORDER BY created_at, id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS succ_k FROM f)
SELECT *, CASE WHEN succ_k > 0 THEN 0.5 + avg(CASE WHEN ok THEN CAST(confidence AS DECIMAL(18, 12)) END) OVER (
        PARTITION BY source, model ORDER BY succ_k RANGE BETWEEN {vocab.HISTORY_SIZE - 1} PRECEDING AND CURRENT ROW)
       ELSE 1.0 END AS perf
FROM k"""


def adaptive(rows_sql: str) -> str:
    """E2 over E4: id, source, value, confidence (unrounded)."""
    return f"""
WITH p AS ({with_perf(rows_sql)}),
w AS (SELECT *, CASE WHEN confidence > {vocab.MIN_CONFIDENCE} THEN ({base_weight()}) * confidence * perf
        ELSE 0.0 END AS w FROM p),
g AS (SELECT id, source, sum(w) AS tw, count(*) AS n, sum(value * w) AS vw, sum(confidence * w) AS cw,
        sum(value) AS v, sum(confidence) AS c FROM w GROUP BY id, source)
SELECT id, source, CASE WHEN tw > 0 THEN vw / tw ELSE v / n END AS value,
       CASE WHEN tw > 0 THEN cw / tw ELSE c / n END AS confidence, 'adaptive_ensemble' AS model_name
FROM g"""


def weighted(rows_sql: str) -> str:
    """Id, source, value, confidence (unrounded, unnormalised)."""
    return f"""
WITH f AS (SELECT id, source, model, CASE WHEN ok THEN value ELSE 0.0 END AS value,
             CASE WHEN ok THEN confidence ELSE 0.0 END AS confidence FROM ({rows_sql}) sc)
SELECT id, source, sum(value * ({mapped_weight()})) AS value, sum(confidence * ({mapped_weight()})) AS confidence,
       'weighted_ensemble' AS model_name
FROM f GROUP BY id, source"""


def with_errors(ens_sql: str, content_sql: str) -> str:
    """Null or blank raw text -> ensemble_error (0, 0)."""
    valid = f"coalesce(length({S.strip_ws('c.text')}) >= 1, false)"
    return f"""
SELECT e.id, e.source,
  CASE WHEN {valid} THEN e.value ELSE 0.0 END AS value,
  CASE WHEN {valid} THEN e.confidence ELSE 0.0 END AS confidence,
  CASE WHEN {valid} THEN e.model_name ELSE 'ensemble_error' END AS model_name
FROM ({ens_sql}) e JOIN ({content_sql}) c ON c.id = e.id"""

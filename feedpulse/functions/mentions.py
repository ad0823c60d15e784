"""Symbol mentions, topic relevance and source classification.

Vocabulary-parametrised and native:

* whole-word symbol hits are one ``split`` of the upper-cased text into word
  runs intersected with the symbol array (a word-bounded symbol is exactly a
  maximal word run), replacing 30-210 regex searches per row;
* pair patterns (``BTC/USDT`` ...) have no left boundary: the word runs before the
  pair suffix are taken once and tested for the symbols that they end in;
* keyword relevance is a substring test per keyword, written as an OR chain
  over literal keywords (cheapest first) so the lower-cased text is computed
  once as a common subexpression.

For vocabularies beyond a few hundred entries use ``mention_rows`` (explode
tokens + size-checked broadcast join).
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from . import patterns as P
from .text import _col

DIALECTS = list(vocab.MENTION_PAIRS)


def _or(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: lambdas that read an outer expression would
    compute it again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _template_hits(u: Column, template: str, right_bounded: bool, sym_arr: Column) -> Column:
    """Symbols S for which ``template`` (S + suffix) occurs in ``u``; S has no left boundary.

    Where the suffix starts with a separator, S ends a run of word characters that stands before
    it: each run is matched once, from its first character on.  Where the suffix is made of word
    characters, S + suffix lies within a run (at its end, if bounded on the right).  Either
    way one linear pass over the text finds the few runs that matter.
    """
    suffix = template.replace("{S}", "")
    lit = P.literal_regex(suffix)
    if suffix[:1].isalnum() or suffix[:1] == "_":
        inside = (lambda r: r.endswith(suffix)) if right_bounded else (lambda r: r.contains(suffix))
        runs = F.filter(F.split(u, P.NON_WORD + "+", -1), inside)
        ends = (lambda r, s: r.endswith(F.concat(s, F.lit(suffix)))) if right_bounded else (
            lambda r, s: r.contains(F.concat(s, F.lit(suffix))))
    else:
        bound = f"(?!{P.WORD})" if right_bounded else ""
        runs = F.regexp_extract_all(u, F.lit(f"(?<!{P.WORD})({P.WORD}++)(?={lit}{bound})"), 1)
        ends = lambda r, s: r.endswith(s)
    hits = _let(runs, lambda rs: F.filter(sym_arr, lambda s: F.exists(rs, lambda r: ends(r, s))))
    return F.when(u.contains(suffix), hits).otherwise(F.array().cast("array<string>"))


def _pair_hits(u: Column, dialect: str, syms: list[str]) -> Column:
    """Union of the template hits of a dialect (array of symbols)."""
    sym_arr = F.array(*[F.lit(x) for x in syms])
    arrs = [_template_hits(u, t, rb, sym_arr) for t, rb in vocab.MENTION_PAIRS[dialect]]
    return F.array_distinct(F.concat(*arrs)) if arrs else F.array().cast("array<string>")


def word_runs(c) -> Column:
    """Upper-cased maximal word-character runs."""
    return F.split(F.upper(_col(c)), P.NON_WORD + "+", -1)


def mentions(c, dialect: str = "twitter", symbols: Sequence[str] = vocab.CRYPTO_SYMBOLS) -> Column:
    """Sorted distinct symbols mentioned in ``c`` under a platform dialect."""
    if dialect not in vocab.MENTION_PAIRS:
        raise ValueError(f"unknown dialect {dialect!r}; expected one of {DIALECTS}")
    syms = [s.upper() for s in symbols]
    sym_arr = F.array(*[F.lit(s) for s in syms])
    u = F.upper(_col(c))
    words = F.array_intersect(sym_arr, F.split(u, P.NON_WORD + "+", -1))
    pairs = vocab.MENTION_PAIRS[dialect]
    if not pairs:
        return F.sort_array(words)
    pair_hits = _pair_hits(u, dialect, syms)
    return F.sort_array(F.array_distinct(F.concat(words, pair_hits)))


def keyword_hit(c, keywords: Sequence[str] = vocab.CRYPTO_KEYWORDS) -> Column:
    """Any keyword as a substring of the lower-cased text ("ape" matches "paper")."""
    low = F.lower(_col(c))
    kws = sorted({k.lower() for k in keywords}, key=len)
    return _or([low.contains(k) for k in kws])


def keyword_count(c, keywords: Sequence[str] = vocab.CRYPTO_KEYWORDS) -> Column:
    """Number of distinct keywords contained (substring) in the lower-cased text."""
    low = F.lower(_col(c))
    kws = sorted({k.lower() for k in keywords})
    return reduce(lambda a, b: a + b, [low.contains(k).cast("int") for k in kws]) if kws else F.lit(0)


def platform_pattern(dialect: str) -> str | None:
    """One alternation per dialect (applied to lower-cased text)."""
    if dialect == "reddit":
        return P.bounded("|".join(vocab.REDDIT_PATTERN_WORDS))
    if dialect == "news":
        parts = [(P.bounded(P.expand(p)) if rb else P.left_bounded(P.expand(p)))
                 for p, rb in vocab.NEWS_PATTERNS]
        return "|".join(parts)
    if dialect == "telegram":
        emoji = "|".join(vocab.TELEGRAM_EMOJI)
        return f"{emoji}|" + P.bounded("|".join(P.expand(p) for p in vocab.TELEGRAM_PATTERNS))
    if dialect == "discord":
        return P.bounded("|".join(P.expand(p) for p in vocab.DISCORD_PATTERNS))
    return None


def any_mention(c, dialect: str = "twitter", symbols: Sequence[str] = vocab.CRYPTO_SYMBOLS) -> Column:
    """``size(mentions(c)) > 0`` without building the array (short-circuits)."""
    syms = [s.upper() for s in symbols]
    u = F.upper(_col(c))
    words = F.arrays_overlap(F.array(*[F.lit(s) for s in syms]), F.split(u, P.NON_WORD + "+", -1))
    if not vocab.MENTION_PAIRS[dialect]:
        return F.coalesce(words, F.lit(False))
    return F.coalesce(words, F.lit(False)) | (F.size(_pair_hits(u, dialect, syms)) > 0)


def relevant(c, dialect: str = "twitter", keywords: Sequence[str] = vocab.CRYPTO_KEYWORDS,
             symbols: Sequence[str] = vocab.CRYPTO_SYMBOLS) -> Column:
    """Keyword substring OR any mention OR a platform pattern (evaluated
    cheapest first; OR short-circuits per row)."""
    x = F.coalesce(_col(c), F.lit(""))
    tests = [keyword_hit(x, keywords)]
    pat = platform_pattern(dialect)
    if pat:
        tests.append(F.lower(x).rlike(pat))
    tests.append(any_mention(x, dialect, symbols))
    return _or(tests)


def news_relevance_score(title, text, url, keywords: Sequence[str] = vocab.CRYPTO_KEYWORDS,
                         symbols: Sequence[str] = vocab.CRYPTO_SYMBOLS,
                         domains: Sequence[str] = vocab.RELEVANCE_DOMAINS) -> Column:
    """Article relevance in [0, 1]."""
    t = F.coalesce(_col(title), F.lit(""))
    b = F.coalesce(_col(text), F.lit(""))
    full = F.lower(F.concat(t, F.lit(" "), b))
    domain = F.coalesce(F.lower(F.parse_url(_col(url), F.lit("AUTHORITY"))), F.lit(""))
    dom = F.when(_or([domain.contains(d) for d in domains]), F.lit(0.3)).otherwise(F.lit(0.0))
    men = F.least(F.size(mentions(full, "news", symbols)) * 0.1, F.lit(0.3))
    tkw = F.least(keyword_count(t, keywords) * 0.15, F.lit(0.4))
    fkw = F.least(keyword_count(full, keywords) * 0.02, F.lit(0.2))
    words = F.size(F.array_remove(F.split(b, P.WS_RUN, -1), ""))
    length = F.when(words > 200, F.lit(0.1)).otherwise(F.lit(0.0))
    return F.least(dom + men + tkw + fkw + length, F.lit(1.0))


def classify_source(domain, classes=vocab.SOURCE_CLASSES) -> Column:
    """First matching class by domain substring, else 'general'."""
    d = F.lower(F.coalesce(_col(domain), F.lit("")))
    out = F.lit("general")
    for name, subs in reversed(classes):
        out = F.when(_or([d.contains(s) for s in subs]), F.lit(name)).otherwise(out)
    return out


def search_symbols(c, symbols: Sequence[str] = vocab.CRYPTO_SYMBOLS,
                   terms: Sequence[str] = vocab.SEARCH_TERMS) -> Column:
    """Symbols whose search terms occur (case-insensitive substring), in
    declared order; explode it to get one row per (item, symbol)."""
    ends = [t.lower().split("{s}") for t in terms]
    wanted = F.array_distinct(F.array(*[F.lit(s) for s in symbols]))
    return _let(F.lower(_col(c)), lambda low: F.filter(wanted, lambda s: _or(
        [low.contains(F.concat(F.lit(a), F.lower(s), F.lit(b))) for a, b in ends])))


def content_tags(platform: str | Column, content_type: str = "text", lang=None) -> Column:
    """Metadata struct (language from the data when given)."""
    lang_col = _col(lang) if lang is not None else F.lit("en")
    return F.struct(lang_col.alias("language"), F.lit(platform).alias("platform"),
                    F.lit(content_type).alias("content_type"))


def mention_rows(df: DataFrame, symbols: DataFrame, text_col: str = "text", id_col: str = "id",
                 max_broadcast_rows: int = 5_000_000) -> DataFrame:
    """J6 for large vocabularies: whole-word mentions as (id, symbol) rows via
    explode + size-checked broadcast equi-join (no per-symbol regex)."""
    from ..operators.broadcast import maybe_broadcast
    toks = (df.select(F.col(id_col), F.explode(F.array_distinct(word_runs(text_col))).alias("symbol"))
            .where(F.col("symbol") != ""))
    sy = maybe_broadcast(symbols.select(F.upper("symbol").alias("symbol")).distinct(), max_broadcast_rows)
    return toks.join(sy, "symbol").select(id_col, "symbol")

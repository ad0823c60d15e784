"""Validation predicates and filters.

Row validators return boolean ``Column``s so that a batch never raises: the
caller splits good and rejected rows with ``split_valid``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from .text import _col, strip_ws


def text_valid(c, max_chars: int = vocab.MAX_TEXT_CHARS) -> Column:
    """V1: non-null text whose stripped length is 1..max_chars."""
    n = F.length(strip_ws(_col(c)))
    return F.coalesce(n.between(1, max_chars), F.lit(False))


def has_text(c) -> Column:
    """Non-null text that is not blank, of any length."""
    return F.coalesce(F.length(strip_ws(_col(c))) >= 1, F.lit(False))


def clean_source(c) -> Column:
    return F.lower(strip_ws(_col(c)))


def source_valid(c, allowed=vocab.ALLOWED_SOURCES) -> Column:
    """V2: lower/strip value in the allow-list."""
    return F.coalesce(clean_source(c).isin(list(allowed)), F.lit(False))


def language_valid(c) -> Column:
    """V3: ``xx`` or ``xx-yy`` after lower/strip; null passes."""
    x = _col(c)
    return F.when(x.isNull(), F.lit(True)).otherwise(
        F.lower(strip_ws(x)).rlike(r"^[a-z]{2}(-[a-z]{2})?$"))


def clean_symbol(c) -> Column:
    return F.upper(strip_ws(_col(c)))


def symbol_valid(c, nullable: bool = False) -> Column:
    """V4: ``^[A-Z0-9]{2,10}$`` after upper/strip (base/quote: nullable=True)."""
    x = _col(c)
    ok = F.coalesce(clean_symbol(x).rlike(r"^[A-Z0-9]{2,10}$"), F.lit(False))
    return F.when(x.isNull(), F.lit(nullable)).otherwise(ok)


def time_range_valid(start, end, max_days: int = 365) -> Column:
    """V5: end after start, and whole days between them at most ``max_days``."""
    s, e = _col(start), _col(end)
    secs = F.unix_micros(e) - F.unix_micros(s)
    days = F.floor(secs / F.lit(86_400_000_000))
    return F.coalesce((e > s) & (days <= max_days), F.lit(False))


def score_valid(value, confidence) -> Column:
    """V6: value in [-1, 1], confidence in [0, 1], neither null nor NaN."""
    v, c = _col(value), _col(confidence)
    ok = (v.between(-1.0, 1.0) & c.between(0.0, 1.0)
          & ~F.isnan(v) & ~F.isnan(c))
    return F.coalesce(ok, F.lit(False))


def clean_method(c) -> Column:
    return F.upper(strip_ws(_col(c)))


def clean_endpoint(c) -> Column:
    e = strip_ws(_col(c))
    return F.when(e.startswith("/"), e).otherwise(F.concat(F.lit("/"), e))


def request_valid(method, endpoint) -> Column:
    """V7: method in the seven verbs and a plain URL path."""
    m_ok = clean_method(method).isin(vocab.HTTP_METHODS)
    e_ok = clean_endpoint(endpoint).rlike(r"^/[a-zA-Z0-9/_\-\.]*$")
    return F.coalesce(m_ok & e_ok, F.lit(False))


def clean_batch_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """V8: trim texts and drop blanks (no HTTP batch cap on a table)."""
    t = strip_ws(F.col(text_col))
    return df.withColumn(text_col, t).where(F.col(text_col) != "")


def split_valid(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows and a reject DataFrame instead of raising."""
    flag = "__valid"
    marked = df.withColumn(flag, F.coalesce(predicate, F.lit(False)))
    return (marked.where(F.col(flag)).drop(flag),
            marked.where(~F.col(flag)).drop(flag))


# --- filters -----------------------------------------------------------------

def min_length(c, n: int) -> Column:
    """F1."""
    return F.coalesce(F.length(_col(c)) >= n, F.lit(False))


def not_tombstone(c) -> Column:
    """``[deleted]`` / ``[removed]`` bodies."""
    return F.coalesce(~_col(c).isin("[deleted]", "[removed]"), F.lit(False))


def not_bot(c) -> Column:
    """F3."""
    return ~F.coalesce(_col(c), F.lit(False))


def recent(ts, as_of, hours_back: int, strict: bool = True) -> Column:
    """``ts > as_of - hours_back`` (strict by default).

    ``as_of`` is explicit (a literal timestamp or column); never the wall clock.
    """
    lo = _as_ts(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours_back))
    return (_col(ts) > lo) if strict else (_col(ts) >= lo)


def _as_ts(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(x).cast("timestamp")


def min_relevance(c, threshold: float = 0.3) -> Column:
    """F5."""
    return F.coalesce(_col(c) >= threshold, F.lit(False))


def confident(c, threshold: float = vocab.MIN_CONFIDENCE) -> Column:
    """F6 (strict)."""
    return F.coalesce(_col(c) > threshold, F.lit(False))


# --- weights -----------------------------------------------------------------

def weights_valid(m, lo: float = 0.95, hi: float = 1.05) -> Column:
    """W1 on a ``MAP<STRING, DOUBLE>`` column."""
    vals = F.map_values(_col(m))
    total = F.aggregate(vals, F.lit(0.0), lambda a, v: a + v)
    ok = ((F.size(vals) > 0)
          & F.forall(vals, lambda v: v.isNotNull() & (v >= 0))
          & total.between(lo, hi))
    return F.coalesce(ok, F.lit(False))


def normalize_weights(m) -> Column:
    """Divide by the sum; a zero sum gives equal weights; empty stays empty."""
    mm = _col(m)
    total = F.aggregate(F.map_values(mm), F.lit(0.0), lambda a, v: a + v)
    n = F.size(F.map_values(mm))
    return F.when(total == 0, F.transform_values(mm, lambda k, v: F.lit(1.0) / n)) \
        .otherwise(F.transform_values(mm, lambda k, v: v / total))


def weights_from_json(c) -> Column:
    """Weights given as a JSON object string."""
    return F.from_json(_col(c), "map<string,double>")

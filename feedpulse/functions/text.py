"""Text cleaning and string scalars.

All functions take and return ``Column`` and compile to native Catalyst
expressions (``regexp_replace``, ``split``, ``parse_url``...), so they stay
inside whole-stage code generation and never cross into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sanitize(c) -> Column:
    """Strip tags, URLs, e-mails, special characters; collapse whitespace.

    Null (non-string) input gives the empty string.
    """
    x = F.coalesce(_col(c), F.lit(""))
    x = F.regexp_replace(x, P.TAG, " ")
    x = F.regexp_replace(x, P.URL, " ")
    x = F.regexp_replace(x, P.EMAIL, " ")
    x = F.regexp_replace(x, P.SPECIAL, " ")
    x = F.regexp_replace(x, P.WS_RUN, " ")
    return F.trim(x)


def replace_urls(c, token: str = "[URL]") -> Column:
    """T2."""
    return F.regexp_replace(_col(c), P.URL_TOKEN, token)


def replace_mentions(c, token: str = "[USER]") -> Column:
    """T3."""
    return F.regexp_replace(_col(c), P.MENTION, token)


def collapse_repeats(c) -> Column:
    """T4: three or more repeats of a character become two."""
    return F.regexp_replace(_col(c), P.REPEAT3, "$1$1")


def social_preprocess(c) -> Column:
    """T5 = T4(T3(T2(T1(c)))), in that order."""
    return collapse_repeats(replace_mentions(replace_urls(sanitize(c))))


def strip_discord_markup(c) -> Column:
    """User mentions, @everyone/@here, channel links, custom emoji."""
    x = _col(c)
    x = F.regexp_replace(x, P.DISCORD_USER, "")
    x = F.regexp_replace(x, P.DISCORD_EVERYONE, "")
    x = F.regexp_replace(x, P.DISCORD_CHANNEL, "")
    x = F.regexp_replace(x, P.DISCORD_EMOJI, "")
    return x


def post_text(title, body) -> Column:
    """``title + '. ' + body``, trimmed."""
    return strip_ws(F.concat(F.coalesce(_col(title), F.lit("")), F.lit(". "),
                             F.coalesce(_col(body), F.lit(""))))


def strip_ws(c) -> Column:
    """Trim Unicode whitespace on both ends (``str.strip`` semantics)."""
    return F.regexp_replace(_col(c), rf"\A{P.WS}+|{P.WS}+\z", "")


def summary(c, n_sentences: int = 3) -> Column:
    """First ``n`` pieces of a split on ``[.!?]+`` joined by '. ', ending in '.'."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), "[.!?]+", -1)
    s = strip_ws(F.array_join(F.slice(parts, 1, n_sentences), ". "))
    return F.when((s != "") & ~s.endswith("."), F.concat(s, F.lit("."))).otherwise(s)


def word_count(c) -> Column:
    """Whitespace-separated word count."""
    toks = F.split(F.coalesce(_col(c), F.lit("")), P.WS_RUN, -1)
    return F.size(F.array_remove(toks, "")).cast("int")


def reading_time(c, words_per_minute: int = 200) -> Column:
    """Integer minutes."""
    return (word_count(c) / F.lit(words_per_minute)).cast("int")


def url_host(c, keep_port: bool = True) -> Column:
    """Lower-cased network location (``AUTHORITY`` keeps a port like netloc)."""
    part = "AUTHORITY" if keep_port else "HOST"
    return F.lower(F.parse_url(_col(c), F.lit(part)))


def has_link(c) -> Column:
    """T11."""
    return F.coalesce(_col(c).rlike(P.LINK), F.lit(False))


def upper(c) -> Column:
    """T12."""
    return F.upper(_col(c))


def lower(c) -> Column:
    """T12."""
    return F.lower(_col(c))


def parse_iso_timestamp(c) -> Column:
    """ISO-8601 string (``Z`` or offset or naive UTC) -> TIMESTAMP."""
    s = F.regexp_replace(_col(c), "Z$", "+00:00")
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in forms])


def epoch_to_timestamp(c) -> Column:
    """Epoch seconds (double) -> TIMESTAMP (UTC session)."""
    return F.timestamp_micros((_col(c) * 1_000_000).cast("long"))


def iso_format(c) -> Column:
    """TIMESTAMP -> ISO string (UTC)."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss")

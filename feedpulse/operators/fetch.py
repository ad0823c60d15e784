"""Source scans over landed records (S1-S4, S7-S12), dedup.

What each platform client does to data, as DataFrame plans:

* a per-key "latest N" is ``row_number`` over ``(key ORDER BY ts DESC, id
  DESC)``; Spark plans it as a ``WindowGroupLimit`` so each partition keeps
  at most N rows per key *before* the shuffle (no hot-key blow-up even if
  one channel holds a third of the rows);
* time windows are explicit ``as_of`` predicates pushed to the scan;
* "posts -> their comments" is an equi-join on the post id (J1);
* membership tests are ``left_semi`` joins against small dimension tables
  (known size -> bounded broadcast, derived -> checked bytes) (J5);
  cross-run dedup is a ``left_anti`` join (J7).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import mentions as M
from ..functions import validate as V
from . import normalize as N
from .broadcast import maybe_broadcast
from .reduction import rows_of

TIME_FILTERS = {"hour": 1, "day": 24, "week": 24 * 7, "month": 24 * 30, "year": 24 * 365}


def _ts(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("timestamp")


def _hours(h: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(h))


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | Column,
                  rank_col: str = "__rn") -> DataFrame:
    """Keep the first ``n`` rows per key in ``order`` (K2, K3, S1-S9 caps)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)
    return out.drop(rank_col)


def dedup_first(df: DataFrame, key: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the first row per id in a deterministic order."""
    keys = [key] if isinstance(key, str) else list(key)
    return top_n_per_key(df, keys, order, 1)


def new_only(df: DataFrame, seen: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose id is not in the stored seen-id table."""
    return df.join(seen.select(key), key, "left_anti")


# --- tweets ------------------------------------------------------------------

def search_tweets(tweets: DataFrame, as_of, symbols: Sequence[str] | None = None, limit: int = 100,
                  hours_back: int = 24, vocabulary: Sequence[str] = vocab.CRYPTO_SYMBOLS,
                  keywords: Sequence[str] = vocab.CRYPTO_KEYWORDS) -> DataFrame:
    """Per-symbol search (X6 terms), English, no retweets, time window,
    at most ``limit`` newest per symbol; then N2 + relevance."""
    symbols = list(symbols) if symbols else list(vocabulary)[:5]  # D10: declared order
    end = _ts(as_of)
    t = tweets.where((F.col("lang") == "en") & ~F.coalesce(F.col("is_retweet"), F.lit(False))
                     & F.col("created_at").between(end - _hours(hours_back), end))
    t = t.withColumn("symbol", F.explode(M.search_symbols("text", symbols)))
    t = top_n_per_key(t, ["symbol"], [F.col("created_at").desc(), F.col("id").desc()], limit)
    n = N.normalize_tweets(t, symbol_col="symbol", symbols=vocabulary)
    return n.where(M.relevant("text", "twitter", keywords, vocabulary))


# --- reddit -------------------------------------------------------------------

def _sort_key(sort_type: str, hot_rank: str | None) -> list[Column]:
    if sort_type == "new":
        return [F.col("created_utc").desc(), F.col("id").desc()]
    if sort_type == "top":
        return [F.col("score").desc(), F.col("id").desc()]
    # "hot" (and unknown sorts) has no public formula: a caller-supplied rank
    if hot_rank:
        return [F.col(hot_rank).asc(), F.col("id").asc()]
    return [F.col("score").desc(), F.col("created_utc").desc(), F.col("id").desc()]


def subreddit_posts(posts: DataFrame, as_of=None, subreddits: Sequence[str] | None = None,
                    limit: int = 100, sort_type: str = "hot", time_filter: str = "day",
                    hot_rank: str | None = None, relevant_only: bool = True) -> DataFrame:
    """Per-subreddit listing (hot/new/top), capped, normalised (N3),
    relevance on the cleaned text (D7)."""
    p = posts
    if subreddits is not None:
        p = p.where(F.col("subreddit").isin(list(subreddits)))
    if sort_type == "top" and time_filter != "all":
        if as_of is None:
            raise ValueError(f"time filter {time_filter!r} needs as_of")
        end = _ts(as_of)
        start = F.unix_timestamp(end - _hours(TIME_FILTERS.get(time_filter, 24)))
        p = p.where(F.col("created_utc") >= start)
    p = top_n_per_key(p, ["subreddit"], _sort_key(sort_type, hot_rank), limit)
    n = N.normalize_posts(p)
    return n.where(M.relevant("text", "reddit")) if relevant_only else n


def post_comments(comments: DataFrame, limit: int = 50, relevant_only: bool = True) -> DataFrame:
    """S3: first ``limit`` comments per post in thread order, N4, relevance."""
    c = top_n_per_key(comments, ["post_id"], [F.col("position").asc(), F.col("id").asc()], limit)
    n = N.normalize_comments(c)
    return n.where(M.relevant("text", "reddit")) if relevant_only else n


def crypto_threads(posts: DataFrame, comments: DataFrame, limit_per_subreddit: int = 50,
                   include_comments: bool = True, max_comments_per_post: int = 20,
                   top_posts: int = 10) -> DataFrame:
    """Posts of every subreddit + up to ``max_comments_per_post``
    comments for each subreddit's ``top_posts`` best-scored relevant posts."""
    p = subreddit_posts(posts, limit=limit_per_subreddit, sort_type="hot")
    if not include_comments:
        return p
    best = top_n_per_key(p.select("id", "subreddit", F.col("metrics.score").alias("score")),
                         ["subreddit"], [F.col("score").desc(), F.col("id").asc()], top_posts)
    # Equi-join post -> comments, whose bodies are not shuffled for it
    c = rows_of(comments, best.select(F.col("id").alias("post_id")), "post_id")
    cm = post_comments(c, limit=max_comments_per_post)
    return N.union_content(p, cm)


# --- channels (telegram / discord) --------------------------------------------------

def channel_messages(messages: DataFrame, as_of, channels: Sequence[str] | None = None,
                     limit: int | None = 100, hours_back: int = 24, platform: str = "telegram",
                     strict: bool = False) -> DataFrame:
    """Newest ``limit`` (None: all) messages per channel inside the window,
    normalised, relevant, deduplicated by message id (D5/D6)."""
    if platform == "telegram":
        ch, ts, mid = "channel", "date", "message_id"
    else:
        ch, ts, mid = "channel_id", "created_at", "message_id"
    m = messages
    if channels is not None:
        m = m.where(F.col(ch).isin(list(channels)))
    lo = _ts(as_of) - _hours(hours_back)
    m = m.where((F.col(ts) > lo) if strict else (F.col(ts) >= lo))
    if limit is not None:
        m = top_n_per_key(m, [ch], [F.col(ts).desc(), F.col(mid).desc()], limit)
    n = N.normalize_telegram(m) if platform == "telegram" else N.normalize_discord(m)
    n = n.where(M.relevant("text", platform))
    return dedup_first(n, "id", [F.col("created_at").desc()])


def monitored_channels(channels: DataFrame, name_col: str = "channel_name",
                       terms: Sequence[str] = vocab.DISCORD_CHANNEL_TERMS) -> DataFrame:
    """Channels whose lower-cased name contains a monitored term."""
    low = F.lower(F.col(name_col))
    cond = F.lit(False)
    for t in terms:
        cond = cond | low.contains(t)
    return channels.where(cond)


def monitored_messages(messages: DataFrame, channels: DataFrame, key: str = "channel_id",
                       channel_rows: int | None = None, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Messages of monitored channels (left-semi join).  A channel
    table of known size is broadcast up to the bound; of a derived one the bytes are checked."""
    mon = monitored_channels(channels).select(key).distinct()
    if channel_rows is not None:
        return messages.join(maybe_broadcast(mon, max_broadcast_rows, known_rows=channel_rows), key, "left_semi")
    return rows_of(messages, mon, key)


def with_channel_info(messages: DataFrame, info: DataFrame, key: str = "channel",
                      info_rows: int | None = None, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """Left join the channel dimension; missing values get defaults.
    A dimension of known size is broadcast up to the bound; otherwise AQE
    decides from the measured size."""
    i = maybe_broadcast(info, max_broadcast_rows, known_rows=info_rows) if info_rows is not None else info
    j = messages.join(i, key, "left")
    return (j.withColumn("channel_title", F.coalesce(F.col("channel_title"), F.lit("")))
             .withColumn("participants_count", F.coalesce(F.col("participants_count"), F.lit(0)))
             .withColumn("channel_type", F.coalesce(F.col("channel_type"), F.lit("channel"))))


# --- API data query (S12) ------------------------------------------------------------

FETCH_SOURCES = ["twitter", "reddit", "news", "telegram", "discord"]


def fetch(content: DataFrame, source: str, as_of, symbol: str | None = None, limit: int = 100,
          hours_back: int = 24) -> DataFrame:
    """Latest ``limit`` content rows of one source within ``hours_back``,
    optionally mentioning ``symbol``; reddit uses a tenth of ``limit``, rounded up, in posts."""
    if source not in FETCH_SOURCES:
        raise ValueError(f"Unsupported source: {source}")
    if limit < 1 or hours_back <= 0:
        raise ValueError("limit and hours_back must be positive")
    n = -(-limit // 10) if source == "reddit" else limit
    c = content.where((F.col("source") == source) & V.recent("created_at", as_of, hours_back, strict=False)
                      & (F.col("created_at") <= _ts(as_of)))
    if symbol:
        c = c.where(F.array_contains(F.col("symbols_mentioned"), symbol.upper()))
    return c.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)

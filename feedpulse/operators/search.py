"""Platform searches (K3, K5, K6, K7).

Each is a filter plus a per-key ``row_number`` cap (planned as a
``WindowGroupLimit`` that prunes map-side) plus a global ``orderBy().limit()``
(``TakeOrderedAndProject``: per-partition top-k, then a single small merge).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fetch as FE
from . import normalize as N


def top_posts(posts: DataFrame, n: int = 10, score_col: str = "score") -> DataFrame:
    """K3: best ``n`` posts per subreddit by score."""
    return FE.top_n_per_key(posts, ["subreddit"], [F.col(score_col).desc(), F.col("id").asc()], n)


def search_discord(messages: DataFrame, channels: DataFrame, query: str, as_of,
                   channel_ids: Sequence[int] | None = None, limit: int = 100,
                   hours_back: int = 168) -> DataFrame:
    """K5: the whole week of every monitored (or given) channel, relevant messages, substring
    match on the cleaned text; of all hits the newest ``limit``."""
    if channel_ids is None:
        m = FE.monitored_messages(messages, channels)
    else:
        m = messages.where(F.col("channel_id").isin(list(channel_ids)))
    hist = FE.channel_messages(m, as_of, limit=None, hours_back=hours_back,
                               platform="discord", strict=True)
    hits = hist.where(F.lower("text").contains(query.lower()))
    return hits.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


def search_telegram(messages: DataFrame, query: str, channels: Sequence[str], limit: int = 100
                    ) -> DataFrame:
    """K6: messages of the channels that contain the query (case-insensitive substring),
    normalised (no relevance filter); of all hits the newest ``limit``."""
    channels = list(channels)
    if not channels:
        raise ValueError("channels must not be empty")
    m = messages.where(F.col("channel").isin(channels) & F.lower("text").contains(query.lower()))
    n = N.normalize_telegram(m)
    return n.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)


SORTS = {"relevance", "hot", "top", "new", "comments"}


def search_reddit(posts: DataFrame, query: str, as_of=None, subreddit: str = "all", limit: int = 100,
                  sort: str = "relevance", time_filter: str = "day") -> DataFrame:
    """K7: posts whose title/body contains any query term; ranked by term
    hits (relevance), score (hot/top), recency (new) or comment count."""
    terms = [t for t in query.lower().split() if t]
    if not terms:
        raise ValueError("query must not be empty")
    p = posts if subreddit == "all" else posts.where(F.col("subreddit") == subreddit)
    if time_filter != "all":
        if as_of is None:
            raise ValueError(f"time filter {time_filter!r} needs as_of")
        end = F.lit(as_of).cast("timestamp")
        start = F.unix_timestamp(end - F.make_dt_interval(F.lit(0), F.lit(FE.TIME_FILTERS.get(time_filter, 24))))
        p = p.where(F.col("created_utc") >= start)
    low = F.lower(F.concat_ws(" ", F.col("title"), F.col("selftext")))
    hits = sum((low.contains(t).cast("int") for t in terms), F.lit(0))
    p = p.withColumn("__hits", hits).where(F.col("__hits") > 0)
    key = {"relevance": [F.col("__hits").desc(), F.col("score").desc()],
           "hot": [F.col("score").desc()], "top": [F.col("score").desc()],
           "new": [F.col("created_utc").desc()], "comments": [F.col("num_comments").desc()]}
    order = key.get(sort, key["relevance"]) + [F.col("id").asc()]
    top = p.orderBy(*order).limit(limit)
    return N.normalize_posts(top.drop("__hits"))

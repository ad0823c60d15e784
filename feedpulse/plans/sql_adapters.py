"""ANSI SQL (DuckDB dialect) text of the adapters and column functions.

These strings are the *oracle* side only: the Spark queries are DataFrame
plans built from ``feedpulse.functions`` / ``feedpulse.operators``.  Both sides
use the same portable regular expressions from ``functions.patterns``.
"""

from __future__ import annotations

from ..functions import patterns as P
from ..sources.adapters import DISCORD_CHANNELS, DISCORD_PREFIX, PLATFORMS, TEMPLATES

q = P.sql_literal


def arr(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


def sanitize(x: str) -> str:
    e = f"coalesce({x}, '')"
    for pat in (P.TAG, P.URL, P.EMAIL, P.SPECIAL):
        e = f"regexp_replace({e}, {q(pat)}, ' ', 'g')"
    e = f"regexp_replace({e}, {q(P.WS_RUN)}, ' ', 'g')"
    return f"trim({e})"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(r'\A' + P.WS + '+|' + P.WS + r'+\z')}, '', 'g')"


def templated(text: str, key: str) -> str:
    return f"({arr(TEMPLATES)}[({key}) % {len(TEMPLATES)} + 1] || ' ' || coalesce({text}, ''))"


def minutes(x: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({x} AS BIGINT)))"


def content(templated_text: bool = False) -> str:
    text = templated("text", "doc_id") if templated_text else "text"
    return f"""SELECT doc_id AS id, {text} AS text, lang,
      {arr(PLATFORMS)}[CAST(replace(source, 'src', '') AS INTEGER) % 5 + 1] AS source,
      {minutes('doc_id')} AS created_at, n_chars
    FROM documents"""


def tweets() -> str:
    return f"""SELECT id, text, created_at, id % 100 AS author_id, lang, id % 9 = 0 AS is_retweet,
      n_chars % 97 AS like_count, n_chars % 31 AS retweet_count, n_chars % 13 AS reply_count,
      CASE WHEN id % 10 = 0 THEN NULL ELSE n_chars % 7 END AS quote_count
    FROM ({content(True)}) c WHERE source = 'twitter'"""


def reddit_posts() -> str:
    body = templated("text", "conv_id")
    return f"""SELECT CAST(conv_id AS VARCHAR) AS id, split_part({body}, chr(10), 1) AS title,
      {body} AS selftext, 'sub' || CAST(conv_id % 8 AS VARCHAR) AS subreddit,
      CAST(1704067200 + conv_id * 600 AS DOUBLE) AS created_utc,
      CASE WHEN conv_id % 17 = 0 THEN NULL ELSE 'user' || CAST(conv_id % 13 AS VARCHAR) END AS author,
      'https://reddit.example/' || CAST(conv_id AS VARCHAR) AS url,
      '/r/sub' || CAST(conv_id % 8 AS VARCHAR) || '/comments/' || CAST(conv_id AS VARCHAR) AS permalink,
      CAST(length(text) AS BIGINT) AS score, (conv_id % 100) / 100.0 AS upvote_ratio,
      conv_id % 50 AS num_comments, conv_id % 3 AS total_awards_received,
      conv_id % 20 = 0 AS stickied, conv_id % 4 AS gilded
    FROM conversations WHERE turn = 0"""


def reddit_comments() -> str:
    body = f"CASE WHEN (conv_id + turn) % 23 = 0 THEN '[deleted]' ELSE {templated('text', 'conv_id + turn')} END"
    return f"""SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS id, {body} AS body,
      CAST(conv_id AS VARCHAR) AS post_id,
      CASE WHEN turn = 1 THEN 't3_' || CAST(conv_id AS VARCHAR)
           ELSE 't1_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn - 1 AS VARCHAR) END AS parent_id,
      CAST(turn AS INTEGER) AS position, CAST(turn - 1 AS INTEGER) AS depth,
      CAST(1704067200 + conv_id * 600 + turn * 60 AS DOUBLE) AS created_utc,
      'user' || CAST((conv_id + turn) % 13 AS VARCHAR) AS author,
      '/r/c/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS permalink,
      CAST(length(text) % 50 AS BIGINT) AS score, role = 'user' AS is_submitter, turn % 2 AS gilded
    FROM conversations WHERE turn > 0"""


def feed_entries() -> str:
    return """SELECT CASE WHEN page_id % 7 = 3 THEN NULL ELSE 'guid-' || CAST(page_id AS VARCHAR) END AS guid,
      'Feed title ' || CAST(page_id AS VARCHAR) AS title,
      'Feed summary ' || CAST(page_id AS VARCHAR) AS summary,
      url AS link,
      TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(page_id AS BIGINT)) AS published_at,
      'http://feed' || CAST(page_id % 5 AS VARCHAR) || '.example.org/rss' AS source_feed,
      CAST(page_id // 5 AS INTEGER) AS position
    FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id, url FROM pages WHERE page_id % 10 = 0) p"""


def telegram_messages() -> str:
    return f"""SELECT '@ch' || CAST(id % 6 AS VARCHAR) AS channel, id AS message_id, text,
      created_at AS date, id % 40 AS sender_id, 'u' || CAST(id % 40 AS VARCHAR) AS sender_username,
      id % 25 = 0 AS sender_is_bot,
      CASE WHEN id % 9 = 0 THEN NULL ELSE n_chars * 3 END AS views,
      n_chars % 11 AS forwards, n_chars % 5 AS reply_count,
      id % 4 = 0 AS has_media, id % 6 = 1 AS is_reply, id % 8 = 2 AS is_forwarded
    FROM ({content(True)}) c WHERE source = 'telegram'"""


def discord_messages() -> str:
    return f"""SELECT id % 3 + 1 AS guild_id, 'guild' || CAST(id % 3 + 1 AS VARCHAR) AS guild_name,
      id % 5 + 100 AS channel_id, {arr(DISCORD_CHANNELS)}[id % 5 + 1] AS channel_name,
      id AS message_id, {q(DISCORD_PREFIX)} || text AS content, created_at,
      CAST(id % 30 AS VARCHAR) AS author_id, 'd' || CAST(id % 30 AS VARCHAR) AS author_username,
      '0001' AS author_discriminator, 'D' || CAST(id % 30 AS VARCHAR) AS author_display_name,
      id % 20 = 0 AS author_is_bot,
      n_chars % 5 + n_chars % 3 AS reactions_count,
      CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END AS mentions_count
    FROM ({content(True)}) c WHERE source = 'discord'"""


def request_log() -> str:
    return """SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(user_id AS VARCHAR) AS key,
      '/' || event_type AS endpoint, CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method,
      CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
      value AS duration_ms, event_type = 'error' AS is_failure, event_type
    FROM events"""


def stub_scores(content_sql: str) -> str:
    return f"""SELECT id, source, created_at, 'transformer' AS model,
      CAST((id * 7) % 201 - 100 AS DOUBLE) / 100.0 AS value, CAST((id * 13) % 101 AS DOUBLE) / 100.0 AS confidence,
      id % 11 <> 0 AS ok
    FROM ({content_sql}) c"""


def fmt_ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def collapse_repeats(x: str) -> str:
    """T4 without back-references: drop a character equal to both of its two
    predecessors (newline excluded), via shifted character lists."""
    cs = f"string_split({x}, '')"
    p1 = f"list_concat([NULL::VARCHAR], list_slice({cs}, 1, len({cs}) - 1))"
    p2 = f"list_concat([NULL::VARCHAR, NULL::VARCHAR], list_slice({cs}, 1, len({cs}) - 2))"
    keep = (f"list_filter(list_zip({cs}, {p1}, {p2}), "
            f"lambda p: NOT (p[1] <> chr(10) AND coalesce(p[1] = p[2] AND p[1] = p[3], false)))")
    return f"array_to_string(list_transform({keep}, lambda p: p[1]), '')"


def social_preprocess() -> str:
    """T5 over the templated content: (id, out)."""
    x = sanitize("text")
    x = f"regexp_replace({x}, {q(P.URL_TOKEN)}, '[URL]', 'g')"
    x = f"regexp_replace({x}, {q(P.MENTION)}, '[USER]', 'g')"
    return f"SELECT id, {collapse_repeats(x)} AS out FROM ({content(True)}) c"

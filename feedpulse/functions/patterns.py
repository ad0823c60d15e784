"""Portable regular expressions.

Python's ``\\w``/``\\s``/``\\b`` are Unicode-aware; Java's and RE2's are ASCII.
Every pattern here is written with explicit classes so that Spark (Java
regex) and a DuckDB oracle (RE2) give the same answer as the Unicode
semantics the operators reproduce.  RE2 has no look-around, so a word
boundary around a literal is spelled as an alternation with ``^``/``$``.
"""

from __future__ import annotations

import re

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
WS_CHARS = r"\t\n\x0B\f\r \x1c-\x1f\x{85}\p{Z}"
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"

# sanitize chain
TAG = r"<[^>]+>"
# URL alphabet: a-z, A-Z, 0-9, the range '$'..'_' (which also covers
# '%XX' escapes, '@', '.', '&', '+', '(', ')', '*', ',' and '\'), plus '!'.
URL = r"http[s]?://[!$-_a-z]+"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
SPECIAL = rf"[^\p{{L}}\p{{N}}_{WS_CHARS}.,!?:;\-()'\"]+"
WS_RUN = f"{WS}+"

# social preprocessing
URL_TOKEN = rf"http[s]?://{NON_WS}+"
MENTION = rf"@{WORD}+"
# '.' in the reproduced semantics excludes only '\n' (Java's also excludes
# '\r', U+0085, U+2028, U+2029), so the class is explicit.
REPEAT3 = r"([^\n])\1{2,}"

# discord markup
DISCORD_USER = r"<@!?[0-9]+>"
DISCORD_EVERYONE = r"@(everyone|here)"
DISCORD_CHANNEL = r"<#[0-9]+>"
DISCORD_EMOJI = r"<a?:[0-9A-Za-z_]+:[0-9]+>"

LINK = r"https?://"


def bounded(body: str) -> str:
    """``\\b body \\b`` for a body that starts and ends with word characters."""
    return f"(^|{NON_WORD})({body})($|{NON_WORD})"


def left_bounded(body: str) -> str:
    return f"(^|{NON_WORD})({body})"


def right_bounded(body: str) -> str:
    return f"({body})($|{NON_WORD})"


def expand(template: str) -> str:
    """Expand ``{s}`` placeholders in vocabulary patterns to the whitespace class."""
    return template.replace("{s}", WS)


def sql_literal(s: str) -> str:
    """Quote a string for an ANSI SQL literal (no backslash escaping)."""
    return "'" + s.replace("'", "''") + "'"


def literal_regex(word: str) -> str:
    """Escape a vocabulary word for use inside a Java/RE2 pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}/-])", r"\\\1", word)

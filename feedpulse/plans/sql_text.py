"""DuckDB oracle text for mentions, relevance and scores."""

from __future__ import annotations

from .. import vocab
from ..functions import mentions as M
from ..functions import patterns as P
from . import sql_adapters as S

q = S.q


def mentions_list(x: str, dialect: str, symbols=vocab.CRYPTO_SYMBOLS) -> str:
    syms = [s.upper() for s in symbols]
    u = f"upper({x})"
    words = f"list_intersect({S.arr(syms)}, regexp_split_to_array({u}, {q(P.NON_WORD + '+')}))"
    pairs = vocab.MENTION_PAIRS[dialect]
    if not pairs:
        return f"list_sort(list_distinct({words}))"
    per = []
    for sym in syms:
        tests = []
        for t, rb in pairs:
            lit = t.replace("{S}", sym)
            if rb:
                tests.append(f"regexp_matches({u}, {q(P.literal_regex(lit) + '($|' + P.NON_WORD + ')')})")
            else:
                tests.append(f"contains({u}, {q(lit)})")
        per.append(f"CASE WHEN {' OR '.join(tests)} THEN {q(sym)} END")
    suffixes = sorted({t.replace("{S}", "").lstrip("/-") for t, _ in pairs})
    guard = " OR ".join(f"contains({u}, {q(sfx)})" for sfx in suffixes)
    pair = (f"CASE WHEN {guard} THEN list_filter([{', '.join(per)}], lambda z: z IS NOT NULL) "
            f"ELSE CAST([] AS VARCHAR[]) END")
    return f"list_sort(list_distinct(list_concat({words}, {pair})))"


def mentions_str(x: str, dialect: str, symbols=vocab.CRYPTO_SYMBOLS) -> str:
    return f"array_to_string({mentions_list(x, dialect, symbols)}, ',')"


def keyword_hit(x: str, keywords=vocab.CRYPTO_KEYWORDS) -> str:
    kws = sorted({k.lower() for k in keywords}, key=len)
    return "(" + " OR ".join(f"contains(lower({x}), {q(k)})" for k in kws) + ")"


def keyword_count(x: str, keywords=vocab.CRYPTO_KEYWORDS) -> str:
    kws = sorted({k.lower() for k in keywords})
    return "(" + " + ".join(f"CAST(contains(lower({x}), {q(k)}) AS INTEGER)" for k in kws) + ")"


def relevant(x: str, dialect: str, keywords=vocab.CRYPTO_KEYWORDS, symbols=vocab.CRYPTO_SYMBOLS) -> str:
    xx = f"coalesce({x}, '')"
    tests = [keyword_hit(xx, keywords), f"len({mentions_list(xx, dialect, symbols)}) > 0"]
    pat = M.platform_pattern(dialect)
    if pat:
        tests.append(f"regexp_matches(lower({xx}), {q(pat)})")
    return "(" + " OR ".join(tests) + ")"


def authority(url: str) -> str:
    return f"lower(regexp_extract({url}, {q(r'^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)')}, 1))"


def relevance_score(title: str, text: str, url: str) -> str:
    t, b = f"coalesce({title}, '')", f"coalesce({text}, '')"
    full = f"lower({t} || ' ' || {b})"
    dom = " OR ".join(f"contains(coalesce({authority(url)}, ''), {q(d)})" for d in vocab.RELEVANCE_DOMAINS)
    words = f"len(list_filter(regexp_split_to_array({b}, {q(P.WS_RUN)}), lambda w: w <> ''))"
    return (f"least((CASE WHEN {dom} THEN 0.3 ELSE 0.0 END)"
            f" + least(len({mentions_list(full, 'news')}) * 0.1, 0.3)"
            f" + least({keyword_count(t)} * 0.15, 0.4)"
            f" + least({keyword_count(full)} * 0.02, 0.2)"
            f" + (CASE WHEN {words} > 200 THEN 0.1 ELSE 0.0 END), 1.0)")


def classify_source(domain: str) -> str:
    d = f"lower(coalesce({domain}, ''))"
    parts = []
    for name, subs in vocab.SOURCE_CLASSES:
        cond = " OR ".join(f"contains({d}, {q(s)})" for s in subs)
        parts.append(f"WHEN {cond} THEN {q(name)}")
    return f"CASE {' '.join(parts)} ELSE 'general' END"


def search_symbols(x: str, symbols=vocab.CRYPTO_SYMBOLS, terms=vocab.SEARCH_TERMS) -> str:
    per = []
    for s in symbols:
        cond = " OR ".join(f"contains(lower({x}), {q(t.replace('{S}', s).lower())})" for t in terms)
        per.append(f"CASE WHEN {cond} THEN {q(s)} END")
    return f"list_filter([{', '.join(per)}], lambda x: x IS NOT NULL)"

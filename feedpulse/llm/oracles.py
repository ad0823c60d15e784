"""DuckDB SQL of the registered queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op6_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""

SQL["op8_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
occ AS (
  SELECT p.doc_id, p.i, z.n, array_to_string(p.w[p.i : p.i + z.n - 1], ' ') AS s
  FROM pos p JOIN sizes z ON p.i + z.n - 1 <= len(p.w)),
hit AS (SELECT o.doc_id, o.i, o.n, win.item_id FROM occ o JOIN win USING (n, s)),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hit),
nh AS (SELECT doc_id, count(*) AS n_hit FROM cov GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(nh.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(ni.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ni.ids, '')) AS items_sha256,
       coalesce(nh.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""

SQL["op5_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS m FROM win) WHERE m < doc_id),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM dup),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n
  FROM word ANTI JOIN cov USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

SQL["op2_jaccard_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_sides AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM both_sides JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id
"""

SQL["op11_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS of_lang FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
lang_total AS (SELECT lang, count(*) AS v, sum(of_lang) AS n FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (
  SELECT g.lang, g.source, coalesce(n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY lang, source) USING (lang, source)),
share AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         CAST(1 + 1000000000 * (coalesce(c.c, 0) + 1) // (g.n + l.v) AS BIGINT) AS p
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN lang_total l ON l.lang = g.lang
  LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         CAST(coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM share x JOIN share y ON x.lang = y.lang AND x.term = y.term
                        WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
term AS (
  SELECT s.lang, s.source, 'term' AS part, s.term AS item, (p - q) * (p - q) // q AS value
  FROM share s JOIN (SELECT k.lang, k.term, CAST(1 + 1000000000 * (k.of_lang + 1) // (l.n + l.v) AS BIGINT) AS q
                     FROM kept k JOIN lang_total l USING (lang)) z ON z.lang = s.lang AND z.term = s.term
  WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def _merkle(name: str, leaves: str, levels: int = 6) -> str:
    """CTEs of trees with 16 children a node over ``leaves(tree, idx, h, n)``, unrolled to 16^levels
    leaves a tree: ``{name}_root(tree, h)`` and ``{name}_path(tree, idx, steps)``, where steps
    lists [left, right] siblings from the leaf up."""
    out = [f"{name}_0 AS (SELECT tree, idx, h, n FROM {leaves})"]
    for k in range(levels):
        out.append(f"""{name}_{k + 1} AS (
  SELECT tree, idx // 16 AS idx, sha256(string_agg(h, '' ORDER BY idx)) AS h, any_value((n + 15) // 16) AS n
  FROM {name}_{k} WHERE n > 1 GROUP BY tree, idx // 16)""")
    ends = " UNION ALL ".join(f"SELECT tree, h FROM {name}_{k} WHERE n = 1" for k in range(levels + 1))
    out.append(f"{name}_root AS ({ends})")
    out.append(f"{name}_p{levels} AS (SELECT tree, idx, CAST([] AS VARCHAR[][]) AS steps FROM {name}_{levels})")
    for k in reversed(range(levels)):
        run = "PARTITION BY c.tree, c.idx // 16 ORDER BY c.idx ROWS BETWEEN"
        out.append(f"""{name}_p{k} AS (
  SELECT c.tree, c.idx, CASE WHEN c.n = 1 THEN CAST([] AS VARCHAR[][]) ELSE
    [[coalesce(string_agg(c.h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
      coalesce(string_agg(c.h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')]] || p.steps END AS steps
  FROM {name}_{k} c LEFT JOIN {name}_p{k + 1} p ON c.n > 1 AND p.tree = c.tree AND p.idx = c.idx // 16)""")
    out.append(f"{name}_path AS (SELECT tree, idx, steps FROM {name}_p0)")
    return ",\n".join(out)


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || {column} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: crc32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""

SQL["op12_merkle_manifest"] = f"""
WITH d AS (
  SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
            ELSE {_leaf('text')} END AS held, {_leaf('text')} AS leaf FROM documents),
l AS (
  SELECT doc_id, leaf, held, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
bottom AS (SELECT tree, idx, leaf AS h, n FROM l),
{_merkle("s", "bottom")},
heads AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS idx, h, count(*) OVER () AS n, tree AS name FROM s_root),
{_merkle("t", "heads", 3)},
proof AS (
  SELECT l.doc_id, l.leaf, l.held, heads.h AS subroot, s_path.steps || t_path.steps AS steps
  FROM l JOIN s_path USING (tree, idx) JOIN heads ON heads.name = l.tree JOIN t_path ON t_path.idx = heads.idx),
done AS (
  SELECT doc_id, leaf, subroot, (SELECT h FROM t_root) AS root,
         sha256(array_to_string(list_transform(steps, lambda s: s[1] || s[2]), '')) AS proof_sha256,
         CASE WHEN len(steps) = 0 THEN held ELSE list_reduce(list_prepend([held, ''], steps), lambda a, s: [sha256(s[1] || a[1] || s[2]), ''])[1] END AS folded_root
  FROM proof)
SELECT *, folded_root = root AS verified FROM done
"""

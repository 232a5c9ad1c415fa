"""DuckDB SQL for the queries that SQL can express, on views of the same tables."""

from __future__ import annotations

from phenoline.llm.host_reputation import TWO_LABEL_SUFFIXES
from phenoline.llm.license_diagonals import GAP, PASSAGES, PHRASES

OP2 = """
WITH l AS (
  SELECT doc_id, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
bad AS (SELECT trim(line, ' ') AS k FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10),
flag AS (
  SELECT doc_id, pos, line, trim(line, ' ') <> '' AND trim(line, ' ') IN (SELECT k FROM bad) AS hit FROM l),
d AS (
  SELECT doc_id, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit AND trim(line, ' ') <> '') AS own,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '') AS rest
  FROM flag GROUP BY 1)
SELECT t.doc_id, CASE WHEN hits > 0 AND own > 0 THEN rest ELSE text END AS text, lang, source, n_chars,
  CAST(CASE WHEN hits > 0 AND own > 0 THEN hits ELSE 0 END AS BIGINT) AS n_removed
FROM documents t LEFT JOIN d USING (doc_id)
"""

_SUFFIXES = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_POSTERIOR = "(k + s * m) / (n + s)"
_STRENGTH = """CASE WHEN sum(n * (k / n - m) * (k / n - m) / (m * (1 - m))) IS NULL OR sum(n) <= count(*) THEN 9.0
  ELSE 1 / least(0.9, greatest(1e-3, (sum(n * (k / n - m) * (k / n - m) / (m * (1 - m))) - count(*)) / (sum(n) - count(*)))) - 1 END"""

OP4 = f"""
WITH u AS (
  SELECT page_id, url, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
v AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM u),
o AS (SELECT v.host, quality FROM v LEFT JOIN labels ON labels.doc_id = try_cast(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1) AS BIGINT)),
h AS (
  SELECT host, count(quality) AS n, coalesce(sum(quality), 0) AS k,
    CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(string_split(host, '.')[-3:], '.')
      ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
    CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({_SUFFIXES}) THEN array_to_string(string_split(host, '.')[-2:], '.')
      ELSE string_split(host, '.')[-1] END AS suffix
  FROM o GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM h) AS m FROM h GROUP BY suffix),
s1 AS (SELECT suffix, {_POSTERIOR} AS mean FROM s0, (SELECT {_STRENGTH} AS s FROM s0 WHERE n > 0)),
d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(s1.mean) AS m FROM h JOIN s1 USING (suffix) GROUP BY suffix, domain),
d1 AS (SELECT domain, {_POSTERIOR} AS mean FROM d0, (SELECT {_STRENGTH} AS s FROM d0 WHERE n > 0)),
h0 AS (SELECT host, n, k, d1.mean AS m FROM h JOIN d1 USING (domain)),
h1 AS (SELECT host, n, s, {_POSTERIOR} AS mean FROM h0, (SELECT {_STRENGTH} AS s FROM h0 WHERE n > 0)),
r AS (SELECT host, mean - 1.645 * sqrt(mean * (1 - mean) / (n + s + 1)) AS bound FROM h1),
g(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
best AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM v, g
  WHERE (host = split_part(rule, '/', 1) OR suffix(host, '.' || split_part(rule, '/', 1)))
    AND prefix(path, substr(rule, length(split_part(rule, '/', 1)) + 1)) GROUP BY page_id)
SELECT v.page_id, v.host, path, best.rule, coalesce(best.verdict, CASE WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict,
  round(bound, 6) AS bound
FROM v LEFT JOIN best USING (page_id) LEFT JOIN r ON r.host = v.host
"""

_TEMPLATES = ", ".join(
    f"({i}, {'true' if i < len(PHRASES) else 'false'}, '{label}', string_split('{text}', ' '))"
    for i, (text, label) in enumerate([*PHRASES, *PASSAGES])
)

OP5 = f"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(words) - 1)) AS pos, words FROM w WHERE len(words) > 1),
t(template, exact, label, words) AS (VALUES {_TEMPLATES}),
q AS (SELECT template, exact, label, len(words) - 1 AS pairs, unnest(range(0, len(words) - 1)) AS place, words FROM t),
q2 AS (SELECT template, exact, label, pairs, place, words[place + 1] AS a, words[place + 2] AS b FROM q),
votes AS (
  SELECT doc_id, template, exact, label, pairs, pos - place AS diagonal, bit_or(1::BIGINT << place) AS seen, min(pos) AS low, max(pos) AS high
  FROM p JOIN q2 ON p.words[pos + 1] = q2.a AND p.words[pos + 2] = q2.b GROUP BY ALL),
kept AS (SELECT * FROM votes WHERE exact OR bit_count(seen) >= 2),
marked AS (
  SELECT *, CASE WHEN NOT exact AND diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS starts
  FROM kept),
spans AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked),
merged AS (
  SELECT doc_id, template, exact, label, bit_count(bit_or(seen)) / pairs AS share, min(low) AS low
  FROM spans GROUP BY doc_id, template, exact, label, pairs, span),
held AS (SELECT * FROM merged WHERE CASE WHEN exact THEN share = 1 ELSE share >= 0.7 END),
found AS (
  SELECT doc_id, count(*) FILTER (WHERE exact) AS n_base, min(low) FILTER (WHERE exact) AS first_word, max(low) FILTER (WHERE exact) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE exact)), ',') AS base_labels,
    array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
  FROM held GROUP BY doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM w LEFT JOIN found USING (doc_id)
"""

# Rates are built by Spark's counts; here they follow from the same counts, and quantiles by the same recursion.
OP10 = """
WITH RECURSIVE w(g, share) AS (VALUES ('src0', 0.15), ('src1', 0.08), ('src2', 0.08), ('src3', 0.08)),
d AS (SELECT *, CASE WHEN source IN (SELECT g FROM w) THEN source ELSE '' END AS grp FROM documents),
n AS (SELECT grp, count(*) AS n FROM d GROUP BY grp),
shares AS (SELECT grp, n, CASE WHEN grp = '' THEN 1.0::DOUBLE - (0.15::DOUBLE + 0.08::DOUBLE + 0.08::DOUBLE + 0.08::DOUBLE) ELSE (SELECT share::DOUBLE FROM w WHERE g = grp) END AS share FROM n),
rate AS (SELECT grp, share / (SELECT sum(share) FROM shares) * (SELECT sum(n) FROM n) / n AS r FROM shares),
cdf(grp, r, k, p, total) AS (
  SELECT grp, r, 0, exp(-r), exp(-r) FROM rate
  UNION ALL SELECT grp, r, k + 1, p * r / (k + 1), total + p * r / (k + 1) FROM cdf WHERE k < 60),
drawn AS (
  SELECT d.*, CAST('0x' || substr(md5('7|' || doc_id || '|0'), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM d),
times AS (SELECT doc_id, (SELECT count(*) FROM cdf WHERE cdf.grp = drawn.grp AND total <= u) AS times FROM drawn),
copies AS (SELECT doc_id, unnest(range(0, times)) AS copy FROM times)
SELECT d.doc_id, text, lang, source, n_chars, CAST(copy AS INT) AS copy,
  CAST('0x' || substr(md5('7-order|' || d.doc_id || '|' || copy), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS position
FROM copies JOIN documents d USING (doc_id)
"""

def _field(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_TAMPERED = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "(n_chars + 1)", "text"))
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
  lambda c, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295))"""

# Nodes are grouped by their parent; paths come from the nodes beside a leaf's ancestors, and folds go up node by node.
OP13 = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_LEAF}) AS leaf,
    CASE WHEN {_CRC} % 7 = 0 THEN sha256({_TAMPERED}) ELSE sha256({_LEAF}) END AS shown FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS m FROM leaf),
up(tree, lvl, idx, m, h) AS (
  SELECT tree, 0::BIGINT, idx, m, leaf FROM placed
  UNION ALL SELECT tree, lvl + 1, idx // 2, any_value(m + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE m > 1 GROUP BY tree, lvl, idx // 2),
sub AS (SELECT tree, lvl AS height, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS m FROM up WHERE m = 1),
crown(lvl, idx, m, h) AS (
  SELECT 0::BIGINT, place, m, subroot FROM sub
  UNION ALL SELECT lvl + 1, idx // 2, any_value(m + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM crown WHERE m > 1 GROUP BY lvl, idx // 2),
root AS (SELECT h AS root, lvl AS height FROM crown WHERE m = 1),
steps AS (
  SELECT p.doc_id, p.tree, p.idx, u.lvl, u.h, (p.idx >> u.lvl) & 1 AS side FROM placed p JOIN up u ON u.tree = p.tree AND u.m > 1 AND u.idx = xor(p.idx >> u.lvl, 1)
  UNION ALL
  SELECT p.doc_id, p.tree, p.idx, s.height + c.lvl, c.h, (s.place >> c.lvl) & 1
  FROM placed p JOIN sub s ON s.tree = p.tree JOIN crown c ON c.m > 1 AND c.idx = xor(s.place >> c.lvl, 1)),
proofs AS (SELECT tree, idx, sha256(string_agg(h, '' ORDER BY lvl)) AS proof FROM steps GROUP BY tree, idx),
fold(tree, idx, lvl, node) AS (
  SELECT tree, idx, 0::BIGINT, shown FROM placed
  UNION ALL
  SELECT f.tree, f.idx, f.lvl + 1, sha256(CASE WHEN t.side = 1 THEN t.h || f.node WHEN t.side = 0 THEN f.node || t.h ELSE f.node END)
  FROM fold f JOIN sub s ON s.tree = f.tree CROSS JOIN root LEFT JOIN steps t ON t.tree = f.tree AND t.idx = f.idx AND t.lvl = f.lvl
  WHERE f.lvl < s.height + root.height)
SELECT p.doc_id, p.leaf, s.subroot, root.root, coalesce(proof, sha256('')) AS proof_sha256, f.node AS folded_root, f.node = root.root AS verified
FROM placed p JOIN sub s USING (tree) CROSS JOIN root LEFT JOIN proofs q ON q.tree = p.tree AND q.idx = p.idx
JOIN fold f ON f.tree = p.tree AND f.idx = p.idx AND f.lvl = s.height + root.height
"""

ORACLES = {
    "op2_line_spread": OP2,
    "op4_host_reputation": OP4,
    "op5_license_diagonals": OP5,
    "op10_poisson_mix": OP10,
    "op13_merkle_manifest": OP13,
}

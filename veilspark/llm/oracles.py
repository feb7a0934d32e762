"""DuckDB SQL with the results of those queries that SQL can express.

Not here, and tested against brute force instead: op2 (a tokenizer), op4 (alignments of templates), op5
(a suffix tree), op6 (XXH64), op7 (a learned model), op8 (crc32).
"""

OP3 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rules(kind, rank, base, pattern, grp, least) AS (VALUES
  ('assign', 0, true, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, true, 'AKIA[A-Z0-9]+', 0, 20),
  ('hex', 2, true, '[0-9a-f]{24,}', 0, 24),
  ('github', 3, false, 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 1),
  ('slack', 4, false, 'xox[abprs]-[A-Za-z0-9-]{10,}', 0, 1),
  ('jwt', 5, false, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 1),
  ('pem', 6, false, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1)),
found AS (
  SELECT doc_id, 'assign' AS kind, t, regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m,
         regexp_extract_all(t, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v FROM d
  UNION ALL SELECT doc_id, 'access', t, regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS m, m FROM d
  UNION ALL SELECT doc_id, 'hex', t, regexp_extract_all(t, '[0-9a-f]{24,}') AS m, m FROM d
  UNION ALL SELECT doc_id, 'github', t, regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}') AS m, m FROM d
  UNION ALL SELECT doc_id, 'slack', t, regexp_extract_all(t, 'xox[abprs]-[A-Za-z0-9-]{10,}') AS m, m FROM d
  UNION ALL SELECT doc_id, 'jwt', t, regexp_extract_all(t, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}') AS m, m FROM d
  UNION ALL SELECT doc_id, 'pem', t, regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----') AS m, m FROM d),
walked AS (
  SELECT doc_id, kind, list_reduce(list_prepend({'rest': t, 'at': 0::BIGINT, 's': 0::BIGINT, 'e': 0::BIGINT, 'out': []::STRUCT(s BIGINT, e BIGINT, n BIGINT)[]},
    list_transform(list_zip(m, v), lambda x: {'rest': x[1], 'at': 0::BIGINT, 's': 0::BIGINT, 'e': length(x[2]), 'out': []::STRUCT(s BIGINT, e BIGINT, n BIGINT)[]})),
    lambda a, x: {
      'rest': substr(a.rest, strpos(a.rest, x.rest) + length(x.rest)),
      'at': a.at + strpos(a.rest, x.rest) - 1 + length(x.rest), 's': 0::BIGINT, 'e': 0::BIGINT,
      'out': list_append(a.out, {'s': a.at + strpos(a.rest, x.rest) - 1, 'e': a.at + strpos(a.rest, x.rest) - 1 + length(x.rest), 'n': x.e})}) AS w
  FROM found WHERE len(m) > 0),
spans AS (
  SELECT doc_id, r.kind, r.rank, r.base, o.s, o.e FROM (SELECT doc_id, kind, unnest(w.out) AS o FROM walked) w JOIN rules r USING (kind) WHERE o.n >= r.least),
per AS (
  SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (base), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""

OP9 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS k
  FROM bw, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS u(i) WHERE len(w) > 0),
grams AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k
  FROM dw, (SELECT DISTINCT n FROM windows) s, unnest(range(1, len(w) - n + 2)) AS u(p)),
hits AS (SELECT g.doc_id, g.p, g.n, b.item_id FROM grams g JOIN windows b USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, p, n FROM hits) h, unnest(range(p, p + n)) AS u(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10 = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
repeated AS (SELECT k, min(doc_id) AS first_doc FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT lines.*, first_doc IS NOT NULL AND doc_id > first_doc AS gone FROM lines LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _op1() -> str:
    from .quality_rules import COMMON_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE, MIN_BLANK, MIN_CHARS, MIN_WORDS, OTHER, WORD_PART

    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    lists = ", ".join(f"('{lang}', {words!r})" for lang, words in [*COMMON_WORDS.items(), (OTHER, every)])
    langs = ", ".join(f"'{x}'" for x in COMMON_WORDS)

    def distance(p: str, q: str) -> str:
        shares = f"list_transform(list_zip({p}, {q}), lambda s: [s[1] / list_sum({p}), s[2] / list_sum({q})])"
        term = "lambda s: CASE WHEN s[1] > 0 THEN s[1] * log2(2 * s[1] / (s[1] + s[2])) ELSE 0 END + CASE WHEN s[2] > 0 THEN s[2] * log2(2 * s[2] / (s[1] + s[2])) ELSE 0 END"
        return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(0, list_sum(list_transform({shares}, {term})) / 2)) END"

    return rf"""
WITH lists(lang_ref, listed) AS (VALUES {lists}),
d AS (
  SELECT doc_id, CASE WHEN lang IN ({langs}) THEN lang ELSE '{OTHER}' END AS lang_ref, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS k FROM d, unnest(range(1, len(w) - 6)) AS u(p)),
twice AS (SELECT doc_id, p FROM win JOIN (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1) USING (doc_id, k)),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM twice, unnest(range(p, p + 8)) AS u(q) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, d.lang_ref, length(t) AS n_chars, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[a-z]+', '', 'g')) AS c1, length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS c2,
    length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS c3, length(t) - length(regexp_replace(t, '[0-9]+', '', 'g')) AS c4,
    length(t) - length(regexp_replace(t, '[.,;:!?''"()-]+', '', 'g')) AS c5,
    list_transform(listed, lambda x: len(list_filter(w, lambda y: lower(y) = x))) AS hits
  FROM d JOIN lists USING (lang_ref) LEFT JOIN rep USING (doc_id)),
h AS (
  SELECT *, [c1, c2, c3, c4, c5, n_symbols, n_chars - c1 - c2 - c3 - c4 - c5 - n_symbols] AS chars, list_append(hits, n_words - list_sum(hits)) AS words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
refs AS (
  SELECT * FROM (SELECT lang_ref, list(n ORDER BY i) AS ref_chars FROM (SELECT lang_ref, i, sum(chars[i]) AS n FROM h, unnest(range(1, 8)) AS u(i) WHERE NOT base_failed GROUP BY 1, 2) GROUP BY 1)
  JOIN (SELECT lang_ref, list(n ORDER BY i) AS ref_words FROM (SELECT lang_ref, i, sum(words[i]) AS n FROM h, unnest(range(1, len(words) + 1)) AS u(i) WHERE NOT base_failed GROUP BY 1, 2) GROUP BY 1) USING (lang_ref)),
blanks AS (SELECT lang_ref, {distance("list_transform(ref_words, lambda x, i: CASE WHEN i = len(ref_words) THEN 1 ELSE 0 END)", "ref_words")} AS blank FROM refs),
limits AS (SELECT lang_ref, CASE WHEN blank >= {MIN_BLANK} THEN least({MAX_WORD_DISTANCE}, blank * {WORD_PART}) ELSE {MAX_WORD_DISTANCE} END AS most FROM blanks)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(CASE WHEN n_chars >= {MIN_CHARS} THEN {distance("chars", "ref_chars")} END, 0) <= {MAX_CHAR_DISTANCE}
    AND coalesce(CASE WHEN n_words >= {MIN_WORDS} THEN {distance("words", "ref_words")} END, 0) <= coalesce(most, {MAX_WORD_DISTANCE}) AS kept
FROM h LEFT JOIN refs USING (lang_ref) LEFT JOIN limits USING (lang_ref)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1(), "op3_secret_scan": OP3, "op9_decontamination": OP9, "op10_line_dedup": OP10}

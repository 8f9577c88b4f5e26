"""DuckDB SQL for the queries that SQL can express."""

_WORD = r"'[^\x20\x09-\x0D]+'"

OP8 = f"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3) + 1] AS w,
              2.0::DOUBLE * source_size AS cap, SUM(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget FROM s0),
s2 AS (SELECT *, cap / w AS r, SUM(w) OVER () AS w_all,
              SUM(cap) OVER (ORDER BY cap / w RANGE UNBOUNDED PRECEDING) AS cap_le,
              SUM(w) OVER (ORDER BY cap / w RANGE UNBOUNDED PRECEDING) AS w_le FROM s1),
s3 AS (SELECT *, cap_le + (w_all - w_le) * r <= budget AS is_full FROM s2),
s4 AS (SELECT *, SUM(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS full_cap, SUM(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS open_w FROM s3),
t AS (SELECT source, source_size, COALESCE(CASE WHEN is_full THEN cap ELSE (budget - full_cap) * w / open_w END, 0.0)::DOUBLE AS target FROM s4),
p AS (SELECT *, CASE WHEN source_size > 0 THEN LEAST(2, FLOOR(target / source_size)) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole,
             SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN whole < 2 AND upto <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

_WS = f"regexp_extract_all(COALESCE(text, ''), {_WORD})"

OP9 = f"""
WITH w AS (SELECT doc_id, {_WS} AS ws FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
c AS (SELECT h FROM p GROUP BY h HAVING COUNT(*) > 1),
bad AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM p JOIN c USING (h)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
k AS (SELECT words.doc_id, COUNT(*) AS n_words, COUNT(bad.j) AS n_removed,
             sha256(COALESCE(string_agg(word, ' ' ORDER BY words.j) FILTER (WHERE bad.j IS NULL), '')) AS kept_sha256
      FROM words LEFT JOIN bad ON words.doc_id = bad.doc_id AND words.j = bad.j GROUP BY words.doc_id)
SELECT w.doc_id, COALESCE(n_words, 0)::BIGINT AS n_words, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(kept_sha256, sha256('')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""

_RULES = {"symbol_rate": ("n_symbols", "word_chars"), "upper_rate": ("n_upper", "word_chars"), "punct_rate": ("n_punct", "word_chars"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words")}
_BINS = ", ".join(f"LEAST(200, FLOOR(200 * {a} / GREATEST({b}, 1)::DOUBLE))::INT AS {r}" for r, (a, b) in _RULES.items())

OP2 = f"""
WITH w AS (SELECT doc_id, lang, COALESCE(text, '') AS t, {_WS} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, COUNT(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, COUNT(*) AS n, COUNT(*) - COUNT(DISTINCT l) AS d FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, {_WORD}) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang AS stratum, len(ws)::BIGINT AS n_words, list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS wc,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, COALESCE(lines.d, 0)::BIGINT AS n_dup_lines, COALESCE(rep.n, 0)::BIGINT AS n_repeat_words,
             COALESCE(lines.n, 0)::BIGINT AS n_lines, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_upper,
             len(regexp_extract_all(t, '[!?;:=~^_+/\\\\@{{}}\\[\\]()"#*$%&|<>]'))::BIGINT AS n_punct
      FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id),
b AS (SELECT *, COALESCE(wc, 0)::BIGINT AS word_chars, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
q AS (SELECT *, {_BINS} FROM b),
lab AS (SELECT doc_id, MAX(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h AS (SELECT stratum, rule, bin, COUNT(*) FILTER (WHERE good) AS good, COUNT(*) FILTER (WHERE NOT good) AS bad
      FROM (UNPIVOT (SELECT stratum, good, {', '.join(_RULES)} FROM q JOIN lab USING (doc_id) WHERE NOT base_failed) ON {', '.join(_RULES)} INTO NAME rule VALUE bin) GROUP BY ALL),
tot AS (SELECT stratum, rule, SUM(good)::BIGINT AS n, SUM(bad)::BIGINT AS n_bad, (SELECT COUNT(DISTINCT COALESCE(stratum, '?')) FROM h) * {len(_RULES)} AS family FROM h GROUP BY ALL),
cand AS (SELECT tot.*, c, COALESCE((SELECT SUM(good) FROM h WHERE h.stratum IS NOT DISTINCT FROM tot.stratum AND h.rule = tot.rule AND bin > c), 0)::BIGINT AS k,
                COALESCE((SELECT SUM(bad) FROM h WHERE h.stratum IS NOT DISTINCT FROM tot.stratum AND h.rule = tot.rule AND bin > c), 0)::BIGINT AS hit
         FROM tot, range(0, 200) AS x(c) WHERE n > 0 AND n_bad > 0),
tail AS (SELECT *, (SELECT SUM(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.01) + (n - j) * ln(0.99))) FROM range(0, k + 1) AS y(j)) AS p FROM cand),
stop AS (SELECT stratum, rule, MAX(c) FILTER (WHERE p > 0.05 / family) AS s FROM tail GROUP BY ALL),
cut AS (SELECT stratum, rule, arg_max(c, (m, c)) AS c FROM
          (SELECT t.stratum, t.rule, t.c, ROUND(hit / n_bad::DOUBLE - 2 * k / n::DOUBLE, 10) AS m FROM tail t JOIN stop ON t.stratum IS NOT DISTINCT FROM stop.stratum AND t.rule = stop.rule AND t.c > COALESCE(s, -1)) WHERE m > 0.02 GROUP BY ALL),
v AS (SELECT *, {', '.join(f"COALESCE({r} > (SELECT c FROM cut WHERE cut.stratum IS NOT DISTINCT FROM q.stratum AND rule = '{r}'), false) AS x_{r}" for r in _RULES)} FROM q)
SELECT doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_punct, base_failed,
       concat_ws(',', {', '.join(f"CASE WHEN x_{r} THEN '{r}' END" for r in _RULES)}) AS rejected_by,
       NOT base_failed AND NOT ({' OR '.join(f"x_{r}" for r in _RULES)}) AS kept
FROM v
"""

OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws FROM documents),
i0 AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS ws FROM benchmark),
i AS (SELECT *, len(ws) AS n, LEAST(5, len(ws)) AS g FROM i0 WHERE len(ws) > 0),
ish AS (SELECT item_id, g, s, COUNT(*) AS c FROM (SELECT item_id, g, array_to_string(ws[k:k + g - 1], ' ') AS s FROM (SELECT *, unnest(range(1, n - g + 2)) AS k FROM i)) GROUP BY ALL),
df AS (SELECT s, COUNT(DISTINCT item_id) AS df FROM ish GROUP BY s),
iw AS (SELECT ish.*, ln(1 + (SELECT COUNT(*) FROM i)::DOUBLE / df) AS w FROM ish JOIN df USING (s)),
tot AS (SELECT item_id, SUM(w * c) AS total FROM iw GROUP BY item_id),
dsh AS (SELECT doc_id, g, k, array_to_string(ws[k:k + g - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - g + 2)) AS k FROM d, (SELECT DISTINCT g FROM i)) WHERE len(ws) >= g),
dw AS (SELECT dsh.*, ln(1 + (SELECT COUNT(*) FROM i)::DOUBLE / COALESCE(df.df, 1)) AS w FROM dsh LEFT JOIN df USING (s)),
hits AS (SELECT doc_id, iw.item_id, k FROM dw JOIN iw ON dw.s = iw.s AND dw.g = iw.g),
size AS (SELECT doc_id, len(ws) AS len FROM d),
win AS (SELECT DISTINCT doc_id, item_id, g, LEAST(n, len) AS n, unnest(range(GREATEST(1, k - LEAST(n, len) + g), LEAST(k, len - LEAST(n, len) + 1) + 1)) AS a
        FROM hits JOIN i USING (item_id) JOIN size USING (doc_id)),
ws AS (SELECT win.doc_id, win.item_id, win.a, win.n, dw.s, ANY_VALUE(dw.w) AS w, COUNT(*) AS c
       FROM win JOIN dw ON win.doc_id = dw.doc_id AND win.g = dw.g AND dw.k BETWEEN win.a AND win.a + win.n - win.g GROUP BY ALL),
sim AS (SELECT ws.doc_id, ws.item_id, ws.a, ws.n, SUM(ws.w * LEAST(ws.c, COALESCE(iw.c, 0))) AS shared, SUM(ws.w * ws.c) AS own
        FROM ws LEFT JOIN iw ON iw.item_id = ws.item_id AND iw.s = ws.s GROUP BY ALL),
best AS (SELECT doc_id, item_id, n, a, ROUND(shared / (own + total - shared), 9) AS similarity FROM sim JOIN tot USING (item_id))
SELECT doc_id, item_id, similarity, (a - 1)::BIGINT AS start_word, n::BIGINT AS n_words
FROM best WHERE similarity >= 0.8 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, a) = 1
"""

ORACLES = {"op2_quality_rules": OP2, "op6_decontaminate": OP6, "op8_source_mix": OP8, "op9_substring_dedup": OP9}

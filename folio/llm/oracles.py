"""DuckDB SQL for the queries of this subpackage that SQL can express.

Operators whose results SQL can't express (signatures, the trained model, tokenised
packing, byte-level repeats, keyed surrogates, records with digests of HTML text) are
tested against brute-force versions instead.
"""

from .quality import ALPHA, CUTOFFS, DELTA, N_STEPS, STEP, fewest

_SPACE = r"[\x20\x09-\x0D]"

OP9 = rf"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), keyed AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), frequent AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, i, line, coalesce(holder <> doc_id, false) AS gone FROM keyed LEFT JOIN frequent USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP7 = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) - 1 AS n FROM turns
), parts AS (
  SELECT *, n // 512 AS part FROM numbered
), shown AS (
  SELECT conv_id, part, n, role, text, false AS again FROM parts
  UNION ALL
  SELECT conv_id, later.part, n, role, text, true FROM parts s JOIN (SELECT DISTINCT conv_id, part FROM parts WHERE part > 0) later USING (conv_id) WHERE s.part = 0 AND role = 'system'
), speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'
), seated AS (
  SELECT *, role = perspective AS own,
    '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
  FROM shown JOIN speakers USING (conv_id)
), pieces AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS piece FROM seated
), placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, perspective, part ORDER BY n) AS stop FROM pieces
)
SELECT conv_id, perspective, part, count(*) FILTER (NOT again) AS n_turns, count(*) FILTER (again) AS n_context, string_agg(piece, '' ORDER BY n) AS text,
  coalesce(string_agg((stop - length(piece) + length(head)) || '-' || (stop - 1), ' ' ORDER BY n) FILTER (own), '') AS mask,
  CAST(coalesce(sum(length(piece) - length(head) - 1) FILTER (own), 0) AS BIGINT) AS mask_chars
FROM placed GROUP BY conv_id, perspective, part
"""

_STEP_OF = ", ".join("CASE " + " ".join(f"WHEN {s} > {c} THEN {STEP[s, i]}" for i, c in enumerate(cs)) + f" ELSE {N_STEPS} END" for s, cs in CUTOFFS.items())

OP2 = rf"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
grams AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 4)) AS p, unnest(list_transform(generate_series(1, len(w) - 4), lambda p: array_to_string(w[p:p+4], ' '))) AS g
  FROM words WHERE len(w) >= 5
), twice AS (
  SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), repeats AS (SELECT doc_id, sum(least(5, coalesce(gap, 5))) AS n FROM twice GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, stratum, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts t JOIN words w USING (doc_id) LEFT JOIN repeats r USING (doc_id)
), found AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_upper / greatest(word_chars, 1) AS upper_ratio,
    n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word
  FROM counts
), stepped AS (SELECT *, least({_STEP_OF}) AS step FROM found),
held AS (
  SELECT * FROM stepped WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1 AND max(coalesce(quality, 0)) = 1)
), totals AS (SELECT stratum, count(*) AS n FROM held GROUP BY stratum HAVING count(*) >= {fewest(DELTA, ALPHA)}),
tests AS (
  SELECT t.stratum, i, n, (SELECT count(*) FROM held h WHERE h.stratum = t.stratum AND h.step <= i) AS k FROM totals t, generate_series(0, {N_STEPS - 1}) AS g(i)
), tails AS (
  SELECT *, CASE WHEN k >= n * {ALPHA} THEN 1.0 ELSE list_sum(list_transform(generate_series(0, k), lambda j:
    exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))) END AS tail
  FROM tests
), checked AS (SELECT *, tail <= {DELTA} / (SELECT count(*) FROM totals) AS ok FROM tails),
accepted AS (SELECT stratum, coalesce(min(i) FILTER (NOT ok), {N_STEPS}) - 1 AS last FROM checked GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(step <= (SELECT last FROM accepted a WHERE a.stratum = f.stratum), false) AS kept
FROM stepped f
"""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM split, range(1, 5) AS g(k) WHERE len(w) >= k
), frequent AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), totals AS (
  SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang
), parts AS (
  SELECT lang, f, array_to_string(w[i:j], ' ') AS phrase FROM frequent, range(1, 4) AS a(i), range(2, 5) AS b(j) WHERE k > 2 AND i < j AND j <= k AND j - i + 1 < k
), covers AS (
  SELECT lang, phrase, max(f) AS cover FROM parts GROUP BY lang, phrase
), stay AS (
  SELECT c.lang, c.phrase, c.k, c.w, c.f AS a FROM frequent c LEFT JOIN covers v USING (lang, phrase) WHERE c.k > 1 AND NOT coalesce(100::HUGEINT * cover >= 80::HUGEINT * c.f, false)
), cuts AS (
  SELECT s.*, x.f AS l, y.f AS r, cut, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM stay s, range(1, 4) AS t(cut), frequent x, frequent y
  WHERE cut < s.k AND x.lang = s.lang AND x.phrase = array_to_string(s.w[1:cut], ' ') AND y.lang = s.lang AND y.phrase = array_to_string(s.w[cut + 1:], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lowest JOIN totals USING (lang) QUALIFY rank <= 2000
"""

#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), "
    "lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"
)

OP12 = rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC.format("doc_id::VARCHAR")} AS h FROM documents
), placed AS (
  SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM texts
), planted AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM placed
), words AS (
  SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM planted
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i
), stretches AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k HAVING count(*) >= greatest(6 - q, 3 * q)
), runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretches GROUP BY doc_id, start, length
), listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    list({{start: start, length: length, period: period}} ORDER BY start, period) AS all_runs
  FROM runs GROUP BY doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words LEFT JOIN listed USING (doc_id)
  WHERE all_runs IS NULL OR len(list_filter(all_runs, lambda r: i >= r.start + r.period AND i < r.start + r.length)) = 0 GROUP BY doc_id
)
SELECT p.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM planted p LEFT JOIN listed USING (doc_id) LEFT JOIN (SELECT * FROM ranked WHERE k = 1) r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_quality_rules": OP2, "op7_chat_rotation": OP7, "op9_line_dedup": OP9, "op11_phrases": OP11, "op12_periodic_runs": OP12}

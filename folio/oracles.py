"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _matches(pattern: str, table: str = "documents", text: str = "text", keys: str = "doc_id") -> str:
    """(keys, i, pos, hit): all matches with their places, from the matches and the gaps between them."""
    p = pattern.replace("'", "''")
    return f"""(
      SELECT {keys}, i, hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY {keys} ORDER BY i) - length(hit) AS INTEGER) AS pos
      FROM (SELECT {keys}, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap, unnest(generate_series(1, len(h))) AS i
            FROM (SELECT {keys}, regexp_extract_all({text}, '{p}') AS h, string_split_regex({text}, '{p}') AS g FROM {table}) WHERE len(h) > 0)
    )"""


_SENTENCES = rf"""sentences AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS ord, pos + length(hit) - length(ltrim(hit, {_WS})) AS base, trim(hit, {_WS}) AS sentence
  FROM {_matches("[^.!?\n]+[.!?…]*".replace(chr(10), "\\n"))} WHERE trim(hit, {_WS}) <> ''
  UNION ALL
  SELECT doc_id, 0, length(text) - length(ltrim(text, {_WS})), trim(text, {_WS}) FROM documents
  WHERE trim(text, {_WS}) <> '' AND NOT regexp_matches(text, '[^.!?\n \t\f\r\x0B][^.!?\n]*|[^.!?\n]+[^.!?\n \t\f\r\x0B]')
)"""

_PHONE_P = r"(?:(?:\+?84)|0)(?:[\s\-.]?\d){8,10}"
_DATE_P = r"\d{1,2}[./-]\d{1,2}[./-]\d{2,4}"
_CURRENCY_P = r"(?i)(?:\d{1,3}(?:[\.\s]\d{3})*(?:,\d+)?|\d+(?:,\d+)?)\s*(?:tỷ|ty|triệu|trieu|nghìn|ngàn|ngan|đồng|dong|đ|d|vnd)"
_UNIT_P = r"(?i)(tỷ|ty|triệu|trieu|nghìn|ngàn|ngan|đồng|dong|đ|d|vnd)$"


def _phones(source: str) -> str:
    return rf"""
    SELECT *, 'phone' AS detector, 'phone_number' AS span_type, CAST(0.95 AS DOUBLE) AS confidence, national AS normalized, '+84' || ltrim(national, '0') AS e164 FROM (
      SELECT *, CASE WHEN raw LIKE '84%' THEN CASE WHEN substring(raw, 3) LIKE '0%' THEN substring(raw, 3) ELSE '0' || substring(raw, 3) END ELSE raw END AS national
      FROM (SELECT *, regexp_replace(hit, '\D', '', 'g') AS raw FROM {source}) WHERE length(raw) >= 9
    ) WHERE length(national) IN (10, 11)"""


def _dates(source: str) -> str:
    return rf"""
    SELECT *, 'dob_full' AS detector, 'date_of_birth' AS span_type, CAST(0.85 AS DOUBLE) AS confidence, printf('%04d-%02d-%02d', year, month, day) AS normalized FROM (
      SELECT *, CASE WHEN y >= 1900 THEN y WHEN y >= 30 THEN y + 1900 ELSE y + 2000 END AS year FROM (
        SELECT *, CAST(regexp_extract(hit, '(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{2,4}})$', 1) AS INTEGER) AS day,
          CAST(regexp_extract(hit, '(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{2,4}})$', 2) AS INTEGER) AS month,
          CAST(regexp_extract(hit, '(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{2,4}})$', 3) AS INTEGER) AS y FROM {source})
    ) WHERE day BETWEEN 1 AND 31 AND month BETWEEN 1 AND 12"""


def _currency(source: str) -> str:
    return rf"""
    SELECT *, 'currency' AS detector, 'currency_amount' AS span_type, CAST(0.8 AS DOUBLE) AS confidence, CAST(amount_vnd AS VARCHAR) AS normalized FROM (
      SELECT *, CAST(round_even(number * CASE WHEN unit IN ('tỷ', 'ty') THEN 1000000000 WHEN unit IN ('triệu', 'trieu') THEN 1000000 WHEN unit IN ('nghìn', 'ngàn', 'ngan') THEN 1000 ELSE 1 END, 0) AS BIGINT) AS amount_vnd FROM (
        SELECT *, lower(regexp_extract(hit, '{_UNIT_P}', 1)) AS unit,
          TRY_CAST(replace(replace(replace(trim(regexp_replace(hit, '{_UNIT_P}', ''), {_WS}), '.', ''), ' ', ''), ',', '.') AS DOUBLE) AS number FROM {source}
      ) WHERE number IS NOT NULL
    )"""


_COLUMNS = "CAST(doc_id AS VARCHAR) AS doc_id, detector, span_type, confidence, normalized, hit, pos AS span_start, pos + length(hit) AS span_end, trim(hit, {ws}) AS span_text".format(ws=_WS)
#: Spans of three detectors on whole texts.
_SPANS = f"""spans AS (
  SELECT {_COLUMNS}, CAST(NULL AS BIGINT) AS amount_vnd, i FROM ({_phones(_matches(_PHONE_P))})
  UNION ALL SELECT {_COLUMNS}, NULL, i FROM ({_dates(_matches(_DATE_P))})
  UNION ALL SELECT {_COLUMNS}, amount_vnd, i FROM ({_currency(_matches(_CURRENCY_P))})
)"""

_SENTENCE_SPANS = f"""sentence_spans AS (
  SELECT doc_id, ord, base, detector, span_type, confidence, hit, pos FROM ({_phones(_matches(_PHONE_P, "sentences", "sentence", "doc_id, ord, base"))})
  UNION ALL SELECT doc_id, ord, base, detector, span_type, confidence, hit, pos FROM ({_dates(_matches(_DATE_P, "sentences", "sentence", "doc_id, ord, base"))})
  UNION ALL SELECT doc_id, ord, base, detector, span_type, confidence, hit, pos FROM ({_currency(_matches(_CURRENCY_P, "sentences", "sentence", "doc_id, ord, base"))})
)"""

_EDGE = """'.,:;!?()[]{}"''“”‘’'"""
_TOKENS = rf"""tokens AS (
  SELECT doc_id, ord, base, i, pos, hit, trim(hit, {_EDGE}) AS c FROM {_matches(r"\S+", "sentences", "sentence", "doc_id, ord, base")}
), named AS (
  SELECT *, c <> '' AND NOT regexp_matches(c, '\p{{Nd}}') AND NOT (upper(c) = c AND lower(c) <> c) AND regexp_matches(c, '^[\p{{Lu}}\p{{Lt}}]') AS name FROM tokens
)"""
_HONORIFICS = "'ông', 'bà', 'anh', 'chị', 'cô', 'chú'"
_PEOPLE = rf"""runs AS (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, ord ORDER BY i) AS g FROM named WHERE name
), grouped AS (
  SELECT doc_id, ord, base, g, min(i) AS i0, min(pos) AS s0, max(pos + length(hit)) AS e0, count(*) AS n, min_by(c, i) AS c0 FROM runs GROUP BY ALL
), titled AS (
  SELECT r.*, t.pos AS title_at, coalesce(lower(t.c) IN ({_HONORIFICS}), false) AS hon
  FROM grouped r LEFT JOIN tokens t ON t.doc_id = r.doc_id AND t.ord = r.ord AND t.i = r.i0 - 1 WHERE n > 1 OR length(c0) > 2
), people AS (
  SELECT CAST(p.doc_id AS VARCHAR) AS doc_id, '0.' || p.ord AS sentence_id, s0, substring(sentence, CASE WHEN hon THEN title_at ELSE s0 END + 1, e0 - CASE WHEN hon THEN title_at ELSE s0 END) AS name,
    p.base + CASE WHEN hon THEN title_at ELSE s0 END AS name_start, p.base + e0 AS name_end,
    CAST(round_even(least(0.55 + CASE WHEN hon THEN 0.1 ELSE 0.0 END + 0.02 * (n + CAST(hon AS INTEGER) - 2), 0.85), 3) AS DOUBLE) AS score
  FROM titled p JOIN sentences s ON s.doc_id = p.doc_id AND s.ord = p.ord
)"""
_MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
_PLAIN = "aaaaaaaaaaaaaaaaaeeeeeeeeeeeiiiiiooooooooooooooooouuuuuuuuuuuyyyyyd"


def _key(name: str) -> str:
    return f"translate(trim(regexp_replace(lower({name}), '\\s+', ' ', 'g')), '{_MARKED}', '{_PLAIN}')"


_KEYED = f"keyed AS (SELECT *, {_key('name')} AS name_key FROM people)"
_LINKS = """blocks AS (SELECT k, string_split(k, ' ')[-1] AS block FROM keys),
      pairs AS (SELECT x.k AS a, y.k AS b, 1 - levenshtein(x.k, y.k) / greatest(length(x.k), length(y.k), 1) AS score FROM blocks x JOIN blocks y ON x.block = y.block AND x.k < y.k)
      SELECT a, b, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'same' ELSE 'review' END AS link FROM pairs WHERE score >= 0.6"""
_CORRUPTED = """corrupted AS (
  SELECT s.* REPLACE (
      CASE span_start % 5 WHEN 1 THEN 10000000 WHEN 2 THEN span_start ELSE span_end END AS span_end,
      CASE span_start % 5 WHEN 3 THEN 'x' || span_text ELSE span_text END AS span_text),
    d.text FROM spans s JOIN documents d ON CAST(d.doc_id AS VARCHAR) = s.doc_id
), checked AS (
  SELECT *, CASE WHEN span_end > length(text) THEN 'out_of_bounds' WHEN span_end <= span_start THEN 'empty_slice'
    WHEN trim(regexp_replace(substring(text, span_start + 1, span_end - span_start), '\\s+', ' ', 'g')) <> trim(regexp_replace(span_text, '\\s+', ' ', 'g')) THEN 'text_mismatch' END AS reason
  FROM corrupted
), judged AS (
  SELECT *, reason IS NULL AS verified,
    CASE WHEN reason IS NULL AND span_type = 'date_of_birth' THEN CAST(nullif(regexp_extract(normalized, '(19|20)\\d{2}', 0), '') AS INTEGER) END AS birth_year FROM checked
)"""
_LINES = """lines AS (
  SELECT doc_id, i - 1 AS i, line, sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 2 AS start,
    len(list_filter(string_split(line, ' '), lambda t: t <> '')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
)"""
#: Sentences of each line as a passage of its own, places as if the lines were joined by blank lines; ``ord`` counts through the document.
_LINE_SENTENCES = rf"""{_LINES}, passages AS (
  SELECT doc_id, i AS pid, start + length(line) - length(ltrim(line, {_WS})) AS start, trim(line, {_WS}) AS text FROM lines WHERE trim(line, {_WS}) <> ''
), split AS (
  SELECT doc_id, pid, start + pos + length(hit) - length(ltrim(hit, {_WS})) AS base, trim(hit, {_WS}) AS sentence FROM {_matches("[^.!?\\n]+[.!?…]*", "passages", "text", "doc_id, pid, start")} WHERE trim(hit, {_WS}) <> ''
), sentences AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY base) AS ord, pid || '.' || (row_number() OVER (PARTITION BY doc_id, pid ORDER BY base) - 1) AS sid FROM (
    SELECT * FROM split UNION ALL
    SELECT doc_id, pid, start, text FROM passages p WHERE NOT EXISTS (SELECT 1 FROM split s WHERE s.doc_id = p.doc_id AND s.pid = p.pid))
)"""
_SOURCE = """source AS (
  SELECT o_orderkey, lower(c_mktsegment) AS site_slug, o_orderpriority AS ingest_category_slug, o_orderstatus AS category_id, c_mktsegment AS category_name,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS publish_date, o_totalprice AS created_at
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""
_WRAPPED = """wrapped AS (
  SELECT event_id, event_id % 6 AS m, props FROM events
)"""
_EXTRACTED = r"""docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, doc_id AS id, doc_id % 6 AS m, text, regexp_extract(text, '^[^ \n]+', 0) AS word FROM documents WHERE length(text) > 0
), spanned AS (
  SELECT *, CASE WHEN m = 3 THEN 'Zz Invented' ELSE word END AS name, CASE m WHEN 1 THEN 1 WHEN 2 THEN 10000000 ELSE 0 END AS s FROM docs
), placed AS (
  SELECT *, s + length(word) AS e, strpos(text, name) - 1 AS found FROM spanned
), issues AS (
  SELECT doc_id, 0 AS k,
    CASE WHEN e > length(text) OR s >= e THEN 'wrong_position' WHEN substring(text, s + 1, e - s) <> name THEN CASE WHEN found >= 0 THEN 'wrong_position' ELSE 'hallucination' END END AS type,
    CASE WHEN e > length(text) OR s >= e THEN 'error' WHEN found >= 0 THEN 'error' ELSE 'critical' END AS severity,
    CASE WHEN e > length(text) OR s >= e THEN 'name.start/end' ELSE 'name' END AS field,
    CASE WHEN e > length(text) OR s >= e THEN 'start=' || s || ', end=' || e WHEN found >= 0 THEN '''' || substring(text, s + 1, e - s) || ''' at position ' || s ELSE '''' || name || ''' not found' END AS actual,
    CASE WHEN e <= length(text) AND s < e AND found >= 0 THEN substring(text, greatest(found - 20, 0) + 1, least(found + length(name) + 20, length(text)) - greatest(found - 20, 0)) END AS text_snippet
  FROM placed WHERE name <> ''
  UNION ALL SELECT doc_id, 1, 'schema_violation', 'warning', 'roles[0].label', 'driver', NULL FROM docs WHERE m = 4
  UNION ALL SELECT doc_id, 2, 'schema_violation', 'warning', 'actions[0].predicate', 'fled', NULL FROM docs WHERE m = 5
  UNION ALL SELECT doc_id, 3, 'wrong_law_article', 'critical', 'actions[0].law_article', 'Điều 999', NULL FROM docs WHERE m = 0 AND NOT contains(text, 'Điều 999')
  UNION ALL SELECT doc_id, 4, 'hallucination', 'warning', 'actions[0].amount_vnd', CAST(id * 2000000000 AS VARCHAR), NULL FROM docs WHERE id * 2000000000 > 1000000000000
  UNION ALL SELECT doc_id, 5, 'missing_entity', 'warning', 'people', 'not extracted',
    CASE WHEN strpos(text, word) - 1 > 50 THEN '...' ELSE '' END || substring(text, greatest(strpos(text, word) - 51, 0) + 1, least(strpos(text, word) - 1 + length(word) + 50, length(text)) - greatest(strpos(text, word) - 51, 0))
      || CASE WHEN strpos(text, word) - 1 + length(word) + 50 < length(text) THEN '...' ELSE '' END FROM docs WHERE m = 1 AND word <> ''
  UNION ALL SELECT doc_id, 6, 'missing_entity', 'warning', 'people', 'not extracted', '' FROM docs WHERE m = 1 AND contains(text, 'Nobody Here')
  UNION ALL SELECT doc_id, 7, 'incomplete_extraction', 'info', 'completeness_check', 'check failed', NULL FROM docs WHERE m = 2
), found AS (SELECT * FROM issues WHERE type IS NOT NULL)"""
_SEVERITIES = {"critical_issues": "critical", "errors": "error", "warnings": "warning", "info_issues": "info"}
_TYPES = {"hallucinations": "hallucination", "wrong_positions": "wrong_position", "missing_entities": "missing_entity", "schema_violations": "schema_violation", "wrong_law_articles": "wrong_law_article"}
_COUNTS = ", ".join([f"count(*) FILTER (severity = '{v}') AS {k}" for k, v in _SEVERITIES.items()] + [f"count(*) FILTER (type = '{v}') AS {k}" for k, v in _TYPES.items()])
_VERDICTS = """reports AS (
  SELECT doc_id, doc_id % 13 = 0 AS bad, coalesce(toxic, 0) = 1 AS t, doc_id % 5 AS m,
    CASE WHEN doc_id % 13 = 0 THEN 'unsure' WHEN coalesce(quality, 0) = 0 THEN 'unsupported' WHEN doc_id % 5 IN (1, 2) THEN 'unsure' ELSE 'supported' END AS verdict, doc_id % 11 = 0 AS denied
  FROM labels
), verdicts AS (
  SELECT *, CASE WHEN bad OR t THEN 1 ELSE 0 END AS issue_count, CASE WHEN NOT bad AND m = 4 AND NOT t THEN 1 ELSE 0 END AS missing_people_count,
    CASE WHEN bad THEN 'parsing_error' WHEN t THEN CASE WHEN m = 3 THEN 'other' ELSE 'conflict' END END AS first_type,
    NOT bad AND verdict = 'supported' AND NOT (m = 4 AND NOT t) AND NOT (t AND m IN (0, 3)) AND NOT denied AS usable FROM reports
)"""

_BASELINE = f"""{_LINE_SENTENCES}, {_SENTENCE_SPANS}, {_TOKENS}, {_PEOPLE}, emitted AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, ord, span_type, base + pos AS span_start, base + pos + length(hit) AS span_end, trim(hit, {_WS}) AS span_text, 'regex' AS source, confidence, detector FROM sentence_spans
  UNION ALL SELECT doc_id, CAST(substring(sentence_id, 3) AS BIGINT), 'person', name_start, name_end, name, 'ner', score, NULL FROM people
), kept AS (
  SELECT * FROM emitted QUALIFY row_number() OVER (PARTITION BY doc_id, span_type, span_start, span_end, source, span_text ORDER BY confidence DESC, ord) = 1
)"""
_PACK = """list_reduce(
        list_prepend([], list_transform(n, lambda c, k: [{'a': k, 'b': k, 'n': c}])),
        lambda acc, x: CASE WHEN len(acc) = 0 THEN x WHEN %s THEN list_concat(acc, x) ELSE list_concat(acc[1:len(acc) - 1], [{'a': acc[len(acc)].a, 'b': x[1].b, 'n': acc[len(acc)].n + x[1].n}]) END)"""


def _percent(part: str, whole: str) -> str:
    return f"coalesce(round_even({part} * 100.0 / nullif({whole}, 0), 2), 0.0)"


_PACKED = f"""{_LINES}, docs AS (
        SELECT doc_id, list(n ORDER BY i) AS n, list(line ORDER BY i) AS ps, list(start ORDER BY i) AS starts FROM lines GROUP BY doc_id
      ), filled AS (SELECT *, {_PACK % "acc[len(acc)].n + x[1].n > 120"} AS f FROM docs
      ), merged AS (
        SELECT * REPLACE (list_reduce(list_prepend([], list_transform(f, lambda y: [y])), lambda acc, x: CASE WHEN len(acc) = 0 THEN x WHEN acc[len(acc)].n >= 40 THEN list_concat(acc, x)
          ELSE list_concat(acc[1:len(acc) - 1], [{{'a': acc[len(acc)].a, 'b': x[1].b, 'n': acc[len(acc)].n + x[1].n}}]) END) AS f) FROM filled
      ), tailed AS (
        SELECT * REPLACE (CASE WHEN len(f) >= 2 AND f[len(f)].n < 40 THEN list_concat(f[1:len(f) - 2], [{{'a': f[len(f) - 1].a, 'b': f[len(f)].b, 'n': f[len(f) - 1].n + f[len(f)].n}}]) ELSE f END AS f) FROM merged
      ), rows AS (SELECT doc_id, ps, starts, unnest(f) AS s, unnest(generate_series(0, len(f) - 1)) AS pid FROM tailed)"""

#: BM25 of every packed passage for every benchmark item that shares a term with it.
_BM25 = _PACKED + r""", passages AS (
        SELECT doc_id, CAST(pid AS INTEGER) AS passage_id, CAST(s.n AS INTEGER) AS word_count, array_to_string(ps[s.a:s.b], chr(10) || chr(10)) AS text FROM rows
      ), tokens AS (SELECT doc_id, passage_id, word_count, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM passages
      ), counts AS (SELECT doc_id, passage_id, term, count(*) AS tf FROM tokens GROUP BY ALL
      ), sizes AS (SELECT doc_id, passage_id, any_value(word_count) AS word_count, count(*) AS length FROM tokens GROUP BY ALL
      ), stats AS (SELECT count(*) AS n, sum(length) / count(*) AS mean FROM sizes
      ), terms AS (SELECT term, count(*) AS df FROM counts GROUP BY term
      ), asked AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark
      ), weights AS (SELECT item_id, term, count(*) * ln(1 + (any_value(n) - any_value(df) + 0.5) / (any_value(df) + 0.5)) AS w FROM asked JOIN terms USING (term), stats GROUP BY ALL
      ), scores AS (
        SELECT item_id, doc_id, passage_id, any_value(word_count) AS word_count, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
        FROM weights JOIN counts USING (term) JOIN sizes USING (doc_id, passage_id), stats GROUP BY item_id, doc_id, passage_id
      ), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, passage_id) AS rank FROM scores)"""



def _periods(value: str, max_age: int | None, name: str) -> str:
    """Periods of a column of orders by customer."""
    old = f"day - prior_day > {max_age}" if max_age else "false"
    end = "least(max(coalesce(next_day, 1099511627775)), max(day) + " + str(max_age) + ")" if max_age else "max(coalesce(next_day, 1099511627775))"
    return f"""{name}_said AS (
        SELECT o_custkey AS key, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, {value} AS value FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC, {value} DESC) = 1
      ), {name}_next AS (
        SELECT *, lag(day) OVER w AS prior_day, lag(value) OVER w AS prior, lead(day) OVER w AS next_day FROM {name}_said WINDOW w AS (PARTITION BY key ORDER BY day)
      ), {name}_numbered AS (
        SELECT *, sum(CASE WHEN prior_day IS NULL OR value IS DISTINCT FROM prior OR {old} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY day) AS k FROM {name}_next
      ), {name} AS (SELECT key, any_value(value) AS value, min(day) AS valid_from, {end} AS valid_to, count(*) AS n FROM {name}_numbered GROUP BY key, k)"""


ORACLES: dict[str, str] = {
    "detector_summary": f"WITH {_SENTENCES}, {_SENTENCE_SPANS} SELECT detector, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs FROM sentence_spans GROUP BY detector",
    "sentence_split": f"WITH {_SENTENCES} SELECT doc_id, '0.' || ord AS sentence_id, CAST(base AS INTEGER) AS sentence_start, sentence FROM sentences",
    "spans_phone": f"SELECT {_COLUMNS.replace(', hit', '').replace(' span_type,', '')}, e164 FROM ({_phones(_matches(_PHONE_P))})",
    "spans_date": f"SELECT {_COLUMNS.replace(', hit', '').replace(' span_type, confidence,', '')}, year, month, day FROM ({_dates(_matches(_DATE_P))})",
    "spans_currency": f"SELECT {_COLUMNS.replace(', hit', '').replace(' span_type, confidence,', '')}, amount_vnd, unit FROM ({_currency(_matches(_CURRENCY_P))})",
    "name_tokens": rf"""
      SELECT d.doc_id, count(hit) AS n_tokens, count(*) FILTER (c <> '' AND NOT regexp_matches(c, '\p{{Nd}}') AND NOT (upper(c) = c AND lower(c) <> c) AND regexp_matches(c, '^[\p{{Lu}}\p{{Lt}}]')) AS n_names,
        CAST(max(pos) AS BIGINT) AS last_start
      FROM documents d JOIN (SELECT doc_id, hit, pos, trim(hit, {_EDGE}) AS c FROM {_matches(r"\S+")}) USING (doc_id) GROUP BY d.doc_id""",
    "person_names": f"WITH {_SENTENCES}, {_TOKENS}, {_PEOPLE} SELECT doc_id, sentence_id, name, CAST(name_start AS INTEGER) AS name_start, CAST(name_end AS INTEGER) AS name_end, score FROM people",
    "people_index": f"""WITH {_SENTENCES}, {_TOKENS}, {_PEOPLE}, {_KEYED},
      spelled AS (SELECT name_key, name, count(*) AS n FROM keyed GROUP BY ALL)
      SELECT k.name_key, (SELECT name FROM spelled s WHERE s.name_key = k.name_key ORDER BY n DESC, name LIMIT 1) AS display_name, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_documents
      FROM keyed k GROUP BY k.name_key""",
    "co_mentions": f"""WITH {_SENTENCES}, {_TOKENS}, {_PEOPLE}, {_KEYED}, one AS (SELECT DISTINCT doc_id, sentence_id, name_key FROM keyed)
      SELECT x.name_key AS a, y.name_key AS b, count(*) AS n, array_to_string(list_sort(list(x.doc_id || ':' || x.sentence_id ORDER BY x.doc_id, x.sentence_id)[1:5]), ' ') AS evidence
      FROM one x JOIN one y ON x.doc_id = y.doc_id AND x.sentence_id = y.sentence_id AND x.name_key < y.name_key GROUP BY ALL""",
    "mention_links": f"""WITH {_SENTENCES}, {_TOKENS}, {_PEOPLE}, {_KEYED}, keys AS (SELECT DISTINCT name_key AS k FROM keyed), {_LINKS}""",
    "people_clusters": f"""WITH RECURSIVE {_SENTENCES}, {_TOKENS}, {_PEOPLE}, {_KEYED},
      keys AS (SELECT DISTINCT name_key, length(name_key) AS n, translate(name_key, 'äöüßñçëîïœæåø', 'ABCDEFGHIJKLM') AS plain FROM keyed),
      links AS (SELECT x.name_key AS a, y.name_key AS b FROM keys x JOIN keys y ON x.name_key <> y.name_key AND greatest(x.n, y.n) >= 7 AND abs(x.n - y.n) <= 0.15 * greatest(x.n, y.n) + 1e-9
        WHERE 1 - levenshtein(x.plain, y.plain) / greatest(x.n, y.n) >= 0.85 - 1e-9),
      reach(node, other) AS (SELECT name_key, name_key FROM keys UNION SELECT node, b FROM reach JOIN links ON other = a),
      members AS (SELECT node AS name_key, min(other) AS cluster FROM reach GROUP BY node),
      placed AS (SELECT * FROM keyed JOIN members USING (name_key)),
      spelled AS (SELECT cluster, name, count(*) AS n FROM placed GROUP BY ALL),
      display AS (SELECT cluster, name AS display_name FROM spelled QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, name) = 1)
      SELECT name_key, cluster, display_name, n_keys, n_mentions, n_documents FROM members JOIN display USING (cluster)
      JOIN (SELECT cluster, count(DISTINCT name_key) AS n_keys, count(*) AS n_mentions, count(DISTINCT doc_id) AS n_documents FROM placed GROUP BY cluster) USING (cluster)""",
    "name_links": f"""WITH keys AS (SELECT DISTINCT {_key('p_name')} AS k FROM part), {_LINKS}""",
    "article_loading": "SELECT count(*) FILTER (contains(html, '<h1') AND contains(html, '<article')) AS loaded, count(*) FILTER (NOT (contains(html, '<h1') AND contains(html, '<article'))) AS failed FROM pages",
    "detector_hits": f"WITH {_SPANS}, once AS (SELECT DISTINCT doc_id, span_type, detector, span_start, span_end, span_text FROM spans) SELECT doc_id, detector, count(*) AS hits FROM once GROUP BY ALL",
    "span_dedupe": f"""WITH {_SPANS}, emitted AS (
        SELECT *, 0 AS round FROM spans UNION ALL SELECT * REPLACE (CASE WHEN span_start % 2 = 0 THEN 0.99 ELSE confidence END AS confidence), 1 AS round FROM spans)
      SELECT doc_id, span_type, span_start, span_end, span_text, CAST(confidence AS DOUBLE) AS confidence, round FROM emitted
      QUALIFY row_number() OVER (PARTITION BY doc_id, span_type, span_start, span_end, span_text ORDER BY confidence DESC, round) = 1""",
    "verify_spans": f"""WITH {_SPANS}, {_CORRUPTED} SELECT doc_id, span_type, span_start, CAST(span_end AS INTEGER) AS span_end, verified, reason, birth_year, CAST(confidence AS DOUBLE) AS confidence,
      CASE WHEN verified THEN CAST(birth_year IS NOT NULL AS INTEGER) + CAST(span_type = 'currency_amount' AS INTEGER) END AS n_derivations FROM judged""",
    "verify_stats": f"WITH {_SPANS}, {_CORRUPTED} SELECT doc_id, count(*) AS input_spans, count(*) FILTER (verified) AS verified_spans, count(*) FILTER (NOT verified) AS dropped_spans FROM judged GROUP BY doc_id",
    "verify_by_type": f"WITH {_SPANS}, {_CORRUPTED} SELECT doc_id, span_type, count(*) AS total, count(*) FILTER (verified) AS verified, coalesce(round_even(avg(confidence) FILTER (verified), 4), 0.0) AS avg_confidence FROM judged GROUP BY ALL",
    "verify_reasons": f"WITH {_SPANS}, {_CORRUPTED} SELECT doc_id, reason, count(*) AS n FROM judged WHERE NOT verified GROUP BY ALL",
    "baseline_spans": f"""WITH {_BASELINE} SELECT k.doc_id, span_type, CAST(span_start AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end, span_text, s.sid AS sentence_id, source, confidence
      FROM kept k JOIN sentences s ON CAST(s.doc_id AS VARCHAR) = k.doc_id AND s.ord = k.ord""",
    "baseline_stats": f"""WITH {_BASELINE},
      s AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS sentences, count(DISTINCT pid) AS passages FROM sentences GROUP BY doc_id),
      e AS (SELECT doc_id, count(*) FILTER (source = 'regex') AS regex_spans, count(*) FILTER (source = 'ner') AS ner_spans FROM emitted GROUP BY doc_id),
      h AS (SELECT doc_id, detector, count(*) AS n FROM kept WHERE detector IS NOT NULL GROUP BY ALL),
      j AS (SELECT doc_id, '{{' || string_agg('"' || detector || '":' || n, ',' ORDER BY detector) || '}}' AS hits FROM h GROUP BY doc_id),
      t AS (SELECT doc_id, count(*) AS total_spans FROM kept GROUP BY doc_id)
      SELECT s.doc_id, coalesce(regex_spans, 0) AS regex_spans, coalesce(ner_spans, 0) AS ner_spans, coalesce(total_spans, 0) AS total_spans, sentences, passages, coalesce(hits, '{{}}') AS detector_hits
      FROM s LEFT JOIN e USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN j USING (doc_id)""",
    "verify_own_spans": f"WITH {_BASELINE} SELECT count(DISTINCT doc_id) AS docs, count(*) AS input_spans, count(*) AS verified_spans, CAST(0 AS BIGINT) AS dropped_spans FROM kept",
    "passage_pack": f"""WITH {_PACKED} SELECT doc_id, CAST(pid AS INTEGER) AS passage_id, CAST(starts[s.a] AS INTEGER) AS p_start, CAST(starts[s.b] + length(ps[s.b]) AS INTEGER) AS p_end, CAST(s.n AS INTEGER) AS word_count,
        md5(array_to_string(ps[s.a:s.b], chr(10) || chr(10))) AS text_md5, CAST(s.b - s.a + 1 AS INTEGER) AS n_paragraphs FROM rows""",
    "passage_fallback": f"""WITH {_LINES} SELECT doc_id, CAST(i AS INTEGER) AS passage_id, CAST(start + length(line) - length(ltrim(line, {_WS})) AS INTEGER) AS p_start,
      CAST(start + length(line) - length(ltrim(line, {_WS})) + length(trim(line, {_WS})) AS INTEGER) AS p_end, CAST(len(list_filter(string_split_regex(trim(line, {_WS}), '\\s+'), lambda t: t <> '')) AS INTEGER) AS word_count, trim(line, {_WS}) AS p_text
      FROM lines WHERE trim(line, {_WS}) <> ''""",
    "passage_search": f"WITH {_BM25} SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, passage_id, score FROM ranked WHERE rank <= 5",
    "passage_gate": f"WITH {_BM25} SELECT doc_id, passage_id, any_value(word_count) AS word_count, count(*) AS n_queries, max(score) AS best_score FROM ranked WHERE rank <= 10 GROUP BY ALL",
    "vector_neighbours": """WITH pairs AS (
        SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS distance FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id
      ) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, distance FROM pairs QUALIFY rank <= 10""",
    "explain_drops": f"""WITH {_SPANS}, {_CORRUPTED} SELECT doc_id, span_type, span_text, span_start, CAST(span_end AS INTEGER) AS span_end, reason,
      CAST(span_start - CASE WHEN span_start % 5 = 3 AND span_start > 0 THEN 1 ELSE 0 END AS INTEGER) AS found_start,
      CAST(span_start + length(span_text) - CASE WHEN span_start % 5 = 3 THEN 1 ELSE 0 END AS INTEGER) AS found_end,
      CAST(CASE WHEN span_start % 5 = 3 THEN 1 ELSE 0 END AS INTEGER) AS cost, CASE WHEN span_start % 5 = 3 THEN 'edited' ELSE 'moved' END AS explanation FROM judged WHERE NOT verified""",
    "backend_spans": f"""WITH {_SENTENCES}, {_TOKENS}, {_PEOPLE} SELECT CAST(g.doc_id AS VARCHAR) AS doc_id, '0.' || g.ord AS sentence_id, 'person' AS span_type, CAST(g.base + s0 AS INTEGER) AS span_start, CAST(g.base + e0 AS INTEGER) AS span_end,
      substring(sentence, s0 + 1, e0 - s0) AS span_text, CAST(0.8 AS DOUBLE) AS confidence, 'capitals' AS backend FROM grouped g JOIN sentences s ON s.doc_id = g.doc_id AND s.ord = g.ord""",
    "allegation_status": """WITH said AS (
        SELECT user_id AS person, event_id % 3 AS allegation, ts, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 7 WHEN 'error' THEN 11 END AS INTEGER) AS mask FROM events
      ), merged AS (
        SELECT person, allegation, bit_or(mask) AS mask, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_statements, min(ts) AS alleged_at, min(ts) FILTER (mask & 3 = 3) AS charged_at,
          min(ts) FILTER (mask & 7 = 7) AS convicted_at, min(ts) FILTER (mask & 11 = 11) AS acquitted_at
        FROM said WHERE person IS NOT NULL AND mask IS NOT NULL GROUP BY ALL
      ) SELECT *, CASE mask WHEN 1 THEN 'alleged' WHEN 3 THEN 'charged' WHEN 7 THEN 'convicted' WHEN 11 THEN 'acquitted' WHEN 15 THEN 'contested' END AS status, mask = 7 AS as_fact FROM merged""",
    "fact_periods": f"WITH {_periods('o_orderpriority', 400, 'p')} SELECT key, value, valid_from, valid_to, n FROM p",
    "fact_as_of": f"""WITH {_periods('o_orderpriority', 400, 'p')}, reads AS (
        SELECT o_orderkey AS seq, o_custkey AS key, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 45 AS asked_day FROM orders
      ) SELECT seq, r.key, asked_day, value, valid_from, valid_to FROM reads r LEFT JOIN p ON p.key = r.key AND asked_day >= valid_from AND asked_day < valid_to""",
    "fact_overlaps": f"""WITH {_periods('o_orderpriority', 400, 'p')}, {_periods('o_orderstatus', None, 's')}
      SELECT p.key, p.value AS left_value, s.value AS right_value, greatest(p.valid_from, s.valid_from) AS valid_from, least(p.valid_to, s.valid_to) AS valid_to
      FROM p JOIN s ON p.key = s.key AND p.valid_from < s.valid_to AND s.valid_from < p.valid_to""",
    "token_count": "SELECT doc_id, CAST(len(list_filter(string_split(text, ' '), lambda t: t <> '')) AS INTEGER) AS n_tokens FROM documents",
    "source_newest": f"WITH {_SOURCE} SELECT * FROM source WHERE site_slug = 'building' AND 'building' IN (lower(ingest_category_slug), lower(category_id), lower(category_name)) ORDER BY publish_date DESC NULLS LAST, created_at DESC NULLS LAST, o_orderkey LIMIT 25",
    "source_oldest": f"WITH {_SOURCE} SELECT * FROM source WHERE 'o' IN (lower(ingest_category_slug), lower(category_id), lower(category_name)) ORDER BY publish_date ASC NULLS FIRST, created_at ASC NULLS FIRST, o_orderkey LIMIT 25",
    "category_counts": f"WITH {_SOURCE} SELECT site_slug, count(*) AS n FROM source WHERE '1-urgent' IN (lower(ingest_category_slug), lower(category_id), lower(category_name)) OR contains(lower(category_name), 'machin') GROUP BY site_slug",
    "documents_labelled": "SELECT doc_id, lang, source, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "documents_unlabelled": "SELECT doc_id, lang, source, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "missing_ids": "SELECT doc_id * 2 AS doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id * 2)",
    "orders_with_lines": """SELECT o_orderkey AS id, CAST(count(l_partkey) AS INTEGER) AS n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey), '') AS children
      FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "url_document_id": r"""SELECT page_id, coalesce(nullif(regexp_extract(url, '-(\d+)\.htm', 1), ''), replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '.htm', '')) AS from_url,
      CAST(page_id + 100000 AS VARCHAR) AS from_number, 'https://site.example' || regexp_replace(url, '^https?://[^/]+', '') AS absolute, 'https://site.example/a/' || page_id || '/x.htm?up=../y' AS climbed FROM pages""",
    "first_url": "SELECT host, page_id, url FROM (SELECT *, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) = 1",
    "timeline_collect": """WITH entries AS (
        SELECT CAST(page_id % 5 + 1 AS INTEGER) AS page, CAST(page_id AS INTEGER) AS position, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '') AS canonical_url FROM pages WHERE contains(lower(regexp_replace(url, '[?#].*$', '')), 'example.com'))
      SELECT * FROM (SELECT * FROM entries WHERE page <= 4 QUALIFY row_number() OVER (PARTITION BY canonical_url ORDER BY page, position) = 1) ORDER BY page, position LIMIT 50""",
    "prompt_truncate": """SELECT conv_id, turn, substring(text, 1, 80) AS passage, CAST(length(text) AS INTEGER) AS original_length, length(text) > 80 AS truncated,
      'doc_id: ' || conv_id || chr(10) || 'title: ' || coalesce(nullif(role, 'system'), 'None') AS metadata FROM conversations""",
    "answer_parse": f"""WITH {_WRAPPED} SELECT event_id, CASE WHEN m = 5 THEN 'request_error' WHEN m IN (0, 1, 2) THEN 'ok' ELSE 'parse_error' END AS status,
      CASE WHEN m = 5 THEN 'timeout' WHEN m = 3 THEN 'JSON decode error' END AS error, CASE WHEN m <= 2 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM wrapped""",
    "answer_status_counts": f"WITH {_WRAPPED} SELECT CASE WHEN m = 5 THEN 'request_error' WHEN m IN (0, 1, 2) THEN 'ok' ELSE 'parse_error' END AS status, count(*) AS n FROM wrapped GROUP BY ALL",
    "lenient_properties": f"WITH {_WRAPPED} SELECT event_id, CASE WHEN m <= 2 THEN props WHEN m = 4 THEN '{{}}' ELSE '' END AS found FROM wrapped",
    "validation_issues": f"WITH {_EXTRACTED} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS ord, type, severity, field, actual, text_snippet FROM found",
    "validation_counts": f"WITH {_EXTRACTED} SELECT d.doc_id, CAST(1 AS BIGINT) AS total_people_extracted, count(type) AS total_issues_found, {_COUNTS} FROM docs d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id",
    "validation_summary": f"""WITH {_EXTRACTED} SELECT (SELECT count(*) FROM docs) AS total_files_processed, count(DISTINCT doc_id) AS total_files_with_issues, count(*) AS total_issues, (SELECT count(*) FROM docs) AS total_people_extracted,
      {_COUNTS}, (SELECT 'model-' || doc_id FROM docs ORDER BY id LIMIT 1) AS original_model FROM found""",
    "verdict_normalise": f"WITH {_VERDICTS} SELECT doc_id, verdict, usable, issue_count, missing_people_count, first_type FROM verdicts",
    "verdict_summary": f"""WITH {_VERDICTS}, c AS (SELECT count(*) AS n, CAST(sum(issue_count) AS BIGINT) AS total_issues, CAST(sum(missing_people_count) AS BIGINT) AS total_missing_people, count(*) FILTER (usable) AS u,
        count(*) FILTER (verdict = 'supported') AS s, count(*) FILTER (verdict = 'unsure') AS q, count(*) FILTER (verdict = 'unsupported') AS x FROM verdicts)
      SELECT n AS total_files_processed, total_issues, total_missing_people, u AS total_usable, s AS total_supported, q AS total_unsure, x AS total_unsupported,
        {_percent('u', 'n')} AS usable_percentage, {_percent('s', 'n')} AS supported_percentage, {_percent('q', 'n')} AS unsure_percentage, {_percent('x', 'n')} AS unsupported_percentage FROM c""",
    "review_text": f"""WITH {_VERDICTS} SELECT doc_id, 'Verdict: ' || verdict || chr(10) || 'Issues: ' || issue_count || ' | Missing people: ' || missing_people_count
      || CASE WHEN issue_count = 1 THEN chr(10) || chr(10) || 'Issues' || chr(10) || '[1] ' || first_type || chr(10) || '  ' || CASE WHEN bad THEN 'The answer was not valid JSON.' ELSE 'd' END ELSE '' END
      || CASE WHEN missing_people_count = 1 THEN chr(10) || 'Missing People' || chr(10) || '- A B' ELSE '' END AS report FROM verdicts""",
    "spans_law_and_ids": """WITH m AS (
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(doc_id % 300 AS VARCHAR) AS article, 'Điều ' || doc_id % 300 || ' Bộ luật Hình sự ' || (1999 + doc_id % 20) AS law,
          CAST(1940 + doc_id % 60 AS VARCHAR) AS y, CAST(doc_id + 100000000 AS VARCHAR) AS n FROM documents),
      p AS (SELECT *, 5 AS at_law, 5 + length(law) + 8 AS at_year, 5 + length(law) + 8 + 13 + 2 AS at_id FROM m)
      SELECT doc_id, 'law_article' AS detector, at_law AS span_start, CAST(at_law + length(law) AS INTEGER) AS span_end, law AS span_text, article AS normalized, 'Bộ luật Hình sự' AS code FROM p
      UNION ALL SELECT doc_id, 'dob_year', CAST(at_year AS INTEGER), CAST(at_year + 13 AS INTEGER), 'sinh năm ' || y, y, NULL FROM p
      UNION ALL SELECT doc_id, 'national_id', CAST(at_id AS INTEGER), CAST(at_id + 8 + length(n) AS INTEGER), 'CMND số ' || n, n, NULL FROM p""",
    "manual_summary": f"""WITH marks AS (
        SELECT d.doc_id, CASE WHEN toxic = 1 THEN CASE WHEN d.doc_id % 2 = 0 THEN 'invalid' END WHEN quality = 1 THEN 'valid' WHEN quality IS NOT NULL THEN 'invalid' END AS s FROM documents d LEFT JOIN labels l USING (doc_id)),
      c AS (SELECT count(*) AS total, count(*) FILTER (s = 'valid') AS valid, count(*) FILTER (s = 'invalid') AS invalid, count(*) FILTER (s IS NULL) AS unset FROM marks)
      SELECT *, {_percent('valid', 'total')} AS valid_percentage, {_percent('invalid', 'total')} AS invalid_percentage, {_percent('unset', 'total')} AS unset_percentage FROM c""",
}

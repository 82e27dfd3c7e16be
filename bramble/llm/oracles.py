"""DuckDB SQL that queries of this package must agree with."""

_PAGE = """replace(replace('WARC/1.1~WARC-Type: response~WARC-Record-ID: <urn:uuid:{id}>~WARC-Date: 2000-01-01T00:00:00Z~WARC-Target-URI: ', '~', chr(13) || chr(10)), '{id}', id)
  || url || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha256(block) || chr(13) || chr(10) || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(block) || chr(13) || chr(10) || chr(13) || chr(10) || block || chr(13) || chr(10) || chr(13) || chr(10)"""


def _uuid(h: str) -> str:
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


FIXITY = f"""
WITH named AS (
  SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'about:blank' ELSE url END AS url, coalesce(html, '') AS html,
    sha256(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '') || '|' || (row_number() OVER (PARTITION BY page_id, url ORDER BY html) - 1)) AS h
  FROM pages
), blocks AS (
  SELECT page_id, url, {_uuid("h")} AS id, CAST('0x' || substr(h, 1, 4) AS INTEGER) % 97 AS kind,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html AS block
  FROM named
), records AS (SELECT page_id, id, kind, {_PAGE} AS record FROM blocks)
SELECT id AS record_id, coalesce(page_id, -1) AS page_id, CAST(strlen(record) AS BIGINT) AS octets, sha256(record) AS record_sha256, CASE WHEN kind IN (0, 2) THEN 'damaged' WHEN kind = 1 THEN 'missing' ELSE 'intact' END AS fate FROM records
UNION ALL
SELECT {_uuid("sha256('extra|' || id)")}, -1, 0, '', 'extra' FROM records WHERE kind = 3
"""


def _part(p: str, q: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)"


_CLASSES = ("small", "capital", "digit", "gap", "symbol", "rest")
_WORD = r"[^\x20\x09-\x0D]+"

DIVERGENCE = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS language FROM documents),
counted AS (
  SELECT r, doc_id, language, regexp_extract_all(text, '{_WORD}') AS words, CAST(length(text) AS BIGINT) AS n_all,
    length(regexp_replace(text, '[^\p{{Ll}}]+', '', 'g')) AS small, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS capital, length(regexp_replace(text, '[^\p{{Nd}}]+', '', 'g')) AS digit,
    length(text) - length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS gap, length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS symbol,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM docs
), sized AS (SELECT *, n_all - small - capital - digit - gap - symbol AS rest, CAST(len(words) AS BIGINT) AS n_words FROM counted),
windows AS (SELECT r, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] AS g FROM (SELECT r, words, unnest(range(1, n_words - 1)) AS i FROM sized)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY r),
word_counts AS (SELECT language, word, count(*) AS n FROM (SELECT language, unnest(words) AS word FROM sized) GROUP BY ALL),
sizes AS (SELECT language, sum(n) AS total FROM word_counts GROUP BY language HAVING sum(n) >= 2000),
common AS (SELECT language, word, n / CAST(total AS DOUBLE) AS q FROM word_counts JOIN sizes USING (language) WHERE n >= CAST(0.004 AS DOUBLE) * total),
shares AS (SELECT language, {", ".join(f"sum({c}) / CAST(sum(n_all) AS DOUBLE) AS q_{c}" for c in _CLASSES)} FROM sized JOIN sizes USING (language) GROUP BY language),
limits AS (
  SELECT language, total, CASE WHEN total >= 0.1 THEN least(CAST(0.4 AS DOUBLE), CAST(0.9 AS DOUBLE) * sqrt((total + {_part("one", "(1 - total)")}) / 2)) END AS word_limit
  FROM (SELECT language, CAST(1 AS DOUBLE) AS one, sum(q) AS total FROM common GROUP BY language)
), own AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(words) AS word FROM sized) GROUP BY ALL),
held AS (
  SELECT r, sum({_part("p", "q")}) AS inside, 1 - sum(p) AS other_p, 1 - sum(q) AS other_q
  FROM (SELECT s.r, c.q, coalesce(o.n, 0) / CAST(s.n_words AS DOUBLE) AS p FROM sized s JOIN common c USING (language) LEFT JOIN own o ON o.r = s.r AND o.word = c.word WHERE s.n_words > 0) GROUP BY r
), told AS (
  SELECT s.*, coalesce(covered.n, 0) AS n_repeat_words, word_limit,
    CASE WHEN n_words >= 50 AND word_limit IS NOT NULL THEN sqrt(greatest((inside + {_part("greatest(other_p, 0)", "other_q")}) / 2, 0)) END AS word_distance,
    CASE WHEN n_all >= 200 AND q_small IS NOT NULL THEN sqrt(greatest(({" + ".join(_part(f"({c} / CAST(n_all AS DOUBLE))", f"q_{c}") for c in _CLASSES)}) / 2, 0)) END AS class_distance
  FROM sized s LEFT JOIN covered USING (r) LEFT JOIN shares USING (language) LEFT JOIN limits USING (language) LEFT JOIN held USING (r)
)
SELECT doc_id, n_words, CAST(n_all - gap AS BIGINT) AS word_chars, CAST(symbol AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(class_distance, 0) <= CAST(0.3 AS DOUBLE) AND coalesce(word_distance, 0) <= coalesce(word_limit, 1) AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM told
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_COPIES = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM words WHERE len(w) BETWEEN 1 AND 3
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

REPEATS = rf"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later) GROUP BY doc_id),
kept AS (SELECT doc_id, w, coalesce(len(js), 0) AS n_removed, list_filter(w, lambda x, k: NOT list_contains(coalesce(js, []), k)) AS stay FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept
"""

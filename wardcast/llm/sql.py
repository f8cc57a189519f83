"""SQL for the results of the queries that SQL can express, written from their definitions."""

from __future__ import annotations

from wardcast.llm import decontamination, pii, quality_rules

#: A word of a text: the separators are space and tab to carriage return.
_WORD = r"[^\x20\x09-\x0D]+"
_RULES = quality_rules.LineRules()
_ENDS = r"[.!?:;\"''\x29\]…。！？]"

_QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words
  FROM documents
), lines AS (
  SELECT doc_id, line, length(line) AS n,
         regexp_matches(line, '[^\x20\x09-\x0D]') AS has_word,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
         length(regexp_replace(line, '[^|»›•·]', '', 'g')) AS menu,
         len(string_split(line, '!!')) - 1 AS shouts,
         len(string_split(line, ' ')) - 1 AS spaces
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
), judged AS (
  SELECT *, (NOT regexp_matches(line, '{_ENDS}[\x20\x09-\x0D]*\z')
             OR 100 * symbols > {_RULES.most_symbols} * n OR 100 * shouts > {_RULES.most_shouts} * n
             OR (menu >= {_RULES.menu_marks} AND 100 * menu > {_RULES.most_menu} * n)
             OR (spaces < {_RULES.boilerplate_words} AND regexp_matches(line, '{quality_rules.BOILERPLATE}'))) AS bad
  FROM lines WHERE has_word
), by_doc AS (
  SELECT doc_id, sum(n) AS line_chars, coalesce(sum(n) FILTER (NOT bad), 0) AS kept_chars,
         count(*) - count(DISTINCT line) AS n_dup_lines
  FROM judged GROUP BY doc_id
), places AS (
  SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d WHERE len(words) >= 5)
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS times FROM places
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n
  FROM windows, (SELECT unnest(range(5)) AS j) WHERE times > 1 GROUP BY doc_id
), measured AS (
  SELECT d.doc_id, len(words) AS n_words,
         length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         coalesce(line_chars, 0) AS line_chars, coalesce(kept_chars, 0) AS kept_chars
  FROM d LEFT JOIN by_doc USING (doc_id) LEFT JOIN covered USING (doc_id)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND 100 * (line_chars - kept_chars) <= {_RULES.most_lost} * line_chars AS kept,
       CAST(line_chars AS BIGINT) AS line_chars, CAST(kept_chars AS BIGINT) AS kept_chars
FROM measured
"""

#: The patterns without what only keeps a backtracking search short.
_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "ssn": r"[0-9]+(-[0-9]+)+",
}


def _matches(kind: str) -> str:
    return f"""
  SELECT doc_id, '{kind}' AS kind, {pii.KINDS.index(kind)} AS rank, m,
         list_sum(list_transform(list_slice(pieces, 1, i), lambda x: length(x)))
           + coalesce(list_sum(list_transform(list_slice(found, 1, i - 1), lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, pieces, found, unnest(found) AS m, generate_subscripts(found, 1) AS i
        FROM (SELECT doc_id, regexp_extract_all(text, '{_PLAIN[kind]}') AS found,
                     string_split_regex(text, '{_PLAIN[kind]}') AS pieces FROM d))"""


_NEAR = "\n".join(f"    WHEN '{k}' THEN '(?i)({w})'" for k, w in pii.CONTEXT.items())
_SCORE = "\n".join(f"    WHEN '{k}' THEN {s}" for k, s in pii.SCORES.items())


def _account(text: str) -> str:
    """Whether a text, without its spaces, is an account number that passes mod-97."""
    code = f"replace({text}, ' ', '')"
    return f"""(length({code}) BETWEEN 15 AND 34 AND list_reduce(
      list_transform(string_split({code}[5:] || {code}[1:4], ''), lambda c: CAST(CASE WHEN c BETWEEN '0' AND '9'
        THEN ascii(c) - 48 ELSE ascii(c) - 55 END AS BIGINT)),
      lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, CAST(0 AS BIGINT)) = 1)"""


_START = "[A-Z]{2}[0-9]{2}"
_PII = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents
), found AS ({" UNION ALL ".join(_matches(k) for k in pii.KINDS if k != "iban")}
), starts AS (
  SELECT doc_id, text, list_sum(list_transform(list_slice(pieces, 1, i), lambda x: length(x))) + 4 * (i - 1) AS start
  FROM (SELECT doc_id, text, pieces, unnest(range(1, len(pieces))) AS i
        FROM (SELECT doc_id, text, string_split_regex(text, '{_START}') AS pieces FROM d WHERE regexp_matches(text, '{_START}')))
), tried AS (
  SELECT *, regexp_extract(whole, '^(?:{pii._NATIONAL})') AS short
  FROM (SELECT *, regexp_extract(substr(text, CAST(start + 1 AS BIGINT), 64), '^{pii.PATTERNS["iban"]}') AS whole FROM starts)
  WHERE whole <> ''
), accounts AS (
  SELECT doc_id, start, n, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS i
  FROM (SELECT doc_id, start, greatest(CASE WHEN {_account("whole")} THEN length(whole) ELSE 0 END,
                                       CASE WHEN short <> '' AND {_account("short")} THEN length(short) ELSE 0 END) AS n FROM tried)
  WHERE n > 0
), chain AS (  -- the leftmost ones that do not overlap
  SELECT doc_id, i, start, n, start + n AS stop, true AS apart FROM accounts WHERE i = 1
  UNION ALL
  SELECT a.doc_id, a.i, a.start, a.n, CASE WHEN a.start >= c.stop THEN a.start + a.n ELSE c.stop END, a.start >= c.stop
  FROM chain c JOIN accounts a ON a.doc_id = c.doc_id AND a.i = c.i + 1
), told AS (
  SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM found
), confirmed AS (
  SELECT doc_id, kind, rank, start, length(m) AS n FROM told WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'),
      lambda x: length(ltrim(x, '0')) > 3 OR TRY_CAST('0' || ltrim(x, '0') AS HUGEINT) > 255)) = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(digits)),
      lambda i: CASE WHEN i % 2 = 0 THEN CAST(digits[length(digits) - i] AS INT)
                ELSE (2 * CAST(digits[length(digits) - i] AS INT)) % 10
                     + (2 * CAST(digits[length(digits) - i] AS INT)) // 10 END)) % 10 = 0
    ELSE regexp_full_match(m, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}')
      AND NOT regexp_matches(m, '\A(000|666|9)|-00-|-0000\z') END
  UNION ALL SELECT doc_id, 'iban', {pii.KINDS.index("iban")}, start, n FROM chain WHERE apart
), around AS (
  SELECT confirmed.*, CASE kind {_NEAR} END AS pattern,
         substr(text, CAST(greatest(start - {pii.BEFORE}, 0) + 1 AS BIGINT), CAST(least(start, {pii.BEFORE}) AS BIGINT)) AS before,
         substr(text, CAST(start + n + 1 AS BIGINT), {pii.AFTER}) AS after
  FROM confirmed JOIN d USING (doc_id)
), scored AS (
  SELECT *, CASE kind {_SCORE} END
    + CASE WHEN regexp_matches(before, pattern) OR regexp_matches(after, pattern) THEN {pii.CONTEXT_GAIN} ELSE 0 END AS score
  FROM around
), spans AS (
  SELECT doc_id, kind, rank, start, kind || ':' || start || ':' || (start + n) AS span
  FROM scored WHERE rank < {len(pii.BASE)} OR score >= {pii.THRESHOLD}
), listed AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)},
         string_agg(span, ',' ORDER BY rank, start) FILTER (rank < {len(pii.BASE)}) AS base,
         string_agg(span, ',' ORDER BY rank, start) AS spans
  FROM spans GROUP BY doc_id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""

_LIKE = decontamination.LIKE

_LEAKS = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM documents WHERE text IS NOT NULL
), items AS (
  SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM (
    SELECT item_id, regexp_extract_all(lower(text), '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL)
  WHERE len(w) > 0
), in_item AS (
  SELECT item_id, n, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s, i - 1 AS place
  FROM (SELECT *, unnest(range(1, n - k + 2)) AS i FROM items)
), bags AS (SELECT item_id, n, k, s, count(*) AS times, min(place) AS place FROM in_item GROUP BY ALL
), in_doc AS (
  SELECT doc_id, k, i - 1 AS place, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM words, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)
), able AS (  -- a window that is alike has that many shingles of the item, so the document has
  SELECT doc_id, item_id, n, k FROM in_doc JOIN bags USING (k, s)
  GROUP BY ALL HAVING 100 * count(DISTINCT in_doc.place) >= {_LIKE} * (n - k + 1)
), windows AS (
  SELECT doc_id, item_id, n, k, start, greatest(start, 0) AS first, least(start + n, size) AS last
  FROM (SELECT able.*, len(w) AS size, unnest(range(1 - n, len(w))) AS start FROM able JOIN words USING (doc_id))
  WHERE least(start + n, size) - greatest(start, 0) >= k
), shares AS (
  SELECT v.doc_id, v.item_id, v.start, v.s, least(v.times, bags.times) AS both_
  FROM (SELECT x.doc_id, item_id, n, x.k, start, s, count(*) AS times
        FROM windows x JOIN in_doc y ON y.doc_id = x.doc_id AND y.k = x.k AND y.place BETWEEN x.first AND x.last - x.k
        GROUP BY ALL) v
  JOIN bags ON bags.item_id = v.item_id AND bags.s = v.s
), alike AS (
  SELECT windows.*, shared / (last - first - k + 1 + n - k + 1 - shared) AS similarity
  FROM windows JOIN (SELECT doc_id, item_id, start, sum(both_) AS shared FROM shares GROUP BY ALL) USING (doc_id, item_id, start)
  WHERE {100 + _LIKE} * shared >= {_LIKE} * (last - first - k + 1 + n - k + 1)
), placed AS (  -- windows in which a shingle stands where an item of that length has it
  SELECT DISTINCT doc_id, item_id, start FROM alike x JOIN in_doc y USING (doc_id, k)
  JOIN (SELECT DISTINCT n, k, s, place AS at FROM bags) b USING (n, k, s)
  WHERE y.place - x.start = b.at
)
SELECT doc_id, item_id, CAST(first AS BIGINT) AS first_word, CAST(last - first AS BIGINT) AS words,
       CAST(similarity AS DOUBLE) AS similarity
FROM alike LEFT JOIN (SELECT *, true AS here FROM placed) USING (doc_id, item_id, start)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id
                           ORDER BY similarity DESC, here DESC NULLS LAST, first, last - first DESC) = 1
"""

_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 175 * count(*) >= 75 * (x.n + y.n)
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM words
  UNION
  SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) LEFT JOIN sizes USING (doc_id)
"""

#: The terms of a text, with repeats.
_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

_RANKED = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         {_TERMS} AS t
  FROM documents
), terms AS (SELECT r, unnest(t) AS term FROM d
), tf AS (SELECT r, term, count(*) AS tf FROM terms GROUP BY ALL
), size AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0
), total AS (SELECT count(*) AS docs, sum(n)::bigint AS l FROM size
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term
), item AS (
  SELECT row_number() OVER () AS i, item_id,
         list_distinct({_TERMS}) AS t
  FROM benchmark
), asked AS (SELECT i, item_id, unnest(t) AS term FROM item
), weighed AS (
  SELECT i, item_id, term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint AS w
  FROM asked JOIN df USING (term), total
), scored AS (
  SELECT i, item_id, doc_id, r,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // l))))::bigint AS score
  FROM weighed JOIN tf USING (term) JOIN size USING (r), total
  GROUP BY i, item_id, doc_id, r
)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::int AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50
"""

_NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), long AS (SELECT r, unnest(x) AS x, unnest(range(len(x))) AS place FROM v
), scores AS (
  SELECT a.r AS a, b.r AS b, sum(a.x * b.x)::bigint AS score
  FROM long a JOIN long b USING (place)
  WHERE a.r IN (SELECT r FROM v WHERE vec_id % 100 = 0)
  GROUP BY a.r, b.r
), pairs AS (
  SELECT p.r AS a, q.r AS b, p.vec_id AS anchor_id, q.vec_id AS id, p.label = q.label AS same, coalesce(score, 0) AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) p JOIN v q ON p.vec_id IS DISTINCT FROM q.vec_id
  LEFT JOIN scores ON scores.a = p.r AND scores.b = q.r
), positives AS (
  SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id NULLS LAST) <= 5
)
SELECT p.anchor_id, p.id AS positive_id,
       row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id NULLS LAST)::int AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""

SQL: dict[str, str] = {
    "op1_quality_rules": _QUALITY,
    "op3_pii": _PII,
    "op7_decontamination": _LEAKS,
    "op9_ngram_jaccard_join": _JOIN,
    "op11_hard_negatives": _NEGATIVES,
    "op13_ranked_search": _RANKED,
}

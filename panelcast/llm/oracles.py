"""DuckDB SQL for the corpus queries that SQL can say."""

from __future__ import annotations

from panelcast.llm.lines import LEAST_WORDS

#: A word is a run of anything but the ASCII blanks; DuckDB's regular expressions know \\x escapes.
_WORD = r"[^\x20\x09-\x0D]+"

EXACT = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

NEAR = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM items a JOIN items b ON a.x = b.x
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), smallest AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN smallest USING (doc_id)
"""

LINES = rf"""
WITH split AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents
), counted AS (
  SELECT doc_id, text, l, list_transform(l, lambda x: len(regexp_extract_all(x, '{_WORD}'))) AS w FROM split
), summed AS (
  SELECT doc_id, text, l, list_transform(range(0, len(l) + 1), lambda i: coalesce(list_sum(w[1 : i]), 0)) AS e FROM counted
), starts AS (
  SELECT doc_id, l, e, unnest(range(1, len(l) + 1)) AS i FROM summed
), ends AS (
  SELECT doc_id, l, e, i,
    list_min(list_filter(range(1, len(l) + 1), lambda j: e[j + 1] >= e[i] + {LEAST_WORDS})) AS stop,
    list_max(list_filter(range(1, len(l) + 1), lambda j: e[i + 1] - e[j] >= {LEAST_WORDS})) AS start
  FROM starts
), runs AS (
  SELECT doc_id, i AS a, stop AS b, array_to_string(l[i : stop], chr(10)) AS run FROM ends WHERE stop IS NOT NULL
  UNION
  SELECT doc_id, start AS a, i AS b, array_to_string(l[start : i], chr(10)) AS run FROM ends WHERE start IS NOT NULL
), later AS (
  SELECT doc_id, a, b FROM runs
  QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, a) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM later
), islands AS (
  SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM gone
), spans AS (
  SELECT doc_id, min(i) - 1 AS start, max(i) AS stop FROM islands GROUP BY doc_id, island
), per_doc AS (
  SELECT doc_id, sum(stop - start) AS n, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed FROM spans GROUP BY doc_id
), gone_lists AS (
  SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
)
SELECT doc_id,
  CASE WHEN g IS NULL THEN text
    ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda k: NOT list_contains(g, k)), lambda k: l[k]), chr(10)) END AS text,
  CAST(coalesce(len(l), 0) AS INTEGER) AS n_lines, CAST(coalesce(n, 0) AS INTEGER) AS removed_lines, coalesce(removed, '') AS removed
FROM split LEFT JOIN per_doc USING (doc_id) LEFT JOIN gone_lists USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), normed AS (
  SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS size FROM vectors
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM normed a JOIN normed b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.size > 0 AND b.size > 0 AND list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), smallest AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN smallest USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

#: CRC-32 of a decimal number as text: eight steps of the shift register for each of its digits.
_CRC = """xor(4294967295, list_reduce(
  list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, ch: list_reduce(list_concat([xor(c, ch)], [0, 0, 0, 0, 0, 0, 0, 0]),
    lambda r, bit: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)))"""

PERIODS = rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, {_CRC} AS h FROM documents
), sized AS (
  SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM split
), placed AS (
  SELECT doc_id, w, n, h, g, CASE WHEN n > 0 THEN g % n END AS a FROM sized
), texts AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END)
    ELSE w END AS w
  FROM placed
), words AS (
  SELECT doc_id, n, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word FROM texts
), same AS (
  SELECT a.doc_id, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), islands AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM same
), stretches AS (
  SELECT doc_id, q, min(i) AS start, max(i) + 1 + q AS stop FROM islands GROUP BY doc_id, q, island
), runs AS (
  SELECT doc_id, start, stop - start AS length, min(q) AS period FROM stretches
  WHERE stop - start >= greatest(6, 4 * q) GROUP BY doc_id, start, stop
), digests AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    arg_max({{'start': start, 'length': length, 'period': period}}, (length, -start, -period)) AS top
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period,
  1000 * top.length // top.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN digests USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece
  FROM documents
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: w[i : i + size - 1])) AS p
  FROM words, (SELECT unnest([1, 2, 3]) AS size)
), counts AS (
  SELECT lang, size, p, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a) AS n FROM counts WHERE size = 1 GROUP BY lang
), candidates AS (
  SELECT lang, size, p, a FROM counts WHERE size > 1 AND a >= 10
), cuts AS (
  SELECT c.lang, c.size, c.p, c.a, k, l.a AS l, r.a AS r,
    CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM (SELECT lang, size, p, a, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.p = c.p[1 : k] JOIN counts r ON r.lang = c.lang AND r.p = c.p[k + 1 : c.size]
), scored AS (
  SELECT lang, size, p, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), longer AS (
  SELECT lang, a, unnest([p[1 : 2], p[2 : 3]]) AS p FROM candidates WHERE size = 3
), kept AS (
  SELECT * FROM scored s
  WHERE NOT EXISTS (SELECT 1 FROM longer g WHERE g.lang = s.lang AND g.p = s.p AND 100 * g.a >= 50 * s.a)
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
    array_to_string(p, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score
  FROM kept
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES = {
    "op2_exact_dedup": EXACT,
    "op9_near_dedup": NEAR,
    "op7_line_dedup": LINES,
    "op11_vector_dedup": VECTORS,
    "op12_periodic_runs": PERIODS,
    "op13_collocations": PHRASES,
}

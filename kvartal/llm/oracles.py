"""SQL (DuckDB) for the operators that SQL can express over whole tables."""

from __future__ import annotations

from kvartal.llm import near_duplicates, quality_rules, spelling_trie, substring_dedup, suffix_dedup, threshold_negatives

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

QUALITY_RULES = rf"""WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
again AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (
  SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM again GROUP BY 1),
lines AS (SELECT doc_id, host, line,
    substr(md5(lower(regexp_replace(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g'))), 1, 16) AS h,
    len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n
  FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
per_doc AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, array_to_string(list_sort(list(DISTINCT h)), '') AS content FROM lines GROUP BY 1),
hot AS (SELECT host, h FROM lines JOIN per_doc USING (doc_id) GROUP BY 1, 2 HAVING count(DISTINCT content) > {quality_rules.MAX_DOCS}),
removed AS (SELECT doc_id, count(*) AS n_lines, sum(n) AS n_words FROM lines l JOIN hot ON l.host IS NOT DISTINCT FROM hot.host AND l.h = hot.h GROUP BY 1),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(p.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(x.n_lines, 0) AS BIGINT) AS n_removed_lines, CAST(coalesce(x.n_words, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN repeats r ON r.doc_id = d.doc_id LEFT JOIN per_doc p ON p.doc_id = d.doc_id LEFT JOIN removed x ON x.doc_id = d.doc_id),
judged AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * (n_words - n_removed_words) >= {quality_rules.MIN_LEFT} * n_words AS kept, n_removed_lines, n_removed_words FROM judged"""

_N, _SIZE = substring_dedup.LENGTH, near_duplicates.WORDS
SUBSTRING_DEDUP = rf"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {_N - 1}], ' ')) AS key FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - {_N - 2})) AS i FROM d WHERE len(w) >= {_N})),
again AS (SELECT doc_id, i FROM windows WHERE key IN (SELECT key FROM windows GROUP BY 1 HAVING count(*) > 1)),
starts AS (SELECT doc_id, list(i) AS at FROM again GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {_N})) AS i FROM again),
lost AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY 1),
kept AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN w ELSE list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN NOT list_contains(gone, i) THEN w[i] END), lambda x: x IS NOT NULL) END AS k
  FROM d LEFT JOIN lost ON lost.doc_id = d.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""

NEAR_DUPLICATES = rf"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + {_SIZE - 1}], ' ')) AS key FROM (
    SELECT doc_id, w, unnest(range(1, len(w) - {_SIZE - 2})) AS i FROM d WHERE len(w) >= {_SIZE})
  UNION ALL SELECT doc_id, 'short ' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {_SIZE - 1}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.key = y.key AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * c.n >= {near_duplicates.SIMILAR} * (p.n + q.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY 1)
SELECT l.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, l.doc_id = component_id AS kept
FROM least l LEFT JOIN n ON n.doc_id = l.doc_id"""

_BYTES = suffix_dedup.LENGTH
#: Bytes as hexadecimal digits, two each; places count bytes from 0.
SUFFIX_DEDUP = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, {2 * _BYTES})) AS key FROM (
  SELECT doc_id, x, unnest(range(0, length(x) // 2 - {_BYTES - 1})) AS i FROM d WHERE length(x) >= {2 * _BYTES})),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {_BYTES} THEN 0 ELSE 1 END AS new FROM later),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {_BYTES} AS b FROM (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM runs),
parts AS (SELECT g.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
    string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN parts p ON p.doc_id = d.doc_id"""

_LONG = spelling_trie.MIN_LENGTH
#: crc32 byte by byte; near words share what is left without one letter.
SPELLING = rf"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
    translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{_LONG},}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents) GROUP BY 1, 2),
drawn AS (SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(0, length(x) // 2),
      lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c // 256, t[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM (SELECT *, hex(encode(doc || ':' || run)) AS x FROM runs), crc),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % {spelling_trie.DRAWN} = 0
    THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM drawn)
  WHERE length(word) >= {_LONG} GROUP BY 1 HAVING sum(n) >= {spelling_trie.MIN_COUNT}),
less AS (SELECT word, length(word) AS size, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT x.word, y.word AS other FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.size = y.size AND x.word <> y.word
  UNION SELECT less.word, w.word FROM less JOIN words w ON w.word = rest UNION SELECT w.word, less.word FROM less JOIN words w ON w.word = rest),
best AS (SELECT near.word, count(*) AS n_near, min(struct_pack(less := -w.n, other := other)) AS b FROM near JOIN words w ON w.word = other GROUP BY 1),
forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= {spelling_trie.TIMES} * n THEN b.other END AS form,
    CASE WHEN -b.less >= {spelling_trie.TIMES} * n THEN -b.less END AS form_n FROM words LEFT JOIN best ON best.word = words.word),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, form FROM walk JOIN forms ON forms.word = walk.at WHERE form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM forms f JOIN walk w ON w.word = f.word JOIN forms e ON e.word = w.at AND e.form IS NULL"""

_FEW = threshold_negatives.POSITIVES
NEGATIVES = f"""WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % {threshold_negatives.EVERY} = 0 AND a.vec_id <> b.vec_id),
positive AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {_FEW})
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND {threshold_negatives.SHARE} * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= {threshold_negatives.NEGATIVES}"""

SQL = {
    "op1_quality_rules": QUALITY_RULES,
    "op4_near_duplicates": NEAR_DUPLICATES,
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op10_suffix_dedup": SUFFIX_DEDUP,
    "op12_threshold_negatives": NEGATIVES,
    "op13_spelling_trie": SPELLING,
}

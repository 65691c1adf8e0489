"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from impactrec.llm.licenses import PHRASES, TEMPLATES

WORDS = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
win AS (
  SELECT k, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM doc WHERE len(w) >= 8)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY k),
line AS (
  SELECT k, source, t, l, array_to_string(regexp_extract_all(l, '{WORDS}'), ' ') AS s,
         len(regexp_extract_all(l, '{WORDS}')) AS n
  FROM (SELECT k, source, t, unnest(string_split(t, chr(10))) AS l FROM doc) WHERE regexp_matches(l, '{WORDS}')),
dup AS (SELECT k, count(*) - count(DISTINCT l) AS n FROM line GROUP BY k),
norm AS (
  SELECT k, source, t, n,
         translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM line),
above AS (
  SELECT source, s FROM (SELECT source, s, count(DISTINCT t) AS c FROM norm GROUP BY source, s) WHERE c > 5),
gone AS (
  SELECT k, count(DISTINCT norm.s) AS lines, sum(n) AS words FROM norm
  JOIN above ON norm.s = above.s AND norm.source IS NOT DISTINCT FROM above.source GROUP BY k),
num AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(gone.lines, 0) AS BIGINT) AS n_removed_lines,
    CAST(len(w) - coalesce(gone.words, 0) AS BIGINT) AS n_left_words
  FROM doc LEFT JOIN dup USING (k) LEFT JOIN rep USING (k) LEFT JOIN gone USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND n_left_words >= 20 AND n_left_words >= 0.3 * n_words AS kept,
  n_removed_lines, n_left_words
FROM num
"""

MIXING = rf"""
WITH doc AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS size FROM documents),
src AS (
  SELECT source, CAST(n AS BIGINT) AS source_size,
    [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS INT)] AS w
  FROM (SELECT source, sum(size) AS n FROM doc GROUP BY source)),
step AS (
  SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER before, 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight
  FROM src WINDOW before AS (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
full_ AS (SELECT *, rest * w / weight >= 2.0 * source_size AS is_full FROM step),
goal AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE) ELSE
    CAST(1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (is_full) OVER (), 0) AS DOUBLE) * w
      / sum(w) FILTER (NOT is_full) OVER () END AS target
  FROM full_),
cum AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY left(md5('mix:' || doc_id), 16), doc_id
                            ROWS UNBOUNDED PRECEDING) AS cum
  FROM doc),
cut AS (
  SELECT cum.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget
  FROM cum JOIN goal ON cum.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, source, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + greatest(0, least(size, budget % source_size - (cum - size))) END AS BIGINT) AS taken
FROM cut
"""


NEAREST = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(r AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""

JACCARD = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
gram AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0))),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a AS doc_id, a AS other FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON r.other = l.a)
SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc.doc_id, coalesce(m, doc.doc_id)) AS component_id
FROM doc LEFT JOIN size USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) USING (doc_id)
"""

_PHRASES = [(p.split(), l) for p, l in PHRASES.items()]
_PLACES = " UNION ALL ".join(
    f"SELECT k, i, '{label}' AS label FROM pos WHERE "
    + " AND ".join(f"w[i + {j}] = '{word}'" for j, word in enumerate(words, 1))
    for words, label in _PHRASES
)
_TEMPLATE_ROWS = ", ".join(
    f"({n}, '{t.label}', '{t.text.lower()}', {list(t.must)!r}::VARCHAR[], {list(t.without)!r}::VARCHAR[])" for n, t in enumerate(TEMPLATES)
)
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LICENSES = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
word AS (SELECT k, doc_id, regexp_extract_all(t, '{ALNUM}') AS w FROM doc),
pos AS (SELECT k, w, unnest(range(0, len(w))) AS i FROM word),
place AS ({_PLACES}),
base AS (
  SELECT k, count(*) AS n, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base
  FROM place GROUP BY k),
full_ AS (
  SELECT n, label, list_distinct(regexp_extract_all(t, '{ALNUM}')) AS words, 2 * len(regexp_extract_all(t, '{ALNUM}')) AS span,
    must, without FROM (VALUES {_TEMPLATE_ROWS}) AS v(n, label, t, must, without)),
tmpl AS (SELECT n, label, unnest(words) AS word FROM full_),
size AS (
  SELECT n, len(words) AS size, CASE WHEN len(words) < 12 THEN len(words) ELSE ceil(0.8 * len(words) - 1e-9) END AS least FROM full_),
raw AS (SELECT k, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM doc),
line AS (SELECT k, i, l, sum(CASE WHEN regexp_matches(l, '{ALNUM}') THEN 0 ELSE 1 END)
           OVER (PARTITION BY k ORDER BY i) AS p FROM raw),
block AS (
  SELECT row_number() OVER () AS b, k, l FROM (
    SELECT k, l FROM line UNION ALL
    SELECT k, string_agg(l, chr(10) ORDER BY i) AS l FROM line WHERE regexp_matches(l, '{ALNUM}')
    GROUP BY k, p HAVING count(*) > 1)),
spot AS (
  SELECT b, k, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT b, k, regexp_extract_all(l, '{ALNUM}') AS w FROM block)),
maybe AS (
  SELECT b, k, n FROM (SELECT b, k, n, count(DISTINCT word) AS c FROM spot JOIN tmpl USING (word) GROUP BY b, k, n) JOIN size USING (n)
  WHERE c >= least),
place_ AS (
  SELECT b, k, n, x.i, list(DISTINCT y.word) AS held FROM maybe JOIN full_ USING (n) JOIN spot x USING (b, k) JOIN spot y USING (b, k)
  WHERE list_contains(words, x.word) AND y.i >= x.i AND y.i < x.i + span GROUP BY b, k, n, x.i),
met AS (
  SELECT b, k, n, any_value(label) AS label, max(len(list_intersect(held, words)) / size) AS part
  FROM place_ JOIN full_ USING (n) JOIN size USING (n)
  WHERE list_has_all(held, must) AND NOT list_has_any(held, without) AND len(list_intersect(held, words)) >= least
  GROUP BY b, k, n),
notice AS (SELECT k, count(*) AS n_notices, list(DISTINCT label) AS labels, max(part) AS score FROM met GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(base.n, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(labels, [])))), ','), '')
    AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices
FROM word LEFT JOIN base USING (k) LEFT JOIN notice USING (k)
"""


#: The table of the byte-wise checksum, and the unsigned crc32 of an expression over its bytes.
_CRC_TABLE = """
crc_step(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crc_t FROM crc_step WHERE k = 8)"""


def _crc32(bytes_: str) -> str:
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), "
        "lambda a, b: xor(a >> 8, crc_t[CAST(xor(a, b) & 255 AS INT) + 1])), 4294967295)"
    )


PREFIX_TRIE = rf"""
WITH RECURSIVE {_CRC_TABLE},
own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, turns,
    {_crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 4 AS h
  FROM own, crc_table),
conv AS (
  SELECT h.conv_id, list_concat(list_slice(coalesce(first.turns, []), 1, h.h), list_slice(h.turns, h.h + 1, len(h.turns))) AS path
  FROM h LEFT JOIN own first ON first.conv_id = h.conv_id - h.conv_id % 20),
member AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS d FROM conv),
node AS (
  SELECT d AS depth, list_slice(path, 1, d) AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(CASE WHEN len(path) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
  FROM member GROUP BY ALL),
up AS (
  SELECT node.*, parent.conv_id AS parent_conv_id, CASE WHEN node.depth = 0 THEN 0 ELSE
    (node.n_convs - 1) * len(regexp_extract_all(node.p[node.depth].t, '{WORDS}')) END AS own_saved
  FROM node LEFT JOIN node parent ON parent.depth = node.depth - 1 AND parent.p = list_slice(node.p, 1, node.depth - 1)),
child AS (SELECT parent_conv_id AS c, depth - 1 AS d, count(*) AS n FROM up WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT up.*, coalesce(child.n, 0) AS n_children FROM up LEFT JOIN child ON c = conv_id AND d = depth),
above AS (SELECT p, n_children, own_saved, unnest(range(0, depth + 1)) AS d FROM full_),
below AS (
  SELECT d, list_slice(p, 1, d) AS q, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own_saved) AS saved
  FROM above GROUP BY ALL)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs,
  CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(ends) AS ends_sha256
FROM full_ JOIN below ON d = depth AND q = p
"""


SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
run AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id,
      translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) GROUP BY ALL),
digits AS (SELECT *, hex(encode(doc_id || ':' || run)) AS x FROM run),
code AS (
  SELECT run, times,
    {_crc32("list_transform(range(1, length(x), 2), lambda i: "
            "CAST((instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1 AS BIGINT))")} AS h
  FROM digits, crc_table),
word AS (
  SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS INT))
    || substring(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS w, times FROM code),
v AS (SELECT w, CAST(sum(times) AS BIGINT) AS n FROM word WHERE length(w) >= 5 GROUP BY w HAVING sum(times) >= 3),
place AS (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v),
hole AS (SELECT w, n, i, substring(w, 1, i - 1) || '*' || substring(w, i + 1) AS p FROM place),
less AS (SELECT DISTINCT w, n, substring(w, 1, i - 1) || substring(w, i + 1) AS p FROM place),
near AS (
  SELECT a.w, a.n, b.w AS o, b.n AS m FROM hole a JOIN hole b ON a.p = b.p AND a.w <> b.w
  UNION ALL SELECT less.w, less.n, v.w, v.n FROM less JOIN v ON less.p = v.w
  UNION ALL SELECT v.w, v.n, less.w, less.n FROM less JOIN v ON less.p = v.w),
best AS (
  SELECT w, n, count(*) AS n_near, first(o ORDER BY m DESC, encode(o)) AS o, max(m) AS m FROM near GROUP BY w, n),
form AS (SELECT w, n, n_near, CASE WHEN m >= 2 * n THEN o END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM best),
step(w, r) AS (
  SELECT w, w FROM v UNION ALL SELECT step.w, form.form FROM step JOIN form ON form.w = step.r WHERE form.form IS NOT NULL),
root AS (SELECT step.w, r FROM step LEFT JOIN form ON form.w = r WHERE form.form IS NULL)
SELECT v.w AS word, form, r AS root, v.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, form_n
FROM v JOIN root ON root.w = v.w LEFT JOIN form ON form.w = v.w
"""


def llm_oracle() -> dict[str, str]:
    return {
        "op2_quality": QUALITY, "op3_mixing": MIXING, "op4_jaccard": JACCARD, "op5_nearest": NEAREST, "op7_licenses": LICENSES,
        "op12_spelling": SPELLING, "op13_prefix_trie": PREFIX_TRIE,
    }

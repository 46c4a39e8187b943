"""SQL that states the results of spelling variants, exact search and phrases."""

SPELLING = r"""
WITH RECURSIVE runs AS (
  SELECT d || ':' || run AS told, run, count(*) AS n FROM (
    SELECT doc_id::VARCHAR AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
steps AS (
  SELECT i AS b, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
  FROM range(256) AS t(i)),
-- crc32 is the exclusive or of what each byte amounts to at its distance from the end, b = 256 standing for the initial value
amounts AS (
  SELECT 0 AS away, b, v FROM steps UNION ALL SELECT 0, 256, 4294967295
  UNION ALL SELECT away + 1, a.b, xor(a.v >> 8, s.v) FROM amounts a JOIN steps s ON s.b = a.v & 255
  WHERE away < (SELECT max(strlen(told)) FROM runs)),
places AS (SELECT told, hex(encode(told)) AS h, unnest(range(strlen(told) + 1)) AS away FROM (SELECT DISTINCT told FROM runs)),
crcs AS (
  SELECT told, xor(4294967295, bit_xor(v)) AS h FROM (
    SELECT told, away, CASE WHEN 2 * away = length(h) THEN 256 ELSE ('0x' || substr(h, length(h) - 2 * away - 1, 2))::BIGINT END AS b FROM places)
  JOIN amounts USING (away, b) GROUP BY told),
hashed AS (SELECT run, n, h FROM runs JOIN crcs USING (told)),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.v = b.v AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN words b ON a.v = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN words b ON a.v = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
known AS (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
chains AS (
  SELECT word, form AS root FROM known WHERE form IS NOT NULL
  UNION ALL SELECT s.word, k.form FROM chains s JOIN known k ON s.root = k.word WHERE k.form IS NOT NULL),
ends AS (SELECT s.word, s.root FROM chains s JOIN known k ON s.root = k.word WHERE k.form IS NULL)
SELECT word, n, n_near, form, form_n, coalesce(root, word) AS root FROM known LEFT JOIN ends USING (word)
"""

EXACT_SEARCH = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 20
"""

PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, p, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM numbered),
runs AS (
  SELECT lang, w AS w1, w || ' ' || lead(w) OVER o AS w2, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS w3,
    w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS w4
  FROM words WINDOW o AS (PARTITION BY p ORDER BY i)),
counts AS MATERIALIZED (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, 1 AS m, w1 AS phrase FROM runs UNION ALL SELECT lang, 2, w2 FROM runs UNION ALL SELECT lang, 3, w3 FROM runs
    UNION ALL SELECT lang, 4, w4 FROM runs)
  WHERE phrase IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
firsts AS MATERIALIZED (
  SELECT c.*, x.f AS l FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')),
scored AS MATERIALIZED (
  SELECT c.lang, c.phrase, c.a, c.k, c.l, y.f AS r, (2000000::HUGEINT * c.a // (c.l + y.f))::BIGINT AS score
  FROM firsts c JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM (
    SELECT lang, a, w, s, unnest(range(1, m - s + 2)) AS i FROM candidates, range(2, 4) AS sizes(s) WHERE s < m)
  GROUP BY ALL),
own AS (
  SELECT w.lang, w.phrase, w.a, w.l, w.r, w.score FROM weakest w LEFT JOIN inner_parts i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM own)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

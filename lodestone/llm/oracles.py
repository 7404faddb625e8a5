"""DuckDB SQL for the queries that SQL can express over whole tables."""

SQL: dict[str, str] = {}

#: Fixed value: the words of a text.
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

SQL["op3_sampled_splitters"] = """
WITH d AS (
  SELECT doc_id, md5(coalesce(text, '')) AS k, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size, coalesce(text, '') AS text FROM documents
), p AS (
  SELECT *, sum(size) OVER (ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size AS place, sum(size) OVER () AS whole FROM d
), s AS (
  SELECT *, CAST(place * 40 // whole AS INTEGER) AS shard FROM p
), bits AS (
  SELECT list(n ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS n
    FROM (SELECT unnest(range(0, 256)) AS i))
)
SELECT doc_id, size,
  CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(concat('0x', substr(hex(encode(text)), 2 * j + 1, 2)) AS BIGINT) FOR j IN range(0, strlen(text))]),
    lambda c, b: xor(bits.t[(xor(c, b) & 255) + 1], c // 256))) AS BIGINT) AS text_crc32,
  'bytes' AS law, shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM s, bits
"""

SQL["op1_substring_dedup"] = f"""
WITH d AS (
  SELECT doc_id, {WORDS} AS w FROM documents
), x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, greatest(1, len(w) - 18))) AS r(i)
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS n FROM x
), gone AS (
  SELECT DISTINCT doc_id, j FROM f, unnest(range(i, i + 20)) AS r(j) WHERE n > 1
), p AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d
), k AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY j) AS kept FROM p ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op10_ngram_join"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.replace('coalesce(text', f'coalesce({LOWER}')} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, greatest(2, len(w) - 3))) AS r(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), c AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a
), m AS (
  SELECT a AS doc_id, min(b) AS component_id FROM c GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

SQL["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents
), x AS (
  SELECT *, len(u) AS n, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) % (len(u) + 1) AS i, CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) % (len(u) + 1) AS j,
    CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) % 100 AS h3, CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) % 100 AS h4 FROM d
), f AS (
  SELECT doc_id, n, t, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(i, j)], '') AS p, array_to_string(u[least(i, j) + 1:greatest(i, j)], '') AS m, array_to_string(u[greatest(i, j) + 1:n], '') AS s FROM x
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) WHEN 'spm' THEN concat('<S>', s, '<P>', p, '<M>', m) ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""

SQL["op11_collocations"] = f"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM d
), g AS (
  SELECT lang, k, w[i:i + k - 1] AS x FROM p, unnest([1, 2, 3, 4, 5]) AS s(k), unnest(range(1, greatest(1, len(w) - k + 2))) AS r(i)
), f AS (
  SELECT lang, k, x, count(*) AS a FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (
  SELECT lang, k, x, a FROM f WHERE k > 1 AND a >= 100
), cuts AS (
  SELECT c.lang, c.x, c.a, j, y.a AS l, z.a AS r, n, 1000 * CAST(c.a AS HUGEINT) * CAST(n AS HUGEINT) // (CAST(y.a AS HUGEINT) * CAST(z.a AS HUGEINT)) AS score
  FROM c JOIN n USING (lang), unnest(range(1, c.k)) AS s(j) JOIN f y ON y.lang = c.lang AND y.x = c.x[1:j] JOIN f z ON z.lang = c.lang AND z.x = c.x[j + 1:c.k]
), low AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, j) = 1
), inner_ AS (
  SELECT DISTINCT c.lang, c.x[i:i + m - 1] AS x FROM c, unnest([2, 3, 4]) AS s(m), unnest(range(1, greatest(1, c.k - m + 2))) AS r(i) JOIN c AS b ON b.lang = c.lang AND b.x = c.x[i:i + m - 1] WHERE m < c.k AND c.a >= b.a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(x, ' ')) AS rank, array_to_string(x, ' ') AS phrase, a, l, r, n, score
  FROM low ANTI JOIN inner_ USING (lang, x)
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000
"""

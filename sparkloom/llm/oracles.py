"""SQL checks of the operators that SQL can express."""

WARC = """
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> leader THEN leader END AS refers_to
FROM (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS leader
      FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages))"""

#: Only A-Z are lower-cased.
_LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(c: str) -> str:
    return f"regexp_extract_all({_LOWER.format(c=c)}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


DECONTAMINATION = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_words('text')} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
        FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, coalesce({_words('text')}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, dw.n AS n, i, item FROM dw JOIN win USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _spans(kind: str, rank: int, pattern: str, group: int, least: int, more: str = "") -> str:
    """Spans of one kind: (row, kind, rank, s, e, v); split and extract_all see the same matches."""
    p = pattern.replace("'", "''")
    return f"""
SELECT row, '{kind}' AS kind, {rank} AS rank, s, s + length(m) AS e, v FROM (
  SELECT row, m, v, i, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT row, gaps, whole, unnest(whole) AS m, unnest(val) AS v, generate_subscripts(whole, 1) AS i
        FROM (SELECT row, regexp_split_to_array(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS whole,
                     regexp_extract_all(text, '{p}', {group}) AS val FROM d)))
WHERE length(v) >= {least} {more}"""


SECRETS = """
WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
base AS (""" + " UNION ALL ".join([
    _spans("assign", 0, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    _spans("access", 1, "AKIA[A-Z0-9]+", 0, 20), _spans("hex", 2, "[0-9a-f]+", 0, 24)]) + """),
tok AS (""" + _spans("owned", 3, "[A-Za-z0-9+/_-]{20,}={0,2}", 0, 20,
                     "AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')") + """),
everything AS (SELECT * FROM base UNION ALL SELECT * FROM tok),
own AS (SELECT v, count(DISTINCT source) + max((source IS NULL)::INT) AS n_owners,
               count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS n_repositories FROM everything JOIN d USING (row) GROUP BY v),
kept AS (SELECT e.*, n_owners <= 1 AND n_repositories <= 10 AS live FROM everything e JOIN own USING (v)
         WHERE rank < 3 OR (n_owners <= 1 AND n_repositories <= 10 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = e.row AND b.s < e.e AND e.s < b.e)))
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '') AS spans,
       count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
FROM d LEFT JOIN kept USING (row) GROUP BY row, doc_id"""

LINES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM d)),
full_lines AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i, {_LOWER.format(c="regexp_replace(line, '^[ \\t\\x0B\\f\\r]+|[ \\t\\x0B\\f\\r]+$', '', 'g')")} AS line
               FROM raw WHERE regexp_matches(line, '[^ \\t\\x0B\\f\\r]')),
win AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS nth FROM (
          SELECT doc_id, i, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c FROM full_lines WINDOW w AS (PARTITION BY doc_id ORDER BY i))
        WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM win WHERE nth > 1),
marked AS (SELECT r.doc_id, r.pos, r.line, f.i, g.i IS NOT NULL AS gone FROM raw r LEFT JOIN full_lines f USING (doc_id, pos)
           LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.i = f.i),
starts AS (SELECT doc_id, count(*) AS n_runs FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone p WHERE p.doc_id = g.doc_id AND p.i = g.i - 1) GROUP BY doc_id)
SELECT doc_id, count(i) AS n_lines, count(*) FILTER (gone) AS n_removed, any_value(coalesce(n_runs, 0))::BIGINT AS n_runs,
       strlen(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), ''))::BIGINT AS kept_bytes,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked LEFT JOIN starts USING (doc_id) GROUP BY doc_id"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format(c='text')}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT a AS v, a AS r FROM link UNION SELECT link.b AS v, reach.r FROM reach JOIN link ON link.a = reach.v),
comp AS (SELECT v, min(r) AS root FROM reach GROUP BY v)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN comp ON v = doc_id"""


#: crc32 of a word by its published table, made from the polynomial.
_CRC = """
tab AS (SELECT list(c ORDER BY i) AS t FROM (
          SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
          FROM range(256) r(i))),
hashed AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(strlen(w)), lambda i:
                  (instr('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
           FROM (SELECT w, hex(encode(w)) AS h FROM vocabulary), tab)"""

RESAMPLING = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_words('text')}, []) AS w FROM documents),
dw AS (SELECT row, w, count(*) AS c FROM (SELECT row, unnest(w) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS c FROM (SELECT unnest({_words('text')}) AS w FROM benchmark) GROUP BY ALL),
vocabulary AS (SELECT w FROM dw UNION SELECT w FROM bw),{_CRC},
s AS (SELECT bucket, sum(c)::DOUBLE AS s FROM dw JOIN hashed USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(c)::DOUBLE AS t FROM bw JOIN hashed USING (w) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS sa, (SELECT coalesce(sum(t), 0) FROM t) AS ta),
gain AS (SELECT b.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (sa + 10000) / ((coalesce(s, 0) + 1) * (ta + 10000))))::BIGINT AS gain
         FROM range(10000) b(bucket) LEFT JOIN s ON s.bucket = b.bucket LEFT JOIN t ON t.bucket = b.bucket, total),
weighed AS (SELECT row, doc_id, len(w)::BIGINT AS n_features, coalesce(floor(total / len(w)), 0)::BIGINT AS weight
            FROM d LEFT JOIN (SELECT row, sum(c * gain)::DOUBLE AS total FROM dw JOIN hashed USING (w) JOIN gain USING (bucket) GROUP BY row) USING (row)),
scored AS (SELECT row, doc_id, n_features, weight,
                  weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
           FROM weighed),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () * 10 // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM scored LEFT JOIN ranked USING (row)"""

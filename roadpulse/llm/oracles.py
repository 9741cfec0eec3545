"""DuckDB SQL for the queries that SQL can express; it shares no code with the operators."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, unnest([list_slice(ws, i, i + 9) FOR i IN range(1, greatest(len(ws) - 9, 1) + 1)]) AS win
            FROM items WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
places AS (SELECT r, ws, n, unnest(range(1, CAST(len(ws) AS BIGINT) - n + 2)) AS i FROM docs, sizes),
found AS (SELECT r, i, n, item FROM (SELECT r, i, n, list_slice(ws, i, i + n - 1) AS win FROM places) JOIN windows USING (win)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)"""

WARC = """
WITH c AS (SELECT page_id, url, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS sha FROM pages),
k AS (SELECT sha, size, max(page_id) AS kept FROM c WHERE size >= 1000 AND page_id IS NOT NULL GROUP BY 1, 2),
m AS (SELECT c.*, coalesce(kept > page_id, false) AS revisit, kept,
             md5('request' || chr(10) || coalesce('=' || page_id, '-') || chr(10) || coalesce('=' || url, '-') || chr(10)
                 || '=' || sha) AS h
      FROM c LEFT JOIN k USING (sha, size))
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, sha AS payload_digest,
       CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN kept END AS refers_to, url AS target_uri,
       '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS request_id
FROM m"""

# components beyond 10^7 would not be exact in the inner products
_NEAREST = """
{a} AS MATERIALIZED (SELECT r, p, x, min((xx + yy - 2 * list_inner_product(x, y)) * 64 + e) AS best
                     FROM parts JOIN {book} USING (p) GROUP BY r, p, x)"""
_BOOK = """
{new}_at AS (SELECT p, e, i, any_value(y[i]) AS was, any_value(s) AS s, any_value(n) AS n
             FROM (SELECT p, e, y, unnest(range(1, len(y) + 1)) AS i FROM {old}) LEFT JOIN
                  (SELECT p, CAST(best AS BIGINT) % 64 AS e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n
                   FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM {a}) GROUP BY 1, 2, 3) USING (p, e, i)
             GROUP BY p, e, i),
{new}_y AS (SELECT p, e, list(CASE WHEN n IS NULL THEN was ELSE (s - ((s % n) + n) % n) // n END ORDER BY i)::DOUBLE[] AS y
            FROM {new}_at GROUP BY p, e),
{new} AS MATERIALIZED (SELECT p, e, y, list_inner_product(y, y) AS yy FROM {new}_y)"""

VECTOR_CODES = f"""
WITH kept AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
              AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
dims AS (SELECT CAST(greatest(ceil(max(len(v)) / 16.0), 1) AS BIGINT) AS w FROM kept),
numbered AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, w,
                    list_resize(list_transform(v, lambda x: greatest(least(floor(256 * x), 33554432), -33554432)), 16 * w, 0) AS v
             FROM kept, dims),
cut AS (SELECT r, p, list_slice(v, p * w + 1, (p + 1) * w) AS x FROM numbered, range(16) AS t(p)),
parts AS MATERIALIZED (SELECT r, p, x, list_inner_product(x, x) AS xx FROM cut),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y, xx AS yy FROM parts WHERE r <= 64),
{_NEAREST.format(a="a0", book="book0")}, {_BOOK.format(new="book1", old="book0", a="a0")},
{_NEAREST.format(a="a1", book="book1")}, {_BOOK.format(new="book2", old="book1", a="a1")},
{_NEAREST.format(a="a2", book="book2")},
coded AS (SELECT r, string_agg(printf('%02x', CAST(best AS BIGINT) % 64), '' ORDER BY p) AS code,
                 CAST(sum(CAST(best AS BIGINT) // 64) AS BIGINT) AS error FROM a2 GROUP BY r),
sha AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS sha
        FROM (SELECT p, e, unnest(y) AS v, unnest(range(len(y))) AS i FROM book2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM coded JOIN numbered USING (r), sha"""

_SIZED = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),"""

MIXING = _SIZED + """
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
      FROM d GROUP BY source),
w AS (SELECT *, rank % 3 + 1 AS weight, CAST(sum(words) OVER () AS BIGINT) AS budget FROM s),
-- the level with the k sources of least words a weight at their bound; the largest of them is the right one
steps AS (SELECT budget - 3 * coalesce(CAST(sum(words) OVER b AS BIGINT), 0) AS up,
                 CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS BIGINT) AS down
          FROM w WINDOW b AS (ORDER BY words / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
high AS (SELECT CAST(up AS HUGEINT) AS up, down FROM steps ORDER BY up / down DESC LIMIT 1),
t AS (SELECT source, rank, words, 3 * words * down <= up * weight AS bound,
             CASE WHEN bound THEN 3.0 * words ELSE CAST(up AS DOUBLE) * weight / down END AS target, weight, up, down FROM w, high),
f AS (SELECT *, CAST(coalesce(sum(CASE WHEN bound THEN 0 ELSE weight END)
                              OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS before FROM t),
q AS (SELECT source, rank, words, CAST(target AS DOUBLE) AS target,
             CASE WHEN bound THEN 3 * words ELSE CAST((before + weight) * up // down - before * up // down AS BIGINT) END AS quota FROM f),
o AS (SELECT k, doc_id, size, source, CASE WHEN size = 0 THEN 0 ELSE CAST(sum(size) OVER (
          PARTITION BY source ORDER BY substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 15),
          CAST(doc_id AS VARCHAR) NULLS FIRST, size, k) - size AS BIGINT) END AS before FROM d)
SELECT doc_id, size, words AS source_size, target, quota,
       CAST(list_sum([greatest(0, least(size, quota - (r * words + before))) FOR r IN range(3)]) AS BIGINT) AS taken,
       CAST(list_sum([CASE WHEN size > 0 AND quota > r * words + before THEN 1 ELSE 0 END FOR r IN range(3)]) AS BIGINT) AS repeats_begun
FROM o JOIN q ON o.source IS NOT DISTINCT FROM q.source"""

PREFIX_TRIE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, length(coalesce(text, '')) AS n,
                  sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h
           FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id, list(h ORDER BY turn NULLS FIRST, role, h) AS hs, list(n ORDER BY turn NULLS FIRST, role, h) AS ns
                     FROM t GROUP BY conv_id),
tab AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384)
                                                                              ELSE a >> 1 END) ORDER BY i) AS tab
        FROM range(256) AS r(i)),
shared AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
                                           lambda ch: CAST(ascii(ch) AS BIGINT))),
                                           lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % 6 AS h
           FROM own, tab),
built AS MATERIALIZED (
    SELECT o.conv_id, list_concat(coalesce(list_slice(b.hs, 1, h), []), list_slice(o.hs, h + 1, len(o.hs))) AS hs,
           list_concat(coalesce(list_slice(b.ns, 1, h), []), list_slice(o.ns, h + 1, len(o.ns))) AS ns
    FROM own AS o JOIN shared USING (conv_id) LEFT JOIN own AS b ON b.conv_id = o.conv_id - o.conv_id % 100),
places AS (SELECT conv_id, d, array_to_string(list_slice(hs, 1, d), '') AS node, CASE WHEN d > 0 THEN ns[d] ELSE 0 END AS n, d = len(hs) AS ended
           FROM (SELECT *, unnest(range(len(hs) + 1)) AS d FROM built)),
nodes AS MATERIALIZED (
    SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n) AS saved,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
    FROM places GROUP BY node, d),
kids AS (SELECT left(node, 64 * (d - 1)) AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
below AS (SELECT left(node, 64 * k) AS node, count(*) FILTER (n_children IS NULL) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
          FROM (SELECT *, unnest(range(d + 1)) AS k FROM nodes LEFT JOIN kids USING (node)) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       v.ends_sha256
FROM nodes AS v JOIN below USING (node) LEFT JOIN kids USING (node)
LEFT JOIN nodes AS u ON v.d > 0 AND u.node = left(v.node, 64 * (v.d - 1))"""

SQL = {"op1_benchmark_decontamination": DECONTAMINATION, "op3_warc_transactions": WARC,
       "op11_prefix_trie": PREFIX_TRIE, "op12_vector_codes": VECTOR_CODES, "op13_mixing": MIXING}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS body
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spots AS (
  SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS body
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, k, windows.n, item_id FROM spots JOIN windows USING (n, body)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP4 = """
WITH polynomial AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, list_transform(range(8), lambda z: CAST(0 AS BIGINT))), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
bytes AS (
  SELECT doc_id, text, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (
  SELECT doc_id, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM bytes, polynomial),
cost AS (
  SELECT doc_id, s, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#' || s), 1, 13) AS BIGINT) + 0.5) / 4503599627370496) AS c
  FROM documents, (SELECT unnest(range(25)) AS s)),
best AS (
  SELECT doc_id, CAST(arg_min(s, c) FILTER (WHERE s < 24) AS INTEGER) AS shard, CAST(arg_min(s, c) AS INTEGER) AS grown_shard FROM cost GROUP BY doc_id)
SELECT doc_id, CAST(n + 8 AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM sums JOIN best USING (doc_id)
"""


OP3 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS v, a AS r FROM edge UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.v WHERE reach.r < edge.b),
root AS (SELECT v, min(r) AS r FROM reach GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least(root.r, d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN root ON root.v = d.doc_id
"""


OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, k, array_to_string(list_slice(w, k, k + 34), ' ') AS body FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)),
again AS (SELECT body FROM windows GROUP BY body HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(k, k + 35)) AS p FROM windows JOIN again USING (body)),
places AS (SELECT r, w[p] AS word, p FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS kept FROM places ANTI JOIN gone USING (r, p) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
"""


def _op12(rounds: int = 6) -> str:
    """Parts as rows (vec_id, p, x): rounds of exhaustive assignment and floored means, written out one after the other."""
    steps = [r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (SELECT r, p, x[p * (len(x) // 8) + 1 : (p + 1) * (len(x) // 8)] AS x FROM v, (SELECT unnest(range(8)) AS p)),
places AS (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS k),
book0 AS (SELECT p, e, x AS c FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < 16) USING (r))"""]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS (
  SELECT r, p, arg_min(struct_pack(e := e, d := d), struct_pack(d := d, e := e)) AS best
  FROM (SELECT r, p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts JOIN book{k} USING (p)) GROUP BY r, p)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c
  FROM (SELECT p, best.e AS e, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS n FROM near{k} JOIN parts USING (r, p), places GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS (SELECT p, e, coalesce(mean{k}.c, book{k}.c) AS c FROM book{k} LEFT JOIN mean{k} USING (p, e))""")
    return ",\n".join(steps) + f""",
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN coded USING (r), digest
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op3_jaccard_join": OP3, "op4_sharding": OP4, "op11_windows": OP11, "op12_codes": _op12()}

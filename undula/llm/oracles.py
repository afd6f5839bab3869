"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations


def _hash(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 12))::bigint"


def _draw(path: str, weight: int) -> str:
    return f"-ln(({_hash(f"k || '|' || {path}")} + 1)::double / {16**12}.0::double) / {weight}::double"


#: Four regions of two racks of two shards, and a seventeenth shard in a region of its own. The CRC table is made by its rule.
SHARDING = f"""WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
d AS (SELECT doc_id, 'k' || doc_id AS k, encode(coalesce(text, '')) AS raw FROM documents),
r AS (SELECT doc_id, k, arg_min(c, x) AS region, min(x) AS best FROM (SELECT doc_id, k, c, {_draw("'/r' || c", 4)} AS x FROM d, (SELECT unnest(range(4)) AS c)) GROUP BY ALL),
a AS (SELECT doc_id, k, region, best, arg_min(c, x) AS rack FROM (SELECT doc_id, k, region, best, region * 2 + c AS c, {_draw("'/r' || region || '/k' || (region * 2 + c)", 2)} AS x FROM r, (SELECT unnest(range(2)) AS c)) GROUP BY ALL),
s AS (SELECT doc_id, k, best, arg_min(c, x) AS shard FROM (SELECT doc_id, k, best, rack * 2 + c AS c, {_draw("'/r' || region || '/k' || rack || '/s' || (rack * 2 + c)", 1)} AS x FROM a, (SELECT unnest(range(2)) AS c)) GROUP BY ALL)
SELECT doc_id, octet_length(raw) + 1 AS size, xor(list_reduce([{2**32 - 1}::bigint] || list_transform(regexp_extract_all(hex(raw), '..'), lambda h: ('0x' || h)::bigint), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), {2**32 - 1}) AS text_crc32,
'key' AS law, shard::int AS shard, row_number() OVER (PARTITION BY shard ORDER BY {_hash("k || '|slot'")} % 256, doc_id) - 1 AS slot, CASE WHEN {_draw("'/x16'", 1)} < best THEN 16 ELSE shard END::int AS grown_shard
FROM s JOIN d USING (doc_id, k), crc"""

NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT w.doc_id, count(g.s) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
re(i, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT y, re.c FROM re JOIN l ON re.i = l.x WHERE re.c < l.y),
m AS (SELECT i, min(c) AS component_id FROM re GROUP BY i)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m ON i = doc_id"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
t AS (SELECT h, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN coalesce(top, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(top, page_id) AS refers_to FROM p LEFT JOIN t ON p.h = t.h"""

#: Fill-in-middle from the definition: units by pattern, cuts by draws, lists of units put together.
INFILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

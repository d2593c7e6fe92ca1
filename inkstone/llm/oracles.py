"""DuckDB SQL for the rows of registered queries."""

from __future__ import annotations

from inkstone.llm.sharding import Topology

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + 12], ' ') AS win FROM iw, unnest(range(1, greatest(len(w) - 12, 1) + 1)) u(i) WHERE len(w) > 0),
places AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM w, (SELECT DISTINCT k FROM windows) ks, unnest(range(1, len(w) - k + 2)) u(i)),
hits AS (SELECT doc_id, i, k, item_id FROM places JOIN windows USING (k, win)),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hits, unnest(range(k)) u(j) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * pairs.n >= 75 * (x.n + y.n - pairs.n)),
reach AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT doc_id, b FROM reach JOIN links ON a = to_id),
least_id AS (SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_id LEFT JOIN sizes USING (doc_id)"""


def _placed(tree: Topology, name: str) -> str:
    """CTEs that walk a tree: at each level the child with the least draw."""
    nodes = [(f"'{'/'.join(path)}'", f"'{'/'.join((*path, child))}'", weight) for path in {(), *((s.region,) for s in tree.shards), *((s.region, s.rack) for s in tree.shards)} for child, weight in tree.children(*path).items()]
    listed = ", ".join(f"({above}, {path}, {weight})" for above, path, weight in sorted(nodes))
    level = f"SELECT doc_id, arg_min(path, -ln((('0x' || substr(md5(path || '/' || doc_id), 1, 13))::BIGINT + 0.5) * pow(2, -52)) / weight) AS node FROM {{below}} JOIN {name}_nodes ON above = node GROUP BY doc_id"
    steps = [("regions", "(SELECT DISTINCT doc_id, '' AS node FROM documents)"), ("racks", f"{name}_regions"), ("leaves", f"{name}_racks")]
    return f"{name}_nodes(above, path, weight) AS (VALUES {listed}), " + ", ".join(f"{name}_{step} AS ({level.format(below=below)})" for step, below in steps)


def sharding(tree: Topology, grown: Topology) -> str:
    """CRC-32 is worked out byte by byte; its polynomial is a fixed value."""
    return f"""
WITH RECURSIVE crc(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
sums AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
{_placed(tree, "now")}, {_placed(grown, "grown")},
placed AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS text_crc32, string_split(n.node, '/')[3]::INTEGER AS shard, string_split(g.node, '/')[3]::INTEGER AS grown_shard
FROM sums JOIN now_leaves n USING (doc_id) JOIN grown_leaves g USING (doc_id), tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot/' || doc_id), 1, 13))::BIGINT % 256, doc_id) - 1 AS slot, grown_shard FROM placed"""

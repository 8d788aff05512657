"""The queries in SQL that DuckDB runs on the same tables; scans of compressed codes are those of plain ones."""

from __future__ import annotations

BASE = """
WITH e AS (
  SELECT vec_id, i, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS BIGINT) AS x
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
), s AS (SELECT vec_id, i // 8 AS m, i % 8 AS j, x FROM e
), cb AS (SELECT m, j, vec_id AS k, x AS c FROM s WHERE vec_id < 16
), d AS (
  SELECT s.vec_id, s.m, cb.k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM s JOIN cb USING (m, j) GROUP BY ALL
), codes AS (SELECT vec_id, CAST(m AS INT) AS m, CAST(arg_min(k, d * 16 + k) AS INT) AS cid FROM d GROUP BY ALL
), adc AS (SELECT vec_id AS query_id, m, k, d FROM d WHERE vec_id % 50 = 0
), sdc AS (
  SELECT a.m, a.k AS a, b.k AS b, CAST(sum((a.c - b.c) * (a.c - b.c)) AS BIGINT) AS d FROM cb a JOIN cb b USING (m, j) GROUP BY ALL
), scan AS (
  SELECT query_id, vec_id, CAST(sum(d) AS BIGINT) AS dist FROM adc JOIN codes ON adc.m = codes.m AND adc.k = codes.cid GROUP BY ALL
), everyscan AS (
  SELECT d.vec_id AS query_id, codes.vec_id, CAST(sum(d) AS BIGINT) AS dist FROM d JOIN codes ON d.m = codes.m AND d.k = codes.cid GROUP BY ALL
), exact AS (
  SELECT q.vec_id AS query_id, b.vec_id, CAST(sum((q.x - b.x) * (q.x - b.x)) AS BIGINT) AS dist
  FROM e q JOIN e b USING (i) WHERE q.vec_id % 50 = 0 GROUP BY ALL
), code AS (SELECT vec_id, list(cid ORDER BY m) AS code FROM codes GROUP BY vec_id
), masks AS (SELECT bits, bit_count(bits) AS n FROM (SELECT unnest(range(256)) AS bits)
), keyed AS (
  SELECT vec_id, 8 - n AS differ, bits, list_transform(range(8), lambda m: CASE WHEN (bits >> m::INTEGER) & 1 = 1 THEN code[m + 1] ELSE -1 END) AS key
  FROM code, masks
), grouped AS (SELECT differ, bits, key, count(*) AS size, min(vec_id) AS first FROM keyed GROUP BY ALL HAVING count(*) > 1
), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM scan) WHERE rank <= 10
), truth AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM exact) WHERE rank <= 10
), steps AS (
  SELECT a.vec_id, a.m, a.cid, lag(a.cid) OVER (PARTITION BY a.m ORDER BY a.vec_id) AS before FROM codes a
), inserts AS (
  SELECT v AS vec_id, list_transform(range(8), lambda i: ('0x' || substr(md5('0:' || v || ':' || i), 1, 7))::BIGINT % 16) AS code FROM (SELECT unnest(range(1000)) AS v)
), cost AS (SELECT vec_id, CAST(5 + 4 * len(list_filter(code, lambda c: c <> 0)) AS BIGINT) AS quarter_bytes FROM inserts
)
"""


def _top(source: str, k: int = 10, where: str = "true") -> str:
    return f"SELECT query_id, CAST(rank AS INT) AS rank, vec_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM {source} WHERE {where}) WHERE rank <= {k}"


_CELLS = "SELECT vec_id, m, cid FROM codes"
_SCAN = _top("scan")
_NEAREST = "SELECT query_id, vec_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM scan) WHERE rank = 1"
_DECODED = "SELECT codes.vec_id, CAST(codes.m * 8 + j AS INT) AS i, c AS value FROM codes JOIN cb ON codes.m = cb.m AND codes.cid = cb.k"

BODIES = {
    "exact_knn_top10": _top("exact"),
    "exact_knn_others_top10": _top("exact", 10, "query_id <> vec_id"),
    "pad_split_subvectors": "SELECT vec_id, CAST(i // 11 AS INT) AS m, 11 AS n, CAST(sum(x) AS BIGINT) AS total FROM e GROUP BY ALL",
    "first_n_vectors": "SELECT vec_id, label FROM embeddings WHERE vec_id < 100",
    "strided_sample": _DECODED + " WHERE codes.vec_id % 7 = 0",
    "hash_order_sample": "SELECT vec_id FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 50",
    "codebook_sampled": "SELECT CAST(m AS INT) AS m, CAST(k AS INT) AS k, CAST(j AS INT) AS i, c AS value FROM cb",
    "codebook_lloyd_round": """SELECT CAST(cb.m AS INT) AS m, CAST(cb.k AS INT) AS k, CAST(cb.j AS INT) AS i, coalesce(CAST(floor(avg_x) AS BIGINT), c) AS value
FROM cb LEFT JOIN (SELECT codes.m, cid, j, sum(x)::DOUBLE / count(*) AS avg_x FROM codes JOIN s ON s.vec_id = codes.vec_id AND s.m = codes.m GROUP BY ALL) a
ON a.m = cb.m AND a.cid = cb.k AND a.j = cb.j""",
    "distortion": "SELECT CAST(sum(d) AS BIGINT) AS distortion FROM (SELECT min(d) AS d FROM d GROUP BY vec_id, m)",
    "sdc_table": "SELECT CAST(m AS INT) AS m, CAST(a AS INT) AS a, CAST(b AS INT) AS b, d FROM sdc",
    "adc_table": "SELECT query_id, CAST(m AS INT) AS m, CAST(k AS INT) AS k, d FROM adc",
    "encode_codes": _CELLS,
    "decode_reconstruct": _DECODED,
    "sdc_pair_distance": """SELECT x.vec_id, CAST(sum(d) AS BIGINT) AS dist FROM codes x JOIN codes y ON y.vec_id = x.vec_id + 1 AND x.m = y.m
JOIN sdc ON sdc.m = x.m AND sdc.a = x.cid AND sdc.b = y.cid GROUP BY x.vec_id""",
    "code_differences": """SELECT x.vec_id, CAST(sum((x.cid <> y.cid)::INT) AS INT) AS n_diffs, CAST(sum((x.cid <> y.cid)::INT * (1 << x.m)) AS BIGINT) AS mask
FROM codes x JOIN codes y ON y.vec_id = x.vec_id + 1 AND x.m = y.m GROUP BY x.vec_id""",
    "zorder_codes": "SELECT vec_id, CAST(sum(((cid >> b) & 1)::BIGINT << (b * 8 + 7 - m)::INT) AS BIGINT) AS zcode FROM codes, (SELECT unnest(range(4))::INT AS b) GROUP BY vec_id",
    "zorder_decode": _CELLS,
    "combine_codes": "SELECT vec_id, m, cid FROM codes WHERE vec_id < 100 UNION ALL SELECT vec_id + 100, m, cid FROM codes WHERE vec_id < 50",
    "pq_scan_top10": _SCAN,
    "pq_leave_one_out": _top("scan", 1, "query_id <> vec_id"),
    "hamming_histogram": """SELECT CAST(differ AS INT) AS differ, count(*) AS n FROM (
  SELECT query_id, vec_id, differ, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM (
    SELECT x.vec_id AS query_id, y.vec_id, sum(d) AS dist, sum((x.cid <> y.cid)::INT) AS differ FROM codes x JOIN codes y ON x.m = y.m
    JOIN sdc ON sdc.m = x.m AND sdc.a = x.cid AND sdc.b = y.cid WHERE x.vec_id % 50 = 0 AND x.vec_id <> y.vec_id GROUP BY ALL)) WHERE rank = 1 GROUP BY differ""",
    "code_distance_range": "SELECT query_id, min(dist) AS least, max(dist) AS most FROM scan GROUP BY query_id",
    "diff_index_rows": "SELECT vec_id, CAST(sum((before IS NULL OR before <> cid)::INT * (1 << m)) AS BIGINT) AS mask, CAST(sum((before IS NULL OR before <> cid)::INT) AS INT) AS n_cids FROM steps GROUP BY vec_id",
    "diff_index_size": """SELECT n AS n_codes, diffs AS n_diffs, 8 + 16 + diffs + n - 1 AS n_bytes
FROM (SELECT count(DISTINCT vec_id) AS n, CAST(sum((before IS NOT NULL AND before <> cid)::INT) AS BIGINT) AS diffs FROM steps)""",
    "diff_index_decode": _CELLS,
    "diff_scan_top10": _SCAN,
    "diff_running_distance": "SELECT query_id, min(dist) AS least, max(dist) AS most, CAST(sum(dist) AS BIGINT) AS total, count(*) AS n FROM scan GROUP BY query_id",
    "stored_code_distance": "SELECT query_id, vec_id, dist FROM scan WHERE vec_id = query_id + 1",
    "zorder_code_distance": "SELECT query_id, vec_id, dist FROM scan WHERE vec_id = query_id + 1",
    "delta_rowstore_scan_top10": _SCAN,
    "rowstore_vectors": "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
    "bound_tree_top10": _SCAN,
    "clique_chains": """SELECT parent_id, vec_id FROM (
  SELECT vec_id, lag(vec_id) OVER (PARTITION BY bits, key ORDER BY vec_id) AS parent_id FROM (
    SELECT k.vec_id, k.bits, k.key, row_number() OVER (PARTITION BY k.vec_id ORDER BY g.size DESC, k.bits, k.key DESC) AS place
    FROM keyed k JOIN grouped g ON k.differ = g.differ AND k.bits = g.bits AND k.key = g.key WHERE k.differ = 5) WHERE place = 1) WHERE parent_id IS NOT NULL""",
    "closest_clique_pairs": """SELECT CAST(bits AS INT) AS comb, a, b, dist FROM (
  SELECT x.bits, x.key, x.vec_id AS a, y.vec_id AS b, p.dist, row_number() OVER (PARTITION BY x.bits, x.key ORDER BY p.dist, x.vec_id, y.vec_id) AS place
  FROM keyed x JOIN keyed y ON x.bits = y.bits AND x.key = y.key AND x.vec_id < y.vec_id JOIN (
    SELECT c.vec_id AS a, e.vec_id AS b, CAST(sum(sdc.d) AS BIGINT) AS dist FROM codes c JOIN codes e ON c.m = e.m AND c.vec_id < e.vec_id
    JOIN sdc ON sdc.m = c.m AND sdc.a = c.cid AND sdc.b = e.cid GROUP BY ALL) p ON p.a = x.vec_id AND p.b = y.vec_id WHERE x.differ = 5) WHERE place = 1""",
    "delta_tree_decode": _CELLS,
    "delta_tree_decode_levels": _CELLS,
    "delta_scan_top10": _SCAN,
    "delta_scan_noheight_top10": _SCAN,
    "delta_scan_recentred_top10": _SCAN,
    "delta_bitpacked_scan_top10": _SCAN,
    "delta_sharded_scan_top10": _SCAN,
    "batch_scan_top10": _top("everyscan"),
    "appended_tree_scan": _SCAN,
    "tree_stats": "SELECT count(*) AS n_codes, 1::BIGINT AS n_roots, count(*) - 1 AS n_edges, true AS depth_ok FROM embeddings",
    "tree_edge_diffs": "SELECT count(*) - 1 AS n_edges, count(*) - 1 AS n_agree FROM embeddings",
    "clique_groups": "SELECT CAST(differ AS INT) AS differ, count(*) AS groups, CAST(sum(size) AS BIGINT) AS codes, CAST(sum(first) AS BIGINT) AS firsts FROM grouped GROUP BY differ",
    "clique_size_histogram": """SELECT CAST(g.differ AS INT) AS differ, CAST(round(log10(g.size)) AS INT) AS magnitude, count(DISTINCT (g.bits, g.key)) AS groups, CAST(count(k.vec_id) + count(DISTINCT (g.bits, g.key)) AS BIGINT) AS codes,
  CAST(sum(p.dist) AS BIGINT) AS distance
FROM grouped g JOIN keyed k ON k.differ = g.differ AND k.bits = g.bits AND k.key = g.key AND k.vec_id <> g.first JOIN (
  SELECT c.vec_id AS a, e.vec_id AS b, CAST(sum(sdc.d) AS BIGINT) AS dist FROM codes c JOIN codes e ON c.m = e.m AND c.vec_id < e.vec_id
  JOIN sdc ON sdc.m = c.m AND sdc.a = c.cid AND sdc.b = e.cid GROUP BY ALL) p ON p.a = g.first AND p.b = k.vec_id GROUP BY ALL""",
    "near_code_pairs": """SELECT * FROM (SELECT x.vec_id AS a, y.vec_id AS b, CAST(sum((x.cid <> y.cid)::INT) AS INT) AS differ
FROM codes x JOIN codes y ON x.m = y.m AND x.vec_id < y.vec_id GROUP BY ALL) WHERE differ <= 3""",
    "star_forest_edges": """SELECT parent_id, vec_id, differ FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY differ, parent_id) AS k FROM (
    SELECT x.vec_id AS parent_id, y.vec_id, CAST(sum((x.cid <> y.cid)::INT) AS INT) AS differ FROM codes x JOIN codes y ON x.m = y.m AND x.vec_id < y.vec_id GROUP BY ALL)) WHERE k = 1""",
    "mst_forest_scan_top1": _NEAREST,
    "recall_at_k": """SELECT CAST(k AS INT) AS k, round(count(t.vec_id)::DOUBLE / (count(DISTINCT top.query_id) * k), 6) AS recall
FROM (SELECT unnest([1, 5, 10]) AS k) JOIN top ON top.rank <= k LEFT JOIN truth t ON t.query_id = top.query_id AND t.vec_id = top.vec_id AND t.rank <= k GROUP BY k""",
    "map_at_k": """SELECT 10 AS k, round(sum(met::DOUBLE / k) / (10 * (SELECT count(DISTINCT query_id) FROM truth)), 6) AS map FROM (
  SELECT k, top.query_id, count(*) AS met FROM (SELECT unnest(range(1, 11)) AS k) JOIN top ON top.rank <= k
  JOIN truth t ON t.query_id = top.query_id AND t.vec_id = top.vec_id AND t.rank <= k GROUP BY ALL)""",
    "ratio_stats": "SELECT round(avg(sqrt(t.dist::DOUBLE / top.dist)), 6) AS avg_ratio, round(max(sqrt(t.dist::DOUBLE / top.dist)), 6) AS max_ratio FROM top JOIN truth t USING (query_id, rank) WHERE top.dist > 0",
    "eps_recall": """SELECT round(avg(eps), 6) AS eps_recall, round(avg(near), 6) AS dist_recall, round(avg(worst), 6) AS worst_ratio FROM (
  SELECT top.query_id, avg((sqrt(x.dist) <= sqrt(l.dist) * 1.1)::INT) AS eps, avg((sqrt(x.dist) <= sqrt(l.dist))::INT) AS near, max(sqrt(x.dist) / sqrt(l.dist)) AS worst
  FROM top JOIN exact x USING (query_id, vec_id) JOIN (SELECT query_id, dist FROM truth WHERE rank = 10) l ON l.query_id = top.query_id GROUP BY top.query_id)""",
    "update_cost": "SELECT vec_id, quarter_bytes FROM cost",
    "update_growth": "SELECT vec_id, CAST(total AS BIGINT) AS total FROM (SELECT vec_id, sum(quarter_bytes) OVER (ORDER BY vec_id) AS total FROM cost) WHERE (vec_id + 1) % 10 = 0",
}
ORACLE_SQL = {name: BASE + body for name, body in BODIES.items()}
#: The nearest code under the relocated codebook: centroids are the same, so distances are, and ids of codes don't matter.
ORACLE_SQL["bound_search_top1"] = BASE + _NEAREST

"""DuckDB SQL for the catalogue's queries."""

ORD = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
MM = "SELECT DISTINCT l_orderkey AS k, l_partkey AS v FROM lineitem"
PAIRS = "SELECT DISTINCT o_orderkey AS k, o_custkey % 50 AS v FROM orders"
EV = "SELECT event_id, user_id, event_type, value, CAST(round(value * 100) AS BIGINT) AS n, epoch_us(ts) // 1000 AS ts_ms FROM events"
TTL = f"""SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 0 ELSE ts_ms + 86400000 *
  CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 5 WHEN 'purchase' THEN 20 ELSE 1 END END AS expires_at_ms FROM ({EV})"""
LIVE = "(expires_at_ms = 0 OR expires_at_ms > 1705276800000)"
VEC = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(CAST(x * (label + 1) AS FLOAT) AS DOUBLE)) AS e FROM embeddings"
PAIR = f"SELECT v.vec_id, v.e, q.e AS q FROM ({VEC}) v, (SELECT e FROM ({VEC}) WHERE vec_id = 0) q"
SUMSQ = "list_sum(list_transform({0}, lambda x: x * x))"


def zipped(f: str, a: str = "e", b: str = "q") -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: {f.format(x='p[1]', y='p[2]')}))"


L2, L1, DOT = zipped("({x} - {y}) * ({x} - {y})"), zipped("abs({x} - {y})"), zipped("{x} * {y}")
NORM = f"sqrt({SUMSQ.format('e')})"
COS = f"1 - greatest(-1.0, least(1.0, {DOT} / ({NORM} * sqrt({SUMSQ.format('q')}))))"


def knn(d: str, where: str = "") -> str:
    return f"SELECT vec_id, round(distance, 5) AS distance FROM (SELECT vec_id, {d} AS distance FROM ({PAIR}) {where} ORDER BY 2, vec_id LIMIT 10)"


def knn_many(d: str, where: str = "") -> str:
    return f"""SELECT query_id, vec_id, round(distance, 4) AS distance, CAST(rank AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
          SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {d} AS distance FROM ({VEC}) a, ({VEC}) b {where})) WHERE rank <= 10"""


L2_MANY = zipped("({x} - {y}) * ({x} - {y})", "a.e", "b.e")
BITS = "list_transform(range(0, 16), lambda i: format('{:X}', (e[4*i+1] > 0)::INT * 8 + (e[4*i+2] > 0)::INT * 4 + (e[4*i+3] > 0)::INT * 2 + (e[4*i+4] > 0)::INT))"
SQ = f"SELECT vec_id, e, list_min(e) AS lo, list_max(e) AS hi, list_transform(e, lambda x: CAST(floor((x - list_min(e)) * 255 / (list_max(e) - list_min(e)) + 0.5) AS BIGINT)) AS codes FROM ({VEC})"
DQ = f"SELECT s.vec_id, list_transform(s.codes, lambda c: s.lo + c * (s.hi - s.lo) / 255) AS e, q.e AS q FROM ({SQ}) s, (SELECT e FROM ({VEC}) WHERE vec_id = 0) q"

BLOBS = """SELECT d.doc_id AS seq, d.text, octet_length(encode(d.text)) AS length, sha256(d.text) AS sha256, d.lang, d.source, l.quality, d.doc_id * 3600000000000 AS wall_ns,
  CASE WHEN octet_length(encode(d.text)) >= 1000 THEN min(d.doc_id) OVER (PARTITION BY d.text) ELSE d.doc_id END AS owner
  FROM documents d LEFT JOIN labels l USING (doc_id)"""
TAGS = f"SELECT seq, source AS tag FROM ({BLOBS}) UNION SELECT seq, 'q' || quality FROM ({BLOBS}) WHERE quality IS NOT NULL"
NODES = """SELECT conv_id * 1000 + turn AS node, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 0 THEN conv_id * 1000 ELSE conv_id * 1000 + turn - 1 END AS parent FROM conversations"""

WRITES = f"SELECT event_type AS tab, user_id AS key, ts_ms // 3600000 AS txn, event_id AS seq, n AS value, event_id % 10 = 0 AS deleted FROM ({EV})"
LOG = f"""SELECT tab, key, txn, seq, op, old_value, new_value FROM (
  SELECT *, CASE WHEN deleted THEN CASE WHEN there THEN 'delete' END WHEN there THEN 'update' ELSE 'insert' END AS op,
    CASE WHEN there THEN before END AS old_value, CASE WHEN NOT deleted THEN value END AS new_value
  FROM (SELECT *, lag(value) OVER w AS before, coalesce(NOT lag(deleted) OVER w, false) AS there FROM ({WRITES}) WINDOW w AS (PARTITION BY tab, key ORDER BY txn, seq))
) WHERE op IS NOT NULL"""
MID = 1705276800000 // 3600000
HIST = "SELECT o_custkey AS k, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS version, max(o_orderkey) AS v FROM orders GROUP BY 1, 2"
AT = 1996 * 12 + 6


def state(v: int) -> str:
    return f"SELECT k, arg_max(v, version) AS v, max(version) AS version FROM ({HIST}) WHERE version <= {v} GROUP BY k"


A, B = f"SELECT k, v FROM ({state(AT)}) WHERE k % 11 <> 3", f"SELECT k, v FROM ({state(AT + 6)}) WHERE k % 11 <> 5"
UPS = f"SELECT b.k, b.v FROM ({B}) b LEFT JOIN ({A}) a USING (k) WHERE a.k IS NULL OR a.v IS DISTINCT FROM b.v"
DEL = f"SELECT k FROM ({A}) WHERE k NOT IN (SELECT k FROM ({B}))"

DOCB = "SELECT doc_id AS seq, doc_id * 3600000000000 AS wall_ns, lang, source FROM documents"
NEAR50 = f"SELECT vec_id AS seq, round(distance, 6) AS distance FROM (SELECT vec_id, {COS} AS distance FROM ({PAIR}) ORDER BY 2, vec_id LIMIT 50)"
DAY = 86400000000000
DOCN = "SELECT doc_id AS node, CASE WHEN doc_id % 4 <> 0 THEN doc_id - doc_id % 4 WHEN doc_id > 0 THEN doc_id // 8 * 4 END AS parent FROM documents"


def bfs(nodes: str, root: int, most: int, edges: str | None = None) -> str:
    return f"""SELECT node, min(hops) AS hops FROM (
      WITH RECURSIVE nb AS (SELECT node AS a, parent AS b FROM ({nodes}) WHERE parent IS NOT NULL UNION SELECT parent, node FROM ({nodes}) WHERE parent IS NOT NULL),
      walk AS (SELECT CAST({root} AS BIGINT) AS node, 0 AS hops UNION SELECT nb.b, walk.hops + 1 FROM walk JOIN nb ON nb.a = walk.node WHERE walk.hops < {most})
      SELECT node, hops FROM walk) GROUP BY node"""


REACH = f"SELECT node AS seq, hops FROM ({bfs(DOCN, 8, 3)})"


def composite(near: str | None, span: bool, reach: str | None, w: tuple[float, float, float], k: int, where: str = "true") -> str:
    parts = []
    if near:
        parts.append(f"SELECT seq, distance, CAST(NULL AS INT) AS hops FROM ({near})")
    if span:
        parts.append(f"SELECT seq, CAST(NULL AS DOUBLE) AS distance, CAST(NULL AS INT) AS hops FROM ({DOCB}) WHERE wall_ns BETWEEN {DAY} AND {4 * DAY}")
    if reach:
        parts.append(f"SELECT seq, CAST(NULL AS DOUBLE) AS distance, hops FROM ({reach})")
    total = sum(w)
    top = f"(SELECT max(hops) FROM ({reach}))" if reach else "0"
    cell = lambda on, s: s if on else "CAST(NULL AS DOUBLE)"
    sem = "CASE WHEN distance IS NULL THEN 0.0 WHEN max(distance) OVER () - min(distance) OVER () <= 1.1920929e-07 THEN 1.0 ELSE 1 - (distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER ()) END"
    tem = "CASE WHEN max(wall_ns) OVER () = min(wall_ns) OVER () THEN 1.0 ELSE CAST(wall_ns - min(wall_ns) OVER () AS DOUBLE) / CAST(max(wall_ns) OVER () - min(wall_ns) OVER () AS DOUBLE) END"
    cau = f"CASE WHEN hops IS NULL THEN 0.0 WHEN {top} = 0 THEN 1.0 ELSE 1 - CAST(hops AS DOUBLE) / {top} END"
    return f"""WITH cand AS (SELECT seq, min(distance) AS distance, min(hops) AS hops FROM ({' UNION ALL '.join(parts)}) GROUP BY seq),
      found AS (SELECT c.*, b.wall_ns FROM cand c JOIN ({DOCB}) b USING (seq) WHERE {where}),
      s AS (SELECT seq, {cell(w[0], sem)} AS semantic, {cell(w[1], tem)} AS temporal, {cell(w[2], cau)} AS causal FROM found),
      t AS (SELECT *, coalesce(semantic, 0) * {w[0] / total!r} + coalesce(temporal, 0) * {w[1] / total!r} + coalesce(causal, 0) * {w[2] / total!r} AS score FROM s)
      SELECT seq, round(score, 5) AS score, round(semantic, 5) AS semantic, round(temporal, 5) AS temporal, round(causal, 5) AS causal FROM t ORDER BY t.score DESC, seq LIMIT {k}"""


FOLD = f"""WITH RECURSIVE e AS (SELECT user_id, n % 1000 AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM ({EV})),
  f AS (SELECT user_id, i, greatest(1, x) AS v FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, greatest(f.v + 1, e.x) FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
  SELECT user_id, CAST(arg_max(v, i) AS BIGINT) AS v FROM f GROUP BY user_id HAVING arg_max(v, i) >= 900"""
ENGINE = "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 100 END AS m FROM customer"
H, OTHER, NOW = "(ts_ms << 16 | event_id % 65536)", "((ts_ms - 5 + event_id % 11) << 16 | 65535)", "(ts_ms + event_id % 3 - 1)"


def step(h: str) -> str:
    return f"CASE WHEN {NOW} > ({h} >> 16) THEN {NOW} << 16 WHEN ({h} & 65535) >= 65535 THEN (({h} >> 16) + 1) << 16 ELSE {h} + 1 END"


SQL: dict[str, str] = {
    "kv_get": f"{ORD} WHERE o_orderkey = 7",
    "kv_range": f"{ORD} WHERE o_orderkey >= 100 AND o_orderkey < 900",
    "kv_range_reverse": f"{ORD} WHERE o_orderkey > 100 AND o_orderkey <= 900",
    "kv_range_unbounded": f"{ORD} WHERE o_orderkey >= 500",
    "kv_iter": "SELECT c_custkey, c_name FROM customer",
    "kv_first": f"{ORD} ORDER BY o_orderkey LIMIT 1",
    "kv_last_composite": "SELECT conv_id, turn, role FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 1",
    "kv_len": "SELECT count(*) AS len FROM orders",
    "kv_upsert": "SELECT c_custkey, coalesce(p, c_acctbal) AS c_acctbal FROM customer FULL JOIN (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) USING (c_custkey)",
    "kv_insert_returns": "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "kv_remove": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0)",
    "kv_pop_first": "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'popped' ELSE 'rest' END AS part FROM orders",
    "kv_pop_last": "SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'popped' ELSE 'rest' END AS part FROM orders",
    "kv_extract_if": f"SELECT *, CASE WHEN o_totalprice > 200000 THEN 'out' ELSE 'rest' END AS part FROM ({ORD})",
    "kv_extract_from_if": f"{ORD} WHERE o_orderstatus = 'F' AND o_orderkey >= 100 AND o_orderkey < 5000",
    "kv_retain": f"{ORD} WHERE o_orderstatus = 'O'",
    "kv_retain_in": f"{ORD} WHERE o_orderstatus = 'O' OR NOT (o_orderkey >= 100 AND o_orderkey < 1000)",
    "kv_drain": "SELECT count(*) AS drained FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1000",
    "kv_drain_rest": f"{ORD} WHERE NOT (o_orderkey >= 100 AND o_orderkey < 1000)",
    "kv_raw": "SELECT CAST(n_nationkey AS VARCHAR) AS key, hex(encode(n_name)) || '00' || hex(encode(CAST(n_regionkey AS VARCHAR))) AS value FROM nation",
    "mm_get": f"SELECT * FROM ({MM}) WHERE k = 7",
    "mm_range": f"SELECT * FROM ({MM}) WHERE k >= 10 AND k < 500",
    "mm_grouped_whole": f"SELECT k, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS vals FROM ({MM}) GROUP BY k",
    "mm_grouped": f"SELECT k, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS vals FROM ({MM}) WHERE k >= 10 AND k < 500 GROUP BY k",
    "mm_len": f"SELECT count(*) AS len FROM ({MM})",
    "mm_value_count": f"SELECT k, count(*) AS n_values FROM ({MM}) GROUP BY k",
    "mm_insert": f"{MM} UNION {PAIRS}",
    "mm_insert_returns": f"SELECT p.k, p.v, m.k IS NOT NULL AS existed FROM ({PAIRS}) p LEFT JOIN ({MM}) m ON p.k = m.k AND p.v = m.v",
    "mm_remove": f"{MM} EXCEPT {PAIRS}",
    "mm_remove_all": f"SELECT * FROM ({MM}) WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "mm_drain": f"SELECT count(*) AS drained FROM ({MM}) WHERE k >= 10 AND k < 500",
    "merge_numeric_add": f"SELECT user_id, CAST(sum(n) % 256 AS BIGINT) AS w1, CAST(sum(n) % 65536 AS BIGINT) AS w2, CAST(sum(CAST(n AS HUGEINT) * 100000) % 4294967296 AS BIGINT) AS w4, CAST(sum(n) AS BIGINT) AS w8 FROM ({EV}) GROUP BY user_id",
    "merge_saturating_add": f"SELECT event_type, CAST(least(sum(n % 7), 255) AS BIGINT) AS w1, CAST(least(sum(n % 100), 65535) AS BIGINT) AS w2, CAST(least(sum(n), 4294967295) AS BIGINT) AS w4 FROM ({EV}) GROUP BY event_type",
    "merge_max_min": f"SELECT user_id, max(n % 65536) AS high, min(n % 65536) AS low FROM ({EV}) GROUP BY user_id",
    "merge_bitwise_or": f"SELECT user_id, bit_or(n) AS bits FROM ({EV}) GROUP BY user_id",
    "merge_float_add": f"SELECT user_id, round(sum(value), 4) AS total FROM ({EV}) GROUP BY user_id",
    "merge_bytes_append_whole": f"SELECT user_id, string_agg(event_type || '|', '' ORDER BY event_id) AS log FROM ({EV}) GROUP BY user_id",
    "merge_bytes_append": f"SELECT user_id, string_agg(substr(event_type, 1, 1) || '|', '' ORDER BY event_id) AS log FROM ({EV}) GROUP BY user_id",
    "merge_fn": FOLD,
    "merge_fn_python": FOLD,
    "ttl_live": f"SELECT * FROM ({TTL}) WHERE {LIVE}",
    "ttl_get": f"SELECT * FROM ({TTL}) WHERE event_id = 0 AND {LIVE}",
    "ttl_range": f"SELECT * FROM ({TTL}) WHERE event_id >= 50 AND event_id < 800 AND {LIVE}",
    "ttl_len_with_expired": f"SELECT count(*) AS len_with_expired FROM ({TTL})",
    "ttl_purge": f"SELECT count(*) FILTER (WHERE NOT {LIVE}) AS purged FROM ({TTL})",
    "ttl_remove_returns": f"SELECT * FROM ({TTL}) WHERE event_id IN (SELECT o_orderkey * 3 FROM orders)",
    "vector_distances": f"SELECT vec_id, round({L2}, 5) AS euclidean_sq, round({COS}, 5) AS cosine, round(-{DOT}, 5) AS dot, round({L1}, 5) AS manhattan, round({NORM}, 5) AS norm, round(e[1] / {NORM}, 6) AS unit_1 FROM ({PAIR})",
    "vector_quantize_binary": f"SELECT vec_id, array_to_string({BITS}, '') AS bits FROM ({VEC})",
    "vector_hamming": f"SELECT vec_id, CAST({zipped('(({x} > 0) <> ({y} > 0))::INT')} AS BIGINT) AS hamming FROM ({PAIR})",
    "vector_quantize_scalar": f"SELECT vec_id, round(lo, 6) AS lo, round(hi, 6) AS hi, array_to_string(codes, ',') AS codes FROM ({SQ})",
    "vector_sq_distances": f"SELECT vec_id, round({L2}, 4) AS l2, round({DOT}, 4) AS dot, round(e[1], 5) AS first FROM ({DQ})",
    "vector_f32_codec": f"SELECT vec_id, CAST(4 * len(e) AS BIGINT) AS n_bytes, true AS same FROM ({VEC})",
    "knn_cosine": knn(COS),
    "knn_euclidean": knn(L2),
    "knn_dot": knn(f"-{DOT}"),
    "knn_manhattan": knn(L1),
    "knn_many": f"""SELECT query_id, id, round(distance, 4) AS distance, CAST(rank AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
          SELECT a.vec_id AS query_id, b.vec_id AS id, {zipped('({x} - {y}) * ({x} - {y})', 'a.e', 'b.e')} AS distance
          FROM ({VEC}) a, ({VEC}) b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE rank <= 5""",
    "metadata_predicates": """SELECT e.vec_id, l.doc_id IS NULL OR quality = 1 AS p_eq, l.doc_id IS NULL OR quality <> 1 AS p_ne, l.doc_id IS NULL OR quality < 1 AS p_lt, l.doc_id IS NULL OR quality >= 0.5 AS p_ge,
        l.doc_id IS NULL OR (quality = 1 AND toxic = 0) AS p_both, l.doc_id IS NULL OR quality = 0 OR toxic = 1 AS p_either FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id""",
    "ann_exact": knn(L2),
    "ann_filtered": knn(L2, "LEFT JOIN labels l ON l.doc_id = vec_id WHERE l.doc_id IS NULL OR quality = 1"),
    "ann_exact_many": knn_many(L2_MANY, "WHERE a.vec_id % 20 = 0"),
    "ann_filtered_many": knn_many(L2_MANY, "LEFT JOIN labels l ON l.doc_id = b.vec_id WHERE a.vec_id % 20 = 0 AND (l.doc_id IS NULL OR quality = 1)"),
    "ann_upsert_remove": "SELECT * FROM (SELECT vec_id, 16 AS code_bytes FROM embeddings UNION SELECT vec_id + CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 100000 END, 16 FROM embeddings WHERE vec_id % 7 = 0) WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0)",
    "blob_read": f"SELECT seq, sha256, CAST(length AS BIGINT) AS n_bytes, true AS intact FROM ({BLOBS})",
    "blob_meta": f"""SELECT seq, left(text, list_max(list_filter(range(0, 64), lambda k: octet_length(encode(left(text, k))) <= 63))) AS label, CAST(length AS BIGINT) AS length, sha256, owner FROM ({BLOBS})""",
    "blob_content_types": "SELECT doc_id, coalesce(['application/octet-stream', 'image/png', 'image/jpeg', 'audio/wav', 'audio/ogg', 'video/mp4', 'application/vnd.las', 'application/x-imu', 'application/x-embedding', 'application/json'][CAST(doc_id % 12 + 1 AS INT)], 'application/octet-stream') AS content_type FROM documents",
    "blob_append": "SELECT doc_id AS seq, sha256(text) AS sha256, true AS intact, CASE WHEN octet_length(encode(text)) >= 1000 THEN coalesce(min(doc_id) FILTER (WHERE doc_id % 2 = 1) OVER w, min(doc_id) OVER w) ELSE doc_id END AS owner FROM documents WINDOW w AS (PARTITION BY text)",
    "blob_namespace_of": "SELECT lang AS namespace FROM documents WHERE doc_id = 2",
    "vector_nan_bits": f"SELECT vec_id, array_to_string({BITS}, '') AS bits FROM (SELECT vec_id, list_transform(e, lambda x, i: CASE WHEN (i - 1) % 3 = 0 THEN 0.0 ELSE x END) AS e FROM ({VEC}))",
    "knn_custom": knn("list_max(list_transform(list_zip(e, q), lambda p: abs(p[1] - p[2])))"),
    "metadata_types": "SELECT doc_id, quality = 1 AS int_int, false AS int_float, false AS float_int, quality = 1 AS float_float, false AS text_int, true AS ne_float, quality >= 0.5 AS ge_float FROM labels",
    "ann_recall_gate": "SELECT m AS metric, count(*) AS queries, true AS enough FROM embeddings, (VALUES ('euclidean_sq'), ('cosine')) v(m) WHERE vec_id % 20 = 0 GROUP BY m",
    "merge_bitwise_or_bytes": f"SELECT user_id, printf('%04X', bit_or(n % 65536)) AS bits FROM ({EV}) GROUP BY user_id",
    "store_savepoint_kept": f"SELECT *, '1,3' AS versions FROM ({ORD}) WHERE o_orderkey % 4 < 1",
    "cdc_mutations": f"""SELECT 1 AS txn, 'customer' AS tab, 'insert' AS op, c_custkey AS k, CAST(NULL AS BIGINT) AS old, c_nationkey AS new FROM customer
        UNION ALL SELECT 2, 'customer', 'delete', c_custkey, c_nationkey, NULL FROM customer WHERE c_custkey % 5 = 0
        UNION ALL SELECT 3, 'customer', 'delete', c_custkey, c_nationkey, NULL FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 = 0
        UNION ALL SELECT 4, 'customer', 'delete', c_custkey, c_nationkey, NULL FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey >= 10 AND c_custkey < 50
        UNION ALL SELECT 1, 'of_nation', 'insert', c_nationkey, NULL, c_custkey FROM customer WHERE c_custkey % 2 = 0
        UNION ALL SELECT 2, 'of_nation', 'insert', c_nationkey, NULL, c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0
        UNION ALL SELECT 3, 'of_nation', 'delete', c_nationkey, c_custkey, NULL FROM customer WHERE c_custkey % 4 = 0
        UNION ALL SELECT 4, 'of_nation', 'delete', c_nationkey, c_custkey, NULL FROM customer WHERE (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AND c_custkey % 4 <> 0 AND c_nationkey >= 3 AND c_nationkey < 6""",
    "blob_range_read": "SELECT doc_id AS seq, substr(hex(encode(text)), 2001, 2400) AS data FROM documents WHERE doc_id = 3",
    "blob_by_sequence": f"SELECT seq, length FROM ({BLOBS}) WHERE seq IN (SELECT vec_id FROM embeddings)",
    "blob_stats": f"SELECT count(*) AS blob_count, CAST(sum(length) FILTER (WHERE seq = owner) AS BIGINT) AS live_bytes, 0 AS dead_bytes, CAST(0 AS DOUBLE) AS fragmentation FROM ({BLOBS})",
    "blob_dedup_stats": f"SELECT count(*) AS entries, CAST(sum(refs) AS BIGINT) AS refs, CAST(sum(length * (refs - 1)) AS BIGINT) AS bytes_saved FROM (SELECT sha256, count(*) AS refs, max(length) AS length FROM ({BLOBS}) WHERE length >= 1000 GROUP BY sha256)",
    "blob_namespace": f"SELECT seq, length FROM ({BLOBS}) WHERE lang = 'de'",
    "blob_tags_all": f"SELECT seq, length FROM ({BLOBS}) WHERE source = 'src0' AND quality = 1",
    "blob_tags_of": f"SELECT tag FROM ({TAGS}) WHERE seq = 2",
    "blob_time_range": f"SELECT seq, wall_ns FROM ({BLOBS}) WHERE wall_ns BETWEEN {DAY} AND {5 * DAY}",
    "blob_time_range_namespace": f"SELECT seq, wall_ns FROM ({BLOBS}) WHERE wall_ns BETWEEN {DAY} AND {20 * DAY} AND lang = 'fr'",
    "blob_near": f"SELECT seq, wall_ns FROM ({BLOBS}) WHERE abs(wall_ns - 50 * 3600000000000) <= {DAY} // 2",
    "blob_delete": f"SELECT count(*) AS blobs, count(*) AS intact, (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0 AND (doc_id + 4) % 5 <> 0) AS edges, (SELECT count(*) FROM ({TAGS}) WHERE seq % 5 <> 0) AS tags FROM documents WHERE doc_id % 5 <> 0",
    "graph_children": f"SELECT node AS child, CASE node % 7 WHEN 1 THEN 'similar' WHEN 2 THEN 'contradicts' WHEN 3 THEN 'supports' WHEN 4 THEN 'supersedes' ELSE 'derived' END AS relation FROM ({NODES}) WHERE parent = 5000",
    "graph_chain": f"WITH RECURSIVE w AS (SELECT 0 AS hop, node, parent FROM ({NODES}) WHERE node = 5005 UNION ALL SELECT hop + 1, n.node, n.parent FROM w JOIN ({NODES}) n ON n.node = w.parent WHERE hop < 10) SELECT hop, node FROM w",
    "graph_path": f"WITH RECURSIVE w AS (SELECT 0 AS hop, node, parent FROM ({NODES}) WHERE node = 5005 UNION ALL SELECT hop + 1, n.node, n.parent FROM w JOIN ({NODES}) n ON n.node = w.parent WHERE hop < 10) SELECT hop, node FROM w WHERE hop <= (SELECT min(hop) FROM w WHERE node = 5000)",
    "graph_bfs": bfs(NODES, 5002, 2),
    "cdc_capture": LOG,
    "cdc_since": f"SELECT * FROM ({LOG}) WHERE txn > {MID}",
    "cdc_range": f"SELECT * FROM ({LOG}) WHERE txn BETWEEN {MID - 24} AND {MID}",
    "cdc_latest": f"SELECT max(txn) AS latest_txn FROM ({LOG})",
    "cdc_retention": f"SELECT * FROM ({LOG}) WHERE txn > {MID - 100}",
    "history_state": f"SELECT k, version, v FROM ({state(AT)})",
    "history_as_of": f"SELECT max(version) AS version FROM ({HIST}) WHERE version * 1000 <= {AT * 1000 + 500}",
    "diff_upserts": UPS,
    "diff_deletes": DEL,
    "diff_counts": f"SELECT (SELECT count(*) FROM ({UPS})) AS upserts, (SELECT count(*) FROM ({DEL})) AS deletes",
    "diff_apply": B,
    "diff_export_import": B,
    "store_engine_table": f"SELECT c_custkey, coalesce(m, c_nationkey) AS c_nationkey FROM ({ENGINE}) WHERE (m IS NOT NULL OR c_custkey % 3 <> 0) AND c_custkey % 7 <> 0",
    "cdc_engine_log": f"""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'insert' ELSE 'update' END AS op, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS old, m AS new FROM ({ENGINE}) WHERE m IS NOT NULL
        UNION ALL SELECT c_custkey, 'delete', coalesce(m, c_nationkey), NULL FROM ({ENGINE}) WHERE (m IS NOT NULL OR c_custkey % 3 <> 0) AND c_custkey % 7 = 0""",
    "cdc_engine_retention": f"SELECT 2 AS txn, (SELECT count(*) FROM ({ENGINE}) WHERE m IS NOT NULL) + (SELECT count(*) FROM ({ENGINE}) WHERE (m IS NOT NULL OR c_custkey % 3 <> 0) AND c_custkey % 7 = 0) AS n",
    "kv_salvage": "SELECT * FROM nation",
    "list_table_stats": " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, 1 AS files FROM {t}" for t in ("region", "nation", "customer", "orders")),
    "stream_windows": "SELECT epoch_us(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) // 1000000 AS start_s, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "graph_edge_context": "SELECT conv_id * 1000 + turn - 1 AS parent, conv_id * 1000 + turn AS child, substr('turn by ' || role || ' ' || repeat('x', 60), 1, 62) AS context FROM conversations WHERE turn > 0",
    "store_time_travel": f"{ORD} WHERE o_orderkey % 4 < 2",
    "store_savepoint": f"{ORD} WHERE o_orderkey % 2 = 0",
    "store_backup": "SELECT 'nation' AS \"table\", count(*) AS rows, count(*) AS copied_rows, true AS same FROM nation UNION ALL SELECT 'region', count(*), count(*), true FROM region",
    "stream_changefeed": f"SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM ({WRITES}) WHERE NOT deleted GROUP BY key",
    "hlc_clock": f"SELECT event_id, {H} AS h, {H} >> 16 AS p, {H} & 65535 AS l, {step(H)} AS ticked, {step(f'greatest({H}, {OTHER})')} AS merged, ts_ms << 16 AS wall FROM ({EV})",
    "composite_semantic": composite(NEAR50, False, None, (1.0, 0.0, 0.0), 10),
    "composite_temporal": composite(None, True, None, (0.0, 2.0, 0.0), 10),
    "composite_causal": composite(None, False, REACH, (0.0, 0.0, 1.0), 15),
    "composite_fused": composite(NEAR50, True, REACH, (0.6, 0.3, 0.1), 10, "b.lang = 'en' AND b.source <> 'src1'"),
    "list_tables": "SELECT unnest(['nation', 'new']) AS name",
}

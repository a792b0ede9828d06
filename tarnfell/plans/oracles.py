"""DuckDB SQL for the registered queries, over the same derived fixture."""

from __future__ import annotations

from .fixture import DUCK


def _slash24(c: str) -> str:
    return f"split_part({c}, '.', 1) || '.' || split_part({c}, '.', 2) || '.' || split_part({c}, '.', 3) || '.0'"


def _km(a: str, b: str) -> str:
    h = f"(pow(sin(radians({b}.lat - {a}.lat) / 2e0), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2e0), 2))"
    return f"2e0 * 6371e0 * atan2(sqrt({h}), sqrt(1e0 - {h}))"


LAYERS = f"""{DUCK},
loc AS (SELECT {_slash24("address_v4")} AS addr, arg_max(latitude, prb_id) AS lat, arg_max(longitude, prb_id) AS lon
  FROM probes WHERE address_v4 IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL GROUP BY 1),
usable AS (SELECT * FROM pings WHERE rtt <> -1 AND NOT contains(dst_addr, ':')),
sub AS (SELECT {_slash24("p.address_v4")} AS src, {_slash24("u.dst_addr")} AS dst, u.rtt, u.hr
  FROM usable u JOIN probes p ON p.prb_id = u.prb_id WHERE p.address_v4 IS NOT NULL),
dist AS (SELECT s.*, {_km("a", "b")} AS dist_km FROM sub s JOIN loc a ON a.addr = s.src JOIN loc b ON b.addr = s.dst),
sol AS (SELECT * FROM dist WHERE rtt >= dist_km / 1e2),
edges AS MATERIALIZED (SELECT src, dst, min(rtt) AS rtt FROM sol GROUP BY 1, 2),
nodes0 AS (SELECT src AS addr FROM edges UNION SELECT dst FROM edges)"""

_LIST = "string_agg(cast(cast(rtt AS decimal(12,3)) AS varchar), ',' ORDER BY rtt)"
_DAYS = "(SELECT cast(x AS date) AS day FROM generate_series(timestamp '2026-02-23', timestamp '2026-02-26', interval 1 day) t(x))"
_PING_FILE = "'ping-' || strftime(day, '%Y-%m-%d') || 'T' || lpad(cast(h AS varchar), 2, '0') || '00"
_BUDGETS = "budgets AS (SELECT cast(b AS int) AS budget FROM range(100, 2501, 100) t(b))"


def _picks(limit: int) -> str:
    return f"""rnd AS (SELECT 'random' AS strategy, seq, src, dst, rtt FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || src || '|' || dst), src, dst) AS seq FROM edges) WHERE seq <= {limit}),
gr0 AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS rn FROM edges),
grd AS (SELECT 'iterative_greedy' AS strategy, seq, src, dst, rtt FROM (SELECT *, row_number() OVER (ORDER BY rn > 1, dst, rn) AS seq FROM gr0) WHERE seq <= {limit}),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY rtt, src) AS rank FROM edges) WHERE rank <= 50),
itl AS (SELECT 'rtt_rank' AS strategy, seq, src, dst, rtt FROM (SELECT *, row_number() OVER (ORDER BY rank, dst) AS seq FROM cand) WHERE seq <= {limit}),
picks AS (SELECT * FROM rnd UNION ALL SELECT * FROM grd UNION ALL SELECT * FROM itl)"""


def _prune(name: str, ratio: str, rounds: int = 4) -> str:
    """CTEs name_0 ... name_rounds: that many rounds of simultaneous removal (more change nothing here)."""
    parts = [f"{name}_0 AS (SELECT addr FROM nodes0)"]
    for r in range(rounds):
        p = f"{name}_{r}"
        parts.append(
            f"""{name}_{r + 1} AS (SELECT p.addr FROM {p} p CROSS JOIN (SELECT count(*) AS n FROM {p}) c
  LEFT JOIN (SELECT src AS addr, count(*) AS k FROM edges WHERE src <> dst AND src IN (SELECT addr FROM {p}) AND dst IN (SELECT addr FROM {p}) GROUP BY 1) o ON o.addr = p.addr
  LEFT JOIN (SELECT dst AS addr, count(*) AS k FROM edges WHERE src <> dst AND src IN (SELECT addr FROM {p}) AND dst IN (SELECT addr FROM {p}) GROUP BY 1) i ON i.addr = p.addr
  WHERE c.n <= 1 OR (coalesce(o.k, 0) >= {ratio} * (c.n - 1) AND coalesce(i.k, 0) >= {ratio} * (c.n - 1)))"""
        )
    return ",\n".join(parts)


_MESH = f"{LAYERS},\n{_prune('m', '0.6e0')}, mesh AS (SELECT addr FROM m_4), med AS (SELECT * FROM edges WHERE src IN (SELECT addr FROM mesh) AND dst IN (SELECT addr FROM mesh))"
_SEEDS = f"""{LAYERS}, vp AS (SELECT e.src, e.dst, e.rtt, l.lat, l.lon FROM edges e JOIN loc l ON l.addr = e.src),
seed AS (SELECT dst, count(*) AS n_vps, avg(lat) AS lat, avg(lon) AS lon FROM vp GROUP BY 1),
d AS (SELECT v.dst, v.rtt * 1e2 AS r, {_km("s", "v")} AS d FROM vp v JOIN seed s ON s.dst = v.dst)"""
_DOCS = """snap AS (SELECT '2026-02-22' AS day, prb_id, address_v4, latitude, longitude FROM probes
  UNION ALL SELECT '2026-02-23', prb_id, address_v4, latitude + 0.5e0, longitude FROM probes WHERE prb_id % 3 <> 0
  UNION ALL SELECT '2026-02-24', CASE WHEN prb_id % 10 = 0 THEN NULL ELSE prb_id END, address_v4, NULL, longitude FROM probes WHERE prb_id % 5 = 0),
recs AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY coalesce(prb_id, -1), address_v4 NULLS FIRST, longitude NULLS FIRST) - 1 AS pos FROM snap)"""
_LINE = """lines AS (SELECT prb_id, dst_addr, rtt, CASE WHEN prb_id % 19 = 3 AND hr = 5 THEN 'bad' WHEN prb_id % 19 = 4 AND hr = 6 THEN 'missing'
  WHEN prb_id % 19 = 5 AND hr = 7 THEN 'nullrtt' WHEN prb_id % 19 = 6 AND hr = 8 THEN 'nullsrc' WHEN prb_id % 19 = 7 AND hr = 9 THEN 'bad' ELSE 'ok' END AS kind FROM pings)"""


def _adaptive(tries: int = 4, minimum: int = 50) -> str:
    ratio, parts, ratios = 0.8, [], []
    for i in range(tries):
        ratios.append(ratio)
        parts.append(_prune(f"t{i}", f"{ratio!r}::DOUBLE"))
        ratio *= 0.9
    pick = "\nUNION ALL ".join(
        f"SELECT addr, round({r!r}::DOUBLE, 6) AS ratio, {i} AS relaxations FROM t{i}_4 WHERE (SELECT count(*) FROM t{i}_4) >= {minimum}" + "".join(f" AND (SELECT count(*) FROM t{j}_4) < {minimum}" for j in range(i)) for i, r in enumerate(ratios)
    )
    return f"{LAYERS},\n" + ",\n".join(parts) + f"\n{pick}"


def all_sql() -> dict[str, str]:
    picks = f"{LAYERS},\n{_picks(2500)},\n{_BUDGETS}"
    few = f"{LAYERS},\n{_picks(200)}"
    return {
        "date_targets": f"SELECT cast(day AS varchar) AS day FROM {_DAYS}",
        "hourly_targets": f"SELECT cast(day AS varchar) AS day, cast(h AS int) AS hour FROM {_DAYS}, range(24) r(h)",
        "probe_urls": f"SELECT 'https://archive.invalid/probes/' || strftime(day, '%Y/%m/%Y%m%d') || '.json.bz2' AS url FROM {_DAYS}",
        "ping_urls": f"SELECT 'https://archive.invalid/pings/' || strftime(day, '%Y-%m-%d') || '/' || {_PING_FILE}.bz2' AS url FROM {_DAYS}, range(24) r(h)",
        "parsed_names": f"SELECT strftime(day, '%Y%m%d') || '_parsed.json' AS name FROM {_DAYS} UNION ALL SELECT {_PING_FILE}_summary.json' FROM {_DAYS}, range(24) r(h)",
        "pending_hours": f"{DUCK} SELECT DISTINCT hr FROM pings WHERE hr % 3 <> 0",
        "probe_parse": f"{DUCK}, {_DOCS} SELECT day AS snapshot_date, pos, prb_id, address_v4, 'XX' AS country, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, cast(NULL AS bigint) AS asn_v4, 'Connected' AS status FROM recs",
        "latest_probes": f"""{DUCK}, {_DOCS} SELECT prb_id, r.a AS address_v4, round(r.la, 6) AS latitude, round(r.lo, 6) AS longitude, snapshot_date, first_seen FROM (
          SELECT prb_id, arg_max(struct_pack(a := address_v4, la := latitude, lo := longitude), day) AS r, max(day) AS snapshot_date, min(day) AS first_seen FROM recs WHERE prb_id IS NOT NULL GROUP BY 1)""",
        "probe_count": f"{DUCK}, {_DOCS} SELECT count(DISTINCT prb_id) AS n_probes FROM recs",
        "ping_scan": f"""{DUCK}, {_LINE} SELECT prb_id, CASE kind WHEN 'missing' THEN '' WHEN 'nullsrc' THEN NULL ELSE '10.9.9.9' END AS src_addr, dst_addr,
          CASE kind WHEN 'missing' THEN -1e0 WHEN 'nullrtt' THEN NULL ELSE rtt END AS rtt FROM lines WHERE kind <> 'bad'""",
        "ping_corrupt_count": f"{DUCK}, {_LINE} SELECT kind = 'bad' AS corrupt, count(*) AS n FROM lines GROUP BY 1",
        "ping_filter": f"{LAYERS} SELECT prb_id, dst_addr, rtt, hr FROM usable",
        "to_slash24": f"{LAYERS} SELECT prb_id, {_slash24('address_v4')} AS subnet FROM probes",
        "ping_to_subnet": f"{LAYERS} SELECT src, dst, rtt, hr FROM sub",
        "hourly_summary": f"{LAYERS} SELECT hr, src, dst, {_LIST} AS rtts FROM sub GROUP BY 1, 2, 3",
        "explode_summary": f"{LAYERS} SELECT src, dst, rtt FROM sub",
        "export_latest": f"{LAYERS} SELECT src, dst, {_LIST} AS rtts FROM sub GROUP BY 1, 2",
        "first_n_hours": f"{LAYERS} SELECT hr, src, dst, {_LIST} AS rtts FROM (SELECT *, dense_rank() OVER (ORDER BY hr) AS k FROM sub) WHERE k <= 10 GROUP BY 1, 2, 3",
        "subnet_locations": f"{LAYERS} SELECT addr, round(lat, 6) AS lat, round(lon, 6) AS lon FROM loc",
        "haversine": f"{DUCK} SELECT sk, dk, round(2e0 * 6371e0 * atan2(sqrt(a), sqrt(1e0 - a)), 6) AS dist_km FROM pair",
        "located_pairs": f"{LAYERS} SELECT src, dst, hr, rtt, round(dist_km, 6) AS dist_km FROM dist",
        "sol_filter": f"{LAYERS} SELECT src, dst, hr, rtt, round(dist_km / 1e2, 6) AS min_rtt FROM sol",
        "sol_filter_array": f"{LAYERS} SELECT src, dst, {_LIST} AS rtts FROM sol GROUP BY 1, 2",
        "array_min_rtt": f"{LAYERS} SELECT src, dst, rtt FROM edges",
        "min_rtt_edges": f"{LAYERS} SELECT src, dst, rtt FROM edges",
        "rtt_wrap": f"{LAYERS} SELECT src, dst, cast(cast(rtt AS decimal(12,3)) AS varchar) AS rtts FROM edges",
        "invert_min": f"{LAYERS} SELECT dst, src, rtt FROM edges",
        "available_vps": f"{LAYERS} SELECT dst, string_agg(src, ',' ORDER BY src) AS srcs FROM edges GROUP BY 1",
        "remaining_vps": f"{LAYERS} SELECT src, dst, rtt FROM (SELECT *, row_number() OVER (ORDER BY md5('42|' || src || '|' || dst), src, dst) AS seq FROM edges) WHERE seq > 1000",
        "all_targets": f"{LAYERS} SELECT DISTINCT dst FROM edges",
        "mesh_nodes": f"{LAYERS} SELECT addr FROM nodes0",
        "mesh_degrees": f"""{LAYERS} SELECT addr, (SELECT count(*) FROM edges WHERE src = addr AND src <> dst) AS out_degree, (SELECT count(*) FROM edges WHERE dst = addr AND src <> dst) AS in_degree FROM nodes0""",
        "mesh_prune_round": f"{LAYERS}, {_prune('m', '0.6e0', 1)} SELECT addr FROM m_1",
        "mesh_prune": f"{_MESH} SELECT addr FROM mesh",
        "mesh_adaptive": _adaptive(),
        "mesh_edges": f"{_MESH} SELECT src, dst, rtt FROM med",
        "mesh_locations": f"{_MESH} SELECT addr, round(lat, 6) AS lat, round(lon, 6) AS lon FROM loc WHERE addr IN (SELECT addr FROM mesh)",
        "mesh_density": f"{_MESH} SELECT n AS n_nodes, e AS n_edges, CASE WHEN n * (n - 1) > 0 THEN round(e / cast(n * (n - 1) AS double), 6) END AS density FROM (SELECT count(*) AS n FROM mesh), (SELECT count(*) AS e FROM med)",
        "constraint_radius": f"{LAYERS} SELECT src, dst, round(rtt * 1e2, 6) AS radius_km FROM edges",
        "constraints_array": f"{_SEEDS} SELECT dst, cast(count(*) AS int) AS n_constraints, round(sum(rtt * 1e2), 6) AS sum_radius_km, min(src) AS first_src FROM vp GROUP BY 1",
        "centroid_seed": f"{_SEEDS} SELECT dst, n_vps, round(lat, 9) AS seed_lat, round(lon, 9) AS seed_lon FROM seed",
        "penalty_at_seed": f"{_SEEDS} SELECT dst, round(sum(CASE WHEN d > r THEN (d - r) * (d - r) ELSE 0.001e0 * d END), 3) AS penalty FROM d GROUP BY 1",
        "region_size": f"{_SEEDS} SELECT dst, round(greatest(0e0, min(r - d)), 6) AS region_size_km FROM d GROUP BY 1",
        "expected_rtt": f"{LAYERS} SELECT e.src, e.dst, round({_km('a', 'b')} * 1.5e0 / 1e2, 6) AS expected_rtt FROM edges e JOIN loc a ON a.addr = e.src JOIN loc b ON b.addr = e.dst",
        "oracle_candidates": f"{picks} SELECT dst, src, rtt, cast(rank AS int) AS rank FROM cand",
        "oracle_first": f"""{picks}, c AS (SELECT k.*, {_km('a', 'b')} AS err FROM cand k JOIN loc a ON a.addr = k.src JOIN loc b ON b.addr = k.dst)
          SELECT dst, src, rtt, round(err, 6) AS error_km FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY err, rtt, src) AS i FROM c) WHERE i = 1""",
        "interleave": f"{picks} SELECT seq, src, dst FROM itl",
        "random_picks": f"{picks} SELECT seq, src, dst, rtt FROM rnd",
        "greedy_as_written": f"{picks} SELECT seq, src, dst, rtt FROM grd",
        "greedy_order": f"""{LAYERS}, u AS (SELECT dst, cast(row_number() OVER (PARTITION BY dst ORDER BY rtt, src) AS int) AS k FROM edges),
          b AS (SELECT dst, k, min(cast(k * 31 % 7 AS double)) OVER (PARTITION BY dst ORDER BY k ROWS UNBOUNDED PRECEDING) AS m FROM u)
          SELECT seq, dst, k FROM (SELECT *, row_number() OVER (ORDER BY m DESC, dst, k) AS seq FROM b) WHERE seq <= 2500""",
        "picks_budget": f"{picks} SELECT strategy, budget, count(*) AS n_picks, count(DISTINCT dst) AS n_targets, round(sum(rtt), 3) AS sum_rtt FROM picks JOIN budgets ON seq <= budget GROUP BY 1, 2",
        "measurements_map": f"{LAYERS},\n{_picks(1000)} SELECT src, cast(count(*) AS int) AS n_dsts FROM rnd GROUP BY 1",
        "utility_snapshot": f"""{LAYERS}, f AS (SELECT dst, arg_min(rtt, src) AS rtt FROM edges GROUP BY 1),
          t AS (SELECT row_number() OVER (ORDER BY dst) AS ping_num, 1e6 AS ex, 20037e0 - greatest(0e0, rtt * 1e2) AS ac FROM f)
          SELECT a.ping_num, round(avg(b.ex), 6) AS avg_expected_km, round(avg(b.ac), 6) AS avg_actual_km,
            arg_max(b.ping_num, struct_pack(e := abs(b.ex - b.ac), n := -b.ping_num)) AS worst_ping, round(max(abs(b.ex - b.ac)), 6) AS worst_error_km
          FROM t a JOIN t b ON b.ping_num BETWEEN a.ping_num - 499 AND a.ping_num GROUP BY 1""",
        "estimate_nn": f"{LAYERS} SELECT n.dst, n.src, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY rtt, src) AS i FROM edges) n JOIN loc ON loc.addr = n.src WHERE i = 1",
        "estimate_single": f"""{few} SELECT strategy, budget, dst, round(any_value(lat), 6) AS lat, round(any_value(lon), 6) AS lon
          FROM picks JOIN (SELECT cast(unnest([100, 200]) AS int) AS budget) ON seq <= budget JOIN loc ON loc.addr = picks.src GROUP BY 1, 2, 3 HAVING count(*) = 1""",
        "estimate_asof": f"{picks} SELECT strategy, budget, dst, src, rtt FROM (SELECT *, row_number() OVER (PARTITION BY strategy, budget, dst ORDER BY rtt, src) AS i FROM picks JOIN budgets ON seq <= budget) WHERE i = 1",
        "budget_curve": f"""{picks}, nn AS (SELECT strategy, budget, dst, src FROM (SELECT *, row_number() OVER (PARTITION BY strategy, budget, dst ORDER BY rtt, src) AS i FROM picks JOIN budgets ON seq <= budget) WHERE i = 1),
          est AS (SELECT nn.*, a.lat, a.lon FROM nn JOIN loc a ON a.addr = nn.src),
          grid AS (SELECT * FROM (SELECT DISTINCT strategy FROM picks), budgets, (SELECT DISTINCT dst FROM edges)),
          r AS (SELECT g.strategy, g.budget, e.dst IS NOT NULL AS found, CASE WHEN b.addr IS NOT NULL THEN coalesce({_km('e', 'b')}, 10000e0) END AS err
            FROM grid g LEFT JOIN est e ON e.strategy = g.strategy AND e.budget = g.budget AND e.dst = g.dst LEFT JOIN loc b ON b.addr = g.dst)
          SELECT strategy, budget, count(*) FILTER (found) AS targets_found, count(*) AS n_targets, round(avg(err), 6) AS avg_error_km FROM r GROUP BY 1, 2""",
        "curve_labels": "SELECT * FROM (VALUES ('random', 'Random'), ('iterative_greedy', 'Iterative_greedy'), ('rtt_rank', 'Rtt_rank')) t(strategy, label)",
        "latency_vs_distance": f"{LAYERS} SELECT src, dst, round(any_value(dist_km), 6) AS dist_km, min(rtt) AS min_rtt FROM sol GROUP BY 1, 2",
        "latency_summary": f"{LAYERS}, p AS (SELECT any_value(dist_km) AS d, min(rtt) AS r FROM sol GROUP BY src, dst) SELECT count(*) AS n_pairs, round(max(d), 6) AS max_dist_km, round(quantile_cont(r, 0.99), 6) AS p99_rtt FROM p",
        "sol_line": f"{LAYERS}, m AS (SELECT max(dist_km) AS m FROM sol) SELECT 0e0 AS dist_km, 0e0 AS rtt UNION ALL SELECT round(m, 6), round(m / 1e2, 6) FROM m",
        "degree_cdf": f"""{LAYERS}, g AS (SELECT 'out' AS direction, count(*) AS degree FROM edges GROUP BY src UNION ALL SELECT 'in', count(*) FROM edges GROUP BY dst)
          SELECT direction, degree, round(row_number() OVER (PARTITION BY direction ORDER BY degree) / cast(count(*) OVER (PARTITION BY direction) AS double), 6) AS p FROM g""",
        "mesh_ideal": f"{LAYERS} SELECT count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_destinations FROM edges",
    }


from __future__ import annotations

E = "e AS (SELECT event_id, user_id, event_type AS stream, value, epoch_us(ts) * 1000 AS t, epoch_us(ts) * 1000 / 1e9 AS s FROM events)"
STEPS = E + ", d AS (SELECT *, t - lag(t) OVER (PARTITION BY stream ORDER BY t) AS d, lag(t) OVER (PARTITION BY stream ORDER BY t) AS p FROM e)"
STEPS += ", m AS (SELECT stream, nullif(median(d), 0) AS m FROM d GROUP BY stream)"
SHAPE = "CASE WHEN n < 100 OR m > span / 10 THEN 'static' WHEN mean >= 3 * m THEN 'burst' ELSE 'periodic' END"
CHECKS = f"""dis AS (SELECT stream, count(*) FILTER (t < pv) AS n_disorder FROM (SELECT stream, t, lag(t) OVER (PARTITION BY stream ORDER BY i) AS pv FROM f) GROUP BY stream),
s AS (SELECT stream, count(*) AS n, max(t) - min(t) AS span, any_value(m) AS m, avg(d) AS mean, any_value(n_disorder) AS n_disorder, count(*) FILTER (d = 0) AS n_duplicates,
  count(*) FILTER (d > 5 * m) AS gaps, coalesce(sum(d - m) FILTER (d > 5 * m), 0) AS lost, count(*) FILTER (d > 2 * m) AS breaks FROM d JOIN m USING (stream) JOIN dis USING (stream) GROUP BY stream),
k AS (SELECT *, {SHAPE} AS shape FROM s),
c AS (SELECT stream, n, span / 1e9 AS span_s, m AS step_ns, 1e9 / mean AS rate_hz, n_disorder, n_duplicates, shape, CASE WHEN shape <> 'burst' THEN gaps END AS n_gaps,
  CASE WHEN shape <> 'burst' THEN least(1.0, lost / span) END AS loss FROM k)"""
NEAR = E + """,
b AS (SELECT DISTINCT t AS bt FROM e WHERE stream = 'click'),
v AS (SELECT stream, t FROM e WHERE stream = 'view'),
n AS (SELECT v.stream, v.t, lo.bt AS lo, hi.bt AS hi FROM v ASOF LEFT JOIN b lo ON v.t >= lo.bt ASOF LEFT JOIN b hi ON v.t <= hi.bt),
o AS (SELECT stream, t, (t - CASE WHEN lo IS NULL OR hi - t <= t - lo THEN hi ELSE lo END) / 1e6 AS x FROM n)"""


def channels(keys: str, columns: str, source: str = "e") -> str:
    """Long form of finite values."""
    return f"c AS (SELECT {keys}, event_id, channel, x FROM (UNPIVOT (SELECT {keys}, event_id, {columns} FROM {source}) ON {columns} INTO NAME channel VALUE x))"


SPEED = E + ", " + channels("user_id", "value, s") + """,
st AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY user_id, channel ORDER BY event_id)) AS d FROM c),
p AS (SELECT user_id, channel, quantile_cont(d, 0.95) AS p95 FROM st GROUP BY ALL HAVING p95 > 0),
sp AS (SELECT user_id, event_id, avg(d / p95) AS speed FROM st JOIN p USING (user_id, channel) WHERE d IS NOT NULL GROUP BY ALL)"""
SECOND = E + """,
w AS (SELECT stream, event_id, value AS x, lag(value) OVER o - 2 * value + lead(value) OVER o AS dd FROM e WINDOW o AS (PARTITION BY stream ORDER BY event_id))"""



def slopes(others: str) -> str:
    """Slope and range of each stream's nearest time less the baseline's (b), over the baseline's rows; of two as near the later."""
    return f"""dn AS (SELECT x.stream, x.t, lo.t AS lo, hi.t AS hi FROM (SELECT n.stream, b.t FROM b CROSS JOIN (SELECT DISTINCT stream FROM {others}) n) x
  ASOF LEFT JOIN {others} lo ON x.stream = lo.stream AND x.t >= lo.t ASOF LEFT JOIN {others} hi ON x.stream = hi.stream AND x.t <= hi.t),
do_ AS (SELECT stream, (t - (SELECT min(t) FROM b)) / 1e9 AS sec, (CASE WHEN lo IS NULL OR hi - t <= t - lo THEN hi ELSE lo END - t) / 1e6 AS x FROM dn),
dr AS (SELECT stream, CASE WHEN count(*) >= 3 THEN regr_slope(x, sec) END AS slope, CASE WHEN count(*) >= 3 THEN max(x) - min(x) END AS spread FROM do_ GROUP BY stream)"""


def alignment() -> str:
    """Of sub-streams (f: container, stream, t): offsets from the master, the one of the longest span."""
    return f"""cd AS (SELECT *, t - lag(t) OVER (PARTITION BY container, stream ORDER BY t) AS d FROM f), cm AS (SELECT container, stream, nullif(median(d), 0) AS m FROM cd GROUP BY ALL),
cs AS (SELECT container, stream, count(*) AS n, min(t) AS head, max(t) AS tail, max(t) - min(t) AS span, any_value(m) AS m, avg(d) AS mean, count(*) FILTER (d > 5 * m) AS gaps FROM cd JOIN cm USING (container, stream) GROUP BY ALL),
ck AS (SELECT *, {SHAPE} AS shape, first_value(stream) OVER w AS master, first_value(head) OVER w AS h, first_value(tail) OVER w AS l FROM cs WINDOW w AS (PARTITION BY container ORDER BY span DESC, stream))
SELECT container, stream, master, n, (n - 1) / (span / 1e9) AS rate_hz, (head - h) / 1e9 AS head_offset_s, (tail - l) / 1e9 AS tail_offset_s, shape, CASE WHEN shape <> 'burst' THEN gaps END AS n_gaps,
  abs(head - h) > 0.05 * (l - h) OR abs(tail - l) > 0.05 * (l - h) AS flagged FROM ck"""


RECORDING = """e AS (SELECT event_type AS stream, epoch_us(ts) * 1000 AS t, event_id AS i FROM events UNION ALL
  SELECT 'tf', (SELECT min(epoch_us(ts) * 1000) FROM events) + o_orderkey * 2000000 + j * 1000, o_orderkey * 20 + j FROM orders CROSS JOIN range(20) r(j) WHERE o_orderkey <= 200),
f AS (SELECT * FROM e), d AS (SELECT *, t - lag(t) OVER (PARTITION BY stream ORDER BY t) AS d, lag(t) OVER (PARTITION BY stream ORDER BY t) AS p FROM e),
m AS (SELECT stream, nullif(median(d), 0) AS m FROM d GROUP BY stream)"""

ORACLES: dict[str, str] = {
    "q01_stream_checks": f"WITH {STEPS}, f AS (SELECT stream, t, event_id AS i FROM e), {CHECKS} SELECT * FROM c",
    "q02_stream_shape": f"""WITH {STEPS}, f AS (SELECT stream, t, event_id AS i FROM e), {CHECKS}
SELECT stream, n, shape, CASE WHEN shape = 'burst' THEN breaks + 1 END AS n_bursts, CASE WHEN shape = 'burst' THEN n / (span / 1e9) END AS effective_hz FROM k""",
    "q03_gaps": f"""WITH {STEPS}, f AS (SELECT stream, t, event_id AS i FROM e), {CHECKS},
g AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY p) AS nth, p AS start_ns, t AS end_ns, d / 1e9 AS duration_s, CAST(floor(d / m) - 1 AS BIGINT) AS n_missing
  FROM d JOIN k USING (stream) WHERE d > 5 * m AND shape <> 'burst')
SELECT * FROM g WHERE nth <= 20""",
    "q04_baseline_rank": f"""WITH {STEPS},
s AS (SELECT stream, count(*) AS n, max(t) - min(t) AS span, avg(d) FILTER (d > 0) AS mean, stddev_pop(d) FILTER (d > 0) AS dev FROM d GROUP BY stream)
SELECT stream, n, span / (SELECT max(span) FROM s) AS coverage, span / (SELECT max(span) FROM s) / (1 + dev / mean) * log10(greatest(n, 10)) AS score
FROM s WHERE n >= 100 AND NOT regexp_matches(lower(stream), 'tf_static|static_tf|_static|static_|calib|metadata|metainfo') AND span / (SELECT max(span) FROM s) >= 0.95""",
    "q05_nearest_residual": f"""WITH {NEAR}
SELECT stream, count(*) AS n, avg(abs(x)) AS mean_ms, max(abs(x)) AS max_ms, quantile_cont(abs(x), 0.95) AS p95_ms,
  quantile_cont(x, 0.05) AS signed_p05_ms, quantile_cont(x, 0.5) AS signed_median_ms, quantile_cont(x, 0.95) AS signed_p95_ms FROM o WHERE x IS NOT NULL GROUP BY stream""",
    "q06_drift": f"""WITH {E}, b AS (SELECT t FROM e WHERE stream = 'click'), o AS (SELECT DISTINCT stream, t FROM e WHERE stream IN ('view', 'purchase')), {slopes("o")}
SELECT stream, slope AS slope_ms_per_s, spread AS range_ms, abs(slope) > 0.5 AND spread > 2000 AS drifts FROM dr""",
    "q07_measured_rate": f"""WITH {E}, f AS (SELECT stream, t - lag(t) OVER (PARTITION BY stream ORDER BY event_id) AS d FROM e)
SELECT stream, count(*) AS n, median(d) FILTER (d > 0) AS step_ns, 1e9 / median(d) FILTER (d > 0) AS rate_hz FROM f GROUP BY stream HAVING count(*) >= 3""",
    "q08_unit_inference": f"""WITH {E}, k AS (SELECT unnest(['s', 'ms', 'us', 'ns']) AS clock, unnest([1e9, 1e6, 1e3, 1.0]) AS div),
c AS (SELECT clock, t / div AS v FROM e CROSS JOIN k), x AS (SELECT clock, v, v - lag(v) OVER (PARTITION BY clock ORDER BY v) AS d FROM c),
s AS (SELECT clock, count(*) AS n, median(abs(v)) AS size, median(d) FILTER (d > 0) AS step FROM x GROUP BY clock),
u AS (SELECT *, CASE WHEN size >= 1e17 THEN 'ns' WHEN size >= 1e14 THEN 'us' WHEN size >= 1e11 THEN 'ms' WHEN size >= 1e8 THEN 's' END AS by_size,
  CASE WHEN size >= 1e17 AND size < 1e19 AND step >= 1e4 AND step < 1e10 THEN 'ns' WHEN size >= 1e14 AND size < 1e17 AND step >= 10 AND step < 1e10 THEN 'us'
    WHEN size >= 1e11 AND size < 1e14 AND step >= 1e-3 AND step < 1e8 THEN 'ms' WHEN size >= 1e8 AND size < 1e11 AND step >= 1e-6 AND step < 1e5 THEN 's'
    WHEN step < 1e3 THEN 'ns' WHEN step < 1e5 THEN 'us' WHEN step < 1e9 THEN 'ms' WHEN step IS NOT NULL THEN 's' END AS by_step FROM s),
f AS (SELECT *, coalesce(by_step, by_size, 'unknown') AS first FROM u),
o AS (SELECT *, [x for x in [first, by_size, 's', 'ms', 'us', 'ns']
  if CASE x WHEN 's' THEN 1 WHEN 'ms' THEN 1e3 WHEN 'us' THEN 1e6 WHEN 'ns' THEN 1e9 END / step BETWEEN 0.001 AND 1e7] AS fitting FROM f)
SELECT clock, n, size, step, CASE WHEN step IS NULL THEN first ELSE coalesce(fitting[1], first) END AS unit,
  CASE WHEN step IS NULL OR fitting[1] = first THEN 'inferred' WHEN fitting[1] IS NOT NULL THEN 'corrected' ELSE 'ambiguous' END AS basis FROM o""",
    "q09_generic_stats": """WITH c AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME "column" VALUE x)
SELECT l_returnflag, "column", count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, min(x) AS min, max(x) AS max, median(x) AS median FROM c GROUP BY ALL""",
    "q10_column_profile": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) FILTER ({c} IS NULL) AS n_missing, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS missing_share, count(DISTINCT {c}) AS n_distinct, """
        + ", ".join(f"CAST({f.format(c) if t != 'string' else 'NULL'} AS DOUBLE) AS {n}" for n, f in (
            ("mean", "avg({})"), ("std", "stddev_samp({})"), ("min", "min({})"), ("max", "max({})"), ("q25", "quantile_cont({}, 0.25)"), ("median", "median({})"), ("q75", "quantile_cont({}, 0.75)")))
        + f""", CASE WHEN count(DISTINCT {c}) <= 20 THEN string_agg(DISTINCT CAST({c} AS VARCHAR), '|' ORDER BY CAST({c} AS VARCHAR)) END AS samples FROM orders"""
        for c, t in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderpriority", "string"))
    ),
    "q11_iqr_outliers": """WITH u AS (SELECT user_id, sum(value) AS total FROM events GROUP BY user_id), q AS (SELECT quantile_cont(total, 0.25) AS a, quantile_cont(total, 0.75) AS b FROM u)
SELECT user_id, total, a - 1.5 * (b - a) AS low, b + 1.5 * (b - a) AS high FROM u, q WHERE total < a - 1.5 * (b - a) OR total > b + 1.5 * (b - a)""",
    "q12_episode_distribution": "SELECT user_id, count(*) AS n_rows FROM events GROUP BY user_id",
    "q13_success_rate": """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id)
SELECT count(*) AS n_episodes, CAST(count(*) FILTER (last = 'purchase') AS BIGINT) AS n_success, count(*) FILTER (last = 'purchase') / count(*) AS rate FROM l""",
    "q14_bad_values_gate": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER ({w}) AS n_bad, count(*) FILTER ({w}) / count(*) AS ratio, count(*) FILTER ({w}) / count(*) > 0.05 AS fails FROM lineitem"""
        for c, w in (("with_null", "l_linenumber = 7"), ("with_nan", "l_quantity > 45"), ("with_inf", "l_quantity < 2"))
    ),
    "q15_monotonic_gate": f"""WITH {E}, k AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN t - 86400000000000 ELSE t END AS t FROM e),
l AS (SELECT user_id, t, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM k)
SELECT user_id, count(*) AS n, count(*) FILTER (t < p) AS n_back, count(*) FILTER (t = p) AS n_same,
  CASE WHEN count(*) FILTER (t < p) > 0 THEN 'fail' WHEN count(*) FILTER (t = p) > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM l GROUP BY user_id""",
    "q16_frame_loss_gate": f"""WITH {E}, d AS (SELECT stream, s - lag(s) OVER (PARTITION BY stream ORDER BY s) AS d FROM e), m AS (SELECT stream, median(d) FILTER (d > 0) AS m FROM d GROUP BY stream),
g AS (SELECT stream, count(*) AS n, coalesce(sum(round(d / m) - 1) FILTER (d > 5 * m), 0.0) AS n_missing FROM d JOIN m USING (stream) GROUP BY stream)
SELECT stream, n, n_missing, n_missing / (n + n_missing) AS loss, n_missing / (n + n_missing) > 0.02 AS fails FROM g""",
    "q17_idle_ratio": f"WITH {SPEED} SELECT user_id, count(*) AS n_steps, count(*) FILTER (speed < 0.1) / count(*) AS idle_ratio, count(*) FILTER (speed < 0.1) / count(*) > 0.6 AS warns FROM sp GROUP BY user_id",
    "q18_action_spike": f"""WITH {SECOND}, m AS (SELECT stream, median(abs(dd)) AS m FROM w WHERE dd IS NOT NULL GROUP BY stream HAVING m > 0)
SELECT stream, 'value' AS channel, count(*) AS n_spikes, max(abs(dd) / m) AS worst FROM w JOIN m USING (stream) WHERE abs(dd) > 4 * m GROUP BY stream""",
    "q18_timed_action_spike": f"""WITH {E}, g AS (SELECT *, event_id / 10 + event_id % 3 / 50 AS a FROM e),
w AS (SELECT stream, lag(value) OVER o - 2 * value + lead(value) OVER o AS dd, lead(a) OVER o - a AS dt FROM g WINDOW o AS (PARTITION BY stream ORDER BY event_id)),
z AS (SELECT stream, abs(dd / (dt * dt)) AS x FROM w WHERE dt > 0 AND dd IS NOT NULL), m AS (SELECT stream, median(x) AS m FROM z GROUP BY stream HAVING median(x) > 0)
SELECT stream, 'value' AS channel, count(*) AS n_spikes, max(x / m) AS worst FROM z JOIN m USING (stream) WHERE x > 4 * m GROUP BY stream""",
    "q19_action_jerk": f"""WITH {E}, w AS (SELECT stream, value AS x, CASE WHEN count(*) OVER o = 5 THEN avg(value) OVER o END AS a FROM e WINDOW o AS (PARTITION BY stream ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
s AS (SELECT stream, count(*) AS n, var_pop(x - a) / var_pop(x) AS r FROM w GROUP BY stream HAVING count(*) >= 8)
SELECT stream, 'value' AS channel, n, r AS jerk_ratio, r > 0.3 AS warns FROM s""",
    "q20_pauses": f"""WITH {SPEED}, g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, speed < 0.3 ORDER BY event_id) AS g FROM sp)
SELECT user_id, count(*) AS n_rows, min(event_id) AS first, max(event_id) AS last FROM g WHERE speed < 0.3 GROUP BY user_id, g HAVING count(*) >= 3""",
    "q21_arm_shaking": f"""WITH {SECOND}, z AS (SELECT stream, dd, lag(dd) OVER (PARTITION BY stream ORDER BY event_id) AS p FROM w WHERE dd <> 0)
SELECT stream, 'value' AS channel, count(*) AS n, count(*) FILTER (sign(dd) <> sign(p)) / count(*) AS flip_ratio, count(*) FILTER (sign(dd) <> sign(p)) / count(*) > 0.3 AS warns FROM z GROUP BY stream""",
    "q22_path_efficiency": f"""WITH {E}, {channels("user_id", "value, s")},
r AS (SELECT user_id, channel, max(x) - min(x) AS r, arg_min(x, event_id) AS x0, arg_max(x, event_id) AS x1 FROM c GROUP BY ALL HAVING r > 0),
st AS (SELECT user_id, channel, event_id, x - lag(x) OVER (PARTITION BY user_id, channel ORDER BY event_id) AS d FROM c),
p AS (SELECT user_id, sum(s) AS path FROM (SELECT user_id, event_id, sqrt(sum(pow(d / r, 2))) AS s FROM st JOIN r USING (user_id, channel) GROUP BY ALL) GROUP BY user_id),
q AS (SELECT user_id, count(*) AS n_channels, sqrt(sum(pow((x1 - x0) / r, 2))) AS direct FROM r GROUP BY user_id HAVING count(*) >= 2)
SELECT user_id, n_channels, least(1, greatest(0, direct / nullif(path, 0))) AS efficiency, least(1, greatest(0, direct / nullif(path, 0))) < 0.3 AS warns FROM q JOIN p USING (user_id)""",
    "q23_actuator_saturation": """WITH g AS (SELECT l_suppkey, abs(l_quantity - lead(l_tax * 500) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey)) AS g FROM lineitem)
SELECT l_suppkey, 'l_quantity' AS channel, count(*) AS n, count(*) FILTER (g > 7) AS n_over, max(g) AS worst FROM g WHERE g IS NOT NULL GROUP BY l_suppkey""",
    "q26_dataset_diff": """WITH a AS (SELECT c_nationkey AS stream, count(*) AS n, max(c_acctbal) - min(c_acctbal) AS span_s, avg(c_acctbal) AS rate_hz FROM customer WHERE c_nationkey < 20 GROUP BY 1),
b AS (SELECT s_nationkey AS stream, count(*) AS n, max(s_acctbal) - min(s_acctbal) AS span_s, avg(s_acctbal) AS rate_hz FROM supplier WHERE s_nationkey > 3 GROUP BY 1)
SELECT stream, CASE WHEN a.n IS NULL THEN 'only_b' WHEN b.n IS NULL THEN 'only_a' ELSE 'matched' END AS state, a.n AS n_a, b.n AS n_b, a.span_s AS span_s_a, b.span_s AS span_s_b,
  a.rate_hz AS rate_hz_a, b.rate_hz AS rate_hz_b, a.n = b.n AS same_n, abs(a.span_s - b.span_s) < 0.5 AS same_span FROM a FULL JOIN b USING (stream)""",
    "q28_pose_blocks": """WITH b AS (SELECT i AS block, CAST(embedding[7 * i + 1:7 * i + 7] AS DOUBLE[]) AS b FROM embeddings CROSS JOIN range(0, 9) r(i)),
z AS (SELECT *, len([x for x in b if x <> 0]) = 0 AS zero, sqrt(b[4] * b[4] + b[5] * b[5] + b[6] * b[6] + b[7] * b[7]) AS norm FROM b),
s AS (SELECT CAST(block AS INTEGER) AS block, count(*) AS n, count(*) FILTER (zero) AS n_zero, min(b[1]) AS x_min, max(b[1]) AS x_max, min(b[2]) AS y_min, max(b[2]) AS y_max, min(b[3]) AS z_min, max(b[3]) AS z_max,
  avg(norm) FILTER (NOT zero) AS quat_norm_mean, stddev_pop(norm) FILTER (NOT zero) AS quat_norm_std FROM z GROUP BY block)
SELECT *, quat_norm_std < 0.01 AND abs(quat_norm_mean - 1) < 0.01 AS quat_valid FROM s""",
    "q29_stationary_blocks": """WITH b AS (SELECT CAST(floor((event_id - 1) / 100) AS BIGINT) AS block, count(*) AS n, avg(value) AS mean, var_pop(value) AS v FROM events GROUP BY 1)
SELECT block, n, mean, CASE WHEN mean = 0 THEN v ELSE v / pow(mean, 2) END AS variation, n = 100 AND CASE WHEN mean = 0 THEN v ELSE v / pow(mean, 2) END < 0.02 AS static FROM b""",
    "q30_constant_channels": """WITH c AS (UNPIVOT (SELECT CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, CAST(3.5 AS DOUBLE) AS flat FROM orders) ON o_custkey, o_totalprice, flat INTO NAME "column" VALUE x),
s AS (SELECT "column", count(*) AS n, CASE WHEN max(x) > min(x) THEN var_pop(x) / pow(max(x) - min(x), 2) ELSE 0 END AS variation FROM c GROUP BY 1)
SELECT *, variation < 1e-6 AS constant FROM s WHERE n > 10""",
    "q31_clipping": """WITH c AS (UNPIVOT (SELECT l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem) ON l_quantity, l_discount, l_tax, l_extendedprice INTO NAME "column" VALUE x),
m AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM c GROUP BY 1)
SELECT "column", count(*) AS n, count(*) FILTER (lo < hi AND (x = lo OR x = hi)) AS n_at_ends, count(*) FILTER (lo < hi AND (x = lo OR x = hi)) / count(*) AS share,
  count(*) FILTER (lo < hi AND (x = lo OR x = hi)) / count(*) > 0.05 AS fails FROM c JOIN m USING ("column") GROUP BY 1""",
    "q32_zscores": "SELECT event_id, event_type AS stream, value, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY event_type)",
    "q33_histogram": """WITH r AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem),
c AS (SELECT CAST(least(29, floor((l_extendedprice - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, lo + i * w AS low, lo + (i + 1) * w AS high, coalesce(n, 0) AS n FROM range(0, 30) g(i) CROSS JOIN r LEFT JOIN c ON c.bin = i""",
    "q34_envelope": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "q37_snapshot_diff": """WITH o AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS episode_key, o_orderstatus AS s FROM orders),
a AS (SELECT * FROM o WHERE id % 5 <> 0), b AS (SELECT id, episode_key, CASE WHEN id % 11 = 0 THEN 'X' ELSE s END AS s FROM o WHERE id % 7 <> 0)
SELECT id, episode_key, CASE WHEN a.s IS NULL THEN 'added' WHEN b.s IS NULL THEN 'removed' WHEN a.s <> b.s THEN 'modified' ELSE 'unchanged' END AS state,
  CASE WHEN a.s <> b.s THEN 'o_orderstatus' ELSE '' END AS changed FROM a FULL JOIN b USING (id, episode_key)""",
    "q37_upsert_log": """SELECT 'segment' AS scope, CAST(o_custkey AS VARCHAR) AS episode_key, o_orderkey AS id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'added' WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'U' THEN 'modified' ELSE 'skipped' END AS action FROM orders WHERE o_orderkey % 2 = 0""",
    "q38_log_lines": """SELECT event_id AS row_index, CASE WHEN event_id % 10 <> 0 THEN 'I' END AS level, CASE WHEN event_id % 10 <> 0 THEN 1 END AS month, CASE WHEN event_id % 10 <> 0 THEN 1 END AS day,
  CASE WHEN event_id % 10 <> 0 THEN (event_id % 60) * 1000000 + 250 END AS time_of_day_us, CASE WHEN event_id % 10 <> 0 THEN CAST(17 AS BIGINT) END AS thread,
  CASE WHEN event_id % 10 <> 0 THEN 'feed.cc:12' END AS source, CASE WHEN event_id % 10 <> 0 THEN event_type ELSE props END AS message FROM events""",
    "q38_timestamp_lines": "SELECT event_id AS row_index, epoch_us(ts) * 1000 AS timestamp, event_id AS frame_index FROM events",
    "q38_fractional_timestamps": """SELECT event_id AS row_index, epoch_us(ts) AS timestamp_us, event_id AS frame_index, CAST(value AS DOUBLE) AS value_2,
  CASE WHEN event_type = 'click' THEN 'C' ELSE 'O' END AS status FROM events""",
    "q58_props_fields": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, 'bigint' AS kind FROM events",
    "q59_message_fields": """SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN CAST(turn AS BIGINT) END AS said_n, CASE WHEN role = 'user' THEN CAST(length(text) AS BIGINT) END AS said_size,
  CASE WHEN role <> 'user' THEN CAST(length(text) AS DOUBLE) / 4 END AS score, CASE WHEN role <> 'user' THEN CAST(turn AS BIGINT) END AS span_0, CASE WHEN role <> 'user' THEN CAST(turn AS BIGINT) + 1 END AS span_1
FROM conversations""",
    "q39_steady_rate": f"""WITH {STEPS}, mp AS (SELECT stream, median(d) FILTER (d > 0) AS m FROM d GROUP BY stream) SELECT stream, count(*) AS n_steps, 1e9 / avg(d) AS rate_hz, stddev_pop(d) / 1e6 AS jitter_ms FROM d JOIN mp USING (stream) WHERE d > 0 AND d <= 10 * m GROUP BY stream""",
    "q40_container_alignment": f"""WITH {E}, f AS (SELECT 'c' || CAST(user_id % 4 AS VARCHAR) AS container, stream, t FROM e), {alignment()}""",
    "q40_burst_alignment": f"WITH {RECORDING.replace('f AS (SELECT * FROM e)', "f AS (SELECT 'c' AS container, stream, t FROM e)")}, {alignment()}",
    "q41_sync_report": f"""WITH {RECORDING}, {CHECKS},
b AS (SELECT t FROM e WHERE stream = 'click'), o AS (SELECT stream, t FROM e WHERE stream <> 'click' AND stream IN (SELECT stream FROM k WHERE shape <> 'burst')),
od AS (SELECT DISTINCT * FROM o), bd AS (SELECT DISTINCT t FROM b), {slopes("od")},
rn AS (SELECT o.stream, o.t, lo.t AS lo, hi.t AS hi FROM o ASOF LEFT JOIN bd lo ON o.t >= lo.t ASOF LEFT JOIN bd hi ON o.t <= hi.t),
rs AS (SELECT stream, avg(abs(x)) AS mean_ms, max(abs(x)) AS max_ms, quantile_cont(abs(x), 0.95) AS p95_ms, quantile_cont(x, 0.05) AS signed_p05_ms, quantile_cont(x, 0.5) AS signed_median_ms,
  quantile_cont(x, 0.95) AS signed_p95_ms FROM (SELECT stream, (t - CASE WHEN lo IS NULL OR hi - t <= t - lo THEN hi ELSE lo END) / 1e6 AS x FROM rn) GROUP BY stream),
j AS (SELECT c.*, mean_ms, max_ms, p95_ms, signed_p05_ms, signed_median_ms, signed_p95_ms, slope AS slope_ms_per_s, spread AS range_ms,
  CASE WHEN dr.stream IS NOT NULL THEN abs(slope) > 0.5 AND spread > 2 * (SELECT m / 1e6 FROM k WHERE stream = 'click') END AS drifts, 'click' AS baseline
  FROM c LEFT JOIN rs USING (stream) LEFT JOIN dr USING (stream))
SELECT *, CASE WHEN coalesce(loss > 0.02, false) OR coalesce(drifts, false) THEN 'fail'
  WHEN coalesce(max_ms > 0.75 * 1000 / (SELECT max(rate_hz) FROM c WHERE shape <> 'burst') * 0.5, false) OR n_disorder + n_duplicates > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM j""",
    "q42_episode_bounds": f"""WITH {E}, k AS (SELECT user_id, event_id, CASE WHEN user_id % 9 = 0 THEN -t ELSE t END AS t FROM e)
SELECT user_id, arg_min(t, event_id) AS first, arg_max(t, event_id) AS last, count(*) AS n, arg_max(t, event_id) < arg_min(t, event_id) AS fails FROM k GROUP BY user_id""",
    "q43_range_of_motion": """WITH c AS (UNPIVOT (SELECT CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) ON p_size, p_retailprice INTO NAME "column" VALUE x)
SELECT "column", min(x) AS min, max(x) AS max, max(x) - min(x) AS range FROM c GROUP BY 1""",
    "q44_last_duration": "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "q45_label_balance": """WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, n / sum(n) OVER () AS share, sum(n) OVER () >= 5 AND n / sum(n) OVER () > 0.8 AS dominates FROM c""",
    "q46_task_candidates": """WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS tasks FROM f GROUP BY user_id""",
    "q47_gate_fps": f"""WITH {E}, f AS (SELECT stream, t - lag(t) OVER (PARTITION BY stream ORDER BY event_id) AS d FROM e), r AS (SELECT stream, 1e9 / median(d) FILTER (d > 0) AS rate_hz FROM f GROUP BY stream HAVING count(*) >= 3)
SELECT stream, rate_hz, CAST(0.001 AS DOUBLE) AS declared_fps, abs(rate_hz - CAST(0.001 AS DOUBLE)) / CAST(0.001 AS DOUBLE) AS deviation, CASE WHEN abs(rate_hz - 0.001) / 0.001 > 0.05 THEN 'warn' ELSE 'pass' END AS verdict FROM r""",
    "q49_chart_series": f"""WITH {E}, r AS (SELECT stream, min(t) AS lo, max(t) AS hi FROM e GROUP BY stream)
SELECT stream, CAST(least(199, floor((t - lo) * 200 / greatest(1, hi - lo))) AS INTEGER) AS bin, count(*) AS n, min(t) AS t, avg(value) AS mean, min(value) AS min, max(value) AS max FROM e JOIN r USING (stream) GROUP BY ALL""",
    "q50_force_checks": """WITH c AS (UNPIVOT (SELECT l_quantity, l_discount FROM lineitem) ON l_quantity, l_discount INTO NAME "column" VALUE x), m AS (SELECT "column", min(x) AS lo, max(x) AS hi FROM c GROUP BY 1)
SELECT "column", count(*) AS n, count(*) FILTER (x = lo OR x = hi) / count(*) AS share, CAST(0.0 AS DOUBLE) AS bad_share, CASE WHEN count(*) FILTER (x = lo OR x = hi) / count(*) > 0.05 THEN 'fail' ELSE 'pass' END AS verdict FROM c JOIN m USING ("column") GROUP BY 1""",
    "q51_document_grep": """WITH l AS (SELECT event_id AS row_index, event_type || ' ' || props AS value, contains(event_type || ' ' || props, 'purchase') AS h FROM events),
n AS (SELECT *, coalesce(lag(h) OVER o, false) OR coalesce(lead(h) OVER o, false) AS near FROM l WINDOW o AS (ORDER BY row_index)) SELECT row_index, value, h AS is_match FROM n WHERE h OR near""",
    "q52_episode_anchors": f"""WITH {E} SELECT CAST(user_id AS VARCHAR) AS episode_key, min(s) AS start_s, max(s) AS end_s, min(event_id) AS first_row, max(event_id) AS last_row, count(*) AS n_rows, max(s) - min(s) AS duration_s FROM e GROUP BY user_id""",
    "q60_times_in_ns": f"""WITH {E}, u AS (SELECT event_id, ['ns', 'us', 'ms', 's', 'frame_index'][event_id % 5 + 1] AS unit, t // [1, 1000, 1000000, 1000000000, 1][event_id % 5 + 1] AS v FROM e)
SELECT event_id, unit, CASE unit WHEN 'ns' THEN v WHEN 'us' THEN v * 1000 WHEN 'ms' THEN v * 1000000 WHEN 's' THEN v * 1000000000 END AS ns,
  CASE WHEN v >= 1e17 THEN 'ns' WHEN v >= 1e14 THEN 'us' WHEN v >= 1e11 THEN 'ms' WHEN v >= 1e8 THEN 's' END AS hint FROM u""",
    "q61_gripper_flips": """WITH r AS (SELECT event_type AS stream, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1 HAVING max(value) > min(value)),
o AS (SELECT stream, event_id, (value - lo) / (hi - lo) > 0.5 AS o FROM events JOIN r ON r.stream = event_type), p AS (SELECT *, lag(o) OVER (PARTITION BY stream ORDER BY event_id) AS p FROM o)
SELECT stream, event_id AS boundary, 'gripper' AS evidence FROM p WHERE o <> p""",
    "q62_merged_segments": """WITH s AS (SELECT o_custkey, o_orderkey AS k, CASE WHEN o_orderkey * 7 % 100 >= 64 THEN o_orderkey END AS good FROM orders),
g AS (SELECT *, coalesce(min(good) OVER (PARTITION BY o_custkey ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(good) OVER (PARTITION BY o_custkey ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), k) AS grp FROM s)
SELECT o_custkey, min(k) * 10 AS start_frame, max(k) * 10 + 9 AS end_frame, 'e' || CAST(coalesce(min(good), min(k)) AS VARCHAR) AS evidence FROM g GROUP BY o_custkey, grp""",
    "q64_time_texts": """WITH v AS (SELECT event_id, round_even(value * 37 - 900, 0) AS r FROM events), w AS (SELECT event_id, r, CAST(abs(r) AS BIGINT) AS a FROM v)
SELECT event_id, CASE WHEN r < 0 THEN '-' ELSE '' END || printf('%02d:%02d:%02d', a // 3600, a % 3600 // 60, a % 60) AS shown,
  CASE event_id % 4 WHEN 0 THEN CAST((event_id % 100) * 3600 + 7 * 60 + 1.5 AS DOUBLE) WHEN 1 THEN CAST(-((event_id % 60) * 60 + 30) AS DOUBLE) WHEN 2 THEN CAST(event_id AS DOUBLE) END AS parsed FROM w""",
    "q65_record_errors": """WITH r AS (SELECT o_orderkey AS id, ['segment', 'task', 'other'][o_orderkey % 7 % 3 + 1] AS scope, [NULL, 'imported', 'user_confirmed', 'guess'][o_orderkey % 5 % 4 + 1] AS src,
  [NULL, 'high', 'odd'][o_orderkey % 11 % 3 + 1] AS conf, o_orderkey % 13 = 0 AS no_key, o_orderkey % 17 - 1 AS a, o_orderkey % 19 AS b, o_orderkey % 3 = 0 AS noise,
  o_orderkey % 4 % 2 = 0 AS no_reason, o_orderkey % 2 = 1 AS no_label, o_orderkey % 6 % 3 = 1 AS bad_hand FROM orders),
n AS (SELECT *, coalesce(src, 'llm_proposed') AS source, coalesce(conf, CASE coalesce(src, 'llm_proposed') WHEN 'user_confirmed' THEN 'high' WHEN 'llm_proposed' THEN 'low' ELSE 'medium' END) AS confidence FROM r)
SELECT id, source, confidence, array_to_string([x for x in [CASE WHEN scope = 'other' THEN 'scope' END, CASE WHEN source = 'guess' THEN 'source' END, CASE WHEN confidence = 'odd' THEN 'confidence' END,
  CASE WHEN no_key THEN 'episode_key' END, CASE WHEN scope = 'segment' AND NOT (a >= 0 AND b >= a) THEN 'times' END, CASE WHEN noise AND no_reason THEN 'noise_reason' END,
  CASE WHEN scope = 'task' AND no_label THEN 'task' END, CASE WHEN bad_hand THEN 'hand' END] if x IS NOT NULL], ',') AS errors FROM n""",
    "q66_estimated_frames": """WITH m AS (SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_quantity AS DOUBLE) * CAST(l_extendedprice / 1000 AS DOUBLE)) AS BIGINT) AS g,
  CASE l_linenumber % 3 WHEN 1 THEN 1 WHEN 2 THEN CAST(l_quantity * 40 AS BIGINT) END AS n FROM lineitem), o AS (SELECT *, n IS NULL OR n <= 1 OR n > 10 * g OR n * 10 < g AS odd FROM m)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN odd THEN g ELSE n END AS BIGINT) AS n_frames, odd AS estimated FROM o""",
    "q67_rate_consistency": f"""WITH {E} SELECT stream, count(*) AS n, CASE stream WHEN 'click' THEN 'match' WHEN 'view' THEN 'mismatch' ELSE 'unknown' END AS consistency FROM e GROUP BY stream HAVING count(*) >= 3""",
    "q68_camera_coverage": """WITH n AS (SELECT DISTINCT o_custkey % 50 AS container, 'cam' || CAST(o_orderkey % 23 AS VARCHAR) AS camera, o_orderkey % 3 = 0 AS k FROM orders),
c AS (SELECT container, camera, bool_or(k) AS has_clock, bool_or(NOT k) AS has_images FROM n GROUP BY ALL)
SELECT container, coalesce(string_agg(camera, ',' ORDER BY camera) FILTER (NOT has_clock), '') AS without_clock, coalesce(string_agg(camera, ',' ORDER BY camera) FILTER (NOT has_images), '') AS without_images FROM c GROUP BY container""",
    "q69_frame_clock": f"WITH {E} SELECT event_id AS frame_index, value, t FROM e",
    "q70_clock_conflicts": f"""WITH f AS (SELECT 's' || CAST(user_id % 3 AS VARCHAR) AS stream, event_id // 200 * 2000000000 + event_id % 200 * 1000 AS w, event_id * 100000000 AS o FROM events),
l AS (SELECT stream, 'w' AS clock, w AS t FROM f UNION ALL SELECT stream, 'o', o FROM f), d AS (SELECT *, t - lag(t) OVER (PARTITION BY stream, clock ORDER BY t) AS d FROM l),
m AS (SELECT stream, clock, nullif(median(d), 0) AS m FROM d GROUP BY ALL), s AS (SELECT stream, clock, count(*) AS n, max(t) - min(t) AS span, any_value(m) AS m, avg(d) AS mean FROM d JOIN m USING (stream, clock) GROUP BY ALL),
k AS (SELECT *, {SHAPE} AS shape FROM s)
SELECT a.stream, 'taken' AS clock, CAST(1.0 AS DOUBLE) AS coverage, b.shape AS main_shape, a.shape, (a.n - 1) / (a.span / 1e9) AS rate_hz, b.shape <> a.shape AS suspected
FROM k a JOIN k b ON a.stream = b.stream AND a.clock = 'o' AND b.clock = 'w' WHERE b.shape = 'burst'""",
    "q71_trajectory": """WITH r AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events), b AS (SELECT event_id, value, user_id, floor((event_id - lo) * 100 / greatest(1, hi - lo + 1)) AS b FROM events, r)
SELECT event_id, value, user_id FROM b QUALIFY row_number() OVER (PARTITION BY b ORDER BY event_id) = 1""",
    "q72_overlay": f"""WITH {E}, r AS (SELECT stream, t - min(t) OVER (PARTITION BY stream) AS t, value, (value - avg(value) OVER (PARTITION BY stream)) / stddev_pop(value) OVER (PARTITION BY stream) AS z FROM e WHERE stream IN ('click', 'view', 'error')),
h AS (SELECT stream, max(t) AS hi FROM r GROUP BY stream)
SELECT stream, CAST(least(49, floor(t * 50 / greatest(1, hi))) AS INTEGER) AS bin, count(*) AS n, min(t) AS t, avg(value) AS raw, avg(z) AS z FROM r JOIN h USING (stream) GROUP BY ALL""",
    "q73_visual_quality": """SELECT p_partkey, p_size * 4 AS width, p_size * 8 AS height, CAST(p_retailprice - 1000 AS DOUBLE) AS duration_s, p_size * 4 < 64 OR p_size * 8 < 64 AS small_frame,
  p_retailprice - 1000 <= 0 AS no_duration FROM part""",
    "q75_video_versions": """WITH f AS (SELECT DISTINCT 'Clip' || CAST(p_partkey % 97 AS VARCHAR) || ['_480', '_1080', '_HD', '_raw', ''][p_partkey % 5 + 1] AS stem, p_partkey % 10 > 0 AS video FROM part)
SELECT regexp_replace(lower(stem), '_(480|720|960|1080|2k|4k|pre|preview|thumb|hd)$', '') AS base, string_agg(stem || '.mp4', ',' ORDER BY stem || '.mp4') AS names FROM f WHERE video GROUP BY 1 HAVING count(*) > 1""",
    "q76_imu_pairs": """WITH n AS (SELECT DISTINCT 'dev' || CAST(c_custkey % 31 AS VARCHAR) AS dev, ['_accel', '_Accelerometer', '_gyro', '_gyroscope', '_mag'][c_custkey % 5 + 1] AS word FROM customer)
SELECT 'imu_6axis' AS kind, a.dev || a.word || '.csv' AS accel, g.dev || g.word || '.csv' AS gyro FROM n a JOIN n g ON a.dev = g.dev WHERE lower(a.word) LIKE '\\_accel%' ESCAPE '\\' AND g.word LIKE '\\_gyro%' ESCAPE '\\'""",
    "q77_episode_mirrors": """WITH t AS (SELECT DISTINCT 'episode_' || CAST(o_custkey AS VARCHAR) AS stem, ['.csv', '.parquet', '.jsonl'][o_orderkey % 3 + 1] AS fmt, o_orderkey % 2 AS n FROM orders WHERE o_custkey % 4 > 0)
SELECT stem, string_agg(stem || fmt, ',' ORDER BY stem || fmt) AS names FROM t GROUP BY stem, n HAVING count(*) > 1""",
    "q78_frame_times": f"""WITH {E},
c AS (SELECT stream, CASE stream WHEN 'click' THEN NULL WHEN 'view' THEN n ELSE n * CASE WHEN stream < 'm' THEN 2 ELSE 1 END + n // 10 END AS m FROM (SELECT stream, count(*) AS n FROM e GROUP BY stream)),
g AS (SELECT stream, t, count(*) AS k FROM e GROUP BY stream, t),
d AS (SELECT *, lag(t) OVER (PARTITION BY stream ORDER BY t) AS p, t - lag(t) OVER (PARTITION BY stream ORDER BY t) AS d FROM g),
s AS (SELECT stream, median(d) AS step, sum(k) AS n FROM d GROUP BY stream),
r AS (SELECT d.*, step, m, m IS NULL OR m = n AS plain, coalesce(round(d / step), 0) AS moves FROM d JOIN s USING (stream) JOIN c USING (stream)),
a AS (SELECT *, sum(CASE WHEN plain THEN k ELSE moves END) OVER (PARTITION BY stream ORDER BY t) - CASE WHEN plain THEN k ELSE 0 END AS a0 FROM r),
b AS (SELECT *, lead(t) OVER (PARTITION BY stream ORDER BY t) AS t2, lead(a0) OVER (PARTITION BY stream ORDER BY t) AS a2 FROM a WHERE plain OR moves > 0 OR p IS NULL),
z AS (SELECT *, CASE WHEN plain THEN a0 + k ELSE least(coalesce(a2, greatest(a0 + 1, m)), m) END AS z0 FROM b),
f AS (SELECT *, unnest(range(CAST(a0 AS BIGINT), CAST(z0 AS BIGINT))) AS frame FROM z WHERE a0 < z0)
SELECT stream, frame, CASE WHEN plain OR frame = a0 THEN t ELSE t + CAST(round((frame - a0) * coalesce((t2 - t) / (a2 - a0), step)) AS BIGINT) END AS t,
  CASE WHEN plain OR frame = a0 THEN 'row' WHEN t2 IS NOT NULL THEN 'between' ELSE 'after' END AS how FROM f""",
    "q79_media_rates": f"""WITH {E},
v AS (SELECT DISTINCT user_id, CASE WHEN user_id % 7 > 0 THEN CAST(20 + user_id % 10 AS DOUBLE) END AS fps FROM e),
s AS (SELECT user_id, CASE WHEN max(t // 1000000) > min(t // 1000000) THEN (count(*) - 1) / ((max(t // 1000000) - min(t // 1000000)) / 1e9) END AS hz FROM e WHERE event_id % 5 > 0 GROUP BY user_id),
o AS (SELECT user_id, fps, hz, coalesce(abs(hz - fps) > greatest(1.0, 0.1 * fps), false) AS off FROM v LEFT JOIN s USING (user_id))
SELECT user_id, fps, hz AS side_hz, off AS contradicts, CASE WHEN hz IS NOT NULL AND (off OR fps IS NULL) THEN round(hz, 3) ELSE fps END AS rate_hz,
  CASE WHEN hz IS NOT NULL AND (off OR fps IS NULL) THEN 'side list' WHEN fps IS NOT NULL THEN 'header' END AS source FROM o""",
    "q53_quaternion_groups": """WITH n AS (SELECT sqrt(list_sum([CAST(x AS DOUBLE) * x for x in embedding[1:4]])) AS v FROM embeddings)
SELECT 'rot_' AS prefix, avg(v) AS norm_mean, stddev_samp(v) AS norm_std, stddev_samp(v) < 0.01 AND avg(v) > 0.99 AS is_unit FROM n""",
}


def _compare(op: str) -> str:
    value = {"diff": "a.price - b.price", "ratio": "a.price / nullif(b.price, 0)", "distance": "sqrt(pow(a.price - b.price, 2) + pow(a.q - b.q, 2))"}[op]
    bins = ", ".join(f"count(*) FILTER (k = {i})" for i in range(10))
    return f"""WITH a AS (SELECT o_orderkey AS i, o_totalprice AS price, CAST(o_custkey AS DOUBLE) AS q FROM orders),
b AS (SELECT l_orderkey AS i, sum(l_extendedprice) AS price, sum(l_quantity) AS q FROM lineitem GROUP BY 1), v AS (SELECT {value} AS x FROM a JOIN b USING (i)),
s AS (SELECT min(x) AS lo, max(x) AS hi FROM v), k AS (SELECT least(9, floor((x - lo) / ((hi - lo) / 10))) AS k FROM v, s), h AS (SELECT array_to_string([{bins}], ',') AS bins FROM k)
SELECT count(x) AS n, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, median(x) AS median, quantile_cont(x, 0.05) AS p05, quantile_cont(x, 0.95) AS p95, any_value(bins) AS bins,
  (SELECT count(DISTINCT i) FROM a WHERE i NOT IN (SELECT i FROM b)) AS keys_only_a, (SELECT count(DISTINCT i) FROM b WHERE i NOT IN (SELECT i FROM a)) AS keys_only_b FROM v, h"""


ORACLES |= {f"q24_compare_{op}": _compare(op) for op in ("diff", "ratio", "distance")}
ORACLES["q25_compare_duplicate_keys"] = """SELECT l_orderkey AS "index", l_extendedprice AS l_extendedprice_a, l_quantity AS l_quantity_b, l_extendedprice / nullif(l_quantity, 0) AS value FROM lineitem"""
ORACLES["q27_vector_profile"] = """WITH r AS (SELECT vec_id AS i, vec_id % 7 = 3 AS z FROM embeddings), n AS (SELECT count(*) AS n FROM r),
t AS (SELECT i, z, CASE WHEN i < (n % 10) * (n // 10 + 1) THEN i // (n // 10 + 1) ELSE n % 10 + (i - (n % 10) * (n // 10 + 1)) // greatest(1, n // 10) END AS t FROM r, n)
SELECT count(*) AS n, count(*) AS n_vectors, count(*) FILTER (z) AS n_zero, count(*) FILTER (z) / count(*) AS zero_share, 64 AS dims, min(i) FILTER (z) AS first_zero, max(i) FILTER (z) AS last_zero,
  max(i) FILTER (z) - min(i) FILTER (z) + 1 = count(*) FILTER (z) AS zero_contiguous, count(*) FILTER (z AND i < 20) AS zero_in_first_20,
  array_to_string([""" + ", ".join(f"count(*) FILTER (z AND t = {i})" for i in range(10)) + "], ',') AS zero_by_tenth FROM t"
ORACLES["q48_difference_stats"] = """WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), k AS (SELECT least(9, floor((o_totalprice - lo) / ((hi - lo) / 10))) AS k FROM orders, s),
h AS (SELECT array_to_string([""" + ", ".join(f"count(*) FILTER (k = {i})" for i in range(10)) + """], ',') AS bins FROM k)
SELECT count(*) AS n, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, median(o_totalprice) AS median,
  quantile_cont(o_totalprice, 0.05) AS p05, quantile_cont(o_totalprice, 0.95) AS p95, any_value(bins) AS bins FROM orders, h"""
ORACLES["q36_annotation_qc"] = f"""WITH {E}, l AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e),
i AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 86400000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS id FROM l),
r AS (SELECT CAST(user_id AS VARCHAR) AS episode_key, CAST(id AS BIGINT) AS id, min(t) / 1e9 - 1704067200 AS a, max(t) / 1e9 - 1704067200 + CASE WHEN id % 5 = 0 THEN 100000 ELSE 0 END AS b FROM i GROUP BY user_id, id),
w AS (SELECT *, a - lag(b) OVER (PARTITION BY episode_key ORDER BY a, id) AS gap FROM r)
SELECT 'time_overlap' AS rule, 'fail' AS level, episode_key, id, -gap AS value FROM w WHERE gap < -1e-9
UNION ALL SELECT 'time_gap', 'warn', episode_key, id, gap FROM w WHERE gap > 0.1
UNION ALL SELECT 'segment_too_short', 'warn', episode_key, id, b - a FROM w WHERE b - a < 0.5
UNION ALL SELECT 'segment_too_long', 'warn', episode_key, id, b - a FROM w WHERE b - a > 60
UNION ALL SELECT 'source_for_declared_use', 'fail', episode_key, id, CAST(NULL AS DOUBLE) FROM w WHERE id = 2"""

ORACLES["q35_segments"] = f"""WITH RECURSIVE {E},
r AS (SELECT stream, row_number() OVER w - 1 AS i, value AS x, count(*) OVER (PARTITION BY stream) AS n, lag(value) OVER w AS p, lead(value) OVER w AS q FROM e WINDOW w AS (PARTITION BY stream ORDER BY event_id)),
g AS (SELECT stream, quantile_cont(abs(x - p), 0.95) AS g FROM r GROUP BY stream),
v1 AS (SELECT stream, i, n, abs(x - p) / g AS v FROM r JOIN g USING (stream) WHERE i > 0 AND g > 0),
v AS (SELECT * FROM v1 UNION ALL SELECT stream, 0, n, v FROM v1 WHERE i = 1),
a1 AS (SELECT *, sum(v) OVER (PARTITION BY stream ORDER BY i) AS upto, greatest(3, n // 100) // 2 AS h, first_value(v) OVER w AS v0, last_value(v) OVER w AS vn
  FROM v WINDOW w AS (PARTITION BY stream ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
a2 AS (SELECT a.stream, a.i, a.n, (hi.upto - coalesce(lo.upto, 0) + greatest(0, a.h - a.i) * a.v0 + greatest(0, a.i + a.h + 1 - a.n) * a.vn) / (2 * a.h + 1) AS v
  FROM a1 a JOIN a1 hi ON hi.stream = a.stream AND hi.i = least(a.n - 1, a.i + a.h) LEFT JOIN a1 lo ON lo.stream = a.stream AND lo.i = a.i - a.h - 1 WHERE a.n >= 8),
a3 AS (SELECT *, sum(v) OVER (PARTITION BY stream ORDER BY i) AS upto, least(25, greatest(3, n // 50)) AS w FROM a2),
sh AS (SELECT a.stream, a.i, abs((hi.upto - mid.upto) - (mid.upto - coalesce(lo.upto, 0))) / a.w AS y FROM a3 a JOIN a3 hi ON hi.stream = a.stream AND hi.i = a.i + a.w - 1
  JOIN a3 mid ON mid.stream = a.stream AND mid.i = a.i - 1 LEFT JOIN a3 lo ON lo.stream = a.stream AND lo.i = a.i - a.w - 1 WHERE a.i >= a.w AND a.i + a.w <= a.n),
hot AS (SELECT *, i - row_number() OVER (PARTITION BY stream ORDER BY i) AS run FROM (SELECT sh.* FROM sh JOIN (SELECT stream, median(y) AS m FROM sh GROUP BY stream) USING (stream) WHERE m > 0 AND y > 3 * m)),
b1 AS (SELECT stream, arg_min(i, (-y, i)) AS b, 'velocity' AS k FROM hot GROUP BY stream, run),
dd AS (SELECT stream, i, n, abs(p - 2 * x + q) AS a FROM r WHERE p IS NOT NULL AND q IS NOT NULL),
b2 AS (SELECT stream, i + 1 AS b, 'spike' AS k FROM dd JOIN (SELECT stream, quantile_cont(a, 0.25) AS lo, quantile_cont(a, 0.75) AS hi FROM dd GROUP BY stream) USING (stream) WHERE hi > lo AND a > hi + 3 * (hi - lo)),
sl AS (SELECT *, i - row_number() OVER (PARTITION BY stream ORDER BY i) AS run FROM v JOIN (SELECT stream, median(v) AS m, min(v) AS lo FROM v GROUP BY stream) USING (stream) WHERE v < greatest(0.1 * m, lo)),
b3 AS (SELECT stream, max(i) + 1 AS b, 'pause' AS k FROM sl GROUP BY stream, run HAVING count(*) >= greatest(5, floor(any_value(n) * 0.02)) AND max(i) + 1 < any_value(n)),
bk AS (SELECT stream, b, string_agg(DISTINCT k, '+' ORDER BY k) AS k FROM (FROM b1 UNION ALL FROM b2 UNION ALL FROM b3) JOIN (SELECT DISTINCT stream, n FROM r) USING (stream) WHERE b > 0 AND b < n GROUP BY stream, b),
nx AS (SELECT a.stream, a.b, min(z.b) AS nxt FROM bk a LEFT JOIN bk z ON a.stream = z.stream AND z.b >= a.b + 6 GROUP BY ALL),
kp AS (SELECT stream, min(b) AS b FROM bk GROUP BY stream UNION ALL SELECT nx.stream, nx.nxt FROM kp JOIN nx USING (stream, b) WHERE nx.nxt IS NOT NULL),
s1 AS (SELECT *, lead(a, 1, n) OVER (PARTITION BY stream ORDER BY a) - 1 AS z FROM (SELECT DISTINCT stream, n, 0 AS a FROM r UNION ALL SELECT stream, n, b FROM kp JOIN (SELECT DISTINCT stream, n FROM r) USING (stream))),
s2 AS (SELECT s1.*, coalesce(k, 'start') AS ev, z - a + 1 AS size, CAST(ceil(((z + 1) / 50.0 - a / 50.0) / 4.0) AS BIGINT) AS parts FROM s1 LEFT JOIN bk ON bk.stream = s1.stream AND bk.b = s1.a),
ct AS (SELECT *, a + CAST(round_even(size * k / parts, 0) AS BIGINT) AS target, greatest(1, size // (parts * 4)) AS w FROM (SELECT *, unnest(range(1, parts)) AS k FROM s2 WHERE parts > 1 AND size >= parts)),
pl AS (SELECT stream, a, k, unnest(range(greatest(a + 1, target - w), greatest(greatest(a + 1, target - w), least(z, target + w) - 1) + 1)) AS i FROM ct),
cu AS (SELECT DISTINCT stream, a, c FROM (SELECT pl.stream, a, k, arg_min(pl.i, (coalesce(v, 'inf'::DOUBLE), pl.i)) AS c FROM pl LEFT JOIN v ON v.stream = pl.stream AND v.i = pl.i GROUP BY ALL)),
s3 AS (SELECT stream, c AS a, lead(c - 1, 1, z) OVER (PARTITION BY stream, a ORDER BY c) AS z, CASE WHEN c = a THEN ev ELSE 'split' END AS ev
  FROM (SELECT stream, a, z, ev, a AS c FROM s2 UNION ALL SELECT s2.stream, s2.a, z, ev, c FROM s2 JOIN cu USING (stream, a))),
gd AS (SELECT *, CASE WHEN (z + 1) / 50.0 - a / 50.0 >= 0.5 - 1e-9 THEN a END AS good FROM s3),
gr AS (SELECT *, coalesce(min(good) OVER (PARTITION BY stream ORDER BY a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(good) OVER (PARTITION BY stream ORDER BY a), a) AS grp FROM gd),
fin AS (SELECT stream, min(a) AS a, max(z) AS z, coalesce(any_value(ev) FILTER (good IS NOT NULL), arg_min(ev, a)) AS ev FROM gr GROUP BY stream, grp)
SELECT stream, CAST(row_number() OVER (PARTITION BY stream ORDER BY a) AS INTEGER) AS id, a AS start_frame, z AS end_frame, a / 50.0 AS start_s, (z + 1) / 50.0 AS end_s, ev AS evidence FROM fin"""
ORACLES["q54_imu_checks"] = f"""WITH {E},
r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS device, event_id, 9.7 + value / 1e4 AS ax, value / 1e3 AS ay, CASE WHEN user_id % 2 = 0 THEN 0.1 ELSE event_id % 7 / 100 END AS az, 0.001 + value / 1e6 AS gx FROM e),
x AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY device) AS n, CASE WHEN device = 'even' THEN sqrt(ax * ax + ay * ay) ELSE sqrt(ax * ax + ay * ay + az * az) END AS a, abs(gx) AS g FROM r),
b AS (SELECT device, i // 100 AS b, (count(*) = 100 OR any_value(n) < 100) AND count(*) >= 3 AND var_pop(a) / pow(avg(a), 2) < 0.02 AS still FROM x GROUP BY ALL),
s AS (SELECT device, count(*) AS n, CASE WHEN device = 'even' THEN 1 ELSE 0 END AS n_constant, avg(CAST(still AS INTEGER)) AS static_share, median(a) FILTER (still) AS an, median(g) FILTER (still) AS gn, count(*) FILTER (still) AS k
  FROM x JOIN (SELECT device AS bd, b AS bb, still FROM b) ON device = bd AND i // 100 = bb GROUP BY device),
u AS (SELECT *, CASE WHEN an BETWEEN 8.5 AND 11 THEN 'm/s2' WHEN an BETWEEN 0.8 AND 1.2 THEN 'g' WHEN an > 100 THEN 'raw' ELSE 'undetermined' END AS au, CASE WHEN gn < 0.5 THEN 'rad/s' WHEN gn < 100 THEN 'deg/s' ELSE 'undetermined' END AS gu FROM s),
w AS (SELECT *, CASE WHEN n_constant = 0 AND k >= 3 AND au IN ('m/s2', 'g') THEN abs(an - CASE au WHEN 'g' THEN 1 ELSE 9.8 END) / CASE au WHEN 'g' THEN 1 ELSE 9.8 END END AS err, CASE gu WHEN 'rad/s' THEN degrees(gn) WHEN 'deg/s' THEN gn END AS bias FROM u)
SELECT device, n, n_constant, static_share, au AS accel_unit, an AS accel_norm, CAST(err AS DOUBLE) AS gravity_error, gu AS gyro_unit, bias AS gyro_bias_deg_s, CAST(0.0 AS DOUBLE) AS bad_share,
  CASE WHEN coalesce(err > 0.1, false) OR coalesce(bias > 10, false) THEN 'fail' WHEN n_constant > 0 OR static_share < 0.05 THEN 'warn' ELSE 'pass' END AS verdict FROM w"""
ORACLES["q55_running_sum"] = "SELECT event_id, event_type AS stream, value, sum(value) OVER (PARTITION BY event_type ORDER BY event_id) AS total FROM events"
ORACLES["q56_fill"] = """WITH k AS (SELECT event_id, event_type AS stream, CASE WHEN event_id % 5 < 2 THEN value END AS v FROM events)
SELECT event_id, stream, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY stream ORDER BY event_id), first_value(v IGNORE NULLS) OVER (PARTITION BY stream ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM k"""
ORACLES["q57_is_clock"] = """WITH k AS (SELECT event_id, 'steady' AS "column", event_id * 8.33 AS v FROM events UNION ALL SELECT event_id, 'value', value FROM events),
d AS (SELECT "column", v - lag(v) OVER (PARTITION BY "column" ORDER BY event_id) AS d FROM k), m AS (SELECT "column", median(d) AS m, min(d) AS lo FROM d GROUP BY 1),
s AS (SELECT "column", count(*) AS n, any_value(m) AS median_step, avg(CASE WHEN d IS NULL THEN NULL WHEN d <= 1.5 * m THEN 1.0 ELSE 0.0 END) AS regular_share, any_value(lo) >= 0 AS monotone FROM d JOIN m USING ("column") GROUP BY 1)
SELECT *, monotone AND median_step > 0 AND regular_share >= 0.9 AS is_clock FROM s"""

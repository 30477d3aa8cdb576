"""SQL of the direct forecaster: the normal equations as plain sums, solved by elimination."""

from slicewise.operators.direct import INPUTS, OUTPUTS, RIDGE, SPANS
from slicewise.oracle.control import loop_ctes
from slicewise.oracle.core import cte, oracle

Z = ["z_thr", "z_lat", "z_loss"]
RAW = ["thr", "lat_log", "loss"]

cte("dir_scale", "SELECT slice, " + ", ".join(
    f"avg({c}) AS m{k}, CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1.0 END AS s{k}"
    for k, c in enumerate(RAW)) + " FROM li_logs WHERE pos < CAST(floor(series_len * 0.8) AS BIGINT) GROUP BY slice")
cte("dir_z", "SELECT l.*, CAST(floor(series_len * 0.8) AS BIGINT) AS cut, " + ", ".join(
    f"({c} - m{k}) / s{k} AS {z}" for k, (c, z) in enumerate(zip(RAW, Z))) + " FROM li_logs l JOIN dir_scale USING (slice)")
INS = [(z, a, b) for z in Z for a, b in SPANS]
cte("dir_train", "SELECT * FROM (SELECT slice, pos, cut, " + ", ".join(
    [f"avg({z}) OVER (s ROWS BETWEEN {b - 1} PRECEDING AND {a - 1} PRECEDING) AS x{i}" for i, (z, a, b) in enumerate(INS)]
    + [f"lead({z}, {h}) OVER s AS y{k * 15 + h - 1}" for k, z in enumerate(Z) for h in range(1, 16)]) + f""",
       CAST(1 AS DOUBLE) AS x{INPUTS - 1} FROM dir_z WINDOW s AS (PARTITION BY scenario, gnb, slice ORDER BY pos))
WHERE pos >= 59 AND pos - 59 < cut - 75""")
cte("dir_sums", "SELECT slice, " + ", ".join(
    [f"sum(x{i} * x{j}) AS g{i}_{j}" for i in range(INPUTS) for j in range(i, INPUTS)]
    + [f"sum(x{i} * y{o}) AS c{i}_{o}" for i in range(INPUTS) for o in range(OUTPUTS)]) + " FROM dir_train GROUP BY slice")
LAST = f"g{INPUTS - 1}_{INPUTS - 1}"
cte("dir_system", f"SELECT slice, CAST({LAST} AS BIGINT) AS n, unnest(range({INPUTS})) AS i, unnest([" + ", ".join("[" + ", ".join(
    [f"g{min(i, j)}_{max(i, j)}" + (f" + {RIDGE} * {LAST}" if i == j < INPUTS - 1 else "") for j in range(INPUTS)]
    + [f"c{i}_{o}" for o in range(OUTPUTS)]) + "]" for i in range(INPUTS)) + "]) AS r FROM dir_sums")
cte("dir_solved", f"""
WITH RECURSIVE e AS (
  SELECT slice, 0 AS k, i, unnest(range({INPUTS + OUTPUTS})) AS j, unnest(r) AS v FROM dir_system
  UNION ALL
  SELECT slice, k + 1, i, j, CASE WHEN i = k THEN v / pp ELSE v - f * p / pp END
  FROM (SELECT *, max(v) FILTER (i = k) OVER (PARTITION BY slice, j) AS p,
               max(v) FILTER (j = k) OVER (PARTITION BY slice, i) AS f,
               max(v) FILTER (i = k AND j = k) OVER (PARTITION BY slice) AS pp FROM e WHERE k < {INPUTS}))
SELECT slice, i, j - {INPUTS} AS o, v FROM e WHERE k = {INPUTS} AND j >= {INPUTS}""")
oracle("direct_coefficients", f"""
SELECT slice, n AS n_windows, true AS solved, CASE o // 15 WHEN 0 THEN 'thr' WHEN 1 THEN 'lat_log' ELSE 'loss' END AS target,
       o % 15 + 1 AS step, round(max(v) FILTER (i = {INPUTS - 1}), 6) AS constant, round(sum(v), 6) AS w_sum,
       round(sum(v * v), 6) AS w_squares
FROM dir_solved JOIN (SELECT DISTINCT slice, n FROM dir_system) USING (slice) GROUP BY slice, n, o""")
cte("dir_inputs", "SELECT scenario, gnb, slice, t, [" + ", ".join(
    f"avg({z}) FILTER (t - pos BETWEEN {a} AND {b})" for z, a, b in INS) + """, 1.0] AS x
FROM dir_z JOIN li_windows USING (scenario, gnb) WHERE pos >= t - 60 AND pos < t GROUP BY ALL""")
cte("dir_out", """
SELECT scenario, gnb, slice, t, o, sum(x * v) AS z
FROM (SELECT scenario, gnb, slice, t, unnest(range(len(x))) AS i, unnest(x) AS x FROM dir_inputs)
JOIN dir_solved USING (slice, i) GROUP BY ALL""")
cte("dir_steps", """
SELECT scenario, gnb, slice, t, o % 15 AS h, max(z) FILTER (o // 15 = 0) * max(s0) + max(m0) AS thr_pred,
       exp(max(z) FILTER (o // 15 = 1) * max(s1) + max(m1)) - 1 AS lat_pred,
       max(z) FILTER (o // 15 = 2) * max(s2) + max(m2) AS loss_pred
FROM dir_out JOIN dir_scale USING (slice) GROUP BY scenario, gnb, slice, t, o % 15""")
oracle("forecast_direct", """
SELECT scenario, gnb, slice, t, h + 1 AS step, round(thr_pred, 4) AS thr_pred, round(lat_pred, 3) AS lat_pred,
       round(loss_pred, 4) AS loss_pred FROM dir_steps""")
loop_ctes("directed", "", """
SELECT *, round(CASE WHEN p_pred >= 0.99 THEN CAST(2 AS DOUBLE)
    WHEN p_pred > 0.01 THEN least(greatest(curve_rho - ln(1.0 / p_pred - 1) / curve_k, 0.01), 3)
    ELSE least(greatest(greatest(thr_ahead, 0) / greatest(capacity, 1e-6), 0.01), 3) END, 9) AS rho
FROM (SELECT scenario, gnb, slice, t, round(max(s.p_real), 9) AS p_real, avg(thr_pred) AS thr_ahead,
             avg(CASE WHEN lat_pred > d.control_lat_max THEN 1.0 ELSE 0.0 END) AS p_pred
      FROM dir_steps JOIN facts d USING (gnb, slice) JOIN li_seen s USING (scenario, gnb, slice, t)
      GROUP BY scenario, gnb, slice, t) JOIN facts USING (gnb, slice)""")
oracle("closed_loop_direct", "SELECT * FROM directed_wide")
oracle("forecast_direct_load", """
SELECT scenario, gnb, slice, t, round(rho, 6) AS rho, round(p_pred, 6) AS p_pred, round(p_real, 6) AS p_real
FROM directed_loads""")
cte("dir_scores", """
SELECT scenario, gnb, slice, t, avg(abs(lat_pred - t_lat)) AS e_lat, avg(abs(p_loss - t_loss)) AS e_loss,
       avg(abs(thr_pred - thr)) AS e_thr,
       round(avg(lat_pred), 9) > max(lat_max) OR round(avg(p_loss), 9) > max(loss_max) AS p_viol,
       round(avg(t_lat), 9) > max(lat_max) OR round(avg(t_loss), 9) > max(loss_max) AS t_viol
FROM (SELECT scenario, gnb, slice, t, thr, thr_pred, lat_pred, least(greatest(loss_pred, 0), 100) AS p_loss,
             exp(lat_log) - 1 AS t_lat, least(greatest(loss, 0), 100) AS t_loss
      FROM dir_steps JOIN li_logs l USING (scenario, gnb, slice) WHERE l.pos = t + h)
JOIN (SELECT * FROM dim_limits WHERE profile = 'detect') USING (slice) GROUP BY ALL""")
oracle("forecast_direct_metrics", """
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
       round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 6) AS specificity
FROM (SELECT slice, gnb, round(avg(e_lat), 5) AS mae_lat_ms, round(avg(e_loss), 5) AS mae_loss_pct,
             round(avg(e_thr), 5) AS mae_thr_mbps, count(*) FILTER (p_viol AND t_viol) AS tp,
             count(*) FILTER (NOT p_viol AND NOT t_viol) AS tn,
             count(*) FILTER (p_viol AND NOT t_viol) AS fp, count(*) FILTER (NOT p_viol AND t_viol) AS fn,
             round(avg(CASE WHEN t_viol THEN 1.0 ELSE 0.0 END), 6) AS viol_rate
      FROM dir_scores GROUP BY slice, gnb)
JOIN (SELECT slice, gnb, round(avg(e_lat), 5) AS trend_mae_lat, round(avg(e_loss), 5) AS trend_mae_loss,
             round(avg(e_thr), 5) AS trend_mae_thr FROM li_scores GROUP BY slice, gnb) USING (slice, gnb)""")

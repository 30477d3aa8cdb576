"""SQL of the load, cost, allocation, forecast and closed-loop queries. Allocation is stated
as the full join of the cost rows, independent of the fold used by the engine."""

from slicewise.oracle.core import cte, oracle

SLICES = ("eMBB", "URLLC", "mMTC")
LOGISTIC = "(1.0 / (1.0 + exp(-curve_k * ({x} - curve_rho))))"


def p_of(n: str) -> str:
    return LOGISTIC.format(x=f"rho * units_default / {n}")


COST = f"""round(0.6 * CASE WHEN rho * units_default * unit_rate >= thr_min
    THEN greatest(1 - least(rho * units_default * unit_rate, n * unit_rate) * (1.0 - {p_of('n')}) / thr_min, 0)
    ELSE 0 END + 0.4 * {p_of('n')}, 9)"""
LIVE_COST = f"""round(0.6 * (greatest(thr_min - least(rho * units_default * unit_rate, n * unit_rate), 0)
    / greatest(thr_min, 1e-9)) + 0.4 * priority * {p_of('n')}, 9)"""
RHO = """CASE WHEN fraction_lost >= 0.99 THEN CAST(2 AS DOUBLE)
    WHEN fraction_lost > 0.01 THEN least(throughput_mean / greatest(capacity * (1.0 - fraction_lost), 1e-6), 3)
    ELSE throughput_mean / greatest(capacity, 1e-6) END"""

cte("facts", """
SELECT u.*, l.thr_min, l.lat_max AS control_lat_max, s.slice_rank, s.priority
FROM dim_units u JOIN (SELECT * FROM dim_limits WHERE profile = 'control') l USING (slice)
JOIN dim_slices s USING (slice)""")

oracle("dim_capacity", """
SELECT gnb, slice, n_rows, CAST(units_default AS BIGINT) AS units_default, CAST(budget AS BIGINT) AS budget,
       unit_rate, round(capacity, 6) AS capacity,
       sum(units_default) OVER (PARTITION BY gnb) = budget AS budget_met
FROM dim_units JOIN (SELECT gnb, slice, count(*) AS n_rows FROM kpi_rows GROUP BY ALL) USING (gnb, slice)""")


def load_cte(name: str, ticks: int) -> None:
    cte(name, f"""
SELECT *, {RHO} AS rho FROM (
  SELECT scenario || '-' || (tick // {ticks}) AS scenario, gnb, slice,
         round(avg(CASE WHEN lat > CASE WHEN slice = 'mMTC' THEN 300 ELSE lat_max END THEN 1.0 ELSE 0.0 END), 9) AS fraction_lost,
         round(avg(thr), 9) AS throughput_mean
  FROM kpi_rows GROUP BY 1, 2, 3) JOIN (SELECT gnb, slice, capacity FROM dim_units) USING (gnb, slice)""")


load_cte("loads_block", 15)
load_cte("loads_tick", 1)
oracle("load_points", """
SELECT scenario, gnb, slice, round(fraction_lost, 6) AS fraction_lost,
       round(throughput_mean, 6) AS throughput_mean, round(capacity, 6) AS capacity,
       round(rho, 6) AS rho, round(rho * capacity, 6) AS offered FROM loads_block""")


def curve_ctes(prefix: str, points: str) -> None:
    def best(src: str) -> str:
        return f"""
SELECT gnb, slice, ki, ri, ki / 200 AS curve_k, ri / 2000 AS curve_rho, sse, n_points FROM (
  SELECT gnb, slice, ki, ri, round(sum((1.0 / (1.0 + exp(-(ki / 200) * (rho - ri / 2000))) - p) ** 2), 9) AS sse,
         max(n_points) AS n_points
  FROM ({src}) WHERE ki BETWEEN 100 AND 10000 AND ri BETWEEN 100 AND 6000 GROUP BY gnb, slice, ki, ri)
QUALIFY row_number() OVER (PARTITION BY gnb, slice ORDER BY sse, ki, ri) = 1"""

    cte(f"{prefix}_pts", f"""
SELECT *, count(DISTINCT (rho, p)) OVER (PARTITION BY gnb, slice) AS n_points
FROM (SELECT gnb, slice, round(rho, 9) AS rho, fraction_lost AS p FROM {points})""")
    cte(f"{prefix}_g1", best(f"""SELECT p.*, (i // 60 + 1) * 100 AS ki, (i % 60 + 1) * 100 AS ri
        FROM {prefix}_pts p, range(6000) t(i)"""))
    for g, step in ((2, 10), (3, 1)):
        cte(f"{prefix}_g{g}", best(f"""
        SELECT p.*, b.ki + (i // 21 - 10) * {step} AS ki, b.ri + (i % 21 - 10) * {step} AS ri
        FROM {prefix}_pts p JOIN (SELECT gnb, slice, ki, ri FROM {prefix}_g{g - 1}) b USING (gnb, slice),
             range(441) t(i)"""))
    cte(f"{prefix}_curve", f"""
SELECT gnb, slice, CASE WHEN n_points >= 2 THEN curve_k ELSE CAST(5 AS DOUBLE) END AS curve_k,
       CASE WHEN n_points >= 2 THEN curve_rho ELSE CAST(1 AS DOUBLE) END AS curve_rho, sse
FROM {prefix}_g3""")


curve_ctes("block", "loads_block")
oracle("calibrate_loss_curve", """
SELECT gnb, slice, curve_k, curve_rho, round(sse, 6) AS sse FROM block_curve""")

cte("cost_block", f"""
SELECT scenario, gnb, slice, n, {COST} AS cost, {LIVE_COST} AS live_cost, units_floor
FROM loads_block JOIN (SELECT * EXCLUDE (capacity) FROM facts) USING (gnb, slice), range(1, 51) t(n) WHERE n <= budget""")
oracle("cost_table", "SELECT scenario, gnb, slice, n, round(cost, 6) AS cost FROM cost_block")
oracle("cost_table_live", """
SELECT scenario, gnb, slice, n, round(live_cost, 6) AS cost FROM cost_block WHERE n >= units_floor""")


def grid(loads: str) -> str:
    return f"""
SELECT k.scenario, f.*, l.rho FROM (SELECT DISTINCT scenario FROM {loads}) k CROSS JOIN facts f
LEFT JOIN {loads} l ON l.scenario = k.scenario AND l.gnb = f.gnb AND l.slice = f.slice"""


oracle("cost_default_fill", f"""
SELECT scenario, gnb, slice, count(*) AS n_counts, bool_or(rho IS NULL) AS filled,
       round(sum(coalesce({COST}, 1.0)), 5) AS cost_sum, round(min(coalesce({COST}, 1.0)), 6) AS cost_min
FROM ({grid('loads_tick')}), range(1, 51) t(n) WHERE n <= budget GROUP BY scenario, gnb, slice""")
cte("grid_block", f"""
SELECT scenario, gnb, slice, slice_rank, n, budget, units_default, units_floor,
       coalesce({COST}, 1.0) AS cost,
       {LIVE_COST.replace('rho * ', 'coalesce(rho, 0.1) * ')} AS live_cost
FROM ({grid('loads_block')}), range(1, 51) t(n) WHERE n <= budget""")
oracle("objective_default", """
SELECT scenario, gnb, round(sum(cost), 6) AS F_default FROM grid_block WHERE n = units_default GROUP BY ALL""")


def best_split(costs: str, keys: str, where: str, cost: str = "cost") -> str:
    on = " AND ".join(f"a.{k} = x.{k}" for k in keys.split(", "))
    return f"""
SELECT {', '.join('a.' + k for k in keys.split(', '))}, a.n AS n1, b.n AS n2, c.n AS n3,
       round(a.{cost} + b.{cost} + c.{cost}, 9) AS total
FROM (SELECT * FROM {costs} WHERE slice = 'eMBB') a
JOIN (SELECT * FROM {costs} WHERE slice = 'URLLC') b ON {on.replace('x.', 'b.')}
JOIN (SELECT * FROM {costs} WHERE slice = 'mMTC') c ON {on.replace('x.', 'c.')} AND {where}
QUALIFY row_number() OVER (PARTITION BY {', '.join('a.' + k for k in keys.split(', '))}
                           ORDER BY total, n1, n2, n3) = 1"""


cte("alloc_block", best_split("grid_block", "scenario, gnb", "c.n = a.budget - a.n - b.n"))
cte("alloc_report", """
SELECT scenario, gnb, round(d, 4) AS F_default, round(total, 4) AS F_optimal,
       round((d - total) / greatest(d, 1e-9) * 100, 1) AS gain_pct,
       n1 AS R_eMBB_opt, n2 AS R_URLLC_opt, n3 AS R_mMTC_opt,
       d1 AS R_eMBB_def, d2 AS R_URLLC_def, d3 AS R_mMTC_def
FROM alloc_block JOIN (
  SELECT scenario, gnb, round(sum(cost), 9) AS d,
         CAST(max(CASE WHEN slice = 'eMBB' THEN n END) AS BIGINT) AS d1,
         CAST(max(CASE WHEN slice = 'URLLC' THEN n END) AS BIGINT) AS d2,
         CAST(max(CASE WHEN slice = 'mMTC' THEN n END) AS BIGINT) AS d3
  FROM grid_block WHERE n = units_default GROUP BY ALL) USING (scenario, gnb)""")
oracle("allocate_exact", "SELECT * FROM alloc_report")
oracle("allocate_fold", "SELECT * FROM alloc_report")
oracle("allocation_vs_default", " UNION ALL ".join(
    f"SELECT scenario, gnb, '{s}' AS slice, R_{s}_opt AS units_opt, R_{s}_def AS units_def, "
    f"R_{s}_opt - R_{s}_def AS change FROM alloc_report" for s in SLICES))
cte("alloc_live", best_split(
    "grid_block", "scenario, gnb", "a.n >= a.units_floor AND b.n >= b.units_floor "
    "AND c.n >= c.units_floor AND a.n + b.n + c.n <= a.budget", "live_cost"))
oracle("allocate_priority", " UNION ALL ".join(
    f"SELECT scenario, gnb, '{s}' AS slice, n{i} AS units FROM alloc_live"
    for i, s in enumerate(SLICES, 1)))

oracle("forecast_trend", """
SELECT scenario, gnb, slice, pos, step, round(m_thr + s_thr * (step - 1 + 30.5), 4) AS thr_pred,
       round(exp(m_lat + s_lat * (step - 1 + 30.5)) - 1, 3) AS lat_pred,
       round(m_loss + s_loss * (step - 1 + 30.5), 4) AS loss_pred
FROM (SELECT *, """ + ", ".join(
    f"round(avg({c}) OVER w, 9) AS m_{a}, round(regr_slope({c}, pos) OVER w, 9) AS s_{a}"
    for a, c in (("thr", "thr"), ("lat", "lat_log"), ("loss", "loss"))) + """
      FROM kpi_logs WINDOW w AS (PARTITION BY scenario, gnb, slice ORDER BY pos
                                 ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)), range(1, 16) t(step)
WHERE pos >= 59""")

cte("li_logs", "SELECT *, ln(1 + least(greatest(lat, 0), 600000)) AS lat_log FROM li_pos")
cte("li_fits", "SELECT scenario, gnb, slice, t, " + ", ".join(
    f"round(avg({c}), 9) AS m_{a}, round(regr_slope({c}, pos - t), 9) AS s_{a}"
    for a, c in (("thr", "thr"), ("lat", "lat_log"), ("loss", "loss"))) + """
FROM li_logs JOIN li_windows USING (scenario, gnb) WHERE pos >= t - 60 AND pos < t GROUP BY ALL""")
LAT_AHEAD = "exp(m_lat + s_lat * (h + 30.5)) - 1"


def loop_ctes(prefix: str, curve: str, loads: str = "") -> None:
    cte(f"{prefix}_loads", loads or f"""
SELECT *, round(CASE WHEN p_pred >= 0.99 THEN CAST(2 AS DOUBLE)
    WHEN p_pred > 0.01 THEN least(greatest(curve_rho - ln(1.0 / p_pred - 1) / curve_k, 0.01), 3)
    ELSE least(greatest(greatest(m_thr + s_thr * 37.5, 0) / greatest(capacity, 1e-6), 0.01), 3) END, 9) AS rho
FROM (SELECT f.*, d.* EXCLUDE (gnb, slice{', curve_k, curve_rho' if curve else ''}), {'c.curve_k, c.curve_rho, ' if curve else ''}
             round(s.p_real, 9) AS p_real,
             len(list_filter(range(15), lambda h: {LAT_AHEAD} > control_lat_max)) / 15 AS p_pred,
             list_sum(list_transform(range(15), lambda h: {LAT_AHEAD})) / 15 AS lat_pred
      FROM li_fits f JOIN facts d USING (gnb, slice) JOIN li_seen s USING (scenario, gnb, slice, t)
      {f'JOIN {curve} c USING (gnb, slice)' if curve else ''})""")
    cte(f"{prefix}_costs", f"""
SELECT scenario, gnb, t, slice, n, budget, units_default, {COST} AS cost
FROM {prefix}_loads, range(1, 51) r(n) WHERE n <= budget""")
    cte(f"{prefix}_split", best_split(f"{prefix}_costs", "scenario, gnb, t",
                                      "c.n = a.budget - a.n - b.n"))
    per = ", ".join(
        f"round(max(CASE WHEN slice = '{s}' THEN {e} END), 4) AS {n}_{s}"
        for s, u in zip(SLICES, ("n1", "n2", "n3"))
        for n, e in (("rho", "rho"), ("p_pred", "p_pred"), ("p_real", "p_real"),
                     ("p_sla_opt", p_of(f"greatest({u}, 1)"))))
    cte(f"{prefix}_wide", f"""
SELECT scenario, gnb, t, round(d, 4) AS F_default, round(total, 4) AS F_optimal,
       round((d - total) / greatest(d, 1e-9) * 100, 1) AS gain_pct,
       n1 AS R_eMBB_opt, n2 AS R_URLLC_opt, n3 AS R_mMTC_opt, w.* EXCLUDE (scenario, gnb, t)
FROM {prefix}_split JOIN (
  SELECT scenario, gnb, t, round(sum(cost), 9) AS d FROM {prefix}_costs WHERE n = units_default GROUP BY ALL)
  USING (scenario, gnb, t)
JOIN (SELECT scenario, gnb, t, {per}, round(sum(abs(p_pred - p_real)) / 3, 4) AS mae_pred
      FROM {prefix}_loads JOIN {prefix}_split USING (scenario, gnb, t) GROUP BY scenario, gnb, t) w
  USING (scenario, gnb, t)""")
    cte(f"{prefix}_long", " UNION ALL ".join(
        f"SELECT scenario, gnb, t, '{s}' AS slice, rho_{s} AS rho, p_pred_{s} AS p_pred, "
        f"p_real_{s} AS p_real, p_sla_opt_{s} AS p_sla_opt FROM {prefix}_wide" for s in SLICES))


loop_ctes("loop", "")
oracle("forecast_load", """
SELECT scenario, gnb, slice, t, round(rho, 6) AS rho, round(p_pred, 6) AS p_pred,
       round(lat_pred, 4) AS lat_pred FROM loop_loads""")
oracle("pred_vs_real", """
SELECT scenario, gnb, slice, t, round(p_pred, 6) AS p_pred, round(p_real, 6) AS p_real,
       round(abs(round(p_pred, 6) - round(p_real, 6)), 6) AS abs_error FROM loop_loads""")
oracle("closed_loop", "SELECT * FROM loop_wide")
oracle("post_alloc_violation", """
SELECT scenario, gnb, t, slice, rho, p_sla_opt, p_real FROM loop_long""")
cte("li_blocks", f"""
SELECT *, {RHO} AS rho FROM (
  SELECT gnb, slice, scenario, pos // 15 AS block,
         round(avg(CASE WHEN lat > CASE WHEN slice = 'mMTC' THEN 300 ELSE lat_max END THEN 1.0 ELSE 0.0 END), 9) AS fraction_lost,
         round(avg(thr), 9) AS throughput_mean
  FROM li_pos JOIN (SELECT slice, lat_max FROM dim_limits WHERE profile = 'detect') USING (slice)
  GROUP BY 1, 2, 3, 4) JOIN (SELECT gnb, slice, capacity FROM dim_units) USING (gnb, slice)""")
curve_ctes("long", "li_blocks")
loop_ctes("fitted", "long_curve")
oracle("closed_loop_calibrated", "SELECT * FROM fitted_wide")


def reduction(online: bool, loop: str = "loop") -> str:
    some = "true" if online else "d >= 0.1"
    red = "(d - o) / greatest(d, 1e-6) * 100" if online else "CASE WHEN d >= 0.1 THEN (d - o) / d * 100 END"
    return f"""
SELECT gnb, slice, round(d, 2) AS viol_static_pct, round(o, 2) AS viol_opt_pct,
       round({red}, 1) AS reduction_pct,
       CASE WHEN {some} THEN round(wd, 1) ELSE 0.0 END AS win_viol_static_pct,
       CASE WHEN {some} THEN round(wo, 1) ELSE 0.0 END AS win_viol_opt_pct
FROM (SELECT gnb, slice, avg(p_real) * 100 AS d, avg(p_sla_opt) * 100 AS o,
             avg(CASE WHEN p_real > 0 THEN 1.0 ELSE 0.0 END) * 100 AS wd,
             avg(CASE WHEN p_sla_opt > 0.05 THEN 1.0 ELSE 0.0 END) * 100 AS wo
      FROM {loop}_long GROUP BY gnb, slice)"""


oracle("sla_reduction", reduction(False))
oracle("sla_reduction_rollup", " UNION ALL ".join(f"""
SELECT slice, gnb, round(avg(viol_static_pct), 4) AS viol_static_pct,
       round(avg(viol_opt_pct), 4) AS viol_opt_pct, round(avg(reduction_pct), 4) AS reduction_pct,
       {str(o).lower()} AS online
FROM ({reduction(o)}) {'' if o else "WHERE slice <> 'mMTC'"}
GROUP BY GROUPING SETS ((slice), (gnb))""" for o in (False, True)))

cte("li_scores", f"""
SELECT scenario, gnb, slice, t, avg(abs(p_lat - t_lat)) AS e_lat, avg(abs(p_loss - t_loss)) AS e_loss,
       avg(abs(p_thr - thr)) AS e_thr,
       round(avg(p_lat), 9) > max(lat_max) OR round(avg(p_loss), 9) > max(loss_max) AS p_viol,
       round(avg(t_lat), 9) > max(lat_max) OR round(avg(t_loss), 9) > max(loss_max) AS t_viol
FROM (SELECT scenario, gnb, slice, t, thr, m_thr + s_thr * (h + 30.5) AS p_thr, {LAT_AHEAD} AS p_lat,
             least(greatest(m_loss + s_loss * (h + 30.5), 0), 100) AS p_loss, lat AS t_lat,
             least(greatest(loss, 0), 100) AS t_loss
      FROM (SELECT *, pos - t AS h FROM li_logs JOIN li_fits USING (scenario, gnb, slice)
            WHERE pos >= t AND pos < t + 15))
JOIN (SELECT * FROM dim_limits WHERE profile = 'detect') USING (slice) GROUP BY ALL""")
cte("li_metrics", """
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1,
       round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 6) AS specificity
FROM (SELECT slice, gnb, round(avg(e_lat), 5) AS mae_lat_ms, round(avg(e_loss), 5) AS mae_loss_pct,
             round(avg(e_thr), 5) AS mae_thr_mbps, count(*) FILTER (p_viol AND t_viol) AS tp,
             count(*) FILTER (NOT p_viol AND NOT t_viol) AS tn,
             count(*) FILTER (p_viol AND NOT t_viol) AS fp, count(*) FILTER (NOT p_viol AND t_viol) AS fn,
             round(avg(CASE WHEN t_viol THEN 1.0 ELSE 0.0 END), 6) AS viol_rate
      FROM li_scores GROUP BY slice, gnb)""")
oracle("forecast_metrics", "SELECT * FROM li_metrics")
oracle("prediction_quality", """
SELECT slice, n, CASE WHEN n > 10 AND sd > 0 AND NOT isnan(r) THEN round(r, 6) END AS r,
       CASE WHEN n > 10 AND sd > 0 THEN round(mae, 6) END AS mae
FROM (SELECT slice, count(*) AS n, corr(p_real, p_pred) AS r, avg(abs(p_pred - p_real)) AS mae,
             stddev_pop(p_real) AS sd FROM loop_long GROUP BY slice)""")
oracle("describe_load", """
SELECT s AS slice, 'rho' AS measure, count(rho) AS n, round(avg(rho), 6) AS mean,
       round(stddev_samp(rho), 6) AS std, min(rho) AS min, max(rho) AS max,
       round(quantile_cont(rho, 0.25), 6) AS q25, round(quantile_cont(rho, 0.5), 6) AS q50,
       round(quantile_cont(rho, 0.75), 6) AS q75
FROM loads_block, unnest([slice, '*']) u(s) GROUP BY s""")
oracle("load_by_scenario", "SELECT scenario, " + ", ".join(
    f"round(avg(rho_{s}), 6) AS \"{s}\"" for s in SLICES) + " FROM loop_wide GROUP BY scenario")
oracle("reduction_matrix", "SELECT slice, " + ", ".join(
    f"max(CASE WHEN gnb = '{g}' THEN reduction_pct END) AS \"{g}\""
    for g in ("Macro", "Commerce", "Industrie")) + f" FROM ({reduction(False)}) GROUP BY slice")

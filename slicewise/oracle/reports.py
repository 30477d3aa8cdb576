"""SQL of the mode comparison, loop reports and generated scenarios."""

from slicewise import dims
from slicewise.operators.scenario import TRANSITIONS
from slicewise.oracle.core import _values, cte, oracle

cte("mode_kpis_all", """
SELECT run AS mode, slice, round(avg(lat), 6) AS mean_lat_ms, round(avg(thr), 6) AS mean_thr_mbps,
       round(avg(CASE WHEN lat > l.lat_max OR loss > l.loss_max THEN 1.0 ELSE 0.0 END) * 100, 6) AS viol_rate_pct,
       count(*) AS n_windows, round(quantile_cont(lat, 0.95), 6) AS p95_lat_ms
FROM mode_rows r JOIN (SELECT slice, lat_max, loss_max FROM dim_limits WHERE profile = 'control') l USING (slice)
GROUP BY run, slice""")
oracle("mode_kpis", "SELECT * FROM mode_kpis_all")
oracle("mode_gain", """
SELECT m.mode, m.slice, round(b.viol_rate_pct - m.viol_rate_pct, 6) AS gain_viol_pp,
       round(b.mean_lat_ms - m.mean_lat_ms, 6) AS gain_lat_ms
FROM mode_kpis_all m JOIN mode_kpis_all b USING (slice)
WHERE b.mode = 'baseline' AND m.mode <> 'baseline'""")
oracle("cumulative_violation", """
SELECT run AS mode, slice, tick, scenario, gnb,
       round(avg(CASE WHEN lat > l.lat_max THEN 1.0 ELSE 0.0 END) OVER (
         PARTITION BY run, slice ORDER BY tick, scenario, gnb
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100, 6) AS cum_viol_pct
FROM mode_rows r JOIN (SELECT slice, lat_max FROM dim_limits WHERE profile = 'control') l USING (slice)""")

oracle("gain_by_group", """
SELECT level, name, count(*) AS n, round(avg(gain_pct), 5) AS mean_gain,
       count(*) FILTER (F_optimal < 0.1) AS n_below_0_1, round(median(gain_pct), 5) AS median_gain
FROM (SELECT 'all' AS level, '*' AS name, gain_pct, F_optimal FROM alloc_report
      UNION ALL SELECT 'gnb', gnb, gain_pct, F_optimal FROM alloc_report
      UNION ALL SELECT 'scenario', scenario, gain_pct, F_optimal FROM alloc_report) GROUP BY level, name""")
oracle("nearly_free_cells", """
SELECT scenario, gnb, F_default, F_optimal, gain_pct FROM alloc_report WHERE F_optimal < 0.1""")
oracle("top_scenarios", """
SELECT scenario, round(avg(gain_pct), 5) AS mean_gain FROM alloc_report GROUP BY scenario
ORDER BY mean_gain DESC, scenario LIMIT 10""")
oracle("ordered_gain_matrix", "SELECT scenario_name AS scenario, position, " + ", ".join(
    f"round(avg(CASE WHEN gnb = '{g}' THEN {c} END), 5) AS \"{g}_{n}\"" for g in dims.CELLS
    for n, c in (("gain", "gain_pct"), ("f_opt", "F_optimal"))) + """
FROM alloc_report JOIN (SELECT scenario_name, CAST(position AS BIGINT) AS position FROM scenario_list)
  ON position = CAST(substr(scenario, 2, 1) AS INT) * 8 + CAST(split_part(scenario, '-', 2) AS INT)
GROUP BY scenario_name, position""")
oracle("score_recommendations", """
SELECT *, CASE WHEN mean_f1 >= 0.65 THEN 'OK' WHEN mean_f1 >= 0.5 THEN 'ATTENTION' ELSE 'CRITIQUE' END AS verdict,
       CASE WHEN worst_gnb = 'Commerce' AND gap_gnb > 0.2 THEN 'COMMERCE'
            WHEN worst_gnb = 'Commerce' AND gap_gnb > 0.1 THEN 'INFO' END AS cell_code,
       CASE WHEN gap_slice > 0.2 AND worst_slice_f1 < 0.6 THEN 'SLICE' END AS slice_code,
       CASE WHEN mean_recall < 0.45 AND mean_f1 < 0.75 THEN 'RECALL'
            WHEN mean_precision < 0.45 AND mean_f1 < 0.75 THEN 'PRECISION' END AS balance_code
FROM (SELECT round(avg(f1), 6) AS mean_f1, round(avg(precision), 6) AS mean_precision,
             round(avg(recall), 6) AS mean_recall FROM li_metrics),
     (SELECT gnb AS worst_gnb, f AS worst_gnb_f1, round(max(f) OVER () - f, 6) AS gap_gnb
      FROM (SELECT gnb, round(avg(f1), 6) AS f FROM li_metrics GROUP BY gnb)
      QUALIFY row_number() OVER (ORDER BY f, gnb) = 1),
     (SELECT slice AS worst_slice, f AS worst_slice_f1, round(max(f) OVER () - f, 6) AS gap_slice
      FROM (SELECT slice, round(avg(f1), 6) AS f FROM li_metrics GROUP BY slice)
      QUALIFY row_number() OVER (ORDER BY f, slice) = 1)""")

oracle("zip_series", """
SELECT a.slice, a.gnb, a.pos, least(a.series_len, b.series_len) AS common_len, a.lat AS low_lat,
       b.lat AS high_lat, a.loss AS low_loss, b.loss AS high_loss
FROM kpi_pos a JOIN kpi_pos b ON a.scenario = 'S0' AND b.scenario = 'S1' AND a.slice = b.slice
  AND a.gnb = b.gnb AND a.pos = b.pos""")
_names = {"NormalLoad": "S0", "LowTrafficNight": "S0", "GlobalSaturation": "S1", "ModerateLoad_eMBB": "S1"}
cte("transitions", f"""
SELECT * FROM (VALUES {_values([(n, s, _names[a], _names[b], f, t) for n, s, a, b, f, t in TRANSITIONS])})
  AS t(name, slice, low, high, from_share, to_share)""")


def blended(name: str, weight: str) -> None:
    mixed = {c: f"(1 - w) * low_{c} + w * high_{c}" for c in ("thr", "lat", "jit", "loss", "load")}
    top = {"loss": "100", "load": "100", "lat": "600000", "thr": "1e300", "jit": "1e300"}
    cte(name, f"""
SELECT *, bool_and(sla_ok) OVER (PARTITION BY scenario, gnb, slice ORDER BY pos
                                 ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS ok_ahead
FROM (SELECT scenario, gnb, slice, pos, thr, lat, jit, loss, load,
             lat <= lat_max AND loss <= loss_max AS sla_ok
  FROM (SELECT scenario, gnb, slice, pos, {', '.join(f"least(greatest({m}, 0), {top[c]}) AS {c}" for c, m in mixed.items())}
    FROM (SELECT *, {weight} AS w
      FROM (SELECT s.name AS scenario, a.gnb, a.slice, a.pos, least(a.series_len, b.series_len) AS n,
                   CAST(floor(least(a.series_len, b.series_len) * from_share) AS BIGINT) AS ts,
                   CAST(floor(least(a.series_len, b.series_len) * to_share) AS BIGINT) AS te,
                   {', '.join(f"a.{c} AS low_{c}, b.{c} AS high_{c}" for c in mixed)}
            FROM transitions s JOIN kpi_pos a ON a.slice = s.slice AND a.scenario = s.low
            JOIN kpi_pos b ON b.slice = s.slice AND b.scenario = s.high AND b.gnb = a.gnb AND b.pos = a.pos)))
  JOIN (SELECT slice, lat_max, loss_max FROM dim_limits WHERE profile = 'detect') USING (slice))""")


blended("made_linear", """CASE WHEN pos < ts THEN 0.0 WHEN pos >= te THEN 1.0
    ELSE (pos - ts) / greatest(te - ts - 1, 1) END""")
blended("made_logistic", "1.0 / (1.0 + exp(-(pos - n / 2.0) / 180.0))")
for _q, _t in (("scenario_linear", "made_linear"), ("scenario_sigmoid", "made_logistic")):
    oracle(_q, f"""
SELECT scenario, gnb, slice, pos, round(thr, 6) AS thr, round(lat, 6) AS lat, round(jit, 6) AS jit,
       round(loss, 6) AS loss, round(load, 6) AS load, sla_ok, ok_ahead,
       CAST(CASE WHEN ok_ahead THEN 0 ELSE 1 END AS INTEGER) AS violated_ahead FROM {_t}""")
oracle("scenario_violation_rate", """
SELECT scenario, slice, count(*) AS n_rows,
       round(avg(CASE WHEN sla_ok THEN 0.0 ELSE 1.0 END) * 100, 1) AS viol_rate_pct
FROM made_linear GROUP BY scenario, slice""")
oracle("combined_dataset", """
SELECT scenario, slice, count(*) AS n_rows, count(DISTINCT gnb) AS n_cells, round(avg(lat), 5) AS mean_lat,
       round(avg(CASE WHEN sla_ok THEN 0.0 ELSE 1.0 END) * 100, 5) AS violation_pct,
       count(*) FILTER (NOT ok_ahead) AS n_violated_ahead, count(src) AS n_original
FROM (SELECT scenario, slice, gnb, lat, sla_ok, ok_ahead, lat_source AS src FROM kpi_rows
      UNION ALL SELECT scenario, slice, gnb, lat, sla_ok, ok_ahead, NULL FROM made_linear)
GROUP BY scenario, slice""")

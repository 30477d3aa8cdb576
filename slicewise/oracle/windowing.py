"""SQL of the feature, label and window queries."""

from slicewise.oracle.core import cte, oracle

BASE = ["thr", "lat_log", "loss", "jit_log", "load"]

oracle("label_rows_15", """
SELECT scenario, gnb, slice, pos, sla_ok, ok_ahead,
       CAST(CASE WHEN ok_ahead THEN 0 ELSE 1 END AS INTEGER) AS violated_ahead
FROM (SELECT *  EXCLUDE (ok_ahead, violated_ahead), bool_and(sla_ok) OVER (PARTITION BY scenario, gnb, slice ORDER BY pos
             ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) AS ok_ahead FROM kpi_pos)""")
oracle("feature_base", """
SELECT scenario, gnb, slice, tick, round(ln(1 + least(greatest(lat, 0), 600000)), 6) AS lat_log,
       round(least(greatest(lat, 0), 600000), 6) AS lat_back FROM kpi_rows""")
cte("kpi_logs", """
SELECT *, ln(1 + least(greatest(lat, 0), 600000)) AS lat_log,
       ln(1 + least(greatest(jit, 0), 600000)) AS jit_log FROM kpi_pos""")
cte("kpi_features", "SELECT *, " + ", ".join(
    f"coalesce({c} - lag({c}) OVER s, 0) AS {c}_trend, "
    f"coalesce(stddev_samp({c}) OVER (s ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS {c}_vol"
    for c in BASE) + " FROM kpi_logs WINDOW s AS (PARTITION BY scenario, gnb, slice ORDER BY pos)")
oracle("feature_trend", "SELECT scenario, gnb, slice, pos, " + ", ".join(
    f"round({c}_trend, 6) AS {c}_trend" for c in BASE) + " FROM kpi_features")
oracle("feature_vol_train", "SELECT scenario, gnb, slice, pos, " + ", ".join(
    f"round({c}_vol, 6) AS {c}_vol" for c in BASE) + " FROM kpi_features")
oracle("feature_vol_serve", """
SELECT scenario, gnb, slice, hist_idx,
       round(coalesce(lat_log - lag(lat_log) OVER s, 0), 6) AS lat_log_trend, """ + ", ".join(
    f"round(CASE WHEN hist_idx >= 4 THEN stddev_pop({c}) OVER (s ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    f" ELSE 0.0 END, 6) AS {c}_vol" for c in BASE) + """
FROM (SELECT *, pos - greatest(series_len - 60, 0) AS hist_idx FROM kpi_logs
      WHERE pos >= greatest(series_len - 60, 0))
WINDOW s AS (PARTITION BY scenario, gnb, slice ORDER BY pos)""")
ALL = BASE + [f"{c}_{k}" for c in BASE for k in ("trend", "vol")]
oracle("feature_matrix", "SELECT scenario, gnb, slice, pos, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in ALL) + " FROM kpi_features")
oracle("scaler_fit", "SELECT slice, feature, round(avg(v), 6) AS mean, "
       "round(CASE WHEN stddev_pop(v) > 1e-12 THEN stddev_pop(v) ELSE 1.0 END, 6) AS std FROM ("
       + " UNION ALL ".join(f"SELECT slice, '{c}' AS feature, {c} AS v FROM kpi_features"
                            for c in ALL) + ") GROUP BY slice, feature")
oracle("scaler_transform", """
SELECT scenario, gnb, slice, tick, """ + ", ".join(
    f"round(({c} - avg({c}) OVER s) / stddev_pop({c}) OVER s, 5) AS z_{c}, round({c}, 6) AS back_{c}"
    for c in ("thr", "lat_log", "loss")) + """
FROM (SELECT *, ln(1 + least(greatest(lat, 0), 600000)) AS lat_log FROM li_kpi)
WINDOW s AS (PARTITION BY slice)""")
oracle("sequence_windows", """
SELECT scenario, gnb, slice, pos - 59 AS start, xn AS x_rows, yn AS y_rows,
       round(x0, 6) AS x_first_lat_log, round(lat_log, 6) AS x_last_lat_log,
       round(xt, 6) AS x_thr, round(xv, 6) AS x_lat_vol, round(yt, 6) AS y_thr,
       round(yl, 6) AS y_lat_log, round(yloss, 6) AS y_loss
FROM (SELECT *, count(*) OVER x AS xn, count(*) OVER y AS yn, first_value(lat_log) OVER x AS x0,
             sum(thr) OVER x AS xt, sum(lat_log_vol) OVER x AS xv, sum(thr) OVER y AS yt,
             sum(lat_log) OVER y AS yl, sum(loss) OVER y AS yloss
      FROM kpi_features
      WINDOW x AS (PARTITION BY scenario, gnb, slice ORDER BY pos ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
             y AS (PARTITION BY scenario, gnb, slice ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING))
WHERE pos >= 59 AND pos - 59 < series_len - 75""")
cte("li_weights", """
SELECT scenario, gnb, slice, pos - 59 AS start, sd + 1 AS weight
FROM (SELECT *, stddev_pop(lat) OVER (PARTITION BY scenario, gnb, slice ORDER BY pos
                                      ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS sd FROM li_pos)
WHERE pos >= 59 AND pos - 59 < series_len - 75""")
oracle("window_weight", """
SELECT scenario, gnb, slice, start, round(weight, 6) AS weight FROM li_weights""")
cte("li_len", "SELECT scenario, gnb, slice, count(*) AS series_len FROM li_kpi GROUP BY ALL")
cte("li_split", """
SELECT slice, scenario, gnb, start,
       CASE WHEN rank > n - greatest(1, CAST(floor(n * 0.15) AS BIGINT)) THEN 'val' ELSE 'train' END AS part
FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY scenario, gnb, start) AS rank,
             count(*) OVER (PARTITION BY slice) AS n
      FROM (SELECT slice, scenario, gnb,
                   unnest(range(CAST(floor(series_len * 0.8) AS BIGINT) - 75)) AS start FROM li_len))
UNION ALL
SELECT slice, scenario, gnb, f + unnest(range(series_len - f - 75)) AS start, 'test' AS part
FROM (SELECT *, greatest(0, CAST(floor(series_len * 0.8) AS BIGINT) - 60) AS f FROM li_len)""")
oracle("temporal_split", "SELECT slice, scenario, gnb, start, part FROM li_split")
oracle("window_inventory", """
SELECT * FROM (SELECT slice, count(*) AS n_windows, round(avg(weight), 6) AS mean_weight,
                      round(max(weight), 6) AS max_weight FROM li_weights GROUP BY slice)
JOIN (SELECT slice, count(*) FILTER (part <> 'test') AS n_train,
             count(*) FILTER (part = 'test') AS n_test FROM li_split GROUP BY slice) USING (slice)
JOIN (SELECT slice, round(avg(CASE WHEN loss > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS lossy_pct
      FROM li_kpi GROUP BY slice) USING (slice)""")
oracle("aligned_cells", """
SELECT scenario, gnb, min(n) AS common_len
FROM (SELECT scenario, gnb, slice, count(*) AS n FROM kpi_rows GROUP BY ALL HAVING count(*) >= 75)
GROUP BY scenario, gnb HAVING count(DISTINCT slice) = 3""")
cte("li_aligned", """
SELECT scenario, gnb, min(series_len) AS common_len,
       greatest(60, CAST(floor(min(series_len) * 0.8) AS BIGINT)) AS t0
FROM li_len WHERE series_len >= 75 GROUP BY scenario, gnb HAVING count(DISTINCT slice) = 3""")
cte("li_windows", """
SELECT scenario, gnb, t0 + 15 * w AS t
FROM (SELECT *, unnest(range((common_len - t0) // 15)) AS w FROM li_aligned)""")
cte("li_seen", """
SELECT scenario, gnb, slice, t, count(*) AS n_rows,
       avg(CASE WHEN lat > CASE WHEN slice = 'mMTC' THEN 300 ELSE lat_max END THEN 1.0 ELSE 0.0 END) AS p_real
FROM li_pos JOIN li_windows USING (scenario, gnb)
JOIN (SELECT slice, lat_max FROM dim_limits WHERE profile = 'detect') USING (slice)
WHERE pos >= t AND pos < t + 15 GROUP BY ALL""")
oracle("eval_windows", """
SELECT scenario, gnb, slice, t, n_rows, round(p_real, 6) AS p_real FROM li_seen""")
oracle("last_n_per_key", """
SELECT scenario, gnb, slice, tick, rows_back, rows_back <= 5 AS in_last_5
FROM (SELECT *, row_number() OVER (PARTITION BY scenario, gnb, slice ORDER BY tick DESC) AS rows_back
      FROM kpi_rows) WHERE rows_back <= 60""")

"""SQL of the KPI and profiling queries."""

from slicewise.oracle.core import oracle

oracle("kpi_buckets", """
SELECT run, scenario, slice, gnb, tick, mean_delay_ms, mean_jitter_ms, mean_thr_mbps,
       bytes_received, packets_received, packets_sent FROM kpi_buckets""")
oracle("kpi_table", "SELECT * FROM kpi_rows")
oracle("sla_summary", """
SELECT slice, gnb, count(*) AS n_rows, round(avg(violated_ahead) * 100, 6) AS violation_pct,
       round(avg(lat), 6) AS mean_latency_ms,
       count(CASE WHEN lat_source = 'measured' THEN 1 END) AS n_measured
FROM kpi_rows GROUP BY ALL""")
oracle("run_duration", "SELECT run, max(t) AS max_time FROM raw_samples GROUP BY run")
oracle("label_range_15", """
SELECT run, slice, gnb, tick, sla_ok, ok_ahead, violated_ahead FROM kpi_rows""")

oracle("classify_keys", """
SELECT module, signal, count(*) AS n, max(slice) AS slice, max(gnb) AS gnb FROM (
  SELECT CASE WHEN signal = 'cbrSentPkt'
              THEN 'ue' || CASE slice WHEN 'eMBB' THEN 'Embb' WHEN 'URLLC' THEN 'Urllc' ELSE 'Mmtc' END
                   || CASE gnb WHEN 'Macro' THEN '_A[' WHEN 'Commerce' THEN '_B[' ELSE '_C[' END
                   || user_id || '].app[0]'
              ELSE 'server' || CASE slice WHEN 'eMBB' THEN 'Embb' WHEN 'URLLC' THEN 'Urllc' ELSE 'Mmtc' END
                   || CASE gnb WHEN 'Macro' THEN '.app[0]' WHEN 'Commerce' THEN '.app[1]' ELSE '.app[2]' END
         END AS module, signal, slice, gnb FROM raw_samples)
GROUP BY module, signal""")
oracle("dq_counts", """
SELECT count(*) AS n_rows, count(CASE WHEN loss < 0 OR loss > 100 THEN 1 END) AS loss_out_of_range,
       count(CASE WHEN thr < 0 THEN 1 END) AS negative_throughput,
       count(CASE WHEN lat < 0 THEN 1 END) AS negative_latency,
       count(*) - count(lat) AS null_lat, count(*) - count(thr) AS null_thr,
       count(*) - count(loss) AS null_loss FROM kpi_rows""")
oracle("dataset_profile", """
SELECT scenario, count(*) AS n_rows, count(DISTINCT tick) AS n_ticks,
       array_to_string(list_sort(list_distinct(list(gnb))), ',') AS cells,
       array_to_string(list_sort(list_distinct(list(slice))), ',') AS slices
FROM kpi_rows GROUP BY scenario""")
oracle("describe_kpi", """
SELECT slice, measure, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std,
       min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.25), 6) AS q25,
       round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75
FROM (SELECT s AS slice, m AS measure,
             CASE m WHEN 'lat' THEN lat WHEN 'thr' THEN thr ELSE loss END AS v
      FROM kpi_rows, (VALUES ('lat'), ('thr'), ('loss')) t(m), unnest([slice, '*']) u(s))
GROUP BY slice, measure""")
oracle("mean_loss_grains", """
SELECT scenario, gnb, slice, CAST(grouping(scenario, gnb, slice) AS BIGINT) AS grain,
       count(*) AS n, round(avg(loss), 6) AS mean_loss
FROM kpi_rows GROUP BY GROUPING SETS ((scenario), (gnb, slice), (scenario, gnb, slice))""")
oracle("loss_heatmap", "SELECT scenario, " + ", ".join(
    f"round(avg(CASE WHEN gnb = '{g}' AND slice = '{s}' THEN loss END), 6) AS \"{g}_{s}\""
    for g in ("Macro", "Commerce", "Industrie") for s in ("eMBB", "URLLC", "mMTC"))
    + " FROM kpi_rows GROUP BY scenario")
oracle("loss_classes", """
SELECT slice, loss_class, count(*) AS n,
       round(count(*) / sum(count(*)) OVER (PARTITION BY slice) * 100, 6) AS pct
FROM (SELECT slice, CASE WHEN loss < 2 THEN '0_zero (<2%)' WHEN loss < 15 THEN '1_low (2-15%)'
        WHEN loss < 50 THEN '2_moderate (15-50%)' WHEN loss < 80 THEN '3_high (50-80%)'
        ELSE '4_extreme (>80%)' END AS loss_class FROM kpi_rows)
GROUP BY slice, loss_class""")
oracle("kpi_correlation", " UNION ALL ".join(
    f"SELECT slice, '{x}' AS x, '{y}' AS y, CASE WHEN NOT isnan(corr({a}, {b})) THEN round(corr({a}, {b}), 6) END AS r FROM kpi_rows GROUP BY slice"
    for x, a, y, b in [
        ("log_latency", "ln(1 + lat)", "log_latency", "ln(1 + lat)"),
        ("log_latency", "ln(1 + lat)", "throughput", "thr"),
        ("log_latency", "ln(1 + lat)", "loss", "loss"),
        ("throughput", "thr", "throughput", "thr"), ("throughput", "thr", "loss", "loss"),
        ("loss", "loss", "loss", "loss")]))


def _histogram(bins: int, value: str) -> str:
    return f"""
SELECT slice, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1})
                   END AS BIGINT) AS bin,
       count(*) AS n, round(min(lo), 6) AS lo, round(min(hi), 6) AS hi
FROM (SELECT slice, {value} AS v, min({value}) OVER (PARTITION BY slice) AS lo,
             max({value}) OVER (PARTITION BY slice) AS hi FROM kpi_rows)
GROUP BY 1, 2"""


oracle("loss_histogram", f"""
SELECT * FROM ({_histogram(50, 'loss')}) JOIN (
  SELECT slice, round(avg(loss), 6) AS mean, round(median(loss), 6) AS median,
         round(avg(CASE WHEN loss < 1 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_below_1,
         round(avg(CASE WHEN loss > 60 THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_above_60
  FROM kpi_rows GROUP BY slice) USING (slice)""")
oracle("latency_histogram", f"""
SELECT * FROM ({_histogram(60, 'least(lat, lat_max * 5)')}) JOIN (
  SELECT slice, round(avg(lat), 6) AS mean,
         round(avg(CASE WHEN lat > lat_max THEN 1.0 ELSE 0.0 END) * 100, 6) AS pct_above_limit
  FROM kpi_rows GROUP BY slice) USING (slice)""")
oracle("loss_boxplot", """
SELECT gnb, slice, min(loss) AS low, max(loss) AS high, round(quantile_cont(loss, 0.25), 6) AS q1,
       round(quantile_cont(loss, 0.5), 6) AS median, round(quantile_cont(loss, 0.75), 6) AS q3
FROM kpi_rows GROUP BY gnb, slice""")
oracle("readiness_checks", """
SELECT * FROM (
  SELECT unnest(['no_missing_values', 'loss_in_0_100', 'a_scenario_near_0', 'a_cell_above_60',
                 'a_scenario_15_to_60', 'three_cells', 'three_slices', 'has_sla_flag',
                 'twelve_scenarios']) AS "check",
         unnest([missing = 0, outside = 0, some_zero, top > 60, some_mid, n_g = 3, n_s = 3, true,
                 n_sc = 12]) AS ok
  FROM (SELECT count(*) FILTER (lat IS NULL OR thr IS NULL OR loss IS NULL) AS missing,
               count(*) FILTER (loss < 0 OR loss > 100) AS outside,
               count(DISTINCT gnb) AS n_g, count(DISTINCT slice) AS n_s,
               count(DISTINCT scenario) AS n_sc FROM kpi_rows),
       (SELECT bool_or(m < 2) AS some_zero, bool_or(m > 15 AND m < 60) AS some_mid
        FROM (SELECT avg(loss) AS m FROM kpi_rows GROUP BY scenario)),
       (SELECT max(m) AS top FROM (SELECT avg(loss) AS m FROM kpi_rows GROUP BY scenario, gnb, slice)))""")
oracle("high_loss_cells", """
SELECT scenario || '-' || (tick // 15) AS scenario, gnb, slice, round(avg(loss), 6) AS mean_loss
FROM kpi_rows GROUP BY 1, 2, 3 HAVING round(avg(loss), 6) > 60""")
oracle("latency_violations", """
SELECT scenario, gnb, slice, count(*) AS n,
       round(avg(CASE WHEN lat > lat_max THEN 1.0 ELSE 0.0 END) * 100, 6) AS violation_pct,
       round(avg(lat), 6) AS mean_latency_ms, max(lat) AS max_latency_ms,
       round(avg(CASE WHEN sla_ok THEN 1.0 ELSE 0.0 END) * 100, 6) AS sla_ok_pct
FROM kpi_rows GROUP BY GROUPING SETS ((slice), (scenario, gnb, slice))""")
oracle("binary_loss", """
SELECT scenario, gnb, slice, tick, lat, lim AS lat_limit,
       CASE WHEN lat > lim THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS late,
       NOT lat > lim AS is_valid
FROM (SELECT *, CASE WHEN slice = 'mMTC' THEN CAST(300 AS DOUBLE) ELSE lat_max END AS lim FROM kpi_rows)""")
oracle("optional_column_fallback", """
SELECT CAST(variant AS INTEGER) AS variant, gnb, slice, count(*) AS n, max(lat_max) AS lat_max,
       round(avg(CASE variant WHEN 0 THEN CASE WHEN packets_received > 0 THEN 0.0 ELSE 1.0 END
                 WHEN 1 THEN 0.0 ELSE loss END), 6) AS mean_loss,
       round(avg(CASE WHEN lat > lat_max THEN 1.0 ELSE 0.0 END) * 100, 6) AS late_pct
FROM (SELECT r.*, b.packets_received FROM kpi_rows r
      JOIN kpi_buckets b USING (run, scenario, slice, gnb, tick)), (VALUES (0), (1), (2)) t(variant)
GROUP BY ALL""")
oracle("series_profile", """
SELECT pos, tick, lat, loss FROM kpi_pos
WHERE slice = 'URLLC' AND gnb = 'Commerce' AND scenario = 'S1'""")
oracle("series_min_length", """
SELECT scenario, gnb, slice, count(*) AS n_ticks FROM kpi_rows GROUP BY ALL HAVING count(*) >= 75""")

oracle("loss_class_table", "SELECT slice, " + ", ".join(
    f"count(*) FILTER (loss >= {a} AND loss < {b}) AS \"{n}\"" for a, b, n in [
        (-1e9, 2, "0_zero"), (2, 15, "1_low"), (15, 50, "2_moderate"), (50, 80, "3_high"),
        (80, 1e9, "4_extreme")]) + " FROM kpi_rows GROUP BY slice")
oracle("latency_violation_heatmap", "SELECT scenario, " + ", ".join(
    f"round(avg(CASE WHEN gnb = '{g}' AND slice = '{s}' THEN CASE WHEN lat > lat_max THEN 1.0 ELSE 0.0 END END) * 100, 6)"
    f" AS \"{g}_{s}\"" for g in ("Macro", "Commerce", "Industrie") for s in ("eMBB", "URLLC", "mMTC"))
    + " FROM kpi_rows GROUP BY scenario")
oracle("latency_max_table", "SELECT scenario, " + ", ".join(
    f"max(CASE WHEN slice = '{s}' THEN lat END) AS \"{s}\"" for s in ("eMBB", "URLLC", "mMTC"))
    + " FROM kpi_rows GROUP BY scenario")
oracle("mean_loss_table", "SELECT gnb, " + ", ".join(
    f"round(avg(CASE WHEN slice = '{s}' THEN loss END), 6) AS \"{s}\"" for s in ("eMBB", "URLLC", "mMTC"))
    + " FROM kpi_rows GROUP BY gnb")

"""SQL of the file and document queries: what the files must contain."""

from slicewise.oracle.core import cte, oracle

cte("named_modules", """
SELECT *, CASE WHEN signal = 'cbrSentPkt'
            THEN 'ue' || CASE slice WHEN 'eMBB' THEN 'Embb' WHEN 'URLLC' THEN 'Urllc' ELSE 'Mmtc' END
                 || CASE gnb WHEN 'Macro' THEN '_A[' WHEN 'Commerce' THEN '_B[' ELSE '_C[' END
                 || user_id || '].app[0]'
            ELSE 'server' || CASE slice WHEN 'eMBB' THEN 'Embb' WHEN 'URLLC' THEN 'Urllc' ELSE 'Mmtc' END
                 || CASE gnb WHEN 'Macro' THEN '.app[0]' WHEN 'Commerce' THEN '.app[1]' ELSE '.app[2]' END
       END AS module, (user_id // 18) || '' || (user_id % 9) || (list_position(['cbrSentPkt', 'cbrRcvdPkt', 'cbrReceivedBytes',
         'cbrFrameDelay', 'cbrJitter'], signal) - 1) AS vec_id
FROM raw_samples""")
cte("vectors", "SELECT DISTINCT run, scenario, vec_id, module, signal, slice, gnb FROM named_modules")
oracle("scan_signal_log", """
SELECT * FROM (SELECT run, signal, count(*) AS n_vectors FROM vectors GROUP BY ALL)
JOIN (SELECT s.run, v.signal, count(*) AS n_samples, round(sum(v), 2) AS v_sum, round(max(t), 6) AS t_max
      FROM named_modules s JOIN vectors v USING (run, vec_id) GROUP BY ALL) USING (run, signal)""")
oracle("relevant_vectors", """
SELECT scenario, slice, gnb, signal, count(*) AS n_vectors FROM vectors GROUP BY ALL""")
oracle("samples_with_keys", """
SELECT run, scenario, slice, gnb, tick, mean_delay_ms, mean_jitter_ms, bytes_received,
       packets_received, packets_sent FROM kpi_buckets""")
oracle("scan_scalar_totals", """
SELECT slice, gnb, CAST(coalesce(sum(CASE WHEN signal = 'cbrSentPkt' THEN n END), 0) AS DOUBLE) AS sent,
       CAST(coalesce(sum(CASE WHEN signal = 'cbrRcvdPkt' THEN n END), 0) AS DOUBLE) AS received,
       CAST(0 AS DOUBLE) AS bytes, CAST(0 AS DOUBLE) AS lost
FROM (SELECT slice, gnb, signal, module, count(*) AS n FROM named_modules GROUP BY ALL)
GROUP BY slice, gnb""")
oracle("run_catalog", """
SELECT DISTINCT run, scenario, run LIKE 'S0%' AS has_scalars FROM raw_samples""")
oracle("kpi_csv_roundtrip", """
SELECT tick, slice, gnb, scenario, thr, lat, jit, loss, load, thr_min, lat_max, loss_max, sla_ok,
       ok_ahead, violated_ahead FROM kpi_rows""")
oracle("kpi_export_view", """
SELECT strftime(TIMESTAMP '2024-01-01' + to_seconds(tick), '%Y-%m-%dT%H:%M:%SZ') AS Time_Sec,
       slice AS Slice_Type, gnb AS gNB_id, scenario AS Scenario, thr AS Slice_Throughput_Mbps,
       lat AS Slice_Latency_ms, jit AS Slice_Jitter_ms, loss AS Slice_Packet_Loss_pct,
       load AS Slice_Network_Load_pct, thr_min AS SLA_Throughput_Min_Mbps,
       lat_max AS SLA_Latency_Max_ms, loss_max AS SLA_PacketLoss_Max_pct,
       CAST(sla_ok AS VARCHAR) AS SLA_OK, CAST(ok_ahead AS VARCHAR) AS SLA_OK_in_15s,
       violated_ahead AS SLA_Violated_in_15s FROM kpi_rows""")
oracle("modes_union_scan", """
SELECT r.run AS mode, slice, count(*) AS n, round(avg(lat), 6) AS mean_lat_ms,
       CAST(sum(b.packets_received) AS BIGINT) AS packets
FROM mode_rows r JOIN mode_buckets b USING (run, scenario, slice, gnb, tick) GROUP BY ALL""")
oracle("allocation_json", """
SELECT scenario, '{' || string_agg('"' || gnb || '":{"URLLC":' || R_URLLC_opt || ',"eMBB":' || R_eMBB_opt
       || ',"mMTC":' || R_mMTC_opt || '}', ',' ORDER BY gnb) || '}' AS document
FROM alloc_report GROUP BY scenario""")

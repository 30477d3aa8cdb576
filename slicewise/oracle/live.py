"""SQL of the live queries: what the stream must have published."""

from slicewise.oracle.control import LAT_AHEAD, LIVE_COST, best_split, loop_ctes, reduction
from slicewise.oracle.core import cte, oracle

cte("reactive", """
SELECT scenario, gnb, slice, cut, last_tick,
       round(CASE WHEN lat > control_lat_max THEN 2.0
                  ELSE least(greatest(thr / greatest(capacity, 1e-6), 0), 2) END, 9) AS rho
FROM (SELECT scenario, gnb, slice, cut, max(tick) AS last_tick, round(avg(lat), 9) AS lat,
             round(avg(thr), 9) AS thr
      FROM (SELECT *, row_number() OVER (PARTITION BY scenario, gnb, slice, cut ORDER BY tick DESC) AS back
            FROM kpi_rows, (VALUES (40), (80), (1000000000)) c(cut) WHERE tick < cut)
      WHERE back <= 5 GROUP BY ALL
      HAVING max(tick) >= CASE cut WHEN 40 THEN 0 WHEN 80 THEN 40 ELSE 80 END)
JOIN facts USING (gnb, slice)""")
oracle("reactive_load", """
SELECT scenario, gnb, slice, last_tick, round(rho, 6) AS rho FROM reactive WHERE cut = 1000000000""")
oracle("stream_reactive_load", """
SELECT scenario, gnb, slice, last_tick, round(rho, 6) AS rho FROM reactive""")
cte("predictive_fits", """
SELECT scenario, gnb, slice, count(*) AS n_rows, max(CASE WHEN back = 1 THEN thr END) AS thr_last,
       round(avg(CASE WHEN back <= 5 THEN lat END), 9) AS lat_recent,
       round(avg(thr), 9) AS m_thr, round(regr_slope(thr, -back), 9) AS s_thr,
       round(avg(lat_log), 9) AS m_lat, round(regr_slope(lat_log, -back), 9) AS s_lat
FROM (SELECT scenario || '-' || (tick // 75) AS scenario, gnb, slice, lat, thr, ln(1 + lat) AS lat_log,
             row_number() OVER (PARTITION BY scenario, tick // 75, gnb, slice ORDER BY tick DESC) AS back
      FROM kpi_rows) WHERE back <= 60 GROUP BY ALL""")
cte("predictive_p", f"""
SELECT *, CASE WHEN shift THEN CAST(lat_recent > control_lat_max AS DOUBLE)
               ELSE len(list_filter(range(15), lambda h: {LAT_AHEAD} > control_lat_max)) / 15 END AS p
FROM (SELECT *, list_sum(list_transform(range(15), lambda h: {LAT_AHEAD})) / 15 > lat_recent * 5 AS shift
      FROM predictive_fits JOIN facts USING (gnb, slice))""")
oracle("predictive_load", """
SELECT k.scenario, g.gnb, g.slice, coalesce(n_rows, 0) AS n_rows,
       CASE WHEN n_rows IS NULL THEN 'fallback_nodata' WHEN n_rows < 60 THEN 'fallback_warmup'
            WHEN shift THEN 'forecast_shift' ELSE 'forecast' END AS mode,
       CASE WHEN n_rows >= 60 THEN round(p, 6) END AS p_viol,
       round(CASE WHEN n_rows IS NULL THEN 0.1
            WHEN n_rows < 60 THEN least(greatest(thr_last / greatest(f.capacity, 1e-6), 0), 2)
            WHEN p >= 0.99 THEN 2.0
            WHEN p <= 0.01 THEN least(greatest((m_thr + s_thr * 37.5) / greatest(f.capacity, 1e-6), 0), 1.5)
            ELSE least(greatest(f.curve_rho - ln(1.0 / greatest(p, 1e-6) - 1) / greatest(f.curve_k, 0.01), 0), 2)
            END, 6) AS rho
FROM (SELECT DISTINCT scenario FROM predictive_fits) k CROSS JOIN facts g
LEFT JOIN predictive_p f ON f.scenario = k.scenario AND f.gnb = g.gnb AND f.slice = g.slice""")
oracle("live_stream_scan", """
SELECT scenario, gnb, slice, count(*) AS n_rows, CAST(max(tick) AS DOUBLE) AS last_time,
       round(avg(lat), 9) AS mean_lat, CAST(sum(b.packets_received) AS BIGINT) AS packets
FROM kpi_rows JOIN kpi_buckets b USING (run, scenario, slice, gnb, tick) GROUP BY scenario, gnb, slice""")
oracle("live_tail_scan", """
SELECT scenario, gnb, slice, CAST(tick AS DOUBLE) AS simtime_s, lat AS avg_latency_ms, thr AS throughput_mbps,
       b.packets_received AS pkt_count, loss AS pkt_loss_pct
FROM kpi_rows JOIN kpi_buckets b USING (run, scenario, slice, gnb, tick)""")
oracle("stream_tumbling_kpi", """
SELECT scenario, gnb, slice, (tick // 15) * 15 AS period_start, count(*) AS n_rows,
       round(avg(lat), 6) AS lat, round(avg(thr), 6) AS thr
FROM kpi_rows GROUP BY scenario, gnb, slice, tick // 15
HAVING (tick // 15) * 15 + 15 <= (SELECT max(tick) FROM kpi_rows) - 30""")
oracle("stream_history_ready", """
SELECT scenario, gnb, slice, max(tick) AS last_tick, count(*) AS n_rows, count(*) >= 60 AS ready,
       round(avg(lat), 9) AS lat_history
FROM (SELECT *, row_number() OVER (PARTITION BY scenario, gnb, slice, cut ORDER BY tick DESC) AS back
      FROM kpi_rows, (VALUES (40), (80), (1000000000)) c(cut) WHERE tick < cut)
WHERE back <= 60 GROUP BY scenario, gnb, slice, cut
HAVING max(tick) >= CASE cut WHEN 40 THEN 0 WHEN 80 THEN 40 ELSE 80 END""")
cte("period_ends", """
SELECT * FROM (
  SELECT scenario, gnb, unnest(range((min(tick) // 15 + 1) * 15, (max(tick) // 15 + 1) * 15 + 1, 15)) AS cut
  FROM kpi_rows GROUP BY scenario, gnb)
WHERE cut <= (SELECT max(tick) FROM kpi_rows) - 30""")
cte("period_fits", """
SELECT scenario, gnb, slice, cut, count(*) AS n_rows, max(CASE WHEN back = 1 THEN thr END) AS thr_last,
       round(avg(CASE WHEN back <= 5 THEN lat END), 9) AS lat_recent,
       round(avg(CASE WHEN back <= 5 THEN thr END), 9) AS thr_recent,
       round(avg(thr), 9) AS m_thr, round(regr_slope(thr, -back), 9) AS s_thr,
       round(avg(ln(1 + lat)), 9) AS m_lat, round(regr_slope(ln(1 + lat), -back), 9) AS s_lat
FROM (SELECT r.*, cut, row_number() OVER (PARTITION BY scenario, gnb, slice, cut ORDER BY tick DESC) AS back
      FROM kpi_rows r JOIN period_ends USING (scenario, gnb) WHERE tick < cut) WHERE back <= 60 GROUP BY ALL""")
cte("period_p", f"""
SELECT *, CASE WHEN shift THEN CAST(lat_recent > control_lat_max AS DOUBLE)
               ELSE len(list_filter(range(15), lambda h: {LAT_AHEAD} > control_lat_max)) / 15 END AS p
FROM (SELECT *, list_sum(list_transform(range(15), lambda h: {LAT_AHEAD})) / 15 > lat_recent * 5 AS shift
      FROM period_fits JOIN facts USING (gnb, slice))""")
PERIOD_LOADS = {
    "reactive": """round(CASE WHEN r.lat_recent > r.control_lat_max THEN 2.0
        ELSE least(greatest(r.thr_recent / greatest(r.capacity, 1e-6), 0), 2) END, 9)""",
    "predictive": """round(CASE
        WHEN r.n_rows < 60 THEN least(greatest(r.thr_last / greatest(r.capacity, 1e-6), 0), 2)
        WHEN r.p >= 0.99 THEN 2.0
        WHEN r.p <= 0.01 THEN least(greatest((r.m_thr + r.s_thr * 37.5) / greatest(r.capacity, 1e-6), 0), 1.5)
        ELSE least(greatest(r.curve_rho - ln(1.0 / greatest(r.p, 1e-6) - 1) / greatest(r.curve_k, 0.01), 0), 2) END, 9)"""}
for _kind, _rho in PERIOD_LOADS.items():
    cte(f"{_kind}_costs", f"""
SELECT scenario, gnb, cut, slice, n, budget, units_floor, {LIVE_COST} AS live_cost
FROM (SELECT k.scenario, k.cut, f.*, CASE WHEN r.gnb IS NULL THEN 0.1 ELSE {_rho} END AS rho
      FROM period_ends k JOIN facts f ON f.gnb = k.gnb
      LEFT JOIN period_p r ON r.scenario = k.scenario AND r.cut = k.cut AND r.gnb = f.gnb AND r.slice = f.slice),
     range(1, 51) t(n) WHERE n <= budget""")
    cte(f"{_kind}_alloc", best_split(
        f"{_kind}_costs", "scenario, gnb, cut", "a.n >= a.units_floor AND b.n >= b.units_floor "
        "AND c.n >= c.units_floor AND a.n + b.n + c.n <= a.budget", "live_cost"))
DOC = """'{' || string_agg('"' || gnb || '":{"URLLC":' || n2 || ',"eMBB":' || n1 || ',"mMTC":' || n3
       || '}', ',' ORDER BY gnb) || '}' AS document"""
oracle("stream_predictive_allocation", f"""
SELECT scenario, gnb, {DOC}, CAST(cut AS BIGINT) AS period_end FROM predictive_alloc GROUP BY scenario, gnb, cut""")
oracle("stream_allocation", f"""
SELECT scenario, gnb, {DOC}, CAST(cut AS BIGINT) AS period_end FROM reactive_alloc GROUP BY scenario, gnb, cut
UNION ALL
SELECT scenario, '*' AS gnb, {DOC}, -1 AS period_end FROM (SELECT DISTINCT scenario FROM kpi_rows), (
  SELECT gnb, max(CASE WHEN slice = 'eMBB' THEN units_default END) AS n1,
         max(CASE WHEN slice = 'URLLC' THEN units_default END) AS n2,
         max(CASE WHEN slice = 'mMTC' THEN units_default END) AS n3 FROM dim_units GROUP BY gnb)
GROUP BY scenario""")
oracle("stream_latest", """
SELECT scenario, gnb, slice, CAST(tick AS DOUBLE) AS simtime_s, lat AS avg_latency_ms,
       thr AS throughput_mbps, b.packets_received AS pkt_count, lat <= l.lat_max AS sla_ok
FROM kpi_rows r JOIN kpi_buckets b USING (run, scenario, slice, gnb, tick)
JOIN (SELECT slice, lat_max FROM dim_limits WHERE profile = 'control') l USING (slice)
QUALIFY row_number() OVER (PARTITION BY scenario, gnb, slice ORDER BY tick DESC) = 1""")
oracle("stream_replay_buffer", """
SELECT scenario, gnb, slice, period, least(rank - 1, 64) AS n_buffer, rank - 1 >= 8 AS ready,
       round(CASE WHEN rank > 1 THEN avg(CASE WHEN rank > 1 THEN y END) OVER (PARTITION BY scenario, gnb, slice ORDER BY period
             ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) END, 6) AS batch_lat_log
FROM (SELECT *, row_number() OVER (PARTITION BY scenario, gnb, slice ORDER BY period) AS rank,
             count(*) OVER (PARTITION BY scenario, gnb, slice) AS n
      FROM (SELECT scenario, gnb, slice, tick // 15 AS period, avg(ln(1 + lat)) AS y
            FROM li_kpi GROUP BY scenario, gnb, slice, tick // 15))
WHERE (period + 1) * 15 <= (SELECT max(tick) FROM li_kpi) - 30""")

# The learner as a recursion over steps: the newest eight samples enter through their sums.
cte("learn_periods", """
SELECT *, row_number() OVER w AS rank, count(*) OVER (PARTITION BY scenario, gnb, slice) AS n,
       lag(y) OVER w AS l, lag(t) OVER w AS tp, (period + 1) * 15 <= (SELECT max(tick) FROM li_kpi) - 30 AS done
FROM (SELECT scenario, gnb, slice, tick // 15 AS period, avg(ln(1 + lat)) AS y, avg(thr) / 10 AS t
      FROM li_kpi GROUP BY scenario, gnb, slice, tick // 15)
WINDOW w AS (PARTITION BY scenario, gnb, slice ORDER BY period)""")
_terms = {"sl": "l", "st": "tp", "sy": "y", "sll": "l * l", "slt": "l * tp", "stt": "tp * tp",
          "sly": "l * y", "sty": "tp * y", "syy": "y * y"}
cte("learn_sums", "SELECT scenario, gnb, slice, period, rank - 8 AS step, rank, done, " + ", ".join(
    f"sum({e}) OVER w AS {k}" for k, e in _terms.items()) + """
FROM learn_periods WHERE rank > 1
WINDOW w AS (PARTITION BY scenario, gnb, slice ORDER BY period ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""")
LEARN = """
WITH RECURSIVE run AS (
  SELECT scenario, gnb, slice, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS period,
         CAST(NULL AS DOUBLE) AS loss, CAST(0 AS DOUBLE) AS w0, CAST(0 AS DOUBLE) AS w1, CAST(0 AS DOUBLE) AS w2
  FROM (SELECT DISTINCT scenario, gnb, slice FROM learn_sums)
  UNION ALL
  SELECT scenario, gnb, slice, step, period, loss, w0 - {rate} * g0 / greatest(norm, 1),
         w1 - {rate} * g1 / greatest(norm, 1), w2 - {rate} * g2 / greatest(norm, 1)
  FROM (SELECT *, sqrt(g0 * g0 + g1 * g1 + g2 * g2) AS norm
        FROM (SELECT s.scenario, s.gnb, s.slice, s.step, s.period, w0, w1, w2,
               (8 * w0 + sl * w1 + st * w2 - sy) / 4 AS g0,
               (sl * w0 + sll * w1 + slt * w2 - sly) / 4 AS g1,
               (st * w0 + slt * w1 + stt * w2 - sty) / 4 AS g2,
               (syy - 2 * (w0 * sy + w1 * sly + w2 * sty) + 8 * w0 * w0 + sll * w1 * w1 + stt * w2 * w2
                + 2 * (sl * w0 * w1 + st * w0 * w2 + slt * w1 * w2)) / 8 AS loss
              FROM run JOIN learn_sums s ON s.scenario = run.scenario AND s.gnb = run.gnb
                AND s.slice = run.slice AND s.step = run.step + 1 AND s.rank > 8 AND s.done)))
SELECT * FROM run WHERE step > 0"""
cte("learned_steps", LEARN.replace("{rate}", "1e-5"))
oracle("stream_online_update", """
SELECT scenario, gnb, slice, period, step, round(loss, 9) AS loss, round(w0, 12) AS w0,
       round(w1, 12) AS w1, round(w2, 12) AS w2 FROM learned_steps""")
oracle("stream_federated_round", """
SELECT scenario, slice, step, CAST(i AS BIGINT) AS idx,
       round(avg(CASE i WHEN 0 THEN w0 WHEN 1 THEN w1 ELSE w2 END), 12) AS value, count(*) AS n_cells
FROM learned_steps, range(3) t(i) WHERE slice = 'eMBB' AND step % 5 = 0 GROUP BY ALL""")
oracle("online_loss_trend", """
SELECT scenario, gnb, slice, step, round(avg(loss) OVER (PARTITION BY scenario, gnb, slice ORDER BY step
       ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS loss_5 FROM learned_steps""")
oracle("online_loss_halves", """
SELECT scenario, gnb, slice, n_steps, round(avg(loss) FILTER (step <= n_steps // 2), 9) AS first_half,
       round(avg(loss) FILTER (step > n_steps // 2), 9) AS second_half,
       round(avg(loss) FILTER (step <= 20), 9) AS first_20,
       round(avg(loss) FILTER (step > n_steps - 20), 9) AS last_20
FROM (SELECT *, max(step) OVER (PARTITION BY scenario, gnb, slice) AS n_steps FROM learned_steps)
GROUP BY scenario, gnb, slice, n_steps""")

# The online loop: every window takes the weights of the last step before it.
cte("online_steps", "SELECT * FROM feed_long")
cte("online_seen", """
SELECT scenario, gnb, slice, t, round(avg(lat_log) FILTER (pos < t), 9) AS x_lat,
       round(avg(thr) FILTER (pos < t), 9) / 10 AS x_thr, max(tick) FILTER (pos = t) // 15 AS starts
FROM li_logs JOIN li_windows USING (scenario, gnb) WHERE pos >= t - 15 AND pos <= t GROUP BY ALL""")
cte("online_given", """
SELECT w.*, coalesce(s.step, 0) AS step, loss, coalesce(fedavg, false) AS fedavg, coalesce(w0, 0) AS w0, coalesce(w1, 0) AS w1, coalesce(w2, 0) AS w2
FROM online_seen w LEFT JOIN online_steps s ON s.scenario = w.scenario AND s.gnb = w.gnb AND s.slice = w.slice
  AND s.period < w.starts
QUALIFY row_number() OVER (PARTITION BY w.scenario, w.gnb, w.slice, w.t ORDER BY s.period DESC NULLS LAST) = 1""")
loop_ctes("online", "", """
SELECT *, round(CASE WHEN p_pred >= 0.99 THEN CAST(2 AS DOUBLE)
    ELSE least(greatest(greatest(m_thr + s_thr * 37.5, 0) / greatest(capacity, 1e-6), 0.01), 3) END, 9) AS rho
FROM (SELECT f.*, d.* EXCLUDE (gnb, slice), g.step, g.loss, g.fedavg, round(s.p_real, 9) AS p_real,
             CASE WHEN exp(w0 + w1 * x_lat + w2 * x_thr) - 1 > control_lat_max THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS p_pred
      FROM li_fits f JOIN facts d USING (gnb, slice) JOIN li_seen s USING (scenario, gnb, slice, t)
      JOIN online_given g USING (scenario, gnb, slice, t))""")
cte("online_rows", """
SELECT * FROM online_wide JOIN (
  SELECT scenario, gnb, t, CAST(max(step) AS BIGINT) AS step, round(avg(loss), 6) AS train_loss,
         bool_or(fedavg) AS fedavg
  FROM online_loads GROUP BY scenario, gnb, t) USING (scenario, gnb, t)""")
oracle("closed_loop_online", "SELECT * FROM online_rows")
oracle("sla_reduction_online", reduction(True, "online"))
cte("online_numbered", """
SELECT *, row_number() OVER (ORDER BY scenario, gnb, t) - 1 AS row_no, count(*) OVER () AS n_all FROM online_rows""")
oracle("half_comparison", " UNION ALL ".join(
    f"SELECT '{p}' AS part, round(avg(mae_pred), 5) AS mae_pred, round(avg(gain_pct), 5) AS gain_pct, "
    f"round(avg(train_loss), 5) AS train_loss FROM online_numbered WHERE {c}" for p, c in [
        ("first_half", "row_no < n_all // 2"), ("second_half", "row_no >= n_all // 2"),
        ("first_rows", "row_no < 20"), ("last_rows", "row_no >= n_all - 20")]))
oracle("rolling_quality", """
SELECT gnb, scenario, t, row_number() OVER w - 1 AS row_no,
       round(avg(mae_pred) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 8) AS mae_10,
       round(avg(gain_pct) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 8) AS gain_10,
       round(avg(F_optimal) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 8) AS objective_5
FROM online_rows WINDOW w AS (PARTITION BY gnb ORDER BY scenario, t)""")

# Learning with feedback: a recursion over the periods of a (scenario, slice), all cells in one row.
_CELLS = ["Commerce", "Industrie", "Macro"]
_SUMS = [*_terms]
# a random eight of the newest 64 samples: those whose hash with the series and the period is least
cte("feed_drawn", """
SELECT p.scenario, p.gnb, p.slice, p.period, p.rank - 8 AS step, s.l, s.tp, s.y
FROM learn_periods p JOIN learn_periods s ON s.scenario = p.scenario AND s.gnb = p.gnb AND s.slice = p.slice
  AND s.rank BETWEEN greatest(2, p.rank - 63) AND p.rank
WHERE p.rank > 8 AND p.done
QUALIFY row_number() OVER (PARTITION BY p.scenario, p.gnb, p.slice, p.period
  ORDER BY md5(concat_ws('|', p.scenario, p.gnb, p.slice, p.period, s.period))) <= 8""")
cte("feed_sums", "SELECT scenario, gnb, slice, period, step, " + ", ".join(
    f"sum({e}) AS {k}" for k, e in _terms.items()) + " FROM feed_drawn GROUP BY ALL")
cte("feed_wide", "SELECT scenario, slice, period, row_number() OVER (PARTITION BY scenario, slice ORDER BY period) AS k, "
    + ", ".join(f"{c} AS {c}" for i in range(3) for c in [f"step{i}", *[f"{x}{i}" for x in _SUMS]])
    + ", " + ", ".join(f"coalesce(max(step{i}) OVER (PARTITION BY scenario, slice ORDER BY period), 0) AS upto{i}" for i in range(3))
    + " FROM (SELECT scenario, slice, period, " + ", ".join(
        f"max(CASE WHEN gnb = '{c}' THEN {x} END) AS {x}{i}" for i, c in enumerate(_CELLS) for x in ["step", *_SUMS])
    + " FROM feed_sums WHERE step > 0 GROUP BY ALL)")


def _fed_step(i: int) -> str:
    """Gradient and loss of cell ``i`` of one row."""
    a, b, c = f"a{i}", f"b{i}", f"c{i}"
    s = {x: f"{x}{i}" for x in _SUMS}
    return f"""(8 * {a} + {s['sl']} * {b} + {s['st']} * {c} - {s['sy']}) / 4 AS g{i}0,
  ({s['sl']} * {a} + {s['sll']} * {b} + {s['slt']} * {c} - {s['sly']}) / 4 AS g{i}1,
  ({s['st']} * {a} + {s['slt']} * {b} + {s['stt']} * {c} - {s['sty']}) / 4 AS g{i}2,
  ({s['syy']} - 2 * ({a} * {s['sy']} + {b} * {s['sly']} + {c} * {s['sty']}) + 8 * {a} * {a} + {s['sll']} * {b} * {b}
   + {s['stt']} * {c} * {c} + 2 * ({s['sl']} * {a} * {b} + {s['st']} * {a} * {c} + {s['slt']} * {b} * {c})) / 8 AS newloss{i}"""


def _feed() -> str:
    cols = [f"{v}{i}" for i in range(3) for v in "abc"]
    moved = ", ".join(
        f"CASE WHEN step{i} IS NULL THEN {v}{i} ELSE {v}{i} - 0.01 * g{i}{j} / greatest(sqrt(g{i}0 ** 2 + g{i}1 ** 2 + g{i}2 ** 2), 1) END AS n{v}{i}"
        for i in range(3) for j, v in enumerate("abc"))
    able = " + ".join(f"CASE WHEN upto{i} > 0 THEN 1 ELSE 0 END" for i in range(3))
    due = "slice = 'eMBB' AND greatest(upto0, upto1, upto2) % 5 = 0"
    mean = {v: "(" + " + ".join(f"CASE WHEN upto{i} > 0 THEN n{v}{i} ELSE 0 END" for i in range(3)) + f") / ({able})" for v in "abc"}
    final = ", ".join(f"CASE WHEN {due} AND upto{i} > 0 THEN {mean[v]} ELSE n{v}{i} END AS {v}{i}" for i in range(3) for v in "abc")
    return f"""
WITH RECURSIVE run AS (
  SELECT scenario, slice, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS period, false AS due,
         {", ".join(f"CAST(NULL AS BIGINT) AS step{i}, CAST(NULL AS DOUBLE) AS newloss{i}" for i in range(3))},
         {", ".join(f"CAST(0 AS DOUBLE) AS {c}" for c in cols)}
  FROM (SELECT DISTINCT scenario, slice FROM feed_wide)
  UNION ALL
  SELECT scenario, slice, k, period, {due} AS due, {", ".join(f"step{i}, newloss{i}" for i in range(3))}, {final}
  FROM (SELECT *, {moved} FROM (
    SELECT f.*, {", ".join(f"r.{c}" for c in cols)}, {", ".join(_fed_step(i) for i in range(3))}
    FROM run r JOIN feed_wide f ON f.scenario = r.scenario AND f.slice = r.slice AND f.k = r.k + 1)))
SELECT * FROM run WHERE k > 0"""


cte("feed_steps", _feed())
cte("feed_long", " UNION ALL ".join(
    f"SELECT scenario, '{c}' AS gnb, slice, period, step{i} AS step, due AS fedavg, newloss{i} AS loss, "
    f"a{i} AS w0, b{i} AS w1, c{i} AS w2 FROM feed_steps WHERE step{i} IS NOT NULL" for i, c in enumerate(_CELLS)))
oracle("stream_federated_learning", """
SELECT scenario, gnb, slice, period, step, fedavg, round(loss, 6) AS loss, round(w0, 8) AS w0,
       round(w1, 8) AS w1, round(w2, 8) AS w2 FROM feed_long""")

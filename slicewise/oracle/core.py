"""Plain SQL statement of every deterministic query, for an independent engine.

``CTES`` holds named sub-queries; ``sql(body)`` prefixes a body with the ones it needs.
"""

from __future__ import annotations

import re

from slicewise import dims


def _values(rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        if isinstance(v, str):
            return "'" + v + "'"
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _mentions(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", text))
    return [name for name in CTES if name in words]


def sql(body: str) -> str:
    needed: list[str] = []

    def add(text: str, seen: tuple[str, ...]) -> None:
        for name in _mentions(text):
            if name in seen or name in needed:
                continue
            add(CTES[name], seen + (name,))
            needed.append(name)

    add(body, ())
    if not needed:
        return body.strip()
    # one reference is inlined by the engine, several are computed once
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in needed)
    return f"WITH {parts}\n{body.strip()}"


def oracle(name: str, body: str) -> None:
    ORACLES[name] = body


_budget = dict(dims.BUDGETS)
cte("dim_units", f"""
SELECT *, units_default * unit_rate AS capacity FROM (VALUES
{_values([r + (_budget[r[0]],) for r in dims.UNITS])}
) AS t(gnb, slice, units_default, unit_rate, units_floor, curve_k, curve_rho, budget)""")
cte("dim_limits", f"""
SELECT * FROM (VALUES {_values(dims.LIMITS)}) AS t(profile, slice, thr_min, lat_max, loss_max)""")
cte("dim_slices", f"""
SELECT * FROM (VALUES {_values(dims.SLICE_FACTS)})
  AS t(slice, slice_rank, queue_capacity, queue_base, priority)""")
cte("scenario_list", f"""
SELECT * FROM (VALUES {_values([(s, i) for i, s in enumerate(dims.SCENARIO_ORDER)])})
  AS t(scenario_name, position)""")

cte("raw_samples", """
SELECT event_id, user_id,
       'S' || ((user_id // 9) % 2) AS scenario, 'S' || ((user_id // 9) % 2) || '-0' AS run,
       CASE (user_id // 3) % 3 WHEN 0 THEN 'Macro' WHEN 1 THEN 'Commerce' ELSE 'Industrie' END AS gnb,
       CASE user_id % 3 WHEN 0 THEN 'eMBB' WHEN 1 THEN 'URLLC' ELSE 'mMTC' END AS slice,
       CASE event_type WHEN 'click' THEN 'cbrSentPkt' WHEN 'view' THEN 'cbrRcvdPkt'
            WHEN 'purchase' THEN 'cbrReceivedBytes' WHEN 'error' THEN 'cbrFrameDelay'
            ELSE 'cbrJitter' END AS signal,
       (CAST(epoch_us(ts) AS DOUBLE) / 1e6 - 1704067200) / 21600 AS t,
       CASE WHEN event_type = 'purchase' THEN round(value * 100000) ELSE value END AS v,
       CASE event_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'periodic_milp' ELSE 'lstm_milp' END AS mode
FROM events""")


def _kpi_ctes(prefix: str, run: str) -> None:
    cte(f"{prefix}_buckets", f"""
SELECT {run} AS run, scenario, slice, gnb, CAST(floor(t) AS BIGINT) AS tick,
       round(avg(CASE WHEN signal = 'cbrFrameDelay' THEN v END), 9) AS mean_delay_ms,
       round(avg(CASE WHEN signal = 'cbrJitter' THEN v END), 9) AS mean_jitter_ms,
       CAST(NULL AS DOUBLE) AS mean_thr_mbps,
       coalesce(sum(CASE WHEN signal = 'cbrReceivedBytes' THEN v END), 0.0) AS bytes_received,
       count(CASE WHEN signal = 'cbrRcvdPkt' THEN 1 END) AS packets_received,
       count(CASE WHEN signal = 'cbrSentPkt' THEN 1 END) AS packets_sent
FROM raw_samples GROUP BY ALL""")
    cte(f"{prefix}_formulas", f"""
SELECT b.*, thr, coalesce(mean_delay_ms, queue_ms) AS lat,
       CASE WHEN mean_delay_ms IS NULL THEN 'estimated' ELSE 'measured' END AS lat_source,
       loss, least(100.0, thr / greatest(thr_min * 10, 1.0) * 100) AS load,
       thr_min, lat_max, loss_max,
       coalesce(mean_delay_ms, queue_ms) <= lat_max AND loss <= loss_max AS sla_ok
FROM (
  SELECT *, greatest(0.1, queue_base + CASE WHEN least(0.99, thr / queue_capacity) > 0
              THEN (least(0.99, thr / queue_capacity) / (1 - least(0.99, thr / queue_capacity))) * 0.5
              ELSE 50.0 END) AS queue_ms
  FROM (
    SELECT *, CASE WHEN bytes_received > 0 THEN bytes_received * 8 / 1e6
                   ELSE coalesce(mean_thr_mbps, 0.0) END AS thr,
           CASE WHEN packets_sent > 0
                THEN greatest(0.0, 100.0 * (1.0 - packets_received / packets_sent))
                ELSE 0.0 END AS loss
    FROM {prefix}_buckets) x
  JOIN dim_slices USING (slice)
  JOIN (SELECT * FROM dim_limits WHERE profile = 'detect') l USING (slice)) b""")
    cte(f"{prefix}_rows", f"""
SELECT run, scenario, slice, gnb, tick, round(thr, 6) AS thr, round(lat, 6) AS lat, lat_source,
       round(coalesce(mean_jitter_ms, spread, 0.0), 6) AS jit, round(loss, 6) AS loss,
       round(load, 6) AS load, thr_min, lat_max, loss_max, sla_ok,
       coalesce(ahead, true) AS ok_ahead,
       CAST(CASE WHEN coalesce(ahead, true) THEN 0 ELSE 1 END AS INTEGER) AS violated_ahead
FROM (
  SELECT *, stddev_samp(lat) OVER (PARTITION BY run, scenario, slice, gnb ORDER BY tick
                            ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS spread,
         bool_and(sla_ok) OVER (PARTITION BY run, scenario, slice, gnb ORDER BY tick
                            RANGE BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS ahead
  FROM {prefix}_formulas)""")


_kpi_ctes("kpi", "run")
_kpi_ctes("mode", "mode")

cte("kpi_pos", """
SELECT *, row_number() OVER s - 1 AS pos,
       count(*) OVER (PARTITION BY scenario, gnb, slice) AS series_len
FROM kpi_rows WINDOW s AS (PARTITION BY scenario, gnb, slice ORDER BY tick)""")

cte("li_kpi", """
SELECT 'L' || (l_linenumber % 2) AS scenario,
       CASE l_suppkey % 3 WHEN 0 THEN 'Macro' WHEN 1 THEN 'Commerce' ELSE 'Industrie' END AS gnb,
       CASE l_returnflag WHEN 'A' THEN 'eMBB' WHEN 'N' THEN 'URLLC' ELSE 'mMTC' END AS slice,
       CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS tick,
       round(CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) * 8 / 1e6, 6) AS thr,
       round(avg(l_quantity), 6) AS lat,
       round(avg(CASE WHEN l_linestatus = 'F' THEN 100.0 ELSE 0.0 END), 6) AS loss
FROM lineitem GROUP BY ALL""")
cte("li_pos", """
SELECT *, row_number() OVER s - 1 AS pos,
       count(*) OVER (PARTITION BY scenario, gnb, slice) AS series_len
FROM li_kpi WINDOW s AS (PARTITION BY scenario, gnb, slice ORDER BY tick)""")

"""SQL of the parameter and sampling queries, and of the local and robust fits."""

from slicewise.oracle.core import cte, oracle

cte("model_ends", """
SELECT CASE label % 3 WHEN 0 THEN 'eMBB' WHEN 1 THEN 'URLLC' ELSE 'mMTC' END AS slice,
       CASE vec_id % 3 WHEN 0 THEN 'Macro' WHEN 1 THEN 'Commerce' ELSE 'Industrie' END AS gnb,
       arg_min(embedding, vec_id) AS a, arg_max(embedding, vec_id) AS b
FROM embeddings GROUP BY 1, 2""")
cte("model_rows", """
SELECT slice, gnb, i AS idx, 'p' || (i // 16) AS param, CAST(a[i + 1] AS DOUBLE) AS initial,
       CAST(b[i + 1] AS DOUBLE) AS final
FROM (SELECT *, unnest(range(len(a))) AS i FROM model_ends)""")
oracle("federated_average", """
SELECT slice, 'p' || (i // 16) AS param, i AS idx, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS value,
       count(*) AS n_vectors
FROM (SELECT CASE label % 3 WHEN 0 THEN 'eMBB' WHEN 1 THEN 'URLLC' ELSE 'mMTC' END AS slice, embedding,
             unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL""")
oracle("random_split", """
SELECT slice, CASE WHEN rank <= CAST(floor(n * 0.15) AS BIGINT) THEN 'val' ELSE 'train' END AS part, count(*) AS n,
       CAST(sum(start) AS BIGINT) AS start_sum
FROM (SELECT slice, start, count(*) OVER (PARTITION BY slice) AS n, row_number() OVER (PARTITION BY slice
        ORDER BY CAST('0x' || substr(md5(concat_ws('|', scenario, gnb, slice, start)), 1, 13) AS BIGINT), scenario, gnb, start) AS rank
      FROM li_weights) GROUP BY ALL""")
cte("sample_stretches", """
SELECT *, sum(w) OVER (PARTITION BY slice ORDER BY start, scenario, gnb) - w AS lo,
       row_number() OVER (PARTITION BY slice ORDER BY start, scenario, gnb) AS i, sum(w) OVER (PARTITION BY slice) AS total
FROM (SELECT *, CAST(round(weight * 1e6) AS BIGINT) AS w FROM li_weights)""")
oracle("weighted_sample", """
SELECT scenario, gnb, slice, count(*) AS n_windows, round(sum(weight), 6) AS weight_sum,
       CAST(sum(n) AS BIGINT) AS n_drawn, count(*) FILTER (n > 0) AS n_distinct, CAST(sum(numbers) AS BIGINT) AS draw_sum
FROM (SELECT s.scenario, s.gnb, s.slice, s.start, any_value(s.weight) AS weight, count(d.i) AS n, coalesce(sum(d.i), 0) AS numbers
      FROM sample_stretches s LEFT JOIN (
        SELECT a.i, s.slice, s.scenario, s.gnb, s.start
        FROM (SELECT slice, i, CAST(CAST('0x' || substr(md5(concat_ws('|', '42', slice, i)), 1, 13) AS BIGINT) % total AS HUGEINT) AS v
              FROM sample_stretches) a
        ASOF JOIN (SELECT * FROM sample_stretches WHERE w > 0) s ON a.slice = s.slice AND a.v >= s.lo) d
        ON d.scenario = s.scenario AND d.gnb = s.gnb AND d.slice = s.slice AND d.start = s.start
      GROUP BY s.scenario, s.gnb, s.slice, s.start)
GROUP BY scenario, gnb, slice HAVING sum(n) > 0""")
oracle("parameter_drift", """
SELECT slice, gnb, l2, divergence, n_vectors, l2_mean FROM (
  SELECT slice, gnb, count(*) AS n_vectors, round(avg(d), 6) AS l2_mean
  FROM (SELECT slice, gnb, sqrt(list_sum(list_transform(range(len(e)), lambda i:
               (CAST(e[i + 1] AS DOUBLE) - CAST(a[i + 1] AS DOUBLE)) ** 2))) AS d
        FROM (SELECT CASE label % 3 WHEN 0 THEN 'eMBB' WHEN 1 THEN 'URLLC' ELSE 'mMTC' END AS slice,
                     CASE vec_id % 3 WHEN 0 THEN 'Macro' WHEN 1 THEN 'Commerce' ELSE 'Industrie' END AS gnb,
                     embedding AS e FROM embeddings) JOIN model_ends USING (slice, gnb))
  GROUP BY slice, gnb) JOIN (
SELECT slice, gnb, round(sqrt(sum((final - initial) ** 2)), 6) AS l2, max(divergence) AS divergence
FROM model_rows LEFT JOIN (
  SELECT slice, round(sum(norm), 6) AS divergence FROM (
    SELECT m.slice, m.gnb, m.param, sqrt(sum((m.final - r.final) ** 2)) AS norm
    FROM model_rows m
    JOIN (SELECT * FROM model_rows QUALIFY gnb = min(gnb) OVER (PARTITION BY slice)) r
      ON r.slice = m.slice AND r.idx = m.idx AND r.gnb <> m.gnb
    GROUP BY m.slice, m.gnb, m.param) GROUP BY slice) USING (slice)
GROUP BY slice, gnb) USING (slice, gnb)""")

COLS = [f"{c}{k}" for c in ("thr", "lat_log", "loss") for k in ("", "_trend", "_vol")]
TARGETS = ["y_thr", "y_lat_log", "y_loss"]
D = len(COLS) + 1
cte("fit_rows", "SELECT * FROM (SELECT slice, gnb, pos, series_len, CAST(1 AS DOUBLE) AS one, " + ", ".join(
    f"{c}, coalesce({c} - lag({c}) OVER s, 0) AS {c}_trend, "
    f"coalesce(stddev_samp({c}) OVER (s ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS {c}_vol, "
    f"avg({c}) OVER (s ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS y_{c}" for c in ("thr", "lat_log", "loss"))
    + """, pos + 15 < CAST(floor(series_len * 0.8) AS BIGINT) AS is_train
FROM li_logs WINDOW s AS (PARTITION BY scenario, gnb, slice ORDER BY pos)) WHERE pos < series_len - 15""")


def eliminated(system: str, keys: str, n: int) -> str:
    """Unknowns (keys, i, o, v) of ``system`` (keys, i, j, v): n columns, then right-hand sides."""
    return f"""
WITH RECURSIVE e AS (
  SELECT {keys}, 0 AS k, i, j, v FROM {system}
  UNION ALL
  SELECT {keys}, k + 1, i, j, CASE WHEN i = k THEN v / pp ELSE v - f * p / pp END
  FROM (SELECT *, max(v) FILTER (i = k) OVER (PARTITION BY {keys}, j) AS p,
               max(v) FILTER (j = k) OVER (PARTITION BY {keys}, i) AS f,
               max(v) FILTER (i = k AND j = k) OVER (PARTITION BY {keys}) AS pp FROM e WHERE k < {n}))
SELECT {keys}, i, j - {n} AS o, v FROM e WHERE k = {n} AND j >= {n}"""


X = [*COLS, "one"]
cte("fed_sums", "SELECT slice, gnb, unnest(range(" + f"{D}" + ")) AS i, unnest([" + ", ".join(
    "[" + ", ".join(f"avg({a} * {b})" for b in [*X, "y_lat_log"]) + "]" for a in X)
    + "]) AS r FROM fit_rows WHERE is_train GROUP BY slice, gnb")
cte("fed_system", f"SELECT slice, gnb, i, unnest(range({D + 1})) AS j, unnest(r) AS v FROM fed_sums")
cte("fed_local", eliminated("fed_system", "slice, gnb", D))
cte("fed_mean", "SELECT slice, i, avg(v) AS c FROM fed_local GROUP BY slice, i")
cte("fed_drawn", f"""
SELECT slice, gnb, i, j, v + CASE WHEN i = j THEN 0.01 WHEN j = {D} THEN 0.01 * c ELSE 0 END AS v
FROM fed_system JOIN fed_mean USING (slice, i)""")
cte("fed_near", eliminated("fed_drawn", "slice, gnb", D))
oracle("federated_fit", """
SELECT slice, gnb, i AS idx, round(l.v, 6) AS local, round(c, 6) AS average, round(p.v, 6) AS proximal
FROM fed_local l JOIN fed_near p USING (slice, gnb, i) JOIN fed_mean USING (slice, i)""")

# the Huber loss is minimised another way than by the engine: steps with the fixed matrix of least squares
cte("hub_scale", "SELECT slice, count(*) AS n, " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}"
    for c in COLS + TARGETS) + " FROM fit_rows WHERE is_train GROUP BY slice")
cte("hub_rows", "SELECT slice, is_train, n, [" + ", ".join(f"({c} - m_{c}) / s_{c}" for c in COLS) + ", 1.0] AS x, [" + ", ".join(
    f"({c} - m_{c}) / s_{c}" for c in TARGETS) + "] AS ys, [" + ", ".join(f"s_{c}" for c in TARGETS)
    + "] AS spread FROM fit_rows JOIN hub_scale USING (slice)")
cte("hub_long", """
SELECT slice, is_train, n, x, unnest(ys) AS y, unnest(spread) AS spread, unnest(range(3)) AS t FROM hub_rows""")
cte("hub_sums", f"SELECT slice, unnest(range({D})) AS i, unnest([" + ", ".join("[" + ", ".join(
    [f"avg(x[{i + 1}] * x[{j + 1}])" + (" + 0.0001" if i == j < D - 1 else "") for j in range(D)]
    + [f"CAST({int(i == j)} AS DOUBLE)" for j in range(D)]) + "]" for i in range(D))
    + "]) AS r FROM hub_rows WHERE is_train GROUP BY slice")
cte("hub_system", f"SELECT slice, i, unnest(range({2 * D})) AS j, unnest(r) AS v FROM hub_sums")
cte("hub_inverse", eliminated("hub_system", "slice", D))
cte("hub_matrix", """
SELECT slice, list(r ORDER BY i) AS inv FROM (SELECT slice, i, list(v ORDER BY o) AS r FROM hub_inverse GROUP BY slice, i)
GROUP BY slice""")
cte("hub_fit", f"""
WITH RECURSIVE it AS (
  SELECT slice, t, 0 AS round, list_transform(range({D}), lambda i: CAST(0 AS DOUBLE)) AS w
  FROM hub_matrix, range(3) r(t)
  UNION ALL
  SELECT slice, t, round + 1, list_transform(range({D}), lambda i: w[i + 1] + list_inner_product(inv[i + 1], g))
  FROM (SELECT slice, t, round, w, inv, [""" + ", ".join(
    f"sum(greatest(-1, least(1, r)) * x[{i + 1}]) / max(n)" + (f" - 0.0001 * w[{i + 1}]" if i < D - 1 else "") for i in range(D)) + """] AS g
        FROM (SELECT it.*, inv, x, n, y - list_inner_product(x, w) AS r
              FROM it JOIN hub_matrix USING (slice) JOIN hub_long USING (slice, t) WHERE is_train AND round < 60)
        GROUP BY slice, t, round, w, inv))
SELECT slice, t, w FROM it WHERE round = 60""")
oracle("forecast_huber", """
SELECT slice, CASE t WHEN 0 THEN 'thr' WHEN 1 THEN 'lat_log' ELSE 'loss' END AS target, max(n) AS n_train, count(*) AS n_test,
       true AS solved, round(avg(abs(list_inner_product(x, w) - y) * spread), 5) AS mae
FROM hub_long JOIN hub_fit USING (slice, t) WHERE NOT is_train GROUP BY slice, t""")

"""Time series over order totals by day, by day and priority, and by month; anomalies over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.catalogue.registry import DAILY, DAILY_BY_PRIORITY, MONTHLY, daily, daily_by_priority, monthly, query, rounded, table
from lumora.operators import anomalies as A
from lumora.operators import timeseries as T

K = ["key"]
#: A fixed day after which the level-shift series is raised.
SHIFT_DAY = "1998-03-01"
SHIFT = f"""shifted AS (SELECT ts, value + CASE WHEN ts >= TIMESTAMP '{SHIFT_DAY}' THEN 3000000 ELSE 0 END AS value FROM daily)"""


def shifted(spark, sf):
    late = F.col("ts") >= F.lit(SHIFT_DAY).cast("timestamp_ntz")
    return daily(spark, sf).select("ts", (F.col("value") + F.when(late, 3000000.0).otherwise(0.0)).alias("value"))


@query("t1_prepare_series", """SELECT o_orderpriority, o_orderdate AS ts, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2""")
def t1(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    s = T.prepare_series(o, "day", ["o_totalprice"], ["o_orderpriority"])
    return s.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("t2_rank_variables", " UNION ALL ".join(f"""SELECT '{c}' AS variable, count({c}) AS observations, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max, round((max({c}) - min({c}))::DOUBLE, 4) AS range FROM lineitem""" for c in ("l_extendedprice", "l_orderkey", "l_partkey")))
def t2(spark, sf):
    return rounded(T.rank_variables(table(spark, sf, "lineitem"), "range", 3), 4)


@query("t3_series_overview", f"""WITH {DAILY_BY_PRIORITY} SELECT key, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min, round(max(value), 4) AS max,
  round(quantile_cont(value, 0.5), 4) AS median, round(stddev_samp(value) / avg(value), 4) AS cv FROM daily_by_priority GROUP BY 1""")
def t3(spark, sf):
    return rounded(T.series_overview(daily_by_priority(spark, sf), "ts", "value", K), 4)


_MA = "CASE WHEN count(*) OVER w = {n} THEN avg(value) OVER w END"


@query("t4_moving_average", f"WITH {DAILY_BY_PRIORITY} SELECT key, ts, value, round({_MA.format(n=30)}, 4) AS moving_average FROM daily_by_priority WINDOW w AS (PARTITION BY key ORDER BY ts ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)")
def t4(spark, sf):
    return rounded(T.moving_average(daily_by_priority(spark, sf), "ts", "value", 30, K), 4)


@query("t5_seasonal_groups", f"""WITH {DAILY}, p AS (SELECT CAST(isodow(ts) - 1 AS INTEGER) AS period, value FROM daily), q AS (SELECT period, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS md, quantile_cont(value, 0.75) AS q3 FROM p GROUP BY 1),
  j AS (SELECT p.period, value AS x, q1, md, q3, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM p JOIN q ON p.period = q.period)
  SELECT period, count(*) AS count, round(max(q1), 4) AS q1, round(max(md), 4) AS median, round(max(q3), 4) AS q3, round(min(CASE WHEN ok THEN x END), 4) AS whisker_low, round(max(CASE WHEN ok THEN x END), 4) AS whisker_high, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS outliers FROM j GROUP BY 1""")
def t5(spark, sf):
    return rounded(T.seasonal_groups(daily(spark, sf), "ts", "value", "weekday"), 4)


@query("t6_ma_decompose", f"""WITH {DAILY}, m AS (SELECT ts, value, {_MA.format(n=5)} AS t FROM daily WINDOW w AS (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
  SELECT ts, value, round(t, 4) AS trend, round(value - t, 4) AS residual FROM m""")
def t6(spark, sf):
    return rounded(T.ma_decompose(daily(spark, sf).select("ts", "value"), "ts", "value", 5), 4)


_CLASSIC = f"""{MONTHLY}, i AS (SELECT ts, value, row_number() OVER (ORDER BY ts) - 1 AS k, CASE WHEN count(*) OVER a = 12 AND count(*) OVER b = 12 THEN (avg(value) OVER a + avg(value) OVER b) / 2 END AS t FROM monthly
  WINDOW a AS (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), b AS (ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)), s AS (SELECT k % 12 AS ph, avg(value - t) AS m FROM i GROUP BY 1),
  c AS (SELECT ph, m - avg(m) OVER () AS s FROM s), r AS (SELECT ts, value, t, s, value - t - s AS e FROM i JOIN c ON k % 12 = ph)"""


@query("t7_classical_decompose", f"WITH {_CLASSIC} SELECT ts, round(value, 3) AS value, round(t, 3) AS trend, round(s, 3) AS seasonal, round(e, 3) AS residual FROM r")
def t7(spark, sf):
    return rounded(T.classical_decompose(monthly(spark, sf), "ts", "value", 12), 3)


@query("t7_decomposition_metrics", f"WITH {_CLASSIC} SELECT round(stddev_samp(t), 3) AS trend_std, round(stddev_samp(s), 3) AS seasonal_std, round(stddev_samp(e), 3) AS residual_std, round(1 - var_samp(e) / var_samp(value), 6) AS explained_variance FROM r")
def t7m(spark, sf):
    parts = T.classical_decompose(monthly(spark, sf), "ts", "value", 12)
    return rounded(T.decomposition_metrics(parts, "value"), 3, explained_variance=6)


@query("t9_residual_diagnostics")
def t9(spark, sf):
    return rounded(T.residual_diagnostics(T.classical_decompose(monthly(spark, sf), "ts", "value", 12)), 4)


_ACF = """i AS (SELECT value - avg(value) OVER () AS x, row_number() OVER (ORDER BY ts) AS k, count(*) OVER () AS n FROM {src}),
  c AS (SELECT b.k - a.k AS lag, sum(a.x * b.x) AS s, max(a.n) AS n FROM i a JOIN i b ON b.k - a.k BETWEEN 0 AND {L} GROUP BY 1), r AS (SELECT CAST(lag AS INTEGER) AS lag, s / (SELECT s FROM c WHERE lag = 0) AS r, n FROM c)"""


@query("t10_acf", f"WITH {DAILY}, {_ACF.format(src='daily', L=40)} SELECT lag, round(r, 6) AS acf, n FROM r")
def t10(spark, sf):
    return rounded(T.acf(daily(spark, sf), "ts", "value", 40))


@query("t10_acf_keyed", f"""WITH {DAILY_BY_PRIORITY}, i AS (SELECT key, value - avg(value) OVER (PARTITION BY key) AS x, row_number() OVER (PARTITION BY key ORDER BY ts) AS k, count(*) OVER (PARTITION BY key) AS n FROM daily_by_priority),
  c AS (SELECT a.key, b.k - a.k AS lag, sum(a.x * b.x) AS s, max(a.n) AS n FROM i a JOIN i b ON a.key = b.key AND b.k - a.k BETWEEN 0 AND 10 GROUP BY 1, 2)
  SELECT c.key, CAST(c.lag AS INTEGER) AS lag, round(c.s / z.s, 6) AS acf, c.n FROM c JOIN c z ON c.key = z.key AND z.lag = 0""")
def t10k(spark, sf):
    return rounded(T.acf(daily_by_priority(spark, sf), "ts", "value", 10, K))


@query("t11_pacf")
def t11(spark, sf):
    return rounded(T.pacf(daily_by_priority(spark, sf), "ts", "value", 40, K))


@query("t11_pacf_two_lags", f"""WITH {DAILY}, {_ACF.format(src='daily', L=2)}, v AS (SELECT max(CASE WHEN lag = 1 THEN r END) AS a, max(CASE WHEN lag = 2 THEN r END) AS b FROM r)
  SELECT CAST(0 AS INTEGER) AS lag, 1.0::DOUBLE AS pacf FROM v UNION ALL SELECT 1, round(a, 6) FROM v UNION ALL SELECT 2, round((b - a * a) / (1 - a * a), 6) FROM v""")
def t11two(spark, sf):
    return rounded(T.pacf(daily(spark, sf), "ts", "value", 2))


@query("t12_ljung_box", f"""WITH {DAILY}, {_ACF.format(src='daily', L=10)} SELECT lag, round(n * (n + 2) * sum(r * r / (n - lag)) OVER (ORDER BY lag), 6) AS q FROM r WHERE lag > 0""")
def t12(spark, sf):
    return rounded(T.ljung_box(daily(spark, sf), "ts", "value", 10).select("lag", "q"))


@query("t13_adf_test")
def t13(spark, sf):
    return rounded(T.adf_test(daily_by_priority(spark, sf), "ts", "value", K), 4)


@query("t14_trend", f"""WITH {DAILY_BY_PRIORITY}, i AS (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY ts) - 1 AS k FROM daily_by_priority)
  SELECT key, count(*) AS n, round(regr_slope(value, k), 6) AS slope, round(regr_intercept(value, k), 3) AS intercept, round(regr_r2(value, k), 8) AS r_squared,
  CASE WHEN regr_slope(value, k) > 0 THEN 'creciente' WHEN regr_slope(value, k) < 0 THEN 'decreciente' ELSE 'estable' END AS direction FROM i GROUP BY 1""")
def t14(spark, sf):
    return rounded(T.trend(daily_by_priority(spark, sf), "ts", "value", K).drop("p_value"), 6, intercept=3, r_squared=8)


@query("t15_granger_first_lag", f"""WITH {DAILY}, i AS (SELECT value AS a, orders::DOUBLE AS b, lag(value) OVER (ORDER BY ts) AS la, lag(orders::DOUBLE) OVER (ORDER BY ts) AS lb FROM daily), u AS (SELECT 'value' AS cause, 'orders' AS effect, b AS y, lb AS x, la AS z FROM i WHERE la IS NOT NULL UNION ALL SELECT 'orders', 'value', a, la, lb FROM i WHERE la IS NOT NULL),
  s AS (SELECT cause, effect, count(*) AS n, var_pop(y) AS yy, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, covar_pop(x, z) AS xz FROM u GROUP BY 1, 2),
  r AS (SELECT *, n * (yy - xy * xy / xx) AS rr, n * (yy - (zz * xy * xy - 2 * xz * xy * zy + xx * zy * zy) / (xx * zz - xz * xz)) AS ru FROM s)
  SELECT cause, effect, CAST(1 AS INTEGER) AS lag, round((rr - ru) / (ru / (n - 3)), 4) AS f FROM r""")
def t15one(spark, sf):
    d = daily(spark, sf).withColumn("orders", F.col("orders").cast("double"))
    return rounded(T.granger(d, "ts", ["value", "orders"], 1).drop("p_value"), 4)


@query("t15_granger")
def t15(spark, sf):
    return rounded(T.granger(daily(spark, sf).withColumn("orders", F.col("orders").cast("double")), "ts", ["value", "orders"], 4), 5)


@query("t18_segment_stats", f"""WITH {DAILY}, {SHIFT}, i AS (SELECT ts, value, row_number() OVER (ORDER BY ts) - 1 AS k FROM shifted)
  SELECT CAST(CASE WHEN k < 600 THEN 1 WHEN k < 1200 THEN 2 ELSE 3 END AS INTEGER) AS segment, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS length, round(avg(value), 3) AS mean, round(stddev_samp(value), 3) AS std, round(min(value), 3) AS min, round(max(value), 3) AS max FROM i GROUP BY 1""")
def t18(spark, sf):
    return rounded(T.segment_stats(shifted(spark, sf), "ts", "value", [600, 1200]), 3)


@query("t19_anomalies_z", "WITH m AS (SELECT event_type, avg(value) AS a, stddev_samp(value) AS s FROM events GROUP BY 1) SELECT event_id, e.event_type, value FROM events e JOIN m ON e.event_type = m.event_type WHERE abs((value - a) / s) > 2.5")
def t19(spark, sf):
    return A.anomalies_z(table(spark, sf, "events").select("event_id", "event_type", "value"), "value", 2.5, ["event_type"])


@query("t19_anomalies_iqr", "WITH m AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) SELECT event_id, e.event_type, value FROM events e JOIN m ON e.event_type = m.event_type WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)")
def t19i(spark, sf):
    return A.anomalies_iqr(table(spark, sf, "events").select("event_id", "event_type", "value"), "value", 1.5, ["event_type"])


@query("t20_anomalies_dbscan", """WITH z AS (SELECT event_id, user_id, value, (value - avg(value) OVER w) / stddev_pop(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY user_id)),
  n AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY z RANGE BETWEEN 0.25 PRECEDING AND 0.25 FOLLOWING) AS k FROM z),
  c AS (SELECT *, sum(CASE WHEN k >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY z RANGE BETWEEN 0.25 PRECEDING AND 0.25 FOLLOWING) AS cores FROM n) SELECT event_id, user_id, value FROM c WHERE k < 5 AND cores = 0""")
def t20(spark, sf):
    return A.anomalies_dbscan(table(spark, sf, "events").select("event_id", "user_id", "value"), "value", ["event_id"], 0.25, 5, ["user_id"])


@query("t21_anomalies_lof", """WITH p AS (SELECT event_id, value, stddev_pop(value) OVER () AS s, row_number() OVER (ORDER BY value, event_id) AS pos FROM events),
  n AS (SELECT a.pos, b.pos AS near, abs(a.value - b.value) / a.s AS d, row_number() OVER (PARTITION BY a.pos ORDER BY abs(a.value - b.value), b.pos) AS r FROM p a JOIN p b ON b.pos BETWEEN a.pos - 20 AND a.pos + 20 AND a.pos <> b.pos QUALIFY r <= 20),
  k AS (SELECT pos, max(d) AS kd FROM n GROUP BY 1), l AS (SELECT n.pos, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN k ON k.pos = n.near GROUP BY 1),
  f AS (SELECT n.pos, avg(b.lrd) / max(a.lrd) AS lof FROM n JOIN l b ON b.pos = n.near JOIN l a ON a.pos = n.pos GROUP BY 1), c AS (SELECT quantile_cont(lof, 0.9) AS cut FROM f)
  SELECT event_id, value, round(lof, 5) AS lof FROM p JOIN f ON p.pos = f.pos, c WHERE lof > cut""")
def t21(spark, sf):
    return rounded(A.anomalies_lof(table(spark, sf, "events").select("event_id", "value"), "value", ["event_id"]), 5)


@query("t23_anomaly_summary", """WITH m AS (SELECT avg(value) AS a, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM events)
  SELECT 'z' AS method, count(*) FILTER (abs((value - a) / s) > 2) AS anomalies, round(count(*) FILTER (abs((value - a) / s) > 2) * 100.0 / max(n), 6) AS pct FROM events, m
  UNION ALL SELECT 'iqr', count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)), round(count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) * 100.0 / max(n), 6) FROM events, m""")
def t23(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return rounded(A.anomaly_summary(e, {"z": A.anomalies_z(e, "value", 2.0), "iqr": A.anomalies_iqr(e, "value")}))


@query("t31_future_dates", f"""WITH {MONTHLY}, d AS (SELECT 'month' AS key, max(ts) AS m FROM monthly) SELECT CAST(s AS INTEGER) AS step, m + to_months(CAST(s AS INTEGER)) AS ts FROM d, (SELECT unnest(range(1, 13)) AS s)""")
def t31(spark, sf):
    return T.future_dates(monthly(spark, sf), "ts", 12)


@query("t31_future_dates_keyed", f"""WITH {DAILY_BY_PRIORITY}, g AS (SELECT key, ts, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY key ORDER BY ts)) AS gap FROM daily_by_priority), m AS (SELECT key, max(ts) AS m, quantile_cont(gap, 0.5) AS gap FROM g GROUP BY 1)
  SELECT key, CAST(s AS INTEGER) AS step, m + to_seconds(CAST(gap * s AS BIGINT)) AS ts FROM m, (SELECT unnest(range(1, 6)) AS s)""")
def t31k(spark, sf):
    return T.future_dates(daily_by_priority(spark, sf), "ts", 5, K)


@query("t32_series_summary", f"""WITH {DAILY}, i AS (SELECT ts, value, orders::DOUBLE AS orders, row_number() OVER (ORDER BY ts) - 1 AS k FROM daily), u AS (SELECT 'value' AS v, ts, k, value AS x FROM i UNION ALL SELECT 'orders', ts, k, orders FROM i),
  s AS (SELECT v, regr_slope(x, k) AS sl, corr(x, k) * sqrt((count(*) - 2) / (1 - corr(x, k) * corr(x, k))) AS t, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM u GROUP BY 1),
  mv AS (SELECT v, month(ts) AS m, var_samp(x) AS w FROM u GROUP BY 1, 2), se AS (SELECT v, stddev_samp(w) > avg(w) * 0.5 AS f FROM mv GROUP BY 1),
  o AS (SELECT u.v, count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) > 0 AS h FROM u JOIN s ON u.v = s.v GROUP BY 1),
  a AS (SELECT bool_or(abs(t) > 1.961 AND sl > 0) AS up, bool_or(abs(t) > 1.961 AND sl <= 0) AS down FROM s), b AS (SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM daily),
  g AS (SELECT coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM se WHERE f), '') AS sv, coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM o WHERE h), '') AS ov, (SELECT count(*) FROM o WHERE h) AS oc)
  SELECT n, first_ts, last_ts, CAST(date_diff('day', first_ts, last_ts) AS INTEGER) AS period_days, CAST(2 AS INTEGER) AS variables, CASE WHEN up THEN 'Creciente' WHEN down THEN 'Decreciente' ELSE 'Estable' END AS overall_trend, sv AS seasonal_variables, ov AS outlier_variables,
  0.0::DOUBLE AS missing_pct, 'Excelente' AS quality, concat_ws(',', CASE WHEN oc > 1 THEN 'many_outlier_variables' END, CASE WHEN n < 30 THEN 'few_observations' END, CASE WHEN sv = '' AND n > 365 THEN 'no_seasonality' END) AS alerts, CASE WHEN n >= 100 THEN 'Excelente' ELSE 'Buena' END AS recommendation FROM a, b, g""")
def t32(spark, sf):
    return rounded(T.series_summary(daily(spark, sf), "ts", ["value", "orders"]))

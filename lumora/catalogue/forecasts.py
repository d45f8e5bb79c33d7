"""Decomposition, change points and forecasts over order totals by day, by day and priority, and by month."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.catalogue.registry import DAILY, DAILY_BY_PRIORITY, MONTHLY, daily, daily_by_priority, monthly, query, rounded
from lumora.catalogue.timeseries import SHIFT, shifted
from lumora.operators import decomposition as D
from lumora.operators import forecasting as FC

K = ["key"]


@query("t8_stl_decompose")
def t8(spark, sf):
    return rounded(D.stl_decompose(monthly(spark, sf), "ts", "value", 12), 2)


@query("t16_change_points_window", f"""WITH {DAILY}, {SHIFT}, g AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS k, CASE WHEN count(*) OVER l = 20 AND count(*) OVER r = 20 THEN power(avg(value) OVER l - avg(value) OVER r, 2) * 10 END AS g FROM shifted
  WINDOW l AS (ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), r AS (ORDER BY ts ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)), p AS (SELECT *, max(g) OVER (ORDER BY k ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING) AS m FROM g)
  SELECT k AS position, ts, round(g / 1e9, 3) AS gain FROM p WHERE g = m AND g > 0 ORDER BY g DESC LIMIT 5""")
def t16(spark, sf):
    found = D.change_points_window(shifted(spark, sf), "ts", "value")
    return rounded(found.withColumn("gain", F.col("gain") / 1e9), 3)


@query("t17_change_points")
def t17(spark, sf):
    late = F.col("ts") >= F.lit("1998-03-01").cast("timestamp_ntz")
    s = daily_by_priority(spark, sf).withColumn("value", F.col("value") + F.when(late, 1500000.0).otherwise(0.0))
    return D.change_points(s, "ts", "value", keys=K)


@query("t24_forecast_linear", f"""WITH {MONTHLY}, i AS (SELECT ts, value, row_number() OVER (ORDER BY ts) - 1 AS k FROM monthly), l AS (SELECT regr_slope(value, k) AS a, regr_intercept(value, k) AS b, count(*) AS n, max(ts) AS m FROM i)
  SELECT CAST(s AS INTEGER) AS step, round(b + a * (n - 1 + s), 3) AS forecast, m + to_months(CAST(s AS INTEGER)) AS ts FROM l, (SELECT unnest(range(1, 6)) AS s)""")
def t24(spark, sf):
    return rounded(FC.forecast_linear(monthly(spark, sf), "ts", "value", 5), 3)


@query("t25_forecast_arima")
def t25(spark, sf):
    return rounded(FC.forecast_arima(daily_by_priority(spark, sf), "ts", "value", 12, K), 2)


@query("t26_forecast_sarima")
def t26(spark, sf):
    return rounded(FC.forecast_sarima(monthly(spark, sf), "ts", "value", 12), 2)


@query("t27_forecast_holt_winters")
def t27(spark, sf):
    return rounded(FC.forecast_holt_winters(daily_by_priority(spark, sf), "ts", "value", 14, 7, K), 2)


# Series whose continuation is known: a straight line, with a fixed pattern where the model has a season, over the days or months of the orders.
WEEK, YEAR = [0, 3, -2, 5, -4, 1, -3], [10, 7, 1, -4, -8, -11, -9, -3, 0, 3, 6, 8]


def straight(series, keys, pattern=(0,)):
    from lumora.plans.order import ordered_index

    placed = ordered_index(series, ["ts"], keys)
    wave = F.array(*[F.lit(float(v)) for v in pattern])[(F.col("_pos") % len(pattern)).cast("int")]
    return placed.select(*keys, "ts", (1000 + 2.5 * F.col("_pos") + wave).alias("value"))


def _straight_sql(horizon, pattern=(0,)):
    wave = f"CAST(([{', '.join(map(str, pattern))}])[(n - 1 + s) % {len(pattern)} + 1] AS DOUBLE)"
    return f"SELECT key, CAST(s AS INTEGER) AS step, 1000 + 2.5 * (n - 1 + s) + {wave} AS forecast FROM (SELECT key, count(*) AS n FROM daily_by_priority GROUP BY 1), (SELECT unnest(range(1, {horizon + 1})) AS s)"


@query("t25_arima_on_lines", f"WITH {DAILY_BY_PRIORITY} {_straight_sql(12)}")
def t25_lines(spark, sf):
    return rounded(FC.forecast_arima(straight(daily_by_priority(spark, sf), K), "ts", "value", 12, K).select("key", "step", "forecast"), 2)


@query("t26_sarima_on_seasons", f"WITH {MONTHLY}, daily_by_priority AS (SELECT 'all' AS key, ts FROM monthly) {_straight_sql(12, YEAR)}")
def t26_seasons(spark, sf):
    found = FC.forecast_sarima(straight(monthly(spark, sf), [], YEAR), "ts", "value", 12)
    return rounded(found.select(F.lit("all").alias("key"), "step", "forecast"), 2)


@query("t27_holt_winters_on_seasons", f"WITH {DAILY_BY_PRIORITY} SELECT key, step, 2 * forecast AS forecast FROM ({_straight_sql(14, WEEK)})")
def t27_seasons(spark, sf):
    s = straight(daily_by_priority(spark, sf), K, WEEK).withColumn("value", F.col("value") * 2)
    # whole numbers: start values taken from the first two seasons fade, but never quite
    return rounded(FC.forecast_holt_winters(s, "ts", "value", 14, 7, K).select("key", "step", "forecast"), 0)


@query("t29_seasonal_regression_on_lines", f"WITH {DAILY_BY_PRIORITY} SELECT key, CAST(s AS INTEGER) AS step, 1000.0::DOUBLE AS height FROM (SELECT DISTINCT key FROM daily_by_priority), (SELECT unnest(range(1, 31)) AS s)")
def t29_lines(spark, sf):
    risen = F.datediff("ts", F.lit("1992-01-01").cast("date")) * 0.5
    s = daily_by_priority(spark, sf).select("key", "ts", (1000 + risen).alias("value"))
    found = FC.forecast_seasonal_regression(s, "ts", "value", 30, keys=K)
    return rounded(found.select("key", "step", (F.col("forecast") - risen).alias("height")), 2)


@query("t28_forecast_var")
def t28(spark, sf):
    return rounded(FC.forecast_var(daily(spark, sf), "ts", ["value", "orders"], 10), 2)


@query("t29_forecast_seasonal_regression")
def t29(spark, sf):
    return rounded(FC.forecast_seasonal_regression(daily_by_priority(spark, sf), "ts", "value", 30, keys=K), 2)


@query("t30_best_model", f"""WITH {DAILY}, p AS (SELECT ts, value, lag(value) OVER (ORDER BY ts) AS last, avg(value) OVER (ORDER BY ts ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS mean FROM daily),
  m AS (SELECT 'last' AS model, value AS y, last AS f FROM p WHERE last IS NOT NULL UNION ALL SELECT 'mean', value, mean FROM p WHERE mean IS NOT NULL),
  r AS (SELECT model, count(*) AS n, avg((y - f) * (y - f)) AS mse, avg(abs(y - f)) AS mae, var_pop(y) AS v, avg(abs((y - f) / y)) AS ape FROM m GROUP BY 1)
  SELECT model, n, round(1 - mse / v, 6) AS r2, round(sqrt(mse), 3) AS rmse, round(mae, 3) AS mae, round(mse / 1e6, 2) AS mse, round(ape * 100, 4) AS mape, mse = min(mse) OVER () AS best FROM r""")
def t30(spark, sf):
    from lumora.operators.timeseries import positions
    from lumora.plans.order import sliding

    d = daily(spark, sf).select("ts", "value")
    placed, small = positions(d)
    naive = sliding(placed, "_pos", 7, 0, lambda w: {"last": F.lag("value", 1).over(w), "mean": F.avg("value").over(w.rowsBetween(-7, -1))}, (), small)
    forecasts = {m: naive.select("ts", F.col(m).alias("forecast")).where("forecast is not null") for m in ("last", "mean")}
    out = FC.best_model(d, forecasts, "ts", "value")
    return rounded(out.withColumn("mse", F.col("mse") / 1e6), 3, r2=6, mse=2, mape=4)

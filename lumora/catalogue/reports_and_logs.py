"""Reports over orders with gaps; log lines and metric records derived from all events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.catalogue.registry import GAPS, gaps, query, rounded, table
from lumora.catalogue.tables_and_quality import _LEVEL
from lumora.operators import logs as L
from lumora.operators import report as R
from lumora.sources import sinks as K
from lumora.streaming import logs as SL


@query("r1_executive_summary", f"""WITH {GAPS}, {_LEVEL} SELECT CAST(total_cells // 6 AS BIGINT) AS total_observations, CAST(5 AS BIGINT) AS total_variables, CAST(3 AS BIGINT) AS numeric_variables, CAST(2 AS BIGINT) AS categorical_variables,
  round(100 - pct, 6) AS completeness_rate, round(least(100, greatest(0, (100 - pct) * 0.7 + 3.0 / 5 * 30)), 6) AS data_quality_score, CASE WHEN 100 - pct > 90 THEN 'excellent_completeness' WHEN 100 - pct > 75 THEN 'good_completeness' ELSE 'low_completeness' END AS finding FROM level""")
def r1(spark, sf):
    return rounded(R.executive_numbers(gaps(spark, sf)))


@query("r2_quality_section")
def r2(spark, sf):
    return R.quality_section(gaps(spark, sf))


@query("r3_descriptive_section")
def r3(spark, sf):
    return R.descriptive_section(gaps(spark, sf))


@query("r4_correlation_section")
def r4(spark, sf):
    return R.correlation_section(table(spark, sf, "lineitem"))


@query("r5_temporal_section", f"WITH {GAPS} " + " UNION ALL ".join(f"""SELECT 'o_orderdate_{c}' AS pair, count(*) AS n, round(regr_slope(v, k), {d}) AS slope, round(regr_r2(v, k), 6) AS r_squared,
  CASE WHEN regr_slope(v, k) > 0 THEN 'creciente' WHEN regr_slope(v, k) < 0 THEN 'decreciente' ELSE 'estable' END AS direction FROM (SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY o_orderdate, {c}) - 1 AS k FROM gaps WHERE {c} IS NOT NULL)""" for c, d in (("o_orderkey", 6), ("o_custkey", 6), ("o_totalprice", 6))))
def r5(spark, sf):
    return rounded(R.temporal_trends(gaps(spark, sf)))


@query("r6_ml_section")
def r6(spark, sf):
    return R.ml_section(table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query("r7_report")
def r7(spark, sf):
    return R.report(gaps(spark, sf), "complete")


@query("r7_executive_report")
def r7e(spark, sf):
    return R.report(gaps(spark, sf), "executive")


@query("r8_text_report")
def r8(spark, sf):
    return R.text_report(gaps(spark, sf))


@query("r9_report_contract_check", "SELECT true AS has_metadata, true AS has_sections, true AS tests_valid, count(*) > 0 AS valid FROM orders")
def r9(spark, sf):
    return R.report_contract_check(R.report(gaps(spark, sf), "quality"))


@query("r10_insight_counts", f"""WITH {GAPS}, {_LEVEL}, r AS (SELECT 100 - pct AS c FROM level), k AS (SELECT CAST(1 AS BIGINT) AS f, CAST(8 + CASE WHEN c < 90 THEN 1 ELSE 0 END AS BIGINT) AS rec FROM r)
  SELECT 'finding' AS kind, f AS insights FROM k UNION ALL SELECT 'recommendation', rec FROM k UNION ALL SELECT 'total', f + rec FROM k""")
def r10(spark, sf):
    return R.insight_counts(R.report(gaps(spark, sf), "quality"))


@query("k3_report_sinks")
def k3(spark, sf):
    """The quality report written as JSON, Markdown, HTML and text, read back as lines."""
    rows = R.report(gaps(spark, sf), "quality")
    folder = K.workspace(spark)
    out = None
    for style in ("json", "markdown", "html", "text"):
        K.write_report(rows, f"{folder}/{style}", style)
        part = spark.read.text(f"{folder}/{style}").select(F.lit(style).alias("style"), "value")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- logs

CUTOFF = "2024-01-10 00:00:00"


def log_lines(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind == "signup", "WARNING").when(kind == "click", "DEBUG").otherwise("INFO")
    text = (
        F.when(kind == "error", "Exception: request timeout").when(kind == "signup", "new user login").when(kind == "purchase", "data ingestion done")
        .otherwise("page shown"))
    stamp = F.when(kind == "view", F.lit("no time")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select(
        F.concat(F.lit("app-"), (F.col("user_id") % 5).cast("string"), F.lit(".log")).alias("file"), F.col("event_id").alias("line_no"),
        F.concat_ws(" - ", stamp, F.lit("svc"), level, text).alias("line"))


LOG = """log AS (SELECT 'app-' || (user_id % 5) || '.log' AS file, event_id AS line_no, event_type AS k, CASE WHEN event_type <> 'view' THEN date_trunc('second', ts) END AS t,
  CASE WHEN event_type = 'view' THEN 'no time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END || ' - svc - ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'click' THEN 'DEBUG' ELSE 'INFO' END || ' - ' ||
  CASE event_type WHEN 'error' THEN 'Exception: request timeout' WHEN 'signup' THEN 'new user login' WHEN 'purchase' THEN 'data ingestion done' ELSE 'page shown' END AS line FROM events)"""
_IN = f"(t IS NULL OR t >= TIMESTAMP '{CUTOFF}')"
_FLAGS = {"exception": "exception|traceback|error:", "performance": "performance|slow|timeout|memory", "user_action": "user|login|logout|upload|download", "data_processing": "data|processing|analysis|ingestion"}
_LV = "CASE WHEN regexp_matches(lower(line), 'error|critical|fatal') THEN 'error' WHEN regexp_matches(lower(line), 'warning|warn') THEN 'warning' WHEN regexp_matches(lower(line), 'info') THEN 'info' WHEN regexp_matches(lower(line), 'debug') THEN 'debug' END"


@query("l1_parse_log", f"WITH {LOG} SELECT file, line_no, t AS ts FROM log WHERE {_IN}")
def l1(spark, sf):
    return L.recent_log(log_lines(spark, sf), CUTOFF).select("file", "line_no", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("l2_classify_log", f"WITH {LOG} SELECT file, line_no, {_LV} AS level, " + ", ".join(f"regexp_matches(lower(line), '{p}') AS is_{n}" for n, p in _FLAGS.items()) + " FROM log")
def l2(spark, sf):
    return L.classify_log(log_lines(spark, sf)).drop("line")


_COUNTS = "count(*) AS lines, " + ", ".join(f"count(*) FILTER ({_IN} AND lv = '{n}') AS {n}_lines" for n in ("error", "warning", "info", "debug")) + ", " + ", ".join(
    f"count(*) FILTER ({_IN} AND regexp_matches(lower(line), '{p}')) AS {n}_lines" for n, p in _FLAGS.items())


@query("l3_log_summary", f"WITH {LOG}, m AS (SELECT *, {_LV} AS lv FROM log), s AS (SELECT file, {_COUNTS} FROM m GROUP BY 1) SELECT *, " + ", ".join(
    f"round({n}_lines * 100.0 / lines, 6) AS {n}_pct" for n in ("error", "warning", "info", "debug")) + " FROM s")
def l3(spark, sf):
    return rounded(L.log_summary(log_lines(spark, sf), cutoff=CUTOFF))


@query("l3_first_lines", f"""WITH {LOG}, m AS (SELECT *, {_LV} AS level FROM log), r AS (SELECT file, level, row_number() OVER (PARTITION BY file, level ORDER BY line_no) AS rank, line_no, line FROM m WHERE {_IN} AND level IN ('error', 'warning'))
  SELECT file, level, CAST(rank AS INTEGER) AS rank, line_no, line FROM r WHERE rank <= 5""")
def l3f(spark, sf):
    return L.first_lines(log_lines(spark, sf), errors=5, warnings=5, cutoff=CUTOFF)


@query("l4_log_alerts", f"""WITH {LOG}, m AS (SELECT *, {_LV} AS lv FROM log), s AS (SELECT {_COUNTS} FROM m), a AS (SELECT 'error_rate' AS alert, error_lines * 1.0 / lines AS amount, 0.1 AS lim FROM s UNION ALL SELECT 'warning_rate', warning_lines * 1.0 / lines, 0.2 FROM s
  UNION ALL SELECT 'exceptions', exception_lines, 10 FROM s UNION ALL SELECT 'performance', performance_lines, 5 FROM s) SELECT alert, round(amount::DOUBLE, 6) AS amount FROM a WHERE amount > lim""")
def l4(spark, sf):
    return rounded(L.log_alerts(L.log_totals(L.log_summary(log_lines(spark, sf), cutoff=CUTOFF))))


@query("k4_log_export", f"WITH {LOG}, m AS (SELECT *, {_LV} AS lv FROM log) SELECT file, count(*) AS lines, count(*) FILTER (lv = 'error') AS error_lines, CAST(24 AS BIGINT) AS hours FROM m GROUP BY 1")
def k4(spark, sf):
    folder = K.workspace(spark)
    K.write_log_analysis(L.log_summary(log_lines(spark, sf)), folder)
    return spark.read.json(folder).select("file", "lines", "error_lines", F.col("analysis_duration_hours").alias("hours"))


@query("l5_tail_logs", f"""WITH {LOG}, m AS (SELECT line, t AS ts, CASE WHEN regexp_matches(lower(line), 'error|critical|fatal') THEN 'error' WHEN regexp_matches(lower(line), 'warning|warn') THEN 'warning' WHEN regexp_matches(lower(line), 'exception|traceback|error:') THEN 'exception'
  WHEN regexp_matches(lower(line), 'performance|slow|timeout|memory') THEN 'performance' END AS kind FROM log) SELECT line, ts, kind FROM m WHERE kind IS NOT NULL""")
def l5(spark, sf):
    folder = K.workspace(spark)
    log_lines(spark, sf).select("line").write.text(f"{folder}/in")
    stream = SL.tail_logs(SL.read_log_stream(spark, f"{folder}/in"))
    return SL.run_once(stream, f"{folder}/out", f"{folder}/state").select("line", F.col("ts").cast("timestamp_ntz").alias("ts"), "kind")


@query("l6_stream_window_counts", f"""WITH {LOG}, m AS (SELECT *, {_LV} AS lv FROM log WHERE t IS NOT NULL), w AS (SELECT time_bucket(INTERVAL 6 HOUR, t) AS window_start, count(*) AS lines, count(*) FILTER (lv = 'error') AS error_lines, count(*) FILTER (lv = 'warning') AS warning_lines FROM m GROUP BY 1)
  SELECT window_start, lines, error_lines, warning_lines FROM w WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(t) FROM m) - INTERVAL 10 MINUTE""")
def l6(spark, sf):
    folder = K.workspace(spark)
    log_lines(spark, sf).select("line").write.text(f"{folder}/in")
    stream = SL.window_counts(SL.read_log_stream(spark, f"{folder}/in"), "6 hours")
    done = SL.run_once(stream, f"{folder}/out", f"{folder}/state")
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "lines", "error_lines", "warning_lines")


@query("l6_window_alerts", f"""WITH {LOG}, m AS (SELECT *, {_LV} AS lv FROM log WHERE t IS NOT NULL), w AS (SELECT time_bucket(INTERVAL 6 HOUR, t) AS s, count(*) AS n, count(*) FILTER (lv = 'error') AS e, count(*) FILTER (lv = 'warning') AS w,
  count(*) FILTER (regexp_matches(lower(line), 'exception|traceback|error:')) AS x, count(*) FILTER (regexp_matches(lower(line), 'performance|slow|timeout|memory')) AS p FROM m GROUP BY 1),
  a AS (SELECT s, 'error_rate' AS alert, e / n AS amount, 0.1 AS lim FROM w UNION ALL SELECT s, 'warning_rate', w / n, 0.2 FROM w UNION ALL SELECT s, 'exceptions', x, 10 FROM w UNION ALL SELECT s, 'performance', p, 5 FROM w)
  SELECT s AS window_start, alert, round(amount::DOUBLE, 6) AS amount FROM a WHERE amount > lim""")
def l6a(spark, sf):
    found = SL.stream_alerts(log_lines(spark, sf), "6 hours")
    return rounded(found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "alert", "amount"))


# ---------------------------------------------------------------- metrics

def metric_records(spark, sf):
    """One JSON record per event, written and read back."""
    e = table(spark, sf, "events")
    folder = K.workspace(spark)
    v = F.col("value")
    record = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.struct((v / 5).alias("percent"), F.lit(8).alias("count")).alias("cpu"),
        F.struct((v / 8).alias("percent"), F.lit(16.0).alias("available_gb"), F.lit(8.0).alias("used_gb")).alias("memory"),
        F.struct((v / 10).alias("percent"), F.lit(100.0).alias("free_gb")).alias("disk"))
    e.select(F.to_json(record).alias("value")).write.text(folder)
    return spark.read.schema(L.METRIC_SCHEMA).json(folder)


_METRIC = f"""m AS (SELECT value FROM events WHERE date_trunc('second', ts) > TIMESTAMP '{CUTOFF}'), s AS (SELECT r.resource, count(*) AS records, round(avg(value / r.k), 6) AS mean, round(max(value / r.k), 6) AS max, round(min(value / r.k), 6) AS min
  FROM m, (VALUES ('cpu', 5), ('memory', 8), ('disk', 10)) r(resource, k) GROUP BY 1)"""


@query("l7_metric_summary", f"WITH {_METRIC} SELECT * FROM s")
def l7(spark, sf):
    return rounded(L.metric_summary(metric_records(spark, sf), CUTOFF))


@query("l8_metric_alerts", f"WITH {_METRIC} SELECT resource, max FROM s WHERE max > 90")
def l8(spark, sf):
    return rounded(L.metric_alerts(L.metric_summary(metric_records(spark, sf), CUTOFF)))

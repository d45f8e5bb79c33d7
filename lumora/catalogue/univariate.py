"""Univariate statistics over line items, orders with gaps and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.catalogue.registry import GAPS, gaps, query, rounded, table
from lumora.operators import univariate as U

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXT = ["o_orderstatus", "o_orderpriority"]


def each(cols, select, source):
    return " UNION ALL ".join(f"SELECT '{c}' AS variable, {select.replace('{c}', c)} FROM {source}" for c in cols)


def _q(p, c="{c}"):
    return f"quantile_cont({c}, {p})"


@query("d1_describe_numeric", each(NUM, f"""count({{c}}) AS count, round(avg({{c}}), 6) AS mean, round(stddev_samp({{c}}), 6) AS std, round(min({{c}}), 6) AS min,
  round({_q(.25)}, 6) AS q25, round({_q(.5)}, 6) AS q50, round({_q(.75)}, 6) AS q75, round(max({{c}}), 6) AS max, round({_q(.75)} - {_q(.25)}, 6) AS iqr""", "lineitem"))
def d1(spark, sf):
    return rounded(U.describe_numeric(table(spark, sf, "lineitem"), NUM))


def _extended(c, source):
    q = {n: f"quantile_cont({c}, {p})" for n, p in (("q1", .01), ("q5", .05), ("q10", .1), ("q25", .25), ("median", .5), ("q75", .75), ("q90", .9), ("q95", .95), ("q99", .99))}
    qs = ", ".join(f"round({e}, 4) AS {n}" for n, e in q.items())
    return f"""SELECT '{c}' AS variable, count({c}) AS count, round(avg({c}), 4) AS mean,
      (SELECT round({c}, 4) FROM (SELECT {c}, count(*) AS k FROM {source} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)) AS mode,
      round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 2) AS variance, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(max({c}) - min({c}), 4) AS range,
      round({q['q75']} - {q['q25']}, 4) AS iqr, round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis, round(stddev_samp({c}) * 100 / avg({c}), 4) AS cv,
      count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 4) AS missing_pct, {qs} FROM {source}"""


@query("d2_extended_stats", f"WITH {GAPS} " + _extended("o_totalprice", "gaps") + " UNION ALL " + _extended("o_custkey", "gaps"))
def d2(spark, sf):
    return rounded(U.extended_stats(gaps(spark, sf), ["o_totalprice", "o_custkey"]), 4, variance=2)


@query("d3_describe_categorical", f"WITH {GAPS}, " + ", ".join(
    f"c_{c} AS (SELECT {c} AS value, count(*) AS k, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM gaps WHERE {c} IS NOT NULL GROUP BY 1)" for c in TEXT) + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, (SELECT count({c}) FROM gaps) AS count, (SELECT count(*) FROM c_{c}) AS unique, value AS top, k AS top_count,
  round(k * 100.0 / (SELECT count(*) FROM gaps), 6) AS top_pct, (SELECT count(*) - count({c}) FROM gaps) AS missing,
  (SELECT string_agg(value || ':' || k, '|' ORDER BY r) FROM c_{c} WHERE r <= 10) AS top10 FROM c_{c} WHERE r = 1""" for c in TEXT))
def d3(spark, sf):
    return rounded(U.describe_categorical(gaps(spark, sf), TEXT))


@query("d4_frequency_table", f"""WITH {GAPS} SELECT o_orderpriority AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(o_orderpriority) FROM gaps), 6) AS pct
  FROM gaps WHERE o_orderpriority IS NOT NULL GROUP BY 1 UNION ALL SELECT 'TOTAL', count(o_orderpriority), 100.0 FROM gaps""")
def d4(spark, sf):
    return rounded(U.frequency_table(gaps(spark, sf), "o_orderpriority"))


@query("d5_category_diversity", " UNION ALL ".join(f"""SELECT '{c}' AS variable, round(-sum(p * log2(p)), 6) AS entropy, round(1 - sum(p * p), 6) AS gini,
  round(1 / sum(p * p), 6) AS effective_categories, round(max(p), 6) AS concentration FROM (SELECT count(*) * 1.0 / sum(count(*)) OVER () AS p FROM part GROUP BY {c})""" for c in ("p_type", "p_brand")))
def d5(spark, sf):
    return rounded(U.category_diversity(table(spark, sf, "part"), ["p_type", "p_brand"]))


@query("d6_ks_normal")
def d6(spark, sf):
    return U.ks_normal(table(spark, sf, "lineitem"), "l_extendedprice")


_G = "count({c}) AS n, skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)) AS s, kurtosis_pop({c}) AS k"


@query("d7_jarque_bera", f"WITH g AS ({each(NUM, _G, 'lineitem')}), j AS (SELECT *, n / 6.0 * (s * s + k * k / 4) AS jb FROM g) SELECT variable, n, round(jb, 4) AS statistic, round(exp(-jb / 2), 6) AS p_value, exp(-jb / 2) > 0.05 AS normal FROM j")
def d7(spark, sf):
    return rounded(U.jarque_bera(table(spark, sf, "lineitem"), NUM), 6, statistic=4)


@query("d8_dagostino_k2", f"""WITH g AS ({each(NUM, _G, 'lineitem')}), a AS (SELECT variable, n, n::DOUBLE AS m, s, k FROM g),
  b AS (SELECT *, s * sqrt((m+1)*(m+3)/(6*(m-2))) AS y, sqrt(2*(3*(m*m+27*m-70)*(m+1)*(m+3)/((m-2)*(m+5)*(m+7)*(m+9)) - 1)) - 1 AS w2,
    (k + 3 - 3*(m-1)/(m+1)) / sqrt(24*m*(m-2)*(m-3)/((m+1)*(m+1)*(m+3)*(m+5))) AS x,
    6*(m*m-5*m+2)/((m+7)*(m+9)) * sqrt(6*(m+3)*(m+5)/(m*(m-2)*(m-3))) AS r FROM a),
  c AS (SELECT *, asinh(y / sqrt(2/(w2-1))) / sqrt(0.5*ln(w2)) AS z1, 6 + 8/r*(2/r + sqrt(1+4/(r*r))) AS aa FROM b),
  d AS (SELECT *, (1 - 2/(9*aa) - cbrt((1-2/aa)/(1+x*sqrt(2/(aa-4))))) / sqrt(2/(9*aa)) AS z2 FROM c)
  SELECT variable, n, round(z1*z1+z2*z2, 4) AS statistic, round(exp(-(z1*z1+z2*z2)/2), 6) AS p_value, exp(-(z1*z1+z2*z2)/2) > 0.05 AS normal FROM d""")
def d8(spark, sf):
    return rounded(U.dagostino_k2(table(spark, sf, "lineitem"), NUM), 6, statistic=4)


@query("d9_anderson_darling")
def d9(spark, sf):
    return rounded(U.anderson_darling(table(spark, sf, "lineitem"), NUM), 3)


@query("d10_shapiro_wilk")
def d10(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("value").cast("double").alias("value"))
    return rounded(U.shapiro_long(e, ["user"]))


def _fences(c, source):
    return f"f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source}))"


@query("d11_outliers_iqr", f"WITH {GAPS}, {_fences('o_totalprice', 'gaps')} SELECT o_orderkey, o_totalprice FROM gaps, f WHERE o_totalprice < lo OR o_totalprice > hi")
def d11(spark, sf):
    return U.outliers_iqr(gaps(spark, sf).select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("d12_outliers_z", "WITH m AS (SELECT avg(value) AS a, stddev_samp(value) AS s FROM events) SELECT event_id, value FROM events, m WHERE abs((value - a) / s) > 3")
def d12(spark, sf):
    return U.outliers_z(table(spark, sf, "events").select("event_id", "value"), "value")


@query("d13_outliers_modified_z", """WITH m AS (SELECT quantile_cont(value, 0.5) AS md FROM events), d AS (SELECT quantile_cont(abs(value - md), 0.5) AS mad FROM events, m)
  SELECT event_id, value FROM events, m, d WHERE 0.6745 * abs(value - md) / mad > 3.5""")
def d13(spark, sf):
    return U.outliers_modified_z(table(spark, sf, "events").select("event_id", "value"), "value")


@query("d14_transform_compare", """WITH t AS (SELECT ln(CASE WHEN value > 0 THEN value END) AS log, sqrt(CASE WHEN value > 0 THEN value END) AS sqrt, value AS original FROM events), g AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS transform, count({c}) AS n, skewness({c}) AS sk, kurtosis({c}) AS ku, skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)) AS s, kurtosis_pop({c}) AS k FROM t" for c in ("log", "sqrt", "original")) +
    ") SELECT transform, n, round(sk, 6) AS skewness, round(ku, 6) AS kurtosis, exp(-n / 12.0 * (s * s + k * k / 4)) > 0.05 AS normal FROM g")
def d14(spark, sf):
    return rounded(U.transform_compare(table(spark, sf, "events"), "value", boxcox=False).drop("lambda"))


@query("d15_boxcox_lambda")
def d15(spark, sf):
    return rounded(U.boxcox_lambda(table(spark, sf, "events"), "value"), 3)


@query("d16_histogram", """WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem),
  c AS (SELECT CAST(least(29, floor((l_extendedprice - lo) / w)) AS BIGINT) AS bin, count(*) AS k FROM lineitem, m GROUP BY 1)
  SELECT b.bin, round(lo + b.bin * w, 6) AS bin_start, round(lo + (b.bin + 1) * w, 6) AS bin_end, coalesce(k, 0) AS count FROM (SELECT unnest(range(30)) AS bin) b LEFT JOIN c ON b.bin = c.bin, m""")
def d16(spark, sf):
    return rounded(U.histogram(table(spark, sf, "lineitem"), "l_extendedprice"))


@query("d17_box_stats", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS md, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
  j AS (SELECT l.l_returnflag, l_extendedprice AS x, q1, md, q3, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag)
  SELECT l_returnflag, count(*) AS count, round(max(q1), 6) AS q1, round(max(md), 6) AS median, round(max(q3), 6) AS q3, min(CASE WHEN ok THEN x END) AS whisker_low,
  max(CASE WHEN ok THEN x END) AS whisker_high, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS outliers FROM j GROUP BY 1""")
def d17(spark, sf):
    return rounded(U.box_stats(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]))


@query("d18_qq_points")
def d18(spark, sf):
    return rounded(U.qq_points(table(spark, sf, "lineitem"), "l_extendedprice"))


@query("d19_kde", """WITH b AS (SELECT l_returnflag AS g, l_extendedprice AS x FROM lineitem), m AS (SELECT g, count(*) AS n, stddev_samp(x) * power(count(*), -0.2) AS h, min(x) AS lo, max(x) AS hi, avg(x) AS mean, quantile_cont(x, 0.5) AS md FROM b GROUP BY 1),
  f AS (SELECT b.g, least(2047, floor((x - lo) / ((hi - lo) / 2048))) AS bin, count(*) AS c, avg(x) AS cx FROM b JOIN m ON b.g = m.g GROUP BY 1, 2),
  k AS (SELECT m.g, i, lo - 3 * h + i * (hi - lo + 6 * h) / 199 AS x, n, h, mean, md FROM m, (SELECT unnest(range(200)) AS i))
  SELECT k.g AS "group", CAST(i AS INTEGER) AS g, round(max(x), 4) AS x, round(1e6 * sum(c * exp(-((x - cx) / h) * ((x - cx) / h) / 2) / (n * h * sqrt(2 * pi()))), 5) AS density, round(max(mean), 4) AS mean, round(max(md), 4) AS median FROM k JOIN f ON k.g = f.g GROUP BY 1, 2""")
def d19(spark, sf):
    found = U.violin_data(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")
    return rounded(found.withColumn("density", F.col("density") * 1e6), 4, density=5)


@query("d20_share_top", "SELECT value, k AS count, round(k * 100.0 / sum(k) OVER (), 6) AS share FROM (SELECT p_brand AS value, count(*) AS k FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)")
def d20(spark, sf):
    return rounded(U.share_top(table(spark, sf, "part"), "p_brand"))


@query("d21_distribution_type", f"""WITH g AS ({each(NUM, 'skewness({c}) AS s, kurtosis({c}) AS k', 'lineitem')}) SELECT variable, round(s, 6) AS skewness, round(k, 6) AS kurtosis,
  CASE WHEN abs(s) < 0.5 AND abs(k) < 0.5 THEN 'Normal' WHEN abs(s) > 1 THEN 'Altamente sesgada' WHEN abs(k) > 3 THEN 'Leptocúrtica (picos altos)' WHEN k < -1 THEN 'Platicúrtica (picos bajos)' ELSE 'Moderadamente sesgada' END AS distribution FROM g""")
def d21(spark, sf):
    return rounded(U.distribution_type(table(spark, sf, "lineitem"), NUM))


@query("d22_skewness_ranking", f"""WITH g AS ({each(NUM, 'skewness({c}) AS s', 'lineitem')}) SELECT variable, round(s, 6) AS skewness, abs(s) < 0.5 AS symmetric, abs(s) > 1 AS highly_skewed,
  row_number() OVER (ORDER BY abs(s) DESC, variable) AS rank FROM g""")
def d22(spark, sf):
    return rounded(U.skewness_ranking(table(spark, sf, "lineitem"), NUM))


@query("d23_extreme_variables", f"""WITH v AS ({each(NUM, 'var_samp({c}) AS v', 'lineitem')}), c AS (SELECT 'l_returnflag' AS variable, l_returnflag AS x, count(*) AS k FROM lineitem GROUP BY 2
  UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2), p AS (SELECT variable, count(*) AS u, max(k) AS t, sum(k) AS n FROM c GROUP BY 1)
  SELECT 'highest_variance' AS finding, arg_max(variable, v) AS variable, round(max(v), 2) AS amount FROM v
  UNION ALL SELECT 'highest_cardinality', arg_max(variable, u), round(max(u)::DOUBLE, 2) FROM p UNION ALL SELECT 'most_imbalanced', arg_max(variable, t / n), round(max(t / n), 2) FROM p WHERE u > 1""")
def d23(spark, sf):
    return rounded(U.extreme_variables(table(spark, sf, "lineitem"), NUM, ["l_returnflag", "l_linestatus"]), 2)


@query("d24_outlier_report", " UNION ALL ".join(f"""(WITH f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, a, s FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS a, stddev_samp({c}) AS s FROM lineitem)),
  n AS (SELECT count({c}) AS n, CAST(sum(CASE WHEN {c} < lo OR {c} > hi THEN 1 ELSE 0 END) AS BIGINT) AS i, CAST(sum(CASE WHEN abs(({c} - a) / s) > 3 THEN 1 ELSE 0 END) AS BIGINT) AS z FROM lineitem, f)
  SELECT '{c}' AS variable, n AS total_values, i AS iqr_outliers, round(i * 100.0 / n, 6) AS iqr_pct, z AS z_outliers, round(z * 100.0 / n, 6) AS z_pct FROM n)""" for c in
  ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUM]))
def d24(spark, sf):
    return rounded(U.outlier_report(table(spark, sf, "lineitem")))

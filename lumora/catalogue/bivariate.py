"""Two-variable statistics and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.catalogue.registry import gaps, query, rounded, table
from lumora.functions import applied
from lumora.operators import bivariate as B
from lumora.operators import quality as Q

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
Z = "1.959963984540054"


def lines(spark, sf):
    return table(spark, sf, "lineitem")


@query("b1_pearson", f"""WITH c AS (SELECT count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT 'pearson' AS method, n, round(r, 6) AS statistic,
  round(tanh(atanh(r) - {Z} / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(r) + {Z} / sqrt(n - 3)), 6) AS ci_high FROM c""")
def b1(spark, sf):
    return rounded(B.pearson(lines(spark, sf), "l_quantity", "l_extendedprice").drop("p_value", "significant"))


@query("b2_spearman", f"""WITH k AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem),
  c AS (SELECT count(*) AS n, corr(a, b) AS r FROM k) SELECT 'spearman' AS method, n, round(r, 6) AS statistic, round(tanh(atanh(r) - {Z} / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(r) + {Z} / sqrt(n - 3)), 6) AS ci_high FROM c""")
def b2(spark, sf):
    return rounded(B.spearman(lines(spark, sf), "l_quantity", "l_extendedprice").drop("p_value", "significant"))


@query("b3_kendall", """WITH p AS (SELECT l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS c FROM lineitem GROUP BY 1, 2),
  s AS (SELECT sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM p a, p b),
  n AS (SELECT sum(c) AS n FROM p), t AS (SELECT sum(t * (t - 1)) AS t FROM (SELECT sum(c) AS t FROM p GROUP BY x)), u AS (SELECT sum(t * (t - 1)) AS u FROM (SELECT sum(c) AS t FROM p GROUP BY y))
  SELECT 'kendall' AS method, CAST(n AS BIGINT) AS n, round(2 * s / sqrt((n * (n - 1) - t) * (n * (n - 1) - u)), 8) AS statistic FROM s, n, t, u""")
def b3(spark, sf):
    return rounded(B.kendall(lines(spark, sf), "l_quantity", "l_discount").drop("p_value"), 8)


def _corr_sql(cols, source):
    return " UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r, CAST(sum(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n FROM {source}" for a in cols for b in cols)


ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *NUM]


@query("b4_corr_matrix", f"SELECT var1, var2, round(r, 6) AS r, n FROM ({_corr_sql(ALL, 'lineitem')})")
def b4(spark, sf):
    return rounded(B.corr_matrix(lines(spark, sf), ALL))


def _rank_sql(c):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"


@query("b4_spearman_matrix", f"""WITH k AS (SELECT {", ".join(_rank_sql(c) for c in ALL)} FROM lineitem) SELECT var1, var2, round(r, 6) AS r, n FROM (
  {" UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS r, count(*) AS n FROM k" for i, a in enumerate(ALL) for b in ALL[:i])})""")
def b4_spearman(spark, sf):
    return rounded(B.rank_corr_matrix(lines(spark, sf), ALL, "spearman"))


FEW = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]


def _kendall_sql(a, b):
    return f"""SELECT '{a}' AS var1, '{b}' AS var2, 2 * s / sqrt((n * (n - 1) - t) * (n * (n - 1) - u)) AS r, CAST(n AS BIGINT) AS n FROM (WITH p AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS c FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)
  SELECT (SELECT sum(a.c * b.c * sign(a.x - b.x) * sign(a.y - b.y)) / 2 FROM p a, p b) AS s, (SELECT sum(c) FROM p) AS n,
  (SELECT sum(t * (t - 1)) FROM (SELECT sum(c) AS t FROM p GROUP BY x)) AS t, (SELECT sum(t * (t - 1)) FROM (SELECT sum(c) AS t FROM p GROUP BY y)) AS u)"""


@query("b4_kendall_matrix", f"""WITH g AS (SELECT l_linenumber, CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity, l_discount, l_tax FROM lineitem)
  SELECT var1, var2, round(r, 8) AS r, n FROM ({" UNION ALL ".join(_kendall_sql(a, b) for i, a in enumerate(FEW) for b in FEW[:i])})""")
def b4_kendall(spark, sf):
    gappy = lines(spark, sf).withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")))
    return rounded(B.rank_corr_matrix(gappy, FEW, "kendall"), 8)


@query("v6_check_corr_matrix", f"SELECT count(*) = count(DISTINCT var1) * count(DISTINCT var2) AS square, min(r) >= -1.01 AND max(r) <= 1.01 AS in_range FROM ({_corr_sql(ALL, 'lineitem')})")
def v6(spark, sf):
    return Q.check_corr_matrix(B.corr_matrix(lines(spark, sf), ALL))


_CHARGE = "(SELECT *, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem) t"
_CC = ["l_quantity", "l_extendedprice", "net", "charge", "l_discount"]


def charges(spark, sf):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines(spark, sf).withColumn("net", net).withColumn("charge", net * (1 + F.col("l_tax")))


_UP = " OR ".join(f"(var1 = '{a}' AND var2 = '{b}')" for i, a in enumerate(_CC) for b in _CC[i + 1:])


@query("b5_strong_pairs", f"SELECT var1, var2, round(r, 6) AS r, CASE WHEN abs(r) > 0.9 THEN 'Muy fuerte' ELSE 'Fuerte' END AS strength FROM ({_corr_sql(_CC, _CHARGE)}) WHERE ({_UP}) AND abs(r) > 0.7")
def b5(spark, sf):
    return rounded(B.strong_pairs(charges(spark, sf), _CC))


@query("b6_most_correlated_pair", f"SELECT var1, var2, round(r, 6) AS r FROM ({_corr_sql(_CC, _CHARGE)}) WHERE {_UP} ORDER BY abs(r) DESC LIMIT 1")
def b6(spark, sf):
    return rounded(B.most_correlated_pair(charges(spark, sf), _CC))


@query("b7_vif_approx", f"""WITH m AS (SELECT var1 AS variable, max(abs(r)) AS m FROM ({_corr_sql(NUM, 'lineitem')}) WHERE var1 <> var2 GROUP BY 1) SELECT variable, round(m, 6) AS max_r,
  round(CASE WHEN m < 0.99 THEN 1 / (1 - m * m) ELSE 'Infinity'::DOUBLE END, 6) AS vif, CASE WHEN m < 0.99 THEN 1 / (1 - m * m) > 10 ELSE true END AS high FROM m""")
def b7(spark, sf):
    return rounded(B.vif_approx(lines(spark, sf), NUM))


@query("b8_linear_regression", """WITH s AS (SELECT regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, corr(l_quantity, l_extendedprice) AS r,
  regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy FROM lineitem) SELECT n, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r, 6) AS r, round(r * r, 6) AS r_squared,
  round(sqrt((1 - r * r) * syy / (sxx * (n - 2))), 4) AS std_err FROM s""")
def b8(spark, sf):
    return rounded(B.linear_regression(lines(spark, sf), "l_quantity", "l_extendedprice").drop("p_value"), 4, r=6, r_squared=6)


@query("b9_scatter_with_trend", """WITH s AS (SELECT regr_slope(o_totalprice, o_custkey) AS a, regr_intercept(o_totalprice, o_custkey) AS b FROM orders)
  SELECT o_orderkey, o_custkey, o_totalprice, round(a * o_custkey + b, 4) AS fitted FROM orders, s""")
def b9(spark, sf):
    return rounded(B.scatter_with_trend(table(spark, sf, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"]), 4)


@query("b10_group_stats", """WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS md, quantile_cont(l_quantity, 0.75) AS q3, avg(l_quantity) AS m, stddev_samp(l_quantity) AS s FROM lineitem GROUP BY 1),
  j AS (SELECT l.l_returnflag, l_quantity AS x, q1, md, q3, m, s, l_quantity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM lineitem l JOIN q ON l.l_returnflag = q.l_returnflag)
  SELECT l_returnflag, count(*) AS count, max(q1) AS q1, max(md) AS median, max(q3) AS q3, min(CASE WHEN ok THEN x END) AS whisker_low, max(CASE WHEN ok THEN x END) AS whisker_high, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS outliers, round(max(m), 6) AS mean, round(max(s), 6) AS std FROM j GROUP BY 1""")
def b10(spark, sf):
    return rounded(B.group_stats(lines(spark, sf), "l_quantity", "l_returnflag"))


@query("b11_anova_oneway", """WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS c FROM g),
  s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * (m - c) * (m - c)) AS b, sum(n * v) AS w FROM g, t) SELECT k AS groups, CAST(n AS BIGINT) AS n, round((b / (k - 1)) / (w / (n - k)), 6) AS f, CAST(k - 1 AS DOUBLE) AS df_between, CAST(n - k AS DOUBLE) AS df_within FROM s""")
def b11(spark, sf):
    return rounded(B.anova_oneway(lines(spark, sf), "l_extendedprice", "l_returnflag").drop("p_value"))


@query("b12_crosstab", "SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS count FROM lineitem GROUP BY 1, 2")
def b12(spark, sf):
    return B.crosstab(lines(spark, sf), "l_returnflag", "l_linestatus")


@query("b12_crosstab_wide", "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1")
def b12w(spark, sf):
    return B.crosstab_wide(lines(spark, sf), "l_returnflag", "l_linestatus")


@query("b13_row_percent", "SELECT a, b, round(k * 100.0 / sum(k) OVER (PARTITION BY a), 6) AS pct FROM (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS k FROM lineitem GROUP BY 1, 2)")
def b13(spark, sf):
    return rounded(B.row_percent(lines(spark, sf), "l_returnflag", "l_linestatus"))


def _chi(a, b, source, yates):
    d = "greatest(abs(o - e) - least(0.5, abs(o - e)), 0)" if yates else "(o - e)"
    return f"""WITH t AS (SELECT {a} AS a, {b} AS b FROM {source}), c AS (SELECT a, b, count(*) AS o FROM t GROUP BY 1, 2), ra AS (SELECT a, count(*) AS ra FROM t GROUP BY 1), cb AS (SELECT b, count(*) AS cb FROM t GROUP BY 1), n AS (SELECT count(*) AS n FROM t),
  g AS (SELECT ra.a, cb.b, ra * 1.0 * cb / n AS e, coalesce(o, 0) AS o, n FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN c ON c.a = ra.a AND c.b = cb.b)
  SELECT max(n) AS n, round(sum({d} * {d} / e), 6) AS statistic, CAST((count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS BIGINT) AS dof FROM g"""


@query("b14_chi_square", _chi("o_orderpriority", "o_orderstatus", "orders", False))
def b14(spark, sf):
    return rounded(B.chi_square(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus").drop("p_value"))


@query("b14_chi_square_yates", _chi("l_linestatus", "l_returnflag = 'R'", "lineitem", True))
def b14y(spark, sf):
    return rounded(B.chi_square(lines(spark, sf).select("l_linestatus", (F.col("l_returnflag") == "R").alias("r")), "l_linestatus", "r").drop("p_value"))


@query("b15_multi_column_test")
def b15(spark, sf):
    return rounded(B.multi_column_test(gaps(spark, sf), ["o_totalprice", "o_custkey", "o_orderpriority", "absent"], "dagostino_k2"), 4)


# ---------------------------------------------------------------- user functions

@query("f1_chunked_processing", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def f1(spark, sf):
    l = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")

    def net(block):
        return block.assign(net=block["l_extendedprice"] * (1 - block["l_discount"]))[["l_orderkey", "l_linenumber", "net"]]

    return rounded(applied.chunked_processing(l, net, "l_orderkey long, l_linenumber int, net double"), 4)


@query("f2_parallel_rows", "SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax, 4) AS score FROM lineitem")
def f2(spark, sf):
    l = lines(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounded(applied.parallel_rows(l, ["l_quantity", "l_tax"], lambda q, t: q * t, "score").drop("l_quantity", "l_tax"), 4)


@query("f2_parallel_columns", " UNION ALL ".join(f"SELECT '{c}' AS variable, round(max({c}) - min({c}), 6) AS result FROM lineitem" for c in NUM))
def f2c(spark, sf):
    return rounded(applied.parallel_columns(lines(spark, sf), NUM, lambda c: F.max(c) - F.min(c)))


@query("f3_column_test", " UNION ALL ".join(f"""SELECT '{c}' AS variable, round(n / 6.0 * (s * s + k * k / 4), 4) AS statistic, round(exp(-n / 12.0 * (s * s + k * k / 4)), 4) AS p_value, CAST(NULL AS VARCHAR) AS error
  FROM (SELECT count({c}) AS n, skewness({c}) * (count({c}) - 2) / sqrt(count({c})::DOUBLE * (count({c}) - 1)) AS s, kurtosis_pop({c}) AS k FROM lineitem)""" for c in NUM))
def f3(spark, sf):
    return rounded(B.multi_column_test(lines(spark, sf), NUM, "jarque_bera"), 4)

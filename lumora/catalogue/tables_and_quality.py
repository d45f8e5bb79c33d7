"""Selection, joins, aggregates, profiles, quality and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.catalogue.registry import COPIES, DAILY, GAPS, copies, daily, gaps, query, rounded, table
from lumora.operators import quality as Q
from lumora.operators import relational as P

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_COLUMNS = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


# ---------------------------------------------------------------- selection

@query("p1_data_columns", "SELECT s_suppkey, s_name FROM supplier")
def p1(spark, sf):
    s = table(spark, sf, "supplier").withColumn("_source_file", F.lit("supplier"))
    return P.data_columns(s.select("s_suppkey", "s_name", "_source_file"))


@query("p2_select_by_type", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def p2(spark, sf):
    return P.select_by_type(table(spark, sf, "lineitem"), "numeric")


@query("p3_preview", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, substr(text, 1, 50) AS text, lang, source,
  CAST(n_chars AS VARCHAR) AS n_chars FROM documents ORDER BY documents.doc_id LIMIT 100""")
def p3(spark, sf):
    return P.preview(table(spark, sf, "documents"), ["doc_id"])


@query("p4_complete_cases", f"WITH {GAPS} SELECT o_orderkey, o_totalprice, o_orderpriority FROM gaps WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL")
def p4(spark, sf):
    return P.complete_cases(gaps(spark, sf), ["o_totalprice", "o_orderpriority"]).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query("p5_mask_filter", "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount < 0.02 OR l_discount > 0.08")
def p5(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.where((F.col("l_discount") < 0.02) | (F.col("l_discount") > 0.08)).select("l_orderkey", "l_linenumber", "l_discount")


@query("p6_sort_nulls_last", f"WITH {GAPS} SELECT o_orderkey, o_totalprice FROM gaps ORDER BY o_totalprice ASC NULLS LAST")
def p6(spark, sf):
    return P.sort_nulls_last(gaps(spark, sf).select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("p7_top_n", "SELECT p_name AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def p7(spark, sf):
    return P.top_n(P.value_counts(table(spark, sf, "part"), "p_name"), "count", 20, ["value"])


@query("p8_dedupe_first", """SELECT o_orderdate AS ts, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey) AS k FROM orders) WHERE k = 1""")
def p8(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), "o_orderkey", "o_totalprice")
    return P.dedupe_first(o, ["ts"], ["o_orderkey"])


@query("p9_duplicate_rows", f"""WITH {COPIES}, k AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, count(*) AS c FROM copies GROUP BY ALL)
  SELECT CAST(sum(c) AS BIGINT) AS rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
    round(sum(c - 1) * 100.0 / sum(c), 6) AS duplicate_percentage FROM k""")
def p9(spark, sf):
    return rounded(P.duplicate_rows(copies(spark, sf)))


@query("p10_sample_n", "SELECT * FROM lineitem ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, '42')), l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 1000")
def p10(spark, sf):
    return P.sample_n(table(spark, sf, "lineitem"), 1000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("p11_every_kth", """WITH o AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders)
  SELECT o_orderkey, o_totalprice FROM o WHERE k % 7 = 0""")
def p11(spark, sf):
    return P.every_kth(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 7)


@query("p12_cap_rows", "SELECT count(*) AS rows, count(*) <= 1000000 AS within_limit FROM lineitem")
def p12(spark, sf):
    return P.size_ok(table(spark, sf, "lineitem"))


@query("p12_cap_rows_first", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 1000000")
def p12_first(spark, sf):
    return P.cap_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"])


@query("p13_split_chronological", """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)
  SELECT o_orderkey, CASE WHEN k < floor(n * (1 - 0.2)) THEN 'train' ELSE 'test' END AS split FROM o""")
def p13(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return P.split_chronological(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split")


@query("p14_split_random", """WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY md5(concat_ws('|', o_orderkey, '42')), o_orderkey))
  SELECT o_orderkey, o_orderstatus, CASE WHEN p < floor(n * (1 - 0.2)) THEN 'train' ELSE 'test' END AS split FROM o""")
def p14(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return P.split_random(o, ["o_orderkey"], stratify="o_orderstatus")


# ---------------------------------------------------------------- joins, unions, aggregates

@query("j1_outer_merge", """SELECT coalesce(c.k, s.k) AS nationkey, c.acctbal, s.acctbal AS acctbal_dup, c.customers
  FROM (SELECT c_nationkey AS k, round(min(c_acctbal), 2) AS acctbal, count(*) AS customers FROM customer GROUP BY 1) c
  FULL JOIN (SELECT s_nationkey AS k, round(min(s_acctbal), 2) AS acctbal FROM supplier GROUP BY 1) s ON c.k = s.k""")
def j1(spark, sf):
    c = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(
        F.round(F.min("c_acctbal"), 2).alias("acctbal"), F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.round(F.min("s_acctbal"), 2).alias("acctbal"))
    return P.outer_merge([c, s], "nationkey")


@query("j2_inner_on_time", f"""WITH {DAILY}, a AS (SELECT ts, value FROM daily), b AS (SELECT ts + INTERVAL 1 DAY AS ts, value AS predicted FROM daily)
  SELECT a.ts, a.value, b.predicted FROM a JOIN b ON a.ts = b.ts""")
def j2(spark, sf):
    d = daily(spark, sf).select("ts", "value")
    shifted = d.select((F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.col("value").alias("predicted"))
    return P.inner_on_time(d, shifted, "ts")


@query("j3_lookup", """SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation FROM customer
  LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey""")
def j3(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    n = table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("k"), "n_name")
    return P.lookup(c, "nation", n, "k", "n_name")


@query("u1_union_by_name", "SELECT s_nationkey AS nationkey, s_acctbal AS acctbal, NULL AS segment FROM supplier UNION ALL SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def u1(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"))
    return s.unionByName(c, allowMissingColumns=True)


@query("a1_group_mean", """SELECT r_name || '/' || n_name AS place, round(avg(c_acctbal), 6) AS mean_value FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY avg(c_acctbal) DESC, 1 LIMIT 20""")
def a1(spark, sf):
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    named = c.select(F.concat_ws("/", "r_name", "n_name").alias("region_nation"), "c_acctbal")
    return rounded(P.group_mean(named, P.place_columns(named)[0], "c_acctbal"))


@query("a2_pivot_mean", """SELECT l_returnflag, round(avg(CASE WHEN l_linestatus='F' THEN l_extendedprice END), 4) AS F,
  round(avg(CASE WHEN l_linestatus='O' THEN l_extendedprice END), 4) AS O FROM lineitem GROUP BY 1""")
def a2(spark, sf):
    return rounded(P.pivot_mean(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_extendedprice", ["F", "O"]), 4)


@query("a3_counts_by_source", "SELECT source AS _source_file, count(*) AS rows FROM documents GROUP BY 1")
def a3(spark, sf):
    return P.counts_by_source(table(spark, sf, "documents").withColumnRenamed("source", "_source_file"))


@query("a4_distinct_count", f"WITH {GAPS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS unique_count FROM gaps" for c in ORDER_COLUMNS))
def a4(spark, sf):
    return P.distinct_count(gaps(spark, sf), ORDER_COLUMNS)


# ---------------------------------------------------------------- profiles and quality

def _profile_sql(cols: list[tuple[str, str, bool]], source: str, digits: int = 4) -> str:
    parts = []
    for name, kind, numeric in cols:
        names = ["minimum", "maximum", "mean", "median", "std"]
        exprs = (
            [f"min({name})", f"max({name})", f"avg({name})", f"quantile_cont(CAST({name} AS DOUBLE), 0.5)", f"stddev_samp({name})"]
            if numeric else ["NULL"] * 5
        )
        cells = ", ".join(f"round(CAST({e} AS DOUBLE), {digits}) AS {n}" for e, n in zip(exprs, names))
        parts.append(
            f"SELECT '{name}' AS variable, '{kind}' AS type, count(*) AS total, count({name}) AS non_null, "
            f"count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS unique_count, "
            f"count(*) - count(DISTINCT {name}) AS duplicates, round(count({name}) * 100.0 / count(*), {digits}) AS completeness, {cells} FROM {source}"
        )
    return " UNION ALL ".join(parts)


ORDER_TYPES = [("o_orderkey", "bigint", True), ("o_custkey", "bigint", True), ("o_orderstatus", "string", False),
               ("o_totalprice", "double", True), ("o_orderdate", "timestamp_ntz", False), ("o_orderpriority", "string", False)]
LINE_TYPES = [("l_orderkey", "bigint", True), ("l_partkey", "bigint", True), ("l_suppkey", "bigint", True), ("l_linenumber", "int", True),
              ("l_quantity", "double", True), ("l_extendedprice", "double", True), ("l_discount", "double", True), ("l_tax", "double", True),
              ("l_returnflag", "string", False), ("l_linestatus", "string", False), ("l_shipdate", "timestamp_ntz", False)]


@query("q1_profile_columns", f"WITH {GAPS} " + _profile_sql(ORDER_TYPES, "gaps"))
def q1(spark, sf):
    return rounded(Q.profile_columns(gaps(spark, sf)), 4)


@query("q1_profile_lineitem", _profile_sql(LINE_TYPES, "lineitem"))
def q1l(spark, sf):
    return rounded(Q.profile_columns(table(spark, sf, "lineitem")), 4)


@query("q2_column_info", f"WITH {GAPS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count FROM gaps" for c in ORDER_COLUMNS))
def q2(spark, sf):
    return Q.column_info(gaps(spark, sf), ["o_orderkey"]).drop("sample_values")


@query("q3_ingestion_summary", """SELECT count(DISTINCT source) AS total_files, count(DISTINCT source || '/' || lang) AS total_tables,
  CAST(count(DISTINCT source || '/' || lang) * 3 AS BIGINT) AS total_columns, count(DISTINCT CASE WHEN lang = 'en' THEN source || '/' || lang END) AS tables_with_time,
  CAST(count(DISTINCT source || '/' || lang) AS BIGINT) AS quantitative, CAST(count(DISTINCT source || '/' || lang) * 2 AS BIGINT) AS qualitative, CAST(0 AS BIGINT) AS datetime FROM documents""")
def q3(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang").distinct()

    def col(n, t):
        return F.struct(F.lit(n).alias("name"), F.lit(t).alias("dtype"))

    catalog = d.select(
        F.col("source").alias("file_path"), F.concat_ws("/", "source", "lang").alias("table_name"),
        (F.col("lang") == "en").alias("has_time_column"),
        F.array(col("n_chars", "quantitative"), col("lang", "qualitative"), col("text", "qualitative")).alias("columns"))
    return Q.ingestion_summary(catalog)


_MISSING = " + ".join(f"(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in ORDER_COLUMNS)
_LEVEL = f"""level AS (SELECT CAST(count(*) * 6 AS BIGINT) AS total_cells, CAST(sum({_MISSING}) AS BIGINT) AS missing_cells,
  sum({_MISSING}) * 100.0 / (count(*) * 6) AS pct FROM gaps)"""
_LABEL = "CASE WHEN pct < 5 THEN 'Excelente' WHEN pct < 15 THEN 'Buena' WHEN pct < 30 THEN 'Regular' ELSE 'Pobre' END"


@query("q4_quality_level", f"WITH {GAPS}, {_LEVEL} SELECT total_cells, missing_cells, round(pct, 6) AS missing_percentage, {_LABEL} AS quality FROM level")
def q4(spark, sf):
    return rounded(Q.quality_level(gaps(spark, sf)))


@query("q5_summary_metrics", f"""WITH {GAPS}, {_LEVEL} SELECT CAST(total_cells // 6 AS BIGINT) AS total_observations, CAST(6 AS BIGINT) AS total_variables, CAST(3 AS BIGINT) AS numeric_variables,
  CAST(2 AS BIGINT) AS categorical_variables, {_LABEL} AS data_quality, round(pct, 6) AS missing_percentage, round(100 - pct, 6) AS completeness_score FROM level""")
def q5(spark, sf):
    return rounded(Q.summary_metrics(gaps(spark, sf)))


_SCORE = f"""m AS (SELECT count(*) AS total_rows, sum({_MISSING}) * 100.0 / (count(*) * 6) AS pct FROM copies),
  k AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, count(*) AS c FROM copies GROUP BY ALL),
  d AS (SELECT CAST(sum(c - 1) AS BIGINT) AS dup, sum(c - 1) * 100.0 / sum(c) AS dpct FROM k)"""


@query("q6_quality_score", f"""WITH {COPIES}, {_SCORE} SELECT total_rows, CAST(6 AS BIGINT) AS total_columns, round(pct, 6) AS missing_percentage, dup AS duplicate_rows,
  CAST(0 AS BIGINT) AS empty_columns, round(greatest(0, 100 - 2 * pct - dpct), 6) AS quality_score, greatest(0, 100 - 2 * pct - dpct) >= 50 AS is_valid FROM m, d""")
def q6(spark, sf):
    return rounded(Q.quality_score(copies(spark, sf)))


def _variable_sql(source: str) -> str:
    text = {"o_orderstatus", "o_orderpriority"}
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, round(m, 6) AS missing_percentage, round(u, 6) AS unique_ratio, round(100 - m, 6) AS completeness_score,
  concat_ws(',', CASE WHEN m > 20 THEN 'high_missing' END, CASE WHEN u < 0.01 AND {'true' if c in text else 'false'} THEN 'few_unique_values' END,
  CASE WHEN m > 0 AND m < 5 THEN 'sporadic_missing' END) AS issues FROM (SELECT (count(*) - count({c})) * 100.0 / count(*) AS m, count(DISTINCT {c}) / count(*) AS u FROM {source})"""
        for c in ORDER_COLUMNS)


@query("q7_quality_by_variable", f"WITH {GAPS} " + _variable_sql("gaps"))
def q7(spark, sf):
    return rounded(Q.quality_by_variable(gaps(spark, sf)))


@query("q8_missing_ranking", f"WITH {GAPS} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) - count({c}) AS missing FROM gaps" for c in ORDER_COLUMNS) + ") WHERE missing > 0")
def q8(spark, sf):
    return Q.missing_ranking(gaps(spark, sf))


@query("q9_type_distribution", """SELECT CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS physical,
  CASE WHEN data_type IN ('BIGINT','INTEGER','DOUBLE') THEN 'numeric' WHEN data_type = 'VARCHAR' THEN 'categorical' ELSE 'temporal' END AS semantic, count(*) AS columns
  FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1, 2""")
def q9(spark, sf):
    return Q.type_distribution(table(spark, sf, "lineitem"))


@query("q10_table_overview", f"""WITH {GAPS} SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, CAST(3 AS BIGINT) AS numeric_columns, CAST(2 AS BIGINT) AS categorical_columns,
  CAST(sum({_MISSING}) AS BIGINT) AS total_missing, count(DISTINCT o_orderstatus) AS source_files FROM gaps""")
def q10(spark, sf):
    return Q.table_overview(gaps(spark, sf).withColumn("_source_file", F.col("o_orderstatus")))


@query("q11_quality_recommendations", f"""WITH {COPIES}, {_SCORE}, v AS ({_variable_sql('copies')}), r AS (SELECT pct, dup, (SELECT count(*) FROM v WHERE issues <> '') AS flagged FROM m, d)
  SELECT 'quality' AS kind, 'impute_missing' AS rule, round(100 - pct, 6) AS amount FROM r WHERE 100 - pct < 80
  UNION ALL SELECT 'quality', 'consider_imputation', round(100 - pct, 6) FROM r WHERE 100 - pct < 90 AND 100 - pct >= 80
  UNION ALL SELECT 'quality', 'remove_duplicates', CAST(dup AS DOUBLE) FROM r WHERE dup > 0
  UNION ALL SELECT 'quality', 'review_variables', CAST(flagged AS DOUBLE) FROM r WHERE flagged > 0
  UNION ALL SELECT 'analysis', 'category_frequencies', 2.0 UNION ALL SELECT 'modeling', 'regression_clustering', 3.0 UNION ALL SELECT 'modeling', 'classification', 2.0
  UNION ALL SELECT 'action', unnest(['validate_with_stakeholders', 'monitor_quality', 'document_preprocessing', 'consider_further_analysis']), NULL""")
def q11(spark, sf):
    return rounded(Q.quality_recommendations(copies(spark, sf)))


# ---------------------------------------------------------------- checks

@query("v1_check_structure", "SELECT 'has_columns' AS check, true AS passed UNION ALL SELECT 'has_rows', count(*) > 0 FROM orders")
def v1(spark, sf):
    return Q.check_structure(table(spark, sf, "orders"))


@query("v2_check_numeric", f"""WITH {GAPS} SELECT 'o_totalprice' AS variable, true AS exists, true AS numeric_type, count(*) - count(o_totalprice) AS not_convertible FROM gaps
  UNION ALL SELECT 'o_orderpriority', true, false, sum(CASE WHEN TRY_CAST(o_orderpriority AS DOUBLE) IS NULL THEN 1 ELSE 0 END)::BIGINT FROM gaps
  UNION ALL SELECT 'o_absent', false, false, NULL""")
def v2(spark, sf):
    return Q.check_numeric(gaps(spark, sf), ["o_totalprice", "o_orderpriority", "o_absent"])


@query("v3_check_categorical", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(DISTINCT {c}) AS unique_count, count(DISTINCT {c}) > count(*) * 0.9 AS too_many_values FROM customer" for c in ("c_name", "c_mktsegment")))
def v3(spark, sf):
    return Q.check_categorical(table(spark, sf, "customer"), ["c_name", "c_mktsegment"])


@query("v4_check_time", """SELECT 'day' AS variable, CAST(0 AS BIGINT) AS unparseable, true AS valid UNION ALL
  SELECT 'label', sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END)::BIGINT, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) = 0 FROM orders""")
def v4(spark, sf):
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    o = table(spark, sf, "orders").select(day.alias("day"), F.when(F.col("o_orderstatus") != "P", day).otherwise("unknown").alias("label"))
    return Q.check_time(o, ["day", "label"])


@query("v5_check_requirements", """SELECT unnest(['univariate','bivariate','multivariate','regression','classification','clustering','time_series']) AS kind, true AS enough_columns,
  (SELECT count(*) >= 10 FROM lineitem) AS enough_rows, true AS any_value, (SELECT count(*) >= 10 FROM lineitem) AS valid""")
def v5(spark, sf):
    l = table(spark, sf, "lineitem")
    kinds = ["univariate", "bivariate", "multivariate", "regression", "classification", "clustering", "time_series"]
    out = Q.check_requirements(l, kinds[0])
    for k in kinds[1:]:
        out = out.unionByName(Q.check_requirements(l, k))
    return out


@query("v7_check_ml_inputs", f"""WITH {GAPS} SELECT count(*) AS rows, sum(CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END)::BIGINT AS rows_with_missing_features,
  sum(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing_target, count(DISTINCT o_orderpriority) AS classes, true AS target_ok, false AS valid FROM gaps""")
def v7(spark, sf):
    return Q.check_ml_inputs(gaps(spark, sf), ["o_totalprice", "o_custkey"], "o_orderpriority", "classification")


@query("v8_validation_suite", f"""WITH {COPIES}, {_SCORE} SELECT 'numeric' AS check, 'error' AS severity, 'o_totalprice' AS subject, (count(*) - count(o_totalprice)) || ' values are not numbers' AS message FROM copies HAVING count(*) > count(o_totalprice)
  UNION ALL SELECT 'quality', 'warning', 'table', 'score ' || format('{{:.1f}}', greatest(0, 100 - 2 * pct - dpct)) FROM m, d WHERE greatest(0, 100 - 2 * pct - dpct) < 50
  UNION ALL SELECT 'overall', 'info', 'table', CASE WHEN count(*) > count(o_totalprice) THEN 'invalid' ELSE 'valid' END FROM copies""")
def v8(spark, sf):
    return Q.validation_suite(copies(spark, sf))

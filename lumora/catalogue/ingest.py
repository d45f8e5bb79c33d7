"""Files written from the tables and read back; name, type and shape operators."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumora.catalogue.registry import GAPS, MESSY, gaps, messy, query, rounded, table
from lumora.functions import columns as C
from lumora.operators import schema as N
from lumora.sources import files as S
from lumora.sources.folders import opened
from lumora.sources import sinks as K
from lumora.sources import tables as W
from lumora.sources.sinks import workbook_bytes

ORDER_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


def _orders_text(spark, sf):
    o = table(spark, sf, "orders")
    return o.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))


def _typed_orders(df):
    return df.select(
        F.col("o_orderkey").cast("string").try_cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("string").try_cast("bigint").alias("o_custkey"),
        "o_orderstatus", F.col("o_totalprice").cast("string").try_cast("double").alias("o_totalprice"),
        C.to_moment(F.col("o_orderdate").cast("string"), "yyyy-MM-dd HH:mm:ss").cast("timestamp_ntz").alias("o_orderdate"), "o_orderpriority")


def _write_books(orders, folder, rows=500):
    """Workbooks of at most `rows` rows each, written by the tasks that hold them."""

    def write(part: pa.Table) -> pa.Table:
        store, root, _ = opened(folder)
        number, cells = part["book"][0].as_py(), part.drop_columns(["book"])
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/book_{number}.xlsx") as f:
            f.write(workbook_bytes(cells.column_names, *zip(*(c.to_pylist() for c in cells.columns))))
        return pa.table({"book": [number]})

    books = max(1, orders.count() // rows)
    text = orders.select(*[F.col(c).cast("string").alias(c) for c in orders.columns], F.pmod(F.xxhash64("o_orderkey"), F.lit(books)).alias("book"))
    text.groupBy("book").applyInArrow(write, "book long").count()


def order_files(spark, sf, books=False):
    """All orders as files: `,` and `;` CSV and parquet by status, and a file of unknown format; on request those
    in parquet as workbooks instead."""
    folder = K.workspace(spark)
    o = _orders_text(spark, sf)
    K.write_csv(o.where("o_orderstatus = 'F'"), f"{folder}/finished")
    K.write_csv(o.where("o_orderstatus = 'O'"), f"{folder}/open", ";")
    pending = o.where("o_orderstatus = 'P'")
    if books:
        _write_books(pending, f"{folder}/books")
    else:
        K.write_parquet(pending, f"{folder}/pending")
    o.select(F.lit("plain words").alias("value")).limit(1).write.text(f"{folder}/notes")
    return folder


# ---------------------------------------------------------------- sources

@query("s1_list_files")
def s1(spark, sf):
    return S.list_files(spark, order_files(spark, sf)).where("ext <> 'crc'")


@query("s2_sniff_files", "SELECT 'csv' AS format, 'utf-8' AS encoding, ',' AS separator, true AS readable UNION ALL SELECT 'csv', 'utf-8', ';', true UNION ALL SELECT 'parquet', NULL, NULL, true UNION ALL SELECT NULL, 'utf-8', NULL, false")
def s2(spark, sf):
    found = S.sniff_files(spark, order_files(spark, sf)).where(~F.col("path").rlike("(_SUCCESS|\\.crc)$"))
    kept = F.when(F.col("format").eqNullSafe("parquet"), None).otherwise(F.col("encoding"))
    txt = found.select("format", kept.alias("encoding"), "separator", F.col("error").isNull().alias("readable"))
    return txt.distinct()


@query("s4_detect_encoding", """SELECT e.encoding, c_custkey, 'Señor ' || c_name AS name FROM customer, (VALUES ('utf-8'), ('latin-1')) AS e(encoding)""")
def s4(spark, sf):
    """Accented names in two encodings; the files are read by the encoding that was found."""
    folder = K.workspace(spark)
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("Señor "), "c_name").alias("name"))
    for encoding in ("UTF-8", "ISO-8859-1"):
        c.write.option("header", True).option("encoding", encoding).csv(f"{folder}/{encoding}")
    groups = S.file_encodings(spark, folder).groupBy("encoding").agg(F.collect_list("path").alias("paths")).collect()
    parts = [S.read_delimited(spark, r["paths"], ",", r["encoding"]).select(F.lit(r["encoding"]).alias("encoding"), F.col("c_custkey").cast("bigint").alias("c_custkey"), "name") for r in groups]
    return reduce(DataFrame.unionByName, parts)


@query("s3_read_csv_auto", ORDER_SQL)
def s3(spark, sf):
    folder = K.workspace(spark)
    K.write_csv(_orders_text(spark, sf), folder, ";")
    return _typed_orders(S.read_csv_auto(spark, folder))


@query("s5_na_tokens", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE l_returnflag END AS flag FROM lineitem")
def s5(spark, sf):
    l = table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    text = F.when(n == 1, "N/A").when(n == 2, " ").when(n == 3, "NULL").otherwise(F.col("l_returnflag"))
    return l.select("l_orderkey", "l_linenumber", C.null_tokens(text).alias("flag"))


@query("s6_read_tsv", ORDER_SQL)
def s6(spark, sf):
    folder = K.workspace(spark)
    K.write_csv(_orders_text(spark, sf), folder, "\t")
    return _typed_orders(S.read_tsv(spark, folder))


@query("s7_read_json_any", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer")
def s7(spark, sf):
    """One document {"data": [...]} per customer, so a document stays small however many there are."""
    folder = K.workspace(spark)
    c = table(spark, sf, "customer")
    docs = c.select(F.to_json(F.struct(F.array(F.struct("c_custkey", "c_nationkey", "c_acctbal")).alias("data"))).alias("value"))
    docs.write.text(folder)
    return S.read_json_any(spark, folder, lines=True).select(F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_custkey", "c_acctbal")


@query("s8_read_parquet", ORDER_SQL)
def s8(spark, sf):
    return S.read_parquet(spark, f"{sf}/orders.parquet")


@query("s9_read_xml", "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey FROM supplier")
def s9(spark, sf):
    folder = K.workspace(spark)
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    s.write.format("xml").option("rowTag", "row").option("rootTag", "rows").save(folder)
    return S.read_xml(spark, folder).select("s_suppkey", "s_name", "s_nationkey")


@query("s10_html_tables", """SELECT url, CAST(2 AS INTEGER) AS table_count, CAST(0 AS INTEGER) AS table_index, CAST(r AS INTEGER) AS row, CASE WHEN r = 0 THEN 'page|length' ELSE page_id || '|' || length(html) END AS cells
  FROM pages, (SELECT unnest([0, 1]) AS r)""")
def s10(spark, sf):
    p = table(spark, sf, "pages")
    body = F.concat(
        F.lit("<table><tr><th>page</th><th>length</th></tr><tr><td>"), F.col("page_id").cast("string"), F.lit("</td><td>"),
        F.length("html").cast("string"), F.lit("</td></tr></table><table><tr><td>second</td></tr></table>"))
    found = W.html_tables(p.select("url", F.concat(body, "html").alias("html")))
    return found.withColumn("cells", F.array_join("cells", "|"))


@query("s10_html_tables_sql", """SELECT url, CAST(n AS INTEGER) AS table_index, CAST(r AS INTEGER) AS row, CASE WHEN n = 1 THEN 'second' WHEN r = 0 THEN 'page' ELSE CAST(page_id AS VARCHAR) END AS cells
  FROM pages, (SELECT unnest([0, 0, 1]) AS n, unnest([0, 1, 0]) AS r)""")
def s10_sql(spark, sf):
    W.register_html_tables(spark, "page_tables")
    text = "concat('<table><tr><th>page</th></tr><tr><td>', page_id, '</td></tr></table><p>-</p><table><tr><td>second</td></tr></table>', html)"
    return spark.sql(f"SELECT url, table_index, row, array_join(cells, '|') AS cells FROM {{pages}} p, LATERAL page_tables({text}, true)", pages=table(spark, sf, "pages"))


@query("s11_read_workbooks", "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(1 AS INTEGER) AS row, CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(n_chars AS VARCHAR) AS n_chars FROM documents")
def s11(spark, sf):
    @F.pandas_udf("binary")
    def make(doc: pd.Series, lang: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([workbook_bytes(["doc_id", "lang", "n_chars"], [int(d), g, int(k)]) for d, g, k in zip(doc, lang, n)])

    books = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), make("doc_id", "lang", "n_chars").alias("content"))
    return W.cells_to_columns(W.workbook_rows(books), ["doc_id", "lang", "n_chars"])


@query("s12_read_many", ORDER_SQL)
def s12(spark, sf):
    tables, _ = S.read_many(spark, order_files(spark, sf, books=True))
    out = None
    for df in tables.values():
        part = _typed_orders(df)
        out = part if out is None else out.unionByName(part)
    return out


@query("s13_ingest_directory", ORDER_SQL)
def s13(spark, sf):
    got = S.ingest_directory(spark, order_files(spark, sf, books=True))["unified"]
    return got.select(
        F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.col("o_custkey").cast("bigint").alias("o_custkey"), "o_orderstatus", "o_totalprice",
        F.col("o_orderdate").cast("timestamp").cast("timestamp_ntz").alias("o_orderdate"), "o_orderpriority")


_SEGMENT_AGES = ["Moins de 25 ans", "Entre 25 et 29 ans", "Entre 30 et 34 ans", "Entre 35 et 39 ans", "65 ans ou plus"]
_AGE_CASE = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN '{a}'" for s, a in zip(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], _SEGMENT_AGES)) + " END"


def _pair(spark, sf):
    """Customers by nation as the two domain files, the second one with another category column."""
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(
        F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    base = c.groupBy(F.lit("2023-01-31").alias("Date référence"), F.col("n_name").alias("Nom département"), F.col("r_name").alias("Nom région"), F.lit("RSA seul").alias("RSA ou PPA"), "c_mktsegment").agg(
        F.count(F.lit(1)).alias("Nombre foyers RSA_PPA"), F.sum(F.length("c_name")).alias("Nombre personnes RSA_PPA"))
    folder = K.workspace(spark)
    ids = ["Date référence", "Nom département", "Nom région", "RSA ou PPA"]
    metrics = ["Nombre foyers RSA_PPA", "Nombre personnes RSA_PPA"]
    K.write_csv(base.select(*ids, F.expr(_AGE_CASE).alias("Age responsable dossier"), *metrics), f"{folder}/{S.PAIR[0][0]}", ";")
    K.write_csv(base.select(*ids, F.col("c_mktsegment").alias("Situation familiale"), *metrics), f"{folder}/{S.PAIR[1][0]}", ";")
    return S.load_source_pair(spark, folder)


_PAIR_SQL = f"""base AS (SELECT n_name AS dept, r_name AS region, c_mktsegment AS seg, {_AGE_CASE} AS age, count(*) AS k, sum(length(c_name)) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4),
  pair AS (SELECT *, 'Age' AS src FROM base UNION ALL SELECT *, 'Situation_Familiale' FROM base)"""


@query("s14_load_source_pair", f"WITH {_PAIR_SQL} SELECT src AS source, dept, region, CASE src WHEN 'Age' THEN age END AS age, CASE src WHEN 'Age' THEN NULL ELSE seg END AS family, CAST(k AS DOUBLE) AS households FROM pair")
def s14(spark, sf):
    p = _pair(spark, sf)
    return p.select(
        F.col("Source").alias("source"), F.col("Nom département").alias("dept"), F.col("Nom région").alias("region"), F.col("Age responsable dossier").alias("age"),
        F.col("Situation familiale").alias("family"), F.col("Nombre foyers RSA_PPA").cast("double").alias("households"))


@query("k1_write_csv", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem")
def k1(spark, sf):
    folder = K.workspace(spark)
    K.write_csv(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"), folder)
    back = spark.read.option("header", True).schema("l_orderkey long, l_linenumber int, l_extendedprice double, l_returnflag string").csv(folder)
    return back


@query("k2_result_exports", "WITH m AS (SELECT avg(value) AS a, stddev_samp(value) AS s FROM events) SELECT event_id, ts, value FROM events, m WHERE abs((value - a) / s) > 2")
def k2(spark, sf):
    from lumora.operators.anomalies import anomalies_z

    folder = K.workspace(spark)
    K.write_result(anomalies_z(table(spark, sf, "events").select("event_id", "ts", "value"), "value", 2.0), folder, "parquet")
    return spark.read.parquet(folder)


# ---------------------------------------------------------------- names and types

@query("n1_clean_names", "SELECT s_suppkey AS supplier_key, s_name AS supplier_name, s_acctbal AS balance____ FROM supplier")
def n1(spark, sf):
    s = table(spark, sf, "supplier")
    return N.clean_names(s.select(F.col("s_suppkey").alias(" Supplier  Key "), F.col("s_name").alias("Supplier-Name"), F.col("s_acctbal").alias("Balance ($)")))


@query("n2_clean_names_unique", "SELECT s_suppkey AS Key, s_name AS Key_1, s_acctbal AS Balance_ FROM supplier")
def n2(spark, sf):
    s = table(spark, sf, "supplier")
    return N.clean_names(s.select(F.col("s_suppkey").alias("Key!"), F.col("s_name").alias("Key"), F.col("s_acctbal").alias("Balance ($)")), "strip")


@query("n3_normalize_name", "SELECT DISTINCT p_name, trim(regexp_replace(lower(p_name), '[_\\s-]+', ' ', 'g')) AS normalized FROM part")
def n3(spark, sf):
    p = table(spark, sf, "part").select("p_name").distinct()
    return p.select("p_name", C.normalize_name(F.concat(F.lit(" "), F.translate("p_name", " ", "-"), F.lit("_"))).alias("normalized"))


@query("n4_trim_table", f"WITH {GAPS} SELECT o_orderkey, o_totalprice, o_orderpriority FROM gaps WHERE o_orderkey BETWEEN (SELECT min(o_orderkey) FROM gaps WHERE o_totalprice IS NOT NULL OR o_orderpriority IS NOT NULL) AND (SELECT max(o_orderkey) FROM gaps WHERE o_totalprice IS NOT NULL OR o_orderpriority IS NOT NULL)")
def n4(spark, sf):
    return N.trim_table(gaps(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderkey")


@query("n5_infer_types")
def n5(spark, sf):
    l = table(spark, sf, "lineitem").join(messy(spark, sf), ["l_orderkey", "l_linenumber"])
    return rounded(N.infer_types(l, ["l_orderkey", "l_linenumber"]), 4)


@query("n6_infer_types_by_cast", """SELECT * FROM (VALUES ('o_orderkey', 'quantitative', 0.8), ('o_custkey', 'quantitative', 0.8), ('o_orderstatus', 'qualitative', 0.6), ('o_totalprice', 'quantitative', 0.8), ('o_orderdate', 'temporal', 0.9), ('o_orderpriority', 'qualitative', 0.6)) v(column_name, dtype, confidence) WHERE (SELECT count(*) FROM orders) > 0""")
def n6(spark, sf):
    return N.infer_types_by_cast(gaps(spark, sf), "simple").withColumnRenamed("column", "column_name")


def _strict(c, numeric=False, moment=False):
    number = "count(*) > 0" if numeric else "false" if moment else f"count(TRY_CAST({c} AS DOUBLE)) = count({c})"
    date = "count(*) > 0" if moment else "false" if numeric else f"count(TRY_CAST({c} AS TIMESTAMP)) = count({c})"
    return f"SELECT '{c}' AS column_name, CASE WHEN {number} THEN 'numeric' WHEN {date} THEN 'timestamp' ELSE 'qualitative' END AS dtype, CAST(1.0 AS DOUBLE) AS confidence FROM gaps"


@query("n6_infer_types_strict", f"WITH {GAPS} " + " UNION ALL ".join([
    _strict("o_orderkey", True), _strict("o_custkey", True), _strict("o_orderstatus"), _strict("o_totalprice", True), _strict("o_orderdate", moment=True), _strict("o_orderpriority")]))
def n6_strict(spark, sf):
    return N.infer_types_by_cast(gaps(spark, sf), "strict").withColumnRenamed("column", "column_name")


@query("n7_to_number_locale", f"WITH {MESSY} SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN round(l_extendedprice, 2) WHEN 1 THEN round(l_extendedprice, 2) WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS DOUBLE) END AS price_text FROM lineitem")
def n7(spark, sf):
    return N.to_number_locale(messy(spark, sf), "price_text")



@query("n8_to_datetime", "SELECT o_orderkey, o_orderdate FROM orders")
def n8(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd-MM-yyyy").alias("o_orderdate"))
    return N.to_datetime(o, "o_orderdate").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("n9_to_category", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS flag FROM lineitem")
def n9(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", C.to_category(F.when(F.col("l_returnflag") == "R", "nan").otherwise(F.col("l_returnflag"))).alias("flag"))


@query("n10_year_columns", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE year(o_orderdate) END AS order_year FROM orders")
def n10(spark, sf):
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.year("o_orderdate").cast("string"))
    return N.year_columns(o.select("o_orderkey", text.alias("order_year")))


@query("n11_apply_types", f"WITH {MESSY} SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN round(l_extendedprice, 2) WHEN 1 THEN round(l_extendedprice, 2) WHEN 2 THEN CAST(CAST(l_quantity AS INT) AS DOUBLE) END AS price_text FROM lineitem")
def n11(spark, sf):
    return N.apply_types(messy(spark, sf), {"price_text": "quantitative", "l_linenumber": "qualitative"})


@query("n12_temporal_columns", """SELECT column_name AS column, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS physical,
  CASE WHEN column_name = 'l_shipdate' THEN 'datetime' END AS semantic, column_name = 'l_shipdate' AS is_temporal FROM information_schema.columns WHERE table_name = 'lineitem'""")
def n12(spark, sf):
    return N.temporal_columns(table(spark, sf, "lineitem").withMetadata("l_shipdate", {"semantic_type": "datetime"}))


@query("n13_detect_time_columns")
def n13(spark, sf):
    o = table(spark, sf, "orders")
    dated = o.withColumn("placed", F.date_format("o_orderdate", "dd/MM/yyyy"))
    return spark.createDataFrame([(c,) for c in N.detect_time_columns(dated, ["o_orderkey"])], "column_name string")


@query("n14_union_tables", """SELECT 'orders' AS _source_file, CAST(0 AS INTEGER) AS _table_index, 'o_orderdate' AS _time_columns, o_orderdate, o_totalprice AS amount, NULL AS event_type FROM orders
  UNION ALL SELECT 'events', 0, NULL, NULL, value, event_type FROM events""")
def n14(spark, sf):
    o = table(spark, sf, "orders").select("o_orderdate", F.col("o_totalprice").alias("amount"))
    e = table(spark, sf, "events").select(F.col("value").alias("amount"), "event_type")
    return N.union_tables([("orders", o), ("events", e)])


@query("n15_union_with_pivot", """SELECT 's' AS _source_file, CAST(0 AS INTEGER) AS _file_index, 'csv' AS _file_format, s_nationkey, CAST(NULL AS INTEGER) AS c_nationkey, 's_nationkey' AS _pivot_column, CAST(s_nationkey AS VARCHAR) AS _pivot_value, 'quantitative' AS _type_s_nationkey, NULL AS _type_c_nationkey FROM supplier
  UNION ALL SELECT 'c', 1, 'json', NULL, c_nationkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR), NULL, 'qualitative' FROM customer""")
def n15(spark, sf):
    s, c = table(spark, sf, "supplier").select("s_nationkey"), table(spark, sf, "customer").select("c_nationkey")
    return N.union_with_pivot([("s", "csv", s), ("c", "json", c)], {0: "s_nationkey", 1: "c_nationkey"}, {"s_nationkey": "quantitative"})


@query("n17_recode", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' ELSE l_returnflag END AS l_returnflag FROM lineitem")
def n17(spark, sf):
    return N.recode(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag", {"A": "accepted", "N": "none"})


# Recodings of benefit and age labels in the domain files.
PRESTATION_MAP = {
    "RSA seul": "RSA", "RSA SEUL": "RSA", "PA seule": "PA", "PA SEULE": "PA", "Prime d'activité": "PA", "PRIME D'ACTIVITE": "PA",
    "RSA et PA": "RSA_ET_PA", "RSA ET PA": "RSA_ET_PA",
}
AGE_MAP = {
    "Moins de 25 ans": "<25", "Entre 25 et 29 ans": "25-29", "Entre 30 et 34 ans": "30-34", "Entre 35 et 39 ans": "35-39", "Entre 40 et 44 ans": "40-44",
    "Entre 45 et 49 ans": "45-49", "Entre 50 et 54 ans": "50-54", "Entre 55 et 59 ans": "55-59", "Entre 60 et 64 ans": "60-64", "65 ans ou plus": "65+",
    "Age indéterminé": "Indéterminé",
}


def _long(spark, sf):
    p = N.recode(N.recode(_pair(spark, sf), "RSA ou PPA", PRESTATION_MAP), "Age responsable dossier", AGE_MAP)
    p = p.withColumn("Year", F.year(C.to_moment(F.col("`Date référence`"), "yyyy-MM-dd")))
    category = F.when(F.col("Source") == "Age", F.concat(F.lit("Age_"), F.col("Age responsable dossier"))).when(
        F.col("Source") == "Situation_Familiale", F.concat(F.lit("Famille_"), F.col("Situation familiale"))).otherwise("Other")
    p = p.withColumnRenamed("Nom département", "dept").withColumnRenamed("RSA ou PPA", "prestation")
    return N.to_long(p, ["dept", "Year", "Source", "prestation"], ["Nombre foyers RSA_PPA", "Nombre personnes RSA_PPA"], category)


_AGE_SHORT = "CASE age " + " ".join(f"WHEN '{a}' THEN '{AGE_MAP[a]}'" for a in _SEGMENT_AGES) + " END"
_LONG_SQL = f"""{_PAIR_SQL}, cat AS (SELECT dept, src, k, p, CASE src WHEN 'Age' THEN 'Age_' || {_AGE_SHORT} ELSE 'Famille_' || seg END AS category FROM pair),
  long AS (SELECT dept, src, category, 'Nombre foyers RSA_PPA' AS ind, CAST(k AS DOUBLE) AS v FROM cat UNION ALL SELECT dept, src, category, 'Nombre personnes RSA_PPA', CAST(p AS DOUBLE) FROM cat)"""


@query("n18_to_long", f"WITH {_LONG_SQL} SELECT dept, CAST(2023 AS INTEGER) AS \"Year\", src AS \"Source\", 'RSA' AS prestation, category AS \"Category\", ind AS \"Indicator\", v AS \"Value\" FROM long")
def n18(spark, sf):
    return _long(spark, sf)


#: All keys of the panel: five age bands and five family groups, each with both counts.
_PANEL = [f"{category}_{ind}" for category in [*(f"Age_{AGE_MAP[a]}" for a in _SEGMENT_AGES), *(f"Famille_{s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))] for ind in ("Nombre foyers RSA_PPA", "Nombre personnes RSA_PPA")]


@query("n19_indicator_panel", f"WITH {_LONG_SQL} SELECT dept, CAST(2023 AS INTEGER) AS \"Year\", " + ", ".join(f"coalesce(sum(CASE WHEN category || '_' || ind = '{k}' THEN v END), 0.0) AS \"{k}\"" for k in _PANEL) + " FROM long GROUP BY 1")
def n19(spark, sf):
    return N.indicator_panel(_long(spark, sf), ["dept", "Year"])


@query("n20_coverage", f"WITH {GAPS} " + " UNION ALL ".join(f"SELECT '{c}' AS variable, round(count({c}) * 1.0 / count(*), 6) AS coverage FROM gaps" for c in ("o_totalprice", "o_orderpriority", "o_custkey")))
def n20(spark, sf):
    return rounded(N.coverage(gaps(spark, sf), ["o_totalprice", "o_orderpriority", "o_custkey"]))


@query("n20_filter_by_coverage", f"WITH {GAPS} SELECT o_orderkey, o_orderpriority, o_custkey FROM gaps")
def n20_filter(spark, sf):
    g = gaps(spark, sf)
    return g.select("o_orderkey", *N.filter_by_coverage(g, ["o_totalprice", "o_orderpriority", "o_custkey"], 0.9))


@query("n21_impute", f"WITH {GAPS} SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM gaps)), 6) AS o_totalprice FROM gaps")
def n21(spark, sf):
    return rounded(N.impute(gaps(spark, sf).select("o_orderkey", "o_totalprice"), ["o_totalprice"], "median"))


@query("n22_scale", """SELECT l_orderkey, l_linenumber, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity FROM lineitem""")
def n22(spark, sf):
    return rounded(N.scale(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"]))


@query("n22_scale_robust", """SELECT l_orderkey, l_linenumber, round((l_extendedprice - q[2]) / (q[3] - q[1]), 6) AS l_extendedprice FROM lineitem, (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)""")
def n22r(spark, sf):
    return rounded(N.scale(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_extendedprice"], "robust"))


@query("n23_log1p_if_nonneg", "SELECT c_custkey, round(ln(1 + c_custkey), 6) AS k, c_acctbal FROM customer")
def n23(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("double").alias("k"), "c_acctbal")
    return rounded(N.log1p_if_nonneg(c, ["k", "c_acctbal"]), 6)


@query("n24_label_encode", f"WITH {GAPS}, c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(o_orderpriority, 'nan') AS v FROM gaps)) SELECT o_orderkey, code AS o_orderpriority FROM gaps JOIN c ON coalesce(o_orderpriority, 'nan') = v")
def n24(spark, sf):
    return N.label_encode(gaps(spark, sf).select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


def _narrow(c, kind):
    if kind == "double":
        return f"SELECT '{c}' AS column_name, 'double' AS from_type, CASE WHEN max(abs({c})) < 3.4028234663852886e38 THEN 'float' ELSE 'double' END AS to_type FROM lineitem"
    return f"SELECT '{c}', '{kind}', CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint' WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint' WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END FROM lineitem"


@query("n25_narrow_types", " UNION ALL ".join([_narrow(c, "double") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")] + [_narrow(c, "bigint") for c in ("l_orderkey", "l_partkey", "l_suppkey")] + [_narrow("l_linenumber", "int")]))
def n25(spark, sf):
    return N.narrow_plan(table(spark, sf, "lineitem")).withColumnRenamed("column", "column_name")


@query("n26_safe_arithmetic", "SELECT l_orderkey, l_linenumber, TRY_CAST(l_returnflag AS DOUBLE) AS f, TRY_CAST(CAST(l_linenumber AS VARCHAR) AS BIGINT) AS i, CASE WHEN l_discount = 0 THEN 0.0 ELSE round(l_tax / l_discount, 6) END AS ratio, CASE WHEN l_tax = 0 THEN 0.0 ELSE round(l_discount / l_tax * 100, 6) END AS pct FROM lineitem")
def n26(spark, sf):
    l = table(spark, sf, "lineitem")
    return rounded(l.select(
        "l_orderkey", "l_linenumber", C.safe_float(F.col("l_returnflag")).alias("f"), C.safe_int(F.col("l_linenumber").cast("string")).alias("i"),
        C.safe_divide(F.col("l_tax"), F.col("l_discount")).alias("ratio"), C.safe_percentage(F.col("l_discount"), F.col("l_tax")).alias("pct")))

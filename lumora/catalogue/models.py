"""Encoding, components, clusters, fitted models and metrics over line items, parts, events and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.catalogue.registry import GAPS, gaps, query, rounded, table
from lumora.operators import linear as L
from lumora.operators import models as M

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lines(spark, sf):
    return table(spark, sf, "lineitem")


@query("m1_encode_mixed", f"""WITH {GAPS}, c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(o_orderpriority, 'nan') AS v FROM gaps)),
  e AS (SELECT o_orderkey, o_totalprice, code FROM gaps JOIN c ON coalesce(o_orderpriority, 'nan') = v WHERE o_totalprice IS NOT NULL)
  SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM e)) / (SELECT stddev_pop(o_totalprice) FROM e), 6) AS o_totalprice, round((code - (SELECT avg(code) FROM e)) / (SELECT stddev_pop(code) FROM e), 6) AS o_orderpriority FROM e""")
def m1(spark, sf):
    return rounded(M.encode_mixed(gaps(spark, sf).select("o_orderkey", "o_totalprice", "o_orderpriority"), ["o_totalprice", "o_orderpriority"]))


@query("m2_pca")
def m2(spark, sf):
    return rounded(L.pca(lines(spark, sf).select(*KEY[:2], *NUM), NUM, 2))


@query("m2_pca_first_axis", """WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS b, stddev_pop(l_extendedprice) AS t, sign(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
  SELECT l_orderkey, l_linenumber, round(((l_quantity - a) / s + r * (l_extendedprice - b) / t) / sqrt(2), 6) AS pc1 FROM lineitem, m""")
def m2f(spark, sf):
    return rounded(L.pca(lines(spark, sf).select(*KEY[:2], "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"], 1).select(*KEY[:2], "pc1"))


@query("m2_pca_variance", """WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT CAST(1 AS INTEGER) AS component, round((1 + abs(r)) / 2, 6) AS explained, round((1 + abs(r)) / 2, 6) AS cumulative, CAST(CASE WHEN (1 + abs(r)) / 2 >= 0.95 THEN 1 ELSE 2 END AS INTEGER) AS needed_for_95 FROM c
  UNION ALL SELECT 2, round((1 - abs(r)) / 2, 6), 1.0, CAST(CASE WHEN (1 + abs(r)) / 2 >= 0.95 THEN 1 ELSE 2 END AS INTEGER) FROM c""")
def m2v(spark, sf):
    return rounded(L.pca_variance(lines(spark, sf), ["l_quantity", "l_extendedprice"]))


@query("m3_kmeans")
def m3(spark, sf):
    return rounded(M.kmeans_summary(lines(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"], 3), 2)


@query("m4_cluster_stats", "SELECT label AS cluster, count(*) AS count, round(avg(embedding[1]), 3) AS e1_mean, round(stddev_samp(embedding[1]), 3) AS e1_std, round(avg(embedding[2]), 3) AS e2_mean, round(stddev_samp(embedding[2]), 3) AS e2_std FROM embeddings GROUP BY 1")
def m4(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("cluster"), F.col("embedding")[0].cast("double").alias("e1"), F.col("embedding")[1].cast("double").alias("e2"))
    return M.cluster_stats(e, ["e1", "e2"])


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    size = len(e.select("embedding").first()[0])
    names = [f"e{i}" for i in range(size)]
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names


@query("m5_hierarchical_clusters")
def m5(spark, sf):
    return M.hierarchical_clusters(lines(spark, sf).select(*KEY[:2], *NUM), NUM, 4).select(*KEY[:2], "cluster")


@query("m6_spectral_clusters")
def m6(spark, sf):
    e, names = _vectors(spark, sf)
    return M.spectral_clusters(e, names, 10).select("vec_id", "cluster")


@query("m7_dbscan")
def m7(spark, sf):
    return M.dbscan(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], ["p_partkey"], 0.2, 5)


@query("m8_isolation_forest")
def m8(spark, sf):
    return rounded(M.isolation_forest(lines(spark, sf).select(*KEY, *NUM[1:]), ["l_extendedprice", "l_discount", "l_tax"], KEY, 0.05))


@query("t22_anomalies_forest")
def t22(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value")
    return rounded(M.isolation_forest(e, ["value"], ["event_id"], 0.05).where("outlier"))


@query("m9_factor_analysis")
def m9(spark, sf):
    e, names = _vectors(spark, sf)
    return rounded(L.factor_loadings(e, names, 2), 4)


_OLS = """s AS (SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_discount, l_discount) AS d, covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q,
  avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my FROM lineitem), w AS (SELECT *, (d * p - b * q) / (a * d - b * b) AS w1, (a * q - b * p) / (a * d - b * b) AS w2 FROM s)"""


@query("m10_linear_model", f"""WITH {_OLS} SELECT '(constant)' AS term, round(my - w1 * mx - w2 * mz, 3) AS coefficient FROM w UNION ALL SELECT 'l_quantity', round(w1, 3) FROM w UNION ALL SELECT 'l_discount', round(w2, 3) FROM w""")
def m10(spark, sf):
    return rounded(L.coefficients(lines(spark, sf), ["l_quantity", "l_discount"], "l_extendedprice"), 3)


@query("m10_linear_predictions", f"WITH {_OLS} SELECT l_orderkey, l_linenumber, round(my + w1 * (l_quantity - mx) + w2 * (l_discount - mz), 3) AS prediction FROM lineitem, w")
def m10p(spark, sf):
    l = lines(spark, sf).select(*KEY[:2], "l_quantity", "l_discount", "l_extendedprice")
    return rounded(M.fit_predict_regression(l, l, ["l_quantity", "l_discount"], "l_extendedprice", "linear").select(*KEY[:2], "prediction"), 3)


@query("m10_ridge_model", """WITH s AS (SELECT count(*) AS n, covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_extendedprice) AS p, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem), w AS (SELECT *, n * p / (n * a + 1) AS w1 FROM s)
  SELECT '(constant)' AS term, round(my - w1 * mx, 3) AS coefficient FROM w UNION ALL SELECT 'l_quantity', round(w1, 3) FROM w""")
def m10r(spark, sf):
    return rounded(L.coefficients(lines(spark, sf), ["l_quantity"], "l_extendedprice", "ridge"), 3)


@query("m10_lasso_model", """WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_extendedprice) AS p, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem), w AS (SELECT *, sign(p) * greatest(abs(p) - 0.1, 0) / a AS w1 FROM s)
  SELECT '(constant)' AS term, round(my - w1 * mx, 3) AS coefficient FROM w UNION ALL SELECT 'l_quantity', round(w1, 3) FROM w""")
def m10l(spark, sf):
    return rounded(L.coefficients(lines(spark, sf), ["l_quantity"], "l_extendedprice", "lasso"), 3)


@query("m11_tree_regressors")
def m11(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.length("p_name").cast("double").alias("name_length"), "p_retailprice")
    return M.compare_models(p, ["p_size", "name_length"], "p_retailprice", ["random_forest", "gradient_boosting"], ["p_partkey"])


@query("m12_ransac")
def m12(spark, sf):
    return rounded(L.ransac(lines(spark, sf), ["l_quantity"], "l_extendedprice", KEY), 3)


@query("m12_theil_sen")
def m12t(spark, sf):
    return rounded(L.theil_sen(lines(spark, sf), ["l_quantity"], "l_extendedprice", KEY), 3)


def _labelled(spark, sf):
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "text"), "doc_id")
    words = F.size(F.split("text", r"\s+")).cast("double")
    return l.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), words.alias("words"), F.col("quality").cast("string").alias("quality"))


@query("m13_classifiers")
def m13(spark, sf):
    return M.compare_models(_labelled(spark, sf), ["n_chars", "words"], "quality", ["logistic", "random_forest", "gradient_boosting", "linear_svm", "naive_bayes", "knn"], ["doc_id"], True)


_KNN = """e AS (SELECT vec_id, label, [CAST(v AS DOUBLE) for v in embedding] AS x, vec_id % 5 = 0 AS held FROM embeddings), d AS (SELECT a.vec_id, CAST(b.label AS VARCHAR) AS y, list_distance(a.x, b.x) AS d FROM e a, e b WHERE a.held AND NOT b.held),
  k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, y) AS r FROM d), v AS (SELECT vec_id, y, count(*) AS c FROM k WHERE r <= 5 GROUP BY 1, 2)"""


@query("m14_knn_classify", f"WITH {_KNN} SELECT CAST(vec_id AS VARCHAR) AS vec_id, y AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, y) AS r FROM v) WHERE r = 1")
def m14(spark, sf):
    e, names = _vectors(spark, sf)
    held = F.col("vec_id") % 5 == 0
    return M.knn_classify(e.where(~held), e.where(held), names, "label", "vec_id")


@query("m15_gaussian_classifiers")
def m15(spark, sf):
    e, names = _vectors(spark, sf)
    return M.compare_models(e.withColumn("label", F.col("label").cast("string")), names, "label", ["lda", "qda", "naive_bayes"], ["vec_id"], True)


@query("m16_regression_metrics", f"""WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem), m AS (SELECT count(*) AS n, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v, avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) AS ape FROM p)
  SELECT n, round(1 - mse / v, 6) AS r2, round(sqrt(mse), 4) AS rmse, round(mae, 4) AS mae, round(mse, 1) AS mse, round(ape * 100, 6) AS mape FROM m""")
def m16(spark, sf):
    l = lines(spark, sf).select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return rounded(M.regression_metrics(l, "y", "p"), 6, rmse=4, mae=4, mse=1)


_RULE = "CASE WHEN l_extendedprice > 60000 THEN 'A' WHEN l_extendedprice > 30000 THEN 'N' ELSE 'R' END"


def _ruled(spark, sf):
    x = F.col("l_extendedprice")
    return lines(spark, sf).select(F.col("l_returnflag").alias("y"), F.when(x > 60000, "A").when(x > 30000, "N").otherwise("R").alias("p"))


@query("m17_classification_metrics", f"""WITH r AS (SELECT l_returnflag AS y, {_RULE} AS p FROM lineitem), l AS (SELECT y, count(*) AS s, count(*) FILTER (y = p) AS tp FROM r GROUP BY 1), q AS (SELECT p, count(*) AS m FROM r GROUP BY 1),
  e AS (SELECT s, tp, coalesce(tp * 1.0 / m, 0) AS pr, tp * 1.0 / s AS rc FROM l LEFT JOIN q ON l.y = q.p), f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM e)
  SELECT CAST(sum(s) AS BIGINT) AS n, round(sum(tp) / sum(s), 6) AS accuracy, round(sum(s * pr) / sum(s), 6) AS precision, round(sum(s * rc) / sum(s), 6) AS recall, round(sum(s * f1) / sum(s), 6) AS f1 FROM f""")
def m17(spark, sf):
    return rounded(M.classification_metrics(_ruled(spark, sf), "y", "p"))


@query("m18_confusion_matrix", f"SELECT a.l AS actual, b.l AS predicted, count(r.y) AS count FROM (SELECT unnest(['A','N','R']) AS l) a CROSS JOIN (SELECT unnest(['A','N','R']) AS l) b LEFT JOIN (SELECT l_returnflag AS y, {_RULE} AS p FROM lineitem) r ON r.y = a.l AND r.p = b.l GROUP BY 1, 2")
def m18(spark, sf):
    return M.confusion_counts(_ruled(spark, sf), "y", "p")


def _scored(spark, sf):
    return lines(spark, sf).select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") * 100 + F.round(F.col("l_discount") * 100)).alias("s"))


_ROC = "s AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity * 100 + round(l_discount * 100) AS s FROM lineitem), g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY 1)"


@query("m19_roc_points", f"WITH {_ROC} SELECT s AS threshold, round(sum(n) OVER w / (SELECT sum(n) FROM g), 8) AS fpr, round(sum(p) OVER w / (SELECT sum(p) FROM g), 8) AS tpr FROM g WINDOW w AS (ORDER BY s DESC)")
def m19(spark, sf):
    return rounded(M.roc_points(_scored(spark, sf), "y", "s"), 8)


@query("m19_auc", f"WITH {_ROC}, c AS (SELECT p, n, sum(n) OVER (ORDER BY s) AS b FROM g) SELECT round(sum(p * (b - n / 2.0)) / (sum(p) * sum(n)), 8) AS auc FROM c")
def m19a(spark, sf):
    return rounded(M.auc(_scored(spark, sf), "y", "s"), 8)


@query("m20_cross_validate", """WITH o AS (SELECT o_custkey::DOUBLE AS x, o_totalprice AS y, (row_number() OVER (ORDER BY o_orderkey) - 1) * 5 // count(*) OVER () AS f FROM orders), t AS (SELECT f.f, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM (SELECT DISTINCT f FROM o) f JOIN o ON o.f <> f.f GROUP BY 1),
  r AS (SELECT o.f, 1 - sum((y - a * x - b) * (y - a * x - b)) / (var_pop(y) * count(*)) AS r2 FROM o JOIN t ON o.f = t.f GROUP BY 1) SELECT CAST(count(*) AS INTEGER) AS folds, round(avg(r2), 6) AS mean_score, round(stddev_pop(r2), 6) AS std_score FROM r""")
def m20(spark, sf):
    o = M.contiguous_folds(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 5)
    return rounded(M.cross_validate(o, ["o_custkey"], "o_totalprice", "linear"))


@query("m20_stratified_folds", """WITH o AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) SELECT o_orderkey, o_orderstatus, CAST(least(4, k * 5 // n) AS INTEGER) AS fold FROM o""")
def m20s(spark, sf):
    return M.stratified_folds(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 5)


@query("m21_compare_models")
def m21(spark, sf):
    return M.compare_models(lines(spark, sf), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["linear", "ridge", "lasso", "elastic_net", "ransac", "theil_sen"], KEY, cv=5)


@query("m21_compare_linear", """WITH o AS (SELECT o_orderkey, o_custkey::DOUBLE AS x0, o_totalprice AS y, row_number() OVER (ORDER BY md5(concat_ws('|', o_orderkey, '42')), o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders),
  s AS (SELECT *, p < floor(n * (1 - 0.2)) AS train, CAST(floor(n * (1 - 0.2)) AS BIGINT) AS nt FROM o), z AS (SELECT avg(x0) FILTER (train) AS a, stddev_pop(x0) FILTER (train) AS d FROM s),
  t AS (SELECT p, train, (x0 - a) / d AS x, y, CASE WHEN train THEN CASE WHEN p < (nt % 5) * (nt // 5 + 1) THEN p // (nt // 5 + 1) ELSE nt % 5 + (p - (nt % 5) * (nt // 5 + 1)) // (nt // 5) END END AS fold FROM s, z),
  f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS c FROM t WHERE train),
  m AS (SELECT train, 1 - avg((y - b * x - c) * (y - b * x - c)) / var_pop(y) AS r2, sqrt(avg((y - b * x - c) * (y - b * x - c))) AS rmse, avg(abs(y - b * x - c)) AS mae FROM t, f GROUP BY train),
  g AS (SELECT i, regr_slope(y, x) AS b, regr_intercept(y, x) AS c FROM t, range(5) AS r(i) WHERE train AND fold <> i GROUP BY i),
  v AS (SELECT 1 - sum((y - b * x - c) * (y - b * x - c)) / (var_pop(y) * count(*)) AS s FROM t JOIN g ON t.fold = g.i GROUP BY i)
  SELECT 'linear' AS model, round(a.r2, 4) AS train_r2, round(a.rmse, 4) AS train_rmse, round(a.mae, 4) AS train_mae, round(h.r2, 4) AS test_r2, round(h.rmse, 4) AS test_rmse, round(h.mae, 4) AS test_mae,
    round((SELECT avg(s) FROM v), 4) AS cv_mean, round((SELECT stddev_pop(s) FROM v), 4) AS cv_std FROM m a, m h WHERE a.train AND NOT h.train""")
def m21l(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey"), "o_totalprice")
    return M.compare_models(o, ["o_custkey"], "o_totalprice", ["linear"], ["o_orderkey"], cv=5)


@query("m22_feature_importance")
def m22(spark, sf):
    return rounded(M.feature_importance(lines(spark, sf), ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_extendedprice"))


@query("m23_binarize_by_percentile", "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.75) FROM lineitem) AS INTEGER) AS target FROM lineitem")
def m23(spark, sf):
    return M.binarize_by_percentile(lines(spark, sf), "l_extendedprice", 0.75).select("l_orderkey", "l_linenumber", "target")


@query("m24_ml_summary", "WITH r AS (" + " UNION ALL ".join(f"SELECT corr({a}, {b}) AS r FROM lineitem" for i, a in enumerate(NUM) for b in NUM[:i]) + """), s AS (SELECT count(*) FILTER (abs(r) > 0.8) AS k FROM r), n AS (SELECT count(*) AS n FROM lineitem)
  SELECT n, CAST(4 AS INTEGER) AS features, k AS strong_pairs, 0.0::DOUBLE AS missing_percentage, 'Excelente' AS quality, concat_ws(',', CASE WHEN n < 20 THEN 'very_few_rows' WHEN n < 40 THEN 'few_rows' END, CASE WHEN k > 0 THEN 'correlated_features' END) AS alerts,
  CASE WHEN n >= 40 THEN 'Excelente' WHEN n >= 20 THEN 'Buena' ELSE 'Revisar' END AS readiness FROM n, s""")
def m24(spark, sf):
    return M.ml_summary(lines(spark, sf), NUM)


@query("m25_residual_rows", "SELECT l_quantity * 1500 AS fitted, round(l_extendedprice - l_quantity * 1500, 6) AS residual FROM lineitem")
def m25(spark, sf):
    l = lines(spark, sf).select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return rounded(M.residual_rows(l, "y", "p"))


@query("m26_project_2d")
def m26(spark, sf):
    l = lines(spark, sf).select(*KEY, "l_returnflag", *NUM)
    return rounded(M.project_2d(l, NUM, "l_returnflag", KEY))


@query("m27_quick_fit", f"""WITH {GAPS}, o AS (SELECT o_custkey::DOUBLE AS x, coalesce(o_totalprice, 0) AS y, (row_number() OVER (ORDER BY o_orderkey) - 1) * 5 // count(*) OVER () AS f FROM gaps), t AS (SELECT f.f, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM (SELECT DISTINCT f FROM o) f JOIN o ON o.f <> f.f GROUP BY 1),
  r AS (SELECT o.f, 1 - sum((y - a * x - b) * (y - a * x - b)) / (var_pop(y) * count(*)) AS r2 FROM o JOIN t ON o.f = t.f GROUP BY 1), s AS (SELECT CAST(count(*) AS INTEGER) AS folds, avg(r2) AS m, stddev_pop(r2) AS d FROM r)
  SELECT (SELECT count(*) FROM o) AS n, (SELECT round(regr_r2(y, x), 6) FROM o) AS r2_train, (SELECT round(sqrt(regr_syy(y, x) * (1 - regr_r2(y, x)) / count(*)), 4) FROM o) AS rmse, folds, round(m, 6) AS mean_score, round(d, 6) AS std_score FROM s""")
def m27(spark, sf):
    return rounded(M.quick_fit(gaps(spark, sf), "o_totalprice", ["o_orderkey"]), 6, rmse=4)

"""Models and clusters against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.operators import linear as L
from lumora.operators import models as M
from lumora.operators.relational import key_mark
from lumora.plans.order import rank_ranges
from lumora.plans.sizing import cut_lineage


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3)) * [1, 2, 0.5] + [5, -1, 2]
    y = 3 + x @ [1.5, -2.0, 0.0] + rng.normal(0, 0.1, 200)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "i int, a double, b double, c double, y double")


def test_ridge_and_lasso(numbers):
    x, y, df = numbers
    xc, yc = x - x.mean(0), y - y.mean()
    w, c = L.fit_linear(df, ["a", "b", "c"], "y", "ridge")
    assert np.allclose(w, np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)) and c == pytest.approx(y.mean() - x.mean(0) @ w)
    w, _ = L.fit_linear(df, ["a", "b", "c"], "y", "lasso")
    slope = xc.T @ (yc - xc @ w) / 200
    for j in range(3):  # optimality: the gradient is ±0.1 where a weight is used, smaller elsewhere
        assert abs(slope[j] - 0.1 * np.sign(w[j])) < 1e-6 if w[j] else abs(slope[j]) <= 0.1 + 1e-9
    w, _ = L.fit_linear(df, ["a", "b", "c"], "y", "elastic_net")
    slope = xc.T @ (yc - xc @ w) / 200 - 0.05 * w
    assert all(abs(slope[j] - 0.05 * np.sign(w[j])) < 1e-6 if w[j] else abs(slope[j]) <= 0.05 + 1e-9 for j in range(3))


def test_pca_scores(numbers):
    x, _, df = numbers
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(z.T @ z / 200)
    v = vectors[:, ::-1]
    v = v * np.sign(v[np.abs(v).argmax(0), range(3)])
    got = np.array([[r["pc1"], r["pc2"], r["pc3"]] for r in L.pca(df, ["a", "b", "c"], 3).orderBy("i").collect()])
    assert np.allclose(got, z @ v)
    share = [r["explained"] for r in L.pca_variance(df, ["a", "b", "c"]).orderBy("component").collect()]
    assert np.allclose(share, values[::-1] / 3)


def test_factor_model_reproduces_covariance(spark):
    rng = np.random.default_rng(4)
    f = rng.normal(size=(4000, 1))
    load = np.array([[0.9, 0.7, 0.5, 0.8]])
    x = f @ load + rng.normal(size=(4000, 4)) * 0.4
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    rows = L.factor_loadings(df, ["a", "b", "c", "d"], 1).collect()
    assert np.allclose([r["loadings"][0] for r in rows], load[0], atol=0.05) and all(abs(r["noise"] - 0.16) < 0.03 for r in rows)


def test_robust_lines_resist_outliers(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, 400)
    y = 2 + 3 * x + rng.normal(0, 0.2, 400)
    y[:80] = rng.uniform(200, 400, 80)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x double, y double")
    for rows in (L.ransac(df, ["x"], "y", ["i"]).collect(), L.theil_sen(df, ["x"], "y", ["i"]).collect()):
        got = {r["term"]: r["coefficient"] for r in rows}
        assert got["x"] == pytest.approx(3, abs=0.4)


def test_ranges_of_ranks_leave_rows_where_they_are(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), float(v)) for i, v in zip(rng.integers(0, 40, 300), rng.normal(size=300))]
    df = cut_lineage(spark.createDataFrame(rows, "i int, v double").repartition(3).withColumn("_mark", key_mark(["i"], 42)))
    ranked = {}
    for pos, r in enumerate(df.orderBy("_mark", "i", "v").collect()):
        ranked.setdefault(r["_mark"], []).append(pos)
    for ranks in ([240], [0, 60, 120, 299], [300, 400], [5, 5, 6], list(range(0, 300, 7))):
        got = rank_ranges(df, ["_mark", "i", "v"], lambda n: [r * n // 300 for r in ranks], "k").collect()
        want = {(r["_mark"], r["v"]): 0 for r in got}
        for pos, r in enumerate(df.orderBy("_mark", "i", "v").collect()):
            want[r["_mark"], r["v"]] = sum(pos >= x for x in ranks)
        assert len(got) == 300 and all(r["k"] == want[r["_mark"], r["v"]] for r in got)
    assert rank_ranges(df.where("false"), ["_mark"], lambda n: [0, n], "k").count() == 0
    plan = rank_ranges(df, ["_mark", "i"], lambda n: [n // 2], "k").where("k = 0").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("cv", [None, 5])
def test_linear_models_are_compared_without_moving_rows(spark, monkeypatch, cv):
    """Same scores as with rows put in order, as for other models; nothing but counts and rows at bounds is checkpointed."""
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b), float(3 * a - b + e)) for i, (a, b, e) in enumerate(rng.normal(size=(700, 3)))]
    df = spark.createDataFrame([*rows, (700, None, 1.0, 2.0), *rows[:20]], "i int, `a b` double, b double, y double")
    names = ["linear", "ransac"]
    pinned, keep = [], M.cut_lineage

    def counted(rows):
        out = keep(rows)
        pinned.append(out.count())
        return out

    monkeypatch.setattr(M, "cut_lineage", counted)
    got = [tuple(r) for r in M.compare_models(df, ["a b", "b"], "y", names, ["i"], cv=cv).collect()]
    assert pinned == []
    data = M.split_random(df.dropna(), ["i"]).collect()
    mean = {c: np.mean([r[c] for r in data if r["split"] == "train"]) for c in ("a b", "b")}
    x = np.array([[r["a b"] - mean["a b"], r["b"] - mean["b"]] for r in data])
    y, train = np.array([r["y"] for r in data]), np.array([r["split"] == "train" for r in data])
    design = np.column_stack([np.ones(len(x)), x])
    gap = y - design @ np.linalg.lstsq(design[train], y[train], rcond=None)[0]
    score = [round(1 - (gap[t] ** 2).mean() / y[t].var(), 4) for t in (train, ~train)]
    linear = next(r for r in got if r[0] == "linear")
    assert [linear[1], linear[4]] == pytest.approx(score, abs=1e-4) and train.sum() == 576
    assert len(got) == 2 and all((r[7] is not None) == bool(cv) for r in got)


@pytest.mark.parametrize("features", [["x"], ["x", "z", "w"]])
def test_trial_lines_count_the_same_rows_as_expressions(spark, features):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame(rng.normal(size=(500, 4)).round(1).tolist(), "x double, z double, w double, y double")
    fits = rng.normal(size=(12, len(features) + 1)).round(1)
    near = [F.sum((F.abs(F.col("y") - L.linear_form(features, f[1:], f[0])) <= 0.5).cast("long")) for f in fits]
    assert L._inliers(df.select(*features, "y"), fits, 0.5) == list(df.agg(*near).first())
    assert L._inliers(df.where("false").select(*features, "y"), fits, 0.5) == [0] * 12


def test_least_hashes_of_many_rows(spark):
    df = spark.range(3000).select((F.col("id") % 900).alias("i"), F.col("id").cast("double").alias("x"), F.when(F.col("id") % 7 > 0, F.col("id") * 2.0).alias("y"))
    mark = F.xxhash64("i", F.lit(42))
    for n in (10, 600, 2000, 5000):
        want = [r[0] for r in df.dropna().orderBy(mark, F.array("x", "y")).limit(n).select("x").collect()]
        assert L.hashed_rows(df, ["x", "y"], n, ["i"], 42)[:, 0].tolist() == want


def brute_dbscan(x, eps, m):
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    core = near.sum(1) >= m
    label, cluster = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], cluster
            while stack:
                j = stack.pop()
                for k in np.flatnonzero(near[j]):
                    if label[k] < 0:
                        label[k] = cluster
                        if core[k]:
                            stack.append(int(k))
            cluster += 1
    return core, label


def test_dbscan_against_pairs(spark, plan):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(0, 0.3, (80, 2)), rng.normal(4, 0.3, (60, 2)), rng.uniform(-6, 10, (25, 2)), np.tile([8.0, -4.0], (40, 1))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double")
    core, label = brute_dbscan(x, 0.5, 5)
    got = {r["i"]: r["cluster"] for r in M.dbscan(df, ["a", "b"], ["i"], 0.5, 5, scaled=False).collect()}
    assert len(got) == len(x)
    pairs = {(got[i], label[i]) for i in range(len(x)) if core[i]}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert all((got[i] == -1) == (label[i] == -1) for i in range(len(x)))


def test_isolation_forest_flags_the_far_points(spark, plan):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(300, 2)), [[9, 9], [-8, 9], [10, -9]]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double")
    rows = M.isolation_forest(df, ["a", "b"], ["i"], 0.01).collect()
    assert len(rows) == 303 and {300, 301, 302} <= {r["i"] for r in sorted(rows, key=lambda r: -r["score"])[:6]}
    assert all(0 < r["score"] < 1 for r in rows) and sum(r["outlier"] for r in rows) <= 4


def test_knn_over_blocks(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 4))
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "i int, a double, b double, c double, d double, y int")
    train, test = df.where("i < 110"), df.where("i >= 110")
    cols = ["a", "b", "c", "d"]
    one = {r["i"]: r["prediction"] for r in M.knn_classify(train, test, cols, "y", "i").collect()}
    many = {r["i"]: r["prediction"] for r in M.knn_classify(train, test, cols, "y", "i", block_rows=17).collect()}
    assert one == many and len(one) == 40
    for i in range(110, 150):
        near = np.argsort(np.linalg.norm(x[:110] - x[i], axis=1))[:5]
        assert one[str(i)] == str(int(y[near].sum() >= 3))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(9)
    centres = np.array([[0, 0], [6, 0], [0, 6]])
    rows = [(i, *map(float, centres[i % 3] + rng.normal(0, 0.6, 2)), "abc"[i % 3]) for i in range(240)]
    return spark.createDataFrame(rows, "i int, a double, b double, y string")


@pytest.mark.parametrize("model", M.CLASSIFIERS)
def test_classifiers_separate_blobs(blobs, model):
    out = M.fit_predict_classes(blobs.where("i < 180"), blobs.where("i >= 180"), ["a", "b"], "y", model, trees=5)
    assert M.classification_metrics(out, "y", "prediction").first()["accuracy"] > 0.9


@pytest.mark.parametrize("cluster", [M.kmeans, M.hierarchical_clusters, lambda d, c, k: M.spectral_clusters(d, c, k, landmarks=20)])
def test_clusters_find_blobs(blobs, cluster):
    out = cluster(blobs, ["a", "b"], 3)
    assert out.groupBy("cluster").agg(F.count_distinct("y").alias("n")).agg(F.max("n")).first()[0] == 1
    assert M.cluster_stats(out, ["a", "b"]).agg(F.sum("count")).first()[0] == 240


@pytest.mark.parametrize("model", M.REGRESSORS)
def test_regressors_fit(numbers, model):
    df = numbers[2]
    out = M.fit_predict_regression(df.where("i < 150"), df.where("i >= 150"), ["a", "b", "c"], "y", model, trees=20)
    assert M.regression_metrics(out, "y", "prediction").first()["r2"] > 0.75


def test_cross_validation_of_trees_and_classes(numbers, blobs):
    folds = M.contiguous_folds(numbers[2], ["i"], 3)
    row = M.cross_validate(folds, ["a", "b"], "y", "random_forest", trees=5).first()
    assert row["folds"] == 3 and row["mean_score"] > 0.5
    row = M.cross_validate(M.stratified_folds(blobs, "y", ["i"], 3), ["a", "b"], "y", "lda", classes=True).first()
    assert row["folds"] == 3 and row["mean_score"] > 0.9


def test_auc_equals_pairs_won(spark, plan):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 80), np.round(rng.normal(size=80), 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    gap = s[y == 1][:, None] - s[y == 0][None]
    assert M.auc(df, "y", "s").first()["auc"] == pytest.approx(((gap > 0) + 0.5 * (gap == 0)).mean())


@pytest.mark.parametrize("shift", [1e6, 1e8, 1.7e9])
def test_shifts_change_no_slope_share_or_class(spark, shift):
    """Columns far from zero: fits, axes and classes are those of the same columns near zero."""
    from lumora.operators import linear as L

    rng = np.random.default_rng(5)
    x, z = rng.normal(size=400), rng.normal(size=400)
    rows = [(int(i), float(a), float(b), float(3 * a - 2 * b + e), "u" if a + b > 0 else "v", float(a + shift)) for i, (a, b, e) in enumerate(zip(x, z, rng.normal(0, 0.1, 400)))]
    df = spark.createDataFrame(rows, "i long, x double, z double, y double, label string, far double")
    near, _ = L.fit_linear(df, ["x", "z"], "y")
    far, _ = L.fit_linear(df, ["far", "z"], "y")
    assert np.allclose(near, far, atol=1e-5)
    assert np.allclose(L.pca_fit(df, ["x", "z", "y"])[3], L.pca_fit(df, ["far", "z", "y"])[3], atol=1e-5)
    for kind in ("lda", "qda", "naive"):
        right = [L.gaussian_predict(df, cols, L.gaussian_fit(df, cols, "label", kind)).where("prediction = label").count() for cols in (["x", "z"], ["far", "z"])]
        assert abs(right[0] - right[1]) <= 2


def test_rows_of_the_null_stratum_stay(spark):
    from lumora.operators.models import stratified_folds
    from lumora.operators.relational import split_random

    df = spark.range(100).selectExpr("id", "CASE WHEN id % 5 > 0 THEN cast(id % 3 AS string) END AS g")
    assert split_random(df, ["id"], stratify="g").count() == 100
    assert stratified_folds(df, "g", ["id"], 4).count() == 100


def test_knn_meets_few_cells_and_counts_copies(spark):
    """Far fewer pairs than test × train are compared; a third of the training rows are copies of one point."""
    from lumora.operators import neighbours as NB

    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3)) + rng.integers(0, 6, size=(3000, 1)) * 5
    x[:1000] = x[0]
    y = rng.integers(0, 3, 3000)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "i int, a double, b double, c double, y int")
    cols = ["a", "b", "c"]
    train, test = df.where("i % 5 > 0"), df.where("i % 5 = 0")
    got = {r["i"]: r["prediction"] for r in NB.knn_classify(train, test, cols, "y", "i", block_rows=100).collect()}
    inside = np.array([i for i in range(3000) if i % 5])
    for i in range(0, 3000, 5):
        d = np.sqrt(((x[inside] - x[i]) ** 2).sum(axis=1))
        near = y[inside][np.lexsort((y[inside], d))[:5]]
        counts = np.bincount(near, minlength=3)
        assert got[str(i)] == str(int(counts.argmax()))
    found = NB.cells(train, cols, "y", 5)
    assert NB.comparisons(NB.visits(test, cols, "i", found, 5), found) < 600 * 2400 / 8
    assert NB.nearest(train.where("false"), test, cols, "y", "i").count() == 0


def test_knn_moves_a_row_once_to_many_cells(spark):
    """In many columns nearly all cells are visited; rows go to regions of cells, and lists of cells stay short in memory."""
    from lumora.operators import neighbours as NB

    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(1500, 16)), rng.integers(0, 3, 1500)
    cols = [f"c{i}" for i in range(16)]
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], ["i", *cols, "y"])
    train, test = df.where("i % 5 > 0"), df.where("i % 5 = 0")
    found = NB.cells(train, cols, "y", 5)
    region = NB._regions(found, 300)
    assert np.bincount(region, weights=found.sizes).max() <= 300
    moved = NB._asked(test, cols, "i", found, 5, region).selectExpr("sum(size(regions))", "sum(size(flatten(cells)))").first()
    assert moved[1] == NB.visits(test, cols, "i", found, 5).count() and moved[0] < moved[1] / 4
    inside = np.array([i for i in range(1500) if i % 5])
    got = {r["i"]: r["prediction"] for r in NB.knn_classify(train, test, cols, "y", "i", block_rows=300).collect()}
    for i in range(0, 1500, 5):
        near = y[inside][np.lexsort((y[inside], np.sqrt(((x[inside] - x[i]) ** 2).sum(axis=1))))[:5]]
        assert got[str(i)] == str(int(np.bincount(near, minlength=3).argmax()))


def test_dbscan_in_five_columns(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.15, size=(60, 5)) for c in (0, 2, 4)] + [rng.uniform(-3, 7, size=(20, 5))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double, d double, e double")
    core, label = brute_dbscan(x, 0.6, 5)
    got = {r["i"]: r["cluster"] for r in M.dbscan(df, list("abcde"), ["i"], 0.6, 5, scaled=False).collect()}
    noise = {i for i in range(len(x)) if label[i] == -1}
    assert {i for i, c in got.items() if c == -1} == noise and len(set(got.values()) - {-1}) == len(set(label) - {-1})


def test_components_of_long_chains_and_stars(spark):
    from lumora.operators.clusters import components

    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 4999)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    nodes = spark.createDataFrame([(v,) for v in {v for e in edges for v in e} | {9999}], "node long")
    got = {r["node"]: r["label"] for r in components(df, nodes).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + k] == 1000 for k in range(300)) and got[5000] == 4999 and got[9999] == 9999


def test_samples_of_trees_are_the_least_hashes(spark):
    from lumora.operators import clusters as C

    df = spark.createDataFrame([(i, float(i)) for i in range(5000)], "i long, v double")
    few, many = (sorted((r["tree"], r["mark"], tuple(r["x"])) for r in C.tree_samples(df.repartition(n), ["v"], ["i"], 4, 64, 1).collect()) for n in (1, 9))
    assert few == many and all(sum(t == k for t, _, _ in few) == 64 for k in range(4))
    assert len({tuple(x for k, _, x in few if k == t) for t in range(4)}) == 4
    tiny = C.isolation_scores(df.where("i < 3"), ["v"], ["i"], trees=5)
    assert tiny.count() == 3 and C.isolation_scores(df.where("false"), ["v"], ["i"]).count() == 0


def test_kmeans_starts_do_not_depend_on_layout(spark):
    from lumora.operators import clusters as C

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.3, size=(200, 2)) for c in ([0, 0], [5, 0], [0, 5], [5, 5])])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double")
    one, two = ([tuple(r)[:2] for r in C.kmeans_summary(df.repartition(n), ["a", "b"], 4).collect()] for n in (1, 6))
    assert one == two == [(k, 200) for k in range(4)]
    labels = {r["i"]: r["cluster"] for r in C.kmeans(df, ["a", "b"], 4).collect()}
    assert all(len({labels[i] for i in range(200 * g, 200 * g + 200)}) == 1 for g in range(4))

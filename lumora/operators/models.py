"""Encoding, clustering, fitted models, metrics and comparisons."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from lumora.operators import linear as L
from lumora.operators.bivariate import corr_matrix
from lumora.operators.clusters import dbscan, isolation_forest, isolation_scores, kmeans, kmeans_summary  # noqa: F401
from lumora.operators.forests import forest_importances
from lumora.operators.neighbours import knn_classify  # noqa: F401  (one of the classifiers)
from lumora.operators.quality import quality_level
from lumora.operators.relational import key_mark, numeric_names, sample_n, split_random, text_names
from lumora.operators.schema import label_encode, scale
from lumora.operators.univariate import qq_points
from lumora.plans.gram import unpack, vector_products
from lumora.plans.order import ordered_index, rank_ranges, running_sums
from lumora.plans.quantiles import quantile_values
from lumora.plans.sizing import broadcast_if_small, cut_lineage, join_on, written


def encode_mixed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text columns label-encoded, complete rows, standardised (at least three rows)."""
    texts = [c for c in cols if c in text_names(df)]
    coded = label_encode(df, texts) if texts else df
    return scale(coded.dropna(subset=list(cols)), list(cols), "zscore")


def _assembled(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return df.dropna(subset=list(cols)).withColumn(out, array_to_vector(L._vector(cols)))


# ---------------------------------------------------------------- clusters

def cluster_stats(labelled: DataFrame, cols: Sequence[str], label: str = "cluster") -> DataFrame:
    """Count, mean and std per cluster and column, 3 decimals."""
    aggs = [a for c in cols for a in (F.round(F.avg(c), 3).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 3).alias(f"{c}_std"))]
    return labelled.groupBy(label).agg(F.count(F.lit(1)).alias("count"), *aggs)


def hierarchical_clusters(df: DataFrame, cols: Sequence[str], k: int = 3, seed: int = 42, out: str = "cluster") -> DataFrame:
    """Divisive hierarchy by bisecting k-means (a linkage tree needs all pairs)."""
    x = _assembled(df, cols)
    return BisectingKMeans(k=k, seed=seed, predictionCol=out).fit(x).transform(x).drop("features")


def spectral_clusters(df: DataFrame, cols: Sequence[str], k: int = 3, landmarks: int = 64, seed: int = 42, out: str = "cluster") -> DataFrame:
    """Graph clustering through landmarks: affinities to a few centres, their leading singular directions, k-means.

    The row-to-row affinity matrix is Z·Z' for the normalised landmark affinities Z, so its eigenvectors
    come from the small matrix Z'Z, summed in one pass.
    """
    scaled = scale(df.dropna(subset=list(cols)), list(cols), "zscore")
    x = _assembled(scaled, cols)
    centres = np.stack(KMeans(k=landmarks, seed=seed, maxIter=5).fit(x).clusterCenters())
    gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    width = float(np.median(gaps[gaps > 0])) if (gaps > 0).any() else 1.0
    m = len(centres)

    @F.pandas_udf("array<double>")
    def affinity(v: pd.Series) -> pd.Series:
        a = np.stack(v.to_numpy()).astype(float)
        d2 = ((a[:, None, :] - centres[None]) ** 2).sum(axis=2)
        z = np.exp(-(d2 - d2.min(axis=1, keepdims=True)) / (2 * (width / 2) ** 2))
        return pd.Series(list(z / z.sum(axis=1, keepdims=True)))

    z = scaled.withColumn("_z", affinity(L._vector(cols)))
    row = vector_products(z, "_z", m).first()
    gram = unpack(row["gram"], m)
    weight = np.sqrt(np.clip(gram[0, 1:], 1e-12, None))  # column sums
    values, vectors = np.linalg.eigh(gram[1:, 1:] / np.outer(weight, weight))
    lead = vectors[:, np.argsort(values)[::-1][1: k + 1]] if m > k else vectors[:, ::-1][:, :k]
    project = lead / weight[:, None]

    @F.pandas_udf("array<double>")
    def embed(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()).astype(float) @ project))

    placed = z.withColumn("features", array_to_vector(embed("_z")))
    model = KMeans(k=k, seed=seed, predictionCol=out).fit(placed)
    return model.transform(placed).drop("_z", "features")


# ---------------------------------------------------------------- fitted models

REGRESSORS = ["linear", "ridge", "lasso", "elastic_net", "random_forest", "gradient_boosting"]
CLASSIFIERS = ["logistic", "random_forest", "gradient_boosting", "linear_svm", "naive_bayes", "lda", "qda"]


#: Depth of the trees of a forest: each further level doubles the statistics of a tree; Spark grows up to 30.
DEPTH = 10


def fit_predict_regression(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, model: str, trees: int = 100, seed: int = 42, depth: int = DEPTH) -> DataFrame:
    """`test` with a `prediction`, from a model fitted on `train`."""
    if model in L.PENALTIES:
        w, c = L.fit_linear(train, features, target, model)
        return L.predict_linear(test.dropna(subset=list(features)), features, w, c)
    made = {
        "random_forest": lambda: RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=depth, seed=seed),
        "gradient_boosting": lambda: GBTRegressor(labelCol=target, maxIter=trees, maxDepth=3, stepSize=0.1, seed=seed),
    }[model]()
    fitted = made.fit(_assembled(train.dropna(subset=[target]), features))
    return fitted.transform(_assembled(test, features)).drop("features")


def _each_against_rest(classifier, labels: int):
    """Two labels need one model, more need one each."""
    return classifier if labels == 2 else OneVsRest(classifier=classifier, labelCol="_y")


def fit_predict_classes(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, model: str, trees: int = 100, seed: int = 42, depth: int = DEPTH) -> DataFrame:
    """`test` with a text `prediction`."""
    if model in ("lda", "qda", "naive_bayes"):
        return L.gaussian_predict(test, features, L.gaussian_fit(train, features, label, model))
    n = train.count()
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip").fit(train)
    base = {
        "logistic": lambda: LogisticRegression(labelCol="_y", regParam=1.0 / max(n, 1), maxIter=100),
        "random_forest": lambda: RandomForestClassifier(labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed),
        "gradient_boosting": lambda: _each_against_rest(GBTClassifier(labelCol="_y", maxIter=trees, maxDepth=3, seed=seed), len(indexer.labels)),
        "linear_svm": lambda: _each_against_rest(LinearSVC(labelCol="_y", maxIter=50), len(indexer.labels)),
    }[model]()
    fitted = base.fit(_assembled(indexer.transform(train), features))
    scored = fitted.transform(_assembled(test, features)).withColumnRenamed("prediction", "_p")
    named = IndexToString(inputCol="_p", outputCol="prediction", labels=indexer.labels).transform(scored)
    return named.select(*test.columns, "prediction")


# ---------------------------------------------------------------- metrics

def regression_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """R², RMSE, MAE, MSE, MAPE (zeros of y ignored) in one aggregate."""
    a, b = F.col(y).cast("double"), F.col(p).cast("double")
    e = a - b
    row = df.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(a).alias("_v"),
        F.avg(F.when(a != 0, F.abs(e / a))).alias("_m"))
    return row.select(*keys, "n", (1 - F.try_divide(F.col("mse"), F.col("_v"))).alias("r2"), F.sqrt("mse").alias("rmse"), "mae", "mse", (F.col("_m") * 100).alias("mape"))


def confusion_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """(actual, predicted, count) over all label pairs, absent ones 0."""
    cells = df.groupBy(F.col(y).cast("string").alias("actual"), F.col(p).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("count"))
    labels = cells.select(F.col("actual").alias("l")).unionByName(cells.select(F.col("predicted").alias("l"))).where("l is not null").distinct()
    labels = cut_lineage(labels)
    listed = labels.agg(F.collect_list("l").alias("_all"), F.lit(1).alias("_j"))  # one row
    every = labels.withColumn("_j", F.lit(1)).join(listed, "_j").select(F.col("l").alias("actual"), F.explode("_all").alias("predicted"))
    return every.join(cells, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("count", F.lit(0)).alias("count"))


def classification_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """Accuracy and weighted precision, recall, F1 (0 on division by zero) from confusion counts."""
    cells = df.groupBy(F.col(y).cast("string").alias("a"), F.col(p).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("c"))
    hit = F.col("c") * (F.col("a") == F.col("p")).cast("long")
    per_actual = cells.groupBy(F.col("a").alias("l")).agg(F.sum("c").alias("support"), F.sum(hit).alias("tp"))
    per_predicted = cells.groupBy(F.col("p").alias("l")).agg(F.sum("c").alias("made"))
    each = per_actual.join(broadcast_if_small(per_predicted), "l", "left")
    precision = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("made")), F.lit(0.0))
    recall = F.try_divide(F.col("tp").cast("double"), F.col("support"))
    each = each.select("support", "tp", precision.alias("pr"), recall.alias("rc"))
    f1 = F.coalesce(F.try_divide(2 * F.col("pr") * F.col("rc"), F.col("pr") + F.col("rc")), F.lit(0.0))
    w, n = F.col("support"), F.sum("support")
    return each.agg(
        n.alias("n"), (F.sum("tp") / n).alias("accuracy"), (F.sum(w * F.col("pr")) / n).alias("precision"),
        (F.sum(w * F.col("rc")) / n).alias("recall"), (F.sum(w * f1) / n).alias("f1"))


def roc_points(df: DataFrame, y: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr): counts per score, then running sums from the highest score down."""
    per = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))
    all_pos, all_neg = per.agg(F.sum("pos"), F.sum("neg")).first()
    cum = running_sums(per.withColumn("_down", -F.col("threshold")), {"tp": F.col("pos"), "fp": F.col("neg")}, ["_down"])
    return cum.select("threshold", "pos", "neg", (F.col("fp") / F.lit(float(all_neg or 1))).alias("fpr"), (F.col("tp") / F.lit(float(all_pos or 1))).alias("tpr")).drop("pos", "neg")


def auc(df: DataFrame, y: str, score: str) -> DataFrame:
    """Area under the ROC curve: trapezoids of pairs won plus half the ties, summed without ordering the rows twice."""
    per = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(F.when(F.col(y) == 1, 1.0).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(1.0)).alias("neg"))
    cum = running_sums(per, {"below": F.col("neg")}, ["s"])
    won = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    return cum.agg(F.try_divide(won, F.sum("pos") * F.sum("neg")).alias("auc"))


# ---------------------------------------------------------------- validation and comparison

def contiguous_folds(df: DataFrame, order: Sequence[str], k: int, marked: bool = False) -> DataFrame:
    """Folds of consecutive rows; the first n mod k folds hold one row more.

    With `marked` the first column of `order` is a `key_mark` of pinned rows: they stay where they are.
    """
    if marked:
        return rank_ranges(df, order, lambda n: [j * (n // k) + min(j, n % k) for j in range(1, k)], "fold")
    n = df.count()
    base, extra = divmod(n, k)
    pos = F.col("_pos")
    head = extra * (base + 1)
    fold = F.when(pos < head, F.floor(pos / (base + 1))).otherwise(F.lit(extra) + F.floor((pos - head) / max(base, 1)))
    return ordered_index(df, order).withColumn("fold", fold.cast("int")).drop("_pos")


def stratified_folds(df: DataFrame, label: str, order: Sequence[str], k: int) -> DataFrame:
    """Within each class consecutive rows are dealt to folds in blocks of equal size."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    placed = join_on(ordered_index(df, order, [label]), broadcast_if_small(sizes), [label])
    return placed.withColumn("fold", F.least(F.lit(k - 1), F.floor(F.col("_pos") * k / F.col("_n"))).cast("int")).drop("_pos", "_n")


def cross_validate(df: DataFrame, features: Sequence[str], target: str, model: str, folds: str = "fold", classes: bool = False, trees: int = 100) -> DataFrame:
    """(folds, mean_score, std_score) of R² or accuracy over a fold column."""
    if not classes and model in L.PENALTIES:
        return L.cross_validate_linear(df, features, target, folds, model)
    numbers = [r[0] for r in df.select(folds).distinct().collect()]
    fit = fit_predict_classes if classes else fit_predict_regression
    rows = []
    for i in sorted(numbers):
        out = fit(df.where(F.col(folds) != i), df.where(F.col(folds) == i), features, target, model, trees)
        m = classification_metrics(out, target, "prediction") if classes else regression_metrics(out, target, "prediction")
        rows.append(m.select((F.col("accuracy") if classes else F.col("r2")).alias("s")))
    scores = reduce(DataFrame.unionByName, rows)
    return scores.agg(F.count(F.lit(1)).cast("int").alias("folds"), F.avg("s").alias("mean_score"), F.stddev_pop("s").alias("std_score"))


#: Rows written by column: packed, in groups that several tasks can share.
BY_COLUMN = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
#: Models of `compare_models` besides those of `fit_predict_regression`, given as a table of coefficients.
ROBUST = {"ransac": L.ransac, "theil_sen": L.theil_sen}


def _standardised(train: DataFrame, both: DataFrame, features: Sequence[str]) -> DataFrame:
    """`both` with features centred and scaled as in `train` (population spread; constant columns are only centred)."""
    row = train.agg(*[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(features)]).first()
    scaled = {c: (F.col(f"`{c}`") - F.lit(float(row[f"m{i}"] or 0.0))) / F.lit(float(row[f"s{i}"] or 1.0)) for i, c in enumerate(features)}
    return both.withColumns(scaled)


def _predictions(train: DataFrame, both: DataFrame, features: Sequence[str], target: str, model: str, key: Sequence[str], classes: bool, trees: int) -> DataFrame:
    if model in ROBUST:
        terms = {r["term"]: r["coefficient"] for r in ROBUST[model](train, features, target, list(key)).collect()}
        return L.predict_linear(both, features, np.array([terms[f] for f in features]), terms["(constant)"])
    if model == "knn":
        named = both.withColumn("_id", F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in key]))
        return named.join(knn_classify(train, named, features, target, "_id"), "_id").drop("_id")
    return (fit_predict_classes if classes else fit_predict_regression)(train, both, features, target, model, trees)


def compare_models(
    df: DataFrame, features: Sequence[str], target: str, models: Sequence[str], key: Sequence[str], classes: bool = False, trees: int = 100, test: float = 0.2, cv: int | None = None
) -> DataFrame:
    """One row per model, 4 decimals, best test score first: scores on training and test rows, and over `cv` folds of the former.

    Features are standardised by the training rows. Any of REGRESSORS, CLASSIFIERS, ROBUST and `knn`. Folds are runs of the
    training rows in the random order of the split; without `cv` their columns are null. Where all models are linear their
    rows are written once by column and never moved: such fits don't depend on the layout of rows, and read few columns.
    """
    linear = not classes and all(m in L.PENALTIES or m in ROBUST for m in models)
    used = df.select(*key, *features, target)

    def pin(rows: DataFrame) -> DataFrame:
        return written(rows, "compared", **BY_COLUMN) if linear else cut_lineage(rows)

    # pinned first: a null test over many computed columns is costly to optimise
    data = pin(used.withColumn("_mark", key_mark(key, 42)) if linear else used).dropna()
    split = split_random(data, key, test, stratify=target if classes else None, mark="_mark" if linear else None)
    order, learning = ["_mark", *key], split.where("split = 'train'")
    if linear and cv:  # folds of rows where they are: written with the split
        others = split.where("split = 'test'").withColumn("fold", F.lit(None).cast("int"))
        both = pin(_standardised(learning, contiguous_folds(learning, order, cv, True).unionByName(others), features).drop("_mark"))
        folded, both = both.where("split = 'train'").drop("split"), both.drop("fold")
    else:
        both = pin(_standardised(learning, split, features))
    train = both.where("split = 'train'").drop("split")
    if cv and not linear:
        folded = cut_lineage(contiguous_folds(train.withColumn("_mark", key_mark(key, 42)), order, cv).drop("_mark"))
    names = ["accuracy", "precision", "recall", "f1"] if classes else ["r2", "rmse", "mae"]
    rows = []
    for m in models:
        made = _predictions(train, both, features, target, m, key, classes, trees).select(target, "prediction", "split")
        made = made if linear else cut_lineage(made)
        parts = []
        for part in ("train", "test"):
            own = made.where(F.col("split") == part)
            scores = (classification_metrics if classes else regression_metrics)(own, target, "prediction")
            parts.append(scores.select(F.lit(m).alias("model"), *[F.round(c, 4).alias(f"{part}_{c}") for c in names]))
        row = parts[0].join(parts[1], "model")
        if cv and m not in ROBUST and m != "knn":
            found = cross_validate(folded, features, target, m, classes=classes, trees=trees).select(F.lit(m).alias("model"), F.round("mean_score", 4).alias("cv_mean"), F.round("std_score", 4).alias("cv_std"))
            row = row.join(found, "model")
        elif cv:
            mean, std = _folds_of_predictions(folded, features, target, m, key, classes, trees, cv)
            row = row.withColumns({"cv_mean": F.lit(mean), "cv_std": F.lit(std)})
        else:
            row = row.withColumns({"cv_mean": F.lit(None).cast("double"), "cv_std": F.lit(None).cast("double")})
        rows.append(row)
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc(f"test_{names[0]}"), "model")


def _folds_of_predictions(folded: DataFrame, features: Sequence[str], target: str, model: str, key: Sequence[str], classes: bool, trees: int, cv: int) -> tuple[float, float]:
    scores = []
    for i in range(cv):
        inside, outside = folded.where(F.col("fold") != i).drop("fold"), folded.where(F.col("fold") == i).drop("fold")
        made = _predictions(inside, outside, features, target, model, key, classes, trees)
        row = (classification_metrics if classes else regression_metrics)(made, target, "prediction").first()
        scores.append(row["accuracy" if classes else "r2"])
    return round(float(np.mean(scores)), 4), round(float(np.std(scores)), 4)


def feature_importance(df: DataFrame, features: Sequence[str], target: str, top: int = 5, trees: int = 100, seed: int = 42, depth: int = 5) -> DataFrame:
    """Importances of the `top` features in a forest of shallow trees, whose upper levels decide them."""
    found = forest_importances(df, features, target, trees, depth, seed)
    rows = [(f, float(found[i])) for i, f in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(top)


def binarize_by_percentile(df: DataFrame, col: str, q: float = 0.5, out: str = "target") -> DataFrame:
    """1 above the exact percentile, else 0."""
    (cut,) = quantile_values(df, col, [q])
    return df.withColumn(out, (F.col(col) > F.lit(cut)).cast("int"))


def residual_rows(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.select(F.col(p).alias("fitted"), (F.col(y) - F.col(p)).alias("residual"))


def residual_qq(df: DataFrame, y: str, p: str, max_points: int | None = None) -> DataFrame:
    return qq_points(residual_rows(df, y, p), "residual", max_points)


def ml_summary(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """One row: size, strong pairs, quality, alerts and readiness grade."""
    features = list(features or numeric_names(df))
    k = len(features)
    base = quality_level(df.select(*features)).select(
        (F.col("total_cells") / k).cast("long").alias("n"), "missing_percentage", "quality", F.lit(1).alias("_j"))
    pairs = corr_matrix(df, features, lower_only=True).where("var1 <> var2").agg(
        F.coalesce(F.sum((F.abs("r") > 0.8).cast("long")), F.lit(0)).alias("strong_pairs"), F.lit(1).alias("_j"))
    row = base.join(F.broadcast(pairs), "_j").drop("_j")
    n = F.col("n")
    alerts = F.array_compact(F.array(
        F.when(n < 5 * k, "very_few_rows").when(n < 10 * k, "few_rows"), F.when(F.col("strong_pairs") > 0, "correlated_features"),
        F.when(F.col("missing_percentage") > 15, "high_missing")))
    # Readiness grades and their limits.
    grade = (
        F.when((F.col("quality") == "Excelente") & (n >= 10 * k), "Excelente")
        .when(F.col("quality").isin("Excelente", "Buena") & (n >= 5 * k), "Buena")
        .when(F.col("quality").isin("Excelente", "Buena", "Regular"), "Revisar").otherwise("Requiere atención"))
    return row.select("n", F.lit(k).alias("features"), "strong_pairs", "missing_percentage", "quality", F.array_join(alerts, ",").alias("alerts"), grade.alias("readiness"))


def project_2d(labelled: DataFrame, cols: Sequence[str], label: str, key: Sequence[str], max_points: int | None = None) -> DataFrame:
    """(key…, label, pc1, pc2) of all complete rows, or of a sample of `max_points`, with the variance shares of both axes."""
    mean, spread, vectors, share = L.pca_fit(labelled, cols)
    axes = [
        L.linear_form(cols, vectors[:, j] / spread, -float((mean / spread) @ vectors[:, j])).alias(f"pc{j + 1}") for j in range(2)
    ]
    complete = labelled.dropna(subset=list(cols))
    shown = sample_n(complete, max_points, key) if max_points else complete
    return shown.select(*key, label, *axes, F.lit(float(share[0])).alias("share1"), F.lit(float(share[1])).alias("share2"))


def quick_fit(df: DataFrame, target: str, order: Sequence[str], model: str = "linear", trees: int = 100) -> DataFrame:
    """Target against all other numeric columns, nulls as 0: in-sample R² and min(5, n//2)-fold R²."""
    features = [c for c in numeric_names(df) if c != target and c not in order]
    data = df.select(*order, *features, target).na.fill(0)
    n = data.count()
    k = min(5, n // 2)
    fitted = regression_metrics(fit_predict_regression(data, data, features, target, model, trees), target, "prediction")
    folds = cross_validate(contiguous_folds(data, order, k), features, target, model, trees=trees)
    return fitted.select(F.lit(1).alias("_j"), "n", F.col("r2").alias("r2_train"), "rmse").join(
        F.broadcast(folds.withColumn("_j", F.lit(1))), "_j").drop("_j")


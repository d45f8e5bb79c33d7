"""Models that need only sums of products: one aggregate, a small solve, and predictions as expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lumora.plans.gram import EXPRESSION_SUMS, column_products, unpack, vector_products


def _vector(cols: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in cols])


def design(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> tuple[np.ndarray, list[tuple[tuple, int, np.ndarray]]]:
    """(centre, [(key values, n, X'X with constant)]) over complete rows, of columns less their overall mean.

    Products of values far from zero would lose their last digits. One small matrix per key reaches the driver.
    """
    few = (len(cols) + 1) * (len(cols) + 2) // 2 <= EXPRESSION_SUMS
    if few:
        values = [F.col(f"_x{i}") for i in range(len(cols))]
        used = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
        used = used.where(reduce(lambda a, b: a & b, [v.isNotNull() for v in values]))
    else:
        values = [F.col("_x")[i] for i in range(len(cols))]
        used = df.select(*keys, _vector(cols).alias("_x")).where(~F.exists("_x", lambda v: v.isNull()))
    means = used.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)]).first()
    centre = np.array([m or 0.0 for m in means])
    gaps = [v - F.lit(float(c)) for v, c in zip(values, centre)]
    if few:
        rows = column_products(used.select(*keys, *[g.alias(f"_c{i}") for i, g in enumerate(gaps)]), [f"_c{i}" for i in range(len(cols))], keys).collect()
    else:
        rows = vector_products(used.select(*keys, F.array(*gaps).alias("_x")), "_x", len(cols), keys).collect()
    if not keys and not rows[0]["n"]:
        raise ValueError("no complete rows")
    return centre, [(tuple(r[k] for k in keys), r["n"], unpack(r["gram"], len(cols))) for r in rows]


def moments(n: int, gram: np.ndarray, centre: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and population covariance from X'X with constant of columns less `centre`."""
    mean = gram[0, 1:] / n
    return mean + centre, gram[1:, 1:] / n - np.outer(mean, mean)


def linear_form(cols: Sequence[str], weights: Sequence[float], constant: float) -> Column:
    out = F.lit(float(constant))
    for c, w in zip(cols, weights):
        out = out + F.lit(float(w)) * F.col(f"`{c}`").cast("double")
    return out


# Penalties of the named models.
PENALTIES = {"linear": (0.0, 0.0), "ridge": (1.0, 0.0), "lasso": (0.1, 1.0), "elastic_net": (0.1, 0.5)}


def solve_penalised(n: int, gram: np.ndarray, model: str) -> tuple[np.ndarray, float]:
    """(weights, constant) for the last column on the others.

    Ridge adds its penalty to the centred cross products. Lasso and elastic net minimise
    ‖y − Xw‖²/(2n) + α·l1·‖w‖₁ + α(1 − l1)/2·‖w‖² by coordinate descent on the same small matrix.
    """
    alpha, l1 = PENALTIES[model]
    mean, cov = moments(n, gram)
    a, b = cov[:-1, :-1], cov[:-1, -1]
    if model == "linear":
        w = np.linalg.lstsq(a, b, rcond=1e-12)[0]
    elif model == "ridge":
        w = np.linalg.solve(a * n + alpha * np.eye(len(b)), b * n)
    else:
        w = np.zeros(len(b))
        for _ in range(10_000):
            largest = 0.0
            for j in range(len(b)):
                rho = b[j] - a[j] @ w + a[j, j] * w[j]
                new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / (a[j, j] + alpha * (1 - l1) or 1.0)
                largest, w[j] = max(largest, abs(new - w[j])), new
            if largest < 1e-10 * max(1.0, float(np.abs(w).max())):
                break
    return w, float(mean[-1] - mean[:-1] @ w)


def fit_linear(df: DataFrame, features: Sequence[str], target: str, model: str = "linear") -> tuple[np.ndarray, float]:
    centre, ((_, n, gram),) = design(df, [*features, target])
    w, c = solve_penalised(n, gram, model)
    return w, c + float(centre[-1] - centre[:-1] @ w)


def coefficients(df: DataFrame, features: Sequence[str], target: str, model: str = "linear") -> DataFrame:
    w, c = fit_linear(df, features, target, model)
    rows = [("(constant)", c), *[(f, float(v)) for f, v in zip(features, w)]]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def predict_linear(df: DataFrame, features: Sequence[str], weights: np.ndarray, constant: float, out: str = "prediction") -> DataFrame:
    return df.withColumn(out, linear_form(features, weights, constant))


def cross_validate_linear(df: DataFrame, features: Sequence[str], target: str, fold: str, model: str = "linear") -> DataFrame:
    """(folds, mean_score, std_score) of R². One pass gives X'X per fold; a training matrix is the total minus a fold."""
    _, per = design(df, [*features, target], [fold])  # scores don't depend on the centre
    total = sum(g for _, _, g in per)
    n_all = sum(n for _, n, _ in per)
    scores = []
    for _, n, g in per:
        w, c = solve_penalised(n_all - n, total - g, model)
        full = np.concatenate([[c], w])
        size = len(features) + 1
        rss = g[size, size] - 2 * full @ g[:size, size] + full @ g[:size, :size] @ full
        tss = g[size, size] - g[0, size] ** 2 / n
        scores.append(1 - rss / tss)
    row = [(len(scores), float(np.mean(scores)), float(np.std(scores)))]
    return df.sparkSession.createDataFrame(row, "folds int, mean_score double, std_score double")


# ---------------------------------------------------------------- components and factors

def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each column turned so that its largest loading (the first of equal ones) is positive."""
    size = np.abs(vectors)
    top = (size >= size.max(axis=0) - 1e-9).argmax(axis=0)
    return vectors * np.where(vectors[top, range(vectors.shape[1])] < 0, -1.0, 1.0)


def pca_fit(df: DataFrame, cols: Sequence[str], scaled: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, loadings by column, explained share) from one aggregate."""
    centre, ((_, n, gram),) = design(df, cols)
    mean, cov = moments(n, gram, centre)
    scale = np.sqrt(np.clip(np.diag(cov), 0, None)) if scaled else np.ones(len(cols))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(values)[::-1]
    values = np.clip(values[order], 0, None)
    return mean, scale, _signed(vectors[:, order]), values / values.sum()


def pca(df: DataFrame, cols: Sequence[str], k: int = 5, scaled: bool = True) -> DataFrame:
    """Complete rows with scores pc1…pck, as plain linear expressions."""
    mean, scale, vectors, _ = pca_fit(df, cols, scaled)
    out = df.dropna(subset=list(cols))
    k = min(k, len(cols))
    return out.select("*", *[
        linear_form(cols, vectors[:, j] / scale, -float((mean / scale) @ vectors[:, j])).alias(f"pc{j + 1}") for j in range(k)
    ])


def pca_variance(df: DataFrame, cols: Sequence[str], scaled: bool = True) -> DataFrame:
    """(component, explained, cumulative, needed_for_95)."""
    _, _, _, share = pca_fit(df, cols, scaled)
    total = np.cumsum(share)
    needed = int(np.searchsorted(total, 0.95 - 1e-12)) + 1
    rows = [(i + 1, float(share[i]), float(total[i]), needed) for i in range(len(cols))]
    return df.sparkSession.createDataFrame(rows, "component int, explained double, cumulative double, needed_for_95 int")


def factor_fit(df: DataFrame, cols: Sequence[str], k: int, rounds: int = 1000, tol: float = 1e-8):
    """Maximum-likelihood factors by EM on the covariance matrix: (mean, loadings, noise)."""
    centre, ((_, n, gram),) = design(df, cols)
    mean, cov = moments(n, gram, centre)
    noise = np.diag(cov).copy()
    values, vectors = np.linalg.eigh(cov)
    load = vectors[:, ::-1][:, :k] * np.sqrt(np.clip(values[::-1][:k], 1e-12, None))
    last = -np.inf
    for _ in range(rounds):
        precision = np.linalg.inv(load @ load.T + np.diag(noise))
        beta = load.T @ precision
        second = np.eye(k) - beta @ load + beta @ cov @ beta.T
        load = cov @ beta.T @ np.linalg.inv(second)
        noise = np.clip(np.diag(cov - load @ beta @ cov), 1e-12, None)
        model = load @ load.T + np.diag(noise)
        like = -np.linalg.slogdet(model)[1] - np.trace(np.linalg.solve(model, cov))
        if abs(like - last) < tol:
            break
        last = like
    # turn to principal axes so that the answer does not depend on the start
    _, axes = np.linalg.eigh(load.T @ (load / noise[:, None]))
    return mean, _signed(load @ axes[:, ::-1]), noise


def factor_loadings(df: DataFrame, cols: Sequence[str], k: int = 2) -> DataFrame:
    _, load, noise = factor_fit(df, cols, k)
    rows = [(c, [float(v) for v in load[i]], float(noise[i])) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "variable string, loadings array<double>, noise double")


def factor_analysis(df: DataFrame, cols: Sequence[str], k: int = 2) -> DataFrame:
    """Complete rows with factor scores f1…fk (posterior means), as linear expressions."""
    mean, load, noise = factor_fit(df, cols, k)
    beta = load.T @ np.linalg.inv(load @ load.T + np.diag(noise))
    out = df.dropna(subset=list(cols))
    return out.select("*", *[linear_form(cols, beta[j], -float(beta[j] @ mean)).alias(f"f{j + 1}") for j in range(k)])


# ---------------------------------------------------------------- Gaussian classifiers

def gaussian_fit(df: DataFrame, features: Sequence[str], label: str, kind: str) -> list[tuple]:
    """[(class, log prior, mean, inverse covariance, log determinant)]: lda pooled, qda per class, naive diagonal."""
    centre, per = design(df, features, [label])
    n_all = sum(n for _, n, _ in per)
    d = len(features)
    fits = [(key[0], n, *moments(n, g, centre)) for key, n, g in per]
    pooled = sum(n * cov for _, n, _, cov in fits) / n_all
    smooth = 1e-9 * float(np.max(np.diag(pooled)))
    out = []
    for cls, n, mean, cov in sorted(fits, key=lambda f: str(f[0])):
        if kind == "lda":
            used = pooled
        elif kind == "qda":
            used = cov * n / max(n - 1, 1)
        else:
            used = np.diag(np.diag(cov) + smooth)
        used = used + 1e-12 * np.trace(used) / d * np.eye(d)
        out.append((cls, float(np.log(n / n_all)), mean, np.linalg.inv(used), float(np.linalg.slogdet(used)[1])))
    return out


def gaussian_predict(df: DataFrame, features: Sequence[str], fits: list[tuple], out: str = "prediction") -> DataFrame:
    """Most probable class by batch matrix products over the few class parameters."""
    classes = [str(f[0]) for f in fits]

    @F.pandas_udf("string")
    def score(x: pd.Series) -> pd.Series:
        m = np.stack(x.to_numpy()).astype(float)
        scores = []
        for _, prior, mean, inverse, logdet in fits:
            gap = m - mean
            scores.append(prior - 0.5 * logdet - 0.5 * np.einsum("ij,jk,ik->i", gap, inverse, gap))
        return pd.Series([classes[i] for i in np.argmax(np.stack(scores), axis=0)])

    return df.dropna(subset=list(features)).withColumn(out, score(_vector(features)))


# ---------------------------------------------------------------- robust regression

def hashed_rows(df: DataFrame, cols: Sequence[str], rows: int, key: Sequence[str], seed: int) -> np.ndarray:
    """A bounded uniform sample by smallest seeded hash (a top-k), as a matrix in hash order.

    Of many rows only those with hashes in the share that should hold twice as many are ordered, if it holds enough.
    """
    mark = F.xxhash64(*[F.col(c) for c in key], F.lit(seed))
    marked = df.dropna(subset=list(cols)).select(mark.alias("_m"), _vector(cols).alias("x"))
    n, picked = marked.count(), []
    if n > 4 * rows:
        least = marked.where(F.col("_m") <= F.lit((2 * rows << 64) // n - (1 << 63)))
        picked = least.orderBy("_m", "x").limit(rows).collect()
    if len(picked) < rows:
        picked = marked.orderBy("_m", "x").limit(rows).collect()
    return np.array([r["x"] for r in picked], dtype=float).reshape(-1, len(cols))


def _subset_fits(sample: np.ndarray, size: int) -> list[np.ndarray]:
    """Least squares [constant, weights] on consecutive subsets of the sample."""
    fits = []
    for start in range(0, len(sample) - size + 1, size):
        part = sample[start: start + size]
        x = np.column_stack([np.ones(size), part[:, :-1]])
        if np.linalg.matrix_rank(x) == x.shape[1]:
            fits.append(np.linalg.lstsq(x, part[:, -1], rcond=None)[0])
    return fits


#: Rows that a trial line is laid through at once: few enough for a core's own cache.
TRIAL_ROWS = 16_384


def _inliers(rows: DataFrame, fits: np.ndarray, limit: float) -> list[int]:
    """For each line [constant, weights], the rows (features…, target, no nulls) within `limit` of it."""
    lines = fits.tolist()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(len(fits), np.int64)
        for batch in batches:
            values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for low in range(0, batch.num_rows, TRIAL_ROWS):
                *x, y = (v[low: low + TRIAL_ROWS] for v in values)
                gap, term = np.empty(len(y)), np.empty(len(y))
                for i, (constant, *weights) in enumerate(lines):
                    gap.fill(constant)  # then in the order of `linear_form`, so that sums are the same to the last digit
                    for w, v in zip(weights, x):
                        gap += np.multiply(v, w, out=term)
                    np.abs(np.subtract(y, gap, out=gap), out=gap)
                    hits[i] += np.count_nonzero(gap <= limit)
        yield pa.record_batch({"at": pa.array(np.arange(len(fits), dtype=np.int32)), "n": pa.array(hits)})

    found = rows.mapInArrow(near, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = {r["at"]: r["n"] for r in found}
    return [counts.get(i, 0) for i in range(len(fits))]


def ransac(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], trials: int = 100, seed: int = 42) -> DataFrame:
    """(term, coefficient, inliers): trial lines from tiny hash samples, all scored in one pass, refit on the inliers of the best.

    A row is an inlier within the median absolute deviation of the target, found exactly.
    """
    from lumora.plans.quantiles import quantile_values

    cols = [*features, target]
    fits = _subset_fits(hashed_rows(df, cols, trials * len(cols), key, seed), len(cols))
    if not fits:
        raise ValueError("no trial subset has full rank")
    y = F.col(f"`{target}`").cast("double")
    (median,) = quantile_values(df, target, [0.5])
    (limit,) = quantile_values(df.select(F.abs(y - F.lit(median)).alias("d")), "d", [0.5])
    complete = df.dropna(subset=cols)
    counts = _inliers(complete.select(*[F.col(f"`{c}`").cast("double") for c in cols]), np.array(fits), limit)
    best = max(range(len(fits)), key=lambda i: (counts[i], -i))
    kept = complete.where(F.abs(y - linear_form(features, fits[best][1:], fits[best][0])) <= F.lit(limit))
    w, c = fit_linear(kept, features, target)
    rows = [("(constant)", c, counts[best]), *[(f, float(v), counts[best]) for f, v in zip(features, w)]]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, inliers long")


def theil_sen(df: DataFrame, features: Sequence[str], target: str, key: Sequence[str], subsets: int = 5000, seed: int = 42) -> DataFrame:
    """Spatial median of the fits on `subsets` tiny hash samples (a bounded sample, like the published estimator)."""
    cols = [*features, target]
    fits = np.array(_subset_fits(hashed_rows(df, cols, subsets * len(cols), key, seed), len(cols)))
    if len(fits) == 0:
        raise ValueError("no subset has full rank")
    scale = np.median(np.abs(fits - np.median(fits, axis=0)), axis=0)
    scale[scale == 0] = 1.0
    points = fits / scale
    centre = np.median(points, axis=0)
    for _ in range(300):
        gap = np.maximum(np.linalg.norm(points - centre, axis=1), 1e-12)
        new = (points / gap[:, None]).sum(axis=0) / (1 / gap).sum()
        if np.linalg.norm(new - centre) < 1e-10:
            break
        centre = new
    found = centre * scale
    rows = [("(constant)", float(found[0])), *[(f, float(v)) for f, v in zip(features, found[1:])]]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")

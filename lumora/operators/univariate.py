"""Univariate statistics. Moments of all columns come from one map-side aggregate; quantiles and
category counts from one shuffle of pre-counted values."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumora.functions.moments import adjusted_kurtosis, adjusted_skew
from lumora.functions.numeric import phi, phi_inverse
from lumora.operators.quality import _stack
from lumora.operators.relational import numeric_names
from lumora.plans.order import ordered_index
from lumora.plans.quantiles import column_quantiles, quantile_values, quantiles, to_long
from lumora.plans.sizing import broadcast_if_small, join_on


def _x(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


# ---------------------------------------------------------------- description

def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max and IQR per column."""
    cols = list(cols or numeric_names(df))
    stats = {"count": lambda c: F.count(_x(c)), "mean": lambda c: F.avg(_x(c)), "std": lambda c: F.stddev_samp(_x(c)),
             "min": lambda c: F.min(_x(c)), "max": lambda c: F.max(_x(c))}
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    joined = _stack(df, cols, stats).join(F.broadcast(q), "variable", "left")
    return joined.select("variable", "count", "mean", "std", "min", "q25", "q50", "q75", "max",
                         (F.col("q75") - F.col("q25")).alias("iqr"))


def column_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, value, count) for text columns; counted before the shuffle, nulls left out."""
    text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    long = text.unpivot([], list(cols), "variable", "value").where(F.col("value").isNotNull())
    return long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count"))


EXTENDED_PROBS = [0.01, 0.05, 0.10, 0.25, 0.5, 0.75, 0.90, 0.95, 0.99]


def extended_stats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """describe_numeric plus mode, variance, range, shape, variation, missing share and tail quantiles."""
    cols = list(cols or numeric_names(df))
    stats = {
        "count": lambda c: F.count(_x(c)), "mean": lambda c: F.avg(_x(c)), "std": lambda c: F.stddev_samp(_x(c)),
        "variance": lambda c: F.var_samp(_x(c)), "min": lambda c: F.min(_x(c)), "max": lambda c: F.max(_x(c)),
        "skewness": lambda c: adjusted_skew(_x(c)), "kurtosis": lambda c: adjusted_kurtosis(_x(c)),
    }
    names = ["q1", "q5", "q10", "q25", "median", "q75", "q90", "q95", "q99"]
    q = column_quantiles(df, cols, EXTENDED_PROBS, names)
    counts = to_long(df, cols).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("_c"))
    # most frequent value, the smallest on ties
    modes = counts.groupBy("variable").agg(F.min(F.struct(-F.col("_c"), "value")).alias("_m")).select(
        "variable", F.col("_m.value").alias("mode"))
    joined = _stack(df, cols, stats).join(F.broadcast(q), "variable", "left").join(F.broadcast(modes), "variable", "left")
    missing = F.col("_rows") - F.col("count")
    return joined.select(
        "variable", "count", "mean", "median", "mode", "std", "variance", "min", "max",
        (F.col("max") - F.col("min")).alias("range"), "q25", "q75", (F.col("q75") - F.col("q25")).alias("iqr"),
        "skewness", "kurtosis", F.try_divide(F.col("std") * 100, F.col("mean")).alias("cv"),
        missing.alias("missing"), (missing * 100.0 / F.col("_rows")).alias("missing_pct"),
        "q1", "q5", "q10", "q90", "q95", "q99",
    )


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, unique, top value with count and share of all rows, missing and the ten largest counts."""
    counts = column_counts(df, cols)
    base = _stack(df, cols, {"count": lambda c: F.count(F.col(f"`{c}`"))})
    # a window group limit keeps ten rows per column before the shuffle
    window = Window.partitionBy("variable").orderBy(F.desc("count"), "value")
    top10 = counts.withColumn("_k", F.row_number().over(window)).where("_k <= 10").groupBy("variable").agg(
        F.array_sort(F.collect_list(F.struct("_k", "value", "count"))).alias("_t"))
    unique = counts.groupBy("variable").agg(F.count(F.lit(1)).alias("unique"))
    joined = base.join(F.broadcast(unique), "variable", "left").join(F.broadcast(top10), "variable", "left")
    top = F.try_element_at("_t", F.lit(1))
    return joined.select(
        "variable", "count", F.coalesce("unique", F.lit(0)).alias("unique"), top["value"].alias("top"),
        F.coalesce(top["count"], F.lit(0)).alias("top_count"),
        F.coalesce(top["count"] * 100.0 / F.col("_rows"), F.lit(0.0)).alias("top_pct"),
        (F.col("_rows") - F.col("count")).alias("missing"),
        F.array_join(F.transform("_t", lambda t: F.concat_ws(":", t["value"], t["count"].cast("string"))), "|").alias("top10"),
    )


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """(value, count, pct) for every value, plus a TOTAL row."""
    counts = df.where(F.col(f"`{col}`").isNotNull()).groupBy(F.col(f"`{col}`").cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count"))
    n = total.first()["count"]
    rows = counts.select("value", "count", (F.col("count") * 100.0 / F.lit(n)).alias("pct"))
    return rows.unionByName(total.select(F.lit("TOTAL").alias("value"), "count", F.lit(100.0).alias("pct")))


def category_diversity(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Entropy (bits), Gini impurity, effective categories and largest share, from counts alone.

    With N the total, entropy = log2 N − Σ c·log2 c / N, so one aggregate of the counts is enough.
    """
    c = F.col("count").cast("double")
    sums = column_counts(df, cols).groupBy("variable").agg(
        F.sum(c).alias("n"), F.sum(c * F.log2(c)).alias("clog"), F.sum(c * c).alias("sq"), F.max(c).alias("top"))
    p2 = F.col("sq") / (F.col("n") * F.col("n"))
    return sums.select(
        "variable", (F.log2("n") - F.col("clog") / F.col("n")).alias("entropy"), (1 - p2).alias("gini"),
        (1 / p2).alias("effective_categories"), (F.col("top") / F.col("n")).alias("concentration"))


# ---------------------------------------------------------------- normality

def ks_normal(df: DataFrame, col: str) -> DataFrame:
    """Kolmogorov–Smirnov against Normal(mean, sample std)."""
    from pyspark.ml.stat import KolmogorovSmirnovTest

    x = df.select(_x(col).alias("x")).where(F.col("x").isNotNull())
    m = x.agg(F.avg("x"), F.stddev_samp("x")).first()
    test = KolmogorovSmirnovTest.test(x, "x", "norm", float(m[0]), float(m[1]))
    return test.select(F.lit(col).alias("variable"), F.col("statistic"), F.col("pValue").alias("p_value"))


def jarque_bera(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    stats = {"n": lambda c: F.count(_x(c)), "_s": lambda c: F.skewness(_x(c)), "_k": lambda c: F.kurtosis(_x(c))}
    jb = F.col("n") / 6.0 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4.0)
    return _stack(df, cols, stats).where("n >= 7").select(
        "variable", "n", jb.alias("statistic"), F.exp(-jb / 2).alias("p_value"), (F.exp(-jb / 2) > 0.05).alias("normal"))


def dagostino_k2(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Omnibus test: squared normal scores of skewness and kurtosis; two degrees of freedom."""
    stats = {"n": lambda c: F.count(_x(c)), "g1": lambda c: F.skewness(_x(c)), "g2": lambda c: F.kurtosis(_x(c))}
    n = F.col("n").cast("double")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b - 1)) - 1
    z1 = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (F.col("g2") + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(spread)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    ratio = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.cbrt(ratio)) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return _stack(df, cols, stats).where("n >= 20").select(
        "variable", "n", k2.alias("statistic"), F.exp(-k2 / 2).alias("p_value"), (F.exp(-k2 / 2) > 0.05).alias("normal"))


def anderson_darling(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A² against a fitted normal, with the 5 % point of Stephens. Ranks come from a distributed order."""
    long = to_long(df, cols)
    m = long.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    counts = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("_c"))
    from lumora.plans.order import running_sums

    ranked = running_sums(counts, {"_cum": F.col("_c")}, ["value"], ["variable"]).join(F.broadcast(m), "variable")
    p = F.greatest(F.lit(1e-300), F.least(F.lit(1 - 1e-16), phi((F.col("value") - F.col("m")) / F.col("s"))))
    # equal values hold ranks cum−c+1 … cum: Σ(2i−1) = cum² − (cum−c)²
    low = F.col("_cum") * F.col("_cum") - (F.col("_cum") - F.col("_c")) * (F.col("_cum") - F.col("_c"))
    high = 2 * F.col("n") * F.col("_c") - low
    terms = ranked.select("variable", "n", (low * F.log(p) + high * F.log(1 - p)).alias("t"))
    total = terms.groupBy("variable", "n").agg(F.sum("t").alias("t"))
    n = F.col("n").cast("double")
    a2 = -n - F.col("t") / n
    critical = 0.752 / (1 + 0.75 / n + 2.25 / (n * n))
    return total.select("variable", "n", a2.alias("statistic"), critical.alias("critical_5"), (a2 < critical).alias("normal"))


#: Largest sample of the Shapiro–Wilk test; bigger groups are judged by Jarque–Bera.
SHAPIRO_MAX = 5000


def _shapiro(values: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's published approximation (1995)."""
    from statistics import NormalDist

    x = np.sort(values.astype(float))
    n = len(x)
    nd = NormalDist()
    if x[-1] - x[0] == 0:
        return 1.0, 1.0
    m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssm = float(m @ m)
    a = np.zeros(n)
    u = 1 / math.sqrt(n)
    if n == 3:
        a[-1], a[0] = math.sqrt(0.5), -math.sqrt(0.5)
    else:
        root = math.sqrt(ssm)
        last = m[-1] / root + np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)
        if n > 5:
            second = m[-2] / root + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)
            norm = (ssm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(norm)
            a[-2], a[1] = second, -second
        else:
            norm = (ssm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(norm)
        a[-1], a[0] = last, -last
    centred = x - x.mean()
    w = min(1.0, float(a @ x) ** 2 / float(centred @ centred))
    if n == 3:
        p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
        return w, p
    log_n, gap = math.log(n), math.log(max(1 - w, 1e-300))
    if n <= 11:
        g = -2.273 + 0.459 * n
        if gap >= g:
            return w, 1e-19
        gap = -math.log(g - gap)
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n)
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return w, 0.5 * math.erfc((gap - mu) / sigma / math.sqrt(2))


def shapiro_wilk(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, n, method, statistic, p_value): a row for Shapiro–Wilk and a row for Jarque–Bera.

    The first is defined up to SHAPIRO_MAX values, and null beyond; the second is there at every size.
    """
    return shapiro_long(to_long(df, cols), ["variable"])


def shapiro_long(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    sizes = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.skewness("value").alias("_s"), F.kurtosis("value").alias("_k"))
    small = broadcast_if_small(sizes.where(F.col("_n").between(3, SHAPIRO_MAX)).select(*keys))
    kept = long.join(small, keys, "left_semi")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = _shapiro(pdf["value"].to_numpy())
        head = pdf.iloc[:1][keys].copy()
        return head.assign(n=len(pdf), method="shapiro", statistic=w, p_value=p)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in long.schema if f.name in keys)
    exact = kept.select(*keys, "value").groupBy(*keys).applyInPandas(
        test, f"{fields}, n long, method string, statistic double, p_value double")
    beyond = sizes.where(F.col("_n") > SHAPIRO_MAX).select(*keys, F.col("_n").alias("n"), F.lit("shapiro").alias("method"), F.lit(None).cast("double").alias("statistic"), F.lit(None).cast("double").alias("p_value"))
    jb = F.col("_n") / 6.0 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4.0)
    rest = sizes.where(F.col("_n") > 2).select(
        *keys, F.col("_n").alias("n"), F.lit("jarque_bera").alias("method"), jb.alias("statistic"), F.exp(-jb / 2).alias("p_value"))
    return exact.unionByName(beyond).unionByName(rest)


# ---------------------------------------------------------------- outliers

def iqr_bounds(df: DataFrame, col: str, k: float = 1.5) -> tuple[float, float] | None:
    q1, q3 = quantile_values(df, col, [0.25, 0.75])
    return None if q1 is None else (q1 - k * (q3 - q1), q3 + k * (q3 - q1))


def outliers_iqr(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Rows outside the fences. The fences are constants of the plan, so the filter reaches the scan."""
    bounds = iqr_bounds(df, col, k)
    if bounds is None:
        return df.where(F.lit(False))
    x = F.col(f"`{col}`")
    return df.where((x < F.lit(bounds[0])) | (x > F.lit(bounds[1])))


def outliers_z(df: DataFrame, col: str, threshold: float = 3.0, ddof: int = 1) -> DataFrame:
    spread = F.stddev_samp if ddof else F.stddev_pop
    m = df.agg(F.avg(_x(col)), spread(_x(col))).first()
    if not m[1]:
        return df.where(F.lit(False))
    x = F.col(f"`{col}`").cast("double")
    return df.where(F.abs((x - F.lit(m[0])) / F.lit(m[1])) > threshold)


def outliers_modified_z(df: DataFrame, col: str, threshold: float = 3.5) -> DataFrame:
    """0.6745·|x − median| / MAD; both medians exact."""
    (median,) = quantile_values(df, col, [0.5])
    if median is None:
        return df.where(F.lit(False))
    gap = F.abs(_x(col) - F.lit(median))
    (mad,) = quantile_values(df.select(gap.alias("d")), "d", [0.5])
    if not mad:
        return df.where(F.lit(False))
    return df.where(F.lit(0.6745) * gap / F.lit(mad) > threshold)


def outlier_report(df: DataFrame, cols: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """IQR and z-score outlier counts per column (of the first `limit`, if given), n ≥ 4."""
    cols = list(cols or numeric_names(df))[:limit]
    q = column_quantiles(df, cols, [0.25, 0.75], ["q1", "q3"])
    rows = {r["variable"]: r for r in q.collect()}
    m = df.agg(*[f(_x(c)).alias(f"{t}{i}") for i, c in enumerate(cols) for t, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    fences = {
        c: (rows[c]["q1"] - 1.5 * (rows[c]["q3"] - rows[c]["q1"]), rows[c]["q3"] + 1.5 * (rows[c]["q3"] - rows[c]["q1"]), m[f"m{i}"], m[f"s{i}"])
        for i, c in enumerate(cols) if c in rows
    }

    def outside(c: str) -> Column:
        low, high, _, _ = fences[c]
        return F.sum(((_x(c) < F.lit(low)) | (_x(c) > F.lit(high))).cast("long"))

    def far(c: str) -> Column:
        mean, std = fences[c][2], fences[c][3]
        return F.sum((F.abs((_x(c) - F.lit(mean)) / F.lit(std)) > 3).cast("long")) if std else F.lit(0).cast("long")

    stacked = _stack(df, list(fences), {"total_values": lambda c: F.count(_x(c)), "iqr_outliers": outside, "z_outliers": far})
    return stacked.where("total_values >= 4").select(
        "variable", "total_values", "iqr_outliers", (F.col("iqr_outliers") * 100.0 / F.col("total_values")).alias("iqr_pct"),
        "z_outliers", (F.col("z_outliers") * 100.0 / F.col("total_values")).alias("z_pct"))


# ---------------------------------------------------------------- transformations

def _boxcox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def boxcox_lambda(df: DataFrame, col: str, low: float = -5.0, high: float = 5.0, rounds: int = 5) -> DataFrame:
    """Maximum-likelihood λ: each round scores 21 values of λ in one aggregate, then zooms in."""
    x = df.select(_x(col).alias("x")).where(F.col("x") > 0)
    shift = x.agg(F.avg(F.log("x"))).first()[0]
    if shift is None:
        raise ValueError(f"{col} has no positive value")
    # dividing by the geometric mean moves no optimum and keeps the powers in range
    scaled = F.exp(F.log("x") - F.lit(shift))
    best = 0.0
    for _ in range(rounds):
        grid = [low + (high - low) * i / 20 for i in range(21)]
        row = x.agg(*[F.var_pop(_boxcox(scaled, g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
        scores = [-(math.log(v) if v else math.inf) for v in row]
        at = int(np.argmax(scores))
        best = grid[at]
        step = (high - low) / 20
        low, high = best - step, best + step
    out = x.agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.lit(col).alias("variable"), "n", F.lit(best).alias("lambda"))


def transform_compare(df: DataFrame, col: str, boxcox: bool = True) -> DataFrame:
    """Shape and normality (Jarque–Bera) of log, square root, Box–Cox and original values in one aggregate."""
    x = F.col("x")
    base = df.select(_x(col).alias("x")).where(x.isNotNull())
    positive = F.when(x > 0, x)
    forms = {"log": F.log(positive), "sqrt": F.sqrt(positive), "original": x}
    lam = None
    if boxcox:
        lam = boxcox_lambda(df, col).first()["lambda"]
        forms["boxcox"] = _boxcox(positive, lam)
    wide = base.select(*[e.alias(n) for n, e in forms.items()])
    stats = {"n": lambda c: F.count(_x(c)), "skewness": lambda c: adjusted_skew(_x(c)), "kurtosis": lambda c: adjusted_kurtosis(_x(c)),
             "_s": lambda c: F.skewness(_x(c)), "_k": lambda c: F.kurtosis(_x(c))}
    jb = F.col("n") / 6.0 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4.0)
    return _stack(wide, list(forms), stats).select(
        F.col("variable").alias("transform"), "n", "skewness", "kurtosis", (F.exp(-jb / 2) > 0.05).alias("normal"),
        F.when(F.col("variable") == "boxcox", F.lit(lam)).cast("double").alias("lambda"))


# ---------------------------------------------------------------- chart data

def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins, the last one closed; empty bins kept."""
    x = F.col(f"`{col}`").cast("double")
    low, high = df.agg(F.min(x), F.max(x)).first()
    if low is None:
        raise ValueError(f"{col} has no value")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.lit(bins - 1).cast("long"), F.floor((x - F.lit(low)) / F.lit(width)))
    counts = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return all_bins.join(F.broadcast(counts), "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("bin_start"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("bin_end"), F.coalesce("count", F.lit(0)).alias("count"))


def box_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (extreme points within 1.5 IQR) and outlier count, per group."""
    by = list(by)
    base = df.select(*by, _x(col).alias("_x")).where(F.col("_x").isNotNull())
    q = quantiles(base, "_x", [0.25, 0.5, 0.75], by, ["q1", "median", "q3"])
    if by:
        joined = join_on(base, broadcast_if_small(q), by)
    else:
        r = q.first()
        joined = base.select("*", *[F.lit(r[n]).alias(n) for n in ("q1", "median", "q3")])
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("_x") >= F.col("q1") - 1.5 * iqr) & (F.col("_x") <= F.col("q3") + 1.5 * iqr)
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"), F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("outliers"))


def qq_points(df: DataFrame, col: str, max_points: int | None = None) -> DataFrame:
    """(theoretical, ordered, fit) at Filliben positions; the line is fitted on all rows. With `max_points` about so many, both ends among them."""
    x = df.select(_x(col).alias("ordered")).where(F.col("ordered").isNotNull())
    n = x.count()
    if n < 2:
        raise ValueError(f"{col} needs two values")
    keyed = x.withColumn("_tie", F.monotonically_increasing_id())
    i = F.col("_pos") + 1
    edge = 0.5 ** (1.0 / n)
    p = F.when(F.col("_pos") == 0, 1 - edge).when(F.col("_pos") == n - 1, edge).otherwise((i - 0.3175) / (n + 0.365))
    placed = ordered_index(keyed, ["ordered", "_tie"]).select("_pos", "ordered", phi_inverse(p).alias("theoretical"))
    line = placed.agg(F.regr_slope("ordered", "theoretical"), F.regr_intercept("ordered", "theoretical")).first()
    step = max(1, n // max_points) if max_points else 1
    kept = placed.where((F.col("_pos") % step == 0) | (F.col("_pos") == n - 1))
    return kept.select("theoretical", "ordered", (F.lit(line[0]) * F.col("theoretical") + F.lit(line[1])).alias("fit"))


def kde(df: DataFrame, col: str, by: str | None = None, grid: int = 200, fine: int = 2048) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth.

    Rows are first counted into fine bins, so the kernel sums cost bins × grid per group, whatever the row count.
    """
    base = df.select((F.col(by) if by else F.lit("all")).alias("group"), _x(col).alias("x")).where(F.col("x").isNotNull())
    m = base.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("s"), F.min("x").alias("low"), F.max("x").alias("high")
    ).where("n > 1 and s > 0")
    band = F.col("s") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    m = broadcast_if_small(m.withColumn("h", band))
    width = (F.col("high") - F.col("low")) / fine
    bins = join_on(base, m, ["group"]).groupBy("group", "n", "h", "low", "high", F.least(F.lit(fine - 1), F.floor((F.col("x") - F.col("low")) / width)).alias("bin")).agg(
        F.count(F.lit(1)).alias("c"), F.avg("x").alias("centre"))
    spread = bins.select("group", "n", "h", "c", "centre", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("g"))
    at = F.col("low") - 3 * F.col("h") + F.col("g") * (F.col("high") - F.col("low") + 6 * F.col("h")) / (grid - 1)
    z = (at - F.col("centre")) / F.col("h")
    kernel = F.col("c") * F.exp(-z * z / 2) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    return spread.select("group", "g", at.alias("x"), kernel.alias("k")).groupBy("group", "g").agg(
        F.max("x").alias("x"), F.sum("k").alias("density"))


def violin_data(df: DataFrame, col: str, by: str) -> DataFrame:
    """Density per group with its mean and median."""
    base = df.select(F.col(by).alias("group"), _x(col).alias("_x"))
    marks = base.groupBy("group").agg(F.avg("_x").alias("mean"))
    med = quantiles(base, "_x", [0.5], ["group"], ["median"])
    return join_on(join_on(kde(df, col, by), broadcast_if_small(marks), ["group"]), broadcast_if_small(med), ["group"])


def share_top(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The n largest categories with their share among the shown ones."""
    counts = df.where(F.col(f"`{col}`").isNotNull()).groupBy(F.col(f"`{col}`").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), "value").limit(n)
    share = F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(F.lit(0)))
    return top.select("value", "count", share.alias("share"))


# ---------------------------------------------------------------- rules and rankings

def _shape_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    stats = {"n": lambda c: F.count(_x(c)), "mean": lambda c: F.avg(_x(c)), "std": lambda c: F.stddev_samp(_x(c)),
             "variance": lambda c: F.var_samp(_x(c)),
             "skewness": lambda c: adjusted_skew(_x(c)), "kurtosis": lambda c: adjusted_kurtosis(_x(c))}
    return _stack(df, cols, stats)


def distribution_type(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fixed rule on skewness and excess kurtosis."""
    s, k = F.abs("skewness"), F.col("kurtosis")
    # Labels and limits of the rule.
    kind = (
        F.when((s < 0.5) & (F.abs(k) < 0.5), "Normal").when(s > 1, "Altamente sesgada")
        .when(F.abs(k) > 3, "Leptocúrtica (picos altos)").when(k < -1, "Platicúrtica (picos bajos)")
        .otherwise("Moderadamente sesgada")
    )
    return _shape_rows(df, cols).where("n >= 4").select("variable", "skewness", "kurtosis", kind.alias("distribution"))


def skewness_ranking(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    s = F.abs("skewness")
    window = Window.partitionBy(F.lit(0)).orderBy(s.desc_nulls_last(), "variable")
    return _shape_rows(df, cols).select(
        "variable", "skewness", (s < 0.5).alias("symmetric"), (s > 1).alias("highly_skewed"), F.row_number().over(window).cast("long").alias("rank"))


def extreme_variables(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """(finding, variable, amount): highest variance, highest cardinality, most imbalanced."""
    variance = _shape_rows(df, numeric).agg(F.max_by("variable", "variance").alias("variable"), F.max("variance").alias("amount"))
    per = column_counts(df, text).groupBy("variable").agg(
        F.count(F.lit(1)).alias("unique"), F.max("count").alias("top"), F.sum("count").alias("all"))
    card = per.agg(F.max_by("variable", F.struct("unique", "variable")).alias("variable"), F.max("unique").cast("double").alias("amount"))
    share = F.col("top") / F.col("all")
    uneven = per.where("unique > 1").agg(F.max_by("variable", share).alias("variable"), F.max(share).alias("amount"))
    rows = [("highest_variance", variance), ("highest_cardinality", card), ("most_imbalanced", uneven)]
    out = None
    for name, part in rows:
        tagged = part.select(F.lit(name).alias("finding"), "variable", "amount")
        out = tagged if out is None else out.unionByName(tagged)
    return out

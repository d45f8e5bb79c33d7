"""Stored time series, one or many (`keys`). Every operator starts from contiguous positions.

Positions come from `ordered_index`, so a single long series is spread over many tasks; sliding
statistics look only a bounded number of rows away and run on blocks with copied edges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from lumora.functions.columns import DATE_FORMATS, to_moment
from lumora.functions.numeric import chi2_p, f_sf, t_p
from lumora.operators.quality import _stack, quality_label
from lumora.operators.relational import dedupe_first, moment_names, numeric_names
from lumora.operators.univariate import box_stats, histogram, outlier_report, qq_points, shapiro_wilk
from lumora.plans.gram import solve, unpack, vector_products
from lumora.plans.order import lags, ordered_index, sliding
from lumora.plans.quantiles import quantiles
from lumora.plans.sizing import broadcast_if_small, cut_lineage, is_small, join_on


def prepare_series(df: DataFrame, ts: str, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Parse the time, drop missing times, keep the first row per (key, time) by value order."""
    keys = list(keys)
    if ts in moment_names(df):
        moment = F.col(ts)
    else:
        text = F.col(ts).cast("string")
        moment = F.coalesce(*[to_moment(text, f) for f in DATE_FORMATS], text.try_cast("timestamp"))
    base = df.select(*keys, moment.alias("ts"), *cols).where(F.col("ts").isNotNull())
    return dedupe_first(base, [*keys, "ts"], list(cols))


def positions(df: DataFrame, ts: str = "ts", keys: Sequence[str] = ()) -> tuple[DataFrame, bool]:
    """The series with `_pos`, and whether it is small enough for plain windows. Times must be unique per key."""
    pinned = cut_lineage(df)  # counted, sampled and read: computed once
    small = is_small(pinned)
    return ordered_index(pinned, [ts], keys, small=small), small


def _fields(df: DataFrame, names: Sequence[str]) -> str:
    return "".join(f"`{n}` {df.schema[n].dataType.simpleString()}, " for n in names)


def _attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one row per key; without keys there is one row, whose plain values enter as constants."""
    if keys:
        return join_on(df, broadcast_if_small(per_key), list(keys))
    if any(isinstance(f.dataType, T.ArrayType) for f in per_key.schema):
        one = F.broadcast(per_key.withColumn("_j", F.lit(1)))
        return df.withColumn("_j", F.lit(1)).join(one, "_j").drop("_j")
    row = per_key.first()
    return df.select("*", *[F.lit(row[c]).cast(per_key.schema[c].dataType).alias(c) for c in per_key.columns])


# ---------------------------------------------------------------- overview

def rank_variables(df: DataFrame, by: str = "variance", n: int = 5, cols: Sequence[str] | None = None) -> DataFrame:
    """Top-n numeric columns by variance, range or completeness, with their summary."""
    cols = list(cols or numeric_names(df))
    x = lambda c: F.col(f"`{c}`").cast("double")
    rows = _stack(df, cols, {
        "observations": lambda c: F.count(x(c)), "mean": lambda c: F.avg(x(c)), "std": lambda c: F.stddev_samp(x(c)),
        "min": lambda c: F.min(x(c)), "max": lambda c: F.max(x(c)), "variance": lambda c: F.var_samp(x(c))})
    span = F.col("max") - F.col("min")
    score = {"variance": F.col("variance"), "range": span, "completeness": F.col("observations").cast("double")}[by]
    return rows.orderBy(score.desc_nulls_last(), "variable").limit(n).select(
        "variable", "observations", (F.col("_rows") - F.col("observations")).alias("missing"), "mean", "std", "min", "max", span.alias("range"))


def series_overview(df: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    base = df.where(F.col(value).isNotNull())
    stats = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    med = quantiles(base, value, [0.5], keys, ["median"])
    return _attach(stats, med, keys).withColumn("cv", F.try_divide(F.col("std"), F.col("mean")))


# Default moving-average widths by purpose.
def default_width(n: int, purpose: str = "series") -> int:
    return {"series": min(30, n // 10), "univariate": min(5, n // 10), "decompose": min(5, n // 2)}[purpose]


def _mean_window(value: str, before: int, after: int):
    def make(w):
        frame = w.rowsBetween(-before, after)
        full = F.count(F.lit(1)).over(frame) == before + after + 1
        present = F.count(value).over(frame) == before + after + 1
        return {"moving_average": F.when(full & present, F.avg(value).over(frame))}

    return make


def moving_average(df: DataFrame, ts: str, value: str, width: int, keys: Sequence[str] = (), center: bool = True) -> DataFrame:
    """Mean of full windows; an even centred window covers rows −w/2 … w/2−1."""
    placed, small = positions(df, ts, keys)
    ahead = (width - 1) // 2 if center else 0
    back = width - 1 - ahead
    return sliding(placed, "_pos", back, ahead, _mean_window(value, back, ahead), keys, small).drop("_pos")


def seasonal_groups(df: DataFrame, ts: str, value: str, period: str) -> DataFrame:
    """Box statistics per calendar period: year, month, quarter or weekday (Monday = 0)."""
    unit = {"year": F.year, "month": F.month, "quarter": F.quarter, "weekday": F.weekday}[period](F.col(ts))
    return box_stats(df.select(unit.alias("period"), value), value, ["period"])


def ma_decompose(df: DataFrame, ts: str, value: str, width: int, keys: Sequence[str] = ()) -> DataFrame:
    averaged = moving_average(df, ts, value, width, keys).withColumnRenamed("moving_average", "trend")
    return averaged.withColumn("residual", F.col(value) - F.col("trend"))


def classical_decompose(
    df: DataFrame, ts: str, value: str, period: int, keys: Sequence[str] = (), model: str = "additive"
) -> DataFrame:
    """Centred moving-average trend, normalised mean per phase, residual."""
    keys = list(keys)
    placed, small = positions(df, ts, keys)
    half = period // 2

    def trend(w):
        if period % 2:
            frame = w.rowsBetween(-half, half)
            full = F.count(value).over(frame) == period
            return {"trend": F.when(full, F.avg(value).over(frame))}
        left, right = w.rowsBetween(-half, half - 1), w.rowsBetween(-half + 1, half)
        full = (F.count(value).over(left) == period) & (F.count(value).over(right) == period)
        return {"trend": F.when(full, (F.avg(value).over(left) + F.avg(value).over(right)) / 2)}

    smooth = sliding(placed, "_pos", half, half, trend, keys, small).withColumn("_phase", F.pmod(F.col("_pos"), F.lit(period)))
    additive = model == "additive"
    detrended = F.col(value) - F.col("trend") if additive else F.try_divide(F.col(value), F.col("trend"))
    phases = smooth.groupBy(*keys, "_phase").agg(F.avg(detrended).alias("_m"))
    centre = F.avg("_m").over(Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))  # ≤ period rows per key
    phases = phases.select(*keys, "_phase", (F.col("_m") - centre if additive else F.col("_m") / centre).alias("seasonal"))
    joined = join_on(smooth, broadcast_if_small(phases), [*keys, "_phase"])
    parts = F.col("trend") + F.col("seasonal") if additive else F.col("trend") * F.col("seasonal")
    residual = F.col(value) - parts if additive else F.try_divide(F.col(value), parts)
    return joined.select(*df.columns, "trend", "seasonal", residual.alias("residual"))


def decomposition_metrics(parts: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Spread of the components and explained variance 1 − var(residual)/var(value)."""
    return parts.groupBy(*keys).agg(
        F.stddev_samp("trend").alias("trend_std"), F.stddev_samp("seasonal").alias("seasonal_std"), F.stddev_samp("residual").alias("residual_std"),
        (1 - F.try_divide(F.var_samp("residual"), F.var_samp(value))).alias("explained_variance"))


def residual_diagnostics(parts: DataFrame, residual: str = "residual") -> DataFrame:
    """n, mean and std, with a row for each normality test and its verdict; Shapiro–Wilk has none beyond 5000 values."""
    stats = parts.agg(F.count(residual).alias("n"), F.avg(residual).alias("mean"), F.stddev_samp(residual).alias("std"))
    test = shapiro_wilk(parts, [residual]).select("n", "method", "statistic", "p_value", (F.col("p_value") > 0.05).alias("normal"))
    return stats.join(F.broadcast(test), "n", "left")


def residual_histogram(parts: DataFrame, residual: str = "residual", bins: int = 30) -> DataFrame:
    return histogram(parts, residual, bins)


def residual_qq(parts: DataFrame, residual: str = "residual", max_points: int | None = None) -> DataFrame:
    return qq_points(parts, residual, max_points)


# ---------------------------------------------------------------- autocorrelation

def acf(df: DataFrame, ts: str, value: str, nlags: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, lag, acf, n): one window with `nlags` lag columns and one aggregate."""
    keys = list(keys)
    base = df.select(*keys, ts, F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    m = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_m"))
    placed, small = positions(base, ts, keys)
    centred = _attach(placed, m, keys).withColumn("_x", F.col("_x") - F.col("_m"))
    lagged = lags(centred, "_pos", {f"_l{k}": ("_x", k) for k in range(1, nlags + 1)}, keys, small)
    sums = lagged.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.sum(F.col("_x") * F.col("_x")).alias("_0"),
        *[F.sum(F.col("_x") * F.col(f"_l{k}")).alias(f"_{k}") for k in range(1, nlags + 1)])
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"_{k}"), F.col("_0")).alias("acf")) for k in range(nlags + 1)])
    rows = sums.select(*keys, "n", F.explode(pairs).alias("_p")).select(*keys, "_p.lag", "_p.acf", "n")
    return rows.where(F.col("lag") < F.col("n"))


def default_nlags(n: int) -> int:
    return min(40, n // 4)


def pacf(df: DataFrame, ts: str, value: str, nlags: int, keys: Sequence[str] = ()) -> DataFrame:
    """Partial autocorrelations by Durbin–Levinson over the few autocorrelations of each key."""
    keys = list(keys)
    rows = acf(df, ts, value, nlags, keys)
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "acf"))).alias("r"))

    def levinson(r: np.ndarray) -> list[float]:
        out, phi = [1.0], np.zeros(0)
        for k in range(1, len(r)):
            below = 1 - phi @ r[1:k]
            last = (r[k] - phi @ r[1:k][::-1]) / below if abs(below) > 1e-14 else 0.0
            phi = np.append(phi - last * phi[::-1], last)
            out.append(float(last))
        return out

    @F.pandas_udf("array<double>")
    def solve_all(r: pd.Series) -> pd.Series:
        return pd.Series([levinson(np.array([p["acf"] for p in row], dtype=float)) for row in r])

    return packed.select(*keys, F.posexplode(solve_all(F.col("r"))).alias("lag", "pacf"))


def ljung_box(df: DataFrame, ts: str, value: str, nlags: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Q and p for each lag (the running sum is over at most `nlags` rows per key)."""
    keys = list(keys)
    rows = acf(df, ts, value, nlags, keys).where("lag > 0")
    n = F.col("n").cast("double")
    window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    q = n * (n + 2) * F.sum(F.col("acf") * F.col("acf") / (n - F.col("lag"))).over(window)
    scored = rows.select(*keys, "lag", q.alias("q"))
    p = chi2_p(F.col("q"), F.col("lag").cast("double"))
    return scored.select(*keys, "lag", "q", p.alias("p_value"), (p > 0.05).alias("independent"))


# MacKinnon's published response surfaces, constant, one variable.
ADF_SMALL_P = [0.038269, 1.4412, 2.1659]
ADF_LARGE_P = [-0.010368, -0.12745, 0.93202, 1.7339]
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_CRITICAL = {1: [-79.433, -16.786, -6.5393, -3.43035], 5: [-40.04, -4.234, -2.8903, -2.86154], 10: [0.0, -2.809, -1.5384, -2.56677]}


def adf_p(stat: float) -> float:
    if stat > ADF_MAX:
        return 1.0
    if stat < ADF_MIN:
        return 0.0
    z = np.polyval(ADF_SMALL_P if stat <= ADF_STAR else ADF_LARGE_P, stat)
    return 0.5 * math.erfc(-z / math.sqrt(2))


def adf_test(df: DataFrame, ts: str, value: str, keys: Sequence[str] = (), longest: int | None = None) -> DataFrame:
    """Augmented Dickey–Fuller with a constant and AIC lag choice; the most lags follow from the length of a series alone, unless the caller gives a limit.

    One aggregate gives the cross products for all lag orders of all keys; a second one, restricted to each
    key's chosen lag, gives the final fit. Only these small matrices are solved outside SQL.
    """
    keys = list(keys)
    base = df.select(*keys, ts, F.col(value).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    level = base.groupBy(*keys).agg(F.avg("_y").alias("_level"))  # the constant takes up any shift; products of far values lose digits
    base = _attach(base, level, keys).withColumn("_y", F.col("_y") - F.col("_level")).drop("_level")
    placed, small = positions(base, ts, keys)
    step = sliding(placed, "_pos", 1, 0, lambda w: {"_prev": F.lag("_y", 1).over(w)}, keys, small).withColumn("_d", F.col("_y") - F.col("_prev"))
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rule = F.least(F.ceil(12 * F.pow(F.col("_n") / 100.0, F.lit(0.25))), F.floor(F.col("_n") / 2) - 3, *([F.lit(longest)] if longest is not None else [])).cast("int")
    sizes = cut_lineage(sizes.withColumn("_max", F.greatest(F.lit(0), rule)).where("_n >= 8"))
    longest = sizes.agg(F.coalesce(F.max("_max"), F.lit(0))).first()[0]  # grows with the fourth root of the longest series

    def history(w):
        back = [F.coalesce(F.lag("_d", k).over(w), F.lit(0.0)) for k in range(1, longest + 1)]
        return {"_x": F.array(F.coalesce("_prev", F.lit(0.0)), *back, F.coalesce("_d", F.lit(0.0)))}

    lagged = sliding(step, "_pos", longest, 0, history, keys, small).select(*keys, "_pos", "_x")
    width = longest + 2

    def fit(limits: DataFrame, pick: bool) -> DataFrame:
        used = _attach(lagged, limits, keys).where(F.col("_pos") > F.col("_max"))
        gram = vector_products(used, "_x", width, [*keys, "_max"])

        @F.pandas_udf("lag int, statistic double, nobs int")
        def run(n: pd.Series, most: pd.Series, packed: pd.Series) -> pd.DataFrame:
            out = []
            for rows, top, g in zip(n, most, packed):
                a = unpack(g, width)
                best = None
                for lag in range(top + 1) if pick else [top]:
                    x = [0, 1, *range(2, 2 + lag)]
                    beta, rss = solve(a, x, width)
                    aic = rows * math.log(max(rss, 1e-300) / rows) + 2 * len(x)
                    if best is None or aic < best[0]:
                        inv = np.linalg.pinv(a[np.ix_(x, x)])
                        se = math.sqrt(max(rss / max(rows - len(x), 1) * inv[1, 1], 1e-300))
                        best = (aic, lag, float(beta[1] / se))
                out.append((best[1], best[2], int(rows)))
            return pd.DataFrame(out, columns=["lag", "statistic", "nobs"])

        return gram.select(*keys, run("n", "_max", "gram").alias("_f")).select(*keys, "_f.*")

    chosen = fit(sizes.select(*keys, "_max"), True).select(*keys, F.col("lag").alias("_max"))
    final = fit(chosen, False)

    @F.pandas_udf("double")
    def p_of(s: pd.Series) -> pd.Series:
        return pd.Series([adf_p(float(v)) for v in s])

    inv_n = 1.0 / F.col("nobs")

    def critical(level: int) -> Column:
        a, b, c, d = ADF_CRITICAL[level]
        return F.lit(d) + (F.lit(c) + (F.lit(b) + F.lit(a) * inv_n) * inv_n) * inv_n

    return final.withColumn("p_value", p_of("statistic")).select(
        *keys, "statistic", "p_value", "lag", "nobs", critical(1).alias("critical_1"), critical(5).alias("critical_5"), critical(10).alias("critical_10"),
        (F.col("p_value") <= 0.05).alias("stationary"))


# ---------------------------------------------------------------- trend and causality

def trend(df: DataFrame, ts: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Regression on row position: slope, intercept, R², p and direction."""
    keys = list(keys)
    base = df.select(*keys, ts, F.col(value).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    placed, _ = positions(base, ts, keys)
    s = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("_y", "_pos").alias("slope"), F.regr_intercept("_y", "_pos").alias("intercept"),
        F.corr("_pos", "_y").alias("_r"))
    r2 = F.col("_r") * F.col("_r")
    t = F.col("_r") * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-300), 1 - r2))
    direction = F.when(F.col("slope") > 0, "creciente").when(F.col("slope") < 0, "decreciente").otherwise("estable")
    return s.select(*keys, "n", "slope", "intercept", r2.alias("r_squared"), t_p(t, (F.col("n") - 2).cast("double")).alias("p_value"), direction.alias("direction"))


def granger(df: DataFrame, ts: str, cols: Sequence[str], maxlag: int = 4, min_rows: int = 20) -> DataFrame:
    """(cause, effect, lag, f, p_value) for every ordered pair; F test of the lags of `cause` in `effect`.

    Rows are repeated once per lag order (lags above it set to 0), so one aggregate per column pair serves all orders.
    """
    base = df.select(ts, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    level = base.agg(*[F.avg(c).alias(c) for c in cols]).first()  # the constant takes up any shift; products of far values lose digits
    base = base.select(ts, *[(F.col(c) - F.lit(level[c] or 0.0)).alias(c) for c in cols])
    placed, small = positions(base, ts)
    spec = {f"_{i}_{k}": (c, k) for i, c in enumerate(cols) for k in range(1, maxlag + 1)}
    history = sliding(placed, "_pos", maxlag, 0, lambda w: {
        "_h": F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.lag(c, k).over(w), F.lit(0.0)).alias("v")) for c, k in spec.values()])}, (), small)
    order = F.explode(F.sequence(F.lit(1), F.lit(maxlag))).alias("lag")
    spread = history.select("_pos", "_h", F.array(*cols).alias("_now"), order).where(F.col("_pos") >= F.col("lag"))
    used = F.transform("_h", lambda h: F.when(h["k"] <= F.col("lag"), h["v"]).otherwise(0.0))
    names = list(spec)
    size = len(names) + len(cols)
    gram = vector_products(spread.select("lag", F.concat(used, "_now").alias("_x")), "_x", size, ["lag"])

    @F.pandas_udf("array<struct<cause:int,effect:int,f:double,p:double>>")
    def test(n: pd.Series, lag: pd.Series, packed: pd.Series) -> pd.Series:
        out = []
        for rows, k, g in zip(n, lag, packed):
            a = unpack(g, size)
            found = []
            for e in range(len(cols)):
                y = len(names) + e + 1
                own = [0] + [e * maxlag + j + 1 for j in range(k)]
                _, restricted = solve(a, own, y)
                for c in range(len(cols)):
                    if c == e:
                        continue
                    full = own + [c * maxlag + j + 1 for j in range(k)]
                    _, rss = solve(a, full, y)
                    d2 = rows - len(full)
                    if rows + k < min_rows or d2 <= 0 or rss <= 0:
                        continue
                    f = max(restricted - rss, 0.0) / k / (rss / d2)
                    found.append({"cause": c, "effect": e, "f": float(f), "p": f_sf(f, k, d2)})
            out.append(found)
        return pd.Series(out)

    rows = gram.select("lag", F.explode(test("n", "lag", "gram")).alias("_t"))
    names_of = F.array(*[F.lit(c) for c in cols])
    return rows.select(
        names_of[F.col("_t.cause")].alias("cause"), names_of[F.col("_t.effect")].alias("effect"), "lag", F.col("_t.f").alias("f"), F.col("_t.p").alias("p_value"))


def granger_summary(df: DataFrame, ts: str, cols: Sequence[str], maxlag: int = 4) -> DataFrame:
    """Smallest p per ordered pair and whether it is below 5 %."""
    return granger(df, ts, cols, maxlag).groupBy("cause", "effect").agg(
        F.min("p_value").alias("min_p"), F.min_by("lag", "p_value").alias("best_lag")).withColumn("significant", F.col("min_p") < 0.05)


# ---------------------------------------------------------------- segments and summary

def segment_stats(df: DataFrame, ts: str, value: str, breaks: DataFrame | Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Start, end, length and statistics of the segments that begin at the given positions.

    `breaks` is a list, or a frame (keys…, position) with a few break points per key.
    """
    keys = list(keys)
    placed, _ = positions(df, ts, keys)
    if isinstance(breaks, DataFrame):
        packed = breaks.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("position").cast("long"))).alias("_breaks"))
        if keys:
            placed = join_on(placed, broadcast_if_small(packed), keys, "left")
        else:
            row = packed.first()
            placed = placed.withColumn("_breaks", F.lit(row["_breaks"] if row else []).cast("array<bigint>"))
    else:
        placed = placed.withColumn("_breaks", F.array(*[F.lit(int(b)).cast("long") for b in sorted(breaks)]) if breaks else F.array().cast("array<bigint>"))
    pos = F.col("_pos")
    segment = F.size(F.filter(F.coalesce(F.col("_breaks"), F.array().cast("array<bigint>")), lambda b: b <= pos)) + 1
    return placed.withColumn("segment", segment).groupBy(*keys, "segment").agg(
        F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("length"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def future_dates(df: DataFrame, ts: str, horizon: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, step, ts): the next timestamps. Month starts step by month, otherwise by the median gap (a day if unknown)."""
    keys = list(keys)
    placed, small = positions(df.select(*keys, ts), ts, keys)
    gaps = sliding(placed, "_pos", 1, 0, lambda w: {"_prev": F.lag(ts, 1).over(w)}, keys, small)
    gap = (F.col(ts) - F.col("_prev")).cast("interval second").cast("decimal(18,6)").cast("double")
    gaps = gaps.select(*keys, ts, gap.alias("_gap"), F.months_between(ts, "_prev").alias("_months"))
    facts = gaps.groupBy(*keys).agg(
        F.max(ts).alias("_last"), F.min((F.dayofmonth(ts) == 1).cast("int")).alias("_first_days"), F.min("_months").alias("_mn"), F.max("_months").alias("_mx"))
    med = quantiles(gaps, "_gap", [0.5], keys, ["_median"])
    facts = join_on(facts, broadcast_if_small(med), keys, "left") if keys else facts.withColumn("_median", F.lit((med.first() or [None])[0]).cast("double"))
    monthly = (F.col("_first_days") == 1) & (F.col("_mn") == 1) & (F.col("_mx") == 1)
    steps = facts.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    gap = F.coalesce(F.col("_median"), F.lit(86400.0))
    kind = df.schema[ts].dataType.simpleString()
    by_gap = (F.col("_last") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (gap * F.col("step")).cast("decimal(18,6)")))
    by_month = F.add_months(F.col("_last"), F.col("step")).cast(kind)
    return steps.select(*keys, "step", F.when(monthly, by_month).otherwise(by_gap.cast(kind)).alias(ts))


def series_summary(df: DataFrame, ts: str, cols: Sequence[str]) -> DataFrame:
    """One row: period, overall trend, seasonal and outlier variables, quality, alerts and grade."""
    cols = list(cols)
    spark = df.sparkSession
    base = df.agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        (F.sum(reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in cols])) * 100.0 / (F.count(F.lit(1)) * len(cols))).alias("missing_pct"))
    slopes = reduce(DataFrame.unionByName, [trend(df, ts, c).select(F.lit(c).alias("variable"), "slope", "p_value") for c in cols])
    monthly = df.groupBy(F.month(ts).alias("m")).agg(*[F.var_samp(c).alias(c) for c in cols])  # 12 rows
    seasonal = _stack(monthly, cols, {"s": lambda c: F.stddev_samp(c), "a": lambda c: F.avg(c)}).select("variable", (F.col("s") > F.col("a") * 0.5).alias("seasonal"))
    outliers = outlier_report(df, cols, None).select("variable", (F.col("iqr_outliers") > 0).alias("has_outliers"))
    per = slopes.join(F.broadcast(seasonal), "variable", "left").join(F.broadcast(outliers), "variable", "left")
    significant = F.col("p_value") < 0.05
    folded = per.agg(
        F.max((significant & (F.col("slope") > 0)).cast("int")).alias("up"), F.max((significant & (F.col("slope") <= 0)).cast("int")).alias("down"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("seasonal"), F.col("variable")))), ",").alias("seasonal_variables"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("has_outliers"), F.col("variable")))), ",").alias("outlier_variables"),
        F.coalesce(F.sum(F.col("has_outliers").cast("int")), F.lit(0)).alias("outlier_count"))
    row = base.withColumn("_j", F.lit(1)).join(F.broadcast(folded.withColumn("_j", F.lit(1))), "_j").drop("_j")
    quality = quality_label(F.col("missing_pct"))
    # Trend labels, grades and their limits.
    overall = F.when(F.col("up") == 1, "Creciente").when(F.col("down") == 1, "Decreciente").otherwise("Estable")
    row = row.withColumn("quality", quality).withColumn("overall_trend", overall)
    grade = (
        F.when((F.col("quality") == "Excelente") & (F.col("n") >= 100), "Excelente")
        .when(F.col("quality").isin("Excelente", "Buena") & (F.col("n") >= 50), "Buena")
        .when(F.col("quality").isin("Excelente", "Buena", "Regular"), "Revisar").otherwise("Requiere atención"))
    alerts = F.array_compact(F.array(
        F.when(F.col("missing_pct") > 15, "high_missing"), F.when(F.col("outlier_count") > len(cols) * 0.5, "many_outlier_variables"),
        F.when(F.col("n") < 30, "few_observations"), F.when((F.col("seasonal_variables") == "") & (F.col("n") > 365), "no_seasonality")))
    return row.select(
        "n", "first_ts", "last_ts", F.datediff("last_ts", "first_ts").alias("period_days"), F.lit(len(cols)).alias("variables"), "overall_trend",
        "seasonal_variables", "outlier_variables", "missing_pct", "quality", F.array_join(alerts, ",").alias("alerts"), grade.alias("recommendation"))

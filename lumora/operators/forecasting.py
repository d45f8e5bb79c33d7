"""Forecasts. Spark sums the normal equations (or the block maps) of every series; only those are solved outside SQL."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lumora.operators.models import regression_metrics
from lumora.operators.timeseries import _attach, _fields, future_dates, positions
from lumora.plans.gram import solve, unpack, vector_products
from lumora.plans.order import sliding
from lumora.plans.sizing import broadcast_if_small, cut_lineage, join_on


def _dated(forecast: DataFrame, df: DataFrame, ts: str, horizon: int, keys: Sequence[str]) -> DataFrame:
    """Steps with their timestamps (a few rows per series on both sides)."""
    dates = future_dates(df, ts, horizon, keys)
    return join_on(forecast, dates, [*keys, "step"]) if keys else join_on(forecast, broadcast_if_small(dates), ["step"])


def forecast_linear(df: DataFrame, ts: str, value: str, horizon: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Straight line over row positions, continued."""
    from lumora.operators.timeseries import trend

    line = trend(df, ts, value, keys)
    steps = line.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "n", "slope", "intercept")
    out = steps.select(*keys, "step", (F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))).alias("forecast"))
    return _dated(out, df.where(F.col(value).isNotNull()), ts, horizon, keys)


# ---------------------------------------------------------------- ARIMA: two regressions

def _off_level(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """`_y` less its mean per key, and these means: products of values far from zero would lose their last digits."""
    level = cut_lineage(df.groupBy(*keys).agg(F.avg("_y").alias("_level")))
    return _attach(df, level, keys).withColumn("_y", F.col("_y") - F.col("_level")).drop("_level"), level


def _on_level(df: DataFrame, level: DataFrame, keys: list[str], cols: Sequence[str] = ("forecast", "lower", "upper")) -> DataFrame:
    lifted = _attach(df, level, keys)
    return lifted.select(*[(F.col(c) + F.col("_level")).alias(c) if c in cols else F.col(c) for c in df.columns])


def _differenced(df: DataFrame, keys: list[str], small: bool, lag: int, source: str, out: str) -> DataFrame:
    return sliding(df, "_pos", lag, 0, lambda w: {out: F.col(source) - F.lag(source, lag).over(w)}, keys, small)


def _history(source: str, lags_: Sequence[int]):
    return lambda w: F.array(*[F.lag(source, k).over(w) for k in lags_])


def _innovations(w: DataFrame, keys: list[str], small: bool, order: int) -> DataFrame:
    """Residuals `_e` of a long autoregression of `_w` per key (first stage)."""
    past = sliding(w, "_pos", order, 0, lambda s: {"_past": _history("_w", range(1, order + 1))(s)}, keys, small)
    past = past.where(F.col("_w").isNotNull())
    full = past.where(~F.exists("_past", lambda v: v.isNull()))
    gram = vector_products(full.select(*keys, F.concat("_past", F.array("_w")).alias("_v")), "_v", order + 1, keys)

    @F.pandas_udf("array<double>")
    def weights(g: pd.Series) -> pd.Series:
        return pd.Series([solve(unpack(p, order + 1), list(range(order + 1)), order + 1)[0].tolist() for p in g])

    beta = gram.select(*keys, weights("gram").alias("_beta"))
    joined = _attach(past, beta, keys)
    fit = F.aggregate(F.zip_with("_past", F.slice("_beta", 2, order), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col("_beta")[0]
    return joined.withColumn("_e", F.coalesce(F.col("_w") - fit, F.lit(0.0))).drop("_past", "_beta")


def _arma_gram(e: DataFrame, keys: list[str], small: bool, ar: Sequence[int], ma: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(matrices of [AR lags, MA lags, value] per key, tails with the last values needed by a forecast)."""
    reach = max([*ar, *ma])
    h = sliding(e, "_pos", reach, 0, lambda s: {"_v": F.concat(_history("_w", ar)(s), _history("_e", ma)(s), F.array("_w"))}, keys, small)
    gram = vector_products(h.where(~F.exists("_v", lambda v: v.isNull())).select(*keys, "_v"), "_v", len(ar) + len(ma) + 1, keys)
    last = e.groupBy(*keys).agg(F.max("_pos").alias("_last"))
    tail = _attach(e, last, keys).where(F.col("_pos") > F.col("_last") - reach - 1)
    tails = tail.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_w", "_e"))).alias("_tail"))
    return gram, tails


def _psi(ar: np.ndarray, ma: np.ndarray, steps: int) -> np.ndarray:
    psi = np.zeros(steps)
    psi[0] = 1.0
    for j in range(1, steps):
        psi[j] = (ma[j - 1] if j <= len(ma) else 0.0) + sum(ar[k] * psi[j - 1 - k] for k in range(min(j, len(ar))))
    return psi


def _recursion(tail, ar_lags, ar_w, ma_lags, ma_w, const, steps):
    w = [t["_w"] for t in tail]
    e = [t["_e"] for t in tail]
    out = []
    for _ in range(steps):
        v = const + sum(c * w[-k] for k, c in zip(ar_lags, ar_w) if k <= len(w)) + sum(c * e[-k] for k, c in zip(ma_lags, ma_w) if k <= len(e))
        w.append(v)
        e.append(0.0)
        out.append(v)
    return np.array(out)


def _poly(lags_, weights_, size) -> np.ndarray:
    p = np.zeros(size)
    for k, v in zip(lags_, weights_):
        p[k - 1] = v
    return p


def _integrated_ar(ar: np.ndarray, diffs: Sequence[int]) -> np.ndarray:
    """AR weights of the undifferenced series: (1 − Σ aL)(1 − L^s)… as 1 − Σ bL."""
    poly = np.concatenate([[1.0], -ar])
    for s in diffs:
        factor = np.zeros(s + 1)
        factor[0], factor[s] = 1.0, -1.0
        poly = np.convolve(poly, factor)
    return -poly[1:]


def _undifference(path: np.ndarray, last: Sequence[float], diffs: Sequence[int]) -> np.ndarray:
    """Values from forecast differences, given enough last values of the series."""
    poly = np.array([1.0])
    for s in diffs:
        factor = np.zeros(s + 1)
        factor[0], factor[s] = 1.0, -1.0
        poly = np.convolve(poly, factor)
    series = list(last)
    for v in path:
        series.append(v - sum(poly[k] * series[-k] for k in range(1, len(poly))))
    return np.array(series[len(last):])


# ---------------------------------------------------------------- conditional sum of squares

#: Rows of a block, at least; blocks that one step of the fold merges, at most.
CSS_BLOCK, CSS_FAN = 4096, 32


def _css_sets(beta: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """The weights, each moved a little in turn, and the moves."""
    moves = np.full(len(beta), 1e-4)
    moves[0] *= max(scale, 1e-12)
    return np.vstack([beta, beta + np.diag(moves)]), moves


def _css_block(w: np.ndarray, sets: np.ndarray, ar: Sequence[int], ma: Sequence[int], reach: int, entered: bool) -> tuple[np.ndarray, np.ndarray]:
    """(innovations at the end, products of innovations) of a run for every set of weights; `w` begins with `reach` earlier values.

    Innovations are linear in those before the run. With `entered` they are kept as vectors over (earlier innovations, 1), so that runs can
    be joined later; without, the run begins the series and earlier innovations are 0.
    """
    n, count, width = len(w) - reach, len(sets), reach + 1 if entered else 1
    u = w[reach:] - sets[:, :1] - sum(sets[:, 1 + i, None] * w[reach - a: len(w) - a] for i, a in enumerate(ar))
    theta = sets[:, 1 + len(ar):, None]
    past = np.zeros((n + reach, count, width))
    if entered:
        past[np.arange(reach), :, np.arange(reach)] = 1.0
    past[reach:, :, -1] = u.T
    with np.errstate(all="ignore"):
        if ma:
            for t in range(reach, n + reach):
                for j, b in enumerate(ma):
                    past[t] -= theta[:, j] * past[t - b]
        flat = past[reach:].reshape(n, -1)
        form = (flat.T @ flat).reshape(count, width, count, width)
    end = np.zeros((count, width, width)) if entered else past[n:].transpose(1, 0, 2)
    if entered:
        end[:, :reach] = past[n:].transpose(1, 0, 2)
        end[:, reach, reach] = 1.0
    return end, form


def _css_then(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        return two[0] @ one[0], one[1] + np.einsum("kab,kalc,lcd->kbld", one[0], two[1], one[0], optimize=True)


def _css_step(found: dict, products: np.ndarray, moves: np.ndarray, ends: np.ndarray) -> dict:
    """One Gauss–Newton step: accepted where the sum of squares falls, else the last step is cut to a quarter."""
    sse = products[0, 0]
    if np.isfinite(sse) and (found["sse"] is None or not np.isfinite(found["sse"]) or sse < found["sse"]):
        slopes = (products[1:, 0] - sse) / moves
        bends = (products[1:, 1:] - products[1:, :1] - products[:1, 1:] + sse) / np.outer(moves, moves)
        size = np.sqrt(np.clip(np.diag(bends), 1e-300, None))
        delta = np.zeros(len(slopes))
        if np.isfinite(bends).all() and np.isfinite(slopes).all():
            delta = -np.linalg.lstsq(bends / np.outer(size, size), slopes / size, rcond=1e-8)[0] / size
        best = found["centre"]
        return {"centre": best + delta, "best": best, "delta": delta, "sse": float(sse), "ends": ends}
    delta = found["delta"] * 0.25
    return found | {"centre": found["best"] + delta, "delta": delta}


def _invertible(theta: np.ndarray, ma: Sequence[int]) -> np.ndarray:
    """Innovation weights, halved until the recursion forgets its start."""
    while len(theta):
        poly = np.zeros(max(ma) + 1)
        poly[0] = 1.0
        for j, b in enumerate(ma):
            poly[b] += theta[j]
        if not len(np.roots(poly)) or np.abs(np.roots(poly)).max() < 0.999:
            break
        theta = theta * 0.5
    return theta


def css_fit(series: DataFrame, start: DataFrame, keys: Sequence[str], reach: int, size: int, rounds: int = 8) -> DataFrame:
    """(keys…, _beta, _sse, _n, _ends): weights that lower the sum of squared innovations, conditional on the first `reach` values.

    `series` has contiguous `_pos` from 0 and `_w`; `start` has a row per key: `_beta` (constant, value weights, innovation weights;
    at most `size` of them), `_ar` and `_ma` (their lags), `_scale` (spread of innovations). Gauss–Newton steps need one pass each:
    innovations are an affine recurrence, so a block is summed up by its map and the products of its innovations under all moved
    weights, and blocks merge in a tree. Where every series is one block, all steps are one pass. `_ends` are the last innovations, oldest first.
    """
    keys = list(keys)
    joint = (size + 1) * (reach + 1)
    rows = max(CSS_BLOCK * math.ceil(joint * joint / 16384), reach)
    fan = max(2, min(CSS_FAN, 4_000_000 // (joint * joint)))
    at = F.filter(F.array_distinct(F.array(F.floor((F.col("_pos") - reach) / rows), F.floor(F.col("_pos") / rows))), lambda b: b >= 0)
    spread = series.select(*keys, F.explode(at).alias("_block"), "_pos", "_w")
    # a block holds `rows` values and the `reach` before them
    spread = spread.where(F.col("_pos") < (F.col("_block") + 1) * rows + reach)
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_w")))
    blocks = spread.groupBy(*keys, "_block").agg(F.transform(ordered, lambda r: r["_w"]).alias("_y")).where(F.size("_y") > reach)
    blocks = cut_lineage(_attach(blocks, start, keys))
    most = blocks.agg(F.max("_block")).first()[0] or 0
    fields = _fields(series, keys)
    names = ["centre", "best", "delta", "sse", "ends"]
    types = "centre array<double>, best array<double>, delta array<double>, sse double, ends array<double>"
    model = ["_ar", "_ma", "_scale"]

    def first(r: dict) -> dict:
        beta, ma = np.asarray(r["_beta"], dtype=float), list(r["_ma"])
        cut = 1 + len(r["_ar"])
        beta = np.concatenate([beta[:cut], _invertible(beta[cut:], ma)])
        return {"centre": beta, "best": beta, "delta": np.zeros(len(beta)), "sse": None, "ends": np.zeros(reach)}

    def listed(found: dict) -> tuple:
        return tuple(v.tolist() if isinstance(v, np.ndarray) else v for v in (found[n] for n in names))

    def search(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                w, found = np.asarray(r["_y"], dtype=float), first(r)
                for _ in range(rounds):
                    sets, moves = _css_sets(found["centre"], r["_scale"])
                    end, form = _css_block(w, sets, list(r["_ar"]), list(r["_ma"]), reach, False)
                    found = _css_step(found, form[:, 0, :, 0], moves, end[0, :, 0])
                out.append((*[r[k] for k in keys], *listed(found), len(w) - reach))
            yield pd.DataFrame(out, columns=[*keys, *names, "_n"])

    def maps(batches):
        for batch in batches:
            for r in batch.to_dict("records"):  # a row holds a whole block
                centre = np.asarray(r["centre"]) if "centre" in r else first(r)["centre"]
                sets, _ = _css_sets(centre, r["_scale"])
                w, whole = np.asarray(r["_y"], dtype=float), None
                piece = max(reach, 4_000_000 // joint)
                for i in range(0, len(w) - reach, piece):
                    part = _css_block(w[i: i + piece + reach], sets, list(r["_ar"]), list(r["_ma"]), reach, True)
                    whole = part if whole is None else _css_then(whole, part)
                yield pd.DataFrame([(*[r[k] for k in keys], r["_block"], len(w) - reach, whole[0].ravel().tolist(), whole[1].ravel().tolist())],
                                   columns=[*keys, "_block", "_n", "_map", "_form"])

    def shaped(m, f) -> tuple[np.ndarray, np.ndarray]:
        m = np.asarray(m, dtype=float).reshape(-1, reach + 1, reach + 1)
        return m, np.asarray(f, dtype=float).reshape(len(m), reach + 1, len(m), reach + 1)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for m, f in pdf.sort_values("_block")[["_map", "_form"]].itertuples(index=False):
            part = shaped(m, f)
            whole = part if whole is None else _css_then(whole, part)
        out = pdf.iloc[[0]].copy()
        out["_block"], out["_n"] = out["_block"] // fan, pdf["_n"].sum()
        out["_map"], out["_form"] = [whole[0].ravel().tolist()], [whole[1].ravel().tolist()]
        return out[[*keys, "_block", "_n", "_map", "_form"]]

    def step(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                found = {n: np.asarray(r[n], dtype=float) if n != "sse" else r[n] for n in names} if "centre" in r else first(r)
                _, moves = _css_sets(found["centre"], r["_scale"])
                m, f = shaped(r["_map"], r["_form"])
                out.append((*[r[k] for k in keys], *listed(_css_step(found, f[:, reach, :, reach], moves, m[0, :reach, reach])), r["_n"]))
            yield pd.DataFrame(out, columns=[*keys, *names, "_n"])

    schema = f"{fields}{types}, _n long"
    part_schema = f"{fields}_block long, _n long, _map array<double>, _form array<double>"
    if most == 0:
        found = cut_lineage(blocks.mapInPandas(search, schema))
    else:
        found = None
        for _ in range(rounds):
            now = blocks if found is None else _attach(blocks, found.drop("_n"), keys)
            parts, top = now.mapInPandas(maps, part_schema), most
            while top > 0:
                parts = parts.groupBy(*keys, F.floor(F.col("_block") / fan).alias("_up")).applyInPandas(merge, part_schema)
                top //= fan
            whole = _attach(parts.drop("_block"), start.select(*keys, "_beta", *model), keys)
            if found is not None:
                whole = _attach(whole, found.drop("_n"), keys)
            found = cut_lineage(whole.mapInPandas(step, schema))
    return found.where("sse is not null").select(*keys, F.col("best").alias("_beta"), F.col("sse").alias("_sse"), "_n", F.col("ends").alias("_ends"))


MAX_P, MAX_D, MAX_Q = 3, 2, 3
Z95 = 1.959963984540054


def forecast_arima(
    df: DataFrame, ts: str, value: str, horizon: int = 12, keys: Sequence[str] = (), auto: bool = True, order: tuple[int, int, int] = (1, 1, 1)
) -> DataFrame:
    """(keys…, step, ts, forecast, lower, upper, p, d, q, aic).

    The order comes from Hannan–Rissanen: a long autoregression estimates the innovations, then value lags and innovation lags are
    regressors. One matrix per series and difference order holds all p × q candidates, so 48 models cost three matrices.
    The weights of the chosen order are then refined by their conditional sum of squares (`css_fit`), which gives `aic` too.
    """
    keys = list(keys)
    base = df.select(*keys, ts, F.col(value).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    base, level = _off_level(base, keys)
    placed, small = positions(base, ts, keys)
    series = cut_lineage(placed)
    ds = list(range(MAX_D + 1)) if auto else [order[1]]
    step = series.withColumn("_d0", F.col("_y"))
    for d in range(1, max(ds) + 1):
        step = _differenced(step, keys, small, 1, f"_d{d - 1}", f"_d{d}")
    stacked = None
    for d in ds:
        one = step.select(*keys, F.lit(d).alias("_d"), (F.col("_pos") - d).alias("_pos"), F.col(f"_d{d}").alias("_w")).where(F.col("_w").isNotNull())
        stacked = one if stacked is None else stacked.unionByName(one)
    by = [*keys, "_d"]
    e = _innovations(stacked, by, small, 8)
    ar, ma = list(range(1, MAX_P + 1)), list(range(1, MAX_Q + 1))
    gram, tails = _arma_gram(e, by, small, ar, ma)
    last = _attach(series, series.groupBy(*keys).agg(F.max("_pos").alias("_last")), keys).where(F.col("_pos") > F.col("_last") - 4)
    ends = last.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_y"))), lambda r: r["_y"]).alias("_ends_y"))
    size, reach = MAX_P + MAX_Q + 1, max(MAX_P, MAX_Q)

    @F.pandas_udf("p int, q int, aic double, beta array<double>, scale double")
    def best(n: pd.Series, packed: pd.Series) -> pd.DataFrame:
        out = []
        for rows, g in zip(n, packed):
            a = unpack(g, size)
            chosen = (None, None, None, None, None)
            for p in range(MAX_P + 1) if auto else [order[0]]:
                for q in range(MAX_Q + 1) if auto else [order[2]]:
                    x = [0, *range(1, p + 1), *range(MAX_P + 1, MAX_P + 1 + q)]
                    if rows <= len(x) + 1:
                        continue
                    beta, rss = solve(a, x, size)
                    aic = rows * math.log(max(rss, 1e-300) / rows) + 2 * (len(x) + 1)
                    if chosen[2] is None or aic < chosen[2]:
                        chosen = (p, q, aic, beta.tolist(), math.sqrt(rss / rows))
            out.append(chosen)
        return pd.DataFrame(out, columns=["p", "q", "aic", "beta", "scale"])

    fits = gram.select(*keys, F.col("_d").alias("d"), best("n", "gram").alias("_f")).select(*keys, "d", "_f.*")
    top = fits.where("aic is not null").groupBy(*keys).agg(F.min_by(F.struct("p", "d", "q", "beta", "scale"), F.col("aic")).alias("_b"))
    chosen = cut_lineage(top.select(*keys, "_b.*"))
    upto = lambda c: F.when(F.col(c) > 0, F.sequence(F.lit(1), F.greatest(F.col(c), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    start = chosen.select(*keys, F.col("beta").alias("_beta"), upto("p").alias("_ar"), upto("q").alias("_ma"), F.col("scale").alias("_scale"))
    order_of = chosen.select(*keys, "p", "d", "q")
    w = _attach(stacked, order_of, keys).where(F.col("_d") == F.col("d"))
    refined = css_fit(w.select(*keys, "_pos", "_w"), start, keys, reach, size)
    tail = _attach(tails, order_of, keys).where(F.col("_d") == F.col("d")).drop("_d")
    ready = _attach(_attach(tail, refined, keys), ends, keys)

    @F.pandas_udf("array<struct<forecast:double,error:double>>")
    def ahead(p: pd.Series, d: pd.Series, q: pd.Series, beta: pd.Series, sse: pd.Series, n: pd.Series, tail_: pd.Series, e: pd.Series, ends_: pd.Series) -> pd.Series:
        out = []
        for np_, diff, nq, b, rss, rows, t, last_e, last_values in zip(p, d, q, beta, sse, n, tail_, e, ends_):
            known = [{"_w": r["_w"], "_e": v} for r, v in zip(list(t)[-reach:], last_e)]
            path = _recursion(known, ar[:np_], b[1: np_ + 1], ma[:nq], b[np_ + 1:], b[0], horizon)
            psi = _psi(_integrated_ar(np.array(b[1: np_ + 1]), [1] * int(diff)), np.array(b[np_ + 1:]), horizon)
            error = np.sqrt(rss / max(rows - len(b), 1) * np.cumsum(psi * psi))
            out.append([{"forecast": float(v), "error": float(z)} for v, z in zip(_undifference(path, last_values, [1] * int(diff)), error)])
        return pd.Series(out)

    aic = F.col("_n") * F.ln(F.greatest(F.col("_sse"), F.lit(1e-300)) / F.col("_n")) + 2 * (F.size("_beta") + 1)
    rows = ready.select(*keys, "p", "d", "q", aic.alias("aic"), F.posexplode(ahead("p", "d", "q", "_beta", "_sse", "_n", "_tail", "_ends", "_ends_y")).alias("_at", "_z"))
    half = Z95 * F.col("_z.error")
    out = rows.select(*keys, (F.col("_at") + 1).alias("step"), F.col("_z.forecast").alias("forecast"), (F.col("_z.forecast") - half).alias("lower"),
                      (F.col("_z.forecast") + half).alias("upper"), "p", "d", "q", "aic")
    return _on_level(_dated(out, base, ts, horizon, keys), level, keys)


def forecast_sarima(df: DataFrame, ts: str, value: str, horizon: int = 12, season: int = 12, keys: Sequence[str] = ()) -> DataFrame:
    """(1,1,1)(1,1,1,season): once and seasonally differenced values on lags 1, s, s+1 of values and innovations.

    Two regressions give first weights, `css_fit` lowers the sum of squared innovations from there.
    """
    keys = list(keys)
    base = df.select(*keys, ts, F.col(value).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    placed, small = positions(base, ts, keys)
    series = cut_lineage(placed)
    once = _differenced(series, keys, small, 1, "_y", "_d1")
    twice = _differenced(once, keys, small, season, "_d1", "_w").where(F.col("_w").isNotNull())
    w = twice.select(*keys, (F.col("_pos") - season - 1).alias("_pos"), "_w")
    e = _innovations(w, keys, small, season + 1)
    lags_ = [1, season, season + 1]
    gram, tails = _arma_gram(e, keys, small, lags_, lags_)
    reach = season + 2
    last = _attach(series, series.groupBy(*keys).agg(F.max("_pos").alias("_last")), keys).where(F.col("_pos") > F.col("_last") - reach)
    ends = last.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_y"))), lambda r: r["_y"]).alias("_ends"))

    @F.pandas_udf("beta array<double>, scale double")
    def weights(n: pd.Series, packed: pd.Series) -> pd.DataFrame:
        fits = [(solve(unpack(g, 7), list(range(7)), 7), rows) for rows, g in zip(n, packed)]
        return pd.DataFrame([(beta.tolist(), math.sqrt(rss / rows)) for (beta, rss), rows in fits], columns=["beta", "scale"])

    seasonal = F.array(*[F.lit(k) for k in lags_])
    begun = gram.select(*keys, weights("n", "gram").alias("_f"))
    start = cut_lineage(begun.select(*keys, F.col("_f.beta").alias("_beta"), seasonal.alias("_ar"), seasonal.alias("_ma"), F.col("_f.scale").alias("_scale")))
    ready = _attach(_attach(css_fit(w, start, keys, season + 1, 7), tails, keys), ends.withColumnRenamed("_ends", "_ends_y"), keys)

    @F.pandas_udf("array<struct<forecast:double,error:double>>")
    def run(beta: pd.Series, sse: pd.Series, n: pd.Series, tail: pd.Series, e: pd.Series, ends_: pd.Series) -> pd.Series:
        out = []
        for b, rss, rows, t, last_e, last_values in zip(beta, sse, n, tail, e, ends_):
            known = [{"_w": r["_w"], "_e": v} for r, v in zip(list(t)[-(season + 1):], last_e)]
            path = _recursion(known, lags_, b[1:4], lags_, b[4:7], b[0], horizon)
            psi = _psi(_integrated_ar(_poly(lags_, b[1:4], season + 1), [1, season]), _poly(lags_, b[4:7], season + 1), horizon)
            error = np.sqrt(rss / max(rows - 7, 1) * np.cumsum(psi * psi))
            values = _undifference(path, last_values, [1, season])
            out.append([{"forecast": float(v), "error": float(s)} for v, s in zip(values, error)])
        return pd.Series(out)

    rows = ready.select(*keys, F.posexplode(run("_beta", "_sse", "_n", "_tail", "_ends", "_ends_y")).alias("_at", "_z"))
    half = Z95 * F.col("_z.error")
    out = rows.select(*keys, (F.col("_at") + 1).alias("step"), F.col("_z.forecast").alias("forecast"), (F.col("_z.forecast") - half).alias("lower"), (F.col("_z.forecast") + half).alias("upper"))
    return _dated(out, base, ts, horizon, keys)


# ---------------------------------------------------------------- Holt–Winters by block maps

#: Rows of a block (more for long seasons, whose maps are larger), and blocks that one step of the fold merges.
HW_BLOCK, HW_FAN = 4096, 32
HW_GRID = [(a, b, g) for a in (0.1, 0.3, 0.5, 0.8) for b in (0.01, 0.1, 0.3) for g in (0.05, 0.2, 0.5)]


def _hw_run(values: np.ndarray, first: int, m: int, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps and error forms of equally long runs (rows of `values`) that begin in the same phase, all taken along together."""
    size, (runs, length) = m + 3, values.shape
    alpha, beta, gamma = (sets[:, i, None] for i in range(3))
    state = np.tile(np.eye(size), (runs, len(sets), 1, 1))
    form = np.zeros_like(state)
    for i in range(length):
        p = 2 + (first + i) % m
        ahead = state[:, :, 0] + state[:, :, 1]
        err = -(ahead + state[:, :, p])
        err[:, :, size - 1] += values[:, i, None]
        form += err[:, :, :, None] * err[:, :, None, :]
        state[:, :, 0] = ahead + alpha * err
        state[:, :, 1] += alpha * beta * err
        state[:, :, p] += gamma * (1 - alpha) * err
    return state, form


def _hw_then(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Map and error form of two runs, one after the other."""
    return two[0] @ one[0], one[1] + one[0].transpose(0, 2, 1) @ two[1] @ one[0]


def _hw_block(values: np.ndarray, first: int, m: int, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Affine state map and squared-error form of a run of rows, for every parameter set.

    The state (level, slope, m seasonals, 1) is linear in the state at the start of the block, so a block
    is summed up by one matrix, and its squared error by one quadratic form.
    """
    lanes = min(64, len(values) // (4 * (m + 3)))
    length = len(values) // lanes // m * m if lanes > 1 else 0
    whole = None
    if length:
        states, forms = _hw_run(values[: lanes * length].reshape(lanes, length), first, m, sets)
        for part in zip(states, forms):
            whole = part if whole is None else _hw_then(whole, part)
    rest = values[lanes * length if length else 0:]
    if len(rest) or whole is None:
        states, forms = _hw_run(rest[None], first, m, sets)  # lanes are whole seasons, so the phase is the same
        whole = (states[0], forms[0]) if whole is None else _hw_then(whole, (states[0], forms[0]))
    return whole


def _hw_start(head: np.ndarray, m: int) -> np.ndarray:
    one, two = head[:m].mean(), head[m: 2 * m].mean()
    return np.concatenate([[one, (two - one) / m], head[:m] - one, [1.0]])


def _hw_sets(centre: np.ndarray, width: float) -> np.ndarray:
    """Parameters at a point of the logit scale and a step to both sides of it in every direction."""
    at = np.vstack([centre, *[centre + sign * width * np.eye(3)[i] for i in range(3) for sign in (1, -1)]])
    return 1 / (1 + np.exp(-np.clip(at, -7, 7)))


def _hw_step(found: dict | None, sets: np.ndarray, state: np.ndarray, form: np.ndarray, start: np.ndarray) -> dict:
    """One step of the search. The best set so far is kept; gradient and curvature of the error around the centre say where to look next."""
    sse = np.einsum("i,gij,j->g", start, form, start)
    i = int(sse.argmin())
    logit = lambda v: np.log(v / (1 - v))
    if found is None:
        return {"centre": logit(sets[i]), "width": 0.4, "best": sets[i], "sse": sse[i], "final": state[i] @ start}
    new = dict(found)
    if sse[i] < found["sse"]:
        new |= {"best": sets[i], "sse": sse[i], "final": state[i] @ start}
    h = found["width"]
    if sse[0] <= found["sse"] * (1 + 1e-9):  # the centre may be the best point itself
        slope, bend = (sse[1::2] - sse[2::2]) / (2 * h), (sse[1::2] - 2 * sse[0] + sse[2::2]) / h**2
        newton = -slope / np.where(bend > 0, bend, 1.0)
        new["centre"] = np.clip(found["centre"] + np.clip(np.where(bend > 0, newton, -np.sign(slope) * 3 * h), -3 * h, 3 * h), -6.5, 6.5)
        new["width"] = h * 0.7
    else:
        new["centre"], new["width"] = logit(np.clip(new["best"], 1e-3, 1 - 1e-3)), h * 0.4
    return new


def forecast_holt_winters(
    df: DataFrame, ts: str, value: str, horizon: int = 12, season: int = 12, keys: Sequence[str] = (), rounds: int = 8
) -> DataFrame:
    """Additive trend and season; band ±10 % of the forecast. Series shorter than two seasons have no forecast.

    Parameters: the best of a grid by squared error, then `rounds` steps of a search by gradient and curvature that never raise the error.
    A series is cut into blocks that are summed up in parallel; maps of consecutive blocks merge in a tree, so no task sees
    more than 32 blocks. Where every series is one block, the whole search is one pass.
    """
    keys = list(keys)
    base = df.select(*keys, ts, F.col(value).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    base, level = _off_level(base, keys)
    placed, _ = positions(base, ts, keys)
    fields, size = _fields(df, keys), season + 3
    rows = HW_BLOCK * math.ceil(size * size / 512)
    ordered = F.array_sort(F.collect_list(F.struct("_pos", "_y")))
    blocks = cut_lineage(placed.groupBy(*keys, F.floor(F.col("_pos") / rows).alias("_block")).agg(
        F.min("_pos").alias("_first"), F.transform(ordered, lambda r: r["_y"]).alias("_y")))
    most = blocks.agg(F.max("_block")).first()[0] or 0
    grid = np.array(HW_GRID)
    found_names = ["centre", "width", "best", "sse", "final"]
    found_types = "centre array<double>, width double, best array<double>, sse double, final array<double>"

    def listed(found: dict) -> tuple:
        return tuple(v.tolist() if isinstance(v, np.ndarray) else float(v) for v in (found[n] for n in found_names))

    def search(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                y = np.asarray(r["_y"], dtype=float)
                if len(y) < 2 * season:
                    continue
                start = _hw_start(y, season)
                found = _hw_step(None, grid, *_hw_block(y, 0, season, grid), start)
                for _ in range(rounds):
                    sets = _hw_sets(found["centre"], found["width"])
                    found = _hw_step(found, sets, *_hw_block(y, 0, season, sets), start)
                out.append((*[r[k] for k in keys], len(y), *listed(found)))
            yield pd.DataFrame(out, columns=[*keys, "_rows", *found_names])

    def maps(batches):
        for batch in batches:
            for r in batch.to_dict("records"):  # a row holds a whole block
                at = _hw_sets(np.array(r["centre"]), r["width"]) if "centre" in r else grid
                state, form = _hw_block(np.asarray(r["_y"], dtype=float), int(r["_first"]), season, at)
                yield pd.DataFrame([(*[r[k] for k in keys], r["_block"], state.ravel().tolist(), form.ravel().tolist())], columns=[*keys, "_block", "_state", "_form"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for s, f in pdf.sort_values("_block")[["_state", "_form"]].itertuples(index=False):
            part = np.array(s).reshape(-1, size, size), np.array(f).reshape(-1, size, size)
            whole = part if whole is None else _hw_then(whole, part)
        out = pdf.iloc[[0]].copy()
        out["_block"], out["_state"], out["_form"] = out["_block"] // HW_FAN, [whole[0].ravel().tolist()], [whole[1].ravel().tolist()]
        return out[[*keys, "_block", "_state", "_form"]]

    def step(batches):
        for batch in batches:
            out = []
            for r in batch.to_dict("records"):
                old = {n: np.asarray(r[n]) if isinstance(r[n], (list, np.ndarray)) else r[n] for n in found_names} if "centre" in r else None
                sets = grid if old is None else _hw_sets(old["centre"], old["width"])
                state, form = (np.array(r[n]).reshape(-1, size, size) for n in ("_state", "_form"))
                out.append((*[r[k] for k in keys], r["_rows"], *listed(_hw_step(old, sets, state, form, _hw_start(np.asarray(r["_head"]), season)))))
            yield pd.DataFrame(out, columns=[*keys, "_rows", *found_names])

    found_schema = f"{fields}_rows long, {found_types}"
    part_schema = f"{fields}_block long, _state array<double>, _form array<double>"
    if most == 0:
        found = blocks.mapInPandas(search, found_schema)
    else:
        lengths = blocks.groupBy(*keys).agg(F.sum(F.size("_y")).alias("_rows"))
        heads = _attach(blocks.where("_block = 0").select(*keys, F.slice("_y", 1, 2 * season).alias("_head")), lengths, keys)
        if rows < 2 * season:
            raise ValueError("a block must hold two seasons")
        heads = cut_lineage(heads.where(F.size("_head") == 2 * season))
        found = None
        for _ in range(rounds + 1):
            parts = (blocks if found is None else _attach(blocks, found.drop("_rows"), keys)).mapInPandas(maps, part_schema)
            top = most
            while top > 0:
                parts = parts.groupBy(*keys, F.floor(F.col("_block") / HW_FAN).alias("_up")).applyInPandas(merge, part_schema)
                top //= HW_FAN
            whole = _attach(parts.drop("_block"), heads, keys)
            if found is not None:
                whole = _attach(whole, found.drop("_rows"), keys)
            found = cut_lineage(whole.mapInPandas(step, found_schema))
    ahead = found.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "_rows", "best", "sse", "final")
    phase = ((F.col("_rows") + F.col("step") - 1) % season + 3).cast("int")
    out = ahead.select(*keys, "step", (F.col("final")[0] + F.col("step") * F.col("final")[1] + F.element_at("final", phase)).alias("forecast"),
                       *[F.col("best")[i].alias(n) for i, n in enumerate(("alpha", "beta", "gamma"))], "sse")
    out = _on_level(out, level, keys)
    band = F.abs(F.col("forecast")) * 0.1
    out = out.select(*keys, "step", "forecast", (F.col("forecast") - band).alias("lower"), (F.col("forecast") + band).alias("upper"), "alpha", "beta", "gamma", "sse")
    return _dated(out, base, ts, horizon, keys)


# ---------------------------------------------------------------- several series, calendar regression

def forecast_var(df: DataFrame, ts: str, cols: Sequence[str], horizon: int = 12, maxlag: int = 5) -> DataFrame:
    """(step, ts, variable, forecast, lag_order): vector autoregression, order by AIC from one matrix."""
    cols = list(cols)
    k = len(cols)
    base = df.select(ts, *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    level = base.agg(*[F.avg(c).alias(c) for c in cols]).first()  # products of values far from zero lose digits
    base = base.select(ts, *[(F.col(c) - F.lit(level[c] or 0.0)).alias(c) for c in cols])
    placed, small = positions(base, ts)
    h = sliding(placed, "_pos", maxlag, 0, lambda w: {"_v": F.array(*[F.lag(c, j).over(w) for j in range(1, maxlag + 1) for c in cols], *cols)}, (), small)
    row = vector_products(h.where(~F.exists("_v", lambda v: v.isNull())).select("_v"), "_v", k * (maxlag + 1)).first()
    n, a = row["n"], unpack(row["gram"], k * (maxlag + 1))
    best = None
    for p in range(1, maxlag + 1):
        x = list(range(k * p + 1))
        fits = [solve(a, x, k * maxlag + 1 + j)[0] for j in range(k)]
        b = np.array(fits)
        y = slice(k * maxlag + 1, None)
        resid = a[y, y] - b @ a[np.ix_(x, range(k * maxlag + 1, k * (maxlag + 1) + 1))] - a[np.ix_(range(k * maxlag + 1, k * (maxlag + 1) + 1), x)] @ b.T + b @ a[np.ix_(x, x)] @ b.T
        aic = np.linalg.slogdet(resid / n + 1e-12 * np.eye(k))[1] + 2 * k * (k * p + 1) / n
        if best is None or aic < best[0]:
            best = (aic, p, b)
    _, p, b = best
    tail = [[r[c] for c in cols] for r in placed.orderBy(F.desc("_pos")).limit(p).collect()]  # newest first
    rows = []
    for step in range(1, horizon + 1):
        x = np.concatenate([[1.0], *[np.array(t) for t in tail[:p]]])
        new = b @ x
        tail.insert(0, new.tolist())
        rows += [(step, c, float(v) + (level[c] or 0.0), p) for c, v in zip(cols, new)]
    out = df.sparkSession.createDataFrame(rows, "step int, variable string, forecast double, lag_order int")
    return join_on(out, future_dates(base, ts, horizon), ["step"])


def forecast_seasonal_regression(df: DataFrame, ts: str, value: str, horizon: int = 12, terms: int = 5, confidence: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    """Linear trend and yearly Fourier terms by least squares per series, with a residual band."""
    from statistics import NormalDist

    keys = list(keys)
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    base = df.select(*keys, ts, F.col(value).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    base, level = _off_level(base, keys)
    origin = base.agg(F.min(ts)).first()[0]
    size = 1 + 2 * terms

    def features():
        year = F.datediff(F.col(ts), F.lit(origin)).cast("double") / 365.25
        waves = [fn(F.lit(2 * math.pi * k) * year) for k in range(1, terms + 1) for fn in (F.sin, F.cos)]
        return F.array(year, *waves)

    gram = vector_products(base.select(*keys, F.concat(features(), F.array("_y")).alias("_v")), "_v", size + 1, keys)

    @F.pandas_udf("beta array<double>, spread double")
    def fit(n: pd.Series, packed: pd.Series) -> pd.DataFrame:
        out = []
        for rows, g in zip(n, packed):
            beta, rss = solve(unpack(g, size + 1), list(range(size + 1)), size + 1)
            out.append((beta.tolist(), math.sqrt(rss / max(rows - size - 1, 1))))
        return pd.DataFrame(out, columns=["beta", "spread"])

    fits = gram.select(*keys, fit("n", "gram").alias("_f")).select(*keys, "_f.*")
    ahead = _attach(future_dates(base, ts, horizon, keys), fits, keys).withColumn("_x", features())
    mean = F.col("beta")[0] + F.aggregate(F.zip_with("_x", F.slice("beta", 2, size), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    half = F.lit(z) * F.col("spread")
    return _on_level(ahead.select(*keys, "step", ts, mean.alias("forecast"), (mean - half).alias("lower"), (mean + half).alias("upper")), level, keys)


# ---------------------------------------------------------------- comparison

def forecast_metrics(actual: DataFrame, predicted: DataFrame, ts: str, value: str, prediction: str, keys: Sequence[str] = ()) -> DataFrame:
    """Regression metrics over the timestamps both sides have."""
    from lumora.operators.relational import inner_on_time

    return regression_metrics(inner_on_time(actual, predicted, ts, keys), value, prediction)


def best_model(actual: DataFrame, forecasts: dict[str, DataFrame], ts: str, value: str, prediction: str = "forecast") -> DataFrame:
    """(model, metrics…, best): one row per model, the lowest RMSE marked."""
    from functools import reduce

    rows = [forecast_metrics(actual, f.select(ts, prediction), ts, value, prediction).select(F.lit(m).alias("model"), "*") for m, f in forecasts.items()]
    table = reduce(DataFrame.unionByName, rows)
    top = table.agg(F.min_by("model", "rmse").alias("_m"), F.lit(1).alias("_j"))
    return table.withColumn("_j", F.lit(1)).join(F.broadcast(top), "_j").select(*table.columns, (F.col("model") == F.col("_m")).alias("best"))

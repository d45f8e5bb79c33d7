"""LOESS seasonal decomposition and change points, without gathering a series in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumora.operators.timeseries import _attach, _fields, positions
from lumora.plans.order import sliding
from lumora.plans.sizing import cut_lineage, join_on


def loess(df: DataFrame, pos: str, value: str, span: int, keys: Sequence[str], n: Column, out: str, small: bool | None = None) -> DataFrame:
    """Local linear fit (tricube weights, `span` nearest places) at every row; rows without a value are only predicted.

    On contiguous places the distance to the farthest of the nearest points follows from the place and the
    length `n`, so each fit needs only rows within `span` places.
    """
    half = (span - 1) // 2
    count = F.least(F.lit(span), n)
    p = F.col(pos)
    far = F.greatest(F.lit(half), count - 1 - p, count - 1 - (n - 1 - p)).cast("double")
    far = F.when(n < span, F.greatest(p, n - 1 - p).cast("double") + F.floor((F.lit(span) - n) / 2)).otherwise(far)

    def make(w):
        rows = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))).over(w.rowsBetween(-span, span))
        return {"_rows": rows, "_far": far}

    windowed = sliding(df, pos, span, span, make, keys, small)
    d = lambda r: (r["p"] - F.col(pos)).cast("double")

    def weight(r: Column) -> Column:
        u = F.abs(d(r)) / F.col("_far")
        cube = 1 - u * u * u
        return F.when(u <= 0.001, 1.0).when(u <= 0.999, cube * cube * cube).otherwise(0.0)

    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("s0", "s1", "s2", "t0", "t1")])
    weighted = F.transform("_rows", lambda r: F.struct(d(r).alias("d"), r["v"].alias("v"), weight(r).alias("w")))
    sums = F.aggregate(weighted, zero, lambda a, r: F.struct(
        (a["s0"] + r["w"]).alias("s0"), (a["s1"] + r["w"] * r["d"]).alias("s1"), (a["s2"] + r["w"] * r["d"] * r["d"]).alias("s2"),
        (a["t0"] + r["w"] * r["v"]).alias("t0"), (a["t1"] + r["w"] * r["d"] * r["v"]).alias("t1")))
    s = F.col("_sums")
    det = s["s0"] * s["s2"] - s["s1"] * s["s1"]
    fit = F.when(F.abs(det) > 1e-9 * s["s0"] * s["s0"], (s["s2"] * s["t0"] - s["s1"] * s["t1"]) / det).otherwise(F.try_divide(s["t0"], s["s0"]))
    return windowed.withColumn("_sums", sums).withColumn(out, fit).drop("_rows", "_far", "_sums")


def _odd(x: float) -> int:
    k = math.ceil(x)
    return k if k % 2 else k + 1


def stl_decompose(df: DataFrame, ts: str, value: str, period: int, keys: Sequence[str] = (), seasonal: int = 7, rounds: int = 2) -> DataFrame:
    """Trend, seasonal and residual by the published procedure (Cleveland et al. 1990), all series at once.

    Each round smooths the phases of the cycle, filters them to remove trend, and smooths the deseasonalised
    values; every step is a sliding window, so one long series is as parallel as many short ones.
    """
    keys = list(keys)
    m = period
    low_span, trend_span = _odd(m), _odd(1.5 * m / (1 - 1.5 / seasonal))
    placed, small = positions(df.select(*keys, ts, F.col(value).cast("double").alias("_y")), ts, keys)
    sizes = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    base = cut_lineage(_attach(placed, sizes, keys))
    state = base.withColumn("_trend", F.lit(0.0))
    n = F.col("_n")
    for _ in range(rounds):
        phase, cycle = F.pmod(F.col("_pos"), F.lit(m)), F.floor(F.col("_pos") / m)
        length = F.floor((n - 1 - F.pmod(F.col("_pos"), F.lit(m))) / m) + 1
        cells = state.select(*keys, "_n", phase.alias("_phase"), cycle.alias("_cycle"), length.alias("_len"), (F.col("_y") - F.col("_trend")).alias("_d"))
        heads = state.where(F.col("_pos") < m).select(*keys, "_n", F.col("_pos").alias("_phase"), length.alias("_len"))
        ends = heads.select(*keys, "_n", "_phase", F.explode(F.array(F.lit(-1).cast("long"), F.col("_len"))).alias("_cycle"), "_len", F.lit(None).cast("double").alias("_d"))
        cycles = cells.unionByName(ends)
        smooth = loess(cycles, "_cycle", "_d", seasonal, [*keys, "_phase"], F.col("_len"), "_c", small)
        # the smoothed phases cover one period before and after the series
        extended = smooth.select(*keys, "_n", (F.col("_cycle") * m + F.col("_phase") + m).alias("_e"), "_c")

        def average(frame: DataFrame, source: str, width: int, out: str) -> DataFrame:
            return sliding(frame, "_e", 0, width - 1, lambda w: {out: F.avg(source).over(w.rowsBetween(0, width - 1))}, keys, small)

        filtered = average(average(average(extended, "_c", m, "_m1"), "_m1", m, "_m2"), "_m2", 3, "_m3")
        lows = filtered.where(F.col("_e") < n).select(*keys, F.col("_e").alias("_pos"), F.col("_m3"), "_n")
        low = loess(lows, "_pos", "_m3", low_span, keys, n, "_low", small).select(*keys, "_pos", "_low")
        cyc = filtered.where((F.col("_e") >= m) & (F.col("_e") < n + m)).select(*keys, (F.col("_e") - m).alias("_pos"), "_c")
        joined = join_on(join_on(base, cyc, [*keys, "_pos"]), low, [*keys, "_pos"]).withColumn("_s", F.col("_c") - F.col("_low"))
        again = joined.drop("_c", "_low").withColumn("_x", F.col("_y") - F.col("_s"))
        state = cut_lineage(loess(again, "_pos", "_x", trend_span, keys, n, "_trend", small).withColumnRenamed("_s", "_season").drop("_x"))
        final = state
        state = state.drop("_season")
    return final.select(
        *keys, ts, F.col("_y").alias(value), F.col("_trend").alias("trend"), F.col("_season").alias("seasonal"),
        (F.col("_y") - F.col("_trend") - F.col("_season")).alias("residual"))


# ---------------------------------------------------------------- change points

def change_points_window(df: DataFrame, ts: str, value: str, width: int = 40, most: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, position, ts, gain): largest local peaks of the mean-shift discrepancy between the two half windows."""
    keys = list(keys)
    h = width // 2
    placed, small = positions(df.select(*keys, ts, F.col(value).cast("double").alias("_y")), ts, keys)

    def make(w):
        left, right = w.rowsBetween(-h, -1), w.rowsBetween(0, h - 1)
        full = (F.count("_y").over(left) == h) & (F.count("_y").over(right) == h)
        gap = F.avg("_y").over(left) - F.avg("_y").over(right)
        return {"gain": F.when(full, gap * gap * (h / 2.0))}

    gained = sliding(placed, "_pos", h, h, make, keys, small)
    peaked = sliding(gained, "_pos", h, h, lambda w: {"_top": F.max("gain").over(w.rowsBetween(-h, h))}, keys, small)
    peaks = peaked.where(F.col("gain").isNotNull() & (F.col("gain") == F.col("_top")) & (F.col("gain") > 0))
    from lumora.operators.relational import rank_within

    top = rank_within(peaks.withColumn("_all", F.lit(0)), keys or ["_all"], [F.desc("gain"), F.col("_pos")], most)
    return top.select(*keys, F.col("_pos").alias("position"), ts, "gain")


#: Break points lie on a grid of JUMP rows at any length. The search sees MAX_BLOCKS blocks per series; where these are wider
#: than the grid, each break is then placed on the grid, within a block on either side.
MAX_BLOCKS = 2000
JUMP = 5


def _refined(f: np.ndarray, c: np.ndarray, jump: int, found: list[int], fine: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], min_size: int) -> list[int]:
    """Positions on the fine grid for coarse breaks (block numbers), one after the other.

    `f` and `c` are running sums of features and rows over coarse blocks; `fine` has, per break, starts, features and
    rows of the fine blocks on either side of it.
    """
    out: list[int] = []
    before_f, before_c = np.zeros(f.shape[1]), 0.0
    for i, b in enumerate(found):
        end = found[i + 1] if i + 1 < len(found) else len(c) - 1
        starts, features, rows = fine[b]
        low = max(b - 1, 0)
        # running sums up to each fine start, and those of the whole next segment
        at_f = f[low] + np.vstack([np.zeros(f.shape[1]), np.cumsum(features, axis=0)[:-1]])
        at_c = c[low] + np.concatenate([[0.0], np.cumsum(rows)[:-1]])
        left_f, left_c, right_f, right_c = at_f - before_f, at_c - before_c, f[end] - at_f, c[end] - at_c
        open_ = (left_c >= min_size) & (right_c >= min_size)
        cost = left_c - (left_f**2).sum(axis=1) / np.maximum(left_c, 1) + right_c - (right_f**2).sum(axis=1) / np.maximum(right_c, 1)
        k = int(np.where(open_, cost, np.inf).argmin()) if open_.any() else int(np.abs(starts - b * jump).argmin())
        out.append(int(starts[k]))
        before_f, before_c = at_f[k], at_c[k]
    return out


def _segments(total: np.ndarray, sizes: np.ndarray, method: str, breaks: int, penalty: float, min_blocks: int) -> list[int]:
    """Break points (block numbers) that minimise the kernel cost Σ (len − ‖Σφ‖²/len)."""
    f = np.vstack([np.zeros(total.shape[1]), np.cumsum(total, axis=0)])
    c = np.concatenate([[0.0], np.cumsum(sizes)])
    b = len(sizes)

    def cost(s, t):
        length = c[t] - c[s]
        gap = f[t] - f[s]
        return length - (gap * gap).sum(axis=-1) / np.where(length > 0, length, 1)

    if method == "pelt":
        best = np.full(b + 1, np.inf)
        best[0], back, open_starts = -penalty, np.zeros(b + 1, dtype=int), [0]
        for t in range(min_blocks, b + 1):
            starts = np.array([s for s in open_starts if t - s >= min_blocks])
            values = best[starts] + cost(starts, t) + penalty
            i = int(values.argmin())
            best[t], back[t] = values[i], starts[i]
            keep = set(starts[values <= best[t] + penalty].tolist())
            open_starts = [s for s in open_starts if s in keep or t - s < min_blocks] + ([t - min_blocks + 1] if t - min_blocks + 1 >= min_blocks else [])
        out, t = [], b
        while t > 0:
            t = int(back[t])
            if t > 0:
                out.append(t)
        return sorted(set(out))
    if method == "binseg":
        cuts = [0, b]
        for _ in range(breaks):
            found = None
            for s, t in zip(cuts, cuts[1:]):
                at = np.arange(s + min_blocks, t - min_blocks + 1)
                if len(at) == 0:
                    continue
                gains = cost(s, t) - cost(np.full(len(at), s), at) - cost(at, np.full(len(at), t))
                i = int(gains.argmax())
                if found is None or gains[i] > found[0]:
                    found = (float(gains[i]), int(at[i]))
            if found is None:
                break
            cuts = sorted([*cuts, found[1]])
        return cuts[1:-1]
    cuts = list(range(0, b, min_blocks)) + [b]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < min_blocks:
        cuts.pop(-2)
    while len(cuts) - 2 > breaks:
        s, m, t = np.array(cuts[:-2]), np.array(cuts[1:-1]), np.array(cuts[2:])
        cuts.pop(1 + int((cost(s, t) - cost(s, m) - cost(m, t)).argmin()))
    return cuts[1:-1]


def change_points(
    df: DataFrame, ts: str, value: str, methods: Sequence[str] = ("pelt", "binseg", "bottomup"), keys: Sequence[str] = (),
    breaks: int = 5, penalty: float = 10.0, min_size: int = 10, nodes: int = 32
) -> DataFrame:
    """(keys…, method, position): segmentation by the Gaussian-kernel cost.

    The kernel is written as a short sum of cosines (Gauss–Hermite quadrature), so the cost of any segment needs only
    sums of these features. Spark sums them per block of rows; the search sees at most MAX_BLOCKS blocks per series, and a
    second pass sums only the rows around the breaks of longer series again, on the grid of JUMP rows.
    """
    keys = list(keys)
    base = df.select(*keys, ts, F.col(value).cast("double").alias("_y")).where(F.col("_y").isNotNull())
    placed, _ = positions(base, ts, keys)
    stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop("_y").alias("_s"), F.avg("_y").alias("_m"))
    # squared gaps of independent normal values have median 2σ² times the median of χ² with one degree of freedom
    stats = stats.select(*keys, "_n", "_m", (JUMP * F.greatest(F.lit(1), F.ceil(F.col("_n") / (MAX_BLOCKS * JUMP)))).cast("long").alias("_jump"),
                         F.coalesce(F.try_divide(F.lit(1.0), 2 * 0.454936423119572 * F.col("_s") * F.col("_s")), F.lit(1.0)).alias("_gamma"))
    t, w = np.polynomial.hermite.hermgauss(nodes)
    half = t > 0
    freq, weight = 2 * t[half], 2 * w[half] / math.sqrt(math.pi)
    x = (F.col("_y") - F.col("_m")) * F.sqrt("_gamma")
    features = [fn(F.lit(float(k)) * x) * math.sqrt(float(v)) for k, v in zip(freq, weight) for fn in (F.cos, F.sin)]
    measured = _attach(placed, stats, keys).withColumn("_block", F.floor(F.col("_pos") / F.col("_jump")))
    names = [f"_f{i}" for i in range(len(features))]
    sums = measured.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_c"), F.max("_jump").alias("_jump"), *[F.sum(e).alias(n) for n, e in zip(names, features)])
    packed = cut_lineage(sums.select(*keys, "_block", "_c", "_jump", F.array(*names).alias("_f")))
    blocks = packed.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods])))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        part = pdf.sort_values("_block")
        jump = int(part["_jump"].iloc[0])
        found = _segments(np.stack(part["_f"].to_numpy()).astype(float), part["_c"].to_numpy(dtype=float), part["method"].iloc[0],
                          breaks, penalty, max(1, math.ceil(min_size / jump)))
        out = pd.DataFrame({"method": part["method"].iloc[0], "position": [int(b) * jump for b in found], "jump": jump})
        for k in keys:
            out[k] = part[k].iloc[0]
        return out[[*keys, "method", "position", "jump"]]

    coarse = cut_lineage(blocks.groupBy(*keys, "method").applyInPandas(search, f"{_fields(df, keys)}method string, position long, jump long"))
    if not coarse.where(F.col("jump") > JUMP).limit(1).count():
        return coarse.drop("jump")
    near = coarse.where(F.col("jump") > JUMP).select(*keys, "method", (F.col("position") / F.col("jump")).cast("long").alias("_at"))
    near = near.withColumn("_block", F.explode(F.array(F.col("_at") - 1, F.col("_at"))))
    around = join_on(measured, near, [*keys, "_block"]).withColumn("_start", F.floor(F.col("_pos") / JUMP) * JUMP)
    fine = around.groupBy(*keys, "method", "_at", "_start").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(e).alias(n) for n, e in zip(names, features)])
    fine = fine.select(*keys, "method", "_at", "_start", "_c", F.array(*names).alias("_f"))

    def refine(whole: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if whole.empty or parts.empty:
            return pd.DataFrame({n: [] for n in [*keys, "method", "position"]})
        whole = whole.sort_values("_block")
        jump = int(whole["_jump"].iloc[0])
        total = np.stack(whole["_f"].to_numpy()).astype(float)
        f = np.vstack([np.zeros(total.shape[1]), np.cumsum(total, axis=0)])
        c = np.concatenate([[0.0], np.cumsum(whole["_c"].to_numpy(dtype=float))])
        own = {}
        for b, rows in parts.groupby("_at"):
            rows = rows.sort_values("_start")
            own[int(b)] = (rows["_start"].to_numpy(), np.stack(rows["_f"].to_numpy()).astype(float), rows["_c"].to_numpy(dtype=float))
        out = pd.DataFrame({"method": whole["method"].iloc[0], "position": _refined(f, c, jump, sorted(own), own, min_size)})
        for k in keys:
            out[k] = whole[k].iloc[0]
        return out[[*keys, "method", "position"]]

    by = [*keys, "method"]
    placed_again = blocks.groupBy(*by).cogroup(fine.groupBy(*by)).applyInPandas(refine, f"{_fields(df, keys)}method string, position long")
    return coarse.where(F.col("jump") <= JUMP).drop("jump").unionByName(placed_again)

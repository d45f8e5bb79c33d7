"""Anomalies in series, exact and without pairing rows: neighbours in value order are neighbours in position."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumora.operators.timeseries import _attach
from lumora.plans.order import ordered_index, sliding
from lumora.plans.quantiles import quantiles
from lumora.plans.sizing import cut_lineage, is_small


def anomalies_z(df: DataFrame, value: str, threshold: float = 3.0, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with |z| above the threshold (sample deviation), per key."""
    m = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.abs(F.try_divide(F.col(value) - F.col("_m"), F.col("_s")))
    return _attach(df, m, keys).where(z > threshold).select(*df.columns)


def anomalies_iqr(df: DataFrame, value: str, k: float = 1.5, keys: Sequence[str] = ()) -> DataFrame:
    q = quantiles(df, value, [0.25, 0.75], keys, ["_q1", "_q3"])
    step = k * (F.col("_q3") - F.col("_q1"))
    x = F.col(value)
    return _attach(df, q, keys).where((x < F.col("_q1") - step) | (x > F.col("_q3") + step)).select(*df.columns)


def _by_value(df: DataFrame, value: str, keys: Sequence[str], tie: Sequence[str]) -> tuple[DataFrame, bool]:
    """Values `_x`, standardised `_z` (population deviation `_s`), with positions in value order."""
    keys = list(keys)
    base = df.where(F.col(value).isNotNull())
    m = base.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))
    scored = _attach(base, m, keys).withColumn("_z", F.coalesce(z, F.lit(0.0)))
    scored = scored.withColumn("_x", F.col(value).cast("double")).drop("_m")
    scored = cut_lineage(scored)
    small = is_small(scored)
    return ordered_index(scored, ["_x", *tie], keys, small=small), small


def anomalies_dbscan(
    df: DataFrame, value: str, tie: Sequence[str], eps: float = 0.5, min_pts: int = 5, keys: Sequence[str] = ()
) -> DataFrame:
    """Noise points of one-dimensional DBSCAN on standardised values.

    If at least `min_pts` values lie within eps of a value, `min_pts` of them are at most `min_pts − 1` places
    away in value order; a value that is not core has fewer neighbours still. Both tests need only that reach.
    """
    keys = list(keys)
    placed, small = _by_value(df, value, keys, tie)
    reach = min_pts - 1

    def core(w):
        near = F.lit(1)
        for k in range(1, reach + 1):
            back, ahead = F.col("_z") - F.lag("_z", k).over(w), F.lead("_z", k).over(w) - F.col("_z")
            near = near + F.coalesce((back <= eps).cast("int"), F.lit(0)) + F.coalesce((ahead <= eps).cast("int"), F.lit(0))
        return {"_core": near >= min_pts}

    flagged = sliding(placed, "_pos", reach, reach, core, keys, small)

    def reached(w):
        hit = F.lit(False)
        for k in range(1, reach + 1):
            for move, sign in ((F.lag, 1), (F.lead, -1)):
                gap = (F.col("_z") - move("_z", k).over(w)) * sign
                hit = hit | F.coalesce(move("_core", k).over(w) & (gap <= eps), F.lit(False))
        return {"_reached": hit}

    marked = sliding(flagged, "_pos", reach, reach, reached, keys, small)
    return marked.where(~F.col("_core") & ~F.col("_reached")).select(*df.columns)


def lof_scores(df: DataFrame, value: str, tie: Sequence[str], k: int = 20, keys: Sequence[str] = ()) -> DataFrame:
    """One-dimensional local outlier factor: the k nearest values are within k places in value order."""
    keys = list(keys)
    placed, small = _by_value(df, value, keys, tie)

    def nearest(w, extra: Sequence[str]) -> Column:
        """The k nearest rows as structs (standardised distance, extra…), the row itself left out.

        Ranked by the unscaled gap, which does not depend on how sums were rounded; ties by place.
        """
        frame = w.rowsBetween(-k, k)
        rows = F.collect_list(F.struct("_x", "_pos", *extra)).over(frame)
        others = F.filter(rows, lambda r: r["_pos"] != F.col("_pos"))
        ranked = F.array_sort(F.transform(others, lambda r: F.struct(F.abs(r["_x"] - F.col("_x")).alias("gap"), r["_pos"].alias("p"), *[r[e].alias(e) for e in extra])))
        scale = F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
        return F.transform(F.slice(ranked, 1, k), lambda r: F.struct((r["gap"] / scale).alias("d"), *[r[e].alias(e) for e in extra]))

    def mean(items: Column, of) -> Column:
        return F.try_divide(F.aggregate(items, F.lit(0.0), lambda a, r: a + of(r)), F.size(items))

    def step(frame_df: DataFrame, extra: Sequence[str], name: str, formula) -> DataFrame:
        near = sliding(frame_df, "_pos", k, k, lambda w: {"_near": nearest(w, extra)}, keys, small)
        return near.withColumn(name, formula(F.col("_near"))).drop("_near")

    one = step(placed, [], "_kdist", lambda near: F.element_at(near, -1)["d"])
    two = step(one, ["_kdist"], "_lrd", lambda near: 1 / (mean(near, lambda r: F.greatest(r["d"], r["_kdist"])) + F.lit(1e-10)))
    three = step(two, ["_lrd"], "_mean", lambda near: mean(near, lambda r: r["_lrd"]))
    return three.select(*df.columns, (F.col("_mean") / F.col("_lrd")).alias("lof"))


def anomalies_lof(df: DataFrame, value: str, tie: Sequence[str], k: int = 20, contamination: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    scored = cut_lineage(lof_scores(df, value, tie, k, keys))  # read twice: for the cut and for the rows
    cut = quantiles(scored, "lof", [1 - contamination], keys, ["_cut"])
    return _attach(scored, cut, keys).where(F.col("lof") > F.col("_cut")).select(*df.columns, "lof")


def anomaly_table(flags: dict[str, DataFrame], cols: Sequence[str]) -> DataFrame:
    """Long table of flagged rows: (cols…, method)."""
    return reduce(DataFrame.unionByName, [f.select(*cols, F.lit(m).alias("method")) for m, f in flags.items()])


def anomaly_summary(df: DataFrame, flags: dict[str, DataFrame]) -> DataFrame:
    """(method, anomalies, pct): count and share of all rows per method."""
    total = df.count()
    asked = df.sparkSession.createDataFrame([(m,) for m in flags], "method string")
    counts = anomaly_table(flags, []).groupBy("method").agg(F.count(F.lit(1)).alias("anomalies"))
    return asked.join(F.broadcast(counts), "method", "left").select(
        "method", F.coalesce("anomalies", F.lit(0)).alias("anomalies"), (F.coalesce("anomalies", F.lit(0)) * 100.0 / F.lit(max(total, 1))).alias("pct"))

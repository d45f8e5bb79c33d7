"""Exact linear-interpolated quantiles.

Small inputs use the built-in `percentile`, which keeps the distinct values of a group in one buffer.
Larger ones take two passes: a sketch with a guaranteed rank error brackets every quantile, then values are
counted (combined before the shuffle): those below a bracket as one number, those inside it one by one.
About one row in a hundred per quantile is shuffled and ranked by a running sum. If a bracket missed its
rank, all values are ranked instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumora.plans.order import running_sums
from lumora.plans.sizing import PERCENTILE_ROWS, broadcast_if_small, cut_lineage, is_small, join_on, small_rows


def to_long(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """(ids…, variable, value double) without nulls."""
    cast = df.select(*[F.col(f"`{c}`") for c in ids], *[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    return cast.unpivot(list(ids), list(cols), "variable", "value").where(F.col("value").isNotNull())


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    names: Sequence[str] | None = None,
    small: bool | None = None,
) -> DataFrame:
    """One row per `keys` with one column per probability (nulls in `value` ignored)."""
    keys = list(keys)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    present = df.select(*keys, F.col(f"`{value}`").cast("double").alias("_v")).where(F.col("_v").isNotNull())
    small = is_small(present, PERCENTILE_ROWS) if small is None else small
    if small:
        arr = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("_q")
        rows = present.groupBy(*keys).agg(arr)
        return rows.select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])

    found = cut_lineage(_bracketed(present, probs, keys))
    missed = reduce(lambda x, y: x | y, [F.col(f"_{t}{i}").isNull() for i in range(len(probs)) for t in ("lo", "hi")])
    if found.where(missed).limit(1).count():
        found = _ranked(present, probs, keys)
    return found.select(
        *keys,
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(n)
            for i, n in enumerate(names)
        ],
    )


#: Accuracy of the bracketing sketch: its rank error is at most 1/ACCURACY of the rows.
ACCURACY = 500


def _picks(probs: Sequence[float], only: bool) -> list[Column]:
    """Values that hold the lower and upper rank of each probability, and the interpolation weight."""
    out = []
    for i, p in enumerate(probs):
        rank = (F.col("_n") - 1) * F.lit(float(p))
        mine = F.col("_p") == i if only else F.lit(True)
        for tag, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            holds = mine & (F.col("_cum") - F.col("_c") <= at) & (at < F.col("_cum"))
            out.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{tag}{i}"))
        out.append(F.max(rank - F.floor(rank)).alias(f"_f{i}"))
    return out


def _with_row(df: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        return join_on(df, broadcast_if_small(per_key), keys)
    one = F.broadcast(per_key.withColumn("_j", F.lit(1)))  # a global aggregate: one row
    return df.withColumn("_j", F.lit(1)).join(one, "_j").drop("_j")


def _bracketed(present: DataFrame, probs: Sequence[float], keys: list[str]) -> DataFrame:
    step = 2.0 / ACCURACY
    edges = [e for p in probs for e in (max(0.0, p - step), min(1.0, p + step))]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), F.lit(ACCURACY)).alias("_b")
    facts = cut_lineage(present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), sketch))
    joined = _with_row(present, facts.select(*keys, "_b"), keys)
    spread = joined.select(*keys, "_v", "_b", F.explode(F.array(*[F.lit(i) for i in range(len(probs))])).alias("_p"))
    low, high = F.col("_b")[F.col("_p") * 2], F.col("_b")[F.col("_p") * 2 + 1]
    marked = spread.where(F.col("_v") <= high).select(*keys, "_p", F.when(F.col("_v") >= low, F.col("_v")).alias("_v"))
    counts = marked.groupBy(*keys, "_p", "_v").agg(F.count(F.lit(1)).alias("_c"))
    # nulls sort first: the rows below a bracket come as one count before its values
    ranked = running_sums(counts, {"_cum": F.col("_c")}, ["_v"], [*keys, "_p"])
    return _with_row(ranked, facts.select(*keys, "_n"), keys).groupBy(*keys).agg(*_picks(probs, True))


def _ranked(present: DataFrame, probs: Sequence[float], keys: list[str]) -> DataFrame:
    counts = cut_lineage(present.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    ranked = running_sums(counts, {"_cum": F.col("_c")}, ["_v"], keys, small=False)
    sizes = present.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return _with_row(ranked, sizes, keys).groupBy(*keys).agg(*_picks(probs, False))


def column_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str] | None = None,
    small: bool | None = None,
) -> DataFrame:
    """(variable, quantile columns…) for several columns in one pass."""
    cols = list(cols)
    small = df.count() * len(cols) <= small_rows(df.sparkSession, PERCENTILE_ROWS) if small is None else small
    if small:
        names = list(names or [f"q{int(round(p * 100))}" for p in probs])
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        wide = df.agg(*[F.percentile(F.col(f"`{c}`").cast("double"), wanted).alias(f"q{i}") for i, c in enumerate(cols)])
        rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"q{i}").alias("q")) for i, c in enumerate(cols)])
        stacked = wide.select(F.explode(rows).alias("_e")).where(F.col("_e.q").isNotNull())
        return stacked.select("_e.variable", *[F.col("_e.q")[i].alias(n) for i, n in enumerate(names)])
    return quantiles(to_long(df, cols), "value", probs, ["variable"], names, small)


def quantile_values(df: DataFrame, value: str, probs: Sequence[float], small: bool | None = None) -> list[float]:
    """The quantiles of one column as numbers (one row reaches the driver)."""
    names = [f"p{i}" for i in range(len(probs))]
    row = quantiles(df, value, probs, names=names, small=small).first()
    return [row[n] for n in names] if row else [None] * len(names)

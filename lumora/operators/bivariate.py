"""Two-variable statistics from pair counts and sums; only one-row or one-per-level results are joined back."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lumora.functions.numeric import chi2_p, f_p, normal_p, t_p
from lumora.operators.relational import every_kth, numeric_names
from lumora.operators.univariate import box_stats
from lumora.plans.order import ordered_index, running_sums
from lumora.plans.sizing import broadcast_if_small, cut_lineage, join_on

#: Normal quantile of a 95 % interval.
Z95 = 1.959963984540054


def _x(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def _pair(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(_x(x).alias("x"), _x(y).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())


def _with_test(row: DataFrame, r: str, name: str) -> DataFrame:
    """p by the t form of a correlation and the Fisher 95 % interval (n > 3)."""
    n, c = F.col("n").cast("double"), F.col(r)
    t = c * F.sqrt((n - 2) / F.greatest(F.lit(1e-300), 1 - c * c))
    p = F.when(F.abs(c) >= 1, F.lit(0.0)).otherwise(t_p(t, n - 2))
    half = F.when((n > 3) & (F.abs(c) < 1), F.lit(Z95) / F.sqrt(n - 3))
    return row.select(
        F.lit(name).alias("method"), "n", c.alias("statistic"), p.alias("p_value"),
        F.tanh(F.atanh(c) - half).alias("ci_low"), F.tanh(F.atanh(c) + half).alias("ci_high"),
        (p < 0.05).alias("significant"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    row = _pair(df, x, y).agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"))
    return _with_test(row, "r", "pearson")


def average_ranks(counts: DataFrame, value: str) -> DataFrame:
    """(value, rank) with ties averaged; `counts` has one row per value with its count `c`."""
    cum = running_sums(counts, {"_cum": F.col("c")}, [value])
    return cum.select(value, (F.col("_cum") - (F.col("c") - 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation. Rows collapse to pair counts; ranks come from a distributed running sum."""
    pairs = cut_lineage(_pair(df, x, y).groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")))
    n = pairs.agg(F.sum("c")).first()[0] or 0
    ranked = pairs
    for v in ("x", "y"):
        counts = pairs.groupBy(v).agg(F.sum("c").alias("c"))
        ranks = average_ranks(counts, v).select(F.col(v).alias(f"_{v}"), (F.col("rank") - (n + 1) / 2.0).alias(f"r{v}"))
        ranked = ranked.join(broadcast_if_small(ranks), F.col(v) == F.col(f"_{v}"))
    c, rx, ry = F.col("c"), F.col("rx"), F.col("ry")
    rho = F.try_divide(F.sum(c * rx * ry), F.sqrt(F.sum(c * rx * rx) * F.sum(c * ry * ry)))
    return _with_test(ranked.agg(F.sum("c").alias("n"), rho.alias("r")), "r", "spearman")


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """τ-b without comparing pairs."""
    return kendall_pairs(df, [(x, y)]).select("method", "n", "statistic", "p_value")


def kendall_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, method, n, statistic, p_value): τ-b of any number of column pairs in one plan; `pair` is the place in the list.

    Two y ranks first differ at one bit. Within each (bit, higher bits) group, ordered by x, the pairs with
    the set bit before the clear bit are the discordant ones, so one running sum counts them all:
    rows × log2(distinct y), however the values are spread. Rows without one of the two values don't count for a pair.
    """
    sides = F.array(*[F.struct(F.lit(i).alias("pair"), _x(x).alias("x"), _x(y).alias("y")) for i, (x, y) in enumerate(pairs)])
    long = df.select(F.inline(sides)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    counted = cut_lineage(long.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("c")))
    ranks = cut_lineage(ordered_index(counted.select("pair", "y").distinct(), ["y"], ["pair"], out="yr"))
    size = (ranks.agg(F.max("yr")).first()[0] or 0) + 1
    ranks = broadcast_if_small(ranks.select(F.col("pair").alias("_pair"), F.col("y").alias("_y"), "yr"))
    coded = counted.join(ranks, (F.col("pair") == F.col("_pair")) & (F.col("y") == F.col("_y"))).select("pair", "x", "y", "yr", "c")
    bits = max(1, math.ceil(math.log2(max(size, 2))))
    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit")
    spread = coded.select("pair", "x", "yr", "c", level).select(
        "pair", "x", "c", "bit", F.expr("shiftright(yr, bit + 1)").alias("prefix"), F.expr("shiftright(yr, bit) & 1").alias("set"))
    merged = spread.groupBy("pair", "bit", "prefix", "x", "set").agg(F.sum("c").alias("c"))
    cum = running_sums(merged, {"before": F.col("c") * F.col("set")}, ["x", "set"], ["pair", "bit", "prefix"])
    discordant = cum.groupBy("pair").agg(F.coalesce(F.sum(F.when(F.col("set") == 0, F.col("c") * F.col("before"))), F.lit(0.0)).alias("d"))

    def ties(col: str) -> DataFrame:
        t = F.col("t")
        g = counted.groupBy("pair", col).agg(F.sum("c").alias("t"))
        return g.groupBy("pair").agg(F.sum(t * (t - 1)).alias(f"{col}1"), F.sum(t * (t - 1) * (t - 2)).alias(f"{col}2"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{col}3"))

    joint = counted.groupBy("pair").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("xy1"))
    row = reduce(lambda a, b: a.join(F.broadcast(b), "pair"), (joint, ties("x"), ties("y"), discordant))  # a row per column pair
    n, d = F.col("n"), F.col("d")
    m = n * (n - 1)
    score = (m - F.col("x1") - F.col("y1") + F.col("xy1")) / 2 - 2 * d
    tau = F.try_divide(2 * score, F.sqrt((m - F.col("x1")) * (m - F.col("y1"))))
    var = (m * (2 * n + 5) - F.col("x3") - F.col("y3")) / 18 + F.col("x1") * F.col("y1") / (2 * m) + F.col("x2") * F.col("y2") / (9 * m * (n - 2))
    return row.where("n > 2").select(
        "pair", F.lit("kendall").alias("method"), n.cast("long").alias("n"), tau.alias("statistic"), normal_p(score / F.sqrt(var)).alias("p_value"))


# ---------------------------------------------------------------- correlation tables

def _moment_parts(df: DataFrame, cols: list[str], centres: list[float]) -> DataFrame:
    """Pairwise sums per Arrow batch by matrix products: (i, j, n, x, y, xx, yy, xy), one row per pair and task batch.

    Values are centred first, so that the sums lose no digits; a missing value counts as 0 with weight 0.
    """
    k = len(cols)
    at = [(i, j) for i in range(k) for j in range(i + 1)]
    rows, cs = np.array([i for i, _ in at]), np.array([j for _, j in at])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, k, k))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - np.array(centres)
            mask = ~np.isnan(x)
            m = mask.astype(float)
            x = np.where(mask, x, 0.0)
            sums, squares = x.T @ m, (x * x).T @ m
            total += np.stack([m.T @ m, sums, sums.T, squares, squares.T, x.T @ x])
        yield pd.DataFrame({"i": rows, "j": cs, **{n: total[a][rows, cs] for a, n in enumerate(("n", "x", "y", "xx", "yy", "xy"))}})

    numbers = df.select(*[_x(c).alias(c) for c in cols])
    return numbers.mapInPandas(run, "i int, j int, n double, x double, y double, xx double, yy double, xy double")


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None, lower_only: bool = False) -> DataFrame:
    """(var1, var2, r, n): pairwise-complete Pearson correlations from one pass of matrix products, whatever the width."""
    cols = list(cols or numeric_names(df))
    centre = df.agg(*[F.avg(_x(c)) for c in cols]).first()
    parts = _moment_parts(df, cols, [float(v or 0.0) for v in centre])
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.col("n")
    cov = F.col("xy") - F.col("x") * F.col("y") / n
    spread = F.sqrt((F.col("xx") - F.col("x") * F.col("x") / n) * (F.col("yy") - F.col("y") * F.col("y") / n))
    same = F.col("i") == F.col("j")
    r = F.when(same & (spread > 0), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, spread))))
    names = F.array(*[F.lit(c) for c in cols])
    base = s.where(n > 0).select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), r.alias("r"), n.cast("long").alias("n"), same.alias("same"))
    both = F.array(F.struct(F.col("a").alias("var1"), F.col("b").alias("var2")), *([] if lower_only else [F.struct(F.col("b").alias("var1"), F.col("a").alias("var2"))]))
    pairs = F.when(F.col("same"), F.slice(both, 1, 1)).otherwise(both)
    return base.select(F.explode(pairs).alias("_p"), "r", "n").select("_p.var1", "_p.var2", "r", "n")


#: Ranks of columns with no more values than this are looked up where the rows are, for so many columns at most.
LOOKUP_VALUES, MOST_LOOKUPS = 100_000, 24


def _rank_columns(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[tuple[str, str], str]]:
    """Average ranks of all columns, side by side, from one long pass, and the rank column of a variable beside another.

    Ranks count only rows where both variables of a pair are present. A variable has one rank column beside all partners without
    gaps, and one more per partner that has gaps. Only columns of many values are shuffled for their ranks.
    """
    present = df.agg(F.count(F.lit(1)), *[F.count(_x(c)) for c in cols]).first()
    whole = {c for c, n in zip(cols, present[1:]) if n == present[0]}
    place: dict[tuple[str, str | None], int] = {}
    beside = {}
    for a in cols:
        for b in cols:
            if a != b:
                beside[a, b] = "r{}".format(place.setdefault((a, None if b in whole else b), len(place)))
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), (_x(a) if b is None else F.when(_x(b).isNotNull(), _x(a))).alias("v")) for (a, b), i in place.items()])
    rows = cut_lineage(df.select(F.monotonically_increasing_id().alias("_row"), slots.alias("_s")))  # numbers must outlive a lost executor
    long = rows.select("_row", F.inline("_s")).where("v is not null")
    counts = cut_lineage(long.groupBy("slot", "v").agg(F.count(F.lit(1)).alias("c")))
    sizes = counts.groupBy("slot").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("values")).orderBy("values", "slot").collect()  # a row per rank column
    totals = {r["slot"]: r["n"] for r in sizes}
    cum = running_sums(counts, {"_cum": F.col("c")}, ["v"], ["slot"])
    ranks = cut_lineage(cum.select(F.col("slot").alias("_slot"), F.col("v").alias("_v"), (F.col("_cum") - (F.col("c") - 1) / 2.0).alias("rank")))
    few = [r["slot"] for r in sizes[:MOST_LOOKUPS] if r["values"] <= LOOKUP_VALUES]
    for i in few:
        known = F.broadcast(ranks.where(F.col("_slot") == i).select("_v", F.col("rank").alias(f"_r{i}")))
        rows = rows.join(known, F.col("_s")[i]["v"] == F.col("_v"), "left").drop("_v")
    centred = {i: -(totals.get(i, 0) + 1) / 2.0 for i in place.values()}
    if len(few) == len(place):
        return rows.select("_row", *[(F.col(f"_r{i}") + centred[i]).alias(f"r{i}") for i in place.values()]), beside
    many = long.where(~F.col("slot").isin(few)) if few else long
    ranked = many.join(broadcast_if_small(ranks.where(~F.col("_slot").isin(few)) if few else ranks), (F.col("slot") == F.col("_slot")) & (F.col("v") == F.col("_v")))
    ranked = ranked.select("_row", "slot", "rank", F.lit(None).cast("array<double>").alias("few"))
    if few:
        ranked = ranked.unionByName(rows.select("_row", F.lit(None).cast("int").alias("slot"), F.lit(None).cast("double").alias("rank"), F.array(*[F.col(f"_r{i}") for i in few]).alias("few")))
    met = ranked.repartition("_row")  # narrow rows move; partial sums would move a whole row of ranks for each
    side = [F.max(F.get("few", F.lit(few.index(i))) if i in few else F.when(F.col("slot") == i, F.col("rank"))) for i in place.values()]
    return met.groupBy("_row").agg(*[(c + centred[i]).alias(f"r{i}") for i, c in zip(place.values(), side)]), beside


def rank_corr_matrix(df: DataFrame, cols: Sequence[str], method: str) -> DataFrame:
    """(var1, var2, r, n) below the diagonal for spearman or kendall: one plan for all pairs, whatever the width."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[:i]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "var1 string, var2 string, r double, n long")
    if method == "kendall":
        names = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2")) for a, b in pairs])
        return kendall_pairs(df, pairs).select(names[F.col("pair")].alias("_p"), F.col("statistic").alias("r"), "n").select("_p.*", "r", "n")
    if method != "spearman":
        raise ValueError(f"no rank correlation {method}")
    ranks, beside = _rank_columns(df, cols)
    table = corr_matrix(ranks, [c for c in ranks.columns if c != "_row"])
    wanted = F.create_map(*[v for a, b in pairs for v in (F.lit(f"{beside[a, b]} {beside[b, a]}"), F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2")))])
    return table.select(wanted[F.concat_ws(" ", "var1", "var2")].alias("_p"), "r", "n").where("_p is not null").select("_p.*", "r", "n")


def _upper(corr: DataFrame, cols: Sequence[str]) -> DataFrame:
    place = F.create_map(*[F.lit(v) for i, c in enumerate(cols) for v in (c, i)])
    return corr.where(place[F.col("var1")] < place[F.col("var2")])


def strong_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.7, top: int | None = None, corr: DataFrame | None = None) -> DataFrame:
    """Pairs above the threshold, strongest first; `corr` reuses a correlation table."""
    r = F.abs("r")
    found = _upper(corr_matrix(df, cols) if corr is None else corr, cols).where(r > threshold).select(
        "var1", "var2", "r", F.when(r > 0.9, "Muy fuerte").otherwise("Fuerte").alias("strength")).orderBy(F.desc(r), "var1", "var2")
    return found.limit(top) if top else found


def most_correlated_pair(df: DataFrame, cols: Sequence[str], corr: DataFrame | None = None) -> DataFrame:
    best = _upper(corr_matrix(df, cols) if corr is None else corr, cols).where(F.col("r").isNotNull()).agg(
        F.max_by(F.struct("var1", "var2", "r"), F.abs("r")).alias("_b"))
    return best.select("_b.*")


def vif_approx(df: DataFrame, cols: Sequence[str], corr: DataFrame | None = None) -> DataFrame:
    """1/(1 − max r²) per variable; infinite from |r| ≥ .99; flagged above 10."""
    best = (corr_matrix(df, cols) if corr is None else corr).where("var1 <> var2").groupBy(F.col("var1").alias("variable")).agg(F.max(F.abs("r")).alias("max_r"))
    vif = F.when(F.col("max_r") < 0.99, 1 / (1 - F.col("max_r") * F.col("max_r"))).otherwise(F.lit(float("inf")))
    return best.select("variable", "max_r", vif.alias("vif"), (vif > 10).alias("high"))


# ---------------------------------------------------------------- regression

def regression_line(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """slope, intercept, r, R², standard error and n, per key."""
    both = df.select(*keys, _x(x).alias("x"), _x(y).alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    s = both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.corr("x", "y").alias("r"), F.regr_sxx("y", "x").alias("_sxx"), F.regr_syy("y", "x").alias("_syy"))
    err = F.sqrt(F.try_divide((1 - F.col("r") * F.col("r")) * F.col("_syy"), F.col("_sxx") * (F.col("n") - 2)))
    return s.select(*keys, "n", "slope", "intercept", "r", (F.col("r") * F.col("r")).alias("r_squared"), err.alias("std_err"))


def linear_regression(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    line = regression_line(df, x, y, keys)
    t = F.try_divide(F.col("slope"), F.col("std_err"))
    return line.withColumn("p_value", t_p(t, (F.col("n") - 2).cast("double")))


def regression_rows(df: DataFrame, x: str, y: str) -> DataFrame:
    """Complete rows with fitted value and residual; the line enters as constants."""
    line = regression_line(df, x, y).first()
    fit = F.lit(line["slope"]) * _x(x) + F.lit(line["intercept"])
    both = df.where(_x(x).isNotNull() & _x(y).isNotNull())
    return both.select("*", fit.alias("fitted"), (_x(y) - fit).alias("residual"))


def scatter_with_trend(df: DataFrame, x: str, y: str, order: Sequence[str], step: int = 1) -> DataFrame:
    """Every `step`-th point in `order`, each with the value of the line fitted on all rows."""
    kept = [*order, *[c for c in (x, y) if c not in order]]
    return every_kth(regression_rows(df, x, y).select(*kept, "fitted"), order, step)


# ---------------------------------------------------------------- groups and tables

def group_stats(df: DataFrame, num: str, by: str) -> DataFrame:
    """Count, mean, std and box statistics per category."""
    m = df.where(_x(num).isNotNull()).groupBy(by).agg(F.avg(_x(num)).alias("mean"), F.stddev_samp(_x(num)).alias("std"))
    return join_on(box_stats(df, num, [by]), broadcast_if_small(m), [by])


def anova_oneway(df: DataFrame, num: str, by: str, min_group: int = 1) -> DataFrame:
    """F, degrees of freedom and p; groups below `min_group` rows are left out."""
    x = df.where(_x(num).isNotNull() & F.col(by).isNotNull())
    groups = x.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(_x(num)).alias("m"), F.var_pop(_x(num)).alias("v")).where(F.col("n") >= min_group)
    groups = cut_lineage(groups)  # read for the centre and for the sums
    n, m = F.col("n"), F.col("m")
    centre = groups.agg((F.sum(n * m) / F.sum(n)).alias("g")).first()["g"]
    if centre is None:
        raise ValueError("no complete rows")
    total = groups.agg(
        F.count(F.lit(1)).alias("groups"), F.sum(n).alias("n"), F.sum(n * (m - F.lit(centre)) * (m - F.lit(centre))).alias("ssb"),
        F.sum(n * F.col("v")).alias("ssw"))
    d1, d2 = (F.col("groups") - 1).cast("double"), (F.col("n") - F.col("groups")).cast("double")
    f = F.try_divide(F.try_divide(F.col("ssb"), d1), F.try_divide(F.col("ssw"), d2))
    return total.select("groups", "n", f.alias("f"), d1.alias("df_between"), d2.alias("df_within"), f_p(f, d1, d2).alias("p_value"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, count) of non-missing pairs."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("count"))


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence | None = None) -> DataFrame:
    from lumora.operators.relational import levels

    values = list(values) if values is not None else levels(df, b)
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    wide = both.groupBy(a).pivot(b, values).agg(F.count(F.lit(1)))
    return wide.na.fill(0, [str(v) for v in values])


def _margins(cells: DataFrame) -> DataFrame:
    """Cells with row total `ra`, column total `cb`; totals are joined, never windowed over a hot level."""
    rows = broadcast_if_small(cells.groupBy("a").agg(F.sum("count").alias("ra")))
    cols = broadcast_if_small(cells.groupBy("b").agg(F.sum("count").alias("cb")))
    return cells.join(rows, "a").join(cols, "b")


def row_percent(df: DataFrame, a: str, b: str) -> DataFrame:
    cells = cut_lineage(crosstab(df, a, b))
    rows = broadcast_if_small(cells.groupBy("a").agg(F.sum("count").alias("ra")))
    return cells.join(rows, "a").select("a", "b", (F.col("count") * 100.0 / F.col("ra")).alias("pct"))


def expected_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected count of the observed cells."""
    cells = cut_lineage(crosstab(df, a, b))
    n = cells.agg(F.sum("count")).first()[0] or 0
    return _margins(cells).select("a", "b", "count", (F.col("ra") * F.col("cb") / F.lit(float(n or 1))).alias("expected"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """χ², degrees of freedom, p; Yates correction with one degree of freedom.

    Expected counts of all cells add up to n, so cells that never occur need no rows: their terms sum to
    n − Σ expected of the observed cells (in a 2×2 table each such cell contributes the same).
    """
    cells = expected_counts(df, a, b)
    o, e = F.col("count"), F.col("expected")
    gap = F.abs(o - e)
    cut = gap - F.least(F.lit(0.5), gap)
    s = cells.agg(
        F.sum("count").alias("n"), F.count_distinct("a").alias("rows"), F.count_distinct("b").alias("cols"), F.count(F.lit(1)).alias("cells"),
        F.sum(gap * gap / e).alias("plain"), F.sum(cut * cut / e).alias("yates"), F.max(gap).alias("gap"), F.sum(e).alias("seen"))
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    empty = F.when(F.col("cells") < F.col("rows") * F.col("cols"), F.greatest(F.lit(0.0), F.col("n") - F.col("seen"))).otherwise(0.0)
    absent = 4 - F.col("cells")
    late = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    chi = F.when(dof == 1, F.col("yates") + F.when(absent > 0, absent * late * late / F.col("gap")).otherwise(0.0)).otherwise(F.col("plain") + empty)
    return s.select("n", chi.alias("statistic"), dof.alias("dof"), chi2_p(chi, dof.cast("double")).alias("p_value"))


def multi_column_test(df: DataFrame, cols: Sequence[str], test: str) -> DataFrame:
    """A named test on each column; columns that cannot be tested give an error row instead of a failure."""
    from lumora.operators import univariate as U

    run = {"jarque_bera": U.jarque_bera, "dagostino_k2": U.dagostino_k2, "anderson_darling": U.anderson_darling, "shapiro_wilk": U.shapiro_wilk}[test]
    good = [c for c in cols if c in numeric_names(df)]
    bad = [(c, "absent" if c not in df.columns else "not numeric") for c in cols if c not in good]
    spark = df.sparkSession
    parts = []
    if good:
        found = run(df, good)
        found = found.where("method = 'shapiro'") if "method" in found.columns else found
        p = F.col("p_value") if "p_value" in found.columns else F.lit(None).cast("double")
        got = found.select("variable", "statistic", p.alias("p_value"))
        asked = spark.createDataFrame([(c,) for c in good], "variable string")
        parts.append(asked.join(F.broadcast(got), "variable", "left").select(
            "variable", "statistic", "p_value", F.when(F.col("statistic").isNull(), "too few values").alias("error")))
    if bad:
        parts.append(spark.createDataFrame([(c, None, None, e) for c, e in bad], "variable string, statistic double, p_value double, error string"))
    return reduce(DataFrame.unionByName, parts)

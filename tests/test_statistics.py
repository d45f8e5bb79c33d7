"""Statistics against published values and brute force on small fixtures."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumora.functions import numeric as X
from lumora.operators import bivariate as B
from lumora.operators import quality as Q
from lumora.operators import univariate as U


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(100, 15, 120)
    rows = [(float(a), float(50 + 0.3 * a + e), "ABC"[i % 3], int(v)) for i, (a, e, v) in enumerate(zip(x, rng.normal(0, 5, 120), rng.integers(0, 6, 120)))]
    return rows, spark.createDataFrame(rows, "x double, y double, g string, t int")


def test_tail_probabilities():
    # published table values: 5 % points
    assert X.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert X.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert X.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert X.f_sf(3.325835, 5, 10) == pytest.approx(0.05, abs=1e-6)
    assert X.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert X.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert X.beta_cdf(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-6)


def test_shapiro_wilk_published_sample(spark):
    # weights of eleven men, Shapiro and Wilk (1965): W = 0.79, below the 1 % point
    data = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = U.shapiro_wilk(spark.createDataFrame([(float(v),) for v in data], "w double"), ["w"]).first()
    assert row["statistic"] == pytest.approx(0.79, abs=0.005) and row["p_value"] < 0.01 and row["method"] == "shapiro"


@pytest.mark.parametrize("n", [5000, 5001])
def test_both_normality_tests_at_either_side_of_the_limit(spark, n):
    rows = {r["method"]: r for r in U.shapiro_wilk(spark.range(n).select(F.col("id").cast("double").alias("v")), ["v"]).collect()}
    assert set(rows) == {"shapiro", "jarque_bera"} and all(r["n"] == n for r in rows.values())
    assert (rows["shapiro"]["statistic"] is None) == (n > 5000)
    assert rows["jarque_bera"]["statistic"] == pytest.approx(n / 24 * (1.2 ** 2), rel=0.01)  # kurtosis of a uniform sample is -1.2


def test_anderson_darling(spark, mixed):
    rows, df = mixed
    x = np.sort([r[0] for r in rows])
    n = len(x)
    z = (x - x.mean()) / x.std(ddof=1)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i = np.arange(1, n + 1)
    expected = -n - np.sum((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1]))) / n
    assert U.anderson_darling(df, ["x"]).first()["statistic"] == pytest.approx(expected)


def test_boxcox_finds_log(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v),) for v in np.exp(rng.normal(size=3000))], "v double")
    assert abs(U.boxcox_lambda(df, "v").first()["lambda"]) < 0.05


def test_kde_integrates_to_one(spark, mixed):
    rows = U.kde(mixed[1], "x", "g").orderBy("group", "x").collect()
    for g in "ABC":
        mine = [(r["x"], r["density"]) for r in rows if r["group"] == g]
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(mine, mine[1:]))
        assert area == pytest.approx(1, abs=0.01)


def test_qq_line(spark, mixed):
    rows = U.qq_points(mixed[1], "x").orderBy("ordered").collect()
    assert len(rows) == 120 and all(a["theoretical"] < b["theoretical"] for a, b in zip(rows, rows[1:]))


def test_histogram_counts_add_up(spark, mixed):
    rows = U.histogram(mixed[1], "x", 7).collect()
    assert len(rows) == 7 and sum(r["count"] for r in rows) == 120


def test_kendall_against_pairs(spark, plan, mixed):
    rows, df = mixed
    s = n1 = n2 = 0
    for a, b in itertools.combinations(rows, 2):
        dx, dy = np.sign(a[3] - b[3]), np.sign(a[1] - b[1])
        s, n1, n2 = s + dx * dy, n1 + (dx != 0), n2 + (dy != 0)
    row = B.kendall(df, "t", "y").first()
    assert row["statistic"] == pytest.approx(s / math.sqrt(n1 * n2)) and 0 <= row["p_value"] <= 1


def test_spearman_is_pearson_of_ranks(spark, plan, mixed):
    rows, df = mixed
    t, y = np.array([r[3] for r in rows]), np.array([r[1] for r in rows])
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert B.spearman(df, "t", "y").first()["statistic"] == pytest.approx(np.corrcoef(rank(t), rank(y))[0, 1])


def test_corr_matrix_is_pairwise_complete(spark):
    rows = [(1.0, 2.0, None), (2.0, None, 1.0), (3.0, 5.0, 2.0), (4.0, 9.0, 7.0), (None, 1.0, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r["var1"], r["var2"]): (r["r"], r["n"]) for r in B.corr_matrix(df).collect()}
    assert len(got) == 9
    for i, u in enumerate("abc"):
        for j, v in enumerate("abc"):
            pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            assert got[u, v][1] == len(pairs)
            assert got[u, v][0] == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1])


def test_rank_correlation_tables(spark, mixed):
    for method, single in (("spearman", B.spearman), ("kendall", B.kendall)):
        got = {(r["var1"], r["var2"]): r["r"] for r in B.rank_corr_matrix(mixed[1], ["x", "y", "t"], method).collect()}
        assert len(got) == 3 and got["y", "x"] == pytest.approx(single(mixed[1], "y", "x").first()["statistic"])


def _tau_b(x, y):
    dx, dy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    return (dx * dy).sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum())


def test_rank_tables_rank_anew_where_a_partner_has_gaps(spark, plan):
    rng = random.Random(11)
    rows = [(rng.randint(0, 9), rng.choice([None, 1.5, 2.5, 9.0]), rng.gauss(0, 1) if rng.random() < 0.7 else None, float(k % 4)) for k in range(90)]
    df = spark.createDataFrame(rows, "a int, b double, c double, d double")
    rank = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
    brute = {"spearman": lambda x, y: np.corrcoef(rank(x), rank(y))[0, 1], "kendall": _tau_b}
    for method, plain in brute.items():
        got = {(r["var1"], r["var2"]): (r["r"], r["n"]) for r in B.rank_corr_matrix(df, list("abcd"), method).collect()}
        assert len(got) == 6
        for (u, v), (r, n) in got.items():
            i, j = "abcd".index(u), "abcd".index(v)
            both = np.array([(row[i], row[j]) for row in rows if row[i] is not None and row[j] is not None], dtype=float)
            assert n == len(both) and r == pytest.approx(plain(both[:, 0], both[:, 1]))


def test_correlation_is_two_by_two(spark, mixed):
    corr = B.corr_matrix(mixed[1], ["x", "y"])
    assert corr.count() == 4 and Q.check_corr_matrix(corr).first()["square"]


def test_chi_square_with_empty_cells(spark):
    pairs = [("a", "u")] * 5 + [("b", "v")] * 7
    row = B.chi_square(spark.createDataFrame(pairs, "p string, q string"), "p", "q").first()
    o = np.array([[5, 0], [0, 7]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    gap = np.abs(o - e)
    assert row["dof"] == 1 and row["statistic"] == pytest.approx(((gap - np.minimum(0.5, gap)) ** 2 / e).sum())


def test_yates_value(spark):
    # 10/20 and 30/25: without correction 3.52…, with it smaller
    pairs = [("a", "u")] * 10 + [("a", "v")] * 20 + [("b", "u")] * 30 + [("b", "v")] * 25
    row = B.chi_square(spark.createDataFrame(pairs, "p string, q string"), "p", "q").first()
    o = np.array([[10, 20], [30, 25]])
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    assert row["statistic"] == pytest.approx(((np.abs(o - e) - 0.5) ** 2 / e).sum())


def test_missing_counts(spark):
    df = spark.createDataFrame([(None if i <= 5 else float(i), "x") for i in range(100)], "numeric1 double, s string")
    got = {r["variable"]: r["null_count"] for r in Q.profile_columns(df).collect()}
    assert got == {"numeric1": 6, "s": 0}


def test_multi_column_test_reports_errors(spark, mixed):
    got = {r["variable"]: r["error"] for r in B.multi_column_test(mixed[1], ["x", "g", "absent"], "jarque_bera").collect()}
    assert got == {"x": None, "g": "not numeric", "absent": "absent"}


def test_rank_tables_shuffle_only_columns_of_many_values(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = pd.DataFrame({"a": rng.normal(size=400), "b": rng.integers(0, 4, 400).astype(float), "c": rng.integers(0, 9, 400).astype(float), "d": rng.integers(0, 300, 400).astype(float)})
    x.loc[::7, "b"] = None
    x.loc[3::11, "a"] = None
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in x.itertuples(index=False)], "a double, b double, c double, d double")
    expected = x.corr("spearman")
    for values, most in ((100_000, 24), (20, 24), (20, 1), (0, 24)):
        monkeypatch.setattr(B, "LOOKUP_VALUES", values)
        monkeypatch.setattr(B, "MOST_LOOKUPS", most)
        got = {(r["var1"], r["var2"]): (r["r"], r["n"]) for r in B.rank_corr_matrix(df, list(x.columns), "spearman").collect()}
        assert len(got) == 6
        for (v, w), (r, n) in got.items():
            assert abs(r - expected.loc[v, w]) < 1e-9 and n == x[[v, w]].dropna().shape[0]
    monkeypatch.undo()
    ranks, _ = B._rank_columns(df, ["b", "c"])
    assert "Exchange hashpartitioning(_row" not in ranks._jdf.queryExecution().executedPlan().toString()

"""Passes over rows as blocks and as plain sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.operators import clusters as C
from lumora.operators import linear as L
from lumora.plans.gram import column_products, vector_products


def test_rounds_over_blocks_end_where_rounds_over_rows_end(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE_ROWS", 7)
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(c, 0.5, (60, 2)) for c in ((0, 0), (5, 1), (1, 6))] + [[[9.0, 9.0]] * 5])
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "x array<double>").repartition(4)
    centres, sizes, inertia = C.kmeans_centres(df, 2, 3, tol=0)
    gaps = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    near = gaps.argmin(axis=1)
    assert sizes.tolist() == np.bincount(near, minlength=3).tolist() and inertia == pytest.approx(gaps.min(axis=1).sum())
    assert np.allclose(centres, [x[near == i].mean(axis=0) for i in range(3)])


def test_few_columns_need_no_python_for_their_products(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(300, 3)) + [1e6, 0, -5]
    df = spark.createDataFrame([(i % 2 if i % 5 else None, *map(float, r)) for i, r in enumerate(x)] + [(1, None, 1.0, 1.0)], "k int, a double, b double, c double")
    whole = df.dropna(subset=["a"])
    grams = [{r["k"]: (r["n"], r["gram"]) for r in rows.collect()} for rows in (
        column_products(whole, ["a", "b"], ["k"]), vector_products(whole.select("k", F.array("a", "b").alias("_x")), "_x", 2, ["k"]))]
    assert grams[0].keys() == grams[1].keys() == {None, 0, 1} and all(g[0] == grams[1][k][0] and np.allclose(g[1], grams[1][k][1]) for k, g in grams[0].items())
    monkeypatch.setattr(L, "vector_products", None)
    centre, ((_, n, gram),) = L.design(df, ["a", "b", "c"])
    assert n == 300 and np.allclose(L.moments(n, gram, centre)[0], x.mean(axis=0)) and np.allclose(L.moments(n, gram)[1], np.cov(x.T, bias=True))
    with pytest.raises(ValueError):
        L.design(df.where("a < 0"), ["a", "b"])

"""Importances of a forest against Spark's own forest and plain sums."""

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor

from lumora.operators import forests as R
from lumora.operators import models as M


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=3000), rng.integers(0, 5, 3000), rng.uniform(size=3000), np.ones(3000)])
    y = 1e6 + 4 * x[:, 0] + 3 * (x[:, 1] == 2) + 0.5 * x[:, 2] + rng.normal(0, 0.3, 3000)
    rows = [(*map(float, r), float(v)) for r, v in zip(x, y)] + [(None, 1.0, 1.0, 1.0, 2.0), (1.0, 1.0, 1.0, 1.0, None)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, d double, y double").repartition(3)


def test_importances_agree_with_the_forest_of_the_library_without_its_stored_weights(table, monkeypatch):
    cols = ["a", "b", "c", "d"]
    found = RandomForestRegressor(labelCol="y", numTrees=100, maxDepth=5, seed=1).fit(M._assembled(table[2].dropna(), cols)).featureImportances
    monkeypatch.setattr(RandomForestRegressor, "fit", None)  # it keeps a weight for every row and tree
    got = {r["feature"]: r["importance"] for r in M.feature_importance(table[2], cols, "y").collect()}
    assert len(got) == 4 and got["d"] == 0 and sum(got.values()) == pytest.approx(1)
    assert all(got[c] == pytest.approx(found[i], abs=0.06) for i, c in enumerate(cols))


def test_one_tree_many_features_and_a_constant_target(table):
    df = table[2]
    one = R.forest_importances(df.select("a", "y").repartition(1), ["a"], "y", trees=1, depth=1)
    assert one.tolist() == [1.0]
    wide = R.forest_importances(df.selectExpr("a", "b", "c", "y", *[f"a * {k} AS a{k}" for k in range(1, 14)]), ["a", "b", "c", *[f"a{k}" for k in range(1, 14)]], "y", trees=10)
    assert wide.sum() == pytest.approx(1) and wide[2] < 0.05  # two words of packed bins
    assert R.forest_importances(df.selectExpr("a", "5.1D AS y"), ["a"], "y").tolist() == [0.0]
    with pytest.raises(ValueError):
        R.forest_importances(df.where("a > 1e9"), ["a"], "y")


def test_weights_are_poisson_and_sums_are_those_of_their_rows():
    n = 200_001
    y, cell = np.arange(n) / n, np.arange(n) // 40
    starts = np.flatnonzero(np.diff(cell, prepend=-1))
    count, total, squares = R._weighted(y, y * y, cell, starts, [1, 2])
    ones = R._weighted(y, y * y, np.arange(n), np.arange(n), [1, 2])  # the same draw, row by row
    shares = np.bincount(ones[0].astype(int), minlength=4)[:4] / n
    assert np.allclose(shares, np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.005)
    for whole, rows, of in ((count, ones[0], 1), (total, ones[1], y), (squares, ones[2], y * y)):
        assert np.allclose(whole, np.add.reduceat(ones[0] * of, starts)) and np.allclose(rows, ones[0] * of)


def test_few_trees_at_a_time_give_the_same(table, monkeypatch):
    all_at_once = R.forest_importances(table[2].coalesce(1), ["a", "b", "c"], "y", trees=7)
    monkeypatch.setattr(R, "SUM_BYTES", 1)
    assert np.allclose(all_at_once, R.forest_importances(table[2].coalesce(1), ["a", "b", "c"], "y", trees=7))

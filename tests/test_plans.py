"""Order, windows, quantiles and sums against plain numpy, for both kinds of plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.plans import gram, order, quantiles
from lumora.plans.sizing import join_on


def skewed(spark, n=900):
    """Three keys, one of them with most rows; values with ties."""
    rng = np.random.default_rng(3)
    keys = rng.choice(["a", "b", "c"], n, p=[0.8, 0.15, 0.05])
    values = np.round(rng.normal(size=n), 1)
    rows = [(str(k), float(v), i) for i, (k, v) in enumerate(zip(keys, values))]
    return rows, spark.createDataFrame(rows, "k string, v double, i int")


def test_running_sum_and_position(spark, plan):
    rows, df = skewed(spark)
    got = {r["i"]: (r["s"], r["_pos"]) for r in order.ordered_index(order.running_sums(df, {"s": F.col("v")}, ["v", "i"], ["k"]), ["v", "i"], ["k"]).collect()}
    for key in "abc":
        mine = sorted((v, i) for k, v, i in rows if k == key)
        total = 0.0
        for pos, (v, i) in enumerate(mine):
            total += v
            assert got[i][1] == pos and got[i][0] == pytest.approx(total)


def test_sliding_windows_cross_block_edges(spark, plan):
    rows, df = skewed(spark)
    placed = order.ordered_index(df, ["i"], ["k"])
    out = order.sliding(placed, "_pos", 3, 2, lambda w: {"m": F.sum("v").over(w.rowsBetween(-3, 2)), "l": F.lag("v", 3).over(w)}, ["k"])
    got = {r["i"]: (r["m"], r["l"]) for r in out.collect()}
    assert len(got) == len(rows)
    for key in "abc":
        mine = [(v, i) for k, v, i in rows if k == key]
        for p, (_, i) in enumerate(mine):
            assert got[i][0] == pytest.approx(sum(v for v, _ in mine[max(0, p - 3): p + 3]))
            assert got[i][1] == (mine[p - 3][0] if p >= 3 else None)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_are_exact(spark, plan, keys):
    rows, df = skewed(spark)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    names = [f"p{i}" for i in range(len(probs))]
    for r in quantiles.quantiles(df, "v", probs, keys, names).collect():
        mine = [v for k, v, _ in rows if not keys or k == r["k"]]
        assert [r[n] for n in names] == pytest.approx(np.quantile(mine, probs).tolist())


def test_ranked_fallback_is_exact(spark):
    rows, df = skewed(spark)
    present = df.select("k", F.col("v").alias("_v"))
    for r in quantiles._ranked(present, [0.5], ["k"]).collect():
        mine = [v for k, v, _ in rows if k == r["k"]]
        assert r["_lo0"] + (r["_hi0"] - r["_lo0"]) * r["_f0"] == pytest.approx(np.median(mine))


def test_null_keys_match(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, y int")
    assert sorted((r["x"], r["y"]) for r in join_on(left, right, ["k"]).collect()) == [(1, 10), (2, 20)]


@pytest.mark.parametrize("width", [3, 14])
def test_cross_products(spark, width):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, width))
    cols = [f"c{i}" for i in range(width)]
    df = spark.createDataFrame([("k" + str(i % 2), *map(float, r)) for i, r in enumerate(x)], "key string, " + ", ".join(f"{c} double" for c in cols))
    for r in gram.cross_products(df, cols, ["key"]).collect():
        part = x[int(r["key"][1])::2]
        design = np.column_stack([np.ones(len(part)), part])
        assert np.allclose(gram.unpack(r["gram"], width), design.T @ design) and r["n"] == 100


def test_partition_count_does_not_matter(spark, large):
    _, df = skewed(spark)
    one = quantiles.quantiles(df.repartition(1), "v", [0.3], ["k"]).orderBy("k").collect()
    assert one == quantiles.quantiles(df.repartition(8), "v", [0.3], ["k"]).orderBy("k").collect()

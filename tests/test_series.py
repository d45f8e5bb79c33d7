"""Series operators against direct computation on small series, for both kinds of plan."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.operators import anomalies as A
from lumora.operators import decomposition as D
from lumora.operators import forecasting as FC
from lumora.operators import timeseries as T


def frame(spark, values, start=datetime(2020, 1, 1), step=timedelta(days=1), key=None):
    rows = [(key or "k", start + i * step, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "key string, ts timestamp_ntz, value double")


def test_stl_recovers_parts(spark, plan):
    i = np.arange(72)
    season = np.tile([5, 3, 1, -1, -3, -5, -4, -2, 0, 1, 2, 3], 6)
    rows = D.stl_decompose(frame(spark, 10 + 0.5 * i + season), "ts", "value", 12, ["key"]).orderBy("ts").collect()
    assert len(rows) == 72
    for r in rows:
        assert r["trend"] + r["seasonal"] + r["residual"] == pytest.approx(r["value"])
    assert max(abs(r["residual"]) for r in rows) < 0.2
    assert np.allclose([r["seasonal"] for r in rows], season, atol=0.3)


def test_loess_matches_direct_fit(spark, plan):
    rng = np.random.default_rng(5)
    y = rng.normal(size=40).cumsum()
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(y)], "key string, p long, v double")
    got = [r["f"] for r in D.loess(df, "p", "v", 9, ["key"], F.lit(40), "f").orderBy("p").collect()]
    for i in range(40):
        near = sorted(range(40), key=lambda j: (abs(j - i), j))[:9]
        far = max(abs(j - i) for j in near)
        x = np.array(near) - i
        u = np.abs(x) / far
        w = np.where(u <= 0.001, 1, np.where(u <= 0.999, (1 - u**3) ** 3, 0))
        m = np.column_stack([np.ones(9), x])
        beta = np.linalg.lstsq(m * np.sqrt(w)[:, None], y[near] * np.sqrt(w), rcond=None)[0]
        assert got[i] == pytest.approx(beta[0], abs=1e-6)


def test_change_points_find_shifts(spark, plan):
    rng = np.random.default_rng(2)
    y = np.concatenate([rng.normal(0, 1, 100), rng.normal(8, 1, 100), rng.normal(-5, 1, 100)])
    found = D.change_points(frame(spark, y), "ts", "value", keys=["key"], breaks=2).collect()
    for method in ("pelt", "binseg", "bottomup"):
        mine = sorted(r["position"] for r in found if r["method"] == method)
        assert len(mine) == 2 and abs(mine[0] - 100) <= 5 and abs(mine[1] - 200) <= 5
    window = [r["position"] for r in D.change_points_window(frame(spark, y), "ts", "value", 40, 2, ["key"]).collect()]
    assert any(abs(p - 100) <= 2 for p in window) and any(abs(p - 200) <= 2 for p in window)


def test_pelt_is_optimal():
    rng = np.random.default_rng(4)
    f = rng.normal(size=(14, 3)) + np.repeat([[0, 0, 0], [4, 0, 1]], 7, axis=0)
    sizes = np.ones(14)

    def cost(s, t):
        return (t - s) - (f[s:t].sum(axis=0) ** 2).sum() / (t - s)

    best = {}
    for mask in range(2**13):
        cuts = [0, *[i + 1 for i in range(13) if mask >> i & 1], 14]
        best[tuple(cuts[1:-1])] = sum(cost(a, b) for a, b in zip(cuts, cuts[1:])) + 2.0 * (len(cuts) - 2)
    found = tuple(D._segments(f, sizes, "pelt", 0, 2.0, 1))
    assert best[found] == pytest.approx(min(best.values()))


def test_holt_winters_equals_recursion(spark, monkeypatch):
    monkeypatch.setattr(FC, "HW_BLOCK", 10)
    rng = np.random.default_rng(7)
    y = 50 + 0.3 * np.arange(60) + np.tile([4, -1, -3, 0], 15) + rng.normal(0, 0.5, 60)
    row = FC.forecast_holt_winters(frame(spark, y), "ts", "value", 4, 4, ["key"], rounds=0).orderBy("step").collect()

    def run(a, b, g):
        level, slope = y[:4].mean(), (y[4:8].mean() - y[:4].mean()) / 4
        s, sse = list(y[:4] - y[:4].mean()), 0.0
        for t, v in enumerate(y):
            e = v - (level + slope + s[t % 4])
            level, slope, s[t % 4], sse = level + slope + a * e, slope + a * b * e, s[t % 4] + g * (1 - a) * e, sse + e * e
        return sse, [level + h * slope + s[(60 + h - 1) % 4] for h in range(1, 5)]

    results = {p: run(*p) for p in FC.HW_GRID}
    best = min(results, key=lambda p: results[p][0])
    assert (row[0]["alpha"], row[0]["beta"], row[0]["gamma"]) == best
    assert [r["forecast"] for r in row] == pytest.approx(results[best][1])


def test_holt_winters_search_lowers_the_error_alike_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(17)
    y = 1e7 + 50 + 0.3 * np.arange(95) + np.resize([4, -1, -3, 0], 95) + rng.normal(0, 1.5, 95).cumsum()
    df = frame(spark, y, key="walk").unionByName(frame(spark, y[:70] * 2, key="short")).unionByName(frame(spark, y[:7], key="too short"))

    def rows(**more):
        out = FC.forecast_holt_winters(df, "ts", "value", 5, 4, ["key"], **more).orderBy("key", "step").collect()
        return {k: [r for r in out if r["key"] == k] for k in ("walk", "short", "too short")}

    grid, one = rows(rounds=0), rows()
    assert one["too short"] == [] and len(one["walk"]) == len(one["short"]) == 5
    for k in ("walk", "short"):
        assert one[k][0]["sse"] < grid[k][0]["sse"]
    monkeypatch.setattr(FC, "HW_BLOCK", 10)
    monkeypatch.setattr(FC, "HW_FAN", 3)
    many = rows(rounds=3)
    monkeypatch.undo()
    one = rows(rounds=3)
    for k in ("walk", "short"):
        for a, b in zip(many[k], one[k]):
            assert [a[c] for c in ("forecast", "alpha", "beta", "gamma", "sse")] == pytest.approx([b[c] for c in ("forecast", "alpha", "beta", "gamma", "sse")], rel=1e-6)

    def plain(a, b, g):
        z = y - y.mean()
        level, slope, s, sse = z[:4].mean(), (z[4:8].mean() - z[:4].mean()) / 4, list(z[:4] - z[:4].mean()), 0.0
        for t, v in enumerate(z):
            e = v - (level + slope + s[t % 4])
            level, slope, s[t % 4], sse = level + slope + a * e, slope + a * b * e, s[t % 4] + g * (1 - a) * e, sse + e * e
        return sse

    r = one["walk"][0]
    assert r["sse"] == pytest.approx(plain(r["alpha"], r["beta"], r["gamma"]), rel=1e-6)


def test_arima_follows_an_autoregression(spark, plan):
    rng = np.random.default_rng(11)
    y = [0.0]
    for _ in range(400):
        y.append(5 + 0.7 * y[-1] + rng.normal())
    out = FC.forecast_arima(frame(spark, y[50:]), "ts", "value", 30, ["key"], auto=False, order=(1, 0, 0)).orderBy("step").collect()
    assert len(out) == 30 and all(r["lower"] < r["forecast"] < r["upper"] for r in out)
    assert out[-1]["forecast"] == pytest.approx(5 / 0.3, abs=1.0)
    auto = FC.forecast_arima(frame(spark, y[50:]), "ts", "value", 3, ["key"]).first()
    assert 0 <= auto["p"] <= 3 and 0 <= auto["d"] <= 2 and 0 <= auto["q"] <= 3


def _css(w, beta, ar, ma, reach):
    e = np.zeros(len(w))
    for t in range(reach, len(w)):
        e[t] = w[t] - beta[0] - sum(b * w[t - a] for a, b in zip(ar, beta[1:])) - sum(b * e[t - a] for a, b in zip(ma, beta[1 + len(ar):]))
    return e


@pytest.mark.parametrize("block", [8192, 500])
def test_css_recovers_weights_whole_or_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(FC, "CSS_BLOCK", block)
    monkeypatch.setattr(FC, "CSS_FAN", 3)
    rng = np.random.default_rng(5)
    noise, w = rng.normal(size=6000), [0.0]
    for t in range(1, 6000):
        w.append(1.0 + 0.6 * w[-1] + noise[t] + 0.5 * noise[t - 1])
    w = np.array(w[100:])
    series = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(w)] + [("b", i, float(v)) for i, v in enumerate(w[:333])], "key string, _pos long, _w double")
    begin = [0.5, 0.4, 0.1]
    start = spark.createDataFrame([(k, begin, [1], [1], 1.0) for k in "ab"], "key string, _beta array<double>, _ar array<int>, _ma array<int>, _scale double")
    got = {r["key"]: r for r in FC.css_fit(series, start, ["key"], 3, 3).collect()}
    for key, part in (("a", w), ("b", w[:333])):
        r = got[key]
        e = _css(part, r["_beta"], [1], [1], 3)
        assert r["_n"] == len(part) - 3 and r["_sse"] == pytest.approx((e * e).sum(), rel=1e-8)
        assert list(r["_ends"]) == pytest.approx(e[-3:], abs=1e-6)
        assert r["_sse"] < (_css(part, begin, [1], [1], 3) ** 2).sum()
        for i in range(3):  # a minimum: no small move is better
            for move in (-0.01, 0.01):
                other = np.array(r["_beta"]) + move * np.eye(3)[i]
                assert (_css(part, other, [1], [1], 3) ** 2).sum() > r["_sse"]
    assert list(got["a"]["_beta"][1:]) == pytest.approx([0.6, 0.5], abs=0.06)


def test_sarima_continues_the_season(spark, plan):
    rng = np.random.default_rng(3)
    season = np.tile([10, 4, -2, -8, -6, 2], 20)
    y = 100 + 0.5 * np.arange(120) + season + rng.normal(0, 0.3, 120)
    out = FC.forecast_sarima(frame(spark, y), "ts", "value", 6, 6, ["key"]).orderBy("step").collect()
    expected = 100 + 0.5 * np.arange(120, 126) + season[:6]
    assert np.abs(np.array([r["forecast"] for r in out]) - expected).max() < 2.5


def test_var_and_seasonal_regression(spark):
    i = np.arange(200)
    a = np.sin(i / 5)
    rows = [(datetime(2020, 1, 1) + timedelta(days=int(k)), float(a[k]), float(np.cos(k / 5))) for k in i]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double")
    out = {(r["step"], r["variable"]): r["forecast"] for r in FC.forecast_var(df, "ts", ["a", "b"], 5).collect()}
    for h in range(1, 6):
        assert out[h, "a"] == pytest.approx(np.sin((199 + h) / 5), abs=1e-3)
    year = [10 + 0.01 * k + 3 * np.sin(2 * np.pi * k / 365.25) for k in range(800)]
    got = FC.forecast_seasonal_regression(frame(spark, year), "ts", "value", 20, keys=["key"]).orderBy("step").collect()
    assert [r["forecast"] for r in got] == pytest.approx([10 + 0.01 * k + 3 * np.sin(2 * np.pi * k / 365.25) for k in range(800, 820)], abs=0.05)


def test_adf_statistic_matches_regression(spark, plan):
    rng = np.random.default_rng(9)
    walk, noise = rng.normal(size=150).cumsum(), rng.normal(size=150)
    df = frame(spark, walk, key="walk").unionByName(frame(spark, noise, key="noise"))
    got = {r["key"]: r for r in T.adf_test(df, "ts", "value", ["key"], longest=6).collect()}
    assert got["noise"]["stationary"] and not got["walk"]["stationary"]
    for name, y in (("walk", walk), ("noise", noise)):
        lag, d = got[name]["lag"], np.diff(y)
        x = np.column_stack([np.ones(len(d) - lag), y[lag:-1], *[d[lag - k: len(d) - k] for k in range(1, lag + 1)]])
        beta, rss = np.linalg.lstsq(x, d[lag:], rcond=None)[:2]
        se = np.sqrt(rss[0] / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        assert got[name]["statistic"] == pytest.approx(beta[1] / se, rel=1e-6) and got[name]["nobs"] == len(x)


def test_adf_published_surface():
    assert T.adf_p(-2.86) == pytest.approx(0.05, abs=0.002) and T.adf_p(-3.43) == pytest.approx(0.01, abs=0.001)


def test_pacf_of_autoregression_cuts_off(spark):
    rng = np.random.default_rng(1)
    y = [0.0]
    for _ in range(3000):
        y.append(0.6 * y[-1] + rng.normal())
    got = {r["lag"]: r["pacf"] for r in T.pacf(frame(spark, y), "ts", "value", 5, ["key"]).collect()}
    assert got[0] == 1 and got[1] == pytest.approx(0.6, abs=0.05) and all(abs(got[k]) < 0.08 for k in range(2, 6))


def test_granger_finds_the_cause(spark, plan):
    rng = np.random.default_rng(6)
    x = rng.normal(size=300)
    y = np.concatenate([[0], 0.8 * x[:-1]]) + rng.normal(0, 0.5, 300)
    df = spark.createDataFrame([(datetime(2020, 1, 1) + timedelta(days=i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "ts timestamp_ntz, x double, y double")
    got = {(r["cause"], r["effect"]): r for r in T.granger(df, "ts", ["x", "y"], 2).where("lag = 1").collect()}
    assert got["x", "y"]["p_value"] < 1e-6 < got["y", "x"]["p_value"]
    m = np.column_stack([np.ones(299), y[:-1], x[:-1]])
    full = np.linalg.lstsq(m, y[1:], rcond=None)[1][0]
    rest = np.linalg.lstsq(m[:, :2], y[1:], rcond=None)[1][0]
    assert got["x", "y"]["f"] == pytest.approx((rest - full) / (full / 296), rel=1e-6)


def lof_brute(z, k):
    n = len(z)
    d = np.abs(z[:, None] - z[None])
    near = [sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], z[j]))[:k] for i in range(n)]
    kd = np.array([d[i, near[i][-1]] for i in range(n)])
    lrd = np.array([1 / (np.mean([max(kd[j], d[i, j]) for j in near[i]]) + 1e-10) for i in range(n)])
    return np.array([np.mean(lrd[near[i]]) / lrd[i] for i in range(n)])


def test_lof_and_dbscan_against_pairs(spark, plan):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=60), [6.0, 6.5, -9.0]])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, value double")
    z = (v - v.mean()) / v.std()
    got = {r["i"]: r["lof"] for r in A.lof_scores(df, "value", ["i"], 5).collect()}
    assert [got[i] for i in range(63)] == pytest.approx(lof_brute(z, 5).tolist())
    for eps in (0.1, 0.3):
        d = np.abs(z[:, None] - z[None]) <= eps
        core = d.sum(axis=1) >= 5
        noise = {i for i in range(63) if not core[i] and not (d[i] & core).any()}
        assert {r["i"] for r in A.anomalies_dbscan(df, "value", ["i"], eps, 5).collect()} == noise


def test_future_dates_fall_back_to_a_day(spark):
    one = frame(spark, [1.0])
    assert [r["ts"] for r in T.future_dates(one, "ts", 2, ["key"]).orderBy("step").collect()] == [datetime(2020, 1, 2), datetime(2020, 1, 3)]


def test_segments_cover_the_series(spark):
    rows = T.segment_stats(frame(spark, range(30)), "ts", "value", [10, 25], ["key"]).orderBy("segment").collect()
    assert [r["length"] for r in rows] == [10, 15, 5]


def test_adf_and_granger_do_not_depend_on_the_level(spark):
    from lumora.operators import timeseries as S

    rng = np.random.default_rng(8)
    noise, other = rng.normal(size=300), rng.normal(size=300)
    rows = [(i, float(a), float(b), float(a + 1e6), float(b + 1e8)) for i, (a, b) in enumerate(zip(noise, other))]
    df = spark.createDataFrame(rows, "t long, a double, b double, far_a double, far_b double")
    near, far = (S.adf_test(df, "t", c).first() for c in ("a", "far_a"))
    assert near["p_value"] < 0.01 and np.isclose(near["statistic"], far["statistic"], atol=1e-3)
    near, far = ([r["f"] for r in S.granger(df, "t", cols).orderBy("cause", "effect", "lag").collect()] for cols in (["a", "b"], ["far_a", "far_b"]))
    assert np.allclose(near, far, atol=1e-3)


def test_forecasts_move_with_the_level(spark):
    rng = np.random.default_rng(3)
    y = np.cumsum(rng.normal(size=120)) * 0.3 + 5
    start = datetime(2020, 1, 1)
    rows = [(start + timedelta(days=i), float(v), float(v + 1e8), float(o), float(o + 1e6)) for i, (v, o) in enumerate(zip(y, rng.normal(size=120)))]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, near double, far double, other double, far_other double")

    def got(frame):
        return np.array([r["forecast"] for r in frame.orderBy("step").collect()])

    assert np.allclose(got(FC.forecast_arima(df, "ts", "near", 5)) + 1e8, got(FC.forecast_arima(df, "ts", "far", 5)), atol=1e-2)
    assert np.allclose(got(FC.forecast_seasonal_regression(df, "ts", "near", 5, 1)) + 1e8, got(FC.forecast_seasonal_regression(df, "ts", "far", 5, 1)), atol=1e-2)
    near = FC.forecast_var(df, "ts", ["near", "other"], 4).where("variable = 'near'")
    assert np.allclose(got(near) + 1e8, got(FC.forecast_var(df, "ts", ["far", "far_other"], 4).where("variable = 'far'")), atol=1e-2)


@pytest.mark.parametrize("n,breaks", [(9_990, [3015, 6035]), (12_000, [3015, 8035]), (31_000, [10_005, 20_015])])
def test_change_points_lie_on_one_grid_at_any_length(spark, n, breaks):
    rng = np.random.default_rng(n)
    y = rng.normal(0, 0.3, n)
    for b in breaks:
        y[b:] += 4
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "ts long, value double")
    found = {}
    for r in D.change_points(df, "ts", "value", ("binseg", "bottomup"), breaks=2).collect():
        found.setdefault(r["method"], []).append(r["position"])
    assert sorted(found["binseg"]) == breaks
    # bottom-up starts from pieces of two blocks, which only the wider blocks' second pass takes apart
    assert all(abs(p - b) <= (10 if n < 10_000 else 0) for p, b in zip(sorted(found["bottomup"]), breaks))


def test_adf_lags_follow_from_the_length(spark):
    rng = np.random.default_rng(2)
    n = 3000
    e = rng.normal(size=n)
    y = np.zeros(n)
    for i in range(n):
        y[i] = 0.3 * y[i - 1] + (0.6 * y[i - 26] if i >= 26 else 0) + e[i] if i else e[i]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "ts long, value double")
    row = T.adf_test(df, "ts", "value").first()
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3)
    d = np.diff(y)

    def fit(lag, start):
        rows = range(start, n - 1)
        x = np.array([[1.0, y[i], *d[i - lag : i][::-1]] for i in rows])
        beta, *_ = np.linalg.lstsq(x, d[start:], rcond=None)
        rss = float(((d[start:] - x @ beta) ** 2).sum())
        cov = np.linalg.inv(x.T @ x) * rss / (len(x) - x.shape[1])
        return len(x) * np.log(rss / len(x)) + 2 * x.shape[1], beta[1] / np.sqrt(cov[1, 1])

    lag = min(range(most + 1), key=lambda k: fit(k, most)[0])
    assert most > 24 and row["lag"] == lag and row["statistic"] == pytest.approx(fit(lag, lag)[1], rel=1e-6)

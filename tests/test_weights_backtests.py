"""Weights, the optimiser, and equity curves."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.functions.columns import capped_simplex
from sextant.functions.numeric import Stream, bootstrap_blocks, bootstrap_indices, max_sharpe, portfolio_stats, project
from sextant.operators import align, backtest, weights
from sextant.params import WeightParams

from .test_metrics import EXPO, series


def test_stream_golden_values():
    s = Stream(42)
    assert [next(s) for _ in range(5)] == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099, 0.6697340414393693, 0.17481389874592423]
    s = Stream(12345, block=2)
    assert [next(s) for _ in range(5)] == [0.9797282677609473, 0.3067522644996643, 0.484205421525985, 0.817934412509203, 0.5094283693470061]


def test_projection_cases():
    w = project(np.array([0.5, 0.3, 0.1, 0.05, 0.05]), 0.02, 0.20)
    assert w.sum() == pytest.approx(1) and np.allclose(w, 0.2)
    w = project(np.array([0.5, 0.3, 0.1, 0.05, 0.05]), 0.05, 0.40)
    assert np.allclose(w, [0.4, 0.325, 0.125, 0.075, 0.075], atol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=6, max_size=20))
def test_projection_is_feasible(v):
    w = project(np.array(v), 0.02, 0.20)
    assert w.sum() == pytest.approx(1, abs=1e-8)
    assert w.min() >= 0.02 - 1e-12 and w.max() <= 0.20 + 1e-12


def test_column_projection_equals_numpy(spark):
    v = [0.4, 0.3, 0.15, 0.05, 0.05, 0.05]
    got = spark.range(1).select(capped_simplex(F.array(*[F.lit(x) for x in v]), 0.02, 0.25).alias("w")).first()["w"]
    assert np.allclose(got, project(np.array(v), 0.02, 0.25), atol=1e-9)


def test_max_sharpe_prefers_the_better_asset():
    mu, cov = np.array([0.15, 0.08]), np.eye(2) * 0.04
    w = max_sharpe(mu, cov, 0.03, 0, 1, 500)
    assert w[0] > w[1] and w.sum() == pytest.approx(1)
    batch = max_sharpe(np.stack([mu, mu[::-1]]), np.stack([cov, cov]), 0.03, 0, 1, 500)
    assert np.allclose(batch[0], w) and np.allclose(batch[1], w[::-1])
    assert portfolio_stats(w, mu, cov, 0.03)[2] > portfolio_stats(np.array([0.5, 0.5]), mu, cov, 0.03)[2] - 1e-12


def test_bootstrap_is_circular_and_exact():
    idx = bootstrap_indices(50, 200, 21, Stream(42))
    assert len(idx) == 200 and idx[0] == int(0.6011037519201636 * 50)
    steps = np.diff(idx) % 50
    assert (steps == 1).mean() > 0.8
    assert (bootstrap_indices(50, 200, 21, Stream(42)) == idx).all()


def plain_samples(rows, length, mean_block, scenarios, seed):
    """Every sample's row numbers, drawn one by one."""
    stream, out = Stream(seed), []
    for _ in range(scenarios):
        picks = []
        while len(picks) < length:
            first = int(next(stream) * rows)
            size = max(1, int(np.floor(-mean_block * np.log(1 - next(stream)) + 0.5)))
            picks += [(first + i) % rows for i in range(min(size, length - len(picks)))]
        out.append(picks)
    return out


@pytest.mark.parametrize(("rows", "length", "mean_block"), [(50, 200, 21), (7, 5, 3), (1000, 1000, 1), (3, 3, 400), (1, 1, 5)])
def test_blocks_of_all_samples_equal_single_draws(rows, length, mean_block):
    scenario, first, size = bootstrap_blocks(rows, length, mean_block, 90, Stream(42))
    made = [np.concatenate([np.arange(a, a + n) % rows for a, n in zip(first[scenario == s], size[scenario == s], strict=True)]).tolist() for s in range(90)]
    assert made == plain_samples(rows, length, mean_block, 90, 42)


@pytest.mark.parametrize("block", [7, 1024])
def test_moments_of_samples(spark, block):
    x = np.random.default_rng(5).normal([0.01, 0.002, 0.0], 0.04, (90, 3))
    params = WeightParams(scenarios=25, mean_block=4, ppy=12)
    got = {r["scenario"]: r for r in weights.scenario_moments(returns(spark, x), params, block).collect()}
    samples = plain_samples(90, params.window(90), 4, 25, 42)
    assert sorted(got) == list(range(25))
    for s, picks in enumerate(samples):
        assert got[s]["symbols"] == ["s0", "s1", "s2"]
        assert np.allclose(got[s]["mu"], x[picks].mean(axis=0) * 12, atol=1e-12)
        assert np.allclose(np.array(got[s]["cov"]).reshape(3, 3), np.cov(x[picks].T) * 12, atol=1e-12)
    found = {r["symbol"]: r["weight"] for r in weights.resampled_weights(returns(spark, x), params).collect()}
    cov = np.stack([np.cov(x[p].T) * 12 for p in samples])
    best = max_sharpe(np.stack([x[p].mean(axis=0) * 12 for p in samples]), cov, params.rf, params.floor, params.cap, params.iterations)
    want = project(best.mean(axis=0), params.floor, params.cap)
    assert np.allclose([found[f"s{i}"] for i in range(3)], want / want.sum(), atol=1e-9)


def test_ten_million_cells_are_resampled(spark):
    """20 members over half a million dates, far more than was allowed in one matrix."""
    table = spark.range(500_000).select(F.col("id").alias("ts"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("m"))
    rets = table.select("ts", F.format_string("s%02d", "m").alias("symbol"), (F.pmod(F.xxhash64("ts", "m"), F.lit(2001)) / 1e5 - 0.01 + F.col("m") / 1e5).alias("ret"))
    w = weights.resampled_weights(rets, WeightParams(scenarios=12, iterations=20)).collect()
    assert len(w) == 20 and sum(r["weight"] for r in w) == pytest.approx(1) and {r["scenarios"] for r in w} == {12}


@pytest.mark.parametrize("tile", [2, 512])
def test_covariances_by_tiles_and_gaps(spark, tile):
    """Members that lack some dates, in tiles smaller than the portfolio."""
    rng = np.random.default_rng(7)
    x = rng.normal(1000, 1, (60, 9))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:-1, 8] = np.nan
    rows = [(f"s{j}", i, float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if not np.isnan(v)]
    got = {(r["a"], r["b"]): r["cov"] for r in weights.cov_matrix(spark.createDataFrame(rows, "symbol string, ts bigint, ret double"), tile).collect()}
    for i in range(9):
        for j in range(i, 9):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if both.any():
                want = np.cov(x[both, i], x[both, j])[0, 1] if both.sum() > 1 else 0
                assert got.pop((f"s{i}", f"s{j}")) == pytest.approx(want, abs=1e-8)
    assert not got


def returns(spark, values):
    rows = [(f"s{j}", i, float(x)) for i, row in enumerate(values) for j, x in enumerate(row)]
    return spark.createDataFrame(rows, "symbol string, ts bigint, ret double")


def test_inverse_vol_and_equal(spark):
    i = np.arange(600)
    r = returns(spark, np.stack([0.01 * np.sin(i), 0.03 * np.sin(i * 1.3)], axis=1))
    w = {x["symbol"]: x["weight"] for x in weights.inverse_vol_weights(r, 0, 1).collect()}
    assert w["s0"] > w["s1"] and sum(w.values()) == pytest.approx(1)
    tight = {x["symbol"]: x["weight"] for x in weights.inverse_vol_weights(r, 0.02, 0.2).collect()}
    assert tight["s0"] == pytest.approx(0.5) and tight["s1"] == pytest.approx(0.5)
    e = weights.equal_weights(spark.createDataFrame([("a",), ("b",)], "symbol string")).collect()
    assert [x["weight"] for x in e] == [0.5, 0.5]


def test_covariance_and_resampling(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal([0.02, 0.001, 0.001], 0.03, (80, 3))
    r = returns(spark, x)
    cov = {(c["a"], c["b"]): c["cov"] for c in weights.cov_matrix(r).collect()}
    want = np.cov(x.T)
    assert cov["s0", "s1"] == pytest.approx(want[0, 1]) and cov["s2", "s2"] == pytest.approx(want[2, 2]) and len(cov) == 6
    params = WeightParams(scenarios=40, mean_block=3, ppy=12, floor=0.05, cap=0.8, iterations=60)
    w = weights.compute_weights("resampled", r, params).collect()
    assert sum(v["weight"] for v in w) == pytest.approx(1) and max(w, key=lambda v: v["weight"])["symbol"] == "s0"
    assert {v["scenarios"] for v in w} == {40} and all(v["wstd"] >= 0 for v in w)
    again = weights.compute_weights("resampled", r, params).collect()
    assert [v["weight"] for v in again] == pytest.approx([v["weight"] for v in w])


def test_proportional_curves_keep_their_growth(spark):
    prices = series(spark, A=EXPO[:1500], B=[p / 2 for p in EXPO[:1500]])
    equity = backtest.equity_curves(prices, weights.equal_weights(prices.select("symbol").distinct()))
    got = {(r["scheme"], r["mode"]): r for r in backtest.backtest_metrics(equity, 252).collect()}
    assert {m for _, m in got} == {"rebal", "buyhold"}
    assert all(r["cagr"] == pytest.approx(0.12, abs=5e-3) for r in got.values())
    first = equity.where("ts = 0").collect()
    assert all(r["value"] == pytest.approx(100) for r in first)


def test_edge_without_a_benchmark(spark):
    m = spark.createDataFrame([("equal", "rebal", 0.1)], "scheme string, mode string, cagr double")
    none = m.select("cagr").limit(0)
    assert backtest.edge(m, none).first()["edge"] == pytest.approx(0.1)
    assert backtest.edge(m, none, missing_as_zero=False).first()["edge"] is None


def test_renormalised(spark):
    w = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 0.3), ("x", "c", 0.2)], "scheme string, symbol string, weight double")
    kept = spark.createDataFrame([("a",), ("b",)], "symbol string")
    got = {r["symbol"]: r["weight"] for r in weights.renormalised(w, kept).collect()}
    assert got == {"a": pytest.approx(0.625), "b": pytest.approx(0.375)}


def test_alignment_benchmark_and_slice(spark):
    prices = series(spark, a=[1, 2, 3, 4], b=[5, 6, 7, 8]).where("not (symbol = 'b' and ts = 86400)")
    aligned = align.align_on_dates(prices)
    assert sorted({r["ts"] for r in aligned.collect()}) == [0, 172_800, 259_200]
    r = {(x["symbol"], x["ts"]): x["ret"] for x in align.aligned_returns(aligned).collect()}
    assert r["a", 172_800] == pytest.approx(2.0)
    bench = spark.createDataFrame([(172_800, 50.0)], "ts bigint, px double")
    got = {x["ts"]: x["value"] for x in align.benchmark_on(aligned.select("ts").distinct(), bench).collect()}
    assert got == {0: None, 172_800: 100.0, 259_200: 100.0}
    assert align.time_slice(prices, 0, 172_800).groupBy("symbol").count().collect()[0]["count"] == 3
    shifted = prices.withColumn("ts", F.when(F.col("symbol") == "b", F.col("ts") + 3600).otherwise(F.col("ts")))
    assert align.align_on_dates(shifted).count() == 0 and align.align_on_dates(shifted, "date").count() == 6


def test_months_need_full_cover(spark):
    rows = [(s, m, 1.0 + m) for s, a, b in (("a", 0, 20), ("b", 5, 20), ("c", 8, 30)) for m in range(a, b)]
    monthly = spark.createDataFrame(rows, "symbol string, month_idx int, px double")
    w = align.common_window(monthly).first()
    assert (w["lo"], w["hi"]) == (8, 19)
    window = spark.createDataFrame([(6, 19)], "lo int, hi int")
    assert {r["symbol"] for r in align.align_on_months(monthly, window).collect()} == {"a", "b"}
    assert align.align_on_months(monthly, spark.createDataFrame([(16, 19)], "lo int, hi int")).count() == 0
    bench = monthly.where("symbol = 'a'").select("month_idx", "px")
    curve = backtest.benchmark_on_months(bench, window).orderBy("month_idx").collect()
    assert len(curve) == 14 and curve[0]["value"] == pytest.approx(100)
    assert backtest.benchmark_on_months(bench, spark.createDataFrame([(6, 25)], "lo int, hi int")).count() == 0

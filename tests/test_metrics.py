"""The classic cases of the metrics, on made-up series with known answers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sextant.operators import metrics, ordering, quality, scan, screen
from sextant.params import ScreenParams

EXPO = [100 * (1.12 ** (1 / 252)) ** i for i in range(252 * 20)]


def series(spark, **named):
    rows = [(s, i * 86_400, float(p)) for s, px in named.items() for i, p in enumerate(px)]
    return spark.createDataFrame(rows, "symbol string, ts bigint, px double")


def one(df, symbol):
    return {r["symbol"]: r for r in df.collect()}[symbol]


@pytest.fixture(scope="module")
def rows(spark):
    noisy = [p * (1 + 0.15 * math.sin(i / 7)) for i, p in enumerate(EXPO)]
    df = series(spark, expo=EXPO, dd=[100, 150, 200, 150, 100, 120], noisy=noisy, flat=[5.0] * 40, single=[1.0])
    return {r["symbol"]: r for r in metrics.series_metrics(df, 252).collect()}


def test_exponential(rows):
    r = rows["expo"]
    assert r["r2"] == pytest.approx(1, abs=1e-6)
    assert r["cagr"] == pytest.approx(0.12, abs=1e-3)
    assert r["mdd"] == pytest.approx(0, abs=1e-9)
    assert r["min5y"] > 0
    assert r["reg"] < 1e-9


def test_drawdown_and_noise(rows):
    assert rows["dd"]["mdd"] == pytest.approx(-0.5)
    assert rows["noisy"]["reg"] > rows["expo"]["reg"]


def test_undefined_metrics_are_null(rows):
    flat, single = rows["flat"], rows["single"]
    assert flat["r2"] is None and flat["mar"] is None and flat["score"] is None
    assert flat["cagr"] == 0 and flat["mdd"] == 0
    assert single["cagr"] is None and single["vol"] is None and single["days"] == 1
    assert rows["dd"]["r2"] is None and rows["dd"]["min5y"] is None


def test_downside_counts_negative_returns_only(spark):
    r = one(metrics.series_metrics(series(spark, a=[100, 90, 99, 89.1, 100]), 12), "a")
    assert r["dvol"] == pytest.approx(0.1 * math.sqrt(12))


def test_empty_table(spark):
    none = spark.createDataFrame([], "symbol string, ts bigint, px double")
    assert metrics.universe_metrics(none, 252).count() == 0
    assert quality.quality_score(metrics.series_metrics(none, 252)).count() == 0


def test_quality_of_dominant_and_worst(spark):
    df = spark.createDataFrame([("a", 0.99, 0.30, 0.6), ("b", 0.95, 0.10, 0.4), ("c", 0.80, -0.20, 0.2)], "symbol string, r2 double, min5y double, mar double")
    q = {r["symbol"]: r["quality"] for r in quality.quality_score(df).collect()}
    assert q["a"] == 1 and q["c"] == 0 and 0 < q["b"] < 1


def test_ranks_do_not_share_and_skip_undefined(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None), ("d", float("nan")), ("e", 2.0)], "symbol string, v double")
    got = {r["symbol"]: r["rank_v"] for r in quality.percentile_ranks(df, ("v",)).collect()}
    assert got == {"a": 0.0, "b": 0.5, "c": None, "d": None, "e": 1.0}
    alone = quality.percentile_ranks(df.where("symbol = 'e'"), ("v",)).first()
    assert alone["rank_v"] == 1.0


def test_undefined_ranked_as_zero(spark):
    df = spark.createDataFrame([("a", None, 0.1, 0.1), ("b", 0.5, -0.1, None)], "symbol string, r2 double, min5y double, mar double")
    q = {r["symbol"]: r["quality"] for r in quality.quality_score(df, undefined_as_zero=True).collect()}
    assert q["a"] == pytest.approx((0 + 1 + 1) / 3) and q["b"] == pytest.approx((1 + 0 + 0) / 3)
    q = {r["symbol"]: r["quality"] for r in quality.quality_score(df).collect()}
    assert q["a"] == pytest.approx(1.0) and q["b"] == pytest.approx((1 + 0) / 2)


ROWS = "symbol string, days bigint, cagr double, mdd double, min5y double, r2 double, quality double"


def test_screen_cascade(spark):
    p = ScreenParams(top_n=2)
    good = (0.2, -0.3, 0.0, 0.95)
    df = spark.createDataFrame(
        [
            ("young", 3779, *good, 1.0),
            ("ok1", 3780, *good, 0.2),
            ("ok2", 3780, *good, 0.9),
            ("ok3", 9999, *good, None),
            ("five", 9999, 0.2, -0.3, -0.06, 0.95, 0.5),
            ("fit", 9999, 0.01, -0.9, 0.0, 0.5, 0.5),
            ("slow", 9999, 0.05, -0.9, 0.0, 0.95, 0.5),
            ("deep", 9999, 0.2, -0.46, 0.0, 0.95, 0.5),
            ("unknown", 9999, 0.2, None, None, float("nan"), 0.1),
        ],
        ROWS,
    )
    assert [r["symbol"] for r in screen.screen(df, p).collect()] == ["ok2", "ok1"]
    assert {r["reason"]: r["n"] for r in screen.reject_counts(df, p).collect()} == {"history": 1, "five_year": 1, "r2": 1, "cagr": 1, "drawdown": 1}
    result = screen.ScreenResult.of(df, p)
    assert result.passed.first()["passed"] == 4
    shown = screen.top(screen.survivors(df, p), p, ascending=True)
    assert [r["symbol"] for r in shown.collect()] == ["ok1", "ok2"]
    stored = ScreenParams(top_n=0, undefined_as_zero=True)
    assert "unknown" not in {r["symbol"] for r in screen.screen(df, stored).collect()}
    assert [r["symbol"] for r in screen.screen(df, ScreenParams(top_n=0)).collect()][-1] == "ok3"


def test_zero_min_years_means_twenty():
    assert ScreenParams(min_years=0).least_points() == 5040
    assert ScreenParams(min_years=12, ppy=12).least_points() == 144


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(1, 1000), min_size=2, max_size=60))
def test_drawdown_against_numpy(spark, px):
    r = one(metrics.series_metrics(series(spark, a=px), 12), "a")
    x = np.array(px)
    assert r["mdd"] == pytest.approx((x / np.maximum.accumulate(x) - 1).min(), abs=1e-12)
    assert -1 <= r["mdd"] <= 0
    series_points = metrics.drawdown_series(series(spark, a=px)).agg(F.min("drawdown_pct").alias("m")).first()["m"]
    assert series_points == pytest.approx(100 * r["mdd"], abs=1e-9)


def test_ranks_of_ties_are_spread(spark):
    """Nine tenths of the rows share a value; ranks from even ranges are those of one sort."""
    rows = [(f"S{i:05d}", 0.0 if i % 10 else (i % 70) / 50 - 0.5, None if i % 3 else float(i)) for i in range(5000)]
    table = spark.createDataFrame(rows, "symbol string, a double, b double")
    for per_task in (100, 1_000_000):
        got = {r["symbol"]: (r["rank_a"], r["rank_b"]) for r in quality.percentile_ranks(table, ("a", "b"), per_task=per_task).collect()}
        for k in (1, 2):
            order = sorted((r[k], r[0]) for r in rows if r[k] is not None)
            place = {s: i / (len(order) - 1) for i, (_, s) in enumerate(order)}
            assert all(got[r[0]][k - 1] == (place[r[0]] if r[k] is not None else None) for r in rows)


def test_ranges_of_a_good_universe_are_even(spark):
    """Values between 0.9 and 1, half of them equal: no range has over twice the mean."""
    value = F.when(F.col("id") % 2 == 0, F.lit(0.95)).otherwise(0.9 + F.pmod(F.xxhash64("id"), F.lit(100_000)) / 1e6)
    rows = spark.range(200_000).select(F.concat(F.lit("S"), "id").alias("symbol"), value.alias("r2"))
    key = F.struct(F.col("r2").alias("v"), F.col("symbol").alias("t"))
    for key in (key, F.when(F.col("symbol") > "S5", key)):
        held = rows.where(key.isNotNull())
        (number,) = ordering.ranges(held, [key], held.count(), 4_000)
        sizes = [r["count"] for r in held.groupBy(number.alias("n")).count().collect()]
        assert len(sizes) > held.count() / 4_000 / 2 and max(sizes) < 2 * 4_000


def test_numbered(spark):
    rows = spark.range(0, 3000, 3).select((F.col("id") * 7 % 3001).alias("ts")).repartition(5)
    for per_task in (64, 10_000):
        got = sorted((r["ts"], r["at"]) for r in ordering.numbered(rows, "ts", "at", 1000, per_task).collect())
        assert [a for _, a in got] == list(range(1000))
    assert ordering.numbered(rows.limit(0), "ts", "at", 0).collect() == []


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-50, 400), st.one_of(st.none(), st.floats(0.5, 9))), unique_by=lambda x: x[:2], max_size=40), st.integers(1, 120))
def test_split_series_run_as_whole_ones(spark, points, width):
    table = spark.createDataFrame(points, "symbol string, ts bigint, px double")
    named = {"peak": ("max", F.col("px")), "total": ("sum", F.col("px")), "prev": ("before", F.col("px"))}
    got = {(r["symbol"], r["ts"]): r for r in scan.running(table, ("symbol",), "ts", named, width).collect()}
    want = scan.running(table, ("symbol",), "ts", named).collect()
    assert len(got) == len(want)
    for r in want:
        one = got[r["symbol"], r["ts"]]
        assert (one["peak"], one["prev"]) == (r["peak"], r["prev"]) and one["total"] == pytest.approx(r["total"])


def test_long_series_spreads(spark):
    """One series of two million points: cut in stretches, no window holds it whole."""
    prices = spark.range(2_000_000).select(F.lit("a").alias("symbol"), F.col("id").alias("ts"), (F.lit(2.0) + F.sin(F.col("id") / 1e5)).alias("px"))
    mdd = metrics.max_drawdown(prices, width=50_000).first()["mdd"]
    assert mdd == pytest.approx(metrics.max_drawdown(prices).first()["mdd"])
    assert metrics.period_returns(prices, width=50_000).count() == 1_999_999

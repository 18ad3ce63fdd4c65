"""As-of conversion and universes."""

from bisect import bisect_right

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant import queries
from sextant.operators import fx, universe
from sextant.operators.resample import from_segments, month_end, to_segments, without_gaps

from .conftest import data


@settings(max_examples=8, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 400), st.sampled_from("AB")), max_size=40),
    st.lists(st.tuples(st.integers(0, 400), st.sampled_from("AB")), max_size=20, unique=True),
)
def test_asof_equals_brute_force(spark, points, rates):
    left = spark.createDataFrame([(k, t, i) for i, (t, k) in enumerate(points)], "k string, ts bigint, n int")
    right = spark.createDataFrame([(k, t, float(t)) for t, k in rates], "k string, ts bigint, rate double")
    got = {r["n"]: r["rate"] for r in fx.asof_join(left, right, "k", "rate", block=50, salts=3).collect()}
    for i, (t, k) in enumerate(points):
        times = sorted(x for x, y in rates if y == k)
        at = bisect_right(times, t)
        assert got[i] == (float(times[at - 1]) if at else None)
    assert len(got) == len(points)


def test_to_base(spark):
    day = 86_400
    rows = [("own", "EUR", t * day, 10.0) for t in range(2)]
    rows += [("usd", None, t * day, 12.0) for t in range(6)]
    rows += [("pence", "GBp", t * day, 900.0) for t in range(6)]
    rows += [("short", "USD", t * day, 5.0) for t in range(3, 5)] + [("none", "CHF", t * day, 5.0) for t in range(6)]
    prices = spark.createDataFrame(rows, "symbol string, currency string, ts bigint, px double")
    rates = spark.createDataFrame([("USD", 2 * day, 1.2), ("USD", 4 * day, 0.0), ("GBP", 0, 0.9)], "ccy string, ts bigint, rate double")
    got = {}
    for r in fx.to_base(prices, rates).collect():
        got.setdefault(r["symbol"], []).append((r["ts"] // day, round(r["px"], 6), r["currency"]))
    assert set(got) == {"own", "pence"}  # two points of usd and of short are left
    assert len(got["own"]) == 2 and len(got["pence"]) == 6
    assert all(p == (p[0], 10.0, "GBp") for p in got["pence"])
    got = {r["symbol"] for r in fx.to_base(prices, rates, least=2).collect()}
    assert "usd" in got and "none" not in got
    assert {r["ccy"] for r in fx.needed_currencies(prices).collect()} == {"GBP", "CHF", "USD"}


def test_ticker_cleaning(spark):
    lines = spark.createDataFrame([(v,) for v in [" brk.b ", "AAPL", "aapl", "", "symbol", "TOOLONGX", None, "nan"]], "value string")
    assert sorted(r["symbol"] for r in universe.clean_tickers(lines).collect()) == ["AAPL", "BRK-B"]
    rows = spark.createDataFrame([(" bf.b ",), ("X",), ("X",)], "Symbol string")
    assert sorted(r["symbol"] for r in universe.constituent_symbols(rows).collect()) == ["X", "X", "bf-b"]


def test_union_takes_the_first(spark):
    schema = "symbol string, r2 double, min5y double, mar double, quality double"
    a = spark.createDataFrame([("x", 0.9, 0.1, 0.1, 0.0), ("y", 0.8, 0.2, 0.2, 0.0)], schema)
    b = spark.createDataFrame([("y", 0.1, 0.1, 0.1, 0.0), ("z", 0.7, None, 0.0, 0.0)], schema)
    got = {r["symbol"]: r for r in universe.union_and_rank([a, b]).collect()}
    assert got["y"]["r2"] == 0.8 and len(got) == 3
    assert got["z"]["quality"] == pytest.approx(0.0)
    curves = [spark.createDataFrame([(s, m, 1.0) for m in range(n)], "symbol string, month_idx int, px double") for s, n in (("y", 3), ("y", 5))]
    assert universe.union_curves(curves).count() == 3


def test_first_curves(spark):
    """A symbol's rows are those of its first universe, also where that one has fewer months."""
    rows = [("x", 2, 1), ("x", 2, 2), ("x", 1, 2), ("y", 3, 1), ("y", 3, 5), (None, 0, 1), ("z", None, 1)]
    curves = spark.createDataFrame(rows, "symbol string, universe_ord int, month_idx int")
    assert sorted(tuple(r) for r in universe.first_curves(curves).collect()) == [("x", 1, 2), ("y", 3, 1), ("y", 3, 5)]


def test_curve_union_reads_prices_once_for_all_universes(spark):
    """No branch per universe: branches of a union share tasks, and each brings its own sorts and joins."""
    plan = queries.q_curve_union(spark, data("sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("lineitem.parquet") <= 2


def test_curve_union_of_suppliers_listed_twice(spark, tmp_path):
    for name in ("lineitem", "nation"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{data('sf0.001')}/{name}.parquet")
    suppliers = spark.read.parquet(f"{data('sf0.001')}/supplier.parquet")
    suppliers.union(suppliers).write.parquet(f"{tmp_path}/supplier.parquet")
    once, twice = (sorted(map(tuple, queries.q_curve_union(spark, d).collect())) for d in (data("sf0.001"), str(tmp_path)))
    assert once == twice and once


def test_choices():
    assert universe.select_universes(["STOXX600", "SP500"]) == ("SP500", "STOXX600")
    with pytest.raises(ValueError):
        universe.select_universes(["DAX"])
    with pytest.raises(ValueError):
        universe.select_universes([])
    assert universe.toggled(["SP500"], "SP500") == ("SP500",) and universe.toggled(["SP500"], "NYSE") == ("SP500", "NYSE")
    choice = universe.benchmark_of
    assert (choice(["SP500", "STOXX600"]), choice(["STOXX600"]), choice(["NYSE"]), choice(["NYSE", "SP500"])) == ("ACWI", "^STOXX", "^NYA", "^GSPC")


def test_benchmark_fallback_and_dropped(spark):
    benchmarks = spark.createDataFrame([("^NYA", 1, 2.0)], "symbol string, month_idx int, px double")
    own = spark.createDataFrame([(7, 9.0)], "month_idx int, px double")
    assert [tuple(r) for r in universe.choose_benchmark(benchmarks, ["NYSE"], own).collect()] == [(1, 2.0)]
    assert [tuple(r) for r in universe.choose_benchmark(benchmarks, ["SP500"], own).collect()] == [(7, 9.0)]
    a, b = (spark.createDataFrame([(s,) for s in x], "symbol string") for x in ("abc", "b"))
    assert universe.missing_count(a, b).first()["dropped"] == 2


def test_month_end_and_segments(spark):
    day = 86_400
    prices = spark.createDataFrame([("a", t * day, float(t + 1)) for t in range(0, 100, 3)], "symbol string, ts bigint, px double")
    monthly = month_end(prices)
    got = {r["month_idx"]: (r["ts"] // day, r["px"]) for r in monthly.collect()}
    assert got[1970 * 12] == (30, 31.0) and got[1970 * 12 + 1] == (57, 58.0) and len(got) == 4
    packed = to_segments(monthly.select("symbol", "month_idx", "px")).first()
    assert packed["start_month"] == "1970-01" and packed["p"][0] == 31.0
    back = from_segments(to_segments(monthly.select("symbol", "month_idx", "px")))
    assert {r["month_idx"]: r["px"] for r in back.collect()} == {m: p for m, (_, p) in got.items()}
    gap = monthly.where(f"month_idx <> {1970 * 12 + 1}")
    assert without_gaps(gap).count() == 0 and without_gaps(monthly).count() == 4

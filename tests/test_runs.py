"""Sources, sinks, whole runs, streaming, and the registered queries."""

import json
import math
import random
from dataclasses import replace
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sextant.operators.metrics import universe_metrics
from sextant.operators.quality import quality_score
from sextant.operators.resample import month_end
from sextant.params import BATCH, LIVE, MONTHLY, ScreenParams, Universe, WeightParams
from sextant.plans import explorer, portfolio
from sextant.sinks import artifacts as out
from sextant.sinks import snapshots, workbook
from sextant.sources import artifacts, chart_api, series, universes
from sextant.streaming import incremental

from .conftest import data

MONTH = 30 * 86_400
LOOSE = ScreenParams(min_years=5, tolerance_5y=-0.99, min_r2=0.0, min_cagr=None, max_drawdown=None, top_n=4, ppy=MONTHLY)


def payload(symbol, adjusted=None, close=None, currency="USD"):
    quote = {"quote": [{"close": close}]}
    if adjusted is not None:
        quote["adjclose"] = [{"adjclose": adjusted}]
    return {"chart": {"result": [{"meta": {"symbol": symbol, "currency": currency}, "timestamp": [1, 2, 3, 4], "indicators": quote}]}}


def test_payloads(spark, tmp_path):
    docs = [payload("a", [1.0, None, -2.0, 4.0], [9.0] * 4), payload("b", None, [1.0, 2.0, 0.0, None]), payload("c", None, [1.0, None, None, None]), {"chart": {"result": None}}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, docs)))
    got = sorted((r["symbol"], r["ts"], r["px"]) for r in series.read_payloads(spark, str(tmp_path)).collect())
    assert got == [("a", 1, 1.0), ("a", 4, 4.0), ("b", 1, 1.0), ("b", 2, 2.0)]
    assert [r[2:] for r in chart_api.payload_rows("a", docs[0])] == [(1, 1.0), (4, 4.0)]
    assert list(chart_api.payload_rows("c", docs[2])) == [] and list(chart_api.payload_rows("d", None)) == []


def test_downloads_take_turns_and_wait():
    import urllib.error

    asked, waits = [], []

    def get(url):
        asked.append(url.split("/")[2])
        if len(asked) == 1:
            raise urllib.error.HTTPError(url, 429, "busy", None, None)
        if len(asked) == 2:
            raise OSError("lost")
        return json.dumps(payload("x", [1.0] * 4)).encode()

    assert chart_api.fetch_series("x", ["http://one", "http://two"], get=get, sleep=waits.append)
    assert asked == ["one", "two", "one"] and waits == [0.8, 1.0]

    def gone(url):
        raise urllib.error.HTTPError(url, 404, "gone", None, None)

    assert chart_api.fetch_series("x", ["http://one"], get=gone, sleep=waits.append) is None


def test_chart_source_reads_by_partition(spark):
    reader = chart_api._Reader({"hosts": "http://a", "symbols": "x,y,z,x", "partitions": "2"})
    assert [p.value for p in reader.partitions()] == [["x", "z"], ["y"]]
    chart_api.register(spark)


def test_fx_pairs(spark):
    rows = [("EURUSD=X", 1, 1.1), ("EURCHF=X", 1, 0.9), ("AAPL", 1, 5.0)]
    prices = spark.createDataFrame(rows, "symbol string, ts bigint, px double")
    assert sorted((r["ccy"], r["rate"]) for r in series.fx_of(prices).collect()) == [("CHF", 0.9), ("USD", 1.1)]
    needed = spark.createDataFrame([("USD",), ("SEK",)], "ccy string")
    assert [r["ccy"] for r in series.missing_rates(needed, series.fx_of(prices)).collect()] == ["SEK"]


def test_universe_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("aapl\nBRK.B\nSymbol\n\n")
    (tmp_path / "table.csv").write_text("Symbol,Name\nA.B,x\nC,y\n")
    config = {
        "T": {"label": "Text", "benchmark": "^X", "txtSources": [str(tmp_path / "list.txt"), str(tmp_path / "none.txt")], "tickers": ["OWN"]},
        "C": {"label": "Table", "benchmark": "^X", "source": str(tmp_path / "table.csv"), "tickers": ["OWN"]},
        "F": {"label": "Gone", "benchmark": "^X", "source": str(tmp_path / "gone.csv"), "tickers": ["OWN"]},
    }
    (tmp_path / "u.json").write_text(json.dumps(config, indent=1))
    load = lambda u: sorted(r["symbol"] for r in universes.load_symbols(spark, universes.read_universe(spark, str(tmp_path / "u.json"), u)).collect())
    assert load("T") == ["AAPL", "BRK-B", "OWN"] and load("C") == ["A-B", "C", "OWN"] and load("F") == ["OWN"]
    with pytest.raises(ValueError):
        universes.read_universe(spark, str(tmp_path / "u.json"), "Z")
    assert isinstance(universes.read_universe(spark, str(tmp_path / "u.json"), "C"), Universe)


@pytest.fixture(scope="module")
def panel(spark):
    """Six noisy series of 180 months."""
    rnd = random.Random(3)
    rows = []
    for j in range(6):
        px = 100.0
        for i in range(180):
            px *= math.exp(0.004 + 0.002 * j + rnd.gauss(0, 0.04))
            rows.append((f"s{j}", int(datetime(1990 + i // 12, i % 12 + 1, 28, tzinfo=UTC).timestamp()), px))
    return spark.createDataFrame(rows, "symbol string, ts bigint, px double").repartition(4).cache()


MODE = replace(BATCH, ppy=MONTHLY, weights=WeightParams(scenarios=12, mean_block=3, ppy=MONTHLY, iterations=30, cap=0.5), least_returns=24, least_points=12, oos_min_years=6)


def test_batch_run_in_and_out_of_sample(spark, panel):
    rows = portfolio.ranked_universe(panel, MODE)
    built = portfolio.build_portfolio(rows, panel, LOOSE, MODE, usable=24)
    total = {r["scheme"]: r["t"] for r in built.weights.groupBy("scheme").agg(F.sum("weight").alias("t")).collect()}
    assert set(total) == {"equal", "invvol", "resampled"} and all(t == pytest.approx(1) for t in total.values())
    assert built.info().count() == 4
    bench = panel.where("symbol = 's0'").select("ts", "px")
    test = portfolio.backtest(built.prices, built.weights, bench, MODE)
    assert test.metrics.count() == 6 and test.with_edge().where("edge is null").count() == 0
    as_of = int(datetime(2003, 6, 1, tzinfo=UTC).timestamp())
    found = portfolio.out_of_sample(panel, LOOSE, as_of, bench, MODE, schemes=("equal", "invvol"), usable=24, survivor=12)
    assert found.backtest.metrics.count() == 4
    assert found.weights.groupBy("scheme").agg(F.sum("weight").alias("t")).where("abs(t - 1) > 1e-9").count() == 0
    assert portfolio.build_portfolio(rows, panel, replace(LOOSE, min_r2=2.0), MODE, usable=24) is None


def test_explorer(spark, panel):
    rows = quality_score(universe_metrics(panel, MONTHLY))
    monthly = month_end(panel).select("symbol", "month_idx", "px")
    bench = monthly.where("symbol = 's0'").select("month_idx", "px")
    build = explorer.recompute(rows, monthly.where("symbol <> 's5'"), LOOSE, bench, schemes=("equal", "invvol"))
    assert build.dropped.first()["dropped"] == 1 and build.metrics.count() == 4
    assert explorer.shown_curve(build.equity, "equal", held=True).count() == 180
    basket = explorer.recompute_from(["s1", "s2", "s1"], rows, monthly, schemes=("equal",))
    assert basket.picks.count() == 2 and explorer.active_build(["s1", "s2"], build, basket) is basket
    assert explorer.active_build(["s1"], build, None) is build
    mode = replace(LIVE, oos_min_years=6)
    later = explorer.recompute_oos(monthly, LOOSE, 2005 * 12, bench, mode, ("equal",))
    assert later.metrics.count() == 2 and later.equity.where("mode = 'rebal'").count() == 84 - 1
    figures = explorer.key_figures("equal", build, later, spark).first()
    assert figures["is_edge"] == pytest.approx(figures["is_cagr"] - figures["is_bench_cagr"])
    assert explorer.key_figures("equal", build, None, spark).first()["oos_cagr"] is None
    by_growth = explorer.recompute_oos(monthly, replace(LOOSE, sort_by="cagr", top_n=2), 2005 * 12, bench, mode, ("equal",))
    by_quality = explorer.recompute_oos(monthly, replace(LOOSE, top_n=2), 2005 * 12, bench, mode, ("equal",))
    assert {r["symbol"] for r in by_growth.picks.collect()} == {r["symbol"] for r in by_quality.picks.collect()}
    shown = explorer.screen_table(rows, replace(LOOSE, sort_by="cagr"), ["s1"], ascending=True)
    assert shown.columns == ["in_basket", "symbol", *explorer.SHOWN] and shown.count() == 4
    assert [r["cagr"] for r in shown.collect()] == sorted(r["cagr"] for r in shown.collect())
    assert [r["symbol"] for r in shown.where("in_basket").collect()] in ([], ["s1"])
    table = explorer.weight_table(build, "invvol").collect()
    assert table[0]["bar"] == 1.0 and [r["weight"] for r in table] == sorted((r["weight"] for r in table), reverse=True)
    assert explorer.recompute(rows, monthly, replace(LOOSE, min_r2=2.0), bench) is None


def test_artifacts_round_trip(spark, panel, tmp_path):
    rows = quality_score(universe_metrics(panel, MONTHLY))
    out.write_metrics(rows, str(tmp_path / "m"), universe="U", label="Test", updated="2020-01-01", params={"minYears": 15})
    back = artifacts.read_metrics(spark, str(tmp_path / "m"))
    assert back.count() == 6 and back.first()["universe"] == "U"
    want = {r["symbol"]: round(r["cagr"], 4) for r in rows.collect()}
    assert {r["symbol"]: r["cagr"] for r in back.collect()} == pytest.approx(want)
    out.write_curves(panel, str(tmp_path / "c"), "2020-01-01", panel.where("symbol = 's1'").select("ts", "px"))
    assert artifacts.read_curves(spark, str(tmp_path / "c")).count() == 6 * 180
    assert artifacts.read_bench_curve(spark, str(tmp_path / "c")).count() == 180
    out.benchmarks_document(panel, {"s0": "Zero"}, "2020-01-01").write.text(str(tmp_path / "b"))
    assert {r["label"] for r in artifacts.read_benchmarks(spark, str(tmp_path / "b")).collect()} == {"Zero"}
    assert artifacts.read_benchmarks(spark, str(tmp_path / "missing")).count() == 0
    out.write_table(rows, str(tmp_path / "t"), "A")
    out.write_table(rows.limit(2), str(tmp_path / "t"), "B")
    out.write_table(rows.limit(3), str(tmp_path / "t"), "B")
    assert {r["universe"]: r["count"] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("universe").count().collect()} == {"A": 6, "B": 3}


def test_portfolio_document(spark, panel):
    rows = portfolio.ranked_universe(panel, MODE)
    built = portfolio.build_portfolio(rows, panel, LOOSE, MODE, schemes=("equal",), usable=24)
    test = portfolio.backtest(built.prices, built.weights, None, MODE)
    universe = Universe("U", "A label", "^X")
    doc = json.loads(out.portfolio_document(built, test, None, universe, rows, LOOSE, "2020-01-01").first()["value"])
    assert (doc["universe"], doc["label"], doc["benchmark"], doc["params"]["min_years"], "oos" in doc) == ("U", "A label", "^X", 5.0, False)
    whole = doc["canonical"]
    best = [r["symbol"] for r in built.picks.orderBy(F.desc("quality")).collect()]
    assert [p["symbol"] for p in whole["picks"]] == best and whole["passed"] == 6 and whole["skipped"]["r2"] == 0
    assert whole["picks"][0]["w_equal"] == 0.25 and set(whole["picks"][0]) >= {"sd_equal", "cagr", "reg", "mar", "quality"}
    tested = whole["backtest"]
    assert len(tested["schemes"]) == 2 and len(tested["schemes"][0]["months"]) == 180 and tested["schemes"][0]["months"][0] == "1990-01"
    assert (tested["from"], tested["to"], "bench" in tested) == ("1990-01-28", "2004-12-28", False)
    bench = panel.where("symbol = 's0'").select("ts", "px")
    as_of = int(datetime(2003, 6, 1, tzinfo=UTC).timestamp())
    later = portfolio.out_of_sample(panel, LOOSE, as_of, bench, MODE, schemes=("equal", "invvol"), usable=24, survivor=12)
    inside = portfolio.backtest(built.prices, built.weights, bench, MODE)
    doc = json.loads(out.portfolio_document(built, inside, later, universe, rows, LOOSE, "2020-01-01", 6).first()["value"])
    assert len(doc["canonical"]["backtest"]["bench"]["values"]) == 180 and doc["canonical"]["backtest"]["bench_metrics"]["cagr"] is not None
    assert doc["oos"]["cutoff"] == "1996-06-02" and doc["oos"]["min_years"] == 6 and doc["oos"]["picks"][0]["w_resampled"] is None
    assert sum(p["w_invvol"] for p in doc["oos"]["picks"]) == pytest.approx(1)
    ranked = {r["symbol"]: r["quality"] for r in later.portfolio.picks.collect()}
    assert [p["symbol"] for p in doc["oos"]["picks"]] == sorted((p["symbol"] for p in doc["oos"]["picks"]), key=lambda s: -ranked[s])
    later.release()


def test_meta_upsert(spark, tmp_path):
    path = str(tmp_path / "meta")
    schema = "universe string, count bigint, eligible bigint, updated string"
    out.upsert_meta(spark.createDataFrame([("A", 1, 1, "x"), ("B", 2, 1, "x")], schema), path, "x")
    out.upsert_meta(spark.createDataFrame([("B", 5, 4, "y")], schema), path, "y")
    assert {tuple(r) for r in artifacts.read_meta(spark, path).collect()} == {("A", 1, 1, "x"), ("B", 5, 4, "y")}


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "snaps")
    base = {"universes": ["SP500"], "source": "screen", "scheme": "equal", "params": {"minR2": 0.9}, "note": "n" * 300, "picks": [("a", 0.5), ("b", 0.5)]}
    first = snapshots.save_snapshot(spark, path, base, datetime(2020, 1, 1))
    second = snapshots.save_snapshot(spark, path, {**base, "scheme": "invvol"}, datetime(2021, 1, 1))
    listed = snapshots.list_snapshots(spark, path).collect()
    assert [r["id"] for r in listed] == [second, first] and len(listed[0]["note"]) == 200
    assert snapshots.load_snapshot(spark, path, second) == {"scheme": "invvol", "universes": ["SP500"], "basket": ["a", "b"]}
    snapshots.delete_snapshot(spark, path, second)
    assert [r["id"] for r in snapshots.list_snapshots(spark, path).collect()] == [first]
    assert snapshots.load_snapshot(spark, path, second) is None


def test_versions_survive_a_kill_between_writes(spark, tmp_path, monkeypatch):
    """Whatever step of a replacement is the last one, readers see the old table or the new one."""
    from sextant import versions

    schema = "universe string, count bigint, eligible bigint, updated string"
    path = str(tmp_path / "meta")
    seen = lambda: {tuple(r) for r in artifacts.read_meta(spark, path).collect()}
    out.upsert_meta(spark.createDataFrame([("A", 1, 1, "x")], schema), path, "x")

    class Killed(Exception):
        pass

    def kill(*_):
        raise Killed

    with monkeypatch.context() as m, pytest.raises(Killed):
        m.setattr(versions, "_point", kill)  # after the data, before the pointer
        out.upsert_meta(spark.createDataFrame([("A", 2, 1, "y")], schema), path, "y")
    assert seen() == {("A", 1, 1, "x")}
    (tmp_path / "meta" / "_versions" / "2").write_text("data-half")  # while the pointer is written
    assert seen() == {("A", 1, 1, "x")} and versions.current(spark, path)[0] == 1
    with monkeypatch.context() as m, pytest.raises(Killed):
        m.setattr(versions, "_clear", kill)  # after the pointer
        out.upsert_meta(spark.createDataFrame([("B", 3, 1, "z")], schema), path, "z")
    assert seen() == {("A", 1, 1, "x"), ("B", 3, 1, "z")}
    for i in range(6):
        out.upsert_meta(spark.createDataFrame([("B", i, 1, "z")], schema), path, "z")
    assert len(list((tmp_path / "meta" / "_versions").glob("[0-9]*"))) == versions.KEPT


def test_a_save_during_a_delete_survives(spark, tmp_path, monkeypatch):
    from sextant import versions

    path = str(tmp_path / "snaps")
    base = {"universes": ["SP500"], "source": "screen", "scheme": "equal", "params": {}, "picks": [("a", 1.0)]}
    keys = [snapshots.save_snapshot(spark, path, base, datetime(2020, 1, i + 1)) for i in range(3)]
    plain, late = versions._point, []

    def slow(*args):
        if not late:
            late.append(True)
            late.append(snapshots.save_snapshot(spark, path, base, datetime(2021, 1, 1)))
        return plain(*args)

    monkeypatch.setattr(versions, "_point", slow)
    snapshots.delete_snapshot(spark, path, keys[0])
    assert {r["id"] for r in snapshots.list_snapshots(spark, path).collect()} == {keys[1], keys[2], late[1]}
    monkeypatch.setattr(snapshots, "MOST_FOLDERS", 2)
    more = snapshots.save_snapshot(spark, path, base, datetime(2022, 1, 1))
    assert snapshots.list_snapshots(spark, path).first()["id"] == more and len(versions.current(spark, path)[1]) <= 2


def test_documents_in_pieces(spark, panel, tmp_path, monkeypatch):
    """More series than a document holds: several documents, read back as one artifact."""
    monkeypatch.setattr(out, "PIECE", 2)
    rows = quality_score(universe_metrics(panel, MONTHLY))
    out.write_metrics(rows, str(tmp_path / "m"), universe="U", label="Test", updated="2020-01-01", params={})
    out.write_curves(panel, str(tmp_path / "c"), "2020-01-01", panel.where("symbol = 's0'").select("ts", "px"))
    assert len(list((tmp_path / "m").glob("part-*"))) > 1
    assert sorted(r["symbol"] for r in artifacts.read_metrics(spark, str(tmp_path / "m")).collect()) == [f"s{i}" for i in range(6)]
    assert artifacts.read_curves(spark, str(tmp_path / "c")).count() == 6 * 180
    assert artifacts.read_bench_curve(spark, str(tmp_path / "c")).count() == 180
    out.write_metrics(rows.limit(0), str(tmp_path / "m"), universe="U", label="Test", updated="2020-01-01", params={})
    assert artifacts.read_metrics(spark, str(tmp_path / "m")).count() == 0


def test_universe_of_many_series_loads(spark, tmp_path):
    n = 100_001
    ids = spark.range(n).select(F.format_string("S%06d", "id").alias("symbol"), "id")
    value = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0)
    rows = ids.select("symbol", F.lit(None).cast("string").alias("ccy"), F.lit(6000).cast("bigint").alias("days"), F.lit("a").alias("start"), F.lit("b").alias("end"),
                      *[value(i).alias(m) for i, m in enumerate(("cagr", "vol", "mdd", "min5y", "r2", "reg", "mar", "sortino", "sharpe", "score", "quality"))])
    folder = str(tmp_path / "data")
    out.write_table(out.rounded_metrics(rows).withColumn("updated", F.lit("2020-01-01")), f"{folder}/metrics", "SP500")
    segments = ids.select("symbol", F.lit("2000-01").alias("start_month"), F.array(F.lit(1.0), F.lit(2.0)).alias("p"))
    out.write_table(segments, f"{folder}/curves", "SP500")
    out.write_table(segments.limit(1), f"{folder}/bench", "SP500")
    out.upsert_meta(spark.createDataFrame([("SP500", n, n, "2020-01-01")], "universe string, count bigint, eligible bigint, updated string"), f"{folder}/meta", "x")
    library = explorer.Library(spark, folder)
    loaded = library.load(["SP500"])
    assert loaded.rows.count() == n and loaded.monthly.count() == 2 * n
    assert loaded.rows.agg(F.max("quality") - F.min("quality")).first()[0] > 0.5
    assert library.load(["SP500"]) is loaded
    out.upsert_meta(spark.createDataFrame([("SP500", n, n, "2020-01-02")], "universe string, count bigint, eligible bigint, updated string"), f"{folder}/meta", "x")
    again = library.load(["SP500"])
    assert again is not loaded and again.rows.count() == n
    library.release()
    assert not again.rows.storageLevel.useMemory


def test_workbook(spark, panel, tmp_path):
    rows = quality_score(universe_metrics(panel, MONTHLY))
    monthly = month_end(panel).select("symbol", "month_idx", "px")
    build = explorer.recompute(rows, monthly, LOOSE, schemes=("equal",))
    path = workbook.export(str(tmp_path), build, build.picks, ["SP500", "NYSE"], "equal", date(2020, 1, 2))
    assert path.endswith("SP500_NYSE_equal_20200102")
    read = lambda name, where=None: spark.read.option("header", True).csv(f"{where or path}/{name}")
    sheet = read("portfolio")
    assert sheet.columns == ["symbol", "weight_pct", "quality", "cagr_pct", "vol_pct", "mdd_pct", "min5y_pct", "r2", "reg_pct"]
    assert sheet.count() == 4 and sheet.first()["weight_pct"] == "25.0" and sheet.where("reg_pct is null").count() == 0
    assert [r["period"] for r in read("backtest").collect()] == ["in-sample"]
    assert read("screening").columns == ["symbol", "quality", "cagr_pct", "vol_pct", "mdd_pct", "min5y_pct", "r2", "reg_pct", "mar", "sortino"]
    later = explorer.recompute_oos(monthly, LOOSE, 2005 * 12, mode=replace(LIVE, oos_min_years=6), schemes=("equal",))
    both = workbook.export(str(tmp_path / "two"), build, build.picks, ["SP500"], "equal", date(2020, 1, 2), later)
    assert sorted(r["period"] for r in read("backtest", both).collect()) == ["in-sample", "out-of-sample"]
    build.release()
    assert build.metrics.count() == 2


def test_incremental_loading(spark, tmp_path):
    rows = [("a", "USD", i * MONTH, 100.0 + i) for i in range(40)]
    inbox, prices, metrics, state = (str(tmp_path / n) for n in ("in", "prices", "metrics", "state"))
    schema = "symbol string, currency string, ts bigint, px double"
    spark.createDataFrame(rows[:35], schema).coalesce(1).write.mode("append").parquet(inbox)
    incremental.load_prices(spark, inbox, prices, metrics, state, MONTHLY).awaitTermination()
    assert spark.read.parquet(metrics).first()["days"] == 35
    spark.createDataFrame([*rows[35:], ("a", "USD", 0, 50.0), ("b", "USD", 0, -1.0)], schema).coalesce(1).write.mode("append").parquet(inbox)
    incremental.load_prices(spark, inbox, prices, metrics, state, MONTHLY).awaitTermination()
    got = spark.read.parquet(metrics).collect()
    assert [(r["symbol"], r["days"]) for r in got] == [("a", 40)]
    assert spark.read.parquet(prices).count() == 41
    assert incremental.daily_closes(spark, inbox).isStreaming


def test_entry_and_oracles(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["metrics_all", "screen_picks", "fx_convert_asof", "backtest_metrics", "universe_union_rerank", "oos_equal"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"create view {t} as select * from '{data('sf0.001')}/{t}.parquet'")
    made = __spark_entry__.queries()[name](spark, data("sf0.001"))
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(made.columns)
    assert sorted(map(str, (tuple(r) for r in made.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_whole_batch_and_explorer(spark, tmp_path, caplog):
    """Two universes from raw series to stored artifacts and back to a combined portfolio."""
    from sextant.plans import batch

    rnd = random.Random(5)
    stamps = [int(datetime(1990 + i // 12, i % 12 + 1, 28, tzinfo=UTC).timestamp()) for i in range(180)]
    rows = []
    for symbol, ccy in [("A", "USD"), ("B", "USD"), ("C", "EUR"), ("D", "GBp"), ("E", "SEK"), ("^GSPC", "USD"), ("^STOXX", "EUR"), ("ACWI", "USD")]:
        px = 100.0
        for t in stamps:
            px *= math.exp(0.008 + rnd.gauss(0, 0.03))
            rows.append((symbol, ccy, t, px))
    rows += [(pair, None, t, rate) for pair, rate in (("EURUSD=X", 1.1), ("EURGBP=X", 0.9)) for t in stamps] + [("A", "USD", 1, float("nan"))]
    raw = spark.createDataFrame(rows, "symbol string, currency string, ts bigint, px double").cache()
    config = {"SP500": {"label": "US", "benchmark": "^GSPC", "tickers": ["A", "B", "C", "E"]}, "STOXX600": {"label": "EU", "benchmark": "^STOXX", "tickers": ["C", "D", "A"]}}
    (tmp_path / "u.json").write_text(json.dumps(config))
    folder, params = str(tmp_path / "data"), replace(LOOSE, min_years=5)
    as_of = int(datetime(2005, 1, 1, tzinfo=UTC).timestamp())
    caplog.set_level("INFO", "sextant.plans.batch")
    done = batch.run_all(spark, ["SP500", "STOXX600"], str(tmp_path / "u.json"), raw, folder, params, as_of, "2005-01-01", MODE, ("equal",))
    assert done == ["SP500", "STOXX600"]
    for words in ("SP500: 721 points read", "SP500: 1 points that aren't positive numbers", "no rates for SEK", "STOXX600 stored, 2 of 2 universes"):
        assert words in caplog.text
    assert batch.requested([]) == ("SP500",) and batch.requested(["BENCH"]) == ()
    meta = {r["universe"]: r["count"] for r in artifacts.read_meta(spark, f"{folder}/meta").collect()}
    assert meta == {"SP500": 3, "STOXX600": 3}  # no rate for E
    document = json.loads(spark.read.text(f"{folder}/portfolio_SP500", wholetext=True).first()["value"])
    assert {p["symbol"] for p in document["canonical"]["picks"]} == {"A", "B", "C"} and "oos" in document
    assert spark.read.parquet(f"{folder}/metrics").groupBy("universe").count().count() == 2
    assert {r["universe"]: r["n"] for r in spark.read.parquet(f"{folder}/curves").groupBy("universe").agg(F.count("p").alias("n")).collect()}["SP500"] > 0
    loaded = explorer.load(spark, folder, ["STOXX600", "SP500"])
    assert loaded.universes == ("SP500", "STOXX600") and loaded.updated.first()["updated"] == "2005-01-01"
    assert {r["symbol"]: r["universe"] for r in loaded.rows.collect()} == {"A": "SP500", "B": "SP500", "C": "SP500", "D": "STOXX600"}
    assert loaded.benchmark.count() == 180
    build = explorer.recompute(loaded.rows, loaded.monthly, replace(LOOSE, undefined_as_zero=True, min_r2=-1), loaded.benchmark, schemes=("equal",))
    assert build.metrics.count() == 2 and build.with_edge().where("edge is null").count() == 0
    watched, seen = batch.counted(raw, "quality")
    watched.count()
    assert seen.get["unusable"] == 1

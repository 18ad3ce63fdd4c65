import json
import time

from pyspark.sql import functions as F

from sextant.plans.batch import download_raw
from sextant.sources.chart_api import download


def answer(url: str) -> bytes:
    """Two points whose price is the time of the answer; ``SLOW`` takes long, ``GONE`` isn't there."""
    symbol = url.split("/chart/")[1].split("?")[0]
    if symbol == "SLOW":
        time.sleep(3)
    if symbol.startswith("GONE"):
        return b'{"chart": {"result": null}}'
    currency = "EUR" if symbol.startswith("EUR") else "GBp" if symbol == "LSE" else "USD"
    now = time.time()
    return json.dumps({"chart": {"result": [{"meta": {"currency": currency}, "timestamp": [1, 2], "indicators": {"quote": [{"close": [now, now]}]}}]}}).encode()


def test_each_symbol_once(spark):
    names = [("A",), ("B",), ("A",), (None,), ("",), ("GONE",)]
    rows = download(spark.createDataFrame(names, "symbol string"), ["http://h"], get=answer, per_second=1000).collect()
    assert sorted((r["symbol"], r["ts"], r["currency"]) for r in rows) == [(s, t, "USD") for s in "AB" for t in (1, 2)]


def test_no_symbols(spark):
    none = spark.createDataFrame([], "symbol string")
    assert download(none, ["http://h"], get=answer).collect() == []


def test_a_slow_symbol_holds_up_its_task_only(spark):
    names = [(f"S{i}",) for i in range(60)] + [("SLOW",)]
    rows = download(spark.createDataFrame(names, "symbol string"), ["http://h"], get=answer, per_second=1000, per_task=4)
    at = {r["symbol"]: r["px"] for r in rows.where("ts = 1").collect()}
    assert len(at) == 61
    assert sum(t > at["SLOW"] for t in at.values()) <= 8  # of its own task; hashing may fill one twice over


def test_the_run_keeps_the_pace(spark):
    names = spark.createDataFrame([(f"S{i}",) for i in range(40)], "symbol string")
    rows = download(names, ["http://h"], get=answer, per_second=10, per_task=1)
    at = sorted(r["px"] for r in rows.where("ts = 1").collect())
    cores = spark.sparkContext.defaultParallelism
    # From one request to the next on a core lie cores / 10 seconds, so no second has more than 10 and a first round.
    assert max(sum(t <= u < t + 1 for u in at) for t in at) <= 10 + 2 * cores


def test_rates_follow_the_currencies(spark, tmp_path):
    symbols = spark.createDataFrame([("A",), ("LSE",)], "symbol string")
    raw = download_raw(symbols, ["^X"], ["http://h"], str(tmp_path / "raw"), get=answer, per_second=1000)
    assert {r["symbol"] for r in raw.select("symbol").distinct().collect()} == {"A", "LSE", "^X", "EURUSD=X", "EURGBP=X"}
    # Stored: reading twice gives the same prices, which are times here.
    assert raw.agg(F.sum("px")).first() == raw.agg(F.sum("px")).first()

"""Schemas of the tables and artifacts; none is inferred."""

from __future__ import annotations

PRICES = "symbol string, currency string, ts bigint, px double"
FX = "ccy string, ts bigint, rate double"
CHART_PAYLOAD = (
    "chart struct<result: array<struct<meta: struct<symbol: string, currency: string>, timestamp: array<bigint>,"
    " indicators: struct<adjclose: array<struct<adjclose: array<double>>>, quote: array<struct<close: array<double>>>>>>>"
)
METRIC_NAMES = ("cagr", "vol", "mdd", "min5y", "r2", "reg", "mar", "sortino", "sharpe", "score", "quality")
METRICS = "symbol string, ccy string, days bigint, start string, end string, " + ", ".join(f"{m} double" for m in METRIC_NAMES)
METRICS_FILE = (
    "updated string, base string, universe string, label string, params map<string, double>, count bigint,"
    " rows array<struct<t: string, ccy: string, days: bigint, start: string, end: string, "
    + ", ".join(f"{m}: double" for m in METRIC_NAMES)
    + ">>"
)
SEGMENT = "struct<s: string, p: array<double>>"
CURVES_FILE = f"updated string, base string, freq string, series map<string, {SEGMENT}>, bench {SEGMENT}"
BENCHMARKS_FILE = "updated string, base string, series map<string, struct<label: string, s: string, p: array<double>>>"
META_FILE = "updated string, universes map<string, struct<count: bigint, eligible: bigint, updated: string>>"
UNIVERSES_FILE = "map<string, struct<label: string, benchmark: string, source: string, txtSources: array<string>, tickers: array<string>>>"
WEIGHTS = "scheme string, symbol string, weight double, wstd double, scenarios bigint"
EQUITY = "scheme string, mode string, ts bigint, value double"
SNAPSHOTS = (
    "id string, universes array<string>, source string, scheme string, params map<string, double>, note string,"
    " picks array<struct<t: string, w: double>>, metrics_is map<string, double>, metrics_oos map<string, double>, created_at timestamp"
)

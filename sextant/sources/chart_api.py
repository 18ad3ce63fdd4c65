"""Downloads of chart series: a Spark data source for a short list, ``download`` for a table of symbols.

``spark.read.format("chart_series").options(hosts=..., symbols=...)`` yields price
rows. Partitions take the place of a pool of workers: ``partitions`` bounds how
many downloads run at once and ``pause_ms`` spaces those of a partition.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import PRICES

#: Symbols of a task: a slow one holds up no more than these, and a lost executor asks for no more of them again.
SYMBOLS_PER_TASK = 8
#: Requests a second of a whole run.
PER_SECOND = 35.0

#: Waits in seconds per attempt, and answers worth another try.
BUSY_WAIT, ERROR_WAIT = 0.8, 0.5
BUSY = (429, 503)


def _get(url: str) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=30) as reply:
        return reply.read()


def fetch_series(
    symbol: str,
    hosts: list[str],
    interval: str = "1d",
    retries: int = 3,
    get: Callable[[str], bytes] = _get,
    sleep: Callable[[float], None] = time.sleep,
) -> dict | None:
    """The payload of one symbol's whole history, None if it can't be had.

    Hosts take turns. A busy answer and a failed connection are tried again after
    a wait that grows; any other HTTP error ends it.
    """
    query = f"/v8/finance/chart/{urllib.parse.quote(symbol)}?period1=0&period2={int(time.time())}&interval={interval}&events=div%2Csplit"
    for attempt in range(retries):
        try:
            return json.loads(get(hosts[attempt % len(hosts)].rstrip("/") + query))
        except urllib.error.HTTPError as error:
            if error.code not in BUSY:
                return None
            sleep(BUSY_WAIT * (attempt + 1))
        except (OSError, ValueError):
            sleep(ERROR_WAIT * (attempt + 1))
    return None


def payload_rows(symbol: str, payload: dict | None) -> Iterator[tuple]:
    """Price rows of one payload; series of under two good points give none."""
    result = ((payload or {}).get("chart") or {}).get("result") or []
    if not result:
        return
    series = result[0]
    indicators = series.get("indicators") or {}
    adjusted = ((indicators.get("adjclose") or [{}])[0] or {}).get("adjclose")
    closes = adjusted or ((indicators.get("quote") or [{}])[0] or {}).get("close") or []
    points = [
        (int(t), float(p)) for t, p in zip(series.get("timestamp") or [], closes, strict=False) if t is not None and p is not None and 0 < p < float("inf")
    ]
    if len(points) >= 2:
        currency = (series.get("meta") or {}).get("currency")
        yield from ((symbol, currency, t, p) for t, p in points)


def download(
    symbols: DataFrame,
    hosts: list[str],
    interval: str = "1d",
    per_second: float = PER_SECOND,
    per_task: int = SYMBOLS_PER_TASK,
    get: Callable[[str], bytes] = _get,
) -> DataFrame:
    """Price rows of the table ``symbols(symbol)``, each symbol once; null and empty ones, and those that can't be had, give none.

    Tasks are short, so a core that is free takes the next few symbols and a slow one
    holds up only those of its task. The pace is that of the run: each core leaves
    ``cores / per_second`` seconds from one request to the next, cores being those known
    at the start. The rows are downloaded whenever they are read, so store them first.
    """
    named = symbols.select("symbol").where("symbol <> ''").distinct()
    tasks = max(1, -(-named.count() // per_task))
    pause = symbols.sparkSession.sparkContext.defaultParallelism / per_second

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for symbol in batch["symbol"]:
                began = time.monotonic()
                rows = list(payload_rows(symbol, fetch_series(symbol, hosts, interval, get=get)))
                if rows:
                    yield pd.DataFrame(rows, columns=["symbol", "currency", "ts", "px"])
                time.sleep(max(0.0, pause - (time.monotonic() - began)))

    return named.repartition(tasks).mapInPandas(fetch, PRICES)


class _Symbols(InputPartition):
    def __init__(self, symbols: list[str]):
        super().__init__(symbols)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.hosts = options["hosts"].split(",")
        self.symbols = [s for s in dict.fromkeys(options["symbols"].split(",")) if s]
        self.count = int(options.get("partitions", "6"))
        self.pause = int(options.get("pause_ms", "120")) / 1000
        self.interval = options.get("interval", "1d")

    def partitions(self) -> list[InputPartition]:
        return [_Symbols(self.symbols[i :: self.count]) for i in range(min(self.count, len(self.symbols)))] or [_Symbols([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for symbol in partition.value:
            yield from payload_rows(symbol, fetch_series(symbol, self.hosts, self.interval))
            time.sleep(self.pause)


class ChartSeriesSource(DataSource):
    """Format ``chart_series``."""

    @classmethod
    def name(cls) -> str:
        return "chart_series"

    def schema(self) -> str:
        return PRICES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChartSeriesSource)

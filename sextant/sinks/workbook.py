"""The three sheets of an export, each written as CSV."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import defined
from ..plans.explorer import Build, weight_table


def percent(name: str) -> Column:
    return F.round(defined(F.col(name)) * 100, 2).alias(f"{name}_pct")


def ratio(name: str) -> Column:
    return F.round(defined(F.col(name)), 3).alias(name)


def portfolio_sheet(build: Build, scheme: str) -> DataFrame:
    """The picks with their weights in the scheme, best quality first."""
    rows = weight_table(build, scheme).orderBy(defined(F.col("quality")).desc_nulls_last(), "symbol")
    shown = [percent(c) for c in ("cagr", "vol", "mdd", "min5y")]
    return rows.select("symbol", percent("weight"), ratio("quality"), *shown, ratio("r2"), percent("reg"))


def backtest_sheet(inside: Build | None, outside: Build | None, scheme: str) -> DataFrame | None:
    """Rebalanced metrics of the scheme in and out of sample, a row for each that there is."""
    sheet = None
    for period, build in (("in-sample", inside), ("out-of-sample", outside)):
        if build is not None:
            row = build.metrics.where((F.col("scheme") == scheme) & (F.col("mode") == "rebal"))
            row = row.select(F.lit(period).alias("period"), percent("cagr"), percent("vol"), percent("mdd"), ratio("sharpe"), ratio("mar"))
            sheet = row if sheet is None else sheet.unionByName(row)
    return sheet


def screening_sheet(shown: DataFrame) -> DataFrame:
    """The rows as displayed."""
    numbers = [percent(c) for c in ("cagr", "vol", "mdd", "min5y")]
    return shown.select("symbol", ratio("quality"), *numbers, ratio("r2"), percent("reg"), ratio("mar"), ratio("sortino"))


def export_name(universes: Sequence[str], scheme: str, day: date) -> str:
    return f"{'_'.join(universes)}_{scheme}_{day:%Y%m%d}"


def export(folder: str, build: Build, shown: DataFrame, universes: Sequence[str], scheme: str, day: date, outside: Build | None = None) -> str:
    """Write the sheets under a folder named after the choice, and return it."""
    path = f"{folder}/{export_name(universes, scheme, day)}"
    sheets = {"portfolio": portfolio_sheet(build, scheme), "backtest": backtest_sheet(build, outside, scheme), "screening": screening_sheet(shown)}
    for name, sheet in sheets.items():
        sheet.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    return path

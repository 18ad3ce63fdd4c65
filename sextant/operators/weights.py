"""Covariances, and portfolio weights under three schemes.

A portfolio has a few dozen members at most (the screen's ``top_n``), while its
return table may be long. Everything that reads the returns is an aggregate;
what is collected per portfolio is one value or one row per member.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import capped_simplex
from ..functions.numeric import Stream, bootstrap_blocks, max_sharpe, portfolio_stats, project
from ..params import WeightParams
from ..schemas import WEIGHTS
from .ordering import numbered

#: Members of a tile of the covariance matrix, and dates of a block of resampled returns.
MEMBERS, BLOCK_ROWS = 512, 1024


def col_means(returns: DataFrame) -> DataFrame:
    """``(symbol, mean_ret)``."""
    return returns.groupBy("symbol").agg(F.avg("ret").alias("mean_ret"))


def cov_matrix(returns: DataFrame, members_per_tile: int = MEMBERS) -> DataFrame:
    """``(a, b, cov)`` for each pair ``a <= b``: the sample covariance over common dates, 0 for a single one.

    Dates are dealt to as many blocks as shuffles have partitions. A task takes the
    products of a block for two tiles of ``members_per_tile`` members, and what leaves it
    are sums per pair, not products per date; the sums of the blocks are then added. A
    row is sent once for each tile it meets.
    """
    spark = returns.sparkSession
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    members = returns.agg(F.approx_count_distinct("symbol")).first()[0]
    tiles = -(-int(members * 1.1) // members_per_tile) or 1
    own = F.pmod(F.xxhash64("symbol"), F.lit(tiles)).cast("int")
    rows = returns.where("ret is not null").select(F.pmod(F.xxhash64("ts"), F.lit(blocks)).cast("int").alias("block"), "ts", "symbol", "ret", own.alias("own"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))) if tiles > 1 else rows.withColumn("other", F.col("own"))
    met = met.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def products(part: pd.DataFrame) -> pd.DataFrame:
        at, day = np.unique(part["ts"].to_numpy(), return_inverse=True)
        symbols, column = np.unique(part["symbol"].to_numpy(dtype=object), return_inverse=True)
        x, there = np.zeros((len(at), len(symbols))), np.zeros((len(at), len(symbols)))
        x[day, column], there[day, column] = part["ret"].to_numpy(), 1.0
        tile = np.zeros(len(symbols), int)
        tile[column] = part["own"].to_numpy()
        low, high = int(part["low"].iloc[0]), int(part["high"].iloc[0])
        i, j = np.triu_indices(len(symbols))
        wanted = (np.minimum(tile[i], tile[j]) == low) & (np.maximum(tile[i], tile[j]) == high)
        i, j = i[wanted], j[wanted]
        n, sums, both = (there.T @ there)[i, j], x.T @ there, (x.T @ x)[i, j]
        sx, sy = sums[i, j], sums[j, i]
        some = n > 0
        between = np.divide(sx * sy, n, out=np.zeros_like(n), where=some)
        columns = {"a": symbols[i], "b": symbols[j], "n": n, "sx": sx, "sy": sy, "between": between, "inside": both - between}
        return pd.DataFrame({k: v[some] for k, v in columns.items()})

    sums = met.groupBy("block", "low", "high").applyInPandas(products, "a string, b string, n double, sx double, sy double, between double, inside double")
    total = sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "between", "inside")])
    moved = F.col("inside") + F.col("between") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    return total.select("a", "b", F.when(F.col("n") > 1, moved / (F.col("n") - 1)).otherwise(0.0).alias("cov"))


def equal_weights(symbols: DataFrame) -> DataFrame:
    """1/n each."""
    every = Window.partitionBy()
    return symbols.select(
        F.lit("equal").alias("scheme"),
        "symbol",
        (F.lit(1.0) / F.count(F.lit(1)).over(every)).alias("weight"),
        F.lit(0.0).alias("wstd"),
        F.lit(0).cast("bigint").alias("scenarios"),
    )


def inverse_vol_weights(returns: DataFrame, floor: float = 0.02, cap: float = 0.20) -> DataFrame:
    """Inverse volatility, moved into the box and made to add up to 1 again.

    A box that can't add up to 1 gives equal weights, since all parts end at the cap.
    """
    risk = returns.groupBy("symbol").agg(F.sqrt(F.greatest(F.coalesce(F.var_samp("ret"), F.lit(0.0)), F.lit(1e-12))).alias("sd"))
    members = risk.agg(F.array_sort(F.collect_list(F.struct("symbol", (F.lit(1.0) / F.col("sd")).alias("v")))).alias("m"))
    shares = members.withColumn("total", F.aggregate("m.v", F.lit(0.0), lambda a, x: a + x))
    shares = shares.withColumn("w", capped_simplex(F.transform("m.v", lambda x: x / F.col("total")), floor, cap))
    shares = shares.withColumn("total", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    each = shares.select(F.explode(F.arrays_zip(F.col("m.symbol").alias("symbol"), F.col("w").alias("w"))).alias("x"), "total")
    return each.select(
        F.lit("invvol").alias("scheme"),
        F.col("x.symbol").alias("symbol"),
        (F.col("x.w") / F.col("total")).alias("weight"),
        F.lit(0.0).alias("wstd"),
        F.lit(0).cast("bigint").alias("scenarios"),
    )


def renormalised(weights: DataFrame, kept: DataFrame) -> DataFrame:
    """The weights of the kept symbols, scaled to add up to 1 in each scheme."""
    left = weights.join(kept.select("symbol").distinct(), "symbol", "left_semi")
    return left.withColumn("weight", F.try_divide("weight", F.sum("weight").over(Window.partitionBy("scheme"))))


def max_sharpe_weights(returns: DataFrame, params: WeightParams) -> DataFrame:
    """``(symbol, weight, ret, vol, sharpe)``: the weights of the best Sharpe ratio over the whole sample.

    Means and covariances are aggregates; a task optimises on these, members squared.
    """
    means = col_means(returns).agg(F.array_sort(F.collect_list(F.struct("symbol", "mean_ret"))).alias("m"))
    pairs = cov_matrix(returns).agg(F.array_sort(F.collect_list(F.struct("a", "b", "cov"))).alias("c"))
    moments = means.join(F.broadcast(pairs), F.lit(True))  # one row each
    moments = moments.select(F.col("m.symbol").alias("symbols"), F.col("m.mean_ret").alias("mu"), F.col("c.cov").alias("cov"))

    def optimise(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for symbols, mu, half in zip(batch["symbols"], batch["mu"], batch["cov"], strict=True):
                k = len(symbols)
                if not k:
                    continue
                cov = np.zeros((k, k))
                cov[np.triu_indices(k)] = half
                cov = (cov + np.triu(cov, 1).T) * params.ppy
                w = max_sharpe(mu * params.ppy, cov, params.rf, params.floor, params.cap, params.iterations)
                gain, vol, ratio = portfolio_stats(w, mu * params.ppy, cov, params.rf)
                yield pd.DataFrame({"symbol": list(symbols), "weight": w, "ret": gain, "vol": vol, "sharpe": ratio})

    return moments.mapInPandas(optimise, "symbol string, weight double, ret double, vol double, sharpe double")


def scenario_counts(spark: SparkSession, rows: int, params: WeightParams) -> DataFrame:
    """``(scenario, row, times)``: how often each bootstrap sample of ``rows`` rows takes each of them.

    Samples are blocks of rows from one seeded stream in order, so a seed gives the same
    ones whatever the number of tasks. The driver makes the blocks, some
    ``scenarios * window / mean_block`` of them whatever the data's size; Spark spells them out.
    """
    blocks = bootstrap_blocks(rows, params.window(rows), params.mean_block, params.scenarios, Stream(params.seed or 12345))
    frame = spark.createDataFrame(pd.DataFrame(dict(zip(("scenario", "first", "size"), blocks, strict=True))), "scenario int, first bigint, size bigint")
    spelled = frame.select("scenario", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("at"))
    return spelled.groupBy("scenario", (F.col("at") % rows).alias("row")).agg(F.count(F.lit(1)).alias("times"))


def scenario_moments(returns: DataFrame, params: WeightParams, rows_per_block: int = BLOCK_ROWS) -> DataFrame:
    """``(scenario, symbols, mu, cov)``: each bootstrap sample's yearly means and covariances, members in order.

    A sample is a count per date, so its sums are the product of the sparse table of
    counts with the returns. Dates are numbered and cut into blocks; a task multiplies
    a block's returns with the counts of all samples there and gives out, per sample, a
    sum and a matrix of products. A sample has at most as many blocks as its window has
    rows. Nothing is collected, and no task holds more than a block or a sample.
    """
    dates = returns.groupBy("ts").agg(F.array_sort(F.collect_list(F.struct("symbol", "ret"))).alias("r"))
    rows = dates.count()
    dated = numbered(dates, "ts", "row", rows)
    block = F.floor(F.col("row") / rows_per_block)
    cells = dated.select(block.alias("block"), "row", F.col("r.symbol").alias("symbols"), F.col("r.ret").alias("ret"))
    drawn = scenario_counts(returns.sparkSession, rows, params).withColumn("block", block)

    def products(cells: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        if cells.empty or drawn.empty:
            return pd.DataFrame([], columns=["scenario", "symbols", "n", "sums", "products"])
        cells = cells.sort_values("row")
        x = np.array(cells["ret"].tolist(), float)
        at = np.searchsorted(cells["row"].to_numpy(), drawn["row"].to_numpy())
        times = drawn["times"].to_numpy(float)
        order = np.argsort(drawn["scenario"].to_numpy(), kind="stable")
        scenarios, first = np.unique(drawn["scenario"].to_numpy()[order], return_index=True)
        out = []
        for s, part in zip(scenarios.tolist(), np.split(order, first[1:]), strict=True):
            taken, n = x[at[part]], times[part]
            out.append((s, cells["symbols"].iloc[0], n.sum(), n @ taken, ((taken * n[:, None]).T @ taken).ravel()))
        return pd.DataFrame(out, columns=["scenario", "symbols", "n", "sums", "products"])

    def moments(parts: pd.DataFrame) -> pd.DataFrame:
        n, sums = parts["n"].sum(), np.sum(parts["sums"].tolist(), axis=0)
        k = len(sums)
        mu = sums / n
        cov = (np.sum(parts["products"].tolist(), axis=0).reshape(k, k) - n * np.outer(mu, mu)) / (n - 1 or 1)
        row = (parts["scenario"].iloc[0], parts["symbols"].iloc[0], mu * params.ppy, (cov * params.ppy).ravel())
        return pd.DataFrame([row], columns=["scenario", "symbols", "mu", "cov"])

    partial = "scenario int, symbols array<string>, n double, sums array<double>, products array<double>"
    summed = cells.groupBy("block").cogroup(drawn.groupBy("block")).applyInPandas(products, partial)
    return summed.groupBy("scenario").applyInPandas(moments, "scenario int, symbols array<string>, mu array<double>, cov array<double>")


def resampled_scenarios(returns: DataFrame, params: WeightParams) -> DataFrame:
    """``(scenario, symbols, w)``: the best weights of each bootstrap sample, optimised where Spark puts them."""

    def optimise(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                mu = np.array(batch["mu"].tolist())
                cov = np.array(batch["cov"].tolist()).reshape(len(mu), mu.shape[1], mu.shape[1])
                best = max_sharpe(mu, cov, params.rf, params.floor, params.cap, params.iterations)
                yield pd.DataFrame({"scenario": batch["scenario"], "symbols": batch["symbols"], "w": list(best)})

    return scenario_moments(returns, params).mapInPandas(optimise, "scenario int, symbols array<string>, w array<double>")


def resampled_weights(returns: DataFrame, params: WeightParams) -> DataFrame:
    """The mean of the scenarios' weights, moved into the box and scaled to 1.

    ``wstd`` is their standard deviation before that. Fewer than ten usable
    scenarios give equal weights.
    """
    scenarios = resampled_scenarios(returns, params)
    usable = scenarios.where(F.forall("w", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    parts = usable.select(F.explode(F.arrays_zip(F.col("symbols").alias("symbol"), F.col("w").alias("w"))).alias("x")).select("x.symbol", "x.w")
    stats = parts.groupBy("symbol").agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("sd"), F.count(F.lit(1)).alias("n"))
    found = sorted((r["symbol"], r["mean"], r["sd"], r["n"]) for r in stats.collect())  # a row per member
    ok = found[0][3] if found else 0
    if ok < 10:
        found = [(r["symbol"], None, 0.0, ok) for r in returns.select("symbol").distinct().orderBy("symbol").collect()]
        if not found:
            return returns.sparkSession.createDataFrame([], WEIGHTS)
    mean = np.array([m for _, m, _, _ in found]) if ok >= 10 else np.full(len(found), 1 / len(found))
    w = project(mean, params.floor, params.cap)
    w = w / w.sum()
    rows = [("resampled", symbol, float(x), float(sd), int(ok)) for (symbol, _, sd, _), x in zip(found, w, strict=True)]
    return returns.sparkSession.createDataFrame(rows, WEIGHTS)


def compute_weights(scheme: str, returns: DataFrame, params: WeightParams) -> DataFrame:
    """``WEIGHTS`` rows of one scheme; any name but ``equal`` and ``invvol`` is resampled."""
    if scheme == "equal":
        return equal_weights(returns.select("symbol").distinct())
    if scheme == "invvol":
        return inverse_vol_weights(returns, params.floor, params.cap)
    return resampled_weights(returns, params)


def all_weights(returns: DataFrame, params: WeightParams, schemes: Iterable[str] = ("equal", "invvol", "resampled")) -> DataFrame:
    out: DataFrame | None = None
    for scheme in schemes:
        one = compute_weights(scheme, returns, params)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no scheme")
    return out


def portfolio_statistics(weights: DataFrame, returns: DataFrame, params: WeightParams) -> DataFrame:
    """``(scheme, expected_return, volatility, sharpe)`` of weights from the returns' means and covariances."""
    mean = col_means(returns).join(weights, "symbol").groupBy("scheme")
    gain = mean.agg((F.sum(F.col("weight") * F.col("mean_ret")) * params.ppy).alias("expected_return"))
    by_a = weights.select("scheme", F.col("symbol").alias("a"), F.col("weight").alias("wa"))
    by_b = weights.select(F.col("scheme").alias("scheme_b"), F.col("symbol").alias("b"), F.col("weight").alias("wb"))
    terms = cov_matrix(returns).join(by_a, "a").join(by_b, "b").where("scheme = scheme_b")
    twice = F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    risk = terms.groupBy("scheme").agg(F.sqrt(F.greatest(F.sum(twice * F.col("wa") * F.col("wb") * F.col("cov")), F.lit(0.0)) * params.ppy).alias("volatility"))
    return gain.join(risk, "scheme").withColumn("sharpe", F.try_divide(F.col("expected_return") - params.rf, F.col("volatility")))

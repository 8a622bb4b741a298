"""A volatility-targeting backtest."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG

YEAR = float(CONFIG.days_a_year)


def positions(forecasts: DataFrame, returns: DataFrame, models: list[str]) -> DataFrame:
    """model, pos, date, weight, turnover, r_next, net. r_next is the next day's return on the full calendar, whose pos counts; weights of days without one still count for turnover.

    forecasts: ticker, date and a column a model. returns: ticker, pos, date, r of every day.
    """
    from ..functions.win import by_pos

    ahead = returns.select("ticker", "date", "pos", F.lead("r").over(by_pos()).alias("r_next"))
    days = forecasts.drop("pos").join(ahead, ["ticker", "date"])
    long = days.unpivot(["ticker", "pos", "date", "r_next"], [f"`{m}`" for m in models], "model", "forecast").where("forecast is not null")
    weight = F.least(F.lit(CONFIG.most_leverage), CONFIG.target_vol / F.sqrt(F.exp("forecast") * YEAR))
    order = Window.partitionBy("model").orderBy("pos")
    out = long.withColumn("weight", weight).withColumn("turnover", F.coalesce(F.abs(F.col("weight") - F.lag("weight").over(order)), F.lit(0.0)))
    return out.withColumn("net", F.col("weight") * F.col("r_next") - CONFIG.cost * F.col("turnover")).drop("forecast")


def with_benchmark(held: DataFrame, name: str = "Buy&Hold") -> DataFrame:
    one = held.groupBy("ticker", "pos", "date").agg(F.first("r_next").alias("r_next"))
    return held.unionByName(one.select("ticker", "pos", "date", "r_next", F.lit(name).alias("model"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("turnover"), F.col("r_next").alias("net")))


def equity(held: DataFrame) -> DataFrame:
    """model, pos, date, net, equity, drawdown (against the highest equity so far, without the starting 1)."""
    so_far = Window.partitionBy("model").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    grown = held.where("net is not null").withColumn("equity", F.product(1 + F.col("net")).over(so_far))
    return grown.withColumn("drawdown", F.col("equity") / F.max("equity").over(so_far) - 1).select("model", "pos", "date", "net", "equity", "drawdown")


def performance(held: DataFrame, benchmark: str = "Buy&Hold") -> DataFrame:
    """A row per model, best Sharpe first."""
    base = held.where((F.col("model") == benchmark) & F.col("net").isNotNull()).select("pos", F.col("net").alias("bench"))
    curve = equity(held).join(base, "pos", "left").withColumn("active", F.col("net") - F.col("bench"))
    root = math.sqrt(YEAR)
    stats = curve.groupBy("model").agg(
        (F.avg("net") * YEAR).alias("ann_ret"), (F.stddev_samp("net") * root).alias("ann_vol"), F.min("drawdown").alias("max_dd"),
        F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), (F.avg("active") * YEAR).alias("a"), (F.stddev_samp("active") * root).alias("b"), F.count(F.lit(1)).alias("days"),
    )
    use = held.groupBy("model").agg(F.avg("weight").alias("avg_lev"), (F.avg("turnover") * YEAR).alias("turnover_yr"))
    out = stats.join(use, "model")
    none = F.lit(0.0)
    return out.select(
        "model", "ann_ret", "ann_vol", (F.col("ann_ret") / F.nullif("ann_vol", none)).alias("sharpe"), "max_dd", (F.col("ann_ret") / F.nullif(F.abs("max_dd"), none)).alias("calmar"),
        "win_rate", F.when(F.col("b") > 1e-12, F.col("a") / F.nullif("b", none)).alias("ir"), "avg_lev", "turnover_yr", "days",
    ).orderBy(F.desc("sharpe"), "model")


def attribution(held: DataFrame, labels: DataFrame, least: int = 50) -> DataFrame:
    """model, sharpe_Low, sharpe_Medium, sharpe_High (of more than `least` days) and the share of profit made in High. labels: pos, regime."""
    rows = held.where("net is not null").join(labels, "pos", "left")
    root = math.sqrt(YEAR)
    made = []
    for name in ("Low", "Medium", "High"):
        of = F.when(F.col("regime") == name, F.col("net"))
        made.append(F.when(F.count(of) > least, F.avg(of) / F.nullif(F.stddev_samp(of), F.lit(0.0)) * root).alias(f"sharpe_{name}"))
    share = F.sum(F.when(F.col("regime") == "High", F.col("net")).otherwise(0.0)) / F.nullif(F.sum("net"), F.lit(0.0))
    return rows.groupBy("model").agg(*made, share.alias("share_high"))

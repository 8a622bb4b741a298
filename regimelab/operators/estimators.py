"""Volatility from daily bars: five trailing estimators and a daily variance proxy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.win import by_pos, rolling

YEAR = float(CONFIG.days_a_year)


def _ln(a: str | Column, b: str | Column) -> Column:
    return F.ln((F.col(a) if isinstance(a, str) else a) / (F.col(b) if isinstance(b, str) else b))


def _gk() -> Column:
    return 0.5 * F.pow(_ln("high", "low"), 2) - (2 * math.log(2) - 1) * F.pow(_ln("close", "open"), 2)


def _rs() -> Column:
    return _ln("high", "close") * _ln("high", "open") + _ln("low", "close") * _ln("low", "open")


def _floor(x: Column, least: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(least)))


def estimators(bars: DataFrame, window: int = CONFIG.estimator_window) -> DataFrame:
    """bars with close_to_close, parkinson, garman_klass, rogers_satchell and yang_zhang, a year's deviation each."""
    n = window
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    before = F.lag("close").over(by_pos())
    steps = bars.withColumns({
        "_r": _ln("close", before), "_p": F.pow(_ln("high", "low"), 2) / (4 * math.log(2)), "_g": _floor(_gk(), 0.0),
        "_s": _rs(), "_o": F.ln(F.col("open") / before), "_c": _ln("close", "open"),
    })
    root = lambda x: F.sqrt(_floor(x, 0.0) * YEAR)
    made = steps.withColumns({
        "close_to_close": rolling(F.stddev_samp, "_r", n) * math.sqrt(YEAR),
        "parkinson": root(rolling(F.avg, "_p", n)),
        "garman_klass": root(rolling(F.avg, "_g", n)),
        "rogers_satchell": root(rolling(F.avg, _floor(F.col("_s"), 0.0), n)),
        "yang_zhang": root(rolling(F.var_samp, "_o", n) + k * rolling(F.var_samp, "_c", n) + (1 - k) * rolling(F.avg, "_s", n)),
    })
    return made.drop("_r", "_p", "_g", "_s", "_o", "_c")


NAMES = ("close_to_close", "parkinson", "garman_klass", "rogers_satchell", "yang_zhang")


def correlations(made: DataFrame) -> DataFrame:
    """a, b, rho of each pair of estimators and the mean of a, over days that have all five."""
    whole = made.na.drop(subset=list(NAMES))
    pairs = [(a, b) for a in NAMES for b in NAMES]
    one = whole.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs], *[F.avg(a).alias(f"{a}|") for a in NAMES])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("rho"), F.col(f"{a}|").alias("mean")) for a, b in pairs]))
    return one.select(rows.alias("x")).select("x.*")


def daily_variance(bars: DataFrame) -> DataFrame:
    """ticker, pos, date, rv (one day's Garman-Klass variance, 1e-10 at least), rv_ann and log_rv."""
    rv = _floor(_gk(), 1e-10)
    return bars.select("ticker", "pos", "date", rv.alias("rv")).where("rv is not null").withColumn("rv_ann", F.sqrt(F.col("rv") * YEAR)).withColumn("log_rv", F.ln("rv"))

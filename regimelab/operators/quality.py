"""Checks of daily bars, and their alignment to one calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.win import by_date, by_pos, filled, so_far


class DataQualityError(Exception):
    """Bars failed a hard check."""


def schema_findings(columns: list[str], required: tuple[str, ...] = CONFIG.columns) -> list[str]:
    return sorted(set(required) - set(columns))


def findings(bars: DataFrame, price: str = "close") -> DataFrame:
    """ticker, check, severity, n: the count of each finding."""
    ohlc = ["open", "high", "low", "close"]
    whole = F.lit(True)
    for c in ohlc:
        whole = whole & F.col(c).isNotNull()
    step = F.datediff("date", F.lag("date").over(by_date()))
    move = F.abs(F.ln(F.col(price) / F.lag(price).over(by_date())))
    rows = bars.withColumns({"step": step, "move": move, "same": F.row_number().over(Window.partitionBy("ticker", "date").orderBy(price))})
    tol = CONFIG.price_tolerance
    counts = {
        "duplicate_date": ("hard", F.col("same") > 1),
        "nonpositive_price": ("hard", whole & (F.least(*ohlc) <= 0)),
        "high_below": ("hard", F.col("high") + tol < F.greatest("open", "close")),
        "low_above": ("hard", F.col("low") - tol > F.least("open", "close")),
        **{f"missing_{c}": ("soft", F.col(c).isNull()) for c in (*ohlc, "volume")},
        "gap": ("soft", F.col("step") > 7),
        "extreme_return": ("soft", F.col("move") > CONFIG.extreme_return),
        "zero_volume": ("soft", F.col("volume") == 0),
    }
    covered = F.count(F.lit(1)) / F.greatest(F.datediff(F.max("date"), F.min("date")) * CONFIG.days_a_year / 365.0, F.lit(1.0))
    one = rows.groupBy("ticker").agg(*[F.count_if(cond).alias(name) for name, (_, cond) in counts.items()], (covered < 0.95).cast("long").alias("low_coverage"))
    severity = {name: s for name, (s, _) in counts.items()} | {"low_coverage": "soft"}
    long = one.unpivot("ticker", list(severity), "check", "n")
    named = F.create_map(*[F.lit(x) for pair in severity.items() for x in pair])
    return long.select("ticker", "check", named[F.col("check")].alias("severity"), "n")


def ticker_report(bars: DataFrame) -> DataFrame:
    """ticker, rows, first_date, last_date, expected (trading days of that span, roughly), coverage, nulls of each column, zero_volume, nonpositive and inverted (high under low) rows."""
    ohlc = ["open", "high", "low", "close"]
    columns = [c for c in (*ohlc, "adj_close", "volume") if c in bars.columns]
    expected = F.datediff(F.max("date"), F.min("date")) * CONFIG.days_a_year / 365.0
    none = F.lit(False)
    for c in ohlc:
        none = none | F.coalesce(F.col(c) <= 0, F.lit(False))
    return bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), expected.alias("expected"), (F.count(F.lit(1)) / F.greatest(expected, F.lit(1.0))).alias("coverage"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns], F.count_if(F.col("volume") == 0).alias("zero_volume"), F.count_if(none).alias("nonpositive"), F.count_if(F.col("high") < F.col("low")).alias("inverted"),
    )


def require_clean(report: DataFrame) -> None:
    hard = report.where("severity = 'hard' and n > 0").limit(20).collect()
    if hard:
        raise DataQualityError("; ".join(f"{r.ticker}: {r.check} {r.n}" for r in hard))


def largest_gaps(bars: DataFrame, most: int = 3) -> DataFrame:
    gaps = bars.select("ticker", F.lag("date").over(by_date()).alias("since"), "date").withColumn("days", F.datediff("date", "since")).where("days > 7")
    top = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("days"), "date"))
    return gaps.withColumn("rank", top).where(F.col("rank") <= most)


def first_extremes(bars: DataFrame, most: int = 5, price: str = "close") -> DataFrame:
    moves = bars.select("ticker", "date", F.ln(F.col(price) / F.lag(price).over(by_date())).alias("r")).where(F.abs("r") > CONFIG.extreme_return)
    return moves.withColumn("rank", F.row_number().over(by_date())).where(F.col("rank") <= most)


def calendar_findings(bars: DataFrame, target: str) -> DataFrame:
    """ticker, first_date, late (starts after the target), missing (target days without a bar in its own lifetime) and whether more than 2 % are."""
    days = bars.where(F.col("ticker") == target).select("date").distinct()
    life = bars.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    due = life.join(F.broadcast(days), F.col("date").between(F.col("first_date"), F.col("last_date")))
    gone = due.join(bars.select("ticker", "date").distinct(), ["ticker", "date"], "left_anti").groupBy("ticker").agg(F.count(F.lit(1)).alias("missing"))
    owed = due.groupBy("ticker").agg(F.count(F.lit(1)).alias("due"))
    start = days.agg(F.min("date").alias("start"))
    out = life.join(owed, "ticker").join(gone, "ticker", "left").join(F.broadcast(start))
    missing = F.coalesce("missing", F.lit(0))
    return out.select("ticker", "first_date", (F.col("first_date") > F.col("start")).alias("late"), missing.alias("missing"), (missing > 0.02 * F.col("due")).alias("sparse"))


def missing_universe(bars: DataFrame, universe: DataFrame) -> DataFrame:
    return universe.join(bars.select("ticker").distinct(), "ticker", "left_anti")


def aligned(bars: DataFrame, target: str) -> DataFrame:
    """Every ticker on the target's days, without filling: pos counts the target's days."""
    days = bars.where(F.col("ticker") == target).select("date").distinct()
    days = days.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)  # one row a trading day
    tickers = bars.select("ticker").distinct()
    grid = tickers.join(F.broadcast(days))  # few tickers by few thousand days
    return grid.join(bars, ["ticker", "date"], "left")


def log_returns(panel: DataFrame, price: str = "close") -> DataFrame:
    return panel.select("ticker", "pos", "date", F.ln(F.col(price) / F.lag(price).over(by_pos())).alias("r"))


def carried(panel: DataFrame, price: str = "close") -> DataFrame:
    """The panel with its price carried over empty days after inception."""
    return panel.withColumn(price, filled(price))


def aligned_series(series: DataFrame, calendar: DataFrame, value: str) -> DataFrame:
    """A series put on a calendar's days first, then carried on: values of other days are lost."""
    on = calendar.select("ticker", "pos", "date").join(series.select("date", value), "date", "left")
    return on.withColumn(value, F.last(value, ignorenulls=True).over(so_far()))


def inceptions(returns: DataFrame) -> DataFrame:
    first = returns.groupBy("ticker").agg(F.min(F.when(F.col("r").isNotNull(), F.col("date"))).alias("inception"))
    start = returns.agg(F.min(F.when(F.col("r").isNotNull(), F.col("date"))).alias("start"))
    return first.join(F.broadcast(start)).select("ticker", "inception", (F.col("inception") > F.col("start")).alias("late"))


def summary(returns: DataFrame) -> DataFrame:
    """Yearly mean and deviation, and skewness and excess kurtosis without bias."""
    n = F.count("r").cast("double")
    g1, g2 = F.skewness("r"), F.kurtosis("r")
    return returns.groupBy("ticker").agg(
        (F.avg("r") * CONFIG.days_a_year).alias("mean"),
        (F.stddev_samp("r") * F.sqrt(F.lit(float(CONFIG.days_a_year)))).alias("deviation"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurt"),
        F.min("r").alias("least"),
        F.max("r").alias("most"),
        F.count_if(F.col("r").isNull()).alias("missing"),
    )

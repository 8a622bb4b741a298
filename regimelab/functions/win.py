"""Point-in-time windows over series keyed by (ticker, pos): every helper returns null until enough values are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_pos():
    return Window.partitionBy("ticker").orderBy("pos")


def by_date():
    return Window.partitionBy("ticker").orderBy("date")


def so_far():
    return by_pos().rowsBetween(Window.unboundedPreceding, 0)


def trailing(n: int, offset: int = 0):
    """The last n rows, up to `offset` rows ago."""
    return by_pos().rowsBetween(-(n - 1) - offset, -offset)


def gated(made: Column, of: Column, frame, least: int) -> Column:
    return F.when(F.count(of).over(frame) >= least, made)


def rolling(how, x: str | Column, n: int, least: int | None = None, offset: int = 0) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    frame = trailing(n, offset)
    return gated(how(x).over(frame), x, frame, n if least is None else least)


def quantile(x: str | Column, q: float, n: int, least: int | None = None, offset: int = 0) -> Column:
    return rolling(lambda c: F.percentile(c, F.lit(q)), x, n, least, offset)


def ahead(how, x: str | Column, h: int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    frame = by_pos().rowsBetween(1, h)
    return gated(how(x).over(frame), x, frame, h)


def zscore(x: str | Column, n: int = 252, least: int = 126) -> Column:
    """(x - mean) / (deviation + 1e-12) over trailing rows."""
    x = F.col(x) if isinstance(x, str) else x
    frame = trailing(n)
    return gated((x - F.avg(x).over(frame)) / (F.stddev_samp(x).over(frame) + 1e-12), x, frame, least)


def filled(x: str, most: int | None = None) -> Column:
    """The last value that is not null, at most so many rows old."""
    return F.last(x, ignorenulls=True).over(so_far() if most is None else by_pos().rowsBetween(-most, 0))


def renumbered(df: DataFrame) -> DataFrame:
    """pos anew, from 0 without gaps, after rows have gone."""
    return df.withColumn("pos", F.row_number().over(by_pos()) - 1)


def average_rank(x: str, *groups: str) -> Column:
    """Ranks from 1, ties sharing their mean rank."""
    order = Window.partitionBy(*groups).orderBy(x)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*groups, x)) - 1) / 2.0

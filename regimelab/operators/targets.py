"""Model matrix, forecasting targets and event labels. Only targets and labels look ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.win import by_pos, ahead, quantile, renumbered, rolling


def har(rv: DataFrame) -> DataFrame:
    return rv.withColumns({"rv_d": F.col("log_rv"), "rv_w": rolling(F.avg, "log_rv", 5), "rv_m": rolling(F.avg, "log_rv", 21)})


def targets(rv: DataFrame, horizons: tuple[int, ...] = CONFIG.horizons) -> DataFrame:
    return rv.withColumns({f"target_h{h}": F.ln(ahead(F.avg, "rv", h)) for h in horizons})


class TooFewRows(Exception):
    """The model matrix is empty, or shorter than a walk-forward evaluation needs."""


def model_matrix(rv: DataFrame, features: DataFrame | None = None, vix: DataFrame | None = None) -> DataFrame:
    """HAR terms, targets, then log VIX and features where there are any; rows with nulls go, pos starts anew."""
    out = targets(har(rv))
    if vix is not None:
        out = out.join(vix.select("date", F.ln("vix").alias("log_vix")), "date", "left")
    if features is not None:
        out = out.join(features.drop("pos", "n_assets"), ["ticker", "date"], "left")
    return renumbered(out.na.drop())


def without_empty(features: DataFrame, keys: tuple[str, ...] = ("ticker", "pos", "date")) -> DataFrame:
    """features less the columns that hold nothing but nulls, which would empty the model matrix."""
    names = [c for c in features.columns if c not in keys]
    held = features.agg(*[F.count(c).alias(c) for c in names]).first()
    return features.drop(*[c for c in names if not held[c]])


def require_rows(matrix: DataFrame, least: int = CONFIG.least_train + CONFIG.least_test) -> DataFrame:
    """matrix, if its longest ticker has rows enough; else an error."""
    most = matrix.agg(F.max("pos")).first()[0]
    if most is None or most + 1 < least:
        raise TooFewRows(f"the model matrix has {0 if most is None else most + 1} rows, {least} are needed")
    return matrix


def transition_rows(matrix: DataFrame, labels: DataFrame) -> DataFrame:
    """matrix with onset, and transition: whether a row is near one, counted in the matrix's own rows."""
    joined = matrix.join(labels.select("ticker", "date", "onset"), ["ticker", "date"], "left")
    return transition_mask(joined.withColumn("onset", F.coalesce("onset", F.lit(False))))


def event_labels(rv: DataFrame, horizon: int = 5, trail: int = 252, q: float = 0.85) -> DataFrame:
    """label: 1 where the mean variance of the next days is over the quantile of days before this one, null where either is; onset: a 1 just after a 0."""
    later, bar = ahead(F.avg, "rv", horizon), quantile("rv", q, trail, offset=1)
    labelled = rv.withColumns({"threshold": bar, "label": F.when(later.isNotNull() & bar.isNotNull(), (later > bar).cast("int"))})
    was = F.lag("label").over(by_pos())
    return labelled.withColumn("onset", F.coalesce((F.col("label") == 1) & (was == 0), F.lit(False)))


def transition_mask(onsets: DataFrame, width: int = CONFIG.event_window) -> DataFrame:
    return onsets.withColumn("transition", F.max(F.col("onset").cast("int")).over(by_pos().rowsBetween(-width, width)) == 1)


def calm_mask(rv: DataFrame, q: float = 0.85, trail: int = 252) -> DataFrame:
    """Whether yesterday was at or below the quantile of the days before today; false where that is not known."""
    return rv.withColumn("calm", F.coalesce(F.lag("rv").over(by_pos()) <= quantile("rv", q, trail, offset=1), F.lit(False)))


def forward_change(rv: DataFrame, horizons) -> DataFrame:
    return rv.withColumns({f"change_h{h}": F.ln(ahead(F.avg, "rv", h)) - F.col("log_rv") for h in horizons})


def smoothed_vol(rv: DataFrame) -> DataFrame:
    """log_rv_smooth over 5 days, and its mean over 21: the volatility-only early-warning feature."""
    five = rv.withColumn("log_rv_smooth", rolling(F.avg, "log_rv", 5))
    return five.withColumn("vol", rolling(F.avg, "log_rv_smooth", 21))

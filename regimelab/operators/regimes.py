"""Hidden volatility regimes, and early warning by walk-forward logistic regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import kernels

NAMES = ("Low", "Medium", "High")


def regimes(smoothed: DataFrame, restarts: int = 10) -> DataFrame:
    """ticker, pos, date, log_rv_smooth, regime_hmm, P_Low, P_Medium, P_High from one fit to all rows: for description, never for scoring."""

    def one(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("pos")
        x = series["log_rv_smooth"].to_numpy(float)
        start, trans, mean, var, _ = kernels.hmm_fit(x, CONFIG.states, restarts, CONFIG.hmm_rounds)
        p = kernels.hmm_filter(x, start, trans, mean, var, smooth=True)
        return series.assign(regime_hmm=np.array(NAMES)[p.argmax(1)], P_Low=p[:, 0], P_Medium=p[:, 1], P_High=p[:, 2])

    rows = smoothed.select("ticker", "pos", "date", "log_rv_smooth").na.drop()
    return rows.groupBy("ticker").applyInPandas(one, "ticker string, pos int, date date, log_rv_smooth double, regime_hmm string, P_Low double, P_Medium double, P_High double")


def fitted_transitions(smoothed: DataFrame, restarts: int = 10) -> DataFrame:
    """ticker, now, Low, Medium, High: the transition matrix of one fit to all rows."""

    def one(series: pd.DataFrame) -> pd.DataFrame:
        _, trans, *_ = kernels.hmm_fit(series.sort_values("pos")["log_rv_smooth"].to_numpy(float), CONFIG.states, restarts, CONFIG.hmm_rounds)
        return pd.DataFrame(trans, columns=list(NAMES)).assign(ticker=series["ticker"].iloc[0], now=list(NAMES))[["ticker", "now", *NAMES]]

    rows = smoothed.select("ticker", "pos", "log_rv_smooth").na.drop()
    return rows.groupBy("ticker").applyInPandas(one, "ticker string, now string, Low double, Medium double, High double")


def transitions(labelled: DataFrame, label: str = "regime_hmm") -> DataFrame:
    """Shares of tomorrow's regime by today's."""
    from ..functions.win import by_pos

    pairs = labelled.select(F.col(label).alias("now"), F.lead(label).over(by_pos()).alias("next")).where("next is not null")
    shares = [F.avg((F.col("next") == n).cast("double")).alias(n) for n in NAMES]
    return pairs.groupBy("now").agg(*shares)


def state_volatility(labelled: DataFrame, label: str = "regime_hmm") -> DataFrame:
    year = float(CONFIG.days_a_year)
    return labelled.groupBy(F.col(label).alias("regime")).agg(F.sqrt(F.exp(F.avg("log_rv_smooth")) * year).alias("volatility"), F.count(F.lit(1)).alias("days"))


def walk_forward_high(smoothed: DataFrame, first: int = CONFIG.least_train, refit: int = 63, restarts: int = 3) -> DataFrame:
    """P_High_wf: tomorrow's chance of the highest state, from fits to rows before and the chain of days up to today.

    Every refit is a group of its own, which gets the rows up to its last day, so fits run side by side.
    """
    rows = smoothed.select("ticker", "pos", "date", "log_rv_smooth").na.drop()
    from ..functions.win import renumbered

    rows = renumbered(rows.withColumnRenamed("pos", "day").withColumn("pos", F.col("day")))
    last = rows.groupBy("ticker").agg(F.max("pos").alias("last")).where(F.col("last") >= first)
    grid = last.select("ticker", F.explode(F.sequence(F.lit(first), F.col("last"), F.lit(refit))).alias("at"))
    spread = rows.join(F.broadcast(grid), "ticker").where(F.col("pos") < F.col("at") + refit)  # grid: a row a refit

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        at, x = int(group["at"].iloc[0]), group["log_rv_smooth"].to_numpy(float)
        start, trans, mean, var, _ = kernels.hmm_fit(x[:at], CONFIG.states, restarts, CONFIG.hmm_rounds_walk_forward)
        p = kernels.hmm_filter(x, start, trans, mean, var) @ trans
        return pd.DataFrame({"ticker": group["ticker"], "pos": group["day"], "date": group["date"], "P_High_wf": p[:, -1]}).iloc[at:]

    return spread.groupBy("ticker", "at").applyInPandas(one, "ticker string, pos int, date date, P_High_wf double")


def walk_forward_logit(df: DataFrame, features: list[str], label: str, valid: str, made: str, first: int = CONFIG.least_train, refit: int = 63) -> DataFrame:
    """The chance of an event on valid rows; a refit that falls on a row that is not valid, or sees one class, leaves the model as it was."""

    def one(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("pos")
        x, y = series[features].to_numpy(float), series[label].to_numpy(float)
        ok = series[valid].to_numpy(bool) & np.isfinite(x).all(1) & np.isfinite(y)
        out, model = np.full(len(y), np.nan), None
        for i in range(first, len(y)):
            if not ok[i]:
                continue
            if (i - first) % refit == 0 or model is None:
                seen = np.flatnonzero(ok[:i])
                if len(set(y[seen])) == 2:
                    z, mean, size = kernels.standardised(x[seen])
                    model = kernels.logistic(z, y[seen]), mean, size
            if model is not None:
                w, mean, size = model
                out[i] = 1 / (1 + np.exp(-(w[0] + (x[i] - mean) / size @ w[1:])))
        return series[["ticker", "pos", "date"]].assign(**{made: out})

    made_df = df.select("ticker", "pos", "date", *features, label, valid).groupBy("ticker").applyInPandas(one, f"ticker string, pos int, date date, `{made}` double")
    return made_df.withColumn(made, F.nanvl(made, F.lit(None).cast("double")))

"""Features borrowed from statistical physics: all from rows up to the day, the cross-section from the rows before it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions import kernels
from ..functions.win import by_pos, rolling, trailing, zscore

W = CONFIG.window


BLOCK = 128  # days of a block; each block gets the window before it too

_COLLECTIVE = "pos int, date date, n_assets int, corr_length double, frobenius double, eig_max_frac double, entropy_eigen double, frac_eig_above_mp double, eig_sum double, eig_squares double"


def collective(returns: DataFrame, window: int = W, least: int = CONFIG.least_assets) -> DataFrame:
    """What the correlation matrix of the `window` rows before a day says, on days when `least` tickers have all of them and move.

    pos, date, n_assets; corr_length (the mean correlation of pairs) and frobenius (the sum of squared entries);
    eig_max_frac, entropy_eigen, frac_eig_above_mp, and the sum and sum of squares of all eigenvalues. Days are dealt in
    blocks that overlap by the window, so a row travels to (window + BLOCK) / BLOCK blocks, whatever the number of pairs.
    """

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        wide = rows.pivot(index="pos", columns="ticker", values="r").sort_index()
        days = rows.drop_duplicates("pos").set_index("pos")["date"].reindex(wide.index)
        r, at = wide.to_numpy(float), wide.index.to_numpy()
        upper, out = {}, []
        for i in np.flatnonzero(at // BLOCK == block):
            lo = np.searchsorted(at, at[i] - window)
            x = r[lo:i]
            if len(x) < window:
                continue
            live = np.isfinite(x).all(0)
            x = x[:, live]
            x = x[:, x.std(0) > 0]
            k = x.shape[1]
            if k < least:
                continue
            c = np.corrcoef(x.T)
            if k not in upper:
                upper[k] = np.triu_indices(k, 1)
            pairs = c[upper[k]]
            found = np.maximum(np.linalg.eigvalsh(c), 1e-12)
            p, edge = found / found.sum(), (1 + math.sqrt(k / window)) ** 2
            out.append((at[i], days.iloc[i], k, pairs.mean(), k + 2 * (pairs**2).sum(), found[-1] / k, -(p * np.log(p)).sum() / math.log(k), (found > edge).mean(), found.sum(), (found**2).sum()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _COLLECTIVE.split(", ")])

    of = F.sequence((F.col("pos") / BLOCK).cast("int"), ((F.col("pos") + window) / BLOCK).cast("int"))
    spread = returns.select("ticker", "pos", "date", "r", F.explode(of).alias("block"))
    return spread.groupBy("block").applyInPandas(solve, _COLLECTIVE)


def cross_section(returns: DataFrame, window: int = W, least: int = CONFIG.least_assets) -> DataFrame:
    """pos, date, n_assets, corr_length and frobenius, as in `collective`."""
    return collective(returns, window, least).select("pos", "date", "n_assets", "corr_length", "frobenius")


def eigen_features(returns: DataFrame, window: int = W, least: int = CONFIG.least_assets) -> DataFrame:
    """pos, date, n_assets, eig_max_frac, entropy_eigen, frac_eig_above_mp, eig_sum and eig_squares, as in `collective`."""
    return collective(returns, window, least).drop("corr_length", "frobenius")


def return_entropy(returns: DataFrame, window: int = W, bins: int = 10) -> DataFrame:
    """entropy_returns: the entropy of standardised returns in equal bins on [-4, 4], over the logarithm of their number."""
    frame = trailing(window)
    held = returns.withColumns({"_n": F.count("r").over(frame), "_m": F.avg("r").over(frame), "_s": F.stddev_pop("r").over(frame) + 1e-12, "_x": F.collect_list("r").over(frame)})
    z = F.filter(F.transform("_x", lambda x: (x - F.col("_m")) / F.col("_s")), lambda v: (v >= -4.0) & (v <= 4.0))
    slot = F.transform(z, lambda v: F.least(F.floor((v + 4.0) / (8.0 / bins)), F.lit(bins - 1)).cast("int"))
    held = held.withColumn("_b", slot)
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter("_b", lambda v: v == b)) / F.size("_b").cast("double"))
    total = F.aggregate(share, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.ln(p)).otherwise(0.0)) / math.log(bins)
    return held.withColumn("entropy_returns", F.when((F.col("_n") == window) & (F.size("_b") > 0), total)).drop("_n", "_m", "_s", "_x", "_b")


def temperature(returns: DataFrame, rv: DataFrame, cross: DataFrame, window: int = 21) -> DataFrame:
    """Dispersion between tickers times volatility times what is left of correlation, as a trailing z."""
    spread = returns.groupBy("pos").agg(F.stddev_samp("r").alias("dispersion"))
    rows = rv.select("ticker", "pos", "date", "rv_ann").join(spread, "pos", "left").join(cross.select("pos", "corr_length"), "pos", "left")
    heat = rolling(F.avg, "dispersion", window) * rolling(F.avg, "rv_ann", window) * F.when(F.col("corr_length").isNotNull(), F.greatest(1 - F.col("corr_length"), F.lit(0.0)))
    return rows.withColumn("_heat", heat).withColumn("temperature", zscore("_heat", CONFIG.z_window, CONFIG.z_least)).drop("_heat")


def shock_features(returns: DataFrame, window: int = W) -> DataFrame:
    """susceptibility (the slope of |r| on |r| of the day before) and acf1 (their correlation inside the window)."""
    rows = returns.withColumn("_a", F.abs("r")).withColumn("_l", F.lag("_a").over(by_pos()))
    rows = rows.withColumn("_l", F.when(F.col("_a").isNotNull(), F.col("_l")))
    frame, inner = trailing(window), trailing(window - 1)
    slope = F.covar_samp("_l", "_a").over(frame) / (F.var_samp("_l").over(frame) + 1e-12)
    moves = (F.stddev_samp("_a").over(inner) > 0) & (F.stddev_samp("_l").over(inner) > 0)
    near = F.when((F.count("_a").over(frame) == window) & moves, F.corr("_l", "_a").over(inner))
    return rows.withColumns({"susceptibility": F.when(F.count("_l").over(frame) == window, slope), "acf1": near}).drop("_a", "_l")


def variance_of_vol(rv: DataFrame, window: int = W) -> DataFrame:
    return rv.withColumn("var_of_vol", rolling(F.var_samp, "log_rv", window))


def hurst(rv: DataFrame, window: int = CONFIG.hurst_window) -> DataFrame:
    """hurst_vol: the exponent of detrended fluctuations of log_rv over trailing rows."""

    def one(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("pos")
        x = series["log_rv"].to_numpy(np.float64)
        out = np.full(len(x), np.nan)
        if len(x) >= window:
            out[window - 1 :] = kernels.dfa(np.lib.stride_tricks.sliding_window_view(x, window))
        return series[["ticker", "pos", "date"]].assign(hurst_vol=out)

    made = rv.select("ticker", "pos", "date", "log_rv").groupBy("ticker").applyInPandas(one, "ticker string, pos int, date date, hurst_vol double")
    return made.withColumn("hurst_vol", F.nanvl("hurst_vol", F.lit(None).cast("double")))


def shock_events(returns: DataFrame, threshold_window: int = 252, q: float = 0.90) -> DataFrame:
    """Days on which |r| is over the quantile of the days before."""
    rows = returns.withColumn("size", F.abs("r"))
    bar = rolling(lambda c: F.percentile(c, F.lit(q)), "size", threshold_window, offset=1)
    return rows.withColumn("shock", F.coalesce(F.col("size") > bar, F.lit(False)))


def branching(returns: DataFrame, window: int = CONFIG.hawkes_window, refit: int = CONFIG.hawkes_refit, least: int = 20) -> DataFrame:
    """hawkes_branching: the branching ratio of the shocks in the last `window` rows, fitted every `refit` rows and carried for at most 7.

    Each refit is a group of its own, so fits run side by side.
    """
    days = shock_events(returns)
    start = window + 252
    grid = days.where((F.col("pos") >= start) & ((F.col("pos") - start) % refit == 0)).select("ticker", F.col("pos").alias("at"))
    shocks = days.where("shock").select("ticker", F.col("pos").alias("event"))
    inside = grid.join(shocks, "ticker").where((F.col("event") > F.col("at") - window) & (F.col("event") <= F.col("at")))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        at = int(group["at"].iloc[0])
        times = np.sort(group["event"].to_numpy(np.float64)) - (at - window)
        n = kernels.hawkes_branching(times, float(window)) if len(times) >= least else None
        return pd.DataFrame({"ticker": group["ticker"].iloc[:1], "pos": [at], "n": [n]}).astype({"n": "float64"})

    fitted = inside.groupBy("ticker", "at").applyInPandas(fit, "ticker string, pos int, n double").withColumn("n", F.nanvl("n", F.lit(None).cast("double")))
    joined = returns.select("ticker", "pos", "date").join(fitted, ["ticker", "pos"], "left")
    return joined.withColumn("hawkes_branching", F.last("n", ignorenulls=True).over(by_pos().rowsBetween(-7, 0))).drop("n")


def hawkes_likelihood(times: DataFrame, mu: float, ratio: float, decay: float, horizon: float) -> DataFrame:
    """ticker and the negative log-likelihood of its event times at fixed parameters, as one fold over the sorted times."""
    sorted_times = times.groupBy("ticker").agg(F.array_sort(F.collect_list(F.col("t").cast("double"))).alias("ts"))
    start = F.struct(F.lit(0.0).alias("a"), F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("ll"))

    def step(acc, t):
        a = F.when(acc["last"].isNull(), F.lit(0.0)).otherwise(F.exp(-decay * (t - acc["last"])) * (1 + acc["a"]))
        return F.struct(a.alias("a"), t.alias("last"), (acc["ll"] + F.ln(mu + ratio * decay * a)).alias("ll"))

    total = F.aggregate("ts", start, step)["ll"]
    mass = mu * horizon + ratio * F.aggregate("ts", F.lit(0.0), lambda acc, t: acc + 1 - F.exp(-decay * (horizon - t)))
    return sorted_times.select("ticker", F.size("ts").alias("events"), (mass - total).alias("loss"))


SIGNALS = ("corr_length", "eig_max_frac", "susceptibility", "acf1", "var_of_vol", "hurst_vol", "hawkes_branching")


def criticality(features: DataFrame, signals: tuple[str, ...] = SIGNALS, against: str | None = "entropy_eigen") -> DataFrame:
    """The mean of the trailing z of the signals that are there, and of the negative of one."""
    parts = [zscore(s, CONFIG.z_window, CONFIG.z_least) for s in signals] + ([zscore(-F.col(against), CONFIG.z_window, CONFIG.z_least)] if against else [])
    held = features.withColumn("_z", F.filter(F.array(*parts), lambda x: x.isNotNull()))
    return held.withColumn("criticality", F.when(F.size("_z") > 0, F.aggregate("_z", F.lit(0.0), lambda a, x: a + x) / F.size("_z"))).drop("_z")


def feature_table(rv: DataFrame, target_returns: DataFrame, panel_returns: DataFrame, least: int = CONFIG.least_assets) -> DataFrame:
    """ticker, pos, date and every feature."""
    keys = ["ticker", "pos", "date"]
    cross = collective(panel_returns, least=least).select("pos", "n_assets", "corr_length", "eig_max_frac", "entropy_eigen", "frac_eig_above_mp")
    out = rv.select(*keys).join(cross, "pos", "left")
    for part, names in (
        (return_entropy(target_returns), ["entropy_returns"]),
        (temperature(panel_returns, rv, cross), ["temperature"]),
        (shock_features(target_returns), ["susceptibility", "acf1"]),
        (variance_of_vol(rv), ["var_of_vol"]),
        (hurst(rv), ["hurst_vol"]),
        (branching(target_returns), ["hawkes_branching"]),
    ):
        out = out.join(part.select("ticker", "pos", *names), ["ticker", "pos"], "left")
    return criticality(out)


def describe(df: DataFrame, names: list[str]) -> DataFrame:
    long = df.unpivot([], names, "feature", "value")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"), F.min("value").alias("least"), F.max("value").alias("most"))

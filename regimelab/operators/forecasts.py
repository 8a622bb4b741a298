"""Walk-forward forecasts of log variance: every fit sees only rows before those it predicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..config import CONFIG
from ..functions import kernels
from ..functions.win import by_pos, so_far


def random_walk(rv: DataFrame) -> DataFrame:
    return rv.withColumn("RandomWalk", F.col("log_rv"))


def ewma(rv: DataFrame, decay: float = 0.94) -> DataFrame:
    """The logarithm of the exponentially weighted mean variance, weights summing to one from the first row.

    Weights are relative to blocks of 4096 rows, so that long histories neither overflow nor lose digits.
    """
    block = (F.col("pos") / 4096).cast("int")
    rows = rv.withColumn("_b", block).withColumn("_w", F.pow(F.lit(decay), -(F.col("pos") - F.col("_b") * 4096).cast("double")))
    within = Window.partitionBy("ticker", "_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_x": F.sum(F.col("rv") * F.col("_w")).over(within), "_n": F.sum("_w").over(within)})
    ends = rows.groupBy("ticker", "_b").agg(F.max_by("_x", "pos").alias("ex"), F.max_by("_n", "pos").alias("en"))
    scale = F.lit(decay ** 4096)
    earlier = rows.select("ticker", "_b").distinct().alias("a").join(ends.alias("e"), (F.col("a.ticker") == F.col("e.ticker")) & (F.col("e._b") < F.col("a._b")))
    carried = earlier.groupBy("a.ticker", "a._b").agg(F.sum(F.col("ex") * F.pow(scale, F.col("a._b") - F.col("e._b"))).alias("cx"), F.sum(F.col("en") * F.pow(scale, F.col("a._b") - F.col("e._b"))).alias("cn"))
    joined = rows.join(carried, ["ticker", "_b"], "left")
    mean = (F.col("_x") + F.coalesce("cx", F.lit(0.0))) / (F.col("_n") + F.coalesce("cn", F.lit(0.0)))
    return joined.withColumn("EWMA", F.ln(F.greatest(mean, F.lit(1e-12)))).drop("_b", "_w", "_x", "_n", "cx", "cn")


def _solver(k: int, m: int = 1):
    """Weights of m least-squares problems from the upper triangle of their common second moments, k by k, and m times k moments with a target."""

    @pandas_udf("array<double>")
    def solve(sums: pd.Series) -> pd.Series:
        out, rows = [], np.triu_indices(k)
        for s in sums:
            if s is None or any(v is None for v in s):
                out.append(None)
                continue
            full, gram = np.asarray(s, float), np.zeros((k, k))
            gram[rows] = gram.T[rows] = full[: len(rows[0])]
            out.append(np.linalg.lstsq(gram, full[len(rows[0]) :].reshape(m, k).T, rcond=None)[0].T.ravel().tolist())
        return pd.Series(out)

    return solve


def walk_forward_ols(matrix: DataFrame, columns: list[str], target: str, made: str, first: int = CONFIG.least_train, refit: int = CONFIG.refit, purge: int = 0) -> DataFrame:
    """matrix with `made`: least squares with an intercept, fitted at row `first` and every `refit` rows after on all rows before, less `purge`.

    Normal equations are running sums of one window, and only refit rows reach the solver; no history is shipped.
    """
    x = [F.lit(1.0), *[F.col(c) for c in columns]]
    k = len(x)
    frame = by_pos().rowsBetween(Window.unboundedPreceding, -1 - purge)
    moments = [F.sum(x[i] * x[j]).over(frame) for i in range(k) for j in range(i, k)] + [F.sum(x[i] * F.col(target)).over(frame) for i in range(k)]
    due = (F.col("pos") >= first) & ((F.col("pos") - first) % refit == 0)
    sums = matrix.withColumn("_sums", F.when(due, F.array(*moments)))
    solved = sums.withColumn("_w", _solver(k)("_sums")).withColumn("_w", F.last("_w", ignorenulls=True).over(so_far()))
    value = sum((F.col("_w")[i] * x[i] for i in range(1, k)), F.col("_w")[0])
    return solved.withColumn(made, F.when(F.col("pos") >= first, value)).drop("_sums", "_w")


def residuals(df: DataFrame, features: list[str], on: list[str], first: int = CONFIG.least_train, refit: int = CONFIG.refit) -> DataFrame:
    """df with each feature replaced by what walk-forward least squares on other columns leaves of it; null before row `first`.

    All features share one window of running sums and one solver. df holds no nulls in these columns, and pos from 0.
    """
    x = [F.lit(1.0), *[F.col(c) for c in on]]
    k, m = len(x), len(features)
    frame = by_pos().rowsBetween(Window.unboundedPreceding, -1)
    moments = [F.sum(x[i] * x[j]).over(frame) for i in range(k) for j in range(i, k)] + [F.sum(x[i] * F.col(f)).over(frame) for f in features for i in range(k)]
    due = (F.col("pos") >= first) & ((F.col("pos") - first) % refit == 0)
    solved = df.withColumn("_sums", F.when(due, F.array(*moments))).withColumn("_w", _solver(k, m)("_sums")).withColumn("_w", F.last("_w", ignorenulls=True).over(so_far()))
    fit = lambda at: sum((F.col("_w")[at * k + i] * x[i] for i in range(1, k)), F.col("_w")[at * k])
    return solved.withColumns({f: F.when(F.col("pos") >= first, F.col(f) - fit(at)) for at, f in enumerate(features)}).drop("_sums", "_w")


def residual(df: DataFrame, feature: str, on: list[str], made: str, first: int = CONFIG.least_train, refit: int = CONFIG.refit) -> DataFrame:
    """What walk-forward least squares on other columns leaves of a feature."""
    return residuals(df.withColumn(made, F.col(feature)), [made], on, first, refit)


def _by_refit(df: DataFrame, columns: list[str], made: str, first: int, refit: int, predict) -> DataFrame:
    """ticker, pos, date and predict's value of each row from `first` on. Every refit is a group of its own, which gets the rows before its next one, so fits run side by side.

    predict(rows by pos, at) gives values of the rows from number `at` on; nan where there is none.
    """
    last = df.groupBy("ticker").agg(F.max("pos").alias("last")).where(F.col("last") >= first)
    grid = last.select("ticker", F.explode(F.sequence(F.lit(first), F.col("last").cast("int"), F.lit(refit))).alias("at"))
    spread = df.select("ticker", "pos", "date", *columns).join(F.broadcast(grid), "ticker").where(F.col("pos") < F.col("at") + refit)  # grid: a row a refit

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        at = int(np.searchsorted(group["pos"].to_numpy(), group["at"].iloc[0]))
        return group[["ticker", "pos", "date"]].iloc[at:].assign(**{made: predict(group, at)})

    out = spread.groupBy("ticker", "at").applyInPandas(one, f"ticker string, pos int, date date, `{made}` double")
    return out.withColumn(made, F.nanvl(F.col(f"`{made}`"), F.lit(None).cast("double")))


def walk_forward_enet(matrix: DataFrame, columns: list[str], target: str, made: str, first: int = CONFIG.least_train, refit: int = CONFIG.refit, purge: int = 0) -> DataFrame:
    """Elastic net on columns standardised over the rows before each refit, its penalty chosen by forward-chained folds of them; rows from `first` on."""

    def predict(rows: pd.DataFrame, at: int) -> np.ndarray:
        x, y = rows[columns].to_numpy(float), rows[target].to_numpy(float)
        z, mean, size = kernels.standardised(x[: at - purge])
        w, b = kernels.elastic_net_cv(z, y[: at - purge])
        return (x[at:] - mean) / size @ w + b

    return _by_refit(matrix, [*columns, target], made, first, refit, predict)


def walk_forward_garch(returns: DataFrame, first: int, made: str, asymmetric: bool = False, refit: int = CONFIG.garch_refit) -> DataFrame:
    """ln of tomorrow's variance: parameters of every refit-th row, the path of variances through today; rows from `first` on.

    returns: r on the rows that forecasts are wanted for, such as those of the model matrix; rows without r are passed over.
    """

    def predict(rows: pd.DataFrame, at: int) -> np.ndarray:
        r = rows["r"].to_numpy(float) * 100
        out, known = np.full(len(r), np.nan), np.flatnonzero(np.isfinite(r))
        start = known[known >= at]
        if len(start):  # the first row with a return fits, as the refit row may have none
            p = kernels.garch_fit(r[known[known <= start[0]]], asymmetric)
            path = kernels.garch_path(p, r[known], asymmetric)[1:] / 100**2
            out[known] = np.log(np.clip(path, 1e-10, 4 / CONFIG.days_a_year))
        return out[at:]

    return _by_refit(returns, ["r"], made, first, refit, predict)

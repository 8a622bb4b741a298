"""Losses, tests of predictive accuracy, rank statistics and resampling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..config import CONFIG
from ..functions import kernels
from ..functions.win import average_rank


def qlike(truth: Column, predicted: Column) -> Column:
    q = truth / F.greatest(predicted, F.lit(1e-12))
    return q - F.ln(q) - 1


def losses(forecasts: DataFrame, models: list[str], target: str = "target_h1", first: int = CONFIG.least_train) -> DataFrame:
    """pos, date, transition, model, error, ql: on days from row `first` on that every model predicts (long). Earlier rows only train."""
    whole = forecasts.where(F.col("pos") >= first).na.drop(subset=[*models, target])
    long = whole.unpivot(["ticker", "pos", "date", "transition", target], [f"`{m}`" for m in models], "model", "yhat")
    return long.select("ticker", "pos", "date", "transition", "model", (F.col("yhat") - F.col(target)).alias("error"), qlike(F.exp(F.col(target)), F.exp(F.col("yhat"))).alias("ql"))


def evaluated(lost: DataFrame) -> DataFrame:
    return lost.groupBy("model").agg(
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg(F.abs("error")).alias("mae"),
        F.avg("ql").alias("qlike"),
        F.avg(F.when(F.col("transition"), F.col("ql"))).alias("qlike_transition"),
        F.avg(F.when(~F.col("transition"), F.col("ql"))).alias("qlike_calm"),
        F.count_if("transition").alias("n_transition"),
        F.count(F.lit(1)).alias("n"),
    )


def long_run_t(d: np.ndarray, least: int, lags: int | None = None) -> float:
    """The mean of d over its long-run deviation, with Bartlett weights; each lag's covariance about its own slices' means. nan for fewer than `least` values or no spread."""
    n = len(d)
    if n < least:
        return float("nan")
    lags = math.floor(1.5 * n ** (1 / 3)) if lags is None else lags
    spread = d.var()
    for k in range(1, min(lags, n - 1) + 1):
        a, b = d[k:], d[:-k]
        spread += 2 * (1 - k / (lags + 1)) * ((a * b).mean() - a.mean() * b.mean())
    return float(d.mean() / math.sqrt(spread / n)) if spread > 0 else float("nan")


def _nulls(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in names})


def newey_west(series: DataFrame, value: str, order: str, groups: list[str], least: int, least_lags: int = 0) -> DataFrame:
    """groups, n, mean and t of a value in an order. One group, which is one series of days, is one task's row of numbers."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        d = rows.sort_values(order)[value].to_numpy(float)
        out = {g: [rows[g].iloc[0]] for g in groups}
        return pd.DataFrame(out | {"n": [len(d)], "mean": [d.mean()], "t": [long_run_t(d, least, max(least_lags, math.floor(1.5 * len(d) ** (1 / 3))))]})

    kinds = dict(series.dtypes)
    schema = ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", n long, mean double, t double"
    return _nulls(series.where(F.col(value).isNotNull()).select(*groups, order, value).groupBy(*groups).applyInPandas(one, schema), "t")


def _two_sided():
    @pandas_udf("double")
    def p(t: pd.Series) -> pd.Series:
        return t.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if v is not None and v == v else None)

    return p


def diebold_mariano(lost: DataFrame, pairs: list[tuple[str, str]], h: int = 1, better: str = "physics") -> DataFrame:
    """a, b, scope (all, transition, calm), n, mean, dm, p and verdict of the difference in QLIKE: whether what a has more than b helps."""
    wide = lost.groupBy("pos", "transition").pivot("model", sorted({m for pair in pairs for m in pair})).agg(F.first("ql"))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"`{a}`") - F.col(f"`{b}`")).alias("d")) for a, b in pairs]
    long = wide.select("pos", "transition", F.explode(F.array(*rows)).alias("x")).select("pos", "transition", "x.*").where("d is not null")
    scoped = long.withColumn("scope", F.explode(F.array(F.lit("all"), F.when(F.col("transition"), F.lit("transition")).otherwise(F.lit("calm")))))
    out = newey_west(scoped, "d", "pos", ["a", "b", "scope"], 30, h - 1).withColumnRenamed("t", "dm").withColumn("p", _two_sided()("dm"))
    # The study's words.
    known = F.coalesce(F.col("p") < 0.05, F.lit(False))
    return out.withColumn("verdict", F.when(known & (F.col("dm") < 0), f"{better} helps").when(known & (F.col("dm") > 0), f"{better} hurts").otherwise("no significant difference"))


def rank_ic(long: DataFrame, groups: list[str], x: str = "x", y: str = "y", least: int = 100) -> DataFrame:
    """groups, n, ic (the correlation of average ranks) and t (Newey-West, of the product of standardised ranks); null for fewer than `least` pairs.

    long: groups, pos, x, y. A group is one series of days; groups run side by side.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n, ic, t = len(rows), float("nan"), float("nan")
        if n >= least:
            a, b = rows[x].rank(), rows[y].rank()
            a, b = ((a - a.mean()) / a.std()).to_numpy(float), ((b - b.mean()) / b.std()).to_numpy(float)
            ic, t = float((a * b).sum() / (n - 1)), long_run_t(a * b, 50)
        return pd.DataFrame({g: [rows[g].iloc[0]] for g in groups} | {"n": [n], "ic": [ic], "t": [t]})

    kinds = dict(long.dtypes)
    schema = ", ".join(f"`{g}` {kinds[g]}" for g in groups) + ", n long, ic double, t double"
    whole = long.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*groups, "pos", x, y)
    return _nulls(whole.groupBy(*groups).applyInPandas(one, schema), "ic", "t")


def spearman_matrix(df: DataFrame, names: list[str]) -> DataFrame:
    """a, b, rho over rows that have all columns."""
    whole = df.select("ticker", *names).na.drop()
    ranked = whole.select(*[average_rank(n, "ticker").alias(n) for n in names])
    one = ranked.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a in names for b in names])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("rho")) for a in names for b in names]))
    return one.select(rows.alias("x")).select("x.*")


def auc(scored: DataFrame, groups: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """groups, n, events, auc: the chance that an event scores above a day without, ties half; null with one class. Counts of equal scores meet first."""
    per = scored.groupBy(*groups, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("q"))
    below = Window.partitionBy(*groups).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("under", F.coalesce(F.sum("q").over(below), F.lit(0)))
    out = per.groupBy(*groups).agg(F.sum("p").alias("events"), F.sum("q").alias("others"), F.sum(F.col("p") * (F.col("under") + F.col("q") / 2.0)).alias("u"))
    both = (F.col("events") > 0) & (F.col("others") > 0)
    return out.select(*groups, (F.col("events") + F.col("others")).alias("n"), "events", F.when(both, F.col("u") / F.nullif(F.col("events") * F.col("others"), F.lit(0))).alias("auc"))


def average_precision(scored: DataFrame, groups: list[str], score: str = "score", label: str = "label") -> DataFrame:
    per = scored.groupBy(*groups, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy(*groups).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"tp": F.sum("p").over(above), "seen": F.sum("n").over(above)})
    out = per.groupBy(*groups).agg(F.sum("p").alias("events"), F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("s"))
    return out.select(*groups, F.when(F.col("events") > 0, F.col("s") / F.nullif(F.col("events"), F.lit(0))).alias("average_precision"))


def block_draws(sizes: DataFrame, draws: int = CONFIG.bootstrap_draws, block: int = CONFIG.bootstrap_block, a: int = 7919, b: int = 104729) -> DataFrame:
    """The columns of sizes but n, draw, slot, i: for each row of sizes (a few, each with n rows to draw from) blocks of consecutive rows from starts that integer arithmetic draws, so that any engine draws the same."""
    keys = [c for c in sizes.columns if c != "n"]
    base = sizes.sparkSession.range(draws).select(F.col("id").alias("draw")).join(F.broadcast(sizes)).where("n > 0")
    base = base.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") + block - 1) / block) - 1)))
    start = F.pmod(F.col("draw") * a + F.col("k") * b + F.col("draw") * F.col("k") * 31, F.greatest(F.lit(1).cast("long"), F.col("n") - block))
    rows = base.select(*keys, "draw", "k", "n", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j"), start.alias("start"))
    rows = rows.select(*keys, "draw", (F.col("k") * block + F.col("j")).alias("slot"), (F.col("start") + F.col("j")).alias("i"), "n")
    return rows.where(F.col("slot") < F.col("n")).drop("n")


def bootstrap_auc(scored: DataFrame, groups: list[str] | None = None, draws: int = CONFIG.bootstrap_draws) -> DataFrame:
    """groups, low, high, draws: the 2.5 and 97.5 percentiles of the AUC of resampled rows; draws of one class are left out. scored: groups, i (0, 1, ... in each), score, label."""
    groups = groups or []
    sizes = scored.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    sampled = block_draws(sizes, draws).join(scored.select(*groups, "i", "score", "label"), [*groups, "i"])
    each = auc(sampled, [*groups, "draw"]).where("auc is not null")
    return each.groupBy(*groups).agg(F.percentile("auc", F.lit(0.025)).alias("low"), F.percentile("auc", F.lit(0.975)).alias("high"), F.count(F.lit(1)).alias("draws"))


def importance(matrix: DataFrame, features: list[str], target: str, scopes: dict[str, str | None], train: float = 0.7, repeats: int = 10, trees: int = 300, least: int = 100) -> DataFrame:
    """scope, feature, importance: the fall in R squared when a column of the last rows is shuffled, after boosted trees on the first.

    scopes: the name of each set of rows, and a condition that they meet (None: all). A scope of fewer than `least` rows
    is left out. Each feature is shuffled by draws of its own.
    """
    marks = {f"_scope{i}": F.lit(True) if c is None else F.coalesce(F.expr(c), F.lit(False)) for i, c in enumerate(scopes.values())}
    rows = matrix.select("ticker", "pos", *features, target, *[c.alias(k) for k, c in marks.items()])
    scoped = list(zip(scopes, marks))

    def one(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("pos")
        x, y = series[features].to_numpy(float), series[target].to_numpy(float)
        cut = int(len(y) * train)
        predict = kernels.boosted_trees(x[:cut], y[:cut], trees)
        out = []
        for scope, mark in scoped:
            mine = series[mark].to_numpy(bool)[cut:]
            a, b = x[cut:][mine], y[cut:][mine]
            if len(b) < least:
                continue
            total = ((b - b.mean()) ** 2).sum()
            base = ((b - predict(a)) ** 2).sum()
            for j, name in enumerate(features):
                rng, fall = np.random.RandomState(j), []
                for _ in range(repeats):
                    c = a.copy()
                    c[:, j] = rng.permutation(c[:, j])
                    fall.append((((b - predict(c)) ** 2).sum() - base) / total)
                out.append((scope, name, float(np.mean(fall))))
        return pd.DataFrame(out, columns=["scope", "feature", "importance"])

    return rows.groupBy("ticker").applyInPandas(one, "scope string, feature string, importance double")


def core_share(imp: DataFrame, core: list[str], scope: str = "transition") -> DataFrame:
    """The sum of the core features' importances over that of all positive ones (1e-12 at least); null where the scope is missing."""
    of = imp.where(F.col("scope") == scope)
    top = F.greatest(F.sum(F.greatest(F.col("importance"), F.lit(0.0))), F.lit(1e-12))
    mine = F.coalesce(F.sum(F.when(F.col("feature").isin(core), F.col("importance"))), F.lit(0.0))
    return of.agg(F.when(F.count(F.lit(1)) > 0, mine / top).alias("share"))

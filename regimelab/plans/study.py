"""The whole study as one lazy plan, written only where several later steps read it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CHANCE, COMPARED, CONFIG, CORE_FEATURES, EVENT_SIGNALS, HAR, LEAD_SIGNALS, PHYSICS, VIX, WARNING_SETS
from ..functions.win import filled, rolling, zscore
from ..operators import backtest, estimators, events, factors, forecasts, metrics, physics, quality, regimes, targets
from ..sources import tables


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@dataclass
class Study:
    """Steps of the study over bars of several tickers, one of which is the target. With a folder, wide steps are written there once and read back.

    vix: date, vix. sectors: the tickers of the cross-section; without enough of them, all tickers are.
    """

    spark: SparkSession
    bars: DataFrame
    target: str
    vix: DataFrame | None = None
    folder: str | None = None
    sectors: tuple[str, ...] | None = None
    carry: bool = True  # prices of the cross-section over days without a bar

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        if not self.folder:
            return df
        tables.write_table(df, f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    # ---- data

    @cached_property
    def validated(self) -> DataFrame:
        return quality.findings(self.bars)

    @cached_property
    def panel(self) -> DataFrame:
        """Bars on the target's days, after a stop at any hard finding."""
        quality.require_clean(self.validated)
        return quality.aligned(self.bars, self.target)

    @cached_property
    def returns(self) -> DataFrame:
        """The target's returns on days that have one: the days of all features."""
        return quality.log_returns(self.panel.where(F.col("ticker") == self.target)).where("r is not null")

    @cached_property
    def universe(self) -> tuple[list[str], int]:
        there = sorted(r.ticker for r in self.bars.select("ticker").distinct().collect())  # a name a ticker
        return CONFIG.universe([t for t in there if t not in ("VIX", "^VIX")], self.sectors)

    @cached_property
    def cross_returns(self) -> DataFrame:
        rows = self.panel.where(F.col("ticker").isin(self.universe[0]))
        made = quality.log_returns(quality.carried(rows) if self.carry else rows)
        return made.join(F.broadcast(self.returns.select("pos")), "pos", "left_semi")  # one row a day

    @cached_property
    def daily_rv(self) -> DataFrame:
        return self._kept("daily_rv", estimators.daily_variance(self.panel.where(F.col("ticker") == self.target)))

    @cached_property
    def feature_rv(self) -> DataFrame:
        """Variances on the days of returns, carried over days that have none."""
        rows = self.returns.select("ticker", "pos", "date").join(self.daily_rv.select("pos", "rv", "rv_ann", "log_rv"), "pos", "left")
        return rows.select("ticker", "pos", "date", *[filled(c).alias(c) for c in ("rv", "rv_ann", "log_rv")])

    @cached_property
    def features(self) -> DataFrame:
        return self._kept("physics_features", physics.feature_table(self.feature_rv, self.returns, self.cross_returns, self.universe[1]))

    @cached_property
    def matrix(self) -> DataFrame:
        held = self._kept("model_matrix", targets.model_matrix(self.daily_rv, targets.without_empty(self.features), self.vix))
        return targets.require_rows(held, 1)

    @cached_property
    def inputs(self) -> list[str]:
        """The features in the matrix."""
        return [c for c in PHYSICS if c in self.matrix.columns]

    @cached_property
    def baseline(self) -> list[str]:
        return [*HAR, VIX] if VIX in self.matrix.columns else list(HAR)

    @cached_property
    def labels(self) -> DataFrame:
        return self._kept("event_onsets", targets.event_labels(self.daily_rv))

    @cached_property
    def masked(self) -> DataFrame:
        return targets.transition_rows(targets.require_rows(self.matrix), self.labels)

    # ---- forecasts

    def models(self, horizon: int) -> list[str]:
        first = ["RandomWalk", "EWMA", "GARCH(1,1)", "EGARCH(1,1)"] if horizon == 1 else []
        return [*first, "HAR", "HAR+Phys", *(["HAR+VIX", "HAR+VIX+Phys"] if VIX in self.baseline else [])]

    def _forecast(self, horizon: int) -> DataFrame:
        goal, keys = f"target_h{horizon}", ["ticker", "date"]
        out = forecasts.walk_forward_ols(self.masked, list(HAR), goal, "HAR")
        menus = {"HAR+Phys": [*HAR, *self.inputs]}
        if VIX in self.baseline:
            out = forecasts.walk_forward_ols(out, self.baseline, goal, "HAR+VIX")
            menus["HAR+VIX+Phys"] = [*self.baseline, *self.inputs]
        for name, columns in menus.items():
            out = out.join(forecasts.walk_forward_enet(self.matrix, columns, goal, name).select(*keys, F.col(f"`{name}`")), keys, "left")
        if horizon == 1:
            out = out.join(forecasts.ewma(self.daily_rv).select(*keys, "EWMA"), keys, "left").withColumn("RandomWalk", F.col("rv_d"))
            days = self.matrix.select("ticker", "pos", "date").join(self.returns.select("ticker", "date", "r"), keys, "left")
            for name, asymmetric in (("GARCH(1,1)", False), ("EGARCH(1,1)", True)):
                made = forecasts.walk_forward_garch(days, CONFIG.least_train, "garch", asymmetric)
                out = out.join(made.select(*keys, F.col("garch").alias(name)), keys, "left")
        return out.select("ticker", "pos", "date", "transition", goal, *[f"`{m}`" for m in self.models(horizon)])

    @cached_property
    def _forecasts(self) -> dict[int, DataFrame]:
        return {}

    def forecast(self, horizon: int = 1) -> DataFrame:
        """ticker, pos, date, transition, the target and a column a model, on the matrix's rows; models with VIX only where there is one."""
        if horizon not in self._forecasts:
            self._forecasts[horizon] = self._kept(f"forecasts_h{horizon}", self._forecast(horizon))
        return self._forecasts[horizon]

    def losses(self, horizon: int) -> DataFrame:
        return metrics.losses(self.forecast(horizon), self.models(horizon), f"target_h{horizon}")

    def forecast_metrics(self) -> DataFrame:
        return _united([metrics.evaluated(self.losses(h)).select(F.lit(h).alias("horizon"), "*") for h in CONFIG.horizons])

    def dm_report(self) -> DataFrame:
        pairs = [p for p in COMPARED if set(p) <= set(self.models(5))]
        return _united([metrics.diebold_mariano(self.losses(h), pairs, h).select(F.lit(h).alias("horizon"), "*") for h in CONFIG.horizons])

    # ---- regimes and early warning

    @cached_property
    def smoothed(self) -> DataFrame:
        return targets.smoothed_vol(targets.calm_mask(self.labels)).where("log_rv_smooth is not null")

    @cached_property
    def regime_table(self) -> DataFrame:
        high = regimes.walk_forward_high(self.smoothed).select("ticker", "pos", "P_High_wf")
        return self._kept("regimes", regimes.regimes(self.smoothed).join(high, ["ticker", "pos"], "left"))

    def transition_matrix(self) -> DataFrame:
        return regimes.fitted_transitions(self.smoothed)

    @cached_property
    def warnings(self) -> DataFrame:
        """features (the name of a set), pos, i, score, label: walk-forward chances of an event, on calm days that have a label and criticality."""
        rows = self.smoothed.join(self.features.select("ticker", "pos", "criticality", "hawkes_branching"), ["ticker", "pos"], "left")
        rows = rows.withColumn("valid", F.col("calm") & F.col("label").isNotNull() & F.col("criticality").isNotNull())
        made = [regimes.walk_forward_logit(rows, list(columns), "label", "valid", "score").where("score is not null").withColumn("features", F.lit(name)) for name, columns in WARNING_SETS.items()]
        scored = _united(made).join(rows.select("ticker", "pos", "label"), ["ticker", "pos"])
        numbered = F.row_number().over(Window.partitionBy("features").orderBy("pos")) - 1
        return self._kept("warnings", scored.select("features", "pos", numbered.cast("long").alias("i"), "score", "label"))

    def early_warning(self) -> DataFrame:
        """features, n, events, event_rate, auc, its bootstrap band (low, high) and average_precision of each set of features."""
        scored = self.warnings
        out = metrics.auc(scored, ["features"]).join(metrics.bootstrap_auc(scored, ["features"]).drop("draws"), "features", "left").join(metrics.average_precision(scored, ["features"]), "features")
        return out.select("features", "n", "events", (F.col("events") / F.col("n")).alias("event_rate"), "auc", "low", "high", "average_precision")

    def lead_times(self) -> DataFrame:
        return events.lead_times(events.alarms(self.features, "criticality"), self.study_labels)

    # ---- events

    @cached_property
    def study_labels(self) -> DataFrame:
        """pos, onset on the days of features."""
        rows = self.features.select("pos").join(self.labels.select("pos", "onset"), "pos", "left")
        return rows.select("pos", F.coalesce("onset", F.lit(False)).alias("onset"))

    @cached_property
    def signals(self) -> DataFrame:
        """signal, pos, value of every signal on every day of features: causal z-scores, criticality as it is."""
        rows = self.feature_rv.select("ticker", "pos", "date", "log_rv").join(self.features.drop("date"), ["ticker", "pos"])
        rows = rows.withColumn("_smooth", rolling(F.avg, "log_rv", 5))
        made = {
            "realized_vol": zscore("_smooth"), "hawkes_branching": zscore("hawkes_branching"), "corr_length": zscore("corr_length"),
            "entropy_eigen": zscore(-F.col("entropy_eigen")), "criticality": F.col("criticality"),
        }
        if self.vix is not None:
            rows = rows.join(self.vix.select("date", F.ln("vix").alias("_vix")), "date", "left")
            made["VIX"] = zscore("_vix")
        rows = rows.select("pos", *[c.alias(k) for k, c in made.items()])
        if self.vix is not None:
            rows = rows.withColumn("crit+VIX", (F.col("criticality") + F.col("VIX")) / 2)
        return self._kept("signals", rows.unpivot(["pos"], [f"`{c}`" for c in rows.columns if c != "pos"], "signal", "value"))

    def event_study(self) -> DataFrame:
        of = self.signals.where(F.col("signal").isin(*EVENT_SIGNALS) & F.col("value").isNotNull())
        return events.event_study(of, self.study_labels, events.placebo_days(self.study_labels))

    def lead_table(self) -> DataFrame:
        """Alarm metrics of each signal, and of criticality moved in a circle."""
        rows = events.alarm_metrics(self.signals.where(F.col("signal").isin(*LEAD_SIGNALS)), self.study_labels)
        chance = events.chance_metrics(self.signals.where("signal = 'criticality'"), self.study_labels).withColumn("signal", F.lit(CHANCE))
        return rows.withColumns({c: F.col(c).cast("double") for c in ("onsets", "detected", "episodes", "false_episodes")}).unionByName(chance)

    def onset_path(self) -> DataFrame:
        rows = self.features.unpivot(["pos"], ["criticality", "hawkes_branching"], "signal", "value").where("value is not null")
        placebo = events.placebo_days(self.study_labels, 1, fwd=20, warm=0, each=CONFIG.path_placebo, last=0)
        return events.onset_path(rows, self.study_labels, placebo)

    # ---- factors and importance

    @cached_property
    def rest(self) -> DataFrame:
        """The features less what the baseline explains of them, walk-forward."""
        return self._kept("residuals", forecasts.residuals(self.matrix, self.inputs, self.baseline).select("ticker", "pos", *self.inputs))

    def factor_decay(self, orthogonal: bool = False, horizons=range(1, 23)) -> DataFrame:
        changes = targets.forward_change(self.matrix.select("ticker", "pos", "date", "rv", "log_rv"), horizons)
        return factors.ic_decay(self.rest if orthogonal else self.matrix, changes, self.inputs, horizons)

    def factor_summary(self) -> DataFrame:
        return factors.ic_summary(self.factor_decay(horizons=(5,)), self.factor_decay(True, (5,)))

    def quantile_table(self) -> DataFrame:
        long = factors.buckets(self.matrix.unpivot(["ticker", "pos"], self.inputs, "feature", "x"))
        changes = targets.forward_change(self.matrix.select("ticker", "pos", "date", "rv", "log_rv"), (5,)).select("ticker", "pos", F.col("change_h5").alias("y"))
        return factors.monotonicity(factors.bucket_table(long.join(changes, ["ticker", "pos"])))

    def feature_corr(self) -> DataFrame:
        return metrics.spearman_matrix(self.matrix, self.inputs)

    @cached_property
    def state_importance(self) -> DataFrame:
        """Importance for the mean of the next 5 days, near transitions and on calm days; and for the next day on all days."""
        names = [*self.baseline, *self.inputs]
        states = metrics.importance(self.masked, names, "target_h5", {"transition": "transition", "calm": "not transition"}, repeats=CONFIG.importance_repeats, trees=CONFIG.trees)
        whole = metrics.importance(self.masked, names, "target_h1", {"all": None}, repeats=CONFIG.importance_repeats, trees=CONFIG.trees)
        return self._kept("importance", states.unionByName(whole))

    def core_share(self) -> DataFrame:
        return metrics.core_share(self.state_importance, list(CORE_FEATURES))

    # ---- backtest

    @cached_property
    def held(self) -> DataFrame:
        """Positions of every model on the days that all of them forecast, and of the benchmark."""
        models = self.models(1)
        days = self.forecast(1).na.drop(subset=models)
        return self._kept("positions", backtest.with_benchmark(backtest.positions(days.drop("pos"), quality.log_returns(self.panel.where(F.col("ticker") == self.target)), models)))

    def backtested(self) -> DataFrame:
        return backtest.performance(self.held)

    def attribution(self) -> DataFrame:
        return backtest.attribution(self.held, self.regime_table.select("pos", F.col("regime_hmm").alias("regime")))

    # ---- data of the charts

    def signal_chart(self) -> DataFrame:
        rows = self.feature_rv.withColumn("rv_smooth", rolling(F.avg, "rv_ann", 5)).join(self.features.drop("date"), ["ticker", "pos"])
        if self.vix is not None:
            rows = rows.join(self.vix, "date", "left")
        return rows.select("date", "rv_smooth", *(["vix"] if self.vix is not None else []), "hurst_vol", "hawkes_branching", "temperature", "criticality")

    def regime_chart(self) -> DataFrame:
        closes = self.panel.where(F.col("ticker") == self.target).select("pos", "close")
        return self.regime_table.join(closes, "pos").select("date", "close", "regime_hmm", "P_High", "P_High_wf")

    def run(self, steps: dict[str, Callable[[Study], object]]) -> dict[str, str]:
        """What became of each step, which gets this study: done, skipped (a table that it reads is missing) or failed, with the reason. One that fails leaves the others alone."""
        out = {}
        for name, step in steps.items():
            try:
                step(self)
                out[name] = "done"
            except FileNotFoundError as gone:
                out[name] = f"skipped: {gone}"
            except Exception as error:  # noqa: BLE001 - a step must not end the run
                out[name] = f"failed: {type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
        return out

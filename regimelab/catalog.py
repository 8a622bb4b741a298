"""All queries of the engine by name, over the bars of the trade tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import CONFIG, HAR
from .functions.win import rolling, zscore
from .operators import backtest, estimators, events, factors, forecasts, metrics, physics, quality, regimes, targets
from .oracle import FACTORS, HORIZONS, sql
from .plans.study import Study
from .sources import kept, tables
from .streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(text: str | None = None, digits: str = "", exact: str = ""):
    """Registers a query. Doubles are rounded to six places; with SQL, its columns are the named ones."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            columns = [*exact.split(), *digits.split()] if text else df.columns
            rounded = set(digits.split()) if text else {c for c, kind in df.dtypes if kind == "double"}
            return df.select(*[(F.round(F.col(f"`{c}`"), 6) + 0.0).alias(c) if c in rounded else F.col(f"`{c}`") for c in columns])

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if text:
            ORACLE_SQL[f.__name__] = sql(text, digits, exact)
        return f

    return register


def _market(spark, d):
    return tables.market(spark, d)


def _rv(spark, d):
    return estimators.daily_variance(_market(spark, d))


def _returns(spark, d):
    return quality.log_returns(_market(spark, d))


def _panel(spark, d):
    return quality.aligned(tables.bars(spark, d), "ALL")


def _panel_returns(spark, d):
    return quality.log_returns(quality.carried(_panel(spark, d).where("ticker <> 'ALL'")))


def _labels(spark, d):
    return targets.event_labels(_rv(spark, d))


def _masked(spark, d):
    return targets.transition_mask(_labels(spark, d))


def _vov(spark, d):
    return physics.variance_of_vol(_rv(spark, d))


def _signals(spark, d):
    shocks = physics.shock_features(_returns(spark, d)).select("ticker", "pos", "date", "susceptibility", "acf1")
    return shocks.join(_vov(spark, d).select("ticker", "pos", "var_of_vol"), ["ticker", "pos"])


SIGNALS = ["acf1", "susceptibility", "var_of_vol"]


def _z(spark, d):
    made = _signals(spark, d).withColumns({s: zscore(s) for s in SIGNALS})
    return made.unpivot(["pos"], SIGNALS, "signal", "value").where("value is not null")


MODELS = ["RandomWalk", "EWMA", "HAR"]


def _forecast(spark, d):
    """The models that SQL can say, on the rows of the matrix without features."""
    rv = _rv(spark, d)
    rows = forecasts.walk_forward_ols(targets.transition_rows(targets.model_matrix(rv), _labels(spark, d)), list(HAR), "target_h1", "HAR")
    rows = rows.withColumn("RandomWalk", F.col("rv_d")).join(forecasts.ewma(rv).select("ticker", "date", "EWMA"), ["ticker", "date"])
    return rows.select("ticker", "pos", "date", "transition", "target_h1", *MODELS)


def _positions(spark, d):
    days = _forecast(spark, d).where(F.col("pos") >= CONFIG.least_train).na.drop(subset=MODELS)
    return backtest.positions(days, _returns(spark, d), MODELS)


def _held(spark, d):
    return backtest.with_benchmark(_positions(spark, d))


def _scored(spark, d):
    from pyspark.sql import Window

    rows = _vov(spark, d).join(_labels(spark, d).select("ticker", "pos", "label"), ["ticker", "pos"]).where("var_of_vol is not null and label is not null")
    i = F.row_number().over(Window.partitionBy("ticker").orderBy("pos")) - 1
    return rows.select("ticker", "pos", i.alias("i"), F.col("var_of_vol").alias("score"), "label")


def _vix(spark, d):
    """What stands in for an index of implied volatility: a month's close-to-close volatility in percent."""
    return _returns(spark, d).select("pos", "date", (rolling(F.stddev_samp, "r", 21) * (CONFIG.days_a_year**0.5 * 100)).alias("vix"))


def _study_labels(spark, d):
    rows = _returns(spark, d).where("r is not null").select("pos").join(_labels(spark, d).select("pos", "onset"), "pos", "left")
    return rows.select("pos", F.coalesce("onset", F.lit(False)).alias("onset"))


def _study_signals(spark, d):
    """The study's signals that SQL can say, as causal z-scores on the days of returns."""
    rows = _returns(spark, d).where("r is not null").select("ticker", "pos", "date").join(_rv(spark, d).select("pos", "log_rv"), "pos")
    rows = rows.join(_vix(spark, d).select("pos", F.ln("vix").alias("vix")), "pos", "left").join(physics.cross_section(_panel_returns(spark, d)).select("pos", "corr_length"), "pos", "left")
    rows = rows.withColumn("smooth", rolling(F.avg, "log_rv", 5))
    made = rows.select("pos", zscore("smooth").alias("realized_vol"), zscore("vix").alias("VIX"), zscore("corr_length").alias("corr_length"))
    return made.unpivot(["pos"], ["realized_vol", "VIX", "corr_length"], "signal", "value")


def _factor_rows(spark, d):
    """The matrix with log VIX and the features that SQL can say."""
    rv, returns = _rv(spark, d), _panel_returns(spark, d)
    cross = physics.cross_section(returns)
    rows = _signals(spark, d).join(cross.select("pos", "corr_length"), "pos").join(physics.temperature(returns, rv, cross).select("pos", "temperature"), "pos")
    return targets.model_matrix(rv, rows, _vix(spark, d))


_STUDIES: dict[tuple, Study] = {}


def _study(spark, d) -> Study:
    """The study over the trade tables: part types are the sectors. Its wide steps are written once for a session and its files."""
    bars = tables.bars(spark, d)
    key = (spark.sparkContext.applicationId, *bars.inputFiles()[:1])
    if key not in _STUDIES:
        types = tuple(sorted(r.p_type for r in spark.read.parquet(f"{d}/part.parquet").select("p_type").distinct().where("p_type is not null").collect()))
        _STUDIES[key] = Study(spark, bars, tables.MARKET, _vix(spark, d).where("vix is not null"), kept.fresh_folder(spark, "study"), types)
    return _STUDIES[key]


# ---- bars, their quality and alignment


@query("select * from bars", "", "ticker date open high low close volume")
def bars_daily(spark, d):
    return tables.bars(spark, d)


@query(
    """select ticker, * from (unpivot (select ticker, sum((n > 1)::INTEGER)::BIGINT as duplicate_date, count(*) filter (least(open, high, low, close) <= 0) as nonpositive_price, count(*) filter (high + 1e-6 < greatest(open, close)) as high_below,
 count(*) filter (low - 1e-6 > least(open, close)) as low_above, count(*) filter (open is null) as missing_open, count(*) filter (high is null) as missing_high, count(*) filter (low is null) as missing_low, count(*) filter (close is null) as missing_close, count(*) filter (volume is null) as missing_volume, count(*) filter (date - was > 7) as gap, count(*) filter (abs(ln(close / prev)) > 0.2) as extreme_return, count(*) filter (volume = 0) as zero_volume,
 (count(*) / greatest((max(date) - min(date)) * 252 / 365.0, 1) < 0.95)::BIGINT as low_coverage
 from (select *, row_number() over (partition by ticker, date order by close) as n, lag(date) over (partition by ticker order by date) as was, lag(close) over (partition by ticker order by date) as prev from bars) group by ticker) on * exclude (ticker) into name "check" value n)""",
    "",
    'ticker check n',
)
def dq_findings(spark, d):
    return quality.findings(tables.bars(spark, d))


ORACLE_SQL["dq_findings"] = ORACLE_SQL["dq_findings"].replace("select ticker, check, n from", 'select ticker, "check", n from').replace("select ticker, * from (unpivot", "select * from (unpivot")


@query("select ticker, count(*) as rows, min(date) as first_date, max(date) as last_date, (max(date) - min(date)) * 252 / 365.0::DOUBLE as expected, count(*) / greatest((max(date) - min(date)) * 252 / 365.0::DOUBLE, 1) as coverage, count(*) filter (open is null) as missing_open, count(*) filter (high is null) as missing_high, count(*) filter (low is null) as missing_low, count(*) filter (close is null) as missing_close, count(*) filter (volume is null) as missing_volume, count(*) filter (volume = 0) as zero_volume, count(*) filter (least(open, high, low, close) <= 0) as nonpositive, count(*) filter (high < low) as inverted from bars group by ticker", "expected coverage", "ticker rows first_date last_date missing_open missing_high missing_low missing_close missing_volume zero_volume nonpositive inverted")
def ticker_report(spark, d):
    return quality.ticker_report(tables.bars(spark, d))


@query("select ticker, date, since, date - since as days, row_number() over (partition by ticker order by date - since desc, date) as rank from (select ticker, date, lag(date) over (partition by ticker order by date) as since from bars) where date - since > 7 qualify rank <= 3", "", "ticker since date days rank")
def dq_largest_gaps(spark, d):
    return quality.largest_gaps(tables.bars(spark, d))


@query("select ticker, date, r, row_number() over (partition by ticker order by date) as rank from (select ticker, date, ln(close / lag(close) over (partition by ticker order by date)) as r from bars) where abs(r) > 0.2 qualify rank <= 5", "r", "ticker date rank")
def dq_first_extremes(spark, d):
    return quality.first_extremes(tables.bars(spark, d))


@query(
    """select l.ticker, l.a as first_date, l.a > (select min(date) from market) as late, count(*) filter (b.date is null) as missing, count(*) filter (b.date is null) > 0.02 * count(*) as sparse
 from (select ticker, min(date) as a, max(date) as z from bars group by ticker) l join market m on m.date between l.a and l.z left join (select distinct ticker, date from bars) b on b.ticker = l.ticker and b.date = m.date group by l.ticker, l.a""",
    "",
    "ticker first_date late missing sparse",
)
def dq_calendar(spark, d):
    return quality.calendar_findings(tables.bars(spark, d), "ALL")


@query("select l_orderkey, l_linenumber, l_partkey, l_extendedprice as price from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_extendedprice, l_suppkey) as n from lineitem) where n = 1", "", "l_orderkey l_linenumber l_partkey price")
def dedupe_keep_first(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("price"))
    return tables.first_of_each(rows, ["l_orderkey", "l_linenumber"], "l_partkey", "price", "l_suppkey")


@query("select p_type as ticker from part group by p_type having not exists (select 1 from bars b where b.ticker = p_type)", "", "ticker")
def dq_missing_universe(spark, d):
    return quality.missing_universe(tables.bars(spark, d), spark.read.parquet(f"{d}/part.parquet").select(F.col("p_type").alias("ticker")).distinct())


@query("select * from panel", "", "ticker pos date close")
def calendar_align(spark, d):
    return _panel(spark, d)


@query("select ticker, pos, date, ln(close / lag(close) over (partition by ticker order by pos)) as r from panel", "r", "ticker pos date")
def log_returns(spark, d):
    return quality.log_returns(_panel(spark, d))


@query("select g.pos, g.date, last_value(b.close ignore nulls) over (order by g.pos) as close from market g left join (select date, close from bars where ticker = (select min(ticker) from bars where ticker <> 'ALL')) b using (date)", "", "pos date close")
def series_carried(spark, d):
    bars = tables.bars(spark, d)
    first = bars.where("ticker <> 'ALL'").agg(F.min("ticker").alias("ticker"))
    return quality.aligned_series(bars.join(F.broadcast(first), "ticker"), _market(spark, d), "close")


@query("select ticker, min(date) filter (r is not null) as inception, min(date) filter (r is not null) > (select min(date) from panel_ret where r is not null) as late from panel_ret group by ticker", "", "ticker inception late")
def inceptions(spark, d):
    return quality.inceptions(_panel_returns(spark, d))


@query("select ticker, avg(r) * 252 as mean, stddev_samp(r) * sqrt(252) as deviation, skewness(r) as skew, kurtosis(r) as kurt, min(r) as least, max(r) as most, count(*) filter (r is null) as missing from panel_ret group by ticker", "mean deviation skew kurt least most", "ticker missing")
def return_summary(spark, d):
    return quality.summary(_panel_returns(spark, d))


# ---- volatility


@query("select * from est where yang_zhang is not null and close_to_close is not null", "close_to_close parkinson garman_klass rogers_satchell yang_zhang", "ticker pos date")
def vol_estimators(spark, d):
    return estimators.estimators(_market(spark, d)).na.drop(subset=list(estimators.NAMES))


_PAIRS = " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as rho, avg({a}) as mean from est where yang_zhang is not null and close_to_close is not null" for a in estimators.NAMES for b in estimators.NAMES)


@query(_PAIRS, "rho mean", "a b")
def estimator_corr(spark, d):
    return estimators.correlations(estimators.estimators(_market(spark, d)))


@query("select * from rv", "rv rv_ann log_rv", "ticker pos date")
def daily_rv(spark, d):
    return _rv(spark, d)


# ---- matrix, targets, labels


@query("select * from har", "rv_d rv_w rv_m", "ticker pos date")
def har_components(spark, d):
    return targets.har(_rv(spark, d))


@query("select * from targets", "target_h1 target_h5 target_h22", "ticker pos date")
def forward_targets(spark, d):
    return targets.targets(_rv(spark, d))


@query("select * from matrix", "rv_d rv_w rv_m target_h1 target_h5 target_h22", "ticker pos date")
def model_matrix(spark, d):
    return targets.model_matrix(_rv(spark, d))


@query("select * from labels", "threshold", "ticker pos date label onset")
def event_labels(spark, d):
    return _labels(spark, d)


@query("select * from masked", "", "pos date onset transition")
def transition_mask(spark, d):
    return _masked(spark, d)


@query("select * from calm", "", "pos date calm")
def calm_mask(spark, d):
    return targets.calm_mask(_rv(spark, d))


@query("select * from change", "change_h1 change_h5 change_h22", "pos date")
def forward_change(spark, d):
    return targets.forward_change(_rv(spark, d), (1, 5, 22))


@query("select *, case when count(log_rv_smooth) over w = 21 then avg(log_rv_smooth) over w end as vol from smooth window w as (order by pos rows between 20 preceding and current row)", "log_rv_smooth vol", "pos date")
def early_warning_vol(spark, d):
    return targets.smoothed_vol(_rv(spark, d))


# ---- features


@query("select * from cross_section", "corr_length frobenius", "pos date n_assets")
def cross_section(spark, d):
    return physics.cross_section(_panel_returns(spark, d))


@query()
def eigen_features(spark, d):
    return physics.eigen_features(_panel_returns(spark, d))


@query("select pos, n_assets, n_assets::DOUBLE as eig_sum, frobenius as eig_squares from cross_section", "eig_sum eig_squares", "pos n_assets")
def eigen_invariants(spark, d):
    """The eigenvalues' sum is the number of assets, and their squares sum to those of the matrix."""
    return physics.eigen_features(_panel_returns(spark, d)).select("pos", "n_assets", "eig_sum", "eig_squares")


@query(
    """select m.pos, m.date, case when m.n = 63 then e.entropy_returns end as entropy_returns from (select pos, date, count(r) over w as n, avg(r) over w as m, stddev_pop(r) over w + 1e-12 as s from ret window w as (order by pos rows between 62 preceding and current row)) m
 left join (select pos, -sum(c / t * ln(c / t)) / ln(10::DOUBLE) as entropy_returns from (select pos, b, count(*)::DOUBLE as c, sum(count(*)) over (partition by pos) as t from (select a.pos, least(floor(((x.r - a.m) / a.s + 4) / 0.8::DOUBLE), 9) as b
 from (select pos, avg(r) over w as m, stddev_pop(r) over w + 1e-12 as s from ret window w as (order by pos rows between 62 preceding and current row)) a join ret x on x.pos between a.pos - 62 and a.pos where (x.r - a.m) / a.s between -4 and 4) group by pos, b) group by pos) e using (pos)""",
    "entropy_returns",
    "pos date",
)
def entropy_returns(spark, d):
    return physics.return_entropy(_returns(spark, d))


@query("select pos, date, case when count(heat) over w >= 126 then (heat - avg(heat) over w) / (stddev_samp(heat) over w + 1e-12) end as temperature from heat window w as (order by pos rows between 251 preceding and current row)", "temperature", "pos date")
def temperature(spark, d):
    returns = _panel_returns(spark, d)
    return physics.temperature(returns, _rv(spark, d), physics.cross_section(returns))


@query("select * from shocks", "susceptibility acf1", "pos date")
def shock_features(spark, d):
    return physics.shock_features(_returns(spark, d))


@query("select * from vov", "var_of_vol", "pos date")
def var_of_vol(spark, d):
    return _vov(spark, d)


_DFA = " union all ".join(
    f"""select pos, {s} as s, avg((syy - sxy * sxy / sxx) / {s}) as f from (select pos, seg, regr_syy(y, t) as syy, regr_sxy(y, t) as sxy, regr_sxx(y, t) as sxx from (select pos, i // {s} as seg, i % {s} as t, y from profile where i < {252 // s * s}) group by pos, seg) group by pos"""
    for s in (8, 13, 21, 34, 55)
)


@query(
    f"""select v.pos, v.date, h.hurst_vol from rv v left join (select pos, regr_slope(0.5 * ln(f), ln(s)) as hurst_vol from ({_DFA.replace('profile', '''(select pos, i, sum(x) over (partition by pos order by i) as y from (select a.pos, b.pos - a.pos + 251 as i, b.log_rv - avg(b.log_rv) over (partition by a.pos) as x from rv a join rv b on b.pos between a.pos - 251 and a.pos where a.pos >= 251))''')}) group by pos) h using (pos)""",
    "hurst_vol",
    "pos date",
)
def dfa_hurst(spark, d):
    return physics.hurst(_rv(spark, d))


@query("select pos, date, coalesce(case when count(a) over w = 252 then a > quantile_cont(a, 0.9) over w end, false) as shock from (select pos, date, abs(r) as a from ret) window w as (order by pos rows between 252 preceding and 1 preceding)", "", "pos date shock")
def hawkes_events(spark, d):
    return physics.shock_events(_returns(spark, d))


_EVENTS = "select pos::DOUBLE as t from (select pos, case when count(a) over w = 252 then a > quantile_cont(a, 0.9) over w end as shock from (select pos, abs(r) as a from ret) window w as (order by pos rows between 252 preceding and 1 preceding)) where shock"


@query(f"select count(*)::INTEGER as events, 0.05 * 3000 + 0.4 * sum(1 - exp(-0.2 * (3000 - t))) - sum(ln(0.05 + 0.4 * 0.2 * coalesce((select sum(exp(-0.2 * (e.t - p.t))) from ({_EVENTS}) p where p.t < e.t), 0))) as loss from ({_EVENTS}) e", "loss", "events")
def hawkes_loglik(spark, d):
    shocks = physics.shock_events(_returns(spark, d)).where("shock").select("ticker", F.col("pos").alias("t"))
    return physics.hawkes_likelihood(shocks, 0.05, 0.4, 0.2, 3000.0)


@query()
def hawkes_branching(spark, d):
    return physics.branching(_returns(spark, d))


@query(
    """select pos, case when count(value) > 0 then avg(value) end as criticality from (select p.pos, z.value from rv p left join z using (pos)) group by pos""",
    "criticality",
    "pos",
)
def criticality(spark, d):
    """The composite of the signals that SQL can say."""
    return physics.criticality(_signals(spark, d), tuple(SIGNALS), None)


@query()
def physics_features(spark, d):
    """Every feature of the study, and criticality of all eight signals."""
    return _study(spark, d).features


@query("select signal as feature, avg(x) as mean, stddev_samp(x) as deviation, min(x) as least, max(x) as most from signals_long group by signal", "mean deviation least most", "feature")
def feature_summary(spark, d):
    return physics.describe(_signals(spark, d), SIGNALS)


# ---- forecasts


@query("select * from forecast", "RandomWalk EWMA HAR", "pos date transition")
def simple_forecasts(spark, d):
    return _forecast(spark, d)


@query(
    """select m.pos, m.date, case when m.pos >= 750 then c.b + c.a * m.rv_d end as HAR_d from matrix m left join (select pos, regr_slope(target_h1, rv_d) over w as a, regr_intercept(target_h1, rv_d) over w as b from matrix window w as (order by pos rows between unbounded preceding and 1 preceding)) c on c.pos = 750 + (m.pos - 750) // 21 * 21""",
    "HAR_d",
    "pos date",
)
def har_ols_one(spark, d):
    return forecasts.walk_forward_ols(targets.model_matrix(_rv(spark, d)), ["rv_d"], "target_h1", "HAR_d")


@query("select pos, m.date, a.HAR as HAR_h1, b.HAR_h5, c.HAR_h22 from matrix m join har_h1 a using (pos) join har_h5 b using (pos) join har_h22 c using (pos)", "HAR_h1 HAR_h5 HAR_h22", "pos date")
def har_ols_walkforward(spark, d):
    out = targets.model_matrix(_rv(spark, d))
    for h in CONFIG.horizons:
        out = forecasts.walk_forward_ols(out, list(HAR), f"target_h{h}", f"HAR_h{h}")
    return out.select("pos", "date", "HAR_h1", "HAR_h5", "HAR_h22")


@query(
    """select m.pos, case when m.pos >= 750 then m.acf1 - c.b - c.a * m.var_of_vol end as acf1_rest from numbered m left join (select pos, regr_slope(acf1, var_of_vol) over w as a, regr_intercept(acf1, var_of_vol) over w as b from numbered window w as (order by pos rows between unbounded preceding and 1 preceding)) c on c.pos = 750 + (m.pos - 750) // 21 * 21""".replace(
        "numbered", "(select (row_number() over (order by pos) - 1)::INTEGER as pos, acf1, var_of_vol from signals where acf1 is not null and var_of_vol is not null)"
    ),
    "acf1_rest",
    "pos",
)
def walk_forward_residual(spark, d):
    from .functions.win import renumbered

    return forecasts.residual(renumbered(_signals(spark, d).na.drop(subset=["acf1", "var_of_vol"])), "acf1", ["var_of_vol"], "acf1_rest")


@query()
def study_forecasts(spark, d):
    """Every model of the study for the next day: random walk, EWMA, GARCH, EGARCH, HAR, and elastic nets with features and VIX."""
    return _study(spark, d).forecast(1)


@query()
def study_forecasts_h5(spark, d):
    return _study(spark, d).forecast(5)


@query()
def study_forecasts_h22(spark, d):
    return _study(spark, d).forecast(22)


# ---- losses, tests, ranks


@query("select model, sqrt(avg(error * error)) as rmse, avg(abs(error)) as mae, avg(ql) as qlike, avg(ql) filter (transition) as qlike_transition, avg(ql) filter (not transition) as qlike_calm, count(*) filter (transition) as n_transition, count(*) as n from losses group by model", "rmse mae qlike qlike_transition qlike_calm", "model n_transition n")
def forecast_metrics(spark, d):
    return metrics.evaluated(metrics.losses(_forecast(spark, d), MODELS))


@query("select a, scope, n, mean, dm, p, case when p < 0.05 and dm < 0 then 'model helps' when p < 0.05 and dm > 0 then 'model hurts' else 'no significant difference' end as verdict from dm_p", "mean dm p", "a scope n verdict")
def dm_stat(spark, d):
    """The models that SQL can say against the random walk."""
    return metrics.diebold_mariano(metrics.losses(_forecast(spark, d), MODELS), [("EWMA", "RandomWalk"), ("HAR", "RandomWalk")], better="model")


@query()
def dm_report(spark, d):
    """Models with features against those without, at three horizons."""
    return _study(spark, d).dm_report()


@query()
def study_forecast_metrics(spark, d):
    """Losses of every model at three horizons."""
    return _study(spark, d).forecast_metrics()


@query("select r.feature, r.h, v.n, case when v.n >= 100 then r.ic end as ic, case when v.n >= 100 and v.v > 0 then v.mean / sqrt(v.v / v.n) end as t from (select feature, h, corr(rx, ry) as ic from ic_ranks group by feature, h) r join ic_var v using (feature, h)", "ic t", "feature h n")
def ic_decay(spark, d):
    """The features that SQL can say, at all horizons."""
    rows = _factor_rows(spark, d)
    return factors.ic_decay(rows, targets.forward_change(rows.select("ticker", "pos", "date", "rv", "log_rv"), HORIZONS), list(FACTORS), HORIZONS)


@query()
def study_ic_decay(spark, d):
    """All features of the study at all horizons."""
    return _study(spark, d).factor_decay()


@query()
def study_ic_orthogonal(spark, d):
    """The same of what the baseline leaves of the features."""
    return _study(spark, d).factor_decay(True)


@query(
    " union all ".join(
        f"""select '{a}' as a, '{b}' as b, corr(x, y) as rho from (select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2 as x, rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2 as y from signals where acf1 is not null and susceptibility is not null and var_of_vol is not null)"""
        for a in SIGNALS
        for b in SIGNALS
    ),
    "rho",
    "a b",
)
def feature_corr(spark, d):
    return metrics.spearman_matrix(_signals(spark, d), SIGNALS)


@query("select 'var_of_vol' as name, count(*) as n, sum(label)::BIGINT as events, (sum(rk) filter (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) as auc from (select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2 as rk from scored)", "auc", "name n events")
def roc_auc(spark, d):
    return metrics.auc(_scored(spark, d).withColumn("name", F.lit("var_of_vol")), ["name"])


@query("select 'var_of_vol' as name, sum(p * tp / seen) / sum(p) as average_precision from (select p, sum(p) over o as tp, sum(n) over o as seen from (select score, sum(label) as p, count(*) as n from scored group by score) window o as (order by score desc))", "average_precision", "name")
def average_precision(spark, d):
    return metrics.average_precision(_scored(spark, d).withColumn("name", F.lit("var_of_vol")), ["name"])


@query(
    """select quantile_cont(auc, 0.025) as low, quantile_cont(auc, 0.975) as high, count(*) as draws from (select draw, (sum(rk) filter (label = 1) - sum(label) * (sum(label) + 1) / 2) / nullif(sum(label) * (count(*) - sum(label)), 0) as auc from
 (select draw, label, rank() over (partition by draw order by score) + (count(*) over (partition by draw, score) - 1) / 2 as rk from (select d as draw, k * 21 + j as slot, (d * 7919 + k * 104729 + d * k * 31) % greatest(1, n - 21) + j as i, n
 from (select count(*) as n from scored), range(0, 500) a(d), lateral (select unnest(range(0, ((n + 20) // 21)::BIGINT)) as k) b, range(0, 21) c(j)) x join scored using (i) where slot < n) group by draw) where auc is not null""",
    "low high",
    "draws",
)
def bootstrap_auc(spark, d):
    return metrics.bootstrap_auc(_scored(spark, d))


# ---- factors


@query("select * from buckets", "", "feature pos bucket")
def quantile_buckets(spark, d):
    return factors.buckets(_signals(spark, d).unpivot(["ticker", "pos"], SIGNALS, "feature", "x").where("x is not null"))


def _bucket_table(spark, d):
    long = factors.buckets(_signals(spark, d).unpivot(["ticker", "pos"], SIGNALS, "feature", "x").where("x is not null"))
    changes = targets.forward_change(_rv(spark, d), (5,)).select("ticker", "pos", F.col("change_h5").alias("y"))
    return factors.bucket_table(long.join(changes, ["ticker", "pos"]))


@query("select * from bucket_table", "mean", "feature bucket n")
def quantile_table(spark, d):
    return _bucket_table(spark, d)


@query("select t.feature, t.bucket, m.monotonicity from bucket_table t left join (select feature, corr(a, b) as monotonicity from (select feature, rank() over (partition by feature order by bucket) as a, rank() over (partition by feature order by mean) as b from bucket_table where mean is not null) group by feature) m using (feature)", "monotonicity", "feature bucket")
def monotonicity(spark, d):
    return factors.monotonicity(_bucket_table(spark, d))


@query()
def ic_summary(spark, d):
    """All features of the study at five days, raw and of what the baseline leaves."""
    return _study(spark, d).factor_summary()


@query()
def study_quantile_table(spark, d):
    """All features of the study by quintile, with monotonicity."""
    return _study(spark, d).quantile_table()


@query()
def study_feature_corr(spark, d):
    return _study(spark, d).feature_corr()


# ---- alarms and event studies


@query("select * from leads", "", "onset_pos detected lead")
def lead_time_latest(spark, d):
    return events.lead_times(events.alarms(_vov(spark, d), "var_of_vol"), _labels(spark, d))


@query(
    """select count(*) as onsets, avg(detected::DOUBLE) as detection_rate, median(lead) as median_lead, (select count(*) from alarmed where alarm) as alarms,
 (select count(*) from alarmed a where alarm and not exists (select 1 from onsets where onset_pos > a.pos and onset_pos <= a.pos + 40))::DOUBLE / nullif((select count(*) from alarmed where alarm), 0) as false_alarm_rate from leads""",
    "detection_rate median_lead false_alarm_rate",
    "onsets alarms",
)
def lead_summary(spark, d):
    return events.lead_summary(events.alarms(_vov(spark, d), "var_of_vol"), _labels(spark, d))


@query("select signal, pos, value from z where value is not null", "value", "signal pos")
def causal_z(spark, d):
    return _z(spark, d)


@query("select * from episodes", "", "episode first last days")
def alarm_episodes(spark, d):
    from .functions.win import renumbered

    held = renumbered(_vov(spark, d).where("var_of_vol is not null").withColumn("day", F.col("pos")))
    return events.episodes(events.alarms(held, "var_of_vol").withColumn("pos", F.col("day")))


_LEADS = """select s.signal, o.n as onsets, l.detected, l.detected::DOUBLE / nullif(o.n, 0) as detection_rate, l.mean_lead, l.median_lead, coalesce(e.n, 0) as episodes, coalesce(e.false, 0) as false_episodes, coalesce(e.false, 0)::DOUBLE / greatest(coalesce(e.n, 0), 1) as false_alarm_rate,
 coalesce(e.n, 0) * 252 / o.days::DOUBLE as episodes_a_year from (select distinct signal from RINGING) s, (select count(*) filter (onset) as n, count(*) as days from study_labels) o
 left join (select signal, count(lead) as detected, avg(lead) as mean_lead, median(lead) as median_lead from (select g.signal, d.pos, d.pos - min(e.first) as lead from (select distinct signal from RINGING) g, study_labels d left join EPISODES e on e.signal = g.signal and e.first >= d.pos - 40 and e.first < d.pos where d.onset group by g.signal, d.pos) group by signal) l on l.signal = s.signal
 left join (select signal, count(*) as n, count(*) filter (not exists (select 1 from study_labels d where d.onset and d.pos > e.first and d.pos <= e.first + 40)) as false from EPISODES e group by signal) e on e.signal = s.signal"""
_LEAD_COLUMNS = "detection_rate mean_lead median_lead false_alarm_rate episodes_a_year"


@query(_LEADS.replace("RINGING", "sringing").replace("EPISODES", "sepisodes"), _LEAD_COLUMNS, "signal onsets detected episodes false_episodes")
def lead_table(spark, d):
    """Alarm metrics of the signals that SQL can say, in one plan."""
    signals = _signals(spark, d).unpivot(["pos"], SIGNALS, "signal", "value").unionByName(_study_signals(spark, d).where("signal <> 'corr_length'"))
    return events.alarm_metrics(signals, _study_labels(spark, d))


@query("select * from (" + _LEADS.replace("RINGING", "sringing").replace("EPISODES", "sepisodes") + ") where signal = 'var_of_vol'", _LEAD_COLUMNS, "signal onsets detected episodes false_episodes")
def alarm_metrics(spark, d):
    return events.alarm_metrics(_vov(spark, d).select(F.lit("var_of_vol").alias("signal"), "pos", F.col("var_of_vol").alias("value")), _study_labels(spark, d))


_MEDIANS = ("onsets", "detected", *_LEAD_COLUMNS.split(), "episodes", "false_episodes")


@query("select " + ", ".join(f"median({c}) as {c}" for c in _MEDIANS) + " from (" + _LEADS.replace("RINGING", "cringing").replace("EPISODES", "cepisodes") + ")", " ".join(_MEDIANS), "")
def chance_metrics(spark, d):
    return events.chance_metrics(_study_signals(spark, d).where("signal = 'realized_vol'"), _study_labels(spark, d))


@query()
def study_lead_table(spark, d):
    """Realized volatility, VIX, criticality, self-excitation, criticality with VIX, and chance."""
    return _study(spark, d).lead_table()


@query()
def study_lead_times(spark, d):
    """The latest alarm of criticality before each onset."""
    return _study(spark, d).lead_times()


@query("select pos, (a + b) / 2 as combined from (select pos, max(value) filter (signal = 'acf1') as a, max(value) filter (signal = 'var_of_vol') as b from z group by pos) where a is not null and b is not null", "combined", "pos")
def combined_signal(spark, d):
    made = _signals(spark, d).withColumns({s: zscore(s) for s in ("acf1", "var_of_vol")})
    return made.where("acf1 is not null and var_of_vol is not null").select("pos", ((F.col("acf1") + F.col("var_of_vol")) / 2).alias("combined"))


def _event_study(spark, d):
    labels = _study_labels(spark, d)
    return events.event_study(_study_signals(spark, d).where("value is not null"), labels, events.placebo_days(labels))


@query("select signal, t::INTEGER as t, mean, onsets, low, high from study", "mean low high", "signal t onsets")
def event_study(spark, d):
    """The study's signals that SQL can say, against all placebo draws."""
    return _event_study(spark, d)


@query(
    "select signal, min(t) filter (stays and t <= 0)::INTEGER as first_t from (select signal, t, min(over_) over w = 1 and count(*) over w = 3 as stays from (select signal, t, coalesce(mean > high, false)::INTEGER as over_ from study) window w as (partition by signal order by t rows between current row and 2 following)) group by signal",
    "",
    "signal first_t",
)
def first_movers(spark, d):
    return events.first_movers(_event_study(spark, d))


@query()
def study_event_study(spark, d):
    """All signals of the study against all placebo draws."""
    return _study(spark, d).event_study()


@query()
def study_first_movers(spark, d):
    return events.first_movers(_study(spark, d).event_study()).orderBy(F.asc_nulls_last("first_t"), "signal")


@query(
    """select m.signal, m.t::INTEGER as t, m.mean, m.mean - 2 * m.s / sqrt(c.n) as low, m.mean + 2 * m.s / sqrt(c.n) as high, c.n, p.placebo from (select signal, t, avg(value) as mean, stddev_pop(value) as s from path_days, range(-40, 21) r(t) join z on z.pos = day + t where value is not null group by signal, t) m, (select nullif(count(*), 0) as n from path_days) c
 left join (select signal, t, avg(value) as placebo from path_placebo, range(-40, 21) r(t) join z on z.pos = day + t where value is not null group by signal, t) p on p.signal = m.signal and p.t = m.t""",
    "mean low high placebo",
    "signal t n",
)
def onset_path(spark, d):
    labels = _study_labels(spark, d)
    placebo = events.placebo_days(labels, 1, fwd=20, warm=0, each=CONFIG.path_placebo, last=0)
    return events.onset_path(_z(spark, d), labels, placebo)


@query()
def study_onset_path(spark, d):
    """Criticality and self-excitation around onsets and placebo days."""
    return _study(spark, d).onset_path()


# ---- backtest


@query("select * from held", "weight turnover r_next net", "model pos date")
def strategy_returns(spark, d):
    return _positions(spark, d)


@query("select model, pos, date, net, ln(abs(equity)) as log_equity, drawdown / (1 + abs(drawdown)) as drawdown from equity", "net log_equity drawdown", "model pos date")
def equity_curve(spark, d):
    """Equity as the logarithm of its size, for these made-up prices compound beyond six places."""
    curve = backtest.equity(_held(spark, d))
    return curve.withColumns({"log_equity": F.ln(F.abs("equity")), "drawdown": F.col("drawdown") / (1 + F.abs("drawdown"))})


@query(
    """select c.model, avg(net) * 252 as ann_ret, stddev_samp(net) * sqrt(252) as ann_vol, avg(net) * 252 / (stddev_samp(net) * sqrt(252)) as sharpe, min(drawdown) as max_dd, avg(net) * 252 / nullif(abs(min(drawdown)), 0) as calmar, avg((net > 0)::INTEGER) as win_rate,
 case when stddev_samp(net - bench) * sqrt(252) > 1e-12 then avg(net - bench) * 252 / (stddev_samp(net - bench) * sqrt(252)) end as ir, any_value(u.avg_lev) as avg_lev, any_value(u.turnover_yr) as turnover_yr, count(*) as days
 from equity c left join (select pos, net as bench from all_held where model = 'Buy&Hold' and net is not null) b using (pos) join (select model, avg(weight) as avg_lev, avg(turnover) * 252 as turnover_yr from all_held group by model) u on u.model = c.model group by c.model""",
    "ann_ret ann_vol sharpe max_dd calmar win_rate ir avg_lev turnover_yr",
    "model days",
)
def perf_stats(spark, d):
    return backtest.performance(_held(spark, d))


def _tercile(spark, d):
    rv = _rv(spark, d)
    edges = rv.agg(F.percentile("log_rv", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    name = F.when(F.col("log_rv") <= F.col("q")[0], "Low").when(F.col("log_rv") <= F.col("q")[1], "Medium").otherwise("High")
    return rv.join(F.broadcast(edges)).select("ticker", "pos", name.alias("regime"))


@query(
    "select model, "
    + ", ".join(f"case when count(*) filter (regime = '{r}') > 50 then avg(net) filter (regime = '{r}') / nullif(stddev_samp(net) filter (regime = '{r}'), 0) * sqrt(252) end as sharpe_{r}" for r in ("Low", "Medium", "High"))
    + ", coalesce(sum(net) filter (regime = 'High'), 0) / nullif(sum(net), 0) as share_high from held left join regime using (pos) where net is not null group by model",
    "sharpe_Low sharpe_Medium sharpe_High share_high",
    "model",
)
def pnl_attribution(spark, d):
    return backtest.attribution(_positions(spark, d), _tercile(spark, d).drop("ticker"))


@query()
def study_backtest(spark, d):
    """Every model of the study, and holding."""
    return _study(spark, d).backtested()


@query()
def study_attribution(spark, d):
    """The same by hidden regime."""
    return _study(spark, d).attribution()


# ---- regimes, early warning, importance


@query("select now, " + ", ".join(f"avg((next = '{r}')::INTEGER) as {r}" for r in ("Low", "Medium", "High")) + " from (select regime as now, lead(regime) over (order by pos) as next from regime) where next is not null group by now", "Low Medium High", "now")
def transition_matrix(spark, d):
    return regimes.transitions(_tercile(spark, d), "regime")


@query()
def hmm_regimes(spark, d):
    """Regimes of all days, and the walk-forward chance of the highest."""
    return _study(spark, d).regime_table


@query()
def hmm_state_volatility(spark, d):
    return regimes.state_volatility(_study(spark, d).regime_table)


@query()
def hmm_transition_matrix(spark, d):
    return _study(spark, d).transition_matrix()


@query()
def early_warning(spark, d):
    """Four sets of features: AUC with its band, average precision and the rate of events."""
    return _study(spark, d).early_warning()


@query()
def state_importance(spark, d):
    """All features: five days ahead near transitions and on calm days, one day ahead on all."""
    return _study(spark, d).state_importance


@query()
def core_share(spark, d):
    """The share of importance near transitions that features of the named mechanisms hold."""
    return _study(spark, d).core_share()


@query()
def study_signal_chart(spark, d):
    return _study(spark, d).signal_chart()


@query()
def study_regime_chart(spark, d):
    return _study(spark, d).regime_chart()


@query("select pos, date, rv_ann, case when count(*) over w = 5 then avg(rv_ann) over w end as rv_smooth from rv window w as (order by pos rows between 4 preceding and current row)", "rv_ann rv_smooth", "pos date")
def signal_chart(spark, d):
    """The data of the volatility chart."""
    return _rv(spark, d).withColumn("rv_smooth", rolling(F.avg, "rv_ann", 5))


@query("select m.pos, m.date, m.close, r.regime from market m join regime r using (pos)", "", "pos date close regime")
def regime_chart(spark, d):
    """The data of the regime chart."""
    return _market(spark, d).join(_tercile(spark, d), ["ticker", "pos"])


# ---- streams


@query("select event_type as ticker, date_trunc('hour', ts) as start, first(value order by ts, value) as open, max(value) as high, min(value) as low, last(value order by ts, value) as close, count(*) as n from events where value > 0 group by all", "", "ticker start open high low close n")
def stream_hourly_bars(spark, d):
    return live.drained(live.event_stream(spark, d), spark.read.parquet(f"{d}/events.parquet"), kept.fresh_folder(spark, "stream"))


__all__ = ["ORACLE_SQL", "QUERIES"]

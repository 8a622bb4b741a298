"""Properties of the operators on made series: closed forms, planted structure, and that no past value moves when the future does."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regimelab.functions import kernels
from regimelab.operators import backtest, estimators, events, factors, forecasts, metrics, physics, quality, regimes, targets
from regimelab.plans.study import Study
from regimelab.sources import tables


def series(spark, ticker="T", **columns):
    n = len(next(iter(columns.values())))
    dates = pd.bdate_range("2000-01-03", periods=n)
    pdf = pd.DataFrame({"ticker": ticker, "pos": np.arange(n, dtype=np.int32), "date": dates.date, **columns})
    return spark.createDataFrame(pdf)


def values(df, column):
    return np.array([np.nan if v[0] is None else float(v[0]) for v in df.orderBy("pos").select(column).collect()])


def gbm(n=1200, sigma=0.2, steps=26, seed=7):
    rng = np.random.default_rng(seed)
    moves = rng.normal(0, sigma / math.sqrt(252 * steps), (n, steps)).cumsum(1)
    start = np.concatenate([[0], moves[:-1, -1].cumsum()])
    path = 100 * np.exp(np.column_stack([np.zeros(n), moves]) + start[:, None])
    return {"open": path[:, 0], "high": path.max(1), "low": path.min(1), "close": path[:, -1], "volume": np.ones(n)}


def test_estimators_recover_volatility_and_closed_forms(spark):
    made = estimators.estimators(series(spark, **gbm()), 252)
    for name in estimators.NAMES:
        assert 0.15 < np.nanmean(values(made, name)) < 0.25
    flat = dict.fromkeys(("open", "high", "low", "close", "volume"), np.full(60, 100.0))
    zero = estimators.estimators(series(spark, **flat), 21)
    assert all(np.nanmax(np.abs(values(zero, n))) == 0 for n in estimators.NAMES)
    wide = flat | {"high": np.full(60, 100 * math.exp(0.02))}
    got = values(estimators.estimators(series(spark, **wide), 21), "parkinson")
    assert abs(got[-1] - math.sqrt(0.02**2 / (4 * math.log(2)) * 252)) < 1e-12 and np.isnan(got[:20]).all()


def test_daily_variance_is_positive_with_inverted_bars(spark):
    bars = gbm(60)
    bars["high"], bars["low"] = bars["close"] * 0.99, bars["close"] * 1.01
    got = values(estimators.daily_variance(series(spark, **bars)), "rv")
    assert np.isfinite(got).all() and (got >= 1e-10).all()


def test_quality_findings(spark):
    bars = pd.DataFrame(gbm(200))
    bars.insert(0, "date", pd.bdate_range("2000-01-03", periods=200).date)
    bars.insert(0, "ticker", "X")
    bars.loc[10, "low"] = -1.0
    bars.loc[20, "high"] = bars.loc[20, "close"] * 0.5
    bars.loc[40, "volume"] = 0.0
    bars.loc[50:, ["open", "high", "low", "close"]] *= 1.4
    bars = pd.concat([bars.drop(index=range(100, 110)), bars.iloc[[60]]])
    report = {(r.check): r.n for r in quality.findings(spark.createDataFrame(bars)).collect()}
    assert report["nonpositive_price"] == 1 and report["high_below"] == 1 and report["zero_volume"] == 1
    assert report["gap"] == 1 and report["extreme_return"] == 1 and report["duplicate_date"] == 1
    with pytest.raises(quality.DataQualityError):
        quality.require_clean(quality.findings(spark.createDataFrame(bars)))
    assert quality.schema_findings(["Open", "Close"]) == ["Adj Close", "High", "Low", "Volume"]


def test_prices_from_csv(spark, tmp_path):
    (tmp_path / "VIX.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-02,1,2,0.5,1.5,1.5,10\n2020-01-02,9,9,9,9,9,9\n2020-01-03,n/a,2,1,2,2,5\n")
    got = tables.read_prices(spark, str(tmp_path)).orderBy("date").collect()
    assert [(r.ticker, str(r.date), r.open, r.close) for r in got] == [("^VIX", "2020-01-02", 1.0, 1.5), ("^VIX", "2020-01-03", None, 2.0)]
    assert tables.read_prices(spark, str(tmp_path), dedupe=False).count() == 3
    assert tables.stem("^VIX") == "VIX" and tables.stem("BRK-B") == "BRK_B"
    out = f"{tmp_path}/out"
    tables.write_csv(spark.createDataFrame(got).select("ticker", "close"), out)
    assert tables.read_csv(spark, out, "ticker string, close double").count() == 2
    assert tables.wide(spark.createDataFrame(got), ["^VIX"], "close").columns == ["date", "^VIX"]


def test_prices_go_by_column_names(spark, tmp_path):
    (tmp_path / "BTC_USD.csv").write_text("Date,Adj Close,Close,High,Low,Open,Volume\nTicker,BTC-USD,BTC-USD,BTC-USD,BTC-USD,BTC-USD,BTC-USD\n2020-01-02 00:00:00,5,4,9,1,2,70\n2020-01-03,6,5,9,1,4,80\n")
    (tmp_path / "GSPC.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-02,1,2,0.5,1.5,1.25,10\n")
    (tmp_path / "OTHER.csv").write_text("Date,Volume,Open,Extra,High,Low,Close,Adj Close\n2020-01-02,7,1,x,2,0.5,1.5,1.25\n")
    got = {(r.ticker, str(r.date)): (r.open, r.high, r.low, r.close, r.adj_close, r.volume) for r in tables.read_prices(spark, str(tmp_path)).collect()}
    assert got == {
        ("BTC-USD", "2020-01-02"): (2, 9, 1, 4, 5, 70), ("BTC-USD", "2020-01-03"): (4, 9, 1, 5, 6, 80), ("^GSPC", "2020-01-02"): (1, 2, 0.5, 1.5, 1.25, 10), ("OTHER", "2020-01-02"): (1, 2, 0.5, 1.5, 1.25, 7),
    }
    assert tables.checked_prices(spark, str(tmp_path)).count() == 4
    (tmp_path / "XLK.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\n")
    with pytest.raises(quality.DataQualityError, match="XLK.csv: no column Adj Close"):
        tables.read_prices(spark, str(tmp_path))
    assert tables.read_prices(spark, str(tmp_path), strict=False).where("ticker = 'XLK'").first().adj_close is None
    (tmp_path / "XLK.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2020-01-02,1,0.9,0.5,1.5,1.5,10\n")
    with pytest.raises(quality.DataQualityError, match="high_below"):
        tables.checked_prices(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        tables.read_prices(spark, str(tmp_path / "none"))


def test_bars_take_first_and_last_by_order_line_and_price(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("A", pd.Timestamp("2020-01-01").date() + pd.Timedelta(days=int(rng.integers(0, 4))), float(rng.integers(1, 9)), int(rng.integers(1, 6)), int(rng.integers(1, 3)), 1.0) for _ in range(200)]
    got = tables.daily(spark.createDataFrame(rows, "ticker string, date date, px double, l_orderkey long, l_linenumber int, l_quantity double")).collect()
    assert len(got) == 4
    for r in got:
        day = sorted((k, n, p) for _, d, p, k, n, _ in rows if d == r.date)
        prices = [p for *_, p in day]
        assert (r.open, r.high, r.low, r.close, r.volume) == (prices[0], max(prices), min(prices), prices[-1], len(prices))


def test_kept_tables_are_made_once_and_anew_for_other_files(spark, tmp_path):
    from regimelab.sources.kept import kept

    made, source = [], f"file://{tmp_path}/in"
    spark.range(3).write.parquet(source)
    build = lambda: made.append(1) or spark.read.parquet(source)
    assert [kept(spark, "t", [source], build).count() for _ in range(2)] == [3, 3] and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert kept(spark, "t", [source], build).count() == 5 and len(made) == 2


def test_alignment_keeps_holes_and_voids_two_returns(spark):
    days = pd.bdate_range("2000-01-03", periods=6).date
    rows = [("A", d, float(i + 1)) for i, d in enumerate(days)] + [("B", d, float(i + 1)) for i, d in enumerate(days) if i != 3]
    panel = quality.aligned(spark.createDataFrame(rows, "ticker string, date date, close double"), "A")
    r = values(quality.log_returns(panel.where("ticker = 'B'")), "r")
    assert np.isnan(r[[0, 3, 4]]).all() and np.isfinite(r[[1, 2, 5]]).all()


def test_kernels():
    x = np.random.default_rng(0).normal(size=(3, 252))
    assert (np.abs(kernels.dfa(x) - 0.5) < 0.25).all() and kernels.dfa(x.cumsum(1)).min() > 1.0
    best, loss = kernels.nelder_mead(lambda p: (p[0] - 3) ** 2 + (p[1] + 1) ** 2, np.array([0.0, 0.0]), 400, 1e-8)
    assert np.allclose(best, [3, -1], atol=1e-3) and loss < 1e-6
    rng = np.random.default_rng(1)
    z = rng.normal(size=(400, 5))
    y = z @ [1.0, -2.0, 0, 0, 0.5] + rng.normal(size=400) * 0.1
    w = kernels.elastic_net(z.T @ z / 400, z.T @ y / 400, 0.1, 0.5, np.zeros(5), tol=1e-12)
    grad = z.T @ (z @ w - y) / 400 + 0.1 * 0.5 * w
    assert np.allclose(grad[w != 0], -0.05 * np.sign(w[w != 0]), atol=1e-8) and (np.abs(grad[w == 0]) <= 0.05 + 1e-8).all()
    coef, b = kernels.elastic_net_cv(z, y)
    assert np.abs(y - z @ coef - b).mean() < 0.2
    labels = (rng.random(400) < 1 / (1 + np.exp(-z[:, 0]))).astype(float)
    c = kernels.logistic(z, labels)
    p = 1 / (1 + np.exp(-(c[0] + z @ c[1:])))
    assert np.abs(z.T @ (p - labels) + c[1:]).max() < 1e-6 and abs((p - labels).sum()) < 1e-6
    predict = kernels.boosted_trees(z, y, 60)
    assert ((y - predict(z)) ** 2).mean() < 0.3 * y.var()


def test_hawkes_branching_of_simulated_events():
    rng, out = np.random.default_rng(3), []
    for ratio in (0.1, 0.7):
        got = []
        for _ in range(4):
            parents, times = list(rng.uniform(0, 6000, rng.poisson(0.08 * 6000))), []
            while parents:
                t = parents.pop()
                times.append(t)
                parents += [u for u in t + rng.exponential(2.0, rng.poisson(ratio)) if u < 6000]
            got.append(kernels.hawkes_branching(np.sort(np.array(times)), 6000.0))
        out.append(np.mean(got))
    assert out[0] < 0.3 and 0.5 < out[1] < 0.9
    assert math.isnan(kernels.hawkes_branching(np.arange(5.0), 10.0))


def test_garch_recovers_persistence():
    rng, h, r = np.random.default_rng(5), 1.0, []
    for _ in range(2500):
        r.append(math.sqrt(h) * rng.normal())
        h = 0.05 + 0.1 * r[-1] ** 2 + 0.85 * h
    p = kernels.garch_fit(np.array(r), False)
    assert 0.85 < p[2] + p[3] < 1.0 and (kernels.garch_path(p, np.array(r), False) > 0).all()


def test_hidden_states_are_found(spark):
    rng = np.random.default_rng(3)
    state, states = 0, []
    for _ in range(2000):
        state = int(rng.integers(0, 3)) if rng.random() < 0.03 else state
        states.append(state)
    x = np.array([-11, -9.5, -8.0])[states] + rng.normal(0, 0.3, 2000)
    got = regimes.regimes(series(spark, log_rv_smooth=x), 4).orderBy("pos").toPandas()
    assert (got.regime_hmm == np.array(regimes.NAMES)[states]).mean() > 0.95
    likes = [kernels.hmm_fit(x, 3, 1, rounds)[4] for rounds in (1, 3, 10)]
    assert likes == sorted(likes)
    shares = regimes.transitions(spark.createDataFrame(got)).collect()
    assert len(shares) == 3 and all(r[r.now] > 0.9 for r in shares)


def test_losses_and_tests(spark):
    v = series(spark, a=np.array([1e-4, 5e-4, 2e-3]))
    assert np.allclose(values(v.withColumn("q", metrics.qlike(F.col("a"), F.col("a"))), "q"), 0)
    both = v.withColumns({"under": metrics.qlike(F.col("a"), F.col("a") / 2), "over": metrics.qlike(F.col("a"), F.col("a") * 2)})
    assert (values(both, "under") > values(both, "over")).all()
    rng = np.random.default_rng(3)
    lost = series(spark, a=rng.random(500), b=rng.random(500)).withColumn("transition", F.lit(False)).unpivot(["pos", "transition"], ["a", "b"], "model", "ql")
    ab, ba = (metrics.diebold_mariano(lost, [p]).where("scope = 'all'").first() for p in (("a", "b"), ("b", "a")))
    assert abs(ab.dm + ba.dm) < 1e-9 and ab.p > 0.05 and ab.verdict == "no significant difference"
    worse = lost.withColumn("ql", F.when(F.col("model") == "b", F.col("ql") + 1).otherwise(F.col("ql")))
    assert [metrics.diebold_mariano(worse, [p]).where("scope = 'all'").first().verdict for p in (("a", "b"), ("b", "a"))] == ["physics helps", "physics hurts"]
    few = metrics.diebold_mariano(lost.where("pos < 20"), [("a", "b")]).where("scope = 'all'").first()
    assert few.dm is None and few.p is None and few.verdict == "no significant difference"


def test_only_rows_after_training_are_judged(spark):
    days = series(spark, target_h1=np.zeros(900), m=np.ones(900)).withColumn("transition", F.lit(False))
    assert metrics.losses(days, ["m"]).agg(F.min("pos"), F.count("pos")).first() == (750, 150)


def test_rank_statistics_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=300), 1)
    y = x + rng.normal(size=300)
    df = series(spark, x=x, y=y).withColumn("g", F.lit("g"))
    got = metrics.rank_ic(df, ["g"]).first()
    assert abs(got.ic - pd.Series(x).rank().corr(pd.Series(y).rank())) < 1e-12 and got.n == 300
    label = (y > 0.5).astype(int)
    scored = series(spark, score=x, label=label).withColumn("g", F.lit("g"))
    above = np.mean([(a > b) + 0.5 * (a == b) for a in x[label == 1] for b in x[label == 0]])
    assert abs(metrics.auc(scored, ["g"]).first().auc - above) < 1e-12
    assert metrics.auc(scored.withColumn("label", F.lit(1)), ["g"]).first().auc is None


def test_ewma_and_walk_forward_fits_against_numpy(spark):
    rng = np.random.default_rng(4)
    rv = np.exp(rng.normal(-9, 0.5, 5000))
    got = values(forecasts.ewma(series(spark, rv=rv)), "EWMA")
    assert np.allclose(got, np.log(pd.Series(rv).ewm(alpha=0.06, adjust=True).mean()), rtol=1e-12)
    x, z = rng.normal(size=900), rng.normal(size=900)
    y = 1 + 2 * x - z + rng.normal(size=900)
    made = values(forecasts.walk_forward_ols(series(spark, x=x, z=z, y=y), ["x", "z"], "y", "f"), "f")
    a = np.column_stack([np.ones(900), x, z])
    for at in (750, 771, 890):
        start = 750 + (at - 750) // 21 * 21
        w = np.linalg.lstsq(a[:start], y[:start], rcond=None)[0]
        assert abs(made[at] - a[at] @ w) < 1e-9
    assert np.isnan(made[:750]).all()


CAUSAL = {
    "estimators": (lambda s: estimators.estimators(s), ["yang_zhang", "close_to_close"]),
    "har": (lambda s: targets.har(estimators.daily_variance(s)), ["rv_w", "rv_m"]),
    "threshold": (lambda s: targets.event_labels(estimators.daily_variance(s)), ["threshold"]),
    "entropy": (lambda s: physics.return_entropy(quality.log_returns(s)), ["entropy_returns"]),
    "shock": (lambda s: physics.shock_features(quality.log_returns(s)), ["susceptibility", "acf1"]),
    "hurst": (lambda s: physics.hurst(estimators.daily_variance(s)), ["hurst_vol"]),
    "ewma": (lambda s: forecasts.ewma(estimators.daily_variance(s)), ["EWMA"]),
    "events": (lambda s: physics.shock_events(quality.log_returns(s)).withColumn("shock", F.col("shock").cast("int")), ["shock"]),
    "hawkes": (lambda s: physics.branching(quality.log_returns(s)), ["hawkes_branching"]),
    "alarm": (lambda s: events.alarms(estimators.daily_variance(s), "rv").withColumn("alarm", F.col("alarm").cast("int")), ["alarm"]),
    "ols": (lambda s: forecasts.walk_forward_ols(targets.har(estimators.daily_variance(s)).na.drop(), ["rv_w"], "rv_d", "f"), ["f"]),
}


@pytest.mark.parametrize("name", sorted(CAUSAL))
def test_the_past_does_not_move_with_the_future(spark, name):
    make, columns = CAUSAL[name]
    bars = gbm(950)
    other = {k: v.copy() for k, v in bars.items()}
    for k in ("open", "high", "low", "close"):
        other[k][900:] *= np.linspace(1, 3, 50)
    a, b = make(series(spark, **bars)), make(series(spark, **other))
    for c in columns:
        x, y = values(a.where("pos < 900"), c), values(b.where("pos < 900"), c)
        assert np.array_equal(x, y, equal_nan=True) and np.isfinite(x).any()


def test_purged_fits_see_no_target_of_the_future(spark):
    rng = np.random.default_rng(1)
    rv = pd.Series(np.exp(rng.normal(-9, 0.5, 900)))
    def fit(v, purge):
        s = targets.targets(series(spark, rv=v.to_numpy()).withColumn("log_rv", F.ln("rv")), (5,))
        return values(forecasts.walk_forward_ols(s, ["log_rv"], "target_h5", "f", purge=purge).where("pos < 751"), "f")
    later = rv.copy()
    later[751:] *= 50
    assert np.array_equal(fit(rv, 4)[750:], fit(later, 4)[750:]) and not np.array_equal(fit(rv, 0)[750:], fit(later, 0)[750:])


def panel(spark, coupled, k=6, n=300):
    rng = np.random.default_rng(9)
    common, out = rng.normal(size=n), None
    for i in range(k):
        r = common + 0.2 * rng.normal(size=n) if coupled else rng.normal(size=n)
        one = series(spark, f"t{i}", r=r * 0.01)
        out = one if out is None else out.unionByName(one)
    return out


def test_coupled_assets_look_coupled(spark):
    a, b = (physics.eigen_features(panel(spark, c)).agg(F.avg("eig_max_frac").alias("e"), F.avg("entropy_eigen").alias("h")).first() for c in (True, False))
    assert a.e > b.e and a.h < b.h
    x, y = (physics.cross_section(panel(spark, c)).agg(F.avg("corr_length")).first()[0] for c in (True, False))
    assert x > 0.8 > 0.2 > abs(y)


def test_entropy_and_susceptibility(spark):
    rng = np.random.default_rng(0)
    spiky = np.where(rng.random(800) < 0.95, 1e-4, rng.normal(0, 0.05, 800))
    a, b = (values(physics.return_entropy(series(spark, r=r)), "entropy_returns") for r in (spiky, rng.normal(0, 0.01, 800)))
    assert 0 <= np.nanmin(a) and np.nanmax(b) <= 1 and np.nanmean(a) < np.nanmean(b)
    size = [0.01]
    for _ in range(1999):
        size.append(0.7 * size[-1] + abs(rng.normal(0, 0.01)))
    r = np.array(size) * rng.choice([-1, 1], 2000)
    assert 0.55 < np.nanmean(values(physics.shock_features(series(spark, r=r), 252), "susceptibility")) < 0.85


def test_buckets_and_alarms(spark):
    x = np.arange(600.0)
    got = factors.buckets(series(spark, x=x).withColumn("feature", F.lit("up"))).orderBy("pos").toPandas()
    assert got.bucket[:252].isna().all() and (got.bucket[252:] == 5).all()
    ring = np.isin(np.arange(100), [10, 12, 17, 40, 46])
    runs = events.episodes(series(spark, alarm=ring)).orderBy("first").collect()
    assert [(r["first"], r["last"]) for r in runs] == [(10, 17), (40, 40), (46, 46)]
    onset = np.isin(np.arange(100), [30, 90])
    leads = {r.onset_pos: (r.detected, r.lead) for r in events.lead_times(series(spark, alarm=ring), series(spark, onset=onset)).collect()}
    assert leads == {30: (True, 13), 90: (False, None)}
    assert sorted(r["at"] for r in events.false_alarms(series(spark, alarm=ring), series(spark, onset=onset)).collect()) == [40, 46]


def test_backtest_against_pandas(spark):
    rng = np.random.default_rng(8)
    r, f = rng.normal(0, 0.01, 300), rng.normal(-9, 0.3, 300)
    held = backtest.positions(series(spark, m=f), series(spark, r=r), ["m"])
    w = np.minimum(2, 0.1 / np.sqrt(np.exp(f) * 252))
    net = (w * np.append(r[1:], np.nan) - 1e-4 * np.abs(np.diff(w, prepend=w[0])))[:-1]
    got = {x.model: x for x in backtest.performance(backtest.with_benchmark(held)).collect()}
    curve = np.cumprod(1 + net)
    assert abs(got["m"].sharpe - net.mean() / net.std(ddof=1) * math.sqrt(252)) < 1e-9
    assert abs(got["m"].max_dd - (curve / np.maximum.accumulate(curve) - 1).min()) < 1e-9
    assert got["Buy&Hold"].ir is None and got["m"].days == 299


def test_study_steps_guards_and_isolation(spark, tmp_path):
    from regimelab import catalog

    study = catalog._study(spark, "/root/testdata/sf0.01")
    assert study.validated.count() == 7 * 13 and study.universe == (sorted(study.sectors), 6)
    assert study.features.count() == study.returns.count() > 2000
    names = set(study.matrix.columns)
    assert {"log_vix", "hawkes_branching", "criticality"} <= names and "n_assets" not in names
    short = Study(spark, study.bars.where("date < '1997-06-01'"), "ALL", sectors=study.sectors)
    with pytest.raises(targets.TooFewRows):
        short.masked  # noqa: B018
    found = study.run({"fine": lambda s: s.labels.count(), "gone": lambda s: open("/nowhere"), "bad": lambda s: 1 / 0, "after": lambda s: s.universe})
    assert found["fine"] == found["after"] == "done" and found["gone"].startswith("skipped") and found["bad"] == "failed: ZeroDivisionError: division by zero"
    dirty = Study(spark, study.bars.withColumn("high", F.col("low") - 1), "ALL")
    with pytest.raises(quality.DataQualityError):
        dirty.panel  # noqa: B018


def test_empty_columns_leave_the_matrix(spark):
    n = 400
    rv = series(spark, rv=np.exp(np.random.default_rng(0).normal(-9, 0.5, n))).withColumn("log_rv", F.ln("rv"))
    features = series(spark, a=np.arange(float(n)), n_assets=np.ones(n)).withColumn("none", F.lit(None).cast("double"))
    made = targets.model_matrix(rv, targets.without_empty(features))
    assert "none" not in made.columns and made.count() == n - 20 - 22
    with pytest.raises(targets.TooFewRows):
        targets.require_rows(targets.model_matrix(rv, features), 1)


def test_variances_are_carried_over_days_without_one(spark):
    bars = gbm(300)
    days = series(spark, "A", **bars).drop("pos").withColumn("open", F.when(F.dayofmonth("date") != 15, F.col("open")))
    study = Study(spark, days, "A", sectors=())
    got = study.feature_rv.orderBy("pos").toPandas()
    assert got.pos.tolist() == list(range(1, 300)) and got.rv.notna().all() and study.daily_rv.count() < 300
    hole = study.panel.where("open is null and pos > 1").agg(F.min("pos")).first()[0]
    assert got.rv[hole - 1] == got.rv[hole - 2]


def test_collective_features_against_pandas(spark):
    rng = np.random.default_rng(2)
    n, k = 400, 8
    r = rng.normal(size=(n, k)) + rng.normal(size=(n, 1))
    r[:150, 7], r[200, 3], r[250:330, 5] = np.nan, np.nan, 0.5
    rows = [(f"t{j}", i, pd.Timestamp("2000-01-01").date(), None if np.isnan(r[i, j]) else float(r[i, j])) for i in range(n) for j in range(k)]
    got = physics.collective(spark.createDataFrame(rows, "ticker string, pos int, date date, r double")).toPandas().set_index("pos")
    for i in (63, 64, 127, 128, 129, 213, 214, 260, 263, 264, 320, 399):
        x = r[i - 63 : i]
        x = x[:, np.isfinite(x).all(0)]
        x = x[:, x.std(0) > 0]
        c = np.corrcoef(x.T)
        e = np.linalg.eigvalsh(c)
        assert got.n_assets[i] == x.shape[1] and abs(got.corr_length[i] - c[np.triu_indices(len(c), 1)].mean()) < 1e-12 and abs(got.eig_max_frac[i] - e[-1] / len(c)) < 1e-12
    assert got.index.tolist() == list(range(63, n))


def test_residuals_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 4))
    y = {f"f{j}": x @ rng.normal(size=4) + rng.normal(size=900) for j in range(3)}
    got = forecasts.residuals(series(spark, **{f"x{i}": x[:, i] for i in range(4)}, **y), list(y), [f"x{i}" for i in range(4)]).orderBy("pos").toPandas()
    a = np.column_stack([np.ones(900), x])
    for name, v in y.items():
        for at in (750, 770, 771, 899):
            start = 750 + (at - 750) // 21 * 21
            assert abs(got[name][at] - (v[at] - a[at] @ np.linalg.lstsq(a[:start], v[:start], rcond=None)[0])) < 1e-9
        assert got[name][:750].isna().all()


def test_garch_is_at_a_maximum_on_a_real_series(spark):
    from regimelab import catalog

    r = np.array([v.r for v in catalog._returns(spark, "/root/testdata/sf0.01").where("r is not null").orderBy("pos").collect()])[:900] * 100
    for asymmetric in (False, True):
        p = kernels.garch_fit(r, asymmetric)

        def loss(q):
            h = np.maximum(kernels.garch_path(q, r, asymmetric)[:-1], 1e-12)
            return 0.5 * (np.log(h) + (r - q[0]) ** 2 / h).sum()

        best = loss(p)
        for j in range(len(p)):
            for step in (-0.02, 0.02):
                q = p.copy()
                q[j] += step * max(abs(q[j]), 0.05)
                inside = q[1] > 0 and q[2] >= 0 and q[3] >= 0 and q[2] + q[3] < 1 if not asymmetric else abs(q[3]) < 1
                assert not inside or loss(q) > best - 0.05


def test_a_late_row_changes_no_closed_window(spark, tmp_path):
    from regimelab.streaming import live

    folder = f"file://{tmp_path}/in"
    at = lambda hour, minute: datetime.datetime(2024, 1, 1, hour, minute)
    first = [(at(1, 5), "a", 5.0), (at(1, 50), "a", 7.0), (at(9, 0), "a", 1.0)]
    for rows in (first, [(at(1, 30), "a", 99.0), (at(12, 0), "a", 2.0)]):
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        stream = live.event_stream(spark, folder)
        live.appended(live.window_bars(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").orderBy("start").collect()
    assert [(r.start.hour, r.open, r.high, r.n) for r in got] == [(1, 5.0, 7.0, 2)] or [(r.start.hour, r.high, r.n) for r in got] == [(1, 7.0, 2), (9, 1.0, 1)]
    now = live.drained(live.event_stream(spark, folder), spark.read.parquet(f"{folder}/events.parquet"), f"file://{tmp_path}/all").collect()
    assert {r.start.hour for r in now} == {1, 9, 12}


def test_universe_falls_back_to_all_tickers():
    from regimelab.config import CONFIG, CORE_FEATURES

    assert CONFIG.universe([*CONFIG.sectors, "SPY"]) == (list(CONFIG.sectors), 6)
    assert CONFIG.universe(["A", "B", "XLK"]) == (["A", "B", "XLK"], 3) and len(CORE_FEATURES) == 10


def test_core_share_is_not_cut_above(spark):
    rows = [("all", "acf1", 1.0), ("transition", "acf1", 1.0), ("transition", "var_of_vol", -0.5), ("transition", "rv_d", 1.0), ("transition", "rv_w", -3.0)]
    imp = spark.createDataFrame(rows, "scope string, feature string, importance double")
    assert metrics.core_share(imp, ["acf1", "var_of_vol"]).first().share == 0.25
    assert metrics.core_share(imp.where("scope = 'all'"), ["acf1"]).first().share is None


def test_importance_finds_the_column_that_matters(spark):
    rng = np.random.default_rng(1)
    x, z = rng.normal(size=900), rng.normal(size=900)
    rows = series(spark, x=x, z=z, y=2 * x + 0.1 * rng.normal(size=900)).withColumn("near", F.col("pos") % 2 == 0)
    got = {(r.scope, r.feature): r.importance for r in metrics.importance(rows, ["x", "z"], "y", {"all": None, "near": "near", "few": "pos > 890"}, repeats=3, trees=60).collect()}
    assert set(got) == {(s, f) for s in ("all", "near") for f in ("x", "z")} and got["all", "x"] > 1 > 0.05 > abs(got["all", "z"])


def test_registered_queries_take_the_study_s_sizes(spark, monkeypatch):
    import inspect

    from regimelab import catalog
    from regimelab.config import CONFIG

    assert (CONFIG.bootstrap_draws, CONFIG.placebo_draws, CONFIG.importance_repeats, CONFIG.trees, CONFIG.hmm_rounds, CONFIG.hmm_rounds_walk_forward) == (500, 1000, 10, 300, 500, 300)
    text = inspect.getsource(catalog) + inspect.getsource(Study)
    assert not [w for w in ("draws=", "repeats=", "trees=", "rounds=", "restarts=") for line in text.splitlines() if w in line and "CONFIG." not in line]
    drawn = []
    monkeypatch.setattr(events, "placebo_days", lambda *a, _of=events.placebo_days, **k: drawn.append(_of(*a, **k)) or drawn[-1])
    catalog.QUERIES["event_study"](spark, "/root/testdata/sf0.01")
    assert drawn[0].agg(F.count_distinct("draw")).first()[0] == 1000
    scored = spark.createDataFrame([(i, float(i % 7), i % 3 == 0) for i in range(200)], "i long, score double, label boolean").withColumn("label", F.col("label").cast("int"))
    assert metrics.bootstrap_auc(scored).first().draws == 500

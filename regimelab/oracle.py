"""The same results in SQL, put together from named common table expressions."""

from __future__ import annotations

import re

_OLS = """select m.pos, case when m.pos >= 750 then c.my + c.b1 * (m.{x1} - c.m1) + c.b2 * (m.{x2} - c.m2) + c.b3 * (m.{x3} - c.m3) end as {made} from {rows} m left join (select *,
 (t1 * (s22 * s33 - s23 * s23) - s12 * (t2 * s33 - s23 * t3) + s13 * (t2 * s23 - s22 * t3)) / det as b1, (s11 * (t2 * s33 - t3 * s23) - t1 * (s12 * s33 - s23 * s13) + s13 * (s12 * t3 - t2 * s13)) / det as b2,
 (s11 * (s22 * t3 - s23 * t2) - s12 * (s12 * t3 - t2 * s13) + t1 * (s12 * s23 - s22 * s13)) / det as b3
 from (select *, s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s23 * s13) + s13 * (s12 * s23 - s22 * s13) as det from (select pos, avg({y}) over w as my, avg({x1}) over w as m1, avg({x2}) over w as m2, avg({x3}) over w as m3,
 covar_pop({x1}, {x1}) over w as s11, covar_pop({x1}, {x2}) over w as s12, covar_pop({x1}, {x3}) over w as s13, covar_pop({x2}, {x2}) over w as s22, covar_pop({x2}, {x3}) over w as s23, covar_pop({x3}, {x3}) over w as s33,
 covar_pop({x1}, {y}) over w as t1, covar_pop({x2}, {y}) over w as t2, covar_pop({x3}, {y}) over w as t3 from {rows} window w as (order by pos rows between unbounded preceding and 1 preceding)))) c on c.pos = 750 + (m.pos - 750) // 21 * 21"""


def ols(rows: str, x: tuple[str, str, str], y: str, made: str) -> str:
    """Walk-forward least squares on three columns, solved by Cramer's rule."""
    return _OLS.format(rows=rows, x1=x[0], x2=x[1], x3=x[2], y=y, made=made)


HORIZONS = range(1, 23)
FACTORS = ("corr_length", "temperature", "susceptibility", "acf1", "var_of_vol")

C: dict[str, str] = {
    "trades": "select p_type as ticker, l_shipdate::DATE as date, l_extendedprice / l_quantity as px, l_orderkey, l_linenumber, l_quantity from lineitem join part on p_partkey = l_partkey",
    "bars": """select ticker, date, first(px order by l_orderkey, l_linenumber, px) as open, max(px) as high, min(px) as low, last(px order by l_orderkey, l_linenumber, px) as close, sum(l_quantity) as volume
 from (select * from trades union all select 'ALL', * exclude (ticker) from trades) group by ticker, date""",
    "market": "select (row_number() over (order by date) - 1)::INTEGER as pos, * from bars where ticker = 'ALL'",
    "rv": """select ticker, pos, date, v as rv, sqrt(v * 252) as rv_ann, ln(v) as log_rv from
 (select ticker, pos, date, greatest(0.5 * ln(high / low) ** 2 - (2 * ln(2::DOUBLE) - 1) * ln(close / open) ** 2, 1e-10) as v from market)""",
    "ret": "select ticker, pos, date, ln(close / lag(close) over (order by pos)) as r from market",
    "grid": "select t.ticker, c.pos, c.date from (select distinct ticker from bars) t, market c",
    "panel": "select g.*, b.open, b.high, b.low, b.close, b.volume from grid g left join bars b on b.ticker = g.ticker and b.date = g.date",
    "locf": "select ticker, pos, date, last_value(close ignore nulls) over (partition by ticker order by pos) as close from panel where ticker <> 'ALL'",
    "panel_ret": "select ticker, pos, date, ln(close / lag(close) over (partition by ticker order by pos)) as r from locf",
    "est_steps": """select *, ln(close / lag(close) over o) as r, ln(high / low) ** 2 / (4 * ln(2::DOUBLE)) as p, greatest(0.5 * ln(high / low) ** 2 - (2 * ln(2::DOUBLE) - 1) * ln(close / open) ** 2, 0) as g,
 ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) as s, ln(open / lag(close) over o) as oc, ln(close / open) as co from market window o as (order by pos)""",
    "est": """select ticker, pos, date,
 case when count(r) over w = 21 then stddev_samp(r) over w * sqrt(252) end as close_to_close,
 case when count(p) over w = 21 then sqrt(avg(p) over w * 252) end as parkinson,
 case when count(g) over w = 21 then sqrt(avg(g) over w * 252) end as garman_klass,
 case when count(s) over w = 21 then sqrt(avg(greatest(s, 0)) over w * 252) end as rogers_satchell,
 case when count(oc) over w = 21 then sqrt(greatest(var_samp(oc) over w + (0.34 / (1.34 + 22.0 / 20))::DOUBLE * var_samp(co) over w + (1 - (0.34 / (1.34 + 22.0 / 20))::DOUBLE) * avg(s) over w, 0) * 252) end as yang_zhang
 from est_steps window w as (order by pos rows between 20 preceding and current row)""",
    "har": """select *, log_rv as rv_d, case when count(*) over a = 5 then avg(log_rv) over a end as rv_w, case when count(*) over b = 21 then avg(log_rv) over b end as rv_m
 from rv window a as (order by pos rows between 4 preceding and current row), b as (order by pos rows between 20 preceding and current row)""",
    "targets": """select *, """ + ", ".join(f"case when count(rv) over h{h} = {h} then ln(avg(rv) over h{h}) end as target_h{h}" for h in (1, 5, 22)) + " from har window " + ", ".join(f"h{h} as (order by pos rows between 1 following and {h} following)" for h in (1, 5, 22)),
    "matrix": "select * replace ((row_number() over (order by pos) - 1)::INTEGER as pos) from targets where rv_m is not null and target_h22 is not null",
    "label0": """select *, case when count(rv) over f = 5 and count(rv) over t = 252 then (avg(rv) over f > quantile_cont(rv, 0.85) over t)::INTEGER end as label, case when count(rv) over t = 252 then quantile_cont(rv, 0.85) over t end as threshold
 from rv window f as (order by pos rows between 1 following and 5 following), t as (order by pos rows between 252 preceding and 1 preceding)""",
    "labels": "select *, coalesce(label = 1 and lag(label) over (order by pos) = 0, false) as onset from label0",
    "masked": "select *, max(onset::INTEGER) over (order by pos rows between 10 preceding and 10 following) = 1 as transition from labels",
    "onsets": "select pos as onset_pos from labels where onset",
    "calm": "select pos, date, coalesce(lag(rv) over (order by pos) <= threshold, false) as calm from label0",
    "change": "select pos, date, " + ", ".join(f"case when count(rv) over h{h} = {h} then ln(avg(rv) over h{h}) end - log_rv as change_h{h}" for h in (1, 5, 22)) + " from rv window " + ", ".join(f"h{h} as (order by pos rows between 1 following and {h} following)" for h in (1, 5, 22)),
    "smooth": "select pos, date, case when count(*) over (order by pos rows between 4 preceding and current row) = 5 then avg(log_rv) over (order by pos rows between 4 preceding and current row) end as log_rv_smooth from rv",
    "live": """select *, count(r) over w = 63 and stddev_samp(r) over w > 0 as live from panel_ret window w as (partition by ticker order by pos rows between 63 preceding and 1 preceding)""",
    "pairs": """select pos, date, a, b, rho from (select x.pos, x.date, x.ticker as a, y.ticker as b, x.live and y.live as ok, corr(x.r, y.r) over (partition by x.ticker, y.ticker order by x.pos rows between 63 preceding and 1 preceding) as rho
 from live x join live y on x.pos = y.pos and x.ticker < y.ticker) where ok and rho is not null""",
    "cross_section": """select * from (select pos, date, ((1 + sqrt(1 + 8 * count(*))) / 2)::INTEGER as n_assets, avg(rho) as corr_length, ((1 + sqrt(1 + 8 * count(*))) / 2)::INTEGER + 2 * sum(rho * rho) as frobenius from pairs group by pos, date) where n_assets >= 6""",
    "heat": """select v.pos, v.date, case when count(d.dispersion) over w = 21 and count(v.rv_ann) over w = 21 then avg(d.dispersion) over w * avg(v.rv_ann) over w * case when c.corr_length is not null then greatest(1 - c.corr_length, 0) end end as heat
 from rv v left join (select pos, stddev_samp(r) as dispersion from panel_ret group by pos) d using (pos) left join cross_section c using (pos) window w as (order by v.pos rows between 20 preceding and current row)""",
    "shock_steps": "select *, abs(r) as a, case when r is not null then abs(lag(r) over (order by pos)) end as l from ret",
    "shocks": """select pos, date, case when count(l) over w = 63 then covar_samp(l, a) over w / (var_samp(l) over w + 1e-12) end as susceptibility,
 case when count(a) over w = 63 and stddev_samp(a) over i > 0 and stddev_samp(l) over i > 0 then corr(l, a) over i end as acf1
 from shock_steps window w as (order by pos rows between 62 preceding and current row), i as (order by pos rows between 61 preceding and current row)""",
    "vov": "select pos, date, case when count(*) over w = 63 then var_samp(log_rv) over w end as var_of_vol from rv window w as (order by pos rows between 62 preceding and current row)",
    "signals": "select 'ALL' as ticker, pos, s.date, susceptibility, acf1, var_of_vol from shocks s join vov using (pos)",
    "signals_long": "unpivot (select pos, acf1, susceptibility, var_of_vol from signals) on acf1, susceptibility, var_of_vol into name signal value x",
    "z": """select signal, pos, case when count(x) over w >= 126 then (x - avg(x) over w) / (stddev_samp(x) over w + 1e-12) end as value from signals_long window w as (partition by signal order by pos rows between 251 preceding and current row)""",
    "ewma": "select pos, date, ln(greatest((select sum(p.rv * 0.94::DOUBLE ** (v.pos - p.pos)) / sum(0.94::DOUBLE ** (v.pos - p.pos)) from rv p where p.pos <= v.pos and p.pos > v.pos - 1500), 1e-12)) as EWMA from rv v",
    "matrix_onsets": "select m.*, coalesce(l.onset, false) as is_onset from matrix m left join (select date, onset from labels) l using (date)",
    "matrix_masked": "select * exclude (is_onset), is_onset as onset, max(is_onset::INTEGER) over (order by pos rows between 10 preceding and 10 following) = 1 as transition from matrix_onsets",
    "har_h1": ols("matrix", ("rv_d", "rv_w", "rv_m"), "target_h1", "HAR"),
    "har_h5": ols("matrix", ("rv_d", "rv_w", "rv_m"), "target_h5", "HAR_h5"),
    "har_h22": ols("matrix", ("rv_d", "rv_w", "rv_m"), "target_h22", "HAR_h22"),
    "forecast": "select m.ticker, m.pos, m.date, m.transition, m.target_h1, m.rv_d as RandomWalk, e.EWMA, h.HAR from matrix_masked m join ewma e using (date) join har_h1 h on h.pos = m.pos",
    "losses": """select pos, date, transition, model, yhat - y as error, exp(y) / greatest(exp(yhat), 1e-12) - ln(exp(y) / greatest(exp(yhat), 1e-12)) - 1 as ql from (select f.pos, f.date, f.transition, f.target_h1 as y, m.model, m.yhat from forecast f,
 lateral (values ('RandomWalk', f.RandomWalk), ('EWMA', f.EWMA), ('HAR', f.HAR)) m(model, yhat) where f.pos >= 750 and f.RandomWalk is not null and f.EWMA is not null and f.HAR is not null and f.target_h1 is not null)""",
    "alarmed": """select pos, date, x, coalesce(case when count(x) over w >= 252 then x > quantile_cont(x, 0.9) over w end, false) as alarm from (select pos, date, var_of_vol as x from vov) window w as (order by pos rows between 504 preceding and 1 preceding)""",
    "leads": "select onset_pos, max(a.pos) is not null as detected, onset_pos - max(a.pos) as lead from onsets left join (select pos from alarmed where alarm) a on a.pos >= onset_pos - 40 and a.pos < onset_pos group by onset_pos",
    "ringing": """select day as pos, coalesce(case when count(x) over w >= 252 then x > quantile_cont(x, 0.9) over w end, false) as alarm from (select pos as day, row_number() over (order by pos) as i, var_of_vol as x from vov where var_of_vol is not null) window w as (order by i rows between 504 preceding and 1 preceding)""",
    "marked": "select pos, sum(new) over (order by pos) as episode from (select pos, coalesce(pos - lag(pos) over (order by pos) > 5, true)::INTEGER as new from ringing where alarm)",
    "episodes": "select episode, min(pos) as first, max(pos) as last, count(*) as days from marked group by episode",
    "first_leads": "select onset_pos, onset_pos - min(first) as lead from onsets left join episodes on first >= onset_pos - 40 and first < onset_pos group by onset_pos",
    "scored": "select (row_number() over (order by v.pos) - 1) as i, v.var_of_vol as score, l.label from vov v join labels l using (pos) where var_of_vol is not null and label is not null",
    "held0": """select model, pos, date, least(2, 0.10 / sqrt(exp(forecast) * 252)) as weight, r_next from (select n.pos, f.date, n.r_next, m.model, m.forecast from forecast f
 join (select pos, date, lead(r) over (order by pos) as r_next from ret) n using (date), lateral (values ('RandomWalk', f.RandomWalk), ('EWMA', f.EWMA), ('HAR', f.HAR)) m(model, forecast) where f.pos >= 750 and f.EWMA is not null and f.HAR is not null) where forecast is not null""",
    "held": "select *, weight * r_next - 1e-4 * turnover as net from (select *, coalesce(abs(weight - lag(weight) over (partition by model order by pos)), 0) as turnover from held0)",
    "all_held": "select model, pos, date, weight, turnover, r_next, net from held union all select distinct 'Buy&Hold', pos, date, 1::DOUBLE, 0::DOUBLE, r_next, r_next from held",
    "equity0": "select model, pos, date, net, product(1 + net) over (partition by model order by pos) as equity from all_held where net is not null",
    "equity": "select *, equity / max(equity) over (partition by model order by pos) - 1 as drawdown from equity0",
    "regime": "select pos, case when log_rv <= q1 then 'Low' when log_rv <= q2 then 'Medium' else 'High' end as regime from rv, (select quantile_cont(log_rv, 1/3::DOUBLE) as q1, quantile_cont(log_rv, 2/3::DOUBLE) as q2 from rv)",
    "fchange": "select pos, h, y from (" + " union all ".join(f"select pos, {h} as h, case when count(rv) over w = {h} then ln(avg(rv) over w) end - log_rv as y from fmatrix window w as (order by pos rows between 1 following and {h} following)" for h in HORIZONS) + ")",
    "ic_pairs": "select f.feature, c.h, f.pos, f.x, c.y from (" + " union all ".join(f"select '{f}' as feature, pos, {f} as x from fmatrix" for f in FACTORS) + ") f join fchange c using (pos)",
    "ic_ranks": """select *, rank() over (partition by feature, h order by x) + (count(*) over (partition by feature, h, x) - 1) / 2 as rx, rank() over (partition by feature, h order by y) + (count(*) over (partition by feature, h, y) - 1) / 2 as ry from ic_pairs where x is not null and y is not null""",
    "ic_products": """select feature, h, row_number() over (partition by feature, h order by pos) - 1 as i, (rx - avg(rx) over g) / stddev_samp(rx) over g * ((ry - avg(ry) over g) / stddev_samp(ry) over g) as d from ic_ranks window g as (partition by feature, h)""",
    "ic_sizes": "select feature, h, count(*) as n, avg(d) as mean, var_pop(d) as v0, floor(1.5 * count(*) ** (1/3::DOUBLE))::INTEGER as lags from ic_products group by feature, h",
    "ic_cov": "select a.feature, a.h, b.i - a.i as k, covar_pop(a.d, b.d) as c from ic_products a join ic_sizes s using (feature, h) join ic_products b on a.feature = b.feature and a.h = b.h and b.i > a.i and b.i <= a.i + s.lags group by all",
    "ic_var": "select s.feature, s.h, s.n, s.mean, s.v0 + coalesce(sum(2 * (1 - c.k / (s.lags + 1)::DOUBLE) * c.c), 0) as v from ic_sizes s left join ic_cov c using (feature, h) group by s.feature, s.h, s.n, s.mean, s.v0",
    "buckets": """select feature, pos, x, case when count(x) over w >= 252 and x is not null then 1 + (x > quantile_cont(x, 0.2) over w)::INTEGER + (x > quantile_cont(x, 0.4) over w)::INTEGER + (x > quantile_cont(x, 0.6) over w)::INTEGER + (x > quantile_cont(x, 0.8) over w)::INTEGER end as bucket
 from (select signal as feature, pos, x from signals_long) window w as (partition by feature order by pos rows between 252 preceding and 1 preceding)""",
    "bucket_table": """select g.feature, g.bucket, avg(y) as mean, count(y) as n from (select distinct feature, b::INTEGER as bucket from buckets, range(1, 6) t(b)) g
 left join (select feature, bucket, change_h5 as y from buckets join change using (pos) where bucket is not null and change_h5 is not null) h on h.feature = g.feature and h.bucket = g.bucket group by g.feature, g.bucket""",
    "vix_days": "select pos, date, case when count(r) over w = 21 then stddev_samp(r) over w * sqrt(252) * 100 end as vix from ret window w as (order by pos rows between 20 preceding and current row)",
    "study_labels": "select r.pos, coalesce(l.onset, false) as onset from ret r left join labels l using (pos) where r.r is not null",
    "study_signals": """select pos, case when count(log_rv) over w5 = 5 then avg(log_rv) over w5 end as realized_vol, ln(vix) as VIX, corr_length from (select r.pos, v.log_rv, x.vix, c.corr_length from ret r join rv v using (pos) left join vix_days x using (pos) left join cross_section c using (pos) where r.r is not null)
 window w5 as (order by pos rows between 4 preceding and current row)""",
    "ez": """select signal, pos, case when count(x) over w >= 126 then (x - avg(x) over w) / (stddev_samp(x) over w + 1e-12) end as value from (select s.pos, v.signal, v.x from study_signals s, lateral (values ('realized_vol', s.realized_vol), ('VIX', s.VIX), ('corr_length', s.corr_length)) v(signal, x))
 window w as (partition by signal order by pos rows between 251 preceding and current row)""",
    "size": "select min(pos) as low, max(pos) + 1 as high, count(*) as n from study_labels",
    "study_days": "select pos as day from study_labels, size where onset and pos - low > 292 and pos < high - 10",
    "placebo": "select d as draw, (low + 292 + (d * 7919 + k * 104729 + d * k * 17) % greatest(1, high - low - 11 - 292)) as day from size, range(0, 1000) a(d), (select unnest(range(0, (select count(*) from study_days))) as k) b",
    "study": """select s.signal, s.t, s.mean, s.onsets, b.low, b.high from (select signal, t, avg(value) as mean, count(value) as onsets from study_days, range(-40, 11) r(t) join ez on ez.pos = day + t where value is not null group by signal, t) s
 left join (select signal, t, quantile_cont(m, 0.025) as low, quantile_cont(m, 0.975) as high from (select signal, t, draw, avg(value) as m from placebo, range(-40, 11) r(t) join ez on ez.pos = day + t where value is not null group by signal, t, draw) group by signal, t) b using (signal, t)""",
    "path_days": "select pos as day from study_labels, size where onset and pos - low > 40 and pos < high - 20",
    "path_placebo": "select low + 40 + (k * 104729) % (high - low - 60) as day from size, range(0, 500) a(k)",
    "slong": "select signal, pos, x as value from signals_long union all select signal, pos, value from ez where signal <> 'corr_length'",
    "sringing": """select signal, day as pos, coalesce(case when count(value) over w >= 252 then value > quantile_cont(value, 0.9) over w end, false) as alarm from (select signal, pos as day, row_number() over (partition by signal order by pos) as i, value from slong where value is not null)
 window w as (partition by signal order by i rows between 504 preceding and 1 preceding)""",
    "sepisodes": "select signal, episode, min(pos) as first from (select signal, pos, sum(new) over (partition by signal order by pos) as episode from (select signal, pos, coalesce(pos - lag(pos) over (partition by signal order by pos) > 5, true)::INTEGER as new from sringing where alarm)) group by signal, episode",
    "rolled": """select s::VARCHAR as signal, (low + (pos - low + s) % n)::INTEGER as pos, value from (select l.pos, e.value from study_labels l left join (select pos, value from ez where signal = 'realized_vol') e using (pos)), size, (values (500), (1000), (1500), (2000)) v(s)""",
    "cringing": "select signal, pos, coalesce(case when count(value) over w >= 252 then value > quantile_cont(value, 0.9) over w end, false) as alarm from rolled window w as (partition by signal order by pos rows between 504 preceding and 1 preceding)",
    "cepisodes": "select signal, episode, min(pos) as first from (select signal, pos, sum(new) over (partition by signal order by pos) as episode from (select signal, pos, coalesce(pos - lag(pos) over (partition by signal order by pos) > 5, true)::INTEGER as new from cringing where alarm)) group by signal, episode",
    "fmatrix0": "select t.*, c.corr_length, h.temperature, s.susceptibility, s.acf1, v.var_of_vol, ln(x.vix) as log_vix from targets t join cross_section c using (pos) join heat_z h using (pos) join shocks s using (pos) join vov v using (pos) join vix_days x using (pos)",
    "heat_z": "select pos, case when count(heat) over w >= 126 then (heat - avg(heat) over w) / (stddev_samp(heat) over w + 1e-12) end as temperature from heat window w as (order by pos rows between 251 preceding and current row)",
    "fmatrix": "select * replace ((row_number() over (order by pos) - 1)::INTEGER as pos) from fmatrix0 where rv_m is not null and target_h22 is not null and corr_length is not null and temperature is not null and susceptibility is not null and acf1 is not null and var_of_vol is not null and log_vix is not null",
    "dm_long": """select a, scope, pos, d from (select pos, transition, a, max(ql) filter (model = a) - max(ql) filter (model = 'RandomWalk') as d from losses, (values ('EWMA'), ('HAR')) v(a) group by pos, transition, a), lateral (values ('all'), (case when transition then 'transition' else 'calm' end)) s(scope) where d is not null""",
    "dm_rows": "select a, scope, row_number() over (partition by a, scope order by pos) - 1 as i, d from dm_long",
    "dm_sizes": "select a, scope, count(*) as n, avg(d) as mean, var_pop(d) as v0, greatest(0, floor(1.5 * count(*) ** (1/3::DOUBLE)))::INTEGER as lags from dm_rows group by a, scope",
    "dm_cov": "select x.a, x.scope, y.i - x.i as k, covar_pop(x.d, y.d) as c from dm_rows x join dm_sizes s on s.a = x.a and s.scope = x.scope join dm_rows y on y.a = x.a and y.scope = x.scope and y.i > x.i and y.i <= x.i + s.lags group by all",
    "dm_var": "select s.a, s.scope, s.n, s.mean, s.v0 + coalesce(sum(2 * (1 - c.k / (s.lags + 1)::DOUBLE) * c.c), 0) as v from dm_sizes s left join dm_cov c on c.a = s.a and c.scope = s.scope group by s.a, s.scope, s.n, s.mean, s.v0",
    "dm_t": "select a, scope, n, mean, case when n >= 30 and v > 0 then mean / sqrt(v / n) end as dm from dm_var",
    # Twice the normal tail beyond |dm|, by Simpson's rule over ten units.
    "dm_p": "select *, case when dm is not null then list_sum(list_transform(range(0, 4001), lambda k: (case when k in (0, 4000) then 1 when k % 2 = 1 then 4 else 2 end) * exp(-0.5::DOUBLE * (abs(dm) + k * 0.0025::DOUBLE) * (abs(dm) + k * 0.0025::DOUBLE)))) * 0.0025::DOUBLE / 3 * sqrt(2 / pi()) end as p from dm_t",
}


def sql(text: str, digits: str = "", exact: str = "") -> str:
    """`select` columns of a text's result, with the expressions that it needs in front, each after those that it needs. digits: columns to round to six places; exact: others."""
    parts: dict[str, str] = {}

    def need(words: str, above: tuple[str, ...] = ()) -> None:
        for word in re.findall(r"\w+", words):
            if word in C and word not in parts and word not in above:
                need(C[word], (*above, word))
                parts[word] = f"{word} as ({C[word]})"

    need(text)
    columns = [*exact.split(), *(f"round({c}, 6) + 0.0 as {c}" for c in digits.split())]
    return (f"with {', '.join(parts.values())} " if parts else "") + f"select {', '.join(columns)} from ({text})"

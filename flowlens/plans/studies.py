"""Queries on snapshots, smart-money events, event studies and screening, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import events as ev
from flowlens.operators import fifo as ff
from flowlens.operators import holdings as ho
from flowlens.operators import hypothesis as hy
from flowlens.operators import screening as sc
from flowlens.operators import series as se
from flowlens.operators import smart_money as sm
from flowlens.operators import strength as st
from flowlens.plans.catalog import _CTE, _NEEDS, HORIZONS, TRAIN_END, query, rd
from flowlens.plans.inference import DRAWS, compared_sql, market
from flowlens.plans.rankings import _CENTS, TOP, _period, marks, mdaily, top
from flowlens.sources import tables as tb

# ---------------------------------------------------------------- snapshots, filled closes

_SNAPS = [("1996-12-31", "1993-12-31"), ("1997-06-30", "1994-06-30"), ("1998-03-31", "1995-03-31"), ("1999-06-30", "1996-06-30"), ("2000-02-29", "1997-02-28"), ("2000-11-04", "1997-11-04")]


def snapshot_dates(t):
    return t.spark.createDataFrame(_SNAPS, "at string, start string").select(F.col("at").cast("date").alias("at"), F.col("start").cast("date").alias("start"))


@query("marks", " union all ".join(f"select date '{b}' as at, symbol, broker, round(total_pnl, 2) total_pnl, row_number() over (partition by symbol order by {_CENTS}) pos from {_period(f"date '{a}'", f"date '{b}'")}" for b, a in _SNAPS))
def e7_snapshot_rankings(t):
    return ho.snapshots(marks(t), snapshot_dates(t)).select("at", "symbol", "broker", rd("total_pnl", 2).alias("total_pnl"), "pos")


_GAPS = """gap as (select symbol, date, last_value(case when date_part('day', date) % 7 <> 0 then "close" end ignore nulls) over (partition by symbol order by date rows unbounded preceding) "close" from prices)"""


@query("pos prices", f""", {_GAPS} select p.symbol, p.broker, p.date, round((cost_s - cost_b) - coalesce(lag(cost_s - cost_b) over (partition by p.symbol, p.broker order by p.date), 0), 3) realized_pnl, round((b - s) * "close" - (bc - cost_b) + (sc - cost_s), 3) unrealized_pnl
    from pos p join gap q on p.symbol = q.symbol and p.date = q.date where "close" is not null""")
def d1_d4_filled_fifo(t):
    """FIFO where some days have no close: they are marked at the last one known, and their realised profit stays."""
    closes = se.filled_closes(t.closes.where(F.day("date") % 7 != 0), t.closes.select("symbol", "date"))
    closes = tb.stored(closes, tb.workspace(t.spark, "filled"), "closes")
    return ff.fifo_daily(t.account_days, closes).select("symbol", "broker", "date", rd("realized_pnl", 3).alias("realized_pnl"), rd("unrealized_pnl", 3).alias("unrealized_pnl"))


# ---------------------------------------------------------------- smart-money events and their study

#: Scaled to the tables, whose 25 firms trade in even lots: twelve brokers, 60 days of history, trades from 1.2 and events from 1.5 standard deviations.
_K, _HISTORY, _SIGMA, _LARGE = 12, 60, 1.5, 1.2
_CTE["slarge"] = _CTE["mlarge"].replace("mlarge as", "slarge as").replace("abs(z) > 2", f"abs(z) > {_LARGE}")
_NEEDS["slarge"] = ["mdaily"]
_TURNED = """sums as (select symbol, date, sum(net) over w sm, count(*) over w c from {net} window w as (partition by symbol order by date rows 4 preceding)),
    zs as (select symbol, date, (sm - avg(sm) over w) / nullif(stddev_samp(sm) over w, 0) z from sums where c = 5 window w as (partition by symbol)),
    ds as (select symbol, date, z, case when z > 0 then 1 else -1 end direction from zs where abs(z) > {sigma})
    select symbol, date, round(z, 5) signal_value, direction from (select *, lag(direction) over (partition by symbol order by date) before from ds) where before <> direction"""
_SMART = f"""cm as (select *, sum(realized_pnl) over (partition by symbol, broker order by date range between interval 1094 days preceding and current row) + unrealized_pnl total_pnl from marks),
    srk as (select symbol, broker, date, row_number() over (partition by symbol, date order by {_CENTS}) pos from cm), hd as (select symbol, date, row_number() over (partition by symbol order by date) n from (select distinct symbol, date from marks)),
    snet as (select l.symbol, l.date, sum(direction) net from slarge l join srk on srk.symbol = l.symbol and srk.broker = l.broker and srk.date = l.date join hd on hd.symbol = l.symbol and hd.date = l.date where pos <= {_K} and n > {_HISTORY} group by all)"""
_FINAL = f"fr as (select *, row_number() over (partition by symbol order by {_CENTS}) pos, count(*) over (partition by symbol) n from (select symbol, broker, sum(realized_pnl) realized_pnl, arg_max(unrealized_pnl, date) unrealized_pnl, sum(realized_pnl) + arg_max(unrealized_pnl, date) total_pnl from marks group by all))"
_PLACEBO = f"""{_FINAL}, dn as (select symbol, broker from (select *, row_number() over (partition by symbol order by md5(concat_ws('|', '42', symbol, broker)), broker) a from fr where pos > {_K} and n >= {2 * _K}) where a <= {_K}),
    pnet as (select symbol, date, net from (select *, row_number() over (partition by symbol order by date) n from (select symbol, date, sum(direction) net from slarge semi join dn using (symbol, broker) group by all)) where n > {_HISTORY})"""


def _made(t):
    m = tb.stored(marks(t), tb.workspace(t.spark, "study"), "marks")
    large = ev.large_trades(mdaily(t), _LARGE)
    return sm.smart_events(m, large, _K, 5, _SIGMA, 3, _HISTORY), sm.placebo_events(m, large, _K, 5, _SIGMA, _HISTORY)


@query("marks slarge", f", {_SMART}, {_TURNED.format(net='snet', sigma=_SIGMA)}")
def g3_smart_money_events(t):
    return _made(t)[0].withColumn("signal_value", rd("signal_value", 5))


@query("marks slarge", f", {_PLACEBO}, {_TURNED.format(net='pnet', sigma=_SIGMA)}")
def g4_placebo_events(t):
    return _made(t)[1].withColumn("signal_value", rd("signal_value", 5))


@query("marks", f", {_FINAL} select symbol, broker, round(realized_pnl, 2) realized_pnl, round(unrealized_pnl, 2) unrealized_pnl, round(total_pnl, 2) total_pnl, pos from fr")
def g5_final_ranking(t):
    return sm.final_ranking(marks(t)).select("symbol", "broker", *[rd(c, 2).alias(c) for c in ("realized_pnl", "unrealized_pnl", "total_pnl")], "pos")


_STUDY_EVENTS = f"""select symbol, side, date, 1 direction from (select *, count(*) over (partition by symbol, side) c from (select symbol, date, case when direction = 1 then 'accumulation' else 'distribution' end side from ({_TURNED.format(net='snet', sigma=_SIGMA).replace('sums as', 'with sums as', 1)})
    union all select symbol, date, 'placebo' from ({_TURNED.format(net='pnet', sigma=_SIGMA).replace('sums as', 'with sums as', 1)}))) where c >= case when side = 'placebo' then 10 else 3 end"""


@query("marks slarge prices", f""", {_SMART}, {_PLACEBO}, {compared_sql(_STUDY_EVENTS, "side", settle=False)}, hs as (select symbol, max(h) hits from (select symbol, side, count(*) filter (significant) h from tests where side <> 'placebo' group by all) group by 1),
    ps as (select symbol, min(p) < 0.05 ps from tests where side = 'placebo' and n >= 5 group by 1)
    select symbol, side, horizon, n, round(m, 3) mean_bps, round(t, 5) t, round(d, 5) d, round(p, 6) p, significant, case when h.hits >= 2 then 'significant' when h.hits = 1 then 'marginal' else 'no_effect' end conclusion, coalesce(ps, false) and h.hits >= 1 placebo_significant
    from tests join hs h using (symbol) left join ps using (symbol) where side <> 'placebo' and n >= 3""")
def l9_event_study(t):
    smart, placebo = _made(t)
    x = sm.event_study(smart, placebo, t.prices, HORIZONS, DRAWS)
    return x.select("symbol", "side", "horizon", "n", rd("mean_bps", 3).alias("mean_bps"), rd("t", 5).alias("t"), rd("d", 5).alias("d"), rd("p", 6).alias("p"), "significant", "conclusion", "placebo_significant")


@query()
def k19_pooled_study(t):
    """Standardised returns of all symbols' events in one pool, 2,000 draws. No twin: the pool is numbered by a hash that SQL lacks; a test holds p against draws in numpy."""
    return sm.pooled_study(_made(t)[0], t.prices, HORIZONS, 2000)


# ---------------------------------------------------------------- screening

WINDOWS = sc.Windows("1996-01-01", "1999-06-30", "1999-07-01", "2001-11-04")
_W = (WINDOWS.train_start, WINDOWS.train_end, WINDOWS.test_start, WINDOWS.test_end)
#: The twin lays out every account on every date.
_DENSE = f"""b as (select *, lead(ret) over (partition by symbol order by date) nxt from (select symbol, date, "close", coalesce(case when pc > 0 then "close" / pc - 1 end, 0) ret from (select *, lag("close") over (partition by symbol order by date) pc from prices) where date between date '{_W[0]}' and date '{_W[3]}')),
    x as (select d.symbol, d.broker, d.date, buy_shares - sell_shares net from mdaily d semi join b on b.symbol = d.symbol and b.date = d.date),
    g as (select a.symbol, a.broker, b.date, ret, nxt, coalesce(net, 0) net from (select distinct symbol, broker from x) a join b on b.symbol = a.symbol left join x on x.symbol = a.symbol and x.broker = a.broker and x.date = b.date),
    s as (select symbol, broker, avg(net) mean, stddev_pop(net) std from g group by all having stddev_pop(net) > 1e-9),
    l as (select g.*, mean, std, abs(net - mean) > 2 * std big from g join s on s.symbol = g.symbol and s.broker = g.broker),
    sp as (select symbol, broker, n1, n0, case when n1 >= 3 and n0 >= 3 then m1 - m0 end spread, case when n1 >= 3 and n0 >= 3 then coalesce((m1 - m0) / nullif(sqrt(v1 / n1 + v0 / n0), 0), 0) end t from
        (select symbol, broker, count(*) filter (big) n1, count(*) filter (not big) n0, avg(nxt) filter (big) m1, avg(nxt) filter (not big) m0, var_samp(nxt) filter (big) v1, var_samp(nxt) filter (not big) v0 from l where nxt is not null group by all)),
    tg as (select symbol, broker, date, net, lead(ret) over (partition by symbol, broker order by date) nr from g where date <= date '{_W[1]}'),
    ta as (select symbol, broker, case when count(*) >= 2 and stddev_pop(net) > 1e-9 then (sum(net * coalesce(nr, 0)) - avg(net) * sum(nr)) / stddev_pop(net) else 0 end ta from tg group by all),
    sg as (select l.symbol, l.date, any_value(l.ret) ret, sum(case when big then ta * (net - mean) / std else 0 end) signal from l join ta on ta.symbol = l.symbol and ta.broker = l.broker group by all)"""


@query("mdaily prices", f", {_DENSE} select symbol, broker, n1 large_days, n0 other_days, round(spread * 10000, 3) spread_bps, round(t, 5) t, t > 1.96 significant from sp where t is not null")
def m1_large_day_spread(t):
    """Next return after an account's large days less that after all its other dates, those without trades included."""
    d, b = mdaily(t), sc.bars(t.prices, WINDOWS)
    x = sc.spreads(d, b, sc.accounts(d, b)).where("t is not null")
    return x.select("symbol", "broker", "large_days", "other_days", rd(F.col("spread") * 10000, 3).alias("spread_bps"), rd("t", 5).alias("t"), (F.col("t") > 1.96).alias("significant"))


@query("mdaily prices", f", {_DENSE} select symbol, date, round(signal, 6) signal from sg")
def m2_weighted_signal(t):
    d, b = mdaily(t), sc.bars(t.prices, WINDOWS)
    return sc.weighted_signal(d, t.prices, b, sc.accounts(d, b), WINDOWS).withColumn("signal", rd("signal", 6))


_CORR = " ".join(f"""{s} as (select symbol, case when n >= 10 and abs(r) < 1 then r else 0 end r, case when n >= 10 and abs(r) < 1 then r * sqrt(n - 2) / sqrt(1 - r * r) else 0 end t from (select symbol, count(*) n, corr(before, ret) r from sb where {cond} group by 1)),""" for s, cond in (("trc", f"date <= date '{_W[1]}'"), ("tec", f"date >= date '{_W[2]}'")))
_FUNNEL = f"""sb as (select *, lag(signal) over (partition by symbol order by date) before from sg qualify lag(signal) over (partition by symbol order by date) is not null), {_CORR}
    base as (select symbol, starts_with(symbol, 'Brand#1') fund, coalesce(bool_or(len(list_filter([0.5, 1.0/3, 0.25, 0.2, 0.1, 2, 3, 4, 5, 10], lambda x: abs(ratio / x - 1) <= 0.0003)) > 0), false) split, count(*) filter (date between date '{_W[0]}' and date '{_W[1]}') trd, count(*) filter (date between date '{_W[2]}' and date '{_W[3]}') ted
        from (select *, "close" / lag("close") over (partition by symbol order by date) ratio from prices) group by 1),
    tu as (select symbol, avg(shares * "close") turnover from (select symbol, date, sum(buy_shares) shares from mdaily where date between date '{_W[0]}' and date '{_W[1]}' group by all) join prices using (symbol, date) where "close" > 0 group by 1),
    va as (select symbol, count(*) nb, count(*) filter (t > 1.96) ns from sp group by 1),
    fu as (select base.symbol, case when fund then 'fund' when split then 'split' when trd < 30 then 'train days' when ted < 20 then 'test days' end early, coalesce(turnover, 0) turnover, coalesce(nb, 0) nb, coalesce(ns, 0) ns from base left join tu using (symbol) left join va using (symbol)),
    re as (select *, case when early is not null then early when turnover < 4e4 then 'turnover' when nb = 0 then 'no brokers' when ns < 0.05 * nb then 'few significant' else 'passed' end reason, case when early is not null then 0 when turnover < 4e4 then 1 when nb = 0 or ns < 0.05 * nb then 2 else 3 end stage from fu),"""


def funnel(t):
    folder = tb.workspace(t.spark, "funnel")
    return sc.funnel(tb.stored(mdaily(t), folder, "daily"), tb.stored(t.prices, folder, "prices"), WINDOWS, least_turnover=4e4, least_test_days=20, fund_prefix="Brand#1", tolerance=0.0003)


def _p(t: str) -> str:
    from flowlens.functions.stats import erfc_sql

    return f"case when {t} = 0 then 1 else {erfc_sql(f'(abs({t})/sqrt(2.0))')} end"


@query("mdaily prices", f""", {_DENSE}, {_FUNNEL} ou as (select re.symbol, stage, reason, case when stage >= 2 then nb end n_brokers, case when stage >= 2 then ns end n_significant, case when stage >= 1 then turnover end avg_turnover,
        case when stage = 3 then trc.r end train_corr, case when stage = 3 then tec.r end test_corr, case when stage = 3 then {_p("tec.t")} end test_p from re left join trc on trc.symbol = re.symbol left join tec on tec.symbol = re.symbol),
    bh as (select symbol, k <= coalesce(max(k) filter (p9 <= 0.05 * k / nt) over (), 0) rejected from (select symbol, round(test_p, 9) p9, row_number() over (order by round(test_p, 9), symbol) k, count(*) over () nt from ou where stage = 3))
    select symbol, stage, reason, n_brokers, n_significant, round(avg_turnover, 2) avg_turnover, round(train_corr, 6) train_corr, round(test_corr, 6) test_corr, round(test_p, 5) test_p, rejected from ou left join bh using (symbol)""")
def m5_screening_funnel(t):
    """Limits are scaled to the tables: closes jump, so that a split is a ratio within 0.03 %; turnover from 4e4; symbols Brand#1x stand for funds."""
    return funnel(t).select("symbol", "stage", "reason", "n_brokers", "n_significant", rd("avg_turnover", 2).alias("avg_turnover"), rd("train_corr", 6).alias("train_corr"), rd("test_corr", 6).alias("test_corr"), rd("test_p", 5).alias("test_p"), "rejected")


@query("mdaily prices", f", {_DENSE}, {_FUNNEL} co as (select stage, reason, count(*) n from re group by all) select stage, reason, n from co")
def m5_funnel_counts(t):
    return funnel(t).groupBy("stage", "reason").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- strength of signals, export

_ADDED = f"""{TOP}, ad as (select symbol, date, count(*) signal_count, sum(buy_amount) amount from marks semi join top using (symbol, broker) where net > 0 and buy_shares > sell_shares group by all),
    ch as (select symbol, date, sum(buy_shares + sell_shares) / (abs(sum(buy_shares - sell_shares)) + 1) churn from marks semi join top using (symbol, broker) group by all),
    ae as (select ad.symbol, ad.date, signal_count, amount, coalesce(churn, 1.0) churn, count(*) over (partition by ad.symbol order by ad.date range between interval 7 days preceding and current row) persistence from ad left join ch on ch.symbol = ad.symbol and ch.date = ad.date)"""
_RET = " union all ".join(f'select symbol, date, {h} horizon, (lead("close", {h}) over (partition by symbol order by date) / "close" - 1) * 10000 ret from prices' for h in HORIZONS)
_STRENGTH = f"""{_ADDED}, mv as (select 'signal_count' metric, symbol, date, cast(signal_count as double) raw from ae union all select 'log_churn', symbol, date, ln(churn) from ae where churn > 0 union all select 'log_amount', symbol, date, ln(amount + 1) from ae union all select 'persistence', symbol, date, cast(persistence as double) from ae),
    qa as (select metric, quantile_cont(raw, 0.01) lo, quantile_cont(raw, 0.99) hi from mv group by 1), cv as (select metric, symbol, date, least(greatest(raw, lo), hi) v from mv join qa using (metric)),
    qb as (select metric, quantile_cont(v, 0.0) e0, quantile_cont(v, 1.0 / 3) e1, quantile_cont(v, 2.0 / 3) e2, quantile_cont(v, 1.0) e3 from cv group by 1),
    qc as (select metric, list_sort(list_distinct([e0, e1, e2, e3])) es, e0, e3 from qb), ed as (select metric, case when len(es) >= 3 then es else [e0, e0 + (e3 - e0) / 2, e3 + 0.001] end es from qc),
    gv as (select cv.*, es, len(list_filter(es[2:], lambda e: e < v)) grp from cv join ed using (metric)),
    vo as (select symbol, stddev_samp(r) vol from (select symbol, "close" / lag("close") over (partition by symbol order by date) - 1 r from prices) group by 1 having count(r) > 30 and stddev_samp(r) > 0),
    rr as (select a.symbol, a.date, a.horizon, coalesce((a.ret - coalesce(b.ret, 0)) / (vol * sqrt(a.horizon) * 10000), a.ret - coalesce(b.ret, 0)) ret from ({_RET}) a left join (select * from ({_RET}) where symbol = 'Brand#11') b on b.date = a.date and b.horizon = a.horizon left join vo on vo.symbol = a.symbol where a.ret is not null),
    xx as (select metric, horizon, grp, symbol, date, v, ret from gv join rr using (symbol, date)),
    zz as (select x.*, c.v z from xx x left join (select symbol, date, v from cv where metric = 'signal_count') c using (symbol, date)),
    rk as (select metric, horizon, rank() over (partition by metric, horizon order by v) + (count(*) over (partition by metric, horizon, v) - 1) / 2 rx, rank() over (partition by metric, horizon order by ret) + (count(*) over (partition by metric, horizon, ret) - 1) / 2 ry, rank() over (partition by metric, horizon order by z) + (count(*) over (partition by metric, horizon, z) - 1) / 2 rz from zz),
    sp as (select metric, horizon, count(*) n, 1 - 6 * sum(power(rx - ry, 2)) / (count(*) * (power(count(*), 2) - 1)) xy, 1 - 6 * sum(power(rx - rz, 2)) / (count(*) * (power(count(*), 2) - 1)) xz, 1 - 6 * sum(power(ry - rz, 2)) / (count(*) * (power(count(*), 2) - 1)) yz from rk group by all having count(*) >= 10),
    gr as (select ed.metric, ed.es, u.g grp, h.horizon from ed, unnest(range(len(es) - 1)) u(g), (select unnest([{", ".join(map(str, HORIZONS))}]) horizon) h),
    gs as (select gr.*, coalesce(c.n, 0) n, coalesce(m.mean, 0) mean from gr left join (select metric, grp, count(*) n from gv group by all) c using (metric, grp) left join (select metric, grp, horizon, avg(ret) mean from xx group by all) m using (metric, grp, horizon)),
    gm as (select *, coalesce(mean < lag(mean) over (partition by metric, horizon order by grp), false) falls from gs)"""


@query("marks prices", f""", {_STRENGTH} select metric, cast(horizon as int) horizon, cast(grp as int) grp, round(es[grp + 1], 6) lo, round(es[grp + 2], 6) hi, gm.n n, round(mean, 6) mean, not bool_or(falls) over w monotonic, round(coalesce(xy, 0), 6) spearman,
    round(coalesce(case when metric = 'signal_count' then xy when (1 - xz * xz) * (1 - yz * yz) > 0 then (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) else 0 end, 0), 6) partial, round(arg_max(mean, grp) over w - arg_min(mean, grp) over w, 6) top_vs_bottom
    from gm left join sp using (metric, horizon) window w as (partition by metric, horizon)""")
def k18_l8_strength(t):
    """Sizes of the signals of brokers adding to what they hold, against excess returns by deviation. Brand#11 stands for the market; one broker is enough for a signal here."""
    folder = tb.workspace(t.spark, "strength-events")
    m, prices = tb.stored(marks(t), folder, "marks"), tb.stored(t.prices, folder, "prices")
    e = tb.stored(ho.adding(m, top(t, m), 1), folder, "events")
    x = st.strength(st.metrics_of(e), st.excess_returns(e, prices, HORIZONS, "Brand#11"), "signal_count")
    return x.select("metric", "horizon", "grp", rd("lo", 6).alias("lo"), rd("hi", 6).alias("hi"), "n", rd("mean", 6).alias("mean"), "monotonic", rd("spearman", 6).alias("spearman"), rd("partial", 6).alias("partial"), rd("top_vs_bottom", 6).alias("top_vs_bottom"))


_EXPORT_FOLD = hy.Fold("all", TRAIN_END, "1999-07-01", "2001-11-04")


@query()
def l7_event_export(t):
    """Events of the significant symbols of a scan, none within ten days after one that counts. No twin: which symbols are significant is drawn with 10,000 draws."""
    return hy.exported(market(t), "contrarian_smart", _EXPORT_FOLD, 10)

"""Queries on returns of signals and scorecards of accounts, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions import stats
from flowlens.operators import backtest as bt
from flowlens.operators import events as ev
from flowlens.operators import fifo as ff
from flowlens.operators import permutation as pm
from flowlens.operators import scorecards as so
from flowlens.operators import screening as sc
from flowlens.operators import series as se
from flowlens.operators import smart_money as sm
from flowlens.plans.catalog import HORIZONS, _EVENTS, query, rd
from flowlens.plans.inference import _K4, DRAWS
from flowlens.plans.rankings import day, marks, mdaily, names
from flowlens.plans.studies import _DENSE, _FINAL, _W, WINDOWS
from flowlens.sources import tables as tb

# ---------------------------------------------------------------- sessions of the weighted signal

_COST = bt.COST
_SESSIONS = f"""{_DENSE}, tp as (select p.symbol, p.date, open, "close", coalesce(signal, 0) sig from prices p left join sg on sg.symbol = p.symbol and sg.date = p.date where p.date between date '{_W[2]}' and date '{_W[3]}'),
    tl as (select *, lag(sig) over w before, lag("close") over w lc, row_number() over w r from tp window w as (partition by symbol order by date)),
    se as (select symbol, date, case when open > 0 and before > 0 then 'long' when open > 0 and before < 0 then 'short' end side, case when open > 0 and before > 0 then "close" / open - 1 - {_COST} when open > 0 and before < 0 then -("close" / open - 1) - {_COST} else 0 end ret, case when lc > 0 then "close" / lc - 1 else 0 end hold from tl where r > 1)"""
_GROWN = "product(1 + {}) over (partition by {} order by date)"


def sessions(t):
    folder = tb.workspace(t.spark, "sessions")
    d, prices = tb.stored(mdaily(t), folder, "daily"), tb.stored(t.prices, folder, "prices")
    b = tb.stored(sc.bars(prices, WINDOWS), folder, "bars")
    s = tb.stored(sc.accounts(d, b), folder, "accounts")
    return tb.stored(bt.sessions(sc.weighted_signal(d, prices, b, s, WINDOWS), prices, WINDOWS.test()), folder, "sessions")


@query("mdaily prices", f", {_SESSIONS} select symbol, date, side, round(ret, 8) ret, round(hold, 8) hold from se")
def m6_sessions(t):
    return sessions(t).select("symbol", "date", "side", rd("ret", 8).alias("ret"), rd("hold", 8).alias("hold"))


def _performance_sql(source: str, key: str, value: str = "ret") -> str:
    return f"""(select {key}, count(*) as days, arg_max(eq, date) - 1 total_return, case when stddev_pop({value}) > 0 then avg({value}) / stddev_pop({value}) * sqrt(252) else 0 end sharpe, least(min(eq / pk - 1), 0) max_drawdown
        from (select *, greatest(max(eq) over (partition by {key} order by date), 1.0) pk from (select *, {_GROWN.format(value, key)} eq from {source})) group by 1)"""


@query("mdaily prices", f"""{", " + _SESSIONS} select symbol, a.days, round(sign(a.total_return) * ln(1 + abs(a.total_return)), 6) growth, round(a.sharpe, 5) sharpe, round(sign(a.max_drawdown) * ln(1 + abs(a.max_drawdown)), 6) drawdown, round(case when a.max_drawdown < 0 then sign(a.total_return) * ln(1 + abs(a.total_return / -a.max_drawdown)) else 0 end, 6) calmar, round(b.total_return, 6) hold_return, round(b.sharpe, 5) hold_sharpe, round(b.max_drawdown, 6) hold_drawdown
    from {_performance_sql("se", "symbol")} a join {_performance_sql("se", "symbol", "hold")} b using (symbol)""")
def m7_m8_strategy_performance(t):
    x = sessions(t)
    # a session of these tables can lose more than all, so that totals are given by their logarithm, with the sign of the total
    scaled = lambda c: F.signum(c) * F.log1p(F.abs(c))
    hold = bt.performance(x, ("symbol",), "hold").select("symbol", *[F.col(c).alias(n) for c, n in (("total_return", "hold_return"), ("sharpe", "hold_sharpe"), ("max_drawdown", "hold_drawdown"))])
    p = bt.performance(x, ("symbol",)).join(hold, "symbol")
    return p.select("symbol", "days", *[rd(scaled(F.col(c)), 6).alias(n) for c, n in (("total_return", "growth"), ("max_drawdown", "drawdown"), ("calmar", "calmar"))], *[rd(c, n).alias(c) for c, n in (("sharpe", 5), ("hold_return", 6), ("hold_sharpe", 5), ("hold_drawdown", 6))])


@query("mdaily prices", f", {_SESSIONS} select symbol, strftime(date, '%Y-%m') as month, round((product(1 + ret) - 1) * 100, 4) ret, round((product(1 + hold) - 1) * 100, 4) hold from se group by all")
def m9_strategy_months(t):
    return bt.monthly(sessions(t)).select("symbol", "month", rd("ret").alias("ret"), rd("hold").alias("hold"))


_SIDE = ", ".join(f"count(*) filter (side = '{s}') n_{s}, round(coalesce(avg(ret) filter (side = '{s}'), 0), 8) avg_{s}, round(coalesce(avg(cast(ret > 0 as int)) filter (side = '{s}'), 0), 6) win_{s}" for s in ("long", "short"))


@query("mdaily prices", f", {_SESSIONS} select symbol, {_SIDE} from se group by 1")
def m10_side_stats(t):
    x = bt.sides(sessions(t))
    return x.select("symbol", *[c for s in ("long", "short") for c in (F.col(f"n_{s}"), rd(f"avg_{s}", 8).alias(f"avg_{s}"), rd(f"win_{s}", 6).alias(f"win_{s}"))])


# ---------------------------------------------------------------- portfolios of signals

_SIGNALS = f"""ev as ({_EVENTS.replace("from large", "from mlarge")}), si as (select 'large' strategy, symbol, date, direction from ev union all select 'contrary', symbol, date, -direction from ev union all select 'buyers', symbol, date, 1 from (select symbol, date from mdaily where buy_shares > sell_shares group by all having count(*) >= 3))"""


def signals(t):
    e = ev.large_trade_events(ev.large_trades(mdaily(t))).select("symbol", "date", "direction")
    buyers = mdaily(t).where("buy_shares > sell_shares").groupBy("symbol", "date").agg(F.count("*").alias("n")).where("n >= 3").select(F.lit("buyers").alias("strategy"), "symbol", "date", F.lit(1).alias("direction"))
    named = lambda name, sign: e.select(F.lit(name).alias("strategy"), "symbol", "date", (F.col("direction") * sign).alias("direction"))
    return named("large", 1).unionByName(named("contrary", -1)).unionByName(buyers)


@query("mdaily exact_mlarge prices", f""", {_SIGNALS}, nx as (select symbol, date, lead(date) over w nd, lead(open) over w no, lead("close") over w nc from prices window w as (partition by symbol order by date)),
    pd as (select strategy, nd date, avg(direction * (nc / no - 1)) - {_COST} ret from si join nx using (symbol, date) where no > 0 group by all), wr as (select strategy, avg(cast(ret > 0 as int)) wr from pd group by 1),
    eq as (select *, sum(ln(case when 1 + ret = 0 then 1 else abs(1 + ret) end)) over w size, case when count(*) filter (1 + ret = 0) over w > 0 then 0 when count(*) filter (1 + ret < 0) over w % 2 = 1 then -1 else 1 end sg from pd window w as (partition by strategy order by date)),
    pk as (select *, greatest(max(case when sg > 0 then size end) over (partition by strategy order by date), 0.0) peak from eq),
    pf as (select strategy, count(*) as days, arg_max(size, date) log_equity, arg_max(sg, date) equity_sign, case when stddev_pop(ret) > 0 then avg(ret) / stddev_pop(ret) * sqrt(252) else 0 end sharpe, least(min(sg * exp(size - peak) - 1), 0) max_drawdown from pk group by 1)
    select strategy, days, round(log_equity, 6) log_equity, equity_sign, round(sharpe, 5) sharpe, round(max_drawdown, 6) max_drawdown, round(wr, 6) win_rate, row_number() over (order by floor(sharpe * 1e9 + 0.5) desc, strategy) as rank from pf join wr using (strategy)""")
def m12_signal_portfolios(t):
    """Equity as the logarithm of its size and its sign: over these tables the total itself leaves the range of a double."""
    p = bt.portfolio(signals(t), t.prices)
    return p.select("strategy", "days", rd("log_equity", 6).alias("log_equity"), "equity_sign", rd("sharpe", 5).alias("sharpe"), rd("max_drawdown", 6).alias("max_drawdown"), rd("win_rate", 6).alias("win_rate"), "rank")


@query("mdaily mlarge prices", f""", {_SIGNALS}, hz as ({" union all ".join(f'select symbol, date, "close", lead(date) over w en, {h} horizon, lead("close", {h + 1}) over w xt from prices window w as (partition by symbol order by date)' for h in HORIZONS)}),
    dd as (select strategy, horizon, en, avg((xt / "close" - 1) * direction) r, count(*) c from si join hz using (symbol, date) where xt is not null and "close" > 0 group by all)
    select strategy, horizon, cast(sum(c) as bigint) trades, count(*) as days, round(avg(r), 8) mean, round(case when stddev_pop(r) > 0 then avg(r) / stddev_pop(r) * sqrt(252.0 / horizon) else 0 end, 5) sharpe_raw, round(case when stddev_pop(r) > 0 then (avg(r) - {_COST}) / stddev_pop(r) * sqrt(252.0 / horizon) else 0 end, 5) sharpe_net, round(avg(cast(r > 0 as int)), 6) win_rate from dd group by 1, 2""")
def m13_horizon_sharpe(t):
    x = bt.horizon_sharpe(signals(t), t.prices, HORIZONS)
    return x.select("strategy", "horizon", "trades", "days", rd("mean", 8).alias("mean"), rd("sharpe_raw", 5).alias("sharpe_raw"), rd("sharpe_net", 5).alias("sharpe_net"), rd("win_rate", 6).alias("win_rate"))


_LOG = """tr as (select b.date date, case when b.date < s.date then 'long' else 'short' end direction, abs(datediff('day', b.date, s.date)) dy, least(b.date, s.date) opened, (s.sell_amount / s.sell_shares) / (b.buy_amount / b.buy_shares) - 1 r
    from mcum b join mcum s on b.symbol = s.symbol and b.broker = s.broker and b.b - b.buy_shares < s.s and s.s - s.sell_shares < b.b where b.buy_shares > 0 and s.sell_shares > 0)"""


def trade_log(t):
    """Closed trades as a log: entry date, direction, seconds held, profit in basis points, and a name by how long they were held."""
    m = ff.matches(mdaily(t))
    held = F.abs(F.datediff("sell_date", "buy_date"))
    name = F.concat(F.lit("fifo_"), F.when(held <= 60, "60d").otherwise("dedup_long"))
    return m.select(F.least("buy_date", "sell_date").alias("date"), F.col("trade_type").alias("direction"), (held * 86_400 + 3_600).alias("hold_seconds"), ((F.col("sell_price") / F.col("buy_price") - 1) * 10_000).alias("net_bps"), name.alias("factor_name"), F.array(F.lit("run"), F.when(held > 5, "kept").otherwise("short")).alias("tags"))


@query("mcum prices", f""", {_LOG}, mk as (select date, "close" from prices where symbol = 'Brand#11'),
    ma as (select case when dy <= 60 then '60d' else 'long' end label, r * 10000 nb, case when direction = 'short' then -1 else 1 end * (y."close" / x."close" - 1) * 10000 mb from tr join mk x on x.date = opened join mk y on y.date = opened + cast(dy as int) where dy > 5)
    select label, count(*) n, round(regr_slope(nb, mb), 6) beta, round(regr_r2(nb, mb), 6) r2, round(avg(nb), 4) avg_return, round(avg(mb), 4) avg_market, round(avg(nb) / stddev_samp(nb) * sqrt(252), 5) sharpe, round((avg(nb) - regr_slope(nb, mb) * avg(mb)) / stddev_samp(nb - b0 * mb) * sqrt(252), 5) excess_sharpe
    from ma join (select label, regr_slope(nb, mb) b0 from ma group by 1) using (label) group by 1 having count(*) >= 2""")
def m14_m15_beta_report(t):
    """Brand#11 stands for the market."""
    x = bt.beta_report(trade_log(t), t.prices.where("symbol = 'Brand#11'"), "fifo", "kept").where("n >= 2")
    return x.select("label", "n", rd("beta", 6).alias("beta"), rd("r2", 6).alias("r2"), rd("avg_return").alias("avg_return"), rd("avg_market").alias("avg_market"), rd("sharpe", 5).alias("sharpe"), rd("excess_sharpe", 5).alias("excess_sharpe"))


# ---------------------------------------------------------------- scorecards


@query("marks mdaily prices", f""", {_FINAL}, ho as (select symbol, arg_max("close", date) / arg_min("close", date) - 1 hold from prices group by 1), am as (select symbol, broker, sum(buy_amount) b, sum(sell_amount) s from mdaily group by all)
    select am.symbol, am.broker, case when b >= s then 'long' else 'short' end as position, round(greatest(b, s), 2) capital, round(total_pnl / greatest(b, s), 6) made, round(case when b >= s then hold else -hold end, 6) expected, round(total_pnl / greatest(b, s) - case when b >= s then hold else -hold end, 6) alpha
    from am join fr on fr.symbol = am.symbol and fr.broker = am.broker join ho on ho.symbol = am.symbol where greatest(b, s) >= 1e4""")
def n2_alpha_against_holding(t):
    """Capital from 1e4 on, for the test tables' scale."""
    x = so.against_holding(mdaily(t), sm.final_ranking(marks(t)), t.prices, 1e4)
    return x.select("symbol", "broker", "position", rd("capital", 2).alias("capital"), rd("made", 6).alias("made"), rd("expected", 6).alias("expected"), rd("alpha", 6).alias("alpha"))


_GRID = """pg as (select symbol, date, coalesce(lead("close") over w / "close" - 1, 0) nx, lead(date) over w is null il from prices window w as (partition by symbol order by date)),
    gd as (select a.symbol, a.broker, p.date, nx, il, coalesce(buy_shares - sell_shares, 0) net, d.symbol is not null traded, coalesce(buy_shares + sell_shares, 0) vol from (select distinct symbol, broker from mdaily) a join pg p on p.symbol = a.symbol left join mdaily d on d.symbol = a.symbol and d.broker = a.broker and d.date = p.date)"""


@query("mdaily prices", f""", {_GRID}, mn as (select symbol, broker, avg(net) mean, count(*) n, count(*) filter (traded) dy, sum(vol) volume from gd group by all),
    rw as (select gd.symbol, gd.broker, any_value(n) n, any_value(dy) dy, any_value(volume) volume, sum(case when not il then (net - mean) * nx else 0 end) raw, sqrt(sum(case when not il then power(net - mean, 2) else 0 end) / (any_value(n) - 1)) sd from gd join mn on mn.symbol = gd.symbol and mn.broker = gd.broker group by all)
    select symbol, broker, dy as days, cast(volume as bigint) volume, round(raw, 6) raw, round(case when sd > 1e-9 then raw / (sd * n) else 0 end, 8) normalised from rw where dy >= 20 and volume >= 100""")
def k2_k3_n9_raw_timing(t):
    """Accounts with 20 trade days and 100 shares or more; the twin lays out every date."""
    x = so.raw_timing(mdaily(t), t.prices).where("days >= 20 and volume >= 100")
    return x.select("symbol", "broker", "days", "volume", rd("raw", 6).alias("raw"), rd("normalised", 8).alias("normalised"))


_LEAD = """li as (select symbol, date, lead("close") over w / "close" - 1 nx, row_number() over w - 1 i, count(*) over (partition by symbol) // 2 mid from prices window w as (partition by symbol order by date)),
    lx as (select d.symbol, d.broker, buy_shares - sell_shares net, nx, i, mid from mdaily d join li on li.symbol = d.symbol and li.date = d.date where nx is not null),
    lc as (select symbol, broker, corr(net, nx) c0, corr(net, nx) filter (i + 1 < mid) c1, corr(net, nx) filter (i >= mid) c2 from lx group by all),
    ls as (select symbol, broker, coalesce(case when not isnan(c0) then c0 end, 0) lead, coalesce(case when not isnan(c1) then c1 end, 0) lead_1, coalesce(case when not isnan(c2) then c2 end, 0) lead_2 from lc)"""


@query("mdaily prices", f", {_LEAD} select symbol, broker, round(lead, 6) as lead, round(lead_1, 6) lead_1, round(lead_2, 6) lead_2, lead_1 * lead_2 > 0 and abs(lead_1) > 0.05 and abs(lead_2) > 0.05 stable from ls")
def n6_lead_stability(t):
    x = so.lead_stability(mdaily(t), t.prices)
    return x.select("symbol", "broker", rd("lead", 6).alias("lead"), rd("lead_1", 6).alias("lead_1"), rd("lead_2", 6).alias("lead_2"), "stable")


@query("marks mdaily prices", f""", {_LEAD}, {_FINAL}, mo as (select symbol, broker, date_trunc('month', date) mo, sum(realized_pnl) made from marks group by all having abs(sum(realized_pnl)) > 1e-6), wr as (select symbol, broker, avg(cast(made > 0 as int)) wr, count(*) as months from mo group by all),
    vo as (select symbol, broker, sum(buy_shares + sell_shares) vol from mdaily group by all),
    al as (select ls.*, coalesce(wr, 0) wr, coalesce(wr.months, 0) as months, total_pnl, total_pnl / vol ps from ls join vo using (symbol, broker) join fr using (symbol, broker) left join wr using (symbol, broker))
    select symbol, broker, round(wr, 6) win_rate, months, round(ps, 6) per_share, round(case when lead_1 * lead_2 > 0 and abs(lead_1) > 0.05 and abs(lead_2) > 0.05 and lead > 0 then 0.3 else 0 end + 0.4 * wr + 0.3 * (ps - min(ps) over w) / case when max(ps) over w > min(ps) over w then max(ps) over w - min(ps) over w else 1 end, 6) score from al window w as (partition by symbol)""")
def n7_composite_score(t):
    folder = tb.workspace(t.spark, "composite")
    m, d = tb.stored(marks(t), folder, "marks"), tb.stored(mdaily(t), folder, "daily")
    x = so.composite(so.lead_stability(d, t.prices), m, sm.final_ranking(m), d)
    return x.select("symbol", "broker", rd("win_rate", 6).alias("win_rate"), "months", rd("per_share", 6).alias("per_share"), rd("score", 6).alias("score"))


_CARD = _K4.rsplit("select symbol, broker, round(any_value(seen)", 1)[0].replace("having count(*) >= 20", "having count(*) >= 1")
_EXEC = """ot as (select b.symbol, b.broker, least(b.b, s.s) - greatest(b.b - b.buy_shares, s.s - s.sell_shares) shares, least(b.date, s.date) opened, greatest(b.date, s.date) closed, b.date < s.date il, b.buy_amount / b.buy_shares bp, s.sell_amount / s.sell_shares sp
    from mcum b join mcum s on b.symbol = s.symbol and b.broker = s.broker and b.b - b.buy_shares < s.s and s.s - s.sell_shares < b.b where b.buy_shares > 0 and s.sell_shares > 0),
    xe as (select ot.symbol, ot.broker, count(*) trades, sum((case when il then sp / bp - 1 else 1 - bp / sp end - case when il then 1 else -1 end * (q."close" / r."close" - 1)) * shares * case when il then bp else sp end) / sum(shares * case when il then bp else sp end) xa
        from ot join prices r on r.symbol = ot.symbol and r.date = opened join prices q on q.symbol = ot.symbol and q.date = closed group by all)"""


@query("marks mdaily mcum prices", f"""{_CARD}, pv as (select symbol, broker, count(*) filter (floor(abs(sim) * 1e6 + 0.5) >= floor(abs(seen) * 1e6 + 0.5)) / {DRAWS} p from a group by all), {_EXEC}, {_FINAL}, {_GRID},
    rt as (select symbol, broker, count(*) filter (traded) dy, sum(vol) volume, sum(net) held, sum(case when not il then net * nx else 0 end) - avg(net) * sum(case when not il then nx else 0 end) raw from gd group by all),
    cd as (select rt.symbol, rt.broker, dy, volume, held, coalesce(total_pnl, 0) pnl, coalesce(xa, 0) xa, coalesce(trades, 0) trades, raw, p from rt join pv using (symbol, broker) left join fr using (symbol, broker) left join xe using (symbol, broker) where dy >= 20 and volume >= 1000)
    select symbol, broker, dy as days, cast(volume as bigint) volume, case when held > 0 then 'long' when held < 0 then 'short' else 'neutral' end direction, round(pnl, 2) total_pnl, round(xa, 6) execution_alpha, trades, round(raw, 6) timing_alpha, round(p, 6) p,
        case when p < 0.05 and raw > 0 then 'leads' when p < 0.05 and raw < 0 then 'misleads' else 'not significant' end timing, case when pnl > 0 and p < 0.05 and raw > 0 and xa > 0 then 'best' when p < 0.05 and raw < 0 then 'contrarian' else 'none' end listed from cd""")
def n4_scorecard(t):
    folder = tb.workspace(t.spark, "scorecard")
    d, prices = tb.stored(mdaily(t), folder, "daily"), tb.stored(t.prices, folder, "prices")
    x = so.scorecard(d, sm.final_ranking(marks(t)), so.execution_alpha(ff.matches(d), prices), so.raw_timing(d, prices), pm.timing_permutation(d, prices, DRAWS))
    return x.select("symbol", "broker", "days", "volume", "direction", rd("total_pnl", 2).alias("total_pnl"), rd("execution_alpha", 6).alias("execution_alpha"), "trades", rd("timing_alpha", 6).alias("timing_alpha"), rd("p", 6).alias("p"), "timing", "listed")


_LATE = lambda sql: sql.replace("from prices window", "from later window")


@query("marks mdaily mcum prices rets", f""", later as (select * from prices semi join rets using (symbol, date)){_LATE(_CARD)}, pv as (select symbol, broker, count(*) filter (floor(abs(sim) * 1e6 + 0.5) >= floor(abs(seen) * 1e6 + 0.5)) / {DRAWS} p from a group by all), {_EXEC}, {_FINAL}, {_LATE(_GRID)},
    rt as (select symbol, broker, sum(case when not il then net * nx else 0 end) - avg(net) * sum(case when not il then nx else 0 end) raw from gd group by all),
    lg as (select symbol, date, ret, lag(date) over w pd, lag(ret) over w pr from rets window w as (partition by symbol order by date)),
    lx as (select k.symbol, k.broker, ret, pr, coalesce(y.buy_shares - y.sell_shares, 0) before, coalesce(z.buy_shares - z.sell_shares, 0) now from (select distinct symbol, broker from mdaily) k join lg on lg.symbol = k.symbol left join mdaily y on y.symbol = k.symbol and y.broker = k.broker and y.date = pd left join mdaily z on z.symbol = k.symbol and z.broker = k.broker and z.date = lg.date where pd is not null),
    lc as (select symbol, broker, case when stddev_pop(before) > 0 then corr(before, ret) end led, case when stddev_pop(now) > 0 then corr(now, pr) end lagged from lx group by all),
    tv as (select symbol, broker, count(*) dy, sum(buy_shares + sell_shares) vol, sum(buy_amount + sell_amount) amount, sum(buy_shares - sell_shares) held from mdaily group by all),
    rr as (select tv.*, pos, realized_pnl, unrealized_pnl, total_pnl, xa, coalesce(trades, 0) trades, case when dy >= 20 then raw end raw, case when dy >= 20 then p end p, case when dy >= 20 then led end led, case when dy >= 20 then lagged end lagged
        from tv left join fr using (symbol, broker) left join xe using (symbol, broker) left join rt using (symbol, broker) left join pv using (symbol, broker) left join lc using (symbol, broker))
    select symbol, pos as rank, rr.broker, coalesce(n_name, '') "name", case when held > 0 then 'long' when held < 0 then 'short' else 'neutral' end direction, round(total_pnl, 2) total_pnl, round(realized_pnl, 2) realized_pnl, round(unrealized_pnl, 2) unrealized_pnl, round(xa, 6) execution_alpha,
        round(raw, 5) timing_alpha, round(p, 6) p, case when p < 0.05 and raw > 0 then 'leads' when p < 0.05 and raw < 0 then 'misleads' when p is not null then 'not significant' end timing, round(led, 5) lead_corr, round(lagged, 5) lag_corr,
        case when lagged > 0.05 then 'with the trend' when lagged < -0.05 then 'against it' when lagged is not null then 'neutral' end style, dy trading_days, cast(vol as bigint) total_volume, round(amount, 2) total_amount, cast(held as bigint) cumulative_net, trades trade_count
    from rr left join nation on rr.broker = concat('F', n_nationkey)""")
def n5_ranking_report(t):
    """The whole report of every account, with names."""
    folder = tb.workspace(t.spark, "report")
    d, prices = tb.stored(mdaily(t), folder, "daily"), tb.stored(t.prices, folder, "prices")
    x = so.ranking_report(d, sm.final_ranking(marks(t)), so.execution_alpha(ff.matches(d), prices), se.returns(prices), prices, DRAWS).join(names(t), "broker", "left")
    money = [rd(c, 2).alias(c) for c in ("total_pnl", "realized_pnl", "unrealized_pnl", "total_amount")]
    fine = [rd(c, n).alias(c) for c, n in (("execution_alpha", 6), ("timing_alpha", 5), ("p", 6), ("lead_corr", 5), ("lag_corr", 5))]
    return x.select("symbol", "rank", "broker", F.coalesce("broker_name", F.lit("")).alias("name"), "direction", *money, *fine, "timing", "style", "trading_days", "total_volume", "cumulative_net", F.col("trades").alias("trade_count"))


#: The window that is followed, and the days after it (fixed values).
_FROM, _TO, _UNTIL = "1998-01-01", "1998-03-31", "1998-04-30"
_ACC = f"""ga as (select *, row_number() over (partition by symbol order by net desc, broker) pos from (select symbol, broker, sum(buy_shares - sell_shares) net, sum(buy_amount) / nullif(sum(buy_shares), 0) buy_vwap from mdaily where date between date '{_FROM}' and date '{_TO}' group by all) where net > 0 qualify pos <= 20)"""


@query("mdaily", f""", {_ACC} select ga.symbol, ga.broker, cast(ga.net as bigint) net, d.date, cast(buy_shares - sell_shares as bigint) traded, case when d.date is null then 'none' when buy_shares > sell_shares then 'buy' when buy_shares < sell_shares then 'sell' else 'even' end action
    from ga left join (select * from mdaily where date > date '{_TO}' and date <= date '{_UNTIL}') d on d.symbol = ga.symbol and d.broker = ga.broker""")
def o10_follow_up(t):
    d = mdaily(t)
    return so.follow_up(d, so.accumulators(d, day(_FROM), day(_TO)), day(_TO), day(_UNTIL)).select("symbol", "broker", "net", "date", "traded", "action")


@query("mdaily", f"""select symbol, date, broker, cast(net as bigint) net, round(amount, 2) net_amount, case when top <= 10 then 'buyers' else 'sellers' end side from (select symbol, date, broker, buy_shares - sell_shares net, buy_amount - sell_amount amount, row_number() over (partition by symbol, date order by buy_shares - sell_shares desc, broker) top, row_number() over (partition by symbol, date order by buy_shares - sell_shares, broker) bottom
    from mdaily where date > date '{_TO}' and date <= date '{_UNTIL}') where top <= 10 or bottom <= 10""")
def o10_daily_movers(t):
    return so.movers(mdaily(t), day(_TO), day(_UNTIL)).select("symbol", "date", "broker", "net", rd("net_amount", 2).alias("net_amount"), "side")


@query("mdaily prices", f""", {_ACC} select ga.symbol, ga.broker, cast(net as bigint) net, round(buy_vwap, 6) buy_vwap, round(("close" - buy_vwap) * net, 2) open_pnl, round("close" / buy_vwap - 1, 6) open_return from ga join (select symbol, arg_max("close", date) "close" from prices where date <= date '{_UNTIL}' group by 1) c on c.symbol = ga.symbol where buy_vwap > 0""")
def o11_marked_accumulators(t):
    closes = t.prices.where(F.col("date") <= day(_UNTIL)).groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    x = so.marked(so.accumulators(mdaily(t), day(_FROM), day(_TO)), closes)
    return x.select("symbol", "broker", "net", rd("buy_vwap", 6).alias("buy_vwap"), rd("open_pnl", 2).alias("open_pnl"), rd("open_return", 6).alias("open_return"))


@query("mdaily prices", f""", {_DENSE}, sb as (select *, lag(signal) over (partition by symbol order by date) before from sg qualify lag(signal) over (partition by symbol order by date) is not null),
    co as (select symbol, {", ".join(f"case when count(*) filter ({c}) >= 10 and abs(corr(before, ret) filter ({c})) < 1 then corr(before, ret) filter ({c}) else 0 end r{i}, count(*) filter ({c}) n{i}" for i, c in enumerate((f"date <= date '{_W[1]}'", f"date >= date '{_W[2]}'")))} from sb group by 1)
    select symbol, round(r0, 6) train_corr, round(r0 * sqrt(n0 - 2) / sqrt(1 - r0 * r0), 5) train_t, round(r1, 6) test_corr, round(r1 * sqrt(n1 - 2) / sqrt(1 - r1 * r1), 5) test_t from co""")
def k15_signal_correlation(t):
    d, b = mdaily(t), sc.bars(t.prices, WINDOWS)
    x = sc.signal_correlation(sc.weighted_signal(d, t.prices, b, sc.accounts(d, b), WINDOWS), b, WINDOWS)
    return x.select("symbol", rd("train_corr", 6).alias("train_corr"), rd("train_t", 5).alias("train_t"), rd("test_corr", 6).alias("test_corr"), rd("test_t", 5).alias("test_t"))


_LATER = {"early": ("1999-07-01", "2000-03-31"), "late": ("2000-04-01", "2000-12-31")}


def _later_sql(start: str, end: str) -> str:
    """Sessions of one test window, as a sub-query."""
    return "(with " + _SESSIONS.replace(_W[2], start).replace(_W[3], end) + " select * from se)"


@query("mdaily prices", f""", x as ({" union all ".join(f"select '{n}' as wn, symbol, date, ret from {_later_sql(a, b)}" for n, (a, b) in _LATER.items())}),
    y as (select wn, symbol, wn || symbol k, date, ret from x), pf as {_performance_sql("y", "k")}
    select wn as "window", symbol, days, round(sign(total_return) * ln(1 + abs(total_return)), 6) growth, round(sharpe, 5) sharpe from pf join (select distinct wn, symbol, k from y) using (k)""")
def m16_later_windows(t):
    folder = tb.workspace(t.spark, "later")
    x = bt.reevaluated(tb.stored(mdaily(t), folder, "daily"), tb.stored(t.prices, folder, "prices"), (_W[0], _W[1]), _LATER)
    return x.select("window", "symbol", "days", rd(F.signum("total_return") * F.log1p(F.abs("total_return")), 6).alias("growth"), rd("sharpe", 5).alias("sharpe"))


@query("mdaily prices", f"""{_CARD}, pv as (select symbol, broker, count(*) filter (floor(abs(sim) * 1e6 + 0.5) >= floor(abs(seen) * 1e6 + 0.5)) / {DRAWS} p from a group by all)
    select case when p < 0.01 then 'highly significant' when p < 0.05 then 'significant' when p < 0.10 then 'marginal' else 'not significant' end verdict, count(*) n, round(any_value(al) * 0.05, 6) expected_false from pv cross join (select count(*) al from pv) group by 1""")
def k13_verdicts(t):
    """Timing p in words, with the number that would be significant by chance."""
    p = pm.timing_permutation(mdaily(t), t.prices, DRAWS).select(stats.verdict(F.col("p")).alias("verdict"))
    g = p.groupBy("verdict").agg(F.count("*").alias("n"))
    return g.select("verdict", "n", rd(stats.expected_false(F.sum("n").over(W.partitionBy())), 6).alias("expected_false"))

"""Queries on permutation tests, timing regimes, standardised returns and strategy scans, each with its SQL twin.

Twins repeat the draws of `permutation.hashes` in SQL; so that they can, these queries make few draws.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import stats
from flowlens.operators import events as ev
from flowlens.operators import holdings as ho
from flowlens.operators import hypothesis as hy
from flowlens.operators import permutation as pm
from flowlens.plans.catalog import HORIZONS, TRAIN_END, query, rd
from flowlens.plans.rankings import _pos, day, marks, mdaily
from flowlens.sources import tables as tb

#: Draws of the queries with twins, where they may stop, and the least number before few hits may stop them (fixed values).
DRAWS, CHECK, LEAST = 60, 20, 40
FOLDS = [hy.Fold(f"{y}", f"{y - 1}-12-31", f"{y}-01-01", f"{y}-12-31") for y in range(1997, 2002)]

_FAR = "floor(abs({}) * 1e6 + 0.5) >= floor(abs({}) * 1e6 + 0.5)"


def market(t, keep: bool = True) -> hy.Market:
    """Marks, days and prices; written once, since every part of a scan reads them."""
    folder = tb.workspace(t.spark, "market")
    return hy.Market(*(tb.stored(df, folder, name) for name, df in (("marks", marks(t)), ("daily", mdaily(t)), ("prices", t.prices))))


# ---------------------------------------------------------------- permutation tests

_K4 = f""", p as (select symbol, date, row_number() over w i, coalesce(lead("close") over w / "close" - 1, 0) nxt from prices window w as (partition by symbol order by date)),
    tot as (select symbol, count(*) n, sum(nxt) ar from p group by 1),
    x as (select d.symbol, d.broker, buy_shares - sell_shares net, nxt, row_number() over (partition by d.symbol, d.broker order by d.date) k from mdaily d join p on p.symbol = d.symbol and p.date = d.date),
    m as (select x.symbol, broker, any_value(n) n, any_value(ar) ar, sum(net) / any_value(n) mean, sqrt(greatest(sum(net * net) / any_value(n) - power(sum(net) / any_value(n), 2), 0)) std, sum(net * nxt) cr from x join tot on tot.symbol = x.symbol group by all having count(*) >= 20),
    o as (select symbol, dr, nxt, row_number() over (partition by symbol, dr order by {pm.hash_sql("i", "dr")}, i) k from p cross join (select unnest(range({DRAWS})) dr)),
    s as (select x.symbol, x.broker, dr, sum(net * o.nxt) cr from x join o on o.symbol = x.symbol and o.k = x.k group by all),
    a as (select m.symbol, m.broker, case when std > 1e-9 then (m.cr - mean * ar) / std else 0 end seen, case when std > 1e-9 then (s.cr - mean * ar) / std else 0 end sim from m join s on s.symbol = m.symbol and s.broker = m.broker)
    select symbol, broker, round(any_value(seen), 6) observed, count(*) filter ({_FAR.format("sim", "seen")}) n_extreme, round(avg(sim), 6) sim_mean, round(stddev_pop(sim), 6) sim_std,
        round(count(*) filter ({_FAR.format("sim", "seen")}) / {DRAWS}, 6) p from a group by all"""


@query("mdaily prices", _K4)
def k4_timing_permutation(t):
    """Accounts with 20 trade days or more."""
    x = pm.timing_permutation(mdaily(t), t.prices, DRAWS, 20)
    return x.select("symbol", "broker", rd("observed", 6).alias("observed"), "n_extreme", rd("sim_mean", 6).alias("sim_mean"), rd("sim_std", 6).alias("sim_std"), rd("p", 6).alias("p"))


@query("rets", f""", v as (select symbol, ret * 1e4 y, row_number() over (partition by symbol order by date) i, count(*) over (partition by symbol) n from rets),
    o as (select symbol, n, y, -1 dr, i k from v union all select symbol, n, y, dr, row_number() over (partition by symbol, dr order by {pm.hash_sql("i", "dr")}, i) from v cross join (select unnest(range({DRAWS})) dr)),
    s as (select symbol, dr, avg(y) filter (k <= n // 2) - avg(y) filter (k > n // 2) st from o group by all)
    select a.symbol, round(any_value(b.st), 4) observed, count(*) filter ({_FAR.format("a.st", "b.st")}) n_extreme from s a join s b on a.symbol = b.symbol and b.dr = -1 where a.dr >= 0 group by 1""")
def k12_user_statistic(t):
    """Mean return of the first half of a symbol's days less that of the second, as a function handed in."""
    halves = lambda x: x[:, : x.shape[1] // 2].mean(axis=1) - x[:, x.shape[1] // 2 :].mean(axis=1)
    found = pm.user_statistic(t.rets.withColumn("bps", F.col("ret") * 1e4), ("symbol",), "date", "bps", halves, DRAWS)
    return found.select("symbol", rd("observed").alias("observed"), "n_extreme")


# ---------------------------------------------------------------- selectors

_WINDOW, _STEP = 40, 20
_BARS = 'i as (select symbol, date, row_number() over w - 1 i, count(*) over (partition by symbol) n, coalesce(lead("close") over w / "close" - 1, 0) nr from prices window w as (partition by symbol order by date))'


@query("mdaily prices", f""", {_BARS}, win as (select symbol, unnest(range((max(n) - {_WINDOW}) // {_STEP} + 1)) w, (max(n) - {_WINDOW}) // {_STEP} + 1 wn from i group by 1 having (max(n) - {_WINDOW}) // {_STEP} + 1 >= 5),
    ar as (select win.symbol, w, sum(nr) ar from win join i on i.symbol = win.symbol and i.i >= w * {_STEP} and i.i < w * {_STEP} + {_WINDOW - 1} group by all),
    m as (select d.symbol, broker, w, sum(buy_shares - sell_shares) / {_WINDOW} mean, sum(power(buy_shares - sell_shares, 2)) / {_WINDOW} sq, sum(case when i.i < w * {_STEP} + {_WINDOW - 1} then (buy_shares - sell_shares) * nr else 0 end) cr
        from mdaily d join i on i.symbol = d.symbol and i.date = d.date join win on win.symbol = d.symbol and i.i >= w * {_STEP} and i.i < w * {_STEP} + {_WINDOW} group by all),
    every as (select distinct win.symbol, broker, w, wn from win join (select distinct symbol, broker from mdaily) a on a.symbol = win.symbol),
    ta as (select e.symbol, e.broker, e.w, wn, coalesce(case when sqrt(greatest(sq - mean * mean, 0)) > 1e-9 then (cr - mean * ar) / sqrt(greatest(sq - mean * mean, 0)) end, 0) ta from every e left join m on m.symbol = e.symbol and m.broker = e.broker and m.w = e.w join ar on ar.symbol = e.symbol and ar.w = e.w),
    g as (select symbol, broker, sum(ta) filter (w = wn - 1) latest, avg(ta) filter (w < wn - 1) mean, stddev_pop(ta) filter (w < wn - 1) std from ta group by all)
    select symbol, broker, round((latest - mean) / std, 5) z from g where std > 1e-9 and abs((latest - mean) / std) > 1.0""")
def h6_timing_regimes(t):
    """Windows of 40 bars, since symbols have few; the twin lays out every account and window."""
    return ho.timing_regimes(mdaily(t), t.prices, window=_WINDOW, threshold=1.0).withColumn("z", rd("z", 5))


_SCAR_H = (5, 10, 20, 60)
_SCARS = f"""l as (select *, cast(sign(z) as int) direction from (select *, (net - mean) / std z from (select *, avg(net) over w mean, stddev_samp(net) over w std from (select *, buy_shares - sell_shares net from mdaily where date <= date '{TRAIN_END}') window w as (partition by symbol, broker)) where std > 0) where abs(z) > 2),
    big as (select * from l where case when direction > 0 then buy_amount else sell_amount end >= 1e4),
    fit as (select symbol, avg(r) drift, stddev_samp(r) vol from (select symbol, date, "close" / lag("close") over (partition by symbol order by date) - 1 r from prices) where date <= date '{TRAIN_END}' and r is not null group by 1 having count(*) >= 30 and stddev_samp(r) > 0),
    fw as ({" union all ".join(f'select symbol, date, {h} horizon, lead("close", {h}) over (partition by symbol order by date) / "close" - 1 raw from prices' for h in _SCAR_H)}),
    sc as (select b.symbol, b.broker, b.date, horizon, (raw - drift * horizon) / (vol * sqrt(horizon)) * direction scar from big b join fw on fw.symbol = b.symbol and fw.date = b.date join fit on fit.symbol = b.symbol where raw is not null)"""


def scars(t):
    large = hy._large_enough(ev.large_trades(mdaily(t).where(F.col("date") <= day(TRAIN_END))), 1e4)
    return ho.scar(large, t.prices, day(TRAIN_END), _SCAR_H)


@query("mdaily prices", f""", {_SCARS} select symbol, broker, round(mean_scar, 6) mean_scar, n, pos from (select *, row_number() over (partition by symbol order by floor(mean_scar * 1e9 + 0.5) desc, broker) pos from (select symbol, broker, avg(scar) mean_scar, count(*) n from sc group by all having count(*) >= 5)) where pos <= 20""")
def h9_scar_selector(t):
    """Amounts from 1e4 on, for the test tables' scale."""
    return ho.scar_top(scars(t)).select("symbol", "broker", rd("mean_scar", 6).alias("mean_scar"), "n", "pos")


@query("mdaily prices", f""", {_SCARS} select horizon, n, round(mean, 6) mean_scar, round(t, 4) t, round({stats.erfc_sql('(abs(t)/sqrt(2.0))')}, 5) p from (select *, mean / (std / sqrt(n)) t from (select horizon, count(*) n, avg(scar) mean, stddev_samp(scar) std from sc group by 1))""")
def k19_scar_pooling(t):
    """Standardised returns of all symbols in one pool a horizon: mean, t against 0 and its p."""
    return ho.pooled(scars(t)).select("horizon", "n", rd("mean_scar", 6).alias("mean_scar"), rd("t").alias("t"), rd("p", 5).alias("p"))


# ---------------------------------------------------------------- strategy scans

_FWD = " union all ".join(f'select symbol, date, {h} horizon, (lead("close", {h}) over (partition by symbol order by date) / "close" - 1) * 10000 ret from prices' for h in HORIZONS)


def _events_sql(f: hy.Fold) -> str:
    """Events of contrarian_smart in one fold."""
    sel = f"(select symbol, broker from {_pos(f"(date '{f.train_end}' - interval 36 month)", f"date '{f.train_end}'")} where pos <= 20)"
    falls = """(select symbol, date, "close" / lag("close") over w - 1 r1, "close" / lag("close", 3) over w - 1 r3 from prices window w as (partition by symbol order by date))"""
    return f"""select '{f.label}' run, f.symbol, f.date, 1 direction from {falls} f join (select symbol, date from mdaily semi join {sel} using (symbol, broker) where buy_shares > sell_shares group by all having count(*) >= 3) b on b.symbol = f.symbol and b.date = f.date
        where r3 is not null and (r1 < -0.02 or r3 < -0.05) and f.date between date '{f.test_start}' and date '{f.test_end}'"""


def compared_sql(events: str, keys: str = "run", n_h: int = len(HORIZONS), settle: bool = True) -> str:
    """Common table expressions down to `tests`, as `hypothesis.concluded` gives them, of events (keys, symbol, date, direction)."""
    k, on = f"{keys}, symbol, horizon", f"({keys}, symbol, horizon)"
    alpha = 0.05 / n_h
    return f"""e as ({events}), fwd as (select * from ({_FWD}) where ret is not null),
    pop as (select symbol, horizon, i, ret from fwd join (select symbol, date, row_number() over (partition by symbol order by date) i, count(*) over (partition by symbol) n from prices) d using (symbol, date) where i <= n - {max(HORIZONS)}),
    a as (select {keys}, symbol, horizon, avg(ret * direction) m, var_samp(ret * direction) v, count(*) n from fwd join e using (symbol, date) group by all),
    b as (select symbol, horizon, avg(ret) bm, var_samp(ret) bv, count(*) bn from pop group by all),
    c as (select {k}, coalesce(n, 0) n, coalesce(bn, 0) bn, m, bm, case when coalesce(n, 0) >= 3 and coalesce(bn, 0) >= 3 then coalesce((m - bm) / nullif(sqrt(v / n + bv / bn), 0), 0) else 0 end t,
        case when coalesce(n, 0) >= 3 and coalesce(bn, 0) >= 3 then coalesce((m - bm) / nullif(sqrt(((n - 1) * v + (bn - 1) * bv) / (n + bn - 2)), 0), 0) else 0 end d
        from (select distinct {keys}, symbol from e) cross join (select unnest([{", ".join(map(str, HORIZONS))}]) horizon) left join a using {on} left join b using (symbol, horizon)),
    w as (select *, case when t = 0 then 1 else {stats.erfc_sql('(abs(t)/sqrt(2.0))')} end wp from c),
    st as (select *, case when n < 3 or bn < 3 {"or abs(d) < 0.2 " if settle else ""}then 1.0 {"when wp > 0.2 then wp " if settle else ""}end settled from w),
    dr as (select {k}, n, m, q, ret, row_number() over (partition by {k}, q order by {pm.hash_sql("i", "q")}, i) kk from st join pop using (symbol, horizon) cross join (select unnest(range({DRAWS})) q) where settled is null),
    sm as (select {k}, q, {_FAR.format("avg(ret)", "any_value(m)")} far from dr where kk <= n group by all),
    cu as (select *, sum(cast(far as int)) over (partition by {k} order by q) hits from sm),
    stop as (select {k}, min(q + 1) filter ({str(settle).lower()} and (q + 1) % {CHECK} = 0 and (hits > (q + 1) * {4 * alpha!r} or (q + 1 >= {LEAST} and hits <= 1))) stop_at from cu group by all),
    pr as (select {k}, hits / (q + 1) p, q + 1 draws from cu join stop using {on} where q + 1 = coalesce(stop_at, {DRAWS})),
    te as (select {k}, n, m, d, t, coalesce(settled, p) p, coalesce(draws, 0) draws, settled is null and p < {alpha!r} and abs(d) >= 0.2 significant, round(coalesce(settled, p), 9) p9 from st left join pr using {on}),
    rk as (select *, count(*) filter (significant) over (partition by {keys}, symbol) hits, row_number() over (partition by {keys} order by p9, symbol, horizon) kk, count(*) over (partition by {keys}) nt from te),
    tests as (select *, case when hits >= 2 then 'significant' when hits = 1 then 'marginal' else 'no_effect' end conclusion, kk <= coalesce(max(kk) filter (p9 <= 0.05 * kk / nt) over (partition by {keys}), 0) rejected from rk)"""


_OPTIONS = {"draws": DRAWS, "check": CHECK, "least": LEAST}


@query("marks mdaily prices", f", {compared_sql(_events_sql(FOLDS[3]))} select symbol, horizon, n, round(m, 3) mean_bps, round(p, 5) p, cast(draws as bigint) draws, significant, conclusion, rejected from tests")
def l1_l2_l4_k10_scan(t):
    """Selector, filter, outcome, baseline and accelerated test of one strategy over one fold, with the false-discovery rate over all symbols and horizons."""
    s = hy.scan(market(t), "contrarian_smart", [FOLDS[3]], **_OPTIONS)
    return s.select("symbol", "horizon", "n", rd("mean_bps", 3).alias("mean_bps"), rd("p", 5).alias("p"), "draws", "significant", "conclusion", "rejected")


@query("marks mdaily prices", f""", {compared_sql(" union all ".join(_events_sql(f) for f in FOLDS))}, s as (select run, symbol, max(conclusion = 'significant') hit, count(*) tests, count(*) filter (rejected) passing, count(*) filter (rejected and d > 0) up, count(*) filter (rejected and d < 0) down from tests group by all),
    g as (select run, count(*) n_symbols, cast(sum(tests) as bigint) n_tests, 100 * avg(cast(hit as int)) sig_rate, count(*) filter (passing > 0) fdr_stocks, cast(sum(passing) as bigint) fdr_rejected, coalesce(100 * greatest(sum(up), sum(down)) / nullif(sum(passing), 0), 0) consistency, case when sum(up) >= sum(down) then 'positive' else 'negative' end dominant from s group by 1)
    select run, n_symbols, n_tests, round(sig_rate, 5) sig_rate, fdr_stocks, fdr_rejected, round(consistency, 5) consistency, dominant, sig_rate > 5 and fdr_stocks >= 10 and consistency > 60 passed from g""")
def l5_cross_validation(t):
    """Five folds in one plan; a fold is a key of every group and window."""
    g = hy.cross_validated(market(t), "contrarian_smart", FOLDS, **_OPTIONS)
    return g.select("run", "n_symbols", "n_tests", rd("sig_rate", 5).alias("sig_rate"), "fdr_stocks", "fdr_rejected", rd("consistency", 5).alias("consistency"), "dominant", "passed")


@query()
def l3_strategy_batch(t):
    """All strategies over one fold with 10,000 draws at most. No twin: the draws are too many for it. Limits on amounts and windows are scaled to the tables."""
    options = {"large_trade_scar": {"amount": 1e4}, "contrarian_broker": {"least_amount": 1e6}, "ta_regime": {"window": 40}, "herding": {"crowd": 2}, "cross_stock": {"cluster": ("Brand#11", "Brand#12", "Brand#13", "Brand#14", "Brand#15")}}
    return hy.batch(market(t), list(hy.STRATEGIES), [FOLDS[3]], options).select("strategy", "symbol", "horizon", "n", "mean_bps", "t", "d", "p", "draws", "significant", "conclusion", "rejected")

"""Queries on merged firms: marks of holders, rankings, look-ups, selectors and event filters, each with its SQL twin.

Firms are brokers merged by nation, which gives accounts long enough for the default limits of the rules.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators import events as ev
from flowlens.operators import holdings as ho
from flowlens.plans.catalog import _CTE, _NEEDS, START, TEST_START, TRAIN_END, query, rd

END = "2000-11-04"

_CTE["mdaily"] = """mdaily as (select symbol, concat('F', s_nationkey) broker, date, cast(sum(buy) as bigint) buy_shares, cast(sum(sell) as bigint) sell_shares,
    sum(buy * price) buy_amount, sum(sell * price) sell_amount from prints join supplier on broker = concat('S', s_suppkey) group by all)"""
_CTE["mcum"] = _CTE["cum"].replace("cum as", "mcum as").replace("from daily", "from mdaily")
_CTE["mpos"] = _CTE["pos"].replace("pos as", "mpos as").replace("from cum", "from mcum").replace("join cum", "join mcum")
_CTE["marks"] = """marks as (select * from (select p.symbol, p.broker, q.date, case when q.date = p.date then rt - coalesce(before, 0) else 0.0 end realized_pnl,
    (b - s) * "close" - (bc - cost_b) + (sc - cost_s) unrealized_pnl, cast(b - s as bigint) net, "close", case when q.date = p.date then buy_shares else 0 end buy_shares,
    case when q.date = p.date then sell_shares else 0 end sell_shares, case when q.date = p.date then buy_amount else 0 end buy_amount, case when q.date = p.date then sell_amount else 0 end sell_amount
    from (select *, cost_s - cost_b rt, lag(cost_s - cost_b) over w before, lead(date) over w nxt from mpos window w as (partition by symbol, broker order by date)) p
    join prices q on p.symbol = q.symbol and q.date >= p.date and (nxt is null or q.date < nxt)) where abs(realized_pnl) > 1e-6 or abs(unrealized_pnl) > 1e-6)"""
_CTE["mlarge"] = _CTE["large"].replace("large as", "mlarge as").replace("from daily", "from mdaily")
_CTE["exact_mlarge"] = _CTE["exact_large"].replace("large as", "mlarge as", 1).replace("from daily", "from mdaily")
_NEEDS.update({"mdaily": ["prints"], "mcum": ["mdaily"], "mpos": ["mcum"], "marks": ["mpos", "prices"], "mlarge": ["mdaily"], "exact_mlarge": ["mdaily"]})


def _mapping(t):
    s = t.raw("supplier")
    return s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("broker"), F.concat(F.lit("F"), F.col("s_nationkey").cast("string")).alias("merged"))


def mdaily(t):
    from flowlens.sources import tables as tb

    return tb.daily_summary(ho.remapped(t.prints, _mapping(t)))


def marks(t):
    return ho.daily_marks(mdaily(t), t.prices)


def names(t):
    return t.raw("nation").select(F.concat(F.lit("F"), F.col("n_nationkey").cast("string")).alias("broker"), F.col("n_name").alias("broker_name"))


def day(s: str):
    return F.lit(s).cast("date")


def _period(a: str, b: str, baseline: bool = True) -> str:
    base = f"coalesce(arg_max(unrealized_pnl, date) filter (date < {a}), 0)" if baseline else "0"
    last = f"coalesce(arg_max(unrealized_pnl, date) filter (date between {a} and {b}), 0)"
    real = f"sum(realized_pnl) filter (date between {a} and {b})"
    return f"(select symbol, broker, {real} realized_pnl, {last} - {base} unrealized_pnl, {real} + {last} - {base} total_pnl from marks where date <= {b} group by all having count(*) filter (date between {a} and {b}) > 0)"


_CENTS = "floor(total_pnl * 100 + 0.500001) desc, broker"


def _pos(a: str, b: str) -> str:
    return f"(select *, row_number() over (partition by symbol order by {_CENTS}) pos from {_period(a, b)})"


TOP = f"top as (select symbol, broker from {_pos(f"(date '{TRAIN_END}' - interval 36 month)", f"date '{TRAIN_END}'")} where pos <= 20)"


def top(t, m=None):
    end = day(TRAIN_END)
    return ho.ranked(ho.period(marks(t) if m is None else m, F.add_months(end, -36), end)).where("pos <= 20")


# ---------------------------------------------------------------- marks and rankings


@query("marks", "select symbol, broker, date, round(realized_pnl, 2) realized_pnl, round(unrealized_pnl, 2) unrealized_pnl from marks")
def d5_holder_days(t):
    return marks(t).select("symbol", "broker", "date", rd("realized_pnl", 2).alias("realized_pnl"), rd("unrealized_pnl", 2).alias("unrealized_pnl"))


_ALL = "(select broker, sum(realized_pnl) realized_pnl, sum(unrealized_pnl) unrealized_pnl, sum(total_pnl) total_pnl from {} group by 1)"
_MARKET = f"(select *, row_number() over (order by {_CENTS}) as rank from {{}})"


def _money(df, *keep):
    return df.select(*keep, *[rd(c, 2).alias(c) for c in ("realized_pnl", "unrealized_pnl", "total_pnl")])


_MONEY = "round(realized_pnl, 2) realized_pnl, round(unrealized_pnl, 2) unrealized_pnl, round(total_pnl, 2) total_pnl"
_WHOLE = _MARKET.format(_ALL.format(_period("date '1900-01-01'", "date '2100-01-01'")))


def whole(t, m=None):
    return ho.market(ho.period(marks(t) if m is None else m, day("1900-01-01"), day("2100-01-01")))


@query("marks", f"select broker, rank, {_MONEY} from {_WHOLE}")
def d12_merged_ranking(t):
    return _money(whole(t), "broker", "rank")


@query("marks", f"select broker, coalesce(n_name, '') broker_name, rank, n - rank + 1 from_last, {_MONEY} from (select *, count(*) over () n from {_WHOLE}) left join nation on broker = concat('F', n_nationkey) where rank <= 5 or rank > n - 5 or broker = 'F7'".replace("n - rank + 1 from_last", "cast(n - rank + 1 as bigint) from_last"))
def e1_ranking_lookup(t):
    r = whole(t)
    r = r.crossJoin(F.broadcast(r.agg(F.count("*").alias("n")))).where("rank <= 5 or rank > n - 5 or broker = 'F7'")
    return _money(r.join(F.broadcast(names(t)), "broker", "left"), "broker", F.coalesce("broker_name", F.lit("")).alias("broker_name"), "rank", (F.col("n") - F.col("rank") + 1).alias("from_last"))


_SIDE = "case when buys > 1.1 * sells then 'long' when sells > 1.1 * buys then 'short' else 'neutral' end"


@query("marks mdaily", f"select r.broker, n_name broker_name, rank, {_MONEY}, {_SIDE} side from {_WHOLE} r join (select broker, sum(buy_amount) buys, sum(sell_amount) sells from mdaily group by 1) a on a.broker = r.broker join nation on r.broker = concat('F', n_nationkey)")
def e2_broker_profile(t):
    a = mdaily(t).groupBy("broker").agg(F.sum("buy_amount").alias("buys"), F.sum("sell_amount").alias("sells"))
    return _money(whole(t).join(a, "broker").join(F.broadcast(names(t)), "broker"), "broker", "broker_name", "rank", F.expr(_SIDE).alias("side"))


@query("marks", f"select broker, rank, {_MONEY} from {_MARKET.format(_ALL.format(_period("date '1997-11-04'", f"date '{END}'")))}")
def e3_rolling_ranking(t):
    return _money(ho.market(ho.period(marks(t), F.add_months(day(END), -36), day(END))), "broker", "rank")


@query("marks", f"select symbol, broker, pos, {_MONEY} from {_pos("date '1997-11-04'", f"date '{END}'")}")
def e4_symbol_ranking_to_date(t):
    return _money(ho.ranked(ho.period(marks(t), F.add_months(day(END), -36), day(END))), "symbol", "broker", "pos")


@query("marks", f"select symbol, broker, pos from {_pos(f"(date '{END}' - interval 182 day)", f"date '{END}'")} where pos <= 20")
def e5_fractional_years_top(t):
    return ho.ranked(ho.period(marks(t), F.date_sub(day(END), int(365 * 0.5)), day(END))).where("pos <= 20").select("symbol", "broker", "pos")


@query("marks", f"select symbol, broker, {_MONEY} from {_period("date '1997-11-04'", f"date '{END}'", False)}")
def e6_rolling_without_baseline(t):
    return _money(ho.period(marks(t), F.add_months(day(END), -36), day(END), baseline=False), "symbol", "broker")


@query("mdaily marks", f""", r as {_WHOLE}, d as (select *, dense_rank() over (partition by symbol order by date desc) back from (select distinct symbol, date from mdaily)),
    n as (select m.symbol, w, m.broker, sum(buy_shares - sell_shares) net from mdaily m join d using (symbol, date) join (values (1), (5), (10), (20), (60)) v(w) on back <= w group by all),
    x as (select n.*, rank, realized_pnl, unrealized_pnl, row_number() over (partition by symbol, w order by net desc, n.broker) top, row_number() over (partition by symbol, w order by net, n.broker) bottom from n join r using (broker))
    select symbol, w, count(*) n_active, cast(coalesce(sum(rank) filter (top <= 15 and net > 0), 0) as bigint) buyer_ranks, cast(coalesce(sum(rank) filter (bottom <= 15 and net < 0), 0) as bigint) seller_ranks,
    round(sum(realized_pnl), 2) realized_pnl, round(sum(unrealized_pnl), 2) unrealized_pnl from x group by all""")
def e8_smart_money(t):
    d = mdaily(t)
    dates = d.select("symbol", "date").distinct().withColumn("back", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).where("back <= 60")
    wide = d.join(dates, ["symbol", "date"]).withColumn("w", F.explode(F.filter(F.array(*map(F.lit, (1, 5, 10, 20, 60))), lambda x: x >= F.col("back"))))
    n = wide.groupBy("symbol", "w", "broker").agg(F.sum(F.col("buy_shares") - F.col("sell_shares")).alias("net")).join(whole(t), "broker")
    w = W.partitionBy("symbol", "w")
    n = n.withColumn("top", F.row_number().over(w.orderBy(F.desc("net"), "broker"))).withColumn("bottom", F.row_number().over(w.orderBy("net", "broker")))
    ranks = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), F.col("rank"))), F.lit(0)).cast("long")
    return n.groupBy("symbol", "w").agg(F.count("*").alias("n_active"), ranks("top <= 15 and net > 0").alias("buyer_ranks"), ranks("bottom <= 15 and net < 0").alias("seller_ranks"), rd(F.sum("realized_pnl"), 2).alias("realized_pnl"), rd(F.sum("unrealized_pnl"), 2).alias("unrealized_pnl"))


@query("daily", "select date, buy_shares, sell_shares, round(buy_amount, 2) buy_amount, round(sell_amount, 2) sell_amount from daily where symbol = 'Brand#11' and broker = 'S7'")
def e10_broker_trades(t):
    return t.daily.where("symbol = 'Brand#11' and broker = 'S7'").select("date", "buy_shares", "sell_shares", rd("buy_amount", 2).alias("buy_amount"), rd("sell_amount", 2).alias("sell_amount"))


_NOW, _THEN = f"date '{TRAIN_END}'", "date '1998-12-30'"
_MOMENTUM = f"""mo as (select symbol, broker, "now", "then", "then" - "now" gained from (select a.symbol, a.broker, a.pos as "now", coalesce(b.pos, u.unseen, 1) as "then" from {_pos(f"({_NOW} - interval 36 month)", _NOW)} a
    left join {_pos(f"({_THEN} - interval 36 month)", _THEN)} b on a.symbol = b.symbol and a.broker = b.broker
    left join (select symbol, max(pos) + 1 unseen from {_pos(f"({_THEN} - interval 36 month)", _THEN)} group by 1) u on a.symbol = u.symbol))"""


def momentum(t):
    return ho.rank_momentum(marks(t), day(TRAIN_END), day("1998-12-30"))


@query("marks", f', {_MOMENTUM} select symbol, broker, "now", "then", gained from mo')
def e12_rank_momentum(t):
    return momentum(t)


# ---------------------------------------------------------------- selectors


@query("marks", f", {TOP} select * from top")
def h1_top_k(t):
    return top(t).select("symbol", "broker")


@query("marks", f', {_MOMENTUM} select symbol, broker, pos from (select *, row_number() over (partition by symbol order by gained desc, broker) pos from mo) where pos <= 20')
def h2_ranking_momentum(t):
    return ho.first_of(momentum(t), 20, [F.desc("gained"), F.col("broker")]).select("symbol", "broker", "pos")


@query("marks mdaily", f""", l as {_pos(f"({_NOW} - interval 36 month)", _NOW)}, h as (select symbol, broker, 1.0 - (row_number() over (partition by symbol order by {_CENTS}) - 1) / nullif(count(*) over (partition by symbol) - 1, 0) here from l where total_pnl > 0),
    g as (select broker, 1.0 - (row_number() over (order by {_CENTS}) - 1) / nullif(count(*) over () - 1, 0) there from (select r.broker, total_pnl from {_WHOLE} r join (select broker, sum(buy_amount + sell_amount) amount from mdaily group by 1) a on a.broker = r.broker where amount >= 1e6)),
    c as (select symbol, h.broker, here - there contrast from h join g using (broker) where here - there >= 0.3)
    select symbol, broker, round(contrast, 6) contrast, pos from (select *, row_number() over (partition by symbol order by floor(contrast * 1e9 + 0.5) desc, broker) pos from c) where pos <= 10""")
def h3_niche_top(t):
    """The limit on turnover is scaled to the test tables' amounts (1e6 in place of 1e9)."""
    m, end = marks(t), day(TRAIN_END)
    amount = mdaily(t).groupBy("broker").agg(F.sum(F.col("buy_amount") + F.col("sell_amount")).alias("total_amount"))
    local = ho.period(m, F.add_months(end, -36), end)
    return ho.niche_top(local, whole(t, m).join(amount, "broker"), least_amount=1e6).withColumn("contrast", rd("contrast", 6))


@query("marks", f"select symbol, broker from {_pos(f"({_NOW} - interval 365 day)", _NOW)} where pos <= 20 intersect select symbol, broker from {_pos(f"({_NOW} - interval 1095 day)", _NOW)} where pos <= 20")
def h4_dual_window(t):
    m, end = marks(t), day(TRAIN_END)
    one, three = (ho.ranked(ho.period(m, F.date_sub(end, 365 * y), end)).where("pos <= 20").select("symbol", "broker") for y in (1, 3))
    return one.intersect(three)


@query("marks", f"""select symbol, broker, case when pos <= 5 then 'top' else 'bottom' end side from (select *, count(*) over (partition by symbol) n from {_pos(f"({_NOW} - interval 36 month)", _NOW)}) where pos <= 5 or pos > n - 5""")
def h5_top_and_bottom(t):
    end = day(TRAIN_END)
    r = ho.ranked(ho.period(marks(t), F.add_months(end, -36), end)).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    return r.where("pos <= 5 or pos > n - 5").select("symbol", "broker", F.when(F.col("pos") <= 5, "top").otherwise("bottom").alias("side"))


@query("mdaily", "select symbol, broker, count(*) as days from mdaily group by all having count(*) >= 60")
def h7_all_active(t):
    return mdaily(t).groupBy("symbol", "broker").agg(F.count("*").alias("days")).where("days >= 60")


@query("marks mdaily", f""", z as (select symbol, broker, abs(arg_max(unrealized_pnl, date)) u from marks group by all), w as (select *, u / nullif(sum(u) over (partition by broker), 0) weight, sum(u * u) over (partition by broker) / nullif(power(sum(u) over (partition by broker), 2), 0) hhi from z)
    select symbol, broker, round(weight, 6) weight, round(hhi, 6) hhi from w semi join mdaily using (symbol, broker) where weight > 0.08""")
def h8_l6_concentration(t):
    w = W.partitionBy("broker")
    z = marks(t).groupBy("symbol", "broker").agg(F.abs(F.max_by("unrealized_pnl", "date")).alias("u")).withColumn("all", F.sum("u").over(w))
    z = z.withColumn("weight", F.try_divide("u", "all")).withColumn("hhi", F.try_divide(F.sum(F.col("u") * F.col("u")).over(w), F.col("all") * F.col("all")))
    return z.where("weight > 0.08").join(mdaily(t).select("symbol", "broker").distinct(), ["symbol", "broker"], "left_semi").select("symbol", "broker", rd("weight", 6).alias("weight"), rd("hhi", 6).alias("hhi"))


# ---------------------------------------------------------------- event filters

_CHURN = "(select symbol, date, sum(buy_shares + sell_shares) / (abs(sum(buy_shares - sell_shares)) + 1) churn_ratio from marks semi join top using (symbol, broker) group by all)"


def _adding(cond: str, brokers: int) -> str:
    return f"""select e.symbol, e.date, 1 direction, signal_count, round(coalesce(churn_ratio, 1.0), 6) churn_ratio, round(amount, 2) conviction_amount from (select symbol, date, count(*) signal_count, sum(buy_amount) amount
    from marks semi join top using (symbol, broker) where net > 0 and buy_shares > sell_shares and {cond} group by all having count(*) >= {brokers}) e left join {_CHURN} c on c.symbol = e.symbol and c.date = e.date where e.date >= date '{TEST_START}'"""


def _tested(e):
    return e.where(F.col("date") >= day(TEST_START))


def _rounded_events(e):
    return _tested(e).withColumn("churn_ratio", rd("churn_ratio", 6)).withColumn("conviction_amount", rd("conviction_amount", 2))


@query("marks", f", {TOP} " + _adding('"close" - unrealized_pnl / net > 0 and unrealized_pnl / (net * ("close" - unrealized_pnl / net)) > 0.2', 3))
def i2_conviction(t):
    m = marks(t)
    return _rounded_events(ho.adding(m, top(t, m), 3, 0.2))


@query("marks", f", {TOP} " + _adding("true", 3))
def i6_concentration_increase(t):
    m = marks(t)
    return _rounded_events(ho.adding(m, top(t, m), 3))


@query("marks mdaily prices", f""", {TOP}, h as (select *, sum(buy_shares - sell_shares) over (partition by symbol, broker order by date) net from mdaily semi join top using (symbol, broker)),
    x as (select * from (select *, lag(net) over (partition by symbol, broker order by date) prev from h) where prev > 0 and (net <= 0 or net < prev * 0.5)),
    n as (select d.symbol, d.date, count(distinct x.broker) signal_count from (select distinct symbol, date from h) d join x on x.symbol = d.symbol and x.date between d.date - interval 20 day and d.date group by all having count(distinct x.broker) >= 5),
    p as (select symbol, date, "close" / lag("close", 20) over (partition by symbol order by date) - 1 trend from prices)
    select n.symbol, n.date, case when trend > 0.05 then -1 else 1 end direction, signal_count from n join p on p.symbol = n.symbol and p.date = n.date where abs(trend) > 0.05 and n.date >= date '{TEST_START}'""")
def i3_collective_exodus(t):
    m, d = marks(t), mdaily(t)
    return _tested(ho.exits(m, d, t.prices, top(t, m)))


@query("marks mdaily prices", f""", {TOP}, f as (select symbol, date, "close" / lag("close") over w - 1 r1, "close" / lag("close", 3) over w - 1 r3 from prices window w as (partition by symbol order by date))
    select f.symbol, f.date, 1 direction, signal_count from f join (select symbol, date, count(*) signal_count from mdaily semi join top using (symbol, broker) where buy_shares > sell_shares group by all having count(*) >= 3) b on b.symbol = f.symbol and b.date = f.date
    where r3 is not null and (r1 < -0.02 or r3 < -0.05) and f.date >= date '{TEST_START}'""")
def i4_contrarian_on_panic(t):
    return _tested(ho.panic_buying(mdaily(t), t.prices, top(t)))


_CLUSTER = ["Brand#11", "Brand#12", "Brand#13", "Brand#14", "Brand#15"]


@query("marks mlarge", f""", {TOP}, b as (select broker, date, sum(direction) total from mlarge semi join top using (symbol, broker) where symbol in ({", ".join(f"'{s}'" for s in _CLUSTER)}) group by all having count(distinct symbol) >= 2)
    select date, cast(sign(sum(total)) as int) direction, cast(abs(sum(total)) as bigint) signal_count from b group by 1 having sum(total) <> 0""")
def i5_cluster_accumulation(t):
    return ho.cluster_buying(ev.large_trades(mdaily(t)), top(t), _CLUSTER)


@query("mdaily marks", f""", r as (select symbol, broker, pos from {_pos("date '1900-01-01'", "date '2100-01-01'")}), d as (select *, dense_rank() over (partition by symbol order by date desc) back from (select distinct symbol, date from mdaily)),
    n as (select m.symbol, m.broker, cast(sum(buy_shares - sell_shares) as bigint) net_buy from mdaily m join d using (symbol, date) where back <= 20 group by all),
    x as (select *, row_number() over (partition by symbol order by net_buy desc, broker) top, row_number() over (partition by symbol order by net_buy, broker) bottom from n)
    select x.symbol, x.broker, coalesce(n_name, '') "name", net_buy, pos as rank, top, bottom from x left join r on r.symbol = x.symbol and r.broker = x.broker left join nation on x.broker = concat('F', n_nationkey) where top <= 15 or bottom <= 15""")
def e9_named_net_buyers(t):
    """Who bought and sold most over the last 20 dates of each symbol, with names and the account's place by profit; accounts without a place stay."""
    d = mdaily(t)
    dates = d.select("symbol", "date").distinct().withColumn("back", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).where("back <= 20")
    n = d.join(dates, ["symbol", "date"]).groupBy("symbol", "broker").agg(F.sum(F.col("buy_shares") - F.col("sell_shares")).alias("net_buy"))
    w = W.partitionBy("symbol")
    n = n.withColumn("top", F.row_number().over(w.orderBy(F.desc("net_buy"), "broker"))).withColumn("bottom", F.row_number().over(w.orderBy("net_buy", "broker"))).where("top <= 15 or bottom <= 15")
    place = ho.ranked(ho.period(marks(t), day("1900-01-01"), day("2100-01-01"))).select("symbol", "broker", F.col("pos").alias("rank"))
    x = n.join(place, ["symbol", "broker"], "left").join(names(t), "broker", "left")
    return x.select("symbol", "broker", F.coalesce("broker_name", F.lit("")).alias("name"), "net_buy", "rank", "top", "bottom")

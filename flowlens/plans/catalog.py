"""Registered queries of the engine, each with its SQL twin over the same tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions import stats
from flowlens.operators import events as ev
from flowlens.operators import fifo as ff
from flowlens.operators import holdings as ho
from flowlens.operators import series as se
from flowlens.sources import tables as tb

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Train window end, test window, and amounts scale of the derived tables (fixed values).
START, TRAIN_END, TEST_START, TEST_END = "1997-01-01", "1999-06-30", "1999-07-01", "2001-11-04"
HORIZONS = (1, 5, 10, 20)
#: Prints of a task that holds whole accounts.
PRINTS_A_TASK = 200_000

_CTE = {
    "prints": "prints as (select p_brand symbol, concat('S', l_suppkey) broker, cast(l_shipdate as date) date, l_extendedprice / l_quantity price, case when l_linestatus = 'O' then cast(l_quantity as bigint) else 0 end buy, case when l_linestatus = 'F' then cast(l_quantity as bigint) else 0 end sell, l_orderkey, l_linenumber from lineitem join part on l_partkey = p_partkey)",
    "daily": "daily as (select symbol, broker, date, cast(sum(buy) as bigint) buy_shares, cast(sum(sell) as bigint) sell_shares, sum(buy * price) buy_amount, sum(sell * price) sell_amount from prints group by all)",
    "prices": "prices as (select symbol, date, arg_min(price, l_orderkey * 10 + l_linenumber) open, max(price) high, min(price) low, sum((buy + sell) * price) / sum(buy + sell) \"close\", cast(sum(buy + sell) as bigint) volume from prints group by all)",
    "cum": "cum as (select *, least(b, s) m from (select *, sum(buy_shares) over w b, sum(sell_shares) over w s, sum(buy_amount) over w bc, sum(sell_amount) over w sc from daily window w as (partition by symbol, broker order by date rows unbounded preceding)))",
    "pos": "pos as (select c.*, case when c.m > 0 then x.bc - x.buy_amount + (c.m - (x.b - x.buy_shares)) * (x.buy_amount / x.buy_shares) else 0 end cost_b, case when c.m > 0 then y.sc - y.sell_amount + (c.m - (y.s - y.sell_shares)) * (y.sell_amount / y.sell_shares) else 0 end cost_s from cum c left join cum x on x.symbol = c.symbol and x.broker = c.broker and x.buy_shares > 0 and c.m > x.b - x.buy_shares and c.m <= x.b left join cum y on y.symbol = c.symbol and y.broker = c.broker and y.sell_shares > 0 and c.m > y.s - y.sell_shares and c.m <= y.s)",
    "fifo": "fifo as (select p.symbol, p.broker, p.date, (cost_s - cost_b) - coalesce(lag(cost_s - cost_b) over (partition by p.symbol, p.broker order by p.date), 0) realized_pnl, (b - s) * \"close\" - (bc - cost_b) + (sc - cost_s) unrealized_pnl, cast(b - s as bigint) net, buy_shares, sell_shares, buy_amount, sell_amount, \"close\" from pos p join prices q on p.symbol = q.symbol and p.date = q.date)",
    "state": "state as (select z.symbol, z.broker, cost_s - cost_b realized_pnl, (b - s) * \"close\" - (bc - cost_b) + (sc - cost_s) unrealized_pnl, bc total_buy_amount, sc total_sell_amount, cost_s - cost_b + (b - s) * \"close\" - (bc - cost_b) + (sc - cost_s) total_pnl from (select * from pos qualify row_number() over (partition by symbol, broker order by date desc) = 1) z join (select symbol, arg_max(\"close\", date) \"close\" from prices group by 1) f on z.symbol = f.symbol)",
    "large": "large as (select *, cast(sign(z) as int) direction from (select *, (net - mean) / std z from (select *, avg(net) over w mean, stddev_samp(net) over w std from (select *, buy_shares - sell_shares net from daily) window w as (partition by symbol, broker)) where std > 0) where abs(z) > 2)",
    "exact_large": "large as (select symbol, broker, date, buy_shares, sell_shares, net, away / sqrt(spread / (n - 1)) z, cast(sign(away) as int) direction from (select *, n * net - s away, n * (n * q - s * s) spread from (select *, cast(count(*) over w as double) n, cast(sum(net) over w as double) s, cast(sum(net * net) over w as double) q from (select *, buy_shares - sell_shares net from daily) window w as (partition by symbol, broker))) where n > 1 and spread > 0 and away * away * (n - 1) > 4.0 * spread)",
    "rets": "rets as (select symbol, date, \"close\", \"close\" / lag(\"close\") over (partition by symbol order by date) - 1 ret from prices qualify lag(\"close\") over (partition by symbol order by date) > 0)",
    "ticks": "ticks as (select event_id, event_type symbol, concat('U', user_id) broker, ts, value price from events)",
}
_NEEDS = {"daily": ["prints"], "prices": ["prints"], "cum": ["daily"], "pos": ["cum"], "fifo": ["pos", "prices"], "state": ["pos", "prices"], "large": ["daily"], "exact_large": ["daily"], "rets": ["prices"]}


def _with(names: str, body: str) -> str:
    done: list[str] = []

    def add(n: str) -> None:
        for x in _NEEDS.get(n, []):
            add(x)
        if n not in done:
            done.append(n)

    for n in names.split():
        add(n)
    return "with " + ", ".join(_CTE[n] for n in done) + body if done else body.lstrip(", ")


class _T:
    """Domain tables of one run, made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return tb.read(self.spark, self.dir, name)

    prints = property(lambda t: tb.prints(t.spark, t.dir))
    daily = property(lambda t: tb.daily_summary(t.prints))
    prices = property(lambda t: tb.prices(t.prints))
    #: Daily closes written once: a table of known size, so that days need not be dealt anew to meet them where it is small.
    closes = cached_property(lambda t: tb.stored(t.prices.select("symbol", "date", "close"), tb.workspace(t.spark, "closes"), "closes"))
    #: The tasks over which accounts are dealt follow the prints, so that what a task holds does not grow with them.
    tasks = cached_property(lambda t: max(t.raw("lineitem").count() // PRINTS_A_TASK + 1, t.spark.sparkContext.defaultParallelism))
    account_days = property(lambda t: tb.daily_summary(t.prints.repartition(t.tasks, "symbol", "broker")))
    fifo = property(lambda t: ff.fifo_daily(t.account_days, t.closes))
    state = property(lambda t: ff.last_state(t.account_days, t.closes))
    large = property(lambda t: ev.large_trades(t.daily))
    rets = property(lambda t: se.returns(t.prices))
    ticks = property(lambda t: tb.ticks(t.spark, t.dir))


def query(needs: str | None = None, sql: str | None = None):
    """Register a function of the tables; sql follows the common table expressions named in needs. Without sql the query has no SQL form."""

    def register(f: Callable[[_T], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(_T(spark, sf_dir))
        if sql:
            SQL[f.__name__] = _rounded(_with(needs or "", " " + sql))
        return f

    return register


def rd(c, n: int = 4):
    """Rounding by the same floating-point steps as in _rounded, so that ties fall alike."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 10.0**n + 0.500001) / 10.0**n


def _rounded(sql: str) -> str:
    """round(x, n) of the SQL twins written out as in rd."""
    while (at := sql.find("round(")) >= 0:
        depth, comma, i = 1, -1, at + 6
        while depth:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            comma = i if c == "," and depth == 1 else comma
            i += 1
        x, n = sql[at + 6 : comma], int(sql[comma + 1 : i - 1])
        sql = f"{sql[:at]}(floor(({x}) * {10.0**n!r} + 0.500001) / {10.0**n!r}){sql[i:]}"
    return sql


# ---------------------------------------------------------------- sources and cleaning


@query("prints", "select symbol, broker, date, round(price, 4) price, buy, sell from prints where date >= date '1998-01-01' and symbol in ('Brand#11', 'Brand#22')")
def a12_scoped_prints(t):
    return t.prints.where((F.col("date") >= F.lit("1998-01-01").cast("date")) & F.col("symbol").isin("Brand#11", "Brand#22")).select("symbol", "broker", "date", rd("price").alias("price"), "buy", "sell")


@query("", "select concat('S', s_suppkey) broker, coalesce(n_name, '') broker_name from supplier left join nation on s_nationkey = n_nationkey and n_regionkey <> 0")
def b11_broker_names(t):
    s, n = t.raw("supplier"), t.raw("nation").where("n_regionkey <> 0")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("broker"), F.coalesce("n_name", F.lit("")).alias("broker_name"))


_TEXT_PRICE = "case when l_suppkey % 50 = 0 then '-' else concat(cast(cast(floor(l_extendedprice) as bigint) // 1000 as varchar), ',', lpad(cast(cast(floor(l_extendedprice) as bigint) % 1000 as varchar), 3, '0'), '.50') end"


@query("", f"select l_orderkey, l_linenumber, cast(replace(p, ',', '') as double) price, cast(l_shipdate + interval 8 hour as date) date from (select *, {_TEXT_PRICE} p from lineitem) where p <> '-'")
def b1_b2_b3_clean_prints(t):
    whole = F.floor("l_extendedprice").cast("long")
    text = F.concat((whole - whole % 1000).cast("long").__truediv__(1000).cast("long").cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(".50"))
    raw = t.raw("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_suppkey") % 50 == 0, "-").otherwise(text).alias("price"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return tb.clean_prints(raw).select("l_orderkey", "l_linenumber", "price", "date")


@query("prints", """, f as (select concat('S', s_suppkey) broker, concat('F', s_nationkey) merged from supplier where s_suppkey > 25)
    select date, coalesce(merged, p.broker) broker, cast(sum(buy) as bigint) buy, cast(sum(sell) as bigint) sell from prints p left join f on f.broker = p.broker group by all""")
def b5_merged_shares(t):
    s = t.raw("supplier").where("s_suppkey > 25")
    mapping = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("broker"), F.concat(F.lit("F"), F.col("s_nationkey").cast("string")).alias("merged"))
    return ho.remapped(t.prints, mapping).groupBy("date", "broker").agg(F.sum("buy").alias("buy"), F.sum("sell").alias("sell"))


_CHAIN = "select s_suppkey k, s_suppkey // 2 nxt from supplier where s_suppkey > 1"


@query("", f"with recursive m as ({_CHAIN}), c(k, root, step) as (select k, nxt, 1 from m union all select c.k, m.nxt, step + 1 from c join m on c.root = m.k) select k, arg_max(root, step) root from c group by k")
def b6_successor_closure(t):
    """Chains of codes followed to their ends by doubling; cycles raise."""
    m = t.raw("supplier").where("s_suppkey > 1").select(F.col("s_suppkey").alias("key"), F.floor(F.col("s_suppkey") / 2).cast("long").alias("to"))
    return tb.closure(m).select(F.col("key").alias("k"), F.col("to").alias("root"))


@query("daily", "select symbol, broker, date, case when buy_amount > 1.1 * sell_amount then 'long' when sell_amount > 1.1 * buy_amount then 'short' else 'neutral' end side, round(buy_amount / 1e8, 8) buy_yi from daily where not starts_with(symbol, 'Brand#1')")
def b8_b12_b13_direction(t):
    side = F.when(F.col("buy_amount") > 1.1 * F.col("sell_amount"), "long").when(F.col("sell_amount") > 1.1 * F.col("buy_amount"), "short").otherwise("neutral")
    return t.daily.where(~F.col("symbol").startswith("Brand#1")).select("symbol", "broker", "date", side.alias("side"), rd(F.col("buy_amount") / 1e8, 8).alias("buy_yi"))


@query("", "select o_orderkey, o_totalprice, cast(o_orderdate as date) o_orderdate from orders where regexp_matches(o_orderpriority, '^[12]-') and o_totalprice > 100000 order by o_orderdate desc, o_orderkey limit 20")
def b16_pattern_top20(t):
    o = t.raw("orders").where(F.col("o_orderpriority").rlike("^[12]-") & (F.col("o_totalprice") > 100000))
    return o.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"))


# ---------------------------------------------------------------- aggregation


@query("daily", "select symbol, broker, date, buy_shares, sell_shares, round(buy_amount, 4) buy_amount, round(sell_amount, 4) sell_amount from daily")
def c1_daily_rollup(t):
    return t.daily.select("symbol", "broker", "date", "buy_shares", "sell_shares", rd("buy_amount").alias("buy_amount"), rd("sell_amount").alias("sell_amount"))


@query("daily", "select count(distinct symbol) n_symbols, count(distinct broker) n_brokers, min(date) first_date, max(date) last_date, count(*) n_rows from daily")
def c2_c3_overview(t):
    return t.daily.agg(F.count_distinct("symbol").alias("n_symbols"), F.count_distinct("broker").alias("n_brokers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_rows"))


@query("daily", "select distinct symbol from daily")
def c2_symbols(t):
    return t.prints.select("symbol").distinct()


@query("daily", """select broker, symbol, count(*) trading_days, cast(sum(buy_shares) as bigint) buy_shares, cast(sum(sell_shares) as bigint) sell_shares, round(sum(buy_amount), 4) buy_amount, round(sum(sell_amount), 4) sell_amount,
    cast(sum(buy_shares - sell_shares) as bigint) net_shares, round(sum(buy_amount) - sum(sell_amount), 4) net_amount from daily group by all order by buy_amount desc""")
def c4_broker_breakdown(t):
    """Largest amount bought first."""
    g = t.daily.groupBy("broker", "symbol").agg(F.count("*").alias("trading_days"), *[F.sum(c).alias(c) for c in ("buy_shares", "sell_shares", "buy_amount", "sell_amount")])
    out = g.select("broker", "symbol", "trading_days", "buy_shares", "sell_shares", rd("buy_amount").alias("buy_amount"), rd("sell_amount").alias("sell_amount"), (F.col("buy_shares") - F.col("sell_shares")).alias("net_shares"), rd(F.col("buy_amount") - F.col("sell_amount")).alias("net_amount"))
    return out.orderBy(F.desc("buy_amount"))


@query("state", "select count(*) n, round(sum(total_pnl), 2) total_pnl, round(max(total_pnl), 2) max_pnl, round(min(total_pnl), 2) min_pnl, round(abs(sum(total_pnl)) / sum(abs(total_pnl)), 6) zero_sum_ratio from state")
def c5_u2_market_summary(t):
    s = t.state
    return s.agg(F.count("*").alias("n"), rd(F.sum("total_pnl"), 2).alias("total_pnl"), rd(F.max("total_pnl"), 2).alias("max_pnl"), rd(F.min("total_pnl"), 2).alias("min_pnl"), rd(F.abs(F.sum("total_pnl")) / F.sum(F.abs("total_pnl")), 6).alias("zero_sum_ratio"))


@query("daily", "select * from (select broker, round(sum(buy_amount + sell_amount), 2) amount, row_number() over (order by round(sum(buy_amount + sell_amount), 2) desc, broker) as rank from daily group by 1) where rank <= 15")
def c6_top_by_amount(t):
    a = t.daily.groupBy("broker").agg(rd(F.sum(F.col("buy_amount") + F.col("sell_amount")), 2).alias("amount"))
    return a.orderBy(F.desc("amount"), "broker").limit(15).withColumn("rank", F.row_number().over(W.orderBy(F.desc("amount"), "broker")))


@query("daily", "select broker, count(*) filter (buy_shares > sell_shares) buy_days, count(*) filter (buy_shares < sell_shares) sell_days, count(*) filter (buy_shares = sell_shares) flat_days, round(avg(cast(buy_shares > sell_shares as int)), 6) buyer_share, count(distinct symbol) n_symbols from daily group by 1")
def c7_c8_behaviour(t):
    net = F.col("buy_shares") - F.col("sell_shares")
    return t.daily.groupBy("broker").agg(F.count_if(net > 0).alias("buy_days"), F.count_if(net < 0).alias("sell_days"), F.count_if(net == 0).alias("flat_days"), rd(F.avg((net > 0).cast("int")), 6).alias("buyer_share"), F.count_distinct("symbol").alias("n_symbols"))


@query("prices", "select symbol, round(arg_min(\"close\", date), 4) first_close, round(arg_max(\"close\", date), 4) last_close from prices group by 1")
def c9_first_last_close(t):
    return t.prices.groupBy("symbol").agg(rd(F.min_by("close", "date")).alias("first_close"), rd(F.max_by("close", "date")).alias("last_close"))


@query("daily", "select symbol, broker, count(*) n from daily join (select distinct symbol, broker from daily order by md5(concat(symbol, '|', broker)) limit 50) using (symbol, broker) group by all")
def c10_sampled_groups(t):
    d = t.daily
    pick = d.select("symbol", "broker").distinct().orderBy(F.md5(F.concat_ws("|", "symbol", "broker").cast("binary"))).limit(50)
    return d.join(pick, ["symbol", "broker"], "left_semi").groupBy("symbol", "broker").agg(F.count("*").alias("n"))


@query("rets", "select symbol, round(avg(ret), 8) mean, round(median(ret), 8) median, round(stddev_samp(ret), 8) std, round(quantile_cont(ret, 0.05), 8) p5, round(quantile_cont(ret, 0.25), 8) p25, round(quantile_cont(ret, 0.75), 8) p75, round(quantile_cont(ret, 0.95), 8) p95, count(*) n from rets group by 1")
def c11_summary(t):
    names = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    g = t.rets.groupBy("symbol").agg(F.avg("ret").alias("m"), F.percentile("ret", F.array(*map(F.lit, names.values()))).alias("q"), F.stddev_samp("ret").alias("s"), F.count("*").alias("n"))
    return g.select("symbol", rd("m", 8).alias("mean"), rd("s", 8).alias("std"), *[rd(F.col("q")[i], 8).alias(n) for i, n in enumerate(names)], "n")


@query("rets", "select symbol, round(avg(z * z * z), 5) skew, round(avg(z * z * z * z) - 3, 5) kurtosis, round(100 * avg(cast(abs(z) > 2 as int)), 4) beyond, cast(4.5500263896 as double) expected, round(100 * avg(cast(z <= 2 as int)), 4) sigma_percentile from (select symbol, (ret - avg(ret) over w) / stddev_samp(ret) over w z from rets window w as (partition by symbol)) group by 1")
def c12_shape(t):
    w = W.partitionBy("symbol")
    z = t.rets.withColumn("z", (F.col("ret") - F.avg("ret").over(w)) / F.stddev_samp("ret").over(w))
    return z.groupBy("symbol").agg(rd(F.avg(F.col("z") * F.col("z") * F.col("z")), 5).alias("skew"), rd(F.avg(F.col("z") * F.col("z") * F.col("z") * F.col("z")) - 3, 5).alias("kurtosis"), rd(100 * F.avg((F.abs("z") > 2).cast("int")), 4).alias("beyond"), F.lit(round(100 * math.erfc(2 / 2**0.5), 10)).alias("expected"), rd(100 * F.avg((F.col("z") <= 2).cast("int")), 4).alias("sigma_percentile"))


@query("", "select o_orderpriority reason, date_trunc('month', o_orderdate)::date as month, count(*) n, round(sum(o_totalprice), 2) volume from orders group by all")
def c13_monthly_reasons(t):
    return t.raw("orders").groupBy(F.col("o_orderpriority").alias("reason"), F.trunc("o_orderdate", "month").alias("month")).agg(F.count("*").alias("n"), rd(F.sum("o_totalprice"), 2).alias("volume"))


@query("fifo", "select broker, count(*) as months, count(*) filter (pnl > 0) win_months from (select broker, date_trunc('month', date) mo, round(sum(realized_pnl), 4) pnl from fifo group by all) group by 1")
def c14_win_months(t):
    m = t.fifo.groupBy("broker", F.trunc("date", "month").alias("mo")).agg(rd(F.sum("realized_pnl")).alias("pnl"))
    return m.groupBy("broker").agg(F.count("*").alias("months"), F.count_if(F.col("pnl") > 0).alias("win_months"))


@query("fifo", "select broker, cast(date_trunc('month', date) as date) as month, round(sum(realized_pnl), 4) pnl, cast(sum(buy_shares + sell_shares) as bigint) volume from (select f.*, d.buy_shares, d.sell_shares from fifo f join daily d on d.symbol = f.symbol and d.broker = f.broker and d.date = f.date) group by all")
def c14_monthly_profit(t):
    return t.fifo.groupBy("broker", F.trunc("date", "month").alias("month")).agg(rd(F.sum("realized_pnl")).alias("pnl"), F.sum(F.col("buy_shares") + F.col("sell_shares")).alias("volume"))


@query("daily", "select symbol, broker, round(sum(buy_amount) / nullif(sum(buy_shares), 0), 6) buy_vwap, round(sum(sell_amount) / nullif(sum(sell_shares), 0), 6) sell_vwap, round(sum(sell_amount) / nullif(sum(sell_shares), 0) - sum(buy_amount) / nullif(sum(buy_shares), 0), 6) spread from daily group by all")
def c15_o9_vwap(t):
    buy, sell = F.try_divide(F.sum("buy_amount"), F.sum("buy_shares")), F.try_divide(F.sum("sell_amount"), F.sum("sell_shares"))
    return t.daily.groupBy("symbol", "broker").agg(rd(buy, 6).alias("buy_vwap"), rd(sell, 6).alias("sell_vwap"), rd(sell - buy, 6).alias("spread"))


@query("daily prices", """select symbol, broker, round(sum(buy_shares * "close") / nullif(sum(buy_shares), 0), 6) at_buys, round(sum(sell_shares * "close") / nullif(sum(sell_shares), 0), 6) at_sells, round(sum(sell_shares * "close") / nullif(sum(sell_shares), 0) - sum(buy_shares * "close") / nullif(sum(buy_shares), 0), 6) spread
    from daily join prices using (symbol, date) group by all having sum(buy_shares) > 0 and sum(sell_shares) > 0""")
def c15_close_spread(t):
    """Closes weighted by the shares bought and sold, of accounts that did both."""
    x = t.daily.join(t.prices.select("symbol", "date", "close"), ["symbol", "date"])
    at = lambda c: F.try_divide(F.sum(F.col(c) * F.col("close")), F.sum(c))
    g = x.groupBy("symbol", "broker").agg(at("buy_shares").alias("b"), at("sell_shares").alias("s")).where("b is not null and s is not null")
    return g.select("symbol", "broker", rd("b", 6).alias("at_buys"), rd("s", 6).alias("at_sells"), rd(F.col("s") - F.col("b"), 6).alias("spread"))


# ---------------------------------------------------------------- FIFO and profit


@query("fifo", "select symbol, broker, date, round(realized_pnl, 3) realized_pnl, round(unrealized_pnl, 3) unrealized_pnl from fifo")
def d1_fifo_daily(t):
    return t.fifo.select("symbol", "broker", "date", rd("realized_pnl", 3).alias("realized_pnl"), rd("unrealized_pnl", 3).alias("unrealized_pnl"))


@query("cum", "select b.symbol, b.broker, cast(least(b.b, s.s) - greatest(b.b - b.buy_shares, s.s - s.sell_shares) as bigint) shares, b.date buy_date, s.date sell_date, round((least(b.b, s.s) - greatest(b.b - b.buy_shares, s.s - s.sell_shares)) * (s.sell_amount / s.sell_shares - b.buy_amount / b.buy_shares), 3) realized_pnl, case when b.date < s.date then 'long' else 'short' end trade_type from cum b join cum s on b.symbol = s.symbol and b.broker = s.broker and b.b - b.buy_shares < s.s and s.s - s.sell_shares < b.b where b.buy_shares > 0 and s.sell_shares > 0")
def d2_closed_trades(t):
    return ff.matches(t.daily).select("symbol", "broker", "shares", "buy_date", "sell_date", rd("realized_pnl", 3).alias("realized_pnl"), "trade_type")


@query("cum", "select symbol, broker, 'long' side, cast(b - greatest(b - buy_shares, mt) as bigint) shares, round(buy_amount / buy_shares, 6) cost_per_share, date open_date from (select *, least(max(b) over w, max(s) over w) mt from cum window w as (partition by symbol, broker)) where buy_shares > 0 and b > mt union all select symbol, broker, 'short', cast(s - greatest(s - sell_shares, mt) as bigint), round(sell_amount / sell_shares, 6), date from (select *, least(max(b) over w, max(s) over w) mt from cum window w as (partition by symbol, broker)) where sell_shares > 0 and s > mt")
def d3_open_lots(t):
    return ff.open_lots(t.daily).select("symbol", "broker", "side", "shares", rd("cost_per_share", 6).alias("cost_per_share"), "open_date")


_OPEN_AT = f"(select *, least(max(b) over w, max(s) over w) mt from cum where date <= date '{TRAIN_END}' window w as (partition by symbol, broker))"


@query("cum", f"select symbol, broker, 'long' side, cast(b - greatest(b - buy_shares, mt) as bigint) shares, round(buy_amount / buy_shares, 6) cost_per_share, date open_date from {_OPEN_AT} where buy_shares > 0 and b > mt union all select symbol, broker, 'short', cast(s - greatest(s - sell_shares, mt) as bigint), round(sell_amount / sell_shares, 6), date from {_OPEN_AT} where sell_shares > 0 and s > mt")
def d3_lots_at_a_date(t):
    """Lots open at the end of the train window; later days do not reach the accounting."""
    d = t.daily.where(F.col("date") <= F.lit(TRAIN_END).cast("date"))
    return ff.open_lots(d).select("symbol", "broker", "side", "shares", rd("cost_per_share", 6).alias("cost_per_share"), "open_date")


@query("prices", "select symbol, date, round(last_value(case when date_part('day', date) % 7 <> 0 then \"close\" end ignore nulls) over (partition by symbol order by date rows unbounded preceding), 6) filled from prices")
def d4_forward_fill(t):
    gap = F.when(F.day("date") % 7 != 0, F.col("close"))
    return t.prices.select("symbol", "date", rd(F.last(gap, ignorenulls=True).over(se.by_symbol().rowsBetween(W.unboundedPreceding, 0)), 6).alias("filled"))


@query("fifo state", f"""select f.symbol, f.broker, round(sum(case when date >= date '{START}' then f.realized_pnl else 0 end) + max(s.unrealized_pnl), 3) total_pnl
    from fifo f join state s on s.symbol = f.symbol and s.broker = f.broker group by all""")
def d6_backtest_window(t):
    """Profit realised from START on and the mark of what is open at the symbol's last close; accounting starts with the first trade."""
    s = ff.last_state(t.account_days, t.closes, START)
    return s.select("symbol", "broker", rd(F.col("late_pnl") + F.col("unrealized_pnl"), 3).alias("total_pnl"))


@query("state", "select symbol, broker, round(total_pnl, 2) total_pnl, round(realized_pnl, 2) realized_pnl, round(unrealized_pnl, 2) unrealized_pnl, row_number() over (partition by symbol order by round(total_pnl, 4) desc, broker) as rank from state")
def d7_symbol_ranking(t):
    r = ff.symbol_ranking(t.state)
    return r.select("symbol", "broker", *(rd(c, 2).alias(c) for c in ("total_pnl", "realized_pnl", "unrealized_pnl")), "rank")


@query("state", "select *, round(total_buy_amount + total_sell_amount, 2) total_amount, row_number() over (order by total_pnl desc, broker) as rank from (select broker, round(sum(total_pnl), 2) total_pnl, round(sum(realized_pnl), 2) realized_pnl, round(sum(unrealized_pnl), 2) unrealized_pnl, round(sum(total_buy_amount), 2) total_buy_amount, round(sum(total_sell_amount), 2) total_sell_amount from state group by 1)")
def broker_ranking(t):
    return ff.market_ranking(t.state)


@query("rets", "select symbol, date, round(ret, 8) ret from rets")
def d9_returns(t):
    return t.rets.select("symbol", "date", rd("ret", 8).alias("ret"))


@query("fifo", "select symbol, broker, date, net, round(\"close\" - unrealized_pnl / net, 4) avg_cost from fifo where net <> 0")
def d10_positions(t):
    return t.fifo.where("net <> 0").select("symbol", "broker", "date", "net", rd(F.col("close") - F.col("unrealized_pnl") / F.col("net")).alias("avg_cost"))


@query("fifo", "select symbol, broker, date, round(sell_amount - buy_amount + net * \"close\" - coalesce(lag(net * \"close\") over (partition by symbol, broker order by date), 0), 3) mtm_pnl from fifo")
def d11_mark_to_market(t):
    w = W.partitionBy("symbol", "broker").orderBy("date")
    value = F.col("net") * F.col("close")
    return t.fifo.select("symbol", "broker", "date", rd(F.col("sell_amount") - F.col("buy_amount") + value - F.coalesce(F.lag(value).over(w), F.lit(0.0)), 3).alias("mtm_pnl"))


# ---------------------------------------------------------------- rankings and look-ups

@query("daily", "select * from (select symbol, broker, net, row_number() over (partition by symbol order by net desc, broker) top, row_number() over (partition by symbol order by net, broker) bottom from (select symbol, broker, cast(sum(buy_shares - sell_shares) as bigint) net from daily group by all)) where top <= 5 or bottom <= 5")
def e9_net_buyers(t):
    n = t.daily.groupBy("symbol", "broker").agg(F.sum(F.col("buy_shares") - F.col("sell_shares")).alias("net"))
    w = W.partitionBy("symbol")
    return n.withColumn("top", F.row_number().over(w.orderBy(F.desc("net"), "broker"))).withColumn("bottom", F.row_number().over(w.orderBy("net", "broker"))).where("top <= 5 or bottom <= 5")


@query("prints", "select symbol, broker, buy + sell volume, l_orderkey, l_linenumber from prints join (select symbol, max(date) date from prints group by 1) using (symbol, date) qualify row_number() over (partition by symbol order by buy + sell desc, l_orderkey, l_linenumber) <= 10")
def e11_latest_top_prints(t):
    p = t.prints
    last = p.groupBy("symbol").agg(F.max("date").alias("date"))
    x = p.join(last, ["symbol", "date"], "left_semi").withColumn("volume", F.col("buy") + F.col("sell"))
    return x.withColumn("n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("volume"), "l_orderkey", "l_linenumber"))).where("n <= 10").select("symbol", "broker", "volume", "l_orderkey", "l_linenumber")


# ---------------------------------------------------------------- windows and series


@query("daily", "select symbol, broker, date, cast(sum(buy_shares - sell_shares) over (partition by symbol, broker order by date range between interval 364 days preceding and current row) as bigint) net_year, case when count(*) over r = 5 then cast(sum(buy_shares - sell_shares) over r as bigint) end net_5_rows from daily window r as (partition by symbol, broker order by date rows 4 preceding)")
def f3_f4_rolling(t):
    d = t.daily.withColumn("net", F.col("buy_shares") - F.col("sell_shares"))
    return d.select("symbol", "broker", "date", F.sum("net").over(se.days_window(("symbol", "broker"), 365)).alias("net_year"), se.rolling("net", 5, ("symbol", "broker")).alias("net_5_rows"))


@query("prices", "select * from (" + " union all ".join(f"select symbol, date, {h} horizon, round((lead(\"close\", {h}) over (partition by symbol order by date) / \"close\" - 1) * 10000, 4) ret_bps from prices" for h in HORIZONS) + ") where ret_bps is not null")
def f6_forward_returns(t):
    return se.forward_returns(t.prices, HORIZONS).withColumn("ret_bps", rd("ret_bps"))


@query("prices", "select symbol, date, round(\"close\" / lag(\"close\", 20) over (partition by symbol order by date) - 1, 8) ret20 from prices qualify lag(\"close\", 20) over (partition by symbol order by date) is not null")
def f7_trailing(t):
    return t.prices.select("symbol", "date", rd(F.col("close") / F.lag("close", 20).over(se.by_symbol()) - 1, 8).alias("ret20")).where("ret20 is not null")


@query("rets", "select symbol, count(*) n, round(stddev_samp(ret) * sqrt(20) * 10000, 4) vol20_bps from (select *, row_number() over (partition by symbol order by date desc) back from rets) where back <= 120 group by 1")
def f9_volatility(t):
    r = t.rets.withColumn("back", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).where("back <= 120")
    return r.groupBy("symbol").agg(F.count("*").alias("n"), rd(F.stddev_samp("ret") * F.sqrt(F.lit(20.0)) * 10000).alias("vol20_bps"))


@query("prices", "select symbol, max(date) month_end from prices group by symbol, date_trunc('month', date)")
def f11_month_ends(t):
    return t.prices.groupBy("symbol", F.trunc("date", "month").alias("m")).agg(F.max("date").alias("month_end")).select("symbol", "month_end")


@query("fifo", "select broker, symbol, coalesce(max(n) filter (win), 0) win_run, coalesce(max(n) filter (not win), 0) loss_run from (select symbol, broker, win, g, count(*) n from (select *, row_number() over (partition by symbol, broker order by date) - row_number() over (partition by symbol, broker, win order by date) g from (select symbol, broker, date, round(realized_pnl, 3) > 0 win from fifo where round(realized_pnl, 3) <> 0)) group by all) group by all")
def f14_streaks(t):
    return se.streaks(t.fifo.withColumn("pnl", rd("realized_pnl", 3)), ("symbol", "broker"), "pnl")


@query("ticks", "select symbol, date_trunc('minute', ts) as minute, round(arg_min(price, epoch_us(ts) * 1000 + event_id % 1000), 6) open, max(price) high, min(price) low, count(*) n from ticks group by all")
def f15_s6_minute_bars(t):
    key = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    return t.ticks.groupBy("symbol", F.date_trunc("minute", "ts").alias("minute")).agg(rd(F.min_by("price", key), 6).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.count("*").alias("n"))


@query("daily", "select symbol, date, broker, rank() over w + (count(*) over (partition by symbol, date, buy_shares) - 1) / 2.0 as avg_rank from daily window w as (partition by symbol, date order by buy_shares)")
def f16_average_rank(t):
    ties = F.count("*").over(W.partitionBy("symbol", "date", "buy_shares"))
    return t.daily.select("symbol", "date", "broker", (F.rank().over(W.partitionBy("symbol", "date").orderBy("buy_shares")) + (ties - 1) / 2.0).alias("avg_rank"))


# ---------------------------------------------------------------- large trades, events, selectors, filters


@query("exact_large", "select symbol, broker, date, round(z, 6) z, direction from large")
def g1_large_trades(t):
    return t.large.select("symbol", "broker", "date", rd("z", 6).alias("z"), "direction")


@query("large prices", ", n as (select symbol, count(*) n from prices group by 1), m as (select symbol, broker, n, sum(buy_shares - sell_shares) / n mean, sqrt(greatest(sum((buy_shares - sell_shares) * (buy_shares - sell_shares)) / n - power(sum(buy_shares - sell_shares) / n, 2), 0)) std, count(*) traded from daily join n using (symbol) group by symbol, broker, n) select m.symbol, m.broker, round(mean, 6) mean, round(std, 6) std, count(*) filter (abs(buy_shares - sell_shares - mean) > 2 * std) + max(case when abs(mean) > 2 * std then n - traded else 0 end) large_days from m join daily d on m.symbol = d.symbol and m.broker = d.broker where std > 0 group by m.symbol, m.broker, mean, std")
def g2_dense_large_days(t):
    return ev.dense_large_days(t.daily, t.prices).select("symbol", "broker", rd("mean", 6).alias("mean"), rd("std", 6).alias("std"), "large_days")


@query("daily", "select symbol, date, round(sum(buy_shares + sell_shares) / (abs(sum(buy_shares - sell_shares)) + 1), 6) churn_ratio from daily group by all")
def g6_churn(t):
    return ho.churn(t.daily).select("symbol", "date", rd("churn_ratio", 6).alias("churn_ratio"))


_EVENTS = "select symbol, date, cast(sign(sum(direction)) as int) direction, abs(sum(direction)) signal_value, count(*) signal_count from large group by all having sum(direction) <> 0"


@query("exact_large", _EVENTS.replace("abs(sum(direction))", "cast(abs(sum(direction)) as bigint)"))
def i1_large_trade_events(t):
    return ev.large_trade_events(t.large)


@query("large", f", e as ({_EVENTS}) select symbol, date, cast(count(*) over (partition by symbol order by date range between interval 30 days preceding and current row) as bigint) persistence from e")
def g8_persistence(t):
    e = ev.large_trade_events(t.large)
    return e.select("symbol", "date", F.count("*").over(se.days_window(("symbol",), 31)).alias("persistence"))


@query("large", f", recursive_free as (select 1), e as ({_EVENTS}), o as (select symbol, direction, date, row_number() over (partition by symbol, direction order by date) i from e), k as (select symbol, direction, list(date order by date) as days from o group by all) select symbol, direction, unnest(list_reduce(list_transform(days, lambda d: [d]), lambda a, x: case when date_diff('day', a[len(a)], x[1]) >= 30 then list_concat(a, x) else a end)) date from k")
def g9_spread_events(t):
    return se.spread_out(ev.large_trade_events(t.large), ("symbol", "direction"), 30)


@query("prices", "select symbol, date, round(\"close\" / prev, 4) ratio from (select *, lag(\"close\") over (partition by symbol order by date) prev from prices) where len(list_filter([0.5, 1.0/3, 0.25, 0.2, 0.1, 2, 3, 4, 5, 10], lambda x: abs(\"close\" / prev / x - 1) <= 0.05)) > 0")
def g10_splits(t):
    known = F.array(*map(F.lit, (0.5, 1.0 / 3, 0.25, 0.2, 0.1, 2.0, 3.0, 4.0, 5.0, 10.0)))
    p = t.prices.withColumn("ratio", F.col("close") / F.lag("close").over(se.by_symbol()))
    return p.where(F.exists(known, lambda x: F.abs(F.col("ratio") / x - 1) <= 0.05)).select("symbol", "date", rd("ratio").alias("ratio"))


# ---------------------------------------------------------------- statistics and jobs


@query("daily prices", ", p as (select *, lead(\"close\") over (partition by symbol order by date) / \"close\" - 1 nr from prices), tot as (select symbol, count(*) n, sum(nr) ar from p group by 1), m as (select d.symbol, d.broker, sum(buy_shares - sell_shares) sx, sum((buy_shares - sell_shares) * (buy_shares - sell_shares)) sxx, sum((buy_shares - sell_shares) * coalesce(nr, 0)) cr from daily d join p on d.symbol = p.symbol and d.date = p.date group by all) select m.symbol, broker, round(case when n >= 2 and sqrt(greatest(sxx / n - power(sx / n, 2), 0)) > 1e-9 then (cr - sx / n * ar) / sqrt(greatest(sxx / n - power(sx / n, 2), 0)) else 0 end, 6) timing_alpha from m join tot using (symbol)")
def k1_timing_alpha(t):
    return ev.timing_alpha(t.daily, t.prices).withColumn("timing_alpha", rd("timing_alpha", 6))


_FWD = " union all ".join(f"select symbol, date, {h} horizon, (lead(\"close\", {h}) over (partition by symbol order by date) / \"close\" - 1) * 10000 ret from prices" for h in HORIZONS)
_COMPARE = f", ev as ({_EVENTS}), fr as (select * from ({_FWD}) where ret is not null), a as (select symbol, horizon, avg(ret * direction) m, var_samp(ret * direction) v, count(*) n from fr join ev using (symbol, date) where date >= date '{TEST_START}' group by all having count(*) >= 3), b as (select symbol, horizon, avg(ret) m, var_samp(ret) v, count(*) n from fr group by all), c as (select symbol, horizon, a.n, a.m, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) t, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) d from a join b using (symbol, horizon)), pv as (select *, {stats.erfc_sql('(abs(t)/sqrt(2.0))')} p from c)"


def compare(t) -> DataFrame:
    """Direction-adjusted returns after events against all returns: Welch t, p and effect size for each symbol and horizon."""
    fr = se.forward_returns(t.prices, HORIZONS)
    agg = lambda v: (F.avg(v).alias("m"), F.var_samp(v).alias("v"), F.count("*").alias("n"))
    e = ev.large_trade_events(t.large).where(F.col("date") >= F.lit(TEST_START).cast("date"))
    a = fr.join(e, ["symbol", "date"]).groupBy("symbol", "horizon").agg(*agg(F.col("ret_bps") * F.col("direction"))).where("n >= 3")
    b = fr.groupBy("symbol", "horizon").agg(*agg(F.col("ret_bps"))).withColumnsRenamed({"m": "bm", "v": "bv", "n": "bn"})
    args = [F.col(c) for c in ("m", "v", "n", "bm", "bv", "bn")]
    c = a.join(b, ["symbol", "horizon"]).withColumn("t", stats.welch_t(*args)).withColumn("d", stats.cohens_d(*args))
    return c.withColumn("p", stats.normal_p(F.col("t")))


@query("large prices", _COMPARE + " select symbol, horizon, n, round(m, 3) mean_bps, round(t, 5) t, round(d, 5) d, round(p, 5) p, least(round(p * 4, 5), 1) < 0.05 and abs(d) >= 0.2 significant from pv")
def k5_k7_compare(t):
    sig = (F.least(rd(F.col("p") * 4, 5), F.lit(1.0)) < 0.05) & (F.abs("d") >= 0.2)
    return compare(t).select("symbol", "horizon", "n", rd("m", 3).alias("mean_bps"), rd("t", 5).alias("t"), rd("d", 5).alias("d"), rd("p", 5).alias("p"), sig.alias("significant"))


@query("large prices", _COMPARE + ", r as (select *, row_number() over (order by round(p, 9), symbol, horizon) k, count(*) over () nt from pv) select symbol, horizon, round(p, 5) p, k <= coalesce(max(k) filter (round(p, 9) <= 0.05 * k / nt) over (), 0) rejected from r")
def k11_l4_fdr(t):
    c = ev.benjamini_hochberg(compare(t).withColumn("run", F.lit(1)), rd("p", 9), ("run",), ties=("symbol", "horizon"))
    return c.select("symbol", "horizon", rd("p", 5).alias("p"), "rejected")


@query("rets", ", mk as (select date, avg(ret) mret from rets group by 1) select symbol, round(regr_slope(ret, mret), 6) beta, round(regr_intercept(ret, mret) * 252, 6) alpha, round(regr_r2(ret, mret), 6) r2, round(avg(ret) / stddev_samp(ret) * sqrt(252), 5) sharpe, count(*) n from rets join mk using (date) group by 1")
def k20_beta(t):
    r = t.rets
    j = r.join(r.groupBy("date").agg(F.avg("ret").alias("mret")), "date")
    return j.groupBy("symbol").agg(rd(F.regr_slope("ret", "mret"), 6).alias("beta"), rd(F.regr_intercept("ret", "mret") * 252, 6).alias("alpha"), rd(F.regr_r2("ret", "mret"), 6).alias("r2"), rd(F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(252.0)), 5).alias("sharpe"), F.count("*").alias("n"))


@query("large prices", f", ev as ({_EVENTS}), x as (select e.symbol, e.date, e.direction, p.open, p.\"close\" from (select *, lead(date) over (partition by symbol order by date) nx from prices) q join ev e on e.symbol = q.symbol and e.date = q.date join prices p on p.symbol = q.symbol and p.date = q.nx) select symbol, count(*) n, round(avg(direction * (\"close\" / open - 1)), 8) mean_ret, round(avg(cast(direction * (\"close\" / open - 1) > 0 as int)), 6) win_rate, count(*) filter (direction > 0) n_long from x where open > 0 group by 1")
def m6_m10_open_to_close(t):
    nxt = t.prices.select("symbol", "date", F.lead(F.struct("open", "close")).over(se.by_symbol()).alias("x"))
    j = ev.large_trade_events(t.large).join(nxt, ["symbol", "date"]).where("x.open > 0")
    r = F.col("direction") * (F.col("x.close") / F.col("x.open") - 1)
    return j.groupBy("symbol").agg(F.count("*").alias("n"), rd(F.avg(r), 8).alias("mean_ret"), rd(F.avg((r > 0).cast("int")), 6).alias("win_rate"), F.count_if(F.col("direction") > 0).alias("n_long"))


# ---------------------------------------------------------------- profiles, episodes, quality


_CLASS = "case when days <= 2 then 'single' when buyd >= 0.6 then 'accumulate' when selld >= 0.6 then 'distribute' when abs(buyd - selld) < 0.2 then 'speculative' else 'mixed' end"


@query("daily", f"select kind, count(*) n from (select {_CLASS} kind from (select symbol, broker, count(*) as days, avg(cast(buy_shares > sell_shares as int)) buyd, avg(cast(buy_shares < sell_shares as int)) selld from daily group by all)) group by 1")
def o5_behaviour_classes(t):
    net = F.col("buy_shares") - F.col("sell_shares")
    g = t.daily.groupBy("symbol", "broker").agg(F.count("*").alias("days"), F.avg((net > 0).cast("int")).alias("buyd"), F.avg((net < 0).cast("int")).alias("selld"))
    return g.groupBy(F.expr(_CLASS).alias("kind")).agg(F.count("*").alias("n"))


@query("fifo", "select count(*) n, count(*) filter (net <> 0 and unrealized_pnl is null) missing, count(*) - count(distinct (symbol, broker, date)) repeated, round(max(abs(total - cash)), 3) < 0.01 reconciled from (select *, sum(realized_pnl) over w + unrealized_pnl total, sum(sell_amount - buy_amount) over w + net * \"close\" cash from fifo window w as (partition by symbol, broker order by date))")
def u3_u4_invariants(t):
    w = W.partitionBy("symbol", "broker").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    f = t.fifo.withColumn("gap", F.sum("realized_pnl").over(w) + F.col("unrealized_pnl") - F.sum(F.col("sell_amount") - F.col("buy_amount")).over(w) - F.col("net") * F.col("close"))
    return f.agg(F.count("*").alias("n"), F.count_if((F.col("net") != 0) & F.col("unrealized_pnl").isNull()).alias("missing"), (F.count("*") - F.count_distinct("symbol", "broker", "date")).alias("repeated"), (rd(F.max(F.abs("gap")), 3) < 0.01).alias("reconciled"))


@query("prices", "select symbol, count(*) n_splits from (select symbol, \"close\" / prev ratio from (select *, lag(\"close\") over (partition by symbol order by date) prev from prices)) where len(list_filter([0.5, 1.0/3, 0.25, 0.2, 0.1, 2, 3, 4, 5, 10], lambda x: abs(ratio / x - 1) <= 0.05)) > 0 group by 1")
def g10_split_symbols(t):
    """Symbols with any such day."""
    return QUERIES["g10_splits"](t.spark, t.dir).groupBy("symbol").agg(F.count("*").alias("n_splits"))


@query("daily", f"select symbol, kind, count(*) n from (select symbol, {_CLASS} kind from (select symbol, broker, count(*) as days, avg(cast(buy_shares > sell_shares as int)) buyd, avg(cast(buy_shares < sell_shares as int)) selld from daily where date between date '{TEST_START}' and date '{TEST_END}' group by all)) group by all")
def o5_window_classes(t):
    """Behaviour within the test window, by symbol."""
    n = F.col("buy_shares") - F.col("sell_shares")
    d = t.daily.where(F.col("date").between(F.lit(TEST_START).cast("date"), F.lit(TEST_END).cast("date")))
    g = d.groupBy("symbol", "broker").agg(F.count("*").alias("days"), F.avg((n > 0).cast("int")).alias("buyd"), F.avg((n < 0).cast("int")).alias("selld"))
    return g.groupBy("symbol", F.expr(_CLASS).alias("kind")).agg(F.count("*").alias("n"))


# the rest of the catalogue registers itself
from flowlens.plans import inference, rankings, reports, research, stored, studies  # noqa: E402, F401

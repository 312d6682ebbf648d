"""Queries on series, signals, profiles, episodes and data quality, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions import stats
from flowlens.operators import events as ev
from flowlens.operators import holdings as ho
from flowlens.operators import scorecards as so
from flowlens.operators import series as se
from flowlens.plans.catalog import _CTE, _EVENTS, HORIZONS, TEST_START, TRAIN_END, query, rd
from flowlens.plans.rankings import _WHOLE, TOP, _pos, day, marks, mdaily, top, whole

ACCOUNT = ("symbol", "broker")
_MEVENTS = _EVENTS.replace("from large", "from mlarge")


def net():
    return F.col("buy_shares") - F.col("sell_shares")


# ---------------------------------------------------------------- sources and cleaning


@query("prints", "select symbol, broker, date, round(price, 4) price, buy, sell, round(buy * price, 4) buy_amount, round(sell * price, 4) sell_amount from prints where date = date '1998-03-02' and symbol in ('Brand#11', 'Brand#12')")
def a10_b4_day_extract(t):
    p = t.prints.where((F.col("date") == day("1998-03-02")) & F.col("symbol").isin("Brand#11", "Brand#12"))
    return p.select("symbol", "broker", "date", rd("price").alias("price"), "buy", "sell", rd(F.col("buy") * F.col("price")).alias("buy_amount"), rd(F.col("sell") * F.col("price")).alias("sell_amount"))


@query("", "select 'lineitem.parquet' file_name, count(*) n_rows from lineitem union all select 'orders.parquet', count(*) from orders")
def a11_rows_per_file(t):
    one = lambda name: t.raw(name).groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name")).agg(F.count("*").alias("n_rows"))
    return one("lineitem").union(one("orders"))


@query("daily", "select symbol, broker, count(*) n from daily semi join (select distinct p_brand symbol from part where p_size > 45) using (symbol) group by all")
def b7_universe(t):
    known = t.raw("part").where("p_size > 45").select(F.col("p_brand").alias("symbol")).distinct()
    return t.daily.join(known, "symbol", "left_semi").groupBy(*ACCOUNT).agg(F.count("*").alias("n"))


@query("", "select case when l_suppkey % 50 = 0 then 'proprietary' else 'normal' end kind, count(*) n, cast(sum(l_quantity) as bigint) shares from lineitem group by 1")
def b10_u7_proprietary_sums(t):
    kind = F.when(F.col("l_suppkey") % 50 == 0, "proprietary").otherwise("normal")
    return t.raw("lineitem").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("shares"))


@query("", "select o_orderkey, case when o_orderdate + interval 30 day < date '1998-01-01' then true else false end expired from orders where o_orderpriority not in ('5-LOW', '4-NOT SPECIFIED')")
def b9_b15_expiry(t):
    o = t.raw("orders").where(~F.col("o_orderpriority").isin("5-LOW", "4-NOT SPECIFIED"))
    return o.select("o_orderkey", (F.date_add(F.to_date("o_orderdate"), 30) < day("1998-01-01")).alias("expired"))


# ---------------------------------------------------------------- windows and series


@query("daily", "select symbol, date, broker, row_number() over (partition by symbol, date order by buy_shares - sell_shares desc, broker) as rank from daily")
def f5_rank_in_date(t):
    return t.daily.select("symbol", "date", "broker", F.row_number().over(W.partitionBy("symbol", "date").orderBy(F.desc(net()), "broker")).alias("rank"))


_DECAY = f""", e as ({_EVENTS}), b as (select symbol, date, "close", row_number() over (partition by symbol order by date) i from prices)
    select d, round(avg(direction * (y."close" / x."close" - 1) * 10000), 4) car_bps, count(*) n from e join b x on x.symbol = e.symbol and x.date = e.date cross join (select unnest(range(1, 21)) d) join b y on y.symbol = x.symbol and y.i = x.i + d group by 1"""


@query("exact_large prices", _DECAY)
def f8_car_decay(t):
    b = t.prices.select("symbol", "date", "close", F.row_number().over(se.by_symbol()).alias("i"))
    x = ev.large_trade_events(t.large).join(b, ["symbol", "date"]).select("symbol", "direction", F.col("close").alias("from"), "i", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("d"))
    j = x.withColumn("i", F.col("i") + F.col("d")).join(b.drop("date"), ["symbol", "i"])
    return j.groupBy(F.col("d").cast("long").alias("d")).agg(rd(F.avg(F.col("direction") * (F.col("close") / F.col("from") - 1) * 10000)).alias("car_bps"), F.count("*").alias("n"))


@query("prices", f"""select symbol, horizon, count(*) n, round(avg(ret), 4) mean_bps from (select *, row_number() over (partition by symbol order by date) i, count(*) over (partition by symbol) n from prices) b
    join ({" union all ".join(f'select symbol, date, {h} horizon, (lead("close", {h}) over (partition by symbol order by date) / "close" - 1) * 10000 ret from prices' for h in HORIZONS)}) r using (symbol, date) where i <= n - {max(HORIZONS)} and ret is not null group by all""")
def f10_j3_baseline_returns(t):
    """Returns of all dates far enough from the end for every horizon, which is what a sample of up to 10,000 dates without replacement holds."""
    n = W.partitionBy("symbol")
    valid = t.prices.select("symbol", "date", F.row_number().over(se.by_symbol()).alias("i"), F.count("*").over(n).alias("n")).where(F.col("i") <= F.col("n") - max(HORIZONS))
    return se.forward_returns(t.prices, HORIZONS).join(valid.select("symbol", "date"), ["symbol", "date"]).groupBy("symbol", "horizon").agg(F.count("*").alias("n"), rd(F.avg("ret_bps")).alias("mean_bps"))


@query("prices", "select symbol, date, lead(date) over w next_date, lead(date, 5) over w fifth_date from prices window w as (partition by symbol order by date)")
def f12_next_dates(t):
    return t.prices.select("symbol", "date", F.lead("date").over(se.by_symbol()).alias("next_date"), F.lead("date", 5).over(se.by_symbol()).alias("fifth_date"))


_HALF = """, i as (select symbol, date, row_number() over (partition by symbol order by date) - 1 i, count(*) over (partition by symbol) n from prices),
    h as (select d.symbol, broker, case when i < n // 2 then 1 else 2 end half, cast(sum(buy_shares - sell_shares) as bigint) net from daily d join i on i.symbol = d.symbol and i.date = d.date group by all)"""


def halves(t):
    i = t.prices.select("symbol", "date", (F.row_number().over(se.by_symbol()) - 1).alias("i"), F.count("*").over(W.partitionBy("symbol")).alias("n"))
    j = t.daily.join(i, ["symbol", "date"]).withColumn("half", F.when(F.col("i") < F.floor(F.col("n") / 2), 1).otherwise(2))
    return j.groupBy(*ACCOUNT, "half").agg(F.sum(net()).alias("net"))


_KIND = "case when first_half > 0 and second_half < 0 then 'buy to sell' when first_half < 0 and second_half > 0 then 'sell to buy' else 'none' end"


@query("daily prices", f"{_HALF} select *, {_KIND} reversal from (select symbol, broker, coalesce(a.net, 0) first_half, coalesce(b.net, 0) second_half from (select * from h where half = 1) a full join (select * from h where half = 2) b using (symbol, broker))")
def f17_o6_reversals(t):
    h = halves(t)
    a, b = (h.where(f"half = {k}").select(*ACCOUNT, F.col("net").alias(name)) for k, name in ((1, "first_half"), (2, "second_half")))
    return a.join(b, [*ACCOUNT], "full").na.fill(0, ["first_half", "second_half"]).withColumn("reversal", F.expr(_KIND))


# ---------------------------------------------------------------- events


@query("mdaily", """select symbol, date, round(sum(gross) over w / (abs(sum(net) over w) + 1), 6) churn_20 from (select symbol, date, sum(buy_shares + sell_shares) gross, sum(buy_shares - sell_shares) net from mdaily group by all)
    window w as (partition by symbol order by date rows 19 preceding) qualify count(*) over w = 20""")
def g7_rolling_churn(t):
    g = mdaily(t).groupBy("symbol", "date").agg(F.sum(F.col("buy_shares") + F.col("sell_shares")).alias("gross"), F.sum(net()).alias("net"))
    x = g.select("symbol", "date", rd(se.rolling("gross", 20, ("symbol",)) / (F.abs(se.rolling("net", 20, ("symbol",))) + 1), 6).alias("churn_20"))
    return x.where("churn_20 is not null")


@query("mdaily", """select symbol, count(*) n, round(100 * avg(cast(abs(z) > 2 as int)), 4) beyond_pct, round(quantile_cont(z, 0.95), 5) p95, round(avg(z * z * z), 5) skew from
    (select symbol, (net - avg(net) over w) / stddev_samp(net) over w z, stddev_samp(net) over w s from (select *, buy_shares - sell_shares net from mdaily) window w as (partition by symbol, broker)) where s > 0 group by 1""")
def g11_threshold_calibration(t):
    w = W.partitionBy(*ACCOUNT)
    z = mdaily(t).withColumn("net", net()).withColumn("s", F.stddev_samp("net").over(w)).withColumn("m", F.avg("net").over(w)).where("s > 0").withColumn("z", (F.col("net") - F.col("m")) / F.col("s"))
    return z.groupBy("symbol").agg(F.count("*").alias("n"), rd(100 * F.avg((F.abs("z") > 2).cast("int"))).alias("beyond_pct"), rd(F.percentile("z", F.lit(0.95)), 5).alias("p95"), rd(F.avg(F.col("z") * F.col("z") * F.col("z")), 5).alias("skew"))


@query("marks mdaily", f""", {TOP}, s as (select symbol, date, avg(cast(buy_shares > sell_shares as int)) smart from mdaily semi join top using (symbol, broker) group by all),
    c as (select symbol, date, avg(cast(buy_shares > sell_shares as int)) crowd from mdaily anti join top using (symbol, broker) group by all having count(distinct broker) >= 1),
    d as (select symbol, date, case when count(*) over w = 5 then avg(crowd - smart) over w end gap from s join c using (symbol, date) window w as (partition by symbol order by date rows 4 preceding)),
    r as (select *, row_number() over (partition by symbol order by floor(gap * 1e9 + 0.5), date) - 1 i, count(*) over (partition by symbol) n from d where gap is not null)
    select symbol, date, case when i <= round(0.05 * (n - 1)) then 1 else -1 end direction, round(abs(gap), 6) signal_value from r where n >= 20 and (i <= round(0.05 * (n - 1)) or i >= round(0.95 * (n - 1)))""".replace("round(0.05 * (n - 1))", "floor(0.05 * (n - 1) + 0.5)").replace("round(0.95 * (n - 1))", "floor(0.95 * (n - 1) + 0.5)"))
def i7_herding_divergence(t):
    """Share of net buyers in the crowd less that among selected brokers, mean of 5 rows, at its extreme twentieths. One crowd broker a day is enough, where the reference asks five: the tables have some 8 firms a symbol and day."""
    d, sel = mdaily(t), top(t).select(*ACCOUNT)
    share = lambda x, name: x.groupBy("symbol", "date").agg(F.avg((net() > 0).cast("int")).alias(name), F.count_distinct("broker").alias("n"))
    j = share(d.join(sel, [*ACCOUNT], "left_semi"), "smart").drop("n").join(share(d.join(sel, [*ACCOUNT], "left_anti"), "crowd").where("n >= 1").drop("n"), ["symbol", "date"])
    g = j.withColumn("diff", F.col("crowd") - F.col("smart")).withColumn("gap", se.rolling("diff", 5, ("symbol",), how=F.avg)).where("gap is not null")
    w = W.partitionBy("symbol")
    r = g.withColumn("i", F.row_number().over(w.orderBy(F.floor(F.col("gap") * 1e9 + 0.5), "date")) - 1).withColumn("n", F.count("*").over(w))
    low, high = (F.floor(q * (F.col("n") - 1) + 0.5) for q in (0.05, 0.95))
    return r.where((F.col("n") >= 20) & ((F.col("i") <= low) | (F.col("i") >= high))).select("symbol", "date", F.when(F.col("i") <= low, 1).otherwise(-1).alias("direction"), rd(F.abs("gap"), 6).alias("signal_value"))


_TESTED = _CTE["mlarge"].split("as (", 1)[1].rsplit(")", 1)[0].replace("from mdaily)", f"from mdaily where date >= date '{TEST_START}')")


@query("mdaily", f", l as ({_TESTED}), e as ({_EVENTS.replace('from large', 'from (select * from l where case when direction > 0 then buy_amount else sell_amount end >= 1e4)')}) select symbol, date, direction, cast(signal_value as bigint) signal_value, signal_count from e")
def i8_large_trades_test_window(t):
    """Large trades by the statistics of the test window alone, of a least amount (1e4 here, for the test tables' scale)."""
    large = ev.large_trades(mdaily(t).where(F.col("date") >= day(TEST_START)))
    amount = F.when(F.col("direction") > 0, F.col("buy_amount")).otherwise(F.col("sell_amount"))
    return ev.large_trade_events(large.where(amount >= 1e4))


_FWD5 = """select symbol, date, (lead("close", 5) over (partition by symbol order by date) / "close" - 1) * 10000 ret from prices"""


@query("mlarge prices", f", e as ({_MEVENTS}), f as ({_FWD5}) select e.symbol, count(*) n, round(avg(ret), 4) mean_bps, round(stddev_samp(ret), 4) std_bps from e join f on f.symbol = 'Brand#11' and f.date = e.date where e.symbol <> 'Brand#11' and ret is not null group by 1")
def j2_j4_cross_symbol_returns(t):
    """Returns of one target symbol after the events of each other symbol, not turned by direction."""
    f = se.forward_returns(t.prices.where("symbol = 'Brand#11'"), (5,)).select("date", "ret_bps")
    j = ev.large_trade_events(ev.large_trades(mdaily(t))).where("symbol <> 'Brand#11'").join(F.broadcast(f), "date")
    return j.groupBy("symbol").agg(F.count("*").alias("n"), rd(F.avg("ret_bps")).alias("mean_bps"), rd(F.stddev_samp("ret_bps")).alias("std_bps"))


@query("marks mdaily prices", f""", r as {_pos(f"(date '{TRAIN_END}' - interval 36 month)", f"date '{TRAIN_END}'")}, g as (select symbol, broker, case when pos <= 5 then 1 when pos > n - 5 then -1 end side from (select *, count(*) over (partition by symbol) n from r)),
    s as (select d.symbol, d.date, sum(case when side = 1 then buy_shares - sell_shares end) up, sum(case when side = -1 then buy_shares - sell_shares end) down from mdaily d join g on g.symbol = d.symbol and g.broker = d.broker where side is not null group by all), f as ({_FWD5})
    select s.symbol, count(*) n, round(avg(ret), 4) mean_bps from s join f on f.symbol = s.symbol and f.date = s.date where up * down < 0 and ret is not null group by 1""")
def j5_disagreement_days(t):
    """Returns after days on which the best and the worst brokers of a symbol trade in opposite directions."""
    end = day(TRAIN_END)
    r = ho.ranked(ho.period(marks(t), F.add_months(end, -36), end)).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    g = r.select(*ACCOUNT, F.when(F.col("pos") <= 5, 1).when(F.col("pos") > F.col("n") - 5, -1).alias("side")).where("side is not null")
    s = mdaily(t).join(g, [*ACCOUNT]).groupBy("symbol", "date").agg(F.sum(F.when(F.col("side") == 1, net())).alias("up"), F.sum(F.when(F.col("side") == -1, net())).alias("down")).where("up * down < 0")
    j = s.join(se.forward_returns(t.prices, (5,)), ["symbol", "date"])
    return j.groupBy("symbol").agg(F.count("*").alias("n"), rd(F.avg("ret_bps")).alias("mean_bps"))


# ---------------------------------------------------------------- statistics

_T = "r * sqrt((n - 2) / (1 - r * r))"
_STRENGTH = "case when abs(r) >= 0.7 then 'strong' when abs(r) >= 0.4 then 'moderate' when abs(r) >= 0.2 then 'weak' else 'none' end"
_PAIRS = [("Brand#11", "Brand#12"), ("Brand#11", "Brand#21"), ("Brand#12", "Brand#33"), ("Brand#22", "Brand#44"), ("Brand#31", "Brand#55")]


@query("rets", f""", b as (select *, lag(ret, 1) over (partition by symbol order by date) prev from rets), c as (select s1, s2, corr(x.ret, y.prev) r, count(*) n from (values {", ".join(map(str, _PAIRS))}) v(s1, s2) join rets x on x.symbol = s1 join b y on y.symbol = s2 and y.date = x.date where prev is not null group by all having count(*) >= 10)
    select s1, s2, round(r, 6) r, n, round({_T}, 5) t, round({stats.erfc_sql(f'(abs({_T})/sqrt(2.0))')}, 5) p, {_STRENGTH} strength from c""")
def f13_k14_lead_lag(t):
    """Correlation of one symbol's return with another's a day earlier, for a table of pairs."""
    pairs = t.spark.createDataFrame(_PAIRS, "s1 string, s2 string")
    x = t.rets.select(F.col("symbol").alias("s1"), "date", "ret").join(F.broadcast(pairs), "s1")
    y = t.rets.select(F.col("symbol").alias("s2"), "date", F.lag("ret").over(se.by_symbol()).alias("prev")).where("prev is not null")
    c = x.join(y, ["s2", "date"]).groupBy("s1", "s2").agg(F.corr("ret", "prev").alias("r"), F.count("*").alias("n")).where("n >= 10").withColumn("t", F.expr(_T))
    return c.select("s1", "s2", rd("r", 6).alias("r"), "n", rd("t", 5).alias("t"), rd(stats.normal_p(F.col("t")), 5).alias("p"), F.expr(_STRENGTH).alias("strength"))


def _rank_sql(c: str) -> str:
    return f"rank() over (partition by symbol order by {c}) + (count(*) over (partition by symbol, {c}) - 1) / 2.0"


_SPEAR = f""", e as ({_MEVENTS}), f as ({_FWD5}), x as (select e.symbol, signal_value v, signal_count z, floor(direction * ret * 1e4 + 0.5) y from e join f on f.symbol = e.symbol and f.date = e.date where ret is not null),
    k as (select symbol, {_rank_sql("v")} rv, {_rank_sql("y")} ry, {_rank_sql("z")} rz from x), s as (select symbol, count(*) n, sum((rv - ry) * (rv - ry)) a, sum((rv - rz) * (rv - rz)) b, sum((ry - rz) * (ry - rz)) c from k group by 1),
    q as (select symbol, n, 1 - 6 * a / (n * (n * n - 1.0)) xy, 1 - 6 * b / (n * (n * n - 1.0)) xz, 1 - 6 * c / (n * (n * n - 1.0)) yz from s where n >= 3)
    select symbol, n, round(xy, 6) rho, round(case when (1 - xz * xz) * (1 - yz * yz) > 1e-12 then (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) else 0 end, 6) partial_rho from q"""


@query("mlarge prices", _SPEAR)
def k16_k17_spearman(t):
    """Rank correlation of event strength with the adjusted return, and the same with the number of brokers held fixed."""
    e = ev.large_trade_events(ev.large_trades(mdaily(t))).join(se.forward_returns(t.prices, (5,)), ["symbol", "date"])
    x = e.select("symbol", F.col("signal_value").alias("v"), F.col("signal_count").alias("z"), F.floor(F.col("direction") * F.col("ret_bps") * 1e4 + 0.5).alias("y"))
    rank = lambda c: F.rank().over(W.partitionBy("symbol").orderBy(c)) + (F.count("*").over(W.partitionBy("symbol", c)) - 1) / 2.0
    k = x.select("symbol", rank("v").alias("rv"), rank("y").alias("ry"), rank("z").alias("rz"))
    gap = lambda a, b: F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b)))
    s = k.groupBy("symbol").agg(F.count("*").alias("n"), gap("rv", "ry").alias("a"), gap("rv", "rz").alias("b"), gap("ry", "rz").alias("c")).where("n >= 3")
    q = s.select("symbol", "n", *[F.expr(f"1 - 6 * {c} / (n * (n * n - 1.0D))").alias(name) for c, name in (("a", "xy"), ("b", "xz"), ("c", "yz"))])
    part = F.expr("case when (1 - xz * xz) * (1 - yz * yz) > 1e-12 then (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) else 0 end")
    return q.select("symbol", "n", rd("xy", 6).alias("rho"), rd(part, 6).alias("partial_rho"))


PERMUTATIONS = 40


@query("mlarge prices", f""", e as ({_MEVENTS}), f as ({_FWD5}), x as (select f.symbol, f.date, floor(ret * 1e4 + 0.5) y, e.date is not null is_event from f left join e on e.symbol = f.symbol and e.date = f.date where ret is not null),
    n as (select symbol, count(*) filter (is_event) n, abs(avg(y) filter (is_event)) observed from x group by 1 having count(*) filter (is_event) >= 3),
    s as (select x.symbol, i, y, row_number() over (partition by x.symbol, i order by md5(concat('7|', i, '|', x.symbol, '|', x.date))) k from x cross join (select unnest(range({PERMUTATIONS})) i) semi join n using (symbol)),
    m as (select symbol, i, n, observed, abs(avg(y)) shuffled from s join n using (symbol) where k <= n group by all)
    select symbol, n, round(observed / 1e4, 4) observed_bps, count(*) filter (shuffled >= observed - 1e-6) as extreme, round(avg(cast(shuffled >= observed - 1e-6 as int)), 6) p from m group by all""")
def k8_permutation(t):
    """How often as many dates drawn without replacement have a mean return as far from 0 as the event dates; the order of a draw is a hash of seed, draw and date."""
    e = ev.large_trade_events(ev.large_trades(mdaily(t))).select("symbol", "date", F.lit(True).alias("is_event"))
    x = se.forward_returns(t.prices, (5,)).join(e, ["symbol", "date"], "left").select("symbol", "date", F.floor(F.col("ret_bps") * 1e4 + 0.5).alias("y"), F.coalesce("is_event", F.lit(False)).alias("is_event"))
    n = x.groupBy("symbol").agg(F.count_if("is_event").alias("n"), F.abs(F.avg(F.when(F.col("is_event"), F.col("y")))).alias("observed")).where("n >= 3")
    s = x.join(n, "symbol").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1))))
    order = F.md5(F.concat(F.lit("7|"), F.col("i").cast("string"), F.lit("|"), "symbol", F.lit("|"), F.col("date").cast("string")).cast("binary"))
    s = s.withColumn("k", F.row_number().over(W.partitionBy("symbol", "i").orderBy(order))).where("k <= n")
    m = s.groupBy("symbol", "i", "n", "observed").agg(F.abs(F.avg("y")).alias("shuffled"))
    far = F.col("shuffled") >= F.col("observed") - 1e-6
    return m.groupBy("symbol", "n", "observed").agg(F.count_if(far).alias("extreme"), rd(F.avg(far.cast("int")), 6).alias("p")).select("symbol", "n", rd(F.col("observed") / 1e4).alias("observed_bps"), "extreme", "p")


# ---------------------------------------------------------------- signals and returns

@query("rets", """, e as (select symbol, date, ret, exp(sum(ln(greatest(1 + ret, 1e-12))) over (partition by symbol order by date)) eq from rets), d as (select *, greatest(max(eq) over (partition by symbol order by date), 1.0) peak from e)
    select symbol, round(arg_max(eq, date) - 1, 6) total_return, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 5) sharpe, round(min(eq / peak - 1), 6) max_drawdown, round((arg_max(eq, date) - 1) / nullif(abs(min(eq / peak - 1)), 0), 5) calmar from d group by 1""")
def m7_m8_buy_and_hold(t):
    """Equity of holding a symbol: total return, Sharpe ratio (population deviation), largest fall from a peak (1.0 at the start counts) and their ratio. A loss of everything leaves 1e-12 of the equity."""
    w = se.by_symbol().rowsBetween(W.unboundedPreceding, 0)
    e = t.rets.withColumn("eq", F.exp(F.sum(F.log(F.greatest(1 + F.col("ret"), F.lit(1e-12)))).over(w))).withColumn("peak", F.greatest(F.max("eq").over(w), F.lit(1.0)))
    total, fall = F.max_by("eq", "date") - 1, F.min(F.col("eq") / F.col("peak") - 1)
    return e.groupBy("symbol").agg(rd(total, 6).alias("total_return"), rd(F.try_divide(F.avg("ret"), F.stddev_pop("ret")) * F.sqrt(F.lit(252.0)), 5).alias("sharpe"), rd(fall, 6).alias("max_drawdown"), rd(F.try_divide(total, F.abs(fall)), 5).alias("calmar"))


@query("rets", "select symbol, strftime(date, '%Y-%m') as month, round((exp(sum(ln(greatest(1 + ret, 1e-12)))) - 1) * 100, 2) ret_pct from rets group by all")
def m9_monthly(t):
    return t.rets.groupBy("symbol", F.date_format("date", "yyyy-MM").alias("month")).agg(rd((F.exp(F.sum(F.log(F.greatest(1 + F.col("ret"), F.lit(1e-12))))) - 1) * 100, 2).alias("ret_pct"))


@query("daily prices", f"select symbol, round(avg(v), 2) traded_value, avg(v) >= 1e5 liquid from (select d.symbol, d.date, sum(buy_shares) * max(\"close\") v from daily d join prices p on p.symbol = d.symbol and p.date = d.date where d.date <= date '{TRAIN_END}' group by all) group by 1")
def m4_liquidity(t):
    v = t.daily.where(F.col("date") <= day(TRAIN_END)).join(t.prices.select("symbol", "date", "close"), ["symbol", "date"]).groupBy("symbol", "date").agg((F.sum("buy_shares") * F.max("close")).alias("v"))
    return v.groupBy("symbol").agg(rd(F.avg("v"), 2).alias("traded_value"), (F.avg("v") >= 1e5).alias("liquid"))


@query("mlarge prices", f", e as ({_MEVENTS}), n as (select symbol, date, lead(date) over (partition by symbol order by date) nx from prices where date >= date '{TEST_START}') select nx date, e.symbol, case when direction > 0 then 'long' else 'short' end direction, cast(signal_value as bigint) signal_value from e join n on n.symbol = e.symbol and n.date = e.date where nx is not null")
def m11_b14_signal_export(t):
    n = t.prices.where(F.col("date") >= day(TEST_START)).select("symbol", "date", F.lead("date").over(se.by_symbol()).alias("nx"))
    e = ev.large_trade_events(ev.large_trades(mdaily(t))).join(n, ["symbol", "date"]).where("nx is not null")
    return e.select(F.col("nx").alias("date"), "symbol", F.when(F.col("direction") > 0, "long").otherwise("short").alias("direction"), "signal_value")


# ---------------------------------------------------------------- profiles and episodes


@query("mdaily rets", """, g as (select r.symbol, r.date, ret, lag(r.date) over w prev_date, lag(ret) over w prev_ret from rets r window w as (partition by symbol order by date)), a as (select distinct symbol, broker from mdaily),
    x as (select a.symbol, a.broker, g.ret, g.prev_ret, coalesce(y.buy_shares - y.sell_shares, 0) nb_prev, coalesce(z.buy_shares - z.sell_shares, 0) nb from a join g using (symbol) left join mdaily y on y.symbol = a.symbol and y.broker = a.broker and y.date = g.prev_date left join mdaily z on z.symbol = a.symbol and z.broker = a.broker and z.date = g.date where prev_date is not null),
    c as (select symbol, broker, case when stddev_pop(nb_prev) > 0 then corr(nb_prev, ret) end lead_corr, case when stddev_pop(nb) > 0 then corr(nb, prev_ret) end lag_corr, count(*) n from x group by all)
    select symbol, broker, n, round(lead_corr, 5) lead_corr, round(lag_corr, 5) lag_corr, case when lead_corr > 0.05 then 'leads' when lead_corr < -0.05 then 'contrarian' else 'neutral' end style from c""")
def n3_lead_lag_corr(t):
    """Correlation of a broker's net buying with the next and the previous return over all dates of the symbol, days without trades counting 0: sums over traded days and totals of the symbol give it without a dense grid."""
    c = so.lead_lag(mdaily(t), t.rets)
    style = F.when(F.col("lead_corr") > 0.05, "leads").when(F.col("lead_corr") < -0.05, "contrarian").otherwise("neutral")
    return c.select(*ACCOUNT, "n", rd("lead_corr", 5).alias("lead_corr"), rd("lag_corr", 5).alias("lag_corr"), style.alias("style"))


_MATCHES = """, o as (select b.symbol, b.broker, least(b.b, s.s) - greatest(b.b - b.buy_shares, s.s - s.sell_shares) shares, b.date buy_date, s.date sell_date, b.buy_amount / b.buy_shares buy_price, s.sell_amount / s.sell_shares sell_price
    from mcum b join mcum s on b.symbol = s.symbol and b.broker = s.broker and b.b - b.buy_shares < s.s and s.s - s.sell_shares < b.b where b.buy_shares > 0 and s.sell_shares > 0),
    c as (select *, buy_date < sell_date is_long, least(buy_date, sell_date) opened, greatest(buy_date, sell_date) closed from o)"""


def closed_trades(t):
    from flowlens.operators import fifo as ff

    m = ff.matches(mdaily(t)).withColumn("is_long", F.col("buy_date") < F.col("sell_date"))
    return m.withColumn("opened", F.least("buy_date", "sell_date")).withColumn("closed", F.greatest("buy_date", "sell_date"))


@query("mcum", f"{_MATCHES} select symbol, broker, opened, closed, cast(sum(shares) as bigint) shares, round(sum(shares * (sell_price - buy_price)), 3) pnl, cast(date_diff('day', opened, closed) as int) holding_days, opened = closed day_trade, sum(shares * (sell_price - buy_price)) > 1e-6 profitable from c group by symbol, broker, opened, closed, is_long".replace("select symbol, broker, opened", "select symbol, broker, is_long, opened"))
def d13_u9_trade_attributes(t):
    pnl = F.sum(F.col("shares") * (F.col("sell_price") - F.col("buy_price")))
    g = closed_trades(t).groupBy(*ACCOUNT, "is_long", "opened", "closed").agg(F.sum("shares").alias("shares"), pnl.alias("raw"))
    return g.select(*ACCOUNT, "is_long", "opened", "closed", "shares", rd("raw", 3).alias("pnl"), F.datediff("closed", "opened").alias("holding_days"), (F.col("opened") == F.col("closed")).alias("day_trade"), (F.col("raw") > 1e-6).alias("profitable"))


@query("mcum prices", f"""{_MATCHES}, x as (select c.*, case when is_long then sell_price / buy_price - 1 else 1 - buy_price / sell_price end trade, case when is_long then 1 else -1 end * (q."close" / p."close" - 1) bench, shares * case when is_long then buy_price else sell_price end value
    from c join prices p on p.symbol = c.symbol and p.date = opened join prices q on q.symbol = c.symbol and q.date = closed)
    select broker, count(*) n_trades, cast(sum(shares) as bigint) shares, round(sum((trade - bench) * value) / sum(value), 6) execution_alpha, round(sum((trade - bench) * value), 2) alpha_amount from x group by 1""".replace("count(*) n_trades, ", ""))
def n1_execution_alpha(t):
    """Return of each closed trade less that of closes over the same days, weighted by the value opened."""
    p = t.prices.select("symbol", "date", "close")
    c = closed_trades(t).join(p.select("symbol", F.col("date").alias("opened"), F.col("close").alias("c0")), ["symbol", "opened"]).join(p.select("symbol", F.col("date").alias("closed"), F.col("close").alias("c1")), ["symbol", "closed"])
    trade = F.when(F.col("is_long"), F.col("sell_price") / F.col("buy_price") - 1).otherwise(1 - F.col("buy_price") / F.col("sell_price"))
    gap = trade - F.when(F.col("is_long"), 1).otherwise(-1) * (F.col("c1") / F.col("c0") - 1)
    value = F.col("shares") * F.when(F.col("is_long"), F.col("buy_price")).otherwise(F.col("sell_price"))
    return c.groupBy("broker").agg(F.sum("shares").alias("shares"), rd(F.sum(gap * value) / F.sum(value), 6).alias("execution_alpha"), rd(F.sum(gap * value), 2).alias("alpha_amount"))


@query("cum", "select side, count(*) n, count(*) filter (shares <= 0) bad_shares, count(*) filter (cost <= 0) bad_cost from (select 'long' side, b - greatest(b - buy_shares, mt) shares, buy_amount / buy_shares as cost from (select *, least(max(b) over w, max(s) over w) mt from cum window w as (partition by symbol, broker)) where buy_shares > 0 and b > mt union all select 'short', s - greatest(s - sell_shares, mt), sell_amount / sell_shares from (select *, least(max(b) over w, max(s) over w) mt from cum window w as (partition by symbol, broker)) where sell_shares > 0 and s > mt) group by 1")
def u5_lot_invariants(t):
    from flowlens.operators import fifo as ff

    return ff.open_lots(t.daily).groupBy("side").agg(F.count("*").alias("n"), F.count_if(F.col("shares") <= 0).alias("bad_shares"), F.count_if(F.col("cost_per_share") <= 0).alias("bad_cost"))


@query("daily", """select broker, min(date) first_trade, max(date) last_trade, count(distinct date) active_days, round(count(distinct date) / (date_diff('day', min(date), max(date)) + 1.0), 6) frequency,
    count(distinct date_trunc('month', date)) active_months, max(buy_months) net_buy_months, max(sell_months) net_sell_months, case when max(buy_months) > 2 * max(sell_months) then 'buying' when max(sell_months) > 2 * max(buy_months) then 'selling' else 'both ways' end trend from daily join (select broker, count(*) filter (net > 0) buy_months, count(*) filter (net < 0) sell_months from (select broker, date_trunc('month', date) mo, sum(buy_shares - sell_shares) net from daily group by all) group by 1) using (broker) group by 1""")
def n8_activity(t):
    d = t.daily
    b = d.groupBy("broker", F.trunc("date", "month").alias("mo")).agg(F.sum(net()).alias("net")).groupBy("broker").agg(F.count_if(F.col("net") > 0).alias("net_buy_months"), F.count_if(F.col("net") < 0).alias("net_sell_months"), F.count("*").alias("active_months"))
    b = b.withColumn("trend", F.when(F.col("net_buy_months") > 2 * F.col("net_sell_months"), "buying").when(F.col("net_sell_months") > 2 * F.col("net_buy_months"), "selling").otherwise("both ways"))
    a = d.groupBy("broker").agg(F.min("date").alias("first_trade"), F.max("date").alias("last_trade"), F.count_distinct("date").alias("active_days"))
    return a.join(b, "broker").withColumn("frequency", rd(F.col("active_days") / (F.datediff("last_trade", "first_trade") + 1.0), 6))


@query("prices", """, f as (select cast(o_orderdate as date) date, count(*) flags from orders where o_orderpriority = '1-URGENT' group by 1), m as (select cast(o_orderdate as date) date, sum(o_totalprice) margin from orders group by 1)
    select symbol, p.date, round("close", 4) "close", coalesce(flags, 0) flags, round(margin, 2) margin from prices p left join f on f.date = p.date left join m on m.date = p.date""")
def o1_context(t):
    o = t.raw("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("flags"), F.sum("o_totalprice").alias("margin"))
    return t.prices.select("symbol", "date", rd("close").alias("close")).join(o, "date", "left").select("symbol", "date", "close", F.coalesce("flags", F.lit(0)).cast("long").alias("flags"), rd("margin", 2).alias("margin"))


@query("ticks", "select a.event_id, count(b.event_id) n, round(max(b.price), 6) high, round(min(b.price), 6) low, round(arg_min(b.price, epoch_us(b.ts) * 1000 + b.event_id % 1000), 6) first, round(arg_max(b.price, epoch_us(b.ts) * 1000 + b.event_id % 1000), 6) last, round(stddev_samp(b.price), 6) std from ticks a left join ticks b on b.symbol = 'click' and b.ts > a.ts - interval 20 minute and b.ts < a.ts where a.symbol = 'purchase' group by 1")
def o2_window_before(t):
    """Clicks in the 20 minutes before each purchase: both are laid out over buckets of 20 minutes, a purchase over its own and the one before, so that an equi-join meets them."""
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = 20 * 60 * 1_000_000
    a = t.ticks.where("symbol = 'purchase'").select("event_id", sec("ts").alias("at"))
    wide = a.withColumn("bucket", F.explode(F.array(F.floor(F.col("at") / width), F.floor(F.col("at") / width) - 1)))
    b = t.ticks.where("symbol = 'click'").select(sec("ts").alias("t"), "price", F.col("event_id").alias("tick")).withColumn("bucket", F.floor(F.col("t") / width))
    order = F.col("t") * 1000 + F.col("tick") % 1000
    g = wide.join(b, "bucket").where((F.col("t") > F.col("at") - width) & (F.col("t") < F.col("at"))).groupBy("event_id").agg(F.count("*").alias("n"), rd(F.max("price"), 6).alias("high"), rd(F.min("price"), 6).alias("low"), rd(F.min_by("price", order), 6).alias("first"), rd(F.max_by("price", order), 6).alias("last"), rd(F.stddev_samp("price"), 6).alias("std"))
    return a.select("event_id").join(g, "event_id", "left").na.fill(0, ["n"])


@query("ticks", "select symbol, cast(ts as date) date, count(*) n, round(max(price), 6) high, round(min(price), 6) low, round(arg_min(price, epoch_us(ts) * 1000 + event_id % 1000), 6) open, round(arg_max(price, epoch_us(ts) * 1000 + event_id % 1000), 6) \"close\" from ticks group by all")
def o4_tick_days(t):
    key = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    return t.ticks.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), rd(F.max("price"), 6).alias("high"), rd(F.min("price"), 6).alias("low"), rd(F.min_by("price", key), 6).alias("open"), rd(F.max_by("price", key), 6).alias("close"))


@query("ticks", "select a.event_id, round(b.price, 6) last_price from ticks a asof join (select symbol, ts, max(price) price from ticks where symbol = 'click' group by all) b on a.ts >= b.ts where a.symbol = 'purchase'")
def o3_as_of_quote(t):
    """Latest click at or before each purchase, hour by hour; an hour without an earlier click of its own takes the last of the hours before, carried over one row an hour."""
    tk = t.ticks.withColumn("hour", F.date_trunc("hour", "ts"))
    quotes = tk.where("symbol = 'click'").groupBy("hour", "ts").agg(F.max("price").alias("last_price"))
    asked = tk.where("symbol = 'purchase'").select("hour", "ts", "event_id")
    ends = quotes.groupBy("hour").agg(F.max_by("last_price", "ts").alias("final"))
    hours = asked.select("hour").union(quotes.select("hour")).distinct().join(ends, "hour", "left").withColumn("one", F.lit(1))
    before = hours.select("hour", F.last("final", ignorenulls=True).over(W.partitionBy("one").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    found = se.as_of(asked, quotes, ("hour",), "ts", "last_price").join(before, "hour", "left").withColumn("last_price", F.coalesce("last_price", "before"))
    return found.where("last_price is not null").select("event_id", rd("last_price", 6).alias("last_price"))


_D = "date '1998-06-01'"


@query("daily", f"select symbol, broker, min(case when date >= {_D} - interval 6 month and date < {_D} then 0 else 1 end) = 0 veteran, cast(sum(case when date >= {_D} then buy_shares - sell_shares else 0 end) as bigint) net from daily where date >= {_D} - interval 6 month group by all having count(*) filter (date >= {_D}) > 0")
def o7_veterans(t):
    cut = day("1998-06-01")
    d = t.daily.where(F.col("date") >= F.add_months(cut, -6))
    g = d.groupBy(*ACCOUNT).agg(F.bool_or(F.col("date") < cut).alias("veteran"), F.sum(F.when(F.col("date") >= cut, net()).otherwise(0)).alias("net"), F.count_if(F.col("date") >= cut).alias("n"))
    return g.where("n > 0").drop("n")


@query("marks mdaily", f""", r as (select *, count(*) over (partition by symbol) n from {_pos(f"(date '{TRAIN_END}' - interval 36 month)", f"date '{TRAIN_END}'")}) select d.symbol, d.date, case when pos <= 5 then 'top' when pos > n - 5 then 'bottom' else 'other' end tier, cast(sum(buy_shares - sell_shares) as bigint) net
    from mdaily d left join r on r.symbol = d.symbol and r.broker = d.broker where d.date >= date '{TEST_START}' group by all""")
def o8_tier_flow(t):
    end = day(TRAIN_END)
    r = ho.ranked(ho.period(marks(t), F.add_months(end, -36), end)).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    tier = F.when(F.col("pos") <= 5, "top").when(F.col("pos") > F.col("n") - 5, "bottom").otherwise("other")
    d = mdaily(t).where(F.col("date") >= day(TEST_START)).join(r.select(*ACCOUNT, "pos", "n"), [*ACCOUNT], "left")
    return d.groupBy("symbol", "date", tier.alias("tier")).agg(F.sum(net()).alias("net"))


# ---------------------------------------------------------------- data quality


@query("marks", f"select 'brokers' as \"check\", count(*) as value, count(*) >= 20 passed from {_WHOLE} union all select 'symbols', count(distinct symbol), count(distinct symbol) >= 20 from marks union all select 'zero_sum_bp', cast(floor(10000 * abs(sum(total_pnl)) / sum(abs(total_pnl))) as bigint), abs(sum(total_pnl)) / sum(abs(total_pnl)) < 0.05 from {_WHOLE}")
def u1_verify(t):
    m = marks(t)
    r = whole(t, m)
    ratio = F.abs(F.sum("total_pnl")) / F.sum(F.abs("total_pnl"))
    one = lambda name, value, ok: (F.lit(name).alias("check"), value.cast("long").alias("value"), ok.alias("passed"))
    return r.agg(*one("brokers", F.count("*"), F.count("*") >= 20)).union(m.agg(*one("symbols", F.count_distinct("symbol"), F.count_distinct("symbol") >= 20))).union(r.agg(*one("zero_sum_bp", F.floor(10000 * ratio), ratio < 0.05)))


@query("daily", "select count(*) n_rows, count(*) - count(distinct (symbol, broker, date)) repeated, count(*) filter (dayofweek(date) in (0, 6)) weekend_rows, (select count(*) from (select symbol, date, lead(date) over (partition by symbol order by date) nx from (select distinct symbol, date from daily)) where date_diff('day', date, nx) > 7) long_gaps from daily")
def u6_calendar(t):
    d = t.daily
    gaps = d.select("symbol", "date").distinct().withColumn("nx", F.lead("date").over(se.by_symbol())).agg(F.count_if(F.datediff("nx", "date") > 7).alias("long_gaps"))
    return d.agg(F.count("*").alias("n_rows"), (F.count("*") - F.count_distinct("symbol", "broker", "date")).alias("repeated"), F.count_if(F.dayofweek("date").isin(1, 7)).alias("weekend_rows")).crossJoin(gaps)


@query("state", "select count(*) n, count(*) filter (b is null) only_first, count(*) filter (a is null) only_second, count(*) filter (abs(a - b) > 1e-4 * greatest(abs(a), 1)) differ from (select broker, sum(total_pnl) a from state group by 1) x full join (select broker, sum(realized_pnl + unrealized_pnl) b from state where broker <> 'S3' group by 1) y using (broker)")
def u8_report_diff(t):
    s = t.state
    x = s.groupBy("broker").agg(F.sum("total_pnl").alias("a"))
    y = s.where("broker <> 'S3'").groupBy("broker").agg(F.sum(F.col("realized_pnl") + F.col("unrealized_pnl")).alias("b"))
    return x.join(y, "broker", "full").agg(F.count("*").alias("n"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.abs(F.col("a") - F.col("b")) > 1e-4 * F.greatest(F.abs("a"), F.lit(1.0))).alias("differ"))


@query("mcum", f"""{_MATCHES} select cast(count(*) as bigint) n, count(*) filter (shares <= 0) bad_shares, count(*) filter (buy_price < 0 or sell_price < 0 or isnan(buy_price) or isnan(sell_price)) bad_price, count(*) filter (symbol = '' or broker = '' or symbol is null or broker is null) no_account,
    count(*) filter (buy_date is null or sell_date is null) no_date, count(*) filter (is_long is null) no_side from c""")
def u9_trade_constraints(t):
    """How many closed trades break a rule of their fields."""
    c = closed_trades(t)
    empty = lambda x: F.col(x).isNull() | (F.col(x) == "")
    bad = lambda x: (F.col(x) < 0) | F.isnan(x)
    return c.agg(F.count("*").alias("n"), F.count_if(F.col("shares") <= 0).alias("bad_shares"), F.count_if(bad("buy_price") | bad("sell_price")).alias("bad_price"), F.count_if(empty("symbol") | empty("broker")).alias("no_account"),
        F.count_if(F.col("buy_date").isNull() | F.col("sell_date").isNull()).alias("no_date"), F.count_if(F.col("is_long").isNull()).alias("no_side"))


@query("daily", """, cal as (select date, row_number() over (order by date) i from (select distinct cast(o_orderdate as date) date from orders)), sd as (select distinct symbol, date from daily),
    sp as (select symbol, min(date) a, max(date) b, count(*) as days, count(*) filter (date not in (select date from cal)) outside from sd group by 1),
    mi as (select sp.symbol, count(*) missing from sp join cal on cal.date between a and b left join sd on sd.symbol = sp.symbol and sd.date = cal.date where sd.date is null group by 1)
    select sp.symbol, days, outside, coalesce(missing, 0) missing from sp left join mi using (symbol)""")
def u6_against_calendar(t):
    """Each symbol's days against a calendar (days with an order): days outside it by an anti join, and calendar days without a row between the first and the last.

    The missing are counted from the days' numbers in the calendar, a list of days; no grid of symbols by days is made.
    """
    cal = t.raw("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    cal = cal.select("date", F.row_number().over(W.orderBy("date")).alias("i"))
    days = t.daily.select("symbol", "date").distinct()
    span = days.groupBy("symbol").agg(F.count("*").alias("days"), F.min("date").alias("a"), F.max("date").alias("b"))
    outside = days.join(cal, "date", "left_anti").groupBy("symbol").agg(F.count("*").alias("outside"))
    # the first day of the calendar from a on, and the last up to b: a symbol's own ends need not be in it
    ends = span.select("symbol", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("a").alias("date")), F.struct(F.lit(1).alias("end"), F.col("b").alias("date")))).alias("e")).select("symbol", "e.end", "e.date")
    asked = ends.select("date").distinct().unionByName(cal.withColumn("known", F.lit(True)), allowMissingColumns=True).groupBy("date").agg(F.max("i").alias("i"))
    before = asked.select("date", F.coalesce(F.max("i").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)), F.lit(0)).alias("upto"), F.col("i").isNotNull().cast("int").alias("inside"))
    at = ends.join(before, "date").groupBy("symbol").agg((F.max(F.when(F.col("end") == 1, F.col("upto"))) - F.max(F.when(F.col("end") == 0, F.col("upto") - F.col("inside")))).alias("expected"))
    x = span.join(outside, "symbol", "left").na.fill(0, ["outside"]).join(at, "symbol")
    return x.select("symbol", "days", "outside", (F.col("expected") - (F.col("days") - F.col("outside"))).cast("long").alias("missing"))


@query("mlarge", f"select symbol, broker, strftime(date, '%Y-%m-%d') as day_text, case when direction > 0 then 'long' else 'short' end side, cast(direction as int) sign from ({_MEVENTS})".replace("select symbol, broker, strftime", "select symbol, strftime"))
def b14_both_ways(t):
    """Directions as words and back, dates as text."""
    e = ev.large_trade_events(ev.large_trades(mdaily(t))).withColumn("side", F.when(F.col("direction") > 0, "long").otherwise("short"))
    return e.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("day_text"), "side", F.when(F.col("side") == "long", 1).when(F.col("side") == "short", -1).alias("sign"))

"""Daily marks of open positions, profit over periods, and the rankings and broker selectors built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators import fifo as ff

ACCOUNT = ("symbol", "broker")


def chosen(df: DataFrame, selected: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of selected accounts; with `by` (say, a run) once for each of its values that selects the account, which they then carry."""
    return df.join(selected.select(*by, *ACCOUNT), [*ACCOUNT], "inner" if by else "left_semi")


def remapped(prints: DataFrame, mapping: DataFrame) -> DataFrame:
    """Prints with broker codes replaced by `mapping` (broker, merged); codes without an entry stay. Aggregate anew afterwards."""
    return prints.join(mapping, "broker", "left").withColumn("broker", F.coalesce("merged", "broker")).drop("merged")


def daily_marks(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """Every account on every trade date of its symbol from its first trade on: profit realised that day and the mark of what it holds.

    A trade day's position holds until the account's next trade day. It is laid out over date numbers, so that closes come by an
    equi-join on (symbol, number) and the work grows with the rows put out. Days on which both figures are 0 have no row.
    """
    by_date, account = W.partitionBy("symbol").orderBy("date"), W.partitionBy(*ACCOUNT).orderBy("date")
    days = prices.select("symbol", "date", "close").withColumn("day", F.row_number().over(by_date))
    last = days.groupBy("symbol").agg(F.max("day").alias("last_day"))
    p = ff.positions(daily).join(days.select("symbol", "date", "day"), ["symbol", "date"]).join(last, "symbol")
    p = p.withColumn("today", F.col("realized_total") - F.coalesce(F.lag("realized_total").over(account), F.lit(0.0)))
    p = p.withColumn("until", F.coalesce(F.lead("day").over(account) - 1, "last_day"))
    held = p.drop("date").withColumnRenamed("day", "first").withColumn("day", F.explode(F.sequence("first", "until")))
    at = held.join(days, ["symbol", "day"]).withColumn("traded", F.col("day") == F.col("first"))
    only = lambda c: F.when(F.col("traded"), F.col(c)).otherwise(F.lit(0))
    out = at.select(
        *ACCOUNT, "date", only("today").cast("double").alias("realized_pnl"), ff.unrealized(F.col("close")).alias("unrealized_pnl"), (F.col("b") - F.col("s")).alias("net"), "close",
        *[only(c).alias(c) for c in ("buy_shares", "sell_shares", "buy_amount", "sell_amount")],
    )
    return out.where((F.abs("realized_pnl") > 1e-6) | (F.abs("unrealized_pnl") > 1e-6))


def period(marks: DataFrame, start: Column, end: Column, baseline: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Profit of each account within [start, end]: realised then, and the last mark in it less the last mark before it (no mark before: 0; baseline False: not taken off).

    start and end may be columns that depend on `by`, so that many periods are one plan.
    """
    inside, before = F.col("date").between(start, end), F.col("date") < start
    at = lambda cond: F.coalesce(F.max_by(F.when(cond, F.col("unrealized_pnl")), F.when(cond, F.col("date"))), F.lit(0.0))
    sums = marks.where(F.col("date") <= end).groupBy(*by, *ACCOUNT).agg(F.sum(F.when(inside, F.col("realized_pnl"))).alias("realized_pnl"), at(inside).alias("last"), at(before).alias("base"), F.count_if(inside).alias("days"))
    open_pnl = F.col("last") - F.col("base") if baseline else F.col("last")
    return sums.where("days > 0").select(*by, *ACCOUNT, "realized_pnl", open_pnl.alias("unrealized_pnl"), (F.col("realized_pnl") + open_pnl).alias("total_pnl"))


def _cents(c: str) -> Column:
    return F.floor(F.col(c) * 100 + 0.500001)


def ranked(pnl: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """pos: place of each broker by total_pnl within keys, ties by broker."""
    return pnl.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(_cents("total_pnl")), "broker")))


def market(pnl: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums over symbols and the market-wide place of each broker. The window runs over one row a broker."""
    s = pnl.groupBy(*by, "broker").agg(*[F.sum(c).alias(c) for c in ("realized_pnl", "unrealized_pnl", "total_pnl")])
    return s.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(_cents("total_pnl")), "broker")))


def rank_momentum(marks: DataFrame, end: Column, earlier: Column, years: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Places gained within a symbol between two dates; a broker without a place at the earlier date counts as one behind its last."""
    back, keys = -12 * years, (*by, "symbol")
    now = ranked(period(marks, F.add_months(end, back), end, by=by), keys).select(*by, *ACCOUNT, F.col("pos").alias("now"))
    then = ranked(period(marks, F.add_months(earlier, back), earlier, by=by), keys).select(*by, *ACCOUNT, F.col("pos").alias("then"))
    unseen = then.groupBy(*keys).agg((F.max("then") + 1).alias("unseen"))
    j = now.join(then, [*by, *ACCOUNT], "left").join(unseen, [*keys], "left")
    return j.select(*by, *ACCOUNT, "now", F.coalesce("then", "unseen", F.lit(1)).alias("then")).withColumn("gained", F.col("then") - F.col("now"))


def first_of(df: DataFrame, k: int, order: list[Column], by: tuple[str, ...] = ()) -> DataFrame:
    """The first k rows of each symbol in an order, with their place."""
    return df.withColumn("pos", F.row_number().over(W.partitionBy(*by, "symbol").orderBy(*order))).where(F.col("pos") <= k)


def niche_top(local: DataFrame, overall: DataFrame, contrast: float = 0.3, least_amount: float = 1e9, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """Brokers that stand much higher in a symbol (among those with a profit there) than in the market (among those with enough turnover)."""
    pct = lambda place, n: F.lit(1.0) - F.try_divide(place - 1, n - 1)
    w = W.partitionBy(*by, "symbol")
    here = ranked(local.where("total_pnl > 0"), (*by, "symbol")).withColumn("here", pct(F.col("pos"), F.count("*").over(w)))
    big = overall.where(F.col("total_amount") >= least_amount)
    # one row a broker: the places of the whole market are one window
    big = big.withColumn("all", F.count("*").over(W.partitionBy(*by))).withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(_cents("total_pnl")), "broker")))
    j = here.drop("pos").join(big.select(*by, "broker", pct(F.col("place"), F.col("all")).alias("there")), [*by, "broker"]).withColumn("contrast", F.col("here") - F.col("there")).where(F.col("contrast") >= contrast)
    return first_of(j, k, [F.desc(F.floor(F.col("contrast") * 1e9 + 0.5)), F.col("broker")], by).select(*by, *ACCOUNT, "contrast", "pos")


def churn(daily: DataFrame, selected: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Shares turned over by a set of brokers against their net position change of the day: gross / (|net| + 1)."""
    x = daily if selected is None else daily.join(selected.select(*ACCOUNT), [*ACCOUNT], "left_semi")
    g = x.groupBy(*by, "symbol", "date").agg(F.sum(F.col("buy_shares") + F.col("sell_shares")).alias("gross"), F.abs(F.sum(F.col("buy_shares") - F.col("sell_shares"))).alias("net"))
    return g.withColumn("churn_ratio", F.col("gross") / (F.col("net") + 1))


def adding(marks: DataFrame, selected: DataFrame, brokers: int, profit: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Days on which enough selected brokers hold shares and buy more (of holdings that are up by `profit` of their cost, if given), with the churn of the selected."""
    x = chosen(marks, selected, by)
    up = (F.col("net") > 0) & (F.col("buy_shares") > F.col("sell_shares"))
    if profit is not None:
        cost = F.col("close") - F.try_divide(F.col("unrealized_pnl"), F.col("net"))
        up &= (cost > 0) & (F.try_divide(F.col("unrealized_pnl"), F.col("net") * cost) > profit)
    s = x.where(up).groupBy(*by, "symbol", "date").agg(F.count("*").alias("signal_count"), F.sum("buy_amount").alias("conviction_amount")).where(F.col("signal_count") >= brokers)
    return s.join(churn(x, by=by).select(*by, "symbol", "date", "churn_ratio"), [*by, "symbol", "date"], "left").select(*by, "symbol", "date", F.lit(1).alias("direction"), "signal_count", F.coalesce("churn_ratio", F.lit(1.0)).alias("churn_ratio"), "conviction_amount")


def exits(marks: DataFrame, daily: DataFrame, prices: DataFrame, selected: DataFrame, brokers: int = 5, days: int = 20, kept: float = 0.5, move: float = 0.05, by: tuple[str, ...] = ()) -> DataFrame:
    """Days by which several selected brokers have left or halved a holding within `days` calendar days: against the trend of the last 20 bars, if that is strong.

    Each exit is laid out over the days it counts for, and distinct brokers are counted per day, so that no range join is made.
    """
    account = W.partitionBy(*by, *ACCOUNT).orderBy("date")
    d = chosen(daily, selected, by)
    held = d.withColumn("net", F.sum(F.col("buy_shares") - F.col("sell_shares")).over(account.rowsBetween(W.unboundedPreceding, 0)))
    held = held.withColumn("prev", F.lag("net").over(account))
    out = held.where((F.col("prev") > 0) & ((F.col("net") <= 0) | (F.col("net") < F.col("prev") * kept)))
    keys = [*by, "symbol", "date"]
    spread = out.select(*by, *ACCOUNT, F.explode(F.sequence("date", F.date_add("date", days))).alias("date"))
    n = spread.join(d.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count_distinct("broker").alias("signal_count")).where(F.col("signal_count") >= brokers)
    trend = prices.select("symbol", "date", (F.col("close") / F.lag("close", 20).over(W.partitionBy("symbol").orderBy("date")) - 1).alias("trend"))
    j = n.join(trend, ["symbol", "date"]).withColumn("direction", F.when(F.col("trend") > move, -1).when(F.col("trend") < -move, 1))
    return j.where("direction is not null").select(*keys, "direction", "signal_count")


def panic_buying(daily: DataFrame, prices: DataFrame, selected: DataFrame, drop: float = -0.02, drop3: float = -0.05, brokers: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Days of a sharp fall (one bar or three) on which enough selected brokers are net buyers."""
    w = W.partitionBy("symbol").orderBy("date")
    falls = prices.select("symbol", "date", (F.col("close") / F.lag("close").over(w) - 1).alias("r1"), (F.col("close") / F.lag("close", 3).over(w) - 1).alias("r3")).where(F.col("r3").isNotNull() & ((F.col("r1") < drop) | (F.col("r3") < drop3)))
    buyers = chosen(daily, selected, by).where("buy_shares > sell_shares").groupBy(*by, "symbol", "date").agg(F.count("*").alias("signal_count"))
    return falls.join(buyers.where(F.col("signal_count") >= brokers), ["symbol", "date"]).select(*by, "symbol", "date", F.lit(1).alias("direction"), "signal_count")


def cluster_buying(large: DataFrame, selected: DataFrame, cluster: list[str], at_least: int = 2) -> DataFrame:
    """Days on which brokers trade large in several symbols of a cluster at once: the sign of their summed directions."""
    x = large.where(F.col("symbol").isin(cluster)).join(selected.select(*ACCOUNT), [*ACCOUNT], "left_semi")
    wide = x.groupBy("broker", "date").agg(F.count_distinct("symbol").alias("symbols"), F.sum("direction").alias("total")).where(F.col("symbols") >= at_least)
    s = wide.groupBy("date").agg(F.sum("total").alias("total")).where("total <> 0")
    return s.select("date", F.signum("total").cast("int").alias("direction"), F.abs("total").alias("signal_count"))


def cluster_events(large: DataFrame, selected: DataFrame, cluster: list[str], at_least: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """For each symbol, days on which brokers selected for it trade large in several symbols of a cluster at once: the sign of their summed directions."""
    wide = large.where(F.col("symbol").isin(cluster)).groupBy("broker", "date").agg(F.count_distinct("symbol").alias("symbols"), F.sum("direction").alias("total")).where(F.col("symbols") >= at_least)
    s = wide.join(selected.select(*by, *ACCOUNT), "broker").groupBy(*by, "symbol", "date").agg(F.sum("total").alias("total")).where("total <> 0")
    return s.select(*by, "symbol", "date", F.signum("total").cast("int").alias("direction"), F.abs("total").alias("signal_count"))


def herding(daily: DataFrame, selected: DataFrame, quantile: float = 0.05, crowd: int = 5, days: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Days at either end of the distribution of the crowd's share of net buyers less that of the selected brokers (mean of `days` rows); against the crowd.

    Counts by day and symbol are made once; the selected brokers' share is taken off them, so that the crowd of a run needs no anti join.
    """
    net = F.col("buy_shares") - F.col("sell_shares")
    every = daily.groupBy("symbol", "date").agg(F.count("*").alias("n"), F.count_if(net > 0).alias("up"))
    smart = chosen(daily, selected, by).groupBy(*by, "symbol", "date").agg(F.count("*").alias("sn"), F.count_if(net > 0).alias("su"))
    w, keys = W.partitionBy(*by, "symbol"), (*by, "symbol")
    x = smart.join(every, ["symbol", "date"]).where(F.col("n") - F.col("sn") >= crowd).withColumn("rows", F.count("*").over(w)).where("rows >= 20")
    x = x.withColumn("gap", (F.col("up") - F.col("su")) / (F.col("n") - F.col("sn")) - F.col("su") / F.col("sn"))
    rolled = w.orderBy("date").rowsBetween(-(days - 1), 0)
    x = x.withColumn("index", F.when(F.count("*").over(rolled) == days, F.avg("gap").over(rolled))).where("index is not null").withColumn("rows", F.count("*").over(w)).where("rows >= 20")
    x = x.withColumn("at", F.floor(F.col("index") * 1e9 + 0.5)).withColumn("i", F.row_number().over(w.orderBy("at", "date")) - 1)
    place = lambda q: F.floor(q * (F.col("rows") - 1) + 0.5)
    edge = lambda q: F.max(F.when(F.col("i") == place(q), F.col("at"))).over(w)
    x = x.withColumn("low", edge(quantile)).withColumn("high", edge(1 - quantile)).where("at <= low or at >= high")
    return x.select(*keys, "date", F.when(F.col("at") > 0, -1).otherwise(1).alias("direction"), F.lit(0).cast("long").alias("signal_count"))


def timing_regimes(daily: DataFrame, prices: DataFrame, window: int = 120, threshold: float = 2.0, least: int = 4) -> DataFrame:
    """Accounts whose timing alpha over the last window of bars lies more than `threshold` deviations from that of the windows before: (symbol, broker, z).

    Windows overlap by half and count bars of the symbol. Days without trades are 0: a window's sums come from its traded days, and a window without any has an alpha of 0, so that
    only (account, window) pairs with trades are made. Symbols with fewer than least + 1 windows have none.
    """
    step = window // 2
    order = W.partitionBy("symbol").orderBy("date")
    p = prices.select("symbol", "date", (F.row_number().over(order) - 1).alias("i"), F.count("*").over(W.partitionBy("symbol")).alias("bars"), (F.lead("close").over(order) / F.col("close") - 1).alias("next_ret"))
    p = p.withColumn("windows", F.when(F.col("bars") >= window, F.floor((F.col("bars") - window) / step) + 1).otherwise(0)).where(F.col("windows") > least)
    first = F.greatest(F.ceil((F.col("i") - window + 1) / F.lit(step)), F.lit(0))
    last = F.least(F.floor(F.col("i") / F.lit(step)), F.col("windows") - 1)
    p = p.where(first <= last).withColumn("w", F.explode(F.sequence(first, last)))
    inner = F.when(F.col("i") < F.col("w") * step + window - 1, F.coalesce("next_ret", F.lit(0.0))).otherwise(F.lit(0.0))
    p = p.withColumn("r", inner)
    total = p.groupBy("symbol", "w").agg(F.sum("r").alias("all_ret"))
    net = (F.col("buy_shares") - F.col("sell_shares")).cast("double")
    x = daily.select(*ACCOUNT, "date", net.alias("net")).join(p.select("symbol", "date", "w", "r", "windows"), ["symbol", "date"])
    m = x.groupBy(*ACCOUNT, "w", "windows").agg(F.sum("net").alias("sx"), F.sum(F.col("net") * F.col("net")).alias("sxx"), F.sum(F.col("net") * F.col("r")).alias("cross")).join(total, ["symbol", "w"])
    mean = F.col("sx") / window
    std = F.sqrt(F.greatest(F.col("sxx") / window - mean * mean, F.lit(0.0)))
    m = m.withColumn("ta", F.when(std > 1e-9, (F.col("cross") - mean * F.col("all_ret")) / std).otherwise(F.lit(0.0)))
    is_last = F.col("w") == F.col("windows") - 1
    before = F.when(~is_last, F.col("ta")).otherwise(F.lit(0.0))
    g = m.groupBy(*ACCOUNT, "windows").agg(F.sum(F.when(is_last, F.col("ta")).otherwise(F.lit(0.0))).alias("latest"), F.sum(before).alias("s"), F.sum(before * before).alias("ss"))
    n = F.col("windows") - 1
    spread = F.sqrt(F.greatest(F.col("ss") / n - (F.col("s") / n) * (F.col("s") / n), F.lit(0.0)))
    return g.withColumn("z", F.when(spread > 1e-9, (F.col("latest") - F.col("s") / n) / spread)).where(F.abs("z") > threshold).select(*ACCOUNT, "z")


def scar(large: DataFrame, prices: DataFrame, train_end: Column, horizons: tuple[int, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Standardised returns after large trades: (by, symbol, broker, date, horizon, scar), turned by the trade's direction.

    Drift and deviation of daily returns are those of the symbol up to train_end (30 closes at least), which may depend on `by` columns that `large` carries.
    """
    order = W.partitionBy("symbol").orderBy("date")
    ends = large.select(*by, train_end.alias("train_end")).distinct()
    p = prices.select("symbol", "date", (F.col("close") / F.lag("close").over(order) - 1).alias("ret"))
    fit = p.crossJoin(F.broadcast(ends)).where(F.col("date") <= F.col("train_end")).groupBy(*by, "symbol").agg(F.count("*").alias("n"), F.avg("ret").alias("drift"), F.stddev_samp("ret").alias("vol")).where("n >= 30 and vol > 0")
    wide = prices.select("symbol", "date", "close", *[F.lead("close", h).over(order).alias(f"f{h}") for h in horizons])
    each = wide.where("close > 0").select("symbol", "date", "close", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("to")) for h in horizons])).alias("x")).where("x.to is not null")
    j = large.join(each.select("symbol", "date", "x.horizon", (F.col("x.to") / F.col("close") - 1).alias("raw")), ["symbol", "date"]).join(fit, [*by, "symbol"])
    value = (F.col("raw") - F.col("drift") * F.col("horizon")) / (F.col("vol") * F.sqrt(F.col("horizon"))) * F.col("direction")
    return j.select(*by, *ACCOUNT, "date", "horizon", value.alias("scar"))


def scar_top(scars: DataFrame, k: int = 20, least: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """The k brokers of each symbol with the highest mean of `least` scars or more, with their place."""
    m = scars.groupBy(*by, *ACCOUNT).agg(F.avg("scar").alias("mean_scar"), F.count("*").alias("n")).where(F.col("n") >= least)
    return first_of(m, k, [F.desc(F.floor(F.col("mean_scar") * 1e9 + 0.5)), F.col("broker")], by)


def pooled(scars: DataFrame) -> DataFrame:
    """Standardised returns of all symbols and brokers in one pool a horizon: n, mean, t against 0, p of a standard normal."""
    from flowlens.functions import stats

    g = scars.groupBy("horizon").agg(F.count("*").alias("n"), F.avg("scar").alias("mean_scar"), F.stddev_samp("scar").alias("std"))
    t = F.try_divide(F.col("mean_scar"), F.col("std") / F.sqrt("n"))
    return g.withColumn("t", t).withColumn("p", stats.normal_p(F.col("t")))


def snapshots(marks: DataFrame, dates: DataFrame) -> DataFrame:
    """Profit of each account within (start, at) of every row of `dates` (at, start), as `period` gives it for one: (at, symbol, broker, realized_pnl, unrealized_pnl, total_pnl), with its place in the symbol.

    Running sums of an account answer all dates: each date asks twice, for what stood at its end and for what stood before its start, and one window over marks and questions carries
    the last sums to them. A hundred dates cost a hundred times their answers, not a hundred passes. `dates` is a short list of days and is sent to all.
    """
    run = W.partitionBy(*ACCOUNT).orderBy("date", "asked").rowsBetween(W.unboundedPreceding, 0)
    points = F.explode(F.array(F.struct(F.col("at"), F.col("at").alias("date"), F.lit(True).alias("end")), F.struct(F.col("at"), F.date_sub("start", 1).alias("date"), F.lit(False).alias("end")))).alias("q")
    ask = marks.select(*ACCOUNT).distinct().crossJoin(F.broadcast(dates.select(points))).select(*ACCOUNT, "q.date", "q.at", "q.end", F.lit(1).alias("asked"), F.lit(None).cast("double").alias("realized_pnl"), F.lit(None).cast("double").alias("unrealized_pnl"))
    rows = marks.select(*ACCOUNT, "date", F.lit(None).cast("date").alias("at"), F.lit(None).cast("boolean").alias("end"), F.lit(0).alias("asked"), "realized_pnl", "unrealized_pnl")
    x = rows.unionByName(ask).select(*ACCOUNT, "at", "end", "asked", F.count("realized_pnl").over(run).alias("n"), F.coalesce(F.sum("realized_pnl").over(run), F.lit(0.0)).alias("r"), F.coalesce(F.last("unrealized_pnl", ignorenulls=True).over(run), F.lit(0.0)).alias("u")).where("asked = 1")
    change = lambda c: F.sum(F.when(F.col("end"), F.col(c)).otherwise(-F.col(c)))
    g = x.groupBy("at", *ACCOUNT).agg(change("n").alias("n"), change("r").alias("realized_pnl"), change("u").alias("unrealized_pnl")).where("n > 0").drop("n")
    return ranked(g.withColumn("total_pnl", F.col("realized_pnl") + F.col("unrealized_pnl")), ("at", "symbol"))

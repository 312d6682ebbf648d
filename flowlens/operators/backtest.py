"""Returns of signals: sessions, equity, months, sides, portfolios and market-matched trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators import screening as sc
from flowlens.operators import series as se
from flowlens.sources import tables as tb

#: Cost of a round trip (fixed value).
COST = 0.00435


def sessions(signal: DataFrame, prices: DataFrame, test: Column, cost: float = COST) -> DataFrame:
    """(symbol, date, side, ret, hold): on each test date but the first, the session's return by the sign of the signal of the test date before, after cost; 0 without a signal or an open. `hold` is the return of the close (0 without a close before)."""
    w = se.by_symbol()
    x = prices.where(test).select("symbol", "date", "open", "close").join(signal.select("symbol", "date", "signal"), ["symbol", "date"], "left")
    x = x.withColumn("before", F.lag(F.coalesce("signal", F.lit(0.0))).over(w)).withColumn("last", F.lag("close").over(w)).withColumn("row", F.row_number().over(w)).where("row > 1")
    raw = F.try_divide(F.col("close"), F.col("open")) - 1
    side = F.when((F.col("open") > 0) & (F.col("before") > 0), "long").when((F.col("open") > 0) & (F.col("before") < 0), "short")
    ret = F.when(F.col("side") == "long", raw - cost).when(F.col("side") == "short", -raw - cost).otherwise(F.lit(0.0))
    return x.withColumn("side", side).select("symbol", "date", "side", ret.alias("ret"), F.coalesce(F.when(F.col("last") > 0, F.col("close") / F.col("last") - 1), F.lit(0.0)).alias("hold"))


def _product(one_plus: Column, over=None) -> Column:
    """Product of factors of any sign, as a sum of logarithms with the sign counted apart; in a group, or over a window."""
    put = (lambda c: c) if over is None else (lambda c: c.over(over))
    size = put(F.sum(F.log(F.when(one_plus == 0, F.lit(1.0)).otherwise(F.abs(one_plus)))))
    sign = F.when(put(F.count_if(one_plus < 0)) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(put(F.count_if(one_plus == 0)) > 0, 0.0).otherwise(sign * F.exp(size))


def performance(returns: DataFrame, keys: tuple[str, ...], value: str = "ret") -> DataFrame:
    """Per key: days, total_return, log_equity and equity_sign (the same without overflow), sharpe (population deviation, by the root of 252), max_drawdown from 1 on, calmar. Keys without deviation or drawdown have 0.

    Equity is kept as the logarithm of its size and its sign (0 once a factor is 0), so that neither peaks nor drawdowns leave the range of a double.
    """
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    f = 1 + F.col(value)
    sign = F.when(F.count_if(f == 0).over(w) > 0, 0).when(F.count_if(f < 0).over(w) % 2 == 1, -1).otherwise(1)
    x = returns.withColumns({"size": F.sum(F.log(F.when(f == 0, F.lit(1.0)).otherwise(F.abs(f)))).over(w), "sign": sign})
    x = x.withColumn("peak", F.greatest(F.max(F.when(F.col("sign") > 0, F.col("size"))).over(w), F.lit(0.0)))
    last = lambda c: F.max_by(c, "date")
    g = x.groupBy(*keys).agg(F.count("*").alias("days"), last("size").alias("log_equity"), last("sign").alias("equity_sign"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.least(F.min(F.col("sign") * F.exp(F.col("size") - F.col("peak")) - 1), F.lit(0.0)).alias("max_drawdown"))
    g = g.withColumn("total_return", F.col("equity_sign") * F.exp("log_equity") - 1)
    sharpe = F.when(F.col("s") > 0, F.col("m") / F.col("s") * F.sqrt(F.lit(252.0))).otherwise(0.0)
    calmar = F.when(F.col("max_drawdown") < 0, F.col("total_return") / -F.col("max_drawdown")).otherwise(0.0)
    return g.select(*keys, "days", "total_return", "log_equity", "equity_sign", sharpe.alias("sharpe"), "max_drawdown", calmar.alias("calmar"))


def monthly(returns: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Compounded returns of each month in per cent: the strategy's and that of holding."""
    pct = lambda c: ((_product(1 + F.col(c)) - 1) * 100).alias(c)
    return returns.groupBy(*keys, F.date_format("date", "yyyy-MM").alias("month")).agg(pct("ret"), pct("hold"))


def sides(returns: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Number, mean return and share of gains of long and of short sessions."""
    of = lambda s: (F.count_if(F.col("side") == s).alias(f"n_{s}"), F.coalesce(F.avg(F.when(F.col("side") == s, F.col("ret"))), F.lit(0.0)).alias(f"avg_{s}"), F.coalesce(F.avg(F.when(F.col("side") == s, (F.col("ret") > 0).cast("int"))), F.lit(0.0)).alias(f"win_{s}"))
    return returns.groupBy(*keys).agg(*of("long"), *of("short"))


def portfolio(signals: DataFrame, prices: DataFrame, cost: float = COST) -> DataFrame:
    """Strategies (strategy, symbol, date, direction) held in equal weights from the open to the close of the next date: performance, share of days with a gain, and place by sharpe."""
    nxt = prices.select("symbol", "date", F.lead(F.struct("date", "open", "close")).over(se.by_symbol()).alias("n"))
    x = signals.where("direction <> 0").join(nxt, ["symbol", "date"]).where("n.open > 0")
    day = x.groupBy("strategy", F.col("n.date").alias("date")).agg((F.avg(F.col("direction") * (F.col("n.close") / F.col("n.open") - 1)) - cost).alias("ret"))
    won = day.groupBy("strategy").agg(F.avg((F.col("ret") > 0).cast("int")).alias("win_rate"))
    p = performance(day, ("strategy",)).join(won, "strategy")
    return p.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.floor(F.col("sharpe") * 1e9 + 0.5)), "strategy")))  # one row a strategy


def horizon_sharpe(signals: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20), cost: float = COST) -> DataFrame:
    """(strategy, horizon, trades, days, mean, sharpe_raw, sharpe_net, win_rate): from the signal's close to that h bars after the next date, averaged by that date, by the root of 252 / h."""
    w = se.by_symbol()
    wide = prices.select("symbol", "date", "close", F.lead("date").over(w).alias("entry"), *[F.lead("close", h + 1).over(w).alias(f"f{h}") for h in horizons])
    wide = wide.select("symbol", "date", "close", "entry", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("to")) for h in horizons])).alias("x"))
    x = signals.where("direction <> 0").join(wide.where("close > 0 and x.to is not null"), ["symbol", "date"])
    d = x.groupBy("strategy", "x.horizon", "entry").agg(F.avg((F.col("x.to") / F.col("close") - 1) * F.col("direction")).alias("r"), F.count("*").alias("trades"))
    g = d.groupBy("strategy", "horizon").agg(F.sum("trades").alias("trades"), F.count("*").alias("days"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("s"), F.avg((F.col("r") > 0).cast("int")).alias("win_rate"))
    sharpe = lambda m: F.when(F.col("s") > 0, m / F.col("s") * F.sqrt(252 / F.col("horizon"))).otherwise(0.0)
    return g.select("strategy", "horizon", "trades", "days", "mean", sharpe(F.col("mean")).alias("sharpe_raw"), sharpe(F.col("mean") - cost).alias("sharpe_net"), "win_rate")


def matched(trades: DataFrame, market: DataFrame) -> DataFrame:
    """Trades (date, direction, hold_seconds, net_bps, ...) with market_bps: the market's move (date, close) between the days of entry and exit, turned for shorts. Trades without both closes are left out."""
    exit_ = F.date_add("date", F.floor(F.col("hold_seconds") / 86_400).cast("int"))
    m = market.select("date", "close")
    x = trades.withColumn("exit", exit_).join(m.withColumnRenamed("close", "at_entry"), "date").join(m.select(F.col("date").alias("exit"), F.col("close").alias("at_exit")), "exit").where("at_entry > 0")
    move = (F.col("at_exit") / F.col("at_entry") - 1) * 10_000
    return x.withColumn("market_bps", F.when(F.col("direction") == "short", -move).otherwise(move)).drop("at_entry", "at_exit", "exit")


def beta_report(trades: DataFrame, market: DataFrame, strategy: str, tag: str) -> DataFrame:
    """One row a hold label of a strategy's logs (factor_name `<strategy>_<label>` or `<strategy>_dedup_<label>`, tags an array): n, beta, alpha, r2, sharpe, excess_sharpe, market_sharpe, avg_return, avg_market; fewer than two trades: zeros."""
    own = trades.where(F.array_contains("tags", tag) & F.col("factor_name").startswith(f"{strategy}_"))
    own = own.withColumn("label", F.regexp_replace(F.substring("factor_name", len(strategy) + 2, 1_000), "^dedup_", ""))
    x = matched(own, market)
    g = x.groupBy("label").agg(
        F.count("*").alias("n"), F.regr_slope("net_bps", "market_bps").alias("b"), F.regr_intercept("net_bps", "market_bps").alias("a"), F.regr_r2("net_bps", "market_bps").alias("r2"), F.avg("net_bps").alias("mr"), F.avg("market_bps").alias("mm"),
        F.var_samp("net_bps").alias("vr"), F.var_samp("market_bps").alias("vm"), F.covar_samp("net_bps", "market_bps").alias("c"))
    zero = lambda c: F.when(F.col("n") >= 2, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    year = F.sqrt(F.lit(252.0))
    rest = F.greatest(F.col("vr") - 2 * F.col("b") * F.col("c") + F.col("b") * F.col("b") * F.col("vm"), F.lit(0.0))
    ratio = lambda m, v: F.when(v > 1e-12, m / F.sqrt(v) * year)
    return g.select("label", "n", zero(F.col("b")).alias("beta"), zero(F.col("a") * 252).alias("alpha"), zero(F.col("r2")).alias("r2"), zero(ratio(F.col("mr"), F.col("vr"))).alias("sharpe"), zero(ratio(F.col("mr") - F.col("b") * F.col("mm"), rest)).alias("excess_sharpe"),
        zero(ratio(F.col("mm"), F.col("vm"))).alias("market_sharpe"), zero(F.col("mr")).alias("avg_return"), zero(F.col("mm")).alias("avg_market"))


def reevaluated(daily: DataFrame, prices: DataFrame, train: tuple[str, str], tests: dict[str, tuple[str, str]], cost: float = COST) -> DataFrame:
    """The weighted signal of one train window over other test windows: performance of each symbol and window. `tests` is a short list of named windows; daily and prices should be tables, since each window reads them."""
    out = None
    for name, (start, end) in tests.items():
        w = sc.Windows(*train, start, end)
        b = sc.bars(prices, w)
        x = sessions(sc.weighted_signal(daily, prices, b, sc.accounts(daily, b), w), prices, w.test(), cost).withColumn("window", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return performance(tb.stored(out, tb.workspace(prices.sparkSession, "reevaluated"), "sessions"), ("window", "symbol"))

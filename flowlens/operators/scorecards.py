"""Scorecards of accounts: profit against holding, raw timing, stability of the lead, composite score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators import permutation as pm
from flowlens.operators import series as se

ACCOUNT = ("symbol", "broker")


def net():
    return (F.col("buy_shares") - F.col("sell_shares")).cast("double")


def against_holding(daily: DataFrame, final: DataFrame, prices: DataFrame, least: float = 1e7) -> DataFrame:
    """Profit of an account by its capital (the larger of amounts bought and sold), less the return of holding the symbol over all its dates (turned for accounts that sold more); capital from `least` on."""
    hold = prices.groupBy("symbol").agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("hold"))
    a = daily.groupBy(*ACCOUNT).agg(F.sum("buy_amount").alias("b"), F.sum("sell_amount").alias("s")).withColumn("capital", F.greatest("b", "s")).where((F.col("capital") > 0) & (F.col("capital") >= least))
    x = a.join(final.select(*ACCOUNT, "total_pnl"), [*ACCOUNT]).join(hold, "symbol")
    long_ = F.col("b") >= F.col("s")
    got, expected = F.col("total_pnl") / F.col("capital"), F.when(long_, F.col("hold")).otherwise(-F.col("hold"))
    return x.select(*ACCOUNT, F.when(long_, "long").otherwise("short").alias("position"), "capital", got.alias("made"), expected.alias("expected"), (got - expected).alias("alpha"))


def raw_timing(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """(symbol, broker, n, days, volume, raw, normalised): sum of (net of the day before less its mean) times return over all dates, and that by the number of dates and the deviation of the terms' nets.

    Days without trades are 0; sums over traded days and the symbol's totals give all of it.
    """
    w, whole = se.by_symbol(), W.partitionBy("symbol")
    p = prices.select("symbol", "date", F.coalesce(F.lead("close").over(w) / F.col("close") - 1, F.lit(0.0)).alias("next"), F.lead("date").over(w).isNull().alias("is_last"), F.count("*").over(whole).alias("n"))
    total = p.groupBy("symbol").agg(F.sum("next").alias("all_ret"))
    x = daily.withColumn("net", net()).join(p, ["symbol", "date"])
    term = F.when(~F.col("is_last"), F.col("net")).otherwise(0.0)
    m = x.groupBy(*ACCOUNT, "n").agg(F.count("*").alias("days"), F.sum(F.col("buy_shares") + F.col("sell_shares")).alias("volume"), F.sum("net").alias("sx"), F.sum(term).alias("tx"), F.sum(term * term).alias("txx"), F.sum(F.col("net") * F.col("next")).alias("cross")).join(total, "symbol").where("n >= 2")
    mean = F.col("sx") / F.col("n")
    raw = F.col("cross") - mean * F.col("all_ret")
    std = F.sqrt(F.greatest((F.col("txx") - 2 * mean * F.col("tx") + (F.col("n") - 1) * mean * mean) / (F.col("n") - 1), F.lit(0.0)))
    return m.select(*ACCOUNT, "n", "days", "volume", raw.alias("raw"), F.when(std > 1e-9, raw / (std * F.col("n"))).otherwise(0.0).alias("normalised"))


def lead_stability(daily: DataFrame, prices: DataFrame, least: float = 0.05) -> DataFrame:
    """Correlation of an account's net on its trade days with the next return, over all of the symbol's dates and in either half of them, and whether both halves agree: same sign, both beyond `least`. Undefined ones are 0."""
    w, whole = se.by_symbol(), W.partitionBy("symbol")
    p = prices.select("symbol", "date", (F.lead("close").over(w) / F.col("close") - 1).alias("next"), (F.row_number().over(w) - 1).alias("i"), F.floor(F.count("*").over(whole) / 2).alias("mid"))
    x = daily.select(*ACCOUNT, "date", net().alias("net")).join(p, ["symbol", "date"]).where("next is not null")
    one, two = F.col("i") + 1 < F.col("mid"), F.col("i") >= F.col("mid")
    corr = lambda cond: F.coalesce(F.nanvl(F.corr(F.when(cond, F.col("net")), F.when(cond, F.col("next"))), F.lit(0.0)), F.lit(0.0))
    g = x.groupBy(*ACCOUNT).agg(corr(F.lit(True)).alias("lead"), corr(one).alias("lead_1"), corr(two).alias("lead_2"))
    return g.withColumn("stable", (F.col("lead_1") * F.col("lead_2") > 0) & (F.abs("lead_1") > least) & (F.abs("lead_2") > least))


def composite(stability: DataFrame, marks: DataFrame, final: DataFrame, daily: DataFrame) -> DataFrame:
    """Score of each account within its symbol: 0.3 for a stable positive lead, 0.4 times the share of months with a realised gain (of those with any), 0.3 times profit a share between the symbol's least and most."""
    months = marks.groupBy(*ACCOUNT, F.trunc("date", "month").alias("month")).agg(F.sum("realized_pnl").alias("made")).where(F.abs("made") > 1e-6)
    won = months.groupBy(*ACCOUNT).agg(F.avg((F.col("made") > 0).cast("int")).alias("win_rate"), F.count("*").alias("months"))
    volume = daily.groupBy(*ACCOUNT).agg(F.sum(F.col("buy_shares") + F.col("sell_shares")).alias("volume"))
    x = stability.join(volume, [*ACCOUNT]).join(final.select(*ACCOUNT, "total_pnl"), [*ACCOUNT]).join(won, [*ACCOUNT], "left").na.fill(0.0, ["win_rate"]).na.fill(0, ["months"])
    x = x.withColumn("per_share", F.coalesce(F.try_divide("total_pnl", "volume"), F.lit(0.0)))
    w = W.partitionBy("symbol")
    low, high = F.min("per_share").over(w), F.max("per_share").over(w)
    part = (F.col("per_share") - low) / F.when(high > low, high - low).otherwise(1.0)
    score = F.when(F.col("stable") & (F.col("lead") > 0), 0.3).otherwise(0.0) + 0.4 * F.col("win_rate") + 0.3 * part
    return x.select(*ACCOUNT, "lead", "stable", "win_rate", "months", "total_pnl", "per_share", score.alias("score"))


def execution_alpha(matches: DataFrame, prices: DataFrame) -> DataFrame:
    """(symbol, broker, trades, execution_alpha): return of each closed trade less that of closes over the same days, weighted by the value opened."""
    p = prices.select("symbol", "date", "close")
    is_long = F.col("buy_date") < F.col("sell_date")
    x = matches.withColumn("is_long", is_long).withColumn("opened", F.least("buy_date", "sell_date")).withColumn("closed", F.greatest("buy_date", "sell_date"))
    x = x.join(p.select("symbol", F.col("date").alias("opened"), F.col("close").alias("c0")), ["symbol", "opened"]).join(p.select("symbol", F.col("date").alias("closed"), F.col("close").alias("c1")), ["symbol", "closed"])
    trade = F.when(F.col("is_long"), F.col("sell_price") / F.col("buy_price") - 1).otherwise(1 - F.col("buy_price") / F.col("sell_price"))
    gap = trade - F.when(F.col("is_long"), 1).otherwise(-1) * (F.col("c1") / F.col("c0") - 1)
    value = F.col("shares") * F.when(F.col("is_long"), F.col("buy_price")).otherwise(F.col("sell_price"))
    return x.groupBy(*ACCOUNT).agg(F.count("*").alias("trades"), F.try_divide(F.sum(gap * value), F.sum(value)).alias("execution_alpha"))


def lead_lag(daily: DataFrame, rets: DataFrame) -> DataFrame:
    """(symbol, broker, n, lead_corr, lag_corr): correlation of an account's net with the next and with the previous return over all n pairs of the symbol's dates, those without trades counting 0; null for a constant net.

    Sums over traded days and totals of the symbol give it without a dense grid.
    """
    w = se.by_symbol()
    g = rets.select("symbol", "date", "ret", F.lead("ret").over(w).alias("next_ret"), F.lag("ret").over(w).alias("prev_ret"), F.lag("date").over(w).alias("prev_date"))
    tot = g.where("prev_date is not null").groupBy("symbol").agg(F.count("*").alias("n"), F.sum("ret").alias("sr"), F.sum(F.col("ret") * F.col("ret")).alias("srr"), F.sum("prev_ret").alias("sp"), F.sum(F.col("prev_ret") * F.col("prev_ret")).alias("spp"))
    x = daily.select(*ACCOUNT, "date", net().alias("v")).join(g, ["symbol", "date"])
    ahead, back = F.col("next_ret").isNotNull(), F.col("prev_date").isNotNull()
    s = lambda cond, e: F.coalesce(F.sum(F.when(cond, e)), F.lit(0.0))
    v = F.col("v")
    m = x.groupBy(*ACCOUNT).agg(*[s(c, e).alias(name) for name, c, e in (("a1", ahead, v), ("a2", ahead, v * v), ("ar", ahead, v * F.col("next_ret")), ("b1", back, v), ("b2", back, v * v), ("br", back, v * F.col("prev_ret")))]).join(tot, "symbol")
    corr = lambda x1, x2, xr, y1, y2: F.when(F.expr(f"n * {x2} - {x1} * {x1} > 1e-9"), F.expr(f"(n * {xr} - {x1} * {y1}) / (sqrt(n * {x2} - {x1} * {x1}) * sqrt(n * {y2} - {y1} * {y1}))"))
    return m.withColumn("lead_corr", corr("a1", "a2", "ar", "sr", "srr")).withColumn("lag_corr", corr("b1", "b2", "br", "sp", "spp")).select(*ACCOUNT, "n", "lead_corr", "lag_corr")


def ranking_report(daily: DataFrame, final: DataFrame, execution: DataFrame, rets: DataFrame, prices: DataFrame, draws: int = 200, days: int = 20) -> DataFrame:
    """One row an account: its place in the symbol by profit, direction, profits, execution alpha and number of closed trades, timing alpha with its permutation p, correlations with the next and the previous return, style, and totals.

    Timing, correlations and style take dates that have a return, and stay null for accounts with fewer than `days` trade days, as does the execution alpha of accounts without a closed trade.
    Style comes from the previous return: above 0.05 'with the trend', below -0.05 'against it'.
    """
    known = prices.join(rets.select("symbol", "date"), ["symbol", "date"], "left_semi")
    both = F.col("buy_shares") + F.col("sell_shares")
    totals = daily.groupBy(*ACCOUNT).agg(F.count("*").alias("trading_days"), F.sum(both).alias("total_volume"), F.sum(F.col("buy_amount") + F.col("sell_amount")).alias("total_amount"), F.sum(F.col("buy_shares") - F.col("sell_shares")).alias("cumulative_net"))
    busy = daily.join(totals.where(F.col("trading_days") >= days).select(*ACCOUNT), [*ACCOUNT], "left_semi")
    timing = raw_timing(busy, known).select(*ACCOUNT, F.col("raw").alias("timing_alpha"))
    p = pm.timing_permutation(busy, known, draws).select(*ACCOUNT, "p")
    x = totals.join(final.select(*ACCOUNT, F.col("pos").alias("rank"), "realized_pnl", "unrealized_pnl", "total_pnl"), [*ACCOUNT], "left").join(execution, [*ACCOUNT], "left")
    x = x.join(timing, [*ACCOUNT], "left").join(p, [*ACCOUNT], "left").join(lead_lag(busy, rets).drop("n"), [*ACCOUNT], "left")
    sure = F.col("p") < 0.05
    says = F.when(sure & (F.col("timing_alpha") > 0), "leads").when(sure & (F.col("timing_alpha") < 0), "misleads").when(F.col("p").isNotNull(), "not significant")
    style = F.when(F.col("lag_corr") > 0.05, "with the trend").when(F.col("lag_corr") < -0.05, "against it").when(F.col("lag_corr").isNotNull(), "neutral")
    direction = F.when(F.col("cumulative_net") > 0, "long").when(F.col("cumulative_net") < 0, "short").otherwise("neutral")
    return x.na.fill(0, ["trades"]).withColumns({"direction": direction, "timing": says, "style": style})


def scorecard(daily: DataFrame, final: DataFrame, execution: DataFrame, timing: DataFrame, permuted: DataFrame, days: int = 20, volume: int = 1000) -> DataFrame:
    """One row for each account with enough days and shares: direction, profit, execution alpha, raw timing and its p, what the timing says, and whether the account is among the best or to be read the other way round.

    Best: a profit, execution and timing above 0, p below 0.05. Contrarian: timing below 0 with p below 0.05. Accounts without a closed trade have an execution alpha of 0.
    """
    x = timing.where((F.col("days") >= days) & (F.col("volume") >= volume)).select(*ACCOUNT, "days", "volume", F.col("raw").alias("timing_alpha"))
    held = daily.groupBy(*ACCOUNT).agg(F.sum(F.col("buy_shares") - F.col("sell_shares")).alias("held"))
    x = x.join(held, [*ACCOUNT]).join(final.select(*ACCOUNT, "total_pnl"), [*ACCOUNT], "left").na.fill(0.0, ["total_pnl"]).join(execution, [*ACCOUNT], "left").na.fill(0.0, ["execution_alpha"]).na.fill(0, ["trades"]).join(permuted.select(*ACCOUNT, "p"), [*ACCOUNT])
    direction = F.when(F.col("held") > 0, "long").when(F.col("held") < 0, "short").otherwise("neutral")
    sure, ahead = F.col("p") < 0.05, F.col("timing_alpha") > 0
    says = F.when(sure & ahead, "leads").when(sure & (F.col("timing_alpha") < 0), "misleads").otherwise("not significant")
    best = (F.col("total_pnl") > 0) & sure & ahead & (F.col("execution_alpha") > 0)
    listed = F.when(best, "best").when(sure & (F.col("timing_alpha") < 0), "contrarian").otherwise("none")
    return x.select(*ACCOUNT, "days", "volume", direction.alias("direction"), "total_pnl", "execution_alpha", "trades", "timing_alpha", "p", says.alias("timing"), listed.alias("listed"))


def accumulators(daily: DataFrame, start, end, k: int = 20) -> DataFrame:
    """The k brokers of each symbol that bought most shares net within [start, end]: (symbol, broker, net, buy_vwap, pos)."""
    g = daily.where(F.col("date").between(start, end)).groupBy(*ACCOUNT).agg(F.sum(F.col("buy_shares") - F.col("sell_shares")).alias("net"), F.try_divide(F.sum("buy_amount"), F.sum("buy_shares")).alias("buy_vwap")).where("net > 0")
    return g.withColumn("pos", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("net"), "broker"))).where(F.col("pos") <= k)


def follow_up(daily: DataFrame, chosen: DataFrame, after, until) -> DataFrame:
    """What accumulators did on each trade day after their window: bought, sold or stood even; accounts without a trade then have one row without a date."""
    d = daily.where((F.col("date") > after) & (F.col("date") <= until)).select(*ACCOUNT, "date", (F.col("buy_shares") - F.col("sell_shares")).alias("traded"))
    x = chosen.select(*ACCOUNT, "net").join(d, [*ACCOUNT], "left")
    return x.withColumn("action", F.when(F.col("date").isNull(), "none").when(F.col("traded") > 0, "buy").when(F.col("traded") < 0, "sell").otherwise("even"))


def movers(daily: DataFrame, after, until, k: int = 10) -> DataFrame:
    """The k brokers with the largest and the k with the smallest net of each symbol and day."""
    w = W.partitionBy("symbol", "date")
    x = daily.where((F.col("date") > after) & (F.col("date") <= until)).select(*ACCOUNT, "date", (F.col("buy_shares") - F.col("sell_shares")).alias("net"), (F.col("buy_amount") - F.col("sell_amount")).alias("net_amount"))
    x = x.withColumn("top", F.row_number().over(w.orderBy(F.desc("net"), "broker"))).withColumn("bottom", F.row_number().over(w.orderBy("net", "broker")))
    side = F.when(F.col("top") <= k, "buyers").when(F.col("bottom") <= k, "sellers")
    return x.select(*ACCOUNT, "date", "net", "net_amount", side.alias("side")).where("side is not null")


def marked(chosen: DataFrame, closes: DataFrame) -> DataFrame:
    """Open profit of accumulators at a close (symbol, close), from the mean price they bought at."""
    x = chosen.where("buy_vwap > 0").join(closes, "symbol")
    return x.select(*ACCOUNT, "net", "buy_vwap", ((F.col("close") - F.col("buy_vwap")) * F.col("net")).alias("open_pnl"), (F.col("close") / F.col("buy_vwap") - 1).alias("open_return"))

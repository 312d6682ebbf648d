"""Large-day spreads, weighted signals and the screening funnel: dense account-by-date rules computed from traded days and totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions import stats
from flowlens.operators import events as ev
from flowlens.sources import tables as tb

ACCOUNT = ("symbol", "broker")


@dataclass(frozen=True)
class Windows:
    """Train and test dates, both ends included. All dates run from the first train day to the last test day."""

    train_start: str
    train_end: str
    test_start: str
    test_end: str

    def train(self) -> Column:
        return F.col("date").between(F.lit(self.train_start).cast("date"), F.lit(self.train_end).cast("date"))

    def test(self) -> Column:
        return F.col("date").between(F.lit(self.test_start).cast("date"), F.lit(self.test_end).cast("date"))

    def all(self) -> Column:
        return F.col("date").between(F.lit(self.train_start).cast("date"), F.lit(self.test_end).cast("date"))


def bars(prices: DataFrame, windows: Windows) -> DataFrame:
    """Dates within the windows: symbol, date, close, ret (over all prices), next (return of the next date within), n (dates)."""
    w, whole = W.partitionBy("symbol").orderBy("date"), W.partitionBy("symbol")
    prev = F.lag("close").over(w)
    p = prices.withColumn("ret", F.when(prev > 0, F.col("close") / prev - 1)).where(windows.all())
    return p.select("symbol", "date", "close", F.coalesce("ret", F.lit(0.0)).alias("ret"), F.lead(F.coalesce("ret", F.lit(0.0))).over(w).alias("next"), F.count("*").over(whole).alias("n"))


def accounts(daily: DataFrame, bars_: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Mean and (population) deviation of net shares of each account over all dates of its symbol, days without trades being 0; `idle` says whether such a day lies beyond sigma. Accounts without deviation are left out."""
    x = daily.select(*ACCOUNT, "date", (F.col("buy_shares") - F.col("sell_shares")).cast("double").alias("net")).join(bars_.select("symbol", "date", "n"), ["symbol", "date"])
    m = x.groupBy(*ACCOUNT, "n").agg(F.sum("net").alias("sx"), F.sum(F.col("net") * F.col("net")).alias("sxx"))
    m = m.withColumn("mean", F.col("sx") / F.col("n")).withColumn("std", F.sqrt(F.greatest(F.col("sxx") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0)))).where("std > 1e-9")
    return m.select(*ACCOUNT, "n", "mean", "std", (F.abs("mean") > sigma * F.col("std")).alias("idle"))


def _traded(daily: DataFrame, bars_: DataFrame, stats_: DataFrame, sigma: float) -> DataFrame:
    x = daily.select(*ACCOUNT, "date", (F.col("buy_shares") - F.col("sell_shares")).cast("double").alias("net")).join(bars_.drop("n", "close"), ["symbol", "date"]).join(stats_, [*ACCOUNT])
    return x.withColumn("dev", F.col("net") - F.col("mean")).withColumn("big", F.abs("dev") > sigma * F.col("std"))


def spreads(daily: DataFrame, bars_: DataFrame, stats_: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Mean next return after an account's large days less that after all its other dates, with Welch t, for three of each or more: (symbol, broker, large_days, other_days, spread, t). Others have nulls.

    Days without trades belong to one side as a whole: their sums are those of all dates less those of traded days.
    """
    nxt = F.col("next")
    total = bars_.where(nxt.isNotNull()).groupBy("symbol").agg(F.count("*").alias("N"), F.sum(nxt).alias("R"), F.sum(nxt * nxt).alias("RR"))
    of = lambda cond, c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0.0))
    x = _traded(daily, bars_, stats_, sigma).where(nxt.isNotNull())
    big, other = F.col("big"), ~F.col("big")
    g = x.groupBy(*ACCOUNT).agg(F.count_if(big).alias("n1"), of(big, nxt).alias("s1"), of(big, nxt * nxt).alias("q1"), F.count_if(other).alias("n0"), of(other, nxt).alias("s0"), of(other, nxt * nxt).alias("q0"))
    g = stats_.select(*ACCOUNT, "idle").join(total, "symbol").join(g, [*ACCOUNT], "left").na.fill(0, ["n1", "s1", "q1", "n0", "s0", "q0"])
    rest = {"n": F.col("N") - F.col("n1") - F.col("n0"), "s": F.col("R") - F.col("s1") - F.col("s0"), "q": F.col("RR") - F.col("q1") - F.col("q0")}
    side = lambda k, c: (F.col(f"{c}{k}") + F.when(F.col("idle") == (k == 1), rest[c]).otherwise(0)).alias(f"{c}{k}")
    g = g.select(*ACCOUNT, *[side(k, c) for k in (1, 0) for c in "nsq"])
    var = lambda k: F.greatest(F.try_divide(F.col(f"q{k}") - F.try_divide(F.col(f"s{k}") * F.col(f"s{k}"), F.col(f"n{k}")), F.col(f"n{k}") - 1), F.lit(0.0))
    enough = (F.col("n1") >= 3) & (F.col("n0") >= 3)
    spread = F.try_divide(F.col("s1"), F.col("n1")) - F.try_divide(F.col("s0"), F.col("n0"))
    se = F.sqrt(F.try_divide(var(1), F.col("n1")) + F.try_divide(var(0), F.col("n0")))
    return g.select(*ACCOUNT, F.col("n1").alias("large_days"), F.col("n0").alias("other_days"), F.when(enough, spread).alias("spread"), F.when(enough, F.coalesce(F.try_divide(spread, se), F.lit(0.0))).alias("t"))


def weighted_signal(daily: DataFrame, prices: DataFrame, bars_: DataFrame, stats_: DataFrame, windows: Windows, sigma: float = 2.0) -> DataFrame:
    """For every date within the windows, the sum over accounts beyond sigma of timing alpha (of the train dates alone) times deviation: (symbol, date, signal).

    An account whose days without trades lie beyond sigma adds a constant to every date; where it trades, that is taken off again. So only traded days are laid out.
    """
    train = windows.train()
    alpha = ev.timing_alpha(daily.where(train), prices.where(train)).where("timing_alpha <> 0")
    known = stats_.join(alpha, [*ACCOUNT]).withColumn("constant", F.when(F.col("idle"), -F.col("timing_alpha") * F.col("mean") / F.col("std")).otherwise(0.0))
    x = _traded(daily, bars_, known, sigma)
    value = F.when(F.col("big"), F.col("timing_alpha") * F.col("dev") / F.col("std")).otherwise(0.0) - F.col("constant")
    days = x.groupBy("symbol", "date").agg(F.sum(value).alias("moved"))
    base = known.groupBy("symbol").agg(F.sum("constant").alias("base"))
    return bars_.select("symbol", "date").join(days, ["symbol", "date"], "left").join(base, "symbol", "left").select("symbol", "date", (F.coalesce("moved", F.lit(0.0)) + F.coalesce("base", F.lit(0.0))).alias("signal"))


def signal_correlation(signal: DataFrame, bars_: DataFrame, windows: Windows) -> DataFrame:
    """Correlation of a day's signal with the next return, for returns in the train and in the test dates, with t and p; ten days or more, else 0 and p 1."""
    w = W.partitionBy("symbol").orderBy("date")
    x = signal.join(bars_.select("symbol", "date", "ret"), ["symbol", "date"]).withColumn("before", F.lag("signal").over(w)).where("before is not null")
    x = x.withColumn("train", windows.train()).withColumn("test", windows.test())
    only = lambda side, c: F.when(F.col(side), F.col(c))
    g = x.groupBy("symbol").agg(*[f for s in ("train", "test") for f in (F.count_if(s).alias(f"{s}_n"), F.corr(only(s, "before"), only(s, "ret")).alias(f"{s}_r"))])
    for s in ("train", "test"):
        r, n = F.col(f"{s}_r"), F.col(f"{s}_n")
        good = (n >= 10) & r.isNotNull() & ~F.isnan(r) & (F.abs(r) < 1)
        g = g.withColumn(f"{s}_t", F.when(good, r * F.sqrt(n - 2) / F.sqrt(1 - r * r)).otherwise(0.0)).withColumn(f"{s}_corr", F.when(good, r).otherwise(0.0))
    p = F.when(F.col("test_t") == 0, F.lit(1.0)).otherwise(stats.normal_p(F.col("test_t")))
    return g.select("symbol", "train_corr", "train_t", "test_corr", "test_t", p.alias("test_p"))


#: Ratios of neighbouring closes that point to a split, within five per cent (fixed values).
SPLITS = (0.5, 1 / 3, 0.25, 0.2, 0.1, 2.0, 3.0, 4.0, 5.0, 10.0)


def split_symbols(prices: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Each symbol with whether any close stands to the one before as in a split."""
    ratio = F.col("close") / F.lag("close").over(W.partitionBy("symbol").orderBy("date"))
    near = F.exists(F.array(*map(F.lit, SPLITS)), lambda x: F.abs(F.col("ratio") / x - 1) <= tolerance)
    return prices.select("symbol", ratio.alias("ratio")).groupBy("symbol").agg(F.coalesce(F.max(near), F.lit(False)).alias("split"))


def funnel(daily: DataFrame, prices: DataFrame, windows: Windows, least_turnover: float = 1e8, least_test_days: int = 60, least_train_days: int = 30, significant_share: float = 0.05, fund_prefix: str = "00", sigma: float = 2.0, alpha: float = 0.05, tolerance: float = 0.05) -> DataFrame:
    """Every symbol with the stage and reason it left at: (symbol, stage, reason, n_brokers, n_significant, avg_turnover, train and test correlation, test_p, rejected).

    Stage 0: funds, splits, too few days; 1: turnover; 2: no accounts, or too few whose large days pay; 3: passed, with the false-discovery rate over those that passed. Later measures are
    made for symbols that earlier stages let through only, and are null for the others.
    """
    p = prices.withColumn("is_train", windows.train()).withColumn("is_test", windows.test()).groupBy("symbol").agg(F.count_if("is_train").alias("train_days"), F.count_if("is_test").alias("test_days"))
    folder = tb.workspace(daily.sparkSession, "funnel")  # what several stages read is written once
    base = p.join(split_symbols(prices, tolerance), "symbol").withColumn("reason", F.when(F.col("symbol").startswith(fund_prefix), "fund").when(F.col("split"), "split").when(F.col("train_days") < least_train_days, "train days").when(F.col("test_days") < least_test_days, "test days"))
    base = tb.stored(base, folder, "base")
    through = base.where("reason is null").select("symbol")
    d = daily.join(through, "symbol", "left_semi")
    traded = d.where(windows.train()).groupBy("symbol", "date").agg(F.sum("buy_shares").alias("shares")).join(prices.where("close > 0").select("symbol", "date", "close"), ["symbol", "date"])
    turnover = through.join(traded.groupBy("symbol").agg(F.avg(F.col("shares") * F.col("close")).alias("avg_turnover")), "symbol", "left").na.fill(0.0, ["avg_turnover"])
    turnover = tb.stored(turnover, folder, "turnover")
    liquid = turnover.where(F.col("avg_turnover") >= least_turnover).select("symbol")
    d, b = d.join(liquid, "symbol", "left_semi"), tb.stored(bars(prices.join(liquid, "symbol", "left_semi"), windows), folder, "bars")
    s = tb.stored(accounts(d, b, sigma), folder, "accounts")
    v = spreads(d, b, s, sigma).groupBy("symbol").agg(F.count("*").alias("n_brokers"), F.count_if(F.col("t") > 1.96).alias("n_significant"))
    v = liquid.join(v, "symbol", "left").na.fill(0, ["n_brokers", "n_significant"]).withColumn("paying", (F.col("n_brokers") > 0) & (F.col("n_significant") >= significant_share * F.col("n_brokers")))
    v = tb.stored(v, folder, "validated")
    last = v.where("paying").select("symbol")
    dd, bb, ss = (x.join(last, "symbol", "left_semi") for x in (d, b, s))
    c = signal_correlation(weighted_signal(dd, prices, bb, ss, windows, sigma), bb, windows)
    x = base.select("symbol", F.col("reason").alias("early")).join(turnover, "symbol", "left").join(v, "symbol", "left").join(c, "symbol", "left")
    reason = F.when(F.col("early").isNotNull(), F.col("early")).when(F.col("avg_turnover") < least_turnover, "turnover").when(F.col("n_brokers") == 0, "no brokers").when(~F.col("paying"), "few significant").otherwise("passed")
    stage = F.when(F.col("early").isNotNull(), 0).when(F.col("avg_turnover") < least_turnover, 1).when(~F.col("paying"), 2).otherwise(3)
    x = x.select("symbol", stage.alias("stage"), reason.alias("reason"), "n_brokers", "n_significant", "avg_turnover", "train_corr", "train_t", "test_corr", "test_t", "test_p")
    x = tb.stored(x, folder, "screened")
    passed = ev.benjamini_hochberg(x.where("stage = 3").select("symbol", "test_p").withColumn("run", F.lit(1)), F.floor(F.col("test_p") * 1e9 + 0.500001) / 1e9, ("run",), alpha, ties=("symbol",)).select("symbol", "rejected")
    return x.join(passed, "symbol", "left")

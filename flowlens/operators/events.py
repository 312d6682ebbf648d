"""Large trades, event filters and broker selectors, for all symbols at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCOUNT = ("symbol", "broker")


def net() -> Column:
    return F.col("buy_shares") - F.col("sell_shares")


def large_trades(daily: DataFrame, sigma: float = 2.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Days on which an account's net shares lie more than sigma (sample) deviations from its mean over the days it traded.

    Net shares are whole, so that both sides of (n x - S)^2 (n - 1) > sigma^2 n (n Q - S^2), with the account's n days, sum S and sum of squares Q, are whole numbers
    (exact up to 2^53): a day at exactly sigma deviations is out, whatever the order of summation. z follows from the same sums.
    """
    w = W.partitionBy(*by, *ACCOUNT)
    x = daily.withColumn("net", net()).withColumns({"n": F.count("net").over(w).cast("double"), "s": F.sum("net").over(w).cast("double"), "q": F.sum(F.col("net") * F.col("net")).over(w).cast("double")})
    x = x.withColumns({"away": F.col("n") * F.col("net") - F.col("s"), "spread": F.col("n") * (F.col("n") * F.col("q") - F.col("s") * F.col("s"))}).where("n > 1 and spread > 0")
    x = x.where(F.col("away") * F.col("away") * (F.col("n") - 1) > sigma * sigma * F.col("spread"))
    x = x.withColumns({"mean": F.col("s") / F.col("n"), "std": F.sqrt(F.col("spread") / (F.col("n") - 1)) / F.col("n"), "z": F.col("away") / F.sqrt(F.col("spread") / (F.col("n") - 1))})
    z = x.drop("n", "s", "q", "away", "spread")
    return z.withColumn("direction", F.signum("z").cast("int"))


def large_trade_events(large: DataFrame, selected: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Daily sum of directions over the selected accounts; its sign is the event."""
    x = large if selected is None else large.join(selected.select(*by, *ACCOUNT), [*ACCOUNT], "inner" if by else "left_semi")
    s = x.groupBy(*by, "symbol", "date").agg(F.sum("direction").alias("total"), F.count("*").alias("signal_count"))
    return s.where("total <> 0").select(*by, "symbol", "date", F.signum("total").cast("int").alias("direction"), F.abs("total").alias("signal_value"), "signal_count")


def dense_large_days(daily: DataFrame, prices: DataFrame, sigma: float = 2.0) -> DataFrame:
    """As large_trades over every date of the symbol, days without trades being 0: moments come from sums over traded days and the number of dates."""
    n = prices.groupBy("symbol").agg(F.count("*").alias("n"))
    x = daily.withColumn("net", net().cast("double"))
    m = x.groupBy(*ACCOUNT).agg(F.sum("net").alias("sx"), F.sum(F.col("net") * F.col("net")).alias("sxx"), F.count("*").alias("traded")).join(n, "symbol")
    m = m.withColumn("mean", F.col("sx") / F.col("n")).withColumn("std", F.sqrt(F.greatest(F.col("sxx") / F.col("n") - F.col("mean") * F.col("mean"), F.lit(0.0)))).where("std > 0")
    large = x.join(m, [*ACCOUNT]).where(F.abs(F.col("net") - F.col("mean")) > sigma * F.col("std")).groupBy(*ACCOUNT).agg(F.count("*").alias("hits"))
    idle = F.when(F.abs("mean") > sigma * F.col("std"), F.col("n") - F.col("traded")).otherwise(F.lit(0))
    return m.join(large, [*ACCOUNT], "left").select(*ACCOUNT, "mean", "std", (F.coalesce("hits", F.lit(0)) + idle).alias("large_days"))


def timing_alpha(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """Sum of (net[t-1] - mean) * ret[t] over all dates, by the deviation of net over all dates: from traded days only."""
    w = W.partitionBy("symbol").orderBy("date")
    p = prices.select("symbol", "date", "close").withColumn("next_ret", F.lead("close").over(w) / F.col("close") - 1)
    total = p.groupBy("symbol").agg(F.count("*").alias("n"), F.sum("next_ret").alias("all_ret"))
    x = daily.select(*ACCOUNT, "date", net().cast("double").alias("net")).join(p, ["symbol", "date"])
    m = x.groupBy(*ACCOUNT).agg(F.sum("net").alias("sx"), F.sum(F.col("net") * F.col("net")).alias("sxx"), F.sum(F.col("net") * F.coalesce("next_ret", F.lit(0.0))).alias("cross")).join(total, "symbol")
    mean = F.col("sx") / F.col("n")
    std = F.sqrt(F.greatest(F.col("sxx") / F.col("n") - mean * mean, F.lit(0.0)))
    return m.select(*ACCOUNT, F.when((F.col("n") >= 2) & (std > 1e-9), (F.col("cross") - mean * F.col("all_ret")) / std).otherwise(F.lit(0.0)).alias("timing_alpha"))


def benjamini_hochberg(df: DataFrame, p: Column, run: tuple[str, ...], alpha: float = 0.05, ties: tuple[str, ...] = ()) -> DataFrame:
    """Marks which tests of a run pass: all up to the largest k with p(k) <= alpha k / n. The window runs over one row a test."""
    w = W.partitionBy(*run)
    x = df.withColumn("__p", p).withColumn("__k", F.row_number().over(w.orderBy("__p", *ties))).withColumn("__n", F.count("*").over(w))
    x = x.withColumn("__top", F.max(F.when(F.col("__p") <= alpha * F.col("__k") / F.col("__n"), F.col("__k"))).over(w))
    return x.withColumn("rejected", F.col("__k") <= F.coalesce("__top", F.lit(0))).drop("__p", "__k", "__n", "__top")

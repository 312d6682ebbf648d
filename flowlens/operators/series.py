"""Windows and series over symbols' trade dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_symbol() -> W:
    return W.partitionBy("symbol").orderBy("date")


def returns(prices: DataFrame) -> DataFrame:
    prev = F.lag("close").over(by_symbol())
    return prices.withColumn("ret", F.when(prev > 0, F.col("close") / prev - 1)).where(F.col("ret").isNotNull()).select("symbol", "date", "close", "ret")


def forward_returns(prices: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(symbol, date, horizon, ret_bps): return to the close h bars later; none past the end."""
    wide = prices.select("symbol", "date", "close", *(F.lead("close", h).over(by_symbol()).alias(f"f{h}") for h in horizons))
    stacked = wide.select("symbol", "date", "close", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"f{h}").alias("to")) for h in horizons))).alias("x"))
    return stacked.where("x.to is not null and close > 0").select("symbol", "date", "x.horizon", ((F.col("x.to") / F.col("close") - 1) * 10000).alias("ret_bps"))


def rolling(value: str, rows: int, keys: tuple[str, ...], order: str = "date", how=F.sum) -> Column:
    """Row-based rolling aggregate, null until the window is full."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(F.lit(1)).over(w) == rows, how(value).over(w))


def days_window(keys: tuple[str, ...], days: int) -> W:
    """The last `days` calendar days, today included."""
    return W.partitionBy(*keys).orderBy(F.unix_date("date")).rangeBetween(-(days - 1), 0)


def streaks(df: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Longest runs of gains and of losses over days with a value other than 0."""
    w = W.partitionBy(*keys).orderBy("date")
    s = df.where(F.col(value) != 0).withColumn("win", F.col(value) > 0)
    s = s.withColumn("run", F.row_number().over(w) - F.row_number().over(W.partitionBy(*keys, "win").orderBy("date")))
    runs = s.groupBy(*keys, "win", "run").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("win"), F.col("n"))), F.lit(0)).alias("win_run"), F.coalesce(F.max(F.when(~F.col("win"), F.col("n"))), F.lit(0)).alias("loss_run"))


def as_of(left: DataFrame, right: DataFrame, keys: tuple[str, ...], at: str, value: str) -> DataFrame:
    """Each left row with the latest right `value` at or before it: union and last over one window, so one shuffle and no range join."""
    cols = left.columns
    r = right.select(*keys, at, F.col(value).alias("__v"), F.lit(0).alias("__k"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in cols if c not in (*keys, at)))
    both = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__k", F.lit(1)).unionByName(r)
    w = W.partitionBy(*keys).orderBy(at, "__k").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__k = 1").select(*cols, value)


def spread_out(events: DataFrame, keys: tuple[str, ...], gap: int) -> DataFrame:
    """Greedy overlap suppression: an event stays if it is `gap` days or more after the last one that stayed. A fold over each group's sorted dates."""
    days = F.array_sort(F.collect_set("date"))
    pick = lambda kept, d: F.when((F.size(kept) == 0) | (F.datediff(d, F.element_at(kept, -1)) >= gap), F.concat(kept, F.array(d))).otherwise(kept)
    return events.groupBy(*keys).agg(days.alias("days")).select(*keys, F.explode(F.aggregate("days", F.array().cast("array<date>"), pick)).alias("date"))


def filled_closes(prices: DataFrame, dates: DataFrame) -> DataFrame:
    """(symbol, date, close) for the dates of prices and those of `dates` (symbol, date), each with the last close known by then; dates before the first close are left out."""
    asked = dates.select("symbol", "date", F.lit(None).cast("double").alias("close"))
    both = prices.select("symbol", "date", "close").unionByName(asked).groupBy("symbol", "date").agg(F.max("close").alias("close"))
    known = F.last("close", ignorenulls=True).over(by_symbol().rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn("close", known).where(F.col("close").isNotNull())

"""Does a signal's size say how far prices move? Quantile groups, rank correlations and partial ones, from counted values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators import series as se
from flowlens.sources import tables as tb

EVENT = ("symbol", "date")


def quantiles(counted: DataFrame, at: list[float], keys: tuple[str, ...] = ("metric",)) -> DataFrame:
    """keys, q (array): quantiles of counted values (keys, value, n), interpolated between neighbours, as sorting all values would give them.

    Running counts take one pass over the distinct values of a key; no buffer holds the values themselves.
    """
    w = W.partitionBy(*keys)
    c = counted.withColumn("upto", F.sum("n").over(w.orderBy("value").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    value_at = lambda k: F.min(F.when(F.col("upto") > k, F.col("value")))
    parts = []
    for i, q in enumerate(at):
        place = (F.col("total") - 1) * q
        parts += [value_at(F.floor(place)).alias(f"low{i}"), value_at(F.ceil(place)).alias(f"high{i}"), F.max(place - F.floor(place)).alias(f"part{i}")]
    g = c.groupBy(*keys).agg(*parts)
    return g.select(*keys, F.array(*[F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * F.col(f"part{i}") for i in range(len(at))]).alias("q"))


def average_rank(value: str, keys: tuple[str, ...]) -> Column:
    """Place of a value among those of its key, ties sharing the mean of their places."""
    w = W.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*keys, value)) - 1) / 2


def grouped(values: DataFrame, groups: int = 3, tail: float = 0.01) -> DataFrame:
    """values (metric, symbol, date, value) with value drawn in to its outer percentiles, its group (from 0) and the edges of the groups.

    Equal edges collapse; where fewer than two groups are left, the range is cut in the middle.
    """
    count = lambda df: df.groupBy("metric", "value").agg(F.count("*").alias("n"))
    ends = quantiles(count(values), [tail, 1 - tail])
    v = values.join(ends, "metric").withColumn("value", F.least(F.greatest("value", F.get("q", F.lit(0))), F.get("q", F.lit(1)))).drop("q")
    edges = quantiles(count(v), [i / groups for i in range(groups + 1)]).withColumn("edges", F.array_distinct("q"))
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(groups))
    edges = edges.select("metric", F.when(F.size("edges") >= 3, F.col("edges")).otherwise(F.array(low, low + (high - low) / 2, high + 0.001)).alias("edges"))
    inner = F.filter(F.slice("edges", 2, 1000), lambda e: e < F.col("value"))
    return v.join(edges, "metric").withColumn("grp", F.size(inner))


def strength(values: DataFrame, returns: DataFrame, confound: str | None = None, groups: int = 3, tail: float = 0.01) -> DataFrame:
    """One row for each (metric, horizon, grp): lo, hi, n (events), mean return, and for the metric and horizon monotonic, spearman, partial (the metric `confound` held), top_vs_bottom.

    returns (symbol, date, horizon, ret) are turned by direction. Rank correlations need ten events with a return, else they are 0.
    """
    folder = tb.workspace(values.sparkSession, "strength")
    v = tb.stored(grouped(values, groups, tail), folder, "grouped")
    x = tb.stored(v.join(returns.where(F.col("ret").isNotNull()), [*EVENT]), folder, "returns")
    size = v.groupBy("metric", "grp").agg(F.count("*").alias("n"), F.first("edges").alias("edges"))
    horizons = returns.select("horizon").distinct()
    means = x.groupBy("metric", "grp", "horizon").agg(F.avg("ret").alias("mean"))
    every = size.select("metric", F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("grp"), "edges").distinct().crossJoin(F.broadcast(horizons))
    rows = every.join(size.drop("edges"), ["metric", "grp"], "left").join(means, ["metric", "grp", "horizon"], "left").na.fill(0, ["n"]).na.fill(0.0, ["mean"])
    cell = W.partitionBy("metric", "horizon")
    before = F.lag("mean").over(cell.orderBy("grp"))
    rows = rows.withColumn("falls", F.coalesce(F.col("mean") < before, F.lit(False)))
    rows = rows.withColumn("monotonic", ~F.max("falls").over(cell)).withColumn("top_vs_bottom", F.max_by("mean", "grp").over(cell) - F.min_by("mean", "grp").over(cell))
    key = ("metric", "horizon")
    r = x.select(*key, *EVENT, average_rank("value", key).alias("rx"), average_rank("ret", key).alias("ry"))
    if confound is not None:
        z = v.where(F.col("metric") == confound).select(*EVENT, F.col("value").alias("z"))
        r = r.join(z, [*EVENT], "left").withColumn("rz", average_rank("z", key))
    else:
        r = r.withColumn("rz", F.lit(None).cast("double"))
    n = F.count("*")
    rho = lambda a, b: 1 - 6 * F.sum((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))) / (n * (n * n - 1))
    g = r.groupBy(*key).agg(n.alias("events"), rho("rx", "ry").alias("xy"), rho("rx", "rz").alias("xz"), rho("ry", "rz").alias("yz")).where("events >= 10")
    rest = (1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))
    held = F.when(rest > 0, (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt(rest)).otherwise(0.0)
    own = F.lit(confound is None) | (F.col("metric") == F.lit(confound))
    g = g.select(*key, F.col("xy").alias("spearman"), F.when(own, F.col("xy")).otherwise(held).alias("partial"))
    out = rows.join(g, [*key], "left").na.fill(0.0, ["spearman", "partial"])
    return out.select(*key, "grp", F.get("edges", F.col("grp")).alias("lo"), F.get("edges", F.col("grp") + 1).alias("hi"), "n", "mean", "monotonic", "spearman", "partial", "top_vs_bottom")


def persistence(events: DataFrame, days: int = 7) -> DataFrame:
    """events with the number of the symbol's event dates within the last `days` calendar days, its own included."""
    d = events.select(*EVENT).distinct().withColumn("persistence", F.count("*").over(W.partitionBy("symbol").orderBy(F.unix_date("date")).rangeBetween(-days, 0)))
    return events.join(d, [*EVENT])


def excess_returns(events: DataFrame, prices: DataFrame, horizons: tuple[int, ...], market: str) -> DataFrame:
    """(symbol, date, horizon, ret): returns after events less those of the market symbol from the same date (none: 0), by the symbol's deviation and the root of the horizon (30 closes or fewer: as they are), turned by direction."""
    r = se.forward_returns(prices, horizons)
    m = r.where(F.col("symbol") == market).select("date", "horizon", F.col("ret_bps").alias("market"))
    ret = prices.select("symbol", (F.col("close") / F.lag("close").over(se.by_symbol()) - 1).alias("ret"))
    vol = ret.groupBy("symbol").agg(F.stddev_samp("ret").alias("vol"), F.count("*").alias("n")).where("n > 30 and vol > 0")
    x = events.select(*EVENT, "direction").join(r, [*EVENT]).join(m, ["date", "horizon"], "left").join(vol.select("symbol", "vol"), "symbol", "left")
    excess = F.col("ret_bps") - F.coalesce("market", F.lit(0.0))
    return x.select(*EVENT, "horizon", (F.coalesce(excess / (F.col("vol") * F.sqrt("horizon") * 10000), excess) * F.col("direction")).alias("ret"))


def metrics_of(events: DataFrame) -> DataFrame:
    """The sizes of a strategy's signals, one row each: brokers, log of churn, log of amount, persistence."""
    e = persistence(events)
    pairs = {"signal_count": F.col("signal_count").cast("double"), "log_churn": F.when(F.col("churn_ratio") > 0, F.ln("churn_ratio")), "log_amount": F.ln(F.col("conviction_amount") + 1), "persistence": F.col("persistence").cast("double")}
    have = {k: c for k, c in pairs.items() if {"log_churn": "churn_ratio", "log_amount": "conviction_amount"}.get(k, k) in e.columns}
    return e.select(*EVENT, F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), c.alias("value")) for k, c in have.items()])).alias("x")).select("x.metric", *EVENT, "x.value").where("value is not null")

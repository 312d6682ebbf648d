"""Smart-money events, their placebo, and event studies for all symbols at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions import stats
from flowlens.operators import holdings as ho
from flowlens.operators import hypothesis as hy
from flowlens.operators import permutation as pm
from flowlens.operators import series as se
from flowlens.sources import tables as tb

ACCOUNT = ("symbol", "broker")


def _cents(c: str):
    return F.floor(F.col(c) * 100 + 0.500001)


def turned(net: DataFrame, window: int = 5, sigma: float = 2.0) -> DataFrame:
    """Events of a series (symbol, date, net): its sum of `window` rows, standardised over the symbol, beyond sigma, where the side changes. The first row beyond sigma has nothing to change from and is left out, as the rule has it."""
    w, whole = se.by_symbol(), W.partitionBy("symbol")
    x = net.withColumn("sum", se.rolling("net", window, ("symbol",))).where("sum is not null")
    x = x.withColumn("z", F.try_divide(F.col("sum") - F.avg("sum").over(whole), F.stddev_samp("sum").over(whole))).where(F.abs("z") > sigma)
    x = x.withColumn("direction", F.when(F.col("z") > 0, 1).otherwise(-1))
    return x.withColumn("before", F.lag("direction").over(w)).where("before <> direction").select("symbol", "date", F.col("z").alias("signal_value"), "direction")


def smart_events(marks: DataFrame, large: DataFrame, k: int = 20, window: int = 5, sigma: float = 2.0, years: int = 3, history: int = 250) -> DataFrame:
    """Large trades of the brokers that on that day are among the k of their symbol with the highest profit: realised over the years before and the open mark. No future day is looked at.

    Days before the symbol's `history`-th mark date do not count.
    """
    by_account = W.partitionBy(*ACCOUNT).orderBy(F.unix_date("date")).rangeBetween(-(365 * years - 1), 0)
    x = marks.withColumn("total", F.sum("realized_pnl").over(by_account) + F.col("unrealized_pnl"))
    x = x.withColumn("pos", F.row_number().over(W.partitionBy("symbol", "date").orderBy(F.desc(_cents("total")), "broker"))).where(F.col("pos") <= k).select(*ACCOUNT, "date")
    dates = marks.select("symbol", "date").distinct().withColumn("n", F.row_number().over(se.by_symbol())).where(F.col("n") > history).select("symbol", "date")
    hits = x.join(dates, ["symbol", "date"], "left_semi").join(large.select(*ACCOUNT, "date", "direction"), [*ACCOUNT, "date"])
    return turned(hits.groupBy("symbol", "date").agg(F.sum("direction").alias("net")), window, sigma)


def final_ranking(marks: DataFrame) -> DataFrame:
    """Profit of each account over all its marks: realised and the last open mark, with its place in the symbol."""
    x = marks.groupBy(*ACCOUNT).agg(F.sum("realized_pnl").alias("realized_pnl"), F.max_by("unrealized_pnl", "date").alias("unrealized_pnl"))
    return ho.ranked(x.withColumn("total_pnl", F.col("realized_pnl") + F.col("unrealized_pnl")))


def placebo_events(marks: DataFrame, large: DataFrame, k: int = 20, window: int = 5, sigma: float = 2.0, history: int = 250, seed: int = 42) -> DataFrame:
    """The same of k brokers a symbol that a hash of seed and name draws from those outside the final top k. Symbols with fewer than 2 k brokers have none."""
    r = final_ranking(marks).withColumn("n", F.count("*").over(W.partitionBy("symbol"))).where((F.col("pos") > k) & (F.col("n") >= 2 * k))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "symbol", "broker").cast("binary"))
    drawn = r.withColumn("at", F.row_number().over(W.partitionBy("symbol").orderBy(order, "broker"))).where(F.col("at") <= k).select(*ACCOUNT)
    net = large.join(drawn, [*ACCOUNT], "left_semi").groupBy("symbol", "date").agg(F.sum("direction").alias("net"))
    net = net.withColumn("n", F.row_number().over(se.by_symbol())).where(F.col("n") > history).drop("n")
    return turned(net, window, sigma)


SIDES = {1: "accumulation", -1: "distribution"}
#: Picks of a task of the pooled study, and rows of its pool up to which that is broadcast (24 bytes each).
PICKS_A_TASK, BROADCAST_ROWS = 2_000_000, 500_000


def event_study(events: DataFrame, placebo: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20), draws: int = 10_000) -> DataFrame:
    """Each side of the events of a symbol (three or more), and the placebo (ten or more), against the returns of all dates: (symbol, side, horizon, n, mean_bps, base_bps, t, d, p, significant, conclusion, placebo_significant).

    Returns are not turned by direction, every test is drawn in full. Conclusion of a symbol: the better side has two significant horizons or more (significant), or one (marginal).
    Placebo tests decide placebo_significant of symbols with a significant horizon and have no rows of their own.
    """
    named = F.when(F.col("direction") == 1, SIDES[1]).otherwise(SIDES[-1])
    e = events.select("symbol", "date", named.alias("side")).unionByName(placebo.select("symbol", "date", F.lit("placebo").alias("side")))
    enough = F.col("events") >= F.when(F.col("side") == "placebo", 10).otherwise(3)
    e = e.withColumn("events", F.count("*").over(W.partitionBy("symbol", "side"))).where(enough).drop("events").withColumn("direction", F.lit(1))
    c = hy.compared(e, prices, horizons, draws, draws, draws + 1, keys=("side",), settle=False)
    c = tb.stored(c, tb.workspace(prices.sparkSession, "event-study"), "tests")
    is_placebo = F.col("side") == "placebo"
    hits = c.where(~is_placebo).groupBy("symbol", "side").agg(F.count_if("significant").alias("hits")).groupBy("symbol").agg(F.max("hits").alias("hits"))
    found = c.where(is_placebo & (F.col("n") >= 5)).groupBy("symbol").agg((F.min("p") < 0.05).alias("placebo_significant"))
    out = c.where(~is_placebo & (F.col("n") >= 3)).join(hits, "symbol").join(found, "symbol", "left")
    conclusion = F.when(F.col("hits") >= 2, "significant").when(F.col("hits") == 1, "marginal").otherwise("no_effect")
    return out.select("symbol", "side", "horizon", "n", "mean_bps", "base_bps", "t", "d", "p", "significant", conclusion.alias("conclusion"), (F.coalesce("placebo_significant", F.lit(False)) & (F.col("hits") >= 1)).alias("placebo_significant"))


def decay(events: DataFrame, prices: DataFrame, days: int = 20) -> DataFrame:
    """Mean return d days after the events of each symbol and side, turned by direction."""
    b = prices.select("symbol", "date", "close", F.row_number().over(se.by_symbol()).alias("i"))
    x = events.join(b, ["symbol", "date"]).where("close > 0").select("symbol", "direction", F.col("close").alias("from"), "i", F.explode(F.sequence(F.lit(1), F.lit(days))).alias("d"))
    j = x.withColumn("i", F.col("i") + F.col("d")).join(b.drop("date"), ["symbol", "i"])
    return j.groupBy("symbol", "direction", "d").agg(F.avg(F.col("direction") * (F.col("close") / F.col("from") - 1) * 10000).alias("car_bps"), F.count("*").alias("n"))


def standardised(prices: DataFrame, horizons: tuple[int, ...], window: int = 120) -> DataFrame:
    """(symbol, date, horizon, scar): forward returns by the symbol's deviation of the last `window` daily returns times the root of the horizon; as they are where there are fewer."""
    w = W.partitionBy("symbol").orderBy(F.desc("date"))
    last = prices.withColumn("ret", F.col("close") / F.lead("close").over(w) - 1).withColumn("k", F.row_number().over(w)).where((F.col("k") <= window) & F.col("ret").isNotNull())
    vol = last.groupBy("symbol").agg(F.stddev_samp("ret").alias("vol"), F.count("*").alias("n")).where((F.col("n") == window) & (F.col("vol") > 0))
    r = se.forward_returns(prices, horizons).join(vol.select("symbol", "vol"), "symbol", "left")
    return r.select("symbol", "date", "horizon", F.coalesce(F.col("ret_bps") / (F.col("vol") * F.sqrt("horizon") * 10000), F.col("ret_bps")).alias("scar"))


def pooled_study(events: DataFrame, prices: DataFrame, horizons: tuple[int, ...] = (1, 5, 10, 20), draws: int = 10_000, dates: int = 2000, window: int = 120) -> DataFrame:
    """Standardised returns of all symbols' events in one pool a side and horizon, against those of up to `dates` dates a symbol: (side, horizon, n, mean_scar, t, d, p, significant).

    The pool of dates grows with the symbols, so that no task holds it: it is numbered in hash order, a draw cuts the numbers into as many blocks as there are events
    and takes one of each, so that all differ; they meet the pool by an equi-join and are averaged by draw. Means are compared to the millionth.

    Draws are dealt over tasks before they are laid out: what they become is many times what Spark expects of so small a table, so the side that is
    broadcast is named, the pool up to a count, and never the draws.
    """
    spark = prices.sparkSession
    folder = tb.workspace(spark, "pooled-study")
    s = tb.stored(standardised(prices, horizons, window), folder, "scars")
    side = F.when(F.col("direction") == 1, SIDES[1]).otherwise(SIDES[-1]).alias("side")
    agg = lambda: (F.avg("scar").alias("m"), F.var_samp("scar").alias("v"), F.count("*").alias("n"))
    a = s.join(events.select("symbol", "date", side), ["symbol", "date"]).groupBy("side", "horizon").agg(*agg())
    pool = s.join(pm.baseline_dates(prices, horizons, dates), ["symbol", "date"])
    pool = tb.stored(_numbered(pool.select("horizon", "symbol", "i", "scar")), folder, "pool")
    b = pool.groupBy("horizon").agg(*agg()).withColumnsRenamed({"m": "bm", "v": "bv", "n": "bn"})
    c = tb.stored(a.join(b, "horizon").where("n >= 3 and bn >= 3"), folder, "tests")
    draw = c.select("side", "horizon", "n", F.col("bn").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    tasks = (c.agg(F.sum("n")).first()[0] or 0) * draws // PICKS_A_TASK + spark.sparkContext.defaultParallelism
    draw = draw.repartition(tasks, "side", "horizon", "draw")
    # as many blocks of equal length as there are events, and one number out of each
    picks = draw.withColumn("step", F.greatest(F.floor(F.col("size") / F.col("n")), F.lit(1))).withColumn("start", pm.hash_of(F.col("horizon"), F.col("draw")) % F.col("size"))
    picks = picks.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", "size") - 1)))
    within = pm.hash_of(F.col("j") + F.col("horizon") * 131071, F.col("draw")) % F.col("step")
    picks = picks.select("side", "horizon", "draw", ((F.col("start") + F.col("j") * F.col("step") + within) % F.col("size")).alias("k"))
    numbers = pool.select("horizon", "k", "scar")
    numbers = F.broadcast(numbers) if pool.count() <= BROADCAST_ROWS else numbers.hint("shuffle_hash")
    means = picks.join(numbers, ["horizon", "k"]).groupBy("side", "horizon", "draw").agg(F.avg("scar").alias("drawn"))
    away = lambda x: F.floor(F.abs(x) * 1e6 + 0.5)
    far = means.join(c.select("side", "horizon", "m"), ["side", "horizon"]).groupBy("side", "horizon").agg((F.count_if(away(F.col("drawn")) >= away(F.col("m"))) / F.lit(draws)).alias("p"))
    args = [F.col(x) for x in ("m", "v", "n", "bm", "bv", "bn")]
    out = c.join(far, ["side", "horizon"]).withColumn("t", F.coalesce(stats.welch_t(*args), F.lit(0.0))).withColumn("d", F.coalesce(stats.cohens_d(*args), F.lit(0.0)))
    return out.select("side", "horizon", "n", F.col("m").alias("mean_scar"), "t", "d", "p", ((F.col("p") < 0.05 / len(horizons)) & (F.abs("d") >= 0.2)).alias("significant"))


def _numbered(pool: DataFrame) -> DataFrame:
    """Rows of each horizon numbered from 0 in hash order (k), without one task seeing them all: rows are dealt to buckets of the hash, numbered within, and each bucket is moved on by the rows before it."""
    h = F.xxhash64("symbol", "i")
    x = pool.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned(F.col("h"), 50).cast("int"))
    inner = x.withColumn("at", F.row_number().over(W.partitionBy("horizon", "bucket").orderBy("h", "symbol", "i")) - 1)
    sizes = x.groupBy("horizon", "bucket").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(W.partitionBy("horizon").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(F.broadcast(before.drop("size")), ["horizon", "bucket"]).select("horizon", "scar", (F.col("at") + F.col("before")).alias("k"))

"""FIFO accounting in closed form: the k-th share bought is matched with the k-th share sold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCOUNT = ("symbol", "broker")


def cumulative(daily: DataFrame) -> DataFrame:
    """Running shares and amounts bought (b, bc) and sold (s, sc) of each account, with the matched number m."""
    w = W.partitionBy(*ACCOUNT).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    sums = {"b": "buy_shares", "s": "sell_shares", "bc": "buy_amount", "sc": "sell_amount"}
    return daily.withColumns({k: F.sum(c).over(w) for k, c in sums.items()}).withColumn("m", F.least("b", "s"))


def positions(daily: DataFrame) -> DataFrame:
    """Per account and trade day: running totals, realised profit to date and cost of what is open.

    The matched number m is the smaller running total, so the cost of the first m shares of that side is its running amount; only the
    other side is looked up: m finds the first day whose running total reaches it. Questions and days stand in one list for each account
    and side, over which one window carries the day, and each question carries its row along, so that nothing is joined back.
    """
    c = cumulative(daily)
    rest = [x for x in c.columns if x not in ACCOUNT]
    whole = c.select(F.struct(*rest).alias("r")).schema["r"].dataType
    day = lambda side, total, cost, shares, amount: F.when(F.col(shares) > 0, F.struct(F.lit(side).alias("side"), F.col(total).alias("x"), F.lit(0).alias("kind"),
        F.struct((F.col(total) - F.col(shares)).alias("x0"), (F.col(cost) - F.col(amount)).alias("c0"), (F.col(amount) / F.col(shares)).alias("avg")).alias("day"), F.lit(None).cast(whole).alias("row")))
    asked = F.struct(F.when(F.col("b") <= F.col("s"), "sell").otherwise("buy").alias("side"), F.col("m").alias("x"), F.lit(1).alias("kind"), F.lit(None).cast("struct<x0:bigint,c0:double,avg:double>").alias("day"), F.struct(*rest).alias("row"))
    points = F.array(asked, day("buy", "b", "bc", "buy_shares", "buy_amount"), day("sell", "s", "sc", "sell_shares", "sell_amount"))
    each = c.select(*ACCOUNT, F.explode(points).alias("p")).where("p is not null").select(*ACCOUNT, "p.*")
    w = W.partitionBy(*ACCOUNT, "side").orderBy(F.desc("x"), "kind").rowsBetween(W.unboundedPreceding, 0)
    found = each.withColumn("day", F.last("day", ignorenulls=True).over(w)).where("kind = 1")
    cost = F.when(F.col("x") > 0, F.col("day.c0") + (F.col("x") - F.col("day.x0")) * F.col("day.avg")).otherwise(F.lit(0.0))
    out = found.select(*ACCOUNT, "row.*", F.when(F.col("side") == "buy", cost).otherwise(F.col("row.bc")).alias("cost_b"), F.when(F.col("side") == "sell", cost).otherwise(F.col("row.sc")).alias("cost_s"))
    return out.withColumn("realized_total", F.col("cost_s") - F.col("cost_b"))


def unrealized(close: Column) -> Column:
    return (F.col("b") - F.col("s")) * close - (F.col("bc") - F.col("cost_b")) + (F.col("sc") - F.col("cost_s"))


def fifo_daily(daily: DataFrame, prices: DataFrame) -> DataFrame:
    """symbol, broker, date, realized_pnl (that day), unrealized_pnl (at the close), net (shares held)."""
    w = W.partitionBy(*ACCOUNT).orderBy("date")
    p = positions(daily).join(prices.select("symbol", "date", "close"), ["symbol", "date"])
    today = F.col("realized_total") - F.coalesce(F.lag("realized_total").over(w), F.lit(0.0))
    return p.select(*ACCOUNT, "date", today.alias("realized_pnl"), unrealized(F.col("close")).alias("unrealized_pnl"), (F.col("b") - F.col("s")).alias("net"), "realized_total", "buy_amount", "sell_amount", "buy_shares", "sell_shares", "b", "s", "bc", "sc", "cost_b", "cost_s", "close")


def matches(daily: DataFrame) -> DataFrame:
    """Closed trades: each overlap of a day's bought interval of shares with a day's sold one. A trade is long if it was bought on an earlier day.

    The running totals of both sides cut the shares of an account into slices; a slice belongs to the next day of either side, which one
    window finds, so that the work grows with the days and not with their pairs.
    """
    c = cumulative(daily)
    lot = lambda shares, amount: F.struct("date", (F.col(amount) / F.col(shares)).alias("price"))
    none = F.lit(None).cast("struct<date:date,price:double>")
    cut = lambda total, shares, bought, sold: F.when(F.col(shares) > 0, F.struct(F.col(total).alias("x"), bought.alias("bought"), sold.alias("sold")))
    points = F.array(cut("b", "buy_shares", lot("buy_shares", "buy_amount"), none), cut("s", "sell_shares", none, lot("sell_shares", "sell_amount")))
    each = c.select(*ACCOUNT, F.explode(points).alias("p")).where("p is not null").select(*ACCOUNT, "p.*")
    order = W.partitionBy(*ACCOUNT).orderBy(F.desc("x"), F.col("bought").isNull())
    w = order.rowsBetween(W.unboundedPreceding, 0)
    slices = each.select(*ACCOUNT, (F.col("x") - F.coalesce(F.lead("x").over(order), F.lit(0))).alias("shares"), F.last("bought", ignorenulls=True).over(w).alias("bought"), F.last("sold", ignorenulls=True).over(w).alias("sold"))
    kind = F.when(F.col("bought.date") < F.col("sold.date"), "long").otherwise("short")
    closed = slices.where("shares > 0 and bought is not null and sold is not null")
    return closed.select(*ACCOUNT, "shares", F.col("bought.date").alias("buy_date"), F.col("bought.price").alias("buy_price"), F.col("sold.date").alias("sell_date"), F.col("sold.price").alias("sell_price"), (F.col("shares") * (F.col("sold.price") - F.col("bought.price"))).alias("realized_pnl"), kind.alias("trade_type"))


def open_lots(daily: DataFrame) -> DataFrame:
    """What is open at the end: the part of each day's interval above the matched number."""
    c = cumulative(daily)
    w = W.partitionBy(*ACCOUNT)
    c = c.withColumn("matched", F.least(F.max("b").over(w), F.max("s").over(w)))
    side = lambda name, total, shares, amount: c.where((F.col(shares) > 0) & (F.col(total) > F.col("matched"))).select(*ACCOUNT, F.lit(name).alias("side"), (F.col(total) - F.greatest(F.col(total) - F.col(shares), F.col("matched"))).alias("shares"), (F.col(amount) / F.col(shares)).alias("cost_per_share"), F.col("date").alias("open_date"))
    return side("long", "b", "buy_shares", "buy_amount").unionByName(side("short", "s", "sell_shares", "sell_amount"))


def last_state(daily: DataFrame, prices: DataFrame, start: str | None = None) -> DataFrame:
    """Per account: realised profit, profit of what is open at the symbol's last close, and amounts traded; with `start`, late_pnl (realised from then on) as well.

    The cost of the first m shares of a side is a sum over its days, each with what of it lies below m, so that no day is looked up and accounts are sorted once.
    """
    order = W.partitionBy(*ACCOUNT).orderBy("date")
    run, whole = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    x = daily.withColumns({"b": F.sum("buy_shares").over(run), "s": F.sum("sell_shares").over(run), "m": F.least(F.sum("buy_shares").over(whole), F.sum("sell_shares").over(whole))})

    def cost(total: str, side: str, m: str) -> Column:
        before = F.col(total) - F.col(f"{side}_shares")
        part = (F.col(m) - before) * (F.col(f"{side}_amount") / F.col(f"{side}_shares"))
        return F.sum(F.when((F.col(f"{side}_shares") == 0) | (F.col(m) <= before), F.lit(0.0)).when(F.col(m) >= F.col(total), F.col(f"{side}_amount")).otherwise(part))

    late = []
    if start is not None:
        early = lambda c: F.sum(F.when(F.col("date") < F.lit(start).cast("date"), F.col(c)).otherwise(F.lit(0))).over(whole)
        x = x.withColumn("m0", F.least(early("buy_shares"), early("sell_shares")))
        late = [(cost("s", "sell", "m0") - cost("b", "buy", "m0")).alias("early_pnl")]
    sums = [F.sum(f"{side}_{c}").alias(a) for a, side, c in (("b", "buy", "shares"), ("s", "sell", "shares"), ("bc", "buy", "amount"), ("sc", "sell", "amount"))]
    at = x.groupBy(*ACCOUNT).agg(*sums, cost("b", "buy", "m").alias("cost_b"), cost("s", "sell", "m").alias("cost_s"), *late)
    final = prices.groupBy("symbol").agg(F.max_by("close", "date").alias("close"))
    at = at.join(final, "symbol").withColumns({"realized_pnl": F.col("cost_s") - F.col("cost_b"), "unrealized_pnl": unrealized(F.col("close"))})
    late = [] if start is None else [(F.col("realized_pnl") - F.col("early_pnl")).alias("late_pnl")]
    return at.select(*ACCOUNT, "realized_pnl", "unrealized_pnl", F.col("bc").alias("total_buy_amount"), F.col("sc").alias("total_sell_amount"), (F.col("realized_pnl") + F.col("unrealized_pnl")).alias("total_pnl"), *late)


def symbol_ranking(state: DataFrame) -> DataFrame:
    w = W.partitionBy("symbol").orderBy(F.desc(F.floor(F.col("total_pnl") * 1e4 + 0.500001)), "broker")
    return state.withColumn("rank", F.row_number().over(w))


def _cents(c: Column) -> Column:
    return F.floor(c * 100.0 + 0.500001) / 100.0


def market_ranking(state: DataFrame) -> DataFrame:
    """Brokers over all symbols. The final ranking window runs over one row for each broker."""
    cols = ["total_pnl", "realized_pnl", "unrealized_pnl", "total_buy_amount", "total_sell_amount"]
    sums = state.groupBy("broker").agg(*(_cents(F.sum(c)).alias(c) for c in cols))
    sums = sums.withColumn("total_amount", _cents(F.col("total_buy_amount") + F.col("total_sell_amount")))
    return sums.withColumn("rank", F.row_number().over(W.orderBy(F.desc("total_pnl"), "broker")))


def seeded(lots: DataFrame, fresh: DataFrame) -> DataFrame:
    """Open lots as opening days of their accounts, followed by fresh days (`fresh` false and true). Lots are all of one side, so that none matches another, and keep their order by date."""
    is_long = F.col("side") == "long"
    of = lambda cond, c: F.when(cond, c).otherwise(F.lit(0))
    amount = F.col("shares") * F.col("cost_per_share")
    seed = lots.select(*ACCOUNT, F.col("open_date").alias("date"), of(is_long, F.col("shares")).cast("long").alias("buy_shares"), of(~is_long, F.col("shares")).cast("long").alias("sell_shares"),
        of(is_long, amount).cast("double").alias("buy_amount"), of(~is_long, amount).cast("double").alias("sell_amount"), F.lit(False).alias("fresh"))
    return seed.unionByName(fresh.select(*ACCOUNT, "date", "buy_shares", "sell_shares", "buy_amount", "sell_amount", F.lit(True).alias("fresh")))


def resumed_daily(lots: DataFrame, fresh: DataFrame, prices: DataFrame, tasks: int | None = None) -> DataFrame:
    """As fifo_daily for days after those that left `lots` open; the history itself is not read. Accounts are dealt over `tasks` tasks, if given."""
    w = W.partitionBy(*ACCOUNT).orderBy("date")
    days = seeded(lots, fresh)
    p = positions(days if tasks is None else days.repartition(tasks, *ACCOUNT))
    today = F.col("realized_total") - F.coalesce(F.lag("realized_total").over(w), F.lit(0.0))
    p = p.withColumn("realized_pnl", today).where("fresh").join(prices.select("symbol", "date", "close"), ["symbol", "date"])
    return p.select(*ACCOUNT, "date", "realized_pnl", unrealized(F.col("close")).alias("unrealized_pnl"), (F.col("b") - F.col("s")).alias("net"))


def resumed_holdings(lots: DataFrame, fresh: DataFrame) -> DataFrame:
    """What each account made on its days after those that left `lots` open, and what it holds from each on: net shares and `base`, its mark being net * close + base."""
    w = W.partitionBy(*ACCOUNT).orderBy("date")
    p = positions(seeded(lots, fresh)).withColumn("realized_pnl", F.col("realized_total") - F.coalesce(F.lag("realized_total").over(w), F.lit(0.0)))
    return p.where("fresh").select(*ACCOUNT, "date", "realized_pnl", (F.col("b") - F.col("s")).alias("net"), unrealized(F.lit(0.0)).alias("base"))


def held_marks(holdings: DataFrame, closes: DataFrame) -> DataFrame:
    """Marks of every account on every date of its symbol from its first day in `holdings` on; a day's holding lasts until the account's next. Rows in which both figures are 0 are left out."""
    days = closes.select("symbol", "date", "close").withColumn("day", F.row_number().over(W.partitionBy("symbol").orderBy("date")))
    last = days.groupBy("symbol").agg(F.max("day").alias("last_day"))
    p = holdings.join(days.select("symbol", "date", "day"), ["symbol", "date"]).join(last, "symbol")
    p = p.withColumn("until", F.coalesce(F.lead("day").over(W.partitionBy(*ACCOUNT).orderBy("date")) - 1, "last_day")).drop("date").withColumnRenamed("day", "first")
    at = p.withColumn("day", F.explode(F.sequence("first", "until"))).join(days, ["symbol", "day"])
    out = at.select(*ACCOUNT, "date", F.when(F.col("day") == F.col("first"), F.col("realized_pnl")).otherwise(F.lit(0.0)).alias("realized_pnl"), (F.col("net") * F.col("close") + F.col("base")).alias("unrealized_pnl"))
    return out.where((F.abs("realized_pnl") > 1e-6) | (F.abs("unrealized_pnl") > 1e-6))


def resumed_marks(lots: DataFrame, fresh: DataFrame, closes: DataFrame) -> DataFrame:
    """Marks of every account on every date of `closes` (those after `lots` were left open): of what was open and has not traded since as well.

    The opening position counts as one that was taken before the first date. Rows in which both figures are 0 are left out.
    """
    days = closes.select("symbol", "date", "close").withColumn("day", F.row_number().over(W.partitionBy("symbol").orderBy("date")))
    last = days.groupBy("symbol").agg(F.max("day").alias("last_day"))
    w = W.partitionBy(*ACCOUNT).orderBy("date")
    p = positions(seeded(lots, fresh)).withColumn("today", F.col("realized_total") - F.coalesce(F.lag("realized_total").over(w), F.lit(0.0))).withColumn("next_fresh", F.lead("fresh").over(w))
    p = p.where("fresh or next_fresh is null or next_fresh").join(days.select("symbol", "date", "day"), ["symbol", "date"], "left").join(last, "symbol")
    p = p.withColumn("first", F.when(F.col("fresh"), F.col("day")).otherwise(F.lit(1))).withColumn("until", F.coalesce(F.lead("day").over(w) - 1, "last_day")).drop("day").where("first <= until")
    at = p.drop("date").withColumn("day", F.explode(F.sequence("first", "until"))).join(days, ["symbol", "day"])
    traded = F.col("fresh") & (F.col("day") == F.col("first"))
    out = at.select(*ACCOUNT, "date", F.when(traded, F.col("today")).otherwise(F.lit(0.0)).alias("realized_pnl"), unrealized(F.col("close")).alias("unrealized_pnl"))
    return out.where((F.abs("realized_pnl") > 1e-6) | (F.abs("unrealized_pnl") > 1e-6))

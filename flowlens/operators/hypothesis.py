"""Strategies as compositions of selector, event filter, outcome, baseline and test, run for all symbols and all folds at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.functions import stats
from flowlens.operators import events as ev
from flowlens.operators import holdings as ho
from flowlens.operators import permutation as pm
from flowlens.operators import series as se

#: Every table of a scan carries the run (fold) that it belongs to.
RUN = ("run",)


@dataclass(frozen=True)
class Fold:
    """Selectors see data up to train_end; events count within [test_start, test_end]."""

    label: str
    train_end: str
    test_start: str
    test_end: str


@dataclass(frozen=True)
class Market:
    """The tables that strategies read."""

    marks: DataFrame
    daily: DataFrame
    prices: DataFrame


@dataclass(frozen=True)
class Strategy:
    """select(market, runs, params) gives accounts (run, symbol, broker); events(market, runs, selected, params) gives (run, symbol, date, direction, ...)."""

    select: Callable[[Market, DataFrame, dict], DataFrame]
    events: Callable[[Market, DataFrame, DataFrame, dict], DataFrame]
    params: dict = field(default_factory=dict)
    horizons: tuple[int, ...] = (1, 5, 10, 20)


def runs_of(m: Market, folds: list[Fold]) -> DataFrame:
    """The folds as a table: run, train_end, test_start, test_end. A list of folds is short, so that it may be broadcast."""
    rows = [(f.label, f.train_end, f.test_start, f.test_end) for f in folds]
    text = m.prices.sparkSession.createDataFrame(rows, "run string, train_end string, test_start string, test_end string")
    return text.select("run", *[F.col(c).cast("date").alias(c) for c in ("train_end", "test_start", "test_end")])


def for_runs(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Each row once a run. Aggregations by run follow, so that the copies are summed before they are shuffled."""
    return df.crossJoin(F.broadcast(runs))


# ---------------------------------------------------------------- selectors


def _train_end() -> Column:
    return F.col("train_end")


def _ranked(m: Market, runs: DataFrame, days: int | None = None) -> DataFrame:
    end = _train_end()
    start = F.add_months(end, -36) if days is None else F.date_sub(end, days)
    return ho.ranked(ho.period(for_runs(m.marks, runs), start, end, by=RUN), (*RUN, "symbol"))


def top_k(m: Market, runs: DataFrame, p: dict) -> DataFrame:
    return _ranked(m, runs).where(F.col("pos") <= p.get("k", 20)).select(*RUN, *ho.ACCOUNT)


def dual_window(m: Market, runs: DataFrame, p: dict) -> DataFrame:
    one, three = (_ranked(m, runs, 365 * y).where(F.col("pos") <= p.get("k", 20)).select(*RUN, *ho.ACCOUNT) for y in (p.get("short_years", 1), p.get("long_years", 3)))
    return one.intersect(three)


def momentum(m: Market, runs: DataFrame, p: dict) -> DataFrame:
    gained = ho.rank_momentum(for_runs(m.marks, runs), _train_end(), F.add_months(_train_end(), -p.get("months", 6)), by=RUN)
    return ho.first_of(gained, p.get("k", 20), [F.desc("gained"), F.col("broker")], RUN).select(*RUN, *ho.ACCOUNT)


def niche(m: Market, runs: DataFrame, p: dict) -> DataFrame:
    amount = m.daily.groupBy("broker").agg(F.sum(F.col("buy_amount") + F.col("sell_amount")).alias("total_amount"))
    overall = ho.market(ho.period(for_runs(m.marks, runs), F.lit("1900-01-01").cast("date"), _train_end(), by=RUN), RUN).join(amount, "broker")
    return ho.niche_top(_ranked(m, runs).drop("pos"), overall, p.get("contrast", 0.3), p.get("least_amount", 1e9), p.get("k", 10), RUN).select(*RUN, *ho.ACCOUNT)


def concentrated(m: Market, runs: DataFrame, p: dict) -> DataFrame:
    """Accounts that hold more than a share of their broker's open profit; by the last mark of all, as the rule has it, so the same in every run."""
    z = m.marks.groupBy(*ho.ACCOUNT).agg(F.abs(F.max_by("unrealized_pnl", "date")).alias("u"))
    z = z.withColumn("weight", F.try_divide("u", F.sum("u").over(W.partitionBy("broker")))).where(F.col("weight") > p.get("weight", 0.08))
    return for_runs(z, runs).select(*RUN, *ho.ACCOUNT)


def regime(m: Market, runs: DataFrame, p: dict) -> DataFrame:
    """Accounts whose timing alpha broke out; over all bars, as the rule has it, so the same in every run."""
    z = ho.timing_regimes(m.daily, m.prices, p.get("window", 120), p.get("threshold", 2.0), p.get("least_windows", 4))
    return for_runs(z, runs).select(*RUN, *ho.ACCOUNT)


def _large_enough(large: DataFrame, amount: float) -> DataFrame:
    return large.where(F.when(F.col("direction") > 0, F.col("buy_amount")).otherwise(F.col("sell_amount")) >= amount)


def by_scar(m: Market, runs: DataFrame, p: dict) -> DataFrame:
    """Brokers with the best standardised returns after large trades of the train window; funds (symbols from 00 on) take no part."""
    train = for_runs(m.daily.where(~F.col("symbol").startswith("00")), runs).where(F.col("date") <= _train_end())
    large = _large_enough(ev.large_trades(train, p["sigma"], RUN), p["amount"])
    scars = ho.scar(large, m.prices, _train_end(), p.get("horizons", (5, 10, 20, 60)), RUN)
    return ho.scar_top(scars, p["k"], p["least"], RUN).select(*RUN, *ho.ACCOUNT)


# ---------------------------------------------------------------- event filters


def _adding(m: Market, runs: DataFrame, s: DataFrame, p: dict) -> DataFrame:
    return ho.adding(m.marks, s, p["brokers"], p.get("profit"), RUN)


def _large(m: Market, runs: DataFrame, s: DataFrame, p: dict) -> DataFrame:
    return ev.large_trade_events(ev.large_trades(m.daily, p["sigma"]), s, RUN)


def _large_in_test(m: Market, runs: DataFrame, s: DataFrame, p: dict) -> DataFrame:
    """Large by the statistics of the days from the test's start on, of the selected accounts."""
    late = ho.chosen(m.daily, s, RUN).join(F.broadcast(runs.select("run", "test_start")), "run").where("date >= test_start")
    x = _large_enough(ev.large_trades(late, p["sigma"], RUN), p["amount"])
    e = x.groupBy(*RUN, "symbol", "date").agg(F.sum("direction").alias("total"), F.count("*").alias("signal_count")).where("total <> 0")
    return e.select(*RUN, "symbol", "date", F.signum("total").cast("int").alias("direction"), "signal_count")


def _cluster(m: Market, runs: DataFrame, s: DataFrame, p: dict) -> DataFrame:
    return ho.cluster_events(ev.large_trades(m.daily, p["sigma"]), s, list(p.get("cluster", ())), p["symbols"], RUN)


STRATEGIES = {
    "large_trade_scar": Strategy(by_scar, _large_in_test, {"k": 20, "sigma": 2.0, "least": 5, "amount": 1e7}, (5, 10, 20, 60)),
    "contrarian_broker": Strategy(niche, _adding, {"k": 10, "contrast": 0.3, "least_amount": 1e9, "profit": 0.15, "brokers": 2}),
    "dual_window": Strategy(dual_window, _adding, {"k": 20, "short_years": 1, "long_years": 3, "profit": 0.15, "brokers": 2}),
    "conviction": Strategy(top_k, _adding, {"k": 20, "profit": 0.2, "brokers": 3}),
    "exodus": Strategy(top_k, lambda m, r, s, p: ho.exits(m.marks, m.daily, m.prices, s, p["brokers"], p["window"], p["kept"], p["move"], RUN), {"k": 20, "brokers": 5, "window": 20, "kept": 0.5, "move": 0.05}),
    "cross_stock": Strategy(top_k, _cluster, {"k": 20, "sigma": 2.0, "symbols": 2, "cluster": ()}),
    "ta_regime": Strategy(regime, _large, {"window": 120, "threshold": 1.0, "sigma": 2.0}),
    "contrarian_smart": Strategy(top_k, lambda m, r, s, p: ho.panic_buying(m.daily, m.prices, s, p["drop"], p["drop3"], p["brokers"], RUN), {"k": 20, "drop": -0.02, "drop3": -0.05, "brokers": 3}),
    "concentration": Strategy(concentrated, _adding, {"weight": 0.08, "brokers": 1}),
    "herding": Strategy(top_k, lambda m, r, s, p: ho.herding(m.daily, s, p["quantile"], p["crowd"], p["days"], RUN), {"k": 20, "quantile": 0.05, "crowd": 5, "days": 5}),
    "momentum_conviction": Strategy(momentum, _adding, {"k": 20, "months": 6, "profit": 0.2, "brokers": 3}),
}


# ---------------------------------------------------------------- outcome, baseline, test


def compared(e: DataFrame, prices: DataFrame, horizons: tuple[int, ...], draws: int = 10_000, check: int = 200, least: int = 500, keys: tuple[str, ...] = RUN, settle: bool = True) -> DataFrame:
    """One row for each (keys, symbol, horizon) of symbols with an event (keys, symbol, date, direction): n, mean_bps, base_bps, t, d, p, draws, significant.

    Returns after events, turned by their direction, against those of dates that have every horizon. Fewer than three of either: p is 1. Catalyst settles what
    it can: an effect size below 0.2 cannot count (p 1), a Welch p above 0.2 stands; only what is left is drawn, until it is clear (see `permutation.adaptive`).
    With settle False every test with enough values is drawn.
    """
    returns = se.forward_returns(prices, horizons)
    dates = pm.baseline_dates(prices, horizons)
    population = returns.join(dates, ["symbol", "date"]).select("symbol", "horizon", "i", F.col("ret_bps").alias("ret"))
    agg = lambda v: (F.avg(v).alias("m"), F.var_samp(v).alias("v"), F.count("*").alias("n"))
    b = population.groupBy("symbol", "horizon").agg(*agg("ret")).withColumnsRenamed({"m": "bm", "v": "bv", "n": "bn"})
    a = returns.join(e.select(*keys, "symbol", "date", "direction"), ["symbol", "date"]).groupBy(*keys, "symbol", "horizon").agg(*agg(F.col("ret_bps") * F.col("direction")))
    each = [*keys, "symbol", "horizon"]
    every = e.select(*keys, "symbol").distinct().withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    c = every.join(a, each, "left").join(b, ["symbol", "horizon"], "left").na.fill(0, ["n", "bn"])
    args = [F.col(x) for x in ("m", "v", "n", "bm", "bv", "bn")]
    enough = (F.col("n") >= 3) & (F.col("bn") >= 3)
    c = c.withColumn("t", F.when(enough, F.coalesce(stats.welch_t(*args), F.lit(0.0))).otherwise(0.0)).withColumn("d", F.when(enough, F.coalesce(stats.cohens_d(*args), F.lit(0.0))).otherwise(0.0))
    welch = F.when(F.col("t") == 0, F.lit(1.0)).otherwise(stats.normal_p(F.col("t")))
    small = F.lit(settle) & (F.abs("d") < 0.2)
    c = c.withColumn("settled", F.when(~enough | small, F.lit(1.0)).when(F.lit(settle) & (welch > 0.2), welch))
    alpha = 0.05 / len(horizons)
    open_ = c.where("settled is null").select(*each, "n", F.col("m").alias("observed"))
    drawn = pm.tested(open_, population, tuple(each), draws, alpha, check, least).select(*each, "p", "draws")
    c = c.join(drawn, each, "left").withColumn("p", F.coalesce("settled", "p"))
    significant = F.col("settled").isNull() & (F.col("p") < alpha) & (F.abs("d") >= 0.2)
    return c.select(*each, "n", F.col("m").alias("mean_bps"), F.col("bm").alias("base_bps"), "t", "d", "p", F.coalesce("draws", F.lit(0)).alias("draws"), significant.alias("significant"))


def run(m: Market, name: str, folds: list[Fold], draws: int = 10_000, check: int = 200, least: int = 500, **params) -> DataFrame:
    """A strategy over all folds in one plan: see `compared`. params override the strategy's own."""
    s = STRATEGIES[name]
    p, runs = {**s.params, **params}, runs_of(m, folds)
    e = s.events(m, runs, s.select(m, runs, p), p).join(F.broadcast(runs.select("run", "test_start", "test_end")), "run").where(F.col("date").between(F.col("test_start"), F.col("test_end")))
    return compared(e, m.prices, s.horizons, draws, check, least)


def concluded(tests: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """tests with the conclusion of each symbol (two significant horizons or more: significant, one: marginal) and which tests pass the false-discovery rate of their run."""
    hits = F.count_if("significant").over(W.partitionBy(*keys, "symbol"))
    tests = tests.withColumn("conclusion", F.when(hits >= 2, "significant").when(hits == 1, "marginal").otherwise("no_effect"))
    return ev.benjamini_hochberg(tests, F.floor(F.col("p") * 1e9 + 0.500001) / 1e9, keys, ties=("symbol", "horizon"))


def scan(m: Market, name: str, folds: list[Fold], **options) -> DataFrame:
    return concluded(run(m, name, folds, **options))


def batch(m: Market, names: list[str], folds: list[Fold], options: dict[str, dict] | None = None, **shared) -> DataFrame:
    """Several strategies: the rows of each scan with its name. options hold parameters of single strategies."""
    out = None
    for name in names:
        one = scan(m, name, folds, **shared, **(options or {}).get(name, {})).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def metrics(scanned: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """One row a run: symbols with events, tests, share of significant symbols (%), symbols and tests passing the false-discovery rate, how many of those agree in sign (%), their sign, and whether the run passes."""
    s = scanned.groupBy(*keys, "symbol").agg(
        F.max(F.col("conclusion") == "significant").alias("hit"), F.count("*").alias("tests"), F.count_if("rejected").alias("passing"), F.count_if(F.col("rejected") & (F.col("d") > 0)).alias("up"), F.count_if(F.col("rejected") & (F.col("d") < 0)).alias("down"))
    g = s.groupBy(*keys).agg(
        F.count("*").alias("n_symbols"), F.sum("tests").alias("n_tests"), (100 * F.avg(F.col("hit").cast("int"))).alias("sig_rate"), F.count_if(F.col("passing") > 0).alias("fdr_stocks"), F.sum("passing").alias("fdr_rejected"), F.sum("up").alias("up"), F.sum("down").alias("down"))
    g = g.withColumn("consistency", F.coalesce(F.try_divide(100 * F.greatest("up", "down"), F.col("fdr_rejected")), F.lit(0.0))).withColumn("dominant", F.when(F.col("up") >= F.col("down"), "positive").otherwise("negative")).drop("up", "down")
    return g.withColumn("passed", (F.col("sig_rate") > 5) & (F.col("fdr_stocks") >= 10) & (F.col("consistency") > 60))


def cross_validated(m: Market, name: str, folds: list[Fold], passing: int = 3, **options) -> DataFrame:
    """metrics of every fold, in one plan, with the verdict over all: enough folds pass."""
    g = metrics(scan(m, name, folds, **options))
    return g.withColumn("overall", F.count_if("passed").over(W.partitionBy()) >= passing)


def exported(m: Market, name: str, fold: Fold, hold_days: int = 0, draws: int = 10_000, check: int = 200, least: int = 500, **params) -> DataFrame:
    """Events (symbol, date, direction) of the symbols whose conclusion is significant, one a date; with hold_days, those that fall within the days held after an earlier one are left out."""
    s = STRATEGIES[name]
    p, runs = {**s.params, **params}, runs_of(m, [fold])
    e = s.events(m, runs, s.select(m, runs, p), p).join(F.broadcast(runs.select("run", "test_start", "test_end")), "run").where(F.col("date").between(F.col("test_start"), F.col("test_end")))
    good = concluded(compared(e, m.prices, s.horizons, draws, check, least)).where("conclusion = 'significant'").select("symbol").distinct()
    e = e.join(good, "symbol", "left_semi").groupBy("symbol", "date").agg(F.min("direction").alias("direction"))
    if hold_days:
        e = e.join(se.spread_out(e, ("symbol",), hold_days), ["symbol", "date"], "left_semi")
    return e

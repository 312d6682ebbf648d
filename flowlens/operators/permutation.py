"""Permutation tests: what can be decided from sums is decided by Catalyst, the rest is drawn in vectorised tasks.

A draw orders positions by a hash of position and draw, so that it is the same on every machine, in a column expression and in numpy. Statistics are
compared to the millionth, so that the order of summation decides nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCOUNT = ("symbol", "broker")
#: Factors of the hash of (position, draw) and of its mixing steps (fixed values, public integer hash).
PLACE, DRAW, MIX = 73856093, 19349663, 0x45D9F3B
#: The draw that thins a population of more than its limit of dates.
THIN = 1 << 20


def hashes(places: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """draws x places hashes of 32 bits."""
    x = (places[None, :].astype(np.uint64) * np.uint64(PLACE) + draws[:, None].astype(np.uint64) * np.uint64(DRAW)) & np.uint64(0xFFFFFFFF)
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * np.uint64(MIX)) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(16))


def hash_of(place: Column, draw: Column) -> Column:
    """The same as a column."""
    low = F.lit(0xFFFFFFFF).cast("long")
    x = (place.cast("long") * PLACE + draw.cast("long") * DRAW).bitwiseAND(low)
    for _ in range(2):
        x = (x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MIX).cast("long")).bitwiseAND(low)
    return x.bitwiseXOR(F.shiftright(x, 16))


def hash_sql(place: str, draw: str) -> str:
    """The same for a SQL twin."""
    x = f"(({place} * {PLACE}::bigint + {draw} * {DRAW}::bigint) & 4294967295)"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {MIX}::bigint) & 4294967295)"
    return f"xor({x}, {x} >> 16)"


def millionths(x):
    return np.floor(np.abs(x) * 1e6 + 0.5)


def adaptive(places: np.ndarray, values: np.ndarray, n: int, observed: float, draws: int, alpha: float, check: int = 200, least: int = 500) -> tuple[float, int]:
    """(p, draws made): the share of samples of n values, without replacement, whose mean lies as far from 0 as `observed`.

    After every `check` draws it ends if more than 4 alpha of them are as far, or if at most one is after `least` draws. p is 1 where the population is smaller than n.
    """
    if not 0 < n <= len(values):
        return 1.0, 0
    order, far, goal = np.argsort(places, kind="stable"), 0, millionths(observed)
    places, values = places[order], values[order]
    for start in range(0, draws, check):
        block = np.arange(start, min(start + check, draws))
        picked = np.argsort(hashes(places, block), axis=1, kind="stable")[:, :n]
        hits = millionths(values[picked].mean(axis=1)) >= goal
        far, made = far + int(hits.sum()), int(block[-1]) + 1
        if made % check == 0 and (far > made * alpha * 4.0 or (made >= least and far <= 1)):
            return far / made, made
    return far / draws, draws


def tested(tests: DataFrame, population: DataFrame, keys: tuple[str, ...], draws: int, alpha: float, check: int = 200, least: int = 500) -> DataFrame:
    """tests (keys, n, observed, ...) with p and the draws it took, from population (keys' last two: symbol, horizon; i, ret), whose rows a key are bounded by the sample of dates.

    Each test carries its population's values as arrays, so that tests are spread over tasks one by one, whatever their symbol.
    """
    shared = ["symbol", "horizon"]
    arrays = population.groupBy(*shared).agg(F.collect_list(F.struct("i", "ret")).alias("population"))
    x = tests.join(arrays, shared, "left")
    schema = tests.select(*keys).schema.add("p", "double").add("draws", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.select(["n", "observed", "population"]).to_pylist():
                pop = row["population"] or []
                out.append(adaptive(np.array([q["i"] for q in pop], np.int64), np.array([q["ret"] for q in pop], float), row["n"], row["observed"], draws, alpha, check, least))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], pa.array([p for p, _ in out], pa.float64()), pa.array([m for _, m in out], pa.int64())], names=[*keys, "p", "draws"])

    found = x.select(*keys, "n", "observed", "population").mapInArrow(run, schema)
    return tests.join(found, [*keys])


def baseline_dates(prices: DataFrame, horizons: tuple[int, ...], limit: int = 10_000) -> DataFrame:
    """(symbol, date, i): dates far enough from the end for every horizon; of more than `limit`, those that a hash picks."""
    order, whole = W.partitionBy("symbol").orderBy("date"), W.partitionBy("symbol")
    p = prices.select("symbol", "date", F.row_number().over(order).alias("i"), F.count("*").over(whole).alias("n")).where(F.col("i") <= F.col("n") - max(horizons))
    p = p.withColumn("k", F.row_number().over(whole.orderBy(hash_of(F.col("i"), F.lit(THIN)), "i")))
    return p.where(F.col("k") <= limit).select("symbol", "date", "i")


# ---------------------------------------------------------------- timing alpha


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.10, "†").otherwise("")


def timing_permutation(daily: DataFrame, prices: DataFrame, draws: int = 200, days: int = 1) -> DataFrame:
    """Permutation p of the timing alpha of each account with `days` trade days or more: (symbol, broker, observed, n_extreme, p, sim_mean, sim_std, percentile, label).

    Shuffling all days of an account, those without trades being 0, puts its m traded values on m random days. Mean and deviation stay, so that only the sum of
    value times next return changes: a draw is one ordering of the symbol's days, shared by its accounts, and an account's draws are a product of the first m returns of each ordering
    with its values. No dense grid of accounts by days is made, and accounts are spread over tasks one by one.
    """
    order = W.partitionBy("symbol").orderBy("date")
    p = prices.select("symbol", "date", F.row_number().over(order).alias("i"), F.coalesce(F.lead("close").over(order) / F.col("close") - 1, F.lit(0.0)).alias("next"))
    returns = p.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("i", "next"))).alias("bars"))
    net = (F.col("buy_shares") - F.col("sell_shares")).cast("double")
    x = daily.select(*ACCOUNT, "date", net.alias("net")).join(p.select("symbol", "date", "i"), ["symbol", "date"])
    x = x.groupBy(*ACCOUNT).agg(F.sort_array(F.collect_list(F.struct("i", "net"))).alias("days")).where(F.size("days") >= days).join(returns, "symbol")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str | None, np.ndarray] = (None, np.empty(0))
        for b in batches:
            out = {c: [] for c in ("symbol", "broker", "observed", "n_extreme", "sim_mean", "sim_std", "percentile")}
            for row in b.to_pylist():
                nxt = np.array([q["next"] for q in row["bars"]])
                if known[0] != row["symbol"]:
                    at = np.argsort(hashes(np.arange(1, len(nxt) + 1), np.arange(draws)), axis=1, kind="stable")
                    known = (row["symbol"], nxt[at])
                n, where = len(nxt), np.array([q["i"] for q in row["days"]]) - 1
                v = np.array([q["net"] for q in row["days"]])
                mean = v.sum() / n
                std = np.sqrt(max((v * v).sum() / n - mean * mean, 0.0))
                flat = n < 2 or std <= 1e-9
                alpha = lambda cross: np.zeros_like(cross) if flat else (cross - mean * nxt.sum()) / std  # noqa: B023, E731
                seen, drawn = float(alpha(v @ nxt[where])), alpha(known[1][:, : len(v)] @ v)
                out["symbol"].append(row["symbol"]), out["broker"].append(row["broker"]), out["observed"].append(seen)
                out["n_extreme"].append(int((millionths(drawn) >= millionths(seen)).sum()))
                out["sim_mean"].append(float(drawn.mean())), out["sim_std"].append(float(drawn.std()))
                out["percentile"].append(float((drawn < seen).mean() * 100))
            yield pa.RecordBatch.from_pydict(out, schema=_TIMING)

    found = x.mapInArrow(run, "symbol string, broker string, observed double, n_extreme long, sim_mean double, sim_std double, percentile double")
    found = found.withColumn("p", F.col("n_extreme") / F.lit(draws))
    return found.withColumn("label", stars(F.col("p")))


_TIMING = pa.schema([("symbol", pa.string()), ("broker", pa.string()), ("observed", pa.float64()), ("n_extreme", pa.int64()), ("sim_mean", pa.float64()), ("sim_std", pa.float64()), ("percentile", pa.float64())])


# ---------------------------------------------------------------- any statistic


def user_statistic(df: DataFrame, keys: tuple[str, ...], order: str, value: str, statistic: Callable[[np.ndarray], np.ndarray], draws: int = 1000, block: int = 200) -> DataFrame:
    """(keys, observed, n_extreme, p): how often a statistic of a group's values in random order lies as far from 0 as in the given order.

    `statistic` takes a matrix, one arrangement a row, and returns a number a row; it is run over blocks of draws, so that a group needs block x values of memory.
    A group is one series (a symbol's returns, say). Null values are left out.
    """
    schema = df.select(*keys).schema.add("observed", "double").add("n_extreme", "long").add("p", "double")

    def run(key, pdf):
        v = pdf.sort_values(order)[value].to_numpy(float)
        observed = float(statistic(v[None, :])[0])
        far, places = 0, np.arange(1, len(v) + 1)
        for start in range(0, draws, block):
            at = np.argsort(hashes(places, np.arange(start, min(start + block, draws))), axis=1, kind="stable")
            far += int((millionths(statistic(v[at])) >= millionths(observed)).sum())
        return pd.DataFrame([(*key, observed, far, far / draws)], columns=[*keys, "observed", "n_extreme", "p"])

    return df.where(F.col(value).isNotNull()).select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)

import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.operators import events as ev
from flowlens.operators import holdings as ho
from flowlens.operators import hypothesis as hy
from flowlens.operators import permutation as pm
from flowlens.operators import smart_money as sm
from flowlens.operators import strength as st
from flowlens.sources import tables as tb

D0 = dt.date(2020, 1, 1)


def prices_of(spark, series):
    return spark.createDataFrame([(s, D0 + dt.timedelta(days=i), float(c)) for s, cs in series.items() for i, c in enumerate(cs)], "symbol string, date date, close double")


def walk(r, n):
    out = [100.0]
    for _ in range(n - 1):
        out.append(out[-1] * math.exp(r.gauss(0, 0.02)))
    return out


def days_of(spark, r, symbols, brokers, n, share=0.4):
    rows = [(s, b, D0 + dt.timedelta(days=i), r.randrange(0, 9), r.randrange(0, 9)) for s in symbols for b in brokers for i in range(n) if r.random() < share]
    return spark.createDataFrame(rows, "symbol string, broker string, date date, buy_shares long, sell_shares long").withColumns({"buy_amount": F.col("buy_shares") * 10.0, "sell_amount": F.col("sell_shares") * 10.0})


# ---------------------------------------------------------------- draws


def test_hash_is_the_same_everywhere(spark):
    want = pm.hashes(np.arange(50), np.arange(7))
    df = spark.range(50).crossJoin(spark.range(7).withColumnRenamed("id", "d")).select("id", "d", pm.hash_of(F.col("id"), F.col("d")).alias("h"))
    assert all(want[r.d, r.id] == r.h for r in df.collect())
    import duckdb

    got = duckdb.sql(f"select i, d, {pm.hash_sql('i', 'd')} h from range(50) a(i), range(7) b(d)").fetchall()
    assert all(want[d, i] == h for i, d, h in got)


def test_adaptive_rule_against_a_loop():
    """One draw at a time: the same p and the same number of draws, whether it stops early, late or not at all."""
    r = np.random.default_rng(4)
    stopped = set()
    for observed, n in ((0.0, 5), (0.2, 30), (0.45, 20), (0.6, 12), (3.0, 8)):
        values, places = r.normal(0, 1, 150), np.arange(1, 151)
        far, want = 0, None
        for i in range(1, 1001):
            h = pm.hashes(places, np.array([i - 1]))[0]
            sample = values[sorted(range(150), key=lambda k: (h[k], places[k]))[:n]]
            far += math.floor(abs(sample.mean()) * 1e6 + 0.5) >= math.floor(abs(observed) * 1e6 + 0.5)
            if i % 200 == 0 and (far > i * 0.0125 * 4 or (i >= 500 and far <= 1)):
                want = (far / i, i)
                break
        want = want or (far / 1000, 1000)
        assert pm.adaptive(places, values, n, observed, 1000, 0.0125) == pytest.approx(want)
        stopped.add(want[1])
    assert 200 in stopped and 600 in stopped
    assert pm.adaptive(np.arange(3), np.ones(3), 5, 1.0, 100, 0.05) == (1.0, 0)


def test_timing_permutation_against_dense_loop(spark):
    r = random.Random(3)
    series = {s: walk(r, 40) for s in "AB"}
    daily = days_of(spark, r, "AB", "xyz", 40)
    got = {(x.symbol, x.broker): x for x in pm.timing_permutation(daily, prices_of(spark, series), draws=50).collect()}
    net = defaultdict(lambda: np.zeros(40))
    for x in daily.collect():
        net[x.symbol, x.broker][(x.date - D0).days] = x.buy_shares - x.sell_shares
    assert set(got) == set(net)

    def alpha(v, rets):
        return ((v[:-1] - v.mean()) * rets).sum() / v.std()

    for (s, b), v in net.items():
        rets = np.diff(series[s]) / series[s][:-1]
        traded = [i for i in range(40) if any(x.symbol == s and x.broker == b and (x.date - D0).days == i for x in daily.collect())] if (s, b) == ("A", "x") else None
        assert abs(got[s, b].observed - alpha(v, rets)) < 1e-9
        if traded is not None:
            sims = []
            for d in range(50):
                at = np.argsort(pm.hashes(np.arange(1, 41), np.array([d]))[0], kind="stable")
                shuffled = np.zeros(40)
                for k, i in enumerate(traded):
                    shuffled[at[k]] = v[i]
                sims.append(alpha(shuffled, rets))
            assert got[s, b].n_extreme == sum(math.floor(abs(z) * 1e6 + 0.5) >= math.floor(abs(got[s, b].observed) * 1e6 + 0.5) for z in sims)
            assert abs(got[s, b].sim_mean - np.mean(sims)) < 1e-9 and abs(got[s, b].sim_std - np.std(sims)) < 1e-9


def test_user_statistic_agrees_with_one_built_in_spark(spark):
    """The mean of the first ten values: as a function over matrices, and as windows and sums over the same draws."""
    r = random.Random(8)
    df = spark.createDataFrame([(g, i, r.gauss(0.2, 1)) for g in "ab" for i in range(30)], "g string, i int, v double")
    got = {x.g: x.n_extreme for x in pm.user_statistic(df, ("g",), "i", "v", lambda x: x[:, :10].mean(axis=1), 100, block=30).collect()}
    n = df.withColumn("place", F.row_number().over(W.partitionBy("g").orderBy("i")))
    seen = n.where("place <= 10").groupBy("g").agg(F.avg("v").alias("seen"))
    d = n.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(99))))
    d = d.withColumn("k", F.row_number().over(W.partitionBy("g", "d").orderBy(pm.hash_of(F.col("place"), F.col("d")), "place"))).where("k <= 10").groupBy("g", "d").agg(F.avg("v").alias("m")).join(seen, "g")
    want = {x.g: x.n for x in d.groupBy("g").agg(F.count_if(F.floor(F.abs("m") * 1e6 + 0.5) >= F.floor(F.abs("seen") * 1e6 + 0.5)).alias("n")).collect()}
    assert got == want and len(set(want.values())) == 2


# ---------------------------------------------------------------- the scan


def test_compared_settles_before_it_draws(spark):
    """Small effects have p 1, weak ones the p of Welch, strong ones are drawn; too few events have p 1; the baseline is that of dates with every horizon."""
    r = random.Random(1)
    prices = prices_of(spark, {"A": walk(r, 200), "B": walk(r, 200)})
    up = {}
    for s, cs in {x: [p.close for p in prices.where(F.col("symbol") == x).orderBy("date").collect()] for x in "AB"}.items():
        up[s] = sorted(range(170), key=lambda i: cs[i] / cs[i + 5])[:12]
    e = [("r", "A", D0 + dt.timedelta(days=i), 1) for i in up["A"]] + [("r", "B", D0 + dt.timedelta(days=i), 1) for i in range(0, 160, 5)] + [("q", "A", D0, 1), ("q", "A", D0 + dt.timedelta(days=1), -1)]
    out = {(x.run, x.symbol, x.horizon): x for x in hy.compared(spark.createDataFrame(e, "run string, symbol string, date date, direction int"), prices, (1, 5), draws=1000).collect()}
    assert len(out) == 6
    strong = out["r", "A", 5]
    assert strong.draws == 600 and strong.p == 0 and strong.significant and strong.n == 12
    assert all(out["q", "A", h].p == 1 and out["q", "A", h].n == 2 and not out["q", "A", h].significant for h in (1, 5))
    assert all(x.p == 1 and x.draws == 0 for x in out.values() if abs(x.d) < 0.2)
    cs = [p.close for p in prices.where("symbol = 'A'").orderBy("date").collect()]
    assert abs(strong.base_bps - np.mean([(cs[i + 5] / cs[i] - 1) * 1e4 for i in range(195)])) < 1e-6


def test_every_strategy_has_a_plan(spark):
    """All eleven compositions run over two folds on a small market, their rows keyed by run."""
    r = random.Random(6)
    prices, daily = prices_of(spark, {s: walk(r, 260) for s in "ABCD"}), days_of(spark, r, "ABCD", [f"b{i}" for i in range(8)], 260)
    m = hy.Market(ho.daily_marks(daily, prices).cache(), daily.cache(), prices.cache())
    folds = [hy.Fold("one", "2020-05-01", "2020-05-02", "2020-07-01"), hy.Fold("two", "2020-07-01", "2020-07-02", "2020-09-10")]
    options = {"large_trade_scar": {"amount": 0, "least": 2}, "contrarian_broker": {"least_amount": 0, "contrast": 0.1}, "ta_regime": {"window": 40}, "herding": {"k": 3, "crowd": 2}, "cross_stock": {"cluster": ["A", "B", "C"]}}
    assert len(hy.STRATEGIES) == 11
    seen = set()
    for name in ("contrarian_smart", "large_trade_scar", "cross_stock", "ta_regime", "herding"):
        s, runs = hy.STRATEGIES[name], hy.runs_of(m, folds)
        p = {**s.params, **options.get(name, {})}
        e = s.events(m, runs, s.select(m, runs, p), p)
        assert {"run", "symbol", "date", "direction"} <= set(e.columns)
        if e.count():
            seen.add(name)
    assert {"ta_regime", "herding", "large_trade_scar"} <= seen


def test_snapshots_are_periods(spark):
    r = random.Random(2)
    marks = ho.daily_marks(days_of(spark, r, "AB", "xyz", 90, 0.3), prices_of(spark, {s: walk(r, 90) for s in "AB"})).cache()
    spans = [("2020-01-05", "2019-12-01"), ("2020-02-10", "2020-01-20"), ("2020-03-20", "2020-02-25"), ("2021-01-01", "2020-12-01")]
    dates = spark.createDataFrame(spans, "at string, start string").select(F.col("at").cast("date").alias("at"), F.col("start").cast("date").alias("start"))
    got = sorted((str(x["at"]), x.symbol, x.broker, round(x.total_pnl, 6), x.pos) for x in ho.snapshots(marks, dates).collect())
    want = []
    for at, start in spans:
        want += [(at, x.symbol, x.broker, round(x.total_pnl, 6), x.pos) for x in ho.ranked(ho.period(marks, F.lit(start).cast("date"), F.lit(at).cast("date"))).collect()]
    assert got == sorted(want) and want


def test_timing_regimes_against_dense_loop(spark):
    r = random.Random(9)
    series = {s: walk(r, 130) for s in "AB"}
    daily = days_of(spark, r, "AB", "xyzw", 130, 0.1)
    got = {(x.symbol, x.broker): x.z for x in ho.timing_regimes(daily, prices_of(spark, series), 20, 0.5).collect()}
    net = defaultdict(lambda: np.zeros(130))
    for x in daily.collect():
        net[x.symbol, x.broker][(x.date - D0).days] = x.buy_shares - x.sell_shares
    want = {}
    for (s, b), v in net.items():
        rets, ta = np.r_[0, np.diff(series[s]) / series[s][:-1]], []
        for start in range(0, 130 - 20 + 1, 10):
            w, q = v[start : start + 20], rets[start : start + 20]
            ta.append(((w[:-1] - w.mean()) * q[1:]).sum() / w.std() if w.std() > 1e-9 else 0.0)
        z = (ta[-1] - np.mean(ta[:-1])) / np.std(ta[:-1])
        if abs(z) > 0.5:
            want[s, b] = z
    assert want and got == pytest.approx(want)


# ---------------------------------------------------------------- smart money


def test_smart_events_against_loop(spark):
    """Top brokers of each day by what was known then, sums of five rows, first event beyond sigma left out."""
    r = random.Random(12)
    dates = [D0 + dt.timedelta(days=i) for i in range(80)]
    marks = [("A", b, d, r.gauss(0, 5), r.gauss(0, 50)) for b in "uvwxyz" for d in dates if r.random() < 0.8]
    large = [("A", b, d, r.choice([1, -1])) for b in "uvwxyz" for d in dates if r.random() < 0.4]
    got = [(x.date, x.direction, round(x.signal_value, 9)) for x in sm.smart_events(spark.createDataFrame(marks, "symbol string, broker string, date date, realized_pnl double, unrealized_pnl double"), spark.createDataFrame(large, "symbol string, broker string, date date, direction int"), 3, 5, 1.0, 3, 20).orderBy("date").collect()]
    have, net = sorted({m[2] for m in marks}), {}
    for d in have[20:]:
        total = {b: sum(m[3] for m in marks if m[1] == b and m[2] <= d) + u for _, b, x, _, u in marks if x == d}
        top = sorted(total, key=lambda b: (-math.floor(total[b] * 100 + 0.500001), b))[:3]
        hits = [x[3] for x in large if x[2] == d and x[1] in top]
        if hits:
            net[d] = sum(hits)
    order = sorted(net)
    sums = [(d, sum(net[x] for x in order[i - 4 : i + 1])) for i, d in enumerate(order) if i >= 4]
    mean, sd = np.mean([s for _, s in sums]), np.std([s for _, s in sums], ddof=1)
    beyond = [(d, 1 if s > mean else -1, round((s - mean) / sd, 9)) for d, s in sums if abs(s - mean) > sd]
    want = [b for a, b in zip(beyond, beyond[1:]) if a[1] != b[1]]
    assert got == want and len(want) >= 2


def test_event_study_and_pool(spark):
    """A planted effect is found, its placebo is not; the pooled p is that of plain draws within their error."""
    r = random.Random(5)
    series = {}
    hits = {s: sorted(r.sample(range(20, 260), 24)) for s in "ABC"}
    for s in "ABC":
        cs = [100.0]
        for i in range(1, 300):
            cs.append(cs[-1] * math.exp(r.gauss(0, 0.02) + (0.02 if s != "C" and i - 1 in hits[s] else 0)))
        series[s] = cs
    prices = prices_of(spark, series)
    events = spark.createDataFrame([(s, D0 + dt.timedelta(days=i), 1) for s in "ABC" for i in hits[s]], "symbol string, date date, direction int")
    placebo = spark.createDataFrame([(s, D0 + dt.timedelta(days=i), -1) for s in "ABC" for i in range(5, 200, 11)], "symbol string, date date, direction int")
    out = sm.event_study(events, placebo, prices, (1, 5), draws=400).collect()
    by = {(x.symbol, x.horizon): x for x in out}
    assert len(out) == 6 and {x.side for x in out} == {"accumulation"}
    assert by["A", 1].significant and by["B", 1].significant and not by["C", 1].significant and not by["C", 1].placebo_significant
    pooled = {x.horizon: x for x in sm.pooled_study(events, prices, (1, 5), draws=400).collect()}
    z = {s: np.std(np.diff(c[-121:]) / np.array(c[-121:-1]), ddof=1) for s, c in series.items()}
    for h in (1, 5):
        pool = np.concatenate([[(c[i + h] / c[i] - 1) / (z[s] * math.sqrt(h)) for i in range(295)] for s, c in series.items()])
        seen = np.mean([(series[s][i + h] / series[s][i] - 1) / (z[s] * math.sqrt(h)) for s in "ABC" for i in hits[s]])
        g = np.random.default_rng(0)
        p = np.mean([abs(g.choice(pool, 72, replace=False).mean()) >= abs(seen) for _ in range(4000)])
        assert pooled[h].n == 72 and abs(pooled[h].mean_scar - seen) < 1e-9 and abs(pooled[h].p - p) < 0.05 + 3 * math.sqrt(p / 400)
    assert pooled[1].significant
    decay = {x.d: x.car_bps for x in sm.decay(events.where("symbol = 'A'"), prices, 3).collect()}
    assert abs(decay[2] - np.mean([(series["A"][i + 2] / series["A"][i] - 1) * 1e4 for i in hits["A"]])) < 1e-6


# ---------------------------------------------------------------- strength


def test_strength_against_numpy(spark):
    r = random.Random(7)
    n = 400
    ev_ = [("S", D0 + dt.timedelta(days=i), float(r.choice([1, 1, 2, 2, 3, 5])), r.gauss(0, 1) ** 2) for i in range(n)]
    ret = [r.gauss(0, 1) + 0.2 * e[2] for e in ev_]
    values = spark.createDataFrame([("count", *e[:3]) for e in ev_] + [("size", e[0], e[1], e[3]) for e in ev_] + [("flat", e[0], e[1], 1.0 if i else 2.0) for i, e in enumerate(ev_)], "metric string, symbol string, date date, value double")
    returns = spark.createDataFrame([(e[0], e[1], 1, x) for e, x in zip(ev_, ret)], "symbol string, date date, horizon int, ret double")
    out = defaultdict(dict)
    for x in st.strength(values, returns, "count").collect():
        out[x.metric][x.grp] = x

    def rank(v):
        v = np.array(v)
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    rho = lambda a, b: 1 - 6 * ((rank(a) - rank(b)) ** 2).sum() / (n * (n * n - 1))
    c = np.clip([e[2] for e in ev_], *np.percentile([e[2] for e in ev_], [1, 99]))
    for name, raw in (("count", [e[2] for e in ev_]), ("size", [e[3] for e in ev_])):
        v = np.clip(raw, *np.percentile(raw, [1, 99]))
        edges = np.unique(np.quantile(v, np.linspace(0, 1, 4)))
        g = np.digitize(v, edges[1:], right=True)
        assert sorted(out[name]) == list(range(len(edges) - 1))
        for k, x in out[name].items():
            assert x.n == (g == k).sum() and abs(x.mean - np.mean([y for y, q in zip(ret, g) if q == k])) < 1e-9 and abs(x.lo - edges[k]) < 1e-9 and abs(x.hi - edges[k + 1]) < 1e-9
        xy, xz, yz = rho(v, ret), rho(v, c), rho(ret, c)
        assert abs(out[name][0].spearman - xy) < 1e-9
        assert abs(out[name][0].partial - (xy if name == "count" else (xy - xz * yz) / math.sqrt((1 - xz**2) * (1 - yz**2)))) < 1e-9
    assert len(out["flat"]) == 2 and out["flat"][0].n + out["flat"][1].n == n


# ---------------------------------------------------------------- closure, filled closes


def test_closure_of_a_long_chain(spark):
    m = spark.range(10_000).select(F.col("id").alias("key"), (F.col("id") + 1).alias("to")).union(spark.createDataFrame([(20_000, 20_001)], "key long, to long"))
    got = {r["key"]: r["to"] for r in tb.closure(m).collect()}
    assert len(got) == 10_001 and set(got.values()) == {10_000, 20_001} and got[0] == 10_000 and got[20_000] == 20_001


@pytest.mark.parametrize("rows", [[(1, 1)], [(1, 2), (2, 1)], [(5, 1), (1, 2), (2, 3), (3, 1)]])
def test_closure_of_a_cycle_raises(spark, rows):
    with pytest.raises(ValueError, match="leads back"):
        tb.closure(spark.createDataFrame(rows, "key long, to long"))


def test_large_trades_of_selected_accounts_by_run(spark):
    large = spark.createDataFrame([("A", "x", D0, 1), ("A", "y", D0, 1), ("A", "z", D0, -1)], "symbol string, broker string, date date, direction int")
    chosen = spark.createDataFrame([("one", "A", "x"), ("one", "A", "y"), ("two", "A", "z")], "run string, symbol string, broker string")
    out = {x.run: (x.direction, x.signal_value) for x in ev.large_trade_events(large, chosen, ("run",)).collect()}
    assert out == {"one": (1, 2), "two": (-1, 1)}


def test_day_files_and_every_symbol(spark, tmp_path):
    """Day files by pattern with a given schema; folders of symbols back with their names as text."""
    rows = [("0050", "x", D0), ("2330", "y", D0 + dt.timedelta(days=1)), ("A", "z", D0)]
    df = spark.createDataFrame(rows, "symbol string, broker string, date date")
    for day in ("2020-01-01", "2020-01-02"):
        df.where(F.col("date") == day).write.parquet(f"{tmp_path}/days/{day}.parquet")
    schema = "symbol string, broker string, date date"
    assert sorted(map(tuple, tb.day_files(spark, f"{tmp_path}/days/*.parquet", schema).collect())) == sorted(rows)
    assert tb.day_files(spark, f"{tmp_path}/days/*-02.parquet", schema).count() == 1
    tb.write_by_symbol(df, f"{tmp_path}/by")
    assert sorted((r.symbol, r.broker, r.date) for r in tb.every_symbol(spark, f"{tmp_path}/by", "broker string, date date").collect()) == sorted(rows)


def test_draws_of_the_pool_are_never_broadcast(spark):
    """A few tests become thousands of draws a test, which Spark expects to be as small as the tests: they must not be gathered on the driver."""
    r = random.Random(6)
    prices = prices_of(spark, {s: walk(r, 80) for s in "AB"})
    events = spark.createDataFrame([(s, D0 + dt.timedelta(days=i), 1) for s in "AB" for i in range(5, 60, 9)], "symbol string, date date, direction int")
    plan = sm.pooled_study(events, prices, (1, 5), draws=50)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    sent = [i for i, line in enumerate(plan) if "BroadcastExchange" in line]
    assert sent
    for i in sent:
        below = next((j for j in range(i + 1, len(plan)) if depth(plan[j]) <= depth(plan[i])), len(plan))
        assert not any("Generate" in line for line in plan[i:below])

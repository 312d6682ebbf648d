import datetime as dt
import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from flowlens.functions.stats import normal_p
from flowlens.operators import backtest as bt
from flowlens.operators import events as ev
from flowlens.operators import fifo as ff
from flowlens.operators import holdings as ho
from flowlens.sources import tables as tb
from flowlens.streaming import incremental as inc

DAY = dt.date(2024, 1, 1)
SCHEMA = "symbol string, broker string, date date, buy_shares long, sell_shares long, buy_amount double, sell_amount double"
PRICES = "symbol string, date date, close double"


def day(i):
    return DAY + dt.timedelta(days=i)


def loop(rows, close):
    """Plain FIFO: sells close longs first, what is left opens shorts; then buys cover shorts."""
    lots, out, total = {}, [], 0.0
    for s, b, d, bs, ss, ba, sa in rows:
        longs, shorts = lots.setdefault((s, b), (deque(), deque()))
        got = 0.0
        for own, other, n, p, sign in ((longs, shorts, ss, sa / ss if ss else 0, 1), (shorts, longs, bs, ba / bs if bs else 0, -1)):
            while n and own:
                take = min(n, own[0][0])
                got += sign * take * (p - own[0][1])
                n -= take
                own[0][0] -= take
                if not own[0][0]:
                    own.popleft()
            if n:
                other.append([n, p])
        c = close[s, d]
        out.append((s, b, d, got, sum(n * (c - p) for n, p in longs) + sum(n * (p - c) for n, p in shorts)))
    return out, lots


def test_fifo_against_loop(spark):
    r = random.Random(4)
    close = {(s, day(i)): r.uniform(50, 150) for s in "AB" for i in range(60)}
    rows = []
    for s in "AB":
        for b in "xyz":
            for i in sorted(r.sample(range(60), 40)):
                bs, ss = r.choice([0, 0, 5, 17, 100]), r.choice([0, 0, 8, 30, 90])
                rows.append((s, b, day(i), bs, ss, bs * r.uniform(50, 150), ss * r.uniform(50, 150)))
    want, lots = loop(rows, close)
    daily = spark.createDataFrame(rows, SCHEMA)
    prices = spark.createDataFrame([(*k, v) for k, v in close.items()], PRICES)
    got = {(x.symbol, x.broker, x.date): x for x in ff.fifo_daily(daily, prices).collect()}
    for s, b, d, real, unreal in want:
        assert got[s, b, d].realized_pnl == pytest.approx(real, abs=1e-6) and got[s, b, d].unrealized_pnl == pytest.approx(unreal, abs=1e-6)
    closed = ff.matches(daily).groupBy("symbol", "broker").agg(F.sum("realized_pnl").alias("p")).collect()
    for x in closed:
        assert x.p == pytest.approx(sum(w[3] for w in want if w[:2] == (x.symbol, x.broker)), abs=1e-6)
    left = {}
    for x in ff.open_lots(daily).collect():
        assert x.shares > 0
        left[x.symbol, x.broker, x.side] = left.get((x.symbol, x.broker, x.side), 0) + x.shares
    for (s, b), (longs, shorts) in lots.items():
        assert left.get((s, b, "long"), 0) == sum(n for n, _ in longs) and left.get((s, b, "short"), 0) == sum(n for n, _ in shorts)


def test_worked_example(spark):
    daily = spark.createDataFrame([("A", "x", day(0), 100, 0, 1000.0, 0.0), ("A", "x", day(1), 100, 0, 2000.0, 0.0), ("A", "x", day(2), 0, 100, 0.0, 2500.0)], SCHEMA)
    prices = spark.createDataFrame([("A", day(i), 25.0) for i in range(3)], PRICES)
    assert ff.fifo_daily(daily, prices).agg(F.sum("realized_pnl")).first()[0] == pytest.approx(1500)


def test_timing_alpha(spark):
    close = [100.0, 100.0, 102.0, 99.96, 101.9592]
    prices = spark.createDataFrame([("A", day(i), c) for i, c in enumerate(close)], PRICES)
    nets = [100, 100, -100, 100, -100]
    make = lambda f: spark.createDataFrame([("A", "x", day(i), max(f * n, 0), max(-f * n, 0), 0.0, 0.0) for i, n in enumerate(nets)], SCHEMA)
    a, b, c = (ev.timing_alpha(make(f), prices).first().timing_alpha for f in (1, 10, -1))
    assert a > 0 and b == pytest.approx(a, abs=1e-10) and c == pytest.approx(-a, abs=1e-10)


def test_statistics(spark):
    p = spark.range(1).select(normal_p(F.lit(0.0)).alias("a"), normal_p(F.lit(1.959964)).alias("b")).first()
    assert p.a == pytest.approx(1, abs=1e-6) and p.b == pytest.approx(0.05, abs=1e-6)
    df = spark.createDataFrame([("r", x) for x in (0.001, 0.02, 0.03, 0.5, 0.9)], "run string, p double")
    assert sorted((x.p, x.rejected) for x in ev.benjamini_hochberg(df, F.col("p"), ("run",)).collect()) == [(0.001, True), (0.02, True), (0.03, True), (0.5, False), (0.9, False)]


def test_incremental(spark, tmp_path):
    rows = [("A", "x", day(i), 1, 0, 1.0, 0.0) for i in range(4)] + [("B", "x", day(0), 1, 0, 1.0, 0.0)]
    every = spark.createDataFrame(rows, SCHEMA)
    stored = every.where((F.col("symbol") == "A") & (F.col("date") < day(2)))
    fresh = inc.new_days(every, stored)
    assert fresh.count() == 3
    merged = inc.merge_daily(inc.merge_daily(stored, fresh), fresh)
    assert sorted(map(tuple, merged.collect())) == sorted(rows)
    every.write.parquet(str(tmp_path / "in"))
    for n in (5, 5):
        inc.ingest(spark, str(tmp_path / "in"), every.schema, str(tmp_path / "out"), str(tmp_path / "check"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_minute_bars_stream(spark, tmp_path):
    ticks = tb.ticks(spark, "/root/testdata/sf0.001").select("symbol", F.col("ts").cast("timestamp").alias("ts"), "price")
    ticks.write.parquet(str(tmp_path / "t"))
    q = inc.minute_bars(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "t"))).writeStream.format("memory").queryName("bars").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from bars").first()[0] == ticks.count()


def test_sources(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"a": "b", "c": "d"}')
    assert sorted(map(tuple, tb.map_table(spark, str(tmp_path / "m.json"), "old", "new").collect())) == [("a", "b"), ("c", "d")]
    (tmp_path / "n.json").write_text('{"date":"d","symbol_id":"1","broker":"x","data":[{"price":"1","buy":2,"sell":0},{"price":"2","buy":0,"sell":3}]}\n')
    assert tb.nested_prints(spark, str(tmp_path / "n.json")).count() == 2
    (tmp_path / "t.csv").write_text("date,symbol,direction,hold_seconds\n1,2,3,4\n")
    with pytest.raises(ValueError):
        tb.trade_log(spark, str(tmp_path / "t.csv"))
    p = tb.prints(spark, "/root/testdata/sf0.001")
    tb.write_by_symbol(tb.daily_summary(p), str(tmp_path / "daily"))
    assert spark.read.parquet(str(tmp_path / "daily")).count() == tb.daily_summary(p).count()
    tb.save_report(tb.prices(p), str(tmp_path / "r"), ("csv", "parquet", "json"))
    assert spark.read.json(str(tmp_path / "r.json")).count() == spark.read.parquet(str(tmp_path / "r.parquet")).count()


def test_daily_marks_against_a_loop(spark):
    """Every date of a symbol from an account's first trade on, also those on which only others trade; closed positions have no rows."""
    r = random.Random(4)
    rows, close = [], {}
    for s in ("A", "B"):
        days = sorted(r.sample(range(60), 40))
        close.update({(s, day(d)): round(r.uniform(5, 20), 2) for d in days})
        for b in ("x", "y", "z"):
            for d in sorted(r.sample(days, 9)):
                bs, ss = r.choice([(10, 0), (0, 10), (30, 10), (0, 25), (7, 7)])
                rows.append((s, b, day(d), bs, ss, bs * r.uniform(5, 20), ss * r.uniform(5, 20)))
    rows.sort(key=lambda x: x[2])
    want = {}
    for s, b in {x[:2] for x in rows}:
        own = [x for x in rows if x[:2] == (s, b)]
        longs, shorts = deque(), deque()
        for d in sorted(k[1] for k in close if k[0] == s and k[1] >= own[0][2]):
            got = 0.0
            for x in (x for x in own if x[2] == d):
                for side, other, n, p, sign in ((longs, shorts, x[4], x[6] / x[4] if x[4] else 0, 1), (shorts, longs, x[3], x[5] / x[3] if x[3] else 0, -1)):
                    while n and side:
                        take = min(n, side[0][0])
                        got += sign * take * (p - side[0][1])
                        n -= take
                        side[0][0] -= take
                        if not side[0][0]:
                            side.popleft()
                    if n:
                        other.append([n, p])
            c = close[s, d]
            mark = sum(n * (c - p) for n, p in longs) + sum(n * (p - c) for n, p in shorts)
            if abs(got) > 1e-6 or abs(mark) > 1e-6:
                want[s, b, d] = (got, mark)
    out = ho.daily_marks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(s, d, c) for (s, d), c in close.items()], PRICES)).collect()
    got = {(x.symbol, x.broker, x.date): (x.realized_pnl, x.unrealized_pnl) for x in out}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert any(k[2] not in {x[2] for x in rows if x[:2] == k[:2]} for k in want)


def test_period_counts_from_its_first_day_and_holders(spark):
    """The start counts, marks before it are taken off, and an account that only holds is ranked."""
    m = spark.createDataFrame([("A", "x", day(1), 0.0, 5.0), ("A", "x", day(3), 2.0, 9.0), ("A", "y", day(2), 7.0, 0.0), ("A", "z", day(0), 0.0, 4.0), ("A", "z", day(4), 0.0, 1.0)], "symbol string, broker string, date date, realized_pnl double, unrealized_pnl double")
    at = lambda i: F.lit(day(i))
    assert {x.broker: x.total_pnl for x in ho.period(m, at(2), at(4)).collect()} == {"x": 6.0, "y": 7.0, "z": -3.0}
    assert {x.broker: x.total_pnl for x in ho.period(m, at(2), at(4), baseline=False).collect()} == {"x": 11.0, "y": 7.0, "z": 1.0}


def test_churn_nets_over_brokers(spark):
    d = spark.createDataFrame([("A", "x", day(1), 100, 0, 0.0, 0.0), ("A", "y", day(1), 0, 90, 0.0, 0.0)], SCHEMA)
    assert ho.churn(d).first().churn_ratio == pytest.approx(190 / 11)


def test_ranking_report_against_loops(spark):
    """Timing, correlations and style of each account from dense lists of days, and nulls for accounts with few days or without a closed trade."""
    import numpy as np

    from flowlens.operators import scorecards as so
    from flowlens.operators import series as se

    rng = np.random.default_rng(5)
    dates = [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(60)]
    close = dict(zip(dates, (100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))).tolist(), strict=True))
    rows = [("X", b, d, int(rng.integers(0, 50)), int(rng.integers(1, 50))) for b, m in (("A", 60), ("B", 25), ("C", 5)) for d in sorted(rng.choice(dates, m, replace=False).tolist())]
    daily = spark.createDataFrame([(*r, r[3] * close[r[2]], r[4] * close[r[2]]) for r in rows], "symbol string, broker string, date date, buy_shares long, sell_shares long, buy_amount double, sell_amount double")
    prices = spark.createDataFrame([("X", d, c) for d, c in close.items()], "symbol string, date date, close double")
    final = spark.createDataFrame([("X", "A", 1, 1.0, 2.0, 3.0), ("X", "B", 2, 0.0, 1.0, 1.0)], "symbol string, broker string, pos int, realized_pnl double, unrealized_pnl double, total_pnl double")
    execution = spark.createDataFrame([("X", "A", 7, 0.5)], "symbol string, broker string, trades long, execution_alpha double")
    out = {r.broker: r for r in so.ranking_report(daily, final, execution, se.returns(prices), prices, 20).collect()}
    days = dates[1:]
    ret = np.array([close[d] / close[p] - 1 for p, d in zip(dates, days, strict=False)])
    for b in "AB":
        net = {r[2]: r[3] - r[4] for r in rows if r[1] == b}
        x = np.array([net.get(d, 0) for d in days], float)
        assert abs(out[b].timing_alpha - ((x[:-1] - x.mean()) * ret[1:]).sum()) < 1e-9
        assert abs(out[b].lead_corr - np.corrcoef(x[:-1], ret[1:])[0, 1]) < 1e-9 and abs(out[b].lag_corr - np.corrcoef(ret[:-1], x[1:])[0, 1]) < 1e-9
        assert out[b].style == ("with the trend" if out[b].lag_corr > 0.05 else "against it" if out[b].lag_corr < -0.05 else "neutral") and 0 <= out[b].p <= 1
        assert out[b].trading_days == len(net) and out[b].cumulative_net == sum(net.values())
    assert (out["A"].trades, out["A"].execution_alpha, out["B"].trades, out["B"].execution_alpha) == (7, 0.5, 0, None)
    assert out["C"].timing_alpha is None and out["C"].p is None and out["C"].style is None and out["C"].timing is None and out["C"].rank is None and out["C"].trading_days == 5


def test_a_day_at_exactly_sigma_deviations_is_not_large(spark):
    """Accounts of 6 to 12 days, one of which lies at exactly two deviations: whole sums decide, not the order of a floating-point one."""
    import itertools

    rows, k = [], 0
    for n in range(6, 13):
        for rest in itertools.combinations_with_replacement(range(0, 9), 3):
            nets = [*rest, *[0] * (n - 4)]
            for x in range(1, 80):
                v = [*nets, x]
                s, q = sum(v), sum(a * a for a in v)
                if n * x > s and (n * x - s) ** 2 * (n - 1) == 4 * n * (n * q - s * s):
                    for scale in (1, 3, 7, 61):
                        rows += [("A", f"b{k}", dt.date(2020, 1, 1 + i), a * scale, 0) for i, a in enumerate(v)]
                        k += 1
    assert k > 50
    daily = spark.createDataFrame(rows, "symbol string, broker string, date date, buy_shares long, sell_shares long")
    assert ev.large_trades(daily).count() == 0
    assert ev.large_trades(daily, 1.99).select("broker").distinct().count() == k


def test_equity_beyond_a_double(spark):
    """Returns that multiply to more than a double holds: logarithm, sign and drawdown stay finite and right."""
    days = [("x", dt.date(2020, 1, 1) + dt.timedelta(days=i), r) for i, r in enumerate([1e9] * 40 + [-0.5, -3.0, -0.5])]
    x = bt.performance(spark.createDataFrame(days, "strategy string, date date, ret double"), ("strategy",)).first()
    assert x.log_equity == pytest.approx(40 * math.log1p(1e9) + math.log(0.5 * 2 * 0.5), rel=1e-12) and x.equity_sign == -1
    assert x.max_drawdown == pytest.approx(-2.0)
